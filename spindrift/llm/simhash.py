"""SimHash near-duplicates: a trie self-join over 64-bit fingerprints.

Fingerprints live in a binary trie, one level a bit. The self-join walks pairs of
trie nodes together from the root; a pair whose paths differ in more bits than the
budget is dropped with everything below it. A sorted array stands for the trie: a
node is a range of it, and its children meet where the next bit turns to 1.

To spread the work, the 64 bits are cut into ``budget + 1`` blocks. Two fingerprints
within the budget agree in at least one whole block, so each block in turn is rotated
to the front and its values are sub-tries joined independently. A crowded pair of nodes
is opened some levels deeper, into the pairs of their descendants within the budget, and
those again as long as any is crowded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import LARGE_BATCHES, discard, fresh_name, materialize, row_marks, settings, use_small_batches
from spindrift.llm.components import connected_components

BITS = 64
#: Bits at which two fingerprints may differ and still link.
BUDGET = 3
SHINGLE_WORDS = 3
SEED = 42
#: A pair of nodes with more fingerprints than this is dealt out as node pairs further down.
CROWDED = 200_000
#: Levels by which a crowded pair is opened at a time.
DEALT_LEVELS = 4
#: Node pairs in one step of the walk; more are put on a stack.
FRONTIER = 1 << 19
#: Node pairs of this many leaf pairs at most are compared leaf by leaf.
SMALL = 16
#: Fingerprints gathered before a walk starts; a walk takes whole sub-tries.
GATHER = 1 << 20


def fingerprint(text: str | None) -> int:
    """SimHash of a text as an unsigned 64-bit number; 0 without words.

    A-Z become lower case; words are runs of anything but ASCII white space; a shingle
    is three words joined by a space, the whole sequence if there are fewer. A bit is 1
    if more than half the shingles' XXH64 values (seed 42), repeats included, have it.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    stops = (ends - 1)[SHINGLE_WORDS - 1 :].tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 1 << 16):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, fp): one for each row of ``docs``; ``fp`` holds the 64 bits as a signed long."""
    use_small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(id_column), F.col(text_column))
    return narrow.mapInArrow(_fingerprint_batches, f"`{id_column}` {kind}, fp bigint")


def trie_pairs(values: np.ndarray, roots: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Walk the trie over sorted distinct ``values`` (uint64) against itself.

    roots: rows (a0, a1, b0, b1, spent) of two ranges whose values share their first
    ``depth`` bits each, and differ in ``spent`` of them; the same range twice for a node
    with itself. Yields index arrays (i, j), i < j, of pairs that differ in ``budget``
    bits at most.
    """
    stack = [(depth, *(roots[:, k] for k in range(4)), roots[:, 4].astype(np.int8))]
    while stack:
        level, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack.append((level, a0[half:], a1[half:], b0[half:], b1[half:], spent[half:]))
            stack.append((level, a0[:half], a1[:half], b0[:half], b1[:half], spent[:half]))
            continue
        few = (a1 - a0) * (b1 - b0) <= SMALL
        if level >= BITS:
            few[:] = True
        if few.any():
            yield from _leaf_pairs(values, a0[few], a1[few], b0[few], b1[few], budget)
            rest = ~few
            a0, a1, b0, b1, spent = a0[rest], a1[rest], b0[rest], b1[rest], spent[rest]
        if not len(a0):
            continue
        same = a0 == b0
        am = _middle(values, a0, a1, level)
        bm = np.where(same, am, _middle(values, b0, b1, level))
        cross = ~same
        parts = [
            (a0, am, b0, bm, spent),
            (am, a1, bm, b1, spent),
            (a0, am, bm, b1, spent + 1),
            (am[cross], a1[cross], b0[cross], bm[cross], spent[cross] + 1),
        ]
        merged = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        alive = (merged[0] < merged[1]) & (merged[2] < merged[3]) & (merged[4] <= budget)
        alive &= ~((merged[0] == merged[2]) & (merged[1] - merged[0] < 2))
        if alive.any():
            stack.append((level + 1, *(m[alive] for m in merged)))


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where, in ranges that share ``level`` bits, the next bit turns to 1."""
    bit = np.uint64(1) << np.uint64(BITS - 1 - level)
    first_one = (values[low] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(values, first_one), low, high)


def _leaf_pairs(values, a0, a1, b0, b1, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (a1 - a0) * (b1 - b0)
    at = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = (b1 - b0)[at]
    i, j = a0[at] + k // wide, b0[at] + k % wide
    keep = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
    if keep.any():
        yield i[keep], j[keep]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each index's smallest index in its group after all pairs."""
    parent = np.arange(n)

    def roots(x: np.ndarray) -> np.ndarray:
        while True:
            up = parent[x]
            if np.array_equal(up, x):
                return x
            x = parent[up]

    for i, j in pairs:
        while True:
            ri, rj = roots(i), roots(j)
            apart = ri != rj
            if not apart.any():
                break
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
    return roots(np.arange(n))


def _walk(rows: np.ndarray, depth: int, block_bits: int, budget: int) -> pa.RecordBatch | None:
    """Links among rows (table, lo, hi, value), sorted: each run of the first three is a pair of nodes ``depth`` levels down."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows["table"][1:] != rows["table"][:-1]) | (rows["lo"][1:] != rows["lo"][:-1]) | (rows["hi"][1:] != rows["hi"][:-1])
    run = np.cumsum(new) - 1
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(rows))
    single = (rows["lo"] == rows["hi"])[low]
    work: list[tuple[int, np.ndarray, np.ndarray]] = []  # table, values, roots
    for table in np.unique(rows["table"][low[single]]):
        # Nodes with themselves lie in order, so one walk takes all of a table's.
        own = single & (rows["table"][low] == table) & (high - low >= 2)
        ends = np.cumsum((high - low)[own])
        starts = ends - (high - low)[own]
        work.append((int(table), rows["value"][own[run]], np.stack([starts, ends, starts, ends, np.zeros(len(ends), np.int64)], axis=1)))
    for k in np.flatnonzero(~single):
        values = rows["value"][low[k] : high[k]]
        cut = int(np.searchsorted(values >> np.uint64(BITS - depth), np.uint64(rows["hi"][low[k]])))
        if 0 < cut < len(values):
            spent = int(rows["lo"][low[k]] ^ rows["hi"][low[k]]).bit_count()
            work.append((int(rows["table"][low[k]]), values, np.array([[0, cut, cut, len(values), spent]])))
    found_a, found_b = [], []
    for table, part, roots in work:
        values = np.ascontiguousarray(part)
        top = _forest(len(values), trie_pairs(values, roots, depth, budget))
        linked = np.flatnonzero(top != np.arange(len(top)))
        found_a.append(_unrotate(values[linked], table * block_bits))
        found_b.append(_unrotate(values[top[linked]], table * block_bits))
    if not found_a:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], names=["src", "dst"])


def _unrotate(values: np.ndarray, turn: int) -> np.ndarray:
    return values if not turn else (values >> np.uint64(turn)) | (values << np.uint64(BITS - turn))


def _linker(depth: int, block_bits: int, budget: int):
    kind = np.dtype([("table", np.int32), ("lo", np.int64), ("hi", np.int64), ("value", np.uint64)])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in batches:
            rows = np.empty(batch.num_rows, kind)
            for name in ("table", "lo", "hi"):
                rows[name] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            # The column is ordered as signed; flipping the top bit back gives the unsigned value.
            rows["value"] = batch.column(batch.schema.get_field_index("ordered")).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63)
            held.append(rows)
            count += len(rows)
            if count >= GATHER:
                rows = np.concatenate(held)
                # The last pair of nodes may go on in the next batch.
                tail = rows[-1]
                cut = int(np.argmax((rows["table"] == tail["table"]) & (rows["lo"] == tail["lo"]) & (rows["hi"] == tail["hi"])))
                if cut and (out := _walk(rows[:cut], depth, block_bits, budget)) is not None:
                    yield out
                held, count = [rows[cut:]], len(rows) - cut
        if count and (out := _walk(np.concatenate(held), depth, block_bits, budget)) is not None:
            yield out

    return links


def _opened(pairs: DataFrame, depth: int, levels: int, budget: int) -> DataFrame:
    """Rows (table, turned, lo, hi) of node pairs ``depth`` levels down, dealt to the pairs of descendants ``levels`` further down."""
    own = F.shiftrightunsigned("turned", BITS - depth - levels)
    masks = F.array(*map(F.lit, range(1 << levels)))
    bits = F.shiftrightunsigned("turned", BITS - depth - levels).bitwiseAND((1 << levels) - 1)
    # The mate is a descendant of the pair's other node (of the same node, where a node is paired with itself).
    above = F.when(F.shiftrightunsigned("turned", BITS - depth) == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    dealt = pairs.select("table", "turned", own.alias("own"), above.alias("above"), bits.alias("bits"), F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))).alias("spent"), F.explode(masks).alias("mask"))
    mate = F.shiftleft("above", levels).bitwiseOR(F.col("bits").bitwiseXOR(F.col("mask")))
    dealt = dealt.where(F.col("spent") + F.bit_count("mask") <= budget).withColumn("mate", mate)
    return dealt.select("table", "turned", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi"))


def hamming_links(values: DataFrame, budget: int = BUDGET, crowded: int = CROWDED, dealt_levels: int = DEALT_LEVELS) -> DataFrame:
    """Links (src, dst) among the distinct values of column ``fp``.

    They connect what the pairs at ``budget`` bits or fewer connect: within a pair of nodes
    the walk sees every such pair and a spanning forest of them is returned, so a
    crowd of near copies gives as many links as members, not their square. A pair of
    nodes with more than ``crowded`` values is opened, again and again, so no task gets
    many more, however many values begin alike.
    """
    spark = values.sparkSession
    tables = budget + 1
    block = BITS // tables
    distinct = values.select("fp").where("fp is not null").distinct()
    turns = [
        F.struct(
            F.lit(k).alias("table"),
            (F.col("fp") if not k else F.shiftleft("fp", k * block).bitwiseOR(F.shiftrightunsigned("fp", BITS - k * block))).alias("turned"),
        )
        for k in range(tables)
    ]
    head = F.shiftrightunsigned("turned", BITS - block)
    keys = ["table", "lo", "hi"]
    pairs = materialize(distinct.select(F.explode(F.array(*turns)).alias("x")).select("x.table", "x.turned").withColumns({"lo": head, "hi": head}), "trie-pairs")
    depth, found, done = block, None, []
    while True:
        crowds = materialize(pairs.groupBy(*keys).count().where(F.col("count") > crowded).select(*keys), "trie-crowds")
        done += [pairs, crowds]
        last = depth + dealt_levels >= BITS or crowds.isEmpty()
        ready = pairs if last else pairs.join(crowds, keys, "left_anti")
        ordered = ready.select(*keys, F.col("turned").bitwiseXOR(F.lit(-(1 << 63))).alias("ordered")).repartition(*keys).sortWithinPartitions(*keys, "ordered")
        with settings(spark, **LARGE_BATCHES):
            links = materialize(ordered.mapInArrow(_linker(depth, block, budget), "src bigint, dst bigint"), "trie-links")
        found = links if found is None else found.unionAll(links)
        if last:
            discard(*done)
            return found
        pairs = materialize(_opened(pairs.join(crowds, keys, "left_semi"), depth, dealt_levels, budget), "trie-pairs")
        depth += dealt_levels


def near_duplicate_components(prints: DataFrame, id_column: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """Add ``component_id`` to rows (id, fp): the smallest id reachable over links.

    Equal fingerprints link; so do those within ``budget`` bits. A null id is never
    the smallest; a component of null ids only has a null component_id. Repeated rows
    stay; an empty table gives an empty one.
    """
    groups = connected_components(hamming_links(prints, budget), "simhash").withColumnsRenamed({"node": "fp", "component": "root"})
    lowest = materialize(
        prints.groupBy("fp").agg(F.min(id_column).alias("low")).join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "simhash-lowest",
    )
    named = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(lowest.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp")


def simhash_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    A null text counts as empty: fingerprint zero, which links like any other. Repeated
    rows come back as often; an empty table gives an empty one.
    """
    prints = materialize(fingerprints(docs, id_column, text_column), "simhash-prints")
    return near_duplicate_components(prints, id_column, budget).select(
        id_column, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", budget: int = BUDGET) -> DataFrame:
    """Keep one row of each group: the smallest id (nulls last), then the smallest row hash.

    All columns of ``docs`` come back unchanged, whatever their names. A null text counts
    as empty, and empty texts are one group; of rows equal in all columns one stays; an
    empty table gives an empty one. Groups are found on narrow rows (two hashes of the
    row, its id, its fingerprint). Equal rows meet as partial results, so that whole rows
    go through one exchange, by their own hashes, and no crowd of equal rows into one task.
    """
    columns = docs.columns
    use_small_batches(docs.sparkSession)
    marks = [fresh_name(docs, x) for x in ("row_mark", "row_check")]
    marked = docs.withColumns(dict(zip(marks, row_marks(docs), strict=True)))
    narrow = marked.select(*[F.col(f"`{c}`").alias(a) for c, a in zip([*marks, id_column, text_column], ["mark", "check", "id", "text"], strict=True)])
    kind = docs.schema[id_column].dataType.simpleString()
    prints = materialize(narrow.mapInArrow(_fingerprint_batches, f"mark bigint, check bigint, id {kind}, fp bigint"), "simhash-marks")
    groups = connected_components(hamming_links(prints, budget), "simhash").withColumnsRenamed({"node": "fp", "component": "root"})
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark", "check"))
    by_print = prints.groupBy("fp").agg(first.alias("first")).join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = materialize(by_print.groupBy("root").agg(F.min("first").alias("first")).select(*[F.col(f"first.{a}").alias(c) for c, a in zip(marks, ("mark", "check"), strict=True)]), "simhash-kept")
    return marked.dropDuplicates(marks).join(kept, marks, "left_semi").select(*[F.col(f"`{c}`") for c in columns])
