"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Lines are poor units, as a copied passage may start and end within one. Documents are
cut into paragraphs by their content instead: a cut falls where a hash of two successive
words is the lowest among its neighbours, so equal passages are cut alike wherever they
stand. Equal paragraphs meet by their hash. Others meet if they agree in a band of
MinHash values over five-word shingles; the exact Jaccard similarity of what meets is
verified, and connected components say which paragraphs are one. A run is a row of such
paragraphs that stand in two documents or more; it goes on across edited words where the
paragraphs on both sides stand in one other document, as far apart.

Whole paragraphs don't reach to the ends of a copied passage. A run long enough is one
for sure; a shorter one is compared with the other document word by word, from each of
its paragraphs outwards across single edits, and is one if so they share enough words.
What goes is decided by paragraph: each stays in the smallest id that has it.

Two paragraphs of similarity 0.8 agree in one of ``BANDS`` bands of ``ROWS`` values with
probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.983. Paragraphs of fewer than
``LEAST_BANDED`` words have so few shingles that 0.8 or more means equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import LARGE_BATCHES, discard, materialize, settings, use_small_batches
from spindrift.llm.components import connected_components

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 4, 2
#: A cut is the lowest of its neighbours up to this many words away; paragraphs have some 9 words.
CUT_REACH = 4
LONGEST = 64
#: Successive equal words that make a run of their own.
RUN = 16
LEAST_BANDED = 8
#: Words that two documents share in a row, edits aside, to make a passage.
LEAST_PASSAGE = 50
#: Words of whole paragraphs that a run needs to be compared word by word. Of 51 copied words they cover fewer in 2 cases of 1,000 (simulated).
LEAST_CORE = 20
#: Words between two paragraphs of a run: one too short to be a paragraph of its own.
RUN_GAP = SHINGLE - 1
#: Words between two paragraphs of a run that another document has at the same distance, up to SHIFT words: an edited paragraph or two.
BRIDGE = 24
SHIFT = 4
#: As LEAST_CORE, for a run with such a bridge.
LEAST_BRIDGED = 12
#: Edits that a comparison goes across on either side, and the equal words that must follow one.
EDITS = 3
RESYNC = 3
#: Words in one row of a text that is compared word by word.
WORD_BLOCK = 64
#: Members of a bucket that are compared in one group; larger buckets go in pairs of blocks.
BLOCK = 512
REMEMBERED = 300_000
SEED = 1

_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def cuts(symbols: np.ndarray) -> np.ndarray:
    """First words of the paragraphs of a text whose words have these hashes."""
    n = len(symbols)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    value = _mix(symbols[:-1] * _M1 ^ symbols[1:], 11)
    lowest = np.ones(n - 1, bool)
    for d in range(1, CUT_REACH + 1):
        # Of equal values the first counts.
        lowest[d:] &= value[d:] < value[:-d]
        lowest[:-d] &= value[:-d] <= value[d:]
    lowest[0] = True
    # One word over and over has no lowest place: such a run is cut at its ends and at even steps.
    turns = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    spans = np.diff(np.append(turns, n))
    found = np.flatnonzero(lowest)
    if spans.max() >= RUN:
        extra = [np.append(np.arange(s, s + k - RUN + 1, RUN), s + k) for s, k in zip(turns.tolist(), spans.tolist(), strict=True) if k >= RUN]
        found = np.unique(np.concatenate([found, *extra]))
        found = found[found < n]
    lengths = np.diff(np.append(found, n))
    if lengths.max() > LONGEST:
        found = np.concatenate([np.arange(s, s + k, LONGEST) for s, k in zip(found.tolist(), lengths.tolist(), strict=True)])
    return found


class Paragraphs:
    """Paragraphs of texts: their words' hashes, cuts and shingles."""

    def __init__(self):
        self.words = _Words()

    def symbols(self, text: str) -> np.ndarray:
        own = _WORD.findall(text.lower())
        return np.fromiter(map(self.words.__getitem__, own), np.uint64, len(own))

    def split(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, first words, lengths, hashes) of the paragraphs of ``SHINGLE`` words or more."""
        symbols = self.symbols(text)
        first = cuts(symbols)
        length = np.diff(np.append(first, len(symbols)))
        enough = length >= SHINGLE
        first, length = first[enough], length[enough]
        raw = symbols.tobytes()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(raw[8 * s : 8 * (s + k)], SEED) for s, k in zip(first.tolist(), length.tolist(), strict=True)], np.uint64)
        return symbols, first, length, hashes


def shingles(symbols: np.ndarray) -> np.ndarray:
    """A hash of every five successive words."""
    n = len(symbols) - SHINGLE + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = _mix(out ^ symbols[k : k + n], k + 1)
    return out


def band_keys(grams: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` keys for each paragraph (none shorter than a shingle)."""
    if not len(first):
        return np.empty((0, BANDS), np.uint64)
    edges = np.empty(2 * len(first), np.int64)
    edges[0::2] = first
    edges[1::2] = first + length - SHINGLE + 1
    trailing = edges[-1] >= len(grams)
    out = np.empty((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(first), band + 1, np.uint64)
        for row in range(ROWS):
            value = _mix(grams, 100 + band * ROWS + row)
            key = _mix(key ^ np.minimum.reduceat(value, edges[:-1] if trailing else edges)[::2], 50)
        out[:, band] = key
    return out


_UNITS = "spot bigint, hash bigint, n int, head bigint, more array<bigint>, grams array<int>"


def _sets_of(values: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, members) of each paragraph's set of shingles, sorted."""
    size = length - SHINGLE + 1
    unit = np.repeat(np.arange(len(first)), size)
    within = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    member = values[np.repeat(first, size) + within]
    order = np.lexsort((member, unit))
    unit, member = unit[order], member[order]
    new = np.ones(len(unit), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (member[1:] != member[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(unit[new], minlength=len(first)))]).astype(np.int32), member[new]


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each paragraph: id, spot (first word times 128, plus the number of words) and hash.

    The first of equal paragraphs of a batch has their number ``n`` and ``head``, the key
    of the first band (the hash, if it is too short for bands). If no batch just before had
    it, either, it has the keys of the other bands, ``more``, and its shingles, ``grams``.
    """
    own = Paragraphs()
    sent: set[int] = set()
    for batch in batches:
        parts, rows, base = [], [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text:
                symbols, first, length, found = own.split(text)
                if len(first):
                    grams = shingles(symbols)
                    parts.append((grams, first + base, length, found, first))
                    rows.append(np.full(len(first), i))
                    base += len(grams)
        if not parts:
            continue
        grams, first, length, hashes, place = (np.concatenate([p[k] for p in parts]) for k in range(5))
        keys = band_keys(grams, first, length)
        once, at, counts = np.unique(hashes, return_index=True, return_counts=True)
        n = np.zeros(len(hashes), np.int32)
        n[at] = counts
        banded = length >= LEAST_BANDED
        fresh = np.zeros(len(hashes), bool)
        fresh[at] = [h not in sent for h in once.tolist()]
        fresh &= banded
        if len(sent) > REMEMBERED:
            sent.clear()
        sent.update(once.tolist())
        offsets, members = _sets_of((grams >> np.uint64(32)).astype(np.uint32).view(np.int32), first[fresh], length[fresh])
        counted = n > 0
        spread = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.concatenate(rows))),
                pa.array(place * 128 + length),
                pa.array(hashes.view(np.int64)),
                pa.array(n, mask=~counted),
                pa.array(np.where(banded, keys[:, 0], hashes).view(np.int64), mask=~counted),
                _lists(spread * (BANDS - 1), keys[fresh, 1:].ravel().view(np.int64), fresh),
                _lists(offsets[spread], members, fresh),
            ],
            names=[batch.schema.names[0], "spot", "hash", "n", "head", "more", "grams"],
        )


def _lists(offsets: np.ndarray, values: np.ndarray, there: np.ndarray) -> pa.ListArray:
    """Lists of ``values``; null where not ``there``."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=pa.array(~there))


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, hash, n), sorted: hashes seen twice or more (key null), and the members of buckets of two hashes or more."""
    held: tuple[np.ndarray, ...] | None = None

    def settle(key: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> pa.RecordBatch | None:
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(n, at)
        key, hashes = key[at], hashes[at]
        twice = hashes[total >= 2]
        shared = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        shared[1:] |= same
        shared[:-1] |= same
        keys = pa.array(np.concatenate([np.zeros(len(twice), np.int64), key[shared]]), mask=np.concatenate([np.ones(len(twice), bool), np.zeros(int(shared.sum()), bool)]))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate([twice, hashes[shared]]))], names=["key", "hash"])

    for batch in batches:
        now = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if held is not None:
            now = tuple(np.concatenate([a, b]) for a, b in zip(held, now, strict=True))
        if not len(now[0]):
            continue
        # The last key may go on in the next batch; of its rows, one for each hash is held.
        start = int(np.searchsorted(now[0], now[0][-1], "left"))
        if start:
            yield settle(*(x[:start] for x in now))
        tail = tuple(x[start:] for x in now)
        new = np.append(True, tail[1][1:] != tail[1][:-1])
        at = np.flatnonzero(new)
        held = tail[0][at], tail[1][at], np.minimum(np.add.reduceat(tail[2], at), 2).astype(np.int32)
    if held is not None and len(held[0]):
        yield settle(*held)


def similar(a: frozenset[int], b: frozenset[int]) -> bool:
    """Whether the exact Jaccard similarity of two shingle sets reaches ``SIMILAR``."""
    small, large = sorted((len(a), len(b)))
    if small < SIMILAR * large:
        return False
    both = len(a & b)
    return both >= SIMILAR * (small + large - both) - 1e-9


def bucket_links(hashes: list[int], grams: list[list[int]], groups: list[int]) -> list[tuple[int, int]]:
    """Links that join what all pairs at ``SIMILAR`` or more would join: a pair already in one group needs no look."""
    sets = [frozenset(g) for g in grams]
    parts: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        parts.setdefault(g, []).append(i)
    links: list[tuple[int, int]] = []
    whole: list[list[int]] = []
    for members in parts.values():
        joined, rest = list(members), []
        for other in whole:
            pair = next(((i, j) for i in members for j in other if similar(sets[i], sets[j])), None)
            if pair:
                links.append((hashes[pair[0]], hashes[pair[1]]))
                joined += other
            else:
                rest.append(other)
        whole = [*rest, joined]
    return links


def _linker(n_keys: int):
    """Links of each group of rows (keys ..., hash, grams, comp) that come sorted by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple | None, list[int], list[list[int]], list[int]] = (None, [], [], [])
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)), strict=True))
            hashes, grams, comps = (batch.column(n_keys + k).to_pylist() for k in range(3))
            links: list[tuple[int, int]] = []
            for k, key in enumerate(keys):
                if key != held[0]:
                    if len(held[1]) > 1:
                        links += bucket_links(*held[1:])
                    held = (key, [], [], [])
                held[1].append(hashes[k])
                held[2].append(grams[k])
                held[3].append(comps[k])
            if links:
                yield _edges(links)
        if len(held[1]) > 1:
            yield _edges(bucket_links(*held[1:]))

    return run


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["src", "dst"])


def _group_links(rows: DataFrame, *keys: str) -> DataFrame:
    # By number, so that partitions of few bytes but many comparisons aren't put together.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "hash", "grams", "comp").repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_linker(len(keys)), "src bigint, dst bigint")


def _similar_links(members: DataFrame, contents: DataFrame) -> DataFrame:
    """Verified links among the members (key, hash) of each bucket.

    Buckets are compared in blocks first. What is then still in several components of a
    bucket of more than one block is compared across blocks, too, so no link between
    components is missed whatever a bucket's size.
    """
    wanted = members.select("hash").distinct()
    found = materialize(contents.join(wanted, "hash").dropDuplicates(["hash"]), "repeat-contents")
    full = materialize(members.join(found, "hash"), "repeat-members")
    # A table of its own for the same reason as the owners below: the join can then split a crowded bucket.
    sizes = materialize(full.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "repeat-sizes")
    dealt = materialize(full.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")), "repeat-dealt")
    first = materialize(_group_links(dealt.withColumn("comp", F.col("hash")), "key", "block"), "repeat-links")
    if not dealt.where("blocks > 1").limit(1).count():
        return first
    comps = connected_components(first, "repeat-first")
    crowded = dealt.where("blocks > 1").join(comps.withColumnsRenamed({"node": "hash", "component": "comp"}), "hash", "left").withColumn("comp", F.coalesce("comp", "hash"))
    apart = crowded.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("key")
    pairs = crowded.join(apart, "key", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other != block")
    pairs = pairs.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return first.unionAll(_group_links(pairs, "key", "low", "high"))


def shared_beside(own: dict[int, int], other: dict[int, int], at: int, shift: int, step: int) -> int:
    """Words from ``at`` on, forwards (step 1) or backwards (-1), that the other text has, too, ``shift`` words on.

    Single words that were put in, left out or replaced are gone across (and counted in),
    ``EDITS`` of them at most, where ``RESYNC`` equal words follow.
    """
    i, j, edits, equal = at, at + shift, 0, 0
    while True:
        a = own.get(i)
        if a is not None and a == other.get(j):
            i, j = i + step, j + step
            equal = abs(i - at)
            continue
        if edits == EDITS:
            return equal
        for x, y in ((1, 1), (1, 0), (0, 1)):
            ahead = [(own.get(i + step * (x + k)), other.get(j + step * (y + k))) for k in range(RESYNC)]
            if all(a is not None and a == b for a, b in ahead):
                i, j, edits = i + step * x, j + step * y, edits + 1
                break
        else:
            return equal


def _block_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each ``WORD_BLOCK`` words of a text: id, number of the block, hashes of its words."""
    own = Paragraphs()
    for batch in batches:
        rows, numbers, parts, ends = [], [], [], [0]
        for i, text in enumerate(batch.column(1).to_pylist()):
            symbols = (own.symbols(text or "") >> np.uint64(32)).astype(np.uint32).view(np.int32)
            for number, low in enumerate(range(0, len(symbols), WORD_BLOCK)):
                rows.append(i)
                numbers.append(number)
                parts.append(symbols[low : low + WORD_BLOCK])
                ends.append(ends[-1] + len(parts[-1]))
        if rows:
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(numbers, pa.int64()), hashes], names=["id", "block", "hashes"])


def _extent_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, run, shared): how many words a paragraph and what is around it share with a document."""
    for batch in batches:
        first, words, shift, blocks = (batch.column(k).to_pylist() for k in range(2, 6))
        shared = []
        for f, n, s, found in zip(first, words, shift, blocks, strict=True):
            own, other = ({b["block"] * WORD_BLOCK + k: h for b in found if b["other"] == side for k, h in enumerate(b["hashes"])} for side in (False, True))
            shared.append(n + shared_beside(own, other, f - 1, s, -1) + shared_beside(own, other, f + n, s, 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], names=["id", "run", "shared"])


def _verified(short: DataFrame, narrow: DataFrame, least_words: int) -> DataFrame:
    """Rows (id, run) of short runs that share ``least_words`` words with one document.

    short: rows (id, run, first, words, low, high). Texts are read again for the documents
    concerned only, and what is compared of them are the words around a paragraph.
    """
    kind = narrow.schema["id"].dataType.simpleString()
    pairs = materialize(
        short.select("id", "run", "first", "words", F.explode(F.array("low", "high")).alias("twin")).where("twin is not null").select("id", "run", "first", "words", F.col("twin.id").alias("twin"), F.col("twin.shift").alias("shift")).distinct(),
        "repeat-pairs",
    )
    wanted = materialize(pairs.select("id").unionAll(pairs.select("twin")).distinct(), "repeat-wanted")
    blocks = materialize(narrow.join(wanted, "id", "left_semi").mapInArrow(_block_batches, f"id {kind}, block bigint, hashes array<int>").distinct(), "repeat-words")
    block = lambda c: F.greatest(F.floor(c / WORD_BLOCK), F.lit(0)).cast("long")
    asked = []
    for other, doc, moved in ((False, "id", F.lit(0)), (True, "twin", F.col("shift"))):
        span = F.sequence(block(F.col("first") + moved - least_words), block(F.col("first") + F.col("words") + moved + least_words))
        asked.append(pairs.select("*", F.lit(other).alias("other"), F.col(doc).alias("of"), F.explode(span).alias("block")))
    met = asked[0].unionAll(asked[1]).join(blocks.withColumnRenamed("id", "of"), ["of", "block"])
    keys = ["id", "run", "first", "words", "shift"]
    both = met.groupBy(*keys, "twin").agg(F.collect_list(F.struct("other", "block", "hashes")).alias("blocks")).select(*keys, "blocks")
    return both.mapInArrow(_extent_batches, f"id {kind}, run bigint, shared bigint").where(F.col("shared") >= least_words).select("id", "run").distinct()


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = LEAST_PASSAGE) -> DataFrame:
    """Rows (id, first_word, end_word, n_words, component_id, removed): part of a passage that other documents have, too.

    Words are runs of letters and digits. ``component_id`` is the smallest id that has (a
    near copy of) the part's paragraphs: the document that keeps them. The part is
    ``removed`` from all others; a passage whose paragraphs are kept by several documents
    has a row for each. So no paragraph goes from every document that has it. Documents
    without such passages have no row; null and empty texts have none; an empty table
    gives an empty one. A null id makes no copy of other documents. A document's own
    repeats don't count, and rows repeated in full count once.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    units = materialize(narrow.mapInArrow(_unit_batches, f"id {kind}, {_UNITS}"), "repeat-units")
    more = units.where("more is not null").select(F.explode("more").alias("key"), "hash", F.lit(0).alias("n"))
    bands = units.where("n is not null").select(F.col("head").alias("key"), "hash", "n").unionAll(more)
    sorted_bands = bands.repartition("key").sortWithinPartitions("key", "hash")
    with settings(spark, **LARGE_BATCHES):
        buckets = materialize(sorted_bands.mapInArrow(_bucket_batches, "key bigint, hash bigint"), "repeat-buckets")
    contents = units.where("grams is not null").select("hash", "grams")
    links = _similar_links(buckets.where("key is not null"), contents)
    comps = connected_components(links, "repeat").withColumnsRenamed({"node": "hash", "component": "comp"})
    repeated = buckets.where("key is null").select("hash").distinct()
    named = repeated.join(comps, "hash", "full_outer").select("hash", F.coalesce("comp", "hash").alias("comp"))
    spots = materialize(units.join(named, "hash").select("id", "spot", "comp"), "repeat-spots")
    discard(units, buckets)
    # As a table of its own, so that the join deals both sides anew and can split a component that very many documents share.
    spot = F.when(F.col("id").isNotNull(), F.struct("id", "spot"))
    owners = materialize(spots.groupBy("comp").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low.id != high.id"), "repeat-owners")
    place = lambda c: F.floor(F.col(c) / 128)
    # Where else the paragraph is: in the first and the last document that have it, and by how many words it is shifted there.
    twin = lambda c: F.when(F.col(f"{c}.id") != F.col("id"), F.struct(F.col(f"{c}.id").alias("id"), (place(f"{c}.spot") - place("spot")).alias("shift"))).alias(c)
    placed = spots.join(owners, "comp").select("id", place("spot").alias("first"), (F.col("spot") % 128).alias("words"), F.col("low.id").alias("owner"), twin("low"), twin("high"))
    # Dealt by document once: equal rows and runs are then found without another exchange.
    placed = placed.where("id is not null").repartition("id").distinct()
    in_doc = Window.partitionBy("id").orderBy("first", "words")
    so_far = in_doc.rowsBetween(Window.unboundedPreceding, 0)
    near = lambda a, b: F.coalesce((a["id"] == b["id"]) & (F.abs(a["shift"] - b["shift"]) <= SHIFT), F.lit(False))
    before = {c: F.lag(c).over(in_doc) for c in ("low", "high", "owner")}
    aligned = near(before["low"], F.col("low")) | near(before["low"], F.col("high")) | near(before["high"], F.col("low")) | near(before["high"], F.col("high"))
    gap = F.col("first") - F.max(F.col("first") + F.col("words")).over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = placed.withColumns({"gap": gap, "aligned": aligned, "beside": near(before["low"], F.col("low")), "same": F.coalesce(before["owner"] == F.col("owner"), F.lit(False))})
    runs = runs.withColumn("bridged", F.coalesce((F.col("gap") > RUN_GAP) & (F.col("gap") <= BRIDGE) & F.col("aligned"), F.lit(False)))
    runs = runs.withColumn("opens", ~(F.coalesce(F.col("gap") <= RUN_GAP, F.lit(False)) | F.col("bridged")))
    # A part has one keeper; words between its paragraphs belong to it only where the keeper has the paragraphs as far apart.
    kept = F.col("owner") == F.col("id")
    runs = runs.withColumn("parts", F.col("opens") | ~F.col("same") | ((F.col("gap") > 0) & ~kept & ~F.col("beside")))
    runs = runs.withColumns({"run": F.sum(F.col("opens").cast("long")).over(so_far), "part": F.sum(F.col("parts").cast("long")).over(so_far)})
    whole = Window.partitionBy("id", "run")
    runs = runs.withColumns({"run_words": F.sum("words").over(whole), "run_bridged": F.max("bridged").over(whole)})
    core = F.when(F.col("run_bridged"), min(LEAST_BRIDGED, least_words)).otherwise(min(LEAST_CORE, least_words))
    runs = materialize(runs.where(F.col("run_words") >= core).select("id", "run", "part", "first", "words", "owner", "low", "high", "run_words"), "repeat-runs")
    discard(spots, owners)
    verified = _verified(runs.where(F.col("run_words") < least_words), narrow, least_words)
    passages = runs.where(F.col("run_words") >= least_words).unionByName(runs.where(F.col("run_words") < least_words).join(verified, ["id", "run"], "left_semi").select(*runs.columns))
    parts = passages.groupBy("id", "part").agg(F.min("first").alias("first_word"), F.max(F.col("first") + F.col("words")).alias("end_word"), F.sum("words").alias("n_words"), F.min("owner").alias("component_id"))
    return parts.select(F.col("id").alias(id_column), "first_word", "end_word", "n_words", "component_id", (F.col("component_id") != F.col("id")).alias("removed"))
