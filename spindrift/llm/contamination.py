"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit verification.

Texts are sequences of words. The CGK random walk embeds a sequence: at step j it reads
the word it stands on and moves on if a random bit of (word, j) says so. Two sequences a
few edits apart soon read the same words at the same steps again, so edit distance
becomes Hamming distance between what is read. Each hash table keeps what the walk reads
at a few sampled steps; windows that agree in all of them are candidates. Steps are
sampled where the walk is still inside a window of the item's size.

A benchmark item is entered once for each of its first ``STARTS`` words as a start, so
walks over documents need to start at every ``STRIDE``-th word only: ``STARTS / STRIDE`` of
them fall on starts of the item and each is a chance to agree. Candidates are verified by the exact edit distance between the
whole item and its best place in the document.

Items longer than ``PIECE`` words are entered piece by piece: of an item within the edit
limit, some piece is too. Items shorter than ``SHORT`` words have no room for sampling:
of one more piece than edits are allowed some piece stays whole, so each piece is looked
up as it is, and the item is verified around it. None of them is missed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spindrift.llm.common import use_small_batches

#: Edits allowed as a share of the item's words: similarity of 0.8 or more.
EDIT_SHARE = 0.2
STRIDE = 4
STARTS = 12
PIECE = 64
SHORT = 13
#: Least words of the items of a class; a class has tables of its own.
CLASSES = (13, 18, 27, 40)
#: Tables of a class, and steps that a table samples.
TABLES = 20
SAMPLES = 4
#: Steps are drawn up to this many times the words that every window of a class has.
REACH = 1.4
#: Windows that walk at once.
AT_ONCE = 1 << 14
#: Words of benchmark text that go to the tasks in one block; a larger benchmark takes several passes.
BLOCK_WORDS = 200_000
REMEMBERED = 300_000
SEED = 8

_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(dict):
    """Hash of each word; never 0, which marks the space between texts."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(word, SEED) | 1
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    x = values ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    x ^= x >> np.uint64(31)
    x[values == 0] = 0  # the walk never leaves the space after a text
    return x


def walk(symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """What the walks from ``starts`` read at the given steps (ascending): a row for each step."""
    seen = np.empty((len(steps), len(starts)), np.uint64)
    at = starts.astype(np.int64)
    wanted = {int(s): k for k, s in enumerate(steps)}
    one = np.uint64(1)
    for step in range(int(steps[-1]) + 1):
        if step % 64 == 0:
            bits = _mix(symbols, 1 + step // 64)
        if step in wanted:
            seen[wanted[step]] = symbols[at]
        at += ((bits[at] >> np.uint64(step % 64)) & one).astype(np.int64)
    return seen


def sampled_steps(least_words: int, tables: int = TABLES, samples: int = SAMPLES) -> np.ndarray:
    """Steps of each table of a class: fixed by the class, alike on all machines."""
    last = max(samples, int(REACH * (least_words - STRIDE + 1)))
    draw = np.random.RandomState(1000 * least_words + 7)
    return np.stack([np.sort(draw.choice(last, samples, replace=False)) for _ in range(tables)])


def _keys(seen: np.ndarray, rows: np.ndarray, salt: int) -> np.ndarray:
    key = np.full(seen.shape[1], (salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for r in rows:
        key = (key ^ seen[r]) * _M1
        key ^= key >> np.uint64(29)
    return key


@dataclass
class Item:
    item_id: int | None
    symbols: tuple[int, ...]


class Index:
    """The items' hash tables: sorted keys, and a bit map that rules most other keys out."""

    def __init__(self, items: list[Item]):
        self.items = items
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)  # least words of a class: (item, first word)
        #: Pieces of short items: by words and key, (item, first word).
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for number, item in enumerate(items):
            n = len(item.symbols)
            if n < SHORT:
                pieces = int(EDIT_SHARE * n + 1e-9) + 1
                for k in range(pieces if n else 0):
                    low, high = k * n // pieces, (k + 1) * n // pieces
                    self.seeds[high - low][int(_sequence_keys(np.array(item.symbols[low:high], np.uint64), high - low)[0])].append((number, low))
                continue
            pieces = max(1, -(-n // PIECE))
            for k in range(pieces):
                low, high = k * n // pieces, (k + 1) * n // pieces
                least = max(c for c in CLASSES if c <= high - low)
                entries[least] += [(number, low + o) for o in range(min(STARTS, high - low))]
        self.classes: list[tuple[int, np.ndarray]] = [(c, sampled_steps(c)) for c in sorted(entries)]
        self.steps = np.unique(np.concatenate([s.ravel() for _, s in self.classes])) if self.classes else np.empty(0, np.int64)
        keys, owners, firsts = [], [], []
        for least, tables in self.classes:
            symbols = np.concatenate([np.append(np.array(items[i].symbols, np.uint64), np.uint64(0)) for i, _ in entries[least]])
            lengths = np.array([len(items[i].symbols) + 1 for i, _ in entries[least]])
            begin = np.cumsum(lengths) - lengths
            first = np.array([o for _, o in entries[least]])
            owner = np.array([i for i, _ in entries[least]])
            seen = walk(symbols, begin + first, self.steps)
            for t, steps in enumerate(tables):
                rows = np.searchsorted(self.steps, steps)
                inside = (seen[rows] != 0).all(axis=0)
                keys.append(_keys(seen, rows, least * 1000 + t)[inside])
                owners.append(owner[inside])
                firsts.append(first[inside])
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owners = np.concatenate(owners)[order] if keys else np.empty(0, np.int64)
        self.firsts = np.concatenate(firsts)[order] if keys else np.empty(0, np.int64)
        size = 1 << max(16, (64 * max(1, len(self.keys))).bit_length())
        self.low = np.uint64(size - 1)
        self.map = np.zeros(size, bool)
        self.map[(self.keys & self.low).astype(np.int64)] = True
        self.masks = [_pattern_masks(i.symbols) for i in items]

    def candidates(self, symbols: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of a walk's start, item, the item's word there) of every agreeing window."""
        for low in range(0, len(starts) if self.classes else 0, AT_ONCE):
            part = starts[low : low + AT_ONCE]
            base = int(part[0])
            window = symbols[base : int(part[-1]) + int(self.steps[-1]) + 2]
            seen = walk(window, part - base, self.steps)
            for least, tables in self.classes:
                for t, steps in enumerate(tables):
                    keys = _keys(seen, np.searchsorted(self.steps, steps), least * 1000 + t)
                    maybe = np.flatnonzero(self.map[(keys & self.low).astype(np.int64)])
                    if not len(maybe):
                        continue
                    left = np.searchsorted(self.keys, keys[maybe], "left")
                    right = np.searchsorted(self.keys, keys[maybe], "right")
                    hits = right - left
                    if hits.any():
                        which = np.repeat(left, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
                        yield np.repeat(part[maybe], hits), self.owners[which], self.firsts[which]


def _sequence_keys(symbols: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n successive words; sequences over the end of a text hold a 0 and match nothing."""
    key = np.full(max(0, len(symbols) - n + 1), n, np.uint64)
    for k in range(n):
        key = (key ^ symbols[k : k + len(key)]) * _M2
        key ^= key >> np.uint64(31)
    return key


def _pattern_masks(symbols: tuple[int, ...]) -> dict[int, int]:
    masks: dict[int, int] = defaultdict(int)
    for i, s in enumerate(symbols):
        masks[s] |= 1 << i
    return dict(masks)


def best_place(masks: dict[int, int], n: int, text: list[int]) -> tuple[int, int]:
    """(edit distance, end) of the best place for a pattern of n words in ``text``: bit-parallel dynamic programming.

    Of equal places the first end counts; an empty text costs the whole pattern.
    """
    full = (1 << n) - 1
    top = 1 << (n - 1)
    plus, minus, score = full, 0, n
    best, end = n, 0
    for k, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1  # a free start: no horizontal step enters at the first row
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, k
    return best, end


def matches(index: Index, symbols: np.ndarray, starts_of: np.ndarray, lengths: np.ndarray, share: float = EDIT_SHARE) -> dict[tuple[int, int], tuple[int, int, int]]:
    """{(text, item): (edit distance, first word, end word)} over texts that lie one after the other in ``symbols``, each followed by a 0."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    walks = np.concatenate([np.arange(s, s + n, STRIDE) for s, n in zip(starts_of, lengths, strict=True)]) if len(lengths) else np.empty(0, np.int64)
    tried: set[tuple[int, int]] = set()

    def settle(text: int, item: int, low: int, high: int) -> None:
        pattern = index.items[item].symbols
        n = len(pattern)
        begin, stop = int(starts_of[text]), int(starts_of[text] + lengths[text])
        low, high = max(begin, low), min(stop, high)
        region = symbols[low:high].tolist()
        allowed = int(share * n + 1e-9)
        # All but ``allowed`` words of the item must find a partner, so that many words of the region are words of it.
        if sum(map(index.masks[item].__contains__, region)) < n - allowed:
            return
        distance, end = best_place(index.masks[item], n, region)
        if distance > allowed:
            return
        if (old := found.get((text, item))) is not None and old[0] <= distance:
            return
        # The place's start: the same search from its end backwards.
        backwards = region[:end][::-1]
        _, back = best_place(_pattern_masks(pattern[::-1]), n, backwards[: n + distance])
        found[text, item] = distance, low + end - back - begin, low + end - begin

    for place, owner, first in index.candidates(symbols, walks):
        text = np.searchsorted(starts_of, place, "right") - 1
        for p, i, o, t in zip(place.tolist(), owner.tolist(), first.tolist(), text.tolist(), strict=True):
            # Starts that differ by a few words look at nearly the same region: one try covers them.
            n = len(index.items[i].symbols)
            slack = int(share * n) + STRIDE
            cell = (p - o) // STRIDE
            if (i, cell) in tried:
                continue
            tried.add((i, cell))
            settle(t, i, p - o - slack - STRIDE, p - o + n + slack + STRIDE)
    for n, table in index.seeds.items():
        keys = _sequence_keys(symbols, n)
        wanted = np.fromiter(table, np.uint64, len(table))
        for p in np.flatnonzero(np.isin(keys, wanted)).tolist():
            t = int(np.searchsorted(starts_of, p, "right") - 1)
            for i, o in table[int(keys[p])]:
                if found.get((t, i), (1,))[0]:
                    whole = len(index.items[i].symbols)
                    slack = int(share * whole + 1e-9)
                    settle(t, i, p - o - slack, p - o + whole + slack)
    return found


class Searcher:
    def __init__(self, rows: list[tuple[int | None, str]]):
        self.words = Words()
        self.index = Index([Item(k, tuple(self.words[w] for w in words_of(t))) for k, t in rows])

    def search(self, texts: list[str]) -> dict[tuple[int, int], tuple[int, int, int]]:
        pieces, lengths = [], []
        for text in texts:
            own = words_of(text)
            lengths.append(len(own))
            pieces.append(np.fromiter(map(self.words.__getitem__, own), np.uint64, len(own)))
            pieces.append(np.zeros(1, np.uint64))
        lengths = np.array(lengths, np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        return matches(self.index, np.concatenate(pieces) if pieces else np.empty(0, np.uint64), starts, lengths)


def benchmark_blocks(benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks of about ``block_words`` words, whatever the benchmark's size."""
    rows = benchmark.select(F.col(f"`{item_column}`").alias("item"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        if found := [(r["item"], r["text"]) for r in part.collect()]:
            yield found


@lru_cache(maxsize=1)
def _searcher(shared) -> Searcher:
    """A block's searcher, made once for each worker."""
    return Searcher(shared.value)


def _match_batches(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(shared)
        for batch in batches:
            found = sorted(searcher.search([t or "" for t in batch.column(1).to_pylist()]).items())
            if not found:
                continue
            items = searcher.index.items
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([t for (t, _), _ in found], pa.int64())),
                    pa.array([items[i].item_id for (_, i), _ in found], kind),
                    *(pa.array([x[k] for _, x in found], pa.int64()) for k in range(3)),
                    pa.array([len(items[i].symbols) for (_, i), _ in found], pa.int64()),
                ],
                names=[batch.schema.names[0], "item_id", "edit_distance", "first_word", "end_word", "item_words"],
            )

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """Rows (id, item_id, edit_distance, first_word, end_word, item_words): a document row that holds an item.

    Words are runs of letters and digits, in lower case. A pair comes once, with the best
    place found. Clean documents have no row; null and empty texts are clean, items
    without words match nothing, equal items match each, repeated documents give
    repeated rows. An empty benchmark gives an empty table.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    id_type, item_type = docs.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    kind = to_arrow_type(benchmark.schema[item_column].dataType)
    schema = f"`{id_column}` {id_type}, item_id {item_type}, edit_distance bigint, first_word bigint, end_word bigint, item_words bigint"
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    out = spark.createDataFrame([], schema)
    for rows in benchmark_blocks(benchmark, item_column, item_text_column):
        out = out.unionAll(narrow.mapInArrow(_match_batches(spark.sparkContext.broadcast(rows), kind), schema))
    return out


def _clean_batches(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _searcher(shared)
        for batch in batches:
            found = searcher.search([t or "" for t in batch.column(text_at).to_pylist()])
            dirty = {t for t, _ in found}
            yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns.

    Null and empty texts are clean and stay, as do repeated rows; items without words
    match nothing; an empty benchmark leaves all rows, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    for rows in benchmark_blocks(benchmark, item_column, item_text_column):
        docs = docs.mapInArrow(_clean_batches(spark.sparkContext.broadcast(rows), docs.columns.index(text_column)), docs.schema)
    return docs
