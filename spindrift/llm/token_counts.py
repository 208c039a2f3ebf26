"""Token counts without tokens: Viterbi over the matches of a unigram vocabulary.

An Aho-Corasick automaton gives, at each end position, the pieces that end there,
longest first. The dynamic programme keeps for each position the best score and the
number of pieces on the best path, nothing else. Ties go as in public unigram
tokenizers: a later candidate for a position must be strictly better, and candidates
come by ascending start, so of equal paths the one with the longer last piece stays.

No piece has a space mark after another character, and none holds a line feed, so a
text falls into chunks (spaces and what follows them; a line feed) whose best paths are
independent. Counts of short chunks are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import use_small_batches
from spindrift.llm.pieces import DEFAULT_MODEL, SPACE, Vocabulary, read_vocabulary

#: Remembered chunks of a worker, and the longest that is remembered: some 40 MB at most.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(vocabulary.pieces, vocabulary.scores, strict=True):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = vocabulary.unknown_score
        self.by_bytes = vocabulary.bytes_known
        inner = {c for p in vocabulary.pieces for c in p.lstrip(SPACE)}
        # Where a text may be cut is read off the vocabulary, not assumed.
        if SPACE in inner:
            self.chunks = re.compile(r"(?s).+")
        elif "\n" in inner:
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        else:
            self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.known: dict[str, int] = {}

    def count_chunk(self, chunk: str) -> int:
        """Pieces on the best path through one chunk."""
        n = len(chunk)
        best: list[float | None] = [0.0] + [None] * n
        pieces = [0] * (n + 1)
        unknown = self.unknown
        at, single = 0, False  # ends before ``at`` are settled; ``single``: the character that ends at ``at`` is a piece

        def close(end: int) -> None:
            """Settle the ends up to ``end``: a character that is no piece itself may still be an unknown one."""
            nonlocal at, single
            while at < end:
                if at and not single:
                    value = best[at - 1] + unknown
                    if best[at] is None or value > best[at]:
                        best[at] = value
                        pieces[at] = pieces[at - 1] + (len(chunk[at - 1].encode("utf-8", "replace")) if self.by_bytes else 1)
                at += 1
                single = False

        for last, (length, score) in self.automaton.iter(chunk):
            end = last + 1
            if end != at:
                close(end)
            value = best[end - length] + score
            if best[end] is None or value > best[end]:
                best[end] = value
                pieces[end] = pieces[end - length] + 1
            if length == 1:
                single = True
        close(n + 1)
        return pieces[n]

    def count(self, text: str | None) -> int:
        """Pieces of a whole text; a space mark goes before it. Null and empty texts have none."""
        if not text:
            return 0
        known, total = self.known, 0
        for chunk in self.chunks.findall(SPACE + text.replace(" ", SPACE)):
            n = known.get(chunk)
            if n is None:
                n = self.count_chunk(chunk)
                if len(chunk) <= LONGEST_REMEMBERED:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(vocabulary: Vocabulary) -> Counter:
    return Counter(vocabulary)


def _count_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for batch in batches:
            counts = [own.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[batch.schema.names[0], "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """Rows (id, n_tokens): one for each row of ``docs``, repeats included.

    Null and empty texts have 0 tokens; texts of any length are counted whole.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(model))
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return narrow.mapInArrow(_count_batches(shared), f"`{id_column}` {kind}, n_tokens bigint")
