"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities of the pieces of one fixed public vocabulary. A word's
likelihood under a language is the sum over all its segmentations of the product of the
pieces' probabilities: a forward pass over the word. A text's score is the sum of its
words' log likelihoods. The probabilities come from labelled words by expectation
maximisation (forward-backward over the same lattices).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import id_bucket, use_small_batches
from spindrift.llm.pieces import DEFAULT_MODEL, SPACE, Vocabulary, read_vocabulary

#: The model is fitted on a bounded sample: about this many documents of a language, and all their words.
FIT_DOCS = 2000
ROUNDS = 3
#: Added to each piece's expected count.
SMOOTHING = 0.05
#: Probability of a character that is no piece, the same in all languages.
UNKNOWN = 1e-7
UNDETERMINED = "und"
#: Words longer than this go through the pass in logarithms, where nothing underflows.
LONG_WORD = 38
REMEMBERED = 200_000
#: Words that are looked up in one go.
AT_ONCE = 1 << 16
#: Words whose lattices are worked out together when fitting, on the driver.
FIT_AT_ONCE = 1 << 14

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Lattice:
    """Matches of the vocabulary's pieces in a word that a space mark goes before."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for k, piece in enumerate(vocabulary.pieces):
            self.automaton.add_word(piece, (len(piece), k))
        self.automaton.make_automaton()
        self.size = len(vocabulary.pieces)

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(start, end, piece) by end; piece -1 for a character that is no piece."""
        starts, before, node, piece = self.side_by_side([word])
        return sorted(zip(before.tolist(), node.tolist(), np.where(piece < self.size, piece, -1).tolist(), strict=True), key=lambda a: a[1])

    def side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first node of each word and the end, then of each arc: node before, node, piece) of many words' lattices in a row.

        A word of n characters has n + 2 nodes, as a space mark goes before it. A character
        that is no piece has an arc of its own, whose piece is numbered beyond the last.
        """
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        joined = "".join([SPACE + w for w in words])
        codes = np.fromiter((last << 40 | length << 32 | piece for last, (length, piece) in self.automaton.iter(joined)), np.int64)
        last, length, piece = codes >> 40, (codes >> 32) & 0xFF, codes & 0xFFFFFFFF
        lacking = np.ones(len(joined), bool)
        lacking[last[length == 1]] = False
        extra = np.flatnonzero(lacking)
        last = np.concatenate([last, extra])
        length = np.concatenate([length, np.ones(len(extra), np.int64)])
        piece = np.concatenate([piece, np.full(len(extra), self.size)])
        # Each word before shifts the nodes by one more than its characters. A piece has a space mark at its start only, so none lies in two words.
        node = last + 1 + np.repeat(np.arange(len(words)), lengths)[last]
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        return starts, node - length, node, piece


class Expectation:
    """Expected uses of pieces over weighted words, in logarithms, so that words of any length count."""

    def __init__(self, lattice: Lattice, words: list[tuple[str, float]]):
        self.size = lattice.size
        starts, *arcs = lattice.side_by_side([w for w, _ in words])
        self.before, self.node, self.piece = (a.astype(np.int32) for a in arcs)
        self.starts, self.ends, self.nodes = starts[:-1], starts[1:] - 1, int(starts[-1])
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
        self.word, self.weight = word[self.node], np.array([c for _, c in words])
        place = np.arange(self.nodes) - self.starts[word] if len(words) else np.empty(0, np.int64)
        self.forward = self._steps(self.node, place)
        self.backward = self._steps(self.before, place)[::-1]

    def _steps(self, at: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Arcs grouped by the place of ``at`` in their words: (arcs, where a new node begins, those nodes)."""
        order = np.lexsort((at, place[at])).astype(np.int32)
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(place[at][order])) + 1) if len(order) else []:
            here = at[part]
            first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            out.append((part, first, here[first]))
        return out

    def counts(self, probability: np.ndarray) -> np.ndarray:
        logs = np.log(np.append(probability, UNKNOWN))[self.piece]
        ahead, behind = np.full(self.nodes, -np.inf), np.full(self.nodes, -np.inf)
        ahead[self.starts], behind[self.ends] = 0.0, 0.0
        for arcs, first, nodes in self.forward:
            ahead[nodes] = np.logaddexp.reduceat(ahead[self.before[arcs]] + logs[arcs], first)
        for arcs, first, nodes in self.backward:
            behind[nodes] = np.logaddexp.reduceat(behind[self.node[arcs]] + logs[arcs], first)
        share = np.exp(ahead[self.before] + logs + behind[self.node] - ahead[self.ends][self.word]) * self.weight[self.word]
        return np.bincount(self.piece, share, self.size + 1)[: self.size]


def fit_pieces(lattice: Lattice, words: list[tuple[str, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language from (word, count) rows."""
    parts = [Expectation(lattice, words[k : k + FIT_AT_ONCE]) for k in range(0, len(words), FIT_AT_ONCE)]
    probability = np.full(lattice.size, 1e-3)
    for _ in range(rounds):
        counts = sum((p.counts(probability) for p in parts), np.zeros(lattice.size)) + SMOOTHING
        probability = counts / counts.sum()
    return probability


@dataclass
class Model:
    """languages: in code point order; probability: a row for each piece, a column for each language."""

    vocabulary: Vocabulary
    languages: tuple[str, ...]
    probability: np.ndarray


class Scorer:
    """Scores texts; likelihoods of words are worked out for many new words at once and remembered."""

    def __init__(self, model: Model):
        self.lattice = Lattice(model.vocabulary)
        self.languages = model.languages
        #: One more row, for a character that is no piece.
        self.probability = np.vstack([model.probability, np.full((1, len(model.languages)), UNKNOWN)])
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.languages)))

    def long_word(self, word: str) -> np.ndarray:
        """Log likelihoods of one word, in logarithms throughout."""
        logs = [np.zeros(len(self.languages))] + [np.full(len(self.languages), -np.inf) for _ in range(len(word) + 1)]
        for s, e, k in self.lattice.arcs(word):
            logs[e] = np.logaddexp(logs[e], logs[s] + np.log(self.probability[k]))
        return logs[-1]

    def words(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words (rows) under each language (columns), summed over all segmentations.

        The words' lattices lie side by side; the forward pass takes all arcs that end at
        the same place of their words in one step.
        """
        out = np.empty((len(words), len(self.languages)))
        short = [k for k, w in enumerate(words) if len(w) <= LONG_WORD]
        for k in set(range(len(words))) - set(short):
            out[k] = self.long_word(words[k])
        if not short:
            return out
        starts, before, node, piece = self.lattice.side_by_side([words[k] for k in short])
        word = np.repeat(np.arange(len(short)), np.diff(starts))
        end = node - starts[:-1][word[node]]
        order = np.lexsort((node, end))
        node, before, piece, end = node[order], before[order], piece[order], end[order]
        ahead = np.zeros((int(starts[-1]), len(self.languages)))
        ahead[starts[:-1]] = 1.0
        edges = np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if low < high:
                here = node[low:high]
                firsts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
                ahead[here[firsts]] = np.add.reduceat(ahead[before[low:high]] * self.probability[piece[low:high]], firsts, axis=0)
        out[short] = np.log(ahead[starts[1:] - 1])
        return out

    def remember(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.rows, new = {}, self.rows[:0], list(words)
        self.rows = np.concatenate([self.rows, self.words(new)]) if new else self.rows
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior with equal priors) of each text; ('und', 0) without letters."""
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        totals = np.zeros((len(texts), len(self.languages)))
        lettered = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        held: list[tuple[int, list[str]]] = []
        count = 0

        def settle() -> None:
            self.remember({w for _, words in held for w in words})
            for i, words in held:
                totals[i] += self.rows[[self.known[w] for w in words]].sum(axis=0)
            held.clear()

        for i in lettered:
            found = words_of(texts[i])
            for at in range(0, len(found), AT_ONCE):
                part = found[at : at + AT_ONCE]
                held.append((i, part))
                count += len(part)
                if count >= AT_ONCE:
                    settle()
                    count = 0
        settle()
        for i in lettered:
            top = int(totals[i].argmax())
            out[i] = self.languages[top], float(1.0 / np.exp(totals[i] - totals[i, top]).sum())
        return out


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                counts[language, word] += n
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(counts.values(), pa.int64())],
            names=["lang", "word", "n"],
        )


def fit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", id_column: str = "doc_id", model: str = DEFAULT_MODEL) -> Model:
    """Fit on rows of ``docs`` with a language and a text.

    The sample holds about ``FIT_DOCS`` documents of each language, by a hash of the id
    and text; all their words count, whatever their length. Repeated rows count each. With
    no labelled row (an empty table, null languages) nothing is learned.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    labelled = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    vocabulary = read_vocabulary(model)
    if not sizes:
        return Model(vocabulary, (), np.empty((len(vocabulary.pieces), 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, FIT_DOCS / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), F.lit(1_000_000)) / F.lit(1e6)
    sample = labelled.where(draw < share).select("lang", "text")
    counted = sample.mapInArrow(_word_batches, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words: dict[str, list[tuple[str, float]]] = {}
    # As columns, which take a tenth of the memory that rows do.
    for lang, word, n in zip(*(column.to_pylist() for column in counted.toArrow().select(["lang", "word", "n"]).columns), strict=True):
        words.setdefault(lang, []).append((word, float(n)))
    languages = tuple(sorted(words))
    lattice = Lattice(vocabulary)
    columns = [fit_pieces(lattice, sorted(words[lang])) for lang in languages]
    return Model(vocabulary, languages, np.stack(columns, axis=1) if columns else np.empty((lattice.size, 0)))


@lru_cache(maxsize=1)
def _scorer(shared) -> Scorer:
    return Scorer(shared.value)


def _predict_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shared)
        for batch in batches:
            found = scorer.texts(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score): one for each row of ``docs``, from its whole text alone.

    A null text, or one without a letter, is 'und' with score 0; so is every text if
    nothing was learned. Equal likelihoods go to the first language in code point order.
    Repeated rows come back as often; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return narrow.mapInArrow(_predict_batches(shared), f"`{id_column}` {kind}, lang_pred string, score double")


def identify_languages(docs: DataFrame, model: str = DEFAULT_MODEL, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """Learn from documents outside the held-out fold, predict all: doc_id, held_out, lang_pred, score.

    One row for each row of ``docs``; nulls, empty texts and empty tables as in
    :func:`predict` and :func:`fit`. A null id counts as the empty text in the fold's hash.
    """
    held = id_bucket("doc_id", folds) == held_fold
    fitted = fit(docs.where(~held), model=model)
    return predict(docs, fitted).select("doc_id", held.alias("held_out"), "lang_pred", "score")
