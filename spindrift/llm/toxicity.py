"""Toxicity by a weighted finite-state grammar over clauses.

The lexicon transducer reads a word's letters and writes a symbol: insult, threat,
target, negation, report or plain word, an insult with its lexical weight. Four more
read a clause's symbols one after the other, composed into one machine: the first marks
insults and threats in the scope of a negation, the second those in reported speech,
the third those with a target nearby (before, or a few words later, which it guesses and
must keep), and the last writes a weight for each marked match: its lexical weight and
the weights of its marks, or nothing, if that is more. An untargeted threat is none. A
clause weighs what its best path does. A text's score is a logistic function of its
clauses' weights.

Words of the small closed classes are fixed. Insults are patterns (a word, or a word
beginning) that labelled texts show: statistics over a bounded sample of labelled rows
choose and weigh them, beside a short fixed list that serves where labels lack. The
marks' weights are learned from the same rows, from given ones on; however the rows
speak, a mark keeps half of its given weight, so that a negated or reported insult never
counts in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import id_bucket, use_small_batches
from spindrift.llm.transducers import Transducer, best_path, build, compose

#: Labelled rows of either class that the classifier is fitted on, about.
FIT_TOXIC = 5_000
FIT_CLEAN = 10_000
#: A toxic text with so many chosen patterns needs no more.
ENOUGH = 4
#: A pattern's log odds ratio, the root of its likelihood ratio, and the toxic texts that have it must reach these.
LEAST_WEIGHT = 2.0
LEAST_Z = 4.5
LEAST_TEXTS = 4
#: Patterns that a task counts before it passes them on.
COUNTED_AT_ONCE = 100_000
#: Lengths of word beginnings that can be patterns.
BEGINNINGS = range(4, 9)
THRESHOLD = 0.3

# Words of the closed classes and a seed lexicon, by language.
INSULTS = """
idiot moron loser worthless trash scum pathetic clown stupid disgusting imbecile dumb fool vermin
dummkopf trottel abschaum versager arschloch widerlich
imbécile crétin connard salaud ordure minable
imbécil estúpido basura escoria patético cretino
""".split()
THREATS = """
kill murder hurt destroy strangle beat shoot stab burn
töten umbringen verletzen vernichten erschießen
tuer assassiner frapper détruire brûler
matar asesinar golpear destruir quemar
""".split()
TARGETS = """
you your yours he she him her they them their these those everyone people
du dich dir dein ihr euch sie ihn ihnen alle
tu te toi vous vos ton il elle ils elles eux
tú usted ustedes vosotros él ella ellos ellas todos
""".split()
NEGATIONS = """
not no never neither nor isn't aren't don't doesn't won't
nicht kein keine keinen nie niemals
pas jamais aucun aucune
nunca jamás ningún ninguna
""".split()
REPORTS = """
said says called calls claimed wrote quoted according alleged reportedly
sagte nannte schrieb behauptete laut
dit disait appelé écrit selon
dijo llamó escribió según
""".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD, END = "insult", "threat", "target", "negation", "report", "word", "end"
NEGATED, REPORTED, TARGETED, UNTARGETED = "negated", "reported", "targeted", "untargeted"
#: How far, in words, a negation and a target reach.
NEGATION_REACH = 3
TARGET_REACH = 4
#: Given weights of the marks and of a targeted threat; the variance of the learned ones around them.
GIVEN = {NEGATED: -2.5, REPORTED: -2.5, UNTARGETED: -0.75, THREAT: 3.0}
VARIANCE = 1.0
LEAST_THREAT = 0.5
SEED_WEIGHT = 3.0
HIGHEST_WEIGHT = 6.0
REMEMBERED = 300_000

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


@dataclass
class Lexicon:
    """The lexicon transducer: insults as whole words and as word beginnings with their weights, and the closed classes.

    Its states are the beginnings of what it knows, its arcs letters.
    """

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    beginnings: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.known: dict[str, tuple[str, float]] = {}
        self.arcs: dict[tuple[int, str], int] = {}
        #: What a word writes that ends in a state, and what any word writes that goes through it.
        self.ending: dict[int, tuple[str, float]] = {}
        self.passing: dict[int, float] = {}
        for kind, group in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (END, _ENDS)):
            self.ending |= {self._state(w): (kind, 0.0) for w in group}
        self.ending |= {self._state(w): (INSULT, weight) for w, weight in self.words.items()}
        self.passing = {self._state(w): weight for w, weight in self.beginnings.items()}

    def _state(self, letters: str) -> int:
        state = 0
        for letter in letters:
            state = self.arcs.setdefault((state, letter), len(self.arcs) + 1)
        return state

    def read(self, token: str) -> tuple[str, float]:
        """(symbol, weight) of a token: the heaviest insult it holds, or its class."""
        state, weight = 0, 0.0
        for letter in token:
            state = self.arcs.get((state, letter), -1)
            if state < 0:
                break
            weight = max(weight, self.passing.get(state, 0.0))
        kind, own = self.ending.get(state, (WORD, 0.0))
        return (INSULT, max(weight, own)) if weight > 0 or kind == INSULT else (kind, own)

    def symbols(self, tokens: list[str]) -> list[tuple[str, float]]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for token in tokens:
            if token not in known:
                known[token] = self.read(token)
        return [known[t] for t in tokens]


_KINDS = (INSULT, THREAT, TARGET, NEGATION, REPORT, WORD)
_MATCHES = (INSULT, THREAT)
_FREE = (0, 0.0)


def negation_scope(alphabet) -> Transducer:
    """Marks matches up to ``NEGATION_REACH`` words after a negation; a state is the words left of its scope."""

    def step(left, symbol):
        written = (*symbol, NEGATED) if left and symbol[0] in _MATCHES else symbol
        return [(NEGATION_REACH if symbol[0] == NEGATION else max(0, left - 1), written, _FREE)]

    return build(0, alphabet, step, lambda _: True)


def reported_speech(alphabet) -> Transducer:
    """Marks matches after a word of reporting, to the end of the clause."""

    def step(reported, symbol):
        return [(reported or symbol[0] == REPORT, (*symbol, REPORTED) if reported and symbol[0] in _MATCHES else symbol, _FREE)]

    return build(False, alphabet, step, lambda _: True)


def target_nearby(alphabet) -> Transducer:
    """Marks matches as targeted or not.

    A state holds how many words the last target still reaches, and within how many words
    a target must follow, as a match before was marked for it. A reading whose target
    doesn't come has no path; one that could have it may also do without.
    """

    def step(state, symbol):
        reach, due = state
        if symbol[0] == TARGET:
            return [((TARGET_REACH, 0), symbol, _FREE)]
        if due == 1:
            return []
        reach_after, due_after = max(0, reach - 1), max(0, due - 1)
        if symbol[0] not in _MATCHES:
            return [((reach_after, due_after), symbol, _FREE)]
        if reach:
            return [((reach_after, due_after), (*symbol, TARGETED), _FREE)]
        return [
            ((0, due_after), (*symbol, UNTARGETED), _FREE),
            ((0, min(due_after or TARGET_REACH, TARGET_REACH)), (*symbol, TARGETED), _FREE),
        ]

    return build((0, 0), alphabet, step, lambda s: s[1] == 0)


def match_weights(alphabet, weights: dict[str, float]) -> Transducer:
    """Writes of each match whether it counts; it does with its lexical weight and the weights of its marks, or not at all."""

    def step(state, symbol):
        kind, marks = symbol[0], symbol[1:]
        skip = (0, (*symbol, "skipped") if kind in _MATCHES else symbol, _FREE)
        added = sum(weights.get(m, 0.0) for m in marks)
        if kind == INSULT:
            return [skip, (0, (*symbol, "counted"), (1, added))]
        if kind == THREAT and UNTARGETED not in marks:
            return [skip, (0, (*symbol, "counted"), (0, weights[THREAT] + added))]
        return [skip]

    return build(0, alphabet, step, lambda _: True)


def _written(machine: Transducer) -> list:
    return list(dict.fromkeys(w for arcs in machine.arcs.values() for _, w, _ in arcs))


def clause_grammar(weights: dict[str, float]) -> Transducer:
    """The composition: what reads a clause's symbols and writes its marked matches and their weight."""
    machine = negation_scope([(k,) for k in _KINDS])
    for following in (reported_speech, target_nearby):
        machine = compose(machine, following(_written(machine)))
    return compose(machine, match_weights(_written(machine), weights))


def clauses(lexicon: Lexicon, text: str | None) -> tuple[list[list[tuple[str, float]]], int]:
    """(symbols of each clause that holds a match, tokens of the text)."""
    tokens = _TOKEN.findall((text or "").lower())
    out, start, hit = [], 0, False
    symbols = lexicon.symbols(tokens)
    for at, (kind, _) in enumerate(symbols):
        if kind == END:
            if hit:
                out.append(symbols[start:at])
            start, hit = at + 1, False
        elif kind in _MATCHES:
            hit = True
    if hit:
        out.append(symbols[start:])
    return out, len(tokens)


@dataclass
class Model:
    lexicon: Lexicon
    #: Intercept and the weights of the features.
    coefficients: tuple[float, float, float, float] = (-3.0, 1.0, 0.5, 0.5)
    #: Weights of the marks and of a targeted threat.
    weights: dict[str, float] = field(default_factory=lambda: dict(GIVEN))

    @cached_property
    def grammar(self) -> Transducer:
        return clause_grammar(self.weights)

    def read(self, clause: list[tuple[str, float]]) -> tuple[float, list]:
        """(weight, marked matches and other symbols) of a clause."""
        return best_path(self.grammar, [((kind,), weight) for kind, weight in clause])

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(weight of all clauses, weight of a hundred words, weight of the heaviest clause), damped."""
        matched, n = clauses(self.lexicon, text)
        found = [self.read(c)[0] for c in matched]
        total = sum(found)
        return (math.log1p(total), math.log1p(100 * total / n), math.log1p(max(found))) if total else (0.0, 0.0, 0.0)

    def score(self, text: str | None) -> float:
        z = self.coefficients[0] + sum(c * v for c, v in zip(self.coefficients[1:], self.features(text), strict=True))
        return 1.0 / (1.0 + math.exp(-min(max(z, -40.0), 40.0)))


def _pattern_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pattern, toxic texts, clean texts), counted over some texts at a time; a beginning ends in *."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def settle() -> pa.RecordBatch:
        clean, toxic = counts
        patterns = list(clean.keys() | toxic.keys())
        out = pa.RecordBatch.from_arrays(
            [pa.array(patterns, pa.string()), pa.array([toxic[p] for p in patterns], pa.int64()), pa.array([clean[p] for p in patterns], pa.int64())],
            names=["pattern", "toxic", "clean"],
        )
        clean.clear()
        toxic.clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {t for t in _TOKEN.findall(text.lower()) if t not in _ENDS}
            counts[label].update(words | {w[:k] + "*" for w in words for k in BEGINNINGS if k <= len(w)})
            if sum(map(len, counts)) > COUNTED_AT_ONCE:
                yield settle()
    if any(counts):
        yield settle()


def specific(rows: list[tuple[str, int]]) -> list[str]:
    """Patterns of (pattern, toxic texts) without beginnings whose texts a longer pattern has nearly all."""
    longer: dict[str, int] = {}
    for pattern, n in rows:
        stem = pattern.rstrip("*")
        for k in BEGINNINGS:
            if k < len(stem) or (k == len(stem) and not pattern.endswith("*")):
                longer[stem[:k]] = max(longer.get(stem[:k], 0), n)
    return [p for p, n in rows if not p.endswith("*") or longer.get(p[:-1], 0) < 0.97 * n]


def log_odds(toxic, clean, n_toxic: float, n_clean: float):
    """Of being in a toxic text: the log odds ratio, its lower bound (two standard errors), and the signed root of the likelihood ratio."""
    weight = np.log((toxic + 0.5) / (n_toxic - toxic + 0.5)) - np.log((clean + 0.5) / (n_clean - clean + 0.5))
    bound = weight - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    n = n_toxic + n_clean
    ratio = np.zeros_like(np.asarray(toxic, float))
    for seen, group in ((toxic, n_toxic), (clean, n_clean)):
        for part, whole in ((seen, toxic + clean), (group - seen, n - toxic - clean)):
            part = np.maximum(part, 0.0)
            ratio += part * np.log(np.where(part > 0, part, 1.0) / np.where(part > 0, group * np.maximum(whole, 1e-9) / n, 1.0))
    return weight, bound, np.sign(weight) * np.sqrt(np.maximum(2 * ratio, 0.0))


def choose_patterns(patterns: list[str], labels: np.ndarray, found: list[np.ndarray]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their weights, chosen one by one.

    found: of each text, the patterns it has. A toxic text that has ``ENOUGH`` chosen
    patterns is explained and speaks for no further one; so words that merely come along
    (a copied text's vocabulary) stay out.
    """
    sizes = np.array([len(f) for f in found], np.int64)
    text = np.repeat(np.arange(len(found)), sizes)
    pattern = np.concatenate(found) if len(found) and sizes.sum() else np.empty(0, np.int64)
    n_toxic, n_clean = float((labels == 1).sum()), float((labels == 0).sum())
    is_toxic = labels[text] == 1
    clean = np.bincount(pattern[~is_toxic], minlength=len(patterns)).astype(float)
    every = np.bincount(pattern[is_toxic], minlength=len(patterns)).astype(float)
    whole, _, _ = log_odds(every, clean, n_toxic, n_clean)
    text, pattern = text[is_toxic], pattern[is_toxic]
    explained = np.zeros(len(found), np.int64)
    chosen: list[int] = []
    open_to = np.ones(len(patterns), bool)
    while True:
        speaks = explained[text] < ENOUGH
        toxic = np.bincount(pattern[speaks], minlength=len(patterns)).astype(float)
        weight, bound, z = log_odds(toxic, clean, n_toxic, n_clean)
        bound[~open_to | (toxic < LEAST_TEXTS) | (weight < LEAST_WEIGHT) | (z < LEAST_Z)] = -np.inf
        best = int(bound.argmax()) if len(bound) else 0
        if not len(bound) or bound[best] == -np.inf:
            break
        chosen.append(best)
        open_to[best] = False
        explained[np.unique(text[pattern == best])] += 1
        if patterns[best].endswith("*"):  # what it covers is read by it
            stem = patterns[best][:-1]
            open_to &= np.array([not p.startswith(stem) for p in patterns])
    words = {patterns[k]: min(float(whole[k]), HIGHEST_WEIGHT) for k in chosen if not patterns[k].endswith("*")}
    return words, {patterns[k][:-1]: min(float(whole[k]), HIGHEST_WEIGHT) for k in chosen if patterns[k].endswith("*")}


def _found_batches(patterns: list[str]):
    number = {p: k for k, p in enumerate(patterns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = set(_TOKEN.findall(text.lower()))
                keys = tokens | {t[:k] + "*" for t in tokens for k in BEGINNINGS if k <= len(t)}
                rows.append(sorted(number[x] for x in keys if x in number))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["label", "found"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression with an intercept, by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        gradient = design.T @ (weight * (y - p)) - penalty @ beta
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty
        step = np.linalg.solve(curvature, gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _feature_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(3))], names=["label", "a", "b", "c"])

    return run


def _mark_batches(model: Model):
    """Rows (label, kind, mark, with, n): matches of a kind that have a mark, or don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[int, str, str, bool]] = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for clause in clauses(model.lexicon, text)[0]:
                    for kind, *marks in model.read(clause)[1]:
                        if kind in _MATCHES:
                            counts.update((label, kind, mark, mark in marks) for mark in (NEGATED, REPORTED, UNTARGETED))
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.bool_()))] + [pa.array([n for _, n in rows], pa.int64())],
            names=["label", "kind", "mark", "has", "n"],
        )

    return run


def learned_weights(counts: dict[tuple[int, str, str, bool], float], n_toxic: float, n_clean: float) -> dict[str, float]:
    """Weights of the marks from counts of (label, kind, mark, whether the match has it).

    A mark's weight is the log odds ratio of toxic to clean matches with it against those
    without, drawn to the given weight as its variance is large, and half of the given
    one at least. A targeted threat weighs the log ratio of how often it comes.
    """
    out = {}
    for mark in (NEGATED, REPORTED, UNTARGETED):
        cells = [counts.get((label, INSULT, mark, has), 0) + 0.5 for has in (True, False) for label in (1, 0)]
        ratio, variance = math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3]), sum(1 / c for c in cells)
        out[mark] = min((GIVEN[mark] / VARIANCE + ratio / variance) / (1 / VARIANCE + 1 / variance), GIVEN[mark] / 2)
    cells = [counts.get((label, THREAT, UNTARGETED, False), 0) + 0.5 for label in (1, 0)]
    ratio, variance = math.log(cells[0] / cells[1]) - math.log((n_toxic + 1) / (n_clean + 1)), sum(1 / c for c in cells)
    drawn = (GIVEN[THREAT] / VARIANCE + ratio / variance) / (1 / VARIANCE + 1 / variance)
    return out | {THREAT: min(max(drawn, LEAST_THREAT), HIGHEST_WEIGHT)}


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on documents with a label 0 or 1; with none of either class the fixed lexicon and weights serve.

    Null texts, null ids and other labels don't count; a document labelled twice, or
    repeated, counts as often. What is fitted on is bounded by ``FIT_TOXIC`` and
    ``FIT_CLEAN`` rows; of these, every pattern that speaks clearly enough is looked at.
    """
    use_small_batches(docs.sparkSession)
    usable = labels.select(F.col(f"`{id_column}`").alias("of_id"), F.col(f"`{label_column}`").cast("int").alias("label")).where("of_id is not null and label in (0, 1)").distinct()
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(Lexicon())
    share = {0: min(1.0, FIT_CLEAN / sizes[0]), 1: min(1.0, FIT_TOXIC / sizes[1])}
    draw = F.pmod(F.xxhash64("of_id"), F.lit(1_000_000)) / F.lit(1e6)
    # The sample's size is bounded by its two parameters, so it can go to every task; texts then need no shuffle.
    drawn = usable.where(draw < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    sample = narrow.join(F.broadcast(drawn), F.col("id") == F.col("of_id")).select("label", "text")
    n_toxic, n_clean = (max(1.0, share[k] * sizes[k]) for k in (1, 0))
    counted = sample.mapInArrow(_pattern_batches, "pattern string, toxic bigint, clean bigint").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") + 0.5) / n_toxic / ((F.col("clean") + 0.5) / n_clean)
    candidates = counted.where((F.col("toxic") >= LEAST_TEXTS) & (lift >= math.exp(LEAST_WEIGHT) / 2))
    rows = candidates.orderBy("pattern").collect()
    # Texts that are explained only lower a pattern's figures, so what falls short now never is chosen.
    weight, _, z = log_odds(np.array([r["toxic"] for r in rows], float), np.array([r["clean"] for r in rows], float), n_toxic, n_clean)
    patterns = specific([(r["pattern"], r["toxic"]) for r, enough in zip(rows, (weight >= LEAST_WEIGHT) & (z >= LEAST_Z), strict=True) if enough])
    seen = sample.mapInArrow(_found_batches(patterns), "label int, found array<int>").collect()
    words, beginnings = choose_patterns(patterns, np.array([r["label"] for r in seen], np.int64), [np.array(r["found"], np.int64) for r in seen])
    model = Model(Lexicon(dict.fromkeys(INSULTS, SEED_WEIGHT) | words, beginnings))
    marks = sample.mapInArrow(_mark_batches(model), "label int, kind string, mark string, has boolean, n bigint").groupBy("label", "kind", "mark", "has").agg(F.sum("n").alias("n")).collect()
    model = Model(model.lexicon, weights=learned_weights({(r["label"], r["kind"], r["mark"], r["has"]): r["n"] for r in marks}, n_toxic, n_clean))
    seen = sample.mapInArrow(_feature_batches(model), "label int, a double, b double, c double").toPandas()
    if seen["label"].nunique() < 2:
        return model
    y = seen["label"].to_numpy(float)
    beta = fit_logistic(seen[["a", "b", "c"]].to_numpy(), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return Model(model.lexicon, tuple(float(b) for b in beta), model.weights)


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, score): one for each row of ``docs``, from its whole text alone; null counts as empty."""
    spark = docs.sparkSession
    use_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return narrow.mapInArrow(_score_batches(shared), f"`{id_column}` {kind}, score double")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2) -> Model:
    """Fit on labels outside the held-out fold only."""
    return fit(docs, labels.where(id_bucket("doc_id", folds) != held_fold))


def classify_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) for each row of ``docs``.

    Null and empty texts score what a text without matches does; repeated rows come back
    as often; an empty table gives an empty one; without usable labels the fixed lexicon
    and weights serve. A null id counts as the empty text in the fold's hash. Extra
    columns of either table don't matter.
    """
    scored = score(docs, learn(docs, labels, folds, held_fold))
    return scored.select("doc_id", (id_bucket("doc_id", folds) == held_fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep_batches(shared, text_at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = pa.array([model.score(t) < threshold for t in batch.column(text_at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return run


def drop_toxic(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null and empty texts stay unless the model calls a text without matches toxic;
    repeated rows go or stay alike; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    use_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep_batches(shared, docs.columns.index(text_column), threshold), docs.schema)
