"""Secret scans: Boolean trigram queries choose the texts that a rule's regex then verifies.

Each rule's regex is parsed and turned into a query over trigrams that any match must
contain. Texts are indexed block by block (an Arrow batch): a trigram's posting list
holds the block's texts that contain it, lists are intersected and united as the query
says, and the regex runs over what is left. A rule without mandatory trigrams (a bare
run of hex digits) scans every text. One pass over a block's trigrams makes the lists of
those that some query asks for, so the index of a block is a few dozen lists and never
leaves its task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import use_small_batches

#: More alternatives than this in one literal set are treated as unknown text.
SET_LIMIT = 64
#: A character class of more members than this is treated as unknown text.
CLASS_LIMIT = 8
#: Characters whose trigrams are looked at in one go.
PASS_CHARS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` is ``least`` characters or longer."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


#: Fixed by the contract of the digest: kinds in the order they are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Published formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("bearer", r"bearer\x20+([A-Za-z0-9._~+/=-]+)", group=1, least=20, any_case=True),
    Rule("url_login", r"://[^\s/:@]{1,64}:([^\s/:@]{1,128})@", group=1, least=3),
)
RULES = BASE_RULES + MORE_RULES

#: A query in disjunctive form: any of these sets of trigrams, all of a set; None: no restriction.
Query = frozenset[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    joint = frozenset(x | y for x in a for y in b)
    return _absorb(joint) if len(joint) <= SET_LIMIT else a


def _absorb(query: frozenset[frozenset[str]]) -> Query:
    """Drop a set that contains another: the smaller one already lets its texts through."""
    return frozenset(x for x in query if not any(y < x for y in query))


def _of_strings(strings: frozenset[str]) -> Query:
    folded = {s.lower() for s in strings}
    if not folded or any(len(s) < 3 for s in folded):
        return None
    return _absorb(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in folded))


def _literals(op, arg) -> frozenset[str] | None:
    """The few strings that a parsed item can match, or None."""
    if op is C.LITERAL:
        return frozenset([chr(arg)])
    if op is C.IN:
        out = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < CLASS_LIMIT:
                out |= {chr(k) for k in range(x[0], x[1] + 1)}
            else:
                return None
        return frozenset(out) if len(out) <= CLASS_LIMIT else None
    if op is C.SUBPATTERN:
        return _sequence_literals(arg[-1])
    if op is C.BRANCH:
        branches = [_sequence_literals(x) for x in arg[1]]
        return frozenset().union(*branches) if all(x is not None for x in branches) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 2:
        inner = _sequence_literals(arg[2])
        if inner is not None:
            return _bounded(frozenset("".join(x) for k in range(arg[0], arg[1] + 1) for x in _products(inner, k)))
    if op is C.AT:
        return frozenset([""])
    return None


def _products(strings: frozenset[str], times: int) -> list[tuple[str, ...]]:
    out: list[tuple[str, ...]] = [()]
    for _ in range(times):
        out = [(*x, s) for x in out for s in strings]
    return out


def _bounded(strings: frozenset[str]) -> frozenset[str] | None:
    return strings if len(strings) <= SET_LIMIT else None


def _sequence_literals(items) -> frozenset[str] | None:
    whole = frozenset([""])
    for op, arg in items:
        one = _literals(op, arg)
        if one is None or _bounded(frozenset(a + b for a in whole for b in one)) is None:
            return None
        whole = frozenset(a + b for a in whole for b in one)
    return whole


def _sequence_query(items) -> Query:
    query: Query = None
    run = frozenset([""])
    for op, arg in items:
        one = _literals(op, arg)
        longer = _bounded(frozenset(a + b for a in run for b in one)) if one is not None else None
        if longer is not None:
            run = longer
            continue
        query = _both(query, _of_strings(run))
        run = one if one is not None else frozenset([""])
        if one is None:
            query = _both(query, _item_query(op, arg))
    return _both(query, _of_strings(run))


def _item_query(op, arg) -> Query:
    if op is C.SUBPATTERN:
        return _sequence_query(arg[-1])
    if op is C.BRANCH:
        queries = [_sequence_query(x) for x in arg[1]]
        return _absorb(frozenset().union(*queries)) if all(q is not None for q in queries) else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
        return _sequence_query(arg[2])
    return None


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, of which every match has all of one; None if there are none."""
    return _sequence_query(_parser.parse(pattern, re.ASCII))


class BlockIndex:
    """Posting lists of one block of texts for given trigrams, made in one pass over the block's trigrams."""

    def __init__(self, texts: list[str], trigrams: list[str]):
        self.size = len(texts)
        wanted = np.sort(np.array([_code(*map(ord, t)) for t in trigrams], np.uint64))
        quick = np.zeros(1 << 16, bool)
        quick[_slot(wanted)] = True
        found: list[np.ndarray] = []
        for numbers, letters in _letters(texts):
            codes = _code(letters[:-2], letters[1:-1], letters[2:])
            at = np.flatnonzero(quick[_slot(codes)])
            which = np.minimum(np.searchsorted(wanted, codes[at]), max(0, len(wanted) - 1))
            hit = wanted[which] == codes[at] if len(wanted) else np.zeros(len(at), bool)
            found.append(np.unique(which[hit] * self.size + numbers[at[hit]]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        edges = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.size)
        lists = [frozenset((pairs[low:high] - k * self.size).tolist()) for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        self.postings = dict(zip(wanted.tolist(), lists, strict=True))

    def posting(self, trigram: str) -> frozenset[int]:
        return self.postings[int(_code(*map(ord, trigram)))]

    def candidates(self, query: Query) -> list[int]:
        if query is None:
            return list(range(self.size))
        found: set[int] = set()
        for trigrams in query:
            lists = sorted(map(self.posting, trigrams), key=len)
            found |= frozenset.intersection(*lists)
        return sorted(found)


def _code(a, b, c):
    """A trigram of code points (below 2 ** 21) as one number."""
    if isinstance(a, np.ndarray):
        return (a << np.uint64(42)) | (b << np.uint64(21)) | c
    return a << 42 | b << 21 | c


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


def _letters(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, lower-case code point) of each letter, some ``PASS_CHARS`` at a time; a 0 parts texts, and parts of a long text share two letters."""
    numbers, parts, held = [], [], 0

    def settle() -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(parts) + "\0\0"
        lengths = np.array([len(p) + 1 for p in parts])
        lengths[-1] += 1
        return np.repeat(np.array(numbers), lengths), np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    for number, text in enumerate(texts):
        folded = text.lower()
        for low in range(0, max(1, len(folded) - 2), PASS_CHARS):
            parts.append(folded[low : low + PASS_CHARS + 2])
            numbers.append(number)
            held += len(parts[-1])
            if held >= PASS_CHARS:
                yield settle()
                numbers, parts, held = [], [], 0
    if parts:
        yield settle()


class Scanner:
    """Spans of all rules over blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted({t for _, _, query in self.rules for trigrams in query or () for t in trigrams})

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text: (start, rule number, end), sorted."""
        index = BlockIndex(texts, self.trigrams)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, regex, query) in enumerate(self.rules):
            # A run that is too short can't pass the length test; where the whole match is one run, ask for it at once.
            quick = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", regex.flags) if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and rule.least else regex
            for i in index.candidates(query):
                for m in quick.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


_COLUMNS = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def _scan_batches(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        base = [r.kind for r in BASE_RULES]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = {kind: [] for kind in base}
            hashes, spans = [], []
            for found in scanner.scan(texts):
                own = [(rules[k].kind, s, e) for s, k, e in found]
                for kind in base:
                    counts[kind].append(sum(x[0] == kind for x in own))
                hashes.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own if k in base).encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in base), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                names=[batch.schema.names[0], "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs``: id, counts of the base kinds, their digest, and all spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then in the
    rules' order. A null text counts as empty: no spans, the digest of the empty text.
    Repeated rows come back as often; an empty table gives an empty one.
    """
    use_small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    return narrow.mapInArrow(_scan_batches(rules), f"`{id_column}` {kind}, {_COLUMNS}")


def _redact_batches(rules: tuple[Rule, ...], text_at: int, chars_at: int | None, mask: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            columns = batch.columns
            clean, changed = list(texts), False
            for i, found in enumerate(scanner.scan([t or "" for t in texts])):
                if found:
                    changed = True
                    parts, at, until = [], 0, 0
                    for start, _, end in found:
                        if start >= until:
                            parts += [texts[i][at:start], mask]
                        at = until = max(until, end)
                    clean[i] = "".join(parts) + texts[i][at:]
            if changed:
                columns[text_at] = pa.array(clean, batch.schema.field(text_at).type)
                if chars_at is not None:
                    lengths = [old if new == was or new is None else len(new) for new, was, old in zip(clean, texts, columns[chars_at].to_pylist(), strict=True)]
                    columns[chars_at] = pa.array(lengths, batch.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def redact_secrets(docs: DataFrame, text_column: str = "text", chars_column: str = "n_chars", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mask`` (overlapping spans by one) and the count of changed texts' characters renewed.

    No row goes, repeated ones neither; a null text stays null; an empty table gives an
    empty one.
    """
    use_small_batches(docs.sparkSession)
    names = docs.columns
    chars = names.index(chars_column) if chars_column in names and docs.schema[chars_column].dataType.simpleString() in ("int", "bigint") else None
    return docs.mapInArrow(_redact_batches(rules, names.index(text_column), chars, mask), docs.schema)
