"""Quality rules whose cutoffs come with a guarantee (DataFrame functions only).

Every rule rejects documents whose value is above a cutoff. Which cutoff a rule may use
in a stratum (a language) is decided on labelled documents: for each candidate, the
exact binomial tail says how likely so few false rejections would be if the true rate
were above the limit. Candidates are tested from the most lenient on, each only if all
before it passed, at a level divided by the number of rules and strata; the limit is
divided by the number of rules, as a document may fall to any of them. So, with
probability ``1 - DELTA`` over the labelled documents, no stratum loses more than
``ALPHA`` of its good documents to the rules. Of the certified cutoffs a rule uses the
one that parts good from bad labels best, the most lenient of equals. A stratum with
too few labels to certify anything keeps every document that passes the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import materialize

#: Highest share of a stratum's good documents that the rules may reject, and the chance of missing that.
ALPHA = 0.04
DELTA = 0.05
#: What one falsely rejected good document costs, in rejected bad ones, as shares of either.
COST = 4.0
#: Candidate cutoffs of every rule; all values are shares of a text.
CUTOFFS = (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)
RULES = ("symbols", "capitals", "dup_lines", "repeats")

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _repeated_words(words: Column) -> Column:
    """Words that lie in some 5-word window which the text has twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    )

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def of_sorted(pairs: Column) -> Column:
        twice = F.filter(
            pairs,
            lambda p, k: F.coalesce(F.get(pairs, k - 1)["hash"] == p["hash"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["hash"] == p["hash"], F.lit(False)),
        )
        return _let(F.sort_array(F.transform(twice, lambda p: p["at"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, of_sorted))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(windows, of_hashes))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", stratum_column: str = "lang") -> DataFrame:
    """The counts of every whole text, its stratum and the rules' values. A null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    stratum = F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum_column}`").cast("string")), F.lit("null"))
    counted = docs.select(F.col(f"`{id_column}`").alias("id"), stratum.alias("stratum"), text.alias("text")).select(
        "id",
        "stratum",
        F.xxhash64("text").alias("print"),
        _let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        (F.length("text") - F.regexp_count("text", F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        _let(
            F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
            lambda lines: F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")),
        ).alias("l"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")), F.lit(0.0))

    return counted.select("id", "stratum", "print", "w.*", "word_chars", "n_symbols", "n_capitals", "l.*").select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"),
        share("n_capitals", "word_chars").alias("capitals"),
        share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"),
    )


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight steps up, and back down."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = F.log(x)
    for k in range(1, 8):
        back = back + F.log(x + float(k))
    return series - back


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X of n draws at ``rate``, where k is below n * rate; 1 where it isn't.

    Summed from the term of k down. Terms fall by a growing factor; those beyond a dozen
    deviations are below 1e-30 of the first and left out, so the work follows sqrt(n).
    """
    n, k = n.cast("double"), k.cast("double")
    first = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * rate)) + 50).cast("int")
    odds = (1 - rate) / rate
    summed = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1.0) * odds).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: s["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.least(F.exp(first) * summed, F.lit(1.0)))


def certified_cutoffs(
    scored: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA, cost: float = COST
) -> DataFrame:
    """Rows (stratum, <rule>_cutoff ...) from :func:`features` and labels (1: good, 0: bad).

    Only documents that pass the base rules count, as only those can fall to a rule. The
    bound needs independent documents, so each text counts once for a label and stratum,
    however often it is copied or labelled. A cutoff is null where none is certified;
    strata without labels have no row. That the same labels choose among the certified
    cutoffs does no harm: candidates are tested in a fixed order that no label has a say
    in, each at the full level, so with the stated probability all certified ones hold
    at once, whichever is then chosen.
    """
    n_strata = max(1, scored.select("stratum").distinct().count())
    marked = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label")).where("label in (0, 1)")
    trials = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (F.col(r) > c).alias("over")) for r in RULES for c in CUTOFFS])
    counted = (
        scored.where("not base_failed")
        .join(marked, "id")
        .dropDuplicates(["stratum", "label", "print"])
        .select("stratum", "label", F.explode(trials).alias("t"))
        .groupBy("stratum", "t.rule", "t.cutoff")
        .agg(
            F.count_if(F.expr("label = 1")).alias("n_good"),
            F.count_if(F.expr("label = 1 and t.over")).alias("k_good"),
            F.count_if(F.expr("label = 0")).alias("n_bad"),
            F.count_if(F.expr("label = 0 and t.over")).alias("k_bad"),
        )
    )
    tested = counted.select(
        "*",
        binomial_tail(F.col("n_good"), F.col("k_good"), alpha / len(RULES)).alias("p"),
        (F.coalesce(F.try_divide("k_bad", "n_bad"), F.lit(0.0)) - cost * F.coalesce(F.try_divide("k_good", "n_good"), F.lit(0.0))).alias("gain"),
    )
    so_far = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    passed = tested.withColumn("worst", F.max("p").over(so_far)).where(F.col("worst") <= delta / (len(RULES) * n_strata))
    best = passed.groupBy("stratum", "rule").agg(F.max(F.struct("gain", "cutoff")).alias("best"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.cutoff"))).alias(f"{r}_cutoff") for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, counts, base_failed, kept.

    ``kept`` is false for a document that fails the base rules or is above a certified
    cutoff of its stratum. Null and empty texts have no words and fail the base rules;
    a null language is a stratum of its own; labels of unknown documents, other than 0
    and 1, or null don't count. Without labels, the base rules alone decide.
    """
    scored = materialize(features(docs, id_column), "quality-features")
    cutoffs = materialize(certified_cutoffs(scored, labels, id_column=id_column), "quality-cutoffs")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"{rule}_cutoff"), F.lit(False))
    return scored.join(cutoffs, "stratum", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
    )


_WORD_SQL = r"[^\x20\x09-\x0D]"
_TAIL_SQL = """
  case when k_good >= n_good * {rate} then 1.0 else least(1.0, list_sum(list_transform(range(0, least(k_good, cast(ceil(12 * sqrt(n_good * {rate})) as bigint) + 50) + 1),
    lambda i: exp(lgamma(n_good + 1) - lgamma(k_good - i + 1) - lgamma(n_good - k_good + i + 1) + (k_good - i) * ln({rate}) + (n_good - k_good + i) * ln(1 - {rate}))))) end
"""

ORACLE_SQL = f"""
with d as (
  select doc_id, coalesce('=' || lang, 'null') as stratum, coalesce(text, '') as text, row_number() over () as rid from documents
), tok as (
  select rid, regexp_extract_all(text, '{_WORD_SQL}+') as ws from d
), flat as (
  select rid, unnest(ws) as w, generate_subscripts(ws, 1) as pos from tok
), win as (
  select rid, pos, w || chr(1) || lead(w, 1) over s || chr(1) || lead(w, 2) over s || chr(1) || lead(w, 3) over s || chr(1) || lead(w, 4) over s as g
  from flat window s as (partition by rid order by pos)
), twice as (
  select rid, pos from (select rid, pos, count(*) over (partition by rid, g) as c from win where g is not null) where c >= 2
), rep as (
  select rid, sum(least(5, coalesce(nxt - pos, 5))) as n_repeat_words
  from (select rid, pos, lead(pos) over (partition by rid order by pos) as nxt from twice) group by rid
), lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD_SQL}') group by rid
), f as (
  select d.doc_id, d.stratum, d.text, len(tok.ws) as n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) as n_capitals,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from d join tok using (rid) left join rep using (rid) left join lines using (rid)
), s as (
  select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
    coalesce(n_symbols / nullif(cast(word_chars as double), 0), 0) as symbols, coalesce(n_capitals / nullif(cast(word_chars as double), 0), 0) as capitals,
    coalesce(n_dup_lines / nullif(cast(n_lines as double), 0), 0) as dup_lines, coalesce(n_repeat_words / nullif(cast(n_words as double), 0), 0) as repeats
  from f
), trial as (
  select stratum, rule, cutoff, count(*) filter (quality = 1) as n_good, count(*) filter (quality = 1 and v > cutoff) as k_good,
    count(*) filter (quality = 0) as n_bad, count(*) filter (quality = 0 and v > cutoff) as k_bad
  from (select stratum, quality, unnest([{', '.join(f"{{'rule': '{r}', 'v': {r}}}" for r in RULES)}], recursive := true) 
    from (select distinct on (stratum, quality, text) * from s join labels using (doc_id) where not base_failed and quality in (0, 1))) x,
       (select unnest([{', '.join(f'{c}::double' for c in CUTOFFS)}]) as cutoff) y
  group by all
), tested as (
  select *, {_TAIL_SQL.format(rate=f"{ALPHA / len(RULES)!r}::double")} as p,
    coalesce(k_bad / nullif(cast(n_bad as double), 0), 0) - {COST} * coalesce(k_good / nullif(cast(n_good as double), 0), 0) as gain
  from trial
), passed as (
  select *, max(p) over (partition by stratum, rule order by cutoff desc rows unbounded preceding) as worst from tested
), best as (
  select stratum, rule, arg_max(cutoff, (gain, cutoff)) as cutoff from passed
  where worst <= {DELTA} / ({len(RULES)} * (select count(distinct stratum) from s)) group by all
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from best b where b.stratum = s.stratum and
    case b.rule when 'symbols' then s.symbols when 'capitals' then s.capitals when 'dup_lines' then s.dup_lines else s.repeats end > b.cutoff) as kept
from s
"""
