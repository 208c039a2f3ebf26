"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from spindrift.llm import contamination, html_text, language, mixing, quality, repeats, secrets, simhash, token_counts, toxicity


def benchmark(spark):
    return spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven twelve"), (1, None), (2, ""), (None, "short one")], "item_id long, text string")


PER_ROW = {
    "token_counts": lambda s, d, l: token_counts.token_counts(d),
    "toxicity": lambda s, d, l: toxicity.classify_toxicity(d, l),
    "simhash": lambda s, d, l: simhash.simhash_duplicates(d),
    "secrets": lambda s, d, l: secrets.find_secrets(d),
    "mixing": lambda s, d, l: mixing.mix_plan(d),
    "quality": lambda s, d, l: quality.quality_rules(d, l),
    "language": lambda s, d, l: language.identify_languages(d),
}
SOME_ROWS = {
    "repeats": lambda s, d, l: repeats.repeated_passages(d),
    "contamination": lambda s, d, l: contamination.find_contamination(d, benchmark(s)),
}
FILTERS = {
    "toxicity": lambda s, d, l: toxicity.drop_toxic(d, toxicity.learn(d, l)),
    "simhash": lambda s, d, l: simhash.drop_near_duplicates(d),
    "contamination": lambda s, d, l: contamination.drop_contaminated(d, benchmark(s)),
    "secrets": lambda s, d, l: secrets.redact_secrets(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_document(spark, docs, wide_docs, empty_docs, labels, name):
    run = PER_ROW[name]
    plain = sorted(map(repr, run(spark, docs, labels).collect()))
    assert len(plain) == docs.count()
    assert sorted(map(repr, run(spark, wide_docs, labels).collect())) == plain
    assert run(spark, empty_docs, labels).collect() == []
    assert run(spark, empty_docs, labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", SOME_ROWS)
def test_rows_of_found_documents(spark, docs, wide_docs, empty_docs, labels, name):
    run = SOME_ROWS[name]
    plain = sorted(map(repr, run(spark, docs, labels).collect()))
    assert sorted(map(repr, run(spark, wide_docs, labels).collect())) == plain
    assert run(spark, empty_docs, labels).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns(spark, docs, wide_docs, empty_docs, labels, name):
    run = FILTERS[name]
    assert run(spark, empty_docs, labels).collect() == []
    kept = run(spark, docs, labels)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    plain = sorted(map(repr, kept.collect()))
    wide = run(spark, wide_docs, labels)
    assert wide.columns == wide_docs.columns
    assert sorted(map(repr, wide.select(docs.columns).collect())) == plain


def test_awkward_benchmarks(spark, docs):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.find_contamination(docs, empty).collect() == []
    assert contamination.drop_contaminated(docs, empty).count() == docs.count()
    text = docs.where("doc_id = 1000").first().text
    plain = spark.createDataFrame([(1, text), (1, text), (2, None), (None, "")], "item_id long, text string")
    clashing = plain.selectExpr("item_id", "text", "text as doc_id", "1 as edit_distance", "2 as first_word", "map('a', 1) as id")
    found = sorted(map(repr, contamination.find_contamination(docs, plain).collect()))
    assert found and sorted(map(repr, contamination.find_contamination(docs, clashing).collect())) == found
    assert contamination.drop_contaminated(docs, clashing).count() == contamination.drop_contaminated(docs, plain).count() < docs.count()


def test_awkward_labels(spark, docs, labels):
    clashing = labels.selectExpr("doc_id", "quality", "toxic", "quality as label", "toxic as text", "doc_id as id", "1 as of_id", "'x' as stratum")
    for run in (lambda x: toxicity.classify_toxicity(docs, x), lambda x: quality.quality_rules(docs, x)):
        assert sorted(map(repr, run(clashing).collect())) == sorted(map(repr, run(labels).collect()))


def test_equal_rows_with_nested_columns(spark):
    """Rows that differ in a map or a nested null only are different rows; equal ones are not told apart."""
    rows = [(1, "a b c d", {"k": 1}, [1, None]), (1, "a b c d", {"k": 2}, [1, None]), (1, "a b c d", {"k": 1}, [None, 1])] * 3 + [(1, "a b c d", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, a array<int>").withColumn("source", F.lit("s"))
    assert simhash.drop_near_duplicates(docs).count() == 1
    taken = mixing.mix(docs).collect()
    assert sum(r.copies for r in taken) == 10 and len(taken) == 10
    assert sorted(repr((r.m, r.a)) for r in taken) == sorted(repr((m, a)) for _, _, m, a in rows)


@pytest.mark.parametrize("few", [1, 2, 1000])
def test_crowds_of_equal_rows(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "RANK_ROWS", few)
    monkeypatch.setattr(mixing, "WRITTEN_ROWS", few)
    rows = [(7, "x y z", "a")] * 25 + [(k, "p q r s", "b") for k in range(6)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, taken = mixing.mix_plan(docs).collect(), mixing.mix(docs).collect()
    assert sorted(r.taken for r in plan if r.taken) == sorted(r.copies * len(r.text.split()) for r in taken)
    # The equal rows' copies differ by one at most.
    copies = [r.copies for r in taken if r.doc_id == 7]
    assert copies and max(copies) - (min(copies) if len(copies) == 25 else 0) <= 1


def test_mix_keeps_columns(spark, docs, wide_docs, empty_docs):
    assert mixing.mix(empty_docs).collect() == []
    plain = mixing.mix(docs)
    assert plain.columns == [*docs.columns, "copies"]
    wide = mixing.mix(wide_docs)
    assert wide.columns == [*wide_docs.columns, "_copies"]
    assert wide.count() == plain.count()


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, lines string"
    rows = [(1, None, None, "x", "y"), (1, None, None, "x", "y"), (None, "http://h/a", "", None, None), (2, "nonsense", "<p" + "x" * 100_000, None, None), (3, "http://h/b", "<p>text " * 20_000, None, None)]
    out = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 4 * 20_000 + 19_999)]
    assert html_text.extract_text(spark.createDataFrame([], schema)).collect() == []


def test_self_closed_foreign_elements():
    from spindrift.llm import html_text

    for tag in ('<svg class="i"/>', "<math/>", "<svg width=5 />", '<SVG a="x>y" b=\'/\' />'):
        assert html_text.read_lines(f"<body><p>before{tag} after</p><p>more</p></body>") == [("before after", False), ("more", False)], tag
    for tag in ('<svg class="i">', "<svg width=5/>", '<svg a="x/">'):
        assert html_text.read_lines(f"<body><p>before{tag}drawn</svg> after</p></body>") == [("before after", False)], tag
