"""The pipeline against its stages done one by one in plain Python."""

import random
import re

import corpus_pipeline
from spindrift.llm import toxicity
from tests.llm.conftest import sentence
from tests.llm.test_exact import groups, slow_print


def test_run(spark, tmp_path):
    rng = random.Random(17)
    item = sentence(rng, 25)
    rows = []
    for k in range(120):
        words = sentence(rng, 60)
        if k % 10 == 0:
            words += " you idiot, you stupid moron. worthless scum and trash."
        if k % 10 == 1:
            words += " token = abcdef123456"
        if k % 10 == 2:
            words = f"{words} {item} {words}"
        rows.append((k, words, "en", f"s{k % 4}", len(words)))
    rows += [(500 + k, rows[k][1], "en", "s1", 0) for k in range(3, 9)] + [(600, None, None, None, None), (601, "", "en", "s0", 0)]
    marks = [(k, 1, int(k % 10 == 0)) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [len(corpus_pipeline.STAGES), *out[0].asDict()] == [5, "doc_id", "text", "lang", "source", "n_chars", "copies"]
    model = toxicity.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [r for r in rows if model.score(r[1]) < toxicity.THRESHOLD]
    assert {r[0] for r in rows} - {r[0] for r in kept} == set(range(0, 120, 10))
    prints = [slow_print(r[1]) for r in kept]
    root = groups(len(kept), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    kept = [min((r for r, x in zip(kept, root, strict=True) if x == g), key=lambda r: r[0]) for g in set(root)]
    kept = [r for r in kept if not (r[1] and re.sub(r"\W+", " ", item) in re.sub(r"\W+", " ", r[1]))]
    expected = {r[0]: None if r[1] is None else re.sub(r"token = \w+", "[SECRET]", r[1]) for r in kept}
    got = {r.doc_id: r.text for r in out}
    assert set(got) <= set(expected) and all(expected[k] == t for k, t in got.items())
    sizes = {r[0]: len((expected[r[0]] or "").split()) for r in kept}
    check_mix({r[0]: (r[3], sizes[r[0]]) for r in kept}, {r.doc_id: r.copies for r in out})


def check_mix(docs, copies):
    """Each source's words are as near its target as any choice of documents can be."""
    names = sorted({s for s, _ in docs.values() if s is not None}) + [None] * any(s is None for s, _ in docs.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(n for t, n in docs.values() if t == s) for s in names}
    target, left, rest = {}, set(names), sum(size.values())
    while left:
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        full = {s for s in left if share[s] > 3 * size[s]}
        for s in full or left:
            target[s] = 3 * size[s] if full else share[s]
        rest -= sum(target[s] for s in full)
        left -= full or left
    for s in names:
        repeats = int(target[s] // size[s]) if size[s] else 0
        reached = 1
        for _, n in (d for d in docs.values() if d[0] == s):
            for _ in range(3 - repeats):
                reached |= reached << n
        goal = int(target[s]) - repeats * size[s]
        best = min(abs(k - goal) for k in range(reached.bit_length()) if reached >> k & 1)
        taken = sum(n * copies.get(k, 0) for k, (t, n) in docs.items() if t == s)
        assert abs(taken - int(target[s])) == best, s
        assert all(copies.get(k, 0) <= 3 for k in docs)


def test_run_on_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(1, "some words of a text", "en", "a", 20), (2, None, None, None, None)], schemas["documents"]).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, 1)]
