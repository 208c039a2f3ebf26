"""Documents with every awkward case, as one table."""

import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of an input that operators use as names of their own.
CLASHING = "id long, fp long, mark long, hash long, size long, score double, held_out boolean, copies long, component_id long, host string, nth int, label int, spot string, comp string, n_words string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("bcdfglmnprst", k=1)[0] + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs():
    def make(seed=0, n=60):
        rng = random.Random(seed)
        rows = [(k, sentence(rng, rng.randint(5, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), 0) for k in range(n)]
        text = sentence(rng, 90)
        rows += [(1000 + k, text, "en", "a", 1) for k in range(5)]  # copies
        words = text.split()
        words[3] = "changed"
        rows += [(2000, " ".join(words), "en", "b", 1)]
        rows += [(3000, None, None, None, None), (None, text, "en", "a", None), (None, None, None, None, None), (3001, "", "en", "b", 0), (3002, " \t\n", "de", "", 3)]
        rows += [(3003, " ".join([sentence(rng, 400)] * 60), "en", "c", 2), (3004, "a " * 3000, "en", "c", 2)]
        rows += [rows[0], rows[0]]  # repeated rows
        return rows

    return make


@pytest.fixture(scope="session")
def docs(spark, make_docs):
    return spark.createDataFrame(make_docs(), DOC_SCHEMA)


@pytest.fixture(scope="session")
def wide_docs(spark, docs):
    from pyspark.sql import functions as F

    extra = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHING.split(", ")]
    return docs.select("*", *extra, F.create_map(F.lit("k"), F.lit(1)).alias("a_map"))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(60)] + [(None, 1, 1), (7, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
