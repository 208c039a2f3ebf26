"""Generation: every proposal is allowed, unseen and parses; caps and budgets hold."""

from collections import Counter

import pytest

from spindrift.operators.search import Generator, build_atoms, templates
from spindrift.plans.expr import fields, parse

FIELDS = ["open", "high", "low", "close", "volume", "amount", "ctx_sent_up", "evt_uplimit_active", "limit_up_streak"]


@pytest.fixture(scope="module")
def generator(spark):
    policy = spark.createDataFrame([("field", "close", 0.3), ("field", "amount", 0.1), ("operator", "Mul", 0.2), ("lane", "x", 0.0)], "kind string, key string, score double")
    return Generator(spark, FIELDS, policy, spark.createDataFrame([("none",)], "expression_hash string"))


def test_atoms_need_their_fields():
    atoms = build_atoms(FIELDS)
    assert len({a.expr for a in atoms}) == len(atoms)
    assert all(set(fields(parse(a.expr))) <= set(FIELDS) and set(a.needs) <= set(FIELDS) for a in atoms)
    assert {a.role for a in atoms} == {"formula_search", "event_state_search", "lagged_context_search"}
    assert not build_atoms(["code"])


@pytest.mark.parametrize("arm", ["rx_ucb", "event_state", "turnover_aware", "cem_elite", "hybrid"])
def test_arms(generator, arm):
    rows = generator.arm(arm, 24)
    assert 0 < len(rows) <= 24 and len({r["expression_hash"] for r in rows}) == len(rows)
    for r in rows:
        assert set(fields(parse(r["expression"]))) <= set(FIELDS)
    assert max(Counter(r["fields"] for r in rows).values()) <= 10
    again = generator.arm(arm, 24)
    assert [r["expression_hash"] for r in rows] == [r["expression_hash"] for r in again]


def test_memory_is_respected(spark, generator):
    seen = generator.broad(6)
    later = Generator(spark, FIELDS, generator.policy, spark.createDataFrame([(r["expression_hash"],) for r in seen], "expression_hash string")).broad(6)
    assert not {r["expression_hash"] for r in seen} & {r["expression_hash"] for r in later}


def test_templates(spark):
    rows = templates(spark, FIELDS).collect()
    assert rows and all(set(fields(parse(r.expression))) <= set(FIELDS) for r in rows)
