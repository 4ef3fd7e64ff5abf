"""Native operators stay in the JVM, and no operator pairs all rows."""

from __future__ import annotations

import re

import pytest

from fernweft.llm import queries
from tests.test_plans import plan

ALL = queries.queries()


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_hash_tree", "op9_fair_mix"])
def test_native_operators_run_no_python(spark, sf_dir, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(ALL[name](spark, sf_dir)))


@pytest.mark.parametrize("name", list(ALL))
def test_no_cross_join(spark, sf_dir, name):
    assert not re.search(r"Cartesian|NestedLoop", plan(ALL[name](spark, sf_dir)))
