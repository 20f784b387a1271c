"""No cartesian or nested-loop join in any table that the operators save, nor in their results."""

import sys

import pytest

from keelson.llm import common
from keelson.llm import queries as llm_queries
from tests.llm.conftest import SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _jobs():
    import corpus_pipeline
    return llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}


@pytest.mark.parametrize("name", sorted(_jobs()))
def test_no_cartesian_or_nested_loop_join(spark, monkeypatch, name):
    plans, save = [], common.save

    def noted(df, *args):
        plans.append(plan(df))
        return save(df, *args)
    for module in [m for n, m in sys.modules.items() if n.startswith("keelson.llm.") and hasattr(m, "save")]:
        monkeypatch.setattr(module, "save", noted)
    plans.append(plan(_jobs()[name](spark, SMALL)))
    assert not any(join in p for p in plans for join in ("CartesianProduct", "BroadcastNestedLoopJoin"))
