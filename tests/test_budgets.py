"""Interpreter queries run with the reference's step budgets."""

import __spark_entry__ as entry
from strataloom.operators import runtime
from tests.conftest import SMALL


def test_runs_have_the_references_budgets(spark, monkeypatch):
    asked, execute = [], runtime.execute

    def watched(cases, **kw):
        asked.append(kw.get("max_steps", 500))
        return execute(cases, **kw)

    monkeypatch.setattr(runtime, "execute", watched)
    rows = entry.queries()["x1_runs"](spark, SMALL).collect()
    assert asked == [500] and all(r.steps == 500 for r in rows if r.timed_out)
    for name, want in (("x4_mutations", [100, 100]), ("x5_equivalence", [500, 500])):
        asked.clear()
        entry.queries()[name](spark, SMALL)
        assert asked == want
    print("x1 timed out", sum(r.timed_out for r in rows), "of", len(rows), "longest", max(r.steps for r in rows))
