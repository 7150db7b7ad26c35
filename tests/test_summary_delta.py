"""Both runs of the delta cover all documents."""

from larkspan.plans import measurement


def test_both_runs_cover_all_documents(spark, sf):
    delta = {r.category: r for r in measurement.summary_delta(spark, sf).collect()}
    whole = {r.category: r.fp for r in measurement.finance_categories(spark, sf).collect()}
    assert delta and all((r.fp_before, r.fp_after) == (whole[c], whole[c]) for c, r in delta.items())
    assert any(r.recall_delta > 0 for r in delta.values())
