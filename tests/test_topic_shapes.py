"""Rows of a topic take their shape behind the exchange."""

from millrace.plans import streams
from millrace.plans.samples import Samples

SMALL = "/root/testdata/sf0.001"


def test_documents_of_pages_are_made_behind_the_exchange(spark, monkeypatch):
    plans, as_json = [], streams.as_json
    monkeypatch.setattr(streams, "as_json", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), as_json(df))[1])
    streams.Topics(Samples(spark, SMALL)).pages()
    before, _, behind = plans[0].partition("RepartitionByExpression")
    assert "AS common" in before and "AS common" not in behind and "during_time" in behind
