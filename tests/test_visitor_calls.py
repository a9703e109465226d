"""What a visitor costs a batch."""

import types

import pandas as pd
import pytest

from millrace.streaming import processors


class Held:
    """A processor's handle that counts its calls."""

    def __init__(self):
        self.timers, self.calls, self.values = set(), 0, {}

    def _call(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, _):
        return types.SimpleNamespace(get=lambda: self._call(self.values.get(name)), exists=lambda: self._call(name in self.values), update=lambda v: self._call(self.values.__setitem__(name, v)))

    def getListState(self, name, _):
        rows = self.values.setdefault(name, [])
        return types.SimpleNamespace(get=lambda: self._call(iter(list(rows))), exists=lambda: self._call(bool(rows)), appendValue=lambda v: self._call(rows.append(v)), clear=lambda: self._call(rows.clear()))

    def registerTimer(self, at):
        self._call(self.timers.add(at))

    def deleteTimer(self, at):
        self._call(self.timers.remove(at))


@pytest.mark.parametrize("kind", [processors.NewVisitorProcessor, processors.UniqueVisitorProcessor, processors.BounceProcessor, processors.LateBounceProcessor])
def test_a_visitor_costs_a_few_calls_a_batch_however_many_rows_it_has(kind):
    held, one = Held(), kind()
    one.init(held)
    n = 1000
    put = lambda ts: list(one.handleInputRows(("a",), iter([pd.DataFrame({"ts": ts, "arrival": None, "entry": True, "body": [str(t) for t in ts]})]), None))
    put([1000 * n + 30_000 * k for k in range(n)])
    put([500_000])  # before all that wait: the timer moves
    assert held.timers == {one.due(500_000) - one.slack_ms} and held.calls < 12
    mark = 1000 * n + 30_000 * (n // 2)
    out = list(one.handleExpiredTimer(("a",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))
    assert held.calls < 24 and sum(map(len, out)) > 0
    left = [ts for rows in held.values["rows"] for ts in rows[0]]
    assert all(one.due(ts) > mark + one.slack_ms for ts in left) and max(held.timers) == (one.due(min(left)) - one.slack_ms if left else one.due(500_000) - one.slack_ms)
