"""Visitors that are dealt to parts."""

import random
import types

import pandas as pd
import pytest

from millrace.streaming import processors

from .test_visitor_calls import Held


class HeldParts(Held):
    def getMapState(self, name, *_):
        marks = self.values.setdefault(name, {})
        return types.SimpleNamespace(getValue=lambda k: self._call(marks.get(k)), containsKey=lambda k: self._call(k in marks), updateValue=lambda k, v: self._call(marks.__setitem__(k, v)))


def batches_of(one, held, rows, watermark):
    """What leaves with a batch, and then with the timers up to the watermark."""
    out = [f for frames in (rows,) if len(frames) for f in one.handleInputRows(("x",), iter([frames]), None)]
    for at in sorted(t for t in held.timers if t <= watermark):
        out += one.handleExpiredTimer(("x",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark), None)
        held.timers.discard(at)
    return [tuple(r) for f in out for r in f[["ts", "body", "flag"]].itertuples(index=False)]


@pytest.mark.parametrize("kind", [processors.NewVisitorProcessor, processors.UniqueVisitorProcessor, processors.BounceProcessor, processors.LateBounceProcessor])
def test_a_part_of_many_visitors_decides_as_single_ones_do_with_calls_a_part(kind):
    rng, n = random.Random(7), 200
    part, whole = HeldParts(), processors.Dealt(kind())
    whole.init(part)
    single = {str(m): (Held(), kind()) for m in range(n)}
    for held, one in single.values():
        one.init(held)
    for k in range(4):
        rows = pd.DataFrame([{"mid": str(rng.randrange(n)), "ts": 100_000 * k + rng.randrange(1, 100_000), "arrival": None, "entry": rng.random() < 0.5, "body": f"{k} {j}"} for j in range(2000)])
        watermark = 100_000 * k + 90_000
        before = part.calls
        got = batches_of(whole, part, rows, watermark)
        marks = 0 if issubclass(kind, processors.BounceProcessor) else 2 * n  # a visitor's own
        assert part.calls - before < 24 + marks
        want = [r for mid, (held, one) in single.items() for r in batches_of(one, held, rows[rows["mid"] == mid], watermark)]
        assert sorted(got) == sorted(want) and (got or k)
