import numpy as np
import pytest

from millrace.llm.induced import SuffixSorter, repeated_places


def texts(seed):
    """Random and periodic texts over few symbols."""
    rng = np.random.default_rng(seed)
    for k in range(60):
        symbols = int(rng.integers(1, 5))
        text = rng.integers(1, symbols + 1, int(rng.integers(1, 120)))
        if k % 3 == 0:
            turn = rng.integers(1, symbols + 1, int(rng.integers(1, 9)))
            text = np.concatenate([np.tile(turn, 20)[:90], rng.integers(1, symbols + 1, 5), np.tile(turn, 10)])
        yield np.append(text, 0).astype(np.uint8), symbols + 1
    yield np.zeros(1, np.uint8), 1


#: In memory; all on disk with recursion to the last name; small pieces.
LIMITS = [{}, {"room": 64, "base": 1, "chunk": 7}, {"base": 3, "chunk": 2}]


@pytest.mark.parametrize("limits", LIMITS)
@pytest.mark.parametrize("cap", [3, 9, 200])
def test_order_and_prefixes(limits, cap):
    for text, symbols in texts(cap):
        s, places, prefixes = text.tolist(), [], []
        for p, common in SuffixSorter(cap, **limits).falling(text, symbols):
            places += p.tolist()
            prefixes += common.tolist()
        assert sorted(places) == list(range(len(s)))
        for a, b, common in zip(places, places[1:], prefixes[1:], strict=False):
            x, y = s[a : a + cap], s[b : b + cap]
            same = next((k for k, (i, j) in enumerate(zip(x, y, strict=False)) if i != j), min(len(x), len(y)))
            assert y <= x and common == same


@pytest.mark.parametrize("limits", LIMITS)
def test_repeated_places(limits):
    for text, symbols in texts(77):
        s = text.tolist()
        grams = [tuple(s[k : k + 4]) for k in range(len(s))]
        want = [len(g) == 4 and grams.count(g) > 1 for g in grams]
        assert repeated_places(text, symbols, 4, **limits).tolist() == want
