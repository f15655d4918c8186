from hypothesis import given, settings
from hypothesis import strategies as st

from trellium.operators.bitmaps import Bitmap

VALUES = st.one_of(st.lists(st.integers(0, 300_000), max_size=200), st.builds(lambda a, n, s: list(range(a, a + n * s, s)), st.integers(0, 70_000), st.integers(0, 9_000), st.integers(1, 5)))


@settings(max_examples=60, deadline=None)
@given(VALUES, VALUES)
def test_bitmaps_are_sets(a, b):
    x, y, p, q = Bitmap.of(a), Bitmap.of(b), set(a), set(b)
    assert x.values().tolist() == sorted(p)
    assert (x & y).values().tolist() == sorted(p & q)
    assert (x | y).values().tolist() == sorted(p | q)
    assert x.and_not(y).values().tolist() == sorted(p - q)
    assert len(x) == len(p)
