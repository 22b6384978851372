import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.functions.bitmap import Bitmap

ints = st.lists(st.integers(0, 1 << 18), max_size=300)


@given(ints, ints)
@settings(max_examples=60, deadline=None)
def test_andnot_is_set_difference(a, b):
    assert Bitmap.of(np.array(a)).andnot(Bitmap.of(np.array(b))).values().tolist() == sorted(set(a) - set(b))


def test_dense_chunks():
    a, b = np.arange(0, 70_000), np.arange(0, 70_000, 2)
    assert Bitmap.of(a).andnot(Bitmap.of(b)).values().tolist() == list(range(1, 70_000, 2))
    assert Bitmap.of(a).andnot(Bitmap.of(a[5:])).values().tolist() == [0, 1, 2, 3, 4]
    assert Bitmap.of(b[:10]).andnot(Bitmap.of(a)).values().tolist() == []
    assert len(Bitmap.of(a)) == 70_000
    assert Bitmap.of(a).nbytes < 70_000


def test_empty():
    assert len(Bitmap.of(np.zeros(0))) == 0 and len(Bitmap.of(np.zeros(0)).andnot(Bitmap.of(np.array([1])))) == 0
