import pytest
from pyspark.sql import functions as F

from moraine.functions import tokens as K

T, B = (100, 101), (200, 201)


def mask(spark, ids, fields, **kw):
    return spark.createDataFrame([(ids,)], "ids array<int>").select(K.field_mask(F.col("ids"), fields, **kw)).first()[0]


CASES = [
    ([1, 3, 100, 10, 11, 101, 2], [T], {}, [3, 4]),
    ([1, 100, 10, 101, 200, 20, 201, 2], [T, B], {}, [2, 5]),
    ([1, 100, 10, 101, 200, 20, 201, 2], [B], {}, [5]),
    ([1, 101, 10, 100, 20, 101], [T], {}, [4]),
    ([1, 100, 10, 11], [T], {}, [2, 3]),
    ([1, 100, 10, 101, 2], [T], {"keep_markers": True}, [1, 2, 3]),
    ([1, 101, 100, 10, 101, 101], [T], {"keep_markers": True}, [2, 3, 4]),
    ([1, 100, 10, 101, 2], [T], {"keep_special": [1, 2]}, [0, 2, 4]),
    ([1, 100, 10, 100, 11, 101, 12, 101, 13], [T], {}, [2, 4, 6]),
    ([1, 10, 2], [T], {}, []),
    ([1, 10, 2], [], {}, [0, 1, 2]),
    ([], [T], {}, []),
]


@pytest.mark.parametrize("ids,fields,kw,want", CASES)
def test_field_mask(spark, ids, fields, kw, want):
    assert [i for i, x in enumerate(mask(spark, ids, fields, **kw)) if x] == want


def test_equal_markers_are_an_error():
    with pytest.raises(ValueError):
        K.field_mask(F.lit(None), [(1, 1)])


def test_query_and_doc_ids(spark):
    df = spark.createDataFrame([([10, 11],), ([],), (list(range(10, 60)),)], "t array<int>")
    q = [r[0] for r in df.select(K.query_ids(F.col("t"), 8)).collect()]
    assert q == [[1, 3, 10, 11, 2, 5, 5, 5], [1, 3, 2, 5, 5, 5, 5, 5], [1, 3, 10, 11, 12, 13, 14, 15]]
    d = [r[0] for r in df.select(K.doc_ids(F.col("t"), 8)).collect()]
    assert d == [[1, 4, 10, 11, 2], [1, 4, 2], [1, 4, 10, 11, 12, 13, 14, 2]]


def test_skip_mask_and_kept(spark):
    df = spark.createDataFrame([([1, 50, 0, 60, 2],)], "ids array<int>")
    m = K.skip_mask(F.col("ids"), [50])
    assert df.select(m).first()[0] == [True, False, False, True, True]
    assert df.select(K.kept(F.col("ids"), m, K.skip_mask(F.col("ids"), [2]))).first()[0] == [1, 60]


def test_special_ids():
    v = {"[PAD]": 0, "[unused0]": 1}
    got = K.special_ids(v, fields={"title": ("<t>", "</t>")})
    assert got == {"[unused0]": 1, "[unused1]": 2, "<t>": 3, "</t>": 4}
    with pytest.raises(ValueError):
        K.special_ids({}, fields={"title": ("<t>", "<t>")})
