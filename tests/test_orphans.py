from datetime import datetime as dt

from conftest import rows

from moraine.operators import orphans

REFS = "tbl string, qid string, ref_key string, at timestamp, via boolean"
LINKS, DOCS, GONE = "pid string, docid string", "docid string, ingested_at timestamp", "docid string, removed_at timestamp, reason string"


def found(spark, refs, links, docs, gone, **kw):
    return rows(orphans.orphan_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(links, LINKS), spark.createDataFrame(docs, DOCS), spark.createDataFrame(gone, GONE), **kw))


def test_kinds_and_ties(spark):
    docs = [("A", dt(2023, 1, 5)), ("A", dt(2023, 3, 5)), ("B", dt(2023, 2, 10, 12)), ("C", dt(2022, 1, 1)), (None, dt(2022, 1, 1))]
    gone = [("C", dt(2023, 2, 1), None), ("C", dt(2023, 2, 1), "spam"), ("D", dt(2023, 2, 1), None), ("B", None, None)]
    links = [("A_p0", "A"), ("A_p0", "A"), ("D_p0", "D"), (None, "A")]
    refs = [
        ("q", "1", "A", dt(2023, 2, 1), False),
        ("q", "1", "A", dt(2023, 1, 4), False),  # late
        ("q", "1", "A", dt(2023, 1, 5), False),  # exactly at its arrival: holds
        ("q", "2", "B", dt(2023, 2, 10, 11), False),  # late within the month
        ("q", "2", "B", dt(2023, 2, 10, 13), False),
        ("q", "3", "C", dt(2023, 2, 1), False),  # deleted at that time
        ("q", "3", "C", dt(2023, 1, 31, 23), False),
        ("q", "4", "D", dt(2023, 1, 1), False),  # never there
        ("q", "4", "D", dt(2023, 3, 1), False),  # deleted comes before missing
        ("q", "5", None, dt(2023, 1, 1), False),
        ("q", "6", "A", None, False),
        ("t", "7", "A_p0", dt(2023, 2, 1), True),
        ("t", "7", "X_p0", dt(2023, 2, 1), True),
        ("t", "7", "X_p0", dt(2023, 2, 1), True),
        ("t", "8", "D_p0", dt(2023, 3, 1), True),
    ]
    want = [
        ("q", "2023-01", "1", "A", "late"),
        ("q", "2023-01", "4", "D", "missing"),
        ("q", "2023-02", "2", "B", "late"),
        ("q", "2023-02", "3", "C", "deleted"),
        ("q", "2023-03", "4", "D", "deleted"),
        ("t", "2023-02", "7", "X_p0", "missing"),
        ("t", "2023-03", "8", "D_p0", "deleted"),
    ]
    assert found(spark, refs, links, docs, gone) == want
    assert found(spark, refs, links, docs, gone, keys_per_range=1) == want


def test_empty_tables(spark):
    assert found(spark, [], [], [], []) == []
    assert found(spark, [("q", "1", "A", dt(2023, 1, 1), False)], [], [], []) == [("q", "2023-01", "1", "A", "missing")]


def test_reference_tables_with_extra_columns(spark):
    q = spark.createDataFrame([("1", "A", 1, dt(2023, 1, 1), "x", "y")], "qid string, docid string, rel int, judged_at timestamp, tbl string, at string")
    t = spark.createDataFrame([("1", ["p", None, "p"], dt(2023, 1, 1), 5), ("2", None, None, 5)], "qid string, pids array<string>, built_at timestamp, key int")
    refs = orphans.retrieval_references(q, t)
    assert len(refs.collect()) == 4
    docs = spark.createDataFrame([("A", dt(2022, 1, 1), "t", 3)], DOCS + ", kind string, period int")
    links = spark.createDataFrame([("p", "A", 1)], LINKS + ", range int")
    gone = spark.createDataFrame([], GONE)
    assert rows(orphans.orphan_references(refs, links, docs, gone)) == []
    assert orphans.orphan_counts(orphans.orphan_references(refs, links, docs.limit(0), gone)).collect()


def test_long_keys_and_ends_that_are_no_characters(spark):
    """A very long key, and keys that differ in a trailing zero character only."""
    long = "k" * 200_000
    refs = spark.createDataFrame([(k, 24000) for k in ("a", "a\0", long, "b")], "key string, period int")
    parents = spark.createDataFrame([("a", 0, 1 << 30), (long, 0, 1 << 30)], "key string, first int, last int")
    assert sorted(r.key for r in orphans.suspects(refs, parents, 2).collect()) == ["a\0", "b"]
