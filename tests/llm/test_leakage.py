import random

import numpy as np
import pytest
from conftest import rows

from moraine.llm import leakage as L

W = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ar", "el", "in", "om", "ut")]


def brute(docs, items, share=0.5, replaced=0.1):
    out = set()
    for d, t in docs:
        w = L.words_of(t or "")
        for i, q in items:
            v = L.words_of(q or "")
            if not v:
                continue
            least = -(-len(v) * share // 1)
            for off in range(-len(v), len(w)):
                same = [k for k in range(len(v)) if 0 <= off + k < len(w) and w[off + k] == v[k]]
                if any(same[b] - same[a] + 1 >= least and (same[b] - same[a] + 1) - (b - a + 1) <= replaced * (same[b] - same[a] + 1) for a in range(len(same)) for b in range(a, len(same))):
                    out.add((d, i))
                    break
    return sorted(out)


def data(seed=2):
    r = random.Random(seed)
    text = lambda n: [r.choice(W) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([4, 9, 12, 20, 30, 44, 60, 80])]
    docs = []
    for d in range(60):
        body = text(60)
        v = items[d % 8][1].split()
        size = max(1, round(len(v) * r.choice([0.4, 0.5, 0.6, 0.8, 1.0])))
        at = r.randrange(0, len(v) - size + 1)
        part = v[at : at + size]
        for k in r.sample(range(size), int(size * r.choice([0, 0.05, 0.1, 0.2]))):
            part[k] = "changed"
        body[20:20] = part
        docs.append((d, (", ".join(body) if d % 3 else " ".join(body).upper() + "!")))
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(L.leaks(D, I).select("doc_id", "item_id")) == want and len(want) > 20


def test_normal_forms(spark):
    item = "Don’t forget “the garden” next to the well-known pear &amp; tree."
    docs = [(1, "don't forget THE garden next to the well known pear & tree"), (2, "dont forget\nthe garden, next to the well known pear tree"), (3, "garden")]
    got = rows(L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, item)], "item_id long, text string")).select("doc_id", "item_id"))
    assert got == [(1, 7), (1, 8), (2, 7), (2, 8)]


def test_edge_cases(spark):
    D = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "   ", "x", 1), (4, "alpha beta gamma " * 40_000, "x", 1), (4, "alpha beta gamma " * 40_000, "x", 1)], "doc_id long, text string, doc string, item int")
    I = spark.createDataFrame([(1, None, "dev"), (2, "", "dev"), (3, "alpha beta gamma alpha beta gamma", None), (4, "!!", "dev")], "item_id long, text string, split string")
    assert rows(L.leaks(D, I).select("doc_id", "item_id")) == [(4, 3)]
    assert rows(L.leaks(D.limit(0), I)) == [] and rows(L.leaks(D, I.limit(0))) == []


def test_masks_hit_every_stretch_that_counts():
    r = random.Random(1)
    for n in range(1, 60):
        for _ in range(60):
            ok = np.ones(n, bool)
            inner = range(1, n - 1)
            for k in r.sample(inner, min(len(inner), n // 10)):
                ok[k] = False
            assert any(all(ok[p + k] for k in range(len(m)) if m[k] == "1") for m in L.masks_for(n) for p in range(n - len(m) + 1)), (n, ok)


def test_masks_are_lossless_and_their_gaps_are_needed():
    for masks, least in ((L.LONG, L.FROM_LONG), (L.MIDDLE, 10)):
        fewest = L.least_blocking(masks, 200)
        assert all(fewest[n] > n // 10 for n in range(least, 201))
        alone = L.least_blocking(masks[:1], 200)
        assert any(alone[n] <= n // 10 for n in range(least, 201))
    # Nothing may be replaced under ten words.
    assert all(L.least_blocking(L.MIDDLE, 9)[n] > 0 for n in range(L.FROM_MIDDLE, 10))


def test_without_the_spaced_masks_a_case_is_lost(spark):
    """Twenty words of an item of forty, with two of them replaced such that no seven in a row are left."""
    item = [f"w{i}" for i in range(40)]
    part = item[5:25]
    part[6], part[13] = "x", "y"
    D = spark.createDataFrame([(1, " ".join(["before"] * 9 + part + ["after"] * 9))], "doc_id long, text string")
    I = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in L.leaks(D, I).collect()] == [(1, 1, 20, 40)]
    runs = L.LONG[:1]
    assert L.leaks(D, I, masks=lambda least: runs).collect() == []


def test_stretch_against_all_runs():
    r = random.Random(5)
    for _ in range(300):
        same = np.array([r.random() < 0.85 for _ in range(r.randrange(1, 40))])
        at = np.flatnonzero(same).tolist()
        want = max((y - x + 1 for i, x in enumerate(at) for j, y in enumerate(at[i:], i) if 10 * (y - x + 1 - (j - i + 1)) <= y - x + 1), default=0)
        assert L.stretch(same, 100) == want


def test_long_items_and_many(spark):
    """An item of 20,000 words, and more items than documents, in one pass."""
    long = " ".join(f"w{i * i % 7919}" for i in range(20_000))
    items = [(0, long)] + [(k, f"the same beginning of all items here item {k} " + " ".join(f"v{k}x{j}" for j in range(20))) for k in range(1, 800)]
    docs = [(1, "x " * 500 + long[:80_000]), (2, items[7][1]), (3, "the same beginning of all items here and no more")]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(L.leaks(D, I).select("doc_id", "item_id")) == [(1, 0), (2, 7)]


def test_more_replaced_words_than_the_masks_bear(spark):
    D = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        L.leaks(D, D.toDF("item_id", "text"), replaced=0.2)
