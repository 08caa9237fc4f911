import random

from conftest import rows
from spanloom.operators.intervals import _sliced, merge_intervals, trace_gaps

SHAPE = "entity string, start long, end long"


def brute(iv):
    by = {}
    for k, s, e in iv:
        if k is not None and s is not None and e is not None and s <= e:
            by.setdefault(k, []).append((s, e))
    periods, gaps = [], []
    for k, v in by.items():
        v.sort()
        s, e = v[0]
        for a, b in v[1:]:
            if a > e:
                periods.append((k, s, e))
                gaps.append((k, e, a))
                s, e = a, b
            e = max(e, b)
        periods.append((k, s, e))
    return sorted(periods), sorted(gaps)


def test_random_with_and_without_slices(spark):
    rnd = random.Random(3)
    iv = []
    for k in ("hot", "a", "b", None):
        for _ in range(400 if k == "hot" else 30):
            s = rnd.randrange(5000)
            iv.append((k, rnd.choice([s, s, s, None]) if rnd.random() < 0.05 else s, rnd.choice([s + rnd.randrange(12), s, s - 3, None])))
    iv += iv[:50] + [("a", -(2**63), -(2**63)), ("a", 2**63 - 1, 2**63 - 1)]
    df = spark.createDataFrame(iv, SHAPE)
    want = brute(iv)
    for size in (100_000, 20):
        periods, gaps = merge_intervals(df, size)
        assert ([r[:3] for r in rows(periods)], rows(gaps)) == ([p for p in sorted(want[0], key=repr)], sorted(want[1], key=repr))


def test_touching_nested_points(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 5, 7), ("x", 2, 3), ("x", 9, 9), ("x", 7, 7), ("y", 4, 4)], SHAPE)
    periods, gaps = merge_intervals(df)
    assert rows(gaps) == [("x", 7, 9)]
    assert rows(periods) == [("x", 1, 7, 4), ("x", 9, 9, 1), ("y", 4, 4, 1)]


def test_empty_and_clashing_columns(spark):
    spans = spark.createDataFrame([("T ", 1, 2, "e", 0), ("t", 4, None, "e", 0), ("t", 5, 6, "e", 0), (None, 1, 9, "e", 0)], "trace_id string, start_time long, end_time long, entity string, slice int")
    assert rows(trace_gaps(spans)) == [("t", 2, 5)]
    assert trace_gaps(spans.limit(0)).collect() == []


def test_clustered_starts_make_no_large_slice(spark):
    iv = [("x", k, k) for k in range(5000)] + [("x", 10**15, 10**15)] + [("y", k, k + 1) for k in range(50)]
    sizes = [r["count"] for r in _sliced(spark.createDataFrame(iv, SHAPE), 500).groupBy("entity", "slice").count().collect()]
    assert sum(sizes) == 5051 and max(sizes) <= 1000 and len(sizes) > 8
