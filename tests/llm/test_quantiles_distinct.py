import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.distinct import distinct_counts, estimate, merge_registers, registers, roll_up, standard_error
from spanloom.llm.quantiles import Summary, answers, merge_summaries, percentiles, rank_check, summarise


def off(values, v, q):
    """How far the rank of v is from the rank asked for."""
    s = np.sort(values)
    r = max(1, int(np.ceil(q * len(s))))
    lo, hi = np.searchsorted(s, v) + 1, np.searchsorted(s, v, "right")
    return max(0, lo - r, r - hi)


@pytest.mark.parametrize("seed", range(4))
def test_merged_summaries_stay_within_their_error(seed):
    rng = np.random.default_rng(seed)
    eps = 0.02
    parts = [rng.normal(size=n) if seed % 2 else rng.integers(0, 9, n).astype(float) for n in rng.integers(1, 900, 37)]
    sums = [Summary.of(np.sort(p), eps / 2) for p in parts]
    while len(sums) > 1:
        sums = [Summary.merge(sums[i : i + 4]).compress(eps * 0.7) for i in range(0, len(sums), 4)]
    s, all_ = sums[0].compress(eps), np.concatenate(parts)
    assert s.n == len(all_) and s.err <= eps * s.n + 1 and len(s.t) < 6 / eps
    for q in (0.001, 0.1, 0.5, 0.9, 0.999, 1.0):
        assert off(all_, s.query(q), q) <= s.err + 1
    assert s.query(1.0) == all_.max() and s.query(0) == all_.min()
    x = np.sort(all_)
    t = s.t
    assert (np.searchsorted(x, t["v"]) + 1 <= t["hi"]).all() and (np.searchsorted(x, t["v"], "right") >= t["lo"]).all()


def test_small_groups_are_exact_and_empty():
    s = Summary.of(np.array([1.0, 2.0, 3.0]), 0.01)
    assert [s.query(q) for q in (0, 0.34, 0.5, 1)] == [1, 2, 2, 3] and s.err == 0.5
    assert Summary.merge([]).n == 0 and Summary.merge([s]).n == 3


def test_percentiles_in_spark(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["hot", "hot", "hot", "x", None]), rnd.choice([rnd.gauss(0, 1), 7.0]), i % 7) for i in range(6000)]
    data += [("x", None, 1), ("nan", float("nan"), 1), ("one", 5.0, 1)]
    df = spark.createDataFrame(data, "g string, v double, slot int").repartition(9)
    for got in (percentiles(df.drop("slot"), ["g"], "v", [0.5, 0.99], 0.01), answers(merge_summaries(summarise(df.drop("slot"), ["g"], "v", 0.01, rows=100), ["g"], 0.01, fan_in=3), ["g"], [0.5, 0.99])):
        rows = got.collect()
        assert {r.g for r in rows} == {"hot", "x", None, "one"}
        for r in rows:
            v = np.array([x for g, x, _ in data if g == r.g and x is not None])
            assert r.n == len(v) and r.max_err <= 0.01 * r.n + 1 and off(v, r.value, r.q) <= 0.01 * r.n + 1
    assert percentiles(df.drop("slot").limit(0), ["g"], "v", [0.5]).collect() == []


def test_summaries_of_days_combine(spark):
    df = spark.range(20_000).select((F.col("id") % 4).alias("day"), F.lit("k").alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    days = merge_summaries(summarise(df, ["day", "g"], "v", 0.005), ["day", "g"], 0.005)
    r = answers(merge_summaries(days.drop("day"), ["g"], 0.01), ["g"], [0.5]).first()
    v = np.array([x[0] for x in df.select("v").collect()])
    assert r.n == 20_000 and off(v, r.value, 0.5) <= 200


def test_distinct_counts_and_merging(spark):
    n = 30_000
    df = spark.range(n).select((F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") % 5 > 0, F.lit("b")).alias("b"), (F.col("id") % 9_001).cast("string").alias("x"))
    df = df.unionByName(df.limit(500)).unionByName(spark.createDataFrame([("0", "b", None)], "a string, b string, x string"))
    got = {(r.level, r.a, r.b): r.n_distinct for r in distinct_counts(df, ["a", "b"], "x").collect()}
    exact = {}
    for r in df.where("x is not null").collect():
        for k in (("a,b", r.a, r.b), ("a", r.a, None), ("b", None, r.b), ("", None, None)):
            exact.setdefault(k, set()).add(r.x)
    assert got.keys() == exact.keys()
    assert all(abs(got[k] - len(v)) <= 5 * standard_error() * len(v) + 3 for k, v in exact.items())
    whole = registers(df, ["a", "b"], "x")
    parts = [registers(df.where(c), ["a", "b"], "x") for c in ("a = '0'", "a <> '0' and b is null", "a <> '0' and b is not null", "b = 'b'")]
    assert sorted(map(repr, merge_registers(*parts).collect())) == sorted(map(repr, whole.collect()))
    assert whole.agg(F.max("top"), F.max("reg"), F.min("top")).first()[1] < 4096
    assert estimate(roll_up(whole, ["a", "b"]).where("level = ''"), ["level"]).first().n_distinct == got["", None, None]
    assert distinct_counts(df.limit(0), ["a", "b"], "x").collect() == []


def test_few_identifiers_are_counted_almost_exactly(spark):
    df = spark.createDataFrame([("g", str(i % 10)) for i in range(100)], "g string, top string")
    assert distinct_counts(df, ["g"], "top").where("level = 'g'").first().n_distinct == 10


def test_whole_numbers_stay_whole(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big + k,) for k in range(9)] + [(None,)], "v long")
    got = {r.q: r.value for r in percentiles(df.selectExpr("'g' g", "v"), ["g"], "v", [0.5, 1.0]).collect()}
    assert got == {0.5: big + 4, 1.0: big + 8}


def test_no_range_has_a_bias(spark):
    """Means over many sets lie well within one standard error, also where few and many registers are hit."""
    for n, sets in ((300, 40), (10_000, 40), (40_000, 12)):
        df = spark.range(n * sets).select((F.col("id") % sets).cast("string").alias("g"), F.col("id").cast("string").alias("x"))
        got = distinct_counts(df, ["g"], "x").where("level = 'g'").agg(F.avg("n_distinct")).first()[0]
        assert abs(got / n - 1) < 0.3 * standard_error() + 3 * standard_error() / sets**0.5 * (n > 1000), (n, got)


def test_rank_check_tells_wrong_answers(spark):
    df = spark.range(1000).selectExpr("'g' g", "id v")
    good = spark.createDataFrame([("g", 0.5, 500)], "g string, q double, value long")
    bad = spark.createDataFrame([("g", 0.5, 560)], "g string, q double, value long")
    assert [rank_check(df, ["g"], "v", x).first().in_bound for x in (good, bad)] == [True, False]
