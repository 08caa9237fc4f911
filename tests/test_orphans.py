import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from spanloom.functions.ids import floor_div, norm_id, norm_parent, utc_day
from spanloom.operators.orphans import orphan_keys, orphan_references, same_file, store_orphans
from spanloom.runtime import table


@pytest.mark.parametrize("share", [0.5, 0.05, 1e-9])
def test_heavy_and_light_keys(spark, share):
    refs = [("hot", f"r{i}", "2025-01-01") for i in range(300)] + [("there", f"s{i}", "2025-01-02") for i in range(200)]
    refs += [(f"k{i % 40}", f"t{i}", "2025-01-03") for i in range(100)] + [(None, "n", "2025-01-01")]
    df = spark.createDataFrame(refs, "key string, id string, day string")
    targets = spark.createDataFrame([("there",), ("there",), ("k1",), ("k2",), (None,)], "key string")
    have = {"there", "k1", "k2"}
    share = max(share, 1 / 400)
    want = sorted((k, i, d) for k, i, d in refs if k is not None and k not in have)
    for most in (1_000_000, 7):  # 7: other keys are dealt to several tasks
        assert rows(orphan_references(df, ["key"], "day", targets, share, most).select("key", "id", "day")) == want
    counts, *_ = orphan_keys(df, ["key"], "day", targets, share)
    assert sum(r["n"] for r in counts.collect()) == len(want)
    assert orphan_references(df, ["key"], "day", targets.limit(0), share).count() == 600
    assert orphan_references(df.limit(0), ["key"], "day", targets, share).count() == 0


def test_ids(spark):
    df = spark.createDataFrame([(" AB\t", "0000"), ("", "  "), (None, None), ("x", "0A0")], "a string, b string")
    assert [tuple(r) for r in df.select(norm_id("a"), norm_parent("b")).collect()] == [("ab", None), (None, None), (None, None), ("x", "0a0")]
    t = spark.createDataFrame([(-1,), (0,), (86_400_000_000_000 - 1,), (None,)], "t long")
    assert [r[0] for r in t.select(utc_day("t")).collect()] == ["1969-12-31", "1970-01-01", "1970-01-01", None]
    assert [r[0] for r in t.select(floor_div("t", 10)).collect()] == [-1, 0, 8_639_999_999_999, None]
    p = spark.createDataFrame([("/srv/spanstore/b//1",), ("./b/1",), ("b/1",), (".//b/1",), ("/srv/spanstore//b/1",)], "p string")
    assert {r[0] for r in p.select(same_file("p")).collect()} == {"b/1"}


def test_store_small(spark):
    day = dt.datetime(2025, 3, 1, 12)
    spans = spark.createDataFrame([("T", "a", None, 10, 1), ("t", "b", " A ", 20, 2), ("t", "c", "zz", 30, 3), ("t", "C", "ZZ", 30, 4), ("u", "d", "a", 40, 5), (None, "e", "q", 1, 6)], "trace_id string, span_id string, parent_span_id string, start_time long, recv_no long")
    index = spark.createDataFrame([("T", 1, day), ("t", 1, day), ("t", 2, day), ("t", None, day), ("t", 3, day)], "trace_id string, block_id long, indexed_at timestamp_ntz")
    blocks = spark.createDataFrame([(1, "./f//1", None, day), (2, "f/2", day, day), (4, None, None, day), (5, "f/5", None, day), (5, "f/5", None, day)], "block_id long, file_path string, deleted_at timestamp_ntz, created_at timestamp_ntz")
    files = spark.createDataFrame([("f/1", None), ("f/5", day)], "file_path string, removed_at timestamp_ntz")
    got = rows(store_orphans(spans, index, blocks, files))
    assert got == sorted(
        [
            ("spans", "t:c", "zz", "1970-01-01"),
            ("spans", "u:d", "a", "1970-01-01"),
            ("trace_index", "t", "2", "2025-03-01"),
            ("trace_index", "t", "3", "2025-03-01"),
            ("blocks", "5", "f/5", "2025-03-01"),
        ]
    )
    none = [x.limit(0) for x in (spans, index, blocks, files)]
    assert store_orphans(*none).count() == 0


def test_extra_columns(spark, data):
    t = {x: table(spark, data, x) for x in ("spans", "trace_index", "blocks", "block_files")}
    plain = rows(store_orphans(*t.values()))
    more = [x.withColumn("key_id", F.lit(1)).withColumn("day", F.lit("x")).withColumn("period", F.lit(2)) for x in t.values()]
    assert rows(store_orphans(*more)) == plain
