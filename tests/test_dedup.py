import random

from conftest import rows
from spanloom.streaming.dedup import _batch_writer, copies, span_copies, span_kept, stream_totals

SHAPE = "recv_no long, trace_id string, span_id string, start_time long, ingested_at timestamp_ntz, bucket int, kind string, batch_no long"
HOUR = 3_600_000_000_000


def brute(data):
    by = {}
    for r in data:
        if r[1] and r[2] and r[0] is not None:
            by.setdefault((r[1].strip().lower(), r[2].strip().lower()), []).append(r[0])
    return sorted((min(v), x) for v in by.values() for x in v if x > min(v))


def messages(n=600, seed=7):
    """Event times rise with the number, but some lag behind; copies bear their message's time."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = max(0, i // 2 - rnd.choice([0, 0, 0, 1, 5, 150]))
        out.append((i, rnd.choice([f"t{k}", f" T{k} "]), rnd.choice(["s", "S"]), k * HOUR // 10, None, 1, "x"))
    out += [(n + i, "hot", "one", 5 * HOUR, None, 2, "y") for i in range(300)]
    out += [(n + 301, None, "s", 1, None, 1, "z"), (n + 302, "t", None, 1, None, 1, "z"), (n + 303, "nt", "s", None, None, 1, "z"), (n + 304, "NT", "s", None, None, 1, "z")]
    return out


def laid(spark, p, data, order):
    spark.createDataFrame([(*r, order(r)) for r in data], SHAPE).repartition(3).write.parquet(p)
    return p


def test_copies_over_batches_late_and_out_of_order(spark, tmp_path):
    data = messages()
    rnd = random.Random(1)
    for name, order in (("by_number", lambda r: r[0] // 9), ("mixed", lambda r: rnd.randrange(50)), ("one_batch", lambda r: None)):
        p = laid(spark, str(tmp_path / name), data, order)
        assert sorted(rows(span_copies(spark, p, delay_ms=1_800_000, steps=5))) == brute(data), name
    kept = {r.recv_no for r in span_kept(spark, p).collect()}
    assert kept == {r[0] for r in data if r[1] and r[2]} - {c for _, c in brute(data)}


def test_several_batches_with_late_messages(spark, tmp_path):
    data = messages()
    p = laid(spark, str(tmp_path / "in"), data, lambda r: r[0])
    t = stream_totals(spark, p, delay_ms=1_800_000).first()
    n = len(brute(data))
    assert (t.n_messages, t.n_copies, t.n_new, t.several_batches, t.some_late) == (902, n, 902 - n, True, True)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """What a batch has written is replaced when it is run again, also after later batches."""
    root = str(tmp_path)
    write = _batch_writer(root)
    shape = "h1 long, h2 long, recv_no long, kept_recv_no long, ms long, kind string"
    first = spark.createDataFrame([(1, 1, 1, 1, 0, "new"), (1, 1, 2, 1, 0, "copy"), (2, 2, 3, 3, 10**8, "new")], shape)
    second = spark.createDataFrame([(1, 1, 4, 4, 0, "late"), (3, 3, 5, 5, 7, "late"), (3, 3, 6, 6, 7, "late"), (2, 2, 7, 3, 10**8, "copy")], shape)
    want = [(1, 2), (1, 4), (3, 7), (5, 6)]
    for df, no in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        write(df, no)
    assert rows(copies(spark, root)) == want
    assert spark.read.parquet(f"{root}/seen").count() == 3


def test_copies_with_other_event_times(spark, tmp_path):
    """Copies that don't bear their message's event time are found by settling."""
    data = [(1, "a", "s", 0, None, 1, "x"), (2, "b", "s", 100 * HOUR, None, 1, "x"), (3, "a", "s", 200 * HOUR, None, 1, "x")]
    p = laid(spark, str(tmp_path / "in"), data, lambda r: r[0])
    assert rows(span_copies(spark, p, steps=3)) == []
    assert rows(span_copies(spark, p, steps=3, settle=True)) == [(1, 3)]


def test_single_file_and_empty(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.createDataFrame([(*r, 1) for r in messages(40)], SHAPE).limit(0).coalesce(1).write.parquet(p)
    assert rows(span_copies(spark, p)) == []
