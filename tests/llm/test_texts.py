import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm.fmindex import FMIndex, suffix_array
from spanloom.llm.leaks import leaked_items, plain
from spanloom.llm import packing
from spanloom.llm.packing import best_fit_decreasing, lower_bound, pack, packed_documents, packing_check, packing_summary, repacked
from spanloom.llm.repeats import HIGH, flagged, highly_repetitive, repeat_shares, thresholds
from spanloom.llm.tokens import TokenCounter, _encoding, token_counts, VOCABULARY
from spanloom.llm.words import WordCoder, piece_words
from spanloom.runtime import table


def out(df):
    return sorted(tuple(r) for r in df.collect())


# --- index ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.integers(1, 9))
def test_index_against_search(w, sample):
    text = np.array(w)
    full = [*w, 0]
    assert suffix_array(np.array(full)).tolist() == sorted(range(len(full)), key=lambda i: full[i:])
    fm = FMIndex(text, sample)
    for k in (1, 3):
        phrases = np.array([[a, *[(a + i) % 5 + 1 for i in range(k - 1)]] for a in range(0, 6)])
        lo, hi = fm.search(phrases)
        for p, a, b in zip(phrases.tolist(), lo, hi):
            want = [i for i in range(len(w) - k + 1) if w[i : i + k] == p]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_index_with_many_words_and_long_repeats():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 200_000, 3000)
    w[1500:2900] = w[:1400]
    fm = FMIndex(w)
    lo, hi = fm.search(w[10:15][None])
    assert sorted(fm.locate(np.arange(lo[0], hi[0]))) == [10, 1510]


# --- words ---


def test_words_are_those_of_the_pattern():
    texts = ["Élan vital, l'été!  don't\n\nstop—now x_y 3,141", "", "   ", "--", "a", "a-b B-a well-known"]
    c = WordCoder()
    flat, off = c.encode(texts)
    names = {i: w for w, i in c.words.items()}
    got = [[names[i] for i in flat[a:b].tolist()] for a, b in zip(off, off[1:])]
    assert got == [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert piece_words("Well-Known--x", joined=True) == ["wellknown", "x"]
    c = WordCoder(numbers=True)
    flat, _ = c.encode(["a 12 3b 4.5"])
    assert len(set(flat.tolist())) == 2


# --- leaks ---


def words(t):
    return [w for p in plain(t).split() for w in piece_words(p, joined=True)]


def test_leaks_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["été", "Straße"]
    formula = [rnd.choice(vocab) for _ in range(12)]
    passages = {}
    for i in range(30):
        p = [rnd.choice(vocab) for _ in range(rnd.randint(3, 40))]
        passages[i] = p + formula if i % 2 else p
    passages[30], passages[31], passages[32] = passages[4], formula, []
    docs = {}
    for d in range(80):
        t = []
        for _ in range(rnd.randint(0, 6)):
            p = passages[rnd.randrange(33)]
            a = rnd.randrange(len(p) + 1)
            t += rnd.choice([formula, p, p[a:], p[:a], [rnd.choice(vocab) for _ in range(9)]])
        s = ""
        for w in t:
            s += (w[:2] + "-\n" + w[2:] if rnd.random() < 0.05 and len(w) > 3 else w.upper() if rnd.random() < 0.1 else w) + rnd.choice([" ", " ", ", ", "\n", "\n\nCourt of X — 6 RG 1/02 — Page 2 of 3\n\n"])
        docs[d] = s
    docs[80], docs[81] = "", docs[3]
    want = []
    for i, p in passages.items():
        ws = words(" ".join(p))
        for d, t in docs.items():
            x = words(t)
            have = {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            hit = {k + j for k in range(len(ws) - 4) if tuple(ws[k : k + 5]) in have for j in range(5)}
            if len(ws) >= 5 and 2 * len(hit) >= len(ws):
                want.append((i, d, len(hit), len(ws)))
    assert len(want) > 50
    df = spark.createDataFrame([(d, t, 1) for d, t in docs.items()] + [(99, None, 1), (None, "x", 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(i, " ".join(p), 0) for i, p in passages.items()] + [(77, None, 0)], "item_id long, passage string, doc_id int")
    assert out(leaked_items(df, items)) == sorted(want)
    spans = leaked_items(df, items, spans=True).collect()
    assert {r.doc_id for r in spans} == {d for _, d, _, _ in want} and all(r.span_end - r.span_start >= 5 for r in spans)
    assert out(leaked_items(df.limit(0), items)) == [] == out(leaked_items(df, items.limit(0)))


def test_headers_by_their_place_and_by_recurrence():
    long = "Court of X " * 40
    alone = f"one two\n\n{long}— 6 RG 1/02 — Leht 2/3\n\nthree four"
    assert plain(alone) == "one two\n\n\n\nthree four"
    t = "one\nKohus 6 Rg 1/02 2 kpl 3\ntwo three 1 of 9\nfour\nKohus 6 Rg 1/02 3 kpl 3\nfive"
    assert plain(t) == "one\n\ntwo three 1 of 9\nfour\n\nfive"  # a line in the running text that ends so once stays
    same = "a\nhe paid 2 of 12\nb\nhe paid 2 of 12\nc"  # nor is what is said twice a header
    assert plain(same) == same and plain("a\n\nit was so for 3 of 12.\n\nb").count("12") == 1


def test_blocks_of_items_in_one_pass(spark):
    rnd = random.Random(6)
    texts = {d: [f"w{rnd.randrange(3000)}" for _ in range(400)] for d in range(40)}
    passages = [(i, " ".join(texts[i % 40][i % 300 : i % 300 + 30] if i % 2 else [f"v{rnd.randrange(3000)}" for _ in range(30)])) for i in range(1000)]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    got = leaked_items(df, items, item_block=150)
    assert out(got) == sorted((i, i % 40, 30, 30) for i in range(1, 1000, 2)) == out(leaked_items(df, items))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one pass over the documents
    assert sorted(tuple(r) for r in leaked_items(df, items, True, 150).collect()) == sorted(tuple(r) for r in leaked_items(df, items, True).collect())


def test_leak_in_a_very_long_text(spark):
    p = " ".join(f"p{i}" for i in range(60))
    long = " ".join(f"x{i % 5000}" for i in range(400_000))
    df = spark.createDataFrame([(1, long + " " + p + " " + long), (2, long)], "doc_id long, text string")
    assert out(leaked_items(df, spark.createDataFrame([(5, p)], "item_id long, passage string"))) == [(5, 1, 60, 60)]


# --- repetition ---


def share(t, run=8):
    w = ["0" if re.search(r"\d", x) else x for x in re.findall(r"[^\W_]+", t.lower())]
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit.update(range(i, i + run))
        seen.add(g)
    return len(w), len(hit)


def test_repetition_against_brute_force(spark):
    rnd = random.Random(9)
    docs = []
    for i in range(120):
        s = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(3)) * rnd.randrange(2) for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(0, 8))]
        docs.append((i, ". ".join(s + rnd.choices(s, k=rnd.randrange(6)) if s else s), rnd.choice(["en", " EN", None]), rnd.choice(["x", None])))
    docs += [(200, "spam " * 5000, "en", "x"), (201, None, "en", "x"), (202, " \n", "en", "x"), (None, "a", "en", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("share", F.lit("s")).withColumn("threshold", F.lit(1))
    want = {d: share(t) for d, t, _, _ in docs if t is not None and d is not None}
    assert {r.doc_id: (r.n_words, r.n_repeated) for r in repeat_shares(df).collect()} == want
    assert out(highly_repetitive(df)) == sorted((d,) for d, (n, k) in want.items() if n and 3 * k >= n)
    t = {(r.lang, r.source): r.threshold for r in thresholds(repeat_shares(df)).collect()}
    assert {r.doc_id for r in flagged(df, most=HIGH).collect()} >= {d for d, (n, k) in want.items() if n and 3 * k >= n}
    assert {r.doc_id for r in flagged(df).collect()} == {r.doc_id for r in repeat_shares(df).collect() if r.share > 0 and r.share >= t[r.lang, r.source]}
    assert set(t) <= {(a, b) for a in ("en", "") for b in ("x", "")}
    assert out(highly_repetitive(df.limit(0))) == []


# --- tokens and packing ---


def test_token_counts_are_the_tokenizers(spark, data):
    enc, count = _encoding(VOCABULARY), TokenCounter()
    odd = ["", " ", "  a", "a  b", "a \n b", "x\n\ny ", "\ta b", "don't 's ü ² 12½ 東京 😀 <|endoftext|>", " lead", "trail ", "a b", "a  b", "a" * 5000, "​ x"]
    texts = odd + [r[0] for r in table(spark, data, "documents").select("text").collect() if r[0] is not None]
    assert [count.count(t) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    df = spark.createDataFrame([(1, "a b"), (2, None), (None, "x"), (3, "")], "doc_id long, text string")
    assert out(token_counts(df)) == [(1, 2), (3, 0)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(30, 40))
def test_bound_and_packing(sizes, cap):
    sizes = np.array(sizes, np.int64)
    box = best_fit_decreasing(sizes, cap)
    n = len(set(box.tolist()))
    assert all(sizes[box == b].sum() <= cap for b in set(box.tolist()))

    def fits(k, rest, gaps):
        return not rest or any(fits(k, rest[1:], sorted([*gaps[:i], gaps[i] - rest[0], *gaps[i + 1 :]])) for i in range(k) if gaps[i] >= rest[0] and (i == 0 or gaps[i] != gaps[i - 1]))

    best = next(k for k in range(len(sizes) + 1) if fits(k, sorted(sizes.tolist(), reverse=True), [cap] * k))
    assert lower_bound(sizes, cap) <= best <= n


def test_pack_splits_only_large_items_and_loses_nothing(spark):
    rnd = random.Random(6)
    data = [(i, rnd.choice([rnd.randint(1, 60), rnd.randint(1, 60), 250, 100, 0, None])) for i in range(600)] + [(7, 30)] * 3
    sizes = spark.createDataFrame(data, "doc_id long, n_tokens long")
    classes = spark.createDataFrame([("a", 100), ("b", 64), ("bad", None), (None, 5), ("a", 100)], "pack_class string, capacity_tokens int")
    for group in (50_000, 40):
        got = pack(sizes, classes, group_items=group).collect()
        for name, cap in (("a", 100), ("b", 64)):
            rows = [r for r in got if r.pack_class == name]
            full, docs = {}, {}
            for r in rows:
                full[r.container] = full.get(r.container, 0) + r.tokens
                docs.setdefault(r.doc_id, []).append(r.tokens)
            assert max(full.values()) <= cap and all(cap - full[r.container] == r.gap for r in rows)
            want = {}
            for d, n in data:
                if n:
                    want.setdefault(d, []).extend([cap] * (n // cap) + [n % cap] * (n % cap > 0) if n > cap else [n])
            assert {d: sorted(v) for d, v in docs.items()} == {d: sorted(v) for d, v in want.items()}
            assert len(full) <= 1.05 * lower_bound(np.array([r.tokens for r in rows]), cap) + 2
    assert pack(sizes.limit(0), classes).collect() == [] == pack(sizes, classes.limit(0)).collect()


def test_packed_documents(spark, data):
    got = packing_summary(packed_documents(table(spark, data, "documents"), table(spark, data, "pack_classes"))).collect()
    assert {r.pack_class for r in got} == {"short", "standard", "long"} and all(r.bins >= r.bound and (r.fill > 0.95 or r.bins - r.bound <= 1) for r in got)


def test_exchange_within_one_group_and_between_groups(spark):
    """What best fit decreasing leaves above the bound is packed anew, whatever the number of groups."""
    rnd = random.Random(5)
    data = [(i, rnd.randint(80, 700)) for i in range(600)]
    sizes = spark.createDataFrame(data, "doc_id long, n_tokens int")
    classes = spark.createDataFrame([("a", 1000)], "pack_class string, capacity_tokens int")
    for group in (10_000, 60):
        got = pack(sizes, classes, group_items=group)
        r = packing_check(got, sizes).first()
        assert all(r[c] for c in ("whole", "within_capacity", "bounds_hold", "open_ones_repacked")) and r.n_docs == 600
        before = pack(sizes, classes, group_items=group, rounds=0)
        assert packing_summary(got).first().bins <= packing_summary(before).first().bins
        if group == 60:
            assert packing_summary(got).first().bins < packing_summary(before).first().bins


def test_repacked_is_valid_and_never_worse():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        sizes = rnd.integers(1, 21, rnd.integers(1, 30))
        for box in (np.arange(len(sizes)), best_fit_decreasing(sizes, 20) * 3 + 1):
            again, bound = repacked(sizes, 20, box)
            n = len(np.unique(again))
            assert again.max() + 1 == n and bound <= n <= len(np.unique(box)) and np.bincount(again, weights=sizes).max() <= 20
    assert repacked(np.array([10, 10, 10, 10]), 20, np.arange(4))[0].max() == 1


def test_more_classes_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(packing, "CLASS_BLOCK", 2)
    classes = spark.createDataFrame([(f"c{i}", 10 + i) for i in range(5)], "pack_class string, capacity_tokens int")
    got = packing_summary(pack(spark.createDataFrame([(1, 4), (2, 9), (3, 25)], "doc_id long, n_tokens int"), classes)).collect()
    assert len(got) == 5 and all(r.tokens == 38 for r in got)


# --- the whole tables ---


@pytest.mark.parametrize("name", ["p9_found", "p10_found"])
def test_found_queries(spark, data, name):
    from spanloom.llm.catalog import QUERIES

    got = QUERIES[name](spark, data)
    assert got.columns == {"p9_found": ["item_id", "doc_id"], "p10_found": ["doc_id"]}[name]
    assert got.count() == got.distinct().count()
