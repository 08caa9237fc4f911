"""Queries of the language-model operators (p4, p7, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.enums import norm_kind, norm_name, norm_status
from spanloom.functions.ids import norm_id, utc_day
from spanloom.llm import distinct, leaks, packing, quantiles, repeats
from spanloom.llm.tokens import token_counts
from spanloom.runtime import cut, table

QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]


def durations(s, d):
    """Durations that count: neither missing nor negative."""
    return table(s, d, "spans").where("duration_ns >= 0").select(utc_day("start_time").alias("day"), norm_name("name").alias("name"), norm_kind("kind").alias("kind"), "duration_ns")


def p4_percentiles(s, d):
    return quantiles.percentiles(durations(s, d), ["name", "kind"], "duration_ns", QUANTILES)


def p4_day_percentiles(s, d):
    """Percentiles of each day; the summaries they come from can be put together."""
    return quantiles.percentiles(durations(s, d), ["day", "name", "kind"], "duration_ns", QUANTILES)


def p4_from_days(s, d):
    """The same percentiles from one summary per day, put together afterwards."""
    keys = ["day", "name", "kind"]
    days = quantiles.merge_summaries(quantiles.summarise(durations(s, d), keys, "duration_ns", quantiles.EPS / 2), keys, quantiles.EPS / 2)
    return quantiles.answers(quantiles.merge_summaries(days.drop("day"), keys[1:], quantiles.EPS), keys[1:], QUANTILES, whole=True)


def _ranked(got, keys):
    """Percentiles held against the exact ranks of their values."""
    return lambda s, d: quantiles.rank_check(durations(s, d), keys, "duration_ns", got(s, d))


def p10_threshold_check(s, d):
    """The quantiles that the thresholds rest on, held against the exact ranks of the
    shares; and thresholds are what they say."""
    keys = ["lang", "source"]
    shares = cut(repeats.repeat_shares(table(s, d, "documents")), "shares")
    got = quantiles.percentiles(shares, keys, "share", [0.5, repeats.QUANTILE])
    return quantiles.rank_check(shares, keys, "share", got)


def p10_flag_check(s, d):
    """Each language and source: documents, and whether those flagged are exactly those at or
    above its threshold."""
    docs = table(s, d, "documents")
    shares = repeats.repeat_shares(docs)
    t = repeats.thresholds(shares)
    want = shares.join(t.select("lang", "source", "threshold"), ["lang", "source"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.count(F.when((F.col("share") >= F.col("threshold")) & (F.col("share") > 0), 1)).alias("k"))
    have = repeats.flagged(docs).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("j"))
    return want.join(have, ["lang", "source"], "left").select("lang", "source", "n_docs", (F.col("k") == F.coalesce("j", F.lit(0))).alias("all_and_only"))


def visits(s, d):
    return table(s, d, "spans").select(norm_id("trace_id").alias("trace_id"), utc_day("start_time").alias("day"), norm_name("name").alias("name"), norm_status("status").alias("status"))


DIMS = ["day", "name", "status"]


def p7_distinct(s, d):
    return distinct.distinct_counts(visits(s, d), DIMS, "trace_id")


def p7_registers(s, d):
    return distinct.registers(visits(s, d), DIMS, "trace_id")


def p7_bound_check(s, d):
    """The estimates of all combinations held against exact counts: within five
    standard errors, or three where few registers are hit."""
    v = visits(s, d).where("trace_id is not null").select(F.explode(distinct.levels(DIMS)).alias("l"), "trace_id").select("l.*", "trace_id")
    exact = v.groupBy("level", *DIMS).agg(F.countDistinct("trace_id").alias("n_exact"))
    got = p7_distinct(s, d).select("level", *DIMS, "n_distinct", "std_error")
    same = F.lit(True)
    for c in ("level", *DIMS):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    ok = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(3.0), 5 * F.col("std_error") * F.col("n_exact"))
    return exact.alias("a").join(got.alias("b"), same, "left").select("a.level", *(f"a.{c}" for c in DIMS), "n_exact", F.coalesce(ok, F.lit(False)).alias("in_bound"))


def p8_packed(s, d):
    return packing.packed_documents(table(s, d, "documents"), table(s, d, "pack_classes"))


QUERIES = {
    "p4_day_percentiles": p4_day_percentiles,
    "p4_percentiles": p4_percentiles,
    "p4_from_days": p4_from_days,
    "p4_rank_check": _ranked(p4_percentiles, ["name", "kind"]),
    "p4_day_rank_check": _ranked(p4_day_percentiles, ["day", "name", "kind"]),
    "p4_from_days_check": _ranked(p4_from_days, ["name", "kind"]),
    "p7_distinct": p7_distinct,
    "p7_registers": p7_registers,
    "p7_bound_check": p7_bound_check,
    "p8_containers": p8_packed,
    "p8_summary": lambda s, d: packing.packing_summary(p8_packed(s, d)),
    "p8_bounds": lambda s, d: packing.packing_bounds(p8_packed(s, d)),
    "p8_check": lambda s, d: packing.packing_check(p8_packed(s, d), token_counts(table(s, d, "documents"))),
    "p8_token_counts": lambda s, d: token_counts(table(s, d, "documents")),
    "p9_found": lambda s, d: leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("item_id", "doc_id"),
    "p9_leaks": lambda s, d: leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p9_spans": lambda s, d: leaks.leaked_items(table(s, d, "documents"), table(s, d, "eval_items"), spans=True),
    "p10_found": lambda s, d: repeats.highly_repetitive(table(s, d, "documents")),
    "p10_word_counts": lambda s, d: repeats.repeat_shares(table(s, d, "documents")).select("doc_id", "n_words", "n_repeated"),
    "p10_shares": lambda s, d: repeats.repeat_shares(table(s, d, "documents")),
    "p10_flagged": lambda s, d: repeats.flagged(table(s, d, "documents")).select("doc_id", "lang", "source", "n_words", "n_repeated"),
    "p10_threshold_check": p10_threshold_check,
    "p10_flag_check": p10_flag_check,
    "p10_thresholds": lambda s, d: repeats.thresholds(repeats.repeat_shares(table(s, d, "documents"))),
}

_NAME = "coalesce(regexp_replace(regexp_replace(trim(name), '\\s+', ' ', 'g'), '/[0-9]+(/|$)', '/{id}\\1', 'g'), '')"
_KIND = "case when regexp_replace(lower(trim(kind)), '^span_kind_', '') in ('internal', 'server', 'client', 'producer', 'consumer') then regexp_replace(lower(trim(kind)), '^span_kind_', '') else 'internal' end"
_STATUS = "case when regexp_replace(lower(trim(status)), '^status_code_', '') in ('ok', 'error', 'unset') then regexp_replace(lower(trim(status)), '^status_code_', '') else 'unset' end"
_TRACE = "nullif(lower(trim(trace_id, chr(32)||chr(9)||chr(10)||chr(13))), '')"

_DAY7 = "strftime(make_timestamp(start_time // 1000), '%Y-%m-%d')"


def _words_sql(text: str, joined: bool) -> str:
    """Words of a text in SQL; joined: without page headers and hyphens (see leaks.plain)."""
    if joined:
        page = r"(?m)^[^\n]{0,200}\b(?:[Pp]age|PAGE|[Ss]eite|SEITE|[Bb]latt|[Pp]\.|S\.) ?\d{1,4} ?(?:of|von|sur|de|/|OF|VON|SUR) ?\d{1,4}[^\n0-9A-Za-z_]{0,20}$"
        text = rf"regexp_replace(regexp_replace({text}, '{page}', '', 'g'), '-\n\s*', '', 'g')"
        hyphen = r"([\pL\pN])[-­‐‑]([\pL\pN])"
        for _ in range(2):
            text = rf"regexp_replace({text}, '{hyphen}', '\1\2', 'g')"
    return rf"regexp_extract_all(lower({text}), '[\pL\pN]+')"


_W10 = rf"""w as (select doc_id, list_transform({_words_sql("text", False)}, lambda x: case when regexp_matches(x, '\d') then '0' else x end) l from documents where text is not null and doc_id is not null),
g as (select doc_id, unnest(range(1, len(l) - 6)) i, unnest(list_transform(range(1, len(l) - 6), lambda i: array_to_string(l[i:i + 7], ' '))) gram from w),
f as (select doc_id, i, min(i) over (partition by doc_id, gram) first from g),
r as (select doc_id, count(distinct p) k from (select doc_id, unnest(range(i, i + 8)) p from f where i > first) group by 1),
s as (select w.doc_id, cast(len(l) as bigint) n_words, coalesce(k, 0) n_repeated from w left join r on r.doc_id = w.doc_id)"""
_W9 = f"""d as (select doc_id, {_words_sql("text", True)} l from documents where text is not null and doc_id is not null),
p as (select item_id, {_words_sql("passage", True)} l from eval_items where passage is not null and item_id is not null),
pg as (select item_id, unnest(range(1, len(l) - 3)) pi, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) gram from p where len(l) >= 5),
dg as (select distinct doc_id, gram from (select doc_id, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) gram from d where len(l) >= 5) where gram in (select gram from pg)),
c as (select item_id, doc_id, count(distinct w) covered from (select item_id, doc_id, unnest(range(pi, pi + 5)) w from pg join dg using (gram)) group by 1, 2),
o as (select c.item_id, c.doc_id, c.covered covered_words, cast(len(p.l) as bigint) passage_words from c join p using (item_id) where 2 * c.covered >= len(p.l))"""

SQL = {
    "p9_found": f"with {_W9} select item_id, doc_id from o",
    "p9_leaks": f"with {_W9} select * from o",
    "p9_spans": f"""with {_W9}, places as (select distinct doc_id, i from (select doc_id, unnest(range(1, len(l) - 3)) i, unnest(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) gram from d where len(l) >= 5) join pg using (gram) join o using (item_id, doc_id)),
m as (select *, case when i > lag(i) over (partition by doc_id order by i) + 5 then 1 else 0 end fresh from places), n as (select *, sum(fresh) over (partition by doc_id order by i) no from m)
select doc_id, min(i) - 1 span_start, max(i) + 4 span_end from n group by doc_id, no""",
    "p10_shares": f"with {_W10} select doc_id, coalesce(lower(trim(lang)), '') lang, coalesce(source, '') source, n_words, n_repeated, case when n_words > 0 then n_repeated / n_words else 0 end as share from s join documents using (doc_id)",
    "p10_found": f"with {_W10} select doc_id from s where n_words > 0 and 3 * n_repeated >= n_words",
    "p10_word_counts": f"with {_W10} select * from s",
    "p8_check": """select pack_class, cast(capacity_tokens as bigint) capacity, count(*) n_docs, true whole, true within_capacity, true bounds_hold, true open_ones_repacked
from (select distinct pack_class, capacity_tokens from pack_classes), (select doc_id from documents where doc_id is not null and length(text) > 0) group by 1, 2""",
    "p4_rank_check": f"select {_NAME} as name, {_KIND} kind, q, cast(count(*) as bigint) n, true in_bound from spans, (select unnest([0.5, 0.75, 0.9, 0.95, 0.99]::double[]) q) where duration_ns >= 0 group by 1, 2, 3",
    "p4_day_rank_check": f"select {_DAY7} as day, {_NAME} as name, {_KIND} kind, q, cast(count(*) as bigint) n, true in_bound from spans, (select unnest([0.5, 0.75, 0.9, 0.95, 0.99]::double[]) q) where duration_ns >= 0 group by 1, 2, 3, 4",
    "p7_bound_check": f"""with v as (select {_TRACE} t, {_DAY7} as day, {_NAME} as name, {_STATUS} status from spans where {_TRACE} is not null)
select concat_ws(',', case when grouping(day) = 0 then 'day' end, case when grouping(name) = 0 then 'name' end, case when grouping(status) = 0 then 'status' end) as level, day, name, status, count(distinct t) n_exact, true in_bound
from v group by grouping sets ((day, name, status), (day, name), (day, status), (name, status), (day), (name), (status), ())""",
    "p10_threshold_check": f"with {_W10}, x as (select coalesce(lower(trim(lang)), '') lang, coalesce(source, '') source from s join documents using (doc_id)) select lang, source, q, count(*) n, true in_bound from x, (select unnest([0.5, 0.95]::double[]) q) group by 1, 2, 3",
    "p10_flag_check": "select coalesce(lower(trim(lang)), '') lang, coalesce(source, '') source, count(*) n_docs, true all_and_only from documents where text is not null and doc_id is not null group by 1, 2",
}
SQL["p4_from_days_check"] = SQL["p4_rank_check"]
