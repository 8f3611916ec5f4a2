"""Golden checks, audits, reports and display values over the field rows of orders."""

from pyspark.sql import functions as F

from docloom.checks.business import SPEC_SQL, spec
from docloom.checks.registry import query
from docloom.fixed import SINGLETON_KEYS
from docloom.operators import audits as AU


def states(t):
    """Documents of orders: some not completed, some without any state."""
    return t.orders.select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "failed").when(F.col("o_orderkey") % 11 != 0, "completed").alias("pipeline_status"),
        F.when(F.col("o_orderkey") % 10 == 3, "queued").otherwise("completed").alias("summary_status"),
    )


STATES_SQL = """
st AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' WHEN o_orderkey % 11 <> 0 THEN 'completed' END AS ps,
  CASE WHEN o_orderkey % 10 = 3 THEN 'queued' ELSE 'completed' END AS ss FROM orders)"""
SINGLE_SQL = "(" + ", ".join(f"'{k}'" for k in SINGLETON_KEYS) + ")"
PROFILE_SQL = f"""
cells AS (SELECT doc_id, bucket, field_key, count(*) AS n, sum(confidence) AS c FROM spec GROUP BY ALL),
prof AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS row_count, round_even(sum(c) / sum(n), 1) AS avg_confidence, CAST(sum(CASE WHEN field_key IN {SINGLE_SQL} THEN n - 1 ELSE 0 END) AS BIGINT) AS surplus,
  list(DISTINCT field_key) AS keys FROM cells GROUP BY 1),
gold AS (SELECT doc_id, field_key, list(CASE WHEN trim(date) <> '' THEN trim(date) ELSE trim(text) END ORDER BY row_seq) AS vals FROM spec GROUP BY 1, 2)"""


@query("ev3_evaluate_documents", f"""WITH {SPEC_SQL}, {STATES_SQL}, {PROFILE_SQL},
ex AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 + 1 AS mn, 40 + o_orderkey % 20 AS mc, CASE WHEN o_orderkey % 2 = 0 THEN 0 END AS mx, CASE o_orderkey % 3 WHEN 0 THEN ['project_name'] WHEN 1 THEN ['bid_deadline_date_time', 'project_owner'] ELSE [] END AS req FROM orders),
lab AS (SELECT o_orderkey AS doc_id, unnest(['project_owner', 'project_value']) AS field_key, unnest(['value 3', 'works']) AS needle FROM orders WHERE o_orderkey % 5 = 0),
wr AS (SELECT lab.doc_id, list('label:' || lab.field_key) AS wrong FROM lab LEFT JOIN gold ON gold.doc_id = lab.doc_id AND gold.field_key = lab.field_key WHERE len(list_filter(coalesce(vals, []), lambda v: contains(lower(v), needle))) = 0 GROUP BY 1),
j AS (SELECT ex.*, ps, ss, coalesce(row_count, 0) AS rc, avg_confidence AS ac, coalesce(surplus, 0) AS su, coalesce(keys, []) AS keys, coalesce(wrong, []) AS wrong FROM ex JOIN st USING (doc_id) LEFT JOIN prof USING (doc_id) LEFT JOIN wr USING (doc_id)),
i AS (SELECT doc_id, rc, ac, list_filter([CASE WHEN ps IS DISTINCT FROM 'completed' THEN 'pipeline_status=' || coalesce(ps, '') END, CASE WHEN ss IS DISTINCT FROM 'completed' THEN 'summary_status=' || ss END], lambda x: x IS NOT NULL) AS state,
  list_concat(list_filter([CASE WHEN rc < mn THEN 'row_count' END, CASE WHEN ac < mc THEN 'avg_confidence' END, CASE WHEN su > mx THEN 'singleton_duplicates' END], lambda x: x IS NOT NULL), list_transform(list_filter(req, lambda k: NOT list_contains(keys, k)), lambda k: 'missing:' || k), wrong) AS live FROM j)
SELECT doc_id, len(state) = 0 AND len(live) = 0 AS passed, CASE WHEN len(state) = 0 THEN rc ELSE 0 END AS row_count, CASE WHEN len(state) = 0 THEN ac END AS avg_confidence, array_to_string(list_sort(CASE WHEN len(state) = 0 THEN live ELSE state END), '|') AS issues FROM i""")
def _(t):
    k = F.col("o_orderkey")
    expect = t.orders.select(
        k.alias("doc_id"), (k % 6 + 1).alias("min_row_count"), (40 + k % 20).alias("min_avg_confidence"), F.when(k % 2 == 0, 0).alias("max_singleton_duplicates"),
        F.when(k % 3 == 0, F.array(F.lit("project_name"))).when(k % 3 == 1, F.array(F.lit("bid_deadline_date_time"), F.lit("project_owner"))).otherwise(F.array().cast("array<string>")).alias("required_field_keys"),
    )
    wanted = F.array(F.struct(F.lit("project_owner").alias("field_key"), F.array(F.lit("Value 3")).alias("needles")), F.struct(F.lit("project_value").alias("field_key"), F.array(F.lit("works")).alias("needles")))
    labels = t.orders.where(k % 5 == 0).select(k.alias("doc_id"), F.explode(wanted).alias("w")).select("doc_id", "w.*")
    return AU.evaluate_documents(states(t), spec(t), expect, labels).withColumn("issues", F.array_join("issues", "|"))


@query("ev6_bootstrap_expectations", f"""WITH {SPEC_SQL}, {STATES_SQL}, {PROFILE_SQL},
w AS (SELECT doc_id, field_key, trim(regexp_replace(vals[1], '(?i)^(project name|project owner|bid deadline|project solicitation number):\\s*', '')) AS v FROM gold WHERE field_key IN ({", ".join(f"'{k}'" for k in AU.LABEL_KEYS)})),
l AS (SELECT doc_id, string_agg(field_key || '=' || v, '|' ORDER BY field_key) AS labels FROM w GROUP BY 1)
SELECT st.doc_id, ps IS NOT DISTINCT FROM 'completed' AS enabled, CASE WHEN ps = 'completed' THEN greatest(8, coalesce(row_count, 0) - 4) END AS min_row_count,
  CASE WHEN ps = 'completed' THEN greatest(55, CAST(trunc(coalesce(avg_confidence, 0) - 15) AS BIGINT)) END AS min_avg_confidence, CASE WHEN ps = 'completed' THEN labels END AS labels
FROM st LEFT JOIN prof USING (doc_id) LEFT JOIN l USING (doc_id)""")
def _(t):
    e = AU.bootstrap_expectations(states(t), spec(t), limit=4)
    shown = F.array_join(F.transform("labels", lambda l: F.concat(l["field_key"], F.lit("="), F.array_join(l["needles"], "+"))), "|")
    return e.select("doc_id", "enabled", "min_row_count", "min_avg_confidence", shown.alias("labels"))


@query("ev11_baseline_by_type", """WITH i AS (SELECT l_returnflag AS et, CASE WHEN l_quantity < 10 THEN 0 ELSE l_linenumber END AS n, l_suppkey AS p, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_partkey % 100 END AS c FROM lineitem)
SELECT coalesce(et, '*') AS extraction_type, CAST(sum(n) AS BIGINT) AS items_total, count(*) FILTER (n = 0) AS empty_docs, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens,
  CAST(coalesce(sum(p + c) FILTER (n = 0), 0) AS BIGINT) AS empty_tokens FROM i GROUP BY ROLLUP (et)""")
def _(t):
    i = t.lineitem.select(
        F.col("l_returnflag").alias("extraction_type"), F.when(F.col("l_quantity") < 10, F.lit(None)).otherwise(F.col("l_linenumber")).alias("n_items"), F.col("l_suppkey").alias("prompt_tokens"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 100).alias("completion_tokens"),
    )
    return AU.baseline_by_type(i)


@query("ev11_baseline_totals", f"""WITH {SPEC_SQL}, r AS (SELECT count(*) AS doc_count, round(sum(o_orderkey % 90), 2) AS elapsed_seconds, round(avg(CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 8) / 8 END), 4) AS parsing_quality, CAST(sum(o_custkey) AS BIGINT) AS summary_tokens FROM orders),
s AS (SELECT count(*) FILTER (citation_verified) AS v, count(*) AS n FROM spec)
SELECT doc_count, CAST(elapsed_seconds AS DOUBLE) AS elapsed_seconds, parsing_quality, summary_tokens, v AS verified_sources, n AS total_sources, printf('%.1f%%', 100.0 * v / n) AS verified_pct FROM r, s""")
def _(t):
    k = F.col("o_orderkey")
    r = t.orders.select((k % 90).cast("double").alias("elapsed_seconds"), F.when(k % 7 != 0, (k % 8) / 8).alias("parsing_quality_score"), F.col("o_custkey").alias("summary_tokens"))
    return AU.baseline_totals(r, spec(t))


AUDIT_SQL = SPEC_SQL + """,
av AS (SELECT *, CASE WHEN bucket = 'project_dates' AND date <> '' THEN date WHEN bucket = 'bond_items' AND date <> '' THEN text || ' | ' || date ELSE text END AS val FROM spec),
atk AS (SELECT *, list_distinct(regexp_extract_all(lower(val), '[a-z0-9]{3,}')[1:8]) AS a, list_distinct(regexp_extract_all(lower(source_text), '[a-z0-9]{3,}')[1:20]) AS b FROM av),
au AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS su FROM atk),
af AS (SELECT *, list_filter([CASE WHEN confidence >= 70 AND NOT citation_verified THEN 'high_conf_unverified' END, CASE WHEN confidence < 50 THEN 'low_confidence' END, CASE WHEN calculated THEN 'calculated' END,
  CASE WHEN su < 0.15 AND NOT calculated THEN 'weak_source_support' END, CASE WHEN citation_verified AND su >= 0.3 THEN 'grounded' END], lambda x: x IS NOT NULL) AS flags FROM au)"""


@query("ev12_audit_fields", f"WITH {AUDIT_SQL} SELECT doc_id, row_seq, val AS value, round_even(su, 2) AS source_support, array_to_string(flags, '|') AS flags FROM af")
def _(t):
    return AU.audit_fields(spec(t), 8, 20).select("doc_id", "row_seq", "value", "source_support", F.array_join("flags", "|").alias("flags"))


@query("ev12_audit_documents", f"""WITH {AUDIT_SQL} SELECT doc_id, count(*) AS row_count, round_even(avg(confidence), 1) AS avg_confidence, min(confidence) AS min_confidence, max(confidence) AS max_confidence, round_even(count(*) FILTER (citation_verified) / count(*), 2) AS verified_rate,
  count(*) FILTER (list_contains(flags, 'high_conf_unverified') OR list_contains(flags, 'weak_source_support')) AS suspicious, coalesce(string_agg(DISTINCT field_key, '|' ORDER BY field_key) FILTER (bucket = 'project_dates'), '') AS date_keys,
  array_to_string(list_filter(['bid_deadline_date_time', 'project_name', 'project_owner'], lambda k: NOT list_contains(list(field_key), k)), '|') AS missing_core FROM af GROUP BY 1""")
def _(t):
    d = AU.audit_documents(AU.audit_fields(spec(t), 8, 20))
    return d.withColumns({"date_keys": F.array_join("date_keys", "|"), "missing_core": F.array_join("missing_core", "|")})


@query("ev13_sanity_issues", f"""WITH {SPEC_SQL}, {STATES_SQL}, g AS (SELECT doc_id, count(*) FILTER (bucket = 'project_metadata_items') AS me, count(*) FILTER (bucket = 'project_dates') AS da, count(*) FILTER (bucket = 'project_size_location_items') AS si, count(*) FILTER (bucket = 'bond_items') AS bo,
  count(*) FILTER (bucket = 'project_metadata_items' AND starts_with(lower(text), 'project name:')) AS na, count(*) FILTER (bucket = 'project_metadata_items' AND starts_with(lower(text), 'project solicitation number:')) AS nu,
  count(*) FILTER (bucket = 'project_dates' AND lower(text) = 'bid deadline' AND date <> '') AS bd, count(*) FILTER (bucket = 'project_dates' AND lower(text) = 'question deadline' AND date <> '') AS qd, count(*) FILTER (citation_verified) AS ve, count(*) AS n FROM spec GROUP BY 1),
j AS (SELECT st.*, g.* EXCLUDE (doc_id), ps IS NOT DISTINCT FROM 'completed' AND ss = 'completed' AS ok FROM st LEFT JOIN g ON g.doc_id = st.doc_id)
SELECT doc_id, 'error' AS level, 'pipeline_status=' || coalesce(ps, '') || ' summary_status=' || ss AS message FROM j WHERE NOT ok
UNION ALL SELECT doc_id, 'error', 'missing spec_check_fields' FROM j WHERE ok AND n IS NULL
UNION ALL SELECT doc_id, 'warn', 'no project_metadata_items' FROM j WHERE ok AND me = 0 UNION ALL SELECT doc_id, 'warn', 'no project_dates' FROM j WHERE ok AND da = 0
UNION ALL SELECT doc_id, 'warn', 'no project_size_location_items' FROM j WHERE ok AND si = 0 UNION ALL SELECT doc_id, 'warn', 'multiple project_name entries (' || na || ')' FROM j WHERE ok AND na > 1
UNION ALL SELECT doc_id, 'info', 'multiple solicitation numbers (' || nu || ')' FROM j WHERE ok AND nu > 1 UNION ALL SELECT doc_id, 'warn', 'missing Bid deadline' FROM j WHERE ok AND bd = 0
UNION ALL SELECT doc_id, 'info', 'missing Question deadline' FROM j WHERE ok AND qd = 0 UNION ALL SELECT doc_id, 'warn', 'no bond_items' FROM j WHERE ok AND bo = 0
UNION ALL SELECT doc_id, 'warn', 'low citation_verified rate (' || ve || '/' || n || ')' FROM j WHERE ok AND ve < 0.9 * n""")
def _(t):
    return AU.sanity_issues(states(t), spec(t))


def deadline_rows(t):
    """Field rows as a deadline list has them: with labels, requirements, dates or quotes left out in turn."""
    k = F.col("row_seq") % 7
    s = spec(t)
    label = F.split("text", ":")[0]
    return s.select(
        "doc_id", "row_seq", F.when(k == 5, "").otherwise(label).alias("text"), F.when(k.isin(1, 5), F.concat(label, F.lit(": "), "source_text")).when(k == 2, "on request").alias("requirement"),
        F.when(k.isin(0, 3), F.col("date")).alias("date"), F.when(k == 3, F.lit("2026-03-11")).alias("date_time"), F.when(k == 4, "noon").alias("value"),
        F.when(k == 6, F.concat(F.lit("The "), F.upper(label), F.lit(" – "), "source_text")).otherwise("").alias("source_text"),
    )


@query("fd31_deadline_display", rf"""WITH {SPEC_SQL}, r AS (SELECT doc_id, row_seq, row_seq % 7 AS k, string_split(text, ':')[1] AS lb, date, source_text AS st FROM spec)
SELECT doc_id, row_seq, CASE WHEN lb = 'Pre-bid conference' THEN lb ELSE lb END AS display_label,
  CASE WHEN k IN (0, 3) AND date <> '' THEN strftime(CAST(substr(date, 1, 10) AS DATE), '%B %-d, %Y') || ', 10:00 AM' WHEN k = 3 THEN 'March 11, 2026' WHEN k IN (1, 5) THEN st WHEN k = 2 THEN 'on request' WHEN k = 4 THEN 'noon' WHEN k = 6 THEN st END AS display_value FROM r""")
def _(t):
    return AU.deadline_display(deadline_rows(t)).select("doc_id", "row_seq", "display_label", "display_value")


_TYPES = [x for _, ts in AU.INSIGHT_GROUPS for x in ts] + ["set_asides"]


@query("fd32_insight_groups", f"""WITH i AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_suppkey, [{", ".join(repr(x) for x in _TYPES)}][CAST(l_partkey % 9 + 1 AS INTEGER)] AS extraction_type, l_discount * 10 AS confidence, CAST(l_quantity AS BIGINT) AS n FROM lineitem)
SELECT doc_id, l_linenumber, l_partkey, l_suppkey, extraction_type, CASE l_partkey % 9 WHEN 0 THEN 'Qualification & evaluation' WHEN 1 THEN 'Qualification & evaluation' WHEN 2 THEN 'Commercial & risk' WHEN 3 THEN 'Commercial & risk' WHEN 4 THEN 'Technical & delivery' WHEN 5 THEN 'Technical & delivery' WHEN 8 THEN 'Other' ELSE 'Submission package' END AS group_label,
  CASE WHEN l_partkey % 9 = 8 THEN 99 ELSE l_partkey % 9 END AS place, CASE WHEN confidence * 100 >= 85 THEN 'strong' WHEN confidence * 100 >= 70 THEN 'moderate' ELSE 'weak' END AS tone, n > 12 AS is_large FROM i""")
def _(t):
    kinds = F.array(*[F.lit(x) for x in _TYPES])
    i = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", F.element_at(kinds, (F.col("l_partkey") % 9 + 1).cast("int")).alias("extraction_type"),
                          (F.col("l_discount") * 10).alias("confidence"), F.col("l_quantity").cast("bigint").alias("n_items"))
    return AU.insight_groups(i).drop("confidence", "n_items")
