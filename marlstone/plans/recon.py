"""Queries of reconciliation, mapping and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.fuzzy import fuzzy_score, ratio
from ..operators import mapping as M
from ..operators import recon as R
from ..sources import facts as S
from .registry import query, table

# Both sides of the reconciliation by order: some extracted figures are in thousands or millions, some keys are missing on a side.
SIDES = """
x AS (SELECT l_orderkey AS okey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY l_orderkey),
p AS (SELECT okey, CASE okey % 5 WHEN 0 THEN v / 1000 WHEN 1 THEN v / 1000000 ELSE v END AS pdf_value FROM x),
q AS (SELECT o_orderkey AS okey, o_totalprice AS xbrl_value FROM orders WHERE o_orderkey % 11 <> 3),
b AS (SELECT okey, pdf_value, xbrl_value FROM p FULL JOIN q USING (okey))"""
_SCALE_SQL = """
o(ord, pf, xf, f, r) AS (VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 'no_scaling'), (1, 1e3, 1.0, 1e3, 'thousands_to_actual'), (2, 1e6, 1.0, 1e6, 'millions_to_actual'), (3, 1e9, 1.0, 1e9, 'billions_to_actual'),
  (4, 1.0, 1e3, 0.001, 'actual_to_thousands'), (5, 1.0, 1e6, 0.000001, 'actual_to_millions'), (6, 1.0, 1e9, 0.000000001, 'actual_to_billions')),
c AS (SELECT okey, ord, f, r, pdf_value * pf AS a, xbrl_value * xf AS b, abs(pdf_value * pf - xbrl_value * xf) / abs(CASE WHEN ord < 4 THEN xbrl_value ELSE pdf_value END) AS diff
      FROM b, o WHERE pdf_value <> 0 AND xbrl_value <> 0),
u AS (SELECT okey, min(diff) AS du FROM c WHERE ord < 4 AND diff < 0.5 GROUP BY okey),
n AS (SELECT c.*, row_number() OVER (PARTITION BY okey ORDER BY diff, ord) AS k FROM c LEFT JOIN u USING (okey) WHERE diff < 0.5 AND (ord < 4 OR du IS NULL OR du > 0.3)),
s AS (SELECT b.okey, b.pdf_value, b.xbrl_value, coalesce(n.a, b.pdf_value) AS a, coalesce(n.b, b.xbrl_value) AS b, coalesce(n.f, 1.0) AS f,
        coalesce(n.r, CASE WHEN b.pdf_value = 0 OR b.xbrl_value = 0 THEN 'zero_value' ELSE 'no_scaling_detected' END) AS r
      FROM b LEFT JOIN n ON n.okey = b.okey AND n.k = 1),
d AS (SELECT *, abs(a - b) / abs(b) AS diff FROM s),
e AS (SELECT okey, pdf_value, xbrl_value, f, r, diff, CASE WHEN pdf_value IS NULL OR xbrl_value IS NULL THEN 'missing_value' WHEN a = b THEN 'exact_match' WHEN diff <= 0.005 THEN 'rounding_match'
        WHEN diff <= 0.01 THEN 'tolerance_match' WHEN diff <= 0.25 THEN 'loose_match' ELSE 'value_mismatch' END AS reason,
        CASE WHEN a = b THEN 1.0 WHEN diff <= 0.01 THEN 1.0 - diff / 0.01 * 0.3 ELSE greatest(0.0, 0.7 - diff / 0.15 * 0.7) END AS trust FROM d),
z AS (SELECT *, CASE WHEN xbrl_value IS NULL THEN 'pdf_only' WHEN pdf_value IS NULL THEN 'xbrl_only'
        WHEN reason IN ('exact_match', 'rounding_match', 'tolerance_match') OR (reason = 'loose_match' AND f <> 1.0) THEN 'match' ELSE 'discrepancy' END AS status FROM e)"""


def _sides(spark, d):
    li = table(spark, d, "lineitem")
    v = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")))
    x = li.groupBy(F.col("l_orderkey").alias("okey")).agg(v.alias("v"))
    scaled = F.when(F.col("okey") % 5 == 0, F.col("v") / 1000).when(F.col("okey") % 5 == 1, F.col("v") / 1000000).otherwise(F.col("v"))
    o = table(spark, d, "orders").where("o_orderkey % 11 <> 3").select(F.col("o_orderkey").alias("okey"), F.col("o_totalprice").alias("xbrl_value"))
    return x.select("okey", scaled.alias("pdf_value")), o


def _recon(spark, d):
    return R.reconcile_keys(*_sides(spark, d), "okey")


@query("flagship_reconcile", f"""WITH {SIDES}, {_SCALE_SQL}
SELECT status, reason, CASE WHEN pdf_value IS NOT NULL AND xbrl_value IS NOT NULL THEN r END AS scale_reason, count(*) AS n, round(avg(diff), 6) AS avg_relative_difference,
  round(sum(CASE WHEN status = 'match' THEN 1 ELSE 0 END) / greatest(1, sum(CASE WHEN status IN ('match', 'discrepancy') THEN 1 ELSE 0 END))::DOUBLE, 6) AS match_rate
FROM z GROUP BY ALL""")
def flagship(spark, d):
    r = _recon(spark, d)
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return r.groupBy("status", "reason", "scale_reason").agg(F.count("*").alias("n"), F.round(F.avg("relative_difference"), 6).alias("avg_relative_difference"), F.round(n("match") / F.greatest(F.lit(1), n("match", "discrepancy")), 6).alias("match_rate"))


@query("j01_f21_f22_recon_rows", f"""WITH {SIDES}, {_SCALE_SQL}
SELECT okey, status, reason, CASE WHEN reason <> 'missing_value' THEN f END AS factor, CASE WHEN reason <> 'missing_value' THEN round(trust, 5) ELSE 0.0 END AS confidence FROM z""")
def recon_rows(spark, d):
    return _recon(spark, d).select("okey", "status", "reason", F.col("scale_factor").alias("factor"), F.round("confidence", 5).alias("confidence"))


@query("a05_recon_summary", f"""WITH {SIDES}, {_SCALE_SQL}
SELECT count(*) FILTER (status = 'match') AS total_matches, count(*) FILTER (status = 'discrepancy') AS total_discrepancies, count(*) FILTER (status = 'pdf_only') AS pdf_only_count,
  count(*) FILTER (status = 'xbrl_only') AS xbrl_only_count, round(count(*) FILTER (status = 'match') / greatest(1, count(*) FILTER (status IN ('match', 'discrepancy')))::DOUBLE, 6) AS match_rate,
  1 - count(*) FILTER (status = 'match') / greatest(1, count(*) FILTER (status IN ('match', 'discrepancy')))::DOUBLE > 0.15 AS alert FROM z""")
def recon_summary(spark, d):
    s = R.summary(_recon(spark, d))
    return s.withColumn("alert", R.mismatch_alert(F.col("match_rate"))).withColumn("match_rate", F.round("match_rate", 6))


@query("a06_f24_causes", f"""WITH {SIDES}, {_SCALE_SQL}
SELECT c.cause, count(z.okey) AS n FROM (VALUES ('rounding_difference'), ('different_values'), ('sign_mismatch'), ('scaling_mismatch')) c(cause)
LEFT JOIN z ON z.status = 'discrepancy' AND c.cause = CASE WHEN z.reason = 'exact_match' THEN 'ok' WHEN z.reason IN ('tolerance_match', 'rounding_match') THEN 'rounding_difference' ELSE 'different_values' END GROUP BY c.cause""")
def causes(spark, d):
    return R.cause_histogram(_recon(spark, d))


@query("j03_pdf_only", f"WITH {SIDES} SELECT p.okey FROM p WHERE p.okey NOT IN (SELECT okey FROM q)")
def pdf_only(spark, d):
    p, q = _sides(spark, d)
    return p.join(q, "okey", "left_anti").select("okey")


@query("j04_u05_xbrl_only", f"WITH {SIDES} SELECT q.okey FROM q WHERE q.okey NOT IN (SELECT okey FROM p)")
def xbrl_only(spark, d):
    p, q = _sides(spark, d)
    return q.join(p, "okey", "left_anti").select("okey")


PAIR = "c_custkey, c_acctbal AS a, CASE c_custkey % 6 WHEN 0 THEN c_acctbal WHEN 1 THEN c_acctbal * 1000 WHEN 2 THEN c_acctbal / 1e6 WHEN 3 THEN -c_acctbal WHEN 4 THEN c_acctbal * 1.3 ELSE 0 END AS b"


def _same(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = 0 AND {b} = 0 THEN true WHEN {a} = 0 OR {b} = 0 THEN false ELSE abs({a} - {b}) / greatest(1e-12, abs({a}), abs({b})) <= 0.01 END)"


_SIMPLE_SQL = f"CASE WHEN {_same('a', 'b')} THEN 'ok' WHEN " + " OR ".join(f"{_same(f'a * {s}', 'b')} OR {_same('a', f'b * {s}')}" for s in ("1e3", "1e6", "1e9")) + f" THEN 'scaling_mismatch' WHEN {_same('abs(a)', 'abs(b)')} AND a * b < 0 THEN 'sign_mismatch' WHEN abs(a - b) / greatest(1e-12, abs(a), abs(b)) <= 0.005 THEN 'rounding_difference' ELSE 'different_values' END"


@query("f23_f29_simple_compare", f"SELECT c_custkey, {_SIMPLE_SQL} AS cause, round(abs(a - b) / greatest(1e-12, abs(a), abs(b)), 6) AS diff FROM (SELECT {PAIR} FROM customer)")
def simple_compare(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", *[x.strip() for x in PAIR.split(", ", 1)[1].split(", ", 1)])
    a, b = F.col("a"), F.col("b").cast("double")
    return c.select("c_custkey", V.simple_compare(a, b)["cause"].alias("cause"), F.round(V.relative_difference(a, b), 6).alias("diff"))


@query("p10_skip_comparison", f"""SELECT c_custkey, a = 0 OR b = 0 OR (concept IN ('Revenue', 'Total Assets', 'Cash and Cash Equivalents', 'Stockholders Equity') AND a * b < 0) OR r > m OR r < 1 / m AS skip
FROM (SELECT *, abs(b / a) AS r, CASE WHEN concept IN ('Operating Income', 'Net Income') THEN 1e7 ELSE 1e6 END AS m FROM (SELECT {PAIR}, CASE c_custkey % 4 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Net Income' ELSE 'Total Liabilities' END AS concept FROM customer))""")
def skip(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", *[x.strip() for x in PAIR.split(", ", 1)[1].split(", ", 1)], "CASE c_custkey % 4 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'Net Income' ELSE 'Total Liabilities' END AS concept")
    return c.select("c_custkey", V.skip_comparison(F.col("a"), F.col("b").cast("double"), F.col("concept")).alias("skip"))


# Wide facts: one row per customer group and segment, one column per year end.
def _wide(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy((F.col("c_custkey") % 40).alias("row_id"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("label"))
    year = F.year("o_orderdate")
    cents = lambda y: F.sum(F.when(year % 3 == y, F.round(F.col("o_totalprice") * 100).cast("long")))
    return g.agg(*[cents(k).alias(n) for k, n in enumerate(("2022-01-30", "2023-01-29", "2024-01-28"))], F.count("*").alias("n")).withColumn("row_id", F.col("row_id") * 100 + F.ascii(F.trim("label")))


_WIDE_SQL = """w AS (SELECT c_custkey % 40 * 100 + ascii(c_mktsegment) AS row_id, trim(c_mktsegment) AS concept, CASE year(o_orderdate) % 3 WHEN 0 THEN '2022-01-30' WHEN 1 THEN '2023-01-29' ELSE '2024-01-28' END AS period,
  sum(round(o_totalprice * 100)::BIGINT)::DOUBLE AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


@query("s06_facts_unpivot", f"WITH {_WIDE_SQL} SELECT row_id, concept, period, value FROM w")
def facts(spark, d):
    f = S.unpivot(_wide(spark, d), "label").where("value IS NOT NULL")
    return f.select("row_id", F.trim("concept").alias("concept"), "period", "value")


@query("s07_catalog", "SELECT DISTINCT trim(c_mktsegment) AS concept FROM customer JOIN orders ON o_custkey = c_custkey")
def catalog(spark, d):
    return S.catalog(S.unpivot(_wide(spark, d), "label"))


TERMS = [("Vehicles", ["automobile"]), ("House", ["household", "furniture"]), ("Build", ["building", "build"]), ("Machines", ["machine"])]


@query("a22_metric_pick", f"""WITH {_WIDE_SQL}, t(metric, term, k) AS (VALUES ('Vehicles', 'automobile', 0), ('House', 'household', 0), ('House', 'furniture', 1), ('Build', 'building', 0), ('Build', 'build', 1), ('Machines', 'machine', 0)),
h AS (SELECT metric, period, row_id, max(lower(concept) = term) AS exact, max(lower(concept) = term AND k = 0) AS stop, any_value(value) AS value FROM w JOIN t ON contains(lower(concept), term) GROUP BY ALL),
l AS (SELECT *, coalesce(sum(stop::INT) OVER (PARTITION BY metric, period ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, period ORDER BY exact DESC, CASE WHEN exact THEN -row_id ELSE row_id END) AS n FROM l WHERE st = 0)
SELECT metric, period, value FROM r WHERE n = 1""")
def metric_pick(spark, d):
    return S.pick_metrics(S.unpivot(_wide(spark, d), "label"), TERMS)


@query("d10_a22_wide_metrics", f"""WITH {_WIDE_SQL} SELECT period, max(value) FILTER (concept = 'BUILDING' AND row_id = m) AS "Build" FROM (SELECT *, min(CASE WHEN concept = 'BUILDING' THEN row_id END) OVER (PARTITION BY period) AS m FROM w) GROUP BY period""")
def wide_metrics(spark, d):
    return S.wide_metrics(S.pick_metrics(S.unpivot(_wide(spark, d), "label"), [("Build", ["building"])]), [("Build", ["building"])])


def _series(spark, d):
    """Extracted and official series by segment (concept) and header (period)."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    header = F.expr("CASE year(o_orderdate) % 4 WHEN 0 THEN '2024-01-28' WHEN 1 THEN 'Year Ended.1' WHEN 2 THEN 'prior year' ELSE 'Graphics' END")
    pdf = o.groupBy(F.col("o_orderstatus").alias("statement_type"), F.when(F.col("c_mktsegment") == "MACHINERY", "Other").otherwise(F.col("c_mktsegment")).alias("concept"), header.alias("period")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("value"))
    official = S.unpivot(_wide(spark, d), "label").groupBy(F.trim("concept").alias("concept"), "period").agg((F.sum("value") / 100.0).alias("value"))
    return pdf, official


@query("j02_period_alignment", """
WITH s AS (SELECT DISTINCT o_orderstatus AS statement_type, c_mktsegment AS concept, CASE year(o_orderdate) % 4 WHEN 0 THEN '2024-01-28' WHEN 1 THEN 'Year Ended.1' WHEN 2 THEN 'prior year' ELSE 'Graphics' END AS period
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY')
SELECT statement_type, concept, period, CASE WHEN period = '2024-01-28' THEN period ELSE '2023-01-29' END AS xbrl_period, CASE WHEN period = '2024-01-28' THEN 'exact' ELSE 'hint' END AS alignment_kind FROM s WHERE period <> 'Graphics'""")
def alignment(spark, d):
    pdf, official = _series(spark, d)
    from pyspark.sql import Window

    x = official.select("concept", F.col("period").alias("xbrl_period"), F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("period"))).alias("xord"))
    return R.align_periods(pdf.join(x, "concept"), ["statement_type", "concept"], fuzzy=False).select("statement_type", "concept", "period", "xbrl_period", "alignment_kind")


@query("j01_q38_series_recon")
def series(spark, d):
    pdf, official = _series(spark, d)
    return R.reconcile(pdf, official)


@query("p11_a24_comparable", """
WITH o AS (SELECT o_orderstatus AS statement_type, c_mktsegment AS concept, CASE year(o_orderdate) % 4 WHEN 0 THEN '2024-01-28' WHEN 1 THEN 'Year Ended.1' WHEN 2 THEN 'prior year' ELSE 'Graphics' END AS period, year(o_orderdate) % 3 AS y, round(o_totalprice * 100)::BIGINT AS v
  FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT statement_type, concept, median(value) AS pm FROM (SELECT statement_type, concept, period, sum(v) / 100.0 AS value FROM o GROUP BY ALL) GROUP BY ALL),
b AS (SELECT concept, median(value) AS xm FROM (SELECT concept, y, sum(v) / 100.0 AS value FROM o GROUP BY ALL) GROUP BY ALL)
SELECT statement_type, concept, NOT (greatest(pm, xm) / least(pm, xm) > 1e7) AS ok FROM a JOIN b USING (concept) WHERE concept <> 'MACHINERY'""")
def comparable(spark, d):
    return R.comparable(*_series(spark, d))


@query("a26_series_resolution", """
WITH g AS (SELECT o_custkey % 50 AS c, o_orderstatus AS s, o_custkey % 3 AS ord, o_orderpriority AS p, sum(round(o_totalprice * 100)::BIGINT) AS v FROM orders GROUP BY ALL),
m AS (SELECT c, s, ord, count(*) AS n, sum(v)::DOUBLE AS t FROM g GROUP BY ALL),
r AS (SELECT c, s, list(struct_pack(ord := ord, n := n, t := t) ORDER BY ord) AS l FROM m GROUP BY ALL)
SELECT s AS statement_type, c::VARCHAR AS concept, list_reduce(l, lambda h, x: CASE WHEN x.n > h.n OR x.t > h.t THEN x ELSE h END).ord AS ord FROM r""")
def resolution(spark, d):
    g = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).cast("string").alias("concept"), F.col("o_orderstatus").alias("statement_type"), (F.col("o_custkey") % 3).alias("ord"), "o_orderpriority").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("v"))
    items = g.groupBy("statement_type", "concept", "ord").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "v"))).alias("periods"))
    return R.resolve_series(items).select("statement_type", "concept", "ord")


LABEL = "CASE p_size % 10 WHEN 0 THEN 'Net revenue (a)' WHEN 1 THEN 'Total assets' WHEN 2 THEN 'Net incom' WHEN 3 THEN concat('Cash ', p_brand) WHEN 4 THEN 'Operating activities, net' WHEN 5 THEN 'Cost of sales' WHEN 6 THEN '1. Revenue' WHEN 7 THEN p_name WHEN 8 THEN 'Total stockholders equity' ELSE p_type END"


def _labels(spark, d):
    return table(spark, d, "part").select(F.expr(LABEL).alias("label"), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'income_statement' WHEN 1 THEN 'balance_sheet' ELSE 'cash_flow' END").alias("statement_type")).distinct()


@query("j05_direct_mapping")
def direct(spark, d):
    return M.direct(_labels(spark, d))


@query("j06_context_mapping")
def context(spark, d):
    return M.in_context(_labels(spark, d))


@query("j07_f11_auto_map")
def auto_map(spark, d):
    return M.auto_map(_labels(spark, d), ["Inventory, net", "Goodwill", "Gross Profit"])


@query("j08_map_or_keep")
def map_or_keep(spark, d):
    return M.map_or_keep(_labels(spark, d))


@query("a08_automap_coverage")
def coverage(spark, d):
    return M.coverage(M.auto_map(_labels(spark, d)))


@query("f09_f10_fuzzy_scores")
def fuzzy(spark, d):
    pairs = _labels(spark, d).select("label").distinct().join(M.dictionary(_labels(spark, d)), F.lit(True))
    return pairs.select("label", "pdf_key", F.round(fuzzy_score("label", "pdf_key"), 6).alias("score"), F.round(ratio(F.lower("label"), F.lower("pdf_key")), 6).alias("ratio"))


@query("p09_candidate_labels", "SELECT DISTINCT trim(p_name) AS label FROM part WHERE length(trim(p_name)) BETWEEN 1 AND 200 AND lower(trim(p_name)) NOT IN ('nan', 'none', '')")
def candidates(spark, d):
    p = table(spark, d, "part")
    return M.candidate_labels(p.select(F.lit(0).alias("col_idx"), F.concat(F.lit(" "), F.col("p_name"), F.lit("\n")).alias("value")))


@query("a25_batch_summary", f"""WITH {SIDES}, {_SCALE_SQL} SELECT okey % 7 AS filing, count(*) FILTER (status = 'match') AS matches, count(*) FILTER (status = 'discrepancy') AS discrepancies FROM z GROUP BY 1""")
def batch(spark, d):
    r = _recon(spark, d)
    return r.groupBy((F.col("okey") % 7).alias("filing")).agg(F.count_if(F.col("status") == "match").alias("matches"), F.count_if(F.col("status") == "discrepancy").alias("discrepancies"))
