"""Queries of comparisons, result files, reports of metrics and page analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config.methods import ADVANTAGES, PROFILES
from ..operators import comparison as C
from ..operators import layout as L
from ..operators import methods as X
from ..sinks import results as R
from ..sources import files as S
from .documents import _PAGES, _blocks, _rounded
from .layouts import _BOUNDS, _METRICS, _WORDS, _metrics, _words
from .recon import _SCALE_SQL, SIDES, _labels, _recon
from .registry import query, table

_METHOD_LIST = "(VALUES " + ", ".join(f"({k}, '{m}')" for k, m in enumerate(PROFILES)) + ") t(k, method)"

# What three methods made of each document; some have no time, one lacks now and then.
_FOUND = f"""f AS (SELECT doc_id, k, method, doc_id % 5 + k AS text_files, length(coalesce(text, '')) * (k + 1) AS chars, (doc_id + k) % 4 AS csv_files, doc_id % 2 = 0 AS box_folder, ((doc_id * (k + 2)) % 50)::DOUBLE AS seconds, (doc_id + k) % 3 AS pages
  FROM documents, {_METHOD_LIST} WHERE (doc_id + k) % 6 <> 1),
r AS (SELECT *, k = 1 OR box_folder AS boxes, k = 2 AS ordered, seconds / greatest(pages, 1) AS per_page, [2, 4, 4][k + 1] AS formats, [3, 4, 5][k + 1] AS special FROM f),
q AS (SELECT *, least((chars > 0)::INT * 10 + ordered::INT * 10 + (k > 0)::INT * 10 + least(csv_files * 5, 15) + 10 + boxes::INT * 5 + ordered::INT * 20 + (formats + special) * 2, 100) AS score FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS qp, CASE WHEN per_page > 0 THEN row_number() OVER (PARTITION BY doc_id, per_page > 0 ORDER BY per_page, k) END AS sp FROM q)"""


def _found(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    each = docs.select("doc_id", "n", F.posexplode(F.array(*map(F.lit, PROFILES))).alias("k", "method")).where("(doc_id + k) % 6 <> 1")
    return each.selectExpr("doc_id", "method", "doc_id % 5 + k AS text_files", "cast(n * (k + 1) AS bigint) AS chars", "(doc_id + k) % 4 AS csv_files", "doc_id % 2 = 0 AS box_folder", "cast(doc_id * (k + 2) % 50 AS double) AS seconds", "(doc_id + k) % 3 AS pages")


@query("k14_comparison_rows", f"WITH {_FOUND} SELECT method, doc_id AS pdf_name, text_files, chars AS total_characters, csv_files AS tables_found, seconds AS processing_time, pages AS pages_processed, boxes AS has_bounding_boxes, ordered AS has_reading_order, formats AS output_formats FROM p")
def comparison_rows(spark, d):
    return C.comparison_csv(C.method_rows(_found(spark, d)))


@query("k14_comparison_report", f"""WITH {_FOUND}, g AS (SELECT doc_id, string_agg(method, ', ' ORDER BY k) AS names, string_agg('  ' || qp || '. ' || method || ': ' || printf('%.1f', score::DOUBLE) || '/100', chr(10) ORDER BY qp) AS ql,
  string_agg('  ' || sp || '. ' || method || ': ' || printf('%.2f', per_page) || 's per page', chr(10) ORDER BY sp) FILTER (sp IS NOT NULL) AS sl, max(method) FILTER (sp = 1) AS fast, max(method) FILTER (qp = 1) AS good, max(k) AS top FROM p GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), 'PDF Extraction Methods Comparison Report', 'PDF: ' || doc_id, 'Analysis Date: 2024-01-01', repeat('=', 60), 'Methods Analyzed: ' || names, '', 'Quality Ranking:', ql, '', 'Speed Ranking (faster is better):' || chr(10) || sl || chr(10),
  'Recommendations:', '  Overall Best: ' || ['traditional', 'layout_parser', 'docling'][top + 1], '  Fastest: ' || fast, '  Most Accurate: ' || good) AS text FROM g""")
def comparison_report(spark, d):
    return C.comparison_report(C.method_rows(_found(spark, d)), F.lit("2024-01-01"))


@query("k14_comparison_json", f"""WITH {_FOUND} SELECT doc_id, string_agg(method, ',' ORDER BY k) AS methods, string_agg(method, ',' ORDER BY qp) AS ranking, max(method) FILTER (sp = 1) AS fastest, max(chars) FILTER (k = 2) AS docling_chars, max(formats) FILTER (k = 2) AS docling_formats FROM p GROUP BY doc_id""")
def comparison_json(spark, d):
    """The detailed comparison, read again."""
    metric = "struct<method:string,text_extraction:struct<chars:long>,unique_features:struct<formats:array<string>>>"
    j = F.from_json("json", f"struct<methods_analyzed:array<string>,overall_ranking:array<struct<method:string>>,recommendations:struct<best_for_speed:string>,extraction_metrics:array<{metric}>>")
    out = C.comparison_json(C.method_rows(_found(spark, d))).select("doc_id", j.alias("j"))
    docling = F.get(F.filter("j.extraction_metrics", lambda m: m["method"] == "docling"), F.lit(0))
    return out.select("doc_id", F.array_join("j.methods_analyzed", ",").alias("methods"), F.array_join(F.transform("j.overall_ranking", lambda m: m["method"]), ",").alias("ranking"), F.col("j.recommendations.best_for_speed").alias("fastest"), docling["text_extraction"]["chars"].alias("docling_chars"), F.when(docling.isNotNull(), F.size(docling["unique_features"]["formats"])).alias("docling_formats"))


@query("m16_method_profiles", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{p['organization']}', '{'; '.join(p['special'])}', '{'; '.join(p['strengths'])}', '{'; '.join(p['limitations'])}', {len(p['formats'])}::INT)" for m, p in PROFILES.items()) + ") t(method, organization, special, strengths, limitations, formats)")
def method_profiles(spark, d):
    return C.profiles(spark).select("method", "organization", *[F.array_join(c, "; ").alias(c) for c in ("special", "strengths", "limitations")], F.size("formats").alias("formats"))


@query("a34_docling_metrics", f"SELECT user_id AS doc_id, count(*) FILTER (event_id % 6 = 1) > 0 AS reading_order_preserved, count(*) FILTER (event_id % 6 = 2) AS tables_with_structure, count(*) FILTER (event_id % 6 = 5) AS formulas_detected, count(*) FILTER (event_id % 6 = 4) AS figures_extracted, true AS cross_page_continuity, {len(ADVANTAGES)}::INT AS advantages FROM events GROUP BY user_id")
def docling_metrics(spark, d):
    n = lambda k: F.count_if(F.col("event_id") % 6 == k)
    c = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(n(1).alias("reading_order_elements"), n(2).alias("tables"), n(5).alias("formulas"), n(4).alias("figures"))
    return C.docling_metrics(c).select("doc_id", "content_analysis.*", "structure_quality.cross_page_continuity", F.size("docling_advantages").alias("advantages"))


@query("s11_result_figures", """SELECT doc_id::VARCHAR AS folder, CASE WHEN doc_id % 4 = 3 THEN 0 WHEN doc_id % 4 = 2 THEN doc_id + 0.25 ELSE doc_id + 0.5 END::DOUBLE AS seconds, CASE WHEN doc_id % 4 = 3 THEN 0 ELSE doc_id % 9 END AS pages FROM documents""")
def result_figures(spark, d):
    """A folder has both kinds of file, one of them, or only files of other names or that aren't JSON."""
    docs = table(spark, d, "documents").select("doc_id")
    first = F.format_string('{"processing_time_seconds": %s, "total_pages": %d}', (F.col("doc_id") + 0.5).cast("string"), F.col("doc_id") % 9)
    second = F.format_string('{"extraction_summary": {"processing_time_seconds": %s}, "document_analysis": {"total_pages": %d}}', (F.col("doc_id") + 0.25).cast("string"), F.col("doc_id") % 9)
    f = lambda name, text: F.struct(F.lit(name).alias("file"), text.alias("text"))
    k = F.col("doc_id") % 4
    files = F.when(k < 2, F.array(f("docling_extraction_results.json", second), f("extraction_summary.json", first))).when(k == 2, F.array(f("docling_extraction_results.json", second))).otherwise(F.array(f("other.json", first), f("layout_parser_extraction_results.json", F.lit("{not json"))))
    return C.result_figures(docs.select(F.col("doc_id").cast("string").alias("folder"), F.explode(files).alias("f")).select("folder", "f.*"))


_OCR = "doc_id % 4 = 0"


@query("k11_combined_result", f"""WITH t AS (SELECT l_orderkey % 50 AS k, count(*) AS n, sum(l_linenumber)::BIGINT AS r FROM lineitem GROUP BY 1), p AS (SELECT doc_id % 60 AS k, count(*) AS pages, count(*) FILTER ({_OCR}) AS ocr, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY 1)
SELECT k::VARCHAR AS doc_id, pages AS total_pages, ocr AS pages_with_ocr, chars AS total_characters, coalesce(n, 0) AS tables_found, coalesce(r, 0) AS total_rows, (k + 0.5)::DOUBLE AS seconds FROM p LEFT JOIN t USING (k)""")
def combined_result(spark, d):
    """Result files of methods that keep texts and tables apart, read again."""
    docs = table(spark, d, "documents").withColumn("k", (F.col("doc_id") % 60).cast("string"))
    pages = docs.select(F.col("k").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.expr(_OCR).alias("used_ocr"), F.lit(True).alias("success"))
    tables = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), F.col("l_linenumber").alias("rows"))
    names = docs.select(F.col("k").alias("doc_id"), (F.col("k").cast("double") + 0.5).alias("seconds")).distinct()
    j = F.from_json("json", "struct<pdf_info:struct<processing_time_seconds:double>,text_extraction:struct<total_pages:long,pages_with_ocr:long,total_characters:long>,table_extraction:struct<tables_found:long,total_rows:long>>")
    return R.combined_result(names, pages, tables).select("doc_id", j.alias("j")).select("doc_id", "j.text_extraction.*", "j.table_extraction.*", F.col("j.pdf_info.processing_time_seconds").alias("seconds"))


@query("k11_layout_result", f"""WITH {_PAGES} SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (t = 'title') AS titles, count(DISTINCT coalesce(page, 1)) AS pages, string_agg(block_id, ',' ORDER BY coalesce(page, 1), ord) AS ids FROM u GROUP BY doc_id""")
def layout_result(spark, d):
    j = F.from_json("json", "struct<pages:array<struct<page_number:long,detected_blocks:array<struct<block_id:string>>>>,extraction_summary:struct<total_blocks:long,blocks_by_type:map<string,long>>>")
    out = R.layout_result(_blocks(spark, d)).select("doc_id", j.alias("j"))
    ids = F.flatten(F.transform("j.pages", lambda p: F.transform(p["detected_blocks"], lambda b: b["block_id"])))
    return out.select("doc_id", F.col("j.extraction_summary.total_blocks").alias("total_blocks"), F.try_element_at("j.extraction_summary.blocks_by_type", F.lit("title")).alias("titles"), F.size("j.pages").cast("long").alias("pages"), F.array_join(ids, ",").alias("ids"))


@query("k10_results_json", f"""WITH {SIDES}, {_SCALE_SQL}, fl AS (SELECT okey // 500 AS filing, count(*) FILTER (status = 'match') AS m, count(*) FILTER (status = 'discrepancy') AS d, count(*) FILTER (status = 'pdf_only') AS po, count(*) FILTER (status = 'xbrl_only') AS xo, string_agg(okey::VARCHAR, ',' ORDER BY okey) FILTER (status = 'match') AS ids FROM z GROUP BY 1)
SELECT filing, m AS total_matches, d AS total_discrepancies, po AS pdf_only_count, xo AS xbrl_only_count, round(m / greatest(1, m + d)::DOUBLE, 6) AS match_rate, coalesce(ids, '') AS matches FROM fl""")
def results_json(spark, d):
    r = _recon(spark, d).withColumn("filing", F.expr("okey div 500"))
    j = F.from_json("json", "struct<summary:struct<total_matches:long,total_discrepancies:long,pdf_only_count:long,xbrl_only_count:long,match_rate:double>,matches:array<struct<okey:long>>>")
    out = R.results_json(r, "filing", ["okey", "reason"]).select("filing", j.alias("j"))
    return _rounded(out.select("filing", "j.summary.*", F.array_join(F.transform("j.matches", lambda v: v["okey"].cast("string")), ",").alias("matches")))


@query("k10_automap_rows")
def automap_rows(spark, d):
    return R.automap_rows(_labels(spark, d))


@query("k19_metrics_json", f"""WITH {_METRICS}, {_BOUNDS} SELECT m.method, wer, precision, recall, NOT (coalesce(wer > wm, false) OR coalesce(precision < pm, false) OR coalesce(recall < rm, false)) AS passed FROM m LEFT JOIN t USING (method)""")
def metrics_json(spark, d):
    """The metrics file, read again."""
    entry = "struct<text_extraction:struct<wer:double>,table_extraction:struct<precision:double,recall:double>>"
    j = F.from_json("json", f"struct<methods:map<string,{entry}>,validation:map<string,struct<passed:boolean>>>")
    out = R.metrics_json(_metrics(spark, d), X.thresholds(spark)).select(j.alias("j"))
    each = out.select("j.validation", F.explode("j.methods").alias("method", "m"))
    return each.select("method", "m.text_extraction.wer", "m.table_extraction.precision", "m.table_extraction.recall", F.element_at("validation", F.col("method"))["passed"].alias("passed"))


@query("k19_validation_text", f"""WITH {_METRICS}, {_BOUNDS}, g AS (SELECT m.method, concat_ws(chr(10), CASE WHEN wer > wm THEN printf('  ❌ wer %.3f > %.3f', wer, wm::DOUBLE) END, CASE WHEN precision < pm THEN printf('  ❌ precision %.3f < %.3f', precision, pm::DOUBLE) END, CASE WHEN recall < rm THEN printf('  ❌ recall %.3f < %.3f', recall, rm::DOUBLE) END) AS fails FROM m LEFT JOIN t USING (method))
SELECT chr(10) || repeat('=', 50) || chr(10) || 'METRICS VALIDATION RESULTS' || chr(10) || repeat('=', 50) || chr(10) || string_agg(chr(10) || upper(method) || CASE WHEN fails = '' THEN ': PASS' || chr(10) || '  ✅ All thresholds met' ELSE ': FAIL' || chr(10) || fails END, chr(10) ORDER BY upper(method))
  || chr(10) || chr(10) || repeat('=', 50) || chr(10) || 'OVERALL: ' || CASE WHEN bool_and(fails = '') THEN 'ALL TESTS PASSED' ELSE 'SOME TESTS FAILED' END || chr(10) || repeat('=', 50) AS text, bool_and(fails = '') AS all_ok FROM g""")
def validation_text(spark, d):
    return R.validation_text(X.gate(_metrics(spark, d), X.thresholds(spark)))


@query("s17_report_methods", f"""WITH p AS (SELECT p_partkey, p_size AS s, p_partkey % 3 AS k FROM part)
SELECT p_partkey, 'pdfplumber_tesseract' AS method, round(CASE WHEN k = 0 THEN (s + 0.5) / 100 END, 6) AS wer, round(CASE WHEN k < 2 THEN s / 100.0 ELSE 0 END::DOUBLE, 6) AS precision, round(CASE WHEN k < 2 THEN (s + 1) / 100.0 ELSE 0 END::DOUBLE, 6) AS recall FROM p
UNION ALL SELECT p_partkey, 'hybrid_camelot_pdfplumber', round(CASE WHEN k < 2 THEN (s + s + 4) / 200.0 END, 6), round(CASE WHEN k < 2 THEN s / 100.0 ELSE 0.6 END::DOUBLE, 6), round(CASE WHEN k < 2 THEN (s + 2) / 100.0 ELSE 0.6 END::DOUBLE, 6) FROM p
UNION ALL SELECT p_partkey, 'layout_parser', NULL, round(CASE WHEN k <> 1 THEN (s + 3) / 100.0 ELSE 0.6 END::DOUBLE, 6), round(CASE WHEN k <> 1 THEN (s + 4) / 100.0 ELSE 0.6 END::DOUBLE, 6) FROM p
UNION ALL SELECT p_partkey, 'docling', round(s / 50.0, 6), round(CASE WHEN k <> 1 THEN (s + 0.25) / 100 ELSE 0.708 END::DOUBLE, 6), round(CASE WHEN k <> 1 THEN (s + 0.75) / 100 ELSE 0.816 END::DOUBLE, 6) FROM p""")
def report_methods(spark, d):
    """Reports in which some methods' lines lack."""
    plain = "CASE WHEN p_partkey % 3 = 0 THEN concat('## PDFPlumber+Tesseract\n- Overall Text WER: ', p_size, '.5%\n') WHEN p_partkey % 3 = 1 THEN '## PDFPlumber+Tesseract\n' ELSE '' END, CASE WHEN p_partkey % 3 < 2 THEN concat('Average Precision | ', p_size, '%\nAverage Recall | ', p_size + 1, '%\n## Hybrid text ', p_size, '-', p_size + 4, '%, tables ~', p_size, '%, ~', p_size + 2, '%\n') ELSE '' END"
    layout = "CASE WHEN p_partkey % 3 <> 1 THEN concat('Layout Parser: ~', p_size + 3, '% and ~', p_size + 4, '%\n') ELSE '' END"
    docling = "concat('## Method 4: Docling\nWER: ', p_size * 2, '%\n'), CASE WHEN p_partkey % 3 <> 1 THEN concat('Average Precision: ', p_size, '.25%\nAverage Recall: ', p_size, '.75%\n') ELSE '' END, '## Other\nAverage Precision: 99.9%\n'"
    texts = table(spark, d, "part").selectExpr("p_partkey", f"concat({plain}, {layout}, {docling}) AS text")
    return _rounded(S.report_methods(texts, ["p_partkey"]))


@query("m12_page_analysis", f"""WITH {_WORDS}, z AS (SELECT page_number, CASE WHEN size > 1.5 * m THEN 'title' WHEN size > 1.2 * m THEN 'heading' WHEN size < 0.8 * m THEN 'small' ELSE 'body' END AS c FROM (SELECT page_number, size, avg(size) OVER (PARTITION BY page_number) AS m FROM w)),
c AS (SELECT page_number, count(*) FILTER (c = 'title') AS title, count(*) FILTER (c = 'heading') AS heading, count(*) FILTER (c = 'small') AS small, count(*) FILTER (c = 'body') AS body FROM z GROUP BY 1),
m AS (SELECT page_number, min(x0) AS "left", max(bottom) AS bottom FROM w GROUP BY 1),
t AS (SELECT DISTINCT page_number, round_even(top, 0) AS t FROM w), s AS (SELECT page_number, round(avg(gap), 6) AS avg_spacing FROM (SELECT page_number, t - lag(t) OVER (PARTITION BY page_number ORDER BY t) AS gap FROM t) WHERE gap IS NOT NULL GROUP BY 1),
o AS (SELECT l_orderkey // 400 + 1 AS page_number, count(*) FILTER (l_returnflag = 'A') AS chars, count(*) FILTER (l_returnflag = 'R') AS rects FROM lineitem GROUP BY 1)
SELECT page_number, title, heading, small, body, "left", bottom, avg_spacing, coalesce(chars, 0) AS chars, coalesce(rects, 0) AS rects FROM c JOIN m USING (page_number) LEFT JOIN s USING (page_number) LEFT JOIN o USING (page_number)""")
def page_analysis(spark, d):
    kind = "CASE l_returnflag WHEN 'A' THEN 'chars' WHEN 'R' THEN 'rects' ELSE 'lines' END AS kind"
    objects = table(spark, d, "lineitem").selectExpr("'d' AS doc_id", "l_orderkey div 400 + 1 AS page_number", kind)
    out = L.page_analysis(_words(spark, d), objects, ["chars", "rects"])
    return _rounded(out.select("page_number", "title", "heading", "small", "body", "left", "bottom", "avg_spacing", "chars", "rects"))


@query("m11_simple_page_layout")
def simple_page_layout(spark, d):
    w = _words(spark, d)
    images = w.where("text LIKE 'A%'").select("doc_id", "page_number", "ord", "x0", "top", "x1", "bottom")
    return L.simple_page_layout(w, images)


@query("u03_table_strategies", "SELECT s AS strategy, count(*) AS tables, sum(l_linenumber)::BIGINT AS rows FROM (SELECT 'standard' AS s, l_linenumber FROM lineitem WHERE l_tax > 0.02 UNION ALL SELECT 'custom', l_linenumber FROM lineitem WHERE l_tax > 0.05 UNION ALL SELECT 'financial', l_linenumber FROM lineitem WHERE l_discount > 0.05) GROUP BY s")
def table_strategies(spark, d):
    """Tables of all strategies: what two of them find counts twice."""
    from functools import reduce

    li = table(spark, d, "lineitem")
    parts = [li.where(w).select(F.lit(s).alias("strategy"), "l_linenumber") for s, w in (("standard", "l_tax > 0.02"), ("custom", "l_tax > 0.05"), ("financial", "l_discount > 0.05"))]
    return reduce(lambda a, b: a.unionAll(b), parts).groupBy("strategy").agg(F.count("*").alias("tables"), F.sum("l_linenumber").cast("long").alias("rows"))
