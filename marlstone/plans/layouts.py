"""Queries of words and boxes, methods, gates, exports and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config.keywords import CAPABILITIES, HAS, THRESHOLDS, USE_CASES
from ..operators import layout as L
from ..operators import methods as X
from ..sinks import write as W
from ..streaming import events as E
from .documents import _PAGES, _blocks, _rounded
from .registry import dealt, query, table

# Words on pages from line items, 400 orders to a page; places are made unique by the row's number in its order.
_WORDS = """w AS (SELECT 'd' AS doc_id, l_orderkey // 400 + 1 AS page_number, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord,
  l_returnflag || l_linestatus || l_linenumber AS text, l_quantity * 10 AS x0, l_quantity * 10 + 5 * l_linenumber + 10 AS x1, (l_partkey * 37 % 7000)::DOUBLE AS top, (l_partkey * 37 % 7000 + 8 + l_suppkey % 20)::DOUBLE AS bottom,
  CASE l_returnflag WHEN 'A' THEN 'Times-Bold' WHEN 'N' THEN 'Helvetica-Oblique' ELSE 'Courier' END AS fontname, (8 + l_suppkey % 12)::DOUBLE AS size FROM lineitem)"""


def _words(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("page_number", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    li = dealt(table(spark, d, "lineitem").withColumn("page_number", F.expr("l_orderkey div 400 + 1")), "page_number").withColumn("ord", F.col("l_orderkey") * 1000 + F.row_number().over(order))
    return li.selectExpr(
        "'d' AS doc_id", "page_number", "cast(ord AS bigint) AS ord", "l_returnflag || l_linestatus || l_linenumber AS text", "l_quantity * 10 AS x0", "l_quantity * 10 + 5 * l_linenumber + 10 AS x1",
        "cast(l_partkey * 37 % 7000 AS double) AS top", "cast(l_partkey * 37 % 7000 + 8 + l_suppkey % 20 AS double) AS bottom",
        "CASE l_returnflag WHEN 'A' THEN 'Times-Bold' WHEN 'N' THEN 'Helvetica-Oblique' ELSE 'Courier' END AS fontname", "cast(8 + l_suppkey % 12 AS double) AS size",
    )


_GAPS = """g AS (SELECT *, coalesce(top - lag(bottom) OVER (PARTITION BY page_number ORDER BY top, x0, ord) > 20, false)::INT AS n FROM w),
k AS (SELECT *, sum(n) OVER (PARTITION BY page_number ORDER BY top, x0, ord) AS block FROM g),
b AS (SELECT page_number, block::BIGINT AS block, count(*) AS words, min(x0) AS x1, min(top) AS y1, max(x1) AS x2, max(bottom) AS y2, string_agg(text, ' ' ORDER BY top, x0, ord) AS text FROM k GROUP BY ALL HAVING count(*) >= 3)"""


@query("w01_a19_gap_blocks", f"WITH {_WORDS}, {_GAPS} SELECT page_number, block, words, x1, y1, x2, y2, text FROM b")
def gap_blocks(spark, d):
    return L.gap_blocks(_words(spark, d)).select("page_number", "block", "words", "x1", "y1", "x2", "y2", "text")


@query("p12_p13_titles", rf"""WITH {_WORDS}, {_GAPS}, s AS (SELECT page_number, block, CASE WHEN words <= 10 THEN 2 ELSE 0 END + (upper(text) = text AND lower(text) <> text)::INT + (y2 - y1 > 20)::INT + (x1 > 100)::INT AS score FROM b)
SELECT page_number, block, score AS title_score, score >= 3 AS is_title FROM s""")
def titles(spark, d):
    return L.titles(L.gap_blocks(_words(spark, d))).select("page_number", "block", "title_score", "is_title")


_AREAS = "a AS (SELECT p AS page_number, 100.0 * (p % 3) AS x1, 1000.0 AS y1, 300.0 AS x2, 4000.0 + p AS y2 FROM (SELECT DISTINCT l_orderkey // 400 + 1 AS p FROM lineitem))"


def _areas(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey div 400 + 1 AS id").distinct().selectExpr("'d' AS doc_id", "id AS page_number", "cast(100.0 * (id % 3) AS double) AS x1", "cast(1000 AS double) AS y1", "cast(300 AS double) AS x2", "cast(4000 + id AS double) AS y2")


@query("j09_words_outside_tables", f"WITH {_WORDS}, {_AREAS} SELECT ord, page_number FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.page_number = w.page_number AND x0 BETWEEN a.x1 AND a.x2 AND top BETWEEN a.y1 AND a.y2)")
def outside(spark, d):
    return L.outside(_words(spark, d), _areas(spark, d)).select("ord", "page_number")


@query("m10_page_layout")
def page_layout(spark, d):
    return L.page_layout(_words(spark, d), _areas(spark, d)).select("page_number", "block", "words", "is_title")


@query("w02_anchored_blocks")
def anchored(spark, d):
    return L.anchored_blocks(_words(spark, d)).groupBy("page_number", "block").count()


@query("w05_line_spacing", f"WITH {_WORDS}, t AS (SELECT DISTINCT page_number, round_even(top, 0) AS t FROM w), g AS (SELECT page_number, t - lag(t) OVER (PARTITION BY page_number ORDER BY t) AS gap FROM t) SELECT page_number, round(avg(gap), 6) AS avg_spacing, max(gap) - min(gap) AS spread FROM g WHERE gap IS NOT NULL GROUP BY page_number")
def line_spacing(spark, d):
    return L.line_spacing(_words(spark, d)).select("page_number", F.round("avg_spacing", 6).alias("avg_spacing"), "spread")


@query("w06_column_gaps", f"WITH {_WORDS}, v AS (SELECT page_number, floor(x0 / 50) * 100 + x0 % 50 AS x0 FROM w), g AS (SELECT page_number, x0, x0 - lag(x0) OVER (PARTITION BY page_number ORDER BY x0) AS gap FROM v) SELECT page_number, count(*) FILTER (gap > 50) + 1 AS columns, array_to_string(list_slice(list(gap ORDER BY x0) FILTER (gap > 50), 1, 3), ',') AS first_gaps FROM g GROUP BY page_number")
def column_gaps(spark, d):
    g = L.column_gaps(_words(spark, d).withColumn("x0", F.expr("floor(x0 / 50) * 100 + x0 % 50")))  # a gap after every fifth quantity
    return g.select("page_number", "columns", F.array_join(F.transform("first_gaps", lambda v: v.cast("string")), ",").alias("first_gaps"))


@query("a29_margins", f'WITH {_WORDS} SELECT page_number, min(x0) AS "left", max(x1) AS "right", min(top) AS top, max(bottom) AS bottom FROM w GROUP BY page_number')
def margins(spark, d):
    return L.margins(_words(spark, d)).drop("doc_id")


@query("w12_a27_size_classes", f"WITH {_WORDS}, m AS (SELECT *, avg(size) OVER (PARTITION BY page_number) AS a FROM w) SELECT page_number, CASE WHEN size > 1.5 * a THEN 'title' WHEN size > 1.2 * a THEN 'heading' WHEN size < 0.8 * a THEN 'small' ELSE 'body' END AS size_class, count(*) AS n FROM m GROUP BY ALL")
def size_classes(spark, d):
    return L.relative_size(_words(spark, d)).groupBy("page_number", "size_class").agg(F.count("*").alias("n"))


@query("a20_f31_fonts", f"""WITH {_WORDS}, f AS (SELECT fontname, sum(length(text))::BIGINT AS chars, avg(size) AS s, printf('%.1f-%.1f', min(size), max(size)) AS range, substr(string_agg(text, '' ORDER BY ord), 1, 100) AS sample FROM w GROUP BY fontname)
SELECT fontname, chars, round(s, 6) AS avg_size, range, sample, CASE WHEN regexp_matches(lower(fontname), 'bold|black|heavy') THEN CASE WHEN s > 16 THEN 'title' WHEN s > 14 THEN 'heading' ELSE 'emphasized_text' END
  WHEN regexp_matches(lower(fontname), 'italic|oblique') THEN 'italic_text' WHEN s > 16 THEN 'large_text' WHEN s < 10 THEN 'small_text' ELSE 'body_text' END AS kind FROM f""")
def fonts(spark, d):
    return L.fonts(_words(spark, d)).withColumn("avg_size", F.round("avg_size", 6))


@query("p17_rulings", f"WITH {_WORDS} SELECT page_number, count(*) FILTER (abs(bottom - top - 8) < 1) > 2 AND count(*) FILTER (abs(x1 - x0 - 15) < 1) > 2 AS has_rulings FROM w GROUP BY page_number")
def rulings(spark, d):
    w = _words(spark, d)
    return L.has_rulings(w.select("doc_id", "page_number", F.lit(0.0).alias("y0"), (F.col("bottom") - F.col("top") - 8).alias("y1"), F.lit(0.0).alias("x0"), (F.col("x1") - F.col("x0") - 15).alias("x1"))).drop("doc_id")


@query("j10_f30_best_table_method", """WITH p AS (SELECT o_orderkey AS page, o_orderkey % 2 = 0 AS r, o_custkey % 3 AS la, o_orderkey % 5 % 2 AS st, o_custkey % 2 AS pl, o_totalprice AS x, o_totalprice * (o_custkey % 3) / 1.5 AS y FROM orders)
SELECT page, CASE WHEN r AND la > 0 THEN 'camelot_lattice' WHEN NOT r AND st > 0 THEN 'camelot_stream' WHEN pl > 0 AND la = 0 AND st = 0 THEN 'pdfplumber' WHEN la > 0 OR st > 0 THEN CASE WHEN x > y THEN 'camelot_lattice' ELSE 'camelot_stream' END ELSE 'none_suitable' END AS method FROM p""")
def best_method(spark, d):
    o = table(spark, d, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return o.select(key.alias("page"), L.best_table_method(key % 2 == 0, cust % 3, key % 5 % 2, cust % 2, price, price * (cust % 3) / 1.5).alias("method"))


@query("f28_table_boxes", "SELECT p_partkey, (100 + p_partkey % 4 * 200)::DOUBLE AS y1, least((100 + p_partkey % 4 * 200)::DOUBLE + p_size * 15, 742.0) AS y2 FROM part")
def table_boxes(spark, d):
    b = L.table_box(F.col("p_partkey") % 4, F.col("p_size"), F.lit(612.0), F.lit(792.0))
    return table(spark, d, "part").select("p_partkey", b["y1"].alias("y1"), b["y2"].alias("y2"))


_PG = "g AS (SELECT doc_id, lang AS method, text, n_chars > 300 AS success, doc_id % 4 = 0 AS used_ocr FROM documents)"


def _page_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("method"), "text", (F.col("n_chars") > 300).alias("success"), (F.col("doc_id") % 4 == 0).alias("used_ocr"))


@query("a12_a16_a18_page_counters", f"""WITH {_PG} SELECT method, count(*) AS total_pages, count(*) FILTER (NOT used_ocr AND success) AS text_pages, count(*) FILTER (used_ocr) AS ocr_pages, count(*) FILTER (NOT success) AS failed_pages,
  round(count(*) FILTER (used_ocr) / count(*)::DOUBLE, 6) AS ocr_usage_rate, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate FROM g GROUP BY method""")
def counters(spark, d):
    return _rounded(X.page_counters(_page_rows(spark, d), "method"))


@query("a10_a11_strategy_rollup", "SELECT l_returnflag AS method, count(*) AS tables, count(*) FILTER (l_tax > 0.04) AS financial, round(avg(l_quantity), 6) AS avg_quality FROM lineitem GROUP BY 1")
def strategies(spark, d):
    from ..operators.tables import strategy_rollup

    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), (F.col("l_tax") > 0.04).alias("is_financial"), F.col("l_quantity").alias("quality_score"))
    return _rounded(strategy_rollup(li))


@query("a13_layout_summary", f"WITH {_PAGES}, {_PG} SELECT (SELECT count(*) FROM u) AS total_blocks, (SELECT count(*) FROM u WHERE t = 'title') AS titles, (SELECT round(count(*) FILTER (success) / count(*)::DOUBLE * 100, 6) FROM g) AS success_rate")
def layout_summary(spark, d):
    s = X.layout_summary(_blocks(spark, d), _page_rows(spark, d))
    return s.select("total_blocks", F.try_element_at("by_type", F.lit("title")).alias("titles"), F.round("success_rate", 6).alias("success_rate"))


_SCORES = """s AS (SELECT lang AS method, min(doc_id) AS ord, count(*) AS files, sum(length(text)) AS chars, count(DISTINCT source) AS tables, avg(n_chars) AS t FROM documents GROUP BY lang),
q AS (SELECT *, least((chars > 0)::INT * 10 + (files > 200)::INT * 10 + 10 + least(tables * 5, 15) + 10 + (files > 130)::INT * 5 + 0 + (files > 110)::INT * 10 + (files % 5 + 3) * 2, 100)::BIGINT AS score FROM s)"""


@query("a17_w09_o08_method_ranking", f"WITH {_SCORES} SELECT method, score, row_number() OVER (ORDER BY score DESC, ord) AS place FROM q")
def ranking(spark, d):
    s = table(spark, d, "documents").groupBy(F.col("lang").alias("method")).agg(F.min("doc_id").alias("ord"), F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.countDistinct("source").alias("tables"))
    n = F.col("files")
    score = X.quality_score(F.col("chars"), n > 200, F.lit(True), F.col("tables"), F.lit(True), n > 130, F.lit(False), n > 110, n % 5, F.lit(3))
    return X.rank(s.select("method", "ord", score.cast("long").alias("score")), "score", "place", "ord").select("method", "score", F.col("place").cast("long").alias("place"))


@query("w09_f32_efficiency", "SELECT method, round(per, 6) AS per_page, row_number() OVER (ORDER BY per, ord) AS place FROM (SELECT lang AS method, min(doc_id) AS ord, (count(*) - 106) / greatest(count(DISTINCT source), 1)::DOUBLE AS per FROM documents GROUP BY lang) WHERE per > 0")
def efficiency(spark, d):
    s = table(spark, d, "documents").groupBy(F.col("lang").alias("method")).agg(F.min("doc_id").alias("ord"), (F.count("*") - 106).alias("seconds"), F.countDistinct("source").alias("pages"))
    return X.efficiency(s).select("method", F.round("per_page", 6).alias("per_page"), F.col("place").cast("long").alias("place"))


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


@query("j16_p23_capabilities", f"SELECT m.method, c.capability, h.method IS NOT NULL AS has FROM (VALUES {_rows([(m,) for m in HAS])}) m(method), (VALUES {_rows([(c,) for c in CAPABILITIES])}) c(capability) LEFT JOIN (VALUES {_rows([(m, c) for m, cs in HAS.items() for c in cs])}) h(method, capability) ON h.method = m.method AND h.capability = c.capability")
def capabilities(spark, d):
    return X.capabilities(spark)


@query("j17_use_cases", f"SELECT use_case, method FROM (VALUES {_rows(USE_CASES)}) u(use_case, method) WHERE method IN ('docling', 'layout_parser')")
def use_cases(spark, d):
    return X.use_cases(spark.createDataFrame([("docling",), ("layout_parser",)], "method string"))


# Metrics of four methods from the tables: heuristics against labels, by id class.
_METRICS = """m AS (SELECT ['docling', 'layout_parser', 'hybrid_camelot_pdfplumber', 'pdfplumber_tesseract'][(doc_id % 4 + 1)::INT] AS method, round(avg(quality) / 12, 6) AS wer, round(avg(quality), 6) AS precision, round(avg(quality) * 0.6, 6) AS recall FROM labels GROUP BY 1)"""
_BOUNDS = f"t(method, wm, pm, rm) AS (VALUES {_rows(THRESHOLDS)})"


def _metrics(spark, d):
    names = F.array(*[F.lit(m) for m in ("docling", "layout_parser", "hybrid_camelot_pdfplumber", "pdfplumber_tesseract")])
    q = F.avg("quality")
    return table(spark, d, "labels").groupBy(F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("method")).agg(F.round(q / 12, 6).alias("wer"), F.round(q, 6).alias("precision"), F.round(q * 0.6, 6).alias("recall"))


@query("j13_p24_gate", f"WITH {_METRICS}, {_BOUNDS} SELECT m.method, wer, precision, recall, concat_ws('; ', CASE WHEN wer > wm THEN printf('wer %.3f > %.3f', wer, wm::DOUBLE) END, CASE WHEN precision < pm THEN printf('precision %.3f < %.3f', precision, pm::DOUBLE) END, CASE WHEN recall < rm THEN printf('recall %.3f < %.3f', recall, rm::DOUBLE) END) AS failures, NOT (coalesce(wer > wm, false) OR coalesce(precision < pm, false) OR coalesce(recall < rm, false)) AS passed FROM m LEFT JOIN t USING (method)")
def gate(spark, d):
    return X.gate(_metrics(spark, d), X.thresholds(spark)).withColumn("failures", F.array_join("failures", "; "))


@query("j14_regressions", f"""WITH {_METRICS}, b AS (SELECT method, wer - 0.03 * (length(method) % 5) AS wer, precision + 0.04 * (length(method) % 3) AS precision, recall + 0.05 * (length(method) % 4) AS recall FROM m),
l AS (SELECT m.method, m.wer - b.wer AS w, b.precision - m.precision AS p, b.recall - m.recall AS r FROM m JOIN b ON b.method = m.method)
SELECT method, round(w, 6)::DOUBLE AS wer_loss, round(p, 6)::DOUBLE AS precision_loss, round(r, 6)::DOUBLE AS recall_loss, concat_ws(',', CASE WHEN w > 0.10 + 1e-12 THEN 'wer' END, CASE WHEN p > 0.08 + 1e-12 THEN 'precision' END, CASE WHEN r > 0.08 + 1e-12 THEN 'recall' END) AS regressed FROM l""")
def regressions(spark, d):
    m = _metrics(spark, d)
    n = F.length("method")  # baselines that differ by method, some beyond what is tolerated
    base = m.select("method", (F.col("wer") - 0.03 * (n % 5)).alias("wer"), (F.col("precision") + 0.04 * (n % 3)).alias("precision"), (F.col("recall") + 0.05 * (n % 4)).alias("recall"))
    r = X.regressions(m, base)
    return r.select("method", *[F.round(c, 6).alias(c) for c in ("wer_loss", "precision_loss", "recall_loss")], F.array_join("regressed", ",").alias("regressed"))


@query("j15_metrics_diff", f"""WITH {_METRICS}, o AS (SELECT method AS file, 'recall' AS key, recall AS old FROM m WHERE method <> 'docling'), n AS (SELECT method AS file, 'recall' AS key, recall + CASE WHEN method = 'layout_parser' THEN 0.1 ELSE 0 END AS new FROM m WHERE method <> 'pdfplumber_tesseract')
SELECT file, key, round(old, 6) AS old, round(new, 6) AS new, round(new - old, 6) AS delta, CASE WHEN old IS NULL THEN '+' WHEN new IS NULL THEN '-' WHEN new > old THEN '↑' WHEN new < old THEN '↓' ELSE '=' END AS arrow FROM o FULL JOIN n USING (file, key)""")
def metrics_diff(spark, d):
    m = _metrics(spark, d).select(F.col("method").alias("file"), F.lit("recall").alias("key"), F.col("recall").alias("value"))
    new = m.where("file <> 'pdfplumber_tesseract'").withColumn("value", F.col("value") + F.when(F.col("file") == "layout_parser", 0.1).otherwise(0.0))
    return _rounded(X.metrics_diff(m.where("file <> 'docling'"), new))


@query("s16_metrics_check", f"WITH {_METRICS} SELECT 'ghost' AS method, 'missing' AS problem UNION ALL SELECT method, 'not_positive' FROM m WHERE NOT (precision > 0 AND recall > 0) AND method <> 'docling'")
def metrics_check(spark, d):
    return X.check_metrics(_metrics(spark, d), ["docling", "ghost"])


@query("a23_k21_drift", "WITH c AS (SELECT lang AS method, doc_id % 3 AS run, avg(length(text)) AS m, count(*) AS chunks FROM documents GROUP BY ALL) SELECT method, run, chunks, round(m, 4) AS mean_chars, round(m - lag(m) OVER (PARTITION BY method ORDER BY run), 4) AS drift FROM c")
def drift(spark, d):
    c = X.chunk_drift(table(spark, d, "documents").select(F.col("lang").alias("method"), (F.col("doc_id") % 3).alias("run"), "text"))
    return c.select("method", "run", "chunks", F.round("mean_chars", 4).alias("mean_chars"), F.round("drift", 4).alias("drift"))


@query("f16_recommendations", """SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 3 > 0 THEN (p_size % 3) || ' financial tables: prefer the financial strategy for statements' END,
CASE WHEN p_size % 7 > p_size % 5 THEN 'custom settings found more: tables are regular' WHEN p_size % 5 > p_size % 7 THEN 'standard settings suffice: tables have borders' END,
CASE WHEN greatest(p_size % 5, p_size % 7, p_size % 3) = 0 THEN 'no tables: text is unstructured or scanned' END) AS advice FROM part""")
def recommendations(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.array_join(X.recommendations(s % 5, s % 7, s % 3), "; ").alias("advice"))


@query("k06_markdown", f"""WITH {_PAGES}, s AS (SELECT *, '<!-- ' || m || ' p' || coalesce(page, 1) || ' ' || printf('%.2f', conf) || ' -->' || chr(10) || CASE WHEN t = 'title' THEN '## ' ELSE '' END || text AS line FROM u WHERE text <> '')
SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY page NULLS FIRST, CASE t WHEN 'title' THEN 1 ELSE 2 END, ord) AS text FROM s GROUP BY doc_id""")
def markdown(spark, d):
    return W.markdown(_blocks(spark, d).withColumn("confidence", F.round("confidence", 6)))


@query("k07_k15_sections_report", f"""WITH {_PAGES} SELECT doc_id, t AS label, string_agg('[p' || coalesce(page, 1) || ' ' || t || '] ' || text, chr(10) ORDER BY page NULLS FIRST, ord) AS text FROM u GROUP BY doc_id, t""")
def sections_report(spark, d):
    return W.sections_report(_blocks(spark, d), F.col("block_type"))


@query("k05_export_json")
def export_json(spark, d):
    b = _blocks(spark, d)
    docs = b.select("doc_id").distinct().withColumn("processing_status", F.lit("success"))
    return W.export_json(docs, b)


@query("k23_banner", "SELECT doc_id, repeat('=', 60) || chr(10) || source || chr(10) || repeat('=', 60) || chr(10) || text || CASE WHEN lang = 'en' THEN chr(10) || 'TABLES' || chr(10) || lang ELSE '' END AS text FROM documents")
def banner(spark, d):
    return table(spark, d, "documents").select("doc_id", W.banner(F.col("source"), F.col("text"), F.when(F.col("lang") == "en", F.col("lang")).otherwise("")).alias("text"))


@query("w07_turn_numbers", "SELECT conv_id, turn, role, 'turn_' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text))::VARCHAR, 3, '0') AS id FROM conversations")
def turn_numbers(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.format_string("turn_%03d", n).alias("id"))


@query("stream_windows", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windows(spark, d):
    return E.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, false)::INT AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return E.sessions(table(spark, d, "events"))


KIND = "CASE event_id % 6 WHEN 0 THEN 'Text' WHEN 1 THEN 'Title' WHEN 2 THEN 'Table' WHEN 3 THEN 'DataGrid' WHEN 4 THEN 'Figure' ELSE 'formula' END"


@query("p20_p26_routing", f"""SELECT event_id, CASE k WHEN 'Text' THEN 'text' WHEN 'Title' THEN 'title' WHEN 'List' THEN 'list' WHEN 'Table' THEN 'table' WHEN 'Figure' THEN 'figure' END AS block_type,
  CASE WHEN regexp_matches(lower(k), 'table|grid') THEN 'table' WHEN contains(lower(k), 'formula') THEN 'formula' WHEN regexp_matches(lower(k), 'figure|picture') THEN 'figure' END AS kind FROM (SELECT event_id, {KIND} AS k FROM events)""")
def routing(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr(KIND).alias("k"))
    return e.select("event_id", L.block_type(F.col("k")).alias("block_type"), L.item_kind(F.col("k")).alias("kind"))


@query("a28_object_counts", f"""SELECT user_id AS page_number, count(*) FILTER (k = 'Text') AS "Text", count(*) FILTER (k = 'Figure') AS "Figure" FROM (SELECT user_id, {KIND} AS k FROM events) GROUP BY user_id HAVING count(*) FILTER (k IN ('Text', 'Figure')) >= 0""")
def object_counts(spark, d):
    e = table(spark, d, "events").select(F.lit("d").alias("doc_id"), F.col("user_id").alias("page_number"), F.expr(KIND).alias("kind"))
    return L.object_counts(e, ["Text", "Figure"]).drop("doc_id")


@query("j11_page_summary", """WITH s AS (SELECT user_id AS p, arg_min(event_id % 2 = 0, event_id) AS o, arg_min(event_type, event_id) AS m FROM events GROUP BY user_id)
SELECT doc_id AS page_number, coalesce(o, false) AS used_ocr, coalesce(m, 'pdfplumber') AS extraction_method FROM documents LEFT JOIN s ON p = doc_id""")
def page_summary(spark, d):
    s = table(spark, d, "events").select(F.lit("d").alias("doc_id"), F.col("user_id").alias("page_number"), F.col("event_id").alias("ord"), (F.col("event_id") % 2 == 0).alias("used_ocr"), F.col("event_type").alias("extraction_method"))
    f = table(spark, d, "documents").select(F.lit("d").alias("doc_id"), F.col("doc_id").alias("page_number"))
    return L.with_page_summary(f, s).drop("doc_id")


@query("p21_min_text", f"WITH {_WORDS}, {_GAPS} SELECT page_number, block, words FROM b WHERE length(trim(text)) >= 12")
def min_text(spark, d):
    return L.with_text(L.gap_blocks(_words(spark, d)), least_chars=12).select("page_number", "block", "words")


@query("w11_reading_index", f"""WITH {_PAGES} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, ord) - 1 AS reading_index FROM u""")
def reading_index(spark, d):
    from ..operators.blocks import with_reading_index

    return with_reading_index(_blocks(spark, d)).select("doc_id", "block_id", F.col("reading_index").cast("long").alias("reading_index"))


@query("s19_processed", "SELECT DISTINCT lower(source) AS folder FROM documents WHERE lower(source) NOT IN ('src1', 'src2') AND source IS NOT NULL")
def processed(spark, d):
    from ..sources.files import processed as names

    return names(table(spark, d, "documents").select(F.col("source").alias("folder")), ["src1", "src2"])


@query("a15_table_files", """WITH f AS (SELECT lang, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'CSV' ELSE 'md' END AS k FROM documents)
SELECT lang, count(*) FILTER (lower(k) = 'csv') AS csv_files, array_to_string(list_sort(list_distinct(list(lower(k)))), ',') AS formats FROM f GROUP BY lang""")
def table_files(spark, d):
    from ..sources.files import file_stats

    f = table(spark, d, "documents").selectExpr("lang", "'t/table_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.CSV' ELSE '.md' END AS file")
    return file_stats(f, ["lang"]).withColumn("formats", F.array_join("formats", ","))


@query("k15_exports", f"""WITH {_PAGES}, s AS (SELECT *, '<!-- ' || m || ' p' || coalesce(page, 1) || ' ' || printf('%.2f', conf) || ' -->' || chr(10) || CASE WHEN t = 'title' THEN '## ' ELSE '' END || text AS line FROM u WHERE text <> '')
SELECT doc_id, m AS method, 'markdown' AS form, '# ' || doc_id || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY page NULLS FIRST, CASE t WHEN 'title' THEN 1 ELSE 2 END, ord) AS text FROM s GROUP BY doc_id, m
UNION ALL SELECT doc_id, m, 'text', string_agg(text, chr(10) ORDER BY page NULLS FIRST, ord) FROM s GROUP BY doc_id, m""")
def method_exports(spark, d):
    """Eight of the twelve exporters; those to JSON are ``k15_json_exports``."""
    return _exports(spark, d, ["markdown", "text"])


def _exports(spark, d, forms):
    from functools import reduce

    b = _blocks(spark, d)
    docs = b.select("doc_id").distinct()
    return reduce(lambda x, y: x.unionByName(y), [W.exports(docs, b, m, f) for m in ("docling", "layout_parser", "hybrid", "pdfplumber_tesseract") for f in forms])


@query("k15_json_exports", f"""WITH {_PAGES} SELECT doc_id, m AS method, 'json' AS form, count(*) AS blocks, string_agg(block_id, ',' ORDER BY ord) AS ids FROM u GROUP BY doc_id, m""")
def json_exports(spark, d):
    """The four exporters to JSON, read again: blocks and their ids in order."""
    out = _exports(spark, d, ["json"])
    j = F.from_json("text", "struct<blocks:array<struct<block_id:string>>,summary:struct<total_blocks:long>>")
    return out.withColumn("j", j).select("doc_id", "method", "form", F.col("j.summary.total_blocks").alias("blocks"), F.array_join("j.blocks.block_id", ",").alias("ids"))


@query("k04_processing_summary", f"""WITH {_PAGES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS succeeded, count(*) AS blocks, count(DISTINCT doc_id) AS documents_with_blocks, array_to_string(list_sort(list_distinct(list(m))), ',') AS methods FROM u""")
def processing_summary(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 != 0, "success").otherwise("failed").alias("processing_status"))
    return W.processing_summary(docs, _blocks(spark, d))


@query("k21_drift_report", """WITH m AS (SELECT source AS method, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source)
SELECT '# Drift' || chr(10) || chr(10) || '| method | n | chars |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || method || ' | ' || n || ' | ' || chars || ' |', chr(10) ORDER BY '| ' || method || ' | ' || n || ' | ' || chars || ' |') AS text FROM m""")
def drift_report(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("source").alias("method")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return W.drift_markdown(m, ["method", "n", "chars"])


@query("k13_s08_csv_round_trip", r"""WITH c AS (SELECT item_id % 7 AS t, item_id AS r, unnest([0, 1, 2, 3]) AS k, text FROM benchmark)
SELECT t::VARCHAR AS table_id, (row_number() OVER (PARTITION BY t, k ORDER BY r) - 1)::INT AS row_idx, k AS col_idx, CASE k WHEN 0 THEN 'Revenue, "net"' WHEN 1 THEN '1,234' WHEN 2 THEN 'two' || chr(10) || 'lines' ELSE text END AS value FROM c""")
def csv_round_trip(spark, d):
    """Cells with commas, quotes and line feeds, as CSV text and back."""
    from ..sources.files import csv_cells

    b = table(spark, d, "benchmark").selectExpr("cast(item_id % 7 AS string) AS table_id", "item_id AS row_idx", "posexplode(array('Revenue, \"net\"', '1,234', 'two\nlines', text)) AS (col_idx, value)")
    lines = W.csv_lines(b)
    whole = lines.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda v: v["line"]), "\n").alias("text"))  # a file a table
    return csv_cells(whole, "text")
