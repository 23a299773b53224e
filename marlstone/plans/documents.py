"""Queries of blocks, sections and tables in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..backends.base import element, extract, plain_text
from ..functions import text as T
from ..operators import blocks as B
from ..operators import tables as C
from .registry import dealt, query, table

# Blocks of pages by four methods: title element, headings, all paragraphs; a document is 10 pages.
_PAGES = """
p AS (SELECT page_id, page_id // 10 AS doc_id, page_id % 10 + 1 AS page, html FROM pages),
b AS (SELECT doc_id, 'docling' AS m, 0 AS k, CASE WHEN page % 4 = 0 THEN NULL ELSE page END AS page, 'title' AS t, 0.8 AS conf, array_to_string(regexp_extract_all(html, '<title>([^<]*)</title>', 1), ' ') AS text, page_id AS ord FROM p
  UNION ALL SELECT doc_id, 'layout_parser', 1, page, 'title', 0.8, array_to_string(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), ' '), page_id FROM p
  UNION ALL SELECT doc_id, 'hybrid', 2, page, 'text', 0.7 + (page_id % 3) / 10.0, array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), ' '), page_id FROM p
  UNION ALL SELECT doc_id, 'pdfplumber_tesseract', 3, page, 'text', 0.9, array_to_string(regexp_extract_all(html, '<p>([^<]*)</p>', 1), ' '), page_id FROM p),
u AS (SELECT doc_id::VARCHAR AS doc_id, m || '_' || t || '_' || ord AS block_id, m, page, t, conf::DOUBLE AS conf, text, k * 1099511627776 + ord AS ord,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM b)"""


def _blocks(spark, d):
    p = table(spark, d, "pages").select(F.expr("page_id div 10").alias("doc_id"), (F.col("page_id") % 10 + 1).alias("page"), "html", "page_id")
    tag = lambda t: F.array_join(F.regexp_extract_all("html", F.lit(f"<{t}>([^<]*)</{t}>"), F.lit(1)), " ")
    page, ord = F.col("page"), F.col("page_id")
    frames = {
        "docling": B.block(p, "docling", F.lit("title"), tag("title"), F.when(page % 4 != 0, page), F.lit(0.8), ord),
        "layout_parser": B.block(p, "layout_parser", F.lit("title"), tag("h1"), page, F.lit(0.8), ord),
        "hybrid": B.block(p, "hybrid", F.lit("text"), tag("p"), page, 0.7 + (ord % 3) / 10.0, ord),
        "pdfplumber_tesseract": B.block(p, "pdfplumber_tesseract", F.lit("text"), tag("p"), page, B.constant("text", "native"), ord),
    }
    return B.union_methods(frames)


@query("m15_u01_blocks", f"WITH {_PAGES} SELECT doc_id, block_id, m AS extraction_method, page AS page_number, t AS block_type, round(conf, 6) AS confidence, ord, text, words FROM u")
def blocks(spark, d):
    return _blocks(spark, d).select("doc_id", "block_id", "extraction_method", "page_number", "block_type", F.round("confidence", 6).alias("confidence"), "ord", F.col("content.text").alias("text"), F.col("quality_metrics.word_count").alias("words"))


@query("a03_w10_consolidate", f"""WITH {_PAGES}, r AS (SELECT *, coalesce(page, 1) AS pg, row_number() OVER (PARTITION BY doc_id, t, coalesce(page, 1) ORDER BY round(conf, 6) DESC, ord) AS n FROM u)
SELECT doc_id, t AS block_type, pg AS page_number, 'unified_' || t || '_p' || pg || '_' || substr(sha256(doc_id || '|' || t || '|' || pg), 1, 8) AS block_id, max(block_id) FILTER (n = 1) AS winner, max(m) FILTER (n = 1) AS best_method,
  count(*) - 1 AS losers, count(DISTINCT m) AS methods FROM r GROUP BY doc_id, t, pg""")
def consolidate(spark, d):
    b = _blocks(spark, d).withColumn("confidence", F.round("confidence", 6))
    c = B.consolidate(b.withColumn("content", F.col("content").withField("metadata", F.col("block_id"))))
    return c.select("doc_id", "block_type", "page_number", "block_id", F.col("content.metadata").alias("winner"), F.col("provenance.best_method").alias("best_method"), F.size("provenance.alternative_blocks").cast("long").alias("losers"), F.size("provenance.source_methods").cast("long").alias("methods"))


_STATS = "count(*) AS blocks, round(avg(conf), 6) AS avg_confidence, round(min(conf), 6) AS min_confidence, round(max(conf), 6) AS max_confidence, round(avg(CASE WHEN trim(text) <> '' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS avg_completeness, sum(length(text))::BIGINT AS text_length, sum(words)::BIGINT AS word_count"


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("a01_block_stats", f"WITH {_PAGES} SELECT {_STATS} FROM u")
def block_stats(spark, d):
    return _rounded(B.stats(_blocks(spark, d)))


@query("a02_a04_a30_by_method_type", f"WITH {_PAGES} SELECT m AS extraction_method, t AS block_type, {_STATS} FROM u GROUP BY ALL")
def by_method(spark, d):
    return _rounded(B.stats(_blocks(spark, d), "extraction_method", "block_type"))


@query("a21_section_overview", f"WITH {_PAGES} SELECT doc_id AS label, count(*) AS blocks, min(page)::INT AS first_page, max(page)::INT AS last_page, array_to_string(list_sort(list(DISTINCT t)), ',') AS types FROM u GROUP BY doc_id")
def section_overview(spark, d):
    return B.section_overview(_blocks(spark, d), F.col("doc_id")).withColumn("types", F.array_join("types", ","))


@query("u02_j12_s18_methods_per_doc", f"WITH {_PAGES} SELECT doc_id, array_to_string(list_sort(list(DISTINCT m)), ',') AS methods FROM u WHERE length(text) > 0 GROUP BY doc_id")
def methods_per_doc(spark, d):
    b = _blocks(spark, d).where(F.length("content.text") > 0)
    docs = b.select("doc_id").distinct()
    return docs.join(b, "doc_id", "left_semi").join(b.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("extraction_method")), ",").alias("methods")), "doc_id")


@query("o04_o05_type_order", f"""WITH {_PAGES} SELECT doc_id, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(page, 0), CASE t WHEN 'title' THEN 1 ELSE 2 END, ord) AS place FROM u""")
def type_order(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.coalesce("page_number", F.lit(0)), B.type_place(F.col("block_type")), "ord")
    return _blocks(spark, d).select("doc_id", "block_id", F.row_number().over(w).cast("long").alias("place"))


@query("o01_o02_reading_order", """
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY round_even(l_quantity * 12.5 / 50, 0) * 50, l_discount, l_orderkey, l_linenumber) AS place FROM lineitem""")
def reading_order(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.lit(1).alias("page_number"), F.struct((F.col("l_quantity") * 12.5).alias("y1"), F.col("l_discount").alias("x1")).alias("bounding_box"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"))
    return li.select("l_orderkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*B.reading_order())).cast("long").alias("place"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)"


@query("w04_sections", rf"""WITH {_LINES}, h AS (SELECT *, length(line) < 60 AND regexp_matches(line, '\.$') AS h FROM l), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, max(trim(line)) FILTER (h) AS title, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), ''), '^\s+|\s+$', '', 'g') AS content,
  len(list_filter(regexp_split_to_array(coalesce(string_agg(line, ' ' ORDER BY i) FILTER (NOT h), ''), '\s+'), lambda w: w <> '')) AS word_count FROM s WHERE section > 0 GROUP BY doc_id, section""")
def sections(spark, d):
    return B.sections(table(spark, d, "documents"), (F.length("line") < 60) & F.col("line").rlike(r"\.$"))


_TABLES = rf"""{_LINES}, t AS (SELECT *, length(line) - length(replace(line, '|', '')) >= 2 AS t FROM l), r AS (SELECT *, sum((NOT t)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM t),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS n FROM r WHERE t), m AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS table_no, i, line FROM k WHERE n >= 2)"""


@query("w03_p14_markdown_tables", f"WITH {_TABLES} SELECT doc_id, table_no::INT AS table_no, i::INT AS i, line FROM m")
def markdown_tables(spark, d):
    return C.markdown_tables(table(spark, d, "documents"))


@query("f07_f08_row_csv", f"""WITH {_TABLES}, x AS (SELECT doc_id, i, string_split(line, '|') AS c FROM m WHERE NOT regexp_matches(line, '^[|\\-:\\s]+$'))
SELECT doc_id, i::INT AS i, array_to_string(list_transform(list_slice(c, 2, greatest(len(c) - 1, 1)), lambda v: trim(v)), ',') AS csv FROM x""")
def row_csv(spark, d):
    t = C.markdown_tables(table(spark, d, "documents"))
    return t.where(~T.is_rule_line(F.col("line"))).select("doc_id", "i", T.row_csv(F.col("line")).alias("csv"))


# Cells of orders as tables: four columns of text, some blank or null, rows by line number.
_CELLS = """c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row_idx, k AS col_idx, CASE k WHEN 0 THEN ' ' || CASE l_suppkey % 3 WHEN 0 THEN 'Total cash' WHEN 1 THEN 'Net income' ELSE 'Units' END
  WHEN 1 THEN CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey::VARCHAR END WHEN 2 THEN CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE l_suppkey::VARCHAR END ELSE l_returnflag END AS value FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL), (SELECT unnest(range(4)) AS k))"""


def _cells(spark, d):
    li = dealt(table(spark, d, "lineitem"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag")])  # repeated keys
    text = F.array(
        F.concat(F.lit(" "), F.when(F.col("l_suppkey") % 3 == 0, "Total cash").when(F.col("l_suppkey") % 3 == 1, "Net income").otherwise("Units")),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey").cast("string")), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.col("l_suppkey").cast("string")), F.col("l_returnflag"),
    )
    return li.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_idx"), F.posexplode(text).alias("col_idx", "value"))


_NUM = "n AS (SELECT table_id, col_idx, count(*) AS n, count(try_cast(value AS DOUBLE)) / count(*)::DOUBLE AS num, count(value) AS filled, count(*) FILTER (trim(value) <> '') AS nb FROM c GROUP BY ALL)"


@query("a09_table_quality", f"""WITH {_CELLS}, {_NUM}, t AS (SELECT table_id, max(n) AS r, count(*) AS k, avg(num) AS num, sum(filled) / sum(n)::DOUBLE AS comp, sum(nb) / sum(n)::DOUBLE AS nbs FROM n GROUP BY ALL)
SELECT table_id, r AS n_rows, k AS n_cols, round((comp * 40 + least(r, k) / greatest(r, k)::DOUBLE * 30 + least(1.0, num) * 30) * 100, 2) AS quality_score, round(nbs, 6) AS non_blank_share FROM t""")
def table_quality(spark, d):
    return C.quality(_cells(spark, d)).select("table_id", "n_rows", "n_cols", "quality_score", F.round("non_blank_share", 6).alias("non_blank_share"))


_TEXT = "x AS (SELECT table_id, row_idx, string_agg(coalesce(value, ''), ',' ORDER BY col_idx) AS line FROM c GROUP BY ALL), tt AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row_idx) AS text FROM x GROUP BY ALL)"
_WORDS = "(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ["revenue", "income", "expense", "assets", "liabilities", "equity", "cash", "total", "net", "gross", "operating", "$", "million", "thousand"]) + ")"


@query("p06_financial_tables", f"""WITH {_CELLS}, {_NUM}, {_TEXT} SELECT table_id, count(*) FILTER (num > 0.5) AS numeric_columns, any_value({_WORDS}) AS words, any_value({_WORDS}) >= 3 OR count(*) FILTER (num > 0.5) >= 2 AS is_financial
FROM n JOIN tt USING (table_id) GROUP BY table_id""")
def financial_tables(spark, d):
    return C.is_financial(_cells(spark, d))


@query("f08_k24_table_text", f"WITH {_CELLS}, {_TEXT} SELECT table_id, text FROM tt")
def table_text(spark, d):
    return C.table_text(_cells(spark, d))


@query("p04_p05_p07_p08_financial_text", f"""WITH {_CELLS}, {_TEXT} SELECT table_id, regexp_matches(lower(text), 'revenue|income|expense|assets|liabilities|equity|cash|receivables|inventory|depreciation|amortization|gross profit|balance sheet|earnings|loss|total') AS page,
  {_WORDS} + contains(lower(text), 'balance')::INT + contains(lower(text), 'statement')::INT + contains(lower(text), 'earnings')::INT + contains(lower(text), 'profit')::INT + contains(lower(text), 'loss')::INT >= 3 AS content,
  CASE WHEN regexp_matches(lower(text), 'revenue|income|earnings|profit') THEN 'income_statement' WHEN regexp_matches(lower(text), 'assets|liabilities|equity|stockholders') THEN 'balance_sheet'
    WHEN regexp_matches(lower(text), 'cash flow|operating activities|investing|financing') THEN 'cash_flow' END AS statement FROM tt""")
def financial_text(spark, d):
    t, x = C.table_text(_cells(spark, d)), F.col("text")
    return t.select("table_id", C.financial_page(x).alias("page"), C.is_financial_content(x).alias("content"), C.statement_type(x).alias("statement"))


@query("p19_clean_cells", f"""WITH {_CELLS}, a AS (SELECT *, count(value) OVER (PARTITION BY table_id, row_idx) AS r FROM c), b AS (SELECT *, count(value) OVER (PARTITION BY table_id, col_idx) AS k FROM a WHERE r > 0)
SELECT table_id, row_idx, col_idx::INT AS col_idx, trim(coalesce(value, '')) AS value FROM b WHERE k > 0""")
def clean_cells(spark, d):
    return C.clean(_cells(spark, d))


@query("p18_square_rows", """WITH r AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row_idx, list_slice([l_returnflag, '', l_partkey::VARCHAR, l_linestatus], 1, 1 + l_suppkey % 4) AS cells FROM lineitem),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY table_id) AS w FROM r)
SELECT table_id, row_idx, array_to_string(list_transform(range(w), lambda j: coalesce(nullif(cells[j + 1], ''), CASE WHEN row_idx = 0 THEN 'Col_' || j ELSE '' END)), '|') AS cells FROM w""")
def square_rows(spark, d):
    li = table(spark, d, "lineitem")
    cells = F.slice(F.array("l_returnflag", F.lit(""), F.col("l_partkey").cast("string"), "l_linestatus"), F.lit(1), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = li.select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row_idx"), cells.alias("cells"))
    return C.square(rows).select("table_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("p03_valid_tables", f"WITH {_CELLS} SELECT table_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols FROM c GROUP BY table_id HAVING count(DISTINCT row_idx) >= 3")
def valid_tables(spark, d):
    return C.shape(_cells(spark, d)).where("n_rows >= 3")


@query("o06_o07_first_rows", f"WITH {_CELLS} SELECT table_id, row_idx, array_to_string(list_slice(list_concat(list(coalesce(value, 'null') ORDER BY col_idx), ['', '', '']), 1, 3), '|') AS cells FROM c WHERE row_idx < 2 GROUP BY ALL")
def first_rows(spark, d):
    return C.first_rows(_cells(spark, d).withColumn("value", F.coalesce("value", F.lit("null"))), 2, 3).withColumn("cells", F.array_join("cells", "|"))


@query("f33_d05_records", f"""WITH {_CELLS}, h AS (SELECT table_id, col_idx, value AS header FROM c WHERE row_idx = 0), b AS (SELECT c.table_id, c.row_idx, h.header, c.value, row_number() OVER (PARTITION BY c.table_id, c.row_idx, h.header ORDER BY c.col_idx DESC) AS n
  FROM c JOIN h USING (table_id, col_idx) WHERE c.row_idx > 0 AND h.header IS NOT NULL) SELECT table_id, row_idx, string_agg(header || '=' || coalesce(value, ''), ';' ORDER BY header) AS record FROM b WHERE n = 1 GROUP BY ALL""")
def records(spark, d):
    r = C.records(_cells(spark, d).where("row_idx > 0 OR value IS NOT NULL"))
    pair = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    return r.select("table_id", "row_idx", F.array_join(F.transform(F.array_sort(F.map_entries("record")), pair), ";").alias("record"))


@query("j18_a32_precision_recall", f"""WITH {_CELLS}, e AS (SELECT table_id, row_idx, col_idx, CASE WHEN (table_id + row_idx) % 7 = 0 THEN 'wrong' ELSE trim(value) END AS a FROM c WHERE (row_idx + col_idx) % 5 <> 4),
j AS (SELECT table_id, count(a) AS extracted, count(b) AS truth, count(*) FILTER (a = b) AS hits FROM (SELECT table_id, row_idx, col_idx, a, trim(value) AS b FROM c FULL JOIN e USING (table_id, row_idx, col_idx)) GROUP BY table_id)
SELECT table_id, extracted, truth, hits, round(hits / extracted::DOUBLE, 6) AS precision, round(hits / truth::DOUBLE, 6) AS recall FROM j""")
def precision_recall(spark, d):
    truth = _cells(spark, d)
    wrong = F.when((F.col("table_id") + F.col("row_idx")) % 7 == 0, "wrong").otherwise(F.col("value"))
    got = truth.where((F.col("row_idx") + F.col("col_idx")) % 5 != 4).withColumn("value", wrong)
    return _rounded(C.precision_recall(got, truth))


@query("m01_html_backend")
def html_backend(spark, d):
    return extract("html", table(spark, d, "pages").withColumnRenamed("page_id", "doc_id"))


@query("m01_html_elements", r"""SELECT page_id, trim(replace(replace(replace(replace(replace(array_to_string(regexp_extract_all(html, '<title>([^<]*)</title>', 1), ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS title FROM pages""")
def html_elements(spark, d):
    return table(spark, d, "pages").select("page_id", element(F.col("html"), "title").alias("title"))


@query("a14_text_stats", "SELECT lang, count(*) AS files, sum(length(text))::BIGINT AS chars, round(sum(length(text)) / count(*)::DOUBLE, 6) AS avg_chars FROM documents GROUP BY lang")
def text_stats(spark, d):
    from ..operators.methods import text_stats as stats

    return _rounded(stats(table(spark, d, "documents"), "lang"))


@query("p22_min_content", f"WITH {_LINES} SELECT doc_id, count(*) AS shown FROM l WHERE length(trim(line)) > 50 GROUP BY doc_id")
def min_content(spark, d):
    return B.lines(table(spark, d, "documents")).where(F.length(T.strip(F.col("line"))) > 50).groupBy("doc_id").agg(F.count("*").alias("shown"))


@query("m01_plain_text_length")
def plain_length(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(plain_text(F.col("html"))).alias("chars"))
