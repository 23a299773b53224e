"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators.blocks import lines
from .registry import query, table

PART_LABEL = "concat(p_partkey % 9, '. ', p_name, '  (net) & $', p_size, ',5% o''x')"


@query("f01_normalize_label", rf"""
SELECT p_partkey, trim(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({PART_LABEL}, '^\s+|\s+$', '', 'g'),
  '\s+', ' ', 'g'), '^\d+\.\s*', ''), '\(.*?\)', '', 'g'), '[$'',]', '', 'g'), '&', 'and'), '%', '')) AS label FROM part
""")
def normalize_label(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalize_label(F.expr(PART_LABEL.replace("''", "\\'"))).alias("label"))


FILE_NAME = "concat(CASE p_size % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'custom' WHEN 2 THEN 'financial' ELSE 'other' END, CASE WHEN p_size % 3 = 0 THEN '_p_' ELSE '_page_' END, p_partkey, '_table_', p_size, '.csv')"


@query("f02_f03_file_names", rf"""
SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(n, 'page_(\d+)', 1), '') AS INT), 1) AS page,
  CASE WHEN starts_with(n, 'standard_') THEN 'standard' WHEN starts_with(n, 'custom_') THEN 'custom' WHEN starts_with(n, 'financial_') THEN 'financial' ELSE 'unknown' END AS kind
FROM (SELECT p_partkey, {FILE_NAME} AS n FROM part)
""")
def file_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(FILE_NAME).alias("n"))
    return p.select("p_partkey", T.page_number(F.col("n")).alias("page"), T.table_type(F.col("n")).alias("kind"))


HEADING = "CASE p_partkey % 8 WHEN 0 THEN concat('Item ', p_size, 'A. ', p_name) WHEN 1 THEN concat('Part I', p_brand) WHEN 2 THEN upper(p_name) WHEN 3 THEN 'Business' WHEN 4 THEN concat('part ', p_name) WHEN 5 THEN upper(p_type) WHEN 6 THEN 'Annual Report' ELSE p_type END"


@query("f04_f05_p15_headings", rf"""
SELECT p_partkey, CASE WHEN regexp_matches(h, '^Part\s+[IVX]+') THEN 2 WHEN regexp_matches(h, '^Item\s+\d+') THEN 3 WHEN h IN ('Our Company', 'Business', 'Risk Factors') THEN 2
    WHEN up AND length(h) < 30 THEN 3 ELSE 4 END AS line_level,
  CASE WHEN regexp_matches(upper(trim(h)), 'SECURITIES AND EXCHANGE COMMISSION|ANNUAL REPORT|FORM 10-K|PART I') THEN 2
    WHEN regexp_matches(upper(trim(h)), 'ITEM [1-5]|BUSINESS|RISK FACTORS|PROPERTIES') THEN 3 ELSE 4 END AS title_level,
  regexp_matches(h, '^Part\s+[IVX]+|^Item\s+\d+[A-Z]?\.?|^[A-Z][A-Z\s]+$|^Business$|^Risk Factors$|^Properties$|^Our Company$|^Forward-Looking Statements$')
    OR (up AND length(h) < 50 AND len(list_filter(regexp_split_to_array(h, '\s+'), lambda w: w <> '')) <= 6) AS is_heading
FROM (SELECT p_partkey, h, upper(h) = h AND lower(h) <> h AS up FROM (SELECT p_partkey, {HEADING} AS h FROM part))
""")
def headings(spark, d):
    p, h = table(spark, d, "part").select("p_partkey", F.expr(HEADING).alias("h")), F.col("h")
    return p.select("p_partkey", T.line_level(h).alias("line_level"), T.title_level(h).alias("title_level"), T.is_heading(h).alias("is_heading"))


LINKED = "concat(CASE WHEN p_size % 2 = 0 THEN '☐ ' ELSE '☒ ' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ' https://a.example/x www.b.example' WHEN 1 THEN ' www.c.example/q?z=1 end' ELSE '' END)"


@query("f06_checkboxes_links", rf"""
SELECT p_partkey, replace(replace(x, '☐', '- [ ]'), '☒', '- [x]') AS boxes,
  regexp_replace(regexp_replace(regexp_replace(x, '(https?://[^\s<>"{{}}|\\^`\[\]]+|www\.[^\s<>"{{}}|\\^`\[\]]+)', '[\1](\1)', 'g'), '\]\(www\.', '](http://www.', 'g'), '$', '') AS linked
FROM (SELECT p_partkey, {LINKED} AS x FROM part)
""")
def links(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(LINKED).alias("x"))
    return p.select("p_partkey", T.checkboxes(F.col("x")).alias("boxes"), T.links(F.col("x")).alias("linked"))


@query("f13_text_counts", r"""
SELECT doc_id, length(text) AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, len(string_split(text, chr(10))) AS line_count FROM documents
""")
def text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), T.word_count(t).alias("words"), F.size(F.split(t, "\n", -1)).cast("long").alias("line_count"))


TAG_WORDS = [("ing", ["tioning", "thing"]), ("que", ["que", "ción"]), ("noun", ["ung", "keit"]), ("mark", ["!!", "$$$"])]


@query("f14_semantic_tags", r"""
WITH d AS (SELECT doc_id, lower(text) AS t, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, len(string_split(text, chr(10))) AS s FROM documents)
SELECT doc_id, array_to_string(list_filter([
  CASE WHEN regexp_matches(t, 'financial|annual report|10-k|earnings|revenue') THEN 'financial_document' END,
  CASE WHEN regexp_matches(t, 'technical|specification|manual|documentation') THEN 'technical_document' END,
  CASE WHEN regexp_matches(t, 'research|study|analysis|methodology') THEN 'research_document' END,
  CASE WHEN contains(t, 'table') THEN 'contains_tables' END, CASE WHEN regexp_matches(t, 'figure|chart|graph') THEN 'contains_figures' END,
  CASE WHEN regexp_matches(t, 'formula|equation|calculation') THEN 'contains_formulas' END,
  CASE WHEN n > 10000 THEN 'long_document' WHEN n < 1000 THEN 'short_document' ELSE 'medium_document' END,
  CASE WHEN s > 10 THEN 'well_structured' WHEN s < 3 THEN 'minimal_structure' END], lambda x: x IS NOT NULL), ',') AS tags FROM d
""")
def semantic_tags(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(T.tags(F.col("text"), F.size(F.split("text", "\n", -1))), ",").alias("tags"))


PERCENT = "CASE p_size % 5 WHEN 0 THEN concat('~', p_size, '%') WHEN 1 THEN concat(p_size, '-', p_size + 4, '%*') WHEN 2 THEN 'N/A' WHEN 3 THEN '' ELSE concat(' ', p_size, '.5 %') END"


@query("f15_percent_cells", rf"""
SELECT p_partkey, round(CASE WHEN contains(y, '-') THEN (try_cast(trim(split_part(y, '-', 1)) AS DOUBLE) + try_cast(trim(split_part(y, '-', 2)) AS DOUBLE)) / 200 ELSE try_cast(y AS DOUBLE) / 100 END, 6) AS share
FROM (SELECT p_partkey, trim(regexp_replace({PERCENT}, '[%~*]|N/A', '', 'g')) AS y FROM part)
""")
def percent_cells(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(T.percent(F.expr(PERCENT)), 6).alias("share"))


PERIOD = "CASE o_orderkey % 9 WHEN 0 THEN 'Jan 28, 2024' WHEN 1 THEN ' January 29, 2023 ' WHEN 2 THEN 'FY2022' WHEN 3 THEN 'Year Ended.1' WHEN 4 THEN 'Year Ended.2' WHEN 5 THEN 'Year Ended' WHEN 6 THEN 'Q3' WHEN 7 THEN '' ELSE 'nan' END"
_PERIOD_SQL = r"""CASE WHEN contains(c, 'jan 28, 2024') OR contains(c, 'january 28, 2024') THEN '2024-01-28' WHEN contains(c, 'jan 29, 2023') OR contains(c, 'january 29, 2023') THEN '2023-01-29'
  WHEN contains(c, 'jan 30, 2022') OR contains(c, 'january 30, 2022') THEN '2022-01-30' WHEN contains(l, '2024') THEN '2024-01-28' WHEN contains(l, '2023') THEN '2023-01-29' WHEN contains(l, '2022') THEN '2022-01-30'
  WHEN contains(l, 'year ended') THEN CASE WHEN contains(l, '.2') THEN '2022-01-30' WHEN contains(l, '.1') THEN '2023-01-29' ELSE '2024-01-28' END ELSE h END"""


@query("f17_f18_w08_periods", rf"""
WITH p AS (SELECT o_orderkey, h, lower(trim(h)) AS l, trim(regexp_replace(lower(trim(h)), '[^\w\s,]', '', 'g')) AS c, o_custkey % 4 AS pos FROM (SELECT o_orderkey, o_custkey, {PERIOD} AS h FROM orders))
SELECT o_orderkey, {_PERIOD_SQL} AS period,
  CASE WHEN l IN ('nan', 'none', '') THEN CASE pos WHEN 0 THEN '2024-01-28' WHEN 1 THEN '2023-01-29' WHEN 2 THEN '2022-01-30' END ELSE {_PERIOD_SQL} END AS column_period FROM p
""")
def periods(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(PERIOD).alias("h"), (F.col("o_custkey") % 4).alias("pos"))
    return o.select("o_orderkey", V.period(F.col("h")).alias("period"), V.column_period(F.col("h"), F.col("pos")).alias("column_period"))


MONEY = "CASE l_linenumber % 7 WHEN 0 THEN concat('$ ', cast(l_quantity AS int), ',', 100 + l_suppkey % 900) WHEN 1 THEN concat('(', cast(l_quantity AS int), '.', l_suppkey % 90 + 10, ')') WHEN 2 THEN concat(cast(l_quantity AS int), ' million') WHEN 3 THEN '-' WHEN 4 THEN concat(cast(l_quantity AS int), 'B') WHEN 5 THEN 'n/a' ELSE 'text' END"


@query("f20_money", rf"""
SELECT l_orderkey, l_linenumber, CASE WHEN lower(x) NOT IN ('nan', 'none', '', '-', 'n/a') THEN
  try_cast(regexp_replace(replace(regexp_replace(x, '[$,)]', '', 'g'), '(', '-'), '[^0-9.\-]', '', 'g') AS DOUBLE) * CASE WHEN contains(lower(x), 'm') THEN 1e6 WHEN contains(lower(x), 'b') THEN 1e9 ELSE 1.0 END END AS amount
FROM (SELECT l_orderkey, l_linenumber, {MONEY} AS x FROM lineitem)
""")
def money(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.money(F.expr(MONEY)).alias("amount"))


@query("f25_coherence", r"""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, round(least(1.0, least(1.0, length(array_to_string(w, ''))::DOUBLE / len(w) / 6) * 0.2 + least(1.0, len(w)::DOUBLE / len(string_split(text, '.')) / 20) * 0.3
  + least(1.0, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: trim(p) <> ''))::DOUBLE * 2 / len(string_split(text, chr(10)))) * 0.2
  + len(list_distinct(string_split(lower(array_to_string(w, ' ')), ' ')))::DOUBLE / len(w) * 0.3), 6) AS coherence FROM d
""")
def coherence(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.coherence(F.col("text")), 6).alias("coherence"))


@query("f26_f32_caps_and_rates", r"""
SELECT doc_id, round(least(1.0, n_chars / 10000.0), 6) AS length_score, round(least(1.0, doc_id / 50.0), 6) AS section_score, CASE WHEN doc_id > 0 THEN round(60.0 / doc_id, 6) END AS efficiency,
  round(n_chars / greatest(doc_id % 7, 1)::DOUBLE, 6) AS per_page FROM documents
""")
def caps(spark, d):
    one = F.lit(1.0)
    return table(spark, d, "documents").select(
        "doc_id", F.round(F.least(one, F.col("n_chars") / 10000.0), 6).alias("length_score"), F.round(F.least(one, F.col("doc_id") / 50.0), 6).alias("section_score"),
        F.round(F.try_divide(F.lit(60.0), F.col("doc_id")), 6).alias("efficiency"), F.round(F.col("n_chars") / F.greatest(F.col("doc_id") % 7, F.lit(1)), 6).alias("per_page"),
    )


@query("f12_formats", r"""
SELECT l_orderkey, l_linenumber, 'table_' || lpad(l_linenumber::VARCHAR, 3, '0') AS id, printf('%.2f', l_quantity) AS quantity, format('{:,}', l_partkey) AS part FROM lineitem
""")
def formats(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.format_string("table_%03d", "l_linenumber").alias("id"), F.format_string("%.2f", "l_quantity").alias("quantity"), F.format_number("l_partkey", 0).alias("part"))


@query("f36_checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksums(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("unknown_checksum")).alias("checksum"))


@query("p02_text_layer", r"SELECT doc_id, i - 1 AS i, length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 10 AS native FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def text_layer(spark, d):
    return lines(table(spark, d, "documents")).select("doc_id", "i", T.keep_text_layer(F.col("line")).alias("native"))


@query("p16_p27_math_and_csv", r"""
SELECT doc_id, regexp_matches(text, '[∑∫∂∆∇±≤≥≠≈∞∝∴∵∈∉⊂⊃∪∩∅√∛∜²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉αβγδεθλμπσφψω]|\\frac|\\sum|\\int|\\partial|\\delta|\\nabla') AS math,
  contains(text, chr(10)) AND regexp_matches(text, '[,\t]') AS csv FROM documents
""")
def math(spark, d):
    return table(spark, d, "documents").select("doc_id", T.has_math(F.col("text")).alias("math"), T.looks_like_csv(F.col("text")).alias("csv"))


@query("p25_a33_cloud_cost", r"""
SELECT p_partkey, (p_size % 10) / 10.0 < 0.95 OR (p_partkey % 10) / 10.0 < 0.7 OR p_size > 45 OR p_partkey % 97 = 0 AS cloud, round(greatest(p_size - 10, 0) * 0.015::DOUBLE, 6) AS cost FROM part
""")
def cloud(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", V.use_cloud((c("p_size") % 10) / 10.0, (c("p_partkey") % 10) / 10.0, c("p_size") > 45, c("p_partkey") % 97 == 0).alias("cloud"), F.round(V.price(c("p_size"), free=10), 6).alias("cost"))


@query("a31_char_error_rate", r"""WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM benchmark), h AS (SELECT *, replace(replace(t, 'the', 'teh'), 'an', '') || CASE WHEN item_id % 3 = 0 THEN ' extra' ELSE '' END AS h FROM t)
SELECT item_id, round(levenshtein(t, h) / length(t)::DOUBLE, 6) AS cer FROM h""")
def cer(spark, d):
    """Whole texts of the benchmark against a copy with errors all over (DuckDB counts bytes, so other characters are masked)."""
    from ..functions.fuzzy import char_error_rate

    t = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("t"))
    h = t.withColumn("h", F.expr("concat(replace(replace(t, 'the', 'teh'), 'an', ''), CASE WHEN item_id % 3 = 0 THEN ' extra' ELSE '' END)"))
    return h.select("item_id", F.round(char_error_rate(F.col("t"), F.col("h")), 6).alias("cer"))


@query("a31_text_error_rate")
def text_cer(spark, d):
    """Whole texts of all documents, with errors all over; too slow for SQL."""
    from ..functions.fuzzy import text_error_rate

    read = F.expr(r"concat(translate(replace(text, 'rn', 'm'), '\n', ' '), CASE WHEN doc_id % 3 = 0 THEN ' extra' ELSE '' END)")
    return table(spark, d, "documents").select("doc_id", F.round(text_error_rate(F.col("text"), read), 6).alias("cer"))


@query("a31_word_error_rate")
def wer(spark, d):
    """Whole texts: a benchmark item against the line of a document that holds it would be exact; here each text against its lower-cased self."""
    from ..functions.fuzzy import word_error_rate

    docs = table(spark, d, "benchmark")
    return docs.select("item_id", F.round(word_error_rate(F.col("text"), F.lower("text")), 6).alias("wer"))


@query("u04_jaccard", r"""
WITH t AS (SELECT item_id, text, list_distinct(string_split(lower(text), ' ')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))::DOUBLE, 6) AS jaccard
FROM t a JOIN t b ON b.item_id = a.item_id + 1
""")
def jaccard(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), t.select(F.col("item_id").alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")), 6).alias("jaccard"))
