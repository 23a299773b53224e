"""Tables as cells: table_id, row_idx, col_idx, header, value. Grids are regrouped only to be rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config.keywords import CONTENT_WORDS, PAGE_WORDS, TABLE_WORDS
from ..config.labels import STATEMENT_WORDS
from ..functions.text import any_of, how_many, is_rule_line, is_table_line, row_cells, strip
from .blocks import lines

KEY = "table_id"


def markdown_tables(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """Maximal runs of at least two lines with two pipes or more, numbered from 1 per text: key, table_no, i, line."""
    each = lines(df, key, text).withColumn("t", is_table_line(F.col("line")) & ((F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))) >= 2))
    run = each.withColumn("run", F.sum((~F.col("t")).cast("int")).over(Window.partitionBy(key).orderBy("i"))).where("t")
    run = run.withColumn("n", F.count("*").over(Window.partitionBy(key, "run"))).where(F.col("n") >= least)
    return run.select(key, F.dense_rank().over(Window.partitionBy(key).orderBy("run")).alias("table_no"), "i", "line")


def markdown_cells(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Cells of Markdown tables; separator lines are dropped, the first line is the header (row 0)."""
    rows = tables.where(~is_rule_line(F.col("line"))).withColumn("row_idx", F.row_number().over(Window.partitionBy(key, "table_no").orderBy("i")) - 1)
    return rows.select(F.concat_ws("_", key, "table_no").alias(KEY), "row_idx", F.posexplode(row_cells(F.col("line"))).alias("col_idx", "value"))


def square(rows: DataFrame) -> DataFrame:
    """Ragged rows (table_id, row_idx, cells) to rectangular ones: width is the widest row's; blanks are filled, headers named Col_j."""
    wide = rows.withColumn("w", F.max(F.size("cells")).over(Window.partitionBy(KEY)))
    filled = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda j: F.coalesce(F.nullif(F.get("cells", j), F.lit("")), F.when(F.col("row_idx") == 0, F.concat(F.lit("Col_"), j.cast("string"))).otherwise("")))
    return wide.select(KEY, "row_idx", filled.alias("cells"))


def clean(cells: DataFrame) -> DataFrame:
    """Without all-null rows, then all-null columns; nulls become empty, values are stripped."""
    full = cells.withColumn("r", F.count("value").over(Window.partitionBy(KEY, "row_idx"))).where("r > 0")
    full = full.withColumn("c", F.count("value").over(Window.partitionBy(KEY, "col_idx"))).where("c > 0").drop("r", "c")
    return full.withColumn("value", F.coalesce(strip(F.col("value")), F.lit("")))


def shape(cells: DataFrame) -> DataFrame:
    """Rows and columns of each table, nulls apart. (Two distinct counts side by side would shuffle cells that already lie by table.)"""
    at = F.inline(F.array(F.struct(F.lit(0).alias("axis"), F.col("row_idx").alias("at")), F.struct(F.lit(1).alias("axis"), F.col("col_idx").alias("at"))))
    each = cells.select(KEY, at).distinct()
    return each.groupBy(KEY).agg(*[F.count(F.when(F.col("axis") == k, F.col("at"))).alias(n) for k, n in enumerate(("n_rows", "n_cols"))])


def columns_numeric(cells: DataFrame) -> DataFrame:
    """Per column: rows and the share that is numeric."""
    number = F.col("value").try_cast("double")
    return cells.groupBy(KEY, "col_idx").agg(F.count("*").alias("n"), (F.count(number) / F.count("*")).alias("numeric"), F.count("value").alias("filled"), F.count_if(strip(F.col("value")) != "").alias("non_blank"))


def quality(cells: DataFrame) -> DataFrame:
    """quality_score as the weights have it (up to 10 000), quality_pct (up to 100) and non_blank_share per table."""
    t = columns_numeric(cells).groupBy(KEY).agg(F.max("n").alias("r"), F.count("*").alias("c"), F.avg("numeric").alias("numeric"), (F.sum("filled") / F.sum("n")).alias("complete"), (F.sum("non_blank") / F.sum("n")).alias("non_blank_share"))
    raw = (F.col("complete") * 40 + F.least("r", "c") / F.greatest("r", "c") * 30 + F.least(F.lit(1.0), "numeric") * 30) * 100
    score = F.round(raw, 2)
    return t.select(KEY, F.col("r").cast("long").alias("n_rows"), F.col("c").cast("long").alias("n_cols"), score.alias("quality_score"), F.round(score / 100, 4).alias("quality_pct"), "non_blank_share")


def table_text(cells: DataFrame, row_end: str = "\n", between: str = ",") -> DataFrame:
    """Each table as text, rows in order."""
    rows = cells.groupBy(KEY, "row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda c: F.coalesce(c["value"], F.lit(""))), between).alias("line"))
    return rows.groupBy(KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "line"))), lambda r: r["line"]), row_end).alias("text"))


def financial_page(text: Column, words: list[str] = PAGE_WORDS) -> Column:
    return any_of(F.lower(text), words)


def financial_words(text: Column, words: list[str] = PAGE_WORDS) -> Column:
    return how_many(F.lower(text), words)


def is_financial_content(text: Column, words: list[str] = CONTENT_WORDS) -> Column:
    return how_many(F.lower(text), words) >= 3


def is_financial(cells: DataFrame, words: list[str] = TABLE_WORDS) -> DataFrame:
    """Three indicator words, or two columns that are more than half numeric."""
    cols = columns_numeric(cells).groupBy(KEY).agg(F.count_if(F.col("numeric") > 0.5).alias("numeric_columns"))
    text = table_text(cells).select(KEY, how_many(F.lower("text"), words).alias("words"))
    return cols.join(text, KEY).select(KEY, "numeric_columns", "words", ((F.col("words") >= 3) | (F.col("numeric_columns") >= 2)).alias("is_financial"))


def statement_type(text: Column, kinds: list[tuple[str, list[str]]] = STATEMENT_WORDS) -> Column:
    """income_statement, balance_sheet or cash_flow by the first list with a word in the text; else null."""
    out = F.lit(None).cast("string")
    for kind, words in reversed(kinds):
        out = F.when(any_of(F.lower(text), words), kind).otherwise(out)
    return out


def records(cells: DataFrame) -> DataFrame:
    """Rows as maps header -> value (a repeated header: the last wins): table_id, row_idx, record."""
    from pyspark.sql import Window as W

    head = cells.where("row_idx = 0").select(KEY, "col_idx", F.col("value").alias("header"))
    body = cells.where("row_idx > 0").join(head, [KEY, "col_idx"])
    last = body.withColumn("_n", F.row_number().over(W.partitionBy(KEY, "row_idx", "header").orderBy(F.desc("col_idx")))).where("_n = 1")
    return last.groupBy(KEY, "row_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", "value")))).alias("record"))


def first_rows(cells: DataFrame, rows: int = 10, cols: int = 4) -> DataFrame:
    """The first rows, cut or padded to so many cells."""
    r = cells.where(F.col("row_idx") < rows).groupBy(KEY, "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda c: c["value"]).alias("v"))
    return r.select(KEY, "row_idx", F.slice(F.concat("v", F.array_repeat(F.lit(""), cols)), 1, cols).alias("cells"))


def strategy_rollup(infos: DataFrame, by: str = "method") -> DataFrame:
    return infos.groupBy(by).agg(F.count("*").alias("tables"), F.count_if("is_financial").alias("financial"), F.avg("quality_score").alias("avg_quality"))


def precision_recall(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per table, on position and stripped value: extracted, true and matching cells, precision and recall."""
    key = [KEY, "row_idx", "col_idx"]
    a = extracted.select(*key, strip(F.col("value")).alias("a"))
    b = truth.select(*key, strip(F.col("value")).alias("b"))
    j = a.join(b, key, "full_outer").groupBy(KEY).agg(F.count("a").alias("extracted"), F.count("b").alias("truth"), F.count_if(F.col("a") == F.col("b")).alias("hits"))
    return j.withColumn("precision", F.try_divide("hits", "extracted")).withColumn("recall", F.try_divide("hits", "truth"))


def micro_macro(pr: DataFrame) -> DataFrame:
    s = lambda c: F.sum(c).cast("double")
    return pr.agg(F.try_divide(s("hits"), s("extracted")).alias("micro_precision"), F.try_divide(s("hits"), s("truth")).alias("micro_recall"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
