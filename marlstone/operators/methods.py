"""Comparison of extraction methods: roll-ups, scores, rankings, capabilities, gates, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config.keywords import CAPABILITIES, HAS, REGRESSION, THRESHOLDS, USE_CASES


def page_counters(pages: DataFrame, *by: str) -> DataFrame:
    """Pages in all, with a text layer, by OCR, failed; and the rates."""
    n, ocr, good = F.count("*"), F.count_if("used_ocr"), F.count_if("success")
    return pages.groupBy(*by).agg(n.alias("total_pages"), F.count_if(~F.col("used_ocr") & F.col("success")).alias("text_pages"), ocr.alias("ocr_pages"), (n - good).alias("failed_pages"), (ocr / F.greatest(n, F.lit(1))).alias("ocr_usage_rate"), (good / F.greatest(n, F.lit(1))).alias("success_rate"))


def layout_summary(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Totals, counts by type as a map, success rate in percent."""
    kinds = blocks.groupBy("block_type").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("block_type", "count")))).alias("by_type"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_blocks"))
    p = pages.agg((F.count_if("success") / F.greatest(F.count("*"), F.lit(1)) * 100).alias("success_rate"))
    return kinds.crossJoin(p)  # one row each


def text_stats(files: DataFrame, *by: str) -> DataFrame:
    n, chars = F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))
    return files.groupBy(*by).agg(n.alias("files"), chars.alias("chars"), (chars / F.greatest(n, F.lit(1))).alias("avg_chars"))


def quality_score(chars: Column, ordered: Column, structured: Column, tables: Column, keeps_structure: Column, boxes: Column, tree: Column, reading: Column, capabilities: Column, formats: Column) -> Column:
    """0 to 100: text 30, tables 25, structure 25, features 2 each."""
    b = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    points = b(chars > 0) * 10 + b(ordered) * 10 + b(structured) * 10 + F.least(tables * 5, F.lit(15)) + b(keeps_structure) * 10 + b(boxes) * 5 + b(tree) * 10 + b(reading) * 10 + (capabilities + formats) * 2
    return F.least(points, F.lit(100))


def rank(df: DataFrame, score: str, name: str, ord: str, ascending: bool = False) -> DataFrame:
    """Place of each row by score; ties keep the order ``ord``. The input is one row per method."""
    by = F.asc(score) if ascending else F.desc(score)
    return df.withColumn(name, F.row_number().over(Window.orderBy(by, F.asc(ord))))


def efficiency(df: DataFrame) -> DataFrame:
    """Seconds per page and rank; methods without a time aren't ranked. df: method, seconds, pages, ord."""
    timed = df.withColumn("per_page", F.col("seconds") / F.greatest("pages", F.lit(1))).where("per_page > 0")
    return rank(timed, "per_page", "place", "ord", ascending=True)


def capabilities(spark) -> DataFrame:
    """method, capability, has: every pair."""
    methods = spark.createDataFrame([(m,) for m in HAS], "method string")
    caps = spark.createDataFrame([(c,) for c in CAPABILITIES], "capability string")
    have = spark.createDataFrame([(m, c) for m, cs in HAS.items() for c in cs], "method string, capability string").withColumn("y", F.lit(True))
    return methods.crossJoin(caps).join(F.broadcast(have), ["method", "capability"], "left").select("method", "capability", F.coalesce("y", F.lit(False)).alias("has"))  # fixed, small sets


def use_cases(methods: DataFrame) -> DataFrame:
    """Use cases whose method is among the available ones."""
    cases = methods.sparkSession.createDataFrame(USE_CASES, "use_case string, method string")
    return cases.join(methods.select("method"), "method", "left_semi")


def thresholds(spark, rows: list = THRESHOLDS) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, "method string, wer_maximum double, precision_minimum double, recall_minimum double"))


def gate(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """metrics: method, wer, precision, recall. Adds failures and passed; what has no bound or no value passes."""
    j = metrics.join(bounds, "method", "left")
    fails = F.array_compact(F.array(
        F.when(F.col("wer") > F.col("wer_maximum"), F.format_string("wer %.3f > %.3f", "wer", "wer_maximum")),
        F.when(F.col("precision") < F.col("precision_minimum"), F.format_string("precision %.3f < %.3f", "precision", "precision_minimum")),
        F.when(F.col("recall") < F.col("recall_minimum"), F.format_string("recall %.3f < %.3f", "recall", "recall_minimum")),
    ))
    return j.select("method", "wer", "precision", "recall", fails.alias("failures"), (F.size(fails) == 0).alias("passed"))


def regressions(current: DataFrame, baseline: DataFrame, most: dict[str, float] = REGRESSION) -> DataFrame:
    """Methods in both: change of each metric and whether it is a regression."""
    b = baseline.select("method", *[F.col(c).alias(f"base_{c}") for c in most])
    j = current.join(b, "method")
    worse = {"wer": F.col("wer") - F.col("base_wer"), **{c: F.col(f"base_{c}") - F.col(c) for c in ("precision", "recall")}}
    bad = F.array_compact(F.array(*[F.when(d > most[c] + 1e-12, c) for c, d in worse.items()]))
    return j.select("method", *[d.alias(f"{c}_loss") for c, d in worse.items()], bad.alias("regressed"))


def metrics_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new: file, key, value. Change and arrow of every key of either side."""
    j = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), ["file", "key"], "full_outer")
    d = F.col("new") - F.col("old")
    arrow = F.when(F.col("old").isNull(), "+").when(F.col("new").isNull(), "-").when(d > 0, "↑").when(d < 0, "↓").otherwise("=")
    return j.select("file", "key", "old", "new", d.alias("delta"), arrow.alias("arrow"))


def check_metrics(metrics: DataFrame, required: list[str]) -> DataFrame:
    """Problems of a metrics relation: required methods that are missing, precision or recall not above 0 (but for docling)."""
    need = metrics.sparkSession.createDataFrame([(m,) for m in required], "method string")
    gone = need.join(metrics, "method", "left_anti").select("method", F.lit("missing").alias("problem"))
    low = F.coalesce(F.col("precision") > 0, F.lit(False)) & F.coalesce(F.col("recall") > 0, F.lit(False))
    return gone.unionByName(metrics.where(~low & (F.col("method") != "docling")).select("method", F.lit("not_positive").alias("problem")))


def chunk_drift(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Per method and run: mean length of its chunks and the change from the run before. chunks: method, run, text."""
    m = chunks.groupBy("method", "run").agg(F.count("*").alias("chunks"), F.avg(F.length(text)).alias("mean_chars"))
    return m.withColumn("drift", F.col("mean_chars") - F.lag("mean_chars").over(Window.partitionBy("method").orderBy("run")))


def recommendations(standard: Column, custom: Column, financial: Column) -> Column:
    """Advice from the number of tables that each strategy found."""
    return F.array_compact(F.array(
        F.when(financial > 0, F.format_string("%d financial tables: prefer the financial strategy for statements", financial)),
        F.when(custom > standard, F.lit("custom settings found more: tables are regular")).when(standard > custom, F.lit("standard settings suffice: tables have borders")),
        F.when(F.greatest(standard, custom, financial) == 0, F.lit("no tables: text is unstructured or scanned")),
    ))
