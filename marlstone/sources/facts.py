"""Official facts: wide CSV with a column per period, to long rows, picks and wide metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config.labels import METRIC_TERMS
from ..functions.text import strip

DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def read_csv(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Facts of a CSV with header, long: row_id, concept, period, value. The label column is ``label``, else the fifth if unnamed, else Concept.

    Row ids are those of a file scan (partition and place in it): increasing in file order for one file.
    """
    wide = spark.read.csv(path, header=True)
    name = label or next((c for c in wide.columns if c in ("_c4", "Unnamed: 4")), "Concept")
    return unpivot(wide.withColumn("row_id", F.monotonically_increasing_id()), name)


def unpivot(wide: DataFrame, label: str) -> DataFrame:
    """Long rows of the columns named as dates; commas are dropped from figures, what isn't a number is null."""
    dates = [c for c in wide.columns if DATE.match(c)]
    long = wide.select("row_id", F.col(label).alias("concept"), *[F.col(f"`{d}`").cast("string").alias(d) for d in dates])
    long = long.unpivot(["row_id", "concept"], dates, "period", "raw")
    return long.select("row_id", "concept", "period", F.replace("raw", F.lit(","), F.lit("")).try_cast("double").alias("value"))


def catalog(facts: DataFrame) -> DataFrame:
    return facts.select(strip(F.col("concept")).alias("concept")).where("concept IS NOT NULL").distinct()


def pick_metrics(facts: DataFrame, terms: list = METRIC_TERMS) -> DataFrame:
    """Per period and metric the value that a scan in row order settles on: the first hit of a term, replaced by any later row equal to a
    term; the scan stops at a row equal to the first term once a value is held."""
    rows = [(m, t, k) for m, ts in terms for k, t in enumerate(ts)]
    words = F.broadcast(facts.sparkSession.createDataFrame(rows, "metric string, term string, k int"))
    each = facts.withColumn("low", F.lower(strip(F.col("concept")))).where("value IS NOT NULL AND low <> ''")
    hit = each.join(words, F.col("low").contains(F.col("term")))
    hit = hit.groupBy("metric", "period", "row_id").agg(F.max(F.col("low") == F.col("term")).alias("exact"), F.max((F.col("low") == F.col("term")) & (F.col("k") == 0)).alias("stop"), F.first("value").alias("value"))
    w = Window.partitionBy("metric", "period").orderBy("row_id")
    live = hit.withColumn("stopped", F.coalesce(F.sum(F.col("stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("stopped = 0")
    return live.groupBy("metric", "period").agg(F.max_by("value", F.struct(F.col("exact"), F.when(F.col("exact"), F.col("row_id")).otherwise(-F.col("row_id")))).alias("value"))


def wide_metrics(picked: DataFrame, terms: list = METRIC_TERMS) -> DataFrame:
    return picked.groupBy("period").pivot("metric", [m for m, _ in terms]).agg(F.first("value"))
