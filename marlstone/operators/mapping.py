"""Mapping of extracted labels to concepts. All work is done once per distinct label; the dictionary is broadcast (fixed size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config.labels import LABELS, STATEMENT_RULES
from ..functions.fuzzy import close_match, fuzzy_score, ratio
from ..functions.text import normalize_label, strip


def dictionary(df: DataFrame, labels: list[tuple[str, str]] = LABELS) -> DataFrame:
    rows = [(k, label, concept) for k, (label, concept) in enumerate(labels)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "ord int, pdf_key string, xconcept string"))


def rules(df: DataFrame) -> DataFrame:
    rows = [(k, s, w, c) for k, (s, w, c) in enumerate(STATEMENT_RULES)]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "ord int, statement_type string, words string, xconcept string"))


def direct(labels: DataFrame) -> DataFrame:
    """label -> concept by exact lookup of the normalised label, else the first entry with a fuzzy score of 0.75; null if none."""
    each = labels.select("label").distinct().withColumn("norm", normalize_label(F.col("label")))
    keys = dictionary(labels)
    exact = each.join(keys.select("pdf_key", F.col("xconcept").alias("exact")), F.col("norm") == F.col("pdf_key"), "left").drop("pdf_key")
    rest = exact.where("exact IS NULL").select("label", "norm").join(keys, F.lit(True))
    found = rest.where(fuzzy_score("norm", "pdf_key") >= 0.75).groupBy("label").agg(F.min_by("xconcept", "ord").alias("fuzzy"))
    return exact.join(found, "label", "left").select("label", "norm", F.coalesce("exact", "fuzzy").alias("concept"))


def in_context(labels: DataFrame) -> DataFrame:
    """(label, statement_type) -> concept: direct, then the statement's rules, then the closest entry whose fuzzy score is 0.45."""
    known = direct(labels)
    each = labels.select("label", "statement_type").distinct().join(known, "label")
    rule = rules(labels)
    hit = each.where("concept IS NULL").join(rule, (each.statement_type == rule.statement_type) & F.lower("norm").contains(F.col("words")))
    by_rule = hit.groupBy("label", each.statement_type).agg(F.min_by("xconcept", "ord").alias("by_rule"))
    open_labels = known.where("concept IS NULL").select("label", "norm")
    near = open_labels.join(dictionary(labels), F.lit(True)).where(fuzzy_score("norm", "pdf_key") >= 0.45)
    near = near.withColumn("s", ratio(F.lower("norm"), F.lower("pdf_key"))).where("s > 0")
    best = near.groupBy("label").agg(F.max_by("xconcept", F.struct("s", -F.col("ord"))).alias("by_score"))
    out = each.join(by_rule, ["label", "statement_type"], "left").join(best, "label", "left")
    return out.select("label", "statement_type", F.coalesce("concept", "by_rule", "by_score").alias("concept"))


def auto_map(labels: DataFrame, catalog: list[str] | None = None) -> DataFrame:
    """label -> concept: direct, then the closest dictionary entry, then the closest label of the official catalog (0.55 or more)."""
    known = direct(labels)
    table = F.create_map(*[F.lit(x) for pair in dict(LABELS).items() for x in pair])
    out = known.withColumn("near", F.try_element_at(table, close_match("norm", list(dict(LABELS)))))
    if catalog:
        from ..functions.fuzzy import normal

        names = {normal(c): c for c in catalog}
        back = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        out = out.withColumn("cat", F.try_element_at(back, close_match("norm", list(names))))
    else:
        out = out.withColumn("cat", F.lit(None).cast("string"))
    return out.select("label", F.coalesce("concept", "near", "cat").alias("concept"))


def map_or_keep(labels: DataFrame, catalog: list[str] | None = None) -> DataFrame:
    """(label, statement_type) -> concept: in context, else auto-mapped, else the label itself."""
    a = in_context(labels)
    b = auto_map(labels, catalog).withColumnRenamed("concept", "auto")
    return a.join(b, "label").select("label", "statement_type", F.coalesce("concept", "auto", "label").alias("concept"), F.coalesce("concept", "auto").isNotNull().alias("mapped"))


def coverage(mapped: DataFrame) -> DataFrame:
    """Share of labels that have a concept."""
    return mapped.agg(F.count("*").alias("labels"), F.count("concept").alias("mapped"), F.avg(F.col("concept").isNotNull().cast("double")).alias("coverage"))


def candidate_labels(cells: DataFrame) -> DataFrame:
    """Distinct labels of the tables' first columns: not blank or a null word, at most 200 characters."""
    label = strip(F.col("value"))
    ok = ~F.lower(label).isin("nan", "none", "") & (F.length(label) <= 200)
    return cells.where("col_idx = 0").select(label.alias("label")).where(F.col("label").isNotNull()).where(ok).distinct()


def top_per(df: DataFrame, by: list[str], *order) -> DataFrame:
    """First row of each group in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
