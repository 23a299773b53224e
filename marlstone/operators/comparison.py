"""Comparison of what several methods made of each document: one row per document and method, rankings, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config.methods import ADVANTAGES, PROFILES, RESULT_FILES
from .methods import quality_score


def profiles(spark: SparkSession) -> DataFrame:
    """One row per method, in order: what is known of it beforehand. Fixed size, so it is broadcast."""
    rows = [(k, m, p["organization"], p["table_method"], p["special"], p["formats"], p["advanced"], p["strengths"], p["limitations"]) for k, (m, p) in enumerate(PROFILES.items())]
    return F.broadcast(spark.createDataFrame(rows, "ord int, method string, organization string, table_method string, special array<string>, formats array<string>, advanced array<string>, strengths array<string>, limitations array<string>"))


def result_figures(files: DataFrame, names: list[str] = RESULT_FILES) -> DataFrame:
    """files: folder, file, text (JSON). Seconds and pages by the first of ``names`` that a folder has; 0 where it has none of them or it can't be read."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("file"))
    first = files.withColumn("_p", place).where("_p > 0").groupBy("folder").agg(F.min_by("text", "_p").alias("j"))
    number = lambda *paths: F.coalesce(*[F.get_json_object("j", p).try_cast("double") for p in paths], F.lit(0.0))
    seconds = number("$.processing_time_seconds", "$.extraction_summary.processing_time_seconds")
    pages = number("$.total_pages", "$.document_analysis.total_pages").cast("long")
    return files.select("folder").distinct().join(first, "folder", "left").select("folder", seconds.alias("seconds"), pages.alias("pages"))


def method_rows(found: DataFrame) -> DataFrame:
    """found: doc_id, method, text_files, chars, csv_files, json_files, box_folder, seconds, pages. Adds the method's profile, what it
    preserves, score, time per page and both places; methods without a time have no place by speed."""
    j = found.join(profiles(found.sparkSession), "method")
    doc, lay = F.col("method") == "docling", F.col("method") == "layout_parser"
    boxes = lay | F.coalesce(F.col("box_folder"), F.lit(False))
    score = quality_score(F.col("chars"), doc, F.col("organization").isin("semantic_structure", "block_based"), F.col("csv_files"), F.lit(True), boxes, doc, doc, F.size("special"), F.size("formats"))
    j = j.withColumns({"has_bounding_boxes": boxes, "has_reading_order": doc, "score": score, "per_page": F.col("seconds") / F.greatest("pages", F.lit(1))})
    quality = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "ord"))
    timed = F.col("per_page") > 0
    speed = F.row_number().over(Window.partitionBy("doc_id", timed).orderBy("per_page", "ord"))
    return j.withColumn("quality_place", quality).withColumn("speed_place", F.when(timed, speed))


def comparison_csv(rows: DataFrame) -> DataFrame:
    """The columns of the comparison's CSV, a row per document and method."""
    return rows.select("method", F.col("doc_id").alias("pdf_name"), "text_files", F.col("chars").alias("total_characters"), F.col("csv_files").alias("tables_found"), F.col("seconds").alias("processing_time"), F.col("pages").alias("pages_processed"), "has_bounding_boxes", "has_reading_order", F.size("formats").alias("output_formats"))


def _by_document(rows: DataFrame) -> DataFrame:
    """One row per document: its methods in order (at most one element per method), by quality and by speed; best of each; overall best."""
    each = F.struct("ord", "method", "score", "per_page")
    sorted_by = lambda key, when=None: F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), each.alias("m")) if when is None else F.when(when, F.struct(F.col(key).alias("k"), each.alias("m")))))
    g = rows.groupBy("doc_id").agg(sorted_by("ord").alias("_o"), sorted_by("quality_place").alias("_q"), sorted_by("speed_place", F.col("speed_place").isNotNull()).alias("_s"))
    g = g.select("doc_id", *[F.transform(c, lambda v: v["m"]).alias(n) for c, n in (("_o", "methods"), ("_q", "by_quality"), ("_s", "by_speed"))])
    has = lambda m: F.exists("methods", lambda v: v["method"] == m)
    return g.withColumns({"best": F.when(has("docling"), "docling").when(has("layout_parser"), "layout_parser").otherwise("traditional"), "fastest": F.get("by_speed", F.lit(0))["method"], "most_accurate": F.get("by_quality", F.lit(0))["method"]})


def comparison_report(rows: DataFrame, at: Column) -> DataFrame:
    """doc_id, text: the summary for readers. ``at`` is the date that it shows."""
    names = lambda c: F.array_join(F.transform(c, lambda v: v["method"]), ", ")
    quality = F.transform("by_quality", lambda v, k: F.format_string("  %d. %s: %.1f/100", k + 1, v["method"], v["score"].cast("double")))
    speed = F.transform("by_speed", lambda v, k: F.format_string("  %d. %s: %.2fs per page", k + 1, v["method"], v["per_page"]))
    lit = lambda *t: F.array(*map(F.lit, t))
    fast = F.when(F.size("by_speed") > 0, F.concat(lit("Speed Ranking (faster is better):"), speed, lit(""))).otherwise(F.array().cast("array<string>"))
    best = F.array(F.lit("Recommendations:"), F.concat(F.lit("  Overall Best: "), "best"), F.concat(F.lit("  Fastest: "), "fastest"), F.concat(F.lit("  Most Accurate: "), "most_accurate"))
    head = F.array(F.lit("PDF Extraction Methods Comparison Report"), F.concat(F.lit("PDF: "), "doc_id"), F.concat(F.lit("Analysis Date: "), at), F.lit("=" * 60), F.concat(F.lit("Methods Analyzed: "), names("methods")), F.lit(""), F.lit("Quality Ranking:"))
    return _by_document(rows).select("doc_id", F.array_join(F.concat(head, quality, lit(""), fast, best), "\n").alias("text"))


def comparison_json(rows: DataFrame) -> DataFrame:
    """doc_id, json: the detailed comparison."""
    entry = F.struct(
        "method", F.struct("text_files", "chars", "organization").alias("text_extraction"), F.struct(F.col("csv_files").alias("tables_found"), F.col("table_method").alias("extraction_method")).alias("table_extraction"),
        F.struct(F.col("has_bounding_boxes").alias("bounding_boxes"), F.col("has_reading_order").alias("reading_order")).alias("structure_analysis"), F.struct("seconds", "pages", "per_page").alias("performance"),
        F.struct("special", "formats", "advanced").alias("unique_features"), "strengths", "limitations",
    )
    full = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json(entry).alias("e")))), lambda v: v["e"]).alias("metrics"))
    j = _by_document(rows).join(full, "doc_id")
    rest = F.to_json(F.struct(F.col("doc_id").alias("pdf_name"), F.transform("methods", lambda v: v["method"]).alias("methods_analyzed"), F.transform("by_quality", lambda v: F.struct(v["method"].alias("method"), v["score"].alias("score"))).alias("overall_ranking"), F.transform("by_speed", lambda v: F.struct(v["method"].alias("method"), v["per_page"].alias("per_page"))).alias("efficiency_ranking"), F.struct(F.col("best").alias("overall_recommendation"), F.col("fastest").alias("best_for_speed"), F.col("most_accurate").alias("best_for_accuracy")).alias("recommendations")))
    return j.select("doc_id", F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"extraction_metrics":['), F.array_join("metrics", ","), F.lit("]}")).alias("json"))


def docling_metrics(counters: DataFrame) -> DataFrame:
    """counters: doc_id, reading_order_elements, tables, formulas, figures. The metrics that set docling off against the others."""
    content = F.struct((F.col("reading_order_elements") > 0).alias("reading_order_preserved"), F.col("tables").alias("tables_with_structure"), F.col("formulas").alias("formulas_detected"), F.col("figures").alias("figures_extracted"))
    structure = F.struct(*[F.lit(True).alias(n) for n in ("hierarchical_extraction", "semantic_understanding", "layout_preservation", "cross_page_continuity")])
    return counters.select("doc_id", content.alias("content_analysis"), structure.alias("structure_quality"), F.array(*map(F.lit, ADVANTAGES)).alias("docling_advantages"))
