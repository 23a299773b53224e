"""Content blocks: construction, union over methods, consolidation, statistics, sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config.keywords import CONFIDENCE, METHODS, TYPE_ORDER
from ..functions.text import is_heading, strip, word_count
from ..schemas import BBOX, BLOCK, CONTENT, PROVENANCE, QUALITY


def constant(kind: str, origin: str) -> Column:
    """Confidence of a block by policy."""
    return F.lit(CONFIDENCE[(kind, origin)])


def block(df: DataFrame, method: str, kind: Column, text: Column, page: Column, confidence: Column, ord: Column, source: Column | None = None, bbox: Column | None = None, structured: Column | None = None, readability: Column | None = None) -> DataFrame:
    """Rows of ``df`` (with doc_id) as BLOCK; one constructor for every method and type."""
    source = F.lit(None) if source is None else source
    quality = F.struct(F.length(text).cast("long").alias("text_length"), word_count(text).alias("word_count"), (F.lit(None) if readability is None else readability).cast("double").alias("readability_score"), F.when(strip(text) != "", 1.0).otherwise(0.0).alias("completeness"))
    cols = {
        "doc_id": F.col("doc_id").cast("string"),
        "block_id": F.format_string("%s_%s_%s", F.lit(method), kind, ord.cast("string")),
        "extraction_method": F.lit(method),
        "page_number": page.cast("int"),
        "block_type": kind,
        "confidence": confidence.cast("double"),
        "bounding_box": (F.lit(None) if bbox is None else bbox).cast(BBOX),
        "content": F.struct(text.alias("text"), (F.lit(None) if structured is None else structured).cast("string").alias("structured"), F.lit(None).cast("string").alias("metadata")).cast(CONTENT),
        "provenance": F.struct(source.cast("string").alias("source_file"), F.lit(None).cast("string").alias("a"), F.array().cast("array<string>").alias("b"), F.array().cast("array<string>").alias("c"), F.array(F.lit(method)).alias("d"), F.lit(method).alias("e"), F.lit(None).cast("string").alias("f"), F.array().cast("array<string>").alias("g")).cast(PROVENANCE),
        "semantic_tags": F.array(kind),
        "quality_metrics": quality.cast(QUALITY),
        "ord": ord.cast("long"),
    }
    return df.select(*[c.alias(n) for n, c in cols.items()])


def empty_blocks(spark) -> DataFrame:
    return spark.createDataFrame([], BLOCK)


def union_methods(frames: dict[str, DataFrame], order: list[str] = METHODS) -> DataFrame:
    """UNION ALL in the fixed order of methods; ``ord`` becomes (method's place, ord in the method)."""
    some = [frames[m].withColumn("ord", F.lit(k * (1 << 40)) + F.col("ord")) for k, m in enumerate([*order, *sorted(set(frames) - set(order))]) if m in frames]
    return reduce(DataFrame.unionByName, some)


def consolidate(blocks: DataFrame, longest: bool = False) -> DataFrame:
    """The best block per document, type and page (null page: 1): most confident, first on ties; ``longest`` prefers longer text on ties.

    Provenance names all methods and the losers. The id is a hash of the group, so the result is deterministic.
    """
    key = ["doc_id", "block_type", "page"]
    tie = [-F.coalesce("quality_metrics.text_length", F.lit(0))] if longest else []
    rank = F.struct(-F.col("confidence"), *[t.alias("t") for t in tie], F.col("ord"))
    whole = F.struct(*[c for c in blocks.columns])
    others = F.array_sort(F.collect_list(F.struct("ord", "block_id", "extraction_method")))
    g = blocks.withColumn("page", F.coalesce("page_number", F.lit(1))).groupBy(*key).agg(F.min_by(whole, rank).alias("w"), others.alias("all"))
    methods = F.array_distinct(F.transform("all", lambda b: b["extraction_method"]))
    losers = F.transform(F.filter("all", lambda b: b["block_id"] != F.col("w.block_id")), lambda b: b["block_id"])
    name = F.format_string("unified_%s_p%d_%s", F.col("block_type"), F.col("page"), F.substring(F.sha2(F.concat_ws("|", "doc_id", "block_type", F.col("page").cast("string")), 256), 1, 8))
    p = F.col("w.provenance")
    provenance = F.struct(p["source_file"].alias("source_file"), p["extraction_config"].alias("extraction_config"), p["parent_blocks"].alias("parent_blocks"), p["child_blocks"].alias("child_blocks"), methods.alias("source_methods"), F.col("w.extraction_method").alias("best_method"), F.lit("highest_confidence").alias("consolidation_strategy"), losers.alias("alternative_blocks"))
    fixed = {"doc_id": F.col("doc_id"), "block_id": name, "extraction_method": F.lit("unified"), "page_number": F.col("page"), "provenance": provenance}
    return g.select(*[fixed.get(c, F.col(f"w.{c}")).alias(c) for c in blocks.columns])


def stats(blocks: DataFrame, *by: str) -> DataFrame:
    """Confidence, completeness, lengths and counts, over all or by columns; no row for no blocks."""
    out = blocks.groupBy(*by).agg(F.count("*").alias("blocks"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.avg("quality_metrics.completeness").alias("avg_completeness"), F.sum("quality_metrics.text_length").alias("text_length"), F.sum("quality_metrics.word_count").alias("word_count"))
    return out.where("blocks > 0")


def section_overview(blocks: DataFrame, label: Column) -> DataFrame:
    """Per label: count, first and last page, sorted distinct types."""
    return blocks.groupBy(label.alias("label")).agg(F.count("*").alias("blocks"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.array_sort(F.collect_set("block_type")).alias("types"))


def with_reading_index(blocks: DataFrame) -> DataFrame:
    """Adds reading_index: a document's blocks numbered from 0 in reading order."""
    return blocks.withColumn("reading_index", F.row_number().over(Window.partitionBy("doc_id").orderBy(*reading_order(), "ord")) - 1)


def reading_order(grid: int = 50) -> list[Column]:
    """Page, line band (banker's rounding), left edge; a missing box is at 0."""
    y, x = F.coalesce("bounding_box.y1", F.lit(0.0)), F.coalesce("bounding_box.x1", F.lit(0.0))
    return [F.col("page_number"), F.bround(y / grid) * grid, x, F.col("ord")]


def type_place(kind: Column) -> Column:
    """Place of a block type in the fixed order; 0 for others."""
    return F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), kind)


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i (from 0), line."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))


def sections(df: DataFrame, header: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections of each text: a header line and the body up to the next one; what stands before the first is dropped.

    ``header`` is a condition on ``line``. key, section (from 1), title, content, word_count.
    """
    if header is None:
        header = F.col("line").startswith("#") | is_heading(F.col("line"))
    each = lines(df, key, text).withColumn("h", F.coalesce((strip(F.col("line")) != "") & header, F.lit(False)))
    each = each.withColumn("section", F.sum(F.col("h").cast("int")).over(Window.partitionBy(key).orderBy("i")))
    body = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("i", "line"))))
    got = each.where("section > 0").groupBy(key, "section").agg(F.max(F.when(F.col("h"), strip(F.col("line")))).alias("title"), F.transform(body, lambda b: b["line"]).alias("b"))
    return got.select(key, "section", "title", strip(F.array_join("b", "\n")).alias("content"), word_count(F.array_join("b", " ")).alias("word_count"))
