"""Words and boxes on pages: grouping into blocks, gaps, columns, spatial joins, font classes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..config.keywords import LAYOUT_TYPES
from ..functions.text import font_kind, title_score, word_count

PAGE = ["doc_id", "page_number"]


def complete_words(words: DataFrame) -> DataFrame:
    """Words that have a text and all four edges."""
    return words.dropna(subset=["text", "x0", "x1", "top", "bottom"])


def gap_blocks(words: DataFrame, gap: float = 20, least: int = 3) -> DataFrame:
    """Blocks of words in (top, x0) order; a new one begins where the gap to the last word's bottom is over ``gap``."""
    w = Window.partitionBy(*PAGE).orderBy("top", "x0", "ord")
    new = F.coalesce((F.col("top") - F.lag("bottom").over(w) > gap).cast("int"), F.lit(0))
    each = words.withColumn("_new", new).withColumn("block", F.sum("_new").over(w)).drop("_new")
    return boxes(each, [*PAGE, "block"]).where(F.col("words") >= least)


def boxes(words: DataFrame, by: list[str]) -> DataFrame:
    """Union box of each group, with its text in reading order."""
    lo, hi = lambda a, b: F.min(F.least(a, b)), lambda a, b: F.max(F.greatest(a, b))
    g = words.groupBy(*by).agg(F.count("*").alias("words"), lo("x0", "x1").alias("x1"), lo("top", "bottom").alias("y1"), hi("x0", "x1").alias("x2"), hi("top", "bottom").alias("y2"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "x0", "ord", "text"))), lambda v: v["text"]), " ").alias("text"))
    return g.withColumn("width", F.col("x2") - F.col("x1")).withColumn("height", F.col("y2") - F.col("y1"))


def with_text(blocks: DataFrame, least_chars: int = 5, least_words: int = 3) -> DataFrame:
    """Blocks of enough words whose text has enough characters (three are asked for where pages are read without blocks)."""
    return blocks.where((F.col("words") >= least_words) & (F.length(F.trim("text")) >= least_chars))


def titles(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("title_score", title_score(F.col("text"), word_count(F.col("text")), F.col("height"), F.col("x1"))).withColumn("is_title", F.col("title_score") >= 3)


def anchored_blocks(words: DataFrame, line: float = 5, gap: float = 20) -> DataFrame:
    """Block numbers with an anchor that only moves between lines: words within ``line`` of it are on its line, within ``gap`` below in
    its block. The carried anchor is no window function, so pages are folded in Arrow batches, one page (bounded) at a time."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["top", "x0", "ord"], kind="stable")
        anchor, block, out = None, 0, []
        for y in page["top"]:
            if anchor is None:
                anchor = y
            elif abs(y - anchor) > line:
                block += y - anchor > gap
                anchor = y
            out.append(int(block))
        return page.assign(block=out)

    return words.groupBy(*PAGE).applyInPandas(fold, StructType([*words.schema.fields, StructField("block", IntegerType())]))


def outside(words: DataFrame, areas: DataFrame) -> DataFrame:
    """Words whose corner lies in no area (x1, y1, x2, y2; edges included) of their page: an equi anti join with a range condition."""
    a = areas.select(*[F.col(c).alias("_" + c) for c in PAGE], "x1", "y1", "x2", "y2") if "x1" not in words.columns else areas.select(*[F.col(c).alias("_" + c) for c in PAGE], *[F.col(c).alias("_" + c) for c in ("x1", "y1", "x2", "y2")])
    n = "_" if "x1" in words.columns else ""
    same = [words[c] == a["_" + c] for c in PAGE]
    inside = (words["x0"] >= a[f"{n}x1"]) & (words["x0"] <= a[f"{n}x2"]) & (words["top"] >= a[f"{n}y1"]) & (words["top"] <= a[f"{n}y2"])
    return words.join(a, same[0] & same[1] & inside, "left_anti")


def line_spacing(words: DataFrame) -> DataFrame:
    """Per page: distances between distinct rounded tops: mean and spread."""
    tops = words.select(*PAGE, F.bround("top").alias("t")).distinct()
    gaps = tops.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy(*PAGE).orderBy("t"))).where("gap IS NOT NULL")
    return gaps.groupBy(*PAGE).agg(F.avg("gap").alias("avg_spacing"), (F.max("gap") - F.min("gap")).alias("spread"))


def column_gaps(words: DataFrame, least: float = 50, show: int = 3) -> DataFrame:
    """Per page: columns (gaps in the sorted left edges, and one) and the first gaps."""
    g = words.withColumn("gap", F.col("x0") - F.lag("x0").over(Window.partitionBy(*PAGE).orderBy("x0")))
    big = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap") > least, F.struct("x0", "gap")))), lambda v: v["gap"])
    return g.groupBy(*PAGE).agg((F.count_if(F.col("gap") > least) + 1).alias("columns"), F.slice(big, 1, show).alias("first_gaps"))


def margins(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def relative_size(words: DataFrame) -> DataFrame:
    """Class of each word by its size against the page's mean."""
    mean = F.avg("size").over(Window.partitionBy(*PAGE))
    return words.withColumn("size_class", F.when(F.col("size") > 1.5 * mean, "title").when(F.col("size") > 1.2 * mean, "heading").when(F.col("size") < 0.8 * mean, "small").otherwise("body"))


def fonts(words: DataFrame, sample: int = 100) -> DataFrame:
    """Per font: characters, mean size, range, a sample in reading order, the content type. For the sample each task keeps the first
    ``sample`` words of a font alone (a word has a character at least)."""
    nth = F.row_number().over(Window.partitionBy("fontname").orderBy("ord"))
    first = words.where("text <> ''").select("fontname", "ord", "text").withColumn("_n", nth).where(F.col("_n") <= sample)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda v: v["text"]), "")
    starts = first.groupBy("fontname").agg(F.substring(text, 1, sample).alias("sample"))
    g = words.groupBy("fontname").agg(F.sum(F.length("text")).alias("chars"), F.avg("size").alias("avg_size"), F.format_string("%.1f-%.1f", F.min("size"), F.max("size")).alias("range"))
    return g.join(starts, "fontname", "left").withColumn("kind", font_kind(F.col("fontname"), F.col("avg_size")))


def has_rulings(lines: DataFrame) -> DataFrame:
    """Per page: more than two horizontal and more than two vertical lines (x0, y0, x1, y1)."""
    flat, steep = F.abs(F.col("y1") - F.col("y0")) < 1, F.abs(F.col("x1") - F.col("x0")) < 1
    return lines.groupBy(*PAGE).agg(((F.count_if(flat) > 2) & (F.count_if(steep) > 2)).alias("has_rulings"))


def best_table_method(rulings: Column, lattice: Column, stream: Column, plain: Column, lattice_accuracy: Column, stream_accuracy: Column) -> Column:
    """Method for a page's tables, from the counts of each and their mean accuracies."""
    some = (lattice > 0) | (stream > 0)
    by_accuracy = F.when(F.coalesce(lattice_accuracy, F.lit(0.0)) > F.coalesce(stream_accuracy, F.lit(0.0)), "camelot_lattice").otherwise("camelot_stream")
    return F.when(rulings & (lattice > 0), "camelot_lattice").when(~rulings & (stream > 0), "camelot_stream").when((plain > 0) & ~some, "pdfplumber").when(some, by_accuracy).otherwise("none_suitable")


def table_box(index: Column, rows: Column, width: Column, height: Column) -> Column:
    """Estimated box of a page's index-th table of so many rows."""
    y1 = (F.lit(100) + index * 200).cast("double")
    y2 = F.least(y1 + rows * 15, height - 50)
    return F.struct(F.lit(50.0).alias("x1"), y1.alias("y1"), (width - 50).alias("x2"), y2.alias("y2"), (width - 100).alias("width"), (y2 - y1).alias("height"))


def page_layout(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Rule-based layout of pages: words outside tables, grouped by gaps, titles marked."""
    return titles(gap_blocks(outside(complete_words(words), tables)))


def block_type(label: Column) -> Column:
    """Block type of a detector's label; null for labels that aren't extracted."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LAYOUT_TYPES.items() for x in pair]), label)


def item_kind(label: Column) -> Column:
    """table, formula or figure by the words in an item's label; else null."""
    low = F.lower(label)
    return F.when(low.rlike("table|grid"), "table").when(low.contains("formula"), "formula").when(low.rlike("figure|picture"), "figure")


def object_counts(objects: DataFrame, kinds: list[str]) -> DataFrame:
    """Per page the number of objects of each kind (0 if none). objects: doc_id, page_number, kind."""
    return objects.groupBy(*PAGE).pivot("kind", kinds).count().fillna(0, kinds)


def with_page_summary(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Page files with used_ocr and extraction_method of their page's first summary row; false and the plain method where there is none."""
    first = summary.groupBy(*PAGE).agg(F.min_by(F.struct("used_ocr", "extraction_method"), "ord").alias("s"))
    j = files.join(first, PAGE, "left")
    return j.select(*files.columns, F.coalesce("s.used_ocr", F.lit(False)).alias("used_ocr"), F.coalesce("s.extraction_method", F.lit("pdfplumber")).alias("extraction_method"))


def simple_page_layout(words: DataFrame, images: DataFrame) -> DataFrame:
    """Layout without tables: anchored groups of words with three or more characters, short ones in capitals or off the left edge as titles; a
    figure per image (doc_id, page_number, ord, x0, top, x1, bottom)."""
    b = with_text(boxes(anchored_blocks(complete_words(words)), [*PAGE, "block"]), least_chars=3, least_words=1)
    caps = (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    title = (word_count(F.col("text")) <= 10) & (caps | (F.col("x1") > 100))
    text = b.select(*PAGE, F.format_string("page_%03d_text_%03d", F.col("page_number"), F.col("block")).alias("block_id"), F.when(title, "title").otherwise("text").alias("block_type"), F.lit(0.8).alias("confidence"), "x1", "y1", "x2", "y2", F.trim("text").alias("content"), F.lit("word_grouping").alias("extraction_method"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("ord"))
    figures = images.withColumn("_n", n).select(*PAGE, F.format_string("page_%03d_figure_%03d", F.col("page_number"), F.col("_n") - 1).alias("block_id"), F.lit("figure").alias("block_type"), F.lit(0.7).alias("confidence"), F.col("x0").alias("x1"), F.col("top").alias("y1"), F.col("x1").alias("x2"), F.col("bottom").alias("y2"), F.format_string("Image %d", F.col("_n")).alias("content"), F.lit("pdf_image_detection").alias("extraction_method"))
    return text.unionByName(figures)


def page_analysis(words: DataFrame, objects: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per page: objects of each kind, words by size class, line spacing, columns, margins."""
    sizes = relative_size(words).groupBy(*PAGE).pivot("size_class", ["title", "heading", "small", "body"]).count().fillna(0)
    out = sizes
    for part in (line_spacing(words), column_gaps(words), margins(words), object_counts(objects, kinds)):
        out = out.join(part, PAGE, "left")
    return out.fillna(0, kinds)
