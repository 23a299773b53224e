"""Reconciliation of extracted figures with official ones. Series are long: (statement_type, concept, period, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config.labels import CALENDAR, CONSOLIDATED_WORDS, SEGMENT_PERIODS, SEGMENT_WORDS
from ..functions.fuzzy import ratio
from ..functions.text import any_of, normalize_label
from ..functions.values import CAUSES, cause, compare, scale, skip_comparison


def reconcile_keys(extracted: DataFrame, official: DataFrame, key: str, tolerance: float = 0.01, rounding: float = 0.005) -> DataFrame:
    """Full reconciliation on one key: columns key, pdf_value / xbrl_value on the two sides.

    Adds status (match, discrepancy, pdf_only, xbrl_only) and the comparison's parts. One shuffled full outer join.
    """
    both = extracted.join(official, key, "full_outer")
    # the comparison refers to the scale many times: the generator keeps Catalyst from copying its expression
    both = both.withColumn("_s", F.explode(F.array(scale(F.col("pdf_value"), F.col("xbrl_value")))))
    both = both.withColumn("_c", F.explode(F.array(compare(F.col("pdf_value"), F.col("xbrl_value"), tolerance, rounding, F.col("_s")))))
    status = F.when(F.col("xbrl_value").isNull(), "pdf_only").when(F.col("pdf_value").isNull(), "xbrl_only").when(F.col("_c.match"), "match").otherwise("discrepancy")
    return both.select(key, "pdf_value", "xbrl_value", status.alias("status"), F.col("_c.reason").alias("reason"), F.col("_c.a").alias("normalized_pdf"), F.col("_c.b").alias("normalized_xbrl"), F.col("_c.factor").alias("scale_factor"), F.col("_c.scale_reason").alias("scale_reason"), F.col("_c.diff").alias("relative_difference"), F.col("_c.confidence").alias("confidence"))


def comparable(pdf: DataFrame, official: DataFrame) -> DataFrame:
    """Per (statement_type, concept) of both sides: ok, whether their figures can be of the same thing (wording of periods, medians)."""
    seg = F.max(any_of(F.lower("period"), SEGMENT_WORDS).cast("int"))
    con = F.max(any_of(F.lower("period"), CONSOLIDATED_WORDS).cast("int"))
    size = F.median(F.when(F.col("value") != 0, F.abs("value")))
    a = pdf.groupBy("statement_type", "concept").agg(seg.alias("seg"), size.alias("pm"))
    b = official.groupBy("concept").agg(con.alias("con"), size.alias("xm"))
    r = F.try_divide(F.greatest("pm", "xm"), F.least("pm", "xm"))
    segment_part = (F.col("seg") == 1) & (F.col("con") == 1) & ((F.col("pm") < 0.8 * F.col("xm")) | (r > 2.5))
    return a.join(b, "concept").select("statement_type", "concept", F.when(F.col("pm").isNull() | F.col("xm").isNull(), True).otherwise(~segment_part & ~(r > 1e7)).alias("ok"))


def align_periods(pairs: DataFrame, key: list[str], calendar: list = CALENDAR, fuzzy: bool = True) -> DataFrame:
    """The best official period for each extracted one. pairs: key..., period, xbrl_period, xord (order of official periods).

    Adds alignment_kind: exact, hint, fuzzy or default. Segment periods that aren't consolidated have no counterpart. Candidates are
    the official periods of the same concept, a handful, so this is a window over small groups.
    """
    low = F.lower(F.trim("period"))
    segment = any_of(low, SEGMENT_PERIODS)
    consolidated = low.contains("consolidated") | low.contains("total")
    word = F.when(segment & consolidated, "year ended").otherwise(low)
    ends = [c[1] for c in calendar]
    at = F.col("xbrl_period")
    hint = F.when(word.contains("year ended.2") & (at == ends[2]), 1).when((word.contains("prior") | word.contains("previous") | word.contains("year ended.1")) & (at == ends[1]), 2).when((word.contains("current") | word.contains("latest") | (word == "year ended")) & (at == ends[0]), 3)
    a, b = F.lower(normalize_label(F.col("period"))), F.lower(normalize_label(at))
    score = ratio(a, b) if fuzzy else F.lit(0.0)
    for year, _, _ in calendar:
        score = score + F.when(a.contains(year) & at.contains(year), 0.5).otherwise(0.0)
    score = score + F.when((a.contains("year") & b.contains("year")) | (a.contains("annual") & b.contains("annual")), 0.2).otherwise(0.0)
    fallback = F.lit(99)
    for k in reversed(range(len(ends))):
        fallback = F.when(at == ends[k], k).otherwise(fallback)
    scored = pairs.where(~segment | consolidated | F.col("period").eqNullSafe(at)).withColumn("_score", F.when(score > 0.3, score)).withColumn("_hint", hint).withColumn("_fall", fallback)
    tier = F.when(F.col("period") == at, 0).when(F.col("_hint").isNotNull(), F.col("_hint")).when(F.col("_score").isNotNull(), 4).otherwise(5)
    order = [tier.asc(), F.when(tier == 4, F.col("_score")).desc_nulls_last(), F.when(tier == 5, F.col("_fall")).asc_nulls_last(), F.col("xord").asc()]
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "period").orderBy(*order))).where("_n = 1")
    kind = F.when(tier == 0, "exact").when(tier < 4, "hint").when(tier == 4, "fuzzy").otherwise("default")
    return best.withColumn("alignment_kind", kind).drop("_score", "_hint", "_fall", "_n")


def reconcile(pdf: DataFrame, official: DataFrame, tolerance: float = 0.01, rounding: float = 0.005, fuzzy: bool = True) -> DataFrame:
    """Series against series; one row per extracted figure, plus official-only concepts. Pairs that are skipped say why."""
    xord = official.withColumn("xord", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("period")))).select("concept", F.col("period").alias("xbrl_period"), F.col("value").alias("xbrl_value"), "xord")
    known = official.select("concept").distinct()
    only = pdf.join(known, "concept", "left_anti").groupBy("statement_type", "concept").agg(F.count("*").alias("n")).select("statement_type", "concept", F.lit("pdf_only").alias("status"))
    pairs = pdf.join(xord, "concept")
    pairs = align_periods(pairs, ["statement_type", "concept"], fuzzy=fuzzy)
    base = pdf.join(known, "concept", "left_semi").join(pairs.select("statement_type", "concept", "period", "xbrl_period", "xbrl_value", "alignment_kind"), ["statement_type", "concept", "period"], "left")
    base = base.join(comparable(pdf, official), ["statement_type", "concept"], "left")
    base = base.withColumn("_s", F.explode(F.array(scale(F.col("value"), F.col("xbrl_value")))))
    base = base.withColumn("_c", F.explode(F.array(compare(F.col("value"), F.col("xbrl_value"), tolerance, rounding, F.col("_s")))))
    skip = F.when(~F.col("ok"), "not_comparable").when(F.col("xbrl_period").isNull(), "no_period").when(skip_comparison(F.col("value"), F.col("xbrl_value"), F.col("concept")), "filtered")
    status = F.when(skip.isNotNull(), "skipped").when(F.col("_c.match"), "match").otherwise("discrepancy")
    rows = base.select("statement_type", "concept", status.alias("status"), "period", "xbrl_period", "alignment_kind", F.col("value").alias("pdf_value"), "xbrl_value", F.coalesce(skip, F.col("_c.reason")).alias("reason"), F.col("_c.factor").alias("scale_factor"), F.col("_c.confidence").alias("confidence"))
    missing = known.join(pdf.select("concept").distinct(), "concept", "left_anti").select("concept", F.lit("xbrl_only").alias("status"))
    return rows.unionByName(only, True).unionByName(missing, True)


def summary(recon: DataFrame) -> DataFrame:
    """One row of counts and the match rate."""
    n = lambda s: F.count_if(F.col("status") == s)
    return recon.agg(n("match").alias("total_matches"), n("discrepancy").alias("total_discrepancies"), n("pdf_only").alias("pdf_only_count"), n("xbrl_only").alias("xbrl_only_count"), (n("match") / F.greatest(F.lit(1), n("match") + n("discrepancy"))).alias("match_rate"))


def cause_histogram(recon: DataFrame) -> DataFrame:
    """Discrepancies per cause, every bucket present."""
    spine = recon.sparkSession.createDataFrame([(c,) for c in CAUSES], "cause string")
    counts = recon.where("status = 'discrepancy'").groupBy(cause(F.col("reason")).alias("cause")).count()
    return F.broadcast(spine).join(counts, "cause", "left").select("cause", F.coalesce("count", F.lit(0)).alias("n"))


def mismatch_alert(match_rate: Column, most: float = 0.15) -> Column:
    return (1 - match_rate) > most


def resolve_series(items: DataFrame, mapped: bool = True) -> DataFrame:
    """Conflicts of series under one (statement_type, concept), items: statement_type, concept, ord, periods (map period -> value).

    In order: the held series is replaced by one with more periods or, if ``mapped``, a larger sum of magnitudes. An order-dependent
    fold, over the tables of one filing that name the concept.
    """
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + F.abs(F.coalesce(v["value"], F.lit(0.0))))
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.map_entries("periods").alias("entries"))))

    def fold(held: Column, new: Column) -> Column:
        better = F.size(new["entries"]) > F.size(held["entries"])
        if mapped:
            better = better | (total(new["entries"]) > total(held["entries"]))
        return F.when(better, new).otherwise(held)

    grouped = items.groupBy("statement_type", "concept").agg(ordered.alias("o")).withColumn("o", F.explode(F.array("o")))
    return grouped.select("statement_type", "concept", F.aggregate(F.slice("o", F.lit(2), F.size("o")), F.get("o", F.lit(0)), fold).alias("w")).select("statement_type", "concept", "w.ord", F.map_from_entries("w.entries").alias("periods"))
