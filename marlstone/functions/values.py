"""Figures: parsing, period headers, scale detection, comparison. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config.labels import CALENDAR, POSITIVE, WIDE_RATIO
from .text import any_of, strip

NO_VALUE = ["nan", "none", "", "-", "n/a"]


def money(x: Column, strict_units: bool = False) -> Column:
    """Amount of a cell: brackets are a minus, "million"/"m" and "billion"/"b" anywhere scale it (whole words only if strict_units)."""
    low = F.lower(x)
    clean = F.regexp_replace(F.replace(F.regexp_replace(x, r"[$,)]", ""), F.lit("("), F.lit("-")), r"[^0-9.\-]", "")
    value = clean.try_cast("double")
    m, b = (low.rlike(r"(?<![a-z])(million|m)(?![a-z])"), low.rlike(r"(?<![a-z])(billion|b)(?![a-z])")) if strict_units else (low.contains("m"), low.contains("b"))
    return F.when(low.isin(NO_VALUE), None).otherwise(value * F.when(m, 1e6).when(b, 1e9).otherwise(1.0))


def period(header: Column, calendar: list[tuple[str, str, list[str]]] = CALENDAR) -> Column:
    """Period end that a header stands for: spelt date, then year, then "year ended" (.1 and .2 are earlier years); else the header."""
    low = F.lower(strip(header))
    clean = strip(F.regexp_replace(low, r"[^\w\s,]", ""))
    out = F.when(low.contains("year ended"), F.when(low.contains(".2"), calendar[2][1]).when(low.contains(".1"), calendar[1][1]).otherwise(calendar[0][1])).otherwise(header)
    for year, end, _ in reversed(calendar):
        out = F.when(low.contains(year), end).otherwise(out)
    for _, end, spellings in reversed(calendar):
        out = F.when(any_of(clean, spellings), end).otherwise(out)
    return out


def column_period(header: Column, position: Column, calendar: list[tuple[str, str, list[str]]] = CALENDAR) -> Column:
    """As ``period``; a blank header stands for the newest, prior or oldest period by its place among the value columns."""
    blank = F.coalesce(F.lower(strip(header)).isin("nan", "none", ""), F.lit(True))
    by_place = F.when(position < len(calendar), F.element_at(F.array(*[F.lit(c[1]) for c in calendar]), (position + 1).cast("int")))
    return F.when(blank, by_place).otherwise(period(header, calendar))


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.lit(1e-12), F.abs(a), F.abs(b))


#: Scales tried in this order: factor, reason; those under 1 scale the official figure up.
UP = [(1.0, "no_scaling"), (1e3, "thousands_to_actual"), (1e6, "millions_to_actual"), (1e9, "billions_to_actual")]
DOWN = [(0.001, "actual_to_thousands"), (0.000001, "actual_to_millions"), (0.000000001, "actual_to_billions")]


def scale(pdf: Column, official: Column) -> Column:
    """struct(diff, ord, a, b, factor, reason): the scale under which the two agree best.

    Candidates differ by less than half; scales of the official figure are looked at only if none of the others comes within 0.3.
    """

    def option(k: int, a: Column, b: Column, over: Column, factor: float, reason: str) -> Column:
        return F.struct((F.abs(a - b) / F.abs(over)).alias("diff"), F.lit(k).alias("ord"), a.alias("a"), b.alias("b"), F.lit(factor).alias("factor"), F.lit(reason).alias("reason"))

    close = lambda options: F.array_min(F.filter(F.array(*options), lambda o: o["diff"] < 0.5))
    up = close([option(k, pdf * f, official, official, f, r) for k, (f, r) in enumerate(UP)])
    down = close([option(k + 4, pdf, official * (1.0 / f), pdf, f, r) for k, (f, r) in enumerate(DOWN)])
    best = F.when(up["diff"] <= 0.3, up).otherwise(F.array_min(F.array_compact(F.array(up, down))))
    none = lambda reason: F.struct(F.lit(None).cast("double").alias("diff"), F.lit(9).alias("ord"), pdf.alias("a"), official.alias("b"), F.lit(1.0).alias("factor"), F.lit(reason).alias("reason"))
    return F.when((pdf == 0) | (official == 0), none("zero_value")).when(best.isNull(), none("no_scaling_detected")).otherwise(best)


def compare(pdf: Column, official: Column, tolerance: float = 0.01, rounding: float = 0.005, scaled: Column | None = None) -> Column:
    """struct(match, reason, a, b, factor, scale_reason, diff, confidence) of two figures. ``scaled``: scale(pdf, official), if at hand."""
    s = scale(pdf, official) if scaled is None else scaled
    a, b = s["a"], s["b"]
    diff = F.when(b != 0, F.try_divide(F.abs(a - b), F.abs(b))).otherwise(F.when(a != 0, F.lit(float("inf"))).otherwise(0.0))
    exact, near, loose = a == b, diff <= tolerance, diff <= 0.25
    rounded = diff <= rounding
    trust = F.when(exact, 1.0).when(near, 1.0 - diff / tolerance * 0.3).otherwise(F.greatest(F.lit(0.0), 0.7 - diff / 0.15 * 0.7))
    ratio = F.when(pdf != 0, F.abs(F.try_divide(official, pdf))).otherwise(F.lit(float("inf")))
    missing, far = pdf.isNull() | official.isNull(), (ratio > 1e10) | (ratio < 1e-10)
    reason = F.when(exact, "exact_match").when(rounded, "rounding_match").when(near, "tolerance_match").when(loose, "loose_match").otherwise("value_mismatch")
    pick = lambda if_missing, if_far, value: F.when(missing, if_missing).when(far, if_far).otherwise(value)
    null = F.lit(None).cast("double")
    return F.struct(
        pick(F.lit(False), F.lit(False), exact | rounded | near | (loose & (s["factor"] != 1.0))).alias("match"),
        pick(F.lit("missing_value"), F.lit("magnitude_mismatch"), reason).alias("reason"),
        pick(null, null, a).alias("a"), pick(null, null, b).alias("b"), pick(null, F.lit(1.0), s["factor"]).alias("factor"),
        pick(F.lit(None), F.lit("values_too_different"), s["reason"]).alias("scale_reason"), pick(null, null, diff).alias("diff"),
        pick(F.lit(0.0), F.lit(0.0), trust).alias("confidence"),
    )


def simple_compare(pdf: Column, official: Column, tolerance: float = 0.01, rounding: float = 0.005) -> Column:
    """struct(match, cause, scale) of the plain comparator: tolerance, scales both ways, sign, rounding."""

    def same(a: Column, b: Column) -> Column:
        return F.when((a == 0) & (b == 0), True).when((a == 0) | (b == 0), False).otherwise(relative_difference(a, b) <= tolerance)

    verdict = lambda m, c, s: F.struct(F.lit(m).alias("match"), F.lit(c).alias("cause"), F.lit(s).alias("scale"))
    out = F.when(same(pdf, official), verdict(True, "ok", 1.0))
    for s in (1e3, 1e6, 1e9):
        out = out.when(same(pdf * s, official), verdict(True, "scaling_mismatch", s)).when(same(pdf, official * s), verdict(True, "scaling_mismatch", 1.0 / s))
    out = out.when(same(F.abs(pdf), F.abs(official)) & (pdf * official < 0), verdict(False, "sign_mismatch", 1.0))
    return out.when(relative_difference(pdf, official) <= rounding, verdict(True, "rounding_difference", 1.0)).otherwise(verdict(False, "different_values", 1.0))


def cause(reason: Column) -> Column:
    """Cause bucket of a comparison's reason."""
    return F.when(reason == "exact_match", "ok").when(reason.isin("tolerance_match", "rounding_match"), "rounding_difference").otherwise("different_values")


CAUSES = ["rounding_difference", "different_values", "sign_mismatch", "scaling_mismatch"]


def skip_comparison(pdf: Column, official: Column, concept: Column, cap: float = 1e6, wide_cap: float = 1e7) -> Column:
    """Pairs that say nothing: a zero, a sign clash of a concept that can't be negative, too large a ratio."""
    ratio = F.abs(F.try_divide(official, pdf))
    most = F.when(concept.isin(WIDE_RATIO), wide_cap).otherwise(cap)
    return (pdf == 0) | (official == 0) | (concept.isin(POSITIVE) & (pdf * official < 0)) | (ratio > most) | (ratio < 1 / most)


def price(pages: Column, each: float = 0.015, free: int = 0) -> Column:
    return F.greatest(pages - free, F.lit(0)) * each


def use_cloud(ocr_confidence: Column, table_score: Column, scanned: Column, failed: Column) -> Column:
    return F.coalesce(ocr_confidence < 0.95, F.lit(False)) | F.coalesce(table_score < 0.7, F.lit(False)) | scanned | failed
