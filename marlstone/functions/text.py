"""Text functions: Column in, Column out. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import keywords as K


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def tokens(x: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(tokens(x)).cast("long")


def any_of(x: Column, words: list[str]) -> Column:
    """x contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def how_many(x: Column, words: list[str]) -> Column:
    """How many of the words x contains."""
    return sum((x.contains(w).cast("int") for w in words), F.lit(0))


def normalize_label(x: Column) -> Column:
    """Label without numbering, notes in brackets and $ ' , %; & is spelt out. Case stays, null is empty."""
    y = strip(F.regexp_replace(strip(x), r"(?U)\s+", " "))
    y = F.regexp_replace(y, r"^\d+\.\s*", "")
    y = F.regexp_replace(y, r"\(.*?\)", "")
    y = F.regexp_replace(y, r"[$',]", "")
    return F.coalesce(strip(F.replace(F.replace(y, F.lit("&"), F.lit("and")), F.lit("%"), F.lit(""))), F.lit(""))


def page_number(name: Column) -> Column:
    """Number after the first "page_", else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"page_(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1))


def table_type(name: Column) -> Column:
    out = F.lit("unknown")
    for kind in ("financial", "custom", "standard"):
        out = F.when(name.startswith(kind + "_"), kind).otherwise(out)
    return out


def is_upper(x: Column) -> Column:
    """Has cased characters and all of them are upper case."""
    return (F.upper(x) == x) & (F.lower(x) != x)


def is_title(x: Column) -> Column:
    """Every run of letters begins with a capital and goes on in lower case; there is one such run."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"(?<!\p{L})\p{Ll}|\p{L}\p{Lu}")


def is_heading(line: Column) -> Column:
    out = is_upper(line) & (F.length(line) < 50) & (F.size(tokens(line)) <= 6)
    for pattern in K.HEADINGS:
        out = out | line.rlike(pattern)
    return out


def line_level(line: Column) -> Column:
    """Heading level of a line."""
    short_caps = is_upper(line) & (F.length(line) < 30)
    named = line.isin("Our Company", "Business", "Risk Factors")
    return F.when(line.rlike(r"^Part\s+[IVX]+"), 2).when(line.rlike(r"^Item\s+\d+"), 3).when(named, 2).when(short_caps, 3).otherwise(4)


def title_level(title: Column, names: list[str] | None = None) -> Column:
    """Heading level of a title; ``names`` are further phrases of level 3 (a company's name)."""
    t = F.upper(strip(title))
    return F.when(any_of(t, K.TITLES_2), 2).when(any_of(t, [*K.TITLES_3, *(names or [])]), 3).otherwise(4)


def checkboxes(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit("☐"), F.lit("- [ ]")), F.lit("☒"), F.lit("- [x]"))


_URL = r'[^\s<>"{}|\\^`\[\]]+'


def links(line: Column) -> Column:
    """URLs as Markdown links; those that begin with www. get a scheme. One pass, so nothing is linked twice."""
    marked = F.regexp_replace(line, rf"(https?://{_URL}|www\.{_URL})", "\u0001$1\u0002$1\u0003")
    fixed = F.regexp_replace(marked, "\u0002www\\.", "\u0002http://www.")
    return F.translate(F.replace(F.replace(fixed, F.lit("\u0002"), F.lit("](")), F.lit("\u0003"), F.lit(")")), "\u0001", "[")


def is_table_line(line: Column) -> Column:
    pipes = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    framed = line.startswith("|") & line.endswith("|")
    return (pipes >= 2) | framed | (line.rlike(r"^[|\-\s]+$") & line.contains("|"))


def is_rule_line(line: Column) -> Column:
    """A table's separator line: only pipes, dashes, colons and blanks."""
    return line.rlike(r"^[|\-:\s]+$")


def row_cells(line: Column) -> Column:
    """Cells of a Markdown table row, stripped, without what stands outside the outer pipes."""
    parts = F.split(line, r"\|", -1)
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), strip)


def row_csv(line: Column) -> Column:
    """The row's cells joined by commas; quotes aren't escaped."""
    return F.array_join(row_cells(line), ",")


def has_math(x: Column) -> Column:
    return F.coalesce(any_of(x, K.MATH), F.lit(False))


def looks_like_csv(x: Column) -> Column:
    """More than one line, and a comma or tab in one of them."""
    return x.contains("\n") & x.rlike(r"[,\t]")


def tags(x: Column, sections: Column) -> Column:
    """Semantic tags of a text with so many sections."""
    low, n = F.lower(x), F.size(tokens(x))
    found = [F.when(any_of(low, words), F.lit(tag)) for tag, words in K.TAGS]
    length = F.when(n > 10000, "long_document").when(n < 1000, "short_document").otherwise("medium_document")
    shape = F.when(sections > 10, "well_structured").when(sections < 3, "minimal_structure")
    return F.array_compact(F.array(*found, length, shape))


def coherence(x: Column) -> Column:
    """Heuristic score from 0 to 1: word length, sentence length, paragraphs, vocabulary."""
    w = tokens(x)
    n = F.size(w).cast("double")
    chars = F.length(F.array_join(w, "")).cast("double")
    sentences = F.size(F.split(x, r"\.", -1))
    paragraphs = F.size(F.filter(F.split(x, "\n\n", -1), lambda p: strip(p) != ""))
    lines = F.size(F.split(x, "\n", -1))
    kinds = F.size(F.array_distinct(F.split(F.lower(F.array_join(w, " ")), " ")))
    one = F.lit(1.0)
    score = F.least(one, chars / n / 6) * 0.2 + F.least(one, n / sentences / 20) * 0.3 + F.least(one, paragraphs * 2 / lines) * 0.2 + kinds / n * 0.3
    return F.when(n > 0, F.least(one, score)).otherwise(F.lit(0.0))


def percent(x: Column) -> Column:
    """'a%' or 'a-b%' (the middle) as a fraction; ~ and * are dropped, N/A and empty are null."""
    y = strip(F.regexp_replace(x, r"[%~*]|N/A", ""))
    parts = F.transform(F.split(y, "-", 2), lambda p: strip(p).try_cast("double"))
    return F.when(y.contains("-"), (F.get(parts, 0) + F.get(parts, 1)) / 200).otherwise(F.get(parts, 0) / 100)


def font_kind(font: Column, size: Column) -> Column:
    """Content type told by a font's name and mean size."""
    f = F.lower(font)
    bold, slanted = any_of(f, ["bold", "black", "heavy"]), any_of(f, ["italic", "oblique"])
    strong = F.when(size > 16, "title").when(size > 14, "heading").otherwise("emphasized_text")
    return F.when(bold, strong).when(slanted, "italic_text").when(size > 16, "large_text").when(size < 10, "small_text").otherwise("body_text")


def keep_text_layer(native: Column) -> Column:
    """Whether a page's own text is used rather than OCR."""
    return F.coalesce(F.length(strip(native)) > 10, F.lit(False))


def title_score(text: Column, words: Column, height: Column, x1: Column, most: int = 10) -> Column:
    """Points for being a title; 3 are enough."""
    first = F.replace(F.get(tokens(text), F.lit(0)), F.lit("."), F.lit(""))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return yes(words <= most) * 2 + yes(is_upper(text) | is_title(text)) + yes(height > 20) + yes(x1 > 100) + yes(strip(text).endswith(":")) * 2 + yes(first.rlike(r"^\d+$"))
