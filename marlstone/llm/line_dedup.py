"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

A text is cut at line feeds. Two families of chunks have boundaries that depend on the lines near them alone, so that they come back at
the same lines when a passage is moved:

* sparse: a rolling hash over the hashes of the last WINDOW lines marks a boundary wherever it is 0 modulo DIVISOR; a chunk is what lies
  between two boundaries, if it has MIN_LINES or more lines;
* dense: a boundary at every line: all pairs of adjacent lines, and single lines of LEAST_WORDS or more words.

A chunk is *old* if the whole corpus has an equal one (same family, compared byte by byte) at an earlier place (smallest doc_id, then text
hash, then line). What goes: old sparse chunks; runs of lines whose pairs are all old, if the run has LEAST_WORDS words; old single
lines. Sparse boundaries alone leave a repeated passage that holds no whole chunk; with the dense family every repeated passage of
LEAST_WORDS words goes whole, and each line that goes has an equal line that stays, at an earlier place.

How it runs: hashes are counted first, and only hashes (one narrow row per chunk). Then the rows of repeated hashes alone are joined to
the texts, to compare bytes. Hot chunks are served by a broadcast of bounded size, and no task holds more of a key than its rows.

Defined results: a null text stays null; an empty text is one empty line; a text whose lines all go becomes empty and its row stays.
Null ids come last in the order of occurrences; rows with the same id and text are one document whose chunks occur once. Extra columns
are carried whatever their names; if ``removed_lines`` is taken, the new column gets underscores. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, join_hot, stash

WINDOW, DIVISOR, MIN_LINES = 2, 4, 2
LEAST_WORDS = 50
WORD = r"[^\x09\x0B\x0C\x0D\x20]+"
SPARSE, PAIR, LINE = 0, 1, 2
_LAST = (1 << 63) - 1
FEW = 200_000  # repeated keys, of 16 bytes, that are broadcast; more are joined by a shuffle
HOT_BYTES = 1 << 16  # longest chunk text that is broadcast (to join_hot's thousand hot keys at most)


def line_hash(line: Column) -> Column:
    """28 bits of the line's md5, so that rolling sums never overflow."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """_d (id), _t (hash of the text), text; the row's other columns stay out, so that no name can clash."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_d"), F.xxhash64("text").alias("_t"), "text", *more)


def _fixed(df: DataFrame, name: str, col: Column) -> DataFrame:
    """A column that is computed once a row: without the generator, Catalyst would copy its expression into the lambdas that use it."""
    return df.withColumn(name, F.explode(F.array(col)))


def chunks(docs: DataFrame) -> DataFrame:
    """One narrow row per chunk: _d, _t, kind, start, end (lines, inclusive), w0 and w1 (words of the first and last line), key (hash).

    Sparse chunks of LEAST_WORDS or more words are left to the pairs: where one is old, so are all its pairs, and their run has the words.
    """
    each = _fixed(_keyed(docs.where("text IS NOT NULL").select("doc_id", "text")), "lines", F.split("text", "\n", -1)).drop("text")
    facts = F.transform("lines", lambda x: F.struct(line_hash(x).alias("r"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w")))
    each = _fixed(each, "f", facts).select("_d", "_t", "f", F.size("f").alias("n"))  # from here on without the lines

    def rolling(i: Column) -> Column:
        return sum((F.coalesce(F.get("f.r", i - k), F.lit(0)) * 31**k for k in range(1, WINDOW)), F.get("f.r", i))

    at = F.sequence(F.lit(0), F.col("n") - 1)
    each = _fixed(each, "ends", F.filter(at, lambda i: (i == F.col("n") - 1) | (rolling(i) % DIVISOR == 0)))
    spans = F.transform("ends", lambda e, j: F.struct(F.coalesce(F.get("ends", j - 1) + 1, F.lit(0)).alias("start"), e.alias("end")))

    def chunk(kind: int, start: Column, end: Column, hashed: list[Column]) -> Column:
        key = F.xxhash64(F.lit(kind), *hashed)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.get("f.w", start).alias("w0"), F.get("f.w", end).alias("w1"), key.alias("key"))

    words = lambda s: F.aggregate(F.slice("f.w", s.start + 1, s.end - s.start + 1), F.lit(0), lambda a, x: a + x)
    few = F.filter(spans, lambda s: (s.end - s.start + 1 >= MIN_LINES) & (words(s) < LEAST_WORDS))
    sparse = F.transform(few, lambda s: chunk(SPARSE, s.start, s.end, [F.slice("f.h", s.start + 1, s.end - s.start + 1)]))
    pairs = F.transform(F.filter(at, lambda i: i < F.col("n") - 1), lambda i: chunk(PAIR, i, i + 1, [F.get("f.h", i), F.get("f.h", i + 1)]))
    single = F.transform(F.filter(at, lambda i: F.get("f.w", i) >= LEAST_WORDS), lambda i: chunk(LINE, i, i, [F.get("f.h", i)]))
    return each.select("_d", "_t", F.explode(F.concat(sparse, pairs, single)).alias("s")).select("_d", "_t", "s.*")


def _in_long_runs(rows: DataFrame, is_pair: Column) -> DataFrame:
    """``rows`` but for the pairs of runs under LEAST_WORDS (a run: pairs that follow one another); dealt by _d, _t."""
    each = rows.repartition("_d", "_t").dropDuplicates(["_d", "_t", "kind", "start", "end"]).withColumn("_p", is_pair)
    at = each.withColumn("_run", F.col("start") - F.row_number().over(Window.partitionBy("_d", "_t", "_p").orderBy("start")))
    run = Window.partitionBy("_d", "_t", "_p", "_run")
    words = at.withColumn("_words", F.sum("w0").over(run) + F.max_by("w1", "start").over(run))
    return words.where(~F.col("_p") | (F.col("_words") >= LEAST_WORDS)).drop("_p", "_run", "_words")


def removals(docs: DataFrame) -> DataFrame:
    """Chunks that go: _d, _t, start, end (they may overlap)."""
    each = stash(chunks(docs), "op1-chunks")
    repeated = stash(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "op1-repeated")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = stash(join_hot(each, repeated, "key", "n", total, few=FEW, inner=True), "op1-found")
    first = found.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("_d", "_t", "start")).alias("first"))
    found = join_hot(found, first, "key", "m", total)
    found = found.withColumn("old", F.struct("_d", "_t", "start") != F.col("first")).drop("first", "m")
    found = _in_long_runs(found, (F.col("kind") == PAIR) & F.col("old"))
    spots = found.groupBy("_d", "_t").agg(F.collect_list(F.struct("kind", "start", "end", "w0", "w1", "key", "n", "old")).alias("spots"))  # at most a text's own chunks
    lines = _fixed(_keyed(docs.select("doc_id", "text")).join(spots, ["_d", "_t"]), "lines", F.split("text", "\n", -1))
    body = lambda s: F.array_join(F.slice("lines", s.start + 1, s.end - s.start + 1), "\n")
    texts = lines.select("_d", "_t", F.explode(F.transform("spots", lambda s: F.struct(s.alias("s"), body(s).alias("chunk")))).alias("x"))
    texts = stash(texts.select("_d", "_t", "x.s.*", "x.chunk"), "op1-texts")
    kept = texts.where("NOT old").dropDuplicates(["key"]).select("key", "n", F.col("chunk").alias("kept"))
    same = join_hot(texts.where("old").drop("n"), kept, "key", "n", total, hot_if=F.octet_length("kept") <= HOT_BYTES)
    same = same.where(F.col("chunk") == F.col("kept")).select("_d", "_t", "kind", "start", "end", "w0", "w1")  # the byte comparison
    return _in_long_runs(same, F.col("kind") == PAIR).select("_d", "_t", "start", "end")


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a text (_d, _t, start, end) that overlap made one; one row per text with the sorted spans."""
    before = Window.partitionBy("_d", "_t").orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    at = spans.withColumn("_new", (reach.isNull() | (F.col("start") > reach)).cast("int")).withColumn("_k", F.sum("_new").over(before))
    one = at.groupBy("_d", "_t", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("_d", "_t").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("gone"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and removed_lines (long)."""
    gone = merged(removals(docs))
    both = _keyed(docs, F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c != "text"]).alias("row")).join(gone, ["_d", "_t"], "left")
    n, lines = F.size("gone"), F.split("text", "\n", -1)

    def between(j: Column) -> Column:
        """Lines after the (j-1)-th span that goes and before the j-th."""
        low = F.coalesce(F.get("gone", j - 1)["end"] + 1, F.lit(0))
        return F.slice("lines", low + 1, F.coalesce(F.get("gone", j)["start"], F.size("lines")) - low)

    # only rows that lose something are cut into lines
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + (g.end - g.start + 1).cast("long")), F.lit(0).cast("long"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    columns = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns, removed.alias(free_name(docs.columns, "removed_lines")))
