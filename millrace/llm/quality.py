"""Quality rules from line frequencies across the documents of a host.

Lines are normalised and hashed; a line that more than ``line_limit`` documents of a host hold is removed from all of
them but the first (the smallest doc_id), and a document that loses too much is rejected. Everything is DataFrame
functions: per-text measures stay in the row, only hashes of lines are shuffled, and a hot host or line is counted with
map-side combine.

Defined cases: NULL text has no words and fails the base rules; NULL hosts form a host of their own; rows with the same
doc_id count as one document, and a repeated row gets the verdict of the other; an empty line is no line. Only ``doc_id``, ``text`` and the host column are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, lines, with_text, without_lines, words

WINDOW = 5


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; ``hashes`` is in the order of the windows."""
    def positions(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    ordered = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(positions(s), total))


def repeated_words(own: Column) -> Column:
    """Words that lie in a window of five words found at least twice in ``own``, an array of words."""
    aligned = F.arrays_zip(*[F.slice(own, k + 1, F.size(own) - (WINDOW - 1)) for k in range(WINDOW)])
    hashes = F.transform(aligned, lambda x: F.xxhash64(x))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(own) < WINDOW, F.lit(0)).otherwise(counted)


def text_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id and the measures of the whole text: one pass, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    filled = F.filter(lines(F.col("text")), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(words(F.col("text")), lambda w: F.struct(
        F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), repeated_words(w).alias("r")))
    bare = docs.select("doc_id", F.col(host).alias("__host"), F.length(text).alias("n_chars"), per_words.alias("__w"),
                       (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
                       let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return bare.select(
        "doc_id", "__host", F.col("__w.n").cast("long").alias("n_words"), F.col("__w.c").cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", F.col("__w.r").cast("long").alias("n_repeat_words"), F.col("n_chars").cast("long").alias("n_chars"))


def frequent_lines(docs: DataFrame, host: str = "source", line_limit: int = 10) -> DataFrame:
    """Per document (doc_id, host): characters in the lines to remove and the positions of those lines."""
    hashed = F.transform(lines(F.col("text")), lambda x: F.struct(F.xxhash64(F.lower(F.trim(x))).alias("h"), F.length(x).alias("n")))
    every = (
        docs.select("doc_id", F.col(host).alias("__host"), F.posexplode(hashed).alias("__i", "__line"))
        .select("doc_id", "__host", "__i", F.col("__line.h").alias("__h"), F.col("__line.n").alias("__n")).filter("__n > 0"))
    spread = (
        every.groupBy("__host", "__h").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("__docs"), F.min("doc_id").alias("__first"))
        .filter(F.col("__docs") > line_limit).select(F.col("__host").alias("__fh"), F.col("__h").alias("__fl"), "__first"))
    over = every.join(spread, F.col("__h").eqNullSafe(F.col("__fl")) & F.col("__host").eqNullSafe(F.col("__fh")))
    return (
        over.filter(~F.col("doc_id").eqNullSafe(F.col("__first")))
        .groupBy("doc_id", "__host", "__i").agg(F.max("__n").alias("__n"))
        .groupBy("doc_id", "__host").agg(F.sum("__n").alias("__gone"), F.sort_array(F.collect_list("__i")).alias("__at")))


def quality_rules(
    docs: DataFrame, host: str = "source", *, line_limit: int = 10, min_words: int = 10, max_repeat_percent: int = 20,
    min_left: float = 0.3,
) -> DataFrame:
    """One row per document: measures, ``base_failed``, characters in removed lines, their positions, ``kept``.

    A document is depleted if under ``min_left`` of its characters are left.
    """
    measures = text_measures(docs, host)
    gone = frequent_lines(docs, host, line_limit).select(
        F.col("doc_id").alias("__id"), F.col("__host").alias("__ih"), "__gone", "__at")
    joined = measures.join(
        gone, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__host").eqNullSafe(F.col("__ih")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.coalesce(F.col("__gone"), F.lit(0)).cast("long")
    depleted = F.col("n_chars") - lost < min_left * F.col("n_chars")
    return joined.select(
        "doc_id", "__host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), lost.alias("removed_chars"), F.col("__at").alias("removed_lines"))


def keep_good(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The documents that the rules keep, without their removed lines; columns as in ``docs``."""
    verdict = quality_rules(docs, host, **limits).groupBy("doc_id", "__host").agg(
        F.max("kept").alias("__kept"), F.first("removed_lines", ignorenulls=True).alias("__at")).filter("__kept")
    verdict = verdict.select(F.col("doc_id").alias("__id"), F.col("__host").alias("__ih"), "__at")
    joined = docs.join(verdict, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col(host).eqNullSafe(F.col("__ih")))
    return with_text(joined, without_lines(F.col("text"), F.col("__at"))).select(*docs.columns)
