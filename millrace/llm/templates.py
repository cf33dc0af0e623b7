"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: first its number of tokens, then its leading tokens, with runs of digits already a
wildcard. In a leaf that enough documents reach, the tree generalises further: a position whose commonest token fills less
than half of the leaf's lines is a variable field. What stays fixed is the leaf's template, if it is at least ``similarity``
of the tokens; a line that has all its fixed tokens is of that template, and any other is a template of its own. Templates
found in ``min_docs`` documents or more recur: only their first line (smallest doc_id, then position) stays.

Only lines of leaves that recur are looked at token by token, and what is grouped by leaf, position or template is counted
with map-side combine, so a line that a third of all documents hold is no more than a large count. What is joined back to
lines is written first, so its true size is known when the join is planned: Spark broadcasts it up to
spark.sql.autoBroadcastJoinThreshold and shuffles both sides beyond.

Defined cases: NULL text stays NULL; lines without a token stay and belong to no template; rows with the same doc_id count
as one document and lose the same lines; NULL doc_id is one document; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACE, kept, let, lines, with_text, without_lines


def _tokens(masked):
    return F.array_remove(F.split(masked, SPACE), "")


def line_leaves(docs: DataFrame, depth: int) -> DataFrame:
    """Every line with a token: doc_id, position, masked line, number of tokens, and its leaf as a hash."""
    leaf = lambda m: let(_tokens(m), lambda t: F.struct(
        m.alias("m"), F.size(t).alias("n"), F.xxhash64(F.size(t), F.slice(t, 1, depth)).alias("leaf")))
    each = F.transform(lines(F.col("text")), lambda x: let(F.regexp_replace(x, "[0-9]+", "<*>"), leaf))
    found = docs.select("doc_id", F.posexplode(each).alias("__i", "__x")).filter(F.col("__x.n") > 0)
    return found.select("doc_id", "__i", F.col("__x.m").alias("__m"), F.col("__x.n").alias("__n"), F.col("__x.leaf").alias("__leaf"))


def recurring_lines(docs: DataFrame, depth: int = 4, similarity: float = 0.7, min_docs: int = 10) -> DataFrame:
    """The lines to drop: doc_id and the sorted positions in that document."""
    own = F.coalesce("doc_id", F.lit(-1))
    found = line_leaves(docs, depth)
    recur = kept(found.groupBy("__leaf").agg(F.countDistinct(own).alias("__d")).filter(F.col("__d") >= min_docs).select("__leaf"))
    held = kept(found.join(recur, "__leaf", "left_semi"))
    tokens = held.select("__leaf", "__n", F.posexplode(_tokens(F.col("__m"))).alias("__p", "__t")).filter(F.col("__p") >= depth)
    votes = tokens.groupBy("__leaf", "__n", "__p", "__t").agg(F.count(F.lit(1)).alias("__c"))
    most = votes.groupBy("__leaf", "__n", "__p").agg(
        F.max(F.struct("__c", "__t")).alias("__top"), F.sum("__c").alias("__all")).filter(2 * F.col("__top.__c") >= F.col("__all"))
    # a leaf without a fixed position beyond the leading tokens has a template too
    fixed = votes.select("__leaf", "__n").distinct().join(most, ["__leaf", "__n"], "left").groupBy("__leaf", "__n").agg(
        F.collect_list(F.when(F.col("__p").isNotNull(), F.struct(F.col("__p"), F.col("__top.__t").alias("__t")))).alias("__fixed"))
    fixed = fixed.filter(F.size("__fixed") + F.least(F.lit(depth), F.col("__n")) >= similarity * F.col("__n")).select("__leaf", "__fixed")
    split = held.withColumn("__t", _tokens(F.col("__m"))).join(kept(fixed), "__leaf", "left")
    fits = F.coalesce(F.forall("__fixed", lambda x: F.get("__t", x["__p"]) == x["__t"]), F.lit(False))
    named = kept(split.select("doc_id", "__i", F.when(fits, F.xxhash64(F.lit(1), "__leaf")).otherwise(F.xxhash64(F.lit(2), "__t")).alias("__template")))
    spread = named.groupBy("__template").agg(
        F.countDistinct(own).alias("__d"), F.min(F.struct("doc_id", "__i")).alias("__first")).filter(F.col("__d") >= min_docs)
    gone = named.join(kept(spread.drop("__d")), "__template").filter(~F.struct("doc_id", "__i").eqNullSafe(F.col("__first")))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("__i")).alias("__gone"))


def drop_recurring_lines(docs: DataFrame, counts: bool = False, **settings) -> DataFrame:
    """Documents without recurring lines; ``counts`` adds n_lines and n_dropped."""
    # grows with the documents, so both are shuffled by document at every size
    gone = recurring_lines(docs, **settings).select(F.col("doc_id").alias("__id"), "__gone").hint("merge")
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    out = with_text(joined, without_lines(F.col("text"), F.col("__gone")))
    if not counts:
        return out.select(*docs.columns)
    n = F.when(joined["text"].isNull(), 0).otherwise(F.size(lines(joined["text"]))).cast("long")
    counted = joined.withColumn("n_lines", n).withColumn("n_dropped", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
    return with_text(counted, without_lines(F.col("text"), F.col("__gone"))).select("doc_id", "n_lines", "n_dropped", "text")
