"""Votes in the order of a log: many on one attribute, each after the ones before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from . import difftree, upsert

#: Rows of a chunk of one attribute's log, and chunks composed in one step.
CHUNK, FAN = 10_000, 1_000


def apply_vote_log(trees: DataFrame, log: DataFrame, at: str = "at", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Trees after log(pub, attr, value, votes, ``at``), votes applied in order of
    ``at`` (ties by value, then votes) as difftree.upvote would one by one.

    No task folds an attribute's log. Votes only grow, so after the first vote the
    head has the most; from then on the head changes where a count exceeds all
    counts before it, and changes places with the head before. Such exchanges of
    two values compose whatever the places are, so chunks of the log give a
    permutation each, and permutations compose in a tree. Counts and heads at the
    start of a chunk come from sums and greatest counts of the chunks before it.

    Rows with a null are ignored, as are votes for records or attributes a tree does
    not have. A vote for a value that is not in the list counts for nothing, but as
    the first of its attribute it still brings the greatest to the front, as one of
    zero votes does. Negative votes raise an error.
    """
    keys = ["pub", "attr"]
    rows = log.select("pub", "attr", "value", F.col("votes").cast("long").alias("votes"), F.col(at).alias("at")).dropna()
    rows = rows.withColumn("votes", F.when(F.col("votes") < 0, F.raise_error(F.lit("a vote log has no negative votes")).cast("long")).otherwise(F.col("votes")))
    rows = written(upsert.running_index(rows, keys, [F.col("at"), F.col("value"), F.col("votes")], 1).withColumnRenamed("bucket", "n"), "log")
    trees = written(difftree.apply_votes(trees, rows.where("n = 0").select("pub", "attr", "value", F.col("votes").cast("int").alias("votes"))), "first_votes")
    rest = rows.where("n > 0 and votes > 0").select(*keys, "value", "votes", "n", F.floor(F.col("n") / chunk).alias("chunk"))
    change = _changes(trees, rest, fan).groupBy("pub").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.struct("perm", "added")))).alias("_log"))
    after = F.transform_values("attrs", lambda k, v: _rearranged(v, F.try_element_at("_log", k)))
    return trees.join(change, "pub", "left").withColumn("attrs", F.when(F.col("_log").isNull(), F.col("attrs")).otherwise(after)).drop("_log")


def _rearranged(nodes: Column, change: Column) -> Column:
    """A node list with the added votes, in the order of a permutation."""
    more = lambda p: F.coalesce(F.try_element_at(change["added"], p), F.lit(0).cast("long"))
    node = lambda p: F.struct(F.get(nodes, p)["value"].alias("value"), (F.get(nodes, p)["votes"] + more(p)).cast("int").alias("votes"), F.get(nodes, p)["bitvector"].alias("bitvector"))
    return F.when(change.isNull(), nodes).otherwise(F.transform(change["perm"], node))


def _changes(trees: DataFrame, rest: DataFrame, fan: int) -> DataFrame:
    """(pub, attr, perm, added): where a list's nodes go, and their further votes.
    Heads of trees have the most votes of their list."""
    keys = ["pub", "attr"]
    nodes = difftree.nodes(trees).select(*keys, "value", F.col("at").cast("int").alias("p"), F.col("votes").cast("long").alias("base"))
    lists = nodes.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("m"), F.max("base").alias("top"))
    totals = rest.groupBy(*keys, "chunk", "value").agg(F.sum("votes").alias("s")).join(nodes, [*keys, "value"]).join(lists, keys)
    past = W.partitionBy(*keys, "value").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = written(totals.withColumn("before", F.col("base") + F.coalesce(F.sum("s").over(past), F.lit(0))), "chunk_votes")
    peaks = totals.groupBy(*keys, "chunk", "m", "top").agg(F.max(F.col("before") + F.col("s")).alias("peak"))
    chunks_before = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    peaks = peaks.select(*keys, "chunk", "m", F.greatest("top", F.max("peak").over(chunks_before)).alias("most"))
    each = rest.join(totals.select(*keys, "chunk", "value", "p", "before"), [*keys, "chunk", "value"]).join(peaks, [*keys, "chunk"])
    count = F.col("before") + F.sum("votes").over(W.partitionBy(*keys, "chunk", "value").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    in_chunk = W.partitionBy(*keys, "chunk").orderBy("n")
    each = each.withColumn("count", count).withColumn("seen", F.max("count").over(in_chunk.rowsBetween(W.unboundedPreceding, -1)))
    heads = each.where(F.col("count") > F.greatest("most", "seen")).select(*keys, "chunk", "m", "n", "p")
    heads = written(heads.withColumn("prev", F.lag("p").over(in_chunk)), "heads")
    # The head at a chunk's start is the last of a chunk before it that has one; at the log's start it is in front.
    last = heads.groupBy(*keys, "chunk").agg(F.max_by("p", "n").alias("last"))
    last = last.select(*keys, "chunk", F.coalesce(F.last("last").over(chunks_before), F.lit(0)).alias("start"))
    swaps = heads.join(last, [*keys, "chunk"]).withColumn("prev", F.coalesce("prev", "start")).where("p <> prev")
    exchanged = lambda perm, s: F.transform(perm, lambda x: F.when(x == s["p"], s["prev"]).when(x == s["prev"], s["p"]).otherwise(x))
    perms = swaps.groupBy(*keys, "chunk").agg(F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("n", "prev", "p"))).alias("swaps"))
    perms = perms.select(*keys, "chunk", F.aggregate("swaps", _identity("m"), exchanged).alias("perm"))
    for width in (fan, fan, None):
        perms = _composed(perms, keys, width)
    added = totals.groupBy(*keys, "m", "p").agg(F.sum("s").alias("s")).groupBy(*keys, "m").agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("added"))
    return added.join(perms.select(*keys, "perm"), keys, "left").select(*keys, F.coalesce("perm", _identity("m")).alias("perm"), "added")


def _identity(m: str) -> Column:
    return F.sequence(F.lit(0), F.col(m) - 1)


def _composed(perms: DataFrame, keys: list[str], width: int | None) -> DataFrame:
    """One permutation for each ``width`` chunks in order; for all of them where None."""
    to = F.lit(0).cast("long") if width is None else F.floor(F.col("chunk") / width)
    lists = perms.withColumn("to", to).groupBy(*keys, "to").agg(F.array_sort(F.collect_list(F.struct("chunk", "perm"))).alias("ps"))
    then = lambda a, b: F.transform(a, lambda x: F.get(b["perm"], x))
    return lists.select(*keys, F.col("to").alias("chunk"), F.aggregate(F.slice("ps", 2, F.greatest(F.size("ps"), F.lit(1))), F.get("ps", F.lit(0))["perm"], then).alias("perm"))
