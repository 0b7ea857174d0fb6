"""Citations: references, download queue and the reference state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name
from ..operators.match import title_candidates

#: States of a reference, and the tries after which it is given up.
OPEN, INCOMPLETE, LIMIT, FINISHED = "OP", "INC", "LIM", "FIN"
MAX_TRIES = 5
#: The lowest status of a failed request, and that of a missing file.
BAD, MISSING = 400, 404


def resolve_references(refs: DataFrame, key: str, title: str, clusters: DataFrame, threshold: int = 80) -> DataFrame:
    """refs(key, title, tries, status) after one round: one cluster finishes a
    reference, none counts a try (given up at MAX_TRIES), several give it up.
    References that are not open or incomplete stay; cluster_id is the edge."""
    live = refs.where(F.col("status").isin(OPEN, INCOMPLETE))
    found = title_candidates(live, key, title, clusters, threshold).groupBy(key).agg(F.countDistinct("cluster_id").alias("n"), F.min("cluster_id").alias("hit"))
    n = F.coalesce("n", F.lit(0))
    tries = F.when(n == 0, F.col("tries") + 1).otherwise(F.col("tries"))
    status = F.when(n == 1, FINISHED).when((n == 0) & (F.col("tries") + 1 < MAX_TRIES), INCOMPLETE).otherwise(LIMIT)
    done = live.join(found, key, "left").withColumn("status", status).withColumn("tries", tries).withColumn("cluster_id", F.when(n == 1, F.col("hit"))).drop("n", "hit")
    rest = refs.where(~F.col("status").isin(OPEN, INCOMPLETE)).withColumn("cluster_id", F.lit(None).cast(clusters.schema["id"].dataType))
    return done.unionByName(rest)


def next_sources(refs: DataFrame, source: str, updated: str, today: Column, limit: int) -> DataFrame:
    """The references of the first ``limit`` sources, by id, whose last round was
    before ``today`` or never, and that have any left open."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    due = refs.where(F.col("status").isin(OPEN, INCOMPLETE) & (F.col(updated).isNull() | (F.col(updated) < today)))
    return due.join(due.select(source).distinct().orderBy(source).limit(limit), source, "left_semi").select(*refs.columns)


def citation_edges(resolved: DataFrame, source: str) -> DataFrame:
    """(source, reference): each once."""
    return resolved.where("cluster_id is not null").select(F.col(source).alias("source"), F.col("cluster_id").alias("reference")).distinct()


def queue_for(records: DataFrame, identifier: str = "identifier") -> DataFrame:
    """Download queue rows of preprint records."""
    return records.select(F.col(identifier).alias("source"), F.concat(F.lit("https://arxiv.org/pdf/"), F.col(identifier), F.lit(".pdf")).alias("url"), F.lit(0).alias("tries"), F.lit(None).cast("timestamp").alias("last_try"))


def next_in_queue(queue: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The first queue rows that were never tried or not since ``now``."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return queue.where(F.col("last_try").isNull() | (F.col("last_try") < now)).orderBy("id").limit(limit)


def attempted(results: DataFrame, limit: int | None = None) -> DataFrame:
    """The results(id, http_status) of a round that ends with its ``limit``-th
    answered request, in the order of id. Refused and missing files do not count
    against the limit. Only the last id of the round comes to the driver."""
    if limit is None:
        return results
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    answered = results.where(F.col("http_status") < BAD).orderBy("id").limit(limit)
    end = answered.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
    return results.where(F.col("id") <= end["last"]) if end["n"] == limit else results


def after_download(queue: DataFrame, results: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue after results(source, http_status), and their counts: an answer
    below 400 leaves as successful, 404 as invalid, anything else is tried again
    later."""
    q = queue.join(results.select("source", "http_status"), "source", "left")
    status = F.col("http_status")
    outcome = F.when(status < BAD, "successful").when(status == MISSING, "invalid").when(status.isNotNull(), "skipped")
    q = q.withColumn("outcome", outcome)
    again = F.coalesce(F.col("outcome") == "skipped", F.lit(False))
    kept = q.where(F.col("outcome").isNull() | again)
    kept = kept.withColumn("tries", F.when(again, F.col("tries") + 1).otherwise(F.col("tries"))).withColumn("last_try", F.when(again, now).otherwise(F.col("last_try")))
    return kept.select(*queue.columns), q.where("outcome is not null").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def with_file(queue: DataFrame) -> DataFrame:
    return queue.withColumn("file", file_name("url"))
