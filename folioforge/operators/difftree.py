"""The difference tree: all values of a record's attributes with their sources.

A tree is one row per record: ``url_ids``, the sources in order of arrival, and
``attrs``, a map from attribute to an array of nodes (value, votes, bitvector)
in order of first arrival; bit i of a bitvector stands for url_ids[i].
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import bit, bit_indexes
from ..storage import written

#: The attributes of a tree, and those that hold ids.
ATTRIBUTES = ["title", "pages", "note", "doi", "abstract", "copyright", "date_published", "volume", "number", "keyword_ids", "author_ids", "pub_source_ids", "type_ids", "study_field_ids"]
ID_ATTRIBUTES = ["keyword_ids", "author_ids", "pub_source_ids", "type_ids", "study_field_ids"]
MULTI = ["author_ids", "keyword_ids"]


def melt(rows: DataFrame, pub: str, url: str, seq: str, attributes: list[str]) -> DataFrame:
    """(pub, url_id, seq, attr, value): one row per value; nulls have none, and
    arrays one per element. Attributes that rows lack count as null."""
    parts = []
    for a in attributes:
        if a in rows.columns:
            c = F.col(a)
            values = F.coalesce(c.cast("array<string>"), F.array().cast("array<string>")) if rows.schema[a].dataType.typeName() == "array" else F.array(c.cast("string"))
            parts.append(F.transform(values, _entry(a)))
    each = rows.select(F.col(pub).alias("pub"), F.col(url).alias("url_id"), F.col(seq).alias("seq"), F.explode(F.flatten(F.array(*parts))).alias("x"))
    return each.select("pub", "url_id", "seq", "x.attr", "x.value", "x.at").where("value is not null")


def _entry(attr: str):
    return lambda v, i: F.struct(F.lit(attr).alias("attr"), v.alias("value"), i.alias("at"))


def source_bits(rows: DataFrame, pub: str, url: str, seq: str) -> DataFrame:
    """(pub, url_ids, url_id, place): sources by first arrival. The sources of a
    record are at most 63, so that a record's list is bounded."""
    lists = _source_lists(rows, pub, url, seq)
    return lists.select("pub", "url_ids", F.posexplode("url_ids").alias("place", "url_id"))


def _source_lists(rows: DataFrame, pub: str, url: str, seq: str) -> DataFrame:
    """(pub, url_ids): each record's sources by first arrival."""
    first = rows.groupBy(F.col(pub).alias("pub"), F.col(url).alias("url_id")).agg(F.min(seq).alias("first"))
    lists = first.groupBy("pub").agg(F.array_sort(F.collect_list(F.struct("first", "url_id"))).alias("s"))
    return lists.select("pub", F.transform("s", lambda x: x["url_id"]).alias("url_ids"))


def _placed(rows: DataFrame, lists: DataFrame, pub: str, url: str) -> DataFrame:
    """Rows with the bit of their source in lists(pub, url_ids), in the record's
    partition: what is grouped by record and more has no further exchange. Values
    are melted after it, so that a row is shuffled once, not once for each value."""
    known = rows.where(F.col(url).isNotNull()).join(lists.select(F.col("pub").alias("_pub"), "url_ids"), F.col(pub) == F.col("_pub"))
    return known.withColumn("_bit", bit(F.array_position("url_ids", F.col(url)) - 1)).drop("_pub", "url_ids")


def _melted_bits(rows: DataFrame, lists: DataFrame, pub: str, url: str, seq: str, attributes: list[str]) -> DataFrame:
    """(pub, attr, value, bit, seq, at): melted rows with their source's bit."""
    each = melt(_placed(rows, lists, pub, url), pub, "_bit", seq, attributes)
    return each.withColumnRenamed("url_id", "bit")


def node_rows(rows: DataFrame, pub: str, url: str, seq: str, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(pub, attr, value, votes, bitvector, ord): the nodes, unnested."""
    each = _melted_bits(rows, _source_lists(rows, pub, url, seq), pub, url, seq, attributes)
    return each.groupBy("pub", "attr", "value").agg(F.lit(0).alias("votes"), F.bit_or("bit").alias("bitvector"), F.min(F.struct("seq", "at")).alias("ord"))


def _nested(grown: DataFrame) -> DataFrame:
    """(pub, attrs) of nodes in their order."""
    lists = grown.groupBy("pub", "attr").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("value", "votes", "bitvector").alias("node")))).alias("nodes"))
    return lists.groupBy("pub").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.transform("nodes", lambda x: x["node"])))).alias("attrs"))


def merge(rows: DataFrame, pub: str, url: str, seq: str, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """One tree (pub, url_ids, attrs) per record, from rows in order of seq."""
    return _source_lists(rows, pub, url, seq).join(_nested(node_rows(rows, pub, url, seq, attributes)), "pub", "left")


def insert(trees: DataFrame, rows: DataFrame, pub: str, url: str, seq: str, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """Trees with the values of more rows: old nodes and sources keep their order,
    whatever the new rows' seq, and new ones come after them; votes stay. As new
    sources get new bits, old bitvectors stay as they are. Nodes without a source
    leave. The trees are written once, as they are read three times."""
    arrived = lambda generation, at: F.struct(F.lit(generation).alias("generation"), at.cast("long").alias("at")).alias("seq")
    trees = written(trees.select("pub", "url_ids", "attrs"), "trees")
    places = trees.select("pub", F.posexplode("url_ids").alias("p", "url_id")).select("pub", "url_id", arrived(0, F.col("p")))
    fresh = rows.withColumn(seq, arrived(1, F.col(seq)))
    arrivals = places.unionByName(fresh.select(F.col(pub).alias("pub"), F.col(url).alias("url_id"), F.col(seq).alias("seq")))
    lists = _source_lists(arrivals, "pub", "url_id", "seq")
    old = nodes(trees).where("bitvector != 0").select("pub", "attr", "value", F.col("bitvector").alias("bit"), arrived(0, F.lit(0)), "at", "votes")
    more = _melted_bits(fresh, lists, pub, url, seq, attributes).select("pub", "attr", "value", "bit", "seq", "at", F.lit(0).alias("votes"))
    grown = old.unionByName(more).groupBy("pub", "attr", "value").agg(F.max("votes").alias("votes"), F.bit_or("bit").alias("bitvector"), F.min(F.struct("seq", "at")).alias("ord"))
    return lists.join(_nested(grown), "pub", "left")


def retract(trees: DataFrame, gone: DataFrame) -> DataFrame:
    """Trees without the sources gone(pub, url_id): their bits leave all nodes, nodes
    that no source is left for leave with their votes, the rest keep their order;
    the bits of later sources move down. A tree without sources leaves. Sources
    that a tree does not have are ignored."""
    lost = gone.select("pub", "url_id").distinct().groupBy("pub").agg(F.collect_set("url_id").alias("_gone"))  # of those a record has, 63 at most
    kept = trees.select("pub", F.explode("url_ids").alias("url_id")).join(gone.select("pub", "url_id").distinct(), ["pub", "url_id"], "left_semi").select("pub").distinct()
    there = F.filter(F.sequence(F.lit(0), F.size("url_ids") - 1), lambda i: ~F.array_contains("_gone", F.get("url_ids", i)))
    # Bit i of what is left stands for the i-th source that stays.
    moved = lambda v: F.aggregate(F.transform("_there", lambda p, i: F.when(F.getbit(v, p) == 1, bit(i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    node = lambda n: F.struct(n["value"].alias("value"), n["votes"].alias("votes"), moved(n["bitvector"]).alias("bitvector"))
    attrs = F.map_filter(F.transform_values("attrs", lambda _, nodes_: F.filter(F.transform(nodes_, node), lambda n: n["bitvector"] != 0)), lambda _, v: F.size(v) > 0)
    touched = trees.join(kept, "pub", "left_semi").join(lost, "pub").where(F.size("url_ids") > 0).withColumn("_there", there).where(F.size("_there") > 0)
    touched = touched.select("pub", F.transform("_there", lambda i: F.get("url_ids", i)).alias("url_ids"), attrs.alias("attrs"))
    return trees.join(kept, "pub", "left_anti").select("pub", "url_ids", "attrs").unionByName(touched)


def nodes(trees: DataFrame) -> DataFrame:
    """(pub, url_ids, attr, at, value, votes, bitvector): trees unnested."""
    each = trees.select("pub", "url_ids", F.explode("attrs").alias("attr", "list"))
    return each.select("pub", "url_ids", "attr", F.posexplode("list").alias("at", "n")).select("pub", "url_ids", "attr", "at", "n.value", "n.votes", "n.bitvector")


def defaults(trees: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """A record's default values: the first node of each attribute without ids."""
    head = lambda a: F.get(F.col("attrs")[a], F.lit(0))["value"]
    return trees.select("pub", *[head(a).alias(a) for a in attributes if a not in ID_ATTRIBUTES])


def default_id(attr: str, current: Column) -> Column:
    """The tree's default type or medium id, else the current one."""
    return F.coalesce(F.get(F.col("attrs")[attr], F.lit(0))["value"].cast("long"), current)


def per_source(trees: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(pub, url_id, attr, values, votes): the tree as each source gave it, with
    arrays in node order; sources(url_id, url, domain) are joined if given."""
    each = nodes(trees).withColumn("i", F.explode(bit_indexes("bitvector"))).withColumn("url_id", F.get("url_ids", F.col("i")))
    back = each.groupBy("pub", "url_id", "attr").agg(F.array_sort(F.collect_list(F.struct("at", "value", "votes"))).alias("x"))
    back = back.select("pub", "url_id", "attr", F.transform("x", lambda n: n["value"]).alias("values"), F.transform("x", lambda n: n["votes"]).alias("votes"))
    return back if sources is None else back.join(sources, "url_id", "left")


def value_votes(trees: DataFrame) -> DataFrame:
    """(pub, attr, votes): a map from value to votes, id attributes left out."""
    skip = [a for a in ID_ATTRIBUTES if a != "study_field_ids"]
    each = trees.select("pub", F.explode("attrs").alias("attr", "list")).where(~F.col("attr").isin(skip) & (F.size("list") > 0))
    return each.select("pub", "attr", F.map_from_entries(F.transform("list", lambda n: F.struct(n["value"], n["votes"]))).alias("votes"))


def upvote(nodes_: Column, value: Column, votes: Column) -> Column:
    """A node list after votes for a value. Walking along the list, a node that
    then has more votes than the head changes places with it."""
    counted = F.transform(nodes_, lambda n: F.struct(n["value"].alias("value"), F.when(n["value"] == value, n["votes"] + votes).otherwise(n["votes"]).alias("votes"), n["bitvector"].alias("bitvector")))

    def walk(s: Column, i: Column) -> Column:
        head, own = F.get(s, F.lit(0)), F.get(s, i)
        return F.when(own["votes"] > head["votes"], F.transform(s, lambda n, k: F.when(k == 0, own).when(k == i, head).otherwise(n))).otherwise(s)

    return F.when(F.size(nodes_) < 2, counted).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(nodes_) - 1, F.lit(1))), counted, walk))


def apply_votes(trees: DataFrame, votes: DataFrame) -> DataFrame:
    """Trees after votes(pub, attr, value, votes), at most one row per attribute of a record."""
    cast = votes.groupBy("pub").agg(F.map_from_entries(F.collect_list(F.struct("attr", F.struct("value", "votes")))).alias("_cast"))
    new = F.transform_values("attrs", lambda k, v: F.when(F.col("_cast").isNotNull() & F.map_contains_key(F.coalesce("_cast", F.expr("map()").cast("map<string,struct<value:string,votes:int>>")), k), upvote(v, F.col("_cast")[k]["value"], F.col("_cast")[k]["votes"])).otherwise(v))
    return trees.join(cast, "pub", "left").withColumn("attrs", new).drop("_cast")


def to_json(trees: DataFrame) -> DataFrame:
    return trees.select("pub", F.to_json(F.struct("url_ids", "attrs")).alias("tree"))


def from_json(rows: DataFrame, url_type: str = "bigint") -> DataFrame:
    schema = f"url_ids array<{url_type}>, attrs map<string,array<struct<value:string,votes:int,bitvector:bigint>>>"
    return rows.select("pub", F.from_json("tree", schema).alias("t")).select("pub", "t.url_ids", "t.attrs")


def bench(rows: DataFrame, pub: str, url: str, seq: str, attributes: list[str] = ATTRIBUTES) -> dict[str, float]:
    """Seconds to merge rows into trees, to insert the later half of them into the
    trees of the earlier, and to read the trees back by source. Results go nowhere."""
    mid = rows.agg(F.expr(f"percentile_approx({seq}, 0.5)")).first()[0]
    early, late = rows.where(F.col(seq) <= mid), rows.where(F.col(seq) > mid)
    steps = {
        "merge": lambda: merge(rows, pub, url, seq, attributes),
        "insert": lambda: insert(merge(early, pub, url, seq, attributes), late, pub, url, seq, attributes),
        "sources": lambda: per_source(merge(rows, pub, url, seq, attributes)),
    }
    times = {}
    for name, step in steps.items():
        began = time.perf_counter()
        step().write.format("noop").mode("overwrite").save()
        times[name] = time.perf_counter() - began
    return times
