"""Record matching: blocking, similarity, and three-way outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import same_author
from ..functions.text import author_tokens, near_length, normalize_author, normalize_title, relevant_words, search_query, title_similarity
from ..storage import written
from .fts import all_tokens_match, best_matches, rarest_token_match, token_index

#: Outcome names shared by all matchers.
SAFE, LIMBO = "SAFE", "LIMBO"
NO_MATCH, SINGLE_MATCH, MULTI_MATCH = "NO_MATCH", "SINGLE_MATCH", "MULTI_MATCH"
AMB_ALIAS, AMB_CLUSTER, AMB_PUB, AMB_NAME_BLOCK = "AMB_ALIAS", "AMB_CLUSTER", "AMB_PUB", "AMB_NAME_BLOCK"


def outcome(found: Column, id_: Column, reason: Column | str) -> list[Column]:
    """status, match, id and reason by how many candidates were found."""
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return [
        F.when(found <= 1, SAFE).otherwise(LIMBO).alias("status"),
        F.when(found == 0, NO_MATCH).when(found == 1, SINGLE_MATCH).otherwise(MULTI_MATCH).alias("match"),
        F.when(found == 1, id_).alias("id"),
        F.when(found > 1, reason).alias("reason"),
    ]


def title_candidates(titles: DataFrame, key: str, title: str, clusters: DataFrame, threshold: int = 80, limit: int = 5) -> DataFrame:
    """(key, cluster_id, similarity, exact): clusters(id, name) similar to a title.

    A title's longest words pick candidates by shared tokens, the ``limit``
    most relevant are compared by edit distance, and where an equal name is
    among them only equal names stay. Each distinct title is searched once.
    """
    # A title goes by two hashes of itself, whatever its length.
    hashes = F.struct(F.xxhash64("norm"), F.xxhash64(F.lit(1), "norm"))
    rows = titles.select(key, normalize_title(title).alias("norm")).where("norm is not null").select(key, "norm", hashes.alias("_title"))
    # Written, so that no task holds the search's windows and joins and those of the rows at once.
    found = written(_distinct_candidates(rows.groupBy("_title").agg(F.first("norm").alias("norm")), "_title", clusters, threshold, limit), "found")
    return rows.select(key, "_title").join(found, "_title").drop("_title")


def _distinct_candidates(asked: DataFrame, key: str, clusters: DataFrame, threshold: int, limit: int) -> DataFrame:
    """title_candidates of asked(key, norm), normalised titles."""
    words = asked.withColumn("words", F.when(F.forall(relevant_words("norm"), lambda w: F.length(w) < 4), F.split("norm", " ")).otherwise(relevant_words("norm")))
    index = token_index(clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id", F.col("name"))
    near = written(best_matches(words, key, "words", index, "cluster_id", clusters.count(), limit), "near")
    pairs = near.join(asked, key).join(clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id")
    pairs = pairs.where(near_length("norm", "name", threshold)).withColumn("similarity", title_similarity("norm", "name")).where(F.col("similarity") >= threshold)
    pairs = pairs.withColumn("exact", F.col("norm") == F.col("name"))
    exact = pairs.groupBy(key).agg(F.max("exact").alias("any_exact"))
    return pairs.join(exact, key).where(F.col("exact") | ~F.col("any_exact")).select(key, "cluster_id", "similarity", "exact")


def equal_titles(left: DataFrame, right: DataFrame, title: str) -> DataFrame:
    """All columns but the titles of rows whose normalised titles are equal; null
    titles equal none. Rows meet by 128 bits of the title, whatever its length."""
    keys = lambda df: df.where(F.col(title).isNotNull()).withColumn("__t", normalize_title(title)).withColumns({"__h": F.xxhash64("__t"), "__g": F.xxhash64(F.lit(1), "__t")}).drop(title, "__t")
    return keys(left).join(keys(right), ["__h", "__g"]).drop("__h", "__g")


def decide_title(titles: DataFrame, key: str, candidates: DataFrame, publications: DataFrame) -> DataFrame:
    """One outcome per title: no cluster, one with exactly one publication,
    one with another number (AMB_PUB), several (AMB_CLUSTER)."""
    pubs = publications.groupBy(F.col("cluster_id")).agg(F.count(F.lit(1)).alias("pubs"))
    found = candidates.join(pubs, "cluster_id", "left").groupBy(key).agg(F.countDistinct("cluster_id").alias("n"), F.min("cluster_id").alias("cluster_id"), F.coalesce(F.min("pubs"), F.lit(0)).alias("pubs"))
    all_ = titles.select(key).join(found, key, "left")
    n = F.coalesce("n", F.lit(0))
    count = F.when((n == 1) & (F.col("pubs") != 1), 2).otherwise(n)  # one cluster, but not one publication
    return all_.select(key, *outcome(count, F.col("cluster_id"), F.when(n == 1, AMB_PUB).otherwise(AMB_CLUSTER)))


def match_exact_title(titles: DataFrame, key: str, title: str, clusters: DataFrame, publications: DataFrame) -> DataFrame:
    """The same outcomes for equal normalised titles only."""
    asked = titles.select(F.col(key), normalize_title(title).alias("name"))
    found = asked.join(clusters.select("name", F.col("id").alias("cluster_id")), "name").select(key, "cluster_id")
    return decide_title(titles, key, found, publications)


def match_alias(rows: DataFrame, key: str, name: str, aliases: DataFrame, reason: str = AMB_ALIAS) -> DataFrame:
    """Outcome by equal alias in aliases(alias, id)."""
    named = rows.select(key, F.col(name).alias("alias"))
    # Counted by alias first: the join gives a row for each name, however many ids its alias has.
    ids = aliases.select("alias", F.col("id").alias("hit")).distinct().groupBy("alias").agg(F.count("hit").alias("n"), F.min("hit").alias("hit"))
    found = named.join(ids, "alias", "left").groupBy(key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("hit").alias("hit"))
    return found.select(key, *outcome(F.col("n"), F.col("hit"), reason))


def match_authors(rows: DataFrame, key: str, name: str, normal: str, authors: DataFrame, aliases: DataFrame) -> DataFrame:
    """Author outcome: equal alias first; for names without one, authors(id,
    block_name) whose block has all telling words of the name and that pass
    same_author."""
    first = match_alias(rows, key, name, aliases)
    rest = rows.join(first.where(F.col("match") == NO_MATCH), key, "left_semi").select(key, F.col(normal).alias("normal")).withColumn("need", author_tokens("normal"))
    blocks = authors.select(F.col("id").alias("author_id"), "block_name", F.split("block_name", " ").alias("has"))
    pairs = all_tokens_match(rest, key, "need", blocks, "author_id", "has").join(rest.select(key, "normal"), key).join(blocks.select("author_id", "block_name"), "author_id")
    pairs = pairs.where(same_author("normal", "block_name"))
    found = rest.select(key).join(pairs.groupBy(key).agg(F.countDistinct("author_id").alias("n"), F.min("author_id").alias("author_id")), key, "left")
    second = found.select(key, *outcome(F.coalesce("n", F.lit(0)), F.col("author_id"), AMB_NAME_BLOCK))
    return first.where(F.col("match") != NO_MATCH).unionByName(second)


def similar_names(names: DataFrame, key: str, name: str, transform: Callable[[str], Column] = normalize_author) -> tuple[DataFrame, DataFrame]:
    """Which names of a table are alike: pairs (id, other) between classes of
    equal transformed names, and membership (key, id) in them; a class goes by
    its smallest key. The other name has one of the search words of the first
    and passes same_author, so pairs are directed. The join is by word and
    initials, with similarity as its condition: only pairs that are alike leave
    it. Null and blank names have none.
    """
    given = names.where(F.length(F.trim(name)) > 0).select(key, F.col(name).alias("_name"))
    # Each distinct name is transformed once, not again for either side of the join;
    # the filter comes after, or Spark would move it, and the transformation, before the grouping.
    forms = written(given.groupBy("_name").agg(F.min(key).alias("id")).select("_name", "id", transform("_name").alias("normal")), "forms").where("normal != ''")
    rows = given.join(forms.select("_name", "normal"), "_name").select(key, "normal")
    classes = forms.groupBy("normal").agg(F.min("id").alias("id")).withColumn("words", F.split("normal", " "))
    own, less = _initials("words")
    kind = lambda n, sig: F.transform(sig, lambda x: F.struct(F.lit(n).alias("kind"), x.alias("sig")))
    asked = classes.select("id", "normal", F.array_distinct(F.split(search_query("normal"), " ")).alias("words"), F.concat(kind(0, own), kind(1, own), kind(2, less)).alias("keys"))
    held = classes.select(F.col("id").alias("other"), F.col("normal").alias("other_name"), F.array_distinct("words").alias("words"), F.concat(kind(0, own), kind(1, less), kind(2, own)).alias("keys"))
    by_word = lambda df, *kept: df.select(*kept, "keys", F.explode("words").alias("word")).select(*kept, "word", F.explode("keys").alias("by")).select(*kept, "word", "by.kind", "by.sig")
    a, b = by_word(asked, "id", "normal").alias("a"), by_word(held, "other", "other_name").alias("b")
    same_key = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("word", "kind", "sig")]
    alike = same_key[0] & same_key[1] & same_key[2] & (F.col("id") != F.col("other")) & same_author("normal", "other_name")
    return a.join(b, alike).select("id", "other").distinct(), rows.join(classes, "normal").select(key, "id")


def _initials(words: str) -> tuple[Column, Column]:
    """Signatures that bound name pairs: the sorted initials, as an array of one,
    and those with one left out. Names that align have at most one word more on
    one side, and all other words have equal initials in pairs; so their sorted
    initials are equal, or equal once one is left out of the longer."""
    letters = F.array_sort(F.transform(words, lambda w: F.substring(w, 1, 1)))
    without = lambda i: F.array_join(F.filter(letters, lambda _, j: j != i), ",")
    return F.array(F.array_join(letters, ",")), F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 1), without))


def block_ladder(rows: DataFrame, key: str, name: str, entities: DataFrame, aliases: DataFrame, alias_first: bool = False) -> DataFrame:
    """(key, id, how, blocks) for media and keywords; id null where one is to be
    created; blocks says how many known entities share the name's block.

    entities(id, block_name), aliases(alias, id). Block first: one block match
    is used; of several, the one whose alias is equal; else create. Alias first:
    one alias match is used, several create, none falls back to a single block.
    """
    asked = rows.where(F.col(name).isNotNull()).select(key, F.col(name).alias("alias"), normalize_title(name).alias("block_name"))
    blocks = entities.groupBy("block_name").agg(F.count(F.lit(1)).alias("blocks"), F.min("id").alias("block_id"))
    if alias_first:
        named = aliases.select("alias", "id").distinct().groupBy("alias").agg(F.count(F.lit(1)).alias("named"), F.min("id").alias("alias_id"))
        out = asked.join(named, "alias", "left").join(blocks, "block_name", "left")
        by_alias = F.coalesce("named", F.lit(0))
        how = F.when(by_alias == 1, "alias").when((by_alias == 0) & (F.col("blocks") == 1), "block").otherwise("create")
    else:
        named = aliases.join(entities.select("id", "block_name"), "id").select("alias", "block_name", "id").distinct().groupBy("alias", "block_name").agg(F.count(F.lit(1)).alias("named"), F.min("id").alias("alias_id"))
        out = asked.join(blocks, "block_name", "left").join(named, ["alias", "block_name"], "left")
        how = F.when(F.col("blocks") == 1, "block").when((F.col("blocks") > 1) & (F.col("named") == 1), "alias").otherwise("create")
    out = out.withColumn("how", how)
    return out.select(key, F.when(F.col("how") == "alias", F.col("alias_id")).when(F.col("how") == "block", F.col("block_id")).alias("id"), "how", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def match_type(rows: DataFrame, key: str, name: str, types: DataFrame, default: str = "misc") -> DataFrame:
    """(key, type_id): the type of that name, else the default's. types(id, name)
    is a small dimension; Spark broadcasts it by its size."""
    other = types.where(F.col("name") == default).agg(F.min("id").alias("id"))
    known = types.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_id"))
    return rows.join(known, F.col(name) == F.col("_name"), "left").select(key, F.coalesce("_id", other.scalar()).alias("type_id"))


def skip_known(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key was not ingested before."""
    return rows.join(known.select(*on), on, "left_anti")


def link_by_phrase(left: DataFrame, lkey: str, lname: str, right: DataFrame, rkey: str, rname: str) -> DataFrame:
    """(lkey, rkey): the last right row whose normalised text holds the left
    text as a phrase. Blocked on the left text's rarest word; each text is
    normalised once."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    asked = left.select(lkey, normalize_title(lname).alias("phrase")).where("phrase != ''").withColumn("need", F.split("phrase", " "))
    texts = written(right.select(rkey, normalize_title(rname).alias("text")), "texts")
    pairs = rarest_token_match(asked, lkey, "need", texts.withColumn("has", F.split("text", " ")), rkey, "has").select(lkey, rkey)
    pairs = pairs.join(asked.select(lkey, "phrase"), lkey).join(texts, rkey)
    return pairs.where(F.contains(pad(F.col("text")), pad(F.col("phrase")))).groupBy(lkey).agg(F.max(rkey).alias(rkey))
