"""Steps whose work must not grow with the square of the rows that share a name."""

import pytest
from pyspark.sql import functions as F

from folioforge import catalog
from folioforge.functions.distance import edit_distances, letter_pairs
from folioforge.operators import difftree, match, sequence


@pytest.fixture
def rows_of(spark):
    """The rows that the plan's nodes of a kind put out, once df has run."""

    def count(df, kind):
        df.collect()
        nodes, found = [df._jdf.queryExecution().executedPlan()], []
        while nodes:
            node = nodes.pop()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
            if kind in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
        return found

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield count
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_alias_is_counted_before_it_is_joined(spark, rows_of):
    rows = spark.range(300).select(F.col("id").alias("k"), F.lit("a name").alias("name"))
    aliases = spark.range(200).select(F.when(F.col("id") < 199, "a name").otherwise("other").alias("alias"), (F.col("id") % 150).alias("id"))
    found = match.match_alias(rows.union(spark.createDataFrame([(300, "other"), (301, "no one's"), (302, None)], "k long, name string")), "k", "name", aliases)
    assert max(rows_of(found, "Join")) <= 303
    got = {r["k"]: (r["match"], r["id"]) for r in found.collect()}
    assert got == {**{k: ("MULTI_MATCH", None) for k in range(300)}, 300: ("SINGLE_MATCH", 49), 301: ("NO_MATCH", None), 302: ("NO_MATCH", None)}


def test_equal_titles_are_searched_once(spark, monkeypatch):
    asked, plain = [], match.best_matches

    def seen(queries, *args):
        asked.append(queries.count())
        return plain(queries, *args)

    monkeypatch.setattr(match, "best_matches", seen)
    titles = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "Deep Graphs").when(F.col("id") > 3, "deep  graph").alias("title"))
    known = spark.createDataFrame([(7, "deep graph"), (8, "deep graphs")], "id long, name string")
    got = sorted((r["id"], r["cluster_id"], r["similarity"], r["exact"]) for r in match.title_candidates(titles, "id", "title", known).collect())
    assert got == [(i, 7 + (i % 2 == 0), 100, True) for i in range(200) if i not in (1, 3)]
    assert asked == [2]


def test_equal_names_are_compared_once(spark, rows_of, tmp_path):
    part = spark.range(100).select(F.col("id").alias("p_partkey"), F.when(F.col("id") % 2 == 0, "red bolt").otherwise("new anvil").alias("p_name"))
    part.write.parquet(f"{tmp_path}/part.parquet")
    found = catalog.author_similarity(spark, str(tmp_path))
    assert max(rows_of(found, "Generate")) <= 8 and found.count() == 400


def test_equal_names_are_transformed_once(spark):
    """Rows that share a name are one call of the transformation, and one of either side's names."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def lower(name):
        calls.add(1)
        return name.lower()

    names = spark.range(300).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "Red Bolt").otherwise("R Bolt").alias("name"))
    pairs, members = match.similar_names(names, "key", "name", lower)
    assert {(r["id"], r["other"]) for r in pairs.collect()} == {(0, 1), (1, 0)}
    assert {(r["key"], r["id"]) for r in members.collect()} == {(k, k % 2) for k in range(300)}
    assert calls.value == 2


def test_a_pair_of_titles_is_compared_once(spark, rows_of):
    """Titles that share several words leave the join as one pair; those over 64 letters are compared there."""
    tails = ["".join(chr(97 + (i * 7 + j * j) % 26) for j in range(5)) for i in range(20)]
    short, long_ = [f"learning representations structured {t}" for t in tails], [f"{'learning representations structured ' * 2}{t}" for t in tails]
    asked = spark.createDataFrame([(n,) for n in short + long_], "name string")
    found = sequence.similar_titles(asked, asked.select(F.col("name").alias("other"), F.lit(0).alias("k")), "k")
    assert max(rows_of(found, "Join")) == 2 * 20 * 20
    assert {(r["name"], r["other"]) for r in found.collect()} == {(a, b) for group in (short, long_) for a in group for b in group}


def test_a_family_of_titles_meets_its_clusters_alone(spark, monkeypatch):
    """Of 400 near-equal titles, pairs are kept with what the batch's first part creates (before, all 160,000)."""
    monkeypatch.setattr(sequence, "FIRST", 100, raising=False)
    kept, plain = {}, sequence.written

    def seen(df, name):
        made = plain(df, name)
        kept[name] = kept.get(name, 0) + made.count()
        return made

    monkeypatch.setattr(sequence, "written", seen)
    records = spark.range(400).select(F.col("id").alias("url_id"), F.concat(F.lit("learning structured representations of graphs "), F.col("id")).alias("name"))
    none = lambda schema: spark.createDataFrame([], schema)
    titles, _ = sequence.Batch(records, none("url_id long, priority int, original_name string, parsed_name string, normal string"), none("id long, name string"), none("cluster_id long"), none("id long, block_name string"), none("alias string, id long")).resolve()
    assert {(r["match"], r["n"]) for r in titles.groupBy("match").agg(F.count("*").alias("n")).collect()} == {("NO_MATCH", 1), ("SINGLE_MATCH", 399)}
    assert kept["title_pairs"] + kept["stored_titles"] < 20000


def test_letter_pairs_bound_the_edits():
    """No more than two elements are gone for each edit, and of texts that share none, all."""
    texts = ["", "a", "ab", "abab", "ababab", "deep graph matching", "deep graf matchin", "x" * 70, "é😀 a\0b"]
    sets = [{i for i, bit in enumerate("".join(f"{int(x) & (1 << 64) - 1:064b}"[::-1] for x in row)) if bit == "1"} for row in letter_pairs(texts)]
    assert list(map(len, sets))[:5] == [0, 0, 1, 3, 5]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if 1 <= min(len(a), len(b)) <= 64:
                assert len(sets[i] - sets[j]) <= 2 * edit_distances([a], [b])[0]


def test_edit_distances():
    plain = {("kitten", "sitting"): 3, ("a", "a"): 0, ("a", "b"): 1, ("abc" * 21 + "x", "abc" * 30): 27, ("aé😀", "é😀ab"): 3, ("x" * 64, "y" * 80): 80}
    assert edit_distances([a for a, _ in plain], [b for _, b in plain]).tolist() == list(plain.values())


def test_values_of_a_tree_are_not_shuffled_for_their_sources(spark):
    """Rows are dealt by record once, before they are melted: no exchange has (pub, attr, value) or more keys."""
    rows = spark.range(40).select((F.col("id") % 4).alias("pub"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("url"), F.col("id").alias("seq"), (F.col("id") % 5).alias("title"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        merged = difftree.merge(rows, "pub", "url", "seq")
        plan = merged._jdf.queryExecution().executedPlan().toString()
        got = {(r["pub"], r["value"]): r["bitvector"] for r in difftree.nodes(merged).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert not [line for line in plan.splitlines() if "Exchange" in line and ("attr" in line or "value" in line)]
    want: dict = {}
    for pub in range(4):
        mine = [i for i in range(40) if i % 4 == pub]
        order = list(dict.fromkeys(i % 3 for i in mine))
        for i in mine:
            if i % 3:
                want[pub, str(i % 5)] = want.get((pub, str(i % 5)), 0) | 1 << order.index(i % 3)
    assert got == want


def test_texts_are_normalised_once_for_phrases(spark):
    """What links phrases reads a table of normalised texts; before, each of its joins normalised them anew."""
    left = spark.createDataFrame([("Deep-Graph",), ("graph deep",), ("nosuch graph",), ("the",), ("",), (None,)], "name string")
    right = spark.createDataFrame([(1, "A deep graph"), (2, "Deep, graph deep"), (3, "other words of the text"), (4, None)], "id long, body string")
    found = match.link_by_phrase(left, "name", "name", right, "id", "body")
    assert "body" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("Deep-Graph", 2), ("graph deep", 2), ("the", 3)}


def test_rows_of_titles_meet_a_written_search(spark):
    """The tasks that join rows with what was found for their titles hold nothing of the search (before, its window and its joins too)."""
    clusters = spark.createDataFrame([(1, "deep graph matching"), (2, "other words")], "id long, name string")
    titles = spark.createDataFrame([(1, "Deep graph matching"), (2, "deep graph matchings"), (3, "none of them"), (4, None)], "k long, title string")
    found = match.title_candidates(titles, "k", "title", clusters)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    assert {tuple(r) for r in found.collect()} == {(1, 1, 100, True), (2, 1, 95, False)}
