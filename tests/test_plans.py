"""Ingestion, citations, schedules, streams and views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioforge.operators import difftree, entities, fts, match, stats, upsert
from folioforge.plans import ingest, serve, weave
from folioforge.schemas import CANONICAL
from folioforge.streaming import harvest


def record(url, title, authors, year=2000, kind="article", key=None, keywords=()):
    pub = (title, None, None, None, None, None, None, year, None, None, kind)
    rel = (key, *[None] * 11)
    return (url, pub, rel, [(a, a, *[None] * 5) for a in authors], list(keywords), [])


@pytest.fixture(scope="module")
def two_sources(spark):
    a = spark.createDataFrame([record("a/1", "Deep Graph Matching", ["Ann Smithson", "Bob Hallberg"], key="J One", keywords=["graphs"]), record("a/2", "Another Thing Entirely", ["Cyd Norbury"], 2001)], CANONICAL)
    b = spark.createDataFrame([record("b/1", "Deep graph matching!", ["Ann Smithson", "Dora Quistgaard"], 1999, "misc", "J. One", ["Graphs", "trees"])], CANONICAL)
    store, first = ingest.ingest(ingest.Store.empty(spark), a, "A")
    return first, *ingest.ingest(store, b, "B")


def test_ingest_two_sources(two_sources):
    first, store, second = two_sources
    assert {r["outcome"]: r["n"] for r in first.collect()} == {"added": 2}
    assert {r["outcome"]: r["n"] for r in second.collect()} == {"added": 1}
    assert store["clusters"].count() == 2 and store["publications"].count() == 2
    assert store["authors"].count() == 4 and store["author_edges"].count() == 5
    assert store["media"].count() == 1 and store["keywords"].count() == 2
    tree = {r["pub"]: r for r in ingest.trees(store).collect()}
    both = next(t for t in tree.values() if len(t["url_ids"]) == 2)
    assert [(n["value"], n["bitvector"]) for n in both["attrs"]["date_published"]] == [("2000", 1), ("1999", 2)]
    assert [(n["value"], n["bitvector"]) for n in both["attrs"]["type_ids"]] == [("1", 1), ("2", 2)]
    assert sorted(n["bitvector"] for n in both["attrs"]["author_ids"]) == [1, 2, 3]
    titles = {r["title"] for r in ingest.merged_publications(store).collect()}
    assert titles == {"Deep Graph Matching", "Another Thing Entirely"}


def test_ingest_again_and_quarantine(spark, two_sources):
    _, store, _ = two_sources
    again = spark.createDataFrame([record("a/1", "Deep Graph Matching", ["Ann Smithson"])], CANONICAL)
    grown, counts = ingest.ingest(store, again, "A")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"duplicate": 1}
    more = store.plus(clusters=spark.createDataFrame([(77, "deep graph matching")], "id long, name string"))
    grown, counts = ingest.ingest(more, spark.createDataFrame([record("c/1", "Deep Graph Matching", ["Eve Unknown"])], CANONICAL), "C")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"limbo": 1}
    assert [r["reason"] for r in grown["limbo"].collect()] == ["AMB_CLUSTER"]
    assert [(r["name"], r["reason"]) for r in grown["limbo_authors"].collect()] == [("Eve Unknown", "None")]
    assert grown["source_records"].count() == store["source_records"].count()


@pytest.mark.parametrize("known", [[], [record("k/1", "Unrelated Known Work", ["Zoe Zimmer"], key="Other Journal", keywords=["other"])]])
def test_one_entity_for_each_new_block(spark, known):
    """Whether the store knows other media does not change what a batch's media become."""
    store = ingest.Store.empty(spark)
    if known:
        store, _ = ingest.ingest(store, spark.createDataFrame(known, CANONICAL), "K")
    batch = [record("a/1", "First Long Title", ["Ann Smithson"], key="Data-Base Review", keywords=["Query-Plan"]), record("a/2", "Second Other Words", ["Bob Hallberg"], key="Data Base Review", keywords=["query plan"])]
    store, counts = ingest.ingest(store, spark.createDataFrame(batch, CANONICAL), "A")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"added": 2}
    assert [r["block_name"] for r in store["media"].where("block_name like 'data%'").collect()] == ["data base review"]
    assert sorted(r["alias"] for r in store["media_aliases"].where("alias like 'Data%'").collect()) == ["Data Base Review", "Data-Base Review"]
    assert store["keywords"].where("block_name = 'query plan'").count() == 1
    assert store["keyword_edges"].join(store["source_records"].where("local_url like 'a/%'"), "url_id").select("keyword_id").distinct().count() == 1


def test_names_of_a_shared_block_get_their_own_entity(spark):
    store = ingest.Store.empty(spark).plus(media=spark.createDataFrame([(1, "X Y", "x y"), (2, "X-Y", "x y")], "id long, main_name string, block_name string"), media_aliases=spark.createDataFrame([(1, "X Y"), (2, "X-Y")], "id long, alias string"))
    batch = [record("a/1", "First Long Title", ["Ann Smithson"], key="X-Y"), record("a/2", "Second Other Words", ["Bob Hallberg"], key="x y!"), record("a/3", "Third Of Them All", ["Cyd Norbury"], key="x y!")]
    store, _ = ingest.ingest(store, spark.createDataFrame(batch, CANONICAL), "A")
    assert store["media"].count() == 3 and store["media_aliases"].count() == 3


def test_one_batch_or_two(spark):
    """Records of different titles and people: one batch gives the store that two give."""
    rows = [record(f"a/{i}", t, [f"{t.split()[0]} Person"], 2000 + i, key=f"Journal of {t}", keywords=[t]) for i, t in enumerate(["Graph Colouring", "Relational Storage Layouts", "Speech", "Quantum Error Correction Codes"])]
    one, _ = ingest.ingest(ingest.Store.empty(spark), spark.createDataFrame(rows, CANONICAL), "A")
    two, _ = ingest.ingest(ingest.Store.empty(spark), spark.createDataFrame(rows[:2], CANONICAL), "A")
    two, _ = ingest.ingest(two, spark.createDataFrame(rows[2:], CANONICAL), "A")
    for name in ingest.STORE_SCHEMAS:
        plain = lambda s: sorted(map(str, s[name].drop("seq").collect()))  # noqa: B023, E731
        assert plain(one) == plain(two), name


def test_of_repeated_urls_the_first_record_counts(spark):
    rows = [record("a/1", t, ["Ann Smithson"], y) for t, y in (("Some Long Title", 2001), ("Some Long Title", 1999), ("Other Long Title", 2005))]
    for order in (rows, rows[::-1]):
        store, counts = ingest.ingest(ingest.Store.empty(spark), spark.createDataFrame(order, CANONICAL).repartition(3), "A")
        assert {r["outcome"]: r["n"] for r in counts.collect()} == {"added": 1}
        assert [r["name"] for r in store["clusters"].collect()] == ["other long title"]


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    store = ingest.Store.load(spark, path)
    assert store["clusters"].count() == 0
    store, _ = ingest.ingest(store, spark.createDataFrame([record("a/1", "First Long Title", ["Ann Smithson"], key="J")], CANONICAL), "A")
    store = store.save(path)
    files = {f.name for f in (tmp_path / "store" / "clusters").rglob("*.parquet")}
    store, _ = ingest.ingest(store, spark.createDataFrame([record("a/2", "Second Other Words", ["Bob Hallberg"], 2003)], CANONICAL), "A")
    (tmp_path / "store" / "clusters" / "batch=1").mkdir()  # what a save that broke off has left does not count
    spark.createDataFrame([(5, "lost")], "id long, name string").write.mode("overwrite").parquet(f"{path}/clusters/batch=1")
    assert ingest.Store.load(spark, path)["clusters"].count() == 1
    store = store.save(path)
    assert files <= {f.name for f in (tmp_path / "store" / "clusters").rglob("*.parquet")}  # only new rows were written
    again = ingest.Store.load(spark, path)
    assert sorted(r["name"] for r in again["clusters"].collect()) == ["first long title", "second other words"]
    assert sorted(r["seq"] for r in again["values"].select("seq").distinct().collect()) == [0, 1]
    assert again.save(path)["source_records"].count() == 2
    with pytest.raises(ValueError):
        ingest.Store.empty(spark).save(path)


def test_merged_records_only(spark):
    store, _ = ingest.ingest(ingest.Store.empty(spark), spark.createDataFrame([record("a/1", "First Long Title", ["Ann Smithson"])], CANONICAL), "A")
    more = store.plus(source_records=spark.createDataFrame([(9, "A", "a/9", 1, 99)], "url_id long, source string, local_url string, type_id long, cluster_id long"), author_edges=spark.createDataFrame([(9, 1, 0)], "url_id long, author_id long, priority int"))
    assert [r["local_url"] for r in ingest.merged_only(more).collect()] == ["a/1"]
    assert ingest.merged_only(more, "author_edges").count() == 1


def test_match_author_outcomes(spark):
    authors = spark.createDataFrame([(1, "anna smithson"), (2, "anna m smithson"), (3, "bob hallberg")], "id long, block_name string")
    aliases = spark.createDataFrame([("A. S.", 1), ("A. S.", 2), ("Bob", 3)], "alias string, id long")
    rows = spark.createDataFrame([(1, "A. S.", "a s"), (2, "Bob", "bob"), (3, "x", "bob hallberg"), (4, "y", "anna smithson"), (5, "z", "nobody here")], "k int, name string, normal string")
    got = {r["k"]: (r["status"], r["match"], r["id"], r["reason"]) for r in match.match_authors(rows, "k", "name", "normal", authors, aliases).collect()}
    assert got == {
        1: ("LIMBO", "MULTI_MATCH", None, "AMB_ALIAS"), 2: ("SAFE", "SINGLE_MATCH", 3, None), 3: ("SAFE", "SINGLE_MATCH", 3, None), 4: ("LIMBO", "MULTI_MATCH", None, "AMB_NAME_BLOCK"), 5: ("SAFE", "NO_MATCH", None, None),
    }


def test_ladders(spark):
    entities_ = spark.createDataFrame([(1, "one"), (2, "two"), (3, "two")], "id long, block_name string")
    aliases = spark.createDataFrame([("Two", 3), ("Odd", 1)], "alias string, id long")
    rows = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "two"), (4, "new"), (5, None), (6, "Odd")], "k int, name string")
    get = lambda first: {r["k"]: (r["id"], r["how"]) for r in match.block_ladder(rows, "k", "name", entities_, aliases, first).collect()}
    assert get(False) == {1: (1, "block"), 2: (3, "alias"), 3: (None, "create"), 4: (None, "create"), 6: (None, "create")}
    assert get(True) == {1: (1, "block"), 2: (3, "alias"), 3: (None, "create"), 4: (None, "create"), 6: (1, "alias")}


def test_search_modes(spark):
    df = spark.createDataFrame([(1, "the big cat"), (2, "a small cat"), (3, "big dogs")], "id int, t string")
    ids = lambda q: sorted(r["id"] for r in fts.search(df, ["t"], q).collect())
    assert ids("cat dogs") == [1, 2, 3] and ids("+big +cat") == [1] and ids('"small cat"') == [2] and ids("+cat -big") == [2]
    assert fts.mode_of("a b") == "natural" and fts.mode_of("+a") == "boolean"
    assert serve.SearchManager(df, ["t"]).count("cat") == 2


def test_search_syntax(spark):
    rows = [(1, "here is the MIT license"), (2, "here is an Apache License"), (3, "Herr Müller: state-of-the-art"), (4, "art of the state; license-free"), (5, "licensing of Ärzte"), (6, None), (7, "Война и мир"), (8, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    ids = lambda q, mode=None: sorted(r["id"] for r in fts.search(df, ["t"], q, mode).collect())
    assert ids('+here -"mit license"') == [2] and ids('+here +"mit license"') == [1]
    assert ids("Müller") == ids("muller") == [3] and ids("voina") == [7] and ids("+Война -мир") == []
    assert ids("+state-of-the-art") == [3] and ids("state-of-the-art", "natural") == [1, 3, 4, 5]
    assert ids("licens*") == [1, 2, 4, 5] and ids("+licens* -license") == [5] and ids("+license-f*") == [4]
    assert ids("+(mit apache) +here") == [1, 2] and ids("+here -(mit (apache license))") == [] and ids("+here +(+mit -apache)") == [1]
    assert ids("-license") == [] and ids("+") == [] and ids('""') == [] and ids("(") == [] and ids(">mit <apache ~arzte") == [1, 2, 5]
    found = fts.search_many(df, ["t"], ["+here", "licens*", "nothing at all*"]).collect()
    assert sorted((r["query"], r["id"]) for r in found) == [("+here", 1), ("+here", 2), ("licens*", 1), ("licens*", 2), ("licens*", 4), ("licens*", 5)] and found[0].asDict().keys() == {"query", "id", "t"}


def test_best_matches_equal_the_plain_sums(spark):
    """With and without the lookup of common tokens, ties and short queries included."""
    import math
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, ["the", "of", *(["and"] if i % 3 else []), *rng.choices(words, k=6)]) for i in range(700)]
    asked = [(i, [*rng.choices(words, k=rng.randint(0, 5)), *rng.sample(["the", "of", "and", "zz"], rng.randint(0, 3))]) for i in range(60)]
    index = spark.createDataFrame([(w, i) for i, d in docs for w in set(d)], "token string, id long")
    df = {w: sum(w in d for _, d in docs) for w in {w for _, d in docs for w in d}}
    got = {}
    for r in fts.best_matches(spark.createDataFrame(asked, "q long, words array<string>"), "q", "words", index, "id", 700).collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"], r["score"]))
    for q, own in asked:
        sums = {i: round(sum(math.log(1 + 700 / df[w]) for w in set(own) & set(d)), 6) for i, d in docs if set(own) & set(d)}
        want = sorted(sums, key=lambda i: (-sums[i], i))[:5]
        assert [(n + 1, i, pytest.approx(sums[i], abs=2e-6)) for n, i in enumerate(want)] == sorted(got.get(q, [])), q


def test_open_references_in_batches(spark):
    day = dt.date(2020, 1, 2)
    rows = [(s, i, status, at) for s, at in ((1, None), (2, day), (3, dt.date(2020, 1, 1)), (4, None)) for i, status in enumerate(["OP", "INC", "FIN"])] + [(0, 0, "LIM", None)]
    refs = spark.createDataFrame(rows, "source long, n int, status string, last_updated date")
    got = weave.next_sources(refs, "source", "last_updated", F.lit(day), 2).collect()
    assert sorted((r["source"], r["n"]) for r in got) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    with pytest.raises(ValueError):
        weave.next_sources(refs, "source", "last_updated", F.lit(day), 0)


def test_type_of_a_record(spark):
    types = spark.createDataFrame([(1, "article"), (2, "misc")], "id long, name string")
    rows = spark.createDataFrame([(1, "article"), (2, "other"), (3, None)], "k int, kind string")
    assert sorted(tuple(r) for r in match.match_type(rows, "k", "kind", types).collect()) == [(1, 1), (2, 2), (3, 2)]


def test_equal_titles(spark):
    a = spark.createDataFrame([(1, "A-B  c"), (2, None), (3, "x")], "a int, t string")
    b = spark.createDataFrame([(1, "a b C!"), (2, None), (3, "y"), (4, "a b c")], "b int, t string")
    assert sorted(tuple(r) for r in match.equal_titles(a, b, "t").collect()) == [(1, 1), (1, 4)]


def test_difftree_votes(spark):
    nodes = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(n).alias("votes"), F.lit(1).cast("long").alias("bitvector")) for v, n in (("a", 1), ("b", 0), ("c", 0))])
    run = lambda v, n: [x["value"] for x in spark.range(1).select(difftree.upvote(nodes, F.lit(v), F.lit(n)).alias("r")).first()["r"]]
    assert run("c", 2) == ["c", "b", "a"] and run("b", 1) == ["a", "b", "c"] and run("zz", 9) == ["a", "b", "c"]


def test_difftree_default_ids_and_bench(spark):
    rows = spark.createDataFrame([(1, 10, 1, "7", "t"), (2, 10, 2, None, "u")], "pub long, url long, seq long, type_ids string, title string")
    trees = difftree.merge(rows, "pub", "url", "seq")
    assert {r["pub"]: r["d"] for r in trees.select("pub", difftree.default_id("type_ids", F.lit(2).cast("long")).alias("d")).collect()} == {1: 7, 2: 2}
    times = difftree.bench(rows, "pub", "url", "seq")
    assert list(times) == ["merge", "insert", "sources"] and min(times.values()) > 0


def test_registered_sources(spark):
    from folioforge.schemas import RAW_OAI

    raw = spark.createDataFrame([("oai:1", "Ann Smithson;", "First Long Title", "1999;")], "identifier string, author string, title string, dates string")
    raw = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_OAI.fields])
    store, counts = ingest.ingest_source(ingest.Store.empty(spark), raw, "core")
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"added": 1} and store["source_records"].first()["source"] == "core"
    with pytest.raises(ValueError):
        ingest.ingest_source(store, raw, "nobody")


def test_runs_do_not_overlap(spark, tmp_path):
    path = f"file://{tmp_path}"
    with harvest.Running(spark, path, "dump") as first, harvest.Running(spark, path, "dump") as second, harvest.Running(spark, path, "other") as third:
        assert (first, second, third) == (True, False, True)
    with harvest.Running(spark, path, "dump") as again:
        assert again
        with harvest.Running(spark, path, "dump", stale=-1) as taken:
            assert taken


def test_id_lists(spark, tmp_path):
    from folioforge.sources.delimited import write_id_lists

    write_id_lists(spark.createDataFrame([("a", [1, 2]), ("b", [])], "k string, ids array<long>").coalesce(1), "k", "ids", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["a,1 2", 'b,""']


def test_difftree_round_trip(spark):
    rows = spark.createDataFrame([(1, 10, 1, "t", ["x", "y"]), (1, 11, 2, "u", ["y"]), (1, 12, 3, "t", None)], "pub long, url long, seq long, title string, author_ids array<string>")
    back = difftree.per_source(difftree.merge(rows, "pub", "url", "seq")).collect()
    assert {(r["url_id"], r["attr"]): r["values"] for r in back} == {(10, "title"): ["t"], (11, "title"): ["u"], (12, "title"): ["t"], (10, "author_ids"): ["x", "y"], (11, "author_ids"): ["y"]}
    votes = difftree.value_votes(difftree.merge(rows, "pub", "url", "seq")).collect()
    assert [(r["attr"], r["votes"]) for r in votes] == [("title", {"t": 0, "u": 0})]


def test_references(spark):
    clusters = spark.createDataFrame([(1, "deep graph matching"), (2, "shallow trees")], "id long, name string")
    refs = spark.createDataFrame([(1, "Deep graph matchin", 0, "OP"), (2, "Unrelated stuff", 1, "INC"), (3, "Unrelated stuff", 4, "INC"), (4, "Deep graph matching", 0, "FIN")], "id int, title string, tries int, status string")
    got = {r["id"]: (r["status"], r["tries"], r["cluster_id"]) for r in weave.resolve_references(refs, "id", "title", clusters).collect()}
    assert got == {1: ("FIN", 0, 1), 2: ("INC", 2, None), 3: ("LIM", 5, None), 4: ("FIN", 0, None)}


def test_download_queue(spark):
    queue = weave.queue_for(spark.createDataFrame([("1.1",), ("1.2",), ("1.3",), ("1.4",)], "identifier string"))
    assert queue.orderBy("source").first()["url"] == "https://arxiv.org/pdf/1.1.pdf" and weave.with_file(queue).orderBy("source").first()["file"] == "1.1.pdf"
    left, counts = weave.after_download(queue, spark.createDataFrame([("1.1", 200), ("1.2", 404), ("1.3", 403)], "source string, http_status int"), F.current_timestamp())
    assert {r["source"]: r["tries"] for r in left.collect()} == {"1.3": 1, "1.4": 0}
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"successful": 1, "invalid": 1, "skipped": 1}
    with pytest.raises(ValueError):
        weave.next_in_queue(left, F.current_timestamp(), 0)


def test_schedule():
    s = harvest.Schedule("monthly", dt.date(2011, 1, 1), dt.date(2011, 3, 15)).first()
    assert (s.start, s.end) == (dt.date(2011, 1, 1), dt.date(2011, 1, 31))
    s = s.after_success()
    assert (s.start, s.end) == (dt.date(2011, 2, 1), dt.date(2011, 3, 3))
    assert s.after_success().end == dt.date(2011, 3, 15)
    assert not s.due(dt.date(2011, 2, 15)) and s.due(dt.date(2011, 3, 3))
    assert not harvest.Schedule("all").first().after_success().enabled
    for bad in (dict(cadence="weekly"), dict(cadence="all", min_date=dt.date(2012, 1, 1), max_date=dt.date(2011, 1, 1)), dict(cadence="all", limit=0)):
        with pytest.raises(ValueError):
            harvest.Schedule(**bad)


def test_upsert_stream(spark, tmp_path):
    src, out, schema = tmp_path / "in", str(tmp_path / "out"), spark.createDataFrame([], "k long, v string, n long, seen string").schema

    def put(rows, target=out):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        harvest.upsert_stream(spark, str(src), schema, target, ["k"], [F.col("n")], str(tmp_path / "cp")).awaitTermination()

    table = lambda target=out: {r["k"]: (r["v"], r["seen"]) for r in harvest.current(spark, schema, target, ["k"], ["seen"]).collect()}
    put([(1, "a", 1, "x"), (1, "b", 2, "x"), (2, "c", 1, "x")])
    put([(1, "d", 3, "new"), (3, "e", 1, "new")])
    assert table() == {1: ("d", "x"), 2: ("c", "x"), 3: ("e", "new")}
    assert spark.read.parquet(f"{out}/version_no=1").count() == 2  # only what changed is written
    to = str(tmp_path / "small")
    assert harvest.compact(spark, schema, out, ["k"], to, ["seen"]) == 1
    put([(2, "f", 9, "newer")], to)
    assert table(to) == {1: ("d", "x"), 2: ("f", "x"), 3: ("e", "new")}


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    seen = []
    events.write.parquet(str(tmp_path / "in"))
    q = harvest.ingest_stream(spark, str(tmp_path / "in"), events.schema, lambda b, n: seen.append(harvest.windowed_counts(b).agg(F.sum("n")).first()[0]), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sum(seen) == events.count() == harvest.windowed_counts(events).agg(F.sum("n")).first()[0]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "h"), (2, "b", None)], "k int, v string, mark string")
    new = spark.createDataFrame([(2, "c", "z"), (3, "d", "z")], "k int, v string, mark string")
    got = {r["k"]: (r["v"], r["mark"]) for r in upsert.upsert(old, new, ["k"], keep=["mark"]).collect()}
    assert got == {1: ("a", "h"), 2: ("c", None), 3: ("d", "z")}
    assert {r["k"] for r in upsert.insert_absent(old, new, ["k"]).collect()} == {3}


def test_continuation_identity(spark):
    lengths = spark.createDataFrame([(0, 5), (1, 3), (4, 2)], "k long, authors long")
    assert {r["k"]: r["authors"] for r in stats.career_continuation(lengths).collect()} == {0: 10, 1: 2, 4: 0}


def test_clusters_of_log(spark):
    log = spark.createDataFrame([("SOURCE", "0A", "Big-Title"), ("REF", "0A", "Big title")], "kind string, id string, title string")
    assert [tuple(r) for r in entities.clusters_of_log(log).collect()] == [(10, "big title")]


def test_download_round_counts_only_answers(spark):
    queue = spark.createDataFrame([(i, f"s{i}", 0, None) for i in range(1, 8)], "id long, source string, tries int, last_try timestamp")
    results = spark.createDataFrame([(1, "s1", 403), (2, "s2", 404), (3, "s3", 204), (4, "s4", 500), (5, "s5", 200), (6, "s6", 200), (7, "s7", 404)], "id long, source string, http_status int")
    assert sorted(r["id"] for r in weave.attempted(results, 2).collect()) == [1, 2, 3, 4, 5]
    assert weave.attempted(results, 4).count() == 7
    with pytest.raises(ValueError):
        weave.attempted(results, 0)
    kept, counts = weave.after_download(queue, weave.attempted(results, 2), F.current_timestamp())
    assert sorted((r["id"], r["tries"]) for r in kept.collect()) == [(1, 1), (4, 1), (6, 0), (7, 0)]
    assert {r["outcome"]: r["n"] for r in counts.collect()} == {"successful": 2, "invalid": 1, "skipped": 2}


def test_similar_names_equals_brute_force(spark):
    given = ["Anna Smithson", "A. Smithson", "anna smithson", "Anna M. Smithson", "Bob Hallberg", "Hallberg", "Anna Hallberg", None, " ", "Smithson Anna"]
    rows = spark.createDataFrame(list(enumerate(given)), "key long, name string")
    pairs, members = match.similar_names(rows, "key", "name")
    normal = {r["key"]: r["n"] for r in rows.select("key", match.normalize_author("name").alias("n")).collect() if r["n"] and r["n"].strip()}
    first = {}
    for k, n in sorted(normal.items()):
        first.setdefault(n, k)
    assert {r["key"]: r["id"] for r in members.collect()} == {k: first[n] for k, n in normal.items()}
    both = spark.createDataFrame([(i, j, a, b) for a, i in first.items() for b, j in first.items() if i != j and set(a.split()) & set(b.split())], "i long, j long, a string, b string")
    want = {(r["i"], r["j"]) for r in both.where(match.same_author("a", "b")).collect()}
    assert want and {tuple(r) for r in pairs.collect()} == want


def test_link_reports(spark, tmp_path):
    from folioforge.sources.delimited import write_reports

    truth = spark.createDataFrame([(1, 2), (1, 3)], "s long, r long")
    found = spark.createDataFrame([(1, 2), (2, 3), (2, 3)], "s long, r long")
    out = stats.link_outcomes(truth, found, ["s", "r"])
    assert sorted(map(tuple, out.collect())) == [(1, 2, "correct"), (1, 3, "missing"), (2, 3, "false")]
    titles = spark.createDataFrame([(1, "one "), (2, "two")], "id long, title string")
    write_reports(stats.link_report(out, "s", "r", titles), str(tmp_path / "report"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report" / "outcome=correct")).collect()] == ["(1,one)-->(2,two)"]


def test_name_table_skips_empty_names(spark):
    rows = spark.createDataFrame([(1, "Ann Smith"), (2, ""), (3, None)], "k int, name string")
    got = entities.name_table(rows, "k", "name").collect()
    assert [(r["k"], r["main_name"], r["normal_name"]) for r in got] == [(1, "Ann Smith", "ann smith")]
