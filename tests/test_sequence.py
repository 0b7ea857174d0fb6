"""Batches against record after record."""

import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions.names import same_author
from folioforge.functions.text import author_tokens, normalize_author, normalize_title
from folioforge.operators import sequence
from folioforge.plans import ingest
from folioforge.schemas import CANONICAL
from tests.test_plans import record


def one_by_one(records, who, clusters, pubs, authors, aliases, like, same, hash_of):
    """Outcomes by a plain loop over the records, given which titles and names are alike."""
    clusters, authors = dict(clusters), dict(authors)
    aliases = {a: {i for b, i in aliases if b == a} for a, _ in aliases}
    titles, people = {}, {}
    for url, name in sorted(records):
        found = [c for c, n in clusters.items() if (name, n) in like]
        found = [c for c in found if clusters[c] == name] or found
        bad = len(found) > 1 or len(found) == 1 and pubs.get(found[0], 0) != 1
        titles[url] = ("LIMBO", "MULTI_MATCH", None, "AMB_PUB" if len(found) == 1 else "AMB_CLUSTER") if bad else ("SAFE", ["NO_MATCH", "SINGLE_MATCH"][len(found)], found[0] if found else None, None)
        mine = [w for w in who if w[0] == url]
        for _, p, original, normal in mine:
            by_alias = aliases.get(original, set())
            hits = by_alias or {a for a, b in authors.items() if (normal, b) in same}
            kind = ("NO_MATCH", "SINGLE_MATCH", "MULTI_MATCH")[min(len(hits), 2)]
            reason = None if len(hits) < 2 else "AMB_ALIAS" if by_alias else "AMB_NAME_BLOCK"
            people[url, p] = ("LIMBO" if len(hits) > 1 else "SAFE", kind, min(hits) if len(hits) == 1 else None, reason)
        if bad or any(people[url, w[1]][0] == "LIMBO" for w in mine):
            continue
        if not found:
            clusters[hash_of[name]] = name
            pubs[hash_of[name]] = 1
        for _, p, original, normal in mine:
            author = people[url, p][2] or hash_of[normal]
            if people[url, p][1] == "NO_MATCH":
                authors[author] = normal
            aliases.setdefault(original, set()).add(author)
    return titles, people


@pytest.mark.parametrize("seed", [1])
def test_equals_record_after_record(spark, seed):
    """Near-equal titles in chains, equal ones many times, names with initials, a store with ambiguous entries."""
    rng = random.Random(seed)
    base = ["deep graph matching networks", "deep graph matching network", "deep graph matchin networks", "deep graph watching networkx", "relational storage layouts", "relational storage layout", "relational storage layoutsss", "relationale storage layoutsss", "a b c", "quantum codes", "query plans", "query planss"]
    firsts, lasts = ["Ann", "A.", "Anna", "Bob", "B.", "Robert"], ["Smithson", "Hallberg", "Wu"]
    rows = []
    for i in range(60):
        rows.append((rng.randrange(-(2**60), 2**60), rng.choice(base), [f"{rng.choice(firsts)} {rng.choice(lasts)}" for _ in range(rng.choice([0, 0, 1, 2]))]))
    records = spark.createDataFrame([(u, t) for u, t, _ in rows], "url_id long, title string").select("url_id", normalize_title("title").alias("name"))
    who = spark.createDataFrame([(u, p, n) for u, _, names in rows for p, n in enumerate(names)], "url_id long, priority int, original_name string")
    who = who.withColumn("parsed_name", F.col("original_name")).withColumn("normal", normalize_author("original_name"))
    clusters = [(1, "quantum codes"), (2, "query plans"), (3, "query planes"), (4, "relational storage layoot")]
    authors, aliases = [(5, "robert hallberg"), (6, "rob hallberg")], [("B. Hallberg", 5), ("Bob Wu", 5), ("Bob Wu", 6)]
    pubs = [(1, 1), (4, 1), (2, 2)]
    frame = lambda r, s: spark.createDataFrame(r, s)
    stored = (frame(clusters, "id long, name string"), frame([(c,) for c, n in pubs for _ in range(n)], "cluster_id long"), frame(authors, "id long, block_name string"), frame(aliases, "alias string, id long"))
    titles, people = sequence.Batch(records, who, *stored).resolve()

    names = [r[0] for r in records.select("name").distinct().collect()]
    normals = [r[0] for r in who.select("normal").distinct().collect()]
    every = frame([(n,) for n in {*names, *[c[1] for c in clusters]}], "other string")
    like = {(r["name"], r["other"]) for r in sequence.similar_titles(frame([(n,) for n in names], "name string"), every.withColumn("k", F.col("other")), "k").collect()}
    blocks = frame([(n,) for n in {*normals, *[a[1] for a in authors]}], "block_name string").withColumn("has", F.split("block_name", " "))
    asked = frame([(n,) for n in normals], "normal string").withColumn("need", author_tokens("normal")).where(F.size("need") > 0)
    pairs = asked.crossJoin(blocks).where(F.forall("need", lambda t: F.array_contains("has", t)) & same_author("normal", "block_name"))
    same = {(r["normal"], r["block_name"]) for r in pairs.collect()}
    hash_of = {r["n"]: r["h"] for r in frame([(n,) for n in {*names, *normals}], "n string").select("n", F.xxhash64("n").alias("h")).collect()}
    plain = one_by_one([(r["url_id"], r["name"]) for r in records.collect()], [(r["url_id"], r["priority"], r["original_name"], r["normal"]) for r in who.collect()], clusters, dict(pubs), authors, aliases, like, same, hash_of)
    assert {r["url_id"]: tuple(r)[1:] for r in titles.collect()} == plain[0]
    assert {(r["url_id"], r["priority"]): tuple(r)[2:] for r in people.collect()} == plain[1]
    kinds = {x[1] + str(x[3]) for x in [*plain[0].values(), *plain[1].values()]}
    assert {"NO_MATCHNone", "SINGLE_MATCHNone", "MULTI_MATCHAMB_CLUSTER", "MULTI_MATCHAMB_PUB"} <= kinds


def test_parts_of_a_batch_give_what_the_batch_gives(spark, monkeypatch):
    """Parts of 20 and 40 records, with words dealt out to shares, against the whole batch at once."""
    rng = random.Random(5)
    base = ["deep graph matching networks", "deep graph matching network", "deep graph matchin networks", "deep graph watching networkx", "relational storage layouts", "relational storage layoutsss", "a b c", "quantum codes", "query planss", "", None]
    names = ["Ann Smithson", "A. Smithson", "Anna Smithson", "Bob Hallberg", "B. Hallberg", "Robert Wu", "R. Wu"]
    rows = [(rng.randrange(-(2**60), 2**60), rng.choice(base), [rng.choice(names) for _ in range(rng.choice([0, 1, 2]))]) for _ in range(60)]
    frame = lambda r, s: spark.createDataFrame(r, s)
    records = frame([(u, t) for u, t, _ in rows], "url_id long, name string")
    who = frame([(u, p, n) for u, _, each in rows for p, n in enumerate(each)], "url_id long, priority int, original_name string")
    who = who.withColumn("parsed_name", F.col("original_name")).withColumn("normal", normalize_author("original_name"))
    stored = (frame([(1, "quantum codes"), (2, "query plans")], "id long, name string"), frame([(1,), (2,), (2,)], "cluster_id long"), frame([(5, "robert wu")], "id long, block_name string"), frame([("Bob Hallberg", 6)], "alias string, id long"))
    got = []
    for first, share in ((10**6, 1000), (20, 2)):
        monkeypatch.setattr(sequence, "FIRST", first)
        monkeypatch.setattr(sequence, "GROWTH", 3)
        monkeypatch.setattr(sequence, "SHARE", share)
        got.append([sorted(map(str, df.collect())) for df in sequence.Batch(records, who, *stored).resolve()])
    assert got[0] == got[1]
    assert len(got[0][0]) == 60 and len(got[0][1]) == who.count()


def test_similar_titles_are_all_found(spark):
    """The classes of length lose no pair."""
    rng = random.Random(3)
    names = sorted({" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x", "of"]) for _ in range(rng.randint(1, 7))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    held = df.select(F.col("name").alias("other"), F.col("name").alias("k"))
    got = {(r["name"], r["other"]) for r in sequence.similar_titles(df, held, "k").collect()}
    found = df.crossJoin(held.select("other")).where(sequence.title_similarity("name", "other") >= 80)
    words = {r["name"]: set(r["w"]) for r in df.select("name", F.when(F.forall(sequence.relevant_words("name"), lambda w: F.length(w) < 4), F.split("name", " ")).otherwise(sequence.relevant_words("name")).alias("w")).collect()}
    assert got == {(r["name"], r["other"]) for r in found.collect() if words[r["name"]] & set(r["other"].split(" "))}


def test_one_batch_or_one_record_at_a_time(spark):
    """Near-equal titles and spellings of names: one batch gives the store that batches of one record give."""
    rows = [record("r/1", "Deep Graph Matching Networks", ["Ann Smithson"], key="J One"), record("r/2", "Deep Graph Matching Network", ["A. Smithson"], 2001, key="J. One"), record("r/3", "Deep Graph Matchin Networks", ["Ann Smithson", "Bob Hallberg"], 2002), record("r/4", "Other Words Here", ["B. Hallberg"], 2003)]
    batch = spark.createDataFrame(rows, CANONICAL)
    order = [r[0] for r in batch.select("local_url", F.xxhash64(F.lit("A"), "local_url").alias("h")).orderBy("h").collect()]
    one, _ = ingest.ingest(ingest.Store.empty(spark), batch, "A")
    each = ingest.Store.empty(spark)
    for url in order:
        each, _ = ingest.ingest(each, spark.createDataFrame([r for r in rows if r[0] == url], CANONICAL), "A")
    for name in ingest.STORE_SCHEMAS:
        plain = lambda s: sorted(map(str, s[name].drop("seq").collect()))  # noqa: B023, E731
        assert plain(one) == plain(each), name
    assert one["clusters"].count() == 2 and one["authors"].count() == 2
