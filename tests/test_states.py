"""References and downloads as streams with state, against the batch rules."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from folioforge.plans import weave
from folioforge.streaming import states

PAST, AHEAD = dt.datetime(2024, 1, 1), dt.datetime(2124, 1, 1)


def folded(attempts):
    """One reference, attempt by attempt: (status, tries, cluster)."""
    status, tries, hit = "OP", 0, None
    for n, found in attempts:
        if status in ("OP", "INC"):
            if n == 0:
                tries += 1
                status = "INC" if tries < 5 else "LIM"
            elif n == 1:
                status, hit = "FIN", found
            else:
                status = "LIM"
    return status, tries, hit


def test_reference_stream_across_restarts(spark, tmp_path):
    """Random attempts in three runs of one checkpoint, with a hot key, null keys and ties."""
    rng, made = random.Random(5), {k: [(None, None, PAST)] for k in range(60)}
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    for run in range(3):
        rows = [(k, n, h, t) for k, a in made.items() for n, h, t in a] if run == 0 else []
        for k in made:
            for i in range(rng.choice([0, 1, 2])):
                n = rng.choice([0, 0, 0, 1, 2])
                made[k].append((n, None if n == 0 else 2**62 + 1 + k, PAST + dt.timedelta(days=10 * run + i)))
                rows.append((k, *made[k][-1]))
        if run == 1:
            hot = [(0, None, PAST + dt.timedelta(days=10, seconds=s)) for s in range(2000)]
            made[1000] = hot
            rows += [(1000, *h) for h in hot] + [(None, 1, 5, PAST), (None, None, None, PAST)]
        rng.shuffle(rows)
        spark.createDataFrame(rows, states.ATTEMPTS).repartition(2).write.mode("append").parquet(where[0])
        states.reference_stream(spark, *where).awaitTermination()
        got = {r["key"]: (r["status"], r["tries"], r["cluster_id"]) for r in states.references(spark, where[1]).collect()}
        want = {k: folded([(n, h) for n, h, t in sorted(a, key=lambda x: x[2]) if n is not None]) for k, a in made.items()}
        assert got == want
    assert got[1000] == ("LIM", 5, None)
    due = {r["key"] for r in states.references(spark, where[1]).where("due").collect()}
    assert due == {k for k, (s, *_) in want.items() if s in ("OP", "INC")}  # all waits are over


def test_reference_waits_for_its_date(spark, tmp_path):
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    spark.createDataFrame([(1, 0, None, PAST), (2, 0, None, AHEAD), (3, None, None, AHEAD), (4, 1, 2**62 + 1, PAST), (5, 1, None, None)], states.ATTEMPTS).write.parquet(where[0])
    states.reference_stream(spark, *where).awaitTermination()
    got = {r["key"]: (r["status"], r["due"]) for r in states.references(spark, where[1]).collect()}
    assert {r["key"]: r["cluster_id"] for r in states.references(spark, where[1]).where("key > 3").collect()} == {4: 2**62 + 1, 5: None}
    assert got == {1: ("INC", True), 2: ("INC", False), 3: ("OP", True), 4: ("FIN", False), 5: ("FIN", False)}


def test_download_stream_equals_rounds(spark, tmp_path):
    """Rounds of answers give the queue that after_download gives, round by round."""
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    rng, names = random.Random(7), [f"s{i}" for i in range(40)]
    table = spark.createDataFrame([(i, s, 0, None) for i, s in enumerate(names)], "id long, source string, tries long, last_try timestamp")
    left, ended = table, {}
    for run in range(3):
        at = PAST + dt.timedelta(days=run)
        answers = [(s, rng.choice([200, 204, 404, 403, 500, 503]), at) for s in rng.sample(names, 25)]
        rows = answers + [("unknown", 200, at), (None, 200, at)] + ([(s, None, PAST) for s in names] if run == 0 else [])
        spark.createDataFrame(rows, states.ANSWERS).repartition(2).write.mode("append").parquet(where[0])
        states.download_stream(spark, *where).awaitTermination()
        open_ = {r["source"] for r in left.collect()}
        ended |= {s: "successful" if c < 400 else "invalid" for s, c, _ in answers if s in open_ and (c < 400 or c == 404)}
        left, _ = weave.after_download(left, spark.createDataFrame(answers, states.ANSWERS), F.lit(at))
        left = spark.createDataFrame(left.collect(), left.schema)
        now = states.queue(spark, where[1])
        want = {r["source"]: (r["tries"], r["last_try"] or PAST) for r in left.collect()}
        assert {r["source"]: (r["tries"], r["at"]) for r in now.where("status = 'queued'").collect()} == want
        assert {r["source"]: r["status"] for r in now.where("status <> 'queued'").collect()} == ended
    assert now.where("status = 'queued' and not due").isEmpty() and "unknown" not in {r["source"] for r in now.collect()}


def test_many_answers_for_one_source(spark, tmp_path):
    """Thousands of refusals count, in whatever order; the first end decides."""
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    later = lambda s: PAST + dt.timedelta(seconds=s)
    rows = [("hot", 403, later(i)) for i in range(3000)] + [("hot", None, PAST), ("end", None, PAST), ("end", 404, later(5)), ("end", 200, later(9)), ("end", 403, later(7))]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, states.ANSWERS).repartition(3).write.parquet(where[0])
    states.download_stream(spark, *where).awaitTermination()
    got = {r["source"]: (r["status"], r["tries"], r["at"]) for r in states.queue(spark, where[1]).collect()}
    assert got == {"hot": ("queued", 3000, later(2999)), "end": ("invalid", 0, later(5))}


def test_timer_fires_without_new_rows(spark, tmp_path):
    """A running stream makes a reference due when its date comes."""
    import time

    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark.createDataFrame([(1, 0, None, now)], states.ATTEMPTS).write.parquet(where[0])
    q = states.reference_stream(spark, *where, retry_seconds=25, every="2 seconds")
    try:
        seen = []
        for _ in range(90):
            time.sleep(1)
            if q.lastProgress and not seen:
                seen = states.references(spark, where[1]).collect()
            if seen and states.references(spark, where[1]).first()["due"]:
                break
        assert seen[0]["status"] == "INC" and states.references(spark, where[1]).first()["due"] and q.exception() is None
    finally:
        q.stop()


def test_state_is_kept_by_buckets(spark, tmp_path, monkeypatch):
    """The state store holds rows and timers of buckets, however many keys they have; results are a key's own."""
    monkeypatch.setattr(states, "BUCKETS", 4)
    where = [str(tmp_path / n) for n in ("in", "log", "checkpoint")]
    rng, made = random.Random(3), {k: [] for k in range(500)}
    for run in range(2):
        rows = []
        for k in rng.sample(sorted(made), 400):
            at, n = PAST + dt.timedelta(days=40_000 if k % 7 == 0 else run), rng.choice([0, 0, 1, 2])
            made[k].append((n, k if n else None, at))
            rows.append((k, *made[k][-1]))
        spark.createDataFrame(rows, states.ATTEMPTS).write.mode("append").parquet(where[0])
        q = states.reference_stream(spark, *where)
        q.awaitTermination()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 4
    got = {r["key"]: r for r in states.references(spark, where[1]).collect()}
    want = {k: folded([(n, h) for n, h, _ in a]) for k, a in made.items() if a}
    assert {k: (r["status"], r["tries"], r["cluster_id"]) for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["due"]} == {k for k, w in want.items() if w[0] == "INC" and k % 7}


def test_rows_of_a_bucket_are_folded_a_few_times():
    """However many batches a bucket's rows come in: folded anew at each, 64 batches took 32 times the rows."""
    processor, folded_rows = states.References(60), []
    fold, n = processor.fold, 500
    processor.fold = lambda rows: folded_rows.append(len(rows)) or fold(rows)
    rng = random.Random(3)
    rows = pd.DataFrame([(rng.randrange(64 * n // 3), rng.choice([-1, 0, 1]), i % 7, True, rng.randrange(20)) for i in range(64 * n)], columns=["key", "n", "hit", "known", "at"])
    got = processor._folded(iter([rows[i * n : (i + 1) * n] for i in range(64)]))
    assert sum(folded_rows) < 5 * len(rows)
    want = rows.sort_values(["at", "n", "hit"], kind="stable")
    want = pd.concat([want[want["n"] != -1].groupby("key").head(5), want[want["n"] == -1].groupby("key").head(1)])
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
