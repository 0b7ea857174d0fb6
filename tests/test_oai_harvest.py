"""The feed as a data source, in batches and as a stream, across failures."""

import pytest

from folioforge.sources import oai, oai_harvest


def options(tmp_path, until="2010-01-04"):
    return {"url": str(tmp_path), "pages": str(tmp_path / "pages"), "from": "2010-01-01", "until": until, "fetch": "tests.feed:fetch"}


def asked(tmp_path):
    return sorted((tmp_path / "log").read_text().splitlines())


WANT = [(d, n) for d in ("2010-01-01", "2010-01-02", "2010-01-04") for n in range(3)]
ASKED = sorted([*[f"{d} {n}" for d, n in WANT], "2010-01-03 0"])


def test_a_broken_harvest_goes_on_at_its_token(spark, tmp_path):
    oai_harvest.register(spark)
    df = spark.read.format("oai").options(**options(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 4
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="the feed is down"):
        df.collect()
    (tmp_path / "broken").unlink()
    assert sorted((r["start"], r["page"]) for r in df.collect()) == WANT
    assert asked(tmp_path) == ASKED  # no page twice
    rows = oai.read_core(spark, str(tmp_path / "pages" / "*" / "*.xml")).collect()
    assert sorted(r["identifier"] for r in rows) == [f"oai:{d}:{n}" for d, n in WANT] and rows[0]["title"].startswith("Ä")


def test_stream_over_a_failure_and_new_days(spark, tmp_path):
    oai_harvest.register(spark)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def run(until):
        q = spark.readStream.format("oai").options(**options(tmp_path, until)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()

    run("2010-01-01")
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="the feed is down"):
        run("2010-01-03")
    (tmp_path / "broken").unlink()
    run("2010-01-03")
    run("2010-01-04")
    assert sorted((r["start"], r["page"]) for r in spark.read.parquet(out).collect()) == WANT and asked(tmp_path) == ASKED


def test_windows_and_options():
    assert [(w.start, w.until) for w in oai_harvest.windows("2010-01-01", "2010-01-06", 2)] == [("2010-01-01", "2010-01-02"), ("2010-01-03", "2010-01-04"), ("2010-01-05", "2010-01-05")]
    assert oai_harvest.windows("2010-01-06", "2010-01-06", 2) == []
    with pytest.raises(ValueError, match="needs the option"):
        oai_harvest.Harvest({"url": "x"})
