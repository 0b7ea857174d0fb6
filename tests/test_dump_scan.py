"""The one-pass dump reader against Spark's reader of one tag at a time."""

import random

import pytest

from folioforge.schemas import DUMP_TAGS, DUMP_XML
from folioforge.sources import xml_dump


def make(n, seed):
    """Records of all tags with words like tags, attributes with brackets, empty ones, long lines and ones of many lines."""
    rng = random.Random(seed)
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE dblp SYSTEM "dblp.dtd">\n<dblp>\n']
    for i in range(n):
        tag = rng.choice(DUMP_TAGS)
        space = rng.choice(["", "\n", "\r\n", "  "])
        body = "".join(f"<author>Näme {rng.randint(0, 99)}</author>{space}" for _ in range(rng.randint(0, 4)))
        body += f"<title>On {'long ' * rng.choice([0, 1, 1, 200])}articles of data, {i} &lt;www&gt; &amp; 漢字 {rng.choice(['x', '𝔹'])}</title>{space}<booktitle>book</booktitle><year>{1990 + i % 30}</year>{space}<ee>a</ee><ee>b</ee>"
        out.append(f'<{tag} key="{tag}/{i}" mdate="2011-01-1{i % 10}"/>{space}' if rng.random() < 0.05 else f'<{tag} {space}key="{tag}/{i}" mdate="2011-01-1{i % 10}">{space}{body}</{tag}>{space}')
    return "".join([*out, "</dblp>\n"])


def rows(df):
    return sorted(map(str, df.select(*DUMP_XML.fieldNames(), "type").collect()))


def by_tag(spark, path, tags):
    parts = [spark.read.format("xml").options(rowTag=t, attributePrefix="_").schema(DUMP_XML).load(path).withColumn("type", xml_dump.F.lit(t)) for t in tags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.fixture
def split(spark):
    """Sets the bytes of a split."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def put(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield put
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [83, 700, 5000, 10_000_000])
def test_equals_the_reader_of_one_tag(spark, tmp_path, split, size):
    """Splits from some for each record to one for all; two files."""
    n = 12 if size < 100 else 80
    for i in range(2):
        (tmp_path / f"{i}.xml").write_text(make(n, 10 * size + i), newline="")
    want, few = rows(by_tag(spark, str(tmp_path), DUMP_TAGS)), rows(by_tag(spark, str(tmp_path), ["book", "www"]))
    split(size)
    assert rows(xml_dump.read_records(spark, str(tmp_path))) == want and len(want) == 2 * n
    assert rows(xml_dump.read_records(spark, str(tmp_path), ["book", "www"])) == few


def test_no_task_has_a_whole_file_and_a_dump_is_read_once(spark, tmp_path, split):
    (tmp_path / "d.xml").write_text(make(100, 1))
    split(2000)
    got = xml_dump.scan_records(spark, str(tmp_path / "d.xml"))
    assert got.count() == 100
    plan = got._jdf.queryExecution().toString()
    assert "FileScan text" not in plan and "FileScan xml" not in plan  # what is left to run reads the written table


def test_broken_and_empty(spark, tmp_path):
    (tmp_path / "a.xml").write_text("")
    (tmp_path / "b.xml").write_text('<dblp></book><book key="b/1"><title>T &nosuch; &uuml;</title></book><article key="a/1"><title>never ends')
    got = xml_dump.read_records(spark, str(tmp_path)).collect()
    assert [(r["_key"], r["title"], r["type"]) for r in got] == [("b/1", ["T nosuch ü"], "book")]
