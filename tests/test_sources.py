"""Sources on small files written here."""

import datetime as dt

import pytest

from folioforge.plans import canonical
from folioforge.sources import delimited, oai, tei, xml_dump

DUMP = """<?xml version="1.0"?><dblp>
<article key="a/1" mdate="2011-01-11"><author>Ann B. Cee</author><author>Dan 0001</author><title>On H<sub>2</sub>O &amp; <i>more</i></title><year>1999</year><pages>1-5</pages><ee>x</ee><ee>y</ee><journal>J</journal></article>
<article key="a/2" mdate="bad"><author>A</author><title>T</title><year>1999</year></article>
<article key="a/3" mdate="2012-2-3"><author>A</author><title>T</title><year>99999</year></article>
<inproceedings key="c/1" mdate="2012-02-03"><author>A</author><title>Conf</title><booktitle>Proc</booktitle><year>2001</year></inproceedings>
<phdthesis key="p/1" mdate="2013-02-03"><title>No author</title><year>2001</year></phdthesis>
</dblp>"""


@pytest.fixture
def dump(tmp_path):
    p = tmp_path / "dump.xml"
    p.write_text(DUMP)
    return str(p)


def test_dump(spark, dump):
    good, counts = xml_dump.harvest(spark, dump)
    rows = {r["dblp_key"]: r for r in good.collect()}
    assert set(rows) == {"a/1", "c/1"} and tuple(counts.first()) == (2, 4)
    one = rows["a/1"]
    assert one["author"] == "Ann B. Cee;Dan 0001;" and one["title"] == "On H2O & more" and one["ee"] == "y" and one["pub_year"] == dt.date(1999, 1, 1)


@pytest.mark.parametrize(("start", "end", "limit", "n"), [("2012-01-01", None, None, 1), (None, "2011-12-31", None, 1), ("2014-01-01", None, None, 0), (None, None, 0, 0), (None, None, 99, 2)])
def test_dump_window_and_limit(spark, dump, start, end, limit, n):
    assert xml_dump.harvest(spark, dump, start=start, end=end, limit=limit)[0].count() == n


def test_entities(spark, tmp_path):
    assert xml_dump.expand_entities("J&uuml;rgen &amp; &unknown; &lt;") == "Jürgen &amp; unknown &lt;"
    p = tmp_path / "dump.xml"
    p.write_text(
        """<?xml version="1.0"?><!DOCTYPE dblp SYSTEM "dblp.dtd"><dblp>
<article key="a/1" mdate="2011-01-11"><author>J&uuml;rgen &Ouml;z</author><title>Gr&ouml;&szlig;e &amp; <i>Ma&szlig;</i></title><year>1999</year></article>
<article key="a/2" mdate="2011-01-11"><author>Plain</author><title>Plain &lt; T</title><year>2000</year></article>
<book key="b/1" mdate="2011-01-12"><author>&Aacute;b</author><title>B&eacute;</title><year>2001</year></book></dblp>"""
    )
    rows = {r["dblp_key"]: r for r in xml_dump.harvest(spark, str(p))[0].collect()}
    assert {k: (r["author"], r["title"], r["type"]) for k, r in rows.items()} == {"a/1": ("Jürgen Öz;", "Größe & Maß", "article"), "a/2": ("Plain;", "Plain < T", "article"), "b/1": ("Áb;", "Bé", "book")}
    two = xml_dump.harvest(spark, str(p), tags=["book", "article"])[0]
    assert two.count() == 3 and xml_dump.harvest(spark, str(p), tags=["book"])[0].count() == 1
    assert xml_dump.with_title(two.withColumn("title", xml_dump.F.lit(None).cast("string"))).first()["title"] == "Test"


def test_canonical_dump(spark, dump):
    rows = {r["local_url"]: r for r in canonical.from_dump(xml_dump.harvest(spark, dump)[0]).collect()}
    assert rows["a/1"]["pub_release"]["key"] == "J" and rows["c/1"]["pub_release"]["key"] == "Proc"
    assert [a["parsed_name"] for a in rows["a/1"]["authors"]] == ["Ann B. Cee", "Dan"]
    assert rows["a/1"]["publication"]["date_published"] == 1999 and rows["a/1"]["publication"]["type_ids"] == "article"


PREPRINT = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header><identifier>oai:1</identifier><datestamp>2010-05-06</datestamp></header><metadata><arXiv xmlns="http://arxiv.org/OAI/arXiv/"><id>0704.0001</id><created>2007-04-02</created><authors><author><keyname>Bal</keyname><forenames>C.</forenames></author><author><keyname>;</keyname></author><author><keyname>Solo</keyname></author></authors><title>A  title
 here</title><categories>hep-ph</categories><abstract> Text </abstract></arXiv></metadata></record>
<record><header status="deleted"><identifier>oai:2</identifier><datestamp>2010-05-06</datestamp></header></record>
</ListRecords></OAI-PMH>"""


def test_preprints(spark, tmp_path):
    p = tmp_path / "p.xml"
    p.write_text(PREPRINT)
    df = oai.read_preprints(spark, str(p))
    (row,) = df.collect()
    assert (row["identifier"], row["author"], row["title"], row["created"], row["mdate"]) == ("0704.0001", "Bal,C.;Solo;", "A title here", dt.date(2007, 4, 2), dt.date(2010, 5, 6))
    (c,) = canonical.from_preprints(df).collect()
    assert c["study_fields"] == ["hep-ph"] and c["publication"]["abstract"] == "Text" and c["publication"]["date_published"] == 2007


CORE = """<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords><record><header><identifier>oai:c;1</identifier><datestamp>2010-01-01</datestamp></header>
<metadata><oai_dc:dc xmlns:oai_dc="o" xmlns:dc="d"><dc:title>Core</dc:title><dc:creator>X Y</dc:creator><dc:creator>Z</dc:creator><dc:subject>k1</dc:subject><dc:subject/><dc:subject>k2</dc:subject><dc:date>1999-02-03</dc:date><dc:date>2004</dc:date></oai_dc:dc></metadata></record>
<record><header status="deleted"><identifier>oai:9</identifier></header></record></ListRecords></OAI-PMH>"""


def test_core(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"{i}.xml").write_text(CORE.replace("c;1", f"c;{i}"))
    df = oai.read_core(spark, str(tmp_path))
    rows = df.orderBy("identifier").collect()
    assert [r["identifier"] for r in rows] == ["oai:c;0", "oai:c;1"] and rows[0]["author"] == "X Y;Z;" and rows[0]["subjects"] == "k1;k2;" and rows[0]["dates"] == "1999-02-03;2004;"
    c = canonical.from_core(df).orderBy("local_url").first()
    assert c["local_url"] == "oai:c0" and c["keywords"] == ["k1", "k2"] and c["publication"]["date_published"] == 2004


def test_core_limit_and_repeated_values(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xml").write_text(CORE.replace("c;1", f"c;{i}"))
    assert [r["identifier"] for r in oai.read_core(spark, str(tmp_path), 2).collect()] == ["oai:c;0", "oai:c;1"]


def test_feed(spark, tmp_path):
    asked = []

    def fetch(params):
        asked.append(params)
        n = len(asked)
        token = f"<resumptionToken cursor='0'>t&amp;{n}</resumptionToken>" if n < 3 else "<resumptionToken/>"
        return CORE.replace("c;1", f"c;{n}").replace("</ListRecords>", token + "</ListRecords>")

    feed = oai.Feed(fetch)
    assert feed.save(spark, str(tmp_path / "pages"), "2010-01-01", "2010-02-01") == 3
    assert asked[0] == {"verb": "ListRecords", "metadataPrefix": "oai_dc", "from": "2010-01-01", "until": "2010-02-01"} and asked[1] == {"verb": "ListRecords", "resumptionToken": "t&1"}
    assert oai.read_core(spark, str(tmp_path / "pages")).count() == 3
    asked.clear()
    assert len(list(feed.pages(limit=3))) == 2  # two records a page
    assert list(oai.Feed(lambda p: "<OAI-PMH><error code='noRecordsMatch'/></OAI-PMH>").pages()) == []
    with pytest.raises(ValueError):
        list(oai.Feed(lambda p: '<error code="badArgument">x</error>').pages())
    with pytest.raises(ValueError):
        list(feed.pages(limit=0))


def test_tei_names_titles_dates(spark, tmp_path):
    person = lambda *parts: "<author><persName>" + "".join(f'<forename type="{t}">{n}</forename>' if t else f"<surname>{n}</surname>" for t, n in parts) + "</persName></author>"
    p = tmp_path / "t.xml"
    p.write_text(
        "<TEI><listBibl><biblStruct><analytic><title>First</title><title>Last</title>"
        + person(("middle", "B"), ("first", "A"), ("first", "Ann"), ("middle", "Cc"), ("other", "D"), ("", "Eff")) + person(("", "Alone")) + person(("first", "G"))
        + '</analytic><monogr><title>J</title><imprint><date when="2001"/><date when="2002-05"/></imprint></monogr></biblStruct></listBibl></TEI>'
    )
    (row,) = tei.read_references(spark, str(p), 1).collect()
    assert (row["title"], row["authors"], str(row["date"])) == ("Last", "A. Ann B. Cc D. Eff;Alone;G.", "2002-01-01")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><listBibl>
<biblStruct><analytic><title level="a">Article</title><author><persName><forename type="first">A</forename><forename type="middle">B</forename><surname>Cee</surname></persName></author></analytic><monogr><title level="j">Journal</title><imprint><date type="published" when="2004-05"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>Book</title><author><persName><forename type="first">Dan</forename><surname>Ee</surname></persName></author><imprint><date when="1999"/></imprint></monogr></biblStruct>
<biblStruct><monogr><title>No author</title><imprint/></monogr></biblStruct>
</listBibl></TEI>"""


def test_tei(spark, tmp_path):
    p = tmp_path / "t.xml"
    p.write_text(TEI)
    rows = tei.read_references(spark, str(p), 7).orderBy("title").collect()
    assert [(r["title"], r["authors"], str(r["date"]), r["source"], r["status"], r["tries"]) for r in rows] == [("Article", "A. B. Cee", "2004-01-01", 7, "OP", 0), ("Book", "Dan Ee", "1999-01-01", 7, "OP", 0)]


def test_delimited(spark, tmp_path):
    write = lambda n, t: (tmp_path / n).write_text(t) and str(tmp_path / n)
    assert [tuple(r) for r in delimited.read_csv(spark, write("a.csv", "year,sum\n1990,5\n"), "year int, sum bigint").collect()] == [(1990, 5)]
    assert [tuple(r) for r in delimited.read_pairs(spark, write("b.csv", "0,7\n1,2\n")).collect()] == [(0, 7), (1, 2)]
    assert [tuple(r) for r in delimited.read_reference_ids(spark, write("c.tsv", '0000000A\t000000FF\n')).collect()] == [(10, 255)]
    assert [tuple(r) for r in delimited.read_semicolons(spark, write("d.csv", 'a;b\n"x;y";""\n'), "a string, b string").collect()] == [("x;y", None)]
    assert [r["seconds"] for r in delimited.read_times(spark, write("e.log", "x TRACK:1.5\nnone\ny TRACK:2\n")).collect()] == [1.5, 2.0]
    assert [tuple(r) for r in delimited.read_log_pairs(spark, write("f.log", "SOURCE 0A:Big title\nx\nREF FF: other\n")).collect()] == [("SOURCE", "0A", "Big title"), ("REF", "FF", "other")]
