"""Scalar functions against known values."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import names, text, values
from folioforge.functions.phonetic import double_metaphone


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [(" ThIs is a TITleß  ", "this is a titless"), ("iss\rue", "issue"), ("iss-ue", "iss ue"), ("a,  b!c", "a bc"), ("Éléments à vélo", "elements a velo"), ("", ""), (None, None)],
)
def test_normalize_title(spark, raw, expected):
    assert one(spark, raw, text.normalize_title) == expected


@pytest.mark.parametrize(("raw", "expected"), [("! Kim lu Yee ", "kim lux yee"), ("J.-P. Sartre", "j p sartre"), ("Yu", "yux")])
def test_normalize_author(spark, raw, expected):
    assert one(spark, raw, text.normalize_author) == expected


def test_lists_and_pages(spark):
    assert one(spark, "a;b;", text.split_authors) == ["a", "b"]
    assert one(spark, "a;b", text.split_authors) == ["a"]
    assert tuple(one(spark, "1-5", text.parse_pages)) == ("1", "5")
    assert tuple(one(spark, "7", text.parse_pages)) == ("7", "7")
    assert tuple(one(spark, "1-2-3", text.parse_pages)) == (None, None)


def test_queries(spark):
    assert one(spark, "the art of computer programming", text.relevant_words) == ["programming", "computer", "art"]
    assert one(spark, "aa bb cc", text.relevant_words) == ["cc", "bb", "aa"]
    assert one(spark, "a tea for two", text.search_query) == "a tea for two"
    assert one(spark, "graph theory and use", text.search_query) == "theory graph use"
    assert one(spark, "john michael x smith wang", text.author_tokens) == ["michael", "smith", "wang", "john"]
    assert one(spark, "alpha beta gamma delta", text.author_query) == "+delta +gamma +alpha"


@pytest.mark.parametrize(("raw", "expected"), [("Donald Knuth", "knuth,d"), ("Plato", "plato,"), ("Guido van Rossum", "van rossum,g"), ("Sammy Davis Jr.", "davis,s"), ("Knuth, Donald", "knuth,d"), ("Johan van der Berg", "van der berg,j")])
def test_name_block(spark, raw, expected):
    assert one(spark, raw, names.name_block) == expected


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("chim sum cha", "chim sum cha", True), ("chim sum cha", "chim s cha", True), ("chim sum", "chim sum cha", True), ("chim s c", "chim sum cha", True),
        ("chim sum c", "chim s cha", False), ("chim sum c ban tu", "chim sum cha", False), ("chim cha sum", "chim sum cha", False), ("la lu mu", "la le lu mu", True), ("la le lu mu", "la lu mu", False),
    ],
)
def test_aligned(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(names.aligned(F.split("a", " "), F.split("b", " ")).alias("r")).first()
    assert row["r"] is expected


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ("yufeng xin", "xinzhi xing", False), ("x", "xin xin", False), ("ernest j", "john e", False), ("p d h hill", "hillary d protas", False), ("ahmed metwally", "ahmed hassan m h ali", False),
        ("dah ming chiu", "dah ming w chiu", True), ("dah ming chiu", "chiu dah ming", True), ("howard ottensen", "howard o meyer", False), ("howard ottensen", "h ottensen", True),
        ("zhang xiu", "xiu zhang", True), ("zhang xiu", "zhang x", True), ("zhang xiu", "x zhang", True), ("rhys hill", "donna r hill", False), ("jose pereira", "jose m g torres pereira", False),
        ("j p olivier dex sardan", "olivier peulen", False),
    ],
)
def test_same_author(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(names.same_author("a", "b").alias("r")).first()
    assert row["r"] is expected


def plain_aligned(a, b, most=1, short=True):
    """One pass over a: each word takes the next free word of b that it fits."""
    at = hits = shortens = lengthens = 0
    for x in a:
        found = next((i for i in range(at, len(b)) if x == b[i] or short and (len(x) == 1 and b[i].startswith(x) or len(b[i]) == 1 and x.startswith(b[i]))), None)
        if found is None:
            at = len(b)
            continue
        hits, at = hits + 1, found + 1
        if x != b[found]:
            shortens, lengthens = shortens + (len(x) == 1), lengthens + (len(x) != 1)
    extra = len(a) - hits, len(b) - hits
    return not (shortens and lengthens) and not (extra[0] and extra[1]) and max(extra) <= most and not (max(extra) and (shortens or lengthens))


def plain_same(a, b):
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    turn = lambda w, k: w[k % len(w) :] + w[: k % len(w)]
    if any(len(w) == 1 for w in x) or len(x[-1]) > 3 and sum(map(len, x)) // len(x) >= 4:
        if x[-1] != y[-1] or len(x) < 2 or len(y) < 2 or not (x[0].startswith(y[0]) or y[0].startswith(x[0])):
            return False
        common = x[-1] in text.AMBIGUOUS_NAMES
        return plain_aligned(turn(x, -1), turn(y, -1), 0 if common else 1, not common)
    return any(plain_aligned(t, y) or plain_aligned(y, t) for t in (x, turn(x, -1), turn(x, 1)))


def test_same_author_equals_plain_python(spark):
    import random

    rng = random.Random(5)
    words = ["ann", "a", "anna", "smith", "s", "lee", "li", "xin", "x", "xinzhi", "hallberg", "h", "m", "garcia", "wang", "zhang", "j", "jose"]
    pairs = []
    for _ in range(3000):
        a = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        b = list(a) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            i = rng.randrange(len(b))
            b[i] = b[i][0]
        if rng.random() < 0.4:
            b.insert(rng.randint(0, len(b)), rng.choice(words))
        if rng.random() < 0.3:
            rng.shuffle(b)
        pairs.append((" ".join(a), " ".join(b)))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.same_author("a", "b").alias("r")).collect()
    assert 300 < sum(r["r"] for r in rows) < 2700
    assert [(r["a"], r["b"]) for r in rows if r["r"] != plain_same(r["a"], r["b"])] == []


def test_rotate_score_phonetic(spark):
    row = spark.range(1).select(
        names.rotate(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1).alias("l"), names.rotate(F.array(F.lit("a"), F.lit("b"), F.lit("c")), -1).alias("r"), names.name_score(F.array(F.lit("j"), F.lit("kim"), F.lit("abcdefghi"))).alias("s")
    ).first()
    assert (row["l"], row["r"], row["s"]) == (["b", "c", "a"], ["c", "a", "b"], 2)
    assert one(spark, "philip knuth", names.metaphone_name) == "FLP N0" and one(spark, "a  b", names.metaphone_name) == "A  P" and one(spark, "", names.metaphone_name) == ""
    assert spark.createDataFrame([(None,)], "n string").select(names.metaphone_name("n").alias("m")).first()["m"] is None


@pytest.mark.parametrize(
    ("word", "primary", "secondary"),
    [
        ("Smith", "SM0", "XMT"), ("Smyth", "SM0", "XMT"), ("Schmidt", "XMT", "SMT"), ("Thompson", "TMPSN", ""), ("Michael", "MKL", "MXL"), ("Knight", "NT", ""), ("Caesar", "SSR", ""), ("Chianti", "KNT", ""), ("architect", "ARKTKT", ""),
        ("focaccia", "FKX", ""), ("bacchus", "PKS", ""), ("edge", "AJ", ""), ("Edgar", "ATKR", ""), ("laugh", "LF", ""), ("Jose", "HS", ""), ("Wright", "RT", ""), ("Wasserman", "ASRMN", "FSRMN"), ("Arnow", "ARN", "ARNF"),
        ("Filipowicz", "FLPTS", "FLPFX"), ("Zhao", "J", ""), ("Xavier", "SF", "SFR"), ("Breaux", "PR", ""), ("sugar", "XKR", "SKR"), ("island", "ALNT", ""), ("Cabrillo", "KPRL", "KPR"), ("Gallegos", "KLKS", "KKS"), ("thumb", "0M", "TM"),
        ("Resnais", "RSN", "RSNS"), ("Campbell", "KMPL", ""), ("raspberry", "RSPR", ""), ("Hochmeier", "HKMR", ""), ("Tichner", "TXNR", "TKNR"), ("McLaughlin", "MKLFLN", ""), ("orchestra", "ARKSTR", ""), ("Bertucci", "PRTX", ""),
        ("accident", "AKSTNT", ""), ("Macgregor", "MKRKR", ""), ("Cagney", "KKN", ""), ("Jankelowicz", "JNKLTS", "ANKLFX"), ("school", "SKL", ""), ("Schneider", "XNTR", "SNTR"), ("Szabo", "SP", "XP"), ("Garçon", "KRSN", ""), ("Müller", "MLR", ""),
        ("Ghislane", "JLN", ""), ("Ghiradelli", "JRTL", ""), ("Peña", "PN", ""), ("", "", ""), ("1", "", ""),
    ],
)
def test_double_metaphone(word, primary, secondary):
    assert double_metaphone(word) == (primary, secondary)


def test_similarity(spark):
    row = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abcde", "abcde")], "a string, b string").select(text.title_similarity("a", "b").alias("s")).collect()
    assert [r["s"] for r in row] == [57, 100, 100]


def test_other_scripts(spark):
    words = ["Ελληνικά", "Ψυχή", "Щукин Ёлка объект", "Київ", "Étude Straße", "plain", "日本"]
    want = ["ellenika", "psukhe", "shchukin iolka obekt", "kiyiv", "etude strasse", "plain", "日本"]
    got = [r["t"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.normalize_title("w").alias("t")).collect()]
    assert got == want == [" ".join(text.title_words(w)) for w in words]


def test_small_text(spark):
    assert one(spark, "John Doe 0001", text.strip_years) == "John Doe"
    assert one(spark, "{ns}title", text.local_tag) == "title"
    assert one(spark, "http://a.b/c/d.pdf", text.file_name) == "d.pdf"
    assert one(spark, "H<sub>2</sub>O\n &amp; co", text.without_tags) == "H2O & co"
    row = spark.createDataFrame([("A", "b", "Doe")], "f string, m string, l string").select(text.person_name("f", "m", "l").alias("r"), text.person_name("f", F.lit(None).cast("string"), "l").alias("q")).first()
    assert (row["r"], row["q"]) == ("A. b. Doe", "A. Doe")


def test_values(spark):
    assert str(one(spark, "1995-4-12", values.parse_mdate)) == "1995-04-12"
    assert one(spark, "x", values.parse_mdate) is None
    assert str(one(spark, "1999", values.parse_year)) == "1999-01-01"
    assert one(spark, "19999", values.parse_year) is None
    row = spark.range(1).select(values.from_hex(F.lit("0000AB12")).alias("n"), values.to_hex8(F.lit(43794)).alias("h"), values.bit_indexes(F.lit(5).cast("bigint")).alias("i"), values.bit(F.lit(62)).alias("b")).first()
    assert (row["n"], row["h"], row["i"], row["b"]) == (43794, "0000AB12", [0, 2], 1 << 62)
