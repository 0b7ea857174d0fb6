"""The corpus pipeline, stage by stage, against plain versions of each."""

import itertools

import pytest
import tokenizers

import corpus_pipeline
from folioforge.llm import langid, quality, secrets
from folioforge.llm.queries import WORD_BPE

from .test_text_ops import check_packing, word_grams

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns, run as the pipeline runs them."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        out[name] = docs
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for name in ("language_id", "quality", "near_dedup", "secret_scan"):
        assert stages[name].schema == stages["documents"].schema or stages[name].columns == stages["documents"].columns


def test_language_stage(spark, stages):
    known = {r["doc_id"] for r in langid.identify(stages["documents"]).collect() if r["known"]}
    before, after = by_id(stages["documents"]), by_id(stages["language_id"])
    assert set(after) == known and all(r["text"] == before[i]["text"] for i, r in after.items())


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = stages["language_id"]
    keep = {r["doc_id"] for r in quality.classify_quality(docs, labels).collect() if r["keep"]}
    before, after = by_id(docs), by_id(stages["quality"])
    assert after == {i: before[i] for i in keep} and keep < set(before)


def test_near_dedup_stage(stages):
    before, after = by_id(stages["quality"]), by_id(stages["near_dedup"])
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    grams = {i: word_grams(words(r["text"])) for i, r in before.items()}
    root = {i: i for i in before}
    for i, j in itertools.combinations(sorted(before), 2):
        if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]) - 1e-9:
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
    assert after == {i: before[i] for i in set(root.values())}


def test_secret_stage(stages):
    before, after = by_id(stages["near_dedup"]), by_id(stages["secret_scan"])
    ranks = secrets.word_ranks(WORD_BPE)
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i]["text"] == secrets.redact(r["text"], ranks, 8.0) and after[i]["n_chars"] == len(after[i]["text"] or "")
        assert not secrets.base_spans(after[i]["text"] or "") or "[SECRET]" in after[i]["text"]


def test_packing_stage(stages):
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    tokens = {i: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for i, r in by_id(stages["secret_scan"]).items()}
    check_packing(stages["packing"].collect(), tokens)


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert sum(x[2] for x in key(corpus_pipeline.run(spark, SMALL))) == sum(x[2] for x in key(stages["packing"]))
    assert {x[0] for x in key(corpus_pipeline.run(spark, SMALL))} == set(by_id(stages["secret_scan"]))


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    """Null, empty, blank, very long and repeated texts, a null id and clashing columns go through every stage."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd_docs, SMALL)
        assert got.columns == odd_docs.columns, name
        assert got.count() <= 9 and stage(spark, no_docs, SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, SMALL).count() == 0
