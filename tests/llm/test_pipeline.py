"""Stages of the corpus pipeline against a brute-force run over the same rows."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline
from patchloom.llm import byte_bpe, surrogates
from patchloom.llm.tools import stored

from .conftest import SF_DIR
from .test_table_operators import brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    named = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    own = {d for d, _, c in brute_components(named.items(), 5, 80) if d == c}
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    free = {d for d in own if not any(i in flat(named[d]) for i in items)}

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "ngram_join", "decontaminate", "surrogates", "byte_bpe"]
    kept = stored(stages["language"](spark, docs, SF_DIR), "t")
    assert {r["doc_id"] for r in kept.collect()} == set(named) and kept.columns == docs.columns
    single = stored(stages["ngram_join"](spark, kept, SF_DIR), "t")
    assert {r["doc_id"] for r in single.collect()} == own and single.columns == docs.columns
    clean = stored(stages["decontaminate"](spark, single, SF_DIR), "t")
    assert {r["doc_id"] for r in clean.collect()} == free and clean.columns == docs.columns
    private = stored(stages["surrogates"](spark, clean, SF_DIR), "t")
    after = {r["doc_id"]: r["text"] for r in private.collect()}
    assert set(after) == free and private.columns == docs.columns
    replaced = {r["doc_id"] for r in surrogates.replace(clean, "k", count_col="n").filter("n > 0").collect()}
    assert replaced and {d for d in free if after[d] != texts[d]} == replaced

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    want = {(d, len(exact.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for d, t in after.items()}
    got = stages["byte_bpe"](spark, private, SF_DIR).collect()
    assert {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got} == want


def test_one_row_of_each_group(spark, documents):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    docs = documents((1, a), (1, a), (2, b), (2, a), (3, b + " more"), (None, c), (None, c), (4, d), (None, d), (7, ""), (7, ""))
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, SF_DIR).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (4, d), (7, ""), (7, "")], key=repr)


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "words of a text", "en", "s", 15), (2, "", "en", "s", 0),
                                 (6, "some more words of another text", "en", "s", 31)], docs.schema)
    for given, want in ((docs, 0), (odd, 2)):
        for name, stage in corpus_pipeline.STAGES:
            given = stored(stage(spark, given, SF_DIR), "t")
        assert given.count() == want


def test_language_stage_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "the old house and the sea", "en", "s", 25, 0.25, "x")],
                                 "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string")
    assert [tuple(r) for r in corpus_pipeline.known_language(spark, docs, SF_DIR).collect()] == [tuple(r) for r in docs.collect()]
