"""The pipeline against a plain version, stage by stage, and what its stages do with odd rows."""

import hashlib
import math
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from driftjobs.llm.secrets import KINDS
from tests_plain import groups_of, near_copies, plain_spans

SF = "/root/testdata/sf0.001"


def plain_redacted(text):
    spans, out, at = plain_spans(text), [], 0
    while spans:
        start, kind, end = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[2])
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def plain_copies(doc_id, rate):
    u = (int(hashlib.md5(f"17:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    n, total = 0, math.exp(-rate)
    while total < u and n < 1000:
        n += 1
        total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
    return n


def test_run_equals_the_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs)
    group = groups_of(ids, near_copies({i: r.text for i, r in docs.items()}))
    texts = {i: plain_redacted(docs[i].text) for i in ids if group[i] == i}
    size = Counter()
    for i, t in texts.items():
        size[docs[i].source] += len(t.encode())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for i, t in texts.items():
        rate = 1 / len(size) * sum(size.values()) / size[docs[i].source]
        expected += [(i, docs[i].source, tuple(library.encode(t)))] * plain_copies(i, rate)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.source, tuple(r.piece_ids)) for r in got) == sorted(expected)
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    words = "the of and to in is that was for on with as are this by from "
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "a", 0, None), (2, words * 3, None, None, None, "y"), (2, words * 3, None, None, None, "y"), (3, "the cat sat on a mat and it was not amused by the dog that ran " * 2000, "en", "a", 1, "z"), (None, words + "other words here", "en", "a", 5, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        empty = stage(spark, docs.where(F.lit(False)), SF)
        assert empty.count() == 0
    kept = corpus_pipeline.drop_copies(spark, corpus_pipeline.identify(spark, spark.createDataFrame(rows, schema), SF), SF)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3] and kept.where("doc_id is null").count() == 1
    assert corpus_pipeline.encode(spark, spark.createDataFrame(rows, schema), SF).count() == len(rows)
