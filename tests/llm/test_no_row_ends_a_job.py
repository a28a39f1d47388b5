"""Rows that a large crawl surely holds: bytes that are no text, hot beginnings, unclosed markup, vectors of any length."""

import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftjobs.llm import passages
from driftjobs.llm.audio import audio_features
from driftjobs.llm.language import bare_text, document_evidence, identify_languages, page_evidence
from driftjobs.llm.mixing import mix_sources
from driftjobs.llm.passages import PhraseAutomaton, strip_passages, words_of
from driftjobs.llm.secrets import redact, scan_secrets
from driftjobs.llm.sentence_pieces import encode_pieces
from driftjobs.llm.simhash import drop_near_copies, drop_simhash_copies, simhash_groups
from driftjobs.llm.token_counts import token_counts
from driftjobs.llm.toxicity import score_toxicity, train
from driftjobs.llm.vectors import SmallWorld, link_vectors
from test_text_operators import MODEL


@pytest.fixture(scope="module")
def broken(spark):
    """A text with bytes that aren't UTF-8, the same with U+FFFD in their place, and a plain one."""
    return spark.sql("""SELECT * FROM VALUES (1L, cast(unhex('61FF62207A') AS string), 'en', 's', 5L), (2L, 'a�b z', 'en', 's', 5L), (3L, 'plain words', 'en', 's', 11L) AS t(doc_id, text, lang, source, n_chars)""")


@pytest.mark.parametrize("operator", [
    lambda d: token_counts(d, MODEL).select("doc_id", "n_tokens"),
    lambda d: encode_pieces(d, MODEL).select("doc_id", "piece_ids", "decoded"),
    lambda d: identify_languages(d, **document_evidence(), labelled=d, labelled_text=F.col("text"), labelled_language=F.col("lang")).select("doc_id", "language", "accepted"),
    lambda d: strip_passages(d).select("id", "n_words", "kept"),
    lambda d: score_toxicity(d, train(d, d.selectExpr("doc_id", "doc_id % 2 AS toxic"))).select("doc_id", F.round("score", 9)),
    lambda d: scan_secrets(d).select("doc_id", "secret_spans"),
    lambda d: redact(d).select("doc_id", "text"),
    lambda d: simhash_groups(d).select("id", "fp"),
    lambda d: audio_features(d).select("doc_id", "media"),
], ids=["tokens", "pieces", "language", "passages", "toxicity", "secrets", "redact", "simhash", "audio"])
def test_bytes_that_are_no_text(broken, operator):
    """Every operator reads them as U+FFFD; all rows are there."""
    got = {r[0]: r[1:] for r in operator(broken).collect()}
    assert set(got) == {1, 2, 3} and got[1] == got[2]


def test_bytes_that_are_no_text_elsewhere(broken):
    assert {r.doc_id for r in drop_near_copies(broken).collect()} == {1, 3} == {r.doc_id for r in drop_simhash_copies(broken).collect()}
    assert {r.doc_id for r in mix_sources(broken).collect()} <= {1, 2, 3}
    pages = broken.selectExpr("doc_id AS page_id", "concat('<html lang=en>', text) AS html", "'http://a.de/' AS url")
    assert identify_languages(pages, **page_evidence(), labelled=broken, labelled_text=F.col("text"), labelled_language=F.col("lang")).count() == 3
    assert broken.where("doc_id = 1").select(F.hex("text")).first()[0] == "61FF62207A"


def plain_strip(texts):
    first = {}
    cut = {i: words_of(t) for i, t in texts.items()}
    for i in sorted(cut):
        for s in range(len(cut[i]) - 49):
            first.setdefault(tuple(cut[i][s : s + 50]), i)
    out = {}
    for i, ws in cut.items():
        gone = {s + k for s in range(len(ws) - 49) if first[tuple(ws[s : s + 50])] < i for k in range(50)}
        out[i] = b" ".join(w for k, w in enumerate(ws) if k not in gone).decode()
    return out


def test_many_phrases_that_begin_alike(spark, docs_of, monkeypatch):
    """More letters than an alphabet of code points would have for one anchor, but for the shards of hot ones."""
    monkeypatch.setattr(passages, "HOT_PHRASES", 20)
    monkeypatch.setattr(passages, "SHARD_WORDS", 2000)
    sizes = []
    find = PhraseAutomaton.find
    monkeypatch.setattr(PhraseAutomaton, "find", lambda self, words: sizes.append(len(self.phrases)) or find(self, words))
    licence = " ".join(f"l{k}" for k in range(16))
    texts = {}
    for k in range(150):
        own = " ".join(f"w{k}x{j}" for j in range(60 + k % 30))
        texts[2 * k] = f"{licence} {own}"
        texts[2 * k + 1] = f"before{k} {licence} {own} after" if k % 3 else f"{own} {licence}"
    got = {r.id: r.kept for r in strip_passages(docs_of(*texts.items())).collect()}
    assert got == plain_strip(texts)


def test_one_hot_anchor_at_size(spark):
    """25 MB of text: 34,000 phrases that begin with one run of 16 words, each in two documents."""
    licence = " ".join(f"l{k}" for k in range(16))
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(43)), lambda j: F.concat(F.lit("w"), F.col("k"), F.lit("x"), j)), " ")
    docs = spark.range(68_000).withColumn("k", F.floor(F.col("id") / 2)).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit(licence), words).alias("text"))
    got = strip_passages(docs).groupBy(F.col("id") % 2).agg(F.count(F.lit(1)), F.min("n_removed"), F.max("n_removed")).collect()
    assert sorted(map(tuple, got)) == [(0, 34_000, 0, 0), (1, 34_000, 60, 60)]


def test_every_document_past_every_shard(spark, monkeypatch):
    """Hits are those that all phrases find in all whole documents."""
    monkeypatch.setattr(passages, "SHARD_WORDS", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = {}

    def keep(docs, found, shared):
        beside = passages._beside(docs, found).select(F.explode(passages._cut(F.col("text"), F.col("spans"))).alias("x"))
        phrases = [r.words.encode() for r in beside.select("x.words").distinct().collect()]
        texts = {(r.id, r.key): words_of(r.text) for r in docs.collect()}
        automata = [PhraseAutomaton() for _ in range(5)]
        for k, p in enumerate(phrases):
            automata[k % 5].add(p.split(), k)
        seen["all"] = {(row, phrases[p], at) for row, ws in texts.items() for a in automata if a.phrases for p, at in a.find(ws)}
        hits = real(docs, found, shared)
        at = {k: tuple(ws) for k, ws in texts.items()}
        seen["hits"] = {((r.id, r.key), b" ".join(at[r.id, r.key][r["at"] : r["at"] + 50]), r["at"]) for r in hits.collect()}
        return hits

    real = passages.phrase_hits
    monkeypatch.setattr(passages, "phrase_hits", keep)
    strip_passages(docs).count()
    assert seen["all"] == seen["hits"] and seen["hits"]


@pytest.mark.parametrize("page", ["<" * 5_000_000, "<script " * 700_000, "<!-- " * 1_000_000, "<html " * 800_000, "<html lang" + " " * 5_000_000, "<style>" * 700_000 + "</script>", "</script" * 600_000, "<a " * 1_600_000 + ">"], ids=range(8))
def test_unclosed_markup_takes_linear_time(spark, page):
    began = time.time()
    bare_text(page)
    evidence = page_evidence()
    spark.createDataFrame([(1, page, "http://" + "a." * 500_000)], "page_id long, html string, url string").select(*[evidence[c].alias(c) for c in ("declared", "host", "suffix")]).collect()
    assert time.time() - began < 30


def test_bare_text():
    assert bare_text("a<b c='d'>e<!-- f <g> -->h<SCRIPT x>i<j></script >k<style>l</style>m") == "a e h k m"
    assert bare_text("a <!-- b > c <script>d <e f <g>h") == "a   c  d <e f  h"
    assert bare_text("") == "" and bare_text("1 < 2") == "1 < 2" and bare_text("x<script") == "x<script"


@pytest.mark.parametrize("dim", [1, 2, 4096])
def test_vectors_of_any_length(spark, dim):
    draw = np.random.default_rng(dim)
    base = draw.standard_normal((12, dim))
    rows = [base[k % 12] + draw.standard_normal(dim) * 0.01 * (k % 5) for k in range(90)]
    unit = [v / np.linalg.norm(v) for v in rows]
    near = np.array(unit) @ np.array(unit).T >= 0.95
    out = {r.id: r for r in link_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "vec_id long, embedding array<double>")).collect()}
    assert [out[k].n_links for k in range(90)] == (near.sum(1) - 1).tolist() and all(out[k].recall >= 0.9 for k in out)


def test_searches_hold_bounded_memory(monkeypatch):
    from driftjobs.llm import vectors

    unit = np.random.default_rng(1).standard_normal((600, 8)).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    whole = SmallWorld(unit)
    monkeypatch.setattr(vectors, "SEEN", 600 * 7)
    parts = SmallWorld(unit)
    assert all(np.array_equal(a, b) for a, b in zip(whole.layers, parts.layers, strict=True))
    assert np.array_equal(whole.search(unit, 20)[0], parts.search(unit, 20)[0]) and public_tokenizers
