"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftjobs.llm import queries
from driftjobs.llm.language import letter_model
from driftjobs.llm import passages
from driftjobs.llm import simhash as simhash_module
from driftjobs.llm.audio import audio_features
from driftjobs.llm.mixing import mix_sources
from driftjobs.llm.secrets import KINDS, redact, scan, scan_secrets
from driftjobs.llm.sentence_pieces import encode_pieces
from driftjobs.llm.simhash import drop_near_copies, simhash, simhash_groups
from driftjobs.llm.token_counts import token_counts
from driftjobs.llm.vectors import SmallWorld, link_vectors
from tests_plain import groups_of, near_copies, plain_base, plain_spans


def test_near_copies_beyond_two_bits_go(spark, docs_of):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = draw.choices(words, k=200)
    changed = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(base))
    texts = [changed(), changed(40), changed(40, 160), changed(*range(10, 200, 10)), " ".join(draw.choices(words, k=200)), None, "", "a b", "A  b", "a b c"]
    docs = docs_of(*texts)
    assert (simhash(texts[0], 5) ^ simhash(texts[2], 5)).bit_count() > 2
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [0, 3, 4, 5, 7, 9]
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    group = groups_of(sorted(texts), near_copies(texts))
    assert sorted(r.doc_id for r in drop_near_copies(docs).select("doc_id").collect()) == sorted(set(group.values()))


def test_a_large_group_of_near_copies_is_found_whole(spark, docs_of):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    base = draw.choices(words, k=300)
    texts = []
    for _ in range(400):
        own = list(base)
        for k in draw.sample(range(300), draw.randrange(1, 5)):
            own[k] = draw.choice(words)
        texts.append(" ".join(own))
    kept = drop_near_copies(docs_of(*texts, *[" ".join(draw.choices(words, k=300)) for _ in range(50)]))
    assert kept.where(F.col("doc_id") < 400).count() == 1 and kept.count() == 51


def test_near_copies_among_many_unlike_texts_of_their_places(spark, docs_of):
    draw = random.Random(0)
    words = [f"w{i}" for i in range(100_000)]
    base = draw.choices(words, k=100)
    changed = lambda *at: " ".join(draw.choice(words) if k in at else w for k, w in enumerate(base))
    texts = [changed(*draw.sample(range(100), 5)) for _ in range(800)]
    texts[400:400] = [changed(99), changed(0)]  # wherever these meet, the least and the greatest are like neither
    group = groups_of(range(802), near_copies(dict(enumerate(texts))))
    kept = drop_near_copies(docs_of(*texts))
    assert group[401] == 400 and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(group.values()))


def test_near_copies_write_each_place_once(spark, docs_of, monkeypatch):
    tables = []
    plain = simhash_module.written
    monkeypatch.setattr(simhash_module, "written", lambda df: tables.append(df.columns) or plain(df))
    words = " ".join(f"w{i}" for i in range(100))
    docs = docs_of(words, words + " more", "quite another text of some words")
    assert sorted(r.doc_id for r in drop_near_copies(docs).collect()) == [0, 2]
    assert sum("at" in t for t in tables) == 1 and sum("k" in t for t in tables) == 1


def test_language_query_judges_pages(spark, sf):
    rows = queries.op3_language_id(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").withColumn("path_lang", F.regexp_extract("url", "/(en|de|fr|es)/", 1)).collect()}
    got = {r.page_id: r for r in rows if r.table == "pages"}
    assert got.keys() == pages.keys() and all(got[i].language == pages[i].path_lang and got[i].lang and got[i].source for i in pages)
    assert sum(r.table == "documents" for r in rows) == spark.read.parquet(f"{sf}/documents.parquet").count() == sum(r.doc_id is not None for r in rows)


def test_copies_count_once_in_the_letter_model(spark):
    texts = [(f"text {'abcdefghij'[i]} number {'qwertzuiop'[i]}", "en") for i in range(10)]
    model = lambda rows, n: letter_model(spark.createDataFrame(rows, "t string, l string"), F.col("t"), F.col("l"), ["en"], train_rows=n)
    for n in (4, 100):
        assert all((model(texts + [t] * 50, n) == model(texts, n)).all() for t in texts[:3])


def test_spans_equal_the_plain_scanner(spark, docs_of):
    """Over a whole table and made texts: base spans place by place, weak parts pair by pair."""
    draw = random.Random(11)
    bits = ["token", "Secret", '" : "', "=", "apikey", "API_KEY", " ", "  :", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "pass", "word", "passwd:", "x9/+_", "http://h.example", "10.0.0.1:80", "\n", "aB3xY9kLm2Qw7ZrT5uV8"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(30))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["token=" + "a" * 300_000 + " x" * 100_000 + " AKIA" + "Z" * 50_000, texts[0], texts[0]]
    docs = docs_of(*texts).withColumns({"n_hex": F.lit("mine"), "secret_spans": F.lit(1)})
    rows = {r.doc_id: r for r in scan_secrets(docs).collect()}
    for i, t in enumerate(texts):
        found = [(s.start, KINDS.index(s.kind), s.end) for s in rows[i].secret_spans]
        assert [s for s in found if s[1] < 3] == plain_base(t or ""), t
        assert found == plain_spans(t), t
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(s[1] == k for s in found) for k in range(3))


def test_automata_decide(spark, docs_of, monkeypatch):
    """Windows of every text as proposals remove nothing that doesn't recur, and without an automaton's hits nothing goes."""
    draw = random.Random(4)
    words = lambda n: [draw.choice(["red", "green", "blue", "old", "new"]) + str(draw.randrange(90)) for _ in range(n)]
    passage = words(80)
    own = lambda i, n: [f"{w}of{i}" for w in words(n)]
    docs = docs_of(*[" ".join(own(i, 30) + passage + own(i, 30)) for i in range(6)], " ".join(words(200)))
    removed = lambda: [r.n_removed for r in passages.strip_passages(docs).orderBy("id").collect()]
    whole = removed()
    assert whole[0] == whole[6] == 0 and set(whole[1:6]) == {80}
    proposed = lambda d: d.select("id", "key", F.explode(passages._anchors(F.col("text"))).alias("x")).select("id", "key", "x.a", "x.b", "x.h")
    monkeypatch.setattr(passages, "candidate_windows", lambda d: (passages.written(proposed(d)), passages.written(proposed(d))))
    got = removed()
    assert got[0] == got[6] == 0 and all(0 < a <= b for a, b in zip(got[1:6], whole[1:6], strict=True))
    monkeypatch.undo()
    real = passages.phrase_hits
    monkeypatch.setattr(passages, "phrase_hits", lambda *tables: passages.written(real(*tables).where("id <> 3")))
    assert removed() == [0 if i == 3 else n for i, n in enumerate(whole)]


def test_passing_places_are_not_written(spark, docs_of, monkeypatch):
    """A file written to a local folder costs a process of its own: the places that pass a shard are read once and go on as they are."""
    real, kept = passages.written, []
    monkeypatch.setattr(passages, "written", lambda df: kept.append(set(df.columns)) or real(df))
    passage = " ".join(f"p{k}" for k in range(60))
    docs = docs_of(passage, f"before {passage}", "other words")
    assert sorted((r.id, r.n_removed) for r in passages.strip_passages(docs).collect()) == [(0, 0), (1, 60), (2, 0)]
    assert len(kept) == 15 and not any({"id", "hot"} <= columns for columns in kept)


def test_long_texts_repeats_and_clashing_names(spark, docs_of):
    """Each operator over texts of millions of letters, rows alike in every column and columns named like its own."""
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    draw = random.Random(6)
    long = " ".join("".join(draw.choices("abcdefghij", k=draw.randrange(1, 9))) for _ in range(300_000))
    names = ("n_bytes", "n_tokens", "piece_ids", "decoded", "fp", "component", "media", "payload", "features", "copy_no", "steps", "first", "row_key", "key", "spans", "starts", "k1", "node", "words")
    docs = docs_of((0, long), (1, long + " end"), (2, "short"), (2, "short"), (3, None)).withColumns({n: F.lit("mine") for n in names})
    expected = {0: len(library.encode(long)), 1: len(library.encode(long + " end")), 2: len(library.encode("short")), 3: 0}
    rows = token_counts(docs, model).select("doc_id", "n_tokens", "steps").collect()
    assert len(rows) == 5 and all(r.n_tokens == expected[r.doc_id] and r.steps == "mine" for r in rows)
    rows = encode_pieces(docs, model).select("doc_id", "n_pieces", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same")).collect()
    assert len(rows) == 5 and all(r.n_pieces == expected[r.doc_id] and r.same for r in rows)
    rows = {(r.id, r.n_words, r.n_removed) for r in passages.strip_passages(docs).collect()}
    assert rows == {(0, 300_000, 0), (1, 300_001, 300_000), (2, 1, 0), (3, 0, 0)}
    rows = {r.id: r.component_id for r in simhash_groups(docs).collect()}
    assert rows == {0: 0, 1: 0, 2: 2, 3: 3}
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 2, 3]
    rows = audio_features(docs).select("doc_id", F.octet_length("payload").alias("n"), "features.frames", "steps").collect()
    assert len(rows) == 5 and all(r.n % 64 == 0 and r.steps == "mine" for r in rows) and max(r.frames for r in rows) > 10_000
    mixed = mix_sources(docs, total=3.0 * len(long))
    assert set(mixed.columns) == {*docs.columns, "copy_no", "shuffle_key"} and mixed.count() > 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.1], 5), (3, [1.0, 0.0, 0.0], 5), (4, [9.0, 0.0, 0.1], 5), (5, [1.0] * 5000, 5), (6, [2.0] * 5000, 5), (6, [2.0] * 5000, 5)], "vec_id int, embedding array<double>, node int")
    vectors = vectors.withColumns({n: F.lit("mine") for n in ("dim", "shard", "k1", "recall", "vector", "id")})
    found = {(r.id, r.n_links, r.component_id) for r in link_vectors(vectors).collect()}
    assert found == {(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 2, 5), (6, 2, 5)}


def test_of_two_shards_one_asks_the_other(spark, monkeypatch, tmp_path):
    from driftjobs.llm import vectors

    real, path = vectors._ask, str(tmp_path)

    def counting(least, dtype):
        ask = real(least, dtype)

        def run(batches):
            import uuid

            def seen():
                for batch in batches:
                    with open(f"{path}/{uuid.uuid4().hex}", "w") as out:
                        out.write(str(batch.column("graph").null_count))
                    yield batch

            yield from ask(seen())

        return run

    monkeypatch.setattr(vectors, "_ask", counting)
    monkeypatch.setattr(vectors, "LEAST_ROWS", 500)
    draw = np.random.default_rng(3)
    unit = draw.standard_normal((2400, 24))
    unit[:300] = unit[0] + draw.standard_normal((300, 24)) * 0.03
    unit[300:1300:2] = unit[301:1300:2] + draw.standard_normal((500, 24)) * 0.02
    near = [(k, v.tolist()) for k, v in enumerate(unit)]
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    group, counts = groups_of(range(2400), zip(a.tolist(), b.tolist(), strict=True)), np.bincount(np.r_[a, b], minlength=2400)
    rows = link_vectors(spark.createDataFrame(near, "vec_id long, embedding array<double>")).collect()
    assert {(r.id, r.n_links, r.component_id) for r in rows} == {(k, int(counts[k]), group[k]) for k in range(2400)} and len(a) > 10_000
    assert 2 * 2400 < sum(int(f.read_text()) for f in tmp_path.iterdir()) < 3 * 2400  # four shards: the own one, and half of the others


def test_large_groups_do_not_hide_misses():
    draw = np.random.default_rng(4)
    unit = draw.standard_normal((1500, 32))
    unit[:500] = unit[0] + draw.standard_normal((500, 32)) * 0.02
    unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
    graph = SmallWorld(unit)
    for layer in graph.layers:  # nothing leads to these
        layer[np.isin(layer, np.arange(1400, 1500))] = -1
    beam, recall = graph.audited_beam(0.95)
    found = {(a, b) for q, c in graph.within(unit, 0.95, beam) for a, b in zip(q.tolist(), c.tolist(), strict=True)}
    assert beam == 0 and recall == 1.0 and found == set(zip(*[x.tolist() for x in np.nonzero(unit @ unit.T >= np.float32(0.95 - 1e-4))], strict=True))


def test_long_keys_and_upper_case_schemes(docs_of):
    key = "".join(random.Random(8).choices("ABCDEFghijkl0123456789+/", k=300))
    spans = lambda text: {kind: text[a:b] for a, kind, b in scan(text, 200)}
    found = spans(f"ASIAABCDEFGH {key} end")
    assert found[KINDS.index("weak_secret")] == key and KINDS.index("weak_access") in found
    assert KINDS.index("endpoint") in spans(f"HTTPS://host.example/path {key} end")
    assert spans(f"plain {key} end") == {}
    assert redact(docs_of(f"ASIAABCDEFGH {key} end")).first().text == "[weak_access] [weak_secret] end"
