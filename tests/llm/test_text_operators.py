"""Each text operator against a plain version or the library it stands for, with nulls, empties, repeats and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from driftjobs.llm import queries
from driftjobs.llm.audio import BANDS, DOWN, FFT, FRAME, HOP, OFF_DB, ON_DB, RATE, TAPS, UP, _phases, active_spans, audio_features, from_wav, log_mel, padded, resample, tensors
from driftjobs.llm.common import attach, written
from driftjobs.llm.components import connected_components
from driftjobs.llm.language import document_evidence, identify_languages, label_languages, letter_model, page_evidence
from driftjobs.llm.mixing import mix_sources, poisson_steps, steps_below
from driftjobs.llm.passages import strip_passages, words_of
from driftjobs.llm.pieces import PieceModel, marked_words, model_bytes
from driftjobs.llm.secrets import redact, scan, scan_secrets
from driftjobs.llm.sentence_pieces import WordEncoder, decoded, encode_pieces
from driftjobs.llm.simhash import drop_simhash_copies, simhash, simhash_groups
from driftjobs.llm.token_counts import token_counts
from driftjobs.llm.toxicity import BUCKETS, TagModel, chain_chances, chains_of, document_stats, features, marginals, score_toxicity, train
from driftjobs.llm.vectors import SmallWorld, link_vectors
from tests_plain import groups_of, plain_simhash

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  \n\t ", "a", "a a", "▁▁ mark", "日本 😀 é\x00", "<s> </s> <unk>", " " * 300 + "x", "ab" * 700, "=-" * 300, "the" * 900, "a  b   c    d", "The cat. The cat.", "The cat. The cat."]


def random_texts(n, seed=1, alphabet="ab ▁t h\n\té日😀<s>019  AAAzz", most=80):
    draw = random.Random(seed)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randrange(most))) for _ in range(n)]


def test_tokens_and_pieces_equal_the_library(spark, docs_of):
    texts = ODD + random_texts(400)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = docs_of(*texts)
    counted = {r.doc_id: r for r in token_counts(df, MODEL, limit=5).collect()}
    encoded = {r.doc_id: r for r in encode_pieces(df, MODEL).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert counted[i].n_tokens == len(ids) and counted[i].over_limit == (len(ids) > 5) and counted[i].n_bytes == len((t or "").encode())
        assert list(encoded[i].piece_ids) == ids and encoded[i].n_pieces == len(ids)
        assert encoded[i].decoded == (t or "").replace("▁", " ")
    back = encode_pieces(df, MODEL).select("doc_id", decoded(df, F.col("piece_ids"), MODEL).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert token_counts(df.limit(0), MODEL).count() == 0 and encode_pieces(df.limit(0), MODEL).count() == 0


def test_unigram_paths_are_the_best(tmp_path):
    """On a unigram model put together by hand: the sum of scores of every word is the greatest there is."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model_bytes(MODEL))
    draw = random.Random(4)
    pieces = [(p.piece, p.type) for p in proto.pieces[:400] if p.type != 1] + [(s, 1) for s in dict.fromkeys(["▁", *"abc", *("".join(draw.choice("abc▁"[: 3 if k else 4]) for k in range(draw.randint(1, 4))) for _ in range(60))]) if "▁" not in s[1:]]
    del proto.pieces[:]
    for piece, kind in pieces:
        proto.pieces.add(piece=piece, score=-draw.random() * 9 if kind == 1 else 0.0, type=kind)
    proto.trainer_spec.model_type = 1
    model = PieceModel(proto.SerializeToString())
    score = {p: model.scores[i] for p, i in model.ids.items()}
    words = sorted({w for t in random_texts(200, 5, "abc abc ", 14) for w in marked_words(t)})
    flat, counts = WordEncoder(model, merges=False).encode(words)
    ids = iter(flat.tolist())
    for word, n in zip(words, counts.tolist(), strict=True):
        text, own = word.replace(" ", "▁"), [model.pieces[next(ids)] for _ in range(n)]
        best = [0.0] + [-1e9] * len(text)
        for end in range(1, len(text) + 1):
            best[end] = max(best[s] + score.get(text[s:end], -1e9) for s in range(end))
        assert "".join(own) == text and sum(score[p] for p in own) == pytest.approx(best[-1])


def test_language(spark, sf, docs_of):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = {"labelled": docs, "labelled_text": F.col("text"), "labelled_language": F.col("lang")}
    rows = identify_languages(docs, **document_evidence(), **labelled).collect()
    assert np.mean([r.language == r.lang for r in rows]) > 0.95 and all(r.accepted for r in rows)
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("path_lang", F.regexp_extract("url", "/(en|de|fr|es)/", 1))
    assert all(r.language == r.path_lang for r in identify_languages(pages, **page_evidence(), **labelled).collect())
    odd = spark.createDataFrame([(1, None, "de", None, 0), (2, "", None, "s", 0), (3, "中文没有字母表" * 9, "en", "s", 0), (3, "the of and to in " * 9, "xx", None, 0), (4, "12 34 !!", "fr", "s", 0)], docs.schema.names)
    got = identify_languages(odd, **document_evidence(), **labelled).collect()
    assert sorted((r.doc_id, r.accepted) for r in got) == [(1, False), (2, False), (3, False), (3, True), (4, False)]
    assert {r.language for r in got if r.accepted} == {"en"} and next(r for r in got if r.doc_id == 1).language == "de"
    assert identify_languages(odd.limit(0), **document_evidence(), **labelled).count() == 0
    assert identify_languages(odd, **document_evidence(), labelled=docs.limit(0), labelled_text=F.col("text"), labelled_language=F.col("lang")).count() == 5


def test_language_by_hand(spark):
    """The posterior of every row against plain loops: likelihood, declaration, suffix and host, each of which moves some row."""
    draw = random.Random(8)
    words = {"aa": ["bana", "nabu", "sola"], "bb": ["krik", "trek", "ikke"], "cc-X": ["ouze", "zuoe", "eozu"]}
    known = [(" ".join(draw.choice(w) for _ in range(40)), k) for k, w in words.items() for _ in range(9)] + [("x", None), (None, "aa"), ("y", " ")]
    labelled = spark.createDataFrame(known, "t string, l string")
    rows = []
    for i in range(60):
        lang = draw.choice(list(words))
        text = draw.choice([" ".join(draw.choice(words[lang]) for _ in range(draw.choice([1, 2, 9]))), "bana krik", "", None, "123"])
        rows.append((i, text, draw.choice(["aa", "BB-y", "cc", "zz", "", None]), draw.choice([f"h{lang}", "h", None]), draw.choice([lang, "s", None]), "mine", "too"))
    rows += [rows[0], (60, "sola nabu " * 40_000, None, None, None, "mine", "too")]
    docs = spark.createDataFrame(rows, "id int, t string, d string, h string, s string, log_prior string, language string")
    got = {r.id: r for r in identify_languages(docs, F.col("t"), F.col("d"), F.col("h"), F.col("s"), labelled, F.col("t"), F.col("l")).collect()}
    names = sorted(words)
    model = letter_model(labelled, F.col("t"), F.col("l"), names).astype(float)

    def fit(text):
        data = (" " + re.sub(r"[^a-z]+", " ", (text or "").lower()).strip() + " ").replace("  ", " ").encode()
        grams = [int(np.uint32((data[k] << 16 | data[k + 1] << 8 | data[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 16) for k in range(len(data) - 2)] if len(data) > 2 else []
        return [sum(model[g, k] for g in grams) / len(grams) for k in range(3)] if grams else None, len(grams)

    fits = [fit(r[1]) for r in rows]
    best = [None if f is None else int(np.argmax(f)) for f, _ in fits]
    moved = Counter()
    for n, (i, _, d, h, s, *_) in enumerate(rows):
        def posterior(use):
            logs = np.zeros(3)
            if "text" in use and fits[n][0]:
                logs += np.array(fits[n][0]) * min(fits[n][1], 60)
            said = (d or "").lower().split("-")[0]
            if "declared" in use and said in ("aa", "bb", "cc"):
                logs += np.log([0.85 if x.lower().split("-")[0] == said else 0.075 for x in names])
            share = np.full(3, 1 / 3)
            for level in ("all", "suffix", "host"):
                others = [best[m] for m, r in enumerate(rows) if m != n and best[m] is not None and (level == "all" or r[4] == s and (level == "suffix" or r[3] == h))]
                count = np.bincount(others, minlength=3) if level in use or level == "all" else np.zeros(3)
                share = (count + 20 * share) / (count.sum() + 20)
            logs += np.log(share)
            p = np.exp(logs - logs.max())
            return p / p.sum()

        whole = posterior({"text", "declared", "suffix", "host"})
        assert got[i].language == names[int(np.argmax(whole))] and got[i].posterior == pytest.approx(whole.max(), rel=1e-4), i
        assert got[i].log_prior == "mine"
        for part in ("declared", "suffix", "host"):
            moved[part] += abs(posterior({"text", "declared", "suffix", "host"} - {part})[int(np.argmax(whole))] - whole.max()) > 1e-3
    assert min(moved.values()) > 3 and got[60].accepted and got[60].language == "aa"
    with pytest.raises(ValueError, match="more than 2 languages"):
        label_languages(labelled, F.col("l"), 2)


def vectors_with_groups(seed=2, n=400, dim=16):
    draw = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x)
    rows = [unit(draw.standard_normal(dim)) for _ in range(n)]
    for size in (5, 60, 150):  # groups of near copies, chains among them
        x = unit(draw.standard_normal(dim))
        for _ in range(size):
            rows.append(unit(x + draw.standard_normal(dim) * draw.choice([0.01, 0.05, 0.08])))
    rows += [rows[3]] * 40 + [rows[3] * 2.5]
    return [(int(i), [float(np.float32(v)) for v in r]) for i, r in zip(draw.permutation(len(rows)), rows, strict=True)]


def test_vectors(spark):
    rows = vectors_with_groups()
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [None] * 16), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (None, rows[7][1]), (n + 7, rows[9][1]), (n + 7, rows[9][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, id int")
    fine = [(k, i, np.float64(np.float32(v))) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for a, b in itertools.combinations(fine, 2) if len(a[2]) == len(b[2]) and a[2] @ b[2] / (np.linalg.norm(a[2]) * np.linalg.norm(b[2])) >= 0.95]
    count = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    group = groups_of(range(len(rows)), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    expected = sorted(((i, int(count[k]), least.get(group[k]), i is not None and i == least.get(group[k])) for k, (i, _) in enumerate(rows)), key=repr)
    found = link_vectors(df).collect()
    assert sorted(((r.id, r.n_links, r.component_id, r.kept) for r in found), key=repr) == expected
    assert min(r.recall for r in found if r.recall is not None) >= 0.999
    assert link_vectors(df.limit(0)).count() == 0


def test_graph_recall():
    unit = np.array([v for _, v in vectors_with_groups(5, 3000)], np.float32)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.unique(unit, axis=0)
    graph = SmallWorld.load(unit, SmallWorld(unit).dump())
    near = unit @ unit.T
    found = {(a, b) for q, c in graph.within(unit, 0.95, graph_beam(unit)) for a, b in zip(q.tolist(), c.tolist(), strict=True)}
    truth = set(zip(*[x.tolist() for x in np.nonzero(near >= 0.95)], strict=True))
    assert len(truth & found) >= 0.999 * len(truth)
    ids, _ = graph.search(unit[::50], 64)
    best = np.argsort(-near[::50], axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:40])) / 10 for a, b in zip(best.tolist(), ids.tolist(), strict=True)]) >= 0.9


def graph_beam(unit):
    return SmallWorld(unit).audited_beam(0.95)[0]


def test_mixing(spark, sf):
    rates = spark.createDataFrame([("a", 0.01), ("b", 2.5), (None, 900.0), ("d", 1e6), ("e", 0.0)], "source string, rate double")
    steps = {r.source: r for r in poisson_steps(rates).collect()}
    assert set(steps) == {"a", "b", None, "d"} and steps["b"].steps[:2] == pytest.approx([np.exp(-2.5), 3.5 * np.exp(-2.5)])
    assert all(s.steps[-1] == pytest.approx(1.0, abs=1e-8) and s.steps == sorted(s.steps) and (s.first == 0 or s.steps[0] < 1e-16) for s in steps.values())
    assert steps["d"].steps[10**6 - steps["d"].first] == pytest.approx(0.5, abs=1e-3) and len(steps["d"].steps) < 21_000
    for list_ in ([0.1], [0.1, 0.2, 0.9], [i / 100 for i in range(100)]):
        found = spark.createDataFrame([(u,) for u in (0.0, 0.05, 0.1, 0.15, 0.9, 0.95, 2.0)], "u double").select("u", steps_below(F.lit(list_), F.col("u")).alias("n"))
        assert all(r.n == sum(x < r.u for x in list_) for r in found.collect())
    many = spark.createDataFrame([(1, "x", "few"), (2, "y" * 10**6, "much")], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mix_sources(many, total=4e5).groupBy("source").count().collect()}
    assert abs(n["few"] - 200_000) < 3000 and n.get("much", 0) <= 5
    rows = [(i, "x" * 10, "en", "big" if i < 6000 else "small" if i < 9000 else None, 1) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    sizes = {r.source: (r.n, r.far) for r in mix_sources(df, seed=3).groupBy("source").agg(F.count("*").alias("n"), F.max("copy_no").alias("far")).collect()}
    assert all(abs(n - 10_000 / 3) < 5 * np.sqrt(3333) for n, _ in sizes.values()) and set(sizes) == {"big", "small", None}
    named = mix_sources(df, {"small": 3, "big": 1}, total=40_000).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in named}.keys() == {"small", "big"} and abs(sum(r["count"] for r in named) - 4000) < 400
    assert mix_sources(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, None, "e", 0), (None, "ab", None, "s", 0), (1, "", None, "e", 0), (1, "ab", None, "s", 0), (1, "ab", None, "s", 0)], df.schema)
    assert {r.source for r in mix_sources(odd, total=40.0).collect()} == {"s"}
    a, b = (sorted(r.shuffle_key for r in mix_sources(df.repartition(k)).collect()) for k in (1, 7))
    assert a == b


def plain_strip(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49) if i is not None else ():
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    out = []
    for i, t in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [5, 6])
def test_passages(docs_of, seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(8)]
    base = [draw.choice(words) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, "a " * 500), (3, "a " * 70 + "b"), (None, " ".join(base[:120]))]
    for i in range(60):
        at = draw.randrange(300)
        own = [draw.choice(words) for _ in range(draw.randrange(30))] + base[at : at + draw.randrange(30, 200)]
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = draw.choice(words)
        rows.append((draw.choice([i, i, i, draw.randrange(40)]), " ".join(own * draw.choice([1, 1, 2])).replace(" w1 ", " w1\n")))
    rows.append(rows[-1])
    got = sorted(map(tuple, strip_passages(docs_of(*rows)).collect()), key=repr)
    assert got == plain_strip(rows)
    assert strip_passages(docs_of("x").limit(0)).count() == 0


def test_toxicity(spark, docs_of):
    draw = np.random.default_rng(0)
    emit, lengths, pairs, start = draw.normal(size=(4, 5)), np.array([5, 3, 1, 4]), draw.normal(size=(2, 2)), 0.3
    chance, _ = marginals(emit, lengths, pairs, start)
    for r, n in enumerate(lengths):  # every way to tag the chain
        weights = {}
        for tags in itertools.product((0, 1), repeat=int(n)):
            weights[tags] = np.exp(tags[0] * start + sum(t * e for t, e in zip(tags, emit[r], strict=False)) + sum(pairs[a, b] for a, b in itertools.pairwise(tags)))
        total = sum(weights.values())
        assert [sum(w for t, w in weights.items() if t[k]) / total for k in range(n)] == pytest.approx(chance[r, :n].tolist())
    model = TagModel(draw.normal(size=BUCKETS + 1), pairs, start, np.zeros(5))
    texts = ["One two. Three four five!", "word " * 300, "", None]
    _, alone = document_stats(texts, model, {})
    for text, p in zip(texts, alone, strict=True):
        flat = [w for c in chains_of(text) for w in c]
        assert len(flat) == len(p) and (not flat or 0 < p.min() <= p.max() < 1)
    for size in (1, 95, 96, 97, 192, 500):  # over the pieces of the pass, and in company
        emit = draw.normal(size=size) * 3
        whole = marginals(emit[None, :], np.array([size]), pairs, start)[0][0]
        company = chain_chances(np.r_[emit, emit[:7], emit], np.array([0, size, size + min(7, size)]), np.array([size, min(7, size), size]), model)
        assert company[:size] == pytest.approx(whole, abs=1e-12) and company[-size:] == pytest.approx(whole, abs=1e-12)
    stats, alone = document_stats(["One two. İstanbul nil!", ""], model, {})  # every way to tag the two chains
    chances = []
    for words in (["one", "two"], ["i̇stanbul", "nil"]):
        e = [sum(model.weights[zlib.crc32(f.encode()) % BUCKETS] for f in features(w)) for w in words]
        w = {t: np.exp(t[0] * (start + e[0]) + t[1] * e[1] + pairs[t]) for t in itertools.product((0, 1), repeat=2)}
        chances += [sum(x for t, x in w.items() if t[k]) / sum(w.values()) for k in (0, 1)]
    assert alone[0] == pytest.approx(chances) and stats[0][0] == pytest.approx(max(chances)) and stats[0][1] == pytest.approx(1 - np.prod(1 - np.array(chances)))
    assert stats[0][2] == pytest.approx(np.log1p(sum(chances))) and stats[0][3] == pytest.approx(min(1, 10 * sum(chances) / 4)) and not stats[1].any()
    names = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    rows = [(i, " ".join(draw.choice(names, 30)) + (f" vile{'xyz'[i % 3]} end." if i % 4 == 0 else " end.")) for i in range(400)]
    long = "İ alpha " * 20_000 + "vilex " + "beta " * 20_000  # one sentence
    docs = docs_of(*rows, (500, ""), (501, None), (502, "alpha"), (502, "alpha"), (503, long)).withColumn("score", F.lit("taken"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in score_toxicity(docs, train(docs, labels)).collect()}
    assert all(scored[i].predicted == int(i % 4 == 0) for i in range(300, 400))
    hit = scored[300].toxic_spans[0]
    assert rows[300][1][hit.start : hit.end].startswith("vile") and scored[500].score == scored[501].score and scored[500].predicted == 0
    assert [long[x.start : x.end] for x in scored[503].toxic_spans] == ["vilex"]
    assert score_toxicity(docs, train(docs, labels.limit(0))).count() == 405 and score_toxicity(docs.limit(0), train(docs, labels)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxicity(spark, sf).where("held_out").collect() if r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    right = [(r.predicted, labels[r.doc_id]) for r in rows]
    assert sum(p and y for p, y in right) > 0.8 * sum(y for _, y in right) and sum(p and y for p, y in right) > 0.7 * sum(p for p, _ in right)


SECRETS = [
    ('password = "hunter22" end', [("assign", 0, 20)]), ("PassWd:abc", []), ("token: password: abcdefgh", [("assign", 0, 15)]), ("api_key=abcdef apikey='ghijkl'", [("assign", 0, 14), ("assign", 15, 29)]),
    ("AKIA" + "A" * 16, [("access", 0, 20)]), ("AKIA" + "A" * 15, []), ("x" + "0123456789abcdef01234567" + "g", [("hex", 1, 25)]), ("é secret : " + "f" * 24, [("assign", 2, 35), ("hex", 11, 35)]),
    (None, []), ("", []),
]


def test_secrets(docs_of):
    rows = scan_secrets(docs_of(*[t for t, _ in SECRETS])).orderBy("doc_id").collect()
    assert [[(s.kind, s.start, s.end) for s in r.secret_spans if s.kind in ("assign", "access", "hex")] for r in rows] == [s for _, s in SECRETS]
    assert [r.n_assign for r in rows] == [sum(s[0] == "assign" for s in spans) for _, spans in SECRETS]
    assert scan_secrets(docs_of("x").limit(0)).count() == 0


def test_linked_parts():
    key, host, ident = "aB3xY9kLm2Qw7ZrT5uV8", "10.20.30.40:8080", "AKIAABCDEF12"
    kinds = lambda t: [k for _, k, _ in scan(t, 200)]
    assert kinds(f"only {key} here") == kinds(f"only {host}") == kinds(f"only {ident}") == []
    assert kinds(f"{ident} then {key}") == [3, 4] and kinds(f"{key} at {host}") == [4, 5]
    assert kinds(f"{ident}{' far' * 80} {key}") == [] and kinds(f"{ident} {'w ' * 40} {key} {'w ' * 40} {host}") == [3, 4, 5]
    draw = random.Random(2)
    for _ in range(200):
        text = " ".join(draw.choice([key, host, ident, "word " * draw.randrange(40), "token=abcdef"]) for _ in range(12))
        spans = scan(text, 60)
        every = scan(text, 10**9)
        role = {0: "s", 1: "i", 2: "s", 3: "i", 4: "s", 5: "e"}
        near = lambda a, b: a != b and max(a[0], b[0]) - min(a[2], b[2]) <= 60
        needs = {3: "s", 4: "ie", 5: "s"}
        all_weak = [s for s in every if s[1] > 2]
        if {role[s[1]] for s in every} >= {"s", "i", "e"}:
            assert [s for s in spans if s[1] > 2] == [s for s in all_weak if any(role[o[1]] in needs[s[1]] and near(s, o) for o in every)]


def test_redaction(docs_of):
    rows = redact(docs_of("a password=abcdefgh b", "clean", None)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["a [assign] b", "clean", None]


def test_simhash(spark, docs_of, sf):
    texts = [*ODD, "One TWO three É", "one two three É", "word " * 3000] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert [simhash(t) & (2**64 - 1) for t in texts] == [plain_simhash(t) for t in texts]
    prints = [plain_simhash(t) for t in texts]
    group = groups_of(range(len(texts)), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    df = docs_of(*texts)
    assert {r.id: r.component_id for r in simhash_groups(df).collect()} == group
    kept = drop_simhash_copies(df.union(df.where("doc_id = 3")).union(docs_of((None, "all alone in the world"), (None, "all alone in the world"))))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(group.values())) and kept.where("doc_id is null").count() == 1
    assert simhash_groups(df.limit(0)).count() == 0
    twins = df.where("doc_id in (14, 15)")
    mapped = twins.union(twins).withColumn("fp", F.create_map(F.lit("a"), F.col("doc_id")))
    assert [r.doc_id for r in drop_simhash_copies(mapped).collect()] == [14]


def test_near_fingerprints_meet(spark):
    from driftjobs.llm.simhash import fingerprint_links

    draw = random.Random(1)
    base = [draw.getrandbits(64) for _ in range(30)]
    prints = sorted({x ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(4))) for x in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    found = connected_components(fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long")))
    expected = groups_of({x for pair in links for x in pair}, links)
    assert {r.node: r.component for r in found.collect()} == expected


def test_components(spark):
    draw = random.Random(9)
    links = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(80)] + [(draw.randrange(5000, 5100), draw.randrange(5000, 5100)) for _ in range(70)] + [(7000, 7000), (None, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [p for p in links if None not in p]
    assert found == groups_of({x for p in real for x in p}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_audio(docs_of):
    texts = [*ODD[:8], "x" * 64, "y" * 5000, "z" * 200_000, "y" * 5000]
    rows = audio_features(docs_of(*texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, rows, strict=True):
        data = (text or "").encode()
        assert bytes(r.payload) == padded(text) == from_wav(bytes(r.media)) and len(r.payload) % 64 == 0 and bytes(r.payload).startswith(data) and len(r.payload) > 0
        table = pa.ipc.open_stream(bytes(r.features.tensor)).read_all()
        assert table["log_mel"].type.shape == [16, 24] and table.num_rows == -(-r.features.frames // 16)
        assert all(0 <= s.start < s.end for s in r.features.spans)
    assert rows[9].features == rows[11].features and rows[9].media == rows[11].media
    tone = lambda rate, n: np.sin(2 * np.pi * 500 * np.arange(n) / rate).astype(np.float32)
    assert np.abs(resample(tone(8000, 8000))[100:5900] - tone(6000, 6000)[100:5900]).max() < 0.1
    draw = np.random.default_rng(5)
    samples = draw.normal(size=500).astype(np.float32)
    low = np.zeros(UP * TAPS)  # the taps in order, from those of each phase
    for p in range(UP):
        low[p::UP] = _phases()[p][::-1]
    for n, x in enumerate(resample(samples)):  # direct convolution with the rate raised by UP
        t = n * DOWN + UP * TAPS // 2
        assert x == pytest.approx(sum(samples[s] * low[t - UP * s] for s in range(max(0, (t - UP * TAPS) // UP), min(500, t // UP + 1)) if 0 <= t - UP * s < UP * TAPS), abs=1e-4)
    some, frames = draw.normal(size=900), 1 + -(-(900 - FRAME) // HOP)
    bands, power = log_mel(some.astype(np.float32))
    assert len(bands) == len(power) == frames
    rate, top = RATE * UP / DOWN, 2595 * np.log10(1 + RATE * UP / DOWN / 2 / 700)
    edge = [700 * (10 ** (top * b / (BANDS + 1) / 2595) - 1) for b in range(BANDS + 2)]
    for f in (0, 3, frames - 1):  # a direct Fourier transform and triangles
        part = np.array([(some[f * HOP + i] if f * HOP + i < 900 else 0.0) * (0.5 - 0.5 * np.cos(2 * np.pi * i / (FRAME - 1))) for i in range(FRAME)])
        assert power[f] == pytest.approx(10 * np.log10(np.mean(part**2) + 1e-10), abs=1e-3)
        spectrum = [abs(sum(part[i] * np.exp(-2j * np.pi * k * i / FFT) for i in range(FRAME))) ** 2 for k in range(FFT // 2 + 1)]
        for b in range(BANDS):
            weigh = [max(0, min((k * rate / FFT - edge[b]) / (edge[b + 1] - edge[b]), (edge[b + 2] - k * rate / FFT) / (edge[b + 2] - edge[b + 1]))) for k in range(FFT // 2 + 1)]
            assert bands[f, b] == pytest.approx(np.log(np.dot(weigh, spectrum) + 1e-6), abs=2e-3)
    for _ in range(50):  # spans by walking both ways from each peak
        level = draw.normal(size=40).astype(np.float32) * 5
        near = level - np.median(level)
        inside = set()
        for k in np.flatnonzero(near >= ON_DB).tolist():
            for step in (1, -1):
                at = k
                while 0 <= at < 40 and near[at] > OFF_DB:
                    inside.add(at)
                    at += step
        assert [k for a, b in active_spans(level) for k in range(round(a * rate / HOP), round((b * rate - FRAME) / HOP) + 1)] == sorted(inside)
    whole = tensors(bands)
    values = pa.ipc.open_stream(whole).read_all()["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, BANDS)
    assert np.array_equal(values[:frames], bands) and not values[frames:].any()
    bands, power = log_mel(np.r_[np.zeros(3000), tone(6000, 3000), np.zeros(3000)].astype(np.float32))
    assert np.argmax(power) in range(30, 63) and len(set(np.argmax(bands[35:55], axis=1).tolist())) == 1
    assert audio_features(docs_of("x").limit(0)).count() == 0


def test_attach_beyond_the_broadcast_bound(spark, monkeypatch):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 3}") for i in range(30)], "i int, k string")
    table = written(spark.createDataFrame([(None, 0), ("k1", 1)], "k string, v int"))
    for bound in (100, 0):
        monkeypatch.setattr("driftjobs.llm.common.BROADCAST_VALUES", bound)
        assert {(r.i % 3, r.v) for r in attach(left, table, "k").collect()} == {(0, 0), (1, 1), (2, None)}


def test_queries_cover_their_tables(spark, sf):
    names = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}
    assert names == set(range(1, 14))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    row = queries.op10_audio(spark, sf).orderBy("doc_id").first()
    text = docs.orderBy("doc_id").first().text
    assert row.payload_sha256 == hashlib.sha256(padded(text)).hexdigest() and row.tail_crc32 == zlib.crc32(padded(text)[-64:])
    base = queries.op8_secret_scan(spark, "/root/testdata/sf0.01").where("n_assign > 0").first()
    own = [f"{k}" for k in base.spans.split(",") if k.split(":")[0] in ("assign", "access", "hex")]
    assert base.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
