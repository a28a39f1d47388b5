"""Merkle manifest, filter audit and byte-level BPE against plain versions and the library."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from driftjobs.llm import merkle, queries
from driftjobs.llm.byte_pairs import ByteRanks, Prefixes, TextEncoder, decode_bytes, encode_bytes, explicit
from driftjobs.llm.filter_audit import FILTERS, filter_audit
from driftjobs.llm.merkle import hex_of, merkle_proofs, proof_text

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  \n\t ", "a", "a  b   c\n\n  d", "\x1c \x1d x\x85y  z", "it's we'll I'VE 'sa", "日本 😀 é\x00 ՘՘ ११", "<|endoftext|>", " " * 300 + "x", "ab" * 900, "=-" * 300, "the" * 900, "\r\n \r\nx ", "ſ 　　b", "a\n bc", "x" * 70_000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part string, place int, size int, digest string, mask int, decoded string, ids int, path int"


def rows_of(spark, rows):
    """Documents with other columns of names that the operators use themselves."""
    return spark.createDataFrame([(*r, 7, "p", 1, 2, "d", 3, "e", 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as f:
        return ByteRanks(f.read())


def test_bytes_equal_the_library(spark, library):
    draw = random.Random(3)
    some = ["a", "b", "the", "  ", " ", "\n", "\t", "'s", "日", "é", "😀", "0", "12", "\x1c", "\x85", "　", "_", "-", "==", "ing", " in", "\r\n", "AB", "힣", "̀"]
    texts = ODD + ["".join(draw.choice(some) for _ in range(draw.randrange(40))) for _ in range(400)]
    df = rows_of(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    out = encode_bytes(df, RANKS, public_tokenizers.PATTERN).withColumn("again", decode_bytes(df, F.col("token_ids"), RANKS))
    for r in out.collect():
        text = texts[r.doc_id] or ""
        assert list(r.token_ids) == library.encode_ordinary(text) and r.n_tokens == len(r.token_ids)
        assert bytes(r.decoded) == bytes(r.again) == text.encode()
    slow = {r.doc_id: list(r.token_ids) for r in encode_bytes(df, RANKS, public_tokenizers.PATTERN, words=False).collect()}
    assert slow == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert encode_bytes(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    ids = spark.createDataFrame([([],), (None,), ([50_300],), ([1, None],)], "ids array<int>")
    assert [r[0] for r in ids.select(decode_bytes(ids, F.col("ids"), RANKS)).collect()] == [b"", None, None, None]


def test_whole_table_of_bytes(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_byte_pairs(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_bytes_that_are_no_text(spark, library):
    df = spark.sql("SELECT 1 AS doc_id, cast(unhex('61FF62') AS string) AS text UNION ALL SELECT 2, repeat('é ', 400000)")
    got = {r.doc_id: r for r in encode_bytes(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert list(got[1].token_ids) == library.encode_ordinary("a�b") and bytes(got[1].decoded) == "a�b".encode()
    assert list(got[2].token_ids) == library.encode_ordinary("é " * 400_000)


def test_every_token_and_every_prefix(ranks, library):
    tokens = list(ranks.rank)
    assert len(ranks.whole) == len(tokens)
    for token, own in zip(tokens, ranks.encode(tokens), strict=True):
        assert own == [ranks.rank[token]]
    draw = random.Random(5)
    for _ in range(150):
        piece = bytes(draw.choice(b"thein ab\xff\x00\xe6") for _ in range(draw.randrange(1, 200)))
        grown = Prefixes(ranks, piece[: len(piece) // 2])
        grown.append(piece[len(piece) // 2 :])
        assert grown.tokens() == ranks.encode([piece])[0] == library._core_bpe.encode_single_piece(piece)
        a, b = sorted(draw.randrange(len(piece) + 1) for _ in range(2))
        new = bytes(draw.choice(b"theinab") for _ in range(draw.randrange(6)))
        grown.edit(a, b, new)
        whole = Prefixes(ranks, piece[:a] + new + piece[b:])
        assert (grown.piece, grown.last) == (whole.piece, whole.last)


def test_an_edit_changes_what_is_near(ranks):
    piece = Prefixes(ranks, b"thequickbrownfox" * 1000)
    made = piece.edit(7000, 7003, b"x")
    assert made <= ranks.longest + 200 and piece.last == Prefixes(ranks, piece.piece).last


def test_a_token_that_merging_never_gives():
    """``abc`` can't come out of merging, for ``bc`` merges first and ``a`` with it nowhere; alone it is still that token, as in the library."""
    own = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abcd": 258, b"cd": 259, b"xabc": 260}
    text = b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in own.items())
    plain = tiktoken.Encoding("made", pat_str="[a-d]+|[^a-d]+", mergeable_ranks=own, special_tokens={})
    encoder = TextEncoder(text, "[a-d]+|[^a-d]+", words=False)
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abcdx", repeat=n)]
    got = encoder.texts(words)
    assert [list(memoryview(g).cast("i")) for g in got] == [plain.encode_ordinary(w) for w in words]
    assert ByteRanks(text).whole < set(own.values())
    with pytest.raises(ValueError, match="byte"):
        ByteRanks(b"YQ== 0\n")


def test_patterns_written_out():
    written_out = explicit(r" ?\p{L}+|[^\s\p{L}]+|\s+(?!\S)")
    assert "\\p" not in written_out and re.findall(written_out, "aé \x1c  b") == ["aé", "\x1c", " ", " b"]
    with pytest.raises(ValueError, match="space"):
        explicit(r"[\S]")


def H(data):  # noqa: N802
    return hashlib.sha256(data).hexdigest()


def plain_proofs(rows, group, change):
    """(id, leaf, subroot, root, digest of siblings, folded root, verified) by building all trees in lists."""
    leaf = lambda r: H(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][k : k + group]).encode()) for k in range(0, len(out[-1]), group)])
        return out

    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(parts, key=lambda n: (n is not None, (n or "").encode()))
    trees = {n: levels([x[2] for x in sorted(parts[n], key=lambda x: x[:3])]) for n in names}
    top = levels([trees[n][-1][0] for n in names])
    out = []
    for no, n in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(parts[n], key=lambda x: x[:3])):
            siblings, now = [], leaf(change(r))
            for tree, place in ((trees[n], at), (top, no)):
                for level in tree[:-1]:
                    first = place // group * group
                    run = level[first : first + group]
                    before, after = run[: place - first], run[place - first + 1 :]
                    siblings += before + after
                    now = H("".join([*before, now, *after]).encode())
                    place //= group
            out.append((r[0], own, trees[n][-1][0], top[-1][0], H("".join(siblings).encode()), now, now == top[-1][0]))
    return sorted(out, key=repr)


def proofs_of(df, group, changed=None):
    found = merkle_proofs(df, group=group, changed=changed)
    columns = [hex_of(c) for c in ("leaf", "subroot", "root")]
    return sorted((tuple(r) for r in found.select("doc_id", *columns, F.sha2(proof_text(F.col("proof")), 256), hex_of("folded_root"), "verified").collect()), key=repr)


@pytest.mark.parametrize("group", [2, 3])
def test_proofs_equal_plain_trees(spark, group, monkeypatch):
    monkeypatch.setattr(merkle, "TIER", 3)
    draw = random.Random(group)
    rows = [(draw.choice([None, *range(60)]), draw.choice([None, "", "s", "é"]), draw.choice([None, "", "de", "en", "en", "é"]), draw.choice([None, 5, 2**63 - 1]), draw.choice([None, "", "日本", "-", "x" * 100_000])) for _ in range(150)]
    rows += [rows[0]] * 3 + [(1, "s", "alone", 4, "t")]
    df = rows_of(spark, [(r[0], r[4], r[2], r[1], r[3]) for r in rows])
    changed = {"n_chars": F.when(F.col("doc_id") % 7 == 0, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}
    add = lambda n: None if n is None or n == 2**63 - 1 else n + 1
    change = lambda r: (*r[:3], add(r[3]), r[4]) if r[0] is not None and r[0] % 7 == 0 else r
    expected = plain_proofs(rows, group, change)
    assert proofs_of(df, group, changed) == expected
    assert {x[-1] for x in expected} == {True, False}
    one = df.where("lang = 'alone'")
    assert proofs_of(one, group) == plain_proofs([rows[-1]], group, lambda r: r)
    assert merkle_proofs(df.limit(0), group=group).count() == 0


def test_tall_trees(spark):
    """More leaves than a block has, so that proofs go over several tiers."""
    df = spark.range(700).selectExpr("id AS doc_id", "cast(null AS string) AS source", "CASE WHEN id < 600 THEN 'a' ELSE concat('b', id % 40) END AS lang", "id AS n_chars", "cast(id AS string) AS text")
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert proofs_of(df, 2) == plain_proofs(rows, 2, lambda r: r)


def plain_audit(rows, labels):
    good, toxic = ({d for d, *l in labels if l[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, s in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    failed = []
    for d, t, s in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]
        own = {f for f, fails in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), d is not None and d > first[t]), strict=True) if fails}
        failed.append((d, s or "", own))
    out = []
    for part in {s for _, s, _ in failed}:
        mine = [(d, own) for d, s, own in failed if s == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order):
                gone = [(d, own) for d, own in left if f in own]
                redundant = sum(f in own and bool(own & set(order[:step])) for _, own in mine)
                left = [x for x in left if x not in gone]
                shapley[f] += len(gone)
                lines.append((part, "".join(order), step + 1, len(left), len(gone), redundant, sum(own == {f} for _, own in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_equals_applying_every_order(spark):
    draw = random.Random(9)
    words = ["ab", "B", "CD", "é", "#x", "z\x0bz", "aa", "日", "|"]
    texts = [None, "", " \n", *(" ".join(draw.choice(words[: draw.randint(1, 9)]) + str(draw.randrange(k)) * (k > 1) for _ in range(draw.randrange(90))) for k in (1, 1, 3, 90, 90, 400) for _ in range(9))]
    rows = [(draw.choice([None, *range(50)]), draw.choice(texts), draw.choice([None, "", "s", "t"])) for _ in range(160)]
    rows += [rows[5]] * 3 + [(77, "w " * 200_000, "s"), (78, "w" * 300_000, "t")]
    labels = [(d, draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for d in [None, *range(40), *range(10)]]
    df = rows_of(spark, [(d, t, "en", s, 1) for d, t, s in rows])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit(df, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit(df.limit(0), marks).count() == 0
    none = filter_audit(df.where("doc_id = 77"), marks.limit(0)).collect()
    assert len(none) == 600 and {r.good_lost for r in none} == {0} and len(FILTERS) == 5


def test_bytes_that_are_no_text_are_audited(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text, 's' AS source UNION ALL SELECT 2L, cast(unhex('61FE62') AS string), 's'")
    got = filter_audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.where("filter_order = 'EABCD' AND step = 1").first().removed == 0


def test_tampering_as_the_contract_says(spark, sf):
    got = {r.doc_id: r for r in queries.op11_merkle_manifest(spark, sf).collect()}
    assert all(r.verified == (zlib.crc32(str(d).encode()) % 7 != 0) for d, r in got.items()) and len({r.root for r in got.values()}) == 1


def test_whole_tables_of_tokens_pieces_and_sound(spark, sf):
    """op1 and op2 over a whole table against the library, op10 against the bytes that it must store."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = dict(zip(texts, pieces.encode(list(texts.values()), num_threads=1), strict=True))
    counted = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op1_token_counts(spark, sf).collect()}
    assert counted == {d: (len(t.encode()), len(ids[d]), len(ids[d]) > 4096) for d, t in texts.items()}
    encoded = {r.doc_id: (list(r.piece_ids), r.decoded_sha256, r.round_trip) for r in queries.op2_sentence_pieces(spark, sf).collect()}
    assert encoded == {d: (ids[d], H(t.replace("▁", " ").encode()), True) for d, t in texts.items()}
    for r in queries.op10_audio(spark, sf).collect():
        data = texts[r.doc_id].encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), H(payload), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and r.feature
