"""Substring dedup: passages that recur in a later document go, located by sharded automata of recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from driftjobs.llm.common import attach, bucketed, discard, fine_text, sized_batches, tidy, words_of, written

WINDOW, ANCHOR = 50, 16
#: Words of phrases in an automaton (some 80 bytes each), and words of text that stream through one copy of it, on average.
SHARD_WORDS, RANGE_WORDS = 100_000, 400_000
#: An anchor of more phrases is hot: its phrases are dealt by their own words, and windows beside it pass the shard of theirs.
HOT_PHRASES = 400
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ANCHORS = "array<struct<h:bigint,c:bigint,a:int,b:int>>"
WINDOWS = "array<struct<s:int,w1:bigint,w2:bigint,h:bigint>>"


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 4096, 2 * len(have[0]) if have else 0)
        inverse = np.uint64(pow(int(_BASES[which]), -1, 1 << 64))
        have = _powers[which] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASES[which], inverse))
    return have[0][:n], have[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Sums:
    """Hashes of any run of a document's words."""

    def __init__(self, words: list[bytes], which: int = 0):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        up, self.down = _power(which, len(words) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(hashes * up[: len(words)], dtype=np.uint64)]

    def run(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start])


def anchors_of(text: str | None) -> tuple[np.ndarray, ...]:
    """The least-hashed 16-word runs of the text's 50-word windows: their hash, and the windows a..b that have each.

    Equal windows have equal anchors, so windows that recur meet at one. The second hash is of the words that the
    windows a..b cover and of the anchor's place in them: where it is equal, so are all of these windows.
    """
    words = words_of(text)
    n = len(words) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    sums = _Sums(words)
    at = np.arange(len(words) - ANCHOR + 1)
    grams = sums.run(at, at + ANCHOR)
    value, place, span = grams, at, WINDOW - ANCHOR + 1
    size = 1
    while size < span:  # the leftmost least of ever longer stretches
        step = min(size, span - size)
        left, right = slice(0, len(value) - step), slice(step, None)
        nearer = value[left] <= value[right]
        value, place = np.where(nearer, value[left], value[right]), np.where(nearer, place[left], place[right])
        size += step
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[first[1:], n] - 1
    spot = place[first]
    context = sums.run(first, last + WINDOW) ^ _mixed((((last - first) << 8) | (spot - first)).astype(np.uint64))
    return grams[spot].view(np.int64), context.view(np.int64), first.astype(np.int32), last.astype(np.int32)


def windows_of(text: str | None, spans: list[dict]) -> tuple[np.ndarray, ...]:
    """Two hashes of each window that starts in one of the spans a..b, and the anchor h of its span."""
    words = words_of(text)
    starts, place = np.unique(np.concatenate([np.arange(x["a"], x["b"] + 1) for x in spans]), return_index=True)
    anchor = np.concatenate([np.full(x["b"] + 1 - x["a"], x["h"], np.int64) for x in spans])[place]
    return starts.astype(np.int32), *[_Sums(words, k).run(starts, starts + WINDOW).view(np.int64) for k in (0, 1)], anchor


def _lists(rows: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(r[0]) for r in rows])].astype(np.int32)
    columns = [pa.array(np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64)) for k in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, list(names)))


def _anchors(text: F.Column) -> F.Column:
    @F.arrow_udf(ANCHORS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))
        for texts in batches:
            yield _lists([anchors_of(t.as_py()) for t in texts], ("h", "c", "a", "b")).cast(kind)
        tidy()

    return find(text)


def _windows(text: F.Column, spans: F.Column) -> F.Column:
    @F.arrow_udf(WINDOWS)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("h", pa.int64())]))
        for texts, lists in batches:
            rows = [windows_of(t.as_py(), s.as_py()) for t, s in zip(texts, lists, strict=True)]
            yield _lists(rows, ("s", "w1", "w2", "h")).cast(kind)
        tidy()

    return find(text, spans)


def _beside(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have spans (a, b, h), with a list of them. The texts lie by row key already, so only spans move."""
    values = [c for c in spans.columns if c not in ("id", "key")]
    lists = spans.groupBy(F.col("id").alias("sid"), F.col("key").alias("skey")).agg(F.collect_set(F.struct(*values)).alias("spans"))
    return docs.join(lists, (F.col("id") == F.col("sid")) & (F.col("key") == F.col("skey")))


def candidate_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By hashes alone: windows that a row of a smaller id seems to have too, and all places of anchors that several ids have.

    Both are rows ``(id, key, a, b, h)``: the windows that start at words a to b, whose anchor is h. Anchors of one
    id only are done. Where an anchor's context recurs, all its windows do; of the other contexts of a
    recurring anchor, one representative each is told apart window by window.
    """
    anchors = written(docs.where("id is not null").select("id", "key", F.explode(_anchors(F.col("text"))).alias("x")).select("id", "key", "x.*"))
    spread = anchors.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("c").alias("c1"), F.max("c").alias("c2"))
    recurring = written(spread.where("low < high").select(F.col("h").alias("rh"), "low", (F.col("c1") == F.col("c2")).alias("alike")))
    shared = written(anchors.join(recurring, F.col("h") == F.col("rh")).drop("rh"))
    discard(anchors, recurring)
    span = ("id", "key", "a", "b", "h")
    alike = shared.where("alike and low < id").select(*span)
    mixed = shared.where("not alike")
    classes = written(mixed.groupBy("h", "c").agg(F.min("id").alias("first")).select(F.col("h").alias("ch"), F.col("c").alias("cc"), "first"))
    told = written(mixed.join(classes, (F.col("h") == F.col("ch")) & (F.col("c") == F.col("cc"))).select(*span, "first"))
    known = told.where("first < id").select(*span)
    texts = _beside(docs, told.where("first = id"))
    windows = written(texts.select("id", "key", F.explode(_windows(F.col("text"), F.col("spans"))).alias("x")).select("id", "key", "x.*"))
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("earlier"), F.max("id").alias("high")).where("earlier < high")
    first = written(first.select(F.col("w1").alias("f1"), F.col("w2").alias("f2"), "earlier"))
    single = windows.join(first, (F.col("w1") == F.col("f1")) & (F.col("w2") == F.col("f2"))).where("earlier < id")
    found = written(alike.union(known).union(single.select("id", "key", F.col("s").alias("a"), F.col("s").alias("b"), "h")))
    discard(classes, told, windows, first)
    return found, shared.select(*span)


def cover(spans: list[dict]) -> list[tuple[int, int]]:
    """Of windows (start, anchor), enough to cover each run of them: every 50th and the last."""
    at = {s: x["h"] for x in spans for s in range(x["a"], x["b"] + 1)}
    out, begin, previous = [], None, None
    for s in sorted(at):
        if previous is None or s != previous + 1:
            if previous is not None and out[-1][0] != previous:
                out.append((previous, at[previous]))
            begin = s
        if (s - begin) % WINDOW == 0:
            out.append((s, at[s]))
        previous = s
    if previous is not None and out[-1][0] != previous:
        out.append((previous, at[previous]))
    return out


def stretches(spans: list[dict], shards: int) -> list[tuple[int, int, int]]:
    """Stretches of words (shard, first, end) that hold the windows of the spans, by the shard of their anchor; those of a shard don't overlap."""
    out: list[list[int]] = []
    for shard, a, end in sorted((x["h"] % shards, x["a"], x["b"] + WINDOW) for x in spans):
        if out and out[-1][0] == shard and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([shard, a, end])
    return [tuple(x) for x in out]


def window_shard(words: bytes, shards: int, hot_shards: int) -> int:
    """The shard of a window of a hot anchor: by Spark's hash of its words, behind the shards of other anchors."""
    own = xxhash.xxh64_intdigest(words, 42)
    return shards + (own - (own >> 63 << 64)) % hot_shards


def _cut(text: F.Column, spans: F.Column, shards: int = 0, hot_shards: int = 0) -> F.Column:
    """Words of the text, joined by one space, by ``at`` and anchor or shard: covering windows, or with ``shards`` what passes each.

    That is the stretches about a shard's anchors; beside hot anchors each window by itself.
    """
    kind = pa.list_(pa.struct([("of", pa.int64()), ("at", pa.int32()), ("words", pa.string())]))

    def pieces(text: str, spans: list[dict]) -> list[dict]:
        words = words_of(text)
        cuts = stretches([x for x in spans if not x["hot"]], shards) if shards else [(h, s, s + WINDOW) for s, h in cover(spans)]
        out = [{"of": k, "at": a, "words": b" ".join(words[a:end])} for k, a, end in cuts]
        for s in sorted({s for x in spans if shards and x["hot"] for s in range(x["a"], x["b"] + 1)}):
            window = b" ".join(words[s : s + WINDOW])
            out.append({"of": window_shard(window, shards, hot_shards), "at": s, "words": window})
        return out

    @F.arrow_udf("array<struct<of:bigint,at:int,words:string>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            yield pa.array([pieces(t.as_py(), s.as_py()) for t, s in zip(texts, lists, strict=True)], kind)
        tidy()

    return cut(text, spans)


class PhraseAutomaton:
    """Aho-Corasick over words: each distinct word of the phrases is a letter, all other words are one letter more."""

    def __init__(self) -> None:
        self.letters: dict[bytes, str] = {}
        self.phrases: list[int] = []
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)

    def add(self, words: list[bytes], phrase: int) -> None:
        letters = self.letters
        self.trie.add_word("".join([letters.setdefault(w, chr(len(letters) + 2 + 2048 * (len(letters) + 2 >= 0xD800))) for w in words]), len(self.phrases))
        self.phrases.append(phrase)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Every occurrence of a phrase: the phrase, and its first word's place."""
        if self.trie.kind != ahocorasick.AHOCORASICK:
            self.trie.make_automaton()
        text = "".join([self.letters.get(w, "\x01") for w in words])
        return [(self.phrases[k], end - WINDOW + 1) for end, k in self.trie.iter(text)]


HITS = "pid bigint, key bigint, at int"


def _locate(id_type: pa.DataType):
    """Of rows sorted by shard and range: phrases become an automaton, and the stretches that follow them stream through it."""
    schema = pa.schema([("id", id_type), ("pid", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton = None, PhraseAutomaton()
        for batch in batches:
            ids, keys, counts, phrases, places = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("shard", "range", "pid", "id", "key", "at", "words")]
            for shard, part, pid, own, key, at, text in zip(*columns, strict=True):
                if group != (shard, part):
                    group, automaton = (shard, part), PhraseAutomaton()
                if pid is not None:
                    automaton.add(words_of(text), pid)
                elif hits := automaton.find(words_of(text)):
                    ids.append(own)
                    keys.append(key)
                    counts.append(len(hits))
                    phrases += [p for p, _ in hits]
                    places += [at + s for _, s in hits]
            again = pa.array(np.repeat(np.arange(len(ids)), counts))
            own = [pa.array(ids, id_type).take(again), pa.array(phrases, pa.int64()), pa.array(keys, pa.int64()).take(again), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(own, schema=schema)
        del automaton
        tidy()

    return locate


def phrase_hits(docs: DataFrame, found: DataFrame, shared: DataFrame) -> DataFrame:
    """Every place of every confirmed phrase: ``(id, pid, key, at)``, from automata that all rows which can hold a phrase stream through.

    Phrases are the distinct windows that cover the candidates. A phrase and all its occurrences have the
    same least 16-word run, whose hash decides the shard: a row passes each shard that has a phrase with one of
    the row's runs, with the stretch of words about that run, and a row none of whose runs a phrase has passes none.
    A shard has SHARD_WORDS words of phrases on average, and no anchor more than HOT_PHRASES phrases in it: those of a hot
    anchor go to shards of their own by the hash of all their words, and of a row beside it each window (35 at an anchor
    at most) passes the shard of its own words. A shard that many stretches pass is cut into ranges of RANGE_WORDS
    words of text, each of which has a copy of the automaton.
    """
    spark = docs.sparkSession
    cut = _beside(docs, found).select(F.explode(_cut(F.col("text"), F.col("spans"))).alias("x"))
    distinct = cut.select(F.col("x.of").alias("h"), F.col("x.words").alias("words")).distinct()
    phrases = written(distinct.withColumn("pid", F.monotonically_increasing_id()))
    anchors = written(phrases.groupBy(F.col("h").alias("ph")).agg(F.count(F.lit(1)).alias("n")).withColumn("hot", F.col("n") > HOT_PHRASES))
    n_hot, n_cold = anchors.agg(F.sum(F.when(F.col("hot"), F.col("n"))), F.sum(F.when(~F.col("hot"), F.col("n")))).first()
    shards, hot_shards = (max(1, -(-(n or 0) * WINDOW // SHARD_WORDS)) for n in (n_cold, n_hot))
    passing = shared.join(anchors.drop("n"), F.col("h") == F.col("ph")).drop("ph")  # read once, so not written
    texts = _beside(docs, passing).select("id", "key", F.explode(_cut(F.col("text"), F.col("spans"), shards, hot_shards)).alias("x"))
    texts = written(texts.select("id", "key", F.col("x.of").alias("shard"), F.col("x.at").alias("at"), F.col("x.words").alias("words")))
    loads = texts.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("words")) / (RANGE_WORDS * 6.0)).cast("int").alias("ranges"))
    loads = written(loads)
    dealt = attach(texts, loads, "shard", 2).withColumn("range", F.pmod(F.xxhash64("id", "key", "at"), F.col("ranges")).cast("int"))
    hot_anchors = anchors.where("hot").select(F.col("ph").alias("h"), "hot")  # one in HOT_PHRASES phrases at most
    own = F.when(F.col("hot"), shards + F.pmod(F.xxhash64("words"), F.lit(hot_shards))).otherwise(F.pmod("h", F.lit(shards)))
    copies = attach(attach(phrases, hot_anchors, "h", 2).withColumn("shard", own).drop("hot"), loads, "shard", 2).where("ranges is not null")
    copies = copies.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)))
    rows = dealt.drop("ranges").unionByName(copies.select("shard", "range", "pid", "words"), allowMissingColumns=True)
    laid = rows.repartition("shard", "range").sortWithinPartitions("shard", "range", F.col("pid").asc_nulls_last())
    id_type = docs.schema["id"].dataType
    hits = written(laid.mapInArrow(_locate(to_arrow_type(id_type)), f"id {id_type.simpleString()}, {HITS}"))
    discard(phrases, anchors, texts, loads)
    return hits


def _strip(text: str | None, starts: list[int] | None) -> tuple[int, int, str]:
    words = words_of(text)
    if not starts:
        return len(words), 0, b" ".join(words).decode("utf-8")
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, np.array(starts), 1)
    np.add.at(edge, np.array(starts) + WINDOW, -1)
    left = np.cumsum(edge[:-1]) == 0
    kept = [w for w, k in zip(words, left.tolist(), strict=True) if k]
    return len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8")


def _stripped(text: F.Column, starts: F.Column) -> F.Column:
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            rows = [_strip(t.as_py(), s.as_py()) for t, s in zip(texts, lists, strict=True)]
            yield pa.array([dict(zip(("n_words", "n_removed", "kept"), r, strict=True)) for r in rows], kind)
        tidy()

    return strip(text, starts)


def strip_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, n_words, n_removed, kept)``, one for each row of ``docs``: its words without recurring passages.

    Gone is each word in a window of 50 words that also starts in a row of a smaller id, judged on the texts as
    given. Words are runs of other characters than space and 0x09-0x0D; ``kept`` joins them by one space. The
    least id with a passage keeps it; rows of one id don't strip each other. Rows without an id neither lose
    nor cause anything. Bytes that aren't UTF-8 count as U+FFFD. Null and empty texts and those under 50 words lose nothing. Texts are whole, whatever
    their length. Repeated rows stay. An empty table stays empty. Other columns don't enter.

    Hashes only propose phrases. Automata find, word by word, which rows hold a phrase and where; the least id
    of a phrase's hits keeps it, and every other hit removes its words.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), fine_text(text_col).alias("text"))
    plain = bucketed(sized_batches(plain), "id", "key")
    found, shared = candidate_windows(plain)
    hits = phrase_hits(plain, found, shared)
    discard(found, shared)
    least = written(hits.groupBy("pid").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"))
    gone = attach(hits, least, "pid", 2).where("least < id")
    starts = written(gone.groupBy(F.col("id").alias("sid"), F.col("key").alias("skey")).agg(F.collect_set("at").alias("starts")))
    discard(hits, least)
    joined = plain.join(starts, (F.col("id") == F.col("sid")) & (F.col("key") == F.col("skey")), "left")
    return joined.select("id", _stripped(F.col("text"), F.col("starts")).alias("x")).select("id", "x.*")
