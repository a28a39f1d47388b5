"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftjobs.llm.common import discard, fine_text, row_key, sized_batches, spread, text_bytes, tidy, written
from driftjobs.llm.components import connected_components

SEED = 42
BITS = 64
#: Bands of a text's least hashes, and hashes in a band: texts of similarity 0.8 share none once in 2,500 times.
BANDS, BAND_HASHES = 20, 5


def _shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words, in order; of all words where there are fewer."""
    words = text_bytes(text).lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    spans = zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype="<u8", count=n)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 values; no words: 0."""
    return _print_of(_shingle_hashes(text, shingle))


def _print_of(hashes: np.ndarray) -> int:
    n = len(hashes)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprint(text: F.Column, shingle: int = 3) -> F.Column:
    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([simhash(t.as_py(), shingle) for t in texts], pa.int64())
        tidy()

    return of(text)


def _ball(fp: F.Column) -> F.Column:
    """The fingerprint and its one-bit variants."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints ``fp`` at 2 or fewer differing bits, directly or over others.

    Each fingerprint emits the ball of radius 1 around it: itself and its 64 one-bit variants. Two
    fingerprints that differ in at most 2 bits meet at a variant in the middle, and all that meet at a
    variant (65 at most, whatever the data) are within 2 bits of each other. So each is linked to the
    least of those at its variant, which keeps rows linear and loses no connection; the distance of
    every linked pair is verified.
    """
    variants = spread(prints.select("fp"), "fp").select("fp", F.explode(_ball(F.col("fp"))).alias("variant"))
    met = variants.groupBy("variant").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows ``(id, row_key, fp, component_id)``, one for each row of ``docs``.

    ``component_id`` is the smallest id of the rows that 2-bit links reach. Null or empty texts and texts
    of spaces have fingerprint 0 and are linked like any other. Repeated rows have one fingerprint. A null
    id is never the smallest; a group of null ids has a null component. No rows: no rows. Other columns
    only enter ``row_key``. Bytes that aren't UTF-8 count as U+FFFD.
    """
    prints = written(sized_batches(docs).select(F.col(id_col).alias("id"), row_key(docs).alias("row_key"), fingerprint(fine_text(text_col), shingle).alias("fp")))
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("least")))
    links = written(fingerprint_links(distinct))
    groups = connected_components(links)
    named = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = written(named)
    heads = written(named.groupBy("component").agg(F.min("least").alias("component_id")))
    labels = written(named.join(heads, "component").select(F.col("fp").alias("label_fp"), "component", "component_id"))
    discard(links, named, heads, distinct)
    found = prints.join(labels, F.col("fp") == F.col("label_fp"))
    return found.select("id", "row_key", "fp", "component", "component_id")


def drop_simhash_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (nulls last), then of the smallest row key.

    Rows alike in every column are one row. All columns stay as they are.
    """
    groups = written(simhash_groups(docs, id_col, text_col))
    order = F.struct(F.col("id").isNull(), "id", "row_key")
    return _keep_heads(docs, groups, groups.groupBy("component").agg(F.min(order).alias("k")), id_col)


def _keep_heads(docs: DataFrame, rows: DataFrame, heads: DataFrame, id_col: str) -> DataFrame:
    """``docs`` at the ``(id, row_key)`` of ``heads.k``; rows alike in every column are one row."""
    keep = written(heads.select(F.col("k.id").alias("__id"), F.col("k.row_key").alias("__row_key")))
    alike = rows.groupBy("id", "row_key").count().where("count > 1").limit(1).count()
    kept = _rows_at(docs, keep, id_col)
    if alike:
        order = Window.partitionBy(id_col, "__key").orderBy("__key")  # Spark keeps one row of a key before it shuffles
        kept = kept.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")
    return kept.drop("__key")


def _rows_at(docs: DataFrame, keep: DataFrame, id_col: str) -> DataFrame:
    keyed = docs.withColumn("__key", row_key(docs))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__row_key"))
    return keyed.join(keep, on, "left_semi")


def sketch(text: F.Column, shingle: int) -> F.Column:
    """``node`` (hash of the text's words), ``fp`` and ``bands`` (hashes of BAND_HASHES least hashes each; no words: none)."""
    draw = np.random.default_rng(SEED)
    flip, spread = draw.integers(0, 1 << 63, (2, BANDS * BAND_HASHES, 1), dtype=np.uint64)
    spread = spread * np.uint64(2) + np.uint64(1)

    def bands(hashes: np.ndarray) -> list[int]:
        least = np.full(len(flip), np.iinfo(np.uint64).max, dtype="<u8")
        for at in range(0, len(hashes), 8192):
            least = np.minimum(least, ((hashes[at : at + 8192] ^ flip) * spread).min(axis=1))
        return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, -1))] if len(hashes) else []

    @F.arrow_udf("struct<node: long, fp: long, bands: array<long>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for t in texts:
                value = t.as_py()
                hashes = _shingle_hashes(value, shingle)
                node = xxhash.xxh3_64_intdigest(b" ".join(text_bytes(value).lower().split())) - (1 << 63)
                rows.append((node, _print_of(hashes) if len(hashes) else 0, bands(hashes)))
            node, fp, band = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(band, pa.list_(pa.int64()))], ["node", "fp", "bands"])
        tidy()

    return of(text)


def shingle_set(text: F.Column, shingle: int) -> F.Column:
    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.unique(_shingle_hashes(t.as_py(), shingle)).view("<i8") for t in texts], pa.list_(pa.int64()))
        tidy()

    return of(text)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose sets of shingles are similar enough."""
    both = pairs.join(sets.toDF("n1", "s1"), F.col("a") == F.col("n1")).join(sets.toDF("n2", "s2"), F.col("b") == F.col("n2"))
    shared = F.size(F.array_intersect("s1", "s2"))
    return both.where(shared >= similarity * (F.size("s1") + F.size("s2") - shared)).select("a", "b")


def _uncompared(met: DataFrame, groups: DataFrame) -> DataFrame:
    """``(node, component)`` of nodes that meet one of another group, neither being an end of the place; three at a place are all compared."""
    inner = met.where("n > 3 and node <> a and node <> z")
    known = inner.join(groups, F.col("node") == F.col("member"), "left").select("at", "node", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("at").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(F.col("at").alias("mixed"))
    return known.join(mixed, F.col("at") == F.col("mixed"), "left_semi").select("node", "component").distinct()


def _pairs_across(rest: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of different groups, among them all that are similar enough.

    With shingles in one order (those that fewest texts have first), the first that two such texts share stands in the
    first 1 - ``similarity`` of either, and enough are left behind it. A shingle of one group only joins nothing.
    """
    tokens = sets.join(rest, F.col("n") == F.col("node")).select("node", "component", F.size("s").alias("size"), F.explode("s").alias("token"))
    tokens = written(tokens)
    known = tokens.groupBy(F.col("token").alias("t")).agg(F.count(F.lit(1)).alias("held"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    ranked = tokens.join(known, F.col("token") == F.col("t")).withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("held", "token")) - 1)
    first = ranked.where((F.col("nth") <= (1 - similarity) * F.col("size") + 1e-6) & (F.col("lo") < F.col("hi")))
    first = written(first.select("token", "node", "component", "size", (F.col("size") - F.col("nth")).alias("left")))
    discard(tokens)
    x, y = first.alias("x"), first.alias("y")
    enough = F.least("x.left", "y.left") >= similarity / (1 + similarity) * (F.col("x.size") + F.col("y.size")) - 1e-6
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & enough)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group that links of Jaccard >= ``similarity`` over ``shingle``-word runs reach.

    Texts of equal words are one node; bytes that aren't UTF-8 count as U+FFFD, and rows stay as they are. Nodes meet where their SimHash balls of radius 1 do, and, as
    the ball of a near copy of many changed words lies further off, where a band of their least hashes is
    equal. At a place each is compared with the least and the greatest there, so rows stay linear,
    and a link counts only if the similarity of the two sets of shingles is high enough. Those of a
    place that this leaves in several groups and that weren't compared with each other are joined exactly
    (``_pairs_across``), so no link of two that meet is lost. The row of the smallest id (nulls last),
    then of the smallest row key, stays as it is.
    """
    found = sized_batches(docs).select(F.col(id_col).alias("id"), row_key(docs).alias("row_key"), sketch(fine_text(text_col), shingle).alias("s"))
    rows = written(found.select("id", "row_key", "s.node", "s.fp", "s.bands"))
    order = F.struct(F.col("id").isNull(), "id", "row_key")
    nodes = written(rows.groupBy("node").agg(F.min(order).alias("k"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    at = F.concat(F.transform(_ball(F.col("fp")), lambda v: F.xxhash64(v)), "bands")
    placed = spread(nodes.select("node", "fp", "bands"), "node").select("node", F.explode(at).alias("place"))
    ends = placed.groupBy("place").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    met = written(placed.join(ends.withColumnRenamed("place", "at"), F.col("place") == F.col("at")).select("at", "node", "a", "z", "n"))
    ended = met.select("node", F.explode(F.array("a", "z")).alias("end")).where("node <> end")
    pairs = written(ended.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("asked")).distinct()
    heads = written(nodes.join(asked, F.col("node") == F.col("asked"), "left_semi").select(F.col("k.id").alias("__id"), F.col("k.row_key").alias("__row_key")))
    texts = _rows_at(docs.select("*"), heads, id_col).select(fine_text(text_col).alias("t"))
    sets = texts.select(sketch(F.col("t"), shingle)["node"].alias("n"), shingle_set(F.col("t"), shingle).alias("s"))
    sets = written(sets.dropDuplicates(["n"]))
    links = written(_similar(pairs, sets, similarity))
    groups = connected_components(links).withColumnRenamed("node", "member")
    rest = written(_uncompared(met, groups))
    if not rest.isEmpty():
        across = written(_pairs_across(rest, sets, similarity))
        more = written(_similar(across, sets, similarity))
        if not more.isEmpty():
            groups = connected_components(links.union(more)).withColumnRenamed("node", "member")
        discard(across)
    grouped = nodes.join(groups, F.col("node") == F.col("member"), "left").select(F.coalesce("component", "node").alias("component"), "k")
    kept = _keep_heads(docs, rows, grouped.groupBy("component").agg(F.min("k").alias("k")), id_col)
    discard(nodes, met, pairs, heads, sets, links, rest)
    return kept
