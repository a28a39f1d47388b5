"""One query for each text operator, over its whole table, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftjobs.llm.audio import audio_features
from driftjobs.llm.byte_pairs import encode_bytes
from driftjobs.llm.filter_audit import filter_audit
from driftjobs.llm.language import document_evidence, identify_languages, page_evidence
from driftjobs.llm.merkle import hex_of, merkle_proofs, proof_text
from driftjobs.llm.mixing import mix_sources
from driftjobs.llm.passages import strip_passages
from driftjobs.llm.secrets import BASE_KINDS, scan_secrets, spans_text
from driftjobs.llm.sentence_pieces import encode_pieces
from driftjobs.llm.simhash import simhash_groups
from driftjobs.llm.token_counts import token_counts
from driftjobs.llm.toxicity import score_toxicity, train
from driftjobs.llm.vectors import link_vectors

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(PIECES)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_pieces(docs, public_tokenizers.path(PIECES))
    plain = F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", F.col("n_pieces").cast("long"), "piece_ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == plain).alias("round_trip"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their own evidence and pages by theirs: ``lang`` is what is declared, ``source`` the host."""
    docs, pages = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "pages")
    labelled = {"labelled": docs, "labelled_text": F.col("text"), "labelled_language": F.col("lang")}
    evidence = page_evidence()
    found = identify_languages(docs, **document_evidence(), **labelled).withColumn("page_id", F.lit(None).cast(pages.schema["page_id"].dataType))
    paged = identify_languages(pages, **evidence, **labelled).withColumns({"doc_id": F.lit(None).cast(docs.schema["doc_id"].dataType), "lang": evidence["declared"], "source": evidence["host"]})
    columns = ["doc_id", "lang", "source", "language", F.round("posterior", 6).alias("posterior"), "accepted", "page_id"]
    return found.select(*columns, F.lit("documents").alias("table")).unionByName(paged.select(*columns, F.lit("pages").alias("table")))


def op4_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_read(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fine AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), counted AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
), least AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM v JOIN least ON v.vec_id = least.x LEFT JOIN counted ON v.vec_id = counted.x
"""


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "copy_no", "shuffle_key")


OP5_SQL = """
WITH sizes AS (
  SELECT source, CAST(sum(coalesce(strlen(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sizes WHERE size > 0) * (SELECT sum(size) FROM sizes) / size AS rate
  FROM sizes WHERE size > 0
), terms AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, unnest(generate_series(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT))) AS s(k)
), steps AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS below FROM terms
), drawn AS (
  SELECT *, (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u,
    row_number() OVER () AS r
  FROM documents
), counted AS (
  SELECT r, count(*) AS n FROM drawn JOIN steps ON drawn.source IS NOT DISTINCT FROM steps.source AND below < u GROUP BY r
)
SELECT doc_id, text, lang, source, n_chars, CAST(c AS INTEGER) AS copy_no,
  md5('17-order:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || c) AS shuffle_key
FROM drawn JOIN counted USING (r), unnest(generate_series(1, n)) AS s(c)
"""


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_passages(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT r, doc_id, s, md5(array_to_string(list_slice(ws, s, s + 49), ' ')) AS m FROM d, unnest(generate_series(1, len(ws) - 49)) AS t(s)
), firsts AS (
  SELECT m, min(doc_id) AS f FROM starts GROUP BY m
), covered AS (
  SELECT DISTINCT r, s + k AS i FROM starts JOIN firsts USING (m), unnest(generate_series(0, 49)) AS t(k) WHERE f < doc_id
), words AS (
  SELECT r, i, ws[i] AS w FROM d, unnest(generate_series(1, len(ws))) AS t(i)
), left_over AS (
  SELECT r, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (r)
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(docs, _read(spark, sf_dir, "labels").where(fold != 2))
    held_out = F.coalesce(fold == 2, F.lit(False))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.to_json("toxic_spans").alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    return scan_secrets(docs).select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2(spans_text(spans, BASE_KINDS), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length("payload")
    spans = F.array_join(F.transform("features.spans", lambda s: F.concat_ws("-", F.round(s["start"], 3), F.round(s["end"], 3))), ",")
    return audio_features(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.col("features.frames"), spans, F.sha2("features.tensor", 256)).alias("feature"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row by its hash is judged as if ``n_chars`` had grown by one since the manifest was made."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    grown = F.when(tampered, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))
    proofs = merkle_proofs(_read(spark, sf_dir, "documents"), changed={"n_chars": grown})
    return proofs.select("doc_id", *[hex_of(c).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), hex_of("folded_root").alias("folded_root"), "verified")


#: CRC-32 bit by bit, for DuckDB has none.
CRC32 = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, byte:
  list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, byte)), CAST(4294967295 AS BIGINT)), 4294967295)"""
_TOLD = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen(CAST({v} AS VARCHAR)), ':', CAST({v} AS VARCHAR)) END"
_LEAF = lambda n: "sha256(concat(" + ", ".join(map(_TOLD, ("doc_id", "source", "lang", n, "text"))) + "))"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {_LEAF("n_chars")} AS leaf, {_LEAF(f"CASE WHEN {CRC32} % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS now FROM documents
), p AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS part FROM d
), tree(part, level, place, digest, size) AS (
  SELECT part, 0, place, leaf, count(*) OVER (PARTITION BY part) FROM p
  UNION ALL SELECT part, any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2 FROM tree WHERE size > 1 GROUP BY part, place // 2
), subs AS (
  SELECT part, digest FROM tree WHERE size = 1
), top(level, place, digest, size) AS (
  SELECT 0, part, digest, count(*) OVER () FROM subs
  UNION ALL SELECT any_value(level) + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), (any_value(size) + 1) // 2 FROM top WHERE size > 1 GROUP BY place // 2
), nodes AS (
  SELECT part, level, place, digest, size FROM tree UNION ALL SELECT -1, level, place, digest, size FROM top
), fold(r, part, own, level, place, size, digest, siblings) AS (
  SELECT r, part, part, 0, place, count(*) OVER (PARTITION BY part), now, '' FROM p
  UNION ALL
  SELECT f.r, CASE WHEN size > 1 THEN f.part ELSE -1 END, f.own, CASE WHEN f.size > 1 THEN f.level + 1 ELSE 0 END, CASE WHEN f.size > 1 THEN f.place // 2 ELSE f.own END,
    CASE WHEN f.size > 1 THEN (f.size + 1) // 2 ELSE (SELECT count(*) FROM subs) END,
    CASE WHEN f.size = 1 THEN f.digest WHEN n.digest IS NULL THEN sha256(f.digest) WHEN f.place % 2 = 0 THEN sha256(concat(f.digest, n.digest)) ELSE sha256(concat(n.digest, f.digest)) END,
    CASE WHEN f.size = 1 THEN f.siblings ELSE concat(f.siblings, coalesce(n.digest, '')) END
  FROM fold f LEFT JOIN (SELECT part AS n_part, level AS n_level, place AS n_place, digest FROM nodes) n ON n_part = f.part AND n_level = f.level AND n_place = xor(f.place, 1)
  WHERE f.size > 1 OR f.part >= 0
), ends AS (
  SELECT r, digest AS folded_root, siblings FROM fold WHERE part = -1 AND size = 1
)
SELECT p.doc_id, leaf, subs.digest AS subroot, (SELECT digest FROM top WHERE size = 1) AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = (SELECT digest FROM top WHERE size = 1) AS verified
FROM p JOIN subs USING (part) JOIN ends USING (r)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(c, b)
), steps AS (
  SELECT concat(p.c, q.c, r.c, s.c, t.c) AS filter_order, step, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t, generate_series(1, 5) AS g(step) WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31
), o AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM steps
), c AS (
  SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN m & own = 0 AND m & before::BIGINT = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN m & own > 0 AND m & before::BIGINT = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN m & own > 0 AND m & before::BIGINT > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN m = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN m & own > 0 AND m & before::BIGINT = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN m & own > 0 AND m & before::BIGINT = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN m & own > 0 THEN n * 120 // bit_count(m) ELSE 0 END) AS BIGINT) AS shapley
FROM c, o GROUP BY part, filter_order, step
"""


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_bytes(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_sentence_pieces, op3_language_id, op4_vector_links, op5_source_mix, op6_passages, op7_toxicity, op8_secret_scan, op9_simhash, op10_audio, op11_merkle_manifest, op12_filter_audit, op13_byte_pairs)
}
ORACLE_SQL: dict[str, str] = {"op4_vector_links": OP4_SQL, "op5_source_mix": OP5_SQL, "op6_passages": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_filter_audit": OP12_SQL}
