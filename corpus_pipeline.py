"""From raw documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftjobs.llm.common import discard, written
from driftjobs.llm.language import document_evidence, identify_languages
from driftjobs.llm.mixing import mix_sources
from driftjobs.llm.secrets import redact
from driftjobs.llm.sentence_pieces import encode_pieces
from driftjobs.llm.simhash import drop_near_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Text bytes of a trie in the last stage: by then executors hold what the stages before have left.
TRIE_BYTES = 8 << 20


# All stages take any documents: extra columns go, repeated rows and ties are handled as each says, texts are whole
# whatever their length, and an empty table stays empty.


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; ``lang`` becomes the language found. Rejected rows go.

    Null and empty texts and texts without letters are rejected. A null ``lang`` declares nothing, a null
    ``source`` is a host like any other. Ties go to the first language by name. Repeated rows stay.
    """
    found = identify_languages(docs, **document_evidence(), labelled=docs, labelled_text=F.col("text"), labelled_language=F.col("lang"))
    return found.where("accepted").withColumn("lang", F.col("language")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: Jaccard 0.8 or more over runs of five words.

    The row of the smallest id stays (nulls last), of one id that of the smallest hash of all columns; of
    rows alike in every column one stays. Null and empty texts are one group.
    """
    return drop_near_copies(docs).select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced by their kind; ``n_chars`` follows the text.

    Null and empty texts and texts without secrets stay as they are, with their ``n_chars``. Repeated rows stay.
    """
    cleaned = redact(docs.withColumn("__before", F.length("text")))
    size = F.when(F.length("text") == F.col("__before"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cleaned.withColumn("n_chars", size).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources at equal weight by bytes, a document as often as its Poisson number says, in random order.

    The null source is a source; a source without bytes of text (null and empty texts) goes. Rows of one id
    repeat alike; rows without an id share one number.
    """
    return mix_sources(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, and whether they decode to its text. Null and empty texts have none. Repeated rows stay."""
    out = encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), trie_bytes=TRIE_BYTES)
    plain = F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return out.select("doc_id", "lang", "source", "n_chars", F.col("n_pieces").cast("long"), "piece_ids", (F.col("decoded") == plain).alias("round_trip"))


STAGES = [
    ("language_id", identify),
    ("simhash_dedup", drop_copies),
    ("secret_scan", remove_secrets),
    ("source_mix", mix),
    ("sentence_pieces", encode),
]

#: SQL can't express SimHash, the secret patterns' spans or piece encoding; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what a stage has read goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        docs = written(found)
        discard(found)
    return STAGES[-1][1](spark, docs, sf_dir)
