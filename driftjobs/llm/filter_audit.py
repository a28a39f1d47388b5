"""What filters remove, alone and together: five quality filters over texts, in every order in which they could be applied.

Words are rows: exploded, counted by (document, word), then by document. With the other flags each document fails some
set of filters; a part has one row of 32 counts, one for each such set, and whatever an order removes is a sum of some of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
#: White space between words, besides the space.
_SPACES = "\t\n\x0b\x0c\r"


def word_totals(docs: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``n_words`` and ``n_distinct`` for each value of ``keys`` that has words; null keys are keys.

    Texts move once, to the task of their key; counting by (key, word) and then by key moves nothing more, and
    neither a long text nor a frequent word makes a hot key.
    """
    spaced = F.translate(text, _SPACES, " " * len(_SPACES))
    words = docs.select(*keys, spaced.alias("__text")).repartition(*keys).select(*keys, F.explode(F.split("__text", " ")).alias("word")).where("word <> ''")
    counts = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failed_filters(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask) for each row: bit k of ``mask`` is set if the row fails the filter FILTERS[k].

    A: under 50 words. B: under 65 distinct words in 100 (no words: passes). C: more than 5 capitals A-Z in 100 code points. D: one of
    ``#$%&*|``. E: a row with a smaller id has the same text, byte for byte.

    A null text is the empty text; a null part is the empty one; a null id is neither smaller nor larger than any.
    Rows alike in id and text fail alike, each counted. Bytes that aren't UTF-8 count as U+FFFD, but for E. An empty table has no rows.
    """
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(raw.cast("binary"), 256)).alias("digest"), fine_text(raw).alias("text"))
    capitals = F.length("text") - F.length(F.translate("text", ascii_uppercase, ""))
    flags = written(rows.select("id", "part", "digest", (100 * capitals > 5 * F.length("text")).alias("c"), F.col("text").rlike("[#$%&*|]").alias("d")))
    # Words of rows alike in id and text are counted together: so many times each row's.
    times = flags.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("times"))
    words = word_totals(rows, ["id", "digest"], F.col("text")).withColumnsRenamed({"id": "__id", "digest": "__digest"})
    judged = times.join(words, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "full_outer")
    n, distinct = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_words", "n_distinct"))
    n = F.floor(n / F.col("times"))
    judged = judged.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), (n < 50).alias("a"), (100 * distinct < 65 * n).alias("b"))
    first = flags.groupBy("digest").agg(F.min("id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("digest").alias("__text"), "__first")
    told = flags.join(judged, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    told = told.join(first, F.col("digest") == F.col("__text"), "left").withColumn("e", F.coalesce(F.col("id") > F.col("__first"), F.lit(False)))
    mask = sum((F.when(F.col(c.lower()), F.lit(1 << k)).otherwise(0) for k, c in enumerate(FILTERS)), F.lit(0))
    return told.select("id", "part", mask.alias("mask"))


def set_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a part: ``all``, ``good`` and ``toxic``, arrays of the rows that fail just the set of filters with that number.

    Several labels of an id are one: good or toxic if any of them says so. Rows without labels are neither.
    """
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = failed.join(named, F.col("id") == F.col("__id"), "left")
    kinds = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = rows.groupBy("part").agg(*[F.count_if((F.col("mask") == m) & flag).alias(f"{kind}_{m}") for kind, flag in kinds.items() for m in range(SETS)])
    return counts.select("part", *[F.array(*[F.col(f"{kind}_{m}") for m in range(SETS)]).alias(kind) for kind in kinds])


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters (``filter_order``) and ``step``: what the step's filter does after those before it.

    ``kept`` rows are left after the step, ``removed`` fall at it, ``redundant`` fail its filter but have fallen before,
    ``unique_fails`` fail its filter alone; ``good_lost`` and ``toxic_lost`` are those of the removed with such a label.
    ``shapley`` is what the filter removes in all orders together. Zeros included; rows as ``failed_filters`` takes them.
    """
    counts = set_counts(failed_filters(docs, id_col, text_col, part_col), labels, id_col)
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = counts.withColumn("filter_order", F.explode(orders)).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda letter: F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(FILTERS) for x in (c, 1 << k)]), letter)
    letters = F.split("filter_order", "")
    rows = rows.withColumn("__own", bit(F.element_at(letters, F.col("step"))))
    rows = rows.withColumn("__before", F.aggregate(F.slice(letters, 1, F.col("step") - 1), F.lit(0), lambda all_, x: all_ + bit(x)))
    has = lambda m, which: m.bitwiseAND(F.col(which)) > 0
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))

    def total(kind: str, which, weight=None) -> Column:
        count = lambda m: F.col(kind)[m] * (F.lit(1) if weight is None else weight(m))
        return F.aggregate(F.filter(sets, which), F.lit(0).cast("long"), lambda all_, m: all_ + count(m))

    removed = lambda m: has(m, "__own") & ~has(m, "__before")
    orders_first = lambda m: F.floor(F.lit(factorial(len(FILTERS))) / F.bit_count(m))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: ~has(m, "__own") & ~has(m, "__before")).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: has(m, "__own") & has(m, "__before")).alias("redundant"),
        F.col("all")[F.col("__own")].alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", lambda m: has(m, "__own"), orders_first).alias("shapley"),
    )
