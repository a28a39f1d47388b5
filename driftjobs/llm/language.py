"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import attach, fine_text, sized_batches, tidy, written

#: Candidates are the languages of the labels. More than so many are an error: the model has BUCKETS numbers for each.
MAX_LANGUAGES, BUCKETS = 200, 1 << 16
#: Labelled texts that fit the letter model, at most (those of the smallest hash); copies of a language are one text.
TRAIN_ROWS = 8000
#: A text counts as at most so many independent trigrams against the other evidence.
EVIDENCE = 60.0
#: Chance that a declared language is right; pseudo-rows of the parent level in host and suffix priors.
DECLARED_RIGHT, PRIOR_ROWS = 0.85, 20.0
#: A row is kept if its best language is at least this likely and fits better than noise over all buckets.
MIN_POSTERIOR, NOISE = 0.5, -float(np.log(BUCKETS))
PIECE_BYTES = 1 << 20
_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)).lower()
_SPACES = re.compile(rb" +")


def _normal(text: str | None) -> bytes:
    """Lower case, runs of other characters than letters as one space."""
    return _SPACES.sub(b" ", b" " + (text or "").lower().encode("utf-8").translate(_LETTERS) + b" ")


def _trigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


def label_languages(labelled: DataFrame, language: F.Column, most: int = MAX_LANGUAGES) -> list[str]:
    """The labels' languages in order; nulls and blanks are none."""
    named = labelled.select(language.alias("language")).where("trim(language) <> ''").distinct().limit(most + 1)
    found = sorted(r["language"] for r in named.collect())
    if len(found) > most:
        raise ValueError(f"the labels name more than {most} languages")
    return found


def letter_model(labelled: DataFrame, text: F.Column, language: F.Column, languages: Sequence[str], train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Log chances ``[bucket, language]`` of hashed byte trigrams, fitted on at most ``train_rows`` distinct labelled texts (and ties).

    Rows of other or no language, and null texts, don't count. The result has BUCKETS rows.
    """
    text = fine_text(text)
    rows = labelled.select(text.alias("text"), language.alias("language"), F.xxhash64(text).alias("h")).where(F.col("language").isin(*languages) & F.col("text").isNotNull())
    bound = rows.select("h", "language").distinct().orderBy("h", "language").limit(train_rows).agg(F.max("h")).first()[0]
    counts = np.full((BUCKETS, len(languages)), 0.5)
    if bound is not None:

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((BUCKETS, len(languages)), dtype=np.int64)
            for batch in batches:
                for t, lang in zip(batch["text"], batch["language"], strict=True):
                    data = _normal(t)
                    if len(data) > 2:
                        total[:, languages.index(lang)] += np.bincount(_trigrams(data), minlength=BUCKETS)
            bucket, at = np.nonzero(total)
            yield pd.DataFrame({"bucket": bucket.astype("int32"), "at": at.astype("int32"), "n": total[bucket, at]})
            tidy()

        found = rows.where(F.col("h") <= bound).dropDuplicates(["h", "language"]).select("text", "language").mapInPandas(count, "bucket int, at int, n long")
        table = found.groupBy("bucket", "at").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
        np.add.at(counts, (table["bucket"], table["at"]), table["n"])
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def text_scores(docs: DataFrame, text: F.Column, model: np.ndarray) -> F.Column:
    """An ``array<double>``: the text's number of trigrams, then its mean log chance a trigram in each language (null if it has none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.ascontiguousarray(shared.value.T)
        for texts in batches:
            rows: list = []
            pending: list[bytes] = []
            size = 0

            def flush() -> None:
                if not pending:
                    return
                lengths = np.array([max(0, len(p) - 2) for p in pending])
                grams = np.concatenate([_trigrams(p) if len(p) > 2 else np.zeros(0, np.int32) for p in pending])
                live = np.flatnonzero(lengths)
                starts = (np.cumsum(lengths) - lengths)[live]
                means = np.zeros((len(live), len(table)))
                for k, own in enumerate(table):
                    if len(live):
                        means[:, k] = np.add.reduceat(own[grams].astype(np.float64), starts) / lengths[live]
                out: list = [[0.0]] * len(pending)
                for r, i in enumerate(live.tolist()):
                    out[i] = [float(lengths[i]), *means[r].tolist()]
                rows.extend(out)
                pending.clear()

            for t in texts:
                pending.append(_normal(t.as_py()))
                size += len(pending[-1])
                if size > PIECE_BYTES:
                    flush()
                    size = 0
            flush()
            yield pa.array(rows, pa.list_(pa.float64()))
        tidy()

    return score(fine_text(text))


def host_counts(judged: DataFrame, n_languages: int) -> DataFrame:
    """Judgements by ``(host, suffix)``: ``n``, and ``m`` of its suffix and ``g`` of all rows, each an array by language.

    ``judged`` has host, suffix and ``best``, the place of the text's own best language; rows without one don't
    count. All levels are grouped counts with partial sums.
    """
    each = range(n_languages)
    array = lambda name: F.array(*[F.coalesce(F.col(f"{name}{k}"), F.lit(0)).cast("double") for k in each])
    own = [F.sum(F.when(F.col("best") == k, 1).otherwise(0)).alias(f"n{k}") for k in each]
    hosts = written(judged.groupBy("host", "suffix").agg(*own))
    everything = hosts.agg(*[F.sum(f"n{k}").alias(f"g{k}") for k in each]).select(array("g").alias("g"))  # one row
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(f"n{k}").alias(f"m{k}") for k in each])
    suffixes = written(suffixes.select(F.col("suffix").alias("__suffix"), array("m").alias("m")).join(F.broadcast(everything)))
    named = attach(hosts.withColumn("__suffix", F.col("suffix")), suffixes, "__suffix", 2 * n_languages)
    return named.select("host", "suffix", array("n").alias("n"), "m", "g")


def smoothed_priors(best: F.Column, counts: Sequence[F.Column], n_languages: int) -> F.Column:
    """Shares of languages among the other rows of the host: towards its suffix's, those towards all rows', and those towards equal shares.

    ``counts`` are those of all rows, the suffix and the host; the row's own judgement is taken out of each.
    """
    shares = F.array(*[F.lit(1.0 / n_languages)] * n_languages)
    for level in counts:
        shares = _towards(F.transform(level, lambda n, k: F.when(k == best, n - 1).otherwise(n)), shares)
    return shares


def _towards(counts: F.Column, parent: F.Column) -> F.Column:
    total = F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + n)
    return F.zip_with(counts, parent, lambda n, p: (n + PRIOR_ROWS * p) / (total + PRIOR_ROWS))


def identify_languages(
    docs: DataFrame,
    text: F.Column,
    declared: F.Column,
    host: F.Column,
    suffix: F.Column,
    labelled: DataFrame,
    labelled_text: F.Column,
    labelled_language: F.Column,
    languages: Sequence[str] | None = None,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``docs`` with ``language``, ``posterior`` and ``accepted``, which replace columns of those names.

    Candidates are ``languages`` or, without them, all that the labels name. The posterior multiplies the
    likelihood of the text (as EVIDENCE trigrams at most), of the declared language, and the prior of the
    host, which is made of its other rows. What is declared counts by its first part; null or unknown
    declarations say nothing. Null hosts and suffixes are groups of their own. A text without letters is
    judged by the rest and rejected; so are a best language under MIN_POSTERIOR and texts that fit no
    language better than noise. Ties go to the first language. Without labels nothing is accepted and the
    language is null. Texts are whole, whatever their length. Repeated rows stay; an empty table stays
    empty; bytes that aren't UTF-8 count as U+FFFD. Rows are written once with their scores, and the table of hosts comes to them; only where it is
    beyond the bound of a broadcast do rows move.
    """
    sized_batches(docs)
    languages = label_languages(labelled, labelled_language) if languages is None else list(languages)
    if not languages:
        return docs.withColumns({"language": F.lit(None).cast("string"), "posterior": F.lit(None).cast("double"), "accepted": F.lit(False)})
    model = letter_model(labelled, labelled_text, labelled_language, languages, train_rows)
    said = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1))
    wide = written(docs.withColumns({"__scores": text_scores(docs, text, model), "__host": host, "__suffix": suffix, "__said": said}))
    likely = F.slice("__scores", 2, len(languages))
    best = F.when(F.size("__scores") > 1, F.array_position(likely, F.array_max(likely)).cast("int") - 1)
    judged = wide.where(F.size("__scores") > 1).select(F.col("__host").alias("host"), F.col("__suffix").alias("suffix"), best.alias("best"))
    place = lambda h, s: F.to_json(F.struct(h.alias("h"), s.alias("s")))
    counts = host_counts(judged, len(languages))
    counts = written(counts.select(place(F.col("host"), F.col("suffix")).alias("__place"), *[F.col(c).alias(f"__{c}") for c in "nmg"]))
    placed = attach(wide.withColumn("__place", place(F.col("__host"), F.col("__suffix"))), counts, "__place", 3 * len(languages))
    none = F.array(*[F.lit(0.0)] * len(languages))
    priors = smoothed_priors(F.coalesce(best, F.lit(-1)), [F.coalesce(f"__{c}", none) for c in "gmn"], len(languages))
    parts = F.array(*[F.lit(x.lower().split("-")[0]) for x in languages])
    right, wrong = float(np.log(DECLARED_RIGHT)), float(np.log((1 - DECLARED_RIGHT) / max(1, len(languages) - 1)))
    told = F.transform(parts, lambda x: F.when(~F.array_contains(parts, F.coalesce("__said", F.lit(""))), 0.0).when(x == F.col("__said"), right).otherwise(wrong))
    fits = F.when(F.size("__scores") > 1, F.transform(likely, lambda x: x * F.least(F.element_at("__scores", 1), F.lit(EVIDENCE)))).otherwise(none)
    logs = F.transform(F.arrays_zip(priors.alias("p"), told.alias("d"), fits.alias("f")), lambda x: F.ln(x["p"]) + x["d"] + x["f"])
    fits_best = (F.size("__scores") > 1) & (F.array_max(likely) > NOISE)
    names = F.array(*[F.lit(x) for x in languages])

    def judge(x: F.Column) -> F.Column:
        posterior = 1 / F.aggregate(x["logs"], F.lit(0.0), lambda acc, y: acc + F.exp(y - x["top"]))
        named = F.element_at(names, F.array_position(x["logs"], x["top"]).cast("int"))
        return F.struct(named.alias("language"), posterior.alias("posterior"), (x["fits"] & (posterior >= MIN_POSTERIOR)).alias("accepted"))

    # Lambdas over arrays of one element: each value is made once, also where a filter on the result is pushed down.
    with_top = F.transform(F.array(logs), lambda x: F.struct(x.alias("logs"), F.array_max(x).alias("top"), fits_best.alias("fits")))
    out = placed.withColumn("__judged", F.element_at(F.transform(with_top, judge), 1))
    out = out.withColumns({c: F.col(f"__judged.{c}") for c in ("language", "posterior", "accepted")})
    return out.drop("__scores", "__host", "__suffix", "__said", "__place", "__n", "__m", "__g", "__judged")


MARKUP = r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,3})"
ADDRESS = r"(?i)\bhttps?://[^\s/:\"'<>]*\.([a-z]{2,24})\b"


def document_evidence() -> dict[str, F.Column]:
    """Evidence of the columns of documents: markup in the text says its language, else the lang column; the source is the host."""
    markup = F.regexp_extract("text", MARKUP, 1)
    address = F.lower(F.regexp_extract("text", ADDRESS, 1))
    return {
        "text": F.col("text"),
        "declared": F.when(F.length(markup) > 0, markup).otherwise(F.col("lang")),
        "host": F.col("source"),
        "suffix": F.when(F.length(address) > 0, address),
    }


_OPENS = re.compile(r"<!--|<(script|style)\b|<[^<>]*>", re.IGNORECASE)
_ENDS = {None: re.compile("-->"), "script": re.compile(r"</script\s*>", re.IGNORECASE), "style": re.compile(r"</style\s*>", re.IGNORECASE)}


def bare_text(html: str) -> str:
    """The page with a space for each tag, comment, script and style sheet; what opens and never closes is text.

    One way through the page: an end that isn't found once isn't looked for again, so no markup takes longer than its length.
    """
    out, at, endless = [], 0, set()
    while found := _OPENS.search(html, at):
        kind, stop = found[1] and found[1].lower(), found.end()
        if not html.endswith(">", found.start(), stop):
            end = None if kind in endless else _ENDS[kind].search(html, stop)
            if end is None:
                endless.add(kind)
                tag = re.compile("<[^<>]*>").match(html, found.start())
                stop = tag.end() if tag else stop
                if tag is None:
                    out.append(html[at:stop])
                    at = stop
                    continue
            else:
                stop = end.end()
        out += [html[at : found.start()], " "]
        at = stop
    return "".join([*out, html[at:]])


def page_text(html: F.Column) -> F.Column:
    """The text of raw pages (``bare_text``); null for null."""

    @F.arrow_udf("string")
    def bare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([bare_text(p) if p is not None else None for p in pages.to_pylist()], pa.string())
        tidy()

    return bare(fine_text(html))


def page_evidence() -> dict[str, F.Column]:
    """Evidence of raw pages: text without tags, markup language, host and suffix of the url."""
    bare = page_text(F.col("html"))
    markup = F.regexp_extract("html", MARKUP, 1)
    host = F.lower(F.regexp_extract("url", r"^\w+://(?:[^/@]*@)?([^/:?#]+)", 1))
    suffix = F.regexp_extract(host, r"\.([a-z]{2,24})$", 1)
    return {"text": bare, "declared": F.when(F.length(markup) > 0, markup), "host": F.when(F.length(host) > 0, host), "suffix": F.when(F.length(suffix) > 0, suffix)}
