"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals add up to document scores."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, sized_batches, tidy

#: The model is fitted on at most so many labelled rows of each class (smallest hash of the id first), of texts up to so many bytes.
TRAIN_ROWS, TRAIN_BYTES = 3000, 16_384
#: Hashed weights; words of a sentence that one step of the forward-backward pass takes. What lies before and behind is carried over.
BUCKETS, PIECE = 1 << 18, 96
#: A word of a toxic row is tagged toxic if one of its features is this much likelier in toxic rows, and its spread over
#: the classes this unlikely by chance (natural logarithms).
TAG_LOG_ODDS, TAG_SURPRISE = 2.3, 6.5
THRESHOLD, SPAN_CHANCE = 0.3, 0.5
#: Pieces in a block of the forward-backward pass; words that a task remembers.
BLOCK, REMEMBERED = 2048, 500_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_STOPS = frozenset(".!?\n")


def features(word: str) -> tuple[str, ...]:
    """Of a lower-case word: itself and its beginnings of 3 to 6 letters."""
    return (f"w {word}", *[f"{k} {word[:k]}" for k in (3, 4, 5, 6) if len(word) > k])


def _slots(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8")) % BUCKETS for f in features(word)]


def tokens_of(text: str | None) -> list[str]:
    """Words and stops in order, each in lower case by itself, so that its place in the text is known."""
    found = _TOKEN.findall(text or "")
    return "\0".join(found).lower().split("\0") if found else []


def chains_of(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence."""
    chains: list[list[str]] = [[]]
    for token in tokens_of(text):
        if token in _STOPS:
            chains.append([])
        else:
            chains[-1].append(token)
    return [c for c in chains if c]


@dataclass
class TagModel:
    """Weights of the tag "toxic" against "other": by feature, of tag pairs [before, after], of a chain's start; and how marginals make a score."""

    weights: np.ndarray
    pairs: np.ndarray
    start: float
    rows: np.ndarray  # weights of document statistics, the bias first

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.rows[0] + stats @ self.rows[1:], -30, 30)))


def marginals(emit: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Chances of the tag "toxic" at each place of padded chains ``[chain, place]``, and the summed chances of tag pairs.

    Forward and backward sums are scaled at every step. Places beyond a chain's length hold 0.
    """
    n, width = emit.shape
    psi = np.exp(np.clip(emit, -30, 30))
    move = np.exp(pairs)
    live = np.arange(width)[None, :] < lengths[:, None]
    forward, backward = np.zeros((width, n, 2)), np.ones((width, n, 2))
    now = np.stack([np.ones(n), psi[:, 0] * np.exp(start)], 1)
    forward[0] = now / now.sum(1, keepdims=True)
    for t in range(1, width):
        now = forward[t - 1] @ move
        now[:, 1] *= psi[:, t]
        forward[t] = now / now.sum(1, keepdims=True)
    for t in range(width - 2, -1, -1):
        now = backward[t + 1].copy()
        now[:, 1] *= psi[:, t + 1]
        now = now @ move.T
        now /= now.sum(1, keepdims=True)
        backward[t] = np.where(live[:, t + 1, None], now, 1.0)
    both = forward * backward
    chance = (both[:, :, 1] / both.sum(2)).T * live
    after = backward.copy()
    after[:, :, 1] *= psi.T
    joint = forward[:-1, :, :, None] * move[None, None] * after[1:, :, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return chance, (joint * live.T[1:, :, None, None]).sum((0, 1))


def _padded(chains: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(c) for c in chains])
    slots = np.full((len(chains), int(lengths.max()), 5), BUCKETS, np.int64)
    for i, chain in enumerate(chains):
        for t, word in enumerate(chain):
            own = _slots(word)
            slots[i, t, : len(own)] = own
    return slots, lengths


def _telling(hits: int, misses: int, toxic: int, clean: int) -> bool:
    """Whether a feature in so many toxic and clean rows tells of toxicity."""
    if np.log((hits + 0.5) / (toxic + 1)) - np.log((misses + 0.5) / (clean + 1)) < TAG_LOG_ODDS:
        return False
    n, q = hits + misses, toxic / (toxic + clean)
    surprise = hits * np.log(hits / n / q) + (misses * np.log(misses / n / (1 - q)) if misses else 0.0)
    return surprise >= TAG_SURPRISE


def fit_tags(toxic: list[str], clean: list[str], rounds: int = 4, batch: int = 256) -> TagModel:
    """Tag the words of labelled texts by how their features are spread over the classes, then fit the field to these tags.

    Two thirds of the texts fit the field; the others fit the weights of document statistics.
    """
    cut, cut_clean = -(-2 * len(toxic) // 3), -(-2 * len(clean) // 3)
    rows: list[tuple[list[list[str]], int]] = [(chains_of(t), 1) for t in toxic[:cut]] + [(chains_of(t), 0) for t in clean[:cut_clean]]
    seen = (Counter(), Counter())
    for chains, label in rows:
        seen[label].update({f for c in chains for w in set(c) for f in features(w)})
    marked = {f for f, k in seen[1].items() if _telling(k, seen[0][f], cut, cut_clean)}
    tagged, plain = [], []
    for chains, label in rows:
        for chain in chains:
            tags = [int(label == 1 and not marked.isdisjoint(features(w))) for w in chain]
            (tagged if any(tags) else plain).append((chain, tags))
    draw = np.random.default_rng(3)
    some = draw.permutation(len(plain))[: 6 * len(tagged) + 20_000]
    examples = tagged + [plain[i] for i in some]
    weights, pairs, start = np.zeros(BUCKETS + 1), np.zeros((2, 2)), 0.0
    squares, pair_squares, start_square = np.full(BUCKETS + 1, 1e-6), np.full((2, 2), 1e-6), 1e-6
    order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = [order[a : a + batch] for a in range(0, len(order), batch)]
    ready = [(*_padded([examples[i][0] for i in b]), b) for b in batches]
    for _ in range(rounds):
        for k in draw.permutation(len(ready)):
            slots, lengths, own = ready[k]
            gold = np.zeros(slots.shape[:2])
            for r, i in enumerate(own):
                gold[r, : lengths[r]] = examples[i][1]
            live = np.arange(slots.shape[1])[None, :] < lengths[:, None]
            chance, expected = marginals(weights[slots].sum(2), lengths, pairs, start)
            off = np.where(live, chance - gold, 0.0)
            step = np.bincount(slots.ravel(), np.repeat(off.ravel(), slots.shape[2]), BUCKETS + 1) + 0.01 * weights
            step[BUCKETS] = 0
            touched = np.unique(slots)
            touched = touched[touched < BUCKETS]
            squares[touched] += step[touched] ** 2
            weights[touched] -= 0.3 * step[touched] / np.sqrt(squares[touched])
            both = live[:, 1:]
            before, after = gold[:, :-1].astype(int), gold[:, 1:].astype(int)
            counted = np.bincount((before * 2 + after)[both], minlength=4).reshape(2, 2) if both.size else np.zeros((2, 2))
            grad = expected - counted + 0.01 * pairs
            pair_squares += grad**2
            pairs -= 0.1 * grad / np.sqrt(pair_squares)
            first = float((chance[:, 0] - gold[:, 0]).sum())
            start_square += first**2
            start -= 0.1 * first / np.sqrt(start_square)
    return TagModel(weights, pairs, start, np.zeros(5))


def fit_rows(model: TagModel, toxic: list[str], clean: list[str], share: float) -> TagModel:
    """Logistic weights of document statistics, each class weighed as in all labelled rows (``share`` of them toxic)."""
    texts = toxic[-(-2 * len(toxic) // 3) :] + clean[-(-2 * len(clean) // 3) :]
    n = len(toxic) - -(-2 * len(toxic) // 3)
    label = np.r_[np.ones(n), np.zeros(len(texts) - n)]
    if not 0 < n < len(texts):
        base = np.clip(share, 1e-4, 1 - 1e-4)
        return TagModel(model.weights, model.pairs, model.start, np.r_[np.log(base / (1 - base)), np.zeros(4)])
    stats, _ = document_stats(texts, model, {})
    weigh = np.where(label == 1, share / n, (1 - share) / (len(texts) - n)) * len(texts)
    x = np.c_[np.ones(len(texts)), stats]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.r_[1e-6, np.full(len(w) - 1, 1.0)]
        hessian = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w -= np.linalg.solve(hessian, x.T @ (weigh * (p - label)) + ridge * w)
    return TagModel(model.weights, model.pairs, model.start, w)


def document_stats(texts: list[str | None], model: TagModel, known: dict[str, float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text: the greatest marginal, the chance of any toxic word, the expected number of them (log), and that per word; and all marginals.

    A sentence is one chain, however long; a text's result doesn't depend on its company.
    """
    tokens = [tokens_of(t) for t in texts]
    fresh = sorted(w for w in set().union(*tokens) if w not in known and w not in _STOPS)
    if fresh:
        slots = [_slots(w) for w in fresh]
        first = np.cumsum([0, *map(len, slots[:-1])])
        known.update(zip(fresh, np.add.reduceat(model.weights[np.fromiter((i for s in slots for i in s), np.int64)], first).tolist(), strict=True))
    known.update(dict.fromkeys(_STOPS, float("nan")))
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    emit = np.fromiter((known[w] for own in tokens for w in own), np.float64, int(sizes.sum()))
    word = ~np.isnan(emit)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.flatnonzero(word)
    emit, owner = emit[place], owner[place]
    stats, chance = np.zeros((len(texts), 4)), np.zeros(len(emit))
    if len(emit):
        new = np.r_[True, (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])]  # after a stop or in another text
        start = np.flatnonzero(new)
        chance = chain_chances(emit, start, np.diff(np.r_[start, len(emit)]), model)
        count = np.bincount(owner, minlength=len(texts))
        own = np.flatnonzero(count)
        first = np.r_[0, np.cumsum(count)[:-1]][own]
        total = np.add.reduceat(chance, first)
        none = np.add.reduceat(np.log1p(-np.minimum(chance, 1 - 1e-9)), first)
        stats[own] = np.stack([np.maximum.reduceat(chance, first), 1 - np.exp(none), np.log1p(total), np.minimum(1.0, 10 * total / count[own])], 1)
    else:
        count = np.zeros(len(texts), dtype=np.int64)
    return stats, np.split(chance, np.cumsum(count)[:-1]) if len(texts) else []


def chain_chances(emit: np.ndarray, starts: np.ndarray, lengths: np.ndarray, model: TagModel) -> np.ndarray:
    """Chances of the tag "toxic" at each place of chains that lie one after another, as ``marginals`` has them.

    A chain longer than PIECE is taken in pieces: the product of a piece's transitions carries the forward
    state to the piece after it and the backward state to the one before, so nothing is cut in the model.
    """
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, size = starts[owner] + nth * PIECE, np.minimum(PIECE, lengths[owner] - nth * PIECE)
    enter, leave = np.ones(len(owner)), np.ones(len(owner))  # odds of the state before a piece and behind its last place
    several = np.flatnonzero(pieces[owner] > 1)
    if len(several):
        m = np.ones((4, len(owner)))
        for part in _blocks(several, size):
            m[:, part] = _product(*_laid(emit, start[part], size[part]), nth[part] == 0, model)
        order = several[np.argsort(nth[several], kind="stable")]
        bounds = np.searchsorted(nth[order], np.arange(nth[order[-1]] + 2))
        for k in range(1, len(bounds) - 1):
            own = order[bounds[k] : bounds[k + 1]]
            (oo, ot, to, tt), odds = m[:, own - 1], enter[own - 1]
            enter[own] = (ot + odds * tt) / (oo + odds * to)
        for k in range(len(bounds) - 2, 0, -1):
            own = order[bounds[k] : bounds[k + 1]]
            (oo, ot, to, tt), odds = m[:, own], leave[own]
            leave[own - 1] = (to + tt * odds) / (oo + ot * odds)
    out = np.empty(len(emit))
    for part in _blocks(np.arange(len(owner)), size):
        psi, live, at = _laid(emit, start[part], size[part])
        out[at[live]] = _chances(psi, size[part], nth[part] == 0, enter[part], leave[part], model)[live]
    return out


def _blocks(pieces: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """The pieces, those of like size together."""
    order = pieces[np.argsort(size[pieces], kind="stable")]
    yield from (order[a : a + BLOCK] for a in range(0, len(order), BLOCK))


def _laid(emit: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By place and piece: exponentials of the emissions, which places are live, and where they lie."""
    at = start + np.arange(size.max())[:, None]
    live = at < start + size
    return np.exp(np.clip(np.where(live, emit[np.minimum(at, len(emit) - 1)], 0.0), -30, 30)), live, at


def _product(psi: np.ndarray, live: np.ndarray, at: np.ndarray, first: np.ndarray, model: TagModel) -> tuple[np.ndarray, ...]:
    """The product of each piece's transitions, up to a factor; the first piece of a chain forgets what is before it."""
    (oo, ot), (to, tt) = np.exp(model.pairs)
    begin = np.exp(model.start)
    m = [np.where(first, 1.0, oo), np.where(first, begin, ot) * psi[0], np.where(first, 1.0, to), np.where(first, begin, tt) * psi[0]]
    for t in range(1, len(psi)):
        a, b, c, d = m
        new = [a * oo + b * to, (a * ot + b * tt) * psi[t], c * oo + d * to, (c * ot + d * tt) * psi[t]]
        scale = np.maximum.reduce(new)
        m = [np.where(live[t], x / scale, y) for x, y in zip(new, m, strict=True)]
    return tuple(m)


def _chances(psi: np.ndarray, size: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray, model: TagModel) -> np.ndarray:
    """Chances as odds, so that a step is a few products over all pieces."""
    (oo, ot), (to, tt) = np.exp(model.pairs)
    ahead = np.empty_like(psi)
    ahead[0] = psi[0] * np.where(first, np.exp(model.start), (ot + enter * tt) / (oo + enter * to))
    for t in range(1, len(psi)):
        ahead[t] = psi[t] * (ot + ahead[t - 1] * tt) / (oo + ahead[t - 1] * to)
    behind = np.empty_like(psi)
    behind[-1] = leave
    for t in range(len(psi) - 2, -1, -1):
        odds = psi[t + 1] * behind[t + 1]
        behind[t] = np.where(size > t + 1, (to + tt * odds) / (oo + ot * odds), leave)
    odds = ahead * behind
    return odds / (1 + odds)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> TagModel:
    """Fit on at most ``train_rows`` labelled rows of each class; the share of toxic rows is counted over all labels given.

    Null labels and ids don't count; an id with several labels is toxic if one is. No labels: every score is 0
    before rounding up by a share of 0.0001; labels of one class: every score is that class's clipped share.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    counts = {r["__toxic"]: r["n"] for r in rows.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= TRAIN_BYTES)).select(F.col(id_col).alias("__own"), fine_text(text_col).alias("__text"))
    texts: dict[int, list[str]] = {}
    for label in (1, 0):
        chosen = rows.where(F.col("__toxic") == label).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
        picked = short.join(F.broadcast(chosen), F.col("__own") == F.col("__id"), "left_semi")  # bounded by train_rows
        found = picked.orderBy(F.xxhash64("__own"), "__own", F.xxhash64("__text")).limit(train_rows).select("__text").collect()
        texts[label] = [r[0] for r in found]
    total = counts.get(0, 0) + counts.get(1, 0)
    share = counts.get(1, 0) / total if total else 0.0
    toxic, clean = texts[1], texts[0]
    blank = TagModel(np.zeros(BUCKETS + 1), np.zeros((2, 2)), 0.0, np.zeros(5))
    model = fit_tags(toxic, clean) if toxic and clean else blank
    return fit_rows(model, toxic, clean, share)


def _spans(text: str, chances: np.ndarray) -> list[dict]:
    words = (m for m in _TOKEN.finditer(text) if m.group() not in _STOPS)
    return [{"start": m.start(), "end": m.end(), "chance": p} for m, p in zip(words, chances.tolist(), strict=True) if p >= SPAN_CHANCE]


def score_toxicity(docs: DataFrame, model: TagModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``toxic_spans``, which replace columns of those names.

    Only the text enters. Scores are between 0 and 1; ``predicted`` is 1 from THRESHOLD on. Spans are words
    (code points, end exclusive) whose marginal is SPAN_CHANCE or more. Null and empty texts get the score of
    a text without toxic words. Texts and sentences are whole, whatever their length. Repeated rows stay; an
    empty table stays empty. Bytes that aren't UTF-8 count as U+FFFD. The model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())])
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(span))])

    @F.arrow_udf("struct<score:double,spans:array<struct<start:int,end:int,chance:double>>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, float] = {}
        for column in batches:
            rows: list = []
            for a in range(0, len(column), 512):
                if len(known) > REMEMBERED:
                    known.clear()
                texts = column.slice(a, 512).to_pylist()
                stats, chances = document_stats(texts, shared.value, known)
                for t, s, p in zip(texts, shared.value.score(stats).tolist(), chances, strict=True):
                    rows.append({"score": s, "spans": _spans(t, p) if len(p) and p.max() >= SPAN_CHANCE else []})
            yield pa.array(rows, kind)
        known.clear()
        tidy()

    judged = sized_batches(docs).withColumn("__judged", score(fine_text(text_col)))
    out = judged.withColumns({"score": F.col("__judged.score"), "toxic_spans": F.col("__judged.spans")}).drop("__judged")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
