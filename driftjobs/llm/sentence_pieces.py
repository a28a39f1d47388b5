"""SentencePiece encoding by Viterbi over a trie of distinct marked words, and decoding."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, sized_batches, tidy
from driftjobs.llm.pieces import MARK, PieceModel, marked_words, model_bytes

NOTHING = -1
#: Pairs of pieces that a worker remembers; beyond them it starts anew, and results stay the same.
PAIRS_REMEMBERED = 200_000
#: Text bytes whose words go through one trie; less needs less memory and more time, results are the same.
TRIE_BYTES = 16 << 20


class WordEncoder:
    """Best paths through the pieces of marked words.

    A forward score is the best sum of piece scores over the ways to cut a prefix. In a unigram model any
    two pieces may follow each other. In a BPE model (``merges``) two pieces may only do so if merging
    their characters gives back just these two; any cut of which each neighbouring pair passes is what
    the merges give, so one path alone has a finite score, and it is the library's.
    """

    def __init__(self, model: PieceModel, merges: bool = True):
        self.model, self.merges = model, merges
        self.may_follow: dict[tuple, bool] = {}
        self.pieces: dict = {p[:n]: False for p in model.ids for n in range(1, len(p))}  # beginnings of pieces
        self.pieces |= {p: (model.scores[i], i) for p, i in model.ids.items()}
        self.unknown = (min(model.scores) - 10.0, NOTHING)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many each word has; words are distinct and in order."""
        merges, unknown, piece_of, known = self.merges, self.unknown, self.pieces.get, self.may_follow.get
        best: list[tuple] = [(0.0, 0, "", 0)]  # by prefix: forward score, start of the last piece, the piece, its id
        alive: list[list[int]] = [[]]  # by prefix: where those of its endings start that begin a piece
        flat, counts, last = array("i"), [], ""
        for word in words:
            word = word.replace(" ", MARK)
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], alive[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, open_ = None, []
                for start in (*alive[end - 1], end - 1):
                    piece = word[start:end]
                    found = piece_of(piece)
                    if found is not None:
                        open_.append(start)
                    if not found:  # no piece
                        if end - start > 1:
                            continue
                        found = unknown
                    if merges:
                        if top is None:
                            before = best[start]
                            follows = known((before[2], piece))
                            if follows or follows is None and self.follows(before[2], piece):
                                top = (found[0] + before[0], start, piece, found[1])  # the others have no finite score
                    elif top is None or found[0] + best[start][0] > top[0]:
                        top = (found[0] + best[start][0], start, piece, found[1])
                best.append(top)
                alive.append(open_)
            at, path = len(word), []
            while at:
                _, at, piece, i = best[at]
                if i != NOTHING:
                    path.append(i)
                elif self.model.byte_ids:
                    path.extend(self.model.byte_ids[b] for b in reversed(piece.encode("utf-8")))
                else:
                    path.append(self.model.unk)
            path.reverse()
            flat.extend(path)
            counts.append(len(path))
            last = word
        return np.array(flat, dtype=np.int32), np.array(counts, dtype=np.int64)

    def follows(self, left: str, right: str) -> bool:
        if len(self.may_follow) > PAIRS_REMEMBERED:
            self.may_follow.clear()
        found = self.may_follow[left, right] = self._merged(left, right)
        return found

    def _merged(self, left: str, right: str) -> bool:
        """Whether merging best pairs first, leftmost first among equals, ends with ``left`` and ``right``."""
        ids, scores = self.model.ids, self.model.scores
        parts, cut = [*left, *right], len(left)
        while True:
            top, at = None, NOTHING
            for i in range(len(parts) - 1):
                merged = ids.get(parts[i] + parts[i + 1])
                if merged is not None and (top is None or scores[merged] > top):
                    top, at = scores[merged], i
            if at == NOTHING:
                return parts == ([left] if left else []) + [right]
            if left and at + 1 == cut:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            cut -= at < cut


class _Codes(dict):
    """Numbers words as they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(maxsize=2)
def _encoder(model: bytes, merges: bool) -> WordEncoder:
    """One for each worker: what it remembers of pairs serves the worker's next tasks too."""
    return WordEncoder(PieceModel(model), merges)


def _encode_together(held: list[pa.Array], encoder: WordEncoder, table: list[bytes]) -> Iterator[pa.Array]:
    codes = _Codes()
    seen = []
    for texts in held:
        for text in texts:
            own = marked_words(text.as_py() or "")
            seen.append(np.fromiter(map(codes.__getitem__, own), dtype=np.int32, count=len(own)))
    distinct = sorted(codes)
    flat, counts = encoder.encode(distinct)
    place = np.fromiter(map(codes.__getitem__, distinct), dtype=np.int64, count=len(distinct))
    del codes, distinct
    size, first = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
    size[place], first[place] = counts, np.cumsum(counts) - counts
    at = 0
    for texts in held:
        values, ends, back = [], [0], []
        for own in seen[at : at + len(texts)]:
            n = size[own]
            stop = np.cumsum(n)
            ids = flat[np.repeat(first[own] - stop + n, n) + np.arange(stop[-1] if len(n) else 0)]
            values.append(ids)
            ends.append(ends[-1] + len(ids))
            back.append(_text_of(ids, table))
        at += len(texts)
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))
        yield pa.StructArray.from_arrays([ids, pa.array(back, pa.string())], ["piece_ids", "decoded"])


def _text_of(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _piece_bytes(model: PieceModel) -> list[bytes]:
    table = [p.replace(MARK, " ").encode("utf-8") if p in model.ids else b"" for p in model.pieces]
    table[model.unk] = " ⁇ ".encode()
    for byte, i in model.byte_ids.items():
        table[i] = bytes([byte])
    return table


def encoded(docs: DataFrame, text_col: str, model_path: str, merges: bool = True, trie_bytes: int = TRIE_BYTES) -> F.Column:
    """A column of piece ids and the text that they decode to. Null and empty texts have no pieces.

    Words of some ``trie_bytes`` of text share a trie; a task holds these texts and their distinct words, no more.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.arrow_udf("struct<piece_ids:array<int>,decoded:string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(model.value, merges)
        table = _piece_bytes(encoder.model)
        held, size = [], 0
        for texts in batches:
            held.append(texts)
            size += texts.nbytes
            if size > trie_bytes:
                yield from _encode_together(held, encoder, table)
                held, size = [], 0
        yield from _encode_together(held, encoder, table)
        del held
        tidy()

    return encode(fine_text(text_col))


def decoded(docs: DataFrame, ids: F.Column, model_path: str) -> F.Column:
    """The text of an ``array<int>`` of piece ids: byte pieces join to UTF-8, marks become spaces, the first of them goes."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _piece_bytes(PieceModel(model.value))
        for lists in batches:
            yield pa.array([_text_of(x.values.to_numpy(zero_copy_only=False), table) if x.is_valid else None for x in lists], pa.string())
        tidy()

    return decode(ids)


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", merges: bool = True, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with ``piece_ids`` (ids of the whole text), ``n_pieces`` and ``decoded``, which replace columns of those names.

    A null or empty text has no pieces and decodes to the empty text. Decoding gives the text back, but that a
    mark (U+2581) in a text is a space, as in the library, and U+FFFD stands for bytes that aren't UTF-8. Repeated rows stay; an empty table stays empty.
    """
    out = sized_batches(docs).withColumn("__encoded", encoded(docs, text_col, model_path, merges, trie_bytes))
    found = {"piece_ids": F.col("__encoded.piece_ids"), "n_pieces": F.size("__encoded.piece_ids"), "decoded": F.col("__encoded.decoded")}
    return out.withColumns(found).drop("__encoded")
