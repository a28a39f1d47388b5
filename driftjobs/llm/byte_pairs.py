"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece has one encoding, so one last token; the encoding of a prefix is that of the prefix before its last
token, and that token. A token that ends a prefix is its last one if the last token of what is left goes with it: if merging
the bytes of both gives just these two. The last tokens of all prefixes are kept, so a piece can grow at its end at
the cost of what is added, and an edit changes the prefixes near it only.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftjobs.llm.common import fine_text, parts, sized_batches, tidy
from driftjobs.llm.pieces import model_bytes

#: Distinct words, and distinct matches, whose ids a worker remembers; beyond it the memory starts anew, and results stay the same.
REMEMBERED = 700_000
#: Longer ones are encoded where they stand.
WORD = 256
#: Stands between pieces, for it is no byte.
_GAP = "\u0100"
_NEVER = 1 << 40


class ByteRanks:
    """Tokens by rank, how each is merged, and which two may stand side by side."""

    def __init__(self, model: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, model.splitlines()) if a}
        self.token = {r: t for t, r in self.rank.items()}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a byte has no token; such a vocabulary can't encode every text")
        self.longest = max(map(len, self.rank))
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self._left: dict[int, tuple] = {}
        self._right: dict[int, tuple] = {}
        self._fits: dict[int, bool] = {}
        self.width = max(self.token) + 1
        self.whole = {self.rank[bytes([b])] for b in range(256)}
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) > 1 and self._merge(token, rank):
                self.whole.add(rank)
        self._fits.clear()
        #: Tokens that merging their own bytes gives; no others come out of merging.
        self.merged = {self.token[r]: r for r in self.whole}

    def _merge(self, token: bytes, rank: int) -> bool:
        """Find the two tokens that the last merge of a token's own bytes joins: of lower rank, and side by side until then."""
        for cut in range(1, len(token)):
            a, b = self.rank.get(token[:cut], _NEVER), self.rank.get(token[cut:], _NEVER)
            if a in self.whole and b in self.whole and (a < rank or cut == 1) and (b < rank or cut == len(token) - 1) and self._apart(a, b, rank):
                self.halves[rank] = (a, b)
                return True
        return False

    def _edge(self, token: int, side: int, known: dict[int, tuple]) -> tuple:
        """What stands at a token's left (0) or right (1) end while its bytes are merged: tokens, and at which merge each ends."""
        found = known.get(token)
        if found is None:
            steps, ends, part = [(self.token[token], _NEVER)], token, token
            while part in self.halves:
                ends, part = part, self.halves[part][side]
                steps.append((self.token[part], ends))
            found = known[token] = tuple(reversed(steps))
        return found

    def _apart(self, a: int, b: int, below: int = _NEVER) -> bool:
        """Whether no merge of a rank under ``below`` joins the end of ``a`` with the beginning of ``b`` while both are merged.

        Of equal ranks the leftmost merges first: a merge within ``a`` before one over the border, that before one within ``b``.
        """
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        while True:
            x, x_ends = left[i]
            y, y_ends = right[j]
            over = self.rank.get(x + y, _NEVER)
            if over < below and over < x_ends and over <= y_ends:
                return False
            if x_ends == y_ends == _NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two."""
        pair = a * self.width + b
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            found = self._fits[pair] = self._apart(a, b)
        return found

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Tells the tokens that end at each byte, the longest first."""
        found = ahocorasick.Automaton()
        for token, rank in self.merged.items():
            found.add_word(token.decode("latin-1"), (rank, len(token)))
        found.make_automaton()
        return found

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The encodings of pieces: the last tokens of all their prefixes in one run over all bytes."""
        text = _GAP + _GAP.join([p.decode("latin-1") for p in pieces])
        last, width, known = [-1] * len(text), self.width, self._fits.get  # -1: at a gap
        done = 0
        for end, (token, size) in self.automaton.iter(text):
            if end != done:
                before = last[end - size]
                if before >= 0:
                    fit = known(before * width + token)
                    if not (self.fits(before, token) if fit is None else fit):
                        continue
                last[end], done = token, end
        out, stop, size = [], -1, self.size
        for piece in pieces:
            stop += len(piece) + 1
            at, token, own = stop, last[stop], []
            while token >= 0:
                own.append(token)
                at -= size[token]
                token = last[at]
            own.reverse()
            out.append(own)
        return out


class Prefixes:
    """A piece of bytes with the last token of each of its prefixes."""

    def __init__(self, ranks: ByteRanks, piece: bytes = b""):
        self.ranks, self.piece, self.last = ranks, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Grow at the end. Prefixes that are there stay as they are."""
        at = len(self.piece)
        self.piece += more
        for end in range(at + 1, len(self.piece) + 1):
            self.last.append(self._last(end))

    def _last(self, end: int) -> int:
        ranks, piece, last = self.ranks, self.piece, self.last
        merged, fits = ranks.merged, ranks.fits
        for start in range(max(0, end - ranks.longest), end):
            token = merged.get(piece[start:end])
            if token is not None and (start == 0 or fits(last[start - 1], token)):
                return token
        raise AssertionError("a prefix without a last token")  # bytes always fit

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes from start to end; how many prefixes had to be made anew.

        Prefixes before ``start`` stay. Behind the edit a prefix depends on as many before it as the longest token
        has bytes; as soon as so many in a row are what they were, the rest is too.
        """
        moved = len(new) - (end - start)
        old, tail = self.last, self.last[end:]
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, same, made = old[:start], 0, 0
        for at in range(start + 1, len(self.piece) + 1):
            token = self._last(at)
            self.last.append(token)
            made += 1
            was = at - moved - 1
            same = same + 1 if was >= end and old[was] == token else 0
            if same >= self.ranks.longest:
                self.last.extend(tail[was - end + 1 :])
                break
        return made

    def tokens(self) -> list[int]:
        """The encoding: last tokens from the end back to the beginning."""
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.ranks.token[out[-1]])
        return out[::-1]


def explicit(pattern: str) -> str:
    """The pattern with Unicode's letters, numbers and spaces written out, as the library's engine has them; ``re`` has other ones."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    ranks = {bytes([b]): b for b in range(256)}
    classes = {}
    for name in ("\\p{L}", "\\p{N}", "\\s"):
        if name in pattern.replace("\\S", "\\s"):
            engine = tiktoken.Encoding("class", pat_str=f"{name}+", mergeable_ranks=ranks, special_tokens={})
            own = np.frombuffer(engine.decode(engine.encode_ordinary(every)).encode("utf-32-le"), dtype="<u4")
            cuts = np.flatnonzero(np.diff(own) != 1)
            runs = zip(own[np.r_[0, cuts + 1]].tolist(), own[np.r_[cuts, len(own) - 1]].tolist(), strict=True)
            classes[name] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\[sS]|\[\^?|\])", pattern):
        if part in classes or part == "\\S":
            ranges = classes["\\s" if part == "\\S" else part]
            if part == "\\S" and inside:
                raise ValueError("a class that holds what is no space can't be written out")
            out.append(ranges if inside else f"[{'^' if part == '\\S' else ''}{ranges}]")
        else:
            inside = part.startswith("[") or inside and part != "]"
            out.append(part)
    return "".join(out)


class TextEncoder:
    """Token ids of texts, each match of the pattern by itself.

    With ``words`` a match begins at every space before something that is no white space, as for the public pattern: white space
    before it is matched up to that space, and nothing else reaches over it. So texts are cut there, and ids of words remembered.
    """

    def __init__(self, ranks: bytes, pattern: str, words: bool = True):
        self._model, self._pattern, self._words = ranks, re.compile(pattern), words
        self._known: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    @cached_property
    def ranks(self) -> ByteRanks:
        return ByteRanks(self._model)

    def _resolve(self, words: list[str]) -> list[bytes]:
        """Ids of words, as bytes of 32-bit numbers. A piece that is a token is that token, as in the library."""
        cut = [self._pattern.findall(w) for w in words]
        fresh = list({p for own in cut for p in own}.difference(self._pieces))
        whole = [self.ranks.rank.get(p.encode()) for p in fresh]
        rest = iter(self.ranks.encode([p.encode() for p, w in zip(fresh, whole, strict=True) if w is None]))
        found = {p: np.array(next(rest) if w is None else [w], "<i4").tobytes() for p, w in zip(fresh, whole, strict=True)}
        known = self._pieces
        out = [b"".join([known[p] if p in known else found[p] for p in own]) for own in cut]
        if len(known) > REMEMBERED:
            known.clear()
        known.update((p, ids) for p, ids in found.items() if len(p) <= WORD)
        return out

    def _cut(self, text: str) -> list[str]:
        """The text's words: the first, and the others without the space before them. Without ``words`` the whole text is the first."""
        if not self._words:
            return [text]
        words = text.split(" ")
        if "" in words[1:] or any(w[0].isspace() for w in set(words[1:])):  # white space of another kind, or more of it
            first, *rest = re.split(r" (?=\S)", text)
            return [first, *rest]
        return words

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        cut = [self._cut(t) if t else None for t in texts]
        if len(self._known) > REMEMBERED:
            self._known.clear()
        known, own = self._known, {}
        missing = list(set().union(*[c[1:] for c in cut if c]).difference(known))
        for word, ids in zip(missing, self._resolve([f" {w}" for w in missing]), strict=True):
            (known if len(word) <= WORD else own)[word] = ids
        firsts = iter(self._resolve([c[0] for c in cut if c]))
        if own:
            return [next(firsts) + b"".join([known[w] if w in known else own[w] for w in c[1:]]) if c else b"" for c in cut]
        return [next(firsts) + b"".join(map(known.__getitem__, c[1:])) if c else b"" for c in cut]


_encoders: dict[str, TextEncoder] = {}


def text_encoder(ranks: bytes, pattern: str, words: bool = True) -> TextEncoder:
    """One encoder for all tasks of a worker, with what it remembers."""
    key = hashlib.sha256(b"\0".join((ranks, pattern.encode(), bytes([words])))).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TextEncoder(ranks, pattern, words)
    return _encoders[key]


def token_bytes(ranks: ByteRanks) -> pa.Array:
    """The bytes of every id, null where an id is free."""
    return pa.array([ranks.token.get(i) for i in range(max(ranks.token) + 1)], pa.binary())


def _lists(rows: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)) // 4
    return pa.ListArray.from_arrays(pa.array(np.r_[0, sizes.cumsum()], pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))


def _joined(ids: pa.ListArray, table: pa.Array) -> pa.Array:
    """The bytes of lists of ids; null for a null list, and for one that holds an id without a token."""
    own = ids.flatten()
    known = pc.and_(pc.greater_equal(own, 0), pc.less(own, len(table)))
    tokens = table.take(pc.if_else(known, own, pa.scalar(None, own.type)))
    offsets = pa.array(np.r_[0, pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).cumsum()], pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), pa.scalar(b"", pa.binary()))
    return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.binary()))


def encoded(docs: DataFrame, text_col: str, ranks_path: str, pattern: str, words: bool = True) -> F.Column:
    """A struct of ``ids`` and of the bytes that these decode to (``decoded``)."""
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(ranks_path), explicit(pattern)))

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = text_encoder(*shared.value, words)
        table = token_bytes(encoder.ranks)
        for texts in batches:
            out = []
            for part in parts(texts):
                ids = _lists(encoder.texts(part.to_pylist()))
                out.append(pa.StructArray.from_arrays([ids, _joined(ids, table)], ["ids", "decoded"]))
            yield pa.concat_arrays(out)
        tidy()

    return encode(fine_text(text_col))


def decode_bytes(df: DataFrame, ids: F.Column | str, ranks_path: str) -> F.Column:
    """The bytes of an ``array<int>`` of ids: null for null, and where an id has no token; none for an empty array."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(ranks_path))

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = token_bytes(ByteRanks(model.value))
        for lists in batches:
            yield _joined(lists, table)
        tidy()

    return decode(ids)


def encode_bytes(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", words: bool = True) -> DataFrame:
    """``docs`` with ``token_ids`` of each whole text, ``n_tokens`` and ``decoded`` (bytes), which replace columns of those names.

    For ``words`` see ``TextEncoder``. Special strings in a text are ordinary text.
    A null or empty text has no tokens and decodes to no bytes. Bytes that aren't UTF-8 count as U+FFFD (``fine_text``).
    Repeated rows stay; an empty table stays empty.
    """
    out = sized_batches(docs).withColumn("__encoded", encoded(docs, text_col, ranks_path, pattern, words))
    found = {"token_ids": F.col("__encoded.ids"), "n_tokens": F.size("__encoded.ids").cast("long"), "decoded": F.col("__encoded.decoded")}
    return out.withColumns(found).drop("__encoded")
