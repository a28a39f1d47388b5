"""What a SentencePiece model file holds, and how it marks the words of a text."""

from __future__ import annotations

import re

import sentencepiece

MARK = "▁"
_WORD = re.compile(r" +[^ ]*")


class PieceModel:
    """Pieces, scores and kinds of a model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        self.processor = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.unk = sp.unk_id()
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.longest = max(map(len, self.ids))
        if any(p.strip(MARK).find(MARK) >= 0 or p.endswith(MARK) and p.strip(MARK) for p in self.ids):
            raise ValueError("a piece goes on over a word boundary; words of such a model can't be encoded apart")


def marked_words(text: str) -> list[str]:
    """The text cut before each run of spaces, a space put in front; no piece of a model reaches over such a cut.

    Spaces stand for the model's mark, and a mark in the text is read as a space. An empty text has no words.
    """
    return _WORD.findall(" " + text.replace(MARK, " ")) if text else []


def model_bytes(path: str) -> bytes:
    """Read on the driver; the model goes to the executors, who need no file of their own."""
    with open(path, "rb") as f:
        return f.read()
