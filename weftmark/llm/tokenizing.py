"""Token ids of whole texts in a task, by the tokenizers library."""

from __future__ import annotations

import functools
import os
import re
import zlib
from itertools import chain

import numpy as np

from weftmark.llm.batches import ragged

END_ID = 2
# bytes of text encoded at a time
TEXT_BYTES = 1 << 20
# pieces that a worker remembers; more are encoded anew in every batch
MEMO_PIECES = 250_000

_OTHER_SPACE = re.compile(r"[^\S \n]")


class _Known(dict):
    """Piece -> number; a new piece gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = number = len(self)
        return number


class PieceEncoder:
    """Encodes texts piece by piece and remembers the ids of pieces.

    A byte-level BPE of this family first splits a text into runs of letters, digits or signs, each with one leading
    blank at most. So a text can be cut before a single blank or line feed between two visible characters without
    changing its ids. Texts with other white space, with a special token's string or with U+0000, which marks
    first pieces here, are encoded in one call.
    """

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_feed = self._encode(["\n"])[0][0]
        self.memo = memo
        self.known = _Known()
        self.flat = np.empty(0, np.uint32)
        self.ends = np.empty(0, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        return (
            not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or "\n " in text
            or " \n" in text or "\0" in text or _OTHER_SPACE.search(text) is not None or any(s in text for s in self.special)
        )

    def _learn(self) -> None:
        """Ids of the new pieces, encoded in few calls with line feeds between them."""
        keys = self.known.new
        pieces = [" " + k if k[0] not in "\0\n" else k[1:] for k in keys]
        lines = self._encode(["\n".join(pieces[i : i + 64]) + "\n" for i in range(0, len(pieces), 64)])
        ids = np.fromiter(chain.from_iterable(lines), np.uint32, sum(map(len, lines)))
        cuts = np.flatnonzero(ids == self.line_feed)
        begins = np.concatenate([[0], cuts[:-1] + 1])
        # a piece after a line feed has its id in front
        led = np.fromiter((k[0] == "\n" for k in keys), np.int64, len(keys))
        lengths = cuts - begins
        ends = np.cumsum(lengths + led)
        flat = np.full(int(ends[-1]), self.line_feed, np.uint32)
        flat[ragged(ends - lengths, lengths)] = ids[ragged(begins, lengths)]
        start = self.ends[-1] if len(self.ends) else 0
        self.ends = np.concatenate([self.ends, start + ends])
        self.flat = np.concatenate([self.flat, flat])

    def _forget(self, size: int) -> None:
        """Back to the first ``size`` pieces."""
        for key in self.known.new:
            del self.known[key]
        self.ends = self.ends[:size]
        self.flat = self.flat[: self.ends[-1] if size else 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the number of ids of each text, the end id included."""
        size = len(self.known)
        self.known.new = []
        odd = [i for i, text in enumerate(texts) if self._odd(text)]
        marked = set(odd)
        # the first piece has no blank before it
        cut = [[] if i in marked else ("\0" + t.replace("\n", " \n")).split(" ") for i, t in enumerate(texts)]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(cut)), np.int64, int(per_text.sum()))
        if self.known.new:
            self._learn()
        begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        lengths = self.ends[index] - begins[index]
        before = np.concatenate([[0], np.cumsum(lengths)])
        first = np.cumsum(per_text) - per_text
        counts = before[first + per_text] - before[first]
        whole = dict(zip(odd, self._encode([texts[i] for i in odd]))) if odd else {}
        for i, ids in whole.items():
            counts[i] = len(ids)
        totals = counts + 1
        out = np.full(int(totals.sum()), END_ID, np.uint32)
        starts = np.cumsum(totals) - totals
        out[ragged(np.repeat(starts - before[first], per_text) + before[:-1], lengths)] = self.flat[
            ragged(begins[index], lengths)
        ]
        for i, ids in whole.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        if size >= self.memo:
            # a memory that no longer fits the texts is dropped
            if len(self.known.new) > len(index) // 3:
                self.known, self.flat, self.ends = _Known(), self.flat[:0], self.ends[:0]
            else:
                self._forget(size)
        return out, totals


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker and tokenizer file."""
    return PieceEncoder(path)


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
