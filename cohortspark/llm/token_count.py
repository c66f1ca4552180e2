"""Token counts by overlap resynchronisation.

A long text is read in chunks that overlap.  Every chunk is encoded with offsets: where its white-space-free
pieces start, and how many tokens each has.  Neighbouring chunks are spliced in their overlap at a place that is
a piece start after white space in both and from which both go on alike; there the tokenizer's normalisation,
pre-tokenizer and merges cannot reach across (a token never holds a space, tab or line feed, and none of these
composes with what follows).  If the overlap holds no such place it is doubled; if one piece fills the whole
chunk, the chunk is.

Pieces recur, so a task remembers the counts of short ones; the tokenizer itself sees each piece once.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import MEMO_LIMIT, per_text

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 256
MEMO_PIECE = 64  # longer pieces are encoded each time
_PIECE = re.compile(r"[^ \n\t]+")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """Tokenizer of a file, by its ending: .json or .model; threads are Spark's business."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


class PieceCounter:
    """Token counts of pieces, without added special tokens."""

    def __init__(self, path: str):
        self.own, self.seen = tokenizer(path), {}

    def _encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.own.encode_batch_fast(pieces, add_special_tokens=False)]

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if len(p) <= MEMO_PIECE and p not in self.seen]
        if len(self.seen) + len(new) > MEMO_LIMIT:
            self.seen, new = {}, [p for p in pieces if len(p) <= MEMO_PIECE]
        self.seen.update(zip(new, self._encode(new)))

    def counts(self, pieces: list[str]) -> list[int]:
        get = self.seen.get
        found = [get(p) for p in pieces]
        if None in found:
            where = [i for i, n in enumerate(found) if n is None]
            for i, n in zip(where, self._encode([pieces[i] for i in where])):
                found[i] = n
        return found


class OverlapCounter:
    """Counts the tokens of texts chunk by chunk."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.pieces, self.chunk, self.overlap = PieceCounter(path), max(1, chunk), max(1, overlap)

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(piece starts, token counts) of text[start:end]."""
        own = [(m.start(), m.group()) for m in _PIECE.finditer(text, start, end)]
        return np.array([at for at, _ in own], np.int64), np.array(self.pieces.counts([p for _, p in own]), np.int64)

    def count(self, text: str) -> int:
        n = len(text)
        if n <= self.chunk:
            return sum(self.pieces.counts(_PIECE.findall(text)))
        total, place, low, high = 0, 0, 0, min(n, self.chunk + self.overlap)
        starts, counts = self._chunk(text, low, high)
        while high < n:
            overlap, found = self.overlap, None
            while found is None and high - overlap > place:
                later_low, later_high = high - overlap, min(n, high + self.chunk)
                later = self._chunk(text, later_low, later_high)
                found = self._common(text, later_low, high, starts, counts, *later)
                overlap *= 2
            if found is None:  # one piece reaches from the last place past the end: a longer chunk
                low, high = place, min(n, high + 2 * (high - place))
                starts, counts = self._chunk(text, low, high)
                continue
            total += int(counts[(starts >= place) & (starts < found)].sum())
            place, low, high, (starts, counts) = found, later_low, later_high, later
        return total + int(counts[starts >= place].sum())

    @staticmethod
    def _common(text, low, high, starts, counts, next_starts, next_counts) -> int | None:
        """First place in the overlap where both chunks start the same whole piece after white space."""
        ours = dict(zip(starts.tolist(), counts.tolist()))
        for s, c in zip(next_starts.tolist(), next_counts.tolist()):
            if s >= high:
                return None
            after = s > 0 and text[s - 1] in " \n\t"
            if after and ours.get(s) == c and _PIECE.match(text, s).end() <= high:
                return s
        return None


def count_function(path: str, limit: int, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Column function text -> n_bytes, n_tokens, over_limit."""

    def build():
        counter = OverlapCounter(path, chunk, overlap)

        def work(texts: list[str]) -> dict:
            fresh: set[str] = set()
            for text in texts:
                fresh.update(_PIECE.findall(text))
                if len(fresh) > MEMO_LIMIT // 4:
                    counter.pieces.learn(fresh)
                    fresh = set()
            counter.pieces.learn(fresh)
            tokens = [counter.count(t) for t in texts]
            return {
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return work

    return per_text(build, "n_bytes long, n_tokens long, over_limit boolean")


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Null and empty texts have 0 bytes and tokens.  Rows are independent: repeated rows repeat, other columns are
    not read, an empty table gives an empty table.
    """
    counts = count_function(path, limit, chunk, overlap)
    return docs.select("doc_id", counts("text").alias("r")).select("doc_id", "r.*")
