"""Byte-level BPE encoding as a tree reduction over a text, and decoding up the same tree.

A text is halved until the halves are short, the leaves are encoded, and neighbours are joined.  A cut may fall
inside a word, so the tokens around it can be wrong; the join encodes a window around the cut anew and splices
it in.  The window grows on both sides until it reaches a place where the split pattern must start a new match
whatever stands around: a space or line feed after a character that is not white space.  No alternative of the
pattern holds white space after something else, and none looks further than one character past its match, so
tokens outside the two places cannot change.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import per_text

LEAF_CHARS = 1 << 14
FIRST_WINDOW = 32
_PLACE = re.compile(r"(?<=\S)[ \n]")  # Python's \s holds all of Unicode's white space, so this is the safe side


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """Encoder for a rank file: lines of a base64 token and its rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class TreeEncoder:
    """Encodes and decodes texts by halving and joining."""

    def __init__(self, path: str, pattern: str, leaf_chars: int = LEAF_CHARS, first_window: int = FIRST_WINDOW):
        self.bpe = encoding(path, pattern)
        self.leaf, self.window = max(1, leaf_chars), max(1, first_window)

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self.leaf:
            return self.bpe.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        return self._join(text, low, middle, high, self._encode(text, low, middle), self._encode(text, middle, high))

    def _join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        start, end = self._before(text, low, middle), self._after(text, middle, high)
        whole = self.bpe.encode_ordinary
        n_left, n_right = len(whole(text[start:middle])), len(whole(text[middle:end]))
        del left[len(left) - n_left :]
        left += whole(text[start:end])
        left += right[n_right:]
        return left

    def _before(self, text: str, low: int, middle: int) -> int:
        """Last sure place of the left half, looked for in windows that double; its start if there is none."""
        size = self.window
        while True:
            first = max(low, middle - size)
            places = [m.start() for m in _PLACE.finditer(text, first + 1, middle)]
            if places:
                return places[-1]
            if first == low:
                return low
            size *= 2

    def _after(self, text: str, middle: int, high: int) -> int:
        """First sure place of the right half; its end if there is none."""
        size = self.window
        while True:
            last = min(high, middle + size)
            place = _PLACE.search(text, middle + 1, last)
            if place:
                return place.start()
            if last == high:
                return high
            size *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, halves concatenated up the tree."""
        if len(ids) <= self.leaf:
            return self.bpe.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def token_function(path: str, pattern: str, with_ids: bool, leaf_chars: int = LEAF_CHARS):
    """Column function text -> n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids."""

    def build():
        tree = TreeEncoder(path, pattern, leaf_chars)

        def work(texts: list[str]) -> dict:
            out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if with_ids:
                out["token_ids"] = []
            for text in texts:
                ids = tree.encode(text)
                packed = np.array(ids, "<u4")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(packed.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(tree.decode(ids)).hexdigest())
                if with_ids:
                    out["token_ids"].append(packed.astype(np.int32))
            return out

        return work

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return per_text(build, fields + ", token_ids array<int>" if with_ids else fields)


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) of every row.

    Null and empty texts have no tokens and the digests of no bytes.  Rows are independent: repeated rows repeat,
    other columns are not read, an empty table gives an empty table.
    """
    tokens = token_function(path, pattern, with_ids, leaf_chars)
    return docs.select("doc_id", tokens("text").alias("r")).select("doc_id", "r.*")
