"""Cross-entropy difference of two matched bigram models.

The target model is counted on the rows marked as target, the background model on all rows.  Both have the same
vocabulary (every word of the corpus) and the same smoothing.  A text's score is the mean over its words of the
target loss minus the background loss: the lower, the more the text is like the target.  A row's own counts are
taken out of the models that saw it.

Counts cover every word and every pair of words of every row, and none is held by one task or the driver.  Texts
are dealt into groups of about GROUP_CHARS characters.  A group counts its own words and pairs and sends each
bucket of keys one packed block: sorted keys, their counts in all rows and in target rows.  A bucket adds the
blocks of all groups up and answers each block with the corpus counts in the order of its keys, so no key
travels back.  The group, whose texts were shuffled once, then scores its rows with the counts.  A frequent word or
pair is one key of each group, however often it is there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cohortspark.llm.text import mix64, word_hashes, words

SMOOTHING = 50.0  # weight of the unigram distribution, in counts
CHUNK = 500_000  # words that a task counts at once; a longer text is taken whole
GROUP_CHARS = 8_000_000  # characters of a group of texts; a longer text makes a longer group
BUCKET_KEYS = 2_000_000  # keys of all groups together that a bucket adds up
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Models:
    """Sizes of the models: words counted in the background, and words of the vocabulary (with one for what is unknown).
    Words of the target are counted on the way."""

    total: int
    size: int


def _before(ids: np.ndarray, lists: list[np.ndarray], start: int) -> np.ndarray:
    """Of each word the one before it in its text; a text starts after ``start``."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    sizes = np.array([len(own) for own in lists])
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[firsts] = start
    return out


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """text -> (item, n): counts of words."""
    hashed = word_hashes()

    def counted(lists: list[np.ndarray]) -> pd.DataFrame:
        where, found = pd.factorize(np.concatenate(lists).view(np.int64))
        return pd.DataFrame({"item": found, "n": np.bincount(where, minlength=len(found))})

    lists, n = [], 0
    for part in parts:
        for text in part["text"]:
            lists.append(hashed(words(text or "")))
            n += len(lists[-1])
            if n >= CHUNK:
                yield counted(lists)
                lists, n = [], 0
    if lists:
        yield counted(lists)


def train_models(docs: DataFrame) -> Models:
    """Sizes of the models over all texts of ``docs``."""
    each = docs.select("text").mapInPandas(_count, "item long, n long").groupBy("item").agg(F.sum("n").alias("n"))
    size, n = each.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return Models(n, size + 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Numbers below 2**64, small ones in few bytes: the bytes of equal weight stand together and are deflated."""
    return zlib.compress(b"".join(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays), 1)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    """Arrays of ``n`` numbers each."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, 8, n) if n else np.zeros((0, 8, 0), np.uint8)
    return [np.ascontiguousarray(block.T).view("<u8").ravel() for block in raw]


@cache
def hashes_of_worker():
    """Word hashes with a memo that a Python worker keeps from one group to the next."""
    return word_hashes()


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each value among the different ones, these, and where each of them comes first."""
    codes, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, found, first


class Group:
    """Words and pairs of the texts of a group, and the sorted keys under which they are counted."""

    def __init__(self, texts: list, target: np.ndarray, hashed):
        lists = [hashed(words(t or "")) for t in texts]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.target = target
        at, vocabulary, _ = _codes(np.concatenate([*lists, np.zeros(0, np.uint64)]))
        self.width = len(vocabulary) + 1
        self.at = at.astype(np.int64) + 1  # 0 stands before the first word
        self.doc = np.repeat(np.arange(len(lists)), self.sizes)
        self.before = _before(self.at, lists, 0)
        self.pair, self.kinds, _ = _codes(self.before * self.width + self.at)
        names = np.concatenate([np.zeros(1, np.uint64), mix64(vocabulary + _STEP)])
        self.word_keys = mix64(names[1:] ^ _STEP)
        self.pair_keys = mix64(mix64(names[self.kinds // self.width] * np.uint64(3) + _STEP) + names[self.kinds % self.width])
        keys = np.concatenate([self.word_keys, self.pair_keys])
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        self.keys, places = keys[order[new]], np.empty(len(keys), np.int64)
        places[order] = np.cumsum(new) - 1
        self.word_places, self.pair_places = places[: len(self.word_keys)], places[len(self.word_keys) :]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the keys in all rows and in the target rows of the group."""
        out = []
        for own in (slice(None), self.target[self.doc]):
            n = np.zeros(len(self.keys), np.int64)
            np.add.at(n, self.word_places, np.bincount(self.at[own] - 1, minlength=len(self.word_keys)))
            np.add.at(n, self.pair_places, np.bincount(self.pair[own], minlength=len(self.pair_keys)))
            out.append(n)
        return out[0], out[1]

    def losses(self, corpus: tuple[np.ndarray, np.ndarray], totals: tuple[int, int], size: int) -> list[np.ndarray]:
        """Mean target and background loss of each text, given the corpus counts of the keys."""
        docs = len(self.sizes)
        where, each, _ = _codes(self.doc * self.width + self.at)
        own_n = np.bincount(where, minlength=len(each))
        last = np.ones(len(self.doc), bool)
        last[:-1] = self.doc[1:] != self.doc[:-1]
        goes_on = np.bincount(where[~last], minlength=len(each))  # times a word has one after it
        word_doc, word_key = each // self.width, self.word_places[each % self.width - 1]
        same, _, first = _codes(self.doc * max(1, len(self.kinds)) + self.pair)
        c = np.bincount(same, minlength=len(first))
        doc, start, kind, word = self.doc[first], self.before[first] == 0, self.pair[first], where[first]
        pair_key = self.pair_places[kind]
        out = []
        for k in (1, 0):
            seen = self.target if k else np.ones(docs, bool)
            single = np.maximum(corpus[k][word_key] - own_n * seen[word_doc], 0)
            both = np.maximum(corpus[k][pair_key] - c * seen[doc], 0)
            total = np.maximum(totals[k] - self.sizes * seen, 0)[doc]
            numerator = np.log2(both + SMOOTHING * ((single[word] + 1.0) / (total + size)))
            loss = np.bincount(doc, c * (np.where(start, np.log2(both + SMOOTHING), 0.0) - numerator), docs)
            loss += np.bincount(word_doc, goes_on * np.log2(single + SMOOTHING), docs)
            out.append(np.divide(loss, self.sizes, out=np.zeros(docs), where=self.sizes > 0))
        return out


def score_documents(docs: DataFrame, target_ids: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (bits per word) and score, their difference, of every row.

    :param docs: the rows (doc_id, text and others) on which ``models`` were counted.
    :param target_ids: doc_id of the rows that make the target; ids of no row, repeats and null change nothing.

    Texts without words, null and empty ones among them, have losses and a score of 0.  Without target rows the
    target model is the uniform one.  Repeated rows repeat (a repeat counts as other text), an empty table gives
    an empty table.
    """
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups, buckets = max(1, ceil(chars / GROUP_CHARS)), max(1, ceil(2 * models.total / BUCKET_KEYS))
    total, size = models.total, models.size
    # Rows and target ids of one id are in one group; rows without an id are dealt by their text.
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(groups)).cast("int")
    loose = F.when(F.col("doc_id").isNull(), place(F.coalesce("text", F.lit("")))).otherwise(place("doc_id"))
    dealt = docs.select(loose.alias("g"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    chosen = target_ids.select(F.col("doc_id").cast(kind)).dropna().distinct()
    chosen = chosen.select(place("doc_id").alias("g"), "doc_id")

    def group_of(table: pa.Table, ids: pa.ChunkedArray) -> Group:
        target = pc.fill_null(pc.is_in(table.column("doc_id"), value_set=ids.drop_null()), False)
        return Group(table.column("text").to_pylist(), target.to_numpy().astype(bool), hashes_of_worker())

    def laid_out(group: Group) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys, bucket after bucket and ascending inside, and where buckets begin."""
        bucket = (group.keys % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1))

    def send(table: pa.Table, ids: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"g": [], "b": [], "k": [], "block": []}
        if table.num_rows:
            group = group_of(table, ids.column("doc_id"))
            n, t = group.counts()
            order, cuts = laid_out(group)
            g, words_of_target = table.column("g")[0].as_py(), int(group.sizes[group.target].sum())
            for b in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[b] : cuts[b + 1]]
                block = pack(np.diff(group.keys[at], prepend=np.uint64(0)), n[at], t[at])
                for name, value in zip(rows, (g, int(b), len(at), block)):
                    rows[name].append(value)
            for name, value in zip(rows, (g, -1, words_of_target, b"")):  # answered with the words of all targets
                rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("g", pa.int32()), ("b", pa.int32()), ("k", pa.int64()), ("block", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        sizes = table.column("k").to_pylist()
        if table.column("b")[0].as_py() < 0:
            whole = pa.array([sum(sizes)] * len(sizes), pa.int64())
            return pa.table({"g": table.column("g"), "b": table.column("b"), "k": whole, "reply": pa.array([b""] * len(sizes), pa.binary())})
        blocks = [unpack(data, k) for data, k in zip(table.column("block").to_pylist(), sizes)]
        where, found = pd.factorize(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in blocks]))
        totals = [np.bincount(where, np.concatenate([x[part] for x in blocks]).astype(np.float64), len(found)).astype(np.int64) for part in (1, 2)]
        ends = np.cumsum(sizes)
        replies = [pack(totals[0][where[e - k : e]], totals[1][where[e - k : e]]) for e, k in zip(ends, sizes)]
        return pa.table({"g": table.column("g"), "b": table.column("b"), "k": table.column("k"), "reply": pa.array(replies, pa.binary())})

    arrow = to_arrow_type(kind)
    fields = pa.schema([("doc_id", arrow), ("n_words", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64())])

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return fields.empty_table()
        group = group_of(table, replies.column("doc_id"))
        order, cuts = laid_out(group)
        corpus, of_target = (np.zeros(len(group.keys), np.int64), np.zeros(len(group.keys), np.int64)), 0
        for b, k, data in zip(*(replies.column(c).to_pylist() for c in ("b", "k", "reply"))):
            if b == -1:
                of_target = k
            elif b is not None:
                for part, values in zip(corpus, unpack(data, k)):
                    part[order[cuts[b] : cuts[b + 1]]] = values
        target, background = group.losses(corpus, (total, of_target), size)
        return pa.table([table.column("doc_id").combine_chunks(), pa.array(group.sizes), pa.array(target), pa.array(background)], schema=fields)

    sent = "g int, b int, k long, "
    blocks = dealt.groupBy("g").cogroup(chosen.groupBy("g")).applyInArrow(send, f"{sent}block binary")
    replies = blocks.groupBy("b").applyInArrow(add, f"{sent}reply binary")
    back = replies.unionByName(chosen, allowMissingColumns=True)
    result = f"doc_id {kind.simpleString()}, n_words long, target_loss double, background_loss double"
    out = dealt.groupBy("g").cogroup(back.groupBy("g")).applyInArrow(score, result)
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
