"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text's bytes (A-Z lower-cased) are cut into chunks.  Each chunk has a polynomial hash modulo three primes
below 2**31; two neighbours combine as ``H(ab) = H(a) * B**len(b) + H(b)``, so chunks can be hashed apart and
joined in any grouping.  Rows with equal fingerprints and lengths are then compared chunk by chunk: the smallest
and the largest chunk at each place of a group must be the same string.  That comparison is a grouped min/max,
combined before the shuffle, so a group of copies is never gathered in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import per_text
from cohortspark.session import safe_unions, settled

PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1000003, 69069, 1664525)
CHUNK = 1 << 16


class Fingerprint:
    """Hashes of chunks of at most ``chunk`` bytes and their combination."""

    def __init__(self, primes=PRIMES, bases=BASES, chunk: int = CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = []
        for p, b in zip(primes, bases):
            power = np.ones(1, np.uint64)
            while len(power) < chunk:  # doubling: B**(n + i) = B**n * B**i
                power = np.concatenate([power, power * np.uint64(pow(b, len(power), p)) % np.uint64(p)])
            self.powers.append(power[:chunk][::-1].copy())

    def of_chunk(self, data: bytes) -> tuple[int, ...]:
        """Chunk hash; products stay below 2**39 and their sum below 2**63."""
        values = np.frombuffer(data, np.uint8).astype(np.uint64)
        n = len(values)
        return tuple(int(values @ w[self.chunk - n :]) % p for w, p in zip(self.powers, self.primes))

    def combine(self, left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
        """Fingerprint of a concatenation, from the parts' fingerprints and the right part's length."""
        return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, self.bases, self.primes))

    def of(self, data: bytes) -> tuple[int, ...]:
        """Fingerprint of all bytes; empty gives zeros."""
        total = (0,) * len(self.primes)
        for at in range(0, len(data), self.chunk):
            part = data[at : at + self.chunk]
            total = self.combine(total, self.of_chunk(part), len(part))
        return total


def fingerprints(docs: DataFrame, primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, _row, size, print, text_sha256, text_hash) of every row; null text counts as empty."""

    def build():
        own = Fingerprint(primes, bases, chunk)

        def work(texts: list[str]) -> dict:
            data = [t.encode().lower() for t in texts]
            return {
                "size": [len(d) for d in data],
                "print": ["-".join(map(str, own.of(d))) for d in data],
                "text_sha256": [hashlib.sha256(d).hexdigest() for d in data],
            }

        return work

    stamp = per_text(build, "size long, print string, text_sha256 string")
    return docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("_row"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        stamp("text").alias("r"),
    ).select("doc_id", "_row", "text_hash", "r.*")


def exact_duplicates(docs: DataFrame, primes=PRIMES, bases=BASES, chunk: int = CHUNK) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays.

    :param docs: doc_id, text and any other columns, which are not read.
    :return: one row per input row: doc_id, keep_id (doc_id of the row that stays), group_size, kept,
        text_sha256, text_hash (xxhash64 of the text as it is).

    Null text equals empty text.  A null doc_id is smaller than any other.  Of rows with the same doc_id and
    text one stays.  An empty table gives an empty table.
    """
    safe_unions(docs.sparkSession)
    rows = settled(fingerprints(docs, primes, bases, chunk))
    key = ["size", "print"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    shared = groups.filter(F.col("_n") > 1).drop("_n")

    # Chunkwise comparison of the texts whose fingerprints are shared.
    member = rows.join(shared, key).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), *key)
    member = member.dropDuplicates()
    named = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = named.join(member, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    places = F.sequence(F.lit(0), F.floor(F.length("text") / chunk).cast("int"))
    chunks = texts.select(*key, lowered.alias("text")).select(*key, "text", F.explode(places).alias("place"))
    piece = F.substring(F.col("text"), F.col("place") * chunk + 1, F.lit(chunk))
    spans = chunks.select(*key, "place", piece.alias("piece")).groupBy(*key, "place")
    unequal = spans.agg((F.min("piece") != F.max("piece")).alias("_odd")).filter("_odd").select(*key).distinct()

    # A group that only shares a fingerprint is split by the digest of the whole text.  Groups are combined before
    # the shuffle; rows meet one row of their group in a join whose large partitions can be split.
    best = [F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size")]
    same = rows.groupBy(*key).agg(*best).join(unequal, key, "left_anti").withColumn("_exact", F.lit(None).cast("string"))
    split = rows.join(unequal, key).groupBy(*key, F.col("text_sha256").alias("_exact")).agg(*best)
    named_groups = same.unionByName(split).withColumnsRenamed({"size": "_size", "print": "_print"})
    own = (F.col("size") == F.col("_size")) & (F.col("print") == F.col("_print"))
    own &= F.col("_exact").isNull() | (F.col("_exact") == F.col("text_sha256"))
    out = rows.join(named_groups, own)
    return out.select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
        "text_hash",
    )
