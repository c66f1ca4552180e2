"""Benchmark passages in documents, found by a generalised suffix automaton over words.

The automaton holds every word substring of every benchmark item.  Document words stream through it and the
length of the longest match that ends at each word is tracked; where it reaches the window length, the words
of the window are hit.  Items shorter than a window are one window each: the state of the whole item is marked
and found through the suffix links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import per_text, words
from cohortspark.session import safe_unions, settled

WINDOW = 13
BLOCK_WORDS = 200_000  # words of one automaton; a larger benchmark is split by item into several
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # words in a text as it is
SCHEMA = "n_words long, items array<string>, spans array<struct<start: long, end: long>>"


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items that each state occurs in."""

    def __init__(self, items: Sequence[tuple[str, Sequence[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]
        self.short: list[list[tuple[int, str]]] = [[]]
        ends: list[tuple[str, list[int]]] = []
        for name, sequence in items:
            last, path = 0, []
            for word in sequence:
                last = self._extend(last, word)
                path.append(last)
            ends.append((name, path))
        for name, path in ends:
            for state in path:  # every suffix of a prefix occurs in the item
                while state > 0 and name not in self.items[state]:
                    self.items[state].add(name)
                    state = self.link[state]
        for (name, sequence), (_, path) in zip(items, ends):
            if 0 < len(sequence) < window:
                state = self._walk(sequence)
                self.short[state].append((len(sequence), name))
        self.vocabulary = {w for step in self.next for w in step}
        self.shortest = min([window, *(len(s) for _, s in items if s)])
        self.has_short = [False] * len(self.next)
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            up = self.link[state]
            self.has_short[state] = bool(self.short[state]) or (up >= 0 and self.has_short[up])

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.items.append(set())
        self.short.append([])
        return len(self.next) - 1

    def _split(self, state: int, target: int, word: bytes) -> int:
        copy = self._new(self.length[state] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, target, word)
        new, state = self._new(self.length[last] + 1), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, target, word)
        return new

    def _walk(self, sequence: Sequence[bytes]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state

    def scan(self, ws: Sequence[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans (start, end) of all windows that occur in ``ws``, and the items they belong to."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        known = self.vocabulary.__contains__
        inside = list(map(known, ws))
        at, n = 0, len(ws)
        while at < n:
            try:
                start = inside.index(True, at)  # no match spans a word that no item has
            except ValueError:
                break
            try:
                at = inside.index(False, start)
            except ValueError:
                at = n
            if at - start >= self.shortest:
                self._scan_run(ws, start, at, spans, found)
        return spans, found

    def _scan_run(self, ws, start: int, end: int, spans: list, found: set) -> None:
        state, matched, window = 0, 0, self.window
        for i in range(start, end):
            word = ws[i]
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            longest = 0
            if matched >= window:
                longest, up = matched, state
                while self.length[self.link[up]] >= window:
                    up = self.link[up]
                found |= self.items[up]
            if self.has_short[state]:
                up = state
                while up > 0 and self.has_short[up]:
                    for size, name in self.short[up]:
                        if size <= matched:
                            longest = max(longest, size)
                            found.add(name)
                    up = self.link[up]
            if longest:
                first = i + 1 - longest
                while spans and spans[-1][1] >= first:
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items with their words, in blocks of about ``block_words`` words, streamed to the driver one by one.

    The benchmark is the stated query set; a block, not the benchmark, bounds an automaton and what the driver
    holds.  Rows with one item_id are one item; null ids are the item with the empty name.
    """
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        ws = words(row["text"] or "")
        if ws:
            if size and size + len(ws) > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"] if row["i"] is not None else "", ws))
            size += len(ws)
    yield block


def match_function(block: list[tuple[str, list[bytes]]], window: int = WINDOW):
    """Column function text -> (n_words, items, spans) for one block of items."""

    def build():
        automaton = SuffixAutomaton(block, window)

        def work(texts: list[str]) -> dict:
            out: dict = {"n_words": [], "items": [], "spans": []}
            for text in texts:
                ws = words(text)
                spans, found = automaton.scan(ws)
                out["n_words"].append(len(ws))
                out["items"].append(sorted(found))
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
            return out

        return work

    return per_text(build, SCHEMA)


def union_length(spans):
    """Words covered by sorted spans: what each adds beyond the end reached so far."""
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("hit"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["end"]).alias("reach"),
            (a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).cast("long").alias("hit"),
        ),
        lambda a: a["hit"],
    )


def merged_spans(spans):
    """Sorted spans with those that overlap or touch made one, as an automaton gives them."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def take(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when(last["end"] >= s["start"], joined).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), take)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add n_words, items (sorted ids), spans (word spans) and n_hit to the rows of ``docs``, all columns kept.

    Existing columns of those names are replaced.  With one block every row is judged where it is read, without
    a shuffle.  With several, the rows are written once, each block is a pass of its own, whose hits are written before
    the next block is fetched (so that a task holds one automaton, the driver two blocks, and no plan grows with
    the benchmark), and the hits of a row, at most one entry per block, are merged.
    """
    safe_unions(docs.sparkSession)
    blocks = benchmark_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    own = [c for c in docs.columns if c.lower() not in {"n_words", "items", "spans", "n_hit"}]
    rows = docs.select(*own)
    if second is None:
        found = rows.withColumn("_llm_m", match_function(first, window)("text"))
        found = found.withColumns({"_llm_items": F.col("_llm_m.items"), "_llm_spans": F.col("_llm_m.spans")})
    else:
        rows = settled(rows.withColumn("_llm_row", F.monotonically_increasing_id()))
        hits = None
        for block in chain([first, second], blocks):
            one = rows.select("_llm_row", match_function(block, window)("text").alias("m")).filter(F.size("m.items") > 0)
            one = settled(one)
            hits = one if hits is None else hits.unionByName(one)
        hits = hits.groupBy("_llm_row").agg(F.collect_list("m").alias("m"))
        hits = hits.select("_llm_row", F.flatten("m.items").alias("_llm_items"), F.flatten("m.spans").alias("_llm_spans"))
        hits = hits.withColumn("_llm_spans", merged_spans(F.array_sort("_llm_spans")))
        counted = rows.withColumn("_llm_m", match_function([], window)("text"))
        found = counted.join(hits, "_llm_row", "left")
        none = F.col("_llm_m")
        found = found.withColumns(
            {
                "_llm_items": F.coalesce("_llm_items", none["items"]),
                "_llm_spans": F.coalesce("_llm_spans", none["spans"]),
            }
        )
    spans = F.array_sort("_llm_spans")
    return found.select(
        *own,
        F.col("_llm_m.n_words").alias("n_words"),
        F.array_sort(F.array_distinct("_llm_items")).alias("items"),
        spans.alias("spans"),
        union_length(spans).alias("n_hit"),
    )


def contaminated(n_hit, n_words):
    """A document is contaminated if a word is hit and hit words are a twentieth of its words or more."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, with their columns as they were.

    Null and empty texts have no words and stay; an empty benchmark leaves every row; repeated rows stay
    repeated; ties do not occur, as every row is judged alone.
    """
    kept = docs.columns
    plain = docs.select(*[F.col(c).alias(f"_llm_c{i}") for i, c in enumerate(kept)], F.col("text"))
    judged = benchmark_matches(plain, benchmark, window).filter(~contaminated(F.col("n_hit"), F.col("n_words")))
    return judged.select(*[F.col(f"_llm_c{i}").alias(c) for i, c in enumerate(kept)])


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = WINDOW, most_left: float = 1.0) -> DataFrame:
    """``docs`` with benchmark passages cut out of their texts, columns as they were.

    A hit span of ``least`` words or more goes, from its first to its last letter; shorter ones stay.  Rows of
    which the cut passages make more than ``most_left`` of the words are dropped.  Null stays null, texts without a hit
    stay as they are, repeated rows stay repeated.
    """
    kept = docs.columns
    plain = docs.select(*[F.col(c).alias(f"_llm_c{i}") for i, c in enumerate(kept)], F.col("text"))
    found = benchmark_matches(plain, benchmark, window)
    long = F.filter("spans", lambda s: s["end"] - s["start"] >= least)
    found = found.withColumn("_llm_cut", long).filter(union_length(F.col("_llm_cut")) <= most_left * F.col("n_words"))
    cut = F.when(F.size("_llm_cut") > 0, F.pandas_udf(_cut_out, "string")("text", "_llm_cut")).otherwise(F.col("text"))
    return found.select(*[(cut if c == "text" else F.col(f"_llm_c{i}")).alias(c) for i, c in enumerate(kept)])


def _cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts without the words of the spans and what stands between them."""
    out = []
    for text, own in zip(texts, spans):
        if text is None or own is None or not len(own):
            out.append(text)
            continue
        places = [m.span() for m in _WORD.finditer(text)]
        kept, at = [], 0
        for s in own:  # in order; spans of different blocks may overlap
            start, end = places[s["start"]][0], places[s["end"] - 1][1]
            kept.append(text[at : max(at, start)])
            at = max(at, end)
        out.append("".join([*kept, text[at:]]))
    return pd.Series(out, dtype=object)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the hit word spans of every row."""
    found = benchmark_matches(docs.select("doc_id", "text"), benchmark, window, block_words)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "spans",
    )
