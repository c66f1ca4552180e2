"""Runs of repeated word sequences, by minimizers at several scales.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), at least twice as long
as q, that no neighbouring word extends.  Runs of short periods are found by comparing the words with themselves
at every short lag.  For longer ones there is a scale for each power of two g: the period is 2 g or more and less
than 4 g.  At a scale every stretch of g words is a gram with a hash, and of every g consecutive grams the leftmost
with the smallest hash is selected.  What such a window selects depends on its words alone, and it covers less
than a period; so inside a run some gram and its like one period later are both selected.  Pairs of equal
selected grams at a distance of the scale are seeds, which are extended to both sides by hashes of prefixes.

Equal grams at distances of at most g / 2 make a stretch of a shorter period; they are one cluster, of which the
distance between members is no smallest period of a run at this scale.  Seeds between two clusters need only the
first member of one of them: other pairs of the same distance extend to the same run.  So there are at most about 16
seeds for each selected gram, in any text.

Several texts are taken together with a separator of its own after each, which no run can cross.  Texts are kept in
order of length, so that the higher scales work on the first ones only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import mix64

LEAST = 12  # words of a run
GRAM = 16  # words of a gram at the lowest scale; periods of less than twice as many are found by lags
TOGETHER = 60_000  # words taken together; a longer text is taken alone
SLICE = 2_000_000  # characters of the texts whose words are held at once; a longer text is held alone
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIMES, _BASES = (2147483647, 2147483629), (1000003, 69069)  # products stay below 2**62


def text_words(text: str | None) -> list[bytes]:
    """Words of a text: all between spaces, tabs, line feeds and the other white space of ASCII."""
    return text.encode().split() if text else []


class Prefixes:
    """Hashes of prefixes modulo two primes, by which equal stretches of any length are told."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.tables = []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(1, np.int64)
            while len(power) <= self.n:  # doubling: base ** (k + i) = base ** k * base ** i
                power = np.concatenate([power, power * pow(base, len(power), prime) % prime])
            power = power[: self.n + 1]
            own = (values % np.uint64(prime)).astype(np.int64) * power[:-1] % prime
            self.tables.append((prime, power, np.concatenate([np.zeros(1, np.int64), np.cumsum(own)])))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` from a and from b > a are the same."""
        same = np.ones(len(a), bool)
        for prime, power, sums in self.tables:
            left = (sums[a + length] - sums[a]) % prime * power[b - a] % prime
            same &= left == (sums[b + length] - sums[b]) % prime
        return same

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from a and b > a on."""
        low, high = np.zeros(len(a), np.int64), self.n - b
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words before a and b > a."""
        low, high = np.zeros(len(a), np.int64), a.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle, b - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _at_lag(ids: np.ndarray, q: int) -> list[np.ndarray]:
    """(start, length, period) of all stretches with period ``q``."""
    same = np.flatnonzero(ids[:-q] == ids[q:])
    if not len(same):
        return []
    cuts = np.flatnonzero(np.diff(same) > 1)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(same) - 1]])
    length = same[last] - same[first] + 1 + q
    long = length >= max(LEAST, 2 * q)
    return [np.stack([same[first][long], length[long], np.full(long.sum(), q)], 1)]


def _selected(grams: np.ndarray, width: int) -> np.ndarray:
    """Leftmost places of the smallest of every ``width`` (a power of two) consecutive values."""
    value, place = grams, np.arange(len(grams))
    step = 1
    while step < width:
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])
        step *= 2
    keep = np.ones(len(place), bool)
    keep[1:] = place[1:] != place[:-1]
    return place[keep]  # places of later windows are never smaller


def _seeds(grams: np.ndarray, places: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal grams at a distance of 2 g or more and less than 4 g, one of each run at least."""
    order = np.lexsort((places, grams[places]))
    m = places[order].astype(np.int64)
    values = grams[m]
    new = np.ones(len(m), bool)
    new[1:] = values[1:] != values[:-1]
    far = np.ones(len(m), bool)
    far[1:] = np.diff(m) > g // 2
    wide = np.int64(len(grams) + 8 * g)
    key = np.cumsum(new) * wide + m  # members of one value stand together, values stand apart
    leads = np.flatnonzero(new | far)  # first members of clusters
    lead_keys, own = key[leads], np.cumsum(new | far) - 1
    out_place, out_distance = [], []
    for side in (1, -1):
        low, high = (2 * g, 4 * g - 1) if side > 0 else (1 - 4 * g, -2 * g)
        start, end = np.searchsorted(lead_keys, key + low), np.searchsorted(lead_keys, key + high, "right")
        count = end - start
        some = np.repeat(np.arange(len(m)), count)
        lead = np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count) + start[some]
        apart = own[some] != lead
        a, b = m[some[apart]], m[leads[lead[apart]]]
        out_place.append(np.minimum(a, b))
        out_distance.append(np.abs(a - b))
    return np.concatenate(out_place), np.concatenate(out_distance)


def _confirmed(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The runs compared word by word; where two stretches only had one hash, the lag is looked through instead."""
    out = []
    for start, length, q in runs:
        if (ids[start : start + length - q] == ids[start + q : start + length]).all():
            out.append(np.array([[start, length, q]]))
        else:
            out += _at_lag(ids, int(q))
    return np.concatenate(out) if out else runs


def find_in(ids: np.ndarray, longest: int, reach) -> np.ndarray:
    """All runs as rows (start, length, period), by start, then period.

    :param ids: word numbers; a number that is there once separates texts.
    :param longest: words of the longest text.
    :param reach: function from a number of words to the end of the texts with as many or more, which come first.
    """
    lag = min(2 * GRAM - 1, longest // 2)
    found = [one for q in range(1, lag + 1) for one in _at_lag(ids, q)]
    g = GRAM
    if longest >= 4 * g:
        values = mix64(ids.astype(np.uint64) + _STEP)
        grams, prefixes, held = values, Prefixes(values), 1
        while 4 * g <= longest:
            grams = grams[: reach(4 * g)]
            while held < g:
                with np.errstate(over="ignore"):
                    grams = mix64(grams[:-held] * np.uint64(3) + mix64(grams[held:] + _STEP))
                held *= 2
            if len(grams) >= g:
                place, distance = _seeds(grams, _selected(grams, g), g)
                if len(place):
                    left, right = prefixes.before(place, place + distance), prefixes.after(place, place + distance)
                    one = np.stack([place - left, left + right + distance, distance], 1)
                    found.append(_confirmed(ids, np.unique(one[one[:, 1] >= 2 * distance], axis=0)))
            g *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found).astype(np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    again = np.zeros(len(runs), bool)  # a multiple of a period has the same stretch
    again[1:] = (runs[1:, 0] == runs[:-1, 0]) & (runs[1:, 1] == runs[:-1, 1])
    runs = runs[~again]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _together(texts: list[list[bytes]]) -> Iterator[list[int]]:
    """Numbers of the texts that are taken together, longest first."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    group, n = [], 0
    for i in order:
        group.append(i)
        n += len(texts[i]) + 1
        if n >= TOGETHER:
            yield group
            group, n = [], 0
    if group:
        yield group


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs (start, length, period) of each list of words."""
    out: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    for group in _together(texts):
        number: dict = {}
        sizes = np.array([len(texts[i]) for i in group])
        ends = np.cumsum(sizes + 1)
        flat = []
        for k, i in enumerate(group):
            flat.extend([number.setdefault(w, len(number)) for w in texts[i]])
            flat.append(number.setdefault(k, len(number)))  # no word is a number

        def reach(least: int) -> int:
            many = int(np.searchsorted(-sizes, -least, "right"))
            return int(ends[many - 1]) if many else 0

        runs = find_in(np.array(flat, np.int64), int(sizes[0]), reach)
        owner = np.searchsorted(ends, runs[:, 0], "right")
        cuts = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            own = runs[cuts[k] : cuts[k + 1]].copy()
            own[:, 0] -= ends[k] - sizes[k] - 1
            out[i] = own
    return out


def collapsed(ws: list[bytes], runs: np.ndarray) -> str:
    """The words joined by spaces, without those that a run repeats."""
    if not len(runs):
        return b" ".join(ws).decode()
    edge = np.zeros(len(ws) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    keep = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(ws, keep) if k]).decode()


def _slices(part: pd.Series) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in part:
        held.append(text_words(text))
        n += len(text or "")
        if n >= SLICE:
            yield held
            held, n = [], 0
    yield held


def _work(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
        for texts in _slices(part):
            for ws, own in zip(texts, runs_of(texts)):
                out["n_words"].append(len(ws))
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in own.tolist()])
                out["collapsed"].append(collapsed(ws, own))
        yield pd.DataFrame(out)


def find_runs(docs: DataFrame) -> DataFrame:
    """Runs of repeated words in every text.

    :param docs: doc_id, text and any other columns, which are not read.
    :return: one row per input row: doc_id, n_words, runs (array of start, length, period in words, by start, then
        period), collapsed (the words joined by single spaces, without those that a run holds after its first
        period).

    Words are divided by ASCII white space; null and empty texts have none, and no runs.  Runs of one start are told
    apart by their periods; repeated rows and rows without an id are rows like others; an empty table gives an
    empty table.
    """
    scan = F.pandas_udf(_work, "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return docs.select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")
