"""Secrets in texts: keyword prefilter, anchored expressions near the hits, embedded checksums.

One Aho-Corasick automaton holds all keywords: the names that assignments use, key prefixes, and every string
of four hexadecimal digits (a run of 16 holds at least one).  Only where a keyword is found is an expression
tried, anchored there.  Tokens that carry a checksum are reported when it is right.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.text import ascii_lower, per_text

KINDS = ("assign", "access", "hex", "github", "npm", "pem")  # order of spans that start together

# Names, prefixes and least lengths of the base kinds, and prefixes of tokens with a checksum.
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
LEAST = {"assign": 12, "access": 18, "hex": 16}
GITHUB_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIX = "npm_"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----")
_HEX_DIGITS = frozenset("0123456789abcdef")


def base62(value: int, width: int = 6) -> str:
    digits = ""
    while value:
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits.rjust(width, "0")


def checksum_right(body: str, check: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the 30 before."""
    return base62(zlib.crc32(body.encode())) == check


class SecretScanner:
    """Finds (start, end, kind) in a text; offsets are code points, ends exclusive."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, str] = {"".join(four): "hex" for four in itertools.product("0123456789abcdef", repeat=4)}
        entries |= {name: "assign" for name in ASSIGN_NAMES}
        entries |= {ACCESS_PREFIX.lower(): "access", NPM_PREFIX: "npm", "-----begin ": "pem"}
        entries |= {prefix: "github" for prefix in GITHUB_PREFIXES}
        for word, kind in entries.items():
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, str]]:
        reached = dict.fromkeys(KINDS, 0)  # matches of a kind do not overlap, short ones included
        spans = []
        for last, (size, kind) in self.automaton.iter(ascii_lower(text)):
            at = last + 1 - size
            if at < reached[kind]:
                continue
            if kind == "hex":
                if text[last] not in _HEX_DIGITS or text[at] not in _HEX_DIGITS:
                    continue
                while at > reached["hex"] and text[at - 1] in _HEX_DIGITS:
                    at -= 1
                match = _HEX.match(text, at)
                value = match.group() if match else ""
            elif kind == "assign":
                match = _ASSIGN.match(text, at)
                value = match.group(1) if match else ""
            elif kind == "access":
                match = _ACCESS.match(text, at)
                value = match.group() if match else ""
            elif kind == "pem":
                match = _PEM.match(text, at)
                value = match.group() if match else ""
            else:
                match = _CHECKED.match(text, at)
                if match and not checksum_right(match.group(1), match.group(2)):
                    match = None
                value = match.group() if match else ""
            if match:
                reached[kind] = match.end()
                if len(value) >= LEAST.get(kind, 1):
                    spans.append((match.start(), match.end(), kind))
        order = {kind: i for i, kind in enumerate(KINDS)}
        return sorted(spans, key=lambda s: (s[0], order[s[2]]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and secrets (structs) of every row.

    Null counts as an empty text, which has no spans and the digest of no bytes.  Rows are independent: repeated
    rows repeat, other columns are not read, an empty table gives an empty table.
    """

    def build():
        scanner = SecretScanner()

        def work(texts: list[str]) -> dict:
            out: dict = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "secrets")}
            for text in texts:
                found = scanner.scan(text)
                base = [s for s in found if s[2] in LEAST]
                for kind in LEAST:
                    out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(found))
                out["secrets"].append([{"start": a, "end": b, "kind": k} for a, b, k in found])
            return out

        return work

    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    scan = per_text(build, f"{fields}, secrets array<struct<start: long, end: long, kind: string>>")
    return docs.select("doc_id", scan("text").alias("r")).select("doc_id", "r.*")
