import hashlib
import random
import re
import zlib

import pytest
from text_cases import HARD, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortspark.llm import decontaminate, pii, secret_scan
from cohortspark.llm.text import words

SECRETS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def brute_secrets(text):
    out = []
    for order, (kind, p) in enumerate(SECRETS.items()):
        for m in p.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


SECRET_PARTS = ["password", "PASSWD", "Token", "api_key", "apikey", "secret", ": ", "=", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789", "DeadBeef", "É", " ", "x", "akia"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(SECRET_PARTS), max_size=25))
def test_base_secrets(parts):
    text = "".join(parts)
    found = [s for s in scanner.scan(text) if s[2] in secret_scan.LEAST]
    assert found == brute_secrets(text)


scanner = secret_scan.SecretScanner()


def test_checksums():
    body = "abcdefghijKLMNOPQRST0123456789"
    good = f"ghp_{body}{secret_scan.base62(zlib.crc32(body.encode()))}"
    assert ("github" in [k for *_, k in scanner.scan(f"é {good} end")]) and scanner.scan("é " + good)[0][:2] == (2, 42)
    assert not scanner.scan(good[:-1] + ("0" if good[-1] != "0" else "1"))


def test_secret_rows(spark):
    texts = [*HARD, "token = 'abcdefghijkl'", "f" * 50_000]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = ",".join(f"{k}:{a}:{b}" for a, b, k in brute_secrets(t or ""))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert secret_scan.scan_secrets(frame(spark, ["a"]).filter("false")).count() == 0


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_personal(text):
    out = []
    for order, (kind, p) in enumerate(PERSONAL.items()):
        for m in re.finditer(p, text):
            number = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(number) <= 19 and luhn(number),
                "phone": lambda: 10 <= len(number) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_personal_rows(spark):
    pick = random.Random(11)
    bits = ["a@b.c", "_x@d.e-f", "..", "@", ".com", "1.2.3.4", ".5", "300", "4111111111111111", "4111 1111-1111 1111", " ", "-", "+1 (389) 555-5010", "+", "é", "😀", "x", "7"]
    texts = [*HARD, *["".join(pick.choice(bits) for _ in range(pick.randrange(25))) for _ in range(400)]]
    texts += [" ".join(["1.2.3.4 jo@ab.de +49 30 1234567"] * 1500), "a.b@" + "c." * 20_000 + "d", "1" * 20_000]
    got = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_personal(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t[:200]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        for kind in PERSONAL:
            assert got[i][f"n_{kind}"] == want.count(kind)
    assert pii.find_personal_data(frame(spark, ["a"]).filter("false")).count() == 0


def test_reliabilities_favour_the_better_labeler():
    pick, patterns = random.Random(2), {}
    for _ in range(4000):
        truth = 1 if pick.random() < 0.4 else -1
        own = tuple(truth if pick.random() < right else -truth for right in (0.95, 0.9, 0.6, 0.55))
        patterns[own] = patterns.get(own, 0) + 1
    _, table = pii.reliabilities(sorted(patterns.items()))
    right = [table[1][k][1] for k in range(4)]
    assert right[0] > 0.85 and right[1] > 0.8 and right[2] < 0.75 and right[3] < 0.7
    weights = pii.train_classifier([("card", own, 2, n) for own, n in sorted(patterns.items())])
    assert weights["form=1"] > weights["context=1"] > 0 > weights["form=-1"]


def brute_hits(doc, items, window):
    hit, found = set(), set()
    for name, item in items:
        n = min(window, len(item))
        for i in range(len(item) - n + 1 if n else 0):
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == item[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(name)
    return len(hit), sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton(items, doc):
    named = [(str(i), [w.encode() for w in item]) for i, item in enumerate(items)]
    ws = [w.encode() for w in doc]
    spans, found = decontaminate.SuffixAutomaton([x for x in named if x[1]], 4).scan(ws)
    assert (sum(b - a for a, b in spans), sorted(found)) == brute_hits(ws, named, 4)


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_contaminated_rows(spark, block_words):
    """Also with a benchmark that is split over several automata."""
    items = [(i, prose(50 + i, 20 + i)) for i in range(6)] + [(90, "short item"), (91, None), (92, ""), (None, prose(77, 15))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [*HARD, items[0][1], prose(8, 300) + " " + items[1][1], prose(9, 30) + " SHORT, item " + items[2][1][:80], items[9][1]]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in decontaminate.contamination_report(docs, benchmark, block_words=block_words).collect()}
    named = [(str(i) if i is not None else "", words(t or "")) for i, t in items]
    for i, t in enumerate(texts):
        if len(t or "") < 10_000:
            n, own = brute_hits(words(t or ""), named, 13)
            assert (got[i].n_hit, got[i].n_items, got[i].n_words) == (n, len(own), len(words(t or ""))), i
            assert got[i].items_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
            assert got[i].contaminated == (n > 0 and 20 * n >= len(words(t or "")))
    for least, most in ((13, 1.0), (13, 0.5), (2, 1.0)):
        left = {r.doc_id: r for r in decontaminate.without_spans(docs, benchmark, least=least, most_left=most).collect()}
        for i, t in enumerate(texts):
            gone = [s for s in got[i].spans if s["end"] - s["start"] >= least]
            drop = {k for s in gone for k in range(s["start"], s["end"])}
            assert (i in left) == (len(drop) <= most * got[i].n_words)
            if i in left:
                assert left[i].score == "x" and (left[i].text == t if not gone else words(left[i].text) == [w for k, w in enumerate(words(t)) if k not in drop])
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.decontaminate(docs, benchmark.filter("false")).count() == len(texts)
