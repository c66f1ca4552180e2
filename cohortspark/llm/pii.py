"""Personal data by weak supervision, in DataFrame operations only.

Expressions find the base spans and further candidates (written-out addresses, numbers in national formats, account
numbers, checked numbers that miss their check).  Four labelers vote on every candidate or abstain: its form, a
gazetteer of endings and country codes, the words before it, and its shape.  Expectation-maximisation on the table
of vote patterns, whose size the labelers bound, estimates how reliable each labeler is and how likely each
pattern is personal data.  A logistic span classifier is trained on the patterns with these soft labels, and its
coefficients score every candidate inside the query.  Base spans are always reported; others when the classifier
says so.

Match positions come from splitting: the pieces between matches and the matches, added up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.session import settled

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("mail_text", "phone_text", "account", "number")

# The base expressions (possessive, and started only where a leftmost match can start, so that
# long runs are scanned once), and those of further candidates.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "mail_text": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+ ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z]{2,12}",
    "phone_text": r"(?<![0-9+()])(?<!\+[0-9]{1,3}[ .-]{1,2})\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# What a text must hold for an expression to be tried at all.
NEEDS = {"email": ("@",), "phone": ("+",), "mail_text": ("at)", "at]", "at )", "at ]"), "number": ("-",)}
# Gazetteers and context words.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
COUNTRY_CODES = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32")
ACCOUNT_COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PL")
CONTEXT_FOR = r"(?i)(mail|contact|write|tel|phone|call|mobile|fax|card|iban|account|ssn|social|address|login|host)\W*(\w+\W+){0,2}$"
CONTEXT_AGAINST = r"(?i)(order|invoice|version|isbn|issn|total|page|figure|table|item|serial|build)\W*(\w+\W+){0,2}$"

LABELERS = ("form", "gazetteer", "context", "shape")
ROUNDS = 40
TRAINING_STEPS = 400
LEAST = 0.5
_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string of at most 19 places passes the Luhn check."""
    padded = F.lpad(number, 19, "0")
    total = F.lit(0)
    for place in range(1, 20):
        d = F.substring(padded, place, 1).cast("int")
        total = total + (d if place % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _part_fits(part: Column) -> Column:
    own = F.regexp_replace(part, "^0+", "")
    return (F.length(own) <= 3) & (F.coalesce(own.try_cast("int"), F.lit(0)) <= 255)


def passes(kind: str, value: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _part_fits)
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _prefix(steps: Column, blocks: Column, i: Column) -> Column:
    """Sum of the first ``i`` steps, from sums of whole blocks: about two block lengths of additions each."""
    whole = F.floor(i / _BLOCK).cast("int")
    add = lambda a, x: a + x
    head = F.aggregate(F.slice(blocks, F.lit(1), whole), F.lit(0), add)
    return head + F.aggregate(F.slice(steps, whole * _BLOCK + 1, i - whole * _BLOCK), F.lit(0), add)


def matches(text: Column, expression: str) -> Column:
    """All matches as structs (start, end, value, before): code points, end exclusive; 40 characters before."""

    def placed(found: Column) -> Column:
        pieces = F.split(text, expression, -1)

        def with_pieces(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))

            def with_steps(s: Column) -> Column:
                count = F.floor((F.size(s) - 1) / _BLOCK).cast("int")
                blocks = F.transform(
                    F.sequence(F.lit(0), count),
                    lambda b: F.aggregate(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda a, x: a + x),
                )
                return let(
                    blocks,
                    lambda bs: F.transform(
                        found,
                        lambda value, i: let(
                            _prefix(s, bs, i) + F.length(p[i]),
                            lambda start: F.struct(
                                start.alias("start"),
                                (start + F.length(value)).alias("end"),
                                value.alias("value"),
                                F.substring(p[i], F.greatest(F.length(p[i]) - 39, F.lit(1)), F.lit(40)).alias("before"),
                            ),
                        ),
                    ),
                )

            return let(steps, with_steps)

        return let(pieces, with_pieces)

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return let(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), lambda f: F.when(F.size(f) > 0, placed(f)).otherwise(none))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, span: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 abstains."""
    value, before = span["value"], span["before"]
    number = digits(value)
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    if kind in ("email", "mail_text"):
        form = _vote(F.lit(True), F.lit(False)) if kind == "email" else F.lit(0)
        gazetteer = _vote(ending.isin(*ENDINGS), F.length(ending) < 2)
        shape = _vote(F.length(value).between(6, 60), F.length(value) > 120)
    elif kind == "ip":
        form = _vote(passes("ip", value), F.lit(True))
        gazetteer = _vote(value.rlike(r"^(10|172|192)\."), value.rlike(r"^0"))
        shape = _vote(F.length(value).between(7, 15), F.length(value) > 15)
    elif kind in ("card", "number"):
        form = _vote(passes("card", value), F.length(number).between(14, 19)) if kind == "card" else _vote(
            ~value.rlike("^(000|666|9)|-00-|-0000$"), F.lit(True)
        )
        gazetteer = _vote(number.rlike("^(4|5[1-5]|3[47]|6011)"), number.rlike("^(0|19[0-9]{2}|20[0-9]{2})")) if kind == "card" else F.lit(0)
        shape = _vote(F.length(number).isin(9, 15, 16), (F.length(number) < 9) | (F.length(number) > 19))
    elif kind == "account":
        form = _vote(F.length(F.translate(value, " ", "")).between(15, 34), F.lit(True))
        gazetteer = _vote(F.substring(value, 1, 2).isin(*ACCOUNT_COUNTRIES), F.lit(True))
        shape = _vote(F.length(number) >= 10, F.length(number) < 6)
    else:
        form = _vote(F.length(number).between(10, 15), F.lit(True))
        gazetteer = _vote(value.rlike(r"^\+(" + "|".join(COUNTRY_CODES) + ")"), F.lit(False))
        shape = _vote(F.length(value) <= 24, F.length(value) > 30)
    context = _vote(before.rlike(CONTEXT_FOR), before.rlike(CONTEXT_AGAINST))
    return dict(zip(LABELERS, (form, gazetteer, context, shape)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans: structs (start, order, end, kind, base, form, gazetteer, context, shape, length)."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    kinds = [*KINDS, *MORE_KINDS]
    empty = "array<struct<start:int,order:int,end:int,kind:string,base:boolean,form:int,gazetteer:int,context:int,shape:int,length:int>>"

    def judged(kind: str, order: int):
        def one(span: Column) -> Column:
            base = passes(kind, span["value"]) if kind in KINDS else F.lit(False)
            cast = [v.cast("int").alias(name) for name, v in votes(kind, span).items()]
            length = F.least(F.floor(F.length(span["value"]) / 8), F.lit(4)).cast("int")
            return F.struct(
                span["start"].alias("start"),
                F.lit(order).alias("order"),
                span["end"].alias("end"),
                F.lit(kind).alias("kind"),
                base.alias("base"),
                *cast,
                length.alias("length"),
            )

        return one

    parts = []
    for order, kind in enumerate(kinds):
        found = F.transform(matches(F.col("text"), EXPRESSIONS[kind]), judged(kind, order))
        if kind == "card":  # short chains of digits are no candidates
            found = F.filter(found, lambda s: s["base"] | (s["end"] - s["start"] >= 12))
        if kind in NEEDS:
            held = reduce(lambda a, b: a | b, [F.instr("text", need) > 0 for need in NEEDS[kind]])
            found = F.when(held, found).otherwise(F.array().cast(empty))
        parts.append(found)
    return out.select("doc_id", F.array_sort(F.flatten(F.array(*[p.cast(empty) for p in parts]))).alias("spans"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[float], list]:
    """Expectation-maximisation over (votes, count): posterior of each pattern, and P(vote | class) per labeler.

    Labelers are taken as independent given the class; the start is the majority of the votes.
    """
    posterior = [1.0 / (1.0 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    table: list = []
    for _ in range(rounds):
        mass = [1.0, 1.0]
        table = [[{-1: 1.0, 0: 1.0, 1: 1.0} for _ in LABELERS] for _ in range(2)]
        for (own, n), p in zip(patterns, posterior):
            for c, weight in ((1, p * n), (0, (1 - p) * n)):
                mass[c] += weight
                for labeler, vote in enumerate(own):
                    table[c][labeler][vote] += weight
        for c in range(2):
            for row in table[c]:
                total = sum(row.values())
                for vote in row:
                    row[vote] /= total
        prior = math.log(mass[1] / mass[0])
        posterior = []
        for own, _ in patterns:
            z = prior + sum(math.log(table[1][k][v] / table[0][k][v]) for k, v in enumerate(own))
            posterior.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))))
    return posterior, table


def _features(kind: str, own: tuple[int, ...], length: int) -> list[str]:
    names = ["constant", f"kind={kind}", f"length={length}"]
    return names + [f"{name}={vote}" for name, vote in zip(LABELERS, own) if vote]


def train_classifier(patterns: list[tuple[str, tuple[int, ...], int, int]], steps: int = TRAINING_STEPS) -> dict[str, float]:
    """Coefficients of a logistic span classifier, from (kind, votes, length, count) and EM's soft labels."""
    pooled: dict[tuple[int, ...], int] = {}
    for _, own, _, n in patterns:
        pooled[own] = pooled.get(own, 0) + n
    keys = sorted(pooled)
    soft = dict(zip(keys, reliabilities([(k, pooled[k]) for k in keys])[0]))
    total = float(sum(n for *_, n in patterns)) or 1.0
    rows = [(_features(kind, own, length), soft[own], n / total) for kind, own, length, n in patterns]
    weights = {name: 0.0 for names, _, _ in rows for name in names}
    for _ in range(steps):
        gradient = {name: 1e-4 * w for name, w in weights.items()}
        for names, label, share in rows:
            p = 1.0 / (1.0 + math.exp(-sum(weights[n] for n in names)))
            for n in names:
                gradient[n] += share * (p - label)
        for name in weights:
            weights[name] -= 2.0 * gradient[name]
    return weights


def _score(span: Column, weights: dict[str, float]) -> Column:
    def part(prefix: str, value: Column) -> Column:
        own = [(k.split("=", 1)[1], w) for k, w in weights.items() if k.startswith(prefix + "=")]
        out = F.lit(0.0)
        for key, w in own:
            same = value == (F.lit(key) if prefix == "kind" else F.lit(int(key)))
            out = out + F.when(same, F.lit(w)).otherwise(F.lit(0.0))
        return out

    z = F.lit(weights.get("constant", 0.0))
    for prefix in ("kind", "length", *LABELERS):
        z = z + part(prefix, span[prefix])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def written(spans: Column) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(text, ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every row.

    :param docs: doc_id, text and any other columns, which are not read.
    :return: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text of all spans) and found (structs
        with the classifier's probability).

    Null counts as an empty text, which has no spans and the digest of no bytes.  Repeated rows repeat; an empty
    table, or one without candidates, gives rows without spans.
    """
    rows = settled(candidates(docs))  # spans only: no text is written
    pattern = ["kind", *LABELERS, "length"]
    counted = rows.select(F.explode("spans").alias("s")).select(*[f"s.{c}" for c in pattern]).groupBy(*pattern).count()
    table = [
        (r["kind"], tuple(r[k] for k in LABELERS), r["length"], r["count"])
        for r in counted.collect()  # at most kinds * 3**labelers * lengths rows
    ]
    weights = train_classifier(sorted(table))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")
    scored = F.transform("spans", lambda s: s.withField("probability", _score(s, weights)))
    kept = F.filter(scored, lambda s: s["base"] | ((s["probability"] >= LEAST) & ~s["kind"].isin(*KINDS)))
    out = rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        kept.alias("found"),
    )
    return out.select(*out.columns[:-1], written(F.col("found")).alias("spans"), "found")
