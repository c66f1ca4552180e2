"""Interval joins with very long intervals and a busy key."""

import random
from datetime import datetime, timedelta

from tables import rows

from cohortspark.operators import joins, rollup

START = datetime(2020, 1, 1)


def test_intervals_of_every_length(spark):
    rng = random.Random(2)
    hour = lambda h: timedelta(hours=h)
    spans = [(k % 3, k, START + hour(s), START + hour(s + length)) for k in range(120) for s, length in [(rng.randrange(-5000, 5000), int(2 ** (rng.random() * 14)))]]
    spans += [(0, 500, START, datetime(9999, 12, 31, 23, 59, 59)), (1, 501, datetime(1, 1, 2), START), (2, 502, START, START), (2, 503, START + hour(1), START)]
    points = [(0 if k % 2 else k % 3, k, START + hour(rng.randrange(-6000, 6000))) for k in range(400)] + [(0, 900, datetime(9999, 12, 30)), (1, 901, datetime(1, 6, 1)), (2, 902, START)]
    p = spark.createDataFrame(points, "k int, p int, at timestamp")
    i = spark.createDataFrame(spans, "k int, i int, s timestamp, e timestamp")
    for closed in (True, False):
        got = rows(joins.interval_join(p, i, ["k"], "at", "s", "e", closed), "p", "i")
        want = [(b, d) for a, b, t in points for c, d, s, e in spans if a == c and s <= t and (t <= e if closed else t < e)]
        assert got == sorted(want, key=repr) and len(set(got)) == len(got)


def test_an_interval_is_listed_a_few_times(spark):
    i = spark.createDataFrame([(0, START, datetime(9999, 1, 1)), (0, START, START + timedelta(hours=3))], "k int, s timestamp, e timestamp")
    p = spark.createDataFrame([(0, START)], "k int, at timestamp")
    joined = joins.interval_join(p, i, ["k"], "at", "s", "e")
    assert joined.count() == 2 and joined.columns == ["k", "at", "s", "e"]
    assert joins.interval_join(p, i.limit(0), ["k"], "at", "s", "e").count() == 0


def test_hours_are_spread_by_day(spark, monkeypatch):
    """Intervals are dealt by day to tasks of bounded hours, and nothing is exchanged after they are spread."""
    monkeypatch.setattr(rollup, "TASK_HOURS", 50)
    rng = random.Random(3)
    spans = [(rng.choice(["a", "b", None]), rng.choice("xy"), s, rng.choice([None, s - 1, s + rng.randrange(60)]), float(rng.randrange(9))) for s in [rng.randrange(-40, 200) for _ in range(150)]]
    spans += [("c", "x", None, 30, 2.0), ("c", "y", 5, 3, 1.0), ("c", "x", -9, -1, 1.0)]
    df = spark.createDataFrame(spans, "k string, label string, start_hours long, end_hours long, w double")
    cover = {}
    once = {}
    for k, label, s, e, w in spans:
        once.setdefault((k, label, s, e), []).append(w)
    for (k, label, s, e), w in once.items():
        for h in range(max(s or 0, 0), e + 1) if e is not None else ():
            cover.setdefault((k, h), []).append((label, sum(w) / len(w)))
    mean = lambda v: round(sum(v) / len(v), 9) if v else None
    flag = rollup.interval_flag(df, ["k"], "label", values=["x", "y"])
    assert flag.columns == ["k", "hours", "proc_x", "proc_y"]
    assert rows(flag) == sorted([(k, h, int(any(n == "x" for n, _ in c)), int(any(n == "y" for n, _ in c))) for (k, h), c in cover.items()], key=repr)
    amounts = {(r.k, r.hours): (r.x, r.y) for r in rollup.interval_mean(df, ["k"], "label", "w", values=["x", "y"]).collect()}
    assert {a: tuple(v if v is None else round(v, 9) for v in b) for a, b in amounts.items()} == {a: tuple(mean([w for n, w in c if n == v]) for v in "xy") for a, c in cover.items()}
    weights = {(r.k, r.hours): round(r.w, 9) for r in rollup.interval_weight(df, ["k"], "w").collect()}
    assert weights == {a: mean([w for _, w in c]) for a, c in cover.items()}
    dealt = rollup._hourly(df.select("k", "label", "start_hours", "end_hours").distinct(), df, ["k"], "start_hours", "end_hours")[0]
    assert dealt.rdd.getNumPartitions() > 20


def test_presence_sorts_ranges_of_rows(spark, monkeypatch):
    """The smallest rows of the keys are found in tasks of bounded rows; each key then makes its flags by itself."""
    monkeypatch.setattr(rollup, "RANGE_ROWS", 20)
    rng = random.Random(4)
    data = [(rng.choice([None, *range(40)]), rng.choice(["p", "q", "s", None]), rng.choice([None, "q", "rare"]) if i else "once", rng.choice(["iv", "po", None])) for i in range(300)]
    df = spark.createDataFrame(data, "k int, d1 string, d2 string, route string")
    tags = [(k, tuple(f"{d}_{r}" if d and r else None for d in (a, b))) for k, a, b, r in data]
    counts = {}
    for _, t in tags:
        for name in filter(None, t):
            counts[name] = counts.get(name, 0) + 1
    often = {n for n, c in counts.items() if c >= 0.05 * sum(counts.values())}
    best = {}
    for k, t in tags:
        if often & set(t):
            best[k] = min(best.get(k, t), t, key=lambda x: [(v is not None, v or "") for v in x])
    names = sorted({n for t in best.values() for n in t if n})
    made = []
    plainly = rollup.settled
    monkeypatch.setattr(rollup, "settled", lambda df: made.append(df) or plainly(df))
    out = rollup.presence_pivot_many(df, ["k"], ["d1", "d2"], "route", 0.05)
    assert out.columns == ["k", *names] and rows(out) == sorted([(k, *(int(n in t) for n in names)) for k, t in best.items()], key=repr)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-sum(counts.values()) // 20)})" in made[0]._jdf.queryExecution().executedPlan().toString()
