"""A small hospital in the shape of the raw tables: deterministic, with gaps, ties and odd texts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from cohortspark.sources.schemas import RAW

START = datetime(2023, 1, 1)
LABELS = {1: "heart rate", 2: "systolic pressure", 3: "Vent mode", 4: "Glasgow coma scale(eye)", 5: "urine", 6: "sodium", 7: "saline", 8: "line", 9: "noise"}


def build(spark, people=40, seed=3):
    rng = random.Random(seed)
    hour = lambda h: timedelta(hours=h)
    t = {name: [] for name in RAW}
    emar_id = 0
    for pid in range(1, people + 1):
        t["patients"].append((pid, "MF"[pid % 2], "5 months" if pid == 1 else f"{20 + pid} years"))
        for visit in range(1 + pid % 2):
            hadm, stay = f"h{pid}{visit}", f"s{pid}{visit}"
            admit = START + hour(100 * pid + 1000 * visit)
            length = 3 if pid == 2 else 20 + rng.randrange(30)
            dead = pid % 4 == 0
            kind = ["nan", "ER", "ward"][pid % 3]
            t["admissions"].append((pid, hadm, None, None, admit, admit + hour(200), None, kind, "home", "single", "plan", "X", int(dead), int(dead)))
            t["icustays"].append((pid, hadm, stay, admit, admit + hour(length), length / 24))
            for n in range(4):
                code = rng.choice(["A1", "B2", "C3"] if n else ["A1", f"rare{pid}"])
                t["diagnoses_icd"].append((pid, hadm, n, code))
                t["procedures_icd"].append((pid, hadm, n, rng.choice(["P1", "P2", f"odd{pid}"]), 10))
            t["transfers"].append((pid, hadm, "admit", "unit A", admit, admit + hour(length // 2)))
            t["transfers"].append((pid, hadm, "transfer", "unit B", admit + hour(length // 2), None))
            for h in range(0, length, 2):
                at = admit + hour(h) + timedelta(minutes=rng.randrange(60))
                hr = 60 + rng.randrange(40) + rng.random()
                t["chartevents"].append((pid, hadm, stay, at, 1, str(hr), hr, "bpm"))
                t["chartevents"].append((pid, hadm, stay, at, 2, "-", 110 + 10 * rng.random() if h % 4 else 900.0, "mmHg"))
                t["chartevents"].append((pid, hadm, stay, at, 3, rng.choice(["AC", "SIMV"]), None, None))
                t["chartevents"].append((pid, hadm, stay, at, 4, "3", float(rng.choice([1, 2, 3, 4, 9])), None))
                if h % 6 == 0:
                    t["labevents"].append((pid, hadm, stay, 6, at, "140", 135 + rng.randrange(10) + rng.random(), "mEq"))
                    t["outputevents"].append((pid, hadm, stay, at, 5, str(rng.randrange(300)), "mL"))
            t["inputevents"].append((pid, hadm, stay, admit + hour(1), admit + hour(5), 7, "50 cc" if pid % 2 else "75.5", "cc", 60.0 + pid))
            t["procedureevents"].append((pid, hadm, stay, admit + hour(2), admit + hour(8), 8, 62.0 + pid))
            for h, (med, note) in enumerate([("Drug N", "0.2 mcg/kg/min"), ("Drug S", "80 ccc/hr"), ("Drug N", "no rate")]):
                emar_id += 1
                at = (admit + hour(3 * h)).strftime("%Y-%m-%d %H:%M:%S")
                t["emar"].append((pid, hadm, stay, "Note", at, med, "given", f"e{emar_id}", 1, "p", 50))
                t["emar_detail"].append((pid, hadm, stay, f"e{emar_id}", 50, 1, "p", note, None, None))
    for item, label in LABELS.items():
        links = {5: "outputevents", 7: "inputevents", 8: "procedureevents"}.get(item, "chartevents")
        t["d_items"].append((item, label, links))
    t["d_labitems"].append((6, "sodium"))
    return {name: spark.createDataFrame(values, RAW[name]) for name, values in t.items() if values}


def label_map(spark):
    pairs = [(v, "Others" if v == "noise" else v) for v in LABELS.values()]
    return spark.createDataFrame(pairs, "raw string, canonical string")
