import math
import random

import numpy as np

from asterweave.llm.match import consistent, fit_logistic, kind_offsets, matched_pairs

CATS = {"ngc": 0.06, "pgc": 0.05, "ldn": 0.2, "sh2": 0.15}


def sky(seed=3, n=900):
    """Objects recorded by several catalogues, some with a companion nearby; truth by object."""
    rnd = random.Random(seed)
    rows, truth, row = [], {}, 0
    for o in range(n):
        ra, dec = rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-0.98, 0.98)))
        parts = [(ra, dec, rnd.uniform(6, 15), math.exp(rnd.uniform(0, 3)))]
        if rnd.random() < 0.3:
            a, d = rnd.uniform(0, 6.28), rnd.uniform(0.3, 0.7) / 60
            parts.append((ra + d * math.cos(a) / math.cos(math.radians(dec)), dec + d * math.sin(a), parts[0][2] + rnd.choice([-1, 1]) * rnd.uniform(2, 4), parts[0][3] * rnd.choice([0.2, 5])))
        for k, (ra_, dec_, mag, size) in enumerate(parts):
            name = f"name {o} {k}"
            for cat, s in CATS.items():
                if rnd.random() < 0.6:
                    err = lambda s=s: rnd.gauss(0, s) / 60
                    row += 1
                    rows.append({
                        "row_id": row, "catalog": rnd.choice([cat, cat.upper(), f" {cat} "]), "id": f"{cat}{o * 2 + k}",
                        "ra": (ra_ + err() / math.cos(math.radians(dec_))) % 360 + rnd.choice([0, 0, 360]), "dec": dec_ + err(),
                        "mag": mag + rnd.gauss(0, 0.15) if rnd.random() < 0.8 else None, "size": size * math.exp(rnd.gauss(0, 0.15)) if rnd.random() < 0.9 else None,
                        "common_names": name if rnd.random() < 0.5 else None,
                    })
                    truth[row] = (o, k)
    return rows, truth


def pairs_of(truth, rows):
    cat = {r["row_id"]: r["catalog"].strip().lower() for r in rows}
    by = {}
    for row, thing in truth.items():
        by.setdefault(thing, []).append(row)
    return {(a, b) for own in by.values() for a in own for b in own if a < b and cat[a] != cat[b]}


def test_recall_and_precision(spark, catalog):
    rows, truth = sky()
    copy = dict(rows[0], row_id=99_999)
    truth[99_999] = truth[rows[0]["row_id"]]
    got = matched_pairs(catalog(*rows, copy)).collect()
    found, want = {(r.row_id_a, r.row_id_b) for r in got}, pairs_of(truth, [*rows, copy])
    right = len(found & want)
    assert right / len(want) > 0.96 and right / len(found) > 0.97
    assert len(got) == len(found) and all(0.5 <= r.confidence <= 1 and r.row_id_a < r.row_id_b for r in got)
    assert any(99_999 in f for f in found)


def test_edges(catalog):
    assert matched_pairs(catalog()).count() == 0
    nothing = [{"row_id": 1, "ra": None, "dec": 1.0}, {"row_id": 2, "ra": float("nan"), "dec": 1.0}, {"row_id": None, "ra": 1.0, "dec": 1.0}]
    assert matched_pairs(catalog(*nothing)).count() == 0
    two = [{"row_id": 1, "ra": 1.0, "dec": 1.0, "catalog": "ngc", "sep": "x", "logit": 1}, {"row_id": 2, "ra": 1.0, "dec": 1.0, "catalog": None}]
    assert [(r.row_id_a, r.row_id_b) for r in matched_pairs(catalog(*two, extra="sep string, logit int")).collect()] == [(1, 2)]


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = np.c_[np.ones(4000), rng.normal(size=4000)]
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 1])))).astype(float)
    assert np.allclose(fit_logistic(x, y), [0.5, 2.0], atol=0.2)


def test_a_certain_witness_lifts_an_unlikely_pair(spark):
    rows = [(1, 2, "a", "b", math.log(0.004)), (1, 3, "a", "c", 10.0), (2, 3, "b", "c", 10.0)]
    got = consistent(spark.createDataFrame(rows, "row_id_a long, row_id_b long, cat_a string, cat_b string, odds double")).collect()
    assert {(r.row_id_a, r.row_id_b) for r in got if r.odds > 0} == {(1, 2), (1, 3), (2, 3)}


def test_words_tell_unlike_kinds_apart():
    # two kinds of pairs with the same odds: those of the second never share a word where both state some
    rng = np.random.default_rng(1)
    n = 4000
    kind = rng.integers(0, 2, n)
    odds = rng.normal(3.0, 2.0, n)
    true = (rng.random(n) < 1 / (1 + np.exp(-odds))) & (kind == 0)
    stated = rng.random(n) < 0.4
    names = np.where(stated, np.where(true & (rng.random(n) < 0.6), 2, 1), 0)
    off = kind_offsets(odds, np.ones(n), names, np.zeros(n, int), kind, 2, 0.01)
    assert off[0] == 0 and off[1] < -4
    # without words, or with too few sure pairs, nothing is taken off
    assert not kind_offsets(odds, np.ones(n), np.zeros(n, int), np.zeros(n, int), kind, 2, 0.01).any()
    assert not kind_offsets(odds - 20, np.ones(n), names, np.zeros(n, int), kind, 2, 0.01).any()


def test_probabilities_are_calibrated(catalog):
    rows, truth = sky(seed=5, n=700)
    got, want = matched_pairs(catalog(*rows)).collect(), pairs_of(truth, rows)
    said = sum(r.confidence for r in got) / len(got)
    right = sum((r.row_id_a, r.row_id_b) in want for r in got) / len(got)
    assert len(got) > 1000 and right > 0.97 and abs(said - right) < 0.02
