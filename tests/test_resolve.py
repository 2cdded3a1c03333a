import math
import random

import pytest

from asterweave.operators import resolve


def test_chain_merges_into_its_leader(catalog):
    arc = 2 / 60
    rows = [
        {"row_id": 1, "id": "NGC1", "ra": 10.0, "dec": 0.0, "mag": 9.0, "priority": 1, "extra_info": "M1"},
        {"row_id": 2, "id": "Sh2-1", "ra": 10.0 + arc, "dec": 0.0, "size": 400.0, "priority": 2},
        {"row_id": 3, "id": "LDN9", "ra": 10.0 + 2 * arc, "dec": 0.0, "size": 20.0, "priority": 8},
        {"row_id": 4, "id": "PGC5", "ra": None, "dec": 0.0, "size": 301.0, "priority": 6},
    ]
    got = {r.id: r for r in resolve.smart_merge(catalog(*rows), 3.0).collect()}
    assert got["NGC1"].extra_info == "LDN9, M1, Sh2-1" and got["NGC1"].size == 20 and got["NGC1"].mag == 9 and got["NGC1"].members == 3
    assert got["PGC5"].size == 300 and got["PGC5"].members == 1


def apart(p, q):
    a1, d1, a2, d2 = map(math.radians, (p["ra"], p["dec"], q["ra"], q["dec"]))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((a2 - a1) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h)))


@pytest.mark.parametrize("seed", [1, 2])
def test_cover_equals_the_sequential_loop(spark, seed):
    rnd = random.Random(seed)
    rows = [{"row_id": i, "id": f"PGC{i}", "ra": rnd.uniform(0, 12), "dec": rnd.uniform(-6, 6), "size": float(rnd.randrange(5)), "final_score": float(rnd.randrange(6))} for i in range(90)]
    df = spark.createDataFrame([(r["row_id"], r["id"], r["ra"], r["dec"], r["size"], "", "", r["final_score"]) for r in rows], "row_id long, id string, ra double, dec double, size double, extra_info string, common_names string, final_score double")
    order = sorted(rows, key=lambda r: (-r["final_score"], -r["size"], r["row_id"]))
    covered, want = set(), {}
    for i, lead in enumerate(order):
        if i in covered:
            continue
        own = [j for j, r in enumerate(order) if j != i and j not in covered and apart(lead, r) < 2.0]
        covered |= {*own, i}
        want[lead["row_id"]] = 1 + len(own)
    assert {r.row_id: r.members for r in resolve.atlas_frames(df).collect()} == want


def test_frame_takes_the_preferred_designation(spark):
    rows = [(1, "B33", 80.0, 0.0, 5.0, "LDN1630", "Horse", 90.0), (2, "Sh2-277", 80.5, 0.0, 400.0, "", "Flame", 50.0), (3, "IC434", 150.0, 0.0, 5.0, "NGC2024", "", 10.0)]
    df = spark.createDataFrame(rows, "row_id long, id string, ra double, dec double, size double, extra_info string, common_names string, final_score double")
    got = {r.row_id: r for r in resolve.atlas_frames(df).collect()}
    assert (got[1].id, got[1].ra, got[1].extra_info, got[1].common_names, got[1].size) == ("Sh2-277", 80.5, "B33, LDN1630", "Horse, Flame", 5.0)
    assert got[3].id == "IC434" and resolve.atlas_frames(df.limit(0)).count() == 0


def test_cover_of_a_crowded_sky_writes_no_pairs(spark, monkeypatch):
    rnd, written, write = random.Random(4), [], resolve.materialize
    rows = [(i, f"PGC{i}", rnd.uniform(-180, 540), rnd.uniform(87.5, 90), float(rnd.randrange(3)), "", "", rnd.choice([None, 1.0, 2.0])) for i in range(300)]
    rows += [(i, f"PGC{i}", ra, dec, None, "", "", 3.0) for i, (ra, dec) in enumerate([(359.5, 0.0), (0.5, 0.0), (-0.5, 0.0), (2.5, 0.0), (0.5, 95.0), (0.5, 95.0)], 300)]

    def counted(df, what):
        out = write(df, what)
        written.append(out.count())
        return out

    monkeypatch.setattr(resolve, "materialize", counted)
    df = spark.createDataFrame(rows, "row_id long, id string, ra double, dec double, size double, extra_info string, common_names string, final_score double")
    got = {r.row_id: r.members for r in resolve.atlas_frames(df).collect()}
    places = {r[0]: {"ra": r[2], "dec": r[3]} for r in rows}
    left, want = [r[0] for r in sorted(rows, key=lambda r: (-(r[7] or 0), -(r[4] or -1), r[0]))], {}
    while left:
        lead = left[0]
        own = [k for k in left if k == lead or lead < 304 and k < 304 and apart(places[lead], places[k]) < 2.0]
        want[lead], left = len(own), [k for k in left if k not in own]
    assert got == want and max(written) <= 10 * len(rows)
