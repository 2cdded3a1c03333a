import datetime as dt
import math
import random

import pytest

from asterweave.functions.stated import size_fillers
from asterweave.operators.impute import fill_missing, filled_cells

NAN = float("nan")


def test_what_counts_as_missing(catalog):
    mags = [None, NAN, -99.9, 99.0, 99.99, 88.88, 999.0, float("inf"), -1.4, 0.0, 17.3]
    sizes = [None, NAN, 0.0, -1.0, 9999.0, 99999.0, 20000.0, 700.0, 0.1, 45.0, 3600.0]
    types = [None, "", "  ", "-", "?", "NaN", "none", "unk", " gx ", "*", "**"]
    rows = [{"row_id": i, "mag": m, "size": s, "type": t} for i, (m, s, t) in enumerate(zip(mags, sizes, types, strict=True))]
    got = {(r.row_id, r.field) for r in filled_cells(fill_missing(catalog(*rows))).collect()}
    want = {(i, "mag") for i in range(8)} | {(i, "size") for i in range(7)} | {(i, "type") for i in range(8)}
    assert got == want


def test_nines_are_fillers_only_where_they_repeat(catalog):
    # sizes of nines among like ones are values; 9999 stands alone, 999 does so once in one table and often in the other
    real = [9.97, 9.98, 9.99, 9.99, 10.0, 99.8, 99.9, 99.99, 100.0, 998.0, 999.0, 1001.5]
    rows = [{"row_id": i, "ra": float(i), "dec": 1.0, "size": s} for i, s in enumerate([*real, *[9999.0] * 5])]
    assert size_fillers(catalog(*rows)) == [9999.0]
    got = {r.row_id for r in filled_cells(fill_missing(catalog(*rows))).where("field = 'size'").collect()}
    assert got == set(range(len(real), len(rows)))
    often = rows + [{"row_id": 100 + i, "ra": 50.0 + i, "dec": 2.0, "size": 999.0} for i in range(9)]
    assert size_fillers(catalog(*often)) == [999.0, 9999.0]
    # deliveries of one row count once
    again = [{"row_id": i, "ra": 5.0, "dec": 1.0, "size": 999.0} for i in range(9)]
    assert size_fillers(catalog(*again)) == [] and size_fillers(catalog()) == []


def test_hidden_cells_come_back(catalog):
    # objects of four kinds, in catalogues with words of their own, three rows each with noise; a tenth of each field is hidden
    rnd = random.Random(9)
    kinds = {"G": ("Gx", 14.0, 2.0), "PN": ("PN", 11.0, 0.5), "OCl": ("NB", 7.0, 12.0), "DrkN": ("DN", 9.0, 40.0)}
    rows, true = [], {}
    for n in range(240):
        kind = rnd.choice(list(kinds))
        ra, dec, mag, size = rnd.uniform(0, 360), rnd.uniform(-60, 60), rnd.gauss(kinds[kind][1], 1), kinds[kind][2] * math.exp(rnd.gauss(0, 0.5))
        for k, cat in enumerate(("ngc", "ngc", rnd.choice(["pgc", "lbn"]))):
            row = {"row_id": 3 * n + k, "ra": ra + rnd.gauss(0, 0.1) / 60, "dec": dec + rnd.gauss(0, 0.1) / 60, "catalog": cat, "plate": f"P{n % 7}"}
            row |= {"mag": mag + rnd.gauss(0, 0.2), "size": size * math.exp(rnd.gauss(0, 0.1)), "type": kinds[kind][0] if cat != "ngc" else kind}
            true[row["row_id"]] = dict(row)
            rows.append(row | {c: None for c in ("mag", "size", "type") if rnd.random() < 0.1})
    got = {r.row_id: r for r in fill_missing(catalog(*rows)).collect()}
    hidden = {c: [(true[r["row_id"]][c], got[r["row_id"]][c]) for r in rows if r[c] is None] for c in ("mag", "size", "type")}
    assert all(len(h) > 50 for h in hidden.values())
    assert sum(abs(t - g) for t, g in hidden["mag"]) / len(hidden["mag"]) < 0.6
    assert sum(abs(math.log(t / g)) for t, g in hidden["size"]) / len(hidden["size"]) < 0.35
    assert sum(t.upper() == g for t, g in hidden["type"]) / len(hidden["type"]) > 0.95


def test_estimates_spread_to_rest(catalog):
    # a chain of rows without magnitude from one with it, each near the next: nothing else tells, so all take its value
    chain = [{"row_id": i, "ra": 10.0, "dec": 0.6 * i / 60, "mag": 5.0 if i == 0 else None, "type": "PN" if i == 0 else "DN"} for i in range(8)]
    far = [{"row_id": 100 + i, "ra": 200.0, "dec": 3.0 * i, "mag": 15.0, "type": "G"} for i in range(20)]
    got = {r.row_id: r.mag for r in fill_missing(catalog(*chain, *far)).collect()}
    assert all(got[i] == pytest.approx(5.0, abs=0.1) for i in range(8))
    # kinds that nobody measures take what their members near measured rows are estimated at
    near = [{"row_id": 200, "ra": 200.0, "dec": 0.1 / 60, "type": "X"}, {"row_id": 201, "ra": 90.0, "dec": 50.0, "type": "X"}]
    got = {r.row_id: r.mag for r in fill_missing(catalog(*chain, *far, *near)).collect()}
    assert got[200] == pytest.approx(15.0, abs=0.1) and got[201] == pytest.approx(15.0, abs=0.1)


def test_fills_come_from_like_rows_and_observed_stay(catalog):
    base = {"type": "G", "catalog": "ngc", "plate": "P1", "updated_at": dt.datetime(2020, 1, 1)}
    other = {"type": "PN", "catalog": "pgc", "plate": "P2", "updated_at": dt.datetime(2021, 1, 1)}
    rows = [{"row_id": i, "ra": 10.0 + i, "dec": 5.0, "mag": 12.0, "size": 4.0} | base for i in range(5)]
    rows += [{"row_id": 10 + i, "ra": 200.0 + i, "dec": -50.0, "mag": 8.0, "size": 1.0} | other for i in range(5)]
    rows += [{"row_id": 20, "ra": 100.0, "dec": 40.0} | base, {"row_id": 21, "ra": 200.0, "dec": -50.0, "plate": "P2"}]
    got = {r.row_id: r for r in fill_missing(catalog(*rows)).collect()}
    assert len(got) == 12
    assert got[0].mag == 12.0 and not got[0].mag_filled and got[0].type == "G"
    assert got[20].mag == pytest.approx(12.0, abs=0.2) and got[20].mag_filled and got[20].size == pytest.approx(4.0, abs=0.3)
    assert got[21].type == "PN" and got[21].type_filled and got[21].mag == pytest.approx(8.0, abs=0.3)


def test_types_come_from_the_catalogue_without_sky_neighbours(catalog):
    def day(year):
        return dt.datetime(year, 1, 1)

    # most rows are galaxies; an untyped row is like those of its catalogue, first of its plate, then of its month
    rows = [{"row_id": i, "type": "G", "catalog": "pgc", "plate": "P1", "updated_at": day(2020)} for i in range(60)]
    rows += [{"row_id": 100 + i, "type": "DN", "catalog": "ldn", "plate": "P1", "updated_at": day(2020)} for i in range(8)]
    rows += [{"row_id": 200 + i, "type": "PN", "catalog": "ngc", "plate": "P2", "updated_at": day(2021)} for i in range(8)]
    rows += [{"row_id": 300 + i, "type": "OCl", "catalog": "ngc", "plate": "P3", "updated_at": day(2022)} for i in range(8)]
    rows += [{"row_id": 900, "catalog": " LDN ", "plate": "P1", "ra": 10.0, "dec": 5.0}, {"row_id": 901, "catalog": "ldn", "plate": "new"}]
    rows += [{"row_id": 902, "catalog": "ngc", "plate": "P2"}, {"row_id": 903, "catalog": "ngc", "updated_at": day(2022)}, {"row_id": 904, "plate": "P1"}]
    got = {r.row_id: r.type for r in fill_missing(catalog(*rows)).where("row_id >= 900").collect()}
    assert got == {900: "DN", 901: "DN", 902: "PN", 903: "OCL", 904: "G"}


def test_every_row_within_the_radius_is_reached(catalog):
    # pairs 0.6 arcmin apart in any direction, over cell edges, the wrap and the poles: one of each states type and magnitude
    rnd, rows = random.Random(2), []
    places = [(rnd.uniform(0, 360), rnd.uniform(-89, 89)) for _ in range(60)]
    places += [(0.001, d) for d in (-60.0, 0.0, 45.0)] + [(rnd.uniform(0, 360), s * (90 - rnd.uniform(0, 5) / 60)) for s in (-1, 1) for _ in range(25)]
    for i, (ra, dec) in enumerate(places):
        turn, a, d = rnd.uniform(0, 2 * math.pi), math.radians(ra), math.radians(dec)
        step = math.radians(0.6 / 60)
        east, north = (-math.sin(a), math.cos(a), 0.0), (-math.sin(d) * math.cos(a), -math.sin(d) * math.sin(a), math.cos(d))
        at = (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))
        x, y, z = (math.cos(step) * p + math.sin(step) * (math.cos(turn) * e + math.sin(turn) * n) for p, e, n in zip(at, east, north, strict=True))
        rows += [{"row_id": i, "ra": ra, "dec": dec, "mag": 5.0, "type": "PN"}]
        rows += [{"row_id": 1000 + i, "ra": math.degrees(math.atan2(y, x)), "dec": math.degrees(math.asin(z)), "catalog": "ldn"}]
    rows += [{"row_id": 5000 + i, "mag": 15.0, "type": "DN", "catalog": "ldn"} for i in range(300)]
    rows += [{"row_id": 6000 + i, "mag": 15.0, "catalog": "ldn"} for i in range(300)]
    got = fill_missing(catalog(*rows)).where("row_id between 1000 and 4999").collect()
    assert len(got) == len(places) and all(r.type == "PN" and r.mag < 9.0 for r in got)


def test_edges(catalog):
    assert fill_missing(catalog()).count() == 0
    # nothing to learn from: flagged, still null; extra columns of clashing names do no harm
    rows = [{"row_id": 1, "patch": "x", "key": 3, "mag_fill": 1.0}, {"row_id": 2}]
    got = fill_missing(catalog(*rows, extra="patch string, key int, mag_fill double")).collect()
    assert len(got) == 2 and all(r.mag is None and r.mag_filled and r.type is None and r.type_filled for r in got)
    long = [{"row_id": 1, "type": "x" * 50_000, "mag": 5.0}, {"row_id": 2, "type": "x" * 50_000}]
    assert {r.row_id: r.mag for r in fill_missing(catalog(*long)).collect()} == {1: 5.0, 2: pytest.approx(5.0)}
