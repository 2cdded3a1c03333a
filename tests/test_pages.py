import datetime as dt

from asterweave.operators import pages

SEG = "array<struct<start:double,end:double>>"


def test_object_pages_and_title(spark):
    schema = "id string, name string, type string, extra_info string, common_names string, selected struct<variant:string,month:int,assignment_date:timestamp>"
    objects = spark.createDataFrame([("B", "B", "PN", "M1, NGC7", " ", ("A", 2, None)), ("A", "A", None, None, "Alpha", ("B", 1, None)), ("C", "C", "G", "", "", None)], schema)
    day = lambda m, d: dt.date(2026, m, d)
    stamp = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [(i, day(m, d), q, q, [(1.0, 2.0)], [stamp(17), stamp(5)], 1.0) for i in "ABC" for m, d, q in ((1, 1, 2.0), (1, 2, 2.0), (2, 1, 1.0), (3, 1, 3.0))]
    daily = spark.createDataFrame(rows, f"obj_id string, day date, q_hours double, m_hours double, qual_segments {SEG}, sun_pts array<timestamp>, tz_offset double")
    got = {r.id: r for r in pages.object_pages(objects, daily).collect()}
    assert {i: (r.page, r.title, r.type_label, r.month_best.day, r.year_best.day) for i, r in got.items()} == {
        "A": (16, "Alpha", "Inny", day(1, 1), day(3, 1)), "B": (18, "B", "Mgławica Planetarna", day(2, 1), day(3, 1)),
    }
    assert got["B"].designations == "NGC7" and got["A"].designations == "brak"
    assert (got["A"].year_best.night.dusk, got["A"].year_best.night.dawn) == (4.0, 16.0)
    camera = "camera struct<lens_focal_length:double,sensor_width:double,sensor_height:double>"
    config = spark.createDataFrame(
        [(("Poznań, PL",), 2026, (25.0, -12.0, 3.0, True, (300.0, 23.5, 15.7)))],
        f"location struct<name:string>, year int, parameters struct<minalt:double,sunlimit:double,minhours:double,prefer_famous:boolean,{camera.replace(' struct', ':struct', 1)}>",
    )
    fact = pages.title_facts(config, objects).first()
    assert (fact.place, fact.n_selected, fact.fov_w) == ("Poznań", 2, 4.488173)
