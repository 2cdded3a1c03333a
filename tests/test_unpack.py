from asterweave.operators.unpack import unpack_fields


def items(spark, texts, at_least=1, extra=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_id long, f string")
    if extra:
        df = df.selectExpr("*", "'x' as field", "1 as pos", "'y' as item", "'z' as text", "0 as dialect")
    got = {}
    for r in sorted(unpack_fields(df, ["f"], at_least=at_least).collect(), key=lambda r: (r.row_id, r.pos)):
        got.setdefault(r.row_id, []).append((r.pos, r.item))
    return got


COMMON = ["Alpha", "Beta", "Gamma Ray", "Delta", "Alpha", "Beta", "Gamma Ray", "Delta"]


def test_delimiters_quotes_and_positions(spark):
    texts = COMMON + [
        "Alpha, Beta", "Alpha;Beta ; Delta", "Alpha | Gamma Ray,", "Alpha\tBeta", "Alpha / Beta / Delta", '"Beta, Inner" ; Alpha', '"The ""Salt"" Arc", Delta, Delta',
        ",, Alpha ,,Beta,", " Alpha ",
    ]
    got = items(spark, texts, extra=True)
    n = len(COMMON)
    assert got[n] == [(1, "Alpha"), (2, "Beta")]
    assert got[n + 1] == [(1, "Alpha"), (2, "Beta"), (3, "Delta")]
    assert got[n + 2] == [(1, "Alpha"), (2, "Gamma Ray")]
    assert got[n + 3] == [(1, "Alpha"), (2, "Beta")]
    assert got[n + 4] == [(1, "Alpha"), (2, "Beta"), (3, "Delta")]
    assert got[n + 5] == [(1, "Beta, Inner"), (2, "Alpha")]
    assert got[n + 6] == [(1, 'The "Salt" Arc'), (2, "Delta"), (3, "Delta")]
    assert got[n + 7] == [(1, "Alpha"), (2, "Beta")]
    assert got[n + 8] == [(1, "Alpha")]


def test_copies_of_a_packed_field_are_split_too(spark):
    got = items(spark, COMMON + ["Alpha, Beta"] * 300)
    assert all(got[len(COMMON) + i] == [(1, "Alpha"), (2, "Beta")] for i in range(300))


def test_signs_inside_quotes_only(spark):
    got = items(spark, COMMON * 5 + ['"Alpha, South", Beta', '"Alpha, South"', '"Beta, South"'])
    n = 5 * len(COMMON)
    assert got[n] == [(1, "Alpha, South"), (2, "Beta")] and got[n + 1] == [(1, "Alpha, South")]


def test_dirt(spark):
    long = ", ".join(["Alpha"] * 20_000)
    got = items(spark, COMMON + [None, "", "  ", ",;|", '"', '5" glass', long, '""', "x" * 100_000])
    n = len(COMMON)
    assert not {n, n + 1, n + 2, n + 3, n + 7} & got.keys()
    assert got[n + 4] == [(1, '"')] and got[n + 5] == [(1, '5" glass')]
    assert len(got[n + 6]) == 20_000 and got[n + 6][-1] == (20_000, "Alpha")
    assert got[n + 8] == [(1, "x" * 100_000)]


def test_at_least_and_empty(spark):
    assert items(spark, COMMON + ["Alpha, Beta"], at_least=2) == {len(COMMON): [(1, "Alpha"), (2, "Beta")]}
    assert items(spark, []) == {}
    assert items(spark, ["Alpha"], at_least=2) == {}
