import numpy as np
import pytest

from asterweave.llm.mixing import marginals_reached, mixed, rake, shares_reached


def docs_of(spark, sizes):
    rows, i = [], 0
    for source, n, tokens in sizes:
        for _ in range(n):
            rows.append((i, source, ["en", "pl", None, "EN-gb"][i % 4], ["a", "b", None][i % 3], tokens + i % 7))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long").selectExpr("*", "1 as copies", "'x' as bucket", "2 as share")


def targets_of(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeat int")


def test_shares_and_caps(spark):
    docs = docs_of(spark, [("big", 3000, 100), ("mid", 600, 100), ("small", 200, 100), (None, 50, 100), ("other", 50, 100), ("big", 3, 0)])
    targets = targets_of(spark, [(" BIG ", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.5, 3)])
    drawn = mixed(docs, targets)
    got = {r.source: r for r in shares_reached(drawn, docs, targets).collect()}
    assert got["absent"].share == 0 and got["absent"].docs == 0
    for name, share, cap in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)):
        assert got[name].share == pytest.approx(share, abs=0.002) and got[name].most_copies <= cap
    rows = drawn.collect()
    assert all(1 <= r.copies <= 4 and r.tokens > 0 for r in rows) and len({r.doc_id for r in rows}) == len(rows)
    assert sorted(rows) == sorted(mixed(docs, targets).collect())


def test_a_large_budget_stops_at_the_caps(spark):
    docs = docs_of(spark, [("a", 100, 50), ("b", 10, 50)])
    targets = targets_of(spark, [("a", 0.5, 3), ("b", 0.5, 2)])
    got = {r.source: r for r in shares_reached(mixed(docs, targets, budget=10**9), docs, targets).collect()}
    assert got["a"].drawn_tokens == 3 * got["a"].tokens and got["b"].drawn_tokens == 2 * got["b"].tokens


def test_nothing_to_draw(spark):
    docs, targets = docs_of(spark, [("a", 5, 10)]), targets_of(spark, [("a", 1.0, 1)])
    assert mixed(docs.limit(0), targets).count() == 0
    assert mixed(docs, targets.limit(0)).count() == 0
    assert mixed(docs, targets_of(spark, [("a", 0.0, 1), (None, 1.0, 1), ("z", 1.0, 0)])).count() == 0
    one = docs_of(spark, [("a", 1, 10)])
    assert [r.copies for r in mixed(one, targets).collect()] == [1]


def test_raking_meets_all_marginals():
    rng = np.random.default_rng(1)
    tokens = rng.integers(50, 500, 24).astype(float)
    axes = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(2), 3), 4), np.tile(np.arange(3), 8)]
    wanted = [np.full(4, tokens.sum() / 4), np.bincount(axes[1], tokens), np.bincount(axes[2], tokens)]
    w, missed = rake(tokens, axes, wanted, np.full(24, 5.0))
    assert max(missed) < 1e-3
    for axis, goal in zip(axes, wanted, strict=True):
        assert np.allclose(np.bincount(axis, w * tokens), goal, rtol=1e-3)


def test_raking_tells_what_it_misses():
    # one cell for each source and language: their marginals contradict each other, the source comes first
    tokens, axes = np.array([100.0, 100.0]), [np.array([0, 1]), np.array([0, 1])]
    w, missed = rake(tokens, axes, [np.array([150.0, 50.0]), np.array([50.0, 150.0])], np.full(2, 5.0))
    assert np.allclose(w * tokens, [150, 50]) and missed[0] < 1e-6 and missed[1] == pytest.approx(1.0)


def test_languages_and_topics_of_any_size_are_raked(spark):
    # "pl" is rare, and mostly in the source that is drawn less
    rows = [(i, "a" if i % 2 else "b", "pl" if i % 200 in (0, 2, 1) else "en", ["x", "y"][i % 3 == 0], 100) for i in range(40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, tokens long")
    targets = targets_of(spark, [("a", 0.8, 1), ("b", 0.2, 1)])
    drawn = mixed(docs, targets)
    reached = {(r.axis, r.value): r for r in marginals_reached(drawn, docs).collect()}
    assert len(reached) == 4
    assert reached["lang", "pl"].share_before == pytest.approx(0.015) and reached["lang", "pl"].share == pytest.approx(0.015, abs=0.003)
    wished = {(r.axis, r.value): r.share for r in marginals_reached(mixed(docs, targets, budget=500_000, langs={"pl": 1, "en": 9}, topics={"x": 1, "y": 3}), docs).collect()}
    assert wished["lang", "pl"] == pytest.approx(0.1, abs=0.01) and wished["topic", "y"] == pytest.approx(0.75, abs=0.02)


def test_without_a_cap_nothing_repeats(spark):
    docs, targets = docs_of(spark, [("a", 50, 100), ("b", 50, 100)]), targets_of(spark, [("a", 0.5, None), ("b", None, 2), ("b", 0.5, 2)])
    got = {r.source: r for r in shares_reached(mixed(docs, targets, budget=10**9), docs, targets).collect()}
    assert got["a"].most_copies == 1 and got["b"].most_copies == 2
