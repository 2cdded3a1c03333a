import random

import numpy as np
import pytest

from asterweave.llm.subjects import Splitter, fit_lexicon, learn_accuracies, learned_prefixes, share_probability, subject_shares, subjects_of, votes

BAG = {
    "sea": ["The boat left the harbour at dawn.", "A wave broke over the deck.", "Sailors tied the anchor rope.", "Salt water filled the hull."],
    "bread": ["The dough rose in the oven.", "Flour and yeast were mixed slowly.", "A crust formed on every loaf.", "The baker kneaded at night."],
}
FILL = ["See also NGC 12.", "To be continued.", "No further remarks."]


def text(rnd, *subjects):
    out = [rnd.choice(BAG[s]) for s in subjects] + [rnd.choice(FILL)]
    return " ".join(out)


def frames(spark, seed=1, n=120):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = rnd.choice([("sea",) * 4, ("bread",) * 4, ("sea", "sea", "bread", "bread")])
        docs.append((i, text(rnd, *own), "forum"))
        if i % 2:
            labels += [(i, s) for s in set(own)]
    truth = {(i, s) for i, t, _ in docs for s in BAG if any(x in t for x in BAG[s])}
    docs += [(1000, None, None), (1001, "", "wiki"), (1002, "  \n ", "wiki"), (1003, "NGC 17", "wiki"), (1004, ("The boat left the harbour at dawn. " * 3000), "wiki")]
    areas = spark.createDataFrame([("sea", "boats and waves"), ("bread", "dough and ovens")], "subject string, description string")
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'q' as subject", "1 as shares", "2 as patterns")
    return d, spark.createDataFrame(labels, "doc_id long, subject string"), areas, truth


def test_finds_subjects(spark):
    docs, labels, areas, truth = frames(spark)
    rows = subjects_of(subject_shares(docs, labels, areas)).collect()
    got = {(r.doc_id, r.subject) for r in rows}
    assert all(0.5 <= r.confidence <= 1 + 1e-9 for r in rows)
    assert {g for g in got if g[0] < 1000} == truth
    assert {g for g in got if g[0] >= 1000} == {(1004, "sea")}


def test_without_labels_or_documents(spark):
    docs, labels, areas, _ = frames(spark, n=6)
    assert subject_shares(docs, labels.limit(0), areas).count() == 11
    assert subject_shares(docs.limit(0), labels, areas).count() == 0
    # texts are read once for other measures, too; columns are carried along
    both = subject_shares(docs, labels, areas, keep=("source", "patterns"), measure=lambda: len).collect()
    assert {(r.doc_id, r.source, r.patterns, r.measured) for r in both} == {(r.doc_id, r.source, 2, len(r.text or "")) for r in docs.collect()}


def test_too_many_subjects_are_an_error(spark):
    docs, labels, _, _ = frames(spark, n=2)
    with pytest.raises(ValueError):
        subject_shares(docs, labels, spark.range(1001).selectExpr("cast(id as string) as subject", "'x' as description"))


def test_sentences():
    cut = Splitter(["update:", "on page 9:"]).cut("[2020-01-01 10:00 UT] NGC 7\n== B12 ==\nDear all,\n\nOne two three. Four five (again) Update: six seven... On page 12: Eight 5. mai nine!")
    assert [s for _, s in cut] == ["Dear all,", "One two three.", "Four five (again)", "Update: six seven...", "On page 12: Eight 5. mai nine!"]


def test_sentences_part_where_folding_changes_the_length():
    cut = Splitter(["update:"])
    for first in ("Eine große Straße", "Wait… it rose", "Cafe\u0301 closed", "Stra\u00dfe cafe\u0301"):
        assert [s for _, s in cut.cut(f"{first} Update: six seven.")] == [first, "Update: six seven."]


def test_learns_which_functions_are_right():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 3, 5000)

    def function(right):
        return np.where(rng.random(5000) < right, truth, (truth + rng.integers(1, 3, 5000)) % 3) + 1

    columns = [function(0.95), function(0.8), np.zeros(5000, int), function(0.6), np.zeros(5000, int)]
    pattern = np.zeros(5000, np.int64)
    for c in columns:
        pattern = pattern * 4 + c
    kinds, back, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    post, accuracy = learn_accuracies(kinds, counts.astype(float), 3)
    assert abs(accuracy[0] - 0.95) < 0.04 and abs(accuracy[1] - 0.8) < 0.04 and abs(accuracy[3] - 0.6) < 0.05
    assert (post.argmax(1)[back] == truth).mean() > 0.94


def test_probability_of_a_share():
    assert share_probability(1, 4, [], 0.25) == 1 and share_probability(1, 5, [], 0.25) == 0 and share_probability(0, 0, [], 0.25) == 0
    # of four sentences three are sure: the fourth decides
    assert share_probability(0, 3, [(0.7, 0.2)], 0.25) == pytest.approx(0.7)
    assert share_probability(1, 4, [(0.0, 0.3)], 0.25) == pytest.approx(0.7)
    rng = np.random.default_rng(3)
    unsure = [(0.3, 0.5)] * 40
    own = rng.multinomial(1, [0.3, 0.5, 0.2], (20_000, 40)).sum(axis=1)
    assert share_probability(2, 10, unsure, 0.35) == pytest.approx((2 + own[:, 0] >= 0.35 * (10 + own[:, 0] + own[:, 1])).mean(), abs=0.03)


def test_designations_are_learned_and_tell_subjects():
    texts = [f"Wreck Vx{i} lies deep. Wreck Vx{i + 1} is near." for i in range(20)] + [f"Rolls of type qB {i} smell fine. Take qB {i}." for i in range(20)]
    texts += ["To be or not to be 3 times."] * 5
    assert learned_prefixes(texts) == ["Vx", "qB"]
    lessons = [(t, "forum", ["sea"] if "Vx" in t else ["bread"]) for t in texts]
    lexicon = fit_lexicon(lessons, ["bread", "sea"])
    pattern, counts = votes(lexicon, Splitter(lexicon.openers, lexicon.prefixes), [("Somebody somewhere recently admired Vx77 indeed.", None), ("Vx 9", None)])
    assert counts.tolist() == [1, 0] and pattern[0] // 4**2 % 4 == 2
