import random

import pytest

from lumenveil.workspace import Workspace
from lumenveil.llm.reading import LevelRule, agreed_levels, coverage_ranks, p9_levels, prose, prose_features, reading_levels, word_ranks
from lumenveil.shipping import ship_package

EASY = "the dog ran to the red house and then it sat down by the old door for a while".split()
HARD = "institutional accountability necessitates comprehensive administrative documentation because jurisdictional interpretation incorporates considerable inconsistencies".split()


def sentences(words, n, seed, length):
    r = random.Random(seed)
    return " ".join(" ".join(r.choice(words) for _ in range(length)).capitalize() + "." for _ in range(n))


DOCS = "doc_id long, text string, english string, words string, level int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, rater string, level int")


def corpus():
    easy = [(i, sentences(EASY, 8, i, 7 + i % 3)) for i in range(1, 21)]
    hard = [(i, sentences(HARD + EASY[:3], 8, i, 12 + i % 5)) for i in range(21, 41)]
    return easy + hard


def rated(spark):
    rows = [(i, r, 1 + (i % 2)) for i in range(1, 16) for r in ("a", "b")] + [(i, "a", 4 + (i % 2)) for i in range(21, 36)]
    rows += rows[:5] + [(3, "c", None), (4, "d", 9), (None, "a", 1), (999, "a", 5)]
    return labels(spark, rows)


def test_levels_separate(spark):
    extra = [
        (50, None), (51, ""), (52, "```\nint x = 1;\n```"), (53, "| a | b |\n| - | - |"),
        (54, sentences(EASY, 9, 5, 8) + "\n\n```\n" + sentences(HARD, 30, 1, 12) + "\n```\n\n- " + "\n- ".join(HARD * 4)),
        (55, sentences(EASY, 12, 6, 8) + "\n\n" + sentences(HARD, 1, 2, 14)),
        (56, sentences(HARD + EASY[:3], 8, 77, 14).replace(".", "").lower()),
        (57, "Der Hund und die Katze sind nicht im Haus, weil sie von der Straße zu dem Garten gehen und das auch noch bei Regen. " * 4),
        (58, sentences(EASY, 8, 9, 8).replace("o", "о")),
    ]
    got = {r["doc_id"]: r for r in reading_levels(frame(spark, corpus() + extra), rated(spark)).collect()}
    assert len(got) == 49
    assert all(got[i]["level"] < 3 for i in range(1, 21)) and all(got[i]["level"] > 3.5 for i in range(21, 41))
    assert all(got[i]["level"] is None and got[i]["n_words"] == 0 for i in (50, 51, 52, 53))
    assert got[54]["level"] < 3.5 and got[55]["level"] < 3.5 and got[56]["level"] > 3.5
    assert got[57]["english"] is False and got[57]["level"] is None
    assert got[58]["english"] is True


def test_coverage_rank_against_brute_force(spark):
    import math
    from collections import Counter

    ship_package(spark)
    rule = LevelRule()
    rows = corpus()
    features = prose_features(frame(spark, rows), rule)
    words = {i: prose(t).lower().replace(".", "").split() for i, t in rows}
    counts = Counter(w for ws in words.values() for w in ws)
    rank = {w: sum(1 for c in counts.values() if c >= n) for w, n in counts.items()}
    want = {i: sorted(rank[w] for w in ws)[math.ceil(rule.share * len(ws)) - 1] for i, ws in words.items()}
    for head in (65_536, 5):  # with the whole vocabulary in memory, and with the join for rarer words
        r = LevelRule(head=head)
        got = {x["doc_id"]: x["coverage_rank"] for x in coverage_ranks(features, word_ranks(features), r, Workspace(spark, "t")).collect()}
        assert got == want


def test_few_labels_and_empty_tables(spark):
    few = reading_levels(frame(spark, corpus()), labels(spark, [(1, "a", 1)])).collect()
    assert len(few) == 40 and all(r["level"] is None for r in few)
    assert reading_levels(frame(spark, []), rated(spark)).count() == 0


def test_agreed_levels(spark):
    rows = [(1, "a", 2), (1, "a", 2), (1, "b", 4), (1, "c", 5), (2, "a", None), (3, "a", 0)]
    assert [tuple(r) for r in agreed_levels(labels(spark, rows)).collect()] == [(1, 4.0)]


@pytest.mark.parametrize("text,want", [("# Title\n\nThis is the text of it.", "This is the text of it."), ("> quoted words are not counted here", ""), ("1. one item of a list\n2) two items of it", ""), ("see src/a/b.ts and loadUserName then go on", "see  and  then go on"), ("", "")])
def test_prose(text, want):
    assert prose(text) == want


def test_held_out_accuracy(spark, data):
    """Levels agree with the median rater on which side of level 4 a document lies."""
    data = data.replace("sf0.001", "sf0.01")
    raters = {r["doc_id"]: r["agreed"] for r in agreed_levels(spark.read.parquet(f"{data}/reading_labels.parquet")).collect()}
    got = {r["doc_id"]: r["level"] for r in p9_levels(spark, data).collect() if r["level"] is not None}
    both = [d for d in raters if d in got]
    right = sum((got[d] >= 3.5) == (raters[d] >= 3.5) for d in both)
    assert len(both) >= 12 and right >= 0.85 * len(both)
