import pytest

from lumenveil.operators.references import orphan_references

REFS = "ref int, scan long, id string, at long, first string, open int, why string"
TARGETS = "scan long, id string, lf long, lt long, row string"
KEYS = dict(keys=["scan", "id"], required=["id"], at="at", live_from="lf", live_to="lt")


def run(spark, refs, targets, match="simple"):
    r = spark.createDataFrame([(*x, "f", 1, "old") for x in refs], REFS)
    t = spark.createDataFrame([(*x, "extra") for x in targets], TARGETS)
    out = orphan_references(r, t, match=match, **KEYS)
    assert out.columns == ["ref", "scan", "id", "at", "first", "open", "why"]
    return {(x["ref"], x["why"]) for x in out.collect()}


def test_reasons(spark):
    targets = [(1, "a", 10, None), (1, "b", 10, 20), (1, "b", 20, 30), (1, "c", 10, 20), (1, "c", 50, None), (1, "a", 10, None)]
    refs = [(1, 1, "a", 10), (2, 1, "a", 9), (3, 1, "b", 20), (4, 1, "b", 30), (5, 1, "c", 30), (6, 1, "c", 50), (7, 1, "zz", 5), (8, 2, "a", 20), (9, 1, None, 5), (10, 1, "zz", None), (11, 1, "a", None)]
    assert run(spark, refs, targets) == {(2, "late"), (4, "deleted"), (5, "deleted"), (7, "missing"), (8, "missing"), (10, "missing")}


@pytest.mark.parametrize("match,want", [("simple", set()), ("partial", {(2, "missing"), (3, "late")}), ("full", {(1, "incomplete"), (2, "incomplete"), (3, "incomplete")})])
def test_match_semantics_of_partial_nulls(spark, match, want):
    assert run(spark, [(1, None, "a", 15), (2, None, "q", 15), (3, None, "a", 5)], [(7, "a", 10, None)], match) == want


def test_empty_and_unknown_match(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, 1, "a", 1)], []) == {(1, "missing")}
    with pytest.raises(ValueError):
        run(spark, [], [], "none")


def test_hot_target_with_many_versions(spark):
    targets = [(1, "h", 10 * i, 10 * i + 5) for i in range(2000)]
    refs = [(i, 1, "h", i) for i in range(0, 1000)]
    assert run(spark, refs, targets) == {(i, "deleted") for i in range(1000) if i % 10 >= 5}
