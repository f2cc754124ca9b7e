from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenveil.operators.intervals import cover_and_gaps, merge_intervals

SCHEMA = "key string, other int, lo int, hi int, _b int, _lo string, from_pos int"


def brute(rows):
    """Lines one by one."""
    lines = {}
    for key, lo, hi in rows:
        if lo is not None and hi is not None and hi >= lo:
            lines.setdefault(key, set()).update(range(lo, hi + 1))
    out = set()
    for key, have in lines.items():
        ordered = sorted(have)
        start = previous = ordered[0]
        for x in ordered[1:]:
            if x != previous + 1:
                out.add((key, "covered", start, previous))
                out.add((key, "gap", previous + 1, x - 1))
                start = x
            previous = x
        out.add((key, "covered", start, previous))
    return out


span = st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(1, 60)), st.one_of(st.none(), st.integers(0, 14)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(span, max_size=25), st.sampled_from([4, 16, 1024]))
def test_against_brute_force(spark, spans, block):
    rows = [(k, lo, None if lo is None or n is None else lo + n) for k, lo, n in spans]
    df = spark.createDataFrame([(k, 1, lo, hi, 7, "x", 9) for k, lo, hi in rows], SCHEMA)
    got = cover_and_gaps(merge_intervals(df, ["key"], "lo", "hi", block=block), ["key"]).collect()
    assert len(got) == len(set(got))
    assert {(r["key"], r["piece"], r["from_pos"], r["to_pos"]) for r in got} == brute(rows)


def test_touching_nested_repeated_and_empty(spark):
    rows = [("a", 1, 1, 5, 0, "", 0), ("a", 1, 6, 6, 0, "", 0), ("a", 1, 2, 3, 0, "", 0), ("a", 1, 2, 3, 0, "", 0), ("a", 1, 9, 8, 0, "", 0)]
    got = merge_intervals(spark.createDataFrame(rows, SCHEMA), ["key"], "lo", "hi").collect()
    assert [(r["from_pos"], r["to_pos"], r["prev_to"]) for r in got] == [(1, 6, None)]
    assert merge_intervals(spark.createDataFrame([], SCHEMA), ["key"], "lo", "hi").count() == 0


def test_one_key_with_most_rows_is_split(spark):
    df = spark.range(20_000).selectExpr("'hot' AS key", "CAST(id * 3 AS INT) AS lo", "CAST(id * 3 + 1 AS INT) AS hi")
    merged = merge_intervals(df, ["key"], "lo", "hi", block=256)
    assert merged.count() == 20_000
    assert merged.where("prev_to = from_pos - 2").count() == 19_999


def test_large_positions(spark):
    df = spark.createDataFrame([("a", 1 << 50, (1 << 50) + 10), ("a", (1 << 50) + 11, (1 << 50) + 20)], "key string, lo long, hi long")
    assert merge_intervals(df, ["key"], "lo", "hi", block=86_400_000_000).collect()[0]["to_pos"] == (1 << 50) + 20
