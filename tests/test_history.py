from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lumenveil.operators.history import latest, periods


def brute(rows):
    out = []
    for entity in {e for e, _, _ in rows}:
        ordered = sorted((t, p) for e, t, p in rows if e == entity)
        runs = []
        for t, p in ordered:
            if not runs or runs[-1][1] != p:
                runs.append((t, p))
        for (t, p), nxt in zip(runs, [*[r[0] for r in runs[1:]], None]):
            out.append((entity, p, t, nxt))
    return sorted(out, key=repr)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(st.tuples(st.sampled_from("abc"), st.integers(0, 80)), st.sampled_from(["x", "y", None]), max_size=60),
    st.sampled_from([1, 2, 7]),
)
def test_against_brute_force(spark, observations, fan_bits):
    rows = [(e, t, p) for (e, t), p in observations.items()]
    df = spark.createDataFrame(rows, "who string, at long, what string").withColumnsRenamed({})
    got = periods(df, "who", "at", "what", fan_bits=fan_bits).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_hot_entity_spans_partitions(spark):
    df = spark.range(3000).selectExpr("'hot' AS who", "id AS at", "CAST(id DIV 10 % 2 AS STRING) AS what", "1 AS _e", "2 AS _b")
    got = periods(df, "who", "at", "what", fan_bits=3).orderBy("valid_from").collect()
    assert len(got) == 300
    assert all(a["valid_to"] == b["valid_from"] for a, b in zip(got, got[1:])) and got[-1]["valid_to"] is None


def test_nulls_and_empty(spark):
    schema = "who string, at long, what string"
    assert periods(spark.createDataFrame([], schema), "who", "at", "what").count() == 0
    rows = [(None, 1, "x"), ("a", None, "x"), ("a", 2, None), ("a", 3, None)]
    assert [tuple(r) for r in periods(spark.createDataFrame(rows, schema), "who", "at", "what").collect()] == [("a", None, 2, None)]


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "b"), ("k", None, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {tuple(r) for r in latest(df, ["k"], ["t"]).collect()} == {("k", 1, "b"), (None, 1, "n")}
