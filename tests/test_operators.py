"""Row-level tests of joins, roll-ups, windows, graphs and evaluation on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import camel_parts, is_external_url, lookup_keys, service_key, short_id
from lumenveil.functions.lines import brace_delta, exploded_lines
from lumenveil.functions.text import loose_id, relative_path, status_label
from lumenveil.operators.aggregates import majority, merged_bags, pairwise_grouping, zero_filled_counts
from lumenveil.operators.evaluation import scores, unambiguous_pairs
from lumenveil.operators.graphs import distances, insert_missing_edges
from lumenveil.operators.joins import asof_join, first_match_join, longest_prefix_join, nearest_span_join, overlap_join
from lumenveil.operators.windows import stable_ids


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw,want",
    [("./a//b", "a/b"), ("a\\b", "a/b"), ("/a/./b/", "a/b"), ("x/../a", "a"), ("../a", "a"), ("", None), (None, None), (".", None), ("a/b.c", "a/b.c"), ("a/..b/c..", "a/..b/c..")],
)
def test_relative_path(spark, raw, want):
    assert value(spark, relative_path(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("In Progress", "in_progress"), ("in-progress ", "in_progress"), ("InProgress", "in_progress"), ("OPEN", "open"), (" ", None), (None, None)])
def test_status_label(spark, raw, want):
    assert value(spark, status_label(F.lit(raw).cast("string"))) == want


def test_identifiers(spark):
    assert value(spark, camel_parts(F.lit("userHTTPServer_id-x"))) == ["user", "http", "server", "id", "x"]
    assert value(spark, lookup_keys(F.lit("userEmail")))[0] == "useremail"
    assert value(spark, loose_id(F.lit("  A b "))) == "a b"
    assert value(spark, service_key(F.lit("www.api.shop.com"))) == "shop.com"
    assert value(spark, short_id("x_", F.lit("k"))).startswith("x_")
    assert value(spark, is_external_url(F.lit("https://api.stripe.com/v1"))) is True
    for private in ("http://localhost:80", "http://10.0.0.1/x", "https://${HOST}/x", "ftp://a.b", None):
        assert value(spark, is_external_url(F.lit(private).cast("string"))) is False


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None)], "id int, content string")
    assert sorted((r["id"], r["line_no"], r["line"]) for r in exploded_lines(df, ["id"]).collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]
    assert value(spark, brace_delta(F.lit("x = {'}': \"{{\"} {"))) == 1


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    a = [(i, rng.choice("xy"), s := rng.randint(1, 900), s + rng.randint(0, 400)) for i in range(60)]
    b = [(i, rng.choice("xyz"), s := rng.randint(1, 900), s + rng.randint(0, 300)) for i in range(60)] + [(99, "x", None, 5), (98, None, 1, 5)]
    left = spark.createDataFrame(a, "i int, k string, lo int, hi int")
    right = spark.createDataFrame(b, "j int, k string, rlo int, rhi int")
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ["k"], ("lo", "hi"), ("rlo", "rhi"), width=64).collect())
    want = sorted((i, j) for i, k, lo, hi in a for j, q, rlo, rhi in b if k == q and rlo is not None and lo <= rhi and rlo <= hi)
    assert got == want


def test_asof_join_against_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.choice("xyw"), rng.randint(0, 300)) for i in range(80)]
    b = [(rng.choice("xyz"), rng.randint(0, 300), i) for i in range(40)]
    out = asof_join(spark.createDataFrame(a, "i int, k string, at long"), spark.createDataFrame(b, "k string, rat long, v int"), ["k"], "at", "rat", ["v"], block=50)
    got = {r["i"]: r["v"] for r in out.collect()}
    for i, k, at in a:
        before = [(t, v) for q, t, v in b if q == k and t <= at]
        assert got[i] == (max(before)[1] if before else None)
    assert len(got) == len(a)


def test_longest_prefix_nearest_and_first_match(spark):
    files = spark.createDataFrame([(1, "a/b/c.py"), (1, "a/x.py"), (1, "z.py"), (2, "a/b/c.py")], "s int, path string")
    sections = spark.createDataFrame([(1, "", "root"), (1, "a", "A"), (1, "a/b", "AB")], "s int, dir string, name string")
    got = {(r["s"], r["path"]): r["name"] for r in longest_prefix_join(files, sections, ["s"], "path", "dir", "name").collect()}
    assert got == {(1, "a/b/c.py"): "AB", (1, "a/x.py"): "A", (1, "z.py"): "root", (2, "a/b/c.py"): None}
    hits = spark.createDataFrame([("f", 5), ("f", 50), ("g", 1)], "k string, line int")
    spans = spark.createDataFrame([("f", 1, 10, "outer"), ("f", 4, 6, "inner"), ("f", 60, 61, "far")], "k string, lo int, hi int, name string")
    near = {(r["k"], r["line"]): (r["name"], r["distance"]) for r in nearest_span_join(hits, spans, ["k"], "line", ("lo", "hi"), "name").collect()}
    assert near == {("f", 5): ("inner", 0), ("f", 50): ("far", 10), ("g", 1): (None, None)}
    rules = spark.createDataFrame([(2, "ab"), (1, "b")], "pos int, part string")
    rows = spark.createDataFrame([("abc",), ("zzz",)], "name string")
    first = {r["name"]: r["part"] for r in first_match_join(rows, rules, F.col("name").contains(F.col("part")), "pos", ["part"], ["name"]).collect()}
    assert first == {"abc": "b", "zzz": None}


def test_rollups(spark):
    df = spark.createDataFrame([("s", "g1", "p1"), ("s", "g1", "p1"), ("s", "g1", "p2"), ("s", "g2", "p1"), ("s", "g2", None), ("s", None, "p1")], "scope string, gold string, predicted string")
    r = pairwise_grouping(df, ["scope"], "gold", "predicted").first()
    assert (r["gold_pairs"], r["predicted_pairs"], r["joint_pairs"]) == (4, 3, 1)
    counts = {r["c"]: r["n"] for r in zero_filled_counts(spark.createDataFrame([("a",), ("a",), ("q",)], "c string"), "c", ["a", "b"]).collect()}
    assert counts == {"a": 2, "b": 0}
    votes = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in majority(votes, ["k"], "v").collect()] == [(1, "a", 1)]
    bags = spark.createDataFrame([(1, 1, {"n": "x"}), (1, 2, {"n": "y", "m": "z"}), (1, 3, {"n": "x"})], "k int, o int, bag map<string,string>")
    assert {r["name"]: r["values"] for r in merged_bags(bags, ["k"], "bag", "o").collect()} == {"n": ["x", "y"], "m": ["z"]}


def test_graphs(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "a", "z")], "s int, source string, target string")
    starts = spark.createDataFrame([(1, "a")], "s int, node string")
    assert {r["node"]: r["distance"] for r in distances(edges, starts, ["s"]).collect()} == {"a": 0, "b": 1, "c": 2}
    wanted = spark.createDataFrame([(1, "a", "b"), (1, "a", "q"), (1, "a", "q")], "s int, source string, target string")
    added = insert_missing_edges(edges, wanted, ["s", "source", "target"])
    assert added.count() == 5 and added.where("synthetic").count() == 1


def test_distances_follow_a_long_chain_to_its_end(spark):
    edges = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(70)], "s string, source string, target string").coalesce(1)
    starts = spark.createDataFrame([("g", "n0")], "s string, node string")
    assert {r["node"]: r["distance"] for r in distances(edges, starts, ["s"]).collect()} == {f"n{i}": i for i in range(71)}


def test_evaluation(spark):
    pairs = spark.createDataFrame([("g1", 1), ("g1", 1), ("g2", 2), ("g2", 3), ("g3", 4), ("g4", 4)], "g string, f int")
    assert [tuple(r) for r in unambiguous_pairs(pairs, "g", "f").collect()] == [("g1", 1)]
    gold = spark.createDataFrame([("r", "g1"), ("r", "g2")], "repo string, g string")
    found = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("q", 3, False)], "repo string, f int, sc boolean")
    out = {r["repo"]: r for r in scores(gold, found, unambiguous_pairs(pairs, "g", "f"), ["repo"], "g", "f", F.col("sc")).collect()}
    assert out["r"]["recall"] == 0.5 and out["r"]["precision"] == 1.0 and "q" not in out


@pytest.mark.parametrize("parts", [1, 17])
def test_ids_do_not_depend_on_partitioning(spark, parts):
    rows = spark.createDataFrame([(i, f"k{i % 5}") for i in range(40)], "i int, k string").repartition(parts)
    ids = {r["i"]: r["stable_id"] for r in stable_ids(rows, "id_", F.col("k"), [F.col("i")]).collect()}
    assert len(set(ids.values())) == 40 and ids[5] == ids[0] + "_2" and "_" not in ids[1][3:]
