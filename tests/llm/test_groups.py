import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lumenveil.llm.groups import contract, linked_groups, star_edges
from lumenveil.llm.pii_groups import P3_SQL, hit_links, loose_key, p3_found
from lumenveil.workspace import Workspace


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {(find(x), x) for x in list(parent)}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 40)), st.integers(0, 40)), max_size=50))
def test_against_union_find(spark, pairs):
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = [tuple(r) for r in linked_groups(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == components(pairs)


def test_long_chain_and_hot_star(spark):
    chain = [(i, i + 1) for i in range(400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    shuffled = chain + star
    random.Random(3).shuffle(shuffled)
    got = {tuple(r) for r in linked_groups(spark.createDataFrame(shuffled, "a long, b long")).collect()}
    assert got == components(shuffled)


def test_star_edges(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "x"), (2, "x"), (9, "y")], "m long, k string")
    assert {tuple(r) for r in star_edges(rows, "m", ["k"]).collect()} == {(3, 1), (2, 1)}


HITS = "hit_id long, scan_id long, signal_id string, file_path string, hit_group string, group_column string, declaration string, a string, v long, key string"


def place(line, name):
    return json.dumps({"line": line, "kind": "field", "name": name})


def test_hit_matching_rules(spark):
    rows = [
        (1, 1, "email", "a.py", "email:user_contact", None, None),
        (2, 1, "email", "b.py", "EMAIL: UserContact", None, None),
        (3, 1, "email", "b.py", None, '"t"."c"', "unresolved"),
        (4, 1, "email", "c.py", None, "T . C", '"unresolved"'),
        (5, 1, "email", "./d.py", None, "-", place("7", "mail")),
        (6, 1, "email", "x/../d.py", None, "", place(7, "mail")),
        (7, 1, "email", "d.py", None, None, place(7, "Mail")),
        (8, 2, "email", "a.py", "email:user_contact", None, None),
        (9, 1, "phone", "a.py", "email:user_contact", None, None),
        (10, 1, "email", None, None, None, "{broken"),
        (None, 1, "email", "a.py", "email:user_contact", None, None),
        (2, 1, "email", "b.py", "EMAIL: UserContact", None, None),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "z") for r in rows], HITS)
    assert {tuple(r) for r in linked_groups(hit_links(df)).collect()} == {(1, 1), (1, 2), (3, 3), (3, 4), (5, 5), (5, 6)}
    assert linked_groups(hit_links(spark.createDataFrame([], HITS))).count() == 0


@pytest.mark.parametrize("raw", ["", " ", "-", "n/a", "None", "[]", '""', "unresolved", None])
def test_placeholders_match_nothing(spark, raw):
    df = spark.createDataFrame([(raw,)], "g string")
    assert df.select(loose_key(df["g"]).alias("k")).first()["k"] is None


def test_p3_against_sql(same_as_sql):
    assert same_as_sql(p3_found, P3_SQL)


def test_hot_keys_and_vertices_give_the_same_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3_000)]
    df = spark.createDataFrame(rows, "hit long, key string")
    edges = star_edges(df, "hit", ["key"], hot=100)
    ws = Workspace(spark, "hot")
    groups = lambda found: {frozenset(r["m"]) for r in found.groupBy("root").agg(F.collect_set("member").alias("m")).collect()}
    assert groups(contract(edges, ws, hot=100)) == groups(contract(star_edges(df, "hit", ["key"]), Workspace(spark, "cold")))
