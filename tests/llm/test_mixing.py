import math

import pytest

from lumenveil.llm.mixing import MixRule, capped_mean, mixture, parameter_for, shares, steps, token_counts
from lumenveil.shipping import ship_package

DOCS = "doc_id long, text string, source string, copy int, tokens string, place string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y") for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def corpus(n=2000):
    names = ["Wiki", "wiki ", "issue", "guide", None, "other"]
    return [(i, f"text number {i} " * (1 + i % 7), names[i % 6]) for i in range(n)]


def test_shares_and_caps(spark):
    df, want = docs(spark, corpus()), targets(spark, [("wiki", 0.3, 1), ("issue", 0.2, 2), ("guide", 0.5, 4), ("absent", 0.0, 3), ("none", 0.1, 2)])
    got = {r["source"]: r for r in shares(df, want).collect()}
    assert set(got) == {"wiki", "issue", "guide", "absent", "none"}
    for source, share in (("wiki", 0.3), ("issue", 0.2), ("guide", 0.5)):
        assert abs(got[source]["reached_share"] - share) < 0.03
        assert got[source]["most_copies"] <= got[source]["max_repeats"]
    assert got["none"]["drawn_records"] == 0 and got["absent"]["drawn_tokens"] == 0


def test_copies_are_numbered_and_placed(spark):
    rows = mixture(docs(spark, corpus(600)), targets(spark, [("guide", 0.9, 3), ("issue", 0.1, 1)])).collect()
    by: dict[int, list[int]] = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["copy"])
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= 3 for c in by.values())
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
    assert rows[0]["text"].startswith("text number")
    again = mixture(docs(spark, corpus(600)).repartition(7), targets(spark, [("guide", 0.9, 3), ("issue", 0.1, 1)])).collect()
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((r["doc_id"], r["copy"]) for r in again)


def test_total_size(spark):
    rows = mixture(docs(spark, corpus()), targets(spark, [("guide", 1.0, 4)]), MixRule(total_tokens=2000, keep=())).collect()
    assert abs(sum(r["tokens"] for r in rows) - 2000) < 500


@pytest.mark.parametrize("rows", [[], [(1, None, "wiki"), (2, "", "wiki"), (3, "x", None)]])
def test_nothing_to_draw(spark, rows):
    assert mixture(docs(spark, rows), targets(spark, [("wiki", 1.0, 2), (None, 0.5, 1)])).count() == 0
    assert mixture(docs(spark, corpus(10)), targets(spark, [])).count() == 0
    assert mixture(docs(spark, corpus(10)), targets(spark, [("wiki", 1.0, 0), ("issue", None, 2)])).count() == 0


@pytest.mark.parametrize("mean,cap", [(0.2, 1), (0.99, 1), (1.0, 1), (1.3, 2), (3.9, 4), (0.0, 3), (4.0, 4)])
def test_capped_poisson(mean, cap):
    p = steps(mean, cap)
    assert len(p) == cap and all(a <= b for a, b in zip(p, p[1:]))
    # the expected number of steps a uniform number passes is the mean
    assert math.isclose(sum(1 - x for x in p), mean, abs_tol=1e-9)
    rate = parameter_for(mean, cap)
    assert math.isinf(rate) or math.isclose(capped_mean(rate, cap), mean, abs_tol=1e-9)


def test_token_counts_are_of_whole_texts(spark):
    import base64

    import tiktoken

    rule = MixRule(keep=())
    with open(rule.tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("t", pat_str=rule.pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {1: "hello world", 2: "é" * 50_000, 3: "a b " * 20_000, 4: "", 5: None}
    ship_package(spark)
    got = {r["doc_id"]: r["tokens"] for r in token_counts(docs(spark, [(i, t, "s") for i, t in texts.items()]), rule).collect()}
    assert got == {i: len(encoder.encode_ordinary(t)) if t else 0 for i, t in texts.items()}


@pytest.mark.parametrize("mean,cap", [(1000.0, 2000), (900.0, 5000), (0.5, 3), (1999.5, 2000)])
def test_high_rates_reach_their_mean(mean, cap):
    rate = parameter_for(mean, cap)
    assert abs(capped_mean(rate, cap) - mean) < 1e-6 * mean
    found = steps(mean, cap)
    assert len(found) == cap and all(a <= b + 1e-12 for a, b in zip(found, found[1:]))
