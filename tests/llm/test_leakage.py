import random

import pytest

from lumenveil.llm.leakage import leaked_items, same_word
from lumenveil.llm.words import masked_windows, normalise, word_batch, words_of

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(RNG.randint(3, 9))) for _ in range(600)]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


SHARED = text(14, 999)
ITEMS = {i: (SHARED if i % 3 == 0 else []) + text(40, i) for i in range(1, 13)}
DOCS = "doc_id long, text string, item_id long, words string, h long"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, " ".join(w), 5) for i, w in ITEMS.items()] + [(50, None, 1), (None, "x", 1), (1, " ".join(ITEMS[1]), 5), (51, "", 2)]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, "w", 2) for i, t in texts.items()], DOCS)


def filler(seed):
    return " ".join(text(60, 10_000 + seed))


def test_passages(spark, items):
    exact = ITEMS[2][5:30]
    noisy = list(ITEMS[4][3:38])
    noisy[6] = noisy[6][:-1] + "q"
    noisy.insert(15, "also")
    del noisy[24]
    marked = ["**" + w.upper() + "**" if k % 4 == 0 else w for k, w in enumerate(ITEMS[5][0:26])]
    texts = {
        1: filler(1) + " " + " ".join(exact) + ". " + filler(2),
        2: filler(3) + "\n> " + "\n> ".join([" ".join(noisy[k : k + 7]) for k in range(0, len(noisy), 7)]),
        3: " ".join(marked) + "&nbsp;",
        4: " ".join(ITEMS[7][4:21]) + " " + filler(4),  # 17 words only
        5: " ".join(SHARED + ITEMS[3][14:22]),  # shared wording and 8 words
        6: " ".join(w.replace("o", "о") for w in ITEMS[8][2:30]),  # Cyrillic o
        7: "\\n".join(" ".join(ITEMS[10][k : k + 5]) for k in range(0, 30, 5)),
        8: None,
        9: "",
        10: " ".join(x if k % 4 else "other" for k, x in enumerate(ITEMS[11])),  # every fourth word replaced
        11: "​".join(ITEMS[1][0][j : j + 1] for j in range(len(ITEMS[1][0]))) + " " + " ".join(ITEMS[1][1:30]),
        12: " ".join(ITEMS[12]) * 1 + " " + filler(9) * 300,
    }
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(docs(spark, texts), items).collect()}
    assert got == {(1, 2), (2, 4), (3, 5), (6, 8), (7, 10), (11, 1), (12, 12)}


def test_items_listed_twice_are_all_found(spark, items):
    texts = {i: filler(i) + " " + " ".join(ITEMS[i][2:32]) for i in (1, 2, 4, 5)}
    twice = items.unionByName(items.where("item_id < 50").selectExpr("item_id + 100 AS item_id", "upper(text) AS text", "doc_id"))
    assert {(d, i) for d, i, _ in leaked_items(docs(spark, texts), twice).collect()} == {(i, i + k) for i in texts for k in (0, 100)}


def test_replaced_words(spark, items):
    two, many = list(ITEMS[2]), list(ITEMS[4])
    two[13] = two[27] = "replacedword"
    many[5::6] = ["replacedword"] * len(many[5::6])  # a template with other fillers
    found = leaked_items(docs(spark, {1: filler(1) + " " + " ".join(two) + " " + filler(2), 2: " ".join(many)}), items).collect()
    assert [tuple(r) for r in found] == [(1, 2, 40)]


def test_wording_shared_in_short_runs_counts(spark):
    a, b, c = text(9, 501), text(9, 502), text(9, 503)
    wordings = {1: a + b + c, 2: a + text(10, 504), 3: text(8, 505) + b, 4: c + text(9, 506)}  # every run of item 1 stands in another item too
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in wordings.items()], "item_id long, text string")
    found = leaked_items(docs(spark, {7: filler(3) + " " + " ".join(a + b + c)}), items).collect()
    assert [tuple(r) for r in found] == [(7, 1, 27)]


def test_empty_tables(spark, items):
    none = docs(spark, {}) if False else spark.createDataFrame([], DOCS)
    assert leaked_items(none, items).count() == 0
    assert leaked_items(docs(spark, {1: filler(1)}), items.where("false")).count() == 0


def test_long_repetitive_text(spark, items):
    texts = {1: " ".join((ITEMS[2][:9] + ["x1", "y2", "z3"]) * 3000 + ITEMS[2][3:30])}
    assert [tuple(r) for r in leaked_items(docs(spark, texts), items).collect()] == [(1, 2, 27)]


@pytest.mark.parametrize("a,b,want", [("word", "word", True), ("word", "wrod", True), ("word", "wor", True), ("word", "wordx", True), ("word", "ward", True), ("cat", "dog", False), ("12", "13", False), ("a", "b", False), ("abcd", "dcba", False)])
def test_same_word(a, b, want):
    assert same_word(a, b) is want and same_word(b, a) is want


def test_word_hashes_agree_with_words():
    raw = ["Hello, World! x1_y2", "", "Grüße aus—Köln", "a" * 5000 + " b", "hello world"]
    normal = [normalise(t) for t in raw]
    batch = word_batch(normal)
    for k, t in enumerate(normal):
        mine = [batch.slice(i, i) for i in range(len(batch.start)) if batch.text[i] == k]
        assert mine == words_of(t)
    assert batch.value[0] == batch.value[[i for i in range(len(batch.text)) if batch.text[i] == 4][0]]
    at, h = masked_windows(batch, (0, 1), 0)
    assert all(batch.text[i] == batch.text[i + 1] for i in at) and len(at) == len(h)


def test_seeds_that_repeat_within_an_item(spark):
    p, x = [f"passage{i}x" for i in range(20)], [f"other{i}y" for i in range(30)]
    item = [*p[:12], *x[:10], *p[5:], *x[10:20], *p, *x[20:]]  # every seed of the passage stands earlier, in a shorter stretch
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    doc = [f"noise{i}z" for i in range(9)] + p + [f"noise{i}w" for i in range(9)]
    docs = spark.createDataFrame([(5, " ".join(doc))], "doc_id long, text string")
    assert [tuple(r) for r in leaked_items(docs, items).collect()] == [(5, 1, 20)]


def test_two_letter_words_with_swapped_letters():
    assert same_word("of", "fo") and not same_word("of", "if") and not same_word("12", "21")
