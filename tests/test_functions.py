import pytest
from pyspark.sql import functions as F

from lumenveil.functions.comments import blank_comments, without_comments
from lumenveil.functions.conditions import apply_rules, compile_condition
from lumenveil.shipping import ship_package


@pytest.mark.parametrize(
    "language,text,want",
    [
        ("typescript", "a // x\n'// s' /* y\nz */ b", "a     \n'// s'     \n     b"),
        ("go", "`// raw` // c", "`// raw`     "),
        ("python", 'x = "# no"  # yes\n', 'x = "# no"       \n'),
        ("python", 'def f():\n    """doc\n    more"""\n    return """kept"""\n', 'def f():\n          \n           \n    return """kept"""\n'),
        ("json", '{"a": "// x"}', '{"a": "// x"}'),
        ("java", "/* open", "       "),
        ("", "", ""),
    ],
)
def test_blank_comments(language, text, want):
    got = blank_comments(text, language)
    assert got == want and len(got) == len(text) and got.count("\n") == text.count("\n")


def test_without_comments_on_columns(spark):
    ship_package(spark)
    df = spark.createDataFrame([("a // b", "go"), (None, "go"), ("x", None)], "t string, l string")
    assert [r["c"] for r in df.select(without_comments(F.col("t"), F.col("l")).alias("c")).collect()] == ["a     ", None, "x"]


def test_conditions(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "z"), (3, "xyz", "z")], "i int, a string, b string")

    def hit(spec):
        return [r["i"] for r in df.where(compile_condition(spec)).orderBy("i").collect()]

    assert hit({"always": True}) == [1, 2, 3] and hit({"exists": "a"}) == [1, 3] and hit({"notSet": "b"}) == [1]
    assert hit({"equals": ["b", "z"]}) == [2, 3] and hit({"regex": ["a", "^a"]}) == [1] and hit({"not": {"regex": ["a", "^a"]}}) == [2, 3]
    assert hit({"anyOf": [{"regex": ["a", "c$"]}, {"equals": ["i", 2]}]}) == [1, 2] and hit({"allOf": [{"exists": "a"}, {"exists": "b"}]}) == [3] and hit({"anyOf": []}) == []
    with pytest.raises(ValueError):
        compile_condition({"maybe": 1})


def test_rules_run_in_order_and_keep_what_is_set(spark):
    df = spark.createDataFrame([("pg", "x"), ("zz", "y")], "engine string, other string")
    rules = [
        {"when": {"exists": "engine"}, "set": {"db": {"lookup": ["engine", {"pg": "postgresql"}]}}},
        {"when": {"notSet": "db"}, "set": {"db": {"from": "other"}}},
        {"when": {"always": True}, "set": {"db": {"const": "never"}, "seen": {"const": "1"}}},
    ]
    assert [(r["db"], r["seen"]) for r in apply_rules(df, rules, ["db", "seen"]).collect()] == [("postgresql", "1"), ("y", "1")]
