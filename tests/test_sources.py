import json

import pytest
from pyspark.sql import functions as F

from lumenveil.operators.graphs import node_link_document
from lumenveil.sources.files import ignore_rules, ignored_paths, path_outcomes, read_tree, schema_file_kind
from lumenveil.sources.graph import read_node_link, write_node_link
from lumenveil.sources.manifests import database_of_connection, declared_packages, pom_packages
from lumenveil.sources.rules import rule_hits, rule_table
from lumenveil.streaming.files import changed_files, current_hits, stream_hits, windowed_counts


def test_read_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.py").write_text("email = 1\n")
    (tmp_path / "z.bin").write_bytes(b"\xff\xfe")
    rows = {r["path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/b/x.py", "z.bin"}
    assert rows["a/b/x.py"]["language"] == "python" and rows["a/b/x.py"]["content"] == "email = 1\n" and rows["a/b/x.py"]["name"] == "x.py"
    assert [r["path"] for r in read_tree(spark, str(tmp_path / "a" / "b" / "x.py")).collect()] == ["x.py"]
    with pytest.raises(FileNotFoundError):
        read_tree(spark, str(tmp_path / "none"))


def test_outcomes(spark):
    rows = [("src/a.ts", 10), ("node_modules/x.js", 10), (".env", 5), ("src/.env.local", 5), ("docs/a.py", 10), ("b.xyz", 1), ("big.py", 3_000_000), ("c.py", 10), ("d.py", 10)]
    out = path_outcomes(spark.createDataFrame(rows, "path string, size long"), exclude=["docs/**"], max_files=2)
    assert {r["path"]: r["reason"] for r in out.collect()} == {
        "src/a.ts": "file_count_cap_reached", "node_modules/x.js": "ignored_by_repository_default_policy", ".env": "sensitive_path_exclusion", "src/.env.local": "sensitive_path_exclusion",
        "docs/a.py": "excluded_by_configured_policy", "b.xyz": "unsupported_file_type_or_language", "big.py": "file_too_large", "c.py": "successfully_processed", "d.py": "successfully_processed",
    }


def test_ignore_rules(spark):
    files = spark.createDataFrame([(".gitignore", "# c\n*.log\n/out/\n!keep.log\n"), ("a/.gitignore", "x?.txt\n**/deep\n")], "path string, content string")
    paths = spark.createDataFrame([(p,) for p in ("e.log", "keep.log", "out/f.py", "a/x1.txt", "b/x1.txt", "a/q/deep", "a/s.py", "sub/e.log")], "path string")
    got = {r["path"] for r in ignored_paths(paths, ignore_rules(files)).where("ignored").collect()}
    assert got == {"e.log", "out/f.py", "a/x1.txt", "a/q/deep"}


def test_packages(spark):
    manifests = {
        "package.json": json.dumps({"name": "x", "dependencies": {"react": "1"}, "devDependencies": {"jest": "2"}}, indent=1),
        "requirements-dev.txt": "# c\nflask>=2\npytest\n-r other.txt\n",
        "go.mod": "module x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n",
        "app/build.gradle": "dependencies {\n  implementation 'org.x:core:1.0'\n}\n",
        "p.csproj": '<PackageReference Include="Newtonsoft.Json" Version="1" />',
        "Gemfile": "gem 'rails', '~> 7'\n",
        "Pipfile": "[[source]]\nurl = \"x\"\n[packages]\nrequests = \"*\"\n[requires]\npython_version = \"3\"\n",
        "composer.json": '{"require": {"monolog/monolog": "2"}}',
        "CMakeLists.txt": "find_package(OpenSSL REQUIRED)\n",
        "broken/package.json": "{",
    }
    df = spark.createDataFrame([("r", p, c) for p, c in manifests.items()], "repo string, path string, content string")
    got = {(r["path"], r["package"]): r["line_no"] for r in declared_packages(df).collect()}
    assert got == {
        ("package.json", "react"): 4, ("package.json", "jest"): 7, ("requirements-dev.txt", "flask"): 2, ("requirements-dev.txt", "pytest"): 3, ("go.mod", "github.com/a/b"): 4,
        ("app/build.gradle", "org.x:core"): 2, ("p.csproj", "Newtonsoft.Json"): 1, ("Gemfile", "rails"): 1, ("Pipfile", "requests"): 4, ("composer.json", "monolog/monolog"): None, ("CMakeLists.txt", "OpenSSL"): 1,
    }
    pom = spark.createDataFrame([("r", "pom.xml", "<dependency>\n<groupId>g</groupId>\n<artifactId>a</artifactId></dependency>")], "repo string, path string, content string")
    assert pom_packages(pom).first()["package"] == "g:a"


def test_graph_round_trip(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A"}, {"id": "b"}, {"label": "no id"}], "edges": [{"source": "a", "target": "b", "relation": "calls"}, {"source": None, "target": "b"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc))
    nodes, links = read_node_link(spark, str(tmp_path / "g.json"))
    assert {r["id"] for r in nodes.collect()} == {"a", "b"} and links.count() == 1
    out = node_link_document(nodes.withColumn("scan", F.lit(1)), links.withColumn("scan", F.lit(1)), "scan")
    write_node_link(out, str(tmp_path / "out"))
    kinds = spark.read.text(str(tmp_path / "out")).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"node": 2, "link": 1}


@pytest.mark.parametrize("path,kind", [("a/schema.prisma", "prisma"), ("db/migrate/1_x.rb", "rails"), ("database/migrations/x.php", "laravel"), ("q.sql", "sql"), ("x.rb", None)])
def test_schema_files(spark, path, kind):
    assert spark.range(1).select(schema_file_kind(F.lit(path)).alias("k")).first()["k"] == kind


def test_connections(spark):
    df = spark.createDataFrame([("jdbc:postgresql://h/db",), ("Server=x;Initial Catalog=y",), ("nothing",), (None,)], "v string")
    assert [r["k"] for r in df.select(database_of_connection(F.col("v")).alias("k")).collect()] == ["postgresql", "sqlserver", None, None]


def test_rules(spark, tmp_path):
    lines = ["const userEmail = x", "user_name = 1", "e-mail", "mail.to = a", "mail.subject", "the EIN of it", "firstName", "nothing", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["line"]: [h["rule_id"] for h in r["h"]] for r in df.select("line", rule_hits(F.col("line")).alias("h")).collect()}
    assert got["user_name = 1"] == ["username"] and got["the EIN of it"] == ["tax_id"] and got["mail.to = a"] == ["email"] and got["mail.subject"] == []
    assert got["firstName"] == ["first_name"] and got["nothing"] == [] and got[None] == []
    (tmp_path / "r.json").write_text(json.dumps([{"rule_id": "x", "category": "c", "label": "l", "pattern": "p"}]))
    assert rule_table(spark, str(tmp_path / "r.json")).count() == 1 and rule_table(spark).count() == 15


def test_stream_of_changed_files(spark, tmp_path):
    schema = "repo string, path string, content string, ingested_at timestamp"
    source = str(tmp_path / "in")
    first = spark.createDataFrame([("r", "a.py", "email = 1\nphone = 2\n", None), ("r", "b.py", "surname = 1\n", None)], schema)
    first.coalesce(1).write.parquet(source)
    run = lambda: stream_hits(changed_files(spark, source, schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    assert {r["occurrence"] for r in current_hits(spark, str(tmp_path / "out")).collect()} == {"occurrence:email:a.py:1", "occurrence:phone_number:a.py:2", "occurrence:last_name:b.py:1"}
    spark.createDataFrame([("r", "a.py", "nothing\n", None)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r["occurrence"] for r in current_hits(spark, str(tmp_path / "out")).collect()} == {"occurrence:last_name:b.py:1"}


def test_windowed_counts(spark):
    df = spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:50:00", "a"), ("2026-01-01 01:10:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in windowed_counts(df, "t", "k").collect()) == [1, 2]
