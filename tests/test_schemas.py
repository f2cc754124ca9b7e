import pytest
from pyspark.sql import functions as F

from lumenveil.functions.text import is_contract_path, same_file, typed_flow_key
from lumenveil.sources.schemas import schema_columns
from lumenveil.sources.terraform import resource_hints, terraform_blocks, terraform_references

FILES = "repo string, path string, content string"


def test_schema_columns(spark):
    files = {
        "a.sql": 'CREATE TABLE IF NOT EXISTS "public"."users" (\n  id bigint PRIMARY KEY,\n  "email" varchar(200) NOT NULL,\n  PRIMARY KEY (id)\n);\nALTER TABLE users ADD COLUMN dob date;\nCREATE TABLE t_scratch (\n  x text\n);\n',
        "schema.prisma": "model User {\n  id    Int @id\n  email String?\n  @@index([email])\n}\n",
        "db/migrate/1_x.rb": "create_table :people do |t|\n  t.string :surname\n  t.index :surname\nend\nadd_column :people, :phone, :string\n",
        "database/migrations/x.php": "Schema::create('orders', function ($table) {\n  $table->string('iban');\n  $table->timestamps();\n});\n",
        "src/x.py": "CREATE TABLE no (a text)\n",
    }
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()], FILES)
    got = {(r["kind"], r["table_name"], r["column"], r["line_no"]) for r in schema_columns(df).collect()}
    assert got == {
        ("sql", "users", "id", 2), ("sql", "users", "email", 3), ("prisma", "User", "id", 2), ("prisma", "User", "email", 3),
        ("rails", "people", "surname", 2), ("rails", "people", "phone", 5), ("laravel", "orders", "iban", 2),
    }


TF = """# a comment {
resource "aws_s3_bucket" "data" {
  bucket = "x"
  tags = {
    a = "}"
  }
}

resource "aws_lambda_function" "fn" {
  env  = aws_s3_bucket.data.id
  role = var.aws_role.x
  key  = data.aws_kms_key.k.arn
  up   = module.net.vpc
}
data "aws_kms_key" "k" {}
module "net" { source = "./net" }
provider "aws" {
"""


def test_terraform(spark):
    blocks = terraform_blocks(spark.createDataFrame([("r", "main.tf", TF), ("r", "x.py", TF)], FILES))
    got = {r["address"]: (r["kind"], r["start_line"], r["end_line"]) for r in blocks.collect()}
    assert got["aws_s3_bucket.data"] == ("resource", 2, 7) and got["aws_lambda_function.fn"] == ("resource", 9, 14)
    assert set(got) == {"aws_s3_bucket.data", "aws_lambda_function.fn", "data.aws_kms_key.k", "module.net", "provider.aws"}
    refs = {(r["source"], r["target"]) for r in terraform_references(blocks).collect()}
    assert refs == {("aws_lambda_function.fn", t) for t in ("aws_s3_bucket.data", "data.aws_kms_key.k", "module.net")}
    hints = spark.createDataFrame([(2, "aws_", "other"), (1, "aws_s3_", "object_storage")], "position int, prefix string, subtype string")
    assert {r["address"]: r["subtype"] for r in resource_hints(blocks, hints).collect()} == {"aws_s3_bucket.data": "object_storage", "aws_lambda_function.fn": "other"}


@pytest.mark.parametrize("path,ok", [("a/b.ts", True), ("", False), ("/a", False), ("C:/a", False), ("a/../b", False), ("a//b", False), ("a\\b", False), ("a/", False), (None, False)])
def test_contract_paths(spark, path, ok):
    assert spark.range(1).select(is_contract_path(F.lit(path).cast("string")).alias("v")).first()["v"] is ok


def test_flow_keys_and_same_file(spark):
    df = spark.createDataFrame([("flow:actor:user->asset:db:main",), ("flow:x:a->asset:b",), (None,)], "k string")
    got = [r["v"] for r in df.select(typed_flow_key(F.col("k")).alias("v")).collect()]
    assert tuple(got[0]) == ("actor", "user", "asset", "db:main") and got[1:] == [None, None]
    pairs = spark.createDataFrame([("a/b.c", "b.c"), ("b.c", "x/b.c"), ("ab.c", "b.c"), ("a", "a")], "a string, b string")
    assert [r["v"] for r in pairs.select(same_file(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False, True]
