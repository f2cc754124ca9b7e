import pytest
from pyspark.sql import functions as F

from lumenveil.sources.aliases import alias_rule
from lumenveil.sources.detectors import DETECTORS, detector_hits

LINES = [
    ("typescript", "const u = process.env.DATABASE_URL", "config", "DATABASE_URL"),
    ("typescript", "import { Pool } from 'pg'", "database", "pg"),
    ("javascript", "router.post('/users/:id', save)", "route", "/users/:id"),
    ("javascript", "const r = await fetch(`https://api.example.com/v1`)", "external", "https://api.example.com/v1"),
    ("typescript", "export const handler = async () => {}", "handler", "handler"),
    ("typescript", "app.use(passport.initialize())", "auth", "passport"),
    ("python", "key = os.environ['API_KEY']", "config", "API_KEY"),
    ("python", "from sqlalchemy import Column", "database", "sqlalchemy"),
    ("python", "def lambda_handler(event, context):", "handler", "lambda_handler"),
    ("python", "@login_required", "auth", "login_required"),
    ("python", "requests.get('https://x.example.org')", "external", "https://x.example.org"),
    ("go", 'v := os.Getenv("TOKEN")', "config", "TOKEN"),
    ("go", 'r.HandleFunc("/health", h)', "route", "/health"),
    ("go", 'rows, err := db.QueryContext(ctx, "SELECT 1")', "database", "SELECT 1"),
    ("java", '@PreAuthorize("hasRole(1)")', "auth", "PreAuthorize"),
    ("java", 'String s = System.getenv("HOME");', "config", "HOME"),
    ("kotlin", '@GetMapping("/k")', "route", "/k"),
    ("csharp", "[Authorize]", "auth", "Authorize"),
    ("csharp", 'var s = Configuration["Db:Host"];', "config", "Db:Host"),
    ("php", "Route::get('/p', 'C@m');", "route", "/p"),
    ("php", "$db = new PDO($dsn);", "database", "PDO"),
    ("php", "$k = getenv('SECRET_KEY');", "config", "SECRET_KEY"),
    ("ruby", "  resources :orders", "route", "orders"),
    ("ruby", "k = ENV.fetch('KEY')", "config", "KEY"),
    ("ruby", "  before_action :authenticate_user!", "auth", "before_action :authenticate_user"),
    ("cpp", "#include <sqlite3.h>", "database", "sqlite3.h"),
    ("cpp", 'const char* t = getenv("TOKEN");', "config", "TOKEN"),
    ("cpp", 'curl_easy_setopt(h, CURLOPT_URL, "http://a.example.com");', "external", "http://a.example.com"),
]


def test_detectors_of_all_languages(spark):
    df = spark.createDataFrame([(i, lang, line) for i, (lang, line, _, _) in enumerate(LINES)], "i int, language string, line string")
    got = {r["i"]: {(h["kind"], h["value"]) for h in r["h"]} for r in df.select("i", detector_hits(df.line, df.language).alias("h")).collect()}
    for i, (_, line, kind, value) in enumerate(LINES):
        assert (kind, value) in got[i], line
    other = df.select(detector_hits(df.line, F.lit("cobol")).alias("h")).where("size(h) > 0")
    assert other.count() == 0 and df.limit(0).select(detector_hits(df.line, df.language)).count() == 0


def test_every_kind_covers_the_languages():
    kinds = {k for k, _, _, _ in DETECTORS}
    assert kinds == {"database", "auth", "config", "route", "external", "handler"}
    for language in ("typescript", "python", "go", "java", "csharp", "php", "ruby", "cpp"):
        assert {k for k, _, langs, _ in DETECTORS if language in langs} >= kinds - {"handler"}


@pytest.mark.parametrize(
    "token,line,rule",
    [
        ("customerEmail", "", "email"), ("recipient_emails", "", "email"), ("billingEmailAddress", "", "email"), ("sendEmail", "", None), ("hide_phone", "", None),
        ("userPass", "", "password"), ("socialSecurityNumber", "", "ssn"), ("address", "x.address()", None), ("address", "  address: string", "address"), ("home_address", "home_address = 1", None),
        ("emailService", "", None), ("x", "", None), ("_", "", None),
    ],
)
def test_aliases(spark, token, line, rule):
    df = spark.createDataFrame([(token, line)], "t string, l string")
    assert df.select(alias_rule(df.t, df.l).alias("r")).first()["r"] == rule
