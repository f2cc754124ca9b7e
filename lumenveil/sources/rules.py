"""Rule catalogs as small tables; built-in personal-data rules and a loader for one's own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenveil.functions.identifiers import ascii_word

#: Personal-data rules (fixed values): id, category, label, pattern.  Patterns ignore letter case and are tried per line.
PERSONAL_DATA_RULES: list[tuple[str, str, str, str]] = [
    ("first_name", "profile_data", "first_name", r"\b(first[_-]?name|firstname|given[_-]?name|forename|f[_-]?name|fname)\b"),
    ("last_name", "profile_data", "last_name", r"\b(last[_-]?name|lastname|family[_-]?name|surname|l[_-]?name|lname)\b"),
    ("full_name", "profile_data", "full_name", r"\b(full[_-]?name|fullname|display[_-]?name|legal[_-]?name|person[_-]?name)\b"),
    ("date_of_birth", "profile_data", "date_of_birth", r"\b(date[_-]?of[_-]?birth|dob|d\.o\.b|birth[_-]?date|birthdate|bday)\b"),
    ("phone_number", "profile_data", "phone_number", r"\b(phone|phone[_-]?number|telephone|tel|mobile|mobile[_-]?number|cell|msisdn)\b"),
    (
        "address",
        "profile_data",
        "address",
        r"\b(street[_-]?address|mailing[_-]?address|home[_-]?address|billing[_-]?address|shipping[_-]?address|postal[_-]?address|zip[_-]?code|postal[_-]?code|postcode)\b",
    ),
    ("ssn", "identifiers", "social_security_number", r"\b(ssn|social[_-]?security[_-]?number|socialsecuritynumber|nin|national[_-]?insurance[_-]?number)\b"),
    ("passport", "identifiers", "passport_number", r"\b(passport[_-]?number|passport[_-]?no|pp[_-]?number|travel[_-]?document[_-]?number)\b"),
    ("national_id", "identifiers", "national_id", r"\b(national[_-]?id|national[_-]?identifier|nid|id[_-]?number|government[_-]?id|gov[_-]?id)\b"),
    (
        "drivers_license",
        "identifiers",
        "drivers_license_number",
        r"\b(driver['’]?s?[_-]?license|driverslicense|driving[_-]?license|driver[_-]?licence|dl[_-]?number|license[_-]?number|licence[_-]?number)\b",
    ),
    ("tax_id", "identifiers", "tax_identifier", r"\b(tax[_-]?id|taxid|tin|ein|vat[_-]?number|fiscal[_-]?code)\b"),
    ("account_number", "identifiers", "account_number", r"\b(account[_-]?number|acct[_-]?number|iban|routing[_-]?number|sort[_-]?code|swift|bic)\b"),
    ("username", "credentials", "username", r"\b(username|user[_-]?name|login|login[_-]?id|userid|user[_-]?id)\b"),
    ("email", "credentials", "user_email", r"\b(email|email[_-]?address)\b"),
    ("password", "credentials", "user_password", r"\b(password|passwd|pass|pwd|passphrase|secret)\b"),
]
#: A bare ``mail`` is an address unless it is a constant's scope, a call, or an object whose member is no address list (fixed value).
BARE_MAIL = r"\bmail\b(?!\s*(?:::|\(|\.(?!(?:to|from|cc|bcc|reply_to|sender|recipients)\b)))"


def rule_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``(rule_id, category, label, pattern)``; ``path`` names a JSON file with a list of such objects in place of the built-in rules."""
    rows = PERSONAL_DATA_RULES
    if path is not None:
        with open(path, encoding="utf-8") as f:
            rows = [(r["rule_id"], r["category"], r["label"], r["pattern"]) for r in json.load(f)]
        ids = [r[0] for r in rows]
        if len(set(ids)) != len(ids):
            raise ValueError("rule ids repeat")
    return spark.createDataFrame(rows, "rule_id string, category string, label string, pattern string")


def rule_hits(line: Column, rules: list[tuple[str, str, str, str]] | None = None) -> Column:
    """Rules that match a line as an array of (rule_id, category, label), unrolled so that the line is scanned without a join."""
    rules = PERSONAL_DATA_RULES if rules is None else rules
    found = []
    for rule_id, category, label, pattern in rules:
        hit = line.rlike("(?i)" + ascii_word(pattern))
        if rule_id == "email":
            hit = hit | line.rlike("(?i)" + ascii_word(BARE_MAIL))
        found.append(F.when(hit, F.struct(F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), F.lit(label).alias("label"))))
    return F.array_compact(F.array(*found))


#: Call shapes that name a route, a database access or a configuration read (kind, detail, languages, pattern with one group).
CODE_SHAPES: list[tuple[str, str, tuple[str, ...], str]] = [
    ("route", "express", ("javascript", "typescript"), r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("route", "fastapi", ("python",), r"@(?:app|router)\.(?:get|post|put|patch|delete)\(\s*[\"']([^\"']+)[\"']"),
    ("route", "aspnet", ("csharp",), r"\[Http(?:Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\""),
    ("route", "spring", ("java",), r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*\"([^\"]+)\""),
    ("database", "orm_js", ("javascript", "typescript"), r"\bdb\.(\w+)\.(?:find\w*|create|update\w*|delete\w*|upsert)\("),
    ("database", "sql_go", ("go",), r"\b(?:QueryRowContext|QueryContext|ExecContext)\(\s*\w+,\s*\"([^\"]+)\""),
    ("database", "sqlalchemy", ("python",), r"__tablename__\s*=\s*[\"'](\w+)[\"']"),
    ("database", "store_java", ("java",), r"\bstore\.(?:find|save|delete)\(\s*\"(\w+)\""),
    ("database", "ef_csharp", ("csharp",), r"\b_db\.(\w+)\.(?:First|Single|Where|Add|Remove)\w*\("),
    ("import", "module_js", ("javascript", "typescript"), r"(?:\bfrom\s+|\brequire\(\s*|^\s*import\s+)[\"']([^\"']+)[\"']"),
    ("import", "module_python", ("python",), r"^\s*(?:from|import)\s+([\w.]+)"),
    ("import", "package_java", ("java",), r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    ("import", "using_csharp", ("csharp",), r"^\s*using\s+([\w.]+)\s*;"),
    ("log", "logger", ("javascript", "typescript", "java", "csharp", "python"), r"\b(?:logger|log|_log|logging|console)\.(\w+)\("),
]


def shape_hits(line: Column, language: Column) -> Column:
    """Shapes found on a line as an array of (kind, detail, value)."""
    found = []
    for kind, detail, languages, pattern in CODE_SHAPES:
        value = F.regexp_extract(line, pattern, 1)
        hit = language.isin(*languages) & (value != "")
        found.append(F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(detail).alias("detail"), value.alias("value"))))
    return F.array_compact(F.array(*found))
