"""Catalog-driven detectors: rules given as rows, one pass over the lines for all languages and kinds of finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kind of finding, technology, languages, pattern whose first group is the finding's value.  No look-arounds, so that any engine can run them.
DETECTORS: list[tuple[str, str, tuple[str, ...], str]] = [
    ("database", "orm", ("javascript", "typescript"), r"\b(?:db|prisma)\.(\w+)\.(?:find\w*|create\w*|update\w*|delete\w*|upsert|count)\("),
    ("database", "driver", ("javascript", "typescript"), r"(?:from\s+|require\(\s*)[\"'](pg|mysql2?|mongodb|mongoose|redis|ioredis|sqlite3|@prisma/client|typeorm|sequelize)[\"']"),
    ("database", "table", ("python",), r"__tablename__\s*=\s*[\"'](\w+)[\"']"),
    ("database", "driver", ("python",), r"^\s*(?:from|import)\s+(sqlalchemy|psycopg2?|pymongo|redis|django\.db|asyncpg|peewee)\b"),
    ("database", "statement", ("go",), r"\b(?:QueryRowContext|QueryContext|ExecContext|QueryRow|Query|Exec)\((?:\w+,\s*)?[\"`]([^\"`]+)[\"`]"),
    ("database", "store", ("java", "kotlin"), r"\bstore\.(?:find|save|delete)\(\s*\"(\w+)\""),
    ("database", "jdbc", ("java", "kotlin"), r"\"(jdbc:\w+):"),
    ("database", "entity", ("java", "kotlin"), r"@Table\(\s*name\s*=\s*\"(\w+)\""),
    ("database", "context", ("csharp",), r"\b_db\.(\w+)\.(?:First|Single|Where|Add|Remove|Find)\w*\("),
    ("database", "driver", ("csharp",), r"^\s*using\s+(Npgsql|MySql\.Data|System\.Data\.SqlClient|Microsoft\.EntityFrameworkCore)\b"),
    ("database", "driver", ("php",), r"new\s+(PDO|mysqli)\("),
    ("database", "driver", ("ruby",), r"^\s*adapter:\s*(\w+)|ActiveRecord::Base\.(establish_connection)"),
    ("database", "driver", ("cpp",), r"#include\s*[<\"](libpq-fe\.h|mysql\.h|sqlite3\.h|mongocxx/\w+|hiredis\.h)"),
    ("auth", "middleware", ("javascript", "typescript"), r"\b(passport|jsonwebtoken|requireAuth|authenticate|express-jwt)\b"),
    ("auth", "dependency", ("python",), r"\bDepends\(\s*(get_current_user|current_user|require_\w+|oauth2_scheme)\b|@(login_required|permission_required)\b"),
    ("auth", "annotation", ("java", "kotlin"), r"@(PreAuthorize|Secured|RolesAllowed)\b"),
    ("auth", "attribute", ("csharp",), r"\[(Authorize|AllowAnonymous)\b"),
    ("auth", "package", ("go",), r"\"(github\.com/golang-jwt/jwt\S*|golang\.org/x/oauth2)\""),
    ("auth", "facade", ("php",), r"\b(Auth::\w+|password_verify)\("),
    ("auth", "filter", ("ruby",), r"\b(before_action\s+:authenticate\w*|devise)\b"),
    ("auth", "library", ("cpp",), r"#include\s*[<\"](jwt-cpp/jwt\.h|security/pam_appl\.h)"),
    ("config", "environment", ("javascript", "typescript"), r"\bprocess\.env\.(\w+)"),
    ("config", "environment", ("python",), r"\bos\.(?:environ\.get\(|environ\[|getenv\()\s*[\"'](\w+)[\"']"),
    ("config", "environment", ("go",), r"\bos\.(?:Getenv|LookupEnv)\(\"(\w+)\"\)"),
    ("config", "environment", ("java", "kotlin"), r"\bSystem\.getenv\(\"(\w+)\"\)|@Value\(\"\$\{([\w.]+)"),
    ("config", "environment", ("csharp",), r"\bEnvironment\.GetEnvironmentVariable\(\"(\w+)\"\)|\bConfiguration\[\"([\w:]+)\"\]"),
    ("config", "environment", ("php",), r"\b(?:getenv|env)\(\s*['\"](\w+)['\"]"),
    ("config", "environment", ("ruby",), r"\bENV(?:\.fetch\(|\[)\s*['\"](\w+)['\"]"),
    ("config", "environment", ("cpp",), r"\bgetenv\(\s*\"(\w+)\""),
    ("route", "router", ("javascript", "typescript"), r"\b(?:app|router)\.(?:get|post|put|patch|delete)\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("route", "router", ("python",), r"@(?:app|router|bp)\.(?:get|post|put|patch|delete|route)\(\s*[\"']([^\"']+)[\"']"),
    ("route", "attribute", ("csharp",), r"\[Http(?:Get|Post|Put|Patch|Delete)\(\s*\"([^\"]+)\""),
    ("route", "annotation", ("java", "kotlin"), r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*\"([^\"]+)\""),
    ("route", "mux", ("go",), r"\.(?:HandleFunc|Handle|GET|POST|PUT|DELETE)\(\s*\"(/[^\"]*)\""),
    ("route", "facade", ("php",), r"\bRoute::(?:get|post|put|patch|delete)\(\s*['\"]([^'\"]+)['\"]"),
    ("route", "dsl", ("ruby",), r"^\s*(?:get|post|put|patch|delete)\s+['\"]([^'\"]+)['\"]|^\s*resources?\s+:(\w+)"),
    ("route", "server", ("cpp",), r"\b(?:CROW_ROUTE\(\s*\w+\s*,|svr\.(?:Get|Post|Put|Delete)\()\s*\"([^\"]+)\""),
    ("external", "client", ("javascript", "typescript"), r"\b(?:fetch|axios\.\w+|client\.(?:get|post|put|patch|delete))\(\s*[\"'`]([^\"'`]+)[\"'`]"),
    ("external", "client", ("python",), r"\b(?:requests|httpx|client|session)\.(?:get|post|put|patch|delete)\(\s*f?[\"']([^\"']+)[\"']"),
    ("external", "client", ("go",), r"\bhttp\.(?:Get|Post|NewRequest)\([^\"]*\"(http[^\"]+)\""),
    ("external", "client", ("java", "kotlin"), r"\b(?:URI\.create|restTemplate\.\w+|WebClient\.create)\(\s*\"([^\"]+)\""),
    ("external", "client", ("csharp",), r"\b_?(?:http|httpClient|client)\.(?:Get|Post|Put|Delete|Send)\w*\(\s*\$?\"([^\"]+)\""),
    ("external", "client", ("php",), r"\b(?:curl_init|Http::(?:get|post))\(\s*['\"]([^'\"]+)['\"]"),
    ("external", "client", ("ruby",), r"\b(?:HTTParty|Faraday|RestClient)\.(?:get|post|put|delete)\(?\s*['\"]([^'\"]+)['\"]"),
    ("external", "client", ("cpp",), r"\bCURLOPT_URL\s*,\s*\"([^\"]+)\""),
    ("handler", "function", ("javascript", "typescript"), r"\bexport\s+(?:const|async function|function)\s+(handler)\b|\bexports\.(handler)\s*="),
    ("handler", "function", ("python",), r"^\s*def\s+(lambda_handler|handler)\s*\("),
    ("handler", "function", ("go",), r"\blambda\.(Start)\("),
    ("handler", "function", ("java", "kotlin"), r"\bimplements\s+(RequestHandler|RequestStreamHandler)\b"),
    ("handler", "function", ("csharp",), r"\[(FunctionName|Function)\(|\b(ILambdaContext)\b"),
    ("handler", "function", ("php",), r"\b(Bref\\\\\w+)"),
]


def detector_hits(line: Column, language: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """Findings of a line as an array of (kind, technology, value); rules of other languages are not tried."""
    found = []
    for kind, technology, languages, pattern in DETECTORS:
        if kinds is not None and kind not in kinds:
            continue
        groups = [F.nullif(F.regexp_extract(line, pattern, g), F.lit("")) for g in range(1, group_count(pattern) + 1)]
        value = F.coalesce(*groups) if len(groups) > 1 else groups[0]
        value = F.when(language.isin(*languages), value)
        found.append(F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(technology).alias("technology"), value.alias("value"))))
    return F.array_compact(F.array(*found))


def group_count(pattern: str) -> int:
    import re

    return re.compile(pattern).groups
