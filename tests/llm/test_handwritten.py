import itertools
import math
from datetime import datetime

import pytest

from lumenveil.llm.handwritten import COMPATIBILITY, LABELS, ROOT, content_evidence, file_labels, leading_comment, propagate
from lumenveil.workspace import Workspace

CODE = "import { db } from '../db';\n\nexport async function load(id: string) {\n  const row = await db.find({ id });\n  return row.name ?? null;\n}\n"
MINIFIED = "".join(f"function a{i}(b,c){{var d=b||[];for(var e=0;e<d.length;e++){{if(d[e].x===c)return d[e]}}return null}};" for i in range(9))
BLOB = "export const DATA = [\n" + "".join("  0x1f, 0x2a, 0x3b, 0x4c,\n" for _ in range(60)) + "];\n"
BASE64 = 'const font = "data:font/woff2;base64,' + "QUJD" * 300 + '";\n'


def label_of(text, language="typescript", repo="acme/portal"):
    e = content_evidence(text, language, repo)
    return LABELS[max(range(5), key=lambda k: e[k])]


@pytest.mark.parametrize(
    "text,want",
    [
        (CODE, "hand"),
        ("// Code generated by protoc-gen-go v1.2.3. DO NOT EDIT.\n" + CODE, "generated"),
        ("/*\n * This file was automatically generated by tool; manual changes will be lost.\n */\n" + CODE, "generated"),
        ("# @generated\n" + CODE, "generated"),
        ("// Copyright 2025 the portal authors.\n// bindings\n//\n// <auto-generated>\n//  Written by the x tool, version 2.1\n// </auto-generated>\n" + CODE, "generated"),
        ("# Diese Datei wurde automatisch von x erzeugt. Nicht bearbeiten!\n" + CODE, "generated"),
        ("// do not edit the order of these steps\n" + CODE, "hand"),
        ("// auto-generated ids start at one\n" + CODE, "hand"),
        ("// an id generated by the database is expected here\n" + CODE, "hand"),
        (CODE + 'export const BANNER = "// Code generated by our exporter. DO NOT EDIT.";\n', "hand"),
        ("/*! leaflet v1.9.4 | (c) 2022 The Leaflet Contributors. MIT License. */\n" + CODE, "vendored"),
        ("/**\n * @license lodash 4.17.21\n * Copyright 2021 lodash team\n */\n" + CODE, "vendored"),
        ("// Copyright 2025 the portal authors.\n// Licensed under the terms of the LICENSE file of portal.\n" + CODE, "hand"),
        (MINIFIED, "minified"),
        ("/* x */\n" + MINIFIED + "\n//# sourceMappingURL=app.js.map\n", "minified"),
        (CODE + 'const longQuery = "select ' + ", ".join(["first_name"] * 80) + ' from t";\n', "hand"),
        (BLOB, "blob"),
        (BASE64, "blob"),
        ("[[1.5,2.5],[3.5,4.5]]," * 200, "blob"),
        ("", "hand"),
        ("<<<<<<< ours\n// Code generated by x v1.0. DO NOT EDIT.\n=======\n", "generated"),
    ],
)
def test_content(text, want):
    assert label_of(text) == want


def test_data_files_are_no_blobs():
    assert label_of('{"values": [' + ", ".join(map(str, range(2000))) + "]}", "json") == "hand"


def test_leading_comment():
    assert leading_comment("\n// a\n/* b\n * c */\ncode // d\n").split() == ["a", "b", "c"]


def posterior(paths, evidence):
    """Sums over all labellings of the tree."""
    nodes = {""}
    for p in paths:
        parts = p.split("/")
        nodes |= {"/".join(parts[:k]) for k in range(1, len(parts) + 1)}
    nodes = sorted(nodes)
    parent = {n: n.rpartition("/")[0] for n in nodes if n}
    total = {p: [0.0] * 5 for p in paths}
    for labels in itertools.product(range(5), repeat=len(nodes)):
        x = dict(zip(nodes, labels))
        w = math.exp(ROOT[x[""]])
        for n, up in parent.items():
            w *= COMPATIBILITY[x[up]][x[n]]
        for p in paths:
            w *= math.exp(evidence[p][x[p]])
        for p in paths:
            total[p][x[p]] += w
    return {p: t[0] / sum(t) for p, t in total.items()}


def test_propagation_is_exact_on_a_small_tree(spark):
    evidence = {"a/b/x": (0, 0, 0, 3.0, 0), "a/b/y": (0, 0, 0, 0, 0), "a/z": (0, 1.0, 0, -2.0, 0), "w": (0, -1, 0, 0, 2.5)}
    df = spark.createDataFrame([(1, p, *map(float, e)) for p, e in evidence.items()], "s int, p string, e0 double, e1 double, e2 double, e3 double, e4 double")
    got = {r["p"]: r["hand"] for r in propagate(df, ["s"], "p", [f"e{k}" for k in range(5)], Workspace(spark, "t")).collect()}
    want = posterior(list(evidence), evidence)
    assert set(got) == set(want) and all(math.isclose(got[p], want[p], rel_tol=1e-9) for p in want)


#: (path, text, truth): neighbours tell files without a notice of their own apart.
NOTICE = "/*! leaflet v1.9.4 | (c) 2022 The Leaflet Contributors. MIT License. */\n"
MADE = "// Code generated by protoc-gen-x v1.2. DO NOT EDIT.\n"
TREE = [
    *[(f"src/lib/leaflet/part{i}.ts", NOTICE + CODE, "vendored") for i in range(4)],
    ("src/lib/leaflet/core.ts", CODE, "vendored"),
    ("src/lib/leaflet/lost.ts", None, "vendored"),
    *[(f"src/vendor/contact{i}.ts", CODE, "hand") for i in range(5)],
    ("src/vendor/unread.ts", None, "hand"),
    *[(f"internal/gen/m{i}.go", MADE + CODE, "generated") for i in range(5)],
    ("internal/gen/late.go", "package m\n\nvar x = 1\n" + MADE + CODE, "generated"),
    ("internal/gen/lost.go", None, "generated"),
    *[(f"internal/mail/m{i}.go", CODE, "hand") for i in range(5)],
    ("internal/mail/template.go", "package m\n\nvar x = 1\n" + MADE + CODE, "hand"),  # code about generated files among code
    ("internal/mail/made.go", "package m\n\n" + MADE + CODE, "generated"),
    *[(f"src/app/a{i}.ts", CODE, "hand") for i in range(6)],
]


def test_neighbours_decide(spark):
    got = run(spark, [(1, [p for p, _, _ in TREE])], [(1, p, t, "typescript", "acme/portal") for p, t, _ in TREE if t is not None])
    truth = {p: label for p, _, label in TREE}
    together = sum(got[1, p] == truth[p] for p in truth)
    # the same files, each in a scan of its own directory alone: nothing but their own evidence
    alone = run(spark, [(k, [p]) for k, (p, _, _) in enumerate(TREE)], [(k, p, t, "typescript", "acme/portal") for k, (p, t, _) in enumerate(TREE) if t is not None])
    apart = sum(alone[k, p] == label for k, (p, _, label) in enumerate(TREE))
    assert together == len(TREE) and apart < len(TREE) - 3


PAYLOADS = "scan_id long, files_scanned array<string>, file_path string, label string, e0 double"
SOURCES = "scan_id long, path string, content string, language string, repo string, ingested_at timestamp, _path string, c0 string"


def run(spark, payloads, sources):
    p = spark.createDataFrame([(s, f, "x", "y", 0.0) for s, f in payloads], PAYLOADS)
    q = spark.createDataFrame([(*r, datetime(2026, 1, n + 1), "a", "b") for n, r in enumerate(sources)], SOURCES)
    return {(r["scan_id"], r["file_path"]): r["label"] for r in file_labels(p, q).collect()}


def test_operator(spark):
    paths = ["src/vendor/contact.ts", "node_modules/x/dist/a.js", "vendor/code.org/x/b.go", "package-lock.json", "src/app_pb2.py", "public/a.min.js", "dist/m.0a1b2c3d.js", "external/lib-1.2/src/q.c",
             "src/gen.ts", "scripts/generate_all.py", "src/old.ts", "./src/gone.ts", None, "", "src/old.ts"]
    sources = [
        (1, "src/vendor/contact.ts", CODE, "TypeScript", "acme/portal"),
        (1, "src/gen.ts", "// @generated\n" + CODE, "typescript", "acme/portal"),
        (1, "scripts/generate_all.py", "import os\n\nprint(os.name)\n", "python", "acme/portal"),
        (1, "src/old.ts", "// @generated\n" + CODE, None, None),
        (1, "src/old.ts", CODE, None, None),
        (1, "src/other.ts", None, "typescript", "acme/portal"),
        (None, "src/n.ts", CODE, "typescript", "acme/portal"),
    ]
    got = run(spark, [(1, paths), (1, paths), (2, None), (None, ["x.py"]), (3, [])], sources)
    want = {
        "src/vendor/contact.ts": "hand", "node_modules/x/dist/a.js": "vendored", "vendor/code.org/x/b.go": "vendored", "package-lock.json": "generated", "src/app_pb2.py": "generated",
        "public/a.min.js": "minified", "dist/m.0a1b2c3d.js": "minified", "external/lib-1.2/src/q.c": "vendored", "src/gen.ts": "generated", "scripts/generate_all.py": "hand", "src/old.ts": "hand", "src/gone.ts": "hand",
    }
    assert got == {(1, p): label for p, label in want.items()}


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_one_directory_with_many_files(spark):
    got = run(spark, [(1, [f"src/f{i}.ts" for i in range(3000)])], [])
    assert len(got) == 3000 and set(got.values()) == {"hand"}
