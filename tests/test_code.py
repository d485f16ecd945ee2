from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import codebase as c
from tidemark.plans.code import R


def paths(spark, *names):
    return spark.createDataFrame([("o/r", n) for n in names], "full_name string, path string")


def test_selection_and_kinds(spark):
    df = paths(spark, "src/a.py", "tests/test_a.py", "tests/test_b.py", "tests/test_c.py", "examples/e.rs", "vendor/x.py", "README.md", "go.mod", "src/deep/b.go", "src/c.ts", "src/d.ts", "src/e.ts", "src/f.ts")
    got = [r.path for r in c.select_files(df).orderBy("place").collect()]
    assert got[:3] == ["tests/test_a.py", "tests/test_b.py", "examples/e.rs"] and len(got) == 9 and got[-1] == "go.mod" and "vendor/x.py" not in got
    kinds = dict(df.select("path", c.evidence_type(F.col("path"))).collect())
    assert kinds["go.mod"] == "dependency" and kinds["examples/e.rs"] == "example" and kinds["src/a.py"] == "implementation"


def test_python_names_survive_bad_files(spark):
    rows = [("o/r", "a.py", "import os.path\nfrom x.y import z\ndef f(): pass\nclass C: pass"), ("o/r", "b.py", "def ("), ("o/r", "c.py", None), ("o/r", "d.js", "function g() {}")]
    df = spark.createDataFrame(rows, "full_name string, path string, content string")
    got = {r.path: (r.symbols, r.imports) for r in c.python_names(df).collect()}
    assert got == {"a.py": (["f", "C"], ["os", "x"]), "b.py": ([], []), "c.py": ([], [])}
    named = {r.path: r.symbols for r in c.names(df).collect()}
    assert named["d.js"] == ["g"] and named["c.py"] == []


def test_scan_budget_and_secrets(spark):
    rows = [("o/r", "a.py", "x = 1"), ("o/r", "b.py", "API_KEY = 'k'"), ("o/r", ".env", "token=1"), ("o/r", "node_modules/m.js", "y"), ("o/r", "c.py", "import spark"), ("o/r", "d.py", "late")]
    df = spark.createDataFrame(rows, "full_name string, path string, content string")
    got = {r.path: r.secret for r in c.scan(df, max_files=3).collect()}
    assert got == {"a.py": False, "b.py": True, "c.py": False}
    context = c.project_context(c.scan(df, max_files=3)).first()
    assert context.frameworks == ["spark"] and context.files == 3 and context.languages == ["python"]


def test_manifests_declare_dependencies(spark):
    rows = [
        ("package.json", '{"name": "x", "dependencies": {"React": "^18", "@next": "1", "left": {"a": 1}}, "devDependencies": {"vite": null}}'), ("sub/package.json", '{"dependencies": {"lodash": "4"}}'), ("b/package.json", "{broken"),
        ("pyproject.toml", '[build-system]\nrequires = ["setuptools"]\n\n[project]\nname = "x"\ndependencies = [\n  "fastapi>=0.1",\n  # "not this",\n  "uvicorn[standard]",\n  \'torch >= 2\',\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n'),
        ("requirements.txt", "# top\nflask==2.0\r\nkafka>=1\nnumpy \n\n"), ("go.mod", "module x"), ("src/a.py", "import redis\nfrom os import path\nclass A: pass\ndef b(): pass"), ("src/b.py", "password = 1\nimport django"),
    ]
    df = spark.createDataFrame([("o/r", *x) for x in rows] + [("o/s", "README.md", "x")], "full_name string, path string, content string")
    want = {"React", "@next", "left", "vite", "lodash", "fastapi", "uvicorn[standard]", "torch", "flask", "kafka", "numpy"}
    assert {r.dependency for r in c.declared(df).collect()} == want
    got = {r.full_name: r for r in c.project_context(c.scan(df)).collect()}["o/r"]
    assert set(got.dependencies) == want | {"redis", "os", "path"}  # the pattern takes `import path` for an import
    assert got.dependencies == sorted(got.dependencies) and got.frameworks == ["@next", "React", "fastapi", "flask", "kafka", "redis", "torch"]
    assert got.symbols == ["A", "b"] and got.languages == ["python"] and got.files == 8
    assert got.summary.startswith("Local project with 8 safe files; primary languages: python; dependencies: @next, React, ")
    (text,) = c.context_text(c.project_context(c.scan(df))).where("full_name = 'o/r'").collect()
    assert text.context.startswith("Project context: python @next React fastapi") and text.context.endswith(got.summary)


def test_ignore_files(spark):
    lines = "# x\n\n*.log.py\n/only_root.py\nout/\ndocs/**\n**/gen/*.py\n!gen/keep.py\na?c.py\n[xy]z.py\n!out/back.py\n\\#odd.py\ntrail.py   \n"
    gone = ["a.log.py", "d/a.log.py", "only_root.py", "out/a.py", "d/out/e/a.py", "out/back.py", "docs/a.py", "docs/d/a.py", "gen/a.py", "d/gen/a.py", "abc.py", "xz.py", "#odd.py", "trail.py"]
    kept = ["d/only_root.py", "outer/a.py", "a.py", "gen/keep.py", "gen/d/a.py", "d/docs.py", "abbc.py", "zz.py", "out.py"]
    rows = [("o/r", ".gitignore", lines)] + [("o/r", p, "x") for p in gone + kept] + [("o/s", p, "x") for p in gone]
    df = spark.createDataFrame(rows, "full_name string, path string, content string")
    assert sorted(r.path for r in c.ignored(df).collect()) == sorted(gone)
    assert {(r.full_name, r.path) for r in c.scan(df).collect()} == {("o/r", p) for p in kept} | {("o/s", p) for p in gone}


def test_whole_scan_reads_up_to_the_full_budget(spark, tmp_path):
    rows = [("o/many", f"f{i:03}.py", "token = 1" if i == 119 else "x") for i in range(130)] + [("o/large", f"f{i:02}.py", "y" * 99_000) for i in range(15)]
    df = spark.createDataFrame(rows, "full_name string, path string, content string").selectExpr("*", "timestamp_ntz'2026-01-01 00:00:00' as fetched_at", "1L as file_id")
    df.write.parquet(str(tmp_path / "source_files.parquet"))
    got = R.queries["safe_scan_whole"](spark, str(tmp_path)).collect()
    assert Counter(r.full_name for r in got) == {"o/many": 120, "o/large": 11}
    assert [r.path for r in got if r.secret] == ["f119.py"]
