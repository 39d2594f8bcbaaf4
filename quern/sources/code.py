"""A few source files in the languages that the extractors read, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = [
    ("acme/app", "pkg/core.py", "python", '"""Core."""\nimport os\nfrom pkg.util import helper\n\n\ndef top(a, b=1):\n    """Add."""\n    return helper(a) + b\n\n\nclass Store(dict):\n    """A store."""\n\n    def save(self, key):\n        return os.path.join("x", key)\n\n    def load(self, key):\n        return self[key]\n'),
    ("acme/app", "pkg/broken.py", "python", "def good(x):\n    return x\n\ndef bad(x:\n    return\n\nclass Odd(:\n    pass\n"),
    ("acme/app", "web/app.js", "javascript", "import x from 'lib/x'\nconst y = require('y')\n\nfunction run(a) {\n  return a\n}\n\nexport const build = (a) => a\nclass View {\n  draw() {}\n}\n"),
    ("acme/app", "web/Card.svelte", "svelte", "<script>\nimport c from './c'\n</script>\n<style>\np { color: red }\n</style>\n"),
    ("acme/app", "src/Main.java", "java", "import java.util.List;\nimport static a.B.*;\n\npublic class Main {\n  private int n;\n  public Main(int n) { this.n = n; }\n  public int get(String s) {\n    if (n > 0) { return n; }\n    return 0;\n  }\n  enum Kind { A, B }\n}\n"),
    ("acme/app", "src/lib.rs", "rust", "use std::fmt;\npub struct P { x: i32 }\nimpl P {\n  pub fn new() -> P { P { x: 0 } }\n}\nimpl fmt::Display for P {\n  fn fmt(&self) -> i32 { 1 }\n}\nfn free(a: i32) -> i32 { a }\n"),
    ("acme/app", "ios/App.swift", "swift", "import Foundation\nclass App {\n  init() { }\n  func start(a: Int) -> Int { return a }\n}\nextension App {\n  func stop() { }\n}\n"),
    ("acme/app", "lib/a.ex", "elixir", "defmodule Shop.Cart do\n  alias Shop.Item\n  def add(c, i) do\n    [i | c]\n  end\n  defp size(c), do: length(c)\nend\n"),
    ("acme/app", "db/schema.sql", "sql", "CREATE TABLE IF NOT EXISTS users (id int, name text);\n-- Query: FindUser\nSELECT * FROM users WHERE id = 1;\nselect 1;\nDELETE FROM users WHERE name = 'x';\n"),
]

DOCUMENTS = [
    ("acme/app", "docs/guide.md", "Intro text.\n# Guide\nWelcome.\n## Setup\nInstall it.\n### Linux\nUse the package.\n## Usage\nRun it.\n"),
    ("acme/app", "docs/old.rst", "Title\n=====\nHello.\n\nPart\n----\nMore.\n\nOther\n----\nEnd.\n"),
    ("acme/app", "docs/spec.md", "# Feature Spec: Login Form\n> Intent Patterns: [sign in | log in, `auth`, ...]\n## Summary L0\nx\n## Parts L1\nUses `AuthBox` and `AuthBox`.\nLoginForm:\n| Component | x |\n## Flow L2\n`NotHere` y\n"),
    ("acme/app", "conf/app.json", '{"name": "x", "port": 1}'),
    ("acme/app", "conf/app.yaml", "name: x\nport: 1\n  nested: 2\n"),
]

COMPONENTS = [
    ("acme/app", "web/Form.vue", "<script lang=\"ts\">\nimport c from './c'\nfunction send(a) {\n  return c(a)\n}\nexport const clear = () => 0\n</script>\n<style>\np { color: red }\n</style>\n<p>{x}</p>\n"),
    ("acme/app", "web/Bare.vue", "<p>no script</p>\n"),
]

LOG = "a1b2c3d4|ann@x.org|2024-01-02T03:04:05+00:00|Add | pipes\n3\t1\tpkg/core.py\n-\t-\timg.png\n\nb2c3d4e5|bob@x.org|2024-01-03T00:00:00+00:00|Fix\n10\t0\tweb/app.js\nodd\t1\tx\n"


ODD_FILES = [
    ("acme_app/logo.png", b"\x89PNG\xff\xfe\x00"),
    ("acme_app/web/app.min.js", b"var a=1"),
    ("acme_app/CHANGELOG.md", b"# Changes\n" + b"Something changed. " * 10),
    ("acme_app/pkg/latin.py", b"# caf\xe9\n" + b"value = 1\n" * 20),
    ("other_tool/main.py", b"print('a long enough file')\n" * 5),
    (".cache_x/main.py", b"x = 1\n" * 20),
    ("plain/main.py", b"x = 1\n" * 20),
]


def checkout(spark: SparkSession, root: str) -> str:
    """The files and documents, and odd ones beside them, written under ``root`` by Hadoop's file systems."""
    mine = [(f"acme_app/{r[1]}", r[-1].encode()) for r in FILES + DOCUMENTS]
    for path, content in mine + ODD_FILES:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(content))
        out.close()
    return root


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "repo_id string, file_path string, language string, content string")


def components(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "repo_id string, file_path string, content string")


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOCUMENTS, "repo_id string, file_path string, content string")


def log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("acme/app", "log", LOG)], "repo_id string, file_path string, content string")


def values(rows: list[tuple], columns: str) -> str:
    """The rows as SQL."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows) + f") t({columns})"
