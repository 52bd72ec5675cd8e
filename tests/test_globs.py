"""Shell globs: equal to fnmatch, total, harmless to other repositories."""
import fnmatch
import re

from codeaudit.functions.text import glob_bodies, glob_to_regex
from pyspark.sql import functions as F

GLOBS = ["*", "?", "a*b", "*.py", "src/*", "src/[a", "foo[", "x[z-a]", "x[!z-a]", "[]a]", "[!]a]", "[a&&b]", "[a-c]x", "[!a-c]x", "[a-]",
         "[-a]", "[--0]", "[a-c-e]", "[\\\\]", "[^a]", "[!^a]", "[[]", "[]]", "[]", "[!]", "a.b", "a+b(c)|{d}", "$x^", "*[0-9]?", "**/x", "é*", "[à-ü]", "~||--&&", "[~||]"]
PATHS = ["", "a", "b", "ab", "axb", "a\nb", "x.py", "src/a", "src/[a", "foo[", "x", "xz", "xa", "]", "[", "&", "bx", "dx", "-", "e", "c", "^", "\\",
         "a.b", "aXb", "a+b(c)|{d}", "$x^", "v12", "p/q/x", "été", "ä", "~||--&&", "|", "~", ".", "/", "0", "[]", "[!]", "a\n"]


def test_globs_equal_fnmatch(spark):
    rows = [(g, p) for g in GLOBS for p in PATHS]
    df = spark.createDataFrame(rows, "g string, p string")
    got = df.withColumn("rx", F.concat(F.lit("(?s)^(?:"), glob_bodies("g"), F.lit(")\\z"))).select(
        "g", "p", F.regexp_like("p", F.col("rx")).alias("m")).collect()
    wrong = [(r.g, r.p, r.m) for r in got if r.m != bool(re.match(fnmatch.translate(r.g), r.p))]
    assert not wrong


def test_a_bad_line_leaves_other_repositories_alone(spark):
    from codeaudit.operators.findings import apply_policy
    from codeaudit.sources.tree import files_from_raw
    raw = spark.createDataFrame(
        [("bad", ".gitignore", b"foo[\nx[z-a]\nsrc/[a\n*.log\n"), ("bad", "a.log", b"x"), ("bad", "foo[", b"x"), ("bad", "keep.py", b"x"),
         ("good", "b.log", b"x")], "repo_id string, path string, data binary").selectExpr(
        "*", "1L as size", "timestamp'2024-01-01' as mtime", "false as is_symlink")
    assert {(r.repo_id, r.path) for r in files_from_raw(raw).collect()} == {("bad", ".gitignore"), ("bad", "keep.py"), ("good", "b.log")}
    f = spark.createDataFrame([("r", "i", "src/[a", "low"), ("r", "i", "src/a", "low"), ("q", "i", "src/x", "low")],
                              "repo_id string, id string, path string, severity string")
    p = spark.createDataFrame([("r", "high", {}, [], ["src/[a", "x[z-a]"]), ("q", "high", {}, [], None)],
                              "repo_id string, fail_on string, severity map<string,string>, ignore array<string>, ignore_paths array<string>")
    assert sorted(r.path for r in apply_policy(f, p).collect()) == ["src/a", "src/x"]


def test_regex_is_a_plain_string():
    assert re.match(glob_to_regex("a*").replace("\\z", "\\Z"), "abc")
