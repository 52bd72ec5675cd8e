"""The source tree data source: pruning, pushed conditions, balance."""
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.sources import tree, tree_reader
from codeaudit.sources.tree_reader import SCHEMA, Condition, Ignores, TreeReader, Units, ignore_lines, read_tree, write_tree


def put(root, files):
    for rel, data in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


TREE = {"a.py": "1", "src/b.py": "22", "src/deep/c.ts": "333", "src/deep/er/d.md": "4", ".env": "x", "lib/__init__.py": "",
        "node_modules/p/i.js": "n", "src/node_modules/q.js": "n", ".git/objects/aa/bb": "g", "logs/x.log": "l", "src/logs/y.py": "l",
        "t.tmp": "t", "img.PNG": b"\x89", "keep.log": "k", "big.bin2": "b" * 50, ".gitignore": "# no\nlogs/\n*.tmp\n!keep.log\nsrc/deep/er\n"}
KEPT = {"a.py", "src/b.py", "src/deep/c.ts", ".env", "lib/__init__.py", "img.PNG", "keep.log", "big.bin2", ".gitignore"}


@pytest.fixture()
def root(tmp_path):
    put(tmp_path, TREE)
    os.symlink("/nope", tmp_path / "broken")
    os.symlink(tmp_path / "src", tmp_path / "loop")
    return str(tmp_path)


class Opened(list):
    def __call__(self, path):
        self.append(path)
        return self.real(path)


@pytest.fixture()
def opened(monkeypatch):
    o = Opened()
    o.real = tree_reader.read_bytes
    monkeypatch.setattr(tree_reader, "read_bytes", o)
    return o


def reader(roots, names=None, filters=(), **options):
    r = TreeReader({"roots": json.dumps(roots), **{k: str(v) for k, v in options.items()}}, names or [x.split()[0] for x in SCHEMA.split(", ")])
    return r, list(r.pushFilters(list(filters)))


def rows(r):
    return [x for p in r.partitions() for b in r.read(p) for x in b.to_pylist()]


def test_listing_opens_no_file_and_enters_no_ignored_folder(root, opened, monkeypatch):
    listed = []
    real = tree_reader.list_dir
    monkeypatch.setattr(tree_reader, "list_dir", lambda p: listed.append(os.path.relpath(p, root)) or real(p))
    r, _ = reader([["r", root]], ["repo_id", "path", "size"])
    got = {x["path"]: x["size"] for x in rows(r)}
    assert set(got) == KEPT | {"broken", "loop"} and got["big.bin2"] == 50
    assert {os.path.basename(p) for p in opened} <= {".gitignore", ".codeauditignore"}
    assert not any("node_modules" in p or ".git" in p.split("/") or "logs" in p or "loop" in p for p in listed)


def test_only_files_that_pass_are_opened(root, opened):
    from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, Not, StringStartsWith
    r, left = reader([["r", root], ["s", root]], filters=[EqualTo(("repo_id",), "r"), StringStartsWith(("path",), "src/"),
                                                          Not(In(("ext",), (".ts",))), LessThanOrEqual(("size",), 10)])
    assert left == [] and [x["path"] for x in rows(r)] == ["src/b.py"]
    content = [p for p in opened if not p.endswith("ignore")]
    assert [os.path.relpath(p, root) for p in content] == ["src/b.py"]


def test_filters_give_what_spark_would(spark, root):
    whole = {r["path"]: r for r in read_tree(spark, [("r", root)]).collect()}
    assert set(whole) == KEPT | {"broken", "loop"} and bytes(whole["src/b.py"]["data"]) == b"22" and whole["loop"]["data"] is None
    assert whole["img.PNG"]["ext"] == ".png" and whole[".env"]["ext"] == "" and whole["a.py"]["mtime"] is not None
    col = F.col
    for c in (col("path") == "src/b.py", col("path").startswith("src/de"), col("ext").isin(".py", ".ts"), ~col("ext").isin(".py", ".ts"),
              col("name").contains("b"), ~col("is_symlink"), col("size") > 1, (col("size") >= 3) & (col("path") != "big.bin2"),
              col("name").endswith(".py") | col("path").startswith("lib"), col("repo_id") == "x", col("mtime") < "2000-01-01",
              ~col("path").startswith("src"), col("path").isin("src/deep/c.ts", "nope")):
        want = {p for p, in spark.createDataFrame(list(whole.values()), SCHEMA).filter(c).select("path").collect()}
        assert {p for p, in read_tree(spark, [("r", root)]).filter(c).select("path").collect()} == want


def test_tables_and_trees_keep_the_same_files(spark, root):
    r = random.Random(1)
    names = ["a", "b.py", "[x]", "c*", "logs", "src", "é", "x y", "node_modules"]
    put(root, {"/".join(r.choice(names) + str(r.randrange(3)) for _ in range(r.randrange(1, 4))) + "/f": "z" for _ in range(60)})
    put(root, {".codeauditignore": "a1\n src0/* \nc?2\n[[]x]1\nb.py[!0]\n/\n  \nx y2/\r\né1\n"})
    every = []
    for d, _, fs in os.walk(root):
        for f in fs:
            p = os.path.join(d, f)
            if not os.path.islink(p):
                every.append(("r", os.path.relpath(p, root), os.path.getsize(p), None, False, open(p, "rb").read()))
    raw = spark.createDataFrame(every, "repo_id string, path string, size long, mtime timestamp, is_symlink boolean, data binary")
    by_sql = {x["path"] for x in tree.files_from_raw(raw).select("path").collect()}
    by_tree = {x["path"] for x in tree.files_from_trees(spark, [("r", root)]).select("path").collect()}
    assert by_sql == by_tree and 20 < len(by_tree) < len(every) - 20


def test_a_large_root_is_cut_into_many_tasks(tmp_path, opened):
    put(tmp_path / "large", {f"m{i % 7}/p{i % 31}/f{i}.py": "x" for i in range(3000)} | {f"flat/g{i}.py": "x" for i in range(1500)})
    for k in range(20):
        put(tmp_path / f"small{k}", {f"f{i}.py": "x" for i in range(3)})
    roots = [[n, str(tmp_path / n)] for n in sorted(os.listdir(tmp_path))]
    r, _ = reader(roots, ["repo_id", "path"], sliceFiles=100, tasks=64)
    parts = r.partitions()
    sizes = [sum(b.num_rows for b in r.read(p)) for p in parts]
    assert sum(sizes) == 4560 and len(parts) == 64 and max(sizes) < 250
    assert {len({x["path"] for x in rows(r)})} == {4503}
    for listings in (0, 1, 5, 40):  # what planning leaves unlisted, tasks walk
        r, _ = reader(roots, ["repo_id", "path"], sliceFiles=100, listings=listings)
        found = [(x["repo_id"], x["path"]) for x in rows(r)]
        assert len(found) == len(set(found)) == 4560


def test_edges(spark, tmp_path):
    assert read_tree(spark, []).count() == 0
    assert read_tree(spark, [("r", str(tmp_path / "missing"))]).count() == 0
    r, _ = reader([["r", str(tmp_path)]])
    assert rows(r) == [] and r.partitions() == [Units([])]
    with open(os.path.join(os.fsencode(str(tmp_path)), b"bad\xff.py"), "wb") as f:
        f.write(b"1")
    put(tmp_path, {"huge.txt": "h" * (R.MAX_FILE_BYTES + 1)})
    got = {x["path"]: x["data"] for x in rows(reader([["r", str(tmp_path)]])[0])}
    assert got == {"bad�.py": b"1", "huge.txt": None}
    assert ignore_lines("# a\r\n!b\n /x/ \n//\n\nc#d") == ["/x", "c#d"]
    assert not Ignores([])("a", "a") and Ignores(["*.py"])("d/a.py", "a.py") and not Ignores(["d"])("ad", "ad")
    from pyspark.sql.datasource import EqualTo, StringStartsWith
    assert Condition.of(EqualTo(("mtime",), 1)) is None and Condition.of(EqualTo(("path", "x"), 1)) is None
    c = Condition.of(StringStartsWith(("path",), "a/b"))
    assert c.may_hold_below("a/") and c.may_hold_below("a/b/c/") and not c.may_hold_below("b/")


def test_written_trees_read_back(spark, tmp_path):
    raw = spark.sql("select concat('r', id % 3) as repo_id, concat('d', id % 5, '/f', id) as path, timestamp_seconds(1e9 + id) as mtime, "
                    "cast(concat('t', id) as binary) as data from range(200)")
    write_tree(raw, f"file://{tmp_path}/t")
    back = read_tree(spark, [(f"r{i}", f"file://{tmp_path}/t/r{i}") for i in range(3)])
    assert sorted(map(tuple, back.select("repo_id", "path", "mtime", "data").collect())) == sorted(map(tuple, raw.collect()))
