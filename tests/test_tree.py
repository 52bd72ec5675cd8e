import os

from conftest import FAKE_AWS, FAKE_STRIPE

from codeaudit.operators import config, secrets
from codeaudit.sources import tree


def _write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    mode = "wb" if isinstance(data, bytes) else "w"
    with open(p, mode) as fh:
        fh.write(data)


def test_walk_keeps_dotfiles_and_applies_ignores(spark, tmp_path):
    root = str(tmp_path)
    _write(root, ".env", f"STRIPE={FAKE_STRIPE}\n")
    _write(root, ".npmrc", "//registry.npmjs.org/:_authToken=x\n")
    _write(root, ".github/workflows/ci.yml", "on: push\n")
    _write(root, "pkg/__init__.py", "x = 1\n")
    _write(root, "node_modules/pkg/index.js", f'const k = "{FAKE_AWS}";\n')
    _write(root, "logs/app.log", "x\n")
    _write(root, ".gitignore", "# comment\nlogs/\n!keep.log\n")
    _write(root, "img.png", b"\x89PNG")
    files = tree.files_from_trees(spark, [("r", root)])
    paths = {r["path"] for r in files.collect()}
    assert {".env", ".npmrc", ".github/workflows/ci.yml", "pkg/__init__.py", ".gitignore"} <= paths
    assert not any(p.startswith("node_modules/") or p.startswith("logs/") or p == "img.png" for p in paths)
    f = secrets.secret_findings(files).unionByName(config.config_findings(files))
    found = {(r["path"], r["id"]) for r in f.collect()}
    assert (".env", "secret/stripe-key") in found and (".npmrc", "config/committed-secret-file") in found


def test_hostile_inputs(spark, tmp_path):
    root = str(tmp_path)
    _write(root, "big.js", "var x=1;\n" * 400000)
    _write(root, "oneline.js", "a=" + "b" * 900000 + ";")
    _write(root, "fake.txt", bytes(range(256)) * 2000)
    _write(root, "bad.py", b'api_key = "\xff\xfe\x00notutf8value123"\n')
    _write(root, "u.py", "# 日本語 مرحبا\nx = 1\n")
    _write(root, "bom.py", b"\xef\xbb\xbfimport os\n")
    _write(root, "unterminated.js", 'const s = "' + "ab" * 60000 + "\n")
    deep = "/".join(f"d{i}" for i in range(40))
    _write(root, deep + "/deep.py", "x=1")
    os.symlink(root, os.path.join(root, "self_link"))
    os.symlink("/nope/missing", os.path.join(root, "broken_link"))
    files = tree.files_from_trees(spark, [("r", root)])
    got = {r["path"]: r["content"] for r in files.collect()}
    assert "big.js" not in got and got["fake.txt"] == "" and got["bad.py"] == ""
    assert deep + "/deep.py" in got and "self_link" not in got
    f = secrets.secret_findings(files).unionByName(config.config_findings(files))
    assert f.count() >= 0


def test_tracked_flags(spark, tmp_path):
    root = str(tmp_path)
    _write(root, ".env", "SECRET_KEY=abc\n")
    _write(root, "app.py", "x = 1\n")
    tracked = spark.createDataFrame([("r", "app.py")], "repo_id string, path string")
    files = tree.files_from_trees(spark, [("r", root)], tracked=tracked)
    t = {r["path"]: r["tracked"] for r in files.collect()}
    assert t == {".env": False, "app.py": True}
    r = config.config_findings(files).collect()
    assert [(x["id"], x["severity"]) for x in r] == [("config/untracked-secret-file", "medium")]


def test_files_partitioned_by_kind_prune_manifest_reads(spark, tmp_path):
    import json as _json

    from codeaudit.sources import manifests as M
    root = str(tmp_path / "tree")
    _write(root, "package.json", _json.dumps({"dependencies": {"a": "*"}}))
    _write(root, "src/app.py", "x = 1\n")
    _write(root, ".gitignore", ".env\n")
    files = tree.files_from_trees(spark, [("r", root)])
    out = str(tmp_path / "files")
    tree.write_files(files, out)
    stored = spark.read.parquet(out)
    assert {r["kind"] for r in stored.select("kind").distinct().collect()} == {"manifest", "ignore", "source"}
    plan = M.floating_dependencies(stored)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan and "manifest" in plan
    assert [r["evidence"] for r in M.floating_dependencies(stored).collect()] == ["a: *"]
