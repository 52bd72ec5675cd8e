import os

import pytest
from conftest import FAKE_AWS, FAKE_DSN, FAKE_STRIPE
from pyspark.sql import functions as F

from codeaudit.plans import scan as PS
from codeaudit.sources import tree


def _repo(root):
    files = {
        "app/settings.py": f'AWS_KEY = "{FAKE_AWS}"\nSTRIPE = "{FAKE_STRIPE}"\nDEBUG = True\nDB = "{FAKE_DSN}"\n',
        "app/safe.py": 'API_KEY = os.environ["API_KEY"]\nTOKEN = "your-token-here"\nPASSWORD = "changeme"\n',
        "Dockerfile": "FROM python:latest\nRUN pip install .\nCMD [\"python\"]\n",
        ".env": "SECRET_KEY=abc\n",
        "requirements.txt": "flask==0.12.2\n",
    }
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as fh:
            fh.write(text)


def test_full_scan(spark, tmp_path):
    _repo(str(tmp_path))
    files = tree.files_from_trees(spark, [("r", str(tmp_path))])
    res = PS.scan(files, enabled=["secrets", "config", "readiness", "deps"])
    counts = res.counts.collect()[0]
    assert counts["critical"] >= 3
    assert res.scores.collect()[0]["grade"] == "F"
    score = res.readiness.collect()[0]["score"]
    assert 0 <= score <= 100
    assert res.gate.collect()[0]["failed"]
    assert res.stats.collect()[0]["files_scanned"] >= 4


def test_clean_repo_grades_well(spark, tmp_path):
    with open(os.path.join(tmp_path, "main.py"), "w") as fh:
        fh.write("print('hello')\n")
    res = PS.scan(tree.files_from_trees(spark, [("r", str(tmp_path))]), enabled=["secrets", "config"])
    assert res.findings.count() == 0 and res.scores.collect()[0]["grade"] == "A"


def test_baseline_and_incremental_round_trip(spark, tmp_path):
    _repo(str(tmp_path))
    files = tree.files_from_trees(spark, [("r", str(tmp_path))])
    a = PS.scan(files, enabled=["secrets", "config"])
    base = a.findings.select("repo_id", F.substring(F.sha2(F.concat_ws("|", "id", "path", "evidence"), 256), 1, 16).alias("fingerprint"))
    b = PS.scan(files, enabled=["secrets", "config"], baseline=base)
    assert b.findings.count() == 0
    state = PS.initial_state(files, ["secrets", "config"])
    again, _st, hits = PS.incremental_file_findings(files, state, ["secrets", "config"])
    assert hits.count() == files.count()
    fp = lambda df: {tuple(r) for r in df.select("id", "path", "line", "evidence").collect()}
    assert fp(again) == fp(a.findings)


def test_unknown_scanner_is_an_error():
    with pytest.raises(PS.ScanError):
        PS.select_scanners(["secrets", "nope"])
    assert PS.select_scanners(skip=["surface"]) == [s for s in PS.ALL_SCANNERS if s != "surface"]


def test_diff_scope(spark, tmp_path):
    for rel, text in {"old.py": f'KEY = "{FAKE_AWS}"\n', "new.py": f'OTHER = "{FAKE_STRIPE}"\n'}.items():
        with open(os.path.join(tmp_path, rel), "w") as fh:
            fh.write(text)
    files = tree.files_from_trees(spark, [("r", str(tmp_path))])
    changed = spark.createDataFrame([("r", "new.py")], "repo_id string, path string")
    full = {r["path"] for r in PS.scan(files, enabled=["secrets"]).findings.collect()}
    diffed = {r["path"] for r in PS.scan(files, enabled=["secrets"], changed=changed).findings.collect()}
    assert full == {"old.py", "new.py"} and diffed == {"new.py"}


def test_diff_scope_leaves_files_out_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(PS, "SLOTS", 4)  # hashes are shared: the join decides
    files = spark.range(500).select(F.concat(F.lit("r"), F.col("id") % 3).alias("repo_id"), F.concat(F.lit("f"), "id").alias("path"),
                                    F.lit("x").alias("content"))
    changed = files.filter("id % 50 = 0").select("repo_id", "path")
    out = PS.diff_scope(files, changed.union(changed))
    assert sorted(map(tuple, out.select("repo_id", "path").collect())) == sorted(map(tuple, changed.collect())) and out.columns == files.columns
    assert "BroadcastHashJoin [_slot" in out._jdf.queryExecution().executedPlan().toString()


def test_driver_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"repo_id", "risk_score", "grade"}
    assert set(E.oracle_sql()) <= set(E.queries())


def test_unresolved_diff_ref_is_an_error(spark):
    ok = spark.createDataFrame([("r", "main", True)], "repo_id string, ref string, resolved boolean")
    PS.check_diff_refs(ok)
    bad = spark.createDataFrame([("r", "origin/does-not-exist", False)], "repo_id string, ref string, resolved boolean")
    with pytest.raises(PS.DiffRefError):
        PS.check_diff_refs(bad)


def test_rule_catalogue(spark):
    from codeaudit.plans.export import rule_catalogue
    kinds = {r["kind"]: 0 for r in rule_catalogue(spark).collect()}
    rows = rule_catalogue(spark).groupBy("kind").count().collect()
    got = {r["kind"]: r["count"] for r in rows}
    assert got == {"secret": 24, "config": 38, "dangerous-file": 13, "readiness": 18} and kinds


def test_reports(spark, tmp_path):
    import json as _json

    from codeaudit.operators import findings as A
    from codeaudit.plans import export as X
    _repo(str(tmp_path))
    files = tree.files_from_trees(spark, [("r", str(tmp_path))])
    res = PS.scan(files, enabled=["secrets", "config", "readiness"])
    j = _json.loads(X.json_reports(res.findings, res.scores, res.counts, res.readiness, res.stats).collect()[0]["document"])
    assert j["findings"] and j["grade"] == "F" and "score" in j["readiness"] and j["stats"]["files_scanned"] >= 4
    assert all(len(f["fingerprint"]) == 16 for f in j["findings"])
    md = X.markdown_documents(res.findings, res.scores, res.counts).collect()[0]["document"]
    assert md.startswith("## ") and "| critical |" in md and FAKE_AWS not in md
    sarif = _json.loads(X.sarif_documents(res.findings).collect()[0]["document"])
    assert sarif["version"] == "2.1.0" and sarif["runs"][0]["results"]
    assert all(r["level"] in ("error", "warning", "note") for r in sarif["runs"][0]["results"])
    assert FAKE_AWS not in _json.dumps(sarif)
    assert A.first_seen_rules(res.findings).count() == len({f["id"] for f in j["findings"]})
