from pyspark.sql import functions as F

from codeaudit.model import FINDING_SCHEMA
from codeaudit.operators import findings as A


def _f(spark, rows):
    full = [("r", f"x{i}", "t", sev, sc, f"f{i}.py", 0, "e", "", "") for i, (sev, sc) in enumerate(rows)]
    return spark.createDataFrame(full, FINDING_SCHEMA)


def _score(spark, rows):
    return A.risk_scores(_f(spark, rows)).collect()[0]


def test_risk_scoring_calibration(spark):
    one_critical = _score(spark, [("critical", "secrets")])
    many_medium = _score(spark, [("medium", "config")] * 15)
    assert one_critical["risk_score"] > many_medium["risk_score"] and one_critical["grade"] == "F"
    process = _score(spark, [("medium", "readiness")] * 10 + [("low", "config")])
    assert _score(spark, [("high", "config")])["grade"] == "C"
    assert many_medium["grade"] == "B"
    only_process = A.risk_scores(_f(spark, [("medium", "readiness")] * 10),
                                 spark.createDataFrame([("r",)], "repo_id string")).collect()[0]
    assert only_process["risk_score"] == 0 and only_process["grade"] == "A"
    assert process["risk_score"] == 3


def test_fingerprint_is_stable(spark):
    rows = [("r", "x", "t", "high", "s", "a.py", 3, "e", "", ""), ("r", "x", "different", "low", "s", "a.py", 99, "e", "", "")]
    fps = {r["fingerprint"] for r in A.with_fingerprint(spark.createDataFrame(rows, FINDING_SCHEMA)).collect()}
    assert len(fps) == 1


def test_dedupe_keeps_most_severe(spark):
    rows = [("r", "config/compose-privileged", "t", "high", "config", "c.yml", 3, "privileged: true", "", ""),
            ("r", "config/k8s-privileged", "t", "high", "config", "c.yml", 3, "privileged: true", "", ""),
            ("r", "config/other", "t", "critical", "config", "c.yml", 3, "privileged: true", "", ""),
            ("r", "deps/x", "t", "low", "deps", "c.yml", 3, "privileged: true", "", "")]
    df = spark.createDataFrame(rows, FINDING_SCHEMA).withColumn("ord_pos", F.monotonically_increasing_id())
    out = {r["id"] for r in A.dedupe(df).collect()}
    assert out == {"config/other", "deps/x"}


def test_baseline_suppresses_everything(spark):
    f = _f(spark, [("high", "config"), ("low", "secrets")])
    base = A.with_fingerprint(f).select("repo_id", "fingerprint")
    assert A.baseline_suppress(f, base).count() == 0


def test_policy_apply(spark):
    f = spark.createDataFrame([("r", "config/docker-latest-tag", "t", "low", "config", "Dockerfile", 1, "e", "", ""),
                               ("r", "config/gha", "t", "medium", "config", "a.yml", 1, "e", "", ""),
                               ("r", "secret/x", "t", "high", "secrets", "examples/a.py", 1, "e", "", ""),
                               ("r", "secret/y", "t", "high", "secrets", "src/a.py", 1, "e", "", "")], FINDING_SCHEMA)
    pol = spark.createDataFrame([("r", "medium", {"config/docker-latest-tag": "high"}, ["config/gha"], ["examples/*"])],
                                "repo_id string, fail_on string, severity map<string,string>, ignore array<string>, ignore_paths array<string>")
    out = {(r["id"], r["severity"]) for r in A.apply_policy(f, pol).collect()}
    assert out == {("config/docker-latest-tag", "high"), ("secret/y", "high")}
    g = A.gate(A.apply_policy(f, pol), fail_on="critical", policy=pol).collect()[0]
    assert g["failed"] and g["blocking"] == 2


def test_counts_zero_filled(spark):
    c = A.severity_counts(_f(spark, [("high", "config")]), spark.createDataFrame([("r",), ("q",)], "repo_id string"))
    got = {r["repo_id"]: (r["critical"], r["high"]) for r in c.collect()}
    assert got == {"r": (0, 1), "q": (0, 0)}


def test_top_k_with_hot_group(spark):
    rows = [("r", "x", "t", "medium", "config", f"p{i:04d}.py", i, "e", "", "") for i in range(2000)]
    t = A.top_per_rule(spark.createDataFrame(rows, FINDING_SCHEMA), 5).orderBy("rank").collect()
    assert [r["path"] for r in t] == [f"p{i:04d}.py" for i in range(5)] and t[0]["rule_count"] == 2000
