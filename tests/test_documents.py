"""Documents in parts: joined, they are the documents."""
import json
import os

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import findings as A
from codeaudit.plans import documents as D
from codeaudit.plans import export as X


def joined(path):
    out, files = {}, {}
    for d in sorted(os.listdir(path)):
        if d.startswith("repo_id="):
            names = sorted(n for n in os.listdir(os.path.join(path, d)) if n.startswith("part-"))
            out[d[8:]] = "".join(open(os.path.join(path, d, n), encoding="utf-8").read() for n in names)
            files[d[8:]] = len(names)
    return out, files


@pytest.fixture()
def findings(spark):
    """Half of all findings in one repository; equal rows, quotes and line ends in texts."""
    i = F.col("id")
    sev = F.element_at(F.array(*[F.lit(s) for s in ("critical", "high", "medium", "low", "info")]), (i * 7 % 5 + 1).cast("int"))
    return spark.range(6000).select(
        F.when(i % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), i % 40)).alias("repo_id"), F.concat(F.lit("config/x"), i % 11).alias("id"),
        F.concat(F.lit('A "title"\n, {'), i % 50, F.lit("}")).alias("title"), sev.alias("severity"), F.lit("config").alias("scanner"),
        F.concat(F.lit("p/"), i % 97, F.lit(".py")).alias("path"), (i % 13).cast("int").alias("line"), F.lit("é\\").alias("evidence"),
        F.lit("fix").alias("remediation"), F.lit("").alias("reference"))


def same(spark, path, documents, hot=None):
    got, files = joined(path)
    want = {r.repo_id: json.loads(r.document) for r in documents.collect()}
    assert {k: json.loads(v) for k, v in got.items()} == want
    if hot:
        assert files[hot] >= 2
    return got


def test_sarif_and_reports(spark, tmp_path, findings):
    repos = findings.select("repo_id").distinct().union(spark.createDataFrame([("calm",)], "repo_id string"))
    D.write_sarif(str(tmp_path / "sarif"), findings, repos)
    same(spark, str(tmp_path / "sarif"), X.sarif_documents(findings, repos), "hot")
    scores, counts = A.risk_scores(findings, repos), A.severity_counts(findings, repos)
    D.write_json_reports(str(tmp_path / "json"), findings, scores, counts)
    same(spark, str(tmp_path / "json"), X.json_reports(findings, scores, counts), "hot")
    back = D.read_elements(spark, str(tmp_path / "json")).select("repo_id", F.get_json_object("json", "$.title").alias("title")).filter("title is not null")
    assert back.count() == 6000 and back.exceptAll(findings.select("repo_id", "title")).count() == 0


def test_boms(spark, tmp_path):
    i = F.col("id")
    pk = spark.range(4000).select(F.when(i % 2 == 0, "hot").otherwise(F.concat(F.lit("r"), i % 7)).alias("repo_id"),
                                  F.concat(F.lit("@s/n"), i).alias("name"), F.lit("1.0").alias("version"), F.lit("npm").alias("eco"))
    D.write_cyclonedx(str(tmp_path / "cdx"), pk)
    same(spark, str(tmp_path / "cdx"), X.cyclonedx_documents(pk), "hot")
    D.write_spdx(str(tmp_path / "spdx"), pk)
    got = same(spark, str(tmp_path / "spdx"), X.spdx_documents(pk), "hot")
    assert json.loads(got["hot"])["relationships"][0]["relationshipType"] == "DESCRIBES"


def test_many_documents_need_no_listing(spark, tmp_path):
    """Files are listed by the tasks that wrote them; names keep their letters, and nothing half written is shown."""
    names = ["007", "1e3", "a/b", "x=y%", "é [1]", "plain"]
    f = spark.createDataFrame([(n, f"config/x{i % 3}", "t \r\n", "high", "config", "p", i, "", "fix", "") for i in range(40) for n in names],
                              "repo_id string, id string, title string, severity string, scanner string, path string, line int, evidence string, "
                              "remediation string, reference string")
    at = str(tmp_path / "sarif")
    D.write_sarif(at, f, f.select("repo_id").distinct())
    assert sorted(os.listdir(tmp_path)) == ["sarif"]
    assert not [n for _, _, files in os.walk(at) for n in files if n.startswith(".part") and ".txt." in n]
    back = D.read_elements(spark, at)
    assert not [x for x in back.inputFiles() if "repo_id=" in x]
    got = {r.repo_id: r.n for r in back.filter("json like '%ruleId%'").groupBy("repo_id").agg(F.count("*").alias("n")).collect()}
    assert got == dict.fromkeys(names, 40)
    lines = {r.repo_id: r.n for r in spark.read.text(at).groupBy(F.col("repo_id")).agg(F.count("*").alias("n")).collect()}
    assert set(lines.values()) == {40 + 3 + 3} and len(lines) == len(names)
    with pytest.raises(FileExistsError):
        D.write_sarif(at, f, f.select("repo_id").distinct())
