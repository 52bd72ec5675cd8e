"""Logs read commit by commit, wherever the files are split."""
import random

import pytest
from conftest import FAKE_AWS, FAKE_DSN

from codeaudit.operators import history as HI
from codeaudit.sources.commit_log import read_commit_log, write_commit_log


def log_text(seed, commits=40):
    r = random.Random(seed)
    out = []
    for c in range(commits):
        out += [f"commit {r.getrandbits(160):040x}" + r.choice(["", " (HEAD -> main)"]), "Author: a <a@b.test>", "", "    commit of a message", ""]
        for f in range(r.randrange(0, 4)):
            path = f"src/f{r.randrange(5)}.py"
            out += [f"diff --git a/{path} b/{path}", f"--- a/{path}", r.choice([f"+++ b/{path}", f"+++ {path}", "+++ /dev/null", f"+++ b/{path} "]), "@@ -0,0 +1 @@"]
            for _ in range(r.randrange(0, 5)):
                out.append(r.choice(["+", "-", " ", "+++", "+commit ", "\\ No newline"]) + "".join(r.choice("ab +é") for _ in range(r.randrange(0, 30))))
    return out


def rows(df):
    return sorted((r.repo_id, r.sha, r.path, r.added) for r in df.collect())


@pytest.mark.parametrize("size", [37, 200, 1000, 1 << 20])
def test_splits_resynchronise_at_commits(spark, tmp_path, size):
    lines = log_text(size)
    (tmp_path / "repo.log").write_text("\n".join(lines) + "\n")
    table = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "repo_id string, seq long, line string")
    want = HI.commit_adds(table)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = read_commit_log(spark, str(tmp_path), "r")
        if size < 1000:
            assert got.rdd.getNumPartitions() > 5
        assert rows(got) == rows(want) and got.count() > 8
        order = [(r.sha, r.path) for r in got.orderBy("first_seq").collect()]
        assert order == [(r.sha, r.path) for r in want.orderBy("first_seq").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_the_plan_moves_no_line(spark, tmp_path):
    (tmp_path / "repo.log").write_text("\n".join(log_text(1)))
    plan = read_commit_log(spark, str(tmp_path), "r")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "InMemoryTableScan" not in plan


def test_text_before_commits_line_ends_and_empty_logs(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"+++ b/x.py\r\n+early\r\ncommit 1234567890\r\n+++ b/x.py\r\n+one\r\n-no\r\n+two")
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "c.log").write_bytes(b"commit abcdef0123\n")
    assert rows(read_commit_log(spark, str(tmp_path), "r")) == [("r", "", "x.py", "early"), ("r", "12345678", "x.py", "one\ntwo")]


def test_findings_from_logs_equal_those_of_lines(spark, tmp_path):
    first = ["commit " + "2" * 40, "+++ b/prod.py", "+KEY = os.environ['KEY']"]
    then = ["commit " + "1" * 40, "+++ b/tests/fixture.py", f'+DSN = "{FAKE_DSN}"', "+++ b/prod.py", f'+KEY = "{FAKE_AWS}"']
    last = ["commit " + "0" * 40, "+++ b/later.py", f'+AGAIN = "{FAKE_AWS}"']
    commits = [("r", i, "\n".join(c)) for i, c in enumerate((first, then, last))] + [("s", 0, "\n".join(last))]
    write_commit_log(spark.createDataFrame(commits, "repo_id string, seq long, text string"), str(tmp_path / "logs"))
    got = HI.findings_from_adds(read_commit_log(spark, str(tmp_path / "logs"))).collect()
    assert {(x["repo_id"], x["id"], x["path"], x["severity"]) for x in got} == {
        ("r", "git-history/aws-access-key", "prod.py @ 11111111", "critical"), ("r", "git-history/db-url", "tests/fixture.py @ 11111111", "medium"),
        ("s", "git-history/aws-access-key", "later.py @ 00000000", "critical")}
