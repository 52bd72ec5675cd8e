from codeaudit.model import FINDING_SCHEMA
from codeaudit.operators import readiness as G


def test_readiness_rewards_good_repo(make_files):
    f = make_files([("tests/test_a.py", "def test(): pass\n"),
                    (".github/workflows/ci.yml", "jobs:\n  t:\n    steps: [gitleaks]\n"),
                    ("package-lock.json", "{}"), ("SECURITY.md", "report to security@x.com"),
                    ("LICENSE", "MIT"), ("CODEOWNERS", "* @me")])
    passed = {r["key"] for r in G.check_results(f).collect() if r["passed"]}
    assert {"tests", "ci", "lockfile", "security-policy", "license", "codeowners", "secret-scanning"} <= passed
    s = G.readiness_scores(f).collect()[0]
    assert s["total"] == 80 and s["earned"] == 6 + 5 + 6 + 8 + 4 + 4 + 2 and 0 <= s["score"] <= 100


def test_readiness_findings_severity(make_files):
    r = {x["id"]: x["severity"] for x in G.readiness_findings(make_files([("main.py", "print(1)\n")])).collect()}
    assert r["readiness/secret-scanning"] == "medium" and r["readiness/codeowners"] == "low" and r["readiness/license"] == "info"


def test_plan(make_files):
    f = make_files([(".env", "API_KEY=abc123\nexport DB_URL=postgres://u:p@h/d\n"), ("package.json", "{}"),
                    (".gitignore", ".env\n*.pem\n")])
    plan = {r["key"]: r for r in G.remediation_plan(f).collect()}
    assert plan["env-example"]["names"] == ["API_KEY", "DB_URL"]
    assert ".env" not in plan["gitignore"]["names"] and "*.key" in plan["gitignore"]["names"]
    assert plan["dep-updates"]["names"] == ["npm"] and "security-txt" not in plan


def test_manual_steps(spark):
    rows = [("r", "secret/aws-access-key", "t", "critical", "secrets", "a", 1, "e", "", ""),
            ("q", "deps/X", "t", "low", "deps", "a", 0, "e", "", "")]
    m = G.manual_steps(spark.createDataFrame(rows, FINDING_SCHEMA)).collect()
    r = sorted((x["repo_id"], x["step_no"]) for x in m)
    assert ("r", 0) in r and ("q", 3) in r and ("r", 1) not in r and len([x for x in r if x[0] == "r"]) == 4
