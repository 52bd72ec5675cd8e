from conftest import FAKE_AWS, FAKE_DSN

from codeaudit.operators import history as HI
from codeaudit.operators import hygiene as HY
from codeaudit.operators import surface as H


def _lines(spark, text, repo="r"):
    return spark.createDataFrame([(repo, i, ln) for i, ln in enumerate(text.split("\n"))],
                                 "repo_id string, seq long, line string")


def test_history_attributes_path_and_downgrades_fixtures(spark):
    log = "\n".join([
        "commit 2222222222222222222222222222222222222222",
        "diff --git a/prod.py b/prod.py", "--- a/prod.py", "+++ b/prod.py", "@@ -1 +1 @@",
        f'-KEY = "{FAKE_AWS}"', "+KEY = os.environ['KEY']",
        "commit 1111111111111111111111111111111111111111",
        "+++ b/tests/fixture.py", f'+DSN = "{FAKE_DSN}"',
        "+++ b/prod.py", f'+KEY = "{FAKE_AWS}"',
        "commit 0000000000000000000000000000000000000000",
        "+++ b/later.py", f'+AGAIN = "{FAKE_AWS}"'])
    r = {x["id"]: x for x in HI.history_findings(_lines(spark, log)).collect()}
    aws = r["git-history/aws-access-key"]
    assert aws["severity"] == "critical" and aws["path"] == "prod.py @ 11111111"
    assert r["git-history/db-url"]["severity"] == "medium" and "(test/docs path)" in r["git-history/db-url"]["title"]
    assert len(r) == 2  # the same key in a later commit is not reported twice


def test_history_skips_generic_and_placeholders(spark):
    log = "commit 3333333333333333333333333333333333333333\n+++ b/a.py\n+client_secret = \"Zr9Z4qLpX2wKmT7vNbHs\"\n" \
          "+url = \"postgresql://user:changeme@db/x\""
    assert HI.history_findings(_lines(spark, log)).count() == 0


def _files(make_files, rows):
    return make_files(rows)


def test_gitignore_pem_gap_only_with_key_material(make_files):
    f = make_files([(".gitignore", ".env\n"), ("app.py", "x=1\n")])
    assert {r["evidence"] for r in HY.gitignore_findings(f).collect()} == set()
    f2 = make_files([(".gitignore", ".env\n"), ("server.pem", "-----BEGIN CERTIFICATE-----\n", False)])
    assert {r["evidence"] for r in HY.gitignore_findings(f2).collect()} == {"*.pem"}
    f3 = make_files([("app.py", "x=1\n"), ("package.json", "{}")])
    assert {r["id"] for r in HY.gitignore_findings(f3).collect()} == {"git/no-gitignore"}
    f4 = make_files([(".gitignore", "*.pem\n"), ("package.json", "{}")])
    assert {r["evidence"] for r in HY.gitignore_findings(f4).collect()} == {".env", "node_modules"}


def test_tracked_secret_files(make_files):
    f = make_files([(".env", "A=1\n", True), ("certs/server.pem", "x", True), (".env.example", "A=\n", True),
                    ("other.pem", "x", False)])
    got = {(r["path"], r["severity"]) for r in HY.tracked_secret_files(f).collect()}
    assert got == {(".env", "critical"), ("certs/server.pem", "high")}


def test_remote_credentials(spark):
    repos = spark.createDataFrame([("a", "https://user:" + "tok3nvalue123456@github.com/o/r.git"),
                                   ("b", "https://github.com/o/r.git"), ("c", "git@github.com:o/r.git")],
                                  "repo_id string, origin_url string")
    r = HY.remote_credentials(repos).collect()
    assert [x["repo_id"] for x in r] == ["a"] and "tok3nvalue123456" not in r[0]["evidence"]


def test_surface_headers_and_tls(spark):
    obs = spark.createDataFrame([("h", "https://h", 200, "https://h",
                                  {"strict-transport-security": "max-age=600", "content-security-policy": "default-src 'unsafe-inline'",
                                   "server": "nginx/1.2", "access-control-allow-origin": "*"},
                                  ["sid=1; Secure; HttpOnly", "ok=1; Secure; HttpOnly; SameSite=Lax"], None)],
                                "host string, url string, status int, final_url string, headers map<string,string>, "
                                "set_cookie array<string>, error string")
    ids = [r["id"] for r in H.header_findings(obs).collect()]
    assert {"surface/hsts-short", "surface/csp-unsafe-inline", "surface/version-disclosure", "surface/cors-wildcard",
            "surface/x-frame-options", "surface/referrer-policy"} <= set(ids)
    assert ids.count("surface/cookie-flags") == 1 and "surface/strict-transport-security" not in ids
    tls = spark.createDataFrame([("h", "TLSv1.1", "Jan  5 00:00:00 2025 GMT", None), ("x", "TLSv1.3", "Jan 1 00:00:00 2030 GMT", "bad chain")],
                                "host string, version string, not_after string, verify_error string")
    t = {(r["repo_id"], r["id"], r["severity"]) for r in H.tls_findings(tls, "2025-01-01 00:00:00").collect()}
    assert t == {("h", "surface/tls-old", "high"), ("h", "surface/cert-expiring", "high"), ("x", "surface/tls-invalid", "critical")}


def test_surface_unreachable(spark):
    obs = spark.createDataFrame([("h", "https://h", None, None, None, None, "URLError")],
                                "host string, url string, status int, final_url string, headers map<string,string>, "
                                "set_cookie array<string>, error string")
    r = [(x["id"], x["severity"], x["evidence"]) for x in H.header_findings(obs).collect()]
    assert r == [("surface/unreachable", "info", "URLError")]
