from conftest import ids

from codeaudit.operators import config


def _scan(make_files, rows):
    return config.config_findings(make_files(rows))


def test_container_file_checks(make_files):
    plain = _scan(make_files, [("svc/Dockerfile.web", "FROM alpine:3.19\nCOPY bin /bin\nENTRYPOINT [\"/bin/run\"]\n")])
    assert ids(plain) == {"config/docker-root-user", "config/docker-no-healthcheck"}
    rooted = _scan(make_files, [("Dockerfile", "FROM alpine:3.19\nUSER root\nUSER 0\nHEALTHCHECK CMD /bin/ok\n")])
    assert ids(rooted) == {"config/docker-root-user"}
    assert ids(_scan(make_files, [("Dockerfile", "FROM alpine:3.19\nUSER 0\nUSER web\nHEALTHCHECK CMD /bin/ok\n")])) == set()


def test_key_files_by_tracking(make_files):
    """Outside git and in its index a key file counts as committed, else as one `git add` away."""
    seen = {}
    for tracked in (None, True, False):
        (r,) = _scan(make_files, [("deploy/id_ed25519", "k\n", tracked)]).collect()
        seen[tracked] = (r["id"], r["severity"])
    assert seen[None] == seen[True] == ("config/committed-secret-file", "critical")
    assert seen[False] == ("config/untracked-secret-file", "medium")


def test_sample_key_files_are_exempt(make_files):
    rows = [("credentials.sample", "x\n"), ("template.pem", "x\n"), (".env.example", "A=\n")]
    assert not ids(_scan(make_files, rows)) & {"config/committed-secret-file", "config/untracked-secret-file"}


def test_public_binding_needs_its_context(make_files):
    rows = [("bind.yaml", "bindings:\n- members:\n  - allAuthenticatedUsers\n  role: viewer\n"), ("words.js", "// who may be allUsers here?\n")]
    found = _scan(make_files, rows).filter("id = 'config/gcp-allusers'").collect()
    assert [(r["path"], r["line"]) for r in found] == [("bind.yaml", 2)] or [r["path"] for r in found] == ["bind.yaml"]


def test_action_owner_decides_the_severity(make_files):
    steps = "".join(f"    - uses: {u}\n" for u in ("github/codeql-action@v3", "acme/ship@main", "acme/ship@" + "0a" * 20))
    r = _scan(make_files, [(".github/workflows/release.yaml", "steps:\n" + steps)]).filter("id = 'config/ci-unpinned-action'").collect()
    assert sorted((x["severity"], x["title"].split(" ")[0], x["line"]) for x in r) == [("low", "First-party", 2), ("medium", "Third-party", 3)]


def test_docs_and_tests_rank_lower(make_files):
    line = "requests.get(u, verify=False)\n"
    r = {x["path"]: x for x in _scan(make_files, [("lib/net.py", line), ("spec/net.py", line)]).collect()}
    assert r["lib/net.py"]["severity"] == "high" and "test/docs" not in r["lib/net.py"]["title"]
    assert r["spec/net.py"]["severity"] in ("medium", "low") and r["spec/net.py"]["title"].endswith("(in test/docs path)")


def test_generated_bundles_are_left_alone(make_files):
    line = "x.outerHTML = y;" * 2000
    assert _scan(make_files, [("dist/app.min.js", line), ("dist/app.js", line)]).count() == 0
    assert _scan(make_files, [("src/app.js", "x.outerHTML = y;\n" * 20)]).count() == 20


def test_line_numbers(make_files):
    r = _scan(make_files, [("docker-compose.yml", "services:\n  a:\n    privileged: true\n")]).collect()
    assert {(x["id"], x["line"]) for x in r} >= {("config/compose-privileged", 3)}


def test_build_arg_values_are_redacted(make_files):
    from codeaudit.operators import config
    value = "Zq8" + "Rw3Np6Ty1Kd=x"
    f = make_files([("Dockerfile", f"FROM a:1\nARG API_TOKEN={value}\nENV DB_PASSWORD {value}\nUSER app\nHEALTHCHECK CMD true\n")])
    got = [r["evidence"] for r in config.config_findings(f).filter("id = 'config/docker-secret-arg'").collect()]
    assert len(got) == 2 and all(value not in e and e.startswith(("ARG API_TOKEN=Zq*", "ENV DB_PASSWORD Zq*")) for e in got)
    raw = config.config_findings(f, raw_values=True).filter("id = 'config/docker-secret-arg'").collect()
    assert all(value in r["evidence"] for r in raw)
