"""Misconfiguration detector (R3–R7) over the ``files`` table.

* R6 dangerous file names: first rule in table order wins; names containing
  example/sample/template are exempt; tracked (or not a git repo) → committed,
  untracked → a downgraded near-miss.
* R3 pattern rules restricted by glob (F10) and, for code rules, by extension
  (F12); evidence is the stripped match cut to 160 characters.
* R5 action pins: GitHub-owned orgs rank low, others medium.
* R7 Dockerfile structure: no non-root USER, no HEALTHCHECK.
* Low-trust paths downgrade every finding of an eligible, non-empty,
  non-minified file, titles say so.
* R4 (the per-file cap of ~200 findings) is a parameter, off by default: every
  match is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.functions.regex import ScanRule, rule_matches
from codeaudit.functions.text import glob_match, is_low_trust, is_minified, path_glob_match
from codeaudit.model import DOWNGRADE, _map_lit, downgrade, redact, strip_ws

SCANNER = "config"
KEYS = ["repo_id", "path"]
SECRET_FILE_REF = "https://cwe.mitre.org/data/definitions/540.html"

# Necessary literals per rule (case-insensitive rules are checked on lower-cased text).
HINTS: dict[str, tuple[tuple, tuple]] = {
    "docker-latest-tag": ((), (":latest",)),
    "docker-add-remote": ((), ("add",)),
    "docker-secret-arg": ((), ("arg", "env")),
    "compose-privileged": ((), ("privileged",)),
    "compose-host-network": ((), ("network_mode",)),
    "k8s-privileged": ((), ("privileged",)),
    "k8s-host-path": ((), ("hostpath:",)),
    "tf-open-ingress": (("cidr_blocks",), ()),
    "tf-public-bucket": (("public-read",), ()),
    "tf-unencrypted": ((), ("encrypted",)),
    "ci-pull-request-target": ((), ("pull_request_target",)),
    "ci-unpinned-action": ((), ("uses:",)),
    "ci-script-injection": (("github.event.",), ()),
    "cors-wildcard": ((), ("access-control-allow-origin", "cors(", "allow_origins")),
    "debug-enabled": ((), ("debug",)),
    "tls-verify-off": ((), ("verify", "rejectunauthorized", "insecureskipverify", "curl")),
    "weak-hash": ((), ("hashlib.", "createhash(")),
    "shell-injection": ((), ("subprocess.", "os.system(", "child_process.exec(")),
    "sql-injection": ((), ("execute", "query")),
    "eval-use": ((), ("eval(", "new function(", "pickle.loads(", "yaml.load(")),
    "public-env-secret": (("NEXT_PUBLIC_", "VITE_", "REACT_APP_", "PUBLIC_", "GATSBY_"), ()),
    "token-in-localstorage": ((), ("localstorage.setitem(", "sessionstorage.setitem(")),
    "react-dangerous-html": (("dangerouslySetInnerHTML",), ()),
    "dom-innerhtml": (("innerHTML", "outerHTML"), ()),
    "postmessage-wildcard": ((".postMessage(",), ()),
    "jwt-none-alg": ((), ("algorithm", "verify", "jwt.decode(")),
    "llm-browser-key": (("dangerouslyAllowBrowser",), ()),
    "llm-prompt-injection": ((), ("prompt", "messages", "system")),
    "llm-unbounded-exec": ((), ("exec", "eval", "subprocess.", "os.system", "child_process.")),
    "llm-tool-args-eval": ((), ("eval(", "exec(", "function(")),
    "llm-secret-in-prompt": ((), ("prompt", "system", "messages")),
    "llm-output-unsanitized-render": ((), ("dangerouslysetinnerhtml", ".innerhtml")),
    "llm-unbounded-tokens": ((), (".create(",)),
    "firebase-open-rules": (("allow",), ()),
    "iam-wildcard-principal": (("Principal",), ()),
    "iam-wildcard-action": (("Action",), ()),
    "gcp-allusers": (("allUsers", "allAuthenticatedUsers"), ()),
    "curl-pipe-shell": (("curl", "wget"), ()),
}

SCAN_RULES = [ScanRule(r.id, i, R.java_pattern(r.pattern), 0, HINTS[r.id][0], HINTS[r.id][1])
              for i, r in enumerate(R.CONFIG_RULES)]
_CODE_IDS = set(R.CODE_RULE_IDS)


def _meta(field: str, col: str = "rule_id") -> Column:
    return _map_lit({r.id: getattr(r, field) for r in R.CONFIG_RULES})[F.col(col)]


def file_flags(files: DataFrame) -> DataFrame:
    """Per-file flags shared by the file detectors, computed once per file:
    ``scanned`` (config-eligible, non-empty, within the cap, not minified),
    ``secret_ok`` (non-empty, within the cap), ``minified``, ``low_trust``."""
    name, ext = F.col("name"), F.col("ext")
    eligible = ext.isin(*R.CODE_EXT) | F.lit(False)
    for p in R.CONFIG_NAME_PREFIXES:
        eligible = eligible | name.startswith(p)
    has_text = F.coalesce(F.length("content") > 0, F.lit(False)) & (F.col("size") <= R.MAX_FILE_BYTES)
    f = files.select(*KEYS, "name", "ext", "tracked", "content", has_text.alias("secret_ok"),
                     eligible.alias("_eligible"), is_minified(name, F.col("content")).alias("minified"),
                     is_low_trust(F.col("path"), name).alias("low_trust"))
    return f.withColumn("scanned", F.col("_eligible") & F.col("secret_ok") & ~F.col("minified")).drop("_eligible")


def _dangerous_idx() -> Column:
    first = None
    for i, (pat, _sev, _why) in enumerate(R.DANGEROUS_FILES):
        hit = glob_match("name", pat) if "*" in pat else (F.col("name") == pat)
        first = F.when(hit, F.lit(i)) if first is None else first.when(hit, F.lit(i))
    exempt = F.lit(False)
    for w in R.EXEMPT_NAME_WORDS:
        exempt = exempt | F.col("name").contains(w)
    return F.when(~exempt, first)


def _action_pin(evidence: Column) -> tuple[Column, Column]:
    rx = R.java_pattern(R.ACTION_USES_PATTERN)
    org = F.regexp_extract(evidence, rx, 1)
    repo = F.regexp_extract(evidence, rx, 2)
    ref = F.regexp_extract(evidence, rx, 3)
    found = evidence.rlike(rx)
    first_party = F.lower(org).isin(*R.FIRST_PARTY_ACTION_ORGS)
    sev = F.when(~found, "medium").when(first_party, "low").otherwise("medium")
    who = F.when(first_party, F.lit("First-party")).otherwise(F.lit("Third-party"))
    title = F.when(~found, F.lit("GitHub Action pinned to a mutable ref")).otherwise(
        F.concat(who, F.lit(" action "), org, F.lit("/"), repo, F.lit(" pinned to the mutable tag `"), ref, F.lit("`")))
    return sev, title


DANGER_ID, ROOT_ID, HEALTH_ID = "@dangerous-file", "@docker-root-user", "@docker-no-healthcheck"
DANGER_ORD, ROOT_ORD, HEALTH_ORD = -1, 1000, 1001


def scan_spec(f: DataFrame) -> tuple[dict, list]:
    """(applies, extra) for ``rule_matches`` on a ``file_flags`` frame with ``didx``."""
    applies = {}
    for r in R.CONFIG_RULES:
        a = F.col("scanned") & path_glob_match(F.col("path"), F.col("name"), r.glob)
        if r.id in _CODE_IDS:
            a = a & F.col("ext").isin(*R.CODE_EXT)
        applies[r.id] = a
    docker = F.col("scanned") & F.col("name").startswith("Dockerfile")
    users = F.regexp_extract_all("content", F.lit(R.java_pattern(R.DOCKER_USER_PATTERN)), F.lit(1))
    root_only = (F.size(users) == 0) | F.forall(users, lambda u: F.lower(u).isin("root", "0"))
    no_health = ~F.col("content").rlike(R.java_pattern(R.DOCKER_HEALTH_PATTERN))
    extra = [(DANGER_ID, DANGER_ORD, F.col("didx").isNotNull(), F.col("name")),
             (ROOT_ID, ROOT_ORD, docker & root_only, F.lit("no non-root USER directive")),
             (HEALTH_ID, HEALTH_ORD, docker & no_health, F.lit(""))]
    return applies, extra


CARRY = ["name", "tracked", "scanned", "low_trust", "didx"]


def config_matches(files: DataFrame) -> DataFrame:
    """One pass over the files: pattern-rule matches plus file-level
    pseudo-matches for dangerous names and Dockerfile structure."""
    f = file_flags(files).withColumn("didx", _dangerous_idx())
    applies, extra = scan_spec(f)
    return rule_matches(f, KEYS, "content", SCAN_RULES, carry=CARRY, applies=applies, extra=extra)


# Rules whose match holds a credential's value, and what comes before the value.
VALUE_RULES = {"docker-secret-arg": r"(?is)^((?:ARG|ENV)\s+\w+\s*[= ]\s*)\S"}


def config_findings(files: DataFrame, with_order: bool = False, cap: int | None = None, raw_values: bool = False) -> DataFrame:
    return findings_from_matches(config_matches(files), with_order, cap, raw_values)


def findings_from_matches(m: DataFrame, with_order: bool = False, cap: int | None = None,
                          raw_values: bool = False) -> DataFrame:
    """Config findings from match rows carrying ``CARRY``.  Values that rules of
    ``VALUE_RULES`` matched are redacted unless ``raw_values`` is set."""
    rid = F.col("rule_id")
    is_danger, is_root, is_health = rid == DANGER_ID, rid == ROOT_ID, rid == HEALTH_ID
    is_pin = rid == "ci-unpinned-action"
    pin_sev, pin_title = _action_pin(F.col("match"))
    d_sev = F.element_at(F.array(*[F.lit(x) for _, x, _ in R.DANGEROUS_FILES]), F.col("didx") + 1)
    d_why = F.element_at(F.array(*[F.lit(x) for _, _, x in R.DANGEROUS_FILES]), F.col("didx") + 1)
    untracked = F.col("tracked").isNotNull() & ~F.col("tracked")
    fid = (F.when(is_danger, F.when(untracked, "config/untracked-secret-file").otherwise("config/committed-secret-file"))
            .when(is_root, "config/docker-root-user").when(is_health, "config/docker-no-healthcheck")
            .otherwise(F.concat(F.lit("config/"), rid)))
    title = (F.when(is_danger, F.when(untracked, F.concat(F.lit("`"), F.col("name"), F.lit(
                "` is present and not ignored — one `git add` from being committed"))).otherwise(d_why))
              .when(is_root, "Container runs as root").when(is_health, "No container HEALTHCHECK")
              .when(is_pin, pin_title).otherwise(_meta("title")))
    sev = (F.when(is_danger, F.when(untracked, downgrade(d_sev, DOWNGRADE, F.lit("low"))).otherwise(d_sev))
            .when(is_root, "medium").when(is_health, "info")
            .when(is_pin, pin_sev).otherwise(_meta("severity")))
    rem = (F.when(is_danger, F.when(untracked, F.concat(F.lit("Add `"), F.col("name"), F.lit(
                "` to .gitignore; it is not in git yet, so nothing needs rotating.")))
                  .otherwise("Ignore it, remove it from the index, purge history and rotate its contents."))
            .when(is_root, "Create an unprivileged user and switch to it before CMD/ENTRYPOINT.")
            .when(is_health, "Add a HEALTHCHECK so orchestrators can detect a wedged process.")
            .otherwise(_meta("remediation")))
    ref = (F.when(is_danger, SECRET_FILE_REF).when(is_root, "https://cwe.mitre.org/data/definitions/250.html")
            .when(is_health, "").otherwise(F.coalesce(_map_lit(R.CONFIG_REFERENCE)[rid], F.lit(""))))
    line = F.when(is_danger, F.lit(0)).otherwise(F.col("line")).cast("int")
    evidence = F.when(is_danger | is_root | is_health, F.col("match")) \
        .otherwise(F.substring(strip_ws(F.col("match")), 1, 160))
    for rule, head in ({} if raw_values else VALUE_RULES).items():
        known = F.regexp_extract(evidence, head, 1)
        evidence = F.when(rid == rule, F.concat(known, redact(F.substr(evidence, F.length(known) + 1), 2))).otherwise(evidence)
    down = F.col("scanned") & F.col("low_trust")
    out = m.select(
        "repo_id", fid.alias("id"),
        F.when(down, F.concat(title, F.lit(" (in test/docs path)"))).otherwise(title).alias("title"),
        F.when(down, downgrade(sev, DOWNGRADE)).otherwise(sev).alias("severity"),
        F.lit(SCANNER).alias("scanner"), "path", line.alias("line"), evidence.alias("evidence"),
        rem.alias("remediation"), ref.alias("reference"),
        F.lit(1).alias("ord_scanner"), F.col("rule_ord").alias("ord_rule"), F.col("start").alias("ord_pos"))
    if cap is not None:
        w = Window.partitionBy(*KEYS).orderBy("ord_rule", "ord_pos")
        out = out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap + 1).drop("_n")
    return out if with_order else out.drop("ord_scanner", "ord_rule", "ord_pos")
