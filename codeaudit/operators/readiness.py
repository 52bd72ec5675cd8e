"""Security-readiness checks.

Each file contributes a boolean per check (its name, path, ancestor dirs,
name glob, or a content pattern when the file is a target); a repo passes a
check when any of its files does — ``bool_or`` per (repo, check), which the
hash aggregate combines map-side.  Score = round-half-even(100·earned/total).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCANNER = "readiness"


@dataclass(frozen=True)
class Check:
    key: str
    label: str
    weight: int
    why: str
    fix: str
    files: tuple = field(default=())
    dirs: tuple = field(default=())
    globs: tuple = field(default=())
    content: tuple = field(default=())
    targets: tuple = field(default=())


# FIXED VALUES — check keys, labels, weights and matcher specs (texts are ours).
CHECKS: list[Check] = [
    Check("lockfile", "Dependencies are lock-pinned", 6,
          "Unpinned dependencies let a hijacked release reach production.", "Commit a lockfile.",
          files=("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb",
                 "poetry.lock", "uv.lock", "Pipfile.lock", "Cargo.lock", "go.sum", "Gemfile.lock")),
    Check("dep-updates", "Automated dependency updates", 6,
          "Known CVEs linger when nobody upgrades.", "Add a dependabot or renovate configuration.",
          files=("dependabot.yml", "dependabot.yaml", "renovate.json", ".renovaterc", "renovate.json5")),
    Check("ci", "Continuous integration configured", 5,
          "Without CI nothing is verified before it ships.", "Add a CI workflow that lints and tests every change.",
          dirs=(".github/workflows",),
          files=(".gitlab-ci.yml", ".circleci/config.yml", "Jenkinsfile", "azure-pipelines.yml")),
    Check("tests", "Automated tests present", 6,
          "Fixes without tests get reverted silently.", "Add a tests directory and run it in CI.",
          dirs=("tests", "test", "__tests__", "spec"),
          globs=("*_test.go", "*.test.ts", "*.test.js", "test_*.py", "*_test.py", "*.spec.ts")),
    Check("secret-scanning", "Secret scanning in CI", 8,
          "Committed keys are the most common early breach.", "Run a secret scanner in CI and as a pre-commit hook.",
          content=(r"(?i)gitleaks|trufflehog|detect-secrets|codeaudit|ggshield",),
          targets=(".github/workflows", ".pre-commit-config.yaml", ".gitlab-ci.yml")),
    Check("sast", "Static analysis / code scanning", 5,
          "Security questionnaires ask for static analysis.", "Enable a static analyser in CI.",
          content=(r"(?i)codeql|semgrep|bandit|gosec|snyk|sonarqube|bearer",),
          targets=(".github/workflows", ".gitlab-ci.yml", "Makefile", "pyproject.toml")),
    Check("precommit", "Pre-commit hooks", 3,
          "A laptop hook is the cheapest place to stop a secret.", "Add a pre-commit configuration.",
          files=(".pre-commit-config.yaml", ".husky", "lefthook.yml")),
    Check("codeowners", "Code review ownership defined", 4,
          "Unreviewed merges fail change-management controls.", "Add CODEOWNERS and require reviews.",
          files=("CODEOWNERS",)),
    Check("security-policy", "Vulnerability disclosure policy", 4,
          "Researchers need a place to report issues.", "Add SECURITY.md with a contact.",
          files=("SECURITY.md", "security.md", "SECURITY.txt")),
    Check("env-example", "Config documented without secrets", 3,
          "An example env file shows configuration is externalised.", "Add .env.example with empty values.",
          files=(".env.example", ".env.sample", ".env.template", "env.example")),
    Check("iac", "Infrastructure as code", 4,
          "Hand-built infrastructure cannot be reviewed or restored.", "Describe infrastructure in code.",
          globs=("*.tf", "*.bicep"),
          files=("docker-compose.yml", "docker-compose.yaml", "Pulumi.yaml", "serverless.yml", "template.yaml")),
    Check("containerized", "Reproducible build/runtime definition", 3,
          "A container definition makes the runtime auditable.", "Add a Dockerfile.",
          globs=("Dockerfile*",)),
    Check("observability", "Error tracking / monitoring wired in", 5,
          "Incidents you never see cannot be answered.", "Wire in error tracking or metrics with alerting.",
          content=(r"(?i)\bsentry\b|opentelemetry|datadog|newrelic|honeycomb|prometheus|logtail|betterstack",),
          targets=("package.json", "pyproject.toml", "requirements.txt", "go.mod", "Gemfile")),
    Check("auth-lib", "Vetted auth implementation", 4,
          "Hand-rolled authentication is where user data leaks.", "Use a vetted authentication library.",
          content=(r"(?i)next-?auth|@auth/|auth0|clerk|supabase|firebase-admin|django\.contrib\.auth|devise|passport|lucia|better-auth|authlib",),
          targets=("package.json", "pyproject.toml", "requirements.txt", "Gemfile", "go.mod")),
    Check("incident-plan", "Incident response / runbook documented", 5,
          "Contracts require a documented breach process.", "Document severities, on-call and notification.",
          content=(r"(?i)incident response|runbook|on-?call|postmortem|breach notification",),
          targets=("docs", "README.md", "SECURITY.md", "RUNBOOK.md")),
    Check("backups", "Backup / recovery documented", 4,
          "Only tested restores recover from data loss.", "Document backups and a tested restore.",
          content=(r"(?i)backup|restore|point-in-time|disaster recovery|pg_dump",),
          targets=("docs", "README.md", "Makefile", "scripts")),
    Check("privacy", "Privacy policy / data handling documented", 3,
          "Personal data handling must be documented.", "Publish a privacy policy and data inventory.",
          content=(r"(?i)privacy policy|gdpr|ccpa|data processing|dpa\b|subprocessor",),
          targets=("docs", "README.md", "PRIVACY.md", "legal")),
    Check("license", "License declared", 2,
          "Unlicensed code is an IP risk in diligence.", "Add a LICENSE file.",
          files=("LICENSE", "LICENSE.md", "LICENSE.txt", "COPYING")),
]
# FIXED VALUES — the attestations that cannot be read from code.
MANUAL = [
    "MFA enforced on GitHub, cloud, email, and the domain registrar",
    "Branch protection: required reviews + status checks on the default branch",
    "Least-privilege cloud IAM (no long-lived root/admin keys)",
    "Offboarding checklist that revokes SSO, repo, and cloud access same-day",
    "Encrypted backups with a restore tested in the last 90 days",
    "Vendor/subprocessor list maintained for customer security reviews",
]
CONTENT_LIMIT = 400_000
TOTAL_WEIGHT = sum(c.weight for c in CHECKS)


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a relative path ('a', 'a/b', …)."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                     lambda i: F.array_join(F.slice(parts, 1, i), "/"))
                  ).otherwise(F.array().cast("array<string>"))


def _dir_match(d: str):
    def f(x: Column) -> Column:
        return (x == d) | x.endswith("/" + d)
    return f


def _check_expr(c: Check, path: Column, name: Column, dirs: Column, content: Column) -> Column:
    from codeaudit.rules import java_pattern
    cond = F.lit(False)
    for f in c.files:
        cond = cond | (name == f) | (path == f) | F.array_contains(dirs, f)
    for d in c.dirs:
        cond = cond | F.exists(dirs, _dir_match(d))
    for g in c.globs:
        pref, _, suf = g.partition("*")
        cond = cond | (name.startswith(pref) & name.endswith(suf))
    if c.content:
        targeted = F.lit(False)
        for t in c.targets:
            targeted = targeted | (path == t) | path.startswith(t + "/") | path.endswith("/" + t) | (name == t)
        head = F.substring(content, 1, CONTENT_LIMIT)
        hit = F.lit(False)
        for p in c.content:
            hit = hit | head.rlike(java_pattern(p))
        cond = cond | (targeted & F.coalesce(hit, F.lit(False)))
    return cond


def check_results(files: DataFrame) -> DataFrame:
    """One row per (repo, check): key, label, weight, passed."""
    path, name = F.col("path"), F.element_at(F.split("path", "/"), -1)
    f = files.select("repo_id", "path", name.alias("name"), ancestors(path).alias("dirs"), "content")
    flags = f.select("repo_id", *[_check_expr(c, F.col("path"), F.col("name"), F.col("dirs"), F.col("content"))
                                  .alias(f"c{i}") for i, c in enumerate(CHECKS)])
    per_repo = flags.groupBy("repo_id").agg(*[F.bool_or(f"c{i}").alias(f"c{i}") for i in range(len(CHECKS))])
    meta = F.array(*[F.struct(F.lit(c.key).alias("key"), F.lit(c.label).alias("label"),
                              F.lit(c.weight).alias("weight"), F.lit(i).alias("i")) for i, c in enumerate(CHECKS)])
    passed = F.array(*[F.col(f"c{i}") for i in range(len(CHECKS))])
    return per_repo.select("repo_id", F.explode(F.arrays_zip(meta.alias("m"), passed.alias("p"))).alias("z")) \
        .select("repo_id", F.col("z.m.key").alias("key"), F.col("z.m.label").alias("label"),
                F.col("z.m.weight").alias("weight"), F.col("z.p").alias("passed"))


def readiness_scores(files: DataFrame) -> DataFrame:
    """Score, earned, total and tier per repo."""
    r = check_results(files)
    s = r.groupBy("repo_id").agg(
        F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0)).cast("long").alias("earned"),
        F.sum("weight").cast("long").alias("total"))
    score = F.bround(F.lit(100.0) * F.col("earned") / F.col("total"), 0).cast("long")
    tier = (F.when(F.col("score") >= 85, "Enterprise-ready").when(F.col("score") >= 70, "Diligence-ready")
            .when(F.col("score") >= 45, "Early-stage gaps").otherwise("Pre-security"))
    return s.withColumn("score", score).withColumn("tier", tier).select("repo_id", "score", "earned", "total", "tier")


def readiness_findings(files: DataFrame) -> DataFrame:
    """One finding per failed check; weight ≥6 medium, ≥4 low, else info."""
    r = check_results(files).filter(~F.col("passed"))
    why = F.create_map(*[x for c in CHECKS for x in (F.lit(c.key), F.lit(c.why))])
    fix = F.create_map(*[x for c in CHECKS for x in (F.lit(c.key), F.lit(c.fix))])
    sev = F.when(F.col("weight") >= 6, "medium").when(F.col("weight") >= 4, "low").otherwise("info")
    return r.select("repo_id", F.concat(F.lit("readiness/"), "key").alias("id"),
                    F.concat(F.lit("Missing: "), "label").alias("title"), sev.alias("severity"),
                    F.lit(SCANNER).alias("scanner"), F.lit(".").alias("path"), F.lit(0).alias("line"),
                    why[F.col("key")].alias("evidence"), fix[F.col("key")].alias("remediation"),
                    F.lit("").alias("reference"))


# Follow-up steps triggered by the finding ids present (G5); the triggers
# follow the behaviour reproduced, the texts are ours.
MANUAL_STEPS = [
    ("rotate", "Rotate every reported credential: finding a key does not un-leak it."),
    ("purge", "Purge the leaked files from history, force-push, and have collaborators re-clone."),
    ("untrack", "Untrack committed credential files (git rm --cached)."),
    ("upgrade", "Upgrade the vulnerable dependencies, then scan again."),
]
MANUAL_SHOWN = 3


def manual_steps(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Per repo, the steps a tool must not take itself (in order), then the
    first three attestations."""
    i = F.col("id")
    flags = findings.groupBy("repo_id").agg(
        F.bool_or(i.startswith("secret/") | i.startswith("git-history/")).alias("rotate"),
        F.bool_or(i.startswith("git-history/")).alias("purge"),
        F.bool_or(i.isin("config/committed-secret-file", "git/tracked-secret-file")).alias("untrack"),
        F.bool_or(i.startswith("deps/")).alias("upgrade"))
    if repos is not None:
        flags = repos.select("repo_id").distinct().join(flags, "repo_id", "left").fillna(False)
    steps = F.array(*[F.when(F.col(k), F.struct(F.lit(n).alias("n"), F.lit(t).alias("step")))
                      for n, (k, t) in enumerate(MANUAL_STEPS)],
                    *[F.struct(F.lit(len(MANUAL_STEPS) + n).alias("n"), F.lit(m).alias("step"))
                      for n, m in enumerate(MANUAL[:MANUAL_SHOWN])])
    return flags.select("repo_id", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("s")) \
        .select("repo_id", F.col("s.n").cast("int").alias("step_no"), F.col("s.step").alias("step"))


# FIXED VALUES — ignore lines a repo should carry, and ecosystems by root file.
GITIGNORE_LINES = [
    ".env", ".env.*", "!.env.example", "*.pem", "*.key", "*.p12", "*.keystore",
    "id_rsa", "id_ed25519", "credentials", "service-account.json",
    "terraform.tfstate", "terraform.tfstate.backup", ".codeaudit-cache.json",
]
ECOSYSTEM_BY_FILE = [
    ("package.json", "npm"), ("package-lock.json", "npm"), ("yarn.lock", "npm"),
    ("pnpm-lock.yaml", "npm"), ("bun.lock", "bun"), ("bun.lockb", "bun"),
    ("requirements.txt", "pip"), ("pyproject.toml", "pip"),
    ("Pipfile", "pip"), ("poetry.lock", "pip"), ("go.mod", "gomod"),
    ("Cargo.toml", "cargo"), ("Gemfile", "bundler"), ("Dockerfile", "docker"),
]
ENV_NAME_PATTERN = r"(?m)^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="


def remediation_plan(files: DataFrame) -> DataFrame:
    """G6 (data part): per repo, the safe additive fixes — missing ignore lines,
    a disclosure policy, an update configuration for the detected ecosystems,
    an env example (variable names only), an incident plan, security.txt."""
    from codeaudit.rules import java_pattern
    p = F.col("path")
    root = files.select("repo_id", "path", "content")
    g = root.groupBy("repo_id").agg(
        F.max(F.when(p == ".gitignore", F.coalesce("content", F.lit("")))).alias("gi"),
        F.bool_or(p == "SECURITY.md").alias("has_sec"),
        F.bool_or(p.isin(".github/dependabot.yml", "renovate.json")).alias("has_updates"),
        F.bool_or(p == "bun.lock").alias("has_bun"), F.bool_or(p == "bun.lockb").alias("has_bunb"),
        F.collect_set(F.when(p.isin(*[f for f, _e in ECOSYSTEM_BY_FILE]), p)).alias("eco_files"),
        F.min_by(F.when(p.isin(".env", ".env.local"), F.col("content")),
                 F.when(p == ".env", 0).when(p == ".env.local", 1)).alias("env"),
        F.bool_or(p == ".env.example").alias("has_example"),
        F.bool_or(p.isin("docs/INCIDENT-RESPONSE.md", "INCIDENT-RESPONSE.md")).alias("has_ir"),
        F.bool_or(p == ".well-known/security.txt").alias("has_sectxt"),
        F.bool_or(p == "index.html").alias("has_index"))
    lines = F.split(F.coalesce("gi", F.lit("")), r"\r?\n")
    missing = F.filter(F.array(*[F.lit(x) for x in GITIGNORE_LINES]), lambda x: ~F.array_contains(lines, x))
    ecos = F.array_distinct(F.filter(F.array(*[
        F.when(F.array_contains("eco_files", f) & ~((F.lit(e) == "npm") & F.lit(f == "package.json")
                                                   & (F.col("has_bun") | F.col("has_bunb"))), F.lit(e))
        for f, e in ECOSYSTEM_BY_FILE]), lambda x: x.isNotNull()))
    keys = F.regexp_extract_all(F.coalesce("env", F.lit("")), F.lit(java_pattern(ENV_NAME_PATTERN)), F.lit(1))
    fix = lambda k, d, path, cond: F.when(cond, F.struct(F.lit(k).alias("key"), d.alias("description"),
                                                          F.lit(path).alias("path"), F.array().cast("array<string>").alias("names")))
    rows = F.array(
        F.when(F.size(missing) > 0, F.struct(F.lit("gitignore").alias("key"),
               F.concat(F.lit("add "), F.size(missing).cast("string"), F.lit(" secret patterns to .gitignore")).alias("description"),
               F.lit(".gitignore").alias("path"), missing.alias("names"))),
        fix("security-policy", F.lit("create SECURITY.md (vulnerability disclosure policy)"), "SECURITY.md",
            ~F.col("has_sec")),
        F.when(~F.col("has_updates"), F.struct(F.lit("dep-updates").alias("key"),
               F.concat(F.lit("create .github/dependabot.yml ("),
                        F.when(F.size(ecos) > 0, F.array_join(ecos, ", ")).otherwise(F.lit("actions")), F.lit(")")).alias("description"),
               F.lit(".github/dependabot.yml").alias("path"), ecos.alias("names"))),
        F.when(F.col("env").isNotNull() & ~F.col("has_example"), F.struct(F.lit("env-example").alias("key"),
               F.lit("derive .env.example from .env (names only, no values)").alias("description"),
               F.lit(".env.example").alias("path"), keys.alias("names"))),
        fix("incident-plan", F.lit("create docs/INCIDENT-RESPONSE.md"), "docs/INCIDENT-RESPONSE.md", ~F.col("has_ir")),
        fix("security-txt", F.lit("publish /.well-known/security.txt"), ".well-known/security.txt",
            ~F.col("has_sectxt") & F.col("has_index")))
    return g.select("repo_id", F.posexplode(F.filter(rows, lambda x: x.isNotNull())).alias("fix_no", "f")) \
        .select("repo_id", F.col("fix_no").cast("int").alias("fix_no"), "f.key", "f.description", "f.path", "f.names")
