"""The scan pipeline: detectors → dedupe → ∪ other scanners → baseline →
policy → scores, counts, gate.  Every input is a table keyed by ``repo_id``;
every output is a DataFrame.  Nothing is collected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.model import FINDING_COLUMNS
from codeaudit.operators import config as C
from codeaudit.operators import findings as A
from codeaudit.operators import history as HI
from codeaudit.operators import hygiene as HY
from codeaudit.operators import licenses as L
from codeaudit.operators import readiness as G
from codeaudit.operators import secrets as S
from codeaudit.operators import supply as SU
from codeaudit.operators import surface as H
from codeaudit.operators import vulns as V
from codeaudit.sources import manifests as M

ALL_SCANNERS = ["secrets", "config", "deps", "licenses", "git", "readiness", "surface"]


class ScanError(ValueError):
    pass


@dataclass
class ScanResult:
    findings: DataFrame
    scores: DataFrame
    counts: DataFrame
    gate: DataFrame
    readiness: DataFrame | None
    stats: DataFrame


def select_scanners(only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """the enabled scanner list; unknown names are an error."""
    enabled = list(only) if only else list(ALL_SCANNERS)
    if skip:
        enabled = [s for s in enabled if s not in set(skip)]
    bad = [s for s in enabled if s not in ALL_SCANNERS]
    if bad:
        raise ScanError(f"unknown scanner(s): {', '.join(bad)}")
    return enabled


class DiffRefError(RuntimeError):
    """A diff base that git could not resolve: scanning "nothing changed"
    would be a false green, so it is an error."""


def check_diff_refs(refs: DataFrame) -> None:
    """``refs`` = (repo_id, ref, resolved boolean) from the ingestion that
    listed the changed files; any unresolved ref is an error (a tiny action)."""
    bad = refs.filter(~F.coalesce(F.col("resolved"), F.lit(False))).limit(5).collect()
    if bad:
        raise DiffRefError("cannot resolve diff ref(s): " + ", ".join(f"{r['repo_id']}@{r['ref']}" for r in bad))


#: Hashes of keys that are sent to all tasks, at most.
SLOTS = 1 << 20


def key_slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("repo_id", "path", F.lit(1)), F.lit(slots)).cast("int")


def diff_scope(files: DataFrame, changed: DataFrame) -> DataFrame:
    """only the changed files (left-semi join on repo and path).  A bounded
    set of key hashes, broadcast, leaves out nearly all others first, so the
    join's exchange holds no more contents than the changed files have."""
    keys = changed.select("repo_id", "path").distinct()
    slots = keys.select(key_slot(SLOTS).alias("_slot")).distinct()
    near = files.withColumn("_slot", key_slot(SLOTS)).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return near.select(*files.columns).join(keys, ["repo_id", "path"], "left_semi")


def file_matches(files: DataFrame) -> DataFrame:
    """One pass over the file contents for both file detectors: the secret
    rules and the config rules (plus the file-level pseudo-matches) run in the
    same ``rule_matches`` scan, so contents are read once and the match rows
    share one exchange; the two detectors then split the rows by rule."""
    from codeaudit.functions.regex import rule_matches
    f = C.file_flags(files).withColumn("didx", C._dangerous_idx())
    applies, extra = C.scan_spec(f)
    applies.update({r.id: F.col("secret_ok") for r in S.SCAN_RULES})
    rules = list(S.SCAN_RULES) + [r.__class__(r.id, r.ord + CONFIG_ORD_OFFSET, r.pattern, r.group, r.hints, r.ihints)
                                  for r in C.SCAN_RULES]
    f = f.withColumn("secret_low_trust", S.secret_low_trust(F.col("path"), F.col("name")))
    return rule_matches(f, S.KEYS, "content", rules, carry=[*C.CARRY, "minified", "secret_low_trust"],
                        applies=applies, extra=extra)


CONFIG_ORD_OFFSET = 100
_SECRET_IDS = [r.id for r in S.SCAN_RULES]


def file_findings(files: DataFrame, enabled: list[str], kept: list[DataFrame] | None = None) -> DataFrame | None:
    """Secret + config findings of the given files, deduplicated (A2).  The
    persisted match rows are added to ``kept``, for callers that go on after
    the findings are written to release."""
    want_s, want_c = "secrets" in enabled, "config" in enabled
    if not (want_s or want_c):
        return None
    if want_s and want_c:
        from pyspark import StorageLevel
        # the two detectors filter the shared match rows by rule; kept once so
        # those filters are not pushed below the scan (which would run it twice)
        m = file_matches(files).persist(StorageLevel.MEMORY_AND_DISK)
        if kept is not None:
            kept.append(m)
        is_secret = F.col("rule_id").isin(*_SECRET_IDS)
        sec = S.findings_from_matches(m.filter(is_secret).withColumn("low_trust", F.col("secret_low_trust")), with_order=True)
        cfg = m.filter(~is_secret).withColumn(
            "rule_ord", F.when(F.col("rule_ord") >= CONFIG_ORD_OFFSET, F.col("rule_ord") - CONFIG_ORD_OFFSET)
            .otherwise(F.col("rule_ord")))
        parts = [sec, C.findings_from_matches(cfg, with_order=True)]
    elif want_s:
        parts = [S.secret_findings(files, with_order=True)]
    else:
        parts = [C.config_findings(files, with_order=True)]
    return A.dedupe(A.union_findings(*parts)).select(*FINDING_COLUMNS)


def scan(files: DataFrame, *, enabled: list[str] | None = None, changed: DataFrame | None = None,
         advisories: DataFrame | None = None, registry: DataFrame | None = None,
         commit_lines: DataFrame | None = None, repos: DataFrame | None = None,
         http_obs: DataFrame | None = None, plain_obs: DataFrame | None = None,
         probe_obs: DataFrame | None = None, tls_obs: DataFrame | None = None, now: str | None = None,
         baseline: DataFrame | None = None, policy: DataFrame | None = None,
         fail_on: str = "high", file_findings_df: DataFrame | None = None) -> ScanResult:
    enabled = select_scanners(enabled)
    scoped = diff_scope(files, changed) if changed is not None else files
    parts: list[DataFrame] = []
    ff = file_findings_df if file_findings_df is not None else file_findings(scoped, enabled)
    if ff is not None:
        parts.append(ff)
    packages = None
    if "deps" in enabled or "licenses" in enabled:
        packages = M.lockfile_packages(files)
    if "deps" in enabled:
        if advisories is not None:
            parts.append(V.vuln_findings(packages, advisories))
        parts += [M.unlocked_manifests(files), M.floating_dependencies(files), M.install_hooks(files),
                  SU.typosquats(packages, M.declared_names(files))]
    if "licenses" in enabled and registry is not None:
        parts.append(L.license_findings(packages, registry))
    if "git" in enabled:
        parts += [HY.tracked_secret_files(files), HY.gitignore_findings(files)]
        if repos is not None:
            parts.append(HY.remote_credentials(repos))
        if commit_lines is not None:
            parts.append(HI.history_findings(commit_lines))
    readiness = None
    if "readiness" in enabled and changed is None:
        parts.append(G.readiness_findings(files))
        readiness = G.readiness_scores(files)
    if "surface" in enabled:
        if http_obs is not None:
            parts.append(H.header_findings(http_obs))
        if plain_obs is not None:
            parts.append(H.redirect_findings(plain_obs))
        if probe_obs is not None:
            parts.append(H.probe_findings(probe_obs))
        if tls_obs is not None and now is not None:
            parts.append(H.tls_findings(tls_obs, now))
    findings = reduce(lambda a, b: a.unionByName(b), [p.select(*FINDING_COLUMNS) for p in parts])
    if baseline is not None:
        findings = A.baseline_suppress(findings, baseline).select(*FINDING_COLUMNS)
    if policy is not None:
        findings = A.apply_policy(findings, policy)
    repo_list = files.select("repo_id").distinct()
    stats = A.scan_stats(scoped, packages=packages)
    return ScanResult(findings=findings, scores=A.risk_scores(findings, repo_list),
                      counts=A.severity_counts(findings, repo_list),
                      gate=A.gate(findings, fail_on=fail_on, policy=policy, repos=repo_list),
                      readiness=readiness, stats=stats)


# --------------------------------------------------------------------------
# incremental rescan
# --------------------------------------------------------------------------
STATE_FINDING = "array<struct<id:string,title:string,severity:string,scanner:string,path:string,line:int," \
                "evidence:string,remediation:string,reference:string>>"


def ruleset_key(enabled: list[str]) -> str:
    return f"{R.RULESET_VERSION}:{','.join(sorted(enabled))}"


def incremental_file_findings(files: DataFrame, state: DataFrame, enabled: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files whose (size, mtime) and ruleset match the stored state reuse
    their stored findings; the rest are scanned.  Returns (findings, new
    state, cache hits).  ``state`` = (repo_id, path, size, mtime, ruleset,
    findings array<struct>); one row per scanned file, findings possibly empty."""
    key = ruleset_key(enabled)
    st = state.filter(F.col("ruleset") == key).select("repo_id", "path", "size", "mtime",
                                                      F.col("findings").alias("_f"))
    hits = files.select("repo_id", "path", "size", "mtime").join(st, ["repo_id", "path", "size", "mtime"])
    # decided on the listing alone: contents are read for the changed files only, whose keys are the small side
    changed = files.select("repo_id", "path").join(hits.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    misses = diff_scope(files, changed)
    fresh = file_findings(misses, enabled)
    reused = hits.select("repo_id", F.explode("_f").alias("f")).select("repo_id", "f.*")
    findings = reused.select(*FINDING_COLUMNS).unionByName(fresh.select(*FINDING_COLUMNS))
    per_file = fresh.groupBy("repo_id", "path").agg(F.collect_list(F.struct(
        *[c for c in FINDING_COLUMNS if c != "repo_id"])).alias("findings"))
    new_rows = misses.select("repo_id", "path", "size", "mtime").join(per_file, ["repo_id", "path"], "left") \
        .select("repo_id", "path", "size", "mtime", F.lit(key).alias("ruleset"),
                F.coalesce("findings", F.array().cast(STATE_FINDING)).alias("findings"))
    new_state = hits.select("repo_id", "path", "size", "mtime", F.lit(key).alias("ruleset"),
                            F.col("_f").alias("findings")).unionByName(new_rows)
    return findings, new_state, hits.select("repo_id", "path")


def initial_state(files: DataFrame, enabled: list[str]) -> DataFrame:
    """State after a full scan (every file, with or without findings),
    written to the session's checkpoint directory — the state is a stored
    table that the next run reads, not a plan to recompute."""
    from codeaudit.session import checkpoint_dir
    checkpoint_dir(files.sparkSession)
    empty = files.limit(0).select("repo_id", "path", "size", "mtime", F.lit("").alias("ruleset"),
                                  F.array().cast(STATE_FINDING).alias("findings"))
    _f, st, _h = incremental_file_findings(files, empty, enabled)
    return st.checkpoint(eager=True)
