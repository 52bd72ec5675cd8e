"""The findings algebra (A1–A13, F11): union, dedupe, baseline, policy, sort,
counts, risk, grade, gate, top-k per rule, first-seen rules, scan stats.

Everything is keyed by ``repo_id``: aggregations are two-level (repo×severity →
repo), which is a map-side partial aggregate followed by a small shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.functions.text import glob_bodies
from codeaudit.model import (SEVERITIES, FINDING_COLUMNS, fingerprint, sev_ord, sev_weight)

ORDER_COLS = ["ord_scanner", "ord_rule", "ord_pos"]
DEDUPE_SCANNERS = ["secrets", "config"]


def union_findings(*dfs: DataFrame) -> DataFrame:
    """A1: union of detector outputs (by name; missing order columns become 0)."""
    norm = []
    for d in dfs:
        for c in ORDER_COLS:
            if c not in d.columns:
                d = d.withColumn(c, F.lit(0).cast("long"))
        norm.append(d.select(*FINDING_COLUMNS, *[F.col(c).cast("long").alias(c) for c in ORDER_COLS]))
    return reduce(lambda a, b: a.unionByName(b), norm)


def dedupe(findings: DataFrame, scanners: list[str] = DEDUPE_SCANNERS) -> DataFrame:
    """A2: one finding per (repo, path, line, evidence[:60]) among the file
    scanners, the most severe first, earliest on ties; other scanners pass.

    Written as ``groupBy().agg(min_by(row, order))`` rather than a ranking
    window: the hash aggregate combines map-side, so a key holding a large
    share of the rows does not land whole in one task."""
    order = [c for c in ORDER_COLS if c in findings.columns]
    cols = findings.columns
    scoped = F.col("scanner").isin(*scanners)
    keys = ["repo_id", "path", "line", F.substring("evidence", 1, 60).alias("_ev60")]
    best = (findings.filter(scoped).groupBy(*keys)
            .agg(F.min_by(F.struct(*cols), F.struct(sev_ord("severity").alias("_s"), *order)).alias("_b"))
            .select("_b.*"))
    return best.unionByName(findings.filter(~scoped | F.col("scanner").isNull()))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint())


def baseline_suppress(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """A3: drop findings whose (repo, fingerprint) is in the accepted baseline."""
    f = findings if "fingerprint" in findings.columns else with_fingerprint(findings)
    return f.join(baseline.select("repo_id", "fingerprint").distinct(), ["repo_id", "fingerprint"], "left_anti")


def apply_policy(findings: DataFrame, policy: DataFrame) -> DataFrame:
    """A4: per-repo policy rows (repo_id, fail_on, severity map<string,string>,
    ignore array<string>, ignore_paths array<string>): drop ignored ids, drop
    findings whose path matches an ignored glob, override severities."""
    p = policy.select("repo_id", F.col("severity").alias("_sev_map"), F.col("ignore").alias("_ignore"))
    # one regex per repository from its globs; each glob is converted once
    globs = policy.select("repo_id", F.explode("ignore_paths").alias("_g")).filter("_g is not null")
    bodies = globs.select("_g").distinct().withColumn("_b", glob_bodies("_g"))
    paths = globs.join(bodies, "_g").groupBy("repo_id").agg(F.concat(
        F.lit("(?s)^(?:"), F.array_join(F.collect_set("_b"), "|"), F.lit(")\\z")).alias("_rx"))
    j = findings.join(p, "repo_id", "left").join(paths, "repo_id", "left")
    ignored_id = F.coalesce(F.array_contains("_ignore", F.col("id")), F.lit(False))
    ignored_path = F.coalesce(
        (F.coalesce(F.col("path"), F.lit("")) != "") &
        F.regexp_like(F.col("path"), F.col("_rx")), F.lit(False))
    override = F.element_at(F.col("_sev_map"), F.col("id"))
    out = j.filter(~ignored_id & ~ignored_path) \
        .withColumn("severity", F.coalesce(F.when(F.coalesce(override, F.lit("")) != "", override), F.col("severity")))
    return out.drop("_sev_map", "_ignore", "_rx")


def report_order() -> list[Column]:
    """A5: severity, scanner, path, line; then what tells findings apart."""
    return [sev_ord("severity").alias("sev"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("scanner", "path")],
            F.coalesce("line", F.lit(0)).alias("line"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("id", "evidence")]]


def severity_counts(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Zero-filled counts per severity, one row per repo."""
    aggs = [F.count_if(F.col("severity") == s).cast("long").alias(s) for s in SEVERITIES]
    c = findings.groupBy("repo_id").agg(*aggs)
    if repos is not None:
        c = repos.select("repo_id").distinct().join(c, "repo_id", "left").fillna(0, SEVERITIES)
    return c


def risk_scores(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A7 + A8: risk = min(100, round_half_even(Σ w·(1+ln n))) over non-readiness
    findings; grade = worse of the letter for 100−risk and the severity cap."""
    f = findings.filter(F.coalesce(F.col("scanner"), F.lit("")) != "readiness")
    return scores_from_counts(f.groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("n")), repos)


def scores_from_counts(per_sev: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A7 + A8 from the number of findings (repo_id, severity, n)."""
    per_repo = per_sev.groupBy("repo_id").agg(
        F.sum(sev_weight("severity") * (F.lit(1.0) + F.log(F.col("n").cast("double")))).alias("raw"),
        F.min(sev_ord("severity")).alias("worst"))
    if repos is not None:
        per_repo = repos.select("repo_id").distinct().join(per_repo, "repo_id", "left")
    risk = F.least(F.lit(100), F.bround(F.coalesce(F.col("raw"), F.lit(0.0)), 0).cast("long")).cast("long")
    s = F.lit(100) - F.col("risk_score")
    letter = (F.when(s >= 85, "A").when(s >= 70, "B").when(s >= 50, "C").when(s >= 30, "D").otherwise("F"))
    cap = (F.when(F.col("worst") == 0, "F").when(F.col("worst") == 1, "C")
           .when(F.col("worst") == 2, "B").otherwise("A"))
    return (per_repo.withColumn("risk_score", risk)
            .withColumn("grade", F.greatest(letter, cap))
            .select("repo_id", "risk_score", "grade"))


def gate(findings: DataFrame, fail_on: str | None = None, policy: DataFrame | None = None,
         repos: DataFrame | None = None) -> DataFrame:
    """a repo fails when any finding is at or above its threshold; the
    threshold is the policy's ``fail_on`` when set, else ``fail_on``; 'never'
    passes."""
    f = findings
    if policy is not None:
        f = f.join(policy.select("repo_id", F.col("fail_on").alias("_pf")), "repo_id", "left")
        thr = F.coalesce(F.col("_pf"), F.lit(fail_on))
    else:
        thr = F.lit(fail_on)
    f = f.withColumn("_thr", thr)
    at_or_above = (F.col("_thr") != "never") & (sev_ord("severity") <= sev_ord(F.col("_thr")))
    g = f.groupBy("repo_id").agg(
        F.coalesce(F.bool_or(at_or_above), F.lit(False)).alias("failed"),
        F.count_if(at_or_above).cast("long").alias("blocking"))
    if repos is not None:
        g = repos.select("repo_id").distinct().join(g, "repo_id", "left") \
            .fillna({"failed": False, "blocking": 0})
    return g


def top_k(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """Top ``k`` rows per group by ``order``, with ``rank`` (1-based).  Spark
    keeps only the best ``k`` of a group in each task before the exchange."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_per_rule(findings: DataFrame, k: int = 5) -> DataFrame:
    """Findings grouped by rule within a repo; the bucket severity is the
    first finding's (in report order); the count; the first ``k`` shown."""
    order = [sev_ord("severity"), "scanner", "path", "line", "evidence"]
    counts = findings.groupBy("repo_id", "id").agg(F.count(F.lit(1)).cast("long").alias("rule_count"))
    top = top_k(findings, ["repo_id", "id"], order, k)
    head = top.filter(F.col("rank") == 1).select("repo_id", "id", F.col("severity").alias("bucket_severity"))
    return top.join(head, ["repo_id", "id"]).join(counts, ["repo_id", "id"]) \
        .select("repo_id", "id", "bucket_severity", "rule_count", F.col("rank").cast("int").alias("rank"),
                "severity", "path", "line", "evidence")


def first_seen_rules(findings: DataFrame) -> DataFrame:
    """A10: one row per rule id (per repo), the first in report order."""
    cols = findings.columns
    return (findings.groupBy("repo_id", "id")
            .agg(F.min_by(F.struct(*cols), F.struct(sev_ord("severity").alias("_s"), "scanner", "path", "line",
                                                    "evidence")).alias("_b"))
            .select("_b.*"))


def scan_stats(files: DataFrame, scanned: DataFrame | None = None, cache_hits: DataFrame | None = None,
               packages: DataFrame | None = None) -> DataFrame:
    """Files scanned, cache hits and distinct packages per repo."""
    s = files.groupBy("repo_id").agg(F.count(F.lit(1)).cast("long").alias("files_scanned"))
    if cache_hits is not None:
        h = cache_hits.groupBy("repo_id").agg(F.count(F.lit(1)).cast("long").alias("cache_hits"))
        s = s.join(h, "repo_id", "left")
    else:
        s = s.withColumn("cache_hits", F.lit(0).cast("long"))
    if packages is not None:
        p = packages.groupBy("repo_id").agg(
            F.count_distinct("name", "version", "eco").cast("long").alias("packages"))
        s = s.join(p, "repo_id", "left")
    else:
        s = s.withColumn("packages", F.lit(0).cast("long"))
    return s.fillna(0, ["cache_hits", "packages"])
