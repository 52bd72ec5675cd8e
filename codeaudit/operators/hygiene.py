"""Repository hygiene (R9–R11): tracked secret files, .gitignore gaps, and
credentials in the remote URL.  File-name work only; contents are read for
the single ``.gitignore`` row per repo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.model import redact

SCANNER = "git"


def tracked_secret_files(files: DataFrame) -> DataFrame:
    """Every (tracked file, dangerous pattern) pair: exact name, or a suffix
    for ``*`` patterns; names with example/sample/template are exempt."""
    base = F.element_at(F.split("path", "/"), -1)
    f = files.filter(F.col("tracked")).select("repo_id", "path", base.alias("base"))
    exempt = reduce(lambda a, b: a | b, [F.col("base").contains(w) for w in R.EXEMPT_NAME_WORDS])
    pats = F.array(*[F.struct(F.lit(p).alias("pat"), F.lit(s).alias("sev"), F.lit(w).alias("why"))
                     for p, s, w in R.DANGEROUS_FILES])
    hit = lambda d: F.when(d["pat"].contains("*"),
                           F.col("base").endswith(F.regexp_replace(d["pat"], r"^\*+", ""))).otherwise(F.col("base") == d["pat"])
    x = f.filter(~exempt).select("repo_id", "path", "base", F.explode(F.filter(pats, hit)).alias("d"))
    return x.select("repo_id", F.lit("git/tracked-secret-file").alias("id"),
                    F.concat(F.col("d.why"), F.lit(" (tracked by git)")).alias("title"),
                    F.col("d.sev").alias("severity"), F.lit(SCANNER).alias("scanner"), "path",
                    F.lit(0).alias("line"), F.col("base").alias("evidence"),
                    F.lit("Untrack it, ignore it, purge it from history and rotate the credentials.").alias("remediation"),
                    F.lit("").alias("reference"))


def gitignore_findings(files: DataFrame) -> DataFrame:
    """R10 per git repo: no .gitignore → medium; otherwise a low finding for each
    needed pattern the file does not mention (.env always; *.pem when key
    material exists; node_modules when a JS manifest is tracked)."""
    base = F.element_at(F.split("path", "/"), -1)
    in_skipped = F.exists(F.split("path", "/"), lambda s: s.isin(*R.KEY_SCAN_SKIP_DIRS))
    key_ext = reduce(lambda a, b: a | b, [F.col("path").endswith(e) for e in R.KEY_EXT])
    g = files.filter(F.col("tracked").isNotNull()).groupBy("repo_id").agg(
        F.max(F.when(F.col("path") == ".gitignore", F.coalesce(F.col("content"), F.lit("")))).alias("ig"),
        F.bool_or(F.col("tracked") & base.isin(*R.JS_MARKERS)).alias("has_js"),
        F.bool_or(key_ext & (F.col("tracked") | ~in_skipped)).alias("has_keys"))
    none = g.filter(F.coalesce(F.col("ig"), F.lit("")) == "").select(
        "repo_id", F.lit("git/no-gitignore").alias("id"), F.lit("No .gitignore in the repository").alias("title"),
        F.lit("medium").alias("severity"), F.lit(SCANNER).alias("scanner"), F.lit(".gitignore").alias("path"),
        F.lit(0).alias("line"), F.lit("").alias("evidence"),
        F.lit("Add a .gitignore covering env files, credentials, keys, build output and local state.").alias("remediation"),
        F.lit("").alias("reference"))
    needles = F.array(F.lit(".env"), F.when(F.col("has_keys"), F.lit("*.pem")), F.when(F.col("has_js"), F.lit("node_modules")))
    gaps = g.filter(F.coalesce(F.col("ig"), F.lit("")) != "").select(
        "repo_id", "ig", F.explode(F.filter(needles, lambda n: n.isNotNull() & ~F.col("ig").contains(n))).alias("needle"))
    gaps = gaps.select(
        "repo_id", F.lit("git/gitignore-gap").alias("id"),
        F.concat(F.lit(".gitignore does not cover `"), F.col("needle"), F.lit("`")).alias("title"),
        F.lit("low").alias("severity"), F.lit(SCANNER).alias("scanner"), F.lit(".gitignore").alias("path"),
        F.lit(0).alias("line"), F.col("needle").alias("evidence"),
        F.concat(F.lit("Add `"), F.col("needle"), F.lit("` to .gitignore.")).alias("remediation"), F.lit("").alias("reference"))
    return none.unionByName(gaps)


def remote_credentials(repos: DataFrame) -> DataFrame:
    """An https origin URL whose authority carries credentials."""
    r = repos.filter(F.col("origin_url").rlike(r"^https://[^/]*@"))
    return r.select("repo_id", F.lit("git/remote-credentials").alias("id"),
                    F.lit("Git remote URL embeds credentials").alias("title"), F.lit("high").alias("severity"),
                    F.lit(SCANNER).alias("scanner"), F.lit(".git/config").alias("path"), F.lit(0).alias("line"),
                    redact(F.col("origin_url"), 12).alias("evidence"),
                    F.lit("Use SSH or a credential helper; the token sits in plaintext in .git/config.").alias("remediation"),
                    F.lit("").alias("reference"))
