"""Git history as a table (S18) and the history secret scan.

Logs as text files are read by ``sources.commit_log``, commit by commit.  Where
they come as a table of lines, ``commit_lines(repo_id, seq, line)`` in order:
Commit and file headers are forward-filled onto the ``+`` lines
(``functions.windows.forward_fill``: running fills per range-partition block
plus a carry across blocks, so one huge repository is not one task); added lines are then grouped per (repo,
commit, path) into one text each — a group is one file's diff in one commit.
The provider rules run over those texts (the generic rule is skipped), the
placeholder gate applies (private keys exempt), one finding per
``rule:value[:24]`` is kept (the first in history order), low-trust paths are
downgraded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.functions.regex import rule_matches
from codeaudit.functions.text import is_placeholder
from codeaudit.model import _map_lit, redact
from codeaudit.operators.findings import top_k
from codeaudit.operators.secrets import SCAN_RULES, alternation

SCANNER = "git"
HISTORY_DOWNGRADE = {"critical": "medium", "high": "low", "medium": "low"}
REFERENCE = "https://cwe.mitre.org/data/definitions/540.html"


def commit_adds(commit_lines: DataFrame) -> DataFrame:
    """(repo_id, commit_ord, sha, path, added) from raw diff lines."""
    from codeaudit.functions.windows import forward_fill
    line = F.col("line")
    is_commit = line.startswith("commit ")
    is_target = line.startswith("+++ ")
    target = F.trim(F.substring(line, 5, 1 << 30))
    tpath = F.when(target == "/dev/null", F.lit("")).when(target.startswith("b/"), F.substring(target, 3, 1 << 30)) \
        .otherwise(target)
    # a commit line resets the path: mark both on the same running "event" order
    d = commit_lines.select(
        "repo_id", "seq", "line",
        F.when(is_commit, F.substring(F.trim(F.substring(line, 8, 1 << 30)), 1, 8)).alias("_sha"),
        F.when(is_commit, F.col("seq")).alias("_cseq"),
        F.when(is_target, F.struct(F.col("seq").alias("s"), tpath.alias("p")))
         .when(is_commit, F.struct(F.col("seq").alias("s"), F.lit("").alias("p"))).alias("_pev"))
    # headers forward-filled onto the lines that follow them (balanced for large repos)
    d = forward_fill(d, ["repo_id"], ["seq"], ["_sha", "_cseq", "_pev"]) \
        .withColumn("sha", F.col("_sha")).withColumn("commit_ord", F.col("_cseq")).withColumn("path", F.col("_pev")["p"])
    adds = d.filter(line.startswith("+") & ~line.startswith("+++") & (F.coalesce(F.col("path"), F.lit("")) != ""))
    g = adds.groupBy("repo_id", "commit_ord", "sha", "path").agg(
        F.min("seq").alias("first_seq"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.substring("line", 2, 1 << 30).alias("t")))),
                                 lambda x: x["t"]), "\n").alias("added"))
    return g.select("repo_id", "commit_ord", "first_seq", F.coalesce("sha", F.lit("")).alias("sha"), "path", "added")


def history_findings(commit_lines: DataFrame, limit: int | None = None) -> DataFrame:
    """R8 over a table of log lines."""
    return findings_from_adds(commit_adds(commit_lines), limit)


def findings_from_adds(adds: DataFrame, limit: int | None = None) -> DataFrame:
    """R8 over added texts, as ``commit_adds`` or ``read_commit_log`` give
    them.  ``limit`` keeps only the first so many findings of a repository;
    by default there is no cap.  As in the reference (and the query's SQL),
    values of a rule that share their first 24 characters are one finding of
    the repository: of several Slack webhooks, private keys or database URLs
    with equal heads only the first is reported."""
    rules = [r for r in SCAN_RULES if r.id != R.GENERIC_RULE_ID]
    # two commits may share a short sha (or have none): their order tells them apart
    keys = ["repo_id", "commit_ord", "sha", "path"]
    m = alternation(rule_matches(adds, keys, "added", rules, carry=["first_seq"]), keys, F.lit(False))
    m = m.filter((F.col("rule_id") == "private-key") | ~is_placeholder("value"))
    # first occurrence of rule:value[:24] in history order
    first = (m.groupBy("repo_id", "rule_id", F.substring("value", 1, 24).alias("_v24"))
             .agg(F.min_by(F.struct("sha", "path", "value", "first_seq", "start", "rule_ord"),
                           F.struct("first_seq", "start", "rule_ord")).alias("b"))
             .select("repo_id", "rule_id", "b.*"))
    ext = F.element_at(F.split("path", r"\."), -1)
    low = F.col("path").rlike(R.java_pattern(R.TEST_PATH_PATTERN)) | ext.isin(*R.HISTORY_DOC_EXT)
    sev = _map_lit({r.id: r.severity for r in R.SECRET_RULES})[F.col("rule_id")]
    title = _map_lit({r.id: r.title for r in R.SECRET_RULES})[F.col("rule_id")]
    out = first.select(
        "repo_id", F.concat(F.lit("git-history/"), "rule_id").alias("id"),
        F.concat(title, F.lit(" found in git history"), F.when(low, F.lit(" (test/docs path)")).otherwise(F.lit("")))
         .alias("title"),
        F.when(low, F.coalesce(_map_lit(HISTORY_DOWNGRADE)[sev], F.lit("info"))).otherwise(sev).alias("severity"),
        F.lit(SCANNER).alias("scanner"),
        F.when(F.col("sha") != "", F.concat(F.col("path"), F.lit(" @ "), F.col("sha"))).otherwise(F.col("path")).alias("path"),
        F.lit(0).alias("line"), redact(F.col("value"), 4).alias("evidence"),
        F.lit("Deleting the file does not remove it from history: rotate the credential, then purge history.")
         .alias("remediation"),
        F.lit(REFERENCE).alias("reference"),
        "first_seq", "start", "rule_ord")
    if limit is not None:
        out = top_k(out, ["repo_id"], ["first_seq", "start", "rule_ord"], limit).drop("rank")
    return out.drop("first_seq", "start", "rule_ord")
