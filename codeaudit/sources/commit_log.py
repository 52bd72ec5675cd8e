"""Text of ``git log -p`` as one row a file's diff in a commit.

A commit begins at a line start with ``commit ``; that text is the record
separator of Spark's text reader, so files are split into byte ranges that
resynchronise at commits by themselves: headers and lines stay together, and
no line is shuffled, sorted or cached to find its commit.  A commit is one
row while it is read.

``commit_ord`` and ``first_seq`` are texts that sort in the order of the log:
by file name, place of the split, commit and target header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a commit's record; the first of a file still begins with "commit ".
SEPARATOR = "\ncommit "
_ADDS = r"""transform(slice(s, 2, size(s)), x -> named_struct('p', trim(substring_index(x, '\n', 1)), 'l', transform(
    filter(split(x, '\n', -1), (l, k) -> k > 0 and startswith(l, '+') and not startswith(l, '+++')), l -> substring(l, 2))))"""
_PATH = "if(x.p = '/dev/null', '', if(startswith(x.p, 'b/'), substring(x.p, 3), x.p))"
# a commit that names a path twice has one text of both
_JOINED = """if(size(array_distinct(a.p)) = size(a), a, transform(array_distinct(a.p), q -> named_struct(
    'p', q, 'l', flatten(transform(filter(a, x -> x.p = q), x -> x.l)))))"""


def read_commit_log(spark: SparkSession, path: str, repo_id: str | None = None) -> DataFrame:
    """(repo_id, commit_ord, first_seq, sha, path, added) of the logs in a
    folder with subfolders ``repo_id=...``, or of one repository's files."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path).select(
        "*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"))
    repo = F.lit(repo_id) if repo_id is not None else F.col("repo_id").cast("string")
    # a record without a hash is what stands before the first commit
    text = F.regexp_replace(F.regexp_replace("value", "^commit ", ""), r"\r(\n|\z)", "$1")
    head = F.trim(F.substring_index(text, "\n", 1))
    order = F.concat("file", *[x for c in ("block", "at") for x in (F.lit(":"), F.lpad(F.col(c).cast("string"), 20, "0"))])
    d = raw.select(repo.alias("repo_id"), order.alias("commit_ord"),
                   F.when(head.rlike(r"^[0-9a-fA-F]{4,}(?:\s|$)"), F.substring(head, 1, 8)).otherwise("").alias("sha"),
                   F.split(F.concat(F.lit("\n"), text), r"\n[+]{3} ", -1).alias("s"))
    d = d.select("repo_id", "commit_ord", "sha", F.expr(f"filter({_ADDS}, x -> size(x.l) > 0)").alias("a"))
    d = d.withColumn("a", F.expr(f"filter(transform(a, x -> named_struct('p', {_PATH}, 'l', x.l)), x -> x.p <> '')"))
    return d.select("repo_id", "commit_ord", "sha", F.posexplode(F.expr(_JOINED)).alias("i", "x")).select(
        "repo_id", "commit_ord", F.concat("commit_ord", F.lit(":"), F.lpad(F.col("i").cast("string"), 10, "0")).alias("first_seq"),
        "sha", F.col("x.p").alias("path"), F.array_join("x.l", "\n").alias("added"))


def write_commit_log(commits: DataFrame, folder: str) -> None:
    """Commits (repo_id, seq, text of a whole commit) as logs, in the order of
    ``seq`` over the files of each repository's subfolder."""
    n = int(commits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    commits.repartitionByRange(n, "repo_id", "seq").sortWithinPartitions("repo_id", "seq").select("repo_id", "text").write.partitionBy(
        "repo_id").text(folder)
