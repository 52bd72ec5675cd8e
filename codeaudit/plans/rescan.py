"""Rescans with a state that is kept in place.

The state is a table of one row a scanned file (repo_id, path, size, mtime,
ruleset, findings), in ``buckets`` partitions by a hash of repository and path.
A rescan

1. compares two sums a bucket, of the listing and of the state; buckets whose
   sums agree are unchanged and are not read further;
2. joins listing and state of the other buckets, without contents or findings;
3. scans the files that are new or changed: contents are filtered by a hash of
   their key against the changed keys' hashes, at most 2**20 of them, which is
   the only broadcast; a file that only shares a hash is scanned in vain and
   dropped exactly afterwards, so contents are in no exchange;
4. replaces the partitions of those buckets (dynamic partition overwrite).

Where the files table has a column ``bucket`` of the same number of buckets,
as ``write_files_by_bucket`` stores it, step 3 reads those partitions alone.
A run that dies leaves each bucket old, new or missing; sums of a missing one
differ, so the next run mends it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.model import FINDING_COLUMNS
from codeaudit.plans.scan import SLOTS, STATE_FINDING, file_findings, key_slot, ruleset_key
from codeaudit.session import checkpoint_dir
from codeaudit.streaming.stream import is_dir

KEYS = ["repo_id", "path"]
STATE = f"bucket int, repo_id string, path string, size long, mtime timestamp, ruleset string, findings {STATE_FINDING}"


@dataclass
class Rescan:
    """``findings`` of all files, read from the state, so valid until the next
    rescan with it; the keys ``scanned`` and ``gone`` in this run; the buckets
    that were replaced."""
    findings: DataFrame
    scanned: DataFrame
    gone: DataFrame
    buckets: list[int]


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def write_files_by_bucket(files: DataFrame, path: str, buckets: int = 64) -> None:
    """A ``files`` table whose partitions are those of the state."""
    files.withColumn("bucket", bucket_of(buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_state(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    """The state's rows; a bucket without files holds a row of nulls."""
    folder = f"{path.rstrip('/')}/of={buckets}"
    if not is_dir(spark, folder):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(folder).filter("path is not null")


def stored_findings(spark: SparkSession, path: str, buckets: int = 64) -> DataFrame:
    return read_state(spark, path, buckets).select("repo_id", F.explode("findings").alias("f")).select("repo_id", "f.*").select(
        *FINDING_COLUMNS)


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(F.struct(
        F.count("*"), F.sum(F.xxhash64(*KEYS, "size", "mtime", "ruleset").cast("decimal(38,0)"))).alias("s"))


def rescan(files: DataFrame, path: str, enabled: list[str], *, buckets: int = 64) -> Rescan:
    """Findings of ``files`` (repo_id, path, size, mtime, content, ...; one row a
    key) by the file detectors, with the state at ``path``, which is brought up
    to date.  Scans with another ruleset or other detectors start anew."""
    spark = files.sparkSession
    key = ruleset_key(enabled)
    if "bucket" not in files.columns:
        files = files.withColumn("bucket", bucket_of(buckets))
    listing = files.select(F.col("bucket").cast("int").alias("bucket"), *KEYS, "size", "mtime", F.lit(key).alias("ruleset"))
    state = read_state(spark, path, buckets)
    now, then = _sums(listing), _sums(state).withColumnRenamed("s", "s0")
    touched = sorted(r["bucket"] for r in now.join(then, "bucket", "full").filter("not s <=> s0").select("bucket").collect())  # one a bucket, at most
    empty = listing.limit(0).select(*KEYS)
    if not touched:
        return Rescan(stored_findings(spark, path, buckets), empty, empty, [])

    def written(df: DataFrame, name: str) -> DataFrame:
        folder = f"{checkpoint_dir(spark).rstrip('/')}/rescan-{name}-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    some = F.col("bucket").isin(touched)
    both = written(listing.filter(some).withColumn("here", F.lit(True)).join(
        state.filter(some).select(*KEYS, F.col("size").alias("size0"), F.col("mtime").alias("mtime0"), F.col("ruleset").alias("ruleset0")),
        KEYS, "full").select(
        *KEYS, "bucket", "size", "mtime", "here",
        (F.col("here") & F.col("ruleset0").isNotNull() & F.expr("size <=> size0 and mtime <=> mtime0 and ruleset <=> ruleset0")).alias("same")),
        "compared")
    changed = both.filter("here and not same")
    slot = key_slot(SLOTS)
    slots = changed.select(slot.alias("slot")).distinct()  # at most 2**20 integers
    at = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # one a bucket, at most
    scan_of = files.filter(F.col("bucket").isin(at)).withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot", "bucket")
    kept: list[DataFrame] = []
    per_file = file_findings(scan_of, enabled, kept).groupBy(*KEYS).agg(F.collect_list(F.struct(
        *[c for c in FINDING_COLUMNS if c != "repo_id"])).alias("findings"))
    none = F.expr(f"cast(array() as {STATE_FINDING})")
    rows = lambda d: d.select("bucket", *KEYS, "size", "mtime", F.lit(key).alias("ruleset"), "findings")
    fresh = rows(changed.join(per_file, KEYS, "left").withColumn("findings", F.coalesce("findings", none)))
    old = rows(both.filter("here and same").join(state.filter(some).select(*KEYS, "findings"), KEYS))
    marks = spark.createDataFrame([(b,) for b in touched], "bucket int").select(
        "bucket", *[F.lit(None).cast(t).alias(c) for c, t in (("repo_id", "string"), ("path", "string"), ("size", "long"), ("mtime", "timestamp"),
                                                              ("ruleset", "string"))], none.alias("findings"))
    new = written(fresh.unionByName(old).unionByName(marks), "state")
    for k in kept:
        k.unpersist()
    new.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(f"{path.rstrip('/')}/of={buckets}")
    return Rescan(stored_findings(spark, path, buckets), changed.select(*KEYS), both.filter("here is null").select(*KEYS), touched)
