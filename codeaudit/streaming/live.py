"""Live risk and gate of repositories from a stream of file versions (T1 over
A6–A8 and F11).

``stream_file_changes`` scans each micro-batch of files and writes, per file
version, how many findings of each severity it has.  ``stream_live_scores``
keeps the newest version of every file as state, keyed by the file, so a
repository of any size is spread over the tasks; a newer version retracts what
the older one counted, a deleted file retracts all, an older or repeated one
changes nothing.  The changes of a micro-batch are summed per repository and
added to its totals, which are written with risk, grade and gate for every
epoch; a replayed epoch starts from the epoch before and writes the same rows
again.  Whatever the order and repetition of the input, the last epoch equals
the batch scores of the newest files.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from codeaudit.model import SEVERITIES
from codeaudit.operators import findings as A
from codeaudit.streaming.stream import _fs_path, _scratch, _source, is_dir, run_to_completion

#: ``scored``: findings that count for the risk, ``gated``: all; per severity.
CHANGES = "repo_id string, path string, version long, deleted boolean, scored array<long>, gated array<long>"
_DELTA = "repo_id string, scored array<long>, gated array<long>"
_TOTALS = "repo_id string, scored array<long>, gated array<long>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_changes(files: DataFrame, findings: DataFrame) -> DataFrame:
    """``CHANGES`` of file versions (repo_id, path, version, deleted), one a
    file, from their findings."""
    scored = F.coalesce(F.col("scanner"), F.lit("")) != "readiness"
    counts = lambda also: F.array(*[F.count_if((F.col("severity") == s) & also) for s in SEVERITIES])
    n = findings.groupBy("repo_id", "path").agg(counts(scored).alias("scored"), counts(F.lit(True)).alias("gated"))
    zero = F.array(*[F.lit(0).cast("long")] * len(SEVERITIES))
    gone = F.coalesce("deleted", F.lit(False))
    return files.select("repo_id", "path", "version", gone.alias("deleted")).join(n, ["repo_id", "path"], "left").select(
        "repo_id", "path", "version", "deleted", *[F.when(F.col("deleted") | F.col(c).isNull(), zero).otherwise(F.col(c)).alias(c)
                                                   for c in ("scored", "gated")])


def newest(files: DataFrame) -> DataFrame:
    """The newest of several versions of a file."""
    last = files.groupBy("repo_id", "path").agg(F.max("version").alias("version"))
    return files.join(last, ["repo_id", "path", "version"], "left_semi").dropDuplicates(["repo_id", "path"])


def stream_file_changes(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType,
                        to_files: Callable[[DataFrame], DataFrame], enabled: list[str] | None = None,
                        files_per_batch: int | None = None, out: str | None = None) -> str:
    """Scan every arriving batch of file versions (``files`` with version and
    deleted); gives the folder of their ``CHANGES``."""
    from codeaudit.plans.scan import file_findings
    base = _scratch(spark, "file-changes")
    out = out or os.path.join(base, "out")

    def batch(df: DataFrame, epoch: int) -> None:
        kept: list[DataFrame] = []
        files = newest(to_files(df))
        found = file_findings(files.filter("not coalesce(deleted, false)"), enabled or ["secrets", "config"], kept)
        file_changes(files, found).write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))
        for k in kept:
            k.unpersist()

    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    run_to_completion(_source(spark, source_dir, glob, schema, **limit).writeStream.foreachBatch(batch).option(
        "checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    return out


class NewestFile(StatefulProcessor):
    """State of a file: its newest version and what that counts.  Gives what
    the repository's counts change by."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "version long, scored array<long>, gated array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()  # null for a new file; each call is a round trip to the JVM
        now = None if held is None else (held[0], list(held[1]), list(held[2]))
        first = now
        for r in rows:
            zero = [0] * len(r.scored)
            new = (r.version, zero, zero) if r.deleted else (r.version, list(r.scored), list(r.gated))
            if now is None or new > now:  # of two rows of one version the larger counts stay: any order gives the same
                now = new
        if now is not None and now != first:
            self.state.update(now)
            old = first or (0, [0] * len(now[1]), [0] * len(now[2]))
            change = [[b - a for a, b in zip(old[i], now[i], strict=True)] for i in (1, 2)]
            if first is None or any(map(any, change)):  # a repository has a score from its first file on
                yield Row(repo_id=key[0], scored=change[0], gated=change[1])

    def close(self) -> None:
        pass


def _summed(rows: DataFrame) -> DataFrame:
    add = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(len(SEVERITIES))]).alias(c)
    return rows.groupBy("repo_id").agg(add("scored"), add("gated"))


def scores_of_totals(totals: DataFrame, fail_on: str = "high") -> DataFrame:
    """Risk, grade (A7, A8) and gate (F11) from counts per severity."""
    rows = lambda c: totals.select("repo_id", F.posexplode(c).alias("i", "n")).withColumn(
        "severity", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("i") + 1)).filter("n > 0")
    scores = A.scores_from_counts(rows("scored"), totals)
    limit = SEVERITIES.index(fail_on) + 1 if fail_on in SEVERITIES else 0
    blocking = F.aggregate(F.slice("gated", 1, limit), F.lit(0).cast("long"), lambda a, x: a + x) if limit else F.lit(0).cast("long")
    return scores.join(totals.select("repo_id", blocking.alias("blocking")), "repo_id").select(
        "repo_id", "risk_score", "grade", (F.col("blocking") > 0).alias("failed"), "blocking")


def _epochs(spark: SparkSession, out: str) -> list[int]:
    if not is_dir(spark, out):
        return []
    fs, p = _fs_path(spark, out)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))


def _totals(spark: SparkSession, out: str, before: int) -> DataFrame:
    """Totals as of the last epoch below ``before``."""
    past = [e for e in _epochs(spark, out) if e < before]
    if not past:
        return spark.createDataFrame([], _TOTALS)
    return spark.read.parquet(os.path.join(out, f"epoch={past[-1]}")).select("repo_id", "scored", "gated")


def stream_live_scores(spark: SparkSession, changes: str, *, base: str | None = None, fail_on: str = "high",
                       files_per_batch: int | None = None) -> str:
    """Follow a folder of ``CHANGES``; gives the folder of totals and scores,
    ``epoch=N`` each.  With the same ``base`` a later run goes on where the
    last one ended."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    base = base or _scratch(spark, "live-scores")
    out = os.path.join(base, "out")

    def batch(df: DataFrame, epoch: int) -> None:
        # written first: every branch of the scores would run the state operator of the batch again
        summed = os.path.join(base, "totals", f"epoch={epoch}")
        _summed(_totals(spark, out, epoch).unionByName(df)).write.mode("overwrite").parquet(summed)
        totals = spark.read.schema(_TOTALS).parquet(summed)
        scores = scores_of_totals(totals, fail_on)
        totals.join(scores, "repo_id").write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))

    reader = spark.readStream.schema(CHANGES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    deltas = reader.parquet(changes).groupBy("repo_id", "path").transformWithState(
        statefulProcessor=NewestFile(), outputStructType=_DELTA, outputMode="Update", timeMode="None")
    run_to_completion(deltas.writeStream.foreachBatch(batch).outputMode("update").option(
        "checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start())
    return out


def live_scores(spark: SparkSession, out: str) -> DataFrame:
    """The last epoch's (repo_id, risk_score, grade, failed, blocking)."""
    epochs = _epochs(spark, out)
    if not epochs:
        return spark.createDataFrame([], "repo_id string, risk_score long, grade string, failed boolean, blocking long")
    return spark.read.parquet(os.path.join(out, f"epoch={epochs[-1]}")).select("repo_id", "risk_score", "grade", "failed", "blocking")
