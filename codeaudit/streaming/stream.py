"""Structured Streaming variants.

* T1 ``stream_file_findings``: new file versions arrive as parquet; each
  micro-batch is scanned with the batch detectors inside ``foreachBatch``
  (the offset computation uses non-time windows, which a streaming plan cannot
  hold) and written under ``epoch=<id>`` with overwrite, so a replayed epoch
  replaces its own output (exactly-once at the sink).
* T2 ``stream_first_seen``: credential matches from added text, kept as the
  history scan keeps them (leftmost, rule order on ties, going on after the
  last kept match) within each row, then one a (repo, rule, value[:24]).  With
  ``delay`` by commit time and in bounded state.
* T3 ``stream_new_findings``: a findings stream left-outer-joined to the
  static accepted baseline; rows without a baseline match are alerts.

All checkpoints and sinks live under the session's checkpoint directory.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeaudit import rules as R
from codeaudit.model import fingerprint
from codeaudit.session import checkpoint_dir


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def is_dir(spark: SparkSession, path: str) -> bool:
    """Directory test on any Hadoop file system (local, HDFS, object stores)."""
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def read_sink(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The parquet sink of a finished stream; empty when no batch ran."""
    if is_dir(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _source(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType, **options):
    """A parquet file stream over ``source_dir`` filtered to ``glob``; when
    ``glob`` names a directory (a table written by Spark), stream that directory."""
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    table_dir = source_dir.rstrip("/") + "/" + glob
    if is_dir(spark, table_dir):
        return reader.parquet(table_dir)
    return reader.option("pathGlobFilter", glob).parquet(source_dir)


def run_to_completion(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_file_findings(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType,
                         to_files: Callable[[DataFrame], DataFrame], enabled: list[str] | None = None,
                         out_dir: str | None = None, files_per_batch: int | None = None) -> str:
    """Scan every arriving batch of files; returns the sink directory.
    ``files_per_batch`` bounds the input files of a batch (all that wait, by
    default)."""
    from codeaudit.plans.scan import file_findings
    enabled = enabled or ["secrets", "config"]
    base = _scratch(spark, "file-findings")
    out_dir = out_dir or os.path.join(base, "out")

    def batch(df: DataFrame, epoch_id: int) -> None:
        kept: list[DataFrame] = []
        f = file_findings(to_files(df), enabled, kept)
        f.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch_id}"))
        for k in kept:
            k.unpersist()

    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    stream = _source(spark, source_dir, glob, schema, **limit)
    q = (stream.writeStream.foreachBatch(batch).option("checkpointLocation", os.path.join(base, "ckpt"))
         .trigger(availableNow=True).start())
    run_to_completion(q)
    return out_dir


_MATCH = "struct<start:int,rule_ord:int,end:int,rule_id:string,match:string>"
SEEN = "repo_id string, rule_id string, v24 string, committed timestamp"


def credential_matches(adds: DataFrame, text_col: str = "added") -> DataFrame:
    """The matches (repo_id, committed, rule_id, value) that an alternation of
    the provider rules keeps, row by row: a streaming plan holds no window, so
    offsets are running sums within the row's arrays."""
    from codeaudit.functions.regex import _prefilter_sql, sql_str, value_of
    from codeaudit.operators.secrets import SCAN_RULES
    rules = [r for r in SCAN_RULES if r.id != R.GENERIC_RULE_ID]
    time = "committed" if "committed" in adds.columns else "cast(null AS timestamp) AS committed"
    t, none = f"`{text_col}`", f"cast(array() AS array<{_MATCH}>)"
    found = adds.selectExpr("repo_id", time, t, *[
        f"CASE WHEN {_prefilter_sql(t, f'lower({t})', r)} THEN regexp_extract_all({t}, {sql_str(r.pattern)}, 0) END AS m{r.ord}" for r in rules])
    found = found.selectExpr("repo_id", "committed", *[x for r in rules for x in (
        f"m{r.ord}", f"CASE WHEN size(m{r.ord}) > 0 THEN split({t}, {sql_str(r.pattern)}, -1) END AS g{r.ord}")])
    # the texts between the matches place them
    spans = [f"""CASE WHEN size(m{r.ord}) > 0 THEN aggregate(slice(arrays_zip(m{r.ord}, g{r.ord}), 1, size(m{r.ord})),
        named_struct('at', 0, 'out', {none}), (a, e) -> named_struct(
            'at', a.at + length(e.g{r.ord}) + length(e.m{r.ord}), 'out', array_append(a.out, named_struct(
                'start', a.at + length(e.g{r.ord}), 'rule_ord', {r.ord}, 'end', a.at + length(e.g{r.ord}) + length(e.m{r.ord}),
                'rule_id', {sql_str(r.id)}, 'match', e.m{r.ord}))), a -> a.out) END""" for r in rules]
    every = found.selectExpr("repo_id", "committed", f"sort_array(flatten(filter(array({', '.join(spans)}), x -> x IS NOT NULL))) AS x")
    kept = every.selectExpr("repo_id", "committed", f"""explode(aggregate(x, named_struct('s', -1, 'k', {none}),
        (t, e) -> if(e.start >= t.s, named_struct('s', e.end, 'k', array_append(t.k, e)), t)).k) AS m""")
    return kept.select("repo_id", "committed", "m.rule_id", "m.match").select(
        "repo_id", "committed", "rule_id", value_of(rules).alias("value")).filter(F.col("value") != "")


def stream_first_seen(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType,
                      to_adds: Callable[[DataFrame], DataFrame], delay: str | None = None,
                      files_per_batch: int | None = None, base: str | None = None) -> str:
    """First sighting of each credential (repo, rule, value[:24]) in the
    order of arrival; gives the folder of ``SEEN``.

    Without ``delay`` a key is held for good.  With it, ``to_adds`` gives the
    commit time ``committed``, and a key is held until the watermark, the latest
    commit time less ``delay``, passes its own time and ``delay``; seen again
    after that it is reported again.  Commits without a time, or older than the
    watermark when they arrive, are late: the stream leaves them to the history
    scan.  With the same ``base`` a later run goes on where the last one ended."""
    from codeaudit.functions.text import is_placeholder
    base = base or _scratch(spark, "first-seen")
    out = os.path.join(base, "out")
    limit = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    m = credential_matches(to_adds(_source(spark, source_dir, glob, schema, **limit)))
    m = m.filter((F.col("rule_id") == "private-key") | ~is_placeholder("value"))
    keyed = m.select("repo_id", "rule_id", F.substring("value", 1, 24).alias("v24"), "committed")
    keys = ["repo_id", "rule_id", "v24"]
    if delay:
        first = keyed.filter("committed is not null").withWatermark("committed", delay).dropDuplicatesWithinWatermark(keys)
    else:
        first = keyed.dropDuplicates(keys)
    q = (first.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    run_to_completion(q)
    return out


def stream_new_findings(spark: SparkSession, source_dir: str, glob: str, schema: T.StructType,
                        to_findings: Callable[[DataFrame], DataFrame], baseline: DataFrame) -> str:
    """Findings that are not in the accepted baseline (stream–static join)."""
    base = _scratch(spark, "new-findings")
    out = os.path.join(base, "out")
    stream = _source(spark, source_dir, glob, schema)
    f = to_findings(stream).withColumn("fingerprint", fingerprint())
    b = baseline.select("repo_id", "fingerprint", F.lit(True).alias("_accepted")).distinct()
    alerts = f.join(b, ["repo_id", "fingerprint"], "left_outer").filter(F.col("_accepted").isNull()).drop("_accepted")
    q = (alerts.writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(base, "ckpt")).outputMode("append")
         .trigger(availableNow=True).start())
    run_to_completion(q)
    return out
