"""Documents in parts (K1, K2, K5, K6): a repository's document as text files
that, joined in the order of their names, are the document.

Every element of a document's lists is a row and a line.  Rows are dealt by
ranges of (repository, section, order) and each task writes the lines of its
range in order, so a document of any size is written by many tasks in bounded
memory; no repository is gathered in a row.  Files are named by the task's
range and written to a folder that takes its name when the job has finished,
so a repeated task writes the same files again and a failed job shows none.

A fleet has many small documents: what a file costs is kept to opening it.
The tasks list what they wrote in the table ``_files`` of the folder, from
which the documents are read back, so no driver lists folders or moves files.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.model import fingerprint
from codeaudit.operators.findings import report_order
from codeaudit.plans import export as X
from codeaudit.session import checkpoint_dir, qualified
from codeaudit.sources.tree_reader import _arrow_fs, _local
from codeaudit.streaming.stream import _fs_path

_FILES = "_files"
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows without a repository, as Spark names it
_BATCH_LINES, _BATCH_BYTES = 5000, 4 << 20
_ORDER = "struct<sev:int,scanner:string,path:string,line:int,id:string,evidence:string>"


def _order(sev=0, scanner="", path="", line=0, id="", evidence="") -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(sev).alias("sev"), col(scanner).alias("scanner"), col(path).alias("path"), col(line).alias("line"),
                    col(id).alias("id"), col(evidence).alias("evidence")).cast(_ORDER).alias("o")


def _folder_of(repo_id: str | None) -> str:
    """A repository's folder, with the name that ``partitionBy`` gives it."""
    return "repo_id=" + (re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", repo_id) if repo_id else _NO_NAME)


class _Part:
    """A file that appears under its name when it is closed."""

    def __init__(self, root: str, folder: str, name: str, attempt: int):
        here = _local(root)
        self.fs, base = (None, here) if here is not None else _arrow_fs(root)
        self.folder, self.name = f"{base}/{folder}", name
        self.hidden = f"{self.folder}/.{name}.{attempt}"
        if self.fs is None:
            os.makedirs(self.folder, exist_ok=True)
            self.file = open(self.hidden, "wb")  # noqa: SIM115
        else:
            self.fs.create_dir(self.folder, recursive=True)
            self.file = self.fs.open_output_stream(self.hidden)

    def close(self) -> None:
        self.file.close()
        (os.replace if self.fs is None else self.fs.move)(self.hidden, f"{self.folder}/{self.name}")


def _write_parts(rows: DataFrame, root: str) -> DataFrame:
    """The files (repo_id, folder, name) of rows (repo_id, line), which a task
    has in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, written = None, None, []
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.txt"

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(written, pa.schema([(c, pa.string()) for c in ("repo_id", "folder", "name")]))

        for b in batches:
            for repo_id, lines in groupby(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), lambda x: x[0]):
                folder = at[1] if at is not None and at[0] == repo_id else _folder_of(repo_id)
                if at is None or folder != at[1]:
                    if part is not None:
                        part.close()
                    part = _Part(root, folder, name, task.taskAttemptId())
                    written.append({"repo_id": repo_id or None, "folder": folder, "name": name})
                at = (repo_id, folder)
                part.file.write(("\n".join(line or "" for _, line in lines) + "\n").encode("utf-8"))
            if len(written) >= _BATCH_LINES:
                yield listed()
                written.clear()
        if part is not None:
            part.close()
        yield listed()

    return rows.mapInArrow(run, "repo_id string, folder string, name string")


def write_documents(path: str, frames: DataFrame, sections: list[DataFrame]) -> None:
    """``frames`` (repo_id, texts): what stands before, between and after the
    lists; ``sections``: (repo_id, o, json) of each list's elements."""
    spark = frames.sparkSession
    pieces = [frames.select("repo_id", F.posexplode("texts").alias("k", "text")).select(
        "repo_id", (2 * F.col("k")).alias("sec"), F.lit(None).cast(_ORDER).alias("o"), F.lit(0).cast("long").alias("u"), "text")]
    pieces += [s.select("repo_id", F.lit(2 * i + 1).alias("sec"), "o", F.monotonically_increasing_id().alias("u"), F.col("json").alias("text"))
               for i, s in enumerate(sections)]
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pieces-{uuid.uuid4().hex}"
    union = reduce(lambda a, b: a.unionByName(b), pieces)
    union.write.parquet(folder)  # the numbers are used twice
    rows = spark.read.schema(union.schema).parquet(folder)
    # all but a list's first element follow a comma
    first = rows.filter("sec % 2 = 1").groupBy("repo_id", "sec").agg(F.min(F.struct("o", "u")).alias("f")).select(
        "repo_id", "sec", F.col("f.u").alias("u"), F.lit(True).alias("first"))
    line = F.when((F.col("sec") % 2 == 0) | F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["repo_id", "sec", "o", "u"]
    placed = rows.join(first, ["repo_id", "sec", "u"], "left").withColumn("line", line).repartitionByRange(n, *order).sortWithinPartitions(*order)
    fs, end = _fs_path(spark, path)
    if fs.exists(end):
        raise FileExistsError(path)
    begun = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    fs.mkdirs(_fs_path(spark, begun)[1])
    _write_parts(placed.select("repo_id", "line"), qualified(spark, begun)).write.parquet(f"{begun}/{_FILES}")
    if not fs.rename(_fs_path(spark, begun)[1], end):
        raise OSError(f"{begun} cannot be renamed to {path}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, value): the lines of the documents below ``path``."""
    root = qualified(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repos, lines, size = [], [], 0

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(repos, pa.string()), pa.array(lines, pa.binary()).cast(pa.string())], names=["repo_id", "value"])

        here = _local(root)
        fs, base = (None, here) if here is not None else _arrow_fs(root)
        for b in batches:
            for repo_id, folder, name in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = f"{base}/{folder}/{name}"
                with open(at, "rb") if fs is None else io.BufferedReader(fs.open_input_stream(at)) as f:
                    for line in f:
                        repos.append(repo_id)
                        lines.append(line.rstrip(b"\n"))
                        size += len(line)
                        if size >= _BATCH_BYTES or len(lines) >= _BATCH_LINES:
                            yield held()
                            repos, lines, size = [], [], 0
        yield held()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.schema("repo_id string, folder string, name string").parquet(f"{path}/{_FILES}").repartition(n).mapInArrow(
        run, "repo_id string, value string")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(repo_id, json) of the lines of documents that are list elements."""
    lines = read_lines(spark, path).select("repo_id", F.regexp_replace("value", "^,", "").alias("json"))
    return lines.filter(F.col("json").startswith("{") & F.col("json").endswith("}"))


def _split(document: Column, lists: list[str]) -> Column:
    """Texts around the empty lists of a document's frame."""
    text, parts = document, []
    for name in lists:
        at = F.locate(f'"{name}":[]', text) + len(name) + 3
        parts.append(F.substring(text, F.lit(1), at))
        text = F.substring(text, at + 1, F.length(text))
    return F.array(*parts, text).alias("texts")


def write_sarif(path: str, findings: DataFrame, repos: DataFrame) -> None:
    """K2 in parts, with rules and results in the order of ``sarif_documents``."""
    rules, results = X.sarif_elements(findings)
    empty = findings.limit(0)
    frames = X.sarif_documents(empty, repos).select("repo_id", _split(F.col("document"), ["rules", "results"]))
    write_documents(path, frames, [
        rules.select("repo_id", _order(id=F.col("_o.id")), F.to_json("rule").alias("json")),
        results.select("repo_id", F.col("_o").cast(_ORDER).alias("o"), F.to_json("r").alias("json"))])


def write_json_reports(path: str, findings: DataFrame, scores: DataFrame, counts: DataFrame) -> None:
    """K1 in parts."""
    f = findings.withColumn("fingerprint", fingerprint())
    frames = X.json_reports(findings.limit(0), scores, counts).select("repo_id", _split(F.col("document"), ["findings"]))
    write_documents(path, frames, [f.select("repo_id", F.struct(*report_order()).cast(_ORDER).alias("o"), F.to_json(F.struct(
        *[c for c in f.columns if c != "repo_id"])).alias("json"))])


def write_cyclonedx(path: str, packages: DataFrame) -> None:
    """K5 in parts."""
    c = X.sbom_components(packages)
    frames = X.cyclonedx_frames(packages.select("repo_id").distinct()).select("repo_id", _split(F.col("document"), ["components"]))
    write_documents(path, frames, [c.select("repo_id", _order(scanner=F.col("name"), path=F.col("version"), id=F.col("eco")),
                                            F.to_json(F.struct("type", F.col("bom_ref").alias("bom-ref"), "name", "version", "purl")).alias("json"))])


def write_spdx(path: str, packages: DataFrame) -> None:
    """K6 in parts."""
    rows = X.spdx_elements(packages)
    frames = X.spdx_frames(packages.select("repo_id").distinct()).select("repo_id", _split(F.col("document"), ["packages", "relationships"]))
    write_documents(path, frames, [rows.select("repo_id", _order(sev=F.col("i")), F.to_json(c).alias("json")) for c in ("p", "r")])
