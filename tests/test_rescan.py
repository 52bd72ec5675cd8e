"""State kept in place over several rescans."""
import os
import time

import pytest
from conftest import FAKE_AWS, FAKE_GH, FAKE_STRIPE
from pyspark.sql import functions as F

from codeaudit.plans import rescan as RE
from codeaudit.plans import scan as PS
from codeaudit.sources.tables import file_columns

ON = ["secrets", "config"]


def files(spark, rows):
    """(repo, path, text, mtime) rows as files."""
    d = spark.createDataFrame(rows, "repo_id string, path string, content string, t long")
    return file_columns(d.withColumn("mtime", F.timestamp_seconds("t")), extra=["mtime"])


def found(df):
    return sorted((r.repo_id, r.path, r.id, r.line) for r in df.collect())


def keys(df):
    return sorted(tuple(r) for r in df.collect())


def tree(n=60):
    return {(f"r{i % 3}", f"src/f{i}.py"): (f'K{i} = "{FAKE_AWS}"\n' if i % 4 == 0 else f"x = {i}\n", 100) for i in range(n)}


def rows(t):
    return [(r, p, c, m) for (r, p), (c, m) in t.items()]


def parts(path):
    return {d: sorted((f, os.stat(os.path.join(b, f)).st_mtime_ns) for f in fs if f.endswith(".parquet"))
            for b, ds, fs in os.walk(path) for d in [os.path.basename(b)] if d.startswith("bucket=")}


def test_three_rescans_replace_only_what_changed(spark, tmp_path):
    path, t = str(tmp_path / "state"), tree()
    a = RE.rescan(files(spark, rows(t)), path, ON, buckets=16)
    assert len(a.buckets) == 16 and keys(a.scanned) == sorted(t)
    assert found(a.findings) == found(PS.file_findings(files(spark, rows(t)), ON))
    before = parts(path)
    none = RE.rescan(files(spark, rows(t)), path, ON, buckets=16)
    assert none.buckets == [] and keys(none.scanned) == [] and found(none.findings) == found(a.findings) and parts(path) == before
    t["r0", "src/f0.py"] = ("clean = 1\n", 101)  # changed, gone, new, touched alone
    del t["r1", "src/f4.py"]
    t["r9", "new.py"] = (f'T = "{FAKE_STRIPE}"\n', 5)
    t["r2", "src/f8.py"] = (t["r2", "src/f8.py"][0], 102)
    b = RE.rescan(files(spark, rows(t)), path, ON, buckets=16)
    assert keys(b.scanned) == [("r0", "src/f0.py"), ("r2", "src/f8.py"), ("r9", "new.py")] and keys(b.gone) == [("r1", "src/f4.py")]
    assert found(b.findings) == found(PS.file_findings(files(spark, rows(t)), ON))
    after = parts(path)
    assert len(b.buckets) <= 4 and {x for x in after if after[x] != before.get(x)} == {f"bucket={x}" for x in b.buckets}
    gone = RE.rescan(files(spark, [("r0", "src/f1.py", "x = 1\n", 100)]), path, ON, buckets=16)
    assert found(gone.findings) == [] and RE.read_state(spark, path, 16).count() == 1
    assert RE.rescan(files(spark, [("r0", "src/f1.py", "x = 1\n", 100)]), path, ON, buckets=16).buckets == []


def test_another_ruleset_a_lost_bucket_and_other_bucket_counts(spark, tmp_path):
    import shutil
    path, t = str(tmp_path / "state"), tree(30)
    RE.rescan(files(spark, rows(t)), path, ON, buckets=4)
    only = RE.rescan(files(spark, rows(t)), path, ["secrets"], buckets=4)
    want = found(only.findings)
    assert keys(only.scanned) == sorted(t) and {x[2] for x in want} == {"secret/aws-access-key"}
    shutil.rmtree(os.path.join(path, "of=4", "bucket=2"))
    again = RE.rescan(files(spark, rows(t)), path, ["secrets"], buckets=4)
    assert again.buckets == [2] and found(again.findings) == want
    assert len(RE.rescan(files(spark, rows(t)), path, ["secrets"], buckets=8).buckets) == 8


def test_keys_that_share_a_hash_are_dropped_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(RE, "SLOTS", 2)
    path, t = str(tmp_path / "state"), tree()
    RE.rescan(files(spark, rows(t)), path, ON, buckets=2)
    t["r0", "src/f0.py"] = (f'G = "{FAKE_GH}"\n', 200)
    b = RE.rescan(files(spark, rows(t)), path, ON, buckets=2)
    assert keys(b.scanned) == [("r0", "src/f0.py")] and found(b.findings) == found(PS.file_findings(files(spark, rows(t)), ON))


def test_contents_pass_no_exchange_and_unchanged_buckets_are_not_read(spark, tmp_path, monkeypatch):
    stored, path, t = str(tmp_path / "files"), str(tmp_path / "state"), tree()
    RE.write_files_by_bucket(files(spark, rows(t)), stored, 16)
    RE.rescan(spark.read.parquet(stored), path, ON, buckets=16)
    t["r0", "src/f0.py"] = (f'G = "{FAKE_GH}"\n', 200)
    newer = str(tmp_path / "newer")
    RE.write_files_by_bucket(files(spark, rows(t)), newer, 16)
    seen = []
    real = RE.file_findings
    monkeypatch.setattr(RE, "file_findings", lambda f, *a: seen.append(f._jdf.queryExecution().executedPlan().toString()) or real(f, *a))
    b = RE.rescan(spark.read.parquet(newer), path, ON, buckets=16)
    (plan,) = seen
    assert len(b.buckets) == 1 and found(b.findings) == found(PS.file_findings(files(spark, rows(t)), ON))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "content" in x)
    assert "bucket#" in scan and f"= {b.buckets[0]})" in scan.split("PartitionFilters")[1]
    exchanges = [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x and "ReusedExchange" not in x]
    assert all("hashpartitioning(slot" in x for x in exchanges), exchanges  # of the changed keys' hashes


def test_a_rescan_without_changes_beats_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from codeaudit.sources.tables import documents_to_files
    stored, path = str(tmp_path / "files"), str(tmp_path / "state")
    RE.write_files_by_bucket(documents_to_files(docs), stored)
    f = spark.read.parquet(stored)
    times = []
    for _ in range(3):
        t0 = time.perf_counter()
        RE.rescan(f, path, ON).findings.write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - t0)
    assert min(times[1:]) < times[0] / 2, times


@pytest.mark.parametrize("buckets", [1, 5])
def test_empty(spark, tmp_path, buckets):
    r = RE.rescan(files(spark, []), str(tmp_path / "state"), ON, buckets=buckets)
    assert r.findings.count() == 0 and r.buckets == []
