"""Live scores: any order and repetition of file versions ends at the batch scores."""
import random

import pytest
from pyspark.sql import functions as F

from codeaudit.operators import findings as A
from codeaudit.streaming import live as L

SEV = ["critical", "high", "medium", "low", "info"]


def history(seed, repos=3, files=12, versions=5):
    """(repo, path, version, deleted, findings) rows and the newest of each file."""
    r = random.Random(seed)
    rows = []
    for k in range(repos):
        for f in range(files):
            for v in range(1, r.randrange(1, versions) + 1):
                gone = r.random() < .2
                rows.append((f"r{k}", f"f{f}", v, gone, [] if gone else [(r.choice(SEV), r.choice(["secrets", "readiness"]))
                                                                         for _ in range(r.randrange(0, 4))]))
    rows.append(("empty", "only", 1, False, []))
    return rows


def counts(found, scored):
    return [sum(s == x and (not scored or scanner != "readiness") for s, scanner in found) for x in SEV]


def batch_scores(spark, rows, fail_on):
    newest = {}
    for row in sorted(rows, key=lambda x: x[2]):
        newest[row[:2]] = row
    found = [(r, p, s, k) for (r, p), row in newest.items() for s, k in row[4]]
    df = spark.createDataFrame(found, "repo_id string, path string, severity string, scanner string")
    repos = spark.createDataFrame([(r,) for r in {x[0] for x in rows}], "repo_id string")
    return sorted(map(tuple, A.risk_scores(df, repos).join(A.gate(df, fail_on=fail_on, repos=repos), "repo_id").select(
        "repo_id", "risk_score", "grade", "failed", "blocking").collect()))


def put(spark, rows, folder):
    data = [(r, p, v, g, counts(f, True), counts(f, False)) for r, p, v, g, f in rows]
    spark.createDataFrame(data, L.CHANGES).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed,fail_on", [(1, "high"), (2, "never")])
def test_any_order_ends_at_the_batch_scores(spark, tmp_path, seed, fail_on):
    rows = history(seed)
    r = random.Random(seed)
    feed = rows + r.sample(rows, 10)
    r.shuffle(feed)
    folder, base = str(tmp_path / "changes"), str(tmp_path / "base")
    for part in (feed[:25], feed[25:60]):
        put(spark, part, folder)
    L.stream_live_scores(spark, folder, base=base, fail_on=fail_on, files_per_batch=1)
    put(spark, feed[60:], folder)  # a later run goes on
    put(spark, feed[:30], folder)  # old versions again
    out = L.stream_live_scores(spark, folder, base=base, fail_on=fail_on, files_per_batch=1)
    assert sorted(map(tuple, L.live_scores(spark, out).collect())) == batch_scores(spark, rows, fail_on)
    assert len(L._epochs(spark, out)) == 4


def test_a_replayed_epoch_writes_the_same(spark, tmp_path):
    """The last epoch run again, as after a failure before its commit."""
    import os
    rows = history(3)
    folder, base = str(tmp_path / "changes"), str(tmp_path / "base")
    put(spark, rows[:20], folder)
    put(spark, rows[20:], folder)
    out = L.stream_live_scores(spark, folder, base=base, files_per_batch=1)
    want = batch_scores(spark, rows, "high")
    assert sorted(map(tuple, L.live_scores(spark, out).collect())) == want
    for name in ("1", ".1.crc"):
        p = os.path.join(base, "ckpt", "commits", name)
        if os.path.exists(p):
            os.remove(p)
    L.stream_live_scores(spark, folder, base=base, files_per_batch=1)
    assert sorted(map(tuple, L.live_scores(spark, out).collect())) == want


def test_files_to_changes(spark):
    from conftest import FAKE_AWS
    from codeaudit.plans.scan import file_findings
    from codeaudit.sources.tables import file_columns
    rows = [("r", "a.py", f'K = "{FAKE_AWS}"\n', 1, False), ("r", "a.py", "x = 1\n", 2, False), ("r", "b.py", f'K = "{FAKE_AWS}"\n', 1, False),
            ("r", "b.py", None, 3, True), ("s", "c.py", f'K = "{FAKE_AWS}"\n', 1, None)]
    f = L.newest(file_columns(spark.createDataFrame(rows, "repo_id string, path string, content string, version long, deleted boolean"),
                              extra=["version", "deleted"]))
    got = {(r.repo_id, r.path): (r.version, r.deleted, r.scored) for r in L.file_changes(
        f, file_findings(f.filter(~F.coalesce("deleted", F.lit(False))), ["secrets"])).collect()}
    assert got == {("r", "a.py"): (2, False, [0] * 5), ("r", "b.py"): (3, True, [0] * 5), ("s", "c.py"): (1, False, [1, 0, 0, 0, 0])}


def test_an_epoch_runs_its_state_operator_once(spark, tmp_path, monkeypatch):
    """The scores of a batch start from its written totals; its keys are asked for once."""
    rows, runs = history(4), spark.sparkContext.accumulator(0)
    handle = L.NewestFile.handleInputRows

    class Counted(L.NewestFile):
        def handleInputRows(self, key, rows, timerValues):
            runs.add(1)
            return handle(self, key, rows, timerValues)

    monkeypatch.setattr(L, "NewestFile", Counted)
    put(spark, rows, folder := str(tmp_path / "changes"))
    out = L.stream_live_scores(spark, folder, base=str(tmp_path / "base"))
    assert sorted(map(tuple, L.live_scores(spark, out).collect())) == batch_scores(spark, rows, "high")
    assert runs.value == len({r[:2] for r in rows})
