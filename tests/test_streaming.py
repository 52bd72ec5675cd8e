import os

from conftest import FAKE_AWS, FAKE_GH

from codeaudit.sources import tables as T
from codeaudit.streaming import stream as ST


def _write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def test_stream_file_findings(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(0, f'KEY = "{FAKE_AWS}"\n', "en", "s1", 10), (1, "nothing here\n", "en", "s1", 10),
            (2, f'x = "{FAKE_GH}"\n', "en", "s2", 10)]
    _write(spark, rows, "doc_id long, text string, lang string, source string, n_chars long", os.path.join(src, "documents.parquet"))
    schema = spark.read.parquet(os.path.join(src, "documents.parquet")).schema
    out = ST.stream_file_findings(spark, src, "documents.parquet", schema, T.documents_to_files, ["secrets"])
    got = {(r["repo_id"], r["id"]) for r in spark.read.parquet(out).collect()}
    assert got == {("s1", "secret/aws-access-key"), ("s2", "secret/github-token")}


def test_stream_first_seen_dedupes_across_commits(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(0, 0, "user", f'k = "{FAKE_AWS}"'), (5, 1, "user", f'again = "{FAKE_AWS}"'), (10, 0, "user", "placeholder")]
    _write(spark, rows, "conv_id long, turn long, role string, text string", os.path.join(src, "conversations.parquet"))
    schema = spark.read.parquet(os.path.join(src, "conversations.parquet")).schema
    out = ST.stream_first_seen(spark, src, "conversations.parquet", schema, T.conversations_to_adds)
    got = {tuple(r) for r in ST.read_sink(spark, out, ST.SEEN).select("repo_id", "rule_id", "v24").collect()}
    planted = {"team-0": 0}  # conversation 0 holds a planted key
    assert ("team-0", "aws-access-key", FAKE_AWS[:24]) in got and len(got) == 1 + len(planted)


def test_matches_are_those_of_the_history_scan(spark):
    """One alternation within a row, whatever overlaps."""
    import random

    from codeaudit.functions.regex import rule_matches
    from codeaudit.operators.secrets import SCAN_RULES, alternation
    from codeaudit.sources import planted as PL
    from pyspark.sql import functions as F
    r = random.Random(4)
    bits = [s[2] for s in PL.COMMIT_SAMPLES] + ["postgresql://u:AKIA" + "QZ7X4NPLMR3TVK9D@h/x", "https://a:" + FAKE_GH + "@x.test/", "é text", "", "eyJ"]
    d = spark.createDataFrame([(i,) for i in range(80)], "k long").select(
        F.lit("r").alias("repo_id"), F.col("k"), F.array(*[PL._filled(F.lit(b), F.col("k").cast("string")) for b in bits]).alias("bits"))
    picks = spark.createDataFrame([(i, [r.randrange(len(bits)) for _ in range(r.randrange(0, 7))], r.choice([" ", "", "\n"])) for i in range(80)],
                                  "k long, at array<int>, by string")
    adds = d.join(picks, "k").select("repo_id", "k", F.expr("array_join(transform(at, i -> bits[i]), by)").alias("added")).cache()
    rules = [x for x in SCAN_RULES if x.id != "generic-secret"]
    want = alternation(rule_matches(adds, ["repo_id", "k"], "added", rules), ["repo_id", "k"], F.lit(False))
    got = ST.credential_matches(adds)
    rows = lambda x: sorted(map(tuple, x.select("rule_id", "value").collect()))
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_first_seen_by_commit_time(spark, tmp_path):
    """Repeats within the delay are dropped, later ones reported anew; late and
    timeless commits are left out; replayed files change nothing."""
    import datetime as dt
    src, base = str(tmp_path / "src"), str(tmp_path / "base")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    key = lambda c: "AKIA" + c * 4 + "X4NPLMR3TVK9"
    feeds = [[("r", key("Q"), day(0)), ("r", key("Q"), day(1)), ("s", key("Q"), day(1)), ("r", key("W"), None)],
             [("r", key("Q"), day(5)), ("r", key("Z"), day(40))],
             [("r", key("Y"), day(20)), ("r", key("V"), day(41))],   # day 20 is late: the watermark is day 30
             [("r", key("Q"), day(42)), ("r", key("Z"), day(43))]]   # Q was forgotten, Z was not
    schema = spark.createDataFrame([], "repo_id string, added string, committed timestamp").schema
    for i, f in enumerate(feeds):
        _write(spark, [(r, f'k = "{k}"', t) for r, k, t in f], schema, os.path.join(src, f"part{i}.parquet"))
        d = os.path.join(src, f"part{i}.parquet")
        for n in os.listdir(d):  # a stream of files, in this order
            if n.startswith("part-"):
                os.replace(os.path.join(d, n), os.path.join(src, f"f{i}-{n}"))
        for _ in range(2):  # the second run finds nothing new
            out = ST.stream_first_seen(spark, src, "f*.parquet", schema, lambda x: x, delay="10 days", base=base, files_per_batch=1)
    got = sorted((r.repo_id, r.v24[4], r.committed) for r in ST.read_sink(spark, out, ST.SEEN).collect())
    assert got == [("r", "Q", day(0)), ("r", "Q", day(42)), ("r", "V", day(41)), ("r", "Z", day(40)), ("s", "Q", day(1))]


def test_stream_new_findings_against_baseline(spark, tmp_path):
    src = str(tmp_path / "src")
    import datetime
    ts = datetime.datetime(2024, 1, 1)
    rows = [(1, ts, 7, "error", 3.5, '{"k": 1}'), (2, ts, 7, "click", 4.5, '{"k": 2}')]
    _write(spark, rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
           os.path.join(src, "events.parquet"))
    schema = spark.read.parquet(os.path.join(src, "events.parquet")).schema
    f = T.events_to_findings(spark.read.parquet(os.path.join(src, "events.parquet")))
    from codeaudit.model import fingerprint
    base = f.filter("ord_pos = 1").select("repo_id", fingerprint().alias("fingerprint"))
    out = ST.stream_new_findings(spark, src, "events.parquet", schema, T.events_to_findings, base)
    assert [r["ord_pos"] for r in spark.read.parquet(out).collect()] == [2]
