"""What must not grow with the input: plans and results of steps that did."""
import re

from pyspark.sql import functions as F

from codeaudit.sources import tables as T
from conftest import SF


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_pass_no_driver_and_lines_are_read_once(spark):
    plan = _plan(T.packages_with_typos(spark, SF))
    assert "Broadcast" not in plan
    assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan)) == 1


def test_typos_are_the_three_shapes_of_a_package(spark):
    pk = T.packages_from_lineitem(spark, SF)
    order = F.regexp_extract("repo_id", "([0-9]+)$", 1).cast("long")
    some = pk.filter((order % 20 == 0) & ~F.col("dev"))
    short = some.withColumn("name", F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)")))
    squats = T.packages_with_typos(spark, SF).exceptAll(pk.unionByName(short))
    assert pk.unionByName(short).exceptAll(T.packages_with_typos(spark, SF)).count() == 0
    assert squats.count() == some.filter(F.col("eco").isin(*T.TYPOS)).count() > 0
    assert {r.name for r in squats.select("name").distinct().collect()} <= {n for v in T.TYPOS.values() for n in v}


def test_registry_documents_aggregate_numbers_alone(spark, tmp_path):
    """A buffer of texts makes a sort aggregate, which holds a task's rows."""
    rows = [(9, "a b", "Brand#1", 3), (4, "a b", "Brand#1", 3), (4, "a b", "Brand#1", 3), (5, "a b", "Brand#1", 4), (None, "c", "Brand#2", 1),
            (6, "d", "Brand#0", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    docs = T.registry_docs_from_part(spark, str(tmp_path))
    assert "SortAggregate" not in _plan(docs) and "ObjectHashAggregate" not in _plan(docs)
    got = {(r["name"], r["version"]): r["doc"] for r in docs.collect()}
    assert len(got) == 7 + 7 + 7 + 1 and got[("c", "1.2.1")] is None and got[("d", None)]
    ring = T.LICENSE_RING
    assert ring[(4 + 2) % len(ring)] in got[("a-b", "1.2.3")] and ring[(5 + 2) % len(ring)] in got[("a-b", "1.2.4")]


def test_spdx_documents_pass_bare_names(spark):
    """Places come from the gathered list, and elements are made after the exchange."""
    from codeaudit.plans import export as X
    pk = T.packages_from_lineitem(spark, SF).filter("repo_id < 'order-2'")
    docs = X.spdx_documents(pk)
    exchanged = re.findall(r"Exchange hashpartitioning\(repo_id[^\n]*", _plan(docs))
    assert exchanged and "Window" not in _plan(docs)
    rows = X.spdx_elements(pk).groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("i", F.to_json("p").alias("p"), F.to_json("r").alias("r")))).alias("x"))
    import json
    want = {r.repo_id: ([json.loads(e.p) for e in r.x], [json.loads(e.r) for e in r.x]) for r in rows.collect()}
    got = {r.repo_id: json.loads(r.document) for r in docs.collect()}
    assert {k: (v["packages"], v["relationships"]) for k, v in got.items()} == want


def test_manifest_files_read_the_lines_once_and_keep_nothing(spark):
    """Three files of an order come from one row, one exchange by order and no cache; hooks parse a file once."""
    from codeaudit.sources import manifests as M
    files = T.manifest_files_from_orders(spark, SF)
    for df in (files, M.install_hooks(files)):
        plan = _plan(df)
        assert len(re.findall(r"FileScan parquet[^\n]*lineitem", plan)) == 1 and "InMemoryTableScan" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey", _plan(files))) == 1


def _advisories(spark, rows):
    return spark.createDataFrame([(i, None, [(n, "npm", v, [("SEMVER", [(lo, None), (None, hi)])])]) for i, n, v, lo, hi in rows],
                                 "id string, withdrawn string, affected array<struct<name:string,eco:string,versions:array<string>,"
                                 "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>")


def test_hits_of_advisories_pass_no_exchange(spark):
    """Rows of (version, advisory) are made once, by the last step: neither sorted, compared nor made distinct."""
    from codeaudit.operators import vulns as V
    adv = _advisories(spark, [(f"A{i % 40}", "p", ["1.0", "3.0", "9.9"], "1.0", "2.0" if i % 2 else "2.5") for i in range(80)])
    pv = spark.createDataFrame([("npm", "p", f"{a}.{b}") for a in range(4) for b in range(8)] * 2, "eco string, name string, version string")
    hits = V.vulnerable_versions(pv, adv)
    rows = [tuple(r) for r in hits.select("id", "version").collect()]
    assert len(rows) == len(set(rows)) == sum(8 + (5 if i % 2 == 0 else 0) + 1 for i in range(40))
    assert re.match(r"AdaptiveSparkPlan[^\n]*\n\+- Union", _plan(hits)), "an aggregate above the hits"


def test_an_update_reads_the_packages_once(spark, tmp_path):
    """Both joins of an update start from the distinct versions, which are written once."""
    from codeaudit.operators import vulns as V
    pk = spark.createDataFrame([("npm", "p", "1.0")] * 3 + [("npm", None, "1.0"), (None, "p", None)], "eco string, name string, version string")
    pv = V.package_versions(pk)
    assert pv.count() == 3 and "Aggregate" not in _plan(pv) and "FileScan parquet" in _plan(pv)


def test_package_stats_make_packages_once(spark, monkeypatch):
    """No branch of the counts makes the packages anew; nulls and repeated rows count as before."""
    from codeaudit.operators import vulns as V
    adv = _advisories(spark, [("A1", "p", ["7.0"], "1.0", "2.0"), ("A2", "p", ["1.5"], "1.2", "3.0"), ("A3", "q", [], "0", "1.0")])
    rows = [("r", "m1", "p", "1.0", "npm", False), ("r", "m2", "p", "1.0", "npm", True), ("r", "m1", "p", "7.0", "npm", True),
            ("r", None, None, "1.0", "npm", None), ("s", None, "q", "1.0", "npm", True), (None, "m", "p", "1.5", "npm", True)] * 2
    pk = spark.createDataFrame(rows, "repo_id string, manifest string, name string, version string, eco string, dev boolean")
    out = V.package_stats(pk, adv)
    assert not re.search(r"Scan ExistingRDD\[repo_id", _plan(out)) and re.search(r"Scan ExistingRDD\[repo_id", _plan(pk))
    assert sorted(tuple(r) for r in out.collect()) == [("r", 3, 1, 2, 2), ("s", 1, 1, 0, 0)]
    assert sorted(tuple(r) for r in V.package_stats(pk).collect()) == [("r", 3, 1, 2, 0), ("s", 1, 1, 0, 0)]
    assert not re.search(r"Exchange hashpartitioning\(eco#[^\n]*\n[^\n]*HashAggregate\(keys=\[repo_id", _plan(out))
    monkeypatch.setattr(V, "SENT_ROWS", 0)  # a large table of versions is joined by exchange
    large = V.package_stats(pk, adv)
    assert "SortMergeJoin [eco" in _plan(large) and sorted(map(tuple, large.collect())) == sorted(map(tuple, out.collect()))


_ADVISORY = ("id string, summary string, aliases array<string>, withdrawn string, db_severity string, "
             "severity array<struct<type:string,score:string>>, affected array<struct<name:string,eco:string,"
             "versions:array<string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>")


def _advisory(i, fixed, **kw):
    return {"id": f"A-{i}", "summary": f"flaw {i}", "aliases": [], "withdrawn": None, "db_severity": "high", "severity": [],
            "affected": [{"name": "hot", "eco": "npm", "versions": [], "ranges": [
                {"type": "SEMVER", "events": [{"introduced": "0", "fixed": None}, {"introduced": None, "fixed": fixed}]}]}], **kw}


def test_findings_of_one_version_are_dealt_by_their_number(spark, monkeypatch):
    """A version that all repositories use and most advisories affect: no task makes most of its findings, and none is lost or doubled."""
    from codeaudit.operators import vulns as V
    for name, v in (("TASK_FINDINGS", 4_000), ("KEY_FINDINGS", 1_500), ("KEY_USES", 40)):
        monkeypatch.setattr(V, name, v, raising=False)
    dev = {0: True, 1: False, 2: None}
    pk = spark.createDataFrame([(f"r{i}", "package-lock.json", "hot", "1.5.0", "npm", dev[i % 3]) for i in range(300)]
                               + [("r0", "z.json", "hot", "1.5.0", "npm", True), (None, "a.json", "hot", "1.5.0", "npm", False), ("r1", "a.json", "cold", "1", "npm", False)],
                               "repo_id string, manifest string, name string, version string, eco string, dev boolean")
    adv = [_advisory(i, "2.0") for i in range(150)]
    adv += [adv[7], _advisory(900, "1.2"), _advisory(901, "2.0", withdrawn="2024-01-01"), _advisory(None, "2.0", id=None)]
    f = V.vuln_findings(pk, spark.createDataFrame(adv, _ADVISORY))
    rows = f.withColumn("task", F.spark_partition_id()).collect()
    want = sorted((f"r{i}", f"deps/A-{k}", "medium" if i % 3 == 0 else "high", "a.json" if i == 1 else "package-lock.json", i % 3 == 0)
                  for i in range(300) for k in [*range(150), 7])
    assert sorted((r.repo_id, r.id, r.severity, r.path, "(dev-only)" in r.title and "build/dev-time" in r.remediation) for r in rows) == want
    assert {r.title for r in rows if r.repo_id == "r1" and r.id == "deps/A-7"} == {"hot 1.5.0 — A-7: flaw 7"}
    of = {}
    for r in rows:
        of[r.task] = of.get(r.task, 0) + 1
    assert max(of.values()) < len(rows) / 3, of


def test_hits_are_made_by_many_tasks(spark):
    """A few ranges hold very many versions: bytes of the ranges must not make them one task's."""
    from codeaudit.operators import vulns as V
    pk = spark.range(1200).select(F.lit("r").alias("repo_id"), F.lit("hot").alias("name"), F.concat(F.lit("1."), "id").alias("version"), F.lit("npm").alias("eco"))
    hits = V.vulnerable_versions(pk, spark.createDataFrame([_advisory(i, "2.0") for i in range(200)], _ADVISORY)).withColumn("task", F.spark_partition_id())
    n = [r["count"] for r in hits.groupBy("task").count().collect()]
    assert sum(n) == 1200 * 200 and max(n) < sum(n) * 0.6, n


def test_license_findings_hold_no_licence_expression(spark):
    """The driver holds a plan's text many times over: what makes a licence must not stand in it once for every word looked for."""
    from codeaudit.operators import licenses as L
    found = L.license_findings(T.packages_from_lineitem(spark, SF), T.registry_licenses_from_part(spark, SF))
    assert len(found._jdf.queryExecution().toString()) < 200_000 and "InMemoryRelation" not in _plan(found)


def test_license_findings_of_repeated_and_missing_keys(spark):
    from codeaudit.operators import licenses as L
    pk = spark.createDataFrame([("r", "lock", n, v, e, False) for n, v, e in (
        ("a-x", "1", "npm"), ("a-x", "1", "npm"), ("b", "1", "PyPI"), ("c", None, "npm"), ("d", "1", "Go"), ("e", "1", "npm"), ("f", "1", "npm"))],
        "repo_id string, manifest string, name string, version string, eco string, dev boolean")
    reg = spark.createDataFrame([("npm", "a-x", "1", " GPL-3.0 "), ("npm", "a-x", "1", "AGPL-3.0"), ("PyPI", "b", "1", ""), ("npm", "c", None, "GPL-3.0"),
                                 ("Go", "d", "1", "GPL-3.0"), ("npm", "e", "1", "MIT"), ("npm", "f", "1", None)],
                                "eco string, name string, version string, license string")
    got = sorted((r.id, r.title, r.severity, r.evidence) for r in L.license_findings(pk, reg).collect())
    assert got == [("license/network-copyleft", "a-x 1 is AGPL-3.0 (network copyleft)", "high", "npm:a-x@1 — AGPL-3.0"),
                   ("license/strong-copyleft", "a-x 1 is GPL-3.0 (strong copyleft)", "high", "npm:a-x@1 —  GPL-3.0 "),
                   ("license/unknown", "b 1 is no license (unknown)", "low", "PyPI:b@1 — no license")]
