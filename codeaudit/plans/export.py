"""Sinks (K1–K9): purl, SBOM rows and documents, SARIF, JSON report,
markdown rows, baseline, rule catalogue.

Relations first: every export is a DataFrame of rows (one per component,
result, rule …) that can be written partitioned by repo.  The document-shaped
variants assemble one JSON string per repo from those rows; a document is
bounded by what one repository contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.operators.findings import report_order
from codeaudit.model import SARIF_LEVEL, SARIF_RANK, _map_lit, fingerprint, sev_ord

TOOL_NAME = "codeaudit"
TOOL_VERSION = "0.1.0"


def pct_quote(col: Column) -> Column:
    """Percent-encode everything but ``A-Za-z0-9_.-~`` (URI component style)."""
    e = F.url_encode(col)
    return F.replace(F.replace(F.replace(e, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
                     F.lit("%7E"), F.lit("~"))


def purl(name: Column, version: Column, eco: Column) -> Column:
    """K7: package URL; npm scopes are encoded separately from the package."""
    t = F.coalesce(_map_lit(R.PURL_TYPE)[eco], F.lower(eco))
    scoped = (t == "npm") & name.startswith("@") & name.contains("/")
    ns = F.substring_index(name, "/", 1)
    pkg = F.substring(name, F.length(ns) + 2, F.lit(1 << 30))
    return F.when(scoped, F.concat(F.lit("pkg:npm/"), pct_quote(ns), F.lit("/"), pkg, F.lit("@"), version)) \
        .otherwise(F.concat(F.lit("pkg:"), t, F.lit("/"), pct_quote(name), F.lit("@"), version))


def serial(root: Column) -> Column:
    """K8: deterministic urn:uuid from sha256 of the root."""
    h = F.sha2(root, 256)
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
                    F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def sbom_components(packages: DataFrame) -> DataFrame:
    """K5 rows: one CycloneDX component per distinct package."""
    d = packages.select("repo_id", "name", "version", "eco").distinct()
    p = purl(F.col("name"), F.col("version"), F.col("eco"))
    return d.select("repo_id", "name", "version", "eco", F.lit("library").alias("type"),
                    p.alias("bom_ref"), p.alias("purl"))


def spdx_packages(packages: DataFrame) -> DataFrame:
    """K6 rows: SPDX packages with index i (sorted by name, version, eco) and the
    relationship (DESCRIBES for the first, CONTAINS after).  The index is a
    per-repo position computed with ``row_index`` (range-partitioned), so a
    repository with a very large package list is spread over many tasks."""
    return _spdx_rows(packages).select(
        "repo_id", "i", F.concat(F.lit("SPDXRef-Package-"), F.col("i").cast("string")).alias("spdx_id"),
        "name", F.col("version").alias("version_info"),
        purl(F.col("name"), F.col("version"), F.col("eco")).alias("purl"),
        F.when(F.col("i") == 0, "DESCRIBES").otherwise("CONTAINS").alias("relationship"))


def _spdx_rows(packages: DataFrame) -> DataFrame:
    from codeaudit.functions.windows import row_index
    d = packages.select("repo_id", "name", "version", "eco").distinct()
    return row_index(d, ["repo_id"], ["name", "version", "eco"]).withColumn("i", F.col("i").cast("int"))


def cyclonedx_documents(packages: DataFrame, project_license: DataFrame | None = None,
                        timestamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """K5 documents: one CycloneDX 1.5 JSON string per repo."""
    c = sbom_components(packages)
    comp = F.struct(F.col("name").alias("_n"), F.col("version").alias("_v"), F.col("eco").alias("_e"),
                    F.struct(F.col("type"), F.col("bom_ref").alias("bom-ref"), "name", "version", "purl").alias("c"))
    g = c.groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(comp)), lambda x: x["c"]).alias("components"))
    return _cyclonedx(g, project_license, timestamp)


def cyclonedx_frames(repos: DataFrame, project_license: DataFrame | None = None, timestamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """K5 documents without components."""
    return _cyclonedx(repos.select("repo_id", F.array().alias("components")), project_license, timestamp)


def _cyclonedx(g: DataFrame, project_license: DataFrame | None, timestamp: str) -> DataFrame:
    if project_license is not None:
        g = g.join(project_license, "repo_id", "left")
    else:
        g = g.withColumn("license", F.lit(None).cast("string"))
    lic = F.when(F.coalesce(F.col("license"), F.lit("")) != "",
                 F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))))
    doc = F.struct(
        F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"),
        serial(F.col("repo_id")).alias("serialNumber"), F.lit(1).alias("version"),
        F.struct(F.lit(timestamp).alias("timestamp"),
                 F.array(F.struct(F.lit(TOOL_NAME).alias("name"), F.lit(TOOL_VERSION).alias("version"))).alias("tools"),
                 F.struct(F.lit("application").alias("type"), F.concat(F.lit("root-"), F.col("repo_id")).alias("bom-ref"),
                          F.col("repo_id").alias("name"), F.lit("0.0.0").alias("version"),
                          lic.alias("licenses")).alias("component")).alias("metadata"),
        F.col("components"))
    return g.select("repo_id", F.to_json(doc).alias("document"))


def spdx_documents(packages: DataFrame, timestamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """K6 documents: one SPDX 2.3 JSON per repo, packages in index order, the
    first DESCRIBED and the rest CONTAINED by the document."""
    # a document gathers its repository's packages anyway: bare names and versions pass the exchange, places come from the
    # sorted array, and elements are made from it
    d = packages.select("repo_id", "name", "version", "eco").filter("repo_id is not null").distinct()
    g = d.groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("name", "version", "eco"))).alias("x"))
    element = lambda k: F.transform("x", lambda e, i: _spdx_element(i, e["name"], e["version"], e["eco"])[k])
    return _spdx(g.select("repo_id", element(0).alias("packages"), element(1).alias("relationships")), timestamp)


def spdx_frames(repos: DataFrame, timestamp: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """K6 documents without packages."""
    return _spdx(repos.select("repo_id", F.array().alias("packages"), F.array().alias("relationships")), timestamp)


def _spdx_element(i: Column, name: Column, version: Column, eco: Column) -> tuple[Column, Column]:
    """The package and the relationship at place ``i`` of a K6 document."""
    spdx_id = F.concat(F.lit("SPDXRef-Package-"), i.cast("string"))
    pkg = F.struct(
        spdx_id.alias("SPDXID"), name.alias("name"), version.alias("versionInfo"),
        F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        F.lit("NOASSERTION").alias("licenseConcluded"), F.lit("NOASSERTION").alias("licenseDeclared"),
        F.lit("NOASSERTION").alias("copyrightText"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"),
                         purl(name, version, eco).alias("referenceLocator"))).alias("externalRefs"))
    rel = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.when(i == 0, "DESCRIBES").otherwise("CONTAINS").alias("relationshipType"),
                   spdx_id.alias("relatedSpdxElement"))
    return pkg, rel


def spdx_elements(packages: DataFrame) -> DataFrame:
    """(repo_id, i, p, r): the packages and relationships of K6 documents."""
    pkg, rel = _spdx_element(F.col("i"), F.col("name"), F.col("version"), F.col("eco"))
    return _spdx_rows(packages).select("repo_id", "i", pkg.alias("p"), rel.alias("r"))


def _spdx(g: DataFrame, timestamp: str) -> DataFrame:
    doc = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"),
        F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.concat(F.col("repo_id"), F.lit("-sbom")).alias("name"),
        F.concat(F.lit("https://spdx.org/spdxdocs/"), F.col("repo_id"), F.lit("-"), serial(F.col("repo_id"))).alias("documentNamespace"),
        F.struct(F.lit(timestamp).alias("created"),
                 F.array(F.lit(f"Tool: {TOOL_NAME}-{TOOL_VERSION}")).alias("creators")).alias("creationInfo"),
        "packages", "relationships")
    return g.select("repo_id", F.to_json(doc).alias("document"))


def sarif_results(findings: DataFrame, extra: list | None = None) -> DataFrame:
    """K2 rows: one SARIF result per finding (level, message, location,
    fingerprint); URLs and empty paths point at '.', line at least 1."""
    local = (F.coalesce(F.col("path"), F.lit("")) != "") & ~F.col("path").startswith("http")
    msg = F.when(F.coalesce(F.col("evidence"), F.lit("")) != "",
                 F.concat(F.col("title"), F.lit(" — "), F.col("evidence"))).otherwise(F.col("title"))
    return findings.select(
        "repo_id", F.col("id").alias("rule_id"), _map_lit(SARIF_LEVEL)[F.col("severity")].alias("level"),
        msg.alias("message"),
        F.when(local, F.col("path")).otherwise(F.lit(".")).alias("uri"),
        F.when(local, F.greatest(F.lit(1), F.col("line"))).otherwise(F.lit(1)).cast("int").alias("start_line"),
        fingerprint().alias("fingerprint"), *(extra or []))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """K2 rule descriptors: the first finding per rule id in report order."""
    cols = ["repo_id", "id", "title", "remediation", "reference", "severity", "scanner"]
    first = (findings.groupBy("repo_id", "id")
             .agg(F.min_by(F.struct(*cols), F.struct(sev_ord("severity").alias("_s"), "scanner", "path", "line",
                                                     "evidence")).alias("_b"))
             .select("_b.*"))
    return first.select(
        "repo_id", "id", F.replace(F.col("id"), F.lit("/"), F.lit("_")).alias("name"),
        F.substring("title", 1, 120).alias("short_description"),
        F.when(F.coalesce(F.col("remediation"), F.lit("")) != "", F.col("remediation")).otherwise(F.col("title"))
         .alias("full_description"),
        F.coalesce(F.col("reference"), F.lit("")).alias("help_uri"),
        F.format_number(_map_lit(SARIF_RANK)[F.col("severity")], 1).alias("security_severity"),
        _map_lit(SARIF_LEVEL)[F.col("severity")].alias("level"), "scanner")


def _in_report_order(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Per repo the values of its rows as one array in report order (``_o``)."""
    return rows.groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))),
                                                   lambda x: x[value]).alias(name))


def sarif_elements(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo_id, _o, rule) and (repo_id, _o, r) of K2 documents."""
    order = report_order()
    res = sarif_results(findings, [F.struct(*order).alias("_o")]).select("repo_id", "_o", F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("uri")).alias("artifactLocation"),
                                  F.struct(F.col("start_line").alias("startLine")).alias("region")
                                  ).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("codeauditFingerprint/v1")).alias("partialFingerprints")).alias("r"))
    rules = sarif_rules(findings).select("repo_id", F.struct("id").alias("_o"), F.struct(
        "id", "name", F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
        F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
        F.col("help_uri").alias("helpUri"),
        F.struct(F.col("security_severity").alias("security-severity"),
                 F.array(F.lit("security"), F.col("scanner")).alias("tags")).alias("properties"),
        F.struct(F.col("level")).alias("defaultConfiguration")).alias("rule"))
    return rules, res


def sarif_documents(findings: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """K2 documents: one SARIF 2.1.0 JSON per repo, results and rules in report
    order; repositories of ``repos`` without findings get one without results.
    A document is one string: larger ones are written in parts
    (``documents.write_sarif``)."""
    rules, res = sarif_elements(findings)
    both = _in_report_order(rules, "rule", "rules").join(_in_report_order(res, "r", "results"), "repo_id")
    if repos is not None:
        both = repos.select("repo_id").distinct().join(both, "repo_id", "left")
    both = both.withColumns({c: F.coalesce(c, F.array().cast(both.schema[c].dataType)) for c in ("rules", "results")})
    doc = F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"),
                   F.lit("2.1.0").alias("version"),
                   F.array(F.struct(F.struct(F.struct(F.lit(TOOL_NAME).alias("name"),
                                                      F.lit(R.RULESET_VERSION).alias("version"),
                                                      F.col("rules")).alias("driver")).alias("tool"),
                                    F.col("results"))).alias("runs"))
    return both.select("repo_id", F.to_json(doc).alias("document"))


def markdown_rows(findings: DataFrame, k: int = 25) -> DataFrame:
    """K3 relation: the first ``k`` critical/high/medium findings per repo in
    report order, with the escaped, cut title and the location cell."""
    from codeaudit.operators.findings import top_k
    top = findings.filter(F.col("severity").isin("critical", "high", "medium"))
    t = top_k(top, ["repo_id"], [sev_ord("severity"), "scanner", "path", "line", "id", "evidence"], k)
    loc = F.when((F.coalesce(F.col("path"), F.lit("")) != "") & (F.col("path") != "."),
                 F.concat(F.lit("`"), F.col("path"),
                          F.when(F.coalesce(F.col("line"), F.lit(0)) != 0,
                                 F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(F.lit("")),
                          F.lit("`"))).otherwise(F.lit("—"))
    return t.select("repo_id", F.col("rank").cast("int").alias("rank"), "severity",
                    F.substring(F.replace(F.col("title"), F.lit("|"), F.lit("\\|")), 1, 90).alias("title"),
                    loc.alias("location"))


def baseline_rows(findings: DataFrame) -> DataFrame:
    """K4: sorted distinct fingerprints per repo."""
    return findings.select("repo_id", fingerprint().alias("fingerprint")).distinct()


def json_reports(findings: DataFrame, scores: DataFrame, counts: DataFrame,
                 readiness: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """K1: per repo: grade, risk, counts, readiness and stats (when given) and
    the findings with fingerprints."""
    f = findings.withColumn("fingerprint", fingerprint())
    cols = [c for c in f.columns if c != "repo_id"]
    g = _in_report_order(f.select("repo_id", F.struct(*report_order()).alias("_o"), F.struct(*cols).alias("f")), "f", "findings")
    j = scores.join(counts, "repo_id").join(g, "repo_id", "left")
    extra = []
    if readiness is not None:
        j = j.join(readiness.select("repo_id", F.struct(*[c for c in readiness.columns if c != "repo_id"]).alias("readiness")),
                   "repo_id", "left")
        extra.append(F.col("readiness"))
    if stats is not None:
        j = j.join(stats.select("repo_id", F.struct(*[c for c in stats.columns if c != "repo_id"]).alias("stats")),
                   "repo_id", "left")
        extra.append(F.col("stats"))
    doc = F.struct(F.lit(TOOL_NAME).alias("tool"), F.col("repo_id").alias("root"), "grade", "risk_score",
                   F.struct("critical", "high", "medium", "low", "info").alias("counts"), *extra,
                   F.coalesce("findings", F.array()).alias("findings"))
    return j.select("repo_id", F.to_json(doc).alias("document"))


def markdown_documents(findings: DataFrame, scores: DataFrame, counts: DataFrame, k: int = 25) -> DataFrame:
    """K3 text: header with grade and risk, the severity counts table, the top
    ``k`` critical/high/medium rows, and "+N more" — assembled from relations."""
    rows = markdown_rows(findings, k)
    line = F.concat(F.lit("| "), F.col("severity"), F.lit(" | "), F.col("title"), F.lit(" | "), F.col("location"), F.lit(" |"))
    body = rows.groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]).alias("lines"),
        F.count(F.lit(1)).alias("shown"))
    total = findings.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    j = scores.join(counts, "repo_id").join(body, "repo_id", "left").join(total, "repo_id", "left")
    table = F.when(F.col("lines").isNull(), F.lit("No critical, high, or medium findings."))\
        .otherwise(F.concat(F.lit("| Sev | Finding | Location |\n|---|---|---|\n"), F.array_join("lines", "\n")))
    more = F.coalesce(F.col("total"), F.lit(0)) - F.coalesce(F.col("shown"), F.lit(0))
    text = F.concat(
        F.lit("## Security scan\n\n**Grade `"), F.col("grade"), F.lit("`** · risk "), F.col("risk_score").cast("string"),
        F.lit("/100\n\n| Critical | High | Medium | Low | Info |\n|---:|---:|---:|---:|---:|\n| "),
        F.concat_ws(" | ", *[F.col(c).cast("string") for c in ("critical", "high", "medium", "low", "info")]),
        F.lit(" |\n\n"), table,
        F.when((F.col("lines").isNotNull()) & (more > 0),
               F.concat(F.lit("\n\n_+"), more.cast("string"), F.lit(" more findings._"))).otherwise(F.lit("")))
    return j.select("repo_id", text.alias("document"))


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """K9: every rule the engine knows, one row each."""
    from codeaudit.operators.readiness import CHECKS
    rows = [("secret", f"secret/{r.id}", r.title, r.severity) for r in R.SECRET_RULES]
    rows += [("config", f"config/{r.id}", r.title, r.severity) for r in R.CONFIG_RULES]
    rows += [("dangerous-file", p, why, sev) for p, sev, why in R.DANGEROUS_FILES]
    rows += [("readiness", f"readiness/{c.key}", c.label, str(c.weight)) for c in CHECKS]
    return spark.createDataFrame(rows, "kind string, id string, title string, severity string")
