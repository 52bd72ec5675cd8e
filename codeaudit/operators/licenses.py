"""Licence risk (D13–D17): classification, inventory, family grouping, project licence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.operators.packages import distinct_packages
from codeaudit.session import stored

SCANNER = "licenses"
SPDX_REF = "https://spdx.org/licenses/"

WHY = {
    "unknown": "No license declared — legally you have no right to use it.",
    "network copyleft": "Network-copyleft terms can oblige you to publish your own service's source; replace it or get legal sign-off.",
    "file-level copyleft": "Changes to these files must be published; record the obligation in the licence inventory.",
    "strong copyleft": "GPL terms can extend to your distributed product; replace it, isolate it, or get legal sign-off.",
    "proprietary": "Proprietary dependency — confirm your usage is covered by a paid license.",
}


def _any_in(up: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | up.contains(w)
    return out


def classify(lic: Column) -> Column:
    """struct(severity, family, why) or null when permissive."""
    up = F.upper(F.coalesce(lic, F.lit("")))
    mk = lambda s, f, w: F.struct(F.lit(s).alias("severity"), F.lit(f).alias("family"), w.alias("why"))
    return (F.when(F.coalesce(lic, F.lit("")) == "", mk("low", "unknown", F.lit(WHY["unknown"])))
            .when(_any_in(up, R.COPYLEFT_STRONG), mk("high", "network copyleft", F.lit(WHY["network copyleft"])))
            .when(_any_in(up, R.COPYLEFT_FILE), mk("medium", "file-level copyleft", F.lit(WHY["file-level copyleft"])))
            .when(_any_in(up, R.COPYLEFT_WEAK), mk("high", "strong copyleft", F.lit(WHY["strong copyleft"])))
            .when(_any_in(up, R.PERMISSIVE), F.lit(None))
            .when(_any_in(up, R.PROPRIETARY_MARKERS), mk("medium", "proprietary", F.lit(WHY["proprietary"])))
            .otherwise(mk("info", "unrecognised", F.concat(F.lit("License `"), lic,
                                                           F.lit("` was not recognised — check it manually before shipping.")))))


def family_key(name: Column) -> Column:
    """Scoped → ``@scope/first-part``, else the first hyphen part."""
    base = F.element_at(F.split(name, "/"), -1)
    first = F.split(base, "-")[0]
    return F.when(name.startswith("@"), F.concat(F.split(name, "/")[0], F.lit("/"), first)).otherwise(first)


def licensed_packages(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct packages of the fetchable ecosystems with their registry licence;
    packages the registry does not know are skipped (unknown ≠ unlicensed)."""
    pk = distinct_packages(packages).filter(F.col("eco").isin(*R.LICENSE_FETCH_ECOSYSTEMS))
    reg = registry.select("eco", "name", "version", "license").filter(F.col("license").isNotNull())
    return pk.join(reg, ["eco", "name", "version"])


def license_inventory(packages: DataFrame, registry: DataFrame, top: int = R.LICENSE_INVENTORY_TOP) -> DataFrame:
    """Packages per licence per repo, top ``top`` by count (name breaks ties)."""
    lp = licensed_packages(packages, registry)
    key = F.when(F.trim(F.coalesce(F.col("license"), F.lit(""))) == "", F.lit("unknown")).otherwise(F.trim("license"))
    c = lp.groupBy("repo_id", key.alias("license")).agg(F.count(F.lit(1)).cast("long").alias("packages"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("packages"), "license")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def license_hits(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Packages whose licence is not permissive.  Licences are made and written
    before they are classified: a condition on the class, put down to where
    licences are made, would repeat that whole expression for every word looked
    for.  What is said of a licence is said once, before its packages come."""
    reg = stored(registry.select("eco", "name", "version", "license").filter(
        F.col("license").isNotNull() & F.col("eco").isin(*R.LICENSE_FETCH_ECOSYSTEMS)), "licences")
    lic_label = F.when(F.col("license") == "", F.lit("no license")).otherwise(F.col("license"))
    said = reg.withColumn("v", classify(F.col("license"))).filter(F.col("v").isNotNull()).select(
        "eco", "name", "version", F.col("v.severity").alias("severity"), F.col("v.family").alias("family"),
        F.col("v.why").alias("why"), F.trim(lic_label).alias("lic"),
        F.concat(F.col("eco"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"),
                 F.lit(" — "), lic_label).alias("evidence"),
        family_key(F.col("name")).alias("fkey"))
    return distinct_packages(packages).join(said, ["eco", "name", "version"]).select(
        "repo_id", "first_manifest", "name", "version", "eco", "severity", "family", "why", "lic", "evidence", "fkey")


def license_findings(packages: DataFrame, registry: DataFrame) -> DataFrame:
    """Per (repo, family, licence, family key): fewer than 3 members → one
    finding each; otherwise one grouped finding naming the first 6 (sorted)."""
    # the hits feed four branches (counts, singles, groups, names shown): written once
    h = stored(license_hits(packages, registry), "hits")
    gk = ["repo_id", "family", "lic", "fkey"]
    # member counts by aggregate + join (combines map-side; no group lands whole in one task)
    h = h.join(h.groupBy(*gk).agg(F.count(F.lit(1)).alias("n")), gk)
    fid = F.concat(F.lit("license/"), F.regexp_replace("family", " ", "-"))
    single = h.filter(F.col("n") < R.LICENSE_GROUP_THRESHOLD).select(
        "repo_id", fid.alias("id"),
        F.concat(F.col("name"), F.lit(" "), F.col("version"), F.lit(" is "), F.col("lic"), F.lit(" ("),
                 F.col("family"), F.lit(")")).alias("title"),
        "severity", F.lit(SCANNER).alias("scanner"), F.col("first_manifest").alias("path"), F.lit(0).alias("line"),
        "evidence", F.col("why").alias("remediation"), F.lit(SPDX_REF).alias("reference"))
    # a group shows its first 6 names (sorted): a salted top-k keeps what is
    # collected at 6 per group however many members the group has
    from codeaudit.operators.findings import top_k
    big = h.filter(F.col("n") >= R.LICENSE_GROUP_THRESHOLD)
    shown = top_k(big.select(*gk, "name"), gk, ["name"], R.LICENSE_GROUP_SHOWN) \
        .groupBy(*gk).agg(F.sort_array(F.collect_list("name")).alias("names"))
    g = big.groupBy(*gk).agg(
        F.first("n").alias("n"), F.first("severity").alias("severity"), F.first("why").alias("why"),
        F.first("first_manifest").alias("path")).join(shown, gk)
    more = F.when(F.col("n") > R.LICENSE_GROUP_SHOWN,
                  F.concat(F.lit(" (+"), (F.col("n") - R.LICENSE_GROUP_SHOWN).cast("string"), F.lit(" more)"))
                  ).otherwise(F.lit(""))
    grouped = g.select(
        "repo_id", fid.alias("id"),
        F.concat(F.col("n").cast("string"), F.lit(" packages are "), F.col("lic"), F.lit(" ("), F.col("family"),
                 F.lit(")")).alias("title"),
        "severity", F.lit(SCANNER).alias("scanner"), "path", F.lit(0).alias("line"),
        F.concat(F.array_join(F.slice("names", 1, R.LICENSE_GROUP_SHOWN), ", "), more).alias("evidence"),
        F.concat(F.col("why"), F.lit(" These are variant builds of one dependency — review the obligation once.")
                 ).alias("remediation"),
        F.lit(SPDX_REF).alias("reference"))
    return single.unionByName(grouped)


def project_license(files: DataFrame) -> DataFrame:
    """Per repo, the licence named by the first root LICENSE-like file
    (SPDX id in its first 2000 chars, else a marker phrase, else 'custom')."""
    order = F.create_map(*[x for i, n in enumerate(R.PROJECT_LICENSE_FILES) for x in (F.lit(n), F.lit(i))])
    cand = files.filter(F.col("path").isin(*R.PROJECT_LICENSE_FILES)).select(
        "repo_id", order[F.col("path")].alias("o"), F.substring("content", 1, 2000).alias("head"))
    first = cand.groupBy("repo_id").agg(F.min_by("head", "o").alias("head"))
    spdx = F.regexp_extract("head", R.java_pattern(R.PROJECT_LICENSE_SPDX_PATTERN), 1)
    lic = F.when(spdx != "", spdx)
    for marker, sp in R.PROJECT_LICENSE_MARKERS:
        lic = lic.when(F.lower("head").contains(marker.lower()), F.lit(sp))
    return first.select("repo_id", lic.otherwise(F.lit("custom")).alias("license"))


def registry_license(doc: Column, eco: Column) -> Column:
    """The licence string of a registry document (VARIANT).
    npm: ``license`` or ``licenses`` — a list (types joined by ', '), an object
    (its ``type``) or a string.  PyPI: ``info.license_expression`` or
    ``info.license`` (stripped); when empty or longer than 60 characters, the
    last part of the first ``License :: `` classifier; cut to 80."""
    def g(path: str, typ: str) -> Column:
        return F.try_variant_get(doc, path, typ)
    first_lic = g("$.license", "variant")
    k1 = F.schema_of_variant(first_lic)
    falsy = (first_lic.isNull() | (k1 == "NULL") | (F.try_variant_get(first_lic, "$", "string") == "")
             | (k1.startswith("ARRAY") & (F.size(F.try_variant_get(first_lic, "$", "array<variant>")) == 0))
             | (k1.startswith("OBJECT") & (F.size(F.try_variant_get(first_lic, "$", "map<string,variant>")) == 0))
             | (k1 == "BOOLEAN") & ~F.coalesce(F.try_variant_get(first_lic, "$", "boolean"), F.lit(False)))
    lic = F.when(~falsy, first_lic).otherwise(g("$.licenses", "variant"))
    kind = F.schema_of_variant(lic)
    as_list = F.array_join(F.transform(F.coalesce(F.try_variant_get(lic, "$", "array<variant>"), F.array()),
                                       lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"),
                                                        F.coalesce(F.try_variant_get(x, "$.type", "string"), F.lit("")))
                                       .otherwise(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))), ", ")
    npm = (F.when(kind.startswith("ARRAY"), as_list)
           .when(kind.startswith("OBJECT"), F.coalesce(F.try_variant_get(lic, "$.type", "string"), F.lit("")))
           .otherwise(F.coalesce(F.try_variant_get(lic, "$", "string"), F.lit(""))))
    expr = F.coalesce(F.try_variant_get(doc, "$.info.license_expression", "string"), F.lit(""))
    plain = F.coalesce(F.try_variant_get(doc, "$.info.license", "string"), F.lit(""))
    first = F.trim(F.when(expr != "", expr).otherwise(plain))
    classifiers = F.coalesce(F.try_variant_get(doc, "$.info.classifiers", "array<string>"), F.array().cast("array<string>"))
    cls = F.try_element_at(F.filter(classifiers, lambda c: c.startswith("License :: ")), F.lit(1))
    from_cls = F.trim(F.element_at(F.split(cls, "::"), -1))
    pypi = F.substring(F.when((first == "") | (F.length(first) > 60), F.coalesce(from_cls, first)).otherwise(first), 1, 80)
    # an unreadable document is "unknown", not "unlicensed": no licence at all
    return F.when(doc.isNull(), F.lit(None).cast("string")).when(eco == "npm", npm).when(eco == "PyPI", pypi)


def registry_licenses(docs: DataFrame) -> DataFrame:
    """(eco, name, version, doc JSON) → (eco, name, version, license)."""
    d = docs.select("eco", "name", "version", F.try_parse_json("doc").alias("doc"))
    return d.select("eco", "name", "version", registry_license(F.col("doc"), F.col("eco")).alias("license"))
