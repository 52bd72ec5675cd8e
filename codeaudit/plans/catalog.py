"""Registered queries (one per operator family) and their DuckDB oracles.

Every query reads the given tables (or stand-ins Spark derives from them)
whole; nothing is sampled or capped unless the cap is the feature.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.model import FINDING_COLUMNS, fingerprint
from codeaudit.operators import config as C
from codeaudit.operators import findings as A
from codeaudit.operators import secrets as S
from codeaudit.plans import reference_sql as RS
from codeaudit.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# --------------------------------------------------------------------------
# secrets (R1, R2, F4, F5, F7, F8)
# --------------------------------------------------------------------------
@register("secret_findings", RS.secret_findings_sql())
def secret_findings(spark, sf):
    return S.secret_findings(T.files_from_documents(spark, sf))


@register("secret_entropy", f"""WITH RECURSIVE {RS.secret_matches_sql()}
SELECT repo_id, path, rule_id, CAST(line AS INTEGER) AS line, CAST(start AS BIGINT) AS start,
       round(entropy, 6) AS entropy, {RS.placeholder_sql('value')} AS placeholder
FROM sm""")
def secret_entropy(spark, sf):
    """Every candidate match with its offset, line, value entropy and
    placeholder verdict (the inputs of the gates)."""
    c = S.candidate_matches(T.files_from_documents(spark, sf))
    from codeaudit.functions.text import is_placeholder, shannon_entropy
    return c.select("repo_id", "path", "rule_id", F.col("line").cast("int").alias("line"),
                    F.col("start").cast("long").alias("start"),
                    F.round(shannon_entropy("value"), 6).alias("entropy"),
                    is_placeholder("value").alias("placeholder"))


@register("config_findings", RS.config_findings_sql())
def config_findings(spark, sf):
    return C.config_findings(T.files_from_documents(spark, sf))


@register("config_findings_markup", RS.config_findings_sql(RS.FILES_FROM_PAGES))
def config_findings_markup(spark, sf):
    return C.config_findings(T.files_from_pages(spark, sf))


def _secret_risk_sql(sf_level: str = "") -> str:
    return f"""WITH sf AS ({RS.secret_findings_sql()}),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, left(evidence, 60)
                                 ORDER BY {RS.sql_map({s: i for i, s in enumerate(['critical','high','medium','low','info'])}, 'severity')}) AS rn
    FROM sf),
d AS (SELECT * FROM ranked WHERE rn = 1),
per_sev AS (SELECT repo_id, severity, count(*) AS n FROM d WHERE scanner <> 'readiness' GROUP BY ALL),
per_repo AS (
    SELECT repo_id,
           sum({RS.sql_map({'critical': 40, 'high': 20, 'medium': 8, 'low': 3, 'info': 0}, 'severity', '0')} * (1 + ln(n))) AS raw,
           min({RS.sql_map({s: i for i, s in enumerate(['critical','high','medium','low','info'])}, 'severity')}) AS worst
    FROM per_sev GROUP BY ALL),
repos AS (SELECT DISTINCT source AS repo_id FROM documents),
scored AS (
    SELECT r.repo_id, CAST(least(100, round_even(coalesce(p.raw, 0.0), 0)) AS BIGINT) AS risk_score, p.worst
    FROM repos r LEFT JOIN per_repo p USING (repo_id))
SELECT repo_id, risk_score,
       greatest(CASE WHEN 100 - risk_score >= 85 THEN 'A' WHEN 100 - risk_score >= 70 THEN 'B'
                     WHEN 100 - risk_score >= 50 THEN 'C' WHEN 100 - risk_score >= 30 THEN 'D' ELSE 'F' END,
                CASE worst WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END) AS grade
FROM scored"""


@register("source_risk", _secret_risk_sql())
def source_risk(spark, sf):
    """Flagship: secret findings → dedupe → risk and grade per source."""
    files = T.files_from_documents(spark, sf)
    f = A.dedupe(S.secret_findings(files, with_order=True))
    repos = T.read(spark, sf, "documents").select(F.col("source").alias("repo_id"))
    return A.risk_scores(f, repos)


# --------------------------------------------------------------------------
# findings algebra over the events stand-in
# --------------------------------------------------------------------------
_SEV_ORD = RS.sql_map({s: i for i, s in enumerate(['critical', 'high', 'medium', 'low', 'info'])}, 'severity')
_SEV_W = RS.sql_map({'critical': 40, 'high': 20, 'medium': 8, 'low': 3, 'info': 0}, 'severity', '0')
EVENTS_FINDINGS = """
    SELECT 'repo-' || user_id AS repo_id,
           ['secrets','config','deps','licenses','git','readiness','surface'][event_id % 7 + 1] || '/' || event_type AS id,
           upper(left(event_type, 1)) || lower(substr(event_type, 2)) || ' finding' AS title,
           CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium'
                           WHEN 'view' THEN 'low' WHEN 'signup' THEN 'info' END AS severity,
           ['secrets','config','deps','licenses','git','readiness','surface'][event_id % 7 + 1] AS scanner,
           'src/module_' || CAST(floor(value) AS BIGINT) % 13 || '.py' AS path,
           CAST(CAST(floor(value * 10) AS BIGINT) % 50 AS INTEGER) AS line,
           props AS evidence, 'Review the finding.' AS remediation, '' AS reference,
           event_id AS ord_pos
    FROM events"""
_FCOLS = ", ".join(FINDING_COLUMNS)
_DEDUPED_SQL = f"""
    SELECT {_FCOLS}, ord_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, left(evidence, 60)
                                     ORDER BY {_SEV_ORD}, ord_pos) AS rn
        FROM ({EVENTS_FINDINGS}) WHERE scanner IN ('secrets', 'config')) WHERE rn = 1
    UNION ALL
    SELECT {_FCOLS}, ord_pos FROM ({EVENTS_FINDINGS}) WHERE scanner NOT IN ('secrets', 'config')"""
_FP = "left(sha256(id || '|' || path || '|' || evidence), 16)"
_BASELINE_SQL = f"""
    SELECT DISTINCT repo_id, {_FP} AS fingerprint
    FROM ({EVENTS_FINDINGS}) f WHERE ord_pos IN (SELECT doc_id FROM labels WHERE quality = 1)"""
_POLICY_SQL = """
    SELECT DISTINCT 'repo-' || user_id AS repo_id,
           CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'never' END AS fail_on,
           'src/module_' || (user_id % 10) || '*' AS ignore_glob
    FROM events"""


@register("dedupe_findings", f"SELECT {_FCOLS} FROM ({_DEDUPED_SQL})")
def dedupe_findings(spark, sf):
    return A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS)


@register("finding_fingerprints", f"SELECT repo_id, id, path, line, {_FP} AS fingerprint FROM ({EVENTS_FINDINGS})")
def finding_fingerprints(spark, sf):
    return T.findings_from_events(spark, sf).select("repo_id", "id", "path", "line", fingerprint().alias("fingerprint"))


@register("baseline_suppress", f"""
    SELECT {_FCOLS}, fingerprint FROM (SELECT *, {_FP} AS fingerprint FROM ({_DEDUPED_SQL})) f
    WHERE NOT EXISTS (SELECT 1 FROM ({_BASELINE_SQL}) b WHERE b.repo_id = f.repo_id AND b.fingerprint = f.fingerprint)""")
def baseline_suppress(spark, sf):
    f = A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS)
    return A.baseline_suppress(f, T.baseline_from_labels(spark, sf))


_POLICY_APPLIED_SQL = f"""
    SELECT f.repo_id, f.id, f.title,
           CASE WHEN f.id = 'config/view' THEN 'high' ELSE f.severity END AS severity,
           f.scanner, f.path, f.line, f.evidence, f.remediation, f.reference
    FROM ({_DEDUPED_SQL}) f LEFT JOIN ({_POLICY_SQL}) p USING (repo_id)
    WHERE f.id <> 'deps/signup'
      AND NOT (coalesce(f.path, '') <> '' AND p.ignore_glob IS NOT NULL
               AND regexp_full_match(f.path, replace(replace(p.ignore_glob, '.', '\\.'), '*', '.*')))"""


@register("policy_apply", _POLICY_APPLIED_SQL)
def policy_apply(spark, sf):
    f = A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS)
    return A.apply_policy(f, T.policy_from_events(spark, sf))


@register("severity_counts", f"""
    SELECT repo_id, {', '.join(f"CAST(count_if(severity = '{s}') AS BIGINT) AS {s}" for s in ['critical', 'high', 'medium', 'low', 'info'])}
    FROM ({_POLICY_APPLIED_SQL}) GROUP BY repo_id""")
def severity_counts(spark, sf):
    f = A.apply_policy(A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS),
                       T.policy_from_events(spark, sf))
    return A.severity_counts(f, T.repos_from_events(spark, sf))


@register("risk_grade", f"""
WITH d AS ({_POLICY_APPLIED_SQL}),
per_sev AS (SELECT repo_id, severity, count(*) AS n FROM d WHERE scanner <> 'readiness' GROUP BY ALL),
per_repo AS (SELECT repo_id, sum({_SEV_W} * (1 + ln(n))) AS raw, min({_SEV_ORD}) AS worst FROM per_sev GROUP BY ALL),
repos AS (SELECT DISTINCT 'repo-' || user_id AS repo_id FROM events),
scored AS (SELECT r.repo_id, CAST(least(100, round_even(coalesce(p.raw, 0.0), 0)) AS BIGINT) AS risk_score, p.worst
           FROM repos r LEFT JOIN per_repo p USING (repo_id))
SELECT repo_id, risk_score,
       greatest(CASE WHEN 100 - risk_score >= 85 THEN 'A' WHEN 100 - risk_score >= 70 THEN 'B'
                     WHEN 100 - risk_score >= 50 THEN 'C' WHEN 100 - risk_score >= 30 THEN 'D' ELSE 'F' END,
                CASE worst WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END) AS grade
FROM scored""")
def risk_grade(spark, sf):
    f = A.apply_policy(A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS),
                       T.policy_from_events(spark, sf))
    return A.risk_scores(f, T.repos_from_events(spark, sf))


@register("gate", f"""
WITH d AS ({_POLICY_APPLIED_SQL}),
p AS (SELECT DISTINCT repo_id, fail_on FROM ({_POLICY_SQL})),
j AS (SELECT d.*, coalesce(p.fail_on, 'high') AS thr FROM d LEFT JOIN p USING (repo_id)),
k AS (SELECT repo_id, thr <> 'never' AND {_SEV_ORD} <= {RS.sql_map({s: i for i, s in enumerate(['critical','high','medium','low','info'])}, 'thr')} AS hit FROM j)
SELECT r.repo_id, coalesce(bool_or(hit), false) AS failed, CAST(count_if(hit) AS BIGINT) AS blocking
FROM (SELECT DISTINCT 'repo-' || user_id AS repo_id FROM events) r LEFT JOIN k USING (repo_id) GROUP BY r.repo_id""")
def gate(spark, sf):
    pol = T.policy_from_events(spark, sf)
    f = A.apply_policy(A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS), pol)
    return A.gate(f, fail_on="high", policy=pol, repos=T.repos_from_events(spark, sf))


@register("top_findings_per_rule", f"""
WITH d AS ({_POLICY_APPLIED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY {_SEV_ORD}, scanner, path, line, evidence) AS rank,
             count(*) OVER (PARTITION BY repo_id, id) AS rule_count FROM d)
SELECT r.repo_id, r.id, h.severity AS bucket_severity, CAST(r.rule_count AS BIGINT) AS rule_count,
       CAST(r.rank AS INTEGER) AS rank, r.severity, r.path, r.line, r.evidence
FROM r JOIN (SELECT repo_id, id, severity FROM r WHERE rank = 1) h USING (repo_id, id)
WHERE r.rank <= 5""")
def top_findings_per_rule(spark, sf):
    f = A.apply_policy(A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS),
                       T.policy_from_events(spark, sf))
    return A.top_per_rule(f, 5)


# --------------------------------------------------------------------------
# packages, SBOM, advisories, typosquats, licences
# --------------------------------------------------------------------------
from codeaudit.operators import licenses as L  # noqa: E402
from codeaudit import rules as RULES  # noqa: E402
from codeaudit.operators import packages as P  # noqa: E402
from codeaudit.operators import supply as SU  # noqa: E402
from codeaudit.operators import vulns as V  # noqa: E402
from codeaudit.plans import export as X  # noqa: E402

_ECO_SQL = "['npm','PyPI','crates.io','RubyGems','Go'][CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) % 5 + 1]"
PACKAGES_SQL = f"""
    SELECT 'order-' || l.l_orderkey AS repo_id,
           CASE p.eco WHEN 'npm' THEN 'package-lock.json' WHEN 'PyPI' THEN 'requirements.txt'
                      WHEN 'crates.io' THEN 'Cargo.lock' WHEN 'RubyGems' THEN 'Gemfile.lock' ELSE 'go.mod' END AS manifest,
           replace(p.p_name, ' ', '-') AS name,
           '1.' || l.l_linenumber || '.' || (p.p_size % 10) AS version, p.eco,
           l.l_returnflag = 'R' AS dev
    FROM lineitem l JOIN (SELECT *, {_ECO_SQL} AS eco FROM part) p ON l.l_partkey = p.p_partkey"""
_DISTINCT_PK = f"""
    SELECT d.*, m.first_manifest FROM (SELECT DISTINCT repo_id, name, version, eco FROM ({PACKAGES_SQL})) d
    JOIN (SELECT repo_id, min(manifest) AS first_manifest FROM ({PACKAGES_SQL}) GROUP BY repo_id) m USING (repo_id)"""
_DEV_ONLY = f"""
    SELECT DISTINCT repo_id, name, version, eco FROM ({PACKAGES_SQL}) WHERE dev
    EXCEPT SELECT repo_id, name, version, eco FROM ({PACKAGES_SQL}) WHERE NOT dev"""


def _stand(spark, sf):
    return T.packages_from_lineitem(spark, sf)


@register("packages_distinct", _DISTINCT_PK)
def packages_distinct(spark, sf):
    return P.distinct_packages(_stand(spark, sf))


@register("dev_only", _DEV_ONLY)
def dev_only(spark, sf):
    return P.dev_only(_stand(spark, sf))


@register("sbom_components", f"""
    SELECT DISTINCT repo_id, name, version, eco, 'library' AS type,
           'pkg:' || CASE eco WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang'
                     WHEN 'crates.io' THEN 'cargo' WHEN 'RubyGems' THEN 'gem' ELSE lower(eco) END
             || '/' || url_encode(name) || '@' || version AS bom_ref,
           'pkg:' || CASE eco WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang'
                     WHEN 'crates.io' THEN 'cargo' WHEN 'RubyGems' THEN 'gem' ELSE lower(eco) END
             || '/' || url_encode(name) || '@' || version AS purl
    FROM ({PACKAGES_SQL})""")
def sbom_components(spark, sf):
    return X.sbom_components(_stand(spark, sf))


@register("spdx_packages", f"""
    SELECT repo_id, CAST(i AS INTEGER) AS i, 'SPDXRef-Package-' || i AS spdx_id, name, version AS version_info,
           'pkg:' || CASE eco WHEN 'npm' THEN 'npm' WHEN 'PyPI' THEN 'pypi' WHEN 'Go' THEN 'golang'
                     WHEN 'crates.io' THEN 'cargo' WHEN 'RubyGems' THEN 'gem' ELSE lower(eco) END
             || '/' || url_encode(name) || '@' || version AS purl,
           CASE WHEN i = 0 THEN 'DESCRIBES' ELSE 'CONTAINS' END AS relationship
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY name, version, eco) - 1 AS i
          FROM (SELECT DISTINCT repo_id, name, version, eco FROM ({PACKAGES_SQL})))""")
def spdx_packages(spark, sf):
    return X.spdx_packages(_stand(spark, sf))


_VECTORS = "['" + "','".join(T.CVSS_VECTORS) + "']"
_DBSEV = "['" + "','".join(T.DB_SEVERITIES) + "']"
ADVISORIES_SQL = f"""
    SELECT 'ADV-' || p_partkey AS id,
           upper(left(p_name, 1)) || substr(p_name, 2) AS p_name0, p_name, p_type, p_partkey,
           {_ECO_SQL} AS eco, replace(p_name, ' ', '-') AS name,
           '1.' || (p_size % 7 + 1) || '.0' AS fixed, '1.' || (p_size % 7 + 1) || '.9' AS listed,
           CASE WHEN p_partkey % 11 = 0 THEN '2024-06-01' END AS withdrawn,
           {_DBSEV}[p_partkey % {len(T.DB_SEVERITIES)} + 1] AS db_severity,
           {_VECTORS}[p_partkey % {len(T.CVSS_VECTORS)} + 1] AS vector,
           CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2024-' || p_partkey END AS cve
    FROM part"""


def _vnum(v: str) -> str:
    return (f"list_transform(string_split(regexp_extract({v}, '^v?([0-9]+(?:\\.[0-9]+)*)', 1), '.'), "
            f"lambda x: CAST(x AS INTEGER))")


def _metric(k: str, default: str) -> str:
    return f"coalesce(nullif(regexp_extract(vector, '(?:^|/){k}:([^/]*)', 1), ''), '{default}')"


def _cvss_sql() -> str:
    w = lambda k: f"(CASE {_metric(k, 'N')} WHEN 'H' THEN 0.56 WHEN 'L' THEN 0.22 ELSE 0.0 END)"
    iss = f"(1.0 - ((1.0 - {w('C')}) * (1.0 - {w('I')}) * (1.0 - {w('A')})))"
    ch = f"({_metric('S', '')} = 'C')"
    impact = f"(CASE WHEN {ch} THEN 7.52 * ({iss} - 0.029) - 3.25 * pow({iss} - 0.02, 15.0) ELSE 6.42 * {iss} END)"
    av = f"(CASE {_metric('AV', 'N')} WHEN 'N' THEN 0.85 WHEN 'A' THEN 0.62 WHEN 'L' THEN 0.55 WHEN 'P' THEN 0.2 ELSE 0.85 END)"
    ac = f"(CASE {_metric('AC', 'L')} WHEN 'L' THEN 0.77 WHEN 'H' THEN 0.44 ELSE 0.77 END)"
    pr = (f"(CASE WHEN {ch} THEN (CASE {_metric('PR', 'N')} WHEN 'N' THEN 0.85 WHEN 'L' THEN 0.68 WHEN 'H' THEN 0.50 ELSE 0.85 END) "
          f"ELSE (CASE {_metric('PR', 'N')} WHEN 'N' THEN 0.85 WHEN 'L' THEN 0.62 WHEN 'H' THEN 0.27 ELSE 0.85 END) END)")
    ui = f"(CASE {_metric('UI', 'N')} WHEN 'N' THEN 0.85 WHEN 'R' THEN 0.62 ELSE 0.85 END)"
    total = f"least((CASE WHEN {ch} THEN 1.08 ELSE 1.0 END) * ({impact} + 8.22 * {av} * {ac} * {pr} * {ui}), 10.0)"
    return (f"(CASE WHEN NOT starts_with(vector, 'CVSS:3') THEN NULL WHEN {iss} <= 0 THEN 0.0 "
            f"ELSE ceil({total} * 10) / 10.0 END)")


_ADV_SEV_SQL = f"""(CASE WHEN lower(db_severity) IN ('critical','high','moderate','medium','low')
          THEN (CASE WHEN lower(db_severity) = 'moderate' THEN 'medium' ELSE lower(db_severity) END)
     WHEN {_cvss_sql()} IS NOT NULL THEN (CASE WHEN {_cvss_sql()} >= 9 THEN 'critical' WHEN {_cvss_sql()} >= 7 THEN 'high'
                                         WHEN {_cvss_sql()} >= 4 THEN 'medium' ELSE 'low' END)
     WHEN regexp_matches(vector, '/(?:C|A):') THEN 'high' ELSE 'medium' END)"""


@register("cvss_base", f"""
    SELECT id, vector, CAST({_cvss_sql()} AS DOUBLE) AS base, {_ADV_SEV_SQL} AS severity FROM ({ADVISORIES_SQL})""")
def cvss_base(spark, sf):
    a = T.advisories_from_part(spark, sf)
    return a.select("id", F.col("severity")[0]["score"].alias("vector"),
                    V.cvss_base(F.col("severity")[0]["score"]).alias("base"),
                    V.advisory_severity(F.col("db_severity"), F.col("severity")).alias("severity"))


@register("fixed_version", f"SELECT id, lower(name) AS lname, fixed FROM ({ADVISORIES_SQL})")
def fixed_version(spark, sf):
    return V.fixed_version(T.advisories_from_part(spark, sf))


_DEV_DOWN = RS.sql_map({"critical": "high", "high": "medium", "medium": "low", "low": "info"}, "sev", "sev")
_VULN_SQL = f"""
WITH pk AS ({_DISTINCT_PK}),
adv AS (SELECT *, {_ADV_SEV_SQL} AS sev0 FROM ({ADVISORIES_SQL})),
hits AS (
    SELECT pk.*, adv.id, adv.cve, adv.sev0 AS sev, adv.fixed,
           upper(left(adv.p_name, 1)) || lower(substr(adv.p_name, 2)) AS summary_name, adv.p_type, adv.withdrawn
    FROM pk JOIN adv ON pk.eco = adv.eco AND pk.name = adv.name
    WHERE pk.version = adv.listed OR ({_vnum('pk.version')} >= [1, 0, 0] AND {_vnum('pk.version')} < {_vnum('adv.fixed')})),
dv AS ({_DEV_ONLY}),
j AS (SELECT h.*, (dv.repo_id IS NOT NULL) AS is_dev FROM hits h
      LEFT JOIN dv ON h.repo_id = dv.repo_id AND h.name = dv.name AND h.version = dv.version AND h.eco = dv.eco
      WHERE withdrawn IS NULL)
SELECT repo_id, 'deps/' || id AS id,
       name || ' ' || version || CASE WHEN is_dev THEN ' (dev-only)' ELSE '' END || ' — ' || coalesce(cve, id) || ': '
         || left(upper(left(split_part(summary_name, ' ', 1), 1)) || lower(substr(split_part(summary_name, ' ', 1), 2)) || ' '
                 || upper(left(split_part(summary_name, ' ', 2), 1)) || lower(substr(split_part(summary_name, ' ', 2), 2))
                 || ' ' || lower(p_type) || ' handling flaw', 110) AS title,
       CASE WHEN is_dev THEN {_DEV_DOWN} ELSE sev END AS severity, 'deps' AS scanner, first_manifest AS path, 0 AS line,
       eco || ':' || name || '@' || version AS evidence,
       'Upgrade ' || name || ' to ' || fixed || ' or later.'
         || CASE WHEN is_dev THEN ' This package is build/dev-time only, so it is ranked one level lower.' ELSE '' END AS remediation,
       'https://osv.dev/vulnerability/' || id AS reference
FROM j"""


@register("vuln_join", _VULN_SQL)
def vuln_join(spark, sf):
    return V.vuln_findings(_stand(spark, sf), T.advisories_from_part(spark, sf))


@register("advisory_update", f"SELECT DISTINCT evidence, id FROM ({_VULN_SQL})")
def advisory_update(spark, sf):
    """Hits of an older advisory snapshot (a tenth missing, a tenth with other
    ranges, withdrawn ones still live) brought up to date."""
    pk, after = V.package_versions(_stand(spark, sf)), T.advisories_from_part(spark, sf)
    k = F.regexp_extract("id", "([0-9]+)$", 1).cast("long")
    wide = F.transform("affected", lambda a: a.withField("ranges", F.transform(a["ranges"], lambda r: r.withField(
        "events", F.slice(r["events"], 1, 1)))))
    before = after.filter(k % 10 != 0).withColumn("affected", F.when(k % 10 == 1, wide).otherwise(F.col("affected"))).withColumn(
        "withdrawn", F.lit(None).cast("string"))
    stored = f"{T.checkpoint_dir(spark).rstrip('/')}/hits-{uuid.uuid4().hex}"
    V.vulnerable_versions(pk, V.live_advisories(before)).write.parquet(stored)
    now = V.updated_versions(spark.read.parquet(stored), pk, before, after)
    return now.select(F.concat("eco", F.lit(":"), "name", F.lit("@"), "version").alias("evidence"), F.concat(F.lit("deps/"), "id").alias("id"))


_TYPO_RING = "CASE eco " + " ".join(f"WHEN '{e}' THEN {v!r}" for e, v in T.TYPOS.items()) + " END"
_ORDER_SQL = "CAST(split_part(repo_id, '-', 2) AS BIGINT)"
PACKAGES_TYPOS_SQL = f"""
    SELECT * FROM ({PACKAGES_SQL})
    UNION ALL SELECT * REPLACE (({_TYPO_RING})[{_ORDER_SQL} % 6 + 1] AS name) FROM ({PACKAGES_SQL})
    WHERE {_ORDER_SQL} % 20 = 0 AND NOT dev AND eco IN ({', '.join(f"'{e}'" for e in T.TYPOS)})
    UNION ALL SELECT * REPLACE (left(name, 2) || substr(name, 4) AS name) FROM ({PACKAGES_SQL}) WHERE {_ORDER_SQL} % 20 = 0 AND NOT dev"""


def _typosquat_sql(popular: str) -> str:
    allow = ", ".join(f"('{e}', '{n}')" for e, ns in RULES.TYPOSQUAT_ALLOWLIST.items() for n in ns)
    return f"""
WITH pk AS (SELECT DISTINCT repo_id, eco, name, version, lower(name) AS lname FROM ({PACKAGES_TYPOS_SQL})),
decl AS (SELECT DISTINCT repo_id, eco, lower(name) AS lname FROM ({PACKAGES_TYPOS_SQL}) WHERE NOT dev),
pop AS ({popular}),
allow AS (SELECT * FROM (VALUES {allow}) t(eco, lname)),
cand AS (SELECT DISTINCT eco, lname FROM pk WHERE length(lname) >= 4
         AND (eco, lname) NOT IN (SELECT eco, target FROM pop) AND (eco, lname) NOT IN (SELECT eco, lname FROM allow)),
near AS (SELECT c.eco, c.lname, min(p.target) AS target FROM cand c JOIN pop p ON c.eco = p.eco
         AND abs(length(c.lname) - length(p.target)) <= 1 AND levenshtein(c.lname, p.target) = 1 GROUP BY ALL),
firsts AS (SELECT repo_id, eco, name, min(target) AS target, min(version) AS version FROM pk JOIN near USING (eco, lname)
           WHERE (repo_id, eco, lname) IN (SELECT repo_id, eco, lname FROM decl) GROUP BY ALL)
SELECT repo_id, 'deps/possible-typosquat' AS id,
       name || ' (' || eco || ') is 1 edit from the popular package ''' || target || '''' AS title,
       'medium' AS severity, 'deps' AS scanner, '' AS path, 0 AS line,
       eco || ':' || name || '@' || version || ' ~ ' || target AS evidence,
       'Confirm this is not a typosquat of ''' || target || ''' before shipping it; if it is legitimate, add it to the baseline.' AS remediation,
       'https://cwe.mitre.org/data/definitions/1357.html' AS reference
FROM firsts"""


def _typosquat(spark, sf, least_repos=None):
    pk = T.packages_with_typos(spark, sf)
    declared = pk.filter(~F.col("dev")).select("repo_id", "eco", F.lower("name").alias("lname"))
    return SU.typosquats(pk, declared, SU.fleet_popular(pk, least_repos) if least_repos else None)


@register("typosquat", _typosquat_sql("SELECT * FROM (VALUES " + ", ".join(
    f"('{e}', '{n}')" for e, ns in RULES.POPULAR_PACKAGES.items() for n in ns) + ") t(eco, target)"))
def typosquat(spark, sf):
    return _typosquat(spark, sf)


@register("typosquat_fleet", _typosquat_sql(f"""SELECT eco, lower(name) AS target FROM ({PACKAGES_TYPOS_SQL})
    GROUP BY ALL HAVING count(DISTINCT repo_id) >= 12"""))
def typosquat_fleet(spark, sf):
    """Names one edit from what a dozen repositories of the fleet use."""
    return _typosquat(spark, sf, 12)


_RING = "['" + "','".join(T.LICENSE_RING) + "']"
REGISTRY_SQL = f"""
    SELECT eco, name, version, arg_min(license, p_partkey) AS license FROM (
        SELECT {_ECO_SQL} AS eco, replace(p_name, ' ', '-') AS name, '1.' || line || '.' || (p_size % 10) AS version,
               {_RING}[(p_partkey + line) % {len(T.LICENSE_RING)} + 1] AS license, p_partkey
        FROM part, generate_series(1, 7) t(line)) GROUP BY ALL"""


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _classify_sql(lic: str) -> str:
    import codeaudit.rules as RR
    up = f"upper(coalesce({lic}, ''))"
    return f"""(CASE WHEN coalesce({lic}, '') = '' THEN 'low|unknown'
      WHEN {_any(up, RR.COPYLEFT_STRONG)} THEN 'high|network copyleft'
      WHEN {_any(up, RR.COPYLEFT_FILE)} THEN 'medium|file-level copyleft'
      WHEN {_any(up, RR.COPYLEFT_WEAK)} THEN 'high|strong copyleft'
      WHEN {_any(up, RR.PERMISSIVE)} THEN NULL
      WHEN {_any(up, RR.PROPRIETARY_MARKERS)} THEN 'medium|proprietary'
      ELSE 'info|unrecognised' END)"""


_LIC_PK = f"""
    SELECT pk.*, r.license FROM ({_DISTINCT_PK}) pk JOIN ({REGISTRY_SQL}) r USING (eco, name, version)
    WHERE pk.eco IN ('npm', 'PyPI')"""


@register("license_inventory", f"""
    SELECT repo_id, license, packages, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY packages DESC, license) AS rank FROM (
            SELECT repo_id, CASE WHEN trim(coalesce(license, '')) = '' THEN 'unknown' ELSE trim(license) END AS license,
                   CAST(count(*) AS BIGINT) AS packages
            FROM ({_LIC_PK}) GROUP BY ALL))
    WHERE rank <= 25""")
def license_inventory(spark, sf):
    return L.license_inventory(_stand(spark, sf), T.registry_licenses_from_part(spark, sf)) \
        .select("repo_id", "license", "packages", F.col("rank").cast("int").alias("rank"))


_WHY_SQL = RS.sql_map(L.WHY, "family")
_LIC_FINDINGS_SQL = f"""
WITH h0 AS (SELECT *, {_classify_sql('license')} AS v FROM ({_LIC_PK})),
h AS (
    SELECT repo_id, first_manifest, name, version, eco, split_part(v, '|', 1) AS severity, split_part(v, '|', 2) AS family,
           trim(CASE WHEN coalesce(license, '') = '' THEN 'no license' ELSE license END) AS lic,
           eco || ':' || name || '@' || version || ' — ' || CASE WHEN coalesce(license, '') = '' THEN 'no license' ELSE license END AS evidence,
           CASE WHEN starts_with(name, '@') THEN split_part(name, '/', 1) || '/' || split_part(split_part(name, '/', -1), '-', 1)
                ELSE split_part(name, '-', 1) END AS fkey
    FROM h0 WHERE v IS NOT NULL),
hw AS (SELECT *, CASE WHEN family = 'unrecognised' THEN 'License `' || lic || '` was not recognised — check it manually before shipping.'
                      ELSE {_WHY_SQL} END AS why,
              count(*) OVER (PARTITION BY repo_id, family, lic, fkey) AS n FROM h)
SELECT repo_id, 'license/' || replace(family, ' ', '-') AS id,
       name || ' ' || version || ' is ' || lic || ' (' || family || ')' AS title, severity, 'licenses' AS scanner,
       first_manifest AS path, 0 AS line, evidence, why AS remediation, 'https://spdx.org/licenses/' AS reference
FROM hw WHERE n < 3
UNION ALL
SELECT repo_id, 'license/' || replace(family, ' ', '-'), n || ' packages are ' || lic || ' (' || family || ')', any_value(severity),
       'licenses', any_value(first_manifest), 0,
       array_to_string(list_slice(list_sort(list(name)), 1, 6), ', ') || CASE WHEN n > 6 THEN ' (+' || (n - 6) || ' more)' ELSE '' END,
       any_value(why) || ' These are variant builds of one dependency — review the obligation once.',
       'https://spdx.org/licenses/'
FROM hw WHERE n >= 3 GROUP BY repo_id, family, lic, fkey, n"""


@register("license_findings", _LIC_FINDINGS_SQL)
def license_findings(spark, sf):
    return L.license_findings(_stand(spark, sf), T.registry_licenses_from_part(spark, sf))


# dependency reachability over per-order chains
EDGES_SQL = """
    SELECT 'order-' || a.l_orderkey AS repo_id, a.l_linenumber AS src, b.l_linenumber AS dst
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE b.l_returnflag <> 'R'
    UNION ALL
    SELECT 'order-' || l_orderkey, max(l_linenumber), 1 FROM lineitem GROUP BY l_orderkey"""


def edges_from_lineitem(spark, sf):
    li = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    a, b = li.alias("a"), li.alias("b")
    chain = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey"))
                   & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)) \
        .filter(F.col("b.l_returnflag") != "R") \
        .select(F.concat(F.lit("order-"), F.col("a.l_orderkey").cast("string")).alias("repo_id"),
                F.col("a.l_linenumber").alias("src"), F.col("b.l_linenumber").alias("dst"))
    back = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("src")).select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"), "src",
        F.lit(1).alias("dst"))
    return chain.unionByName(back)


@register("dependency_reachability", f"""
WITH RECURSIVE e AS ({EDGES_SQL}),
r(repo_id, node) AS (
    SELECT DISTINCT 'order-' || l_orderkey, CAST(1 AS INTEGER) FROM lineitem
    UNION
    SELECT e.repo_id, e.dst FROM r JOIN e ON r.repo_id = e.repo_id AND r.node = e.src)
SELECT repo_id, CAST(node AS INTEGER) AS node FROM r""")
def dependency_reachability(spark, sf):
    roots = T.read(spark, sf, "lineitem").select(
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("repo_id"), F.lit(1).alias("node")).distinct()
    return P.reachable(edges_from_lineitem(spark, sf), roots).select("repo_id", F.col("node").cast("int").alias("node"))


# --------------------------------------------------------------------------
# readiness
# --------------------------------------------------------------------------
from codeaudit.operators import readiness as G  # noqa: E402


def _readiness_flags_sql(files_sql: str) -> str:
    exprs = []
    for i, c in enumerate(G.CHECKS):
        conds = ["false"]
        for f in c.files:
            conds.append(f"(name = {RS.q(f)} OR path = {RS.q(f)} OR list_contains(dirs, {RS.q(f)}))")
        for d in c.dirs:
            conds.append(f"len(list_filter(dirs, lambda x: x = {RS.q(d)} OR ends_with(x, {RS.q('/' + d)}))) > 0")
        for g in c.globs:
            pref, _, suf = g.partition("*")
            conds.append(f"(starts_with(name, {RS.q(pref)}) AND ends_with(name, {RS.q(suf)}))")
        if c.content:
            tg = " OR ".join(f"(path = {RS.q(t)} OR starts_with(path, {RS.q(t + '/')}) OR ends_with(path, {RS.q('/' + t)}) "
                             f"OR name = {RS.q(t)})" for t in c.targets)
            hit = " OR ".join(f"regexp_matches(left(content, {G.CONTENT_LIMIT}), {RS.q(p)})" for p in c.content)
            conds.append(f"(({tg}) AND coalesce({hit}, false))")
        exprs.append(f"bool_or({' OR '.join(conds)}) AS c{i}")
    return f"""
    SELECT repo_id, {', '.join(exprs)} FROM (
        SELECT repo_id, path, split_part(path, '/', -1) AS name, content,
               CASE WHEN len(string_split(path, '/')) > 1
                    THEN list_transform(generate_series(1, len(string_split(path, '/')) - 1),
                                        lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/'))
                    ELSE [] END AS dirs
        FROM ({files_sql})) GROUP BY repo_id"""


def _readiness_checks_sql(files_sql: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT repo_id, {RS.q(c.key)} AS key, {RS.q(c.label)} AS label, {c.weight} AS weight, c{i} AS passed FROM fl"
        for i, c in enumerate(G.CHECKS))
    return f"WITH fl AS ({_readiness_flags_sql(files_sql)}) {rows}"


@register("readiness_score", f"""
    SELECT repo_id, CAST(round_even(100.0 * earned / total, 0) AS BIGINT) AS score, earned, total,
           CASE WHEN round_even(100.0 * earned / total, 0) >= 85 THEN 'Enterprise-ready'
                WHEN round_even(100.0 * earned / total, 0) >= 70 THEN 'Diligence-ready'
                WHEN round_even(100.0 * earned / total, 0) >= 45 THEN 'Early-stage gaps' ELSE 'Pre-security' END AS tier
    FROM (SELECT repo_id, CAST(sum(CASE WHEN passed THEN weight ELSE 0 END) AS BIGINT) AS earned,
                 CAST(sum(weight) AS BIGINT) AS total
          FROM ({_readiness_checks_sql(RS.FILES_FROM_DOCUMENTS)}) GROUP BY repo_id)""")
def readiness_score(spark, sf):
    return G.readiness_scores(T.files_from_documents(spark, sf))


@register("readiness_findings", f"""
    SELECT repo_id, 'readiness/' || key AS id, 'Missing: ' || label AS title,
           CASE WHEN weight >= 6 THEN 'medium' WHEN weight >= 4 THEN 'low' ELSE 'info' END AS severity,
           'readiness' AS scanner, '.' AS path, 0 AS line, {RS.sql_map({c.key: c.why for c in G.CHECKS}, 'key')} AS evidence,
           {RS.sql_map({c.key: c.fix for c in G.CHECKS}, 'key')} AS remediation, '' AS reference
    FROM ({_readiness_checks_sql(RS.FILES_FROM_DOCUMENTS)}) WHERE NOT passed""")
def readiness_findings(spark, sf):
    return G.readiness_findings(T.files_from_documents(spark, sf))


# --------------------------------------------------------------------------
# live surface (H1–H9) and git history
# --------------------------------------------------------------------------
from codeaudit import rules as RR  # noqa: E402
from codeaudit.operators import history as HI  # noqa: E402
from codeaudit.operators import surface as H  # noqa: E402
from codeaudit.sources import commit_log as CL  # noqa: E402

NOW = "2025-01-01T00:00:00Z"  # an absolute instant, whatever the session time zone
_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
_HTTP_SQL = f"""
    SELECT {_HOST} AS host, 'https://' || {_HOST} || '/page/' || page_id AS url, page_id,
           CASE WHEN page_id % 3 = 0 THEN 'max-age=' || (page_id * 100000) || '; includeSubDomains' END AS hsts,
           CASE WHEN page_id % 2 = 0 THEN (CASE WHEN page_id % 4 = 0 THEN 'default-src ''self'' ''unsafe-inline'''
                                                ELSE 'default-src ''self''' END) END AS csp,
           CASE WHEN page_id % 5 <> 0 THEN 'nosniff' END AS xcto,
           CASE WHEN page_id % 6 = 1 THEN 'no-referrer' END AS rp,
           CASE WHEN page_id % 9 = 2 THEN 'camera=()' END AS pp,
           CASE WHEN page_id % 4 = 1 THEN 'DENY' END AS xfo,
           CASE WHEN page_id % 7 = 0 THEN 'nginx/1.' || (page_id % 20) END AS server,
           CASE WHEN page_id % 8 = 3 THEN 'PHP/8.1' END AS xpb,
           CASE WHEN page_id % 11 = 0 THEN '*' END AS acao
    FROM pages"""


def _missing(col, key, sev, title, fix):
    return (f"SELECT host, 'surface/{key}', {RS.q(title)}, '{sev}', url, 'header absent', {RS.q(fix)}, "
            f"'https://owasp.org/www-project-secure-headers/' FROM o WHERE {col} IS NULL")


_HDR_FIX = {"strict-transport-security": ("hsts", "Send Strict-Transport-Security with a long max-age."),
            "content-security-policy": ("csp", "Ship a Content-Security-Policy, report-only first."),
            "x-content-type-options": ("xcto", "Send X-Content-Type-Options: nosniff."),
            "referrer-policy": ("rp", "Send a strict Referrer-Policy."),
            "permissions-policy": ("pp", "Send a Permissions-Policy that disables unused features."),
            "x-frame-options": ("xfo", "Send X-Frame-Options: DENY or CSP frame-ancestors.")}
_SURF_COLS = "repo_id, id, title, severity, scanner, path, line, evidence, remediation, reference"


@register("surface_headers", f"""
WITH o AS ({_HTTP_SQL}),
u(host, id, title, severity, url, evidence, remediation, reference) AS (
    {' UNION ALL '.join(_missing(_HDR_FIX[k][0], k, s, t, _HDR_FIX[k][1]) for k, s, t in RR.REQUIRED_HEADERS)}
    UNION ALL SELECT host, 'surface/hsts-short', 'HSTS max-age below 180 days', 'low', url, hsts,
                     'Raise max-age to a year once HTTPS coverage is complete.', '' FROM o
              WHERE contains(hsts, 'max-age=') AND TRY_CAST(regexp_extract(hsts, 'max-age=([^;]*)', 1) AS BIGINT) < {RR.HSTS_MIN_AGE}
    UNION ALL SELECT host, 'surface/csp-unsafe-inline', 'CSP allows ''unsafe-inline''', 'medium', url, left(csp, 140),
                     'Replace ''unsafe-inline'' with nonces or hashes.', '' FROM o WHERE contains(csp, 'unsafe-inline')
    UNION ALL SELECT host, 'surface/version-disclosure', 'Server version disclosed via `server`', 'low', url, 'server: ' || server,
                     'Strip the `server` header at the proxy.', '' FROM o WHERE trim(server) <> ''
    UNION ALL SELECT host, 'surface/version-disclosure', 'Server version disclosed via `x-powered-by`', 'low', url, 'x-powered-by: ' || xpb,
                     'Strip the `x-powered-by` header at the proxy.', '' FROM o WHERE trim(xpb) <> ''
    UNION ALL SELECT host, 'surface/cors-wildcard', 'Live response sends Access-Control-Allow-Origin: *', 'medium', url, 'ACAO: *',
                     'Restrict to an explicit origin allowlist.', '' FROM o WHERE acao = '*'
    UNION ALL SELECT host, 'surface/cookie-flags', 'Cookie missing secure, httponly, samesite', 'medium', url, 'pref',
                     'Set Secure; HttpOnly; SameSite on session cookies.', 'https://cwe.mitre.org/data/definitions/1004.html'
              FROM o WHERE page_id % 3 = 1)
SELECT host AS repo_id, id, title, severity, 'surface' AS scanner, url AS path, 0 AS line, evidence, remediation, reference FROM u""")
def surface_headers(spark, sf):
    return H.header_findings(T.http_obs_from_pages(spark, sf))


@register("surface_redirect", f"""
    SELECT {_HOST} AS repo_id, 'surface/no-https-redirect' AS id, 'HTTP does not redirect to HTTPS' AS title, 'high' AS severity,
           'surface' AS scanner, 'http://' || {_HOST} AS path, 0 AS line, url AS evidence,
           'Redirect all HTTP traffic to HTTPS at the edge.' AS remediation, '' AS reference
    FROM pages WHERE NOT starts_with(url, 'https://')""")
def surface_redirect(spark, sf):
    return H.redirect_findings(T.plain_http_obs_from_pages(spark, sf))


_PROBES = "[" + ", ".join(f"'{p}'" for p, _s, _t in RR.PROBE_PATHS) + "]"
_ENV_BODY = "'APP_KEY=base64:abc' || chr(10) || 'DB_PASSWORD=x' || chr(10)"


@register("surface_probes", f"""
WITH p AS (
    SELECT {_HOST} AS host, 'https://' || {_HOST} AS base, {_PROBES}[page_id % {len(RR.PROBE_PATHS)} + 1] AS path,
           CASE WHEN page_id % 2 = 0 THEN 200 ELSE 404 END AS status,
           CASE WHEN page_id % 2 <> 0 THEN '' WHEN page_id % 10 = 4 THEN {_ENV_BODY} ELSE html END AS body_text,
           CASE WHEN page_id % 2 <> 0 THEN 0 WHEN page_id % 10 = 4 THEN octet_length(encode({_ENV_BODY}))
                ELSE octet_length(encode(html)) END AS body_len
    FROM pages),
m(path, sev, title) AS (VALUES {', '.join(f"('{p}', '{s}', {RS.q(t)})" for p, s, t in RR.PROBE_PATHS)})
SELECT host AS repo_id, 'surface/no-security-txt' AS id, m.title, 'info' AS severity, 'surface' AS scanner,
       base || p.path AS path, 0 AS line, 'HTTP ' || status AS evidence,
       'Publish /.well-known/security.txt with a contact address.' AS remediation, '' AS reference
FROM p JOIN m USING (path) WHERE ends_with(p.path, 'security.txt') AND NOT (status = 200 AND body_len > 0)
UNION ALL
SELECT host, 'surface/exposed-path', m.title, m.sev, 'surface', base || p.path, 0, 'HTTP 200, ' || body_len || '+ bytes',
       'Block the path at the server/CDN and rotate anything it exposed.', ''
FROM p JOIN m USING (path)
WHERE NOT ends_with(p.path, 'security.txt') AND status = 200 AND body_len > 0
  AND NOT contains(lower(left(body_text, 60)), '<!doctype html')""")
def surface_probes(spark, sf):
    return H.probe_findings(T.probe_obs_from_pages(spark, sf))


@register("surface_tls", f"""
WITH h AS (SELECT {_HOST} AS host, min(page_id) AS k FROM pages GROUP BY 1),
t AS (SELECT host, k, CASE WHEN k % 13 = 5 THEN 'TLSv1.1' ELSE 'TLSv1.3' END AS version,
             DATE '2025-01-01' + CAST(k % 60 - 10 AS INTEGER) AS d,
             CASE WHEN k % 17 = 3 THEN 'certificate verify failed: hostname mismatch' END AS verify_error FROM h),
t2 AS (SELECT *, strftime(d, '%b') || CASE WHEN day(d) < 10 THEN '  ' ELSE ' ' END || day(d) || ' 00:00:00 ' || year(d) || ' GMT'
                 AS not_after,
              CAST(floor((epoch(CAST(d AS TIMESTAMP)) - epoch(TIMESTAMP '2025-01-01 00:00:00')) / 86400) AS BIGINT) AS days FROM t)
SELECT host AS repo_id, 'surface/tls-invalid' AS id, 'TLS certificate does not validate' AS title, 'critical' AS severity,
       'surface' AS scanner, host AS path, 0 AS line, left(verify_error, 140) AS evidence,
       'Fix the chain or hostname, or renew the certificate.' AS remediation, '' AS reference
FROM t2 WHERE verify_error IS NOT NULL
UNION ALL
SELECT host, 'surface/tls-old', 'Negotiated ' || version, 'high', 'surface', host, 0, version,
       'Disable TLS below 1.2 at the load balancer.', '' FROM t2 WHERE verify_error IS NULL AND version IN ('TLSv1', 'TLSv1.1')
UNION ALL
SELECT host, 'surface/cert-expiring', 'TLS certificate expires in ' || days || ' days',
       CASE WHEN days < {RR.CERT_HIGH_DAYS} THEN 'high' ELSE 'medium' END, 'surface', host, 0, not_after,
       'Renew now and automate renewal with expiry alerting.', '' FROM t2 WHERE verify_error IS NULL AND days < {RR.CERT_WARN_DAYS}""")
def surface_tls(spark, sf):
    return H.tls_findings(T.tls_obs_from_pages(spark, sf), NOW)


_LEAKS_SQL = """(SELECT * REPLACE (CASE WHEN conv_id % 7 = 0 AND turn = 0
        THEN text || chr(10) || 'AWS_KEY = "AKIA' || upper(left(sha1(CAST(conv_id // 70 AS VARCHAR)), 16)) || '"' ELSE text END AS text)
    FROM conversations)"""
_COMMIT_LINES_SQL = f"""
    SELECT 'team-' || (conv_id % 5) AS repo_id, conv_id * 1000000 AS seq, 'commit ' || sha1(CAST(conv_id AS VARCHAR)) AS line
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT 'team-' || (conv_id % 5), conv_id * 1000000 + (turn + 1) * 1000, '+++ b/' || role || '/notes.md' FROM conversations
    UNION ALL
    SELECT 'team-' || (conv_id % 5), conv_id * 1000000 + (turn + 1) * 1000 + i, '+' || t
    FROM {_LEAKS_SQL}, LATERAL (SELECT unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i)"""
_ADDS_SQL = f"""
WITH cl AS ({_COMMIT_LINES_SQL}),
ev AS (SELECT *, CASE WHEN starts_with(line, 'commit ') THEN left(trim(substr(line, 8)), 8) END AS _sha,
              CASE WHEN starts_with(line, 'commit ') THEN seq END AS _cseq,
              CASE WHEN starts_with(line, '+++ ') THEN
                        (CASE WHEN trim(substr(line, 5)) = '/dev/null' THEN ''
                              WHEN starts_with(trim(substr(line, 5)), 'b/') THEN substr(trim(substr(line, 5)), 3)
                              ELSE trim(substr(line, 5)) END)
                   WHEN starts_with(line, 'commit ') THEN '' END AS _p FROM cl),
ff AS (SELECT *, last_value(_sha IGNORE NULLS) OVER w AS sha, last_value(_cseq IGNORE NULLS) OVER w AS commit_ord,
              last_value(_p IGNORE NULLS) OVER w AS path
       FROM ev WINDOW w AS (PARTITION BY repo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT repo_id, commit_ord, min(seq) AS first_seq, coalesce(sha, '') AS sha, path,
       string_agg(substr(line, 2), chr(10) ORDER BY seq) AS added
FROM ff WHERE starts_with(line, '+') AND NOT starts_with(line, '+++') AND coalesce(path, '') <> ''
GROUP BY repo_id, commit_ord, sha, path"""


@register("history_commits", f"SELECT repo_id, commit_ord, first_seq, sha, path, added FROM ({_ADDS_SQL})")
def history_commits(spark, sf):
    return HI.commit_adds(T.commit_lines_from_conversations(spark, sf))


@register("history_log_commits", f"SELECT repo_id, sha, path, added FROM ({_ADDS_SQL})")
def history_log_commits(spark, sf):
    """The same history as log files, read commit by commit."""
    return CL.read_commit_log(spark, T.logs_on_disk(spark, T.commit_texts_from_conversations(spark, sf))).select(
        "repo_id", "sha", "path", "added")


def _history_sql() -> str:
    import re as _re
    parts = []
    for i, r in enumerate(RR.SECRET_RULES):
        if r.id == RR.GENERIC_RULE_ID:
            continue
        g = min(1, _re.compile(r.pattern).groups)
        src = "(SELECT repo_id, commit_ord || '|' || sha || '|' || path AS path, added AS content, first_seq, false AS minified, false AS low_trust FROM ad)"
        parts.append(RS._rule_rows_sql(r.id, i, r.pattern, g, src).replace("minified, low_trust,", "first_seq,"))
    union = " UNION ALL ".join(parts)
    sev = RS.sql_map({r.id: r.severity for r in RR.SECRET_RULES}, "rule_id")
    title = RS.sql_map({r.id: r.title for r in RR.SECRET_RULES}, "rule_id")
    hd = RS.sql_map(HI.HISTORY_DOWNGRADE, sev, "'info'")
    exts = ", ".join(f"'{e}'" for e in RR.HISTORY_DOC_EXT)
    return f"""
WITH RECURSIVE ad AS ({_ADDS_SQL}),
rm AS ({union}),
lm AS (SELECT *, start + mlen AS fin, split_part(path, '|', 2) AS sha, array_to_string(string_split(path, '|')[3:], '|') AS fpath,
              row_number() OVER (PARTITION BY repo_id, path ORDER BY start, rule_ord) AS i
       FROM rm WHERE NOT (rule_id = 'openai-key' AND value LIKE 'sk-ant-%')),
walk AS (SELECT repo_id, path, i, fin AS last, true AS keep FROM lm WHERE i = 1
         UNION ALL
         SELECT l.repo_id, l.path, l.i, CASE WHEN l.start >= w.last THEN l.fin ELSE w.last END, l.start >= w.last
         FROM walk w JOIN lm l ON l.repo_id = w.repo_id AND l.path = w.path AND l.i = w.i + 1),
g AS (SELECT lm.* FROM lm JOIN walk USING (repo_id, path, i) WHERE walk.keep
      AND (rule_id = 'private-key' OR NOT {RS.placeholder_sql('value')})),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, rule_id, left(value, 24)
                                                  ORDER BY first_seq, start, rule_ord) AS rn FROM g) WHERE rn = 1),
lt AS (SELECT *, regexp_matches(fpath, {RS.q(RR.TEST_PATH_PATTERN)}) OR split_part(fpath, '.', -1) IN ({exts}) AS low FROM f)
SELECT repo_id, 'git-history/' || rule_id AS id,
       {title} || ' found in git history' || CASE WHEN low THEN ' (test/docs path)' ELSE '' END AS title,
       CASE WHEN low THEN {hd} ELSE {sev} END AS severity, 'git' AS scanner,
       CASE WHEN sha <> '' THEN fpath || ' @ ' || sha ELSE fpath END AS path, 0 AS line, {RS.redact_sql('value')} AS evidence,
       'Deleting the file does not remove it from history: rotate the credential, then purge history.' AS remediation,
       {RS.q(HI.REFERENCE)} AS reference
FROM lt"""


@register("history_findings", _history_sql())
def history_findings(spark, sf):
    return HI.history_findings(T.commit_lines_from_conversations(spark, sf))


# --------------------------------------------------------------------------
# manifests and lockfiles (S5–S15, D7–D10) over the generated manifest files
# --------------------------------------------------------------------------
from codeaudit.sources import manifests as M  # noqa: E402

_LINES_SQL = """
    SELECT 'order-' || l.l_orderkey AS repo_id, l.l_orderkey, replace(p.p_name, ' ', '-') AS name, l.l_linenumber,
           l.l_returnflag, l.l_linestatus, '1.' || l.l_linenumber || '.' || (p.p_size % 10) AS version,
           CASE WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'N' THEN '*'
                WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'A' THEN 'latest'
                WHEN l.l_linestatus = 'O' AND l.l_returnflag = 'R' THEN 'github:acme/' || replace(p.p_name, ' ', '-') || '#main'
                ELSE '^1.' || l.l_linenumber || '.0' END AS spec
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""
_FIRST_SQL = f"""
    SELECT repo_id, l_orderkey, name, min({{'ln': l_linenumber, 'spec': spec, 'dev': l_returnflag = 'R'}}) AS d
    FROM ({_LINES_SQL}) GROUP BY ALL"""


def _mfiles(spark, sf):
    return T.manifest_files_from_orders(spark, sf)


@register("manifest_packages", f"""
    SELECT DISTINCT repo_id, 'package-lock.json' AS manifest, name, version, 'npm' AS eco, bool_and(l_returnflag = 'R') AS dev
    FROM ({_LINES_SQL}) x JOIN orders o ON x.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'
    GROUP BY repo_id, name, version
    UNION ALL
    SELECT DISTINCT repo_id, 'requirements.txt', name, version, 'PyPI', CAST(NULL AS BOOLEAN)
    FROM ({_LINES_SQL}) x JOIN orders o ON x.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O'""")
def manifest_packages(spark, sf):
    return M.lockfile_packages(_mfiles(spark, sf)).distinct()


_FORMAT = lambda field: f"CASE l_orderkey % {len(T.LOCK_FORMATS)} " + " ".join(
    f"WHEN {i} THEN {field(x)}" for i, x in enumerate(T.LOCK_FORMATS)) + " END"


@register("lockfile_formats", f"""
    SELECT repo_id, {_FORMAT(lambda x: f"'{x[0]}'")} AS manifest,
           CASE WHEN l_orderkey % {len(T.LOCK_FORMATS)} = 6 THEN 'git.test/' ELSE '' END || name AS name, version,
           {_FORMAT(lambda x: f"'{x[1]}'")} AS eco,
           {_FORMAT(lambda x: {None: "NULL", "true": "true", "flag": "dev"}[x[2]])} AS dev
    FROM (SELECT repo_id, l_orderkey, name, f['v'] AS version, f['dev'] AS dev
          FROM (SELECT repo_id, l_orderkey, name, min({{'ln': l_linenumber, 'v': version, 'dev': l_returnflag = 'R'}}) AS f
                FROM ({_LINES_SQL}) GROUP BY repo_id, l_orderkey, name))""")
def lockfile_formats(spark, sf):
    """The ten other lockfile formats, one an order."""
    return M.lockfile_packages(T.lock_files_from_orders(spark, sf)).distinct()


_LOCKS = " / ".join(sorted(M.UNRESOLVED_MANIFESTS["package.json"][0]))


@register("unlocked_manifests", f"""
    SELECT f.repo_id, 'deps/unresolved-manifest' AS id,
           'package.json has ' || count(*) || ' declared dependencies but no lockfile — CVE scan skipped for npm' AS title,
           'medium' AS severity, 'deps' AS scanner, 'package.json' AS path, 0 AS line, 'package.json' AS evidence,
           'Commit a lockfile ({_LOCKS}); without resolved versions this ecosystem is unchecked, not clean.' AS remediation,
           'https://cwe.mitre.org/data/definitions/1104.html' AS reference
    FROM ({_FIRST_SQL}) f JOIN orders o ON f.l_orderkey = o.o_orderkey WHERE o.o_orderstatus <> 'F'
    GROUP BY f.repo_id""")
def unlocked_manifests(spark, sf):
    return M.unlocked_manifests(_mfiles(spark, sf))


@register("floating_versions", f"""
    SELECT repo_id,
           CASE WHEN d.spec IN ('*', 'latest') THEN 'deps/floating-version' ELSE 'deps/git-dependency' END AS id,
           CASE WHEN d.spec IN ('*', 'latest')
                THEN name || ' is pinned to "' || d.spec || '" — resolves to whatever is newest at install time'
                ELSE name || ' installs directly from a git ref, bypassing registry integrity checks' END AS title,
           'medium' AS severity, 'deps' AS scanner, 'package.json' AS path, 0 AS line, name || ': ' || d.spec AS evidence,
           CASE WHEN d.spec IN ('*', 'latest') THEN 'Pin a version range and let the lockfile carry reproducibility.'
                ELSE 'Prefer a registry release, or pin an exact commit SHA.' END AS remediation,
           CASE WHEN d.spec IN ('*', 'latest') THEN 'https://cwe.mitre.org/data/definitions/1357.html'
                ELSE 'https://cwe.mitre.org/data/definitions/829.html' END AS reference
    FROM ({_FIRST_SQL}) WHERE d.spec IN ('*', 'latest') OR starts_with(d.spec, 'github:')""")
def floating_versions(spark, sf):
    return M.floating_dependencies(_mfiles(spark, sf))


@register("install_hooks", """
    SELECT 'order-' || o_orderkey AS repo_id, 'deps/install-script-hook' AS id,
           'package.json runs a `postinstall` lifecycle script on install'
             || CASE WHEN o_orderpriority = '1-URGENT' THEN ' — pipes a remote script into a shell' ELSE '' END AS title,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'medium' END AS severity, 'deps' AS scanner,
           'package.json' AS path, 0 AS line,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'curl -fsSL https://get.example.com/i | sh' ELSE 'node scripts/setup.js' END AS evidence,
           'Review lifecycle scripts and run untrusted installs with scripts disabled.' AS remediation,
           'https://cwe.mitre.org/data/definitions/506.html' AS reference
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""")
def install_hooks(spark, sf):
    return M.install_hooks(_mfiles(spark, sf))


@register("declared_names", f"""
    SELECT DISTINCT repo_id, 'npm' AS eco, lower(name) AS lname FROM ({_FIRST_SQL})
    UNION
    SELECT DISTINCT repo_id, 'PyPI', lower(name) FROM ({_LINES_SQL}) x JOIN orders o ON x.l_orderkey = o.o_orderkey
    WHERE o.o_orderstatus = 'O'""")
def declared_names(spark, sf):
    return M.declared_names(_mfiles(spark, sf))


# --------------------------------------------------------------------------
# tree eligibility, ignore rules, diff scope, incremental rescans (S1–S4, F2,
# F6, F9, F12, A12, A13)
# --------------------------------------------------------------------------
from codeaudit.functions.text import is_low_trust, is_minified  # noqa: E402
from codeaudit.plans import scan as PS  # noqa: E402
from codeaudit.sources import tree as TR  # noqa: E402
from codeaudit.sources import tree_reader as TD  # noqa: E402


@register("file_flags", f"""
    SELECT repo_id, path, ext, {RS.low_trust_sql('path', 'ext')} AS low_trust,
           {RS.minified_sql('name', 'content')} AS minified,
           (ext IN ({', '.join(RS.q(e) for e in RR.CODE_EXT)}) OR {' OR '.join(f"starts_with(name, {RS.q(p)})" for p in RR.CONFIG_NAME_PREFIXES)}) AS config_eligible
    FROM ({RS.file_cols_sql(RS.FILES_FROM_DOCUMENTS)})""")
def file_flags(spark, sf):
    f = T.files_from_documents(spark, sf)
    elig = F.col("ext").isin(*RR.CODE_EXT)
    for p in RR.CONFIG_NAME_PREFIXES:
        elig = elig | F.col("name").startswith(p)
    return f.select("repo_id", "path", "ext", is_low_trust(F.col("path"), F.col("name")).alias("low_trust"),
                    is_minified(F.col("name"), F.col("content")).alias("minified"), elig.alias("config_eligible"))


_RAW_SQL = """
    SELECT source AS repo_id,
           CASE doc_id % 8 WHEN 0 THEN 'src/app/doc_' || doc_id || '.py'
                           WHEN 1 THEN 'node_modules/lib' || (doc_id % 3) || '/doc_' || doc_id || '.js'
                           WHEN 2 THEN 'logs/doc_' || doc_id || '.log'
                           WHEN 3 THEN 'docs/guide/doc_' || doc_id || '.md'
                           WHEN 4 THEN 'build/doc_' || doc_id || '.js'
                           WHEN 5 THEN 'tmp/doc_' || doc_id || '.tmp'
                           WHEN 6 THEN 'pkg/cache/doc_' || doc_id || '.txt'
                           ELSE (CASE WHEN doc_id % 16 = 15 THEN 'secrets/doc_' || doc_id || '.pem'
                                      ELSE '.github/workflows/doc_' || doc_id || '.yml' END) END AS path,
           CAST(octet_length(encode(text)) AS BIGINT) AS size
    FROM documents
    UNION ALL SELECT DISTINCT source, '.gitignore', CAST(34 AS BIGINT) FROM documents"""


@register("ignored_files", f"""
    SELECT repo_id, path, split_part(path, '/', -1) AS name,
           lower(regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]+)$', 1)) AS ext, size
    FROM ({_RAW_SQL})
    WHERE NOT (starts_with(path, 'node_modules/') OR starts_with(path, 'build/') OR starts_with(path, 'logs/')
               OR ends_with(path, '.tmp') OR contains(path, '/cache/'))""")
def ignored_files(spark, sf):
    return TR.files_from_raw(T.raw_tree_from_documents(spark, sf)).select("repo_id", "path", "name", "ext", "size")


@register("tree_listing", f"""
    SELECT repo_id, path, name, ext, CASE WHEN path = '.gitignore' THEN 32 ELSE CAST(size AS BIGINT) END AS size
    FROM ({ORACLES['ignored_files']})""")
def tree_listing(spark, sf):
    """The same tree as real files: written under the checkpoint folder and
    listed by the data source, without opening one."""
    return TD.read_tree(spark, T.tree_on_disk(spark, sf), content=False).filter(
        (F.col("size") <= RR.MAX_FILE_BYTES) & ~F.col("ext").isin(*RR.BINARY_EXT)).select("repo_id", "path", "name", "ext", "size")


_FILE_FINDINGS_SQL = f"""
    SELECT {_FCOLS} FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, left(evidence, 60) ORDER BY {_SEV_ORD}) AS rn
        FROM (SELECT * FROM ({RS.secret_findings_sql()}) UNION ALL SELECT * FROM ({RS.config_findings_sql()})))
    WHERE rn = 1"""


@register("incremental_rescan", _FILE_FINDINGS_SQL)
def incremental_rescan(spark, sf):
    enabled = ["secrets", "config"]
    state = PS.initial_state(T.previous_files_from_documents(spark, sf), enabled)
    findings, _state, _hits = PS.incremental_file_findings(T.files_from_documents(spark, sf), state, enabled)
    return findings


@register("rescan_in_place", _FILE_FINDINGS_SQL)
def rescan_in_place(spark, sf):
    """Scan of the previous revision, rescan of this one and a rescan without
    changes, on one state."""
    from codeaudit.plans import rescan as RE
    state = f"{T.checkpoint_dir(spark).rstrip('/')}/state-{uuid.uuid4().hex}"
    now = T.files_from_documents(spark, sf)
    for files in (T.previous_files_from_documents(spark, sf), now, now):
        found = RE.rescan(files, state, ["secrets", "config"])
    return found.findings


@register("scan_stats", """
    SELECT source AS repo_id, CAST(count(*) AS BIGINT) AS files_scanned,
           CAST(count(*) FILTER (WHERE lang <> 'fr') AS BIGINT) AS cache_hits, CAST(0 AS BIGINT) AS packages
    FROM documents GROUP BY source""")
def scan_stats(spark, sf):
    enabled = ["secrets", "config"]
    cur = T.files_from_documents(spark, sf)
    state = PS.initial_state(T.previous_files_from_documents(spark, sf), enabled)
    _f, _s, hits = PS.incremental_file_findings(cur, state, enabled)
    return A.scan_stats(cur, cache_hits=hits)


@register("diff_scope", f"""
    SELECT * FROM ({_FILE_FINDINGS_SQL})
    WHERE CAST(regexp_extract(path, 'doc_(\\d+)\\.', 1) AS BIGINT) IN (SELECT doc_id FROM documents WHERE lang <> 'en')""")
def diff_scope(spark, sf):
    files = T.files_from_documents(spark, sf)
    return PS.file_findings(PS.diff_scope(files, T.changed_files_from_documents(spark, sf)), ["secrets", "config"])


# --------------------------------------------------------------------------
# Structured Streaming (T1–T3): streams run to completion (availableNow);
# the query returns the sink as a batch DataFrame
# --------------------------------------------------------------------------
from codeaudit.streaming import stream as ST  # noqa: E402


def _schema(spark, sf, table):
    return spark.read.parquet(f"{sf.rstrip('/')}/{table}.parquet").schema


@register("stream_secret_findings", f"""
    SELECT {_FCOLS} FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, left(evidence, 60) ORDER BY {_SEV_ORD}) AS rn
        FROM ({RS.secret_findings_sql()})) WHERE rn = 1""")
def stream_secret_findings(spark, sf):
    out = ST.stream_file_findings(spark, sf, "documents.parquet", _schema(spark, sf, "documents"),
                                  T.documents_to_files, ["secrets"])
    from codeaudit.model import FINDING_SCHEMA
    return ST.read_sink(spark, out, FINDING_SCHEMA).select(*FINDING_COLUMNS)


@register("stream_new_findings", f"""
    SELECT f.*, {_FP} AS fingerprint FROM ({EVENTS_FINDINGS}) f
    WHERE NOT EXISTS (SELECT 1 FROM ({_BASELINE_SQL}) b WHERE b.repo_id = f.repo_id AND b.fingerprint = {_FP})""")
def stream_new_findings(spark, sf):
    out = ST.stream_new_findings(spark, sf, "events.parquet", _schema(spark, sf, "events"),
                                 T.events_to_findings, T.baseline_from_labels(spark, sf))
    from codeaudit.model import FINDING_SCHEMA
    from pyspark.sql import types as Ty
    schema = Ty.StructType(list(FINDING_SCHEMA.fields)).add("ord_pos", "long").add("fingerprint", "string")
    return ST.read_sink(spark, out, schema).select(*FINDING_COLUMNS, "ord_pos", "fingerprint")


def _first_seen_sql() -> str:
    import re as _re
    parts = []
    for i, r in enumerate(RR.SECRET_RULES):
        if r.id == RR.GENERIC_RULE_ID:
            continue
        g = min(1, _re.compile(r.pattern).groups)
        rx = RS.q(RS.re2(r.pattern))
        parts.append(f"SELECT repo_id, '{r.id}' AS rule_id, unnest(regexp_extract_all(added, {rx}, {g})) AS value FROM a")
    return f"""
WITH a AS (SELECT 'team-' || (conv_id % 5) AS repo_id, text AS added FROM {_LEAKS_SQL}),
m AS ({' UNION ALL '.join(parts)})
SELECT repo_id, rule_id, left(value, 24) AS v24 FROM m
WHERE value <> '' AND (rule_id = 'private-key' OR NOT {RS.placeholder_sql('value')})"""


@register("stream_first_seen", _first_seen_sql() + " GROUP BY ALL")
def stream_first_seen(spark, sf):
    out = ST.stream_first_seen(spark, sf, "conversations.parquet", _schema(spark, sf, "conversations"),
                               T.conversations_to_adds)
    return ST.read_sink(spark, out, ST.SEEN).select("repo_id", "rule_id", "v24")


@register("stream_first_seen_in_time", _first_seen_sql() + " GROUP BY ALL")
def stream_first_seen_in_time(spark, sf):
    """The same by commit time, with a bounded state: a credential is reported
    anew only after a year without it."""
    out = ST.stream_first_seen(spark, sf, "conversations.parquet", _schema(spark, sf, "conversations"),
                               T.conversations_to_adds, delay="365 days")
    return ST.read_sink(spark, out, ST.SEEN).select("repo_id", "rule_id", "v24")


@register("live_risk", f"""
    WITH f AS ({_FILE_FINDINGS_SQL}),
    per_sev AS (SELECT repo_id, severity, count(*) AS n FROM f GROUP BY ALL),
    per_repo AS (SELECT repo_id, sum({_SEV_W} * (1 + ln(n))) AS raw, min({_SEV_ORD}) AS worst,
                        sum(n) FILTER (severity IN ('critical', 'high')) AS blocking FROM per_sev GROUP BY ALL),
    scored AS (SELECT r.repo_id, CAST(least(100, round_even(coalesce(raw, 0.0), 0)) AS BIGINT) AS risk_score, worst,
                      CAST(coalesce(blocking, 0) AS BIGINT) AS blocking
               FROM (SELECT DISTINCT source AS repo_id FROM documents) r LEFT JOIN per_repo USING (repo_id))
    SELECT repo_id, risk_score,
           greatest(CASE WHEN 100 - risk_score >= 85 THEN 'A' WHEN 100 - risk_score >= 70 THEN 'B'
                         WHEN 100 - risk_score >= 50 THEN 'C' WHEN 100 - risk_score >= 30 THEN 'D' ELSE 'F' END,
                    CASE worst WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END) AS grade,
           blocking > 0 AS failed, blocking
    FROM scored""")
def live_risk(spark, sf):
    """Two revisions of the files as a stream of versions: the first with a
    credential in every tenth file, which the second takes out."""
    from codeaudit.streaming import live as LI
    root = f"{T.checkpoint_dir(spark).rstrip('/')}/live-{uuid.uuid4().hex}"
    now = T.files_from_documents(spark, sf).withColumn("deleted", F.lit(False))
    tenth = F.col("path").rlike("doc_[0-9]*0[.]")
    leak = F.concat(F.col("content"), F.lit('\nK = "AKIA'), F.lit('QZ7X4NPLMR3TVK9D"\n'))
    for rev, files in ((1, now.withColumn("content", F.when(tenth, leak).otherwise(F.col("content")))), (2, now.filter(tenth))):
        files.withColumn("version", F.lit(rev).cast("long")).write.parquet(f"{root}/rev{rev}")
        LI.stream_file_changes(spark, root, f"rev{rev}", spark.read.parquet(f"{root}/rev{rev}").schema, lambda d: d, out=f"{root}/changes/rev{rev}")
        out = LI.stream_live_scores(spark, f"{root}/changes", base=f"{root}/scores")
    return LI.live_scores(spark, out)


# --------------------------------------------------------------------------
# exports (K1–K7) and remediation
# --------------------------------------------------------------------------
def _applied(spark, sf):
    return A.apply_policy(A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS),
                          T.policy_from_events(spark, sf))


_LEVEL = RS.sql_map({"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}, "severity")
_RANK = RS.sql_map({"critical": "9.5", "high": "8.0", "medium": "5.0", "low": "3.0", "info": "1.0"}, "severity")


@register("sarif_results", f"""
    SELECT repo_id, id AS rule_id, {_LEVEL} AS level,
           CASE WHEN coalesce(evidence, '') <> '' THEN title || ' — ' || evidence ELSE title END AS message,
           CASE WHEN coalesce(path, '') <> '' AND NOT starts_with(path, 'http') THEN path ELSE '.' END AS uri,
           CAST(CASE WHEN coalesce(path, '') <> '' AND NOT starts_with(path, 'http') THEN greatest(1, line) ELSE 1 END AS INTEGER) AS start_line,
           {_FP} AS fingerprint
    FROM ({_POLICY_APPLIED_SQL})""")
def sarif_results(spark, sf):
    return X.sarif_results(_applied(spark, sf))


@register("sarif_rules", f"""
    SELECT repo_id, id, replace(id, '/', '_') AS name, left(title, 120) AS short_description,
           CASE WHEN coalesce(remediation, '') <> '' THEN remediation ELSE title END AS full_description,
           coalesce(reference, '') AS help_uri, {_RANK} AS security_severity, {_LEVEL} AS level, scanner
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY {_SEV_ORD}, scanner, path, line, evidence) AS rn
          FROM ({_POLICY_APPLIED_SQL})) WHERE rn = 1""")
def sarif_rules(spark, sf):
    return X.sarif_rules(_applied(spark, sf))


@register("markdown_rows", f"""
    SELECT repo_id, CAST(rank AS INTEGER) AS rank, severity, left(replace(title, '|', '\\|'), 90) AS title,
           CASE WHEN coalesce(path, '') <> '' AND path <> '.'
                THEN '`' || path || CASE WHEN coalesce(line, 0) <> 0 THEN ':' || line ELSE '' END || '`' ELSE '—' END AS location
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_SEV_ORD}, scanner, path, line, id, evidence) AS rank
          FROM ({_POLICY_APPLIED_SQL}) WHERE severity IN ('critical', 'high', 'medium'))
    WHERE rank <= 25""")
def markdown_rows(spark, sf):
    return X.markdown_rows(_applied(spark, sf))


@register("baseline_rows", f"SELECT DISTINCT repo_id, {_FP} AS fingerprint FROM ({_POLICY_APPLIED_SQL})")
def baseline_rows(spark, sf):
    return X.baseline_rows(_applied(spark, sf))


@register("sarif_documents")
def sarif_documents(spark, sf):
    return X.sarif_documents(_applied(spark, sf), T.repos_from_events(spark, sf))


def _parts(spark, sf):
    return f"{T.checkpoint_dir(spark).rstrip('/')}/documents-{uuid.uuid4().hex}"


_SARIF_RESULT = ("ruleId string, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<"
                 "artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>, partialFingerprints map<string,string>")


@register("sarif_parts", ORACLES["sarif_results"])
def sarif_parts(spark, sf):
    """SARIF documents written in parts; their results read back."""
    from codeaudit.plans import documents as D
    path = _parts(spark, sf)
    D.write_sarif(path, _applied(spark, sf), T.repos_from_events(spark, sf))
    at = "x.locations[0].physicalLocation"
    return D.read_elements(spark, path).select("repo_id", F.from_json("json", _SARIF_RESULT).alias("x")).filter("x.ruleId is not null").selectExpr(
        "repo_id", "x.ruleId AS rule_id", "x.level", "x.message.text AS message", f"{at}.artifactLocation.uri AS uri",
        f"{at}.region.startLine AS start_line", "x.partialFingerprints['codeauditFingerprint/v1'] AS fingerprint")


@register("json_report_parts", f"SELECT repo_id, id, severity, path, line, {_FP} AS fingerprint FROM ({_POLICY_APPLIED_SQL})")
def json_report_parts(spark, sf):
    """JSON reports written in parts; their findings read back."""
    from codeaudit.plans import documents as D
    f, repos, path = _applied(spark, sf), T.repos_from_events(spark, sf), _parts(spark, sf)
    D.write_json_reports(path, f, A.risk_scores(f, repos), A.severity_counts(f, repos))
    x = D.read_elements(spark, path).select("repo_id", F.from_json(
        "json", "id string, severity string, path string, line int, fingerprint string").alias("x"))
    return x.filter("x.fingerprint is not null").select("repo_id", "x.*")


@register("cyclonedx_components", f"SELECT repo_id, name, version, type, bom_ref, purl FROM ({ORACLES['sbom_components']})")
def cyclonedx_components(spark, sf):
    """The components of the CycloneDX documents, read back."""
    x = X.cyclonedx_documents(_stand(spark, sf)).select("repo_id", F.explode(F.from_json(
        "document", "components array<struct<type:string,`bom-ref`:string,name:string,version:string,purl:string>>")["components"]).alias("x"))
    return x.select("repo_id", "x.name", "x.version", "x.type", F.col("x.`bom-ref`").alias("bom_ref"), "x.purl")


@register("spdx_elements", f"SELECT repo_id, spdx_id, name, version_info, purl, relationship FROM ({ORACLES['spdx_packages']})")
def spdx_elements(spark, sf):
    """The packages of the SPDX documents with their relationships, read back."""
    kind = ("packages array<struct<SPDXID:string,name:string,versionInfo:string,externalRefs:array<struct<referenceLocator:string>>>>, "
            "relationships array<struct<relationshipType:string,relatedSpdxElement:string>>")
    x = X.spdx_documents(_stand(spark, sf)).select("repo_id", F.from_json("document", kind).alias("d")).select(
        "repo_id", F.explode(F.arrays_zip("d.packages", "d.relationships")).alias("x"))
    return x.filter("x.packages.SPDXID = x.relationships.relatedSpdxElement").selectExpr(
        "repo_id", "x.packages.SPDXID AS spdx_id", "x.packages.name", "x.packages.versionInfo AS version_info",
        "x.packages.externalRefs[0].referenceLocator AS purl", "x.relationships.relationshipType AS relationship")


@register("spdx_documents")
def spdx_documents(spark, sf):
    return X.spdx_documents(_stand(spark, sf))


@register("cyclonedx_documents")
def cyclonedx_documents(spark, sf):
    return X.cyclonedx_documents(_stand(spark, sf))


@register("json_reports")
def json_reports(spark, sf):
    f = _applied(spark, sf)
    repos = T.repos_from_events(spark, sf)
    return X.json_reports(f, A.risk_scores(f, repos), A.severity_counts(f, repos))


@register("markdown_documents")
def markdown_documents(spark, sf):
    f = _applied(spark, sf)
    repos = T.repos_from_events(spark, sf)
    return X.markdown_documents(f, A.risk_scores(f, repos), A.severity_counts(f, repos))


_STEPS = G.MANUAL_STEPS
_MAN = G.MANUAL[:G.MANUAL_SHOWN]


@register("manual_steps", f"""
WITH fl AS (SELECT repo_id,
                   bool_or(starts_with(id, 'secret/') OR starts_with(id, 'git-history/')) AS rotate,
                   bool_or(starts_with(id, 'git-history/')) AS purge,
                   bool_or(id IN ('config/committed-secret-file', 'git/tracked-secret-file')) AS untrack,
                   bool_or(starts_with(id, 'deps/')) AS upgrade
            FROM (SELECT DISTINCT 'repo-' || user_id AS repo_id FROM events) LEFT JOIN ({_POLICY_APPLIED_SQL}) USING (repo_id)
            GROUP BY repo_id)
{' UNION ALL '.join(f"SELECT repo_id, {n} AS step_no, {RS.q(t)} AS step FROM fl WHERE {k}" for n, (k, t) in enumerate(_STEPS))}
UNION ALL {' UNION ALL '.join(f"SELECT repo_id, {len(_STEPS) + n}, {RS.q(m)} FROM fl" for n, m in enumerate(_MAN))}""")
def manual_steps(spark, sf):
    return G.manual_steps(_applied(spark, sf), T.repos_from_events(spark, sf))


_GI = "[" + ", ".join(RS.q(x) for x in G.GITIGNORE_LINES) + "]"


@register("remediation_plan", f"""
    SELECT DISTINCT source AS repo_id, 0 AS fix_no, 'gitignore' AS key, 'add {len(G.GITIGNORE_LINES)} secret patterns to .gitignore' AS description,
           '.gitignore' AS path, {_GI} AS names FROM documents
    UNION ALL SELECT DISTINCT source, 1, 'security-policy', 'create SECURITY.md (vulnerability disclosure policy)', 'SECURITY.md',
           CAST([] AS VARCHAR[]) FROM documents
    UNION ALL SELECT DISTINCT source, 2, 'dep-updates', 'create .github/dependabot.yml (actions)', '.github/dependabot.yml',
           CAST([] AS VARCHAR[]) FROM documents
    UNION ALL SELECT DISTINCT source, 3, 'incident-plan', 'create docs/INCIDENT-RESPONSE.md', 'docs/INCIDENT-RESPONSE.md',
           CAST([] AS VARCHAR[]) FROM documents""")
def remediation_plan(spark, sf):
    return G.remediation_plan(T.files_from_documents(spark, sf))



# --------------------------------------------------------------------------
# repository hygiene
# --------------------------------------------------------------------------
from codeaudit.operators import hygiene as HY  # noqa: E402


def _tree_files(spark, sf):
    raw = T.raw_tree_from_documents(spark, sf)
    return TR.files_from_raw(raw, tracked=T.tracked_from_raw(raw))


_KEPT_SQL = f"""
    SELECT * FROM ({_RAW_SQL})
    WHERE NOT (starts_with(path, 'node_modules/') OR starts_with(path, 'build/') OR starts_with(path, 'logs/')
               OR ends_with(path, '.tmp') OR contains(path, '/cache/'))"""


@register("tracked_secret_files", f"""
    SELECT repo_id, 'git/tracked-secret-file' AS id, 'Certificate/key material committed to the repo (tracked by git)' AS title,
           'high' AS severity, 'git' AS scanner, path, 0 AS line, split_part(path, '/', -1) AS evidence,
           'Untrack it, ignore it, purge it from history and rotate the credentials.' AS remediation, '' AS reference
    FROM ({_KEPT_SQL}) WHERE ends_with(path, '.pem')""")
def tracked_secret_files(spark, sf):
    return HY.tracked_secret_files(_tree_files(spark, sf))


@register("gitignore_findings", f"""
    SELECT repo_id, 'git/gitignore-gap' AS id, '.gitignore does not cover `' || needle || '`' AS title, 'low' AS severity,
           'git' AS scanner, '.gitignore' AS path, 0 AS line, needle AS evidence, 'Add `' || needle || '` to .gitignore.' AS remediation,
           '' AS reference
    FROM (SELECT DISTINCT repo_id, '.env' AS needle FROM ({_KEPT_SQL})
          UNION SELECT DISTINCT repo_id, '*.pem' FROM ({_KEPT_SQL}) WHERE ends_with(path, '.pem'))""")
def gitignore_findings(spark, sf):
    return HY.gitignore_findings(_tree_files(spark, sf))


@register("remote_credentials", f"""
    SELECT host AS repo_id, 'git/remote-credentials' AS id, 'Git remote URL embeds credentials' AS title, 'high' AS severity,
           'git' AS scanner, '.git/config' AS path, 0 AS line,
           left(u, 12) || repeat('*', least(12, length(u) - 24)) || right(u, 12) AS evidence,
           'Use SSH or a credential helper; the token sits in plaintext in .git/config.' AS remediation, '' AS reference
    FROM (SELECT host, 'https://ci-bot:ghs' || sha1(host) || '@' || host || '/app.git' AS u
          FROM (SELECT {_HOST} AS host, min(page_id) AS k FROM pages GROUP BY 1) WHERE k % 9 = 0)""")
def remote_credentials(spark, sf):
    return HY.remote_credentials(T.repos_from_pages(spark, sf))


# --------------------------------------------------------------------------
# policy files
# --------------------------------------------------------------------------
from codeaudit.sources import config_files as CF  # noqa: E402


@register("policy_validation", """
    SELECT DISTINCT 'repo-' || user_id AS repo_id, '.codeaudit-policy.json' AS path,
           CASE user_id % 9 WHEN 4 THEN 'policy fail_on must be one of [''critical'', ''high'', ''info'', ''low'', ''medium''] or ''never'''
                            WHEN 5 THEN 'policy ''ignore_paths'' must be a list of strings'
                            ELSE 'policy file is not valid JSON' END AS error
    FROM events WHERE user_id % 9 IN (4, 5, 6)""")
def policy_validation(spark, sf):
    _good, errors = CF.validate_policies(T.policy_files_from_events(spark, sf))
    return errors


@register("policy_from_files", f"""
    SELECT f.repo_id, f.id, f.title,
           CASE WHEN f.id = 'config/view' AND p.repo_id IS NOT NULL THEN 'high' ELSE f.severity END AS severity,
           f.scanner, f.path, f.line, f.evidence, f.remediation, f.reference
    FROM ({_DEDUPED_SQL}) f LEFT JOIN (SELECT * FROM ({_POLICY_SQL}) WHERE CAST(substr(repo_id, 6) AS BIGINT) % 9 NOT IN (4, 5, 6)) p USING (repo_id)
    WHERE NOT (p.repo_id IS NOT NULL AND f.id = 'deps/signup')
      AND NOT (coalesce(f.path, '') <> '' AND p.ignore_glob IS NOT NULL
               AND regexp_full_match(f.path, replace(replace(p.ignore_glob, '.', '\\.'), '*', '.*')))""")
def policy_from_files(spark, sf):
    good, _errors = CF.validate_policies(T.policy_files_from_events(spark, sf))
    f = A.dedupe(T.findings_from_events(spark, sf)).select(*FINDING_COLUMNS)
    return A.apply_policy(f, good)


@register("registry_licenses", f"""
    SELECT eco, name, version, CASE WHEN eco IN ('npm', 'PyPI') THEN license END AS license FROM ({REGISTRY_SQL})""")
def registry_licenses(spark, sf):
    return T.registry_licenses_from_part(spark, sf)


_MARKERS = " ".join(f"WHEN contains(lower(head), {RS.q(m.lower())}) THEN {RS.q(sp)}" for m, sp in RR.PROJECT_LICENSE_MARKERS)


@register("project_license", f"""
    SELECT repo_id, CASE WHEN spdx <> '' THEN spdx {_MARKERS} ELSE 'custom' END AS license
    FROM (SELECT source AS repo_id, left(arg_min(text, doc_id), 2000) AS head,
                 regexp_extract(left(arg_min(text, doc_id), 2000), {RS.q(RR.PROJECT_LICENSE_SPDX_PATTERN)}, 1) AS spdx
          FROM documents WHERE contains(text, 'icense') OR contains(text, 'rights reserved') GROUP BY source)""")
def project_license(spark, sf):
    return L.project_license(T.license_files_from_documents(spark, sf))


@register("package_stats", f"""
WITH v AS ({_VULN_SQL}),
pk AS (SELECT repo_id, count(DISTINCT (name, version, eco)) AS packages, count(DISTINCT manifest) AS manifests
       FROM ({PACKAGES_SQL}) GROUP BY repo_id),
dv AS (SELECT repo_id, count(*) AS dev_only_packages FROM ({_DEV_ONLY}) GROUP BY repo_id),
vf AS (SELECT repo_id, count(DISTINCT evidence) AS vulnerable_packages FROM v GROUP BY repo_id)
SELECT pk.repo_id, CAST(pk.packages AS BIGINT) AS packages, CAST(coalesce(dv.dev_only_packages, 0) AS BIGINT) AS dev_only_packages,
       CAST(pk.manifests AS BIGINT) AS manifests, CAST(coalesce(vf.vulnerable_packages, 0) AS BIGINT) AS vulnerable_packages
FROM pk LEFT JOIN dv USING (repo_id) LEFT JOIN vf USING (repo_id)""")
def package_stats(spark, sf):
    return V.package_stats(_stand(spark, sf), T.advisories_from_part(spark, sf))


@register("license_classify", f"""
    SELECT license, split_part(v, '|', 1) AS severity, split_part(v, '|', 2) AS family
    FROM (SELECT DISTINCT license, {_classify_sql('license')} AS v
          FROM ({REGISTRY_SQL}) WHERE eco IN ('npm', 'PyPI'))
    WHERE v IS NOT NULL""")
def license_classify(spark, sf):
    reg = T.registry_licenses_from_part(spark, sf).filter(F.col("eco").isin("npm", "PyPI"))
    v = reg.select("license").distinct().withColumn("v", L.classify(F.col("license"))).filter(F.col("v").isNotNull())
    return v.select("license", F.col("v.severity").alias("severity"), F.col("v.family").alias("family"))


_CURL = next(r for r in RR.CONFIG_RULES if r.id == "curl-pipe-shell")


@register("file_findings_manifests", f"""
    SELECT 'order-' || o_orderkey AS repo_id, 'config/curl-pipe-shell' AS id, {RS.q(_CURL.title)} AS title,
           'high' AS severity, 'config' AS scanner, 'package.json' AS path, 1 AS line,
           'curl -fsSL https://get.example.com/i | sh' AS evidence, {RS.q(_CURL.remediation)} AS remediation,
           {RS.q(RR.CONFIG_REFERENCE['curl-pipe-shell'])} AS reference
    FROM orders WHERE o_orderpriority = '1-URGENT'
      AND o_orderkey IN (SELECT l_orderkey FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)""")
def file_findings_manifests(spark, sf):
    """The fused secret + config pass over the generated manifest files."""
    return PS.file_findings(_mfiles(spark, sf), ["secrets", "config"])


_RAW_CONTENT_SQL = """
    SELECT source AS repo_id,
           CASE doc_id % 8 WHEN 0 THEN 'src/app/doc_' || doc_id || '.py'
                           WHEN 1 THEN 'node_modules/lib' || (doc_id % 3) || '/doc_' || doc_id || '.js'
                           WHEN 2 THEN 'logs/doc_' || doc_id || '.log'
                           WHEN 3 THEN 'docs/guide/doc_' || doc_id || '.md'
                           WHEN 4 THEN 'build/doc_' || doc_id || '.js'
                           WHEN 5 THEN 'tmp/doc_' || doc_id || '.tmp'
                           WHEN 6 THEN 'pkg/cache/doc_' || doc_id || '.txt'
                           ELSE (CASE WHEN doc_id % 16 = 15 THEN 'secrets/doc_' || doc_id || '.pem'
                                      ELSE '.github/workflows/doc_' || doc_id || '.yml' END) END AS path,
           text AS content
    FROM documents
    UNION ALL SELECT DISTINCT source, '.gitignore', '# c' || chr(10) || 'logs/' || chr(10) || '*.tmp' || chr(10)
                                   || '!keep.log' || chr(10) || 'cache' || chr(10) FROM documents"""
_KEPT_CONTENT_SQL = f"""
    SELECT * FROM ({_RAW_CONTENT_SQL})
    WHERE NOT (starts_with(path, 'node_modules/') OR starts_with(path, 'build/') OR starts_with(path, 'logs/')
               OR ends_with(path, '.tmp') OR contains(path, '/cache/'))"""


@register("tree_scan", f"""
    SELECT {_FCOLS} FROM (
        SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, left(evidence, 60) ORDER BY {_SEV_ORD}) AS rn
        FROM (SELECT * FROM ({RS.secret_findings_sql(_KEPT_CONTENT_SQL)})
              UNION ALL SELECT * FROM ({RS.config_findings_sql(_KEPT_CONTENT_SQL)})))
    WHERE rn = 1""")
def tree_scan(spark, sf):
    """Raw tree → ignore rules, eligibility, decoding → the fused file scan."""
    return PS.file_findings(_tree_files(spark, sf), ["secrets", "config"])


@register("tree_disk_scan", ORACLES["tree_scan"])
def tree_disk_scan(spark, sf):
    """Real files → the data source (ignored directories are never entered) →
    the fused file scan."""
    return PS.file_findings(TR.files_from_trees(spark, T.tree_on_disk(spark, sf)), ["secrets", "config"])


@register("pipeline_scores", f"""
WITH f AS (
    SELECT repo_id, severity, scanner FROM ({_FILE_FINDINGS_SQL})
    UNION ALL SELECT DISTINCT source, 'medium', 'git' FROM documents
    UNION ALL SELECT repo_id, severity, 'readiness' FROM (
        SELECT repo_id, CASE WHEN weight >= 6 THEN 'medium' WHEN weight >= 4 THEN 'low' ELSE 'info' END AS severity
        FROM ({_readiness_checks_sql(RS.FILES_FROM_DOCUMENTS)}) WHERE NOT passed)),
per_sev AS (SELECT repo_id, severity, count(*) AS n FROM f WHERE scanner <> 'readiness' GROUP BY ALL),
per_repo AS (SELECT repo_id, sum({_SEV_W} * (1 + ln(n))) AS raw, min({_SEV_ORD}) AS worst FROM per_sev GROUP BY ALL),
repos AS (SELECT DISTINCT source AS repo_id FROM documents),
scored AS (SELECT r.repo_id, CAST(least(100, round_even(coalesce(p.raw, 0.0), 0)) AS BIGINT) AS risk_score, p.worst
           FROM repos r LEFT JOIN per_repo p USING (repo_id))
SELECT repo_id, risk_score,
       greatest(CASE WHEN 100 - risk_score >= 85 THEN 'A' WHEN 100 - risk_score >= 70 THEN 'B'
                     WHEN 100 - risk_score >= 50 THEN 'C' WHEN 100 - risk_score >= 30 THEN 'D' ELSE 'F' END,
                CASE worst WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'B' ELSE 'A' END) AS grade
FROM scored""")
def pipeline_scores(spark, sf):
    """The scan pipeline end to end (file detectors, git hygiene, readiness)
    → risk and grade per repository."""
    files = T.files_from_documents(spark, sf)
    return PS.scan(files, enabled=["secrets", "config", "git", "readiness"]).scores


# --------------------------------------------------------------------------
# planted rule hits: expectations from row keys alone
# --------------------------------------------------------------------------
from codeaudit.sources import planted as PL  # noqa: E402


def _planted_case(samples, field: int, doc_id: str = "doc_id") -> str:
    values = "[" + ", ".join(RS.q(s[field]) for s in samples) + "]"
    return f"replace({values}[{doc_id} % {len(samples)} + 1], '{{d}}', {doc_id}::varchar)"


@register("planted_rule_hits", f"""
    SELECT source AS repo_id, {_planted_case(PL.SAMPLES, 1)} AS path, {_planted_case(PL.SAMPLES, 0)} AS id,
           CAST({PL.LINE} AS INTEGER) AS line
    FROM documents""")
def planted_rule_hits(spark, sf):
    """Every rule of the file detectors on files derived from every document:
    each must find its own sample at its line, and leave the calm twin alone."""
    f = PL.planted_files(T.read(spark, sf, "documents"))
    found = PS.file_findings(f.drop("planted", "hit"), ["secrets", "config"])
    return found.join(f.select("repo_id", "path", F.col("planted").alias("id")), ["repo_id", "path", "id"], "left_semi").select(
        "repo_id", "path", "id", "line")


@register("planted_history_hits", f"""
    SELECT source AS repo_id, 'git-history/' || split_part({_planted_case(PL.COMMIT_SAMPLES, 0)}, '/', 2) AS id,
           'src/h_' || doc_id || '.py @ ' || left(sha256(doc_id::varchar), 8) AS path, 'git' AS scanner
    FROM documents""")
def planted_history_hits(spark, sf):
    """A credential added in a commit of every document."""
    return HI.history_findings(PL.planted_commits(T.read(spark, sf, "documents"))).select("repo_id", "id", "path", "scanner")


@register("planted_log_hits", ORACLES["planted_history_hits"])
def planted_log_hits(spark, sf):
    """The same commits as log files."""
    lines = PL.planted_commits(T.read(spark, sf, "documents"))
    commits = lines.groupBy("repo_id", F.floor(F.col("seq") / 4).alias("seq")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct(F.col("seq").alias("s"), "line"))), lambda x: x["line"]), "\n").alias("text"))
    return HI.findings_from_adds(CL.read_commit_log(spark, T.logs_on_disk(spark, commits))).select("repo_id", "id", "path", "scanner")


_BUILD_IDS = ["config/docker-root-user", "config/docker-no-healthcheck", "config/ci-unpinned-action"]


@register("planted_builds", """
    SELECT source AS repo_id, 'config/docker-root-user' AS id, 'medium' AS severity, 'Container runs as root' AS title,
           'svc_' || doc_id || '/Dockerfile' AS path FROM documents WHERE doc_id % 4 IN (0, 2)
    UNION ALL SELECT source, 'config/docker-no-healthcheck', 'info', 'No container HEALTHCHECK', 'svc_' || doc_id || '/Dockerfile'
    FROM documents WHERE doc_id % 4 IN (0, 3)
    UNION ALL SELECT source, 'config/ci-unpinned-action', CASE doc_id % 3 WHEN 0 THEN 'low' ELSE 'medium' END,
           CASE doc_id % 3 WHEN 0 THEN 'First-party action actions' ELSE 'Third-party action acme' END || '/a' || doc_id
             || ' pinned to the mutable tag `v2`', '.github/workflows/p_' || doc_id || '.yml'
    FROM documents WHERE doc_id % 3 < 2""")
def planted_builds(spark, sf):
    """Dockerfile structure and action pins on a file of each a document."""
    f = C.config_findings(PL.planted_builds(T.read(spark, sf, "documents")))
    return f.filter(F.col("id").isin(_BUILD_IDS)).select("repo_id", "id", "severity", "title", "path")


@register("planted_rule_rows", f"""
    SELECT source AS repo_id, {_planted_case(PL.SAMPLES, 0)} AS id, {_planted_case(PL.SAMPLES, 1)} AS path,
           ({RS.sql_map({**{f"secret/{r.id}": r.severity for r in RR.SECRET_RULES}, **{f"config/{r.id}": r.severity for r in RR.CONFIG_RULES}},
                        _planted_case(PL.SAMPLES, 0))}) AS severity,
           CASE WHEN starts_with({_planted_case(PL.SAMPLES, 0)}, 'secret/') THEN 'secrets' ELSE 'config' END AS scanner
    FROM documents""")
def planted_rule_rows(spark, sf):
    """The same files' findings with severity and scanner."""
    f = PL.planted_files(T.read(spark, sf, "documents"))
    found = PS.file_findings(f.drop("planted", "hit"), ["secrets", "config"])
    return found.join(f.select("repo_id", "path", F.col("planted").alias("id")), ["repo_id", "path", "id"], "left_semi").select(
        "repo_id", "id", "path", "severity", "scanner")
