"""Independent DuckDB formulations of the queries (the correctness oracles).

DuckDB's regex engine is RE2: no lookarounds, ASCII ``\\b``, and ``(?U)`` means
"ungreedy".  Patterns therefore drop our ``(?dU)`` prefix, and the single
lookahead among the secret rules is replaced by a post-filter.  The SQL uses
DuckDB list lambdas (``lambda x, i: …``) for per-match prefix sums.
"""

from __future__ import annotations

from codeaudit import rules as R
from codeaudit.model import DOWNGRADE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(d: dict, key: str, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in d.items())
    return f"(CASE {key} {whens} ELSE {default} END)"


FILES_FROM_DOCUMENTS = """
    SELECT source AS repo_id,
           CASE doc_id % 5 WHEN 0 THEN 'app/doc_' || doc_id || '.py'
                           WHEN 1 THEN 'deploy/doc_' || doc_id || '.yml'
                           WHEN 2 THEN 'notes/doc_' || doc_id || '.md'
                           WHEN 3 THEN 'config/doc_' || doc_id || '.json'
                           ELSE 'tests/doc_' || doc_id || '.py' END AS path,
           text AS content
    FROM documents"""


FILES_FROM_PAGES = """
    SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS repo_id,
           'web/page_' || page_id || '.vue' AS path, html AS content
    FROM pages"""


def file_cols_sql(src: str) -> str:
    return f"""
    SELECT repo_id, path, regexp_extract(path, '[^/]*$') AS name,
           lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext,
           octet_length(encode(content)) AS size, content
    FROM ({src})"""


def minified_sql(name: str, content: str) -> str:
    lens = f"list_transform(list_slice(string_split({content}, chr(10)), 1, {R.MINIFIED_LINES}), lambda x: length(x))"
    return (f"(regexp_matches({name}, {q(R.MINIFIED_NAME_PATTERN)}) OR "
            f"coalesce(length({content}) >= {R.MINIFIED_MIN_CHARS} AND list_max({lens}) > {R.MINIFIED_LINE_LEN} "
            f"AND list_sum({lens}) / len({lens}) > {R.MINIFIED_AVG_LEN}, false))")


def low_trust_sql(path: str, ext: str) -> str:
    exts = ", ".join(q(e) for e in R.DOC_EXT)
    return f"(regexp_matches({path}, {q(R.TEST_PATH_PATTERN)}) OR {ext} IN ({exts}))"


def placeholder_sql(v: str) -> str:
    t = f"trim({v})"
    return (f"(length({t}) < 8 OR regexp_matches({t}, {q(R.PLACEHOLDER_PATTERN)}) "
            f"OR regexp_matches({t}, {q(R.WEAK_PLACEHOLDER_PATTERN)}) "
            f"OR len(list_distinct(string_split({t}, ''))) <= 3)")


def entropy_sql(v: str) -> str:
    return (f"(SELECT coalesce(-sum(p * log2(p)), 0.0) FROM (SELECT count(*) / length({v}) AS p "
            f"FROM unnest(string_split({v}, '')) AS _t(_c) GROUP BY _c))")


def redact_sql(v: str, keep: int = 4) -> str:
    s = f"trim({v})"
    return (f"(CASE WHEN length({s}) <= {2 * keep} THEN repeat('*', length({s})) "
            f"ELSE left({s}, {keep}) || repeat('*', least(12, length({s}) - {2 * keep})) || right({s}, {keep}) END)")


def re2(p: str) -> str:
    return p.replace("(?!ant-)", "")


def _rule_rows_sql(rule_id: str, ordv: int, rx: str, group: int, src: str) -> str:
    rxq = q(re2(rx))
    nl = "lambda x: length(x) - length(replace(x, chr(10), ''))"
    ln = "lambda x: length(x)"
    val = (f"CASE WHEN regexp_extract(ms[i], {rxq}, {group}) = '' THEN ms[i] "
           f"ELSE regexp_extract(ms[i], {rxq}, {group}) END") if group else "ms[i]"
    return f"""
    SELECT repo_id, path, minified, low_trust, {q(rule_id)} AS rule_id, {ordv} AS rule_ord, ms[i] AS match, {val} AS value,
           list_sum(list_transform(list_slice(gs, 1, i), {ln}))
             + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), {ln})), 0) AS start,
           1 + list_sum(list_transform(list_slice(gs, 1, i), {nl}))
             + coalesce(list_sum(list_transform(list_slice(ms, 1, i - 1), {nl})), 0) AS line,
           length(ms[i]) AS mlen,
           length(ms[i]) - length(replace(ms[i], chr(10), '')) AS mnl
    FROM (SELECT *, regexp_extract_all(content, {rxq}, 0) AS ms, regexp_split_to_array(content, {rxq}) AS gs
          FROM {src} WHERE regexp_matches(content, {rxq})) AS _m,
         LATERAL (SELECT unnest(generate_series(1, len(ms))) AS i) AS _i"""


def secret_matches_sql(files_sql: str = FILES_FROM_DOCUMENTS) -> str:
    """CTE body list producing ``sm`` (gated secret matches with entropy)."""
    import re
    parts = []
    for i, r in enumerate(R.SECRET_RULES):
        g = min(1, re.compile(r.pattern).groups)
        parts.append(_rule_rows_sql(r.id, i, r.pattern, g, "ef"))
    union = "\n    UNION ALL".join(parts)
    ent = {r.id: r.entropy for r in R.SECRET_RULES}
    return f"""
ef AS (
    SELECT repo_id, path, content, {minified_sql('name', 'content')} AS minified,
           ({low_trust_sql('path', 'ext')} OR name = '.env.example') AS low_trust
    FROM ({file_cols_sql(files_sql)}) WHERE size <= {R.MAX_FILE_BYTES} AND length(content) > 0
),
rm AS ({union}
),
rm2 AS (
    SELECT *, start + mlen AS "end", line + mnl AS end_line FROM rm
    WHERE NOT (rule_id = 'openai-key' AND value LIKE 'sk-ant-%')
),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY start, rule_ord) AS i FROM rm2
    WHERE rule_id <> 'generic-secret' OR NOT minified
),
walk AS (
    SELECT repo_id, path, i, "end" AS a, CASE WHEN rule_id <> 'generic-secret' THEN "end" ELSE 0 END AS s, true AS keep
    FROM ordered WHERE i = 1
    UNION ALL
    SELECT o.repo_id, o.path, o.i, CASE WHEN o.start >= w.a THEN o."end" ELSE w.a END,
           CASE WHEN o.rule_id <> 'generic-secret' AND o.start >= w.s THEN o."end" ELSE w.s END,
           o.start >= w.a OR (o.rule_id <> 'generic-secret' AND o.start >= w.s)
    FROM walk w JOIN ordered o ON o.repo_id = w.repo_id AND o.path = w.path AND o.i = w.i + 1
),
cand AS (
    SELECT o.repo_id, o.path, o.minified, o.low_trust, o.rule_id, o.rule_ord, o.match, o.value, o.start, o.line, o."end"
    FROM ordered o JOIN walk w USING (repo_id, path, i) WHERE w.keep
),
sm AS (
    SELECT *, {entropy_sql('value')} AS entropy, {sql_map(ent, 'rule_id', '0.0')} AS floor_ FROM cand
)"""


def reported_sql() -> str:
    """CTE ``rep``: gated matches, without generic ones whose value a gated
    provider match overlaps (positions found by plain string search)."""
    return f"""gated AS (
    SELECT *, "end" - instr(reverse(match), reverse(value)) + 1 AS vend FROM sm
    WHERE (rule_id = 'private-key' OR NOT {placeholder_sql('value')}) AND (floor_ <= 0 OR entropy >= floor_)
),
rep AS (
    SELECT * FROM gated g WHERE rule_id <> 'generic-secret' OR NOT EXISTS (
        SELECT 1 FROM gated p WHERE p.rule_id <> 'generic-secret' AND p.repo_id = g.repo_id AND p.path = g.path
          AND p.start < g.vend AND p."end" > g.vend - length(g.value))
)"""


def secret_findings_sql(files_sql: str = FILES_FROM_DOCUMENTS) -> str:
    sev = sql_map({r.id: r.severity for r in R.SECRET_RULES}, "rule_id")
    title = sql_map({r.id: r.title for r in R.SECRET_RULES}, "rule_id")
    rem = sql_map({r.id: r.remediation for r in R.SECRET_RULES}, "rule_id")
    down = sql_map(DOWNGRADE, sev, sev)
    return f"""WITH RECURSIVE {secret_matches_sql(files_sql)},
{reported_sql()}
SELECT repo_id, 'secret/' || rule_id AS id,
       CASE WHEN low_trust THEN {title} || ' (in test/docs path)' ELSE {title} END AS title,
       CASE WHEN low_trust THEN {down} ELSE {sev} END AS severity,
       'secrets' AS scanner, path, CAST(line AS INTEGER) AS line, {redact_sql('value')} AS evidence,
       {rem} AS remediation, {q(R.SECRET_REFERENCE)} AS reference
FROM rep"""


def _re2_config(p: str) -> str:
    """RE2 form of a config pattern: lookaheads become supersets (dropped)."""
    p = p.replace("(?!['\\\"`])", "")
    p = p.replace("(?!.*Loader\\s*=\\s*(?:yaml\\.)?SafeLoader)", "")
    p = p.replace("(?:(?!max_tokens|maxOutputTokens|max_output_tokens|max_completion_tokens)[\\s\\S]){0,300}",
                  "[\\s\\S]{0,300}")
    return p


def config_findings_sql(files_sql: str = FILES_FROM_DOCUMENTS) -> str:
    from codeaudit.functions.text import glob_to_regex
    code_ext = ", ".join(q(e) for e in R.CODE_EXT)
    code_ids = set(R.CODE_RULE_IDS)
    prefixes = " OR ".join(f"starts_with(name, {q(p)})" for p in R.CONFIG_NAME_PREFIXES)
    parts = []
    for i, r in enumerate(R.CONFIG_RULES):
        if r.glob == "*":
            ap = "true"
        elif "/" in r.glob:
            ap = (f"(regexp_matches(path, {q(glob_to_regex(r.glob))}) OR "
                  f"regexp_matches(path, {q(glob_to_regex('*/' + r.glob))}))")
        else:
            ap = f"regexp_matches(name, {q(glob_to_regex(r.glob))})"
        if r.id in code_ids:
            ap = f"({ap} AND ext IN ({code_ext}))"
        src = f"(SELECT * FROM cf WHERE scanned AND {ap})"
        parts.append(_rule_rows_sql(r.id, i, _re2_config(r.pattern), 0, src)
                     .replace("minified, low_trust,", "name, tracked, low_trust, scanned,"))
    union = "\n    UNION ALL".join(parts)
    danger_case = " ".join(
        f"WHEN {('regexp_matches(name, ' + q(glob_to_regex(p)) + ')') if '*' in p else ('name = ' + q(p))} THEN {i}"
        for i, (p, _s, _w) in enumerate(R.DANGEROUS_FILES))
    exempt = " OR ".join(f"contains(name, {q(w)})" for w in R.EXEMPT_NAME_WORDS)
    d_sev = "[" + ", ".join(q(s) for _, s, _ in R.DANGEROUS_FILES) + "]"
    d_why = "[" + ", ".join(q(w) for _, _, w in R.DANGEROUS_FILES) + "]"
    title = sql_map({r.id: r.title for r in R.CONFIG_RULES}, "rule_id")
    sev = sql_map({r.id: r.severity for r in R.CONFIG_RULES}, "rule_id")
    rem = sql_map({r.id: r.remediation for r in R.CONFIG_RULES}, "rule_id")
    ref = sql_map(R.CONFIG_REFERENCE, "rule_id", "''")
    pin = R.ACTION_USES_PATTERN
    fp = ", ".join(q(o) for o in R.FIRST_PARTY_ACTION_ORGS)
    pin_found = f"regexp_matches(match, {q(pin)})"
    org = f"regexp_extract(match, {q(pin)}, 1)"
    pin_title = (f"CASE WHEN NOT {pin_found} THEN 'GitHub Action pinned to a mutable ref' ELSE "
                 f"(CASE WHEN lower({org}) IN ({fp}) THEN 'First-party' ELSE 'Third-party' END) || ' action ' || "
                 f"{org} || '/' || regexp_extract(match, {q(pin)}, 2) || ' pinned to the mutable tag `' || "
                 f"regexp_extract(match, {q(pin)}, 3) || '`' END")
    pin_sev = f"CASE WHEN NOT {pin_found} THEN 'medium' WHEN lower({org}) IN ({fp}) THEN 'low' ELSE 'medium' END"
    down = lambda s: sql_map(DOWNGRADE, s, s)
    return f"""WITH cf0 AS ({file_cols_sql(files_sql)}),
cf AS (
    SELECT repo_id, path, name, ext, CAST(true AS BOOLEAN) AS tracked, content,
           (ext IN ({code_ext}) OR {prefixes}) AND coalesce(length(content) > 0, false) AND size <= {R.MAX_FILE_BYTES}
             AND NOT {minified_sql('name', 'content')} AS scanned,
           {low_trust_sql('path', 'ext')} AS low_trust,
           CASE WHEN NOT ({exempt}) THEN (CASE {danger_case} ELSE NULL END) END AS didx
    FROM cf0),
pm AS ({union}
),
pat AS (
    SELECT repo_id, 'config/' || rule_id AS id,
           CASE WHEN rule_id = 'ci-unpinned-action' THEN {pin_title} ELSE {title} END AS title,
           CASE WHEN rule_id = 'ci-unpinned-action' THEN {pin_sev} ELSE {sev} END AS severity,
           path, CAST(line AS INTEGER) AS line, left(trim(match), 160) AS evidence,
           {rem} AS remediation, {ref} AS reference, scanned, low_trust
    FROM pm),
dng AS (
    SELECT repo_id,
           CASE WHEN tracked IS NOT NULL AND NOT tracked THEN 'config/untracked-secret-file' ELSE 'config/committed-secret-file' END AS id,
           CASE WHEN tracked IS NOT NULL AND NOT tracked
                THEN '`' || name || '` is present and not ignored — one `git add` from being committed'
                ELSE {d_why}[didx + 1] END AS title,
           CASE WHEN tracked IS NOT NULL AND NOT tracked THEN {sql_map(DOWNGRADE, d_sev + '[didx + 1]', "'low'")}
                ELSE {d_sev}[didx + 1] END AS severity,
           path, 0 AS line, name AS evidence,
           CASE WHEN tracked IS NOT NULL AND NOT tracked
                THEN 'Add `' || name || '` to .gitignore; it is not in git yet, so nothing needs rotating.'
                ELSE 'Ignore it, remove it from the index, purge history and rotate its contents.' END AS remediation,
           'https://cwe.mitre.org/data/definitions/540.html' AS reference, scanned, low_trust
    FROM cf WHERE didx IS NOT NULL),
dk AS (
    SELECT *, regexp_extract_all(content, {q(R.DOCKER_USER_PATTERN)}, 1) AS users FROM cf
    WHERE scanned AND starts_with(name, 'Dockerfile')),
dock AS (
    SELECT repo_id, 'config/docker-root-user' AS id, 'Container runs as root' AS title, 'medium' AS severity,
           path, 1 AS line, 'no non-root USER directive' AS evidence,
           'Create an unprivileged user and switch to it before CMD/ENTRYPOINT.' AS remediation,
           'https://cwe.mitre.org/data/definitions/250.html' AS reference, scanned, low_trust
    FROM dk WHERE len(users) = 0 OR len(list_filter(users, lambda u: lower(u) NOT IN ('root', '0'))) = 0
    UNION ALL
    SELECT repo_id, 'config/docker-no-healthcheck', 'No container HEALTHCHECK', 'info', path, 1, '',
           'Add a HEALTHCHECK so orchestrators can detect a wedged process.', '', scanned, low_trust
    FROM dk WHERE NOT regexp_matches(content, {q(R.DOCKER_HEALTH_PATTERN)})),
allf AS (SELECT * FROM pat UNION ALL SELECT * FROM dng UNION ALL SELECT * FROM dock)
SELECT repo_id, id,
       CASE WHEN scanned AND low_trust THEN title || ' (in test/docs path)' ELSE title END AS title,
       CASE WHEN scanned AND low_trust THEN {down('severity')} ELSE severity END AS severity,
       'config' AS scanner, path, CAST(line AS INTEGER) AS line, evidence, remediation, reference
FROM allf"""
