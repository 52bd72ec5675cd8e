"""Multi-rule regex scan with offsets and line numbers (whole texts, JVM-side).

Per rule and file: a cheap literal prefilter (``instr`` on substrings every
match must contain), then ``regexp_extract_all`` for the matches and, only when
there are matches, ``split(text, rx, -1)`` for the gaps between them.  Only
small per-match metadata (gap lengths, newline counts, the match text) leaves
the text row.  Offsets and line numbers are running sums over a window
partitioned by file, after one exchange of match rows (never file contents).
Callers get rows hash-partitioned by the file keys, so later windows and joins
on those keys add no further exchange.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.functions.text import newline_count


@dataclass(frozen=True)
class ScanRule:
    id: str
    ord: int
    pattern: str                    # Java regex, flags already applied
    group: int = 0                  # capture group holding the value (0 = whole match)
    hints: tuple = field(default=())      # any of these substrings must occur (case-sensitive)
    ihints: tuple = field(default=())     # … or these, in the lower-cased text


def sql_str(v: str) -> str:
    """A Spark SQL string literal holding exactly ``v``."""
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefilter_sql(text: str, lower: str, r: ScanRule) -> str:
    conds = [f"contains({text}, {sql_str(h)})" for h in r.hints] + \
            [f"contains({lower}, {sql_str(h)})" for h in r.ihints]
    return "(" + " OR ".join(conds) + ")" if conds else "true"


NL_SQL = "(length({x}) - length(replace({x}, '\\n', '')))"


def value_of(rules: list[ScanRule], rule_col: str = "rule_id", match_col: str = "match") -> Column:
    """Captured value (first group, else the whole match), re-extracted from the
    short match text; one SQL CASE over the rule id."""
    whens = [f"WHEN {sql_str(r.id)} THEN regexp_extract({match_col}, {sql_str(r.pattern)}, {r.group})"
             for r in rules if r.group > 0]
    if not whens:
        return F.col(match_col)
    v = f"(CASE {rule_col} {' '.join(whens)} ELSE {match_col} END)"
    return F.expr(f"CASE WHEN {v} = '' THEN {match_col} ELSE {v} END")


def rule_matches(df: DataFrame, keys: list[str], text_col: str, rules: list[ScanRule],
                 carry: list[str] | None = None, applies: dict[str, Column] | None = None,
                 extra: list[tuple[str, int, Column, Column]] | None = None) -> DataFrame:
    """One row per (file, rule, match): keys…, carry…, rule_id, rule_ord, match,
    value, start (0-based code points), end, line (1-based), end_line.

    ``applies`` optionally maps a rule id to a per-file boolean (e.g. a glob or
    extension condition); the rule is not evaluated where it is false.
    ``extra`` adds file-level pseudo-matches ``(rule_id, ord, condition, text)``
    computed in the same pass (offset 0, line 1), so file-level checks need no
    second read of the contents."""
    carry = carry or []
    applies = applies or {}
    extra = extra or []
    need_lower = any(r.ihints for r in rules)
    xcols = [c for j, (_i, _o, cond, mt) in enumerate(extra) for c in (cond.alias(f"_xc{j}"), mt.alias(f"_xm{j}"))]
    xnames = [n for j in range(len(extra)) for n in (f"_xc{j}", f"_xm{j}")]
    base = df.select(*keys, *carry, text_col,
                     *([F.lower(F.col(text_col)).alias("_lower")] if need_lower else []),
                     *[applies[r.id].alias(f"_ap{r.ord}") for r in rules if r.id in applies],
                     *xcols)
    t, lo = f"`{text_col}`", "_lower" if need_lower else f"`{text_col}`"
    names = [f"`{k}`" for k in [*keys, *carry, *xnames]]
    # stage 1: matches per rule (one regex pass, only where the literals occur)
    s1 = []
    for r in rules:
        gate = _prefilter_sql(t, lo, r)
        if r.id in applies:
            gate = f"_ap{r.ord} AND {gate}"
        s1.append(f"CASE WHEN {gate} THEN regexp_extract_all({t}, {sql_str(r.pattern)}, 0) END AS _m{r.ord}")
    st1 = base.selectExpr(*names, t, *s1)
    # stage 2: gaps between matches, only for rules that matched
    s2 = [f"CASE WHEN size(_m{r.ord}) > 0 THEN split({t}, {sql_str(r.pattern)}, -1) END AS _g{r.ord}" for r in rules]
    st2 = st1.selectExpr(*names, *[f"_m{r.ord}" for r in rules], *s2)
    # stage 3: per-match structs, flattened and exploded
    arrays = []
    for r in rules:
        m, g = f"_m{r.ord}", f"_g{r.ord}"
        arrays.append(
            f"CASE WHEN size({m}) > 0 THEN transform(slice(arrays_zip({m}, {g}), 1, size({m})), "
            f"e -> named_struct('rule_id', {sql_str(r.id)}, 'rule_ord', {r.ord}, 'match', e.{m}, "
            f"'glen', CAST(length(e.{g}) AS BIGINT), 'gnl', CAST({NL_SQL.format(x='e.' + g)} AS BIGINT))) END")
    for j, (xid, o, _c, _m) in enumerate(extra):
        arrays.append(f"CASE WHEN _xc{j} THEN array(named_struct('rule_id', {sql_str(xid)}, 'rule_ord', {o}, "
                      f"'match', coalesce(_xm{j}, ''), 'glen', CAST(0 AS BIGINT), 'gnl', CAST(0 AS BIGINT))) END")
    allm = f"flatten(filter(array({', '.join(arrays)}), a -> a IS NOT NULL))"
    exploded = st2.selectExpr(*[f"`{k}`" for k in [*keys, *carry]], f"posexplode({allm}) AS (pos, m)") \
        .selectExpr(*[f"`{k}`" for k in [*keys, *carry]], "pos", "m.*")
    w = (Window.partitionBy(*keys, "rule_id").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    mlen = F.length("match").cast("long")
    mnl = newline_count("match").cast("long")
    return (exploded.repartition(*keys)
            .select("*", mlen.alias("_mlen"), mnl.alias("_mnl"))
            .select("*", (F.sum(F.col("glen") + F.col("_mlen")).over(w) - F.col("_mlen")).alias("start"),
                    (F.sum(F.col("gnl") + F.col("_mnl")).over(w) - F.col("_mnl") + 1).cast("int").alias("line"))
            .select("*", (F.col("start") + F.col("_mlen")).alias("end"),
                    (F.col("line") + F.col("_mnl")).cast("int").alias("end_line"),
                    value_of(rules).alias("value"))
            .drop("glen", "gnl", "_mlen", "_mnl", "pos"))
