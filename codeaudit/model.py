"""The ``findings`` relation and the severity dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# FIXED VALUES — severity order, risk weights, SARIF level and rank.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_WEIGHT = {"critical": 40, "high": 20, "medium": 8, "low": 3, "info": 0}
SARIF_LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_RANK = {"critical": 9.5, "high": 8.0, "medium": 5.0, "low": 3.0, "info": 1.0}

# FIXED VALUES — the three downgrade tables.
DOWNGRADE = {"critical": "medium", "high": "low", "medium": "low", "low": "info"}
DEV_DOWNGRADE = {"critical": "high", "high": "medium", "medium": "low", "low": "info"}

FINDING_SCHEMA = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("remediation", T.StringType()),
    T.StructField("reference", T.StringType()),
])
FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA.fields]


def _map_lit(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def sev_ord(col: Column | str) -> Column:
    """0 = critical … 4 = info (null for unknown)."""
    return _map_lit({s: i for i, s in enumerate(SEVERITIES)})[F.col(col) if isinstance(col, str) else col]


def sev_weight(col: Column | str) -> Column:
    return _map_lit(SEVERITY_WEIGHT)[F.col(col) if isinstance(col, str) else col]


def downgrade(col: Column | str, table: dict = DOWNGRADE, default: Column | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_map_lit(table)[c], default if default is not None else c)



def fingerprint(id_col="id", path_col="path", evidence_col="evidence") -> Column:
    """First 16 hex chars of sha256(id|path|evidence); line/title/severity excluded."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (id_col, path_col, evidence_col)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def strip_ws(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def redact(col: Column, keep: int = 4) -> Column:
    """first ``keep`` + up to 12 stars + last ``keep``; short values become all stars."""
    s = strip_ws(col)
    n = F.length(s)
    return (F.when(n <= 2 * keep, F.repeat(F.lit("*"), n))
            .otherwise(F.concat(F.substring(s, 1, keep),
                                F.repeat(F.lit("*"), F.least(F.lit(12), n - 2 * keep)),
                                F.substring(s, -keep, keep))))




def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint())
