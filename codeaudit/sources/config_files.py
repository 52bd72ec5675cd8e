"""Policy and baseline files.

A policy is JSON ``{"fail_on", "severity": {rule: level}, "ignore": [ids],
"ignore_paths": [globs]}`` (all keys optional).  Across a fleet the policy
files are rows of the ``files`` table; they are parsed as VARIANT and
validated with SQL, giving one ``policy`` row per valid file and one
``policy_errors`` row per invalid file.  A bad policy is an error, never a
silent default: ``require_valid`` raises when any error row exists.  A bad or
missing baseline is silently empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.model import SEVERITIES

POLICY_FILE = ".codeaudit-policy.json"
BASELINE_FILE = ".codeaudit-baseline.json"


class PolicyError(ValueError):
    pass


def _get(v: str, path: str, typ: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{typ}')")


def _kind(v: str, path: str) -> Column:
    return F.schema_of_variant(_get(v, path, "variant"))


def validate_policies(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` = (repo_id, path, content).  Returns (policy, policy_errors)."""
    valid_levels = ", ".join(f"'{s}'" for s in SEVERITIES)
    d = texts.select("repo_id", "path", F.try_parse_json("content").alias("v"))
    is_obj = F.schema_of_variant("v").startswith("OBJECT")
    fail_on = _get("v", "$.fail_on", "variant")
    sev = _get("v", "$.severity", "variant")
    ign = _get("v", "$.ignore", "variant")
    igp = _get("v", "$.ignore_paths", "variant")

    def str_list_ok(var: Column, path: str) -> Column:
        arr = _get("v", path, "array<variant>")
        return var.isNull() | (F.schema_of_variant(var).startswith("ARRAY")
                               & F.forall(arr, lambda x: F.schema_of_variant(x) == "STRING"))

    sev_map = _get("v", "$.severity", "map<string,string>")
    checks = [
        (F.col("v").isNull(), "policy file is not valid JSON"),
        (~is_obj, "policy file must contain a JSON object"),
        (~(fail_on.isNull() | ((_kind("v", "$.fail_on") == "STRING")
                               & F.expr(f"try_variant_get(v, '$.fail_on', 'string') IN ({valid_levels}, 'never')"))),
         f"policy fail_on must be one of {sorted(SEVERITIES)} or 'never'"),
        (~(sev.isNull() | F.schema_of_variant(sev).startswith("OBJECT")),
         "policy 'severity' must be an object of rule-id to severity"),
        (F.schema_of_variant(sev).startswith("OBJECT")
         & ~F.coalesce(F.forall(F.map_values(sev_map), lambda x: x.isin(*SEVERITIES)), F.lit(False)),
         "policy 'severity' has invalid levels"),
        (~str_list_ok(ign, "$.ignore"), "policy 'ignore' must be a list of strings"),
        (~str_list_ok(igp, "$.ignore_paths"), "policy 'ignore_paths' must be a list of strings"),
    ]
    errs = F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())
    d = d.withColumn("_errors", errs)
    errors = d.filter(F.size("_errors") > 0).select("repo_id", "path", F.col("_errors")[0].alias("error"))
    good = d.filter(F.size("_errors") == 0).select(
        "repo_id",
        F.expr("try_variant_get(v, '$.fail_on', 'string')").alias("fail_on"),
        F.coalesce(sev_map, F.create_map().cast("map<string,string>")).alias("severity"),
        F.coalesce(_get("v", "$.ignore", "array<string>"), F.array().cast("array<string>")).alias("ignore"),
        F.coalesce(_get("v", "$.ignore_paths", "array<string>"), F.array().cast("array<string>")).alias("ignore_paths"))
    return good, errors


def policies_from_files(files: DataFrame, name: str = POLICY_FILE) -> tuple[DataFrame, DataFrame]:
    """Root-level policy files of every repo in the ``files`` table."""
    return validate_policies(files.filter(F.col("path") == name).select("repo_id", "path", "content"))


def require_valid(errors: DataFrame) -> None:
    """Raise when any policy is invalid (an action on a tiny table)."""
    bad = errors.limit(5).collect()
    if bad:
        raise PolicyError("; ".join(f"{r['repo_id']}:{r['path']}: {r['error']}" for r in bad))


def load_policy(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """One policy file on shared storage → a one-row policy table (or PolicyError)."""
    try:
        t = spark.read.text(path, wholetext=True)
    except Exception as e:  # noqa: BLE001 — a missing file is a policy error
        raise PolicyError(f"cannot read policy file {path}: {e}") from e
    texts = t.select(F.lit(repo_id).alias("repo_id"), F.lit(path).alias("path"), F.col("value").alias("content"))
    good, errors = validate_policies(texts)
    require_valid(errors)
    return good


def baselines_from_files(files: DataFrame, name: str = BASELINE_FILE) -> DataFrame:
    """(repo_id, fingerprint) from each repo's baseline file; malformed → none."""
    b = files.filter(F.col("path") == name).select("repo_id", F.try_parse_json("content").alias("v"))
    fps = F.coalesce(_get("v", "$.fingerprints", "array<string>"), F.array().cast("array<string>"))
    return b.select("repo_id", F.explode(fps).alias("fingerprint")).filter(F.col("fingerprint").isNotNull()).distinct()
