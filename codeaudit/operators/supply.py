"""Typosquat detection.

Declared names ∩ resolved packages, minus popular names, short names and the
allow-list, that are one edit from a popular name.  Neighbours are found by a
deletion index: names one edit apart share a string that is one of them or one
of them without a character, so an equi-join on those strings proposes all of
them, and the edit distance is checked on what it proposes.  The popular names
may be a table of any size, such as the names most repositories of the fleet
use (``fleet_popular``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.session import checkpoint_dir

SCANNER = "deps"


def popular_table(spark: SparkSession) -> DataFrame:
    rows = [(eco, n) for eco, names in R.POPULAR_PACKAGES.items() for n in names]
    return spark.createDataFrame(rows, "eco string, target string")


def allowlist_table(spark: SparkSession) -> DataFrame:
    rows = [(eco, n) for eco, names in R.TYPOSQUAT_ALLOWLIST.items() for n in names]
    return spark.createDataFrame(rows, "eco string, lname string")


def fleet_popular(packages: DataFrame, least_repos: int) -> DataFrame:
    """(eco, target): the names that so many repositories have."""
    names = packages.select("repo_id", "eco", F.lower("name").alias("target")).distinct()
    return names.groupBy("eco", "target").agg(F.count("*").alias("n")).filter(F.col("n") >= least_repos).select("eco", "target")


def _with_deletions(name: str) -> Column:
    """The name and, for each place, the name without the character there."""
    return F.explode(F.expr(f"array_distinct(concat(array({name}), transform(if(length({name}) > 0, sequence(1, length({name})), "
                            f"cast(array() as array<int>)), i -> concat(substring({name}, 1, i - 1), substring({name}, i + 1)))))"))


def neighbours(names: DataFrame, targets: DataFrame) -> DataFrame:
    """(eco, lname, target) of the names (eco, lname) that are one edit from a
    target (eco, target): an insertion, a deletion or a substitution.  A string
    is shared by few names, whatever their number: those with one character put
    somewhere into it."""
    a = names.select("eco", "lname").distinct().select("eco", "lname", _with_deletions("lname").alias("part"))
    b = targets.select("eco", "target").distinct().select("eco", "target", _with_deletions("target").alias("part"))
    return a.join(b, ["eco", "part"]).filter(F.levenshtein("lname", "target", 1) == 1).select("eco", "lname", "target").distinct()


def typosquats(packages: DataFrame, declared: DataFrame, popular: DataFrame | None = None) -> DataFrame:
    """D12. ``declared`` is (repo_id, eco, lname) from D10, ``popular`` (eco,
    target) the fixed table unless given.  One hit per (repo, eco, name); the
    lexicographically first target on ties.

    Neighbours are looked for among the distinct (eco, name) pairs only (a fleet
    has far fewer distinct names than package rows); hits are joined back to
    the declared packages."""
    spark = packages.sparkSession
    pop = popular_table(spark) if popular is None else popular
    names = (packages.select("eco", F.lower("name").alias("lname")).distinct()
             .filter(F.length("lname") >= R.MIN_TYPOSQUAT_LEN)
             .join(pop.select("eco", F.col("target").alias("lname")), ["eco", "lname"], "left_anti")
             .join(F.broadcast(allowlist_table(spark)), ["eco", "lname"], "left_anti"))
    found = neighbours(names, pop).groupBy("eco", "lname").agg(F.min("target").alias("target"))
    # stored, so that its size is known before the fleet's rows are read: only rows with such names pass an exchange
    folder = f"{checkpoint_dir(spark).rstrip('/')}/near-{uuid.uuid4().hex}"
    found.write.parquet(folder)
    near = spark.read.schema(found.schema).parquet(folder)
    cand = (packages.select("repo_id", "eco", "name", "version", F.lower("name").alias("lname"))
            .join(near, ["eco", "lname"])
            .join(declared.select("repo_id", "eco", "lname").join(near.select("eco", "lname"), ["eco", "lname"], "left_semi"),
                  ["repo_id", "eco", "lname"], "left_semi"))
    first = cand.groupBy("repo_id", "eco", "name").agg(F.min("target").alias("target"), F.min("version").alias("version"))
    return first.select(
        "repo_id", F.lit("deps/possible-typosquat").alias("id"),
        F.concat(F.col("name"), F.lit(" ("), F.col("eco"), F.lit(") is 1 edit from the popular package '"),
                 F.col("target"), F.lit("'")).alias("title"),
        F.lit("medium").alias("severity"), F.lit(SCANNER).alias("scanner"), F.lit("").alias("path"),
        F.lit(0).alias("line"),
        F.concat(F.col("eco"), F.lit(":"), F.col("name"), F.lit("@"), F.col("version"), F.lit(" ~ "),
                 F.col("target")).alias("evidence"),
        F.concat(F.lit("Confirm this is not a typosquat of '"), F.col("target"),
                 F.lit("' before shipping it; if it is legitimate, add it to the baseline.")).alias("remediation"),
        F.lit("https://cwe.mitre.org/data/definitions/1357.html").alias("reference"))
