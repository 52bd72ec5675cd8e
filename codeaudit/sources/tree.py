"""Source trees → the ``files`` table.

Trees are read by the data source ``source_tree`` (``tree_reader``), which
drops ignored directories before it descends and opens no file that a filter
on the listing leaves out.  Spark's ``binaryFile`` source would skip names
starting with ``.`` or ``_`` (``.env``, ``.github``, ``__init__.py``), exactly
the files a security scan must not lose.  ``files_from_raw`` applies the same
rules in Spark SQL to a table of files that something else has listed.

Ignore semantics: a file is dropped when it or any ancestor directory matches
a pattern by name, by relative path, as ``*/pattern`` or as ``pattern/*``
(shell-style, ``*`` crosses ``/``).  Patterns are the default excludes plus the
non-comment, non-negated lines of ``.codeauditignore`` and ``.gitignore``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.functions.text import glob_bodies, glob_body, suffix
from codeaudit.sources.tree_reader import IGNORE_FILES, read_tree


def decode_text(data: Column) -> Column:
    """Empty when a NUL byte occurs in the first 4096 bytes (binary sniff);
    otherwise UTF-8 with invalid sequences replaced.  The sniff is a byte-level
    ``contains`` on the raw head (binary → string keeps the bytes as they are)."""
    has_nul = F.substring(data, 1, 4096).cast("string").contains(F.lit("\x00"))
    return F.when(data.isNull(), F.lit(None).cast("string")) \
        .when(has_nul, F.lit("")).otherwise(F.make_valid_utf8(data.cast("string")))


def ignore_patterns(raw: DataFrame) -> DataFrame:
    """S3: (repo_id, pattern) from the repo's ignore files (defaults excluded)."""
    ig = raw.filter(F.col("path").isin(*IGNORE_FILES) & F.col("data").isNotNull()) \
        .select("repo_id", F.explode(F.split(decode_text(F.col("data")), r"\r?\n")).alias("line"))
    ln = F.trim("line")
    return ig.select("repo_id", ln.alias("line")).filter(
        (F.col("line") != "") & ~F.col("line").startswith("#") & ~F.col("line").startswith("!")) \
        .select("repo_id", F.regexp_replace("line", "/+$", "").alias("pattern")).filter(F.col("pattern") != "").distinct()


def _forms(pattern: str) -> tuple[str, str]:
    """(name regex, rel regex) for one shell pattern."""
    return glob_body(pattern), "|".join(glob_body(g) for g in (pattern, "*/" + pattern, pattern + "/*"))


def _default_regexes() -> tuple[str, str]:
    names, rels = zip(*[_forms(p) for p in R.DEFAULT_EXCLUDES])
    return "(?s)^(?:" + "|".join(names) + ")$", "(?s)^(?:" + "|".join(rels) + ")$"


def repo_ignore_regexes(patterns: DataFrame) -> DataFrame:
    """One (name regex, rel regex) pair per repo built from its own patterns."""
    g = F.col("g")
    rel = F.concat(F.lit("(?:"), g, F.lit(")|(?:.*/"), g, F.lit(")|(?:"), g, F.lit("/.*)"))
    # each pattern is converted once, however many repositories have it
    bodies = patterns.select("pattern").distinct().withColumn("g", glob_bodies("pattern"))
    agg = patterns.join(bodies, "pattern").groupBy("repo_id").agg(F.collect_set(g).alias("n"), F.collect_set(rel).alias("r"))
    return agg.select("repo_id",
                      F.concat(F.lit("(?s)^(?:"), F.array_join("n", "|"), F.lit(")$")).alias("rx_name"),
                      F.concat(F.lit("(?s)^(?:"), F.array_join("r", "|"), F.lit(")$")).alias("rx_rel"))


def _ignored(path: Column, rx_name: Column | str, rx_rel: Column | str) -> Column:
    """The file, or any ancestor directory, matches by name or by path."""
    parts = F.split(path, "/")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))

    def test(pref: Column) -> Column:
        last = F.element_at(F.split(pref, "/"), -1)
        if isinstance(rx_name, str):
            return last.rlike(rx_name) | pref.rlike(rx_rel)
        return F.regexp_like(last, rx_name) | F.regexp_like(pref, rx_rel)
    return F.exists(prefixes, test)


def files_from_trees(spark: SparkSession, roots: list[tuple[str, str]], tracked: DataFrame | None = None) -> DataFrame:
    """S1–S4 + S20: walked, ignored, eligible files as the ``files`` table.
    ``tracked`` is an optional (repo_id, path) table of git-indexed paths; repos
    without it get ``tracked = NULL`` (not a git repository)."""
    raw = read_tree(spark, roots).filter(
        ~F.col("is_symlink") & (F.col("size") <= R.MAX_FILE_BYTES) & ~F.col("ext").isin(*R.BINARY_EXT))
    return _files(raw, tracked, None)


def files_from_raw(raw: DataFrame, tracked: DataFrame | None = None, git_repos: DataFrame | None = None) -> DataFrame:
    dn, dr = _default_regexes()
    pats = repo_ignore_regexes(ignore_patterns(raw))
    f = raw.join(pats, "repo_id", "left")
    ig = _ignored(F.col("path"), dn, dr) | F.coalesce(
        F.when(F.col("rx_name").isNotNull(), _ignored(F.col("path"), F.col("rx_name"), F.col("rx_rel"))), F.lit(False))
    name = F.element_at(F.split("path", "/"), -1)
    return _files(f.filter(~ig & ~F.col("is_symlink") & (F.col("size") <= R.MAX_FILE_BYTES) & ~suffix(name).isin(*R.BINARY_EXT)),
                  tracked, git_repos)


def _files(kept: DataFrame, tracked: DataFrame | None, git_repos: DataFrame | None) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    f = kept.select("repo_id", "path", name.alias("name"),
                    F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), suffix(name).alias("ext"),
                    "size", "mtime", decode_text(F.col("data")).alias("content"))
    if tracked is not None:
        t = tracked.select("repo_id", "path", F.lit(True).alias("_t"))
        repos = (git_repos if git_repos is not None else tracked).select("repo_id").distinct().withColumn("_git", F.lit(True))
        f = f.join(t, ["repo_id", "path"], "left").join(repos, "repo_id", "left").select(
            "*", F.when(F.col("_git"), F.coalesce("_t", F.lit(False))).alias("tracked")).drop("_t", "_git")
    else:
        f = f.withColumn("tracked", F.lit(None).cast("boolean"))
    return f.select("repo_id", "path", "name", "dir", "ext", "size", "mtime", "tracked", "content")


# Storage layout: the per-name branches (lockfiles, manifests, ignore files,
# readiness targets) read few rows, but a parquet scan reads whole column
# chunks of ``content``.  Writing ``files`` partitioned by ``kind`` lets those
# branches prune to their partition instead of re-reading every file's text.
MANIFEST_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "requirements.txt",
                  "requirements-dev.txt", "Pipfile.lock", "Gemfile.lock", "go.mod", "poetry.lock", "uv.lock",
                  "Cargo.lock", "package.json", "pyproject.toml", "Gemfile", "Cargo.toml", "Pipfile"]


def file_kind() -> Column:
    name = F.element_at(F.split("path", "/"), -1)
    return (F.when(name.isin(*MANIFEST_NAMES), F.lit("manifest"))
             .when(name.isin(*IGNORE_FILES), F.lit("ignore"))
             .otherwise(F.lit("source")))


def write_files(files: DataFrame, path: str) -> None:
    """Persist a ``files`` table partitioned by kind (then by repo_id inside
    each file by clustering), for partition-pruned manifest/ignore reads."""
    files.withColumn("kind", file_kind()).repartition("kind", "repo_id") \
        .write.mode("overwrite").partitionBy("kind").parquet(path)
