"""Lockfile and manifest parsers (S5–S15) and manifest checks (D7–D10), all
as column expressions over the ``files`` table (``repo_id, path, name, dir,
content``).  JSON is read as VARIANT (``try_parse_json``: broken files become
NULL, never an error); line formats use ``regexp_extract_all`` with capture
groups; every output row carries the manifest path it came from.

Rows: ``(repo_id, manifest, name, version, eco, dev)`` where ``dev`` is
true/false only for sources that say so (npm ``packages`` flags, Pipfile
sections, bun reachability, requirements-dev) and NULL otherwise, so a
``bool_and(dev)`` over a key is the dev − prod rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.rules import java_pattern as J

OUT = ["repo_id", "manifest", "name", "version", "eco", "dev"]

# FIXED VALUES — line formats of the text lockfiles.
PNPM_PATTERN = r"(?m)^\s+/?((?:@[^/]+/)?[^/@\s]+)[/@](\d+\.\d+\.\d+[^\s:(]*)"
REQ_PATTERN = r"(?m)^\s*([A-Za-z0-9._\-]+)\s*==\s*([0-9][^\s;#\\]*)"
GOMOD_PATTERN = r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-]+/[^\s]+)\s+v([^\s/]+)"
GEM_PATTERN = r"(?m)^\s{4}([A-Za-z0-9._\-]+) \(([\d][^)]*)\)"
YARN_HEAD_PATTERN = r"^\"?((?:@[^/@\s\"]+/)?[^@\s\"]+)@[^\n]*?:\n"
YARN_VERSION_PATTERN = r"\n\s+version:?\s+\"?([^\"\s]+)\"?"
TOML_NAME_PATTERN = r"(?m)^\s*name\s*=\s*\"([^\"]+)\""
TOML_VERSION_PATTERN = r"(?m)^\s*version\s*=\s*\"([^\"]+)\""
JSONC_STRIP_PATTERN = r"(\"(?:[^\"\\]++|\\.)*+\")|//[^\n]*"
TRAILING_COMMA_PATTERN = r",(\s*[}\]])"

LOCK_PARSERS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "requirements.txt",
                "requirements-dev.txt", "Pipfile.lock", "Gemfile.lock", "go.mod", "poetry.lock", "uv.lock", "Cargo.lock"]


def _kind_pruned(files: DataFrame) -> DataFrame:
    """On a ``files`` table stored partitioned by kind, read the manifest partition only."""
    return files.filter(F.col("kind") == "manifest") if "kind" in files.columns else files


def _files(files: DataFrame, *names: str) -> DataFrame:
    return _kind_pruned(files).filter(F.col("name").isin(*names) & (F.coalesce(F.length("content"), F.lit(0)) > 0))


def _subset(files: DataFrame, *names: str) -> DataFrame:
    """The rows of the named manifests, read once and kept for the branches
    that follow (a small share of a tree's files)."""
    from pyspark import StorageLevel
    return _kind_pruned(files).filter(F.col("name").isin(*names)).select("repo_id", "path", "name", "dir", "content") \
        .persist(StorageLevel.MEMORY_AND_DISK)


def _pairs(files: DataFrame, pattern: str, eco: str, dev: Column | None = None) -> DataFrame:
    """Two-group line format → rows, via regexp_extract_all on both groups."""
    rx = J(pattern)
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), F.lit(1)).alias("n"),
                     F.regexp_extract_all("content", F.lit(rx), F.lit(2)).alias("v"))
    d = dev if dev is not None else F.lit(None).cast("boolean")
    return files.select("repo_id", F.col("path").alias("manifest"), d.alias("dev"), F.explode(z).alias("p")) \
        .select("repo_id", "manifest", F.col("p.n").alias("name"), F.col("p.v").alias("version"),
                F.lit(eco).alias("eco"), "dev")


def npm_lock(files: DataFrame) -> DataFrame:
    """``packages`` map (name from ``name`` or the last node_modules/ part;
    dev/devOptional flags) plus the v1 nested ``dependencies`` tree, walked
    level by level until a level is empty (neutral dev)."""
    from pyspark import StorageLevel
    f = _files(files, "package-lock.json").select("repo_id", F.col("path").alias("manifest"),
                                                   F.try_parse_json("content").alias("j"))
    pk = f.select("repo_id", "manifest",
                  F.explode(F.expr("try_variant_get(j, '$.packages', 'map<string,variant>')")).alias("k", "m"))
    is_obj = F.schema_of_variant("m").startswith("OBJECT")
    nm = F.expr("try_variant_get(m, '$.name', 'string')")
    ver = F.expr("try_variant_get(m, '$.version', 'string')")
    dev = F.coalesce(F.expr("try_variant_get(m, '$.dev', 'boolean')"), F.lit(False)) | \
        F.coalesce(F.expr("try_variant_get(m, '$.devOptional', 'boolean')"), F.lit(False))
    name = F.when(F.coalesce(nm, F.lit("")) != "", nm).otherwise(F.element_at(F.split("k", "node_modules/"), -1))
    a = pk.filter((F.col("k") != "") & is_obj).select(
        "repo_id", "manifest", name.alias("name"), ver.alias("version"), F.lit("npm").alias("eco"), dev.alias("dev")) \
        .filter((F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("version"), F.lit("")) != ""))
    # v1 tree: one level per iteration; the loop runs over tree depth, never over rows
    level = f.select("repo_id", "manifest",
                     F.explode(F.expr("try_variant_get(j, '$.dependencies', 'map<string,variant>')")).alias("k", "m"))
    outs = [a]
    while True:
        v = F.expr("try_variant_get(m, '$.version', 'string')")
        ok = F.schema_of_variant("m").startswith("OBJECT") & (F.coalesce(v, F.lit("")) != "")
        level = level.filter(ok).persist(StorageLevel.MEMORY_AND_DISK)
        if level.count() == 0:
            break
        outs.append(level.select("repo_id", "manifest", F.col("k").alias("name"), v.alias("version"),
                                 F.lit("npm").alias("eco"), F.lit(None).cast("boolean").alias("dev")))
        level = level.select("repo_id", "manifest", F.explode(
            F.expr("try_variant_get(m, '$.dependencies', 'map<string,variant>')")).alias("k", "m"))
    return reduce(lambda x, y: x.unionByName(y), outs)


def yarn_lock(files: DataFrame) -> DataFrame:
    """Split into top-level blocks, then one header and one version per block."""
    f = _files(files, "yarn.lock")
    b = f.select("repo_id", F.col("path").alias("manifest"),
                 F.explode(F.split("content", J(r"\n(?=[^\s])"))).alias("blk"))
    name = F.regexp_extract(F.concat("blk", F.lit("\n")), J(YARN_HEAD_PATTERN), 1)
    ver = F.regexp_extract("blk", J(YARN_VERSION_PATTERN), 1)
    return b.select("repo_id", "manifest", name.alias("name"), ver.alias("version"), F.lit("npm").alias("eco"),
                    F.lit(None).cast("boolean").alias("dev")).filter((F.col("name") != "") & (F.col("version") != ""))


def toml_lock(files: DataFrame) -> DataFrame:
    """``[[package]]`` blocks of poetry.lock / uv.lock (PyPI) and Cargo.lock
    (crates.io); a block needs both a name and a version."""
    f = _files(files, "poetry.lock", "uv.lock", "Cargo.lock")
    eco = F.when(F.col("name") == "Cargo.lock", "crates.io").otherwise("PyPI")
    b = f.select("repo_id", F.col("path").alias("manifest"), eco.alias("eco"),
                 F.explode(F.split("content", J(r"(?m)^(?=\[\[)"))).alias("blk")) \
        .filter(F.col("blk").startswith("[[package]]"))
    n = F.regexp_extract("blk", J(TOML_NAME_PATTERN), 1)
    v = F.regexp_extract("blk", J(TOML_VERSION_PATTERN), 1)
    return b.select("repo_id", "manifest", n.alias("name"), v.alias("version"), "eco",
                    F.lit(None).cast("boolean").alias("dev")).filter((F.col("name") != "") & (F.col("version") != ""))


def pipfile_lock(files: DataFrame) -> DataFrame:
    """``default`` (prod) and ``develop`` (dev) sections, ``==`` pins only."""
    f = _files(files, "Pipfile.lock").select("repo_id", F.col("path").alias("manifest"),
                                              F.try_parse_json("content").alias("j"))
    parts = []
    for section, dev in (("default", False), ("develop", True)):
        s = f.select("repo_id", "manifest", F.explode(
            F.expr(f"try_variant_get(j, '$.{section}', 'map<string,variant>')")).alias("k", "m"))
        ver = F.coalesce(F.expr("try_variant_get(m, '$.version', 'string')"), F.lit(""))
        parts.append(s.filter(ver.startswith("==")).select(
            "repo_id", "manifest", F.col("k").alias("name"), F.substring(ver, 3, 1 << 30).alias("version"),
            F.lit("PyPI").alias("eco"), F.lit(dev).alias("dev")))
    return parts[0].unionByName(parts[1])


def strip_jsonc(text: Column) -> Column:
    """Drop ``//`` comments outside strings, then trailing commas (the comma
    pass is not string-aware, as in the behaviour reproduced)."""
    no_comments = F.regexp_replace(text, J(JSONC_STRIP_PATTERN), "$1")
    return F.regexp_replace(no_comments, J(TRAILING_COMMA_PATTERN), "$1")


def bun_entries(files: DataFrame) -> DataFrame:
    """bun.lock ``packages``: (repo, manifest, key, name, version, deps keys)."""
    f = _files(files, "bun.lock").select("repo_id", F.col("path").alias("manifest"),
                                         F.try_parse_json(strip_jsonc(F.col("content"))).alias("j"))
    e = f.select("repo_id", "manifest", "j", F.explode(
        F.expr("try_variant_get(j, '$.packages', 'map<string,variant>')")).alias("key", "arr"))
    first = F.expr("try_variant_get(arr, '$[0]', 'variant')")
    s0 = F.expr("try_variant_get(arr, '$[0]', 'string')")
    ok = F.schema_of_variant("arr").startswith("ARRAY") & F.schema_of_variant(first).isin("STRING")
    name = F.regexp_extract(s0, r"^(.*)@([^@]*)$", 1)
    ver = F.regexp_extract(s0, r"^(.*)@([^@]*)$", 2)
    deps = F.concat(*[F.coalesce(F.map_keys(F.expr(f"try_variant_get(try_variant_get(arr, '$[2]', 'variant'), '$.{s}', 'map<string,variant>')")),
                                 F.array().cast("array<string>"))
                      for s in ("dependencies", "peerDependencies", "optionalDependencies")])
    return e.filter(ok & (name != "") & (ver != "")).select("repo_id", "manifest", "key", name.alias("name"),
                                                            ver.alias("version"), deps.alias("deps"), "j")


def bun_lock(files: DataFrame) -> DataFrame:
    """S13 + D6: bun packages; dev = not reachable from any workspace's runtime
    dependencies (through dependencies/peer/optional edges)."""
    from pyspark import StorageLevel

    from codeaudit.operators.packages import reachable
    e = bun_entries(files).persist(StorageLevel.MEMORY_AND_DISK)
    if e.isEmpty():  # no bun lockfiles: skip the reachability loop
        return e.select("repo_id", "manifest", "name", "version", F.lit("npm").alias("eco"),
                        F.lit(None).cast("boolean").alias("dev"))
    nodes = e.select(F.concat_ws("\u0000", "repo_id", "manifest").alias("repo_id"), F.col("key").alias("node"))
    edges = e.select(F.concat_ws("\u0000", "repo_id", "manifest").alias("repo_id"), F.col("key").alias("src"),
                     F.explode("deps").alias("dst")).join(
        nodes.select("repo_id", F.col("node").alias("dst")), ["repo_id", "dst"], "left_semi")
    ws = e.select("repo_id", "manifest", "j").dropDuplicates(["repo_id", "manifest"]).select(
        F.concat_ws("\u0000", "repo_id", "manifest").alias("repo_id"),
        F.explode(F.expr("try_variant_get(j, '$.workspaces', 'map<string,variant>')")).alias("w", "wm"))
    roots = ws.select("repo_id", F.explode(F.map_keys(
        F.expr("try_variant_get(wm, '$.dependencies', 'map<string,variant>')"))).alias("node")) \
        .join(nodes, ["repo_id", "node"], "left_semi")
    prod = reachable(edges, roots).withColumn("prod", F.lit(True))
    keyed = e.select(F.concat_ws("\u0000", "repo_id", "manifest").alias("rk"), "repo_id", "manifest",
                     F.col("key").alias("node"), "name", "version")
    j = keyed.join(prod.withColumnRenamed("repo_id", "rk"), ["rk", "node"], "left")
    return j.select("repo_id", "manifest", "name", "version", F.lit("npm").alias("eco"),
                    (~F.coalesce(F.col("prod"), F.lit(False))).alias("dev"))


def lockfile_packages(files: DataFrame, with_bun: bool = True) -> DataFrame:
    """S14/S15 input: every parser's rows, unioned by name.

    The lockfile rows are selected from ``files`` once and kept (they are a
    small share of a tree), so the parser branches do not each re-read the
    contents of every file."""
    from pyspark import StorageLevel
    files = _kind_pruned(files).filter(F.col("name").isin(*LOCK_PARSERS)) \
        .select("repo_id", "path", "name", "dir", "content").persist(StorageLevel.MEMORY_AND_DISK)
    parts = [
        npm_lock(files),
        yarn_lock(files),
        _pairs(_files(files, "pnpm-lock.yaml"), PNPM_PATTERN, "npm"),
        _pairs(_files(files, "requirements.txt"), REQ_PATTERN, "PyPI"),
        _pairs(_files(files, "requirements-dev.txt"), REQ_PATTERN, "PyPI", F.lit(True)),
        pipfile_lock(files),
        _pairs(_files(files, "Gemfile.lock"), GEM_PATTERN, "RubyGems"),
        _pairs(_files(files, "go.mod"), GOMOD_PATTERN, "Go"),
        toml_lock(files),
    ]
    if with_bun:
        parts.append(bun_lock(files))
    return reduce(lambda a, b: a.unionByName(b), [p.select(*OUT) for p in parts])


# --------------------------------------------------------------------------
# manifest checks
# --------------------------------------------------------------------------
# FIXED VALUES — manifests that need a sibling lockfile, and their ecosystems.
UNRESOLVED_MANIFESTS = {
    "package.json": (["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json",
                      "bun.lock", "bun.lockb"], "npm"),
    "pyproject.toml": (["uv.lock", "poetry.lock", "pdm.lock", "requirements.txt"], "PyPI"),
    "Gemfile": (["Gemfile.lock"], "RubyGems"),
    "Cargo.toml": (["Cargo.lock"], "crates.io"),
}
PYPROJECT_DECL_PATTERN = r"(?m)^\s*[\"']?[A-Za-z0-9][\w.\-]*[\"']?\s*[=><~^]"
FLOAT_SPEC_PATTERN = r"(?i)^\*$|^latest$"
GIT_SPEC_PATTERN = r"^(?:git\+|git://|github:|[\w-]+/[\w.-]+#)"
INSTALL_HOOK_KEYS = ["preinstall", "install", "postinstall"]
DANGEROUS_HOOK_PATTERN = r"(?i)\bcurl\s|\bwget\s|\bnode\s+-e\b|\beval\(|\|\s*(?:sudo\s+)?(?:ba|z|s)?sh\b"
DEP_SECTIONS = ["dependencies", "devDependencies", "optionalDependencies"]


def unlocked_manifests(files: DataFrame) -> DataFrame:
    """A manifest with no sibling lockfile (same repo and directory)."""
    rows = [(m, lock, eco) for m, (locks, eco) in UNRESOLVED_MANIFESTS.items() for lock in locks]
    spark = files.sparkSession
    need = spark.createDataFrame(rows, "mname string, lock string, eco string")
    man = _files(_subset(files, *UNRESOLVED_MANIFESTS), *UNRESOLVED_MANIFESTS).select(
        "repo_id", "dir", "path", F.col("name").alias("mname"), "content")
    present = files.select("repo_id", "dir", F.col("name").alias("lock"))
    have = man.join(F.broadcast(need), "mname").join(present, ["repo_id", "dir", "lock"], "left_semi") \
        .select("repo_id", "path").distinct()
    m = man.join(have, ["repo_id", "path"], "left_anti").join(
        F.broadcast(need.select("mname", "eco").distinct()), "mname")
    j = F.try_parse_json("content")
    n_pkg = reduce(lambda a, b: a + b, [F.coalesce(F.size(F.expr(
        f"try_variant_get(try_parse_json(content), '$.{s}', 'map<string,variant>')")), F.lit(0)) for s in DEP_SECTIONS])
    n_py = F.size(F.regexp_extract_all("content", F.lit(J(PYPROJECT_DECL_PATTERN)), F.lit(0)))
    n = F.when(F.col("mname") == "package.json", F.when(j.isNotNull(), n_pkg).otherwise(F.lit(0))) \
        .when(F.col("mname") == "pyproject.toml", n_py).otherwise(F.lit(0))
    m = m.withColumn("n", n).filter(~((F.col("mname") == "package.json") & (F.col("n") == 0)))
    locks_txt = F.create_map(*[x for k, (locks, _e) in UNRESOLVED_MANIFESTS.items()
                               for x in (F.lit(k), F.lit(" / ".join(sorted(locks))))])
    count = F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" declared dependencies"))) \
        .otherwise(F.lit("declared dependencies"))
    return m.select(
        "repo_id", F.lit("deps/unresolved-manifest").alias("id"),
        F.concat(F.col("mname"), F.lit(" has "), count, F.lit(" but no lockfile — CVE scan skipped for "), F.col("eco"))
         .alias("title"),
        F.lit("medium").alias("severity"), F.lit("deps").alias("scanner"), "path", F.lit(0).alias("line"),
        F.col("mname").alias("evidence"),
        F.concat(F.lit("Commit a lockfile ("), locks_txt[F.col("mname")],
                 F.lit("); without resolved versions this ecosystem is unchecked, not clean.")).alias("remediation"),
        F.lit("https://cwe.mitre.org/data/definitions/1104.html").alias("reference"))


def _package_json_entries(files: DataFrame) -> DataFrame:
    f = _files(_subset(files, "package.json"), "package.json").select("repo_id", "path", F.try_parse_json("content").alias("j"))
    parts = [f.select("repo_id", "path", F.lit(i).alias("sec"), F.posexplode(F.expr(
        f"try_variant_get(j, '$.{s}', 'map<string,variant>')")).alias("pos", "dep", "spec"))
             for i, s in enumerate(DEP_SECTIONS)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def floating_dependencies(files: DataFrame) -> DataFrame:
    """``*``/``latest`` or git-ref specs in package.json dependency sections."""
    e = _package_json_entries(files)
    spec = F.trim(F.expr("try_variant_get(spec, '$', 'string')"))
    is_str = F.schema_of_variant("spec") == "STRING"
    e = e.filter(is_str).withColumn("s", spec)
    floating = F.col("s").rlike(J(FLOAT_SPEC_PATTERN))
    git = F.col("s").rlike(J(GIT_SPEC_PATTERN))
    e = e.filter(floating | git)
    return e.select(
        "repo_id", F.when(floating, "deps/floating-version").otherwise("deps/git-dependency").alias("id"),
        F.when(floating, F.concat(F.col("dep"), F.lit(" is pinned to \""), F.col("s"),
                                  F.lit("\" — resolves to whatever is newest at install time")))
         .otherwise(F.concat(F.col("dep"), F.lit(" installs directly from a git ref, bypassing registry integrity checks")))
         .alias("title"),
        F.lit("medium").alias("severity"), F.lit("deps").alias("scanner"), "path", F.lit(0).alias("line"),
        F.concat(F.col("dep"), F.lit(": "), F.col("s")).alias("evidence"),
        F.when(floating, F.lit("Pin a version range and let the lockfile carry reproducibility."))
         .otherwise(F.lit("Prefer a registry release, or pin an exact commit SHA.")).alias("remediation"),
        F.when(floating, F.lit("https://cwe.mitre.org/data/definitions/1357.html"))
         .otherwise(F.lit("https://cwe.mitre.org/data/definitions/829.html")).alias("reference"))


def install_hooks(files: DataFrame) -> DataFrame:
    """Npm lifecycle scripts run on install; remote-fetch or eval → high."""
    # one pass: each file is parsed once for its three hooks and kept nowhere
    f = _files(files, "package.json").select("repo_id", "path", F.try_parse_json("content").alias("j"))
    hooks = F.array(*[F.struct(F.lit(key).alias("hook"), F.expr(f"try_variant_get(j, '$.scripts.{key}', 'string')").alias("cmd"))
                      for key in INSTALL_HOOK_KEYS])
    h = f.select("repo_id", "path", F.explode(hooks).alias("h")).select("repo_id", "path", "h.*").filter(F.coalesce(F.col("cmd"), F.lit("")) != "")
    bad = F.col("cmd").rlike(J(DANGEROUS_HOOK_PATTERN))
    return h.select(
        "repo_id", F.lit("deps/install-script-hook").alias("id"),
        F.concat(F.lit("package.json runs a `"), F.col("hook"), F.lit("` lifecycle script on install"),
                 F.when(bad, F.lit(" — pipes a remote script into a shell")).otherwise(F.lit(""))).alias("title"),
        F.when(bad, "high").otherwise("medium").alias("severity"), F.lit("deps").alias("scanner"), "path",
        F.lit(0).alias("line"), F.substring("cmd", 1, 160).alias("evidence"),
        F.lit("Review lifecycle scripts and run untrusted installs with scripts disabled.").alias("remediation"),
        F.lit("https://cwe.mitre.org/data/definitions/506.html").alias("reference"))


def declared_names(files: DataFrame) -> DataFrame:
    """Lower-cased names a human declared, per (repo, ecosystem)."""
    files = _subset(files, "package.json", "requirements.txt", "requirements-dev.txt", "pyproject.toml",
                    "Cargo.toml", "Gemfile", "Pipfile")
    pj = _files(files, "package.json").select("repo_id", F.try_parse_json("content").alias("j"))
    npm = reduce(lambda a, b: a.unionByName(b), [
        pj.select("repo_id", F.explode(F.map_keys(F.expr(f"try_variant_get(j, '$.{s}', 'map<string,variant>')")))
                  .alias("n")) for s in DEP_SECTIONS + ["peerDependencies"]]).select("repo_id", F.lit("npm").alias("eco"), "n")
    req = _files(files, "requirements.txt", "requirements-dev.txt").select(
        "repo_id", F.explode(F.split("content", r"\r?\n")).alias("ln"))
    ln = F.trim(F.split("ln", "#")[0])
    req = req.select("repo_id", ln.alias("ln")).filter(~F.col("ln").startswith("-")).select(
        "repo_id", F.lit("PyPI").alias("eco"), F.regexp_extract("ln", r"^([A-Za-z0-9][\w.\-]*)", 1).alias("n"))

    def rx(names, pattern, eco):
        return _files(files, *names).select("repo_id", F.lit(eco).alias("eco"), F.explode(
            F.regexp_extract_all("content", F.lit(J(pattern)), F.lit(1))).alias("n"))
    parts = [npm, req,
             rx(["pyproject.toml"], r"[\"']([A-Za-z0-9][\w.\-]*)\s*(?:[<>=!~\[]|[\"'])", "PyPI"),
             rx(["Cargo.toml"], r"(?m)^\s*([A-Za-z0-9][\w.\-]*)\s*=", "crates.io"),
             rx(["Gemfile"], r"(?m)^\s*gem\s+[\"']([^\"']+)[\"']", "RubyGems"),
             rx(["Pipfile"], r"(?m)^\s*[\"']?([A-Za-z0-9][\w.\-]*)[\"']?\s*=", "PyPI")]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.filter(F.coalesce(F.col("n"), F.lit("")) != "").select("repo_id", "eco", F.lower("n").alias("lname")).distinct()
