"""Column builders over text: entropy, placeholder gate, minified detector,
low-trust paths, file suffixes and shell-style globs.  All native Spark
expressions (higher-order functions), no Python UDFs."""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit import rules as R
from codeaudit.model import strip_ws


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chars(col: Column | str) -> Column:
    return F.split(_c(col), "", -1)


def shannon_entropy(col: Column | str) -> Column:
    """Bits per character: -Σ p·log2 p over distinct characters (0 for '')."""
    c = _c(col)
    cs = chars(c)
    n = F.length(c)
    ent = F.aggregate(
        F.array_distinct(cs), F.lit(0.0).cast("double"),
        lambda acc, ch: acc - (F.size(F.filter(cs, lambda x: x == ch)) / n)
        * F.log2(F.size(F.filter(cs, lambda x: x == ch)) / n))
    return F.when((c.isNull()) | (n == 0), F.lit(0.0)).otherwise(ent)


def is_placeholder(col: Column | str) -> Column:
    """Blank or short; a placeholder marker anywhere; a weak word as the whole
    value; or at most three distinct characters."""
    v = strip_ws(_c(col))
    return (F.coalesce(F.length(v), F.lit(0)) < 8) \
        | v.rlike(R.java_pattern(R.PLACEHOLDER_PATTERN)) \
        | v.rlike(R.java_pattern(R.WEAK_PLACEHOLDER_PATTERN)) \
        | (F.size(F.array_distinct(chars(v))) <= 3)


def is_minified(name: Column | str, text: Column | str) -> Column:
    """Generated bundle: by name, or ≥20k chars whose first 400 lines have a line
    over 1000 chars and an average over 200."""
    t = _c(text)
    lines = F.slice(F.split(t, "\n", R.MINIFIED_LINES + 1), 1, R.MINIFIED_LINES)
    lens = F.transform(lines, lambda x: F.length(x))
    longest = F.array_max(lens)
    avg = F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(lens)
    by_shape = (F.length(t) >= R.MINIFIED_MIN_CHARS) & (longest > R.MINIFIED_LINE_LEN) & (avg > R.MINIFIED_AVG_LEN)
    return _c(name).rlike(R.java_pattern(R.MINIFIED_NAME_PATTERN)) | F.coalesce(by_shape, F.lit(False))


def suffix(name: Column | str) -> Column:
    """Lower-cased path suffix with its dot; '' when the only dot leads the name."""
    return F.lower(F.regexp_extract(_c(name), r"^.+(\.[^.]+)$", 1))


def is_low_trust(path: Column | str, name: Column | str) -> Column:
    return _c(path).rlike(R.java_pattern(R.TEST_PATH_PATTERN)) | suffix(name).isin(*R.DOC_EXT)


def _class(body: str) -> str:
    """A regex for one character of a shell class (the text between brackets).
    Every character is written by its code, so none is special; reversed
    ranges hold nothing."""
    negated = body.startswith("!")
    chars = body[1:] if negated else body
    code = lambda c: f"\\x{{{ord(c):x}}}"
    out, i = [], 0
    while i < len(chars):
        if chars[i + 1:i + 2] == "-" and i + 2 < len(chars):
            if chars[i] <= chars[i + 2]:
                out.append(f"{code(chars[i])}-{code(chars[i + 2])}")
            i += 3
        else:
            out.append(code(chars[i]))
            i += 1
    if not out:
        return "." if negated else r"[^\x{0}-\x{10ffff}]"
    return f"[{'^' if negated else ''}{''.join(out)}]"


def glob_body(glob: str) -> str:
    """fnmatch-style glob → regex without anchors, for Java and RE2 alike
    (``*`` crosses ``/``).  Total: an unclosed class is literal text."""
    out, i, n = [], 0, len(glob)
    while i < n:
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            first = i + (glob[i:i + 1] == "!")
            end = glob.find("]", first + (glob[first:first + 1] == "]"))
            if end < 0:
                out.append("\\[")
            else:
                out.append(_class(glob[i:end]))
                i = end + 1
        else:
            out.append(ch if ch.isalnum() or ch in "_/" or ord(ch) > 127 else f"\\x{{{ord(ch):x}}}")
    return "".join(out)


def glob_to_regex(glob: str) -> str:
    """``glob_body`` for whole strings."""
    return "(?s)^(?:" + glob_body(glob) + ")\\z"


def glob_bodies(col: Column | str) -> Column:
    """``glob_body`` of globs held in a column; for columns of few rows, such
    as the patterns of ignore and policy files."""
    @F.pandas_udf("string")
    def convert(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None else glob_body(g))
    return convert(_c(col))


def glob_match(col: Column | str, glob: str) -> Column:
    return _c(col).rlike(glob_to_regex(glob))


def path_glob_match(path: Column | str, name: Column | str, glob: str) -> Column:
    """A rule glob: ``*`` matches all; a glob with ``/`` matches the relative
    path (or any suffix of it); otherwise the file name."""
    if glob == "*":
        return F.lit(True)
    if "/" in glob:
        return glob_match(path, glob) | glob_match(path, "*/" + glob)
    return glob_match(name, glob)


def newline_count(col: Column | str) -> Column:
    c = _c(col)
    return F.length(c) - F.length(F.regexp_replace(c, "\n", ""))
