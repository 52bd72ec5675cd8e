"""Operator 6 against brute force."""
import random
import re

from cases import documents  # noqa: F401
from codeaudit.llm.components import components
from codeaudit.llm.jaccard import jaccard_components


def sets_of(rows, k=4):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=85):
    sets, up = sets_of(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_brute_force(documents):
    r = random.Random(5)
    rows, word = [], lambda: f"w{r.randrange(3000)}"
    common = [word() for _ in range(30)]
    for base in range(6):
        w = [word() for _ in range(r.randrange(20, 160))]
        rows += [(None, " ".join(w))]
        for _ in range(25):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                v[r.randrange(len(v))] = word()
            if r.random() < 0.3:
                v += common
            if r.random() < 0.3:
                v = v[r.randrange(0, 5):]
            rows.append((None, " ".join(v)))
    rows += [(None, " ".join([word() for _ in range(40)] + common)) for _ in range(40)]
    rows += [(None, t) for t in ("", " \n", "one", "One", "one two three", "ONE two\tthree", "a b c d", "a b c d e", None)]
    r.shuffle(rows)
    rows = [(i * 7 % 997, t) for i, (_, t) in enumerate(rows)]
    got = result(jaccard_components(documents(rows)))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 60  # many links


def test_edges(documents, spark):
    rows = [(None, None), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, ""), (5, "\x00  "), (6, "\x00  ")]
    assert result(jaccard_components(documents(rows))) == brute(rows)
    assert jaccard_components(documents([])).count() == 0
    clash = documents([(1, "a b c d"), (2, "a b c d")]).selectExpr("*", "1 as c", "2 as token", "3 as __row", "4 as g")
    assert result(jaccard_components(clash)) == [(1, 1, 1), (2, 1, 1)]


def test_long_text(documents):
    long = " ".join(f"x{i}" for i in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "short text of five words")]
    assert {(d, c) for d, _, c in result(jaccard_components(documents(rows)))} == {(1, 1), (2, 1), (3, 3)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (300, 300)]
    got = {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(101)} | {(200, 200), (201, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_prefixes_share_enough():
    """Sets at the threshold share at least the stated part of their long prefixes, in a common bucket."""
    import numpy as np

    from codeaudit.llm.jaccard import _bucket, _least_shared, _long_prefix
    r = np.random.default_rng(2)
    for _ in range(400):
        n, p = int(r.integers(1, 300)), int(r.choice([50, 80, 85, 100]))
        x = r.choice(1 << 40, n, replace=False).astype(np.uint64)
        m = int(r.integers(0, n // 3 + 1))
        y = np.concatenate([x[m:], r.choice(1 << 40, int(r.integers(0, 4)), replace=False).astype(np.uint64) + np.uint64(1 << 41)])
        both = n - m
        if 100 * both < p * (len(x) + len(y) - both):
            continue
        shared = len(np.intersect1d(_long_prefix(x, p), _long_prefix(y, p)))
        assert shared >= max(_least_shared(len(x), p), _least_shared(len(y), p)) >= 1
        assert abs(_bucket(len(x), p) - _bucket(len(y), p)) <= 1
