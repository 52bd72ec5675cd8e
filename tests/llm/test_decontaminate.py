"""Operator 4 against brute force."""
import random
import re

from cases import documents  # noqa: F401
from codeaudit.llm.decontaminate import decontaminate


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(rows, items, window=10):
    found = {}
    for i, t in items:
        w = split(t)
        for p in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[p:p + window]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, ids = split(t), set(), set()
        for n in {len(x) for x in found}:
            for p in range(len(w) - n + 1):
                got = found.get(tuple(w[p:p + n]))
                if got:
                    hit |= set(range(p, p + n))
                    ids |= got
        out.append((d, len(w), sorted(hit), sorted(str(i) for i in ids if i is not None)))
    return sorted(out, key=str)


def result(documents, spark, rows, items, **kw):
    df = decontaminate(documents(rows), spark.createDataFrame(items, "item_id long, text string"), **kw)
    return sorted(((r.doc_id, r.n_words, [q for s in r.spans for q in range(s.start, s.end)], list(r.item_ids)) for r in df.collect()
                   if r.n_hit == sum(s.end - s.start for s in r.spans) and r.n_items == len(r.item_ids)), key=str)


def test_brute_force(documents, spark):
    r = random.Random(8)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(30)]
    items += [(100, items[3][1]), (101, "Prefix " + items[5][1] + " suffix"), (102, "rare"), (103, "two rare"), (104, "aa aa aa aa aa aa aa aa aa aa aa aa"),
              (105, None), (None, "null id words " * 5), (106, "...!"), (107, "aa aa aa")]
    rows = []
    for i in range(200):
        parts = [" ".join(word() for _ in range(r.randrange(0, 30)))]
        for _ in range(r.randrange(0, 4)):
            w = split(r.choice(items)[1])
            a = r.randrange(0, len(w) + 1)
            parts += [r.choice([" ", ", ", "\n-- "]).join(w[a:a + r.randrange(0, 25)]).upper(), " ".join(word() for _ in range(r.randrange(0, 5)))]
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "aa " * 300), (None, "aa " * 12), (903, "aa " * 300)]
    want = brute(rows, items)
    assert result(documents, spark, rows, items) == want
    assert sum(bool(h) for _, _, h, _ in want) > 60
    assert result(documents, spark, rows, items, gram=3) == want


def test_edges(documents, spark):
    item = [(1, "one two three four five six seven eight nine ten eleven")]
    assert result(documents, spark, [], item) == []
    assert result(documents, spark, [(1, "a b")], []) == [(1, 2, [], [])]
    clash = documents([(1, item[0][1])]).selectExpr("*", "1 as fp", "2 as pos", "3 as __row", "4 as item_id")
    (r,) = decontaminate(clash, spark.createDataFrame([(1, item[0][1], 5)], "item_id long, text string, fp int")).collect()
    assert (r.n_hit, r.n_items) == (11, 1)
    long = " ".join(f"w{i}" for i in range(300_000))
    (r,) = decontaminate(documents([(1, long + " " + item[0][1])]), spark.createDataFrame(item, "item_id long, text string")).collect()
    assert [(s.start, s.end) for s in r.spans] == [(300_000, 300_011)]
