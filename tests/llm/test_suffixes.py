"""Operator 10 against brute force."""
import random
import re

from cases import documents  # noqa: F401
from codeaudit.llm.suffixes import repeated_passages


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(rows, n=50):
    at = {}
    for k, (d, t) in enumerate(rows):
        w = split(t)
        for p in range(len(w) - n + 1):
            at.setdefault(tuple(w[p:p + n]), []).append((d is None, d or 0, k, p))
    all_words, later = {}, {}
    for places in at.values():
        if len(places) < 2:
            continue
        first = min(places)
        for none, d, k, p in places:
            all_words.setdefault(k, set()).update(range(p, p + n))
            own = min(x[3] for x in places if x[2] == k)
            if (none, d) > first[:2] or p > own:
                later.setdefault(k, set()).update(range(p, p + n))
    return sorted(((rows[k][0], len(split(rows[k][1])), sorted(w), sorted(later.get(k, ()))) for k, w in all_words.items()), key=str)


def result(df):
    flat = lambda spans: [q for s in spans for q in range(s.start, s.end)]
    return sorted(((r.doc_id, r.n_words, flat(r.spans), flat(r.later)) for r in df.collect()
                   if r.n_repeated == len(flat(r.spans)) and r.n_later == len(flat(r.later))), key=str)


def test_brute_force(documents):
    r = random.Random(9)
    word = lambda: f"w{r.randrange(500)}"
    passages = [[word() for _ in range(n)] for n in (48, 49, 50, 51, 60, 75, 120, 200)]
    passages.append(["same"] * 90)
    rows = []
    for i in range(120):
        w = [word() for _ in range(r.randrange(0, 80))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, 12)
            w += p[a if r.random() < 0.4 else 0:] + [word() for _ in range(r.randrange(0, 20))]
        rows.append((i * 37 % 211, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    rows += [(300, None), (301, ""), (302, " ".join(passages[6] * 2)), (None, " ".join(passages[4])), (303, "same " * 400)]
    want = brute(rows)
    assert result(repeated_passages(documents(rows))) == want and len(want) > 40
    assert result(repeated_passages(documents(rows), window=9)) == want


def test_edges(documents):
    assert repeated_passages(documents([])).count() == 0
    text = " ".join(f"x{i}" for i in range(60))
    assert repeated_passages(documents([(1, text), (2, text[:-30]), (3, None)])).count() == 2
    clash = documents([(1, text), (2, text)]).selectExpr("*", "1 as run", "2 as id", "3 as __row", "4 as start")
    (a, b) = sorted(repeated_passages(clash).collect(), key=lambda r: r.doc_id)
    assert (a.n_later, b.n_later, b.originals) == (0, 60, [1])
    alike = repeated_passages(documents([(1, text), (1, text)])).collect()
    assert [(r.n_repeated, r.n_later) for r in alike] == [(60, 0)] * 2
    long = " ".join(f"y{i}" for i in range(200_000))
    (a, b) = sorted(repeated_passages(documents([(1, long), (2, "head " + long)])).collect(), key=lambda r: r.doc_id)
    assert (a.n_repeated, b.n_later) == (200_000, 200_000)
