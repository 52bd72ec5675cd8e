"""Operator 12 against brute force."""
import random

from cases import documents  # noqa: F401
from codeaudit.llm.license_scan import BASE, TEMPLATES, Template, needed, rare_index, scan_licenses, split, _Vocabulary


def brute(rows, base=BASE, templates=TEMPLATES):
    out = []
    for i, text in rows:
        w, found = split(text or ""), []
        for n, t in enumerate((*base, *templates)):
            tw = split(t.text)
            for s in range(1 - len(tw), len(w)):
                m = sum(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(tw))
                span = w[max(s, 0):s + len(tw)]
                if m >= needed(t) and all(any(span[k:k + len(split(p))] == split(p) for k in range(len(span))) for p in t.phrases):
                    found.append((s, n, t.label, n < len(base), m, len(tw)))
        out.append((i, len(w), [(x[2], x[3], x[0], x[4], x[5]) for x in sorted(found)]))
    return sorted(out, key=str)


def result(df, **kw):
    return sorted(((r[0], r.n_words, [(p.label, p.base, p.start, p.matched, p.words) for p in r.places])
                   for r in scan_licenses(df, **kw).collect()), key=str)


def files(seed=6, n=150):
    r = random.Random(seed)
    filler = ["mit", "license", "the", "der", "Software", "public", "general", "é1", "x", "under", "version", "2", "3", "0"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts.append(" ".join(r.choice(filler) for _ in range(r.randrange(0, 20))))
            w = r.choice((*BASE, *TEMPLATES)).text.split()
            for _ in range(r.randrange(0, max(1, len(w) // 5))):
                w[r.randrange(len(w))] = r.choice(filler)
            a = r.choice([0, 0, 0, 1, len(w) // 8])
            parts.append(r.choice([" ", "  ", "-", "\n* "]).join(w[a:]).upper() if r.random() < .3 else " ".join(w[a:]))
        rows.append((i, r.choice([" ", ". "]).join(parts)))
    return rows


def test_brute_force(documents):
    rows = files() + [(900, None), (901, ""), (902, "--"), (None, "MIT License"), (903, "mit mit license license"), (903, "mit mit license license"),
                      (904, "mit license " * 200), (905, "General\nPublic-License, version 3")]
    want = brute(rows)
    assert result(documents(rows)) == want and result(documents(rows, 1)) == want
    labels = {p[0] for _, _, places in want for p in places}
    assert labels >= {t.label for t in TEMPLATES if t.label not in ("LGPL", "AGPL")} and any(p[2] < 0 for _, _, places in want for p in places)


def test_key_phrases_tell_relatives_apart(documents):
    gpl = next(t for t in TEMPLATES if t.label == "GPL-3.0" and len(t.text) > 100)
    ((_, _, places),) = result(documents([(1, gpl.text)]))
    assert {p[0] for p in places} == {"gpl", "GPL-3.0"}
    ((_, _, places),) = result(documents([(1, gpl.text.replace("version 3", "version three"))]))
    assert {p[0] for p in places} == {"gpl"}


def test_the_index_holds_one_word_more_than_may_miss():
    import numpy as np
    t = (Template("a", "one two three four five six seven eight nine ten", (), 80), Template("b", "two two", (), 100))
    v = _Vocabulary(t)
    index = rare_index(v, np.arange(len(v.hash))[::-1])
    assert [len(x) for x in index] == [3, 1] and sorted(w for w, _ in index[0]) == [7, 8, 9]


def test_empty_clashing_names_long_text_and_own_templates(documents, spark):
    assert result(documents([])) == []
    own = dict(base=(Template("z", "zeta eta", (), 100),), templates=())
    clash = documents([(1, "Zeta ETA")]).selectExpr("*", "1 as id", "2 as t", "3 as places", "4 as n_words")
    assert result(clash, **own) == [(1, 2, [("z", True, 0, 2, 2)])]
    text = spark.createDataFrame([("k", "w " * 1_500_000 + "zeta eta " + "w " * 1_500_000)], "doc_id string, text string")
    assert result(text, **own) == [("k", 3_000_002, [("z", True, 1_500_000, 2, 2)])]
