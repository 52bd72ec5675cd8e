"""Operator 13 against brute force."""
import random
import re
from collections import Counter

from cases import documents  # noqa: F401
from codeaudit.llm.collocations import collocations, dictionary


def pieces(t):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top=2000, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * a >= 100 * f[lang, w[i:i + k]]}
    out = []
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            s, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                             for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], s))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranked, seen = [], Counter()
    for x in out:
        seen[x[0]] += 1
        if seen[x[0]] <= top:
            ranked.append((x[0], seen[x[0]], *x[1:]))
    return ranked


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(parts)


def result(df, **kw):
    return sorted(((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations(df, **kw).collect()),
                  key=lambda x: (x[0], x[1]))


def corpus(seed=3, docs=500):
    r = random.Random(seed)
    common, rare = ["of", "the", "in", "Éa", "x\x00y", "don't"], [f"w{i}" for i in range(300)]
    stock = ["New York City hall", "as far as I know", "ad hoc", "point of no return", "à la carte"]
    rows = []
    for _ in range(docs):
        t = []
        for _ in range(r.randrange(0, 160)):
            t.append(r.choice(stock) if r.random() < .2 else r.choice(common) if r.random() < .6 else r.choice(rare))
            t.append(r.choice([" ", " ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "; ", "\x0b"]))
        rows.append((r.choice(["en", "en", "de", None, "und"]), "".join(t)))
    return rows


def test_brute_force(spark):
    rows = corpus()
    rows += [rows[5]] * 40 + [rows[6]] * 3  # repeated rows
    rows += [("en", None), ("en", ""), (None, "..."), ("fr", " \t "), ("xx", "same " * 3000), ("yy", "a b, " * 500)]
    want = brute(rows, 20)
    assert len(want) > 100 and {x[0] for x in want} >= {"en", "de", "und", "xx", "yy"}
    assert result(table(spark, rows), least=20) == want
    assert result(table(spark, rows, 1), least=20, every=2) == want
    assert result(table(spark, rows), least=20, top=5) == brute(rows, 20, 5)


def test_ties_lengths_and_long_text(spark):
    rows = [("en", "b a. a b. c a. a c. " * 30), ("en", "q r s t u v w. " * 50), ("en", " ".join(f"u{i % 7000}" for i in range(700_000)))]
    assert result(table(spark, rows), least=30) == brute(rows, 30)
    assert result(table(spark, rows), least=30, longest=2) == brute(rows, 30, longest=2)


def test_empty_and_clashing_names(spark):
    assert result(table(spark, [])) == []
    rows = [("en", "one two three. " * 40)]
    clash = table(spark, rows).selectExpr("*", "1 as phrase", "2 as own", "3 as m", "4 as salt", "5 as score", "6 as n")
    assert result(clash, least=10) == brute(rows, 10)


def test_dictionary_owns_each_word_once(spark):
    rows = corpus(9, 60)
    rows += rows[:20]
    chunks = dictionary(table(spark, rows), every=4, least=2).collect()
    assert sum(c.own * c.m for c in chunks) == sum(len(w) for _, t in rows for w in pieces(t))
    assert max(c.m for c in chunks) >= 2
