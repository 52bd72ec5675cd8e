"""Operator 2: held-out accuracy, spans, exact Viterbi paths."""
import random

import numpy as np
from pyspark.sql import functions as F

from cases import documents  # noqa: F401
from codeaudit.llm import language
from codeaudit.llm.language import Model, fit, keep_known, label

VOCABULARY = {"en": "the of and that with this house river walking quickly thought under", "de": "der die und nicht straße über mädchen gehen schnell gedanke fluss",
              "ru": "это дом река быстро мысль под над человек город улица", "el": "σπίτι ποτάμι γρήγορα σκέψη κάτω πόλη δρόμος άνθρωπος"}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY[lang].split()) for _ in range(n))


def corpus(documents):
    return documents([(i, text(x, 30, i)) for i in range(120) for x in [list(VOCABULARY)[i % 4]]]).withColumn(
        "lang", F.element_at(F.array(*map(F.lit, VOCABULARY)), (F.col("doc_id") % 4 + 1).cast("int")))


def test_spans_and_scripts(documents):
    model = fit(corpus(documents))
    parts = [("en", 12), ("de", 15), ("ru", 6), ("en", 11), ("el", 5)]
    mixed = ". ".join(text(x, n, 99 + i) for i, (x, n) in enumerate(parts))
    rows = {r.doc_id: r for r in label(documents([(1, mixed), (2, text("de", 9, 5).upper()), (3, "123 -- !!"), (4, None), (5, ""), (6, "日本語")]), model).collect()}
    spans = [(s.lang, s.end - s.start) for s in rows[1].spans]
    assert [x for x, _ in spans] == [x for x, _ in parts] and all(abs(a[1] - b[1]) <= 1 for a, b in zip(spans, parts, strict=True))
    assert rows[2].lang_pred == "de" and rows[2].score == 1.0
    assert all((rows[i].lang_pred, rows[i].score, rows[i].spans) == ("und", 0.0, []) for i in (3, 4, 5))
    assert rows[6].lang_pred in VOCABULARY and 0 <= rows[6].score <= 1


def test_best_paths():
    """The shortcut gives what plain Viterbi gives."""
    r = np.random.default_rng(4)
    m = Model(["a", "b", "c"], np.zeros((0, 3)), np.zeros((0, 3)), np.zeros((0, 3)), penalty=3.0)
    for _ in range(300):
        s = r.normal(size=(int(r.integers(1, 40)), 3)) + r.choice([0, 2]) * np.eye(3)[r.integers(0, 3)]
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - 3.0) + row
        path = m.path(s)
        value = s[np.arange(len(s)), path].sum() - 3.0 * (np.diff(path) != 0).sum()
        assert abs(value - best.max()) < 1e-9


def test_two_languages_over_a_third():
    """Two adjacent stretches of two languages, each within the penalty, against the language best in total."""
    m = Model(["c", "a", "b"], np.zeros((0, 3)), np.zeros((0, 3)), np.zeros((0, 3)))
    assert m.path(np.array([[0.0, 10, -20], [0, -20, 10]])).tolist() == [1, 2]
    r = np.random.default_rng(6)
    for _ in range(300):
        n = int(r.integers(1, 5))
        s = np.repeat([[0.0, 10, -20], [0, -20, 10], [0, 1, 1]], n, axis=0)[r.permutation(3 * n) if r.random() < 0.5 else slice(2 * n)] / n
        s = s + r.normal(size=s.shape)
        best = s[0].copy()
        for row in s[1:]:
            best = np.maximum(best, best.max() - m.penalty) + row
        path = m.path(s)
        assert abs(s[np.arange(len(s)), path].sum() - m.penalty * (np.diff(path) != 0).sum() - best.max()) < 1e-9


def test_held_out_accuracy(spark):
    from codeaudit.llm import queries
    got = queries.op2_language(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right >= 0.99 * n


def test_edges(documents):
    docs = corpus(documents)
    assert fit(docs.limit(0)) is None and fit(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in label(docs, None).collect()} == {("und", 0.0)}
    model = fit(docs.withColumn("lang", F.lit("xx")))
    assert {r.lang_pred for r in label(docs, model).collect()} == {"xx"}
    assert label(docs.limit(0), model).count() == 0
    long = documents([(1, text("ru", 300_000, 1) + " " + text("en", 100_000, 2))])
    (r,) = label(long, fit(docs)).collect()
    assert r.lang_pred == "ru" and len(r.spans) == 2
    extra = docs.selectExpr("*", "1 as t", "2 as score", "3 as __row", "4 as spans")
    assert keep_known(extra, fit(extra)).columns == extra.columns


def test_rejects_and_keeps(documents):
    docs = corpus(documents).union(documents([(900, None), (901, "12 34"), (902, ""), (None, text("en", 20, 3))]))
    kept = keep_known(docs, fit(docs)).collect()
    assert {r.doc_id for r in kept} == {*range(120), None}


def test_every_label_is_learned(documents):
    """More labels than are stored whole, the last of them with the fewest rows."""
    r = random.Random(8)
    names = [f"l{i:03}" for i in range(90)]
    alphabet = {x: r.sample("abcdefghijklmnopqrstuvwxyz", 7) for x in names}
    say = lambda x: " ".join("".join(r.choice(alphabet[x]) for _ in range(6)) for _ in range(60))
    rows = [(k * 100 + i, say(x), x) for i, x in enumerate(names) for k in range(2 if i < 80 else 1)]
    name = F.create_map(*[F.lit(v) for d, _, x in rows for v in (d, x)])
    model = fit(documents([(d, t) for d, t, _ in rows]).withColumn("lang", name[F.col("doc_id")]))
    assert model.langs == names
    new = [(i, say(x)) for i, x in enumerate(names)]
    got = {x.doc_id: x.lang_pred for x in label(documents(new), model).collect()}
    assert sum(got[i] == x for i, x in enumerate(names)) >= 85


def test_sparse_tables_and_many_labels(documents, monkeypatch):
    """Tables stored sparsely, small steps and the path by bits give the same labels."""
    docs = corpus(documents)
    mixed = [". ".join(text(x, 9, i + 10 * k) for k, x in enumerate(VOCABULARY)) for i in range(20)]
    want = fit(docs)
    plain = [(want.scores(t), want.path(want.scores(t)[0])) for t in mixed]
    monkeypatch.setattr(language, "DENSE", 2)
    monkeypatch.setattr(language, "_CELLS", 200)
    got = fit(docs)
    assert isinstance(got.two, language.Sparse)
    for t, ((s, sizes), path) in zip(mixed, plain, strict=True):
        mine, letters = got.scores(t)
        assert np.abs(mine - s).max() < 1e-3 and (letters == sizes).all() and (got.path(mine) == path).all()


def test_keeps_a_text_of_many_languages(documents):
    model = fit(corpus(documents))
    mixed = documents([(1, ". ".join(text(x, 20, 7) for x in ("en", "ru", "el", "de"))), (2, "12 34")])
    (r,) = label(mixed.filter("doc_id = 1"), model).collect()
    assert r.score < 0.5 and len(r.spans) == 4
    assert [x.doc_id for x in keep_known(mixed, model).collect()] == [1]
