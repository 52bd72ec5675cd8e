"""The pipeline's stages against brute force, each on its own input."""
import corpus_pipeline as P
import test_decontaminate
import test_jaccard
import test_lines
import test_packing
from pyspark.sql import functions as F

from codeaudit.llm.common import written

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", "en", "s", 0)]
    docs = written(docs.union(spark.createDataFrame(extra, docs.schema)).withColumn("d", F.lit(1)), "test-docs")
    before = pairs(docs)
    steps = dict(P.STAGES)
    assert list(steps) == ["language", "lines", "near", "clean", "packed"]

    kept = written(steps["language"](spark, docs, SF), "test-1")
    assert kept.columns == docs.columns
    assert pairs(kept) == [x for x in before if x[0] < 10**6]

    rows = pairs(kept)
    after = written(steps["lines"](spark, kept, SF), "test-2")
    want = test_lines.brute(rows)
    assert pairs(after) == [(i, want[i][0]) for i, _ in rows if not want[i][1] or want[i][0].strip()]
    assert after.columns == docs.columns and after.filter("n_chars <> length(text)").count() == 0

    rows = pairs(after)
    one = written(steps["near"](spark, after, SF), "test-3")
    assert pairs(one) == [x for x in rows if x[0] in {c for d, n, c in test_jaccard.brute(rows)}]
    assert one.columns == docs.columns

    rows = pairs(one)
    clean = written(steps["clean"](spark, one, SF), "test-4")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _, h, _ in test_decontaminate.brute(rows, items) if h}
    assert hit and pairs(clean) == [x for x in rows if x[0] not in hit]
    assert clean.columns == docs.columns

    rows = pairs(clean)
    n, least = test_packing.check(rows, steps["packed"](spark, clean, SF).collect(), 4096)
    assert n <= 1.02 * least + 1


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None,) * 5] * 3, docs.schema)
    for some in (docs.limit(0), nulls, docs.withColumn("lang", F.lit(None).cast("string")).limit(5)):
        d = some
        for name, f in P.STAGES:
            d = written(f(spark, d, SF), f"test-{name}")
        assert d.count() >= 0


def test_run(spark):
    assert P.run(spark, SF).count() > 50


def test_near_takes_five_words_and_four_fifths(spark):
    """Pairs of five-word similarity 0.8 or more are one, others are not."""
    words = lambda d, n: [f"w{d}x{i}" for i in range(n)]
    shingled = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    rows, kept = [], []
    for k, (n, more) in enumerate([(104, 25), (104, 26), (100, 22), (100, 30), (204, 50), (204, 51)]):
        one, two = words(k, n), words(k, n + more)
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
        same = len(shingled(one) & shingled(two)) >= 0.8 * len(shingled(one) | shingled(two))
        kept += [2 * k] if same else [2 * k, 2 * k + 1]
    assert len(kept) == 9
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [i for i, _ in pairs(P.near(spark, docs, SF))] == kept
