"""Benchmark decontamination by winnowing (operator 4).

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z
lower-cased.  A window is `window` consecutive words of an item; an item of
fewer words, but not none, is one window.  A document word inside any
occurrence of a window is hit.

Method: of every `window - gram + 1` neighbouring `gram`-grams the least hash
is kept, so a shared window always shares a fingerprint.  A fixed 4 MB bit map
of the benchmark's fingerprints drops others where they arise; what is left
carries the words around it, is joined with the benchmark's fingerprints and
is extended left and right by comparing words.  Items shorter than a window
are found by the hash of all their words.

Defined results: null, empty and wordless texts have no words and no hits;
wordless items have no window; null item ids are not counted as items, but
their windows hit; repeated rows are rows of their own; empty tables give no
rows, or no hits; texts are read whole, a very long one in memory in proportion
to it; ties need no rule.  Only the id and text columns are read, so others may have
any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, map_batches, row_number, written
from codeaudit.llm.words import ALNUM, mix, minimisers, runs, words

#: Slots of the bit map: 2**25 bits, 4 MB, whatever the benchmark's size.
SLOT_BITS = 25

_HIT = "fp long, pos int, before string, after string"


def _fingerprints(h: np.ndarray, gram: int, window: int) -> np.ndarray:
    g = runs(h, gram)
    return minimisers(g, window - gram + 1)


def _context(raw: bytes, s: np.ndarray, e: np.ndarray, pos: int, n: int, reach: int) -> tuple[str, str]:
    """The `reach` folded words before and the `n + reach` from `pos` on."""
    fold = lambda i, j: " ".join(bytes(ALNUM[np.frombuffer(raw[a:b], np.uint8)]).decode("utf-8", "replace")
                                 for a, b in zip(s[i:j], e[i:j], strict=True))
    return fold(max(0, pos - reach), pos), fold(pos, min(len(s), pos + n + reach))


def _item_rows(gram: int, window: int):
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s, e, h = words(raw, ALNUM)
            if len(h) >= window:
                g = runs(h, gram)
                out += [(row, 0, int(g[p].view(np.int64)), *_context(raw, s, e, p, gram, window - gram))
                        for p in _fingerprints(h, gram, window)]
            elif len(h):
                n = len(h)
                out.append((row, n, int(mix(runs(h, n))[0].view(np.int64)), *_context(raw, s, e, 0, n, 0)))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()),
                                            strict=True)], names=["item_row", "short", "fp", "before", "after"])

    return rows


def _document_rows(gram: int, window: int, bits, lengths: list[int]):
    def known(h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64((1 << SLOT_BITS) - 1)
        table = bits.value
        return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0

    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        n_words, found = [], []
        for raw in b.column(2).to_pylist():
            s, e, h = words(raw, ALNUM)
            n_words.append(len(h))
            one = []
            g = runs(h, gram)
            p = _fingerprints(h, gram, window)
            p = p[known(g[p])]
            one += [(0, int(g[i].view(np.int64)), int(i), *_context(raw, s, e, i, gram, window - gram)) for i in p]
            for n in lengths:
                g = mix(runs(h, n))
                one += [(n, int(g[i].view(np.int64)), int(i), *_context(raw, s, e, i, n, 0))
                        for i in np.flatnonzero(known(g))]
            found.append([dict(zip(("short", "fp", "pos", "before", "after"), x, strict=True)) for x in one])
        kind = pa.list_(pa.struct([("short", pa.int32()), ("fp", pa.int64()), ("pos", pa.int32()),
                                   ("before", pa.string()), ("after", pa.string())]))
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n_words, pa.int64()), pa.array(found, kind)],
            names=[ROW, "doc_id", "n_words", "found"])

    return rows


def _same(a: str, b: str) -> str:
    """SQL: length of the common prefix of two word arrays."""
    return (f"aggregate(sequence(1, greatest(1, least(size({a}), size({b})))), 0, "
            f"(n, i) -> if(n = i - 1 and get({a}, i - 1) = get({b}, i - 1), i, n))")


def decontaminate(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5,
                  row: str | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, spans (array of hit word ranges
    `start` to `end`, exclusive, merged), n_hit, item_ids (distinct, as sorted
    strings), n_items and the row number `__row` (the
    column `row`, if named)."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    spark = docs.sparkSession
    ids = written(items.select(row_number(), F.col(item_id).alias("item_id"), F.col(item_text).alias("t")), "items")
    prints = written(map_batches(
        ids.select(ROW, F.col("t").cast("binary")), _item_rows(gram, window),
        "item_row long, short int, fp long, before string, after string"), "item-prints")
    slot = F.col("fp").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    filled = prints.select(F.shiftright(slot, 6).alias("w"),
                           F.expr(f"shiftleft(1L, cast(fp & {(1 << 6) - 1} as int))").alias("b")).groupBy("w").agg(
        F.bit_or("b").alias("b"))
    table = np.zeros(1 << (SLOT_BITS - 6), np.uint64)  # at most 2**19 rows come here
    for r in filled.toLocalIterator():
        table[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    lengths = sorted(r["short"] for r in prints.select("short").distinct().collect() if r["short"])  # below window
    bits = spark.sparkContext.broadcast(table)

    scanned = written(map_batches(
        docs.select(row_number(row), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")),
        _document_rows(gram, window, bits, lengths),
        f"{ROW} long, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, "
        "found array<struct<short:int, fp:long, pos:int, before:string, after:string>>"), "scanned")

    # Several items often share a fingerprint with its surroundings: compared once.
    theirs = prints.groupBy("short", "fp", F.col("before").alias("ib"), F.col("after").alias("ia")).agg(
        F.collect_set("item_row").alias("item_rows"))
    split = lambda c: f"filter(split({c}, ' '), x -> x <> '')"
    pairs = (scanned.filter(F.size("found") > 0).select(ROW, F.explode("found").alias("f")).select(ROW, "f.*")
             .join(theirs, ["short", "fp"])
             .withColumn("left", F.expr(_same(f"reverse({split('before')})", f"reverse({split('ib')})")))
             .withColumn("right", F.expr(_same(split("after"), split("ia")))))
    whole = F.when(F.col("short") > 0, F.col("right") >= F.col("short")).otherwise(
        (F.col("right") >= gram) & (F.col("left") + F.col("right") >= window))
    hits = written(pairs.filter(whole).select(
        ROW, (F.col("pos") - F.col("left")).alias("start"),
        (F.col("pos") + F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("right"))).alias("end"),
        "item_rows"), "hits")

    # Ranges of a row merged: a range opens where none before it reaches.
    w = Window.partitionBy(ROW).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = (hits.select(ROW, "start", "end").distinct()
              .withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
              .withColumn("k", F.sum("opens").over(w))
              .groupBy(ROW, "k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
              .groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
                                F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit")))
    named = (hits.select(ROW, F.explode("item_rows").alias("item_row")).distinct()
             .join(ids.select(F.col(ROW).alias("item_row"), F.col("item_id").cast("string").alias("i")), "item_row")
             .groupBy(ROW).agg(F.sort_array(F.collect_set("i")).alias("item_ids")))
    return (scanned.select(ROW, "doc_id", "n_words").join(merged, ROW, "left").join(named, ROW, "left")
            .select(ROW, "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int>>")).alias("spans"),
                    F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))
            .withColumn("n_items", F.size("item_ids").cast("long")))
