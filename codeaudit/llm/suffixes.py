"""Passage dedup by sparse suffix arrays (operator 10).

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased.  A passage is
`min_words` or more consecutive words that stand at two or more places of the
table.

Method: suffixes are kept only where the hash of `gram` words is the least of
`window` neighbouring ones, so equal passages keep suffixes at equal places:
every passage holds one at most `window - 1` words from its start, followed
there by `min_words - window + 1` shared words.  The kept suffixes are sorted
by the hash of that many first words; neighbours that agree mark a hash as
repeated, in a bit map of fixed size.  Around each suffix with a marked hash
the match is extended left and right: all runs of `min_words` words that hold
the suffix's place are compared over the whole table by their hashes, exactly,
and repeated runs merge into spans.

Defined results: null, empty and short texts have no spans; a passage that a
document repeats in itself counts as well; of equal passages those of the
smallest doc_id (nulls last), and there the first, are the original and the
others later copies; rows of equal id are originals alike; empty tables give
no rows; texts are read whole, a very long one in memory in proportion to it;
only the id (an integer) and text columns are read.  Runs are compared by 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, map_batches, row_number, written
from codeaudit.llm.words import SPACED, minimisers, runs, words

#: Bits of the map of repeated suffix hashes: 8 MB, whatever the input's size.
MAP_BITS = 26
_LAST = (1 << 63) - 1


def _suffixes(h: np.ndarray, gram: int, window: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the kept suffixes and the hashes of their first words."""
    key = runs(h, reach)
    at = minimisers(runs(h, gram), window)
    at = at[at < len(key)]
    return at, key[at]


def _marked(texts: DataFrame, gram: int, window: int, reach: int) -> np.ndarray:
    def send(batches):
        for b in batches:
            keys = [_suffixes(words(raw, SPACED)[2], gram, window, reach)[1] for raw in b.column(0).to_pylist()]
            keys, n = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_counts=True)
            # A hash that a batch holds more than once is sent twice, however often.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([keys, keys[n > 1]]).view(np.int64))], names=["key"])

    def neighbours(batches):
        """Repeated hashes of a sorted partition: equal ones are neighbours."""
        last = None
        for b in batches:
            k = b.column(0).to_numpy()
            if not len(k):
                continue
            before = np.concatenate([[k[0] - 1 if last is None else last], k[:-1]])
            last = k[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(k[before == k]))], names=["key"])

    kept = written(texts.mapInArrow(send, "key long"), "suffixes")
    repeated = kept.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(neighbours, "key long")
    slot = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    filled = repeated.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)  # at most 2**20 rows come here
    for r in filled.toLocalIterator():
        bits[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def repeated_passages(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_words: int = 50, gram: int = 8,
                      window: int = 33) -> DataFrame:
    """A row for each document that holds a repeated passage: `__row`, doc_id,
    n_words, spans (array of word ranges `start` to `end`, exclusive), n_repeated
    (words in spans), later (spans of later copies), n_later, and originals
    (ids of documents that hold the originals of later copies, sorted)."""
    reach = min_words - window + 1
    if not 0 < gram <= reach:
        raise ValueError("gram may not exceed min_words - window + 1")
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    bits = spark.sparkContext.broadcast(_marked(texts.select("t"), gram, window, reach))

    def extend(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for row, i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            h = words(raw, SPACED)[2]
            if len(h) < min_words:
                continue
            at, key = _suffixes(h, gram, window, reach)
            slot = key & np.uint64((1 << MAP_BITS) - 1)
            at = at[(bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0]
            if not len(at):
                continue
            # Runs that start up to window - 1 words before a marked place.
            n = len(h) - min_words + 1
            near = np.zeros(n + 1, np.int64)
            np.add.at(near, np.minimum(np.maximum(at - window + 1, 0), n), 1)
            np.add.at(near, np.minimum(at + 1, n), -1)
            start = np.flatnonzero(np.cumsum(near[:-1]) > 0)
            run = runs(h, min_words)[start]
            _, first, which = np.unique(run, return_index=True, return_inverse=True)
            again = np.ones(len(run), bool)
            again[first] = False
            for c, v in zip(out, (run.view(np.int64), np.full(len(run), row), np.full(len(run), _LAST if i is None else i),
                                  start, np.full(len(run), len(h)), again), strict=True):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)],
                                          names=["run", ROW, "id", "start", "n", "again"])

    found = map_batches(texts.select(row_number(), F.col("doc_id").cast("long").alias("doc_id"), "t"), extend,
                        f"run long, {ROW} long, id long, start int, n int, again boolean")
    same = found.groupBy("run").agg(F.count("*").alias("k"), F.min("id").alias("first")).filter("k > 1").select("run", "first")
    # Starts of a document, with the id of the original where they are later copies.
    per = found.join(same, "run").groupBy(ROW, "id", "n").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.when(F.col("again") | (F.col("first") < F.col("id")), F.col("first")).alias("of")))).alias("x"))

    def merge(b: pa.RecordBatch) -> pa.RecordBatch:
        def spans(start: np.ndarray) -> list[dict]:
            if not len(start):
                return []
            cut = np.flatnonzero(np.diff(start) > min_words) + 1
            return [{"start": int(s[0]), "end": int(s[-1]) + min_words} for s in np.split(start, cut)]

        rows = []
        for x in b.column("x").to_pylist():
            start = np.array([y["start"] for y in x])
            of = [y["of"] for y in x]
            later = np.array([o is not None for o in of])
            rows.append((spans(start), spans(start[later]), sorted({o for o in of if o is not None and o != _LAST})))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        all_spans, later, originals = zip(*rows, strict=True) if rows else ([], [], [])
        size = lambda c: pa.array([sum(s["end"] - s["start"] for s in x) for x in c], pa.int64())
        ids = b.column("id").to_pylist()
        return pa.RecordBatch.from_arrays(
            [b.column(ROW), pa.array([None if i == _LAST else i for i in ids], pa.int64()), b.column("n").cast(pa.int64()),
             pa.array(all_spans, kind), size(all_spans), pa.array(later, kind), size(later), pa.array(originals, pa.list_(pa.int64()))],
            names=[ROW, "doc_id", "n_words", "spans", "n_repeated", "later", "n_later", "originals"])

    span = "array<struct<start:int, end:int>>"
    return map_batches(per, merge, f"{ROW} long, doc_id long, n_words long, spans {span}, n_repeated long, later {span}, "
                       "n_later long, originals array<long>")
