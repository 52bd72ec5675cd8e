"""Phrase collocations by prefix-free parsing (operator 13).

Texts are lower-cased (A-Z), split into pieces at `[.,;:!?\\x0A-\\x0D]` and those
into words `[^\\x20\\x09]+`; everything is counted per language.  A phrase of k
neighbouring words of a piece is scored at its weakest cut by
floor(1000 * a * n / (l * r)), where a, l and r count the phrase and its two
parts and n all words of the language.

Method: each text is parsed into chunks that begin where the hash of the next
`longest` - 1 words says so and end with the first words of the next chunk, so
equal passages give equal chunks wherever they stand.  The chunks' dictionary
(distinct chunks with their parse frequencies) is what is counted: a phrase in
it weighs as often as its chunk occurs, and belongs to the chunk that holds its
first word before the overlap, so an occurrence in an overlap counts once.
Pairs of words are counted first, by 64-bit hashes; those of too few occurrences
are left out of a bit map of fixed size, which lets a longer phrase pass only if
all its pairs may be frequent.  What passes is counted as text, exactly: the
bit map saves work and decides nothing.  Equal phrases of one block of about
4 MB are put together by 64-bit hashes before their text is sent.

Defined results: a null text is empty, a null language `und`; texts without
words give nothing; repeated rows count again; a very long text is parsed like
others, with memory in proportion to it; equal scores are ordered by count and
then phrase; empty tables give no rows; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.llm.common import written
from codeaudit.llm.words import _table, mix, runs, words

_MARKS = b".,;:!?\n\x0b\x0c\r"
#: Bytes of words; byte 0 shares its code with 0xFF, which no UTF-8 text holds.
_WORD = _table(lambda c: c not in b" \t" + _MARKS)
_WORD[0] = 255
_IS_MARK = np.isin(np.arange(256), np.frombuffer(_MARKS, np.uint8))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text that are handled at once (a longer text alone).
_BLOCK = 1 << 22
#: Bits of the map of frequent pairs: 8 MB, whatever the input's size.
MAP_BITS = 26
#: Parts of a key's rows in the joins by phrase and language.
_SALTS = 16


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about `_BLOCK` bytes."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _BLOCK:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class _Block:
    """The words of some texts: starts, ends, hashes, the text and the piece
    each stands in."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts).translate(_LOWER)
        self.start, self.end, self.hash = words(self.raw, _WORD)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.text = np.searchsorted(first, self.start, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(_IS_MARK[np.frombuffer(self.raw, np.uint8)]), self.start)

    def __len__(self) -> int:
        return len(self.start)


def _cuts(b: _Block, overlap: int, every: int, least: int) -> np.ndarray:
    """First words of the chunks: each text's first word, and words whose
    `overlap`-word window has a hash that is a multiple of `every`, `least`
    words or more after the last cut."""
    head = np.flatnonzero(np.r_[True, b.text[1:] != b.text[:-1]]) if len(b) else np.zeros(0, np.int64)
    mark = np.flatnonzero(runs(b.hash, overlap) % np.uint64(every) == 0)
    mark = mark[b.text[mark] == b.text[mark + overlap - 1]]
    out, last = [], 0
    heads = set(head.tolist())
    for t in np.union1d(head, mark).tolist():
        if t in heads or t - last >= least:
            out.append(t)
            last = t
    return np.array(out, np.int64)


def _parse(overlap: int, every: int, least: int):
    def run(batches):
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in _blocks(texts):
                b = _Block(texts[lo:hi])
                cut = _cuts(b, overlap, every, least)
                if not len(cut):
                    continue
                after = np.r_[cut[1:], len(b)]
                more = np.r_[b.text[cut[1:]] == b.text[cut[:-1]], False]
                tail = b.end[np.where(more, after + overlap, after) - 1]
                chunks = [b.raw[x:y] for x, y in zip(b.start[cut].tolist(), tail.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(b.text[cut] + lo)), pa.array(after - cut, pa.int64()), pa.array(chunks, pa.binary())],
                    names=["lang", "own", "chunk"])
    return run


def dictionary(docs: DataFrame, *, text: str = "text", lang: str = "lang", overlap: int = 4, every: int = 64,
               least: int = 16) -> DataFrame:
    """The distinct chunks of each language with the number of words that are
    theirs (`own`; the others overlap the next chunk) and their frequency `m`."""
    return docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"),
                       F.coalesce(F.col(lang), F.lit("und")).alias("lang")).mapInArrow(
        _parse(overlap, every, least), "lang string, own long, chunk binary").groupBy("lang", "own", "chunk").agg(
        F.count("*").alias("m"))


def _code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sum of its weights."""
    order = np.argsort(key)
    k = key[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], order[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


def _dictionary_blocks(batches):
    """(block, owned, weight and language code of each word, languages)."""
    for batch in batches:
        lang, own, chunk, m = (batch.column(i).to_pylist() for i in range(4))
        for lo, hi in _blocks(chunk):
            b = _Block(chunk[lo:hi])
            at = np.arange(len(b)) - np.searchsorted(b.text, b.text)
            codes = {x: _code(x) for x in set(lang[lo:hi])}
            yield (b, at < np.array(own[lo:hi], np.int64)[b.text], np.array(m[lo:hi], np.int64)[b.text],
                   np.array([codes[x] for x in lang[lo:hi]], np.uint64)[b.text], lang[lo:hi])


def _pair_keys(b: _Block, code: np.ndarray) -> np.ndarray:
    return mix(runs(b.hash, 2) + code[:-1]) if len(b) > 1 else np.zeros(0, np.uint64)


def _pair_counts(batches):
    for b, owned, weight, code, _ in _dictionary_blocks(batches):
        key = _pair_keys(b, code)
        ok = np.flatnonzero(owned[:len(key)] & (b.piece[1:] == b.piece[:-1])) if len(key) else np.zeros(0, np.int64)
        k, _, c = _sums(key[ok], weight[ok])
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c, pa.int64())], names=["k", "c"])


def _bit_map(keys: DataFrame) -> np.ndarray:
    slot = F.col("k").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    found = keys.select(F.shiftright(slot, 6).alias("w"), slot.alias("s")).groupBy("w").agg(
        F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    for r in found.toLocalIterator():  # at most 2**20 rows
        bits[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return bits


def _phrase_counts(longest: int, bits):
    def run(batches):
        for b, owned, weight, code, langs in _dictionary_blocks(batches):
            slot = _pair_keys(b, code) & np.uint64((1 << MAP_BITS) - 1)
            good = (bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
            of, out, count, size = [], [], [], []
            fit = np.ones(len(b), bool)
            for k in range(1, min(longest, len(b)) + 1):
                if k > 1:
                    fit = fit[:-1] & good[k - 2:]
                n = len(b) - k + 1
                at = np.flatnonzero(fit & owned[:n] & (b.piece[:n] == b.piece[k - 1:]))
                _, first, c = _sums(mix(runs(b.hash, k)[at] + code[at]), weight[at])
                at = at[first]
                of.append(b.text[at])
                count.append(c)
                size.append(np.full(len(at), k))
                out += [b" ".join(b.raw[x:y].split()) if k > 1 else b.raw[x:y]
                        for x, y in zip(b.start[at].tolist(), b.end[at + k - 1].tolist(), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(pa.array(np.concatenate(of))), pa.array(np.concatenate(size), pa.int32()),
                     pa.array(out, pa.binary()).cast(pa.string()), pa.array(np.concatenate(count), pa.int64())],
                    names=["lang", "size", "phrase", "c"])
    return run


def _salted_join(rows: DataFrame, other: DataFrame, on: list[str], spread: str) -> DataFrame:
    """Inner join with `other`, whose keys are unique: a key that many rows
    have is dealt over `_SALTS` parts by the column `spread`."""
    salts = F.explode(F.expr(f"sequence(0, {_SALTS - 1})")).alias("salt")
    return rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).join(
        other.select("*", salts), [*on, "salt"]).drop("salt")


def frequent_phrases(chunks: DataFrame, *, longest: int = 5, least: int = 100) -> DataFrame:
    """(lang, size, phrase, f) of the phrases of up to `longest` words with at
    least `least` occurrences, from a written `dictionary` whose overlap is
    `longest` - 1."""
    spark = chunks.sparkSession
    chunks = chunks.select("lang", "own", "chunk", "m")
    pairs = chunks.mapInArrow(_pair_counts, "k long, c long").groupBy("k").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
    bits = spark.sparkContext.broadcast(_bit_map(pairs))
    return chunks.mapInArrow(_phrase_counts(longest, bits), "lang string, size int, phrase string, c long").groupBy(
        "lang", "size", "phrase").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100,
                 percent: int = 100, top: int = 2000, every: int = 64) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank,
    phrase, a, l, r, n, score.  A phrase inside a longer one that occurs
    `percent` of a hundred times as often is left out."""
    chunks = written(dictionary(docs, text=text, lang=lang, overlap=longest - 1, every=every), "chunks")
    total = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("m")).alias("n"))
    known = written(frequent_phrases(chunks, longest=longest, least=least), "phrases")
    # a longer phrase around this one also holds one longer by one word, at least as frequent
    inside = known.filter("size > 2").select("lang", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"),
        F.lit(None).cast("int").alias("size"), F.lit(None).cast("long").alias("f"), F.col("f").alias("g"))
    left = known.filter("size > 1").select("lang", "phrase", "size", "f", F.lit(None).cast("long").alias("g")).unionByName(
        inside).groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("f").alias("a"), F.max("g").alias("g")).filter(
        F.col("size").isNotNull() & (F.col("g").isNull() | (100 * F.col("g") < percent * F.col("a")))).drop("g")
    cuts = left.select("lang", "phrase", "size", "a", F.explode(F.expr("sequence(1, size - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = _salted_join(cuts, part("first", "l"), ["lang", "first"], "rest")
    cuts = _salted_join(cuts, part("rest", "r"), ["lang", "rest"], "first")
    cuts = _salted_join(cuts, total, ["lang"], "phrase")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumn("product", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn(
        "parts", wide("l") * wide("r")).withColumn("score", F.expr("product div parts"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # the best of each part of a language first: the last ranking gets `_SALTS` times `top` rows of it at most
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("b.score"), F.desc("a"), "phrase"))
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = best.withColumn("rank", rank("lang", "salt")).filter(F.col("rank") <= top).drop("salt")
    return best.withColumn("rank", rank("lang")).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")
