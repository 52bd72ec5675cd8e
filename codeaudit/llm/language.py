"""Language identification of mixed text (operator 2).

Words are runs of letters of the lower-cased text.  A word's script (by the
code point of its first letter) narrows the languages to those that write it;
a word's score for a language is the mean log-likelihood ratio of its 2- and
3-byte grams, summed over the word; Viterbi over the words, with a penalty for
each change of language, labels the spans.

The classifier is fitted on a bounded sample of the labelled rows, about
`per_lang` whole documents a language (all, if fewer), and on every label that
is not null; the tables of more than `DENSE` labels are stored sparsely.

Defined results: a null text or one without letters is `und` with score 0 and
no spans, and so is every text if there is nothing to learn from; null labels
are not learned; repeated rows are labelled alike; texts are read whole, a very
long one in memory in proportion to it; of languages with equal letters and of
equal paths the first by name is taken; empty tables give no rows; only the id,
text and label columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, map_batches, row_number

UNKNOWN = "und"

# First code points of the scripts' ranges (Unicode blocks).
SCRIPTS = ("other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai",
           "georgian", "hangul", "kana", "han")
RANGES = ((0x0000, "other"), (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
          (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"),
          (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
          (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
          (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
          (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
          (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0xFF21, "latin"),
          (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"))
_STARTS = np.array([a for a, _ in RANGES])
_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])

_GRAMS = 1 << 16
_WIDTH = 2 * _GRAMS + len(SCRIPTS)
_LETTERS = re.compile(r"[^\W\d_]+")
_ASCII = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))
_CHUNK = 1 << 20
#: Labels whose tables are stored whole, those that a task counts for at a
#: time, and numbers that a step of scoring holds.
DENSE, _COUNTED, _CELLS = 64, 64, 1 << 23


def _pieces(text: str | None):
    """Space-separated words of `text` as UTF-8, in pieces of bounded size."""
    for at in _cuts(text or ""):
        piece = text[at[0]:at[1]]
        if piece.isascii():
            yield b" " + piece.encode().translate(_ASCII) + b" "
        else:
            yield (" " + " ".join(_LETTERS.findall(piece.lower())) + " ").encode("utf-8", "replace")


def _cuts(text: str):
    at = 0
    while at < len(text):
        end = min(at + _CHUNK, len(text))
        while end < len(text) and text[end].isalpha() and end < at + 2 * _CHUNK:
            end += 1
        yield at, end
        at = end


def _grams(piece: bytes):
    """Starts and lengths of the words; the 2- and 3-byte grams that start at
    each byte from a word's preceding space to its last byte; scripts."""
    b = np.frombuffer(piece, np.uint8)
    inside = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    wide = np.full(len(b) + 2, 32, np.uint32)
    wide[:-2] = b
    two = (wide[:-2] << np.uint32(8)) | wide[1:-1]
    three = (((two << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    lead = b[start].astype(np.int64)
    nxt = [b[np.minimum(start + i, len(b) - 1)].astype(np.int64) & 63 for i in (1, 2, 3)]
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 31) << 6 | nxt[0], np.where(
        lead < 0xF0, (lead & 15) << 12 | nxt[0] << 6 | nxt[1], (lead & 7) << 18 | nxt[0] << 12 | nxt[1] << 6 | nxt[2])))
    script = _OF[np.searchsorted(_STARTS, point, "right") - 1]
    return start, end, two, three, script


class Sparse:
    """The table of log-likelihood ratios of grams and languages, by the grams
    that a language was seen with: per seen pair what the count adds, per
    language what an unseen gram has, per gram the mean."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray]):
        lang = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
        gram = np.concatenate(grams)
        order = np.argsort(gram, kind="stable")
        self.lang = lang[order]
        self.more = np.log(2.0 * np.concatenate(counts) + 1)[order].astype(np.float32)
        self.at = np.searchsorted(gram[order], np.arange(_GRAMS + 1))
        base = np.log(0.5) - np.log([n.sum() + 0.5 * _GRAMS for n in counts])
        self.base = base - base.mean()
        self.mean = np.bincount(gram[order], self.more, _GRAMS) / len(grams)

    def sums(self, codes: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
        """Scores (word x language) summed over grams `codes` of words `word`."""
        n = self.at[codes + 1] - self.at[codes]
        one = np.repeat(self.at[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out = np.bincount(np.repeat(word, n) * len(self.base) + self.lang[one], self.more[one], words * len(self.base))
        return (out.reshape(words, -1) - np.bincount(word, self.mean[codes], words)[:, None]
                + np.bincount(word, minlength=words)[:, None] * self.base)


@dataclass
class Model:
    langs: list[str]
    two: np.ndarray | Sparse
    three: np.ndarray | Sparse
    writes: np.ndarray  # script x language
    penalty: float = 12.0
    #: Added to a word's score for languages that don't write its script.
    foreign: float = -20.0

    def scores(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word x language) and letters-in-bytes of the words."""
        rows, sizes = [], []
        for piece in _pieces(text):
            start, end, two, three, script = _grams(piece)
            if not len(start):
                continue
            step = max(1, _CELLS // len(self.langs))
            cuts = np.unique(np.searchsorted(start, np.arange(0, len(two) + step, step)))
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                first, last = int(start[a]) - 1, int(end[z - 1])
                s = self._sums(two[first:last], three[first:last], start[a:z] - 1 - first, end[a:z] - first)
                known = self.writes[script[a:z]]
                rows.append(s + np.where(known.any(1)[:, None] & ~known, np.float32(self.foreign), np.float32(0)))
            sizes.append(end - start)
        if not rows:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(sizes)

    def _sums(self, two: np.ndarray, three: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scores of the words whose grams are from `start` to `end`."""
        if isinstance(self.two, Sparse):
            word = np.repeat(np.arange(len(start)), end - start)
            at = np.arange(len(word)) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)
            return ((self.two.sums(two[at], word, len(start)) + self.three.sums(three[at], word, len(start))) * 0.5).astype(np.float32)
        # From the space before a word to its last byte: words alternate with gaps in reduceat.
        at = np.column_stack([start, end]).ravel()
        per = (self.two[two] + self.three[three]) * np.float32(0.5)
        return np.add.reduceat(per, at[:-1] if at[-1] >= len(per) else at, axis=0)[::2]

    def _many(self, s: np.ndarray) -> np.ndarray:
        """The best path over many languages, a bit for each word and language."""
        v = s[0].astype(np.float64)
        changed, to = np.zeros((len(s), -(-s.shape[1] // 8)), np.uint8), np.zeros(len(s), np.int64)
        for i in range(1, len(s)):
            to[i] = v.argmax()
            t = v[to[i]] - self.penalty
            changed[i] = np.packbits(v < t)
            v = np.maximum(v, t) + s[i]
        out = np.empty(len(s), np.int64)
        at = out[-1] = int(v.argmax())
        for i in range(len(s) - 1, 0, -1):
            if changed[i, at >> 3] >> (7 - (at & 7)) & 1:
                at = int(to[i])
            out[i - 1] = at
        return out

    def path(self, s: np.ndarray) -> np.ndarray:
        """The best language of each word."""
        best = int(s.sum(0, dtype=np.float64).argmax())
        # A row of stretches of other languages costs as many changes as it has stretches, or one more, unless it
        # covers the whole text: then one less.  So the best path never changes where no stretch gains more than one
        # change costs, nor a first and a last stretch together.
        gain = np.cumsum(s.astype(np.float64) - s[:, best:best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        ends = gain[:-1].max() + (gain[-1] - gain[:-1]).max() if len(s) > 1 else 0
        if max((gain - low).max(), ends) <= self.penalty:
            return np.full(len(s), best)
        if s.shape[1] > DENSE:
            return self._many(s)
        v = s[0].tolist()
        history, penalty = [v], self.penalty
        for row in s[1:].tolist():
            t = max(v) - penalty
            v = [(a if a >= t else t) + b for a, b in zip(v, row, strict=True)]
            history.append(v)
        out = np.empty(len(s), np.int64)
        at = v.index(max(v))
        out[-1] = at
        for i in range(len(s) - 2, -1, -1):
            v = history[i]
            m = max(v)
            if v[at] < m - penalty:
                at = v.index(m)
            out[i] = at
        return out


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 5000) -> Model | None:
    """The classifier; None if there is nothing to learn from."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(key)).alias("h")).filter(
        "t is not null and lang is not null")
    count = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not count:
        return None
    langs = sorted(count)
    number = {x: i for i, x in enumerate(langs)}
    large = [x for x in langs if count[x] > per_lang]
    below = F.create_map(*[F.lit(v) for x in large for v in (x, max(1, int(per_lang / count[x] * (1 << 20))))]) if large else None
    sample = rows.select("t", "lang") if below is None else rows.filter(
        F.expr(f"pmod(h, {1 << 20})") < F.coalesce(below[F.col("lang")], F.lit(1 << 20))).select("t", "lang")

    def row(i: int, v: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(v)
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()),
                                           pa.array([v[at].tobytes()], pa.binary())], names=["lang", "at", "n"])

    def count_grams(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if x not in total and len(total) == _COUNTED:
                    for y, v in total.items():
                        yield row(number[y], v)
                    total.clear()
                mine = total.setdefault(x, np.zeros(_WIDTH, np.int64))
                for piece in _pieces(t):
                    start, end, two, three, script = _grams(piece)
                    if len(start):
                        used = np.zeros(len(two) + 1, np.int8)
                        used[start - 1] = 1
                        used[end] -= 1
                        used = np.cumsum(used[:-1]) > 0
                        mine[:_GRAMS] += np.bincount(two[used], minlength=_GRAMS)
                        mine[_GRAMS:2 * _GRAMS] += np.bincount(three[used], minlength=_GRAMS)
                        mine[2 * _GRAMS:] += np.bincount(script, minlength=len(SCRIPTS))
        for x, v in total.items():
            yield row(number[x], v)

    def add(batches):
        at, total = -1, np.zeros(_WIDTH, np.int64)
        for b in batches:  # by language
            for x, i, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if x != at:
                    if at >= 0:
                        yield row(at, total)
                    at, total = x, np.zeros(_WIDTH, np.int64)
                total[np.frombuffer(i, np.int32)] += np.frombuffer(v, np.int64)
        if at >= 0:
            yield row(at, total)

    kind, tasks = "lang int, at binary, n binary", min(len(langs), 1000)
    none = np.zeros(0, np.int64)
    counts = [(none, none)] * len(langs)
    for r in sample.mapInArrow(count_grams, kind).repartitionById(tasks, F.col("lang") % tasks).sortWithinPartitions("lang").mapInArrow(
            add, kind).toLocalIterator():  # a row a language, of 1.5 MB at most
        counts[r["lang"]] = np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int64)

    def part(lo: int, hi: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        inside = [(at >= lo) & (at < hi) for at, _ in counts]
        return [at[x] - lo for (at, _), x in zip(counts, inside, strict=True)], [n[x] for (_, n), x in zip(counts, inside, strict=True)]

    def whole(lo: int, hi: int) -> np.ndarray:
        out = np.zeros((len(langs), hi - lo))
        for v, at, n in zip(out, *part(lo, hi), strict=True):
            v[at] = n
        return out

    def table(lo: int, hi: int) -> np.ndarray | Sparse:
        if len(langs) > DENSE:
            return Sparse(*part(lo, hi))
        n = whole(lo, hi) + 0.5
        p = np.log(n / n.sum(1, keepdims=True))
        return np.ascontiguousarray((p - p.mean(0)).T.astype(np.float32))

    seen = whole(2 * _GRAMS, _WIDTH)
    writes = (seen > 0.005 * np.maximum(seen.sum(1, keepdims=True), 1)).T
    return Model(langs, table(0, _GRAMS), table(_GRAMS, 2 * _GRAMS), writes)


def _read(model: Model | None, text: str | None) -> tuple[str, float, list[dict]]:
    """Language, score and spans of a text."""
    s, sizes = model.scores(text) if model else (np.zeros((0, 0)), np.zeros(0))
    if not len(s):
        return UNKNOWN, 0.0, []
    path = model.path(s)
    share = np.bincount(path, sizes, len(model.langs))
    cut = np.flatnonzero(np.diff(path, prepend=-1))
    return model.langs[int(share.argmax())], float(share.max() / share.sum()), [
        {"start": a, "end": z, "lang": model.langs[path[a]]} for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(path)], strict=True)]


def label(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: `__row`, doc_id, lang_pred (the language of most letters),
    score (its share of the letters), spans (word ranges `start` to `end`,
    exclusive, with their language)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, spans = zip(*(_read(held.value, t) for t in b.column(2).to_pylist()), strict=True) if b.num_rows else ([], [], [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                           pa.array(spans, kind)], names=[ROW, "doc_id", "lang_pred", "score", "spans"])

    return map_batches(docs.select(row_number(), F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), run,
                       f"{ROW} long, doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double, "
                       "spans array<struct<start:int, end:int, lang:string>>")


def keep_known(docs: DataFrame, model: Model | None, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of `docs`, as they are, whose text has a language with a score
    of `least` or more (by default, any language: texts of many are kept); all,
    if there is no model."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text.lower())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        seen = (_read(held.value, t) for t in b.column(at).to_pylist())
        return b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in seen], pa.bool_()))

    return map_batches(docs, run, docs.schema)
