"""Best-fit packing by a grouping genetic algorithm (operator 8).

A document is its token ids and then `end_id`.  Only documents longer than
`length` are cut, into pieces of `length` and a last one that may be shorter;
pieces are packed into as few sequences of at most `length` tokens as the
search finds.

Method: pieces are dealt at random into blocks of about `block_items`.  A
block's islands each hold a population of packings.  Crossover injects whole
well-filled sequences of one parent into the other, removes the other's
sequences that hold the same pieces and puts displaced pieces back by best
fit; mutation dissolves the emptiest sequences.  Between epochs each island's
elite moves to the next island.  The best packing of a block is taken; pieces
of sequences that are not well filled form the next level's blocks, until one
block is left.  Where that brings too little, only the emptiest tenth of each
block's sequences goes on, and where blocks are of hardly more than one
sequence, the next are twice as large.  Blocks and islands are rows, so no task
holds more than some blocks, and every level is a few narrow jobs.

Defined results: a null text is an empty one, of `end_id` alone; repeated rows
and null ids are packed like others; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import os
import random
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import map_batches, written

#: White space that str.split and the tokenizers' patterns may see differently.
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile("[" + "".join(map(chr, (
    0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: The contract's vocabulary file.
TOKENIZER = "word_bpe_49k.json"
#: Bytes of a generation of the words' cache, which holds two.
GENERATION_BYTES = 96 << 20
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_words: dict[str, _Words] = {}


def _plain_bytes() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


_ALPHABET = _plain_bytes()


def _byte_level(word: str) -> str | None:
    """A word (in lower case, if ASCII) in the byte-level alphabet as the
    tokenizers' pipeline would give it to the model; None where lower case or composition is not letter by
    letter, so only the pipeline itself can tell."""
    if word.isascii():
        return word if word.isalpha() else None
    low = word.lower()
    if not word.isalpha() or len(low) != len(word) or "\u03a3" in word or not unicodedata.is_normalized("NFC", low):
        return None
    return "".join(map(_ALPHABET.__getitem__, low.encode()))


class _Words(dict):
    """The ids, as bytes, of chunks between white space: a plain word and the
    ASCII marks after it, which the tokenizers' patterns part, are looked up
    apart, any other chunk is encoded whole.  What is not asked for while a
    generation fills up is forgotten with the one after it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.older, self.size = self.tokenizer.model, {}, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            if not chunk.isalpha():
                word = chunk.rstrip(_MARKS)
                ids = self[word] + self[chunk[len(word):]] if word != chunk and word.isalpha() else self.whole(chunk)
            elif chunk.isascii() and chunk != (low := chunk.lower()):
                ids = self[low]
            else:
                plain = _byte_level(chunk)
                ids = self.whole(chunk) if plain is None else array("I", [t.id for t in self.model.tokenize(plain)]).tobytes()
        self[chunk] = ids
        self.size += 200 + len(chunk) + len(ids)  # 200: the three objects and their places
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def text(self, text: str) -> bytes:
        if text.isascii():
            if any(c in text for c in _ODD_ASCII):
                return self.whole(text)
            chunks = (text if "<|" in text else text.lower()).split()  # special tokens are found before lower case
        elif _ODD_SPACE.search(text):
            return self.whole(text)
        else:
            chunks = text.split()
        ids = b"".join(map(self.__getitem__, chunks))
        if self.size > GENERATION_BYTES:
            self.older, self.size = dict(self), 0
            self.clear()
        return ids


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, for tokenizers that lower-case,
    part words from marks and never join characters across white space: words
    are encoded once and kept in a cache of bounded size."""
    if path not in _words:
        _words[path] = _Words(path)
    return [_words[path].text(t) for t in texts]


def encode(texts: list[str]) -> list[bytes]:
    """`encode_words` with the vocabulary file of the contract, found where the
    tokenizers' package puts it on each node."""
    import public_tokenizers
    return encode_words(texts, public_tokenizers.path(TOKENIZER))


# One block

def _pack(items: list[int], size: list[int], length: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """`bins` with each item put into the fullest one that has room."""
    bins = bins or []
    free = sorted((length - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(free, (size[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (length - size[i], len(bins) - 1))
        else:
            room, b = free.pop(at)
            bins[b].append(i)
            insort(free, (room - size[i], b))
    return bins


def fitness(bins: list[list[int]], size: list[int], length: int) -> float:
    """Fewer and, among as few, more unevenly filled sequences are better."""
    fill = [sum(size[i] for i in b) / length for b in bins]
    return -len(bins) + sum(f * f for f in fill) / max(len(fill), 1)


def _cross(a: list[list[int]], b: list[list[int]], size: list[int], length: int, r: random.Random) -> list[list[int]]:
    filled = sorted(b, key=lambda x: -sum(size[i] for i in x))
    chosen = r.sample(filled[:max(1, len(filled) // 2)], max(1, len(filled) // 4))
    inside = {i for x in chosen for i in x}
    stay = [list(x) for x in a if inside.isdisjoint(x)]
    held = inside.union(*stay) if stay else inside
    loose = sorted((i for x in a for i in x if i not in held), key=lambda i: -size[i])
    return _pack(loose, size, length, [list(x) for x in chosen] + stay)


def _mutate(a: list[list[int]], size: list[int], length: int, r: random.Random) -> list[list[int]]:
    by_fill = sorted(a, key=lambda x: sum(size[i] for i in x))
    n = max(1, len(a) // 20)
    out = by_fill[:n] + r.sample(by_fill[n:], min(n, len(a) - n))
    gone = {id(x) for x in out}
    loose = [i for x in out for i in x]
    r.shuffle(loose)
    loose.sort(key=lambda i: -size[i] + r.randrange(-8, 9))
    return _pack(loose, size, length, [list(x) for x in a if id(x) not in gone])


def evolve(size: list[int], length: int, population: list[list[list[int]]], seed: int, members: int,
           generations: int) -> list[list[list[int]]]:
    """The population, best first, after some generations; an empty one is founded."""
    r = random.Random(seed)
    score = lambda x: -fitness(x, size, length)
    best = -(-sum(size) // length)
    pop = list(population)
    if not pop:
        order = sorted(range(len(size)), key=lambda i: -size[i])
        pop.append(_pack(order, size, length))
        while len(pop) < members:
            pop.append(_pack(sorted(order, key=lambda i: -size[i] * r.uniform(0.7, 1.3)), size, length))
    for _ in range(generations):
        pop.sort(key=score)
        if len(pop[0]) <= best:
            break
        children = []
        for _ in range(members):
            a, b = r.sample(pop[:members], 2) if len(pop) > 1 else (pop[0], pop[0])
            child = _cross(a, b, size, length, r)
            children.append(_mutate(child, size, length, r) if r.random() < 0.5 else child)
        pop = sorted(pop + children, key=score)[:members]
    return sorted(pop, key=score)[:members]


def _flat(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _nested(flat: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(flat, default=-1) + 1)]
    for i, k in enumerate(flat):
        out[k].append(i)
    return [b for b in out if b]


_STATE = "block long, island int, items array<long>, sizes array<int>, pop array<array<int>>"


def _epoch(state: DataFrame, length: int, epoch: int, members: int, generations: int) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pops = []
        for block, island, _, sizes, pop in zip(*(c.to_pylist() for c in b.columns), strict=True):
            done = evolve(sizes, length, [_nested(x) for x in pop], hash((block, island, epoch)), members, generations)
            pops.append([_flat(x, len(sizes)) for x in done])
        return pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(pops, pa.list_(pa.list_(pa.int32())))],
                                          names=["block", "island", "items", "sizes", "pop"])

    return map_batches(state.select("block", "island", "items", "sizes", "pop"), run, _STATE)


def _level(left: DataFrame, count: int, length: int, level: int, *, block_items: int, islands: int, epochs: int, members: int,
           generations: int, well_filled: float, last: bool) -> DataFrame:
    """(item, size, block, bin, place, keep, emptiest) of one level; `keep` is
    false for the items of sequences to be packed again, `emptiest` true for
    those of the emptiest tenth of a block's sequences, of one at least."""
    blocks = max(1, count // block_items)
    state = (left.withColumn("block", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(blocks)))
             .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("item", "size"))).alias("x"))
             .select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.item").alias("items"),
                     F.col("x.size").alias("sizes"), F.expr("cast(array() as array<array<int>>)").alias("pop")))
    # A row is some work, so a task gets a few, evenly.
    tasks = min(-(-blocks * islands // 8), 20_000)
    task = F.expr(f"cast(pmod(block * {islands} + island, {tasks}) as int)")
    state = state.repartitionById(tasks, task)
    for epoch in range(epochs):
        state = written(_epoch(state, length, epoch, members, generations), f"pack-{level}-{epoch}")
        if epoch + 1 < epochs:
            elite = state.select("block", F.expr(f"(island + 1) % {islands}").alias("island"), F.expr("slice(pop, 1, 1)").alias("guests"))
            state = state.join(elite, ["block", "island"]).withColumn("pop", F.concat("pop", "guests")).drop("guests").repartitionById(
                tasks, task)

    def settle(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(7)]
        for block, solutions in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            items, sizes = solutions[0]["items"], solutions[0]["sizes"]
            bins = max((_nested(s["best"]) for s in solutions), key=lambda x: fitness(x, sizes, length))
            filled = [sum(sizes[i] for i in x) for x in bins]
            emptiest = set(sorted(range(len(bins)), key=filled.__getitem__)[:max(1, len(bins) // 10)])
            for k, x in enumerate(bins):
                keep = last or filled[k] >= well_filled * length
                at = 0
                for i in x:
                    for c, v in zip(rows, (items[i], sizes[i], block, k, at, keep, k in emptiest), strict=True):
                        c.append(v)
                    at += sizes[i]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)],
                                          names=["item", "size", "block", "bin", "place", "keep", "emptiest"])

    best = state.select("block", F.struct("island", "items", "sizes", F.col("pop")[0].alias("best")).alias("s")).groupBy("block").agg(
        F.sort_array(F.collect_list("s")).alias("s"))
    return map_batches(best, settle, "item long, size int, block long, bin int, place int, keep boolean, emptiest boolean")


def pack(docs: DataFrame, encode: Callable[[list[str]], list[bytes]], *, doc_id: str = "doc_id", text: str = "text",
         length: int = 4096, end_id: int = 1, block_items: int = 600, islands: int = 2, epochs: int = 2, members: int = 4,
         generations: int = 3, well_filled: float = 0.995, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id,
    offset and, with `with_ids`, ids (array of int).  `encode` gives the
    little-endian 32-bit ids of texts."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = [[] for _ in range(6)]
        for at in range(0, b.num_rows, 200):
            part = b.slice(at, 200)
            for d, raw in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                raw += end
                for k, start in enumerate(range(0, len(raw), 4 * length)):
                    one = raw[start:start + 4 * length]
                    for c, v in zip(rows, (d, k, start // 4, len(one) // 4, zlib.crc32(one), one if with_ids else None), strict=True):
                        c.append(v)
        kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32", "raw"])

    pieces = written(map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")), cut,
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, raw binary")
        .withColumn("item", F.monotonically_increasing_id()), "pieces")
    # Full pieces are sequences of their own.
    plan = [pieces.filter(F.col("length") == length).select("item", F.concat_ws(":", F.lit("f"), "item").alias("name"),
                                                            F.lit(0).alias("place"))]
    left = pieces.filter(F.col("length") < length).select("item", F.col("length").cast("int").alias("size"))
    count, level = left.count(), 0
    while count:
        last = count <= block_items
        done = written(_level(left, count, length, level, block_items=block_items, islands=islands, epochs=epochs, members=members,
                              generations=generations, well_filled=well_filled, last=last), f"packed-{level}")
        again = done.filter(~F.col("keep")).count()
        if not last and (again > 0.9 * count or level >= 12):  # little use in trying all once more
            done = done.withColumn("keep", F.expr("keep or not emptiest"))
            again = done.filter(~F.col("keep")).count()
            if again > 0.5 * count:
                block_items *= 2
        plan.append(done.filter("keep").select("item", F.concat_ws(":", F.lit(level), "block", "bin").alias("name"), "place"))
        left, count, level = done.filter(~F.col("keep")).select("item", "size"), again, level + 1
    placed = plan[0]
    for p in plan[1:]:
        placed = placed.unionByName(p)
    # Names are numbered without a global sort: a hash would do but for collisions.
    parts = F.split("name", ":")
    number = F.when(parts[0] == "f", parts[1].cast("decimal(38,0)") * 64 + 63).otherwise(
        (parts[1].cast("decimal(38,0)") * (1 << 20) + parts[2].cast("decimal(38,0)")) * 64 + parts[0].cast("decimal(38,0)"))
    out = pieces.join(placed, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", number.cast("long").alias("sequence_id"),
        F.col("place").cast("long").alias("offset"), "raw")
    if not with_ids:
        return out.drop("raw")

    def numbers(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in b.column("raw").to_pylist()]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names[:-1], "ids"])

    return map_batches(out, numbers, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema[:-1]) + ", ids array<int>")
