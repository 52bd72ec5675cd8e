"""N-gram Jaccard join by grouped prefixes (operator 6).

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased.  A document's
set is its distinct `shingle`-word shingles; with fewer words, the whole
sequence as one.  Two documents link when 100 * intersection >= percent *
union.  Shingles are compared by 64-bit hashes, equal sets by 128 bits.

Method: documents of equal sets are one class.  A first prefix filter over the
whole table leaves the classes that can have a partner at all: in hash order,
similar sets share a known number of the shingles of their long prefixes, and
sizes of similar sets fall into a common size bucket, so every document sends
its long prefix under its two buckets to counters of fixed size, and a class
stays only if enough of its own came twice.  Among these, exact frequencies
order the shingles (rarest first); classes of equal size and prefix form a
group, groups that share a prefix shingle and pass the size and position
filters are candidates, and their members are verified on whole sets.  In each
shingle's list every group is first verified against the group with the fewest
rare shingles; what that connects is not paired again, so a crowd of near
copies costs one check a member, while every pair between still unconnected
classes is.

Defined results: documents without words or text have the empty set and are
linked with nothing; repeated rows are equal documents; a component's id is
its smallest non-null doc_id (null if it has none); texts are read whole, a
very long one in memory in proportion to it; an empty table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import ROW, map_batches, row_number, written
from codeaudit.llm.components import components
from codeaudit.llm.words import SPACED, mix, runs, words

#: The counters: slices, each with so many bits for "seen" and "seen again",
#: and the bits a slice has in the map sent to all tasks (8 MB).  Fixed sizes;
#: a collision only lets a class through to the exact stage.
SLICE_BITS, SEEN_BITS, MAP_BITS = 8, 24, 18
_SALT = np.uint64(0xA0761D6478BD642F)


def shingles(raw: bytes | None, k: int) -> np.ndarray:
    h = words(raw, SPACED)[2]
    return np.unique(runs(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def _long_prefix(s: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in hash order, as many as a similar set may lack and
    a tenth of the set more."""
    n = len(s)
    return s[np.argsort(mix(s ^ _SALT))[:n - -(-percent * n // 100) + -(-n // 10)]]


def _least_shared(n: int, percent: int) -> int:
    """So many of its long prefix a set of `n` shares with a similar set's: of
    the smaller set's, a tenth of that set is left when all it may lack is
    taken away."""
    smaller = -(-percent * n // 100)
    return -(-smaller // 10)


def _bucket(n: int, percent: int) -> int:
    """Sizes of similar sets are in the same or neighbouring buckets."""
    return int(np.log(n) / -np.log(percent / 100 - 1e-9)) if percent < 100 else n


def _keys(prefix: np.ndarray, bucket: int) -> np.ndarray:
    return mix(prefix + np.uint64(bucket * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))


def _seen_twice(texts: DataFrame, k: int, percent: int) -> np.ndarray:
    """Bit map of the long-prefix shingles that different classes of a batch,
    or documents of different batches, have in one size bucket."""
    shift, mask = np.uint64(64 - SLICE_BITS), np.uint64((1 << SEEN_BITS) - 1)

    def send(batches):
        for b in batches:
            sets = {}
            for raw in b.column(0).to_pylist():
                s = shingles(raw, k)
                if len(s):
                    sets.setdefault(mix(s).sum(dtype=np.uint64), s)
            if sets:
                keys = np.concatenate([_keys(_long_prefix(s, percent), _bucket(len(s), percent) + i)
                                       for s in sets.values() for i in (0, 1)])
                keys.sort()
                cuts = np.searchsorted(keys, np.arange(1 << SLICE_BITS, dtype=np.uint64) << shift)
                low = ((keys >> np.uint64(32)) & mask).astype(np.uint32)
                parts = np.split(low, cuts[1:])
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(
                    [x.tobytes() for x in parts], pa.binary())], names=["slice", "keys"])

    def count(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                once, twice = held.setdefault(i, (np.zeros(1 << SEEN_BITS, bool), np.zeros(1 << MAP_BITS, bool)))
                keys, n = np.unique(np.frombuffer(raw, np.uint32), return_counts=True)
                again = keys[once[keys] | (n > 1)]
                twice[again & np.uint32((1 << MAP_BITS) - 1)] = True
                once[keys] = True
        for i, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array(
                [np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

    rows = texts.mapInArrow(send, "slice int, keys binary").repartitionById(1 << SLICE_BITS, F.col("slice")).mapInArrow(
        count, "slice int, bits binary").collect()  # a row a slice, 8 MB in all
    bits = np.zeros((1 << SLICE_BITS, 1 << (MAP_BITS - 3)), np.uint8)
    for r in rows:
        bits[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _may_match(s: np.ndarray, bits: np.ndarray, percent: int) -> bool:
    pre, least = _long_prefix(s, percent), _least_shared(len(s), percent)
    for i in (0, 1):
        keys = _keys(pre, _bucket(len(s), percent) + i)
        low = (keys >> np.uint64(32)) & np.uint64((1 << MAP_BITS) - 1)
        at = (keys >> np.uint64(64 - SLICE_BITS)).astype(np.int64), (low >> np.uint64(3)).astype(np.int64)
        if int(((bits[at] >> (low & np.uint64(7)).astype(np.uint8)) & 1).sum()) >= least:
            return True
    return False


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar enough."""
    x = sets.select(F.col("c").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("c").alias("b"), F.col("tokens").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").filter(
        100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                       percent: int = 85, row: str | None = None) -> DataFrame:
    """Per row of `docs`: `__row` (the column `row`, if named), doc_id,
    n_shingles, component_id and component_row (the row number that stands for
    the component: of its smallest doc_id, the smallest)."""
    spark = docs.sparkSession
    seen = spark.sparkContext.broadcast(_seen_twice(docs.select(F.col(text).cast("binary").alias("t")), shingle, percent))

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, tokens, known = [], [], [], set()
        for raw in b.column(2).to_pylist():
            s = shingles(raw, shingle)
            n.append(len(s))
            keys.append((int(mix(s).sum(dtype=np.uint64).view(np.int64)),
                         int(mix(s ^ _SALT).sum(dtype=np.uint64).view(np.int64))))
            new = len(s) and keys[-1] not in known and _may_match(s, seen.value, percent)
            known.add(keys[-1])
            tokens.append(s.view(np.int64) if new else np.zeros(0, np.int64))
        at = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
             pa.array([k[1] for k in keys], pa.int64()),
             pa.ListArray.from_arrays(at, pa.array(np.concatenate(tokens) if tokens else [], pa.int64()))],
            names=[ROW, "doc_id", "n_shingles", "k1", "k2", "tokens"])

    scanned = written(map_batches(
        docs.select(row_number(row), F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")), scan,
        f"{ROW} long, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_shingles long, k1 long, k2 long, "
        "tokens array<long>"), "scan")
    sets = written(scanned.filter(F.size("tokens") > 0).groupBy("k1", "k2").agg(F.first("tokens").alias("tokens"))
                   .withColumn("c", F.monotonically_increasing_id()), "sets")
    links = _links(sets.select("c", "tokens"), percent)

    reach = components(links)
    classes = scanned.filter("n_shingles > 0").groupBy("k1", "k2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least"))
    grouped = (sets.select("k1", "k2", "c").join(reach, F.col("c") == F.col("node")).select("k1", "k2", "component")
               .join(classes, ["k1", "k2"]))
    least = grouped.groupBy("component").agg(F.min("least").alias("linked"))
    named = classes.join(grouped.select("k1", "k2", "component").join(least, "component"), ["k1", "k2"], "left").select(
        "k1", "k2", F.coalesce("linked", "least").alias("of"))
    some = scanned.filter("n_shingles > 0").join(named, ["k1", "k2"]).select(
        ROW, "doc_id", "n_shingles", F.col("of.doc_id").alias("component_id"), F.col(f"of.{ROW}").alias("component_row"))
    return some.union(scanned.filter("n_shingles = 0").select(
        ROW, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col(ROW).alias("component_row")))


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs (a, b) of classes (c, tokens) that connect all that is
    connected."""
    n = F.size("tokens")
    one = sets.select("c", F.explode("tokens").alias("token"))
    often = one.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    # Shingles of one class only sort first; `u` counts them, `pre` has the others of the prefix.
    known = one.join(often, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    prefixes = written(
        sets.select("c", n.alias("n")).join(known, "c")
        .withColumn("u", F.col("n") - F.size("s"))
        .withColumn("p", F.expr(f"n - ({percent}L * n + 99) div 100 + 1"))
        .select("c", "n", "u", F.expr("transform(slice(s, 1, cast(greatest(p - u, 0) as int)), x -> x.token)").alias("pre"))
        .filter(F.size("pre") > 0), "prefixes")
    # Groups: equal size and equal prefix; one with shingles of its own is alone.
    key = [F.col("n"), F.col("pre"), F.when(F.col("u") > 0, F.col("c")).alias("own")]
    groups = written(prefixes.groupBy(*key).agg(F.min("c").alias("g"), F.min("u").alias("u"),
                                                F.collect_list("c").alias("members"))
                     .select("g", "n", "u", "pre", "members"), "groups")
    member = groups.select("g", F.explode("members").alias("c"))
    listed = groups.select("g", "n", "u", F.posexplode("pre").alias("i", "token")).select(
        "token", "g", "n", (F.col("u") + F.col("i")).alias("pos"), "u")

    def fits(a: str, b: str) -> str:
        return (f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) and "
                f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= ({percent}L * ({a}.n + {b}.n) + {99 + percent}) "
                f"div {100 + percent}")

    hubs = (listed.groupBy("token").agg(F.min(F.struct("u", "g", "n", "pos")).alias("h"), F.count("*").alias("k"))
            .filter("k > 1").select("token", F.col("h.g").alias("g"), F.col("h.n").alias("n"),
                                    F.col("h.pos").alias("pos")))
    star = listed.alias("x").join(hubs.alias("y"), "token").filter("x.g <> y.g").filter(fits("x", "y")).select(
        F.greatest("x.g", "y.g").alias("a"), F.least("x.g", "y.g").alias("b"))
    within = member.filter("c <> g").select(F.col("c").alias("a"), F.col("g").alias("b"))
    tried = written(star.union(within).distinct(), "tried")
    first = written(_verified(tried, sets, percent), "links")

    # What is still apart: pairs of groups that share a prefix shingle, not both of the hub's component.
    reach = components(first)
    placed = written(member.join(reach, F.col("c") == F.col("node"), "left").select(
        "g", "c", F.coalesce("component", "c").alias("comp")), "placed")
    comp = placed.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    at = listed.join(comp, "g")
    mixed = (at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h"),
                                     F.min(F.struct("u", "g", "lo", "hi")).alias("hub"))
             .filter("l <> h").select("token", F.when(F.col("hub.lo") == F.col("hub.hi"), F.col("hub.lo")).alias("main")))
    at = written(at.join(mixed, "token").withColumn("other", F.expr("not (main <=> lo and main <=> hi)")), "mixed")
    apart = "not (x.lo = x.hi and y.lo = y.hi and x.lo = y.lo)"
    pairs = at.filter("other").alias("x").join(at.alias("y"), "token").filter(
        "x.g <> y.g and (not y.other or x.g > y.g)").filter(apart).filter(fits("x", "y")).select(
        F.greatest("x.g", "y.g").alias("ga"), F.least("x.g", "y.g").alias("gb"))
    pairs = pairs.union(comp.filter("lo <> hi").select(F.col("g").alias("ga"), F.col("g").alias("gb"))).distinct()
    rest = (pairs.join(placed.select(F.col("g").alias("ga"), F.col("c").alias("a"), F.col("comp").alias("ca")), "ga")
            .join(placed.select(F.col("g").alias("gb"), F.col("c").alias("b"), F.col("comp").alias("cb")), "gb")
            .filter("ca <> cb").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
            .join(tried, ["a", "b"], "left_anti"))
    return first.union(_verified(rest, sets, percent))
