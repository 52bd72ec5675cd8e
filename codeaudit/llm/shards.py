"""Sharding by histogram sort (operator 5), law `bytes`.

Documents are sorted by the hash of their text, so equal texts are a group
that stays together.  Splitters are found by counting, in rounds, the exact
bytes below candidate keys over all partitions and refining the candidates
until each splitter meets its tolerance; then the documents are exchanged
once.  Each shard is many key ranges, one task each.  Groups (or single texts) too large
to be cut around are placed on the emptiest shards first, the ranges fill up the
rest, and the rows of such a group are dealt over several tasks by their id.

Defined results: a null text has no bytes and size 1; null ids and repeated
rows are placed like others; a group larger than a shard's share makes its
shard larger, the others stay even; empty tables give no rows; other columns
are carried, whatever their names (`shard` and `slot` are replaced).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import written

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _histogram(digests: DataFrame, probes: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Exact bytes of the light rows below each probe."""
    held = digests.sparkSession.sparkContext.broadcast((probes, heavy))

    def count(batches):
        probes, heavy = held.value
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            k, s = b.column(0).to_numpy(), b.column(1).to_numpy()
            light = ~np.isin(k, heavy)
            np.add.at(total, np.searchsorted(probes, k[light], "right"), s[light])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    rows = digests.select("key", "size").mapInArrow(count, "at long, n long").groupBy("at").agg(
        F.sum("n").alias("n")).collect()  # a row for each gap between probes at most
    total = np.zeros(len(probes) + 1, np.int64)
    for r in rows:
        total[r["at"]] = r["n"]
    return np.cumsum(total)[:-1]


def _splitters(digests: DataFrame, targets: list[float], slack: list[float], total: int, heavy: np.ndarray) -> np.ndarray:
    """For each target a key below which about so many bytes lie, to `slack`
    or as close as whole groups allow."""
    lo = [(_LEAST, 0)] * len(targets)
    hi = [(_MOST, total)] * len(targets)
    best: list[tuple[float, int]] = [min((t, _LEAST), (total - t, _MOST)) for t in targets]
    live = [i for i, t in enumerate(targets) if best[i][0] > slack[i]]
    while live:
        probes: set[int] = set()
        for i in live:
            (a, x), (b, y) = lo[i], hi[i]
            guess = a + int((b - a) * ((targets[i] - x) / max(y - x, 1)))
            step = max((b - a) // 32, 1)
            probes |= {min(max(p, a + 1), b - 1) for p in (guess - step, guess, guess + step, (a + b) // 2)}
        sorted_probes = np.array(sorted(probes), np.int64)
        below = dict(zip(sorted_probes.tolist(), _histogram(digests, sorted_probes, heavy).tolist(), strict=True))
        keys = sorted(below)
        for i in live:
            t = targets[i]
            j = int(np.searchsorted([below[k] for k in keys], t, "right"))
            if j:
                lo[i] = max(lo[i], (keys[j - 1], below[keys[j - 1]]))
            if j < len(keys):
                hi[i] = min(hi[i], (keys[j], below[keys[j]]))
            best[i] = min(best[i], (abs(t - lo[i][1]), lo[i][0]), (abs(t - hi[i][1]), hi[i][0]))
        live = [i for i in live if best[i][0] > slack[i] and hi[i][0] - lo[i][0] > 1]
    return np.maximum.accumulate(np.array([k for _, k in best], np.int64)) if targets else np.zeros(0, np.int64)


def shard(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = 8, tolerance: float = 0.002,
          ranges: int = 16, range_bytes: int = 512 << 20) -> DataFrame:
    """`docs` with `shard` (int, from 0) and `slot` (long, gapless from 0 in its
    shard).  A shard is `ranges` key ranges, or more where they would exceed
    `range_bytes`."""
    spark = docs.sparkSession
    key = F.xxhash64(F.col(text))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    salt = F.xxhash64(F.col(doc_id))
    digests = written(docs.select(key.alias("key"), size.alias("size"), salt.alias("salt")), "digests")
    total = digests.agg(F.sum("size")).first()[0] or 0
    limit = max(tolerance * total / shards, 1)
    heavy = [(r["n"], r["key"]) for r in digests.groupBy("key").agg(F.sum("size").alias("n"))
             .filter(F.col("n") > limit).collect()]  # shards / tolerance rows at most
    heavy.sort(key=lambda x: (-x[0], x[1]))
    fill = [(0, s) for s in range(shards)]
    home: dict[int, int] = {}
    for n, k in heavy:
        b, s = heapq.heappop(fill)
        home[k] = s
        heapq.heappush(fill, (b + n, s))
    filled = [b for b, _ in sorted(fill, key=lambda x: x[1])]
    light = total - sum(filled)
    # The level to which the ranges fill all shards that lie below it.
    level, below = 0.0, sorted(filled)
    for m in range(1, shards + 1):
        level = (light + sum(below[:m])) / m
        if m == shards or level <= below[m]:
            break
    share = [max(0.0, level - b) for b in filled]
    parts = max(ranges, -(-total // (shards * range_bytes)))
    ends = np.cumsum([s / parts for s in share for _ in range(parts)])[:-1].tolist()
    even = total / shards
    slack = [tolerance * even / 2 if (i + 1) % parts == 0 else max(even / parts / 8, 1) for i in range(len(ends))]
    heavy_keys = np.array(sorted(home), np.int64)
    cuts = _splitters(digests, ends, slack, light, heavy_keys) if light else np.zeros(len(ends), np.int64)

    # Ranges first, then for each heavy group as many tasks as its bytes ask for.
    where = np.repeat(np.arange(shards), parts).tolist()
    first: dict[int, tuple[int, int]] = {}
    for n, k in heavy:
        tasks = max(1, -(-int(n) * parts // int(even + 1)))
        first[k] = (len(where), tasks)
        where += [home[k]] * tasks
    plan = spark.sparkContext.broadcast((cuts, heavy_keys, np.array([first[k] for k in heavy_keys.tolist()], np.int64)))

    @F.pandas_udf("int")
    def bucket(k: pd.Series, salt: pd.Series) -> pd.Series:
        cuts, heavy_keys, first = plan.value
        k, salt = k.to_numpy(), salt.to_numpy()
        out = np.searchsorted(cuts, k, "right")
        if len(heavy_keys):
            at = np.minimum(np.searchsorted(heavy_keys, k), len(heavy_keys) - 1)
            is_heavy = heavy_keys[at] == k
            out = np.where(is_heavy, first[at, 0] + salt % first[at, 1], out)
        return pd.Series(out.astype(np.int32))

    counts = {r["b"]: r["n"] for r in digests.select(bucket("key", "salt").alias("b")).groupBy("b").agg(
        F.count("*").alias("n")).collect()}  # a row for each task of the exchange
    before, run = [], [0] * shards
    for b, s in enumerate(where):
        before.append(run[s])
        run[s] += counts.get(b, 0)
    starts = spark.sparkContext.broadcast((np.array(where, np.int32), np.array(before, np.int64)))

    @F.pandas_udf("shard int, before long")
    def place(b: pd.Series) -> pd.DataFrame:
        where, before = starts.value
        return pd.DataFrame({"shard": where[b.to_numpy()], "before": before[b.to_numpy()]})

    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    dealt = (docs.select(F.struct(*keep).alias("d"), key.alias("key"), F.col(doc_id).alias("i"),
                         bucket(key, salt).alias("b"))
             .repartitionById(len(where), F.col("b")).sortWithinPartitions("key", "i")
             # Each task holds one bucket, so a row's place in its task is its place in the bucket.
             .withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    return dealt.withColumn("p", place("b")).select("d.*", F.col("p.shard").alias("shard"),
                                                    (F.col("p.before") + F.col("at")).alias("slot"))
