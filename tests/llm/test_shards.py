"""Operator 5: near equal bytes, whole groups, gapless slots."""
import random
from collections import defaultdict

from cases import documents  # noqa: F401
from codeaudit.llm.shards import shard


def check(rows, got, slack):
    assert sorted(map(str, ((x.doc_id, x.text) for x in got))) == sorted(map(str, rows))
    bytes_of, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in got:
        assert 0 <= x.shard < 8
        bytes_of[x.shard] += len((x.text or "").encode()) + 1
        slots[x.shard].append(x.slot)
        homes[x.text].add(x.shard)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    assert all(len(h) == 1 for h in homes.values())
    mean = sum(bytes_of.values()) / 8
    assert max(bytes_of.values()) <= mean + slack and min(bytes_of.get(s, 0) for s in range(8)) >= mean - slack
    return bytes_of


def test_balance(documents):
    r = random.Random(1)
    rows = [(i, "é" * r.randrange(0, 400) + str(r.random())) for i in range(4000)]
    rows += [(i, "copy of one text " * 20) for i in range(5000, 5150)] + [(9000, None), (9001, ""), (None, "x"), (9000, None)]
    df = documents(rows, 5)
    got = shard(df).collect()
    check(rows, got, 4000)
    again = {(x.doc_id, x.text): (x.shard, x.slot) for x in shard(df.repartition(3)).collect()}
    assert all(again[x.doc_id, x.text][0] == x.shard for x in got)


def test_giant_group(documents):
    """A group larger than a shard's share stays whole; the others are even."""
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"text {i:04}") for i in range(900)]
    got = shard(documents(rows)).collect()
    sizes = sorted(check(rows, got, 10**9).values())
    assert sizes[-1] == 9000 and sizes[-2] - sizes[0] < 200


def test_edges(documents):
    assert shard(documents([])).count() == 0
    assert [(x.slot,) for x in shard(documents([(1, None)])).collect()] == [(0,)]
    clash = documents([(1, "a"), (2, "b")]).selectExpr("*", "1 as key", "2 as b", "3 as shard", "4 as p", "5 as d")
    got = shard(clash)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "b", "p", "d", "shard", "slot"]
    assert {(x.key, x.b, x.p, x.d) for x in got.collect()} == {(1, 2, 4, 5)}
