"""Operator 11 against brute force."""
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from codeaudit.llm.conversations import damage, repair_conversations, repaired_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    for v in by.values():
        v.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
    return by


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("blank" if not ink else "duplicate" if (r, x) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, fault):
    """Uniform-cost search over (row, initials' state), least (cost, audit) first."""
    grammar = re.compile("(s?(ua)+)?")
    prefix = lambda s: re.fullmatch("(s(ua)*u?|(ua)*u?)", s)
    state = lambda s: s if s in ("", "s") else s[-1]
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, said, kept = heapq.heappop(heap)
        if (i, state(said)) in best:
            continue
        best[i, state(said)] = 1
        if i == len(rows) and grammar.fullmatch(said):
            return cost, audit, "\n".join(f"{r}:{x}" for r, x in kept)
        moves = [(2, "I", 0, w, "") for w in ("user", "assistant")]
        if i < len(rows):
            _, r, x = rows[i]
            moves.append((3, "D", 1, None, None))
            if fault[i] not in ("blank", "duplicate"):
                t = fault[i] == "truncated"
                moves += [(t, "K", 1, r, x)] + [(2 + t, "R", 1, w, x) for w in ("user", "assistant")]
        for c, e, step, r, x in moves:
            if r is None:
                heapq.heappush(heap, (cost + c, audit + e, i + step, said, kept))
            elif r[:1] and prefix(said + r[:1]):
                heapq.heappush(heap, (cost + c, audit + e, i + step, said + r[:1], (*kept, (r, x))))
    raise AssertionError


def brute(rows, ids=()):
    out = []
    by = ordered(rows)
    for c in {*by, *ids}:
        v = by[c]
        f = faults(v)
        turns = [t for t, _, _ in v if t is not None]
        cost, audit, text = cheapest(v, f)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(f.count(k) for k in ("blank", "duplicate", "truncated")),
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False)), cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, parts=3, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in repair_conversations(df, **kw).collect()), key=str)


def talks(seed=4, n=120):
    r = random.Random(seed)
    texts = ["Hello.", "Hello.", "What?", "no end", "", " \t\n", "Sure!  ", "x\x0b.", " ", "é.", "x" * 3000 + "."]
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 14)):
            rows.append((c, r.choice([t, t, t, t + 3, 2, None]), r.choice(["user", "assistant"][t % 2:] + ["system", "user", "assistant", "tool", "", None, "ux"]),
                         r.choice([*texts, f"Say {t}.", f"Say {t}", None])))
    return rows


def test_brute_force(spark):
    rows = talks()
    rows += rows[:30] + [(None, 0, "user", "a."), (None, 1, "assistant", "b."), (None, None, "system", "s.")]
    want = brute(rows)
    assert result(spark, rows) == want
    assert len({x[7] for x in want}) > 60 and any("I" in x[7] for x in want)


def test_segments_are_put_together(spark):
    """A conversation over many segments and partitions, and duplicates across
    them, come out as if in one piece."""
    r = random.Random(2)
    rows = [(7 if r.random() < .6 else r.randrange(40), t, r.choice(["user", "assistant", "system", "other"]),
             r.choice([f"Say {r.randrange(60)}.", f"Say {r.randrange(60)}", "", f"Only {t}."])) for t in range(700)]
    rows += [(8, None, "user", "same.")] * 50
    want = brute(rows)
    assert result(spark, rows, segment_rows=5) == want
    assert result(spark, rows, segment_rows=1) == want
    assert result(spark, rows, segment_chars=40) == want


def test_repaired_rows_give_the_hash(spark):
    rows = talks(5, 30)
    by = defaultdict(list)
    for r in repaired_rows(spark.createDataFrame(rows, SCHEMA), segment_rows=4).collect():
        by[r.conv_id].append((r.pos, r.edit, f"{r.role}:{r.text}"))
    for c, *_, audit, sha in result(spark, rows):
        v = sorted(by[c])
        assert [p for p, _, _ in v] == list(range(len(v))) and "".join(e for _, e, _ in v) == audit.replace("D", "")
        assert hashlib.sha256("\n".join(x for _, _, x in v).encode()).hexdigest() == sha


def test_damage(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Text {c}, {t}! Yes?") for c in range(60) for t in range(4)]
    rows += [(None, None, None, None), (5, None, None, "x"), (501, 1, "user", None)]
    want = []
    for c, t, r, x in rows:
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if f:
            want += [(c, t, "user" if f == 4 else r, "" if f == 1 else re.sub("[.!?]", "", x) if f == 2 else x)] * (2 if f == 3 else 1)
    got = damage(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.conv_id, r.turn, r.role, r.text) for r in got.filter("present").collect()), key=str) == sorted(want, key=str)
    ids = {c for c, *_ in rows}
    have = sorted((tuple(r) for r in repair_conversations(got, present="present").collect()), key=str)
    assert have == brute(want, ids) and len(have) == len(ids)


def test_empty_clashing_names_and_text_ids(spark):
    assert result(spark, []) == []
    gone = spark.createDataFrame([(1, 1, "user", "x", False)], SCHEMA + ", present boolean")
    assert [tuple(r) for r in repair_conversations(gone, present="present").collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    clash = spark.createDataFrame([("k", 1, "user", "Hi.", 1, 2, 3)], "conv_id string, turn long, role string, text string, sig int, conv int, seg int")
    (r,) = repair_conversations(clash).collect()
    assert (r.conv_id, r.cost, r.audit) == ("k", 2, "KI")
