"""Conversation structure repair by a suffix-shared automaton (operator 11).

A conversation is its rows by turn (nulls first; rows of one turn by role and
the MD5 of their text).  A row's fault is the first of: blank (no character
other than `[\\x20\\x09-\\x0D]`), duplicate (its role and text were seen earlier
in the conversation), truncated (its last such character is none of `.!?`).
Its initial is the first character of its role.

Repair is the cheapest list of edits after which the initials read
`(s?(ua)+)?`: Keep (0), Rerole to user or assistant (2), Delete (3; required
for blank and duplicate rows), Insert an empty user or assistant row (2); a
truncated row that is not deleted costs 1 more.  The grammar's state (start,
after system, after user, after assistant) leaves one role to insert or rerole
to, so a list of edits is fixed by its initials, the audit; of equally cheap
ones the ASCII-least is taken.

Method: a row becomes one letter of a signature, for its role and fault.  Equal
suffixes of signatures are one node of an automaton, whoever's they are; a node
holds, per grammar state, the cost to go and the first edit of the best audit.
At a node different edits lead different ways, so the least letter among the
cheapest also begins the least audit, and a node needs no text of its audit.
The distinct signatures are sorted from their ends, so each task builds its
part of the automaton along one path: what neighbours share stays, the rest is
computed once (nodes on the border of two tasks once more).

A conversation may be as large as the table.  Rows are dealt by ranges and cut
into segments of bounded size; a segment that others follow is solved for the
four states at its end, and the segments' small matrices are put together per
conversation.  The output (and the SHA-256, which is sequential by nature) is
streamed in order of the rows.

Defined results: null roles and texts are one space; a null or empty role, and
any role of another initial, can not be kept; null ids are one conversation; a
conversation without (present) rows has zeros, an empty audit and the hash of
nothing; texts are read whole, however long; ties of turn are ordered as said,
repeated rows are duplicates; empty tables give no rows; other columns are not
read.  Turns are integers, ids of any type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import written

_SPACE = " \t\n\v\f\r"
#: Rows and characters of text after which a segment is cut.
SEGMENT_ROWS, SEGMENT_CHARS = 1 << 16, 1 << 22
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_STEP = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: Where an inserted or reroled row leads, and its role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = ("user", "user", "assistant", "user")
_FAR = 1 << 50
#: The ends of a segment: that of a conversation, or one of the four states.
FINAL = "end"
_UNITS = [",".join(str(0 if i == q else _FAR) for i in range(4)) for q in range(4)]

_SOLVED = "end string, sig string, every boolean, cost array<long>, audits array<string>, exits array<int>"


def _present(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    ok = F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)
    space = lambda c: F.when(ok, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("")
    return rows.select(F.col(conv_id).alias("conv"), F.when(ok, F.col(turn)).alias("turn"), space(role).alias("role"),
                       space(text).alias("text"), ok.alias("ok"))


class _Segment:
    def __init__(self):
        self.sig, self.rows, self.seen, self.size = [], [], set(), 0
        self.lo = self.hi = None
        self.turns = self.illegal = 0
        self.first = self.last = None

    def add(self, turn, role: str, text: str) -> None:
        body = text.rstrip(_SPACE)
        if not body:
            c = "b"
        elif (role, text) in self.seen:
            c = "d"
        else:
            self.seen.add((role, text))
            c = role[:1] if role[:1] in ("s", "u", "a") else "x"
            c = c if body[-1] in ".!?" else c.upper()
        self.sig.append(c)
        self.rows.append({"role": role, "text": text})
        self.size += len(text)
        if turn is not None:
            self.turns += turn != self.hi
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        if self.last is None:
            self.first = role[:1]
        else:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]


def _cut(schema: pa.Schema, rows: int, chars: int):
    """Segments of the sorted rows of a partition.  `whole`: surely all of a
    conversation; one that is cut, or stands first or last in its partition,
    may have other segments."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid, seg, out, held = TaskContext.get().partitionId(), 0, [], 0
        conv, cur, edge, many = None, None, True, False

        def put(whole: bool) -> None:
            nonlocal seg, held
            out.append({"conv": conv, "pid": pid, "seg": seg, "whole": whole, "sig": "".join(cur.sig), "rows": cur.rows,
                        "lo": cur.lo, "hi": cur.hi, "turns": cur.turns, "illegal": cur.illegal, "first": cur.first, "last": cur.last})
            seg += 1
            held += cur.size + 64 * len(cur.rows)

        for b in batches:
            for c, turn, role, text, ok in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if cur is not None and c != conv:
                    put(not edge and not many)
                    cur, edge, many = None, False, False
                elif cur is not None and (len(cur.rows) >= rows or cur.size >= chars):
                    put(False)
                    cur, many = None, True
                if held > chars or len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
                if cur is None:
                    conv, cur = c, _Segment()
                if ok:
                    cur.add(turn, role, text)
        if cur is not None:
            put(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _node(symbol: str, to: list[int]) -> tuple[list[int], str]:
    """(cost to go, first edit) per grammar state of the node whose first row
    is `symbol`, from the costs of the node after it."""
    cost, edit = [3 + x for x in to], ["D"] * 4
    low = symbol.lower()
    if low not in "bd":
        extra = symbol != low
        step = _STEP.get(low, {})
        for q in range(4):
            for c, e in (((to[step[q]] + extra, "K"),) if q in step else ()) + ((2 + extra + to[_NEXT[q]], "R"),):
                if (c, e) < (cost[q], edit[q]):
                    cost[q], edit[q] = c, e
    return _inserted(cost, edit)


def _inserted(cost: list[int], edit: list[str]) -> tuple[list[int], str]:
    """The same with insertions before the row: after two of them a state
    between turns is back, so one round over user and assistant is enough."""
    user, assistant = cost[_USER], cost[_ASSISTANT]
    for q, via in ((_USER, assistant), (_ASSISTANT, user)):
        if (2 + via, "I") < (cost[q], edit[q]):
            cost[q], edit[q] = 2 + via, "I"
    for q in (_START, _SYSTEM):
        if (2 + cost[_USER], "I") < (cost[q], edit[q]):
            cost[q], edit[q] = 2 + cost[_USER], "I"
    return cost, "".join(edit)


def _end(end: str) -> tuple[list[int], str]:
    """The node after the last row; "." ends the segment."""
    if end == FINAL:
        return _inserted([0, _FAR, _FAR, 0], [".", ".", ".", "."])
    return [int(x) for x in end.split(",")], "...."


def _walk(path: list[tuple[list[int], str]], back: str, q: int) -> tuple[str, int]:
    """The best audit from state `q` at the top of `path`, and the state that
    it ends in."""
    at, out = len(back), []
    while (e := path[at][1][q]) != ".":
        out.append(e)
        if e == "K":
            q = _STEP[back[at - 1].lower()][q]
        elif e != "D":
            q = _NEXT[q]
        at -= e != "I"
    return "".join(out), q


def _solve(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, before, path = None, "", []
        for b in batches:
            out, held = [], 0
            for e, back, every in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if e != end:
                    end, before, path = e, "", [_end(e)]
                n = min(len(back), len(before))
                if back[:n] != before[:n]:
                    n = next(i for i in range(n) if back[i] != before[i])
                del path[n + 1:]
                for c in back[n:]:
                    path.append(_node(c, path[-1][0]))
                before = back
                done = [_walk(path, back, q) for q in range(4 if every else 1)]
                out.append({"end": e, "sig": back[::-1], "every": every, "cost": path[-1][0],
                            "audits": [a for a, _ in done], "exits": [q for _, q in done]})
                held += len(back)
                if held > SEGMENT_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def solved(keys: DataFrame) -> DataFrame:
    """Cost to go, audits and last states of distinct (end, sig, every), from
    the start state or, with `every`, from each grammar state."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    back = keys.select("end", F.reverse("sig").alias("back"), "every")
    return back.repartitionByRange(n, "end", F.substring("back", 1, 200)).sortWithinPartitions("end", "back", "every").mapInArrow(
        _solve(_arrow(_SOLVED)), _SOLVED)


def _lookup(wanted: DataFrame) -> DataFrame:
    """`wanted` (pid, end, sig, every, ...) with the columns of `solved`: first
    one row a partition and signature, so a frequent one joins in few rows."""
    local = written(wanted.select("pid", "end", "sig", "every").distinct(), "signatures")
    found = solved(local.select("end", "sig", "every").distinct())
    each = local.join(found, ["end", "sig", "every"])
    return wanted.join(each, ["pid", "end", "sig", "every"])


def _later_copies(open_: DataFrame) -> DataFrame:
    """(pid, seg, later): rows of segments whose role and text an earlier
    segment of the conversation has.  A segment has each at most once here."""
    each = open_.select("conv", "pid", "seg", "sig", F.posexplode("rows").alias("pos", "r")).filter(
        ~F.expr("substring(sig, pos + 1, 1)").isin("b", "d"))
    key = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")), F.lit("\n"),
                         F.length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")))
    each = written(each.select(key.alias("key"), F.struct("pid", "seg").alias("s"), "pos"), "copies")
    first = each.groupBy("key").agg(F.min("s").alias("s0"), F.count("*").alias("n")).filter("n > 1")
    return each.join(first, "key").filter("s <> s0").groupBy("s").agg(F.collect_list("pos").alias("later")).select("s.*", "later")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for sig, later in zip(b.column("sig").to_pylist(), b.column("later").to_pylist(), strict=True):
            if later:
                s = bytearray(sig, "ascii")
                for i in later:
                    s[i] = ord("d")
                sig = s.decode()
            out.append(sig)
        yield b.drop_columns(["sig", "later"]).append_column("sig", pa.array(out, pa.string()))


def _backward(parts):
    """Ends of a conversation's segments from their matrices, last to first."""
    import pandas as pd
    parts = parts.sort_values(["pid", "seg"]).reset_index(drop=True)
    ends, after = [], None
    for m in reversed(parts["cost"].tolist()):
        if after is None:
            ends.append(FINAL)
            after = list(m[0])
        else:
            low = min(after)
            ends.append(",".join(str(x - low) for x in after))
            after = [min(int(m[j][q]) + after[j] for j in range(4)) for q in range(4)]
    return pd.DataFrame({"conv": parts["conv"], "pid": parts["pid"], "seg": parts["seg"], "sig": parts["sig"], "end": ends[::-1]})


def _forward(parts):
    """Audits of a conversation's segments, each from the state the one before
    it ends in."""
    import pandas as pd
    parts = parts.sort_values(["pid", "seg"]).reset_index(drop=True)
    q, audits = _START, []
    for a, e in zip(parts["audits"], parts["exits"], strict=True):
        audits.append(a[q])
        q = int(e[q])
    return pd.DataFrame({"conv": parts["conv"], "pid": parts["pid"], "seg": parts["seg"], "sig": parts["sig"], "audit": audits})


def _audited(segments: DataFrame, kind: str) -> DataFrame:
    """(conv, pid, seg, sig, audit) of every segment."""
    small = segments.select("conv", "pid", "seg", "sig")
    key = small.columns
    one = small.filter(segments["whole"])
    open_ = segments.filter(~F.col("whole"))
    parts = open_.select(*key).join(_later_copies(open_), ["pid", "seg"], "left").select(*key, "later")
    parts = written(parts.mapInArrow(_marked, f"conv {kind}, pid int, seg long, sig string"), "open")
    # the first of the small matrices: of the segments' costs from each state, to each state at their ends
    last = parts.groupBy("conv").agg(F.max(F.struct("pid", "seg")).alias("last"))
    tagged = parts.join(last, parts["conv"].eqNullSafe(last["conv"])).select(parts["*"], (F.struct("pid", "seg") == F.col("last")).alias("final"))
    ends = F.when(F.col("final"), F.array(F.lit(FINAL))).otherwise(F.array(*map(F.lit, _UNITS)))
    wanted = tagged.select(*key, F.posexplode(ends).alias("unit", "end"), F.lit(True).alias("every"))
    matrices = _lookup(wanted).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("unit", "cost"))).alias("m")).select(
        *key, F.col("m.cost").alias("cost"))
    following = written(matrices.groupBy("conv").applyInPandas(
        _backward, f"conv {kind}, pid int, seg long, sig string, end string"), "ends")
    found = written(_lookup(one.withColumn("end", F.lit(FINAL)).withColumn("every", F.lit(False)).unionByName(
        following.withColumn("every", F.lit(True)))), "audits")
    chosen = found.filter("every").select(*key, "audits", "exits").groupBy("conv").applyInPandas(
        _forward, f"conv {kind}, pid int, seg long, sig string, audit string")
    return found.filter("not every").select(*key, F.col("audits")[0].alias("audit")).unionByName(chosen)


class _Conversation:
    def __init__(self, conv):
        self.conv, self.q, self.cost, self.hash, self.pos = conv, _START, 0, hashlib.sha256(), 0
        self.audit, self.counts = [], [0, 0, 0, 0]
        self.lo = self.hi = self.last = None
        self.turns = 0

    def follow(self, sig: str, audit: str, seg: dict) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the repaired rows of the next segment."""
        c = self.counts
        c[0], c[1], c[2] = c[0] + sig.count("b"), c[1] + sig.count("d"), c[2] + sum(x.isupper() for x in sig)
        c[3] += seg["illegal"] + (self.last is not None and seg["first"] is not None
                                  and self.last + seg["first"] not in ("su", "ua", "au"))
        self.last = self.last if seg["last"] is None else seg["last"]
        if seg["lo"] is not None:
            self.turns += seg["turns"] - (seg["lo"] == self.hi)
            self.lo = seg["lo"] if self.lo is None else self.lo
            self.hi = seg["hi"]
        self.audit.append(audit)
        rows, i = seg["rows"], 0
        for e in audit:
            if e == "I":
                role, text, add = _ROLE[self.q], "", 2
            else:
                role, text, fault = rows[i]["role"], rows[i]["text"], sig[i].isupper()
                i += 1
                if e == "D":
                    self.cost += 3
                    continue
                add = fault + 2 * (e == "R")
                role = _ROLE[self.q] if e == "R" else role
            self.q = _STEP[role[0]][self.q] if e == "K" else _NEXT[self.q]
            self.cost += add
            self.hash.update(f"{'\n' if self.pos else ''}{role}:{text}".encode())
            self.pos += 1
            yield e, role, text

    def row(self) -> dict:
        blank, duplicate, truncated, illegal = self.counts
        return {"conv": self.conv, "gaps": 0 if self.lo is None else self.hi - self.lo + 1 - self.turns, "blank": blank,
                "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": self.cost,
                "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _stream(schema: pa.Schema, each_row: bool):
    """Conversations, or their repaired rows, from segments in order, each
    after its audit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, held, out, size = None, None, [], 0
        for b in batches:
            for r in range(b.num_rows):
                x = {n: b.column(n)[r].as_py() for n in ("conv", "kind", "sig", "audit", "seg_")}
                if cur is None or x["conv"] != cur.conv:
                    if cur is not None and not each_row:
                        out.append(cur.row())
                    cur = _Conversation(x["conv"])
                if x["kind"] == 0:
                    held = x["sig"], x["audit"]
                    continue
                for e, role, text in cur.follow(*held, x["seg_"]):
                    if each_row:
                        out.append({"conv": cur.conv, "pos": cur.pos - 1, "edit": e, "role": role, "text": text})
                        size += len(text)
                if size > SEGMENT_CHARS or len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if cur is not None and not each_row:
            out.append(cur.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _repaired(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None, ddl: Callable[[str], str],
              each_row: bool, segment_rows: int, segment_chars: int) -> DataFrame:
    kind = rows.select(conv_id).schema[0].dataType.simpleString()
    base = _present(rows, conv_id, turn, role, text, present).select(
        "*", F.md5(F.col("text").cast("binary")).alias("h"), F.monotonically_increasing_id().alias("salt"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may be split anywhere: the salt deals them out
    ordered = base.repartitionByRange(n, "conv", "turn", "role", "h", "salt").sortWithinPartitions("conv", "turn", "role", "h")
    cut = (f"conv {kind}, pid int, seg long, whole boolean, sig string, rows array<struct<role:string,text:string>>, "
           "lo long, hi long, turns long, illegal long, first string, last string")
    segments = written(ordered.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", "ok").mapInArrow(
        _cut(_arrow(cut), segment_rows, segment_chars), cut), "segments")
    audits = _audited(segments, kind)
    body = F.struct("rows", "lo", "hi", "turns", "illegal", "first", "last")
    both = segments.select("conv", "pid", "seg", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("sig"),
                           F.lit(None).cast("string").alias("audit"), body.alias("seg_")).unionByName(
        audits.select("conv", "pid", "seg", F.lit(0).alias("kind"), "sig", "audit"), allowMissingColumns=True)
    out = ddl(kind)
    return both.repartition(n, "conv").sortWithinPartitions("conv", "pid", "seg", "kind").mapInArrow(
        _stream(_arrow(out), each_row), out).withColumnRenamed("conv", conv_id)


def repair_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         present: str | None = None, segment_rows: int = SEGMENT_ROWS,
                         segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Per conversation: faults (gaps of turns, blank, duplicate, truncated,
    illegal neighbours), cost and audit of its repair, and the SHA-256 of the
    repaired `role:text` lines.  Rows whose column `present` is not true only
    name their conversation."""
    return _repaired(rows, conv_id, turn, role, text, present, lambda kind: (
        f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string"), False, segment_rows, segment_chars)


def repaired_rows(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                  present: str | None = None, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The repaired conversations: id, pos (from 0), edit (K, R or I), role and
    text."""
    return _repaired(rows, conv_id, turn, role, text, present,
                     lambda kind: f"conv {kind}, pos long, edit string, role string, text string", True, segment_rows, segment_chars)


def damage(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults put in by the CRC-32 of `id:turn` modulo 20: 0 drops
    the row (`present` is false), 1 empties its text, 2 removes its `.!?`, 3
    repeats it, 4 makes it the user's.  Nulls count as one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), known(role).alias("role"), known(text).alias("text"),
                    (F.crc32(F.concat(known(conv_id), F.lit(":"), known(turn)).cast("binary")) % 20).alias("f"))
    return d.select(
        "conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("f") != 0).alias("present"), F.explode(F.expr("if(f = 3, array(0, 1), array(0))")).alias("copy")).drop("copy")
