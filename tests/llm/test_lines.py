"""Operator 7 against brute force."""
import random

from cases import documents  # noqa: F401
from codeaudit.llm.lines import dedup_lines


def brute(rows, window=3):
    """(doc_id, text) sorted by doc_id in, {doc_id: (text, removed)} out."""
    seen, out = set(), {}
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p:p + window])
            if not any(x.strip() for x in w):
                continue
            if w in seen:
                gone |= set(range(p, p + window))
            seen.add(w)
        out[i] = (t if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), sorted(gone))
    return out


def test_brute_force(documents):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice("abcdefg") + r.choice(["", " x", "  "]) for _ in range(r.randrange(0, 12)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n\n"), (203, "a\na\na\na\na\na"), (204, "a\na\na\na\na\na"), (205, "q\r\nw\r\ne")]
    got = dedup_lines(documents(rows))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "line_dedup"]
    found = {x.doc_id: (x.text, x.line_dedup.removed) for x in got.collect()}
    want = brute(rows)
    assert found == want
    assert any(g for _, g in want.values())
    assert found[203][0].count("a") >= 1 and found[204][0] == ""


def test_edges(documents):
    text = "l1\nl2\nl3"
    clash = documents([(None, text), (7, text), (7, text), (8, "x")]).selectExpr("*", "1 as d", "2 as gone", "3 as __row", "4 as h")
    got = dedup_lines(clash).collect()
    assert sorted((x.doc_id or 0, x.text) for x in got) == [(0, ""), (7, ""), (7, text), (8, "x")]  # null ids come last
    assert all((x.d, x.gone, x["__row"], x.h) == (1, 2, 3, 4) for x in got)
    assert dedup_lines(documents([])).count() == 0
    long = "\n".join(f"line {i}" for i in range(60_000))
    got = {x.doc_id: x.text for x in dedup_lines(documents([(1, long), (2, "head\n" + long)])).collect()}
    assert got == {1: long, 2: "head"}
