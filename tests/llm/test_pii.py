"""Operator 3: round trip, validity, linking, untouched text."""
import datetime
import random
import re

import hashlib

from cases import documents  # noqa: F401
from codeaudit.llm.pii import pseudonymise


def luhn(d):
    s = [int(c) for c in d][::-1]
    return (sum(s[::2]) + sum(sum(divmod(2 * x, 10)) for x in s[1::2])) % 10 == 0


def card(r, n):
    body = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def values(r):
    day = datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73049))
    area = r.choice([1, 665, 667, 899, r.randrange(1, 600)])
    return {"card": card(r, r.randrange(13, 20)), "spaced": " ".join(re.findall("....", card(r, 16))),
            "phone": f"+1 ({r.randrange(200, 1000)}) {r.randrange(200, 1000)}-{r.randrange(10000):04}",
            "dots": f"{r.randrange(200, 1000)}.{r.randrange(200, 1000)}.{r.randrange(10000):04}",
            "ssn": f"{area:03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}",
            "ip": ".".join(str(r.randrange(256)) for _ in range(4)), "ymd": day.isoformat(),
            "mdy": f"{day.month:02}/{day.day:02}/{day.year}", "dmy": f"{day.day:02}.{day.month:02}.{day.year}",
            "short": f"{day.month}/{day.day}/{day.year}"}


def texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = values(r)
        out.append((i, "; ".join(f"{k} is {x}" for k, x in v.items()), v))
    return out


def test_round_trip_and_formats(documents):
    rows = texts(150, 1)
    made = pseudonymise(documents([(i, t) for i, t, _ in rows]), "key").cache()
    got = {r.doc_id: (r.text, r.n_private) for r in made.collect()}
    for i, t, v in rows:
        new = dict(x.split(" is ") for x in got[i][0].split("; "))
        shape = lambda s: re.sub(r"\d", "9", s)
        for k in ("card", "spaced", "phone", "dots", "ssn", "ymd", "mdy", "dmy"):
            assert shape(new[k]) == shape(v[k]), (k, v[k], new[k])
        for k in ("card", "spaced"):
            assert luhn(new[k].replace(" ", "")) and new[k][0] == v[k][0]
        assert all(int(x) < 256 for x in new["ip"].split("."))
        assert datetime.date.fromisoformat(new["ymd"]).strftime("%m/%d/%Y %d.%m.%Y") == f"{new['mdy']} {new['dmy']}"
        assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", new["ssn"])
        assert got[i][1] >= 9
    back = {r.doc_id: r.text for r in pseudonymise(made.drop("n_private"), "key", invert=True).collect()}
    plain = lambda t: re.sub(r"(?<=short is )0|(?<=/)0(?=\d/\d{4}$)", "", t)
    assert {i: plain(t) for i, t in back.items()} == {i: plain(t) for i, t, _ in rows}
    other = {r.doc_id: r.text for r in pseudonymise(documents([(i, t) for i, t, _ in rows]), "other").collect()}
    assert all(other[i] != got[i][0] for i in other)


def test_day_first_slash_dates(documents):
    days = [f"{d:02}/{m:02}/{y}" for d in (13, 28, 29, 30, 31) for m in (1, 2, 12) for y in (1900, 2000, 2099)]
    rows = list(enumerate(days))
    made = pseudonymise(documents(rows), "k").cache()
    got = {r.doc_id: r.text for r in made.collect()}
    valid = lambda t: t[:5] not in ("30/02", "31/02") and t not in ("29/02/1900", "29/02/2099")
    for i, t in rows:
        assert (got[i] != t and int(got[i][:2]) > 12 and datetime.datetime.strptime(got[i], "%d/%m/%Y")) if valid(t) else got[i] == t
    assert {r.doc_id: r.text for r in pseudonymise(made.drop("n_private"), "k", invert=True).collect()} == dict(rows)


def test_links_and_leaves_the_rest(documents):
    same = "call 212-555-0147 or (212) 555-0147, card 4111-1111-1111-1111 / 4111111111111111, A.b@x.example A.B@x.example"
    plain = "order 4111111111111112, v4.0.1, 300.1.2.3, 1899-12-31, 2100-01-01, 02/30/2000, 000-12-3456, 666-12-3456, 123-00-1234, a@b, 12-34"
    got = {r.doc_id: r for r in pseudonymise(documents([(1, same), (2, plain), (3, "212.555.0147"), (4, "x" * 300_000 + " 10.0.0.1")]), "k").collect()}
    phones = {re.sub(r"\D", "", p) for p in got[1].text.split(", card")[0].split(" or ")}
    assert phones == {re.sub(r"\D", "", got[3].text)} and phones != {"2125550147"}
    cards = re.findall(r"[\d-]{16,19}", got[1].text)
    assert len({c.replace("-", "") for c in cards}) == 1
    assert len(set(re.findall(r"\w+@x", got[1].text))) == 1 and "A.b@" not in got[1].text
    assert (got[2].text, got[2].n_private) == (plain, 0)
    assert got[4].n_private == 1 and got[4].text.startswith("x" * 300_000 + " ")


def test_edges(documents):
    clash = documents([(None, None), (2, ""), (2, ""), (3, "9.9.9.9")]).selectExpr("*", "1 as d", "2 as found", "3 as new", "4 as n_private")
    got = pseudonymise(clash, "it's a \\ key")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "d", "found", "new", "n_private"]
    assert sorted(((r.doc_id or 0), r.n_private) for r in got.collect()) == [(0, 0), (2, 0), (2, 0), (3, 1)]
    assert pseudonymise(documents([]), "k").count() == 0


def test_cards_beside_other_digits(documents):
    r, rows = random.Random(12), []
    spaced = lambda c: " ".join(re.findall(".{1,4}", c))
    for i in range(40):
        c, a, b = card(r, 16), card(r, 15), card(r, r.choice([13, 16, 19]))
        rows += [(spaced(c), " 05/27", ""), (c, f" {r.randrange(100, 1000)}", ""), (spaced(c), "", "05/27 "), (spaced(c), "", "order 12 "),
                 (c, " 05/27x", "order 12 "), (b, "", "7 "), (f"{a[:4]} {a[4:10]} {a[10:]}", " 11/30 123", ""),
                 (c.replace(c, "-".join(re.findall("....", c))), " 99", "1-")]
    rows = [("4111 1111 1111 1111", " 05/27", ""), ("4111111111111111", " 123", ""), *rows]
    made = pseudonymise(documents([(i, x + c + y) for i, (c, y, x) in enumerate(rows)]), "k").cache()
    got = {t.doc_id: (t.text, t.n_private) for t in made.collect()}
    for i, (c, y, x) in enumerate(rows):
        new, n = got[i]
        mid = new[len(x):len(new) - len(y)]
        assert new.startswith(x) and new.endswith(y) and n == 1, (x, c, y, new)
        assert mid != c and luhn(re.sub(r"\D", "", mid)) and mid[0] == c[0] and re.sub(r"\d", "9", mid) == re.sub(r"\d", "9", c)
    back = {t.doc_id: t.text for t in pseudonymise(made.drop("n_private"), "k", invert=True).collect()}
    assert back == {i: x + c + y for i, (c, y, x) in enumerate(rows)}


def test_values_after_cards_and_long_runs(documents):
    c = "4111 1111 1111 1111"
    more = ["212-555-0147", "123-45-6789", "2001-07-04", "07/04/2001", "10.0.0.1", "77@x.example", "2125550147", "4242 4242 4242 4242"]
    rows = [(i, f"{c} {x}") for i, x in enumerate(more)] + [(90, "12345 123-45-6789"), (91, "7" * 300_001), (92, "1 " * 100_000 + c)]
    made = pseudonymise(documents(rows), "k").cache()
    got = {t.doc_id: t.text for t in made.collect()}
    assert {t.doc_id: t.n_private for t in made.collect() if t.doc_id < 91} == {**dict.fromkeys(range(len(more)), 2), 90: 1}
    for i, x in enumerate(more):
        assert got[i][:19] != c and luhn(got[i][:19].replace(" ", "")) and got[i][20:] != x, got[i]
    assert got[90][:6] == "12345 " and got[90][6:] != "123-45-6789" and got[91] == "7" * 300_001
    assert got[92].startswith("1 " * 100_000) and not got[92].endswith(c)


def feistel_card(d, key):
    """The method, written again: eight rounds over the halves of the middle digits."""
    n = len(d) - 2
    half, rest = n // 2, n - n // 2
    a, b = int(d[1:1 + half]), int(d[1 + half:1 + n])
    f = lambda r, v, size: int(hashlib.sha256(f"{key}|card|{r}|{v}".encode()).hexdigest()[:15], 16) % size
    for r in range(1, 9):
        if r % 2:
            a = (a + f(r, b, 10 ** half)) % 10 ** half
        else:
            b = (b + f(r, a, 10 ** rest)) % 10 ** rest
    body = d[0] + f"{a:0{half}}{b:0{rest}}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_equal_cards_are_linked_whatever_stands_beside(documents):
    r, rows, want = random.Random(31), [], []
    spaced = lambda c: " ".join(re.findall(".{1,4}", c))
    for k in range(1000):
        c = card(r, 16)
        if k % 2:  # an issuer's
            c = next(x for x in iter(lambda: card(r, 16), None) if x[0] in "3456")
        new = feistel_card(c, "k")
        for write in (str, spaced):
            for before, after in (("", ""), ("", f" {r.randrange(100, 1000)}"), ("", f" {r.randrange(1, 13):02}/{r.randrange(24, 40)}"),
                                  (f"{r.randrange(10, 100)} ", ""), ("no. 7 ", " 123")):
                rows.append((len(rows), before + write(c) + after))
                want.append(before + write(new) + after)
        if k % 2:
            rows.append((len(rows), f"{r.choice('01789')}{r.randrange(100, 1000)} {spaced(c)}"))
            want.append(rows[-1][1][:5] + spaced(new))
    made = pseudonymise(documents(rows), "k").cache()
    got = {t.doc_id: t.text for t in made.collect()}
    assert [(rows[i][1], got[i], w) for i, w in enumerate(want) if got[i] != w] == []
    back = {t.doc_id: t.text for t in pseudonymise(made.drop("n_private"), "k", invert=True).collect()}
    assert [(rows[i][1], back[i]) for i in back if back[i] != rows[i][1]] == []
