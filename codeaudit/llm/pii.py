"""Format-preserving pseudonyms for private data (operator 3); SQL functions
only.

Found: card numbers (13 to 19 digits with a valid check digit), North American
phone numbers, social security numbers, IPv4 addresses, dates of the years
1900 to 2099 (YYYY-MM-DD, MM/DD/YYYY, or DD/MM/YYYY where the first is no
month, DD.MM.YYYY) and mail addresses.  What is not valid in its format stays.

Method: a valid number or date is an element of a domain whose size has two
factors; a balanced or unbalanced Feistel network over the two parts, keyed by
SHA-256, permutes the domain exactly, so every pseudonym is valid in the same
format, equal values get equal pseudonyms in all documents and formats, and
whoever has the key can invert it (an unpadded date, 7/4/2001, may come back
padded, when its pseudonym had two-digit fields).  Cards keep their first digit and length
and get a new check digit.  Beside other digits (an expiry date, a check value,
a number before it) a card is read in the groups that cards are written in: from
the left, first those of an issuer's first digit, length and groups, else any
of them, a length of 16 before others.  What stands beside a card has no part in
its pseudonym; where digits in front of it or the first 16 of a longer one
happen to make a card themselves, that is what is read.  Day-first slash dates
walk the permutation until the day is again no month.  The name part of a mail address becomes a keyed
hash of the address (not invertible); its domain stays.

All work is in the row: no shuffle, no key or document that gathers rows.

Defined results: a null text stays null with nothing found; texts are read
whole, however long; empty texts, ties and repeated rows need no rule; empty tables give no rows; other columns are
carried whatever their names (`out` is replaced).  The key is part of the
query's plan, so logs that show plans show it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The formats.
FORMATS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "ymd": r"(?<![\d/.-])\d{4}-\d{2}-\d{2}(?![\d/-])",
    "slash": r"(?<![\d/.-])\d{1,2}/\d{1,2}/\d{4}(?![\d/-])",
    "dot": r"(?<![\d/.-])\d{1,2}\.\d{1,2}\.\d{4}(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?<![\d+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-]?)[2-9]\d{2}[ .-]?\d{4}(?!\d)",
}
# A run of digits that may hold cards: of 13 digits or more, up to where another value begins.  In its first 13 digits
# ten in groups may be a card's, so a phone number ends it only if written with hyphens.
_NO_PHONE = "|".join(f"(?:{p})" for k, p in FORMATS.items() if k != "phone")
_HYPHENS = r"(?<= )[2-9]\d{2}-[2-9]\d{2}-\d{4}(?!\d)"
FORMATS["card"] = (rf"(?<!\d)\d(?:(?:[ -](?!{_NO_PHONE}|{_HYPHENS}))?\d){{12}}"
                   rf"(?:(?:[ -](?!{_NO_PHONE}|{FORMATS['phone']}))?\d)*+")
#: The groups that cards are written in (with the separator before them).
CARD_GROUPS = (r"^[ -]?(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|"
               r"\d{4}([ -])\d{3}\3\d{3}\3\d{3}|\d{6}[ -]\d{7,13})$")

#: The groups of issuers' cards, and their lengths by first digit, likeliest first.
ISSUER_GROUPS = (r"^[ -]?(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}|"
                 r"\d{4}([ -])\d{3}\3\d{3}\3\d{3})$")
ISSUER_LENGTHS = {"2": (16,), "3": (15, 14, 16), "4": (16, 13, 19), "5": (16,), "6": (16, 19)}
LENGTHS = (16, 15, 14, 13, 19, 18, 17)

def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """Expressions over one match `m`."""

    def __init__(self, key: str, invert: bool):
        self.key, self.invert = key, invert

    def feistel(self, kind: str, a: str, b: str, size_a: str, size_b: str) -> str:
        """struct<a, b> of the permuted element (a, b) of [0, size_a) x [0, size_b)."""
        order = f"sequence({ROUNDS}, 1, -1)" if self.invert else f"sequence(1, {ROUNDS})"
        sign = "-" if self.invert else "+"

        def f(value: str, size: str) -> str:
            digest = f"sha2(concat({_q(self.key)}, '|{kind}|', r, '|', {value}), 256)"
            return f"cast(conv(substr({digest}, 1, 15), 16, 10) as bigint) % {size}"
        return (f"aggregate({order}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 1, "
                f"named_struct('a', pmod(s.a {sign} {f('s.b', size_a)}, {size_a}), 'b', s.b), "
                f"named_struct('a', s.a, 'b', pmod(s.b {sign} {f('s.a', size_b)}, {size_b}))))")

    def let(self, value: str, var: str, body: str) -> str:
        """`body` with `var` bound to `value`, evaluated once."""
        return f"transform(array({value}), {var} -> {body})[0]"

    digits = "regexp_replace(m, '[^0-9]', '')"

    def fill(self, digits: str, m: str = "m") -> str:
        """`m` with its digits replaced in order."""
        return self.let(digits, "ds", (
            f"array_join(transform(sequence(1, length({m})), p -> if(substr({m}, p, 1) between '0' and '9', "
            f"substr(ds, length(regexp_replace(substr({m}, 1, p), '[^0-9]', '')), 1), substr({m}, p, 1))), '')"))

    @staticmethod
    def _join(parts: str, start: str, n: str) -> str:
        return f"array_join(slice({parts}, {start}, {n}), '')"

    def cards(self, run: str) -> str:
        """array<struct<i, n>>: the cards of a digit run, as the first group and
        the number of groups; a run of no such reading may be one card as a
        whole."""
        kind = "array<struct<i:int,n:int>>"
        issuer = "case left(w, 1) " + " ".join(f"when '{c}' then array{x if len(x) > 1 else f'({x[0]})'}" for c, x in ISSUER_LENGTHS.items()) + \
            " else cast(array() as array<int>) end"

        def readings(groups: str, lengths: str) -> str:
            # per number of groups: the place of its length in the order, if the digits `w` are a card
            rank = self.let("regexp_replace(u, '[^0-9]', '')", "w", f"if(luhn_check(w), array_position({lengths}, length(w)), 0)")
            one = self.let(self._join("gs", "i", "n"), "u", f"if(regexp_like(u, {_q(groups)}), {rank}, 0)")
            size = (f"coalesce(array_min(filter(transform(sequence(1, least(5, size(gs) - i + 1)), n -> named_struct('r', {one}, 'n', n)), "
                    "x -> x.r > 0)).n, 0)")
            return (f"aggregate(sequence(1, size(gs)), named_struct('free', 1, 'found', cast(array() as {kind})), (s, i) -> if(i < s.free, s, "
                    + self.let(size, "k", "if(k = 0, s, named_struct('free', i + k, 'found', concat(s.found, array(named_struct('i', i, 'n', k)))))")
                    + ")).found")

        whole = self.let(f"regexp_replace({run}, '[^0-9]', '')", "w", "length(w) between 13 and 19 and luhn_check(w)")
        any_card = self.let(readings(CARD_GROUPS, f"array{LENGTHS}"), "found", (
            f"if(size(found) = 0 and {whole}, array(named_struct('i', 1, 'n', size(gs))), found)"))
        return self.let(f"split({run}, '(?=[ -])', -1)", "gs", self.let(readings(ISSUER_GROUPS, issuer), "known", (
            f"if(size(known) > 0, known, {any_card})")))

    def card_run(self) -> str:
        """`m` with its cards replaced."""
        end = "(if(j = 0, 1, at[j - 1].i + at[j - 1].n))"
        one = self.let(self._join("hs", "x.i", "x.n"), "c", self.card("c"))
        moved = self.let("split(m, '(?=[ -])', -1)", "hs", (
            f"concat(array_join(transform(at, (x, j) -> concat({self._join('hs', end, f'x.i - {end}')}, {one})), ''), "
            + self._join("hs", "element_at(at, -1).i + element_at(at, -1).n", "size(hs)") + ")"))
        return self.let(self.cards("m"), "at", f"if(size(at) = 0, m, {moved})")

    def card(self, m: str) -> str:
        # The first digit stays; the next n - 2 are permuted; the last is the check digit.
        half, rest = "cast((length(d) - 2) div 2 as int)", "cast(length(d) - 2 - (length(d) - 2) div 2 as int)"
        ten = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
        moved = self.feistel("card", f"cast(substr(d, 2, {half}) as bigint)", f"cast(substr(d, 2 + {half}, {rest}) as bigint)",
                             ten(half), ten(rest))
        body = f"concat(substr(d, 1, 1), lpad(x.a, {half}, '0'), lpad(x.b, {rest}, '0'))"
        # Doubled digits alternate, from the last of the body backwards.
        total = ("aggregate(sequence(1, length(body)), 0, (t, i) -> t + if((length(body) - i) % 2 = 0, "
                 "element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substr(body, i, 1) as int) + 1), "
                 "cast(substr(body, i, 1) as int)))")
        new = self.let(moved, "x", self.let(body, "body", f"concat(body, pmod(-{total}, 10))"))
        return self.let(f"regexp_replace({m}, '[^0-9]', '')", "d", self.fill(new, m))

    def phone(self) -> str:
        ten = "right(d, 10)"
        moved = self.feistel("phone", f"cast(left({ten}, 3) as bigint) - 200",
                             f"(cast(substr({ten}, 4, 3) as bigint) - 200) * 10000 + cast(right(d, 4) as bigint)", "800", "8000000")
        new = self.let(moved, "x", "concat(left(d, length(d) - 10), 200 + x.a, 200 + x.b div 10000, lpad(x.b % 10000, 4, '0'))")
        return self.let(self.digits, "d", self.fill(new))

    def ssn(self) -> str:
        # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
        area = "cast(left(d, 3) as bigint)"
        moved = self.feistel("ssn", f"{area} - if({area} > 666, 2, 1)",
                             "(cast(substr(d, 4, 2) as bigint) - 1) * 9999 + cast(right(d, 4) as bigint) - 1", "898", "989901")
        new = self.let(moved, "x", "concat(lpad(x.a + if(x.a >= 665, 2, 1), 3, '0'), lpad(x.b div 9999 + 1, 2, '0'), "
                                   "lpad(x.b % 9999 + 1, 4, '0'))")
        valid = f"{area} between 1 and 899 and {area} <> 666 and substr(d, 4, 2) <> '00' and right(d, 4) <> '0000'"
        return self.let(self.digits, "d", f"if({valid}, {self.fill(new)}, m)")

    def ip(self) -> str:
        part = "transform(split(m, '[.]'), x -> cast(x as bigint))"
        moved = self.feistel("ip", "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536")
        new = self.let(moved, "x", "concat_ws('.', x.a div 256, x.a % 256, x.b div 256, x.b % 256)")
        return self.let(part, "o", f"if(array_max(o) <= 255, {new}, m)")

    def _day(self, date: str) -> str:
        """The permuted day of a day number from 0 (1900-01-01) to 73048 = 17 * 4297 - 1."""
        return self.let(self.feistel("date", f"{date} div 4297", f"{date} % 4297", "17", "4297"), "x", "x.a * 4297 + x.b")

    def date(self, order: str, day_over_12: bool = False) -> str:
        """`order` names the fields of the format."""
        at = {c: f"p[{i}]" for i, c in enumerate(order)}
        parsed = lambda y, mo, d: f"try_cast(concat({y}, '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')) as date)"
        number = f"cast(datediff({parsed(at['y'], at['m'], at['d'])}, date'1900-01-01') as bigint)"
        to_date = "date_add(date'1900-01-01', cast(n as int))"
        field = {"y": f"cast(year({to_date}) as string)", "m": f"cast(month({to_date}) as string)",
                 "d": f"cast(day({to_date}) as string)"}
        padded = "regexp_like(m, '^[0-9]{2}[^0-9][0-9]{2}[^0-9]') or regexp_like(m, '^[0-9]{4}')"
        mark = "regexp_extract(m, '[^0-9]', 0)"
        written = lambda pad: f"concat_ws({mark}, " + ", ".join(
            field[c] if c == "y" or not pad else f"lpad({field[c]}, 2, '0')" for c in order) + ")"
        moved = self._day("n0")
        if day_over_12:  # the first field is no month, and stays so
            moved = ("aggregate(sequence(1, 96), " + self._day("n0") + ", (w, i) -> if(day(date_add(date'1900-01-01', cast(w as int))) > 12, w, "
                     + self._day("w") + "))")
        out = f"if({padded}, {written(True)}, {written(False)})"
        return self.let("split(m, '[-/.]')", "p", self.let(number, "n0", (
            f"if(n0 between 0 and 73048, {self.let(moved, 'n', out)}, m)")))

    def mail(self) -> str:
        return (f"concat(left(sha2(concat({_q(self.key)}, '|mail|', lower(m)), 256), 16), substr(m, instr(m, '@')))")

    def replace(self) -> str:
        one = lambda k: f"regexp_like(m, {_q('^(?:' + FORMATS[k] + ')$')})"
        slash = ("if(cast(split(m, '/')[0] as int) > 12, " + self.date("dmy", True) + f", {self.date('mdy')})")
        cases = [("instr(m, '@') > 0", "m" if self.invert else self.mail()), (one("ymd"), self.date("ymd")), (one("slash"), slash),
                 (one("dot"), self.date("dmy")), (one("ssn"), self.ssn()), (one("ip"), self.ip()), (one("phone"), self.phone()),
                 ("true", self.card_run())]
        return "case " + " ".join(f"when {c} then {v}" for c, v in cases) + " end"


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", out: str = "n_private", invert: bool = False) -> DataFrame:
    """`docs` with the private values in `text` replaced and `out` (long), the
    number of replaced values.  `invert` with the same key restores numbers
    and dates."""
    every = _q("|".join(f"(?:{p})" for p in FORMATS.values()))
    t = f"d.`{text}`"
    sql = _Sql(key, invert)
    found = docs.select(F.struct(*docs.columns).alias("d")).withColumn(
        "found", F.expr(f"if({t} rlike '[0-9@]', regexp_extract_all({t}, {every}, 0), cast(array() as array<string>))"))
    new = found.withColumn("new", F.expr(f"transform(found, m -> {sql.replace()})"))
    joined = f"""if(size(found) = 0, {t}, concat_ws('', flatten(zip_with(split({t}, {every}, -1), new,
        (gap, x) -> array(gap, coalesce(x, ''))))))"""
    same = lambda a, b: a.lower() == b.lower()
    count = ("aggregate(zip_with(found, new, (m, x) -> if(m = x, 0, if(regexp_like(m, '^[0-9][0-9 -]{12,}$'), greatest(1, size("
             + sql.cards("m") + ")), 1))), 0, (n, k) -> n + k)")
    return new.select(*[(F.expr(joined) if same(c, text) else F.col("d")[c]).alias(c) for c in docs.columns if not same(c, out)],
                      F.expr(f"if({t} is null, 0, {count})").cast("long").alias(out))
