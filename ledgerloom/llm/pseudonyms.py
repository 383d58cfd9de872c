"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame functions alone.

Numbers and dates in a text are found by one pattern, validated, and permuted within their own format: a card number stays
a card number of its length with a right check digit, an address stays four octets, a date a date. Mail names and
hexadecimal secrets are permuted sign by sign within digits, small and capital letters. A permutation depends on the key,
the kind and the format only (a mail name's also on the host), so equal values get equal pseudonyms in every document,
different ones different ones, and whoever has the key can go back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 10
#: Digits of a card, and how often a match with cards is permuted at most until it can be told apart again.
CARD_DIGITS = (13, 19)
WALK = 64

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Java patterns of what is looked for, in this order; a match of an earlier one wins.
PATTERNS = {
    "mail": r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:(?:1[6-9]|[2-9][0-9])[0-9]{2}([-/.])[0-9]{2}\g[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\h"
            r"(?:1[6-9]|[2-9][0-9])[0-9]{2})(?![0-9/-])",
    "address": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "social": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}"
             r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,39}(?![0-9])",
}


def _pattern() -> str:
    """All patterns as one; back references are numbered in it."""
    joined = "|".join(f"(?:{p})" for p in PATTERNS.values())
    return joined.replace(r"\g", r"\1").replace(r"\h", r"\2")


PATTERN = _pattern()

Map = Callable[[Column], Column]


class Feistel:
    """Permutations of Z_a x Z_b: rounds add a keyed hash of one half to the other, in turn."""

    def __init__(self, key: str, back: bool = False) -> None:
        self.key, self.back = key, back

    def _round(self, i: Column, kind: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("/", F.lit(self.key), kind, i.cast("string"), other.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def __call__(self, kind: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
        """The image of (left, right) as a struct; `kind` names the permutation."""
        steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        sign = -1 if self.back else 1

        def step(x: Column, i: Column) -> Column:
            even = i % 2 == 0
            moved = F.pmod(
                F.when(even, x["l"]).otherwise(x["r"])
                + sign * F.pmod(self._round(i, kind, F.when(even, x["r"]).otherwise(x["l"])), F.when(even, a).otherwise(b)),
                F.when(even, a).otherwise(b),
            )
            return F.struct(F.when(even, moved).otherwise(x["l"]).alias("l"), F.when(even, x["r"]).otherwise(moved).alias("r"))

        return F.aggregate(steps, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)

    def digits(self, kind: str, text: Column) -> Column:
        """A permutation of the digit strings of the length of `text` (two to 36)."""
        u = F.floor(F.length(text) / 2).cast("int")
        v = F.length(text) - u
        power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
        name = F.concat(F.lit(kind), F.length(text).cast("string"))
        out = self(name, F.substring(text, F.lit(1), u), F.substring(text, u + 1, v), power(u), power(v))
        return _let(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), u, "0"), F.lpad(x["r"].cast("string"), v, "0")))

    def characters(self, kind: Column, text: Column, letters: int) -> Column:
        """A permutation of the texts of one layout (up to 128 signs): digits, and the first `letters` small and capital
        letters, move among themselves, all other signs stay. Rounds move every second sign by a keyed hash of the others,
        in which small and capital letters are alike."""
        steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if self.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
        sign = -1 if self.back else 1

        def turn(c: Column, by: Column) -> Column:
            code = F.ascii(c)
            ring = lambda first, size: F.char(first + F.pmod(code - first + sign * by, F.lit(size)))
            return (
                F.when(c.between("0", "9"), ring(48, 10)).when(c.between("a", "z"), ring(97, letters))
                .when(c.between("A", "Z"), ring(65, letters)).otherwise(c)
            )

        def step(signs: Column, i: Column) -> Column:
            others = F.lower(F.array_join(F.filter(signs, lambda c, k: k % 2 != i % 2), ""))
            digest = F.sha2(F.concat_ws("/", F.lit(self.key), kind, F.size(signs).cast("string"), i.cast("string"), others), 512)
            by = lambda d, k: F.conv(F.substring(d, F.shiftright(k, 1) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return _let(digest, lambda d: F.transform(
                signs, lambda c, k: F.when(k % 2 == i % 2, turn(c, by(d, k))).otherwise(c)
            ))

        return F.array_join(F.aggregate(steps, F.split(text, ""), step), "")


def _let(value: Column, use: Map) -> Column:
    """`use(value)` with `value` worked out once."""
    return F.transform(F.array(value), use)[0]


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(layout: Column, digits: Column) -> Column:
    """`layout` with its digits replaced, one after the other."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(x: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(x["out"], F.when(digit, F.substring(digits, x["k"], F.lit(1))).otherwise(c)).alias("out"),
            (x["k"] + digit.cast("int")).alias("k"),
        )

    return F.aggregate(F.split(layout, ""), start, put, lambda x: x["out"])


def luhn_digit(payload: Column) -> Column:
    """The check digit behind a string of digits."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(payload), ""), lambda c, i: _let(
        c.cast("int"), lambda d: F.when(i % 2 == 0, twice(d)).otherwise(d)
    ))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda x, d: x + d), F.lit(10))


def _valid(digits: Column) -> Column:
    """Whether the last digit is the check digit of the others."""
    return F.right(digits, F.lit(1)).cast("int") == luhn_digit(F.substring(digits, F.lit(1), F.length(digits) - 1))


def _places(value: Column) -> Column:
    """Where cards could stand in a match: 64 * first digit + digit behind the last, from the start of a group to an end of one.

    They follow from the layout alone: by their starts, longer ones first.
    """
    sizes = F.transform(F.split(value, "[ -]"), F.length)
    digits_of = lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda x, y: x + y)
    groups = F.size(sizes)
    pairs = F.transform(F.sequence(F.lit(1), groups), lambda i: F.transform(
        F.sequence(groups, i, F.lit(-1)), lambda j: digits_of(i - 1) * 64 + digits_of(j)
    ))
    return F.filter(F.flatten(pairs), lambda p: (p.bitwiseAND(63) - F.shiftright(p, 6)).between(*CARD_DIGITS))


def _chosen(places: Column, digits: Column) -> Column:
    """The places that hold a valid card, none over one before it."""

    def take(found: Column, p: Column) -> Column:
        start, end = F.shiftright(p, 6), p.bitwiseAND(63)
        free = start >= F.coalesce(F.try_element_at(found, F.lit(-1)).bitwiseAND(63), F.lit(0))
        card = F.substring(digits, start + 1, end - start)
        return F.when(F.when(free, _valid(card)).otherwise(False), F.concat(found, F.array(p))).otherwise(found)

    return F.aggregate(places, F.array().cast("array<int>"), take)


def _card(f: Feistel) -> Map:
    """Cards with a right check digit are permuted into such cards, wherever in a longer match they stand; null without one.

    The permutation is repeated until the same places are chosen in its result as in the match, which lets it go back.
    Only a match with several cards among many other digits could reach `WALK` steps; it is then left as it is after them.
    """

    def move(digits: Column, p: Column) -> Column:
        start, end = F.shiftright(p, 6), p.bitwiseAND(63)
        payload = F.substring(digits, start + 1, end - start - 1)
        new = _let(f.digits("card", payload), lambda d: F.concat(d, luhn_digit(d).cast("string")))
        return F.concat(F.substring(digits, F.lit(1), start), new, F.substring(digits, end + 1, F.length(digits)))

    def walk(places: Column, digits: Column, chosen: Column) -> Column:
        def step(x: Column, _: Column) -> Column:
            moved = _let(F.aggregate(chosen, x["digits"], move), lambda new: F.struct(
                new.alias("digits"), (_chosen(places, new) == chosen).alias("done")
            ))
            return F.when(x["done"], x).otherwise(moved)

        start = F.struct(digits.alias("digits"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step, lambda x: x["digits"])

    def one(value: Column) -> Column:
        return _let(F.struct(_places(value).alias("places"), _only_digits(value).alias("digits")), lambda m: _let(
            _chosen(m["places"], m["digits"]),
            lambda chosen: F.when(F.size(chosen) > 0, _refill(value, walk(m["places"], m["digits"], chosen))),
        ))

    return one


def _phone(f: Feistel) -> Map:
    """The country code stays."""

    def one(value: Column) -> Column:
        head = F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[^0-9]))?", 0)
        rest = F.substring(value, F.length(head) + 1, F.length(value))
        return F.concat(head, _refill(rest, _let(_only_digits(rest), lambda d: f.digits("phone", d))))

    return one


def _social(f: Feistel) -> Map:
    """Areas 001 to 899 without 666, groups 01 to 99 and serials 0001 to 9999 are permuted together."""

    def one(value: Column) -> Column:
        part = lambda a, n: F.substring(value, a, n).cast("long")
        area = part(1, 3) - 1 - (part(1, 3) > 666).cast("int")
        out = f(F.lit("social"), area * 99 + part(5, 2) - 1, part(8, 4) - 1, F.lit(898 * 99), F.lit(9999))

        def write(x: Column) -> Column:
            area = F.floor(x["l"] / 99)
            area = area + 1 + (area >= 665).cast("int")
            pad = lambda n, size: F.lpad(n.cast("string"), size, "0")
            return F.concat_ws("-", pad(area, 3), pad(x["l"] % 99 + 1, 2), pad(x["r"] + 1, 4))

        return _let(out, write)

    return one


def _address(f: Feistel) -> Map:
    def one(value: Column) -> Column:
        o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
        half = F.lit(1 << 16)
        out = f(F.lit("address"), o[0] * 256 + o[1], o[2] * 256 + o[3], half, half)
        return _let(out, lambda x: F.concat_ws(
            ".", *[n.cast("string") for h in ("l", "r") for n in (F.floor(x[h] / 256), x[h] % 256)]
        ))

    return one


def _date(f: Feistel) -> Map:
    """Days of the same 400 years, which always are 146 097 = 189 x 773; null for what is no date."""

    def one(value: Column) -> Column:
        year_first = value.rlike("^[0-9]{4}")
        sign = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
        iso = F.when(year_first, F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 6, 2), F.substring(value, 9, 2)))
        iso = iso.otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
        start = F.to_date(F.lit("2000-01-01"))

        def renew(date: Column) -> Column:
            days = F.datediff(date, start)
            in_cycle = F.pmod(days, F.lit(146_097))
            out = f(F.lit("date"), F.floor(in_cycle / 773), in_cycle % 773, F.lit(189), F.lit(773))
            return _let(out, lambda x: F.date_add(start, (days - in_cycle + x["l"] * 773 + x["r"]).cast("int")))

        def write(date: Column) -> Column:
            y, m, d = (F.date_format(date, p) for p in ("yyyy", "MM", "dd"))
            return F.when(year_first, F.concat(y, sign, m, sign, d)).otherwise(F.concat(d, sign, m, sign, y))

        parsed = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
        return _let(parsed, lambda p: F.when(p.isNotNull(), _let(renew(p), write)))

    return one


def _mail(f: Feistel) -> Map:
    """The name is permuted, apart for every host; the host stays."""

    def one(value: Column) -> Column:
        name, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        return F.concat(f.characters(F.concat(F.lit("mail"), F.lower(host)), name, 26), F.lit("@"), host)

    return one


def _secret(f: Feistel) -> Map:
    return lambda value: f.characters(F.lit("secret"), value, 6)


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one match of `PATTERN`, null if the match holds no valid value; with `back`, the value of a pseudonym."""
    f = Feistel(key, back)
    makers = {
        "mail": _mail(f), "secret": _secret(f), "date": _date(f), "address": _address(f), "social": _social(f),
        "phone": _phone(f), "card": _card(f),
    }
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        shape = PATTERNS[kind].replace(r"\g", r"\1").replace(r"\h", r"\2")
        out = F.when(value.rlike(f"^(?:{shape})$"), makers[kind](value)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """`docs` with every valid value in `text` replaced, and `n_pseudonyms`, the number of matches that hold one.

    Null and empty texts stay as they are and have none; long texts are searched whole, repeated rows treated alike, an empty
    table gives an empty one. A column named `n_pseudonyms` is replaced; `__found` is for the operator. Dates that do not
    exist and digits that hold no card with a right check digit stay as they are. Runs of more than 40 digits in groups are
    searched for cards 40 digits at a time.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), 0)
    pairs = F.transform(found, lambda x: F.struct(x.alias("old"), pseudonym(x, key, back).alias("new")))
    rows = docs.drop("n_pseudonyms").withColumn("__found", F.when(F.col(text).rlike("[0-9@]|[A-Fa-f]{32}"), pairs))
    n = F.coalesce(F.size(F.filter("__found", lambda x: x["new"].isNotNull())), F.lit(0))
    joined = F.zip_with(
        F.split(F.col(text), PATTERN, -1), "__found",
        lambda piece, x: F.concat(piece, F.coalesce(x["new"], x["old"], F.lit(""))),
    )
    return rows.withColumns({
        text: F.when(n > 0, F.array_join(joined, "")).otherwise(F.col(text)), "n_pseudonyms": n.cast("long"),
    }).drop("__found")
