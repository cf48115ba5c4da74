"""PII: format-preserving pseudonyms by a keyed Feistel network, in DataFrame expressions only.

One regular expression finds what may be personal; each find is validated by its kind (Luhn check digit, octets of
an address, days of the calendar, areas, groups and serials of a social security number, exchanges of a phone number).
What is valid is permuted among all valid values of its format under the key: numbers
by a Feistel network on the two halves of their digits, addresses on two 16-bit halves, dates on the factors
189 x 773 of the 146,097 days of four centuries (so no value falls outside and none is tried twice). Equal values
get equal pseudonyms in every document, and with the key numbers, addresses and dates come back (reveal). E-mail
addresses and secrets have no such format: they get keyed digests, one way.

A pass over a text is one split and one extraction by the same expression; nothing is shuffled, and a row's work
grows with its text. Nothing depends on other rows, so hot values cost nothing.

Kinds and formats: card (13 to 19 digits, also in groups, Luhn; the check digit is made anew), phone (digits after
a +country code: any area code, an exchange from 200 on, a line), ssn (ddd-dd-dddd: an area from 001 to 899 but 666, a
group from 01, a serial from 0001), ip (four octets, without leading zeros), date (yyyy-mm-dd,
yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy; from 1800 to 2199), email (a host of up to 127 labels), secret (access key ids, password= and token= values).

Defined results
* what isn't valid stays as it is; null text stays null, with counts of 0; empty text stays empty.
* of overlapping finds the first, from the left, counts; of those at one place the first in PATTERN.
* rows that repeat, and null doc_ids, are handled as any row; an empty table gives an empty result; other columns
  are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

#: For the registered query, which is a demonstration; there is no default key.
DEMO_KEY = "demo-key"
ROUNDS = 10
FIRST_DAY, DAYS, SMALL, LARGE = "1800-01-01", 146_097, 189, 773

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Formats, most particular first. A host has 127 labels at most, as the format of names says; a group
#: that is repeated without a bound would cost stack in proportion to the text.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "key_id": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}\"?[0-9A-Za-z_./+-]{8,}",
    "date": r"(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"\d{3}-\d\d-\d{4}(?![\d-])",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
}
#: A find begins where no word, number or address goes on.
BEGIN = r"(?<![0-9A-Za-z_%+@.-])"
PATTERN = BEGIN + "(?:" + "|".join(FORMATS.values()) + ")"
KINDS = ["email", "secret", "date", "ip", "phone", "ssn", "card"]


def prf(key: str, tweak: Column, turn: Column, x: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    text = F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), x.cast("string"), F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, right: Column, size_left: Column, size_right: Column, key: str, tweak: Column, back: bool = False) -> Column:
    """A keyed permutation of the pairs (l, r) with 0 <= l < size_left and 0 <= r < size_right; back: its inverse."""
    turns = F.lit(list(range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)))
    pair = lambda a, b: F.struct(a.cast("bigint").alias("l"), b.cast("bigint").alias("r"))

    def moved(x: Column, by: Column, size: Column) -> Column:
        return F.pmod(x - by % size if back else x + by % size, size)

    def turn(state: Column, i: Column) -> Column:
        even = pair(moved(state["l"], prf(key, tweak, i, state["r"]), size_left), state["r"])
        odd = pair(state["l"], moved(state["r"], prf(key, tweak, i, state["l"]), size_right))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(turns, pair(left, right), turn)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A keyed permutation of the strings of as many digits, for 2 to 18 digits."""

    def body(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
        halves = feistel(F.substring(d, F.lit(1), a).cast("bigint"), F.substring(d, a + 1, n - a).cast("bigint"), size(a), size(n - a), key, F.concat(F.lit(kind), n.cast("string")), back)
        return let(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), a, F.lit("0")), F.lpad(h["r"].cast("string"), n - a, F.lit("0"))))

    return let(digits, body)


def luhn_sum(digits: Column, doubled_last: int) -> Column:
    """Digits summed, every second one doubled (and 9 less, if that has two digits); doubled_last: 1 if the last is."""

    def body(d: Column) -> Column:
        n = F.length(d)

        def add(total: Column, i: Column) -> Column:
            x = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return total + F.when((n - i) % 2 == 1 - doubled_last, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return let(digits, body)


def fill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by digits."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def step(state: Column, c: Column) -> Column:
        new = F.struct(F.concat(state["s"], F.substring(digits, state["i"] + 1, F.lit(1))).alias("s"), (state["i"] + 1).alias("i"))
        return F.when(c.between("0", "9"), new).otherwise(F.struct(F.concat(state["s"], c).alias("s"), state["i"].alias("i")))

    return F.aggregate(F.split(form, ""), start, step, lambda state: state["s"])


def card(x: Column, key: str, back: bool) -> Column:
    """Null if the check digit is wrong."""

    def body(d: Column) -> Column:
        payload = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card", back)
        whole = let(payload, lambda p: F.concat(p, F.pmod(F.lit(10) - luhn_sum(p, 1) % 10, F.lit(10)).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, let(whole, lambda w: fill(x, w)))

    return let(digits_of(x), body)


def padded(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def number(d: Column, start: int, n: int) -> Column:
    return F.substring(d, start, n).cast("bigint")


def phone(x: Column, key: str, back: bool) -> Column:
    """Null if the exchange begins with 0 or 1."""
    code = F.regexp_extract(x, r"^\+\d{1,3}", 0)
    rest = F.substring(x, F.length(code) + 1, F.length(x))

    def moved(h: Column) -> Column:
        return F.concat(padded(F.floor(h["l"] / 8), 3), (h["l"] % 8 + 2).cast("string"), padded(h["r"], 6))

    def body(d: Column) -> Column:
        halves = feistel(number(d, 1, 3) * 8 + number(d, 4, 1) - 2, number(d, 5, 6), F.lit(8_000), F.lit(1_000_000), key, F.lit("phone"), back)
        return F.when(number(d, 4, 1) >= 2, F.concat(code, fill(rest, let(halves, moved))))

    return let(digits_of(rest), body)


def ssn(x: Column, key: str, back: bool) -> Column:
    """Null if there is no such area, group or serial."""

    def moved(h: Column) -> Column:
        area = F.floor(h["l"] / 99) + 1
        return F.concat(padded(F.when(area >= 666, area + 1).otherwise(area), 3), padded(h["l"] % 99 + 1, 2), padded(h["r"] + 1, 4))

    def body(d: Column) -> Column:
        area, group, serial = number(d, 1, 3), number(d, 4, 2), number(d, 6, 4)
        place = F.when(area > 666, area - 2).otherwise(area - 1)
        halves = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9_999), key, F.lit("ssn"), back)
        return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), fill(x, let(halves, moved)))

    return let(digits_of(x), body)


def ip(x: Column, key: str, back: bool) -> Column:
    def body(o: Column) -> Column:
        half = lambda i: F.get(o, F.lit(i)).cast("bigint") * 256 + F.get(o, F.lit(i + 1)).cast("bigint")
        size = F.lit(1 << 16)
        out = lambda h: F.concat_ws(".", *[F.floor(v / 256).cast("int").cast("string") if k == 0 else (v % 256).cast("string") for v in (h["l"], h["r"]) for k in (0, 1)])
        return let(feistel(half(0), half(2), size, size, key, F.lit("ip"), back), out)

    return let(F.split(x, r"\."), body)


def date(x: Column, key: str, back: bool) -> Column:
    """Null if there is no such day in the four centuries."""
    formats = [("^....-", "yyyy-MM-dd"), ("^..../", "yyyy/MM/dd"), (r"^..\.", "dd.MM.yyyy"), ("^../", "MM/dd/yyyy")]

    def moved(day: Column) -> Column:
        off = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
        there = feistel(F.floor(off / LARGE), off % LARGE, F.lit(SMALL), F.lit(LARGE), key, F.lit("date"), back)
        return F.when((off >= 0) & (off < DAYS), let(there, lambda h: F.date_add(F.lit(FIRST_DAY).cast("date"), (h["l"] * LARGE + h["r"]).cast("int"))))

    def written(form: str):
        return lambda day: F.date_format(moved(day), form)

    out = None
    for start, form in formats:
        value = let(F.try_to_timestamp(x, F.lit(form)).cast("date"), written(form))
        out = F.when(x.rlike(start), value) if out is None else out.when(x.rlike(start), value)
    return out


def email(x: Column, key: str) -> Column:
    part = lambda s, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s), F.lit(key)), 256), 1, n)
    return F.concat(F.lit("u"), part(x, 12), F.lit("@d"), part(F.substring_index(x, "@", -1), 8), F.lit(".example"))


def secret(x: Column, key: str) -> Column:
    """The last run of key characters replaced by a keyed digest of its length (64 at most)."""
    value = F.regexp_extract(x, r"[0-9A-Za-z_./+-]+$", 0)
    digest = F.upper(F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), value, F.lit(key)), 256))
    head = F.when(value.startswith("AKIA"), F.lit("AKIA")).otherwise(F.lit(""))
    return F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(value)), head, F.substring(digest, F.lit(1), F.length(value) - F.length(head)))


def replaced(x: Column, key: str, back: bool = False) -> Column:
    """struct(kind, out) of a find; kind is null, and out the find itself, if it isn't valid."""
    whole = lambda kind: x.rlike("^(?:" + FORMATS[kind] + ")$")
    value = lambda kind, out: let(out, lambda o: F.struct(F.when(o.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(o, x).alias("out")))
    same = F.struct(F.lit(None).cast("string").alias("kind"), x.alias("out"))
    return (
        F.when(x.contains("@"), same if back else value("email", email(x, key)))
        .when(whole("key_id") | whole("secret"), same if back else value("secret", secret(x, key)))
        .when(whole("date"), value("date", date(x, key, back)))
        .when(whole("ip"), value("ip", ip(x, key, back)))
        .when(whole("phone"), value("phone", phone(x, key, back)))
        .when(whole("ssn"), value("ssn", ssn(x, key, back)))
        .when(whole("card"), value("card", card(x, key, back)))
        .otherwise(same)
    )


def rewritten(text: Column, key: str, back: bool = False) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kind of each find (null: it stayed)."""
    finds = F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda x: replaced(x, key, back))

    def joined(f: Column) -> Column:
        parts = F.transform(F.split(text, PATTERN, -1), lambda p, i: F.concat(p, F.coalesce(F.get(f, i)["out"], F.lit(""))))
        return F.struct(F.when(F.size(f) > 0, F.array_join(parts, "")).otherwise(text).alias("text"), f["kind"].alias("kinds"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9@=:]"), let(finds, joined)).otherwise(none)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, and for each kind n_<kind>."""
    if not key:
        raise ValueError("pseudonyms need a key")
    done = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_new", rewritten(F.col("text"), key))
    kinds = F.filter(F.coalesce(F.col("_new.kinds"), F.array().cast("array<string>")), lambda k: k.isNotNull())
    count = lambda kind: F.size(F.filter("_kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return done.withColumn("_kinds", kinds).select("doc_id", "_new.text", F.size("_kinds").cast("long").alias("n_found"), *map(count, KINDS))


def reveal(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text: numbers, addresses and dates of pseudonymise() with the same key turned back."""
    return docs.select("doc_id", rewritten(F.col("text").cast("string"), key, True)["text"].alias("text"))
