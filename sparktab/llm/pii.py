"""Personal data replaced by format-preserving pseudonyms.

Values are found by pattern and validated (checksum, calendar, number ranges); a valid value is permuted inside its
own format by a keyed Feistel network and put back in its place. The permutation depends on the key and the kind
only, so equal values get equal pseudonyms in all documents and different values different ones.

Numbers: payment cards (first digit and length stay, the check digit is made valid again), North American phone
numbers (with +1 and brackets any area code), social security numbers, IP addresses. Dates from 1900 to 2099, in three notations. Mail addresses (the part before the @)
and credentials of 8 characters and more go through the same network character by character, each staying in its class.

A round adds a keyed digest of one half to the other half, modulo the size of that half's domain; with ROUNDS alternating
rounds this is a bijection. Where a domain is not a product (dates), the permutation is walked until it falls inside.

All of it is column expressions. Defined results: a null text stays null with counts 0; values that don't validate stay
as they are; equal rows get equal texts; an empty table gives an empty result. Other columns are kept by `pseudonymise`
(its own are text, n_numbers, n_dates, n_names and replace columns of these names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import query, table

ROUNDS = 8
KEY = "example key: pass your own"  # of the query only
FIRST_DAY, DAYS = -25567, 73049  # 1900-01-01 to 2099-12-31, in days since 1970

# Fixed patterns. Each is bounded on the left, so a long run is read once.
NAME = r"(?i:password|passwd|token|secret|api_?key)(?i:_?key)?[\"']?\s{0,2}[=:]"  # with any prefix, in JSON too
CREDENTIAL = rf"(?<={NAME}\s{{0,2}}[\"']?)[^\s\"',;]{{8,}}"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
PHONE_FORM = r"(?:\+1[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4})"
PHONE = rf"(?<![\d(+]){PHONE_FORM}(?!\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
#: Credentials first: one that begins like another value is replaced as a whole.
ANY = "|".join((CREDENTIAL, ACCESS_KEY, MAIL, PHONE, SOCIAL, DATE, ADDRESS, CARD))
#: No value without one of these, so most texts are read by this pattern only.
SIGN = rf"[0-9@]|{NAME}"
#: Letters beside a-z and A-Z (first, last code point): each stays in its range.
LETTERS = ((0xC0, 0xD6), (0xD8, 0xDE), (0xDF, 0xF6), (0xF8, 0xFF), (0x100, 0x17F), (0x391, 0x3A1), (0x3B1, 0x3C9), (0x400, 0x42F), (0x430, 0x45F),
           (0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digest(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string")), 256)


def permute(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Feistel permutation of a pair of numbers, left < left_size and right < right_size: a struct (l, r)."""
    def add(half: Column, other: Column, size: Column, i: Column) -> Column:
        return F.pmod(half + F.conv(F.substring(_digest(key, kind, i, other), 1, 15), 16, 10).cast("bigint") % size, size)

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, add(s["l"], s["r"], left_size, i)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(add(s["r"], s["l"], right_size, i)).alias("r"))

    left_size, right_size = left_size.cast("bigint"), right_size.cast("bigint")
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10 ** i) for i in range(10)]), (n + 1).cast("int"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one at weight 1."""
    def total(digits: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((F.length(digits) - i) % 2 == 1, 2).otherwise(1)
            return s + F.when(d > 9, d - 9).otherwise(d)
        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return let(digits, total)


def _refill(value: Column, digits: Column) -> Column:
    """The digits in the places of the value's digits; all else as it was."""
    def fill(digits: Column) -> Column:
        def put(s: Column, ch: Column) -> Column:
            is_digit = ch.between("0", "9")
            return F.struct(F.concat(s["t"], F.when(is_digit, F.substring(digits, s["n"] + 1, F.lit(1))).otherwise(ch)).alias("t"),
                            (s["n"] + is_digit.cast("int")).alias("n"))
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        return F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), put)["t"]
    return let(digits, fill)


def _pad(n: Column, width) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def card(key: str, value: Column) -> Column:
    """Pseudonym of a card number; null if its checksum or length is wrong."""
    def of(d: Column) -> Column:
        inner = F.length(d) - 2                                  # between the first and the check digit
        a = F.floor(inner / 2).cast("int")
        b = inner - a
        p = permute(key, "card", F.substring(d, F.lit(2), a), F.substring(d, a + 2, b), _pow10(a), _pow10(b))
        body = let(p, lambda p: F.concat(F.substring(d, 1, 1), _pad(p["l"], a), _pad(p["r"], b)))
        whole = let(body, lambda t: F.concat(t, F.pmod(10 - _luhn(F.concat(t, F.lit("0"))) % 10, F.lit(10)).cast("string")))
        return F.when(F.length(d).between(13, 19) & (_luhn(d) % 10 == 0), _refill(value, whole))
    return let(F.regexp_replace(value, r"\D", ""), of)


def phone(key: str, value: Column) -> Column:
    def of(d: Column) -> Column:
        lead, n = F.substring(d, F.lit(1), F.length(d) - 10), F.right(d, F.lit(10))
        area, office = F.substring(n, 1, 3).cast("bigint"), F.substring(n, 4, 3).cast("bigint")
        a, o = (F.when(x >= 200, 200).otherwise(0) for x in (area, office))  # codes from 200 on, and those below, among themselves
        size = lambda x: F.when(x > 0, 800).otherwise(200)
        p = permute(key, "phone", area - a, (office - o) * 10_000 + F.substring(n, 7, 4).cast("bigint"), size(a), size(o) * 10_000)
        return _refill(value, let(p, lambda p: F.concat(lead, _pad(p["l"] + a, 3), _pad(F.floor(p["r"] / 10_000) + o, 3), _pad(p["r"] % 10_000, 4))))
    return let(F.regexp_replace(value, r"\D", ""), of)


def social(key: str, value: Column) -> Column:
    a, g, s = (F.substring(value, i, n).cast("bigint") for i, n in ((1, 3), (5, 2), (8, 4)))
    p = permute(key, "social", a - 1 - (a > 666).cast("int"), (g - 1) * 9999 + s - 1, F.lit(898), F.lit(99 * 9999))
    whole = let(p, lambda p: F.concat_ws("-", _pad(p["l"] + 1 + (p["l"] >= 665).cast("int"), 3), _pad(F.floor(p["r"] / 9999) + 1, 2),
                                         _pad(p["r"] % 9999 + 1, 4)))
    return F.when(a.between(1, 899) & (a != 666) & (g > 0) & (s > 0), whole)


def address(key: str, value: Column) -> Column:
    part = F.split(value, r"\.")
    n = [F.element_at(part, i).cast("bigint") for i in (1, 2, 3, 4)]
    p = permute(key, "address", n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
    whole = let(p, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256), p[h] % 256)]))
    return F.when((n[0] < 256) & (n[1] < 256) & (n[2] < 256) & (n[3] < 256), whole)


def date(key: str, value: Column) -> Column:
    """Pseudonym of a calendar date in the notation it came in; null if there is no such day.

    A date of two-digit parts is read day first; month first only where that can't be (its second part above 12). Those are
    permuted among themselves, so that each notation keeps different dates apart.
    """
    iso, sep = value.rlike(r"^\d{4}-"), F.substring(value, 3, 1)
    day = F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).otherwise(
        F.try_to_timestamp(F.regexp_replace(value, r"\.", "/"), F.lit("dd/MM/yyyy")))
    american = ~iso & day.isNull()
    day = F.coalesce(day, F.when(american, F.try_to_timestamp(F.regexp_replace(value, r"\.", "/"), F.lit("MM/dd/yyyy"))))
    n = F.unix_date(day.cast("date")) - FIRST_DAY

    def walk(x: Column, i: Column) -> Column:
        p = permute(key, "date", F.floor(x / 271), x % 271, F.lit(270), F.lit(271))
        early = F.day(F.date_from_unix_date((F.least(x, F.lit(DAYS - 1)) + FIRST_DAY).cast("int"))) <= 12
        return F.when((i == 1) | (x >= DAYS) | (american & early), let(p, lambda p: p["l"] * 271 + p["r"])).otherwise(x)

    out = F.date_from_unix_date((F.aggregate(F.sequence(F.lit(1), F.lit(60)), n.cast("bigint"), walk) + FIRST_DAY).cast("int"))
    def written(out: Column) -> Column:
        d, m, y = (F.date_format(out, f) for f in ("dd", "MM", "yyyy"))
        return (F.when(iso, F.date_format(out, "yyyy-MM-dd")).when(american, F.concat(m, sep, d, sep, y))
                .otherwise(F.concat(d, sep, m, sep, y)))

    return F.when(n.between(0, DAYS - 1), let(out, written))


def characters(key: str, kind: str, value: Column) -> Column:
    """Class-preserving Feistel permutation of a string: letters a-z, A-Z, those of LETTERS and digits stay in their range; lower-case hex stays hex."""
    letters = F.when(value.rlike("^[0-9a-f]+$"), 6).otherwise(26)

    def shift(half: Column, other: Column, i: Column) -> Column:
        chars = F.filter(F.split(half, ""), lambda c: c != "")

        def all_(h: Column) -> Column:
            def move(ch: Column, at: Column) -> Column:
                k = F.conv(F.substring(h, (at % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
                code = F.ascii(ch)
                def turn(base: int, size) -> Column:
                    return F.char(F.lit(base) + (code - base + k) % size)
                def wide(first: int, last: int) -> Column:
                    at_ = F.lit(first) + (code - first + k) % (last - first + 1)
                    return F.decode(F.unhex(F.lpad(F.hex(at_), 4, "0")), "UTF-16BE")
                out = F.when(ch.between("0", "9"), turn(48, F.lit(10))).when(ch.between("a", "z"), turn(97, letters)).when(ch.between("A", "Z"), turn(65, F.lit(26)))
                for first, last in LETTERS:
                    out = out.when(ch.between(chr(first), chr(last)), wide(first, last))
                return out.otherwise(ch)
            return F.array_join(F.transform(chars, move), "")

        return let(_digest(key, kind, i, other), all_)

    def step(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, shift(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
                        F.when(odd, s["r"]).otherwise(shift(s["r"], s["l"], i)).alias("r"))

    half = F.ceil(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, F.length(value)).alias("r"))
    return let(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), lambda s: F.concat(s["l"], s["r"]))


def pseudonym(key: str, value: Column) -> Column:
    """struct (t, kind): the pseudonym of a found value, or the value itself with kind null."""
    mail = F.concat(characters(key, "mail", F.substring_index(value, "@", 1)), F.lit("@"), F.substring_index(value, "@", -1))
    def named(col: Column, kind: str) -> Column:
        return let(col, lambda t: F.struct(F.coalesce(t, value).alias("t"), F.when(t.isNotNull(), F.lit(kind)).alias("kind")))
    return (F.when(value.rlike(r"^AKIA[0-9A-Z]{16}$"), named(F.concat(F.lit("AKIA"), characters(key, "key", F.substring(value, 5, 16))), "name"))
            .when(value.rlike(f"^{PHONE_FORM}$"), named(phone(key, value), "number"))
            .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), named(social(key, value), "number"))
            .when(value.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), named(date(key, value), "date"))
            .when(value.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), named(address(key, value), "number"))
            .when(value.rlike(r"^\d[\d -]{11,21}\d$"), named(card(key, value), "number"))
            .when(value.rlike(r"^[^@\s]+@[A-Za-z0-9.-]+$"), named(mail, "name"))
            .otherwise(named(characters(key, "secret", value), "name")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """With the caller's secret key: the rows of `docs` with their text rewritten, and how many numbers, dates and names (mail, credentials) it had."""
    values = F.when(F.col("text").rlike(SIGN), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    found = docs.withColumn("__found", F.transform(values, lambda v: pseudonym(key, v)))
    pieces = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(pieces, "__found", lambda p, v: F.concat(p, F.coalesce(v["t"], F.lit("")))), "")
    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("__found", lambda v: v["kind"] == kind)), F.lit(0)).cast("bigint")

    return (found.withColumns({"text": F.when(F.size("__found") > 0, joined).otherwise(F.col("text")),
                               **{f"n_{kind}s": F.when(F.col("__found").isNull(), F.lit(0).cast("bigint")).otherwise(count(kind))
                                  for kind in ("number", "date", "name")}}).drop("__found"))


@query("op7_pii")
def op7_pii(spark, folder):
    return pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), KEY)
