"""Format-preserving Feistel pseudonyms for personal data in text.

Every value found is read as a mixed-radix number, one digit per position, and permuted with a keyed Feistel
network over the two halves of its positions. The permutation depends on nothing but the key, the kind and the
value, so equal values stay linked across documents, different values stay different, and the format stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Longest half of a value that is one Feistel half: 26 ** 12 fits a bigint.
HALF = 12
DATE_FIRST, DATE_DAYS = "1900-01-01", 73049

#: (kind, pattern). Where two patterns match at one place the first of them is tried first.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    ("date", r"(?<![\d-])(?:19|20)\d\d-\d\d-\d\d(?![\d-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|(?:1[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4})(?!\d)"),
    ("intl", r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,5}\)(?:[ .-]?\d){4,12}|(?:[ .-]?\d){6,13})(?!\d)"),
    ("ssn", r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])"),
]
ANY = "|".join(f"(?:{pattern})" for _, pattern in PATTERNS)


def _hash_mod(key: str, kind: Column, round_no: Column, other: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, round_no.cast("string"), other.cast("string"), size.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def feistel(key: str, kind: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct(l, r): the keyed permutation of (left, right) in [0, left_size) x [0, right_size)."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    step = lambda a, i: F.when(
        i % 2 == 0, F.struct(((a["l"] + _hash_mod(key, kind, i, a["r"], left_size)) % left_size).alias("l"), a["r"].alias("r"))
    ).otherwise(F.struct(a["l"].alias("l"), ((a["r"] + _hash_mod(key, kind, i, a["l"], right_size)) % right_size).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _radix(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[a-zA-Z]$"), 26).otherwise(1).cast("bigint")


def _alphabet(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), F.lit(DIGITS)).when(c.rlike("^[a-z]$"), F.lit(LOWER)).otherwise(F.lit(UPPER))


def _digit(c: Column) -> Column:
    return F.greatest(F.position(c, _alphabet(c)) - 1, F.lit(0)).cast("bigint")


def _number(chars: Column) -> Column:
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("size"))
    return F.aggregate(chars, zero, lambda a, c: F.struct((a["n"] * _radix(c) + _digit(c)).alias("n"), (a["size"] * _radix(c)).alias("size")))


def _spell(number: Column, like: Column) -> Column:
    """The number in the characters of `like`: the same class at each position, other characters as they are."""
    zero = F.struct(number.alias("n"), F.lit("").alias("s"))
    char = lambda a, c: F.when(_radix(c) == 1, c).otherwise(F.substr(_alphabet(c), (a["n"] % _radix(c) + 1).cast("int"), F.lit(1)))
    step = lambda a, c: F.struct(F.call_function("div", a["n"], _radix(c)).alias("n"), F.concat(char(a, c), a["s"]).alias("s"))
    return F.aggregate(F.reverse(like), zero, step, lambda a: a["s"])


def permute(key: str, kind: Column, value: Column) -> Column:
    """Permutes the ASCII letters and digits of the value within their classes; values over 2 * HALF go in pieces."""

    def piece(text: Column) -> Column:
        def halves(chars: Column) -> Column:
            cut = F.ceil(F.size(chars) / 2).cast("int")
            left, right = F.slice(chars, 1, cut), F.slice(chars, cut + 1, F.size(chars))
            return _let(F.struct(left.alias("lc"), right.alias("rc"), _number(left).alias("l"), _number(right).alias("r")), lambda x: _let(
                feistel(key, kind, x["l"]["n"], x["r"]["n"], x["l"]["size"], x["r"]["size"]),
                lambda f: F.concat(_spell(f["l"], x["lc"]), _spell(f["r"], x["rc"]))))

        return _let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), halves)

    pieces = F.regexp_extract_all(value, F.lit("(?s).{1,%d}" % (2 * HALF)), F.lit(0))
    return F.array_join(F.transform(pieces, piece), "")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _luhn_digit(body: Column) -> Column:
    """The digit that makes body + digit pass the Luhn check."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    return F.get(F.filter(tries, lambda d: _luhn(F.concat(body, d))), F.lit(0))


def _mod97(text: Column) -> Column:
    """A string of digits and capitals (A = 10 ... Z = 35) modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + _digit(c)) % 97).otherwise((a * 100 + _digit(c) + 10) % 97)
    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0).cast("bigint"), step)


def _refill(digits: Column, like: Column) -> Column:
    """The characters of `like` with its digits replaced, in order, by those given."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct((a["k"] + 1).alias("k"), F.concat(a["s"], F.substr(digits, a["k"], F.lit(1))).alias("s"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["s"], c).alias("s")))
    return F.aggregate(F.regexp_extract_all(like, F.lit("."), F.lit(0)), F.struct(F.lit(1).alias("k"), F.lit("").alias("s")), step, lambda a: a["s"])


def _card(key: str, value: Column) -> Column:
    def change(d: Column) -> Column:
        return _let(permute(key, F.lit("card"), F.substr(d, F.lit(1), F.length(d) - 1)), lambda body: _refill(F.concat(body, _luhn_digit(body)), value))

    return _let(_digits(value), lambda d: F.when(_luhn(d), change(d)))


def _iban(key: str, value: Column) -> Column:
    country, rest = F.substring(value, 1, 2), F.substr(value, F.lit(5), F.length(value))
    valid = _mod97(F.concat(rest, F.substring(value, 1, 4))) == 1
    return F.when(valid, _let(permute(key, F.lit("iban"), rest), lambda b: F.concat(
        country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b)))


def _ip(key: str, value: Column) -> Column:
    def change(o: Column) -> Column:
        two = lambda i: F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))
        size = F.lit(65536).cast("bigint")
        return F.when(~F.exists(o, lambda x: x > 255), _let(feistel(key, F.lit("ip"), two(0), two(2), size, size), lambda f: F.concat_ws(
            ".", *[y.cast("string") for h in ("l", "r") for y in (F.shiftright(f[h], 8), f[h] % 256)])))

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), change)


def _date(key: str, value: Column) -> Column:
    """Days since DATE_FIRST as (row, column) of a 271 x 270 grid; a place past the last day is permuted again."""
    a, b = F.lit(271).cast("bigint"), F.lit(270).cast("bigint")
    walk = lambda n: _let(feistel(key, F.lit("date"), F.call_function("div", n, F.lit(270).cast("bigint")), n % 270, a, b), lambda f: f["l"] * 270 + f["r"])
    day = F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date")
    first = F.lit(DATE_FIRST).cast("date")
    moved = F.aggregate(F.sequence(F.lit(1), F.lit(8)), walk(F.datediff(day, first).cast("bigint")), lambda n, _: F.when(n >= DATE_DAYS, walk(n)).otherwise(n))
    return F.when(day.isNotNull(), F.date_format(F.date_add(first, moved.cast("int")), "yyyy-MM-dd"))


def _tail(key: str, kind: str, value: Column, head: str) -> Column:
    """Permutes what follows the match of `head`."""
    start = F.regexp_extract(value, head, 0)
    return F.concat(start, permute(key, F.lit(kind), F.substr(value, F.length(start) + 1, F.length(value))))


def _ssn(key: str, value: Column) -> Column:
    """Permutes all but the first digit, again while an area, group or serial that is never issued comes out."""
    issued = "^(?!000|666|9)...-(?!00)..-(?!0000)"
    turn = lambda v: _tail(key, "ssn", v, "^.")
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), turn(value), lambda v, _: F.when(v.rlike(issued), v).otherwise(turn(v)))


def _pseudonym(key: str, kind: Column, value: Column) -> Column:
    """The pseudonym, or null if the value is not valid for its kind."""
    return (
        F.when(kind == "email", F.concat(permute(key, F.lit("email"), F.substring_index(value, "@", 1)), F.lit("@"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", _ip(key, value)).when(kind == "date", _date(key, value)).when(kind == "iban", _iban(key, value))
        .when(kind == "card", _card(key, value)).when(kind == "phone", _tail(key, "phone", value, r"^(?:\+?1[ .-]?)?\(?\d"))
        .when(kind == "intl", _tail(key, "intl", value, r"^\+\d\d?")).when(kind == "ssn", _ssn(key, value))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with the personal data in `text` replaced, and a column pii of (kind, n) by kind.

    Kinds: e-mail addresses (local part), IPv4 addresses, ISO dates from 1900 to 2099, IBANs (check digits
    renewed), payment cards (Luhn-valid ones, check digit renewed), North American phone numbers (any area code in
    brackets or after +1, else from 2 to 9 first) and international ones, with or without an area in brackets, US
    social security numbers. Matches that fail validation stay. Defined results: null and empty
    texts stay as they are with no pii; rows are independent, so repeated rows come out alike; all other
    columns of `docs` stay, except one named pii, which is replaced; an empty table gives no rows.
    """
    none = F.array().cast("array<struct<value:string,kind:string,new:string>>")
    kind = lambda m: F.coalesce(*[F.when(m.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS])
    some = F.col("text").rlike("[0-9@]") & F.col("text").rlike(ANY)
    found = F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: _let(kind(m), lambda k: F.struct(m.alias("value"), k.alias("kind"), _pseudonym(key, k, m).alias("new"))))
    out = docs.drop("pii").withColumn("_found", F.when(some, found).otherwise(none))
    gaps = F.split("text", ANY, -1)
    rebuilt = F.array_join(F.zip_with(gaps, "_found", lambda g, f: F.concat(g, F.coalesce(f["new"], f["value"], F.lit("")))), "")
    out = out.withColumn("text", F.when(F.size("_found") > 0, rebuilt).otherwise(F.col("text")))
    valid = F.filter("_found", lambda f: f["new"].isNotNull())
    kinds = F.array(*[F.lit(k) for k, _ in PATTERNS])
    counts = F.transform(kinds, lambda k: F.struct(k.alias("kind"), F.size(F.filter(valid, lambda f: f["kind"] == k)).alias("n")))
    return out.withColumn("pii", F.filter(counts, lambda x: x["n"] > 0)).drop("_found")
