"""Operator 10: format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values are permuted inside their own format by a keyed alternating
Feistel network: the value is split in two parts, and each round adds a keyed hash of
one part (SHA-256 of key, kind, round and part) to the other, modulo the size of that
part.  A permutation keeps equal values equal and different values different, so
documents stay linked without a table of values.

kind   | valid if                                     | what is permuted
-------|----------------------------------------------|------------------------------------
card   | 13 to 19 digits, also grouped, Luhn sum is 0 | all but the check digit, set anew
ssn    | no part is 0, area is not 666 or 9xx         | serial and group (area kept)
phone  | ten digits in groups, with a country code or | the last seven digits
       | without                                      |
       | + and 8 to 15 digits, in one or with a space,| all digits after the third
       | dot or dash between groups                   |
ip     | four octets of 0 to 255                      | all 32 bits
date   | a calendar day of 1800 to 2199; a slash date | the day's number in these 400 years; of a
       | is month first, or else day first            | day-first slash date, see ``_day_first``
email  | local part @ domain with a top level         | letters and digits of the local part

Not covered, and left as they are: numbers that only context tells (nine digits in one, a phone
number of one country without separators), dates without leading zeros, IPv6 and IBAN.

Everything is Spark expressions; a text is split at the matches and joined again.
Null text stays null; a value that is not valid stays as it is.  Repeated rows get equal
texts.  Columns of ``documents`` stay, but for one named ``pii``, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read

# The patterns of the kinds.
GROUPED = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![A-Za-z0-9]|[.-]\d)"
ABROAD = r"\+[1-9](?:\d{7,14}|\d{0,2}(?:[ .-](?:\(\d{1,4}\)|\d{1,12})){1,5})(?![A-Za-z0-9]|[.-]\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}\.(?:xn--[A-Za-z0-9-]{1,59}|[A-Za-z]{2,24})(?![A-Za-z0-9])",
    "ip": r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9]|\.\d)",
    "date": r"(?<![A-Za-z0-9./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![A-Za-z0-9]|[./-]\d)",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)",
    "phone": rf"(?<![A-Za-z0-9])(?:{GROUPED}|{ABROAD})",
    "card": r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rounds of the network; days of 400 Gregorian years and two factors of them.
ROUNDS, YEARS_DAYS, DAY_PARTS = 10, 146_097, (189, 773)
FIRST_DAY, YEARS = "1800-01-01", range(1800, 2200)
LEAP = [y for y in YEARS if y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)]


def _keyed(key: Column, kind: str, round_: Column, part: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(kind), round_, part).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def permute(value: Column, low_size: Column, high_size: Column, key: Column, kind: str) -> Column:
    """Keyed permutation of 0 .. low_size * high_size - 1."""
    start = F.struct(F.floor(value / low_size).cast("long").alias("high"), F.pmod(value, low_size).cast("long").alias("low"))

    def step(s: Column, i: Column) -> Column:
        low = F.when(i % 2 == 0, F.pmod(s["low"] + _keyed(key, kind, i, s["high"]), low_size)).otherwise(s["low"])
        high = F.when(i % 2 == 1, F.pmod(s["high"] + _keyed(key, kind, i, s["low"]), high_size)).otherwise(s["high"])
        return F.struct(high.cast("long").alias("high"), low.cast("long").alias("low"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["high"] * low_size + s["low"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _lay_out(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by ``digits``."""
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    is_digit = lambda c: (c >= "0") & (c <= "9")
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(is_digit(c), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + is_digit(c).cast("int")).alias("at"))
    return F.aggregate(F.split(text, ""), state, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """Luhn sum; every second digit is doubled, starting with the given place from the right (0 is the last)."""
    double = F.pmod(F.length(digits) - 1 - F.lit(doubled_from_right), F.lit(2))
    value = lambda c, i: F.when(F.pmod(i, F.lit(2)) == double, F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int"))).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _card(text: Column, key: Column) -> Column:
    digits = _digits(text)
    n = F.length(digits) - 1
    head = F.substring(digits, F.lit(1), n)
    low = F.floor(n / 2).cast("int")
    new = F.lpad(permute(head.cast("long"), _power(low), _power(n - low), key, "card").cast("string"), n, "0")
    check = F.pmod(10 - F.pmod(luhn_sum(new, 0), F.lit(10)), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits, 1) % 10 == 0, _lay_out(text, F.concat(new, check)))


def _ssn(text: Column, key: Column) -> Column:
    area, group, serial = (F.substring(text, a, n) for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")
    # 99 groups by 9999 serials, none of them 0
    new = permute((group.cast("long") - 1) * 9999 + serial.cast("long") - 1, F.lit(9999).cast("long"), F.lit(99).cast("long"), F.concat(key, area), "ssn")
    return F.when(ok, F.concat(area, F.lit("-"), F.lpad((F.floor(new / 9999) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((new % 9999 + 1).cast("string"), 4, "0")))


def _phone(text: Column, key: Column) -> Column:
    digits = _digits(text)
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - 7), F.substring(digits, F.length(digits) - 6, F.lit(7))
    new = F.lpad(permute(tail.cast("long"), F.lit(1000).cast("long"), F.lit(10000).cast("long"), F.concat(key, head), "phone").cast("string"), 7, "0")
    # abroad area codes have any length, so all but three digits are permuted
    code, n = F.substring(digits, F.lit(1), F.lit(3)), F.length(digits) - 3
    low = F.floor(n / 2).cast("int")
    own = F.lpad(permute(F.substring(digits, F.lit(4), n).cast("long"), _power(low), _power(n - low), F.concat(key, code), "phone").cast("string"), n, "0")
    abroad = F.when(F.length(digits).between(8, 15), _lay_out(text, F.concat(code, own)))
    return F.when(text.rlike(f"^(?:{GROUPED})$"), _lay_out(text, F.concat(head, new))).otherwise(abroad)


def _ip(text: Column, key: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    new = permute(value, F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    written = F.concat_ws(".", *(F.floor(new / 256**k) % 256 for k in (3, 2, 1, 0)))
    return F.when(F.forall(octets, lambda x: x < 256), written)


def _day_first(text: Column, key: Column) -> Column:
    """Slash dates that only make sense day first, among each other: so no two dates get one pseudonym.

    Days 13 to 28 are permuted with month and year; days 29 to 31 keep day and month, and their year is
    permuted among the leap years or among the others.
    """
    day, month, year = (F.substring(text, a, n).cast("long") for a, n in ((1, 2), (4, 2), (7, 4)))
    ok = (day > 12) & (month <= 12) & year.between(YEARS[0], YEARS[-1]) & F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))).isNotNull()
    new = permute(((year - YEARS[0]) * 12 + month - 1) * 16 + day - 13, F.lit(240).cast("long"), F.lit(320).cast("long"), key, "day-first")
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    whole = F.concat_ws("/", two(new % 16 + 13), two(F.floor(new / 16) % 12 + 1), (F.floor(new / 192) + YEARS[0]).cast("string"))

    def among(years: list[int], low: int, kind: str) -> Column:
        held = F.array(*map(F.lit, years))
        at = permute(F.array_position(held, year.cast("int")) - 1, F.lit(low).cast("long"), F.lit(len(years) // low).cast("long"), F.concat(key, F.substring(text, 1, 5)), kind)
        return F.concat(F.substring(text, 1, 6), F.get(held, at.cast("int")).cast("string"))

    late = F.when(year.cast("int").isin(LEAP), among(LEAP, 1, "leap")).otherwise(among([y for y in YEARS if y not in LEAP], 3, "common"))
    return F.when(ok, F.when(day <= 28, whole).otherwise(late))


def _date(text: Column, key: Column) -> Column:
    def valued(shape: str) -> Column:
        number = F.datediff(F.to_date(F.try_to_timestamp(text, F.lit(shape))), F.lit(FIRST_DAY).cast("date")).cast("long")
        new = permute(number, F.lit(DAY_PARTS[1]).cast("long"), F.lit(DAY_PARTS[0]).cast("long"), key, "date")
        return F.when(number.between(0, YEARS_DAYS - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), new.cast("int")), shape))

    slash = F.coalesce(valued("MM/dd/yyyy"), _day_first(text, key))
    return F.when(text.rlike(r"^\d{4}-"), valued("yyyy-MM-dd")).when(text.rlike(r"^\d{2}\.\d{2}\."), valued("dd.MM.yyyy")).when(text.rlike(r"^\d{2}/\d{2}/"), slash)


def _email(text: Column, key: Column) -> Column:
    """A Feistel network over characters: each round shifts the letters and digits of one half within their own kind."""
    local = F.substring_index(text, "@", 1)
    half = F.ceil(F.length(local) / 2).cast("int")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        def one(c: Column, at: Column) -> Column:
            move = _keyed(key, "email", F.concat_ws("|", i, at), other)
            code = F.ascii(c)
            turn = lambda low, n: F.chr((low + F.pmod(code - low + move, F.lit(n).cast("long"))).cast("long"))
            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        return F.when(F.length(part) > 0, F.array_join(F.transform(F.split(part, ""), one), "")).otherwise(part)

    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(shifted(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i).alias("b")))
    new = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: F.concat(s["a"], s["b"]))
    return F.concat(new, F.substring(text, F.length(local) + 1, F.length(text)))


_MASKS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with pseudonyms in ``text`` and ``pii``, a map from kind to the number of values replaced (null text: null)."""
    secret = F.lit(key)
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    values, new = fresh(documents, "_values"), fresh(documents, "_told")
    df = documents.withColumn(values, F.when(F.col("text").rlike(ANY), found))

    def told(value: Column) -> Column:
        kind = None
        for name, pattern in PATTERNS.items():
            own = F.when(value.rlike(f"^(?:{pattern})$"), F.struct(F.lit(name).alias("kind"), _MASKS[name](value, secret).alias("new"), value.alias("old")))
            kind = own if kind is None else F.coalesce(kind, own)
        return kind

    df = df.withColumn(new, F.transform(values, told))
    between = F.split("text", ANY)
    pieces = F.zip_with(between, new, lambda part, x: F.concat(part, F.coalesce(x["new"], x["old"], F.lit(""))))
    df = df.withColumn("text", F.when(F.col(new).isNotNull(), F.array_join(pieces, "")).otherwise(F.col("text")))
    done = F.filter(F.coalesce(new, F.array().cast("array<struct<kind:string,new:string,old:string>>")), lambda x: x["new"].isNotNull())
    number = lambda kind: F.size(F.filter(done, lambda x: x["kind"] == kind)).cast("long")
    counts = F.map_from_arrays(F.array(*map(F.lit, PATTERNS)), F.array(*map(number, PATTERNS)))
    return df.withColumn("pii", F.when(F.col("text").isNotNull(), counts)).drop(values, new)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-1")
    return out.select("doc_id", *(F.coalesce(F.col("pii")[k], F.lit(0)).cast("long").alias(f"n_{k}") for k in PATTERNS), "text")
