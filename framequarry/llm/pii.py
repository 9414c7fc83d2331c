"""Format-preserving pseudonyms for personal data, in SQL functions only.

Found are mail addresses, payment card numbers (Luhn-valid), IPv4 addresses (octets up to 255), phone
numbers and calendar dates (1900 to 2099, real days). Each is permuted within its own format by a
keyed Feistel network, so a value has the same pseudonym in every document, two values never share
one, and the result is again a valid value of its kind:

card    all digits but the last are permuted as one number, the last is the new check digit.
phone   the last ten digits are permuted; a country code, blanks and brackets stay.
ip      the two halves of the 32 bits are permuted.
date    the day's number is permuted among the days of the range (walking on while outside of it).
mail    letters stay letters and digits digits in the local part (lower-cased); the domain stays.

Values are linked whatever their separators: only digits count, and what stands between them is put
back. What fails its test (a number with a wrong check digit, a 31st of April) is left alone, and what it
holds is still looked at: mail first, then cards with a group of six, then addresses, dates and phones,
then cards in other printed groups, then in any other groups, each in what the ones before have left. Values may touch with a blank,
a dash or a dot between them; a dotted run of more than four numbers is read as addresses from the left.
Null texts are returned as null with no findings; texts of any length are treated whole, and no pattern
repeats a group in a way that needs a stack. An empty table gives an empty one; columns other than
doc_id and text are ignored, whatever their names; rows that repeat are answered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

KINDS = ("email", "card", "ip", "date", "phone")
#: What each kind looks like.
#: Mail: begins behind another address or anything that is no part of one; the domain has no empty label, ends in
#: letters, and leaves a word that an @ follows to the next address. One character at a time: no stack is needed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@(?!\.)(?:(?!\.\.)[A-Za-z0-9.-])+\.[A-Za-z]{2,}+(?![A-Za-z0-9_%+]*+@)"
#: Groups of digits one blank or dash apart, 13 digits or more: cards are looked for at every group.
CHAIN = r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
#: How cards are printed, and any other grouping; the first form that is Luhn-valid counts.
#: Those with a group of six, which may end like a phone, are looked for before phones.
WITH_SIX = ("[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}",)
PRINTED = ("[0-9]{13,19}", "[0-9]{4}(?:[ -][0-9]{4}){3}", "[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,3}")
GROUPED = tuple(f"(?:[0-9][ -]?){{{n - 1}}}[0-9]" for n in range(19, 12, -1))
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
IP = rf"(?<![0-9A-Za-z])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z])"
DATE = r"(?<![0-9A-Za-z])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])"
#: Signs around what is settled (with its kind's sign), and before a group that a card begins at.
EDGE, BEGINS = "\ue000", "\ue001"
UNIT = f"{EDGE}[^{EDGE}]*+{EDGE}"
SIGNS = dict(zip(KINDS, "ecidp", strict=True))
ROUNDS = 8
FIRST_DAY, DAYS, DAY_LEFT, DAY_RIGHT = "1900-01-01", 73049, 271, 270


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _draw(key: Column, kind: str, turn: int, value: Column) -> Column:
    """A keyed pseudo-random number below 2^60 from a value."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(f"{kind}|{turn}"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: Column, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Permutes the pairs (left, right) of numbers below the two sizes: a struct of both."""
    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for turn in range(ROUNDS):
        step = _left_step(key, kind, turn, left_size) if turn % 2 == 0 else _right_step(key, kind, turn, right_size)
        pair = let(pair, step)
    return pair


def _left_step(key: Column, kind: str, turn: int, size: Column):
    return lambda p: F.struct(((p["l"] + _draw(key, kind, turn, p["r"]) % size) % size).alias("l"), p["r"].alias("r"))


def _right_step(key: Column, kind: str, turn: int, size: Column):
    return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _draw(key, kind, turn, p["l"]) % size) % size).alias("r"))


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """Permutes the digit strings of one length (2 to 36 digits) among themselves."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    left, right = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    mixed = feistel(key, f"{kind}", left, right, _ten_to(half), _ten_to(rest))
    return let(mixed, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, "0"), F.lpad(p["r"].cast("string"), rest, "0")))


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def put_back(form: Column, digits: Column) -> Column:
    """The form with its digits replaced in order; everything else stays."""
    places = F.sequence(F.lit(1), F.length(form))
    return F.array_join(
        F.transform(
            places,
            lambda i: let(
                F.substring(form, i, F.lit(1)),
                lambda c: F.when(c.between("0", "9"), F.substring(digits, F.length(only_digits(F.substring(form, F.lit(1), i))), F.lit(1))).otherwise(c),
            ),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit weighing one."""

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weigh), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _day(match: Column) -> Column:
    """The day's number in the range, or null if there is no such day."""
    d = only_digits(match)
    iso = F.substring(match, 5, 1) == "-"
    year = F.when(iso, F.substring(d, 1, 4)).otherwise(F.substring(d, 5, 4))
    month = F.when(iso, F.substring(d, 5, 2)).when(F.substring(match, 3, 1) == "/", F.substring(d, 1, 2)).otherwise(F.substring(d, 3, 2))
    day = F.when(iso, F.substring(d, 7, 2)).when(F.substring(match, 3, 1) == "/", F.substring(d, 3, 2)).otherwise(F.substring(d, 1, 2))
    parsed = F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date")
    number = F.datediff(parsed, F.lit(FIRST_DAY).cast("date"))
    return F.when((number >= 0) & (number < DAYS), number)


def kind_of(match: Column) -> Column:
    """Which kind a match of an address, date or phone is after its test; null if it fails."""
    return (
        F.when(match.rlike(rf"^(?:{IP})$"), F.lit("ip"))
        .when(match.rlike(rf"^(?:{DATE})$"), F.when(_day(match).isNotNull(), F.lit("date")))
        .when(match.rlike(rf"^(?:{PHONE})$"), F.lit("phone"))
    )


def _card(key: Column, match: Column) -> Column:
    def permuted(d: Column) -> Column:
        body = permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return put_back(match, let(only_digits(match), permuted))


def _phone(key: Column, match: Column) -> Column:
    d = only_digits(match)
    kept = F.length(d) - 10
    return put_back(match, F.concat(F.substring(d, F.lit(1), kept), permute_digits(key, "phone", F.substring(d, kept + 1, F.lit(10)))))


def _ip(key: Column, match: Column) -> Column:
    o = F.transform(F.split(match, r"\."), lambda x: x.cast("long"))
    size = F.lit(65536).cast("long")
    mixed = let(o, lambda a: feistel(key, "ip", F.get(a, F.lit(0)) * 256 + F.get(a, F.lit(1)), F.get(a, F.lit(2)) * 256 + F.get(a, F.lit(3)), size, size))
    return let(mixed, lambda p: F.concat_ws(".", *(F.floor(x / 256).cast("string") if high else (x % 256).cast("string") for x in (p["l"], p["r"]) for high in (True, False))))


def _date(key: Column, match: Column) -> Column:
    def once(n: Column) -> Column:
        mixed = feistel(key, "date", F.floor(n / DAY_RIGHT), n % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT))
        return let(mixed, lambda p: p["l"] * DAY_RIGHT + p["r"])

    # the permuted number is outside of the range once in 600 cases: go on from there until it is inside, which
    # takes no more steps than there are numbers outside, and one
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(DAY_LEFT * DAY_RIGHT - DAYS)), F.struct(_day(match).cast("long").alias("n"), F.lit(False).alias("done")), lambda a, _: F.when(a["done"], a).otherwise(let(once(a["n"]), lambda n: F.struct(n.alias("n"), (n < DAYS).alias("done")))), lambda a: a["n"])
    date = let(walked, lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int")))
    third = F.substring(match, 3, 1)
    return let(date, lambda d: F.when(third == "/", F.date_format(d, "MM/dd/yyyy")).when(third == ".", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")))


def _email(key: Column, match: Column) -> Column:
    """The local part's two halves in turn, each letter or digit moved by what the other half gives."""
    domain = F.lower(F.substring_index(match, "@", -1))
    local = F.lower(F.substring_index(match, "@", 1))

    def moved(part: Column, other: Column, turn: int) -> Column:
        def shift(draw: Column, c: Column, i: Column, base: int, first: int) -> Column:
            return F.char(F.pmod(F.ascii(c) - first + F.pmod(F.xxhash64(draw, i), F.lit(base)), F.lit(base)) + first)

        def by(draw: Column) -> Column:  # bound once: a digest a half, not one a letter
            moves = lambda c, i: F.when(c.between("a", "z"), shift(draw, c, i, 26, 97)).when(c.between("0", "9"), shift(draw, c, i, 10, 48)).otherwise(c)
            return F.array_join(F.transform(F.split(part, ""), moves), "")

        return let(F.sha2(F.concat_ws("|", key, F.lit(f"email|{turn}"), other), 256), by)

    half = F.floor(F.length(local) / 2).cast("int")
    pair = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local) - half).alias("r"))
    for turn in range(ROUNDS):
        pair = let(pair, _mail_step(moved, turn))
    return let(pair, lambda p: F.concat(p["l"], p["r"], F.lit("@"), domain))


def _mail_step(moved, turn: int):
    if turn % 2 == 0:
        return lambda p: F.struct(moved(p["l"], p["r"], turn).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), moved(p["r"], p["l"], turn).alias("r"))


def _swapped(text: Column, pattern: str, stand_in) -> Column:
    """The text with every match of a pattern outside of settled parts replaced."""
    pattern = f"{UNIT}|{pattern}"
    ins = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(m.startswith(EDGE), m).otherwise(stand_in(m)))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), ins, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def _unit(kind: str, value: Column) -> Column:
    return F.concat(F.lit(EDGE + SIGNS[kind]), value, F.lit(EDGE))


def _begun(chain: Column, forms: tuple[str, ...]) -> Column:
    """The chain with a sign before every group that a card begins at, and a letter for its number of groups."""

    def groups_of(rest: Column) -> Column:
        tried = F.array(*(F.regexp_extract(rest, f"^{form}(?![0-9])", 0) for form in forms))
        valid = F.filter(tried, lambda c: (c != "") & (luhn_sum(only_digits(c)) % 10 == 0))
        return let(F.get(valid, F.lit(0)), lambda c: F.length(F.regexp_replace(c, "[0-9]", "")) + 1)

    def each(groups: Column) -> Column:
        def signed(g: Column, k: Column) -> Column:
            return let(groups_of(F.array_join(F.slice(groups, k + 1, F.lit(20)), "")), lambda n: F.when(n.isNull(), g).otherwise(F.concat(F.lit(BEGINS), F.char(n + 96), g)))

        return F.array_join(F.transform(groups, signed), "")

    return let(F.regexp_extract_all(chain, F.lit("[0-9]+[ -]?"), F.lit(0)), each)


def _cards(forms: tuple[str, ...], key: Column) -> list:
    """The steps that settle cards: begin them at every group, take the leftmost, drop the other signs."""
    group, sign = f"(?:{BEGINS}[a-s])?[0-9]++", f"{BEGINS}[a-s]"
    taken = "(?:" + "|".join(f"{BEGINS}{chr(96 + n)}[0-9]++(?:[ -]{group}){{{n - 1}}}" for n in range(1, 20)) + ")"
    return [
        lambda s: _swapped(s, CHAIN, lambda m: _begun(m, forms)),
        lambda s: _swapped(s, taken, lambda m: _unit("card", _card(key, F.regexp_replace(m, sign, "")))),
        lambda s: F.regexp_replace(s, sign, ""),
    ]


def _other(key: Column, match: Column) -> Column:
    kinds = {"ip": _ip, "date": _date, "phone": _phone}

    def named(kind: Column) -> Column:
        out = F.when(kind.isNull(), match)
        for name, of in kinds.items():
            out = out.when(kind == name, _unit(name, of(key, match)))
        return out

    return let(kind_of(match), named)


def _held(spark: SparkSession, secret: str) -> DataFrame:
    """One row with the key, made in the JVM; plans show its column's name alone."""
    jvm, cells = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    cells[0] = secret
    rows = jvm.java.util.ArrayList()
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(cells))
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(StructType([StructField("pii_key", StringType(), False)]).json())
    return DataFrame(spark._jsparkSession.createDataFrame(rows, kind), spark)


def pseudonymise(docs: DataFrame, secret: str) -> DataFrame:
    """doc_id, n_email, n_card, n_ip, n_date, n_phone, the text with pseudonyms, and its sha256; one row for each row.

    One narrow projection: no shuffle, no Python. `secret` is the key of the permutation: whoever knows it can
    undo the pseudonyms, so the caller brings it, and it stands in no plan: it travels as a row.
    """
    if not secret:
        raise ValueError("pseudonyms need a key")
    key = F.col("pii_key")
    # a text without digits and @ holds nothing: it skips all scans
    some = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    steps = [
        # signs of the text itself are settled from the start
        lambda s: F.when(some, F.replace(F.replace(s, F.lit(EDGE), F.lit(f"{EDGE}x{EDGE}")), F.lit(BEGINS), F.lit(f"{EDGE}y{EDGE}"))),
        lambda s: _swapped(s, EMAIL, lambda m: _unit("email", _email(key, m))),
        *_cards(WITH_SIX, key),
        lambda s: _swapped(s, "|".join((IP, DATE, PHONE)), lambda m: _other(key, m)),
        *_cards(PRINTED, key),
        *_cards(GROUPED, key),
    ]
    found = docs.select("doc_id", "text", F.col("text").alias("s")).crossJoin(F.broadcast(_held(docs.sparkSession, secret)))
    for step in steps:
        found = found.withColumn("s", step(F.col("s")))
    units = found.withColumn("units", F.coalesce(F.regexp_extract_all("s", F.lit(UNIT), F.lit(0)), F.array().cast("array<string>")))

    def inside(unit: Column) -> Column:
        out = F.substring(unit, F.lit(3), F.length(unit) - 3)
        return F.when(unit == f"{EDGE}x{EDGE}", EDGE).when(unit == f"{EDGE}y{EDGE}", BEGINS).otherwise(out)

    joined = F.array_join(F.zip_with(F.split("s", UNIT, -1), F.transform("units", inside), lambda p, u: F.concat(p, F.coalesce(u, F.lit("")))), "")
    whole = units.withColumn("out", F.when(F.size("units") > 0, joined).otherwise(F.col("text")))
    counts = [F.size(F.filter("units", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return whole.select("doc_id", *counts, F.col("out").alias("text"), F.sha2("out", 256).alias("text_sha256"))


def _is(kind: str):
    return lambda u: u.startswith(EDGE + SIGNS[kind])
