"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Card numbers, telephone numbers, social-security numbers, IPv4 addresses, e-mail names
and dates are found by one pattern, validated, and put through a keyed Feistel network
over exactly the values of their format.  A network is a permutation: equal values get
equal pseudonyms in every document, different values different ones, and a pseudonym is
again a valid value of the format.  Invalid matches stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EPOCH, DAYS = "1900-01-01", 270 * 270  # 1900-01-01 to 2099-08-05
BEFORE, AFTER = 245 * 2831, 44 * 65581  # days from 0001-01-01 to the day before, and from the day after to 9999-12-31
#: Month-first dates that cannot be day-first: month and day in all years, and leap years with a 29 February.
_SLOTS = ",".join(f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, 32) if d <= (28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31))
_LEAP = ",".join(f"{y:04}" for y in range(1, 10000) if y % 4 == 0 and (y % 100 or y % 400 == 0) and not 1900 <= y <= 2099)

#: Kind -> pattern; the first that matches wins. No pattern can restart inside a run of its own characters.
PATTERNS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "dialled": r"\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){2,4}(?![0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}-){3}[0-9]{1,7}|(?:[0-9]{4} ){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
_DATES = {r"^[0-9]{4}-": "yyyy-MM-dd", r"^[0-9]{4}/": "yyyy/MM/dd", r"^[0-9]{2}\.": "dd.MM.yyyy", r"^[0-9]{2}/": "dd/MM/yyyy"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b, as struct<a,b>."""

    def hashed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(acc: Column, i: Column) -> Column:
        first = F.struct(((acc["a"] + hashed(i, acc["b"]) % size_a) % size_a).alias("a"), acc["b"].alias("b"))
        second = F.struct(acc["a"].alias("a"), ((acc["b"] + hashed(i, acc["a"]) % size_b) % size_b).alias("b"))
        return F.when(i % 2 == 0, first).otherwise(second)

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _text(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0"))


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _fill(shape: Column, characters: Column, kept: str) -> Column:
    """shape with its characters of the class kept replaced in turn."""
    step = lambda acc, c: F.when(
        c.rlike(kept), F.struct(F.concat(acc["s"], F.substr(characters, acc["k"], F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), step)["s"]


def _permute_digits(d: Column, tweak: str, key: str) -> Column:
    """A permutation of the digit strings of the length of d (2 to 36)."""
    n = F.length(d)
    u = F.floor(n / 2).cast("int")
    v = n - u
    pair = feistel(F.substr(d, F.lit(1), u), F.substr(d, u + 1, v), _ten(u), _ten(v), F.concat(F.lit(tweak), n.cast("string")), key)
    return _let(pair, lambda p: F.concat(_text(p["a"], u), _text(p["b"], v)))


def luhn_sum(d: Column) -> Column:
    """The Luhn sum of a digit string; valid if a multiple of 10."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    """The first digit stays (its network), the check digit follows from the others."""

    def make(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), "card", key))
        whole = _let(body, lambda x: F.concat(x, ((F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, _fill(m, whole, "[0-9]")).otherwise(m)

    return _let(_digits(m), make)


def _phone(m: Column, key: str) -> Column:
    """A leading 1 stays. Where area code and exchange start with 2 to 9 they do so after; other numbers stay among
    those of an area code below 200, or else of an exchange below 200."""

    def make(d: Column) -> Column:
        n = F.length(d)
        area, rest = F.substr(d, n - 9, F.lit(3)).cast("long"), F.substr(d, n - 6, F.lit(7)).cast("long")
        odd_area, odd_rest = area < 200, (area >= 200) & (rest < 2_000_000)
        least_a, size_a = F.when(odd_area, 0).otherwise(200), F.when(odd_area, 200).otherwise(800)
        least_b = F.when(odd_area | odd_rest, 0).otherwise(2_000_000)
        size_b = F.when(odd_area, 10_000_000).when(odd_rest, 2_000_000).otherwise(8_000_000)
        pair = feistel(area - least_a, rest - least_b, size_a, size_b, F.lit("phone"), key)
        new = _let(pair, lambda p: F.concat(F.substr(d, F.lit(1), n - 10), _text(p["a"] + least_a, F.lit(3)), _text(p["b"] + least_b, F.lit(7))))
        return _fill(m, new, "[0-9]")

    return _let(_digits(m), make)


def _dialled(m: Column, key: str) -> Column:
    """An international number: the first two digits stay; 8 to 15 digits are valid."""
    make = lambda d: F.when(
        F.length(d).between(8, 15), _fill(m, F.concat(F.substring(d, 1, 2), _permute_digits(F.substr(d, F.lit(3), F.length(d) - 2), "dialled", key)), "[0-9]")
    ).otherwise(m)
    return _let(_digits(m), make)


def _ip(m: Column, key: str) -> Column:
    def make(o: Column) -> Column:
        part = lambda k: o[k].cast("long")
        pair = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
        byte = lambda x, k: F.floor(x / 256 if k == 0 else x % 256).cast("string")
        new = _let(pair, lambda p: F.concat_ws(".", byte(p["a"], 0), byte(p["a"], 1), byte(p["b"], 0), byte(p["b"], 1)))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), new).otherwise(m)

    return _let(F.split(m, r"\."), make)


def _ssn(m: Column, key: str) -> Column:
    def make(d: Column) -> Column:
        area, group, serial = (F.substring(d, s, n).cast("long") for s, n in ((1, 3), (4, 2), (6, 4)))
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit("ssn"), key)
        new = _let(pair, lambda p: F.concat_ws(
            "-", F.lpad((p["a"] + F.when(p["a"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((F.floor(p["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["b"] % 9999 + 1).cast("string"), 4, "0"),
        ))
        return F.when(valid, new).otherwise(m)

    return _let(_digits(m), make)


def _month_first(m: Column, key: str) -> Column:
    """A date such as 12/31/1999, of which the second number is above 12: again such a date.

    Years of 1900 to 2099 stay among themselves, as do other years, and 29 February among leap years.
    """
    slots, leap = F.split(F.lit(_SLOTS), ","), F.split(F.lit(_LEAP), ",")
    year, day = F.substring(m, 7, 4).cast("long"), F.substring(m, 1, 5)
    near = year.between(1900, 2099)
    place = F.array_position(slots, day) - 1
    of_year = F.when(near, year - 1900).when(year < 1900, year - 1).otherwise(year - 201)
    pair = feistel(of_year, place, F.when(near, 200).otherwise(9799), F.lit(len(_SLOTS.split(","))), F.lit("month"), key)
    year_of = lambda k: F.when(near, k + 1900).when(k < 1899, k + 1).otherwise(k + 201)
    usual = _let(pair, lambda p: F.concat(F.get(slots, p["b"].cast("int")), F.lit("/"), _text(year_of(p["a"]), F.lit(4))))
    at = F.when(near, (year - 1904) / 4).otherwise(F.array_position(leap, F.substring(m, 7, 4)) - 1).cast("long")
    small, big = F.when(near, 7).otherwise(25), F.when(near, 7).otherwise(95)
    rare = _let(feistel(F.floor(at / big), at % big, small, big, F.lit("leap"), key), lambda p: _let(p["a"] * big + p["b"], lambda k: F.concat(F.lit("02/29/"), F.when(near, (k * 4 + 1904).cast("string")).otherwise(F.get(leap, k.cast("int"))))))
    return F.when(day == "02/29", rare).otherwise(usual)


def _date(m: Column, key: str) -> Column:
    def moved(form: str) -> Callable[[Column], Column]:
        def part(n: Column, first: int, big: int, small: int, tweak: str) -> Column:
            pair = feistel(F.floor((n - first) / small), (n - first) % small, F.lit(big), F.lit(small), F.lit(tweak), key)
            return _let(pair, lambda p: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (p["a"] * small + p["b"] + first).cast("int")), form))

        def make(n: Column) -> Column:
            usual = F.when(n.between(0, DAYS - 1), part(n, 0, 270, 270, "date"))
            return usual.when(n.between(-BEFORE, -1), part(n, -BEFORE, 245, 2831, "before")).when(n.between(DAYS, DAYS + AFTER - 1), part(n, DAYS, 44, 65581, "after")).otherwise(m)

        return make

    out = m
    for shape, form in _DATES.items():
        day = F.datediff(F.try_to_date(m, form), F.lit(EPOCH).cast("date"))
        out = F.when(m.rlike(shape), _let(day, moved(form))).otherwise(out)
    month_first = m.rlike("^[0-9]{2}/(1[3-9]|[23])") & ~m.endswith("0000") & F.try_to_date(m, "MM/dd/yyyy").isNotNull()
    return F.when(month_first, _month_first(m, key)).otherwise(out)


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the name are base-36 digits, permuted in blocks of 22; the domain stays."""

    def block(s: Column, k: Column) -> Column:
        n = F.length(s)
        u = F.floor(n / 2).cast("int")
        v = n - u
        number = lambda x: F.coalesce(F.conv(x, 36, 10).cast("long"), F.lit(0))
        size = lambda x: F.aggregate(F.sequence(F.lit(0), x), F.lit(1).cast("long"), lambda acc, i: F.when(i == 0, acc).otherwise(acc * 36))
        pair = feistel(number(F.substr(s, F.lit(1), u)), number(F.substr(s, u + 1, v)), size(u), size(v), F.concat(F.lit("email"), k.cast("string"), F.lit("/"), n.cast("string")), key)
        base36 = lambda x, w: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), w, F.lit("0"))
        return _let(pair, lambda p: F.concat(F.when(u > 0, base36(p["a"], u)).otherwise(""), base36(p["b"], v)))

    def make(name: Column) -> Column:
        plain = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
        whole = _let(plain, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 22).cast("int")), lambda k: block(F.substr(x, k * 22 + 1, F.least(F.lit(22), F.length(x) - k * 22)), k)), ""))
        new = F.concat(_fill(name, whole, "[A-Za-z0-9]"), F.substr(m, F.length(name) + 1, F.length(m)))
        return F.when(F.length(plain) > 0, new).otherwise(m)

    return _let(F.substring_index(m, "@", 1), make)


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "dialled": _dialled, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind of a match of ANY."""
    out = F.lit(KINDS[-1])
    for k in reversed(KINDS[:-1]):
        out = F.when(m.rlike(f"^(?:{PATTERNS[k]})$"), k).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    out = m
    for k, make in _MAKERS.items():
        out = F.when(kind == k, make(m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, found array<struct<kind,pseudonym>>), a row per row; texts without valid matches stay as they are.

    key: the secret of the permutations; with another key all pseudonyms differ.  found lists the replaced values in
    text order, by kind and pseudonym only.  A null text stays null with nothing found; other columns are left out.
    """
    text = F.col(text_col)
    matches = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def entry(m: Column) -> Column:
        return _let(kind_of(m), lambda k: F.struct(k.alias("kind"), m.alias("old"), pseudonym(m, k, key).alias("pseudonym")))

    listed = docs.select(F.col(id_col), text.alias("_text"), F.transform(matches, entry).alias("_all"))
    between = F.split(F.col("_text"), ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(between, F.transform("_all", lambda x: x["pseudonym"]), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    changed = F.filter("_all", lambda x: x["old"] != x["pseudonym"])
    return listed.select(
        F.col(id_col),
        F.when(F.size("_all") > 0, joined).otherwise(F.col("_text")).alias("text"),
        F.coalesce(F.transform(changed, lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym"))), F.array().cast("array<struct<kind:string,pseudonym:string>>")).alias("found"),
    )
