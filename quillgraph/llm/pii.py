"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Values are found by one pattern and checked: card numbers by their Luhn digit, addresses by their octets, social
security numbers by their ranges, dates by the calendar.  What passes is permuted by a keyed Feistel network within
its own format: a card becomes a card with a right check digit, a date a date.  The permutation depends on the key and
the value alone, so equal values get equal pseudonyms in every document and different values different ones.  Mail
addresses, which are no numbers, get a keyed token in the form of a mail address.  What fails its check stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z][A-Za-z0-9\-]*+"
DATE = r"(?<![0-9A-Za-z.\-/])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z\-/])"
ADDRESS = r"(?<![0-9A-Za-z.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])"
SOCIAL = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])"
#: A whole run of digit groups, up to what is a date, a social security number or a phone; _card() looks for the cards in it.
CARD = (r"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![0-9A-Za-z])"
        rf"(?:[ \-](?!{DATE}|{SOCIAL}|{PHONE})[0-9]++(?![0-9A-Za-z]))*+")
KINDS = {"mail": MAIL, "date": DATE, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  #: 17 * 4297 days reach to 2099-12-31


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, domain: Column, key: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs 0 <= l < left_size, 0 <= r < right_size.

    Even rounds add a keyed hash of r to l, odd rounds one of l to r, each modulo its own size; every round can be
    undone, so the whole is a permutation of the domain, whatever the sizes.
    """
    def mix(i: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), domain, i.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["l"] + mix(i, s["r"])) % left_size).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + mix(i, s["l"])) % right_size).alias("r"))

    first = F.struct(F.coalesce(left, F.lit(0)).cast("long").alias("l"), F.coalesce(right, F.lit(0)).cast("long").alias("r"))
    first = first.cast("struct<l:bigint,r:bigint>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, lambda s, i: step(s, i).cast("struct<l:bigint,r:bigint>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one, by ``digits``."""
    gaps = F.split(form, "[0-9]", -1)
    ones = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)))
    return F.array_join(F.zip_with(gaps, F.concat(ones, F.array(F.lit(""))), lambda g, d: F.concat(g, d)), "")


def _padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, F.lit("0"))


def _permuted(digits: Column, domain: str, key: str) -> Column:
    """Digits of any length up to 36, permuted among those of their length."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    out = feistel(F.substring(digits, F.lit(1), a).cast("long"), F.substring(digits, a + 1, n).cast("long"), power(a), power(n - a), F.concat(F.lit(domain), n.cast("string")), key)
    return _let(out, lambda s: F.concat(_padded(s["l"], a), _padded(s["r"], n - a)))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _luhn(digits: Column) -> Column:
    """Luhn sum of a number whose last digit is the check digit."""
    back = F.reverse(digits)
    at = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, at(i)).otherwise(doubled(at(i))))


def _card(m: Column, key: str) -> Column:
    """Of the run's groups, from the left, the most that follow one another, hold 13 to 19 digits and pass Luhn are a card."""
    def changed(t: Column) -> Column:
        def made(d: Column) -> Column:
            body = _permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
            return _let(body, lambda b: _filled(t, F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

        return _let(_digits(t), made)

    def ends(groups: Column) -> Column:
        """For each group the number of groups of the card that begins there, or 0."""
        def reach(i: Column) -> Column:
            span = lambda k: F.array_join(F.transform(F.slice(groups, i, k), _digits), "")
            fits = lambda k: _let(span(k), lambda d: F.when(F.length(d).between(13, 19), _luhn(d) % 10 == 0).otherwise(False))
            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.size(groups) - i + 1, F.lit(19))), fits)), F.lit(0))

        return F.transform(F.sequence(F.lit(1), F.size(groups)), reach)

    def cards(n: Column) -> Column:
        """Structs (at, to) of the cards, none over another."""
        kind = "array<struct<at:int,to:int>>"
        add = lambda s, i: F.when((F.element_at(n, i) > 0) & ~F.exists(s, lambda c: c["to"] >= i), F.concat(
            s, F.array(F.struct(i.alias("at"), (i + F.element_at(n, i) - 1).alias("to"))).cast(kind))).otherwise(s)
        return F.aggregate(F.sequence(F.lit(1), F.size(n)), F.array().cast(kind), add)

    def shown(groups: Column, found: Column) -> Column:
        def one(i: Column) -> Column:
            mine = F.filter(found, lambda c: (c["at"] <= i) & (c["to"] >= i))
            whole = F.array_join(F.slice(groups, i, F.element_at(mine, 1)["to"] - i + 1), "")
            return F.when(F.size(mine) == 0, F.element_at(groups, i)).when(F.element_at(mine, 1)["at"] < i, "").otherwise(_let(whole, changed))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.size(groups)), one), "")

    # groups with the separator before them
    return _let(F.regexp_extract_all(m, F.lit("[ \\-]?[0-9]+"), F.lit(0)), lambda g: _let(
        ends(g), lambda n: F.when(F.exists(n, lambda x: x > 0), _let(cards(n), lambda c: shown(g, c))).otherwise(m)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays; the ten digits after it are permuted."""
    return _let(_digits(m), lambda d: _filled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), _permuted(F.right(d, F.lit(10)), "phone", key))))


def _address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    fine = F.forall(parts, lambda p: p <= 255)
    out = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), F.lit("address"), key)
    return F.when(fine, _let(out, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))).otherwise(m)


def _social(m: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99 and serials 0001-9999."""
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("social"), key)

    def shown(s: Column) -> Column:
        i = F.floor(s["l"] / 99)
        return F.concat_ws("-", _padded(F.when(i >= 665, i + 2).otherwise(i + 1), F.lit(3)), _padded(s["l"] % 99 + 1, F.lit(2)), _padded(s["r"] + 1, F.lit(4)))

    return F.when(fine, _let(out, shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Calendar dates of 1900 to 2099 are permuted among themselves; others stay."""
    day = F.date_diff(F.try_to_date(m, "yyyy-MM-dd"), F.lit(_FIRST_DAY).cast("date")).cast("long")
    a, b = _DAYS
    out = feistel(day % a, F.floor(day / a), F.lit(a), F.lit(b), F.lit("date"), key)
    return F.when((day >= 0) & (day < a * b), _let(out, lambda s: F.date_format(F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["r"] * a + s["l"]).cast("int")), "yyyy-MM-dd"))).otherwise(m)


def _mail(m: Column, key: str) -> Column:
    token = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)).cast("binary"), 256)
    return _let(token, lambda t: F.concat(F.lit("u"), F.substring(t, 1, 12), F.lit("@d"), F.substring(t, 13, 6), F.lit(".invalid")))


def kind_of(m: Column) -> Column:
    """Name of the first kind whose pattern the whole of m is."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(m.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """m permuted within its format, or m itself where it fails the check of its kind."""
    made = {"mail": _mail, "date": _date, "address": _address, "social": _social, "phone": _phone, "card": _card}
    def chosen(k: Column) -> Column:
        out = m
        for name in reversed(KINDS):
            out = F.when(k == name, made[name](m, key)).otherwise(out)
        return out

    return _let(kind_of(m), chosen)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """docs with the personal data of text_col replaced in out_col and the number of replaced values in count_col.

    Null texts stay null with 0 replaced; other columns, rows and repeats are as they were; an empty table stays
    empty.  The text is scanned whole, in one pass of a pattern that cannot run away on long tokens.
    """
    body, found, new = F.col(text_col), "_found_values", "_new_values"
    some = body.rlike("[0-9]|@")
    with_found = docs.withColumn(found, F.when(some, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    with_new = with_found.withColumn(new, F.transform(F.col(found), lambda m: pseudonym(m, key)))
    joined = F.array_join(F.zip_with(F.split(body, ANY, -1), F.concat(F.col(new), F.array(F.lit(""))), lambda t, v: F.concat(t, v)), "")
    changed = F.size(F.filter(F.zip_with(F.col(found), F.col(new), lambda a, b: a != b), lambda x: x)).cast("long")
    return (
        with_new.withColumn(count_col, F.when(body.isNull(), F.lit(0)).otherwise(changed).cast("long"))
        .withColumn(out_col, F.when(F.size(found) > 0, joined).otherwise(body)).drop(found, new)
    )
