import datetime
import hashlib
import re

from pyspark.sql import functions as F

from quillgraph.llm import pii

KEY = "test key"


def network(left, right, a, b, domain):
    def mix(i, x):
        return int(hashlib.sha256(f"{KEY}|{domain}|{i}|{x}".encode()).hexdigest()[:15], 16)

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + mix(i, right)) % a
        else:
            right = (right + mix(i, left)) % b
    return left, right


def luhn(s):
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(map(int, reversed(s))))


def permuted(d, domain):
    a = len(d) // 2
    left, right = network(int(d[:a]), int(d[a:]), 10**a, 10 ** (len(d) - a), f"{domain}{len(d)}")
    return f"{left:0{a}d}{right:0{len(d) - a}d}"


def filled(form, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), form)


def brute(m):
    d = re.sub("[^0-9]", "", m)
    if "@" in m:
        h = hashlib.sha256(f"{KEY}|mail|{m.lower()}".encode()).hexdigest()
        return f"u{h[:12]}@d{h[12:18]}.invalid"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", m):
        try:
            day = (datetime.date.fromisoformat(m) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return m
        if not 0 <= day < 17 * 4297:
            return m
        left, right = network(day % 17, day // 17, 17, 4297, "date")
        return (datetime.date(1900, 1, 1) + datetime.timedelta(right * 17 + left)).isoformat()
    if re.fullmatch(r"(\d+\.){3}\d+", m):
        p = list(map(int, m.split(".")))
        if max(p) > 255:
            return m
        left, right = network(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "address")
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return m
        left, right = network((a - 2 if a > 666 else a - 1) * 99 + g - 1, s - 1, 898 * 99, 9999, "social")
        i = left // 99
        return f"{i + 2 if i >= 665 else i + 1:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if len(d) in (10, 11, 12, 13) and re.search(r"[ .(-]", m) and luhn(d) % 10 or re.match(r"\+|\(", m):
        return filled(m, d[:-10] + permuted(d[-10:], "phone"))
    if luhn(d) % 10:
        return m
    body = permuted(d[:-1], "card")
    return filled(m, body + str(-luhn(body + "0") % 10))


VALUES = ["joe.88@mail7.example.com", "2024-02-29", "2023-02-29", "1850-01-01", "10.20.30.255", "10.20.30.256", "123-45-6789", "666-45-6789", "+1 (017) 555-7713", "555-123-4567",
          "4845168114407329", "4845168114407328", "4111-1111-1111-1111", "0.0.0.0", "2099-12-31"]


def test_pseudonyms_match_brute_force_and_keep_their_format(spark):
    text = "x " + ", ".join(VALUES) + " end é " + VALUES[0]
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (3, "", "c"), (4, "no data", "d"), (5, "A" * 200_000 + " " + "9" * 100_000, "e"), (5, VALUES[10], "f"), (6, VALUES[10] + "***", "g")], "doc_id long, text string, found string")
    got = {r["found"]: r for r in pii.pseudonymised(df, KEY).collect()}
    want = text
    for v in VALUES:
        want = re.sub(rf"(?<![\w.]){re.escape(v)}(?!\w)", lambda _, v=v: brute(v), want)
    assert got["a"]["text"] == want
    assert got["a"]["n_replaced"] == 1 + sum(brute(v) != v for v in VALUES)
    assert got["b"]["text"] is None and got["b"]["n_replaced"] == 0
    assert [got[k]["n_replaced"] for k in "cde"] == [0, 0, 0] and got["e"]["text"] == "A" * 200_000 + " " + "9" * 100_000
    assert got["f"]["text"] + "***" == got["g"]["text"] != VALUES[10] + "***" and luhn(got["f"]["text"]) % 10 == 0
    assert pii.pseudonymised(df.limit(0), KEY).count() == 0


def test_the_network_is_a_permutation(spark):
    all_pairs = spark.range(17 * 23).select((F.col("id") % 17).alias("l"), F.floor(F.col("id") / 17).alias("r"))
    out = all_pairs.select(pii.feistel(F.col("l"), F.col("r"), F.lit(17), F.lit(23), F.lit("d"), KEY).alias("s"))
    assert out.distinct().count() == 17 * 23


def test_single_digit_addresses_and_cards_beside_other_numbers(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    want = {
        "see 8.8.8.8": f"see {brute('8.8.8.8')}",
        f"{spaced} 123 end": f"{brute(spaced)} 123 end",
        f"12 {card}": f"12 {brute(card)}",
        f"1234 {spaced}": f"1234 {brute(spaced)}",
        f"{spaced} {card} 7": f"{brute(spaced)} {brute(card)} 7",
        f"{card} 555-123-4567": f"{brute(card)} {brute('555-123-4567')}",
        f"{card} 2024-02-29 {card} 12ab": f"{brute(card)} {brute('2024-02-29')} {brute(card)} 12ab",
        "1 " * 3000: "1 " * 3000,
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymised(df, KEY).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())
