"""Format-preserving pseudonyms for personal data, in DataFrame and SQL expressions only.

Numbers and dates that pass validation are replaced by a keyed permutation of
their own format: a Feistel network on two residues (a in Z_m, b in Z_n) whose
rounds add a keyed hash of the one to the other. It is a bijection of m * n
values for any moduli, so no value is walked or rejected, equal values get equal
pseudonyms in all documents, and different values different ones:

* card numbers (13 to 19 digits, Luhn valid): first digit and length stay, the
  digits between are permuted, the check digit is set anew;
* telephone numbers of the North American plan (area code and exchange from 200, or
  a country code or brackets): permuted, area and exchange staying below 200 or not;
* IPv4 addresses: the 32 bits are permuted;
* ISO dates from 1900-01-01 on, 72,900 days: permuted among these days;
* social security numbers (area 001 to 899 without 666, group and serial not 0);
* e-mail addresses are no numbers: local part and domain become keyed hashes
  of their lower-cased form under a reserved domain.

Separators, brackets and everything between are kept, as is the time after a date. Values that fail
validation (a Luhn-invalid number, 2024-02-31, an octet of 300) aren't personal data
in these formats and stay.

Each text is split once at candidate matches and put together again, all inside
one projection: no shuffle, no Python.

Defined cases: a null text stays null with no findings; null ids are carried;
repeated rows get equal results; very long texts are handled in one pass, in time
in proportion to their length; an e-mail domain has 127 labels at most; other
columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: The key of the query alone; pseudonyms are no safer than the key, so the operator asks for one.
DEMO_KEY = "sievewright-demo-key"
ROUNDS = 8
#: A number may follow punctuation, unless that continues another number.
_B, _E = r"(?<![\p{L}\p{N}_])(?<!\p{N}[.+-])", r"(?![\p{L}\p{N}_])"
#: Candidate formats in order of preference at one place (Java regular expressions).
#: An e-mail address starts where its local part does, the others at a digit, + or (,
#: so that most characters are passed over at once. Every repetition has a bound: Java's
#: engine recurses for repeated groups, and a long text must neither overflow its stack nor take quadratic time.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,126}[A-Za-z]{2,24}",
    "ip": _B + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![\p{L}\p{N}_]|\.[0-9])",
    "date": _B + r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?!(?!T[0-9])[\p{L}\p{N}_-])",
    "ssn": _B + r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])",
    "phone": r"(?<![\p{L}\p{N}_.-])(?:\+1[0-9]{10}|(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + _E,
    "card": _B + r"(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}_-])",
}
_NUMBERS = "|".join(f"(?:{p})" for k, p in FORMATS.items() if k != "email")
CANDIDATE = f"(?:{FORMATS['email']})|(?=[0-9+(])(?:{_NUMBERS})"
DAYS = 270 * 270


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _round(key: str, name: str, i: Column, value: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws("|", F.lit(key), F.lit(name), i.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, name: str, a: Column, b: Column, m: Column, n: Column) -> Column:
    """Permute (a, b) of Z_m x Z_n: struct(a, b). ``m`` and ``n`` may differ by row."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        new_a = F.pmod(s["a"] + F.pmod(_round(key, name, i, s["b"]), m), m)
        new_b = F.pmod(s["b"] + F.pmod(_round(key, name, i, s["a"]), n), n)
        return F.when(i % 2 == 0, F.struct(new_a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), new_b.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order, by those of ``digits``."""
    chars = F.split(template, "")
    state = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def put(a: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(a["s"], F.when(is_digit, F.substring(digits, a["i"] + 1, F.lit(1))).otherwise(c)).alias("s"),
            (a["i"] + is_digit.cast("int")).alias("i"),
        )

    return F.aggregate(chars, state, put, lambda a: a["s"])


def _luhn_sum(digits: Column, doubled_last: bool) -> Column:
    def add(acc: Column, x: Column) -> Column:
        d = x["d"]
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(x["p"] % 2 == (0 if doubled_last else 1), twice).otherwise(d)

    places = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("p")))
    return F.aggregate(places, F.lit(0), add)


def _card(key: str, x: Column) -> Column:
    def make(d: Column) -> Column:
        inner = F.length(d) - 2  # all but the first and the check digit
        left = F.floor(inner / 2).cast("int")
        m, n = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), inner - left).cast("long")
        a, b = F.substring(d, 2, left).cast("long"), F.substring(d, left + 2, inner - left).cast("long")
        name = F.length(d)

        def build(s: Column) -> Column:
            body = F.concat(F.substring(d, 1, 1), F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), inner - left, "0"))
            return let(body, lambda y: _refill(x, F.concat(y, F.pmod(-_luhn_sum(y, True), F.lit(10)).cast("string"))))

        # Lengths are domains of their own: the first digit and the length go into the key.
        mixed = let(feistel(key, "card", a, b, m, n), build)
        return F.when((_luhn_sum(d, False) % 10 == 0) & (name > 12) & ~d.rlike(r"^(.)\1*$"), mixed)

    return let(_digits(x), make)


def _phone(key: str, x: Column) -> Column:
    """Area and exchange are each below 200 or not, and stay so; the rest is permuted."""

    def make(all_digits: Column) -> Column:
        d = F.substring(all_digits, -10, 10)
        area, exchange, line = (F.substring(d, p, k).cast("long") for p, k in ((1, 3), (4, 3), (7, 4)))
        low = [F.when(v < 200, 0).otherwise(200) for v in (area, exchange)]
        size = [F.when(v < 200, 20_000).otherwise(80_000) for v in (area, exchange)]
        a, b = (area - low[0]) * 100 + F.floor(line / 100), (exchange - low[1]) * 100 + line % 100

        def build(s: Column) -> Column:
            new = F.concat(
                F.lpad((F.floor(s["a"] / 100) + low[0]).cast("string"), 3, "0"),
                F.lpad((F.floor(s["b"] / 100) + low[1]).cast("string"), 3, "0"),
                F.lpad((s["a"] % 100 * 100 + s["b"] % 100).cast("string"), 4, "0"),
            )
            return _refill(x, F.concat(F.substring(all_digits, 1, F.length(all_digits) - 10), new))

        # Without a country code or brackets only numbers of the plan are telephone numbers.
        valid = x.startswith("+") | x.contains("(") | ((area >= 200) & (exchange >= 200))
        return F.when(valid, let(feistel(key, "phone", a, b, *size), build))

    return let(_digits(x), make)


def _ip(key: str, x: Column) -> Column:
    def make(o: Column) -> Column:
        part = lambda i: o[i].cast("long")
        valid = F.forall(o, lambda v: (v.cast("int") < 256) & ((F.length(v) == 1) | ~v.startswith("0")))
        mixed = let(
            feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65_536), F.lit(65_536)),
            lambda s: F.concat_ws(".", *(F.floor(v).cast("string") for v in (s["a"] / 256, s["a"] % 256, s["b"] / 256, s["b"] % 256))),
        )
        return F.when(valid, mixed)

    return let(F.split(x, r"\."), make)


def _date(key: str, x: Column) -> Column:
    first = F.to_date(F.lit("1900-01-01"))

    def make(day: Column) -> Column:
        mixed = let(
            feistel(key, "date", F.floor(day / 270), day % 270, F.lit(270), F.lit(270)),
            lambda s: F.date_format(F.date_add(first, (s["a"] * 270 + s["b"]).cast("int")), "yyyy-MM-dd"),
        )
        return F.when((day >= 0) & (day < DAYS), mixed)

    return let(F.date_diff(F.try_to_date(x, "yyyy-MM-dd"), first), make)


def _ssn(key: str, x: Column) -> Column:
    """Areas 001..899 but 666, groups 01..99, serials 0001..9999."""

    def make(p: Column) -> Column:
        area, group, serial = p[0].cast("long"), p[1].cast("long"), p[2].cast("long")
        a = (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1

        def build(s: Column) -> Column:
            k = F.floor(s["a"] / 99) + 1
            new_area = F.when(k >= 666, k + 1).otherwise(k)
            pad = lambda v, w: F.lpad(v.cast("string"), w, "0")
            return F.concat_ws("-", pad(new_area, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(feistel(key, "ssn", a, serial - 1, F.lit(898 * 99), F.lit(9999)), build))

    return let(F.split(x, "-"), make)


def _email(key: str, x: Column) -> Column:
    h = lambda name, v: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(name), F.lower(v)).cast("binary"), 256), 1, 16)
    return F.concat(F.lit("u"), h("local", x), F.lit("@"), F.lit("d"), F.substring(h("domain", F.substring_index(x, "@", -1)), 1, 8), F.lit(".invalid"))


def pseudonym(x: Column, key: str) -> Column:
    """struct(kind, value) of one candidate; null if it passes no validation."""
    makers = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind in reversed(FORMATS):
        made = let(makers[kind](key, x), _named(kind))
        out = F.when(x.rlike(f"^(?:{FORMATS[kind]})$"), made).otherwise(out)
    return out


def _named(kind: str):
    return lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def pseudonymise(documents: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (pseudonymised), kinds (of what was replaced, in order) and the
    columns of ``extra``. Texts without a digit next to a separator or an at sign
    have no candidate and are passed through."""
    rows = documents.select(F.col(id_col).alias("doc_id"), *extra, F.col(text_col).cast("string").alias("sw_t"))
    rows = rows.withColumn("sw_m", F.regexp_extract_all("sw_t", F.lit(CANDIDATE), 0))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    rows = rows.withColumn("sw_p", F.when(F.size("sw_m") > 0, F.transform("sw_m", lambda x: pseudonym(x, key))).otherwise(none))
    gaps = F.split("sw_t", CANDIDATE, -1)
    # n matches have n + 1 gaps; every gap but the first follows a match.
    woven = let(gaps, lambda g: F.array_join(F.transform(g, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.coalesce(F.get("sw_p", i - 1)["value"], F.get("sw_m", i - 1)), x))), ""))
    changed = F.exists("sw_p", lambda p: p.isNotNull())
    kinds = F.transform(F.filter("sw_p", lambda p: p.isNotNull()), lambda p: p["kind"])
    return rows.select("doc_id", *extra, F.when(changed, woven).otherwise(F.col("sw_t")).alias("text"), kinds.alias("kinds"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by pseudonyms."""
    found = pseudonymise(table(spark, sf_dir, "documents"), key=DEMO_KEY)
    counts = [F.size(F.array_remove(F.col("kinds"), name)) for name in FORMATS]
    counts = [(F.size("kinds") - c).cast("long").alias(f"n_{name}") for c, name in zip(counts, FORMATS, strict=True)]
    return found.select("doc_id", "text", *counts)
