"""Parts of the entity rules that have uses of their own: exact money, codes with weights, cues, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal places of currencies that don't have two (ISO 4217).
EXPONENTS = {"JPY": 0, "KRW": 0, "CLP": 0, "VND": 0, "ISK": 0, "BHD": 3, "KWD": 3, "OMR": 3, "JOD": 3, "TND": 3}


def exponent(currency: Column) -> Column:
    """Decimal places of a currency."""
    out = F.lit(2)
    for code, places in EXPONENTS.items():
        out = F.when(currency == code, places).otherwise(out)
    return out


def minor_units(amount: Column, places: Column) -> Column:
    """An amount such as 1,234.5 in the currency's smallest unit, as text, without ever being a
    float; null if it has more decimal places than the currency."""
    plain = F.regexp_replace(amount, ",", "")
    whole, rest = F.regexp_extract(plain, "^-?([0-9]+)", 1), F.regexp_extract(plain, "[.]([0-9]+)$", 1)
    digits = F.regexp_replace(F.concat(whole, F.rpad(rest, places, "0")), "^0+(?=[0-9])", "")
    return F.when(F.length(rest) <= places, F.concat(F.when(plain.startswith("-"), "-").otherwise(""), digits))


def facet_key(kind: Column, value: Column) -> Column:
    """The key under which a value is counted: its kind, and the value trimmed, collapsed, in lower case."""
    return F.concat(kind, F.lit(":"), F.lower(F.trim(F.regexp_replace(value, r"\s+", " "))))


def near_cue(text: Column, at: Column, cues: Sequence[str], reach: int = 40) -> Column:
    """Whether one of the cues stands, as a word, in the `reach` characters before a match at `at` (from 1)."""
    before = F.lower(F.substr(text, F.greatest(at - reach, F.lit(1)), at - F.greatest(at - reach, F.lit(1))))
    return before.rlike(r"\b(?:" + "|".join(cues) + r")\b")


def is_date_format(code: Column) -> Column:
    """Whether a spreadsheet's number format shows a date or time: a letter of d, m, y, h, s outside quotes, brackets and escapes."""
    bare = F.regexp_replace(F.lower(code), r'"[^"]*"|\\.|_.|\[[^\]]*\]', "")
    return ~F.contains(bare, F.lit("general")) & bare.rlike("[dmyhs]")


def iso_6346(text: Column) -> Column:
    """A container's code: letters count 10 to 38 without multiples of 11, places double, modulo 11, modulo 10."""
    bare = F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55 + F.floor((F.ascii(c) - 55 - 1) / 10))
    total = sum((value(F.substring(bare, i + 1, 1)) * (1 << i) for i in range(10)), F.lit(0))
    return (F.length(bare) == 11) & (total % 11 % 10 == F.ascii(F.substring(bare, 11, 1)) - 48)


def aba(text: Column) -> Column:
    """A routing number: weights 3, 7, 1, divisible by ten, not all zero."""
    digit = lambda i: F.substring(text, i + 1, 1).cast("int")
    return (F.length(text) == 9) & (text != "000000000") & (sum((digit(i) * (3, 7, 1)[i % 3] for i in range(9)), F.lit(0)) % 10 == 0)


def prepared_match(raw: Column) -> Column:
    """What a user types, made safe for matching: a dangling quote goes, a slash or tilde that isn't
    a phrase's modifier becomes a blank, parentheses outside phrases are balanced."""
    odd = F.pmod(F.regexp_count(raw, F.lit('"')), F.lit(2)) == 1
    text = F.when(odd, F.regexp_replace(raw, '"([^"]*)$', "$1")).otherwise(raw)
    text = F.regexp_replace(text, r'(?<!")[/~]|(?<=")[/~](?![0-9])', " ")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"), F.lit(False).alias("phrase"))

    def step(s: Column, c: Column) -> Column:
        quote, inside = c == '"', s["phrase"]
        surplus = ~inside & (c == ")") & (s["open"] == 0)
        opened = F.when(~inside & (c == "("), s["open"] + 1).when(~inside & (c == ")") & ~surplus, s["open"] - 1).otherwise(s["open"])
        return F.struct(F.when(surplus, s["out"]).otherwise(F.concat(s["out"], c)).alias("out"), opened.alias("open"), F.when(quote, ~inside).otherwise(inside).alias("phrase"))

    closed = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda s: F.concat(s["out"], F.repeat(F.lit(")"), s["open"])))
    return F.trim(F.regexp_replace(closed, r"\s+", " "))


def has_positive_term(prepared: Column) -> Column:
    """Whether a prepared query asks for anything: it is empty, or not all of its terms are negated."""
    return (prepared == "") | F.exists(F.split(F.regexp_replace(prepared, r"[()|]", " "), r"\s+"), lambda t: (t != "") & ~t.rlike("^[!-]"))
