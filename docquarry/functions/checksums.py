"""Check digits as Column expressions over digit strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(text: Column) -> Column:
    """Values of 0-9 and A-Z (10 to 35), other characters left out."""
    bare = F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")
    return F.transform(
        F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    )


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))


def mod_97(text: Column) -> Column:
    """ISO 7064 mod 97-10 of the whole string is 1 (letters count as two digits)."""
    rest = F.aggregate(digits(text), F.lit(0), lambda a, d: F.when(d > 9, (a * 100 + d) % 97).otherwise((a * 10 + d) % 97))
    return rest == 1


def iban(text: Column) -> Column:
    """The first four characters go last, then mod 97-10."""
    bare = F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")
    return F.length(bare).between(15, 34) & bare.rlike("^[A-Z]{2}[0-9]{2}") & mod_97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)))


def mod_11_2(text: Column) -> Column:
    """ISO 7064 mod 11-2 with a last digit or X."""
    bare = F.regexp_replace(F.upper(text), "[^0-9X]", "")
    head = digits(F.substr(bare, F.lit(1), F.length(bare) - 1))
    total = F.aggregate(head, F.lit(0), lambda a, d: (a + d) * 2 % 11)
    last = F.when(F.right(bare, F.lit(1)) == "X", 10).otherwise(F.right(bare, F.lit(1)).try_cast("int"))
    return (12 - total) % 11 == last


def mod_11_10(text: Column) -> Column:
    """ISO 7064 mod 11-10."""
    number = digits(text)
    last = F.element_at(number, -1)
    p = F.aggregate(F.slice(number, F.lit(1), F.size(number) - 1), F.lit(10), lambda a, d: F.when((a + d) % 10 == 0, 20 % 11).otherwise((a + d) % 10 * 2 % 11))
    return (11 - p) % 10 == last


def weighted(text: Column, weights: Sequence[int], modulus: int, target: int = 0) -> Column:
    """Sum of digits times weights, all digits weighted, modulo `modulus`."""
    values = digits(text)
    total = F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    return (F.size(values) == len(weights)) & (total % modulus == target)


def imo(text: Column) -> Column:
    """Ship numbers: the last digit is that of the first six, weighted 7 to 2."""
    values = digits(text)
    total = F.aggregate(F.zip_with(F.slice(values, 1, 6), F.array(*[F.lit(w) for w in range(7, 1, -1)]), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    return (F.size(values) == 7) & (total % 10 == F.element_at(values, 7))


def isin(text: Column) -> Column:
    """Two letters, nine characters and a digit; Luhn over the digits of the letters' values."""
    bare = F.upper(F.trim(text))
    spelt = F.array_join(F.transform(digits(bare), lambda d: d.cast("string")), "")
    return bare.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$") & F.call_function("luhn_check", spelt)


#: The table of the Damm quasigroup, row by row.
DAMM = "0317598642 7092154863 4206871359 1750983426 6123045978 3674209581 5869720134 8945362017 9438617205 2581436790"


def damm(text: Column) -> Column:
    table = F.lit(DAMM.replace(" ", ""))
    state = F.aggregate(digits(text), F.lit(0), lambda a, d: F.substr(table, a * 10 + d + 1, F.lit(1)).cast("int"))
    return state == 0
