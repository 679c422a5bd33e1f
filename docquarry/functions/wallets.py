"""Checksums of wallet addresses as Column expressions: base58 with double SHA-256, bech32, capitals by Keccak-256."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets, and the generator and final constants of the bech32 code (1 for witness version 0).
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_END, BECH32M_END = 1, 0x2BC830A3
PREFIX = (3, 3, 0, 2, 3)

PATTERN = r"\b(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{8,87}|BC1[02-9AC-HJ-NP-Z]{8,87})\b"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _longs(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _places(text: Column, alphabet: str) -> Column:
    """Places of characters in an alphabet, from 0."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.position(c, F.lit(alphabet)) - 1).cast("long"))


def base58_hex(text: Column) -> Column:
    """A base58 number of up to 36 characters as 54 hex digits: nine limbs of 24 bits, times 58 with carry."""

    def times(limbs: Column, digit: Column) -> Column:
        start = F.struct(digit.alias("carry"), F.slice(limbs, 1, 0).alias("out"))

        def limb(s: Column, x: Column) -> Column:
            v = x * 58 + s["carry"]
            return F.struct(F.shiftright(v, 24).alias("carry"), F.concat(s["out"], F.array(v % (1 << 24))).alias("out"))

        return F.aggregate(limbs, start, limb, lambda s: s["out"])

    limbs = F.aggregate(_places(text, BASE58), _longs(*[0] * 9), times)
    return F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.hex(x), 6, "0")), "")


def base58check(text: Column) -> Column:
    """Whether an address of 25 bytes has version 0 or 5, a 1 for each leading zero byte, and the
    first four bytes of its double SHA-256 at the end."""

    def judge(digits: Column) -> Column:
        own, body = F.substring(digits, 5, 50), F.substring(digits, 5, 42)
        twice = F.sha2(F.unhex(F.sha2(F.unhex(body), 256)), 256)
        ones = F.length(F.regexp_extract(text, "^1*", 0)) * 2 == F.length(F.regexp_extract(own, "^(?:00)*", 0))
        return digits.startswith("0000") & F.substring(own, 1, 2).isin("00", "05") & ones & (F.upper(F.substring(twice, 1, 8)) == F.substring(own, 43, 8))

    return text.rlike(f"^[{BASE58}]+$") & _let(base58_hex(text), judge)


def polymod(values: Column) -> Column:
    """The remainder of the bech32 code over values of five bits."""

    def step(a: Column, v: Column) -> Column:
        out = F.shiftleft(a.bitwiseAND(0x1FFFFFF), 5).bitwiseXOR(v)
        for i, g in enumerate(GENERATOR):
            out = out.bitwiseXOR(F.shiftright(a, 25 + i).bitwiseAND(1) * g)
        return out

    return F.aggregate(values, F.lit(1).cast("long"), step)


def segwit(text: Column) -> Column:
    """Whether a bc1 address is of one case, has the constant of its witness version, and a program
    of whole bytes: 20 or 32 of them in version 0, 2 to 40 up to version 16."""

    def judge(data: Column) -> Column:
        version, n = F.get(data, F.lit(0)), F.size(data) - 7
        size, left = F.floor(n * 5 / 8), n * 5 % 8
        rest = F.try_element_at(data, n + 1).bitwiseAND(F.get(_longs(0, 1, 3, 7, 15), left)) == 0
        end = F.when(version == 0, BECH32_END).otherwise(BECH32M_END)
        fits = F.when(version == 0, size.isin(20, 32)).otherwise(size.between(2, 40))
        return F.when((n < 2) | (version > 16) | (left > 4), False).otherwise(rest & fits & (polymod(F.concat(_longs(*PREFIX), data)) == end))

    spelled = F.lower(text).rlike(f"^bc1[{BECH32}]+$")
    return spelled & ((text == F.lower(text)) | (text == F.upper(text))) & _let(_places(F.substr(F.lower(text), F.lit(4)), BECH32), judge)


def segwit_address(program: Column, version: int = 0) -> Column:
    """The bc1 address of a program in hex."""
    padded = F.rpad(program, 65, "0")
    group = lambda i: F.conv(F.substr(padded, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("long")
    value = lambda i: F.get(F.array(*[F.shiftright(group(i), s) for s in (15, 10, 5, 0)]), i % 4).bitwiseAND(31)
    values = F.concat(_longs(version), F.transform(F.sequence(F.lit(0), (F.ceil(F.length(program) * 4 / 5) - 1).cast("int")), value))

    def spelt(data: Column) -> Column:
        rest = polymod(F.concat(_longs(*PREFIX), data, _longs(*[0] * 6))).bitwiseXOR(BECH32_END if version == 0 else BECH32M_END)
        every = _let(rest, lambda r: F.concat(data, F.array(*[F.shiftright(r, s).bitwiseAND(31) for s in range(25, -1, -5)])))
        return F.concat(F.lit("bc1"), F.array_join(F.transform(every, lambda v: F.substr(F.lit(BECH32), v.cast("int") + 1, F.lit(1))), ""))

    return _let(values, spelt)


def bitcoin(text: Column) -> Column:
    """Whether an address that PATTERN finds has a right checksum."""
    return F.when(F.lower(F.substring(text, 1, 3)) == "bc1", segwit(text)).otherwise(base58check(text))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _round_constants() -> list[int]:
    """Of the 24 rounds, from the register x^8 + x^6 + x^5 + x^4 + 1: one bit for each power of two."""
    out, r = [], 1
    for _ in range(24):
        constant = 0
        for j in range(7):
            constant |= (r & 1) << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(_signed(constant))
    return out


def _walk() -> tuple[list[int], list[int]]:
    """For each lane the one that moves there, and by how far that is turned."""
    source, turn, x, y = [0] * 25, [0] * 25, 1, 0
    for t in range(24):
        to = y + 5 * ((2 * x + 3 * y) % 5)
        source[to], turn[to] = x + 5 * y, (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return source, turn


def keccak_lanes(lanes: Column) -> Column:
    """The permutation of 25 lanes of 64 bits, as a fold over the round constants."""
    every, (source, turn) = F.sequence(F.lit(0), F.lit(24)), _walk()
    source, turn = F.array(*[F.lit(v) for v in source]), F.array(*[F.lit(v) for v in turn])
    turned = lambda v, n: F.call_function("shiftleft", v, n).bitwiseOR(F.call_function("shiftrightunsigned", v, 64 - n))

    def column(s: Column, x: Column) -> Column:
        out = F.get(s, x)
        for y in range(1, 5):
            out = out.bitwiseXOR(F.get(s, x + 5 * y))
        return out

    def theta(s: Column, c: Column) -> Column:
        return F.transform(s, lambda v, i: v.bitwiseXOR(F.get(c, (i + 4) % 5)).bitwiseXOR(turned(F.get(c, (i + 1) % 5), F.lit(1))))

    def chi(b: Column, constant: Column) -> Column:
        at = lambda i, k: F.get(b, i - i % 5 + (i + k) % 5)
        mixed = lambda v, i: v.bitwiseXOR(F.bitwise_not(at(i, 1)).bitwiseAND(at(i, 2)))
        return F.transform(b, lambda v, i: F.when(i == 0, mixed(v, i).bitwiseXOR(constant)).otherwise(mixed(v, i)))

    def one(s: Column, constant: Column) -> Column:
        parity = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda x: column(s, x))
        moved = lambda t: F.transform(every, lambda j: turned(F.get(t, F.get(source, j)), F.get(turn, j)))
        return _let(_let(parity, lambda c: theta(s, c)), lambda t: _let(moved(t), lambda b: chi(b, constant)))

    return F.aggregate(_longs(*_round_constants()), lanes, one)


def eip55(text: Column) -> Column:
    """Whether a 0x address of mixed case has its capitals where the Keccak-256 of the lower-case
    digits has a half byte of 8 or more; of one case it claims nothing and is taken."""
    digits = F.substr(text, F.lit(3))
    low = F.lower(digits)
    lane = lambda k: F.conv(F.hex(F.reverse(F.substring(low, 8 * k + 1, 8))), 16, -10).cast("long")
    block = F.concat(F.array(*[lane(k) for k in range(5)]), _longs(1, *[0] * 10, _signed(1 << 63), *[0] * 8))
    half = lambda s, i: F.call_function("shiftrightunsigned", F.get(s, F.floor(i / 16).cast("int")), (F.floor(i / 2).cast("int") % 8) * 8 + F.when(i % 2 == 0, 4).otherwise(0)).bitwiseAND(15)
    right = lambda s: F.forall(F.transform(F.split(digits, ""), lambda c, i: ~c.rlike("[A-Fa-f]") | (c.rlike("[A-F]") == (half(s, i) >= 8))), lambda ok: ok)
    return F.when((digits == low) | (digits == F.upper(digits)), True).otherwise(_let(keccak_lanes(block), right))
