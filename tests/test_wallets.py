"""Wallet checksums against published addresses and plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from docquarry.functions import wallets as W
from docquarry.operators import entities as E

GOOD = [
    "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", "1111111111111111111114oLvT2", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4",
    "BC1QW508D6QEJXTDG4Y5R3ZARVARY0C5XW7KV8F3T4", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0", "bc1zw508d6qejxtdg4y5r3zarvaryvaxxpcs",
]
BAD = ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLz", "11111111111111111111114oLvT2", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", "bc1p38j9r5y49hruaue7wxjce0updqjuyyx0kh56v8s25huc6995vvpql3jow4", "bc1pw5dgrnzv"]
CAPITALS = ["5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", "fB6916095ca1df60bB79Ce92cE3Ea74c37c5d359", "dbF03B407c01E7cD3CBea99509d93f8DDDC8C6FB", "D1220A0cf47c7B9Be7A2E6BA89F429762e7b9aDb"]


def judged(spark, texts, test):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", test(F.col("t")).alias("ok")).collect()
    return {r["t"]: r["ok"] for r in got}


def test_bitcoin(spark):
    assert judged(spark, GOOD + BAD, W.bitcoin) == {**dict.fromkeys(GOOD, True), **dict.fromkeys(BAD, False)}


def base58(body):
    raw = body + hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = W.BASE58[d] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


@pytest.mark.parametrize("version", [0, 5, 7])
def test_base58_of_hashes(spark, version):
    """Right in versions 0 and 5, and never with one character changed."""
    made = [base58(bytes([version]) + b"\0" * (i % 3) + hashlib.sha256(str(i).encode()).digest()[: 20 - i % 3]) for i in range(60)]
    broken = [a[:9] + ("2" if a[9] != "2" else "3") + a[10:] for a in made]
    assert judged(spark, made + broken, W.base58check) == {**dict.fromkeys(made, version != 7), **dict.fromkeys(broken, False)}


def test_capitals(spark):
    right = ["0x" + a for a in CAPITALS]
    flat = [f(a) for a in CAPITALS for f in (lambda a: "0x" + a.lower(), lambda a: "0x" + a.upper())]
    wrong = ["0x" + a.swapcase() for a in CAPITALS] + ["0x" + a[:-1] + a[-1].swapcase() for a in CAPITALS if a[-1].isalpha()]
    assert judged(spark, right + flat + wrong, W.eip55) == {**dict.fromkeys(right + flat, True), **dict.fromkeys(wrong, False)}


def test_programs_round_trip(spark):
    programs = [(hashlib.sha256(str(i).encode()).hexdigest()[: (40, 64)[i % 2]],) for i in range(40)]
    df = spark.createDataFrame(programs, "p string")
    for version in (0, 1):
        assert all(r[0] for r in df.select(W.segwit(W.segwit_address(F.col("p"), version))).collect())


def test_wallets_in_texts(spark):
    text = f"to {GOOD[0]}, not {BAD[0]}; {GOOD[3]}. 0x{CAPITALS[0]} but 0x{CAPITALS[0].swapcase()} and 0x{CAPITALS[1].upper()}"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["value"]) for r in E.scan(df).where("kind = 'crypto_wallet'").collect()}
    assert got == {(1, GOOD[0]), (1, GOOD[3]), (1, "0x" + CAPITALS[0]), (1, "0x" + CAPITALS[1].lower())}


def test_segwit_addresses_are_dealt_to_all_cores(spark):
    """One small file of keys is the work of more than one task."""
    from docquarry.plans import registry

    assert registry.QUERIES["segwit_addresses"](spark, "/root/testdata/sf0.001").withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1
