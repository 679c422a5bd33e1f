"""Rule-based entities in texts: patterns with validators, overlap resolution, summaries.

All rules are Column expressions: matches come from regexp_extract_all, validators filter them, so
scanning stays in the JVM and only rows that any pattern can match are looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import checksums as C
from docquarry.functions import wallets as W
from docquarry.functions.entities import iso_6346


@dataclass(frozen=True)
class Rule:
    """kind and rule_id of what a pattern finds; precedence settles overlaps; valid and value judge and normalise a match."""

    kind: str
    rule_id: str
    pattern: str
    precedence: int
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    value: Callable[[Column], Column] = lambda m: m


def real_date(iso: Column) -> Column:
    year = F.substring(iso, 1, 4).cast("int")
    return F.try_to_date(F.substring(iso, 1, 10), "yyyy-MM-dd").isNotNull() & year.between(1800, 2100)


def octets(ip: Column) -> Column:
    return F.forall(F.split(ip, "[.]"), lambda o: (o.cast("int") <= 255) & ~o.rlike("^0[0-9]"))


def lower_domain(mail: Column) -> Column:
    return F.concat(F.regexp_extract(mail, "^([^@]*@)", 1), F.lower(F.regexp_extract(mail, "@(.*)$", 1)))


def no_spaces(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^0-9A-Z]", "")


def plus_digits(text: Column) -> Column:
    return F.concat(F.lit("+"), F.regexp_replace(text, "[^0-9]", ""))


def degrees(pair: Column, side: int) -> Column:
    return F.trim(F.get(F.split(pair, ","), F.lit(side))).cast("double")


def one_case_low(address: Column) -> Column:
    """Capitals are kept only where they are a checksum."""
    digits = F.substr(address, F.lit(3))
    return F.when(digits == F.upper(digits), F.lower(address)).otherwise(address)


RULES = (
    Rule("email", "email.basic", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,24}", 90, lambda m: ~F.contains(m, F.lit("..")) & (F.instr(m, "@") <= 65), lower_domain),
    Rule("network", "network.ip", r"\b[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}\b", 60, octets),
    Rule("bank_account", "bank.payment_card", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", 70, C.luhn, no_spaces),
    Rule("bank_account", "bank.iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b", 95, C.iban, no_spaces),
    Rule("company_id", "company.lei", r"\b[0-9A-Z]{18}[0-9]{2}\b", 85, C.mod_97),
    Rule("security", "security.isin", r"\b[A-Z]{2}[0-9A-Z]{9}[0-9]\b", 80, C.isin),
    Rule("vessel", "vessel.imo", r"\bIMO ?[0-9]{7}\b", 65, lambda m: C.imo(F.right(m, F.lit(7)))),
    Rule("publication", "publication.orcid", r"\b[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]\b", 75, C.mod_11_2),
    Rule("publication", "publication.doi", r"\b10[.][0-9]{4,9}/[A-Za-z0-9._;()/:-]*[A-Za-z0-9]", 88),
    Rule("vulnerability", "vulnerability.cve", r"\bCVE-[0-9]{4}-[0-9]{4,7}\b", 92),
    Rule("date", "date.iso8601", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", 50, real_date),
    Rule("device", "device.mac", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b", 78, value=F.lower),
    Rule("money", "money.iso_code", r"\b(?:USD|EUR|GBP|JPY|CHF) ?[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]{2})?\b", 55, value=lambda m: F.regexp_replace(m, "[ ,]", "")),
    Rule("phone", "phone.e164", r"[+][1-9][0-9 ().-]{6,18}[0-9]", 45, lambda m: F.length(plus_digits(m)).between(9, 16), lambda m: plus_digits(m)),
    Rule("national_id", "national_id.us_ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 72, lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$")),
    Rule("crypto_wallet", "crypto.ethereum", r"\b0x[0-9a-fA-F]{40}\b", 87, W.eip55, one_case_low),
    Rule("crypto_wallet", "crypto.bitcoin", W.PATTERN, 86, W.bitcoin, lambda m: F.when(m.startswith("BC1"), F.lower(m)).otherwise(m)),
    Rule("coordinates", "coordinates.decimal", r"-?[0-9]{1,2}[.][0-9]{3,}, ?-?[0-9]{1,3}[.][0-9]{3,}", 40, lambda m: degrees(m, 0).between(-90, 90) & degrees(m, 1).between(-180, 180)),
    Rule("cargo_container", "container.iso6346", r"\b[A-Z]{3}[UJZ] ?[0-9]{6} ?[0-9]\b", 74, iso_6346, no_spaces),
    Rule("network", "network.asn", r"\bAS[0-9]{1,10}\b", 58, lambda m: F.substr(m, F.lit(3)).cast("decimal(10,0)").between(1, 4294967295)),
    Rule("company_id", "company.vat_de", r"\bDE ?[0-9]{9}\b", 68, lambda m: C.mod_11_10(F.regexp_replace(m, "[^0-9]", "")), no_spaces),
)


def _matches(number: int, rule: Rule) -> Column:
    """(rule, m, at) of a rule's matches in the column text: each begins after what lies between the
    matches up to it, and the matches before it."""
    sum_of = lambda parts: F.aggregate(parts, F.lit(0), lambda n, t: n + F.length(t))

    def place(both: Column) -> Column:
        found, between = both["found"], both["between"]
        at = lambda i: sum_of(F.slice(between, F.lit(1), i + 1)) + sum_of(F.slice(found, F.lit(1), i)) + 1
        return F.transform(found, lambda m, i: F.struct(F.lit(number).alias("rule"), m.alias("m"), at(i).alias("at")))

    both = F.struct(F.regexp_extract_all("text", F.lit(f"({rule.pattern})"), F.lit(1)).alias("found"), F.split("text", rule.pattern).alias("between"))
    return F.get(F.transform(F.array(both), place), F.lit(0))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kind, rule_id, value, matched, at, end, precedence) of valid matches, at from 1.

    One pass without a shuffle: texts that no pattern meets go first, then all rules' matches of a
    text come from one generator and are judged row by row.
    """
    some = F.lit(False)
    for rule in rules:
        some = some | F.col("text").rlike(rule.pattern)
    hits = df.select("doc_id", "text").where(some).select("doc_id", F.explode(F.concat(*[_matches(i, r) for i, r in enumerate(rules)])).alias("h")).select("doc_id", "h.*")
    m = F.col("m")
    valid, value = F.lit(False), F.lit(None).cast("string")
    for i, rule in enumerate(rules):
        own = F.col("rule") == i
        valid, value = F.when(own, rule.valid(m)).otherwise(valid), F.when(own, rule.value(m)).otherwise(value)
    of = lambda name: F.get(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rule"))
    return hits.where(valid).select(
        "doc_id", of("kind").alias("kind"), of("rule_id").alias("rule_id"), value.alias("value"), m.alias("matched"), "at", (F.col("at") + F.length(m)).alias("end"), of("precedence").alias("precedence")
    )


def resolve(hits: DataFrame) -> DataFrame:
    """Of hits that overlap, those of greater precedence stay, then longer, then earlier ones. A hit
    goes only if it meets one that stays: in a chain the best stays and so does the one beyond its neighbour.

    Hits of a text that touch form runs, by one sort; within a run the best are taken in turn.
    """
    order = Window.partitionBy("doc_id").orderBy("at", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_new", F.coalesce((F.col("at") >= reach).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order))
    rank = F.struct((-F.col("precedence")).alias("p"), (F.col("at") - F.col("end")).alias("l"), F.col("at").alias("at"), F.col("rule_id").alias("r"))
    own = runs.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.struct(*hits.columns).alias("hit")))).alias("h"))

    def take(kept: Column, x: Column) -> Column:
        meets = F.exists(kept, lambda k: (x["hit"]["at"] < k["hit"]["end"]) & (k["hit"]["at"] < x["hit"]["end"]))
        return F.when(meets, kept).otherwise(F.concat(kept, F.array(x)))

    return own.select(F.explode(F.aggregate("h", F.slice("h", 1, 0), take)).alias("h")).select("h.hit.*")


def summarise(hits: DataFrame) -> DataFrame:
    """By kind and value: how often, in how many documents, and the best rule."""
    return hits.groupBy("kind", "value").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.min_by("rule_id", F.struct(-F.col("precedence"), F.col("rule_id"))).alias("rule_id")
    )
