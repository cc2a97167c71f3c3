"""Made-up records for trials: receipts, invoices and cards whose numbers obey their rules, by hashes of a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BIZ_WEIGHTS

#: Names of goods with their prices (multiples of ten, so that a tenth of them is whole), and of parties.
GOODS = tuple((f"item {i}", 10 * (37 * i % 990 + 10)) for i in range(1, 41))
PARTIES = tuple(f"party {i}" for i in range(1, 31))


def pick(key: Column, salt: str, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high`` that depends on a key and a salt alone."""
    return (F.pmod(F.xxhash64(F.lit(salt), key), F.lit(high - low + 1)) + low).cast("bigint")


def business_number(key: Column, salt: str) -> Column:
    """Ten digits in three groups, the last of which checks the others."""
    digits = [pick(key, f"{salt}{i}", 0, 9) for i in range(9)]
    total = sum((d * w for d, w in zip(digits, BIZ_WEIGHTS, strict=True)), F.floor(digits[8] * 5 / 10))
    digits.append(F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)))
    part = lambda a, b: F.concat(*(d.cast("string") for d in digits[a:b]))
    return F.concat_ws("-", part(0, 3), part(3, 5), part(5, 10))


def _day(key: Column) -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), pick(key, "day", 0, 270).cast("int")).cast("string")


def _lines(key: Column, least: int, most: int, qty: int) -> Column:
    """Array of (name, qty, price), different goods, ``least`` to ``most`` of them."""
    goods = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).cast("bigint").alias("price")) for n, p in GOODS))
    first = pick(key, "first", 0, len(GOODS) - 1)
    at = lambda i: F.get(goods, F.pmod(first + 7 * i, F.lit(len(GOODS))).cast("int"))
    return F.transform(F.sequence(F.lit(0), pick(key, "lines", least, most).cast("int") - 1), lambda i: F.struct(at(i)["name"].alias("name"), (F.pmod(F.xxhash64(F.lit("qty"), key, i), F.lit(qty)) + 1).cast("bigint").alias("qty"), at(i)["price"].alias("price")))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + f(x))


def receipts(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, fields): store, business number, telephone, date, items, total and the tax that it contains (an eleventh)."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    made = spark.range(n).withColumn("ls", _lines(key, 3, 6, 3))
    items = F.transform("ls", lambda x: F.struct(x["name"].alias("name"), x["qty"].alias("qty"), (x["qty"] * x["price"]).alias("amount")))
    total = _sum(F.col("ls"), lambda x: x["qty"] * x["price"])
    tel = F.concat(F.lit("02-000-"), pick(key, "tel", 1000, 9999).cast("string"))
    date = F.concat(_day(key), F.lit(" "), F.lpad(pick(key, "hour", 8, 21).cast("string"), 2, "0"), F.lit(":"), F.lpad(pick(key, "minute", 0, 59).cast("string"), 2, "0"))
    store = F.get(F.array(*map(F.lit, PARTIES)), pick(key, "store", 0, len(PARTIES) - 1).cast("int"))
    fields = F.struct(store.alias("store"), business_number(key, "biz").alias("biz_no"), tel.alias("tel"), date.alias("date"), items.alias("items"), total.alias("total"), F.bround(total / 11).cast("bigint").alias("vat"))
    return made.select("id", fields.alias("fields"))


def invoices(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, fields): supplier and buyer, date, items with their tax (a tenth), totals."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    made = spark.range(n).withColumn("ls", _lines(key, 2, 4, 200))
    supply = lambda x: x["qty"] * x["price"]
    tax = lambda x: F.floor(supply(x) / 10).cast("bigint")
    items = F.transform("ls", lambda x: F.struct(x["name"].alias("name"), x["qty"].alias("qty"), x["price"].alias("price"), supply(x).alias("supply"), tax(x).alias("tax")))
    names = F.array(*map(F.lit, PARTIES))
    seller = pick(key, "seller", 0, len(PARTIES) - 1)
    buyer = F.pmod(seller + pick(key, "buyer", 1, len(PARTIES) - 1), F.lit(len(PARTIES)))
    party = lambda at, salt: F.struct(business_number(key, salt).alias("biz_no"), F.get(names, at.cast("int")).alias("name"), F.concat(F.lit("ceo "), pick(key, salt, 1, 999).cast("string")).alias("ceo"))
    sums = [_sum(F.col("ls"), supply).alias("supply_total"), _sum(F.col("ls"), tax).alias("tax_total"), _sum(F.col("ls"), lambda x: supply(x) + tax(x)).alias("total")]
    return made.select("id", F.struct(party(seller, "s").alias("supplier"), party(buyer, "b").alias("buyer"), _day(key).alias("date"), items.alias("items"), *sums).alias("fields"))


def cards(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, fields): company, name, title, telephone numbers and address of business cards."""
    key = F.xxhash64(F.lit(seed), F.col("id"))
    number = lambda head, salt: F.concat(F.lit(head), pick(key, salt, 1000, 9999).cast("string"))
    company = F.get(F.array(*map(F.lit, PARTIES)), pick(key, "company", 0, len(PARTIES) - 1).cast("int"))
    name = F.concat(F.lit("person "), pick(key, "name", 1, 9999).cast("string"))
    mail = F.concat(F.lit("p"), pick(key, "name", 1, 9999).cast("string"), F.lit("@example.com"))
    fields = F.struct(company.alias("company"), name.alias("name"), F.lit("sales").alias("dept"), F.lit("manager").alias("title"), number("02-000-", "tel").alias("tel"), number("010-0000-", "mobile").alias("mobile"), mail.alias("email"), F.concat(F.lit("street "), pick(key, "street", 1, 300).cast("string")).alias("address"))
    return spark.range(n).select("id", fields.alias("fields"))
