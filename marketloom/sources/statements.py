"""Annual statements from nested fact documents, in Catalyst alone.

A document has facts by taxonomy, tag and unit; a fact has a span or an instant, a value,
a fiscal period, a form and a filing date.  Of a period's filings the earliest counts: it
is what was known first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<start:string,`end`:string,val:double,fp:string,form:string,filed:string>>>>>>>"
#: The public tags of each item, its unit, and whether it is a flow; of several tags the first that a firm has counts.
ITEMS = {
    "net_income": (("us-gaap", "NetIncomeLoss", "USD", True),),
    "cfo": (("us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", True),),
    "total_assets": (("us-gaap", "Assets", "USD", False),),
    "capex": (("us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", True),),
    "book_equity": (("us-gaap", "StockholdersEquity", "USD", False),),
    "shares": (("dei", "EntityCommonStockSharesOutstanding", "shares", False),),
    "revenue": (("us-gaap", "Revenues", "USD", True), ("us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD", True)),
    "cogs": (("us-gaap", "CostOfRevenue", "USD", True), ("us-gaap", "CostOfGoodsAndServicesSold", "USD", True)),
}
#: The forms and the fiscal period of annual reports.
FORMS, ANNUAL = ("10-K", "10-K/A"), "FY"


def _day(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def annual_facts(docs: DataFrame, shortest: int = 350, longest: int = 380) -> DataFrame:
    """(symbol, item, choice, fy_end, value, filed, place) of docs(symbol, doc): each period's earliest annual filing.

    Flows span a whole year.  `choice` is the place of the tag among an item's; `place` that
    of the period's first fact in the document.  Facts without a value, an end or a filing
    date are left out, as are documents that do not parse.
    """
    d = docs.select("symbol", F.from_json("doc", SCHEMA).alias("d"))
    picked = [
        F.struct(F.lit(item).alias("item"), F.lit(k).alias("choice"), F.lit(flow).alias("flow"), F.col("d.facts")[taxonomy][tag]["units"][unit].alias("facts"))
        for item, tags in ITEMS.items() for k, (taxonomy, tag, unit, flow) in enumerate(tags)
    ]
    rows = d.select("symbol", F.explode(F.array(*picked)).alias("p")).select("symbol", "p.item", "p.choice", "p.flow", F.posexplode("p.facts").alias("place", "f"))
    start, end, filed = _day(F.col("f.start")), _day(F.col("f.end")), _day(F.col("f.filed"))
    rows = rows.where((F.col("f.fp") == ANNUAL) & F.col("f.form").isin(*FORMS) & F.col("f.val").isNotNull() & end.isNotNull() & filed.isNotNull())
    rows = rows.where(~F.col("flow") | F.abs(F.datediff(end, start)).between(shortest, longest))
    first = F.min_by(F.struct(F.col("f.val").alias("value"), filed.alias("filed")), F.struct(filed, "place"))
    return rows.groupBy("symbol", "item", "choice", end.alias("fy_end")).agg(first.alias("v"), F.min("place").alias("place")).select("symbol", "item", "choice", "fy_end", "v.value", "v.filed", "place")


def annual_statements(docs: DataFrame, most_days: int = 120) -> DataFrame:
    """A row for each symbol and fiscal year with net income, operating cash flow and assets above 0, as the schema of fundamentals.

    Filed when the last of these three was.  Other items are null where the firm has no such
    fact; without capital spending the free cash flow is the operating one.  Shares are those
    of the date nearest the year's end within `most_days`, of two as near the first in the
    document.
    """
    facts = annual_facts(docs)
    used = facts.withColumn("best", F.min("choice").over(Window.partitionBy("symbol", "item"))).where("choice = best")
    names = [i for i in ITEMS if i != "shares"]
    value = {i: F.max(F.when(F.col("item") == i, F.col("value"))).alias(i) for i in names}
    filed = {i: F.max(F.when(F.col("item") == i, F.col("filed"))).alias(f"{i}_filed") for i in names[:3]}
    years = used.where("item <> 'shares'").groupBy("symbol", "fy_end").agg(*value.values(), *filed.values())
    years = years.where("net_income IS NOT NULL AND cfo IS NOT NULL AND total_assets > 0").withColumn("filed", F.greatest(*[f"{i}_filed" for i in names[:3]]))
    counted = used.where("item = 'shares'").select("symbol", F.col("fy_end").alias("at"), F.col("value").alias("shares"), "place")
    gap = F.abs(F.datediff("at", "fy_end"))
    near = years.select("symbol", "fy_end").join(counted, "symbol").where(gap <= most_days)  # as many rows as a firm has years near
    near = near.groupBy("symbol", "fy_end").agg(F.min_by("shares", F.struct(gap, "place")).alias("shares"))
    out = years.join(near, ["symbol", "fy_end"], "left").withColumn("fcf", F.col("cfo") - F.coalesce("capex", F.lit(0.0)))
    return out.select("symbol", "fy_end", "filed", "net_income", "cfo", "total_assets", "capex", "fcf", "book_equity", "shares", "revenue", "cogs")
