"""Insiders' open-market purchases from quarterly archives of tab-separated tables.

An archive is read through Spark's own file source, so it can lie wherever Spark reads; a
task unpacks one archive at a time and gives its three tables as rows of one shape, keyed
by the filing's number.  All that follows is grouping: one shuffle by filing, one by
ticker and date.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of an archive, their columns that are read, and the codes of an open-market purchase.
SUBMISSION, OWNER, TRANSACTION = "SUBMISSION.tsv", "REPORTINGOWNER.tsv", "NONDERIV_TRANS.tsv"
COLUMNS = {
    SUBMISSION: {"ticker": "ISSUERTRADINGSYMBOL", "filed": "FILING_DATE"},
    OWNER: {"role": "RPTOWNER_RELATIONSHIP"},
    TRANSACTION: {"code": "TRANS_CODE", "side": "TRANS_ACQUIRED_DISP_CD", "shares": "TRANS_SHARES", "price": "TRANS_PRICEPERSHARE", "traded": "TRANS_DATE"},
}
PURCHASE, ACQUIRED = "P", "A"
#: Tickers that stand for none, and the names of months.
NO_TICKER = ("", "NONE", "N/A", "NA")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_FIELDS = ("ticker", "filed", "role", "code", "side", "shares", "price", "traded")
ROWS = "archive string, place long, kind string, accession string, " + ", ".join(f"{f} string" for f in _FIELDS)
_BATCH = 20_000


def archives(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all archives at a path: archive, place (order within a table), kind (the table), accession, and the table's columns."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(10_000_000)
        for frame in frames:
            for path, content in frame.itertuples(index=False):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    there = set(archive.namelist())
                    for kind, columns in COLUMNS.items():
                        if kind not in there:
                            continue
                        with archive.open(kind) as f:
                            held: list[tuple] = []
                            for place, row in enumerate(csv.DictReader(io.TextIOWrapper(f, "latin-1"), delimiter="\t")):
                                named = {ours: row.get(theirs) for ours, theirs in columns.items()}
                                held.append((path, place, kind, row.get("ACCESSION_NUMBER"), *[named.get(x) for x in _FIELDS]))
                                if len(held) == _BATCH:
                                    yield pd.DataFrame(held, columns=["archive", "place", "kind", "accession", *_FIELDS])
                                    held = []
                            yield pd.DataFrame(held, columns=["archive", "place", "kind", "accession", *_FIELDS])

    return files.mapInPandas(unpack, ROWS)


def day(text: Column) -> Column:
    """A date written as 03-MAR-2021, 03-MAR-21, 2021-03-03 or 03/03/2021; null for anything else."""
    t = F.upper(F.trim(text))
    part = lambda pattern, i: F.regexp_extract(t, pattern, i)
    named = r"^(\d{1,2})-([A-Z]{3})-(\d{4}|\d{2})$"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(named, 2)).cast("string")
    short = part(named, 3)
    year = F.when(F.length(short) == 4, short).when(short >= "69", F.concat(F.lit("19"), short)).otherwise(F.concat(F.lit("20"), short))
    iso, slashed = r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    made = F.when(t.rlike(named), F.concat_ws("-", year, month, part(named, 1))).when(t.rlike(iso), t).when(t.rlike(slashed), F.concat_ws("-", part(slashed, 3), part(slashed, 1), part(slashed, 2)))
    return F.try_to_timestamp(made, F.lit("yyyy-M-d")).cast("date")


def buys(rows: DataFrame, most_roles: int = 4) -> DataFrame:
    """(ticker, filing_date, trans_date, buy_value, n_owners, roles) of archive rows: open-market purchases by ticker and filing date.

    Purchases without shares or a price above 0, filings without a ticker or a date, and
    transactions without a submission are left out; amounts that are no numbers count as
    none.  trans_date is the last one given, owners are counted by filing, roles are the
    first four in alphabetical order.  A filing belongs to its archive.
    """
    place = F.struct("place")
    bought = (F.col("kind") == TRANSACTION) & (F.trim("code") == PURCHASE) & (F.trim("side") == ACQUIRED)
    amount = lambda c: F.coalesce(F.expr(f"try_cast(trim({c}) AS DOUBLE)"), F.lit(0.0))
    worth = bought & (amount("shares") > 0) & (amount("price") > 0)
    filing = rows.groupBy("archive", "accession").agg(
        F.max_by(F.when(F.col("kind") == SUBMISSION, F.struct("ticker", "filed")), F.when((F.col("kind") == SUBMISSION) & ~F.upper(F.trim("ticker")).isin(*NO_TICKER), F.col("place"))).alias("about"),
        F.collect_set(F.when(F.col("kind") == OWNER, F.col("role"))).alias("roles"),
        F.sum(F.when(worth, amount("shares") * amount("price"))).alias("value"),
        F.max_by(F.when(worth, day(F.col("traded"))), F.when(worth & day(F.col("traded")).isNotNull(), place)).alias("traded"),
        F.max(F.when(worth & day(F.col("traded")).isNotNull(), F.col("place"))).alias("place"))
    filing = filing.where("value IS NOT NULL AND about IS NOT NULL").select("archive", "accession", "roles", "value", "traded", "place", F.upper(F.trim("about.ticker")).alias("ticker"), day(F.col("about.filed")).alias("filing_date"))
    g = filing.where("filing_date IS NOT NULL").groupBy("archive", "ticker", "filing_date").agg(
        F.max_by("traded", "place").alias("trans_date"), F.round(F.sum("value"), 2).alias("buy_value"), F.count("*").cast("int").alias("n_owners"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"))
    return g.select("ticker", "filing_date", "trans_date", "buy_value", "n_owners", F.slice(F.filter("roles", lambda r: r != ""), 1, most_roles).alias("roles"))
