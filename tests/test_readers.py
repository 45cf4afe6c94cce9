"""Streams joined with streams, fact documents, insider archives and the hash chain."""

import datetime as dt
import hashlib
import io
import json
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import ledger, panel
from marketloom.plans import studies
from marketloom.sources import insider, statements
from marketloom.streaming import enrich

T0 = dt.datetime(2024, 1, 2, 15, 0)


def at(s):
    return (T0 + dt.timedelta(seconds=s)).isoformat()


# ---- streams ----

BAR, QUOTE = "symbol string, ts timestamp, close double, volume double", "symbol string, ts timestamp, bid double, ask double, bid_size double, ask_size double"
BARS = [[("A", 4, 10.0), ("A", 5, 11.0), ("B", 7, 20.0)], [("A", 9, 12.0), ("A", 9, 12.5), ("C", 9, 1.0)], [("A", 30, 13.0), ("B", 31, 21.0)], [("A", 3, 99.0), ("A", 33, 14.0)], [("Z", 500, 0.0)]]
# the quotes of A at 8 come after that at 10 but within the delay; that of B at 15 comes too late, as does the bar of A at 3
QUOTES = [[("A", 5, 1.0), ("B", 6, 2.0)], [("A", 10, 3.0), ("A", 8, 4.0), ("A", 8, 4.5)], [("A", 29, 5.0), (None, 3, 1.0)], [("B", 15, 6.0), ("A", 33, 7.0)], [("Z", 500, 0.0)]]


@pytest.mark.parametrize("most", [None, 10.0])
def test_bars_take_the_quote_as_of_their_time(spark, tmp_path, most):
    for name, files in (("bars", BARS), ("quotes", QUOTES)):
        (tmp_path / name).mkdir()
        for i, rows in enumerate(files):
            made = [{"symbol": s, "ts": at(t), **({"close": v, "volume": 1.0} if name == "bars" else {"bid": v, "ask": v + 1, "bid_size": 1.0, "ask_size": None})} for s, t, v in rows]
            (tmp_path / name / f"{i}.json").write_text("\n".join(map(json.dumps, made)))
            os.utime(tmp_path / name / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
    out = enrich.enriched(read("bars", BAR), read("quotes", QUOTE), "10 seconds", most)
    name = f"enriched{0 if most is None else 1}"
    query = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = sorted((r["symbol"], r["close"], r["bid"]) for r in spark.table(name).where("symbol <> 'Z'").collect())
    # against the batch join of what is not late
    bars = spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), v) for f in BARS for s, t, v in f if v != 99.0], "symbol string, ts timestamp, close double")
    quotes = spark.createDataFrame([(s, T0 + dt.timedelta(seconds=t), v) for f in QUOTES for s, t, v in f if v not in (6.0, 4.0)], "symbol string, ts timestamp, bid double")
    want = sorted((r["symbol"], r["close"], r["bid"]) for r in panel.asof(bars, quotes, ["symbol"], "ts", ["bid"], most=most).where("symbol <> 'Z'").collect())
    assert got == want and ("A", 12.5, 4.5) in got and ("C", 1.0, None) in got


# ---- statements ----

def fact(end, val, filed, start=None, fp="FY", form="10-K"):
    return {"end": end, "val": val, "filed": filed, "fp": fp, "form": form, **({"start": start} if start else {})}


def year(y, val, filed, **more):
    return fact(f"{y}-12-31", val, filed, f"{y}-01-01", **more)


def document(**tags):
    out = {"us-gaap": {}, "dei": {}}
    for tag, facts in tags.items():
        own, unit = ("dei", "shares") if tag.startswith("Entity") else ("us-gaap", "USD")
        out[own][tag] = {"label": tag, "units": {unit: facts, "EUR": [year(2021, -1.0, "2022-02-01")]}}
    return json.dumps({"cik": 1, "facts": out})


def test_annual_statements(spark):
    cash = "NetCashProvidedByUsedInOperatingActivities"
    a = document(
        NetIncomeLoss=[year(2021, 9.0, "2023-02-01"), year(2021, 5.0, "2022-02-01"), year(2021, 7.0, "2022-06-01", form="10-K/A"), year(2022, 8.0, "2023-02-01"), fact("2022-12-31", 2.0, "2022-01-01", "2022-10-01"), year(2020, 1.0, "2021-02-01")],
        **{cash: [year(2021, 6.0, "2022-03-01"), year(2022, 4.0, "2023-02-01"), year(2022, 3.0, "2022-08-01", fp="Q2"), year(2022, 2.0, "2022-08-02", form="10-Q")]},
        Assets=[fact("2021-12-31", 100.0, "2022-02-01"), fact("2022-12-31", 110.0, "2023-02-15"), fact("2020-12-31", 0.0, "2021-02-01")],
        PaymentsToAcquirePropertyPlantAndEquipment=[year(2021, 2.0, "2022-02-01")],
        EntityCommonStockSharesOutstanding=[fact("2022-02-10", 50.0, "2022-02-20"), fact("2021-11-20", 49.0, "2022-02-20"), fact("2023-06-30", 60.0, "2023-07-01")],
        RevenueFromContractWithCustomerExcludingAssessedTax=[year(2021, 30.0, "2022-02-01")],
        CostOfRevenue=[year(2022, 12.0, "2023-02-01")], CostOfGoodsAndServicesSold=[year(2021, 11.0, "2022-02-01")])
    b = document(NetIncomeLoss=[year(2021, 5.0, "2022-02-01")], Assets=[fact("2021-12-31", 1.0, "2022-02-01")])
    docs = spark.createDataFrame([("A", a), ("B", b), ("C", "{broken"), ("D", None), ("E", json.dumps({"facts": {}}))], "symbol string, doc string")
    got = {(r["symbol"], str(r["fy_end"])): r for r in statements.annual_statements(docs).collect()}
    assert set(got) == {("A", "2021-12-31"), ("A", "2022-12-31")}
    first, second = got["A", "2021-12-31"], got["A", "2022-12-31"]
    assert (first["net_income"], first["cfo"], first["total_assets"], first["capex"], first["fcf"]) == (5.0, 6.0, 100.0, 2.0, 4.0)
    assert str(first["filed"]) == "2022-03-01" and str(second["filed"]) == "2023-02-15"
    assert (first["revenue"], first["cogs"], second["revenue"], second["cogs"]) == (30.0, None, None, 12.0)  # the firm has the first cost tag
    assert (second["capex"], second["fcf"], second["book_equity"]) == (None, 4.0, None)
    assert (first["shares"], second["shares"]) == (50.0, None)  # both dates are 41 days off: the first in the document


def test_statements_need_no_python(spark):
    plan = statements.annual_statements(spark.createDataFrame([("A", "{}")], "symbol string, doc string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# ---- insider archives ----

def table(columns, rows):
    return "\n".join("\t".join(map(str, r)) for r in [columns, *rows]) + "\n"


def archive(path, submissions, owners, transactions):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(insider.SUBMISSION, table(["ACCESSION_NUMBER", "FILING_DATE", "OTHER", "ISSUERTRADINGSYMBOL"], submissions))
        z.writestr(insider.OWNER, table(["ACCESSION_NUMBER", "RPTOWNER_RELATIONSHIP"], owners))
        z.writestr(insider.TRANSACTION, table(["ACCESSION_NUMBER", "TRANS_CODE", "TRANS_ACQUIRED_DISP_CD", "TRANS_SHARES", "TRANS_PRICEPERSHARE", "TRANS_DATE"], transactions))


def test_insider_buys_by_ticker_and_filing_date(spark, tmp_path):
    archive(tmp_path / "2021q1.zip",
            [("1", "03-MAR-2021", "x", " abc "), ("2", "2021-03-03", "x", "ABC"), ("3", "03/04/2021", "x", "none"), ("4", "gone", "x", "ABC"), ("5", "04-MAR-21", "é".encode().decode("latin-1"), "XYZ"), ("6", "05-MAR-2021", "x", "ABC")],
            [("1", "Officer"), ("1", "Director"), ("2", "Director"), ("2", ""), ("2", "TenPercentOwner"), ("2", "Other"), ("5", "Director")],
            [("1", "P", "A", "100", "2.5", "01-MAR-2021"), ("1", "P", "A", "10", "1", ""), ("1", "S", "D", "9", "9", "02-MAR-2021"), ("2", " P ", "A", "4", "5", "28-FEB-2021"), ("2", "P", "A", "0", "5", "02-MAR-2021"),
             ("3", "P", "A", "1", "1", "x"), ("4", "P", "A", "1", "1", "x"), ("5", "P", "A", "2.5", "4", "never"), ("6", "P", "A", "many", "4", "05-MAR-2021"), ("7", "P", "A", "1", "1", "x")])
    archive(tmp_path / "2021q2.zip", [("1", "03-MAR-2021", "x", "ABC")], [], [("1", "P", "A", "1", "1", "31-FEB-2021"), ("1", "M", "A", "1", "1", "01-MAR-2021")])
    (tmp_path / "notes.txt").write_text("no archive")
    rows = insider.archives(spark, str(tmp_path))
    got = sorted((r["ticker"], str(r["filing_date"]), str(r["trans_date"]), r["buy_value"], r["n_owners"], r["roles"]) for r in insider.buys(rows).collect())
    assert got == [("ABC", "2021-03-03", "2021-02-28", 280.0, 2, ["Director", "Officer", "Other", "TenPercentOwner"]), ("ABC", "2021-03-03", "None", 1.0, 1, []), ("XYZ", "2021-03-04", "None", 10.0, 1, ["Director"])]


def test_written_dates(spark):
    cases = {"03-MAR-2021": "2021-03-03", "3-mar-68": "2068-03-03", "03-Mar-69": "1969-03-03", "2021-1-9": "2021-01-09", "12/31/2020": "2020-12-31", "31/12/2020": "None", "": "None", "30-FEB-2021": "None", "3-XXX-2021": "None"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", insider.day(F.col("t")).alias("d")).collect()
    assert {r["t"]: str(r["d"]) for r in got} == cases


# ---- the hash chain ----

def events(rows):
    return [(log, float(ts), kind, json.dumps(order), tie) for log, ts, kind, order, tie in rows]


EVENT = "log string, ts double, event string, order string, tie int"


def test_a_ledger_goes_on_from_its_tail_and_shows_the_first_changed_row(spark):
    first = [("x", 1, "SIGNAL", {"b": 1, "a": [1.5, None, "é"]}, 0), ("x", 1, "SUBMIT", {"id": "o"}, 1), ("y", 5.25, "ACK", {}, 0)]
    later = [("x", 2, "FILL", {"z": {"q": 1, "c": 2}}, 0), ("z", 3, "CANCEL", {"id": 1}, 0)]
    one = ledger.append(spark.createDataFrame(events(first), EVENT).repartition(3)).cache()
    two = one.unionByName(ledger.append(spark.createDataFrame(events(later), EVENT), one)).cache()
    rows = {(r["log"], r["seq"]): r for r in two.collect()}
    assert set(rows) == {("x", 0), ("x", 1), ("x", 2), ("y", 0), ("z", 0)}
    # by hand: canonical JSON, one row after the other
    import hashlib

    before = "0" * 64
    for seq, (_, ts, kind, order, _) in enumerate([first[0], first[1], later[0]]):
        text = json.dumps({"seq": seq, "ts": float(ts), "event": kind, "order": order, "prev_hash": before}, sort_keys=True, separators=(",", ":"))
        assert rows["x", seq]["prev_hash"] == before and rows["x", seq]["hash"] == hashlib.sha256(text.encode()).hexdigest()
        before = rows["x", seq]["hash"]
    judge = lambda df: {r["log"]: (r["total"], r["ok"], r["broken_at_seq"]) for r in ledger.verify(df).collect()}
    assert judge(two) == {"x": (3, True, None), "y": (1, True, None), "z": (1, True, None)}
    changed = two.withColumn("order", F.when((F.col("log") == "x") & (F.col("seq") == 1), F.lit('{"id":"p"}')).otherwise(F.col("order")))
    assert judge(changed)["x"] == (3, False, 1) and judge(changed)["y"][1]
    assert judge(two.where("NOT (log = 'x' AND seq = 1)"))["x"] == (2, False, 2)
    assert judge(two.withColumn("ts", F.when(F.col("log") == "z", 4.0).otherwise(F.col("ts"))))["z"] == (1, False, 0)
    assert ledger.verify(two.limit(0)).collect() == []


def test_unknown_events_are_refused(spark):
    with pytest.raises(Exception, match="unknown event"):
        ledger.append(spark.createDataFrame(events([("x", 1, "NAP", {}, 0)]), EVENT)).collect()


def test_logs_stream_through_their_tasks_and_ties_have_one_order(spark):
    """Logs over several batches and batches over several logs; no Python call a log; rows that agree in ts and tie go by event and order."""
    rng = np.random.Generator(np.random.PCG64(8))
    sizes = {"long": 40, None: 5, **{f"l{i}": 1 + i % 3 for i in range(30)}}
    rows = [(log, float(rng.integers(0, 6)), str(rng.choice(["SUBMIT", "ACK", "FILL"])), json.dumps({"b": 1, "a": i})) for log, n in sizes.items() for i in range(n)]
    rows.append(("long", None, "FILL", "{}"))
    parts = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        one, two = (spark.createDataFrame(p[::-1], "log string, ts double, event string, order string").repartition(k) for p, k in zip(parts, (1, 3)))
        first = ledger.append(one)
        df = first.unionByName(ledger.append(two, first))
        assert "PandasGroups" not in (plan := df._jdf.queryExecution().toString()) and "CoGroups" not in plan
        got = {(r["log"], r["seq"]): tuple(r)[2:] for r in df.collect()}
        assert all((r["total"], r["ok"]) == (sizes[r["log"]] + (r["log"] == "long"), True) for r in ledger.verify(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, tails = {}, {}
    for part in parts:
        for log, ts, event, order in sorted(part, key=lambda r: (r[1] is None, r[1] or 0.0, r[2], r[3])):
            seq, before = tails.get(log, (-1, "0" * 64))
            value = {"seq": seq + 1, "ts": math.nan if ts is None else ts, "event": event, "order": json.loads(order), "prev_hash": before}
            made = hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            want[log, seq + 1] = (ts, event, json.dumps(json.loads(order), sort_keys=True, separators=(",", ":")), before, made)
            tails[log] = seq + 1, made
    assert got == want


def test_the_check_of_the_orders_makes_no_python_call_a_log(spark, tmp_path):
    rows = [(k, (k * 7) % 23, "FOP"[k % 3], f"{k % 5}-P") for k in range(120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").repartition(4).write.parquet(str(tmp_path / "orders.parquet"))
    df = studies.QUERIES["ledger_check"](spark, str(tmp_path))
    assert "PandasGroups" not in (plan := df._jdf.queryExecution().toString()) and "CoGroups" not in plan
    counts = {str(c): sum(r[1] == c for r in rows) for c in range(23)}
    assert sorted(map(tuple, df.collect())) == sorted((log, n, True, None) for log, n in counts.items())
    want = {}
    for log in counts:
        before = "0" * 64
        for seq, (k, _, status, priority) in enumerate(sorted((r for r in rows if str(r[1]) == log), key=lambda r: (r[0] % 2, r[0]))):
            event = {"F": "FILL", "O": "SUBMIT"}.get(status, "PARTIAL_FILL")
            text = f'{{"event":"{event}","order":{{"key":{k},"priority":"{priority}"}},"prev_hash":"{before}","seq":{seq},"ts":{k}.0}}'
            before = hashlib.sha256(text.encode()).hexdigest()
            want[log, seq] = (event, before)
    assert {(r["log"], r["seq"]): (r["event"], r["hash"]) for r in studies.QUERIES["ledger_chain"](spark, str(tmp_path)).collect()} == want
