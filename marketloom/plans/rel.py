"""Relational plans: one description, run as DataFrame steps or written as SQL.

A Rel is a list of steps over named tables.  `df` replays them on DataFrames, so
Catalyst sees ordinary projections, filters, windows, joins and aggregates; `sql`
writes the same steps as nested selects for another engine.  The few functions that
dialects spell differently are written as macros: @last(x), @pct(x, q), @list(x).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MACROS = {
    "last": (r"last_value(\1) IGNORE NULLS", r"last_value(\1 IGNORE NULLS)"),
    "pct": (r"percentile(\1)", r"quantile_cont(\1)"),
    "list": (r"collect_list(\1)", r"list(\1)"),
    "days": (r"datediff(\1)", r"-date_diff('day', \1)"),  # days(a, b) = a - b
    "session": (r"to_date(from_utc_timestamp(\1, 'America/New_York'))", r"CAST(timezone('America/New_York', timezone('UTC', \1)) AS DATE)"),
    "clock": (r"date_format(from_utc_timestamp(\1, 'America/New_York'), 'HH:mm')", r"strftime(timezone('America/New_York', timezone('UTC', \1)), '%H:%M')"),
    "dow": (r"dayofweek(\1)", r"(dayofweek(\1) + 1)"),  # 1 is Sunday
}


def dialect(text: str, spark: bool) -> str:
    """The text with its macros spelled for Spark or for DuckDB."""
    for name, (ours, theirs) in _MACROS.items():
        text = re.sub(rf"@{name}\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", ours if spark else theirs, text)
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)  # doubles in both, not decimals


@dataclass(frozen=True)
class Rel:
    """A plan; every method gives a new one."""

    steps: tuple = ()

    @staticmethod
    def table(name: str) -> "Rel":
        return Rel((("table", name),))

    @staticmethod
    def shared(name: str, plan: "Rel") -> "Rel":
        """A plan that one query reads more than once: one DataFrame, so that Spark reuses its exchanges; nothing outlives the query."""
        return Rel((("shared", name, plan),))

    def _and(self, *step) -> "Rel":
        return replace(self, steps=(*self.steps, step))

    def with_(self, **columns: str) -> "Rel":
        """Columns added."""
        return self._and("with", columns)

    def select(self, *names: str, **columns: str) -> "Rel":
        """Only these columns."""
        return self._and("select", {**{n: n for n in names}, **columns})

    def where(self, condition: str) -> "Rel":
        return self._and("where", condition)

    def group(self, *keys: str, **aggregates: str) -> "Rel":
        return self._and("group", keys, aggregates)

    def join(self, other: "Rel", on: str, how: str = "inner", hint: bool = False) -> "Rel":
        """Join on a condition over the aliases a (this) and b (other); keep all columns of a, and of b those not in a.

        `on` may be comma-separated names: an equi-join that keeps them once.
        """
        return self._and("join", other, on, how, hint)

    def union(self, other: "Rel") -> "Rel":
        return self._and("union", other)

    def distinct(self) -> "Rel":
        return self._and("distinct",)

    # ---- as DataFrames ----
    def df(self, tables: dict[str, DataFrame]) -> DataFrame:
        out: DataFrame | None = None
        say = lambda t: dialect(t, True)
        for step in self.steps:
            match step:
                case ("table", name):
                    out = tables[name]
                case ("shared", name, plan):
                    if name not in tables:
                        tables[name] = plan.df(tables)
                    out = tables[name]
                case ("with", columns):
                    out = out.select("*", *[F.expr(say(e)).alias(c) for c, e in columns.items()])
                case ("select", columns):
                    out = out.select(*[F.expr(say(e)).alias(c) for c, e in columns.items()])
                case ("where", condition):
                    out = out.where(say(condition))
                case ("group", keys, aggregates):
                    out = out.groupBy(*keys).agg(*[F.expr(say(e)).alias(c) for c, e in aggregates.items()])
                case ("join", other, on, how, hint):
                    b = other.df(tables)
                    b = F.broadcast(b) if hint else b
                    if re.fullmatch(r"[\w, ]+", on):
                        out = out.join(b, [n.strip() for n in on.split(",")], how)
                    else:
                        extra = [c for c in b.columns if c not in out.columns] if how not in ("left_semi", "left_anti") else []
                        out = out.alias("a").join(b.alias("b"), F.expr(say(on)), how).select("a.*", *[f"b.{c}" for c in extra])
                case ("union", other):
                    out = out.unionByName(other.df(tables))
                case ("distinct",):
                    out = out.distinct()
        return out

    # ---- as SQL ----
    def columns(self, schemas: dict[str, list[str]]) -> list[str]:
        out: list[str] = []
        for step in self.steps:
            match step:
                case ("table", name):
                    out = list(schemas[name])
                case ("shared", _, plan):
                    out = plan.columns(schemas)
                case ("with", columns):
                    out = [*out, *columns]
                case ("select", columns):
                    out = list(columns)
                case ("group", keys, aggregates):
                    out = [*keys, *aggregates]
                case ("join", other, _, how, _) if how not in ("left_semi", "left_anti"):
                    out = [*out, *[c for c in other.columns(schemas) if c not in out]]
        return out

    def sql(self, schemas: dict[str, list[str]]) -> str:
        text, done = "", []
        for step in self.steps:
            match step:
                case ("table", name):
                    text = f"SELECT * FROM {name}"
                case ("shared", _, plan):
                    text = plan.sql(schemas)
                case ("with", columns):
                    text = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({text})"
                case ("select", columns):
                    text = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({text})"
                case ("where", condition):
                    text = f"SELECT * FROM ({text}) WHERE {condition}"
                case ("group", keys, aggregates):
                    by = f" GROUP BY {', '.join(keys)}" if keys else ""
                    text = f"SELECT {', '.join([*keys, *[f'{e} AS {c}' for c, e in aggregates.items()]])} FROM ({text}){by}"
                case ("join", other, on, how, _):
                    mine, theirs = Rel(tuple(done)).columns(schemas), other.columns(schemas)
                    extra = "".join(f", b.{c}" for c in theirs if c not in mine)
                    kind = {"left": "LEFT", "inner": "INNER", "left_semi": "SEMI", "left_anti": "ANTI", "cross": "CROSS", "full": "FULL"}[how]
                    extra = "" if kind in ("SEMI", "ANTI") else extra
                    condition = " AND ".join(f"a.{n.strip()} = b.{n.strip()}" for n in on.split(",")) if re.fullmatch(r"[\w, ]+", on) else on
                    text = f"SELECT a.*{extra} FROM ({text}) a {kind} JOIN ({other.sql(schemas)}) b ON {condition}"
                case ("union", other):
                    names = ", ".join(Rel(tuple(done)).columns(schemas))
                    text = f"SELECT {names} FROM ({text}) UNION ALL SELECT {names} FROM ({other.sql(schemas)})"
                case ("distinct",):
                    text = f"SELECT DISTINCT * FROM ({text})"
            done.append(step)
        return dialect(text, False)
