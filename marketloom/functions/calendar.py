"""The exchange calendar as expressions over a New York date (text) and clock (HH:MM)."""

from __future__ import annotations

# fixed values: days without a session, and days that close at 13:00
HOLIDAYS = (
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-03-29", "2024-05-27", "2024-06-19", "2024-07-04", "2024-09-02", "2024-11-28", "2024-12-25",
    "2025-01-01", "2025-01-20", "2025-02-17", "2025-04-18", "2025-05-26", "2025-06-19", "2025-07-04", "2025-09-01", "2025-11-27", "2025-12-25",
    "2026-01-01", "2026-01-19", "2026-02-16", "2026-04-03", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-11-26", "2026-12-25",
    "2027-01-01", "2027-01-18", "2027-02-15", "2027-03-26", "2027-05-31", "2027-06-18", "2027-07-05", "2027-09-06", "2027-11-25", "2027-12-24",
)
EARLY_CLOSES = ("2024-07-03", "2024-11-29", "2024-12-24", "2025-07-03", "2025-11-28", "2025-12-24", "2026-11-27", "2026-12-24", "2027-11-26")


def _among(day: str, days: tuple) -> str:
    return f"{day} IN ({', '.join(repr(d) for d in days)})"


def session(day: str = "session", clock: str = "clock") -> str:
    """REGULAR, PRE_MARKET, AFTER_HOURS, CLOSED_WEEKEND, CLOSED_HOLIDAY or CLOSED."""
    ends = f"CASE WHEN {_among(day, EARLY_CLOSES)} THEN '13:00' ELSE '16:00' END"
    return (f"CASE WHEN @dow(CAST({day} AS DATE)) IN (1, 7) THEN 'CLOSED_WEEKEND' WHEN {_among(day, HOLIDAYS)} THEN 'CLOSED_HOLIDAY' WHEN {clock} >= '09:30' AND {clock} < {ends} THEN 'REGULAR' "
            f"WHEN {clock} >= '04:00' AND {clock} < '09:30' THEN 'PRE_MARKET' WHEN {clock} >= {ends} AND {clock} < '20:00' THEN 'AFTER_HOURS' ELSE 'CLOSED' END")


def tradeable(kind: str = "kind", extended: bool = False) -> str:
    return f"{kind} IN ('REGULAR', 'PRE_MARKET', 'AFTER_HOURS')" if extended else f"{kind} = 'REGULAR'"


def covered(day: str = "session") -> str:
    """Whether the holidays of the day's year are known."""
    return f"substr({day}, 1, 4) BETWEEN '{min(HOLIDAYS)[:4]}' AND '{max(HOLIDAYS)[:4]}'"
