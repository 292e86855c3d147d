"""Wall-clock time. Detections carry local time without a zone (timestamp_ntz),
so nothing here reads the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SLOTS_PER_DAY = 48
MICROS = 1_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 on the same wall clock."""
    ts = _col(ts)
    seconds = (
        F.unix_date(ts.cast("date")).cast("long") * 86_400
        + F.hour(ts) * 3_600
        + F.minute(ts) * 60
    )
    return seconds * MICROS + (second_of_minute(ts) * MICROS).cast("long")


def second_of_minute(ts: Column | str) -> Column:
    """Second with its fraction, decimal(8,6)."""
    return F.extract(F.lit("SECOND"), _col(ts))


def half_hour(ts: Column | str) -> Column:
    """Hour of day plus 0.0 or 0.5."""
    ts = _col(ts)
    return F.hour(ts) + F.when(F.minute(ts) < 30, F.lit(0.0)).otherwise(F.lit(0.5))


def slot_of(date: Column | str, halfhour: Column | str) -> Column:
    """Running half-hour number since 1970-01-01."""
    return F.unix_date(_col(date)).cast("long") * SLOTS_PER_DAY + (_col(halfhour) * 2).cast("long")


def slot_date(slot: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_col(slot) / SLOTS_PER_DAY).cast("int"))


def slot_half_hour(slot: Column | str) -> Column:
    return F.pmod(_col(slot), F.lit(SLOTS_PER_DAY)) / F.lit(2.0)


def midnight(date: Column | str) -> Column:
    """Local midnight of a date, as timestamp_ntz."""
    return _col(date).cast("date").cast("timestamp_ntz")


def to_local(ts_utc: Column | str, zone: str) -> Column:
    """UTC wall clock to the wall clock of ``zone``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _col(ts_utc))
