"""Durations (as seconds), backoff and timestamps in text form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3_600, 86_400
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = r"[0-9]+(?:\.[0-9]*)?(?:ns|us|µs|ms|s|m|h)"


def _simple(text: str) -> float | None:
    """Seconds of a sequence such as 1h30m; None if it is none."""
    if text in ("0", "+0", "-0"):
        return 0.0
    if not re.fullmatch(rf"[+-]?(?:{_PART})+", text):
        return None
    total = sum(float(n) * _UNITS[u] for n, u in re.findall(r"([0-9]+(?:\.[0-9]*)?)(ns|us|µs|ms|s|m|h)", text))
    return -total if text[0] == "-" else total


def parse_text(text: str) -> float:
    """Seconds of ``30m``, ``1h30m``, ``7d`` or ``1d12h``."""
    plain = _simple(text)
    if plain is not None:
        return plain
    days = re.fullmatch(r"\s*([+-]?[0-9]+)d(\S*)", text)
    rest = _simple(days[2]) if days and days[2] else 0.0
    if not days or rest is None:
        raise ValueError(f"not an interval: {text!r} (try 30m, 24h, 7d)")
    return int(days[1]) * DAY + rest


def parse(text: Column) -> Column:
    """Seconds of an interval, null if it is malformed; native."""
    days = F.regexp_extract(text, r"^([0-9]+)d", 1)
    rest = F.regexp_replace(text, r"^[0-9]+d", "")
    good = text.rlike(r"^(?:[0-9]+d)?(?:[0-9]+(?:\.[0-9]*)?(?:ms|s|m|h))*$") & (text != "")

    def total(unit: str) -> Column:
        numbers = F.regexp_extract_all(rest, F.lit(rf"([0-9]+(?:\.[0-9]*)?){unit}"), F.lit(1))
        return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x.cast("double"))

    seconds = total("h") * HOUR + total("m(?!s)") * MINUTE + total("s") + total("ms") / 1000
    return F.when(good, F.when(days == "", 0.0).otherwise(F.expr("0.0") + F.try_to_number(days, F.lit("999999999")).cast("double") * DAY) + seconds)


def format(seconds: Column) -> Column:
    """Largest two units, cut off: 45s, 12m, 2h5m, 3d4h."""
    s = seconds.cast("long")
    minutes, hours = F.floor(s / MINUTE), F.floor(s / HOUR)
    days = F.floor(hours / 24)
    text = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    some = lambda n, unit: F.when(n > 0, text(n, unit)).otherwise("")
    return (
        F.when(s < MINUTE, text(s, "s")).when(s < HOUR, text(minutes, "m")).when(s < DAY, F.concat(text(hours, "h"), some(minutes % 60, "m"))).otherwise(F.concat(text(days, "d"), some(hours % 24, "h")))
    )


def format_text(seconds: float) -> str:
    s = int(seconds)
    if s < MINUTE:
        return f"{s}s"
    if s < HOUR:
        return f"{s // MINUTE}m"
    big, small, units = (s // HOUR, s % HOUR // MINUTE, "hm") if s < DAY else (s // DAY, s % DAY // HOUR, "dh")
    return f"{big}{units[0]}" + (f"{small}{units[1]}" if small else "")


def backoff(attempt: Column, initial: Column, most: Column) -> Column:
    """Delay before the ``attempt``-th retry: doubled each time, up to ``most``."""
    delay = initial * F.pow(F.lit(2.0), attempt - 1)
    return F.when((delay <= 0) | (delay > most), most).otherwise(delay)


def jitter(delay: Column, seed: int | None = None, key: Column | None = None) -> Column:
    """Delay within a tenth on either side; of a ``key`` always the same, so that a task that runs again waits as long."""
    share = F.rand(seed) if key is None else F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return delay + (share * 0.2 - 0.1) * delay


def rfc3339(ts: Column) -> Column:
    """UTC text with the fraction's trailing zeros dropped.  Such texts are compared as texts (see the history operators)."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(whole, F.when(part == "", "").otherwise(F.concat(F.lit("."), part)), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    return F.try_to_timestamp(text)


def next_run(last: Column, interval: Column, now: Column) -> Column:
    """Seconds since the epoch of the next run: now if there was none."""
    return F.coalesce(last + interval, now)
