"""Request times under a fixed delay per host, without a loop over requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def request_slots(arrivals: DataFrame, delay_us: int, host: str = "host", at: str = "arrival_us", tie: str = "id") -> DataFrame:
    """Arrivals (host, arrival in microseconds, tie-break) with the slot each gets.

    A slot is the later of the arrival and the slot before plus the delay, which
    is a running maximum of ``arrival - delay * place`` plus ``delay * place``.
    """
    order = Window.partitionBy(host).orderBy(at, tie)
    placed = arrivals.withColumn("_place", (F.row_number().over(order) - 1).cast("long"))
    best = F.max(F.col(at) - F.lit(delay_us).cast("long") * F.col("_place")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("slot_us", best + F.lit(delay_us).cast("long") * F.col("_place")).withColumn("wait_us", F.col("slot_us") - F.col(at)).drop("_place")
