"""Window frames over groups that no task should hold.

A group's order is cut into slots and each slot is a window of its own; the rows
that a slot's frames reach into in its neighbours are copied in beside it (a
halo) and left out again afterwards. Results are those of one window a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.operators.order import places

#: Rows of a slot of a frame by rows.
SLOT_ROWS = 50_000


def time_frame(df: DataFrame, by: list[str], ts: str, preceding: int, following: int = 0, slot: int | None = None, **aggregates: Column) -> DataFrame:
    """Add ``aggregates`` over the rows of the group from ``preceding`` seconds
    before to ``following`` seconds after each row's ``ts``, ends included.

    ``slot`` is the width of a slot in seconds: the frame's where it is not
    given, and no less than that. Rows with equal times share a frame; rows
    without a time share one with each other, in one task. Groups may be null.
    """
    width = max(slot or 0, preceding, following, 1) * 1_000_000
    at = F.col("__at")
    timed = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__home", F.floor(at / F.lit(width)))
    inside = at - F.col("__home") * width
    return _framed(
        timed,
        [*by, "__slot"],
        copy_on=inside >= width - preceding * 1_000_000,
        copy_back=inside < following * 1_000_000 + 1,
        window=lambda keys: Window.partitionBy(*keys).orderBy("__at").rangeBetween(-preceding * 1_000_000, following * 1_000_000),
        aggregates=aggregates,
    ).drop("__at")


def row_frame(df: DataFrame, by: list[str], order: list[Column], before: int, after: int, rows: int = SLOT_ROWS, **aggregates: Column) -> DataFrame:
    """Add ``aggregates`` over the rows of the group from ``before`` rows before
    to ``after`` rows after each row in ``order``.

    Rows are put into one order of the whole table, group by group, and cut into
    slots of ``rows`` rows, whatever the groups. Where rows tie in ``order``
    their order is arbitrary but the same for all aggregates."""
    size = max(rows, before, after, 1)
    placed = places(df, [*[F.col(c).asc_nulls_first() for c in by], *order], "__at").withColumn("__home", F.floor(F.col("__at") / size))
    inside = F.pmod("__at", F.lit(size))
    return _framed(
        placed,
        [*by, "__slot"],
        copy_on=inside >= size - before,
        copy_back=inside < after,
        window=lambda keys: Window.partitionBy(*keys).orderBy("__at").rowsBetween(-before, after),
        aggregates=aggregates,
    ).drop("__at")


def _framed(df: DataFrame, keys: list[str], copy_on: Column, copy_back: Column, window, aggregates: dict[str, Column]) -> DataFrame:
    """Rows in their own slot and, as copies, in those that reach for them."""
    home = F.col("__home")
    slots = F.array_compact(F.array(F.when(copy_on, home + 1), F.when(copy_back, home - 1)))
    spread = df.withColumn("__slot", F.explode_outer(F.when(home.isNotNull(), F.concat(F.array(home), slots))))
    over = window(keys)
    summed = spread.select("*", *[a.over(over).alias(name) for name, a in aggregates.items()])
    return summed.where(home.eqNullSafe(F.col("__slot"))).drop("__slot", "__home")
