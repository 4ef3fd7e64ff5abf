"""Joins on two inequalities, for sides of any size.

To count, both sides are put into one order for each inequality, in which a right row
stands after a left row exactly if the inequality holds (the direction and what
ties do are settled there). Places in these orders have no ties and no hot
values, so that slices of places are of equal size whatever the data.

Counting needs no pairs: right rows in later slices of both orders are summed
in a table of slices, those that share a slice with the left row are counted
inside it. Pairs are made block against block, only where two blocks can meet:
each side is cut along its own orders.
"""

from __future__ import annotations

import math
import operator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fernweft.materialize import materialize
from fernweft.operators.order import places

#: Rows of a slice when counting, at least and as a rule, and of a block when pairing.
COUNT_ROWS, PAIR_ROWS = 100_000, 2_000
#: Rows that pairing deals out at least, rows of its longest slices and blocks, and tasks.
DEALT_ROWS, LONGEST_SLICE, LONGEST_BLOCK, MOST_TASKS = 8_000_000, 250_000, 16_000, 1_000
#: Rows that are paired at once: a task holds the pairs of a right run and a block.
LEFT_RUN, RIGHT_RUN = 256, 16
COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
#: An inequality: a left column, ``<``, ``<=``, ``>`` or ``>=``, a right column.
Inequality = tuple[str, str, str]


def _order(values: Column, side: Column, op: str) -> list[Column]:
    """An order in which right rows (side 1) stand after exactly the left rows
    (side 0) for which ``left op right`` holds."""
    first = side if op in ("<=", ">=") else -side
    return [values.asc() if op[0] == "<" else values.desc(), first]


def _checked(on: list[Inequality]) -> None:
    if len(on) != 2 or any(op not in COMPARE for _, op, _ in on):
        raise ValueError("two inequalities with <, <=, > or >= are needed")


def _placed(left: DataFrame, right: DataFrame, on: list[Inequality]) -> tuple[DataFrame, int]:
    """``side, row, px, py`` of all rows that can match, and their number."""
    _checked(on)
    sides = [
        df.select(F.lit(side).alias("side"), "__row", *[F.col(pair[2 * side]).alias(c) for c, pair in zip("xy", on)])
        for side, df in enumerate((left, right))
    ]
    both = sides[0].unionByName(sides[1]).where("x is not null and y is not null")
    by_x = places(both, _order(F.col("x"), F.col("side"), on[0][1]), "px")
    by_y = materialize(places(by_x, _order(F.col("y"), F.col("side"), on[1][1]), "py").select("side", "__row", "px", "py"), "placed")
    return by_y, by_y.count()


def later_of_later(px: np.ndarray, py: np.ndarray, side: np.ndarray) -> np.ndarray:
    """For each row of side 0: rows of side 1 with greater ``px`` and ``py``.

    Rows in order of ``px`` are merged in blocks that double: in each step the
    earlier block of a pair counts rows of the later one by ``py``."""
    n = len(px)
    order = np.argsort(px, kind="stable")
    y = np.empty(n, np.int64)
    y[np.argsort(py[order], kind="stable")] = np.arange(n)
    right, counts, at = side[order] == 1, np.zeros(n, np.int64), np.arange(n)
    size = 1
    while size < n:
        pair, earlier = at // (2 * size), at // size % 2 == 0
        merged = np.argsort(pair * n + y)
        seen = np.cumsum((right & ~earlier)[merged])
        ends = np.minimum((pair[merged] + 1) * 2 * size, n) - 1
        counts[merged] += np.where(earlier[merged], seen[ends] - seen, 0)
        size *= 2
    out = np.zeros(n, np.int64)
    out[order] = np.where(right, 0, counts)
    return out


SLICED = "side int, __row bigint, px bigint, py bigint, xs bigint, ys bigint, n bigint"


def theta_count(left: DataFrame, right: DataFrame, on: list[Inequality], name: str = "n", rows: int = COUNT_ROWS) -> DataFrame:
    """``left`` with the number of right rows that fulfil both inequalities.

    ``on`` is like ``[("a", "<", "b"), ("c", ">=", "d")]``, left columns first.
    ``name`` is no column of ``left``. Nulls match nothing and such left rows
    count 0. Equal rows count each. Slices
    hold ``rows`` rows, or so many that the table of slices has no more entries
    than the sides have rows.
    """
    held = materialize(left.withColumn("__row", F.monotonically_increasing_id()), "theta-left")
    placed, n = _placed(held, right.withColumn("__row", F.lit(0).cast("long")), on)
    size = max(rows, math.isqrt(n))
    slices = max(1, -(-n // size))
    cut = placed.withColumn("xs", F.floor(F.col("px") / size)).withColumn("ys", F.floor(F.col("py") / size)).withColumn("n", F.lit(0).cast("long"))

    def same_x(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(n=later_of_later(part["px"].to_numpy(), part["py"].to_numpy(), part["side"].to_numpy()))

    def same_y(part: pd.DataFrame) -> pd.DataFrame:
        # A right row of the same slice of x is in order before the left ones.
        x = part["xs"].to_numpy() * 2 + (part["side"].to_numpy() == 0)
        found = part.assign(n=part["n"] + later_of_later(x, part["py"].to_numpy(), part["side"].to_numpy()))
        return found[found["side"] == 0]

    near = cut.groupBy("xs").applyInPandas(same_x, SLICED).groupBy("ys").applyInPandas(same_y, SLICED)
    counted = near.select("__row", "n", "xs", "ys").join(_beyond(cut, slices), ["xs", "ys"])
    summed = materialize(counted.select("__row", (F.col("n") + F.col("beyond")).alias(name)), "theta-counts")
    return held.join(summed, "__row", "left").drop("__row").na.fill(0, [name])


def _beyond(cut: DataFrame, slices: int) -> DataFrame:
    """Right rows in later slices of both orders, for each pair of slices."""
    n = cut.where("side = 1").groupBy("xs", "ys").agg(F.count(F.lit(1)).alias("n"))
    cells = cut.sparkSession.range(slices * slices).select(F.floor(F.col("id") / slices).alias("xs"), F.pmod("id", F.lit(slices)).alias("ys"))
    grid = cells.join(n, ["xs", "ys"], "left").na.fill(0, ["n"])
    after = lambda by, along: Window.partitionBy(by).orderBy(F.desc(along)).rowsBetween(Window.unboundedPreceding, -1)
    along_x = grid.withColumn("n", F.coalesce(F.sum("n").over(after("ys", "xs")), F.lit(0)))
    return along_x.select("xs", "ys", F.coalesce(F.sum("n").over(after("xs", "ys")), F.lit(0)).alias("beyond"))


def theta_join(left: DataFrame, right: DataFrame, on: list[Inequality], rows: int = PAIR_ROWS, dealt: int = DEALT_ROWS) -> DataFrame:
    """All pairs that fulfil both inequalities, with all columns of both sides;
    right columns are prefixed with ``right_``.

    Rows beyond the other side's least and greatest values go first. Each side is
    cut into slices along the first order, in order of the second, and into blocks
    of ``rows`` rows, which meet those that they can match, by the least and
    greatest values in them; the rows that this deals out are ``dealt`` or four
    for each that is left, as blocks are longer where more would meet, up to
    ``LONGEST_BLOCK``. Pairs come out of the last join with their columns and are
    neither written nor shuffled. Rows meet as arrays, and a run of left rows
    comes out for one right row after the other, so that a file of pairs repeats
    itself and stays small. Nulls match nothing; equal rows match each.
    """
    _checked(on)
    a = _can_match(left, right, [(x, op, y) for x, op, y in on], "theta-left")
    b = _can_match(right, a, [(y, TURNED[op], x) for x, op, y in on], "theta-right")
    lefts, left_rows = _ranked(a, *[x for x, _, _ in on], rows)
    rights, right_rows = _ranked(b, *[y for _, _, y in on], rows)
    rights = rights.select("__slice", "__rank", *[F.col(c).alias(f"right_{c}") for c in right.columns])
    on = [(x, op, f"right_{y}") for x, op, y in on]
    most, size = max(dealt, 4 * (a.count() + b.count())), rows
    while True:
        one, other = _blocks(lefts, left_rows, size, "__block"), _blocks(rights, right_rows, size, "__right_block")
        meeting = _can_meet(one, other, on)
        n = meeting.count()
        if 2 * size * n <= most or size >= LONGEST_BLOCK:
            break
        size = min(LONGEST_BLOCK, size * max(2, 2 * size * n // most))
    meeting = materialize(meeting, "meeting-blocks")
    keys, tasks = ["__block", "__right_block"], max(1, min(n, MOST_TASKS))
    # Tasks are stated, as their work is in what they return and not in what they read.
    some = _runs(one, keys[0], LEFT_RUN, on, 0, left.columns).join(meeting, keys[0]).repartition(tasks, *keys)
    others = _runs(other, keys[1], RIGHT_RUN, on, 1, [f"right_{c}" for c in right.columns]).join(meeting, keys[1]).repartition(tasks, *keys)
    named = some.select(*[F.col(k).alias(f"{k}_of_left") for k in keys], "__run_0", "end_0_0", "end_0_1")
    same = [F.col(k) == F.col(f"{k}_of_left") for k in keys]
    # Merged, never broadcast: a right run meets the left runs of one block at a time.
    met = others.join(named.hint("merge"), reduce(and_, same + _reach(on)))
    each = met.select(F.explode("__run_1").alias("__right"), "__run_0").select("__right", F.explode("__run_0").alias("__left"))
    found = each.where(reduce(and_, [COMPARE[op](F.col("__left")[x], F.col("__right")[y]) for x, op, y in on]))
    return found.select(*[F.col("__left")[c].alias(c) for c in left.columns], *[F.col("__right")[f"right_{c}"].alias(f"right_{c}") for c in right.columns])


def _ranked(df: DataFrame, x: str, y: str, rows: int) -> tuple[DataFrame, int]:
    """``df`` with ``__slice`` along ``x`` and ``__rank`` along ``y`` in it, and
    the rows of a slice: about as many slices as left runs in each."""
    run = min(rows, LEFT_RUN)
    size = min(LONGEST_SLICE, max(run, math.isqrt(df.count() * run)))
    cut = places(df, [F.col(x)], "__place").withColumn("__slice", F.floor(F.col("__place") / size)).drop("__place")
    rank = F.row_number().over(Window.partitionBy("__slice").orderBy(y)) - 1
    return materialize(cut.withColumn("__rank", rank), "ranked"), size


def _blocks(ranked: DataFrame, slice_rows: int, rows: int, name: str) -> DataFrame:
    """Column ``name``: numbers without gaps of blocks of ``rows`` rows or fewer,
    which are parts of a slice or whole slices."""
    if rows >= slice_rows:
        return ranked.withColumn(name, F.floor(F.col("__slice") / (rows // slice_rows)))
    parts = -(-slice_rows // rows)
    return ranked.withColumn(name, F.col("__slice") * parts + F.floor(F.col("__rank") / -(-slice_rows // parts)))


def _runs(blocks: DataFrame, key: str, rows: int, on: list[Inequality], side: int, columns: list[str]) -> DataFrame:
    """``key``, arrays ``__run_0`` or ``__run_1`` of ``rows`` rows, and their ends."""
    run = F.collect_list(F.struct(*columns)).alias(f"__run_{side}")
    return blocks.groupBy(key, "__slice", F.floor(F.col("__rank") / rows).alias("__part")).agg(run, *_ends(on, side)).drop("__slice", "__part")


def _can_match(df: DataFrame, others: DataFrame, on: list[Inequality], label: str) -> DataFrame:
    """Rows that fulfil each inequality with some row of ``others``."""
    bounds = [(F.max if op[0] == "<" else F.min)(y) for _, op, y in on]
    return materialize(df.where(reduce(and_, [COMPARE[op](F.col(x), others.select(bound).scalar()) for (x, op, _), bound in zip(on, bounds)])), label)


def _ends(on: list[Inequality], side: int) -> list[Column]:
    """What is most likely to fulfil each inequality."""
    return [(F.min if (op[0] == "<") == (side == 0) else F.max)((x, y)[side]).alias(f"end_{side}_{i}") for i, (x, op, y) in enumerate(on)]


def _reach(on: list[Inequality]) -> list[Column]:
    """Whether two groups of rows may match, by their ends."""
    return [COMPARE[op](F.col(f"end_0_{i}"), F.col(f"end_1_{i}")) for i, (_, op, _) in enumerate(on)]


def _can_meet(lefts: DataFrame, rights: DataFrame, on: list[Inequality]) -> DataFrame:
    """Pairs ``__block, __right_block`` of which some rows may fulfil each
    inequality. Blocks are few beside rows; each left block is matched with all
    right ones, and those out of reach are left out."""
    tops = materialize(rights.groupBy("__right_block").agg(*_ends(on, 1)), "right-blocks")
    last = F.coalesce(tops.select(F.max("__right_block")).scalar(), F.lit(-1).cast("long"))
    ranges = lefts.groupBy("__block").agg(*_ends(on, 0)).where(last >= 0).withColumn("__right_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return ranges.join(tops, "__right_block").where(reduce(and_, _reach(on))).select("__block", "__right_block")
