"""The scalar operators as SQL functions, without Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

_EDGES = "x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"
_SHARED = (
    "greatest(0D, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0D, least(ay1, by1) - greatest(ay0, by0))"
)
_BOTH = ", ".join(f"{side}{edge.split()[0]} DOUBLE" for side in "ab" for edge in _EDGES.split(", "))


def _replaced(start: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        start = f"replace({start}, '{old}', '{new}')"
    return start


def definitions() -> dict[str, tuple[str, str, str]]:
    """Name to parameters, type and body."""
    runs = [(str(n), "." * n) for n in range(1, 9)]
    return {
        "box_iou": (
            _BOTH,
            "DOUBLE",
            f"{_SHARED} / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - {_SHARED})",
        ),
        "board_cells": ("placement STRING", "STRING", _replaced("replace(placement, '/', '')", runs)),
        "board_cells_strict": (
            "placement STRING",
            "STRING",
            # eight ranks of eight squares, no two numbers side by side
            f"CASE WHEN placement RLIKE '^[prnbqkPRNBQK1-8/]+$' AND NOT placement RLIKE '[1-8][1-8]' AND size(split(placement, '/')) = 8 "
            f"AND forall(split(placement, '/'), rank -> length({_replaced('rank', runs)}) = 8) "
            f"THEN {_replaced("replace(placement, '/', '')", runs)} END",
        ),
        "safe_ratio": ("n DOUBLE, d DOUBLE", "DOUBLE", "try_divide(n, d)"),
        "round_half_up": ("v DOUBLE", "DOUBLE", "CAST(floor(v + 0.5D) AS DOUBLE)"),
    }


def register_operators(spark: SparkSession) -> list[str]:
    names = []
    for name, (params, kind, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {kind} RETURN {body}")
        names.append(name)
    return names


def register_distribution(spark: SparkSession, view: str, keys: list[str], value: str, name: str = "distribution") -> None:
    """``SELECT * FROM distribution(least)``: count, min, p50, p95 and max of a view's column per group.

    As the operator of that name: null values don't count, a null key is a
    group, percentiles are of the nearest rank.  ``least`` leaves out groups
    with fewer values, and is 0 if it is not given.  Equal values are counted
    before they are shuffled; the different ones of a group are ranked in one
    task, which may spill, where the operator also takes groups of more.
    """
    def quoted(column: str) -> str:
        return "`" + column.replace("`", "``") + "`"

    kinds = {f.name: f.dataType.simpleString() for f in spark.table(view).schema.fields}
    by = ", ".join(map(quoted, keys))
    returned = [f"{quoted(k)} {kinds[k]}" for k in keys] + ["`count` BIGINT"] + [f"{c} {kinds[value]}" for c in ("min", "p50", "p95", "max")]
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(least BIGINT DEFAULT 0) RETURNS TABLE({", ".join(returned)}) RETURN
        WITH counted AS (SELECT {by}, {quoted(value)} AS _v, count(*) AS _n FROM {view} GROUP BY {by}, {quoted(value)}),
        ranked AS (SELECT *, sum(_n) OVER (PARTITION BY {by} ORDER BY _v NULLS LAST ROWS UNBOUNDED PRECEDING) AS _upto,
          sum(CASE WHEN _v IS NOT NULL THEN _n ELSE 0 END) OVER (PARTITION BY {by}) AS _total FROM counted)
        SELECT {by}, max(_total), min(_v), min(_v) FILTER (WHERE _upto >= ceil(0.5D * _total)),
          min(_v) FILTER (WHERE _upto >= ceil(0.95D * _total)), max(_v)
        FROM ranked GROUP BY {by} HAVING max(_total) >= least"""
    )
