"""Top-k lists and overlap suppression of scored square windows.

Input rows hold ``page, seq, x0, y0, x1, y1, score``; ``seq`` is the arrival
order and unique within a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxeval.functions.geometry import Box, iou
from boxeval.operators.keys import join_groups
from boxeval.operators.ordered import hot_groups
from boxeval.session import cut

# fixed values: overlaps, floor, ratio and limits of lists
SUPPRESS_IOU = 0.72
DIVERSE_IOU = 0.75
SCORE_FLOOR = 1.15
AMBIGUITY_RATIO = 0.035
RESULT_LIMIT = 4
DIVERSE_LIMIT = 48
FOLD_LIMIT = 256
CHUNK = 100_000
#: A page with more rows than the first is read by as many tasks as the second.
LARGE_PAGE, DEALS = 20_000, 32
#: Most large pages that are broadcast.
MOST_BROADCAST = 100_000
_EDGES = ["x0", "y0", "x1", "y1"]


def with_corners(df: DataFrame) -> DataFrame:
    """``x, y, side`` windows as boxes."""
    return df.select(
        "page", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"),
        (F.col("x") + F.col("side")).alias("x1"), (F.col("y") + F.col("side")).alias("y1"), "score",
    )


def _finite(df: DataFrame) -> DataFrame:
    bound = F.lit(float("inf"))
    return df.where(~F.isnan("score") & (F.abs("score") < bound))


def top_k(df: DataFrame, k: int) -> DataFrame:
    """Best ``k`` rows per page; equal scores keep arrival order.

    The limit on the row number lets every task cut its share of a page to
    ``k`` rows before the shuffle.
    """
    best_first = Window.partitionBy("page").orderBy(F.desc("score"), "seq")
    ranked = _finite(df).withColumn("rank", F.row_number().over(best_first))
    return ranked.where(F.col("rank") <= k)


def _entries() -> list[Column]:
    return [(-F.col("score")).alias("worse"), F.col("seq"), *(F.col(e) for e in _EDGES)]


def _entry() -> Column:
    """A window that sorts best first."""
    return F.struct(*_entries())


def _box(entry: Column) -> Box:
    return Box(*(entry[e] for e in _EDGES))


def _after(a: Column, b: Column) -> Column:
    return (a["worse"] > b["worse"]) | ((a["worse"] == b["worse"]) & (a["seq"] > b["seq"]))


def _differs(a: Box, b: Box) -> Column:
    """Offset or size further apart than small-window tolerance."""
    allowed = F.greatest(F.lit(1.5), F.least(a.width, b.width) / 32)
    return (
        (F.abs(a.x0 - b.x0) > allowed)
        | (F.abs(a.y0 - b.y0) > allowed)
        | (F.abs(a.width - b.width) > allowed * 2)
    )


def _rival(best: Column, other: Column, ratio: float) -> Column:
    """``other`` comes later, overlaps, lies elsewhere and scores nearly as well."""
    top, low = -best["worse"], -other["worse"]
    return (
        _after(other, best)
        & (iou(_box(best), _box(other)) >= SUPPRESS_IOU)
        & _differs(_box(best), _box(other))
        & ((top - low) / top <= ratio)
    )


def suppress(
    df: DataFrame,
    abstain: bool = True,
    limit: int = RESULT_LIMIT,
    floor: float = SCORE_FLOOR,
    ratio: float = AMBIGUITY_RATIO,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Windows that no better window overlaps, best first, ``limit`` per page.

    With ``abstain`` a window with a near-equal rival elsewhere is left out,
    but still suppresses.  Pages above ``fold_limit`` rows go through rounds.
    """
    large = cut(hot_groups(df, ["page"], fold_limit))
    if large.isEmpty():
        return _suppress_fold(df, abstain, limit, floor, ratio)
    small = _suppress_fold(df.join(large, "page", "left_anti"), abstain, limit, floor, ratio)
    rounds = suppress_rounds(df.join(large, "page", "left_semi"), abstain, limit, floor, ratio)
    return small.unionByName(rounds)


def _keep(floor: float) -> Column:
    """The windows of ``todo``, best first, that reach ``floor`` and that no better one hides."""

    def take(done: Column, one: Column) -> Column:
        hidden = F.exists(done, lambda d: iou(_box(d), _box(one)) >= SUPPRESS_IOU)
        return F.when((-one["worse"] < floor) | hidden, done).otherwise(F.concat(done, F.array(one)))

    return F.aggregate("todo", F.filter("todo", lambda _: F.lit(False)), take)


def _suppress_fold(df: DataFrame, abstain: bool, limit: int, floor: float, ratio: float) -> DataFrame:
    pages = _finite(df).groupBy("page").agg(F.sort_array(F.collect_list(_entry())).alias("todo"))
    pages = pages.withColumn("kept", _keep(floor))
    if abstain:
        clear = F.filter(
            "kept", lambda k: ~F.exists(F.col("todo"), lambda o: _rival(k, o, ratio))
        )
        pages = pages.withColumn("kept", clear)
    listed = pages.select("page", F.posexplode(F.slice("kept", 1, limit)).alias("at", "w"))
    return listed.select(
        "page", "w.seq", *(F.col(f"w.{e}") for e in _EDGES), (-F.col("w.worse")).alias("score"),
        (F.col("at") + 1).alias("rank"),
    )


def suppress_rounds(
    df: DataFrame,
    abstain: bool = True,
    limit: int = RESULT_LIMIT,
    floor: float = SCORE_FLOOR,
    ratio: float = AMBIGUITY_RATIO,
    chunk: int = FOLD_LIMIT,
    large_page: int = LARGE_PAGE,
) -> DataFrame:
    """The same selection for pages of any size, best windows first.

    A round folds the best ``chunk`` open windows of each page and compares
    what it keeps with the page's other windows, which are dealt over tasks
    where there are more than ``large_page``.  Windows that a kept one hides
    are no longer open, and a page with ``limit`` results leaves, so overlaps
    are never listed pair by pair.
    """
    open_row = (-F.col("worse") >= floor).alias("open")
    rows = _finite(df).withColumn("worse", -F.col("score")).select("page", "worse", "seq", *_EDGES, open_row)
    rows = _with_deals(cut(rows), large_page)
    best_first = Window.partitionBy("page").orderBy("worse", "seq")
    results = []
    while True:
        head = rows.where("open").withColumn("at", F.row_number().over(best_first)).where(F.col("at") <= chunk)
        lists = head.groupBy("page").agg(F.sort_array(F.collect_list(_window())).alias("todo"), F.max("deals").alias("deals"))
        folded = cut(lists.select("page", "deals", _keep(floor).alias("kept"), F.element_at("todo", -1).alias("last")))
        if folded.isEmpty():
            break
        clear = folded.select("page", F.inline("kept"))
        if abstain:
            clear = join_groups(clear, _unsure(rows, folded, ratio), ["page", "seq"], "left_anti")
        results.append(cut(clear))
        counted = reduce(DataFrame.unionByName, results).groupBy("page").agg(F.count("*").alias("n"))
        done = counted.where(F.col("n") >= limit).select("page")
        later = _met(rows, join_groups(folded, done, ["page"], "left_anti")).where(_after(_window(), F.col("last")))
        hidden = F.exists("kept", lambda k: iou(_box(k), _box(_window())) >= SUPPRESS_IOU)
        rows = cut(later.withColumn("open", F.col("open") & ~hidden).select(*rows.columns))
    chosen = reduce(DataFrame.unionByName, results) if results else rows.where("open")
    scored = chosen.withColumn("score", -F.col("worse")).select("page", "seq", *_EDGES, "score")
    return top_k(scored, limit)


def _window() -> Column:
    return F.struct("worse", "seq", *_EDGES)


def _with_deals(rows: DataFrame, large_page: int) -> DataFrame:
    """``deals``: over how many tasks the rows of the page are dealt."""
    large = cut(hot_groups(rows, ["page"], large_page).withColumn("deals", F.lit(DEALS)))
    n = large.count()
    if n == 0:
        return rows.withColumn("deals", F.lit(1))
    marked = join_groups(rows, F.broadcast(large) if n <= MOST_BROADCAST else large, ["page"], "left")
    return cut(marked.withColumn("deals", F.coalesce("deals", F.lit(1))))


def _met(rows: DataFrame, folded: DataFrame) -> DataFrame:
    """Rows with the list of their page; there is a copy of the list for each task that reads a large page."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("seq"), F.col("deals"))).drop("deals")
    copies = folded.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals").cast("bigint") - 1)))
    return join_groups(dealt, copies, ["page", "deal"])


def _unsure(rows: DataFrame, folded: DataFrame, ratio: float) -> DataFrame:
    """Kept windows that have a rival among the page's rows."""
    rivals = F.filter("kept", lambda k: _rival(k, _window(), ratio))
    return _met(rows, folded).select("page", F.explode(rivals).alias("k")).select("page", "k.seq").distinct()


def diverse_top_k(
    df: DataFrame, k: int = DIVERSE_LIMIT, at_least: float = DIVERSE_IOU, chunk: int = CHUNK
) -> DataFrame:
    """A bounded list built in arrival order that holds no near copies.

    A newcomer is compared with the best kept window it overlaps: it is dropped
    unless it scores higher, and then takes that window's place.  The kept
    scores never fall, so once a list is full, rows at or below its last score
    are dropped unseen.  Pages above ``chunk`` rows are read chunk by chunk.
    """
    rows = _finite(df)
    todo, state = rows, None
    while not cut(hot_groups(todo, ["page"], chunk)).isEmpty():
        first = Window.partitionBy("page").orderBy("seq")
        head = todo.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= chunk).drop("_n")
        head = cut(head)
        state = cut(_insert_all(head, state, k, at_least))
        seen = head.groupBy("page").agg(F.max("seq").alias("_seen"))
        last = state.select("page", F.when(F.size("kept") == k, -F.element_at("kept", -1)["worse"]).alias("_bar"))
        rest = todo.join(seen, "page").join(last, "page", "left").where(F.col("seq") > F.col("_seen"))
        todo = cut(rest.where(F.col("_bar").isNull() | (F.col("score") > F.col("_bar"))).select(*rows.columns))
    done = _insert_all(todo, state, k, at_least)
    listed = done.select("page", F.posexplode("kept").alias("at", "w"))
    return listed.select(
        "page", "w.seq", *(F.col(f"w.{e}") for e in _EDGES), (-F.col("w.worse")).alias("score"),
        (F.col("at") + 1).alias("rank"),
    )


def _insert_all(rows: DataFrame, state: DataFrame | None, k: int, at_least: float) -> DataFrame:
    arrivals = F.struct("seq", (-F.col("score")).alias("worse"), *_EDGES)
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list(arrivals)).alias("todo"))
    kind = rows.select(F.array(_entry()).alias("e")).schema["e"].dataType.simpleString()
    if state is None:
        pages = pages.withColumn("kept", F.array().cast(kind))
    else:
        pages = pages.join(state, "page", "full").withColumn(
            "kept", F.coalesce("kept", F.array().cast(kind))
        )

    def insert(kept: Column, arrival: Column) -> Column:
        one = F.struct(*(arrival[c].alias(c) for c in ("worse", "seq", *_EDGES)))
        met = F.get(F.filter(kept, lambda e: iou(_box(e), _box(one)) >= at_least), F.lit(0))
        # the window it replaces, if any, makes room
        others = F.filter(kept, lambda e: F.coalesce(e["seq"] != met["seq"], F.lit(True)))
        grown = F.slice(F.sort_array(F.concat(others, F.array(one))), 1, k)
        return F.when(F.coalesce(met["worse"] <= one["worse"], F.lit(False)), kept).otherwise(grown)

    folded = F.aggregate(F.coalesce("todo", F.expr("filter(todo, x -> false)")), F.col("kept"), insert)
    return pages.select("page", F.when(F.col("todo").isNull(), F.col("kept")).otherwise(folded).alias("kept"))


def over_limit(pred: DataFrame, n: int = RESULT_LIMIT) -> DataFrame:
    """Inputs with more than ``n`` predictions, as infrastructure failures."""
    counted = pred.groupBy("page").agg(F.count("*").alias("predictions"))
    return counted.where(F.col("predictions") > n).withColumn("reason", F.lit("too-many-predictions"))
