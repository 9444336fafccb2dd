"""One-to-one matching of predicted boxes with true boxes.

Two facts keep this from pairing everything with everything on a page:

* boxes with an IoU of at least ``t`` have centres and sizes close to each
  other, so an equi join on a size-aware grid finds every such pair;
* copies of a box behave alike, so geometry is compared once per distinct box
  and copies are matched by rank.

Page keys, prediction indexes ``p`` and truth indexes ``a`` may be of any
orderable type; both indexes must be unique within a page.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxeval.functions.geometry import Box, box, iou
from boxeval.operators.ordered import hot_groups, row_numbers
from boxeval.session import cut

MATCH_IOU = 0.9
FOLD_LIMIT = 256
_EDGES = ["x0", "y0", "x1", "y1"]
_CELLS = ["_lw", "_lh", "_cx", "_cy"]


def _grid(df: DataFrame, at_least: float, spread: bool) -> DataFrame:
    """Add grid keys to boxes.

    The keys hold the size level of each side and the cell of the centre.  One
    side of a join stays in its own cell; the other is spread over the cells a
    partner with the wanted IoU can have, which is one or two per key.
    """
    base = max(2.0, at_least**-2)
    reach = (1 - at_least) / (2 * at_least)
    slack = 1e-9
    b = box()

    def level(size: Column) -> Column:
        return F.floor(F.log(size) / log(base)).cast("int")

    def cell(center: Column, lev: Column) -> Column:
        return F.floor(center / (F.pow(F.lit(base), lev + 1) * max(0.5, 2 * reach)))

    center_x, center_y = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
    if not spread:
        leveled = df.withColumn("_lw", level(b.width)).withColumn("_lh", level(b.height))
        return leveled.withColumn("_cx", cell(center_x, F.col("_lw"))).withColumn(
            "_cy", cell(center_y, F.col("_lh"))
        )

    def levels(size: Column) -> Column:
        low, high = size * at_least * (1 - slack), size / at_least * (1 + slack)
        return F.explode(F.sequence(level(low), level(high)))

    def cells(center: Column, size: Column, lev: str) -> Column:
        # centres are at most this share of the smaller side apart
        smaller = F.least(size, F.pow(F.lit(base), F.col(lev) + 1))
        away = smaller * reach * (1 + slack) + slack
        return F.explode(
            F.sequence(cell(center - away, F.col(lev)), cell(center + away, F.col(lev)))
        )

    leveled = df.withColumn("_lw", levels(b.width)).withColumn("_lh", levels(b.height))
    return leveled.withColumn("_cx", cells(center_x, b.width, "_lw")).withColumn(
        "_cy", cells(center_y, b.height, "_lh")
    )


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(
        *(F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns)
    )


def near_pairs(left: DataFrame, right: DataFrame, key: str, at_least: float) -> DataFrame:
    """Rows of both sides on the same ``key`` with IoU >= ``at_least`` (> 0).

    Columns come back prefixed ``l_`` and ``r_``, with the shared key and ``iou``.
    """
    keep = [key, *_CELLS]
    l_grid = _prefixed(_grid(left, at_least, spread=False), "l_", keep)
    r_grid = _prefixed(_grid(right, at_least, spread=True), "r_", keep)
    # size estimates do not see that rows are spread over cells, so a broadcast
    # chosen from them could outgrow memory; a sorted join can also split skew
    joined = l_grid.join(r_grid.hint("merge"), keep).drop(*_CELLS)
    scored = joined.withColumn("iou", iou(box("l_"), box("r_")))
    return scored.where(F.col("iou") >= at_least)


def touching_pairs(left: DataFrame, right: DataFrame, key: str, tile: float = 256.0) -> DataFrame:
    """Rows of both sides on the same ``key`` that overlap at all.

    Boxes are listed in every tile they touch; a pair counts in the tile that
    holds the top-left corner of its overlap, so no pair comes twice.
    """

    def tiled(df: DataFrame, prefix: str) -> DataFrame:
        b = box()
        spans = df.withColumn(
            "_tx", F.explode(F.sequence(F.floor(b.x0 / tile), F.floor(b.x1 / tile)))
        ).withColumn("_ty", F.explode(F.sequence(F.floor(b.y0 / tile), F.floor(b.y1 / tile))))
        return _prefixed(spans, prefix, [key, "_tx", "_ty"])

    joined = tiled(left, "l_").join(tiled(right, "r_").hint("merge"), [key, "_tx", "_ty"])
    l, r = box("l_"), box("r_")
    owner = (F.col("_tx") == F.floor(F.greatest(l.x0, r.x0) / tile)) & (
        F.col("_ty") == F.floor(F.greatest(l.y0, r.y0) / tile)
    )
    scored = joined.where(owner).drop("_tx", "_ty").withColumn("iou", iou(l, r))
    return scored.where(F.col("iou") > 0)


def distinct_boxes(df: DataFrame, index: str) -> DataFrame:
    """One row per page and geometry: its number of copies and smallest index."""
    return df.groupBy("page", *_EDGES).agg(
        F.count("*").alias("n"), F.min(index).alias("first")
    )


def box_pairs(pred: DataFrame, truth: DataFrame, at_least: float = MATCH_IOU) -> DataFrame:
    """Pairs of distinct predicted and true boxes of a page with their IoU.

    ``n_pred`` and ``n_truth`` are the copies behind each pair, so nothing is
    lost by listing geometry once.  ``at_least=0`` lists every overlap.
    """
    p, a = distinct_boxes(pred, "p"), distinct_boxes(truth, "a")
    found = (
        near_pairs(p, a, "page", at_least) if at_least > 0 else touching_pairs(p, a, "page")
    )
    return found.select(
        "page",
        *(F.col("l_" + e).alias("p" + e) for e in _EDGES),
        *(F.col("r_" + e).alias("t" + e) for e in _EDGES),
        "iou",
        F.col("l_first").alias("first_p"),
        F.col("r_first").alias("first_a"),
        F.col("l_n").alias("n_pred"),
        F.col("r_n").alias("n_truth"),
    )


def large_pages(boxes: DataFrame, limit: int = FOLD_LIMIT) -> DataFrame | None:
    """Pages with more than ``limit`` rows, if there are any; a null page is none."""
    large = cut(hot_groups(boxes.select("page").where(F.col("page").isNotNull()), ["page"], limit))
    return None if large.isEmpty() else large


def gathered(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per page with all its boxes: ``page, preds, truths``, arrays of structs of the other columns.

    Only for pages with few boxes (see ``large_pages``).  Both sides meet in one
    shuffle by page, and what is made of a page stays partitioned by it.
    """

    def packed(df: DataFrame) -> Column:
        return F.struct(*(c for c in df.columns if c != "page"))

    p, t = pred.select("page", packed(pred).alias("pred")), truth.select("page", packed(truth).alias("truth"))
    boxes = p.unionByName(t, allowMissingColumns=True).where(F.col("page").isNotNull())
    # dealt out before lists are made, as lists of a part of a page would be sorted for nothing
    return boxes.repartition("page").groupBy("page").agg(
        F.collect_list("pred").alias("preds"), F.collect_list("truth").alias("truths")
    )


def _box_of(entry: Column) -> Box:
    return Box(*(entry[e] for e in _EDGES))


def _solid(entries: str) -> Column:
    """Boxes that have an area; no other has an IoU of note."""
    return F.filter(entries, lambda e: (e["x1"] > e["x0"]) & (e["y1"] > e["y0"]))


def _folded(pages: DataFrame, a_type: str, at_least: float) -> DataFrame:
    """Add ``pairs`` to gathered pages: what ``pairing`` says of them, by one ordered fold per page.

    Entries are matches, and unmatched predictions that overlap a matched truth.
    """
    couples = F.flatten(
        F.transform(
            _solid("preds"),
            lambda p: F.transform(
                _solid("truths"),
                lambda t: F.struct(
                    (-iou(_box_of(p), _box_of(t))).alias("worse"), p["p"].alias("p"), t["a"].alias("a")
                ),
            ),
        )
    )
    close = F.filter(couples, lambda c: c["worse"] <= -at_least)
    ranked = pages.withColumn("todo", F.sort_array(close))
    entry = ranked.schema["todo"].dataType.simpleString()

    def take(done: Column, pair: Column) -> Column:
        used = F.exists(done, lambda m: (m["p"] == pair["p"]) | (m["a"] == pair["a"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(pair)))

    # a lone qualifying pair needs no fold and leaves no duplicate
    lone = F.size("todo") <= 1
    folded = F.when(lone, F.col("todo")).otherwise(F.aggregate("todo", F.array().cast(entry), take))

    def again(pair: Column) -> Column:
        own = F.exists("m", lambda m: m["p"] == pair["p"])
        return ~own & F.exists("m", lambda m: m["a"] == pair["a"])

    extra = F.when(
        F.size("todo") > F.size("m"),
        F.array_distinct(F.transform(F.filter("todo", again), lambda t: t["p"])),
    )
    matched = ranked.withColumn("m", folded)
    rows = F.concat(
        F.transform(
            "m",
            lambda m: F.struct(
                m["p"].alias("p"), m["a"].alias("a"), (-m["worse"]).alias("iou"), F.lit(False).alias("duplicate")
            ),
        ),
        F.transform(
            F.coalesce(extra, F.slice(F.transform("m", lambda m: m["p"]), 1, 0)),
            lambda p: F.struct(
                p.alias("p"),
                F.lit(None).cast(a_type).alias("a"),
                F.lit(None).cast("double").alias("iou"),
                F.lit(True).alias("duplicate"),
            ),
        ),
    )
    return matched.withColumn("pairs", rows).drop("todo", "m")


def _a_type(truth: DataFrame) -> str:
    return truth.schema["a"].dataType.simpleString()


def paired_boxes(
    pred: DataFrame, truth: DataFrame, at_least: float = MATCH_IOU, given: bool = False
) -> DataFrame:
    """Predictions of pages with few boxes, side by side with what they matched: ``page, pred, pair, truth``.

    The three are structs; ``pair`` is as in ``pairing`` and null without a
    partner, and so is ``truth``.  With ``given`` all boxes of a page belong together.
    """
    pages = gathered(pred, truth)
    if given:
        one, no = F.lit(1.0), F.lit(False)
        together = F.transform(
            "preds",
            lambda p: F.transform(
                "truths",
                lambda t: F.struct(p["p"].alias("p"), t["a"].alias("a"), one.alias("iou"), no.alias("duplicate")),
            ),
        )
        pages = pages.withColumn("pairs", F.flatten(together))
    else:
        pages = _folded(pages, _a_type(truth), at_least)
    no_pair = F.lit(None).cast(pages.schema["pairs"].dataType.elementType)
    no_truth = F.lit(None).cast(pages.schema["truths"].dataType.elementType)

    def row(p: Column, pair: Column, t: Column) -> Column:
        return F.struct(p.alias("pred"), pair.alias("pair"), t.alias("truth"))

    def of_pair(p: Column, pair: Column) -> Column:
        known = F.transform(F.filter("truths", lambda t: t["a"] == pair["a"]), lambda t: row(p, pair, t))
        return F.when(F.size(known) > 0, known).otherwise(F.array(row(p, pair, no_truth)))

    def of_pred(p: Column) -> Column:
        own = F.flatten(F.transform(F.filter("pairs", lambda m: m["p"] == p["p"]), lambda m: of_pair(p, m)))
        return F.when(F.exists("pairs", lambda m: m["p"] == p["p"]), own).otherwise(
            F.array(row(p, no_pair, no_truth))
        )

    return pages.select("page", F.inline(F.flatten(F.transform("preds", of_pred))))


def _fold_pages(pred: DataFrame, truth: DataFrame, at_least: float) -> DataFrame:
    """Greedy matching of pages with few boxes."""
    pages = gathered(pred.select("page", "p", *_EDGES), truth.select("page", "a", *_EDGES))
    return _folded(pages, _a_type(truth), at_least).select("page", F.inline("pairs"))


def split_pages(
    pred: DataFrame, truth: DataFrame, large: DataFrame
) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Predictions and truths of all other pages, and of the ``large`` ones."""
    small, big = (tuple(df.join(large, "page", how) for df in (pred, truth)) for how in ("left_anti", "left_semi"))
    return small, big


def pairing(
    pred: DataFrame, truth: DataFrame, at_least: float = MATCH_IOU, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Matches, and duplicates as rows without a truth: ``page, p, a, iou, duplicate``.

    Pages with up to ``fold_limit`` boxes are matched by a fold inside one row;
    larger pages go through ``greedy_match_rounds``, which gives the same result
    without gathering a page.
    """
    large = large_pages(pred.select("page").unionByName(truth.select("page")), fold_limit)
    if large is None:
        return _fold_pages(pred, truth, at_least)
    (few_pred, few_truth), (big_pred, big_truth) = split_pages(pred, truth, large)
    small = _fold_pages(few_pred, few_truth, at_least)
    match = cut(greedy_match_rounds(big_pred, big_truth, at_least, fold_limit=0))
    again = duplicates(big_pred, big_truth, match, at_least).select("page", "p", F.lit(True).alias("duplicate"))
    return (
        small.unionByName(match.withColumn("duplicate", F.lit(False)))
        .unionByName(again, allowMissingColumns=True)
    )


def greedy_match(
    pred: DataFrame, truth: DataFrame, at_least: float = MATCH_IOU, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """One-to-one matches by falling IoU, then prediction, then truth index."""
    paired = pairing(pred, truth, at_least, fold_limit)
    return paired.where(~F.col("duplicate")).select("page", "p", "a", "iou")


def _members(df: DataFrame, index: str, copied: DataFrame) -> DataFrame:
    """Boxes of the copied classes with their rank among the copies, from 0."""
    inside = df.select("page", F.struct(*_EDGES).alias("cls"), F.col(index).alias("ix")).join(
        copied, ["page", "cls"], "left_semi"
    )
    ranked = row_numbers(inside, ["page", "cls"], [F.col("ix")], "rank")
    return cut(ranked.withColumn("rank", F.col("rank") - 1))


def _classes(entries: str, index: str) -> Column:
    """The distinct boxes of a gathered side, each with the sorted indexes of its copies."""
    solid = _solid(entries)

    def edges(e: Column) -> Column:
        return F.struct(*(e[c].alias(c) for c in _EDGES))

    def members(cls: Column) -> Column:
        return F.sort_array(F.transform(F.filter(solid, lambda e: edges(e) == cls), lambda e: e[index]))

    return F.transform(
        F.array_distinct(F.transform(solid, edges)), lambda c: F.struct(c.alias("cls"), members(c).alias("members"))
    )


def _close_classes(pred: DataFrame, truth: DataFrame, at_least: float) -> DataFrame:
    """Pairs of distinct boxes of pages with few boxes, with the indexes of their copies.

    A pair whose boxes have no other partner is settled at once: its copies are
    matched in index order, one row each, with ``lone`` set.
    """
    pages = gathered(pred.select("page", "p", *_EDGES), truth.select("page", "a", *_EDGES))
    split = pages.select("page", _classes("preds", "p").alias("ps"), _classes("truths", "a").alias("ts"))
    couples = F.transform(
        "ps",
        lambda p: F.transform(
            "ts",
            lambda t: F.struct(
                p["cls"].alias("pc"), t["cls"].alias("tc"), iou(_box_of(p["cls"]), _box_of(t["cls"])).alias("iou"),
                p["members"].alias("p_all"), t["members"].alias("t_all"),
            ),
        ),
    )
    close = F.filter(F.flatten(couples), lambda c: c["iou"] >= at_least)
    pairs = split.select("page", F.inline(close))
    # pages are whole in their tasks, so these windows need no shuffle
    by_p, by_t = Window.partitionBy("page", "pc"), Window.partitionBy("page", "tc")
    counted = pairs.withColumn("lone", (F.count("*").over(by_p) == 1)).withColumn(
        "lone", F.col("lone") & (F.count("*").over(by_t) == 1)
    )
    both = F.least(F.size("p_all"), F.size("t_all"))
    # a single step takes the heads, which are indexes that are not null where there are any
    in_order = F.col("lone") & (both > 1)
    copies = F.arrays_zip(
        F.when(in_order, F.slice("p_all", 1, both)).otherwise(F.array(F.array_min("p_all"))).alias("p"),
        F.when(in_order, F.slice("t_all", 1, both)).otherwise(F.array(F.array_min("t_all"))).alias("a"),
    )
    open_ = ~F.col("lone")
    return counted.select(
        "page", "iou", "lone", *(F.when(open_, F.col(c)).alias(c) for c in ("pc", "tc", "p_all", "t_all")), F.inline(copies)
    )


def _copied(open_pairs: DataFrame, cls: str, members: str) -> DataFrame:
    """The copies in ``members`` of each class that has several, with their rank from 0."""
    several = open_pairs.where(F.size(members) > 1).select("page", F.col(cls).alias("cls"), F.col(members).alias("ix"))
    return cut(several.distinct().select("page", "cls", F.posexplode("ix").alias("rank", "ix")))


def greedy_match_rounds(
    pred: DataFrame, truth: DataFrame, at_least: float = MATCH_IOU, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """The greedy matches of pages of any size, found in rounds.

    A round takes every pair of distinct boxes that are each other's best
    remaining choice and matches their copies in index order, as many at once
    as no equally good third box could claim.  Copies leave a class in index
    order, so a class needs only a cursor and the index it points at.

    Boxes of pages with up to ``fold_limit`` of them are gathered to find the
    pairs; pairs that nothing contends for are matched there, and the rest go
    to the rounds.  On larger pages a grid join finds the pairs.
    """
    fresh = [F.lit(0).cast("bigint").alias("p_at"), F.lit(0).cast("bigint").alias("t_at")]
    large = None if fold_limit == 0 else large_pages(pred.select("page").unionByName(truth.select("page")), fold_limit)
    few, big = ((pred, truth), None) if large is None else split_pages(pred, truth, large)
    if fold_limit == 0:
        few, big = None, (pred, truth)
    parts, found = [], []
    if few is not None:
        close = cut(_close_classes(*few, at_least))
        found.append(close.where("lone").select("page", "p", "a", "iou"))
        open_pairs = close.where(~F.col("lone"))
        live = open_pairs.select(
            "page", "pc", "tc", "iou", F.size("p_all").cast("bigint").alias("n_pred"), F.size("t_all").cast("bigint").alias("n_truth"),
            *fresh, F.col("p").alias("p_head"), F.col("a").alias("t_head"),
        )
        parts.append((live, _copied(open_pairs, "pc", "p_all"), _copied(open_pairs, "tc", "t_all")))
    if big is not None:
        live = cut(
            box_pairs(*big, at_least).select(
                "page",
                F.struct(*(F.col("p" + e).alias(e) for e in _EDGES)).alias("pc"),
                F.struct(*(F.col("t" + e).alias(e) for e in _EDGES)).alias("tc"),
                "iou",
                "n_pred",
                "n_truth",
                *fresh,
                F.col("first_p").alias("p_head"),
                F.col("first_a").alias("t_head"),
            )
        )
        # classes without copies need no member table: their head is the box itself
        p_copied = live.where(F.col("n_pred") > 1).select("page", F.col("pc").alias("cls"))
        t_copied = live.where(F.col("n_truth") > 1).select("page", F.col("tc").alias("cls"))
        parts.append((live, _members(big[0], "p", p_copied), _members(big[1], "a", t_copied)))
    live, pm, tm = (reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))
    runs = []
    while not live.isEmpty():
        stars = _stars(live)
        if not stars.isEmpty():
            shared = cut(_match_stars(stars, pm, tm))
            found.append(shared.select("page", "p", "a", "iou"))
            p_done = shared.groupBy("page", "pc").agg(F.count("*").alias("k"))
            t_done = shared.groupBy("page", "tc").agg(F.count("*").alias("k"))
            live = cut(_advance(live, p_done, t_done, pm, tm))
            continue
        run = _mutual_runs(live, pm, tm)
        runs.append(run)
        # a class is in at most one run per round
        live = cut(_advance(live, run.select("page", "pc", "k"), run.select("page", "tc", "k"), pm, tm))
    if runs:
        found.append(_expand_runs(reduce(DataFrame.unionByName, runs), pm, tm))
    if not found:
        return live.select("page", F.col("p_head").alias("p"), F.col("t_head").alias("a"), "iou")
    return reduce(DataFrame.unionByName, found)


def _stars(live: DataFrame) -> DataFrame:
    """Pairs of true boxes whose equally good predictions all want nothing else.

    The copies of such predictions may take turns in index order, which rounds
    of single heads would follow one by one.
    """
    by_p, by_t = Window.partitionBy("page", "pc"), Window.partitionBy("page", "tc")
    marked = (
        live.withColumn("p_best", F.max("iou").over(by_p))
        .withColumn("p_ties", F.count_if(F.col("iou") == F.col("p_best")).over(by_p))
        .withColumn("t_best", F.max("iou").over(by_t))
    )
    tied = F.col("iou") == F.col("t_best")
    loyal = tied & (F.col("iou") == F.col("p_best")) & (F.col("p_ties") == 1)
    counted = marked.withColumn("ties", F.count_if(tied).over(by_t)).withColumn(
        "loyal", F.count_if(loyal).over(by_t)
    )
    chosen = counted.where(tied & (F.col("ties") > 1) & (F.col("loyal") == F.col("ties")))
    return cut(chosen.select(*live.columns))


def _match_stars(stars: DataFrame, pm: DataFrame, tm: DataFrame) -> DataFrame:
    """Line up the copies of all predictions of a star and give out its truths in order."""
    kept = ["page", "pc", "tc", "iou", "t_at", "n_truth", "t_head"]
    single = stars.where(F.col("n_pred") == 1).select(*kept, F.col("p_head").alias("p"))
    several = (
        stars.join(pm.withColumnRenamed("cls", "pc"), ["page", "pc"])
        .where(F.col("rank") >= F.col("p_at"))
        .select(*kept, F.col("ix").alias("p"))
    )
    lined = row_numbers(single.unionByName(several), ["page", "tc"], [F.col("p")], "u")
    served = lined.where(F.col("u") <= F.col("n_truth") - F.col("t_at")).withColumn(
        "rank", F.col("t_at") + F.col("u") - 1
    )
    truths = tm.select("page", F.col("cls").alias("tc"), "rank", "ix")
    named = served.join(truths, ["page", "tc", "rank"], "left")
    return named.select("page", "pc", "tc", "iou", "p", F.coalesce("ix", "t_head").alias("a"))


def _mutual_runs(live: DataFrame, pm: DataFrame, tm: DataFrame) -> DataFrame:
    """Runs of matches: classes, start ranks, heads and length.

    The windows hold the partners of one distinct box, whose number depends on
    pixel resolution and not on the number of rows.
    """
    by_p, by_t = Window.partitionBy("page", "pc"), Window.partitionBy("page", "tc")
    good_p, good_t = F.col("iou") == F.col("p_best"), F.col("iou") == F.col("t_best")
    # among equally good partners the smallest head goes first, and may go on
    # until the next smallest head is due; in structs, a head that is null is the smallest
    t_head, p_head = F.struct("t_head"), F.struct("p_head")
    t_seen = (
        live.withColumn("p_best", F.max("iou").over(by_p))
        .withColumn("t_first", F.min(F.when(good_p, t_head)).over(by_p))
        .withColumn(
            "t_stop",
            F.min(F.when(good_p & (t_head > F.col("t_first")), t_head)).over(by_p),
        )
    )
    both_seen = (
        t_seen.withColumn("t_best", F.max("iou").over(by_t))
        .withColumn("p_first", F.min(F.when(good_t, p_head)).over(by_t))
        .withColumn(
            "p_stop",
            F.min(F.when(good_t & (p_head > F.col("p_first")), p_head)).over(by_t),
        )
    )
    heads = (t_head == F.col("t_first")) & (p_head == F.col("p_first"))
    room = F.least(F.col("n_pred") - F.col("p_at"), F.col("n_truth") - F.col("t_at"))
    mutual = cut(
        both_seen.where(good_p & good_t & heads)
        .withColumn("k", room)
        .drop("p_best", "t_best", "p_first", "t_first")
    )
    contested = (F.col("k") > 1) & (F.col("p_stop").isNotNull() | F.col("t_stop").isNotNull())
    kept = [c for c in mutual.columns if c not in ("p_stop", "t_stop")]
    if mutual.where(contested).isEmpty():
        return mutual.select(*kept)
    p_room = _room(mutual.where(contested), pm, "pc", "p_at", "p_stop", "p_room")
    t_room = _room(mutual.where(contested), tm, "tc", "t_at", "t_stop", "t_room")
    sized = mutual.join(p_room, ["page", "pc"], "left").join(t_room, ["page", "tc"], "left")
    return cut(sized.withColumn("k", F.least("k", "p_room", "t_room")).select(*kept))


def _room(
    mutual: DataFrame, members: DataFrame, cls: str, at: str, stop: str, name: str
) -> DataFrame:
    """Copies from the cursor on whose index is below the rival's head.

    A class without copies has no members here and no row in the result; its
    single box is the head, so the run length is one anyway.
    """
    tied = mutual.where(F.col(stop).isNotNull()).select("page", cls, at, stop)
    inside = tied.join(members.withColumnRenamed("cls", cls), ["page", cls]).where(
        (F.col("rank") >= F.col(at)) & (F.struct(F.col("ix")) < F.col(stop))
    )
    return inside.groupBy("page", cls).agg(F.count("*").alias(name))


def _advance(
    live: DataFrame, p_done: DataFrame, t_done: DataFrame, pm: DataFrame, tm: DataFrame
) -> DataFrame:
    """Move the cursors past this round's ``k`` matches and drop exhausted classes."""
    joined = live.join(p_done.withColumnRenamed("k", "p_k"), ["page", "pc"], "left").join(
        t_done.withColumnRenamed("k", "t_k"), ["page", "tc"], "left"
    )
    for side in ("p", "t"):
        joined = joined.withColumn(side + "_at", F.col(side + "_at") + F.coalesce(side + "_k", F.lit(0)))
    left = (F.col("p_at") < F.col("n_pred")) & (F.col("t_at") < F.col("n_truth"))
    rest = joined.where(left)
    # only classes with copies can have moved and still be here
    for side, cls, members in (("p", "pc", pm), ("t", "tc", tm)):
        heads = members.select(
            "page", F.col("cls").alias(cls), F.col("rank").alias(side + "_at"), F.col("ix").alias(side + "_new")
        )
        rest = rest.join(heads, ["page", cls, side + "_at"], "left").withColumn(
            side + "_head", F.coalesce(side + "_new", side + "_head")
        )
    return rest.select(*live.columns)


def _expand_runs(runs: DataFrame, pm: DataFrame, tm: DataFrame) -> DataFrame:
    """Class runs back to member pairs: heads for single steps, else by rank."""
    plain = runs.where(F.col("k") == 1).select(
        "page", F.col("p_head").alias("p"), F.col("t_head").alias("a"), "iou"
    )
    long_runs = runs.where(F.col("k") > 1).select("page", "pc", "tc", "iou", "p_at", "t_at", "k")
    p_rows = (
        pm.withColumnRenamed("cls", "pc")
        .join(long_runs, ["page", "pc"])
        .where((F.col("rank") >= F.col("p_at")) & (F.col("rank") < F.col("p_at") + F.col("k")))
        .select(
            "page",
            F.col("tc").alias("cls"),
            (F.col("t_at") + F.col("rank") - F.col("p_at")).alias("rank"),
            "iou",
            F.col("ix").alias("p"),
        )
    )
    copies = p_rows.join(tm, ["page", "cls", "rank"]).select("page", "p", F.col("ix").alias("a"), "iou")
    return plain.unionByName(copies)


def missed(truth: DataFrame, match: DataFrame) -> DataFrame:
    return truth.join(match.select("page", "a"), ["page", "a"], "left_anti")


def false_positives(pred: DataFrame, match: DataFrame) -> DataFrame:
    return pred.join(match.select("page", "p"), ["page", "p"], "left_anti")


def duplicates(
    pred: DataFrame, truth: DataFrame, match: DataFrame, at_least: float = MATCH_IOU
) -> DataFrame:
    """Unmatched predictions that overlap an already matched truth."""
    taken = truth.join(match.select("page", "a"), ["page", "a"], "left_semi")
    unmatched = false_positives(pred, match)
    again = box_pairs(unmatched, taken, at_least).select(
        "page", *(F.col("p" + e).alias(e) for e in _EDGES)
    )
    return unmatched.join(again, ["page", *_EDGES], "left_semi")


def nearest_truth(pred: DataFrame, truth: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Best truth per prediction by IoU, then smallest index; IoU may be zero.

    Boxes of pages with up to ``fold_limit`` of them are gathered and compared
    there; larger pages are searched by joins.
    """
    large = large_pages(pred.select("page").unionByName(truth.select("page")), fold_limit)
    if large is None:
        return _nearest_gathered(pred, truth)
    few, big = split_pages(pred, truth, large)
    return _nearest_gathered(*few).unionByName(_nearest_joined(*big))


def _nearest_gathered(pred: DataFrame, truth: DataFrame) -> DataFrame:
    pages = gathered(pred.select("page", "p", *_EDGES), truth.select("page", "a", *_EDGES))
    classes = pages.select("page", "preds", "truths", _classes("truths", "a").alias("ts")).where(F.size("truths") > 0)

    def answer(p: Column) -> Column:
        # an index that is null counts only where a box has no other
        rated = F.transform(
            "ts",
            lambda t: F.struct(
                (-iou(_box_of(p), _box_of(t["cls"]))).alias("worse"), F.array_min(t["members"]).alias("a")
            ),
        )
        return F.array_min(F.filter(rated, lambda r: r["worse"] < 0))

    first = F.array_min(F.transform("truths", lambda t: t["a"]))
    whole = F.filter("preds", lambda p: reduce(lambda a, b: a & b, (p[e].isNotNull() for e in _EDGES)))
    found = classes.select("page", first.alias("first"), F.inline(F.transform(whole, lambda p: F.struct(p.alias("box"), answer(p).alias("b")))))
    near = F.col("b").isNotNull()
    return found.select(
        "page", *(F.col("box")[e].alias(e) for e in _EDGES), "box.p",
        F.when(near, F.col("b.a")).otherwise(F.col("first")).alias("a"),
        F.when(near, -F.col("b.worse")).otherwise(0.0).alias("iou"),
    )


def _nearest_joined(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Close partners are looked for first, and only predictions without one go
    on to the wider and costlier search."""
    first_a = truth.groupBy("page").agg(F.min("a").alias("a"))
    todo, answers = distinct_boxes(pred, "p").select("page", *_EDGES), []
    for at_least in (MATCH_IOU, 0.5, 0.0):
        todo = cut(todo)
        pairs = box_pairs(todo.withColumn("p", F.lit(0)), truth, at_least)
        hit = pairs.groupBy("page", *(F.col("p" + e).alias(e) for e in _EDGES)).agg(
            F.min(F.struct((-F.col("iou")).alias("worse"), F.col("first_a").alias("a"))).alias("b")
        )
        hit = cut(hit.select("page", *_EDGES, F.col("b.a").alias("a"), (-F.col("b.worse")).alias("iou")))
        answers.append(hit)
        todo = todo.join(hit, ["page", *_EDGES], "left_anti")
    apart = todo.join(first_a, "page").select("page", *_EDGES, "a", F.lit(0.0).alias("iou"))
    best = reduce(DataFrame.unionByName, [*answers, apart])
    return pred.select("page", "p", *_EDGES).join(best, ["page", *_EDGES])


def single_or_abstain(pred: DataFrame, inputs: DataFrame) -> DataFrame:
    """The prediction of inputs that have exactly one; otherwise no board."""
    counted = pred.groupBy("page").agg(F.count("*").alias("n"), F.min("p").alias("only"))
    alone = F.coalesce(F.col("n"), F.lit(0)) == 1
    return inputs.join(counted, "page", "left").select(
        "page",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_predictions"),
        F.when(alone, F.lit("done")).otherwise(F.lit("no-board")).alias("phase"),
        F.when(alone, F.col("only")).alias("p"),
    )

