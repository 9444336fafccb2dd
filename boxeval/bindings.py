"""Views that turn the driver tables into operator inputs.

Each one is a projection of a whole table.  Indexes within a page are sortable
strings made from the row's own key, so no page has to be sorted to number it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.operators.integrity import content_hash
from boxeval.operators.ordered import running
from boxeval.operators.policy import detect_licence

PAGE_SIDE = 800.0
#: About as many images become pixels in one task.
IMAGES_IN_TASK = 256
# fixed values: three allowed origins and the licence policy
ALLOWED_ORIGINS = [
    "https://blog.tionsh.example.net",
    "https://blog.tionsh.example.com",
    "https://m.tionsh.example.net",
]
ALLOWED_LICENCES = [
    "MIT",
    "ISC",
    "BSD-2-Clause",
    "BSD-3-Clause",
    "Apache-2.0",
    "0BSD",
    "Unlicense",
    "CC0-1.0",
    "BlueOak-1.0.0",
    "MPL-2.0",
    "Python-2.0",
    "CC-BY-4.0",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_id() -> Column:
    def padded(name: str, width: int) -> Column:
        return F.lpad(F.col(name).cast("bigint").cast("string"), width, "0")

    return F.concat(
        padded("l_linenumber", 2),
        padded("l_partkey", 12),
        padded("l_suppkey", 12),
        padded("l_quantity", 2),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("line_id", _line_id())


def _truth_boxes(df: DataFrame) -> DataFrame:
    side = F.lit(80) + F.lit(8) * F.col("l_linenumber")
    return (
        df.withColumn("x0", (F.pmod("l_partkey", F.lit(5)) * 150).cast("double"))
        .withColumn("y0", (F.pmod("l_suppkey", F.lit(5)) * 150).cast("double"))
        .withColumn("x1", F.col("x0") + side)
        .withColumn("y1", F.col("y0") + side)
    )


def truths(spark: SparkSession, sf_dir: str, *extra: str, of: DataFrame | None = None) -> DataFrame:
    """B1 true boxes: ``page, a, x0..y1`` and any further columns asked for, of all lines or those in ``of``."""
    placed = _truth_boxes(lines(spark, sf_dir) if of is None else of).where(F.col("l_linenumber") <= 4)
    return placed.select(
        F.col("l_orderkey").alias("page"), F.col("line_id").alias("a"), "x0", "y0", "x1", "y1", *extra
    )


def predictions(spark: SparkSession, sf_dir: str, *extra: str, of: DataFrame | None = None) -> DataFrame:
    """B1 predicted boxes: shifted truths, some lost, some given twice."""
    quantity = F.col("l_quantity").cast("bigint")
    lost = (F.col("l_returnflag") == "N") & (F.col("l_quantity") > 40)
    twice = (F.col("l_returnflag") == "A") & (F.col("l_quantity") <= 15)
    shift = F.struct(F.lit(0).alias("k"), (quantity % 5).alias("dx"), (quantity % 3).alias("dy"))
    again = F.struct(F.lit(1).alias("k"), (quantity % 3).alias("dx"), F.lit(0).cast("bigint").alias("dy"))
    found = F.when(lost, F.array().cast("array<struct<k:int,dx:bigint,dy:bigint>>"))
    found = found.when(twice, F.array(shift, again)).otherwise(F.array(shift))
    moved = _truth_boxes(lines(spark, sf_dir) if of is None else of).withColumn("m", F.explode(found))
    return moved.select(
        F.col("l_orderkey").alias("page"),
        F.concat("line_id", F.lit("-"), F.col("m.k").cast("string")).alias("p"),
        (F.col("x0") + F.col("m.dx")).alias("x0"),
        (F.col("y0") + F.col("m.dy")).alias("y0"),
        (F.col("x1") + F.col("m.dx")).alias("x1"),
        (F.col("y1") + F.col("m.dy")).alias("y1"),
        *extra,
    )


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one 64-cell board and confidence vector per embedding."""
    glyphs = F.transform(
        F.col("embedding"),
        lambda v: F.when(v.cast("double") > 0.1, F.lit("P"))
        .when(v.cast("double") < -0.1, F.lit("p"))
        .otherwise(F.lit(".")),
    )
    trust = F.transform(
        F.col("embedding"), lambda v: F.least(F.lit(1.0), F.lit(0.5) + F.abs(v.cast("double")))
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.array_join(glyphs, "").alias("cells"),
        trust.alias("confidences"),
    )


def labelled_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 with the truth board of each label: the one of its smallest id."""
    b = boards(spark, sf_dir)
    proto = b.groupBy("label").agg(F.min_by("cells", "vec_id").alias("truth_cells"))
    return b.join(proto, "label")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: one recogniser run per event; sessions are user days."""
    k = F.get_json_object("props", "$.k")
    phase = (
        F.when(F.col("event_type") == "view", F.lit("no-board"))
        .when(F.col("event_type") == "error", F.lit("error"))
        .otherwise(F.lit("done"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.pmod("user_id", F.lit(3)).cast("bigint").alias("engine"),
        F.col("event_type"),
        k.alias("k"),
        F.pmod(k.cast("bigint"), F.lit(5)).alias("style"),
        phase.alias("phase"),
        F.col("value").alias("ms"),
        F.col("props"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured input per order line, with the counts a summary adds up."""
    oracle = F.col("l_returnflag") == "A"
    quantity = F.col("l_quantity").cast("bigint")
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")

    def pick(cond: Column, value: Column) -> Column:
        return F.when(cond, value).otherwise(zero)

    stage = F.when(oracle, F.lit("classifier")).otherwise(
        F.when(F.col("l_returnflag") == "R", F.lit("manual")).otherwise(F.lit("full-page"))
    )
    expected = (
        F.when(oracle, one).when(F.col("l_tax") > 0.07, zero).otherwise(one + pick(quantity > 25, one))
    )
    base = lines(spark, sf_dir).select(
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, F.lit("control"))
        .otherwise(F.lit("candidate"))
        .alias("candidate"),
        F.col("l_orderkey").alias("page"),
        F.col("line_id").alias("input_id"),
        stage.alias("stage"),
        F.concat(F.lit("style-"), F.pmod("l_partkey", F.lit(5)).cast("string")).alias("style"),
        F.when(F.col("l_linestatus") == "O", F.lit("development"))
        .otherwise(F.lit("held-out"))
        .alias("split"),
        F.array(
            F.concat(F.lit("flag-"), F.col("l_returnflag")),
            F.concat(F.lit("size-"), (quantity % 4).cast("string")),
        ).alias("tags"),
        F.col("l_linenumber").cast("bigint").alias("repetition"),
        (F.col("l_linenumber") == 1).alias("cold"),
        F.col("l_extendedprice").alias("ms"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("init_ms"),
        oracle.alias("oracle"),
        expected.alias("expected_boards"),
        F.when(oracle, one).otherwise(quantity % 3).alias("predictions"),
        quantity.alias("q"),
        F.col("l_discount").alias("d"),
        F.col("l_tax").alias("t"),
    )
    both = F.least("expected_boards", "predictions")
    hits = F.when(F.col("d") < 0.05, both).otherwise(F.greatest(both - 1, zero))
    scored = (
        base.withColumn("matched", F.when(~oracle_col(), hits))
        .withColumn("missed", F.col("expected_boards") - F.col("matched"))
        .withColumn("false_positive", F.col("predictions") - F.col("matched"))
        .withColumn("duplicate", F.when(F.col("false_positive") > 1, one).when(~oracle_col(), zero))
        .withColumn("aligned", F.when(~oracle_col(), pick(F.col("t") < 0.05, F.col("matched"))))
        .withColumn(
            "exact",
            F.when(oracle_col(), pick(F.col("d") < 0.05, one)).otherwise(
                pick(F.col("t") < 0.03, F.col("matched"))
            ),
        )
        .withColumn(
            "correct_squares",
            F.col("exact") * 64 + (F.coalesce("matched", one) - F.col("exact")) * F.col("q"),
        )
        .withColumn("expected_squares", F.col("expected_boards") * 64)
        .withColumn("reliable", pick(F.col("t") < 0.06, F.col("predictions")))
        .withColumn("reliable_exact", F.least("reliable", "exact"))
        .withColumn("reliable_wrong", F.col("reliable") - F.col("reliable_exact"))
        .withColumn(
            "identifiable",
            F.col("expected_boards") - pick((F.col("q") > 40) & (F.col("expected_boards") > 0), one),
        )
        .withColumn("correct_orientations", F.least("identifiable", "exact"))
        .withColumn("ambiguous_truth", F.col("expected_boards") - F.col("identifiable"))
        .withColumn("ambiguous_predictions", pick(F.col("q") % 2 == 0, F.col("predictions")))
        .withColumn("ambiguity_acknowledged", F.least("ambiguous_truth", "ambiguous_predictions"))
        .withColumn(
            "reliable_wrong_study",
            F.least(
                F.col("reliable"),
                F.col("reliable_wrong")
                + F.greatest(F.col("reliable_exact") - F.col("correct_orientations"), zero),
            ),
        )
        .withColumn("out_of_image", pick(F.col("repetition") == 7, F.col("predictions")))
    )
    return scored.drop("q", "d", "t")


def oracle_col() -> Column:
    return F.col("oracle")


def couples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 predictions next to the true box of the same line: ``t*`` and ``p*`` edges."""
    moved = predictions(spark, sf_dir, "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax")
    pred = moved.select(
        "page", "p", *(F.col(e).alias("p" + e) for e in ("x0", "y0", "x1", "y1")),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_tax",
    )
    both = _truth_boxes(pred)
    return both.select(
        "page", "p", "px0", "py0", "px1", "py1",
        *(F.col(e).alias("t" + e) for e in ("x0", "y0", "x1", "y1")),
        "l_linenumber", "l_quantity", "l_tax",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored square windows, one per order line: ``page, seq, x, y, side, score``."""
    return lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"),
        F.col("line_id").alias("seq"),
        (F.pmod("l_partkey", F.lit(3)) * 6 + F.pmod("l_suppkey", F.lit(2)) * 150).cast("double").alias("x"),
        (F.pmod("l_suppkey", F.lit(3)) * 6).cast("double").alias("y"),
        (F.lit(80) + F.pmod("l_partkey", F.lit(4)) * 4).cast("double").alias("side"),
        (F.lit(1.0) + F.col("l_quantity") / 50).alias("score"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: messages of request lifecycles, keyed by user.

    ``latest`` is the newest request of the key at that moment; answers with a
    high ``k`` speak of the request before it and so arrive late.  ``detail``
    says which phase began, and whether a result has a board.
    """
    kind = (
        F.when(F.col("event_type") == "signup", F.lit("request"))
        .when(F.col("event_type") == "view", F.lit("phase"))
        .when(F.col("event_type") == "purchase", F.lit("result"))
        .when(F.col("event_type") == "error", F.lit("error"))
        .otherwise(F.lit("cancel"))
    )
    events = runs(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("key"), "ts", "ms", kind.alias("kind"), F.col("k").cast("bigint").alias("k")
    )
    opened = F.when(F.col("kind") == "request", F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counted = running(events, ["key"], [F.col("ts"), F.col("event_id")], opened, "latest")
    about = F.when((F.col("kind") == "request") | (F.col("k") < 50), F.col("latest")).otherwise(
        F.greatest(F.col("latest") - 1, F.lit(1))
    )
    odd = F.pmod("k", F.lit(2)) == 1
    detail = F.when(F.col("kind") == "phase", F.when(odd, F.lit("loading-model")).otherwise(F.lit("recognizing")))
    detail = detail.when(F.col("kind") == "result", F.when(odd, F.lit("no-board")).otherwise(F.lit("board")))
    return counted.where(F.col("latest") > 0).select(
        "event_id", "key", "ts", F.unix_micros("ts").alias("us"), "ms", "latest", about.alias("request_id"), "kind", detail.alias("detail")
    )


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, truths and inputs of B1 with the boards of B2 on them."""
    b = labelled_boards(spark, sf_dir).select(
        F.col("vec_id").alias("l_suppkey"), "cells", "truth_cells", F.array_min("confidences").alias("floor")
    )
    # lines meet the boards before ids and boxes are made of them, while they are short
    known = table(spark, sf_dir, "lineitem").join(b, "l_suppkey").withColumn("line_id", _line_id())
    truth = truths(spark, sf_dir, "l_returnflag", "cells", of=known)
    facing = (
        F.when(F.col("l_returnflag") == "A", F.lit("white"))
        .when(F.col("l_returnflag") == "R", F.lit("black"))
        .otherwise(F.lit("ambiguous"))
    )
    edges = ["x0", "y0", "x1", "y1"]
    truth = truth.select("page", "a", *edges, "cells", facing.alias("orientation"))
    pred = predictions(
        spark, sf_dir, "l_linestatus", "l_discount", "l_tax", "cells", "truth_cells", "floor", of=known
    )
    read = (
        F.when(F.col("l_discount") < 0.05, F.col("cells"))
        .when(F.col("l_discount") < 0.08, F.col("truth_cells"))
        .otherwise(F.reverse("cells"))
    )
    pred = pred.select(
        "page",
        "p",
        *edges,
        read.alias("cells"),
        F.least(F.lit(1.0), F.col("floor") + F.col("l_discount") * 4).alias("min_conf"),
        F.when(F.col("l_linestatus") == "O", F.lit("white")).otherwise(F.lit("black")).alias("orientation"),
        (F.col("l_tax") > 0.06).alias("orientation_ambiguous"),
    )
    return pred, truth, pages(spark, sf_dir)


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page`` of each box of B1, judged or not."""
    return predictions(spark, sf_dir).select("page").unionByName(truths(spark, sf_dir).select("page"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured inputs: one page per order, 700 px wide and high."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page"),
        F.lit(700.0).alias("width"),
        F.lit(700.0).alias("height"),
        F.lit(False).alias("oracle"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell edits: one per event, on the board numbered like its user."""
    value = (
        F.when(F.col("event_type") == "view", F.lit("."))
        .when(F.col("event_type") == "error", F.lit("k"))
        .when(F.col("event_type") == "click", F.lit("Q"))
        .otherwise(F.lit("P"))
    )
    return runs(spark, sf_dir).select(
        F.col("user_id").alias("vec_id"),
        F.pmod(F.col("k").cast("bigint"), F.lit(64)).cast("int").alias("square"),
        value.alias("value"),
        "ts",
        F.col("event_id").alias("edit_id"),
    )


EXPECTED_BOARD = "4k3/8/8/8/8/8/8/4K3"
EMPTY_BOARD = "8/8/8/8/8/8/8/8"
# adjacent digits: a board for the loose parser only
LOOSE_BOARD = "44/8/8/8/8/8/8/8"


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 as raw protocol strings, some of them missing or malformed."""
    base = runs(spark, sf_dir)
    k = F.col("k").cast("bigint")
    null = F.lit(None).cast("string")
    hour = F.hour("ts")
    board = (
        F.when(k < 40, F.lit(EXPECTED_BOARD)).when(k < 70, F.lit(EMPTY_BOARD)).when(k < 80, F.lit(LOOSE_BOARD))
    )
    seen = F.col("event_type") == "view"
    trusted = F.when(F.col("ms") > 10, F.lit("true")).when(F.col("ms") > 2, F.lit("false")).otherwise(F.lit("maybe"))
    cents = F.floor(F.col("ms") * 100).cast("bigint").cast("string")
    total = (
        F.when(k % 7 == 0, F.lit(""))
        .when(k % 11 == 0, F.lit("NaN"))
        .when(k % 13 == 0, F.lit("-3"))
        .when(k % 17 == 0, F.lit("0x10"))
        .otherwise(cents)
    )
    first = F.pmod(hour, F.lit(2)) == 0
    cold = F.when(k % 19 == 0, F.lit("yes")).when(k % 23 == 0, (~first).cast("string"))
    return base.select(
        "event_id",
        F.col("user_id").alias("case_id"),
        F.pmod(F.dayofmonth("ts"), F.lit(4)).cast("bigint").alias("session"),
        F.pmod(hour, F.lit(2)).cast("bigint").alias("run"),
        F.when(k >= 95, F.lit("unknown")).when(k >= 90, null).otherwise(F.col("phase")).alias("phase"),
        F.when(seen, F.when(k < 10, F.lit(EXPECTED_BOARD))).otherwise(board).alias("placement"),
        F.when(seen, F.when(k < 5, F.lit("true"))).otherwise(trusted).alias("reliable"),
        total.alias("total_ms"),
        F.when(k % 5 == 0, F.lit(" 12.5e1 ")).otherwise(F.lit("7")).alias("stage_ms"),
        cold.otherwise(first.cast("string")).alias("cold"),
        F.when(k % 29 == 0, F.lit("v0")).otherwise(F.lit("v1")).alias("version"),
    )


def planned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page"), F.lit(PAGE_SIDE).alias("page_width"), F.lit(PAGE_SIDE).alias("page_height")
    )


def planned_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 truths as annotations: kind, style and rectangle."""
    kind = F.when(F.col("l_linenumber") <= 3, F.lit("complete")).otherwise(F.lit("partial"))
    t = truths(spark, sf_dir, "l_linenumber", "l_partkey")
    return t.select(
        "page",
        "a",
        kind.alias("kind"),
        F.concat(F.lit("style-"), F.pmod("l_partkey", F.lit(5)).cast("string")).alias("style"),
        F.col("x0").alias("x"),
        F.col("y0").alias("y"),
        (F.col("x1") - F.col("x0")).alias("width"),
        (F.col("y1") - F.col("y0")).alias("height"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 as device records: one row per user with a status per capability."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    counted = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    )

    def status(name: str) -> Column:
        n = F.col(name)
        return (
            F.when(n >= 14, F.lit("supported"))
            .when(n >= 12, F.lit("unknown"))
            .when(n >= 9, F.lit("unsupported"))
            .otherwise(F.lit("error"))
        )

    device = F.concat(F.lit("class-"), F.pmod("user_id", F.lit(3)).cast("string"))
    return counted.select(device.alias("device_class"), *(status(k).alias(k) for k in kinds))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: documents with a licence line as packages; some have compound licences."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", detect_licence(F.col("text")).alias("found"))
    whole = (
        F.when(F.col("lang") == "de", F.concat(F.lit("("), "found", F.lit(" OR MIT)")))
        .when(F.col("lang") == "fr", F.concat("found", F.lit(" AND CC-BY-4.0")))
        .when(F.col("lang") == "es", F.concat(F.lit(" "), "found", F.lit(" ")))
        .otherwise(F.col("found"))
    )
    return docs.where(F.col("found").isNotNull()).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), whole.alias("licence")
    )


def licence_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed exceptions: documents judged good, each with one licence."""
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return good.select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name"), F.lit("GPL-3.0").alias("licence")
    )


def pins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected and actual hashes of contents.

    Labelled documents are pinned by the hash of their text without outer
    blanks, benchmark items by their own, though nothing was delivered for them.
    """
    docs = documents(spark, sf_dir).select("doc_id", "text")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    squeezed = F.replace("text", F.lit("  "), F.lit(" "))
    pinned = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(
        name.alias("path"), content_hash(squeezed).alias("sha256")
    )
    bench = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("path"), content_hash(F.col("text")).alias("sha256")
    )
    return pinned.unionByName(bench), docs.select(name.alias("path"), content_hash(F.col("text")).alias("sha256"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: an 8 x 8 image per embedding, whole samples from 0 to 255."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("at", "e"))
    gray = F.floor((F.col("e").cast("double") + 0.5) * 255).cast("double")
    return rows.select(
        F.col("vec_id").cast("bigint").alias("img"),
        F.floor(F.col("at") / 8).cast("bigint").alias("y"),
        F.pmod(F.col("at"), F.lit(8)).cast("bigint").alias("x"),
        F.greatest(F.lit(0.0), F.least(F.lit(255.0), gray)).alias("v"),
    )


def pixel_sizes(spark: SparkSession, sf_dir: str, width: int = 8, height: int = 8) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("img"),
        F.lit(width).cast("bigint").alias("width"),
        F.lit(height).cast("bigint").alias("height"),
    )


def printed_boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """80 x 80 images: each embedding printed as a 64 px checkerboard on paper.

    Cell brightness follows the embedding, so the boards differ in contrast.
    """
    axis = F.sequence(F.lit(0), F.lit(79))
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("img"), "embedding")
    # a row becomes 6400 pixels, so rows are dealt out while they are few; the pixels of an image stay together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-images.count() // IMAGES_IN_TASK))
    images = images.repartition(tasks, "img")
    px = images.withColumn("y", F.explode(axis)).withColumn("x", F.explode(axis))
    row, col = F.floor((F.col("y") - 8) / 8), F.floor((F.col("x") - 8) / 8)
    inside = row.between(0, 7) & col.between(0, 7)
    ink = F.try_element_at("embedding", (row * 8 + col + 1).cast("int")).cast("double") * 60
    tone = F.when(F.pmod(row + col, F.lit(2)) == 0, F.lit(210.0)).otherwise(F.lit(130.0))
    v = F.when(inside, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), tone + ink))).cast("double"))
    px = px.select(
        "img",
        F.col("y").cast("bigint").alias("y"),
        F.col("x").cast("bigint").alias("x"),
        v.otherwise(F.lit(238.0)).alias("v"),
    )
    return px, pixel_sizes(spark, sf_dir, 80, 80)
