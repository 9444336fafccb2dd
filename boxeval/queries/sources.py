"""Catalogues, indexes, contents, inventories and device records, written from the tables and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import inventory, table
from boxeval.operators.integrity import content_hash, verify_pins
from boxeval.queries.governance import _INVENTORY
from boxeval.queries.registry import query
from boxeval.session import cut
from boxeval.sources import readers as S
from boxeval.streaming.sinks import remove_folder, work_folder


def _written(spark: SparkSession, name: str, write, read) -> DataFrame:
    """What ``read`` finds in a folder that ``write`` has filled; the folder goes afterwards."""
    folder = work_folder(spark, name)
    write(folder)
    rows = cut(read(folder))
    remove_folder(spark, folder)
    return rows


def _name(prefix: str, number: str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("bigint").cast("string"))


@query(
    "s1_read_catalogue",
    """WITH boxes AS (SELECT l_orderkey, count(*) AS boxes, CAST(sum((l_partkey % 5) * 150) AS BIGINT) AS x, CAST(sum(80 + 8 * l_linenumber) AS BIGINT) AS width,
      count(*) FILTER (WHERE l_returnflag = 'A') AS cut_off FROM lineitem GROUP BY l_orderkey)
    SELECT 'corpus-' || o_custkey % 7 AS corpus_id, 'page-' || o_orderkey AS page, 800 AS width, o_custkey AS seed, coalesce(boxes, 0) AS boxes, coalesce(x, 0) AS sum_x,
      coalesce(b.width, 0) AS sum_width, coalesce(cut_off, 0) AS cut_off, o_orderstatus || ',' || lower(o_orderpriority) AS tags, 0 AS problems
    FROM orders LEFT JOIN boxes b ON l_orderkey = o_orderkey""",
)
def read_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages and their lines as boxes, written as catalogue documents and read as tables."""
    side = (F.lit(80) + 8 * F.col("l_linenumber")).cast("int")
    rect = F.struct(
        (F.pmod("l_partkey", F.lit(5)) * 150).cast("int").alias("x"), (F.pmod("l_suppkey", F.lit(5)) * 150).cast("int").alias("y"),
        side.alias("width"), side.alias("height"),
    )
    box = F.struct(
        F.concat(F.lit("box-"), F.col("l_linenumber").cast("string")).alias("id"),
        F.when(F.col("l_returnflag") == "A", F.lit("partial")).otherwise(F.lit("full")).alias("kind"),
        rect.alias("pixelRect"), F.col("l_linestatus").alias("orientation"), F.col("l_quantity").cast("int").alias("borderWidthPx"),
    )
    boxes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("annotations"))
    orders = table(spark, sf, "orders")
    pages = orders.join(boxes, orders["o_orderkey"] == boxes["l_orderkey"], "left").select(
        F.concat(F.lit("corpus-"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("corpus"),
        _name("page-", "o_orderkey").alias("id"),
        F.lit(800).alias("width"),
        F.lit(800).alias("height"),
        F.array("o_orderstatus", F.lower("o_orderpriority")).alias("tags"),
        F.struct(F.lit("orders").alias("spec"), F.col("o_custkey").alias("seed")).alias("generator"),
        F.coalesce("annotations", F.array().cast(boxes.schema["annotations"].dataType)).alias("annotations"),
    )

    def read(folder: str) -> DataFrame:
        found = S.read_catalogue(spark, folder, lines=True)
        boxes = found["truth"].groupBy("page").agg(
            F.count("*").alias("boxes"), F.sum("x").alias("sum_x"), F.sum("width").alias("sum_width"), F.count_if(F.col("kind") == "partial").alias("cut_off")
        )
        tags = found["page_tags"].groupBy("page").agg(F.array_sort(F.collect_list(F.struct("at", "tag"))).alias("t"))
        problems = found["problems"].count()
        numbers = [F.coalesce(n, F.lit(0)).alias(n) for n in ("boxes", "sum_x", "sum_width", "cut_off")]
        rows = found["pages"].join(boxes, "page", "left").join(tags, "page", "left")
        return rows.select("corpus_id", "page", "width", "seed", *numbers, F.array_join("t.tag", ",").alias("tags"), F.lit(problems).alias("problems"))

    return _written(spark, "catalogue", lambda folder: S.write_catalogue(pages, folder, "corpus"), read)


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """Events as fixtures: what is expected of one is what its ``props`` hold."""
    fixture = F.struct(
        _name("event-", "event_id").alias("id"),
        content_hash(F.col("props")).alias("sha256"),
        F.struct(F.col("event_type").alias("kind")).alias("source"),
        F.array("event_type").alias("tags"),
        F.parse_json("props").alias("expected"),
        F.parse_json(F.concat(F.lit('{"value": '), F.col("value").cast("string"), F.lit("}"))).alias("tolerance"),
    )
    # events are dealt out while they are short; lists made before that would hold what a whole file split makes
    dealt = table(spark, sf, "events").withColumn("part", F.floor(F.col("event_id") / 64)).repartition("part")
    events = dealt.select("part", fixture.alias("f"))
    return events.groupBy("part").agg(F.collect_list("f").alias("fixtures")).select(F.lit(1).alias("schemaVersion"), "fixtures")


@query(
    "s2_read_fixture_index",
    """SELECT 'event-' || event_id AS id, event_type AS kind, CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, CASE event_type WHEN 'view' THEN '$.missing' ELSE '$.k' END) AS BIGINT) END AS wanted,
      CAST(len(json_keys(props)) AS BIGINT) AS fields, CAST(json_extract_string(props, '$.k') AS BIGINT) AS total, value FROM events""",
)
def read_fixture_index(spark: SparkSession, sf: str) -> DataFrame:
    """Each kind of event has its own path into what is expected; clicks have none, and that of views leads nowhere."""

    def read(folder: str) -> DataFrame:
        index, _ = S.read_fixture_index(spark, folder, lines=True)
        kind = F.col("source.kind")
        path = F.when(kind == "view", F.lit("$.missing")).when(kind != "click", F.lit("$.k"))
        fields = S.expected_fields(index).groupBy("id").agg(F.count("*").alias("fields"), F.sum(F.col("value").cast("bigint")).alias("total"))
        rows = index.select("id", kind.alias("kind"), S.wanted_values(index, path, "bigint").alias("wanted"), F.variant_get("tolerance", "$.value", "double").alias("value"))
        return rows.join(fields, "id", "left").select("id", "kind", "wanted", F.coalesce("fields", F.lit(0)).alias("fields"), "total", "value")

    return _written(spark, "index", _index(spark, sf).write.json, read)


@query(
    "s3_lookup_fixture",
    """WITH wanted AS (SELECT 'event-' || doc_id AS id FROM labels UNION SELECT 'event-' || (item_id + 1000000000) FROM benchmark)
    SELECT w.id, event_type AS kind, event_id IS NOT NULL AS known FROM wanted w LEFT JOIN events ON 'event-' || event_id = w.id""",
)
def lookup_fixture(spark: SparkSession, sf: str) -> DataFrame:
    """The fixtures that judged documents name, and the names that no fixture has."""
    beyond = table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("n"))
    wanted = table(spark, sf, "labels").select(F.col("doc_id").alias("n")).unionByName(beyond)
    wanted = wanted.select(_name("event-", "n").alias("id")).distinct()

    def read(folder: str) -> DataFrame:
        index, _ = S.read_fixture_index(spark, folder, lines=True)
        found, unknown = S.lookup_fixture(index, wanted)
        rows = found.select("id", F.col("source.kind").alias("kind"), F.lit(True).alias("known"))
        return rows.unionByName(unknown.select("id", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("known")))

    return _written(spark, "index", _index(spark, sf).write.json, read)


@query(
    "s5_read_inventory",
    f"""WITH {_INVENTORY}, given AS (SELECT name, licence, CAST(name[5:] AS BIGINT) AS n FROM inv)
    SELECT CASE WHEN n % 9 = 0 THEN NULL ELSE name END AS name, licence, CASE n % 9 WHEN 0 THEN 'no-name' WHEN 1 THEN 'no-versions' ELSE '' END AS problem, CASE WHEN n % 9 > 1 THEN '1.' || n || '|2' END AS versions
    FROM (SELECT CASE WHEN n % 9 = 1 THEN NULL ELSE name END AS name, licence, n FROM given)
    UNION ALL SELECT NULL, 'unlisted', 'not-a-list', NULL FROM (SELECT DISTINCT n // 64 FROM given)""",
)
def read_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Packages by licence, some without a name or without versions, and in each map a licence that has no list."""
    number = F.substring("name", 5, 18).cast("bigint")
    rows = inventory(spark, sf).withColumn("n", number)
    versions = F.when(F.col("n") % 9 != 1, F.array(F.concat(F.lit("1."), F.col("n").cast("string")), F.lit("2")))
    package = F.struct(F.when(F.col("n") % 9 != 0, F.col("name")).alias("name"), versions.alias("versions"))
    lists = rows.groupBy(F.floor(F.col("n") / 64).alias("part"), "licence").agg(F.to_json(F.collect_list(package)).alias("p"))
    member = F.concat(F.regexp_replace(F.to_json(F.array("licence")), r"^\[|\]$", ""), F.lit(":"), "p")
    maps = lists.groupBy("part").agg(F.array_join(F.collect_list(member), ",").alias("m"))
    lines = maps.select(F.concat(F.lit('{"unlisted":3,'), "m", F.lit("}")).alias("value"))

    def read(folder: str) -> DataFrame:
        packages, bad = S.read_inventory_members(spark, folder)
        good = packages.select("name", "licence", F.lit("").alias("problem"), F.array_join("versions", "|").alias("versions"))
        none = F.lit(None).cast("string")
        return good.unionByName(bad.select(none.alias("name"), "licence", "problem", none.alias("versions")))

    return _written(spark, "inventory", lines.write.text, read)


@query(
    "s6_read_contents",
    """WITH stored AS (SELECT page_id, html || chr(10) AS content FROM pages),
    pinned AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN sha256('other') ELSE sha256(content) END AS pin FROM stored WHERE page_id % 7 <> 0
      UNION ALL SELECT item_id + 1000000000, sha256(text) FROM benchmark)
    SELECT coalesce(p.page_id, s.page_id) AS page_id, strlen(content) AS length, CASE WHEN pin IS NULL THEN 'untracked' WHEN s.page_id IS NULL THEN 'missing' WHEN pin = sha256(content) THEN 'ok' ELSE 'mismatch' END AS status
    FROM pinned p FULL JOIN stored s ON s.page_id = p.page_id""",
)
def read_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files of their own, hashed from their bytes and held against pins; some pins are wrong or of no page."""
    pages = table(spark, sf, "pages").select("page_id", "html")
    own = content_hash(F.concat("html", F.lit("\n")))
    pin = F.when(F.col("page_id") % 10 == 0, F.sha2(F.lit("other"), 256)).otherwise(own)
    pinned = pages.where(F.col("page_id") % 7 != 0).select("page_id", pin.alias("sha256"))
    items = table(spark, sf, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("page_id"), content_hash(F.col("text")).alias("sha256"))

    tasks = S.shelves(pages)

    def read(folder: str) -> DataFrame:
        # a file's name without a number is that of pages without an id
        number = F.regexp_extract("path", r"([^/]+)\.txt$", 1).try_cast("bigint")
        files = S.read_contents(spark, folder, "*.txt", tasks=tasks)
        files = cut(files.select(number.alias("page_id"), "length", content_hash(F.col("content")).alias("sha256")))
        checked = verify_pins(pinned.unionByName(items), files, "page_id").select("page_id", "status")
        return checked.join(files.select("page_id", "length"), "page_id", "left").select("page_id", "length", "status")

    return _written(spark, "contents", lambda folder: S.write_contents(pages, folder, "page_id", "html", tasks), read)


_FAULTS = {
    "commit:must be a hash": "n % 5 = 0",
    "date:must be a day": "n % 11 = 3",
    "deviceClass:must be known": "c_nationkey % 4 = 3",
    "url:must be an https origin": "n % 7 = 2",
    "capabilities:must be the declared ones": "n % 13 = 1",
    "widthsTried:must have modes and widths": "c_acctbal < 0",
    "result:must be known": "c_mktsegment = 'BUILDING'",
    "unknown-key:$.battery": "n % 17 = 4",
}


@query(
    "s9_read_evidence",
    "WITH records AS (SELECT *, c_custkey AS n FROM customer) "
    + " UNION ALL ".join(f"SELECT '{problem}' AS problem, count(*) AS records FROM records WHERE {when} HAVING count(*) > 0" for problem, when in _FAULTS.items())
    + " UNION ALL SELECT 'records', count(*) FROM records",
)
def read_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as device records with planted faults; the problems, each with the number of records that have it."""

    def unless(problem: str, good: Column, bad: Column) -> Column:
        return F.when(F.expr(_FAULTS[problem]), bad).otherwise(good)

    # fixed values: the declared capabilities
    names = ["indexeddb", "opfs", "workers", "webassembly", "storage-estimate", "storage-persistence", "touch", "cross-origin-isolation"]

    def capabilities(known: list[str]) -> Column:
        return F.create_map(*(F.lit(v) for name in known for v in (name, "supported")))

    width = unless("widthsTried:must have modes and widths", F.lit(320), F.lit(0))
    record = table(spark, sf, "customer").withColumn("n", F.col("c_custkey")).select(
        F.lit(1).alias("schemaVersion"),
        F.lit(7).alias("issue"),
        unless("commit:must be a hash", F.substring(F.sha2(F.col("c_name"), 256), 1, 12), F.lit("HEAD")).alias("commit"),
        unless("date:must be a day", F.lit("2024-02-29"), F.lit("2023-02-29")).alias("date"),
        unless("deviceClass:must be known", F.lit("laptop"), F.lit("fridge")).alias("deviceClass"),
        F.lit("os").alias("os"),
        F.lit("browser").alias("browser"),
        F.lit(True).alias("installed"),
        unless("url:must be an https origin", F.lit("https://app.example/"), F.lit("http://app.example/")).alias("url"),
        unless("capabilities:must be the declared ones", capabilities(names), capabilities(names[1:])).alias("capabilities"),
        F.lit(False).alias("crossOriginIsolated"),
        F.array(F.struct(F.lit("portrait").alias("mode"), width.alias("cssWidth"))).alias("widthsTried"),
        unless("result:must be known", F.lit("pass"), F.lit("maybe")).alias("result"),
        F.col("c_name").alias("notes"),
        F.array().cast("array<string>").alias("evidence"),
        F.array().cast("array<string>").alias("limitations"),
        # fields that are null are not written
        F.when(F.expr(_FAULTS["unknown-key:$.battery"]), F.lit(1)).alias("battery"),
    )

    def read(folder: str) -> DataFrame:
        records, problems = S.read_evidence(spark, folder, lines=True)
        # every problem names the file that its record came from
        counts = problems.where(F.col("file").contains("part-")).groupBy("problem").agg(F.count("*").alias("records"))
        return counts.unionByName(records.agg(F.lit("records").alias("problem"), F.count("*").alias("records")))

    return _written(spark, "evidence", record.write.json, read)
