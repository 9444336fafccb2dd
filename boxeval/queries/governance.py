"""Contract checks, integrity, text rules, licence policy and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxeval.bindings import (
    ALLOWED_LICENCES,
    ALLOWED_ORIGINS,
    boards,
    documents,
    inventory,
    labelled_boards,
    licence_exceptions,
    lines,
    observations,
    pins,
    predictions,
    raw_runs,
    runs,
    table,
    truths,
)
from boxeval.functions import text as X
from boxeval.functions.boards import mean_confidence
from boxeval.functions.geometry import box, in_bounds, is_valid
from boxeval.functions.numbers import reasons, strict_boolean, strict_duration
from boxeval.operators import contracts as V
from boxeval.operators import integrity as H
from boxeval.operators import policy as L
from boxeval.operators.ordered import row_numbers
from boxeval.queries.registry import query
from boxeval.queries.views import BOARDS, BOXES, LINES, OBS, RAW

_PAGE_RULES = [
    ("url", "must use https", "starts_with(url, 'https://')"),
    ("url", "must end in a number", "regexp_matches(url, '/[0-9]+$')"),
    ("html", "must start with a doctype", "starts_with(html, '<!DOCTYPE html>')"),
    ("html", "must be closed", "regexp_matches(html, '</html>\\s*$')"),
    ("html", "must be non-empty", "length(html) > 0"),
]


def _violations_sql(source: str, entity: str, row_id: str, rules: list[tuple[str, str, str]]) -> str:
    parts = (
        f"SELECT '{entity}' AS entity, CAST({row_id} AS VARCHAR) AS row_id, '{path}' AS path, '{message}' AS message FROM {source} WHERE NOT coalesce({ok}, false)"
        for path, message, ok in rules
    )
    return " UNION ALL ".join(parts)


@query("v1_check_fields", _violations_sql("pages", "page", "page_id", _PAGE_RULES))
def check_fields(spark: SparkSession, sf: str) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    ok = [
        url.startswith("https://"),
        url.rlike("/[0-9]+$"),
        html.startswith("<!DOCTYPE html>"),
        html.rlike(r"</html>\s*$"),
        F.length(html) > 0,
    ]
    rules = [V.Rule(path, message, rule) for (path, message, _), rule in zip(_PAGE_RULES, ok)]
    return V.check_fields(table(spark, sf, "pages"), "page", F.col("page_id"), rules)


@query(
    "v2_check_keys",
    """WITH j AS (SELECT event_id, json_keys(CASE WHEN event_type = 'error' THEN replace(props, '"k"', '"key"') ELSE props END) AS names FROM events)
    SELECT 'event' AS entity, CAST(event_id AS VARCHAR) AS row_id, unnest(list_filter(names, lambda n: n <> 'k')) AS path, 'unexpected property' AS message FROM j
    UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), 'k', 'missing property' FROM j WHERE NOT list_contains(names, 'k')""",
)
def check_keys(spark: SparkSession, sf: str) -> DataFrame:
    renamed = F.replace("props", F.lit('"k"'), F.lit('"key"'))
    json = F.when(F.col("event_type") == "error", renamed).otherwise(F.col("props"))
    return V.check_keys(table(spark, sf, "events"), "event", F.col("event_id"), json, ["k"])


@query(
    "v3_check_unique",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def check_unique(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_unique(table(spark, sf, "lineitem"), ["l_orderkey"], "l_linenumber")


_CROSS = [
    ("placement", "partial truth must omit it", "NOT (kind = 'partial' AND placement IS NOT NULL)"),
    ("placement", "complete truth needs it", "NOT (kind = 'complete' AND placement IS NULL)"),
    ("rect", "complete truth must be a square of eight cells", "kind = 'partial' OR (w = h AND w % 8 = 0)"),
    ("rect", "must stay inside the page", "x0 >= 0 AND y0 >= 0 AND x0 + w <= 700 AND y0 + h <= 700"),
    ("source", "needs exactly one of generator and url", "(generator IS NULL) <> (url IS NULL)"),
    ("rendered", "black view must be reversed", "orientation <> 'black' OR rendered = reverse(placement)"),
]
_CROSS_SQL = f"""WITH {BOXES}, t AS (SELECT page, a, x0, y0, x1 - x0 + q % 2 AS w, y1 - y0 AS h, CASE WHEN l_linenumber <= 3 THEN 'complete' ELSE 'partial' END AS kind,
  CASE WHEN (l_linenumber <= 3 AND l_tax < 0.07::DOUBLE) OR (l_linenumber = 4 AND l_discount > 0.08::DOUBLE) THEN a END AS placement, CASE WHEN l_linestatus = 'O' THEN 'g' END AS generator,
  CASE WHEN l_returnflag <> 'N' THEN 'u' END AS url, CASE WHEN l_returnflag = 'R' THEN 'black' ELSE 'white' END AS orientation FROM truth),
u AS (SELECT *, page || '/' || a AS row_id, CASE WHEN h > 90 THEN reverse(placement) ELSE placement END AS rendered FROM t) {{}}"""


@query("v4_check_cross_field", _CROSS_SQL.format(_violations_sql("u", "truth", "row_id", _CROSS).replace("NOT coalesce(orientation <> 'black' OR rendered = reverse(placement), false)", "NOT coalesce(orientation <> 'black' OR placement IS NULL OR rendered = reverse(placement), false)")))
def check_cross_field(spark: SparkSession, sf: str) -> DataFrame:
    t = truths(spark, sf, "l_linenumber", "l_tax", "l_discount", "l_quantity", "l_linestatus", "l_returnflag")
    complete = F.col("l_linenumber") <= 3
    given = (complete & (F.col("l_tax") < 0.07)) | (~complete & (F.col("l_discount") > 0.08))
    black = F.col("l_returnflag") == "R"
    t = (
        t.withColumn("w", F.col("x1") - F.col("x0") + F.col("l_quantity").cast("bigint") % 2)
        .withColumn("h", F.col("y1") - F.col("y0"))
        .withColumn("placement", F.when(given, F.col("a")))
        .withColumn("generator", F.when(F.col("l_linestatus") == "O", F.lit("g")))
        .withColumn("url", F.when(F.col("l_returnflag") != "N", F.lit("u")))
    )
    t = t.withColumn(
        "rendered", F.when(F.col("h") > 90, F.reverse("placement")).otherwise(F.col("placement"))
    )
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + F.col("w") <= 700) & (F.col("y0") + F.col("h") <= 700)
    turned = ~black | F.col("placement").isNull() | (F.col("rendered") == F.reverse("placement"))
    ok = [
        complete | F.col("placement").isNull(),
        ~complete | F.col("placement").isNotNull(),
        ~complete | ((F.col("w") == F.col("h")) & (F.col("w") % 8 == 0)),
        inside,
        F.col("generator").isNull() != F.col("url").isNull(),
        turned,
    ]
    rules = [V.Rule(path, message, rule) for (path, message, _), rule in zip(_CROSS, ok)]
    return V.check_fields(t, "truth", F.concat_ws("/", F.col("page").cast("string"), "a"), rules)


@query(
    "v5_check_references",
    """SELECT 'documents' AS entity, CAST(doc_id AS VARCHAR) AS row_id, 'not in labels' AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), 'not in documents' FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
)
def check_references(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    return V.check_references(documents(spark, sf), labels, "doc_id", "documents", "labels")


_REQUIRED = {"flag-A": 1, "flag-N": 1, "flag-R": 1, "size-0": 100, "size-3": 100, "size-4": 1}


@query(
    "v6_check_coverage",
    f"""WITH {OBS}, w AS (SELECT unnest([{', '.join(f"{{'tag': '{t}', 'at_least': {n}::BIGINT}}" for t, n in _REQUIRED.items())}]) AS x),
    c AS (SELECT tag, count(*) AS n FROM (SELECT tag1 AS tag FROM obs UNION ALL SELECT tag2 FROM obs) GROUP BY tag)
    SELECT x.tag AS tag, x.at_least AS at_least, coalesce(n, 0) AS n, coalesce(n, 0) >= x.at_least AS covered FROM w LEFT JOIN c ON c.tag = x.tag""",
)
def check_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return V.check_coverage(observations(spark, sf), "tags", _REQUIRED)


@query(
    "v7_check_constants",
    """SELECT 'document' AS entity, CAST(doc_id AS VARCHAR) AS row_id, 'lang' AS path, 'must equal en' AS message FROM documents WHERE lang <> 'en'
    UNION ALL SELECT 'document', CAST(doc_id AS VARCHAR), 'source', 'must equal src0' FROM documents WHERE source <> 'src0'""",
)
def check_constants(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "lang", "source")
    return V.check_constants(docs, "document", F.col("doc_id"), {"lang": "en", "source": "src0"})


_QUARANTINE_SQL = f"""WITH {BOXES}, g AS (SELECT page, p, x0, CASE WHEN l_quantity = 50 THEN x0 ELSE x1 END AS x1, 0.5 + l_tax * 10 AS min_conf, CASE WHEN l_linenumber = 7 THEN 'sideways' ELSE 'white' END AS o FROM pred)
SELECT page, p, concat_ws(',', CASE WHEN x1 <= x0 THEN 'box-order' END, CASE WHEN min_conf > 1 THEN 'confidence-range' END, CASE WHEN o = 'sideways' THEN 'orientation-enum' END) AS reasons FROM g WHERE"""


def _messages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf, "l_quantity", "l_tax", "l_linenumber")
    p = p.withColumn("x1", F.when(F.col("l_quantity") == 50, F.col("x0")).otherwise(F.col("x1")))
    rules = [
        V.Rule("box", "box-order", is_valid(box())),
        V.Rule("min_conf", "confidence-range", (F.lit(0.5) + F.col("l_tax") * 10).between(0.0, 1.0)),
        V.Rule("orientation", "orientation-enum", F.col("l_linenumber") != 7),
    ]
    return V.quarantine(p, rules)


@query("v8_quarantine", f"{_QUARANTINE_SQL} x1 <= x0 OR min_conf > 1 OR o = 'sideways'")
def quarantine_bad(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = _messages(spark, sf)
    return bad.select("page", "p", F.array_join("reasons", ",").alias("reasons"))


@query("v8_quarantine_kept", f"SELECT page, p FROM ({_QUARANTINE_SQL} NOT (x1 <= x0 OR min_conf > 1 OR o = 'sideways'))")
def quarantine_good(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = _messages(spark, sf)
    return good.select("page", "p")


@query(
    "v8_quarantine_measurements",
    f"""WITH {BOARDS}, told AS (SELECT vec_id, list_min(conf) AS low, list_sum(conf) / 64 AS mean,
      CASE label WHEN 3 THEN list_prepend(1.5::DOUBLE, conf[2:]) WHEN 4 THEN conf[:63] WHEN 5 THEN list_append(conf[:63], NULL) ELSE conf END AS c FROM boards)
    SELECT vec_id, concat_ws(',', CASE WHEN len(c) <> 64 THEN 'must hold 64 values' END, CASE WHEN len(list_filter(c, lambda v: v IS NULL OR v > 1 OR v < 0)) > 0 THEN 'must lie in [0, 1]' END,
      CASE WHEN abs(list_min(c) - low) > 0.000001 THEN 'contradicts vector' END, CASE WHEN coalesce(abs(list_sum(c) / len(list_filter(c, lambda v: v IS NOT NULL)) - mean), 1) > 0.000001 OR len(list_filter(c, lambda v: v IS NULL)) > 0 THEN 'contradicts vector' END) AS reasons
    FROM told WHERE reasons <> \'\'""",
)
def quarantine_measurements(spark: SparkSession, sf: str) -> DataFrame:
    """Boards whose vectors have a value out of range, one too few, or none."""
    b = boards(spark, sf).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "confidences")
    stored = b.withColumn("low", F.array_min("confidences")).withColumn("mean", mean_confidence(F.col("confidences")))
    most = F.slice("confidences", 1, 63)
    changed = (
        F.when(F.col("label") == 3, F.concat(F.array(F.lit(1.5)), F.slice("confidences", 2, 63)))
        .when(F.col("label") == 4, most)
        .when(F.col("label") == 5, F.concat(most, F.array(F.lit(None).cast("double"))))
        .otherwise(F.col("confidences"))
    )
    told = stored.withColumn("confidences", changed)
    rules = V.measurement_rules(F.col("confidences"), F.col("low"), F.col("mean"))
    _, bad = V.quarantine(told, rules)
    return bad.select("vec_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "v9_check_aggregates",
    f"""WITH {BOARDS} SELECT 'board' AS entity, CAST(vec_id AS VARCHAR) AS row_id, 'min_conf' AS path, 'contradicts vector' AS message FROM boards WHERE label = 3
    UNION ALL SELECT 'board', CAST(vec_id AS VARCHAR), 'mean_conf', 'contradicts vector' FROM boards WHERE label = 3 OR label = 4""",
)
def check_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    off = F.when(F.col("label") == 3, F.lit(0.01)).otherwise(F.lit(0.0))
    off_mean = F.when(F.col("label").isin(3, 4), F.lit(0.002)).otherwise(F.lit(0.0))
    stored = boards(spark, sf).select(
        "vec_id",
        "confidences",
        (F.array_min("confidences") + off).alias("low"),
        (mean_confidence(F.col("confidences")) - off_mean).alias("mean"),
    )
    rules = V.aggregate_rules(F.col("confidences"), F.col("low"), F.col("mean"))
    return V.check_fields(stored, "board", F.col("vec_id"), rules)


@query(
    "v10_check_region",
    """WITH g AS (SELECT vec_id, label, list_transform(embedding, lambda v: (CAST(v AS DOUBLE) + 0.3::DOUBLE) * 400) AS d FROM embeddings)
    SELECT 'raster' AS entity, CAST(vec_id AS VARCHAR) AS row_id, 'width' AS path, 'must be 8 to 4096' AS message FROM g WHERE label = 0
    UNION ALL SELECT 'raster', CAST(vec_id AS VARCHAR), 'data', 'length must match the size' FROM g WHERE label = 0
    UNION ALL SELECT 'raster', CAST(vec_id AS VARCHAR), 'data', 'samples must be 0 to 255' FROM g WHERE len(list_filter(d, lambda v: v < 0 OR v > 255)) > 0""",
)
def check_region(spark: SparkSession, sf: str) -> DataFrame:
    data = F.transform("embedding", lambda v: (v.cast("double") + 0.3) * 400)
    width = F.when(F.col("label") == 0, F.lit(4)).otherwise(F.lit(8))
    rasters = table(spark, sf, "embeddings").select("vec_id", width.alias("w"), F.lit(8).alias("h"), data.alias("d"))
    rules = V.region_rules(F.col("w"), F.col("h"), F.col("d"), 1)
    return V.check_fields(rasters, "raster", F.col("vec_id"), rules)


_PATH_SQL = "regexp_extract(url, '^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)', 1)"


@query(
    "v11_check_paths",
    f"""WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages)
    SELECT 'page' AS entity, CAST(page_id AS VARCHAR) AS row_id, 'path' AS path, 'must not escape its root' AS message FROM p WHERE starts_with(path, '/') IS NULL OR regexp_matches(path, '(^|/)[.][.](/|$)')
    UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), 'path', 'must be canonical' FROM p WHERE NOT regexp_matches(path, '^/[a-z]{{2}}/[0-9]+$')""",
)
def check_paths(spark: SparkSession, sf: str) -> DataFrame:
    # paths are relative to the site, so the leading slash is cut first
    path = X.path_of(F.col("url"))
    rules = [
        V.Rule("path", "must not escape its root", ~X.escapes_root(F.substring(path, F.lit(2), F.length(path)))),
        V.Rule("path", "must be canonical", path.rlike("^/[a-z]{2}/[0-9]+$")),
    ]
    return V.check_fields(table(spark, sf, "pages"), "page", F.col("page_id"), rules)


@query(
    "v12_parse_strict",
    f"""WITH {RAW} SELECT event_id, total_ms, cold, CASE WHEN reliable IN ('true', 'false') THEN reliable = 'true' END AS reliable,
      concat_ws(',', CASE WHEN total_ms IS NULL THEN 'total-ms' END, CASE WHEN cold IS NULL THEN 'cold' END, CASE WHEN reliable IS NULL OR reliable = 'maybe' THEN 'reliable' END) AS invalid FROM raw""",
)
def parse_strict(spark: SparkSession, sf: str) -> DataFrame:
    total, cold = strict_duration(F.col("total_ms")), strict_boolean(F.col("cold"))
    trusted = strict_boolean(F.col("reliable"))
    bad = reasons((total.isNull(), "total-ms"), (cold.isNull(), "cold"), (trusted.isNull(), "reliable"))
    return raw_runs(spark, sf).select(
        "event_id", total.alias("total_ms"), cold.alias("cold"), trusted.alias("reliable"),
        F.array_join(bad, ",").alias("invalid"),
    )


@query("h1_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", H.content_hash(F.col("text")).alias("sha256"))


@query(
    "h2_verify_pins",
    """WITH e AS (SELECT 'doc-' || doc_id AS path, sha256(replace(text, '  ', ' ')) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'item-' || item_id, sha256(text) FROM benchmark), a AS (SELECT 'doc-' || doc_id AS path, sha256(text) AS h FROM documents)
    SELECT coalesce(e.path, a.path) AS path, e.h AS pinned, a.h AS found, CASE WHEN e.h IS NULL THEN 'untracked' WHEN a.h IS NULL THEN 'missing' WHEN e.h = a.h THEN 'ok' ELSE 'mismatch' END AS status
    FROM e FULL JOIN a ON e.path = a.path""",
)
def verify_pins(spark: SparkSession, sf: str) -> DataFrame:
    expected, actual = pins(spark, sf)
    return H.verify_pins(expected, actual, "path")


def _tree(rows: str, leaf: int) -> str:
    """The fingerprint of groups with up to two levels below the root."""
    node = f"SELECT g, n, place, item, 2 * (CAST(n > {leaf} AS INTEGER) + CAST(n > {leaf * 256} AS INTEGER)) AS digits FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM ({rows}))"
    for level in (2, 1, 0):
        up = max(2 * level - 2, 0)
        joined = f"SELECT g, n, left(place, {2 * level}) AS place, sha256(string_agg(item, '' ORDER BY place, item)) AS item, {up} AS digits FROM ({node}) WHERE digits = {2 * level} GROUP BY g, n, left(place, {2 * level})"
        node = joined if level == 0 else f"{joined} UNION ALL SELECT g, n, place, item, digits FROM ({node}) WHERE digits <> {2 * level}"
    return node


_ITEMS = "SELECT {group} AS g, sha256({id}) AS place, sha256(sha256({content}) || ':' || {id}) AS item FROM {table}"


@query(
    "h3_set_fingerprint",
    f"SELECT g AS source, item AS fingerprint, n FROM ({_tree(_ITEMS.format(group='source', id='CAST(doc_id AS VARCHAR)', content='text', table='documents'), 4096)})",
)
def set_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    hashed = documents(spark, sf).select("source", "doc_id", H.content_hash(F.col("text")).alias("sha256"))
    return H.set_fingerprint(hashed, "source", "doc_id")


_PAGE_ID = "'page-' || event_id"


@query(
    "h3_set_fingerprint_text_ids",
    f"SELECT g AS event_type, item AS fingerprint, n FROM ({_tree(_ITEMS.format(group='event_type', id=_PAGE_ID, content='props', table='events'), 16)})",
)
def set_fingerprint_text_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Small nodes, so that the tree has several levels."""
    page = F.concat(F.lit("page-"), F.col("event_id").cast("bigint").cast("string"))
    hashed = table(spark, sf, "events").select("event_type", page.alias("page"), H.content_hash(F.col("props")).alias("sha256"))
    return H.set_fingerprint(hashed, "event_type", "page", leaf=16)


@query(
    "h4_table_diff",
    """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), p AS (SELECT label, arg_min(v, vec_id) AS w FROM e GROUP BY label),
    z AS (SELECT e.vec_id, v, w, list_transform(range(1, 65), lambda i: abs(w[i] - v[i])) AS g FROM e JOIN p ON p.label = e.label)
    SELECT vec_id, v = w AS equal, CAST(len(list_filter(g, lambda x: x > 0)) AS BIGINT) AS changed, list_max(g) AS max_change FROM z""",
)
def table_diff(spark: SparkSession, sf: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    now = table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", v.alias("v"))
    proto = now.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"))
    old = now.join(proto, "label").select("vec_id", F.col("w").alias("v"))
    return H.table_diff(old, now, "vec_id", "v")


@query(
    "h5_repeatability",
    """SELECT CAST(user_id AS BIGINT) AS user_id, variants FROM (SELECT user_id, count(DISTINCT (event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5)) AS variants FROM events GROUP BY user_id) WHERE variants > 1""",
)
def repeatability(spark: SparkSession, sf: str) -> DataFrame:
    return H.repeatability(runs(spark, sf), ["user_id"], ["event_type", "style"])


@query(
    "h6_exact_copies",
    "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def exact_copies(spark: SparkSession, sf: str) -> DataFrame:
    return H.exact_copies(documents(spark, sf), "doc_id", "text")


# word by word: a link has a scheme, a drive's path a letter and colon, a rooted path two slashes
_REDACT_SQL = r"""WITH first AS (SELECT page_id, string_split(html, chr(10))[1] AS line FROM pages),
  links AS (SELECT page_id, regexp_replace(line, '[a-zA-Z][-+.a-zA-Z0-9]*:/{2,}[^[:space:]<>"'']+', '[link]', 'g') AS line FROM first),
  drives AS (SELECT page_id, regexp_replace(line, '\b[a-zA-Z]:[/\\][^[:space:]<>"'':]+', '[path]', 'g') AS line FROM links)
SELECT page_id, regexp_replace(line, '(^|[[:space:]({=,;<"''\[])/[^/[:space:]<>"'':]+/[^[:space:]<>"'':]*', '\1[path]', 'g') AS safe FROM drives"""


@query("x1_redact", _REDACT_SQL)
def redact(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.redact(F.col("html")).alias("safe"))


@query(
    "x2_origin_violations",
    f"""SELECT regexp_extract(url, '^([a-z][a-z0-9+.-]*://[^/?#]+)', 1) AS origin, count(*) AS n FROM pages GROUP BY 1
    HAVING origin NOT IN ({', '.join(f"'{o}'" for o in ALLOWED_ORIGINS)})""",
)
def origin_violations(spark: SparkSession, sf: str) -> DataFrame:
    counted = table(spark, sf, "pages").groupBy(X.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"))
    return counted.where(~F.col("origin").isin(ALLOWED_ORIGINS))


# fixed values: message kind, stable code, safe text
_CODES = [
    ("error", "runtime-failure", "The diagram could not be read."),
    ("click", "aborted", "The request was cancelled."),
    ("view", "no-board", "No board was found."),
]


@query(
    "x4_error_code_map",
    f"""SELECT code, text, count(*) AS n FROM (SELECT {' '.join(['CASE event_type'] + [f"WHEN '{k}' THEN '{c}'" for k, c, _ in _CODES] + ["ELSE 'none' END"])} AS code,
      {' '.join(['CASE event_type'] + [f"WHEN '{k}' THEN '{t}'" for k, _, t in _CODES] + ["ELSE '' END"])} AS text FROM events) GROUP BY code, text""",
)
def error_code_map(spark: SparkSession, sf: str) -> DataFrame:
    kinds = spark.createDataFrame(_CODES, "event_type string, code string, text string")
    counted = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    joined = counted.join(F.broadcast(kinds), "event_type", "left")
    return (
        joined.groupBy(F.coalesce("code", F.lit("none")).alias("code"), F.coalesce("text", F.lit("")).alias("text"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    "x5_shapes",
    r"""SELECT page_id, regexp_matches(h, '^[a-z0-9]+(-[a-z0-9]+)*$') AS kebab, regexp_matches(CASE WHEN length(html) > 2000 THEN sha256(html) ELSE h END, '^[0-9a-f]{64}$') AS sha, regexp_matches(d, '^\d{4}-\d{2}-\d{2}$') AS day
    FROM (SELECT page_id, html, regexp_extract(url, '://([^.]+)', 1) AS h, '2024-13-' || regexp_extract(url, '/(\d+)', 1) AS d FROM pages)""",
)
def shapes(spark: SparkSession, sf: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^.]+)", 1)
    sha = F.when(F.length("html") > 2000, F.sha2("html", 256)).otherwise(host)
    day = F.concat(F.lit("2024-13-"), F.regexp_extract("url", r"/(\d+)", 1))
    return table(spark, sf, "pages").select(
        "page_id", X.is_kebab_id(host).alias("kebab"), X.is_sha256(sha).alias("sha"), X.is_iso_date(day).alias("day")
    )


@query("x6_project_safe", f"WITH {BOARDS} SELECT vec_id, label, cells = truth_cells AS exact FROM labelled")
def project_safe(spark: SparkSession, sf: str) -> DataFrame:
    scored = labelled_boards(spark, sf).withColumn("exact", F.col("cells") == F.col("truth_cells"))
    return scored.select("vec_id", "label", "exact")


_LINE = "list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)licen[sc]e|released under'))[1]"
_FOUND = " ".join(f"WHEN contains(line, '{words}') THEN '{name}'" for words, name in L.ALIASES)
_INVENTORY = f"""found AS (SELECT doc_id, lang, CASE {_FOUND} ELSE 'unknown' END AS found FROM (SELECT doc_id, lang, {_LINE} AS line FROM documents) WHERE line IS NOT NULL),
inv AS (SELECT 'doc-' || doc_id AS name, CASE lang WHEN 'de' THEN '(' || found || ' OR MIT)' WHEN 'fr' THEN found || ' AND CC-BY-4.0' WHEN 'es' THEN ' ' || found || ' ' ELSE found END AS licence FROM found),
parsed AS (SELECT name, licence, CASE WHEN contains(bare, ' OR ') THEN 'or' WHEN contains(bare, ' AND ') THEN 'and' ELSE 'plain' END AS kind,
  CASE WHEN contains(bare, ' OR ') THEN string_split(bare, ' OR ') WHEN contains(bare, ' AND ') THEN string_split(bare, ' AND ') ELSE [bare] END AS parts
  FROM (SELECT *, CASE WHEN trim(licence) LIKE '(%)' THEN trim(trim(licence)[2:-2]) ELSE trim(licence) END AS bare FROM inv)),
judged AS (SELECT *, len(list_filter(parts, lambda p: p IN ({', '.join(f"'{a}'" for a in ALLOWED_LICENCES)}))) AS good FROM parsed),
exempt AS (SELECT 'doc-' || doc_id AS name, 'GPL-3.0' AS licence FROM labels WHERE quality = 1)"""


@query("l1_parse_expression", f"WITH {_INVENTORY} SELECT name, licence, kind, array_to_string(parts, '|') AS parts FROM parsed")
def parse_expression(spark: SparkSession, sf: str) -> DataFrame:
    parsed = inventory(spark, sf).withColumn("e", L.parse_expression(F.col("licence")))
    return parsed.select("name", "licence", "e.kind", F.array_join("e.parts", "|").alias("parts"))


@query(
    "l2_is_allowed",
    f"WITH {_INVENTORY} SELECT name, licence, CASE kind WHEN 'or' THEN good > 0 ELSE good = len(parts) END AS allowed FROM judged",
)
def is_allowed(spark: SparkSession, sf: str) -> DataFrame:
    verdict = L.is_allowed(L.parse_expression(F.col("licence")), ALLOWED_LICENCES)
    return inventory(spark, sf).select("name", "licence", verdict.alias("allowed"))


@query(
    "l3_find_violations",
    f"""WITH {_INVENTORY} SELECT name, licence FROM judged j WHERE NOT CASE kind WHEN 'or' THEN good > 0 ELSE good = len(parts) END
      AND NOT EXISTS (SELECT 1 FROM exempt e WHERE e.name = j.name AND e.licence = j.licence)""",
)
def find_violations(spark: SparkSession, sf: str) -> DataFrame:
    return L.find_violations(inventory(spark, sf), ALLOWED_LICENCES, licence_exceptions(spark, sf))


@query("l4_detect_licence", f"WITH {_INVENTORY} SELECT doc_id, found FROM found")
def detect_licence(spark: SparkSession, sf: str) -> DataFrame:
    found = documents(spark, sf).select("doc_id", L.detect_licence(F.col("text")).alias("found"))
    return found.where(F.col("found").isNotNull())


@query(
    "j11_policy_exceptions",
    f"WITH {_INVENTORY} SELECT name, licence FROM inv i WHERE NOT EXISTS (SELECT 1 FROM exempt e WHERE e.name = i.name AND e.licence = i.licence)",
)
def policy_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return L.without_exceptions(inventory(spark, sf), licence_exceptions(spark, sf))


@query("m20_inventory_count", f"WITH {_INVENTORY} SELECT licence, count(*) AS packages FROM inv GROUP BY ROLLUP (licence)")
def inventory_count(spark: SparkSession, sf: str) -> DataFrame:
    return L.inventory_count(inventory(spark, sf))


@query("u2_key_union", "SELECT doc_id AS key FROM labels UNION SELECT item_id FROM benchmark ORDER BY key")
def key_union(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "labels").select(F.col("doc_id").alias("key"))
    right = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"))
    return left.union(right).distinct().orderBy("key")


@query("u3_untracked", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def untracked(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id"))


@query(
    "u4_order_alignment",
    f"""WITH {LINES}, n AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY line_id) AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, line_id) AS j FROM lines)
    SELECT l_orderkey, bool_and(i = j) AS aligned, count(*) AS n FROM n GROUP BY l_orderkey""",
)
def order_alignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = lines(spark, sf).select("l_orderkey", "line_id", "l_shipdate")
    first = row_numbers(rows, ["l_orderkey"], [F.col("line_id")], "i")
    both = row_numbers(first, ["l_orderkey"], [F.col("l_shipdate"), F.col("line_id")], "j")
    return H.order_alignment(both, "l_orderkey", "i", "j")
