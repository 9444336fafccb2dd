"""SQL twins of the binding views, as CTE text for the oracle queries."""

LINES = """
lines AS (
  SELECT *, lpad(CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR), 2, '0')
         || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
         || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')
         || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 2, '0') AS line_id,
         CAST((l_partkey % 5) * 150 AS DOUBLE) AS bx,
         CAST((l_suppkey % 5) * 150 AS DOUBLE) AS byy,
         CAST(80 + 8 * l_linenumber AS DOUBLE) AS side,
         CAST(l_quantity AS BIGINT) AS q
  FROM lineitem)
"""

BOXES = LINES + """,
truth AS (
  SELECT l_orderkey AS page, line_id AS a, bx AS x0, byy AS y0, bx + side AS x1, byy + side AS y1, lines.*
  FROM lines WHERE l_linenumber <= 4),
pred AS (
  SELECT l_orderkey AS page, line_id || '-0' AS p, bx + q % 5 AS x0, byy + q % 3 AS y0,
         bx + side + q % 5 AS x1, byy + side + q % 3 AS y1, lines.*
  FROM lines WHERE NOT (l_returnflag = 'N' AND l_quantity > 40)
  UNION ALL
  SELECT l_orderkey, line_id || '-1', bx + q % 3, byy, bx + side + q % 3, byy + side, lines.*
  FROM lines WHERE l_returnflag = 'A' AND l_quantity <= 15),
couples AS (
  SELECT page, p, x0 AS px0, y0 AS py0, x1 AS px1, y1 AS py1,
         bx AS tx0, byy AS ty0, bx + side AS tx1, byy + side AS ty1, l_linenumber, l_quantity, l_tax
  FROM pred)
"""


def iou(a: str, b: str) -> str:
    """IoU text for two edge prefixes such as ``p.`` and ``t.``."""
    shared = (
        f"(greatest(0.0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0))"
        f" * greatest(0.0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"
    )
    area_a = f"({a}x1 - {a}x0) * ({a}y1 - {a}y0)"
    area_b = f"({b}x1 - {b}x0) * ({b}y1 - {b}y0)"
    return f"({shared} / ({area_a} + {area_b} - {shared}))"


PAIRS = BOXES + f""",
pairs AS (
  SELECT p.page, p.p, t.a, {iou('p.', 't.')} AS iou,
         p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1,
         t.x0 AS tx0, t.y0 AS ty0, t.x1 AS tx1, t.y1 AS ty1
  FROM pred p JOIN truth t ON p.page = t.page)
"""

# greedy one-to-one walk: one step per qualifying pair of a page
MATCH = PAIRS + """,
ranked AS (
  SELECT page, p, a, iou, row_number() OVER (PARTITION BY page ORDER BY iou DESC, p, a) AS rn
  FROM pairs WHERE iou >= 0.9),
walk AS (
  SELECT page, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS up, CAST([] AS VARCHAR[]) AS ua,
         CAST(NULL AS VARCHAR) AS p, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS DOUBLE) AS iou
  FROM (SELECT DISTINCT page FROM ranked)
  UNION ALL
  SELECT w.page, r.rn,
         CASE WHEN list_contains(w.up, r.p) OR list_contains(w.ua, r.a) THEN w.up ELSE list_append(w.up, r.p) END,
         CASE WHEN list_contains(w.up, r.p) OR list_contains(w.ua, r.a) THEN w.ua ELSE list_append(w.ua, r.a) END,
         CASE WHEN list_contains(w.up, r.p) OR list_contains(w.ua, r.a) THEN NULL ELSE r.p END,
         CASE WHEN list_contains(w.up, r.p) OR list_contains(w.ua, r.a) THEN NULL ELSE r.a END,
         r.iou
  FROM walk w JOIN ranked r ON r.page = w.page AND r.rn = w.k + 1),
matches AS (SELECT page, p, a, iou FROM walk WHERE p IS NOT NULL)
"""

WINDOWS = LINES + """,
wins AS (
  SELECT l_orderkey AS page, line_id AS seq,
         CAST((l_partkey % 3) * 6 + (l_suppkey % 2) * 150 AS DOUBLE) AS x,
         CAST((l_suppkey % 3) * 6 AS DOUBLE) AS y,
         CAST(80 + (l_partkey % 4) * 4 AS DOUBLE) AS side,
         1.0::DOUBLE + l_quantity / 50 AS score
  FROM lines)
"""

BOARDS = """
boards AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, embedding,
         array_to_string(list_transform(embedding, lambda v:
           CASE WHEN CAST(v AS DOUBLE) > 0.1::DOUBLE THEN 'P' WHEN CAST(v AS DOUBLE) < -0.1::DOUBLE THEN 'p' ELSE '.' END), '') AS cells,
         list_transform(embedding, lambda v: least(1.0::DOUBLE, 0.5::DOUBLE + abs(CAST(v AS DOUBLE)))) AS conf
  FROM embeddings),
labelled AS (
  SELECT b.*, t.truth_cells FROM boards b
  JOIN (SELECT label, arg_min(cells, vec_id) AS truth_cells FROM boards GROUP BY label) t ON b.label = t.label)
"""

RUNS = """
runs AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS user_id, ts,
         strftime(ts, '%Y-%m-%d') AS day, CAST(user_id % 3 AS BIGINT) AS engine, event_type,
         json_extract_string(props, '$.k') AS k,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS style,
         CASE event_type WHEN 'view' THEN 'no-board' WHEN 'error' THEN 'error' ELSE 'done' END AS phase,
         value AS ms, props,
         row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS run
  FROM events)
"""

OBS = LINES + """,
obs0 AS (
  SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'control' ELSE 'candidate' END AS candidate,
         l_orderkey AS page, line_id AS input_id,
         CASE l_returnflag WHEN 'A' THEN 'classifier' WHEN 'R' THEN 'manual' ELSE 'full-page' END AS stage,
         'style-' || CAST(l_partkey % 5 AS VARCHAR) AS style,
         CASE WHEN l_linestatus = 'O' THEN 'development' ELSE 'held-out' END AS split,
         'flag-' || l_returnflag AS tag1, 'size-' || CAST(q % 4 AS VARCHAR) AS tag2,
         CAST(l_linenumber AS BIGINT) AS repetition, l_linenumber = 1 AS cold, l_extendedprice AS ms,
         CASE WHEN l_linenumber = 1 THEN l_quantity END AS init_ms, l_returnflag = 'A' AS oracle,
         CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_tax > 0.07::DOUBLE THEN 0 ELSE 1 + CASE WHEN q > 25 THEN 1 ELSE 0 END END AS expected_boards,
         CASE WHEN l_returnflag = 'A' THEN 1 ELSE q % 3 END AS predictions,
         q, l_discount AS d, l_tax AS t FROM lines),
obs1 AS (
  SELECT *, CASE WHEN NOT oracle THEN CASE WHEN d < 0.05::DOUBLE THEN least(expected_boards, predictions)
              ELSE greatest(least(expected_boards, predictions) - 1, 0) END END AS matched FROM obs0),
obs2 AS (
  SELECT *, expected_boards - matched AS missed, predictions - matched AS false_positive,
         CASE WHEN oracle THEN NULL WHEN predictions - matched > 1 THEN 1 ELSE 0 END AS duplicate,
         CASE WHEN oracle THEN NULL WHEN t < 0.05::DOUBLE THEN matched ELSE 0 END AS aligned,
         CASE WHEN oracle THEN CASE WHEN d < 0.05::DOUBLE THEN 1 ELSE 0 END
              ELSE CASE WHEN t < 0.03::DOUBLE THEN matched ELSE 0 END END AS exact,
         expected_boards * 64 AS expected_squares,
         CASE WHEN t < 0.06::DOUBLE THEN predictions ELSE 0 END AS reliable,
         expected_boards - CASE WHEN q > 40 AND expected_boards > 0 THEN 1 ELSE 0 END AS identifiable,
         CASE WHEN q % 2 = 0 THEN predictions ELSE 0 END AS ambiguous_predictions,
         CASE WHEN repetition = 7 THEN predictions ELSE 0 END AS out_of_image
  FROM obs1),
obs3 AS (
  SELECT *, exact * 64 + (coalesce(matched, 1) - exact) * q AS correct_squares,
         least(reliable, exact) AS reliable_exact, reliable - least(reliable, exact) AS reliable_wrong,
         least(identifiable, exact) AS correct_orientations, expected_boards - identifiable AS ambiguous_truth,
         least(expected_boards - identifiable, ambiguous_predictions) AS ambiguity_acknowledged
  FROM obs2),
obs AS (
  SELECT *, least(reliable, reliable_wrong + greatest(reliable_exact - correct_orientations, 0)) AS reliable_wrong_study
  FROM obs3)
"""

# the running count of requests per key; answers may speak of the one before
REQUESTS = """
counted AS (
  SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS key, ts, event_type, value AS ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS latest
  FROM events),
requests AS (
  SELECT event_id, key, ts, epoch_us(ts) AS us, ms, latest,
         CASE WHEN event_type = 'signup' OR k < 50 THEN latest ELSE greatest(latest - 1, 1) END AS request_id,
         CASE event_type WHEN 'signup' THEN 'request' WHEN 'view' THEN 'phase' WHEN 'purchase' THEN 'result'
           WHEN 'error' THEN 'error' ELSE 'cancel' END AS kind,
         CASE event_type WHEN 'view' THEN if(k % 2 = 1, 'loading-model', 'recognizing') WHEN 'purchase' THEN if(k % 2 = 1, 'no-board', 'board') END AS detail
  FROM counted WHERE latest > 0)
"""

JUDGED = MATCH + "," + BOARDS + """,
jtruth AS (
  SELECT t.page, t.a, b.cells, CASE t.l_returnflag WHEN 'A' THEN 'white' WHEN 'R' THEN 'black' ELSE 'ambiguous' END AS orientation
  FROM truth t JOIN labelled b ON b.vec_id = t.l_suppkey),
jpred AS (
  SELECT p.page, p.p, p.x0, p.y0, p.x1, p.y1,
         CASE WHEN p.l_discount < 0.05::DOUBLE THEN b.cells WHEN p.l_discount < 0.08::DOUBLE THEN b.truth_cells ELSE reverse(b.cells) END AS cells,
         least(1.0::DOUBLE, list_min(b.conf) + p.l_discount * 4) AS min_conf,
         CASE WHEN p.l_linestatus = 'O' THEN 'white' ELSE 'black' END AS orientation, p.l_tax > 0.06::DOUBLE AS orientation_ambiguous
  FROM pred p JOIN labelled b ON b.vec_id = p.l_suppkey),
dup AS (
  SELECT DISTINCT q.page, q.p FROM pairs q JOIN matches m ON m.page = q.page AND m.a = q.a
  WHERE q.iou >= 0.9 AND NOT EXISTS (SELECT 1 FROM matches n WHERE n.page = q.page AND n.p = q.p)),
rec0 AS (
  SELECT p.page, p.p, false AS oracle, p.x0 >= 0 AND p.y0 >= 0 AND p.x1 <= 700 AND p.y1 <= 700 AS in_image, p.min_conf >= 0.7 AS reliable,
         m.a AS matched_a, d.p IS NOT NULL AS duplicate, m.iou,
         greatest(abs(q.px0 - q.tx0) * 8 / (q.tx1 - q.tx0), abs(q.px1 - q.tx1) * 8 / (q.tx1 - q.tx0), abs(q.py0 - q.ty0) * 8 / (q.ty1 - q.ty0), abs(q.py1 - q.ty1) * 8 / (q.ty1 - q.ty0)) AS grid_error,
         CASE WHEN m.a IS NOT NULL THEN CAST(len(list_filter(range(1, 65), lambda i: substr(p.cells, i, 1) = substr(t.cells, i, 1))) AS BIGINT) END AS correct_squares,
         CASE WHEN t.orientation <> 'ambiguous' THEN NOT p.orientation_ambiguous AND p.orientation = t.orientation END AS orientation_correct,
         coalesce(t.orientation = 'ambiguous', false) AS truth_ambiguous, p.orientation_ambiguous
  FROM jpred p LEFT JOIN matches m ON m.page = p.page AND m.p = p.p LEFT JOIN jtruth t ON t.page = m.page AND t.a = m.a
  LEFT JOIN pairs q ON q.page = m.page AND q.p = m.p AND q.a = m.a LEFT JOIN dup d ON d.page = p.page AND d.p = p.p),
records AS (
  SELECT *, correct_squares = 64 AS exact, reliable AND NOT coalesce(correct_squares = 64, false) AS reliable_wrong,
         reliable AND (NOT coalesce(correct_squares = 64, false) OR coalesce(orientation_correct, true) = false) AS reliable_wrong_study
  FROM rec0),
measured0 AS (
  SELECT o.o_orderkey AS page, false AS oracle, coalesce(t.n, 0) AS expected_boards, coalesce(t.ident, 0) AS identifiable,
         coalesce(r.n, 0) AS predictions, coalesce(r.matched, 0) AS matched, coalesce(r.dup, 0) AS duplicate, coalesce(r.aligned, 0) AS aligned,
         coalesce(r.exact, 0) AS exact, CAST(coalesce(r.correct, 0) AS BIGINT) AS correct_squares, coalesce(r.reliable, 0) AS reliable,
         coalesce(r.rexact, 0) AS reliable_exact, coalesce(r.rwrong, 0) AS reliable_wrong, coalesce(r.rwrongs, 0) AS reliable_wrong_study,
         coalesce(r.oc, 0) AS correct_orientations, coalesce(r.amb, 0) AS ambiguous_predictions, coalesce(r.ack, 0) AS ambiguity_acknowledged,
         coalesce(r.outside, 0) AS out_of_image
  FROM orders o
  LEFT JOIN (SELECT page, count(*) AS n, count(*) FILTER (WHERE orientation <> 'ambiguous') AS ident FROM jtruth GROUP BY page) t ON t.page = o.o_orderkey
  LEFT JOIN (SELECT page, count(*) AS n, count(matched_a) AS matched, count(*) FILTER (WHERE duplicate) AS dup,
      count(*) FILTER (WHERE grid_error <= 0.08::DOUBLE) AS aligned, count(*) FILTER (WHERE exact) AS exact, sum(correct_squares) AS correct,
      count(*) FILTER (WHERE reliable) AS reliable, count(*) FILTER (WHERE reliable AND exact) AS rexact, count(*) FILTER (WHERE reliable_wrong) AS rwrong,
      count(*) FILTER (WHERE reliable_wrong_study) AS rwrongs, count(*) FILTER (WHERE orientation_correct) AS oc,
      count(*) FILTER (WHERE orientation_ambiguous) AS amb, count(*) FILTER (WHERE truth_ambiguous AND orientation_ambiguous) AS ack,
      count(*) FILTER (WHERE NOT in_image) AS outside FROM records GROUP BY page) r ON r.page = o.o_orderkey),
measured AS (
  SELECT *, predictions - reliable AS unreliable, predictions = 0 AS no_board, expected_boards * 64 AS expected_squares,
         expected_boards - matched AS missed, predictions - matched AS false_positive, expected_boards - identifiable AS ambiguous_truth,
         matched / nullif(predictions, 0) AS precision, matched / nullif(expected_boards, 0) AS recall,
         exact / nullif(expected_boards, 0) AS exact_rate, correct_squares / nullif(expected_boards * 64, 0) AS square_rate
  FROM measured0)
"""

RAW = """
raw AS (
  SELECT event_id, case_id, session, run,
    CASE WHEN k >= 95 THEN 'unknown' WHEN k >= 90 THEN NULL ELSE phase END AS phase,
    CASE WHEN event_type = 'view' THEN CASE WHEN k < 10 THEN '4k3/8/8/8/8/8/8/4K3' END WHEN k < 40 THEN '4k3/8/8/8/8/8/8/4K3' WHEN k < 70 THEN '8/8/8/8/8/8/8/8' WHEN k < 80 THEN '44/8/8/8/8/8/8/8' END AS placement,
    CASE WHEN event_type = 'view' THEN CASE WHEN k < 5 THEN 'true' END WHEN value > 10 THEN 'true' WHEN value > 2 THEN 'false' ELSE 'maybe' END AS reliable,
    CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN NULL WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN NULL ELSE floor(value * 100) END AS total_ms,
    CASE WHEN k % 5 = 0 THEN 125.0 ELSE 7.0 END::DOUBLE AS stage_ms,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN run <> 0 ELSE run = 0 END AS cold, k % 29 = 0 AS old
  FROM (SELECT CAST(event_id AS BIGINT) AS event_id, CAST(user_id AS BIGINT) AS case_id, CAST(day(ts) % 4 AS BIGINT) AS session, CAST(hour(ts) % 2 AS BIGINT) AS run,
     CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value,
     CASE event_type WHEN 'view' THEN 'no-board' WHEN 'error' THEN 'error' ELSE 'done' END AS phase FROM events)),
assessed0 AS (SELECT *, CASE WHEN phase IN ('done', 'no-board', 'error') THEN phase END AS known, coalesce(phase = 'done' AND placement = '4k3/8/8/8/8/8/8/4K3', false) AS exact FROM raw),
assessed AS (SELECT *,
    list_filter([CASE WHEN known IS NULL THEN 'phase-missing-or-invalid' END, CASE WHEN known = 'error' THEN 'recognizer-error' END,
      CASE WHEN known = 'done' AND reliable = 'maybe' THEN 'reliable-missing-or-invalid' END,
      CASE WHEN known = 'done' AND coalesce(placement, '44/') LIKE '44/%' THEN 'placement-missing-or-invalid' END,
      CASE WHEN known = 'no-board' AND reliable IS NOT NULL THEN 'no-board-reliable-present' END, CASE WHEN known = 'no-board' AND placement IS NOT NULL THEN 'no-board-placement-present' END,
      CASE WHEN total_ms IS NULL THEN 'total-ms-missing-or-invalid' END, CASE WHEN cold IS NULL THEN 'cold-start-missing-or-invalid' END,
      CASE WHEN old THEN 'recognizer-version-mismatch' END], lambda x: x IS NOT NULL) AS infra,
    CASE WHEN known = 'done' AND reliable = 'true' AND NOT exact THEN 1 ELSE 0 END AS unsafe,
    CASE WHEN session > 2 THEN 'observation-identity-invalid' WHEN cold IS NULL OR cold <> (run = 0) THEN 'cold-sequence-invalid' END AS odd
  FROM assessed0)
"""

SUMMARY = """count(*) AS observations, bool_and(oracle) AS oracle, bool_or(oracle) AND NOT bool_and(oracle) AS mixed, CAST(sum(predictions - reliable) AS BIGINT) AS unreliable, count(*) FILTER (WHERE predictions = 0) AS no_board,
  CAST(sum(expected_boards) AS BIGINT) AS expected_boards, CAST(sum(predictions) AS BIGINT) AS predictions, CAST(sum(exact) AS BIGINT) AS exact,
  CAST(sum(correct_squares) AS BIGINT) AS correct_squares, CAST(sum(expected_squares) AS BIGINT) AS expected_squares, CAST(sum(reliable) AS BIGINT) AS reliable,
  CAST(sum(reliable_exact) AS BIGINT) AS reliable_exact, CAST(sum(reliable_wrong) AS BIGINT) AS reliable_wrong, CAST(sum(reliable_wrong_study) AS BIGINT) AS reliable_wrong_study,
  CAST(sum(identifiable) AS BIGINT) AS identifiable, CAST(sum(correct_orientations) AS BIGINT) AS correct_orientations, CAST(sum(ambiguous_truth) AS BIGINT) AS ambiguous_truth,
  CAST(sum(ambiguous_predictions) AS BIGINT) AS ambiguous_predictions, CAST(sum(ambiguity_acknowledged) AS BIGINT) AS ambiguity_acknowledged, CAST(sum(out_of_image) AS BIGINT) AS out_of_image,
  CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(matched), 0) AS BIGINT) END AS matched, CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(missed), 0) AS BIGINT) END AS missed,
  CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(false_positive), 0) AS BIGINT) END AS false_positive, CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(duplicate), 0) AS BIGINT) END AS duplicate,
  CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(aligned), 0) AS BIGINT) END AS aligned,
  CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(matched), 0) AS DOUBLE) / nullif(CAST(sum(predictions) AS DOUBLE), 0) END AS precision,
  CASE WHEN NOT bool_or(oracle) THEN CAST(coalesce(sum(matched), 0) AS DOUBLE) / nullif(CAST(sum(expected_boards) AS DOUBLE), 0) END AS recall,
  CAST(sum(exact) AS DOUBLE) / nullif(CAST(sum(expected_boards) AS DOUBLE), 0) AS exact_rate, CAST(sum(correct_squares) AS DOUBLE) / nullif(CAST(sum(expected_squares) AS DOUBLE), 0) AS square_rate,
  CAST(sum(correct_orientations) AS DOUBLE) / nullif(CAST(sum(identifiable) AS DOUBLE), 0) AS orientation_rate"""

PIXELS = """
px AS (
  SELECT CAST(vec_id AS BIGINT) AS img, CAST(i // 8 AS BIGINT) AS y, CAST(i % 8 AS BIGINT) AS x,
         CAST(greatest(0.0, least(255.0, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5::DOUBLE) * 255))) AS DOUBLE) AS v, label
  FROM embeddings, range(0, 64) t(i))
"""
