"""Readers, writers, the generator and small operators as queries over the driver's tables, each with its SQL.

What a writer writes goes to the shared folder and is read back, so that a
query's result holds only if both sides are right.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quintet.functions import jsontree, scalars
from quintet.operators import evaluate, generate, load, registry, vectorize
from quintet.plans import events
from quintet.plans.catalogue import EVENT_VOTE_SQL, GRADED_SQL, PAIRS_SQL, SCORE_SQL, STAGES, dims, event_search, grades, q1_knn_vote, query, vote_sql
from quintet.plans.events import table
from quintet.session import cut, shared_folder
from quintet.sources import readers, sinks
from quintet.operators import knn

NAMES = {i: f"d{i}" for i in range(14)}
LISTED = ", ".join(NAMES.values())


@query(events.FEATURES_SQL + f"SELECT event_id, {LISTED} FROM vectors")
def q27_requests_round_trip(spark, sf_dir):
    """Transactions written as JSON lines, read by the fixed schema and made into vectors."""
    folder = shared_folder(spark, "requests")
    sinks.write_lines(cut(events.transactions(spark, sf_dir)), sinks.request_json(), folder)
    back = readers.transaction_lines(spark, folder)
    return back.select(F.col("id").cast("long").alias("event_id"), *dims(vectorize.vector(events.SCALE, events.RISK), NAMES))


@query(events.FEATURES_SQL + f"SELECT event_id, {LISTED} FROM vectors")
def q28_requests_array(spark, sf_dir):
    """The same from one JSON array."""
    folder = shared_folder(spark, "array")
    sinks.write_array(cut(events.transactions(spark, sf_dir)), sinks.request_json(), "idx", folder)
    return readers.transactions(spark, folder).select(F.col("id").cast("long").alias("event_id"), *dims(vectorize.vector(events.SCALE, events.RISK), NAMES))


@query(events.FEATURES_SQL + f"SELECT row_number() OVER (ORDER BY event_id) - 1 AS ref_idx, CASE WHEN event_type = 'error' THEN 'fraud' ELSE 'legit' END AS label, {LISTED} FROM vectors")
def q29_references_round_trip(spark, sf_dir):
    """Labelled vectors written as one JSON array, read back with their place in it, and kept as Parquet by bucket."""
    rows = cut(events.transactions(spark, sf_dir).select("idx", vectorize.vector(events.SCALE, events.RISK).alias("vector"), F.when(F.col("event_type") == "error", "fraud").otherwise("legit").alias("label")))
    folder = shared_folder(spark, "references")
    sinks.write_array(rows, sinks.reference_json(), "idx", f"{folder}/json")
    sinks.references_parquet(readers.references(spark, f"{folder}/json"), f"{folder}/parquet")
    return spark.read.parquet(f"{folder}/parquet").select("ref_idx", "label", *dims(F.col("vector"), NAMES))


RISK_TEXT = json.dumps(events.RISK)
RISK_SQL = " UNION ALL ".join(f"SELECT '{k}' AS code, CAST({v} AS DOUBLE) AS risk" for k, v in events.RISK.items())


@query(f"WITH r AS ({RISK_SQL}) SELECT e.event_id, coalesce(r.risk, CAST(0.5 AS DOUBLE)) AS mcc_risk, sha256('{RISK_TEXT}') AS checksum FROM events e LEFT JOIN r ON r.code = e.event_type")
def q30_risk_file(spark, sf_dir):
    """A risk map replaced as a file, read as a table and looked up, beside the checksum of its bytes."""
    path = shared_folder(spark, "risk") + ".json"
    sinks.replace_file(spark, path, "{}")
    sinks.replace_file(spark, path, RISK_TEXT)
    rows = vectorize.mcc_risk_join(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", readers.risk_table(spark, path))
    return rows.join(F.broadcast(readers.checksum(spark, path).select(F.col("sha256").alias("checksum")))).select("event_id", "mcc_risk", "checksum")


@query("SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in events.SCALE.to_dict().items()))
def q31_scale_file(spark, sf_dir):
    path = shared_folder(spark, "scale") + ".json"
    sinks.replace_file(spark, path, json.dumps(events.SCALE.to_dict()))
    return spark.createDataFrame([tuple(readers.scale(spark, path).to_dict().values())], ", ".join(f"{k} double" for k in events.SCALE.to_dict()))


LABELLED_SQL = EVENT_VOTE_SQL.replace("SELECT q_id, CAST(", ", said AS (SELECT q_id, CAST(", 1) + """)
SELECT row_number() OVER (ORDER BY q_id) - 1 AS idx, CAST(q_id AS VARCHAR) AS id, approved AS expected_approved, fraud_score AS expected_fraud_score,
  count(*) OVER () AS total, count(*) FILTER (NOT approved) OVER () AS fraud_count, count(*) FILTER (fraud_score = CAST(0.6 AS DOUBLE)) OVER () AS edge_case_count FROM said
"""


@query(LABELLED_SQL)
def q32_labelled_file(spark, sf_dir):
    """Transactions labelled by their neighbours, written as one labelled file with its stats, and read back."""
    rows = events.transactions(spark, sf_dir)
    q, r = event_search(spark, sf_dir)
    votes = knn.voted(q, r, leave_out_self=True).select(F.col("q_id").alias("idx"), F.col("approved").alias("expected_approved"), F.col("fraud_score").alias("expected_fraud_score"))
    entries = cut(rows.join(votes, "idx"))
    folder = shared_folder(spark, "labelled")
    sinks.write_test_data(entries, generate.stats(entries), "0" * 64, folder)
    back, stats = readers.test_data(spark, folder)
    return back.select(F.col("idx").cast("long").alias("idx"), "id", "expected_approved", "expected_fraud_score").join(F.broadcast(stats.select("total", "fraud_count", "edge_case_count")))


def results(spark, sf_dir):
    """events as results: a user is a participant, a type a submission."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").cast("string").alias("participant"), F.col("event_type").alias("submission"),
        F.round("value", 2).alias("score"), F.date_format(F.col("ts").cast("timestamp"), scalars.ISO).alias("timestamp"),
    )


@query("""
WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS participant, event_type AS submission, round(value, 2) AS score, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, event_id % 2 AS new FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY participant, submission, new ORDER BY timestamp DESC, event_id DESC) AS n, max(new) OVER (PARTITION BY participant, submission) AS newest FROM r)
SELECT participant, submission, score, timestamp FROM n WHERE n = 1 AND new = newest
""")
def q33_registry_file(spark, sf_dir):
    """A registry after an upsert, written as one nested JSON file that replaces the old one, and read back."""
    rows = results(spark, sf_dir)
    once = lambda new: registry.latest(rows.filter(F.col("event_id") % 2 == new), ["participant", "submission"], ["timestamp", "event_id"]).drop("event_id")
    path = shared_folder(spark, "registry") + ".json"
    result = "score double, timestamp string"
    sinks.write_registry(once(0), path)
    sinks.write_registry(registry.upsert(readers.registry(spark, path, result), once(1)), path)
    return readers.registry(spark, path, result)


@query("""
WITH s AS (SELECT CAST(user_id AS VARCHAR) AS participant, event_type AS id, min(event_id) AS first FROM events GROUP BY 1, 2),
d AS (SELECT participant, min_by(id, first) AS id FROM s GROUP BY 1)
SELECT participant, id AS submission, 'repo-' || id AS repo FROM d UNION ALL SELECT participant, 'click' AS submission, max(CASE WHEN id = 'click' THEN 'repo-click' END) AS repo FROM s GROUP BY 1
""")
def q34_resolve(spark, sf_dir):
    """Submissions asked for by name, and by "default", among each participant's list in order."""
    first = results(spark, sf_dir).groupBy("participant", "submission").agg(F.min("event_id").alias("first"))
    one = F.struct(F.col("submission").alias("id"), F.concat(F.lit("repo-"), F.col("submission")).alias("repo"))
    people = first.groupBy("participant").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", one.alias("s")))), lambda x: x["s"]).alias("submissions"))
    asked = people.select("participant", F.explode(F.array(F.lit("default"), F.lit("click"))).alias("submission"))
    return registry.resolve(people, asked).select("participant", "submission", "repo")


@query("""
WITH t AS (SELECT event_id, '{"id":' || event_id || ',"text":"// kept /* too */ \\" ","props":' || replace(props, ' ', '') || '}' AS want FROM events)
SELECT event_id, want AS minified, event_id = event_id AS equal, event_id % 2 = 0 AS equal_to_even FROM t
""")
def q35_json_texts(spark, sf_dir):
    """Commented JSON minified, and compared with the same members in another order and number format."""
    kept = '"// kept /* too */ \\" "'
    join = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    text = join("{ // a comment\n  \"id\" : ", F.col("event_id").cast("string"), f' , /* "x" */ "text" : {kept} , "props" : ', F.col("props"), " }")
    rows = table(spark, sf_dir, "events").select("event_id", "props", text.alias("text"))
    other = lambda ident: join('{"props": ', F.col("props"), f', "text": {kept}, "id": ', ident, ".0}")
    even = (F.col("event_id") - F.col("event_id") % 2).cast("string")
    small = jsontree.minify("text")
    return rows.select("event_id", small.alias("minified"), jsontree.compare(small, other(F.col("event_id").cast("string"))).alias("equal"), jsontree.compare(small, other(even)).alias("equal_to_even"))


@query("""
WITH t AS (SELECT event_id, unnest([value / 3, value * 1e20, value / 1e12, round(value), 0 - value]) AS x, unnest([0, 1, 2, 3, 4]) AS way FROM events),
p AS (SELECT *, CASE WHEN abs(x) < 1e16 AND x = CAST(CAST(x AS DECIMAL(38, 0)) AS DOUBLE) AND x BETWEEN -2147483648 AND 2147483647 THEN CAST(CAST(x AS INT) AS VARCHAR) END AS whole, printf('%.15g', x) AS short, printf('%.17g', x) AS long FROM t)
SELECT event_id, way, coalesce(whole, CASE WHEN abs(CAST(short AS DOUBLE) - x) <= greatest(abs(CAST(short AS DOUBLE)), abs(x)) * 2.220446049250313e-16 THEN short ELSE long END) AS text FROM p
""")
def q36_json_numbers(spark, sf_dir):
    v = F.col("value")
    ways = F.posexplode(F.array(v / 3.0, v * 1e20, v / 1e12, F.round(v), F.lit(0.0) - v)).alias("way", "x")
    return table(spark, sf_dir, "events").select("event_id", ways).select("event_id", "way", jsontree.number_text("x").alias("text"))


@query(PAIRS_SQL + ", votes AS (" + vote_sql() + """),
c AS (SELECT count(*) AS t, count(*) FILTER (NOT approved) AS f, count(*) FILTER (approved) AS l, count(*) FILTER (fraud_score = CAST(0.6 AS DOUBLE)) AS e FROM votes)
SELECT printf('Stats: total=%d fraud=%d (%.1f%%) legit=%d (%.1f%%) edge=%d (%.1f%%)', t, f, CAST(100 AS DOUBLE) * f / t, l, CAST(100 AS DOUBLE) * l / t, e, CAST(100 AS DOUBLE) * e / t) AS line FROM c
""")
def q37_stats_line(spark, sf_dir):
    return sinks.stats_line(evaluate.label_stats(q1_knn_vote(spark, sf_dir)))


SHOWN = "regexp_replace(printf('%.10f', {}), '\\.?0+$', '')"


@query(GRADED_SQL + ", counts_p99 AS (SELECT counts.*, (SELECT quantile_cont(value, 0.99) FROM events) AS p99 FROM counts), final AS (SELECT * FROM (WITH " + SCORE_SQL.strip() + """))
SELECT printf('%.2fms', p99) AS p99, """ + SHOWN.format("round(failure_rate * 100, 2)") + """ || '%' AS failure_rate, weighted_errors AS weighted_errors_E, round(detection_score, 2) AS detection, round(final_score, 2) AS final_score,
  fp AS false_positive_detections, detection_score <= -3000 AS detection_cut FROM final
""")
def q38_report_file(spark, sf_dir):
    """The score report written as indented JSON and read back."""
    from quintet.plans.catalogue import table as of

    counts = evaluate.confusion(grades(spark, sf_dir)).crossJoin(evaluate.p99(of(spark, sf_dir, "events"), "value"))
    folder = shared_folder(spark, "report")
    sinks.write_report(evaluate.report(evaluate.scored(counts)), folder)
    schema = "p99 string, scoring struct<breakdown:struct<false_positive_detections:bigint>,failure_rate:string,weighted_errors_E:bigint,detection_score:struct<value:double,cut_triggered:boolean>,final_score:double>"
    back = spark.read.schema(schema).option("multiLine", True).json(folder)
    return back.select(
        "p99", "scoring.failure_rate", "scoring.weighted_errors_E", F.col("scoring.detection_score.value").alias("detection"), "scoring.final_score",
        "scoring.breakdown.false_positive_detections", F.col("scoring.detection_score.cut_triggered").alias("detection_cut"),
    )


TABLE_NAMES = ("stage", "duration", "from", "to", "stage_reqs", "cumulative")
TABLE_SQL = """
WITH s(stage_no, duration_s, target) AS (VALUES (1, 120, 900), (2, 60, 900), (3, 45, 100)),
f AS (SELECT *, lag(target, 1, 1) OVER (ORDER BY stage_no) AS from_rate FROM s),
r AS (SELECT *, (from_rate + target) * duration_s // 2 AS reqs FROM f),
c AS (SELECT stage_no AS place, [CAST(stage_no AS VARCHAR), duration_s || 's', CAST(from_rate AS VARCHAR), CAST(target AS VARCHAR), CAST(reqs AS VARCHAR), CAST(sum(reqs) OVER (ORDER BY stage_no) AS VARCHAR)] AS cells FROM r
  UNION ALL SELECT max(stage_no) + 2, ['total', sum(duration_s) || 's', '1', CAST(max_by(target, stage_no) AS VARCHAR), '', CAST(sum(reqs) AS VARCHAR)] FROM r),
names AS (SELECT ['stage', 'duration', 'from', 'to', 'stage_reqs', 'cumulative'] AS n),
widths AS (SELECT [greatest(max(length(cells[1])), 5), greatest(max(length(cells[2])), 8), greatest(max(length(cells[3])), 4), greatest(max(length(cells[4])), 2), greatest(max(length(cells[5])), 10), greatest(max(length(cells[6])), 10)] AS w FROM c),
lines AS (SELECT place, '│ ' || array_to_string([lpad(cells[1], w[1]::INT, ' '), lpad(cells[2], w[2]::INT, ' '), lpad(cells[3], w[3]::INT, ' '), lpad(cells[4], w[4]::INT, ' '), lpad(cells[5], w[5]::INT, ' '), lpad(cells[6], w[6]::INT, ' ')], ' │ ') || ' │' AS line FROM c, widths
  UNION ALL SELECT -1, '│ ' || array_to_string([rpad(n[1], w[1]::INT, ' '), rpad(n[2], w[2]::INT, ' '), rpad(n[3], w[3]::INT, ' '), rpad(n[4], w[4]::INT, ' '), rpad(n[5], w[5]::INT, ' '), rpad(n[6], w[6]::INT, ' ')], ' │ ') || ' │' FROM names, widths
  UNION ALL SELECT k, l || array_to_string([repeat('─', w[1] + 2), repeat('─', w[2] + 2), repeat('─', w[3] + 2), repeat('─', w[4] + 2), repeat('─', w[5] + 2), repeat('─', w[6] + 2)], '|').replace('|', m) || e FROM widths, (VALUES (-2, '┌', '┬', '┐'), (0, '├', '┼', '┤'), (4, '├', '┼', '┤'), (6, '└', '┴', '┘')) b(k, l, m, e))
SELECT CAST(place AS BIGINT) AS place, line FROM lines
"""


@query(TABLE_SQL)
def q39_load_table(spark, sf_dir):
    script = "startRate: 1, stages: [" + ", ".join(f"{{ duration: '{d}s', target: {t} }}" for _, d, t in STAGES) + "]"
    stages, start = load.stages_of(spark, script)
    return load.table_lines(load.estimated(stages, start), start).withColumnRenamed("at", "place")


@query("""
SELECT event_id, ((x >> 7) | (x << 25)) & 4294967295 AS rotated, xor(x, x >> 3) AS xored, (x << 5) & 4294967295 AS shifted, x >> 11 AS down, 'EV-' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(7, length(CAST(event_id AS VARCHAR))) AS INT), '0') AS numbered,
  round(value * 100) / 100 AS cents, left(event_type, 3) AS code, (minute(ts) * 60 + second(ts)) / CAST(60 AS DOUBLE) AS minutes
FROM (SELECT *, event_id * 2654435761 % 4294967296 AS x FROM events)
""")
def q40_small_functions(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    rows = table(spark, sf_dir, "events").withColumn("x", F.col("event_id") * F.lit(2654435761) % F.lit(1 << 32))
    return rows.select(
        "event_id", scalars.rotated_right("x", 7).alias("rotated"), scalars.xored("x", scalars.shifted_right("x", 3)).alias("xored"), scalars.shifted_left("x", 5).alias("shifted"), scalars.shifted_right("x", 11).alias("down"),
        scalars.numbered("EV-", "event_id", 7).alias("numbered"), scalars.round2("value").alias("cents"), scalars.code("event_type", 3).alias("code"), scalars.minutes_between(at, F.date_trunc("hour", at)).alias("minutes"),
    )


SEED, DRAWS = 42, 20_000
MULTIPLIER, TURN = 6364136223846793005, 1 << 64
#: The generator's recurrence written out in 128-bit numbers.
STREAM_SQL = f"""
WITH RECURSIVE s(i, st) AS (SELECT 0, ((CAST({2 * SEED + 1} AS HUGEINT) + {SEED}) * {MULTIPLIER} + {2 * SEED + 1}) % {TURN}
  UNION ALL SELECT i + 1, (st * {MULTIPLIER} + {2 * SEED + 1}) % {TURN} FROM s WHERE i < {DRAWS - 1}),
w AS (SELECT i, CAST(xor(st // 262144, st) // 134217728 % 4294967296 AS BIGINT) AS word, CAST(st // {1 << 59} AS INT) AS turn FROM s),
d AS (SELECT i, ((word >> turn) | (word << ((32 - turn) % 32))) & 4294967295 AS draw FROM w)
SELECT CAST(i AS BIGINT) AS i, draw, draw / CAST(4294967295 AS DOUBLE) AS unit FROM d
"""


@query(STREAM_SQL)
def q41_random_stream(spark, sf_dir):
    """The numbers that the exact generator draws from."""
    return generate.stream(spark, SEED, DRAWS)
