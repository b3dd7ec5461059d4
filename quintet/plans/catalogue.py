"""The engine's operators as queries over the driver's tables, each with the SQL that it must equal.

On embeddings a vector is fraud if its label is below 3 and its reference index
is vec_id; neighbours are found among all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.functions import jsontree, scalars
from quintet.operators import evaluate, generate, knn, load, registry, vectorize
from quintet.plans import events
from quintet.plans.events import table
from quintet.schema import FIELDS
from quintet.session import cut

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL if it has one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return put


def embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, references) of embeddings."""
    rows = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding").cast("array<double>").alias("vector")
    return rows.select(F.col("vec_id").alias("q_id"), vector), rows.select(F.col("vec_id").alias("ref_idx"), vector, F.when(F.col("label") < 3, "fraud").otherwise("legit").alias("label"))


D2 = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), lambda s, x: s + x)"
PAIRS_SQL = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS q_id, b.vec_id AS ref_idx, CASE WHEN b.label < 3 THEN 'fraud' ELSE 'legit' END AS label, {D2} AS d2 FROM e a JOIN e b ON a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, ref_idx) AS rank FROM pairs)
"""


def vote_sql(k: int = 5, threshold: str = "0.6") -> str:
    return f"SELECT q_id, count(*) FILTER (label = 'fraud') AS fraud_n, round(count(*) FILTER (label = 'fraud') / CAST({k} AS DOUBLE) * 10000) / 10000 AS fraud_score, count(*) FILTER (label = 'fraud') / CAST({k} AS DOUBLE) < CAST({threshold} AS DOUBLE) AS approved FROM ranked WHERE rank <= {k} GROUP BY q_id"


VOTE_SQL = PAIRS_SQL + vote_sql()


@query(VOTE_SQL)
def q1_knn_vote(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    return knn.vote(q, knn.neighbours(q, r, leave_out_self=True))


@query(PAIRS_SQL + "SELECT q_id, rank, ref_idx, label, round(d2, 6) AS d2 FROM ranked WHERE rank <= 5")
def q2_knn_neighbours(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    found = knn.neighbours(q, r, leave_out_self=True)
    return found.select("q_id", F.col("rank").cast("long").alias("rank"), "ref_idx", "label", F.round("d2", 6).alias("d2"))


@query(PAIRS_SQL + "SELECT q_id, rank, ref_idx, label, round(d2, 6) AS d2 FROM ranked WHERE rank <= 5")
def q2_knn_neighbours_sql(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    found = knn.neighbours_sql(q, r, leave_out_self=True)
    return found.select("q_id", F.col("rank").cast("long").alias("rank"), "ref_idx", "label", F.round("d2", 6).alias("d2"))


@query(PAIRS_SQL + "SELECT q_id, rank, ref_idx, label, round(d2, 6) AS d2 FROM ranked WHERE rank <= 5")
def q2_knn_neighbours_grid(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    found = knn.grid_search(q, r, 5, True, blocks=4)
    return found.select("q_id", F.col("rank").cast("long").alias("rank"), "ref_idx", "label", F.round("d2", 6).alias("d2"))


ZERO = [0.0] * 64


@query("""
SELECT vec_id AS ref_idx, CASE WHEN label < 3 THEN 'fraud' ELSE 'legit' END AS label,
  round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda s, x: s + x), 6) AS d2
FROM embeddings ORDER BY list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), lambda s, x: s + x), vec_id LIMIT 5
""")
def q3_single_query(spark, sf_dir):
    _, r = embedded(spark, sf_dir)
    return knn.closest(r, ZERO).withColumn("d2", F.round("d2", 6))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
z AS (SELECT v AS o FROM e WHERE vec_id = (SELECT min(vec_id) FROM e)),
p AS (SELECT vec_id,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(v, o), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), lambda s, x: s + x) AS d2,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(v, o), lambda t: abs(t[1] - t[2]))), lambda s, x: s + x) AS d1,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(v, o), lambda t: t[1] * t[2])), lambda s, x: s + x) AS vo,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(v, v), lambda t: t[1] * t[2])), lambda s, x: s + x) AS vv,
  list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(o, o), lambda t: t[1] * t[2])), lambda s, x: s + x) AS oo FROM e, z)
SELECT vec_id, round(sqrt(d2), 6) AS l2, round(d1, 6) AS l1, round(1 - vo / (sqrt(vv) * sqrt(oo)), 6) + 0 AS cosine FROM p
""")
def q4_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = rows.agg(F.min_by("v", "vec_id").alias("o"))
    both = rows.join(F.broadcast(one))
    return both.select("vec_id", F.round(scalars.l2("v", "o"), 6).alias("l2"), F.round(scalars.l1("v", "o"), 6).alias("l1"), (F.round(scalars.cosine("v", "o"), 6) + F.lit(0.0)).alias("cosine"))


@query("""
SELECT event_id, hour(ts) / CAST(23 AS DOUBLE) AS hour_of_day, (isodow(ts) - 1) / CAST(6 AS DOUBLE) AS day_of_week,
  CASE WHEN value / 100 > 1 THEN CAST(1 AS DOUBLE) ELSE round(value / 100 * 10000) / 10000 END AS amount, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
  CAST(epoch_us(ts) // 1000000 AS BIGINT) AS epoch FROM events
""")
def q5_feature_scalars(spark, sf_dir):
    at = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", (F.hour(at) / 23.0).alias("hour_of_day"), (scalars.day_of_week(at) / 6.0).alias("day_of_week"),
        scalars.round4(scalars.clamp01(F.col("value") / 100.0)).alias("amount"),
        scalars.iso_of(F.unix_timestamp(at)).alias("iso"), scalars.epoch_of(scalars.iso_of(F.unix_timestamp(at))).alias("epoch"),
    )


def feature_rows(spark, sf_dir, risk=None):
    return events.transactions(spark, sf_dir).select("idx", "event_type", vectorize.vector(events.SCALE, events.RISK if risk is None else risk).alias("vector"))


def dims(vector, names):
    return [F.element_at(vector, i + 1).alias(n) for i, n in names.items()]


@query(events.FEATURES_SQL + "SELECT event_id, d5 AS minutes, d6 AS km FROM vectors")
def q6_sentinels(spark, sf_dir):
    f = vectorize.features(events.SCALE, events.RISK)
    return events.transactions(spark, sf_dir).select(
        F.col("idx").alias("event_id"), scalars.round4(f["minutes_since_last"]).alias("minutes"), scalars.round4(f["km_from_last"]).alias("km")
    )


@query("""
SELECT event_id, CASE event_type WHEN 'view' THEN CAST(0.15 AS DOUBLE) WHEN 'click' THEN CAST(0.30 AS DOUBLE) WHEN 'signup' THEN CAST(0.45 AS DOUBLE) WHEN 'error' THEN CAST(0.80 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS mcc_risk FROM events
""")
def q7_mcc_lookup(spark, sf_dir):
    risk = spark.createDataFrame(list(events.RISK.items()), "code string, risk double")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return vectorize.mcc_risk_join(rows, "event_type", risk).select("event_id", "mcc_risk")


@query(events.FEATURES_SQL + "SELECT event_id, d11 AS unknown_merchant FROM vectors")
def q8_unknown_merchant(spark, sf_dir):
    f = vectorize.features(events.SCALE, events.RISK)
    return events.transactions(spark, sf_dir).select(F.col("idx").alias("event_id"), scalars.round4(f["unknown_merchant"]).alias("unknown_merchant"))


@query("""
WITH one AS (SELECT user_id, event_type, min(epoch_us(ts)) AS first FROM events GROUP BY 1, 2)
SELECT e.event_id, e.user_id FROM events e WHERE EXISTS (SELECT 1 FROM one o WHERE o.user_id = e.user_id AND o.event_type = e.event_type AND o.first = epoch_us(e.ts))
""")
def q8_first_visits(spark, sf_dir):
    """Membership as a relation: events that are the first of their user and type."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    first = rows.groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    return rows.join(first, ["user_id", "event_type", "ts"], "left_semi").select("event_id", "user_id")


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS tx_count_24h FROM events
""")
def q9_tx_count_24h(spark, sf_dir):
    return events.history(table(spark, sf_dir, "events")).select("event_id", F.col("tx24").alias("tx_count_24h"))


@query(events.FEATURES_SQL + "SELECT event_id, " + ", ".join(f"d{i}" for i in range(14)) + " FROM vectors")
def q10_feature_vectors(spark, sf_dir):
    return feature_rows(spark, sf_dir).select(F.col("idx").alias("event_id"), *dims(F.col("vector"), {i: f"d{i}" for i in range(14)}))


EVENT_D2 = "CAST(0 AS DOUBLE) + " + " + ".join(f"(a.d{i} - b.d{i}) * (a.d{i} - b.d{i})" for i in range(14))
EVENT_VOTE_SQL = events.FEATURES_SQL.replace("WHEN 'view' THEN CAST(0.15 AS DOUBLE) WHEN 'click' THEN CAST(0.30 AS DOUBLE) WHEN 'signup' THEN CAST(0.45 AS DOUBLE) WHEN 'error' THEN CAST(0.80 AS DOUBLE)", "WHEN '' THEN CAST(0 AS DOUBLE)") + f"""
, best AS (SELECT a.event_id AS q_id, min({{'d2': {EVENT_D2}, 'idx': b.event_id, 'label': b.event_type}}, 5) AS five
  FROM vectors a JOIN vectors b ON a.event_id <> b.event_id GROUP BY 1)
SELECT q_id, CAST(len(list_filter(five, lambda x: x.label = 'error')) AS BIGINT) AS fraud_n,
  round(len(list_filter(five, lambda x: x.label = 'error')) / CAST(5 AS DOUBLE) * 10000) / 10000 AS fraud_score,
  len(list_filter(five, lambda x: x.label = 'error')) / CAST(5 AS DOUBLE) < CAST(0.6 AS DOUBLE) AS approved FROM best
"""  # fmt: skip


def event_search(spark, sf_dir):
    """(queries, references) of events; an error event is fraud, and its type is in no feature."""
    rows = cut(feature_rows(spark, sf_dir, {}))
    return rows.select(F.col("idx").alias("q_id"), "vector"), rows.select(F.col("idx").alias("ref_idx"), "vector", F.when(F.col("event_type") == "error", "fraud").otherwise("legit").alias("label"))


@query(EVENT_VOTE_SQL)
def q11_vectorize_knn_vote(spark, sf_dir):
    q, r = event_search(spark, sf_dir)
    return knn.voted(q, r, leave_out_self=True)


@query(EVENT_VOTE_SQL)
def q21_bucketed_knn(spark, sf_dir):
    q, r = event_search(spark, sf_dir)
    return knn.voted(q, r, leave_out_self=True, first=knn.BUCKETS)


@query(PAIRS_SQL + ", votes AS (" + vote_sql() + """)
SELECT count(*) AS total, count(*) FILTER (NOT approved) AS fraud_count, count(*) FILTER (approved) AS legit_count,
  round(count(*) FILTER (NOT approved) / CAST(count(*) AS DOUBLE) * 10000) / 10000 AS fraud_rate, round(count(*) FILTER (approved) / CAST(count(*) AS DOUBLE) * 10000) / 10000 AS legit_rate,
  count(*) FILTER (fraud_score = CAST(0.6 AS DOUBLE)) AS edge_case_count, round(count(*) FILTER (fraud_score = CAST(0.6 AS DOUBLE)) / CAST(count(*) AS DOUBLE) * 10000) / 10000 AS edge_case_rate FROM votes
""")
def q12_label_stats(spark, sf_dir):
    return evaluate.label_stats(q1_knn_vote(spark, sf_dir))


GRADED_SQL = PAIRS_SQL + ", votes AS (" + vote_sql() + """),
graded AS (SELECT v.q_id, v.approved, e.label >= 3 AS expected_approved, CASE WHEN e.label = 9 THEN 500 ELSE 200 END AS status FROM votes v JOIN embeddings e ON e.vec_id = v.q_id),
counts AS (SELECT count(*) FILTER (status = 200 AND approved = expected_approved AND NOT approved) AS tp, count(*) FILTER (status = 200 AND approved = expected_approved AND approved) AS tn,
  count(*) FILTER (status = 200 AND approved <> expected_approved AND NOT approved) AS fp, count(*) FILTER (status = 200 AND approved <> expected_approved AND approved) AS fn,
  count(*) FILTER (status <> 200) AS errors FROM graded)
"""  # fmt: skip


def grades(spark, sf_dir):
    """Votes on embeddings as responses; vectors of label 9 stand for failed requests."""
    rows = table(spark, sf_dir, "embeddings")
    expected = rows.select(F.col("vec_id").alias("idx"), (F.col("label") >= 3).alias("expected_approved"), F.when(F.col("label") == 9, 500).otherwise(200).alias("status"))
    said = q1_knn_vote(spark, sf_dir).select(F.col("q_id").alias("idx"), "approved")
    return evaluate.graded(expected, said.join(expected.select("idx", "status"), "idx"))


@query(GRADED_SQL + "SELECT * FROM counts")
def q13_confusion(spark, sf_dir):
    return evaluate.confusion(grades(spark, sf_dir))


@query("SELECT round(quantile_cont(value, 0.99), 9) AS p99 FROM events")
def q14_p99(spark, sf_dir):
    return evaluate.p99(table(spark, sf_dir, "events"), "value").select(F.round("p99", 9).alias("p99"))


SCORE_SQL = """
n AS (SELECT *, tp + tn + fp + fn + errors AS n, fp + 3 * fn + 5 * errors AS weighted_errors, fp + fn + errors AS failures FROM counts_p99),
r AS (SELECT *, CASE WHEN n > 0 THEN weighted_errors / CAST(n AS DOUBLE) ELSE 0 END AS epsilon, CASE WHEN n > 0 THEN failures / CAST(n AS DOUBLE) ELSE 0 END AS failure_rate FROM n),
s AS (SELECT *, CASE WHEN p99 <= 0 THEN CAST(0 AS DOUBLE) WHEN p99 > 2000 THEN CAST(-3000 AS DOUBLE) ELSE 1000 * log10(1000 / greatest(p99, CAST(1 AS DOUBLE))) END AS p99_score,
  CASE WHEN NOT failure_rate > CAST(0.15 AS DOUBLE) THEN 1000 * log10(1 / greatest(epsilon, CAST(0.001 AS DOUBLE))) END AS rate_component,
  CASE WHEN NOT failure_rate > CAST(0.15 AS DOUBLE) THEN 0 - 300 * log10(CAST(1 + weighted_errors AS DOUBLE)) END AS absolute_penalty FROM r),
t AS (SELECT *, coalesce(rate_component + absolute_penalty, CAST(-3000 AS DOUBLE)) AS detection_score FROM s)
SELECT tp, tn, fp, fn, errors, round(p99, 6) AS p99, CAST(weighted_errors AS BIGINT) AS weighted_errors, round(epsilon, 6) AS epsilon, round(failure_rate, 6) AS failure_rate, round(p99_score, 4) AS p99_score,
  round(rate_component, 4) AS rate_component, round(absolute_penalty, 4) AS absolute_penalty, round(detection_score, 4) AS detection_score, round(p99_score + detection_score, 4) AS final_score FROM t
"""


def shown(scores: DataFrame) -> DataFrame:
    four = [F.round(c, 4).alias(c) for c in ("p99_score", "rate_component", "absolute_penalty", "detection_score", "final_score")]
    return scores.select("tp", "tn", "fp", "fn", "errors", *[F.round(c, 6).alias(c) for c in ("p99", "epsilon", "failure_rate")], "weighted_errors", *four)


@query(GRADED_SQL + ", counts_p99 AS (SELECT counts.*, (SELECT quantile_cont(value, 0.99) FROM events) AS p99 FROM counts)," + SCORE_SQL)
def q15_score_report(spark, sf_dir):
    counts = evaluate.confusion(grades(spark, sf_dir)).crossJoin(evaluate.p99(table(spark, sf_dir, "events"), "value"))
    return shown(evaluate.scored(counts))


#: The scoring examples (fp, fn, errors, p99 in ms) over 5,000 requests, and the edges of the rules.
ANCHORS = [
    (0, 0, 0, 1.0, 5000), (5, 5, 0, 3.0, 5000), (0, 0, 0, 100.0, 5000), (30, 20, 0, 10.0, 5000), (100, 50, 0, 300.0, 5000), (500, 250, 0, 200.0, 5000),
    (500, 300, 0, 10.0, 5000), (0, 0, 5000, 60000.0, 5000), (0, 0, 0, 0.0, 0), (0, 0, 0, 2000.0, 10), (0, 0, 0, 2000.01, 10),
]
ANCHOR_SQL = ", ".join(f"(CAST({n - fp - fn - e} AS BIGINT), CAST(0 AS BIGINT), CAST({fp} AS BIGINT), CAST({fn} AS BIGINT), CAST({e} AS BIGINT), CAST({p} AS DOUBLE))" for fp, fn, e, p, n in ANCHORS)


@query(f"WITH counts_p99 AS (SELECT * FROM (VALUES {ANCHOR_SQL}) v(tp, tn, fp, fn, errors, p99))," + SCORE_SQL)
def q16_scoring_anchors(spark, sf_dir):
    rows = [(n - fp - fn - e, 0, fp, fn, e, p) for fp, fn, e, p, n in ANCHORS]
    return shown(evaluate.scored(spark.createDataFrame(rows, "tp long, tn long, fp long, fn long, errors long, p99 double")))


STAGES = [(1, 120, 900), (2, 60, 900), (3, 45, 100)]


@query("""
WITH s(stage_no, duration_s, target) AS (VALUES (1, 120, 900), (2, 60, 900), (3, 45, 100)),
f AS (SELECT *, lag(target, 1, 1) OVER (ORDER BY stage_no) AS from_rate FROM s),
r AS (SELECT *, CAST((from_rate + target) * duration_s // 2 AS BIGINT) AS stage_reqs FROM f)
SELECT stage_no, duration_s, target, from_rate, stage_reqs, CAST(sum(stage_reqs) OVER (ORDER BY stage_no) AS BIGINT) AS cumulative FROM r
""")
def q17_load_estimate(spark, sf_dir):
    stages = spark.createDataFrame(STAGES, "stage_no int, duration_s int, target int")
    return load.estimated(stages, 1)


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def q18_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.sha256("text").alias("digest"))


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1
""")
def q19_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return registry.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS added, json_exists(props, '$.k') AS has_k,
  CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' ELSE lower(json_type(props, '$.k')) END AS kind FROM events
""")
def q20_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", jsontree.parse("props", "map<string,bigint>").alias("m"), jsontree.parse("props").alias("v"))
    more = jsontree.parse(jsontree.printed(jsontree.with_field("m", "added", jsontree.field(F.col("m"), "K") + 1)), "map<string,bigint>")
    kind = jsontree.kind(F.try_variant_get("v", "$.k", "variant"))
    return rows.select("event_id", jsontree.field(F.col("m"), "k").alias("k"), jsontree.field(more, "added").alias("added"), jsontree.has("m", "K").alias("has_k"), kind.alias("kind"))


SWEEP = [(3, "0.6"), (5, "0.6"), (3, "0.67"), (5, "0.67")]


@query(PAIRS_SQL + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS k, CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (approved) AS approved_n, count(*) FILTER (NOT approved) AS denied_n FROM ({vote_sql(k, t)})" for k, t in SWEEP))
def q22_threshold_sweep(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    return knn.sweep(q, knn.neighbours(q, r, 5, True), [(k, float(t)) for k, t in SWEEP])


#: Fixed values of the workload: payloads, their share of fraud, and that of references.
PAYLOADS, PAYLOAD_RATIO, REFERENCE_RATIO = 54_100, 0.47, 0.35
#: References of the worked distances; the whole workload has 3,000,000, which one task draws in minutes.
REFERENCES = 100_000


@query()
def q23_generator(spark, sf_dir):
    """References and payloads of the exact generator, drawn once each and labelled; q41 has the SQL of its numbers."""
    made, references = cut(generate.exact_transactions(spark, PAYLOADS, PAYLOAD_RATIO)), cut(generate.exact_references(spark, REFERENCES, REFERENCE_RATIO))
    return generate.labelled(made, references).select("idx", "id", "expected_approved", "expected_fraud_score")


@query(EVENT_VOTE_SQL.replace("a.event_id <> b.event_id", "true").replace("SELECT q_id,", "SELECT CAST(q_id AS VARCHAR) AS id,", 1).replace("CAST(len(list_filter(five, lambda x: x.label = 'error')) AS BIGINT) AS fraud_n,", ""))
def q24_streaming_score(spark, sf_dir):
    """events as a stream of JSON requests, scored among themselves and read back."""
    from quintet.streaming import score
    from quintet.streaming.files import through_stream

    rows = events.transactions(spark, sf_dir)
    _, references = event_search(spark, sf_dir)
    requests = rows.select(F.to_json(F.struct(*FIELDS)).alias("value"))
    search = knn.Search(references)
    if search.sent:
        return through_stream(requests, lambda stream: score.score(score.requests(stream), search, scale=events.SCALE, risk={}))
    return through_stream(requests, score.requests, files_at_once=64, each=lambda rows: score.scored(rows, search, scale=events.SCALE, risk={}))


@query("""
WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events)
SELECT a.event_id, b.event_id AS previous_id, round(b.value, 6) AS previous_value FROM (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS previous FROM p) a LEFT JOIN p b ON b.event_id = a.previous
""")
def q25_last_transaction(spark, sf_dir):
    """The as-of relation behind "last transaction": each event with its user's one before."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    mine = W.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("event_id", F.lag("event_id").over(mine).alias("previous_id"), F.round(F.lag("value").over(mine), 6).alias("previous_value"))


@query(PAIRS_SQL + "SELECT q_id, round(sum(CASE WHEN label = 'fraud' THEN 1 / greatest(sqrt(d2), 1e-9) ELSE 0 END) / sum(1 / greatest(sqrt(d2), 1e-9)), 6) AS weighted_score FROM ranked WHERE rank <= 5 GROUP BY q_id")
def q26_weighted_vote(spark, sf_dir):
    q, r = embedded(spark, sf_dir)
    return knn.weighted_vote(knn.neighbours(q, r, leave_out_self=True)).withColumn("weighted_score", F.round("weighted_score", 6))
