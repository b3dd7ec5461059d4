"""The scoring engine against published and derived values, and against brute force."""

import gzip
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quintet.operators import evaluate, generate, knn, load, registry, vectorize
from quintet.schema import MCC_RISK, TRANSACTION, one_line
from quintet.sources import elements, readers, sinks

RATIO = 0.35


@pytest.fixture(scope="module")
def references(spark):
    return generate.exact_references(spark, 100, RATIO).persist()


@pytest.fixture(scope="module")
def payloads(spark):
    return generate.exact_transactions(spark, 50, RATIO).persist()


#: Worked examples: id, rounded vector.
VECTORS = {
    "tx-1329056812": [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006],
    "tx-3330991687": [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055],
    "tx-3576980410": [0.0385, 0.25, 0.05, 0.8696, 0.3333, 0.2257, 0.0189, 0.0137, 0.15, 0, 1, 0, 0.2, 0.0299],
}
DENIED = {
    "tx-1788243118", "tx-2870794086", "tx-3943816664", "tx-3795737979", "tx-3330991687", "tx-317390006", "tx-669205318", "tx-1239962632",
    "tx-3943856389", "tx-2053987499", "tx-643415378", "tx-2201636350", "tx-3894616122", "tx-232785218", "tx-3724573454", "tx-1628318673",
    "tx-1471757780", "tx-4112059057", "tx-1284334529",
}


def test_generated_payloads_have_the_worked_vectors(payloads):
    got = {r["id"]: list(r["vector"]) for r in vectorize.vectorize(payloads).collect()}
    for ident, vector in VECTORS.items():
        assert got[ident] == vector


def test_neighbours_of_worked_payloads(spark, payloads, references):
    queries = payloads.select(F.col("idx").alias("q_id"), "id", vectorize.vector().alias("vector"))
    expected = {"tx-1329056812": [(66, 0.2158), (0, 0.2249), (54, 0.2603), (60, 0.3536), (42, 0.3682)], "tx-3330991687": [(24, 0.5292), (7, 1.5388), (97, 1.6051), (79, 1.6237), (55, 1.9077)]}
    for way in (knn.neighbours, knn.neighbours_sql, knn.bucketed):
        found = way(queries, references).join(queries.select("q_id", "id"), "q_id").filter(F.col("id").isin(*expected)).orderBy("q_id", "rank").collect()
        for ident, near in expected.items():
            assert [(r["ref_idx"], round(math.sqrt(r["d2"]), 4)) for r in found if r["id"] == ident] == near


def test_scores_of_all_payloads(spark, payloads, references):
    labelled = generate.labelled(payloads, references)
    got = {r["id"]: (r["expected_fraud_score"], r["expected_approved"]) for r in labelled.collect()}
    assert len(got) == 50
    for ident, (score, approved) in got.items():
        want = 0.6 if ident == "tx-2174907811" else 1.0 if ident in DENIED else 0.0
        assert (score, approved) == (want, want < 0.6)
    stats = generate.stats(labelled).first()
    assert (stats["total"], stats["fraud_count"], stats["edge_case_count"], stats["edge_case_rate"]) == (50, 20, 1, 0.02)


def test_distances_over_a_hundred_thousand_references(spark, payloads):
    many = generate.exact_references(spark, 100_000, RATIO)
    wanted = {"tx-1329056812": [0.0340, 0.0488, 0.0509, 0.0591, 0.0592], "tx-3330991687": [0.2315, 0.2384, 0.2552, 0.2667, 0.2785]}
    queries = payloads.filter(F.col("id").isin(*wanted)).select(F.col("idx").alias("q_id"), "id", vectorize.vector().alias("vector"))
    found = knn.bucketed(queries, many).join(queries.select("q_id", "id"), "q_id").orderBy("rank").collect()
    for ident, near in wanted.items():
        assert [round(math.sqrt(r["d2"]), 4) for r in found if r["id"] == ident] == near


def test_all_ways_agree_with_ties_and_few_references(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.random(14) * 2) / 2, "fraud" if i % 3 else "legit") for i in range(60)]
    for i, (_, v, _) in enumerate(rows):
        v[[9, 10, 11]] = rng.integers(0, 2, 3)
        v[[5, 6]] = -1 if i % 2 else v[[5, 6]]
    frame = spark.createDataFrame([(i, [float(x) for x in v], lab) for i, v, lab in rows], "ref_idx long, vector array<double>, label string")
    queries = frame.select(F.col("ref_idx").alias("q_id"), "vector")
    for n in (60, 7, 3, 0):
        some = frame.filter(F.col("ref_idx") < n)
        want = None
        for found in (
            knn.neighbours_sql(queries, some, 5, True), knn.neighbours(queries, some, 5, True), knn.neighbours(queries, some, 5, True, most_bytes=0, block_rows=16),
            knn.bucketed(queries, some, 5, True), knn.bucketed(queries, some, 5, True, most_bytes=0, block_rows=16),
        ):
            got = sorted((r["q_id"], r["rank"], r["ref_idx"], r["label"], r["d2"]) for r in found.collect())
            want = got if want is None else want
            assert got == want
        assert [r["approved_n"] + r["denied_n"] for r in knn.sweep(queries, knn.neighbours(queries, some, 5, True), [(3, 0.6), (5, 0.67)]).collect()] == [60, 60]
        votes = {r["q_id"]: r["fraud_score"] for r in knn.vote(queries, knn.neighbours(queries, some, 5, True)).collect()}
        assert len(votes) == 60
        if not n:
            assert set(votes.values()) == {0.0}


def repeated(spark):
    """(queries, references) of 60 vectors, 7 times each; some are null or not finite."""
    rng = np.random.default_rng(5)
    base = np.round(rng.random((60, 14)) * 2) / 2
    base[:, [9, 10, 11]], base[::2, [5, 6]] = rng.integers(0, 2, (60, 3)), -1
    base[3, 0], base[4, 1], base[7], base[8] = np.nan, np.inf, -0.0, 0.0
    rows = [(i, [float(x) for x in base[i % 60]], "fraud" if i % 3 else None if i % 7 == 0 else "legit") for i in range(420)] + [(1000, None, "legit")]
    references = spark.createDataFrame(rows, "ref_idx long, vector array<double>, label string")
    return references.select(F.col("ref_idx").alias("q_id"), "vector"), references


def test_large_references_are_searched_by_distinct_vectors(spark):
    queries, references = repeated(spark)
    search = knn.Search(references, 5, True)
    assert search.kept.count() <= 61 and search.kept.selectExpr("max(size(own))").first()[0] == 6
    for self_ in (True, False):
        want = sorted(map(tuple, knn.broadcast_search(queries, references, 5, self_).collect()), key=str)
        votes = sorted(map(tuple, knn.vote(queries, knn.broadcast_search(queries, references, 5, self_)).collect()))
        for sizes in ({"most_bytes": 0, "block_rows": 7}, {"most_bytes": 20_000}):
            assert sorted(map(tuple, knn.neighbours(queries, references, 5, self_, **sizes).collect()), key=str) == want
            assert sorted(map(tuple, knn.voted(queries, references, leave_out_self=self_, **sizes).collect())) == votes


def test_cells_lie_within_buckets(spark):
    queries, references = repeated(spark)
    want = sorted(map(tuple, knn.vote(queries, knn.broadcast_search(queries, references, 5, True)).collect()))
    assert sorted(map(tuple, knn.voted(queries, references, leave_out_self=True, most_bytes=0, block_rows=7, first=knn.BUCKETS).collect())) == want
    search = knn.Search(references, 5, True, 0, 7, knn.BUCKETS)
    assert search.placed.groupBy("cell").agg(F.countDistinct(knn.bucket(F.col("vector"))).alias("n")).filter("n > 1").isEmpty()


def test_rounded_query_and_denominator(spark):
    one = spark.createDataFrame([(0, [0.0], "fraud"), (1, [1.0], "fraud")], "ref_idx long, vector array<double>, label string")
    q = spark.createDataFrame([(0, [0.1])], "q_id long, vector array<double>")
    vote = knn.vote(q, knn.neighbours(q, one)).first()
    assert (vote["fraud_score"], vote["approved"]) == (0.4, True)


def test_three_dimensional_example(spark):
    refs = [([0.01, 0.08, 0.05], "legit"), ([0.58, 0.92, 1.0], "fraud"), ([0.02, 0.10, 0.10], "legit"), ([0.95, 1.0, 0.92], "fraud"), ([0.5, 0.7, 0.6], "fraud"), ([0.1, 0.2, 0.1], "legit")]
    frame = spark.createDataFrame([(i, v, lab) for i, (v, lab) in enumerate(refs)], "ref_idx long, vector array<double>, label string")
    near = knn.closest(frame, [1.0, 0.96, 0.96], 3).collect()
    assert [r["ref_idx"] for r in near] == [3, 1, 4]


def one(spark, **changes):
    row = {
        "id": "a", "transaction": {"amount": 10.0, "installments": 1, "requested_at": "2026-03-11T18:45:53Z"},
        "customer": {"avg_amount": 20.0, "tx_count_24h": 1, "known_merchants": ["m"]}, "merchant": {"id": "m", "mcc": "5411", "avg_amount": 5.0},
        "terminal": {"is_online": True, "card_present": False, "km_from_home": 1.0}, "last_transaction": None,
    }
    for k, v in changes.items():
        group, _, name = k.partition("__")
        if name:
            row[group] = row[group] | {name: v}
        else:
            row[group] = v
    frame = spark.createDataFrame([(json.dumps(row),)], "value string").select(F.from_json("value", f"struct<{one_line(TRANSACTION)}>").alias("r")).select("r.*")
    return vectorize.vectorize(frame).first()["vector"]


def test_feature_edges(spark):
    assert one(spark, customer__avg_amount=0.0)[2] == 1.0
    assert math.isnan(one(spark, customer__avg_amount=0.0, transaction__amount=0.0)[2])
    assert one(spark, customer__avg_amount=-1.0)[2] == 0.0
    assert one(spark, customer__known_merchants=[])[11] == 1.0
    assert one(spark, merchant__mcc="0000")[12] == 0.5
    later = {"timestamp": "2026-03-11T19:45:53Z", "km_from_current": 2000.0}
    assert one(spark, last_transaction=later)[5:7] == [0.0, 1.0]
    earlier = {"timestamp": "2026-03-11T18:45:23Z", "km_from_current": 0.0}
    assert one(spark, last_transaction=earlier)[5] == round(0.5 / 1440 * 10000) / 10000
    assert one(spark, transaction__amount=0.5)[0] == 0.0001  # a midpoint goes up
    assert one(spark)[5:7] == [-1.0, -1.0]


def test_scores_of_the_published_examples(spark):
    rows = [(5000 - a - b - c, 0, a, b, c, p) for a, b, c, p in [(0, 0, 0, 1.0), (5, 5, 0, 3.0), (0, 0, 0, 100.0), (30, 20, 0, 10.0), (100, 50, 0, 300.0), (500, 250, 0, 200.0), (500, 300, 0, 10.0), (0, 0, 5000, 60000.0)]]
    want = [(3000.00, 3000.00, 6000.00), (2522.88, 2001.27, 4524.15), (1000.00, 3000.00, 4000.00), (2000.00, 1157.02, 3157.02), (522.88, 581.13, 1104.01), (698.97, -327.12, 371.85), (2000.00, -3000.00, -1000.00), (-3000.00, -3000.00, -6000.00)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, tp long, tn long, fp long, fn long, errors long, p99 double")
    for r, (p, d, f) in zip(evaluate.scored(frame).orderBy("i").collect(), want, strict=True):
        assert (r["p99_score"], r["detection_score"], r["final_score"]) == (pytest.approx(p, abs=0.01), pytest.approx(d, abs=0.01), pytest.approx(f, abs=0.01))


def test_report_and_edges(spark):
    frame = spark.createDataFrame([(4945, 0, 40, 15, 0, 5.81), (85, 0, 15, 0, 0, 2000.0), (0, 0, 0, 0, 0, 0.0), (84, 0, 16, 0, 0, 2000.01)], "tp long, tn long, fp long, fn long, errors long, p99 double")
    reports = [json.loads(x["j"])["report"] for x in evaluate.report(evaluate.scored(frame)).select(F.to_json(F.struct("report"), {"ignoreNullFields": "false"}).alias("j")).collect()]
    first = reports[0]["scoring"]
    assert (reports[0]["p99"], first["failure_rate"], first["weighted_errors_E"]) == ("5.81ms", "1.1%", 85)
    assert first["final_score"] == pytest.approx(3425.03, abs=0.02)
    assert not reports[1]["scoring"]["detection_score"]["cut_triggered"] and not reports[1]["scoring"]["p99_score"]["cut_triggered"]
    assert (reports[2]["scoring"]["p99_score"]["value"], reports[2]["scoring"]["detection_score"]["value"]) == (0.0, 3000.0)
    cut = reports[3]["scoring"]
    assert cut["detection_score"]["rate_component"] is None and cut["final_score"] == -6000.0


def test_confusion_counts(spark):
    rows = [(200, True, True), (200, False, False), (200, True, False), (200, False, True), (200, None, True), (200, None, False), (500, None, True), (None, None, True)]
    got = evaluate.confusion(spark.createDataFrame(rows, "status int, approved boolean, expected_approved boolean")).first()
    assert tuple(got) == (1, 1, 3, 1, 2)


def test_load_plan(spark):
    stages, start = load.stages_of(spark, "startRate: 1,\n stages: [ { duration: '120s', target: 900 } ]")
    estimate = load.estimated(stages, start)
    assert estimate.first()["stage_reqs"] == 54060
    assert tuple(load.total(estimate).first()) == (120, 54060)
    assert load.widths(estimate.select("stage_no", "target")).first()["stage_no"] == 8


def test_registry(spark):
    schema = "participant string, submission string, score double, timestamp string"
    old = spark.createDataFrame([("a", "x", 1.0, "1"), ("b", "y", 2.0, "1")], schema)
    new = spark.createDataFrame([("a", "x", 3.0, "2"), ("a", "x", 4.0, "3"), ("c", "z", 5.0, "1")], schema)
    got = registry.upsert(old, new)
    assert sorted((r["participant"], r["score"]) for r in got.collect()) == [("a", 4.0), ("b", 2.0), ("c", 5.0)]
    assert "registry" in registry.nested(got).columns
    people = spark.createDataFrame([("a", [("p", "repo1"), ("q", "repo2")])], "participant string, submissions array<struct<id:string,repo:string>>")
    asked = spark.createDataFrame([("a", "default"), ("a", "q")], "participant string, submission string")
    assert sorted(tuple(r) for r in registry.resolve(people, asked).select("submission", "repo").collect()) == [("p", "repo1"), ("q", "repo2")]


def test_percentile_is_exact(spark):
    r = np.random.default_rng(1)
    for values in (r.random(5000), r.integers(0, 5, 3000).astype(float), [7.0], [1.0, 2.0], np.arange(101.0), np.exp(r.normal(0, 3, 40_000))):
        frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "ms double")
        assert evaluate.p99(frame, "ms").first()["p99"] == pytest.approx(np.percentile(values, 99), rel=1e-12)
    assert evaluate.p99(spark.createDataFrame([], "ms double"), "ms").first()["p99"] is None


def test_load_table(spark):
    stages, start = load.stages_of(spark, "startRate: 1,\n stages: [ { duration: '120s', target: 900 } ]")
    lines = [r["line"] for r in load.table_lines(load.estimated(stages, start), start).orderBy("at").collect()]
    assert lines[1] == "│ stage │ duration │ from │ to  │ stage_reqs │ cumulative │"
    assert lines[3] == "│     1 │     120s │    1 │ 900 │      54060 │      54060 │"
    assert lines[5] == "│ total │     120s │    1 │ 900 │            │      54060 │"
    assert lines[0][0] + lines[2][0] + lines[4][0] + lines[6][0] == "┌├├└" and len({len(x) for x in lines}) == 1


def test_stats_line_takes_counts(spark):
    stats = spark.createDataFrame([(100_000, 12_345, 87_655, 0.1235, 0.8766, 0, 0.0)], "total long, fraud_count long, legit_count long, fraud_rate double, legit_rate double, edge_case_count long, edge_case_rate double")
    assert sinks.stats_line(stats).first()["line"] == "Stats: total=100000 fraud=12345 (12.3%) legit=87655 (87.7%) edge=0 (0.0%)"


def test_registry_file_is_replaced(spark, tmp_path):
    path, schema = f"file://{tmp_path}/r.json", "participant string, submission string, score double, timestamp string"
    one = spark.createDataFrame([("ann", "x", 1.0, "2026-01-01T00:00:00Z"), ("ann", "é", None, "t")], schema)
    sinks.write_registry(one, path)
    text = (tmp_path / "r.json").read_text()
    assert list(json.loads(text)["ann"]) == ["x", "é"] and text.startswith('{\n    "ann"')
    sinks.write_registry(registry.stamped(one.filter("submission = 'x'")), path)
    back = readers.registry(spark, path, "score double, timestamp string").collect()
    assert len(back) == 1 and len(back[0]["timestamp"]) == 20 and back[0]["timestamp"] > "2026"
    assert [p for p in os.listdir(tmp_path) if not p.endswith(".crc")] == ["r.json"]


def test_first_of_equal_codes_counts(spark):
    risk = spark.createDataFrame([(1, "a", 0.9), (0, "a", 0.1)], "at int, code string, risk double")
    assert vectorize.mcc_risk_join(spark.createDataFrame([("a",), ("b",)], "m string"), "m", risk).select("m", "mcc_risk").orderBy("m").collect() == [("a", 0.1), ("b", 0.5)]


def test_leaves_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 8)
    monkeypatch.setattr(knn, "TILE", 5)
    r = np.random.default_rng(9)
    for trial in range(60):
        n, dims, k = int(r.integers(0, 200)), int(r.integers(1, 6)), int(r.integers(1, 7))
        rows = r.integers(0, 4, (n, dims)) / 4 if trial % 2 else r.normal(0, 10.0 ** r.integers(-3, 4), (n, dims))
        q = np.concatenate([rows[: n // 3], r.normal(0, 1, (10, dims))])
        if trial % 5 == 0 and n > 3:
            rows[0, 0], rows[1, 0], q[0, 0] = np.nan, np.inf, 1e200
        ids = r.permutation(n) * 3
        q_ids = r.integers(0, 3 * n + 1, len(q)) if trial % 3 else None
        index = knn.Index(ids, np.array(["x"] * n, object), rows, 8)
        place, d2 = index.nearest(q, q_ids, k)
        for i, v in enumerate(q):
            with np.errstate(invalid="ignore", over="ignore"):
                every = knn.distances(v[None], np.ascontiguousarray(rows.T))[0] if n else np.zeros(0)
            want = sorted((d, j) for d, j in zip(every, ids, strict=True) if d < knn.FAR and (q_ids is None or j != q_ids[i]))[:k]
            got = [(d, index.ids[p]) for p, d in zip(place[i], d2[i], strict=True) if p >= 0]
            assert got == want, trial


def test_files_round_trip(spark, tmp_path, payloads, references):
    sinks.write_array(payloads, sinks.request_json(), "idx", str(tmp_path / "payloads"))
    name = next(p for p in os.listdir(tmp_path / "payloads") if p.startswith("part"))
    text = (tmp_path / "payloads" / name).read_text()
    parsed = json.loads(text)
    assert len(parsed) == 50 and parsed[0]["last_transaction"] is None and ": " not in text.split("requested_at")[0]
    back = readers.transactions(spark, str(tmp_path / "payloads" / name))
    assert sorted(r["id"] for r in back.collect()) == sorted(p["id"] for p in parsed)
    assert sorted(map(str, vectorize.vectorize(back).collect())) == sorted(map(str, vectorize.vectorize(payloads).collect()))

    sinks.write_array(references, sinks.reference_json(), "ref_idx", str(tmp_path / "refs"))
    name = next(p for p in os.listdir(tmp_path / "refs") if p.startswith("part"))
    with gzip.open(tmp_path / "refs.json.gz", "wt") as f:
        f.write((tmp_path / "refs" / name).read_text())
    again = readers.references(spark, str(tmp_path / "refs.json.gz"))
    assert sorted(map(str, again.collect())) == sorted(map(str, references.collect()))
    sinks.references_parquet(again, str(tmp_path / "refs.parquet"))
    assert spark.read.parquet(str(tmp_path / "refs.parquet")).count() == 100

    (tmp_path / "bad.json").write_text('[{"vector": [1, 2], "label": "fraud"}]')
    with pytest.raises(Exception, match="14 dimensions"):
        readers.references(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "risk.json").write_text(json.dumps(MCC_RISK))
    assert readers.risk(spark, str(tmp_path / "risk.json")) == MCC_RISK
    (tmp_path / "scale.json").write_text(json.dumps({"max_amount": 1}))
    with pytest.raises(ValueError, match="lacks"):
        readers.scale(spark, str(tmp_path / "scale.json"))
    os.mkdir(tmp_path / "people")
    (tmp_path / "people" / "ann.json").write_text('[{"id": "one", "repo": "r"}]')
    assert readers.participants(spark, str(tmp_path / "people")).first()["participant"] == "ann"
    import hashlib

    assert readers.checksum(spark, str(tmp_path / "risk.json")).first()["sha256"] == hashlib.sha256((tmp_path / "risk.json").read_bytes()).hexdigest()


@pytest.fixture
def small_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_an_array_is_written_and_read_by_several_tasks(spark, tmp_path, payloads, references, small_splits):
    sinks.write_array(payloads, sinks.request_json(), "idx", str(tmp_path / "a"))
    (name,) = [p for p in os.listdir(tmp_path / "a") if not p.startswith((".", "_"))]
    parsed = json.loads((tmp_path / "a" / name).read_text())
    assert [x["id"] for x in parsed] == [r["id"] for r in payloads.orderBy("idx").collect()]
    (tmp_path / "one_line.json").write_text(json.dumps(parsed))
    (tmp_path / "indented.json").write_text(json.dumps(parsed, indent=4) + "\n")
    want = sorted(map(str, spark.read.schema(one_line(TRANSACTION)).option("multiLine", True).json(str(tmp_path / "one_line.json")).collect()))
    for path in ("a", "one_line.json", "indented.json"):
        back = readers.transactions(spark, str(tmp_path / path))
        assert sum(n > 0 for n in back.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 5
        assert sorted(map(str, back.collect())) == want
    sinks.write_array(payloads.limit(0), sinks.request_json(), "idx", str(tmp_path / "none"))
    assert readers.transactions(spark, str(tmp_path / "none")).count() == 0


def test_elements_of_any_json(spark, tmp_path, small_splits):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    values = [1, None, "a}],[{\\\"\\\\", {"k}": [{"x": '"'}, [], {}]}, [], [[1, 2], [3]], "\u65e5" * 30, {"": {"": "{" * 50}}] * 3
    for name, some in (("many", values), ("one", values[2:3]), ("none", [])):
        for indent in (None, 2):
            (tmp_path / f"{name}.json").write_text(json.dumps(some, indent=indent, ensure_ascii=False))
            got = sorted((r["at"], json.dumps(json.loads(r["value"]))) for r in elements.of_array(spark, str(tmp_path / f"{name}.json")).collect())
            assert got == [(i, json.dumps(x)) for i, x in enumerate(some)]
    (tmp_path / "object.json").write_text('{"a": [1]}')
    assert elements.of_array(spark, str(tmp_path / "object.json")) is None
    (tmp_path / "open.json").write_text('[{"a": 1}, {"b": ')
    with pytest.raises(ValueError, match="incomplete"):
        elements.of_array(spark, str(tmp_path / "open.json"))


def test_labelled_file(spark, tmp_path, payloads, references):
    entries = generate.labelled(payloads, references)
    rows = [{"request": json.loads(r["j"]), "expected_approved": r["expected_approved"], "expected_fraud_score": r["expected_fraud_score"]} for r in entries.orderBy("idx").select(sinks.request_json().alias("j"), "expected_approved", "expected_fraud_score").collect()]
    stats = generate.stats(entries).first().asDict()
    (tmp_path / "test-data.json").write_text(json.dumps({"references_checksum_sha256": "0", "stats": stats, "entries": rows}))
    back, told = readers.test_data(spark, str(tmp_path / "test-data.json"))
    assert back.count() == 50 and told.first()["fraud_count"] == 20
    assert sinks.stats_line(told).first()["line"].startswith("Stats: total=50 fraud=20 (40.0%)")


def test_references_and_labelled_file_are_read_by_several_tasks(spark, tmp_path, payloads, references, small_splits):
    tasks = lambda rows: sum(n > 0 for n in rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())
    sinks.write_array(references, sinks.reference_json(), "ref_idx", str(tmp_path / "refs"))
    back = readers.references(spark, str(tmp_path / "refs"))
    assert tasks(back) > 3 and sorted(map(str, back.collect())) == sorted(map(str, references.collect()))
    entries = generate.labelled(payloads, references)
    sinks.write_test_data(entries, generate.stats(entries), "0" * 64, str(tmp_path / "labelled"))
    back, told = readers.test_data(spark, str(tmp_path / "labelled"))
    assert tasks(back) > 3 and told.first()["references_checksum_sha256"] == "0" * 64 and told.first()["total"] == 50
    pick = lambda rows: sorted(map(tuple, rows.select("idx", "id", "expected_approved", "expected_fraud_score").collect()))
    assert pick(back) == pick(entries)


def test_what_is_no_element_is_never_parsed(spark, tmp_path, references, payloads, small_splits):
    """Spark evaluates an expression that two parts of a filter share before the filter's first part."""
    sinks.write_array(references, sinks.reference_json(), "ref_idx", str(tmp_path / "refs"))
    assert readers.references(spark, str(tmp_path / "refs")).filter("label = 'fraud' and vector[0] >= 0").count() == references.filter("label = 'fraud' and vector[0] >= 0").count()
    sinks.write_array(references.limit(0), sinks.reference_json(), "ref_idx", str(tmp_path / "none"))
    assert readers.references(spark, str(tmp_path / "none")).count() == 0
    entries = generate.labelled(payloads, references)
    sinks.write_test_data(entries, generate.stats(entries), "0" * 64, str(tmp_path / "labelled"))
    some = "expected_fraud_score > 0.1 and transaction.amount > 0"
    assert readers.test_data(spark, str(tmp_path / "labelled"))[0].filter(some).count() == entries.filter(some).count() > 0


def test_scalable_generator(spark):
    made = generate.scalable_transactions(spark, 4000, RATIO, seed=5).persist()
    assert made.count() == 4000
    share = {r["profile"]: r["count"] / 4000 for r in made.groupBy("profile").count().collect()}
    assert abs(share["legit"] - 0.65) < 0.03 and abs(share["borderline"] - 0.035) < 0.015
    vectors = np.array([r["vector"] for r in vectorize.vectorize(made).collect()])
    assert vectors.shape == (4000, 14) and not np.isnan(vectors).any()
    legit = made.filter("profile = 'legit'")
    assert legit.filter("transaction.amount not between 10 and 500").isEmpty() and legit.filter("not array_contains(customer.known_merchants, merchant.id)").isEmpty()


def test_streaming_equals_batch(spark, payloads, references, tmp_path):
    from quintet.streaming import score
    from quintet.streaming.files import through_stream

    requests = payloads.select(sinks.request_json().alias("value"))
    streamed = through_stream(requests, lambda s: score.score(score.requests(s), references))
    batch = score.score(payloads, references)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    requests.write.text(str(tmp_path / "in"))
    stream = score.requests(spark.readStream.schema("value string").text(str(tmp_path / "in")))
    running = score.score_batches(stream, references, lambda rows, _: seen.extend(map(tuple, rows.collect())), str(tmp_path / "state"))
    running.processAllAvailable()
    running.stop()
    assert sorted(seen) == sorted(map(tuple, batch.collect()))


def test_streams_take_references_of_any_size(spark, payloads, references):
    from quintet.streaming import score
    from quintet.streaming.files import through_stream

    want = sorted(map(tuple, score.score(payloads, references).collect()))
    requests = payloads.select(sinks.request_json().alias("value"))
    many = references.unionByName(references.withColumn("ref_idx", F.col("ref_idx") + 1000))
    for search in (knn.Search(references, most_bytes=0, block_rows=30), knn.Search(many, k=10, most_bytes=0, block_rows=30)):
        got = through_stream(requests, score.requests, each=lambda rows, search=search: score.scored(rows, search))
        assert sorted(map(tuple, got.collect())) == want
    # 200 references of 100 vectors fit where 200 vectors wouldn't
    assert sorted(map(tuple, score.score(payloads, many, k=10, most_bytes=20_000).collect())) == want


def test_pairs_are_formed_by_several_tasks(spark, references):
    queries = references.select(F.col("ref_idx").alias("q_id"), "vector").coalesce(1)
    found = knn.neighbours_sql(queries, references, 5, True)
    assert sum(n > 0 for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("BroadcastNestedLoopJoin") :]


def test_pairs_are_formed_of_blocks_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(knn, "ACROSS", 7)
    monkeypatch.setattr(knn, "DOWN", 5)
    rng = np.random.default_rng(11)
    odd = [None, [], [1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1e200] * 4, [1e14, 0.0, 0.0, 0.0], [None, 0.0, 0.0, 0.0], [1.0, 2.0], [1.0, 3.0], [1e200, 0.0], [1e200, 1e3]]
    rows = [(i % 70, [float(x) for x in np.round(rng.random(4) * 2) / 2], ("fraud", "legit", None)[i % 3]) for i in range(90)] + [(100 + i, v, "legit") for i, v in enumerate(odd)]
    references = spark.createDataFrame(rows, "ref_idx long, vector array<double>, label string")
    queries = references.select(F.col("ref_idx").alias("q_id"), "vector").dropDuplicates(["q_id"])
    asked = queries.collect()

    def apart(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return math.nan
        d2 = 0.0
        for x, y in zip(a, b, strict=True):
            d2 += (x - y) * (x - y)
        return d2

    for leave_out_self in (True, False):
        want = []
        for q in asked:
            near = sorted((d2, i) for i, v, _ in rows if not (leave_out_self and i == q["q_id"]) and (d2 := apart(q["vector"], v)) < 1e30)
            want += [(q["q_id"], n + 1, i, d2) for n, (d2, i) in enumerate(near[:5])]
        for most_bytes in (1 << 20, 0):
            got = knn.neighbours_sql(queries, references, 5, leave_out_self, most_bytes)
            assert sorted((r["q_id"], r["rank"], r["ref_idx"], r["d2"]) for r in got.collect()) == sorted(want)
