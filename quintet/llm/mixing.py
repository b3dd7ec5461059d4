"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Sources in the order of their code
points (null last) have the weights given, repeated; they share all words by
weight, but none gets more than `most` times its own, and what it can't take is
shared again by weight among the rest.

Rates minimise the relative entropy sum m_i (r_i log r_i - r_i) under one token
constraint a source, sum size_i r_i = target, with 0 <= r_i <= most. The base
measure is m_i = size_i^`base`: with base 0, the default, entropy is counted by
document, and with base 1 by token, in which case a source's documents share a
rate. The dual is convex, and its solution tilts documents exponentially:
r_i = min(most, exp(lambda_s * size_i^(1 - base))), so a source that must shrink
does so in its long documents first, and one that must grow grows in them. Newton steps
on lambda are taken for all sources at once, each step one aggregation over a
histogram of sizes, kept in a bracket that the dual's monotony gives. Sources,
multipliers and brackets stay in DataFrames; the driver sees a residual.

Rates become copies: floor(r), and one more for some. Per source, sizes are
walked from the largest and each takes the number of further copies that keeps
the sum nearest to its target, so the error left is at most half a document of
the smallest sizes. Which documents of a size get them goes by a hash of id and
text. Large cells (source, size) are dealt into bins that each get their share,
so no group of equal documents is ranked in one task.

Scale: documents are reduced to (id, source, size, hash) once, then to a
histogram of distinct sizes, combined on the map side; a hot source is a
histogram like any other. Sources are ranked in ranges and filled by
aggregations, so there may be as many as hosts. Reruns agree: only hashes, counts and sorted orders decide.

Defined results: a null or empty text has size 0 and takes one copy of nothing;
a null source is a source of its own; rows that share an id count each, equal
rows being interchangeable; a source without words has target 0; extra columns
are kept.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.llm import common

WEIGHTS, MOST, BIN = (1, 2, 3), 3, 2048


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, h) of each document."""

    def measure(batches):
        import pyarrow as pa
        import xxhash

        for b in common.by_bytes(batches, "text"):
            texts = common.utf8(b.column("text"))
            ids = b.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("source"), pa.array([len((t or b"").split()) for t in texts], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest((t or b"") + b"\0%d" % (-1 if i is None else i)) - (1 << 63) for i, t in zip(ids, texts, strict=True)], pa.int64()),
            ], names=["id", "source", "size", "h"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(measure, "id long, source string, size long, h long")


def weighted(sizes: DataFrame, weights, keep: common.Scratch) -> DataFrame:
    """(source, source_size, weight): weights dealt in the order of code points, null last.

    Sources are ranked where they lie after a range partitioning, and only the
    partitions' counts are summed in order.
    """
    first = F.col("source").asc_nulls_last()
    dealt = keep(sizes.repartitionByRange(common.partitions(sizes.sparkSession), first).withColumn("p", F.spark_partition_id()))
    before = dealt.groupBy("p").count().select("p", (F.sum("count").over(W.orderBy("p")) - F.col("count")).alias("before"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(first)) + F.col("before")
    place = (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")
    return dealt.join(F.broadcast(before), "p").select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place).cast("double").alias("weight"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, keep: common.Scratch | None = None) -> DataFrame:
    """(source, source_size, target): of sizes (source, source_size), a row a source.

    The level is raised round by round: sources that it fills stop at `most`
    times their size, and the rest share what they can't take. A round is one
    aggregation; the driver sees two sums.
    """
    keep = keep or common.Scratch(sizes.sparkSession)
    listed = keep(weighted(sizes, weights, keep))
    whole = listed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level = whole[0] or 0, (whole[0] or 0) / (whole[1] or 1)
    while True:
        full = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        own = listed.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        raised = (total - most * own[0]) / own[1] if own[1] else level
        if raised <= level:
            break
        level = raised
    share = F.when(full, F.lit(most).cast("double") * F.col("source_size")).otherwise(F.lit(level) * F.col("weight"))
    return listed.select("source", "source_size", share.alias("target"))


def duals(cells: DataFrame, goal: DataFrame, *, base: float = 0.0, most: int = MOST, near: float = 1e-9, steps: int = 60, keep: common.Scratch | None = None) -> DataFrame:
    """(source, lam): the multipliers, by distributed Newton steps within brackets.

    cells: (source, size, n) with size > 0; goal: (source, source_size, target).
    """
    keep = keep or common.Scratch(cells.sparkSession)
    tilt = F.pow(F.col("size").cast("double"), F.lit(1.0 - base))
    rated = cells.withColumn("x", tilt)
    span = rated.groupBy("source").agg(F.min("x").alias("x0"))
    state = span.join(goal, span["source"].eqNullSafe(goal["source"])).select(span["source"], "target", "source_size", "x0")
    bound = F.log(F.col("target") / F.col("source_size")) / F.col("x0")
    full = F.col("target") >= F.lit(most) * F.col("source_size")
    edge = F.lit(math.log(most)) / F.col("x0")
    state = keep(state.select(
        "source", "target",
        F.when(full, edge).otherwise(F.lit(0.0)).alias("lam"),
        F.when(full, edge).otherwise(F.least(bound, F.lit(0.0))).alias("lo"),
        F.when(full | (bound > 0), edge).otherwise(F.lit(0.0)).alias("hi"),
    ))
    table = state
    for _ in range(steps):
        rate = F.least(F.exp(F.col("lam") * F.col("x")), F.lit(float(most)))
        words = F.col("n") * F.col("size")
        at = rated.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
            F.first("target").alias("target"), F.first("lam").alias("lam"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(rate < most, words * rate * F.col("x")).otherwise(0.0)).alias("slope"),
        )
        over = F.col("taken") > F.col("target")
        at = at.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.greatest("lo", "lam"))).withColumn("hi", F.when(over, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.when(F.col("slope") > 0, F.col("lam") - (F.col("taken") - F.col("target")) / F.col("slope"))
        inside = newton.isNotNull() & (newton >= F.col("lo")) & (newton <= F.col("hi"))
        off = F.abs(F.col("taken") - F.col("target")) / F.col("target")
        at = keep(at.select(
            "source", "target", "lo", "hi", off.alias("off"),
            F.when(off <= near, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"),
        ))
        keep.drop(table)
        table, state = at, at.drop("off")
        worst = at.agg(F.max("off")).first()[0]
        if worst is None or worst <= near:
            break
    return state.select("source", "lam")


def rounded(cells: DataFrame, base: float, most: int) -> DataFrame:
    """cells (source, size, n, lam, target) with copies all get and how many get one more."""

    def diffuse(pdf):
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(np.int64)
        rate = np.minimum(np.exp(pdf["lam"].to_numpy(float) * size ** (1.0 - base)), most)
        rate[np.abs(rate - np.round(rate)) < 1e-7] = np.round(rate[np.abs(rate - np.round(rate)) < 1e-7])
        floor = np.floor(rate).astype(np.int64)
        due, more = 0.0, np.zeros(len(n), np.int64)
        room = np.where(floor < most, n, 0)
        for i in range(len(n)):
            due += (rate[i] - floor[i]) * n[i] * size[i]
            more[i] = min(room[i], max(0, int(math.floor(due / size[i] + 0.5))))
            due -= more[i] * size[i]
        return pdf.assign(copies=floor, more=more)[["source", "size", "n", "copies", "more"]]

    keyed = cells.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    return keyed.groupBy("key").applyInPandas(lambda pdf: diffuse(pdf), "source string, size long, n long, copies long, more long")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, most: int = MOST, base: float = 0.0,
) -> DataFrame:
    """(id, source, size, source_size, target, copies): a row for each of docs, with h of its id and text."""
    keep = common.Scratch(docs.sparkSession)
    rows = keep(sized(docs, id_col, text_col, source_col))
    cells = keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = keep(targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most, keep))
    keep.bounded(cells.count(), 100_000)  # sources and their sizes
    some = cells.filter("size > 0")
    lam = duals(some, goal.filter("source_size > 0"), base=base, most=most, keep=keep)
    tilted = some.join(lam.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = keep(rounded(tilted, base, most))
    keep.close(rows, goal, plan)

    # documents of a size are ranked by hash within bins; a bin's share of the further copies follows its place
    both = rows.join(plan.withColumnsRenamed({"source": "s", "size": "z"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    both = both.withColumn("bin", F.pmod(F.xxhash64("h"), F.coalesce(F.ceil(F.col("n") / BIN), F.lit(1))).cast("long"))
    part = both.filter("more > 0 and more < n")
    bins = part.groupBy("source", "size", "bin").agg(F.count("*").alias("own"), F.first("n").alias("n"), F.first("more").alias("more"))
    until = F.sum("own").over(W.partitionBy("source", "size").orderBy("bin"))
    share = lambda upto: F.expr(f"({upto} * more) div n")
    bins = bins.withColumn("until", until).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bin").alias("b"), (share("until") - share("(until - own)")).alias("share")
    )
    rank = F.row_number().over(W.partitionBy("source", "size", "bin").orderBy("h", "id"))
    ranked = part.withColumn("rank", rank).join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bin") == F.col("b"))).withColumn("one", (F.col("rank") <= F.col("share")).cast("long"))
    plain = both.filter("more is null or more <= 0 or more >= n").withColumn("one", F.expr("if(more > 0, 1L, 0L)"))
    columns = ["id", "source", "size", "h", F.coalesce(F.col("copies") + F.col("one"), F.lit(1)).alias("copies")]
    counted = ranked.select(*columns).union(plain.select(*columns))
    named = goal.withColumnRenamed("source", "s")
    return counted.join(named, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "size", "source_size", "target", "copies", "h")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents`."""
    found = mix(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    own, name, back = common.masked(docs)
    counted = mix(docs)
    # rows equal in id and text are interchangeable: number them on both sides
    one = W.partitionBy("i", "h").orderBy("copies")
    chosen = counted.select(F.col("id").alias("i"), "h", "copies").withColumn("k", F.row_number().over(one)).filter("copies > 0")
    hashed = numbered(own, name["doc_id"], name["text"])
    both = hashed.join(chosen, hashed["__id"].eqNullSafe(chosen["i"]) & (hashed["__h"] == chosen["h"]) & (hashed["__k"] == chosen["k"]))
    return back(both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id, __h as in sized() and __k, a number among rows equal in both."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("__id", T.LongType()), T.StructField("__h", T.LongType())])

    def hashed(batches):
        import pyarrow as pa
        import xxhash

        for b in common.by_bytes(batches, text_col):
            ids = b.column(id_col).cast(pa.int64())
            h = [xxhash.xxh3_64_intdigest((t or b"") + b"\0%d" % (-1 if i is None else i)) - (1 << 63) for i, t in zip(ids.to_pylist(), common.utf8(b.column(text_col)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, ids, pa.array(h, pa.int64())], names=[*b.schema.names, "__id", "__h"])

    return docs.mapInArrow(hashed, schema).withColumn("__k", F.row_number().over(W.partitionBy("__id", "__h").orderBy(F.lit(0))))
