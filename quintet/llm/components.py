"""Connected components of links in a DataFrame: contracted where they lie, then by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.llm import common

#: Links that a task contracts; it holds a few dozen megabytes for them.
AT_ONCE = 250_000


def state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def stars_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of their component), of links that are all at hand, for all but the smallest."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == top).all():
            break
        top = new
    some = top != np.arange(len(nodes))
    return nodes[some], nodes[top[some]]


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """Written links (u, v) as stars of what each of so many tasks holds; they connect the same nodes."""

    def stars(batches):
        held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if held:
            u, v = stars_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return edges.coalesce(tasks).mapInArrow(stars, "u long, v long")


def smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours; u's smallest come from a combined minimum."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")


def components(links: DataFrame, keep: common.Scratch, rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for each node of links (u, v); component is the smallest node reachable.

    Links lie in as many tasks as their number asks for, which contract them to
    stars. Where there are several tasks, stars are joined across them in rounds,
    each contracted again and written to `keep`. A round's work is proportional
    to the links; a hub's links are joined to one number, which an adaptive skew
    join splits.
    """
    edges = keep(links.filter("u != v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")))
    tasks = 1 + edges.count() // at_once
    stars = keep(contracted(edges, tasks))
    keep.drop(edges)
    before = state(stars) if tasks > 1 else None
    for _ in range(rounds if tasks > 1 else 0):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = smallest(large)
        more = keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct())
        again = keep(contracted(more, tasks))
        # a star whose hub is a leaf of no other is whole; if contracting changes nothing any more, all are
        done = state(more) == state(again) == before
        keep.drop(stars, large, more)
        stars, before = again, state(again)
        if done:
            break
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = keep(stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    ))
    keep.drop(stars)
    return found
