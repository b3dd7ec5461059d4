"""Elements of JSON arrays of any size, found by all tasks that read a file.

Text is read in pieces that end with "}", so that a file on one line is split
too. Whether a split begins within a string, and how deep, is known once every
split has counted its quotes and brackets for both cases. A second read cuts the
splits at the commas and brackets of one level; what is cut by a split's edge is
joined again.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.session import cut

STEP = np.zeros(256, np.int8)
STEP[list(b"[{")], STEP[list(b"]}")] = 1, -1
TOKEN = STEP != 0
TOKEN[list(b'",')] = True


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places of brackets and commas, the bytes there, whether an odd number of quotes is before each, quotes mod 2)."""
    a = np.frombuffer(re.sub(rb"\\.", b"  ", data, flags=re.S) if b"\\" in data else data, np.uint8)
    where = np.flatnonzero(TOKEN[a])
    kind = a[where]
    quote = kind == ord('"')
    odd = quote.cumsum() % 2 == 1
    return where[~quote], kind[~quote], odd[~quote], int(quote.sum() % 2)


def levels(kind: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """(the level that each token separates, opens or closes; the depth after all)."""
    step = STEP[kind].astype(np.int64)
    after = depth + step.cumsum()
    return after + (step < 0), int(after[-1]) if len(after) else depth


def slices(batches):
    """((file, start of the split), bytes) in the order of reading."""
    for b in batches:
        if not b.num_rows:
            continue
        file, start = b.column("file").to_numpy(), b.column("start").to_numpy()
        edges = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for i, j in zip([0, *edges], [*edges, b.num_rows], strict=True):
            text = pc.binary_join_element_wise(b.column("value").slice(i, j - i).cast(pa.large_binary()), pa.scalar(b"}", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
            yield (int(file[i]), int(start[i])), b"".join(text.to_pylist())


def counts(batches):
    """A row a split: quotes mod 2 and, for a begin outside and within a string, the change of depth and tokens by level."""
    seen: dict[tuple[int, int], list] = {}
    for key, data in slices(batches):
        s = seen.setdefault(key, [0, [0, 0], [Counter(), Counter()]])
        _, kind, odd, parity = tokens(data)
        for within in (0, 1):
            own, s[1][within] = levels(kind[odd == bool(within ^ s[0])], s[1][within])
            s[2][within].update(dict(zip(*(x.tolist() for x in np.unique(own, return_counts=True)), strict=True)))
        s[0] ^= parity
    for (file, start), (parity, deep, at) in seen.items():
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "parity": parity, "deep": deep, "at": [list(c) for c in at], "n": [list(c.values()) for c in at]}], COUNTS)


COUNTS = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("parity", pa.int32()), ("deep", pa.list_(pa.int64())), ("at", pa.list_(pa.list_(pa.int64()))), ("n", pa.list_(pa.list_(pa.int64())))])
FOUND = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("start", pa.int64()), ("inside", pa.bool_()), ("value", pa.string())])


def cutting(states, level: int, edges: bool):
    """The function that cuts splits: the whole parts inside of them, or those at their edges and those outside of the level."""

    def run(batches):
        key, state, held, first = None, None, [], True
        last = lambda: pa.RecordBatch.from_pylist([{"file": key[0], "at": state[2], "start": key[1], "inside": state[1] >= level, "value": b"".join(held).decode()}], FOUND)
        for now, data in slices(batches):
            if now != key:
                if edges and key:
                    yield last()
                key, state, held, first = now, list(states.value[now]), [], True
            where, kind, odd, parity = tokens(data)
            real = odd == bool(state[0])
            where, kind = where[real], kind[real]
            own, deep = levels(kind, state[1])
            mine = own == level
            where, step = where[mine], STEP[kind[mine]]
            ends, begins = where + (step > 0), where + (step >= 0)
            inside = np.concatenate([[state[1] >= level], step >= 0])
            state[0], state[1] = state[0] ^ parity, deep
            if not len(where):
                held.append(data)
                continue
            values = [b"".join([*held, data[: ends[0]]]), *(data[a:b] for a, b in zip(begins[:-1].tolist(), ends[1:].tolist(), strict=True))]
            edge = np.zeros(len(values), bool)
            edge[0], first = first, False
            keep = np.flatnonzero(edge | ~inside[:-1] if edges else ~edge & inside[:-1])
            if len(keep):
                n = len(keep)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0])), pa.array(state[2] + keep), pa.array(np.full(n, key[1])), pa.array(inside[keep]), pa.array([values[i] for i in keep], pa.binary()).cast(pa.string())], schema=FOUND)
            state[2] += len(where)
            held = [data[begins[-1] :]]
        if edges and key:
            yield last()

    return run


def only(rows: DataFrame, ok: Column) -> DataFrame:
    """The rows where ok holds; values of others are null, since Spark may parse what a filter is about to drop."""
    return rows.filter(ok).withColumn("value", F.when(ok, F.col("value")))


def parts(spark: SparkSession, path: str, level: int = 1) -> tuple[DataFrame, dict[int, list[tuple[int, str]]]]:
    """What lies between the commas of a level, as (file, at, value), and, by file, what lies outside of it, as [(at, text)].

    `file` is a hash of the file's path; `at` counts parts within a file. A bracket
    belongs to the text outside.
    """
    raw = spark.read.option("lineSep", "}").text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    kind = "file long, start long, parity int, deep array<long>, at array<array<long>>, n array<array<long>>"
    files = defaultdict(list)
    for r in raw.mapInArrow(counts, kind).collect():
        files[r["file"]].append(r)
    states, ends = {}, {}
    for file, rows in files.items():
        within, depth, before = 0, 0, 0
        for r in sorted(rows, key=lambda r: r["start"]):
            states[file, r["start"]] = (within, depth, before)
            before += dict(zip(r["at"][within], r["n"][within], strict=True)).get(level - depth, 0)
            depth, within = depth + r["deep"][within], within ^ r["parity"]
        if within or depth not in (0, -1):
            raise ValueError(f"{path} has an incomplete JSON value")
        ends[file] = depth  # below 0: no "}" was behind the last piece
    sent = spark.sparkContext.broadcast(states)
    kind = "file long, at long, start long, inside boolean, value string"
    cuts = raw.mapInArrow(cutting(sent, level, True), kind)
    cuts = cut(cuts.groupBy("file", "at", "inside").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value")))
    outside = defaultdict(list)
    for r in sorted(cuts.filter("not inside").collect(), key=lambda r: r["at"]):
        outside[r["file"]].append((r["at"], r["value"]))
    for file, texts in outside.items():
        if ends[file] < 0:
            texts[-1] = (texts[-1][0], texts[-1][1].rstrip()[:-1])
    whole = raw.mapInArrow(cutting(sent, level, False), kind)
    return whole.select("file", "at", "value").unionByName(only(cuts, F.col("inside")).select("file", "at", "value")), dict(outside)


def of_array(spark: SparkSession, path: str) -> DataFrame | None:
    """(at, value): the elements of arrays, one a file; None if a file is no array."""
    found, outside = parts(spark, path)
    if any([t.strip("\ufeff \t\r\n") for _, t in texts] != ["[", "]"] for texts in outside.values()):
        return None
    empty = [file for file, texts in outside.items() if texts[1][0] == 2]
    if empty:
        found = only(found, ~(F.col("file").isin(empty) & F.col("value").rlike(r"^\s*$")))
    return found.select((F.col("at") - 1).alias("at"), "value")


def of_member(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, str] | None:
    """((at, value) of the array that an object has under a name, the object's text without them); None for anything else."""
    found, outside = parts(spark, path, 2)
    if len(outside) != 1:
        return None
    (texts,) = outside.values()
    places = [i for i, (_, t) in enumerate(texts) if re.search(rf'[{{,]\s*"{re.escape(name)}"\s*:\s*\[$', t)]
    if len(places) != 1 or not texts[0][1].strip("\ufeff \t\r\n").startswith("{"):
        return None
    a, b = texts[places[0]][0], texts[places[0] + 1][0]
    mine = only(found, (F.col("at") > a) & (F.col("at") < b))
    if b == a + 2:
        mine = only(mine, ~F.col("value").rlike(r"^\s*$"))
    others = [(r["at"], r["value"], True) for r in found.filter((F.col("at") < a) | (F.col("at") > b)).collect()]
    text, before = "", False
    for _, value, inside in sorted([*others, *((at, t, False) for at, t in texts)]):
        text, before = text + "," * (before and inside) + value, inside
    return mine.select((F.col("at") - (a + 1)).alias("at"), "value"), text
