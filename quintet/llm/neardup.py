"""MinHash near-dedup by an inverted join of signature coordinates.

Equal shingle sets are one class first. Each class posts its id under each of
its `coords` (coordinate, value) pairs. Two sets of similarity s agree in each
coordinate with probability s, so a pair is a candidate if it collides in at
least `least` of them, and a candidate is a link if the full sets say so. With
64 coordinates, 32 collisions and a similarity of 0.75 a true link is missed
with probability under 1e-5; everything after the signatures is exact.

Collisions are counted by prefix and skip merging. Values that one class alone
posts are skipped; a class with fewer than `least` shared values can collide
with no other often enough and is skipped whole; each remaining class needs to
be looked up under its size - least + 1 rarest values only, since two lists
that share `least` values must meet in those. Values of passages that many
documents share are the frequent ones and so are not looked up.

A group of classes under one value never becomes all its pairs. First
each member is compared with three hubs of its group that lie in other
components, verified links merge components, and values within a single
component are skipped from then on, which resolves groups of near copies in a
number of pairs linear in their size. Members of different components that
still share enough values are looked up once more, by the shingles themselves:
the same skipping and prefixes, now with the exact number of shingles that a
link needs, leave a member that is far from all others without a single lookup.
What is left after a round of hubs there, too, is compared pair by pair under the
rarest shingles, so that no link is lost.

Comparing streams the members past their hub: rows are dealt by hub and a salt
that splits hubs of many partners, sorted so that the hub's set comes first.

Every step is a table in the shared folder, read by the next and deleted with
its shuffle files when no later step needs it, so the disk holds one round.

Defined results: null or empty texts (no words) have no shingles and link with
nothing; rows that repeat an id each get their own text's component; a null id
is never the smallest unless its whole component has none, and is then its own
group's kept one; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.llm import common, shingles
from quintet.llm.components import components

WIDTH, COORDS, LEAST, PERCENT = 5, 64, 32, 75
U = np.uint64


def signed(docs: DataFrame, id_col: str, text_col: str, width: int, coords: int) -> DataFrame:
    """(id, t, n, cid, sig): the text's hash, set size, 64-bit class id of the set, and MinHash values."""

    def sign(batches):
        flip, by = shingles.stream(3, coords), shingles.stream(4, coords) | U(1)
        import xxhash

        for b in common.by_bytes(batches, "text", 1 << 20):
            own = shingles.sets(common.utf8(b.column("text")), width)
            n = np.array([len(s) for s in own], np.int64)
            sig = np.zeros((len(own), coords), U)
            full = np.flatnonzero(n)
            if len(full):
                flat, at = np.concatenate(own), np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for k in range(coords):
                    sig[full, k] = np.minimum.reduceat((flat ^ flip[k]) * by[k], at)
            ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in own]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * coords, pa.int32()), pa.array(sig.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(n), pa.array(ids, pa.int64()), lists], names=["id", "t", "n", "cid", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sign, "id long, t long, n long, cid long, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cid, set): the packed shingles of wanted classes (rep, cid), from the texts of their representatives."""
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    both = texts.join(wanted, texts["rep"].eqNullSafe(wanted["id"]))

    def pack(batches):
        import xxhash

        for b in common.by_bytes(batches, "text", 1 << 20):
            rows = []
            for cid, s in zip(b.column("cid").to_pylist(), shingles.sets(common.utf8(b.column("text")), width), strict=True):
                # rows that share an id may hold another text than the class's
                if len(s) and xxhash.xxh3_64_intdigest(raw := s.tobytes()) - (1 << 63) == cid:
                    rows.append((cid, raw))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cid", "set"])

    return both.select("cid", "text").mapInArrow(pack, "cid long, set binary")


#: Bits of the filter that within() broadcasts; its 8 MB don't depend on the input.
FILTER_BITS = 1 << 26


def within(docs: DataFrame, id_col: str, ids: DataFrame):
    """docs without most of those that have none of the ids, so that their texts needn't be shuffled, and the broadcast.

    A filter of fixed size: the more ids, the more other rows pass, and a join decides.
    """
    place = F.pmod(F.xxhash64(F.col("id")), F.lit(FILTER_BITS))
    words = ids.select((place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    at = docs.withColumn("__at", F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(FILTER_BITS)))

    def keep(batches):
        for b in batches:
            where = b.column(b.num_columns - 1).to_numpy()
            yield b.filter(pa.array((sent.value[where >> 6] >> (where & 63) & 1).astype(bool)))

    return at.mapInArrow(keep, at.schema).drop("__at"), sent


def verified(pairs: DataFrame, facts: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b): collisions counted on the signatures, then full sets compared."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("salts"))
    salted = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = hubs.join(facts, hubs["a"] == facts["cid"]).select("a", "salt", F.lit(0).alias("role"), "cid", "sig", "set").union(
        salted.join(facts, salted["b"] == facts["cid"]).select("a", "salt", F.lit(1).alias("role"), "cid", "sig", "set")
    )
    dealt = rows.repartition(common.partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")

    def compare(batches):
        hub = hub_sig = hub_set = None
        for b in common.by_bytes(batches, "set"):
            out = []
            for a, role, cid, sig, raw in zip(*(b.column(c).to_pylist() for c in ("a", "role", "cid", "sig", "set")), strict=True):
                if role == 0:
                    hub, hub_sig, hub_set = a, np.array(sig), np.frombuffer(raw, U)
                    continue
                if hub != a:
                    raise RuntimeError("a member came before its hub")
                linked = int((hub_sig == np.array(sig)).sum()) >= least
                if linked:
                    other = np.frombuffer(raw, U)
                    common_n = np.intersect1d(hub_set, other, assume_unique=True).size
                    linked = 100 * common_n >= percent * (len(hub_set) + len(other) - common_n)
                out.append((a, cid, linked))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "linked"])

    return dealt.mapInArrow(compare, "a long, b long, linked boolean")


#: Keys before its own that a row of prefixes() tells, so that most pairs meet once.
BEFORE = 16


def prefixes(members: DataFrame) -> DataFrame:
    """(cid, label, total, size, key, left, before) of the rarest keys of members (cid, label, need, total, key), among keys that several labels share.

    need: how many keys a link has to share. Fewer shared ones (size) than that, and there is no link.
    left: how many shared keys there are from this one on, in an order that is the same for all.
    before: the last keys in front of this one.
    """
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("key", "n")
    ranked = members.join(keys, "key").groupBy("cid", "label", "need", "total").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("ks"))
    some = ranked.filter(F.size("ks") >= F.col("need")).select(
        "cid", "label", "total", F.size("ks").alias("size"), F.expr("transform(slice(ks, 1, greatest(size(ks) - need + 1, 0)), x -> x.key)").alias("ks")
    )
    before = F.expr(f"slice(ks, greatest(at - {BEFORE - 1}, 1), least(at, {BEFORE}))")
    return some.select("*", F.posexplode("ks").alias("at", "key")).select("cid", "label", "total", "size", "key", (F.col("size") - F.col("at")).alias("left"), before.alias("before"))


def by_shingle(facts: DataFrame, wanted: DataFrame, percent: int) -> DataFrame:
    """(cid, need, total, key): the shingles of wanted classes; a link shares at least `need` of their `total`."""

    def explode(batches):
        for b in common.by_bytes(batches, "set", 1 << 20):
            own = [np.frombuffer(raw, np.int64) for raw in b.column("set").to_pylist()]
            n = np.array([len(x) for x in own])
            need = -(-percent * n // 100)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("cid").to_numpy(), n)), pa.array(np.repeat(need, n), pa.int32()), pa.array(np.repeat(n, n), pa.int32()), pa.array(np.concatenate(own))], names=["cid", "need", "total", "key"]
            )

    return facts.join(wanted, "cid", "left_semi").select("cid", "set").mapInArrow(explode, "cid long, need int, total int, key long")


def labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members with the component that each class is in so far."""
    if labels is None:
        return members.withColumn("label", F.col("cid"))
    return members.join(labels.toDF("cid", "component"), "cid", "left").withColumn("label", F.coalesce("component", "cid")).drop("component")


def merged(labels: DataFrame | None, links: DataFrame, keep: common.Scratch) -> DataFrame:
    """labels (node, component) after further links (a, b)."""
    if labels is None:
        return components(links.toDF("u", "v"), keep)
    between = (
        links.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("u"), F.coalesce("cb", "b").alias("v"))
    )
    better = components(between, keep)
    more = better.toDF("component", "better")
    old = labels.join(more, "component", "left").select("node", F.coalesce("better", "component").alias("component"))
    new = more.join(labels.select(F.col("node").alias("component")), "component", "left_anti").toDF("node", "component")
    found = keep(old.union(new))
    keep.drop(better, labels)
    return found


def stars(rare: DataFrame) -> DataFrame:
    """Each member with hubs of its group where the label differs: those of least and greatest label, and the centre.

    The centre is the member that shares most of its keys: what copies were made
    from shares all, and links even with those that link with few other copies.
    """
    one = F.struct("label", "cid")
    centre = F.max_by(one, F.struct(F.col("size") / F.col("total"), F.col("cid")))
    hubs = rare.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi"), centre.alias("centre")).filter("lo.label != hi.label")
    both = rare.select("key", "cid", "label").join(hubs, "key")
    return both.select("cid", "label", F.explode(F.array("lo", "hi", "centre")).alias("hub")).filter("hub.label != label").select(
        F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")
    ).distinct()


def crossings(rare: DataFrame, percent: int) -> DataFrame:
    """All pairs of different labels that meet under a key and may still share enough.

    The first key that a link's sets have in common has all others behind it on
    both sides; a key with fewer left than the link needs isn't that, or there is
    no link. A pair that has a key in common among those told before isn't at its first.
    """
    rare = rare.select("cid", "label", "total", "key", "left", "before")
    other = rare.select("key", F.col("cid").alias("other"), F.col("label").alias("its"), F.col("total").alias("its_total"), F.col("left").alias("its_left"), F.col("before").alias("its_before"))
    enough = (100 + percent) * F.least("left", "its_left") >= percent * (F.col("total") + F.col("its_total"))
    return rare.join(other, (rare["key"] == other["key"]) & (F.col("label") < F.col("its")) & enough & ~F.arrays_overlap("before", "its_before")).select(
        F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")
    ).distinct()


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, coords: int = COORDS,
    least: int = LEAST, percent: int = PERCENT, star_rounds: int = 1,
) -> DataFrame:
    """(id_col, n_shingles, cid, text_hash, component_id, kept), a row for each of docs.

    component_id: smallest id reachable over links of 100 * intersection >=
    percent * union; kept: the id is that. cid: the class of equal sets;
    text_hash: xxhash64 of the text, which tells rows of one id apart.
    """
    keep = common.Scratch(docs.sparkSession)
    wide = keep(signed(docs, id_col, text_col, width, coords))
    rows = keep(wide.select("id", "t", "n", "cid"))
    classes = keep(wide.filter("cid is not null").groupBy("cid").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    keep.drop(wide)
    posts = classes.select("cid", F.posexplode("sig")).select("cid", F.xxhash64("pos", "col").alias("key"))
    keys = posts.groupBy("key").count().filter("count > 1").select("key")
    shared = keep(posts.join(keys, "key").groupBy("cid").agg(F.collect_list("key").alias("ks")).filter(F.size("ks") >= least))
    keep.bounded(shared.count(), 5000)  # all that follows is about these classes
    wanted = classes.join(shared.select("cid"), "cid", "left_semi").select(F.col("rep").alias("id"), "cid", "sig")
    texts, sent = within(docs.select(id_col, text_col), id_col, wanted.select("id"))
    facts = keep(full_sets(texts, wanted.select("id", "cid"), id_col, text_col, width).dropDuplicates(["cid"]).join(wanted.select("cid", "sig"), "cid"))
    sent.unpersist()

    labels = tried = None
    members = shared.select("cid", F.lit(least).alias("need"), F.lit(coords).alias("total"), F.explode("ks").alias("key"))
    for turn in range(2 * star_rounds + 1):
        left = None
        if turn == star_rounds:  # by coordinates no longer, but by shingles
            left = keep(prefixes(labelled(members, labels)).select("cid").distinct())
            keep.drop(shared)
            members = by_shingle(facts, left, percent)
        rare = keep(prefixes(labelled(members, labels)))
        if turn >= star_rounds:  # components only grow, so who isn't looked up now never will be
            members = by_shingle(facts, rare.select("cid").distinct(), percent)
        pairs = stars(rare) if turn < 2 * star_rounds else crossings(rare, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = keep(pairs)
        seen = keep(verified(pairs, facts, least, percent))
        failed = seen.filter("not linked").select("a", "b")
        tried = failed if tried is None else tried.union(failed)
        links = seen.filter("linked").select("a", "b")
        if not links.isEmpty():
            labels = merged(labels, links, keep)
        keep.drop(pairs, left, rare if turn < star_rounds else None)

    named = classes.select("cid", "rep")
    if labels is None:
        named = named.select("cid", F.col("rep").alias("component_id"))
    else:
        named = named.join(labels.toDF("cid", "component"), "cid", "left").select("cid", "rep", F.coalesce("component", "cid").alias("component"))
        least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = named.join(least_id, "component").select("cid", "component_id")
    keep.tasks = None
    named = keep(named)
    keep.close(rows, named)
    found = rows.select("id", "t", "n", "cid").join(named, "cid", "left")
    ident = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cid", F.col("t").alias("text_hash"), ident.alias("component_id"), F.col("id").eqNullSafe(ident).alias("kept")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of `documents`."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("cid", "text_hash")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: those that are their component's smallest id; rows equal in id and text stay together."""
    own, name, back = common.masked(docs)
    gone = near_duplicates(docs).filter("not kept").select("doc_id", "text_hash").distinct()
    hashed = own.withColumn("__t", F.xxhash64(name["text"]))
    same = F.col(name["doc_id"]).cast("long").eqNullSafe(gone["doc_id"]) & (F.col("__t") == gone["text_hash"])
    return back(hashed.join(gone, same, "left_anti"))
