"""Writers, and the exact JSON that they write."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.functions.scalars import ISO, json_array, json_number




def text(x) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(x.alias("s"))), r'^\{"s":(.*)\}$', 1)


def member(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null")))


def object_of(*members: Column) -> Column:
    parts = [x for m in members for x in (F.lit(","), m)][1:]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def moment(x) -> Column:
    return F.concat(F.lit('"'), F.date_format(x, ISO), F.lit('"'))


def request_json(nulls: bool = True) -> Column:
    """A transaction as compact JSON: numbers in their short form, an absent last transaction as null."""
    n = lambda c: json_number(F.col(c).cast("double"))
    last = F.when(F.col("last_transaction").isNull(), F.lit("null")).otherwise(
        object_of(member("timestamp", moment("last_transaction.timestamp")), member("km_from_current", n("last_transaction.km_from_current")))
    )
    known = F.concat(F.lit("["), F.array_join(F.transform("customer.known_merchants", text), ","), F.lit("]"))
    flag = lambda c: F.col(c).cast("string")
    parts = [
        member("id", text(F.col("id"))),
        member("transaction", object_of(member("amount", n("transaction.amount")), member("installments", n("transaction.installments")), member("requested_at", moment("transaction.requested_at")))),
        member("customer", object_of(member("avg_amount", n("customer.avg_amount")), member("tx_count_24h", n("customer.tx_count_24h")), member("known_merchants", known))),
        member("merchant", object_of(member("id", text(F.col("merchant.id"))), member("mcc", text(F.col("merchant.mcc"))), member("avg_amount", n("merchant.avg_amount")))),
        member("terminal", object_of(member("is_online", flag("terminal.is_online")), member("card_present", flag("terminal.card_present")), member("km_from_home", n("terminal.km_from_home")))),
    ]
    return object_of(*parts, *([member("last_transaction", last)] if nulls else []))


def reference_json() -> Column:
    """A labelled vector as compact JSON."""
    return object_of(member("vector", json_array("vector")), member("label", text(F.col("label"))))


def write_lines(rows: DataFrame, json: Column, path: str) -> None:
    """One JSON value a line, in as many files as there are partitions."""
    rows.select(json.alias("value")).write.mode("overwrite").text(path)


def write_array(rows: DataFrame, json: Column, order: str, path: str) -> None:
    """One JSON array in one file, in order, an element a line."""
    write_whole(rows, json, order, "[", "]", path)


def write_whole(rows: DataFrame, json: Column, order: str, head: str, tail: str, path: str) -> None:
    """One file below path: rows' texts in order, joined by commas, between head and tail.

    Parts are sorted and written by all tasks, and then copied one after another,
    each going once it is copied; no text is in memory as a whole.
    """
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    fs.delete(to, True)
    dealt = rows.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), order).sortWithinPartitions(order)
    dealt.select(F.concat(F.lit(","), json)).write.text(f"{path}/_parts")
    parts = sorted((s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(to, "_parts")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName())
    made = jvm.org.apache.hadoop.fs.Path(to, "_made")
    out = fs.create(made, True)
    try:
        out.write(bytearray(head.encode()))
        for i, s in enumerate(parts):
            part = fs.open(s.getPath())
            try:
                if not i:
                    part.read()  # the first comma
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            finally:
                part.close()
            fs.delete(s.getPath(), False)
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(to, "_parts"), True)
    fs.rename(made, jvm.org.apache.hadoop.fs.Path(to, "part-00000.json"))


def write_test_data(entries: DataFrame, stats: DataFrame, checksum: str, path: str) -> None:
    """The labelled test file: the references' checksum, the row of stats, and entries (idx, request, expected …) in order, as one value."""
    one = object_of(member("request", request_json()), member("expected_approved", F.col("expected_approved").cast("string")), member("expected_fraud_score", json_number("expected_fraud_score")))
    told = stats.select(F.to_json(F.struct(*stats.columns))).first()[0]
    write_whole(entries, one, "idx", f'{{"references_checksum_sha256":{json.dumps(checksum)},"stats":{told},"entries":[', "]}", path)


def references_parquet(references: DataFrame, path: str) -> None:
    """References for repeated use: columns, sorted by bucket so that a bucket's rows are read alone."""
    from quintet.operators.knn import bucket

    references.withColumn("bucket", bucket(F.col("vector"))).sortWithinPartitions("bucket", "ref_idx").write.mode("overwrite").parquet(path)


def pretty(value) -> Column:
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


def write_report(report: DataFrame, path: str) -> None:
    """The one-row report, indented."""
    report.select(pretty(F.col("report")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: Fixed value of the workload: the line's format.
STATS_LINE = "Stats: total=%d fraud=%d (%.1f%%) legit=%d (%.1f%%) edge=%d (%.1f%%)"


def stats_line(stats: DataFrame) -> DataFrame:
    """One line that tells the label counts, with shares of the counts themselves."""

    @F.pandas_udf("string")
    def line(total: pd.Series, fraud: pd.Series, legit: pd.Series, edge: pd.Series) -> pd.Series:
        share = lambda n, of: 100.0 * n / of if of else float("nan")
        rows = zip(*(c.astype(int).tolist() for c in (total, fraud, legit, edge)), strict=True)
        return pd.Series([STATS_LINE % (t, f, share(f, t), g, share(g, t), e, share(e, t)) for t, f, g, e in rows], dtype=object)

    return stats.select(line("total", "fraud_count", "legit_count", "edge_case_count").alias("line"))


def registry_json(registry: DataFrame, indent: int = 4) -> str:
    """{participant: {submission: result}} as indented JSON; a registry is small by its nature."""
    rows = registry.orderBy("participant", "submission").select("participant", "submission", F.to_json(F.struct(*[c for c in registry.columns if c not in ("participant", "submission")])).alias("r"))
    out: dict[str, dict] = {}
    for r in rows.toLocalIterator():
        out.setdefault(r["participant"], {})[r["submission"]] = json.loads(r["r"])
    return json.dumps(out, indent=indent, ensure_ascii=False)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """A file with this text, in place of one that may be there: written beside it and renamed over it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(conf)
    to = fs.makeQualified(to)
    part = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".{to.getName()}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf).rename(part, to, how)


def write_registry(registry: DataFrame, path: str) -> None:
    """The registry as one JSON file that is replaced whole or not at all."""
    replace_file(registry.sparkSession, path, registry_json(registry))
