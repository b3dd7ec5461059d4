"""Readers of the JSON inputs. Errors stop a read: a broken file gives no partial result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.schema import DIMS, TEST_DATA, TRANSACTION, Scale, one_line, struct
from quintet.sources import elements


def whole(spark: SparkSession, path: str) -> DataFrame:
    """(value, path): each file's text."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of a JSON array, or of files of one a line, by the fixed schema."""
    found = elements.of_array(spark, path)
    if found is not None:
        return found.select(parsed(F.col("value"), struct(TRANSACTION)).alias("r")).select("r.*")
    return spark.read.schema(one_line(TRANSACTION)).option("mode", "FAILFAST").option("multiLine", True).json(path)


def transaction_lines(spark: SparkSession, path: str) -> DataFrame:
    """As transactions(), for files of one a line, which are splittable."""
    return spark.read.schema(one_line(TRANSACTION)).option("mode", "FAILFAST").json(path)


def checked(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """rows, failing at the first vector of another size or label that is missing."""
    sized = F.assert_true(F.coalesce(F.size("vector") == dims, F.lit(False)), F.lit(f"a vector must have {dims} dimensions"))
    named = F.assert_true(F.col("label").isNotNull(), F.lit("a label must be text"))
    return rows.filter(sized.isNull() & named.isNull())


def references(spark: SparkSession, path: str, dims: int = DIMS) -> DataFrame:
    """(ref_idx, vector, label) of one JSON array, .gz too; ref_idx is the place in the file.

    A compressed array is read by one task: convert it to Parquet once with
    sinks.references_parquet and read that from then on. Labels are cut to the
    7 characters that are compared.
    """
    found = elements.of_array(spark, path)
    if found is None:
        raise ValueError(f"{path} is no JSON array")
    rows = found.select("at", parsed(F.col("value"), "struct<vector:array<double>,label:string>").alias("r")).select(F.col("at").alias("ref_idx"), "r.vector", F.substring("r.label", 1, 7).alias("label"))
    return checked(rows, dims)


def scale(spark: SparkSession, path: str) -> Scale:
    """The divisors; all are required."""
    schema = ", ".join(f"{k} double" for k in Scale().to_dict())
    row = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).first()
    if row is None or None in tuple(row):
        raise ValueError(f"{path} lacks a divisor")
    return Scale(**row.asDict())


def risk_table(spark: SparkSession, path: str) -> DataFrame:
    """(code, risk) of a JSON object with any keys."""
    maps = whole(spark, path).select(parsed(F.col("value"), "map<string,double>").alias("m"))
    return maps.select(F.posexplode(F.map_entries("m")).alias("at", "e")).select("at", F.col("e.key").alias("code"), F.col("e.value").alias("risk"))


def risk(spark: SparkSession, path: str) -> dict[str, float]:
    """The map in its order; a lookup sees its first 32 entries (vectorize.usable)."""
    return {r["code"]: r["risk"] for r in risk_table(spark, path).orderBy("at").limit(32).collect()}


def test_data(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries with idx, one row of stats) of a labelled test file."""
    found = elements.of_member(spark, path, "entries")
    if found is None:
        raise ValueError(f"{path} is no labelled test file")
    one = f"struct<request:{struct(TRANSACTION)},expected_approved:boolean,expected_fraud_score:double>"
    entries = found[0].select(F.col("at").cast("int").alias("idx"), parsed(F.col("value"), one).alias("e")).select("idx", "e.request.*", "e.expected_approved", "e.expected_fraud_score")
    all_of = spark.createDataFrame([(found[1],)], "value string").select(parsed(F.col("value"), struct(TEST_DATA)).alias("e")).select("e.*")
    return entries, all_of.select("references_checksum_sha256", "stats.*")


def participants(spark: SparkSession, folder: str) -> DataFrame:
    """(participant, submissions): one file a participant, named after them."""
    files = whole(spark, f"{folder.rstrip('/')}/*.json")
    return files.select(
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("participant"), parsed(F.col("value"), "array<struct<id:string,repo:string>>").alias("submissions")
    )


def registry(spark: SparkSession, path: str, result: str) -> DataFrame:
    """(participant, submission, result's columns) of a registry file; result is their schema."""
    maps = whole(spark, path).select(parsed(F.col("value"), f"map<string,map<string,struct<{result}>>>").alias("m"))
    people = maps.select(F.explode("m").alias("participant", "s"))
    return people.select("participant", F.explode("s").alias("submission", "r")).select("participant", "submission", "r.*")


def runner_config(spark: SparkSession, path: str) -> DataFrame:
    """One row; max_memory_mb is text in the file and max_cpu a number."""
    schema = (
        "participants_dir string, test_script string, post_test_script string, submission_health_check_endpoint string, submission_health_check_retries int, "
        "submission_health_check_interval_ms int, api_issues_url string, poll_interval_ms int, max_preview_submissions_per_day int, max_cpu double, max_memory_mb string"
    )
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def checksum(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files' bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
