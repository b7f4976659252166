"""Readers and writers for the file formats of corpora and rollouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.index import with_row_index


def read_parquet_union(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """Many Parquet paths as one table; strict schemas, or outer columns filled with nulls."""
    parts = [spark.read.parquet(p) for p in paths]
    if strict and any(p.schema.simpleString() != parts[0].schema.simpleString() for p in parts):
        raise ValueError("schemas differ")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), parts)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines). A bad line never fails the job; ``drop`` gives no bad lines back."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = spark.read.text(path).select(
        "value",
        F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    good = parsed.filter(F.col("r._corrupt").isNull() & (F.trim("value") != "")).select(*[F.col(f"r.{f.name}") for f in schema.fields])
    bad = parsed.filter(F.col("r._corrupt").isNotNull()).select(F.col("value").alias("line"))
    return good, (bad if on_error == "quarantine" else bad.limit(0))


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = True, unique: str | None = None) -> DataFrame:
    """Tab-separated rows; a repeated ``unique`` key is an error."""
    df = spark.read.schema(schema).option("sep", "\t").option("header", header).csv(path)
    if unique:
        twice = df.groupBy(unique).count().filter("count > 1").limit(1).count()
        if twice:
            raise ValueError(f"{unique} is not unique")
    return df


def write_jsonl_by(df: DataFrame, path: str, key: str) -> None:
    """One file set per key value, ``/`` in the key made ``_``."""
    df.withColumn("key_safe", F.replace(F.col(key), F.lit("/"), F.lit("_"))).write.partitionBy("key_safe").json(path)


def merge_jsonl(spark: SparkSession, paths: str | list[str], out: str | None = None) -> DataFrame:
    """Every line of every file, as long as it parses as a JSON object."""
    lines = spark.read.text(paths).filter(F.try_variant_get(F.try_parse_json("value"), "$", "variant").isNotNull())
    if out:
        lines.write.text(out)
    return lines


def merge_token_tables(dfs: list[DataFrame]) -> DataFrame:
    """Append token tables; document ids of later parts move past the earlier ones."""
    kinds = {d.schema["tokens"].dataType.simpleString() for d in dfs}
    if len(kinds) != 1:
        raise ValueError(f"token types differ: {sorted(kinds)}")
    parts = reduce(DataFrame.unionByName, [d.withColumn("part", F.lit(i)) for i, d in enumerate(dfs)])
    # one row per part: bounded by the number of input tables
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("part").agg((F.max("doc_id") + 1).alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return parts.join(F.broadcast(shifts), "part").withColumn("doc_id", F.col("doc_id") + F.col("_shift")).drop("_shift")


def response_rows(df: DataFrame, uid: str, sample: str, response: str, width: int) -> DataFrame:
    """Responses of a prompt as an ordered array, at most ``width`` to a row.

    ``block`` numbers the rows of a prompt with more samples than that, so no
    prompt is ever gathered whole into one task.
    """
    return (
        df.groupBy(uid, F.floor(F.col(sample) / width).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(sample, response))).alias("_r"))
        .select(uid, "block", F.col(f"_r.{response}").alias("responses"))
    )


def missing_blocks(spark: SparkSession, n: int, block: int, written: DataFrame) -> DataFrame:
    """Fixed row ranges of a resumable job that are not yet written whole.

    ``written`` holds (block_start, n_rows); a block with a wrong count is not valid.
    """
    expected = spark.range(-(-n // block)).select(
        (F.col("id") * block).alias("block_start"),
        F.least(F.lit(n), (F.col("id") + 1) * block).alias("block_end"))
    good = written.withColumnRenamed("block_start", "_s")
    whole = (F.col("block_start") == F.col("_s")) & (F.col("n_rows") == F.col("block_end") - F.col("block_start"))
    return expected.join(good, whole, "left_anti")
