"""Readers and writers: bad input, duplicate keys, shifted ids, resumable blocks."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from weftline.sources import files, keyed_json

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def test_bad_lines_are_dropped_or_set_aside(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text('{"id": 1, "text": "a"}\n{"id": 2, "te\n\nnot json\n{"id": 3, "text": "c"}\n')
    good, bad = files.read_jsonl(spark, str(path), SCHEMA, on_error="quarantine")
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert sorted(r.line for r in bad.collect()) == ["not json", '{"id": 2, "te']
    assert files.read_jsonl(spark, str(path), SCHEMA)[1].count() == 0


def test_merge_keeps_lines_that_parse(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nbroken\n')
    (tmp_path / "b.jsonl").write_text('{"id": 2}\n')
    out = str(tmp_path / "out")
    files.merge_jsonl(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")], out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"id": 1}', '{"id": 2}']


def test_repeated_keys_in_evidence_are_an_error(spark, tmp_path):
    path = tmp_path / "e.tsv"
    path.write_text("id\ttext\ttitle\n1\ta\tA\n1\tb\tB\n")
    with pytest.raises(ValueError, match="not unique"):
        files.read_tsv(spark, str(path), "id long, text string, title string", unique="id")
    assert files.read_tsv(spark, str(path), "id long, text string, title string").count() == 2


def test_strict_union_needs_equal_schemas(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b"))
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    with pytest.raises(ValueError):
        files.read_parquet_union(spark, paths)
    assert sorted(files.read_parquet_union(spark, paths, strict=False).columns) == ["id", "x"]


def test_later_token_tables_move_their_ids(spark):
    a = spark.createDataFrame([(0, [1]), (1, [2])], "doc_id long, tokens array<int>")
    b = spark.createDataFrame([(0, [3])], "doc_id long, tokens array<int>")
    assert sorted((r.doc_id, r.tokens) for r in files.merge_token_tables([a, b, b]).collect()) == [(0, [1]), (1, [2]), (2, [3]), (3, [3])]
    with pytest.raises(ValueError):
        files.merge_token_tables([a, b.withColumn("tokens", F.col("tokens").cast("array<long>"))])


def test_wide_prompts_split_into_blocks(spark):
    df = spark.range(10).select(F.lit("p").alias("uid"), F.col("id").alias("i"), F.col("id").cast("string").alias("resp"))
    got = files.response_rows(df, "uid", "i", "resp", width=4).orderBy("block").collect()
    assert [r.responses for r in got] == [["0", "1", "2", "3"], ["4", "5", "6", "7"], ["8", "9"]]


def test_blocks_written_short_are_missing(spark):
    done = spark.createDataFrame([(0, 4), (4, 3)], "block_start long, n_rows long")
    assert [(r.block_start, r.block_end) for r in files.missing_blocks(spark, 10, 4, done).orderBy("block_start").collect()] == [(4, 8), (8, 10)]


def test_keyed_json_with_metrics_and_failed_tasks(spark, tmp_path):
    """Keys with slashes and nulls, a sum per key; a job whose task fails leaves nothing that is read."""
    path, schema = str(tmp_path / "out"), "id long, key string, score double, text string"
    rows = [(i, ["a/b", "c", None][i % 3], i * 0.5, f"té\n{i}") for i in range(60)]
    df = spark.createDataFrame(rows, schema).repartition(4)
    broken = df.withColumn("id", F.when(F.col("id") == 37, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        keyed_json.write_keyed_json(broken, path, "key", ["score"])
    assert keyed_json.read_keyed_json(spark, path, schema).count() == 0
    keyed_json.write_keyed_json(df, path, "key", ["score"])
    back = keyed_json.read_keyed_json(spark, path, schema)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    metrics = json.loads((tmp_path / "out" / "metrics.json").read_text())
    assert metrics == {k: {"rows": 20, "score": sum(r[2] for r in rows if r[1] == v)} for k, v in (("a_b", "a/b"), ("c", "c"), ("_null", None))}


def test_keyed_json_stream_commits_a_batch_once(spark, tmp_path):
    feed, path, mark = (str(tmp_path / n) for n in ("feed", "out", "mark"))
    for part in (range(0, 10), range(10, 25)):
        spark.createDataFrame([(i, f"k{i % 2}") for i in part], "id long, key string").write.mode("append").parquet(feed)
        keyed_json.stream_keyed_json(spark.readStream.schema("id long, key string").parquet(feed), path, "key", mark, ["id"]).awaitTermination()
    # the last batch loses its commit in the checkpoint and is run again
    for name in ("1", ".1.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    keyed_json.stream_keyed_json(spark.readStream.schema("id long, key string").parquet(feed), path, "key", mark, ["id"]).awaitTermination()
    assert sorted(r.id for r in keyed_json.read_keyed_json(spark, path, "id long, key string").collect()) == list(range(25))
    assert json.loads((tmp_path / "out" / "batch=1" / "metrics.json").read_text()) == {"k0": {"rows": 8, "id": sum(range(10, 25, 2))}, "k1": {"rows": 7, "id": sum(range(11, 25, 2))}}
