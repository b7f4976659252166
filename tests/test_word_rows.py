"""A row per word leaves the worker in bounded pieces."""

import re

from pyspark.sql import functions as F

from weftline.functions import text as tx


def test_rows_are_those_of_the_column(spark, monkeypatch):
    monkeypatch.setattr(tx, "WORD_ROWS", 7)
    texts = ["Ab, cd_1  é! " * 9, "", None, "...", "one", "İa bc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = sorted((r.id, r.i, r.word, r.start) for r in tx.word_rows(df, "id", "t").collect())
    assert got == [(k, i, m.group(), m.start()) for k, t in enumerate(texts) for i, m in enumerate(re.finditer(r"\w+", (t or "").lower()))]


def test_batches_are_bounded(spark):
    df = spark.createDataFrame([(1, "a b " * 150_000)], "id long, t string")

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})
    out = [r.n for r in tx.word_rows(df, "id", "t").mapInArrow(sizes, "n long").collect()]
    assert sum(out) == 300_000 and max(out) <= tx.WORD_ROWS
