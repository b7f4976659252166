import zlib

import numpy as np
import pytest

from weftline.llm import shards
from weftline.session import fresh_path


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 4097])
def test_permutation_and_its_inverse(n):
    places = shards.permuted(np.arange(n), n, 5)
    assert sorted(places.tolist()) == list(range(n))
    assert shards.row_at(places % 40, places // 40, n, 40, 5).tolist() == list(range(n))
    if n > 50:
        assert np.abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.2


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in shards.assign(docs.repartition(7)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    n = len(texts)
    for number, d in enumerate(sorted(texts)):
        r, data = rows[d], (texts[d] or "").encode()
        place = int(shards.permuted(np.array([number]), n, 7)[0])
        assert (r.size, r.text_crc32, r.row, r.shard, r.slot) == (len(data) + 16, zlib.crc32(data), number, place % 40, place // 40)


def test_repeats_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (4, "a", 2), (4, "a", 3), (4, "b", 4)], "doc_id bigint, text string, shard int")
    rows = shards.assign(df, 3).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4
    assert sorted(r.slot for r in rows) == [0, 0, 0, 1]
    assert shards.assign(df.limit(0)).count() == 0
    path = fresh_path(spark, "shards")
    shards.write_shards(df, path, 3)
    kept = spark.read.parquet(path).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("4", "a"), ("4", "a"), ("4", "b"), ("None", "None")]
