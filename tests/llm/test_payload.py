import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from weftline.llm import payload, tokens
from weftline.session import fresh_path

TEXTS = ["", " ", "  ", "a  b", "a \n b", "don't stop's 'tis it's", "<|endoftext|> a <|endoftext|>b", "a\xa0 b", "½ x² a1b2", "\n", "a ", " a", "tab\t tab", "éa' 'b", "x" * 300,
         "end.\nNext 12,345 $$$ %%% ok&&& ", "a\x1c b\x85 c", chr(0x3000) + " wide " + chr(0x200B) + "z", "日本語 テキスト", "é combining"]


def test_encoder_equals_the_tokenizer_on_whole_texts():
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choice("ab é.,'\n\t0|<>$") for _ in range(draw.randrange(60))) for _ in range(500)] + [None]
    ids, bounds = tokens.Encoder(tokens.vocabulary_path()).encode(pa.array(texts))
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [0], repr(t)


def test_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000)).astype(np.uint64)
    sizes, bits = payload.build_hash(keys)
    assert sorted(payload.Hash(sizes, bits)(keys).tolist()) == list(range(len(keys)))
    assert payload.Hash(*payload.build_hash(keys[:0]))(keys[:3]).tolist() == [-1, -1, -1]


def test_round_trip_and_lookups(spark):
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(100_000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id bigint, text string, start int").repartition(3)
    folder = fresh_path(spark, "ids")
    payload.write_ids(df, folder)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in payload.lookup(spark, folder, df).collect()}
    want, start = {}, 0
    for d, t in sorted(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[d] = start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert got == want
    some = payload.lookup(spark, folder, spark.createDataFrame([(3,), (-5,), (10**12,)], "doc_id bigint"), with_ids=True).collect()
    assert [(r.doc_id, r.ids) for r in some] == [(3, tokenizer.encode(dict(docs)[3], add_special_tokens=False).ids + [0])]


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, "b c"), (1, "b c"), (2, "")], "doc_id bigint, text string")
    rows = sorted((str(r.doc_id), r.start, r.n_tokens) for r in payload.write_and_read(spark, df).collect())
    assert [r[0] for r in rows] == ["1", "1", "1", "2", "None"]
    assert sorted((s, n) for _, s, n in rows)[0] == (0, 2) and sum(n for *_, n in rows) == 2 + 1 + 3 + 3 + 1
    assert payload.write_and_read(spark, df.limit(0)).count() == 0
