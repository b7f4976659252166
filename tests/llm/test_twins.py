import zlib

import duckdb

from weftline.llm import twins


def test_crc32_of_utf8_bytes():
    texts = ["0", "17", "12:wörter", "-5:añadir ÿ", "日本"]
    con = duckdb.connect()
    for t in texts:
        assert con.execute(f"SELECT {twins.crc32('x')} FROM (SELECT ?::VARCHAR AS x)", [t]).fetchone()[0] == zlib.crc32(t.encode())
