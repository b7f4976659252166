"""Row shaping against the documented small cases."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import chats, cleaning, rows
from weftline.functions import text as tx, urls


def batch(spark, n):
    return spark.createDataFrame([(i, chr(97 + i)) for i in range(n)], "i long, label string")


@pytest.mark.parametrize("divisor,total", [(2, 4), (3, 3), (7, 7)])
def test_padding_cycles_and_unpads(spark, divisor, total):
    got = rows.pad_to_divisor(batch(spark, 3), divisor, ["i"]).orderBy("row_idx").collect()
    assert len(got) == total
    assert [r.label for r in got] == ["abc"[i % 3] for i in range(total)]
    assert [r.label for r in got if not r.is_pad] == ["a", "b", "c"]


def test_repeat_then_fold_then_reorder(spark):
    three = rows.repeat_rows(batch(spark, 3), 2)
    folded = rows.fold(three, ["i", "sample_idx"], 2, ["label"]).orderBy("fold_id")
    assert [r.label for r in folded.collect()] == [["a", "a"], ["b", "b"], ["c", "c"]]
    turned = rows.reorder(folded, ["fold_id"], spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "out_pos long, pos long"))
    flat = rows.unfold(turned, "out_pos", ["label"]).orderBy("out_pos", "pos")
    assert [r.label for r in flat.collect()] == ["b", "b", "c", "c", "a", "a"]


def test_fold_needs_a_whole_multiple(spark):
    with pytest.raises(Exception, match="no multiple"):
        rows.fold(batch(spark, 5), ["i"], 2, ["label"]).collect()


def test_zip_columns_rejects_conflicts_and_missing_rows(spark):
    a = spark.createDataFrame([(1, "x", float("nan")), (2, "y", 1.0)], "k long, s string, d double")
    assert rows.zip_columns(a, a.withColumn("e", F.lit(5)), "k").count() == 2
    with pytest.raises(Exception, match="shared column differs"):
        rows.zip_columns(a, a.withColumn("s", F.lit("z")), "k").collect()
    with pytest.raises(Exception, match="row keys differ"):
        rows.zip_columns(a, a.filter("k = 1"), "k").collect()


def test_chunk_must_divide(spark):
    with pytest.raises(ValueError):
        rows.chunk_rows(batch(spark, 5), 2, ["i"])
    assert [r.chunk for r in rows.chunk_rows(batch(spark, 6), 3, ["i"]).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]


def test_concat_needs_equal_columns(spark):
    with pytest.raises(ValueError):
        rows.concat([batch(spark, 2), batch(spark, 2).drop("label")])


def test_shuffle_is_a_permutation(spark):
    got = rows.seeded_order(batch(spark, 20), 5, ["i"]).collect()
    assert sorted(r.pos for r in got) == list(range(20))
    assert [r.i for r in sorted(got, key=lambda r: r.pos)] != list(range(20))


def test_url_rules_take_the_first_hit(spark):
    cases = {
        "https://www.youtube.com/watch": "domain", "http://news.bbc.co.uk/a.pdf?x=1": "extension", "http://x": "short",
        "ftp://some.where.org/file": "malformed", "https://good.example.org/a": "keep", "https://user@GOOD.example.org/b": "malformed",
        "https://kym-cdn.com/x": "domain", "http://10.0.0.1/x": "keep",
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)] + [(99, "https://good.example.org/a")], "id long, url string")
    got = {r.id: r.status for r in urls.url_filter(df, "url", "id").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert got[99] == "duplicate"


def test_cleanup_stops_at_the_first_rule(spark):
    long = "word " * 200
    df = spark.createDataFrame([("short",), ("see javascript",), (long + "\n\nend",)], "text string")
    got = [(r.rule, r.removed) for r in cleaning.cleanup_rules(df, "text", ("remove_512", "general_cleaning")).collect()]
    assert got == [("remove_512", True), ("remove_512", True), ("general_cleaning", False)]
    both = cleaning.cleanup_rules(df, "text", ("remove_256_javascript", "ftfy_fix_text", "general_cleaning")).collect()
    assert [r.rule for r in both] == ["ftfy_fix_text", "remove_256_javascript", "ftfy_fix_text"]
    assert both[2].new_text.endswith("\n\nend")


@pytest.mark.parametrize("bad,good", [("cafÃ©", "café"), ("it‘s “so”", "it's \"so\""), ("a\r\nb\x07", "a\nb"), ("naïve", "naïve"), ("Ã", "Ã")])
def test_text_repair(spark, bad, good):
    assert spark.createDataFrame([(bad,)], "t string").select(tx.fix_text(F.col("t"))).first()[0] == good


def test_prompt_length_needs_every_variant(spark):
    df = spark.createDataFrame([(1, [("user", "a b")], [("user", "a b c d e f g h")]), (2, [("user", "a")], [("user", "b")])],
                               "id int, prompt array<struct<role:string,content:string>>, hint array<struct<role:string,content:string>>")
    assert [r.id for r in chats.filter_by_prompt_length(df, ["prompt", "hint", "cot"], 6).collect()] == [2]


def test_context_adds_stops_and_keeps_the_last_turns(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Hi", "Yes?", "Go!", "So", "End"])], "c int, turn int, text string")
    got = {r.turn: r.context for r in chats.dialog_context(df, "c", "turn", "text", last=3).collect()}
    assert got == {0: "", 1: "Hi.", 2: "Hi. [SEP] Yes?", 3: "Hi. [SEP] Yes? [SEP] Go!", 4: "Yes? [SEP] Go! [SEP] So."}


def test_words_and_offsets(spark):
    got = spark.createDataFrame([("Ab, cd_1  é!",)], "t string").select(tx.words_with_positions(F.col("t")).alias("w")).first().w
    assert [(x.word, x.start) for x in got] == [("ab", 0), ("cd_1", 4), ("é", 10)]


def test_answer_search(spark):
    df = spark.createDataFrame([("The U.S. won in 1990.", ["u.s"], ["won  in"], ["19[0-9]+"], ["("])], "t string, a array<string>, b array<string>, c array<string>, d array<string>")
    row = df.select(tx.has_answer(F.col("t"), F.col("a")).alias("a"), tx.has_answer(F.col("t"), F.col("b")).alias("b"),
                    tx.has_answer(F.col("t"), F.col("c"), "regex").alias("c")).first()
    assert (row.a, row.b, row.c) == (True, True, True)
    assert df.select(tx.has_answer(F.col("t"), F.col("d"), "regex")).first()[0] is False
