"""Answer grading, formats, scorers and training samples: golden cases."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays as ar, grading as gr, text as tx
from weftline.functions.wordpiece import wordpiece
from weftline.operators import metrics as me, objectives as ob, scoring as sc


def run(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("text,strict,flexible", [
    ("so #### 1,234", "1234", "1,234"), ("#### -5.0 then 7.", "-5.0", "7."), ("nothing . here.", None, "."), ("none", None, None), ("4 and .", None, "4"),
])
def test_hash_answers(spark, text, strict, flexible):
    assert run(spark, lambda t: gr.extract_hash_answer(t), text) == strict
    assert run(spark, lambda t: gr.extract_hash_answer(t, "flexible"), text) == flexible


@pytest.mark.parametrize("text,content", [
    (r"a \boxed{1} b \boxed{\frac{1}{\sqrt{2}}} c", r"\frac{1}{\sqrt{2}}"), (r"\boxed{open", None), (r"\fbox{3}", None),
    (r"$\boxed 5$ end", "5"), ("no box", None), (r"\boxed{}", ""),
])
def test_boxes(spark, text, content):
    assert run(spark, lambda t: gr.boxed_answer(t), text) == content


@pytest.mark.parametrize("raw,clean", [
    (r"\dfrac12", r"\frac{1}{2}"), (r"\frac1{72}", r"\frac{1}{72}"), (r"\tfrac{3}{4}", r"\frac{3}{4}"), ("0.5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"),
    ("x = 7", "7"), (r"\sqrt3+1", r"\sqrt{3}+1"), (r"90^\circ", "90"), (r"5\text{ cm}", "5"), (r"50\%", "50"), (".5x", "0.5x"),
    (r"\left(1, 2\right)", "(1,2)"), (r"\frac", None), ("a/b", None), ("03/4", "03/4"), (r"1\text{ a}\text{ b}", None), ("", ""), (r"\frac1", r"\frac1"),
])
def test_math_cleanup(spark, raw, clean):
    assert run(spark, lambda t: gr.normalize_math(t), raw) == clean


@pytest.mark.parametrize("a,b,same", [("1/2", r"\frac{1}{2}", True), ("a/b", "a/b", True), ("a/b", "a / b", False), (None, None, True), (None, "1", False)])
def test_answers_equal(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(gr.answers_equal(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize("raw,plain", [
    (r"\text{Blue}", "blue"), ("7 3/4", "7+3/4"), ("1,234", "1234"), ("12.0", "12"), ("5 miles", "5"), ("{x+1}", "x+1"), ("3 or 4", "3,4"), ("2 million", "2*10^6"), ("- 3", "-3"), ("45^\\circ", "45"),
])
def test_plain_expressions(spark, raw, plain):
    assert run(spark, lambda t: gr.normalize_expr(t), raw) == plain


@pytest.mark.parametrize("response,truths,right", [
    (r"\boxed{\frac12}", ["0.5"], True), (r"\boxed{(1, 2)}", ["(1,2)"], True), (r"\boxed{[1,2]}", ["(1,2)"], False), (r"\boxed{1,000}", ["1000"], True),
    (r"\boxed{2/4}", ["1/2"], False), (r"\boxed{7}", [r"\boxed{8}", r"\boxed{7}"], True), ("7", ["7"], False), (r"\boxed{}", ["1"], False),
])
def test_math_grades(spark, response, truths, right):
    assert run(spark, lambda r, t: gr.grade_math(r, t), response, truths) is right


GOOD = "<think> work </think>\n<answer>\\boxed{1}</answer>"


@pytest.mark.parametrize("text,kind,ok", [
    (GOOD, "math", True), ("   " + GOOD, "math", True), ("    " + GOOD, "math", False), (GOOD.replace("</think>\n", "</think>x"), "math", False),
    (GOOD + " boxed", "math", False), (GOOD.replace("\\boxed{1}", "```python\nprint(1)\n```"), "code", True),
    (GOOD.replace("\\boxed{1}", "```python\nprint(1)\n``` ```"), "code", False), ("x</think> boxed", "tag", True), ("x</think></think> boxed", "tag", False),
    ("a\n\\boxed{1}\n", "line", True), ("\\boxed{1}\na", "line", False), ("\\boxed{1}\na", "anywhere", True), ("\\boxed{1}\n\n\n\n", "anywhere", False),
])
def test_formats(spark, text, kind, ok):
    assert run(spark, lambda t: gr.verify_format(t, kind), text) is ok


@pytest.mark.parametrize("text,phrase,matched", [
    ("Work. The answer is 42", "42", True), ("12 is the answer for you", "12", True), (r"We get \boxed{ 3 }. Done", "3", True), ("so x = 5. More", "5", True), ("no digits here is it", "it", False),
])
def test_final_phrase(spark, text, phrase, matched):
    got = run(spark, lambda t: gr.extract_final_phrase(t), text)
    assert (got.s, got.m) == (phrase, matched)


def test_code_scores(spark):
    df = spark.createDataFrame([([True, True],), ([True, False, True, True],), ([],), ([False] * 10 + [True] * 10,)], "r array<boolean>")
    assert [x[0] for x in df.select(gr.code_score(F.col("r"))).collect()] == [1.0, 0.75, 1.0, 0.0]
    assert run(spark, lambda t: gr.extract_code_block(t), "a ```python\nx\n``` b ```python\ny = 1\n``` c") == "y = 1"


def test_unknown_sources_fail_and_blanks_score_zero(spark):
    df = spark.createDataFrame([("openai/gsm8k", " \n", "1")], "s string, r string, t string")
    scored = sc.score(F.col("s"), F.col("r"), F.col("t"), sc.registry())
    assert df.select(scored).first()[0] == 0.0
    with pytest.raises(Exception, match="no scorer"):
        df.withColumn("r", F.lit("x")).withColumn("s", F.lit("other")).select(scored).collect()


def test_scorer_limits(spark):
    def slow(r, _t):
        if r == "loop":
            while True:
                pass
        return 1 / len(r)
    own = sc.custom_scorer(slow, seconds=0.2, default=-1.0)
    df = spark.createDataFrame([("loop", "t"), ("", "t"), ("ab", "t")], "r string, t string")
    assert [x[0] for x in df.select(own(F.col("r"), F.col("t"))).collect()] == [-1.0, -1.0, 0.5]


def test_given_model_scores_are_kept(spark):
    df = spark.createDataFrame([(GOOD, "2", "math", [1, 1, 0], 0.3)], "r string, t string, a string, m array<int>, s double")
    row = sc.grade_rollouts(df, "r", "t", "a", "m", sc.registry(), model_scores="s").first()
    assert (row.score, row.token_scores, row.format_score) == (0.3, [0.0, 0.3, 0.0], 1.0)


def test_blocks_resume(spark, tmp_path):
    df = spark.range(25).withColumn("text", F.concat(F.lit("doc "), F.col("id").cast("string")))
    out, load = str(tmp_path / "vectors"), sc.hashed_words(8)
    assert sc.embed_blocks(df.filter("id < 10"), "id", "text", load, out, 10, 10) == 1
    assert sc.embed_blocks(df, "id", "text", load, out, 10, 25) == 2
    assert sc.embed_blocks(df, "id", "text", load, out, 10, 25) == 0
    assert spark.read.parquet(out).select("id").distinct().count() == 25


def test_word_pieces(spark):
    vocab = spark.createDataFrame([("un",), ("##aff",), ("##able",), ("##a",)], "piece string")
    df = spark.createDataFrame([(1, "Unaffable xyz un"), (2, None), (3, "  "), (4, "u" * 300 + " un")], "k long, t string")
    got = {r.k: r.pieces for r in wordpiece(df, "k", "t", vocab).collect()}
    assert got == {1: ["un", "##aff", "##able", "[UNK]", "un"], 2: [], 3: [], 4: ["[UNK]", "un"]}


def test_answers_with_composed_and_decomposed_accents(spark):
    df = spark.createDataFrame([("un café noir", ["cafe\u0301"]), ("un cafe\u0301 noir", ["café"]), ("un cafe noir", ["café"])], "t string, a array<string>")
    assert [r[0] for r in df.select(tx.has_answer(F.col("t"), F.col("a"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(tx.has_answer(F.col("t"), F.col("a"), "regex")).collect()] == [True, True, False]


def test_padding_policies(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<bigint>")

    def padded(n, **kw):
        return [list(v) for v in df.select(*ar.pad_or_truncate(F.col("x"), n, **kw)).first()]
    assert padded(5) == [[0, 0, 1, 2, 3], [0, 0, 1, 1, 1]]
    assert padded(5, left_pad=False) == [[1, 2, 3, 0, 0], [1, 1, 1, 0, 0]]
    assert padded(2, policy="left") == [[2, 3], [1, 1]]
    assert padded(2, policy="right") == [[1, 2], [1, 1]]
    with pytest.raises(Exception, match="longer than"):
        padded(2)


def test_truncation_counts_match_a_loop(spark):
    df = spark.createDataFrame([(a, b) for a in range(1, 14) for b in range(0, 14)], "a int, b int")
    for r in df.select("a", "b", *ob.removed_counts(F.col("a"), F.col("b"), 9)).collect():
        a, b = r[0], r[1]
        while a + b > 9:
            if a > b:
                a -= 1
            else:
                b -= 1
        assert (r[0] - a, r[1] - b) == (r[2], r[3])


def test_span_corruption_can_be_undone(spark):
    df = spark.range(20).withColumn("t", F.transform(F.sequence(F.lit(1), F.col("id") + 30), lambda x: x + 100))
    for r in ob.span_corruption(df, "id", "t", 40, 64, 64, 0.15, 1, bos=1, eos=2, first_sentinel=1000).collect():
        spans, cur = {}, None
        for x in [x for x in r.text_dec if x][1:]:
            if x >= 1000:
                cur = spans.setdefault(x, [])
            else:
                cur.append(x)
        assert sum((spans.get(x, [x]) for x in r.text_enc if x), []) == r.t[:40]
        assert 0 < sum(map(len, spans.values())) <= 6
        assert [x for x in r.labels if x >= 0] == [x for x in r.text_dec if x][1:] + [2]


def test_masked_words_stay_whole(spark):
    df = spark.createDataFrame([(i, [1] + list(range(10, 40)) + [2, 0, 0]) for i in range(10)], "id long, t array<bigint>").withColumn(
        "s", F.transform("t", lambda x: (x % 3 == 1).cast("int")))
    for r in ob.span_masked_lm(df, "id", "t", "s", 0.3, 9, 500, 3).collect():
        hit = [i for i, m in enumerate(r.loss_mask) if m]
        assert 0 < len(hit) <= 9 and all(r.t[i] > 2 and r.labels[i] == r.t[i] for i in hit)
        words = {}
        for i, x in enumerate(r.t):
            if x > 2:
                words.setdefault((x - 10) // 3, []).append(i)
        assert all(set(w) <= set(hit) or not set(w) & set(hit) for w in words.values())


def test_empty_answers_are_left_out(spark):
    df = spark.createDataFrame([(1, "the cat sat", "A cat sat!"), (2, "", "x"), (3, "x", "no_passages_used"), (4, "b", "c")], "k int, g string, a string")
    got = {r.k: (r.precision, r.recall, r.f1) for r in me.token_f1(df, "k", "g", "a").collect()}
    assert got == {1: (1.0, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 4: (0.0, 0.0, 0.0)}


def test_ensemble_needs_every_model(spark):
    rows = [("d", 1, 0, [0.6, 0.4]), ("d", 1, 0, [0.2, 0.8]), ("d", 2, 1, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "dataset string, uid long, label int, probs array<double>")
    with pytest.raises(Exception, match="missing from a model"):
        me.ensemble(df, 2).collect()
    assert me.ensemble(df.filter("uid = 1"), 2).first().predicted == 1
