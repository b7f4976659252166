"""Groups, advantages and token arrays against plain Python."""

import itertools
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from weftline.operators import rollout as ro, tokens as tk


@pytest.fixture(scope="module")
def groups():
    rnd = random.Random(2)
    rows = []
    for uid in range(12):
        for i in range([1, 4, 8][uid % 3] if uid else 60):
            rows.append((uid, i, float(rnd.random() < 0.4), rnd.choice([0.1, 0.2, 0.3, 0.5]), rnd.randrange(1, 20)))
    return rows


@pytest.fixture(scope="module")
def df(spark, groups):
    return spark.createDataFrame(groups, "uid long, i long, score double, model double, n int")


def test_advantage(df, groups):
    got = {(r.uid, r.i): r.advantage for r in ro.grpo_advantage(df, "uid", "score").collect()}
    for uid, i, s, *_ in groups:
        g = [x[2] for x in groups if x[0] == uid]
        m, d = (0.0, 1.0) if len(g) == 1 else (statistics.mean(g), statistics.stdev(g))
        assert got[(uid, i)] == pytest.approx((s - m) / (d + 1e-6), abs=1e-9)


@pytest.mark.parametrize("levels", [2, 3, 50])
def test_pair_accuracy(df, levels):
    by = {2: F.col("score"), 3: (F.col("score") + F.col("i") % 2) / 2, 50: (F.col("i") * 37 % 11 - 5) / 7.0}
    graded = df.withColumn("acc", by[levels])
    got = {r.uid: r.pair_acc for r in ro.pairwise_accuracy(graded, "uid", ["i"], "model", "acc").collect()}
    rows = {}
    for r in graded.collect():
        rows.setdefault(r.uid, []).append((r.i, r.model, r.acc))
    for uid, g in rows.items():
        num = den = 0.0
        for (_, s1, a1), (_, s2, a2) in itertools.combinations(sorted(g), 2):
            den += abs(a1 - a2)
            num += ((s1 - s2 > 0) == (a1 - a2 > 0)) * abs(a1 - a2)
        assert got[uid] == pytest.approx(num / den if den else 0.5)


def test_every_group_has_one_outcome(df, groups):
    got = ro.accept_groups(df, "uid", "score", "n", 0.2, 0.8, 0.1, 19, k=2).collect()
    assert len(got) == 12
    low = [r.uid for r in sorted(got, key=lambda r: r.uid) if r.acc <= 0.1]
    assert [r.uid for r in sorted(got, key=lambda r: r.uid) if r.reroll] == low[:len(low) // 2 * 2]
    for r in got:
        g = [x for x in groups if x[0] == r.uid]
        assert r.accepted == (0.2 <= statistics.mean(x[2] for x in g) <= 0.8 and max(x[4] for x in g) < 19)


def test_nothing_accepted_rerolls_everything(df):
    assert all(r.reroll and not r.accepted for r in ro.accept_groups(df, "uid", "score", "n", 2.0, 3.0, 0.1).collect())


def test_too_few_rerolls_are_left(df):
    assert not any(r.reroll for r in ro.accept_groups(df, "uid", "score", "n", 0.0, 1.0, 0.1, k=100).collect())


def test_no_accuracy_filter_means_no_reroll(df):
    got = ro.accept_groups(df, "uid", "score", "n", filter_accuracy=False).collect()
    assert all(r.accepted and not r.reroll for r in got)


def test_source_levels_merge_by_name(spark):
    scores = {"math/general_reasoning/health_AI": 0.9, "math/general_reasoning/numina_cn_k12": 0.7,
              "math/PRIME-RL/health_AI": 0.8, "math/PRIME-RL/numina_cn_k12": 0.5}
    df = spark.createDataFrame([(k, v, 1.0) for k, v in scores.items()], "s string, r double, f double")
    got = {(x.level, x.name): round(x.score, 6) for x in ro.score_by_source(df, "s", "r", "f").collect()}
    assert got == {("domain", "math"): 0.725, ("source", "general_reasoning"): 0.8, ("source", "PRIME-RL"): 0.65,
                   ("subcategory", "health_AI"): 0.85, ("subcategory", "numina_cn_k12"): 0.6, ("all", "all"): 0.725}


def test_mixin_replaces_wrong_by_wrong(spark):
    new = spark.createDataFrame([(1, i, s, 10 + i) for i, s in enumerate([1.0, 0.0, 0.0, 0.0])], "uid int, i int, score double, n int")
    old = spark.createDataFrame([(1, i, s, 20 + i) for i, s in enumerate([0.0, 1.0, 0.0])], "uid int, i int, score double, n int")
    got = {r.i: (r.n, r.replaced) for r in ro.mixin_correct(new, old, "uid", ["i"], "score", ["score", "n"]).collect()}
    assert got == {0: (10, False), 1: (20, True), 2: (22, True), 3: (13, False)}


@pytest.fixture(scope="module")
def tokens(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(9):
        n = 7
        stop = rnd.randrange(1, n + 1)
        rows.append((i, i % 3, [rnd.uniform(-1, 1) for _ in range(n)], [rnd.uniform(-1, 1) for _ in range(n)], [int(t < stop) for t in range(n)]))
    return rows, spark.createDataFrame(rows, "id long, uid long, r array<double>, v array<double>, m array<int>")


def whiten(values, masks):
    flat = [v for vs, ms in zip(values, masks) for v, m in zip(vs, ms) if m]
    mean, var = statistics.mean(flat), statistics.variance(flat)
    return [[(v - mean) / math.sqrt(var + 1e-8) for v in vs] for vs in values]


def close(a, b):
    return all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True))


def test_gae(tokens):
    rows, df = tokens
    adv = []
    for _, _, r, v, _ in rows:
        out, last = [], 0.0
        for t in reversed(range(7)):
            last = r[t] + 0.9 * (v[t + 1] if t < 6 else 0.0) - v[t] + 0.9 * 0.8 * last
            out.append(last)
        adv.append(out[::-1])
    white = whiten(adv, [x[4] for x in rows])
    for g in tk.gae(df, "r", "v", "m", 0.9, 0.8).collect():
        assert close(g.advantages, white[g.id])
        assert close(g.returns, [a + b for a, b in zip(adv[g.id], rows[g.id][3])])


def test_reset_after_the_end(tokens):
    rows, df = tokens
    for g in tk.reinforce_pp(df, "r", "m", 0.7).collect():
        _, _, r, _, m = rows[g.id]
        run, want = 0.0, [0.0] * 7
        for t in reversed(range(7)):
            run = r[t] + 0.7 * run
            want[t] = run
            run *= m[t]
        assert close(g.returns, want)
        assert all(a == 0 for a, k in zip(g.advantages, m) if not k)


def test_one_masked_token_is_an_error(tokens):
    _, df = tokens
    with pytest.raises(Exception, match="fewer than two"):
        tk.masked_whiten(df.filter("id = 0").withColumn("m", F.transform("m", lambda x, i: (i == 0).cast("int"))), "r", "m", "w").collect()


def test_masks(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, 0], [0, 0, 2, 99, 99, 5])], "m array<int>, ids array<int>")
    row = df.select(tk.eos_mask(F.col("ids"), [99, 7]).alias("e"), tk.position_ids(F.col("m")).alias("p"),
                    tk.remove_pad(F.col("ids"), F.col("m")).alias("k"), tk.expand_to_token(F.lit(2.5), F.col("m")).alias("x")).first()
    assert (row.e, row.p, row.k, row.x) == ([1, 1, 1, 1, 0, 0], [0, 0, 0, 1, 1], [99, 5], [0.0, 2.5, 0.0, 0.0, 0.0])


def test_tasks_of_guidance_follow_the_rows(spark, monkeypatch):
    from weftline import session
    monkeypatch.setattr(session, "ROWS_A_TASK", 64, raising=False)
    # half of the prompts are accepted without guidance, the others with hints
    rows = [(u, v, float(i < (4 if v == "hint" or u % 2 else 0)), i) for u in range(400) for v in ("plain", "hint") for i in range(8)]
    df = spark.createDataFrame(rows, "uid long, variant string, score double, n long")
    got, _ = ro.adaptive_guidance(df, "uid", "variant", "score", "n", {"plain": (0.1, 0.9), "hint": (0.1, 0.9)}, 0.0, 50, k=3)
    held = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
    # 200 re-rolled prompts are cut to 198
    assert sum(r["count"] for r in held) == 200 * 8 + 198 * 8
    # 4 partitions are set: 400 rows each of a variant
    assert len(held) > 40 and max(r["count"] for r in held) < 250
    assert {r.uid for r in got.filter("not on_policy").select("uid").distinct().collect()} == set(range(0, 396, 2))


def test_rerolls_are_cut_by_names_too(spark):
    df = spark.createDataFrame([(f"p{u}", float(u < 2), 1) for u in (0, 10, 2, 33, 4, 5, 6)] + [("p1", 1.0, 1), ("p1", 0.0, 1), (None, 0.0, 1)], "uid string, score double, n long")
    got = {r.uid: r.reroll for r in ro.accept_groups(df, "uid", "score", "n", 0.2, 0.8, 0.1, k=3).collect()}
    # in order: None, p10, p2, p33, p4, p5, p6; the last one is left out
    assert sorted(u for u, reroll in got.items() if reroll) == ["p10", "p2", "p33", "p4", "p5"]


def test_indexed_rows_are_written_once_and_narrow(spark, monkeypatch):
    from weftline import plans
    from weftline.operators import index
    placed, written = index._placed, []
    monkeypatch.setattr(index, "_placed", lambda df, order, *more: written.append(placed(df, order, *more)) or written[-1])
    mixed = plans.QUERIES["mixin_correct"](spark, "/root/testdata/sf0.001")
    assert set(written[0].columns) == {"uid", "score", "resp_len", "variant", "_v_sample_idx", "_at", "_part"}
    # what follows reads the numbered rows, and numbers none itself
    assert len(written) == 3 and all("l_tax" not in w._jdf.queryExecution().optimizedPlan().toString() for w in [mixed, *written])
