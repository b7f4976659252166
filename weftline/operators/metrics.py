"""Evaluation metrics of answers, classifiers and language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx

EPS = 1e-6


def token_f1(df: DataFrame, key: str, guess: str, answer: str) -> DataFrame:
    """(key, precision, recall, f1) over normalised tokens; rows with an empty answer are left out.

    The answer ``no_passages_used`` counts as empty, an empty guess scores 0.
    Tokens are counted per side, so a long text is spread over the shuffle.
    """
    a = F.when(F.col(answer) == "no_passages_used", "").otherwise(F.col(answer))
    rows = df.select(key, F.col(guess).alias("_g"), a.alias("_a")).filter("_a <> ''")

    def tokens(c):
        return F.filter(F.split(tx.normalize_answer(F.col(c)), " "), lambda w: w != "")
    both = rows.select(key, tokens("_g").alias("_gt"), tokens("_a").alias("_at"))
    sides = F.concat(F.transform("_gt", lambda w: F.struct(w.alias("w"), F.lit(1).alias("g"), F.lit(0).alias("a"))),
                     F.transform("_at", lambda w: F.struct(w.alias("w"), F.lit(0).alias("g"), F.lit(1).alias("a"))))
    counts = both.select(key, F.inline(sides)).groupBy(key, "w").agg(F.sum("g").alias("g"), F.sum("a").alias("a"))
    sums = counts.groupBy(key).agg(F.sum(F.least("g", "a")).alias("same"), F.sum("g").alias("ng"), F.sum("a").alias("na"))
    out = rows.select(key).join(sums, key, "left")
    same, p, r = F.coalesce("same", F.lit(0)), F.col("same") / F.col("ng"), F.col("same") / F.col("na")
    hit = same > 0
    return out.select(key, F.when(hit, p).otherwise(0.0).alias("precision"), F.when(hit, r).otherwise(0.0).alias("recall"),
                      F.when(hit, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def exact_match(df: DataFrame, prediction: str, answers: str) -> DataFrame:
    """``exact``: the prediction equals one of the answers after normalisation."""
    p = tx.normalize_exact(F.col(prediction))
    return df.withColumn("_p", p).withColumn("exact", F.array_contains(F.transform(answers, tx.normalize_exact), F.col("_p"))).drop("_p")


def ensemble(preds: DataFrame, n_models: int, thresholds: dict[str, float] | None = None) -> DataFrame:
    """(dataset, uid, label, predicted) from the mean probabilities of all models.

    Every uid must come from every model. With a threshold the last class
    decides between 1 and 0, else the largest mean wins, lowest class first.
    """
    cells = preds.select("dataset", "uid", "label", F.posexplode("probs").alias("cls", "p"))
    means = cells.groupBy("dataset", "uid", "label", "cls").agg(F.sum("p").alias("_s"), F.count("*").alias("_m"))
    aligned = F.when(F.col("_m") != n_models, F.raise_error(F.lit("a uid is missing from a model"))).otherwise(F.col("_s") / n_models)
    means = means.withColumn("p", aligned)
    best = F.max_by("cls", F.struct("p", -F.col("cls")))
    out = means.groupBy("dataset", "uid", "label").agg(best.alias("_arg"), F.max_by("p", "cls").alias("_last"))
    if thresholds is None:
        return out.select("dataset", "uid", "label", F.col("_arg").alias("predicted"))
    t = F.element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("dataset"))
    return out.select("dataset", "uid", "label", (F.col("_last") >= t).cast("int").alias("predicted"))


def accuracy(df: DataFrame, dataset: str, predicted: str, label: str) -> DataFrame:
    """Correct, total and percentage per dataset and over all of them (``all``)."""
    right = F.count_if(F.col(predicted) == F.col(label)).alias("correct")
    per = df.groupBy(F.col(dataset).cast("string").alias("dataset")).agg(right, F.count("*").alias("total"))
    pooled = per.agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).select(F.lit("all").alias("dataset"), "correct", "total")
    return per.unionByName(pooled).withColumn("percent", F.col("correct") * 100.0 / F.col("total"))


def best_threshold(df: DataFrame, prob: str, label: str) -> DataFrame:
    """(threshold, accuracy): the first of 0.00 .. 0.99 with the best accuracy of ``prob >= threshold``.

    Rows are reduced to how many thresholds they reach; the rest is a hundred
    running counts.
    """
    grid = F.array(*[F.lit(i * (1.0 / 100.0)) for i in range(100)])
    reach = F.size(F.filter(grid, lambda t: t <= F.col(prob)))
    counts = df.groupBy(reach.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    spark = df.sparkSession
    steps = spark.range(101).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").fillna(0)
    # 101 rows
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    sums = steps.select("k", F.sum("neg").over(upto).alias("_tn"), F.sum("pos").over(upto).alias("_fn"),
                        F.sum("pos").over(Window.partitionBy()).alias("_p"), F.sum("neg").over(Window.partitionBy()).alias("_n"))
    # threshold i is passed by rows that reach more than i of them
    at = sums.filter("k < 100").select((F.col("k") * (1.0 / 100.0)).alias("threshold"),
                                       ((F.col("_tn") + F.col("_p") - F.col("_fn")) / (F.col("_p") + F.col("_n"))).alias("accuracy"))
    return at.agg(F.max_by("threshold", F.struct("accuracy", -F.col("threshold"))).alias("threshold"), F.max("accuracy").alias("accuracy"))


def classification_report(df: DataFrame, label: str, predicted: str, ignore: int | None = None) -> DataFrame:
    """Per-class counts and scores, and their support-weighted means (class ``weighted``).

    The four counts leave out rows whose label is ignored; the scores use all
    rows. Everything is a sum over one confusion table.
    """
    cells = df.groupBy(F.col(label).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("_hit"),
                      F.sum(F.when(F.col("t") == ignore, F.col("n")).otherwise(0) if ignore is not None else F.lit(0)).alias("_ign"))
    seen = F.col("t") != ignore if ignore is not None else F.lit(True)
    truth = cells.groupBy(F.col("t").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    given = cells.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("given"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("given_seen"))
    rows = truth.join(given, "cls", "full").fillna(0)
    if ignore is not None:
        rows = rows.filter(F.col("cls") != ignore)
    rows = rows.withColumn("_t", total.select(F.struct("*")).scalar()).select("*", "_t._all", "_t._hit", "_t._ign").drop("_t")
    tp, fp_all, fn = F.col("tp"), F.col("given") - F.col("tp"), F.col("support") - F.col("tp")
    tn_all = F.col("_all") - tp - fp_all - fn
    prec, rec = tp / (tp + fp_all + EPS), tp / (tp + fn + EPS)
    po = (tp + tn_all) / F.col("_all")
    pe = ((tp + fp_all) * (tp + fn) + (fn + tn_all) * (fp_all + tn_all)) / (F.col("_all").cast("double") * F.col("_all"))
    out = rows.select(
        F.col("cls").cast("string").alias("cls"), F.col("support"), (F.col("support") / F.col("_all")).alias("_w"),
        tp.cast("double").alias("tp"), (F.col("given_seen") - tp).cast("double").alias("fp"),
        (F.col("_all") - F.col("_ign") - F.col("support") - (F.col("given_seen") - tp)).cast("double").alias("tn"), fn.cast("double").alias("fn"),
        prec.alias("precision"), rec.alias("recall"), (2 * prec * rec / (prec + rec + EPS)).alias("f1"),
        ((po - pe) / (1 - pe + EPS)).alias("kappa"), (tp / (F.col("given") + F.col("support") - tp + EPS)).alias("jaccard"),
        (F.col("_hit") / F.col("_all")).alias("accuracy"))
    names = ["tp", "fp", "tn", "fn", "precision", "recall", "f1", "kappa", "jaccard"]
    mean = out.agg(F.sum("support").alias("support"), *[F.sum(F.col(c) * F.col("_w")).alias(c) for c in names], F.first("accuracy").alias("accuracy"))
    return out.drop("_w").unionByName(mean.withColumn("cls", F.lit("weighted")))


def perplexity(df: DataFrame, loss_sum: str, tokenized: str, original: str) -> DataFrame:
    """Average loss, perplexity and word-adjusted perplexity of a token stream; exponents end at 20."""
    sums = df.agg(F.sum(loss_sum).alias("l"), F.sum(tokenized).alias("t"), F.sum(original).alias("o"))
    loss, ratio = F.col("l") / (F.col("t") - 1), (F.col("t") - 1) / (F.col("o") - 1)
    return sums.select(loss.alias("loss"), F.exp(F.least(F.lit(20.0), loss)).alias("ppl"),
                       F.exp(F.least(F.lit(20.0), loss * ratio)).alias("adjusted_ppl"), ratio.alias("token_ratio"))


def event_stats(df: DataFrame, event: str, value: str) -> DataFrame:
    """Mean, population deviation, count, extremes and total per event, rounded to two digits."""
    two = lambda c, n: F.round(c, 2).alias(n)
    return df.groupBy(event).agg(two(F.avg(value), "mean"), two(F.stddev_pop(value), "std"), F.count(value).alias("count"),
                                 two(F.min(value), "min"), two(F.max(value), "max"), two(F.sum(value), "total"))
