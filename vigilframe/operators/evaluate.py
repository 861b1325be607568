"""Model evaluation: confusion metrics, ROC, splits, scaling, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.running import running_sums


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: counts, accuracy, precision, recall, F1 and false-positive rate."""
    c = F.count_if
    row = df.agg(
        c(truth & predicted).alias("tp"), c(~truth & predicted).alias("fp"),
        c(truth & ~predicted).alias("fn"), c(~truth & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    row = row.withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn)).withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return row.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("fpr", ratio(fp, fp + tn))


def roc_points(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """(score, tp, fp, pos, neg) cumulated from the highest score down.

    Scores are aggregated first; the running sums go over ranges of equally
    many scores, so no single task sorts all distinct scores.
    """
    per = df.select(score.cast("double").alias("score"), truth.alias("t")).groupBy("score").agg(
        F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg")
    )
    return running_sums(per, [], [F.desc("score")], None, {"tp": F.col("pos"), "fp": F.col("neg")})


def roc_threshold(points: DataFrame, fpr_limit: float) -> DataFrame:
    """One row: threshold with the best TPR within the limit (else Youden's J), its rates, and the AUC."""
    p, n = points.agg(F.sum("pos"), F.sum("neg")).first()
    p, n = int(p or 0), int(n or 0)
    tpr, fpr = F.col("tp") / F.lit(max(p, 1)), F.col("fp") / F.lit(max(n, 1))
    # rank-sum form: ties count one half
    # products of counts leave the range of bigint, so they are taken in double
    tp, pos, neg = (F.col(c).cast("double") for c in ("tp", "pos", "neg"))
    area = F.sum(neg * (tp - pos) + F.lit(0.5) * neg * pos) / F.lit(max(float(p) * float(n), 1.0))
    rated = points.withColumn("tpr", tpr).withColumn("fpr", fpr)
    within = F.col("fpr") <= fpr_limit
    pick = F.max(F.when(within, F.struct(F.col("tpr"), (-F.col("fpr")).alias("nf"), F.col("score"))))
    youden = F.max(F.struct((F.col("tpr") - F.col("fpr")).alias("j"), F.col("score"), F.col("tpr"), F.col("fpr")))
    out = rated.agg(pick.alias("p"), youden.alias("y"), area.alias("auc"))
    use = F.col("p").isNotNull()
    return out.select(
        F.when(use, F.col("p.score")).otherwise(F.col("y.score")).alias("threshold"),
        F.when(use, F.col("p.tpr")).otherwise(F.col("y.tpr")).alias("tpr"),
        F.when(use, -F.col("p.nf")).otherwise(F.col("y.fpr")).alias("fpr"),
        F.when(F.lit(p * n == 0), F.lit(0.5)).otherwise(F.col("auc")).alias("auc"),
    )


def separation(df: DataFrame, score: Column, truth: Column, min_ratio: float) -> DataFrame:
    """Mean attack score over mean benign score, against a bar."""
    attack, benign = F.avg(F.when(truth, score)), F.avg(F.when(~truth, score))
    row = df.agg(attack.alias("attack_mean"), benign.alias("benign_mean"))
    ratio = F.when(F.col("benign_mean") > 0, F.col("attack_mean") / F.col("benign_mean"))
    return row.withColumn("ratio", ratio).withColumn("passed", F.coalesce(F.col("ratio") >= min_ratio, F.lit(False)))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, weight): attacks weigh n_benign / n_attack, benign rows 1."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum(F.when(F.col(label) == 0, F.col("n"))).alias("b"), F.sum(F.when(F.col(label) == 1, F.col("n"))).alias("a")).first()
    weight = float(totals["b"] or 0) / max(float(totals["a"] or 0), 1.0)
    return counts.select(label, "n", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0)).alias("weight"))


def hash_position(*columns) -> Column:
    """A uniform, repeatable position in [0, 1) for ordering rows."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def stratified_split(
    df: DataFrame, label: str, position: Column, tie: str, train: float = 0.70, val: float = 0.15
) -> DataFrame:
    """Add ``split`` per class, with the minimum sizes for small classes.

    Rows are ranked by a position; ranges of equally many rows keep a class
    with most of the rows distributed.
    """
    placed = df.withColumn("_p", position)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_sums(
        placed, [label], [F.col("_p"), F.col(tie)], None, {"_rank": F.lit(1).cast("bigint")}
    ).join(sizes, label)
    n = F.col("_n")
    n_train = F.greatest(F.lit(1), F.bround(n * F.lit(train), 0).cast("bigint"))
    n_val = F.when(n > 2, F.greatest(F.lit(1), F.bround(n * F.lit(val), 0).cast("bigint"))).otherwise(F.lit(0))
    tight = (n_train + n_val >= n) & (n >= 3)
    t = F.when(tight, F.greatest(F.lit(1), n - 2)).otherwise(n_train)
    v = F.when(tight, F.lit(1)).otherwise(n_val)
    split = F.when(F.col("_rank") <= t, "train").when(F.col("_rank") <= t + v, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_p", "_rank", "_n")


def subsample(df: DataFrame, position: Column, n: int) -> DataFrame:
    """A repeatable uniform sample of n rows; rows at the same position go by their values (maps and variants do not order)."""
    ties = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return df.withColumn("_p", position).orderBy("_p", *ties).limit(n).drop("_p")


def scaler(df: DataFrame, values: list[str]) -> DataFrame:
    """(feature, mean, scale) with the population deviation; a constant scales by one."""
    row = df.agg(
        *[F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("scale")).alias(v) for v in values]
    )
    long = row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("feature"), F.col(f"`{v}`.mean").alias("mean"), F.col(f"`{v}`.scale").alias("scale")) for v in values])).alias("r")).select("r.*")
    return long.withColumn("scale", F.when(F.col("scale") == 0, F.lit(1.0)).otherwise(F.col("scale")))


def entropy_by_source(df: DataFrame, source: str, item: str, target: str) -> DataFrame:
    """(source, entropy, destinations): bits over the item counts, distinct targets.

    Two-level aggregation: pairs are counted first, so a busy source is spread.
    """
    pairs = df.groupBy(source, item).agg(F.count(F.lit(1)).alias("_c"))
    entropy = pairs.groupBy(source).agg(
        F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_clog")
    ).select(source, (F.log2("_n") - F.col("_clog") / F.col("_n")).alias("entropy"))
    seen = df.select(source, target).distinct().groupBy(source).agg(F.count(target).alias("destinations"))
    return entropy.join(seen, source)
