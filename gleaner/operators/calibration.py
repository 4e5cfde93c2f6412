"""The threshold that separates labelled samples best, by one sort over ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import Tables


def best_threshold(samples: DataFrame) -> DataFrame:
    """One row for samples (score, label): the threshold with the best (balanced accuracy, precision, recall).

    Candidates are 0, the midpoints of consecutive distinct scores (clamped to [0, 1]) and 1; a score at or above is
    positive; the lowest of full ties stays.  No positive or no negative sample is an error; samples without score or label
    are passed over.  Counts are added up by distinct score, and those are dealt by ranges: sums of ranges first, then in each range.
    """
    clamped = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    by_value = samples.where("score is not null and label is not null").groupBy(clamped.alias("v")).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"), F.count_if((F.col("score") < 0) & F.col("label")).alias("below_pos"), F.count_if((F.col("score") < 0) & ~F.col("label")).alias("below_neg"))
    tables = Tables(samples.sparkSession, "calibration")
    ranges = tables.save(by_value.repartitionByRange("v").sortWithinPartitions("v").withColumn("_part", F.spark_partition_id()), "ranges")
    higher, lower = W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1), W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    # one row for each range
    base = ranges.groupBy("_part").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "below_pos", "below_neg")], F.max("v").alias("top")).select(
        "_part", F.coalesce(F.sum("pos").over(higher), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("neg").over(higher), F.lit(0)).alias("neg_above"), F.max("top").over(lower).alias("top_below"),
        F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"), F.sum("below_pos").over(whole).alias("bp"), F.sum("below_neg").over(whole).alias("bn"))
    down, up = W.partitionBy("_part").orderBy(F.desc("v")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("_part").orderBy("v")
    steps = ranges.withColumns({
        "own_prev": F.lag("v").over(up), "own_pos": F.coalesce(F.sum("pos").over(down), F.lit(0)), "own_neg": F.coalesce(F.sum("neg").over(down), F.lit(0))}).join(F.broadcast(base), "_part").select(
        "v", "pos", "neg", "p", "n", "bp", "bn", F.coalesce("own_prev", "top_below").alias("prev"), (F.col("own_pos") + F.col("pos_above")).alias("pos_over"), (F.col("own_neg") + F.col("neg_above")).alias("neg_over"))
    middle = steps.where("prev is not null").select(((F.col("prev") + F.col("v")) / 2).alias("t"), (F.col("pos_over") + F.col("pos")).alias("tp"), (F.col("neg_over") + F.col("neg")).alias("fp"), "p", "n")
    ends = steps.groupBy("p", "n", "bp", "bn").agg(F.coalesce(F.sum(F.when(F.col("v") == 1, F.col("pos"))), F.lit(0)).alias("one_pos"), F.coalesce(F.sum(F.when(F.col("v") == 1, F.col("neg"))), F.lit(0)).alias("one_neg"))
    zero = ends.select(F.lit(0.0).alias("t"), (F.col("p") - F.col("bp")).alias("tp"), (F.col("n") - F.col("bn")).alias("fp"), "p", "n")
    one = ends.select(F.lit(1.0).alias("t"), F.col("one_pos").alias("tp"), F.col("one_neg").alias("fp"), "p", "n")
    div = lambda a, b: a / F.greatest(F.lit(1), b)
    scored = zero.union(middle).union(one).withColumns({"recall": div(F.col("tp"), F.col("p")), "precision": div(F.col("tp"), F.col("tp") + F.col("fp"))})
    scored = scored.withColumn("balanced", (F.col("recall") + div(F.col("n") - F.col("fp"), F.col("n"))) / 2)
    best = scored.agg(F.max(F.struct("balanced", "precision", "recall", (-F.col("t")).alias("low"), "tp", "fp", "p", "n")).alias("b"))
    both = F.coalesce((F.col("b.p") > 0) & (F.col("b.n") > 0), F.lit(False))
    checked = F.when(both, -F.col("b.low")).otherwise(F.raise_error(F.lit("positive and negative samples are needed")).cast("double"))
    six = lambda c: F.round(F.col(f"b.{c}"), 6)
    return best.select(
        F.round(checked, 6).alias("threshold"), six("balanced").alias("balanced_accuracy"), six("precision").alias("precision"), six("recall").alias("recall"),
        F.col("b.tp").alias("true_positive"), (F.col("b.n") - F.col("b.fp")).alias("true_negative"), F.col("b.fp").alias("false_positive"), (F.col("b.p") - F.col("b.tp")).alias("false_negative"), (F.col("b.p") + F.col("b.n")).alias("samples"))
