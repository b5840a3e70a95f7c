"""Metrics of predictions from one aggregate of (label, prediction) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, by: list[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Counts and shares of each true label's row; rows without a true or predicted label take no part."""
    n = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(*by, truth, predicted).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by, truth)), 6))


def per_class(df: DataFrame, by: list[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """tp, predicted and true counts with precision, recall and F1 of every label seen on either side; 0 / 0 is 0."""
    n = confusion(df, by, truth, predicted)
    sides = n.select(*by, F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s")).select(*by, "s.*")
    c = sides.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumn("precision", zero(F.try_divide(F.col("tp").cast("double"), F.col("predicted")))).withColumn("recall", zero(F.try_divide(F.col("tp").cast("double"), F.col("support"))))
    return c.withColumn("f1", zero(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))))


def summary(df: DataFrame, by: list[str], truth: str = "y_true", predicted: str = "y_pred", digits: int | None = 6) -> DataFrame:
    """Accuracy and macro and weighted averages, one row per group, rounded unless ``digits`` is None."""
    c = per_class(df, by, truth, predicted)
    r = lambda x, a: (x if digits is None else F.round(x, digits)).alias(a)
    macro = [r(F.avg(m), f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [r(F.sum(F.col(m) * F.col("support")) / F.sum("support"), f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return c.groupBy(*by).agg(r(F.sum("tp") / F.sum("support"), "accuracy"), *macro, *weighted, F.sum("support").alias("n"))


def report(df: DataFrame, by: list[str], truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Rows of a classification report: each class, accuracy, macro and weighted averages, two decimals."""
    c = per_class(df, by, truth, predicted)
    two = lambda x, a: F.round(x, 2).alias(a)
    rows = c.select(*by, F.col("label").cast("string").alias("row"), two(F.col("precision"), "precision"), two(F.col("recall"), "recall"), two(F.col("f1"), "f1"), "support")
    s = summary(df, by, truth, predicted)
    null = F.lit(None).cast("double")
    total = s.select(*by, F.lit("accuracy").alias("row"), null.alias("precision"), null.alias("recall"), two(F.col("accuracy"), "f1"), F.col("n").alias("support"))
    for kind in ("macro", "weighted"):
        total = total.unionByName(s.select(*by, F.lit(f"{kind} avg").alias("row"), *(two(F.col(f"{kind}_{m}"), m) for m in ("precision", "recall", "f1")), F.col("n").alias("support")))
    return rows.unionByName(total)


def best(df: DataFrame, score: str = "weighted_f1", name: str = "model") -> DataFrame:
    """The group with the highest score; the first name wins a tie."""
    return df.orderBy(F.desc(score), name).limit(1)


def top_labels(probabilities: Column, names: Column, most: int = 3) -> Column:
    """The most probable labels, ties in label order."""
    pairs = F.zip_with(names, probabilities, lambda n, p: F.struct((-p).alias("k"), n.alias("label"), p.alias("prob")))
    return F.transform(F.slice(F.array_sort(pairs), 1, most), lambda x: F.struct(x["label"].alias("label"), x["prob"].alias("prob")))


def comparison_text(rows: DataFrame, metrics: list[str], name: str = "model") -> DataFrame:
    """Each model's metrics with four decimals, as the lines of a comparison file; a missing metric is 0."""
    return rows.select(F.concat_ws(",", F.col(name), *(F.format_string("%.4f", F.coalesce(F.col(m), F.lit(0.0))) for m in metrics)).alias("value"))


def report_text(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lines of a printed classification report: (by, value), the row's name, precision, recall, F1 and support."""
    number = lambda c: F.when(F.col(c).isNull(), F.lit(" " * 9)).otherwise(F.format_string("%9.2f", F.col(c)))
    return rows.select(*by, F.concat(F.lpad("row", 24, " "), number("precision"), number("recall"), number("f1"), F.format_string("%9d", F.col("support"))).alias("value"))


def save_report(lines: DataFrame, path: str) -> None:
    """Write report or comparison lines as text, one file a partition."""
    lines.select("value").write.mode("overwrite").text(path)
