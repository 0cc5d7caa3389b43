"""The evaluation bench: correctness, quality metrics by group, curves, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.parse import same_value
from loomwell.operators.model import ILLEGIBLE, KNOWN, NOT_APPLICABLE, NOT_GIVEN, TO_REVIEW, UNKNOWN

#: Statuses that a person looks at anyway.
ATTENDED = [TO_REVIEW, ILLEGIBLE, "PAGE_NON_LUE"]


def compare_truth(truth: DataFrame, fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Truth rows with the status that the extraction gave them.

    ``truth``: image, page_type, key, ...; ``fields``: image, key, status, ...; ``pages``: image, page_type,
    free. A page that was taken for another is PAGE_NON_LUE, a field that free mode lacks
    NON_LU_MODE_LIBRE.
    """
    p = pages.select("image", F.col("page_type").alias("_page"), F.col("free").alias("_free"))
    f = fields.withColumnRenamed("status", "_status").withColumn("_met", F.lit(True)).drop("page_type")
    joined = truth.join(p, "image", "left").join(f, ["image", "key"], "left")
    wrong_page = ~F.coalesce(F.col("_page") == F.col("page_type"), F.lit(False))
    status = F.when(wrong_page, "PAGE_NON_LUE").when(F.col("_met").isNull() & F.col("_free"), "NON_LU_MODE_LIBRE").otherwise(F.coalesce("_status", F.lit("PAGE_NON_LUE")))
    return joined.withColumn("status", status).drop("_status", "_page", "_free", "_met")


def field_correct(truth_status: Column, status: Column, truth: Column, got: Column) -> Column:
    """Whether a field was read correctly, by the status of its truth."""
    same = same_value(truth, got)
    return (
        F.when(truth_status == ILLEGIBLE, status.isin(ILLEGIBLE, TO_REVIEW))
        .when(truth_status.isin(NOT_GIVEN, NOT_APPLICABLE), status.isin(NOT_GIVEN, NOT_APPLICABLE))
        .when(truth_status == UNKNOWN, status == UNKNOWN)
        .otherwise(status.isin(KNOWN, TO_REVIEW) & F.coalesce(same, F.lit(False)))
    )


def _share(part: Column, whole: Column, scale: int = 4) -> Column:
    """part / whole of two counts, rounded half up; null if there is nothing to divide by."""
    ratio = part.cast("decimal(18,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)")
    return F.round(ratio, scale).cast("double")


def quality_metrics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """n, accuracy, unattended, silent_error, review_rate, useful_review over all and by each group.

    ``rows``: groups, status, ok. One pass for all groupings (grouping sets).
    """
    review = F.col("status").isin(TO_REVIEW, ILLEGIBLE)
    auto = ~F.col("status").isin(ATTENDED)

    def count(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    n, n_auto, n_review = F.count(F.lit(1)), count(auto), count(review)
    sets = [[], *[[F.col(g)] for g in groups]]
    metrics = rows.groupingSets(sets, *groups).agg(
        F.grouping_id().cast("long").alias("level"),
        n.alias("n"),
        _share(count(F.col("ok")), n).alias("accuracy"),
        _share(n_auto, n).alias("unattended"),
        _share(count(auto & ~F.col("ok")), n_auto).alias("silent_error"),
        _share(n_review, n).alias("review_rate"),
        _share(count(review & ~F.col("ok")), n_review).alias("useful_review"),
    )
    return metrics.select(*groups, "level", "n", "accuracy", "unattended", "silent_error", "review_rate", "useful_review")


def threshold_curve(rows: DataFrame, points: int = 11, low: float = 0.5, high: float = 0.99) -> DataFrame:
    """(point, threshold, coverage, silent_error): filled fields at or above each threshold.

    Each row goes to the highest threshold that it reaches; sums from above over the few points
    replace a join of all rows with all points.
    """
    step = (high - low) / (points - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))
    reached = F.size(F.filter(cut, lambda t: F.col("conf") >= t)) - 1
    per = rows.withColumn("point", F.when(F.col("filled"), reached).otherwise(-1)).groupBy("point").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("ok"), 1)).alias("wrong")
    )
    axis = rows.sparkSession.range(-1, points).select(F.col("id").cast("int").alias("point"))
    above = Window.orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)  # a dozen rows
    summed = axis.join(per, "point", "left").select(
        "point", F.sum(F.coalesce("n", F.lit(0))).over(above).alias("n"), F.sum(F.coalesce("wrong", F.lit(0))).over(above).alias("wrong"), 
        F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    threshold = F.round((F.lit(low) + F.col("point") * F.lit(step)).cast("decimal(18,9)"), 3).cast("double")
    return summed.where("point >= 0").select("point", threshold.alias("threshold"), _share(F.col("n"), F.col("total")).alias("coverage"), _share(F.col("wrong"), F.col("n")).alias("silent_error"))


def worst_silent_errors(rows: DataFrame, order: str, n: int = 30) -> DataFrame:
    """The first known fields that are wrong, in order of input."""
    return rows.where((F.col("status") == KNOWN) & ~F.col("ok")).orderBy(order).limit(n)


def threshold_search(rows: DataFrame, low: float = 0.8, high: float = 4.0, points: int = 65) -> DataFrame:
    """(threshold, cost): of evenly spaced thresholds the first with the least 2 * false accepts + false rejects.

    ``rows``: estimate, bad. Estimates are counted per interval first, so the 65 points only meet
    a small table.
    """
    step = (high - low) / (points - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))
    # how many thresholds lie below the estimate: those reject the row
    below = F.size(F.filter(cut, lambda t: F.col("estimate") > t))
    per = rows.groupBy(below.alias("below")).agg(F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(~F.col("bad"), 1)).alias("good"))
    axis = rows.sparkSession.range(points + 1).select(F.col("id").cast("int").alias("below"))
    known = axis.join(per, "below", "left").select("below", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("good", F.lit(0)).alias("good"))
    so_far = Window.orderBy("below").rowsBetween(Window.unboundedPreceding, 0)  # 66 rows
    later = Window.orderBy("below").rowsBetween(1, Window.unboundedFollowing)
    cost = 2 * F.sum("bad").over(so_far) + F.coalesce(F.sum("good").over(later), F.lit(0))
    costs = known.select(F.col("below").alias("point"), cost.alias("cost")).where(F.col("point") < points)
    best = costs.agg(F.min(F.struct("cost", "point")).alias("best"))
    threshold = F.round((F.lit(low) + F.col("best.point") * F.lit(step)).cast("decimal(18,9)"), 4).cast("double")
    return best.select(threshold.alias("threshold"), F.col("best.cost").alias("cost"))


def report_lines(metrics: DataFrame) -> list[str]:
    """A Markdown table of metrics; the groups are few."""
    columns = metrics.columns
    rows = metrics.orderBy("level").collect()
    return ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]]


def infer_types(samples: DataFrame, key: str, value: str, share: float = 0.8) -> DataFrame:
    """(key, type): the first of date, bp, int, quantity whose pattern matches that share of values, else text."""
    shapes = {
        "date": r"^\s*[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-][0-9]{2,4}\s*$",
        "bp": r"^\s*[0-9]{2,3}\s*/\s*[0-9]{2,3}\s*$",
        "int": r"^\s*[0-9]+\s*$",
        "quantity": r"^\s*[0-9]+(?:[.,][0-9]+)?\s*[A-Za-z°/%]+\s*$",
    }
    n = F.count(F.col(value))
    found = None
    for kind, shape in shapes.items():
        enough = F.count(F.when(F.col(value).rlike(shape), 1)) * 100 >= n * int(round(share * 100))
        found = F.when(enough, kind) if found is None else found.when(enough, kind)
    return samples.groupBy(key).agg(F.when(n > 0, found.otherwise("text")).otherwise("text").alias("type"))


def degenerate_columns(cells: DataFrame, by: list[str]) -> DataFrame:
    """Table columns that carry no reading: six rows or more, three fifths filled, two values at most."""
    stats = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("filled"), F.count_distinct("value").alias("distinct"))
    return stats.where("rows >= 6 AND filled * 10 >= rows * 6 AND distinct <= 2")


def anchor_labels(labels: DataFrame, n_patients: int) -> DataFrame:
    """Labels that stand once on a page and for every patient."""
    per = labels.groupBy("page_type", "text").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient").alias("patients"))
    return per.where((F.col("n") == F.col("patients")) & (F.col("patients") == n_patients)).select("page_type", "text")
