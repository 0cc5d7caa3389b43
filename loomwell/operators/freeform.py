"""Pages of unknown layout: labels to keys, cells to keys, and a status that is never certain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwell.functions.parse import marker
from loomwell.functions.text import has_personal_data, label_match
from loomwell.operators.model import NOT_GIVEN, TO_REVIEW, UNKNOWN


def match_labels(pairs: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Add ``key``: the label itself if it is a key, else the key of the most similar label (80 or more)."""
    by_label = {**{key.replace("_", " "): key for key in labels}, **{label: key for key, label in labels.items()}, **{key: key for key in labels}}
    known = F.create_map(*[F.lit(x) for pair in by_label.items() for x in pair])
    best = label_match(list(by_label))(F.col("label"))
    return pairs.withColumn("key", F.coalesce(F.when(F.col("label").isin(list(labels)), F.col("label")), F.try_element_at(known, best)))


def to_fields(values: DataFrame) -> DataFrame:
    """Status and confidence of free-mode values: marks are taken at their word, all else is for review;
    values that hold personal data are dropped."""
    mark = marker(F.col("text"))
    status = F.when(mark == "inconnu", UNKNOWN).when(mark == "vide", NOT_GIVEN).otherwise(TO_REVIEW)
    kept = values.where(~F.coalesce(has_personal_data("text"), F.lit(False)))
    return kept.withColumn("status", status).withColumn("confidence", F.when(F.col("sure"), 0.6).otherwise(0.4))


def cells_to_keys(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Table cells by row and column label; the template's keys are few and broadcast."""
    return cells.join(F.broadcast(keys), ["row_label", "col_label"], "left")


def reading_order(y: Column, x: Column) -> list[Column]:
    return [F.round(y / 6), x]


def dedupe_keys(boxes: DataFrame, page: str = "page_type", lines: bool = False) -> DataFrame:
    """Give later fields of one key on a page the suffix _2, _3, ... in the order y, x, id; with ``lines`` in
    reading order, in which heights that round to one line are equal."""
    order = Window.partitionBy(page, "key").orderBy(*(reading_order(F.col("y"), F.col("x")) if lines else ["y", "x"]), "id")
    n = F.row_number().over(order)
    return boxes.withColumn("unique_key", F.when(n == 1, F.col("key")).otherwise(F.concat(F.col("key"), F.lit("_"), n.cast("string"))))


def repair_glyphs(values: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Replace the unreadable sign by what one vocabulary entry alone has there, else by é.

    ``vocabulary`` (entry) is small by nature and broadcast; texts without the sign don't join.
    """
    broken = values.where(F.col("text").contains("�"))
    pattern = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\\", r"\\\\"), r"([%_])", r"\\$1"), "�", "_")
    met = broken.withColumn("_like", pattern).withColumn("_n", F.length("text")).join(
        F.broadcast(vocabulary.withColumn("_n", F.length("entry"))), "_n"
    ).where(F.expr("entry LIKE _like"))
    unique = met.groupBy("text").agg(F.count_distinct("entry").alias("n"), F.min("entry").alias("entry")).where("n = 1").select("text", "entry")
    joined = values.join(unique, "text", "left")
    return joined.withColumn("repaired", F.coalesce("entry", F.regexp_replace("text", "�", "é"))).drop("entry")


def rename_keys(fields: DataFrame, renames: list[tuple[str, str, str]]) -> DataFrame:
    """Rename keys (page or "", old, new), whole or before a ``__`` suffix; page rules after global ones."""
    key = F.col("key")
    for scope in (False, True):
        out = None
        for page, old, new in renames:
            if bool(page) != scope:
                continue
            hit = key.rlike(f"^{old}(__|$)") & (F.lit(True) if not page else F.col("page_type") == page)
            changed = F.regexp_replace(key, f"^{old}(?=__|$)", new)
            out = F.when(hit, changed) if out is None else out.when(hit, changed)
        key = key if out is None else out.otherwise(key)
    return fields.withColumn("key", key)


def twin_pages(anchors: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of page types whose anchor sets have a Jaccard similarity above ``least``, and what differs.

    There is one set per page type, a handful; pairs meet on shared anchors.
    """
    sets = anchors.groupBy("page_type").agg(F.array_sort(F.collect_set("text")).alias("texts"))
    met = anchors.alias("a").join(anchors.alias("b"), F.expr("a.text = b.text AND a.page_type < b.page_type")).select(
        F.col("a.page_type").alias("one"), F.col("b.page_type").alias("two")
    ).distinct()
    both = met.join(sets.select(F.col("page_type").alias("one"), F.col("texts").alias("t1")), "one").join(
        sets.select(F.col("page_type").alias("two"), F.col("texts").alias("t2")), "two"
    )
    jaccard = F.size(F.array_intersect("t1", "t2")) / F.size(F.array_union("t1", "t2"))
    return both.withColumn("jaccard", jaccard).where(F.col("jaccard") > least).select(
        "one", "two", "jaccard", F.array_except("t1", "t2").alias("only_one"), F.array_except("t2", "t1").alias("only_two")
    )
