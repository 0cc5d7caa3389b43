"""Merging repeated captures, and the difference of a record and a new scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.operators.model import KNOWN, TO_REVIEW
from loomwell.operators.scan import BUCKETS, HOT, MOST_KEYS, Running, running
from loomwell.sources.scratch import written

#: Values that a new scan doesn't add to a record.
BLANK = ["", "false", "0", "0.0"]


def fold_readings(readings: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The best reading per key over all photos, in photo order.

    ``readings``: keys, seq, free (free mode), status, confidence, value. A template reading beats
    a free one; else the higher confidence wins and the older one a tie. If both were known
    with different values, the winner goes to review, which later photos then see: so the
    fold is in order of ``seq``. A key's photos are folded in one array; :func:`fold_all` takes others for very many.
    """
    cells = F.array_sort(F.collect_list(F.struct("seq", "free", "status", "confidence", F.col(value).alias("value"))))
    first = F.element_at("_cells", 1)

    def step(best: Column, new: Column) -> Column:
        wins = F.when(best["free"] != new["free"], best["free"]).otherwise(new["confidence"] > best["confidence"])
        clash = (best["status"] == KNOWN) & (new["status"] == KNOWN) & ~best["value"].eqNullSafe(new["value"])
        won = F.when(wins, new).otherwise(F.struct(*[best[f].alias(f) for f in ("seq", "free", "status", "confidence", "value")]))
        return F.struct(
            won["seq"].alias("seq"), won["free"].alias("free"), F.when(clash, F.lit(TO_REVIEW)).otherwise(won["status"]).alias("status"),
            won["confidence"].alias("confidence"), won["value"].alias("value"), (best["conflict"] | clash).alias("conflict"),
        )

    start = F.struct(*[first[f].alias(f) for f in ("seq", "free", "status", "confidence", "value")], F.lit(False).alias("conflict"))
    folded = F.aggregate(F.slice("_cells", 2, F.size("_cells")), start, step)
    grouped = readings.groupBy(*keys).agg(cells.alias("_cells")).withColumn("_best", folded)
    return grouped.select(*keys, "_best.seq", "_best.status", "_best.confidence", F.col("_best.value").alias(value), "_best.conflict")


def fold_scanned(readings: DataFrame, keys: list[str], value: str = "value", hot: int = HOT, buckets: int = BUCKETS) -> DataFrame:
    """What :func:`fold_readings` gives, by scans instead of an array per key, for keys of any number of readings.

    The best reading so far changes hands only at a *holder*: a reading that beats all before it, by template before
    free mode, then confidence. Readings between two holders can do one thing, contradict the holder. So a
    holder's fate is whether it is still known on arrival (``fresh``) and whether one of its span contradicts it. ``fresh`` depends
    on the holder before as NOT does, or not at all: it is the last settled one, turned as often as NOTs follow it.
    """
    rows = readings.select(*keys, "seq", "free", "status", "confidence", F.col(value).alias("_value"))
    # among equals the older one stays, so a later equal never beats the holder
    rows = written(rows.withColumn("_rank", F.struct((~F.col("free")).alias("t"), F.col("confidence").alias("c"))), "readings")
    ranked = running(rows, keys, ["seq"], [Running("_above", "_rank", "max", exclusive=True)], hot, buckets)
    holds = F.col("_above").isNull() | (F.col("_rank") > F.col("_above"))
    me = F.when(holds, F.struct("seq", F.col("_value").alias("value")))
    held = running(ranked.withColumn("_holds", holds).withColumn("_me", me), keys, ["seq"], [Running("_holder", "_me", "last", skip_nulls=True)], hot, buckets)
    known = F.col("status") == KNOWN
    contradicts = ~F.col("_holds") & known & ~F.col("_value").eqNullSafe(F.col("_holder.value"))
    of = [*keys, F.col("_holder.seq").alias("seq")]
    spans = held.groupBy(*of).agg(
        F.max(contradicts).alias("_contradicted"),
        *[F.max_by(c, F.col("_holds")).alias(c) for c in ("status", "confidence", "_value")],
    )
    spans = written(spans.withColumn("_span", F.struct(F.col("_value").alias("value"), F.col("_contradicted").alias("hit"))), "spans")
    chained = running(spans, keys, ["seq"], [Running("_before", "_span", "last", exclusive=True)], hot, buckets)
    differs = ~F.col("_value").eqNullSafe(F.col("_before.value")) & ~F.col("_before.hit")
    turns = known & F.col("_before").isNotNull() & F.coalesce(differs, F.lit(False))
    turned = running(chained.withColumn("_turn", turns.cast("int")), keys, ["seq"], [Running("_turns", "_turn", "sum")], hot, buckets)
    settled = F.when(F.col("_turn") == 0, F.struct(known.alias("fresh"), F.col("_turns").alias("turns")))
    ends = running(turned.withColumn("_settled", settled), keys, ["seq"], [Running("_from", "_settled", "last", skip_nulls=True)], hot, buckets)
    fresh = F.col("_from.fresh") != ((F.col("_turns") - F.col("_from.turns")) % 2 == 1)
    # a holder that is known and not fresh met a contradiction on arrival
    clash = (known & ~fresh) | (fresh & F.col("_contradicted"))
    status = F.when(known & clash, F.lit(TO_REVIEW)).otherwise(F.col("status"))
    best = F.struct("seq", status.alias("status"), "confidence", "_value")
    picked = ends.groupBy(*keys).agg(F.max_by(best, F.col("seq")).alias("_best"), F.max(clash).alias("conflict"))
    return picked.select(*keys, "_best.seq", "_best.status", "_best.confidence", F.col("_best._value").alias(value), "conflict")


def fold_all(readings: DataFrame, keys: list[str], value: str = "value", hot: int = HOT) -> DataFrame:
    """The best reading per key: keys of more than ``hot`` readings by scans, all others in one array each."""
    hot = max(hot, readings.count() // MOST_KEYS)
    large = written(readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select(*keys), "hot-keys")
    if large.isEmpty():
        return fold_readings(readings, keys, value)
    large = F.broadcast(large)  # MOST_KEYS at most
    few = fold_readings(readings.join(large, keys, "left_anti"), keys, value)
    return few.unionByName(fold_scanned(readings.join(large, keys, "left_semi"), keys, value, hot))


def rescan_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, old_value, new_value): what a new scan adds to or changes in a record.

    Both: keys, value (string), safe (known or validated by a person); ``new`` may have ``known``. An addition is a
    known new value that isn't empty, false or zero, where the record has no safe one; a change is
    two safe values that differ, whatever they are: 5 to 0, true to false, and a value to none are changes.
    """
    known = F.col("known") if "known" in new.columns else F.col("safe")
    o = old.select(*keys, F.col("value").alias("old_value"), F.col("safe").alias("old_safe"))
    n = new.where("safe").select(*keys, F.col("value").alias("new_value"), known.alias("new_known"))
    had = F.coalesce("old_safe", F.lit(False))
    fills = F.col("new_known") & ~F.coalesce("new_value", F.lit("")).isin(BLANK)
    kind = F.when(~had & fills, "addition").when(had & ~F.col("old_value").eqNullSafe(F.col("new_value")), "change")
    return n.join(o, keys, "left").withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind", F.when(had, F.col("old_value")).alias("old_value"), "new_value")


def rescan_merge(old: DataFrame, changes: DataFrame, accepted: Column, keys: list[str], new: DataFrame | None = None, page_keys: list[str] | None = None) -> DataFrame:
    """(keys, value, origin): the record with all additions and the accepted changes; nothing else moves.

    With ``new`` and ``page_keys`` (the keys that name a page), pages that the record lacks enter whole.
    """
    taken = changes.where((F.col("kind") == "addition") | accepted).select(*keys, "new_value", F.lit(True).alias("_taken"))
    had = old.select(*keys, "value", F.lit(True).alias("_had"))
    origin = F.when(F.col("_taken").isNull(), "kept").when(F.col("_had").isNull(), "added").otherwise("changed")
    merged = had.join(taken, keys, "full").select(*keys, F.when(F.col("_taken"), F.col("new_value")).otherwise(F.col("value")).alias("value"), origin.alias("origin"))
    if new is None:
        return merged
    fresh = new.join(old.select(*page_keys).distinct(), page_keys, "left_anti").select(*keys, "value", F.lit("page").alias("origin"))
    return merged.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def reapply(fields: DataFrame, validated: DataFrame, keys: list[str]) -> DataFrame:
    """Values that a person has validated override what was read again; validated fields that the new
    reading lacks come back, and fields validated by nobody now keep who had validated them."""
    v = validated.select(*keys, F.col("value").alias("_value"), F.col("validated_by").alias("_by"))
    joined = fields.join(v, keys, "full")
    hit = F.col("_by").isNotNull()
    return (
        joined.withColumn("value", F.when(hit, F.col("_value")).otherwise(F.col("value")))
        .withColumn("status", F.when(hit, KNOWN).otherwise(F.col("status")))
        .withColumn("confidence", F.when(hit, 1.0).otherwise(F.col("confidence")))
        .withColumn("validated_by", F.coalesce("_by", "validated_by"))
        .drop("_value", "_by")
    )


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the one received last: the idempotent upsert of a sink.

    max_by aggregates on the map side, so a key that was sent very often is no hot spot.
    """
    rest = [c for c in rows.columns if c != key]
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
