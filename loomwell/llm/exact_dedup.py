"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical after every ASCII white-space character
(space, tab to carriage return) is deleted. Refinement goes length -> prefix hash -> full
hash; each level only looks at rows whose group of the level before has two members.

Defined cases: a null text counts as empty, so all null and blank texts form one group;
an empty table gives an empty result; a text of any length is hashed whole; a repeated ``doc_id`` is one document in several rows,
each of which is reported, and rows that tie with the kept row in id and length are all reported as
kept (``keep_one`` passes on one row of equal id and text); ties in length go to the smallest id; a null id is left as it is; extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwell.llm.shared import BROADCAST_IDS, TEXT_KEY, forget, materialise, text_key, text_or_empty, without

#: What equality ignores.
BLANKS = r"[\x20\x09-\x0D]"
#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 64


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document, made in the only pass over the texts."""
    text = text_or_empty(text_col)
    bare = F.regexp_replace(text, BLANKS, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_text"),
        F.length(bare).alias("n_bare"),
        F.xxhash64(F.substring(bare, 1, PREFIX_CHARS)).alias("head"),
        F.unhex(F.sha2(bare, 256)).alias("digest"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    The signature rows (about 60 bytes) are written once; texts are never shuffled. Group
    tables are written before they are joined back, so that both sides of every join are
    shuffles and adaptive execution can split a hot group.
    """
    sig, _ = materialise(signatures(docs, id_col, text_col), "dedup-signatures")
    by_length, lengths_path = materialise(_groups(sig, "n_bare"), "dedup-lengths", narrow=True)
    alike = sig.select("doc_id", "n_text", "n_bare", "head", "digest").join(
        by_length.hint("merge"), "n_bare", "left_semi"
    )
    by_head, heads_path = materialise(_groups(alike, "n_bare", "head"), "dedup-heads", narrow=True)
    alike = alike.join(by_head.hint("merge"), ["n_bare", "head"], "left_semi")
    first = F.min(F.struct((-F.col("n_text")).alias("less"), F.col("doc_id")))
    groups = (
        alike.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where("group_size > 1")
        .select("digest", "group_size", F.col("first.doc_id").alias("keep_id"), (-F.col("first.less")).alias("keep_n"))
    )
    groups, _ = materialise(groups, "dedup-groups", narrow=True)
    forget(docs.sparkSession, lengths_path)
    forget(docs.sparkSession, heads_path)
    return (
        sig.select("doc_id", "n_text", "digest")
        .join(groups.hint("merge"), "digest", "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            F.coalesce(
                F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_text") == F.col("keep_n"))),
                F.lit(False),
            ).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The first pass hashes beginnings only; the full hash is made for texts whose length and
    beginning another row has, too. Rows are dropped, not ids: of an id with two texts each is judged by itself,
    and of rows with equal id and text one stays.
    """
    bare = F.regexp_replace(text_or_empty(text_col), BLANKS, "")
    key = text_key(text_col).alias(TEXT_KEY)
    marks = docs.select(F.col(id_col).alias("doc_id"), key, F.length(bare).alias("n_bare"), F.xxhash64(F.substring(bare, 1, PREFIX_CHARS)).alias("head"))
    marks, _ = materialise(marks, "dedup-marks")
    by_length, lengths_path = materialise(_groups(marks, "n_bare"), "dedup-lengths", narrow=True)
    alike = marks.join(by_length.hint("merge"), "n_bare", "left_semi")
    by_head, heads_path = materialise(_groups(alike, "n_bare", "head"), "dedup-heads", narrow=True)
    alike = alike.join(by_head.hint("merge"), ["n_bare", "head"], "left_semi").select("doc_id", TEXT_KEY).distinct()
    alike, alike_path = materialise(alike, "dedup-alike", narrow=True)
    texts = docs.select(F.col(id_col).alias("doc_id"), key, F.col(text_col).alias("text"))
    again = texts.join(F.broadcast(alike) if alike.count() <= BROADCAST_IDS else alike.hint("merge"), ["doc_id", TEXT_KEY], "left_semi")
    bare = F.regexp_replace(text_or_empty("text"), BLANKS, "")
    full, full_path = materialise(again.select("doc_id", TEXT_KEY, F.length(text_or_empty("text")).alias("n"), F.unhex(F.sha2(bare, 256)).alias("digest")), "dedup-full")
    first = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id"), F.col(TEXT_KEY))).alias("first")
    firsts, firsts_path = materialise(full.groupBy("digest").agg(first), "dedup-firsts", narrow=True)
    other = (F.col("doc_id") != F.col("first.doc_id")) | (F.col(TEXT_KEY) != F.col(f"first.{TEXT_KEY}"))
    out = full.join(firsts.hint("merge"), "digest").where(other).select("doc_id", TEXT_KEY).distinct()
    dropped, _ = materialise(out, "dedup-dropped", narrow=True)
    for path in (lengths_path, heads_path, alike_path, full_path, firsts_path):
        forget(docs.sparkSession, path)
    return without(docs, dropped, marks, id_col, text_col)


ORACLE = """
WITH s AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents
), k AS (
  SELECT doc_id, h, n,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM s
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM k
"""
