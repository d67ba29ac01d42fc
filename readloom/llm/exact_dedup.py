"""Exact deduplication by a 128-bit content hash, confirmed byte by byte (DataFrame functions only).

Every row gets the MD5 of its text without white space, its length and its SHA-256; that narrow table is written
once. Groups are formed on it with map-side combining, first by (hash, length) and then by hash, so a text that a
third of all rows share costs one row per map task. The bytes inside the groups are compared by a second grouping
on (hash, bytes), which also combines on the map side: a hash with two byte strings is a collision. Collisions
are not expected for MD5 on text that nobody forged; if there is one, the groups are formed by (hash, bytes).

One row of each group is kept; which one is written down with the groups, by a key that rows get in the narrow table.

Defined cases: a null text equals the empty text; all empty texts form one group; a null doc_id is never chosen
while the group has a row of the same length with an id, and of rows with null ids alone one is kept (keep_id null); rows that
repeat a doc_id are each reported, each counts in group_size, and one of them at most is kept; columns other than
the id, the text and the row key are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import ROW, SPACE, materialize, text_or_empty, with_row_key


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[str], Column] = F.md5
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and the row key of ``docs`` if it has one.

    Of the rows with equal text (white space aside) the one with the most code points stays, then the smallest id.
    """
    text = text_or_empty(text_col)
    given = [ROW] if ROW in docs.columns else []
    wide = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("raw"), *given)
        .withColumn("norm", F.regexp_replace("raw", SPACE, ""))
        .withColumn("h", content_hash("norm"))
    )
    collided = wide.groupBy("h", "norm").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("kinds"))
    key = ["h"] if collided.where("kinds > 1").isEmpty() else ["h", "norm"]
    row = F.col(ROW) if given else F.monotonically_increasing_id()
    rows = materialize(
        wide.select(
            "doc_id", *key, F.char_length("raw").cast("long").alias("len"), F.sha2("norm", 256).alias("text_sha256"), row.alias(ROW)
        ),
        "exact-rows",
    )
    by_length = rows.groupBy(*key, "len").agg(
        F.min("doc_id").alias("least_id"), F.min_by(ROW, F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("row"), F.count("*").alias("n")
    )
    groups = by_length.groupBy(*key).agg(
        F.max_by("least_id", "len").alias("keep_id"), F.max_by("row", "len").alias("keep_row"), F.sum("n").alias("group_size")
    )
    groups = materialize(groups, "exact-groups")  # a table, so that the join can split the rows of a hot group
    return rows.join(groups, key).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col(ROW) == F.col("keep_row")).alias("kept"),
        "text_sha256",
        *given,
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows go by a key of their own, so null and repeated ids lose no other row."""
    keyed = with_row_key(docs)
    kept = exact_groups(keyed, id_col, text_col).where("kept").select(ROW)
    return keyed.join(kept, ROW, "left_semi").select(*docs.columns)
