"""Exact deduplication with DataFrame functions only: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPACE = " \t\n\x0b\x0c\r"


def normalised(column: str):
    """The text without blanks, tabs and line ends; null counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    for blank in SPACE:  # byte-wise search; translate() and a regular expression take more time a character
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after deleting white space; null is the empty text. Of equal texts the row with
    the most code points in its original text stays, then the one with the smallest id (a null id comes last).
    Rows that repeat an id with equal text are each returned and counted; both are marked kept if that id stays.
    An empty table gives an empty result; further columns are ignored, whatever their names.

    The texts themselves meet only where a hash repeats: rows are first reduced to hashes, and the byte comparison
    groups by (hash, text) with map-side aggregation, so a text with a million copies crosses the network once per task.
    """
    norm = normalised(text_col)
    hashed = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
            F.unhex(F.md5(norm)).alias("h128"),
            F.unhex(F.sha2(norm, 256)).alias("sha"),
        )
    )
    best = F.max(F.struct("points", (-F.col("id")).alias("minus"))).alias("best")
    groups = hashed.groupBy("h128", "sha").agg(F.count("*").alias("group_size"), best)
    repeated = (
        hashed.groupBy("h128").agg(F.count("*").alias("n")).filter("n > 1").select("h128")
    )
    known = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("known")  # rows without an id are compared too
    members = hashed.join(repeated, "h128", "left_semi").select(known).distinct()
    texts = df.select(F.col(id_col).alias("id"), norm.alias("norm")).select(known, "norm")
    # Byte comparison: as many distinct texts as distinct hash pairs, else a hash hides a collision.
    compared = (
        texts.join(members.hint("shuffle_hash"), "known", "left_semi")
        .groupBy(F.unhex(F.md5("norm")).alias("h128"), "norm")
        .agg(F.count("*").alias("n"))
        .groupBy("h128", F.unhex(F.sha2("norm", 256)).alias("sha"))
        .agg(F.count("*").alias("texts"))
    )
    groups = groups.join(compared, ["h128", "sha"], "left").select(
        "h128",
        "sha",
        "group_size",
        "best",
        F.when(F.coalesce("texts", F.lit(1)) > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")))
        .otherwise(F.lit(True))
        .alias("same"),
    )
    return hashed.join(groups.filter("same"), ["h128", "sha"]).select(
        F.col("id").alias(id_col),
        (-F.col("best.minus")).alias("keep_id"),
        "group_size",
        F.expr("id <=> -best.minus").alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
