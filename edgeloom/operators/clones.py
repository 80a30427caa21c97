"""Clone groups over text units by normalised text and by skeleton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Scratch


# One character per kind of atom; names are put in last. Repetition stays on
# character classes: Java regexes recurse on repeated groups and overflow the
# stack on long texts.
ATOMS = (("\u0001", "$STR"), ("\u0002", "$VAR"), ("\u0003", "$NUM"))


def marked(text: Column) -> Column:
    """Strings, identifiers and numbers as one mark each; blanks collapsed."""
    s = F.regexp_replace(text, r'"[^"\n]*"|\'[^\'\n]*\'', "\u0001")
    s = F.regexp_replace(s, r"[\p{L}_][\p{L}\p{N}_]*", "\u0002")
    s = F.regexp_replace(s, r"[0-9]+(\.[0-9]+)?", "\u0003")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalised(marks: Column) -> Column:
    for mark, name in ATOMS:
        marks = F.replace(marks, F.lit(mark), F.lit(name))
    return marks


def skeleton(marks: Column) -> Column:
    """Runs of atoms collapse to one mark, so only punctuation and order remain."""
    return F.regexp_replace(marks, "[\u0001-\u0003][\u0001-\u0003 ]*", r"\$ ")


def fingerprints(units: DataFrame, min_chars: int = 1) -> DataFrame:
    """(unit columns without text, hash, skeleton_hash), written once.

    Grouping and joining back both start from this small table, so the text is
    read and normalised once and never shuffled.
    """
    kept = [c for c in units.columns if c != "text"]
    prints = (
        units.withColumn("_n", marked(F.col("text")))
        .filter(F.length("_n") >= min_chars)
        .select(*kept, F.sha2(normalised(F.col("_n")), 256).alias("hash"), F.sha2(skeleton(F.col("_n")), 256).alias("skeleton_hash"))
    )
    return Scratch(units.sparkSession, "clones").save(prints, "prints")


def structural(prints: DataFrame) -> DataFrame:
    """Members of groups with equal normalised text, with the group's size.

    A member names its group; the group's rows are its member list, so a group
    that holds a third of all units stays spread out.
    """
    groups = prints.groupBy("hash").agg(F.count("*").alias("members")).filter("members >= 2")
    return prints.join(groups, "hash").drop("skeleton_hash")


def boilerplate(prints: DataFrame) -> DataFrame:
    """Members of groups with equal skeleton but more than one normalised text."""
    groups = (
        prints.groupBy("skeleton_hash")
        .agg(F.count("*").alias("members"), (F.min("hash") != F.max("hash")).alias("varied"))
        .filter("members >= 2 AND varied")
        .drop("varied")
    )
    return prints.join(groups, "skeleton_hash").drop("hash")
