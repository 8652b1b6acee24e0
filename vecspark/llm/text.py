"""Expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: what separates words; the words themselves are ``[^\x20\x09-\x0D]+``
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def only(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text, under fixed names: whatever other columns are called, they cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
