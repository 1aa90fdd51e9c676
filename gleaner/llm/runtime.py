"""What the operators share: tables in the shared folder, and keys of documents."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_folder, stored, table

__all__ = ["NO_ID", "content_key", "order_id", "private", "shared_folder", "stored", "table"]

#: Stands for a missing doc_id wherever documents are ordered or matched.
NO_ID = -(1 << 63)


def order_id(column: str | Column) -> Column:
    """doc_id as a long that is never null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def content_key(column: str | Column) -> Column:
    """A hash of a text that tells rows of one doc_id apart; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.xxhash64(F.coalesce(column, F.lit("")))


def private(df: DataFrame, n: int) -> list[str]:
    """n column names that df has not."""
    taken, names = {c.lower() for c in df.columns}, []
    while len(names) < n:
        name = f"own_{uuid4().hex}"
        names += [name] if name not in taken else []
    return names
