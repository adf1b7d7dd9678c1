"""Shared helpers of the corpus operators: the library's tables in the shared folder, white space, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..tables import Scratch, components, delete_folder, scratch_root

__all__ = ["SPACES", "Scratch", "components", "delete_folder", "held_out", "scratch_root", "squeeze"]

#: ASCII white space, as the contracts of the operators define it.
SPACES = r"[\x20\x09-\x0D]+"


def squeeze(text: Column) -> Column:
    """Null becomes empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def held_out(doc_id: Column) -> Column:
    """Rows kept from every fit: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
