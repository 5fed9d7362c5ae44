"""Expressions on identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def canonical_uuid(col: Column) -> Column:
    """The lower-case 8-4-4-4-12 form of any usual writing of a UUID (case, dashes, braces, urn prefix, blanks).

    A value that is no UUID comes back unchanged, null as null.
    """
    bare = F.regexp_replace(F.lower(col), r"[\p{IsWhite_Space}\p{Cf}(){}\[\]\"']", "")
    hexes = F.regexp_replace(F.regexp_replace(bare, "^(urn:)?(uuid:)?", ""), "-", "")
    parts = [F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(col.rlike(PLAIN_UUID), col).when(hexes.rlike("^[0-9a-f]{32}$"), F.concat_ws("-", *parts)).otherwise(col)


def clean_label(col: Column) -> Column:
    """Upper case without surrounding white space; null stays null."""
    return F.upper(F.regexp_replace(col, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", ""))
