"""Splitting oversized texts at natural boundaries.

A text is reduced to a skeleton of one letter per character that is not white space, naming what follows it: b the
end of a block (a blank line), l of a line, w of a word, x nothing. On the skeleton, one bounded-quantifier regex cuts
the pieces: its alternatives are ordered by boundary strength, each consumes as much as the limit allows, and the last
falls back on any character. Piece lengths become offsets into the text, and each piece starts the overlap earlier.
Everything runs in the JVM on one row at a time; only oversized rows are shuffled, to drop repeated ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 120
SPACE = r"\p{IsWhite_Space}"
#: Line ends as in Unicode; a carriage return with line feed is one.
LINE_END = r"(?>\r\n|[\n\r\x0B\f\x{85}\x{2028}\x{2029}])"
INNER = r"[\p{IsWhite_Space}&&[^\n\r\x0B\f\x{85}\x{2028}\x{2029}]]"


def solid_length(text: Column) -> Column:
    """Code points of text without the Unicode property White_Space."""
    return F.char_length(F.regexp_replace(text, f"{SPACE}+", ""))


def is_oversized(text: Column, limit: int) -> Column:
    """Whether more than limit code points are no white space; false for null. Bytes bound code points, so short texts aren't looked at."""
    return F.coalesce((F.octet_length(text) > limit) & (solid_length(text) > limit), F.lit(False))


def cut_pattern(limit: int, overlap: int) -> str:
    """The regex over skeletons. The first piece has no overlap before it and may be longer by that.

    Strong boundaries count in the second half of the room; before any of them in the first half comes a word end in
    the second, so that a cut leaves no splinters.
    """

    def one(room: int) -> str:
        half = room // 2
        late = [f".{{{half},{room - 1}}}{c}" for c in ("b", "l", "[lbw]")]
        return "|".join([f".{{1,{room}}}$", *late, f".{{0,{max(half - 1, 0)}}}[bl]", f".{{0,{max(half - 1, 0)}}}w", f".{{1,{room}}}"])

    return f"^(?:{one(limit)})|(?:{one(limit - overlap)})"


def split_oversized(df: DataFrame, text: str, keys: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """keys, piece_index, piece_start, piece_text, piece_size, boundary for each row of df whose text is oversized.

    A text is oversized if it has more than limit characters (code points) other than white space. Its pieces come in
    order from 0; each has at most limit such characters, the repeated part included, and begins with the last
    overlap characters of the piece before (all of it, where that is shorter). piece_start is the 0-based offset of
    the piece in the text. boundary tells what a piece ends with: block, line, word, char (cut inside a word) or end.
    White space after a cut stays with the piece before it, so that the pieces without their overlap concatenate to
    the text. Null, empty and small texts give no rows; rows repeated in keys and text give one set of pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    big = df.where(is_oversized(F.col(text), limit)).select(F.struct(*keys).alias("key"), F.col(text).alias("whole")).distinct()
    # possessive quantifiers: on long runs of blank lines others would recurse
    shape = F.regexp_replace("whole", f"[^{SPACE}]", "x")
    marks = F.regexp_replace(F.regexp_replace(shape, f"x{INNER}*+{LINE_END}(?:{INNER}*+{LINE_END})++{INNER}*+", "b"), f"x{INNER}*+{LINE_END}{INNER}*+", "l")
    skeleton = F.regexp_replace(F.regexp_replace(marks, f"x{SPACE}+", "w"), f"^{SPACE}+", "")
    cuts = F.regexp_extract_all("skeleton", F.lit(cut_pattern(limit, overlap)), 0)
    solid = F.filter(F.transform(F.split("shape", ""), lambda c, i: F.when(c == "x", i)), lambda i: i.isNotNull())
    found = big.withColumn("shape", shape).withColumn("skeleton", skeleton).withColumn("cuts", cuts).withColumn("solid", solid)
    # the k-th piece ends before the first solid character that it doesn't have
    counts = F.aggregate("cuts", F.array(F.lit(0)), lambda a, c: F.concat(a, F.array(F.element_at(a, -1) + F.length(c))))
    starts = F.transform("counts", lambda n, i: F.when(i == 0, 0).when(n < F.size("solid"), F.get("solid", n)).otherwise(F.char_length("whole")))
    found = found.withColumn("counts", counts).withColumn("starts", starts)
    pieces = F.transform(
        "cuts",
        lambda c, i: F.struct(
            i.alias("piece_index"),
            F.greatest(F.get("starts", i) - F.when(i > 0, overlap).otherwise(0), F.lit(0)).alias("piece_start"),
            F.get("starts", i + 1).alias("piece_end"),
            F.when(i == F.size("cuts") - 1, "end").when(c.endswith("b"), "block").when(c.endswith("l"), "line").when(c.endswith("w"), "word").otherwise("char").alias("boundary"),
        ),
    )
    rows = found.select("key", "whole", F.explode(pieces).alias("p"))
    piece = F.substring(F.col("whole"), F.col("p.piece_start") + 1, F.col("p.piece_end") - F.col("p.piece_start"))
    out = rows.select("key.*", F.col("p.piece_index").alias("piece_index"), F.col("p.piece_start").alias("piece_start"), piece.alias("piece_text"), F.col("p.boundary").alias("boundary"))
    return out.withColumn("piece_size", solid_length(F.col("piece_text")))
