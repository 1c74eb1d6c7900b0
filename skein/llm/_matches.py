"""Places of pattern matches in a text, by DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches of a block. Sums run within a block and over blocks, as an array that grows inside a sum is copied each time.
BLOCK = 128


def pieces(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<gap, m, v>>: the text before each leftmost non-overlapping match, the match, its group; last the rest, m null."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(F.split(text, pattern, -1), whole, lambda g, m: F.struct(g.alias("gap"), m.alias("m"), m.alias("v")))
    if not group:
        return both
    return F.zip_with(both, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, v: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), v.alias("v")))


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, v>> of the matches, in code points, the end exclusive; v is the group."""
    parts = F.transform(pieces(text, pattern, group), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("v")))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda k: F.slice(a, k * BLOCK + 1, BLOCK))
    blocks = F.transform(cut(parts), lambda b: F.struct(b.alias("b"), F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("n")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(blocks, first, lambda s, x: F.struct((s["at"] + x["n"]).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    none = F.array().cast("array<struct<start:int,end:int,v:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + x["n"]
        found = F.struct(start.alias("start"), end.alias("end"), x["v"].alias("v"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["n"].isNotNull(), F.concat(s["out"], F.array(found))).otherwise(s["out"]).alias("out"))

    within = F.zip_with(blocks, starts, lambda x, at: F.aggregate(x["b"], F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"]))
    return F.when(text.rlike(pattern), F.flatten(within)).otherwise(none)


def blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with blanks instead of the matches whose group has ``least`` characters; places stay."""
    kept = F.transform(pieces(text, pattern, group), lambda x: F.concat(x["gap"], F.when(F.length(x["v"]) >= least, F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(F.coalesce(x["m"], F.lit("")))))
    return F.when(text.rlike(pattern), F.array_join(kept, "")).otherwise(text)
