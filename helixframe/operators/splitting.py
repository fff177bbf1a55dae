"""Splitting reads by groups of contigs, and merging what was split.

Spark needs none of this to scale: what must meet is co-located by its keys. It is here so that files can be exchanged in that form, and
because merge(filter(split(x))) = filter(x) is a strong test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import columns as C

UNMAPPED_GROUP, SPREAD = "unmapped", "spread"


def contig_groups(dictionary: list[tuple[str, int]], size: int = 0) -> dict[str, str]:
    """Contig -> group, in the dictionary's order: a group takes contigs while their length stays within size (the longest contig's, if 0).
    '*' is in the group unmapped."""
    size = size if size > 0 else max((n for _, n in dictionary), default=0)
    if size <= 0:
        raise ValueError("no valid size of contig groups")
    out, number, filled = {"*": UNMAPPED_GROUP}, 1, 0
    for name, n in dictionary:
        if filled and filled + n > size:
            number, filled = number + 1, 0
        out[name], filled = f"group{number:05d}", filled + n
    return out


def _group_of(contig: Column, groups: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return F.try_element_at(table, contig)


def split(reads: DataFrame, groups: dict[str, str], single_end: bool = False) -> DataFrame:
    """reads with a column `part`: each read goes to its contig's group. A mate on another group's contig sends the read to `spread`, and
    a copy with the tag sr to the group."""
    own = F.assert_true(_group_of(F.col("rname"), groups).isNotNull(), F.concat(F.lit("a read lies on a contig that is not in the header: "), F.col("rname")))
    own = F.coalesce(own.cast("string"), _group_of(F.col("rname"), groups))
    if single_end:
        return reads.withColumn("part", own)
    near = (F.col("rnext") == "=") | (F.col("rname") == "*") | F.coalesce(_group_of(F.col("rnext"), groups) == own, F.lit(False))
    tagged = C.with_tag("sr", "i", "1")
    to = F.when(near, F.array(F.struct(own.alias("part"), F.lit(False).alias("copy")))).otherwise(F.array(F.struct(F.lit(SPREAD).alias("part"), F.lit(False).alias("copy")), F.struct(own.alias("part"), F.lit(True).alias("copy"))))
    return reads.withColumn("__to", F.explode(to)).withColumn("tags", F.when(F.col("__to.copy"), tagged).otherwise(F.col("tags"))).withColumn("part", F.col("__to.part")).drop("__to")


def write_split(parts: DataFrame, path: str) -> None:
    parts.write.partitionBy("part").mode("overwrite").parquet(path)


def merge(parts: DataFrame) -> DataFrame:
    """The reads of all parts, without the tagged copies; sort what comes out if an order is wanted."""
    return parts.where((F.col("part") == SPREAD) | C.tag("sr").isNull()).drop("part")


def merge_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_spread(part: DataFrame, spread: DataFrame, contigs: list[str]) -> DataFrame:
    """A part with the spread reads on its contigs, as calling on one part needs them."""
    return part.where(C.tag("sr").isNull()).unionByName(spread.where(F.col("rname").isin(*contigs)))
