"""Intervals on contigs: sort, flatten, overlap, intersect, and joins by range.

A join by range meets on (contig, bin): both sides name the bins they touch, so it is an equi join that hashes, spills and splits when
it is skewed. The smaller side is broadcast only while it has no more rows than a bound that is counted first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def sorted_by_start(intervals: DataFrame) -> DataFrame:
    return intervals.orderBy("chrom", "start", "end")


def flattened(intervals: DataFrame) -> DataFrame:
    """chrom, start, end: the fewest intervals that cover the same. Those that touch at a point are joined, neighbours that don't stay
    apart ([2,3] and [4,5]).

    An interval opens an island if its start lies beyond all ends before it. Of intervals with one start the longest stands for all, so that no order is left open; these are
    found map-side. Rows within one bin are reduced next, so what a contig's window sorts are islands of bins and not single rows."""
    within = Window.partitionBy("chrom", "__bin").orderBy("start", "end")
    across = Window.partitionBy("chrom").orderBy("start", "end")

    def islands(rows: DataFrame, w, keys: list[str]) -> DataFrame:
        before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = rows.withColumn("__new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")

    longest = intervals.where(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy("chrom", "start").agg(F.max("end").alias("end"))
    binned = longest.withColumn("__bin", F.floor(F.col("start") / (BIN * 64)))
    return islands(islands(binned, within, ["chrom", "__bin"]).drop("__bin"), across, ["chrom"])


def _bins(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / BIN), F.floor(F.greatest(start, end) / BIN)))


def overlapping(rows: DataFrame, regions: DataFrame, chrom: str, start: str, end: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows with region.start < end and region.end >= start of some region on their contig; each row once."""
    flat = flattened(regions).select(F.col("chrom").alias("__chrom"), F.col("start").alias("__from"), F.col("end").alias("__to"))
    near = flat.select("*", _bins(F.col("__from"), F.col("__to")).alias("__bin"))
    hit = (F.col("__from") < F.col(end)) & (F.col("__to") >= F.col(start))
    if near.limit(broadcast_rows + 1).count() <= broadcast_rows:
        near = F.broadcast(near)
    one_bin = F.floor(F.col(start) / BIN)
    last_bin = F.floor(F.greatest(F.col(start), F.col(end)) / BIN)
    # a read touches few bins: a semi join by its first bin, and for those that have more, by each further one
    keyed = rows.withColumn("__bins", F.sequence(one_bin, last_bin))
    single = keyed.where(F.size("__bins") == 1).withColumn("__bin1", F.get("__bins", F.lit(0)))
    found = single.join(near, (F.col(chrom) == F.col("__chrom")) & (F.col("__bin1") == F.col("__bin")) & hit, "left_semi").drop("__bin1")
    longer = keyed.where(F.size("__bins") > 1)
    # named by what the answer depends on: numbers given to rows here would be given twice, and not in one order, as these rows are computed for both sides of the join
    spans = longer.select(F.col(chrom).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e"), "__bins").distinct().select("__c", "__s", "__e", F.explode("__bins").alias("__bin1"))
    reached = spans.join(near, (F.col("__c") == F.col("__chrom")) & (F.col("__bin1") == F.col("__bin")) & (F.col("__from") < F.col("__e")) & (F.col("__to") >= F.col("__s")), "left_semi").select("__c", "__s", "__e").distinct()
    return found.unionByName(longer.join(reached, (F.col(chrom) == F.col("__c")) & (F.col(start) == F.col("__s")) & (F.col(end) == F.col("__e")), "left_semi")).drop("__bins")


def overlaps(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """queries with a column `overlaps` (region.start < end and region.end >= start)."""
    marked = overlapping(queries, regions, "chrom", "start", "end").select("chrom", "start", "end").distinct().withColumn("overlaps", F.lit(True))
    return queries.join(marked, ["chrom", "start", "end"], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(False)))


def intersecting(queries: DataFrame, regions: DataFrame) -> DataFrame:
    """query_start, query_end, chrom, start, end: the regions that share a point with each query, closed at both ends. A pair
    is reported in the first bin that both touch, so once."""
    q = queries.select("chrom", F.col("start").alias("query_start"), F.col("end").alias("query_end"))
    q = q.select("*", _bins(F.col("query_start"), F.col("query_end")).alias("__bin"))
    r = regions.select("chrom", "start", "end").select("*", _bins(F.col("start"), F.col("end")).alias("__bin"))
    both = q.join(r, ["chrom", "__bin"]).where((F.col("end") >= F.col("query_start")) & (F.col("start") <= F.col("query_end")))
    return both.where(F.col("__bin") == F.greatest(F.floor(F.col("query_start") / BIN), F.floor(F.col("start") / BIN))).drop("__bin")


def from_bed(bed: DataFrame) -> DataFrame:
    return bed.select("chrom", "start", "end")


def from_variants(variants: DataFrame, use_info_end: bool = True) -> DataFrame:
    """chrom, start = pos, end = INFO/END, or the last base of REF."""
    own = F.col("pos") + F.length("ref") - 1
    named = F.try_element_at("info", F.lit("END")).try_cast("int") if use_info_end else F.lit(None).cast("int")
    return variants.select("chrom", F.col("pos").alias("start"), F.coalesce(named, own).cast("int").alias("end"))


def sites(intervals: DataFrame) -> DataFrame:
    """What the known-sites commands write: flattened intervals in order."""
    return sorted_by_start(flattened(intervals))


def reads_of_regions(reads: DataFrame, regions: DataFrame, padding: int = 100) -> DataFrame:
    """One row for each read and padded region (region_id, chrom, start, end) that it overlaps."""
    from helixframe.functions import columns as C

    r = regions.select("region_id", F.col("chrom").alias("rname"), (F.col("start") - padding).alias("__from"), (F.col("end") + padding).alias("__to"))
    r = r.select("*", _bins(F.col("__from"), F.col("__to")).alias("__bin"))
    a = reads.withColumn("__end", C.end_position())
    a = a.select("*", _bins(F.col("pos"), F.col("__end")).alias("__bin"))
    both = a.join(r, ["rname", "__bin"]).where((F.col("__from") <= F.col("__end")) & (F.col("__to") >= F.col("pos")))
    return both.where(F.col("__bin") == F.greatest(F.floor(F.col("pos") / BIN), F.floor(F.col("__from") / BIN))).drop("__bin", "__end", "__from", "__to")
