"""Filters and rewrites of reads. Each is one predicate or projection, so Catalyst fuses a chain of them into one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators.intervals import overlapping
from helixframe.schema import DUPLICATE, QC_FAILED, SECONDARY, UNMAPPED


def mapped(reads: DataFrame) -> DataFrame:
    return reads.where(C.not_any(UNMAPPED))


def strictly_mapped(reads: DataFrame) -> DataFrame:
    """Also with a position and a reference."""
    return reads.where(~C.strictly_unmapped())


def mapping_quality(reads: DataFrame, least: int) -> DataFrame:
    """least 0 keeps all; more than 255 keeps none."""
    return reads if least <= 0 else reads.where(F.lit(False)) if least > 255 else reads.where(F.col("mapq") >= least)


def exactly_mapped(reads: DataFrame) -> DataFrame:
    """No insertion, deletion, skip, hard clip, padding, match or mismatch operation: only M and S."""
    return reads.where(~F.coalesce(F.col("cigar"), F.lit("*")).rlike("(?i)[IDNHPX=]"))


EXACT_TAGS = {"X0": 1, "X1": 0, "XM": 0, "XO": 0, "XG": 0}


def exactly_mapped_strict(reads: DataFrame) -> DataFrame:
    """One best hit, no other hits, mismatches or gaps, all said by the aligner's tags."""
    return reads.where(F.coalesce(_all([C.tag(k) == str(v) for k, v in EXACT_TAGS.items()]), F.lit(False)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def overlapping_regions(reads: DataFrame, regions: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Reads that overlap a region (chrom, start, end; half open at the start). A read without reference bases counts as its position
    alone."""
    length = C.reference_length(C.ops())
    end = F.when(C.some(UNMAPPED) | (length == 0), F.col("pos")).otherwise(F.col("pos") + length - 1)
    return overlapping(reads.withColumn("__end", end), regions, "rname", "pos", "__end", broadcast_rows).drop("__end")


def without_duplicates(reads: DataFrame) -> DataFrame:
    return reads.where(C.not_any(DUPLICATE))


def without_spread_copies(reads: DataFrame, header_has_spread: bool) -> DataFrame:
    """Drops the copies that splitting has made (tag sr), if the header says that it has."""
    return reads.where(C.tag("sr").isNull()) if header_has_spread else reads


def cleared_duplicate_flag(reads: DataFrame) -> DataFrame:
    return reads.withColumn("flag", F.col("flag").bitwiseAND(~DUPLICATE))


def renamed_chromosomes(reads: DataFrame, prefix: str = "chr") -> DataFrame:
    named = lambda c: F.when(F.col(c).isin("=", "*"), F.col(c)).otherwise(F.concat(F.lit(prefix), F.col(c)))
    return reads.withColumns({"rname": named("rname"), "rnext": named("rnext")})


def with_reference_ids(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds refid and next_refid (-1: not in the dictionary). The dictionary has one row for each contig of the header; it becomes
    one map, so no join is needed."""
    table = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("sn", F.col("refid").cast("int")))).alias("__ids"))
    own = F.coalesce(F.try_element_at("__ids", "rname"), F.lit(-1))
    other = F.when(F.col("rnext") == "=", own).otherwise(F.coalesce(F.try_element_at("__ids", "rnext"), F.lit(-1)))
    base = reads.drop("refid", "next_refid").crossJoin(F.broadcast(table))  # one row: the header's dictionary
    return base.withColumns({"refid": own, "next_refid": other}).drop("__ids")


def with_read_group(reads: DataFrame, group: str) -> DataFrame:
    """Every read's RG tag becomes this one."""
    return reads.withColumn("tags", C.with_tag("RG", "Z", group))


def in_dictionary(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Reads whose contig is in the (new) dictionary, and those without a contig."""
    known = dictionary.select(F.col("sn").alias("rname")).unionByName(dictionary.sparkSession.createDataFrame([("*",)], "rname string"))
    return reads.join(F.broadcast(known), "rname", "left_semi")  # a header's dictionary: contigs, not reads


def without_tags(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.withColumn("tags", C.without_tags(keys)) if keys else reads


def only_tags(reads: DataFrame, keys: list[str]) -> DataFrame:
    return reads.withColumn("tags", C.only_tags(keys))


def cleaned(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Unmapped reads get mapping quality 0; a read that hangs over its contig's end has the overhang soft clipped."""
    table = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("sn", F.col("ln").cast("int")))).alias("__ln"))
    length = F.try_element_at("__ln", "rname")
    o = C.ops()
    over = F.col("pos") + C.reference_length(o) - 1 - length
    hangs = C.not_any(UNMAPPED) & (over > 0)
    base = reads.crossJoin(F.broadcast(table))  # one row: the header's dictionary
    return base.withColumns({"mapq": F.when(C.some(UNMAPPED), F.lit(0)).otherwise(F.col("mapq")), "cigar": F.when(hangs, _clipped_end(o, over)).otherwise(F.col("cigar"))}).drop("__ln")


def _clipped_end(o: Column, over: Column) -> Column:
    """The operations with so many reference bases at the end turned into a soft clip. Hard clips stay outermost."""
    hard = F.aggregate(F.filter(F.slice(o, -1, 1), lambda x: x["op"] == "H"), F.lit(0), lambda n, x: n + x["len"])
    state = F.struct(over.cast("int").alias("left"), F.lit(0).alias("soft"), F.array().cast("array<struct<len:int,op:string>>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        eats_reference, eats_read, open_end = x["op"].isin(*C.REFERENCE_OPS), x["op"].isin(*C.READ_OPS), F.size(a["kept"]) == 0
        from_reference = F.when(eats_reference, F.least(a["left"], x["len"])).otherwise(0)
        # until something is kept, insertions, deletions and clips at the end go whole
        cut = F.when(~open_end, 0).when(eats_reference & eats_read, from_reference).otherwise(x["len"])
        rest = x["len"] - cut
        keep = F.when((rest > 0) & (x["op"] != "H"), F.concat(F.array(F.struct(rest.alias("len"), x["op"].alias("op"))), a["kept"])).otherwise(a["kept"])
        return F.struct((a["left"] - from_reference).alias("left"), (a["soft"] + F.when(eats_read, cut).otherwise(0)).alias("soft"), keep.alias("kept"))

    def end(a: Column) -> Column:
        soft = F.when(a["soft"] > 0, F.concat(a["kept"], F.array(F.struct(a["soft"].alias("len"), F.lit("S").alias("op"))))).otherwise(a["kept"])
        return C.cigar_text(F.when(hard > 0, F.concat(soft, F.array(F.struct(hard.alias("len"), F.lit("H").alias("op"))))).otherwise(soft))

    lead = F.filter(F.slice(o, 1, 1), lambda x: x["op"] == "H")
    text = F.aggregate(F.reverse(o), state, step, end)
    return F.concat(F.array_join(F.transform(lead, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""), text)


def of_sample(reads: DataFrame, groups: DataFrame, sample: str | None = None) -> DataFrame:
    """Reads whose read group belongs to the sample. groups: id and sm of the header. Without a name the header must have one sample."""
    if sample is None:
        names = [r[0] for r in groups.select("sm").distinct().limit(2).collect()]
        if len(names) != 1:
            raise ValueError("the header has several samples: name one")
        sample = names[0]
    return reads.withColumn("__rg", C.tag("RG")).join(F.broadcast(groups.where(F.col("sm") == sample).select(F.col("id").alias("__rg"))), "__rg", "left_semi").drop("__rg")


def _agrees(dictionary: DataFrame, reads: DataFrame) -> tuple[DataFrame, Column]:
    table = dictionary.agg(F.map_from_entries(F.collect_list(F.struct("sn", F.col("ln").cast("int")))).alias("__ln"))
    return reads.crossJoin(F.broadcast(table)), F.coalesce(F.col("pos") <= F.try_element_at("__ln", "rname"), F.lit(False))


def _whole() -> Column:
    n = F.length("seq")
    fits = C.bound(C.ops(), lambda o: (n == C.read_length(o)) & ~F.exists(o, lambda x: x["op"] == "N"))
    return (n > 0) & (n == F.size("qual")) & fits & C.tag("RG").isNotNull() & C.tag("sr").isNull()


def recalibratable(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Reads that count for base-quality recalibration."""
    base, inside = _agrees(dictionary, reads)
    return base.where((F.col("mapq") > 0) & (F.col("mapq") < 255) & C.not_any(SECONDARY | DUPLICATE | QC_FAILED) & ~C.strictly_unmapped() & (F.col("pos") > 0) & inside & _whole()).drop("__ln")


def callable_reads(reads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Reads that variant calling uses, without their tags but RG."""
    base, inside = _agrees(dictionary, reads)
    good = (F.col("mapq") >= 20) & (F.col("mapq") != 255) & C.not_any(SECONDARY | DUPLICATE | QC_FAILED) & ~C.strictly_unmapped() & (F.col("pos") > 0) & (C.reference_length(C.ops()) > 0) & inside & _whole() & C.well_formed()
    return base.where(good).drop("__ln").withColumn("tags", C.only_tags(["RG"]))


def for_region(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reads that go into a region's calling, the others): ten bases, mapping quality 20, mate on the same contig."""
    passes = F.coalesce((F.length("seq") >= 10) & (F.col("mapq") >= 20) & (C.not_any(1) | F.col("rnext").isin("=", "*") | (F.col("rnext") == F.col("rname"))), F.lit(False))
    return reads.where(passes), reads.where(~passes)


def with_replaced_ids(reads: DataFrame, groups: dict[str, str], programs: dict[str, str]) -> DataFrame:
    """RG and PG tags renamed, as merging headers asks for."""
    def renamed(value: Column, names: dict[str, str]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value) if names else value

    new = F.transform("tags", lambda x: F.struct(x["k"].alias("k"), x["t"].alias("t"), F.when(x["k"] == "RG", renamed(x["v"], groups)).when(x["k"] == "PG", renamed(x["v"], programs)).otherwise(x["v"]).alias("v")))
    return reads.withColumn("tags", new) if groups or programs else reads


def where(reads: DataFrame, condition: Column) -> DataFrame:
    """A predicate of the user's own, as a Column."""
    return reads.where(condition)
