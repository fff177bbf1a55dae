"""Filters, rewrites, orders, splits and intervals over the derived reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators import filters, intervals, sorting, splitting
from helixframe.plans import views as V

R = f"r AS ({V.reads_sql()})"
KEY = ["idx", "flag"]


def _of(f, *columns):
    """A query that applies f to the reads and returns columns."""
    return lambda spark, sf: f(V.reads(spark, sf), spark, sf).select(*(columns or KEY))


def _q(where: str, columns: str = "idx, flag") -> str:
    return f"WITH {R} SELECT {columns} FROM r WHERE {where}"


def _dictionary(spark, first: int = 0):
    return V.dictionary(spark).where(F.col("refid") >= first)


FLAT_SQL = """
s1 AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s0),
s2 AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s1),
flat AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM s2 GROUP BY chrom, island)"""
#: Sites of all events are spread over so many positions where few of them are to lie on the reads' contigs.
FEW = 270_000
QUERY_INTERVALS = """
SELECT 'chr'||(1 + o_orderkey % 4) AS chrom, CAST((o_orderkey*77) % 5300 AS INT) AS start, CAST((o_orderkey*77) % 5300 + o_orderkey % 90 AS INT) AS {end}
FROM {orders} GROUP BY 1, 2, 3"""
GROUPS = splitting.contig_groups([(n, x) for _, n, x in V.CONTIGS[:3]] + [("chr4", 100)])
GROUP_SQL = "CASE " + " ".join(f"WHEN c = '{k}' THEN '{v}'" for k, v in GROUPS.items()) + " END"


def _spread_reads(spark, sf):
    """Reads of which one in seven has its mate on another contig, and one in 41 has no contig."""
    other = F.concat(F.lit("chr"), (1 + (F.col("k") * 5 + F.col("m")) % 4).cast("string"))
    return V.reads(spark, sf).withColumn("rnext", F.when((F.col("k") % 7 == 0) & (F.col("rnext") == "="), other).otherwise(F.col("rnext"))).withColumn("rname", F.when(F.col("k") % 41 == 0, "*").otherwise(F.col("rname")))


SPREAD_SQL = """
sr AS (SELECT idx, is_sr, CASE WHEN k % 41 = 0 THEN '*' ELSE rname END AS rname, CASE WHEN k % 7 = 0 AND rnext = '=' THEN 'chr'||(1 + (k*5 + m) % 4) ELSE rnext END AS rnext FROM r),
own AS (SELECT sr.*, (SELECT g FROM grp WHERE c = rname) AS g, (SELECT g FROM grp WHERE c = rnext) AS g2 FROM sr)"""
GRP_SQL = "grp AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in GROUPS.items()) + ") t(c, g))"
NEAR = "(rnext = '=' OR rname = '*' OR coalesce(g2 = g, false))"


def _tags(spark, sf, f):
    return f(V.reads(spark, sf)).select("idx", F.array_join(F.transform("tags", lambda x: F.concat(x["k"], F.lit(":"), x["t"], F.lit(":"), x["v"])), "|").alias("tags"))


def _tags_sql(keep: set[str]) -> str:
    one = {"RG": "'RG:Z:'||rg", "X0": "'X0:i:'||x0", "X1": "'X1:i:'||x1", "XM": "'XM:i:'||xm", "XO": "'XO:i:0'", "XG": "'XG:i:0'", "sr": "CASE WHEN is_sr=1 THEN 'sr:i:1' END"}
    parts = ", ".join(v for k, v in one.items() if k in keep)
    return f"WITH {R} SELECT idx, concat_ws('|', {parts}) AS tags FROM r" if parts else f"WITH {R} SELECT idx, '' AS tags FROM r"


ALL_TAGS = {"RG", "X0", "X1", "XM", "XO", "XG", "sr"}


def _lengths(spark, sf):
    o = C.ops()
    return V.reads(spark, sf).select("idx", C.read_length(o).cast("int").alias("read_length"), C.reference_length(o).cast("int").alias("reference_length"), C.end_position().cast("int").alias("end_pos"), C.well_formed().alias("well_formed"))


CIGARS = ["*", "5S45M", "45M5S", "5H5S40M", "20M2D30M", "20M3I27M", "10M100N40M", "50S", "10M10M", "3I47M", "47M3I", "20M2I2D26M", "20M2D", "5H45M5H", "5P45M", "20M5P25M", "10m5d35M", "20=2X28=", "0M50M", "5S3I42M", "40M5P"]
#: read bases, reference bases, well formed, by hand
CIGAR_FACTS = [(0, 0, False), (50, 45, True), (50, 45, True), (45, 40, True), (50, 52, True), (50, 47, True), (50, 150, True), (50, 0, False), (20, 20, True), (50, 47, True), (50, 47, True), (48, 48, False), (20, 22, False), (45, 45, True), (45, 45, True), (45, 45, True), (45, 50, True), (50, 50, True), (50, 50, False), (50, 42, True), (40, 40, False)]


def _edge_cigars(spark, sf):
    rows = V.load(spark, sf, "orders").select(F.get(F.array(*[F.lit(c) for c in CIGARS]), (F.col("o_orderkey") % len(CIGARS)).cast("int")).alias("cigar"), F.col("o_orderkey").alias("idx"))
    o = C.ops()
    return rows.select("idx", C.read_length(o).alias("read_length"), C.reference_length(o).alias("reference_length"), C.well_formed().alias("well_formed"), C.cigar_text(C.merged(o)).alias("merged"))


_MERGED = [("20M" if c == "10M10M" else "50M" if c == "0M50M" else c.upper()) for c in CIGARS]
_EDGE_SQL = "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {a}, {b}, {str(w).lower()}, '{m}')" for i, ((a, b, w), m) in enumerate(zip(CIGAR_FACTS, _MERGED, strict=True))) + f") t(i, read_length, reference_length, well_formed, merged)) SELECT o_orderkey AS idx, read_length, reference_length, well_formed, merged FROM orders JOIN f ON o_orderkey % {len(CIGARS)} = i"

_NAMED = "multiple proper unmapped next_unmapped reversed next_reversed first last secondary qc_failed duplicate supplementary".split()


def _flag_predicates(spark, sf):
    named = [C.is_(n).alias(n) for n in _NAMED]
    return V.reads(spark, sf).select("idx", C.every(3).alias("every3"), C.some(48).alias("some48"), C.not_every(65).alias("not_every65"), C.not_any(260).alias("not_any260"), *named)


_FLAG_SQL = f"WITH {R} SELECT idx, (flag & 3) = 3 AS every3, (flag & 48) <> 0 AS some48, (flag & 65) <> 65 AS not_every65, (flag & 260) = 0 AS not_any260, " + ", ".join(f"(flag & {1 << i}) <> 0 AS {n}" for i, n in enumerate(_NAMED)) + " FROM r"

_CLEAN_SQL = f"""WITH {R}, x AS (SELECT r.*, 5100 - 150*refid AS ln, b + 49 - CASE WHEN rev=1 THEN c ELSE 0 END AS last_base FROM r)
SELECT idx, CASE WHEN (flag & 4) <> 0 THEN 0 ELSE mapq END AS mapq,
 CASE WHEN (flag & 4) <> 0 OR last_base <= ln OR pos > ln THEN CASE WHEN (flag & 4) = 0 AND pos > ln THEN '50S' ELSE cigar END
  WHEN rev=1 THEN (50 - c - (last_base - ln))||'M'||(c + last_base - ln)||'S'
  WHEN c=0 THEN (50 - (last_base - ln))||'M'||(last_base - ln)||'S'
  ELSE c||'S'||(50 - c - (last_base - ln))||'M'||(last_base - ln)||'S' END AS cigar FROM x"""


def _short_dictionary(spark):
    return V.dictionary(spark).withColumn("ln", 5100 - 150 * F.col("refid"))


_ORDER_SQL = """row_number() OVER (ORDER BY refid, pos, rev, qname, mflag, mapq, next_ref, next_pos, tlen, idx)"""
_MASK = "CASE WHEN f2 & 8 <> 0 THEN f2 & ~32 ELSE f2 END"
_RANK_SQL = f"""WITH {R}, m AS (SELECT *, CASE WHEN f1 & 4 <> 0 THEN f1 & ~16 ELSE f1 END AS f2 FROM (SELECT *, CASE WHEN flag & 1 = 0 THEN flag & ~40 ELSE flag END AS f1 FROM r) a),
k AS (SELECT idx, refid, pos, (flag & 16) <> 0 AS rv, qname, {_MASK} AS mflag, mapq, CASE WHEN flag & 1 <> 0 THEN refid END AS nr, CASE WHEN flag & 1 <> 0 THEN pnext END AS np, tlen FROM m)
SELECT idx, CAST(row_number() OVER (ORDER BY refid, pos, rv, qname, mflag, mapq, nr NULLS FIRST, np NULLS FIRST, tlen, idx) AS BIGINT) AS coordinate_rank FROM k"""

QUERIES = {
    "filter_unmapped": _of(lambda r, s, d: filters.mapped(r)),
    "filter_unmapped_strict": _of(lambda r, s, d: filters.strictly_mapped(r.withColumn("pos", F.when(F.col("k") % 17 == 0, 0).otherwise(F.col("pos"))))),
    "filter_mapq": _of(lambda r, s, d: filters.mapping_quality(r, 20), "idx", "mapq"),
    "filter_exact": _of(lambda r, s, d: filters.exactly_mapped(r.withColumn("cigar", F.when(F.col("k") % 3 == 0, "20M2D30M").otherwise(F.col("cigar"))))),
    "filter_exact_strict": _of(lambda r, s, d: filters.exactly_mapped_strict(r)),
    "filter_overlap_bed": _of(lambda r, s, d: filters.overlapping_regions(r, V.sites(s, d, FEW)), "idx", "rname", "pos"),
    "remove_duplicates": _of(lambda r, s, d: filters.without_duplicates(r.withColumn("flag", F.when(F.col("k") % 9 == 0, F.col("flag") + 1024).otherwise(F.col("flag"))))),
    "remove_spread_copies": _of(lambda r, s, d: filters.without_spread_copies(r, True)),
    "clear_duplicate_flag": _of(lambda r, s, d: filters.cleared_duplicate_flag(r.withColumn("flag", F.col("flag") + 1024))),
    "rename_chromosomes": _of(lambda r, s, d: filters.renamed_chromosomes(r, "x"), "idx", "rname", "rnext"),
    "add_refid": _of(lambda r, s, d: filters.with_reference_ids(r, _dictionary(s, 1)), "idx", "refid", "next_refid"),
    "replace_read_group": lambda spark, sf: _tags(spark, sf, lambda r: filters.with_read_group(r, "new")),
    "replace_dictionary": _of(lambda r, s, d: filters.in_dictionary(r, _dictionary(s, 2)), "idx", "rname"),
    "keep_tags": lambda spark, sf: _tags(spark, sf, lambda r: filters.only_tags(r, ["RG", "XM", "sr"])),
    "keep_no_tags": lambda spark, sf: _tags(spark, sf, lambda r: filters.only_tags(r, [])),
    "remove_tags": lambda spark, sf: _tags(spark, sf, lambda r: filters.without_tags(r, ["RG", "XM", "sr"])),
    "clean_reads": _of(lambda r, s, d: filters.cleaned(r, _short_dictionary(s)), "idx", "mapq", "cigar"),
    "sample_filter": _of(lambda r, s, d: filters.of_sample(r, V.read_groups(s), "one"), "idx", "rg"),
    "flag_predicates": _flag_predicates,
    "recalibration_eligible": _of(lambda r, s, d: filters.recalibratable(r, _short_dictionary(s)), "idx", "mapq"),
    "calling_eligible": _of(lambda r, s, d: filters.callable_reads(r, _short_dictionary(s)), "idx", "mapq"),
    "region_read_filter": _of(lambda r, s, d: filters.for_region(r)[0], "idx", "mapq"),
    "replace_ids": lambda spark, sf: _tags(spark, sf, lambda r: filters.with_replaced_ids(filters.only_tags(r, ["RG", "X0"]), {"rg1": "other"}, {})),
    "cigar_lengths": _lengths,
    "cigar_edge_cases": _edge_cigars,
    "coordinate_rank": _of(lambda r, s, d: sorting.coordinate_numbered(r.withColumn("next_refid", F.when(C.some(1), F.col("refid")).otherwise(-1))), "idx", "coordinate_rank"),
    "queryname_rank": _of(lambda r, s, d: sorting.queryname_numbered(r), "idx", "queryname_rank"),
    "downsample": lambda spark, sf: sorting.downsampled(V.reads(spark, sf).withColumn("pos", F.col("pos") % 40 + 1), 5).groupBy("rname", "pos").agg(F.count(F.lit(1)).alias("n")),
    "best_reads": _of(lambda r, s, d: sorting.best_by(r, ["rname"], [F.desc("mapq"), F.asc("idx")], 128), "idx", "rname"),
    "contig_groups": lambda spark, sf: spark.createDataFrame(list(GROUPS.items()), "contig string, part string"),
    "split_reads": lambda spark, sf: splitting.split(_spread_reads(spark, sf), GROUPS).groupBy("part", C.tag("sr").isNotNull().alias("tagged")).agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("long").alias("sum_idx")),
    "split_single_end": lambda spark, sf: splitting.split(_spread_reads(spark, sf), GROUPS, single_end=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").cast("long").alias("sum_idx")),
    "merge_split": lambda spark, sf: splitting.merge(splitting.split(filters.without_spread_copies(_spread_reads(spark, sf), True), GROUPS)).select("idx", "rname", "rnext"),
    "part_with_spread": lambda spark, sf: _part_with_spread(spark, sf),
    "intervals_flatten": lambda spark, sf: intervals.flattened(V.sites(spark, sf)),
    "intervals_overlap": lambda spark, sf: intervals.overlaps(_queries(spark, sf), V.sites(spark, sf)),
    "intervals_intersect": lambda spark, sf: intervals.intersecting(_queries(spark, sf), intervals.flattened(V.sites(spark, sf))),
    "intervals_sorted": lambda spark, sf: intervals.sorted_by_start(V.sites(spark, sf, FEW)),
    "reads_of_regions": lambda spark, sf: intervals.reads_of_regions(V.reads(spark, sf), _regions(spark, sf)).select("idx", "region_id"),
}


def _queries(spark, sf):
    return spark.sql(QUERY_INTERVALS.replace("{end}", "`end`"), orders=V.load(spark, sf, "orders").select("o_orderkey"))


def _regions(spark, sf):
    return V.sites(spark, sf, FEW).withColumn("region_id", F.col("start").cast("long") * 10 + F.substring("chrom", 4, 1).cast("long")).groupBy("region_id").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"), F.max("end").alias("end"))


def _part_with_spread(spark, sf):
    parts = splitting.split(filters.without_spread_copies(_spread_reads(spark, sf), True), GROUPS)
    return splitting.with_spread(parts.where("part = 'group00001'"), parts.where(F.col("part") == splitting.SPREAD), [k for k, v in GROUPS.items() if v == "group00001"]).select("idx", "rname")


_QI = "q AS (" + QUERY_INTERVALS.replace("{end}", '"end"').replace("{orders}", "orders") + ")"
_S = lambda spread: f"s0 AS ({V.sites_sql(spread)}), {FLAT_SQL}"
_HEADER_FIT = "coalesce(pos <= 5100 - 150*refid, false)"
_GOOD = f"(flag & 1796) = 0 AND pos > 0 AND {_HEADER_FIT} AND is_sr = 0"

SQL = {
    "filter_unmapped": _q("(flag & 4) = 0"),
    "filter_unmapped_strict": _q("(flag & 4) = 0 AND k % 17 <> 0"),
    "filter_mapq": _q("mapq >= 20", "idx, mapq"),
    "filter_exact": _q("k % 3 <> 0"),
    "filter_exact_strict": _q("x0 = 1 AND x1 = 0 AND xm = 0"),
    "filter_overlap_bed": f"WITH {R}, {_S(FEW)} SELECT idx, rname, pos FROM r WHERE EXISTS (SELECT 1 FROM flat WHERE chrom = rname AND start < CASE WHEN flag & 4 <> 0 THEN pos WHEN rev=1 THEN pos + 49 - c ELSE b + 49 END AND \"end\" >= pos)",
    "remove_duplicates": _q("k % 9 <> 0"),
    "remove_spread_copies": _q("is_sr = 0"),
    "clear_duplicate_flag": _q("true"),
    "rename_chromosomes": _q("true", "idx, 'x'||rname AS rname, rnext"),
    "add_refid": _q("true", "idx, CASE WHEN refid >= 1 THEN refid ELSE -1 END AS refid, CASE WHEN rnext = '=' AND refid >= 1 THEN refid ELSE -1 END AS next_refid"),
    "replace_read_group": _tags_sql(ALL_TAGS).replace("'RG:Z:'||rg", "'RG:Z:new'"),
    "replace_dictionary": _q("refid >= 2", "idx, rname"),
    "keep_tags": _tags_sql({"RG", "XM", "sr"}),
    "keep_no_tags": _tags_sql(set()),
    "remove_tags": _tags_sql(ALL_TAGS - {"RG", "XM", "sr"}),
    "clean_reads": _CLEAN_SQL,
    "sample_filter": _q("rg IN ('rg0', 'rg1')", "idx, rg"),
    "flag_predicates": _FLAG_SQL,
    "recalibration_eligible": _q(f"mapq > 0 AND mapq < 255 AND {_GOOD}", "idx, mapq"),
    "calling_eligible": _q(f"mapq >= 20 AND mapq <> 255 AND {_GOOD}", "idx, mapq"),
    "region_read_filter": _q("mapq >= 20", "idx, mapq"),
    "replace_ids": f"WITH {R} SELECT idx, 'RG:Z:'||CASE WHEN rg = 'rg1' THEN 'other' ELSE rg END||'|X0:i:'||x0 AS tags FROM r",
    "cigar_lengths": _q("true", "idx, 50 AS read_length, CAST(50 - c AS INT) AS reference_length, CAST(CASE WHEN rev=1 THEN pos + 49 - c ELSE b + 49 END AS INT) AS end_pos, true AS well_formed"),
    "cigar_edge_cases": _EDGE_SQL,
    "coordinate_rank": _RANK_SQL,
    "queryname_rank": f"WITH {R} SELECT idx, CAST(row_number() OVER (ORDER BY qname, idx) AS BIGINT) AS queryname_rank FROM r",
    "downsample": f"WITH {R} SELECT rname, CAST(p AS INT) AS pos, CAST(least(5, count(*)) AS BIGINT) AS n FROM (SELECT rname, pos % 40 + 1 AS p FROM r) x GROUP BY rname, p",
    "best_reads": f"WITH {R} SELECT idx, rname FROM (SELECT *, row_number() OVER (PARTITION BY rname ORDER BY mapq DESC, idx) AS n FROM r) x WHERE n <= 128",
    "contig_groups": f"WITH {GRP_SQL} SELECT c AS contig, g AS part FROM grp",
    "split_reads": f"""WITH {R}, {GRP_SQL}, {SPREAD_SQL},
 o AS (SELECT idx, CASE WHEN {NEAR} THEN g ELSE 'spread' END AS part, is_sr = 1 AS tagged FROM own UNION ALL SELECT idx, g, true FROM own WHERE NOT {NEAR})
 SELECT part, tagged, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx FROM o GROUP BY part, tagged""",
    "split_single_end": f"WITH {R}, {GRP_SQL}, {SPREAD_SQL} SELECT g AS part, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx FROM own GROUP BY g",
    "merge_split": f"WITH {R}, {GRP_SQL}, {SPREAD_SQL} SELECT idx, rname, rnext FROM own WHERE is_sr = 0",
    "part_with_spread": f"WITH {R}, {GRP_SQL}, {SPREAD_SQL} SELECT idx, rname FROM own WHERE is_sr = 0 AND g = 'group00001'",
    "intervals_flatten": f"WITH {_S(27_000)} SELECT * FROM flat",
    "intervals_overlap": f"WITH {_QI}, {_S(27_000)} SELECT *, EXISTS (SELECT 1 FROM flat WHERE flat.chrom = q.chrom AND flat.start < q.\"end\" AND flat.\"end\" >= q.start) AS overlaps FROM q",
    "intervals_intersect": f"WITH {_QI}, {_S(27_000)} SELECT q.start AS query_start, q.\"end\" AS query_end, flat.* FROM q JOIN flat ON flat.chrom = q.chrom AND flat.\"end\" >= q.start AND flat.start <= q.\"end\"",
    "intervals_sorted": V.sites_sql(FEW),
    "reads_of_regions": f"""WITH {R}, s0 AS ({V.sites_sql(FEW)}), g AS (SELECT CAST(start AS BIGINT) * 10 + CAST(substring(chrom, 4, 1) AS BIGINT) AS region_id, min(chrom) AS chrom, min(start) AS s, max("end") AS e FROM s0 GROUP BY 1)
 SELECT idx, region_id FROM r JOIN g ON chrom = rname AND s - 100 <= CASE WHEN rev=1 THEN pos + 49 - c ELSE b + 49 END AND e + 100 >= pos""",
}
