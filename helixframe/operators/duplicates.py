"""Duplicates: marking, optical duplicates, counters, library sizes.

Reads are compared by where their 5' ends lie, unclipped. The best of each position is found by aggregations with map-side combining, so that a
deep position costs a task no more than a shallow one; only narrow columns take part, and the flags are joined back by idx."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.schema import DUPLICATE, MULTIPLE, NEXT_UNMAPPED, REVERSED, SECONDARY, SUPPLEMENTARY, UNMAPPED

UNKNOWN = "Unknown Library"
PIXELS, MOST = 100, 300_000
END = ("refid", "upos", "rev")


def with_library(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """Adds lb, the library of a read's group; null for none. groups: id and lb of the header."""
    named = groups.select(F.col("id").alias("__rg"), "lb")
    return reads.drop("lb").withColumn("__rg", C.tag("RG")).join(F.broadcast(named), "__rg", "left").drop("__rg")  # one row for each read group of a header


def is_true_pair(flag: Column | str = "flag") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    return c.bitwiseAND(MULTIPLE | NEXT_UNMAPPED) == MULTIPLE


def eligible(reads: DataFrame) -> DataFrame:
    """idx, qname, flag, lib, refid, upos, rev, score, pair of reads that can be duplicates. lib is never null."""
    return reads.where(C.not_any(UNMAPPED | SECONDARY | SUPPLEMENTARY)).select(
        "idx", "qname", "flag", F.coalesce("lb", F.lit(UNKNOWN)).alias("lib"), F.col("lb").isNull().alias("no_lib"), "refid", C.unclipped_position().alias("upos"), C.some(REVERSED).alias("rev"), C.phred_score().alias("score"), is_true_pair().alias("pair"))


def duplicate_fragments(ends: DataFrame) -> DataFrame:
    """idx of fragments that are duplicates: all, where a true pair has an end there; else all but the one with the highest
    score (then the smallest name, then the smallest idx)."""
    key = ["lib", "no_lib", *END]
    best = ends.groupBy(*key).agg(F.max("pair").alias("any_pair"), F.min(F.when(~F.col("pair"), F.struct((-F.col("score")).alias("s"), "qname", "idx"))).alias("best"))
    return ends.where(~F.col("pair")).join(best, key).where(F.col("any_pair") | (F.col("idx") != F.col("best.idx"))).select("idx")


def pairs(ends: DataFrame) -> DataFrame:
    """One row for each two true-pair reads of a library and name, in the order of idx: lib, no_lib, qname, a and b (structs of refid, upos, rev,
    idx, flag, score; a is the left one), score."""
    turn = F.floor((F.row_number().over(Window.partitionBy("lib", "no_lib", "qname").orderBy("idx")) - 1) / 2)
    end = F.struct(*END, "idx", "flag", "score")
    two = ends.where("pair").withColumn("turn", turn).groupBy("lib", "no_lib", "qname", "turn").agg(F.count(F.lit(1)).alias("n"), F.min(end).alias("a"), F.max(end).alias("b"))
    return two.where("n = 2").select("lib", "no_lib", "qname", "a", "b", (F.col("a.score") + F.col("b.score")).alias("score"))


def _pair_key() -> list[Column]:
    return [F.col("lib"), F.col("no_lib"), *[F.col(f"{s}.{e}").alias(f"{s}_{e}") for s in "ab" for e in END]]


PAIR_KEY = ["lib", "no_lib", *[f"{s}_{e}" for s in "ab" for e in END]]


def with_origin(mates: DataFrame) -> DataFrame:
    """pairs with origin, the idx of the left read of the best pair at the same place."""
    keyed = mates.select(*_pair_key(), "qname", "a", "b", "score")
    best = keyed.groupBy(*PAIR_KEY).agg(F.min(F.struct((-F.col("score")).alias("s"), "qname", F.col("a.idx").alias("idx"))).alias("best"))
    return keyed.join(best, PAIR_KEY).withColumn("origin", F.col("best.idx")).drop("best")


def duplicate_pairs(mates: DataFrame) -> DataFrame:
    """idx of both reads of pairs that are not the best of their place."""
    return with_origin(mates).where("a.idx <> origin").select(F.explode(F.array("a.idx", "b.idx")).alias("idx"))


def mark(reads: DataFrame) -> DataFrame:
    """reads (with lb, refid, idx) with the duplicate flag set on duplicates."""
    ends = eligible(reads)
    found = duplicate_fragments(ends).unionByName(duplicate_pairs(pairs(ends))).withColumn("__dup", F.lit(True))
    return reads.join(found, "idx", "left").withColumn("flag", F.when(F.col("__dup"), F.col("flag").bitwiseOR(DUPLICATE)).otherwise(F.col("flag"))).drop("__dup")


# optical duplicates


def optical_members(mates: DataFrame, reads: DataFrame) -> DataFrame:
    """For pairs at a place with more than one (and no more than MOST on their strand): origin, strand (of the first read in the template), rg, tile, x, y, idx."""
    shared = with_origin(mates)
    sizes = shared.groupBy("origin").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    first = F.when(F.col("a.flag").bitwiseAND(64) != 0, F.col("a")).otherwise(F.col("b"))
    rows = shared.join(sizes, "origin").select("lib", "origin", "qname", first.alias("f")).select("lib", "origin", F.col("f.rev").alias("strand"), F.col("f.idx").alias("idx"), C.tile_info().alias("t")).where("t IS NOT NULL")
    full = rows.groupBy("origin", "strand").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST)
    rows = rows.join(full, ["origin", "strand"], "left_anti")
    return rows.join(reads.select("idx", C.tag("RG").alias("rg")), "idx").select("lib", "origin", "strand", "rg", F.col("t.tile").alias("tile"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), "idx")


def clusters(group: np.ndarray, x: np.ndarray, y: np.ndarray, pixels: int) -> np.ndarray:
    """The cluster of each point: points of a group within so many pixels in both directions are together. Points of one cell (pixels + 1 wide) always
    are; neighbouring cells are, if any two of their points are."""
    cx, cy = np.floor_divide(x, pixels + 1), np.floor_divide(y, pixels + 1)
    order = np.lexsort((cy, cx, group))
    g, cx, cy, x, y = group[order], cx[order], cy[order], x[order], y[order]
    new = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(cx) != 0) | (np.diff(cy) != 0)]) if len(g) else np.zeros(0, bool)
    cell, first = np.cumsum(new) - 1, np.flatnonzero(new)
    edges = [*first.tolist(), len(g)]
    at = {(a, b, c): i for i, (a, b, c) in enumerate(zip(g[first].tolist(), cx[first].tolist(), cy[first].tolist(), strict=True))}
    parent = list(range(len(first)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (a, b, c), i in at.items():
        for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
            j = at.get((a, b + dx, c + dy))
            if j is None or root(i) == root(j):
                continue
            p, q = slice(edges[i], edges[i + 1]), slice(edges[j], edges[j + 1])
            if any((np.abs(x[q] - u) <= pixels)[np.abs(y[q] - v) <= pixels].any() for u, v in zip(x[p].tolist(), y[p].tolist(), strict=True)):
                parent[root(j)] = root(i)
    out = np.empty(len(g), np.int64)
    out[order] = np.array([root(i) for i in range(len(first))], np.int64)[cell] if len(g) else 0
    return out


def optical_counts(members: DataFrame, pixels: int = PIXELS) -> DataFrame:
    """lib, origin, optical: sum of (size - 1) over the clusters of each place. A place's strand, read group and tile meet in one task, with many other
    places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        code = t.column("code").to_numpy()
        found = clusters(code, t.column("x").to_numpy().astype(np.int64), t.column("y").to_numpy().astype(np.int64), pixels)
        _, at, n = np.unique(found, return_index=True, return_counts=True)
        keep = n > 1
        yield pa.RecordBatch.from_pydict({"lib": t.column("lib").take(pa.array(at[keep])).combine_chunks(), "origin": t.column("origin").take(pa.array(at[keep])).combine_chunks(), "optical": pa.array(n[keep] - 1, pa.int64())})

    coded = members.withColumn("code", F.xxhash64("origin", "strand", F.coalesce("rg", F.lit("")), "tile"))
    part = coded.repartition("code").select("lib", "origin", "code", "x", "y")
    return part.mapInArrow(run, "lib string, origin long, optical long").groupBy("lib", "origin").agg(F.sum("optical").alias("optical"))


# counters

COUNTERS = ("unpaired_examined", "pairs_examined", "secondary_or_supplementary", "unmapped", "unpaired_duplicates", "pair_duplicates", "optical_duplicates")


def counters(marked: DataFrame, groups: DataFrame, optical: DataFrame | None = None) -> DataFrame:
    """library and the seven counters, for each library of the header and for reads without one. marked: reads with lb, duplicates flagged."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    unmapped, other = C.some(UNMAPPED), C.some(SECONDARY | SUPPLEMENTARY)
    plain, pair, dup = ~unmapped & ~other, is_true_pair(), C.some(DUPLICATE)
    own = marked.groupBy(F.coalesce("lb", F.lit(UNKNOWN)).alias("library")).agg(
        n(plain & ~pair).alias("unpaired_examined"), F.floor(n(plain & pair) / 2).cast("long").alias("pairs_examined"), n(~unmapped & other).alias("secondary_or_supplementary"), n(unmapped).alias("unmapped"),
        n(plain & ~pair & dup).alias("unpaired_duplicates"), F.floor(n(plain & pair & dup) / 2).cast("long").alias("pair_duplicates"))
    spark = marked.sparkSession
    names = groups.where("lb IS NOT NULL").select(F.col("lb").alias("library")).unionByName(spark.createDataFrame([(UNKNOWN,)], "library string")).distinct()
    seen = optical.groupBy(F.col("lib").alias("library")).agg(F.sum("optical").alias("optical_duplicates")) if optical is not None else spark.createDataFrame([], "library string, optical_duplicates long")
    out = names.join(own, "library", "left").join(seen, "library", "left")
    return out.select("library", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS])


def merged_counters(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("library").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def histograms(mates: DataFrame, optical: DataFrame | None = None) -> DataFrame:
    """library, set_size, all_sets, non_optical_sets, optical_sets: how many places have so many pairs (without the optical ones; how many
    optical ones and the origin)."""
    sizes = with_origin(mates).groupBy(F.col("lib").alias("library"), "origin").agg(F.count(F.lit(1)).alias("n"))
    o = optical.select(F.col("lib").alias("library"), "origin", "optical") if optical is not None else mates.sparkSession.createDataFrame([], "library string, origin long, optical long")
    both = sizes.join(o, ["library", "origin"], "left").withColumn("optical", F.coalesce("optical", F.lit(0)))
    rows = both.select("library", F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.col("n").alias("set_size")), F.struct(F.lit("non").alias("kind"), (F.col("n") - F.col("optical")).alias("set_size")), F.struct(F.lit("opt").alias("kind"), F.when(F.col("optical") > 0, F.col("optical") + 1).alias("set_size")))).alias("s")).where("s.set_size > 0")
    n = lambda k: F.sum(F.when(F.col("s.kind") == k, 1).otherwise(0)).cast("long")
    return rows.groupBy("library", F.col("s.set_size").cast("long").alias("set_size")).agg(n("all").alias("all_sets"), n("non").alias("non_optical_sets"), n("opt").alias("optical_sets"))


def library_size(pairs_examined: Column, unique_pairs: Column) -> Column:
    """The number of molecules from which so many draws give so many distinct ones, by 40 halvings; 0 without duplicates."""
    n, c = pairs_examined.cast("double"), unique_pairs.cast("double")
    f = lambda x: c / x - 1 + F.exp(-n / x)
    high = F.array_min(F.filter(F.sequence(F.lit(2), F.lit(60)), lambda p: f(F.pow(F.lit(10.0), p.cast("double")) * c) < 0))
    state = F.struct(F.lit(1.0).alias("lo"), F.pow(F.lit(10.0), high.cast("double")).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        r = (s["lo"] + s["hi"]) / 2
        u = f(r * c)
        return F.struct(F.when(u > 0, r).when(u == 0, r).otherwise(s["lo"]).alias("lo"), F.when(u < 0, r).when(u == 0, r).otherwise(s["hi"]).alias("hi"))

    size = F.aggregate(F.sequence(F.lit(1), F.lit(40)), state, halve, lambda s: F.floor(c * ((s["lo"] + s["hi"]) / 2)).cast("long"))
    return F.when((pairs_examined > 0) & (unique_pairs > 0) & (pairs_examined > unique_pairs), size).otherwise(F.lit(0).cast("long"))


def derived(counted: DataFrame) -> DataFrame:
    """counters with percent_duplication and library_size."""
    examined = F.col("unpaired_examined") + 2 * F.col("pairs_examined")
    percent = F.when(examined == 0, F.lit(0.0)).otherwise((F.col("unpaired_duplicates") + 2 * F.col("pair_duplicates")).cast("double") / examined)
    unique = F.col("pairs_examined") - F.col("pair_duplicates")
    return counted.withColumns({"percent_duplication": percent, "library_size": library_size(F.col("pairs_examined") - F.col("optical_duplicates"), unique)})


def return_on_investment(counted: DataFrame, most: int = 100) -> DataFrame:
    """library, x, roi: what x times as much sequencing would give, for libraries with a size."""
    size, unique = F.col("library_size").cast("double"), (F.col("pairs_examined") - F.col("pair_duplicates")).cast("double")
    rows = counted.where("library_size > 0").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(most))))
    return rows.select("library", "x", (size * (1 - F.exp(-(F.col("x") * F.col("pairs_examined")).cast("double") / size)) / unique).alias("roi"))
