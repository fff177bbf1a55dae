"""Recalibration over the derived reads. The oracle counts bases in closed form and takes the binomial coefficient along."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators import filters
from helixframe.operators import recalibration as B
from helixframe.plans import views as V

KNOWN = 270_000


def _all(s, d):
    return V.reads(s, d), V.dictionary(s), V.read_groups(s), V.reference(s), V.sites(s, d, KNOWN)


def _tables(s, d):
    return B.counted_tables(*_all(s, d))


def _eligible(s, d):
    return filters.recalibratable(V.reads(s, d), V.dictionary(s))


def _applied(s, d):
    out = B.applied(V.reads(s, d), V.read_groups(s), _tables(s, d))
    return out.select("idx", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"))


def _applied_static(s, d):
    out = B.applied(V.reads(s, d), V.read_groups(s), _tables(s, d), static=(10, 20, 30))
    return out.select("idx", F.array_join(F.col("qual").cast("array<string>"), ",").alias("qual"))


def _quantized(s, d):
    table = B.quantized(B.observed_qualities(B.finalized(_tables(s, d))), 16)
    return s.createDataFrame(list(enumerate(table)), "qual int, stands_for int")


def _merged(s, d):
    t = _tables(s, d)
    return B.merged_tables([t, t])


def _adaptor(s, d):
    """Template sizes changed so that some reads have run into their adaptor."""
    r = _eligible(s, d).withColumn("tlen", F.when(F.col("tlen") > 0, 10 + F.col("k") % 60).otherwise(-10 - F.col("k") % 60)).withColumn("pnext", (F.col("pos") + F.when(C.some(16), 20).otherwise(5)).cast("int"))
    return B.clipped_bases(r).select("idx", "n")


E = f"""r AS ({V.reads_sql()}),
ok AS (SELECT * FROM r WHERE mapq > 0 AND mapq < 255 AND (flag & 1796) = 0 AND pos > 0 AND is_sr = 0 AND pos <= 5300 + 40*refid)"""
BASES = f"""{E},
{V.BASES_SQL.replace("FROM r CROSS JOIN", "FROM ok r CROSS JOIN")},
cut AS (SELECT *, CASE WHEN rev=1 THEN i ELSE i - c END AS i2, 50 - c AS len, CASE WHEN (flag & 129) = 129 THEN -1 ELSE 1 END AS ro FROM bases WHERE NOT soft),
ends AS (SELECT idx, min(i2) FILTER (q > 2) AS lo, max(i2) FILTER (q > 2) AS hi FROM cut GROUP BY idx),
mach AS (SELECT cut.*, CASE WHEN i2 BETWEEN lo AND hi THEN CASE WHEN rev=1 THEN 3 - base ELSE base END END AS mb, CASE WHEN rev=1 THEN ro * (len - i2) ELSE ro * (1 + i2) END AS cyc FROM cut JOIN ends USING (idx)),
seq2 AS (SELECT *, lag(mb) OVER (PARTITION BY idx ORDER BY CASE WHEN rev=1 THEN -i2 ELSE i2 END) AS pmb FROM mach),
ctx AS (SELECT *, CASE WHEN pmb IS NULL OR mb IS NULL THEN NULL ELSE substring('ACGT', CAST(pmb + 1 AS INT), 1) || substring('ACGT', CAST(mb + 1 AS INT), 1) END AS context FROM seq2),
s0 AS ({V.sites_sql(KNOWN)}),
known AS (SELECT DISTINCT chrom, unnest(range(start, "end" + 1)) AS p FROM s0),
obs AS (SELECT ctx.*, coalesce(pu, id) AS read_group FROM ctx JOIN rgs ON rg = id WHERE q >= 6 AND NOT EXISTS (SELECT 1 FROM known WHERE known.chrom = ctx.rname AND known.p = ctx.p))"""
TABLES = f"""{V.GROUPS_SQL}, {BASES},
tab AS (SELECT CASE WHEN gc = 0 THEN 'cycle' WHEN gx = 0 THEN 'context' ELSE 'quality' END AS kind, read_group, q AS qual, cyc AS cycle, context, observations, mismatches FROM (
 SELECT read_group, q, CAST(cyc AS INT) AS cyc, context, grouping(cyc) AS gc, grouping(context) AS gx, count(*) AS observations, count(*) FILTER (base <> refbase) AS mismatches
 FROM obs GROUP BY GROUPING SETS ((read_group, q), (read_group, q, cyc), (read_group, q, context))) z WHERE gx = 1 OR context IS NOT NULL)"""


def _empirical(n: str, m: str, expected: str) -> str:
    """With the binomial coefficient; the highest posterior's first quality."""
    d = f"least(20, abs(trunc(qq - ({expected}))))"
    prior = f"CASE WHEN {d} >= 20 THEN -1.7976931348623157e308 ELSE log10(0.9 * exp(-2 * pow({d}, 2))) END"
    like = f"CASE WHEN qq = 0 THEN -1.7976931348623157e308 ELSE (lgamma({n} + 3) - lgamma({m} + 2) - lgamma({n} - {m} + 2)) / ln(10) - qq / 10 * ({m} + 1) + log10(1 - pow(10, -qq / 10)) * ({n} + 2 - ({m} + 1)) END"
    best = f"list_transform(range(0, 61), lambda q0: list_transform([CAST(q0 AS DOUBLE)], lambda qq: {prior} + {like})[1])"
    return f"CAST(list_position(list_transform({best}, lambda v: round(v, 9)), list_max(list_transform({best}, lambda v: round(v, 9)))) - 1 AS INT)"


FINAL = f"fin AS (SELECT *, {_empirical('observations', 'mismatches', 'CAST(qual AS DOUBLE)')} AS empirical FROM tab)"
COMBINED = "com AS (SELECT read_group, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(mismatches) AS BIGINT) AS mismatches, -10 * log10(sum(observations * pow(10, -qual / 10)) / sum(observations)) AS reported FROM tab WHERE kind = 'quality' GROUP BY read_group)"
APPLY = f"""grp AS (SELECT read_group, {_empirical('observations', 'mismatches', 'reported')} AS g FROM com),
qt AS (SELECT tab.read_group, qual, CAST({_empirical('observations', 'mismatches', 'CAST(g AS DOUBLE)')} AS DOUBLE) AS base FROM tab JOIN grp ON tab.read_group = grp.read_group WHERE kind = 'quality'),
dl AS (SELECT kind, tab.read_group, tab.qual, cycle, context, {_empirical('observations', 'mismatches', 'base')} - base AS delta FROM tab JOIN qt ON tab.read_group = qt.read_group AND tab.qual = qt.qual WHERE kind <> 'quality'),
ab AS (SELECT *, CASE WHEN rev=1 THEN 3 - base ELSE base END AS mb0, CASE WHEN (flag & 129) = 129 THEN -1 ELSE 1 END AS ro FROM (SELECT * FROM ({V.BASES_SQL.replace("bases AS (", "", 1).strip()[:-1]}) z) y),
ae AS (SELECT idx, min(i) FILTER (q > 2) AS lo, max(i) FILTER (q > 2) AS hi FROM ab GROUP BY idx),
am AS (SELECT ab.*, CASE WHEN i BETWEEN lo AND hi THEN mb0 END AS mb, CASE WHEN rev=1 THEN ro * (50 - i) ELSE ro * (1 + i) END AS cyc FROM ab JOIN ae USING (idx)),
ac AS (SELECT *, lag(mb) OVER (PARTITION BY idx ORDER BY CASE WHEN rev=1 THEN -i ELSE i END) AS pmb FROM am),
ax AS (SELECT ac.*, coalesce(pu, id) AS read_group, CASE WHEN pmb IS NULL OR mb IS NULL THEN NULL ELSE substring('ACGT', CAST(pmb + 1 AS INT), 1) || substring('ACGT', CAST(mb + 1 AS INT), 1) END AS context FROM ac JOIN rgs ON rg = id),
aq AS (SELECT ax.idx, ax.i, ax.q, ax.read_group, coalesce(base2, g) + coalesce(dc.delta, 0) + coalesce(dx.delta, 0) AS estimate, g FROM ax LEFT JOIN grp ON grp.read_group = ax.read_group
 LEFT JOIN (SELECT read_group, qual, base AS base2 FROM qt) q2 ON q2.read_group = ax.read_group AND q2.qual = ax.q
 LEFT JOIN dl dc ON dc.kind = 'cycle' AND dc.read_group = ax.read_group AND dc.qual = ax.q AND dc.cycle = ax.cyc
 LEFT JOIN dl dx ON dx.kind = 'context' AND dx.read_group = ax.read_group AND dx.qual = ax.q AND dx.context = ax.context),
an AS (SELECT idx, i, CASE WHEN q < 6 OR g IS NULL THEN q ELSE least(93, greatest(1, CAST(round(estimate) AS INT))) END AS q2, q < 6 OR g IS NULL AS same FROM aq)"""


def _with(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_ADAPTOR_SQL = """SELECT idx, count(*) FILTER (NOT soft AND NOT gone) AS n FROM (SELECT *,
 coalesce(paired AND CASE WHEN rev=1 THEN last_base > pn ELSE pos <= pn + tl END AND CASE WHEN rev=1 THEN pn - 1 ELSE pos + abs(tl) END BETWEEN pos AND last_base
  AND CASE WHEN rev=1 THEN p <= pn - 1 ELSE p >= pos + abs(tl) END, false) AS gone FROM (
 SELECT bases.*, CASE WHEN tlen > 0 THEN 10 + k % 60 ELSE -10 - k % 60 END AS tl, CAST(pos + CASE WHEN rev=1 THEN 20 ELSE 5 END AS INT) AS pn, CASE WHEN rev=1 THEN pos + 49 - c ELSE b + 49 END AS last_base,
 (flag & 1) <> 0 AND (flag & 12) = 0 AND ((flag & 16) <> 0) <> ((flag & 32) <> 0) AS paired FROM bases) y) z GROUP BY idx"""

QUERIES = {
    "recalibration_clip": lambda s, d: B.clipped_bases(_eligible(s, d)),
    "adaptor_clip": _adaptor,
    "bqsr_cycle": lambda s, d: B.end_cycles(_eligible(s, d)),
    "bqsr_context": lambda s, d: B.counted_contexts(_eligible(s, d)),
    "bqsr_mismatch": lambda s, d: B.counted_mismatches(*_all(s, d)),
    "bqsr_tables": _tables,
    "bqsr_merge": _merged,
    "bqsr_combined": lambda s, d: B.combined(_tables(s, d)).select("read_group", "observations", "mismatches", F.round("reported", 9).alias("reported")),
    "bqsr_empirical": lambda s, d: B.finalized(_tables(s, d)),
    "bqsr_quantize": _quantized,
    "static_quantize": lambda s, d: s.createDataFrame(list(enumerate(B.static_levels([10, 20, 30]))), "qual int, stands_for int"),
    "bqsr_apply": _applied,
    "bqsr_apply_static": _applied_static,
    "read_group_covariate": lambda s, d: B.group_covariate(V.reads(s, d), V.read_groups(s)).groupBy("read_group").agg(F.count(F.lit(1)).alias("n")),
}
SQL = {
    "recalibration_clip": _with("SELECT idx, count(*) AS n, CAST(sum(p * q) AS BIGINT) AS pq, string_agg(substring('ACGT', CAST(base + 1 AS INT), 1), '' ORDER BY i) AS letters FROM cut GROUP BY idx", BASES.split(",\nends AS")[0]),
    "adaptor_clip": _with(_ADAPTOR_SQL, E, V.BASES_SQL.replace("FROM r CROSS JOIN", "FROM ok r CROSS JOIN")),
    "bqsr_cycle": _with("SELECT idx, CAST(max(cyc) FILTER (i2 = 0) AS INT) AS first_cycle, CAST(max(cyc) FILTER (i2 = len - 1) AS INT) AS last_cycle FROM mach GROUP BY idx", BASES.split(",\nseq2 AS")[0]),
    "bqsr_context": _with("SELECT context, count(*) AS n, CAST(sum(idx) AS BIGINT) AS sum_idx FROM ctx GROUP BY context", BASES.split(",\ns0 AS")[0]),
    "bqsr_mismatch": _with("SELECT idx, count(*) AS bases, count(*) FILTER (base <> refbase) AS mismatches FROM obs GROUP BY idx", V.GROUPS_SQL, BASES),
    "bqsr_tables": _with("SELECT * FROM tab", TABLES),
    "bqsr_merge": _with("SELECT kind, read_group, qual, cycle, context, 2 * observations AS observations, 2 * mismatches AS mismatches FROM tab", TABLES),
    "bqsr_combined": _with("SELECT read_group, observations, mismatches, round(reported, 9) AS reported FROM com", TABLES, COMBINED),
    "bqsr_empirical": _with("SELECT * FROM fin", TABLES, FINAL),
    "static_quantize": "SELECT CAST(q AS INT) AS qual, CAST(CASE WHEN q <= 6 THEN q WHEN q <= 10 THEN 10 WHEN q <= 20 THEN 20 ELSE 30 END AS INT) AS stands_for FROM (SELECT unnest(range(0, 254)) AS q) t",
    "bqsr_apply": _with("SELECT idx, string_agg(q2, ',' ORDER BY i) AS qual FROM an GROUP BY idx", TABLES, COMBINED, APPLY),
    "bqsr_apply_static": _with("SELECT idx, string_agg(CASE WHEN same THEN q2 WHEN q2 <= 6 THEN q2 WHEN q2 <= 10 THEN 10 WHEN q2 <= 20 THEN 20 ELSE 30 END, ',' ORDER BY i) AS qual FROM an GROUP BY idx", TABLES, COMBINED, APPLY),
    "read_group_covariate": _with("SELECT coalesce(pu, id) AS read_group, count(*) AS n FROM r JOIN rgs ON rg = id GROUP BY 1", f"r AS ({V.reads_sql()})", V.GROUPS_SQL),
}
