"""Duplicates over the derived reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators import duplicates as D
from helixframe.plans import views as V


def _reads(spark, sf):
    return V.reads(spark, sf)


def _ends(spark, sf):
    return D.eligible(_reads(spark, sf))


def _mates(spark, sf):
    return D.pairs(_ends(spark, sf))


def _marked(spark, sf):
    r = _reads(spark, sf)
    return r, D.mark(r)


def _optical(spark, sf, pixels=D.PIXELS):
    r = _reads(spark, sf)
    return D.optical_counts(D.optical_members(D.pairs(D.eligible(r)), r), pixels)


def _counters(spark, sf):
    r, m = _marked(spark, sf)
    return D.counters(m, V.read_groups(spark), D.optical_counts(D.optical_members(D.pairs(D.eligible(r)), r)))


def _histogram(spark, sf):
    mates = _mates(spark, sf)
    return D.histograms(mates, _optical(spark, sf))


def _merged(spark, sf):
    c = _counters(spark, sf)
    return D.merged_counters([c, c])


SCORE = "list_sum(list_filter(" + V.QUAL_SQL + ", lambda q: q >= 15))"
STEPS = f"""r AS ({V.reads_sql()}),
e AS (SELECT *, coalesce(lb, '{D.UNKNOWN}') AS lib, (flag & 9) = 1 AS tp, CAST({SCORE} AS BIGINT) AS score FROM r WHERE (flag & 2308) = 0),
f AS (SELECT *, max(CASE WHEN tp THEN 1 ELSE 0 END) OVER (PARTITION BY lib, lb IS NULL, refid, upos, rev) AS any_tp, row_number() OVER (PARTITION BY lib, lb IS NULL, refid, upos, rev, tp ORDER BY score DESC, qname, idx) AS nth FROM e),
df AS (SELECT idx FROM f WHERE NOT tp AND (any_tp = 1 OR nth > 1)),
m1 AS (SELECT *, (row_number() OVER (PARTITION BY lib, lb IS NULL, qname ORDER BY idx) - 1) // 2 AS turn FROM e WHERE tp),
m2 AS (SELECT *, count(*) OVER (PARTITION BY lib, lb IS NULL, qname, turn) AS mates, row_number() OVER (PARTITION BY lib, lb IS NULL, qname, turn ORDER BY refid, upos, rev, idx) AS o FROM m1),
p AS (SELECT a.lib, a.lb IS NULL AS no_lib, a.qname, a.refid AS r1, a.upos AS p1, a.rev AS v1, a.idx AS i1, a.flag AS f1, a.rg AS rg1, b.refid AS r2, b.upos AS p2, b.rev AS v2, b.idx AS i2, b.rg AS rg2, a.score + b.score AS score
 FROM m2 a JOIN m2 b ON a.lib = b.lib AND (a.lb IS NULL) = (b.lb IS NULL) AND a.qname = b.qname AND a.turn = b.turn AND a.o = 1 AND b.o = 2 AND a.mates = 2),
pr AS (SELECT *, first_value(i1) OVER w AS origin, row_number() OVER w AS nth FROM p WINDOW w AS (PARTITION BY lib, no_lib, r1, p1, v1, r2, p2, v2 ORDER BY score DESC, qname, i1)),
dp AS (SELECT unnest([i1, i2]) AS idx FROM pr WHERE nth > 1),
d AS (SELECT idx FROM df UNION SELECT idx FROM dp),
marked AS (SELECT r.* REPLACE (CASE WHEN d.idx IS NULL THEN flag ELSE flag | 1024 END AS flag) FROM r LEFT JOIN d ON r.idx = d.idx)"""

TILES = """t AS (SELECT lib, origin, CASE WHEN (f1 & 64) <> 0 THEN v1 ELSE v2 END AS strand, CASE WHEN (f1 & 64) <> 0 THEN rg1 ELSE rg2 END AS rg, i1 AS id,
  CAST(split_part(qname, ':', 5) AS INT) AS tile, CAST(split_part(qname, ':', 6) AS INT) AS x, CAST(split_part(qname, ':', 7) AS INT) AS y FROM pr)"""
REACH = """near AS (SELECT a.lib, a.origin, a.id AS a, b.id AS b FROM t a JOIN t b ON a.origin = b.origin AND a.strand = b.strand AND a.rg = b.rg AND a.tile = b.tile AND abs(a.x - b.x) <= 100 AND abs(a.y - b.y) <= 100),
reach AS (SELECT * FROM near UNION SELECT reach.lib, reach.origin, reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
least AS (SELECT lib, origin, a, min(b) AS root FROM reach GROUP BY lib, origin, a),
optical AS (SELECT lib, origin, CAST(sum(n - 1) AS BIGINT) AS optical FROM (SELECT lib, origin, root, count(*) AS n FROM least GROUP BY lib, origin, root) z WHERE n > 1 GROUP BY lib, origin)"""
COUNTS = f"""libs AS (SELECT 'lib' || i AS library FROM (SELECT unnest(range(0, 3)) AS i) z UNION ALL SELECT '{D.UNKNOWN}'),
own AS (SELECT coalesce(lb, '{D.UNKNOWN}') AS library,
  count(*) FILTER (flag & 2308 = 0 AND flag & 9 <> 1) AS unpaired_examined, count(*) FILTER (flag & 2308 = 0 AND flag & 9 = 1) // 2 AS pairs_examined,
  count(*) FILTER (flag & 4 = 0 AND flag & 2304 <> 0) AS secondary_or_supplementary, count(*) FILTER (flag & 4 <> 0) AS unmapped,
  count(*) FILTER (flag & 2308 = 0 AND flag & 9 <> 1 AND flag & 1024 <> 0) AS unpaired_duplicates, count(*) FILTER (flag & 2308 = 0 AND flag & 9 = 1 AND flag & 1024 <> 0) // 2 AS pair_duplicates
  FROM marked GROUP BY 1),
seen AS (SELECT lib AS library, CAST(sum(optical) AS BIGINT) AS optical_duplicates FROM optical GROUP BY lib),
counted AS (SELECT libs.library, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in D.COUNTERS)} FROM libs LEFT JOIN own ON own.library = libs.library LEFT JOIN seen ON seen.library = libs.library)"""
DERIVED = """size0 AS (SELECT *, CAST(pairs_examined - optical_duplicates AS DOUBLE) AS sn, CAST(pairs_examined - pair_duplicates AS DOUBLE) AS sc FROM counted),
size1 AS (SELECT library, sn, sc, CAST(1 AS DOUBLE) AS lo, list_min(list_filter(list_transform(range(2, 61), lambda p: pow(CAST(10 AS DOUBLE), p)), lambda m: sc / (m * sc) - 1 + exp(-sn / (m * sc)) < 0)) AS hi, 0 AS step FROM size0 WHERE sn > sc AND sc > 0),
halved AS (SELECT * FROM size1 UNION ALL SELECT library, sn, sc, CASE WHEN u >= 0 THEN r ELSE lo END, CASE WHEN u <= 0 THEN r ELSE hi END, step + 1 FROM (SELECT *, sc / (r * sc) - 1 + exp(-sn / (r * sc)) AS u FROM (SELECT *, (lo + hi) / 2 AS r FROM halved WHERE step < 40) a) b),
sized AS (SELECT library, CAST(floor(sc * ((lo + hi) / 2)) AS BIGINT) AS library_size FROM halved WHERE step = 40),
derived AS (SELECT counted.*, CASE WHEN unpaired_examined + 2 * pairs_examined = 0 THEN 0 ELSE CAST(unpaired_duplicates + 2 * pair_duplicates AS DOUBLE) / (unpaired_examined + 2 * pairs_examined) END AS percent_duplication, coalesce(library_size, 0) AS library_size FROM counted LEFT JOIN sized ON sized.library = counted.library)"""


def _with(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


QUERIES = {
    "phred_score": lambda s, d: _reads(s, d).select("idx", C.phred_score().alias("score")),
    "unclipped_position": lambda s, d: _reads(s, d).select("idx", C.unclipped_position().cast("int").alias("upos")),
    "add_library": lambda s, d: D.with_library(_reads(s, d), V.read_groups(s)).select("idx", "lb"),
    "duplicate_eligible": lambda s, d: _ends(s, d).select("idx", "pair"),
    "mark_fragments": lambda s, d: D.duplicate_fragments(_ends(s, d)),
    "match_mates": lambda s, d: _mates(s, d).select("qname", F.col("a.idx").alias("left_idx"), F.col("b.idx").alias("right_idx"), "score"),
    "mark_pairs": lambda s, d: D.duplicate_pairs(_mates(s, d)),
    "mark_duplicates": lambda s, d: _marked(s, d)[1].select("idx", "flag"),
    "tile_info": lambda s, d: _reads(s, d).select("idx", C.tile_info().alias("t")).select("idx", "t.*"),
    "optical_duplicates": lambda s, d: _optical(s, d),
    "dup_histogram": _histogram,
    "dup_counters": _counters,
    "merge_metrics": _merged,
    "library_size": lambda s, d: D.derived(_counters(s, d)).select("library", F.round("percent_duplication", 9).alias("percent_duplication"), "library_size"),
    "return_on_investment": lambda s, d: D.return_on_investment(D.derived(_counters(s, d))).select("library", "x", F.round("roi", 6).alias("roi")),
}
SQL = {
    "phred_score": _with(f"SELECT idx, CAST({SCORE} AS BIGINT) AS score FROM r", f"r AS ({V.reads_sql()})"),
    "unclipped_position": _with("SELECT idx, upos FROM r", f"r AS ({V.reads_sql()})"),
    "add_library": _with("SELECT idx, lb_of AS lb FROM r JOIN rgs ON rg = id", f"r AS ({V.reads_sql()})", V.GROUPS_SQL),
    "duplicate_eligible": _with("SELECT idx, tp AS pair FROM e", STEPS),
    "mark_fragments": _with("SELECT idx FROM df", STEPS),
    "match_mates": _with("SELECT qname, i1 AS left_idx, i2 AS right_idx, score FROM p", STEPS),
    "mark_pairs": _with("SELECT idx FROM dp", STEPS),
    "mark_duplicates": _with("SELECT idx, flag FROM marked", STEPS),
    "tile_info": _with("SELECT idx, CAST(split_part(qname, ':', 5) AS INT) AS tile, CAST(split_part(qname, ':', 6) AS INT) AS x, CAST(split_part(qname, ':', 7) AS INT) AS y FROM r", f"r AS ({V.reads_sql()})"),
    "optical_duplicates": _with("SELECT lib, origin, optical FROM optical", STEPS, TILES, REACH),
    "dup_histogram": _with("""SELECT library, CAST(set_size AS BIGINT) AS set_size, count(*) FILTER (kind = 'all') AS all_sets, count(*) FILTER (kind = 'non') AS non_optical_sets, count(*) FILTER (kind = 'opt') AS optical_sets FROM (
 SELECT lib AS library, 'all' AS kind, n AS set_size FROM g UNION ALL SELECT lib, 'non', n - o FROM g UNION ALL SELECT lib, 'opt', o + 1 FROM g WHERE o > 0) z WHERE set_size > 0 GROUP BY library, set_size""",
        STEPS, TILES, REACH, "g AS (SELECT pr.lib, pr.origin, count(*) AS n, coalesce(max(optical), 0) AS o FROM pr LEFT JOIN optical ON optical.origin = pr.origin GROUP BY pr.lib, pr.origin)"),
    "dup_counters": _with("SELECT * FROM counted", STEPS, TILES, REACH, COUNTS),
    "merge_metrics": _with("SELECT library, " + ", ".join(f"2 * {c} AS {c}" for c in D.COUNTERS) + " FROM counted", STEPS, TILES, REACH, COUNTS),
    "library_size": _with("SELECT library, round(percent_duplication, 9) AS percent_duplication, library_size FROM derived", STEPS, TILES, REACH, COUNTS, DERIVED),
    "return_on_investment": _with("SELECT library, CAST(x AS INT) AS x, round(CAST(library_size AS DOUBLE) * (1 - exp(-CAST(x * pairs_examined AS DOUBLE) / CAST(library_size AS DOUBLE))) / CAST(pairs_examined - pair_duplicates AS DOUBLE), 6) AS roi FROM derived CROSS JOIN (SELECT unnest(range(1, 101)) AS x) z WHERE library_size > 0", STEPS, TILES, REACH, COUNTS, DERIVED),
}
