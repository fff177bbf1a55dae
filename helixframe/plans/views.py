"""Aligned reads, sites, regions and a reference, derived from the driver's tables by whole-number arithmetic.

READS is text that Spark and DuckDB both run. Each order is one template with one or two mates of 50 bases; where a read starts without
its clip (upos) is known in closed form, so the operators' own CIGAR arithmetic is tested against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.columns import bound

LENGTH = 50
CONTIGS = [(i, f"chr{i + 1}", 5300 + 40 * i) for i in range(4)]

READS = """
SELECT CAST(k * 2 + m AS BIGINT) AS idx, k, CAST(m AS INT) AS m, CAST(c AS INT) AS c, CAST(b AS BIGINT) AS b,
 'I'||k||':1:FC:1:'||(1101 + g % 3)||':'||((u*13) % 160)||':'||((u*29) % 160) AS qname,
 CAST(pr + 4*unm + 16*rev + 32*pr*(1-rev) + 64*pr*(1-m) + 128*pr*m + 256*sec + 512*qcf + 8*pr*mun AS INT) AS flag,
 'chr'||(1 + g % 4) AS rname, CAST(g % 4 AS INT) AS refid,
 CAST(CASE WHEN rev=1 THEN b ELSE b+c END AS INT) AS pos, CAST(u % 61 AS INT) AS mapq,
 CASE WHEN c=0 THEN '50M' WHEN rev=1 THEN (50-c)||'M'||c||'S' ELSE c||'S'||(50-c)||'M' END AS cigar,
 CASE WHEN pr=1 THEN '=' ELSE '*' END AS rnext,
 CAST(CASE WHEN pr=0 THEN 0 WHEN rev=1 THEN b + 200*(1-2*m) + c ELSE b + 200*(1-2*m) END AS INT) AS pnext,
 CAST(CASE WHEN pr=0 THEN 0 WHEN m=0 THEN 250 ELSE -250 END AS INT) AS tlen,
 CAST(CASE WHEN rev=1 THEN b+49 ELSE b END AS INT) AS upos, CAST(rev AS INT) AS rev, lb, 'rg'||(g%3) AS rg,
 CAST(1 + CASE WHEN u%7=0 THEN 1 ELSE 0 END AS INT) AS x0, CASE WHEN u%13=0 THEN NULL ELSE CAST(CASE WHEN u%5=0 THEN 1 ELSE 0 END AS INT) END AS x1,
 CAST(CASE WHEN u%3=0 THEN 1 ELSE 0 END AS INT) AS xm, CAST(CASE WHEN k%50=0 THEN 1 ELSE 0 END AS INT) AS is_sr
FROM (SELECT k, m, g, u, u % 4 AS c, 1+(g*37)%5000 + m*200 AS b,
   CASE WHEN m=0 THEN g%2 ELSE 1-g%2 END AS rev, CASE WHEN k%5=0 THEN 0 ELSE 1 END AS pr,
   CASE WHEN (u+m)%23=0 THEN 1 ELSE 0 END AS unm, CASE WHEN (u+1-m)%23=0 THEN 1 ELSE 0 END AS mun,
   CASE WHEN u%29=0 AND m=1 THEN 1 ELSE 0 END AS sec, CASE WHEN u%31=0 THEN 1 ELSE 0 END AS qcf,
   CASE WHEN g%7=0 THEN NULL ELSE 'lib'||(g%3) END AS lb
  FROM (SELECT o_orderkey AS k, (o_orderkey*7919)%8009 AS g, (o_orderkey*104729)%10007 AS u FROM {orders}) o
  CROSS JOIN (VALUES (0),(1)) AS t(m)) x
WHERE pr=1 OR m=0
"""

#: Intervals with 0-based starts, one of each event, spread over {spread} positions; the contigs' own 5300 are a part of these, so that not all of them is
#: covered.
SITES = """
SELECT 'chr'||(1 + event_id % 4) AS chrom, CAST((event_id*131) % {spread} AS INT) AS start, CAST((event_id*131) % {spread} + 1 + event_id % 12 AS INT) AS "end"
FROM {events}
"""

QUAL_SQL = "list_transform(range(0, 50), lambda i: CAST((k*31 + i*17 + m*7) % 42 AS INT))"


def _code(p: str, refid: str) -> str:
    """The reference's base at p (0 to 3)."""
    return f"(({p})*({p})*3 + ({p})*7 + 11*({refid})) % 4"


def reads_sql(table: str = "orders") -> str:
    return READS.replace("{orders}", table)


def sites_sql(spread: int = 27_000, table: str = "events") -> str:
    return SITES.replace("{events}", table).replace("{spread}", str(spread))


#: For DuckDB: a row for each base of each read, with its place i, quality q, base code and the reference's.
BASES_SQL = f"""
bases AS (SELECT *, CASE WHEN soft THEN (k+i) % 4 ELSE ({_code('p', 'refid')} + CASE WHEN mut THEN 1 ELSE 0 END) % 4 END AS base, {_code('p', 'refid')} AS refbase
 FROM (SELECT r.*, i, CAST((k*31 + i*17 + m*7) % 42 AS INT) AS q, r.b + i AS p, (k*5 + i*3 + m) % 37 = 0 AS mut, CASE WHEN rev=1 THEN i >= 50 - c ELSE i < c END AS soft
  FROM r CROSS JOIN (SELECT unnest(range(0, 50)) AS i) t) y)"""


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(rows: DataFrame, rows_per_task: int = 20_000, most_rows: int = 250_000) -> DataFrame:
    """rows (few narrow columns) dealt to as many tasks as they are worth: a file is read by no more tasks than it has row groups, which may be one, and what is made
    of a row here is far larger than the row. Tasks grow up to most_rows once there are eight for each core."""
    n = rows.count()
    tasks = max(1, min(-(-n // rows_per_task), max(8 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // most_rows))))
    return (rows.repartition(tasks, *rows.columns) if tasks > 1 else rows).select(*[fenced(F.col(c)).alias(c) for c in rows.columns])


def fenced(c: Column) -> Column:
    """c, of whole numbers: no filter on it is pushed below its projection, where it would run in as few tasks as the file has, and what it is made of isn't inlined in lambdas, which are
    not compiled. Nor is a projection with a lambda compiled together with what comes before and after it into one method, too long for the JVM to compile any further."""
    return bound(c, lambda x: x) + F.monotonically_increasing_id() * 0


def narrow_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's columns."""
    return spark.sql(READS, orders=dealt(load(spark, sf_dir, "orders").select("o_orderkey")))


def _table(values: list) -> Column:
    """A list as one literal: it is folded from a single text, as thousands of literals would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def _qualities(r: Column, modulus: int, inverse: int, least: int = 0) -> Column:
    """least + (r + 17 i) % modulus for the bases i of a read: a slice of the multiples of 17, as inverse * 17 is 1 modulo modulus."""
    return F.slice(_table([least + j * 17 % modulus for j in range(modulus + LENGTH)]).cast("array<int>"), (r * inverse % modulus).cast("int") + 1, F.lit(LENGTH))


def _letters(refid: int, b: int, w: int) -> str:
    """The bases of an unclipped read at b (all that counts is b modulo 4); w: (5 k + m) modulo 37, of which the read's mismatches depend."""
    return "".join("ACGT"[(p * p * 3 + p * 7 + 11 * refid + ((w + i * 3) % 37 == 0)) % 4] for i in range(LENGTH) for p in [b + i])


def _fenced() -> list[Column | str]:
    return [fenced(F.col("idx")).alias("idx"), "qname", fenced(F.col("flag")).cast("int").alias("flag"), "rname", fenced(F.col("pos")).cast("int").alias("pos")]


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of schema.READ, and a few columns of the view (k, m, lb, rg, refid, upos). What repeats is looked up in tables of literals, which costs less than a lambda
    for each base."""
    r = narrow_reads(spark, sf_dir)
    k, m, c = F.col("k"), F.col("m"), F.col("c")
    qual = _qualities(k * 31 + m * 7, 42, 5)
    table = _table([_letters(i, b, w) for i in range(len(CONTIGS)) for b in range(4) for w in range(37)])
    main = F.get(table, ((F.col("refid") * 4 + F.col("b") % 4) * 37 + (k * 5 + m) % 37).cast("int"))
    soft = F.get(_table(["".join("ACGT"[(j + i) % 4] for i in range(LENGTH)) for j in range(4)]), (k % 4).cast("int"))
    n = F.lit(LENGTH)
    seq = F.when(c == 0, main).when(F.col("rev") == 1, F.concat(main.substr(F.lit(1), n - c), soft.substr(n - c + 1, c))).otherwise(F.concat(soft.substr(F.lit(1), c), main.substr(c + 1, n - c)))

    pair = lambda k, t, v: F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), v.cast("string").alias("v"))
    none = F.array().cast("array<struct<k:string,t:string,v:string>>")
    tags = F.concat(
        F.array(pair("RG", "Z", F.col("rg")), pair("X0", "i", F.col("x0"))), F.when(F.col("x1").isNotNull(), F.array(pair("X1", "i", F.col("x1")))).otherwise(none),
        F.array(pair("XM", "i", F.col("xm")), pair("XO", "i", F.lit(0)), pair("XG", "i", F.lit(0))), F.when(F.col("is_sr") == 1, F.array(pair("sr", "i", F.lit(1)))).otherwise(none))
    return r.select(*_fenced(), "mapq", "cigar", "rnext", "pnext", "tlen", seq.alias("seq"), qual.alias("qual"), tags.alias("tags"), "k", "m", "lb", "rg", "refid", "upos")


#: One position in 211 varies: in every template where the position is 1 modulo 3, else in those with an even key.
PLANTED = "({p}) % 211 = 100 AND (({p}) % 3 = 1 OR ({k}) % 2 = 0)"


def _mixed(p):
    """A base code without repeats, unlike the plain one, which has a period of four bases: what assembly needs."""
    return ((p * p * 31 + p * 7919 + F.col("refid") * 1013) % 10007) % 4


def mixed_sql(p: str, refid: str = "refid") -> str:
    return f"((({p})*({p})*31 + ({p})*7919 + {refid}*1013) % 10007) % 4"


def planted_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reads with good qualities and the reference's bases but for planted alternatives (the next letter)."""
    r = narrow_reads(spark, sf_dir)

    def strand(refid: int, even: bool) -> str:
        """All positions that reads cover, with what templates of even or odd key carry."""
        return "".join("ACGT"[(((p * p * 31 + p * 7919 + refid * 1013) % 10007) % 4 + (p % 211 == 100 and (p % 3 == 1 or even))) % 4] for p in range(1, 5200 + LENGTH))

    strands = _table([strand(i, even) for i in range(len(CONTIGS)) for even in (True, False)])
    seq = F.get(strands, (F.col("refid") * 2 + F.col("k") % 2).cast("int")).substr(F.col("b").cast("int"), F.lit(LENGTH))
    qual = _qualities(F.col("k") * 31 + F.col("m") * 7, 11, 2, 30)
    tags = F.array(F.struct(F.lit("RG").alias("k"), F.lit("Z").alias("t"), F.col("rg").alias("v")))
    return r.where("is_sr = 0").select(*_fenced(), F.lit(60).alias("mapq"), "cigar", "rnext", "pnext", "tlen", seq.alias("seq"), qual.alias("qual"), tags.alias("tags"))


def sites(spark: SparkSession, sf_dir: str, spread: int = 27_000) -> DataFrame:
    """chrom, start, end."""
    return spark.sql(SITES.replace('"end"', "`end`").replace("{spread}", str(spread)), events=dealt(load(spark, sf_dir, "events").select("event_id"), 200_000, 5_000_000))


def dictionary(spark: SparkSession) -> DataFrame:
    """The sequence dictionary: refid, sn, ln."""
    return spark.createDataFrame(CONTIGS, "refid int, sn string, ln int")


DICTIONARY_SQL = "sq AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {x})" for i, n, x in CONTIGS) + ") t(refid, sn, ln))"


def read_groups(spark: SparkSession) -> DataFrame:
    """The header's read groups: id, lb, pu, sm. The last has no platform unit."""
    return spark.createDataFrame([("rg0", "lib0", "unit0", "one"), ("rg1", "lib1", "unit1", "one"), ("rg2", "lib2", None, "two")], "id string, lb string, pu string, sm string")


GROUPS_SQL = "rgs AS (SELECT * FROM (VALUES ('rg0', 'lib0', 'unit0', 'one'), ('rg1', 'lib1', 'unit1', 'one'), ('rg2', 'lib2', NULL, 'two')) t(id, lb_of, pu, sm))"


def reference(spark: SparkSession, chunk: int = 1000, mixed: bool = False) -> DataFrame:
    """contig, chunk (from 0), bases: the reference in chunks of equal length (but for a contig's last)."""
    one = dictionary(spark).select("refid", F.col("sn").alias("contig"), "ln", F.explode(F.sequence(F.lit(0), F.floor((F.col("ln") - 1) / chunk).cast("int"))).alias("chunk"))
    p = F.sequence(F.col("chunk") * chunk + 1, F.least(F.col("ln"), (F.col("chunk") + 1) * chunk))
    return one.select("contig", "chunk", F.array_join(F.transform(p, lambda p: F.lit("ACGT").substr((_mixed(p.cast("long")) if mixed else (p.cast("long") * p * 3 + p * 7 + 11 * F.col("refid")) % 4).cast("int") + 1, F.lit(1))), "").alias("bases"))
