"""SAM text: a line is split and cast by Catalyst; nothing is read by Python but the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.sources.headers import Header, parse, text

BASES = "=ACMGRSVTWYHKDBN"


def header(spark: SparkSession, path: str) -> Header:
    """Of a file, or of the first file of a folder by name. Only lines before the first read are gathered."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).where(F.col("value").startswith("@") & F.col("value").rlike(r"^@[A-Za-z]{2}(\t|$)"))
    first = lines.agg(F.min("file")).first()[0]
    return parse([r.value for r in lines.where(F.col("file") == first).orderBy("at", "n").collect()]) if first else Header()


def _tag(field: Column) -> Column:
    return F.struct(F.substring(field, 1, 2).alias("k"), F.substring(field, 4, 1).alias("t"), field.substr(F.lit(6), F.length(field)).alias("v"))


def sequence(letters: Column) -> Column:
    """Upper case; letters that no code stands for are N; null for *."""
    return F.when(letters != "*", F.regexp_replace(F.upper(letters), f"[^{BASES}]", "N"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schema.READ. A missing sequence or quality is null. idx grows with the place in a file."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: at(i).cast("int")
    qual = F.when(at(10) != "*", F.transform(F.split(at(10), ""), lambda c: F.ascii(c) - 33))
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^@[A-Za-z]{2}(\t|$)") & (F.col("value") != ""))
    return lines.select(
        F.monotonically_increasing_id().alias("idx"), at(0).alias("qname"), number(1).alias("flag"), at(2).alias("rname"), number(3).alias("pos"), number(4).alias("mapq"), C.cigar_text(C.merged(C.ops(at(5)))).alias("cigar"),
        at(6).alias("rnext"), number(7).alias("pnext"), number(8).alias("tlen"), sequence(at(9)).alias("seq"), qual.alias("qual"), F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), _tag).alias("tags"))


def lines(reads: DataFrame) -> DataFrame:
    """The text of each read, as column value."""
    letter = lambda q: F.char(q + 33)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<struct<k:string,t:string,v:string>>")), lambda x: F.concat_ws(":", x["k"], x["t"], x["v"]))
    same = F.when((F.col("rnext") == F.col("rname")) & (F.col("rnext") != "*"), "=").otherwise(F.coalesce("rnext", F.lit("*")))
    none = lambda c: F.coalesce(F.col(c), F.lit("*"))
    fixed = [none("qname"), F.col("flag").cast("string"), none("rname"), F.col("pos").cast("string"), F.col("mapq").cast("string"), none("cigar"), same, F.col("pnext").cast("string"), F.col("tlen").cast("string"), none("seq"), F.coalesce(F.array_join(F.transform("qual", letter), ""), F.lit("*"))]
    return reads.select(F.concat_ws("\t", F.array(*fixed), tags).alias("value"))


def write(reads: DataFrame, head: Header, path: str) -> None:
    """A folder of text: the header is a file of its own that comes first by name; part files hold reads in their order."""
    spark = reads.sparkSession
    lines(reads).write.mode("overwrite").text(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-header")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(bytearray(text(head).encode()))
    out.close()
