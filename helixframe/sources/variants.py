"""VCF, BED and site lists: text in columns, parsed by Catalyst."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.intervals import sites as ordered_sites

SITES_LINE = "# elsites format version 1.0"
TYPES = {"Integer": "int", "Float": "double", "Flag": "boolean", "Character": "string", "String": "string"}


@dataclass
class VcfHeader:
    version: str = "VCFv4.2"
    meta: list[str] = field(default_factory=list)
    info: dict[str, tuple[str, str]] = field(default_factory=dict)  # name: (number, type)
    format: dict[str, tuple[str, str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)


def vcf_header(spark: SparkSession, path: str) -> VcfHeader:
    out, rows = VcfHeader(), spark.read.text(path).where(F.col("value").startswith("#")).select("value", F.monotonically_increasing_id().alias("n")).orderBy("n").collect()
    for line in (r.value for r in rows):
        if line.startswith("##fileformat="):
            out.version = line.split("=", 1)[1]
        elif line.startswith("##"):
            out.meta.append(line[2:])
            kind, _, rest = line[2:].partition("=<")
            if kind in ("INFO", "FORMAT"):
                parts = dict(p.split("=", 1) for p in rest.rstrip(">").split(",")[:3] if "=" in p)
                getattr(out, kind.lower())[parts["ID"]] = (parts.get("Number", "."), parts.get("Type", "String"))
        else:
            out.samples = line.split("\t")[9:]
    return out


def _none(c: Column) -> Column:
    return F.when(c != ".", c)


def _listed(c: Column, by: str) -> Column:
    return F.when(c.isNull() | (c == "."), F.array().cast("array<string>")).otherwise(F.split(c, by))


def read_vcf(spark: SparkSession, path: str, genotypes: bool = True) -> DataFrame:
    """Rows of schema.VARIANT. INFO is a map (flags map to an empty text). Without genotypes, sample columns aren't looked at. Compressed files (.gz) are read too."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    info = F.map_from_entries(F.transform(_listed(at(7), ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), x.substr(F.length(F.substring_index(x, "=", 1)) + 2, F.length(x))).otherwise("").alias("v"))))
    keys = F.when(F.size(f) > 8, F.split(at(8), ":")).otherwise(F.array().cast("array<string>"))

    def one(sample: Column) -> Column:
        data = F.map_from_arrays(F.slice(keys, F.lit(1), F.size(F.split(sample, ":"))), F.split(sample, ":"))
        gt = F.try_element_at(data, F.lit("GT"))
        alleles = F.transform(F.split(F.coalesce(gt, F.lit(".")), "[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))
        return F.struct(F.coalesce(gt.contains("|"), F.lit(False)).alias("phased"), F.when(gt.isNotNull(), alleles).alias("gt"), F.map_filter(data, lambda k, v: k != "GT").alias("data"))

    samples = F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))), one) if genotypes else F.array().cast("array<struct<phased:boolean,gt:array<int>,data:map<string,string>>>")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    return lines.select(at(0).alias("chrom"), at(1).cast("int").alias("pos"), _listed(at(2), ";").alias("id"), at(3).alias("ref"), _listed(at(4), ",").alias("alt"), _none(at(5)).cast("double").alias("qual"), _listed(at(6), ";").alias("filter"), info.alias("info"), keys.alias("format"), samples.alias("genotypes"))


def typed(variants: DataFrame, head: VcfHeader, names: list[str]) -> DataFrame:
    """variants with columns of INFO entries, by the types that the header gives them: one value, a list, or whether a flag is there."""
    def value(name: str) -> Column:
        number, kind = head.info.get(name, (".", "String"))
        v, t = F.try_element_at("info", F.lit(name)), TYPES.get(kind, "string")
        return v.isNotNull() if kind == "Flag" else v.try_cast(t) if number in ("1", "0") else F.transform(F.split(v, ","), lambda x: x.try_cast(t))

    return variants.select("*", *[value(n).alias(n) for n in names])


def number_text(x: Column) -> Column:
    """QUAL: two decimals, without .00."""
    return F.when(x.isNull(), ".").otherwise(F.regexp_replace(F.format_string("%.2f", x), r"\.00$", ""))


def float_text(x: Column) -> Column:
    """Numbers in INFO and FORMAT: three digits with an exponent below 0.01, three decimals below 1, else two."""
    return F.when(x < 0.01, F.format_string("%.3e", x)).when(x < 1, F.format_string("%.3f", x)).otherwise(F.format_string("%.2f", x))


def vcf_lines(variants: DataFrame) -> DataFrame:
    joined = lambda c, by: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, ".").otherwise(F.array_join(c, by))
    info = F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"])))

    def sample(g: Column) -> Column:
        numbers = F.transform(g["gt"], lambda a: F.when(a < 0, ".").otherwise(a.cast("string")))
        alleles = F.when(g["phased"], F.array_join(numbers, "|")).otherwise(F.array_join(numbers, "/"))
        return F.array_join(F.transform(F.col("format"), lambda k: F.when(k == "GT", alleles).otherwise(F.coalesce(F.try_element_at(g["data"], k), F.lit(".")))), ":")

    fixed = F.array(F.col("chrom"), F.col("pos").cast("string"), joined("id", ";"), F.col("ref"), joined("alt", ","), number_text(F.col("qual")), joined("filter", ";"), joined(info, ";"))
    rest = F.when(F.size("format") > 0, F.concat(F.array(F.array_join("format", ":")), F.transform("genotypes", sample))).otherwise(F.array().cast("array<string>"))
    return variants.select(F.concat_ws("\t", fixed, rest).alias("value"))


def write_vcf(variants: DataFrame, head: VcfHeader, path: str) -> None:
    spark = variants.sparkSession
    vcf_lines(variants).write.mode("overwrite").text(path)
    columns = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *head.samples] if head.samples else [])]
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-header")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(bytearray("".join([f"##fileformat={head.version}\n", *(f"##{m}\n" for m in head.meta), "#" + "\t".join(columns) + "\n"]).encode()))
    out.close()


def concatenated(parts: list[DataFrame], dictionary: DataFrame) -> DataFrame:
    """Variants of several files in the order of the contigs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    ranks = dictionary.select(F.col("sn").alias("chrom"), F.col("refid").alias("__rank"))
    return out.join(F.broadcast(ranks), "chrom", "left").orderBy(F.col("__rank").asc_nulls_last(), "pos").drop("__rank")  # one row for each contig


BED_COLUMNS = ["chrom string", "start int", "end int", "name string", "score int", "strand string", "thickStart int", "thickEnd int", "itemRgb string", "blockCount int", "blockSizes string", "blockStarts string"]


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of schema.BED; columns that a line hasn't got are null. Comments, track and browser lines are skipped; a score is 0 to 1000, a strand + or -."""
    f = F.split("value", "[\t ]+")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)"))
    rows = lines.select(*[F.get(f, F.lit(i)).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(BED_COLUMNS)])
    bad = (F.col("end").isNull() | F.col("start").isNull()) | ~F.coalesce(F.col("score"), F.lit(0)).between(0, 1000) | ~F.coalesce(F.col("strand"), F.lit("+")).isin("+", "-", ".")
    return rows.withColumn("chrom", F.when(bad, F.raise_error(F.concat(F.lit("not a BED line: "), F.coalesce("chrom", F.lit("?"))))).otherwise(F.col("chrom")))


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return lines.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("int").alias("start"), F.get(f, F.lit(2)).cast("int").alias("end"))


def write_sites(intervals: DataFrame, path: str) -> None:
    """Flattened and sorted, with the format's first line in each file."""
    rows = ordered_sites(intervals)
    rows.select(F.concat_ws("\t", "chrom", "start", "end").alias("value")).write.mode("overwrite").text(path)
    spark = intervals.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part-00000-header")
    out = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(jpath, True)
    out.write(bytearray((SITES_LINE + "\n").encode()))
    out.close()
