"""The rows that this library works on, and the flag bits of a read.

A read's place in its file is a column (idx), because rows of a DataFrame have no order. Tags keep their order in a file, so they
are a list; tag() picks one. What a header says is a small DataFrame or a plain value, never state."""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.StringType()), T.StructField("v", T.StringType())])
READ = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("qname", T.StringType()), T.StructField("flag", T.IntegerType()),
    T.StructField("rname", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("mapq", T.IntegerType()),
    T.StructField("cigar", T.StringType()), T.StructField("rnext", T.StringType()), T.StructField("pnext", T.IntegerType()),
    T.StructField("tlen", T.IntegerType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.ArrayType(T.IntegerType())),
    T.StructField("tags", T.ArrayType(TAG)),
])
BED = "chrom string, start int, end int, name string, score int, strand string, thickStart int, thickEnd int, itemRgb string, blockCount int, blockSizes string, blockStarts string"
VARIANT = "chrom string, pos int, id array<string>, ref string, alt array<string>, qual double, filter array<string>, info map<string,string>, format array<string>, genotypes array<struct<phased:boolean,gt:array<int>,data:map<string,string>>>"

MULTIPLE, PROPER, UNMAPPED, NEXT_UNMAPPED, REVERSED, NEXT_REVERSED = 1, 2, 4, 8, 16, 32
FIRST, LAST, SECONDARY, QC_FAILED, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 512, 1024, 2048
FLAGS = {
    "multiple": MULTIPLE, "proper": PROPER, "unmapped": UNMAPPED, "next_unmapped": NEXT_UNMAPPED, "reversed": REVERSED, "next_reversed": NEXT_REVERSED,
    "first": FIRST, "last": LAST, "secondary": SECONDARY, "qc_failed": QC_FAILED, "duplicate": DUPLICATE, "supplementary": SUPPLEMENTARY,
}
