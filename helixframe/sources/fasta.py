"""References: FASTA with an index, read by ranges into chunks; kept as Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.files import opened

INDEX = "contig string, length long, offset long, bases int, width int"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The five columns of an index file."""
    return spark.read.csv(path, sep="\t", schema=INDEX)


def make_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """Of a FASTA file that has none; reads it once, line by line."""
    out: list[list] = []
    system, p = opened(path)
    with system.open_input_stream(p) as f:
        at, rest = 0, b""
        while True:
            part = f.read(1 << 22)
            lines = (rest + part).split(b"\n")
            rest = lines.pop()
            if not part and rest:
                lines, rest = [rest], b""
            for line in lines:
                n = len(line) + 1
                if line.startswith(b">"):
                    out.append([line[1:].split()[0].decode(), 0, at + n, 0, 0])
                elif out and line.rstrip(b"\r"):
                    bases = len(line.rstrip(b"\r"))
                    out[-1][1] += bases
                    if not out[-1][3]:
                        out[-1][3:] = [bases, n]
                at += n
            if not part:
                return [tuple(r) for r in out]


def cleaned(bases, upper: bool = True, plain: bool = True):
    """Column of bases in upper case, with letters that stand for several bases as N."""
    out = F.upper(bases) if upper else bases
    return F.regexp_replace(out, "[^ACGTNacgtn]", "N") if plain else out


def read(spark: SparkSession, path: str, index: list[tuple[str, int, int, int, int]] | None = None, chunk: int = 64_000, upper: bool = True, plain: bool = True) -> DataFrame:
    """contig, chunk (from 0), bases. Each task reads the bytes of its chunks only."""
    rows = [(c, k, n, off, b, w) for c, n, off, b, w in (index or make_index(path)) for k in range(max(1, -(-n // chunk)))]
    plan = spark.createDataFrame(rows, "contig string, chunk int, length long, offset long, per int, width int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, p = opened(path)
        with system.open_input_file(p) as f:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    first, last = r["chunk"] * chunk, min(r["length"], (r["chunk"] + 1) * chunk)
                    place = lambda i, r=r: r["offset"] + i // r["per"] * r["width"] + i % r["per"] if r["per"] else r["offset"]
                    f.seek(place(first))
                    data = f.read(place(last) - place(first))
                    out.append(data.replace(b"\n", b"").replace(b"\r", b"").decode())
                yield pa.RecordBatch.from_pydict({"contig": b.column("contig"), "chunk": b.column("chunk"), "bases": pa.array(out, pa.string())})

    chunks = plan.repartition(max(1, min(len(rows), 1000)), "contig", "chunk").mapInArrow(run, "contig string, chunk int, bases string")
    return chunks.withColumn("bases", cleaned(F.col("bases"), upper, plain))


def write_parquet(reference: DataFrame, path: str) -> None:
    """The form in which a reference is kept: sorted chunks, so that a contig's range is read alone."""
    reference.repartitionByRange("contig", "chunk").sortWithinPartitions("contig", "chunk").write.mode("overwrite").parquet(path)


def open_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("contig string, chunk int, bases string").parquet(path)


def sequence(reference: DataFrame, contig: str, start: int, end: int, chunk: int) -> DataFrame:
    """One row with the bases from start to end (from 1, both inside); only the chunks that are touched are read."""
    first, last = (start - 1) // chunk, (end - 1) // chunk
    rows = reference.where((F.col("contig") == contig) & F.col("chunk").between(first, last))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "bases"))), lambda x: x["bases"]), "")
    return rows.agg(joined.alias("b")).select(F.substring("b", F.lit(start - first * chunk), F.lit(end - start + 1)).alias("bases"))
