"""Best-fit packing by a plan over the histogram of lengths.

Pieces are counted by length; best fit, longest first, runs over the counts, so that its work depends on the capacity and not on the number
of documents. Its plan says which ranks of a length go to which sequences at which offset; pieces take these slots by their
rank within their length. Ranks are counted within salted groups and shifted by the counts of the salts before, so no length,
however common, meets in one task."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import documents, in_arrow, planned_bytes, slices, stored, tasks, width
from helixframe.llm.subwords import encoder

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, offset): from the first rank on, so many pieces of the length go to consecutive sequences, to
    the same offset in each.

    counts: pieces by length, 1 to capacity. Best fit decreasing over counts: pieces of a length fill the open sequences with
    the least room that takes them, group by group of sequences filled alike, before new ones are opened."""
    out: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    rooms: list[int] = []
    sequences = 0

    def add(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # new sequences, each of which takes as many of this length as it can
                each = capacity // length
                full, rest = divmod(left, each)
                for j in range(each if full else 0):
                    out.append((length, rank, full, sequences, j * length))
                    rank += full
                for j in range(rest):
                    out.append((length, rank, 1, sequences + full, j * length))
                    rank += 1
                add(capacity - each * length, sequences, full)
                if rest:
                    add(capacity - rest * length, sequences + full, 1)
                sequences, left = sequences + full + bool(rest), 0
            else:
                space = rooms[at]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    rooms.pop(at)
                take = min(left, n)
                out.append((length, rank, take, first, capacity - space))
                add(space - length, first, take)
                if take < n:
                    add(space, first + take, n - take)
                rank, left = rank + take, left - take
    return out


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of each document: of its ids and the end id; longer ones than the capacity are cut so that all pieces but
    the first are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                rows += [(doc, i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])) for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_arrow(docs.select("doc_id", "text"), run, PIECE)


def _placed(slots: list[tuple[int, int, int, int, int]]):
    ordered = sorted(slots)
    table = np.array(ordered, np.int64).reshape(-1, 5)
    keys = (table[:, 0] << np.int64(44)) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << np.int64(44)) + rank, side="right") - 1
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "piece": b.column("piece"), "start": b.column("start"), "length": pa.array(length), "ids_crc32": b.column("ids_crc32"),
                "sequence_id": pa.array(table[at, 3] + rank - table[at, 1]), "offset": pa.array(table[at, 4]),
            })

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pack doc_id and text of docs into sequences of at most capacity tokens. One row for each piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Rows that share a doc_id, or have none, are packed each for itself. Other columns
    are ignored; no rows give no rows. What reaches the driver is a count for each length, capacity of them at most, and the
    plan has fewer entries than capacity squared, whatever the number of documents."""
    spark = docs.sparkSession
    salts = 4 * width(spark)
    pieces = stored(cut(docs, tokenizer, end_id, capacity), "pieces", planned_bytes(docs)).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    totals = {length: n for length, n in counts.groupBy("length").agg(F.sum("n")).collect()}
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("within", rank).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    few = ranked.coalesce(tasks(spark, planned_bytes(docs)))
    return in_arrow(few.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _placed(plan(totals, capacity)), out)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)
