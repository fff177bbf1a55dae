"""Token ids in binary shards with a minimal perfect hash index.

A shard is one row of a Parquet table in a folder that all executors share: a header (part, seq, start within its part,
n_ids, first_key, last_key), the raw payload (ids as little-endian unsigned 32-bit integers, documents one after the other in
ascending order of their key) and an index. The index is a minimal perfect hash of the shard's document keys: levels of bit
arrays, each of which takes the keys that fell alone on their bit, and the rest goes to the next level; a key's slot is the
number of set bits before its own. A slot holds the key's fingerprint, by which foreign keys are refused, and the place and length
of its ids. So keyed access costs a few bit tests and reads nothing else.

Nulls: a null text is an empty document (its end id only); a null doc_id is a key of its own, before all others. Rows that
share a doc_id are separate documents, in the order of their texts; the n-th of them has the key (doc_id, n)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import documents, in_arrow, shared_folder, ship, slices
from helixframe.llm.subwords import encoder

#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
SHARD = "part int, seq int, start long, n_ids long, n_keys int, first_key long, last_key long, keys binary, levels binary, slots binary, payload binary"
SLOT = np.dtype([("fingerprint", "<u4"), ("length", "<u4"), ("place", "<u8")])
KEY = np.dtype([("doc_id", "<i8"), ("nth", "<u4"), ("null", "<u4")])
GAMMA = 1.7


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-mixed bits of each key."""
    with np.errstate(over="ignore"):
        x = keys["doc_id"].astype("u8") + np.uint64(0x9E3779B97F4A7C15) * (keys["nth"].astype("u8") * np.uint64(2) + keys["null"] + np.uint64(977 * seed + 1))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (one byte a bit until they are packed) for distinct keys."""
    levels = []
    while len(keys):
        at = (mixed(keys, len(levels)) % np.uint64(size := max(8, int(GAMMA * len(keys))))).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


def slots_of(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for some foreign keys."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        at = (mixed(keys[left], i) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits) - 1
        out[left] = np.where(bits[at], before + rank[at], -1)
        left, before = left[~bits[at]], before + int(bits.sum())
    return out


def packed(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *map(len, levels)], "<u4").tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


def unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    sizes, at, out = np.frombuffer(data, "<u4", n, 4).tolist(), 4 + 4 * n, []
    for size in sizes:
        out.append(np.unpackbits(np.frombuffer(data, "u1", -(-size // 8), at), count=size).astype(bool))
        at += -(-size // 8)
    return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def lookup(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) in the shard's payload, in ids, of each key; -1 for keys that the shard hasn't got."""
    slot = slots_of(unpacked(shard["levels"]), keys)
    table = np.frombuffer(shard["slots"], SLOT)
    if not len(table):
        return np.full(len(keys), -1), np.full(len(keys), -1)
    got = table[np.maximum(slot, 0)]
    known = (slot >= 0) & (got["fingerprint"] == fingerprints(keys))
    return np.where(known, got["place"].astype(np.int64), -1), np.where(known, got["length"].astype(np.int64), -1)


def _writer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        end, last, nth, start, seq = np.array([end_id], "<u4").tobytes(), object(), 0, 0, 0
        keys: list[tuple[int, int, int]] = []
        parts: list[bytes] = []
        n = 0

        def shard() -> pa.RecordBatch:
            k, lengths = np.array(keys, KEY), np.array([len(x) // 4 for x in parts], np.int64)
            levels, slots = build_levels(k), np.zeros(len(k), SLOT)
            slot = slots_of(levels, k)
            slots["fingerprint"][slot], slots["length"][slot], slots["place"][slot] = fingerprints(k), lengths, np.cumsum(lengths) - lengths
            row = {"part": part, "seq": seq, "start": start, "n_ids": n, "n_keys": len(k), "first_key": None if keys[0][2] else keys[0][0], "last_key": None if keys[-1][2] else keys[-1][0], "keys": k.tobytes(), "levels": packed(levels), "slots": slots.tobytes(), "payload": b"".join(parts)}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for b in slices(batches):
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                nth, last = (nth + 1 if doc == last else 0), doc
                keys.append((doc or 0, nth, int(doc is None)))
                parts.append(ids + end)
                n += len(parts[-1]) // 4
                if n >= SHARD_IDS:
                    yield shard()
                    start, seq, n = start + n, seq + 1, 0
                    keys.clear()
                    parts.clear()
        if keys:
            yield shard()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write doc_id and text of docs as shards to the folder path. Rows are dealt by ranges of doc_id, so part and seq give the order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    in_arrow(ordered, _writer(tokenizer, end_id), SHARD).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards, with base: the ids in all parts before. One row for each part is gathered to sum them up, as many as the
    writing job had tasks."""
    shards = spark.read.schema(SHARD).parquet(path)
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    return shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard in b.to_pylist():
            keys, payload = np.frombuffer(shard["keys"], KEY), memoryview(shard["payload"])
            place, length = lookup(shard, keys)
            crcs = [zlib.crc32(payload[4 * p : 4 * (p + n)]) for p, n in zip(place.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": pa.array(keys["doc_id"], pa.int64(), mask=keys["null"] > 0), "start": pa.array(shard["base"] + shard["start"] + place, pa.int64()),
                "n_tokens": pa.array(length, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()),
            })


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, fetched by its key through each shard's index."""
    return in_arrow(read_shards(spark, path), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _fetch(left: pa.Table, right: pa.Table) -> pa.Table:
    asked = np.zeros(left.num_rows, KEY)
    asked["doc_id"] = left.column("doc_id").to_numpy()
    out: dict[int, list] = {}
    for shard in right.to_pylist():
        place, length = lookup(shard, asked)
        ids = np.frombuffer(shard["payload"], "<u4")
        for d, p, n in zip(asked["doc_id"].tolist(), place.tolist(), length.tolist(), strict=True):
            if p >= 0:
                out[d] = ids[p : p + n].astype(np.int64).tolist()
    return pa.table({"doc_id": pa.array(list(out), pa.int64()), "ids": pa.array(list(out.values()), pa.list_(pa.int64()))})


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Keyed access: doc_id and ids of each wanted doc_id (the first document of that id). Keys are routed by the shards' ranges, and
    only shards that are asked for are opened."""
    ship(spark)
    ranges = spark.read.schema(SHARD).parquet(path).select(F.struct("part", "seq").alias("shard"), "first_key", "last_key")
    keys = wanted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    routed = keys.join(ranges, F.col("doc_id").between(F.coalesce("first_key", F.lit(-(1 << 63))), F.coalesce("last_key", F.lit(-(1 << 63))))).select("shard", "doc_id")
    asked = routed.select(F.col("shard").alias("opened")).distinct()
    opened = spark.read.schema(SHARD).parquet(path).select(F.struct("part", "seq").alias("opened"), "levels", "slots", "payload").join(asked, "opened", "left_semi")
    return routed.groupBy("shard").cogroup(opened.groupBy("opened")).applyInArrow(_fetch, "doc_id long, ids array<long>")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "shards")
    write_shards(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    return digests(spark, path)
