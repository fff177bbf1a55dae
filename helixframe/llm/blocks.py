"""Finding what repeats across a corpus without moving it more than once.

Documents are dealt into blocks of about BLOCK_BYTES by a hash of their id (so copies spread evenly). A block hashes its windows, keeps each
hash once, and sends them, sorted and difference-coded, to buckets by range of hash. A bucket sees all blocks' sorted lists, counts, and
answers each block with one small array in the order that the block sent. Blocks then join their documents with the answers. The
documents' exchange is the same in every step, and Spark runs it once. A hash that is everywhere is sent once by a block."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import cores, ship, total_bytes, width

BLOCK_BYTES = 2 << 20
SENT = "blk long, bucket int, payload binary"
ANSWER = "blk long, bucket int, answer binary"

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, ODD = np.uint64(0x9E3779B97F4A7C17), np.uint64(0xD6E8FEB86659FD93)
#: Two independent hash functions; where a hash decides alone, both have to agree.
SEED, SEED2 = np.uint64(int(_rng.integers(0, 1 << 63))), np.uint64(int(_rng.integers(0, 1 << 63)))
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Runs of more bytes are hashed one by one, by the library's digest.
LONG = 256
_FIRST = np.array([(1 << (8 * i)) - 1 for i in range(8)], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _careful() -> None:
    """Arrays of 32 MB and more are taken from the system and given back to it, and no more than 64 MB are kept at the heap's end: a worker that has had a
    large group doesn't keep its memory. Those of usual blocks (16 MB) are used again."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):  # another C library
        pass
    pa.set_memory_pool(pa.system_memory_pool())


_careful()


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse, modulo 2 ** 64, for i = 0 .. n."""
    known = _powers.get(int(base))
    if known is None or len(known[0]) <= n:
        size = ((n >> 18) + 1) << 18
        with np.errstate(over="ignore"):
            made = []
            for b in (int(base), pow(int(base), -1, 1 << 64)):
                p = np.ones(size, np.uint64)
                p[1:] = np.uint64(b)
                made.append(np.cumprod(p, dtype=np.uint64, out=p))
        _powers[int(base)] = known = tuple(made)
    return known


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * ODD
        x ^= x >> np.uint64(32)
        x *= ODD
        x ^= x >> np.uint64(32)
    return x


def mix_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    with np.errstate(over="ignore"):
        return mix(a * BASE + (b ^ (b >> np.uint64(29))))


def hash_runs(padded: bytes, start: np.ndarray, end: np.ndarray, seed: np.uint64 = SEED) -> np.ndarray:
    """64 bits of each run of bytes. Eight bytes at a time go in and are mixed, so that no arrangement of letters cancels itself out. padded: the
    buffer and eight bytes more."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    size = end - start
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) + seed)
    at = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        left, x = size[at] - k, eight[start[at] + k]
        tail = left < 8
        x[tail] &= _FIRST[left[tail]]
        out[at] = mix(out[at] ^ x)
    key = int(seed).to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8, key=key).digest(), "<u8")[0]
    return out


def hash_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n values in a row, put together from runs of 1, 2, 4, .. values."""
    out, have, run, size = None, 0, hashes, 1
    while True:
        if n & size:
            out = run if out is None else mix_two(out[: len(out) - size], run[have : have + len(out) - size])
            have += size
        if have == n:
            return out
        run = mix_two(run[:-size], run[size:])
        size *= 2


@dataclass
class Words:
    """The words of several texts: hash of each, byte range in buffer, and the range of words of each text."""

    padded: bytes
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text, and one more

    def windows(self, n: int, seed: np.uint64 | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of n words of one text. seed: of another hash function than the first."""
        if len(self.hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = self.hashes if seed is None else hash_runs(self.padded, self.start, self.end, seed)
        at = np.arange(len(hashes) - n + 1)
        at = at[at + n <= self.first[np.searchsorted(self.first, at, side="right")]]
        return at, hash_windows(hashes, n)[at]


def words_of(texts: list[str | None]) -> Words:
    parts = [(t or "").encode() for t in texts]
    padded = b"\n".join(parts) + b"\n" + bytes(8)
    space = SPACES[np.frombuffer(padded, np.uint8, len(padded) - 8)]
    edges = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edges[0::2], edges[1::2]
    offsets = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return Words(padded, hash_runs(padded, start, end), start, end, np.searchsorted(start, offsets))


def planes(values: np.ndarray) -> bytes:
    """Unsigned whole numbers byte plane by byte plane: high planes are mostly zeros, which shuffle compression removes."""
    wide = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
    return bytes([wide]) + np.ascontiguousarray(raw.T).tobytes()


def unplanes(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    """The n numbers, in the least of 1, 2, 4 or 8 bytes that they need, and the bytes that they took."""
    wide = data[0]
    room = 1 << max(0, wide - 1).bit_length()
    out = np.zeros((n, room), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, wide * n, 1).reshape(wide, n).T
    return out.view(f"<u{room}").ravel(), 1 + wide * n


def packed(hashes: np.ndarray, extras: list[np.ndarray]) -> bytes:
    """Sorted hashes as differences, and further numbers for each."""
    head = np.array([len(hashes)], "<u4").tobytes()
    return head + planes(np.diff(hashes, prepend=np.uint64(0))) + b"".join(planes(x) for x in extras)


def unpacked(data: bytes | pa.Buffer, n_extras: int) -> tuple[np.ndarray, list[np.ndarray]]:
    n, view = int(np.frombuffer(data, "<u4", 1)[0]), memoryview(data).cast("B")[4:]
    with np.errstate(over="ignore"):
        gaps, at = unplanes(view, n)
        hashes, extras = np.cumsum(gaps, dtype=np.uint64), []
    for _ in range(n_extras):
        x, took = unplanes(view[at:], n)
        extras.append(x)
        at += took
    return hashes, extras


def sent(blk: int, hashes: np.ndarray, extras: list[np.ndarray], buckets: int) -> pa.Table:
    """Rows for the buckets. hashes: sorted, each once. The last row's bucket takes what is left, so answers come back for all."""
    edges = np.searchsorted(hashes, bucket_edges(buckets)).tolist()
    rows = [(b, packed(hashes[s:e], [x[s:e] for x in extras])) for b, (s, e) in enumerate(zip(edges, [*edges[1:], len(hashes)], strict=True)) if e > s]
    return pa.table({"blk": pa.array([blk] * len(rows), pa.int64()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())})


@functools.cache
def bucket_edges(buckets: int) -> np.ndarray:
    return np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)


def answers(table: pa.Table, n_extras: int, f: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray], checked: bool = False) -> pa.Table:
    """A bucket's work. f gets for all blocks' entries, in the order of their hashes (and of blocks within): an entry's group (0, 1, ..), groups'
    first places and the extras; returns a byte for each entry. checked: the first extra is a second hash; entries are equal if both
    hashes are; f doesn't get it."""
    rows, payload, sizes = np.argsort(table.column("blk").to_numpy(), kind="stable"), table.column("payload"), []
    keys = table.select(["blk", "bucket"]).take(pa.array(rows))
    columns: list[list[np.ndarray]] = [[] for _ in range(n_extras + 1)]
    for i in rows.tolist():
        hashes, extras = unpacked(payload[i].as_buffer(), n_extras)
        sizes.append(len(hashes))
        for kept, x in zip(columns, [hashes, *extras], strict=True):
            kept.append(x)
    del table, payload
    hashes, *extras = [np.concatenate(columns.pop(0)) for _ in range(n_extras + 1)]
    order = np.lexsort((extras[0], hashes)) if checked else np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    del hashes
    extras = [x[order] for x in extras]
    if checked:
        new[1:] |= extras[0][1:] != extras[0][:-1]
        extras = extras[1:]
    out = np.zeros(len(order), np.uint8)
    out[order] = f(np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new), extras)
    edges = np.cumsum([0, *sizes])
    return keys.append_column("answer", pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()))


def answered(right: pa.Table, kind: str | None = None) -> np.ndarray:
    """What a block gets: a byte for each of its sorted hashes."""
    if kind is not None:
        right = right.filter(pc.equal(right.column("kind"), kind))
    right = right.sort_by("bucket")
    return np.frombuffer(b"".join(right.column("answer").to_pylist()), np.uint8)


@dataclass
class Dealt:
    """Documents in blocks."""

    docs: DataFrame
    buckets: int
    blocks: int
    size: int  # bytes of all texts

    def send(self, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return self.docs.groupBy("blk").applyInArrow(lambda t: f(t), SENT)

    def ask(self, rows: DataFrame, f: Callable[[pa.Table], pa.Table]) -> DataFrame:
        return rows.groupBy("bucket").applyInArrow(lambda t: f(t), ANSWER)

    def give(self, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return self.docs.groupBy("blk").cogroup(right.groupBy("blk")).applyInArrow(lambda left, right: f(left, right), schema)


def deal(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Dealt:
    """docs: doc_id and text, and other columns that are wanted. Documents with a null doc_id are dealt by their text."""
    ship(docs.sparkSession)
    _, size = total_bytes(docs)
    few = 2 * cores(docs.sparkSession)
    blocks = max(1, -(-size // block_bytes))
    blk = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(blocks)).alias("blk")
    parts = max(few, min(blocks, 4 * width(docs.sparkSession)))
    return Dealt(docs.select(blk, "*").repartition(parts, "blk"), max(few, size // (16 << 20)), blocks, size)
