"""Exact repeated substrings of documents' bytes, by merging the Burrows-Wheeler transforms of shards.

In every window of `length` bytes one run of GRAM bytes is marked: the one with the smallest hash. Equal windows have equal marks, at the
same place. So a window can only repeat if its mark does. Marks, about one in 70 bytes, are counted over the corpus first.

The windows of one occurrence of a mark that repeats lie within a stretch of 2 * length - GRAM bytes around it. Stretches go to buckets by their mark's hash. A
block of documents is a shard: it sends each bucket the positional Burrows-Wheeler transform of its stretches, lined up at their marks, that is, for each column
from the right the symbols before the suffixes, in the suffixes' order. A bucket merges all shards' transforms without their
texts: an interleave of the shards is refined column by column, by a stable partition on the symbols that each shard reads next, and the
lengths of common prefixes of neighbours are carried along. After a column, neighbours with `length` or more in common are repeated
intervals; their windows are reported to the blocks that sent them. No suffixes are sorted again.

A mark with more than HOT occurrences (a passage that is everywhere) would meet in one bucket; its windows are compared by 128 bits of two hash
functions instead, dealt by their own hash. Within a block, a stretch that occurs often (its bytes are compared) is sent once."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.llm.blocks import BASE, SEED, SEED2, TABLE, Dealt, answered, answers, bucket_edges, deal, hash_runs, mix, mix_two, sent
from helixframe.llm.common import documents

LENGTH, GRAM, HOT = 200, 64, 4096
PAD = 255  # no byte of UTF-8
#: Rows that are laid out at once, and bytes that are hashed at once: a block's arrays of 64-bit numbers never exist as a whole.
ROWS, PIECE = 2048, 1 << 18
LOW = np.uint64(0xFFFFFFFF)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row, by doubling."""
    have = 1
    while 2 * have <= n:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def rolled(x: np.ndarray, n: int) -> np.ndarray:
    """A polynomial of each n bytes in a row, modulo 2^64, put together from runs of 1, 2, 4, .. bytes."""
    out, have, run, size = None, 0, TABLE[x], 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                out = run if out is None else out[: len(out) - size] + run[have : have + len(out) - size] * np.uint64(pow(int(BASE), have, 1 << 64))
                have += size
            if have == n:
                return out
            run = run[:-size] + run[size:] * np.uint64(pow(int(BASE), size, 1 << 64))
            size *= 2


@dataclass
class Bytes:
    """The texts of a block: raw, and the same as a buffer; first byte of each and one more; at: starts of windows within one text; mark: place of each window's mark."""

    raw: bytes
    buffer: np.ndarray
    first: np.ndarray
    at: np.ndarray
    mark: np.ndarray
    length: int
    gram: int

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of the n bytes at each place: rolled(), mixed."""
        out = np.empty(len(at), np.uint64)
        with np.errstate(over="ignore"):
            power = np.array([pow(int(BASE), i, 1 << 64) for i in range(n)], np.uint64)
            for a in range(0, len(at), ROWS):
                out[a : a + ROWS] = (TABLE[self.buffer[at[a : a + ROWS, None] + np.arange(n)]] * power).sum(1, dtype=np.uint64)
            return mix(out)

    def wholes(self, at: np.ndarray, seed: np.uint64) -> np.ndarray:
        """Another hash of each window (at: ascending): nothing cancels out in it (see blocks)."""
        edges = np.searchsorted(at, np.arange(0, len(self.buffer) + PIECE, PIECE)).tolist()
        parts = [self._wholes(at[a:z], seed) for a, z in zip(edges, edges[1:], strict=False) if z > a]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _wholes(self, at: np.ndarray, seed: np.uint64) -> np.ndarray:
        if self.length < 8:
            return hash_runs(self.raw + bytes(8), at, at + self.length, seed)
        # only bytes of these windows are looked at: windows that overlap or touch make one stretch, stretches are put one behind the other
        last = np.append(np.diff(at) > self.length, True)
        begins, ends = at[np.append(True, last[:-1])], at[last] + self.length
        raw = b"".join(self.raw[a:z] for a, z in zip(begins.tolist(), ends.tolist(), strict=True))
        skipped = np.cumsum(begins - np.append(0, ends[:-1]))
        at = at - skipped[np.cumsum(last) - last]
        # runs of eight bytes at every place, put together; the last of them may overlap
        eight = mix(np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,)) ^ seed)
        out, have, run, size, rest = None, 0, eight, 8, self.length // 8
        while have < self.length // 8 * 8:
            if rest & 1:
                out = run[at] if out is None else mix_two(out, run[at + have])
                have += size
            if have < self.length // 8 * 8:
                run, size, rest = mix_two(run[:-size], run[size:]), 2 * size, rest >> 1
        return mix_two(out, eight[at + self.length - 8])

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the marks, each once, and which of them is each window's."""
        new = np.ones(len(self.mark), bool)
        new[1:] = self.mark[1:] != self.mark[:-1]
        return self.mark[new].astype(np.int64), np.cumsum(new, dtype=np.int32) - np.int32(1)


def bytes_of(parts: list[bytes | None], length: int) -> Bytes:
    parts = [p or b"" for p in parts]
    raw, first = b"".join(parts), np.cumsum([0, *map(len, parts)])
    buffer = np.frombuffer(raw, np.uint8)
    gram, windows = min(GRAM, length), max(0, len(buffer) - length + 1)
    starts = np.zeros(len(buffer) + 1, np.int8)
    sizes = np.diff(first)
    ok = sizes >= length
    np.add.at(starts, first[:-1][ok], 1)
    np.add.at(starts, first[1:][ok] - length + 1, -1)
    inside = np.cumsum(starts, dtype=np.int8, out=starts)[:windows] > 0
    at, mark = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, windows, PIECE):
        z = min(a + PIECE, windows)
        keys = rolled(buffer[a : z + length - 1], gram)
        with np.errstate(over="ignore"):
            keys ^= keys >> np.uint64(31)
            keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys &= ~LOW
        keys |= np.arange(len(keys), dtype=np.uint64)
        least, here = sliding_least(keys, length - gram + 1), np.flatnonzero(inside[a:z])
        at.append((here + a).astype(np.int32))
        mark.append(((least[here] & LOW).astype(np.int64) + a).astype(np.int32))
    return Bytes(raw, buffer, first, np.concatenate(at), np.concatenate(mark), length, gram)


def transform(stretches: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Of rows that are in order of their buckets: for each column the symbols there, in the order of what follows them (within a bucket)."""
    columns = np.ascontiguousarray(stretches.T)
    out, order = np.empty_like(columns), np.arange(columns.shape[1])
    base = np.cumsum(np.diff(bucket, prepend=bucket[:1]) != 0)
    base = base.astype(np.uint16 if base.max(initial=0) < 256 else np.uint32) << 8
    for j in range(len(columns) - 1, -1, -1):
        out[j] = columns[j][order]
        order = order[np.argsort(base + out[j], kind="stable")]
    return out


def merged(shards: list[np.ndarray], length: int) -> np.ndarray:
    """Merge shards' transforms (columns by rows). Gives, for each column that a window of `length` can start at and each row (shard by
    shard, in the order they were sent), whether the window there occurs in another row."""
    symbols = np.concatenate(shards, axis=1)
    width, n = symbols.shape
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16 if len(shards) < 1 << 16 else np.uint32), [x.shape[1] for x in shards])
    row, common = np.arange(n, dtype=np.int32), np.zeros(n + 1, np.int16)  # common[i]: of the i-th with the one before it
    out = np.zeros((width - length + 1, n), bool)
    for j in range(width - 1, -1, -1):
        own = np.empty(n, np.uint8)
        own[np.argsort(shard, kind="stable")] = symbols[j]  # each shard's symbols in turn
        order = np.argsort(own, kind="stable")
        sorted_own, a, b = own[order], order[:-1], order[1:]
        same = (sorted_own[1:] == sorted_own[:-1]) & (sorted_own[1:] != PAD)
        after = np.zeros(n + 1, np.int16)
        after[1:n] = np.where(same, np.where(b == a + 1, common[b] + 1, 1), 0)
        far = np.flatnonzero(same & (b != a + 1))
        if len(far):
            # neighbours that others stood between have the least in common of all that stood there
            group = np.cumsum(common[:n] == 0)
            far = far[group[a[far]] == group[b[far]]]
            edges = np.empty(2 * len(far), np.int64)
            edges[0::2], edges[1::2] = a[far] + 1, b[far] + 1
            if len(far):
                after[far + 1] = np.minimum.reduceat(common, edges)[0::2] + 1
        shard, row, common = shard[order], row[order], after
        if j <= width - length:
            long = common >= length
            out[j, row[long[:-1] | long[1:]]] = True
    return out


class Repeats:
    """The two exchanges."""

    def __init__(self, dealt: Dealt, length: int, hot: int = HOT):
        self.length, self.buckets, self.hot = length, dealt.buckets, hot
        self.bits = min(64, max(32, (dealt.blocks * (2 << 20) // 32).bit_length() + 6))
        self.lead = length - min(GRAM, length)
        self.width = self.lead + length

    def short(self, hashes: np.ndarray) -> np.ndarray:
        return hashes & np.uint64(((1 << self.bits) - 1) << (64 - self.bits))

    def read(self, table: pa.Table) -> Bytes:
        return bytes_of(table.column("text").cast(pa.binary()).to_pylist(), self.length)

    def send_marks(self, table: pa.Table) -> pa.Table:
        b = self.read(table)
        hashes, counts = np.unique(self.short(b.hashes(b.marks()[0], b.gram)), return_counts=True)
        return sent(table.column("blk")[0].as_py(), hashes, [counts], self.buckets)

    def count(self, table: pa.Table) -> pa.Table:
        """1: the mark repeats; 2: it has more than HOT occurrences."""
        def grade(group: np.ndarray, first: np.ndarray, extras: list[np.ndarray]) -> np.ndarray:
            n = np.add.reduceat(extras[0].astype(np.int64), first)[group]
            return (n > 1).astype(np.uint8) + (n > self.hot)

        return answers(table, 1, grade)

    def send_stretches(self, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return sent(0, np.zeros(0, np.uint64), [], self.buckets)
        c, blk = Candidates(self, self.read(left), answered(right)), left.column("blk")[0].as_py()
        hashes, check, which = c.hot_hashes()
        hot = sent(blk, hashes, [check, np.minimum(np.bincount(which, minlength=len(hashes)), 2)], self.buckets)
        hot = hot.set_column(1, "bucket", pa.array(hot.column("bucket").to_numpy() + self.buckets, pa.int32()))
        which, first = np.unique(c.bucket, return_index=True)
        symbols = transform(c.stretches(), c.bucket)
        rows = [symbols[:, a:z].tobytes() for a, z in zip(first.tolist(), [*first[1:].tolist(), len(c.bucket)], strict=True)] if len(which) else []
        return pa.concat_tables([pa.table({"blk": pa.array([blk] * len(rows), pa.int64()), "bucket": pa.array(which, pa.int32()), "payload": pa.array(rows, pa.binary())}), hot])

    def merge(self, table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= self.buckets:
            return answers(table, 2, lambda group, first, extras: (np.add.reduceat(extras[0].astype(np.int64), first)[group] > 1).astype(np.uint8), checked=True)
        rows, payload = np.argsort(table.column("blk").to_numpy(), kind="stable"), table.column("payload")
        shards = [np.frombuffer(payload[i].as_buffer(), np.uint8).reshape(self.width, -1) for i in rows.tolist()]
        edges = np.cumsum([0, *(x.shape[1] for x in shards)]).tolist()
        bits = np.packbits(merged(shards, self.length).T, axis=1)
        keys = table.select(["blk", "bucket"]).take(pa.array(rows))
        return pa.table({"blk": keys.column("blk"), "bucket": keys.column("bucket"), "answer": pa.array([bits[a:z].tobytes() for a, z in zip(edges, edges[1:], strict=False)], pa.binary())})

    def gone(self, left: pa.Table, right: pa.Table) -> tuple[Bytes, np.ndarray]:
        """The bytes of a block, and whether each goes."""
        b = self.read(left)
        kind, bucket = right.column("kind").to_numpy(), right.column("bucket").to_numpy()
        of = lambda keep: answered(right.filter(pa.array(keep)))
        c = Candidates(self, b, of(kind == "marks"))
        at = c.repeated(of((kind == "windows") & (bucket < self.buckets)), of((kind == "windows") & (bucket >= self.buckets)))
        edge = np.zeros(len(b.buffer) + 1, np.int32)
        edge[at] += 1
        edge[at + self.length] -= 1
        return b, np.cumsum(edge, dtype=np.int32, out=edge)[:-1] > 0


class Candidates:
    """A block's windows whose mark repeats: `hot` ones, and stretches, each once, in order of bucket and hash."""

    def __init__(self, r: Repeats, b: Bytes, answer: np.ndarray):
        self.r, self.b = r, b
        places, own = b.marks()
        hashes = b.hashes(places, b.gram)
        grade = answer[np.unique(r.short(hashes), return_inverse=True)[1]] if len(places) else np.zeros(0, np.uint8)
        self.hot = b.at[grade[own] == 2] if len(places) else b.at
        keep = np.flatnonzero(grade == 1)
        low = b.at[np.searchsorted(own, keep)].astype(np.int64) if len(keep) else np.zeros(0, np.int64)
        high = b.at[np.searchsorted(own, keep, side="right") - 1].astype(np.int64) if len(keep) else low
        mark = places[keep]
        a, z, m = low.tolist(), (high + r.length).tolist(), mark.tolist()
        whole = np.array([zlib.crc32(b.raw[x:y]) for x, y in zip(a, z, strict=True)], np.uint64)
        with np.errstate(over="ignore"):
            key = mix(mix(whole ^ hashes[keep]) + (mark - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (high - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        bucket = np.searchsorted(bucket_edges(r.buckets), hashes[keep], side="right") - 1
        order = np.lexsort((key, bucket))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        # equal keys are looked into: stretches are the same only if their bytes and the place of the mark are
        for i in np.flatnonzero(~new).tolist():
            x, y = int(order[i - 1]), int(order[i])
            new[i] = m[x] - a[x] != m[y] - a[y] or b.raw[a[x] : z[x]] != b.raw[a[y] : z[y]]
        first = order[new]
        self.which = np.empty(len(order), np.int64)  # of each occurrence
        self.which[order] = np.cumsum(new) - 1
        self.often = np.bincount(self.which, minlength=len(first)) > 1
        self.low, self.high, self.mark = low, high, mark
        self.first, self.bucket = first, bucket[first]

    def hot_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes of the distinct hot windows, in order of the first, and which of them is each window's."""
        one, two = self.b.wholes(self.hot, SEED), self.b.wholes(self.hot, SEED2)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return one[new], two[new], which

    def stretches(self) -> np.ndarray:
        """Bytes around the marks, lined up at them."""
        out = np.full((len(self.first), self.r.width), PAD, np.uint8)
        columns = np.arange(self.r.width) - self.r.lead
        for a in range(0, len(self.first), ROWS):
            f = self.first[a : a + ROWS, None]
            place = self.mark[f] + columns
            inside = (place >= self.low[f]) & (place < self.high[f] + self.r.length)
            part = out[a : a + ROWS]
            part[inside] = self.b.buffer[place[inside]]
        return out

    def repeated(self, merged_bits: np.ndarray, hot_answer: np.ndarray) -> np.ndarray:
        """Starts of the windows that occur elsewhere."""
        starts = self.r.lead + 1
        bits = np.unpackbits(merged_bits.reshape(-1, -(-starts // 8)), axis=1, count=starts).astype(bool)
        bits |= self.often[:, None]
        found = [np.zeros(0, np.int64)]
        for a in range(0, len(self.low), ROWS):
            low, mark, which = (x[a : a + ROWS] for x in (self.low, self.mark, self.which))
            n = self.high[a : a + ROWS] - low + 1
            of = np.repeat(np.arange(len(n)), n)
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(of))
            found.append(at[bits[which[of], self.r.lead - (mark[of] - at)]])
        hot = self.hot[hot_answer[self.hot_hashes()[2]] > 0] if len(self.hot) else self.hot
        return np.concatenate([*found, hot])


def _both(dealt: Dealt, r: Repeats) -> DataFrame:
    marks = dealt.ask(dealt.send(r.send_marks), r.count)
    windows = dealt.ask(dealt.give(marks, r.send_stretches, "blk long, bucket int, payload binary"), r.merge)
    return marks.withColumn("kind", F.lit("marks")).unionByName(windows.withColumn("kind", F.lit("windows")))


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row: bytes covered by a string of `length` bytes that also starts
    anywhere else go, judged on the input.

    A null or empty text has no bytes. Rows that share a doc_id, or have none, are documents like others, and copies of each other if their
    texts are equal. Other columns are ignored. No rows, no result."""
    dealt = deal(docs.select("doc_id", "text"))
    r = Repeats(dealt, length)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, sizes, removed, spans, shas = left.column("doc_id").cast(pa.int64()), [], [], [], []
        if left.num_rows:
            b, gone = r.gone(left, right)
            begins = np.diff(gone, prepend=False) & gone
            for a, z in zip(b.first.tolist(), b.first[1:].tolist(), strict=False):
                own = gone[a:z]
                n = int(own.sum())
                sizes.append(z - a)
                removed.append(n)
                spans.append(int(begins[a + 1 : z].sum()) + int(n > 0 and own[0]))
                shas.append(hashlib.sha256((b.buffer[a:z][~own] if n else b.buffer[a:z]).tobytes()).hexdigest())
        return pa.table({"doc_id": doc, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return dealt.give(_both(dealt, r), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated bytes taken out of text (and n_chars, where there is one, counted anew). A character of which only some bytes go
    goes whole. Documents that lose their last word by it go."""
    # other columns travel under names that can't clash
    names = [c if c in ("doc_id", "text", "n_chars") else f"other_{i}" for i, c in enumerate(docs.columns)]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    dealt, schema = deal(plain), plain.schema
    r, arrow = Repeats(dealt, length), to_arrow_schema(schema)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(names)
        if left.num_rows:
            b, gone = r.gone(left, right)
            texts, stays = left.column("text").to_pylist(), []
            for i, (a, z) in enumerate(zip(b.first.tolist(), b.first[1:].tolist(), strict=False)):
                if gone[a:z].any():
                    texts[i] = b.buffer[a:z][~gone[a:z]].tobytes().decode("utf-8", "ignore")
                stays.append(not gone[a:z].any() or bool(texts[i].strip(" \t\n\x0b\x0c\r")))
            out = out.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                old = left.column("n_chars").to_pylist()
                n = [len(t) if gone[a:z].any() else o for t, o, a, z in zip(texts, old, b.first.tolist(), b.first[1:].tolist(), strict=False)]
                out = out.set_column(names.index("n_chars"), "n_chars", pa.array(n, pa.int64()))
            out = out.filter(pa.array(stays, pa.bool_()))
        return out.cast(arrow)

    out = dealt.give(_both(dealt, r), finish, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(documents(spark, sf_dir))
