"""Bases of many reads at once, as flat arrays. Reads that share a CIGAR are laid out together by one template."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SOFT, INSERTED = -1, -2
_OPS = re.compile(r"([0-9]+)([MIDNSHPX=])")


def runs(cigar: str | None) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OPS.findall((cigar or "*").upper())]


@functools.lru_cache(1 << 16)
def aligned(cigar: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each base of a read: how far from the read's position it is aligned (SOFT, INSERTED), and the same for the aligned base that it goes with."""
    place, goes, at, last = [], [], 0, 0
    for n, op in runs(cigar):
        if op in "M=X":
            place += range(at, at + n)
            goes += range(at, at + n)
            last = at + n - 1 if n else last
        elif op in "SI":
            place += [SOFT if op == "S" else INSERTED] * n
            goes += [SOFT if op == "S" else last] * n
        if op in "MDN=X":
            at += n
    return np.array(place, np.int64), np.array(goes, np.int64)


@functools.lru_cache(1 << 16)
def covered(cigar: str | None) -> tuple[np.ndarray, ...]:
    """For each position that a read covers: how far from its own, index of the base (-1: deleted), whether a neighbouring operation inserts, deletes or
    clips, and whether it clips; and the indexes of soft clipped bases."""
    all_runs, rows, soft, at, read = runs(cigar), [], [], 0, 0
    for k, (n, op) in enumerate(all_runs):
        if op in "M=XD":
            near = [set() for _ in range(n)]
            if n and k:
                near[0].add(all_runs[k - 1][1])
            if n and k + 1 < len(all_runs):
                near[-1].add(all_runs[k + 1][1])
            rows += [(at + i, -1 if op == "D" else read + i, bool(near[i] & {"I", "S", "D"}), "S" in near[i]) for i in range(n)]
        if op == "S":
            soft += range(read, read + n)
        at += n if op in "MDN=X" else 0
        read += n if op in "MIS=X" else 0
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2].astype(bool), table[:, 3].astype(bool), np.array(soft, np.int64)


class Flat:
    """qual and seq of a batch, one read after the other; n and first: a read's length and first base; row: the read of each base."""

    def __init__(self, batch: pa.RecordBatch):
        qual = batch.column("qual")
        self.n = pc.fill_null(pc.list_value_length(qual), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.qual = qual.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        data, starts, sizes = _text(batch.column("seq"))
        if (sizes == self.n).all():  # as it should be
            self.seq = data[starts[0] : starts[0] + sizes.sum()] if len(starts) else data[:0]
        else:
            letters = "".join((s or "")[:n].ljust(n, " ") for s, n in zip(batch.column("seq").to_pylist(), self.n.tolist(), strict=True))
            self.seq = np.frombuffer(letters.encode("latin-1", "replace"), np.uint8)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.cigars = batch.column("cigar").dictionary_encode()

    def by_cigar(self):
        """(cigar, its reads), for each cigar of the batch."""
        code = pc.fill_null(self.cigars.indices, -1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        edges = np.flatnonzero(np.diff(code[order], prepend=-2))
        names = self.cigars.dictionary.to_pylist()
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
            yield (None if code[order[a]] < 0 else names[code[order[a]]]), order[a:z]


def numbers(batch: pa.RecordBatch, name: str, null: int = 0) -> np.ndarray:
    return pc.fill_null(batch.column(name).cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def letters(codes: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    """Strings of one letter each; empty where the code is 0, null where missing."""
    full = codes != 0
    offsets = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
    valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(codes), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes[full].astype(np.uint8).tobytes())])


def _text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all texts as bytes, where each begins, how long it is); nulls are empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = texts.buffers()
    if data is not None and not texts.null_count:
        at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts)].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        if not len(at) or not (raw[at[0] : at[-1] + sizes[-1]] >= 128).any():
            return raw, at, sizes
    plain = [(t or "").encode("latin-1", "replace") for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in plain], np.int64)
    return np.frombuffer(b"".join(plain), np.uint8), np.cumsum(sizes) - sizes, sizes


def text_at(texts: pa.Array, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The letter at a place of the row's text; 0 beyond it."""
    data, starts, sizes = _text(texts)
    inside = (at >= 0) & (at < sizes[row])
    return np.where(inside, data[np.where(inside, starts[row] + at, 0)], 0).astype(np.uint8) if len(data) else np.zeros(len(row), np.uint8)


def summed(code: np.ndarray, values: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, sums of each array of values by code; None: how many there are). Codes are whole numbers; where they lie close together they are counted without a sort."""
    if not len(code):
        return code, [np.zeros(0, np.int64 if v is None or v.dtype.kind in "biu" else float) for v in values]
    low = int(code.min())
    if int(code.max()) - low < 4 * len(code) + (1 << 16):
        at = code - low
        n = np.bincount(at)
        some = np.flatnonzero(n)
        codes = some + low
    else:
        codes, at, n = np.unique(code, return_inverse=True, return_counts=True)
        some = np.arange(len(codes))
    out = []
    for v in values:
        s = (n if v is None else np.bincount(at, weights=v))[some]
        out.append(s.astype(np.int64) if v is None or v.dtype.kind in "biu" else s)
    return codes, out


class Sums:
    """Sums by code over all batches of a task, of which no more than about `most` codes are held at once: a table of what came more than once is far smaller than its rows,
    and bounded where it isn't."""

    def __init__(self, most: int = 1 << 20):
        self.parts, self.held, self.most = [], 0, most

    def add(self, codes: np.ndarray, values: list[np.ndarray]) -> None:
        self.parts.append((codes, values))
        self.held += len(codes)
        if self.held > self.most:
            self.parts = [self._merged()]
            self.held = len(self.parts[0][0])

    def _merged(self) -> tuple[np.ndarray, list[np.ndarray]]:
        codes = np.concatenate([c for c, _ in self.parts])
        return summed(codes, [np.concatenate(v) for v in zip(*(v for _, v in self.parts), strict=True)])

    def full(self) -> bool:
        return self.held > self.most // 2

    def taken(self) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """All that is held, which is then forgotten; None if that is nothing."""
        if not self.held:
            return None
        out, self.parts, self.held = self._merged(), [], 0
        return out


_CODE = np.full(256, -1, np.int8)
_CODE[[ord(c) for c in "ACGT"]] = range(4)


def context_codes(seq: np.ndarray, qual: np.ndarray, row: np.ndarray, index: np.ndarray, reverse: np.ndarray, low_tail: int) -> np.ndarray:
    """4 * the base before + the base, in the machine's direction, for bases in order of row and index; -1 without one (see recalibration.contexts)."""
    if not len(row):
        return np.zeros(0, np.int64)
    big, n = np.int64(1 << 40), int(row.max()) + 1
    low, high = np.full(n, big), np.full(n, -1, np.int64)
    good = qual > low_tail
    np.minimum.at(low, row[good], index[good])
    np.maximum.at(high, row[good], index[good])
    code = _CODE[seq].astype(np.int64)
    code[(index < low[row]) | (index > high[row])] = -1
    code = np.where(reverse & (code >= 0), 3 - code, code)
    back, ahead = np.full(len(code), -1, np.int64), np.full(len(code), -1, np.int64)
    together = row[1:] == row[:-1]
    back[1:][together] = code[:-1][together]
    ahead[:-1][together] = code[1:][together]
    before = np.where(reverse, ahead, back)
    return np.where((before >= 0) & (code >= 0), 4 * before + code, -1)
