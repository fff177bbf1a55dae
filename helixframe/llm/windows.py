"""Substring dedup: runs of words that occurred before, found by level-wise doubling.

Windows of a few words (BASE_WORDS at most) that occur once in the corpus are done with; those that repeat are extended to twice their length where both
halves repeat, and so on up to the length asked for; a level to which no candidate comes sends nothing. Each level is one exchange of hashes (see blocks): at
lower levels short ones, whose chance collisions only leave a few more candidates; at the last level 128 bits of two hash functions, and where each
window comes first. Words are not sent: windows whose 128 bits agree count as equal."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.blocks import SEED2, SENT, Dealt, Words, answered, answers, deal, sent, words_of
from helixframe.llm.common import documents

WORDS, BASE_WORDS = 20, 5
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def levels(length: int) -> list[int]:
    """Lengths of windows, each at most twice the one before it, up to the length asked for."""
    out = [length]
    while out[0] > BASE_WORDS:
        out.insert(0, -(-out[0] // 2))
    return out


def _ordered(table: pa.Table) -> pa.Table:
    """By doc_id, null first, then text: the order in which a block's documents count as earlier."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if not table.column("doc_id").null_count else pa.concat_tables([
        table.filter(pc.is_null(table.column("doc_id"))).sort_by("text"),
        table.filter(pc.is_valid(table.column("doc_id"))).sort_by([("doc_id", "ascending"), ("text", "ascending")]),
    ])


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & np.uint64(((1 << bits) - 1) << (64 - bits))


class Level:
    """What a block recomputes at each step: its candidates of a level. known: the answers to the levels below; the last level has whole hashes."""

    def __init__(self, table: pa.Table, steps: list[int], known: list[np.ndarray], bits: int):
        self.table = _ordered(table)
        self.words: Words = words_of(self.table.column("text").to_pylist())
        last, flags = len(steps) - 1, None
        for k in range(len(known) + 1):
            self.at, hashes = self.words.windows(steps[k])
            self.hashes = hashes if k == last else _short(hashes, bits)
            self.check = self.words.windows(steps[k], SEED2)[1] if k == last else np.zeros(len(hashes), np.uint64)
            if flags is not None:
                keep = flags[self.at] & flags[self.at + steps[k] - steps[k - 1]]
                self.at, self.hashes, self.check = self.at[keep], self.hashes[keep], self.check[keep]
            self._distinct()
            if k < len(known):
                flags = np.zeros(len(self.words.hashes) + 1, bool)
                flags[self.at] = known[k][self.which] > 0

    def _distinct(self) -> None:
        """first: the first of each distinct candidate, in order of their hashes; which: for each candidate the number of its equals there."""
        order = np.lexsort((self.check, self.hashes)) if self.check.any() else np.argsort(self.hashes, kind="stable")
        hashes, check = self.hashes[order], self.check[order]
        new = np.ones(len(order), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (check[1:] != check[:-1])
        self.first, self.which = order[new], np.empty(len(order), np.int32)
        self.which[order] = np.cumsum(new, dtype=np.int32) - 1

    def ids(self) -> np.ndarray:
        """The doc_id of each distinct candidate's first place, shifted so that it orders as an unsigned number; 0 for null."""
        doc = self.table.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        with np.errstate(over="ignore"):
            return doc[np.searchsorted(self.words.first, self.at[self.first], side="right") - 1].astype(np.uint64) + np.uint64(1 << 63)


def _known(right: pa.Table, n: int) -> list[np.ndarray]:
    return [answered(right, str(k)) for k in range(n)]


def judged(dealt: Dealt, bits: int, length: int = WORDS) -> DataFrame:
    """The answers of all levels, each with its number as kind. At the last level 1 says that the block has the first of all windows of that hash."""
    steps, buckets, known = levels(length), dealt.buckets, None

    def send(k: int):
        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            if not left.num_rows:
                return sent(0, np.zeros(0, np.uint64), [], buckets)
            level, blk = Level(left, steps, _known(right, k) if k else [], bits), left.column("blk")[0].as_py()
            if k < len(steps) - 1:
                return sent(blk, level.hashes[level.first], [np.minimum(np.bincount(level.which, minlength=len(level.first)), 2)], buckets)
            ids = level.ids()
            base = ids.min() if len(ids) else np.uint64(0)
            return sent(blk, level.hashes[level.first], [level.check[level.first], ids - base, np.full(len(ids), base)], buckets)

        return run

    def count(table: pa.Table) -> pa.Table:
        return answers(table, 1, lambda group, first, extras: (np.add.reduceat(extras[0].astype(np.int64), first) > 1).astype(np.uint8)[group])

    def earliest(table: pa.Table) -> pa.Table:
        def first_of(group: np.ndarray, first: np.ndarray, extras: list[np.ndarray]) -> np.ndarray:
            ids = extras[0].astype(np.uint64) + extras[1]
            least = np.minimum.reduceat(ids, first)
            tied = ids == least[group]
            # of blocks with the same first doc_id (rows that share it) the smallest counts; blocks are in order within a group
            nth = np.cumsum(tied)
            return (tied & (nth - (nth - tied)[first][group] == 1)).astype(np.uint8)

        return answers(table, 3, first_of, checked=True)

    for k in range(len(steps)):
        rows = dealt.send(send(k)) if known is None else dealt.give(known, send(k), SENT)
        got = dealt.ask(rows, earliest if k == len(steps) - 1 else count).withColumn("kind", F.lit(str(k)))
        known = got if known is None else known.unionByName(got)
    return known


def flags_of(left: pa.Table, right: pa.Table, bits: int, length: int) -> tuple[Level, np.ndarray]:
    """The last level of a block, and for each of its words whether it goes."""
    steps = levels(length)
    *lower, full = _known(right, len(steps))
    level = Level(left, steps, lower, bits)
    stays = np.zeros(len(level.at), bool)
    stays[level.first[full > 0]] = True  # the first of the block is the first of all
    cover = np.zeros(len(level.words.hashes) + 1, np.int32)
    gone = level.at[~stays]
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + length, -1)
    return level, np.cumsum(cover)[:-1] > 0


def _bits(dealt: Dealt) -> int:
    """Short hashes: as many bits as there may be words, and some more."""
    return min(64, max(32, (dealt.blocks * (2 << 20) // 4).bit_length() + 6))


def dedup_windows(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row: words covered by a window of `length` words that also starts earlier go.

    A null or empty text has no words. Earlier is: a smaller doc_id (null is the smallest), or the same document further left; of
    rows that share a doc_id, those in one block of documents count by their texts. Other columns are ignored. No rows, no result."""
    dealt = deal(docs.select("doc_id", "text"))
    bits = _bits(dealt)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())})
        level, gone = flags_of(left, right, bits, length)
        w, data = level.words, level.words.padded
        n_words, n_removed, shas = np.diff(w.first), [], []
        for a, b in zip(w.first.tolist(), w.first[1:].tolist(), strict=False):
            keep = np.flatnonzero(~gone[a:b]) + a
            n_removed.append(b - a - len(keep))
            shas.append(hashlib.sha256(b" ".join(data[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True))).hexdigest())
        return pa.table({"doc_id": level.table.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())})

    return dealt.give(judged(dealt, bits, length), finish, OUT)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_windows(documents(spark, sf_dir))
