"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of each prefix of a chunk has one last token, which the prefix alone determines. It is found among the vocabulary's tokens that
end there (matches of an Aho-Corasick automaton, longest first): it is the one that is compatible with the last token of the prefix
that it leaves. Two tokens are compatible if merging their bytes by the rules gives just these two. Following the stored last
tokens back from the end gives the ids. Prefixes are remembered over chunks and texts in tables of bounded size."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm.common import documents, in_arrow, slices
from helixframe.llm.subwords import BYTE_PIECES, ODD, byte_letters

CACHE = 300_000
#: Bytes of a piece up to which its prefixes are remembered.
LONG = 64
NONE = 1 << 31


class SuffixAutomaton:
    """An Aho-Corasick automaton over the tokens, in spite of the name: states are their prefixes; step() gives the state of the longest prefix that ends at the next byte;
    ends[state] lists (token, length) of all tokens that end there, longest first."""

    def __init__(self, tokens: dict[bytes, int]):
        self.next: list[dict[int, int]] = [{}]
        self.fail, own, depth = [0], {}, [0]
        for token, i in tokens.items():
            s = 0
            for b in token:
                if b not in self.next[s]:
                    self.next[s][b] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    depth.append(depth[s] + 1)
                s = self.next[s][b]
            own[s] = (i, len(token))
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for s in sorted(range(len(depth)), key=depth.__getitem__):
            self.ends[s] = ((own[s],) if s in own else ()) + self.ends[self.fail[s]]
            for b, t in self.next[s].items():
                self.fail[t] = self.step(self.fail[s], b) if s else 0

    def step(self, s: int, b: int) -> int:
        while s and b not in self.next[s]:
            s = self.fail[s]
        return self.next[s].get(b, 0)


class PrefixEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        vocab = {bytes(letters[c] for c in k): v for k, v in model["model"]["vocab"].items() if k not in special}
        self.special = special
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for k, v in [*vocab.items(), *((k.encode(), v) for k, v in special.items())]:
            self.bytes_of[v] = k
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.order = dict.fromkeys(vocab.values(), -1)
        for n, m in enumerate(model["model"]["merges"]):
            a, b = (vocab[bytes(letters[c] for c in x)] for x in (m.split(" ") if isinstance(m, str) else m))
            joined = vocab[self.bytes_of[a] + self.bytes_of[b]]
            self.rank[a, b] = n
            if joined not in self.split:
                self.split[joined], self.order[joined] = (a, b), n
        self.automaton = SuffixAutomaton(vocab)
        self.fits: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[bytes, tuple[int, int, int]] = {}
        self.chunks: dict[str, bytes] = {}
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.cut = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merge rules leave bytes(a) + bytes(b) as just a, b: no merge over the border comes before the merges
        that build a and b. Goes down both tokens' merges, latest first."""
        if (known := self.fits.get((a, b))) is not None:
            return known
        left, right, limit, fit = a, b, NONE, True
        while True:
            if (n := self.rank.get((left, right))) is not None and n < limit:
                fit = False
                break
            ol, orr = self.order[left], self.order[right]
            if ol < 0 and orr < 0:
                break
            # undo the later of the two last merges; of equal merges the one further left is done first
            if ol > orr:
                limit, left = ol, self.split[left][1]
            else:
                limit, right = orr + 1, self.split[right][0]
        self.fits[a, b] = fit
        return fit

    def piece(self, text: bytes) -> list[int]:
        """The ids of a piece. Extends the longest known prefix byte by byte."""
        known, n = self.prefixes, len(text)
        m = n
        while m and text[:m] not in known:
            m -= 1
        state = known[text[:m]][0] if m else 0
        while m < n:
            state, m = self.automaton.step(state, text[m]), m + 1
            for token, length in self.automaton.ends[state]:
                if length == m or self.compatible(known[text[: m - length]][1], token):
                    known[text[:m]] = (state, token, length)
                    break
            else:
                raise ValueError(f"no token ends at {text[:m]!r}")
        out = []
        while n:
            _, token, length = known[text[:n]]
            out.append(token)
            n -= length
        return out[::-1]

    def long_piece(self, text: bytes) -> list[int]:
        """Without remembered prefixes, whose bytes would grow with the square of the length."""
        state, last = 0, []
        for n, b in enumerate(text, 1):
            state = self.automaton.step(state, b)
            last.append(next((t, length) for t, length in self.automaton.ends[state] if length == n or self.compatible(last[n - length - 1][0], t)))
        out, at = [], len(text)
        while at:
            token, length = last[at - 1]
            out.append(token)
            at -= length
        return out[::-1]

    def pack(self, piece: str) -> bytes:
        return np.array(self.piece(p) if len(p := piece.encode()) <= LONG else self.long_piece(p), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            out, at = [], 0
            for m in self.cut.finditer(text):
                out += [self.encode(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
                at = m.end()
            return b"".join([*out, self.encode(text[at:])])
        known, cut = self.chunks, self.pieces.findall(text) if ODD.search(text) else BYTE_PIECES.findall(text)
        for p in set(cut).difference(known):
            known[p] = self.pack(p)
        out = b"".join(map(known.__getitem__, cut))
        for table, most in ((known, CACHE), (self.prefixes, 2 * CACHE), (self.fits, 2 * CACHE)):
            if len(table) > most:
                table.clear()
        return out

    def decode(self, ids: bytes) -> str:
        """As decode(ids, skip_special_tokens=False): bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, PrefixEncoder] = {}


def prefix_encoder(path: str) -> PrefixEncoder:
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = [np.frombuffer(prefix_encoder(path).encode(t), "<i4") for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of each row of doc_id, ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: Sequence[str] = [prefix_encoder(path).decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document: encoded, then decoded from its ids. A null or empty text has no
    ids; rows that share a doc_id, or have none, each give their row; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = prefix_encoder(path)
        for b in slices(batches):
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = enc.encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
