"""Exact ids of the tokenizers library at a fraction of its time.

A text of Latin letters, digits, ASCII signs and white space (PLAIN) is cut by an equivalent of the tokenizer's own pattern, and its pieces are
merged by tiktoken's core with the same vocabulary. Every other text, and one with a special token in it, goes to the library itself."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

CACHE = 300_000
LOWER, UPPER = "a-z\\u00df-\\u00f6\\u00f8-\\u017e", "A-Z\\u00c0-\\u00d6\\u00d8-\\u00de"
#: Finds a character that is not plain. Left out of the letters: U+0130, whose lower case is two characters.
ODD = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u012f\\u0131-\\u017e]")
#: The patterns of the two pre-tokenizers for plain texts.
BYTE_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LOWER}{UPPER}]+| ?[0-9]+| ?[^ \\t-\\r{LOWER}{UPPER}0-9]+|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+")
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^ \\t-\\r{LOWER}0-9]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted({*range(256)}.difference(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """encode(texts): the ids of each text as little-endian unsigned 32-bit integers. A null text counts as empty.

    A vocabulary with word ends has a byte that UTF-8 never uses in their place, which joins the byte before it first of all."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in said["added_tokens"]) or "(?!)")
        letters, model = byte_letters(), said["model"]
        self.end = model.get("end_of_word_suffix") or ""

        def raw(token: str) -> bytes:
            ends = self.end and token.endswith(self.end)
            return bytes(letters[c] for c in (token[: -len(self.end)] if ends else token)) + b"\xff" * bool(ends)

        special = {t["content"] for t in said["added_tokens"]}
        ids = {raw(k): v for k, v in model["vocab"].items() if k not in special}
        ranks = {bytes([b]): b for b in range(256)}
        if self.end:
            ranks |= {bytes([b, 255]): 256 + b for b in range(255)}
        for n, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(a) + raw(b), 512 + n)
        self.id_of = np.zeros(max(ranks.values()) + 1, "<u4")
        for k, r in ranks.items():
            self.id_of[r] = ids.get(k, 0)
        self.core = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.cache: dict[str, bytes] = {}

    def library(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        return [self.one(t) if t else b"" for t in texts]

    def one(self, text: str) -> bytes:
        if ODD.search(text) or self.special.search(text):
            return self.library([text])[0]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        pieces = WORD_PIECES.findall(text.lower()) if self.end else BYTE_PIECES.findall(text)
        if missing := list(set(pieces).difference(cache)):
            merged, last = [], b"\xff" if self.end else b""
            for p in missing:
                merged.append(self.core.encode_single_piece(p.encode() + last))
            at = np.cumsum([0, *map(len, merged)]).tolist()
            ids = self.id_of[np.array([r for m in merged for r in m], np.int64)].tobytes()
            cache.update((p, ids[4 * a : 4 * b]) for p, a, b in zip(missing, at, at[1:], strict=False))
        return b"".join(map(cache.__getitem__, pieces))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
