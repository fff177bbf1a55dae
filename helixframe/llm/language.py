"""Language identification, word first.

A word that the model knows is scored by its log frequency in each language; a word it doesn't know by its character n-grams:
the longest known ones at each place, from five letters down to one. Word and n-gram counts come from a sample of labelled
documents of bounded size: SAMPLE of each language, those with the smallest hashes of their doc_id. Every language with a labelled
document is learned; where there are more than LANGUAGES, each has as much less of the sample and of the tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import documents, in_arrow, slices

#: Documents of each language that the model is fitted on, languages that have so many, and words and n-grams of each language that it keeps.
SAMPLE, LANGUAGES, WORDS, GRAMS = 800, 64, 60_000, 40_000
LONGEST = 5
#: Runs of letters, and of what counts as numeric without being a digit or a letter (fractions, superscripts, Roman numerals), which few texts have. A
#: class that names all of these is tried one by one at each letter.
RUN = re.compile(r"[^\W\d_]+")
CACHE = 400_000


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    runs = RUN.findall(text.lower()) if text else []
    if "".join(runs).isalpha():
        return runs
    return [w for r in runs for w in ([r] if r.isalpha() else "".join(c if c.isalpha() else " " for c in r).split())]


class Model:
    """score(word): log probabilities of a word in each language."""

    def __init__(self, counts: dict[str, tuple[Counter, dict[int, Counter]]]):
        """counts: for each language its words, and its n-grams by length, as many as are to be kept."""
        self.languages = sorted(counts)
        self.words = self._table([counts[k][0] for k in self.languages])
        self.grams = {n: self._table([counts[k][1].get(n, Counter()) for k in self.languages]) for n in range(1, LONGEST + 1)}
        #: Rows of words in scores; rows beyond them are room.
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    @staticmethod
    def _table(each: list[Counter]) -> dict[str, np.ndarray]:
        keep = {k for c in each for k in c}
        totals = np.array([sum(c.values()) for c in each], float) + 0.5 * (len(keep) + 1)
        return {k: np.log((np.array([c[k] for c in each]) + 0.5) / totals).astype(np.float32) for k in keep}

    def score(self, word: str) -> np.ndarray:
        if (known := self.words.get(word)) is not None:
            return known
        marked, out, at, n_parts = f"^{word}$", np.zeros(len(self.languages), np.float32), 0, 0
        while at < len(marked):
            for n in range(min(LONGEST, len(marked) - at), 0, -1):
                if (known := self.grams[n].get(marked[at : at + n])) is not None:
                    out, n_parts = out + known, n_parts + 1
                    break
            else:
                n = 1
            at += max(1, n - 1)
        return out / max(1, n_parts)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the share of the likelihood it has; und and 0 without letters, or if nothing was learned."""
        words = words_of(text)
        if not words or not self.languages:
            return "und", 0.0
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
            self.scores = self.scores[:0].copy()
        if new := list(set(words).difference(cache)):
            start, end = len(cache), len(cache) + len(new)
            if end > len(self.scores):
                # with room for more, so that few texts move the rows of all words
                more = np.empty((end + end // 2, len(self.languages)), np.float32)
                more[:start] = self.scores[:start]
                self.scores = more
            self.scores[start:end] = [self.score(w) for w in new]
            cache.update(zip(new, range(start, end), strict=True))
        total = self.scores[list(map(cache.__getitem__, words))].sum(0, dtype=float)
        p = np.exp(total - total.max())
        return self.languages[int(p.argmax())], float(p.max() / p.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n (0: whole words), gram and count of what a task has read."""
    found: dict[str, list[Counter]] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            own = found.setdefault(lang, [Counter()])
            own[0].update(words_of(text))
    for lang, (words,) in found.items():
        grams = [words, *(Counter() for _ in range(LONGEST))]
        for w, k in words.items():
            m = f"^{w}$"
            for n in range(1, LONGEST + 1):
                for i in range(len(m) - n + 1):
                    grams[n][m[i : i + n]] += k
        for n, c in enumerate(grams):
            yield pa.record_batch({"lang": pa.array([lang] * len(c), pa.string()), "n": pa.array([n] * len(c), pa.int32()), "gram": pa.array(list(c), pa.string()), "count": pa.array(list(c.values()), pa.int64())})


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learn from the text and lang of docs that aren't held out. Null langs, and rows with no doc_id, teach nothing. The counts of the sample
    are summed on the executors; the driver gets the most frequent words and n-grams of each language, at most languages *
    (WORDS + LONGEST * GRAMS) of them (or one of each kind for each language)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    n_languages = known.agg(F.count_distinct("lang")).first()[0]
    share = lambda most: most if n_languages <= languages else max(1, most * languages // n_languages)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("k", F.row_number().over(first)).where(F.col("k") <= share(sample)).drop("k")
    # sample * languages ids at most (or one for each language)
    texts = known.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "text")
    total = in_arrow(texts, _counts, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("count"), "gram"))
    kept = total.withColumn("k", rank).where(F.col("k") <= F.when(F.col("n") == 0, share(WORDS)).otherwise(share(GRAMS))).drop("k")
    counts: dict[str, tuple[Counter, dict[int, Counter]]] = {}
    for t in kept.toArrow().to_batches():
        for lang, n, gram, k in zip(*(t.column(c).to_pylist() for c in ("lang", "n", "gram", "count")), strict=True):
            own = counts.setdefault(lang, (Counter(), {}))
            (own[0] if n == 0 else own[1].setdefault(n, Counter()))[gram] = k
    return Model(counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Only the text is looked at. Null or letterless texts: und, 0. Rows that share
    a doc_id, or have none (not held out), each give their row; other columns are ignored."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = spread.value
        for b in slices(batches):
            got = [own.predict(t) for t in b.column("text").to_pylist()]
            out = [d is not None and zlib.crc32(str(d).encode()) % 4 == 2 for d in b.column("doc_id").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id").cast(pa.int64()), "held_out": pa.array(out, pa.bool_()), "lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([x for _, x in got], pa.float64())})

    return in_arrow(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
