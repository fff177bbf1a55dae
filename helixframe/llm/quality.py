"""Quality rules: base rules and robust multivariate outliers.

Each document gets a vector of transformed statistics (mean word length, symbols, repeated lines, repeated words; whole numbers,
so that sums are exact). For each language and source the minimum covariance determinant is sought: from two starts, concentration steps
move to the SHARE of documents with the smallest Mahalanobis distances, and the start that ends with the smaller determinant
stays. A document whose distance from its group's centre exceeds CUTOFF is rejected.

All of it is DataFrame functions and SQL. A concentration step is one aggregation by group and distance bin, a running count over a
group's bins (BINS at most) and sums of whole numbers; no rows of a group ever meet in one task. Variances have a floor (NOISE, in
the units of the transforms): most documents have no symbols at all, and a plain determinant would be zero."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import documents, planned_bytes, stored

SPACE = r"\x20\x09-\x0D"
WINDOW = 5
#: Documents of a group from which it has estimates of its own; smaller ones are pooled by language, then all together.
LEAST = 50
SHARE, STEPS, BINS, FINE = 0.75, 3, 4000, 16
#: 1 / P(chi2(6) < q) * SHARE for q = the SHARE quantile of chi2(4): makes the subset's scatter consistent.
CONSISTENT = 1.4853
#: Quantile of chi2(4) at 1 - 1e-6.
CUTOFF = 33.38
#: Units for each step of a natural logarithm, and standard deviations that no group falls below.
UNIT = 1024
NOISE = (60, 720, 500, 720)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIM = range(4)


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def _repeated(windows: Column, size: int) -> Column:
    """Words covered by windows (their hashes, in order) that occur twice or more."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(size), F.coalesce(F.get(at, i + 1) - p, F.lit(size))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twin = F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        return bound(F.sort_array(F.transform(twin, lambda x: x["i"])), covered)

    sorted_pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(bound(sorted_pairs, places))


def _of_words(text: Column):
    def stats(w: Column) -> Column:
        n = F.size(w)
        hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(n.cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), bound(hashes, lambda h: _repeated(h, WINDOW)).alias("n_repeat_words"))

    return bound(words(text), stats)


def with_base(docs: DataFrame) -> DataFrame:
    """docs with the five numbers of BASE and base_failed, in one struct column `base_stats`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    repeated_lines = bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))

    def whole(s: Column) -> Column:
        failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
        return F.struct(s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), symbols.cast("long").alias("n_symbols"), repeated_lines.alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"))

    return docs.withColumn("base_stats", bound(_of_words(F.col("text")), whole))


def _transforms() -> list[str]:
    logs = (
        "(word_chars + 250.0) / (n_words + 50.0)", "1.0 + 1000.0 * n_symbols / (word_chars + 250.0)",
        "1.0 + 1000.0 * n_dup_lines / (n_words + 50.0)", "1.0 + 100.0 * n_repeat_words / (n_words + 50.0)",
    )
    return [f"CAST(floor({UNIT} * ln(CAST({x} AS DOUBLE))) AS BIGINT)".replace("250.0", "CAST(250 AS DOUBLE)").replace("1000.0", "CAST(1000 AS DOUBLE)").replace("100.0", "CAST(100 AS DOUBLE)").replace("50.0", "CAST(50 AS DOUBLE)").replace("1.0 ", "CAST(1 AS DOUBLE) ") for x in logs]


SUMS = [*(f"t{i}" for i in DIM), *(f"t{i} * t{j}" for i in DIM for j in range(i + 1))]
NAMES = [*(f"s{i}" for i in DIM), *(f"s{i}{j}" for i in DIM for j in range(i + 1))]


def _sum(terms: str, name: str) -> str:
    return f"CAST(sum({terms}) AS BIGINT) AS {name}"


def _cholesky(source: str, name: str) -> list[str]:
    """From m0.., c00.. (centre and scatter) of a group: the inverse w of the scatter's Cholesky factor, and its determinant. In steps, as common table expressions."""
    keep, out, last = "g, start, n, m0, m1, m2, m3", [], source
    for i in DIM:
        row = []
        for j in range(i):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"{name}_l{i}{j} AS (SELECT *, (c{i}{j}{inner}) / l{j}{j} AS l{i}{j} FROM {last})")
            last = f"{name}_l{i}{j}"
            row.append(f" - l{i}{j} * l{i}{j}")
        out.append(f"{name}_l{i}{i} AS (SELECT *, sqrt(c{i}{i}{''.join(row)}) AS l{i}{i} FROM {last})")
        last = f"{name}_l{i}{i}"
    inverse: dict[tuple[int, int], str] = {}
    for i in DIM:
        columns = []
        for j in range(i + 1):
            inner = " + ".join(f"l{i}{k} * w{k}{j}" for k in range(j, i))
            columns.append(f"1 / l{i}{i} AS w{i}{i}" if i == j else f"-({inner}) / l{i}{i} AS w{i}{j}")
            inverse[i, j] = f"w{i}{j}"
        out.append(f"{name}_w{i} AS (SELECT *, {', '.join(columns)} FROM {last})")
        last = f"{name}_w{i}"
    out.append(f"{name} AS (SELECT {keep}, l00 * l11 * l22 * l33 AS det, {', '.join(inverse.values())} FROM {last})")
    return out


def _distance() -> str:
    rows = [" + ".join(f"w{i}{j} * (t{j} - m{j})" for j in range(i + 1)) for i in DIM]
    return " + ".join(f"({r}) * ({r})" for r in rows)


def groups_sql() -> list[str]:
    """Common table expressions from `stats` up to `x`: all documents with their group g and transforms t0..; `e`: those that estimates are
    made from."""
    return f"""u AS (SELECT *, coalesce(lang, '') AS own_lang, coalesce(source, '') AS own_source FROM stats),
sized AS (SELECT own_lang, own_source, CAST(sum(CASE WHEN base_failed THEN 0 ELSE 1 END) AS BIGINT) AS n FROM u GROUP BY own_lang, own_source),
pooled AS (SELECT own_lang, own_source, n, CAST(sum(CASE WHEN n < {LEAST} THEN n ELSE 0 END) OVER (PARTITION BY own_lang) AS BIGINT) AS n_lang FROM sized),
named AS (SELECT own_lang, own_source, CASE WHEN n >= {LEAST} THEN 's:' || own_lang || ':' || own_source WHEN n_lang >= {LEAST} THEN 'l:' || own_lang ELSE 'all' END AS g FROM pooled),
x AS (SELECT u.*, named.g, {", ".join(f"{t} AS t{i}" for i, t in enumerate(_transforms()))} FROM u JOIN named ON u.own_lang = named.own_lang AND u.own_source = named.own_source),
e AS (SELECT g, t0, t1, t2, t3 FROM x WHERE NOT base_failed)""".split(",\n")


def _moments(source: str, name: str) -> str:
    centre = ", ".join(f"CAST(s{i} AS DOUBLE) / k AS m{i}" for i in DIM)
    scatter = ", ".join(f"(CAST(s{i}{j} AS DOUBLE) / k - (CAST(s{i} AS DOUBLE) / k) * (CAST(s{j} AS DOUBLE) / k)) * {{c}}" + (f" + {NOISE[i] ** 2}" if i == j else "") + f" AS c{i}{j}" for i in DIM for j in range(i + 1))
    return f"{name} AS (SELECT g, start, n, {centre}, {scatter.replace('{c}', str(CONSISTENT))} FROM {source} WHERE k > 0)"


def estimates_sql() -> list[str]:
    """Common table expressions from `e` to `best`: g, centre m0.. and factor w00.. of each group."""
    sums = ", ".join(_sum(s, n) for s, n in zip(SUMS, NAMES, strict=True))
    middle = ", ".join(f"CAST(MEDIAN(t{i}, 0.5) AS DOUBLE) AS q{i}" for i in DIM)
    spread = ", ".join(f"CAST(MEDIAN(abs(t{i} - q{i}), 0.5) AS DOUBLE) * 1.4826 AS d{i}" for i in DIM)
    diagonal = ", ".join(f"d{i} * d{i} + {NOISE[i] ** 2} AS c{i}{i}" if i == j else f"CAST(0 AS DOUBLE) AS c{i}{j}" for i in DIM for j in range(i + 1))
    out = [
        f"mid AS (SELECT g, count(*) AS n, {middle} FROM e GROUP BY g)",
        f"mad AS (SELECT e.g AS g, max(n) AS n, {', '.join(f'max(q{i}) AS m{i}' for i in DIM)}, {spread} FROM e JOIN mid ON e.g = mid.g GROUP BY e.g)",
        f"all0 AS (SELECT g, 1 AS start, count(*) AS n, count(*) AS k, {sums} FROM e GROUP BY g)",
        _moments("all0", "all1"),
        f"begin0 AS (SELECT g, 0 AS start, n, m0, m1, m2, m3, {diagonal} FROM mad UNION ALL SELECT * FROM all1)",
        *_cholesky("begin0", "f0"),
    ]
    for step in range(1, STEPS + 1):
        was = f"f{step - 1}"
        out += [
            f"d{step} AS (SELECT e.g AS g, start, n, t0, t1, t2, t3, least({BINS}, CAST(floor({FINE} * ({_distance()})) AS BIGINT)) AS bin FROM e JOIN {was} ON e.g = {was}.g)",
            f"b{step} AS (SELECT g, start, n, bin, count(*) AS k, {sums} FROM d{step} GROUP BY g, start, n, bin)",
            f"r{step} AS (SELECT *, CAST(sum(k) OVER (PARTITION BY g, start ORDER BY bin) AS BIGINT) - k AS before FROM b{step})",
            f"h{step} AS (SELECT g, start, max(n) AS n, CAST(sum(k) AS BIGINT) AS k, {', '.join(_sum(x, x) for x in NAMES)} FROM r{step} WHERE before < {SHARE} * n GROUP BY g, start)",
            _moments(f"h{step}", f"m{step}"),
            *_cholesky(f"m{step}", f"f{step}"),
        ]
    final = f"f{STEPS}"
    columns = ", ".join([*(f"m{i}" for i in DIM), *(f"w{i}{j}" for i in DIM for j in range(i + 1))])
    out.append(f"best AS (SELECT g, {columns} FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY det, start) AS nth FROM {final}) ranked WHERE nth = 1)")
    return out


#: Tables of a row or two for each group. They are written, so that the plan of a step doesn't hold the steps before.
SMALL = {"named", *(f"f{step}" for step in range(STEPS + 1))}
VERDICT = f"NOT base_failed AND coalesce({_distance()} <= {CUTOFF}, true)"


def judged(stats: DataFrame) -> DataFrame:
    """stats (stored; with lang, source, BASE and base_failed) with the column kept. Without a row that passes the base rules
    there are no estimates, and those rules decide."""
    spark, tables = stats.sparkSession, {"stats": stats}

    def run(query: str) -> DataFrame:
        """Each expression is analysed by itself: one statement of them all is too deep for the analyser, and for the driver's memory."""
        used = dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", query))
        return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2} \2", query), **{k: tables[k] for k in used})

    for x in [*groups_sql(), *estimates_sql()]:
        name, _, query = x.partition(" AS ")
        found = run(query.strip()[1:-1].replace("MEDIAN", "percentile"))
        tables[name] = stored(found, name, 0) if name in SMALL else found
    columns = ", ".join(f"x.`{c}`" for c in stats.columns)
    return run(f"SELECT {columns}, {VERDICT} AS kept FROM x LEFT JOIN best ON x.g = best.g")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed, kept of each row. Needs doc_id, text, lang, source; ignores other columns. A null or empty text has no words and fails
    the base rules. Null languages and sources are groups like others. Rows that share a doc_id, or have none, are judged each
    by its own text."""
    stats = with_base(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", "base_stats.*")
    return judged(stored(stats, "quality", planned_bytes(docs))).select("doc_id", *BASE, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row")
    stats = stored(with_base(docs.select(whole, "doc_id", "text", "lang", "source")).select("whole_row", "doc_id", "lang", "source", "base_stats.*"), "quality", planned_bytes(docs))
    return judged(stats).where("kept").select("whole_row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


_STATS = rf"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w FROM documents),
runs AS (SELECT doc_id, i, w[i : i + {WINDOW - 1}] AS run FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 2}))) AS i FROM w) y),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS k FROM runs) y WHERE k > 1),
covered AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n_repeat_words FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS step FROM twice) y GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')))) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
stats AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)"""
OP1_SQL = "WITH " + ",\n".join([_STATS, *groups_sql(), *estimates_sql()]).replace("MEDIAN", "quantile_cont") + f"\nSELECT doc_id, {', '.join(BASE)}, base_failed, {VERDICT} AS kept FROM x LEFT JOIN best ON x.g = best.g"
