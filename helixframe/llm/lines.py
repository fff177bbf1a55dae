"""Line dedup by spread over sites.

For each distinct line (128 bits of hash) the sites that have it are counted by HyperLogLog sketches, which merge by aggregation. Lines
whose estimate lies within MARGIN of the threshold get an exact distinct count. A line on SITES sites or more is boilerplate: it goes
from every document but one (that of the smallest doc_id, at its first place), so that nothing is lost from the corpus as a whole.

All of it is DataFrame functions. Rows are hashes, not texts, until the documents are put together again; a very common line is
counted map-side first, and its join to the documents is of the kind that Spark splits when a partition is skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import documents
from helixframe.llm.quality import SPACE, bound

SITES, MARGIN, LG_K = 10, 0.25, 12
BLANKS = " \t\n\x0b\x0c\r"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, site, at (from 0), h1, h2 of each line that isn't blank."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("source"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    line = _trimmed(F.col("line"))
    return lines.where(line != "").select("doc_id", "text_hash", "site", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """h1, h2, first (doc_id and place of the one that stays) of lines on so many sites or more."""
    first = F.min(F.struct("doc_id", "at")).alias("first")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), first).withColumn("about", F.hll_sketch_estimate("sketch")).drop("sketch")
    likely = spread.where(F.col("about") >= int(sites * (1 - MARGIN)))
    near = likely.where(F.col("about") <= sites * (1 + MARGIN))
    exact = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("exact"))
    counted = near.join(exact, ["h1", "h2"]).where(F.col("exact") >= sites)
    return likely.where(F.col("about") > sites * (1 + MARGIN)).select("h1", "h2", "first").unionByName(counted.select("h1", "h2", "first"))


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """row (all columns of docs), doc_id, text, source, line_dropped (places of lines that go, from 0; null for none) and line_text (what stays).

    A line is what lies between line feeds; it is compared without white space at its ends, and blank lines stay. Null and
    empty texts stay as they are. A null source is a site like others. Rows that share doc_id and text are treated alike. Of a null doc_id's lines the first one
    counts as the smallest."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", "source")
    lines = line_hashes(docs)
    hit = lines.join(boilerplate(lines, sites), ["h1", "h2"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at"))))
    gone = hit.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(F.collect_set("at").alias("line_dropped"))
    back = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left").drop("gone_id", "gone_hash")

    def left(parts: Column) -> Column:
        places = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("line_dropped")))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    kept = F.when(F.col("line_dropped").isNull(), F.col("text")).otherwise(bound(F.split("text", "\n", -1), left))
    return back.withColumn("line_text", kept)


def without_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines taken out of text (and n_chars, where there is one, counted anew). Documents that have lost their
    last word by it go: all they held stays elsewhere."""
    out = dedup_lines(docs, sites).where(F.col("line_dropped").isNull() | (_trimmed(F.col("line_text")) != ""))
    changed = {"text": F.col("line_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("line_dropped").isNull(), F.col("row.n_chars")).otherwise(F.length("line_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, kept_sha256 (of the text that stays; null counts as empty)."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: _trimmed(x) != ""))
    sha = F.sha2(F.coalesce(F.col("line_text"), F.lit("")).cast("binary"), 256)
    return dedup_lines(docs).select("doc_id", lines.cast("long").alias("n_lines"), F.coalesce(F.size("line_dropped"), F.lit(0)).cast("long").alias("n_removed"), sha.alias("kept_sha256"))


OP5_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, site, pos, parts[pos] AS raw, trim(parts[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM t) y),
b AS (SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
m AS (SELECT l.doc_id, l.pos, l.raw, l.line, b.line IS NOT NULL AND NOT (b.first.doc_id = l.doc_id AND b.first.pos = l.pos) AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, CAST(count(*) FILTER (line <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
