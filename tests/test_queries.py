"""Every query of the catalog against its SQL in another engine, on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from helixframe.plans import catalog
from helixframe.plans import views as V

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    rows = [tuple(None if pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalog.SQL[name]).df())


def test_assembly_regions_tile_the_contigs(spark):
    rows = catalog.QUERIES["assembly_regions"](spark, SF).toPandas().sort_values(["contig", "start"])
    for (_, name, n) in V.CONTIGS:
        r = rows[rows.contig == name]
        assert r.start.iloc[0] == 1 and r.end.iloc[-1] == n and (r.start.iloc[1:].to_numpy() == r.end.iloc[:-1].to_numpy() + 1).all() and (r.end - r.start < 300).all()


def test_calls_are_the_planted_ones(spark):
    got = {(r.contig, r.pos): (r.ref, r.alt, r.gt) for r in catalog.QUERIES["call_variants"](spark, SF).collect()}
    want = {}
    for i, name, n in V.CONTIGS:
        for p in range(100, n + 1, 211):
            code = ((p * p * 31 + p * 7919 + i * 1013) % 10007) % 4
            want[name, p] = ("ACGT"[code], "ACGT"[(code + 1) % 4], "1/1" if p % 3 == 1 else "0/1")
    assert len(got) >= 30 and all(want[k] == v for k, v in got.items())


def test_quantized_qualities(spark):
    table = [r.stands_for for r in sorted(catalog.QUERIES["bqsr_quantize"](spark, SF).collect())]
    assert len(table) == 94 and len(set(table[7:])) <= 16 and all(1 <= q <= 93 for q in table[1:])


def test_merged_split_equals_filtered(spark):
    """merge(filter(split(x))) = filter(x), duplicates included."""
    from pyspark.sql import functions as F

    from helixframe.operators import duplicates, filters, splitting

    reads = filters.without_spread_copies(V.reads(spark, SF), True).withColumn("rnext", F.when((F.col("k") % 7 == 0) & (F.col("rnext") == "="), "chr1").otherwise(F.col("rnext")))
    groups = splitting.contig_groups([(n, x) for _, n, x in V.CONTIGS])
    f = lambda r: filters.mapping_quality(filters.mapped(r), 20)
    through = splitting.merge(f(splitting.split(reads, groups)))
    assert {tuple(r) for r in duplicates.mark(through).select("idx", "flag").collect()} == {tuple(r) for r in duplicates.mark(f(reads)).select("idx", "flag").collect()}


def test_sam_header_writes_all_rows(spark, monkeypatch):
    from helixframe.plans import file_queries

    written, write = [], file_queries.sam.write
    monkeypatch.setattr(file_queries.sam, "write", lambda rows, *rest: (written.append(rows.count()), write(rows, *rest)))
    catalog.QUERIES["sam_header"](spark, SF)
    assert written == [V.reads(spark, SF).count()]


def test_repeated_sites_are_flattened_whatever_their_order(spark, tmp_path):
    """Many events with one interval: neighbours stay apart, and no order of equal rows counts."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 54_000  # each interval twice
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64())}), tmp_path / "events.parquet")
    got = sorted(map(tuple, catalog.QUERIES["intervals_flatten"](spark, str(tmp_path)).select("chrom", "start", "end").collect()))
    want = []
    for chrom, start, end in sorted({(f"chr{1 + e % 4}", e * 131 % 27_000, e * 131 % 27_000 + 1 + e % 12) for e in range(n)}):
        if want and want[-1][0] == chrom and start <= want[-1][2]:
            want[-1] = (chrom, want[-1][1], max(end, want[-1][2]))
        else:
            want.append((chrom, start, end))
    assert got == want and all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:], strict=False))
    plan = catalog.QUERIES["intervals_flatten"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "max(end" in plan.replace("`", "").split("Window")[-1]  # equal starts are reduced before any window


def test_streamed_rows_are_spread_over_more_files_as_they_grow(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from helixframe.plans import file_queries

    pq.write_table(pa.table({"o_orderkey": pa.array(range(120_000), pa.int64())}), tmp_path / "orders.parquet")
    seen, stream = [], file_queries.streams.stream
    monkeypatch.setattr(file_queries.streams, "stream", lambda s, source, *rest: (seen.append((len(list(__import__("pathlib").Path(source).glob("*.parquet"))), rest[-1])), stream(s, source, *rest))[1])
    out = catalog.QUERIES["stream_filter"](spark, str(tmp_path))
    assert seen == [(6, 3)] and out.count() == V.reads(spark, str(tmp_path)).where("(flag & 4) = 0 AND mapq >= 20").count()
