"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from helixframe.llm import queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op1_quality']}) x WHERE kept").fetchall()}
    docs = [r for r in con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    docs = [(d, left, s) for (d, _, s), (_, removed, left) in zip(docs, brute.boilerplate(docs), strict=True) if not removed or left.strip(brute.BLANK)]
    classes = brute.near_classes([t for _, t, _ in docs])
    docs = [r for i, r in enumerate(docs) if classes[i] == i]
    left = []
    for (d, t, _), g in zip(docs, brute.repeated_bytes([t for _, t, _ in docs]), strict=True):
        text = np.frombuffer(t.encode(), np.uint8)[~g].tobytes().decode("utf-8", "ignore") if g.any() else t
        if not g.any() or text.strip(brute.BLANK):
            left.append((d, text))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in left:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or min(len(ids), 1024)
        for a, z in zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids), 1024), len(ids)], strict=True):
            want[d, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), SF).count() == 0
