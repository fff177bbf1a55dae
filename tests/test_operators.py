"""Edge cases of single operators, by hand or against sequential models."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.functions import columns as C
from helixframe.operators import duplicates, filters, intervals, pileup, recalibration, report, sorting, splitting
from helixframe.operators.pipeline import Options, run
from helixframe.schema import READ
from helixframe.sources import bam, fasta, sam, variants
from helixframe.sources.headers import Header, merge, parse, text, with_dictionary, with_program


def reads(spark, rows):
    base = {"idx": 0, "qname": "q", "flag": 0, "rname": "c", "pos": 1, "mapq": 60, "cigar": "4M", "rnext": "*", "pnext": 0, "tlen": 0, "seq": "ACGT", "qual": [30] * 4, "tags": [("RG", "Z", "g")]}
    return spark.createDataFrame([tuple((base | {"idx": i} | r)[n] for n in READ.names) for i, r in enumerate(rows)], READ)


FLATTEN = [
    ([], []), ([(2, 3), (3, 4)], [(2, 4)]), ([(2, 3), (4, 5)], [(2, 3), (4, 5)]), ([(2, 4), (3, 5), (4, 6)], [(2, 6)]), ([(2, 4), (3, 5), (4, 6), (7, 9)], [(2, 6), (7, 9)]),
    ([(2, 3), (3, 4), (5, 6), (6, 7)], [(2, 4), (5, 7)]), ([(2, 3), (2, 5), (2, 4), (2, 3), (2, 6), (2, 7)], [(2, 7)]),
]


def test_flatten(spark):
    rows = [(f"c{k}", a, b) for k, (given, _) in enumerate(FLATTEN) for a, b in given]
    got = {tuple(r) for r in intervals.flattened(spark.createDataFrame(rows, "chrom string, start int, end int")).collect()}
    assert got == {(f"c{k}", a, b) for k, (_, want) in enumerate(FLATTEN) for a, b in want}


def test_flatten_random(spark):
    rng, rows, at = random.Random(0), [], 0
    for _ in range(20_000):
        start = max(0, at - 1) if rng.random() < 0.2 else at + 1
        at = start + rng.choice([3, 3, 3, 200_000])
        rows.append(("c", start, at))
    want: list[list[int]] = []
    for _, a, b in sorted(rows):
        if want and a <= want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    rng.shuffle(rows)
    got = sorted([r.start, r.end] for r in intervals.flattened(spark.createDataFrame(rows, "chrom string, start int, end int")).collect())
    assert got == want


def test_overlap_and_intersect(spark):
    near = spark.createDataFrame([("c", 2, 4), ("c", 6, 8)], "chrom string, start int, end int")
    yes = [(1, 3), (2, 3), (2, 5), (3, 7), (5, 7), (6, 8), (6, 9), (5, 9), (1, 10), (4, 5)]
    no = [(1, 2), (0, 1), (9, 12), (5, 6)]
    got = {(r.start, r.end): r.overlaps for r in intervals.overlaps(spark.createDataFrame([("c", *p) for p in yes + no] + [("d", 1, 9)], "chrom string, start int, end int"), near).collect()}
    assert got == {**{p: True for p in yes}, **{p: False for p in no}, (1, 9): False}
    pairs = intervals.intersecting(spark.createDataFrame([("c", 4, 6), ("c", 1, 3), ("c", 5, 5), ("c", 0, 5000)], "chrom string, start int, end int"), near).collect()
    found = defaultdict(set)
    for r in pairs:
        found[r.query_start, r.query_end].add((r.start, r.end))
    assert dict(found) == {(4, 6): {(2, 4), (6, 8)}, (1, 3): {(2, 4)}, (0, 5000): {(2, 4), (6, 8)}}


def test_overlap_without_broadcast_and_over_bins(spark):
    rows = reads(spark, [{"pos": 1000, "cigar": "3000M"}, {"pos": 5000, "cigar": "10M"}, {"pos": 5000, "cigar": "*", "flag": 4}])
    regions = spark.createDataFrame([("c", 3500, 3501), ("c", 4999, 5000)], "chrom string, start int, end int")
    for most in (0, 1000):
        assert {r.idx for r in filters.overlapping_regions(rows, regions, most).collect()} == {0, 1, 2}


def test_clean_cigars(spark):
    d = spark.createDataFrame([(0, "c", 100)], "refid int, sn string, ln int")
    cases = {"50M": "41M9S", "5S45M": "5S41M4S", "45M5S": "41M9S", "5H45M5H": "5H41M4S5H", "41M9I5M": "41M14S", "30M3D20M": "30M3D8M12S", "41M2D9M": "41M9S"}
    rows = [{"pos": 60, "cigar": c} for c in cases] + [{"pos": 60, "cigar": "50M", "flag": 4}, {"pos": 51, "cigar": "50M"}]
    got = [r.cigar for r in filters.cleaned(reads(spark, rows), d).orderBy("idx").collect()]
    assert got == [*cases.values(), "50M", "50M"]


def test_third_read_starts_a_new_pair(spark):
    rows = [{"qname": "a", "flag": 1, "pos": p} for p in (10, 20, 30)] + [{"qname": "b", "flag": 1, "pos": p} for p in (10, 20)]
    r = filters.with_reference_ids(reads(spark, rows), spark.createDataFrame([(0, "c", 100)], "refid int, sn string, ln int")).withColumn("lb", F.lit("l"))
    mates = duplicates.pairs(duplicates.eligible(r)).collect()
    assert sorted((m.qname, m.a.idx, m.b.idx) for m in mates) == [("a", 0, 1), ("b", 3, 4)]
    assert {x.idx for x in duplicates.mark(r).where(F.col("flag").bitwiseAND(1024) != 0).collect()} == {3, 4}


def model_of_marking(rows):
    """One read after the other, as they come."""
    best_fragment, best_pair, waiting, out = {}, {}, {}, set()
    pair_ends = set()
    for r in rows:
        if r["flag"] & 9 == 1:
            pair_ends.add(r["key"])
    for r in rows:
        if r["flag"] & 9 != 1:
            if r["key"] in pair_ends:
                out.add(r["idx"])
                continue
            old = best_fragment.get(r["key"])
            if old is None or (-r["score"], r["qname"], r["idx"]) < (-old["score"], old["qname"], old["idx"]):
                best_fragment[r["key"]] = r
                if old is not None:
                    out.add(old["idx"])
            else:
                out.add(r["idx"])
            continue
        mate = waiting.pop(r["qname"], None)
        if mate is None:
            waiting[r["qname"]] = r
            continue
        a, b = sorted((mate, r), key=lambda x: (x["key"], x["idx"]))
        new = (-(a["score"] + b["score"]), a["qname"], a["idx"]), (a, b)
        old = best_pair.get((a["key"], b["key"]))
        if old is None or new[0] < old[0]:
            best_pair[a["key"], b["key"]] = new
            if old is not None:
                out |= {x["idx"] for x in old[1]}
        else:
            out |= {a["idx"], b["idx"]}
    return out


def test_marking_against_a_sequential_model(spark):
    rng, rows = random.Random(6), []
    for i in range(400):
        paired = rng.random() < 0.7
        for m in range(2 if paired else 1):
            rows.append({"qname": f"q{i}", "flag": (1 if paired else 0) | 16 * rng.randrange(2), "pos": rng.randrange(1, 6), "cigar": "4M", "qual": [rng.choice([10, 20, 30]) for _ in range(4)]})
    given = [r | {"idx": i} for i, r in enumerate(rows)]
    for r in given:
        rev = bool(r["flag"] & 16)
        r["key"], r["score"] = (r["pos"] + 3 if rev else r["pos"], rev), sum(q for q in r["qual"] if q >= 15)
    frame = filters.with_reference_ids(reads(spark, rows), spark.createDataFrame([(0, "c", 100)], "refid int, sn string, ln int")).withColumn("lb", F.lit(None).cast("string"))
    got = {r.idx for r in duplicates.mark(frame).where(F.col("flag").bitwiseAND(1024) != 0).collect()}
    assert got == model_of_marking(given)


def test_clusters():
    import numpy as np

    rng = np.random.default_rng(2)
    g, x, y = rng.integers(0, 6, 300), rng.integers(0, 2500, 300), rng.integers(0, 2500, 300)
    got = duplicates.clusters(g, x, y, 100)
    parent = list(range(300))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(300):
        for j in range(i):
            if g[i] == g[j] and abs(x[i] - x[j]) <= 100 and abs(y[i] - y[j]) <= 100:
                parent[root(i)] = root(j)
    same = {}
    assert all(same.setdefault(root(i), c) == c for i, c in enumerate(got.tolist())) and len(set(got.tolist())) == len({root(i) for i in range(300)})


def test_static_levels():
    assert recalibration.static_levels([15])[6:] == [15] * 248 and recalibration.static_levels([15])[:6] == list(range(6))
    got = recalibration.static_levels([30, 10, 20])
    assert got[5:8] == [5, 6, 10] and got[10] == 10 and got[11] == 20 and got[20] == 20 and got[21] == 30 and got[253] == 30
    with pytest.raises(ValueError):
        recalibration.static_levels([94])


def test_dynamic_levels():
    counts = [0] * 94
    for q, n in ((10, 1000), (11, 900), (30, 5000), (31, 4000), (40, 10)):
        counts[q] = n
    assert recalibration.quantized(counts, 0) == list(range(94))
    table = recalibration.quantized(counts, 4)
    assert len(set(table)) <= 4 and table[10] == table[11] and table[30] - table[10] > 10


def test_recalibration_with_indels_and_sites(spark):
    ref = "ACGTACGTTTGCAAGCTA"
    d = spark.createDataFrame([(0, "c", len(ref))], "refid int, sn string, ln int")
    groups = spark.createDataFrame([("g", "l", None, "s")], "id string, lb string, pu string, sm string")
    # ACGT | insertion GG | ACGT -> deletes TT -> GCAA
    rows = reads(spark, [{"pos": 1, "cigar": "4M2I4M2D4M", "seq": "ACGTGGACGAGCAA", "qual": [30] * 14}])
    chunks = spark.createDataFrame([("c", 0, ref)], "contig string, chunk int, bases string")
    got = recalibration.observations(rows, d, groups, chunks).collect()
    assert len(got) == 14 and sum(r.mismatch for r in got) == 1
    near = spark.createDataFrame([("c", 8, 8)], "chrom string, start int, end int")
    assert sum(r.mismatch for r in recalibration.observations(rows, d, groups, chunks, near).collect()) == 0
    with pytest.raises(Exception, match="no read group|RG"):
        recalibration.group_covariate(rows.withColumn("tags", F.array().cast(READ["tags"].dataType)), groups).collect()


def test_pileup_of_a_deletion(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGTACGTAC")], "contig string, chunk int, bases string")
    rows = reads(spark, [{"pos": 1, "cigar": "3M2D3M", "seq": "ACGCGT", "qual": [30] * 6}])
    got = {r.pos: (r.op, r.base, r.alt, r.alt_before) for r in pileup.elements(rows, chunks).collect()}
    assert got[4] == ("D", None, True, True) and got[3] == ("M", "G", False, True) and got[6] == ("M", "C", False, True) and got[2] == ("M", "C", False, False) and len(got) == 8


HEADER = parse(["@HD\tVN:1.6\tSO:coordinate", "@SQ\tSN:c\tLN:100", "@SQ\tSN:d\tLN:50", "@RG\tID:g\tLB:l\tSM:s", "@PG\tID:p", "@CO\thello", "@sr\tco:split"])


def test_headers():
    assert parse(text(HEADER).splitlines()) == HEADER and HEADER.order == "coordinate" and HEADER.dictionary() == [(0, "c", 100), (1, "d", 50)]
    with pytest.raises(ValueError):
        parse(["@SQ\tSN:c\tLN:1", "@HD\tVN:1"])
    with pytest.raises(ValueError):
        parse(["@XX\tSN:c"])
    more = with_program(HEADER, "p", "1", "x y", seed=1)
    assert more.pg[1]["PP"] == "p" and more.pg[1]["ID"].startswith("p.")
    assert with_dictionary(HEADER, [{"SN": "d", "LN": "50"}, {"SN": "c", "LN": "100"}]).order == "unknown"
    assert with_dictionary(HEADER, [{"SN": "c", "LN": "100"}]).order == "coordinate"
    other = parse(["@SQ\tSN:b\tLN:9", "@SQ\tSN:d\tLN:50", "@RG\tID:g\tLB:other", "@RG\tID:h"])
    both, groups, _ = merge([HEADER, other])
    names = [r["SN"] for r in both.sq]
    assert names.index("c") < names.index("d") and names.index("b") < names.index("d") and groups == [{}, {"g": "g.1"}] and {r["ID"] for r in both.rg} == {"g", "g.1", "h"}
    with pytest.raises(ValueError):
        merge([parse(["@SQ\tSN:a\tLN:1", "@SQ\tSN:b\tLN:1"]), parse(["@SQ\tSN:b\tLN:1", "@SQ\tSN:a\tLN:1"])])


def test_alignment_files(spark, tmp_path):
    rows = [
        {"qname": f"r{i}", "flag": 16 * (i % 2), "rname": ("c", "*")[i % 5 == 0], "pos": 0 if i % 5 == 0 else 1 + i % 90, "cigar": "*" if i % 5 == 0 else "4M", "seq": ("ACGT", "NACG", None)[i % 3], "qual": ([30, 2, 93, 0], [1, 2, 3, 4], None)[i % 3],
         "tags": [("RG", "Z", "g"), ("X0", "i", str(i - 5)), ("XA", "A", "q"), ("XF", "f", "1.5"), ("XB", "B", "s,1,-2,3"), ("XH", "H", "1AE3")], "rnext": "d", "pnext": 7, "tlen": -3}
        for i in range(300)
    ]
    frame = reads(spark, rows).repartition(3)
    want = sorted(str(tuple(r)[1:]) for r in frame.collect())
    sam.write(frame, HEADER, str(tmp_path / "sam"))
    assert sam.header(spark, str(tmp_path / "sam")) == HEADER
    assert sorted(str(tuple(r)[1:]) for r in bam.reads_of(spark, str(tmp_path / "sam")).collect()) == want
    bam.write(frame, HEADER, str(tmp_path / "bam"))
    for size in (64, 500, 1 << 20):
        assert sorted(str(tuple(r)[1:]) for r in bam.read(spark, str(tmp_path / "bam"), size).collect()) == want
    assert sorted(str(tuple(r)[1:]) for r in bam.reads_of(spark, str(tmp_path / "bam")).collect()) == want
    assert bam.read_header(bam.listed(str(tmp_path / "bam"), ".bam")[0])[0] == HEADER


def test_pipeline_leaves_the_header_given_to_it(spark):
    head = Header(sq=HEADER.sq, rg=HEADER.rg, user={"@sr": [{"co": "x"}], "@xy": []})
    got = run(reads(spark, [{"qname": "a"}]), head, Options(remove_optional_reads=True))
    assert "@sr" in head.user and list(got.header.user) == ["@xy"]


def test_alignment_files_by_format_or_ending(spark, tmp_path):
    frame = reads(spark, [{"qname": f"r{i}", "cigar": "4M", "seq": "ACGT", "qual": [30] * 4} for i in range(20)]).coalesce(1)
    for name, kind, compressed in (("a.bam", None, True), ("b.BAM", None, True), ("c.sam", None, False), ("d.txt", None, False), ("e", None, False), ("f.sam", "bam", True), ("g.bam", ".SAM", False)):
        path = str(tmp_path / name)
        bam.write_reads(frame, HEADER, path, kind)
        assert bool(bam.listed(path, ".bam")) == compressed
        assert sorted(r.qname for r in bam.reads_of(spark, path).collect()) == sorted(f"r{i}" for i in range(20))
    for name, kind in (("h.cram", None), ("i.bam", "CRAM")):
        with pytest.raises(ValueError):
            bam.write_reads(frame, HEADER, str(tmp_path / name), kind)
        assert not (tmp_path / name).exists()


def test_large_bam_is_read_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    frame = reads(spark, [{"qname": f"read{i}", "seq": "".join(rng.choice("ACGT") for _ in range(100)), "qual": [rng.randrange(60) for _ in range(100)], "cigar": "100M"} for i in range(3000)]).coalesce(1)
    bam.write(frame, HEADER, str(tmp_path / "bam"))
    for size in (20_000, 70_000):
        got = bam.read(spark, str(tmp_path / "bam"), size).orderBy("idx").collect()
        assert [r.qname for r in got] == [f"read{i}" for i in range(3000)]


def test_fasta(spark, tmp_path):
    path = tmp_path / "r.fa"
    path.write_text(">c one\nACGTNRYacgt\nACGTA\n>d\nTTTT\n>e\n")
    index = fasta.make_index(str(path))
    assert [(c, n) for c, n, *_ in index] == [("c", 16), ("d", 4), ("e", 0)]
    (tmp_path / "r.fai").write_text("".join("\t".join(map(str, r)) + "\n" for r in index))
    assert [tuple(r) for r in fasta.read_index(spark, str(tmp_path / "r.fai")).collect()] == index
    for chunk in (3, 5, 100):
        read = fasta.read(spark, str(path), index, chunk)
        whole = defaultdict(str)
        for r in read.orderBy("contig", "chunk").collect():
            whole[r.contig] += r.bases
        assert whole == {"c": "ACGTNNNACGTACGTA", "d": "TTTT", "e": ""}
        assert fasta.sequence(read, "c", 4, 9, chunk).first().bases == "TNNNAC"
    fasta.write_parquet(fasta.read(spark, str(path), index, 5), str(tmp_path / "p"))
    assert fasta.open_parquet(spark, str(tmp_path / "p")).count() == 6


def test_variants(spark, tmp_path):
    (tmp_path / "v.vcf").write_text('##fileformat=VCFv4.2\n##INFO=<ID=DP,Number=1,Type=Integer,Description="x">\n##INFO=<ID=AF,Number=A,Type=Float,Description="x">\n##INFO=<ID=DB,Number=0,Type=Flag,Description="x">\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nc\t5\t.\tACG\tA,<DEL>\t12.50\tPASS\tDP=3;AF=0.5,0.25;DB;END=9\tGT:DP\t0|1:7\t./.\nc\t9\tx;y\tA\t.\t.\t.\t.\n')
    v = variants.read_vcf(spark, str(tmp_path / "v.vcf"))
    h = variants.vcf_header(spark, str(tmp_path / "v.vcf"))
    a, b = variants.typed(v, h, ["DP", "AF", "DB"]).orderBy("pos").collect()
    assert (a.DP, a.AF, a.DB, a.alt, a.qual) == (3, [0.5, 0.25], True, ["A", "<DEL>"], 12.5) and a.genotypes[0].phased and a.genotypes[0].gt == [0, 1] and a.genotypes[1].gt == [-1, -1]
    assert (b.id, b.alt, b.qual, b.DB) == (["x", "y"], [], None, False) and h.samples == ["a", "b"]
    lines = [r.value for r in variants.vcf_lines(v).collect()]
    assert lines[0] == "c\t5\t.\tACG\tA,<DEL>\t12.50\tPASS\tDP=3;AF=0.5,0.25;DB;END=9\tGT:DP\t0|1:7\t./.:." and lines[1] == "c\t9\tx;y\tA\t.\t.\t.\t."
    assert [tuple(r) for r in intervals.from_variants(v).orderBy("start").collect()] == [("c", 5, 9), ("c", 9, 9)]
    assert [tuple(r) for r in intervals.from_variants(v, use_info_end=False).orderBy("start").collect()] == [("c", 5, 7), ("c", 9, 9)]
    d = spark.createDataFrame([(0, "d", 9), (1, "c", 9)], "refid int, sn string, ln int")
    assert [r.chrom for r in variants.concatenated([v, v.withColumn("chrom", F.lit("d"))], d).collect()] == ["d", "d", "c", "c"]
    (tmp_path / "r.bed").write_text("# x\ntrack name\nc\t5\t9\tn\t500\t-\n\nc\t1\t2\n")
    assert [(r.chrom, r.start, r.end, r.score, r.strand) for r in variants.read_bed(spark, str(tmp_path / "r.bed")).orderBy("start").collect()] == [("c", 1, 2, None, None), ("c", 5, 9, 500, "-")]
    (tmp_path / "bad.bed").write_text("c\t5\t9\tn\t5000\t-\n")
    with pytest.raises(Exception, match="not a BED line"):
        variants.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    numbers = spark.createDataFrame([(0.001,), (0.5,), (2.0,)], "x double").select(variants.float_text(F.col("x")).alias("t"), variants.number_text(F.col("x")).alias("q"))
    assert [tuple(r) for r in numbers.collect()] == [("1.000e-03", "0"), ("0.500", "0.50"), ("2.00", "2")]


def test_options_are_checked(spark):
    for wrong in ({"remove_tags": ("a",), "keep_tags": ()}, {"optical": True}, {"bqsr": "full"}, {"bqsr": "apply"}, {"bqsr": "x"}, {"static_levels": (99,)}, {"sort": "x"}):
        with pytest.raises(ValueError):
            Options(**wrong)
    with pytest.raises(ValueError):
        pileup.Model(confidence="x")
    with pytest.raises(ValueError):
        pileup.Model(padding=-1)
    with pytest.raises(ValueError):
        filters.of_sample(reads(spark, [{}]), spark.createDataFrame([("g", "l", None, "s"), ("h", "l", None, "t")], "id string, lb string, pu string, sm string"))


def test_sort_is_left_out_where_it_is_done(spark):
    rows = reads(spark, [{"pos": 5}, {"pos": 3}])
    assert "Sort" not in run(rows, HEADER, Options(sort="coordinate")).reads._jdf.queryExecution().toString()
    out = run(rows, Header(sq=HEADER.sq, rg=HEADER.rg), Options(sort="coordinate"))
    assert [r.pos for r in out.reads.collect()] == [3, 5] and out.header.order == "coordinate"
    assert sorting.effective_order("keep", "unknown") is None and sorting.effective_order("queryname", "coordinate") == "queryname"


def test_reports(spark):
    rows = reads(spark, [{"qname": q, "flag": 1 + 64 * (p == 5), "pos": p} for q in "abc" for p in (5, 9)])
    result = run(rows, HEADER, Options(mark_duplicates=True, optical=True))
    got = report.duplicate_metrics(result.metrics, duplicates.return_on_investment(result.metrics), duplicates.histograms(duplicates.pairs(duplicates.eligible(result.reads))), "command")
    line = next(x for x in got.splitlines() if x.startswith("l\t"))
    assert line.split("\t")[1:8] == ["0", "3", "0", "0", "0", "2", "0"] and "3.0\t" in got
    assert any("NON_REF" in x for x in report.variant_header("GVCF", "s", [("c", 9)], (0, 1))) and not any("NON_REF" in x for x in report.variant_header("NONE", "s", [("c", 9)]))


def test_unclipped_positions(spark):
    cases = {("5S45M", 0): 95, ("5H5S40M", 0): 90, ("45M5S", 16): 149, ("40M3D2M5S3H", 16): 152, ("45M5S", 0): 100, ("*", 0): 100, ("10M100N40M", 16): 249}
    rows = reads(spark, [{"pos": 100, "cigar": c, "flag": f} for c, f in cases])
    assert [r[0] for r in rows.orderBy("idx").select(C.unclipped_position()).collect()] == list(cases.values())
    names = spark.createDataFrame([("a:b:1:2:3",), ("i:r:f:l:7:8:9",), ("a:b",), ("a:b:x:y:z",)], "qname string").select(C.tile_info().alias("t")).collect()
    assert [r.t and (r.t.tile, r.t.x, r.t.y) for r in names] == [(1, 2, 3), (7, 8, 9), None, (None, None, None)]


def test_splitting_rejects_unknown_contigs(spark):
    with pytest.raises(Exception, match="not in the header"):
        splitting.split(reads(spark, [{"rname": "zz"}]), splitting.contig_groups([("c", 10)])).collect()
    assert splitting.contig_groups([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == {"*": "unmapped", "a": "group00001", "b": "group00001", "c": "group00002", "d": "group00003"}


def _few_reads(spark):
    """Reads with clips, insertions, deletions, adaptor, missing letters and letters that are none of ACGT."""
    rows = [(i, f"r{i}", (99, 147, 0, 16)[i % 4], "c", 1 + (i * 37) % 150, 60, ("50M", "4S46M", "20M3I27M", "25M2D25M", "45M5S")[i % 5], "=", 1 + (i * 11) % 150, (60, -60, 0, 90)[i % 4], ("ACGTN" * 10 if i % 7 == 0 else "ACGGTCATTA" * 5), [(i * 5 + j * 7) % 42 for j in range(50)], [{"k": "RG", "t": "Z", "v": f"g{i % 2}"}]) for i in range(300)]
    reference = spark.createDataFrame([("c", k, "".join("ACGT"[(p * p + k) % 4] for p in range(100))) for k in range(3)], "contig string, chunk int, bases string")
    return spark.createDataFrame(rows, READ).repartition(3), spark.createDataFrame([(0, "c", 300)], "refid int, sn string, ln int"), spark.createDataFrame([("g0", "l", "u", "s"), ("g1", "l", None, "s")], "id string, lb string, pu string, sm string"), reference


def test_tables_counted_in_tasks_equal_those_of_bases(spark, monkeypatch):
    reads, d, groups, reference = _few_reads(spark)
    near = spark.createDataFrame([("c", a, a + 1 + a % 4) for a in range(0, 310, 9)] * 3, "chrom string, start int, end int")
    for sites in (None, near):
        base = recalibration.observations(reads, d, groups, reference, sites, 100)
        ordered = lambda x: sorted(map(str, x.select(*sorted(x.columns)).collect()))
        assert ordered(recalibration.tables(base)) == ordered(recalibration.counted_tables(reads, d, groups, reference, sites, 100))
        of_reads = base.groupBy("idx").agg(F.count(F.lit(1)).alias("bases"), F.sum(F.col("mismatch").cast("int")).cast("long").alias("mismatches"))
        assert ordered(of_reads) == ordered(recalibration.counted_mismatches(reads, d, groups, reference, sites, 100))
        known = {p for r in (sites.collect() if sites is not None else []) for p in range(r.start, r.end + 1)}
        assert base.count() > 5000 and (sites is None or len(known) > 100)


def test_likelihoods_summed_in_tasks_equal_those_of_elements(spark):
    reads, _, _, reference = _few_reads(spark)
    pile = pileup.elements(reads, reference, 100)
    close = lambda x: {(r.contig, r.pos): tuple(round(v, 8) for v in r[2:]) for r in x.collect()}
    for alt, least in (("alt_before", 10), ("alt", 6)):
        assert close(pileup.reference_or_any(pile, alt, least)) == close(pileup.likelihoods(reads, reference, alt, least, 100))
    want = pile.groupBy("contig", "pos", "ref").pivot("base", ["A", "C", "G", "T"]).count().na.fill(0).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, pileup.allele_counts(reads, reference, 100).collect()))
    want = pile.groupBy("contig", "pos").agg(F.count(F.lit(1)), F.sum(F.col("alt").cast("int")), F.sum("qual")).collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, pileup.depths(reads, reference, 100).collect()))


def test_sums_are_handed_out_when_full():
    import numpy as np

    from helixframe.operators.kernels import bases

    sums, seen = bases.Sums(most=100), {}
    for i in range(50):
        code = np.arange(i, i + 30) * (1 << 20 if i % 2 else 1)
        sums.add(*bases.summed(code, [None, code * 0.5]))
        if sums.full() or i == 49:
            codes, (n, half) = sums.taken()
            assert sums.held == 0 and len(codes) <= 130
            for c, x, h in zip(codes.tolist(), n.tolist(), half.tolist(), strict=True):
                seen[c] = seen.get(c, 0) + x
                assert h == c * 0.5 * x
    assert sum(seen.values()) == 1500 and sums.taken() is None


def test_long_rows_are_not_numbered_to_find_their_regions(spark):
    """Rows over several bins were named by numbers that a second run of their plan gave to other rows."""
    from helixframe.operators import intervals

    rows = [("c", a, a + 900 + 40 * (a % 31), a) for a in range(0, 60_000, 97)] * 2
    regions = [("c", a, a + 3) for a in range(500, 60_000, 2900)] * 3
    q = spark.createDataFrame(rows, "chrom string, start int, end int, n int").repartition(5)
    got = intervals.overlapping(q, spark.createDataFrame(regions, "chrom string, start int, end int"), "chrom", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if any(s < r[2] and e >= r[1] for _, s, e in set(regions)))
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().analyzed().toString()
