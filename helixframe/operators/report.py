"""Texts: duplicate metrics, recalibration tables, tracks, variant headers. They are made of aggregates of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixframe.operators.recalibration import finalized, quantized

#: Names and lines that the formats fix.
METRIC_COLUMNS = ("LIBRARY", "UNPAIRED_READS_EXAMINED", "READ_PAIRS_EXAMINED", "SECONDARY_OR_SUPPLEMENTARY_RDS", "UNMAPPED_READS", "UNPAIRED_READ_DUPLICATES", "READ_PAIR_DUPLICATES", "READ_PAIR_OPTICAL_DUPLICATES", "PERCENT_DUPLICATION", "ESTIMATED_LIBRARY_SIZE")
HISTOGRAM_COLUMNS = ("BIN", "CoverageMult", "all_sets", "optical_sets", "non_optical_sets")


def _number(x: float) -> str:
    return f"{x:.6f}".rstrip("0")


def duplicate_metrics(derived: DataFrame, roi: DataFrame, histogram: DataFrame, command: str) -> str:
    """derived, roi, histogram: as duplicates.derived, return_on_investment and histograms give them. The histogram is printed if exactly one library
    has pairs."""
    rows = derived.orderBy("library").collect()
    out = ["## METRICS", f"# {command}", "", "\t".join(METRIC_COLUMNS)]
    for r in rows:
        values = [r.library, r.unpaired_examined, r.pairs_examined, r.secondary_or_supplementary, r.unmapped, r.unpaired_duplicates, r.pair_duplicates, r.optical_duplicates, _number(r.percent_duplication)]
        out.append("\t".join(map(str, values + ([r.library_size] if r.pairs_examined else []))))
    out.append("")
    paired = [r for r in rows if r.pairs_examined]
    if len(paired) == 1:
        multiples = {r.x: r.roi for r in roi.where(roi.library == paired[0].library).collect()}
        sets = {r.set_size: r for r in histogram.where(histogram.library == paired[0].library).collect()}
        out += ["## HISTOGRAM", "\t".join(HISTOGRAM_COLUMNS)]
        for i in sorted({*range(1, 101), *sets}):
            s = sets.get(i)
            out.append("\t".join([f"{i}.0", _number(multiples.get(i, 0.0)), *(str(getattr(s, c) if s else 0) for c in ("all_sets", "optical_sets", "non_optical_sets"))]))
    return "\n".join([*out, ""])


def recalibration_report(tabled: DataFrame, counts: list[int], levels: int = 16) -> str:
    """Quantised qualities, then the three tables, sorted by their keys."""
    table = quantized(counts, levels)
    out = ["#:Quantized", "QualityScore\tCount\tQuantizedScore", *(f"{q}\t{n}\t{t}" for q, (n, t) in enumerate(zip(counts, table, strict=True))), ""]
    rows = finalized(tabled).orderBy("kind", "read_group", "qual", "cycle", "context").collect()
    for kind in ("quality", "cycle", "context"):
        out += [f"#:{kind}", "ReadGroup\tQualityScore\tCovariate\tEmpiricalQuality\tObservations\tErrors"]
        out += [f"{r.read_group}\t{r.qual}\t{r.cycle if kind == 'cycle' else r.context if kind == 'context' else '-'}\t{r.empirical}.0000\t{r.observations}\t{r.mismatches}.00" for r in rows if r.kind == kind]
        out.append("")
    return "\n".join(out)


def track(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Lines (column value) of a track for a genome browser: contig, start (from 0), end, name, number. rows: contig, start, end and the value."""
    from pyspark.sql import functions as F

    return rows.select(F.concat_ws("\t", "contig", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.lit(name), F.format_string("%.5f", F.col(value).cast("double"))).alias("value"))


FIELDS = {
    "INFO": {"AC": ("A", "Integer"), "AF": ("A", "Float"), "AN": ("1", "Integer"), "BaseQRankSum": ("1", "Float"), "DP": ("1", "Integer"), "END": ("1", "Integer"), "ExcessHet": ("1", "Float"), "FS": ("1", "Float"), "MLEAC": ("A", "Integer"), "MLEAF": ("A", "Float"), "MQ": ("1", "Float"), "MQRankSum": ("1", "Float"), "QD": ("1", "Float"), "RAW_MQandDP": ("2", "Integer"), "ReadPosRankSum": ("1", "Float"), "SOR": ("1", "Float")},
    "FORMAT": {"AD": ("R", "Integer"), "DP": ("1", "Integer"), "GQ": ("1", "Integer"), "GT": ("1", "String"), "MIN_DP": ("1", "Integer"), "PGT": ("1", "String"), "PID": ("1", "String"), "PL": ("G", "Integer"), "PS": ("1", "Integer"), "SB": ("4", "Integer")},
}


def variant_header(confidence: str, sample: str, contigs: list[tuple[str, int]], bands: tuple[int, ...] = ()) -> list[str]:
    """The lines of a called file's header, by confidence mode."""
    blocks = confidence == "GVCF"
    skip = {"NONE": {"RAW_MQandDP", "MIN_DP", "END", "SB", "PGT", "PID", "PS"}, "GVCF": {"AC", "AF", "AN", "FS", "MQ", "QD", "SOR"}, "BP_RESOLUTION": {"AC", "AF", "AN", "FS", "MQ", "QD", "SOR", "MIN_DP", "END"}}[confidence]
    out = ["fileformat=VCFv4.2", *(["ALT=<ID=NON_REF,Description=\"any other allele\">"] if confidence != "NONE" else []), 'FILTER=<ID=LowQual,Description="low quality">']
    out += [f'{kind}=<ID={k},Number={n},Type={t},Description="{k}">' for kind in ("FORMAT", "INFO") for k, (n, t) in FIELDS[kind].items() if k not in skip]
    out += [f"GVCFBlock{a}-{b}=minGQ={a}(inclusive),maxGQ={b}(exclusive)" for a, b in zip(bands, bands[1:], strict=False)] if blocks else []
    return [f"##{x}" for x in [*out, *(f"contig=<ID={n},length={x}>" for n, x in contigs)]] + ["#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
