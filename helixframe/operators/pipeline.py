"""The command in one object: options, their checks, and the fixed order in which they are applied."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from helixframe.operators import duplicates, filters, recalibration, sorting
from helixframe.sources.headers import Header, Record, with_dictionary, with_group, with_prefix, with_program


@dataclass(frozen=True)
class Options:
    """What is to be done. The order of application is fixed, whatever order options are given in."""

    remove_unmapped: bool = False
    remove_unmapped_strict: bool = False
    least_mapping_quality: int = 0
    exact: bool = False
    exact_strict: bool = False
    regions: DataFrame | None = None
    clear_duplicate_flag: bool = False
    rename_chromosomes: bool = False
    clean: bool = False
    dictionary: tuple[tuple[str, int], ...] | None = None
    read_group: tuple[tuple[str, str], ...] | None = None
    mark_duplicates: bool = False
    optical: bool = False
    remove_optional_reads: bool = False
    remove_duplicates: bool = False
    remove_tags: tuple[str, ...] = ()
    keep_tags: tuple[str, ...] | None = None
    sort: str = "keep"
    bqsr: str = ""  # "", "full", "tables", "apply"
    reference: DataFrame | None = None
    known_sites: DataFrame | None = None
    tables: DataFrame | None = None
    levels: int = 0
    static_levels: tuple[int, ...] = ()
    max_cycle: int = 500
    program: tuple[str, str, str] | None = None

    def __post_init__(self):
        def wrong(condition: bool, what: str) -> None:
            if condition:
                raise ValueError(what)

        wrong(bool(self.remove_tags) and self.keep_tags is not None, "tags are either removed or kept")
        wrong(self.optical and not self.mark_duplicates, "optical duplicates need marked duplicates")
        wrong(self.bqsr not in ("", "full", "tables", "apply"), f"no such recalibration mode: {self.bqsr}")
        wrong(self.bqsr in ("full", "tables") and self.reference is None, "recalibration needs a reference")
        wrong(self.bqsr == "apply" and self.tables is None, "applying needs tables")
        wrong(any(q > recalibration.TOP_QUALITY or q < 0 for q in self.static_levels), "levels go from 0 to 93")
        wrong(self.sort not in ("keep", "unknown", "unsorted", "queryname", "coordinate"), f"no such order: {self.sort}")


@dataclass
class Result:
    reads: DataFrame
    header: Header
    metrics: DataFrame | None = None
    tables: DataFrame | None = None


def run(reads: DataFrame, header: Header, o: Options) -> Result:
    """reads: rows of schema.READ."""
    spark = reads.sparkSession
    if o.program:
        header = with_program(header, *o.program)
    if o.remove_unmapped_strict:
        reads = filters.strictly_mapped(reads)
    elif o.remove_unmapped:
        reads = filters.mapped(reads)
    reads = filters.mapping_quality(reads, o.least_mapping_quality)
    reads = filters.exactly_mapped(reads) if o.exact else reads
    reads = filters.exactly_mapped_strict(reads) if o.exact_strict else reads
    reads = filters.overlapping_regions(reads, o.regions) if o.regions is not None else reads
    reads = filters.cleared_duplicate_flag(reads) if o.clear_duplicate_flag else reads
    if o.rename_chromosomes:
        reads, header = filters.renamed_chromosomes(reads), with_prefix(header)

    def dictionary():
        return spark.createDataFrame(header.dictionary(), "refid int, sn string, ln int")

    reads = filters.cleaned(reads, dictionary()) if o.clean else reads
    if o.dictionary is not None:
        header = with_dictionary(header, [{"SN": n, "LN": str(x)} for n, x in o.dictionary])
        reads = filters.in_dictionary(reads, dictionary())
    if o.read_group is not None:
        record: Record = dict(o.read_group)
        reads, header = filters.with_read_group(reads, record["ID"]), with_group(header, record)
    groups = spark.createDataFrame(header.groups() or [("", None, None, None)], "id string, lb string, pu string, sm string")
    metrics = None
    wanted = sorting.effective_order(o.sort, header.order)
    if o.mark_duplicates or wanted == "coordinate":
        reads = filters.with_reference_ids(reads, dictionary())
    if o.mark_duplicates:
        reads = duplicates.with_library(reads, groups)
        plain, reads = reads, duplicates.mark(reads)
        optical = duplicates.optical_counts(duplicates.optical_members(duplicates.pairs(duplicates.eligible(plain)), plain)) if o.optical else None
        metrics = duplicates.derived(duplicates.counters(reads, groups, optical))
    if o.remove_optional_reads:
        reads = filters.without_spread_copies(reads, "@sr" in header.user)
        header = replace(header, user={k: v for k, v in header.user.items() if k != "@sr"})
    tables = o.tables
    if o.bqsr in ("full", "tables"):
        tables = recalibration.counted_tables(reads, dictionary(), groups, o.reference, o.known_sites, max_cycle=o.max_cycle)
    if o.bqsr in ("full", "apply"):
        reads = recalibration.applied(reads, groups, tables, o.levels, o.static_levels, o.max_cycle)
    reads = filters.without_duplicates(reads) if o.remove_duplicates else reads
    reads = filters.without_tags(reads, list(o.remove_tags)) if o.remove_tags else reads
    reads = filters.only_tags(reads, list(o.keep_tags)) if o.keep_tags is not None else reads
    if wanted:
        reads, header = sorting.sorted_as(reads, o.sort, header.order), header.with_order(o.sort)
    return Result(reads, header, metrics, tables)


