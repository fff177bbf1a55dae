"""Flags, tags, CIGAR strings and sort keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.schema import DUPLICATE, FLAGS, LAST, MULTIPLE, NEXT_REVERSED, NEXT_UNMAPPED, QC_FAILED, REVERSED, SECONDARY, UNMAPPED

READ_OPS, REFERENCE_OPS = "MIS=X", "MDN=X"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body) -> Column:
    """body(value), with value computed once a row: what a lambda refers to by an expression is computed for each element."""
    return F.transform(F.array(value), body).getItem(0)


# flags


def every(mask: int, flag: Column | str = "flag") -> Column:
    return _c(flag).bitwiseAND(mask) == mask


def some(mask: int, flag: Column | str = "flag") -> Column:
    return _c(flag).bitwiseAND(mask) != 0


def not_every(mask: int, flag: Column | str = "flag") -> Column:
    return ~every(mask, flag)


def not_any(mask: int, flag: Column | str = "flag") -> Column:
    return ~some(mask, flag)


def is_(name: str, flag: Column | str = "flag") -> Column:
    """is_("reversed"), is_("duplicate"), ..."""
    return some(FLAGS[name], flag)


def strictly_unmapped() -> Column:
    return some(UNMAPPED) | F.col("rname").isNull() | F.col("rname").isin("", "*") | (F.col("pos") == 0)


def next_strictly_unmapped() -> Column:
    return some(NEXT_UNMAPPED) | F.col("rnext").isNull() | F.col("rnext").isin("", "*") | (F.col("pnext") == 0)


# tags


def tag(key: str, tags: Column | str = "tags") -> Column:
    """The text of the first tag of that name; null without one."""
    return F.get(F.filter(_c(tags), lambda x: x["k"] == key), F.lit(0))["v"]


def without_tags(keys: list[str], tags: Column | str = "tags") -> Column:
    return F.filter(_c(tags), lambda x: ~x["k"].isin(*keys)) if keys else _c(tags)


def only_tags(keys: list[str], tags: Column | str = "tags") -> Column:
    return F.filter(_c(tags), lambda x: x["k"].isin(*keys) if keys else F.lit(False))


def with_tag(key: str, kind: str, value: Column | str, tags: Column | str = "tags") -> Column:
    """The tags with this one set: in place where it was, else at the end."""
    new = F.struct(F.lit(key).alias("k"), F.lit(kind).alias("t"), (F.lit(value) if isinstance(value, str) else value).alias("v"))
    have = F.exists(_c(tags), lambda x: x["k"] == key)
    return F.when(have, F.transform(_c(tags), lambda x: F.when(x["k"] == key, new).otherwise(x))).otherwise(F.concat(F.coalesce(_c(tags), F.array().cast("array<struct<k:string,t:string,v:string>>")), F.array(new)))


# CIGAR


def ops(cigar: Column | str = "cigar") -> Column:
    """array<struct<len int, op string>>; empty for * and null. Operations are given in upper case."""
    found = F.regexp_extract_all(F.coalesce(_c(cigar), F.lit("*")), F.lit(r"([0-9]+[MIDNSHPX=midnshpx])"), F.lit(1))
    return F.transform(found, lambda x: F.struct(x.substr(F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.upper(F.right(x, F.lit(1))).alias("op")))


def merged(cigar_ops: Column) -> Column:
    """Equal neighbours joined into one operation."""
    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct((last["len"] + x["len"]).alias("len"), x["op"].alias("op"))))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["op"] == x["op"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(cigar_ops, F.array().cast("array<struct<len:int,op:string>>"), add)


def cigar_text(cigar_ops: Column) -> Column:
    return F.when(F.size(cigar_ops) == 0, "*").otherwise(F.array_join(F.transform(cigar_ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), ""))


def _length(cigar_ops: Column, of: str) -> Column:
    return F.aggregate(cigar_ops, F.lit(0), lambda n, x: n + F.when(x["op"].isin(*of), x["len"]).otherwise(0))


def read_length(cigar_ops: Column) -> Column:
    return _length(cigar_ops, READ_OPS)


def reference_length(cigar_ops: Column) -> Column:
    return _length(cigar_ops, REFERENCE_OPS)


def end_position(pos: Column | str = "pos", cigar: Column | str = "cigar") -> Column:
    return _c(pos) + reference_length(ops(cigar)) - 1


def _clipped_at_start(cigar_ops: Column) -> Column:
    """Soft and hard clips before anything else."""
    step = lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["op"].isin("S", "H"), x["len"]).otherwise(0)).alias("n"), (a["on"] & x["op"].isin("S", "H")).alias("on"))
    return F.aggregate(cigar_ops, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), step, lambda a: a["n"])


def unclipped_position(pos: Column | str = "pos", flag: Column | str = "flag", cigar: Column | str = "cigar") -> Column:
    """Where the read's 5' end would lie, had it not been clipped. Without operations it is the position."""
    o = ops(cigar)
    forward = _c(pos) - _clipped_at_start(o)
    backward = _c(pos) - 1 + reference_length(o) + _clipped_at_start(F.reverse(o))
    return F.when(F.size(o) == 0, _c(pos)).when(some(REVERSED, flag), backward).otherwise(forward)


#: Operations of a well-formed CIGAR, one letter each: clips and padding only at the ends, insertions and deletions never side by side or
#: next to an end's clip, no deletion or padding last.
WELL_FORMED = r"^(?:H?S|H|P)?(?:[M=XN]|I(?![IDSH]))(?:[M=XN]|I(?![IDSH])|D(?![IDSH]|$)|P(?![PSH]|$))*(?:SH?|H)?$"


def well_formed(cigar: Column | str = "cigar") -> Column:
    o = ops(cigar)
    letters = F.array_join(F.transform(o, lambda x: x["op"]), "")
    return (F.size(o) > 0) & ~F.exists(o, lambda x: x["len"] == 0) & letters.rlike(WELL_FORMED)


# sort keys


def masked_flag(flag: Column | str = "flag") -> Column:
    """Bits that say nothing count as unset: those of a mate without one, the strand of an unmapped read or mate."""
    f = _c(flag)
    f = F.when(not_any(MULTIPLE, f), f.bitwiseAND(~(NEXT_UNMAPPED | NEXT_REVERSED))).otherwise(f)
    f = F.when(some(UNMAPPED, f), f.bitwiseAND(~REVERSED)).otherwise(f)
    return F.when(some(NEXT_UNMAPPED, f), f.bitwiseAND(~NEXT_REVERSED)).otherwise(f)


def coordinate_keys() -> list[Column]:
    """Of the coordinate order, over refid, pos, flag, qname, mapq, next_refid, pnext, tlen, idx. Reads without a reference come last."""
    paired = some(MULTIPLE)
    return [F.col("refid") < 0, F.col("refid"), F.col("pos"), some(REVERSED), F.coalesce(F.col("qname"), F.lit("")), masked_flag(), F.col("mapq"), F.when(paired, F.col("next_refid")), F.when(paired, F.col("pnext")), F.col("tlen"), F.col("idx")]


def queryname_keys() -> list[Column]:
    return [F.col("qname"), F.col("idx")]


# qualities and names


def phred_score(qual: Column | str = "qual", least: int = 15) -> Column:
    """Sum of the qualities that are `least` or more."""
    return F.aggregate(F.filter(_c(qual), lambda q: q >= least), F.lit(0).cast("long"), lambda a, q: a + q)


def tile_info(qname: Column | str = "qname") -> Column:
    """struct<tile, x, y> from a name of seven or five fields; null from others."""
    parts = F.split(_c(qname), ":")
    at = lambda i: F.struct(*(F.get(parts, F.lit(i + j)).try_cast("int").alias(n) for j, n in enumerate(("tile", "x", "y"))))
    return F.when(F.size(parts) == 7, at(4)).when(F.size(parts) == 5, at(2))


def last_in_template() -> Column:
    return some(LAST)


def unusable() -> Column:
    return some(SECONDARY | DUPLICATE | QC_FAILED)
