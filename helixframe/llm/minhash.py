"""Near-duplicate documents by improved consistent weighted sampling.

A document is a weighted set of shingles (runs of five words; fewer, if it has fewer): weight = times it occurs * idf, idf = 2 - log(df) / log(documents), in eighths of an
octave of df. df counts all documents, exactly but for chance collisions of short hashes (see blocks). The idf lies between 1 and 2, so that copies in great
numbers don't lose the weight of what they share against what sets each apart.

Only a document of whose weight 0.8 or more lies on shingles that other documents have too can have a partner; the others are done with. The rest
get ROWS * BANDS samples, whose chance to agree is the weighted Jaccard similarity; documents that agree in all samples of a band are candidates. Candidates are verified
by the weighted Jaccard similarity of their whole sets.

No group is expanded into its pairs at once: the members of a band's group are verified against one hub, groups are then the connected parts of
verified links, and further rounds verify what is still apart against hubs of a group's largest part. What is left apart after ROUNDS rounds is
verified pair by pair over the different parts. There, a band's group of more than SMALL members (a passage that is everywhere brings
documents together that have little else in common) is dealt into blocks of about BLOCK members, and each pair of blocks is compared by itself,
each pair of texts in the first band that they share. Before any verification bounds are tested: the weight that a text
has for itself is in no other's set; and with shingles dealt into PARTS by their hash, two texts share no more of a part than either has of it. The second bound
is close to the similarity itself, so that of a group's pairs hardly more than its links are made."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.blocks import answered, answers, deal, mix, packed, sent, unpacked, words_of
from helixframe.llm.common import documents, in_arrow, planned_bytes, stored, tasks

SHINGLE, SIMILAR, ROWS, BANDS, ROUNDS, SMALL, PARTS = 5, 0.8, 3, 16, 3, 64, 64
#: Members of a block of a large group, and how many of them are compared with another block at once.
BLOCK, TILE = 1024, 32
SET_BITS = np.uint64(((1 << 48) - 1) << 16)
_SIGNATURE = pa.schema([("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("total", pa.float64()), ("own", pa.float64()), ("parts", pa.list_(pa.float32())), ("shingles", pa.binary())])
SIGNATURE = "node binary, bands array<long>, total double, own double, parts array<float>, shingles binary"

_draw = np.random.default_rng(7).random
_R = -np.log(_draw((1 << 16,)) * _draw((1 << 16,)) + 1e-300)  # gamma(2, 1)
_LOG_C = np.log(-np.log(_draw((1 << 16,)) * _draw((1 << 16,)) + 1e-300))
_BETA = _draw((1 << 16,))
_ODD = np.random.default_rng(8).integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def log_a(at: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """The sampling value, as 32 bits that keep the order; it tells the step t of the sample too."""
    r = _R[at]
    t = np.floor(log_w / r + _BETA[at])
    return ((_LOG_C[at] - r * (t - _BETA[at] + 1) + 90) * (1 << 25)).clip(0, (1 << 32) - 1).astype(np.uint64) << np.uint64(32)


_PLAIN = log_a(np.arange(1 << 16), np.full(1 << 16, math.log(2)))


def idf(octaves: np.ndarray, n: int) -> np.ndarray:
    """octaves: 8 * log2(df), rounded."""
    return 2 - octaves / 8 / max(1.0, math.log2(max(2, n)))


class Shingles:
    """The distinct texts of a block and their shingles. pair_text and pair_hash: one entry for each shingle of each text, by text and then hash."""

    def __init__(self, table: pa.Table):
        node, first = {}, []
        copies: list[int] = []
        for i, x in enumerate(table.column("node").to_pylist()):
            if x not in node:
                node[x] = len(first)
                first.append(i)
                copies.append(0)
            copies[node[x]] += 1
        self.node = list(node)
        w = words_of(table.column("text").take(pa.array(first, pa.int64())).to_pylist())
        at, hashes = w.windows(SHINGLE)
        sizes = np.diff(w.first)
        for n in range(1, SHINGLE):
            if (short := sizes == n).any():
                few, more = w.windows(n)
                own = short[np.searchsorted(w.first, few, side="right") - 1]
                at, hashes = np.concatenate([at, few[own]]), np.concatenate([hashes, more[own]])
        text = np.searchsorted(w.first, at, side="right") - 1
        self.hashes, inverse = np.unique(hashes, return_inverse=True)
        pair, self.tf = np.unique(text * np.int64(len(self.hashes) or 1) + inverse, return_counts=True)
        self.text, self.which = np.divmod(pair, np.int64(len(self.hashes) or 1))
        self.df = np.bincount(self.which, np.array(copies, float)[self.text], len(self.hashes)).astype(np.uint64)

    def short(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Short hashes, each once, how many documents have them, and which of them each hash became."""
        cut = self.hashes & np.uint64(((1 << bits) - 1) << (64 - bits))
        new = np.concatenate([[True], cut[1:] != cut[:-1]]) if len(cut) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return cut[first], (np.add.reduceat(self.df, first) if len(first) else self.df), np.cumsum(new) - 1


def signatures(block: Shingles, octaves: np.ndarray, n: int) -> pa.Table:
    """For each text that can have a partner: its bands and its weighted set."""
    weight = weight_all = block.tf * idf(octaves, n)[block.which]
    shared = (octaves > 0)[block.which]
    texts = len(block.node)
    total, common = np.bincount(block.text, weight, texts), np.bincount(block.text, weight * shared, texts)
    able = (total > 0) & (common >= SIMILAR * total * (1 - 1e-9))
    keep = able[block.text]
    text, which, tf, weight = block.text[keep], block.which[keep], block.tf[keep], weight[keep]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    if not len(first):
        return _SIGNATURE.empty_table()
    hashes = block.hashes[which]
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    tail = hashes & np.uint64(0xFFFFFFFF)
    log_w, odd = np.log(weight), np.flatnonzero(np.abs(weight - 2) > 1e-12)
    bands = np.zeros((BANDS, len(first)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS * BANDS):
            at = (low * _ODD[k]) >> np.uint32(16)
            value = _PLAIN[at]
            value[odd] = log_a(at[odd], log_w[odd])
            sample = np.minimum.reduceat(value | tail, first)
            bands[k // ROWS] = mix(bands[k // ROWS] + sample + np.uint64(k))
    edges, sets = [*first.tolist(), len(text)], []
    octave = octaves[which].astype(np.uint64)
    for a, b in zip(edges, edges[1:], strict=False):
        sets.append(packed(hashes[a:b] & SET_BITS, [tf[a:b].astype(np.uint64), octave[a:b]]))
    own = text[first]
    part = ((block.hashes[block.which] >> np.uint64(20)) % np.uint64(PARTS)).astype(np.int64)
    parts = np.bincount(block.text * PARTS + part, weight_all * shared, texts * PARTS).reshape(texts, PARTS)[own].astype(np.float32)
    lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
    columns = [pa.array([block.node[i] for i in own.tolist()], pa.binary()), lists(bands.T.astype(np.int64)), pa.array(total[own]), pa.array((total - common)[own]), lists(parts), pa.array(sets, pa.binary())]
    return pa.table(columns, schema=_SIGNATURE)


def similarity(a: bytes, b: bytes, n: int) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    (ha, (ta, oa)), (hb, (tb, ob)) = unpacked(a, 2), unpacked(b, 2)
    wa, wb = ta * idf(oa.astype(float), n), tb * idf(ob.astype(float), n)
    hashes = np.concatenate([ha, hb])
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
    both = float(np.minimum(np.concatenate([wa, wb])[order][same], np.concatenate([wa, wb])[order][same + 1]).sum())
    return both / (float(wa.sum() + wb.sum()) - both)


def with_node(docs: DataFrame) -> DataFrame:
    return docs.withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def _signed(docs: DataFrame) -> tuple[DataFrame, int]:
    """The signatures, and the number of documents with a word."""
    worded = with_node(docs.select("doc_id", "text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    dealt, n = deal(worded), worded.count()
    buckets = dealt.buckets
    bits = min(64, max(44, (dealt.blocks * (2 << 20) // 4).bit_length() + 12))

    def send(table: pa.Table) -> pa.Table:
        hashes, df, _ = Shingles(table).short(bits)
        return sent(table.column("blk")[0].as_py(), hashes, [df], buckets)

    def count(table: pa.Table) -> pa.Table:
        return answers(table, 1, lambda group, first, extras: np.round(8 * np.log2(np.add.reduceat(extras[0].astype(np.int64), first).astype(float)))[group].astype(np.uint8))

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return signatures(Shingles(left), np.zeros(0), n)
        block = Shingles(left)
        return signatures(block, answered(right)[block.short(bits)[2]].astype(float), n)

    rows = dealt.give(dealt.ask(dealt.send(send), count), sign, SIGNATURE)
    return stored(rows, "signatures", dealt.size), n


def able(a: str, b: str) -> Column:
    """Whether two texts can be similar: a.total and a.own (what no other text has) bound what they share from above."""
    total = lambda x: F.col(f"{x}.total")
    most = F.least(total(a) - F.col(f"{a}.own"), total(b) - F.col(f"{b}.own"))
    return most >= (SIMILAR - 1e-9) * (total(a) + total(b) - most)


def able_by_parts(a: str, b: str) -> Column:
    both = F.aggregate(F.zip_with(F.col(f"{a}.parts"), F.col(f"{b}.parts"), lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)
    return both >= (SIMILAR - 1e-5) * (F.col(f"{a}.total") + F.col(f"{b}.total") - both)


def _verified(links: DataFrame, sets: DataFrame, n: int, parts: int) -> DataFrame:
    """links: u, v. Those whose sets are similar."""

    def run(batches):
        for b in batches:
            like = [similarity(x, y, n) >= SIMILAR - 1e-12 for x, y in zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("u"), b.column("v"), pa.array(like, pa.bool_())], ["u", "v", "like"])

    each = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(parts, "u").distinct()
    u = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")).repartition(parts, "u")
    v = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")).repartition(parts, "v")
    pairs = each.join(u, "u").repartition(parts, "v").join(v, "v").select("u", "v", "su", "sv")
    return in_arrow(pairs, run, "u binary, v binary, like boolean").where("like").select("u", "v")


def _contracted(batches):
    """Of one task's edges u, v: each node with the smallest node of its part, but for those themselves."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    ends = pa.chunked_array([*table.column("u").chunks, *table.column("v").chunks])
    nodes = ends.unique()
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = pc.index_in(ends, value_set=nodes).to_numpy().reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.record_batch([nodes.take(pa.array(moved)), nodes.take(pa.array(root[moved]))], ["u", "v"])


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its part) for all nodes of the edges u, v. Each task contracts its own edges; if there is more than one task's
    worth of them, large and small stars follow by turns until nothing changes. Each step is written to the shared folder."""
    spark = edges.sparkSession
    parts = tasks(spark, planned_bytes(edges))
    edges = stored(in_arrow(edges.where("u <> v").select("u", "v").coalesce(parts), _contracted, "u binary, v binary"), "edges")
    said = None
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").repartition(parts, "u").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("a"), "m").unionByName(lower.select(F.col("u").alias("a"), "m")).where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).repartition(parts, "u").distinct()
        edges, before = stored(small, "edges"), said
        # a digest of all edges tells whether a step has changed any
        said = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if said == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _side(name: str, *more: str) -> Column:
    return F.struct("node", "root", "total", "own", *more).alias(name)


def _hub_links(members: DataFrame, turn: int) -> DataFrame:
    """members: band, key, node, root, total, own. Each against its group's hub: any member at first, then one of the group's largest part."""
    members = members.repartition(tasks(members.sparkSession, planned_bytes(members)), "band", "key")
    h = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("h"), "node", "root", "total", "own"))
    if turn:
        parts = members.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"), h.alias("hub"))
        hubs = parts.groupBy("band", "key").agg(F.max(F.struct("n", "hub")).alias("m")).select("band", "key", F.col("m.hub").alias("hub"))
    else:
        hubs = members.groupBy("band", "key").agg(h.alias("hub"))
    met = members.select("band", "key", _side("a")).join(hubs, ["band", "key"])
    return met.where((F.col("a.root") != F.col("hub.root")) & able("a", "hub")).select(F.col("a.node").alias("u"), F.col("hub.node").alias("v"))


def block_pairs(table: pa.Table) -> pa.Table:
    """u, v: the pairs of two blocks of a large group (or within one) that are of different parts, share no earlier band, and pass both bounds."""
    table = table.sort_by("total")
    total, own, chunk = (table.column(c).to_numpy() for c in ("total", "own", "chunk"))
    band, low, high = (table.column(c)[0].as_py() for c in ("band", "low", "high"))
    nodes, root = table.column("node").to_pylist(), np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
    keys, parts = (pa.concat_arrays(table.column(c).chunks).flatten().to_numpy().reshape(table.num_rows, -1) for c in ("bands", "parts"))
    left, right, common, us, vs = np.flatnonzero(chunk == low), np.flatnonzero(chunk == high), total - own, [], []
    for s in range(0, len(left), TILE):
        i = left[s : s + TILE]
        # similar texts' totals differ by a factor of SIMILAR at most
        j = right[np.searchsorted(total[right], total[i[0]] * (SIMILAR - 1e-6)) : np.searchsorted(total[right], total[i[-1]] / (SIMILAR - 1e-6), side="right")]
        most = np.minimum(common[i][:, None], common[j])
        ok = (root[i][:, None] != root[j]) & (most >= (SIMILAR - 1e-9) * (total[i][:, None] + total[j] - most))
        if low == high:
            ok &= i[:, None] < j
        for b in range(band):
            ok &= keys[i, b][:, None] != keys[j, b]
        x, y = np.nonzero(ok)
        x, y = i[x], j[y]
        both = np.minimum(parts[x], parts[y]).sum(1, dtype=float)
        like = both >= (SIMILAR - 1e-5) * (total[x] + total[y] - both)
        us += [nodes[k] for k in x[like].tolist()]
        vs += [nodes[k] for k in y[like].tolist()]
    return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})


def _pair_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different parts within a group that may be similar. Large groups are compared block by block, a pair of blocks at a time."""
    size = planned_bytes(sets)
    parts = tasks(sets.sparkSession, size)
    dealt = members.repartition(parts, "band", "key")
    sized = dealt.join(dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")), ["band", "key"])
    rows = stored(sized.repartition(parts, "node").join(sets.select("node", "parts", "bands").repartition(parts, "node"), "node"), "last", size)
    small, chunks = rows.where(F.col("n") <= SMALL).repartition(parts, "band", "key"), F.ceil(F.col("n") / BLOCK).cast("int")
    both = small.select("band", "key", _side("a", "parts")).join(small.select("band", "key", _side("b", "parts")), ["band", "key"])
    few = both.where((F.col("a.root") < F.col("b.root")) & able("a", "b") & able_by_parts("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    dealt = rows.where(F.col("n") > SMALL).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other")).drop("other", "n")
    dealt = dealt.repartition(parts, "band", "key", "low", "high")
    return few.unionByName(dealt.groupBy("band", "key", "low", "high").applyInArrow(lambda t: block_pairs(t), "u binary, v binary"))


def linked(signed: DataFrame, n: int) -> DataFrame:
    """node, root of all texts that are similar to another one. signed: as from _signed, a text once or more often."""
    spark, size = signed.sparkSession, planned_bytes(signed)
    parts = tasks(spark, size)
    firsts = [F.first(c).alias(c) for c in ("total", "own", "parts", "bands", "shingles")]
    sets = stored(signed.repartition(parts, "node").groupBy("node").agg(*firsts), "sets", size)
    members = sets.select("node", "total", "own", F.posexplode("bands").alias("band", "key")).repartition(parts, "band", "key")
    groups = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "key")
    members = stored(members.join(groups, ["band", "key"], "left_semi"), "bands", size)
    roots = None
    for turn in range(ROUNDS + 1):
        if roots is None:
            with_root = members.withColumn("root", F.col("node"))
        else:
            with_root = members.repartition(parts, "node").join(roots.repartition(parts, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        with_root = with_root.repartition(parts, "band", "key")
        split = with_root.groupBy("band", "key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band", "key")
        open_groups = stored(with_root.join(split, ["band", "key"], "left_semi"), "open", size)
        if open_groups.isEmpty():
            break
        links = _hub_links(open_groups, turn) if turn < ROUNDS else _pair_links(open_groups, sets)
        found = stored(_verified(links, sets, n, parts), "links", size)
        if found.isEmpty():
            continue
        # parts found before are carried on as a link from each member to its root
        roots = connected(found if roots is None else found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    return roots if roots is not None else spark.createDataFrame([], "node binary, root binary")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, root (of its group) and whether there is a word, of each row."""
    signed, n = _signed(docs)
    ids = with_node(docs.select("doc_id", "text")).select("doc_id", "node", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    return ids.join(linked(signed, n), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group), class_size of each row: groups of documents that are linked by weighted
    Jaccard similarities of 0.8 or more; equal texts are always in one group.

    Texts without a word (null and empty ones too) are groups by themselves. Rows that share a doc_id are documents of their own. Null
    doc_ids can't name a group: its other documents do, or null if there are none. Other columns are ignored."""
    rows = _classes(docs)
    names = rows.where("worded").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    worded = rows.where("worded").join(names, "root").select("doc_id", "class_id", "class_size")
    return worded.unionByName(rows.where("NOT worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs of each group stays: that with the smallest doc_id (null only if there is no other), of those the one whose text has the
    smallest hash, of rows equal in both any. Rows without a word stay."""
    found = stored(_classes(docs).where("worded").select("doc_id", "node", "root"), "classes")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    judged = stored(found.join(best, "root").select("doc_id", "node", F.expr("doc_id <=> best.doc_id AND node = best.node").alias("stays")), "judged")
    gone = judged.where("NOT stays").select("doc_id", "node").distinct()
    node = F.unhex(F.md5(docs["text"].cast("binary")))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (node == gone["node"]), "left_anti")
    if judged.where("stays").groupBy("doc_id", "node").count().where("count > 1").isEmpty():
        return left
    rows = left.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("id"), F.unhex(F.md5(F.col("row.text").cast("binary"))).alias("node"), F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    return rows.where("worded").dropDuplicates(["id", "node"]).unionByName(rows.where("NOT worded")).select("row.*")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
