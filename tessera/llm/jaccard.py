"""Near-duplicates by SimHash trie links and, where these can't reach, by a prefix-filtered join.

A document's set is the distinct XXH64 values of its five-word shingles (lower-cased
text). Two documents link if their sets' Jaccard similarity is 4/5 or more, counted
in whole numbers; groups are the components of these links. The sets' SimHash
fingerprints are joined by the binary trie first (``simhash.link_edges``), which links
copies with few changes; each link is checked by the whole sets. Fingerprints give no
bound on this similarity (pairs at 4/5 differ in some 10 of 64 bits), so the links they
miss come from prefixes: a set of n that reaches 4/5 with another shares at least
ceil(4n/5) of its shingles, so under any one order of all shingles two linked sets share
a shingle among the first n - ceil(4n/5) + 1 of each. The order puts shingles that a
sample of the documents repeats last, so that common passages make few candidates; the
sample decides the cost and not the result.

Documents with equal sets are one node (equal 64-bit hashes of the sorted set). The
nodes that share a prefix shingle are a bucket, and buckets of the same nodes are one. A node is first compared with the
smallest nodes of its buckets, those it meets most often, which links the most of a
dense group by stars. Buckets whose nodes have several roots then are searched in two
rounds, first for the best partners of each node, then for all that are still unlinked:
bit maps of two sets differ in no more bits than the sets have unlike shingles, and only
pairs of unlike roots whose sizes and maps allow 4/5 leave the bucket and are verified by
their whole sets. So no link is missed, and nodes that are linked already are never paired.

Defined results for odd input: a null or wordless text has the empty set, and all of
these are one group; a text of fewer words than a shingle is one shingle; a null
doc_id takes no part in groups (component_id null) and such rows are always kept;
repeated rows and repeated doc_ids share their group; texts of any length are taken
whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from ..session import discard, materialise

WIDTH = 5
SAMPLE_ROWS = 20_000
COMMON = 50_000
FLUSH = 1 << 17
LEADS, PARTNERS, FIRSTS, SEEN = 3, 4, 16, 200_000
MAP_BITS, WIDE_BITS = 1024, 8192


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(simhash.shingle_hashes(text, width))


def set_hash(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), simhash.SEED)


def bit_map(found: np.ndarray, n_bits: int = MAP_BITS) -> list[int]:
    """A bit for each value of the shingles' low bits; maps differ in no more bits than the sets in shingles."""
    bits = np.zeros(n_bits, np.uint8)
    bits[(found % np.uint64(n_bits)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def prefix(found: np.ndarray, common: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 shingles of a set of n; those in ``common`` (sorted) come last, by ``level``."""
    n = len(found)
    if not n:
        return found
    order = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        order = np.where(common[at] == found, level[at], 0)
    return found[np.argsort(order, kind="stable")[: n - (4 * n + 4) // 5 + 1]]  # the set is sorted by hash


def _sets(batches: Iterator[pa.RecordBatch], width: int, column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield part, [shingle_set(t or b"", width) for t in part.column(column).cast(pa.large_binary()).to_pylist()]


def _longs(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def set_hashes(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the hash of the shingle set as a signed long), n (its size), sim (its SimHash) and map (its bit map) of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            maps = pa.array([bit_map(s) for s in sets], pa.list_(pa.int64()))
            columns = part.column(0), _longs([set_hash(s) for s in sets]), pa.array(list(map(len, sets)), pa.int32()), _longs(list(map(simhash.majority_bits, sets))), maps
            yield pa.record_batch(list(columns), ["doc_id", "fp", "n", "sim", "map"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp long, n int, sim long, map array<bigint>")


def common_shingles(documents: DataFrame, rows: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the ``rows`` documents repeats, sorted, and how common each is."""
    every = max(1, rows // SAMPLE_ROWS)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, width):
            yield pa.record_batch([_longs(np.concatenate(sets))], ["shingle"])

    sample = documents.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).select("doc_id", "text")
    counts = sample.mapInArrow(apply, "shingle long").groupBy("shingle").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    shingle, count = found["shingle"].to_numpy().view(np.uint64), found["count"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], np.log2(np.maximum(count[order], 1)).astype(np.int64)


def shared_prefixes(documents: DataFrame, rows: int, width: int = WIDTH) -> DataFrame:
    """p (a bucket), n (size of the set), fp, and lead_n, lead of the bucket's smallest node.

    A bucket is the nodes that share a prefix shingle, if there are several; shingles with
    the same nodes are one bucket, named by a hash of its nodes.
    """
    common, level = common_shingles(documents, rows, width)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task are sent once
        for _, sets in _sets(batches, width):
            marks = list(map(set_hash, sets))
            new = {m: s for m, s in zip(marks, sets, strict=True) if m not in seen}
            if not new:
                continue
            if len(seen) > SEEN:
                seen.clear()
            seen.update(new)
            firsts = [prefix(s, common, level) for s in new.values()]
            each = [len(f) for f in firsts]
            n, fp = np.repeat([len(s) for s in new.values()], each).astype(np.int32), np.repeat(np.array(list(new), np.uint64), each)
            yield pa.record_batch([_longs(np.concatenate(firsts)), pa.array(n), _longs(fp)], ["p", "n", "fp"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for p, n, fp in simhash.whole_buckets(batches):
            new = np.r_[True, (p[1:] != p[:-1]) | (fp[1:] != fp[:-1])]  # equal sets stand together
            p, n, fp = p[new], n[new], fp[new]
            firsts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            lasts = np.r_[firsts[1:], len(p)]
            data, kept = fp.tobytes(), []
            for first, last in zip(firsts[lasts - firsts > 1].tolist(), lasts[lasts - firsts > 1].tolist(), strict=True):
                members = xxhash.xxh64_intdigest(data[8 * first : 8 * last], simhash.SEED)
                if members not in seen:
                    seen.add(members)
                    kept.append((members, first, last))
            if len(seen) > SEEN:
                seen.clear()
            if kept:
                rows = np.concatenate([np.arange(a, b) for _, a, b in kept])
                each = [b - a for _, a, b in kept]
                lead = np.repeat([a for _, a, _ in kept], each)
                yield pa.record_batch([pa.array(p[rows]), _longs(np.repeat(np.array([m for m, _, _ in kept], np.uint64), each)), pa.array(n[rows]), pa.array(fp[rows]), pa.array(n[lead]), pa.array(fp[lead])], ["p", "members", "n", "fp", "lead_n", "lead"])

    dealt = documents.where("doc_id is not null").select("doc_id", "text").mapInArrow(spread, "p long, n int, fp long").repartition("p").sortWithinPartitions("p", "n", "fp")
    found = materialise(dealt.mapInArrow(several, "p long, members long, n int, fp long, lead_n int, lead long"), "buckets")
    first = found.where("fp = lead").groupBy("members").agg(F.min("p").alias("p"))
    return found.join(first, ["members", "p"], "left_semi").select(F.col("members").alias("p"), "n", "fp", "lead_n", "lead")


def best_leads(shared: DataFrame, most: int = LEADS) -> DataFrame:
    """Pairs a, b of a node and the leads that it shares most prefix shingles with, if their sizes allow 4/5."""
    counted = shared.where("fp <> lead and 4L * n <= 5L * lead_n and 4L * lead_n <= 5L * n").groupBy("fp", "lead").count()
    best = counted.groupBy("fp").agg(F.slice(F.sort_array(F.collect_list(F.struct("count", "lead")), asc=False), 1, most).alias("best"))
    return best.select(F.col("fp").alias("a"), F.explode(F.transform("best", lambda x: x["lead"])).alias("b"))


def trie_pairs(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """Pairs a, b of nodes whose fingerprints the binary trie self-join links: a forest of them."""
    prints = materialise(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("first")), "stage-prints")
    n = prints.count()
    edges = simhash.link_edges(prints.select("fp"), budget, simhash.spare_blocks(n, budget), n)
    first = lambda x: prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
    across = edges.join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    own = F.min("fp").over(W.partitionBy("sim"))
    equal = nodes.select("fp", own.alias("b")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return across.unionByName(equal)


def open_pairs(rooted: DataFrame, most: int | None) -> DataFrame:
    """Pairs a, b of a bucket's nodes with different roots whose sizes and bit maps allow 4/5.

    ``rooted``: p, n, fp, root, map and firsts. A pair that surely meets in a bucket before
    this one is left to that. Each node names the ``most`` best of its partners, or all.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, held = [], [], 0
        for p, n, fp, root, maps, own_firsts in simhash.whole_buckets(batches):
            maps = maps.view(np.uint64)  # the bits of a signed number are counted without its sign
            firsts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            lasts = np.r_[firsts[1:], len(p)]
            mixed = np.minimum.reduceat(root, firsts) != np.maximum.reduceat(root, firsts)
            for first, last in zip(firsts[mixed].tolist(), lasts[mixed].tolist(), strict=True):
                size, step = n[first:last].astype(np.int64), max(1, FLUSH // (last - first))
                for i in range(first, last, step):
                    rows = slice(i, min(i + step, last))
                    own = n[rows].astype(np.int64)[:, None]
                    unlike = np.bitwise_count(maps[rows, None, :] ^ maps[None, first:last, :]).sum(-1, dtype=np.int64)
                    good = (root[rows, None] != root[None, first:last]) & (9 * unlike <= own + size) & (4 * own <= 5 * size) & (4 * size <= 5 * own)
                    if most and last - first > most:
                        cost = np.where(good, unlike / (own + size), 2.0)
                        picked = np.argpartition(cost, most - 1, axis=1)[:, :most]
                        best = np.zeros_like(good)
                        np.put_along_axis(best, picked, True, axis=1)
                        good &= best
                    x, y = np.nonzero(good)
                    if len(x):
                        fresh = ~_met_before(own_firsts[rows], own_firsts[first:last], x, y, p[first])
                        x, y = x[fresh], y[fresh]
                    if len(x):
                        left.append(fp[rows][x])
                        right.append(fp[first:last][y])
                        held += len(x)
                    if held > FLUSH:
                        yield _distinct(left, right)
                        left, right, held = [], [], 0
        if held:
            yield _distinct(left, right)

    return rooted.select("p", "n", "fp", "root", "map", "firsts").repartition("p").sortWithinPartitions("p").mapInArrow(apply, "a long, b long")


def still_open(shared: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """p, n, fp, root, map and firsts (the node's first such buckets) of the buckets whose nodes have several roots."""
    rooted = shared.select("p", "n", "fp").join(roots, shared.fp == roots.node, "left").select("p", "n", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("p").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("p")
    found = materialise(rooted.join(mixed, "p", "left_semi"), "open")
    padding = F.array_repeat(F.lit((1 << 63) - 1), FIRSTS)
    firsts = found.groupBy("fp").agg(F.slice(F.concat(F.sort_array(F.collect_list("p")), padding), 1, FIRSTS).alias("firsts"))
    return found.join(nodes.select("fp", "map").join(firsts, "fp"), "fp")


def _met_before(left: np.ndarray, right: np.ndarray, x: np.ndarray, y: np.ndarray, bucket: int) -> np.ndarray:
    """True for pairs whose first buckets name a common one before ``bucket``."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), 1 << 13):
        a, b = left[x[i : i + (1 << 13)]], right[y[i : i + (1 << 13)]]
        out[i : i + (1 << 13)] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < bucket)).any((1, 2))
    return out


def _distinct(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def alike(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs whose bit maps allow 4/5: such sets have at most a ninth of both sizes unlike."""
    a, b = (maps.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}")) for x in "ab")
    unlike = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(9 * unlike <= F.col("na") + F.col("nb")).select("a", "b")


def verified(pairs: DataFrame, documents: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs a, b of nodes whose sets have a Jaccard similarity of 4/5 or more."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialise(alike(pairs, nodes), "pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    wanted = materialise(ends.join(nodes.select("fp", "low"), "fp").select(F.col("low").alias("doc_id"), "fp"), "wanted")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for part, sets in _sets(batches, width):
            own = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            good = own == part.column(0).to_numpy()  # a repeated doc_id may have another text
            sets = [s for s, g in zip(sets, good, strict=True) if g]
            columns = pa.array(own[good]), pa.array([len(s) for s in sets], pa.int32()), pa.array([bit_map(s, WIDE_BITS) for s in sets], kind), pa.array([s.view(np.int64) for s in sets], kind)
            yield pa.record_batch(list(columns), ["fp", "n", "map", "shingles"])

    texts = documents.select("doc_id", "text").join(wanted, "doc_id").select("fp", "text")
    sets = materialise(texts.mapInArrow(apply, "fp long, n int, map array<bigint>, shingles array<bigint>"), "sets")
    close = materialise(alike(pairs, sets.drop("shingles")).distinct(), "close")  # a node's row may repeat with its doc_id
    own = sets.select("fp", "shingles")
    both = close.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("shared"))
    links = materialise(shared.where("9 * shared >= 4 * total").select("a", "b"), "verified")  # shared / (total - shared) >= 4/5
    for table in (pairs, wanted, sets, close):
        discard(table)
    return links


def near_duplicates(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (hash of the set, signed long) and component_id (smallest doc_id reachable over links)."""
    prints = materialise(set_hashes(documents, width), "sets-hashed")
    firsts = [F.first(c).alias(c) for c in ("n", "sim", "map")]
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies"), *firsts), "nodes")
    shared = materialise(shared_prefixes(documents, prints.count(), width), "prefixes")
    links = verified(trie_pairs(nodes).unionByName(best_leads(shared)), documents, nodes, width)
    for most in (PARTNERS, None):  # first the best partners of each node, then all that are still unlinked
        rooted = still_open(shared, simhash.connected(links, "rounds"), nodes)
        more = verified(open_pairs(rooted, most), documents, nodes, width)
        if more.isEmpty():
            continue  # the best by bit maps may all be wrong, as maps of long texts are full
        links = materialise(links.unionByName(more), "links")
    ids = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    repeated = prints.join(ids, "doc_id").select(F.col("fp").alias("a"), "b")
    return simhash.grouped(prints.select("doc_id", "fp"), nodes, simhash.connected(links.unionByName(repeated)))


def filter_documents(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """One document of each group, that with the smallest doc_id, all columns as they are."""
    return simhash.keep_first(documents, near_duplicates(documents, width))
