"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits; a bit is set if it is set in over half of the XXH64
values of the text's shingles. Two fingerprints link if they differ in at most
``budget`` bits. Distinct fingerprints are dealt out by their blocks: the bits are
cut into budget + 1 blocks, so that linked ones agree in at least one block, and
each (block, value) is a bucket. The fingerprints of a bucket are sorted, which
makes each trie node a range of rows. Pairs of nodes are traversed together, level
by level and for all buckets of a task at once: a pair splits into the pairs of
its children, a pair of unlike children has one more differing bit, and a pair
over the budget is dropped. With very many fingerprints there are more blocks, and
more of them must agree, so that buckets stay small. Nodes whose fingerprints are all linked with each
other already are dropped too, so a dense group costs about its size and not its
square. A task returns a spanning forest of the links it found, at most one edge
per row; the components come from distributed star contraction of these edges.

Defined results for odd input: a null or wordless text has fingerprint zero and
links like any other; a null doc_id takes no part in groups (component_id null)
and such rows are always kept; repeated rows and repeated doc_ids share their
group; an empty table gives an empty result; extra columns are ignored by
``near_duplicates`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .skew import join_groups

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
BITS = 64
BUCKET_ROWS = 4096
#: Fingerprints of a bucket that is dealt out once more, and rows a task should get.
HOT_BUCKET, TASK_ROWS = 1 << 17, 1 << 21
SALTS = 16


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words of the lower-cased text, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((hashed(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit fingerprint; 0 for a text without words."""
    return majority_bits(shingle_hashes(text, width))


def majority_bits(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(h), 4096):
        ones += np.unpackbits(h[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]) if len(h) else 0


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                fps = [fingerprint(t or b"", width) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(apply, "doc_id long, fp long")


def labels_of(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest row each of ``n`` rows is connected with by the edges a-b and earlier labels."""
    labels = np.arange(n) if labels is None else labels.copy()
    while len(a):
        la, lb = labels[a], labels[b]
        unlike = la != lb
        if not unlike.any():
            break
        a, b, la, lb = a[unlike], b[unlike], la[unlike], lb[unlike]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]
    return labels


def trie_links(group: np.ndarray, key: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """For each row the smallest row it is linked with, directly or not, in its own group.

    ``group`` is sorted, ``key`` (uint64) is sorted and distinct within a group and
    holds the ``bits`` low bits that the trie branches on, highest first.
    """
    n = len(key)
    labels = np.arange(n)
    firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    lasts = np.r_[firsts[1:], n]
    for allowed in (1, budget) if budget > 1 else (budget,):
        several = lasts - firsts > 1
        a0, a1 = firsts[several], lasts[several]
        frontier = (a0, a1, a0, a1, np.zeros(len(a0), np.int64))
        for level in range(bits - 1, -2, -1):
            todo: list[tuple[np.ndarray, ...]] = []
            for start in range(0, len(frontier[0]), 1 << 18):
                labels = _one_level(key, labels, tuple(x[start : start + (1 << 18)] for x in frontier), level, allowed, todo)
            if not todo:
                break
            frontier = tuple(map(np.concatenate, zip(*todo, strict=True)))
    return labels


def _one_level(key, labels, nodes, level, allowed, todo):
    """Settle small pairs of nodes, drop needless ones, split the others at bit ``level``."""
    a0, a1, b0, b1, d = nodes
    changes = np.r_[0, np.cumsum(labels[1:] != labels[:-1])] if len(labels) else labels
    joined = (changes[a0] == changes[a1 - 1]) & (changes[b0] == changes[b1 - 1]) & (labels[a0] == labels[b0])
    a0, a1, b0, b1, d = (x[~joined] for x in (a0, a1, b0, b1, d))
    whole = d + level + 1 <= allowed  # whatever the lower bits are, all of these link
    small = whole | ((a1 - a0) * (b1 - b0) <= 16)
    if small.any():
        s0, s1, t0, t1 = (x[small] for x in (a0, a1, b0, b1))
        count = (s1 - s0) * (t1 - t0)
        if whole.any():  # a star is enough for these
            star = whole[small]
            labels = labels_of(len(labels), *_stars(s0[star], s1[star], t0[star], t1[star]), labels)
            s0, s1, t0, t1, count = (x[~star] for x in (s0, s1, t0, t1, count))
        if len(count):
            of = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            wide = (t1 - t0)[of]
            left, right = s0[of] + k // wide, t0[of] + k % wide
            near = (left != right) & (np.bitwise_count(key[left] ^ key[right]) <= allowed)
            labels = labels_of(len(labels), left[near], right[near], labels)
        a0, a1, b0, b1, d = (x[~small] for x in (a0, a1, b0, b1, d))
    if len(a0):
        am, bm = _middles(key, a0, a1, level), _middles(key, b0, b1, level)
        own = (a0 == b0) & (a1 == b1)
        for x0, x1, y0, y1, more, use in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~own)):
            good = (x1 > x0) & (y1 > y0) & (d + more <= allowed)
            if use is not None:
                good &= use
            if good.any():
                todo.append((x0[good], x1[good], y0[good], y1[good], d[good] + more))
    return labels


def _stars(s0, s1, t0, t1):
    """Edges from the first row of each pair of ranges to all other rows of both."""
    froms, tos = [], []
    for x0, x1 in ((s0, s1), (t0, t1)):
        count = x1 - x0
        of = np.repeat(np.arange(len(count)), count)
        froms.append(s0[of])
        tos.append(x0[of] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return np.concatenate(froms), np.concatenate(tos)


def _middles(key, lo, hi, level):
    """The first row of each range whose bit ``level`` is set (rows are sorted and agree above it)."""
    lo, hi, bit = lo.copy(), hi.copy(), np.uint64(level)
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        set_ = ((key[np.minimum(mid, len(key) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & set_, mid, hi)
        lo = np.where(open_ & ~set_, mid + 1, lo)
    return lo


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of ``n`` blocks the 64 bits are cut into."""
    cuts = np.linspace(0, BITS, n + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def spare_blocks(n: int, budget: int) -> int:
    """How many blocks beyond one must agree, so that buckets of ``n`` fingerprints stay small."""
    spare = 0
    while spare < 3 and n >> ((1 + spare) * (BITS // (budget + 1 + spare))) > BUCKET_ROWS:
        spare += 1
    return spare


def _block(which: tuple[int, ...], cuts: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` in the chosen blocks, as one number."""
    out = F.lit(0).cast("bigint")
    for i in which:
        shift, width = cuts[i]
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def link_edges(distinct: DataFrame, budget: int = 4, spare: int = 0, n: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all linked ones: a forest per bucket.

    The bits are cut into budget + 1 + spare blocks. Linked fingerprints agree in
    1 + spare of them at least; each choice of so many blocks deals all rows out
    once, by the bits of the chosen blocks, and the tries branch on the others.
    A bucket of more than ``HOT_BUCKET`` fingerprints is dealt out once more, by
    blocks of its other bits, of which linked ones agree in one at least. Rows come
    sorted by bucket, so a task holds few buckets at a time, whatever its share is.
    """
    cuts = blocks(budget + 1 + spare)
    chosen = list(combinations(range(len(cuts)), 1 + spare))
    keyed = distinct.select("fp", F.posexplode(F.array(*(_block(which, cuts) for which in chosen))).alias("choice", "value"))
    hot = materialise(keyed.groupBy("choice", "value").count().where(F.col("count") > HOT_BUCKET).select("choice", "value"), "hot-buckets")
    no_sub = [F.lit(-1).alias("sub"), F.lit(0).cast("bigint").alias("sub_value")]
    subs = [[i for i in range(len(cuts)) if i not in which] for which in chosen]
    if hot.isEmpty():
        dealt = keyed.select("fp", "choice", "value", *no_sub)
    else:
        parts = F.element_at(F.array(*(F.array(*(_block((i,), _halves(cuts, rest, budget)) for i in range(budget + 1))) for rest in subs)), F.col("choice") + 1)
        again = keyed.join(hot, ["choice", "value"], "left_semi").select("fp", "choice", "value", F.posexplode(parts).alias("sub", "sub_value"))
        dealt = keyed.join(hot, ["choice", "value"], "left_anti").select("fp", "choice", "value", *no_sub).unionByName(again)
    n = distinct.count() if n is None else n
    tasks = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(chosen) // TASK_ROWS)
    keys = ["choice", "value", "sub", "sub_value"]
    dealt = dealt.select(*keys, "fp").repartition(tasks, *keys).sortWithinPartitions(*keys)

    def edges(choice: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forest of whole buckets of one choice."""
        value, sub, sub_value, fp = rest
        key, bits = np.zeros_like(fp), 0
        for i in subs[int(choice[0])]:
            shift, width = cuts[i]
            key = (key << np.uint64(width)) | ((fp >> np.uint64(shift)) & np.uint64((1 << width) - 1))
            bits += width
        new = np.r_[True, (value[1:] != value[:-1]) | (sub[1:] != sub[:-1]) | (sub_value[1:] != sub_value[:-1])]
        group = np.cumsum(new)
        order = np.lexsort((key, group))
        labels = trie_links(group[order], key[order], bits, budget)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return fp[order][labels[linked]].view(np.int64), fp[order][linked].view(np.int64)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_buckets(batches, len(keys)):
            columns[-1] = columns[-1].view(np.uint64)
            ends = np.r_[np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]]), len(columns[0])]
            for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                a, b = edges(*(c[start:stop] for c in columns))
                if len(a):
                    yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(apply, "a long, b long")


def _halves(cuts: list[tuple[int, int]], rest: list[int], budget: int) -> list[tuple[int, int]]:
    """``budget`` + 1 disjoint blocks inside the blocks ``rest``: an unlike bit spoils one of them at most."""
    pieces = [cuts[i] for i in rest]
    while len(pieces) < budget + 1:
        pieces.sort(key=lambda p: p[1])
        shift, width = pieces.pop()
        pieces += [(shift, width // 2), (shift + width // 2, width - width // 2)]
    return pieces[: budget + 1]


def whole_buckets(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[np.ndarray]]:
    """The columns of whole buckets; rows come sorted by the first ``keys`` columns. List columns become matrices."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in batch.columns]
        same = np.logical_and.reduce([c == c[-1] for c in new[:keys]])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held and any(h[-1] != c[0] for h, c in zip(held[-1][:keys], new[:keys], strict=True)):
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if cut:
            held.append([c[:cut] for c in new])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in new])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def connected(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of the edges, root being its component's smallest node.

    Alternates large-star and small-star: each step only groups by a node and takes
    minima, and rewrites edges to point at smaller nodes, until nothing changes.
    The edge table of each round is written to the shared folder.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        # large-star: neighbours above u go to the smallest of u and its neighbours
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: u and its neighbours below go to the smallest of these
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        after = materialise(after, name)
        n, check = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if (n, check) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, check)


def near_duplicates(documents: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id (smallest doc_id reachable over links)."""
    prints = materialise(fingerprints(documents, width), "fingerprints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "nodes")
    n = nodes.count()
    return grouped(prints, nodes, connected(link_edges(nodes.select("fp"), budget, spare_blocks(n, budget), n)))


def grouped(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of ``prints`` from the roots of linked nodes (fp, low, copies).

    A component may hold most nodes and a node most rows: nodes find the lowest id of
    their root over ``SALTS`` copies of it, rows find their node as ``join_groups`` does.
    """
    rooted = nodes.join(links, nodes.fp == links.node, "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("many")).where("many > 1")
    salted = lowest.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    classes = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(salted, ["root", "salt"], "left")
    classes = materialise(classes.select("fp", "copies", F.coalesce("component_id", "low").alias("component_id")), "classes")
    found = join_groups(prints, classes, "fp", prints.count())
    return found.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def filter_documents(documents: DataFrame, width: int = 4, budget: int = 4) -> DataFrame:
    """One document of each group, that with the smallest doc_id, all columns as they are.

    Of rows that repeat that doc_id one stays.
    """
    return keep_first(documents, near_duplicates(documents, width, budget))


def keep_first(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of each group with the smallest doc_id, and all rows without doc_id."""
    found = groups.select(F.col("doc_id").alias("id"), "component_id")
    first = found.where("id = component_id").groupBy("id").agg(F.count("*").alias("rows"))
    packed = documents.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))  # no clash with names of the table
    kept = packed.join(first, "id")
    once, again = kept.where("rows = 1").select("row.*"), kept.where("rows > 1").dropDuplicates(["id"]).select("row.*")
    return once.unionByName(again).unionByName(documents.where(F.col("doc_id").isNull()))
