"""Ranked lexical search: block-max pruning over a forward index of document ranges.

Documents lie in blocks, ranges of rows as they are stored. A block is one row of the
index: the forward lists of its documents (packed) and, for each term it holds, the
number of documents with it and the maximum of its impact on any of them. Queries are
taken in rounds of a bounded number of terms, and each round is

1. Document frequencies of the round's terms, added up over the blocks.
2. Bounds: a block's bound for a query is the sum of weight times maximum. Of each query
   the ``SEEDS`` blocks with the highest bounds are scored; the k-th best score found
   is a threshold that no document of the answer stays below.
3. Each task sorts its blocks by their bounds, query by query, and scores them until the
   bound drops below the threshold, which rises with what the task has found. The k best
   of each task are merged.

Only the columns with the maxima are read in steps 1 and 2. Nothing is joined but the
seeds (at most ``SEEDS`` short rows for a query), and no block is sent anywhere.

The score is BM25-like, in whole numbers: the sum over a query's terms of ``weight`` times ``impact``.

Defined results for odd input: a null or empty text, or one without a term, is not in the
answer and isn't counted; rows without doc_id take no part; rows that repeat a doc_id are
documents of their own, each counted and ranked; rows of one item_id are one query with the
terms of all, an item without id or terms has no rows; equal scores go by doc_id; an empty
table gives an empty result; extra columns are ignored. A very long text is a block by itself.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

#: Terms are runs of digits, letters and all beyond ASCII: the bytes of terms, and a space for others.
_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
BLOCK_ROWS, BLOCK_POSTINGS = 16, 1 << 17
SEEDS = 16
PIECE = 256
ROUND_TERMS, ROUND_ITEMS = 1 << 17, 2048
INDEX = "block_id long, documents long, postings long, lists binary, terms binary, df binary, best binary"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased."""
    return text.encode().translate(_BYTES).split()


def impact(tf: np.ndarray, n_terms: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n_terms``, before the weight; grows with tf/m."""
    m = 50 + 50 * n_terms * documents // all_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _numbers(column: pa.Array, at: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), kind)


def build_index(documents: DataFrame) -> tuple[DataFrame, int]:
    """(blocks, number of documents with a term) of ``documents`` (doc_id, text)."""
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    counted = pa.schema([("documents", pa.int64()), ("terms", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(terms_of(text.as_py())) for text in batch.column(0)]
            yield _out(counted, [sum(n > 0 for n in sizes)], [sum(sizes)])

    known = rows.select("text").mapInArrow(count, "documents long, terms long").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    n_documents, n_terms = known.documents or 0, known.terms or 0
    schema = pa.schema([(c, pa.int64()) for c in ("block_id", "documents", "postings")] + [(c, pa.binary()) for c in ("lists", "terms", "df", "best")])

    def block(number: int, ids: list[int], found: list[Counter]) -> pa.RecordBatch:
        vocabulary: dict[bytes, int] = {}
        sizes = np.array([len(c) for c in found])
        lengths = np.array([c.total() for c in found])
        term_no = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for c in found for t in c), np.int32, sizes.sum())
        tf = np.fromiter((x for c in found for x in c.values()), np.int64, sizes.sum())
        worth = impact(tf, np.repeat(lengths, sizes), n_documents, n_terms)  # under 1,000,000
        best = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(best, term_no, worth)
        df = np.bincount(term_no, minlength=len(vocabulary))
        lists = b"".join([np.array(ids, np.int64).tobytes(), sizes.astype(np.int64).tobytes(), term_no.tobytes(), worth.astype(np.int32).tobytes()])
        values = [number, len(ids), len(term_no), pa.compress(lists, codec="zstd", asbytes=True), b" ".join(vocabulary), df.astype(np.int32).tobytes(), best.astype(np.int32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, found, postings = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = Counter(terms_of(text.as_py()))
                if not counts:
                    continue
                if found and (len(found) >= BLOCK_ROWS or postings + len(counts) > BLOCK_POSTINGS):
                    yield block(number, ids, found)
                    number, ids, found, postings = number + 1, [], [], 0
                ids.append(doc_id)
                found.append(counts)
                postings += len(counts)
        if found:
            yield block(number, ids, found)

    return materialise(rows.mapInArrow(blocks, INDEX), "forward-index"), n_documents


@dataclass
class Round:
    """The queries of a round: terms, their weights, and which queries have them."""

    items: list[int]
    vocabulary: pa.Array
    of_item: list[np.ndarray]
    starts: np.ndarray
    members: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(pairs: list[tuple[int, bytes]]) -> Round:
        items, vocabulary = sorted({i for i, _ in pairs}), sorted({t for _, t in pairs})
        item_no, term_no = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(vocabulary)}
        both = np.array(sorted((term_no[t], item_no[i]) for i, t in pairs), np.int64).reshape(-1, 2)
        by_item = both[np.argsort(both[:, 1], kind="stable")]
        ends = np.cumsum(np.bincount(by_item[:, 1], minlength=len(items)))
        starts = np.concatenate([[0], np.cumsum(np.bincount(both[:, 0], minlength=len(vocabulary)))])
        return Round(items, pa.array(vocabulary, pa.binary()), np.split(by_item[:, 0], ends[:-1]), starts, both[:, 1], np.zeros(len(vocabulary), np.int64))

    def asked(self, batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each block of a batch: (numbers in the round, numbers in the block) of the terms that the round asks for."""
        terms = [t.as_py().split(b" ") for t in batch.column("terms")]
        at = pc.index_in(pa.array(itertools.chain.from_iterable(terms), pa.binary()), value_set=self.vocabulary)
        here = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        found = at.take(pa.array(here)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum([len(t) for t in terms])
        cuts = np.searchsorted(here, ends)
        return [(found[a:b], here[a:b] - first) for a, b, first in zip([0, *cuts[:-1]], cuts, [0, *ends[:-1]], strict=True)]

    def bounds(self, batch: pa.RecordBatch, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(block, query): what no document of the block exceeds."""
        out = np.zeros((batch.num_rows, len(self.items)), np.int64)
        for at, (terms, here) in enumerate(asked):
            if len(terms):
                best = _numbers(batch.column("best"), at, np.int32)[here].astype(np.int64)
                sizes = self.starts[terms + 1] - self.starts[terms]
                first = np.repeat(self.starts[terms] - np.concatenate([[0], sizes.cumsum()[:-1]]), sizes)
                np.add.at(out[at], self.members[first + np.arange(len(first))], np.repeat(self.weights[terms] * best, sizes))
        return out


class Block:
    """A block's forward lists, read when its first query needs them."""

    def __init__(self, batch: pa.RecordBatch, at: int, terms: np.ndarray, here: np.ndarray):
        order = np.argsort(terms)
        self.batch, self.at, self.terms, self.here = batch, at, terms[order], here[order]
        self.lists: tuple[np.ndarray, ...] | None = None

    def scores(self, queries: Round, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, doc_ids) of the block's documents with a score above 0."""
        if self.lists is None:
            documents, postings = (self.batch.column(c)[self.at].as_py() for c in ("documents", "postings"))
            packed = pa.decompress(self.batch.column("lists")[self.at].as_buffer(), 16 * documents + 8 * postings, codec="zstd", asbytes=True)
            ids, sizes = np.frombuffer(packed, np.int64, 2 * documents).reshape(2, -1)
            term_no, worth = np.frombuffer(packed, np.int32, 2 * postings, 16 * documents).reshape(2, -1)
            self.lists = ids, np.concatenate([[0], sizes.cumsum()[:-1]]), term_no, worth, np.zeros(term_no.max() + 1, np.int64)
        ids, starts, term_no, worth, weights = self.lists
        wanted = queries.of_item[q]
        place = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        has = self.terms[place] == wanted
        own = self.here[place[has]]
        weights[own] = queries.weights[wanted[has]]
        found = np.add.reduceat(weights[term_no] * worth, starts)
        weights[own] = 0
        return found[found > 0], ids[found > 0]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _out(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``PIECE`` blocks at a time, which bounds what a task holds beside its batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def _frequencies(queries: Round) -> Callable:
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches):
        total = np.zeros(len(queries.vocabulary), np.int64)
        for batch in _pieces(batches):
            for at, (terms, here) in enumerate(queries.asked(batch)):
                total[terms] += _numbers(batch.column("df"), at, np.int32)[here]  # a block has a term once
        yield _out(schema, np.flatnonzero(total), total[total > 0])

    return run


def _seeds(queries: Round) -> Callable:
    schema = pa.schema([("item", pa.int64()), ("bound", pa.int64()), ("block_id", pa.int64())])

    def run(batches):
        n = len(queries.items)
        bounds, blocks = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        for batch in _pieces(batches):
            new, ids = queries.bounds(batch, queries.asked(batch)), batch.column("block_id").to_numpy()
            bounds, blocks = np.hstack([bounds, new.T]), np.hstack([blocks, np.broadcast_to(ids, (n, len(ids)))])
            top = np.argpartition(-bounds, min(SEEDS, bounds.shape[1] - 1), axis=1)[:, :SEEDS]
            bounds, blocks = np.take_along_axis(bounds, top, 1), np.take_along_axis(blocks, top, 1)
        item, seed = np.nonzero(bounds)
        yield _out(schema, item, bounds[item, seed], blocks[item, seed])

    return run


def _seed_scores(queries: Round, k: int) -> Callable:
    schema = pa.schema([("item", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in _pieces(batches):
            items, scores = [], []
            for at, (terms, here) in enumerate(queries.asked(batch)):
                block = Block(batch, at, terms, here)
                for q in batch.column("items")[at].as_py():
                    scores.append(_best(*block.scores(queries, q), k)[0])
                    items.append(np.full(len(scores[-1]), q))
            if items:
                yield _out(schema, np.concatenate(items), np.concatenate(scores))

    return run


def _search(queries: Round, thresholds: np.ndarray, k: int) -> Callable:
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64()), ("blocks", pa.int64())])

    def run(batches):
        limit = thresholds.copy()
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(queries.items)
        scored = seen = 0
        for batch in _pieces(batches):
            asked = queries.asked(batch)
            table = queries.bounds(batch, asked)
            blocks = [Block(batch, at, *own) for at, own in enumerate(asked)]
            seen += table.size
            for q in np.flatnonzero((table >= limit).any(axis=0)):
                for b in np.argsort(-table[:, q], kind="stable"):
                    if table[b, q] < limit[q]:
                        break
                    scored += 1
                    scores, ids = blocks[b].scores(queries, q)
                    new = scores >= limit[q]
                    if new.any():
                        found[q] = _best(np.concatenate([found[q][0], scores[new]]), np.concatenate([found[q][1], ids[new]]), k)
                        if len(found[q][0]) == k:
                            limit[q] = max(limit[q], found[q][0][-1])
        sizes = [len(ids) for _, ids in found]
        if sum(sizes):
            zero = np.zeros(sum(sizes), np.int64)
            yield _out(schema, np.repeat(np.arange(len(found)), sizes), np.concatenate([ids for _, ids in found]), np.concatenate([x for x, _ in found]), zero, zero)
        yield _out(schema, [None], [None], [None], [scored], [seen])

    return run


def _round(index: DataFrame, documents: int, queries: Round, k: int) -> DataFrame:
    heads = index.select("block_id", "terms", "df", "best")
    for row in heads.mapInArrow(_frequencies(queries), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # at most the round's terms
        queries.weights[row.term] = weight(row.df, documents)
    best_first = W.partitionBy("item").orderBy(F.desc("bound"), "block_id")
    seeds = heads.mapInArrow(_seeds(queries), "item long, bound long, block_id long").withColumn("_no", F.row_number().over(best_first)).where(F.col("_no") <= SEEDS)
    asked = seeds.groupBy("block_id").agg(F.collect_list("item").alias("items"))
    scored = index.join(F.broadcast(asked), "block_id").mapInArrow(_seed_scores(queries, k), "item long, score long")
    kth = scored.withColumn("_no", F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))).where(F.col("_no") == k)
    thresholds = np.ones(len(queries.items), np.int64)
    for row in kth.collect():  # one row for a query at most
        thresholds[row.item] = row.score
    names = index.sparkSession.createDataFrame(list(enumerate(queries.items)), "item long, item_id long")
    return index.mapInArrow(_search(queries, thresholds, k), "item long, doc_id long, score long, scored long, blocks long").join(F.broadcast(names), "item", "left").drop("item")


def search_parts(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame | None:
    """What the tasks of all rounds found: the k best of each task, and rows with ``scored`` of ``blocks`` pairs of query and block."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = list(set(terms_of(text.as_py())))
                yield _out(schema, [item] * len(own), own)

    asked = items.where("item_id is not null and text is not null").select("item_id", "text")
    pairs = materialise(asked.mapInArrow(split, "item_id long, term binary").distinct(), "query-terms")
    n_pairs, n_items = pairs.agg(F.count("*"), F.count_distinct("item_id")).first()
    index, n_documents = build_index(documents)
    if not n_pairs or not n_documents:
        return None
    rounds = max(-(-n_pairs // ROUND_TERMS), -(-n_items // ROUND_ITEMS))
    out = None
    for number in range(rounds):
        own = pairs.where(F.pmod(F.hash("item_id"), F.lit(rounds)) == number) if rounds > 1 else pairs
        rows = [(r.item_id, bytes(r.term)) for r in own.collect()]  # about ROUND_TERMS short rows
        if rows:
            found = _round(index, n_documents, Round.of(rows), k)
            out = found if out is None else out.unionByName(found)
    return out


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item."""
    parts = search_parts(documents, items, k)
    if parts is None:
        return documents.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return parts.where("doc_id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
