"""Source divergence audit: term shares of sources against their language and each other.

Terms are counted by (lang, source), added up within each task before anything is shuffled.
A language keeps the terms of at least ``min_documents`` of its documents. Shares are whole
numbers, p = 1 + floor(10**9 (count + 1) / (N + V)), and a difference of shares is worth
f(p, q) = floor((p - q)**2 / q).

Ranked terms by radix selection: histograms over the bits of the values, highest bits
first, are added up over all tasks and show in which digit each group's kth value lies;
rows above it are taken, rows below it are dropped, rows in it go to the next digits.
Rows that tie at the kth value are refined the same way by the bytes of their terms in
UTF-8. What is left is at most k rows, and a few that still tie, for each group.

Pairs of sources, sparse and corrected by a baseline: a term that neither source has gives
the same f(p0, q0), so the sum over all terms is V f(p0, q0), plus a correction of the terms
that the one or the other has, plus one of the terms that both have. Sources lie in squares
of ``SIDE`` x ``SIDE``; the terms of a language are dealt out over many tasks, and each adds
up its corrections for a square before it passes them on: no row is made for a pair and a term.

Defined results for odd input: null text, lang and source are ''; a row counts as a document
of its own even if it repeats; a language without kept terms gives pairs of value 0 and no
terms; a language with one source has no pairs; equal values go by the UTF-8 order of the
items; an empty table gives an empty result; extra columns are ignored; a very long text is
counted like any other. Counts are exact below 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import discard, materialise

UNIT = 1_000_000_000
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
FLUSH = 200_000
SIDE = 256
ROWS_A_TASK = 100_000
DIGIT_BITS, VALUE_BITS = 12, 60
TIE_BYTES = 2
PAIRS_AT_ONCE = 1 << 19


def count_terms(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def flushed(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            seen = docs[lang, source]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array([t.decode() for t in own], pa.string()), pa.array(list(own.values()), pa.int64()), pa.array([seen[t] for t in own], pa.int64())], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(Counter)
        docs: dict = defaultdict(Counter)
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own, known = Counter(text.as_py().encode().translate(_LETTERS).split()), counts[lang, source]
                held -= len(known)
                known.update(own)
                docs[lang, source].update(own.keys())
                held += len(known)
                if held > FLUSH:
                    yield from flushed(counts, docs)
                    counts.clear()
                    docs.clear()
                    held = 0
        yield from flushed(counts, docs)

    rows = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 (count + 1) / total)."""
    wide = (F.coalesce(count, F.lit(0)) + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.call_function("div", wide, total) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


# Ranked terms


def _cut(rows: DataFrame, group: list[str], digit: Column, order: Column, enough: int) -> tuple[DataFrame, DataFrame]:
    """(rows that stay in the running for good, rows still open) after a digit of the radix selection.

    ``_left`` is how many of a group's rows are still to be found among ``rows``. A group
    stays open where its digit holds over ``enough`` rows.
    """
    keyed = rows.withColumn("_digit", digit)
    counts = keyed.groupBy(*group, "_digit").agg(F.count("*").alias("_here"), F.first("_left").alias("_left"))
    before = F.coalesce(F.sum("_here").over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_left", F.col("_left") - before).where(F.col("_left") > 0)
    found = keyed.drop("_left").join(placed, [*group, "_digit"])
    split = F.col("_here") > F.greatest(F.col("_left"), F.lit(enough))
    return found.where(~split).select(*[c for c in rows.columns if c != "_left"]), found.where(split).select(*rows.columns)


def top_by_radix(rows: DataFrame, group: list[str], value: str, item: str, k: int, enough: int = 1_000) -> DataFrame:
    """The k rows of each group with the highest ``value`` (0 to 2**60 - 1), ties by the bytes of ``item``, with ``rank``."""
    v = F.col(value)
    bits = F.length(F.bin(v))
    low = [(F.shiftright(v, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)), F.desc("_digit")) for shift in range(VALUE_BITS - DIGIT_BITS, -1, -DIGIT_BITS)]
    digits = [(bits * 64 + F.call_function("shiftright", v, F.greatest(bits - 7, F.lit(0))).bitwiseAND(F.lit(63)), F.desc("_digit")), *low]  # the length and the six bits below the highest come first
    still, done = rows.withColumn("_left", F.lit(k).cast("bigint")), []
    at, width = 1, TIE_BYTES
    while True:
        if digits:
            digit, order = digits.pop(0)
        else:
            digit, order = F.substring(F.encode(item, "UTF-8"), at, width), F.asc("_digit")
            at, width = at + width, 2 * width
        kept, further = _cut(still, group, digit, order, enough)
        done.append(kept)
        still = materialise(further, "radix-open")
        if still.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(W.partitionBy(*group).orderBy(v.desc(), F.col(item)))  # k + enough rows of a group at most
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# Pairs of sources


def _square(lang: str, table: pa.Table) -> pa.Table:
    """The corrections of a square of sources for some of a language's terms."""
    side, number, p = (table.column(c).to_numpy() for c in ("side", "number", "p"))
    codes = table.column("term").combine_chunks().dictionary_encode().indices
    base = codes.is_null().to_numpy(zero_copy_only=False)
    code = codes.fill_null(-1).to_numpy(zero_copy_only=False)
    sides = []
    for bit in (1, 2):
        mine = (side & bit) > 0
        names, first = np.unique(number[mine & base], return_index=True)
        rows = mine & ~base
        sides.append((names, p[mine & base][first], np.searchsorted(names, number[rows]), p[rows], code[rows]))
    (left, p0, i, pi, ci), (right, q0, j, qj, cj) = sides
    zero = _differ(p0[:, None], q0[None, :])
    out = np.zeros(zero.shape, np.int64)

    def one_sided(slots: np.ndarray, shares: np.ndarray, total: np.ndarray, worth) -> None:
        """Terms that this side has, against the other side's baselines; equal shares are counted once."""
        for s in np.unique(slots):
            each, n = np.unique(shares[slots == s], return_counts=True)
            step = max(1, PAIRS_AT_ONCE // total.shape[1])
            for a in range(0, len(each), step):
                total[s] += (n[a : a + step, None] * worth(s, each[a : a + step, None])).sum(axis=0)

    one_sided(i, pi, out, lambda s, x: _differ(x, q0[None, :]) - zero[s])
    one_sided(j, qj, out.T, lambda s, x: _differ(p0[None, :], x) - zero[:, s])
    order = np.argsort(cj, kind="stable")
    j, qj, cj = j[order], qj[order], cj[order]
    starts, sizes = np.searchsorted(cj, ci, "left"), np.searchsorted(cj, ci, "right") - np.searchsorted(cj, ci, "left")
    ends = sizes.cumsum()
    a = 0
    while a < len(ci):  # terms that both have, some rows of the left side at a time
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS_AT_ONCE, "right")))
        n = sizes[a:b]
        l = np.repeat(np.arange(a, b), n)  # noqa: E741
        r = np.repeat(starts[a:b] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(len(l))
        g = _differ(pi[l], qj[r]) - _differ(pi[l], q0[j[r]]) - _differ(p0[i[l]], qj[r]) + zero[i[l], j[r]]
        np.add.at(out, (i[l], j[r]), g)
        a = b
    x, y = np.nonzero(left[:, None] != right[None, :])
    return pa.table({"lang": pa.array([lang] * len(x), pa.string()), "left": left[x], "right": right[y], "value": out[x, y]})


def pair_values(shares: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, left, right, value): the corrections of all pairs of sources of a language, by number."""
    block = F.floor(F.col("number") / SIDE)
    whole = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda x: F.when(x == block, F.array(F.struct(x.alias("a"), x.alias("b"), F.lit(3).alias("side")))).otherwise(F.array(F.struct(block.alias("a"), x.alias("b"), F.lit(1).alias("side")), F.struct(x.alias("a"), block.alias("b"), F.lit(2).alias("side")))))
    dealt = lambda df: df.withColumn("_at", F.explode(F.flatten(whole))).select("lang", "part", "_at.*", "number", "term", "p")
    terms = shares.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))
    bases = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("p0"))
    rows = dealt(terms).unionByName(dealt(bases))
    found = rows.groupBy("lang", "part", "a", "b").applyInArrow(lambda key, table: _square(key[0].as_py(), table), "lang string, left long, right long, value long")
    return found.groupBy("lang", "left", "right").agg(F.sum("value").alias("value"))


def audit_sources(documents: DataFrame, min_documents: int = 3, k: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): sources ranked by divergence, and each source's ``k`` most over-used terms."""
    counts = materialise(count_terms(documents), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents).drop("docs")
    kept = materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    discard(counts)
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n"), F.count("*").alias("rows")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"), F.sum("rows").alias("rows"))
    groups = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    of_lang = W.partitionBy("lang")
    known = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("bigint").alias("number"), F.coalesce("v", zero).alias("v"),
        F.greatest(F.coalesce("total", zero) + F.coalesce("v", zero), F.lit(1)).alias("total"), (F.col("lang_total") + F.col("v")).alias("lang_total"),
        F.ceil(F.count("*").over(of_lang) / SIDE).alias("blocks"), F.greatest(F.ceil(F.coalesce("rows", zero) / ROWS_A_TASK), F.lit(1)).cast("bigint").alias("parts"),
    )
    known = materialise(known.withColumn("p0", share(F.lit(0).cast("bigint"), F.col("total"))), "sources")
    shares = kept.join(known, ["lang", "source"]).select("lang", "source", "number", "blocks", "parts", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    shares = materialise(shares, "shares")
    discard(kept)
    over = shares.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    ranked_terms = top_by_radix(over, ["lang", "source"], "value", "item", k)
    one = lambda number, name, base: known.select("lang", F.col("number").alias(number), F.col("source").alias(name), F.col("p0").alias(base), *(["v"] if number == "left" else []))
    pairs = pair_values(shares, known).join(one("left", "source", "_p"), ["lang", "left"]).join(one("right", "item", "_q"), ["lang", "right"])
    value = F.when(F.col("v") == 0, zero).otherwise(F.col("value") + F.col("v") * difference(F.col("_p"), F.col("_q")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked_pairs.unionByName(ranked_terms)
