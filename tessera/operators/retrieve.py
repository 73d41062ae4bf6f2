"""The three retrieval routes and their fusion.

Routes read a ``chunks`` table (workspace, entry_id, chunk_no, start, chunk_text and
the metadata columns), a ``vectors`` table and a ``headings`` table. Texts are
needed only to compute scores; they never go through a sort or a join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import postings
from . import query as q

KEYWORD_RECALL, HEADING_RECALL = 500, 200
RRF_K = 60
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
KEY = ("workspace", "entry_id", "chunk_no")


def route_limit(limit: int) -> int:
    """How many hits each route hands to the fusion."""
    return min(max(3 * limit, 20), 100)


def clamp(limit: int) -> int:
    return min(max(limit, 1), 100)


def entry_filter(entries: DataFrame, query: q.Query) -> DataFrame | None:
    """entry_id of the entries that meet all column and range filters, or None without any.

    Dates are compared as text, so ``<=2019`` leaves out 2019-05.
    """
    compare = {">=": Column.__ge__, "<=": Column.__le__, ">": Column.__gt__, "<": Column.__lt__}
    tests = [q.contains(F.col(c), v) for c, v in query.filters] + [compare[op](F.col(c), F.lit(v)) for c, op, v in query.ranges]
    return entries.where(reduce(Column.__and__, tests)).select("entry_id") if tests else None


def bm25(table: DataFrame, query: q.Query, columns: tuple[str, ...], group: str = "workspace", carried: list[Column] | None = None) -> DataFrame:
    """``table`` with ``bm25`` (lower is better), from the statistics of each workspace's whole table.

    ``carried`` are computed where the texts lie and pass the join with the statistics instead of the table's columns.
    """
    terms = [t for t in query.terms if set(t.columns) & set(columns)]
    length = sum((F.greatest(F.lit(0), F.length(F.coalesce(F.col(c), F.lit(""))) - (q.TRIGRAM - 1)) for c in columns), F.lit(0))
    counted = table.withColumn("_length", length.cast("double"))
    for i, t in enumerate(terms):
        counted = counted.withColumn(f"_f{i}", sum((q.occurrences(F.col(c), t.body) for c in t.columns if c in columns), F.lit(0)).cast("double"))
    whole = counted.groupBy(F.col(group).alias("_group")).agg(
        F.count("*").cast("double").alias("_n"), F.avg("_length").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"_n{i}") for i in range(len(terms))]
    )
    if carried is not None:
        counted = counted.select(F.col(group).alias("_of"), *carried, "_length", *[f"_f{i}" for i in range(len(terms))])
    joined = counted.join(whole, F.col(group if carried is None else "_of").eqNullSafe(F.col("_group")))
    kept = table.columns if carried is None else [c for c in counted.columns if c not in ("_of", "_length") and c not in {f"_f{i}" for i in range(len(terms))}]
    return joined.select(*kept, _bm25_of(len(terms)).alias("bm25"))


def _bm25_of(n_terms: int) -> Column:
    """BM25 (lower is better) from _f<i>, _length and the statistics _n, _mean and _n<i>."""

    def part(i: int) -> Column:
        idf = F.log((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        f = F.col(f"_f{i}")
        return F.when(idf > 0, idf).otherwise(IDF_FLOOR) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))

    return -sum((part(i) for i in range(n_terms)), F.lit(0.0))


@dataclass
class KeywordIndex:
    """The stored index of ``postings.build`` and its statistics by workspace."""

    postings: DataFrame
    statistics: DataFrame


def indexed_matches(index: KeywordIndex, query: q.Query) -> DataFrame:
    """Key, start, bm25, coverage, tf and first of the chunks that a query's expression holds for, from the index alone."""
    terms, groups = query.terms, [i for i in query.items if isinstance(i, q.Near)]
    counted = postings.term_counts(index.postings, query)
    frequency = counted.groupBy(F.col("workspace").alias("_group")).agg(*[F.count_if(F.col(f"_f{i}") > 0).cast("double").alias(f"_n{i}") for i in range(len(terms))])
    whole = index.statistics.select("workspace", F.col("n").cast("double").alias("_n"), (F.col("length") / F.col("n")).alias("_mean"))

    def known(item: q.Term | q.Near) -> Column:
        if isinstance(item, q.Near):
            return F.col(f"_near{[g is item for g in groups].index(True)}")
        return F.col(f"_f{[(t.body, t.column) for t in terms].index((item.body, item.column))}") > 0

    joined = counted.join(frequency, F.col("workspace").eqNullSafe(F.col("_group"))).drop("_group").join(whole, "workspace")
    return joined.where(q.condition(query, F.col, known=known)).select(*KEY, "start", F.round(_bm25_of(len(terms)), 12).alias("bm25"), "coverage", "tf", "first")


def keyword_route(chunks: DataFrame, query: q.Query, limit: int = 20, allowed: DataFrame | None = None, index: KeywordIndex | None = None) -> DataFrame:
    """Keyword hits: key, route_rank, score, bm25, coverage, tf, hit_offset, match_mode.

    With an ``index`` the expression is answered from the postings of its trigrams, and
    ``chunks`` are read for short terms only.

    Up to 500 best by BM25, of these the best by coverage, reranked by coverage,
    capped term frequency and BM25. Short terms add hits that hold all of them.
    """
    body = F.col("chunk_text")
    n = len(query.phrases)
    low = F.lower(body)
    places = [F.instr(low, p.lower()) for p in query.phrases]
    count = lambda p: ((F.length(low) - F.length(F.replace(low, F.lit(p.lower()), F.lit("")))) / len(p)).cast("bigint")
    coverage = sum(((x > 0).cast("int") for x in places), F.lit(0))
    tf = sum((F.least(F.lit(5), count(p)) for p in query.phrases), F.lit(0))
    first = reduce(F.least, [F.when(x > 0, x) for x in places]) if n > 1 else F.when(places[0] > 0, places[0]) if n else F.lit(None)
    keys = [F.col(k) for k in KEY]
    found = []
    test = q.condition(query, F.col)
    if test is not None:
        if index is not None and postings.usable(query):
            rows = indexed_matches(index, query)
            coverage, tf, first = F.col("coverage"), F.col("tf"), F.col("first")
        else:
            own = [coverage.alias("coverage"), tf.alias("tf"), first.cast("bigint").alias("first")]
            rows = bm25(chunks, query, q.TEXT_COLUMNS, carried=[*keys, F.col("start"), test.alias("_holds"), *own]).where("_holds")
            coverage, tf, first = F.col("coverage"), F.col("tf"), F.col("first")
        if allowed is not None:
            rows = rows.join(allowed, "entry_id", "left_semi")
        rows = rows.select(*keys, F.round("bm25", 12).alias("bm25"), coverage.cast("bigint").alias("coverage"), tf.cast("bigint").alias("tf"), (F.col("start") + first - 1).cast("bigint").alias("hit_offset"))
        order = ["bm25", "entry_id", "chunk_no"]
        rows = rows.orderBy(*order).limit(KEYWORD_RECALL)
        if n:
            rows = rows.orderBy(F.desc("coverage"), *order).limit(max(60, 3 * limit))
            order = [F.desc("coverage"), F.desc("tf"), *order]
            rows = rows.withColumn("score", F.round(F.col("coverage") / F.lit(float(n)), 4))
        else:
            rows = rows.withColumn("score", F.lit(None).cast("double")).withColumn("hit_offset", F.lit(None).cast("bigint"))
        ranked = rows.orderBy(*order).limit(limit).withColumn("_order", F.row_number().over(W.orderBy(*order)))
        found.append(ranked.withColumn("match_mode", F.lit("fts")))
    if query.like_terms:
        test = reduce(Column.__and__, [low.contains(t.lower()) for t in query.like_terms])
        rows = chunks.where(test)
        if allowed is not None:
            rows = rows.join(allowed, "entry_id", "left_semi")
        at = reduce(F.least, [F.instr(low, t.lower()) for t in query.like_terms]) if len(query.like_terms) > 1 else F.instr(low, query.like_terms[0].lower())
        none = {"bm25": "double", "coverage": "bigint", "tf": "bigint"}
        rows = rows.select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in none.items()], (F.col("start") + at - 1).cast("bigint").alias("hit_offset"), F.lit(None).cast("double").alias("score"))
        rows = rows.orderBy("entry_id", "chunk_no").limit(limit)
        rows = rows.withColumn("_order", F.row_number().over(W.orderBy("entry_id", "chunk_no")) + 1_000).withColumn("match_mode", F.lit("like-low-precision"))
        found.append(rows)
    if not found:
        raise q.QueryError("empty_query")
    hits = reduce(DataFrame.unionByName, found)
    once = hits.withColumn("_place", F.row_number().over(W.partitionBy(*KEY).orderBy("_order"))).where("_place = 1")
    ranked = once.withColumn("route_rank", F.row_number().over(W.orderBy("_order")).cast("bigint"))  # at most two limits of rows
    return ranked.select(*KEY, "route_rank", "score", "bm25", "coverage", "tf", "hit_offset", "match_mode")


def cosine(vector: Column, unit_query: list[float]) -> Column:
    """The inner product with a query of unit length, in double precision."""
    wanted = F.array(*[F.lit(float(x)) for x in unit_query])
    return F.aggregate(F.zip_with(vector, wanted, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector divided by its length (a zero vector stays)."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(size == 0, 1.0).otherwise(size))


def vector_route(vectors: DataFrame, unit_query: list[float], limit: int = 20, allowed: DataFrame | None = None, most_allowed: int | None = None) -> DataFrame:
    """Nearest chunks by cosine: the best window of each, then the best ``limit``.

    ``most_allowed`` keeps the optional cap on filtered entries; beyond it the route is refused.
    """
    rows = vectors
    if allowed is not None:
        if most_allowed is not None and allowed.limit(most_allowed + 1).count() > most_allowed:
            raise q.QueryError("vector_candidates_exceeded", str(most_allowed))
        rows = rows.join(allowed, "entry_id", "left_semi")
    scored = rows.select(*KEY, "win_start", F.round(F.greatest(F.lit(0.0), cosine(F.col("embedding"), unit_query)), 4).alias("score"))
    best = scored.groupBy(*KEY).agg(F.max(F.struct(F.col("score"), -F.col("win_start"))).alias("best"))
    flat = best.select(*KEY, F.col("best.score").alias("score"), (-F.col("best.col2")).alias("win_start"))
    order = [F.desc("score"), "entry_id", "chunk_no"]
    return flat.orderBy(*order).limit(limit).withColumn("route_rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def heading_route(headings: DataFrame, query: q.Query, limit: int = 20, allowed: DataFrame | None = None) -> DataFrame:
    """Headings that match, best BM25 first: workspace, entry_id, heading_no, score, heading columns, route_rank."""
    test = q.condition(query, lambda c: F.col("heading_text") if c == "chunk_text" else F.lit(""))
    if test is None:
        return headings.limit(0).select("workspace", "entry_id", "heading_no", F.lit(0.0).alias("score"), "heading_text", "level", F.col("start").alias("heading_offset"), F.lit(0).cast("bigint").alias("route_rank"))
    table = headings.withColumn("chunk_text", F.col("heading_text"))
    scored = bm25(table, query, ("chunk_text",)).where(test)
    if allowed is not None:
        scored = scored.join(allowed, "entry_id", "left_semi")
    coverage = sum((q.contains(F.col("heading_text"), p).cast("int") for p in query.phrases), F.lit(0))
    score = F.round(coverage / F.lit(float(len(query.phrases))), 4) if query.phrases else F.lit(None).cast("double")
    rows = scored.select("workspace", "entry_id", "heading_no", score.alias("score"), "heading_text", "level", F.col("start").alias("heading_offset"), F.round("bm25", 12).alias("bm25"))
    order = ["bm25", "entry_id", "heading_no"]
    kept = rows.orderBy(*order).limit(min(HEADING_RECALL, max(3 * limit, 30)))
    return kept.withColumn("route_rank", F.row_number().over(W.orderBy(*order)).cast("bigint")).drop("bm25")


def fuse(keyword: DataFrame, vector: DataFrame, heading: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion; every candidate with its score, per-route scores and source.

    Key: (workspace, entry_id, unit), unit being the chunk or ``h`` and the heading number.
    """
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    parts = [
        keyword.select("workspace", "entry_id", F.col("chunk_no").cast("string").alias("unit"), F.lit("fts").alias("route"), "route_rank", "hit_offset", none("win_start", "bigint"), none("heading_offset", "bigint")),
        vector.select("workspace", "entry_id", F.col("chunk_no").cast("string").alias("unit"), F.lit("vector").alias("route"), "route_rank", none("hit_offset", "bigint"), "win_start", none("heading_offset", "bigint")),
        heading.select("workspace", "entry_id", F.concat(F.lit("h"), "heading_no").alias("unit"), F.lit("heading").alias("route"), "route_rank", none("hit_offset", "bigint"), none("win_start", "bigint"), "heading_offset"),
    ]
    share = F.lit(1.0) / (F.lit(float(k)) + F.col("route_rank"))
    of = lambda r: F.sum(F.when(F.col("route") == r, share).otherwise(0.0))
    grouped = reduce(DataFrame.unionByName, parts).groupBy("workspace", "entry_id", "unit").agg(
        of("fts").alias("fts"), of("vector").alias("vector"), of("heading").alias("heading"), F.max("hit_offset").alias("hit_offset"), F.max("win_start").alias("win_start"), F.max("heading_offset").alias("heading_offset")
    )
    source = F.when((F.col("fts") > 0) & (F.col("vector") > 0), "fused").when(F.col("fts") > 0, "fts").when(F.col("vector") > 0, "vector").otherwise("heading")
    total = F.round(F.col("fts") + F.col("vector") + F.col("heading"), 9)
    parts4 = [F.round(c, 4).alias(f"{c}_score") for c in ("fts", "vector", "heading")]
    return grouped.select("workspace", "entry_id", "unit", total.alias("total"), F.round(total, 4).alias("score"), *parts4, source.alias("score_source"), "hit_offset", "win_start", "heading_offset")


def top_fused(fused: DataFrame, limit: int = 20) -> DataFrame:
    """The best ``limit`` candidates with ``fused_rank``."""
    order = [F.desc("total"), "workspace", "entry_id", "unit"]
    return fused.orderBy(*order).limit(limit).withColumn("fused_rank", F.row_number().over(W.orderBy(*order)).cast("bigint"))


def place_of(hit: str = "hit_offset", window: str = "win_start", chunk: str = "start", heading: str = "heading_offset") -> Column:
    """Where a hit is in its text: hit, else window, else chunk, else heading."""
    return F.coalesce(F.col(hit), F.col(window), F.col(chunk), F.col(heading))


def by_section(hits: DataFrame) -> DataFrame:
    """Merge hits of one section; the best stands for all, route scores add up.

    ``hits``: workspace, entry_id, unit, fused_rank, section_no (null: none), the
    route scores and score_source. Hits outside any section stay apart. The order
    is that of each section's best member.
    """
    group = F.when(F.col("section_no").isNotNull(), F.concat(F.lit("s"), "section_no")).otherwise(F.concat(F.lit("r"), "fused_rank"))
    rows = hits.withColumn("_group", group)
    sums = {c: F.round(F.sum(c), 4) for c in ("fts_score", "vector_score", "heading_score")}
    labels = ("fused", "heading", "fts", "vector")
    source = F.concat_ws("+", *[F.when(F.max(F.col("score_source") == label), label) for label in labels])
    return rows.groupBy("workspace", "entry_id", "_group").agg(
        F.min("fused_rank").alias("section_rank"), F.min_by("unit", "fused_rank").alias("unit"), F.min("section_no").alias("section_no"),
        *[x.alias(c) for c, x in sums.items()], F.round(sums["fts_score"] + sums["vector_score"] + sums["heading_score"], 4).alias("score"),
        source.alias("score_source"), (F.count("*") - 1).alias("same_section_hits"),
    ).drop("_group")


def envelope(fused: DataFrame, keyword: DataFrame, vectors: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """One row about a search: candidates, truncation, filtered entries, misses."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = one(fused, "candidates_total").crossJoin(one(keyword, "keyword_hits")).crossJoin(one(vectors, "vectors_rows"))  # single rows
    row = row.crossJoin(one(allowed, "filtered_entries")) if allowed is not None else row.withColumn("filtered_entries", F.lit(None).cast("bigint"))
    return row.select("candidates_total", (F.col("candidates_total") > limit).alias("truncated_by_limit"), "filtered_entries", (F.col("keyword_hits") == 0).alias("keyword_miss"), "vectors_rows", (F.col("vectors_rows") == 0).alias("vector_zero_hint"))
