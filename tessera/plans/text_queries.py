"""Registered queries: segmentation, headings, ledgers, sources, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import anchors as a
from ..operators import read
from ..operators import segment as s
from ..sources import subtitles
from . import model as m
from .registry import query

SENTENCE = "(?s)^.*[。！？.!?\\n]"


def cut_sql(start: str, size: int) -> str:
    """Where a text that goes on is cut: after the last sentence end of the far half, else at ``size``."""
    last = f"length(regexp_extract(text[{start} + 1:{start} + {size}], '{SENTENCE}'))"
    return f"CASE WHEN {last} > {size // 2 + 1} THEN {start} + {last} ELSE {start} + {size} END"


@query(f"""WITH RECURSIVE {m.ENTRIES_SQL},
w AS (
  SELECT entry_id, text, length(text)::BIGINT AS n, 0::BIGINT AS win_start, (CASE WHEN length(text) > 800 THEN {cut_sql("0", 800)} ELSE length(text) END)::BIGINT AS win_end FROM entries
  UNION ALL
  SELECT entry_id, text, n, a, (CASE WHEN n - a > 800 THEN {cut_sql("a", 800)} ELSE n END)::BIGINT FROM (SELECT entry_id, text, n, greatest(win_end - 100, win_start + 1) AS a FROM w WHERE win_end < n)
)
SELECT entry_id, win_start, win_end, md5(text[win_start + 1:win_end]) AS digest FROM w WHERE regexp_matches(text[win_start + 1:win_end], '\\S')""")
def windows_800_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.windows(m.entries(spark, sf_dir)).select("entry_id", "win_start", "win_end", F.md5("body").alias("digest"))


@query(f"""WITH RECURSIVE {m.ENTRIES_SQL},
trimmed AS (SELECT entry_id, text, (length(text) - length(ltrim(text, ' ' || chr(9) || chr(10) || chr(13))))::BIGINT AS p0, length(rtrim(text, ' ' || chr(9) || chr(10) || chr(13)))::BIGINT AS n FROM entries),
p AS (
  SELECT entry_id, text, n, p0 AS a, (CASE WHEN n - p0 > 1000 THEN {cut_sql("p0", 1000)} ELSE n END)::BIGINT AS b FROM trimmed
  UNION ALL SELECT entry_id, text, n, b, (CASE WHEN n - b > 1000 THEN {cut_sql("b", 1000)} ELSE n END)::BIGINT FROM p WHERE b < n
),
pieces AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY a) AS i FROM p),
c AS (
  SELECT entry_id, i, a AS start, b AS stop, 0::BIGINT AS chunk_no FROM pieces WHERE i = 1
  UNION ALL
  SELECT q.entry_id, q.i, CASE WHEN c.stop - c.start + q.b - q.a > 1000 THEN greatest(0, c.stop - 50) ELSE c.start END, q.b, c.chunk_no + CASE WHEN c.stop - c.start + q.b - q.a > 1000 THEN 1 ELSE 0 END
  FROM c JOIN pieces q ON q.entry_id = c.entry_id AND q.i = c.i + 1
)
SELECT entry_id, chunk_no, min(start) AS start, max(stop) AS stop FROM c GROUP BY ALL""")
def chunks_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1,000 characters with 50 of overlap (texts of this table have no blank lines)."""
    return s.chunks(m.entries(spark, sf_dir), size=1000, overlap=50).select("entry_id", "chunk_no", "start", "stop")


PARAGRAPH_TEXT = "replace(text, '. ', '.' || chr(10) || ' ' || chr(10))"


@query(f"""WITH {m.ENTRIES_SQL},
parts AS (SELECT entry_id, unnest(regexp_split_to_array({PARAGRAPH_TEXT}, '\\n\\s*\\n')) AS part FROM entries),
tidy AS (SELECT entry_id, trim(part, ' ' || chr(10) || chr(9) || chr(13)) AS part FROM parts)
SELECT entry_id, count(*) AS paragraphs, sum(length(part))::BIGINT AS chars FROM tidy WHERE part <> '' GROUP BY entry_id""")
def para_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.entries(spark, sf_dir).select("entry_id", F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    return s.paragraph_rows(rows).groupBy("entry_id").agg(F.count("*").alias("paragraphs"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


@query(f"WITH {m.ENTRIES_SQL}, {m.LINES_SQL} SELECT entry_id, line_no, start, length(line)::BIGINT AS chars FROM lines")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.lines(spark, sf_dir).select("entry_id", "line_no", "start", F.length("line").cast("bigint").alias("chars"))


#: One step a piece: a part is cut at its last sentence end, and a slice ends before the piece that would overfill it.
SLICES_SQL = rf"""WITH RECURSIVE {m.ENTRIES_SQL},
split AS (SELECT entry_id, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') AS paras, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS rows FROM entries),
parts AS (SELECT entry_id, CASE WHEN len(paras) > 1 THEN paras ELSE rows END AS parts FROM split),
steps AS (
  SELECT entry_id, parts, 1 AS part_no, parts[1] AS rest, '' AS held, 0 AS size, 0 AS slice_no, NULL::VARCHAR AS done FROM parts
  UNION ALL
  SELECT entry_id, parts, CASE WHEN after = '' THEN part_no + 1 ELSE part_no END, CASE WHEN after = '' THEN parts[part_no + 1] ELSE after END,
    CASE WHEN full_up AND tail = '' OR held = '' THEN piece WHEN full_up THEN tail || chr(10) || chr(10) || piece ELSE held || chr(10) || chr(10) || piece END,
    (CASE WHEN full_up THEN length(tail) ELSE size END + length(piece) + 1)::INTEGER, slice_no + full_up::INTEGER, CASE WHEN full_up THEN held END
  FROM (SELECT *, held <> '' AND size + length(piece) + 1 > 1000 AS full_up, trim(held[greatest(1, length(held) - 99):], ' ' || chr(10) || chr(9) || chr(13)) AS tail
    FROM (SELECT *, trim(rest[1:cut], ' ' || chr(9) || chr(13)) AS piece, trim(rest[cut + 1:], ' ' || chr(9) || chr(13)) AS after
      FROM (SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN stop > 501 THEN stop ELSE 1000 END AS cut
        FROM (SELECT *, length(regexp_extract(rest[1:1000], '(?s)^.*[。！？.!?\n]')) AS stop FROM steps WHERE rest IS NOT NULL)))))
SELECT entry_id, slice_no::BIGINT AS slice_no, length(body)::BIGINT AS chars, left(sha256(body), 16) AS sha256
FROM (SELECT entry_id, slice_no - 1 AS slice_no, done AS body FROM steps WHERE done IS NOT NULL UNION ALL SELECT entry_id, slice_no, held FROM steps WHERE rest IS NULL)"""


@query(SLICES_SQL)
def slice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices' manifest (sizes and hashes) with slices of 1,000 characters; a recurrence over joined texts."""
    return s.slice_manifest(m.entries(spark, sf_dir), size=1000, overlap=100)


#: Lines of documents with heading marks put before some of them.
MARKED = "CASE WHEN line_no % 5 = 0 THEN '## ' || left(line, 30) WHEN line_no % 5 = 1 THEN 'Chapter ' || line_no WHEN line_no % 5 = 2 THEN '1.2.3 ' || left(line, 8) WHEN line_no % 5 = 3 THEN 'Running head' ELSE line END"
LEVEL = "CASE WHEN regexp_matches(x, '^#{1,6}\\s+.+') THEN length(regexp_extract(x, '^(#+)', 1)) WHEN length(trim(x)) <= 60 AND NOT regexp_matches(trim(x), '[。！？；!?;.]$') THEN CASE WHEN regexp_matches(trim(x), '(?i)^chapter\\s+[0-9]+') THEN 1 WHEN regexp_matches(trim(x), '^[0-9]+(\\.[0-9]+)+\\s*\\S') THEN least(6, 1 + length(regexp_extract(trim(x), '^[0-9]+(\\.[0-9]+)+\\s*\\S')) - length(replace(regexp_extract(trim(x), '^[0-9]+(\\.[0-9]+)+\\s*\\S'), '.', ''))) END END"
MARKED_SQL = f"""{m.ENTRIES_SQL}, {m.LINES_SQL},
shaped AS (SELECT entry_id, line_no, {MARKED} AS x FROM lines),
placed AS (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY entry_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM shaped),
levelled AS (SELECT entry_id, start, ({LEVEL})::BIGINT AS level, CASE WHEN regexp_matches(x, '^#{{1,6}}\\s+.+') THEN regexp_replace(trim(x), '^#+\\s+', '') ELSE trim(x) END AS heading_text FROM placed),
counted AS (SELECT *, count(*) OVER (PARTITION BY entry_id, lower(regexp_replace(heading_text, '\\s+', '', 'g'))) AS times FROM levelled WHERE level IS NOT NULL)"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    shaped = m.lines(spark, sf_dir).select("entry_id", "line_no", F.expr(MARKED).alias("x"))
    grouped = shaped.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "x"))).alias("all"))
    return grouped.select("entry_id", F.array_join(F.transform("all", lambda r: r["x"]), "\n").alias("text"))


@query(f"WITH {MARKED_SQL} SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY start) AS heading_no, start, level, heading_text FROM counted WHERE times < 3")
def headings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked and unmarked headings with their levels, running headers left out."""
    return a.headings(_marked(spark, sf_dir))


@query(f"WITH {MARKED_SQL} SELECT entry_id, count(*) AS kept, (count(*) FILTER (level > 2))::BIGINT AS deep FROM counted WHERE times < greatest(3, floor(10 * 0.6)) GROUP BY entry_id")
def running_header_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold follows the number of pages: here ten for each text."""
    found = a.headings(_marked(spark, sf_dir).withColumn("pages", F.lit(10)), pages="pages")
    return found.groupBy("entry_id").agg(F.count("*").alias("kept"), F.count_if(F.col("level") > 2).alias("deep"))


SUBS_SQL = """
gaps AS (SELECT entry_id, start, level, heading_text, coalesce(lead(start) OVER (PARTITION BY entry_id ORDER BY start, pre DESC), total) AS stop, count(*) OVER (PARTITION BY entry_id) AS n, pre FROM (
  SELECT h.entry_id, start, level, heading_text, total_chars AS total, 0 AS pre FROM headings h JOIN entries USING (entry_id) UNION ALL SELECT entry_id, 0, NULL, '卷首', total_chars, 1 FROM entries)),
stepped AS (SELECT *, unnest(range(1, 1 + greatest(0, ceil((stop - start) / 500.0)::BIGINT - CASE WHEN n = 1 AND pre = 1 THEN 2 ELSE 1 END))) AS i FROM gaps),
subs AS (SELECT entry_id, (start + i * 500)::BIGINT AS start, level, heading_text || '·续' || i AS title FROM stepped)"""
#: Headings, sub-sections (negative numbers) and fronts (0), each up to the next of them.
ANCHORS_SQL = f"""{SUBS_SQL},
anchors AS (SELECT entry_id, heading_no AS no, start, level, heading_text AS title FROM headings UNION ALL SELECT entry_id, -row_number() OVER (PARTITION BY entry_id ORDER BY start), start, level, title FROM subs UNION ALL SELECT entry_id, 0, 0, NULL, NULL FROM entries),
anchored AS (SELECT s.entry_id, no, start, coalesce(lead(start) OVER (PARTITION BY s.entry_id ORDER BY start, CASE WHEN no = 0 THEN 0 WHEN no > 0 THEN 1 ELSE 2 END, no), total_chars) AS stop, level, s.title FROM anchors s JOIN entries USING (entry_id))"""


@query(f"WITH {m.ENTRIES_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL}, {SUBS_SQL} SELECT * FROM subs")
def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors every 500 characters inside longer gaps."""
    return a.subsections(m.headings(spark, sf_dir), m.entries(spark, sf_dir), step=500)


@query(f"WITH {m.ENTRIES_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL}, {ANCHORS_SQL} SELECT entry_id, no AS section_no, start, stop, level, title FROM anchored")
def anchored_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a section reference can name: headings, sub-sections and fronts with their ends."""
    e = m.entries(spark, sf_dir)
    return read.anchored(m.headings(spark, sf_dir, e), e, step=500)


@query(f"""WITH {m.ENTRIES_SQL}, {m.LINES_SQL},
pages AS (SELECT entry_id, line_no // 4 + 1 AS page, min(start) AS start FROM lines GROUP BY ALL),
fixed AS (SELECT p.entry_id, p.start, 1::BIGINT AS level, line AS heading_text, 0 AS src FROM pages p JOIN lines l ON l.entry_id = p.entry_id AND l.start = p.start),
parsed AS (SELECT entry_id, start, 2::BIGINT AS level, line AS heading_text, 1 AS src FROM lines),
rest AS (SELECT * FROM parsed a WHERE NOT EXISTS (SELECT 1 FROM fixed f WHERE f.entry_id = a.entry_id AND abs(f.start - a.start) < 500 AND lower(regexp_replace(f.heading_text, '\\s+', '', 'g')) = lower(regexp_replace(a.heading_text, '\\s+', '', 'g'))))
SELECT entry_id, start, level, heading_text FROM (SELECT * FROM fixed UNION ALL SELECT * FROM rest) QUALIFY row_number() OVER (PARTITION BY entry_id, start ORDER BY src, level, heading_text) = 1""")
def outline_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline anchors at page starts (a page is four lines) before like parsed headings nearby."""
    lines = m.lines(spark, sf_dir)
    pages = lines.groupBy("entry_id", (F.floor(F.col("line_no") / 4) + 1).alias("page")).agg(F.min("start").alias("start"))
    first = lines.where("line_no % 4 = 0")
    outline = first.select("entry_id", F.lit(1).cast("bigint").alias("level"), F.col("line").alias("heading_text"), (F.floor(F.col("line_no") / 4) + 1).alias("page"))
    parsed = lines.select("entry_id", "start", F.lit(2).cast("bigint").alias("level"), F.col("line").alias("heading_text"))
    return a.merge_outline(parsed, outline, pages)


@query("""SELECT page_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(
  regexp_replace(html, '(?is)<h1\\b[^>]*>\\s*(.*?)\\s*</h1\\s*>', chr(10) || chr(10) || '# \\1' || chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[^\\S\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x, ' ' || chr(13))), lambda x: x <> ''), chr(10)) AS body FROM pages""")
def html_structured_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "pages").select("page_id", t.html_to_text(F.col("html")).alias("body"))


def _srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as SRT texts."""
    stamp = lambda ms: F.concat(t.clock(ms), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))
    block = F.concat_ws("\n", F.col("turn").cast("string"), F.concat(stamp(F.col("start_ms")), F.lit(" --> "), stamp(F.col("end_ms"))), "text")
    rows = m.segments(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("all"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda r: r["block"]), "\n\n").alias("srt"))


@query("""SELECT conv_id, turn * 10000 AS start_ms, (turn + 1) * 10000 AS end_ms, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM conversations WHERE trim(text) <> ''""")
def srt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as SRT and parsed back."""
    return _srt(spark, sf_dir).select("conv_id", F.inline(subtitles.parse_srt(F.col("srt"))))


@query("""SELECT conv_id, turn * 10000 AS start_ms, (turn + 1) * 10000 AS end_ms, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM conversations WHERE trim(text) <> ''""")
def vtt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as WebVTT: a header block, dots in the times, cue settings and tags."""
    body = F.regexp_replace(F.regexp_replace("srt", r"(\d\d:\d\d:\d\d),(\d{3}) --> (\d\d:\d\d:\d\d),(\d{3})", "$1.$2 --> $3.$4 align:start\n<v A>"), r"<v A>\n", "<v A>")
    return _srt(spark, sf_dir).select("conv_id", F.inline(subtitles.parse_vtt(F.concat(F.lit("WEBVTT\n\n"), body))))


@query(f"WITH {m.SEGMENTS_SQL.strip()} SELECT conv_id, count(*) AS segments, max(char_start + length(text))::BIGINT AS chars, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM spans GROUP BY conv_id")
def segments_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m.segments(spark, sf_dir)
    spans = a.segment_spans(rows, "conv_id", ["turn", "text"]).groupBy("conv_id").agg(F.count("*").alias("segments"), F.max("char_end").alias("chars"))
    return spans.join(a.joined_text(rows, "conv_id", ["turn"]).select("conv_id", F.md5("full_text").alias("digest")), "conv_id")


@query(f"""WITH {m.SEGMENTS_SQL.strip()},
pieces AS (SELECT conv_id, unnest(range((total + 299) // 300))::BIGINT AS chunk_no, total FROM (SELECT conv_id, max(char_start + length(text)) AS total FROM spans GROUP BY conv_id))
SELECT p.conv_id, chunk_no, arg_min(start_ms, char_start) AS start_ms, arg_max(end_ms, char_start) AS end_ms FROM pieces p LEFT JOIN spans s ON s.conv_id = p.conv_id AND char_start + length(text) > chunk_no * 300 AND char_start < least(total, chunk_no * 300 + 300) GROUP BY ALL""")
def time_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time ranges of 300-character chunks of the joined conversations."""
    spans = a.segment_spans(m.segments(spark, sf_dir), "conv_id", ["turn", "text"])
    total = spans.groupBy("conv_id").agg(F.max("char_end").alias("total"))
    rows = total.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("total") / 300) - 1)).alias("chunk_no"))
    chunks = rows.select("conv_id", "chunk_no", (F.col("chunk_no") * 300).alias("start"), F.least("total", F.col("chunk_no") * 300 + 300).alias("stop"))
    return a.chunk_times(chunks, spans, "conv_id")


PROBES_SQL = "probes AS (SELECT entry_id, unnest(range(0, total_chars, 400))::BIGINT AS place FROM entries)"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.col("total_chars") - 1), F.lit(400).cast("bigint"))
    return m.entries(spark, sf_dir).select("entry_id", F.explode(step).alias("place"))


@query(f"WITH {m.ENTRIES_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL}, {PROBES_SQL} SELECT p.entry_id, place, heading_no FROM probes p ASOF LEFT JOIN headings h ON h.entry_id = p.entry_id AND p.place >= h.start")
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.asof_backward(_probes(spark, sf_dir), m.headings(spark, sf_dir), ["entry_id"], "place", ["heading_no"])


@query(f"""WITH {m.ENTRIES_SQL}, {m.LINES_SQL}, {PROBES_SQL}, pages AS (SELECT entry_id, line_no // 10 + 1 AS page, min(start) AS start FROM lines GROUP BY ALL)
SELECT p.entry_id, place, 'pdf' AS kind, page::BIGINT AS n FROM probes p ASOF LEFT JOIN pages h ON h.entry_id = p.entry_id AND p.place >= h.start""")
def asof_source_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten lines as a ledger; each probe's page."""
    pages = m.lines(spark, sf_dir).groupBy("entry_id", (F.floor(F.col("line_no") / 10) + 1).alias("page")).agg(F.min("start").alias("start"))
    found = a.asof_backward(_probes(spark, sf_dir), a.ledger(pages=pages), ["entry_id"], "place", ["kind", "v1", "v2", "title"])
    where = a.source_location(F.col("kind"), F.col("v1"), F.col("v2"), F.col("title"), F.lit(None).cast("bigint"))
    return found.select("entry_id", "place", where["kind"].alias("kind"), where["n"].alias("n"))


@query(f"WITH {m.ENTRIES_SQL}, {PROBES_SQL} SELECT entry_id, place, (length(text[1:place]) - length(replace(text[1:place], chr(10), '')) + 1)::BIGINT AS line FROM probes JOIN entries USING (entry_id)")
def line_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probes(spark, sf_dir).join(m.entries(spark, sf_dir).select("entry_id", "text"), "entry_id")
    return rows.select("entry_id", "place", t.line_number(F.col("text"), F.col("place").cast("int")).cast("bigint").alias("line"))


CAP = 700


def cap_sql(text: str, most: int) -> str:
    """A text cut at the last line end before ``most``, unless that is in the first half."""
    head = f"({text})[1:{most}]"
    at = f"(length({head}) - instr(reverse({head}), chr(10)))"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN contains({head}, chr(10)) AND {at} >= {most // 2} THEN ({text})[1:{at}] ELSE {head} END"


@query(f"WITH {m.ENTRIES_SQL} SELECT entry_id, length(c)::BIGINT AS read_chars, md5(c) AS digest FROM (SELECT entry_id, {cap_sql('text', CAP)} AS c FROM entries)")
def cap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = t.capped(F.col("text"), CAP)
    return m.entries(spark, sf_dir).select("entry_id", F.length(cut).cast("bigint").alias("read_chars"), F.md5(cut).alias("digest"))


SECTIONS_SQL = f"""{m.ENTRIES_SQL}, {m.LINES_SQL}, {m.HEADINGS_SQL},
bounds AS (SELECT entry_id, heading_no AS section_no, start FROM headings UNION ALL SELECT entry_id, 0, 0 FROM entries),
sections AS (SELECT b.entry_id, section_no, start, coalesce(lead(start) OVER (PARTITION BY b.entry_id ORDER BY start, section_no), total_chars) AS stop FROM bounds b JOIN entries USING (entry_id))"""
WINDOW_SQL = f"""spans AS (SELECT *, CASE WHEN stop - start > {CAP} THEN greatest(start, least(place - {CAP // 2}, stop - {CAP})) ELSE start END AS a, CASE WHEN stop - start > {CAP} THEN least(stop, greatest(start, least(place - {CAP // 2}, stop - {CAP})) + {CAP}) ELSE stop END AS b FROM wanted),
bodies AS (SELECT s.*, text[a + 1:b] AS body FROM spans s JOIN entries USING (entry_id)),
contents AS (SELECT *, {cap_sql('body', CAP)} AS content FROM bodies)"""
READ_SQL = "length(content)::BIGINT AS read_chars, md5(content) AS digest, greatest(0, stop - start - length(content))::BIGINT AS remaining_chars, stop - start > length(content) AS truncated"


def _read(spans: DataFrame, entries: DataFrame) -> DataFrame:
    found = read.read_spans(spans, entries, CAP)
    return found.select("entry_id", *[c for c in ("section_no",) if c in found.columns], "read_chars", F.md5("content").alias("digest"), "remaining_chars", "truncated")


@query(f"WITH {SECTIONS_SQL}, wanted AS (SELECT *, start + (stop - start) // 2 AS place FROM sections WHERE section_no > 0), {WINDOW_SQL} SELECT entry_id, section_no, {READ_SQL} FROM contents")
def read_section_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section read around its middle by its reference."""
    e = m.entries(spark, sf_dir)
    spans = read.sections(m.headings(spark, sf_dir), e).where("section_no > 0")
    refs = spans.withColumn("ref", read.parse_ref(read.section_ref(F.col("entry_id"), F.col("section_no"), F.col("start") + F.floor((F.col("stop") - F.col("start")) / 2))))
    return _read(refs.select("entry_id", F.col("ref.number").alias("section_no"), "start", "stop", F.col("ref.at").alias("at")), e)


@query(f"WITH {SECTIONS_SQL}, wanted AS (SELECT *, (stop * 3) // 4 AS place FROM sections WHERE section_no = 0), {WINDOW_SQL} SELECT entry_id, {READ_SQL} FROM contents")
def read_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text before the first anchor, around three quarters of it."""
    e = m.entries(spark, sf_dir)
    spans = read.sections(m.headings(spark, sf_dir), e).where("section_no = 0").drop("section_no")
    return _read(spans.withColumn("at", F.floor(F.col("stop") * 3 / 4)), e)


@query("""SELECT page_id, CASE WHEN contains(lower(url), 'youtube.com') OR contains(lower(url), 'youtu.be') THEN 'youtube' WHEN contains(lower(url), 'bilibili.com') OR contains(lower(url), 'b23.tv') THEN 'bilibili' WHEN regexp_matches(url, '^https?://') THEN 'web' ELSE 'unknown' END AS kind FROM pages""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "pages").select("page_id", t.content_type(F.col("url")).alias("kind"))


@query("""WITH s AS (SELECT event_id, (event_id * 7919) % 86400000 AS ms FROM events)
SELECT event_id, ms, lpad((round_even(ms / 1000.0, 0)::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((round_even(ms / 1000.0, 0)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((round_even(ms / 1000.0, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS hms FROM s""")
def ts_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written and parsed back to milliseconds."""
    ms = (F.col("event_id") * 7919) % 86_400_000
    whole = F.floor(ms / 1000)
    stamp = F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60, ms % 1000)
    return m.table(spark, sf_dir, "events").select("event_id", t.timestamp_ms(stamp).alias("ms"), t.clock(ms).alias("hms"))


@query("""WITH s AS (SELECT event_id, (event_id * 37) % 40000 AS sec FROM events) SELECT event_id, sec AS clock_at, sec AS number_at, CASE WHEN sec >= 3600 THEN (sec // 3600) || ':' || lpad((sec % 3600 // 60)::VARCHAR, 2, '0') ELSE (sec // 60)::VARCHAR END || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS label FROM s""")
def play_at_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = (F.col("event_id") * 37) % 40_000
    label = t.play_label(sec)
    return m.table(spark, sf_dir, "events").select("event_id", t.play_at(label).alias("clock_at"), t.play_at(sec.cast("string")).alias("number_at"), label.alias("label"))


@query("""WITH u AS (SELECT doc_id, left(sha256(text), 16) AS k, doc_id % 6 AS c FROM documents)
SELECT doc_id, CASE WHEN c = 0 THEN 'goto' WHEN c = 1 THEN 'play' END AS action, CASE WHEN c < 2 THEN 'lib_' || doc_id END AS workspace, CASE WHEN c < 2 THEN k END AS entry, CASE WHEN c = 1 THEN doc_id % 86400 END AS play_at FROM u""")
def uri_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep links of six shapes, two of them valid."""
    k = t.entry_id(F.col("text"))
    base = F.concat(F.lit("?ws=lib_"), "doc_id", F.lit("&entry="), k)
    at = F.concat(F.lit("&at="), F.col("doc_id") % 86_400)
    case = F.col("doc_id") % 6
    uri = (
        F.when(case == 0, F.concat(F.lit("tessera://goto"), base)).when(case == 1, F.concat(F.lit("tessera://play"), base, at)).when(case == 2, F.concat(F.lit("tessera://play"), base))
        .when(case == 3, F.concat(F.lit("tessera://goto"), base, F.lit("&x=1"))).when(case == 4, F.concat(F.lit("tessera://goto"), base, F.lit("&at=86401"))).otherwise(F.concat(F.lit("other://goto"), base))
    )
    link = t.link_fields(uri, "tessera")
    return m.table(spark, sf_dir, "documents").select("doc_id", link["action"].alias("action"), link["workspace"].alias("workspace"), link["entry"].alias("entry"), link["at"].alias("play_at"))


@query("""SELECT conv_id, turn, 'tessera://goto?ws=talks%20' || conv_id || '&entry=' || left(sha256(text), 16) || CASE WHEN turn % 2 = 0 THEN '&at=' || (turn * 10) ELSE '' END AS link,
CASE WHEN turn % 2 = 0 THEN (CASE WHEN turn * 10 >= 3600 THEN (turn * 10 // 3600) || ':' || lpad((turn * 10 % 3600 // 60)::VARCHAR, 2, '0') ELSE (turn * 10 // 60)::VARCHAR END) || ':' || lpad((turn * 10 % 60)::VARCHAR, 2, '0') ELSE 'page ' || turn END AS label FROM conversations WHERE text IS NOT NULL""")
def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to turns: by time for even ones, by page for odd ones."""
    timed = F.when(F.col("turn") % 2 == 0, F.col("start_ms"))
    where = t.locator("tessera", F.concat(F.lit("talks "), "conv_id"), t.entry_id(F.col("text")), timed, F.lit("page"), F.col("turn"))
    return m.segments(spark, sf_dir).select("conv_id", "turn", where["link"].alias("link"), where["label"].alias("label"))
