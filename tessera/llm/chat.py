"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A fingerprint is the SHA-256 of the sorted nested field paths of a record layout
(``messages[].role`` and so on). ``schema_fingerprint`` takes it from a DataFrame
schema, ``record_fingerprint`` from each JSON record by SQL functions alone, so a
table of mixed records is routed row by row. A mapping says in SQL expressions how
a layout becomes turns; a new layout is one more entry of ``MAPPINGS``.

The template writes ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn. Control
strings inside roles and texts (of this template and of other usual ones) get a
backslash after their first character, and backslashes are doubled, which
``unescape`` reverses exactly. The loss mask comes as spans of the formatted text,
those of the assistant texts; ``loss_text`` reads the text through them.

Everything here is DataFrame and SQL functions. Turns of a conversation are first
grouped in runs of ``RUN_TURNS`` turn numbers and formatted there, then the runs
are joined, so a very long conversation is spread over tasks until its one output
row is put together.

Defined results for odd input: null texts and roles count as empty; a null
conv_id or turn is a value like any other (null turns come first); repeated rows
are kept and follow each other, ties on turn go by role, then text; an empty table
gives an empty result; extra columns of any name are ignored. JSON records may have
further fields; those of an unknown layout, and what is no JSON object, give no turns
and come out of ``unmapped_json`` instead.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of usual chat templates.
CONTROL = ("<|", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>")
RUN_TURNS = 64
LOSS_ROLE = "assistant"
TURNS = "array<struct<turn: bigint, role: string, text: string>>"


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a type: structs by name, ``[]`` for array elements."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_fingerprint(schema: T.StructType, ignore: tuple[str, ...] = ()) -> str:
    """The fingerprint of a schema, without the top-level columns in ``ignore``."""
    return fingerprint_of([p for f in schema.fields if f.name not in ignore for p in field_paths(f.dataType, f.name)])


def _pair(first: str, second: str, roles: tuple[str, str] = ("user", "assistant")) -> str:
    return f"array(named_struct('turn', 0L, 'role', '{roles[0]}', 'text', {first}), named_struct('turn', 1L, 'role', '{roles[1]}', 'text', {second}))"


def _list(array: str, role: str, text: str) -> str:
    return f"transform({array}, (m, i) -> named_struct('turn', cast(i as bigint), 'role', {role}, 'text', {text}))"


#: The text of a message: a string as it is, of a list of parts their texts put together.
_PARTS = "coalesce(array_join(transform(try_variant_get(m.content, '$', 'array<struct<text: string>>'), p -> p.text), ''), try_variant_get(m.content, '$', 'string'))"
_FROM = "CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END"
_JOINED = "concat_ws('\\n\\n', instruction, nullif(input, ''))"
#: Layout name: (field paths, schema of a record, expression for its turns). The first holds one turn a row.
MAPPINGS: dict[str, tuple[list[str], str, str]] = {
    "rows": (["role", "text", "turn"], "turn bigint, role string, text string", "array(named_struct('turn', turn, 'role', role, 'text', text))"),
    "messages": (["messages[].role", "messages[].content"], "messages array<struct<role: string, content: string>>", _list("messages", "m.role", "m.content")),
    "messages_parts": (["messages[].role", "messages[].content[].text"], "messages array<struct<role: string, content: variant>>", _list("messages", "m.role", _PARTS)),
    "conversation": (["conversations[].role", "conversations[].content"], "conversations array<struct<role: string, content: string>>", _list("conversations", "m.role", "m.content")),
    "share": (["conversations[].from", "conversations[].value"], "conversations array<struct<from: string, value: string>>", _list("conversations", _FROM, "m.value")),
    "prompt": (["prompt", "response"], "prompt string, response string", _pair("prompt", "response")),
    "completion": (["prompt", "completion"], "prompt string, completion string", _pair("prompt", "completion")),
    "instruction": (["instruction", "output"], "instruction string, output string", _pair("instruction", "output")),
    "instruction_input": (["input", "instruction", "output"], "instruction string, input string, output string", _pair(_JOINED, "output")),
    "question": (["answer", "question"], "question string, answer string", _pair("question", "answer")),
}
#: Layouts whose content may be a string in one record or turn and a list of parts in another, as they are read from JSON.
MIXED = {"messages": MAPPINGS["messages_parts"][1:], "conversation": ("conversations array<struct<role: string, content: variant>>", _list("conversations", "m.role", _PARTS))}
BY_FINGERPRINT = {fingerprint_of(paths): name for name, (paths, _, _) in MAPPINGS.items()}


def canonical_turns(records: DataFrame, key: str) -> DataFrame:
    """(key, turn, role, text) from a table whose schema fingerprint names its mapping."""
    needed = {f: name for f, name in BY_FINGERPRINT.items()}
    own = [c for c in records.columns if c != key]
    name = needed.get(schema_fingerprint(records.select(own).schema))
    if name is None:  # extra columns: the mapping with the most top-level fields among those present
        tops = {n: {p.split(".")[0].split("[")[0] for p in paths} for n, (paths, _, _) in MAPPINGS.items()}
        fit = [n for n, top in tops.items() if top <= {*own} and schema_fingerprint(records.select(sorted(top)).schema) in BY_FINGERPRINT]
        if not fit:
            raise ValueError(f"no mapping for the layout {sorted(own)}")
        name = max(fit, key=lambda n: len(tops[n]))
    _, schema, expression = MAPPINGS[name]
    if name == "rows":
        return records.select(key, F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return records.select(key, F.inline(F.expr(expression).cast(TURNS)))


def record_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON object, at any depth; null if it isn't one.

    They are read off the schema of the parsed value: a walk over its tokens keeps the
    paths of the open objects and arrays on a stack.
    """
    schema = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(schema, F.lit(r"(`(?:[^`]|``)*`|[^\s<>,:`]+)(?=: )|OBJECT<|ARRAY<|>|[A-Z][A-Z_]*(?:\(\d+,\s*\d+\))?"), F.lit(0))
    strings = lambda *c: F.array(*c).cast("array<string>")
    start = F.struct(strings().alias("stack"), F.lit("").alias("now"), strings().alias("paths"), F.lit(True).alias("type"))

    def step(s: Column, token: Column) -> Column:
        top = F.coalesce(F.get(s["stack"], F.lit(0)), F.lit(""))
        named = F.concat(top, F.when(top == "", "").otherwise("."), F.regexp_replace(token, "^`|`$", ""))
        closes, opens = token == ">", token.isin("OBJECT<", "ARRAY<")
        # after OBJECT< or a finished field a name follows, after a name or ARRAY< a type
        now = F.when(token == "ARRAY<", F.concat(s["now"], F.lit("[]"))).when(~closes & ~opens & ~s["type"], named).otherwise(s["now"])
        stack = F.when(opens, F.concat(strings(now), s["stack"])).when(closes, F.slice(s["stack"], 2, F.greatest(F.lit(1), F.size(s["stack"])))).otherwise(s["stack"])
        leaf = ~closes & ~opens & s["type"]
        paths = F.when(leaf & (now != ""), F.concat(s["paths"], strings(now))).otherwise(s["paths"])
        follows = (token == "ARRAY<") | (~closes & ~opens & ~s["type"])
        return F.struct(stack.alias("stack"), now.alias("now"), paths.alias("paths"), follows.alias("type"))

    found = F.aggregate(tokens, start, step, lambda s: F.array_sort(F.array_distinct(s["paths"])))
    return F.when(schema.startswith("OBJECT<"), found)


def record_fingerprint(record: Column) -> Column:
    return F.sha2(F.array_join(record_paths(record), "\n"), 256)


def route_json(records: DataFrame, key: str, column: str = "record") -> DataFrame:
    """(key, record, fingerprint, paths, layout) of JSON records; layout is null where no mapping fits.

    A fingerprint that is known names its mapping; a record with further fields takes
    the mapping with the most fields among those it holds in full.
    """
    marked = records.select(key, F.col(column).alias("record"), record_paths(F.col(column)).alias("paths"))
    marked = marked.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    exact = F.create_map(*[F.lit(x) for pair in BY_FINGERPRINT.items() for x in pair])
    fitting = [F.when(F.size(F.array_except(F.array(*map(F.lit, paths)), "paths")) == 0, name) for name, (paths, _, _) in sorted(MAPPINGS.items(), key=lambda m: -len(m[1][0]))]
    return marked.withColumn("layout", F.coalesce(F.try_element_at(exact, "fingerprint"), *fitting))


def canonical_json(records: DataFrame, key: str, column: str = "record") -> DataFrame:
    """(key, turn, role, text) of mixed JSON records, each by the mapping of its own layout.

    ``unmapped_json`` gives the records that no mapping fits.
    """
    routed = route_json(records, key, column)
    found = None
    for name, (_, *mapping) in MAPPINGS.items():
        schema, expression = MIXED.get(name, mapping)
        one = routed.where(F.col("layout") == name).select(F.col(key).alias("_key"), F.from_json("record", schema).alias("r")).select("_key", "r.*")
        part = one.select(F.col("_key").alias(key), F.inline(F.expr(expression).cast(TURNS)))
        found = part if found is None else found.unionByName(part)
    return found


def unmapped_json(records: DataFrame, key: str, column: str = "record") -> DataFrame:
    """(key, fingerprint, paths, record) of the records that no mapping fits; paths are null if it is no JSON object."""
    return route_json(records, key, column).where("layout is null").select(key, "fingerprint", "paths", "record")


def unmapped_layouts(records: DataFrame, key: str, column: str = "record") -> DataFrame:
    """(fingerprint, paths, records): how many records each unknown layout has."""
    return unmapped_json(records, key, column).groupBy("fingerprint", "paths").agg(F.count("*").alias("records"))


def escape(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    """``text`` without any control string, so that ``unescape`` gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in control:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: key, formatted and loss.

    ``loss`` has the length of each run of turns in the formatted text, and the spans
    (start and length in the run, code points) of the assistant texts in it.
    """
    run = F.floor(F.col("turn") / RUN_TURNS)
    rows = turns.select(
        F.col(key).alias("k"), run.alias("run"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    runs = rows.groupBy("k", "run").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def shaped(t: Column) -> Column:
        head, body = F.concat(F.lit(START), escape(t["role"]), F.lit(SEP)), escape(t["text"])
        return F.struct(F.concat(head, body, F.lit(END)).alias("out"), F.length(head).alias("before"), F.length(body).alias("size"), (t["role"] == LOSS_ROLE).alias("loss"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def span(s: Column, t: Column) -> Column:
        own = F.array(F.struct((s["at"] + t["before"]).alias("start"), t["size"].alias("length")))
        return F.struct((s["at"] + F.length(t["out"])).alias("at"), F.when(t["loss"], F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    made = runs.select("k", "run", F.transform("turns", shaped).alias("made"))
    parts = made.select("k", "run", F.array_join(F.transform("made", lambda t: t["out"]), "").alias("out"), F.aggregate("made", zero, span)["spans"].alias("spans"))
    whole = parts.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("run", "out", "spans"))).alias("runs"))
    sizes = F.transform("runs", lambda r: F.struct(F.length(r["out"]).alias("length"), r["spans"].alias("spans")))
    return whole.select(F.col("k").alias(key), F.array_join(F.transform("runs", lambda r: r["out"]), "").alias("formatted"), sizes.alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    ended = F.split(formatted, r"<\|im_end\|>")
    bodies = F.slice(ended, 1, F.size(ended) - 1)

    def turn(body: Column) -> Column:
        parts = F.split(F.substr(body, F.lit(len(START) + 1)), r"<\|im_sep\|>")
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    return F.transform(bodies, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, cut out of the formatted text, unescaped, nothing between.

    Every run is cut out once and its spans out of it, so the cost doesn't grow with the
    square of a conversation.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<part: string, spans: array<struct<start: int, length: int>>>>").alias("parts"))
    cut = lambda text, start, size: F.substr(text, start + 1, size)

    def run(s: Column, r: Column) -> Column:
        part = F.struct(cut(formatted, s["at"], r["length"]).alias("part"), r["spans"].alias("spans"))
        return F.struct((s["at"] + r["length"]).alias("at"), F.concat(s["parts"], F.array(part)).alias("parts"))

    parts = F.aggregate(loss.cast("array<struct<length: int, spans: array<struct<start: int, length: int>>>>"), zero, run)["parts"]
    return F.array_join(F.transform(parts, lambda p: F.array_join(F.transform(p["spans"], lambda x: unescape(cut(p["part"], x["start"], x["length"]))), "")), "")
