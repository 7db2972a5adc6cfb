"""Chat formatting by schema fingerprints, in DataFrame and SQL functions alone.

A record is a variant (``parse_json``, or ``to_variant_object`` of columns) of
unknown layout. Its nested field paths, as far as any known layout has them, are
sorted and hashed; the hash selects a declarative mapping, which turns the
record into canonical turns (role, text). Turns are formatted by a template whose
control strings are escaped in roles and texts, and can be read back exactly.

    <|turn|>role
    text<|end|>

Escapes: ``\\`` becomes ``\\\\``, ``<|`` becomes ``<\\|``, and in a role a line end
becomes ``\\n``; so ``<|`` only ever begins a control string.

Defined results: a null role or text is empty; a record of unknown layout has
null turns (and a fingerprint to add a layout by), it is not dropped; a key whose
value is null counts as present; no turns give an empty string.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END, LOSS_ROLE = "<|turn|>", "<|end|>", "assistant"
#: Levels of objects and lists that a path follows; what lies deeper counts as a value.
DEPTH = 5


@dataclass(frozen=True)
class Layout:
    """A known record layout.

    ``turns`` is SQL for an array of (role, text) over the variant ``record``;
    ``paths`` must be there, ``optional`` ones may be.
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = field(default=())

    def fingerprints(self) -> list[str]:
        return [fingerprint_of([*self.paths, *more]) for k in range(len(self.optional) + 1)
                for more in combinations(self.optional, k)]


def fingerprint_of(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _text(path: str, of: str = "record") -> str:
    return f"try_variant_get({of}, '{path}', 'string')"


def _list(path: str, role: str, text: str) -> str:
    return (f"transform(try_variant_get(record, '{path}', 'array<variant>'), m -> "
            f"named_struct('role', {role}, 'text', {text}))")


def _single(*turns: tuple[str, str]) -> str:
    """Turns of fixed roles; an optional one that the record doesn't have is left out."""
    made = ", ".join(f"if(try_variant_get(record, '{path}', 'variant') is null, null, "
                     f"named_struct('role', '{role}', 'text', {_text(path)}))" for role, path in turns)
    return f"filter(array({made}), t -> t is not null)"


_FROM = ("CASE try_variant_get(m, '$.from', 'string') WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' "
         "ELSE try_variant_get(m, '$.from', 'string') END")

LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", ("$.messages[].role", "$.messages[].content"),
           _list("$.messages", _text("$.role", "m"), _text("$.content", "m"))),
    Layout("from_value", ("$.conversations[].from", "$.conversations[].value"),
           _list("$.conversations", _FROM, _text("$.value", "m"))),
    Layout("authored_parts", ("$.thread[].author.role", "$.thread[].content.parts[]"),
           _list("$.thread", _text("$.author.role", "m"),
                 "array_join(try_variant_get(m, '$.content.parts', 'array<string>'), '', '')")),
    Layout("prompt_completion", ("$.prompt", "$.completion"),
           _single(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("instruction", ("$.instruction", "$.output"),
           _single(("system", "$.system"), ("user", "$.instruction"), ("assistant", "$.output")), ("$.system",)),
    Layout("rows", ("$.rows[].turn", "$.rows[].role", "$.rows[].text"),
           "transform(array_sort(transform(try_variant_get(record, '$.rows', 'array<variant>'), m -> named_struct("
           "'turn', try_variant_get(m, '$.turn', 'bigint'), 'role', try_variant_get(m, '$.role', 'string'), "
           "'text', try_variant_get(m, '$.text', 'string')))), m -> named_struct('role', m.role, 'text', m.text))"),
)


def _paths(value: str, prefix: str, depth: int) -> str:
    """SQL for the array of field paths below ``value``."""
    if depth == 0:
        return f"array({prefix})"
    e, x = f"e{depth}", f"x{depth}"
    return (f"CASE WHEN startswith(schema_of_variant({value}), 'OBJECT') THEN flatten(transform(map_entries("
            f"cast({value} as map<string, variant>)), {e} -> "
            f"{_paths(f'{e}.value', f'concat({prefix}, {chr(39)}.{chr(39)}, {e}.key)', depth - 1)})) "
            f"WHEN startswith(schema_of_variant({value}), 'ARRAY') THEN array_distinct(flatten(transform("
            f"cast({value} as array<variant>), {x} -> {_paths(x, f'concat({prefix}, {chr(39)}[]{chr(39)})', depth - 1)}))) "
            f"ELSE array({prefix}) END")


def fingerprint(record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """SHA-256 of the record's field paths that any layout knows."""
    known = sorted({p for x in layouts for p in (*x.paths, *x.optional)})
    names = ", ".join(f"'{p}'" for p in known)
    found = f"array_intersect({_paths(record, chr(39) + '$' + chr(39), DEPTH)}, array({names}))"
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.expr(found))), "\n"), 256)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``records`` (with a variant column ``record``) plus fingerprint, layout and turns."""
    by_print = F.lit(None).cast("string")
    turns = None
    for x in layouts:
        here = F.col("fingerprint").isin(x.fingerprints())
        by_print = F.when(here, F.lit(x.name)).otherwise(by_print)
        mapped = F.expr(f"transform({x.turns}, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))")
        turns = F.when(here, mapped) if turns is None else turns.when(here, mapped)
    return (records.withColumn("fingerprint", fingerprint("record", layouts))
            .withColumn("layout", by_print).withColumn("turns", turns))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape(text: Column, role: bool = False) -> Column:
    """Between doubled backslashes, a single one belongs to the character after it."""
    def plain(part: Column) -> Column:
        part = F.replace(part, F.lit("\\|"), F.lit("|"))
        return F.replace(part, F.lit("\\n"), F.lit("\n")) if role else part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), plain), "\\")


#: Elements of a list whose running sums are made from one another; lists of them get theirs from their totals.
_CHUNK = 128


def running_starts(sizes: str) -> Column:
    """The sum of all elements before each one, of a list column of longs: chunk by chunk, so a long list costs its length
    and not its square."""
    none = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(none, F.greatest(F.ceil(F.size(sizes) / _CHUNK) - 1, none)),
                         lambda c: F.slice(sizes, (c * _CHUNK + 1).cast("int"), _CHUNK))
    totals = F.transform(chunks, lambda chunk: F.aggregate(chunk, none, lambda a, x: a + x))
    bases = F.aggregate(totals, F.array(none), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))
    inner = F.transform(chunks, lambda chunk: F.slice(F.aggregate(
        chunk, F.array(none), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(chunk)))
    return F.flatten(F.zip_with(inner, F.slice(bases, 1, F.size(chunks)), lambda own, base: F.transform(own, lambda x: x + base)))


def formatted(records: DataFrame) -> DataFrame:
    """``records`` (with ``turns``) plus ``formatted`` and ``mask``: for every turn where its text lies in it
    (start and length in code points) and whether it is under the loss."""
    parts = F.transform("turns", lambda t: F.struct(_escape_role(t["role"]).alias("role"), _escape(t["text"]).alias("text"),
                                                    (t["role"] == LOSS_ROLE).alias("loss")))
    head, tail = len(START) + 1, len(END) + 1
    sizes = F.transform("_parts", lambda p: (F.length(p["role"]) + F.length(p["text"]) + (head + tail)).cast("long"))
    text = F.array_join(F.transform("_parts", lambda p: F.concat(F.lit(START), p["role"], F.lit("\n"), p["text"],
                                                                 F.lit(END + "\n"))), "")
    mask = F.zip_with("_parts", "_starts", lambda p, start: F.struct(
        (start + head + F.length(p["role"])).alias("start"), F.length(p["text"]).cast("long").alias("length"),
        p["loss"].alias("loss")))
    return (records.withColumn("_parts", parts).withColumn("_sizes", sizes).withColumn("_starts", running_starts("_sizes"))
            .withColumn("formatted", text).withColumn("mask", mask).drop("_parts", "_sizes", "_starts"))


def read_back(records: DataFrame) -> DataFrame:
    """``records`` (with ``formatted`` and ``mask``) plus ``read``, the turns parsed from the formatted text, with where
    each text lies in it, and ``loss_texts``, the unescaped texts at the places that the mask puts under the loss."""
    pieces = F.split("formatted", "<\\|end\\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    cut = F.transform("_pieces", lambda p: F.struct(F.instr(p, F.lit("\n")).alias("at"), p.alias("piece")))
    sizes = F.transform("_pieces", lambda p: (F.length(p) + (len(END) + 1)).cast("long"))
    read = F.zip_with("_cut", "_starts", lambda c, start: F.struct(
        _unescape(F.substring(c["piece"], F.lit(len(START) + 1), c["at"] - len(START) - 1), role=True).alias("role"),
        _unescape(F.substring(c["piece"], c["at"] + 1, F.length(c["piece"]))).alias("text"),
        (start + c["at"]).alias("start"),
        (F.length(c["piece"]) - c["at"]).cast("long").alias("length")))
    loss = F.transform(F.filter(F.arrays_zip(F.col("read").alias("read"), F.col("mask").alias("mask")), lambda z: (
        z["mask"]["loss"] & (z["mask"]["start"] == z["read"]["start"]) & (z["mask"]["length"] == z["read"]["length"]))),
        lambda z: z["read"]["text"])
    return (records.withColumn("_pieces", pieces).withColumn("_cut", cut).withColumn("_sizes", sizes)
            .withColumn("_starts", running_starts("_sizes")).withColumn("read", read).withColumn("loss_texts", loss)
            .drop("_pieces", "_cut", "_sizes", "_starts"))


def records_from_rows(rows: DataFrame) -> DataFrame:
    """A variant record per conv_id from rows by turn (conv_id, turn, role, text), laid out as its turns allow.

    A user and an assistant turn: prompt and completion. System, user, assistant: an instruction. Other conversations
    of these roles go by a hash of conv_id into from/value pairs, authored parts or messages; any other role or a null
    one keeps the rows. Turns are ordered by turn, then role and text; a null conv_id is a conversation of its own.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").groupBy("conv_id").agg(
        turns.alias("t")).withColumn("roles", F.transform("t", lambda x: F.coalesce(x["role"], F.lit("?"))))
    way = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    known = F.size(F.array_except("roles", F.array(*map(F.lit, ("system", "user", "assistant"))))) == 0
    record = F.expr("to_variant_object(named_struct('rows', t))")
    for when, made in (
            (known, "named_struct('messages', transform(t, x -> named_struct('role', x.role, 'content', x.text)))"),
            (known & (way == 0), "named_struct('conversations', transform(t, x -> named_struct('from', CASE x.role WHEN 'user' "
                                 "THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END, 'value', x.text)))"),
            (known & (way == 1), "named_struct('thread', transform(t, x -> named_struct('author', named_struct('role', x.role), "
                                 "'content', named_struct('parts', array(x.text)))))"),
            (F.array_join("roles", ",") == "user,assistant",
             "named_struct('prompt', t[0].text, 'completion', t[1].text)"),
            (F.array_join("roles", ",") == "system,user,assistant",
             "named_struct('system', t[0].text, 'instruction', t[1].text, 'output', t[2].text)")):
        record = F.when(when, F.expr(f"to_variant_object({made})")).otherwise(record)
    return said.select("conv_id", record.alias("record"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, mask, read, loss_texts of every conversation of ``rows``."""
    return read_back(formatted(canonical_turns(records_from_rows(rows)))).select(
        "conv_id", "layout", "formatted", "mask", "read", "loss_texts")
