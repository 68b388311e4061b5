"""Chat formatting: schema fingerprints select declarative mappings into canonical turns.

A record's fingerprint is the SHA-256 of those of its nested field paths (a.b, a[].b) that some
layout maps, types left out; other fields don't matter. It selects one of LAYOUTS; each maps
its layout to canonical turns (turn, role, text). An empty list of turns has its layout and no
turns. A record of several layouts' fields has the fingerprint of none: it takes the layout that is
there whole, the one of most fields if there are several, and a `system` text beside it, null and
empty ones left out, goes before its turns. Records with no whole layout, or that are no JSON,
have layout null and no turns.
A table of turn rows is fingerprinted by the paths of its schema in the same way; if columns of
several row layouts clash, the first layout that is there whole is taken.

Template: <|turn|>ROLE<|text|>TEXT<|end|> for each turn, with <|loss|> for <|text|> where the
text is trained on (the role in `loss_roles`); what stands between <|loss|> and <|end|> is
the loss mask. Inside roles and texts a backslash is doubled and every control string gets
one behind its first character, so no marker can occur there and `unescaped` restores all.

Turns are ordered by (turn, null last; role; text). Null texts and roles are empty; rows
with a null conv_id form one conversation. A conversation's turns are joined in blocks of
BLOCK turn numbers first, so even a very long one never meets row by row in one task.
DataFrame operations only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm._common import clear_of

BLOCK = 64
LOSS_ROLES = ("assistant",)
TURN, TEXT, LOSS, END = "<|turn|>", "<|text|>", "<|loss|>", "<|end|>"
#: Strings that templates in use give a meaning to.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and the SQL over the variant `v` that gives its turns."""

    name: str
    paths: tuple[str, ...]
    turns: str
    #: Path of the list of turns, which is a path of its own where it is empty.
    empty: str | None = None

    @property
    def fingerprints(self) -> list[str]:
        return [fingerprint(self.paths), *([fingerprint((self.empty,))] if self.empty else [])]


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _list(path: str, role: str, text: str) -> str:
    got = f"coalesce(try_variant_get(v, '$.{path}', 'array<struct<{role}:string,{text}:string>>'), array())"
    return f"transform({got}, (x, i) -> named_struct('turn', cast(i as bigint), 'role', CASE x.{role} WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.{role} END, 'text', x.{text}))"


def _pair(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('turn', {i}L, 'role', '{role}', 'text', {sql})" for i, (role, sql) in enumerate(parts)) + ")"


def _get(path: str) -> str:
    return f"try_variant_get(v, '$.{path}', 'string')"


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _list("messages", "role", "content"), "messages[]"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _list("conversations", "from", "value"), "conversations[]"),
    Layout("prompt", ("completion", "prompt"), _pair(("user", _get("prompt")), ("assistant", _get("completion")))),
    Layout("instruction", ("instruction", "output"), _pair(("user", _get("instruction")), ("assistant", _get("output")))),
    Layout("instruction_input", ("input", "instruction", "output"), _pair(("user", f"concat_ws('\\n\\n', {_get('instruction')}, nullif({_get('input')}, ''))"), ("assistant", _get("output")))),
    Layout("question", ("answer", "question"), _pair(("user", _get("question")), ("assistant", _get("answer")))),
    Layout("system_prompt", ("prompt", "response", "system"), _pair(("system", _get("system")), ("user", _get("prompt")), ("assistant", _get("response")))),
)


SYSTEM = "system"

#: Tokens of a variant's schema text: a field's name, plain or quoted, the brackets, a type.
_TOKEN = r"`(?:[^`]|``)*`: |[^`:<>, ]+: |OBJECT<>|OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?"


def paths_of(schema: Column) -> Column:
    """Field paths of a variant's schema text, any depth: a.b for objects in objects, a[].b for lists of them.

    A fold over the text's tokens: `prefixes` holds what the names at each open bracket follow.
    A list that is empty everywhere has the path a[], one of plain values a[]. with a dot.
    """
    start = F.struct(F.lit("").alias("at"), F.array(F.lit("")).alias("prefixes"), F.array().cast("array<string>").alias("paths"))

    def state(at: Column, prefixes: Column, paths: Column) -> Column:
        return F.struct(at.alias("at"), prefixes.alias("prefixes"), paths.alias("paths"))

    def step(s: Column, token: Column) -> Column:
        at, prefixes, paths = s["at"], s["prefixes"], s["paths"]
        name = F.btrim(F.substr(token, F.lit(1), F.char_length(token) - 2), F.lit("`"))
        inner = F.when(at == "", at).otherwise(F.concat(at, F.lit(".")))
        leaf = F.when(at.endswith("[]") & (token != "VOID"), F.concat(at, F.lit("."))).otherwise(at)
        return (
            F.when(token.endswith(": "), state(F.concat(F.element_at(prefixes, -1), name), prefixes, paths))
            .when(token == "OBJECT<", state(at, F.array_append(prefixes, inner), paths))
            .when(token == "ARRAY<", state(F.concat(at, F.lit("[]")), F.array_append(prefixes, inner), paths))
            .when(token == ">", state(at, F.slice(prefixes, 1, F.size(prefixes) - 1), paths))
            .otherwise(state(at, prefixes, F.array_append(paths, leaf)))
        )

    return F.coalesce(F.aggregate(F.regexp_extract_all(schema, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: F.array_sort(F.array_distinct(s["paths"]))), F.array().cast("array<string>"))


def turns_of_records(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records without their JSON column, with fingerprint, layout and turns (turn, role, text)."""
    clear_of(records, "fingerprint", "layout", "turns")
    clear_of(records, "v")
    known = sorted({p for x in layouts for p in (*x.paths, x.empty) if p})
    mapped = F.array_intersect(paths_of(F.schema_of_variant("v")), F.array(*map(F.lit, known)))
    got = records.withColumn("v", F.try_parse_json(column)).withColumn("fingerprint", F.sha2(F.array_join(F.array_sort(mapped), "\n"), 256))
    got = got.withColumn("layout", _layout_of(mapped, layouts))
    turns = F.array().cast(_TURNS)
    for x in layouts:
        turns = F.when(F.col("layout") == x.name, F.expr(x.turns).cast(_TURNS)).otherwise(turns)
    # Of a layout that doesn't map it, a system text is a turn of its own.
    told = [x.name for x in layouts if SYSTEM in x.paths]
    system = F.expr(f"nullif({_get(SYSTEM)}, '')")
    apart = F.col("layout").isNotNull() & ~F.col("layout").isin(*told) & system.isNotNull()
    first = F.array(F.struct(F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), system.alias("text")))
    return got.withColumn("turns", F.when(apart, F.concat(first, turns)).otherwise(turns)).drop("v", column)


def _layout_of(mapped: Column, layouts: tuple[Layout, ...]) -> Column:
    """By fingerprint; else the layout of most fields that is there whole, the first of several."""
    name = F.lit(None).cast("string")
    for x in reversed(sorted(layouts, key=lambda x: -len(x.paths))):
        whole = F.size(F.array_except(F.array(*map(F.lit, x.paths)), mapped)) == 0
        name = F.when(whole | (F.array_contains(mapped, x.empty) if x.empty else F.lit(False)), F.lit(x.name)).otherwise(name)
    for x in layouts:
        name = F.when(F.col("fingerprint").isin(*x.fingerprints), F.lit(x.name)).otherwise(name)
    return name


#: Layouts of tables with a row for each turn: paths of (conversation, turn, role, text).
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "from", "value"), ("conv_id", "turn", "message.role", "message.content"))


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Field paths of a schema, any depth."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table of turn rows; columns of no layout are left out."""
    mapped, paths = {fingerprint(x): x for x in ROW_LAYOUTS}, schema_paths(rows.schema)
    known = {p for x in ROW_LAYOUTS for p in x}
    found = mapped.get(fingerprint([p for p in paths if p in known])) or next((x for x in ROW_LAYOUTS if {*x} <= {*paths}), None)
    if found is None:
        raise ValueError(f"no layout has the columns {', '.join(rows.columns)}")
    conv, turn, role, text = (F.col(".".join(f"`{n}`" for n in p.split("."))) for p in found)
    return rows.select(conv.alias("conv_id"), turn.cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))


def escaped(x: Column) -> Column:
    out = F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"\\(\\?)", "$1")


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """(conv_id, formatted) of canonical turn rows."""
    marker = F.when(F.col("role").isin(*loss_roles), F.lit(LOSS)).otherwise(F.lit(TEXT))
    piece = F.concat(F.lit(TURN), escaped(F.col("role")), marker, escaped(F.col("text")), F.lit(END))
    order = [F.col("turn").isNull().alias("none"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = turns.select("conv_id", F.floor(F.coalesce(F.col("turn"), F.lit((1 << 63) - 1)) / F.lit(BLOCK)).alias("block"), F.struct(*order, piece.alias("piece")).alias("row"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["piece"]), "")
    blocks = rows.groupBy("conv_id", "block").agg(joined("row").alias("piece"))
    return blocks.groupBy("conv_id").agg(joined(F.struct("block", "piece")).alias("formatted"))


def parsed(text: Column) -> Column:
    """Turns (role, text, loss) read back from a formatted conversation."""
    pieces = F.filter(F.split(text, r"<\|end\|>", -1), lambda s: s != "")
    parts = lambda s: F.split(s, r"<\|(?:turn|text|loss)\|>", -1)
    return F.transform(pieces, lambda s: F.struct(unescaped(parts(s)[1]).alias("role"), unescaped(parts(s)[2]).alias("text"), F.contains(s, F.lit(LOSS)).alias("loss")))


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, all read back from `formatted`."""
    turns = conversations.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
