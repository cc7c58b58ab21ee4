"""Chat formatting: schema fingerprints choose the mapping of a record to turns; a reversible template marks them.

Built from DataFrame functions alone. A record is a typed struct, whose fields may be null, or a JSON text, which is
first read into the struct that all declared layouts need together. The paths of the nested fields that a record has,
of those that any layout declares, are hashed; a table of hashes, one for each layout and choice of its optional
paths, says which mapping makes turns of the record. Fields that no layout declares are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from gleaner.llm.common import null_to_empty

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"
SEED = 42


@dataclass(frozen=True)
class Layout:
    """Declares where turns are: a list of messages, or single fields that are one turn each.

    A path names nested fields, `a.b`, and `a.list[].b` those of a list's elements, at any depth. `required` paths must be
    there, `optional` ones may be; a path of another layout rules this one out, unless it is optional here. messages is the
    path of the list of turns; role and text are paths within its elements, or fields has the path of each role's
    text. roles renames role names.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        return self.required + self.optional

    def fingerprints(self, known: list[str]) -> list[int]:
        """The hash of the required paths with each choice of optional ones, and with those known paths that lead to them."""

        def whole(own: tuple[str, ...]) -> set[str]:
            return {*own, *(k for k in known if any(p.startswith((f"{k}.", f"{k}[].")) for p in own))}

        return [path_hash(whole((*self.required, *some))) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]

    def turns(self, record: Column, kind: StructType) -> Column:
        """array<struct<role,text>>; a field turn that is absent is left out if it is optional."""
        if self.messages is None:
            made = [F.when(_text(record, kind, p).isNotNull() | F.lit(p in self.required), F.struct(F.lit(r).alias("role"), _text(record, kind, p).alias("text"))) for r, p in self.fields]
            return F.array_compact(F.array(*made))
        said, listed = _at(record, kind, self.messages)
        inner = listed.elementType

        def role_of(m: Column) -> Column:
            out = _text(m, inner, self.role)
            for old, new in self.roles:
                out = F.when(_text(m, inner, self.role) == old, new).otherwise(out)
            return out

        return F.transform(said, lambda m: F.struct(role_of(m).alias("role"), _text(m, inner, self.text).alias("text")))

    def fits(self, kind: DataType) -> bool:
        """Whether records of a type can have this layout: all required paths, and turns where they are declared."""
        there = all(_type_at(kind, p) is not None for p in self.required)
        return there and (self.messages is None or isinstance(_type_at(kind, self.messages), ArrayType))

    def not_texts(self, kind: DataType) -> list[str]:
        """Paths of texts and roles that a type has as structs, lists or maps."""
        listed = f"{self.messages}[]." if self.messages else ""
        own = [listed + p for p in (self.role, self.text)] if self.messages else [p for _, p in self.fields]
        return [p for p in own if isinstance(_type_at(kind, p), (ArrayType, MapType, StructType))]


def _steps(path: str) -> list[tuple[str, bool]]:
    """(name, whether a list's elements are meant) of a path."""
    return [(s.removesuffix("[]"), s.endswith("[]")) for s in path.split(".")]


def _type_at(kind: DataType, path: str) -> DataType | None:
    """The type at a path; None if there is none. Of a list's elements where the path goes into them."""
    for name, listed in _steps(path):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
        if listed:
            if not isinstance(kind, ArrayType):
                return None
            kind = kind.elementType
    return kind


def _at(record: Column, kind: DataType, path: str) -> tuple[Column, DataType | None]:
    """The value at a path without lists, and its type; null where the type has no such path."""
    found = _type_at(kind, path)
    if found is None:
        return F.lit(None), None
    for name, _ in _steps(path):
        record = record[name]
    return record, found


def _text(record: Column, kind: DataType, path: str) -> Column:
    return _at(record, kind, path)[0].cast("string")


def _messages(name: str, field: str, role: str, text: str, roles: tuple = ()) -> Layout:
    """A list of turns; empty lists, turns without a text or role and an extra prompt are allowed."""
    return Layout(name, (field,), (f"{field}[].{role}", f"{field}[].{text}", "prompt"), messages=field, role=role, text=text, roles=roles)


#: Layouts that public instruction data commonly has.
LAYOUTS = (
    _messages("messages", "messages", "role", "content"),
    _messages("conversations", "conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Layout("instruction", ("output",), ("instruction", "input"), fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_completion", ("completion",), ("prompt",), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("response",), ("prompt",), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer",), ("question",), fields=(("user", "question"), ("assistant", "answer"))),
)


def path_hash(paths: list[str]) -> int:
    """XXH64 of the sorted paths, joined by line ends, as fingerprint() computes it for a row."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), SEED)
    return value - (1 << 64) if value >> 63 else value


def declared(layouts: tuple[Layout, ...]) -> tuple[list[str], dict[int, str]]:
    """(all paths, layout of each fingerprint); layouts that one record could both fit are refused."""
    names: dict[int, str] = {}
    paths = sorted({p for x in layouts for p in x.paths})
    for x in layouts:
        for h in x.fingerprints(paths):
            if names.setdefault(h, x.name) != x.name:
                raise ValueError(f"layouts {names[h]} and {x.name} fit the same record")
    return paths, names


def record_schema(layouts: tuple[Layout, ...]) -> str:
    """The struct of all declared paths, every leaf a string, for reading JSON."""
    tree: dict = {}
    lists: set[tuple[str, ...]] = set()
    for x in layouts:
        for p in [*x.paths, *([f"{x.messages}[]"] if x.messages else [])]:
            node, at = tree, ()
            for name, listed in _steps(p):
                node, at = node.setdefault(name, {}), (*at, name)
                if listed:
                    lists.add(at)

    def shown(node: dict, at: tuple[str, ...]) -> str:
        own = f"struct<{', '.join(f'`{k}`: {shown(v, (*at, k))}' for k, v in node.items())}>" if node else "string"
        return f"array<{own}>" if at in lists else own

    return f"struct<{', '.join([*(f'`{k}`: {shown(v, (k,))}' for k, v in tree.items()), '`__bad`: string'])}>"


def _there(value: Column, kind: DataType, steps: list[tuple[str, bool]]) -> Column | None:
    """Whether a value has a path; None if its type has none."""
    if not steps:
        return value.isNotNull()
    (name, listed), *rest = steps
    if not isinstance(kind, StructType) or name not in kind.names:
        return None
    inner = kind[name].dataType
    if not listed:
        return _there(value[name], inner, rest)
    if not isinstance(inner, ArrayType) or _there(value[name], inner.elementType, rest) is None:
        return None
    return F.exists(value[name], lambda m: F.coalesce(_there(m, inner.elementType, rest), F.lit(False)))


def fingerprint(record: Column, kind: DataType, paths: list[str]) -> Column:
    """Hash of those declared paths that a record has. A null field is absent; a list's field is there if an element has it."""
    found = [(p, _there(record, kind, _steps(p))) for p in paths]
    there = [F.when(has, p) for p, has in found if has is not None]
    return F.xxhash64(F.array_join(F.array_sort(F.array_compact(F.array(*there))), "\n"))


def escape(text: Column) -> Column:
    r"""No `<|` is left: backslashes are doubled and `<|` becomes `<\|`."""
    return F.replace(F.replace(null_to_empty(text), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


def canonical_turns(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, out: str = "turns") -> DataFrame:
    """All columns with layout (name), schema_hash (long), turns and error added, replacing columns of these names.

    record_col is a struct or a JSON text. A text or role that is missing or null is empty. error is null where there
    are turns, else `null_record`, `not_json` (also: nested too deep), `unknown_layout`, or `not_text` where a typed record has
    a struct, list or map in the place of a text; nothing is dropped silently. In JSON such a place gives its JSON as text.
    A typed record has no bound but a row's own 2 GB; a JSON string may have as many characters as a Java string.
    """
    paths, names = declared(layouts)
    base = [c for c in records.columns if c not in ("layout", "schema_hash", "error", out)]
    kind = records.schema[record_col].dataType
    record = F.col(record_col)
    if isinstance(kind, StringType):
        schema = record_schema(layouts)
        record = F.from_json(record, schema, {"maxStringLen": str((1 << 31) - 1), "columnNameOfCorruptRecord": "__bad"})
        kind = DataType.fromDDL(schema)
        bad = F.col("__v.__bad").isNotNull()
    else:
        bad = F.lit(False)
    read = records.select(*base, record.alias("__v"), F.col(record_col).isNull().alias("__none")).withColumn("__h", fingerprint(F.col("__v"), kind, paths))
    layout, odd = F.lit(None).cast("string"), F.lit(False)
    turns = F.lit(None).cast(TURNS)
    for x in layouts:
        fits = F.col("__h").isin(*(h for h, name in names.items() if name == x.name))
        if x.fits(kind):
            layout = F.when(fits, x.name).otherwise(layout)
            if x.not_texts(kind):
                odd = odd | fits
            else:
                turns = F.when(fits, x.turns(F.col("__v"), kind)).otherwise(turns)
    usable = ~F.col("__none") & ~bad
    turns = F.when(usable, F.transform(turns, lambda t: F.struct(null_to_empty(t.role).alias("role"), null_to_empty(t.text).alias("text"))))
    layout = F.when(usable, layout)
    error = F.when(F.col("__none"), "null_record").when(bad, "not_json").when(layout.isNull(), "unknown_layout").when(odd, "not_text")
    return read.select(*base, layout.alias("layout"), F.when(usable, F.col("__h")).alias("schema_hash"), turns.alias(out), error.alias("error"))


def format_turns(turns: Column, loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[Column, Column]:
    """(formatted text, loss mask).

    The mask has an entry for each turn: the code points before its text, of its text as escaped, and after it, and
    whether the text has loss. The entries' sums are the formatted text's length, and each is made from its turn
    alone, so that a conversation of many turns takes time in proportion.
    """
    opened = lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"))
    formatted = F.array_join(F.transform(turns, lambda t: F.concat(opened(t), escape(t.text), F.lit(END + "\n"))), "")
    mask = F.transform(
        turns,
        lambda t: F.struct(F.length(opened(t)).alias("before"), F.length(escape(t.text)).alias("chars"), F.lit(len(END) + 1).alias("after"), t.role.isin(*loss_roles).alias("loss")),
    )
    return formatted, mask


def _pieces(formatted: Column) -> Column:
    """What follows each opening mark; the escape leaves no mark inside texts or roles."""
    return F.filter(F.split(formatted, r"<\|im_start\|>"), lambda _, i: i > 0)


def read_turns(formatted: Column) -> Column:
    """array<struct<role,text>>, as they were before formatting."""

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(p.substr(F.length(role) + 2, F.length(p) - F.length(role) - (len(END) + 2))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """Unescaped texts under the mask, in order."""
    under = F.zip_with(_pieces(formatted), mask, lambda p, m: F.when(m.loss, unescape(p.substr(m.before - len(START) + 1, m.chars))))
    return F.filter(under, lambda t: t.isNotNull())


def format_chat(records: DataFrame, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """canonical_turns() with formatted (string) and loss_mask added; both are null where turns are."""
    turned = canonical_turns(records, record_col, layouts)
    formatted, mask = format_turns(F.col("turns"), loss_roles)
    return turned.drop("formatted", "loss_mask").withColumns({"formatted": formatted, "loss_mask": mask})


def as_records(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, record): a typed record in the messages layout for each conversation of a table of turns.

    Turns are ordered by number, nulls last, then role and text. Null texts and roles are empty. A conversation is
    one training example, so its turns meet in one row; null conv_ids are one conversation; repeated rows repeat.
    """
    row = F.struct(F.col(turn_col).isNull().alias("no"), F.col(turn_col).alias("turn"), null_to_empty(role_col).alias("role"), null_to_empty(text_col).alias("content"))
    ordered = F.array_sort(F.collect_list(row))
    messages = F.transform(ordered, lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    return turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.struct(messages.alias("messages")).alias("record"))
