"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is JSON text in any of several layouts (prompt and completion, instruction and output, lists of messages,
...). Its nested field paths, without the types of their values, are hashed; the fingerprint selects a declarative
:class:`Mapping`, which turns the record into canonical turns (role, text). :func:`formatted` writes turns in a
template whose control strings are escaped inside texts, with a loss mask; :func:`read_back` gives the turns and
the text under the mask again.

Defined cases: a record that is null, no JSON or of no known layout has null turns (:func:`unmapped` counts such
layouts); an empty list of messages has no turns, and its formatted text is empty; a null text is empty; a null role
is the empty role; an optional field that is null or missing makes no turn. In :func:`records`, rows of a null id are one conversation;
rows of the same turn are ordered by role, then text, and repeated rows stay; columns of other names are not read.
A conversation is one row from grouping on, as its digest is of one text: the rows of one id meet in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import free

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Say:
    """One turn of ``role``; its text is at ``paths``, joined by an empty line where they are several."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each object of the list at ``path``; ``roles`` renames what is found in its field ``role``."""

    path: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    """The turns of one layout, in order. Fields of ``optional`` and ``ignored`` may be missing; ignored ones are not read.

    Paths are names joined by dots, with ``[]`` after a list. Each choice of the optional and ignored fields has a fingerprint
    of its own.
    """

    name: str
    parts: tuple[Say | Each, ...]
    optional: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    def layouts(self) -> list[frozenset[str]]:
        """The sets of field paths that this mapping reads; a list may be empty."""
        always: list[list[set[str]]] = []
        for p in self.parts:
            if isinstance(p, Each):
                always.append([{f"{p.path}[].{p.role}", f"{p.path}[].{p.text}"}, {f"{p.path}[]"}])
            else:
                always.append([{x for x in p.paths if x not in self.optional}])
        free_ = [*self.optional, *self.ignored]
        sets = [frozenset()]
        for choice in always:
            sets = [s | frozenset(c) for s in sets for c in choice]
        return [s | frozenset(c) for s in sets for n in range(len(free_) + 1) for c in combinations(free_, n)]

    def fingerprints(self) -> list[str]:
        return sorted({hashlib.sha256(skeleton(paths).encode()).hexdigest()[:16] for paths in self.layouts()})


MAPPINGS = (
    Mapping("messages", (Each("messages", "role", "content"),), ignored=("id",)),
    Mapping("conversations", (Say("system", ("system",)), Each("conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))), optional=("system",), ignored=("id",)),
    Mapping("completion", (Say("user", ("prompt",)), Say("assistant", ("completion",))), ignored=("id",)),
    Mapping("response", (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",))), optional=("system",), ignored=("id",)),
    Mapping("instruction", (Say("user", ("instruction", "input")), Say("assistant", ("output",))), optional=("input",), ignored=("id",)),
    Mapping("question", (Say("user", ("data.question",)), Say("assistant", ("data.answer.text",))), ignored=("id",)),
)


def _quoted(name: str) -> str:
    plain = name.replace("_", "a").isalnum() and name.isascii() and not name.isdigit()
    return name if plain else f"`{name.replace('`', '``')}`"


def skeleton(paths: frozenset[str]) -> str:
    """The nested fields as :func:`shape` writes those of a record."""
    tree: dict = {}
    for path in paths:
        node = tree
        for name in path.replace("[]", ".[]").split("."):
            node = node.setdefault(name, {})

    def text(node: dict) -> str:
        if not node:
            return ""
        if "[]" in node:
            return f"ARRAY<{text(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{_quoted(k)}: {text(node[k])}" for k in sorted(node)) + ">"

    return text(tree)


def shape(variant: Column) -> Column:
    """The nested field paths of a value: its schema, fields in order of their names, without the types of single values."""
    return F.regexp_replace(F.schema_of_variant(variant), r"(`(?:[^`]|``)*`|OBJECT<|ARRAY<|\w+:)|\w+(?:\([0-9]+,[0-9]+\))?", "$1")


def _at(path: str) -> str:
    return "$" + "".join(f"['{name}']" for name in path.split("."))


def _turns(variant: Column, mapping: Mapping) -> Column:
    """The mapping as an expression."""

    def say(p: Say) -> Column:
        texts = [F.try_variant_get(variant, _at(x), "string") for x in p.paths]
        needed = [t for x, t in zip(p.paths, texts, strict=True) if x not in mapping.optional]
        joined = [F.coalesce(t, F.lit("")) if x not in mapping.optional else t for x, t in zip(p.paths, texts, strict=True)]
        turn = F.array(F.struct(F.lit(p.role).alias("role"), F.concat_ws("\n\n", *joined).alias("text")))
        return turn if needed else F.when(F.coalesce(*texts).isNotNull(), turn).otherwise(F.array().cast(TURNS))

    def each(p: Each) -> Column:
        def one(m: Column) -> Column:
            role = found = F.coalesce(F.try_variant_get(m, _at(p.role), "string"), F.lit(""))
            for a, b in p.roles:
                role = F.when(found == a, F.lit(b)).otherwise(role)
            return F.struct(role.alias("role"), F.coalesce(F.try_variant_get(m, _at(p.text), "string"), F.lit("")).alias("text"))

        return F.transform(F.try_variant_get(variant, _at(p.path), "array<variant>"), one)

    parts = [say(p) if isinstance(p, Say) else each(p) for p in mapping.parts]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def canonical(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with fingerprint, layout (the mapping's name) and turns of the JSON text in column ``record``.

    Columns of these names are replaced.
    """
    seen: dict[str, str] = {}
    for m in mappings:
        for f in m.fingerprints():
            if seen.setdefault(f, m.name) != m.name:
                raise ValueError(f"{seen[f]} and {m.name} read the same layout")
    value = free("_value", df.columns)
    df = df.withColumn(value, F.try_parse_json(record))
    v, layout, turns = F.col(value), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        fits = F.col("fingerprint").isin(m.fingerprints())
        layout, turns = F.when(fits, F.lit(m.name)).otherwise(layout), F.when(fits, _turns(v, m)).otherwise(turns)
    df = df.withColumn("fingerprint", F.substring(F.sha2(shape(v), 256), 1, 16))
    return df.withColumns({"layout": layout, "turns": turns}).drop(value)


def unmapped(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """fingerprint, shape and n_records of every layout that no mapping reads; those of records that are no JSON are null."""
    known = [f for m in mappings for f in m.fingerprints()]
    shapes = df.select(shape(F.try_parse_json(record)).alias("shape")).groupBy("shape").agg(F.count("*").alias("n_records"))
    shapes = shapes.select(F.substring(F.sha2("shape", 256), 1, 16).alias("fingerprint"), "shape", "n_records")
    return shapes.where(F.col("fingerprint").isNull() | ~F.col("fingerprint").isin(known))


def escaped(text: Column) -> Column:
    """No control string is left: ``<|`` becomes ``<\\|``, and where backslashes stand between there is one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escaped_role(role: Column) -> Column:
    """As texts, and on one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescaped(role), r"\\\\", -1), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def formatted(df: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with formatted, and loss: for each turn, start and length in code points of what is trained on.

    ``start`` counts from the end of the turn's start marker; the length is 0 for roles not in ``trained``.
    Null turns give nulls.
    """
    pieces = free("_pieces", df.columns)

    def piece(t: Column) -> Column:
        role, text = _escaped_role(F.coalesce(t["role"], F.lit(""))), escaped(F.coalesce(t["text"], F.lit("")))
        length = F.when(F.coalesce(t["role"], F.lit("")).isin(*trained), F.char_length(text)).otherwise(0)
        return F.struct(F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n")).alias("piece"), (F.char_length(role) + 1).alias("start"), length.alias("length"))

    df = df.withColumn(pieces, F.transform("turns", piece))
    loss = F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return df.withColumns({"formatted": F.array_join(F.col(pieces)["piece"], ""), "loss": loss}).drop(pieces)


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with read_turns and read_loss (all text under the mask), from ``formatted`` and ``loss`` alone."""
    read, tail = free("_read", df.columns), len(END) + 1

    def turn(piece: Column, span: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.char_length(role) + 2, F.char_length(piece) - F.char_length(role) - 1 - tail)
        under = F.substring(piece, span["start"] + 1, span["length"])
        return F.struct(_unescaped_role(role).alias("role"), unescaped(text).alias("text"), unescaped(under).alias("under"))

    pieces = F.split("formatted", r"<\|im_start\|>", -1)
    df = df.withColumn(read, F.zip_with(F.slice(pieces, 2, F.greatest(F.size("loss"), F.lit(0))), F.col("loss"), turn))
    turns = F.transform(read, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return df.withColumns({"read_turns": turns, "read_loss": F.array_join(F.col(read)["under"], "")}).drop(read)


def records(conversations: DataFrame) -> DataFrame:
    """conv_id and record, JSON text: each conversation in the plainest layout that holds it.

    A user's and an assistant's turn are prompt and completion; with a system's turn before, system, prompt and response. Longer
    ones that a system's turn opens name their speakers human and gpt; all others are lists of messages.
    """
    rows = conversations.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = whole.withColumn("roles", F.col("t")["role"])
    text = lambda i: F.col("t")[i]["text"]
    named = lambda m: F.struct(F.when(m["role"] == "user", "human").otherwise("gpt").alias("from"), m["text"].alias("value"))
    rest = F.slice("t", 2, F.size("t"))
    two_sided = F.forall(F.slice("roles", 2, F.size("roles")), lambda r: r.isin("user", "assistant"))
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion")))
    three = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    speakers = F.to_json(F.struct(text(0).alias("system"), F.transform(rest, named).alias("conversations")))
    messages = F.to_json(F.struct(F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages")))
    roles = lambda *r: F.col("roles") == F.array(*map(F.lit, r))
    record = F.when(roles("user", "assistant"), pair).when(roles("system", "user", "assistant"), three)
    record = record.when((F.col("roles")[0] == "system") & (F.size("roles") > 1) & two_sided, speakers).otherwise(messages)
    return whole.select("conv_id", record.alias("record"))


def digests(df: DataFrame) -> DataFrame:
    """conv_id and the figures of what :func:`read_back` gives."""
    whole = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select("conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("read_loss").cast("long").alias("loss_chars"), F.sha2("read_loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout")
