"""Faults of conversations and their cheapest repair.

A repaired conversation has the roles (s?(ua)+)?: perhaps a system turn, then a user's and an assistant's in turn, or nothing.
Turns may be kept, given the role that fits, deleted, or inserted with an empty text. The costs to go, for each state of that
grammar, are computed from the last turn to the first; a walk from the first turn then takes, among the edits that keep to
the least cost, the one with the least letter. Before any state only one of user and assistant fits, so the letters alone
give the repaired turns.

Conversations are sorted in tasks and repaired one after the other. A conversation of very many turns or bytes is dealt over
tasks in pieces: each piece is first a matrix of least costs from state to state; going back over a conversation's pieces gives
the costs to go at each piece's end, a walk through each piece from all four states gives where each leads, and going
forward over the pieces which of them holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import with_row_key, written
from .textarrays import freeing

#: States of the grammar: nothing yet, after a system turn, after a user's, after an assistant's; where a role's initial leads.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
#: Where the one of user and assistant leads that fits.
_FITS = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = {_USER: "user", _ASSISTANT: "assistant"}
_REROLE, _DELETE, _TRUNCATED, _INSERT = 1, 2, 5, 5
#: Costs to go after the last turn.
_DONE = (0, 2 * _INSERT, _INSERT, 0)
_NEVER = 1 << 40
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_BLANKS = " \t\n\x0b\x0c\r"
_MAX_BROADCAST = 1_000_000


def faults(turns: list[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text): blank, duplicate, truncated, or an empty string."""
    seen: set[tuple[str, str]] = set()
    out = []
    for turn in turns:
        text = turn[1].rstrip(_BLANKS)
        out.append("blank" if not text else "duplicate" if turn in seen else "truncated" if text[-1] not in ".!?" else "")
        seen.add(turn)
    return out


def symbol(role: str, fault: str) -> str:
    """What the repair sees of a turn: - if it must go, else its role's initial (x: of no known role), upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "-"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


@lru_cache(1 << 14)
def _before(turn: str, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a turn from those after it."""
    plain = []
    for state in range(4):
        least = _DELETE + ahead[state]
        if turn != "-":
            more = _TRUNCATED * turn.isupper()
            kept = _AFTER.get((state, turn.lower()))
            least = min(least, more + _REROLE + ahead[_FITS[state]], _NEVER if kept is None else more + ahead[kept])
        plain.append(min(least, _NEVER))
    return tuple(min(plain[s], _INSERT + plain[_FITS[s]], 2 * _INSERT + plain[_FITS[_FITS[s]]]) for s in range(4))


@lru_cache(1 << 14)
def _edit(turn: str, ahead: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letter among the edits that keep to the least cost, and the state it leads to."""
    here, kept = _before(turn, ahead), _AFTER.get((state, turn.lower()))
    if _DELETE + ahead[state] == here[state]:
        return "D", state
    if _INSERT + here[_FITS[state]] == here[state]:
        return "I", _FITS[state]
    if kept is not None and _TRUNCATED * turn.isupper() + ahead[kept] == here[state]:
        return "K", kept
    return "R", _FITS[state]


def costs_to_go(symbols: str, end: tuple[int, ...] = _DONE) -> tuple[list[tuple[int, ...]], list[int]]:
    """For each place between turns the costs to go by state, as their least value and what each has above it."""
    above, least = [()] * (len(symbols) + 1), [0] * (len(symbols) + 1)
    least[-1] = min(end)
    above[-1] = tuple(x - least[-1] for x in end)
    for k in range(len(symbols) - 1, -1, -1):
        here = _before(symbols[k], above[k + 1])
        low = min(here)
        least[k] = least[k + 1] + low
        above[k] = here if not low else tuple(x - low for x in here)
    return above, least


def walk(symbols: str, above: list[tuple[int, ...]], state: int, last: bool = True) -> tuple[str, int]:
    """The letters of the edits from a state on, and the state after them. last: whether the conversation ends here."""
    letters, k = [], 0
    while k < len(symbols):
        letter, state = _edit(symbols[k], above[k + 1], state)
        letters.append(letter)
        k += letter != "I"
    while last and _DONE[state]:
        letters.append("I")
        state = _FITS[state]
    return "".join(letters), state


def repaired(letters: str, turns: list[tuple[str, str]], state: int = _START) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of the turns that the edits leave."""
    at = iter(turns)
    for letter in letters:
        role, text = next(at) if letter != "I" else ("", "")
        if letter == "D":
            continue
        following = _AFTER[state, role[0]] if letter == "K" else _FITS[state]
        yield letter, role if letter == "K" else _ROLES[following], text
        state = following


def illegal(initials: list[str]) -> int:
    return sum(pair not in _LEGAL for pair in zip(initials, initials[1:]))


class _Summary(NamedTuple):
    gaps: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    audit: str = ""
    repaired_sha256: str = hashlib.sha256().hexdigest()


_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _summary(numbers: list[int | None], turns: list[tuple[str, str]]) -> _Summary:
    """All figures of one conversation in order."""
    if not turns:
        return _Summary()
    known = {n for n in numbers if n is not None}
    found = faults(turns)
    symbols = "".join(symbol(role, fault) for (role, _), fault in zip(turns, found))
    above, least = costs_to_go(symbols)
    letters, _ = walk(symbols, above, _START)
    left = "\n".join(f"{role}:{text}" for _, role, text in repaired(letters, turns))
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return _Summary(gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal([role[:1] for role, _ in turns]), least[0] + above[0][_START], letters, hashlib.sha256(left.encode()).hexdigest())


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list, list]]:
    """(conv, turn numbers, turns) of each conversation of a task's sorted rows; rows that are not there count for its id only."""
    conv, numbers, turns, some = None, [], [], False
    for batch in batches:
        for c, n, role, text, there in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "role", "text", "there")), strict=True):
            if some and c != conv:
                yield conv, numbers, turns
                numbers, turns = [], []
            conv, some = c, True
            if there:
                numbers.append(n)
                turns.append((role, text))
    if some:
        yield conv, numbers, turns


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), schema.types)], schema=schema)


class _Rows(NamedTuple):
    """The turns of ordinary conversations, of those dealt in pieces (None if there are none), and the id's type."""

    ordinary: DataFrame
    large: DataFrame | None
    id_type: str

    def schema(self, columns: str) -> tuple[str, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        text = f"conv_id {self.id_type}, {columns}"
        return text, to_arrow_schema(_parse_datatype_string(text))


def _rows(rows: DataFrame, there: Column | None, max_rows: int, max_bytes: int) -> _Rows:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), (F.lit(True) if there is None else there).alias("there"))
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    large = written(sizes.where((F.col("n") > max_rows) | (F.col("bytes") > max_bytes)).select(F.col("conv").alias("large")))
    n_large = large.count()
    id_type = rows.schema["conv_id"].dataType.simpleString()
    if not n_large:
        return _Rows(turns, None, id_type)
    side = F.broadcast(large) if n_large <= _MAX_BROADCAST else large
    same = F.col("conv").eqNullSafe(F.col("large"))
    return _Rows(turns.join(side, same, "left_anti"), turns.join(side, same, "left_semi"), id_type)


def _sorted_tasks(ordinary: DataFrame) -> DataFrame:
    return ordinary.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")


def repair_conversations(rows: DataFrame, there: Column | None = None, max_rows: int = 20_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (the edits' letters) and repaired_sha256 (of the repaired turns as role:text, joined by newlines).

    Turns are taken by number, null ones first (ties: by role, then text; in pieces by the text's first 1000 characters, then its
    hash). A null role or text is one space, so that turn is
    blank; a null conv_id is one conversation of its own. gaps counts the numbers missing between the least and the greatest
    (null ones don't count). there: rows for which it is false are only known for their conv_id; a conversation without any
    other has zeros, an empty audit and the hash of the empty text. Conversations of more than max_rows turns or
    max_bytes bytes are dealt over tasks in pieces; only their hash, which can't be split, is one task's, which keeps nothing of
    the turns that it reads. An empty table gives an empty one. Other columns are ignored.
    """
    found = _rows(rows, there, max_rows, max_bytes)
    schema, arrow = found.schema(_SUMMARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(((conv, *_summary(numbers, turns)) for conv, numbers, turns in _one_by_one(batches)), arrow)

    whole = _sorted_tasks(found.ordinary).mapInArrow(freeing(run), schema)
    return whole if found.large is None else whole.unionByName(_large_summaries(_in_pieces(found, max_rows), found))


def repaired_turns(rows: DataFrame, there: Column | None = None, max_rows: int = 20_000, max_bytes: int = 32 << 20) -> DataFrame:
    """The repaired conversations of rows (see repair_conversations): conv_id, turn (renumbered from 0), role, text, edit (K, R
    or I). Conversations that the repair leaves without a turn have no row."""
    found = _rows(rows, there, max_rows, max_bytes)
    schema, arrow = found.schema("turn long, role string, text string, edit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def left() -> Iterator[tuple]:
            for conv, _, turns in _one_by_one(batches):
                symbols = "".join(symbol(role, fault) for (role, _), fault in zip(turns, faults(turns)))
                letters, _ = walk(symbols, costs_to_go(symbols)[0], _START)
                for k, (letter, role, text) in enumerate(repaired(letters, turns)):
                    yield conv, k, role, text, letter

        yield from _in_batches(left(), arrow)

    whole = _sorted_tasks(found.ordinary).mapInArrow(freeing(run), schema)
    if found.large is None:
        return whole
    pieces = _in_pieces(found, max_rows)

    def rebuild(turns: pa.Table, audit: pa.Table) -> Iterator[tuple]:
        conv, before = audit.column("conv")[0].as_py(), audit.column("before")[0].as_py()
        for k, (letter, role, text) in enumerate(_rebuilt(turns, audit)):
            yield conv, before + k, role, text, letter

    return whole.unionByName(_over_pieces(pieces, rebuild, schema, arrow))


# Conversations in pieces


class _Pieces(NamedTuple):
    """turns: conv, part, piece, row, turn, role, text, fault; audits: conv, part, piece, state, letters, before (turns left by the
    pieces before), last, and the pieces' counts."""

    turns: DataFrame
    audits: DataFrame


def _in_pieces(found: _Rows, piece_rows: int) -> _Pieces:
    keyed = with_row_key(written(found.large), "key")
    order = ["conv", F.asc_nulls_first("turn"), "role", "head", "digest", "key"]  # the bounds of ranges are driver data, so no whole texts
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    dealt = written(keyed.withColumns({"digest": digest, "head": F.substring("text", 1, 1000)}).repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "head"))
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    placed = dealt.select("*", part.alias("part"), F.col("_metadata.row_index").alias("row")).withColumn("piece", F.floor(F.col("row") / piece_rows))
    last = F.substring(F.rtrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")), -1, 1)
    firsts = placed.where("there").groupBy("conv", "digest").agg(F.min(F.struct("part", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("digest").alias("d"), "first")
    marked = placed.where("there").join(firsts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(last == "", "blank").when(F.col("first").isNotNull() & (F.struct("part", "row") > F.col("first")), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    turns = written(marked.select("conv", "part", "piece", "row", "turn", "role", "text", fault.alias("fault")))

    conv = f"conv {found.id_type}"
    matrices_schema = f"{conv}, part int, piece long, symbols string, initials string, blank long, duplicate long, truncated long, illegal long, matrix array<long>"
    _, arrow = found.schema(matrices_schema.split(", ", 1)[1])

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        roles, found_faults = table.column("role").to_pylist(), table.column("fault").to_pylist()
        symbols = "".join(map(symbol, roles, found_faults))
        rows = []
        for state in range(4):
            above, least = costs_to_go(symbols, tuple(0 if s == state else _NEVER for s in range(4)))
            rows += [least[0] + x for x in above[0]]
        initials = [r[:1] for r in roles]
        ends = (initials[0] or "x") + (initials[-1] or "x")
        values = [table.column(c)[0].as_py() for c in ("conv", "part", "piece")] + [symbols, ends, *map(found_faults.count, ("blank", "duplicate", "truncated")), illegal(initials), rows]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip(values, arrow.types)], names=["conv", *arrow.names[1:]])

    matrices = written(turns.select("conv", "part", "piece", "row", "role", "fault").groupBy("conv", "part", "piece").applyInArrow(matrix, matrices_schema))

    ends_schema = f"{conv}, part int, piece long, ahead array<long>, last boolean, cost long, between long"
    _, ends_arrow = found.schema(ends_schema.split(", ", 1)[1])

    def costs_at_ends(table: pa.Table) -> pa.Table:
        """Back over the pieces of a conversation, some numbers each."""
        table = table.sort_by([("part", "ascending"), ("piece", "ascending")])
        rows, ahead, out = table.to_pylist(), _DONE, []
        for k in range(len(rows) - 1, -1, -1):
            m = rows[k]["matrix"]
            between = int(k > 0 and (rows[k - 1]["initials"][1], rows[k]["initials"][0]) not in _LEGAL)
            after = ahead
            ahead = tuple(min(m[4 * end + state] + after[end] for end in range(4)) for state in range(4))
            out.append((rows[k]["conv"], rows[k]["part"], rows[k]["piece"], list(after), k == len(rows) - 1, ahead[_START] if k == 0 else 0, between))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), ends_arrow.types)], names=["conv", *ends_arrow.names[1:]])

    ends = matrices.drop("symbols").groupBy("conv").applyInArrow(costs_at_ends, ends_schema).withColumnRenamed("conv", "e")
    joined = matrices.drop("matrix", "initials").join(ends, F.col("conv").eqNullSafe(F.col("e")) & (matrices.part == ends.part) & (matrices.piece == ends.piece)).drop(ends.part).drop(ends.piece).drop("e")
    walks_schema = f"{conv}, part int, piece long, last boolean, cost long, illegal long, blank long, duplicate long, truncated long, letters array<string>, exits array<int>, left array<long>"
    _, walks_arrow = found.schema(walks_schema.split(", ", 1)[1])

    def from_all_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walks() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    above, _ = costs_to_go(r["symbols"], tuple(r["ahead"]))
                    letters, exits = zip(*(walk(r["symbols"], above, state, r["last"]) for state in range(4)))
                    yield r["conv"], r["part"], r["piece"], r["last"], r["cost"], r["illegal"] + r["between"], r["blank"], r["duplicate"], r["truncated"], letters, exits, [len(x) - x.count("D") for x in letters]

        for batch in _in_batches(walks(), walks_arrow, 1):
            yield pa.RecordBatch.from_arrays(batch.columns, names=["conv", *walks_arrow.names[1:]])

    walks = written(joined.mapInArrow(freeing(from_all_states), walks_schema))
    entries_schema = f"{conv}, part int, piece long, state int, before long"
    _, entries_arrow = found.schema(entries_schema.split(", ", 1)[1])

    def entries(table: pa.Table) -> pa.Table:
        """Forward over the pieces of a conversation."""
        state, before, out = _START, 0, []
        for r in table.sort_by([("part", "ascending"), ("piece", "ascending")]).to_pylist():
            out.append((r["conv"], r["part"], r["piece"], state, before))
            before += r["left"][state]
            state = r["exits"][state]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), entries_arrow.types)], names=["conv", *entries_arrow.names[1:]])

    at = walks.select("conv", "part", "piece", "exits", "left").groupBy("conv").applyInArrow(entries, entries_schema).withColumnRenamed("conv", "e")
    whole = walks.join(at, F.col("conv").eqNullSafe(F.col("e")) & (walks.part == at.part) & (walks.piece == at.piece)).drop(at.part).drop(at.piece)
    audits = written(whole.select("conv", "part", "piece", "state", "before", "last", "cost", "illegal", "blank", "duplicate", "truncated", F.get("letters", F.col("state")).alias("letters")))
    return _Pieces(turns, audits)


def _rebuilt(turns: pa.Table, audit: pa.Table) -> Iterator[tuple[str, str, str]]:
    turns = turns.sort_by("row")
    return repaired(audit.column("letters")[0].as_py(), list(zip(turns.column("role").to_pylist(), turns.column("text").to_pylist())), audit.column("state")[0].as_py())


def _over_pieces(pieces: _Pieces, rebuild: Callable[[pa.Table, pa.Table], Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """rebuild(turns, audit) for each piece; rows as in schema."""

    def run(turns: pa.Table, audit: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_in_batches(rebuild(turns, audit), arrow), arrow)

    keys = ("conv", "part", "piece")
    return pieces.turns.select(*keys, "row", "role", "text").groupBy(*keys).cogroup(pieces.audits.groupBy(*keys)).applyInArrow(run, schema)


def _large_summaries(pieces: _Pieces, found: _Rows) -> DataFrame:
    schema, arrow = found.schema("part int, piece long, text string")

    def texts(turns: pa.Table, audit: pa.Table) -> Iterator[tuple]:
        left = "\n".join(f"{role}:{text}" for _, role, text in _rebuilt(turns, audit))
        if left:
            yield tuple(audit.column(c)[0].as_py() for c in ("conv", "part", "piece")) + (left,)

    hash_schema, hash_arrow = found.schema("repaired_sha256 string")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def streamed() -> Iterator[tuple]:
            conv, state = None, None
            for batch in batches:
                for k in range(batch.num_rows):
                    c = batch.column("conv_id")[k].as_py()
                    if state is not None and c != conv:
                        yield conv, state.hexdigest()
                        state = None
                    if state is None:
                        conv, state = c, hashlib.sha256()
                    else:
                        state.update(b"\n")
                    state.update(batch.column("text")[k].as_py().encode())
            if state is not None:
                yield conv, state.hexdigest()

        yield from _in_batches(streamed(), hash_arrow)

    ordered = _over_pieces(pieces, texts, schema, arrow).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    hashed = ordered.mapInArrow(freeing(hashes), hash_schema).withColumnRenamed("conv_id", "h")
    there = pieces.turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv", "g")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece", "letters"))), lambda p: p["letters"]), "")
    sums = pieces.audits.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("cost", "illegal", "blank", "duplicate", "truncated")], audit.alias("audit"))
    own = found.large.groupBy("conv").agg(F.count_if("there").alias("n")).select(F.col("conv").alias("o"))
    joined = own.join(sums, F.col("o").eqNullSafe(F.col("conv")), "left").join(there, F.col("o").eqNullSafe(F.col("g")), "left").join(hashed, F.col("o").eqNullSafe(F.col("h")), "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(F.col("o").alias("conv_id"), *[none(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_Summary().repaired_sha256)).alias("repaired_sha256"))
