"""Conversation structure repair by a run-length dynamic programme.

A row of a conversation is a symbol: its role's initial (s, u, a or other) and its first
fault (blank, duplicate of an earlier row's role and text, truncated).  Keep, Rerole, Delete
and Insert turn the role initials into ``(s?(ua)+)?`` at least cost.  Four states (nothing
yet, after s, u, a) fix the role that Rerole and Insert give, so a symbol is a 4 x 4 min-plus
matrix.  Equal consecutive symbols are one run; cost vectors go backwards over a run through
the cached powers M, M^2, M^4, ..., and the audit is unrolled forwards, taking the least
initial (D < I < K < R) among the steps of least cost.

On Spark: rows that agree in all columns are counted before the shuffle; earlier copies are
found by an aggregate and a join, not by a group's rows in one task; the symbols of a sorted
table become run pieces, so a long conversation spreads over many tasks, and only its runs
meet.  The audit, one cell of the result, then travels ahead of the conversation's rows,
which stream by in order and are edited one at a time; no task holds a conversation's texts.
What one task must pass is the text that one digest covers.

Defined results: a null role or text reads as one space, a null turn sorts first and counts
no gap, null conv_ids are one conversation; rows of one turn go by role, then by the text's
first 64 characters, then by its digest; an empty role is no legal one; a repeated row is a duplicate of itself; a text of
any length is a row like others; a conversation without rows has zeros, an empty audit and
the empty digest; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import materialize, python_ready, table

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
BLANKS = " \t\n\x0b\f\r"
#: Roles and faults of a symbol (code = 4 * role + fault).
ROLES, OTHER = "sua", 3
FINE, BLANK, DUPLICATE, CUT = range(4)
#: Last state: nothing, s, u, a; the state and role that an added or changed row leads to.
NEXT, NEEDED = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
ACCEPTED = (0, 3)
FAR = 1 << 40
HEAD, CHUNK, PIECE = 64, 512, 1 << 16

Vector = tuple[int, int, int, int]


def _inserted() -> list[list[int]]:
    """Cost of the inserts that lead from a state to another."""
    cost = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for p in range(4):
        q, paid = NEXT[p], INSERT
        while paid < cost[p][q]:
            cost[p][q] = paid
            q, paid = NEXT[q], paid + INSERT
    return cost


def _times(a, b) -> list[list[int]]:
    return [[min(a[p][x] + b[x][q] for x in range(4)) for q in range(4)] for p in range(4)]


def _apply(m, v: Vector) -> Vector:
    return tuple(min(m[p][q] + v[q] for q in range(4)) for p in range(4))


@lru_cache(maxsize=None)
def steps(symbol: int) -> tuple:
    """Per state the edits of a row: (initial, cost, state after)."""
    role, fault = divmod(symbol, 4)
    extra = TRUNCATED if fault == CUT else 0
    out = []
    for p in range(4):
        found = [("D", DELETE, p)]
        if fault in (FINE, CUT):
            if (p, role) in KEPT:
                found.append(("K", extra, KEPT[p, role]))
            found.append(("R", REROLE + extra, NEXT[p]))
        out.append(tuple(found))
    return tuple(out)


@lru_cache(maxsize=None)
def power(symbol: int, k: int):
    """The min-plus transition of ``2 ** k`` equal rows, inserts before each included."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    own = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        for _, cost, q in steps(symbol)[p]:
            own[p][q] = min(own[p][q], cost)
    return _times(_inserted(), own)


def end() -> Vector:
    """Cost still due in each state when no row is left."""
    return tuple(min(_inserted()[p][q] for q in ACCEPTED) for p in range(4))


def before(symbol: int, length: int, v: Vector) -> Vector:
    """Cost still due before a run, from the cost due after it."""
    k = 0
    while length >> k:
        if length >> k & 1:
            v = _apply(power(symbol, k), v)
        k += 1
    return v


@lru_cache(maxsize=1 << 16)
def _edit(symbol: int, v: Vector, state: int) -> tuple[str, int]:
    """The inserts and the edit of the next row, given the cost due after it less a constant."""
    due, text = before(symbol, 1, v), ""
    while True:
        for initial, cost, q in sorted([*steps(symbol)[state], ("I", INSERT, NEXT[state])]):
            if cost + (due if initial == "I" else v)[q] == due[state]:
                text, state = text + initial, q
                break
        if text[-1] != "I":
            return text, state


def audit(runs: list[tuple[int, int]]) -> tuple[int, Iterator[str]]:
    """(least cost, the edits' initials in pieces) of a conversation's runs (symbol, length)."""
    after = [end()]
    for symbol, length in reversed(runs):
        after.append(before(symbol, length, after[-1]))
    after.reverse()

    def unroll():
        state = 0
        for (symbol, length), last in zip(runs, after[1:], strict=True):
            done = 0
            while done < length:
                n = min(CHUNK, length - done)
                due = [before(symbol, length - done - n, last)]
                for _ in range(n - 1):
                    due.append(before(symbol, 1, due[-1]))
                text = []
                for v in reversed(due):
                    least = min(v)
                    piece, state = _edit(symbol, tuple(x - least for x in v), state)
                    text.append(piece)
                yield "".join(text)
                done += n
        while state not in ACCEPTED:
            yield "I"
            state = NEXT[state]

    return after[0][0], unroll()


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped (no copies), emptied, stripped of
    ``[.!?]``, repeated or given to the user, each with a twentieth of the keys."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("hit"))
    text = (F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1).alias("copies"))


ORDER = ["turn", "role", "head", "digest"]


def prepare(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies with nulls read as spaces, and the order's columns."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), copies.alias("copies")).withColumns(
        {"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.sha2("text", 256))})


def _pieces(batches):
    """Runs of a sorted table: (conv_id, part, piece, symbols, lengths), a row per conversation
    and ``PIECE`` runs."""
    conv, part, seq, symbols, lengths = None, None, 0, [], []

    def close():
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array([seq], pa.int64()),
             pa.array([symbols], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int64()))],
            names=["conv_id", "part", "piece", "symbols", "lengths"])

    for b in batches:
        kind, out = b.schema.field(0).type, []
        for key, p, first, more, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part is None or key != conv or len(symbols) >= PIECE:
                if part is not None:
                    out.append(close())
                conv, part, symbols, lengths, seq = key, p, [], [], seq + 1
            for symbol, length in ((first, min(n, 1)), (more, n - 1)):
                if length > 0:
                    if symbols and symbols[-1] == symbol:
                        lengths[-1] += length
                    else:
                        symbols.append(symbol)
                        lengths.append(length)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if part is not None:
        yield close()


def _audits(batches):
    for b in batches:
        rows = []
        for pieces in b.column(1).to_pylist():
            runs: list[tuple[int, int]] = []
            count, illegal = [0] * 4, 0
            for p in pieces:
                for symbol, length in zip(p["symbols"], p["lengths"], strict=True):
                    if runs:
                        illegal += (runs[-1][0] // 4, symbol // 4) not in {(0, 1), (1, 2), (2, 1)}
                    illegal += length - 1
                    count[symbol % 4] += length
                    if runs and runs[-1][0] == symbol:
                        runs[-1] = (symbol, runs[-1][1] + length)
                    else:
                        runs.append((symbol, length))
            cost, text = audit(runs)
            rows.append((count[BLANK], count[DUPLICATE], count[CUT], illegal, cost, "".join(text)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string())],
            names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation of
    ``rows`` (conv_id, turn, role, text; copies where the column exists)."""
    python_ready(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    kept = F.rtrim("text", F.lit(BLANKS))
    units = materialize(
        prepare(rows).withColumn("blank", kept == "").withColumn("cut", ~F.right(kept, F.lit(1)).isin(".", "!", "?"))
        .groupBy("conv_id", *ORDER).agg(F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.sum("copies").alias("n")),
        "conversation-units")
    first = units.where("n > 0").groupBy("conv_id", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("f_null"), F.min("turn").alias("f_turn")).select(
        F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "f_null", "f_turn")
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    is_first = F.col("turn").eqNullSafe(F.when(~F.col("f_null"), F.col("f_turn")))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER) * 4
    coded = units.join(first, same, "left").select(
        "conv_id", *ORDER, "n",
        (role + F.when(F.col("blank"), BLANK).when(~is_first, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)).alias("symbol"),
        (role + F.when(F.col("blank"), BLANK).otherwise(DUPLICATE)).alias("again"))
    line = coded.orderBy("conv_id", *ORDER).select("conv_id", F.spark_partition_id().alias("part"), "symbol", "again", "n")
    pieces = line.mapInArrow(_pieces, f"conv_id {kind}, part int, piece long, symbols array<int>, lengths array<long>")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "symbols", "lengths"))).alias("pieces"))
    found = whole.mapInArrow(_audits, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    gaps = units.where("n > 0").groupBy(F.col("conv_id").alias("g_conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    joined = found.join(gaps, F.col("conv_id").eqNullSafe(F.col("g_conv")), "left")
    return materialize(joined.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate",
                                     "truncated", "illegal", "cost", "audit"), "conversation-audits")


def _edited(batches) -> Iterator[tuple]:
    """The repaired rows (conv_id, edit, turn, role, text) of a sorted stream in which each
    conversation's audit comes first; ends a conversation with (conv_id, None, ...)."""
    conv, edits, at, state, open_ = None, "", 0, 0, False

    def inserts():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            yield conv, "I", None, NEEDED[state], ""
            at, state = at + 1, NEXT[state]

    for b in batches:
        for key, is_row, turn, role, text, copies in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
            if not is_row:
                if open_:
                    yield from inserts()
                    yield conv, None, None, None, None
                conv, edits, at, state, open_ = key, text, 0, 0, True
                continue
            for _ in range(copies):
                yield from inserts()
                edit, at = edits[at], at + 1
                if edit == "K":
                    yield conv, edit, turn, role, text
                    state = KEPT[state, ROLES.index(role[0])]
                elif edit == "R":
                    yield conv, edit, turn, NEEDED[state], text
                    state = NEXT[state]
    if open_:
        yield from inserts()
        yield conv, None, None, None, None


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit followed by its rows in order."""
    rows = prepare(rows).where("copies > 0").select("conv_id", F.lit(1).alias("is_row"), "turn", "role", "text", "copies", "head", "digest")
    heads = found.select("conv_id", F.lit(0).alias("is_row"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("head"),
                         F.lit(None).cast("binary").alias("digest"))
    line = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER)
    return line.select("conv_id", "is_row", "turn", "role", "text", "copies")


def _rows(batches):
    out, size, conv, position = [], 0, object(), 0
    kind = None

    def batch():
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()),
             pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())],
            names=["conv_id", "position", "edit", "turn", "role", "text"])

    def typed():
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    for key, edit, turn, role, text in _edited(typed()):
        if edit is None:
            position = 0
            continue
        out.append((key, position, edit, turn, role, text))
        position, size = position + 1, size + len(text)
        if size > 8 << 20 or len(out) >= 4096:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def repair(rows: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, position from 0, edit, turn, role, text)."""
    python_ready(rows)
    found = audits(rows) if found is None else found
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, found).mapInArrow(_rows, f"conv_id {kind}, position long, edit string, turn long, role string, text string")


def _digests(batches):
    kind, keys, out = None, [], []

    def typed():
        nonlocal kind
        for b in batches:
            kind = b.schema.field(0).type
            yield b

    digest, first = hashlib.sha256(), True
    for key, edit, _, role, text in _edited(typed()):
        if edit is None:
            keys.append(key)
            out.append(digest.hexdigest())
            digest, first = hashlib.sha256(), True
            if len(keys) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out)], names=["d_conv", "repaired_sha256"])
                keys, out = [], []
            continue
        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(out)], names=["d_conv", "repaired_sha256"])


def report(rows: DataFrame) -> DataFrame:
    """``audits`` with ``repaired_sha256``: the digest of the repaired rows ``role:text``."""
    found = audits(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    digests = _in_order(rows, found).mapInArrow(_digests, f"d_conv {kind}, repaired_sha256 string")
    return found.join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left").drop("d_conv")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """DuckDB SQL: the same edits by one recursion over single rows, last to first, which
    carries the cheapest (cost, audit, repaired rows) of each state."""
    far = "{'c': 100000000, 'a': '', 'r': []::varchar[]}"

    def step(e: str, cost: str, initial: str, row: str | None) -> str:
        more = f"list_concat([{row}], {e}.r)" if row else f"{e}.r"
        return f"{{'c': {e}.c + {cost}, 'a': '{initial}' || {e}.a, 'r': {more}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def row(p: int, after: int, initials: dict[str, int]) -> str:
        keep = " ".join(f"when o.initial = '{i}' then {step(f'e{q}', 'o.extra', 'K', 'o.line')}" for i, q in initials.items())
        return least(step(f"e{p}", "3", "D", None),
                     f"case when o.must_go then {far} else {step(f'e{after}', '2 + o.extra', 'R', f'{chr(39)}{NEEDED[p]}:{chr(39)} || o.text')} end",
                     f"case when o.must_go then {far} {keep} else {far} end") + f" as b{p}"

    user, answer = "'user:'", "'assistant:'"
    return f"""
with recursive bits(crc_of) as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, b: xor(c >> 1, (c & 1) * 3988292384), i))),
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    hex(encode(concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' ')))) as h
  from conversations),
hits as (
  select * exclude (h), xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint),
      lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 as hit
  from given, bits),
damaged as (
  select conv_id, turn, case hit when 4 then 'user' else role end as role,
    case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case hit when 0 then 0 when 3 then 2 else 1 end))
  from hits),
placed as (
  select conv_id, turn, role, text, row_number() over (
      partition by conv_id order by turn nulls first, role, substr(text, 1, 64), sha256(text)) as i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as kept
  from damaged),
faults as (
  select conv_id, turn, role, text, i, role[1] as initial, kept = '' as blank,
    kept <> '' and row_number() over (partition by conv_id, role, text order by i) > 1 as duplicate,
    kept <> '' and right(kept, 1) not in ('.', '!', '?') as open_end,
    lag(role[1]) over (partition by conv_id order by i) || role[1] as pair
  from placed),
lines as (
  select *, blank or duplicate as must_go, open_end and not duplicate as truncated,
    case when open_end and not duplicate then 1 else 0 end as extra, role || ':' || text as line
  from faults),
facts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from lines group by conv_id),
walk as (
  select conv_id, n as i, {{'c': 0, 'a': '', 'r': []::varchar[]}} as e0, {{'c': 4, 'a': 'II', 'r': [{user}, {answer}]}} as e1,
    {{'c': 2, 'a': 'I', 'r': [{answer}]}} as e2, {{'c': 0, 'a': '', 'r': []::varchar[]}} as e3
  from facts
  union all
  select conv_id, i, {least('b0', step('e2', '2', 'I', user))}, {least('b1', step('e2', '2', 'I', user))}, e2, e3
  from (
    select conv_id, i, b0, b1, {least('b2', step('b3', '2', 'I', answer))} as e2, {least('b3', step('b2', '2', 'I', user))} as e3
    from (
      select w.conv_id, w.i - 1 as i, {row(0, 2, {'s': 1, 'u': 2})}, {row(1, 2, {'u': 2})}, {row(2, 3, {'a': 3})}, {row(3, 2, {'u': 2})}
      from walk w join lines o on o.conv_id is not distinct from w.conv_id and o.i = w.i))),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(e0.c, 0)::bigint as cost,
  coalesce(e0.a, '') as audit, sha256(coalesce(array_to_string(e0.r, chr(10)), '')) as repaired_sha256
from ids left join facts on facts.conv_id is not distinct from ids.conv_id
left join walk on walk.conv_id is not distinct from ids.conv_id and walk.i = 0"""


SQL = _sql()
