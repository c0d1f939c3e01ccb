"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation is right if its roles read, by their initials, ``(s?(ua)+)?``. Each
row is kept (K, 0), gets the role user or assistant (R, 1) or is deleted (D, 2);
rows without text may be inserted (I, 5) anywhere. A blank row (nothing but white
space) and a duplicate (role and text seen earlier) must go, a truncated one (its
last other character is not ``.``, ``!`` or ``?``) costs 5 more if it stays. Of the
cheapest edits those come out whose letters are least in ASCII order.

Four states (nothing yet; after s, u, a) make the cost of all that follows a vector
of four numbers. It is computed from the end on and stored at every sqrt(n)-th row
only; the walk from the front computes the vectors of one block at a time anew and
takes the least letter whose cost fits, a tight edge.

Long conversations work the same way on pieces of bounded size, which the rows'
global order gives. A piece is a 4 x 4 matrix in (min, +): a pass over the matrices
from the end gives the vector behind every piece, a pass over the pieces' walks
from the front the state before it. Both stream small rows and hold one vector or
state; no conversation is ever gathered.

Rows are taken by turn (null first), then role, then SHA-256 of the text. Cases:
null role and text are one space; a null conversation id is a conversation of its
own, and rows with equal turns, or equal altogether, are rows like others. An empty
table gives no rows. Other columns are left behind, whatever they are called. The
input should be a stored table: equal rows are dealt by their place in it.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinara.llm.common import partitions, picked, small_batches, tidy
from affinara.shipping import join_spread, written

PIECE_ROWS = 1 << 14
PIECE_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
NEVER = 1 << 60
WHITE = " \t\n\v\f\r"

# states: 0 nothing yet, 1 after s, 2 after u, 3 after a
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NEXT = (2, 2, 3, 2)  # where the one role that may be inserted or given leads to
GIVEN = ("user", "user", "assistant", "user")
# what a row is: its initial (0 to 3 for s, u, a and others), 4 if it must go, 8 if it is truncated
INITIALS = "sua"
MUST_GO, TRUNCATED, BLANK = 4, 8, 16


def closed(v: tuple) -> tuple:
    """A cost vector with insertions before it allowed."""
    two = min(v[2], INSERT + v[3])
    return (min(v[0], INSERT + two), min(v[1], INSERT + two), two, min(v[3], INSERT + v[2]))


END = closed((0, NEVER, NEVER, 0))


def _edges(code: int):
    """(keep cost, states after keeping, cost of another role) of a row; None for what is not allowed."""
    if code & MUST_GO:
        return None, (None,) * 4, None
    more = UNFINISHED if code & TRUNCATED else 0
    initial = code & 3
    return KEEP + more, AFTER[INITIALS[initial]] if initial < 3 else (None,) * 4, REROLE + more


EDGES = [_edges(code) for code in range(32)]


def before(v: tuple, code: int) -> tuple:
    """The cost vector before a row, from the one behind it."""
    keep, after, rerole = EDGES[code]
    out = []
    for q in range(4):
        best = v[q] + DELETE
        if rerole is not None:
            best = min(best, v[NEXT[q]] + rerole)
            if after[q] is not None:
                best = min(best, v[after[q]] + keep)
        out.append(min(best, NEVER))
    return closed(out)


def checkpoints(codes: bytes, end: tuple) -> tuple[int, list[tuple]]:
    """(stride, vectors before rows 0, stride, 2 stride, ... and behind the last row)."""
    stride = max(1, math.isqrt(len(codes)))
    marks, v = [end], end
    for i in range(len(codes) - 1, -1, -1):
        v = before(v, codes[i])
        if i % stride == 0:
            marks.append(v)
    return stride, marks[::-1]


def walk(codes: bytes, end: tuple, state: int, last: bool, marks=None) -> tuple[str, int]:
    """The least letters among the cheapest edits of these rows from a state on, and the state behind them."""
    stride, marks = marks or checkpoints(codes, end)
    letters = []
    for k, start in enumerate(range(0, len(codes), stride)):
        part = codes[start : start + stride]
        vectors = [marks[k + 1]]
        for code in reversed(part):
            vectors.append(before(vectors[-1], code))
        for code in part:
            here, behind = vectors.pop(), vectors[-1]
            keep, after, rerole = EDGES[code]
            while True:
                cost = here[state]
                if cost == behind[state] + DELETE:
                    letters.append("D")
                    break
                if cost == here[NEXT[state]] + INSERT:
                    letters.append("I")
                    state = NEXT[state]
                    continue
                if after[state] is not None and cost == behind[after[state]] + keep:
                    letters.append("K")
                    state = after[state]
                else:
                    letters.append("R")
                    state = NEXT[state]
                break
    while last and state not in (0, 3):
        letters.append("I")
        state = NEXT[state]
    return "".join(letters), state


def matrix(codes: bytes) -> list[tuple]:
    """Column e: the cost vector before these rows if only state e may follow them."""
    units = [tuple(0 if q == e else NEVER for q in range(4)) for e in range(4)]
    for code in reversed(codes):
        units = [before(v, code) for v in units]
    return units


def row_codes(roles: list[str], texts: list[str], seen: set[bytes]) -> bytes:
    """What each row is, given the digests of role and text seen before these rows."""
    out, seen = bytearray(), set(seen)
    for role, text in zip(roles, texts, strict=True):
        at = INITIALS.find(role[0]) if role else -1
        code, own = at if at >= 0 else 3, digest(role, text)
        body = text.rstrip(WHITE)
        if not body:
            code |= MUST_GO | BLANK
        elif own in seen:
            code |= MUST_GO
        elif body[-1] not in ".!?":
            code |= TRUNCATED
        seen.add(own)
        out.append(code)
    return bytes(out)


def digest(role: str, text: str) -> bytes:
    own = role.encode()
    return hashlib.sha256(len(own).to_bytes(8, "big") + own + text.encode()).digest()


def edited(letters: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """The rows after these edits."""
    new_roles, new_texts, at = [], [], 0
    for letter in letters:
        if letter == "I":
            new_roles.append(GIVEN[state])
            new_texts.append("")
            state = NEXT[state]
            continue
        if letter == "K":
            new_roles.append(roles[at])
            new_texts.append(texts[at])
            state = AFTER[roles[at][0]][state]
        elif letter == "R":
            new_roles.append(GIVEN[state])
            new_texts.append(texts[at])
            state = NEXT[state]
        at += 1
    return new_roles, new_texts


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by a hash of conversation and turn: dropped, emptied, cut of full stops, repeated or given the role user."""
    rows = picked(df, conv_id=conv_id, turn=turn, role=role, text=text)
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    body = F.coalesce("text", space)
    rows = rows.withColumn("kind", kind).where("kind <> 0").withColumn("_place", F.monotonically_increasing_id())
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body).alias("text"),
        "_place",
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )


def pieces(rows: DataFrame) -> DataFrame:
    """Conversations in their order, in pieces of bounded size: (piece, conv_id, turns, roles, texts); ``piece`` ascends."""
    small_batches(rows.sparkSession)
    if "_place" not in rows.columns:
        rows = rows.withColumn("_place", F.monotonically_increasing_id())
    if "_copy" not in rows.columns:
        rows = rows.withColumn("_copy", F.lit(0))
    conv, space = rows.schema["conv_id"].dataType, F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "_place", "_copy")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_text", "_place", "_copy"]
    ordered = rows.withColumn("_text", F.sha2(F.col("text").cast("binary"), 256)).repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    schema = T.StructType(
        [
            T.StructField("piece", T.LongType()),
            T.StructField("conv_id", conv),
            T.StructField("turns", T.ArrayType(rows.schema["turn"].dataType)),
            T.StructField("roles", T.ArrayType(T.StringType())),
            T.StructField("texts", T.ArrayType(T.StringType())),
        ]
    )

    def cut(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held, size, rows_held, whose = [], 0, 0, None

        def done():
            rows = pa.Table.from_batches(held)
            columns = [rows.column(n).combine_chunks() for n in ("turn", "role", "text")]
            edge = pa.array([0, len(rows)], pa.int32())
            lists = [pa.ListArray.from_arrays(edge, c.cast(pa.string()) if i else c) for i, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows.column("conv_id").combine_chunks().slice(0, 1), *lists], schema.names)

        for batch in batches:
            if not len(batch):
                continue
            ids = batch.column("conv_id").to_pylist()
            sizes = [len(t) for t in batch.column("text").to_pylist()]
            start = 0
            for i, own in enumerate(ids):
                if rows_held + i - start and (own != whose or rows_held + i - start >= PIECE_ROWS or size >= PIECE_BYTES):
                    held.append(batch.slice(start, i - start))
                    yield done()
                    number += 1
                    held, size, rows_held, start = [], 0, 0, i
                whose, size = own, size + sizes[i]
            held.append(batch.slice(start))
            rows_held += len(ids) - start
        if rows_held:
            yield done()

    narrow = ordered.select("conv_id", "turn", "role", "text")
    return written(narrow.mapInArrow(tidy(cut), schema), "conversation-pieces")


def _streamed(df: DataFrame, order: Column, step, schema: str) -> DataFrame:
    """All rows of a conversation in order through one task, one at a time: ``step(row, carried, new)`` gives (out, carried)."""

    def run(batches):
        key, carried = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                new = row["key"] != key
                key = row["key"]
                made, carried = step(row, carried, new)
                out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    kind = pa.schema([(n, pa.int64() if t == "long" else pa.int32() if t == "int" else pa.bool_() if t == "boolean" else pa.list_(pa.int64())) for n, t in (f.strip().split(" ") for f in schema.split(","))])
    return df.repartition(partitions(df), "key").sortWithinPartitions("key", order).mapInArrow(tidy(run), schema)


def planned(held: DataFrame, long: DataFrame) -> DataFrame:
    """(piece, codes, behind, state, last) for the pieces of conversations that have several."""
    own = join_spread(held, long, ["key"], "piece").select("key", "piece", "roles", "texts")

    def digests(batches):
        for batch in batches:
            for key, piece, roles, texts in zip(*(batch.column(n).to_pylist() for n in ("key", "piece", "roles", "texts")), strict=True):
                found = list({digest(r, t) for r, t in zip(roles, texts, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found)), pa.array([piece] * len(found), pa.int64()), pa.array(found, pa.binary())], ["key", "piece", "digest"])

    # a piece names each digest once, so a text that fills a conversation is a row for each piece
    named = written(own.mapInArrow(tidy(digests), "key string, piece long, digest binary"), "conversation-digests")
    first = named.groupBy("key", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = join_spread(named, written(first, "first-digests"), ["key", "digest"], "piece").where("piece > first")
    seen = again.groupBy("piece").agg(F.collect_list("digest").alias("seen"))

    def coded(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                codes = row_codes(row["roles"], row["texts"], set(row["seen"] or ()))
                rows.append({"key": row["key"], "piece": row["piece"], "codes": codes, "matrix": [x for v in matrix(codes) for x in v]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("piece", pa.int64()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64()))]))

    codes = written(own.join(seen, "piece", "left").mapInArrow(tidy(coded), "key string, piece long, codes binary, matrix array<long>"), "conversation-codes")

    def back(row, v, new):
        behind, m = END if new else v, row["matrix"]
        out = {"piece": row["piece"], "behind": list(behind), "last": new}
        return out, tuple(min(NEVER, *(m[4 * e + q] + behind[e] for e in range(4))) for q in range(4))

    behind = written(_streamed(codes.select("key", "piece", "matrix"), F.col("piece").desc(), back, "piece long, behind array<long>, last boolean"), "conversation-vectors")

    def walked(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                marks = checkpoints(row["codes"], tuple(row["behind"]))
                ends = [walk(row["codes"], tuple(row["behind"]), q, False, marks)[1] for q in range(4)]
                rows.append({"key": row["key"], "piece": row["piece"], "ends": ends})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("piece", pa.int64()), ("ends", pa.list_(pa.int64()))]))

    both = codes.drop("matrix").join(behind, "piece")
    ends = both.select("key", "piece", "codes", "behind").mapInArrow(tidy(walked), "key string, piece long, ends array<long>")

    def ahead(row, state, new):
        state = 0 if new else state
        return {"piece": row["piece"], "state": state}, row["ends"][state]

    states = _streamed(ends, F.col("piece").asc(), ahead, "piece long, state int")
    return written(both.select("piece", "codes", "behind", "last").join(states, "piece"), "conversation-plan")


REPAIRED = (
    "conv_id {kind}, piece long, turns array<{turn}>, audit string, cost long, blank long, duplicate long, truncated long, illegal long, "
    "initials array<string>, roles array<string>, texts array<string>"
)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired pieces of conversations (conv_id, turn, role, text): those of one piece, and those of several.

    A row holds a piece's turns, its edits (``audit``) and their cost, counts of its
    faults, the initials of its first and last role before, and the repaired roles and texts.
    """
    held = pieces(rows).withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
    long = written(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "long-conversations")
    conv, turn = (held.schema[n].dataType for n in ("conv_id", "turns"))
    schema = REPAIRED.format(kind=conv.simpleString(), turn=turn.elementType.simpleString())

    def fixed(batches):
        for batch in batches:
            ids, turns = batch.column("conv_id"), batch.column("turns")
            out = []
            for row in batch.drop_columns(["conv_id", "turns"]).to_pylist():
                roles, texts, codes = row["roles"], row["texts"], row["codes"]
                if codes is None:  # the whole conversation
                    codes, end, state, last = row_codes(roles, texts, set()), END, 0, True
                else:
                    end, state, last = tuple(row["behind"]), row["state"], row["last"]
                marks = checkpoints(codes, end)
                letters, _ = walk(codes, end, state, last, marks)
                new_roles, new_texts = edited(letters, roles, texts, state)
                stays = sum(1 for x, c in zip((x for x in letters if x != "I"), codes, strict=True) if x != "D" and c & TRUNCATED)
                initials = [r[:1] for r in roles]
                out.append(
                    {
                        "piece": row["piece"],
                        "audit": letters,
                        "cost": DELETE * letters.count("D") + INSERT * letters.count("I") + REROLE * letters.count("R") + UNFINISHED * stays,
                        "blank": sum(1 for c in codes if c & BLANK),
                        "duplicate": sum(1 for c in codes if c & MUST_GO and not c & BLANK),
                        "truncated": sum(1 for c in codes if c & TRUNCATED),
                        "illegal": sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b not in ("su", "ua", "au")),
                        "initials": [initials[0], initials[-1]],
                        "roles": new_roles,
                        "texts": new_texts,
                    }
                )
            if out:
                made = pa.RecordBatch.from_pylist(out, _ARROW)
                yield pa.RecordBatch.from_arrays([ids, made.column(0), turns, *made.columns[1:]], ["conv_id", "piece", "turns", *_ARROW.names[1:]])

    plan = planned(held, long)
    columns = ["piece", "conv_id", "turns", "roles", "texts", "codes", "behind", "last", "state"]
    short = held.join(long, "key", "left_anti")
    for field in ("codes", "behind", "last", "state"):
        short = short.withColumn(field, F.lit(None).cast(plan.schema[field].dataType))
    several = held.join(plan, "piece")
    return short.select(columns).mapInArrow(tidy(fixed), schema), several.select("key", *columns).mapInArrow(tidy(fixed), schema)


_ARROW = pa.schema(
    [
        ("piece", pa.int64()),
        ("audit", pa.string()),
        *((n, pa.int64()) for n in ("cost", "blank", "duplicate", "truncated", "illegal")),
        ("initials", pa.list_(pa.string())),
        ("roles", pa.list_(pa.string())),
        ("texts", pa.list_(pa.string())),
    ]
)
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summed(repaired: DataFrame) -> DataFrame:
    """One row for each conversation, whose pieces come one after the other: counts, audit, SHA-256 of the repaired text."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"

    def run(batches):
        whose, state = None, None

        def done():
            total, turns = state["total"], state["turns"]
            total["gaps"] = 0 if turns is None else turns[1] - turns[0] + 1 - turns[2]
            columns = [state["id"], *(pa.array([total[c]], pa.int64()) for c in COUNTS), pa.array(["".join(state["audit"])]), pa.array([state["hash"].hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            made = []
            for i, row in enumerate(batch.drop_columns(["conv_id"]).to_pylist()):
                own = batch.column("conv_id")[i].as_py()
                if state is None or own != whose:
                    if state is not None:
                        made.append(done())
                    whose = own
                    state = {"id": batch.column("conv_id").slice(i, 1), "total": dict.fromkeys(COUNTS, 0), "turns": None, "audit": [], "hash": hashlib.sha256(), "any": False, "end": None}
                total = state["total"]
                for name in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    total[name] += row[name]
                if state["end"] is not None and state["end"] + row["initials"][0] not in ("su", "ua", "au"):
                    total["illegal"] += 1
                state["end"] = row["initials"][1]
                known = [t for t in row["turns"] if t is not None]
                if known:  # they ascend
                    kinds = len(set(known))
                    if state["turns"] is None:
                        state["turns"] = (known[0], known[-1], kinds)
                    else:
                        low, high, n = state["turns"]
                        state["turns"] = (low, known[-1], n + kinds - (high == known[0]))
                state["audit"].append(row["audit"])
                for r, t in zip(row["roles"], row["texts"], strict=True):
                    state["hash"].update((("\n" if state["any"] else "") + f"{r}:{t}").encode())
                    state["any"] = True
            if made:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
        if state is not None:
            yield done()

    return repaired.mapInArrow(tidy(run), schema)


def summaries(rows: DataFrame, all_ids: DataFrame) -> DataFrame:
    """One row for each conversation id of ``all_ids``; one without rows has zeros, no edits and the hash of an empty text."""
    short, several = repair(rows)
    # a text's SHA-256 is a chain: the pieces of one conversation pass one task, one after the other
    chained = several.repartition(partitions(rows), F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece")
    found = summed(short).unionByName(summed(chained)).withColumnRenamed("conv_id", "_id")
    ids = all_ids.select("conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return joined.select("conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
