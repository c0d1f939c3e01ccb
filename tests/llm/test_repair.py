"""Conversation repair against all edits of short conversations, and against itself in pieces."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from affinara.llm import repair

RIGHT = re.compile("(s?(ua)+)?")


def plain(rows):
    """(counts, cost, audit, hash) of rows in order, by the least of all edits: whole strings are compared."""
    roles, texts = [r for r, _ in rows], [t for _, t in rows]
    faults, seen = [], set()
    for role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, kept, inserted):
        """The least (cost, letters) from row i on; ``kept`` holds the initials so far (its last two and whether any)."""
        found = []
        if i == len(rows) and RIGHT.fullmatch(kept):
            found.append((0, ""))
        if inserted < 2:
            for initial in "ua":
                if prefix(kept + initial):
                    cost, letters = best(i, short(kept + initial), inserted + 1)
                    found.append((cost + 5, "I" + letters))
        if i < len(rows):
            cost, letters = best(i + 1, kept, 0)
            found.append((cost + 2, "D" + letters))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for initial, letter, price in ((roles[i][:1], "K", 0), ("u", "R", 1), ("a", "R", 1)):
                    if initial and prefix(kept + initial):
                        cost, letters = best(i + 1, short(kept + initial), 0)
                        found.append((cost + price + more, letter + letters))
        return min(found, default=(10**9, ""))

    cost, letters = best(0, "", 0)
    lines, kept, at = [], "", 0
    for letter in letters:
        give = "assistant" if kept.endswith("u") else "user"
        if letter == "I":
            lines.append(f"{give}:")
        elif letter == "K":
            lines.append(f"{roles[at]}:{texts[at]}")
            give = roles[at]
        elif letter == "R":
            lines.append(f"{give}:{texts[at]}")
        kept += give[0] if letter != "D" else ""
        at += letter != "I"
    assert RIGHT.fullmatch(kept)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def prefix(kept):
    return any(RIGHT.fullmatch(kept + end) for end in ("", "a", "ua"))


def short(kept):
    """A shorter beginning with the same continuations."""
    return kept if len(kept) < 3 else kept[:1].replace("a", "") + ("ua" if kept.endswith("a") else "u") if kept[0] == "s" else ("ua" if kept.endswith("a") else "u")


def damaged(rows):
    """Rows (conv, turn, role, text) after damage, in order, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *plain([(r, t) for _, r, t in own]))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, piece int, key string").repartition(3)
    found = repair.summaries(repair.damaged(df), df).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in found}


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(11)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "under", "sa"]
    texts = ["yes.", "no!", "what?", "cut", "  ", "", None, "a. ", "b.\n", "\x1f", " ", "é"]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(r.randint(1, 9)):
            regular = r.random() < 0.5
            role = ("user", "assistant")[turn % 2] if regular else r.choice(roles)
            rows.append((conv, r.choice([turn, turn, turn, turn + 3, None]), role, f"text {turn}." if regular else r.choice(texts)))
    rows += [(500, 1, "user", "same.")] * 7 + [(501, None, None, None)] * 3
    return rows


@pytest.mark.parametrize("piece_rows", [1, 3, 1 << 14])
def test_same_as_the_least_of_all_edits(spark, conversations, monkeypatch, piece_rows):
    monkeypatch.setattr(repair, "PIECE_ROWS", piece_rows)
    assert got(spark, conversations) == expected(conversations)


@pytest.mark.parametrize("seed", range(30))
def test_walk_is_least_and_pieces_agree(seed):
    r = random.Random(seed)
    rows = [(r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b!", "c", "", f"{i}."])) for i in range(r.randint(0, 12))]
    codes = repair.row_codes([a for a, _ in rows], [b for _, b in rows], set())
    letters, state = repair.walk(codes, repair.END, 0, True)
    assert letters == plain(rows)[-2] and state in (0, 3)
    cut = r.randint(0, len(rows))
    behind = repair.checkpoints(codes[cut:], repair.END)[1][0]
    m = repair.matrix(codes[:cut])
    front = tuple(min(m[e][q] + behind[e] for e in range(4)) for q in range(4))
    assert front == repair.checkpoints(codes, repair.END)[1][0]
    one, middle = repair.walk(codes[:cut], behind, 0, False)
    assert one + repair.walk(codes[cut:], repair.END, middle, True)[0] == letters


def test_only_square_root_many_vectors_are_kept():
    stride, marks = repair.checkpoints(bytes(10_000), repair.END)
    assert stride == 100 and len(marks) == 101


def test_one_conversation_of_most_rows(spark, monkeypatch):
    """Its pieces stay small, and the result is that of one pass."""
    monkeypatch.setattr(repair, "PIECE_ROWS", 64)
    rows = [(7, i, ("user", "assistant")[i % 2 if i % 11 else 0], f"row {i % 300}" + ("." if i % 5 else "")) for i in range(1500)]
    rows += [(i, 0, "user", "hello.") for i in range(100, 140)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    sizes = [len(r["turns"]) for r in repair.pieces(repair.damaged(df)).collect()]
    assert max(sizes) <= 64 and len(sizes) > 20
    found, own = got(spark, rows), damaged(rows)[7]
    codes = repair.row_codes([r for _, r, _ in own], [t for _, _, t in own], set())
    assert found[7][6] == repair.walk(codes, repair.END, 0, True)[0]
    assert found[7][5] == repair.checkpoints(codes, repair.END)[1][0][0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summaries(repair.damaged(df), df).collect() == []


def test_sql_says_the_same(conversations):
    import duckdb

    from affinara.llm import queries

    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", conversations)
    found = con.sql(queries.SQL["op13_repair"]).fetchall()
    assert {r[0]: r[1:] for r in found} == expected(conversations)
