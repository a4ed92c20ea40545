"""Conversation structure repair (operator 12) by Four-Russians block tables.

A conversation is to read ``(s?(ua)+)?`` in the initials of its roles: system
first if at all, then user and assistant in turn.  Each row is kept (cost 0),
given the role user or assistant (``RERO``) or deleted (``DELETE``); rows of
empty text may be inserted (``INSERT``); a row whose text breaks off costs
``TRUNCATED`` more unless it is deleted; blank and repeated rows must go.  The
cheapest edits win, ties by the least string of their initials (D, I, K, R).

The rows become symbols (role initial x fault), and the dynamic program over
them has four states: nothing yet, after ``s``, after ``u``, after ``a``.  Its
vector of costs to the end takes few values once its least entry is subtracted.

* *Tables.* For every block of ``BLOCK`` symbols and every such vector behind
  the block, the vector before it, the cost it adds, and the state a cheapest
  path that enters in each state leaves it in are computed once.
* *Costs.* A conversation is read from its end, a block a look-up.
* *Tracing.* Each block is expanded backward from the vector behind it into the
  vectors between its rows.  They are true costs to the end, so going forward
  through them by the least letter that loses nothing is right in all ties.

On Spark the damaged rows are range-partitioned by (conversation, turn), so a
conversation of any length is cut into pieces.  A piece that other ranges go on
from acts as a function: for each vector behind it, the vector before it and
where each state leads.  Those functions (a row a piece) are composed along the
conversation; then every range is traced by itself.  Only the texts of
conversations that lie across ranges are sent on: a sha256 is one sequence, so
their pieces stream through one task in order, in short slices.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from bootlens.llm.common import staged

RERO, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLOCK = 4
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)      # the state after one more user or assistant row
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbols: a row that must go, then kinds of initials, each sound or broken off.
KINDS = "sua?"
GONE, SYMBOLS = 0, 1 + 2 * len(KINDS)
#: Costs to the end behind the last row: nothing, or ``ua``, or ``a`` still to be inserted.
END = (0, 2 * INSERT, INSERT, 0)
#: Longest slice (characters) of a repaired text that is sent on.
SLICE = 1 << 14
SEPARATORS = " \t\n\x0b\x0c\r"


# ------------------------------------------------------------ one row


def keep_to(state: int, kind: str) -> int | None:
    """The state after keeping a row of this kind, or None where the pattern forbids it."""
    if kind == "s":
        return SYSTEM if state == START else None
    if kind in "ua" and NEXT[state] == (USER if kind == "u" else ASSISTANT):
        return NEXT[state]
    return None


def moves(symbol: int) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of one row: (letter, cost, next state), by letter."""
    out = []
    for state in range(4):
        own = [("D", DELETE, state)]
        if symbol != GONE:
            kind, broken = KINDS[(symbol - 1) % len(KINDS)], TRUNCATED * (symbol > len(KINDS))
            to = keep_to(state, kind)
            if to is not None:
                own.append(("K", broken, to))
            own.append(("R", RERO + broken, NEXT[state]))
        out.append(own)
    return out


MOVES = [moves(s) for s in range(SYMBOLS)]


def before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end in front of a row, from those behind it; insertions come before the row's own edit."""
    cost = [min(c + after[to] for _, c, to in MOVES[symbol][q]) for q in range(4)]
    for _ in range(3):   # no more than two insertions in a row ever pay
        cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
    return tuple(cost)


def edits(symbol: int, here: tuple[int, ...], after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least string of edits up to and with this row's own on a cheapest path, and the state behind it."""
    out = ""
    while True:
        for letter, cost, to in sorted([*MOVES[symbol][state], ("I", INSERT, NEXT[state])]):
            left = here[to] if letter == "I" else after[to]
            if cost + left == here[state]:
                break
        out, state = out + letter, to
        if letter != "I":
            return out, state


# ------------------------------------------------------------ the tables


@dataclass
class Tables:
    """``vectors``: the normalised cost vectors.  For vector v behind block b (symbols as digits to the
    base ``SYMBOLS``, the first row's the highest): ``to[v, b]`` and ``add[v, b]`` give the vector in
    front (normalised, and what was subtracted), ``end[v, b, q]`` the state that entering in q leads to.
    ``one_*`` are the same for single rows, which a conversation's length leaves over."""

    vectors: list[tuple[int, ...]]
    to: np.ndarray
    add: np.ndarray
    end: np.ndarray
    one_to: np.ndarray
    one_add: np.ndarray
    one_end: np.ndarray


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(v)
    return tuple(x - least for x in v), least


@functools.cache
def tables(block: int = BLOCK) -> Tables:
    vectors, place, steps = [_normal(END)[0]], {_normal(END)[0]: 0}, []
    k = 0
    while k < len(vectors):   # all vectors that any rows can give
        row = []
        for s in range(SYMBOLS):
            v, least = _normal(before(s, vectors[k]))
            if v not in place:
                place[v] = len(vectors)
                vectors.append(v)
            row.append((place[v], least))
        steps.append(row)
        k += 1
    one_to, one_add = (np.array([[x[j] for x in row] for row in steps], dtype=np.int64) for j in (0, 1))
    one_end = np.array([[[edits(s, before(s, v), v, q)[1] for q in range(4)] for s in range(SYMBOLS)] for v in vectors], dtype=np.int64)
    to, add, end = one_to, one_add, one_end
    for _ in range(block - 1):   # one more row in front: the new digit is the highest
        front_to = np.stack([one_to[to, s] for s in range(SYMBOLS)], axis=1)
        front_add = np.stack([add + one_add[to, s] for s in range(SYMBOLS)], axis=1)
        front_end = np.stack([np.take_along_axis(end, one_end[to, s], axis=2) for s in range(SYMBOLS)], axis=1)
        n = len(vectors)
        to, add, end = front_to.reshape(n, -1), front_add.reshape(n, -1), front_end.reshape(n, -1, 4)
    return Tables(vectors, to, add, end, one_to, one_add, one_end)


def _blocks(symbols: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(single rows left over at the front, numbers of the full blocks behind them)."""
    over = len(symbols) % block
    digits = symbols[over:].reshape(-1, block)
    return symbols[:over], digits @ (SYMBOLS ** np.arange(block - 1, -1, -1, dtype=np.int64))


def act(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A piece as a function of the vector behind it: (vector in front, cost added, state behind for each state in front)."""
    t = tables()
    single, full = _blocks(symbols)
    now = np.arange(len(t.vectors))
    add = np.zeros(len(now), dtype=np.int64)
    end = np.tile(np.arange(4), (len(now), 1))
    for to, plus, ends, b in [(t.to, t.add, t.end, b) for b in full[::-1]] + [(t.one_to, t.one_add, t.one_end, s) for s in single[::-1]]:
        end = np.take_along_axis(end, ends[now, b], axis=1)
        add = add + plus[now, b]
        now = to[now, b]
    return now, add, end


_EXPANDED: dict = {}


def _expand(v: int, b: int, length: int) -> list[tuple[list[str], int]]:
    """A block traced for each state in front of it, the vector behind it being ``v``; kept, as there are few."""
    key = (v, b, length)
    if key not in _EXPANDED:
        digits = [b // SYMBOLS ** (length - 1 - i) % SYMBOLS for i in range(length)]
        costs = [tables().vectors[v]]
        for s in reversed(digits):
            costs.append(before(s, costs[-1]))
        costs.reverse()
        out = []
        for state in range(4):
            letters = []
            for i, s in enumerate(digits):
                text, state = edits(s, costs[i], costs[i + 1], state)
                letters.append(text)
            out.append((letters, state))
        _EXPANDED[key] = out
    return _EXPANDED[key]


def trace(symbols: np.ndarray, behind: int = 0, state: int = START) -> tuple[list[str], int, int]:
    """(edits of each row with the insertions in front of it, cost to the end at the front less the least entry of
    the vector behind, state behind the last row)."""
    t = tables()
    single, full = _blocks(symbols)
    vs, cost = [behind], 0
    for b in full[::-1]:
        cost += int(t.add[vs[-1], b])
        vs.append(int(t.to[vs[-1], b]))
    for s in single[::-1]:
        cost += int(t.one_add[vs[-1], s])
        vs.append(int(t.one_to[vs[-1], s]))
    cost += t.vectors[vs[-1]][state]
    vs.pop()
    out: list[str] = []
    for b, length in [(int(s), 1) for s in single] + [(int(b), BLOCK) for b in full]:
        letters, state = _expand(vs.pop(), b, length)[state]
        out += letters
    return out, cost, state


def tail(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (END[state] // INSERT)


def repair(rows: list[tuple[str, str]], letters: list[str], state: int, last: bool) -> tuple[list[str], int]:
    """Repaired ``role:text`` lines of a piece that begins in ``state``, and the state behind it."""
    lines = []
    for (role, text), own in zip(rows, letters):
        for x in own:
            if x == "D":
                continue
            state = NEXT[state] if x in "IR" or not role.startswith("s") else SYSTEM
            lines.append(f"{ROLE[state]}:" if x == "I" else f"{ROLE[state]}:{text}" if x == "R" else f"{role}:{text}")
    if last:
        for _ in tail(state):
            state = NEXT[state]
            lines.append(f"{ROLE[state]}:")
    return lines, state


# ------------------------------------------------------------ on Spark


def shown(c: Column) -> Column:
    """A value as text, null as one space."""
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a row's crc32 names; roles and texts that are null are one space."""
    code = F.crc32(F.concat_ws(":", shown(F.col(conv_id)), shown(F.col(turn))).cast("binary")) % 20
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), shown(F.col(role)).alias("role"), shown(F.col(text)).alias("text"), code.alias("code"))
    hurt = named.where("code <> 0").select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return hurt.drop("copy")


def _symbols(placed: DataFrame) -> DataFrame:
    """(range, at, key, initial, turn, fault, symbol) of the placed rows, texts left behind."""
    body = F.rtrim(F.col("text"), F.lit(SEPARATORS))
    narrow = placed.select("range", "at", "key", "turn", "role_text", F.substring("role", 1, 1).alias("initial"),
                           F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated").alias("own"))
    first = (narrow.where("own IS NULL OR own <> 'blank'").groupBy("key", "role_text").agg(F.min("at").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("key", "role_text", "first"))
    kind = sum((F.when(F.col("initial") == k, i).otherwise(0) for i, k in enumerate(KINDS[:-1])), F.lit(0))
    kind = F.when(F.col("initial").isin(*KINDS[:-1]), kind).otherwise(len(KINDS) - 1)
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("own"))
    return (narrow.join(first, ["key", "role_text"], "left").withColumn("fault", fault)
            .select("range", "at", "key", "initial", "turn", "fault",
                    F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(1 + kind + F.when(F.col("fault") == "truncated", len(KINDS)).otherwise(0)).cast("int").alias("symbol")))


def _pieces(keys: list) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _edge_functions(table: pa.Table) -> pa.Table:
    """The first and the last conversation of a range as functions; only they may go on in other ranges."""
    t = table.select(["range", "at", "key", "initial", "turn", "symbol"]).sort_by("at")
    keys, symbols = t.column("key").to_pylist(), t.column("symbol").to_numpy()
    pieces = _pieces(keys)
    out = []
    for a, b in dict.fromkeys(pieces[:1] + pieces[-1:]):
        to, add, end = act(symbols[a:b].astype(np.int64))
        out.append({"range": t.column("range")[0].as_py(), "key": keys[a], "to": to.tolist(), "end": end.ravel().tolist(),
                    "last_initial": t.column("initial")[b - 1].as_py(), "last_turn": t.column("turn")[b - 1].as_py()})
    return pa.Table.from_pylist(out, schema=_EDGE)


_EDGE = pa.schema([("range", pa.int64()), ("key", pa.string()), ("to", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())),
                   ("last_initial", pa.string()), ("last_turn", pa.int64())])
_EDGE_DDL = "range long, key string, to array<long>, end array<long>, last_initial string, last_turn long"
_PLACE = pa.schema([("range", pa.int64()), ("key", pa.string()), ("behind", pa.int32()), ("state", pa.int32()), ("begins", pa.bool_()), ("ends", pa.bool_()),
                    ("before_initial", pa.string()), ("before_turn", pa.int64())])
_PLACE_DDL = "range long, key string, behind int, state int, begins boolean, ends boolean, before_initial string, before_turn long"


def _along(table: pa.Table) -> pa.Table:
    """A conversation's pieces, one row a range: from the end, the vector behind each; from the start, the state in front of each."""
    rows = table.sort_by("range").to_pylist()
    behind, v = [], 0
    for r in reversed(rows):
        behind.append(v)
        v = r["to"][v]
    behind.reverse()
    out, state = [], START
    for k, (r, v) in enumerate(zip(rows, behind)):
        prev = rows[k - 1] if k else {"last_initial": None, "last_turn": None}
        out.append({"range": r["range"], "key": r["key"], "behind": v, "state": state, "begins": k == 0, "ends": k == len(rows) - 1,
                    "before_initial": prev["last_initial"], "before_turn": prev["last_turn"]})
        state = r["end"][4 * v + state]
    return pa.Table.from_pylist(out, schema=_PLACE)


_PIECE = pa.schema([("range", pa.int64()), ("key", pa.string()), ("begins", pa.bool_()), ("ends", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()),
                    ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                    ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.int64()), ("part", pa.int64()), ("over", pa.bool_()), ("repaired", pa.string()), ("sha", pa.string())])
_PIECE_DDL = ("range long, key string, begins boolean, ends boolean, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, "
              "cost long, audit string, lines long, part long, over boolean, repaired string, sha string")
_MORE = {c: 0 for c in ("turns", "blank", "duplicate", "truncated", "illegal", "cost", "lines")} | {"audit": ""}


def _price(letters: str, n_broken: int) -> int:
    return RERO * letters.count("R") + DELETE * letters.count("D") + INSERT * letters.count("I") + TRUNCATED * n_broken


def _repair_range(faults: pa.Table, texts: pa.Table) -> pa.Table:
    """Every piece of a range: counts, edits, and its repaired text (whole conversations: the digest instead)."""
    f, t = faults.sort_by("at"), texts.sort_by("at")
    cols = {c: f.column(c).to_pylist() for c in f.column_names}
    symbols = f.column("symbol").to_numpy().astype(np.int64)
    roles, bodies = t.column("role"), t.column("text")
    out = []
    for a, b in _pieces(cols["key"]):
        begins, ends = cols["begins"][a], cols["ends"][a]
        own, state = symbols[a:b], cols["state"][a]
        letters, _, _ = trace(own, cols["behind"][a], state)
        rows = list(zip(roles.slice(a, b - a).to_pylist(), bodies.slice(a, b - a).to_pylist()))
        lines, after = repair(rows, letters, state, ends)
        audit = "".join(letters)
        broken = sum(1 for s, x in zip(own, letters) if s > len(KINDS) and x[-1] != "D")
        if ends:
            audit += "I" * (len(lines) - sum(len(x) - x.count("D") for x in letters))
        marks = [cols["before_initial"][a], *cols["initial"][a:b]] if not begins else cols["initial"][a:b]
        turns = [x for x in cols["turn"][a:b] if x is not None]
        joined = "\n".join(lines)
        whole = begins and ends
        parts = [None] if whole else [joined[i:i + SLICE] for i in range(0, len(joined), SLICE)] or [""]
        out.append({"range": cols["range"][a], "key": cols["key"][a], "begins": begins, "ends": ends, "low": min(turns, default=None), "high": max(turns, default=None),
                    "turns": len(set(turns)) - (not begins and bool(turns) and turns[0] == cols["before_turn"][a]),
                    **{name: cols["fault"][a:b].count(name) for name in ("blank", "duplicate", "truncated")},
                    "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(marks, marks[1:])), "cost": _price(audit, broken), "audit": audit, "lines": len(lines),
                    "part": 0, "over": len(parts) == 1, "repaired": parts[0], "sha": hashlib.sha256(joined.encode()).hexdigest() if whole else None})
        out += [{**_MORE, "range": cols["range"][a], "key": cols["key"][a], "begins": begins, "ends": ends, "part": k, "over": k == len(parts) - 1, "repaired": x}
                for k, x in enumerate(parts[1:], 1)]
    return pa.Table.from_pylist(out, schema=_PIECE)


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, conversation by conversation: counts add up, edits and the digest go on; a batch of slices at a time."""
    names = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")
    now: dict | None = None
    for batch in batches:
        for k in range(batch.num_rows):
            r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if now is None:
                now = {"key": r["key"], "low": None, "high": None, **dict.fromkeys(names, 0), "audit": [], "lines": 0, "sha": hashlib.sha256()}
            for c, pick in (("low", min), ("high", max)):
                now[c] = pick((x for x in (now[c], r[c]) if x is not None), default=None)
            for c in names:
                now[c] += r[c]
            now["audit"].append(r["audit"])
            if r["lines"] and now["lines"]:
                now["sha"].update(b"\n")
            now["sha"].update(r["repaired"].encode())
            now["lines"] += r["lines"]
            if r["ends"] and r["over"]:
                yield pa.RecordBatch.from_pylist([{**now, "audit": "".join(now["audit"]), "sha": now["sha"].hexdigest()}], schema=_DONE)
                now = None


_DONE = pa.schema([_PIECE.field(c) for c in ("key", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "lines", "sha")])
_DONE_DDL = "key string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines long, sha string"


def repaired(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text; as they are, no damage is done): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, lines, repaired_sha256.

    Rows go by turn (nulls first), then role, then a hash of the text.  A null conv_id is a conversation of its own; null
    roles and texts are one space."""
    key = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("i"), F.col("conv_id").cast("string")))
    text = rows.select(key.alias("key"), F.col("turn").cast("long").alias("turn"), shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"))
    ordered = (text.withColumn("role_text", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
               .repartitionByRange("key", "turn", "role", "role_text").sortWithinPartitions("key", "turn", "role", "role_text"))
    at = F.monotonically_increasing_id()
    placed = staged(ordered.withColumn("at", at).withColumn("range", F.shiftright("at", 33)), "conversation-rows")
    faults = staged(_symbols(placed), "conversation-faults")
    edges = faults.groupBy("range").applyInArrow(_edge_functions, _EDGE_DDL)
    place = staged(edges.groupBy("key").applyInArrow(_along, _PLACE_DDL), "conversation-edges")
    alone = {"behind": F.lit(0), "state": F.lit(START), "begins": F.lit(True), "ends": F.lit(True)}
    known = faults.join(place, ["range", "key"], "left").withColumns({c: F.coalesce(F.col(c), x) for c, x in alone.items()})
    texts = placed.select(F.col("range").alias("of"), F.col("at"), F.col("role"), F.col("text"))
    pieces = staged(known.groupBy("range").cogroup(texts.groupBy("of")).applyInArrow(_repair_range, _PIECE_DDL), "conversation-pieces")
    whole = pieces.where("begins AND ends").select(*_DONE.names)
    long = (pieces.where("NOT (begins AND ends)").repartition("key").sortWithinPartitions("key", "range", "part")
            .mapInArrow(_join_pieces, _DONE_DDL))
    done = whole.unionByName(long)
    ids = rows.select(F.col("conv_id"), key.alias("key")).distinct()
    return ids.join(done, "key").select(
        "conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal",
        "cost", "audit", "lines", F.col("sha").alias("repaired_sha256"))


def audit(conversations: DataFrame) -> DataFrame:
    """Damage the rows, repair them, and report every original conv_id; those that lose all rows: zeros, no edits, the digest of nothing."""
    fixed = repaired(damage(conversations)).select("*", F.col("conv_id").alias("_id")).drop("conv_id")
    every = conversations.select("conv_id").distinct()
    j = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = F.lit(0).cast("long")
    empty = hashlib.sha256(b"").hexdigest()
    return j.select("conv_id", *[F.coalesce(F.col(c), zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
