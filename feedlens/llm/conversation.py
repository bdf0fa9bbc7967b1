"""Repair of the turn structure of conversations, at least cost.

A conversation is right when its role initials read ``(s?(ua)+)?``: an optional
system turn, then user and assistant in turn, an answer last.  Each turn can be
kept (0), given the role ``user`` or ``assistant`` (2) or deleted (3; the only
choice for blank turns and for repeated ones); a turn with empty text can be
inserted anywhere (2).  A truncated turn that stays costs 1 more.  Of the
cheapest edit scripts the one whose letters (``K R D I``, in order) sort first
is taken.

The search is a dynamic programme over four states (nothing yet, after system,
after user, after assistant).  Rows are repartitioned by conversation and
sorted by turn; each task streams them and carries, per state, the cost and the
rank of its best script across Arrow batches.  The scripts of two states never
are prefixes of each other (each ends with the letter of the same row), so
ranks decide every tie and scripts need not be held.

A row leaves one byte per state to go back by.  When a conversation outgrows a
block (``block_rows`` or ``block_bytes``), its rows and back bytes are written
out and dropped from memory; blocks of such conversations are decided by a
second stream that reads only the back bytes, last block first.  Memory of a
task is one block and one Arrow batch, whatever a conversation's length.

Defined cases.  A null role or text counts as one space.  Rows without a
conversation id are one conversation; rows without a turn come first.  Rows of
one turn go by role, then text (bytewise); equal ones repeat each other.  A
conversation whose rows all go ends as one empty block.  An empty table gives
an empty table.  Other columns are not read.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from feedlens.session import materialize

SPACES = " \t\n\x0b\x0c\r"
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: inserts that lead from one state to another
INSERTS = {(NONE, NONE): 0, (NONE, USER): 1, (NONE, ASSISTANT): 2, (SYSTEM, SYSTEM): 0, (SYSTEM, USER): 1,
           (SYSTEM, ASSISTANT): 2, (USER, USER): 0, (USER, ASSISTANT): 1, (ASSISTANT, ASSISTANT): 0, (ASSISTANT, USER): 1}
#: what one row can add to a script, in the order of scripts
STEPS = sorted(["D"] + ["I" * k + e for k in range(3) for e in "KR"])
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 40


def follow(state: int, role: int) -> bool:
    """Whether a turn of this role may come after the state."""
    return state == NONE if role == SYSTEM else (state != USER) if role == USER else (role == ASSISTANT and state == USER)


def moves(role: int | None, gone: bool, cut: bool) -> list[tuple[int, int, int, int]]:
    """``(state, next state, cost, step)`` of everything that can be done with a row."""
    out = [(p, p, DELETE, STEPS.index("D")) for p in range(4)]      # inserts before a deleted row sort after those behind it
    if not gone:
        for (p, q), k in INSERTS.items():
            if role and follow(q, role):
                out.append((p, role, INSERT * k + TRUNCATED * cut, STEPS.index("I" * k + "K")))
            new = ASSISTANT if q == USER else USER
            out.append((p, new, INSERT * k + REROLE + TRUNCATED * cut, STEPS.index("I" * k + "R")))
    return out


MOVES = {(r, g, c): moves(r, g, c) for r, g, c in product((None, SYSTEM, USER, ASSISTANT), (False, True), (False, True))}


class Search:
    """Cost and rank of the best script of each state, and the way back."""

    def __init__(self):
        self.start, self.known = ((0, FAR, FAR, FAR), (0, 0, 0, 0)), {}

    def step(self, now, kind):
        """``(next, added cost, back bytes)``: costs are kept relative to the
        least, so few states occur and each is worked out once."""
        found = self.known.get((now, kind))
        if found is None:
            cost, rank = now
            best = {}
            for p, q, c, e in MOVES[kind]:
                if cost[p] < FAR:
                    best[q] = min(best.get(q, (FAR,)), (cost[p] + c, rank[p], e, p))
            least = min(b[0] for b in best.values())
            order = {q: i for i, q in enumerate(sorted(best, key=lambda q: best[q][1:3]))}
            new = (tuple(best[q][0] - least if q in best else FAR for q in range(4)), tuple(order.get(q, 0) for q in range(4)))
            back = bytes(best[q][3] * 8 + best[q][2] if q in best else 255 for q in range(4))
            found = self.known[now, kind] = (new, least, back)
        return found

    def end(self, now) -> tuple[int, int, int]:
        """``(cost, state, inserts)`` of the best way to finish."""
        cost, rank = now
        ways = [(cost[p] + INSERT * k, rank[p], p, k) for p, q, k in
                ((NONE, NONE, 0), *((p, ASSISTANT, INSERTS[p, ASSISTANT]) for p in (SYSTEM, USER, ASSISTANT))) if cost[p] < FAR]
        c, _, p, k = min(ways)
        return c, p, k


def go_back(back: bytes, state: int) -> tuple[str, int]:
    """``(script, state before)`` of a block that ends in ``state``."""
    out = []
    for i in range(len(back) - 4, -1, -4):
        b = back[i + state]
        out.append(STEPS[b & 7])
        state = b >> 3
    return "".join(reversed(out)), state


def apply_script(script: str, state: int, roles: list[str], texts: list[str], turns: list[int | None]):
    """The repaired turns of a block: lists of role, text, turn and edit."""
    out, i = [], 0
    for e in script:
        if e == "I":
            role, text, turn = ("assistant" if state == USER else "user"), "", None
        else:
            role, text, turn = roles[i], texts[i], turns[i]
            i += 1
            if e == "R":
                role = "assistant" if state == USER else "user"
        if e != "D":
            out.append((role, text, turn, e))
            state = INITIAL[role[0]]
    return [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]


TOTALS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Conversation:
    """What is carried over the rows of one conversation."""

    def __init__(self, name, start):
        self.name, self.now, self.block = name, start, 0
        self.count = dict.fromkeys(TOTALS, 0)
        self.first = self.last = self.turn = self.initial = None
        self.different = 0
        self.clear()

    def clear(self):
        self.roles, self.texts, self.turns, self.back, self.size = [], [], [], bytearray(), 0

    def add(self, search: Search, turn, role, text, fault):
        c, initial = self.count, role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            c["illegal"] += 1
        self.initial = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.different += turn != self.last
            self.last = turn
        if fault:
            c[fault] += 1
        self.now, more, back = search.step(self.now, (INITIAL.get(initial), fault in ("blank", "duplicate"), fault == "truncated"))
        c["cost"] += more
        self.back += back
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.size += len(text)

    def spilled(self):
        """A block of a conversation that goes on."""
        row = {"name": self.name, "block": self.block, "last": False, "roles": self.roles, "texts": self.texts,
               "turns": self.turns, "back": bytes(self.back)}
        self.block += 1
        self.clear()
        return row

    def closed(self, search: Search):
        """The last block, with the totals; decided if it is the only one."""
        more, state, inserts = search.end(self.now)
        self.count["cost"] += more
        if self.first is not None:
            self.count["gaps"] = self.last - self.first + 1 - self.different
        row = {"name": self.name, "block": self.block, "last": True, "end": state, "inserts": inserts, **self.count}
        if self.block:
            return row | {"roles": self.roles, "texts": self.texts, "turns": self.turns, "back": bytes(self.back)}
        script, _ = go_back(self.back, state)
        script += "I" * inserts
        roles, texts, turns, edits = apply_script(script, NONE, self.roles, self.texts, self.turns)
        return row | {"script": script, "roles": roles, "texts": texts, "turns": turns, "edits": "".join(edits)}


def block_schema(kind: T.DataType) -> T.StructType:
    words = T.ArrayType(T.StringType())
    return T.StructType(
        [T.StructField("name", kind), T.StructField("block", T.LongType()), T.StructField("last", T.BooleanType()),
         T.StructField("script", T.StringType()), T.StructField("edits", T.StringType()),
         T.StructField("roles", words), T.StructField("texts", words), T.StructField("turns", T.ArrayType(T.LongType())),
         T.StructField("back", T.BinaryType()), T.StructField("end", T.IntegerType()), T.StructField("inserts", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in TOTALS])


def gather(rows, schema: pa.Schema, size, most: int = 4 << 20):
    """Record batches of about ``most`` bytes from an iterator of dicts."""
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += 200 + size(r)
        if n >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def faults(conv: DataFrame, name: str, turn: str, role: str, text: str) -> DataFrame:
    """``name, turn, role, text, fault``, a conversation in one partition, by turn."""
    read = conv.select(F.col(name).alias("name"), F.col(turn).cast("long").alias("turn"),
                       F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    bare = F.rtrim("text", F.lit(SPACES))
    # partitioned by conversation first: the window and the stream share one exchange
    again = F.row_number().over(W.Window.partitionBy("name", "role", "text").orderBy("turn")) > 1
    fault = (F.when(bare == "", "blank").when(F.col("again"), "duplicate")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))
    return (read.repartition("name").withColumn("again", again).withColumn("fault", fault)
            .sortWithinPartitions("name", F.col("turn").asc_nulls_first(), "role", "text", "again")
            .select("name", "turn", "role", "text", "fault"))


def search_blocks(conv: DataFrame, name: str, turn: str, role: str, text: str,
                  block_rows: int, block_bytes: int) -> DataFrame:
    """The first stream: blocks, decided where a conversation has only one."""
    schema = block_schema(conv.schema[name].dataType)

    def run(batches):
        search, arrow = Search(), to_arrow(schema)

        def blocks():
            at = None
            for batch in batches:
                for who, when, role, text, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if at is None or who != at.name:
                        if at is not None:
                            yield at.closed(search)
                        at = Conversation(who, search.start)
                    elif len(at.roles) >= block_rows or at.size >= block_bytes:
                        yield at.spilled()
                    at.add(search, when, role, text, fault)
            if at is not None:
                yield at.closed(search)

        yield from gather(blocks(), arrow, lambda r: sum(map(len, r["texts"])) + 40 * len(r["texts"]))

    return faults(conv, name, turn, role, text).mapInArrow(run, schema)


def decide(blocks: DataFrame) -> DataFrame:
    """Scripts of the blocks of long conversations: ``name, block, script, state`` (before the block)."""
    kind = blocks.schema["name"].dataType
    schema = T.StructType([T.StructField("name", kind), T.StructField("block", T.LongType()),
                           T.StructField("script", T.StringType()), T.StructField("state", T.IntegerType())])

    def run(batches):
        arrow = to_arrow(schema)

        def scripts():
            state = None
            for batch in batches:
                for name, block, last, back, end, inserts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    state = end if last else state
                    script, state = go_back(back, state)
                    yield {"name": name, "block": block, "script": script + "I" * (inserts or 0), "state": state}

        yield from gather(scripts(), arrow, lambda r: len(r["script"]))

    return (blocks.select("name", "block", "last", "back", "end", "inserts").repartition("name")
            .sortWithinPartitions("name", F.col("block").desc()).mapInArrow(run, schema))


def repair(conv: DataFrame, name: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = 4096, block_bytes: int = 4 << 20) -> DataFrame:
    """The repaired conversations, one row per block of at most ``block_rows`` turns read.

    ``<name>, block, last``, the block's part of the edit ``script``, and the
    turns that result: ``roles, texts, turns`` (null where inserted) and
    ``edits`` (one letter each).  The last block holds the conversation's
    totals: ``gaps, blank, duplicate, truncated, illegal, cost``."""
    blocks = materialize(search_blocks(conv, name, turn, role, text, block_rows, block_bytes), "conversation-blocks")
    schema = block_schema(blocks.schema["name"].dataType)
    split = blocks.where("script is null")
    scripts = decide(split).withColumnsRenamed({"name": "of", "block": "at", "script": "decided"})
    with_scripts = split.join(scripts, F.col("name").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")

    def run(batches):
        arrow = to_arrow(schema)

        def applied():
            for batch in batches:
                for r in batch.to_pylist():
                    script, state = r.pop("decided"), r.pop("state")
                    roles, texts, turns, edits = apply_script(script, state, r["roles"], r["texts"], r["turns"])
                    yield r | {"script": script, "roles": roles, "texts": texts, "turns": turns, "edits": "".join(edits)}

        yield from gather(applied(), arrow, lambda r: sum(map(len, r["texts"])) + 40 * len(r["texts"]))

    done = blocks.where("script is not null").unionByName(with_scripts.mapInArrow(run, schema))
    return done.select(F.col("name").alias(name), "block", "last", "script", "roles", "texts", "turns", "edits", *TOTALS)


def repaired_turns(blocks: DataFrame, name: str = "conv_id") -> DataFrame:
    """One row per repaired turn: ``<name>, block, place, role, text, turn, edit``."""
    each = F.arrays_zip("roles", "texts", "turns", F.split("edits", "").alias("letters"))
    return (blocks.where(F.size("roles") > 0).select(name, "block", F.posexplode(each).alias("place", "t"))
            .select(name, "block", "place", F.col("t.roles").alias("role"), F.col("t.texts").alias("text"),
                    F.col("t.turns").alias("turn"), F.col("t.letters").alias("edit")))


def transcript_digests(blocks: DataFrame, name: str = "conv_id") -> DataFrame:
    """``<name>``, totals, ``audit`` (the whole script) and ``repaired_sha256`` of
    the lines ``role:text``.  Conversations of one block are hashed in place; the
    others stream by block, one running hash each."""
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    one = F.col("last") & (F.col("block") == 0)
    short = blocks.where(one).select(name, *TOTALS, F.col("script").alias("audit"),
                                     F.sha2(said.cast("binary"), 256).alias("repaired_sha256"))
    schema = short.schema

    def run(batches):
        import hashlib
        arrow = to_arrow(schema)

        def digests():
            h, audit, any_turn = hashlib.sha256(), [], False
            for batch in batches:
                for r in batch.to_pylist():
                    for who, what in zip(r["roles"], r["texts"], strict=True):
                        h.update(("\n" * any_turn + who + ":" + what).encode())
                        any_turn = True
                    audit.append(r["script"])
                    if r["last"]:
                        yield {name: r[name], **{c: r[c] for c in TOTALS}, "audit": "".join(audit), "repaired_sha256": h.hexdigest()}
                        h, audit, any_turn = hashlib.sha256(), [], False

        yield from gather(digests(), arrow, lambda r: len(r["audit"]))

    long = (blocks.where(~one).select(name, "block", "last", "script", "roles", "texts", *TOTALS)
            .repartition(name).sortWithinPartitions(name, "block").mapInArrow(run, schema))
    return short.unionByName(long)
