"""Conversation structure repair by a scan of min-plus matrices.

A conversation is well formed when the initials of its turns' roles spell ``(s?(ua)+)?``. Four states
tell how far a prefix has come: nothing yet, a system turn, a user turn, an assistant turn. A turn is a
4x4 matrix whose entries are the cheapest (cost, audit) that lead from one state to another over it,
insertions before and behind it included; the audit is the string of the edits' initials. Matrices are
multiplied with "add costs and join audits" for times and "least cost, then least audit" for plus.
That is associative, as audits of equal cost that lead over the same turns never are prefixes of each
other (what the longer one has more would be insertions, which cost).

Turns are dealt to ranges of (conversation, turn), cut into blocks of at most ``TURNS`` turns, and a tree of
products over blocks, ``FAN`` at a time, gives each conversation's cheapest audit; every product keeps
the states between its factors, so that on the way back each block learns the states it lies between,
and with them its own part of the audit. However long a conversation is, a task holds one block, or
``FAN`` matrices, at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepkit.llm.staging import discard, materialize

#: Turns and characters of a block, from which a new one begins; factors of a product.
TURNS, CHARACTERS, FAN = 256, 1_000_000, 16
#: Costs: a new role, a deletion, an insertion, a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, system, user, assistant; where a role's initial leads; states to end in.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
#: White space of the blank and truncated rules.
SPACE = " \t\n\x0b\x0c\r"
#: Bits of a place: a block in its partition, a turn in its block.
BLOCK_BITS, TURN_BITS = 33, 10

Matrix = tuple  # 16 entries, rows first: (cost, audit, states between the factors) or None


# ---- matrices

def _product(factors: list[Matrix]) -> Matrix:
    """The product of matrices; each entry's third part: the states before, between and behind the factors."""
    out: list = [None] * 16
    for i in range(4):
        best = {i: (0, "", str(i))}
        for m in factors:
            grown: dict = {}
            for k, (cost, audit, path) in best.items():
                for j in range(4):
                    entry = m[4 * k + j]
                    if entry is None:
                        continue
                    made = (cost + entry[0], audit + entry[1], path + str(j))
                    if j not in grown or made[:2] < grown[j][:2]:
                        grown[j] = made
            best = grown
        for j, made in best.items():
            out[4 * i + j] = made
    return tuple(out)


def _edit(step: dict[int, int], cost: int, name: str) -> Matrix:
    return tuple((cost, name, "") if step.get(i) == j else None for i in range(4) for j in range(4))


def _least(*options: Matrix) -> Matrix:
    return tuple(min((e for e in entries if e is not None), key=lambda e: e[:2], default=None) for entries in zip(*options, strict=True))


_STAY = _edit({i: i for i in range(4)}, 0, "")
_INSERTED = _least(_edit(STEPS["u"], INSERT, "I"), _edit(STEPS["a"], INSERT, "I"))


@lru_cache(None)
def closure() -> Matrix:
    """Any number of insertions: powers of "one or none" until they settle."""
    made = _least(_STAY, _INSERTED)
    while True:
        grown = _least(made, _product([made, made]))
        if [e and e[:2] for e in grown] == [e and e[:2] for e in made]:
            return made
        made = grown


@lru_cache(None)
def turn_matrix(kind: str) -> Matrix:
    """A turn by its kind: ``x`` must go; else its role's initial (``o`` for any but s, u and a), in capitals if
    it is truncated."""
    edits = [_edit({i: i for i in range(4)}, DELETE, "D")]
    if kind != "x":
        extra = CUT if kind.isupper() else 0
        edits.append(_edit(STEPS.get(kind.lower(), {}), extra, "K"))
        edits += [_edit(STEPS[r], REROLE + extra, "R") for r in "ua"]
    return _product([closure(), _least(*edits), closure()])


@lru_cache(1 << 16)
def _few(kinds: str) -> Matrix:
    return turn_matrix(kinds) if len(kinds) == 1 else _product([_few(kinds[: len(kinds) // 2]), _few(kinds[len(kinds) // 2 :])])


def block_matrix(kinds: str) -> Matrix:
    """The product over a block's turns: runs of eight, which recur and are remembered, then pairs."""
    level = [_few(kinds[i : i + 8]) for i in range(0, len(kinds), 8)]
    while len(level) > 1:
        level = [_product(level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else _STAY


def _added(state: int) -> tuple[str, int]:
    """The role that may follow a state, and the state it leads to."""
    return ("assistant", 3) if state == 2 else ("user", 2)


def apply_audit(state: int, audit: str, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that a block's part of an audit leaves."""
    out, at = [], 0
    for edit in audit:
        if edit in "RI":
            role, state = _added(state)
            out.append((edit, role, texts[at] if edit == "R" else ""))
        elif edit == "K":
            out.append((edit, roles[at], texts[at]))
            state = STEPS[roles[at][:1]][state]
        at += edit != "I"
    return out


# ---- turns to blocks

def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies`` after the damage that crc32("conv_id:turn") % 20 orders: 0 drops
    the row, 1 empties its text, 2 takes its sentence marks, 3 doubles it, 4 makes it the user's. Nulls are
    one space, but in conv_id and turn only for this key."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(key.cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.filter("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _combined(rows: DataFrame) -> DataFrame:
    """Equal rows of a batch as one with their number, so that rows that repeat without end don't travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.Table.from_batches([batch]).group_by(["conv_id", "turn", "role", "text"]).aggregate([("copies", "sum")])
            yield from made.rename_columns({"copies_sum": "copies"}).select(batch.schema.names).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


BLOCK = "bid long, run long, conv_id long, kinds string, roles array<string>, texts array<string>, digests array<binary>, blank long, duplicate long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long"


class _Block:
    def __init__(self, bid: int, run: int, conv_id: int | None):
        self.bid, self.run, self.conv_id = bid, run, conv_id
        self.kinds, self.roles, self.texts, self.digests = [], [], [], []
        self.blank = self.duplicate = self.illegal = self.turns = self.size = 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.seen: set[bytes] = set()

    def add(self, turn: int | None, role: str, text: str, digest: bytes, copy: bool) -> None:
        initial, bare = role[:1], text.rstrip(SPACE)
        kind = "x"
        if not bare:
            self.blank += 1
        elif copy or digest in self.seen:
            self.duplicate += 1
        else:
            kind = initial if initial in STEPS else "o"
            kind = kind if bare[-1] in ".!?" else kind.upper()
            self.seen.add(digest)
        self.kinds.append(kind)
        self.digests.append(digest if kind != "x" else None)
        self.roles.append(role)
        self.texts.append(text if kind != "x" else "")
        self.size += len(role) + len(self.texts[-1])
        self.illegal += len(self.roles) > 1 and self.last_role + initial not in ("su", "ua", "au")
        self.first_role = initial if self.first_role is None else self.first_role
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    @property
    def full(self) -> bool:
        return len(self.kinds) >= TURNS or self.size >= CHARACTERS

    def row(self) -> dict:
        return {k: getattr(self, k) for k in ("bid", "run", "conv_id", "roles", "texts", "digests", "blank", "duplicate", "illegal", "first_role", "last_role", "first_turn", "last_turn", "turns")} | {"kinds": "".join(self.kinds)}


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of conversations in order (``BLOCK``). Turns come by turn, nulls first, then by role and text.

    ``bid`` is partition << 33 | block in it; ``run``: the conversation's first block in its partition.
    ``kinds`` has a letter a turn (see ``turn_matrix``), with turns that occurred earlier in the block as ``x``.
    """
    schema = _arrow(BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << BLOCK_BITS
        block, held, size, number = None, [], 0, 0
        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                for copy in range(copies):
                    if block is None or block.full or block.conv_id != conv_id:
                        same = block is not None and block.conv_id == conv_id
                        if block is not None:
                            held.append(block.row())
                            size += block.size + 64 * len(block.kinds)
                        if size > 4 * CHARACTERS:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                        block = _Block(base | number, block.run if same else number, conv_id)
                        number += 1
                    block.add(turn, role, text, digest, copy > 0)
        if block is not None:
            yield pa.RecordBatch.from_pylist([*held, block.row()], schema)

    start = F.substring("text", 1, 64)  # long texts needn't be compared, or sampled, to deal the rows
    dealt = rows.repartitionByRange("conv_id", "turn", "role", start).sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, BLOCK)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.rsplit(" ", 1) for f in schema.split(", "))])


def _ranks(blocks: DataFrame) -> tuple[dict[int, int], int]:
    """For partitions that begin within a conversation: how many of its blocks lie before them; and the largest
    place of a block in its conversation. The driver gets one row a partition."""
    seq = F.col("bid").bitwiseAND((1 << BLOCK_BITS) - 1)
    part = F.shiftright("bid", BLOCK_BITS).alias("part")
    firsts = F.min(F.when(F.col("run") > 0, F.col("run")))
    found = blocks.select(part, seq.alias("seq"), "run", "conv_id").groupBy("part").agg(
        F.count("*").alias("n"), F.min_by("conv_id", "seq").alias("first"), F.max_by("conv_id", "seq").alias("last"), firsts.alias("second"), F.max("run").alias("tail"), F.max(F.col("seq") - F.col("run")).alias("longest"))
    carry, most, conv_id, count = {}, 0, None, 0
    for r in found.orderBy("part").collect():
        before = count if count and r["first"] == conv_id else 0
        if before:
            carry[r["part"]] = before
        most = max(most, r["longest"], before + (r["second"] or r["n"]) - 1)
        conv_id, count = r["last"], r["n"] - r["tail"] + (before if r["tail"] == 0 else 0)
    return carry, most


# ---- the tree

NODE = "conv_id long, place long, costs array<long>, audits array<string>, paths array<string>, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _stored(m: Matrix) -> dict:
    return {"costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m], "paths": [e and e[2] for e in m]}


def _matrix(row: dict) -> Matrix:
    return tuple(None if c is None else (c, a, "") for c, a in zip(row["costs"], row["audits"], strict=True))


def leaves_of(blocks: DataFrame, carry: dict[int, int]) -> DataFrame:
    """A node (``NODE``) a block, with ``bid``: turns whose role and text occurred in an earlier block become
    ``x``. First occurrences are found by an aggregate over digests, and go back to their blocks as lists of
    places, so that a text that is said without end is no task's own."""
    place = F.col("bid") * (1 << TURN_BITS) + F.col("pos")
    seen = blocks.select("conv_id", "bid", F.posexplode("digests").alias("pos", "digest")).filter("digest IS NOT NULL")
    firsts = seen.groupBy("conv_id", "digest").agg(F.min(place).alias("place"))
    firsts = firsts.groupBy(F.shiftright("place", TURN_BITS).alias("bid")).agg(F.collect_list(F.col("place").bitwiseAND((1 << TURN_BITS) - 1)).alias("firsts"))
    columns = [c for c in ("bid", "run", "conv_id", "kinds", *_COUNTS, "first_role", "last_role", "first_turn", "last_turn") if c != "truncated"]
    schema = _arrow(f"bid long, {NODE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                firsts, run = set(row.pop("firsts") or ()), row.pop("run")
                old = row.pop("kinds")
                kinds = "".join(k if i in firsts else "x" for i, k in enumerate(old))
                row["duplicate"] += kinds.count("x") - old.count("x")
                part, seq = row["bid"] >> BLOCK_BITS, row["bid"] & ((1 << BLOCK_BITS) - 1)
                row["place"] = seq - run + (carry.get(part, 0) if run == 0 else 0)
                out.append(row | {"truncated": sum(map(str.isupper, kinds))} | _stored(block_matrix(kinds)))
            yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.select(*columns).join(firsts, "bid", "left").mapInArrow(run, f"bid long, {NODE}")


def _joined(rows: list[dict]) -> dict:
    """One node of nodes that follow each other."""
    out = {k: rows[0][k] for k in ("conv_id", "first_role")} | {"place": rows[0]["place"] // FAN, "last_role": rows[-1]["last_role"]}
    out |= {k: sum(r[k] for r in rows) for k in _COUNTS}
    out["illegal"] += sum(a["last_role"] + b["first_role"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    timed = [r for r in rows if r["turns"]]
    out["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    out["first_turn"], out["last_turn"] = (timed[0]["first_turn"], timed[-1]["last_turn"]) if timed else (None, None)
    return out | _stored(_product([_matrix(r) for r in rows]))


def parents_of(nodes: DataFrame) -> DataFrame:
    """A node for every ``FAN`` consecutive ones of a conversation."""
    schema = _arrow(NODE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if group and (row["conv_id"], row["place"] // FAN) != (group[0]["conv_id"], group[0]["place"] // FAN):
                    out.append(_joined(group))
                    group = []
                group.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)
        if group:
            yield pa.RecordBatch.from_pylist([_joined(group)], schema)

    dealt = nodes.repartition("conv_id", F.expr(f"place div {FAN}")).sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, NODE)


def _entry(column: str, i: Column, j: Column) -> Column:
    return F.element_at(column, (i * 4 + j + 1).cast("int"))


def _ended(roots: DataFrame) -> DataFrame:
    """Roots with the state they end in (``i`` is 0), cost and audit: the least over the states to end in."""
    options = F.array(*(F.struct(F.col("costs")[e].alias("cost"), F.col("audits")[e].alias("audit"), F.lit(e).alias("j")) for e in ENDS))
    best = F.array_min(F.filter(options, lambda o: o["cost"].isNotNull()))
    return roots.withColumn("best", best).select("*", F.lit(0).alias("i"), F.col("best.j").alias("j"), F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")).drop("best")


class Repair:
    """The repair of a table's conversations after ``damaged``.

    ``summary()``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of conversations that have
    turns; ``blocks(by)``: their repaired turns by blocks. ``close()`` deletes what was staged.
    """

    def __init__(self, rows: DataFrame):
        self.staged = [materialize(blocks_of(_combined(rows)), "turns")]
        self.turns = self.staged[0]
        carry, most = _ranks(self.turns)
        levels = [self._keep(leaves_of(self.turns, carry), "leaves")]
        while most > 0:
            levels.append(self._keep(parents_of(levels[-1].drop("bid")), "nodes"))
            most //= FAN
        self.roots = _ended(levels[-1])
        states = self.roots
        for level in levels[-2::-1]:  # from the roots to the blocks: the states a node lies between
            up = states.select(F.col("conv_id").alias("c"), F.col("place").alias("p"), _entry("paths", F.col("i"), F.col("j")).alias("path"))
            at = F.col("place") % FAN
            found = level.join(up, level["conv_id"].eqNullSafe(up["c"]) & (F.expr(f"place div {FAN}") == F.col("p")))
            states = found.select(*level.columns, *(F.substring("path", (at + d).cast("int"), F.lit(1)).cast("int").alias(n) for d, n in ((1, "i"), (2, "j"))))
        self.pieces = states.select("bid", "conv_id", F.col("i").cast("long").alias("state"), _entry("audits", F.col("i"), F.col("j")).alias("piece"))

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        self.staged.append(materialize(df, name))
        return self.staged[-1]

    def close(self) -> None:
        discard(*self.staged)

    def summary(self) -> DataFrame:
        first, last = (F.col(c).cast("decimal(20,0)") for c in ("first_turn", "last_turn"))
        gaps = F.least(F.coalesce(last - first + 1 - F.col("turns"), F.lit(0)), F.lit((1 << 63) - 1)).cast("long")
        return self.roots.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def blocks(self, by: str = "bid") -> DataFrame:
        """conv_id, bid and ``turns``, an array of (edit, role, text), in order of conv_id and bid within partitions
        by ``bid``, or by ``conv_id`` for a reader that needs a conversation in one place."""
        schema = pa.schema([("conv_id", pa.int64()), ("bid", pa.int64()), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, piece, bid = 0, "", None
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if row["piece"] is not None:  # stands right before its block
                        state, piece, bid = row["state"], row["piece"], row["bid"]
                        continue
                    if bid != row["bid"]:
                        raise RuntimeError(f"block {row['bid']} has no part of an audit")
                    made = apply_audit(state, piece, row["roles"], row["texts"])
                    out.append({"conv_id": row["conv_id"], "bid": bid} | {name: [t[k] for t in made] for k, name in enumerate(("edits", "roles", "texts"))})
                yield pa.RecordBatch.from_pylist(out, schema)

        turns = self.turns.select("conv_id", "bid", F.lit(None).cast("long").alias("state"), F.lit(None).cast("string").alias("piece"), "roles", "texts")
        parts = self.pieces.select("conv_id", "bid", "state", "piece", *(F.lit(None).cast("array<string>").alias(c) for c in ("roles", "texts")))
        dealt = turns.unionByName(parts).repartition(by).sortWithinPartitions("conv_id", "bid", F.col("piece").isNull())
        return dealt.mapInArrow(run, "conv_id long, bid long, edits array<string>, roles array<string>, texts array<string>")

    def rows(self) -> DataFrame:
        """conv_id, bid, pos, edit, role, text: the repaired turns, in order of (bid, pos) within a conversation."""
        zipped = F.arrays_zip("edits", "roles", "texts")
        return self.blocks().select("conv_id", "bid", F.posexplode(zipped).alias("pos", "t")).select("conv_id", "bid", "pos", F.col("t.edits").alias("edit"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"))

    def digests(self) -> DataFrame:
        """conv_id and repaired_sha256 over ``role:text`` joined by newlines. A hash of a whole conversation can't be
        put together from parts, so one task reads each conversation's blocks, one at a time."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, made, started = None, None, False
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if made is None or row["conv_id"] != now:
                        if made is not None:
                            out.append({"conv_id": now, "repaired_sha256": made.hexdigest()})
                        now, made, started = row["conv_id"], hashlib.sha256(), False
                    for role, text in zip(row["roles"], row["texts"], strict=True):
                        made.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                        started = True
                yield pa.RecordBatch.from_pylist(out, schema)
            if made is not None:
                yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": made.hexdigest()}], schema)

        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        return self.blocks("conv_id").select("conv_id", "roles", "texts").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_digest(rows: DataFrame) -> DataFrame:
    """Every original conv_id with its faults, the least cost, the audit, and a digest of what it is repaired to.

    Null roles and texts are one space, null turns come first and count in no gap, a null conv_id is a
    conversation of its own; rows of the same turn come by role and text, rows that repeat are faults of
    the conversation (duplicate, or blank); very long conversations and texts are read by blocks; other
    columns are ignored; an empty table gives no rows; conversations whose rows the damage drops have
    zeros, an empty audit and the digest of nothing. Gaps beyond a long are the largest one. The result is a table in the
    shared folder.
    """
    repair = Repair(damaged(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair.summary().withColumnRenamed("conv_id", "c")
    digests = repair.digests().withColumnRenamed("conv_id", "d")
    joined = every.join(found, every["conv_id"].eqNullSafe(found["c"]), "left").join(digests, every["conv_id"].eqNullSafe(digests["d"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    out = materialize(joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")), "repaired")
    repair.close()
    return out
