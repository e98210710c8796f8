"""Conversation structure repair: the cheapest edits that make roles alternate, with the edits as an audit.

Wanted are no turns, or an optional system turn and then user and assistant in turns, ending with an assistant.
A pass over a conversation's rows keeps, for each of the four places such a sequence can be at (`EMPTY`, `SYSTEM`,
`USER`, `REPLY`), the cheapest edits up to here. Edits are nodes linked to the edits before them, so prefixes
are shared. A node knows its ancestors 1, 2, 4 ... steps back and a rolling hash of its whole prefix: of two
equally cheap lists the least in ASCII order is found by a search for their longest common prefix, and equal
hashes of different nodes are verified letter by letter. A place keeps only its least list: the letters
decide the place, and an edit without a row costs something, so no list is the beginning of another of
equal cost and place. What all four lists share is written out and dropped from time to time; what is repaired
is hashed as it goes. So a task holds the audit's letters and as many nodes as the lists differ, whatever the
length of the conversation.

Rows meet by conversation. Repeats of (role, text) are found by a window that takes the same
partitioning, on the whole text; both sorts spill, so no set of texts is held.

Defined results: `damaged` makes nulls one space; rows without a conversation id are one conversation; null
turns come first and rows of one turn are ordered by role and text. A role without letters can't be kept. An
empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and what stands for white space.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
BLANK = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, REPLY = range(4)
BASE, PRIME = 0x1F3D5B79A, (1 << 61) - 1
CUT = 512  # rows between two looks for what all lists share
OUT = 1024  # conversations handed on together
COLUMNS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Edits:
    """A list of edits: its last letter, and the list before it."""

    __slots__ = ("letter", "size", "hash", "up")

    def __init__(self, before: Edits | None = None, letter: str = ""):
        self.letter = letter
        self.size = before.size + 1 if before else 0
        self.hash = (before.hash * BASE + ord(letter)) % PRIME if before else 1
        self.up = []
        while before is not None:
            self.up.append(before)
            k = len(self.up) - 1
            before = before.up[k] if k < len(before.up) else None

    def at(self, size: int) -> Edits:
        """The first ``size`` edits."""
        node = self
        while node.size > size:
            node = node.up[(node.size - size).bit_length() - 1]
        return node

    def letters(self) -> str:
        node, out = self, []
        while node.up:
            out.append(node.letter)
            node = node.up[0]
        return "".join(reversed(out))


def same(a: Edits, b: Edits) -> bool:
    if a is b or a.hash != b.hash or a.size != b.size:
        return a is b
    while a is not b and a.up:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def parting(a: Edits, b: Edits) -> tuple[Edits, Edits]:
    """The lists up to and with the first letter that differs; equal ones if one begins the other."""
    size = min(a.size, b.size)
    a, b = a.at(size), b.at(size)
    if same(a, b):
        return a, b
    for k in range(len(a.up) - 1, -1, -1):
        if k < len(a.up) and not same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a, b


def less(a: Edits, b: Edits) -> bool:
    x, y = parting(a, b)
    return a.size < b.size if same(x, y) else x.letter < y.letter


def shared(lists: list[Edits]) -> Edits:
    """The longest beginning of all of them."""
    common = lists[0]
    for other in lists[1:]:
        x, y = parting(common, other)
        common = x if same(x, y) else x.up[0]
    return common


def without(lists: list[Edits], size: int) -> list[Edits]:
    """The lists from ``size`` on, still sharing what they shared."""
    made, out, start = {}, [], Edits()
    for node in lists:
        path = []
        while node.size > size and id(node) not in made:
            path.append(node)
            node = node.up[0]
        now = made[id(node)] if node.size > size else start
        for old in reversed(path):
            now = made[id(old)] = Edits(now, old.letter)
        out.append(now)
    return out


class _Place:
    """The cheapest edits that lead to a place, and the hash of what they leave."""

    __slots__ = ("cost", "edits", "left")

    def __init__(self, cost: int, edits: Edits, left):
        self.cost, self.edits, self.left = cost, edits, left


class Repair:
    """One conversation's rows in order."""

    def __init__(self, cut: int = CUT):
        self.cut, self.rows, self.written = cut, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.moments, self.last_turn, self.last_initial = 0, None, None
        self.places: list[_Place | None] = [_Place(0, Edits(), hashlib.sha256()), None, None, None]
        self._insert()

    def _offer(self, places: list, to: int, origin: int, cost: int, letter: str, said: str | None) -> None:
        """The way from ``origin`` to ``to`` stays if it is the cheapest, or the least of the cheapest."""
        before, held = (places if letter == "I" else self.places)[origin], places[to]
        if before is None or (held is not None and held.cost < before.cost + cost):
            return
        edits = Edits(before.edits, letter)
        if held is not None and held.cost == before.cost + cost and not less(edits, held.edits):
            return
        left = before.left
        if said is not None:
            left = left.copy()
            left.update((said if origin == EMPTY else "\n" + said).encode("utf-8", "surrogatepass"))
        places[to] = _Place(before.cost + cost, edits, left)

    def _insert(self) -> None:
        """Turns without text may be put in at any point: a user's, and after it an assistant's."""
        for origin in (EMPTY, SYSTEM, REPLY):
            self._offer(self.places, USER, origin, INSERT, "I", "user:")
        self._offer(self.places, REPLY, USER, INSERT, "I", "assistant:")

    def take(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        initial, bare = role[:1], text.rstrip(BLANK)
        gone, extra = False, 0
        if not bare:
            self.blank, gone = self.blank + 1, True
        elif repeated:
            self.duplicate, gone = self.duplicate + 1, True
        elif bare[-1] not in ".!?":
            self.truncated, extra = self.truncated + 1, TRUNCATED
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high, self.last_turn, self.moments = turn, turn, self.moments + 1

        places: list[_Place | None] = [None] * 4
        for origin in range(4):
            self._offer(places, origin, origin, DELETE, "D", None)
        if not gone:
            if initial == "s":
                self._offer(places, SYSTEM, EMPTY, extra, "K", f"{role}:{text}")
            for origin in range(4):
                to, wanted = (REPLY, "assistant") if origin == USER else (USER, "user")
                if initial == wanted[0]:
                    self._offer(places, to, origin, extra, "K", f"{role}:{text}")
                self._offer(places, to, origin, REROLE + extra, "R", f"{wanted}:{text}")
        self.places = places
        self._insert()
        self._forget()
        self.rows += 1
        if self.rows % self.cut == 0:
            self._write_shared()

    def _forget(self) -> None:
        """Places that can't win any more: whatever may follow them is cheaper after a reply.

        After a system turn the same may follow as after a reply; at the beginning a system turn may be kept besides,
        which after a reply is deleted.
        """
        system, start, reply = self.places[SYSTEM], self.places[EMPTY], self.places[REPLY]
        if system is not None and system.cost > reply.cost:
            self.places[SYSTEM] = None
        if start is not None and start.cost > reply.cost + DELETE:
            self.places[EMPTY] = None

    def _write_shared(self) -> None:
        held = [p for p in self.places if p is not None]
        common = shared([p.edits for p in held])
        if 2 * common.size >= max(p.edits.size for p in held):
            self.written.append(common.letters())
            for place, edits in zip(held, without([p.edits for p in held], common.size)):
                place.edits = edits

    def result(self, conversation: int | None) -> tuple:
        best, reply = self.places[EMPTY], self.places[REPLY]
        if best is None or reply.cost < best.cost or (reply.cost == best.cost and less(reply.edits, best.edits)):
            best = reply
        gaps = self.high - self.low + 1 - self.moments if self.moments else 0
        audit = "".join([*self.written, best.edits.letters()])
        return (
            conversation, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, audit, best.left.hexdigest(),
        )


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows damaged by a hash of conversation and turn; a dropped one stays as a mark."""

    def given(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    hit = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), given("role").alias("role"),
        given("text").alias("text"), kind.alias("_kind"),
    )
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 0, "").when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def repair(turns: DataFrame, cut: int = CUT) -> DataFrame:
    """A row per conversation (`COLUMNS`): its faults, the cost of the cheapest repair, its edits and a hash of what they leave.

    ``turns`` has (conv_id, turn, role, text, dropped); rows marked ``dropped`` count for nothing, but a
    conversation that has only such rows is still returned, with zeros and an empty audit.
    """
    copies = Window.partitionBy("conv_id", "role", "text", "dropped").orderBy("turn")
    placed = turns.select("conv_id", "turn", "role", "text", "dropped").repartition("conv_id")
    marked = placed.withColumn("_seen", F.row_number().over(copies))
    ordered = marked.sortWithinPartitions("conv_id", "turn", "role", "text", "_seen")
    rows = ordered.select("conv_id", "turn", "role", "text", (F.col("_seen") > 1).alias("repeated"), "dropped")
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in COLUMNS.split(", "))])

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, found = None, None, []
        for some in batches:
            for conversation, turn, role, text, repeated, dropped in zip(*(c.to_pylist() for c in some.columns)):
                if now is None or conversation != now[0]:
                    if now is not None:
                        found.append(state.result(now[0]))
                    now, state = (conversation,), Repair(cut)
                if not dropped:
                    state.take(turn, role, text, repeated)
            if len(found) >= OUT or sum(len(f[7]) for f in found) >= 4 << 20:
                yield batch(found)
                found = []
        if now is not None:
            found.append(state.result(now[0]))
        if found:
            yield batch(found)

    return rows.mapInArrow(work, COLUMNS)
