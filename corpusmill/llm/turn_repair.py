"""Repair of conversation structure by survivor-coalescence Viterbi.

A conversation's role initials have to read ``(s?(ua)+)?``. Its rows are kept (0), reroled to user or assistant (1) or deleted (2;
blank rows and duplicates have to be), and empty user or assistant rows are inserted (5); a truncated row that stays costs 5. The
cheapest edits win, of equally cheap ones those whose initials D, I, K, R read least.

One survivor is kept for each of the four states that a prefix can leave. Their edits hang in a tree of back pointers that knows its
live branches; dead branches, those that have become too dear to win among them, are freed at once, and as soon as all survivors share an ancestor the edits up to it are given out, so
memory holds the unresolved suffixes alone. Equally cheap survivors are told apart by their complete unresolved suffixes: all
strings end with a row's own edit, none is the beginning of another, so their order after a row follows from their order before it and from the
row's edits, and is kept as a rank instead of being read again from the tree.

Rows are dealt by range of (conversation, turn, role, text hash), so that one conversation, however long, lies in many chunks of at
most ``2 ** CHUNK_BITS`` rows. A chunk's cheapest costs and ranks from each state to each state are a four by four table; tables are chained per
conversation, which gives each chunk the state that it starts and ends in, and then each chunk repairs its rows by itself. Only hashes and
roles take part; texts travel once, for the result. The digest of ``query`` hashes a conversation's whole text in order, which only one
task can do; it reads its rows as a stream.

Edge cases: a null role or text is one space (a blank row). Null turns come first; rows of one turn go by role, then by the hash of
their text. Null conversation ids form one conversation. Repeated rows are duplicates. Empty tables give empty results; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, read

CHUNK_BITS = 16
BLANKS = " \t\n\r\x0b\x0c"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What comes next, and where it leads.
EXPECTED, AFTER = "uuau", (2, 2, 3, 2)
NAMES = {"u": "user", "a": "assistant"}
#: Fewest inserts from a state to others; those that end the conversation well.
FILLS = (((0, 0), (2, 1), (3, 2)), ((1, 0), (2, 1), (3, 2)), ((2, 0), (3, 1)), ((3, 0), (2, 1)))
FINISH = (0, 2, 1, 0)
#: What goes on from the second state goes on from the first for so much more (first row: from 0 to each): by inserts, or by deleting the s that
#: only state 0 may keep. A survivor dearer than another by more than that cannot win.
BRIDGE = ((0, 0, 5, 0), (12, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))


def steps(fault: int, initial: str) -> list[list[tuple[int, str, int]]]:
    """For each state the edits of a row: (state after it, letters, cost)."""
    out = []
    for state in range(4):
        ways = [(state, "D", DELETE)]
        if fault not in (BLANK, DUPLICATE):
            stay = CUT if fault == TRUNCATED else 0
            if state == 0 and initial == "s":
                ways.append((1, "K", KEEP + stay))
            for at, n in FILLS[state]:
                letter, cost = ("K", KEEP) if initial == EXPECTED[at] else ("R", REROLE)
                ways.append((AFTER[at], "I" * n + letter, cost + n * INSERT + stay))
        out.append(ways)
    return out


STEPS = {(fault, initial): steps(fault, initial) for fault in range(4) for initial in ("s", "u", "a", "")}


def steps_of(fault: int, role: str):
    return STEPS[fault, role[:1] if role[:1] in ("s", "u", "a") else ""]


def advance(front: dict, ways: list) -> dict:
    """front {state: (cost, rank)} after a row: {state: (cost, rank, state before, letters)}."""
    best = {}
    for state, (cost, rank, *_) in front.items():
        for to, letters, more in ways[state]:
            key = (cost + more, rank, letters, state)
            if to not in best or key < best[to]:
                best[to] = key
    best = {t: b for t, b in best.items() if all(b[0] <= best[o][0] + BRIDGE[o][t] for o in best)}
    order = sorted(best, key=lambda t: best[t][1:3])
    return {t: (best[t][0], r, best[t][3], best[t][2]) for r, t in enumerate(order)}


def final_state(front: dict) -> int:
    return min(front, key=lambda t: (front[t][0] + FINISH[t] * INSERT, front[t][1]))


class Node:
    """Edits of one row, behind those of the rows before; kids are its live branches."""

    __slots__ = ("parent", "letters", "kids")

    def __init__(self, parent, letters):
        self.parent, self.letters, self.kids = parent, letters, []


class Survivors:
    """The survivors over the rows read so far; edits on which all of them agree are given out and forgotten."""

    def __init__(self, entry: int = 0):
        self.front = {entry: (0, 0)}
        self.root = Node(None, "")
        self.tips = {entry: self.root}
        self.held = 0

    def push(self, ways: list) -> list[str]:
        """Takes a row; gives the edits that are settled by it, one string a row."""
        self.front = advance(self.front, ways)
        tips = {}
        for state, (_, _, before, letters) in self.front.items():
            parent = self.tips[before]
            node = tips[state] = Node(parent, letters)
            parent.kids.append(node)
            self.held += 1
        for node in self.tips.values():
            while not node.kids and node is not self.root:
                node.parent.kids.remove(node)
                self.held -= 1
                node = node.parent
        self.tips = tips
        out = []
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.held -= 1
            out.append(self.root.letters)
        return out

    def finish(self, exit_state: int | None = None) -> tuple[list[str], str]:
        """The edits still open, by the survivor of the state (the cheapest finish, if none is named), and the inserts at the end."""
        state = final_state(self.front) if exit_state is None else exit_state
        node, out = self.tips[state], []
        while node is not self.root:
            out.append(node.letters)
            node = node.parent
        return out[::-1], "" if exit_state is not None else "I" * FINISH[state]


def roles_after(state: int, letters: str, role: str) -> tuple[list[str], int]:
    """The roles that the edits of a row give, and the state after them."""
    out = []
    for letter in letters:
        if letter == "K" and state == 0 and role[:1] == "s":
            out.append(role)
            state = 1
        elif letter != "D":
            out.append(role if letter == "K" else NAMES[EXPECTED[state]])
            state = AFTER[state]
    return out, state


def identified(turns: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, cid (as text, never null), turn, role, text (nulls: one space), digest of all but the turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text))
    cid = F.when(F.col(conv_id).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(conv_id).cast("string")))
    out = turns.select(F.col(conv_id).alias("conv_id"), cid.alias("cid"), F.col(turn).cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return with_digest(out)


def with_digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.md5(F.concat("cid", F.lit("\0"), "role", F.lit("\0"), "text"))))


def order() -> list:
    return [F.col("cid"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def placed(rows: DataFrame) -> DataFrame:
    """rows (identified) without texts: conv_id, cid, chunk, at (place among all rows), turn, role, digest, fault."""
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    narrow = rows.select("conv_id", "cid", "turn", "role", "digest", fault.alias("fault"), F.pmod(F.monotonically_increasing_id(), F.lit(1024)).alias("salt"))
    dealt = narrow.repartitionByRange(*order(), "salt").sortWithinPartitions(*order(), "salt").drop("salt").withColumn("at", F.monotonically_increasing_id())
    dealt = materialize(dealt.withColumn("chunk", F.shiftright("at", CHUNK_BITS)), "places")
    first = dealt.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = (F.col("fault") != BLANK) & (F.col("at") > F.col("first"))
    marked = dealt.join(first, "digest", "left").withColumn("fault", F.when(again, DUPLICATE).otherwise(F.col("fault"))).drop("first")
    out = materialize(marked, "marked")
    out._shared_tables = [dealt, out]
    return out


def groups(batches, names: tuple[str, ...], columns: tuple[str, ...]):
    """(key, rows) of the sorted batches, where rows runs over tuples of the columns; a group may lie in many batches."""

    def flat():
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in names))
            yield from zip(keys, zip(*(batch.column(c).to_pylist() for c in columns)))

    rows = flat()
    held = next(rows, None)

    def group(key):
        nonlocal held
        while held is not None and held[0] == key:
            row = held[1]
            held = next(rows, None)
            yield row

    while held is not None:
        key = held[0]
        own = group(key)
        yield key, own
        for _ in own:
            pass


def table_of(rows) -> tuple[list[int], list[int]]:
    """Costs and ranks from each state to each state over the rows (fault, role), -1 where there is no way."""
    fronts = [{s: (0, 0)} for s in range(4)]
    for fault, role in rows:
        ways = steps_of(fault, role)
        fronts = [advance(f, ways) for f in fronts]
    return [f[t][0] if t in f else -1 for f in fronts for t in range(4)], [f[t][1] if t in f else -1 for f in fronts for t in range(4)]


def chained(tables: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The states that each chunk of a conversation starts and ends in, by the tables of its chunks in order."""
    front, back = {0: (0, 0)}, []
    for costs, ranks in tables:
        ways = [[(t, ranks[4 * s + t], costs[4 * s + t]) for t in range(4) if costs[4 * s + t] >= 0] for s in range(4)]
        front = advance(front, ways)
        back.append({t: before for t, (_, _, before, _) in front.items()})
    state, out = final_state(front), []
    for before in reversed(back):
        out.append((before[state], state))
        state = before[state]
    return out[::-1]


def boundaries(marked: DataFrame) -> DataFrame:
    """cid, chunk, entry, leave: states at the ends of the chunks of those conversations that lie in several."""
    spread = marked.groupBy("cid").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo < hi").select("cid")

    def tables(batches):
        for (cid, chunk), rows in groups(batches, ("cid", "chunk"), ("fault", "role")):
            costs, ranks = table_of(rows)
            yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([chunk], pa.int64()), pa.array([costs], pa.list_(pa.int64())), pa.array([ranks], pa.list_(pa.int64()))], ["cid", "chunk", "costs", "ranks"])

    rows = marked.join(spread, "cid", "left_semi").select("cid", "chunk", "at", "fault", "role")
    parts = rows.repartition("cid", "chunk").sortWithinPartitions("cid", "chunk", "at").mapInArrow(tables, "cid string, chunk long, costs array<long>, ranks array<long>")

    def chain(batches):  # a row of each chunk, not of each turn
        for (cid,), chunks in groups(batches, ("cid",), ("chunk", "costs", "ranks")):
            chunks = list(chunks)
            ends = chained([c[1:] for c in chunks])
            ends[-1] = (ends[-1][0], None)  # the last chunk finds its end, and the inserts there, by itself
            yield pa.RecordBatch.from_arrays([pa.array([cid] * len(ends)), pa.array([c[0] for c in chunks], pa.int64()), pa.array([e[0] for e in ends], pa.int32()), pa.array([e[1] for e in ends], pa.int32())], ["cid", "chunk", "entry", "leave"])

    return parts.repartition("cid").sortWithinPartitions("cid", "chunk").mapInArrow(chain, "cid string, chunk long, entry int, leave int")


def edits(rows: DataFrame) -> DataFrame:
    """What becomes of each row of rows (identified): its columns but the text, at, fault, edit, and roles.

    edit holds the inserts before the row, its own K, R or D, and behind the last row those at the end; roles are the roles that it gives, in order.
    Rows are in the order of at within a conversation."""
    marked = placed(rows)
    bounded = marked.join(boundaries(marked), ["cid", "chunk"], "left")
    types = {f.name: f.dataType.simpleString() for f in marked.schema}
    names = ["conv_id", "cid", "at", "turn", "role", "digest", "fault"]
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", edit string, roles array<string>"

    def repair(batches):
        arrow, out = None, []

        def flushed(n):
            columns = [pa.array(c, t) for c, t in zip(zip(*out[:n]), arrow)]
            del out[:n]
            return pa.RecordBatch.from_arrays(columns, [*names, "edit", "roles"])

        def typed():
            nonlocal arrow
            for batch in batches:
                arrow = arrow or [*(batch.schema.field(n).type for n in names), pa.string(), pa.list_(pa.string())]
                yield batch

        for _, group in groups(typed(), ("cid", "chunk"), (*names, "entry", "leave")):
            waiting, survivors, state, leave = deque(), None, 0, None
            for *row, entry, leave in group:
                if survivors is None:
                    state = entry or 0
                    survivors = Survivors(state)
                waiting.append(row)
                for letters in survivors.push(steps_of(row[6], row[4])):
                    done = waiting.popleft()
                    roles, state = roles_after(state, letters, done[4])
                    out.append((*done, letters, roles))
                if len(out) > 4096:
                    yield flushed(4096)
            rest, tail = survivors.finish(leave)
            for letters in rest:
                done = waiting.popleft()
                roles, state = roles_after(state, letters, done[4])
                out.append((*done, letters, roles))
            if tail:
                done = out.pop()
                roles, state = roles_after(state, tail, "")
                out.append((*done[:-2], done[-2] + tail, [*done[-1], *roles]))
        if out:
            yield flushed(len(out))

    # dealt by a hash of the join's keys, as a shuffle by the keys themselves is left out behind the join, whose skewed partitions may be split
    return bounded.repartition(F.xxhash64("cid", "chunk")).sortWithinPartitions("cid", "chunk", "at").mapInArrow(repair, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, at, step, role, text of the conversations after their edits; in order by at and step within a conversation."""
    steps_ = edits(rows).select("conv_id", "at", "digest", "edit", F.posexplode("roles").alias("step", "role"))
    letters = F.translate("edit", "D", "")
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"))
    own = F.substring(letters, F.col("step") + 1, F.lit(1)) != "I"
    out = steps_.withColumn("own", own).join(texts, "digest")
    return out.select("conv_id", "at", "step", "role", F.when(F.col("own"), F.col("text")).otherwise("").alias("text"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (identified) of conversations with faults put in by crc32 of their ids, and copies: how often each is there afterwards."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = identified(turns, "conv_id", "turn", "role", "text").withColumn("fault", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return with_digest(rows).withColumn("copies", F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)).drop("fault")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digested(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """A row of counts and hashes for each conversation of rows (identified, with copies), by its edits."""
    own = rows.select("conv_id", "cid", "turn", "role", "digest", F.lit(-1).cast("long").alias("at"), F.when(F.col("copies") > 0, F.col("text")).cast("binary").alias("text"), F.lit(0).alias("fault"), F.lit(None).cast("string").alias("edit"), F.lit(None).cast("array<string>").alias("roles"))
    steps_ = edited.select("conv_id", "cid", "turn", "role", "digest", "at", F.lit(None).cast("binary").alias("text"), "fault", "edit", "roles")
    both = own.unionByName(steps_).repartition("cid").sortWithinPartitions(*order(), "at")

    def digest(batches):
        arrow, out = None, []

        def typed():
            nonlocal arrow
            for batch in batches:
                arrow = arrow or [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield batch

        def flushed():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *(c.split()[0] for c in DIGEST.split(", "))])

        for _, group in groups(typed(), ("cid",), ("conv_id", "turn", "role", "at", "text", "fault", "edit", "roles")):
            counts, illegal, cost, audit, sha, before, started = [0] * 4, 0, 0, [], hashlib.sha256(), None, False
            low = high = turns = None
            for conv_id, turn, role, at, text, fault, edit, roles in group:
                if at < 0:  # the text that the edits behind it are about
                    held = text
                    continue
                if turn is not None:
                    low, turns = (turn, 0) if low is None else (low, turns)
                    turns += turn != high
                    high = turn
                counts[fault] += 1
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                audit.append(edit)
                roles = iter(roles)
                for letter in edit:
                    cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
                    if letter != "D":
                        sha.update((b"\n" if started else b"") + next(roles).encode("utf-8", "surrogatepass") + b":")
                        started = True
                        if letter != "I":
                            sha.update(held)
                            cost += CUT if fault == TRUNCATED else 0
            gaps = 0 if low is None else high - low + 1 - turns
            out.append((conv_id, gaps, *counts[1:], illegal, cost, "".join(audit), sha.hexdigest()))
            if len(out) >= 1024:
                yield flushed()
        if out:
            yield flushed()

    kind = dict(both.dtypes)["conv_id"]
    return both.mapInArrow(digest, f"conv_id {kind}, {DIGEST}")


def query(spark, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    there = rows.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).drop("copy", "copies")
    return digested(rows, edits(there))
