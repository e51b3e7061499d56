"""Repair of conversations whose turns are out of order: the cheapest edits after which the roles fit ``(system? (user assistant)+)?``.

Four states tell what may follow: nothing yet, after a system, a user or an assistant turn. In the manner of Wu and Manber, for costs 0, 1, 2, ... in turn and
every place in a conversation one set of states (four bits) holds those from which the rest can be repaired at exactly that cost; sets of one cost follow from cheaper ones and from the
place behind by table look-ups, for all conversations of a batch at once. The first cost whose set at the front holds the start is the least; following the bits forward, the least letter first,
gives the least audit. A conversation of any length is cut into segments of SEGMENT turns: small matrices of costs between states tell each segment what the rest costs, and then each is traced on its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Scratch, kept
from ._order import numbered

SEGMENT = 64
#: Costs; a turn that breaks off costs one more if it stays.
REROLE, DELETE, INSERT, BROKEN = 2, 3, 2, 1
#: The role that follows each state (start, system, user, assistant), as a state; and what the end costs there, by letters.
FOLLOWS, TAIL = (2, 2, 3, 2), ("", "II", "I", "")
NAMES = ("", "system", "user", "assistant")
_SHUT = tuple(INSERT * len(x) for x in TAIL)
#: Codes of turns: s, u, a and x (another role), in upper case where the text breaks off; b and d (blank, duplicate) must go.
_KEEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
_BATCH = 1024
_BLANKS = r"\x20\x09-\x0D"


def _before(steps: dict[int, int]) -> np.ndarray:
    """For each set of states the set of those from which a step leads into it."""
    return np.array([sum(1 << q for q, to in steps.items() if held >> to & 1) for held in range(16)], np.uint8)


_TURN = _before(dict(enumerate(FOLLOWS)))
_KINDS = np.stack([_before(_KEEP[k]) for k in "suax"])
_KIND_OF = np.zeros(128, np.uint8)
for _n, _k in enumerate("suax"):
    _KIND_OF[[ord(_k), ord(_k.upper())]] = _n


def cost_layers(codes: np.ndarray, seeds: np.ndarray, wanted: int) -> np.ndarray:
    """sets[cost, place, item] of states for items of one length: codes (items x length, bytes), seeds (items x 4): what is left to pay behind the last turn, negative where the state can't end.

    Layers are added until every item has all wanted states (bits) at its front, or no cost can lead to more.
    """
    codes = codes.T
    length, n = codes.shape
    kind, gone, late = _KIND_OF[codes], (codes == ord("b")) | (codes == ord("d")), (codes >= ord("A")) & (codes <= ord("Z"))
    none, out, found = np.zeros((length + 1, n), np.uint8), [], np.zeros(n, np.uint8)
    most = int(seeds.max(initial=0)) + DELETE * length + 2 * INSERT + 1
    for cost in range(most + 1):
        back = lambda k: out[cost - k] if k <= cost else none  # noqa: B023, E731
        own = np.zeros((length + 1, n), np.uint8)
        for q in range(4):
            own[length] |= (seeds[:, q] == cost).astype(np.uint8) << q
        for i in range(length - 1, -1, -1):
            stay = _KINDS[kind[i], np.where(late[i], back(BROKEN)[i + 1], own[i + 1])] | _TURN[np.where(late[i], back(REROLE + BROKEN)[i + 1], back(REROLE)[i + 1])]
            own[i] = np.where(gone[i], 0, stay) | back(DELETE)[i + 1] | _TURN[back(INSERT)[i]]
        out.append(own)
        found |= own[0]
        if (found & wanted == wanted).all():
            break
    return np.stack(out)


def traced(sets: bytes, length: int, code: str, state: int) -> tuple[str, int]:
    """The least of the cheapest audits from a state on, and the state behind the last turn; sets: the layers of one item, cost by cost."""
    width = length + 1
    cost = next(c for c in range(len(sets) // width) if sets[c * width] >> state & 1)
    i, letters = 0, []
    while i < length:
        at = cost * width + i
        late = code[i].isupper()
        follow = FOLLOWS[state]
        if cost >= DELETE and sets[at - DELETE * width + 1] >> state & 1:
            letters.append("D")
            cost, i = cost - DELETE, i + 1
        elif cost >= INSERT and sets[at - INSERT * width] >> follow & 1:
            letters.append("I")
            cost, state = cost - INSERT, follow
        else:
            to = _KEEP[code[i].lower()].get(state)
            if to is not None and cost >= late and sets[at - late * width + 1] >> to & 1:
                letters.append("K")
                cost, state, i = cost - late, to, i + 1
            else:
                letters.append("R")
                cost, state, i = cost - REROLE - late, follow, i + 1
    return "".join(letters), state


def _by_length(codes: list[str]):
    """(rows, their codes as bytes) for rows of one length, some at a time."""
    of = {}
    for n, code in enumerate(codes):
        of.setdefault(len(code), []).append(n)
    for length, rows in of.items():
        for k in range(0, len(rows), _BATCH):
            part = rows[k : k + _BATCH]
            yield part, np.frombuffer("".join(codes[n] for n in part).encode(), np.uint8).reshape(len(part), length)


def _transfers(batches):
    """The costs between states of each segment, 16 numbers by entry and exit; -1 where there is no way."""
    for batch in batches:
        codes = batch.column("codes").to_pylist()
        costs = np.full((len(codes), 4, 4), -1, np.int32)
        for rows, part in _by_length(codes):
            for last in range(4):
                seeds = np.full((len(rows), 4), -1)
                seeds[:, last] = 0
                front = cost_layers(part, seeds, 15)[:, 0]
                for q in range(4):
                    has = front >> q & 1
                    costs[rows, q, last] = np.where(has.any(axis=0), has.argmax(axis=0), -1)
        yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("seg"), pa.array(costs.reshape(len(codes), 16).tolist(), pa.list_(pa.int32()))], names=["g", "seg", "costs"])


def _traces(wanted: int):
    """What each segment's audits are from each wanted state, and where they end."""

    def run(batches):
        for batch in batches:
            codes, last = batch.column("codes").to_pylist(), batch.column("last").to_pylist()
            seeds = np.array(batch.column("seeds").to_pylist(), np.int64).reshape(-1, 4)
            audits, exits = [[None] * 4 for _ in codes], [[None] * 4 for _ in codes]
            for rows, part in _by_length(codes):
                sets = cost_layers(part, seeds[rows], wanted)
                size, length = len(sets) * sets.shape[1], part.shape[1]
                flat = np.ascontiguousarray(sets.transpose(2, 0, 1)).tobytes()
                for k, n in enumerate(rows):
                    for q in range(4):
                        if wanted >> q & 1:
                            letters, exits[n][q] = traced(flat[k * size : (k + 1) * size], length, codes[n], q)
                            audits[n][q] = letters + TAIL[exits[n][q]] if last[n] else letters
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("seg"), batch.column("codes"), pa.array(audits, pa.list_(pa.string())), pa.array(exits, pa.list_(pa.int32()))], names=["g", "seg", "codes", "audits", "exits"]
            )

    return run


def _rest(key, rows):
    """What is left to pay behind each segment of a conversation, least first taken off: four numbers a segment."""
    rows = rows.sort_by("seg")
    left, out = list(_SHUT), []
    for costs in reversed(rows.column("costs").to_pylist()):
        out.append([x - min(left) for x in left])
        left = [min(c + x for c, x in zip(costs[q * 4 : q * 4 + 4], left, strict=True) if c >= 0) for q in range(4)]
        left = [x - min(left) for x in left]
    return pa.table([rows.column("g"), rows.column("seg"), pa.array(out[::-1], pa.list_(pa.int32()))], names=["g", "seg", "seeds"])


def _entries(key, rows):
    """The state before each segment of a conversation."""
    rows = rows.sort_by("seg")
    state, out = 0, []
    for exits in rows.column("exits").to_pylist():
        out.append(state)
        state = exits[state]
    return pa.table([rows.column("g"), rows.column("seg"), pa.array(out, pa.int32())], names=["g", "seg", "entry"])


def _audited(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, seg, codes, audit) from (g, seg, size, codes)."""
    shape = "g string, seg long, codes string, audits array<string>, exits array<int>"
    shut = F.array(*[F.lit(x) for x in _SHUT])
    one = segments.where(F.col("size") <= SEGMENT).select("g", "seg", "codes", shut.alias("seeds"), F.lit(True).alias("last")).mapInArrow(_traces(1), shape)
    one = one.select("g", "seg", "codes", F.element_at("audits", 1).alias("audit"))
    # long conversations: for each, some numbers for 64 turns, less than the letters of its audit
    many = segments.where(F.col("size") > SEGMENT)
    costs = many.mapInArrow(_transfers, "g string, seg long, costs array<int>")
    rest = costs.groupBy("g").applyInArrow(_rest, "g string, seg long, seeds array<int>")
    last = F.col("seg") == F.floor((F.col("size") - 1) / SEGMENT)
    traces = scratch.keep(many.select("g", "seg", "codes", last.alias("last")).join(rest, ["g", "seg"]).mapInArrow(_traces(15), shape))
    entry = traces.select("g", "seg", "exits").groupBy("g").applyInArrow(_entries, "g string, seg long, entry int")
    return one.unionByName(traces.join(entry, ["g", "seg"]).select("g", "seg", "codes", F.element_at("audits", F.col("entry") + 1).alias("audit")))


def _walk(conv_type: pa.DataType, turns: bool):
    """Streams each conversation's audit and turns, in order, to its repaired turns or to one row of figures."""
    names = ["conv", "place", "edit", "role", "text"] if turns else ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    class Talk:
        def __init__(self, conv):
            self.conv, self.codes, self.letters, self.at, self.row = conv, [], [], 0, 0
            self.code = self.audit = None
            self.state = self.place = self.cost = self.illegal = self.distinct = 0
            self.least = self.most = self.before = None
            self.digest, self.out = hashlib.sha256(), []

        def line(self, edit, role, text):
            if turns:
                self.out.append((self.conv, self.place, edit, role, text))
            else:
                self.digest.update((("\n" if self.place else "") + f"{role}:{text}").encode())
            self.place += 1

        def inserts(self):
            while self.at < len(self.audit) and self.audit[self.at] == "I":
                self.at, self.cost, self.state = self.at + 1, self.cost + INSERT, FOLLOWS[self.state]
                self.line("I", NAMES[self.state], "")

        def ready(self):
            if self.audit is None:
                self.audit, self.code = "".join(self.letters), "".join(self.codes)

        def turn(self, turn, role, text):
            self.ready()
            if turn is not None:
                self.distinct += turn != self.most
                self.least, self.most = turn if self.least is None else self.least, turn
            if self.before is not None:
                self.illegal += self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            self.inserts()
            edit, late = self.audit[self.at], self.code[self.row].isupper()
            self.at, self.row = self.at + 1, self.row + 1
            if edit == "D":
                self.cost += DELETE
                return
            self.cost += late * BROKEN
            if edit == "R":
                self.cost, self.state = self.cost + REROLE, FOLLOWS[self.state]
                role = NAMES[self.state]
            else:
                self.state = _KEEP[role[:1]][self.state]
            self.line(edit, role, text)

        def figures(self):
            code = self.code
            gaps = self.most - self.least + 1 - self.distinct if self.distinct else 0
            return (self.conv, gaps, code.count("b"), code.count("d"), sum(map(code.count, "SUAX")), self.illegal, self.cost, self.audit, self.digest.hexdigest())

        def end(self):
            self.ready()
            self.inserts()
            return self.out if turns else [self.figures()]

    types = [conv_type] + ([pa.int64(), pa.string(), pa.string(), pa.string()] if turns else [pa.int64()] * 6 + [pa.string()] * 2)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        talk, group, out = None, None, []
        for batch in batches:
            for g, what, conv, turn, role, text, codes, audit in zip(*[batch.column(c).to_pylist() for c in ("g", "what", "conv", "turn", "role", "text", "codes", "audit")], strict=True):
                if talk is None or g != group:
                    out += talk.end() if talk else []
                    talk, group = Talk(conv), g
                if what == 1:
                    talk.codes.append(codes)
                    talk.letters.append(audit)
                elif what == 2:
                    talk.turn(turn, role, text)
            if turns and talk:
                out, talk.out = out + talk.out, []
            if out:
                yield batch_of(out)
                out = []
        if talk and (out := out + talk.end()):
            yield batch_of(out)

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _repaired(rows: DataFrame, every: DataFrame | None, conv: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    cols = {c: F.col(f"`{c}`") for c in (conv, turn, role, text)}
    space = lambda c: F.coalesce(cols[c].cast("string"), F.lit(" "))
    group = lambda c: F.coalesce(F.concat(F.lit("1"), c.cast("string")), F.lit("0"))
    body = space(text)
    plain = rows.select(group(cols[conv]).alias("g"), cols[conv].alias("conv"), cols[turn].alias("turn"), space(role).alias("role"), body.alias("text"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("body"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("body")]
    first = F.substring("role", 1, 1)
    head = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    code = F.when(~F.col("text").rlike(f"[^{_BLANKS}]"), "b").when(F.col("text").rlike(rf"[.!?][{_BLANKS}]*\z"), head).otherwise(F.upper(head))
    with Scratch(rows.sparkSession) as scratch:
        narrow = scratch.keep(plain.select("g", "turn", "role", "body", code.alias("code")))
        placed = scratch.keep(numbered(narrow, "g", order, scratch))
        fresh = placed.groupBy("g", "role", "body").agg(F.min("pos").alias("pos")).select("g", "pos", F.lit(True).alias("fresh"))
        known = placed.select("g", "pos", "size", "code").join(fresh, ["g", "pos"], "left")
        known = known.withColumn("code", F.when((F.col("code") == "b") | F.col("fresh"), F.col("code")).otherwise("d"))
        letters = F.array_sort(F.collect_list(F.struct("pos", "code")))
        segments = known.groupBy("g", F.floor(F.col("pos") / SEGMENT).alias("seg"), "size").agg(F.array_join(F.transform(letters, lambda x: x["code"]), "").alias("codes"))
        audits = scratch.keep(_audited(scratch.keep(segments), scratch))
        nothing = {"seg": "long", "turn": rows.schema[turn].dataType, "role": "string", "text": "string", "body": "binary", "codes": "string", "audit": "string", "conv": rows.schema[conv].dataType}

        def shaped(df, what):
            return df.select("g", F.lit(what).alias("what"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

        marks = (rows if every is None else every).select(cols[conv].alias("conv")).distinct().withColumn("g", group(F.col("conv")))
        stream = shaped(marks, 0).unionByName(shaped(audits, 1)).unionByName(shaped(plain.drop("conv"), 2))
        # a conversation is read in order by one task, as its digest and its audit are one value each; rows stream by and only the letters are held
        stream = stream.repartition("g").sortWithinPartitions("g", "what", "seg", *order)
        kind = rows.schema[conv].dataType.simpleString()
        shape = f"conv {kind}, place long, edit string, role string, text string" if turns else f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
        out = stream.select("g", "what", "conv", "turn", "role", "text", "codes", "audit").mapInArrow(_walk(_arrow(rows.schema[conv].dataType), turns), shape)
        return kept(out.withColumnRenamed("conv", conv))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired turns of each conversation: conv, place (0, 1, 2, ...), edit (K kept, R another role, I inserted), role and text.

    Turns are read by turn, nulls first, those of one turn by role and the SHA-256 of their text; a null role or text counts as one space. Turns that are blank (nothing but white space) or repeat
    role and text of an earlier one are deleted at 3; others may be kept, given the role user or assistant at 2 or deleted at 3, and empty turns of both roles inserted at 2 anywhere;
    a turn that stays though it doesn't end in . ! or ? costs 1 more. Of the cheapest edits the ones whose letters (D, I, K, R) come first are made. Roles count by their first letter, and other ones than
    s, u and a can't stay. A null conv is a conversation; other columns are left; no rows give no rows.
    """
    return _repaired(rows, None, conv, turn, role, text, True)


def report(rows: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation of every, which holds those of rows (else of rows alone): gaps in its whole-numbered turns, blank, duplicate and truncated turns (by their first fault), adjacent roles that can't follow one another, the
    cost of its repair, its audit (the letters of the edits, as in repair) and the SHA-256 of the repaired turns, role:text, a line each. One without rows has zeros, no audit and the digest of nothing."""
    return _repaired(rows, every, conv, turn, role, text, False)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults put in by the CRC-32 of conv:turn modulo 20: dropped (0), emptied (1), without . ! ? (2), repeated (3), said by the user (4). Nulls count as one space."""
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    body: Column = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(space(text), ".!?", "")).otherwise(space(text))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    named = rows.where(fault != 0).select(F.col(f"`{conv}`").alias(conv), F.col(f"`{turn}`").alias(turn), F.when(fault == 4, F.lit("user")).otherwise(space(role)).alias(role), body.alias(text), copies.alias("_copy"))
    return named.drop("_copy")
