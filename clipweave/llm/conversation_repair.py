"""Repair of conversations by generalised LR parsing: the cheapest edits that make the roles fit a grammar."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rules over the roles' initials: an optional system turn, then pairs of user and assistant; or nothing.
RULES = (("C", ""), ("C", "sT"), ("C", "T"), ("T", "Tua"), ("T", "ua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: Turns, and bytes of text, of one block of a conversation; a text is never cut.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
_BLANKS = " \t\n\r\x0b\x0c"


# ---------------------------------------------------------------- the automaton


@dataclass(frozen=True)
class Node:
    """A stack's top; equal stacks are one node, and stacks share what lies below."""

    state: int
    below: Node | None


class Automaton:
    """LR states of RULES with lookahead by what may follow a symbol; a state may have several actions, which are all followed."""

    def __init__(self, rules=RULES, start: str = "C"):
        self.rules = rules
        heads = {h for h, _ in rules}
        closed = lambda items: self._closed(frozenset(items), heads)
        self.states = [closed({(k, 0) for k, (h, _) in enumerate(rules) if h == start})]
        self.next: dict[tuple[int, str], int] = {}
        for n, items in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({rules[k][1][at] for k, at in items if at < len(rules[k][1])}):
                to = closed({(k, at + 1) for k, at in items if rules[k][1][at : at + 1] == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.next[n, symbol] = self.states.index(to)
        follow = {h: {"$"} if h == start else set() for h in heads}
        while True:
            before = sum(map(len, follow.values()))
            for h, body in rules:
                for a, b in zip(body, [*body[1:], ""]):
                    if a in heads:
                        follow[a] |= follow[h] if not b else {b}
            if sum(map(len, follow.values())) == before:
                break
        self.ends = [{s: [k for k, at in items if at == len(rules[k][1]) and s in follow[rules[k][0]]] for s in (*"sua", "$")} for items in self.states]
        self.only = [next(iter(items))[0] if len(items) == 1 and all(at == len(rules[k][1]) for k, at in items) else None for items in self.states]
        self.known: dict[Node, Node] = {}
        self.start, self.goal = self._node(0, None), start

    def _closed(self, items: frozenset, heads: set[str]) -> frozenset:
        while True:
            wanted = {self.rules[k][1][at] for k, at in items if at < len(self.rules[k][1])} & heads
            more = items | {(k, 0) for k, (h, _) in enumerate(self.rules) if h in wanted}
            if more == items:
                return items
            items = more

    def _node(self, state: int, below: Node | None) -> Node:
        node = Node(state, below)
        return self.known.setdefault(node, node)

    def _reduced(self, top: Node, rule: int) -> Node | None:
        """The stack after a reduction; None where the whole input is reduced."""
        head, body = self.rules[rule]
        for _ in body:
            top = top.below
        to = self.next.get((top.state, head))
        return None if to is None else self._node(to, top)

    def tops(self, top: Node, ahead: str) -> list[Node | None]:
        """The stack and what its reductions before the symbol ahead make of it."""
        found = [top]
        for node in found:
            if node is not None:
                found += [n for k in self.ends[node.state][ahead] if (n := self._reduced(node, k)) not in found]
        return found

    @functools.cache  # noqa: B019
    def shifted(self, top: Node, symbol: str) -> tuple[Node, ...]:
        out = []
        for node in self.tops(top, symbol):
            if node is not None and (to := self.next.get((node.state, symbol))) is not None:
                new = self._node(to, node)
                while self.only[new.state] is not None:  # nothing else can happen there: reduced at once, so that equal stacks meet
                    new = self._reduced(new, self.only[new.state])
                out.append(new)
        return tuple(out)

    @functools.cache  # noqa: B019
    def accepts(self, top: Node) -> bool:
        return None in self.tops(top, "$")


AUTOMATON = Automaton()


def _stacks() -> list[Node]:
    found = [AUTOMATON.start]
    for top in found:
        found += [n for s in "sua" for n in AUTOMATON.shifted(top, s) if n not in found]
    return found


#: All stacks that the grammar can reach: they are few, as reductions keep them short. And whether the last role on one is a user.
STACKS = _stacks()
NUMBER = {n: k for k, n in enumerate(STACKS)}
_USER = [any(to == n.state for (_, s), to in AUTOMATON.next.items() if s == "u") for n in STACKS]

Best = dict[Node, tuple[int, str]]


def _inserted(best: Best) -> Best:
    """best, with turns inserted as far as that makes a stack cheaper."""
    out, fresh = dict(best), list(best)
    while fresh:
        top = fresh.pop()
        cost, audit = out[top]
        for symbol in ROLES:
            for new in AUTOMATON.shifted(top, symbol):
                if (goal := (cost + INSERT, audit + "I")) < out.get(new, (1 << 62, "")):
                    out[new] = goal
                    fresh.append(new)
    return out


def _put(best: Best, top: Node, goal: tuple[int, str]) -> None:
    if top not in best or goal < best[top]:
        best[top] = goal


def _parsed(kinds: str, start: int) -> tuple[tuple[int, int, str], ...]:
    """exit stack, cost and audit of the cheapest edits of turns from a stack, for each stack that they end on.

    kinds has a letter for each turn: its role's initial (``-``: another), a capital (``_``) if the text is cut short, ``x`` if it must
    go. All stacks go through the turns side by side; where two become equal, the one with the least (cost, audit) stays: edits of as
    many turns that end with a turn are never each other's beginning, so what follows can't turn their order around. Inserted turns
    belong to the turn that follows.
    """
    best: Best = {STACKS[start]: (0, "")}
    for kind in kinds:
        now: Best = {}
        role, short = kind.lower() if kind != "_" else "-", CUT if kind.isupper() or kind == "_" else 0
        for top, (cost, audit) in _inserted(best).items():
            _put(now, top, (cost + DELETE, audit + "D"))
            if kind != "x":
                for new in AUTOMATON.shifted(top, role) if role != "-" else ():
                    _put(now, new, (cost + short, audit + "K"))
                for symbol in ROLES:
                    for new in AUTOMATON.shifted(top, symbol):
                        _put(now, new, (cost + short + REROLE, audit + "R"))
        best = now
    return tuple((NUMBER[t], *goal) for t, goal in best.items())


_short = functools.lru_cache(1 << 16)(_parsed)


def moves(kinds: str, start: int) -> tuple[tuple[int, int, str], ...]:
    return (_short if len(kinds) <= 64 else _parsed)(kinds, start)


@functools.cache
def closing(stack: int) -> tuple[int, str]:
    """Cost and audit of the turns that complete a stack."""
    return min(goal for top, goal in _inserted({STACKS[stack]: (0, "")}).items() if AUTOMATON.accepts(top))


def repaired(roles: list[str], texts: list[str], audit: str, start: int) -> tuple[list[str], list[str]]:
    """The turns after the edits."""
    out_roles, out_texts, at, user = [], [], 0, _USER[start]
    for edit in audit:
        if edit != "D":
            role = roles[at] if edit == "K" else ROLES["a" if user else "u"]
            out_roles.append(role)
            out_texts.append("" if edit == "I" else texts[at])
            user = role[:1] == "u"
        at += edit != "I"
    return out_roles, out_texts


# ---------------------------------------------------------------- turns and their faults


def is_blank(text: str) -> bool:
    return not text.strip(_BLANKS)


def _kind(role: str, fault: str) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    return "x" if fault in ("blank", "duplicate") else {"-": "_"}.get(initial, initial.upper()) if fault else initial


def faults(roles: list[str], texts: list[str], first: set[int] | None = None) -> list[str]:
    """The first fault of each turn, or nothing. first: the places of turns that are not duplicates, if other blocks have a say in it."""
    seen, out = set(), []
    for k, turn in enumerate(zip(roles, texts)):
        again = turn in seen if first is None else k not in first
        seen.add(turn)
        out.append("blank" if is_blank(turn[1]) else "duplicate" if again else "truncated" if turn[1].rstrip(_BLANKS)[-1] not in ".!?" else "")
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:]))


_COUNTS = "n long, first_turn long, last_turn long, turns long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"
_KEYS = "conv_id long, part long, seq long"
_DONE = "cost long, audit string, roles array<string>, texts array<string>"
_COUNT_NAMES = [c.split()[0] for c in _COUNTS.split(", ")]


def _counted(turns: list, roles: list[str], found: list[str]) -> dict:
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    ends = {"first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)), "first_role": initials[0], "last_role": initials[-1]}
    return {"n": len(turns), **ends, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": illegal_pairs(initials)}


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    kinds |= {f"array<{k}>": pa.list_(t) for k, t in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def _batches(rows: Iterator[dict], schema: pa.Schema, many: int = 2000) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most so many rows, and of a few blocks' texts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.get("_bytes") or 0
        if len(held) >= many or size >= BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in held], schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in schema.names} for r in held], schema)


_CUT = f"{_KEYS}, whole boolean, given_turns array<long>, given_roles array<string>, given_texts array<string>, {_COUNTS}, {_DONE}"


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[dict]:
    """Blocks of conversations from turns in order; the first and the last conversation of a task may go on in another one."""
    part, seq, held, size, split, first = TaskContext.get().partitionId(), 0, [], 0, False, True

    def block(whole: bool) -> dict:
        nonlocal seq
        seq += 1
        own = {"conv_id": held[0][0], "part": part, "seq": seq, "whole": whole, "_bytes": size}
        turns, roles, texts = ([r[k] for r in held] for k in (1, 2, 3))
        if not whole:
            return own | {"given_turns": turns, "given_roles": roles, "given_texts": texts}
        found = faults(roles, texts)
        kinds = "".join(map(_kind, roles, found))
        cost, audit = min((cost + more[0], audit + more[1]) for end, cost, audit in moves(kinds, 0) for more in [closing(end)])
        new_roles, new_texts = repaired(roles, texts, audit, 0)
        return own | _counted(turns, roles, found) | {"cost": cost, "audit": audit, "roles": new_roles, "texts": new_texts}

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[0][0]:
                yield block(not (split or first))
                held, size, split, first = [], 0, False, False
            elif held and (len(held) >= most or size >= BLOCK_BYTES):
                yield block(False)
                held, size, split = [], 0, True
            held.append(row)
            size += len(row[3])
    if held:
        yield block(False)


_MOVES = f"{_KEYS}, given_roles array<string>, given_texts array<string>, {_COUNTS}, entries array<int>, exits array<int>, costs array<long>, ranks array<int>, audits array<string>"


def _block_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For blocks of longer conversations, the cheapest edits from every stack to every stack, with the audits' ranks."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                found = faults(r["given_roles"], r["given_texts"], set(r["firsts"] or ()))
                kinds = "".join(map(_kind, r["given_roles"], found))
                every = [(start, *m) for start in range(len(STACKS)) for m in moves(kinds, start)]
                rank = {a: k for k, a in enumerate(sorted({m[3] for m in every}))}
                out = {"entries": [m[0] for m in every], "exits": [m[1] for m in every], "costs": [m[2] for m in every], "ranks": [rank[m[3]] for m in every], "audits": [m[3] for m in every]}
                yield r | _counted(r["given_turns"], r["given_roles"], found) | out | {"_bytes": sum(map(len, r["given_texts"]))}

    yield from _batches(rows(), _arrow(_MOVES), 200)


def choose(blocks: list[tuple[list[int], list[int], list[int], list[int]]]) -> list[tuple[int, int, bool]]:
    """The way through the blocks (entries, exits, costs, ranks of their moves) with the least (cost, audit): each block's entry and exit; True for the last."""
    best, back = {0: (0, 0)}, []
    for entries, exits, costs, ranks in blocks:
        now: dict[int, tuple[int, int, int, int]] = {}
        for entry, end, cost, rank in zip(entries, exits, costs, ranks):
            if entry in best:
                goal = (best[entry][0] + cost, best[entry][1], rank, entry)
                now[end] = min(now.get(end, goal), goal)
        order = {x: k for k, x in enumerate(sorted({g[1:3] for g in now.values()}))}
        back.append({end: g[3] for end, g in now.items()})
        best = {end: (g[0], order[g[1:3]]) for end, g in now.items()}
    end = min(best, key=lambda e: (best[e][0] + closing(e)[0], best[e][1], closing(e)[1]))
    way = []
    for k in reversed(range(len(blocks))):
        way.append((back[k][end], end, k == len(blocks) - 1))
        end = back[k][end]
    return way[::-1]


def _chosen(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "seq"])
    way = choose(list(zip(group["entries"], group["exits"], group["costs"], group["ranks"])))
    return pd.DataFrame({"part": group["part"].to_numpy(), "seq": group["seq"].to_numpy(), "entry": [w[0] for w in way], "exit": [w[1] for w in way], "last": [w[2] for w in way]})


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                k = next(k for k, m in enumerate(zip(r["entries"], r["exits"])) if m == (r["entry"], r["exit"]))
                more = closing(r["exit"]) if r["last"] else (0, "")
                audit = r["audits"][k] + more[1]
                roles, texts = repaired(r["given_roles"], r["given_texts"], audit, r["entry"])
                yield r | {"cost": r["costs"][k] + more[0], "audit": audit, "roles": roles, "texts": texts, "_bytes": sum(map(len, texts))}

    yield from _batches(rows(), _arrow(f"{_KEYS}, {_COUNTS}, {_DONE}"), 200)


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of repaired conversations: conv_id, part and seq (their order), whole (the conversation is this one block), counts of the
    given turns and their faults, cost and audit of the edits, and the repaired roles and texts.

    turns: conv_id, turn, role, text; in a conversation by turn (nulls first), then role, then text. Null roles and texts are one space,
    a null conv_id is a conversation; repeated rows are turns of their own (and duplicates); other columns are ignored; an empty table
    gives no row. A blank or duplicate turn must go; a truncated one that stays costs more; see RULES and the costs.

    Turns are dealt out and sorted by ranges of (conversation, turn, role, text), so a long conversation is many tasks, cut into blocks.
    One that lies inside a task is parsed there. Of others, each block gives its cheapest edits from every stack to every stack; these
    few numbers are brought together by conversation to find the way, and the blocks are mended by it. Duplicates across blocks are
    found by digests, counted before they move.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # the ranges' bounds need no more than a text's start; rows are sorted by all of it
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    cut = saved(ordered.mapInArrow(lambda b: _batches(_blocks(b, block_rows), _arrow(_CUT)), _CUT), "turns")
    keys = ["part", "seq"]
    rest = cut.where("not whole").select("conv_id", *keys, "given_turns", "given_roles", "given_texts")
    each = rest.select("conv_id", *keys, F.posexplode(F.arrays_zip("given_roles", "given_texts")).alias("at", "t"))
    digest = F.sha2(F.concat(F.length("t.given_roles").cast("string"), F.lit(":"), "t.given_roles", "t.given_texts"), 256)
    firsts = each.groupBy("conv_id", digest.alias("digest")).agg(F.min(F.struct(*keys, "at")).alias("x")).groupBy("x.part", "x.seq").agg(F.collect_list("x.at").alias("firsts"))
    moved = saved(rest.join(firsts, keys, "left").select(*rest.columns, "firsts").mapInArrow(_block_moves, _MOVES), "moves")
    way = moved.select("conv_id", *keys, "entries", "exits", "costs", "ranks").groupBy("conv_id").applyInPandas(_chosen, "part long, seq long, entry int, exit int, last boolean")
    mended = moved.join(way, keys).mapInArrow(_mended, f"{_KEYS}, {_COUNTS}, {_DONE}")
    # what meets at the border of two blocks; turns are sorted, so only neighbours can be equal
    before = Window.partitionBy("conv_id").orderBy("part", "seq")
    known = F.last("last_turn", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    role = F.lag("last_role").over(before)
    fits = F.concat(role, "first_role").isin("su", "ua", "au") & (role != "") & (F.col("first_role") != "")
    mended = mended.withColumns({"turns": F.col("turns") - F.when(known == F.col("first_turn"), 1).otherwise(0), "illegal": F.col("illegal") + F.when(role.isNotNull() & ~fits, 1).otherwise(0)})
    columns = ["conv_id", *keys, "whole", *_COUNT_NAMES, "cost", "audit", "roles", "texts"]
    return cut.where("whole").select(*columns).union(mended.withColumn("whole", F.lit(False)).select(*columns))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation: the digest of its turns, block after block."""
    schema = _arrow("conv_id long, repaired_sha256 string")

    def rows() -> Iterator[dict]:
        state = None
        for batch in batches:
            for r in batch.to_pylist():
                if state and state[0] != r["conv_id"]:
                    yield {"conv_id": state[0], "repaired_sha256": state[1].hexdigest()}
                    state = None
                state = state or [r["conv_id"], hashlib.sha256(), False]
                for turn in zip(r["roles"], r["texts"]):
                    state[1].update((b"\n" if state[2] else b"") + ":".join(turn).encode())
                    state[2] = True
        if state:
            yield {"conv_id": state[0], "repaired_sha256": state[1].hexdigest()}

    yield from _batches(rows(), schema)


def summarize(blocks: DataFrame) -> DataFrame:
    """By conversation of repair's blocks: gaps, faults, illegal, cost, audit, and the digest of its repaired ``role:text`` lines. The lines of a conversation of several blocks are read in order, never held together."""
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")
    gaps = lambda first, last, turns: F.coalesce(last - first + 1 - turns, F.lit(0)).cast("long").alias("gaps")
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = blocks.where("whole").select("conv_id", gaps(F.col("first_turn"), F.col("last_turn"), F.col("turns")), *sums, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    rest = blocks.where("not whole")
    by = rest.groupBy("conv_id").agg(
        gaps(F.min("first_turn"), F.max("last_turn"), F.sum("turns")), *(F.sum(c).alias(c) for c in sums),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    digests = rest.select("conv_id", "part", "seq", "roles", "texts").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    found = by.join(digests.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*whole.columns)
    return whole.union(found)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations after faults were put in, by the crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1)))).drop("col")
