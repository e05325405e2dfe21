"""Cheapest repair of conversations by bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state of the role grammar ``(s?(ua)+)?``), an edge
one edit: Keep, Rerole, Delete or Insert. Forward and reverse heaps run towards each
other until no cheaper or equally cheap path can be missing; every crossing of the least
cost is finished, and the least of the joined audits (one letter per edit) wins.

As a Spark job: rows get a position in the whole table by measured ranges
(``global_index``), so a conversation of any length is cut into segments of at most
``SEGMENT_ROWS`` rows. Only one letter per row reaches the search. A segment of a longer
conversation is searched from and to every state, and the segments are then chained.
Texts are shuffled once, at the end, when they stream through their audit.

Defined cases: null roles and texts count as one space; rows of a conversation go by
turn (nulls first), then role, then SHA-256 of the text; repeated rows are duplicates
from the second on; a null conversation id is a conversation; a role whose first
character is not s, u or a cannot be kept; an empty table gives no rows. Columns beside
the four named ones are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stateglass.llm.common import part_count, written
from stateglass.operators.order import global_index

SEGMENT_ROWS = 1024
# Searches a worker remembers; short conversations have few patterns.
CACHED_SEARCHES = 50_000

BLANKS = " \t\n\x0b\x0c\r"
LEGAL_PAIRS = ("su", "ua", "au")

# A row is one letter: initial of its role (other, s, u, a) times its kind.
INITIALS = "?sua"
FINE, GONE, TRUNCATED = range(3)  # GONE rows must be deleted

# States of the grammar: nothing yet, after s, after u, after a. It may end in the
# first or the last.
START, ENDS = 0, (0, 3)
STATES = range(4)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
EXPECTED = ("user", "user", "assistant", "user")
AFTER_EXPECTED = (2, 2, 3, 2)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 3, 4, 3, 3


def letter(initial: str, kind: int) -> str:
    at = INITIALS.find(initial) if initial else 0
    return chr(ord("A") + 3 * max(at, 0) + kind)


def _edges(code: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edit) of the edits that read the row of this letter."""
    at, kind = divmod(ord(code) - ord("A"), 3)
    found = [(s, s, COST_DELETE, DELETE) for s in STATES]
    if kind != GONE:
        more = COST_TRUNCATED if kind == TRUNCATED else 0
        for s in STATES:
            found.append((s, AFTER_EXPECTED[s], COST_REROLE + more, REROLE))
            if INITIALS[at] in KEPT[s]:
                found.append((s, KEPT[s][INITIALS[at]], more, KEEP))
    return found


_LETTERS = [chr(ord("A") + i) for i in range(3 * len(INITIALS))]
_FORWARD = {c: [[e[1:] for e in _edges(c) if e[0] == s] for s in STATES] for c in _LETTERS}
_REVERSE = {c: [[(e[0], *e[2:]) for e in _edges(c) if e[1] == s] for s in STATES] for c in _LETTERS}
_INSERTED_FROM = [[s for s in STATES if AFTER_EXPECTED[s] == t] for t in STATES]


@lru_cache(CACHED_SEARCHES)
def cheapest(codes: str, start: int, goals: tuple[int, ...], insert_last: bool) -> tuple[int, str] | None:
    """Least (cost, audit) from ``start`` before all rows to a goal state after them.

    ``insert_last`` allows inserts after the last row. Heaps go by cost, then by rows
    read (forward) or left (reverse): the only free edit, Keep, reads a row, so every
    label of a node is there when the node is taken.
    """
    n = len(codes)
    forward, reverse = {(0, start): (0, "")}, {(n, g): (0, "") for g in goals}
    ahead, behind = [(0, 0, start)], [(0, 0, g) for g in goals]
    done_f: set[tuple[int, int]] = set()
    done_r: set[tuple[int, int]] = set()
    best: tuple[int, str] | None = None
    while ahead or behind:
        least = (ahead[0][0] if ahead else 0) + (behind[0][0] if behind else 0)
        if best is not None and least > best[0]:
            break
        if ahead and (not behind or ahead[0][0] <= behind[0][0]):
            cost, i, state = heappop(ahead)
            node = (i, state)
            if node in done_f:
                continue
            done_f.add(node)
            audit = forward[node][1]
            if node in done_r:
                best = _lesser(best, cost + reverse[node][0], audit + reverse[node][1])
            steps = [(i + 1, *e) for e in _FORWARD[codes[i]][state]] if i < n else []
            if i < n or insert_last:
                steps.append((i, AFTER_EXPECTED[state], COST_INSERT, INSERT))
            for to, after, price, edit in steps:
                label, other = (cost + price, audit + edit), (to, after)
                if other in done_r:
                    best = _lesser(best, label[0] + reverse[other][0], label[1] + reverse[other][1])
                if other not in done_f and (other not in forward or label < forward[other]):
                    forward[other] = label
                    heappush(ahead, (label[0], to, after))
        else:
            cost, left, state = heappop(behind)
            i = n - left
            node = (i, state)
            if node in done_r:
                continue
            done_r.add(node)
            audit = reverse[node][1]
            if node in done_f:
                best = _lesser(best, cost + forward[node][0], forward[node][1] + audit)
            steps = [(i - 1, *e) for e in _REVERSE[codes[i - 1]][state]] if i else []
            if i < n or insert_last:
                steps += [(i, s, COST_INSERT, INSERT) for s in _INSERTED_FROM[state]]
            for to, before, price, edit in steps:
                label, other = (cost + price, edit + audit), (to, before)
                if other in done_f:
                    best = _lesser(best, label[0] + forward[other][0], forward[other][1] + label[1])
                if other not in done_r and (other not in reverse or label < reverse[other]):
                    reverse[other] = label
                    heappush(behind, (label[0], n - to, before))
    return best


def _lesser(best: tuple[int, str] | None, cost: int, audit: str) -> tuple[int, str]:
    return (cost, audit) if best is None else min(best, (cost, audit))


def illegal_pairs(codes: str) -> int:
    initials = "".join(INITIALS[(ord(c) - ord("A")) // 3] for c in codes)
    return sum(initials[i : i + 2] not in LEGAL_PAIRS for i in range(len(initials) - 1))


def chain(segments: list[dict]) -> tuple[int, str]:
    """Least (cost, audit) over segments in order, each with its ``paths``.

    All but the last segment end with a row that is read, so no audit up to a border is
    the beginning of another one. Audits of equal cost are therefore told apart by the
    order of what came before, then by the new piece: a comparison of small things.
    """
    # state: (cost, rank of the audit among the states, pieces as a linked list)
    reached = {START: (0, 0, None)}
    for segment in segments:
        options: dict[int, tuple] = {}
        for p in segment["paths"]:
            if p["start"] in reached:
                cost, rank, pieces = reached[p["start"]]
                option = (cost + p["cost"], rank, p["audit"], pieces)
                if p["goal"] not in options or option[:3] < options[p["goal"]][:3]:
                    options[p["goal"]] = option
        order = sorted({o[1:3] for o in options.values()})
        reached = {g: (o[0], order.index(o[1:3]), (o[2], o[3])) for g, o in options.items()}
    cost, _, pieces = min((reached[e] for e in ENDS if e in reached), key=lambda o: o[:2])
    found = []
    while pieces is not None:
        found.append(pieces[0])
        pieces = pieces[1]
    return cost, "".join(reversed(found))


def repair_conversations(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """One row per conversation: what is wrong with it and its cheapest repair.

    ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``;
    the digest is over the repaired ``role:text`` joined by newlines.
    """
    found = plan_repairs(rows, conv, turn, role, text, segment_rows)
    found = _streamed(rows, found, conv, turn, role, text, messages=False)
    return found.select(F.col("conv.id").alias(conv), "found.*", F.col("sha").alias("repaired_sha256"))


def repaired_messages(
    rows: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """The repaired conversations, one row per message: ``conv, pos, edit, role, text``."""
    found = plan_repairs(rows, conv, turn, role, text, segment_rows)
    found = _streamed(rows, found, conv, turn, role, text, messages=True)
    return found.select(F.col("conv.id").alias(conv), "pos", "edit", "role", "text")


def plan_repairs(
    rows: DataFrame, conv: str, turn: str, role: str, text: str, segment_rows: int
) -> DataFrame:
    """``conv`` (a struct, never null) and ``found``, a struct of faults, cost and audit."""
    plain = _plain(rows, conv, turn, role, text)
    ending = F.rtrim("text", F.lit(BLANKS))
    narrow = plain.select(
        "conv",
        "turn",
        "role",
        "digest",
        (ending == "").alias("blank"),
        (~F.substring(ending, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    ranked = global_index(narrow, ["conv", "turn", "role", "digest"], "at")

    # The first row of every (role, text) of a conversation, found by map-side minima.
    same = F.struct("conv", "role", "digest")
    firsts = ranked.groupBy(same.alias("same")).agg(F.min("at").alias("first"))
    marked = (
        ranked.withColumn("same", same)
        .join(firsts, "same")
        .withColumn("duplicate", ~F.col("blank") & (F.col("at") > F.col("first")))
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("truncated"))
    )
    initial = F.substring("role", 1, 1)
    at = F.when(initial.isin(*INITIALS[1:]), F.call_function("locate", initial, F.lit(INITIALS)) - 1).otherwise(0)
    kind = F.when(F.col("blank") | F.col("duplicate"), GONE).when(F.col("truncated"), TRUNCATED).otherwise(FINE)
    marked = marked.select(
        "conv", "at", "turn", "blank", "duplicate", "truncated", F.char(F.lit(ord("A")) + 3 * at + kind).alias("code")
    )
    marked = written(marked, "conversation-rows")

    # Conversations are told apart by the place of their first row.
    faults = ("blank", "duplicate", "truncated")
    stats = (
        marked.groupBy("conv", "turn")
        .agg(F.min("at").alias("start"), F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in faults])
        .groupBy("conv")
        .agg(
            F.min("start").alias("start"),
            F.sum("n").alias("n_rows"),
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
            *[F.sum(c).alias(c) for c in faults],
        )
    )
    where = F.call_function("div", F.col("at") - F.col("start"), F.lit(segment_rows).cast("long"))
    segments = (
        marked.join(stats.select("conv", "start", "n_rows"), "conv")
        .groupBy("start", where.alias("segment"))
        .agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
        .select(
            "start",
            "segment",
            F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"),
            (F.call_function("div", F.col("n_rows") - 1, F.lit(segment_rows).cast("long"))).alias("last"),
        )
    )
    path = "array<struct<start:int,goal:int,cost:long,audit:string>>"
    solved = segments.mapInArrow(_solve, f"start long, segment long, last long, codes string, illegal long, paths {path}")
    solved = written(solved, "conversation-segments")
    whole = solved.where("last = 0").select(
        "start", "illegal", F.col("paths")[0]["cost"].alias("cost"), F.col("paths")[0]["audit"].alias("audit")
    )
    chained = (
        solved.where("last > 0")
        .groupBy("start")
        .applyInArrow(_chain, "start long, illegal long, cost long, audit string")
    )
    return stats.join(whole.unionByName(chained), "start").select(
        "conv", F.struct("gaps", *faults, "illegal", "cost", "audit").alias("found")
    )


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    def column(name: str) -> Column:
        return F.col(f"`{name}`")

    def spaced(name: str) -> Column:
        return F.coalesce(column(name).cast("string"), F.lit(" "))

    plain = rows.select(
        F.struct(column(conv).alias("id")).alias("conv"),
        column(turn).cast("long").alias("turn"),
        spaced(role).alias("role"),
        spaced(text).alias("text"),
    )
    return plain.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        illegal, paths = [], []
        for codes, segment, last in zip(*[batch.column(c).to_pylist() for c in ("codes", "segment", "last")]):
            illegal.append(illegal_pairs(codes))
            starts = (START,) if segment == 0 else tuple(STATES)
            goals = [ENDS] if segment == last else [(s,) for s in STATES]
            searched = [(s, g[0], cheapest(codes, s, g, segment == last)) for s in starts for g in goals]
            paths.append(
                [{"start": s, "goal": g, "cost": p[0], "audit": p[1]} for s, g, p in searched if p is not None]
            )
        kept = {c: batch.column(c) for c in ("start", "segment", "last", "codes")}
        kind = pa.list_(pa.struct([("start", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_pydict(
            {**kept, "illegal": pa.array(illegal, pa.int64()), "paths": pa.array(paths, kind)}
        )


def _chain(found: pa.Table) -> pa.Table:
    """The segments of one conversation put together; it holds its audits, never texts."""
    segments = found.sort_by("segment").to_pylist()
    cost, audit = chain(segments)
    borders = sum(illegal_pairs(a["codes"][-1] + b["codes"][0]) for a, b in zip(segments, segments[1:]))
    illegal = sum(s["illegal"] for s in segments) + borders
    result = {"start": [segments[0]["start"]], "illegal": [illegal], "cost": [cost], "audit": [audit]}
    return pa.table(result, pa.schema([("start", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))


def _streamed(
    rows: DataFrame, repairs: DataFrame, conv: str, turn: str, role: str, text: str, messages: bool
) -> DataFrame:
    """Texts in order behind the audit of their conversation, read as a stream.

    A task keeps one audit and one digest, whatever the length of a conversation.
    """
    plain = _plain(rows, conv, turn, role, text)
    heads = repairs.withColumn("tag", F.lit(0))
    lines = plain.withColumn("tag", F.lit(1)).unionByName(heads, allowMissingColumns=True)
    ordered = lines.repartition(part_count(rows.sparkSession), "conv").sortWithinPartitions(
        "conv", "tag", "turn", "role", "digest"
    )
    schema = repairs.schema
    if messages:
        made = f"conv {schema['conv'].dataType.simpleString()}, pos long, edit string, role string, text string"
        return ordered.select("conv", "tag", "role", "text", "found").mapInArrow(_messages, made)
    made = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", sha string"
    return ordered.select("conv", "tag", "role", "text", "found").mapInArrow(_digests, made)


class Walk:
    """Applies an audit to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            role, self.state, self.at = EXPECTED[self.state], AFTER_EXPECTED[self.state], self.at + 1
            yield INSERT, role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = KEPT[self.state][role[0]]
            yield KEEP, role, text
        elif edit == REROLE:
            yield REROLE, EXPECTED[self.state], text
            self.state = AFTER_EXPECTED[self.state]


def _lines(batches: Iterator[pa.RecordBatch]):
    """(row number, its batch, tag, role, text, audit) of every line."""
    for batch in batches:
        found = batch.column("found").field("audit").to_pylist()
        tags, roles, texts = (batch.column(c).to_pylist() for c in ("tag", "role", "text"))
        for k in range(batch.num_rows):
            yield k, batch, tags[k], roles[k], texts[k], found[k]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = head = digest = None
    empty = True

    def add(parts) -> None:
        nonlocal empty
        for _, role, text in parts:
            digest.update((b"" if empty else b"\n") + f"{role}:{text}".encode())
            empty = False

    def result() -> pa.RecordBatch:
        add(walk.inserts())
        return pa.RecordBatch.from_arrays(
            [*(head.column(c) for c in ("conv", "found")), pa.array([digest.hexdigest()])], ["conv", "found", "sha"]
        )

    done: list[pa.RecordBatch] = []
    for k, batch, tag, role, text, audit in _lines(batches):
        if tag == 0:
            if walk is not None:
                done.append(result())
                if len(done) >= 1000:
                    yield _joined(done)
                    done = []
            walk, head, digest, empty = Walk(audit), batch.slice(k, 1), hashlib.sha256(), True
        else:
            add(walk.row(role, text))
    if walk is not None:
        done.append(result())
        yield _joined(done)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk = head = None
    pos = 0
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        convs = pa.concat_arrays([r[0] for r in rows])
        columns = [pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()), (4, pa.string()))]
        return pa.RecordBatch.from_arrays([convs, *columns], ["conv", "pos", "edit", "role", "text"])

    def add(parts) -> None:
        nonlocal pos
        for edit, role, text in parts:
            rows.append((head, pos, edit, role, text))
            pos += 1

    for k, batch, tag, role, text, audit in _lines(batches):
        if tag == 0:
            if walk is not None:
                add(walk.inserts())
            walk, head, pos = Walk(audit), batch.column("conv").slice(k, 1), 0
        else:
            add(walk.row(role, text))
        if len(rows) >= 1000:
            yield made()
            rows.clear()
    if walk is not None:
        add(walk.inserts())
    if rows:
        yield made()
