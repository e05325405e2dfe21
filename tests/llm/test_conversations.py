"""Repair of conversations against plain searches over all edits."""

import hashlib
import itertools
import random

import pytest

from stateglass.llm.conversations import (
    ENDS, EXPECTED, AFTER_EXPECTED, KEPT, STATES, chain, cheapest, letter, repair_conversations, repaired_messages,
)
from stateglass.llm.queries_structure import damaged

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def plain_paths(codes, start, insert_last=True):
    """Least (cost, audit) per state by a table over all nodes; at most four inserts in a row."""

    def inserted(reached):
        out = dict(reached)
        for _ in range(4):
            for s, (cost, audit) in list(out.items()):
                option = (cost + 3, audit + "I")
                t = AFTER_EXPECTED[s]
                out[t] = min(out.get(t, option), option)
        return out

    reached = {start: (0, "")}
    for code in codes:
        initial, kind = "?sua"[(ord(code) - 65) // 3], (ord(code) - 65) % 3
        after = {}
        for s, (cost, audit) in inserted(reached).items():
            options = [(s, 4, "D")]
            if kind != 1:
                more = 3 if kind == 2 else 0
                options.append((AFTER_EXPECTED[s], 3 + more, "R"))
                if initial in KEPT[s]:
                    options.append((KEPT[s][initial], more, "K"))
            for t, price, edit in options:
                option = (cost + price, audit + edit)
                after[t] = min(after.get(t, option), option)
        reached = after
    return inserted(reached) if insert_last else reached


LETTERS = [letter(i, k) for i in ("x", "s", "u", "a") for k in range(3)]


def test_search_finds_least_audit_of_short_rows():
    for n in range(4):
        for codes in itertools.product(LETTERS, repeat=n):
            found = plain_paths(codes, 0)
            want = min(found[e] for e in ENDS if e in found)
            assert cheapest("".join(codes), 0, ENDS, True) == want


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_chain_to_the_whole(size):
    rng = random.Random(size)
    for _ in range(150):
        codes = "".join(rng.choices(LETTERS, k=rng.randrange(1, 30)))
        found = plain_paths(codes, 0)
        want = min(found[e] for e in ENDS if e in found)
        assert cheapest(codes, 0, ENDS, True) == want
        cut = [codes[i : i + size] for i in range(0, len(codes), size)]
        segments = []
        for k, piece in enumerate(cut):
            last = k == len(cut) - 1
            goals = [ENDS] if last else [(s,) for s in STATES]
            every = [(s, g[0], cheapest(piece, s, g, last)) for s in ((0,) if k == 0 else STATES) for g in goals]
            segments.append({"paths": [{"start": s, "goal": g, "cost": p[0], "audit": p[1]} for s, g, p in every if p]})
        assert chain(segments) == want


def plain_repair(rows):
    rows = sorted(
        ((t, r, x) for t, r, x in rows),
        key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).digest()),
    )
    seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        end, kind = text.rstrip(BLANK), 0
        if not end:
            kind = 1
            counts["blank"] += 1
        elif (role, text) in seen:
            kind = 1
            counts["duplicate"] += 1
        elif end[-1] not in ".!?":
            kind = 2
            counts["truncated"] += 1
        seen.add((role, text))
        codes += letter(role[:1], kind)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    found = plain_paths(codes, 0)
    cost, audit = min(found[e] for e in ENDS if e in found)
    said, state, left = [], 0, iter(rows)
    for edit in audit:
        if edit == "I":
            said.append((edit, EXPECTED[state], ""))
            state = AFTER_EXPECTED[state]
            continue
        _, role, text = next(left)
        if edit == "K":
            said.append((edit, role, text))
            state = KEPT[state][role[0]]
        elif edit == "R":
            said.append((edit, EXPECTED[state], text))
            state = AFTER_EXPECTED[state]
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in said).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest), said


def random_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(rng.randrange(1, longest)):
            turn = rng.choice([None, *range(longest)])
            role = rng.choice(["user", "assistant", "system", "tool", "user", "assistant", "", None])
            text = rng.choice(["Hi.", "Yes!", "what", "", " \n", "é? ", "a long one. " * 50, "ok\x0b", None, "end.\x00"])
            rows.append((conv, turn, role, text))
    return rows


@pytest.mark.parametrize("segment_rows", [1024, 3])
def test_table_matches_plain_repair(spark, segment_rows):
    rows = random_rows(4, 40, 14) + [(7, k, "user", "same.") for k in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r[0]: tuple(r[1:]) for r in repair_conversations(frame, segment_rows=segment_rows).collect()}
    said = {}
    for r in repaired_messages(frame, segment_rows=segment_rows).collect():
        said.setdefault(r.conv_id, []).append((r.pos, r.edit, r.role, r.text))
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got.keys() == convs.keys()
    for conv, messages in convs.items():
        figures, lines = plain_repair(messages)
        assert got[conv] == figures
        assert [m[1:] for m in sorted(said.get(conv, []))] == lines


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"Text {t}. Yes!") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    got = sorted(map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        changed = (c, t, "user" if fault == 4 else role, {1: "", 2: text.replace(".", "").replace("!", "")}.get(fault, text))
        want += [changed] * {0: 0, 3: 2}.get(fault, 1)
    assert got == sorted(want, key=repr)


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", "A.", "x", 5)], SCHEMA + ", found string, `a.b` int")
    row = repair_conversations(odd).collect()[0]
    assert (row.cost, row.audit) == (3, "KI")
    renamed = odd.withColumnsRenamed({"conv_id": "c.id", "text": "at"})
    row = repair_conversations(renamed, conv="c.id", text="at").collect()[0]
    assert (row["c.id"], row.audit) == (1, "KI")
