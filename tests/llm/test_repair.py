"""Conversation repair: the query and random conversations against all edits tried in order, memory, edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from msgwarden.llm import repair as p
from msgwarden.llm.catalog import op12_conversation_repair


def damage(conv_id, turn, role, text):
    role, text = (" " if x is None else x for x in (role, text))
    h = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
    if h == 0:
        return []
    text = {1: "", 2: re.sub("[.!?]", "", text)}.get(h, text)
    row = (turn, "user" if h == 4 else role, text)
    return [row, row] if h == 3 else [row]


def plain(rows):
    """Counts, cost, edits and digest by a table of whole edit strings, all ways kept in the open."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts, seen, faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for _, role, text in rows:
        shown = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    ways = {"": (0, "", ())}  # last initial so far (empty: nothing yet) to cost, edits, lines

    def inserts():
        for _ in range(4):
            for last, (cost, edits, lines) in list(ways.items()):
                to = "a" if last == "u" else "u"
                new = (cost + 3, edits + "I", (*lines, {"u": "user:", "a": "assistant:"}[to]))
                if to not in ways or new[:2] < ways[to][:2]:
                    ways[to] = new

    inserts()
    for (_, role, text), fault in zip(rows, faults):
        found, x, more = defaultdict(list), role[:1], 3 * (fault == "truncated")
        for last, (cost, edits, lines) in ways.items():
            found[last].append((cost + 4, edits + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            to = "a" if last == "u" else "u"
            if x == to or (x == "s" and last == ""):
                found[x].append((cost + more, edits + "K", (*lines, f"{role}:{text}")))
            found[to].append((cost + 3 + more, edits + "R", (*lines, {"u": "user:", "a": "assistant:"}[to] + text)))
        ways = {k: min(v, key=lambda w: w[:2]) for k, v in found.items()}
        inserts()
    cost, edits, lines = min((ways[k] for k in ("", "a") if k in ways), key=lambda w: w[:2])
    return (gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query(spark, sf_dir):
    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        groups[r.conv_id] += damage(*r)
    assert results(op12_conversation_repair(spark, sf_dir)) == {c: plain(rows)[0] for c, rows in groups.items()}


def random_rows(seed, convs, most):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "u", "", None]
    texts = ["a.", "b!", "c", "d ?\n", "", " \t", "e. f", None, "a.", "ü?", "x\x0b"]
    for c in range(convs):
        few = rng.sample(roles, rng.randint(1, 4))
        for _ in range(rng.randint(1, most)):
            own = f"{rng.randint(0, 999)}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((None if c == 3 else c, rng.choice([None, *range(8), *range(8)]), rng.choice(few), own))
    return rows


def test_random_conversations_against_all_ways(spark):
    rows = random_rows(5, 400, 14)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, seen int, first string").repartition(7)
    groups, hurt = defaultdict(list), defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn, *(" " if x is None else x for x in (role, text))))
        hurt[c] += damage(c, turn, role, text)
    assert results(p.repair_report(df)) == {c: plain(rs)[0] for c, rs in groups.items()}
    assert results(p.damage_report(df)) == {c: plain(rs)[0] for c, rs in hurt.items()}
    turns = defaultdict(list)
    for r in sorted(p.repaired_turns(df).collect(), key=lambda r: r.step):
        assert r.step == len(turns[r.conv_id])
        turns[r.conv_id].append(r)
    for c, rs in groups.items():
        whole, lines = plain(rs)
        assert "".join(r.edit for r in turns[c]) == whole[6]
        assert [f"{r.role}:{r.text}" for r in turns[c] if r.edit != "D"] == list(lines)


def test_memory_is_what_is_unresolved(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["user", "assistant"]), f"{i}.") for i in range(6000)]
    emitted, late, certain = [], 0, 0
    search = p.Search(lambda *edit: emitted.append(edit))
    for row in rows:
        search.row(row, row[1][0], False, False)
        certain = max([certain, *(e[2][0] for e in emitted[certain:] if e[2])])
        late = max(late, row[0] - certain)
    search.finish()
    assert late < 300 and "".join(e[0] for e in emitted) == plain(rows)[0][6]
    for roles in (["system"], ["user"], ["tool", "user", "user"], ["assistant", "assistant", "system"]):  # ties that stay open for long
        rows = [(i, roles[i % len(roles)], f"{i}.") for i in range(700)]
        emitted.clear()
        search = p.Search(lambda *edit: emitted.append(edit))
        for row in rows:
            search.row(row, row[1][0], False, False)
        assert (search.finish(), "".join(e[0] for e in emitted)) == plain(rows)[0][5:7]


def test_edges(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert p.repair_report(spark.createDataFrame([], shape)).collect() == [] == p.damage_report(spark.createDataFrame([], shape)).collect()
    gone = next(i for i in range(99) if not damage(i, 0, "user", "x"))
    rows = [(gone, 0, "user", "x"), (100, 1, "user", "q?" * 100_000), (100, 2, "assistant", "a" * 300_000 + ".")]
    found = results(p.damage_report(spark.createDataFrame(rows, shape)))
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[100] == plain([r for x in rows[1:] for r in damage(*x)])[0]
    one = spark.createDataFrame([(7, i // 40, ("user", "assistant")[i // 40 % 2], f"{i // 40}.") for i in range(20_000)], shape)  # each row 40 times
    (r,) = p.repair_report(one).collect()
    assert (r.duplicate, r.cost, r.illegal) == (19_500, 4 * 19_500, 19_500) and r.audit.count("K") == 500
