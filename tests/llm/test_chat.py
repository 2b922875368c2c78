"""Conversations against a plain walk over their rows, and reply trees against a recursive one."""

import hashlib
import random

from msgwarden.llm import chat
from msgwarden.llm.catalog import op1_chat_formatting


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def plain(rows):
    convs = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    found = {}
    for c, turns in convs.items():
        own = [t for r, t in turns if r == "assistant"]
        found[c] = (len(turns), digest(turns), sum(map(len, own)), hashlib.sha256("".join(own).encode()).hexdigest())
    return found


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert {r.conv_id: tuple(r)[1:5] for r in op1_chat_formatting(spark, sf_dir).collect()} == plain(rows)


def test_edges(spark):
    random.seed(2)
    bits = ["<", "|", ">", "\\", "</s>", "<s>", "[INST]", "[/INST]", "<|", "|>", "\n", "<<SYS>>", "<</SYS>>", "é", "x", "[", "</s", "😀"]
    rows = [(i % 7, i // 7, random.choice(["user", "assistant", "sys<|tem\\", None]), "".join(random.choices(bits, k=random.randrange(12)))) for i in range(300)]
    rows += [(None, 1, "user", None), (None, 0, "assistant", ""), (3, 5, "user", "tie"), (3, 5, "user", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    formatted = chat.format_conversations(df)
    assert {r.conv_id: tuple(r)[1:5] for r in chat.read_back(formatted).collect()} == plain(rows)
    for r in formatted.collect():
        for control in ("[INST]", "[/INST]", "<s>", "<<SYS>>"):
            assert control not in r.text
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_trees(spark):
    """Branches of random trees, with a circle and an orphan."""
    random.seed(4)
    nodes = []
    for tree in range(6):
        for i in range(60):
            parent = None if i == 0 else tree * 100 + random.randrange(max(0, i - 8), i)
            nodes.append((tree, tree * 100 + i, parent, "assistant" if i % 2 else "user", f"t{tree}n{i}", float(random.randrange(5)) if i % 7 else None))
    nodes += [(9, 900, 901, "user", "circle", 1.0), (9, 901, 900, "user", "circle", 1.0), (9, 902, 555_555, "user", "orphan", 1.0)]
    by_id = {n[1]: n for n in nodes}
    parents = {n[2] for n in nodes}
    expected = []
    for tree in (*range(6), 9):
        paths = []
        for n in (n for n in nodes if n[0] == tree and n[1] not in parents):
            path = [n]
            while path[-1][2] in by_id:
                path.append(by_id[path[-1][2]])
            paths.append((-sum(p[5] or 0.0 for p in path) / len(path), -len(path), n[1], path[::-1]))
        for rank, (score, _, _, path) in enumerate(sorted(paths)[:3], 1):
            expected.append((tree, rank, round(-score, 9), digest([(p[3], p[4]) for p in path])))
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    got = chat.format_paths(df, paths=3).collect()
    assert sorted((r.tree, r.path_rank, round(r.path_score, 9), digest(chat.turns_of(r.text))) for r in got) == sorted(expected)


def test_forests_with_other_columns(spark):
    nodes = spark.createDataFrame([(1, 1, None, "user", "q", 1.0, 5, "x"), (1, 2, 1, "assistant", "a", 2.0, 6, "y")],
                                  "tree long, node long, parent long, role string, text string, score double, known int, head string")
    (row,) = chat.format_paths(nodes).collect()
    assert "q" in row.text and len(row.loss) == 1
    assert chat.format_paths(nodes.limit(0)).collect() == []
