"""Spelling variants: the query against plain code, near pairs against all pairs, chains, hot keys and edges."""

import random
import re
import zlib
from collections import Counter

from msgwarden.llm import spelling as s
from msgwarden.llm.catalog import op11_spelling_variants

LOWER = str.maketrans(s.UPPER, s.LOWER)


def plain_words(docs, every=97, least=5, times=3):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= times}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(words):
    out, forms = {}, {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
        out[w] = [forms[w], None, n, len(near), words[forms[w]] if forms[w] else None]
    for w in out:
        root = w
        while forms[root]:
            root = forms[root]
        out[w][1] = root
    return {(w, *v) for w, v in out.items()}


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = rows_of(op11_spelling_variants(spark, sf_dir))
    words = plain_words(docs)
    assert len(rows) == len(words) and {(r[0], r[3]) for r in rows} == set(words.items())
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    near = Counter(w for w in words for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v))
    assert {r[0]: r[4] for r in rows} == {w: near[w] for w in words}
    forms = {r[0]: r[1] for r in rows}
    assert sum(f is not None for f in forms.values()) > 50
    for word, form, root, n, _, form_n in rows:
        assert form is None or (one_edit(word, form) and form_n == words[form] >= 2 * n)
        while forms[word]:
            word = forms[word]
        assert root == word


def alike(seed, count, letters="abé", low=1, high=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(low, high))): rng.randint(1, 40) for _ in range(count)}


def test_near_words_against_all_pairs(spark):
    words = alike(1, 500) | {"x" * 300: 9, "x" * 299 + "y": 20, "x" * 301: 5, "日本語の文": 3, "日本の文": 8, "a😀bcd": 2, "abcd": 4, "a😀cd": 4}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = plain(words)
    for most in (s.PAIRS, 1, 40):  # crowded keys are cut again, down to single characters
        assert set(rows_of(s.variants(df, most=most))) == expected
        pairs = [tuple(r) for r in s.near_pairs(df.select("word"), most).collect()]
        assert len(pairs) == len(set(pairs))


def test_chains_are_followed_to_the_last(spark):
    words = {"".join("b" if j < i else "a" for j in range(12)): 2**i for i in range(13)}
    rows = rows_of(s.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {r[2] for r in rows} == {"b" * 12} and set(rows) == plain(words)


def test_no_words_are_sent_whole(spark, monkeypatch):
    words = alike(3, 60, "ab", 3, 9)
    plans, keep = [], s.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(s, "written", lambda df: keep(plan(df)))
    got = plan(s.variants(s.written(spark.createDataFrame(list(words.items()), "word string, n long"))))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not [p for p in plans if "Broadcast" in p]
    assert set(rows_of(got)) == plain(words)


def test_edges(spark):
    texts = [
        (1, "Hello HELLO hello. hallo ÀÉÎ àéî"), (1, "Hello HELLO hello. hallo ÀÉÎ àéî"), (None, "hallo hallo-hallo 1hallo2 Strasse"), (2, None), (3, ""),
        (4, "x" * 50_000 + " " + "y" * 50_000), (5, "x" * 50_000), (6, "x" * 50_000), (7, "x" * 50_001), (8, "x" * 50_001), (9, "x" * 50_001), (10, "×÷ÿßà ×÷ÿßà ×÷ÿßà"),
    ]
    df = spark.createDataFrame([(*t, "q", 0) for t in texts], "doc_id long, text string, word string, n int")
    for every in (97, 2, 0):
        words = plain_words(texts, every)
        assert set(rows_of(s.spelling_variants(df, every=every))) == plain(words) and words
    assert s.spelling_variants(df.limit(0)).collect() == []
    assert s.variants(spark.createDataFrame([(None, 3)], "word string, n long")).collect() == []
