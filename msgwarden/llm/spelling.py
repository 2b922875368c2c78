"""Spelling variants: words one edit apart, met by asymmetric q-chunks, and the form each is a variant of.

Of two words at most one character apart in length, the shorter one gives two disjoint chunks, its halves, and the other
one its positional grams of the same lengths. One edit leaves one of the halves whole, and that half stands in the other
word where it was, or one place on; so words are joined on (length, half, gram) within a shift of one and then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, written

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that would compare more pairs than this is split by the halves of what is left of the words.
PAIRS = 1 << 20


def ascii_lower(text: Column) -> Column:
    """`text` with A-Z in lower case; the slower replacement runs only where anything is in upper case."""
    return F.when(F.lower(text) == text, text).otherwise(F.translate(text, UPPER, LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, run): every letter run of at least `least` characters, A-Z in lower case. A null text has none."""
    found = F.regexp_extract_all(col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    rows = docs.select(col(id_col).cast("string").alias("id"), F.explode(found).alias("run"))
    return rows.where(F.length("run") >= least).select("id", ascii_lower(F.col("run")).alias("run"))


def misspelt(rows: DataFrame, every: int = 97) -> DataFrame:
    """`word` for every run: where `every` divides the CRC-32 of id and run, one character less."""
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    return rows.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """(word, n) of the words of at least `least` characters met at least `times` times; counts combine before the shuffle."""
    long_ = words.where(F.length("word") >= least)
    return long_.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def _sorted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that sorts both sides and sends neither whole: words stored compressed and rows of an explode are sized far too
    low, and the driver would gather what passes for a small table."""
    return left.join(right.hint("merge"), on, how)


def _chunks(rows: DataFrame) -> DataFrame:
    """The halves of what is left of each word, from `lo` to `hi`, and what is left beside them."""
    halves = F.expr(
        """array(
            struct(0 AS half, substring(word, lo + 1, q) AS piece, lo + q AS lo, hi AS hi),
            struct(1 AS half, substring(word, lo + q + 1, r - q) AS piece, lo AS lo, lo + q AS hi))"""
    )
    sized = rows.withColumn("r", F.expr("hi - lo")).withColumn("q", F.expr("int(r div 2)"))
    cut = sized.select("word", "path", "r", F.explode(halves).alias("c"))
    return cut.select("word", F.xxhash64("path", "r", "c.half", "c.piece").alias("path"), "c.lo", "c.hi", "r")


def _grams(rows: DataFrame) -> DataFrame:
    """Grams of what is left of each word at every place within one of where a half of a word of the same length or one
    less can stand. `still`: the place a half keeps when the edit is beside it, counted from its own end of the word."""
    places = F.expr(
        """flatten(transform(array(m, m - 1), r -> concat(
            transform(filter(array(0, 1), s -> s + r div 2 <= m), s -> struct(
                r, 0 AS half, s = 0 AS still, substring(word, int(lo + s + 1), int(r div 2)) AS piece, int(lo + r div 2) AS lo, hi AS hi)),
            transform(filter(array(-1, 0, 1), s -> r div 2 + s >= 0 AND s + r <= m), s -> struct(
                r, 1 AS half, s = m - r AS still, substring(word, int(lo + r div 2 + s + 1), int(r - r div 2)) AS piece,
                lo AS lo, int(hi - r + r div 2) AS hi)))))"""
    )
    cut = rows.withColumn("m", F.expr("hi - lo")).where("m > 0").select("word", "path", F.explode(places).alias("g")).where("g.r >= 0")
    return cut.select("word", F.xxhash64("path", "g.r", "g.half", "g.piece").alias("path"), "g.lo", "g.hi", "g.still", "g.r")


# Whether b is a with one character replaced or put in. The built-in distance takes time that grows with the square of the
# length; for long words the first difference is found by halving, and what follows it is compared.
_STEPS = ", ".join(str(1 << k) for k in reversed(range(30)))
_SAME = f"aggregate(array({_STEPS}), 0, (p, k) -> IF(p + k <= length(a) AND left(a, p + k) = left(b, p + k), p + k, p))"
_ONE_EDIT = f"""CASE WHEN length(b) - length(a) NOT IN (0, 1) OR a = b THEN false
    WHEN length(b) <= 100 THEN levenshtein(a, b, 1) = 1
    ELSE substring(a, {_SAME} + 1 + length(a) - length(b) + 1) = substring(b, {_SAME} + 2) END"""


def near_pairs(words: DataFrame, most: int = PAIRS) -> DataFrame:
    """(a, b): every two different words of `words` (word: string, distinct) exactly one insertion, deletion or
    replacement of a character apart, once, the shorter or else smaller one first.

    A key shared by so many words that more than `most` pairs would be compared is not joined: its words are cut again,
    in the half that the edit must be in, and meet under keys that hold both halves. Each round halves what is left,
    so the last keys fix all but one character and hold no more words than an alphabet allows.
    """
    whole = words.select("word", F.lit(0).cast("long").alias("path"), F.lit(0).alias("lo"), F.length("word").alias("hi"))
    chunks, grams, found = _chunks(whole), _grams(whole), None
    while True:
        mine = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("mine"), F.min("r").alias("r"))
        theirs = grams.groupBy("path").agg(F.count(F.lit(1)).alias("theirs"))
        crowded = written(_sorted_join(mine, theirs, "path").where((F.col("mine") * F.col("theirs") > most) & (F.col("r") > 1)).select("path"))
        split = not crowded.isEmpty()
        left, right = (d.join(crowded, "path", "left_anti") if split else d for d in (chunks, grams))
        a, b = left.select("path", F.col("word").alias("a")), right.select("path", F.col("word").alias("b"))
        ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        met = _sorted_join(a, b, "path").where(ordered & F.expr(_ONE_EDIT)).select("a", "b")
        found = met if found is None else found.union(met)
        if not split:
            return found.distinct()
        chunks = written(_chunks(chunks.join(crowded, "path", "left_semi").select("word", "path", "lo", "hi")))
        still = grams.where("still").join(crowded, "path", "left_semi").select("word", "path", "lo", "hi").distinct()
        grams = written(_grams(still))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last; every round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(_sorted_join(at, on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = 2, most: int = PAIRS) -> DataFrame:
    """Per word of `words` (word: string, n: long): the word it is a variant of, and the end of that chain.

    Words are near if they differ by one inserted, deleted or replaced character. `form` is the near word of largest `n`
    (the smallest of ties, by code point), if that is at least `times` (over one) times the word's own; `root` follows
    forms to the last. `n_near` counts near words, `form_n` is the form's n. Chains have no circles, as n grows.

    Null words are left out, repeated ones must be summed before (`counted`); an empty table gives no rows, and other
    columns are ignored. What moves are words, never texts; pairs are verified where they meet.
    """
    words = words.select("word", "n").where(F.col("word").isNotNull())
    pairs = near_pairs(words.select("word"), most)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    others = _sorted_join(both, words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = others.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    joined = _sorted_join(words, best, "word", "left").withColumn("taken", -F.col("best.n") >= F.col("n") * times)
    formed = written(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("taken"), F.col("best.other")).alias("form"), F.when(F.col("taken"), -F.col("best.n")).alias("form_n"),
        )
    )
    roots = followed(formed.where("form IS NOT NULL").select("word", "form"))
    return _sorted_join(formed, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, least: int = 5, times: int = 3) -> DataFrame:
    """`variants` of the words in the texts, misspelt here and there by `misspelt` (by none if `every` is 0).

    Whole texts are searched in one pass and only counted words leave it. A null text has no words and an empty one
    neither; a null id reads as an empty one; repeated rows count again; an empty table gives no rows; other columns,
    whatever their names, are ignored. A run of any length is one word.
    """
    found = runs(docs, id_col, text_col, least)
    words = misspelt(found, every) if every else found.select(F.col("run").alias("word"))
    return variants(written(counted(words, least, times)))
