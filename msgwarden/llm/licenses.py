"""License scans by diagonal voting of word n-grams."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col
from .license_texts import NOTICES, PHRASES

#: Words of a gram; templates of fewer words are left out.
GRAM = 3
#: Diagonals up to so many words apart belong to one copy (words put in or left out between them).
GAP = 8
#: A stretch of a span is a copy of a template when it holds this share of its grams and is at most this many times as long.
COVERAGE, STRETCH = 0.7, 1.5
#: Places are scaled per template, so that the longest stretch of any template is just below this.
SCALE = 1 << 31
#: Everything but digits, small letters and what is not ASCII.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.lower()) if w]


def gram_rows(notices=NOTICES, gram: int = GRAM) -> list[tuple]:
    """(template, label, grams, place, words of the gram) of every gram of every notice: a table of fixed size."""
    rows = []
    for template, (label, text) in enumerate(notices):
        words = template_words(text)
        grams = len(words) - gram + 1
        rows += [(template, label, grams, i, " ".join(words[i : i + gram])) for i in range(grams)]
    return rows


def _phrase_at(words: Column, at: Column, phrases) -> Column:
    """Label of the phrase that starts at word `at`, else null; phrases start with different words."""
    tests = [
        (reduce(lambda a, b: a & b, [F.get(words, at + i) == w for i, w in enumerate(phrase.split())]), label)
        for phrase, label in phrases
    ]
    return reduce(lambda seen, t: seen.when(t[0], t[1]), tests[1:], F.when(*tests[0]))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES, gram: int = GRAM
) -> DataFrame:
    """One row per document: places of the phrases, labels of phrases and verified templates, and the best coverage.

    Every gram of every text is looked up in the table of template grams, whose size is fixed. Hits are counted per
    template and diagonal (place in the text minus place in the template); diagonals up to `GAP` apart are merged. A
    merged span may hold several copies that stand close together, so every stretch of it that is at most `STRETCH` times
    as long as the template is looked at; one counts when it holds `COVERAGE` of the template's grams, word for word.
    `score` is the best coverage of such stretches, 0 without one.

    A null or empty text has no words. Repeated rows are scanned each for itself, a null id stays null, other columns are
    ignored, an empty table gives no rows. One shuffle, of the hits and one row per text.
    """
    spark = docs.sparkSession
    templates = spark.createDataFrame(gram_rows(notices, gram), "template int, label string, grams int, place int, words string")
    words = [F.get(F.split("words", " "), F.lit(i)) for i in range(gram)]
    hit = F.struct("template", "label", "grams", "place", "words")
    grams = templates.groupBy(F.xxhash64(*words).alias("gram")).agg(F.collect_list(hit).alias("hits"))

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.coalesce(col(text_col).cast("string"), F.lit("")), letters, letters.lower())
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).cast("long").alias("doc_id"),
        F.array_remove(F.split(text, NO_WORD), "").alias("words"),
    )
    at = rows.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("at", "word"))
    following = [F.get("words", F.col("at") + i) for i in range(gram)]
    gram_hash = F.when(following[-1].isNotNull(), F.xxhash64(*following))
    found = (
        at.withColumn("base", _phrase_at(F.col("words"), F.col("at"), phrases))
        .withColumn("gram", gram_hash)
        .withColumn("own", F.concat_ws(" ", *following))
        .join(F.broadcast(grams), "gram", "left")
        .where("coalesce(at, 0) = 0 or base is not null or hits is not null")
    )
    exact = F.filter("hits", lambda h: h["words"] == F.col("own"))
    # the place itself, for counts and phrases, and a row for each template it agrees with
    nothing = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in (("template", "int"), ("label", "string"), ("grams", "int"), ("place", "int"), ("words", "string"))))
    votes = found.select(
        "row", "doc_id", "n_words", "at", "base", F.explode(F.concat(F.array(nothing), F.coalesce(exact, F.array()))).alias("hit")
    ).repartition("row")
    base_at = F.when(F.col("hit.template").isNull() & F.col("base").isNotNull(), F.col("at"))
    diagonals = votes.groupBy(
        "row", "doc_id", "n_words", F.col("hit.template").alias("template"), F.col("hit.label").alias("label"), F.col("hit.grams").alias("grams"),
        F.when(F.col("hit.template").isNotNull(), F.col("at") - F.col("hit.place")).alias("diagonal"),
    ).agg(
        F.collect_set("hit.place").alias("places"),
        F.count(base_at).alias("n_base"), F.min(base_at).alias("first"), F.max(base_at).alias("last"),
        F.collect_set(F.when(base_at.isNotNull(), F.col("base"))).alias("bases"),
    )
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(along) > GAP).cast("int")
    merged = diagonals.withColumn("apart", apart).withColumn("span", F.sum(F.coalesce("apart", F.lit(0))).over(along))
    # a stretch ends at each hit and goes back as far as a copy may reach; the scale makes that the same range for all templates
    reach = F.floor(STRETCH * (F.col("grams") + gram - 1)).cast("long") - gram
    scale = F.when(reach > 0, F.floor(F.lit(SCALE) / reach)).otherwise(SCALE + 1).cast("long")
    stretch = W.partitionBy("row", "template", "span").orderBy("scaled").rangeBetween(-SCALE, W.currentRow)
    held = (
        merged.withColumn("place", F.explode_outer("places"))
        .withColumn("scaled", (F.col("diagonal") + F.col("place")).cast("long") * scale)
        .withColumn("held", F.size(F.collect_set("place").over(stretch)))
    )
    coverage = F.col("held") / F.col("grams")
    copy = coverage >= COVERAGE
    result = held.groupBy("row", "doc_id", "n_words").agg(
        F.sum("n_base").alias("n_base"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("template").isNull(), F.col("bases")))))).alias("bases"),
        F.collect_set(F.when(copy, F.col("label"))).alias("copies"),
        F.coalesce(F.max(F.when(copy, coverage)), F.lit(0.0)).alias("score"),
    )
    return result.select(
        "doc_id", "n_words", "n_base", F.col("first").cast("long").alias("first_word"), F.col("last").cast("long").alias("last_word"),
        F.array_join("bases", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("bases", "copies")), ",").alias("labels"), "score",
    )


def scan_sql() -> str:
    """The same scan for DuckDB, over string grams in place of hashes; a stretch is joined with the hits it reaches back to."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    grams = ", ".join(f"({t}, {quoted(label)}, {n}, {i}, {quoted(words)})" for t, label, n, i, words in gram_rows())
    phrase = "CASE " + " ".join(
        "WHEN " + " AND ".join(f"words[pos + {i + 1}] = {quoted(w)}" for i, w in enumerate(p.split())) + f" THEN {quoted(label)}"
        for p, label in PHRASES
    ) + " END"
    own = " || ' ' || ".join(f"words[pos + {i + 1}]" for i in range(GRAM))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH grams(template, label, grams, place, gram) AS (VALUES {grams}),
rows AS (
  SELECT row_number() OVER () AS r, doc_id, [w FOR w IN regexp_split_to_array(
    translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{NO_WORD}') IF w <> ''] AS words FROM documents),
places AS (SELECT r, words, unnest(range(len(words))) AS pos FROM rows),
found AS (SELECT r, pos, {phrase} AS base, {own} AS gram FROM places),
base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT base)) AS bases
  FROM found WHERE base IS NOT NULL GROUP BY r),
hits AS (SELECT r, template, label, grams, place, pos, pos - place AS diagonal FROM found JOIN grams USING (gram)),
diagonals AS (SELECT DISTINCT r, template, diagonal FROM hits),
steps AS (
  SELECT *, coalesce(CAST(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {GAP} AS INT), 0) AS apart
  FROM diagonals),
merged AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM steps),
held AS (
  SELECT r, template, label, grams, place, pos, span, greatest(0, CAST(floor({STRETCH} * (grams + {GRAM - 1})) AS BIGINT) - {GRAM}) AS reach
  FROM hits JOIN merged USING (r, template, diagonal)),
stretches AS (
  SELECT e.r, e.label, count(DISTINCT b.place) / e.grams AS coverage
  FROM (SELECT DISTINCT r, template, label, grams, pos, span, reach FROM held) e
  JOIN held b ON b.r = e.r AND b.template = e.template AND b.span = e.span AND b.pos BETWEEN e.pos - e.reach AND e.pos
  GROUP BY e.r, e.template, e.label, e.grams, e.span, e.pos),
copies AS (
  SELECT r, list_sort(list(DISTINCT label)) AS labels, max(coverage) AS score FROM stretches WHERE coverage >= {COVERAGE} GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bases, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bases, []), coalesce(labels, [])))), ',') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM rows LEFT JOIN base USING (r) LEFT JOIN copies USING (r)"""
