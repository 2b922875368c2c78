"""Rules that are a table: thousands of patterns, found through the literals they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import settled

TOKEN = r"[\p{L}\p{N}_]+"
GAP = r"[^\p{L}\p{N}_]+"
#: Two neighbouring words of a text and what stands between them, and its three parts.
SEAM, PARTS = TOKEN + GAP + TOKEN, f"({TOKEN})({GAP})({TOKEN})"
#: So many characters on either side of the gap make the key under which a rule meets a seam: the most its word has.
NEAR = (1, 2, 3)
#: A pattern that is a string in any ASCII case: after the flag, characters that stand for themselves, or classes of one.
_OWN = r"A-Za-z0-9_ ,;:'\"!@%=<>/~"
STRING, ONE = rf"\A\(\?i\)(?:[{_OWN}]|\[[{_OWN}]\])+\z", rf"\[([{_OWN}])\]"
#: Characters outside ASCII whose lower case begins with an ASCII letter.
KELVIN, DOTTED = "\u212a", "\u0130"
#: Rules sent to every task; a larger table is joined without the texts.
SENT = 50_000


def tokens(text: Column) -> Column:
    """The distinct words of a text in lower case, and the empty one, which stands for rules without a literal."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def _with_words(rows: DataFrame) -> DataFrame:
    """The rows with ``__words`` of ``__low``, the ``__gaps`` around them, and the distinct words no longer than a key's part."""
    words = F.regexp_extract_all("__low", F.lit(TOKEN), F.lit(0))
    rows = settled(rows.withColumns({"__words": words, "__gaps": F.split("__low", TOKEN, -1)}), ["__words", "__gaps"])
    return settled(rows.withColumn("__short", F.array_distinct(F.filter("__words", lambda w: F.length(w) <= NEAR[-1]))), ["__short"])


def _key(before: Column, gap: Column, after: Column, i: Column | int, j: Column | int) -> Column:
    """A hash of the last `i` characters before the gap, the gap and the first `j` after it."""
    return F.xxhash64(F.lit(i), F.lit(j), F.right(before, F.lit(i)), gap, F.left(after, F.lit(j)))


def _seam_index(rules: DataFrame) -> DataFrame:
    """The rules with the words ``__a`` and ``__b`` of their seam, its ``__hash``, ``__plain``, whether the pattern is the seam
    in any ASCII case, ``__loops``, whether that can overlap itself, and ``__all``, a pattern for texts with all of ``__also``."""
    a, gap, b = (F.regexp_extract("__seam", PARTS, i) for i in (1, 2, 3))
    string = F.lower(F.regexp_replace(F.substring("pattern", 5, 1 << 30), ONE, "$1"))
    plain = F.col("pattern").rlike(STRING) & (string == F.col("__seam")) & (F.col("__also") == F.array("__seam"))
    loops = F.exists(F.sequence(F.lit(1), F.length("__seam") - 1), lambda k: F.left("__seam", k) == F.right("__seam", k))
    near = lambda c: F.greatest(*(F.when(F.length(c) >= n, n) for n in NEAR))
    made = {"__a": a, "__b": b, "__hash": _key(a, gap, b, near(a), near(b)), "__plain": F.coalesce(plain, F.lit(False)), "__loops": loops}
    quoted = lambda w: F.concat(F.lit(r"(?=(?s:.*?)\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    made["__all"] = F.when(F.forall("__also", lambda w: w.isNotNull()), F.concat(F.lit(r"\A"), F.array_join(F.transform("__also", quoted), "")))
    return settled(rules.withColumns(made | {"__id": F.monotonically_increasing_id()}), [*made, "__id"])


def _by_seam(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """__key, rule, n: the rules whose ``__seam`` a text holds, each rule once, with the number of matches.

    Words of a rule may be parts of a text's words at its ends, so ``bathe cat`` holds ``he ca``. Where the pattern is that
    string its matches are the places where text and rule meet, added up without a search. Other rules search the text,
    once, at the first place that holds the seam; so do strings whose places overlap, and all in a text with one of the two
    characters whose lower case alone is ASCII. From the words on, all is generated code up to the sums, without higher-order
    functions: a step outside would be handed all rows of a text at once, with copies of the text.
    """
    outside = [~F.contains("__text", F.lit(c)) for c in (KELVIN, DOTTED)]
    rows = _with_words(rows).withColumns({"__row": F.monotonically_increasing_id(), "__fits": outside[0] & outside[1]})
    placed = rows.select("*", F.posexplode("__words").alias("__at", "__before"))
    place, before, gap, after, token = (F.col(c) for c in ("__at", "__before", "__gap", "__after", "__token"))
    placed = placed.withColumns({"__gap": F.get("__gaps", place + 1), "__after": F.get("__words", place + 1)})
    keys = F.array(*(_key(before, gap, after, i, j) for i in NEAR for j in NEAR))
    placed = placed.where(after.isNotNull()).select("*", F.explode(keys).alias("__hash"))
    met = placed.join(F.broadcast(_seam_index(rules)), "__hash")
    own = F.concat(before, gap, after)
    listed = F.array_contains(F.when(F.length(token) <= NEAR[-1], F.col("__short")).otherwise(F.col("__words")), token)
    # one filter, so that the list of words is the last thing looked at
    met = met.where(F.contains(own, "__seam") & ((token == "") | (token == before) | (token == after) | listed))

    # two places that share what the word between them has in common with both
    beyond = [F.get("__gaps", place + 2) == gap, F.startswith(F.get("__words", place + 2), F.col("__b"))]
    shared = F.endswith(after, "__a") & (F.length(after) < F.length("__a") + F.length("__b")) & beyond[0] & beyond[1]
    string = F.col("__plain") & F.col("__fits")
    made = {"__string": string, "__overlaps": string & F.col("__loops") & F.coalesce(shared, F.lit(False))}
    met = settled(met.withColumns(made), [*made])

    # whether the text holds `found` here first: words up to the end of the seam's first one
    upto = lambda found: F.substring("__low", F.lit(1), F.instr("__low", found) - 1 + F.length("__a"))
    here = lambda found: F.regexp_count(upto(found), F.lit(TOKEN)) == place + 1
    met = met.where(F.col("__string") | (here(F.col("__seam")) & F.rlike("__low", F.col("__all"))))
    due = ~F.col("__string") | (F.col("__overlaps") & here(F.concat(F.col("__a"), gap, after, gap, F.col("__b"))))
    searched = F.when(due, F.coalesce(F.regexp_count("__text", F.col("pattern")), F.lit(0)).cast("bigint"))
    n = F.coalesce(F.max(searched), F.count(F.lit(1)))
    return met.groupBy("__row", "__id", "__key", "rule").agg(n.alias("n")).select("__key", "rule", "n")


def rule_hits(docs: DataFrame, rules: DataFrame, key: str, text: str, sent: int = SENT) -> DataFrame:
    """key, rule, n: how often each rule's pattern is found in each text, where it is.

    ``rules`` (rule, pattern, literal) is an index from literal to rule: a word in lower case that every match of the
    pattern needs, whole, or null for none; it may have ``also``, a list of further strings in lower case that a match needs.
    Only rules whose literal a text holds are tried on it, so the cost follows the rules that may match and not the size
    of the table; further strings are looked for before the pattern is. A rule with one that spans two words is found by
    those two as neighbours, since both words alone stand in many texts. Up to ``sent`` rules are sent to the tasks, and texts are
    searched where they are read. For more, words and rules meet without the texts, which are then joined once with the
    rules to try.
    """
    also = F.coalesce("also", F.array().cast("array<string>")) if "also" in rules.columns else F.array().cast("array<string>")
    index = rules.select("rule", "pattern", F.lower(F.coalesce("literal", F.lit(""))).alias("__token"), also.alias("__also"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull())
    few = index.limit(sent + 1).count() <= sent
    rows = settled(rows.withColumn("__low", F.lower("__text")), ["__low"])  # once a text, not once a word of it
    holds = lambda strings: F.forall(strings, lambda w: F.contains("__low", w))
    if few:
        inner = F.filter(F.transform("__also", lambda w: F.regexp_extract(w, SEAM, 0)), lambda s: s != "")
        index = index.withColumn("__seam", F.get(inner, F.lit(0)))
        paired = _by_seam(rows, index.where(F.col("__seam").isNotNull())).select(F.col("__key").alias(key), "rule", "n")
        index = index.where(F.col("__seam").isNull())
        # one row for a text and word, with all rules of the word, until it is known which are likely
        rule = F.struct("rule", "pattern", "__also")
        by_word = F.broadcast(index.groupBy("__token").agg(F.collect_list(rule).alias("__rules")))
        met = rows.select("*", F.explode(tokens(F.col("__low"))).alias("__token")).join(by_word, "__token")
        chosen = met.withColumn("__rules", F.filter("__rules", lambda r: holds(r["__also"]))).where(F.size("__rules") > 0)
        likely = chosen.select("__key", "__text", F.inline("__rules")).drop("__also")
    else:
        placed = rows.select("__key", F.explode(tokens(F.col("__low"))).alias("__token"))
        met = placed.join(index, "__token").groupBy(F.col("__key").alias("__own"), "rule", "pattern").agg(F.first("__also").alias("__also"))
        likely = met.join(rows, F.col("__own").eqNullSafe(F.col("__key"))).where(holds(F.col("__also")))
    n = F.regexp_count("__text", F.col("pattern")).cast("bigint").alias("n")
    found = settled(likely.select(F.col("__key").alias(key), "rule", n), ["n"])
    return (found.union(paired) if few else found).where("n > 0")
