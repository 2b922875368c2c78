"""DuckDB SQL for the operators whose results it can express by other means: plain neighbours, a table of states, windows."""

from __future__ import annotations


def crc32_ctes(keys: str) -> str:
    """CTEs that end in `crc(k, h)`: the CRC-32 of every `k` of the relation `keys`.

    The checksum is linear: every byte adds what it becomes over the bytes that follow, and so does the initial value.
    """
    return f"""
        bits AS (SELECT b.b AS b, b.b::BIGINT AS v, 0 AS i FROM range(256) b(b)
                 UNION ALL SELECT b, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), i + 1 FROM bits WHERE i < 8),
        step AS (SELECT b, v FROM bits WHERE i = 8),
        longest AS (SELECT max(octet_length(encode(k))) AS n FROM {keys}),
        after AS (SELECT b, v, 1 AS i FROM step
                  UNION ALL SELECT a.b, xor(a.v >> 8, s.v), a.i + 1 FROM after a JOIN step s ON s.b = a.v & 255, longest WHERE a.i < n),
        initial AS (SELECT 4294967295::BIGINT AS v, 0 AS i
                    UNION ALL SELECT xor(t.v >> 8, s.v), t.i + 1 FROM initial t JOIN step s ON s.b = t.v & 255, longest WHERE t.i < n),
        sized AS (SELECT k, hex(encode(k)) AS x, octet_length(encode(k)) AS n FROM {keys}),
        bytes AS (SELECT k, n, n - p AS i, ('0x' || x[2 * p + 1 : 2 * p + 2])::INT AS b FROM (SELECT *, unnest(range(n)) AS p FROM sized)),
        added AS (SELECT k, any_value(n) AS n, bit_xor(v) AS v FROM bytes JOIN after USING (i, b) GROUP BY k),
        crc AS (SELECT k, xor(xor(added.v, initial.v), 4294967295) AS h FROM added JOIN initial ON initial.i = added.n)"""


def spelling_sql(every: int = 97, least: int = 5, times: int = 3) -> str:
    """Near words by their spellings with one character left out, instead of chunks and grams."""
    lower = "translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE found AS (
            SELECT doc_id, {lower} AS r FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
        per_doc AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || r AS k, r, count(*) AS n FROM found WHERE length(r) >= {least} GROUP BY ALL),
        keys AS (SELECT DISTINCT k FROM per_doc), {crc32_ctes("keys")},
        words AS (
            SELECT CASE WHEN h % {every} = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word,
                   sum(n)::BIGINT AS n
            FROM per_doc JOIN crc USING (k) GROUP BY 1 HAVING length(word) >= {least} AND sum(n) >= {times}),
        without AS (SELECT word, p, left(word, p) || substr(word, p + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS p FROM words)),
        pairs AS (
            SELECT a.word AS word, b.word AS other FROM without a JOIN without b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
            UNION SELECT w.word, x.word FROM without x JOIN words w ON x.rest = w.word
            UNION SELECT x.word, w.word FROM without x JOIN words w ON x.rest = w.word),
        best AS (
            SELECT word, count(*) AS n_near, min({{'n': -o.n, 'w': other}}) AS b
            FROM pairs JOIN (SELECT word AS other, n FROM words) o USING (other) GROUP BY word),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 2 * n THEN b.w END AS form, CASE WHEN -b.n >= 2 * n THEN -b.n END AS form_n
            FROM words LEFT JOIN best USING (word)),
        walk AS (
            SELECT word, word AS at_, form AS next_ FROM formed
            UNION ALL SELECT walk.word, walk.next_, f.form FROM walk JOIN formed f ON f.word = walk.next_)
    SELECT word, form, at_ AS root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN (SELECT word, at_ FROM walk WHERE next_ IS NULL) USING (word)"""


def repair_sql() -> str:
    """All cheapest ways to the four states, row after row, as (cost, edits); no tree and nothing forgotten."""

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def way(state: str, cost: str, edit: str, when: str = "true") -> str:
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}'}} END"

    go = "NOT must_go"
    into = {
        "z": [way("z", "4", "D")],
        "s": [way("s", "4", "D"), way("z", "extra", "K", f"{go} AND initial = 's'")],
        "u": [way("u", "4", "D")] + [w for p in "zsa" for w in (way(p, "extra", "K", f"{go} AND initial = 'u'"), way(p, "3 + extra", "R", go))],
        "a": [way("a", "4", "D"), way("u", "extra", "K", f"{go} AND initial = 'a'"), way("u", "3 + extra", "R", go)],
    }
    taken = ", ".join(f"{least(*ways)} AS {s}" for s, ways in into.items())
    to_user = least("u", *[way(p, "3", "I") for p in "zsa"])
    to_answer = least("a", way("u", "3", "I"))

    def closed(rows: str) -> str:
        once = f"SELECT conv_id, i, z, s, u, {to_answer} AS a FROM (SELECT conv_id, i, z, s, {to_user} AS u, a FROM ({rows}))"
        return f"SELECT conv_id, i, z, s, {to_user} AS u, a FROM ({once})"

    blanks = r"[\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        keys AS (SELECT DISTINCT k FROM keyed), {crc32_ctes("keys")},
        hurt AS (
            SELECT conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role,
                   CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE WHEN h % 20 = 3 THEN 2 ELSE 1 END)) AS copy
            FROM keyed JOIN crc USING (k) WHERE h % 20 <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
        first_fault AS (
            SELECT *, left(role, 1) AS initial, CASE
                WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN regexp_matches(text, '[.!?]{blanks}*$') THEN 'none' ELSE 'truncated' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous
            FROM placed),
        rows_ AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM first_fault),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM rows_ GROUP BY conv_id),
        nothing AS (SELECT NULL::STRUCT(c BIGINT, e VARCHAR) AS none_),
        start AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': ''}} AS z, none_ AS s, none_ AS u, none_ AS a FROM counts, nothing),
        ways AS (
            {closed("SELECT * FROM start")}
            UNION ALL
            {closed(f"SELECT w.conv_id, r.i, {taken} FROM ways w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1")}),
        ended AS (
            SELECT w.conv_id, list_min([z, a]) AS best FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i),
        edits AS (SELECT conv_id, best.e AS e, unnest(range(1, length(best.e) + 1)) AS p FROM ended),
        steps AS (
            SELECT conv_id, e[p] AS edit, p, length(replace(e[1:p], 'I', '')) AS i, length(replace(e[1:p], 'D', '')) AS nth FROM edits),
        shown AS (
            SELECT s.conv_id, s.nth, s.edit, r.role, CASE WHEN s.edit = 'I' THEN '' ELSE r.text END AS text,
                   max(CASE WHEN s.nth = 1 AND s.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led
            FROM steps s LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i WHERE s.edit <> 'D'),
        repaired AS (
            SELECT conv_id, sha256(string_agg(
                CASE WHEN edit = 'K' THEN role WHEN (nth - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth)) AS x
            FROM shown GROUP BY conv_id)
    SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
           coalesce(best.e, '') AS audit, coalesce(x, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) i
    LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
    LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
    LEFT JOIN repaired x ON x.conv_id IS NOT DISTINCT FROM i.conv_id"""


def mixing_sql(epochs: int = 3, seed: int = 0) -> str:
    """Targets in closed form, by the order in which sources run dry; queues and mix as plain running sums."""
    return rf"""
    WITH docs AS (
            SELECT row_number() OVER () AS row_, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS shuffle FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
        weighed AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, {epochs} * source_size AS most FROM totals),
        dry AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER earlier, 0) AS weight
            FROM weighed WINDOW earlier AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        capped AS (SELECT *, w * rest::DOUBLE / weight > most AS full_ FROM dry),
        shared AS (
            SELECT sum(source_size) - coalesce(sum(most) FILTER (full_), 0) AS rest, sum(w) - coalesce(sum(w) FILTER (full_), 0) AS weight FROM capped),
        targets AS (
            SELECT source, source_size, least(CASE WHEN full_ THEN most::DOUBLE ELSE w * s.rest::DOUBLE / s.weight::DOUBLE END, most::DOUBLE) AS target
            FROM capped, shared s),
        queued AS (
            SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size, row_) - size AS start
            FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
        turns AS (SELECT *, unnest(range({epochs})) * source_size + start AS began FROM queued WHERE size > 0),
        pieces AS (SELECT *, least(size, ceil(target) - began) AS piece FROM turns WHERE began < ceil(target)),
        mixed AS (SELECT row_, piece, sum(piece) OVER (ORDER BY (began + piece) / target, source NULLS LAST, began) - piece AS before FROM pieces),
        taken AS (
            SELECT row_, sum(greatest(0, least(piece, (SELECT sum(size) FROM docs) - before)))::BIGINT AS taken FROM mixed GROUP BY row_)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued LEFT JOIN taken USING (row_)"""
