"""SQL for the results of operators that SQL can express, run on small tables:
exact joins over all shingles where the operators hash, band and prune."""

NEAR_DUPLICATES = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
    ), place AS (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0
    ), shingle AS (
        SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c FROM place GROUP BY ALL
    ), total AS (
        SELECT doc_id, sum(c) AS n FROM shingle GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS o
        FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ), link AS (
        SELECT a, b FROM shared JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE o >= 0.8 * (x.n + y.n - o)
        UNION ALL SELECT (SELECT min(doc_id) FROM words WHERE len(w) = 0), doc_id FROM words WHERE len(w) = 0
    ), edge AS (
        SELECT a, b FROM link UNION SELECT b, a FROM link
    ), reach(doc_id, root) AS (
        SELECT doc_id, doc_id FROM words UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.root = e.a
    ) SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id"""

BENCHMARK_LEAKS = r"""
    WITH doc AS (
        SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
    ), item AS (
        SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
    ), d AS (
        SELECT doc_id, n, p, array_to_string(w[p + 1:p + 5], ' ') AS s FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM doc WHERE len(w) > 4)
    ), q AS (
        SELECT item_id, n, q, array_to_string(w[q + 1:q + 5], ' ') AS s FROM (SELECT item_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS q FROM item WHERE len(w) > 4)
    ), met_once AS (
        SELECT DISTINCT d.doc_id, q.item_id, q.n AS n, least(q.n, d.n) AS size, d.n - least(q.n, d.n) AS last FROM d JOIN q ON d.s = q.s
    ), laid AS (
        SELECT doc_id, item_id, n, size, unnest(range(0, last + 1)) AS start FROM met_once
    ), hit AS (
        SELECT DISTINCT d.doc_id, q.item_id, d.p, d.s FROM d JOIN q ON d.s = q.s
    ), own AS (
        SELECT l.doc_id, l.item_id, l.start, l.n, l.size, hit.s, count(*) AS c
        FROM laid l JOIN hit ON hit.doc_id = l.doc_id AND hit.item_id = l.item_id AND hit.p >= l.start AND hit.p <= l.start + l.size - 5 GROUP BY ALL
    ), its AS (
        SELECT item_id, s, count(*) AS c FROM q GROUP BY ALL
    ), met AS (
        SELECT own.doc_id, own.item_id, own.start, own.n, own.size, sum(least(own.c, its.c)) AS o
        FROM own JOIN its ON own.item_id = its.item_id AND own.s = its.s GROUP BY ALL
    ), good AS (
        SELECT doc_id, item_id, start, CAST(o AS DOUBLE) / CAST(size - 4 + n - 4 - o AS DOUBLE) AS similarity FROM met
    ), best AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM good WHERE similarity >= 0.8
    ) SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, similarity FROM best WHERE k = 1"""


def located(relation: str, keys: str, text: str, pattern: str) -> str:
    """A subquery: keys, m, start of every match of a pattern in a text."""
    p = pattern.replace("'", "''")
    return f"""(
        SELECT {keys}, m, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS BIGINT) AS start
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m FROM (
            SELECT *, string_split_regex({text}, '{p}') AS gaps, regexp_extract_all({text}, '{p}') AS ms FROM {relation})))"""


def secrets(rules: list[tuple[str, str]], base: int) -> str:
    """rules: (kind, expression) in order; the first three are the base kinds
    assign, access and hex with their least lengths."""
    valid = ["length(regexp_extract(m, '{p}', 2)) >= 12", "length(m) >= 18", "length(m) >= 16"] + ["true"] * (len(rules) - 3)
    parts = []
    for k, (kind, full) in enumerate(rules):
        p = full.replace("'", "''")
        parts.append(f"""
        SELECT doc_id, {k} AS k, '{kind}' AS kind, m, start FROM {located('doc', 'doc_id', 't', full)} WHERE {valid[k].format(p=p)}""")
    return f"""
    WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS ({' UNION ALL '.join(parts)}
    ), named AS (SELECT *, kind || ':' || start || ':' || (start + length(m)) AS s FROM span)
    SELECT d.doc_id AS doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
        sha256(coalesce(string_agg(s, ',' ORDER BY start, k) FILTER (WHERE k < {base}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, k), '') AS spans
    FROM doc d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id"""


def personal_data(patterns: dict[str, str], term: str, min_docs: int, generalised: float, removed: float) -> str:
    """The base kinds in order with their expressions as they are stated."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    twice = "lambda c, i: CAST(c AS INTEGER) * (1 + (i + 1) % 2) - CASE WHEN i % 2 = 0 AND CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END"
    valid = [
        "true",
        "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || ltrim(x, '0') AS BIGINT) > 255)) = 0",
        f"length({digits}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), {twice})) % 10 = 0",
        f"length({digits}) BETWEEN 9 AND 15",
    ]
    parts = [f"SELECT doc_id, {k} AS k, '{kind}' AS kind, lower(m) AS entity, start, start + length(m) AS stop FROM {located('doc', 'doc_id', 't', p)} WHERE {valid[k]}" for k, (kind, p) in enumerate(patterns.items())]
    return f"""
    WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS ({' UNION ALL '.join(parts)}
    ), holder AS (SELECT * FROM doc WHERE doc_id IN (SELECT doc_id FROM span)
    ), raw AS (SELECT doc_id, lower(m) AS term, start AS a, start + length(m) AS b FROM {located('holder', 'doc_id', 't', term)}
    ), near AS (
        SELECT * FROM raw WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.doc_id = raw.doc_id AND s.start < b AND s.stop > a)
    ), total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM doc
    ), ent AS (SELECT k, entity, count(DISTINCT doc_id) AS de FROM span GROUP BY ALL HAVING count(DISTINCT doc_id) >= {min_docs}
    ), held AS (SELECT DISTINCT doc_id, k, entity, de FROM span JOIN ent USING (k, entity)
    ), pair AS (
        SELECT k, entity, de, term, count(*) AS co FROM held JOIN (SELECT DISTINCT doc_id, term FROM near) USING (doc_id) GROUP BY ALL HAVING count(*) >= {min_docs}
    ), word AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '\\p{{L}}+')) AS term FROM doc
    ), freq AS (SELECT term, count(*) AS df FROM word WHERE term IN (SELECT term FROM pair) GROUP BY term
    ), share AS (
        SELECT k, entity, term, log2(n * co / (df * de)) / log2(n / de) AS share FROM pair JOIN freq USING (term) CROSS JOIN total WHERE de < n
    ), told AS (
        SELECT doc_id, term, max(share) AS share FROM held JOIN share USING (k, entity) WHERE share >= {generalised} GROUP BY ALL
    ), named AS (
        SELECT doc_id, k, start AS a, kind || ':' || start || ':' || stop AS s FROM span
        UNION ALL SELECT doc_id, CASE WHEN share >= {removed} THEN 5 ELSE 4 END, a, CASE WHEN share >= {removed} THEN 'term:' ELSE 'context:' END || a || ':' || b
        FROM near JOIN told USING (doc_id, term)
    ) SELECT d.doc_id AS doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card,
        count(*) FILTER (WHERE k = 3) AS n_phone, sha256(coalesce(string_agg(s, ',' ORDER BY k, a) FILTER (WHERE k < 4), '')) AS base_sha256,
        coalesce(string_agg(s, ',' ORDER BY k, a), '') AS spans
    FROM doc d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id"""


#: The base expressions of personal data as they are stated.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PERSONAL_DATA = personal_data(STATED, r"\p{L}{3,}", min_docs=2, generalised=0.75, removed=0.95)


def _term(p: str, q: str) -> str:
    part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"({part(p, q)} + {part(q, p)}) / 2"


QUALITY_RULES = rf"""
    WITH doc AS (
        SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents
    ), split AS (
        SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc
    ), win AS (
        SELECT id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM split WHERE len(w) > 2)
    ), rep AS (
        SELECT id, count(DISTINCT p) AS n FROM (
            SELECT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY id, g) AS k FROM win) WHERE k > 1) GROUP BY id
    ), word AS (
        SELECT id, lang, unnest(w) AS word FROM split
    ), counts AS (
        SELECT lang, word, count(*) AS n FROM word WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, word, count(*) FROM word GROUP BY word
    ), total AS (
        SELECT lang, sum(n) AS total FROM counts GROUP BY lang HAVING lang IS NULL OR sum(n) >= 2000
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM counts
    ), bin AS (
        SELECT r.lang AS lang, r.word AS word, r.n / t.total AS q FROM ranked r JOIN total t ON r.lang IS NOT DISTINCT FROM t.lang WHERE k <= 32
    ), other AS (
        SELECT lang, 1 - sum(q) AS q FROM bin GROUP BY lang
    ), class AS (
        SELECT id, doc_id, lang, CASE WHEN lang IN (SELECT lang FROM total) THEN lang END AS ref, len(w) AS n, length(t) AS chars,
            CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
            [length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')), length(regexp_replace(t, '[^\p{{N}}]', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')),
             length(regexp_replace(t, '[^\p{{P}}]', '', 'g')), length(regexp_replace(t, '[^\p{{S}}]', '', 'g'))] AS five FROM split
    ), classes AS (
        SELECT *, list_append(five, chars - list_sum(five)) AS c FROM class
    ), part AS (
        SELECT id, ref, chars, unnest(range(1, 7)) AS k, unnest(c) AS n FROM classes
    ), classq AS (
        SELECT ref, k, sum(n) / sum(sum(n)) OVER (PARTITION BY ref) AS q FROM part WHERE ref IS NOT NULL GROUP BY ref, k
        UNION ALL SELECT NULL, k, sum(n) / sum(sum(n)) OVER () FROM part GROUP BY k
    ), classd AS (
        SELECT id, sqrt(greatest(sum({_term('(n / chars)', 'q')}), 0)) AS d FROM part JOIN classq c ON part.ref IS NOT DISTINCT FROM c.ref AND part.k = c.k WHERE chars >= 200 GROUP BY id
    ), found AS (
        SELECT id, b.word AS word, count(*) AS n FROM word JOIN classes c USING (id) JOIN bin b ON c.ref IS NOT DISTINCT FROM b.lang AND word.word = b.word GROUP BY ALL
    ), histogram AS (
        SELECT c.id AS id, coalesce(f.n, 0) / c.n AS p, b.q AS q FROM classes c JOIN bin b ON c.ref IS NOT DISTINCT FROM b.lang LEFT JOIN found f ON f.id = c.id AND f.word = b.word WHERE c.n >= 50
        UNION ALL SELECT c.id, (c.n - coalesce(s.n, 0)) / c.n, o.q FROM classes c JOIN other o ON c.ref IS NOT DISTINCT FROM o.lang
            LEFT JOIN (SELECT id, sum(n) AS n FROM found GROUP BY id) s ON s.id = c.id WHERE c.n >= 50
    ), wordd AS (
        SELECT id, sqrt(greatest(sum({_term('p', 'q')}), 0)) AS d FROM histogram GROUP BY id
    ), judged AS (
        SELECT c.*, coalesce(rep.n, 0) AS repeated, classd.d AS cd, wordd.d AS wd FROM classes c LEFT JOIN rep USING (id) LEFT JOIN classd USING (id) LEFT JOIN wordd USING (id)
    ) SELECT doc_id, CAST(n AS BIGINT) AS n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(repeated AS BIGINT) AS n_repeat_words,
        (n < 50 OR 100 * repeated > 50 * n) AS base_failed,
        NOT (n < 50 OR 100 * repeated > 50 * n) AND NOT coalesce(cd > 0.25, false) AND NOT coalesce(wd > 0.15 + sqrt(33 / (8 * ln(2) * n)), false) AS kept,
        round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM judged"""

SPELLING = r"""
    WITH RECURSIVE run AS (
        SELECT doc_id, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c
        FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS m FROM documents) WHERE length(m) >= 7 GROUP BY ALL
    ), tab AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
    ), bytes AS (
        SELECT doc_id, r, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM run
    ), summed AS (
        SELECT r, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
            lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM bytes, tab
    ), thin AS (
        SELECT CASE WHEN h % 31 = 0 THEN r[:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, c FROM summed
    ), w AS (
        SELECT word, CAST(sum(c) AS BIGINT) AS n FROM thin WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
    ), shape AS (
        SELECT word, n, -1 AS i, word AS s FROM w UNION ALL SELECT word, n, i, word[:i] || word[i + 2:] FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
    ), met AS (
        SELECT DISTINCT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM shape a JOIN shape b ON a.s = b.s AND a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)
    ), near AS (
        SELECT word, count(*) AS n_near, arg_min(other, {'m': -m, 'other': other}) FILTER (WHERE m >= 10 * n) AS form, max(m) FILTER (WHERE m >= 10 * n) AS form_n
        FROM met GROUP BY word
    ), step(word, spot) AS (
        SELECT word, word FROM w UNION SELECT step.word, near.form FROM step JOIN near ON step.spot = near.word WHERE near.form IS NOT NULL
    ), ends AS (
        SELECT step.word AS word, step.spot AS root FROM step LEFT JOIN near ON near.word = step.spot WHERE near.form IS NULL
    ) SELECT w.word AS word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form, form_n, root FROM w LEFT JOIN near USING (word) JOIN ends USING (word)"""


def vector_codes(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Each round as two tables: the entry of each part, and the codebooks after it."""

    def nearest(k: int) -> str:
        return f"""near{k} AS MATERIALIZED (
        SELECT vec_id, pos, arg_min(entry, {{'d': d, 'e': entry}}) AS entry, min(d) AS d FROM (
            SELECT p.vec_id AS vec_id, p.pos AS pos, b.entry AS entry, CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) AS BIGINT) AS d
            FROM part p JOIN book{k} b ON p.pos = b.pos) GROUP BY vec_id, pos)"""

    tables = [f"""kept AS MATERIALIZED (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    ), part AS MATERIALIZED (
        SELECT vec_id, pos, c[pos * len(c) // {parts} + 1:(pos + 1) * len(c) // {parts}] AS v FROM (SELECT *, unnest(range({parts})) AS pos FROM kept)
    ), book0 AS MATERIALIZED (
        SELECT pos, CAST(dense_rank() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS entry, v FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
    )"""]  # fmt: skip
    for k in range(rounds):
        tables.append(f"""{nearest(k)}, mean{k} AS (
        SELECT pos, entry, list(m ORDER BY i) AS v FROM (
            SELECT pos, entry, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
                SELECT pos, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM part JOIN near{k} USING (vec_id, pos)) GROUP BY pos, entry, i) GROUP BY pos, entry
    ), book{k + 1} AS MATERIALIZED (
        SELECT b.pos AS pos, b.entry AS entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON b.pos = m.pos AND b.entry = m.entry)""")
    return f"""
    WITH {', '.join(tables)}, {nearest(rounds)}, coded AS (
        SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
    ), sha AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{rounds}
    ) SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), sha"""
