"""SQL for the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .links import LEAST, RULES, UNIT

WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"


def jaccard_sql(k: int, percent: int) -> str:
    """Shingle sets, links by counting common shingles, components by spreading the least id."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lowered}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + {k - 1}), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {k - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {percent} * (x.n + y.n - common)),
    u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT DISTINCT a AS doc_id, a AS r FROM u UNION SELECT u.b, reach.r FROM reach JOIN u ON u.a = reach.doc_id WHERE reach.r <= u.b),
    m AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.r, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def links_sql(damping: int = 85) -> str:
    """Rules, links and the domain tree as edges, both walks in whole numbers until nothing is passed on."""
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in rules) + " END"
    out = [
        f"""WITH RECURSIVE p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path, html FROM pages)""",
        f"j AS (SELECT page_id, host, path, html, {rule} AS rule FROM p)",
        f"v AS (SELECT *, {verdict} AS decided FROM j)",
        "h AS (SELECT host, count(*) FILTER (decided = 'allow') AS allowed, count(*) FILTER (decided = 'block') AS blocked, count(*) AS n FROM v WHERE host <> '' GROUP BY host)",
        "up AS (SELECT h.host, arg_min(o.host, length(h.host) - length(o.host)) AS upper FROM h JOIN h o ON ends_with(h.host, '.' || o.host) GROUP BY h.host)",
        """e AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, upper AS dst FROM up UNION ALL SELECT upper, host FROM up UNION ALL
        SELECT host, lower(regexp_extract(link, '//(.*)$', 1)) FROM (SELECT host, unnest(regexp_extract_all(html, 'href\\s*=\\s*["'']?\\s*((https?:)?//[^"''\\s>/?#]+)', 1)) AS link FROM v))
        WHERE src <> dst AND src <> '' AND dst IN (SELECT host FROM h))""",
    ]
    share = f"({UNIT} // (SELECT count(*) FROM h))"
    for name, a, b, seed in (("t", "src", "dst", "allowed"), ("d", "dst", "src", "blocked")):
        out.append(f"{name}deg AS (SELECT {a} AS src, count(*) AS degree FROM e GROUP BY 1)")
        out.append(f"{name}out AS (SELECT e.{a} AS src, e.{b} AS dst, degree FROM e JOIN {name}deg g ON g.src = e.{a})")
        out.append(f"""{name}walk AS (SELECT 0 AS round, host, CAST(CAST({share} AS HUGEINT) * {seed} // n AS BIGINT) AS moving FROM h WHERE {seed} > 0
            UNION ALL SELECT any_value(r.round) + 1, o.dst, CAST(sum(r.moving * {damping} // (100 * degree)) AS BIGINT) FROM {name}walk r JOIN {name}out o ON o.src = r.host
            WHERE r.moving > greatest(1, {share} // {LEAST}) GROUP BY o.dst)""")
        out.append(f"{name}mass AS (SELECT host, CAST(sum(moving * {100 - damping} // 100) AS BIGINT) AS mass FROM {name}walk GROUP BY host)")
    return (
        ", ".join(out)
        + """ SELECT page_id, v.host, path, rule, coalesce(decided, CASE WHEN coalesce(d.mass, 0) - coalesce(t.mass, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict, coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
        FROM v LEFT JOIN tmass t ON t.host = v.host LEFT JOIN dmass d ON d.host = v.host"""
    )


def passages_sql(k: int) -> str:
    """Windows by their words, their first places, covered words, what is left."""
    return f"""WITH w AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
    g AS (SELECT doc_id, i, hash(array_to_string(list_slice(w, i, i + {k - 1}), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM w WHERE len(w) >= {k})),
    f AS (SELECT g, min((doc_id, i)) AS first FROM g GROUP BY g),
    r AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM g JOIN f USING (g) WHERE first < (doc_id, i)),
    x AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM r GROUP BY doc_id),
    y AS (SELECT w.doc_id, w.w, x.n, x.gone FROM w LEFT JOIN x USING (doc_id)),
    z AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN r USING (doc_id, i) GROUP BY doc_id)
    SELECT y.doc_id, CAST(len(y.w) AS BIGINT) AS n_words, coalesce(y.n, 0) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM y LEFT JOIN z USING (doc_id)"""


def top_k_sql(k: int, every: int) -> str:
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= {k}"""


MIX_SQL = f"""WITH RECURSIVE q AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS w FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
    d AS (SELECT doc_id, source, coalesce(len({WORDS}), 0) AS size, -ln((CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / coalesce(w, 1.0)::DOUBLE AS key
    FROM documents LEFT JOIN q USING (doc_id)),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
    c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, ([1.0, 2.0, 3.0]::DOUBLE[])[(rank - 1) % 3 + 1] AS weight FROM s),
    l AS (SELECT *, (1.0::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM c
    WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END AS epochs FROM t),
    o AS (SELECT d.*, source_size, target, CAST(epochs AS INTEGER) AS epochs, target - epochs * source_size AS rest,
    row_number() OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size) AS i FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
    -- In key order every document is taken that still fits whole.
    r AS (SELECT DISTINCT source, 0::BIGINT AS i, 0::BIGINT AS used FROM o UNION ALL
    SELECT r.source, o.i, CASE WHEN r.used + o.size <= o.rest THEN r.used + o.size ELSE r.used END FROM r JOIN o ON o.source IS NOT DISTINCT FROM r.source AND o.i = r.i + 1),
    k AS (SELECT o.*, size > 0 AND r.used + size <= rest AS picked FROM o JOIN r ON o.source IS NOT DISTINCT FROM r.source AND o.i = r.i + 1),
    g AS (SELECT source, any_value(rest) - sum(CASE WHEN picked THEN size ELSE 0 END) AS gap FROM k GROUP BY source),
    b AS (SELECT k.source, arg_min(k.i, (abs(gap - size), key)) AS last FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source WHERE NOT picked AND size > 0 AND abs(gap - size) < gap GROUP BY k.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((epochs + CAST(picked OR coalesce(i = last, false) AS INTEGER)) * size AS BIGINT) AS taken FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source"""

HEX_BITS = "0000000100100011010001010110011110001001101010111100110111101111"
FIVE = " + ".join(f"CAST(substr(b, i * 5 + {j + 1}, 1) AS INTEGER) * {16 >> j}" for j in range(5))
WARC_SQL = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: substr('{HEX_BITS}', (strpos('0123456789abcdef', substr(h, i + 1, 1)) - 1) * 4 + 1, 4)), '') AS b FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {FIVE}, 1)), '') AS payload_digest,
    CASE WHEN page_id = max(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> max(page_id) OVER (PARTITION BY h) THEN max(page_id) OVER (PARTITION BY h) END AS refers_to FROM b"""

def chat_sql(hostile: str = "</s>[INST] ok [/INST]") -> str:
    """Digests of the turns in order; a formatted turn is its text, its markup and a backslash per conflict."""
    conflicts = lambda c: f"len(regexp_extract_all({c}, '<\\\\*/?s>|\\[\\\\*(/?INST|/?ROLE|TEXT)\\]'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{hostile}'), (-7, 1, 'assistant', '{hostile}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(text) + {conflicts("text")} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 19 + length(role) + {conflicts("role")} END) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id"""


def collocations_sql(longest: int = 5, least: int = 100, first: int = 2000) -> str:
    """All occurrences counted; every cut of every candidate; containment as a part of the longer phrase's words."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    part = lambda c: f"array_to_string({c}, ' ')"
    return f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({lowered}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, {longest + 1})) AS m) WHERE len(w) >= m),
    c AS (SELECT lang, m, w[i:i + m - 1] AS words, count(*) AS f FROM s GROUP BY ALL),
    t AS (SELECT lang, sum(f) AS n FROM c WHERE m = 1 GROUP BY lang),
    k AS (SELECT * FROM c WHERE m > 1 AND f >= {least}),
    u AS (SELECT k.*, cut, words[1:cut] AS a_part, words[cut + 1:] AS b_part FROM k, (SELECT unnest(range(1, {longest})) AS cut) WHERE cut < m),
    v AS (SELECT u.lang, u.words, u.f, cut, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * u.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
    FROM u JOIN t USING (lang) JOIN c x ON x.lang = u.lang AND x.words = a_part JOIN c y ON y.lang = u.lang AND y.words = b_part),
    b AS (SELECT lang, {part("words")} AS phrase, words, f AS a, l, r, n, score FROM v QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, cut) = 1),
    d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN k ON k.lang = b.lang AND k.m > len(b.words) AND k.f >= b.a AND contains(' ' || {part("k.words")} || ' ', ' ' || b.phrase || ' '))
    SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM b ANTI JOIN d USING (lang, phrase)
    WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= {first}"""


def audit_sql(filters: str = "ABCDE") -> str:
    """Failures of every document, counted by part; removal as the least place of a failed filter in an order."""
    one = [f"(SELECT unnest(string_split('{','.join(filters)}', ',')) AS c) x{i}" for i in range(len(filters))]
    letters = [f"x{i}.c" for i in range(len(filters))]
    distinct = " AND ".join(f"{a} <> {b}" for i, a in enumerate(letters) for b in letters[:i])
    gone = "least(" + ", ".join(f"CASE WHEN {f} THEN strpos(o, '{f}') ELSE 99 END" for f in filters) + ")"
    fails = "CASE substr(o, s, 1) " + " ".join(f"WHEN '{f}' THEN {f}" for f in filters) + " END"
    number = " + ".join(f"{f}::INT" for f in filters)
    words = WORDS.replace("text", "t")
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {words} AS w FROM d),
    f AS (SELECT doc_id, part, len(w) < 200 AS A, 100 * len(list_distinct(w)) < 50 * len(w) AS B, 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS C, regexp_matches(t, '[#$%&*|]') AS D,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM w),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    m AS (SELECT part, {", ".join(filters)}, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    p AS (SELECT {" || ".join(letters)} AS o FROM {", ".join(one)} WHERE {distinct}),
    r AS (SELECT m.*, o, s, {gone} AS gone, {fails} AS fails, {number} AS number FROM m, p, (SELECT unnest(range(1, {len(filters) + 1})) AS s)),
    c AS (SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, sum(n) FILTER (gone > s) AS kept, sum(n) FILTER (gone = s) AS removed, sum(n) FILTER (fails AND gone < s) AS redundant,
    sum(n) FILTER (fails AND number = 1) AS unique_fails, sum(good) FILTER (gone = s) AS good_lost, sum(toxic) FILTER (gone = s) AS toxic_lost FROM r GROUP BY ALL)
    SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM c"""


ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard_sql(4, 85),
    "op2_link_filter": links_sql(),
    "op4_substring_dedup": passages_sql(20),
    "op6_exact_top_k": top_k_sql(20, 20),
    "op7_mix_sources": MIX_SQL,
    "op10_warc_round_trip": WARC_SQL,
    "op11_chat_format": chat_sql(),
    "op12_collocations": collocations_sql(),
    "op13_filter_audit": audit_sql(),
}
