"""DuckDB text of the operators that SQL can express."""

from storelens.llm.licences import PHRASES, SENTENCES
from storelens.llm.url_rules import CONFIDENCE, LISTED, SUPPORT, VOCABULARY, WIDTH

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
WORDS = rf"list_filter(string_split_regex({LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

# Smallest id reachable by links a-b between nodes.
REACH = """
reach(node, other) AS (
    SELECT node, node FROM nodes
    UNION
    SELECT r.node, e.b FROM reach r JOIN links e ON r.other = e.a
),
smallest AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""

OP1 = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, list_filter(string_split_regex({LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    END AS s FROM split
),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
    SELECT l.doc_id AS a, r.doc_id AS b
    FROM elements l JOIN elements r ON l.x = r.x AND l.doc_id <> r.doc_id
    GROUP BY l.doc_id, r.doc_id, l.n, r.n
    HAVING 100 * count(*) >= 90 * (l.n + r.n - count(*))
),
nodes AS (SELECT doc_id AS node FROM sets),
{REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component AS component_id
FROM sets JOIN smallest ON node = doc_id
"""

OP5 = rf"""
WITH items AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
    SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS x
    FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
places AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS x
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, p.size, i, item FROM places p JOIN windows w ON p.x = w.x AND p.size = w.size),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id
"""

OP7 = r"""
WITH messages AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
    -- Each role is framed by 4 marks and a line end, each text by 7 marks and a line end; an escaped character takes two.
    SELECT *, 5 + 8 + length(role) + length(text)
        + length(regexp_replace(role, '[^\\<|]', '', 'g')) + length(regexp_replace(text, '[^\\<]', '', 'g')) AS size
    FROM messages
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP9 = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS v,
        embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good
    FROM embeddings
),
links AS (
    SELECT l.node AS a, r.node AS b
    FROM (SELECT * FROM vectors WHERE good) l JOIN (SELECT * FROM vectors WHERE good) r ON l.node <> r.node AND len(l.v) = len(r.v)
    WHERE list_cosine_similarity(l.v, r.v) >= 0.9
),
nodes AS (SELECT node FROM vectors),
{REACH},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT node AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(component AS BIGINT) AS component_id, node = component AS kept
FROM smallest LEFT JOIN counted ON a = node
"""

# In the given pages the content is one article element and references are few.
OP2 = r"""
WITH articles AS (SELECT page_id, url, coalesce(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '') AS x FROM pages),
plain AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]+>', chr(10), 'g') AS x FROM articles),
decoded AS (
    SELECT page_id, url, regexp_replace(regexp_replace(x, '&quot;', '"', 'g'), '&amp;?', '&', 'g') AS x FROM plain
)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text,
    CAST(length(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars
FROM decoded
"""


def _licences(phrases, sentences) -> str:
    listed = [(t, x, True) for t, x in phrases] + [(t, x, False) for t, x in sentences]
    rows = ", ".join(f"({i}, '{t}', '{x}', {p})" for i, (t, x, p) in enumerate(listed))
    return rf"""
    WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
    templates AS (SELECT template, label, phrase, string_split(t, ' ') AS t FROM (VALUES {rows}) AS v(template, t, label, phrase)),
    grams AS (SELECT template, i - 1 AS place, t[i] || ' ' || t[i + 1] AS g FROM (SELECT template, t, unnest(range(1, len(t))) AS i FROM templates)),
    rolled AS (SELECT doc_id, i - 1 AS place, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM docs)),
    votes AS (
        SELECT DISTINCT doc_id, template, r.place - g.place AS diagonal, g.place AS spot
        FROM rolled r JOIN grams g ON r.g = g.g
    ),
    lines AS (
        SELECT doc_id, template, diagonal, label, phrase, len(t) AS size, count(*) AS votes
        FROM votes JOIN templates USING (template) GROUP BY ALL
    ),
    own AS (
        SELECT a.template, list_distinct(flatten(list(list_filter(range(0, len(a.t)), lambda i: NOT list_contains(b.t, a.t[i + 1]))))) AS places
        FROM templates a JOIN templates b ON a.label <> b.label AND NOT a.phrase AND NOT b.phrase
            AND len(list_filter(a.t, lambda x: list_contains(b.t, x))) >= 0.7 * len(a.t)
        GROUP BY a.template
    ),
    kept AS (SELECT * FROM lines WHERE NOT phrase OR votes = size - 1),
    parted AS (
        SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= 3 THEN 0 ELSE 1 END AS starts
        FROM kept
    ),
    runs AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM parted),
    spans AS (
        SELECT doc_id, label, phrase, count(DISTINCT diagonal) AS places, min(diagonal) AS first, max(diagonal) AS last,
            count(DISTINCT word) / max(size) AS share, list_has_all(list(DISTINCT word), coalesce(any_value(o.places), [])) AS own_found
        FROM (SELECT r.*, unnest([spot, spot + 1]) AS word FROM runs r JOIN votes v USING (doc_id, template, diagonal))
        LEFT JOIN own o USING (template)
        GROUP BY doc_id, template, label, phrase, run
    ),
    found AS (
        SELECT doc_id, sum(places) FILTER (phrase) AS n_base, min(first) FILTER (phrase) AS first_word, max(last) FILTER (phrase) AS last_word,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
            string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase OR share >= 0.7 AND own_found) AS labels, max(share) AS score
        FROM spans GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
        CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
    """


# crc32 of each distinct word: its table of 256 values, then a fold over the word's bytes.
OP11 = rf"""
WITH docs AS (SELECT doc_id, {WORDS} AS w FROM documents),
targets AS (SELECT {WORDS} AS w FROM benchmark),
crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
vocabulary AS (SELECT DISTINCT unnest(w) AS word FROM docs UNION SELECT DISTINCT unnest(w) FROM targets),
word_bytes AS (
    SELECT word, hex(encode(word)) AS h FROM vocabulary
),
buckets AS (
    SELECT word, xor(list_reduce(
        list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: CAST('0x' || h[i:i + 1] AS BIGINT))),
        lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM word_bytes, crc_table
),
features AS (SELECT doc_id, unnest(w) AS word FROM docs),
source AS (SELECT bucket, count(*) AS n FROM features JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS n FROM (SELECT unnest(w) AS word FROM targets) JOIN buckets USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln(
        (CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM source) + 10000))
        / (CAST(s.n + 1 AS DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM target) + 10000)))) AS BIGINT) AS gain
    FROM source s LEFT JOIN target t USING (bucket)
),
sums AS (
    SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total, count(*) AS n
    FROM features JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
),
weights AS (
    SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
        CAST('0x' || sha256('2024:' || d.doc_id)[1:8] AS BIGINT) AS h
    FROM docs d LEFT JOIN sums s ON s.doc_id = d.doc_id
),
scores AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weights),
drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, (SELECT count(*) FROM scores WHERE n_features >= 20) AS n
    FROM scores WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scores s LEFT JOIN drawn d ON d.doc_id = s.doc_id
"""


def _centroids(rounds: int = 10) -> str:
    """The rounds as one step of SQL each."""
    assign = """(
        SELECT row, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM (
            SELECT row, cluster, CAST(sum((x - y) * (x - y)) AS BIGINT) AS distance FROM long JOIN c{r} USING (i) GROUP BY row, cluster
        ) GROUP BY row
    )"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED {assign.format(r=r)}")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
            SELECT cluster, i, CAST(coalesce((s - ((s % n) + n) % n) // n, y) AS BIGINT) AS y
            FROM c{r} LEFT JOIN (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM long JOIN a{r} USING (row) GROUP BY cluster, i) USING (cluster, i)
        )""")
    steps.append(f"ends AS MATERIALIZED {assign.format(r=rounds)}")
    return f"""
    WITH kept AS (
        SELECT row_number() OVER () AS row, vec_id, embedding AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    long AS MATERIALIZED (
        SELECT row, i, CAST(floor(1024 * CAST(e[i] AS DOUBLE)) AS HUGEINT) AS x FROM (SELECT row, e, unnest(range(1, 65)) AS i FROM kept)
    ),
    starts AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id) - 1 AS cluster FROM kept),
    c0 AS MATERIALIZED (SELECT CAST(cluster AS INTEGER) AS cluster, i, CAST(x AS BIGINT) AS y FROM long JOIN starts USING (row) WHERE cluster < 8),
    {", ".join(steps)},
    names AS (SELECT cluster, sha256(string_agg(y, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
    SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
        CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM ends JOIN kept USING (row) JOIN names USING (cluster)
    """


OP13 = r"""
WITH plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
FROM plain
"""


def _urls() -> str:
    """Listed rules by comparison, mined ones by counting all sets of up to three of a url's surest tokens."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in LISTED)
    return rf"""
    WITH parts AS (
        SELECT row_number() OVER () AS row, page_id, contains(coalesce(url, ''), '://') AS there,
            translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
            regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
            regexp_extract(coalesce(url, ''), '\?([^#]*)', 1) AS query, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1) AS scheme
        FROM pages
    ),
    listed AS (SELECT h, p, h || p AS rule, v FROM (VALUES {rules}) AS t(h, p, v)),
    best AS (
        SELECT row, max_by(rule, (length(rule), rule)) AS rule, max_by(v, (length(rule), rule)) AS v
        FROM parts JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row
    ),
    labelled AS (SELECT parts.*, rule, v, coalesce(v = 'block', false) AS blocked FROM parts LEFT JOIN best USING (row)),
    tokens AS (
        SELECT DISTINCT row, blocked, unnest(list_concat(
            list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || regexp_replace(x, '\d+', '0', 'g')),
            list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path=' || regexp_replace(x, '\d+', '0', 'g')),
            list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: split_part(x, '=', 1)), lambda x: x <> ''), lambda x: 'query=' || x),
            ['scheme=' || scheme])) AS t
        FROM labelled WHERE there
    ),
    least AS (SELECT ceil({SUPPORT}::DOUBLE * count(DISTINCT row)) AS n FROM tokens),
    vocabulary AS (
        SELECT t, row_number() OVER (ORDER BY count(*) FILTER (blocked) / count(*) DESC, count(*) DESC, t) AS place
        FROM tokens GROUP BY t HAVING count(*) >= (SELECT n FROM least) ORDER BY place LIMIT {VOCABULARY}
    ),
    chosen AS (SELECT row, blocked, t FROM tokens JOIN vocabulary USING (t) QUALIFY row_number() OVER (PARTITION BY row ORDER BY place) <= {WIDTH}),
    sets AS (
        SELECT blocked, [t] AS s FROM chosen
        UNION ALL SELECT a.blocked, [a.t, b.t] FROM chosen a JOIN chosen b ON a.row = b.row AND a.t < b.t
        UNION ALL SELECT a.blocked, [a.t, b.t, c.t] FROM chosen a JOIN chosen b ON a.row = b.row AND a.t < b.t JOIN chosen c ON a.row = c.row AND b.t < c.t
    ),
    found AS (
        SELECT s, count(*) FILTER (blocked) / count(*) AS confidence FROM sets GROUP BY s
        HAVING count(*) FILTER (blocked) >= (SELECT n FROM least) AND count(*) FILTER (blocked) / count(*) >= {CONFIDENCE}::DOUBLE
    ),
    kept AS (
        SELECT s FROM found f WHERE NOT EXISTS (
            SELECT 1 FROM found g WHERE len(g.s) < len(f.s) AND list_has_all(f.s, g.s) AND g.confidence >= f.confidence)
    ),
    fired AS (
        SELECT DISTINCT row FROM (
            SELECT row, s FROM tokens JOIN (SELECT s, unnest(s) AS t FROM kept) USING (t) GROUP BY row, s HAVING count(*) = len(s))
    )
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN f.row IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM labelled l LEFT JOIN fired f ON f.row = l.row
    """


ORACLE_SQL = {"op1_ngram_join": OP1, "op2_html_text": OP2, "op10_licence_scan": _licences(PHRASES, SENTENCES), "op5_decontaminate": OP5, "op7_chat": OP7, "op8_url_filter": _urls(), "op9_vector_caps": OP9, "op11_importance": OP11, "op12_centroids": _centroids(), "op13_exact_dedup": OP13}
