"""DuckDB SQL of the operators that SQL expresses in reasonable time at small scale."""

WS = r"[\x20\x09-\x0D]+"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS host, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, list_filter(regexp_split_to_array(x, '{WS}'), lambda s: s <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l AS (SELECT doc_id, host, x, unnest(string_split(x, chr(10))) AS line FROM d),
lw AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '{WS}', ' ', 'g')), '[0-9]', '0', 'g') AS norm, len(list_filter(regexp_split_to_array(line, '{WS}'), lambda s: s <> '')) AS nw FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
f AS (SELECT host, norm, count(DISTINCT x) AS n FROM lw GROUP BY host, norm), h AS (SELECT host, count(DISTINCT x) AS hd FROM d GROUP BY host),
hot AS (SELECT host, norm FROM f JOIN h USING (host) WHERE n > greatest(5, least(20, hd * 2 // 100))),
lost AS (SELECT doc_id, count(*) AS removed_lines, CAST(sum(nw) AS BIGINT) AS removed_words FROM lw JOIN hot USING (host, norm) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_words, 0) AS removed_words
 FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * removed_words <= 50 * n_words AS kept FROM c"""

REACH = "reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN pair l ON l.a = r.other), comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"

NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WS}'), lambda s: s <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (sh) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
pair AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT doc_id AS id FROM documents), {REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN comp ON id = w.doc_id"""

EMBED_DEDUP = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
pair AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), nodes AS (SELECT vec_id AS id FROM embeddings), {REACH}
SELECT id AS vec_id, (SELECT count(*) FROM pair WHERE a = id) AS n_links, component_id, component_id = id AS kept FROM comp"""

#: crc32 of a text of digits: a table of bytes, then the text's bytes in order.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) AS r(i)))"


def crc32(text: str) -> str:
    """crc32 of a text, in a query that also reads ``crc``."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


def _levels(name: str, count: int) -> str:
    """The levels ``name``1 and on above ``name``0 (tree, i, h, n), and the proofs ``name``p1 and on of ``name``p0 (doc_id, tree, i, n, acc, proof, ...)."""
    out = []
    for k in range(count):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 2 AS i, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 1) // 2 AS n FROM {name}{k} GROUP BY tree, i // 2, n)")
        out.append(
            f"{name}p{k + 1} AS MATERIALIZED (SELECT q.* REPLACE (q.i // 2 AS i, (q.n + 1) // 2 AS n, proof || coalesce(s.h, '') AS proof, CASE WHEN q.n = 1 THEN acc WHEN s.h IS NULL THEN sha256(acc) WHEN q.i % 2 = 1 THEN sha256(s.h || acc) ELSE sha256(acc || s.h) END AS acc)"
            f" FROM {name}p{k} q LEFT JOIN {name}{k} s ON s.tree = q.tree AND s.i = xor(q.i, 1))"
        )
    return ",\n".join(out)


#: Up to 2**16 rows of a language and 2**6 languages.
MERKLE = f"""WITH {CRC_TABLE},
d AS (SELECT *, {_leaf('n_chars')} AS leaf, CASE WHEN {crc32('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS bad, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM documents, crc),
o AS MATERIALIZED (SELECT doc_id, leaf, bad, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
a0 AS MATERIALIZED (SELECT tree, i, leaf AS h, n FROM o), ap0 AS MATERIALIZED (SELECT doc_id, tree, i, n, leaf, bad AS acc, '' AS proof FROM o),
{_levels('a', 16)},
b0 AS MATERIALIZED (SELECT 0 AS tree, tree AS i, h, count(*) OVER () AS n FROM a16), bp0 AS MATERIALIZED (SELECT doc_id, 0 AS tree, p.tree AS i, b.n, leaf, acc, proof, b.h AS subroot FROM ap16 p JOIN b0 b ON b.i = p.tree),
{_levels('b', 6)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = h AS verified FROM bp6, b6"""

PREFIX_TRIE = f"""WITH {CRC_TABLE},
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {crc32('conv_id::VARCHAR')} % 4 AS h FROM o, crc),
r AS (SELECT h.conv_id, coalesce(b.ts, [])[1:h] || h.ts[h + 1:] AS ts FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, ts[1:d] AS k, d, d = len(ts) AS last FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256,
 CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(k[d].t, '{WS}'), lambda w: w <> '')) END AS words FROM p GROUP BY k, d),
c AS (SELECT a.k, a.d, count(b.d) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.k[1:a.d] = a.k GROUP BY a.k, a.d),
s AS (SELECT a.k, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved FROM c a JOIN c b ON b.d >= a.d AND b.k[1:a.d] = a.k JOIN n ON n.k = b.k AND n.d = b.d GROUP BY a.k, a.d)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN c USING (k, d) JOIN s USING (k, d) LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]"""
