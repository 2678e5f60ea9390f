"""DuckDB SQL for the queries whose contract SQL can express."""

from __future__ import annotations

from .common import ALNUM_WORD, SPACE_WORD
from .divergence import TERM

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


CONTAMINATION = f"""
WITH item_words AS (SELECT item_id, regexp_extract_all({_low('text')}, '{ALNUM_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT s.r, s.n, s.i, item_id FROM starts s JOIN windows v ON v.n = s.n AND v.x = s.x),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), '') AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{SPACE_WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
named AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS place, s, n FROM shingles JOIN (SELECT s, count(*) AS f FROM shingles GROUP BY s) USING (s) JOIN sizes USING (doc_id)),
heads AS (SELECT doc_id, s, n FROM named WHERE place <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
candidates AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM heads x JOIN heads y ON x.s = y.s AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
common AS (SELECT a, b, na, nb, count(*) AS i FROM candidates c JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s GROUP BY a, b, na, nb),
links AS (SELECT a, b, i, na, nb FROM common WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS other FROM both_ways UNION SELECT r.v, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comps AS (SELECT v, min(other) AS comp FROM reach GROUP BY v),
equal AS (SELECT a AS v, b AS other FROM links WHERE i = na AND i = nb UNION SELECT b, a FROM links WHERE i = na AND i = nb),
classes AS (SELECT v, least(v, min(other)) AS class FROM equal GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(comp, doc_id) AS component_id, doc_id = coalesce(comp, doc_id) AS kept, coalesce(class, doc_id) AS class_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN comps ON v = doc_id LEFT JOIN classes k ON k.v = doc_id"""

NEIGHBOURS = """
WITH valid AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

SUBSTRINGS = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents),
places AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(list_slice(w, i, i + 34), ' ') END AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs)),
again AS (SELECT x FROM places WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1),
marked AS (SELECT p.r, p.i, p.word, max(CASE WHEN a.x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM places p LEFT JOIN again a ON a.x = p.x),
kept AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS k FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (r)"""



def _crc_table() -> str:
    """The checksum of each byte, as an SQL list."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return f"{out}::BIGINT[]"


IMPORTANCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM documents),
items AS (SELECT regexp_extract_all({_low("coalesce(text, '')")}, '{ALNUM_WORD}') AS w FROM benchmark),
sizes AS (SELECT unnest([1, 2, 3]) AS k),
features AS (SELECT r, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x, count(*) AS n FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k) GROUP BY ALL),
wanted AS (SELECT array_to_string(list_slice(w, i, i + k - 1), ' ') AS x, count(*) AS n FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items, sizes WHERE len(w) >= k) GROUP BY ALL),
spelled AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM features UNION SELECT x FROM wanted)),
bytes AS (SELECT x, list_transform(range(1, strlen(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, i, 1)) - 1) + instr('0123456789ABCDEF', substr(h, i + 1, 1)) - 1) AS b FROM spelled),
hashed AS (SELECT x, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, v: xor(c >> 8, ({_crc_table()})[(xor(c, v) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM bytes),
s AS (SELECT bucket, sum(n) AS s FROM features JOIN hashed USING (x) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM wanted JOIN hashed USING (x) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM features) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM wanted) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM features JOIN hashed USING (x) JOIN gains USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM ranked) THEN rank END AS rank, n_words FROM scored LEFT JOIN ranked USING (r)"""

SUFFIXES = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, doc_id, i, b[i + 1:i + 100] AS x FROM (SELECT r, doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM docs)),
late AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, r, i) AS nth FROM starts) WHERE nth > 1),
bytes AS (SELECT r, hex(b[p + 1:p + 1]) AS c, p FROM (SELECT r, b, unnest(range(0, octet_length(b))) AS p FROM docs)),
gone AS (SELECT b.r, b.p, c, max(CASE WHEN l.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.r ORDER BY b.p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS g FROM bytes b LEFT JOIN late l ON l.r = b.r AND l.i = b.p),
turns AS (SELECT *, lead(g, 1, 0) OVER (PARTITION BY r ORDER BY p) AS g_next FROM gone),
sums AS (SELECT r, CAST(sum(g) AS BIGINT) AS n_removed, count_if(g = 1 AND g_next = 0) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (WHERE g = 0) AS kept FROM turns GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM docs LEFT JOIN sums USING (r)"""

DIVERGENCE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_low("coalesce(text, '')")}, '{TERM}') AS w FROM documents),
words AS (SELECT lang, source, r, unnest(w) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM words GROUP BY ALL),
kept AS (SELECT lang, term FROM counts GROUP BY lang, term HAVING sum(d) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (CAST(sum(n) OVER (PARTITION BY lang, source) AS HUGEINT) + 2 * v) AS BIGINT) AS p FROM dense JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (CAST(sum(n) OVER (PARTITION BY lang) AS HUGEINT) + 2 * v) AS BIGINT) AS q FROM whole JOIN sizes USING (lang)),
sums AS (SELECT x.lang, x.source, y.source AS item, CAST(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS BIGINT) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
tops AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM tops),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""

ORACLES = {
    "op3_contamination": CONTAMINATION,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op8_neighbours": NEIGHBOURS,
    "op10_substrings": SUBSTRINGS,
    "op11_importance": IMPORTANCE,
    "op12_suffixes": SUFFIXES,
    "op13_divergence": DIVERGENCE,
}
