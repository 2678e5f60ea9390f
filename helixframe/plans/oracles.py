"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from ..functions.sequence import _FORWARD, _REVERSE
from .relations import CLASSES, SQL_CHUNKS, SQL_DENSE, SQL_EDGES, SQL_GRAPH, SQL_ORDERS, SQL_PIECES, SQL_READS, SQL_SEQUENCES, SQL_STEPS, SQL_TOURS, sql_dna, sql_rc

_F = "[" + ",".join(str(int(x)) for x in _FORWARD.ravel()) + "]::UBIGINT[]"
_R = "[" + ",".join(str(int(x)) for x in _REVERSE.ravel()) + "]::UBIGINT[]"
_CONTIGS = f"contigs AS (SELECT item_id AS seg, {sql_dna('text')} AS seq FROM benchmark)"
_EXPANDED = f"expanded AS (SELECT DISTINCT w.seg, s.seq FROM walk_steps w JOIN segment_seq s ON s.seg = w.seg // {CLASSES})"


def _rotated(x: str, n: str) -> str:
    return f"(CASE WHEN ({n}) = 0 THEN {x} ELSE (({x} & ((1::UBIGINT << (64 - ({n}))) - 1)) << ({n})) | ({x} >> (64 - ({n}))) END)"


def _signed(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= 9223372036854775808 THEN CAST({x} AS HUGEINT) - 18446744073709551616 ELSE CAST({x} AS HUGEINT) END AS BIGINT)"


_CHARS = f"""{SQL_READS},
chars AS (SELECT read_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) - 1 AS p FROM reads WHERE length(seq) > 0),
marked AS (SELECT *, lag(c) OVER (PARTITION BY read_id ORDER BY p) AS prev, max(p) OVER (PARTITION BY read_id) AS stop FROM chars),
runs AS (
  SELECT read_id, row_number() OVER w - 1 AS t, p, instr('ACGT', c) - 1 AS code, coalesce(lead(p) OVER w - 1, stop) AS tail
  FROM marked WHERE prev IS NULL OR prev <> c WINDOW w AS (PARTITION BY read_id ORDER BY p))"""


def _hashes(order: int) -> str:
    return f"""{_CHARS},
raw AS (
  SELECT read_id, t, lag(CASE WHEN code < 2 THEN p ELSE tail END, {order // 2}) OVER (PARTITION BY read_id ORDER BY t) AS pos,
    bit_xor(list_extract({_F}, code * 64 + t % 64 + 1)) OVER w AS f,
    bit_xor(list_extract({_R}, code * 64 + t % 64 + 1)) OVER w AS r
  FROM runs WINDOW w AS (PARTITION BY read_id ORDER BY t ROWS BETWEEN {order - 1} PRECEDING AND CURRENT ROW)),
hashes AS (SELECT read_id, t, pos, {_rotated('f', 't % 64')} AS f, {_rotated('r', f'(64 - (t - {order - 1}) % 64) % 64')} AS r FROM raw WHERE t >= {order - 1})"""


def _samples(order: int, c: int) -> str:
    return f"""{_hashes(order)},
samples AS (
  SELECT read_id, t, pos, CASE WHEN f < r THEN f ELSE r END AS h,
    CASE WHEN f < r THEN substr('ACGT', CAST((f // {c}) % 4 AS BIGINT) + 1, 1) ELSE substr('TGCA', CAST((r // {c}) % 4 AS BIGINT) + 1, 1) END AS base
  FROM hashes WHERE (CASE WHEN f < r THEN f ELSE r END) % {c} = 0)"""


REVERSE_COMPLEMENT = f"WITH {SQL_READS} SELECT read_id, {sql_rc('seq')} AS rc FROM reads"
HOMOPOLYMER_COMPRESS = f"""WITH {_CHARS}
SELECT read_id, coalesce(string_agg(substr('ACGT', code + 1, 1), '' ORDER BY t), '') AS hpc FROM (SELECT r.read_id, code, t FROM reads r LEFT JOIN runs USING (read_id)) GROUP BY read_id"""
RUN_MIDDLE = f"""WITH {_CHARS}
SELECT read_id, count(*) AS n_runs, CAST(sum(m) AS BIGINT) AS sum_pos, CAST(sum(m * code) AS BIGINT) AS sum_weighted FROM (SELECT read_id, code, CASE WHEN code < 2 THEN p ELSE tail END AS m FROM runs) GROUP BY read_id"""
CANONICAL_KMER = f"""WITH {SQL_SEQUENCES}, k AS (SELECT seg, i - 1 AS pos, substr(seq, i, 21) AS k FROM (SELECT seg, seq, unnest(range(1, length(seq) - 19)) AS i FROM segment_seq))
SELECT seg, pos, least(k, {sql_rc('k')}) AS kmer FROM k"""
KMER_HASH = f"""WITH {SQL_SEQUENCES}, c AS (SELECT seg, instr('ACGT', unnest(string_split(seq, ''))) - 1 AS code, length(seq) - generate_subscripts(string_split(seq, ''), 1) AS n FROM segment_seq),
h AS (SELECT seg, bit_xor(list_extract({_R}, (3 - code) * 64 + n % 64 + 1)) AS h FROM c GROUP BY seg)
SELECT seg, {_signed('h')} AS hash FROM h"""


def rolling(order: int) -> str:
    return f"""WITH {_hashes(order)}, d AS (SELECT read_id, count(*) AS n_windows, bit_xor(f) AS f, bit_xor(r) AS r, count(*) FILTER (WHERE f < r) AS n_forward, CAST(sum(f % 20) AS BIGINT) AS sum_mod FROM hashes GROUP BY read_id)
SELECT read_id, n_windows, {_signed('f')} AS xor_forward, {_signed('r')} AS xor_reverse, n_forward, sum_mod FROM d"""


def sample(order: int, c: int) -> str:
    return f"WITH {_samples(order, c)} SELECT read_id, t, pos, {_signed('h')} AS hash, base FROM samples"


def reduce(order: int, c: int) -> str:
    return f"WITH {_samples(order, c)} SELECT read_id, string_agg(base, '' ORDER BY t) AS seq FROM samples GROUP BY read_id"


def reduce_pieces(order: int, c: int) -> str:
    return f"WITH {_samples(order, c).replace(SQL_READS, SQL_PIECES)} SELECT read_id // 1000000 AS read_id, CAST(read_id % 1000000 AS INTEGER) AS piece, string_agg(base, '' ORDER BY t) AS seq FROM samples GROUP BY ALL"


def reduce_inner(order: int, c: int) -> str:
    return f"WITH {_samples(order, c)}, ends AS (SELECT read_id, max(t) AS stop FROM runs GROUP BY read_id) SELECT read_id, string_agg(base, '' ORDER BY t) AS seq FROM samples JOIN ends USING (read_id) WHERE t > {order - 1} AND t < stop GROUP BY read_id"


LONGEST = f"""WITH {SQL_GRAPH}, s AS (SELECT seg, length, row_number() OVER (ORDER BY length DESC, CAST(seg AS VARCHAR)) - 1 AS place FROM segments)
SELECT place, 'contig_' || place AS name, CAST(seg AS VARCHAR) AS was, length FROM s"""
BY_NAME = f"WITH {SQL_GRAPH} SELECT CAST(seg AS VARCHAR) AS name, length, coverage FROM segments WHERE seg IN (SELECT a FROM half_edges GROUP BY a HAVING count(*) > 3)"


CIGAR = """WITH c AS (SELECT CASE WHEN l_returnflag = 'A' THEN '*' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_returnflag = 'N' THEN 'M' ELSE 'I' END END AS cigar FROM lineitem)
SELECT cigar, CASE WHEN regexp_full_match(cigar, '\\d+M') THEN CAST(replace(cigar, 'M', '') AS INTEGER) END AS overlap, count(*) AS n FROM c GROUP BY cigar"""


def _counts(k: int) -> str:
    return f"""{SQL_READS}, w AS (SELECT substr(seq, i, {k}) AS k FROM (SELECT seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads)),
counts AS (SELECT least(k, {sql_rc('k')}) AS kmer, count(*) AS n FROM w GROUP BY 1)"""


def kmer_count(k: int, least: int) -> str:
    return f"WITH {_counts(k)} SELECT kmer, n FROM counts WHERE n >= {least}"


def kmer_count_long(ks: tuple[int, ...], least: int) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({_long(k, least)})" for k in ks)


def _long(k: int, least: int) -> str:
    return f"WITH {_counts(k)} SELECT CAST({k} AS INTEGER) AS k, substr(kmer, 1, 8) AS head, n, count(*) AS n_kmers, min(kmer) AS lowest, max(kmer) AS highest FROM counts WHERE n >= {least} GROUP BY ALL"


def kmer_spectrum(k: int) -> str:
    return f"WITH {_counts(k)} SELECT n, count(*) AS n_kmers FROM counts GROUP BY n"


def contig_lookup(k: int, stride: int, contigs: str = _CONTIGS) -> str:
    return f"""WITH {SQL_READS}, {contigs},
places AS (SELECT seg, i AS cpos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT seg, seq, unnest(range(0, length(seq) - {k} + 1, {stride})) AS i FROM contigs)),
idx AS (SELECT kmer, seg, cpos FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY seg, cpos) AS n FROM places) WHERE n = 1),
w AS (SELECT read_id, i AS pos, substr(seq, i + 1, {k}) AS k FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM reads)),
f AS (SELECT read_id, pos, seg, cpos, true AS fwd FROM w JOIN idx ON k = kmer),
r AS (SELECT read_id, pos, seg, cpos, false AS fwd FROM w JOIN idx ON {sql_rc('k')} = kmer)
SELECT * FROM f UNION ALL SELECT * FROM r ANTI JOIN f USING (read_id, pos)"""


def _needed(k: int, stride: int) -> str:
    return f"""{_CONTIGS}, needed AS (SELECT DISTINCT substr(seq, place + 1, {k}) AS kmer FROM (
  SELECT seq, unnest(range(0, length(seq) - {k} + 1, {stride})) AS place FROM contigs WHERE length(seq) >= {k} UNION ALL SELECT seq, length(seq) - {k} FROM contigs WHERE length(seq) >= {k}))"""


def aligned(k: int, stride: int) -> str:
    return f"""{contig_lookup(k, stride).replace('SELECT * FROM f UNION ALL SELECT * FROM r ANTI JOIN f USING (read_id, pos)', ', hits AS (SELECT * FROM f UNION ALL SELECT * FROM r ANTI JOIN f USING (read_id, pos))')},
marked AS (SELECT *, CASE WHEN lag(seg) OVER w = seg AND lag(fwd) OVER w = fwd THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
runs AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY read_id ORDER BY pos) - 1 AS BIGINT) AS idx FROM marked)
SELECT read_id, idx, seg, fwd, min(pos) AS first, max(pos) AS last, count(*) AS n_hits FROM runs GROUP BY read_id, idx, seg, fwd"""


_HITS = "SELECT * FROM f UNION ALL SELECT * FROM r ANTI JOIN f USING (read_id, pos)"


def placed(k: int, stride: int) -> str:
    return f"""{contig_lookup(k, stride, SQL_CHUNKS).replace('WITH', 'WITH RECURSIVE', 1).replace(_HITS, f', hits AS ({_HITS})')},
sized AS (SELECT h.read_id, pos, seg, fwd, length(c.seq) - {k} - CASE WHEN fwd THEN cpos ELSE length(c.seq) - cpos - {k} END AS rest, CASE WHEN fwd THEN cpos ELSE length(c.seq) - cpos - {k} END AS start, length(d.seq) AS read_size
  FROM hits h JOIN contigs c USING (seg) JOIN reads d ON d.read_id = h.read_id),
ahead AS (SELECT *, CASE WHEN rest > 10 THEN least(CAST(floor(rest * 0.8) AS BIGINT), read_size - pos - {k} - 5) ELSE 0 END AS jump FROM sized),
probed AS (SELECT read_id, list_reduce(list({{'pos': pos, 'look': CASE WHEN jump < 0 THEN 9223372036854775807 ELSE pos + 1 + jump END, 'seen': []::BIGINT[]}} ORDER BY pos),
  lambda s, x: CASE WHEN x.pos >= s.look THEN {{'pos': x.pos, 'look': x.look, 'seen': list_append(s.seen, x.pos)}} ELSE s END, {{'pos': -1::BIGINT, 'look': 0::BIGINT, 'seen': []::BIGINT[]}}).seen AS seen FROM ahead GROUP BY read_id),
visits AS (SELECT a.*, lag(pos) OVER w AS before, CASE WHEN lag(seg) OVER w = seg AND lag(fwd) OVER w = fwd THEN 0 ELSE 1 END AS fresh FROM (SELECT read_id, unnest(seen) AS pos FROM probed) JOIN ahead a USING (read_id, pos) WINDOW w AS (PARTITION BY read_id ORDER BY pos)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY pos) - 1 AS idx FROM visits),
steps AS (SELECT read_id, idx, seg, fwd, arg_min(start, pos) AS start, arg_max(start, pos) + {k} AS stop, arg_min(pos - before - start, pos) AS gap FROM grouped GROUP BY ALL),
gaps AS (SELECT * FROM (SELECT read_id, idx, seg AS b, CASE WHEN fwd THEN 0 ELSE 1 END AS leaving, gap, lag(seg) OVER w AS from_seg, lag(fwd) OVER w AS from_fwd FROM steps WINDOW w AS (PARTITION BY read_id ORDER BY idx)) WHERE from_seg IS NOT NULL),
walk AS (
  SELECT DISTINCT b, leaving, gap, b AS last, leaving AS side, CAST(gap AS BIGINT) AS rest, CAST([] AS STRUCT(seg BIGINT, fwd BOOLEAN)[]) AS path, false AS stuck FROM gaps
  UNION ALL
  SELECT w.b, w.leaving, w.gap, coalesce(e.b, w.last), CASE WHEN e.b IS NULL THEN w.side ELSE 1 - e.eb END, w.rest - coalesce(greatest(length(c.seq) - 30, 1), 0), CASE WHEN e.b IS NULL THEN w.path ELSE list_append(w.path, {{'seg': e.b, 'fwd': e.eb = 0}}) END, e.b IS NULL
  FROM walk w LEFT JOIN half_edges e ON e.a = w.last AND e.ea = w.side LEFT JOIN contigs c ON c.seg = e.b WHERE w.rest > 0 AND NOT w.stuck),
listed AS (SELECT *, count(*) OVER (PARTITION BY b, leaving, gap) AS n, count(*) OVER (PARTITION BY b, leaving, gap, last) AS m FROM walk WHERE rest <= 0 OR stuck),
fits AS (SELECT g.read_id, g.idx, l.path FROM gaps g JOIN listed l ON l.b = g.b AND l.leaving = g.leaving AND l.gap = g.gap AND l.last = g.from_seg AND n < 50 AND m = 1 AND from_fwd <> CASE WHEN len(l.path) = 0 THEN g.leaving = 1 ELSE l.path[-1].fwd END),
cuts AS (SELECT s.*, CASE WHEN s.idx > 0 AND f.idx IS NULL THEN 1 ELSE 0 END AS cut, coalesce(array_to_string(list_reverse(list_transform(f.path[1:len(f.path) - 1], lambda x: CASE WHEN x.fwd THEN '<' ELSE '>' END || x.seg)), ''), '') || CASE WHEN s.fwd THEN '>' ELSE '<' END || s.seg AS t FROM steps s LEFT JOIN fits f USING (read_id, idx)),
pieces AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY read_id ORDER BY idx) AS BIGINT) AS piece FROM cuts)
SELECT read_id, piece, string_agg(t, '' ORDER BY idx) AS path, CAST(arg_min(start, idx) AS INTEGER) AS start, CAST(arg_max(stop, idx) AS INTEGER) AS stop FROM pieces GROUP BY read_id, piece"""


def spelled(overlap: int) -> str:
    return f"""WITH {SQL_STEPS}, {SQL_SEQUENCES}, t AS (SELECT read_id, idx, CASE WHEN fwd THEN seq ELSE {sql_rc('seq')} END AS t FROM walk_steps w JOIN segment_seq s ON s.seg = w.seg // {CLASSES})
SELECT read_id, string_agg(CASE WHEN idx = 0 THEN t ELSE substr(t, {overlap + 1}) END, '' ORDER BY idx) AS seq FROM t GROUP BY read_id"""


def needed(k: int, stride: int) -> str:
    return f"WITH {_needed(k, stride)} SELECT kmer FROM needed"


def semi_join(k: int, stride: int) -> str:
    return f"""WITH {SQL_READS}, {_needed(k, stride)},
w AS (SELECT read_id, i AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM reads))
SELECT read_id, pos, kmer FROM w WHERE kmer IN (SELECT kmer FROM needed) OR {sql_rc('kmer')} IN (SELECT kmer FROM needed)"""


def _dictionary(order: int, c: int, km: int) -> str:
    return f"""{_samples(order, c)},
short AS (SELECT read_id, string_agg(base, '' ORDER BY t) AS s, list(pos ORDER BY t) AS places FROM samples GROUP BY read_id),
windows AS (SELECT s.read_id, i - 1 AS i, substr(s.s, i - {km} + 1, {km}) AS k, substr(r.seq, places[i - {km} + 11] + 1, places[i - 10] - places[i - {km} + 11] + 1) AS z
  FROM (SELECT read_id, s, places, unnest(range({km}, length(s) + 1)) AS i FROM short) s JOIN reads r USING (read_id)),
seen AS (SELECT read_id, i, CASE WHEN {sql_rc('k')} < k THEN {sql_rc('k')} ELSE k END AS kmer, CASE WHEN {sql_rc('k')} < k THEN {sql_rc('z')} ELSE z END AS central FROM windows),
nth AS (SELECT *, row_number() OVER (PARTITION BY kmer, central ORDER BY read_id, i) AS n FROM seen),
each AS (SELECT kmer, central, min((read_id, i)) AS first, min((read_id, i)) FILTER (WHERE n = 4) AS fourth FROM nth GROUP BY kmer, central),
best AS (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY fourth IS NULL, coalesce(fourth, first), central) AS n FROM each),
words AS (SELECT kmer, central, fourth IS NOT NULL AS confirmed FROM best WHERE n = 1)"""


def dictionary(order: int, c: int, km: int) -> str:
    return f"WITH {_dictionary(order, c, km)} SELECT kmer, central, confirmed FROM words"


def inflate(order: int, c: int, km: int) -> str:
    return f"""WITH {_dictionary(order, c, km)},
asked AS (SELECT read_id AS seg, place, substr(s, place + 1, {km}) AS k FROM (SELECT read_id, s, unnest(range(0, length(s) - {km} + 1, {km - 21})) AS place FROM short WHERE length(s) >= {km})),
found AS (SELECT seg, place, CASE WHEN {sql_rc('k')} < k THEN {sql_rc('central')} ELSE central END AS z FROM asked LEFT JOIN words ON kmer = least(k, {sql_rc('k')})),
sized AS (SELECT *, coalesce(last_value(length(z) IGNORE NULLS) OVER (PARTITION BY seg ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM found)
SELECT seg, string_agg(CASE WHEN z IS NULL THEN repeat('N', before) WHEN place = 0 OR length(z) = 0 THEN z ELSE substr(z, 2) END, '' ORDER BY place) AS seq, count(*) FILTER (WHERE z IS NULL) AS missing FROM sized GROUP BY seg"""


def inflate_linked(order: int, c: int, km: int, cut: tuple[int, int] | None) -> str:
    size, lap = cut or (1 << 30, 0)
    step = size - lap
    rc = sql_rc
    overlapping = lambda n, same: f"coalesce(list_filter(range({n}, 0, -1), lambda o: {same})[1], 0)"
    return f"""WITH {_samples(order, c)},
short AS (SELECT read_id, string_agg(base, '' ORDER BY t) AS s, list(pos ORDER BY t) AS places FROM samples GROUP BY read_id),
cuts AS (SELECT read_id * 100000 + j AS seg, substr(s, {step} * j + 1, {size}) AS seq FROM (SELECT read_id, s, unnest(range(0, greatest(1, (length(s) - {lap} + {step} - 1) // {step}))) AS j FROM short)),
contigs AS (SELECT {'seg' if cut else 'seg // 100000 AS seg'}, seq FROM cuts),
longer AS (SELECT x.seg, x.seq, CASE WHEN length(y.seq) > {lap + 10} THEN substr(y.seq, length(y.seq) - {lap + 9}, 10) END AS l, CASE WHEN length(z.seq) > {lap + 10} THEN substr(z.seq, {lap + 1}, 10) END AS r
  FROM contigs x LEFT JOIN contigs y ON {'y.seg = x.seg - 1' if cut else 'false'} LEFT JOIN contigs z ON {'z.seg = x.seg + 1' if cut else 'false'}),
extended AS (SELECT seg, coalesce(l, '') || seq || coalesce(r, '') AS seq, l IS NULL AS open_left, r IS NULL AS open_right FROM longer),
able AS (SELECT * FROM extended WHERE length(seq) >= {km}),
at_all AS (SELECT seg, 0 AS role, spot, substr(seq, spot + 1, {km}) AS k, false AS is_full FROM (SELECT seg, seq, unnest(range(0, length(seq) - {km} + 1, {km - 21})) AS spot FROM able)
  UNION ALL SELECT seg, 1, 0, substr(seq, 1, {km}), true FROM able WHERE open_left UNION ALL SELECT seg, 2, length(seq) - {km}, substr(seq, length(seq) - {km - 1}, {km}), open_right FROM able),
asked AS (SELECT *, least(k, {rc('k')}) AS kmer, {rc('k')} < k AS turned FROM at_all),
needed AS (SELECT kmer, bool_or(is_full) AS is_full FROM asked GROUP BY kmer),
windows AS (SELECT s.read_id, i - 1 AS i, substr(s.s, i - {km} + 1, {km}) AS k, substr(r.seq, places[i - {km} + 11] + 1, places[i - 10] - places[i - {km} + 11] + 1) AS z,
    substr(r.seq, greatest(0, places[i - {km} + 1] - {order}) + 1, places[i] + {order} + 1 - greatest(0, places[i - {km} + 1] - {order})) AS y
  FROM (SELECT read_id, s, places, unnest(range({km}, length(s) + 1)) AS i FROM short) s JOIN reads r USING (read_id)),
seen AS (SELECT read_id, i, kmer, CASE WHEN k = kmer THEN z ELSE {rc('z')} END AS central, CASE WHEN is_full THEN CASE WHEN k = kmer THEN y ELSE {rc('y')} END END AS whole FROM windows JOIN needed ON kmer = least(k, {rc('k')})),
nth AS (SELECT *, row_number() OVER (PARTITION BY kmer, whole, central ORDER BY read_id, i) AS n FROM seen),
each AS (SELECT kmer, whole, central, min((read_id, i)) AS first, min((read_id, i)) FILTER (WHERE n = 4) AS fourth FROM nth GROUP BY kmer, whole, central),
words AS (SELECT kmer, central, whole FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY fourth IS NULL, coalesce(fourth, first)) AS n FROM each) WHERE n = 1),
texts AS (SELECT seg, role, spot, CASE WHEN turned THEN {rc('t')} ELSE t END AS t FROM (SELECT a.*, CASE WHEN a.is_full THEN whole ELSE central END AS t FROM asked a LEFT JOIN words w USING (kmer))),
sized AS (SELECT *, coalesce(last_value(length(t) IGNORE NULLS) OVER (PARTITION BY seg ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM texts WHERE role = 0),
middle AS (SELECT seg, string_agg(CASE WHEN t IS NULL THEN repeat('N', before) WHEN spot = 0 OR length(t) = 0 THEN t ELSE substr(t, 2) END, '' ORDER BY spot) AS seq, count(*) FILTER (WHERE t IS NULL) AS missing FROM sized GROUP BY seg),
sides AS (SELECT seg, max(t) FILTER (WHERE role = 1) AS h, max(t) FILTER (WHERE role = 2) AS e, count(*) FILTER (WHERE t IS NULL) AS gone FROM texts WHERE role > 0 GROUP BY seg),
begun AS (SELECT seg, e, missing + gone AS missing, CASE WHEN h IS NULL OR length(h) = 0 THEN seq ELSE substr(h, 1, length(h) - {overlapping('length(h)', "substr(h, CAST(length(h) - o + 1 AS BIGINT), least(o, 30, length(seq))) = substr(seq, 1, least(o, 30, length(seq)))")}) || seq END AS seq FROM middle JOIN sides USING (seg)),
ended AS (SELECT seg, missing, CASE WHEN e IS NULL OR least(length(e), length(seq)) = 0 THEN seq ELSE seq || substr(e, {overlapping('least(length(e), length(seq))', "substr(e, CAST(o - least(o, 30) + 1 AS BIGINT), least(o, 30)) = substr(seq, length(seq) - least(o, 30) + 1, least(o, 30))")} + 1) END AS seq FROM begun)
SELECT seg, seq, missing FROM ended UNION ALL SELECT seg, repeat('N', length(seq) * 20), 0 FROM extended WHERE length(seq) < {km}"""


def next_k(k: int, copies: int) -> str:
    return f"WITH {_CONTIGS} SELECT seg || '_' || i AS name, seq FROM (SELECT seg, seq, unnest(range(0, {copies})) AS i FROM contigs WHERE length(seq) >= {k})"


_SIDES = "sides AS (SELECT a AS seg, count(*) FILTER (WHERE ea = 0) AS l, count(*) FILTER (WHERE ea = 1) AS r FROM half_edges GROUP BY a)"
_SHAPE = f"{_SIDES}, shape AS (SELECT s.*, coalesce(l, 0) AS l, coalesce(r, 0) AS r FROM segments s LEFT JOIN sides USING (seg))"
_NEAR = "near AS (SELECT e.*, s.coverage AS b_cov, s.length AS b_len FROM half_edges e JOIN segments s ON s.seg = e.b)"
_BUBBLES = """ends AS (SELECT a, ea, count(*) AS n, min(b) AS lo, max(b) AS hi FROM half_edges GROUP BY a, ea),
beside AS (SELECT e.a AS seg, e.ea, CASE WHEN q.lo = e.a THEN q.hi ELSE q.lo END AS sibling
  FROM half_edges e JOIN ends o ON o.a = e.a AND o.ea = e.ea AND o.n = 1 JOIN ends q ON q.a = e.b AND q.ea = e.eb AND q.n = 2),
bubbles AS (SELECT seg, min(sibling) AS sibling FROM beside GROUP BY seg HAVING count(*) = 2 AND min(sibling) = max(sibling) AND min(sibling) <> seg)"""
HALF_EDGES = f"WITH {SQL_STEPS}, {SQL_EDGES} SELECT a, ea, b, eb FROM half_edges"
DEGREE = f"WITH {SQL_STEPS}, {SQL_EDGES} SELECT a AS seg, ea AS side, count(*) AS degree FROM half_edges GROUP BY 1, 2"
BEST_NEIGHBOUR = f"""WITH {SQL_GRAPH}, {_NEAR}, n AS (SELECT *, row_number() OVER (PARTITION BY a, ea ORDER BY b_cov DESC, b, eb) AS n FROM near)
SELECT a AS seg, ea AS side, b AS best, b_cov AS best_cov FROM n WHERE n = 1"""


def shave(longest: int) -> str:
    return f"WITH {SQL_GRAPH}, {_SHAPE} SELECT seg, length, coverage FROM shape WHERE length > {longest} OR (l > 0 AND r > 0)"


BUBBLES = f"WITH {SQL_ORDERS}, {_BUBBLES} SELECT seg, sibling FROM bubbles"
POPPED = f"""WITH {SQL_ORDERS}, summed AS (SELECT *, sum(coverage) OVER (PARTITION BY s) AS total FROM ways),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY (length * coverage + 1000 * total) / (length + 1000) DESC, o) AS n FROM summed),
lost AS (SELECT * FROM ranked WHERE n > 1),
links AS (SELECT s AS a, 1 AS ea, o AS b, 0 AS eb FROM lost UNION SELECT o, 1, s + 1, 0 FROM lost)
SELECT CASE WHEN a < b THEN a ELSE b END AS a, CASE WHEN a < b THEN ea ELSE eb END AS ea, CASE WHEN a < b THEN b ELSE a END AS b, CASE WHEN a < b THEN eb ELSE ea END AS eb FROM links"""


def _weak(c: float, n: int) -> str:
    return f"(coverage < {c} AND (length < {n} OR coverage = 1))"


def trim(c: float, n: int) -> str:
    return f"""WITH {SQL_GRAPH}, {_SHAPE}, {_BUBBLES}
SELECT seg FROM shape WHERE (l = 0 OR r = 0) AND {_weak(c, n)} UNION SELECT seg FROM segments JOIN bubbles USING (seg) WHERE coverage = 1"""


def detach(c: float, n: int) -> str:
    return f"""WITH {SQL_GRAPH}, {_SHAPE}, {_NEAR},
open_cut AS (SELECT a, ea, b, eb FROM near JOIN shape ON seg = a WHERE (l = 0 OR r = 0) AND NOT {_weak(c, n)} AND b_cov > 2 * coverage),
judged AS (SELECT n.a FROM near n JOIN shape s ON s.seg = n.a WHERE l > 0 AND r > 0 GROUP BY n.a HAVING bool_and(b_cov >= 2 * coverage AND EXISTS (
  SELECT 1 FROM near o WHERE o.a = n.b AND o.ea = n.eb AND NOT (o.b = n.a AND o.eb = n.ea) AND o.b_cov >= 2 * coverage))),
cut AS (SELECT * FROM open_cut UNION SELECT a, ea, b, eb FROM half_edges WHERE a IN (SELECT a FROM judged)),
both_ways AS (SELECT * FROM cut UNION SELECT b, eb, a, ea FROM cut)
SELECT a, ea, b, eb FROM both_ways WHERE a < b OR (a = b AND ea <= eb)"""


LINKS_KEPT = f"WITH {SQL_GRAPH}, k AS (SELECT seg FROM segments WHERE coverage >= 2) SELECT a, ea, b, eb FROM half_edges WHERE a IN (SELECT seg FROM k) AND b IN (SELECT seg FROM k)"
LINKS_REMOVED = f"WITH {SQL_GRAPH}, k AS (SELECT seg FROM segments WHERE coverage >= 2) SELECT a, ea, b, eb FROM half_edges WHERE NOT (a IN (SELECT seg FROM k) AND b IN (SELECT seg FROM k))"
COVERAGE = f"""WITH {SQL_GRAPH}, p AS (SELECT w.seg, length, sum(length) OVER (PARTITION BY read_id ORDER BY idx DESC) AS rest FROM walk_steps w JOIN segments USING (seg))
SELECT seg, round(sum(least(1.0, rest / length)), 6) AS coverage FROM p GROUP BY seg"""


def overlap(most: int, default: int) -> str:
    return f"""WITH {SQL_STEPS}, {SQL_EDGES}, {SQL_SEQUENCES}, {_EXPANDED},
p AS (SELECT a, ea, b, eb, CASE WHEN ea = 1 THEN x.seq ELSE {sql_rc('x.seq')} END AS s1, CASE WHEN eb = 0 THEN y.seq ELSE {sql_rc('y.seq')} END AS s2
  FROM half_edges JOIN expanded x ON x.seg = a JOIN expanded y ON y.seg = b WHERE a < b OR (a = b AND ea <= eb)),
f AS (SELECT *, instr(s2, right(s1, 30)) AS place FROM p)
SELECT a, ea, b, eb, CAST(CASE WHEN length(s1) < 30 OR length(s2) < 30 THEN 0 WHEN place = 0 OR place + 29 > {most} THEN {default} ELSE place + 29 END AS INTEGER) AS overlap FROM f"""


LINK_LINES = f"""WITH {SQL_GRAPH}, e AS (SELECT lpad(CAST(a AS VARCHAR), 12, '0') AS a, ea, lpad(CAST(b AS VARCHAR), 12, '0') AS b, eb FROM half_edges)
SELECT 'S' || chr(9) || seg || chr(9) || '*' || chr(9) || 'DP:f:' || CAST(coverage AS INTEGER) || chr(9) || 'LN:i:' || length AS line FROM segments
UNION ALL SELECT 'L' || chr(9) || a || chr(9) || CASE WHEN ea = 1 THEN '+' ELSE '-' END || chr(9) || b || chr(9) || CASE WHEN eb = 0 THEN '+' ELSE '-' END || chr(9) || '0M' FROM e WHERE a < b OR (a = b AND ea <= eb)"""
SORT_GFA = """WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'S' WHEN 2 THEN 'H' ELSE '#' END || chr(9) || user_id || chr(9) || event_type AS line FROM events)
SELECT row_number() OVER (ORDER BY line[1] DESC, event_id) - 1 AS place, line FROM l WHERE line[1] IN ('S', 'L')"""
COPY_NUMBERS = "SELECT user_id || '_' || event_type AS name, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS \"copy\" FROM events"
ADD_COVERAGES = f"""WITH {SQL_STEPS}, v AS (SELECT seg // {CLASSES} AS part, count(*) AS n FROM walk_steps GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS name, CAST(coalesce(n, 0) AS DOUBLE) AS coverage FROM part LEFT JOIN v ON part = p_partkey"""

_CONTRACTIBLE = """single AS (SELECT a, ea FROM half_edges GROUP BY a, ea HAVING count(*) = 1),
links AS (SELECT e.* FROM half_edges e JOIN single x ON x.a = e.a AND x.ea = e.ea JOIN single y ON y.a = e.b AND y.ea = e.eb WHERE e.a <> e.b)"""
CONTRACTIBLE = f"WITH {SQL_STEPS}, {SQL_EDGES}, {_CONTRACTIBLE} SELECT a, ea, b, eb FROM links"
MERGED = f"""WITH RECURSIVE {SQL_GRAPH}, {_CONTRACTIBLE},
reach AS (SELECT seg, seg AS other FROM segments UNION SELECT r.seg, l.b FROM reach r JOIN links l ON l.a = r.other),
tips AS (SELECT seg FROM segments WHERE seg NOT IN (SELECT a FROM links GROUP BY a HAVING count(*) = 2)),
named AS (SELECT r.seg, coalesce(min(other) FILTER (WHERE other IN (SELECT seg FROM tips)), min(other)) AS chain FROM reach r GROUP BY r.seg)
SELECT chain AS seg, CAST(sum(length) AS INTEGER) AS length, round(sum(coverage * length) / sum(length), 6) AS coverage, count(*) AS parts FROM named JOIN segments USING (seg) GROUP BY chain"""

_PLACED = f"""{_CONTRACTIBLE},
reach AS (SELECT seg, seg AS other FROM segments UNION SELECT r.seg, l.b FROM reach r JOIN links l ON l.a = r.other),
tips AS (SELECT seg FROM segments WHERE seg NOT IN (SELECT a FROM links GROUP BY a HAVING count(*) = 2)),
named AS (SELECT r.seg, coalesce(min(other) FILTER (WHERE other IN (SELECT seg FROM tips)), min(other)) AS chain, count(*) FILTER (WHERE other IN (SELECT seg FROM tips)) = 0 AS ring FROM reach r GROUP BY r.seg),
inner_ends AS (SELECT a AS seg, ea AS side FROM links),
open_ends AS (SELECT seg, chain, side, (SELECT count(*) FROM inner_ends i WHERE i.seg = named.seg) AS n FROM named, (SELECT unnest([0, 1]) AS side) e WHERE NOT ring AND NOT EXISTS (SELECT 1 FROM inner_ends i WHERE i.seg = named.seg AND i.side = e.side)),
outer_ends AS (SELECT seg, side, chain, CASE WHEN n = 0 THEN side WHEN seg = chain THEN 0 ELSE 1 END AS of_chain FROM open_ends
  UNION ALL SELECT seg, 0, chain, 0 FROM named WHERE ring AND seg = chain UNION ALL SELECT b, eb, chain, 1 FROM named JOIN links ON a = seg AND ea = 0 WHERE ring AND seg = chain)"""
MERGED_LINKS = f"""WITH RECURSIVE {SQL_GRAPH}, {_PLACED},
rest AS (SELECT e.* FROM half_edges e ANTI JOIN (SELECT l.* FROM links l JOIN named ON named.seg = l.a AND NOT ring) l ON l.a = e.a AND l.ea = e.ea AND l.b = e.b AND l.eb = e.eb)
SELECT DISTINCT x.chain AS a, x.of_chain AS ea, y.chain AS b, y.of_chain AS eb FROM rest r JOIN outer_ends x ON x.seg = r.a AND x.side = r.ea JOIN outer_ends y ON y.seg = r.b AND y.side = r.eb"""
MERGED_SEQUENCES = f"""WITH RECURSIVE {SQL_GRAPH}, {SQL_SEQUENCES}, {_EXPANDED}, {_PLACED},
line AS (SELECT seg, chain, CAST(0 AS BIGINT) AS idx, CASE WHEN ring THEN true ELSE EXISTS (SELECT 1 FROM inner_ends i WHERE i.seg = named.seg AND i.side = 1) OR NOT EXISTS (SELECT 1 FROM inner_ends i WHERE i.seg = named.seg) END AS fwd, 0 AS lap FROM named WHERE seg = chain
  UNION ALL SELECT l.b, w.chain, w.idx + 1, l.eb = 0, (l.a + l.b) % 5 FROM line w JOIN links l ON l.a = w.seg AND l.ea = CASE WHEN w.fwd THEN 1 ELSE 0 END WHERE l.b <> w.chain)
SELECT chain AS seg, string_agg(substr(CASE WHEN fwd THEN seq ELSE {sql_rc('seq')} END, CAST(lap AS INTEGER) + 1), '' ORDER BY idx) AS seq FROM line JOIN expanded USING (seg) GROUP BY chain"""
MINIMUM = f"WITH {SQL_GRAPH} SELECT read_id, min(coverage) AS coverage FROM walk_steps JOIN segments USING (seg) GROUP BY read_id"
COUNTERS = f"WITH {SQL_STEPS}, n AS (SELECT read_id, count(*) AS n FROM walk_steps GROUP BY read_id) SELECT count(*) AS n_walks, count(*) FILTER (WHERE n = 1) AS n_single FROM n"


def bounded(budget: int) -> str:
    return f"""WITH RECURSIVE {SQL_GRAPH},
walk AS (
  SELECT s.seg, e.side, s.seg AS last, e.side AS leaving, CAST({budget} AS BIGINT) AS rest, '' AS path, CAST(0 AS BIGINT) AS length, false AS stuck FROM segments s, (SELECT unnest([0, 1]) AS side) e
  UNION ALL
  SELECT w.seg, w.side, coalesce(e.b, w.last), CASE WHEN e.b IS NULL THEN w.leaving ELSE 1 - e.eb END, w.rest - coalesce(s.length, 0),
    w.path || CASE WHEN e.b IS NULL THEN '' ELSE CASE WHEN e.eb = 0 THEN '>' ELSE '<' END || e.b END, w.length + coalesce(s.length, 0), e.b IS NULL
  FROM walk w LEFT JOIN half_edges e ON e.a = w.last AND e.ea = w.leaving LEFT JOIN segments s ON s.seg = e.b WHERE w.rest > 0 AND NOT w.stuck),
done AS (SELECT *, count(*) OVER (PARTITION BY seg, side) AS n FROM walk WHERE rest <= 0 OR stuck)
SELECT seg, side, path, length FROM done WHERE n < 50"""


PARSED = f"WITH {SQL_STEPS} SELECT read_id, idx, seg, fwd FROM walk_steps"
SPLIT = f"""WITH {SQL_GRAPH}, k AS (SELECT seg FROM segments WHERE coverage >= 2),
kept AS (SELECT * FROM half_edges WHERE a IN (SELECT seg FROM k) AND b IN (SELECT seg FROM k)),
pairs AS (SELECT *, lag(seg) OVER w AS a, CASE WHEN lag(fwd) OVER w THEN 1 ELSE 0 END AS ea, CASE WHEN fwd THEN 0 ELSE 1 END AS eb FROM walk_steps WINDOW w AS (PARTITION BY read_id ORDER BY idx)),
cuts AS (SELECT p.*, CASE WHEN p.a IS NOT NULL AND k.a IS NULL THEN 1 ELSE 0 END AS cut FROM pairs p LEFT JOIN kept k ON k.a = p.a AND k.ea = p.ea AND k.b = p.seg AND k.eb = p.eb),
pieces AS (SELECT read_id, idx, seg, fwd, CAST(sum(cut) OVER (PARTITION BY read_id ORDER BY idx) AS BIGINT) AS piece FROM cuts)
SELECT read_id, piece, row_number() OVER (PARTITION BY read_id, piece ORDER BY idx) - 1 AS idx, seg, fwd FROM pieces"""
_SUPPORT = f"""{SQL_STEPS},
beyond AS (
  SELECT o.read_id, o.idx, o.seg, CASE WHEN o.fwd THEN 1 ELSE 0 END AS side, n.idx - o.idx AS depth, CASE WHEN n.fwd THEN '>' ELSE '<' END || n.seg AS t FROM walk_steps o JOIN walk_steps n ON n.read_id = o.read_id AND n.idx > o.idx
  UNION ALL
  SELECT o.read_id, o.idx, o.seg, CASE WHEN o.fwd THEN 0 ELSE 1 END, o.idx - n.idx, CASE WHEN n.fwd THEN '<' ELSE '>' END || n.seg FROM walk_steps o JOIN walk_steps n ON n.read_id = o.read_id AND n.idx < o.idx),
strings AS (SELECT *, string_agg(t, '') OVER (PARTITION BY read_id, idx, side ORDER BY depth) AS prefix, coalesce(string_agg(t, '') OVER (PARTITION BY read_id, idx, side ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS parent FROM beyond),
counted AS (SELECT seg, side, prefix, parent, depth, count(*) AS support FROM strings GROUP BY ALL),
support AS (SELECT *, CAST(sum(support) OVER (PARTITION BY seg, side, parent) - support AS BIGINT) AS against FROM counted)"""
SUPPORT = f"WITH {_SUPPORT} SELECT seg, side, prefix, CAST(depth AS INTEGER) AS depth, support, against FROM support"
_MAXIMAL = "maximal AS (SELECT seg, side, prefix AS path, depth FROM support s WHERE NOT EXISTS (SELECT 1 FROM support o WHERE o.seg = s.seg AND o.side = s.side AND o.parent = s.prefix))"
MAXIMAL = f"""WITH {SQL_STEPS},
walked AS (SELECT list(CASE WHEN fwd THEN '>' ELSE '<' END || seg ORDER BY idx) AS f, list(CASE WHEN fwd THEN '<' ELSE '>' END || seg ORDER BY idx DESC) AS r, list(seg ORDER BY idx) AS s, list(fwd ORDER BY idx) AS d, count(*) AS n FROM walk_steps GROUP BY read_id),
ways AS (SELECT s[i] AS seg, CASE WHEN d[i] THEN 1 ELSE 0 END AS side, f[i + 1:n] AS t FROM (SELECT *, unnest(range(1, n)) AS i FROM walked)
  UNION SELECT s[i], CASE WHEN d[i] THEN 0 ELSE 1 END, r[n - i + 2:n] FROM (SELECT *, unnest(range(2, n + 1)) AS i FROM walked)),
padded AS (SELECT seg, side, array_to_string(t, '') AS path, array_to_string(list_transform(t, lambda x: x[1] || lpad(x[2:], 12, '0')), '') AS key FROM ways),
lines AS (SELECT *, lead(key) OVER (PARTITION BY seg, side ORDER BY key) AS follower FROM padded)
SELECT seg, side, path FROM lines WHERE follower IS NULL OR NOT starts_with(follower, key)"""


def _whole(name: str, ok: str) -> str:
    return f"""{name} AS (SELECT seg, side, prefix, parent, depth FROM support WHERE depth = 1 AND ({ok}) UNION ALL
  SELECT s.seg, s.side, s.prefix, s.parent, s.depth FROM support s JOIN {name} p ON p.seg = s.seg AND p.side = s.side AND p.prefix = s.parent WHERE {ok.replace('support', 's.support').replace('against', 's.against')})"""


def _strong(steps: str, least: int) -> str:
    return f"""{_SUPPORT.replace(SQL_STEPS, steps)}, {_whole('strong', f'support >= {least} AND (against = 0 OR support > 4)')},
strongest AS (SELECT seg, side, prefix AS path, depth FROM (SELECT *, row_number() OVER (PARTITION BY seg, side ORDER BY depth DESC, prefix) AS n FROM strong) WHERE n = 1)"""


_CONSENSUS = f"""segs AS (SELECT DISTINCT seg FROM walk_steps), {_MAXIMAL}, {_whole('fine', '0.2 * (support - 1) > against - 1 AND against < 5')},
n AS (SELECT f.seg, f.side, f.prefix AS path, row_number() OVER (PARTITION BY f.seg, f.side ORDER BY f.depth DESC, f.prefix) AS n FROM fine f JOIN maximal m ON m.seg = f.seg AND m.side = f.side AND m.path = f.prefix),
win AS (SELECT seg, side, path FROM n WHERE n = 1),
up AS (SELECT seg, side, path, path AS prefix FROM win UNION ALL SELECT u.seg, u.side, u.path, s.parent FROM up u JOIN support s ON s.seg = u.seg AND s.side = u.side AND s.prefix = u.prefix WHERE s.parent <> ''),
kept AS (SELECT u.seg, u.side, arg_max(u.prefix, s.depth) FILTER (WHERE s.support > 1) AS kept FROM up u JOIN support s ON s.seg = u.seg AND s.side = u.side AND s.prefix = u.prefix GROUP BY u.seg, u.side),
walked AS (SELECT DISTINCT seg, side FROM support),
wide AS (SELECT w.seg, max(CASE WHEN w.side = 0 THEN coalesce(kept, '') END) AS l, max(CASE WHEN w.side = 1 THEN coalesce(kept, '') END) AS r, count(*) FILTER (WHERE k.seg IS NULL) AS open FROM walked w LEFT JOIN kept k ON k.seg = w.seg AND k.side = w.side GROUP BY w.seg),
agreed AS (SELECT s.seg, coalesce(l, '') AS left_path, coalesce(r, '') AS right_path, coalesce(open, 0) = 0 AS haploid FROM segs s LEFT JOIN wide USING (seg))"""
STRONG = f"WITH RECURSIVE {_strong(SQL_DENSE, 2)} SELECT seg, side, path, CAST(depth AS INTEGER) AS depth FROM strongest"
CONSENSUS = f"WITH RECURSIVE {_SUPPORT}, {_CONSENSUS} SELECT seg, left_path, right_path, haploid FROM agreed"
_BRIDGES = """ways AS (SELECT seg, side, regexp_extract_all(path, '[<>][0-9]+') AS t FROM (SELECT seg, 0 AS side, left_path AS path FROM agreed WHERE haploid UNION ALL SELECT seg, 1, right_path FROM agreed WHERE haploid)),
others AS (SELECT seg, side, t, i, CAST(substr(t[i], 2) AS BIGINT) AS target, CASE WHEN t[i][1] = '>' THEN 0 ELSE 1 END AS target_side FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM ways)),
met AS (SELECT *, row_number() OVER (PARTITION BY seg, side ORDER BY i) AS n FROM others WHERE target <> seg AND target IN (SELECT seg FROM agreed WHERE haploid)),
found AS (SELECT seg, side, target, target_side, array_to_string(t[1:i], '') AS path FROM met WHERE n = 1),
bridges AS (SELECT f.* FROM found f JOIN found b ON b.seg = f.target AND b.side = f.target_side AND b.target = f.seg AND b.target_side = f.side WHERE f.seg < f.target OR (f.seg = f.target AND f.side <= f.target_side))"""


def _sign(side: str) -> str:
    return f"CASE WHEN {side} = 1 THEN '>' ELSE '<' END"


def _flipped(path: str) -> str:
    return f"array_to_string(list_reverse(list_transform(regexp_extract_all({path}, '[<>][0-9]+'), lambda x: CASE WHEN x[1] = '>' THEN '<' ELSE '>' END || substr(x, 2))), '')"


_UNREPRESENTED = f"""built AS (SELECT {_sign('side')} || seg || path AS line FROM bridges),
lines AS (SELECT line FROM built UNION ALL SELECT {_flipped('line')} FROM built),
walked_on AS (SELECT seg, side, path, {_sign('side')} || seg || path AS walk FROM strongest),
loose AS (SELECT * FROM walked_on w WHERE NOT EXISTS (SELECT 1 FROM lines WHERE contains(line || '>', walk || '>') OR contains(line || '>', walk || '<'))),
unrepresented AS (SELECT seg, side, path FROM loose WHERE seg IN (SELECT seg FROM loose GROUP BY seg HAVING count(DISTINCT side) = 2))"""
_TOURED = _SUPPORT.replace(SQL_STEPS, SQL_TOURS)
BRIDGES = f"WITH RECURSIVE {_TOURED}, {_CONSENSUS}, {_BRIDGES} SELECT * FROM bridges"
UNREPRESENTED = f"WITH RECURSIVE {_strong(SQL_TOURS, 2)}, {_CONSENSUS}, {_BRIDGES}, {_UNREPRESENTED} SELECT * FROM unrepresented"


def _untangled(least: int) -> str:
    return f"""WITH RECURSIVE {_strong(SQL_TOURS, least)}, {_CONSENSUS}, {_BRIDGES}, {_UNREPRESENTED},
cover AS (SELECT seg, CAST(count(*) AS DOUBLE) AS c FROM walk_steps GROUP BY seg),
hap AS (SELECT seg FROM agreed WHERE haploid),
drawn AS (SELECT b.seg AS f, b.side AS fs, least(x.c, y.c) AS want, regexp_extract_all({_sign('b.side')} || b.seg || b.path, '[<>][0-9]+') AS t FROM bridges b JOIN cover x ON x.seg = b.seg JOIN cover y ON y.seg = b.target),
on_bridges AS (SELECT f, fs, want, i - 1 AS idx, CAST(substr(t[i], 2) AS BIGINT) AS seg, t[i][1] = '>' AS fwd FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM drawn)),
inside AS (SELECT o.*, c.c AS has, sum(want) OVER (PARTITION BY o.seg ORDER BY f, fs DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY o.seg ORDER BY f, fs DESC, idx) - 1 AS "copy", count(*) OVER (PARTITION BY o.seg) AS m FROM on_bridges o JOIN cover c USING (seg) WHERE seg NOT IN (SELECT seg FROM hap)),
peeled AS (SELECT *, least(want, CASE WHEN before IS NULL THEN has ELSE greatest(has - before, 1.0) END) AS got FROM inside),
rest AS (SELECT c.seg, greatest(c.c - coalesce(sum(got), 0.0), 1.0) AS c, coalesce(max(m), 0) AS "copy" FROM cover c LEFT JOIN peeled p USING (seg) GROUP BY c.seg, c.c),
through AS (SELECT l.seg AS g, {_flipped('l.path')} || '>' || l.seg || r.path AS line FROM unrepresented l JOIN unrepresented r ON r.seg = l.seg AND r.side = 1 WHERE l.side = 0),
all_passed AS (SELECT g, i - 1 AS idx, CAST(substr(t[i], 2) AS BIGINT) AS seg, t[i][1] = '>' AS fwd FROM (SELECT g, regexp_extract_all(line, '[<>][0-9]+') AS t, unnest(range(1, len(regexp_extract_all(line, '[<>][0-9]+')) + 1)) AS i FROM through)),
passed AS (SELECT * FROM all_passed WHERE g IN (SELECT g FROM all_passed JOIN rest USING (seg) GROUP BY g HAVING min(c) >= {least})),
made AS (SELECT seg, CAST(0 AS BIGINT) AS "copy", c FROM hap JOIN cover USING (seg) UNION ALL SELECT seg, "copy", got FROM peeled UNION ALL SELECT seg, "copy", c FROM rest WHERE seg IN (SELECT seg FROM passed) AND seg NOT IN (SELECT seg FROM hap)),
placed AS (SELECT 'b' AS kind, o.f, o.fs, o.idx, o.seg, o.fwd, coalesce(p."copy", 0) AS "copy" FROM on_bridges o LEFT JOIN peeled p ON p.f = o.f AND p.fs = o.fs AND p.idx = o.idx
  UNION ALL SELECT 'p', g, 0, idx, seg, fwd, CASE WHEN seg IN (SELECT seg FROM hap) THEN 0 ELSE "copy" END FROM passed JOIN rest USING (seg)),
paired AS (SELECT seg AS a, "copy" AS ca, CASE WHEN fwd THEN 1 ELSE 0 END AS ea, lead(seg) OVER w AS b, lead("copy") OVER w AS cb, CASE WHEN lead(fwd) OVER w THEN 0 ELSE 1 END AS eb FROM placed WINDOW w AS (PARTITION BY kind, f, fs ORDER BY idx)),
links AS (SELECT a, ca, ea, b, cb, eb FROM paired WHERE b IS NOT NULL UNION SELECT b, cb, eb, a, ca, ea FROM paired WHERE b IS NOT NULL)"""


def untangled_segments(least: int) -> str:
    return f'{_untangled(least)} SELECT seg AS origin, CAST("copy" AS BIGINT) AS "copy", round(c, 6) AS coverage FROM made'


def untangled_links(least: int) -> str:
    return f"{_untangled(least)} SELECT a, CAST(ca AS BIGINT) AS ca, ea, b, CAST(cb AS BIGINT) AS cb, eb FROM links"


DUPLICATED = f"""WITH {SQL_GRAPH}, {_NEAR}, degree AS (SELECT a, ea, count(*) AS d FROM half_edges GROUP BY a, ea),
sides AS (SELECT n.a AS seg, n.ea AS side, count(*) AS n, max(d) AS d, min(b_cov) AS lo, max(b_cov) AS hi, sum(b_cov) AS total, min(b_len) AS shortest, bool_or(n.a = n.b) AS own FROM near n JOIN degree g ON g.a = n.b AND g.ea = n.eb GROUP BY 1, 2),
ok AS (SELECT s.seg, max(side) AS side FROM sides JOIN segments s USING (seg) WHERE n >= 2 AND d = 1 AND lo >= 1 AND NOT own AND hi * 0.1 <= lo AND shortest >= 0.2 * length AND coverage > 0.8 * total AND coverage > hi GROUP BY s.seg)
SELECT ok.seg, CAST(row_number() OVER (PARTITION BY ok.seg ORDER BY n.b, n.eb) - 1 AS INTEGER) AS "copy", n.b AS neighbour, round(coverage * b_cov / total, 6) AS coverage
FROM ok JOIN sides t ON t.seg = ok.seg AND t.side = ok.side JOIN near n ON n.a = ok.seg AND n.ea = ok.side JOIN segments s ON s.seg = ok.seg"""


EXCLUSIVE = f"""WITH {SQL_GRAPH}, {_NEAR}, degree AS (SELECT a, ea, count(*) AS d FROM half_edges GROUP BY a, ea),
sides AS (SELECT n.a AS seg, n.ea AS side, count(*) AS n, max(d) AS d, sum(b_cov) AS total, bool_or(n.a = n.b) AS own FROM near n JOIN degree g ON g.a = n.b AND g.ea = n.eb GROUP BY 1, 2),
ok AS (SELECT s.seg, min(side) AS side FROM sides JOIN segments s USING (seg) WHERE n > 1 AND d = 1 AND NOT own AND (coverage > 0.7 * total OR length < 100) GROUP BY s.seg)
SELECT ok.seg, CAST(row_number() OVER (PARTITION BY ok.seg ORDER BY n.b, n.eb) - 1 AS INTEGER) AS "copy", n.b AS neighbour, round(coverage * b_cov / total, 6) AS coverage
FROM ok JOIN sides t ON t.seg = ok.seg AND t.side = ok.side JOIN near n ON n.a = ok.seg AND n.ea = ok.side JOIN segments s ON s.seg = ok.seg"""


def extension(overlap: int, size: int) -> str:
    return f"""WITH {SQL_STEPS}, {SQL_EDGES}, {SQL_SEQUENCES}, {_EXPANDED},
n AS (SELECT a, ea, substr(CASE WHEN eb = 0 THEN y.seq ELSE {sql_rc('y.seq')} END, {overlap + 1}, {size}) AS t, row_number() OVER (PARTITION BY a, ea ORDER BY b DESC, eb DESC) AS n
  FROM half_edges JOIN expanded x ON x.seg = a JOIN expanded y ON y.seg = b)
SELECT a AS seg, ea AS side, t AS extension FROM n WHERE n = 1"""


CONTAINMENT = f"""WITH {SQL_READS}, {_CONTIGS}
SELECT seg, (SELECT count(*) FROM reads r WHERE contains(r.seq, c.seq) OR contains(r.seq, {sql_rc('c.seq')})) AS n_in FROM contigs c"""
