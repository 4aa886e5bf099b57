"""SQL of the graph queries for DuckDB alone: paths are walked step by step, where the Spark operators double pointers.

Written apart from the operators, from what a segment, a tip, a bubble and a link are, to hold them against.
"""

from __future__ import annotations

from strandloom.plans.dialect import duckdb_sql
from strandloom.plans.views import K, ORD, canon, rc, with_views

#: Valley and peak of the derived reads' histogram; shares and lengths of the rules for tips, bubbles and variants.
VALLEY, PEAK, ERROR_FREQ, ERROR_SHARE, VARIANT = 3, 13, 2, 5, 7


def graph(g: str, edges: str) -> str:
    """Tables of a graph over canonical edges (kp1, freq): oriented edges, nodes, single steps, walks and whole segments."""
    return f"""
{g}_both AS (SELECT DISTINCT kp1, freq FROM (SELECT kp1, freq FROM {edges} UNION ALL SELECT {rc('kp1')}, freq FROM {edges}) x),
{g}_nodes AS (SELECT kmer, n_in, n_out, CAST(CASE WHEN raw > 4 THEN (raw + 1) // 4 ELSE 1 END AS BIGINT) AS f, n_in = 1 AND n_out = 1 AS plain
    FROM (SELECT kmer, CAST(sum(i) AS INT) AS n_in, CAST(sum(o) AS INT) AS n_out, least(2 * sum(w), 255) AS raw
        FROM (SELECT substr(kp1, 1, {K}) AS kmer, 0 AS i, 1 AS o, CASE WHEN kp1 = {rc('kp1')} THEN 2 * freq ELSE freq END AS w FROM {g}_both
              UNION ALL SELECT substr(kp1, 2), 1, 0, CASE WHEN kp1 = {rc('kp1')} THEN 2 * freq ELSE freq END FROM {g}_both) e GROUP BY kmer) n),
{g}_steps AS MATERIALIZED (SELECT e.kp1, e.freq, a.kmer AS a, a.plain AS from_plain, b.kmer AS b, b.plain AS to_plain, b.f, substr(e.kp1, {K + 1}) AS c
    FROM {g}_both e JOIN {g}_nodes a ON substr(e.kp1, 1, {K}) = a.kmer JOIN {g}_nodes b ON substr(e.kp1, 2) = b.kmer),
{g}_walks AS (SELECT a AS first, b AS last, kp1 AS seq, 1 AS n, f AS total, freq AS weight, CAST(f AS VARCHAR) AS freqs, to_plain AS go FROM {g}_steps WHERE NOT from_plain
    UNION ALL SELECT w.first, s.b, w.seq || s.c, w.n + 1, w.total + s.f, w.weight + s.freq, w.freqs || ' ' || CAST(s.f AS VARCHAR), s.to_plain FROM {g}_walks w JOIN {g}_steps s ON w.last = s.a WHERE w.go),
{g}_segments AS MATERIALIZED (SELECT w.first, w.last, w.seq, CAST(w.n AS BIGINT) AS n, w.total // w.n AS mean_freq, w.weight, a.f AS first_f, a.n_in AS first_in, a.n_out AS first_out, b.n_out AS last_out, CAST(a.f AS VARCHAR) || ' ' || w.freqs AS freqs,
    {ORD.format('w.seq')} <= {ORD.format(rc('w.seq'))} AS forward, CASE WHEN {ORD.format('w.seq')} <= {ORD.format(rc('w.seq'))} THEN w.seq ELSE {rc('w.seq')} END AS strand_seq
    FROM {g}_walks w JOIN {g}_nodes a ON w.first = a.kmer JOIN {g}_nodes b ON w.last = b.kmer WHERE NOT w.go)"""


def tips(g: str) -> str:
    return f"SELECT * FROM {g}_segments WHERE (first_in > 1 OR first_out > 1) AND (mean_freq <= {ERROR_FREQ} AND n < {2 * K} OR n <= {K} AND last_out = 0)"


def bubbles(g: str) -> str:
    roots = f"SELECT * FROM {g}_segments WHERE first_f > {VALLEY} AND first_f < {2 * PEAK} AND first_out > 1"
    return f"""SELECT w.*, s.best FROM ({roots}) w JOIN (SELECT first, last, max(mean_freq) AS best FROM ({roots}) r WHERE mean_freq > {VALLEY} GROUP BY first, last) s
        ON w.first = s.first AND w.last = s.last WHERE w.mean_freq <= {ERROR_FREQ} AND w.mean_freq * {ERROR_SHARE} <= s.best"""


def without(edges: str, bad: str) -> str:
    """Edges but those on some segments, either strand."""
    inside = f"SELECT substr(seq, CAST(p AS INT), {K + 1}) AS kp1 FROM (SELECT seq, RANGE(1; length(seq) - {K}) AS p FROM ({bad}) b) q"
    return f"SELECT kp1, freq FROM {edges} WHERE kp1 NOT IN (SELECT {canon('kp1')} FROM ({inside}) i)"


ALL = "all_edges AS MATERIALIZED (SELECT kp1, CAST(least(n, 255) AS INT) AS freq FROM counts)"
WHOLE = f"{ALL}, {graph('w', 'all_edges')}"
SIMPLE = f"{WHOLE}, clipped AS MATERIALIZED ({without('all_edges', tips('w'))}), {graph('c', 'clipped')}, popped AS MATERIALIZED ({without('clipped', bubbles('c'))}), {graph('s', 'popped')}"
#: A join for each side, as a condition over both would compare all pairs.
LINKS = """named AS (SELECT sha1(strand_seq) AS id, CASE WHEN forward THEN '+' ELSE '-' END AS strand, first, last FROM w_segments),
links_of AS (SELECT DISTINCT a.id AS src, 'r' AS side, b.id AS dst, b.strand FROM named a JOIN named b ON a.last = b.first WHERE a.strand = '+'
    UNION SELECT a.id, 'l', b.id, b.strand FROM named a JOIN named b ON a.first = b.last WHERE a.strand = '+')"""
ALTS = f"""alts AS (SELECT first, last, list_sort(list(DISTINCT substr(seq, {K + 1}, length(seq) - {2 * K}))) AS alts FROM w_segments
    WHERE length(seq) > {2 * K} AND length(seq) <= {2 * K + VARIANT} GROUP BY first, last),
texts AS (SELECT first, last, alts, concat(first, '{{', array_to_string(alts, ','), '}}', last) AS text FROM alts
    WHERE len(alts) > 1 AND {ORD.format("concat(first, last)")} <= {ORD.format(rc("concat(first, last)"))})"""
UNITIGS = f"solid_edges AS MATERIALIZED (SELECT kp1, freq FROM solid), {graph('u', 'solid_edges')}"
BOTH_READS = f"SELECT seq AS x FROM reads UNION ALL SELECT {rc('seq')} FROM reads"

ONE_STRAND = f"{ORD.format('kmer')} <= {ORD.format(rc('kmer'))}"

TEXTS = {
    "unitig_seeds": (WHOLE, f"SELECT kmer, CAST(f AS INT) AS freq FROM w_nodes WHERE plain AND abs(f - {PEAK}) < 0.3 * {PEAK} AND {ONE_STRAND}"),
    "simplify_roots": (WHOLE, f"SELECT kmer, CAST(f AS INT) AS freq FROM w_nodes WHERE f > {VALLEY} AND f < {2 * PEAK} AND greatest(n_in, n_out) > 1 AND {ONE_STRAND}"),
    "segment_stats": (UNITIGS, "SELECT sha1(seq) AS id, n + 1 AS n_kmers, CAST(weight // n AS BIGINT) AS mean_freq FROM u_segments WHERE forward"),
    "map_seed": (UNITIGS, f"SELECT id, CAST(p AS INT) AS p, read_id AS rid FROM (SELECT sha1(seq) AS id, seq, RANGE(1; length(seq) - {K - 1}) AS p FROM u_segments WHERE forward AND length(seq) >= {K + 5}) v JOIN reads ON substr(v.seq, CAST(p AS INT), {K}) = substr(reads.seq, 1, {K})"),
    "segments": (WHOLE, "SELECT seq, n, mean_freq, CASE WHEN last_out = 0 THEN 4 ELSE 3 END AS end_state FROM w_segments"),
    "tips": (WHOLE, f"SELECT seq, n, mean_freq FROM ({tips('w')}) t"),
    "bubbles": (WHOLE, f"SELECT seq, n, mean_freq, best FROM ({bubbles('w')}) b"),
    "unitigs": (SIMPLE, "SELECT sha1(seq) AS id, seq, CAST(length(seq) AS INT) AS len FROM s_segments WHERE forward"),
    "dbg_links": (f"{WHOLE}, {LINKS}", "SELECT src, side, dst, strand FROM links_of"),
    "dbg_edge_text": (f"{WHOLE}, {LINKS}", """SELECT concat_ws(chr(9), src, coalesce(string_agg(DISTINCT dst || ':', '' ORDER BY dst || ':') FILTER (side = 'l'), ''),
        coalesce(string_agg(DISTINCT dst || ':', '' ORDER BY dst || ':') FILTER (side = 'r'), '')) AS line FROM links_of GROUP BY src"""),
    "dbg_vertex_text": (SIMPLE, "SELECT concat('>', sha1(seq), chr(9), length(seq), chr(9), first_in, chr(9), last_out, chr(10), seq, chr(10), '+', chr(10), freqs) AS record FROM s_segments WHERE forward"),
    "self_cycles": (f"{WHOLE}, {LINKS}", f"""SELECT v.id, v.seq, v.support FROM (SELECT sha1(s.seq) AS id, s.seq, (SELECT count(*) FROM (SELECT x, RANGE(2; length(x) - length(s.seq)) AS p FROM ({BOTH_READS}) r) q WHERE substr(x, CAST(p AS INT), length(s.seq)) = s.seq) AS support
        FROM w_segments s WHERE s.forward AND s.first_in = 2 AND s.last_out = 2 AND sha1(s.seq) IN (SELECT src FROM links_of WHERE src = dst AND side = 'r' AND strand = '+')) v WHERE v.support >= 2"""),
    "bubble_merge": (f"{WHOLE}, {ALTS}", "SELECT text, CAST(len(alts) AS INT) AS n_alts FROM texts"),
    "variant_expand": (f"{WHOLE}, {ALTS}", "SELECT text, concat(first, alt, last) AS seq FROM (SELECT text, first, last, unnest(alts) AS alt FROM texts) t"),
    "unitig_quality": (f"{WHOLE}, {ALTS}", f"SELECT text, concat(repeat('3', {K}), repeat('2', length(alts[1])), repeat('3', {K})) AS quality FROM texts"),
    "dbg_vertices": (UNITIGS, "SELECT seq, n + 1 AS n_kmers, CAST(weight // n AS BIGINT) AS mean_freq FROM u_segments WHERE forward"),
    "unitig_fasta": (UNITIGS, "SELECT concat('>', sha1(seq), chr(9), length(seq), chr(10), seq) AS record FROM u_segments WHERE forward"),
    "unitig_groups": ("ways AS (SELECT u1 AS a, u2 AS b FROM links UNION SELECT u2, u1 FROM links), reach AS (SELECT a AS unitig, a AS g FROM ways UNION SELECT r.unitig, w.b FROM reach r JOIN ways w ON r.g = w.a)", "SELECT unitig, min(g) AS group_id FROM reach GROUP BY unitig"),
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (tables, query) in TEXTS.items():
        text = with_views(f"{tables} {query}")  # the views that any of these tables read
        head, _, _ = text.rpartition(f" {tables} {query}")
        out[name] = duckdb_sql(f"WITH RECURSIVE {head.removeprefix('WITH ')}, {tables} {query}")
    return out
