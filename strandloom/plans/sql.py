"""Queries that SQL expresses; each text runs in Spark and, as its oracle, in DuckDB (plans.dialect, plans.views)."""

from __future__ import annotations

from strandloom.plans.views import K, ORD, bit, canon, rc

#: The letters' bases as digits A C G T = 0 to 3, where a base and its complement add up to 3.
DIGITS = "10321032103210321032103210"
N_FREE = """SELECT read_id, lib_id, i, region, start, qual, CAST(length(region) AS INT) AS len FROM (
    SELECT read_id, lib_id, i, qual, CASE WHEN npos = 0 OR npos > 50 THEN substr(seq_n, 1, CASE WHEN npos = 0 THEN 100 ELSE npos - 1 END) ELSE substr(seq_n, npos + 1) END AS region,
    CAST(CASE WHEN npos = 0 OR npos > 50 THEN 0 ELSE npos END AS INT) AS start FROM (SELECT read_id, lib_id, i, qual, seq_n, CAST(position('N' IN seq_n) AS INT) AS npos FROM reads) a) b"""
QUAL = "SELECT read_id, lib_id, i, RANGE(1; length(qual)) AS p, qual FROM reads"
SCORES = f"SELECT read_id, lib_id, i, ascii(substr(qual, CAST(p AS INT), 1)) - 33 AS q FROM ({QUAL}) s"
PER_READ = f"SELECT read_id, lib_id, i, CAST(sum(q) AS BIGINT) AS total, count(*) AS n, CAST(sum(CASE WHEN q <= 10 THEN 1 ELSE 0 END) AS BIGINT) AS low FROM ({SCORES}) r GROUP BY read_id, lib_id, i"


def paired(low: int, mean: int) -> str:
    """Pairs (reads 2j and 2j + 1 of a paired library) whose pooled quality passes."""
    return f"SELECT a.read_id AS r1, b.read_id AS r2, a.total + b.total AS total FROM ({PER_READ}) a JOIN ({PER_READ}) b ON b.read_id = a.read_id + 1 WHERE a.i % 2 = 0 AND a.lib_id < 2 AND a.low + b.low <= {low} AND a.total + b.total >= {mean} * (a.n + b.n)"


FIRST = f"SELECT read_id AS rid, substr(seq, 1, {K}) AS seed, seq FROM reads"
BOTH = f"SELECT read_id AS qid, '+' AS strand, seq AS oriented FROM reads UNION ALL SELECT read_id AS qid, '-' AS strand, {rc('seq')} AS oriented FROM reads"
SEEDS = f"SELECT qid, strand, oriented, CAST(p AS INT) AS p, substr(oriented, CAST(p AS INT) + 1, {K}) AS seed FROM (SELECT qid, strand, oriented, RANGE(1; length(oriented) - {K}) AS p FROM ({BOTH}) b) s"
#: A seed that more reads start with than twice the reads' peak is a repeat and makes no pairs.
MOST = 26
CAPPED = f"SELECT f.rid, f.seed, f.seq FROM ({FIRST}) f JOIN (SELECT seed FROM ({FIRST}) r GROUP BY seed HAVING count(*) <= {MOST}) s ON f.seed = s.seed"
OVERLAPS = f"SELECT qid, rid, strand, 100 - p AS consis_len FROM ({SEEDS}) q JOIN ({CAPPED}) f ON q.seed = f.seed WHERE qid <> rid AND substr(oriented, p + 1) = substr(f.seq, 1, 100 - p)"
CURVE = """SELECT freq, n, lag(n, 1) OVER w AS a1, lag(n, 2) OVER w AS a2, lag(n, 3) OVER w AS a3, lead(n, 1) OVER w AS b1, lead(n, 2) OVER w AS b2 FROM hist WINDOW w AS (ORDER BY freq)"""
PEAKS = f"""SELECT freq AS peak, row_number() OVER (ORDER BY freq) AS k FROM ({CURVE}) c
    WHERE a3 < a2 AND a2 < a1 AND a1 < n AND n > b1 AND b1 > b2 AND freq > (SELECT min(freq) FROM ({CURVE}) v WHERE a1 > n AND n < b1)"""
DEGREE = "bit_count({0})"
SIDES = " UNION ALL ".join(f"SELECT '{b}' AS base, {v} AS bit, '{side}' AS side" for b, v in (("C", 1), ("A", 2), ("T", 4), ("G", 8)) for side in "lr")
TARGETS = f"SELECT kmer, base, side, CASE WHEN side = 'r' THEN concat(substr(kmer, 2), base) ELSE concat(base, substr(kmer, 1, {K - 1})) END AS next FROM nodes CROSS JOIN ({SIDES}) x WHERE ((CASE WHEN side = 'r' THEN rlink ELSE llink END) & bit) <> 0"

SQL: dict[str, str] = {
    # scans, metadata
    "scan_reads": "SELECT read_id, lib_id, doc_id, i, seq, seq_n, qual FROM reads",
    "lib_offsets": "SELECT lib_id, n_reads, CAST(sum(bases) OVER (ORDER BY lib_id) - bases AS BIGINT) AS start FROM (SELECT lib_id, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY lib_id) l",
    "ann_summary": "SELECT lib_id, CAST(max(length(seq)) AS INT) AS max_len, CAST(min(length(seq)) AS INT) AS min_len, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM reads GROUP BY lib_id",
    "len_major": "SELECT lib_id, CAST(k AS BIGINT) AS k, CAST(before AS BIGINT) AS before FROM (SELECT lib_id, row_number() OVER (PARTITION BY lib_id ORDER BY read_id) - 1 AS k, sum(length(seq)) OVER (PARTITION BY lib_id ORDER BY read_id ROWS UNBOUNDED PRECEDING) - length(seq) AS before FROM reads) r WHERE k % 512 = 0",
    "pac_roundtrip": f"SELECT read_id, translate({ORD.format('seq')}, '0123', 'CATG') AS seq FROM reads",
    "map_text_roundtrip": "SELECT CAST(split_part(line, chr(9), 1) AS BIGINT) AS read_id, split_part(line, chr(9), 2) AS strand, CAST(split_part(line, chr(9), 3) AS INT) AS len FROM (SELECT concat(CAST(read_id AS VARCHAR(30)), chr(9), CASE WHEN i % 2 = 1 THEN '-' ELSE '+' END, chr(9), CAST(length(seq) AS VARCHAR(30))) AS line FROM reads) t",
    # projections
    "base_encode": f"SELECT read_id, {ORD.format('seq')} AS digits FROM reads",
    "base_decode": f"SELECT read_id, translate(digits, '0123', 'CATG') AS seq FROM (SELECT read_id, {ORD.format('seq')} AS digits FROM reads) d",
    "revcomp": f"SELECT read_id, {rc('seq')} AS rc FROM reads",
    "complement": "SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS comp FROM reads",
    "reverse_seq": "SELECT read_id, reverse(seq) AS rev FROM reads",
    "kmer_neighbors": "SELECT kmer, b AS base, concat(substr(kmer, 2), b) AS next, concat(b, substr(kmer, 1, 32)) AS prev FROM nodes CROSS JOIN (SELECT 'A' AS b UNION ALL SELECT 'C' UNION ALL SELECT 'G' UNION ALL SELECT 'T') x",
    "edge_to_nodes": f"SELECT kp1, substr(kp1, 1, {K}) AS prefix, {bit(f'substr(kp1, {K + 1}, 1)')} AS rlink, substr(kp1, 2) AS suffix, {bit('substr(kp1, 1, 1)')} AS llink FROM solid",
    "canonical_kmer": f"SELECT read_id, p, {canon('kp1')} AS canon FROM windows",
    "kmer_windows": "SELECT read_id, p, kp1 FROM windows",
    "qual_quantise": f"SELECT read_id, CAST(least(3, greatest(0, floor(q / 16))) AS INT) AS q2, count(*) AS n FROM ({SCORES}) s GROUP BY 1, 2",
    "n_free_region": f"SELECT read_id, start, len, region FROM ({N_FREE}) r",
    "node_degree": f"SELECT kmer, CAST({DEGREE.format('llink')} AS INT) AS indegree, CAST({DEGREE.format('rlink')} AS INT) AS outdegree FROM nodes",
    "color_space": "SELECT read_id, p, substr('0123103223013210', CAST(4 * (position(substr(kp1, 1, 1) IN 'ACGT') - 1) + position(substr(kp1, 2, 1) IN 'ACGT') AS INT), 1) AS color FROM windows",
    "cigar_len": "SELECT l_orderkey, l_linenumber, CAST(CAST(LETTERS(cigar, 'M[0-9]+I$', '';ALL) AS INT) + CAST(LETTERS(LETTERS(cigar, '^[0-9]+M', '';ALL), 'I$', '';ALL) AS INT) AS INT) AS len FROM (SELECT l_orderkey, l_linenumber, concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)), 'M', CAST(l_linenumber AS VARCHAR(9)), 'I') AS cigar FROM lineitem) c",
    # filters
    "filter_len": f"SELECT read_id, len FROM ({N_FREE}) r WHERE len >= {K + 10}",
    "trim_fixed": f"SELECT read_id, substr(region, 1, 90) AS seq FROM ({N_FREE}) r WHERE len >= 90",
    "filter_qual_pe_q1": paired(5, 25),
    "filter_qual_pe_q2": paired(2, 30),
    "filter_qual_pe_q3": paired(0, 35),
    "filter_qual_se": f"SELECT read_id, total FROM ({PER_READ}) r WHERE lib_id = 2 AND low = 0 AND total >= 35 * n",
    "solid_kmers": "SELECT kp1, freq FROM solid",
    "relink": f"SELECT kmer, base, side FROM ({TARGETS}) t WHERE NOT EXISTS (SELECT 1 FROM nodes d WHERE d.freq <= 1 AND d.kmer = {canon('t.next')})",
    # joins
    "node_lookup": f"SELECT w.read_id, w.p, n.freq FROM (SELECT read_id, p, {canon(f'substr(kp1, 1, {K})')} AS kmer FROM windows) w JOIN nodes n ON w.kmer = n.kmer",
    "locate_read": """SELECT q.pos, r.read_id, q.pos - r.start AS off FROM (SELECT k * 997 % (SELECT 100 * count(*) FROM reads) AS pos FROM (SELECT row_number() OVER (ORDER BY read_id) - 1 AS k FROM reads) x) q
        JOIN (SELECT read_id, CAST(100 * (row_number() OVER (ORDER BY read_id) - 1) AS BIGINT) AS start FROM reads) r ON q.pos >= r.start AND q.pos < r.start + 100""",
    "locate_segment": "SELECT read_id, p, CAST(CASE WHEN p <= 17 THEN 0 WHEN p <= 34 THEN 1 WHEN p <= 51 THEN 2 ELSE 3 END AS INT) AS serial FROM windows",
    "seed_lookup": f"SELECT w.read_id, w.p, f.rid FROM (SELECT read_id, p, substr(kp1, 1, {K}) AS seed FROM windows) w JOIN ({FIRST}) f ON w.seed = f.seed",
    "mate_join": "SELECT pair_id, lib_id, u1, u2, p1, p2 FROM pairs",
    "seen_antijoin": f"SELECT read_id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM (SELECT qid, rid FROM ({OVERLAPS}) o) s WHERE s.rid = r.read_id AND s.qid < r.read_id)",
    # aggregations
    "kmer_count": "SELECT kp1, CAST(least(n, 255) AS INT) AS freq FROM counts",
    "kmer_hist": "SELECT freq, n FROM hist",
    "node_build": "SELECT kmer, freq, llink, rlink FROM nodes",
    "read_len_extrema": f"SELECT CAST(min(len) AS INT) AS min_len, CAST(max(len) AS INT) AS max_len FROM ({N_FREE}) r",
    "pair_links": "SELECT u1, u2, n FROM links",
    "insert_size": "SELECT lib_id, count(*) AS n, round(avg(abs(p1 - p2) + 100), 6) AS mean_insert, round(stddev_samp(abs(p1 - p2) + 100), 6) AS sd_insert FROM pairs WHERE u1 = u2 GROUP BY lib_id",
    "gap_estimate": "SELECT g.u1, g.u2, round(e.gap, 6) AS gap, round(e.sd, 6) AS sd, round(sqrt(sum((g.gap - e.gap) / g.sd * ((g.gap - e.gap) / g.sd)) / count(*)), 6) AS score FROM gaps g JOIN (SELECT u1, u2, sum(gap / (sd * sd)) / sum(1 / (sd * sd)) AS gap, sqrt(1 / sum(1 / (sd * sd))) AS sd FROM gaps GROUP BY u1, u2) e ON g.u1 = e.u1 AND g.u2 = e.u2 GROUP BY g.u1, g.u2, e.gap, e.sd",
    "gap_obs": "SELECT u1, u2, gap, sd FROM gaps",
    "base_cumfreq": f"SELECT base, n, CAST(sum(n) OVER (ORDER BY {ORD.format('base')}) - n AS BIGINT) AS before FROM (SELECT substr(seq, CAST(p AS INT), 1) AS base, count(*) AS n FROM (SELECT seq, RANGE(1; length(seq)) AS p FROM reads) s GROUP BY 1) b",
    "read_tally": f"SELECT lib_id, CAST(sum(CASE WHEN len >= {K + 10} THEN 1 ELSE 0 END) AS BIGINT) AS processed, CAST(sum(CASE WHEN len >= {K + 10} THEN 0 ELSE 1 END) AS BIGINT) AS unprocessed FROM ({N_FREE}) r GROUP BY lib_id",
    "best_hit": f"SELECT qid, rid, consis_len FROM (SELECT qid, rid, consis_len, row_number() OVER (PARTITION BY qid ORDER BY consis_len DESC, rid, strand) AS k FROM ({OVERLAPS}) o) b WHERE k = 1",
    "overlap_count": f"SELECT qid, count(*) AS mapped FROM ({OVERLAPS}) o GROUP BY qid",
    "min_insert": "SELECT CAST(min(CASE WHEN lib_id = 0 THEN 300 ELSE 500 END) AS INT) AS min_insert FROM reads WHERE lib_id < 2",
    # ranking and index parity (Spark runs operators.index instead of these texts)
    "suffix_array": "SELECT isa, rid, off FROM sa",
    "bwt_column": "SELECT isa, bwt FROM sa",
    "fm_occ": "SELECT isa, bwt, CAST(count(*) OVER (PARTITION BY bwt ORDER BY isa ROWS UNBOUNDED PRECEDING) AS BIGINT) AS occ FROM sa",
    "lf_map": "SELECT s.isa, s.occ + coalesce(c.before, 0) AS lf FROM (SELECT isa, bwt, CAST(count(*) OVER (PARTITION BY bwt ORDER BY isa ROWS UNBOUNDED PRECEDING) AS BIGINT) AS occ FROM sa) s JOIN (SELECT bwt, CAST(sum(n) OVER (ORDER BY translate(bwt, '$CATG', '01234')) - n AS BIGINT) AS before FROM (SELECT bwt, count(*) AS n FROM sa GROUP BY bwt) b) c ON s.bwt = c.bwt",
    "lcp_flag": "SELECT isa, coalesce(prefix = lag(prefix) OVER (ORDER BY isa), false) AS lcp FROM sa",
    "sa_sample": "SELECT isa, rid, off FROM sa WHERE isa % 64 = 0",
    "bwt_merge": "SELECT CAST(row_number() OVER (ORDER BY translate(suffix, '$CATG', '01234'), rid) AS BIGINT) AS isa, bwt FROM (SELECT rid, suffix, bwt FROM suffixes WHERE rid % 2 = 0 UNION ALL SELECT rid, suffix, bwt FROM suffixes WHERE rid % 2 <> 0) m",
    "kmer_curve": f"SELECT (SELECT CAST(min(freq) AS INT) FROM ({CURVE}) v WHERE a1 > n AND n < b1) AS valley, CAST(max(CASE WHEN k = 1 THEN peak END) AS INT) AS peak1, CAST(max(CASE WHEN k = 2 THEN peak END) AS INT) AS peak2 FROM ({PEAKS}) p",
    "map_edge_order": "SELECT unitig, pair_id, mate, CAST(row_number() OVER (PARTITION BY unitig ORDER BY pos, pair_id, mate) AS BIGINT) AS k FROM mates",
    "kmer_sorted": f"SELECT kp1, freq FROM solid ORDER BY {ORD.format('kp1')}",
    "vertex_index": f"SELECT kmer, CAST(row_number() OVER (ORDER BY {ORD.format('kmer')}) AS BIGINT) AS k FROM nodes WHERE {DEGREE.format('llink')} <> 1 OR {DEGREE.format('rlink')} <> 1",
    "top_pair_links": "SELECT u1, u2, n FROM links ORDER BY n DESC, u1, u2 LIMIT 20",
    # set operations
    "union_libs": "SELECT read_id, seq FROM reads WHERE lib_id = 0 UNION ALL SELECT read_id, seq FROM reads WHERE lib_id = 1 UNION ALL SELECT read_id, seq FROM reads WHERE lib_id = 2",
    "both_strands": "SELECT qid AS read_id, strand, oriented AS seq FROM (" + BOTH + ") b",
    # mapping and overlaps
    "overlap_seeds": f"SELECT qid, rid, strand, p FROM ({SEEDS}) q JOIN ({CAPPED}) f ON q.seed = f.seed WHERE qid <> rid",
    "overlaps": f"SELECT qid, rid, strand, consis_len FROM ({OVERLAPS}) o",
    "hamming": f"SELECT doc_id, rid, CAST(p AS INT) AS p, CAST(sum(CASE WHEN substr(part, CAST(k AS INT), 1) <> substr(seq, CAST(k AS INT), 1) THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM (SELECT m.doc_id, m.rid, m.p, m.part, m.seq, RANGE(1; 100) AS k FROM (SELECT g.doc_id, g.p, substr(g.g, CAST(g.p AS INT), 100) AS part, f.rid, f.seq FROM (SELECT doc_id, g, RANGE(1; length(g) - 99) AS p FROM genomes) g JOIN ({FIRST}) f ON substr(g.g, CAST(g.p AS INT), {K}) = f.seed) m) h GROUP BY doc_id, rid, p",
    # all documents as one text of bases
    # (letters become digits in base order and are complemented once a text; a window then costs two substrings and a comparison)
    "doc_kmer_hist": f"""SELECT CAST(c AS INT) AS freq, count(*) AS n FROM (SELECT least(count(*), 255) AS c FROM
        (SELECT least(substr(d, CAST(p AS INT), {K + 1}), substr(r, CAST(length(d) - p AS INT) - {K - 1}, {K + 1})) AS kp1 FROM
            (SELECT d, r, RANGE(1; length(d) - {K}) AS p FROM (SELECT d, translate(reverse(d), '0123', '3210') AS r FROM
                (SELECT translate(upper(LETTERS(text, '[^A-Za-z]', '';ALL)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '{DIGITS}') AS d FROM documents) a) b) c) w GROUP BY kp1) f GROUP BY 1""",
}
