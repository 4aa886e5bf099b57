"""Derived tables that the queries start from, in SQL that both engines read (plans.dialect).

The test tables hold no DNA. Letters of whole benchmark texts become bases; reads are 100-base windows at pseudo-random
places, 20 for each base, some with a substitution, half of them reverse-complemented.
"""

from __future__ import annotations

K = 33
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "CATGCATGCATGCATGCATGCATGCA"
RC = "translate(reverse({0}), 'ACGT', 'TGCA')"
ORD = "translate({0}, 'CATG', '0123')"


def rc(x: str) -> str:
    return RC.format(x)


def canon(x: str) -> str:
    return f"CASE WHEN {ORD.format(x)} <= {ORD.format(rc(x))} THEN {x} ELSE {rc(x)} END"


def bit(base: str) -> str:
    return f"CASE {base} WHEN 'C' THEN 1 WHEN 'A' THEN 2 WHEN 'T' THEN 4 ELSE 8 END"


VIEWS = {
    "genomes": f"""SELECT min(item_id) AS doc_id, g FROM (SELECT item_id, translate(upper(LETTERS(text, '[^A-Za-z]', '';ALL)), '{UPPER}', '{BASES}') AS g FROM benchmark) q
        WHERE length(g) >= 100 GROUP BY g""",
    "places": "SELECT doc_id, g, RANGE(0; floor(length(g) * 20 / 100) - 1) AS i FROM genomes",
    "cuts": "SELECT doc_id, i, substr(g, CAST((i * i * 31 + i * 7919 + doc_id * 104729) % (length(g) - 99) AS INT) + 1, 100) AS x, CAST((i * 13 + doc_id) % 100 AS INT) AS p FROM places",
    "errors": "SELECT doc_id, i, CASE WHEN i % 20 = 0 THEN concat(substr(x, 1, p), translate(substr(x, p + 1, 1), 'ACGT', 'CGTA'), substr(x, p + 2)) ELSE x END AS y FROM cuts",
    "reads": f"""SELECT doc_id * 100000 + i AS read_id, CAST(doc_id % 3 AS INT) AS lib_id, doc_id, i, CASE WHEN i % 2 = 1 THEN {rc('y')} ELSE y END AS seq,
        CASE WHEN i % 17 = 0 THEN concat(substr(y, 1, CAST((i * 7) % 100 AS INT)), 'N', substr(y, CAST((i * 7) % 100 AS INT) + 2)) ELSE y END AS seq_n,
        CASE WHEN i % 13 = 0 THEN repeat('>', 100) WHEN i % 11 = 0 THEN concat(repeat('I', CAST(i % 100 AS INT)), '#', repeat('I', CAST(99 - i % 100 AS INT))) ELSE repeat('I', 100) END AS qual FROM errors""",
    "spots": f"SELECT read_id, lib_id, seq, RANGE(1; length(seq) - {K}) AS p FROM reads",
    "windows": f"SELECT read_id, lib_id, CAST(p AS INT) AS p, substr(seq, CAST(p AS INT), {K + 1}) AS kp1 FROM spots",
    "counts": f"SELECT kp1, count(*) AS n FROM (SELECT {canon('kp1')} AS kp1 FROM windows) q GROUP BY kp1",
    "solid": "SELECT kp1, CAST(least(n, 255) AS INT) AS freq FROM counts WHERE n >= 2",
    # each edge in both orientations, each with the node at its start and the one at its end
    "ends": f"""SELECT substr(x, 1 + tail, {K}) AS kmer, freq, CASE WHEN tail = 1 THEN {bit('substr(x, 1, 1)')} ELSE 0 END AS llink, CASE WHEN tail = 0 THEN {bit(f'substr(x, {K + 1}, 1)')} ELSE 0 END AS rlink FROM
        (SELECT CASE WHEN turned = 1 THEN {rc('kp1')} ELSE kp1 END AS x, freq, tail FROM solid CROSS JOIN (SELECT 0 AS turned, 0 AS tail UNION ALL SELECT 0, 1 UNION ALL SELECT 1, 0 UNION ALL SELECT 1, 1) t) o""",
    "raw_nodes": f"""SELECT kmer, CAST(least(2 * sum(freq), 255) AS INT) AS raw, CAST(bit_or(llink) AS INT) AS llink, CAST(bit_or(rlink) AS INT) AS rlink FROM ends
        WHERE {ORD.format('kmer')} <= {ORD.format(rc('kmer'))} GROUP BY kmer""",
    "nodes": "SELECT kmer, CAST(CASE WHEN raw > 4 THEN floor((raw + 1) / 4) ELSE 1 END AS INT) AS freq, llink, rlink FROM raw_nodes",
    "hist": "SELECT CAST(f AS INT) AS freq, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT RANGE(1; 255) AS f) r LEFT JOIN (SELECT least(n, 255) AS c, count(*) AS n FROM counts GROUP BY 1) h ON f = c",
    # mappings of mate pairs to unitigs, from lineitem (there are no real ones)
    "mates": """SELECT l_orderkey AS pair_id, l_partkey % 40 AS unitig, CAST(l_quantity AS INT) AS pos, CAST(l_suppkey % 3 AS INT) AS lib_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS mate FROM lineitem""",
    "pairs": "SELECT a.pair_id, a.lib_id, a.unitig AS u1, b.unitig AS u2, a.pos AS p1, b.pos AS p2 FROM mates a JOIN mates b ON a.pair_id = b.pair_id WHERE a.mate = 1 AND b.mate = 2",
    "links": "SELECT least(u1, u2) AS u1, greatest(u1, u2) AS u2, count(*) AS n FROM pairs WHERE u1 <> u2 GROUP BY 1, 2",
    "gaps": "SELECT least(u1, u2) AS u1, greatest(u1, u2) AS u2, CAST(CASE WHEN lib_id = 0 THEN 300 ELSE 500 END - (100 - p1) - p2 AS DOUBLE) AS gap, CAST(CASE WHEN lib_id = 0 THEN 30 ELSE 50 END AS DOUBLE) AS sd FROM pairs WHERE u1 <> u2 AND lib_id < 2",
    "segs": "SELECT read_id AS rid, seq FROM reads",
    "suffixes": "SELECT rid, CAST(p AS INT) AS off, substr(seq || '$', CAST(p AS INT) + 1) AS suffix, CASE WHEN p = 0 THEN '$' ELSE substr(seq, CAST(p AS INT), 1) END AS bwt FROM (SELECT rid, seq, RANGE(0; length(seq)) AS p FROM segs) q",
    "sa": "SELECT CAST(row_number() OVER (ORDER BY translate(suffix, '$CATG', '01234'), rid) AS BIGINT) AS isa, rid, off, bwt, substr(suffix, 1, 34) AS prefix FROM suffixes",
}
#: Tables that views read.
TABLES = ("benchmark", "lineitem", "documents")


def needs(text: str) -> list[str]:
    """Views that a query reads, in an order in which each comes after those it reads itself."""
    import re

    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            out += [x for x in needs(VIEWS[name]) if x not in out] + [name] * (name not in out)
    return out


def with_views(text: str) -> str:
    """The query with all views it needs before it."""
    names = needs(text)
    return (f"WITH {', '.join(f'{n} AS ({VIEWS[n]})' for n in names)} {text}" if names else text)
