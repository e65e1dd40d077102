"""SQL of the registered queries, for DuckDB: shared common table expressions and one final SELECT each."""

from __future__ import annotations

import math

from ..functions.dna import AS_DNA, LETTERS, UPPER
from ..operators.pssm import Motif
from . import settings as S

SQL: dict[str, str] = {}
PIECE = 512


def dna(text: str) -> str:
    return f"translate(regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LETTERS[:26]}'), '[^a-z0-9]', '', 'g'), '{LETTERS}', '{AS_DNA}')"


SEQS = f"seqs AS MATERIALIZED (SELECT doc_id AS seq, source AS name, {dna('text')} AS s FROM documents)"
BENCH = f"bseqs AS MATERIALIZED (SELECT item_id AS seq, 'benchmark' AS name, {dna('text')} AS s FROM benchmark)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def windows(name: str, width: int, source: str = "seqs", pad: int = 0, known: bool = True) -> str:
    """All windows of a width, by pieces of the sequences."""
    p = "N" * pad
    return (
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT seq, o + i AS pos, substr(piece, i + 1, {width}) AS w FROM (SELECT seq, o, piece, unnest(range(0, least({PIECE}, length(piece) - {width - 1}))) AS i"
        f" FROM (SELECT seq, o, substr(p, o + 1, {PIECE + width - 1}) AS piece FROM (SELECT seq, p, unnest(range(0, length(p) - {width - 1}, {PIECE})) AS o FROM (SELECT seq, '{p}' || s AS p FROM {source})))))"
        + (" WHERE NOT contains(w, 'N'))" if known else ")")
    )


MARKOV = (
    windows("w3", 3, pad=2, known=False)
    + """,
c3 AS (SELECT w, count(*) AS n FROM w3 WHERE NOT ends_with(w, 'N') GROUP BY 1),
mc AS (SELECT k, substr(w, 3 - k, k) AS ctx, substr(w, 3, 1) AS base, sum(n)::BIGINT AS n FROM c3, (VALUES (0), (1), (2)) AS t(k) WHERE NOT contains(substr(w, 3 - k, k + 1), 'N') GROUP BY ALL),
bases(b) AS (VALUES ('A'), ('C'), ('G'), ('T')),
ctxs AS (SELECT 0 AS k, '' AS ctx UNION ALL SELECT 1, b FROM bases UNION ALL SELECT 2, x.b || y.b FROM bases x, bases y),
mk AS MATERIALIZED (SELECT c.k, c.ctx, b AS base, coalesce(n, 0) AS n, ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY c.k, c.ctx) + 4.0)) AS logp
  FROM ctxs c CROSS JOIN bases LEFT JOIN mc ON mc.k = c.k AND mc.ctx = c.ctx AND mc.base = b)"""
)


def isolated(name: str, source: str, width: int) -> str:
    """Distinct words with their own log-likelihood."""
    return (
        f"{name} AS MATERIALIZED (SELECT w, sum(logp) AS ll FROM (SELECT w, i, substr(w, greatest(1, i - 1), least(i, 2) + 1) AS x FROM (SELECT w, unnest(range(0, {width})) AS i FROM (SELECT DISTINCT w FROM {source})))"
        " JOIN (SELECT ctx || base AS x, logp FROM mk) USING (x) GROUP BY w)"
    )


def score(matrix: list[list[float]], word: str = "w") -> str:
    return " + ".join(f"CASE substr({word}, {i + 1}, 1) " + " ".join(f"WHEN '{b}' THEN ({float(x)!r})::DOUBLE" for b, x in zip("ACGT", row, strict=True)) + " END" for i, row in enumerate(matrix))


def posterior(m: Motif, lam: float, back: bool) -> str:
    logp = m.log()
    matrix = (logp[::-1, ::-1] if back else logp).tolist()
    return f"1 / (1 + exp(-(({math.log(lam / (1 - lam))!r}) + {score(matrix)} - ll)))"


def hits(name: str, words: str, motifs: list[Motif]) -> str:
    parts = [f"SELECT '{m.name}' AS motif, w, '{s}' AS strand, {posterior(m, S.LAMBDA, s == '-')} AS z FROM {words}" for m in motifs for s in "+-"]
    return f"{name} AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE z >= {S.THRESHOLD})"


SCANNED = [m.for_scan() for m in S.MOTIFS]
OCC = ",\n".join([
    SEQS, MARKOV, windows("w8", S.WIDTH), isolated("l8", "w8", S.WIDTH), hits("h8", "l8", SCANNED),
    "occ AS MATERIALIZED (SELECT motif, w8.w, seq, pos, strand, z FROM w8 JOIN h8 USING (w))",
    "lens AS (SELECT seq, length(s)::BIGINT AS length FROM seqs)",
])
W6 = SEQS + ",\n" + windows("w6", 6) + ",\nk6 AS MATERIALIZED (SELECT w, count(*) AS n FROM w6 GROUP BY 1)"
FREQ = """comp AS (SELECT b AS base, (SELECT sum(length(s) - length(replace(s, b, '')))::BIGINT FROM seqs) AS n FROM (VALUES ('A'), ('C'), ('G'), ('T')) AS t(b)),
freq AS (SELECT base, n, sum(n) OVER (PARTITION BY base IN ('A', 'T')) / 2.0 / sum(n) OVER () AS freq FROM comp)"""
PROBS = ",\n".join(f"{n} AS (SELECT * FROM (VALUES " + ", ".join(f"('{m.name}', {i}, '{b}', {float(m.probs[i, k])!r})" for m in ms for i in range(m.width) for k, b in enumerate("ACGT")) + ") AS t(motif, col, base, p))" for n, ms in (("raw", S.MOTIFS), ("probs", SCANNED)))
LO = """lo4 AS (SELECT motif, col, base, log2(p) - log2(freq) AS lo, freq FROM probs JOIN freq USING (base)),
lo5 AS (SELECT motif, col, base, lo FROM lo4 UNION ALL SELECT motif, col, 'N', sum(lo * freq) FROM lo4 GROUP BY 1, 2),
whole AS MATERIALIZED (SELECT motif, col, base, lo, floor((lo - min(lo) OVER (PARTITION BY motif)) * (100 / (max(lo) OVER (PARTITION BY motif) - min(lo) OVER (PARTITION BY motif))) + 0.5)::INT AS whole FROM lo5)"""
CDF = (
    "p0 AS (SELECT DISTINCT motif, 0 AS score, 1.0::DOUBLE AS p FROM probs),\n"
    + ",\n".join(f"p{i + 1} AS MATERIALIZED (SELECT p.motif, score + whole AS score, sum(p * freq) AS p FROM p{i} p JOIN whole w ON w.motif = p.motif AND w.col = {i} JOIN freq f ON f.base = w.base GROUP BY 1, 2)" for i in range(S.WIDTH))
    + f",\ncdf AS MATERIALIZED (SELECT motif, score, p AS pdf, least(1, sum(p) OVER (PARTITION BY motif ORDER BY score DESC)) AS tail FROM p{S.WIDTH})"
)
MERGED = """isl AS (SELECT motif, seq, pos, pos + length(w) AS e, CASE WHEN pos < max(pos + length(w)) OVER (PARTITION BY motif, seq ORDER BY pos, pos + length(w) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh,
  row_number() OVER (PARTITION BY motif, seq ORDER BY pos, pos + length(w)) AS r FROM occ),
isn AS (SELECT *, sum(fresh) OVER (PARTITION BY motif, seq ORDER BY r) AS island FROM isl),
merged AS MATERIALIZED (SELECT motif, seq, min(pos) AS "start", max(e) AS "end", count(*) AS n FROM isn GROUP BY motif, seq, island)"""
PAIRS = f"""o AS (SELECT *, pos + length(w) AS e FROM occ),
pairs AS MATERIALIZED (SELECT a.seq, a.motif AS m1, b.motif AS m2, a.strand AS s1, b.strand AS s2, a.pos AS p1, a.e AS e1, b.pos AS p2, b.e AS e2, b.pos - a.e AS d, length(a.w) AS w1, length(b.w) AS w2
  FROM o a JOIN o b ON a.seq = b.seq AND b.pos - a.e BETWEEN 0 AND {S.DISTANCE}),
sp AS MATERIALIZED (SELECT m1 AS "primary", m2 AS secondary, s1 = s2 AS same_strand, s1 = '-' AS upstream, d AS distance, seq, p1 AS "start", e2 AS "end" FROM pairs
  UNION ALL SELECT m2, m1, s1 = s2, s2 = '+', d, seq, p1, e2 FROM pairs WHERE m1 <> m2),
hist AS MATERIALIZED (SELECT "primary", secondary, same_strand, upstream, distance, count(*) AS n FROM sp GROUP BY ALL)"""


def add(name: str, prelude: str, select: str) -> None:
    SQL[name] = f"WITH {prelude}\n{select}"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


add("dna_sequences", SEQS, "SELECT seq, name, length(s)::BIGINT AS length, coalesce(sum(length(s)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gstart, md5(s) AS digest FROM seqs")
add("base_composition", SEQS, "SELECT b AS base, (SELECT sum(length(s) - length(replace(s, b, '')))::BIGINT FROM seqs) AS n FROM (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) AS t(b)")
add("zero_order_freqs", f"{SEQS},\n{FREQ}", f"SELECT base, n, {r('freq', 9)} AS symmetric, {r('(n + 1) / (sum(n) OVER () + 4.0)', 9)} AS plain FROM freq")
add("kmer_counts_w6", W6, "SELECT w, n FROM k6")
add("canonical_kmers", W6, f"SELECT least(w, {RC.format('w')}) AS w, sum(n)::BIGINT AS n FROM k6 GROUP BY 1")
_ORD = " + ".join(f"(strpos('ACGT', substr(w, {i + 1}, 1)) - 1) * {4**i}" for i in range(6))
add("kmer_ordinal", W6, f"SELECT w, ({_ORD})::BIGINT AS ordinal, {RC.format('w')} AS rc, (strpos('ACGT', substr(w, 1, 1)) - 1)::INT AS first FROM k6")
add("prefix_counts", W6, "SELECT depth, substr(w, 1, depth) AS prefix, sum(n)::BIGINT AS n, count(*) AS leaves FROM k6, (VALUES (1), (2), (3), (4), (5)) AS t(depth) GROUP BY 1, 2")
add("nfree_window_counts", SEQS, "SELECT width, sum(greatest(0, length(run) - width + 1))::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(s, '[ACGT]+')) AS run FROM seqs), (SELECT unnest(range(1, 13))::INT AS width) GROUP BY 1")
add("start_counts_by_width", f"{SEQS},\n{windows('w4', 4)},\n{windows('w5', 5)},\n{windows('w6', 6)}", " UNION ALL ".join(f"SELECT {k} AS width, count(DISTINCT least(w, {RC.format('w')})) AS n FROM w{k}" for k in (4, 5, 6)))


def _hamming(a: str, b: str, n: int) -> str:
    return " + ".join(f"(substr({a}, {i + 1}, 1) <> substr({b}, {i + 1}, 1))::INT" for i in range(n))


def _shifted(a: str, b: str, n: int) -> str:
    parts = [_hamming(a, b, n)]
    for s in range(1, n):
        parts += [f"{s} + {_hamming(f'substr({a}, {s + 1})', b, n - s)}", f"{s} + {_hamming(f'substr({b}, {s + 1})', a, n - s)}"]
    return f"least({', '.join(parts)})"


_S6 = f"'{S.SEED6}'"
add("hamming_to_seed", W6, f"SELECT w, {_hamming('w', _S6, 6)} AS distance FROM k6")
add("shifted_edit_distance", W6, f"SELECT w, a AS shifted, least(a, b) AS either, least(a, b) <= 2 AS close FROM (SELECT w, {_shifted('w', _S6, 6)} AS a, {_shifted('rc', _S6, 6)} AS b FROM (SELECT w, {RC.format('w')} AS rc FROM k6))")
add("seed_filter_speedup", W6, f"SELECT w, n FROM (SELECT least(w, {RC.format('w')}) AS w, sum(n)::BIGINT AS n FROM k6 GROUP BY 1) WHERE ({_ORD}) % {S.EVERY} = 0")
add("n_segments", SEQS, "SELECT seq, count(*) FILTER (NOT contains(run, 'N')) AS known_runs, count(*) FILTER (contains(run, 'N')) AS unknown_runs, max(length(run)) FILTER (NOT contains(run, 'N')) AS longest_known, coalesce(sum(length(run)) FILTER (contains(run, 'N')), 0)::BIGINT AS unknown FROM (SELECT seq, unnest(regexp_extract_all(s, '[ACGT]+|N+')) AS run FROM seqs) GROUP BY 1")
add("markov_counts_o2", f"{SEQS},\n{MARKOV}", "SELECT k, ctx, base, n FROM mc")
add("markov_logprobs_o2", f"{SEQS},\n{MARKOV}", f"SELECT k, ctx, base, n, {r('logp')} AS logp FROM mk")
BASE = f"{SEQS},\n{MARKOV},\nll3 AS MATERIALIZED (SELECT x.w, CASE WHEN ends_with(x.w, 'N') THEN ({math.log(0.25)!r})::DOUBLE ELSE logp END AS ll FROM (SELECT DISTINCT w, regexp_extract(w, '[ACGT]*$') AS tail FROM w3) x LEFT JOIN mk ON ctx || base = tail),\nbl AS MATERIALIZED (SELECT seq, pos, right(w, 1) AS base, ll FROM w3 JOIN ll3 USING (w))"
add("base_log_likelihood", BASE, f"SELECT seq, count(*) AS n, {r('sum(ll)')} AS ll, {r('min(ll)')} AS least FROM bl GROUP BY 1")
_WLL = "wl AS (SELECT seq, pos, sum(ll) OVER x AS ll, count(*) OVER x AS n, sum((base = 'N')::INT) OVER x AS unknown FROM bl WINDOW x AS (PARTITION BY seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND {0} FOLLOWING))"
add("window_log_likelihood", f"{BASE},\n{_WLL.format(5)}", f"SELECT seq, count(*) AS n, {r('min(ll)')} AS low, {r('max(ll)')} AS high, {r('avg(ll)')} AS mean FROM wl WHERE n = 6 AND unknown = 0 GROUP BY 1")
add("isolated_log_likelihood", f"{SEQS},\n{MARKOV},\n{windows('w6', 6)},\n{isolated('l6', 'w6', 6)}", f"SELECT w, (SELECT count(*) FROM w6 WHERE w6.w = l6.w) AS n, {r('ll')} AS ll FROM l6")
add("log_odds_matrix", f"{SEQS},\n{FREQ},\n{PROBS},\n{LO}", f"SELECT motif, col, base, {r('lo')} AS lo, whole FROM whole")
add("pssm_ic", f"{SEQS},\n{FREQ},\n{PROBS}", f"SELECT motif, {r('sum(p * ln(p)) + count(DISTINCT col) * ln(4)')} AS ic, {r('sum(p * (ln(p) - ln(freq)))')} AS relative FROM raw JOIN freq USING (base) GROUP BY 1")
add("consensus", f"{SEQS},\n{FREQ},\n{PROBS},\na AS (SELECT motif, col, first(base ORDER BY p DESC, base) AS a, first(base ORDER BY p / freq DESC, base) AS b FROM raw JOIN freq USING (base) GROUP BY 1, 2)", "SELECT motif, string_agg(a, '' ORDER BY col) AS consensus, string_agg(b, '' ORDER BY col) AS over_background FROM a GROUP BY 1")
add("score_cdf", f"{SEQS},\n{FREQ},\n{PROBS},\n{LO},\n{CDF}", f"SELECT motif, score, {r('pdf', 9)} AS pdf, {r('tail', 9)} AS tail FROM cdf")
add("pwm_scan_sites", OCC, f'SELECT motif, w, seq, pos, strand, {r("z")} AS "Z" FROM occ')
_WORD = f"CASE WHEN strand = '+' THEN w ELSE {RC.format('w')} END"
add("pwm_scan_pvalues", f"{OCC},\n{FREQ},\n{PROBS},\n{LO},\n{CDF},\nsc AS (SELECT motif, w, strand, sum(whole)::INT AS score FROM (SELECT h.motif, h.w, h.strand, whole FROM (SELECT DISTINCT motif, w, strand, unnest(range(0, {S.WIDTH})) AS i FROM occ) h JOIN whole x ON x.motif = h.motif AND x.col = h.i AND x.base = substr(CASE WHEN h.strand = '+' THEN h.w ELSE {RC.format('h.w')} END, h.i + 1, 1)) GROUP BY 1, 2, 3)",
    f'SELECT o.motif, o.w, seq, pos, o.strand, {r("z")} AS "Z", sc.score, {r("tail", 9)} AS pvalue FROM occ o JOIN sc ON sc.motif = o.motif AND sc.w = o.w AND sc.strand = o.strand JOIN cdf c ON c.motif = o.motif AND c.score = sc.score')
add("pwm_scan_context", f"{BASE},\n{windows('w8', 8)},\n{_WLL.format(7)},\nx AS (SELECT w8.seq, w8.pos, w, ll FROM w8 JOIN wl ON wl.seq = w8.seq AND wl.pos = w8.pos),\n{hits('h8', 'x', SCANNED[:1]).replace(' AS motif, w, ', ' AS motif, w, seq, pos, ')}", f'SELECT motif, w, seq, pos, strand, {r("z")} AS "Z" FROM h8')
add("scan_filter_include_exclude", OCC, f"SELECT motif, w, seq, pos, strand, {r('z')} AS \"Z\" FROM occ WHERE motif IN ('M1', 'M2') AND motif NOT IN ('M2') AND z >= 0.5")
add("top_sites_per_motif", OCC, f'SELECT motif, rank, w, seq, pos, strand, z AS "Z" FROM (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY z DESC, seq, pos, strand)::INT AS rank FROM (SELECT motif, w, seq, pos, strand, {r("z")} AS z FROM occ)) WHERE rank <= 25')
add("sites_by_motif", OCC, f"SELECT motif, count(*) AS n, {r('sum(z)', 4)} AS sum_z, {r('min(z)', 4)} AS min_z, {r('max(z)', 4)} AS max_z FROM occ GROUP BY 1")
add("site_density", OCC, f"SELECT motif, seq, {r('count(*) / (any_value(length) - 7.0)', 9)} AS per_base FROM occ JOIN lens USING (seq) GROUP BY 1, 2")
add("best_z_by_seq", OCC, f"SELECT motif, seq, {r('max(z)')} AS best FROM occ GROUP BY 1, 2")
add("seq_centric_long", OCC, f"SELECT seq, motif, count(*) AS total, {r('sum(z)', 5)} AS expected, {r('max(z)', 5)} AS best, {r('1 - product(1 - z)', 5)} AS anywhere FROM occ GROUP BY 1, 2")
_WIDE = ", ".join(f"coalesce(count(*) FILTER (motif = '{m}'), 0) AS \"n_{m}\", {r(f'''coalesce(sum(z) FILTER (motif = '{m}'), 0)''', 5)} AS \"e_{m}\"" for m in S.NAMES)
add("seq_centric_wide", OCC, f"SELECT lens.seq, any_value(length) AS length, count(motif) AS total, {r('coalesce(sum(z), 0)', 5)} AS expected, {_WIDE} FROM lens LEFT JOIN occ USING (seq) GROUP BY 1")
add("seq_centric_melt", OCC, f"SELECT seq, stat, value FROM (UNPIVOT (SELECT lens.seq, {', '.join(f'''count(*) FILTER (motif = '{m}')::DOUBLE AS \"n_{m}\", {r(f'''coalesce(sum(z) FILTER (motif = '{m}'), 0)''', 5)} AS \"e_{m}\"''' for m in S.NAMES)} FROM lens LEFT JOIN occ USING (seq) GROUP BY 1) ON {', '.join(f'\"{k}_{m}\"' for m in S.NAMES for k in 'ne')} INTO NAME stat VALUE value)")
add("seq_centric_cast", OCC, "SELECT seq, " + ", ".join(f"count(*) FILTER (motif = '{m}') AS \"{m}_total\", {r(f'''coalesce(max(z) FILTER (motif = '{m}'), 0)''')} AS \"{m}_best\"" for m in S.NAMES) + " FROM occ GROUP BY 1")
add("full_outer_seq_stats", OCC, "SELECT seq, " + ", ".join(f"{r(f'''coalesce(sum(z) FILTER (motif = '{m}'), 0)''', 5)} AS \"{m}_e\"" for m in S.NAMES) + " FROM occ GROUP BY 1")
add("scan_summary", OCC, f"SELECT count(*) AS hits, count(DISTINCT motif) AS motifs, {r('min(z)')} AS min_z, {r('max(z)')} AS max_z, (SELECT count(*) FROM lens) AS seqs, (SELECT sum(length)::BIGINT FROM lens) AS bases FROM occ")
add("site_rank_curve", OCC, f'SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY z DESC, seq, pos, strand)::INT AS rank, z AS "Z" FROM (SELECT motif, seq, pos, strand, {r("z")} AS z FROM occ)')
add("coverage_curve", OCC, f"SELECT motif, row_number() OVER (PARTITION BY motif ORDER BY best DESC, seq)::INT AS rank, best FROM (SELECT motif, seq, {r('max(z)')} AS best FROM occ GROUP BY 1, 2)")
add("position_quantiles", OCC, f"SELECT motif, rank::INT AS rank, {r('scaled')} AS scaled, {r('CASE WHEN n > 1 THEN (rank - 1.0) / (n - 1) ELSE 0 END')} AS quantile FROM (SELECT motif, scaled, row_number() OVER (PARTITION BY motif ORDER BY scaled, seq, pos, strand) AS rank, count(*) OVER (PARTITION BY motif) AS n FROM (SELECT motif, seq, pos, strand, (pos + length(w) / 2.0) / length AS scaled FROM occ JOIN lens USING (seq)))")
add("cooccurrence", f"{OCC},\nb AS (SELECT motif, seq, max(z) AS z FROM occ GROUP BY 1, 2)", f"SELECT x.motif AS motif1, y.motif AS motif2, {r('sqrt(sum(x.z * y.z)) / (SELECT sqrt(sum(z * z)) FROM b WHERE b.motif = y.motif)')} AS c FROM b x JOIN b y USING (seq) GROUP BY 1, 2")
add("length_listing", SEQS, "SELECT length(s)::BIGINT AS length, count(*) AS n FROM seqs GROUP BY 1")
add("enrichment_vs_background", f"{OCC},\n{BENCH},\n{windows('v8', 8, 'bseqs')},\n{isolated('m8', 'v8', 8)},\n{hits('g8', 'm8', SCANNED)},\nbocc AS (SELECT motif, v8.w FROM v8 JOIN g8 USING (w)),\na AS (SELECT motif, count(*) / (SELECT sum(greatest(0, length(s) - 7))::DOUBLE FROM seqs) AS x FROM occ GROUP BY 1),\nb AS (SELECT motif, count(*) / (SELECT sum(greatest(0, length(s) - 7))::DOUBLE FROM bseqs) AS y FROM bocc GROUP BY 1)", f"SELECT motif, {r('x', 9)} AS per_base, {r('y', 9)} AS bg_per_base, {r('x / y', 9)} AS ratio FROM a LEFT JOIN b USING (motif)")
add("bed_export", OCC, f"SELECT name AS chrom, pos AS \"start\", pos + length(w) AS \"end\", motif AS name, floor(1000 * ({r('z')}))::INT AS score, strand FROM occ JOIN seqs USING (seq)")
add("adjacent_overlap_flag", OCC, "SELECT motif, seq, max(coalesce(nxt - pos < length(w), false)) AS overlapping FROM (SELECT *, lead(pos) OVER (PARTITION BY motif, seq ORDER BY pos, strand) AS nxt FROM occ) GROUP BY 1, 2")
add("merged_intervals", f"{OCC},\n{MERGED}", "SELECT * FROM merged")
_SHARED = "coalesce(sum(least(a.\"end\", b.\"end\") - greatest(a.\"start\", b.\"start\")), 0)::BIGINT"
_JOIN = "merged a JOIN merged b ON a.motif = 'M1' AND b.motif = 'M3' AND a.seq = b.seq AND a.\"start\" < b.\"end\" AND b.\"start\" < a.\"end\""
add("site_overlap_amount", f"{OCC},\n{MERGED}", f"SELECT {_SHARED} AS bases FROM {_JOIN}")
add("erased_windows", f"{OCC},\n{windows('w6', 6)},\ncov AS (SELECT DISTINCT seq, unnest(range(pos - 5, pos + 8)) AS pos FROM occ)", "SELECT seq, count(*) AS n FROM w6 ANTI JOIN cov ON cov.seq = w6.seq AND cov.pos = w6.pos GROUP BY 1")
add("confusion_counts", f"{OCC},\n{MERGED},\nq AS (SELECT (SELECT {_SHARED} FROM {_JOIN}) AS tp, (SELECT sum(\"end\" - \"start\")::BIGINT FROM merged WHERE motif = 'M1') AS t, (SELECT sum(\"end\" - \"start\")::BIGINT FROM merged WHERE motif = 'M3') AS p, (SELECT sum(length)::BIGINT FROM lens) AS n),\nc AS (SELECT tp, p - tp AS fp, t - tp AS fn, n - t - p + tp AS tn FROM q)",
    f"SELECT tp, fp, fn, tn, {r('tp / (tp + fn)::DOUBLE', 9)} AS \"nSn\", {r('tp / (tp + fp)::DOUBLE', 9)} AS \"nPPV\", {r('tn / (tn + fp)::DOUBLE', 9)} AS \"nSp\", {r('tp / (tp + fn + fp)::DOUBLE', 9)} AS \"nPC\", {r('(tp::DOUBLE * tn - fn::DOUBLE * fp) / sqrt((tp + fn)::DOUBLE * (tn + fp) * (tp + fp) * (tn + fn))', 9)} AS \"nCC\" FROM c")
add("pair_spacings", f"{OCC},\n{PAIRS}", "SELECT * FROM sp")
_FIT = f"{S.DISTANCE} + {{w}} <= {{s}} AND length - {S.DISTANCE} - {{w}} > {{e}} - 1"
add("pair_spacings_inner", f"{OCC},\n{PAIRS}", f'SELECT m1 AS "primary", m2 AS secondary, s1 = s2 AS same_strand, s1 = \'-\' AS upstream, d AS distance, seq, p1 AS "start", e2 AS "end" FROM pairs JOIN lens USING (seq) WHERE {_FIT.format(w="w2", s="p1", e="e1")} UNION ALL SELECT m2, m1, s1 = s2, s2 = \'+\', d, seq, p1, e2 FROM pairs JOIN lens USING (seq) WHERE m1 <> m2 AND {_FIT.format(w="w1", s="p2", e="e2")}')
add("spacing_histogram", f"{OCC},\n{PAIRS}", "SELECT * FROM hist")
_D = S.DISTANCE + 1
add("spacing_dense", f"{OCC},\n{PAIRS}", f'SELECT x."primary", x.secondary, cell::INT AS cell, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT "primary", secondary, unnest(range(0, {4 * _D})) AS cell FROM hist) x LEFT JOIN hist h ON h."primary" = x."primary" AND h.secondary = x.secondary AND h.distance + upstream::INT * {_D} + same_strand::INT * {2 * _D} = cell')
_EV = f'ev AS (SELECT "primary", secondary, sum(n)::BIGINT AS n, {r(f"lgamma({4 * _D}) - lgamma(sum(n) + {4 * _D}) + sum(lgamma(n + 1)) + sum(n) * ln({4 * _D})", 4)} AS log_evidence FROM hist GROUP BY 1, 2)'
add("spacing_evidence", f"{OCC},\n{PAIRS},\n{_EV}", "SELECT * FROM ev")
add("spacing_report", f"{OCC},\n{PAIRS},\n{_EV}", f'SELECT "primary", secondary, n, log_evidence FROM (SELECT *, row_number() OVER (PARTITION BY least("primary", secondary), greatest("primary", secondary) ORDER BY log_evidence DESC, "primary") AS r FROM ev) WHERE r = 1 AND log_evidence >= {S.EVIDENCE_AT_LEAST}')
_DEFS = ", ".join(f"('{a}', '{b}', {str(c).lower()}, {str(u).lower()}, {x})" for a, b, c, u, x in S.DEFINITIONS)
add("find_spacings", f"{OCC},\n{PAIRS}", f'SELECT "primary", secondary, same_strand, upstream, distance, seq, "start", "end" FROM sp SEMI JOIN (SELECT * FROM (VALUES {_DEFS}) AS t(a, b, c, u, x)) ON "primary" = a AND secondary = b AND same_strand = c AND upstream = u AND distance = x')
add("spaced_pairs_offset", OCC, f"SELECT * FROM (SELECT x.seq, x.pos AS pos_x, x.strand AS strand_x, y.pos AS pos_y, y.strand AS strand_y, CASE WHEN x.strand = '+' THEN y.pos - x.pos ELSE x.pos + length(x.w) - y.pos - length(y.w) END AS \"offset\" FROM occ x JOIN occ y ON x.motif = 'M1' AND y.motif = 'M3' AND x.seq = y.seq AND x.strand = y.strand) WHERE \"offset\" IN ({', '.join(map(str, S.OFFSETS))})")
_EM = [f"SELECT {_w} AS o, n * ({posterior(SCANNED[1], S.EM_LAMBDA, b)}) AS z FROM x" for _w, b in (("w", False), (RC.format("w"), True))]
add("em_iteration_counts", f"{SEQS},\n{MARKOV},\n{windows('w8', 8)},\n{isolated('l8', 'w8', 8)},\nx AS (SELECT l8.w, ll, n FROM l8 JOIN (SELECT w, count(*) AS n FROM w8 GROUP BY 1) k ON k.w = l8.w)", f"SELECT i::INT AS col, substr(o, i + 1, 1) AS base, {r('sum(z)', 3)} AS z FROM (SELECT o, z, unnest(range(0, 8)) AS i FROM ({' UNION ALL '.join(_EM)})) GROUP BY 1, 2")
add("pruned_words", OCC, f"SELECT w, count(*) AS n, strand, {r('any_value(z)')} AS \"Z\" FROM occ WHERE motif = 'M1' GROUP BY w, strand")
add("site_matrix", OCC, f"SELECT motif, i::INT AS col, substr(o, i + 1, 1) AS base, count(*) AS n FROM (SELECT motif, {_WORD} AS o, unnest(range(0, 8)) AS i FROM occ) GROUP BY 1, 2, 3")
add("hamming_per_base", OCC, " UNION ALL ".join(f"SELECT motif, {r(f'''sum({_hamming('o', repr(m.consensus()), 8)}) / (count(*) * 8.0)''')} AS per_base FROM (SELECT motif, {_WORD} AS o FROM occ WHERE motif = '{m.name}') GROUP BY 1" for m in S.MOTIFS))
add("event_spacings", "e AS (SELECT event_type AS motif, user_id AS seq, floor(epoch(ts))::BIGINT AS pos FROM events),\np AS (SELECT a.motif AS m1, b.motif AS m2, floor((b.pos - a.pos - 1) / 60)::BIGINT AS d FROM e a JOIN e b ON a.seq = b.seq AND b.pos - a.pos - 1 BETWEEN 0 AND 3600)", 'SELECT "primary", secondary, same_strand, upstream, d AS distance, count(*) AS n FROM (SELECT m1 AS "primary", m2 AS secondary, true AS same_strand, false AS upstream, d FROM p UNION ALL SELECT m2, m1, true, true, d FROM p WHERE m1 <> m2) GROUP BY ALL')
add("local_positions", f"{OCC},\ng AS (SELECT seq, coalesce(sum(length(s)) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gstart FROM seqs)", "SELECT DISTINCT gstart + pos AS gpos, seq, pos::BIGINT AS pos FROM occ JOIN g USING (seq)")
add("cumulative_log_likelihood", f"{BASE},\ncl AS (SELECT seq, sum(ll) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_ll FROM bl)", f"SELECT seq, {r('min(cum_ll)', 4)} AS last, {r('avg(cum_ll)', 4)} AS mean FROM cl GROUP BY 1")
_CHOOSE = "lgamma(sum(n) + 1) - sum(lgamma(n + 1))"
add("spacing_likelihoods", f"{OCC},\n{PAIRS}", f'SELECT "primary", secondary, sum(n)::BIGINT AS n, {r(_CHOOSE, 4)} AS log_choose, {r(f"{_CHOOSE} - sum(n) * ln({4 * _D})", 4)} AS log_uniform, {r(f"lgamma(sum(n) + 1) + lgamma({4 * _D}) - lgamma(sum(n) + {4 * _D})", 4)} AS log_dirichlet FROM hist GROUP BY 1, 2')
_FOUND = 'x."seq" = y."seq" AND least(x."end", y."end") - greatest(x."start", y."start") >= 0.25 * ({0}."end" - {0}."start") AND x."start" < y."end" AND y."start" < x."end"'
add("site_accuracy", f"{OCC},\n{MERGED},\nt AS (SELECT * FROM merged WHERE motif = 'M1'),\np AS (SELECT * FROM merged WHERE motif = 'M3'),\nc AS (SELECT (SELECT count(*) FROM t x WHERE EXISTS (SELECT 1 FROM p y WHERE {_FOUND.format('x')})) AS stp, (SELECT count(*) FROM p y WHERE NOT EXISTS (SELECT 1 FROM t x WHERE {_FOUND.format('x')})) AS sfp, (SELECT count(*) FROM t) AS n)",
    f'SELECT stp, sfp, n - stp AS sfn, {r("stp / n::DOUBLE", 9)} AS "sSn", {r("stp / (stp + sfp)::DOUBLE", 9)} AS "sPPV", {r("(stp / n::DOUBLE + stp / (stp + sfp)::DOUBLE) / 2", 9)} AS "sASP" FROM c')
add("report_header", OCC, f"SELECT (SELECT count(*) FROM lens) AS seqs, (SELECT sum(length)::BIGINT FROM lens) AS bases, count(*) AS sites, count(DISTINCT motif) AS motifs, {r('(SELECT sum(length)::DOUBLE FROM lens) / count(*)')} AS bases_per_site FROM occ")
add("fasta_round_trip", SEQS, "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, name, length(s)::BIGINT AS length, md5(s) AS digest FROM seqs")
SQL["scan_csv_round_trip"] = f"SELECT motif, w, seq, pos, strand, score FROM ({SQL['pwm_scan_pvalues']})"
add("lengths_round_trip", SEQS, "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, length(s)::BIGINT AS length, name FROM seqs")
