"""Sequence, background, scan, interval, spacing and statistics operators against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import background, em, intervals, pssm, scan, sequences, spacing, stats
from helixframe.operators.significance import ColumnPValues, Significance, exact_p, log_alignments, log_product_p
from helixframe.sources import fasta

R = random.Random(5)
RAW = [("a", "".join(R.choice("ACGT") for _ in range(150))), ("b", "NNAC" + "".join(R.choice("ACGTN") for _ in range(90))), ("c", ""), ("d", "ACG"), ("e", "".join(R.choice("AC") for _ in range(200)))]


def rc(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def seqs(spark):
    return fasta.from_strings(spark, RAW).cache()


def test_windows_across_tiles(seqs):
    for tile in (7, 4096):
        got = sorted((r["seq"], r["offset"], r["s"]) for r in sequences.tiles(seqs, 5, tile).collect())
        assert all(s == RAW[q][1][o : o + tile + 4] for q, o, s in got)
    got = sorted((r["seq"], r["pos"], r["w"]) for r in sequences.windows(seqs, 5).collect())
    assert got == sorted((q, i, s[i : i + 5]) for q, (_, s) in enumerate(RAW) for i in range(len(s) - 4) if "N" not in s[i : i + 5])


def test_global_positions(seqs, spark):
    g = sequences.globalise(seqs)
    starts = {r["seq"]: r["gstart"] for r in g.collect()}
    total = 0
    for q, (_, s) in enumerate(RAW):
        assert starts[q] == total
        total += len(s)
    back = sequences.localise(spark.range(total).select(F.col("id").alias("gpos")), g).collect()
    assert len(back) == total and all(starts[r["seq"]] + r["pos"] == r["gpos"] for r in back)


def test_counts(seqs):
    comp = {r["base"]: r["n"] for r in sequences.composition(seqs).collect()}
    assert comp == {b: sum(s.count(b) for _, s in RAW) for b in "ACGTN"}
    known = {r["width"]: r["n"] for r in sequences.known_window_counts(seqs, 6).collect()}
    assert known == {w: sum("N" not in s[i : i + w] for _, s in RAW for i in range(len(s) - w + 1)) for w in range(1, 7)}
    r = sorted((x["seq"], x["start"], x["end"], x["known"]) for x in sequences.runs(seqs).collect())
    assert all(("N" not in RAW[q][1][a:b]) == k and set(RAW[q][1][a:b]) <= (set("ACGT") if k else {"N"}) for q, a, b, k in r)


def brute_markov(order, pseudo=1.0):
    n = Counter(s[i : i + k + 1] for _, s in RAW for k in range(order + 1) for i in range(len(s) - k) if "N" not in s[i : i + k + 1])
    return lambda w: math.log((n[w] + pseudo) / (sum(n[w[:-1] + b] for b in "ACGT") + 4 * pseudo))


def brute_ll(s, order=2):
    f, out, run = brute_markov(order), [], 0
    for i, b in enumerate(s):
        if b == "N":
            out.append(math.log(0.25))
            run = 0
        else:
            k = min(run, order)
            out.append(f(s[i - k : i + 1]))
            run += 1
    return out


def test_background(seqs):
    m = background.markov(seqs, 2).cache()
    f = brute_markov(2)
    assert m.count() == 4 + 16 + 64
    assert all(abs(r["logp"] - f(r["ctx"] + r["base"])) < 1e-12 for r in m.collect())
    ll = {(r["seq"], r["pos"]): r["ll"] for r in background.base_ll(seqs, m, 2).collect()}
    for q, (_, s) in enumerate(RAW):
        for i, x in enumerate(brute_ll(s)):
            assert abs(ll[q, i] - x) < 1e-12
    wl = {(r["seq"], r["pos"]): (r["w"], r["ll"]) for r in background.window_ll(background.base_ll(seqs, m, 2), 6).collect()}
    assert all(w == RAW[q][1][i : i + 6] and abs(x - sum(brute_ll(RAW[q][1])[i : i + 6])) < 1e-9 for (q, i), (w, x) in wl.items())
    iso = {r["w"]: r["ll"] for r in background.isolated_ll(sequences.word_counts(seqs, 6), m, 2, 6).collect()}
    assert all(abs(x - sum(brute_ll(w))) < 1e-9 for w, x in iso.items())


@pytest.fixture(scope="module")
def sites(seqs):
    m = background.markov(seqs, 2).cache()
    return scan.scan(seqs, [pssm.from_seed("M", "ACAACA"), pssm.from_seed("K", "CCACC", 0.2)], m, 2, 0.05, 0.2).cache()


@pytest.mark.parametrize("context", [False, True])
def test_scan_is_exhaustive(seqs, context):
    motif = pssm.from_seed("M", "ACAACA")
    got = {(r["seq"], r["pos"], r["strand"]): r["Z"] for r in scan.scan(seqs, [motif], background.markov(seqs, 2), 2, 0.05, 0.2, context).collect()}
    want = {}
    for q, (_, s) in enumerate(RAW):
        ll = brute_ll(s)
        for i in range(len(s) - 5):
            w = s[i : i + 6]
            if "N" in w:
                continue
            back = sum(ll[i : i + 6]) if context else sum(brute_ll(w))
            for strand, x in (("+", w), ("-", rc(w))):
                odds = 0.05 / 0.95 * math.exp(sum(motif.log()[j]["ACGT".index(c)] for j, c in enumerate(x)) - back)
                if odds / (1 + odds) >= 0.2:
                    want[q, i, strand] = odds / (1 + odds)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want


def test_non_overlapping(sites):
    rows = [r.asDict() for r in sites.collect()]
    best = [r.asDict() for r in intervals.greedy(sites).collect()]
    want = []
    for m in ("M", "K"):
        kept = []
        for r in sorted((r for r in rows if r["motif"] == m), key=lambda r: (-r["Z"], r["pos"], r["strand"])):
            if all(k["seq"] != r["seq"] or abs(k["pos"] - r["pos"]) >= len(r["w"]) for k in kept):
                kept.append(r)
        want += kept
    key = lambda r: (r["motif"], r["seq"], r["pos"], r["strand"])
    assert sorted(map(key, best)) == sorted(map(key, want))
    top = scan.best(sites, 3).collect()
    assert max(Counter(r["motif"] for r in top).values()) <= 3
    swept = intervals.by_position(sites).collect()
    by = sorted((r["motif"], r["seq"], r["pos"], len(r["w"])) for r in swept)
    assert all(a[:2] != b[:2] or b[2] - a[2] >= a[3] for a, b in zip(by, by[1:], strict=False))


def test_interval_algebra(sites, seqs):
    m = intervals.merged(sites, "motif")
    cover = {x: {(r["seq"], i) for r in m.collect() if r["motif"] == x for i in range(r["start"], r["end"])} for x in ("M", "K")}
    pick = lambda x: m.where(F.col("motif") == x).select("seq", "start", "end")
    assert intervals.overlap_amount(pick("M"), pick("K")).first()[0] == len(cover["M"] & cover["K"])
    c = intervals.confusion(pick("M"), pick("K"), seqs).first()
    n = sum(len(s) for _, s in RAW)
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (len(cover["M"] & cover["K"]), len(cover["K"] - cover["M"]), len(cover["M"] - cover["K"]), n - len(cover["M"] | cover["K"]))
    left = {(r["seq"], r["pos"]) for r in intervals.erased(sequences.windows(seqs, 4), sites).collect()}
    hit = cover["M"] | cover["K"]
    want = {(r["seq"], r["pos"]) for r in sequences.windows(seqs, 4).collect() if not any((r["seq"], r["pos"] + i) in hit for i in range(4))}
    assert left == want


def test_spacing_golden(spark):
    """Two motifs of width 8, four bases apart, on three sequences of 44 bases."""
    rows = [("MOTIF-1", "AAGGTTCC", 0, 12, "+"), ("MOTIF-1", "AAGGTTCC", 1, 12, "+"), ("MOTIF-1", "AAGGTTCC", 2, 12, "-"), ("MOTIF-2", "CCTTGGAA", 0, 24, "+"), ("MOTIF-2", "CCTTGGAA", 1, 24, "+"), ("MOTIF-2", "CCTTGGAA", 2, 24, "+")]
    occ = spark.createDataFrame(rows, "motif string, w string, seq long, pos int, strand string").withColumn("Z", F.lit(1.0))
    size = spark.createDataFrame([(i, 44) for i in range(3)], "seq long, length int")
    h = spacing.histogram(spacing.oriented(spacing.close_pairs(occ, 4), size, 4))
    got = {(r["primary"][-1], r["same_strand"], r["upstream"], r["distance"]): r["n"] for r in h.collect()}
    assert got == {("1", True, False, 4): 2, ("1", False, True, 4): 1, ("2", True, True, 4): 2, ("2", False, True, 4): 1}
    e = spacing.evidence(h, 4).where("primary = 'MOTIF-1'").first()["log_evidence"]
    assert abs(e - (math.lgamma(20) - math.lgamma(23) + math.lgamma(3) + 3 * math.log(20))) < 1e-9
    cells = spacing.dense(h, 4).where("primary = 'MOTIF-1'").first()["cells"]
    assert len(cells) == 20 and cells[4 + 10] == 2 and cells[4 + 5] == 1 and sum(cells) == 3


def test_statistics(sites, seqs):
    rows = sites.collect()
    long = {(r["seq"], r["motif"]): r for r in stats.seq_long(sites).collect()}
    for (q, m), r in long.items():
        z = [x["Z"] for x in rows if x["seq"] == q and x["motif"] == m]
        assert r["total"] == len(z) and abs(r["expected"] - sum(z)) < 1e-9 and abs(r["anywhere"] - (1 - np.prod([1 - x for x in z]))) < 1e-9
    lengths = seqs.select("seq", F.length("s").alias("length"))
    wide = stats.seq_wide(sites, lengths, ["M", "K"])
    assert wide.count() == len(RAW) and wide.agg(F.sum("total")).first()[0] == len(rows)
    assert stats.melt(wide, ["M", "K"]).count() == 4 * len(RAW)


def test_score_and_p_value_tail():
    bg = np.array([0.3, 0.2, 0.2, 0.3])
    whole = pssm.scaled(pssm.log_odds(pssm.from_seed("s", "GGAGGA", 0.1), bg))
    pdf = pssm.score_pdf(whole, bg)
    assert abs(pdf.sum() - 1) < 1e-12
    tail = pssm.right_tail(pdf)
    import itertools

    cut = pssm.score_of("GGAGGA", whole) - 40
    want = sum(np.prod([bg["ACGT".index(c)] for c in w]) for w in itertools.product("ACGT", repeat=6) if pssm.score_of("".join(w), whole) >= cut)
    assert abs(tail[cut] - want) < 1e-12


def test_column_p_values():
    assert abs(exact_p([0.1, 0.45, 0.45], 2, 1.7) - 0.19) < 1e-9
    p = exact_p([0.2, 0.2, 0.3, 0.3], 10, 14)
    assert abs(p / 2.048e-07 - 1) < 1e-3
    for n, llr in ((10, 14), (10, 5), (6, 3)):
        got = math.exp(ColumnPValues(np.array([0.2, 0.2, 0.3, 0.3]), n, 4000)(llr))
        assert abs(got / exact_p([0.2, 0.2, 0.3, 0.3], n, llr) - 1) < 0.02
    assert abs(math.exp(log_product_p(math.log(0.01), 1)) - 0.01) < 1e-12
    assert log_alignments(2, 10) == math.log(20) + math.log((9 * 2) // 2)
    sig = Significance(np.full(4, 0.25), 10)
    strong, weak = sig.log_evalue(pssm.from_sites("x", ["ACGTACGTAA"] * 10, 0.01), 10, 1000), sig.log_evalue(pssm.from_sites("x", ["ACGTACGTAA", "TTTTACGTAA"] * 5, 0.01), 10, 1000)
    assert strong < 0 and strong < weak


def test_em_improves_likelihood(spark):
    r = random.Random(1)
    text = [("s", "".join(r.choice("ACGT") for _ in range(20)) + "AAGGTTCC" + "".join(r.choice("ACGT") for _ in range(20))) for _ in range(20)]
    s = fasta.from_strings(spark, text)
    m = background.markov(s, 0).cache()
    rows = background.window_ll(background.base_ll(s, m, 0), 8).join(sequences.globalise(s).select("seq", "gstart"), "seq").withColumn("gpos", F.col("gstart") + F.col("pos")).drop("gstart")
    out = em.run_em(rows, pssm.from_seed("x", "AAGGTTCA"), 20, rows.count(), most=6)
    assert out.motif.consensus() in ("AAGGTTCC", "GGAACCTT") and out.expected_sites > 10


def test_seed_and_grid():
    assert np.allclose(pssm.from_seed("x", "AN").probs, [[0.5, 1 / 6, 1 / 6, 1 / 6], [0.25] * 4])
    assert pssm.geometric(2, 10, 2**0.5) == [2, 3, 4, 5, 7, 9, 10]
    assert pssm.shuffled(pssm.from_seed("x", "ACGT"), 1).width == 4
    assert abs(pssm.information(pssm.uniform("u", 3))) < 1e-9


def test_site_confusion(spark):
    cols = "seq long, start int, end int"
    truth = spark.createDataFrame([(1, 0, 8), (1, 20, 28), (2, 0, 8), (3, 5, 6)], cols)
    found = spark.createDataFrame([(1, 6, 14), (1, 27, 40), (2, 0, 4), (2, 4, 8), (4, 0, 8)], cols)
    c = intervals.site_confusion(truth, found)
    assert tuple(c.first()) == (2, 2, 2)  # a cover of 1 of 8 is not enough
    assert [round(x, 9) for x in intervals.site_accuracy(c).first()] == [0.5, 0.5, 0.5]
    assert tuple(intervals.site_confusion(truth.limit(0), found.limit(0)).first()) == (0, 0, 0)


def test_spacing_likelihoods(spark):
    h = spark.createDataFrame([("a", "b", True, False, 0, 3), ("a", "b", True, False, 2, 1)], "primary string, secondary string, same_strand boolean, upstream boolean, distance int, n long")
    r = spacing.likelihoods(h, 2, alpha=2.0).first()
    choose = math.lgamma(5) - math.lgamma(4) - math.lgamma(2)
    assert r["n"] == 4 and abs(r["log_choose"] - choose) < 1e-9 and abs(r["log_uniform"] - choose + 4 * math.log(12)) < 1e-9
    want = choose + math.lgamma(24) - math.lgamma(28) + math.lgamma(5) - math.lgamma(2) + math.lgamma(3) - math.lgamma(2)
    assert abs(r["log_dirichlet"] - want) < 1e-9


def test_centroid_merges():
    x = np.array([[0.0, 0.0], [0.0, 1.0], [5.0, 0.0], [5.0, 3.0], [9.0, 9.0]])
    clusters, want = {i: [i] for i in range(len(x))}, []
    for node in range(len(x), 2 * len(x) - 1):
        d, a, b = min((float(np.linalg.norm(x[clusters[a]].mean(0) - x[clusters[b]].mean(0))), a, b) for a in clusters for b in clusters if a < b)
        clusters[node] = clusters.pop(a) + clusters.pop(b)
        want.append((a, b, round(d, 9), len(clusters[node])))
    assert [(a, b, round(d, 9), n) for a, b, d, n in stats.merges(x @ x.T)] == want
    assert stats.merges(np.zeros((1, 1))) == []
