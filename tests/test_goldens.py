"""Known results: sites of a matrix in ten sequences, a score and its p-value, the likelihood."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import background, em, pssm, scan, sequences
from helixframe.sources import fasta

# fixed values: sequences, matrix and its sites with Z of .73 or more
SEQUENCES = [
    "ACTACCACCGACAGAGATAATTGATGGCAAGCTGCCCTCGCAGGGCACAACCTAAGAAATAGACTGAGTATCGTTACAGAAACATAAGAGGATCATCGGCGGTAAAAG",
    "CTCGCAAACCTTAGACGAGTTTCGCCGAGCACCACGAGGCCAAATCCAAAGGGAGTGTTTGGGCGTACCCTCTGCTCCTTAACCACTTGTACAATCGTCCGCCGCCCATGA",
    "TGATCAAAGGGAAGGCGCGCGTGCTACCTAAGGGAGATGGGCACGGAAAACTTGGGAATTTGACGAAAGCCAGGCAATAGGACAATTGCTCTCTGGTCCAAGCATTATCCCG",
    "AGCAAGGAGTAACCTTAGGATCCCGAATGGCAGACACTGATAAGCTTTATCAAACTGTGGCTGTGCGTATCATTCGTCGAGGGAGTACATACCTTTGCG",
    "CGGACTCACGCTAGCACGTCTAACATCGTACTACATGGCGAACCGCCGAAGGCGCTACTCGTCGATTAGTCCGGGCCACATCCGTAAATTTGAAATT",
    "GTGCCGAGTGGCGAAGCGGCTCAGGTTCCGCGTTGGAGTTATGTTCGCATGCGGACGTTTATGTATGAACCTCGAGAGAAAGCTAAAGAGAGGCTGAATCCCCAGTTCCGC",
    "CCCGGAGACGAGAGGATGGATGTAGAGCCATGCCCATGTCATAGGTGTCCCCAGCTTTGTAGAGTGAAGCCAAAACCTTAGGCGCTGGTGCTATTTATGATCCAATCGCAG",
    "CGTTCAGACTAGATATAAAGCGTAAGAGCCTTCCGACCGCTGCGACTTGGCGAAAAGCACGGGTTGCACTGATGCGAAGAATGGGGCTCCCTCCC",
    "AGGGACGGGGCGGAGTAGATTTGATCCTCAATAGTTGGATATTGCCGGCGGAAATGCGGAAGTAATAACGTAACCCACTGTCTGAC",
    "CCTCTAATGACGCGCGCACTTTTTCTCCTCTGTGGGTAACCACCGGTTAGGGGGTTCTGATACAACTTTAAGCCTCATCAGGTCAGACAACGG",
]
LOG_PWM = [
    [-0.2186892, -4.02535169, -1.82812711, -4.02535169],
    [-0.05505978, -4.02535169, -4.02535169, -4.02535169],
    [-1.46040233, -0.65805586, -1.46040233, -4.02535169],
    [-4.02535169, -0.05505978, -4.02535169, -4.02535169],
    [-4.02535169, -4.02535169, -4.02535169, -0.05505978],
    [-1.82812711, -2.41591378, -0.98082925, -0.98082925],
    [-0.52884413, -4.02535169, -1.19213835, -2.41591378],
    [-1.82812711, -4.02535169, -0.41443378, -1.82812711],
    [-1.82812711, -1.82812711, -0.41443378, -4.02535169],
    [-0.41443378, -1.19213835, -4.02535169, -4.02535169],
    [-1.82812711, -2.41591378, -0.65805586, -1.46040233],
]
SITES = [
    (0.749857, 5, 67, "+"), (0.814953, 0, 48, "+"), (0.819370, 3, 51, "+"), (0.827948, 5, 79, "+"), (0.862206, 3, 36, "-"), (0.912242, 5, 97, "-"), (0.919355, 2, 47, "+"),
    (0.963969, 1, 6, "+"), (0.968255, 6, 46, "-"), (0.968813, 9, 73, "-"), (0.974733, 5, 16, "-"), (0.984093, 6, 73, "+"), (0.984245, 3, 10, "+"),
]


@pytest.fixture(scope="module")
def ten(spark):
    return fasta.from_strings(spark, [(str(i), s) for i, s in enumerate(SEQUENCES)]).cache()


def test_sites_of_a_matrix(ten):
    motif = pssm.Motif("M", np.exp(np.array(LOG_PWM)))
    windows = sequences.windows(ten, motif.width).count()
    model = background.markov(ten, 2, 1.0)
    found = scan.scan(ten, [motif], model, 2, scan.sites_lambda(len(SEQUENCES), windows), 0.73, context=True)
    got = sorted((r["Z"], r["seq"], r["pos"], r["strand"]) for r in found.collect())
    assert [x[1:] for x in got] == [x[1:] for x in SITES]
    assert np.allclose([x[0] for x in got], [x[0] for x in SITES], atol=1e-6)
    isolated = scan.scan(ten, [motif], model, 2, scan.sites_lambda(len(SEQUENCES), windows), 0.73306, context=False)
    assert isolated.count() == 13


def test_score_and_p_value():
    # fixed values
    back = np.array([0.23644793, 0.26355207, 0.26355207, 0.23644793])
    a, c, t = 0.00029519092384519346, 0.00032902880149812734, 0.00029519092384519346
    g = [a, c, 0.99908058935081134, t]
    at = [0.99904675147315847, c, c, t]
    theta = np.array([g, g, at, g, [0.12513913599250936, 0.0003290288014981274, 0.87423664428214731, 0.00029519092384519351], at])
    lo = pssm.scaled(pssm.log_odds(pssm.Motif("M", theta), back))
    assert pssm.score_of("GGAGGA", lo) == 594
    tail = pssm.right_tail(pssm.score_pdf(lo, back.round(3)))
    assert abs(tail[594] - 0.00027054512544153608) < 1e-15


@pytest.mark.parametrize("g", [None, 0.25])
def test_expected_log_likelihood(spark, g):
    rows = [(0, "ACG", 0.7, -3.0, -4.0), (1, "TTT", 0.0, -9.0, -4.5), (0, "GGG", 1.0, -2.0, -5.0)]
    z = spark.createDataFrame(rows, "rc int, w string, Z double, bs double, ll double")
    if g is not None:
        z = z.withColumn("g", F.lit(g))
    lam, p = 0.01, g or 0.0
    want = sum((x * (math.log(1 - p) + math.log(lam) + bs) if x else 0) + ((1 - x) * (math.log((1 - p) * (1 - lam) + p) + ll) if x < 1 else 0) for _, _, x, bs, ll in rows)
    got = em.step(z, 3, lam)
    assert math.isclose(got[-1], want) and math.isclose(got[-2], 1.7)
    assert np.allclose(got[:12].reshape(3, 4), [[0.7, 0, 1, 0], [0, 0.7, 1, 0], [0, 0, 1.7, 0]])
