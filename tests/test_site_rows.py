"""Motifs of site lists of any length."""

import numpy as np

from helixframe import cli
from helixframe.operators import pssm
from helixframe.sources import meme


def test_all_lines_of_a_long_site_list_count(spark, tmp_path):
    (tmp_path / "list").write_text("ACGT\n" * 1_000_000 + " ttgn \n\n" * 500_000)
    cli.main(["sites", str(tmp_path / "list"), "--name", "M", "--out", str(tmp_path / "m")])
    m = meme.read(spark, str(tmp_path / "m"))["motifs"][0]
    assert m.nsites == 1_500_000
    assert np.allclose(m.probs[0], [2 / 3, 0, 0, 1 / 3], atol=1e-4)


def test_rows_as_the_list(spark):
    sites = ["ACGT", "AAGN", "TCGT"]
    want, got = pssm.from_sites("M", sites), pssm.from_site_rows("M", spark.createDataFrame([(s,) for s in sites], "s string"))
    assert np.array_equal(want.probs, got.probs) and want.nsites == got.nsites
