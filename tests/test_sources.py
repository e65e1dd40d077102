"""Readers and writers: round trips and rejected input."""

import pytest
from pyspark.sql import functions as F

from helixframe.operators.pssm import from_seed
from helixframe.sources import fasta, meme, scanfiles
from helixframe.streaming import scan as stream


def test_fasta(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">one two\nacgt\n ACN\n>\n\n>chr1:10-20\nTTT\n")
    got = sorted((r["name"], r["s"]) for r in fasta.read(spark, str(p)).collect())
    assert got == [("chr1:10-20", "TTT"), ("one two", "ACGTACN")]
    assert [tuple(r) for r in fasta.regions(fasta.read(spark, str(p))).select("chrom", "start", "end").collect()] == [("chr1", 10, 20)]
    fasta.write(fasta.read(spark, str(p)), str(tmp_path / "out"))
    assert sorted((r["name"], r["s"]) for r in fasta.read(spark, str(tmp_path / "out")).collect()) == got


def test_planted_truth(spark):
    s = fasta.planted(spark, "AAGGTTCC", 12, 40, 0.0, 7).cache()
    for r in fasta.planted_truth(s).join(s, "seq").collect():
        w = r["s"][r["pos"] : r["pos"] + 8]
        assert (w[::-1].translate(str.maketrans("ACGT", "TGCA")) if r["rev_comp"] else w) == r["site"] == "AAGGTTCC"


def test_meme_round_trip():
    m = from_seed("M1", "ACGT")
    m.evalue, m.url, m.altname = float("inf"), "http://x", "alt"
    got = meme.parse(meme.render([m, from_seed("M2", "AC")], [0.3, 0.2, 0.2, 0.3]))
    assert [x.name for x in got["motifs"]] == ["M1", "M2"] and got["background"] == [0.3, 0.2, 0.2, 0.3] and got["strands"] == ["+", "-"]
    first = got["motifs"][0]
    assert first.evalue == float("inf") and first.url == "http://x" and first.altname == "alt" and abs(first.probs - m.probs).max() < 1e-5
    assert meme.clover([m]).startswith(">M1\n") and "a" in "".join(meme.simplified(from_seed("z", "A", 0.001)))
    assert meme.renamed([m], "{name}-{idx}")[0].name == "M1-0"


def test_scan_files(spark, tmp_path):
    rows = [("M", "ACG", 1, 5, "+", 0.5, 10, 0.1), ("M", "ACC", 0, 2, "-", 0.25, 20, 0.01)]
    sites = spark.createDataFrame(rows, scanfiles.OCCURRENCES)
    scanfiles.write_occurrences(sites, str(tmp_path / "occ"))
    assert [tuple(r) for r in scanfiles.read_occurrences(spark, str(tmp_path / "occ")).collect()] == [rows[1], rows[0]]
    seqs = fasta.from_strings(spark, [("a", "ACGTACGT"), ("b", "CCCCCCCCC")])
    assert [tuple(r) for r in scanfiles.bed(sites, seqs).orderBy("chrom").collect()] == [("a", 2, 5, "M", 250, "-"), ("b", 5, 8, "M", 500, "+")]
    xml = scanfiles.cisml(sites, seqs).first()["xml"]
    assert 'start="4" stop="2"' in xml and 'start="5" stop="7"' in xml
    scanfiles.write_lengths(seqs, str(tmp_path / "len"))
    assert [r["length"] for r in scanfiles.read_lengths(spark, str(tmp_path / "len")).orderBy("seq").collect()] == [8, 9]
    assert scanfiles.unmatched(sites, seqs.where("seq = 0")).count() == 1


def test_spacing_definitions(spark, tmp_path):
    good, bad = tmp_path / "g", tmp_path / "b"
    good.write_text("A B S U 4\n\nA C C D 10\n")
    bad.write_text("A B X U 4\n")
    got = scanfiles.read_spacings(spark, str(good)).collect()
    assert [tuple(r) for r in got] == [("A", "B", True, True, 4), ("A", "C", False, False, 10)]
    assert scanfiles.render_spacings(scanfiles.read_spacings(spark, str(good))).first()[0] == "A B S U 4"
    with pytest.raises(Exception, match="not a spacing"):
        scanfiles.read_spacings(spark, str(bad)).collect()


def test_streaming_scan(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.fa").write_text(">a\nTTACGTACGATT\n>b\nCCCC\n")
    found = stream.scan(stream.read(spark, str(tmp_path / "in")), from_seed("M", "ACGTACGA", 0.01), [0.25] * 4)
    q = found.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["name"], r["pos"], r["strand"]) for r in spark.table("hits").where(F.col("Z") > 0.9).collect()] == [("a", 2, "+")]
