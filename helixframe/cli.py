"""Command-line programs over the operators: ``python -m helixframe.cli COMMAND ...``."""

from __future__ import annotations

import argparse
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import background, discover, discriminate, em, intervals, pssm, scan, sequences, spacing, stats
from .session import local_session, ship
from .sources import fasta, meme, scanfiles


def _model(seqs: DataFrame, a: argparse.Namespace, spark: SparkSession) -> tuple[DataFrame, np.ndarray]:
    source = fasta.read(spark, a.background) if a.background else seqs
    freqs = np.array([r["freq"] for r in background.frequencies(source).orderBy("base").collect()])
    return background.markov(source, a.order, a.pseudo).cache(), freqs


def do_scan(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sites of all motifs, sequence lengths and, if asked, BED."""
    seqs = fasta.read(spark, a.fasta).cache()
    motifs = [m.for_scan() for m in meme.read(spark, a.motifs)["motifs"]]
    model, freqs = _model(seqs, a, spark)
    sites = scan.decorate(scan.scan(seqs, motifs, model, a.order, a.lam, a.threshold, context=not a.isolated), motifs, freqs).cache()
    scanfiles.write_occurrences(sites, f"{a.out}/occurrences")
    scanfiles.write_lengths(seqs, f"{a.out}/lengths")
    if a.bed:
        scanfiles.write_bed(sites, seqs, f"{a.out}/bed")


def do_discover(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = fasta.read(spark, a.fasta).cache()
    found = discover.discover(seqs, a.count, a.min_sites, a.max_sites, a.width or None, a.order, a.threshold, a.every)
    meme.write(spark, [f["motif"] for f in found], f"{a.out}/motifs")
    for i, f in enumerate(found):
        f["instances"].write.option("header", True).csv(f"{a.out}/instances-{i + 1}")


def do_em(spark: SparkSession, a: argparse.Namespace) -> None:
    seqs = fasta.read(spark, a.fasta).cache()
    model, _ = _model(seqs, a, spark)
    windows = background.window_ll(background.base_ll(seqs, model, a.order), len(a.seed))
    windows = windows.join(sequences.globalise(seqs).select("seq", "gstart"), "seq").withColumn("gpos", F.col("gstart") + F.col("pos")).drop("gstart").cache()
    r = em.run_em(windows, pssm.from_seed("EM", a.seed), a.sites, windows.count())
    meme.write(spark, [r.motif], f"{a.out}/motifs")


def do_stats(spark: SparkSession, a: argparse.Namespace) -> None:
    sites, lengths = scanfiles.read_occurrences(spark, a.occurrences, False).cache(), scanfiles.read_lengths(spark, a.lengths)
    names = [r[0] for r in sites.select("motif").distinct().orderBy("motif").collect()]
    for name, df in (("motifs", stats.by_motif(sites)), ("summary", stats.summary(sites, lengths)), ("cooccurrence", stats.cooccurrence(stats.best_by_seq(sites))), ("sequences", stats.seq_wide(sites, lengths, names))):
        df.write.option("header", True).csv(f"{a.out}/{name}")


def do_spacings(spark: SparkSession, a: argparse.Namespace) -> None:
    """Histograms and evidence of all pairs, or the places of defined spacings."""
    sites = scanfiles.read_occurrences(spark, a.occurrences, False)
    pairs = spacing.oriented(spacing.close_pairs(sites, a.distance), scanfiles.read_lengths(spark, a.lengths).select("seq", "length") if a.lengths else None, a.distance)
    if a.definitions:
        defs = scanfiles.read_spacings(spark, a.definitions).cache()
        lost = [r[0] for r in spacing.undefined_motifs(defs, sites).collect()]
        if lost:
            raise SystemExit(f"no sites of {', '.join(lost)}")
        spacing.find(pairs, defs).write.option("header", True).csv(f"{a.out}/pairs")
        return
    counts = spacing.histogram(pairs).cache()
    counts.write.option("header", True).csv(f"{a.out}/histogram")
    e = spacing.evidence(counts, a.distance)
    (e if a.inverse else spacing.without_inverse(e)).where(F.col("log_evidence") >= a.evidence).orderBy(F.desc("log_evidence")).write.option("header", True).csv(f"{a.out}/evidence")


def do_discriminate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sequence tables of two sets; columns e_* are the design."""
    sets = [scanfiles.read_wide(spark, p).withColumn("y", F.lit(float(i))) for i, p in enumerate(a.tables)]
    data = sets[0]
    for x in sets[1:]:
        data = data.unionByName(x, allowMissingColumns=True)
    cols = [c for c in data.columns if c.startswith("e_")]
    r = discriminate.discriminate(data.na.fill(0), cols, alpha=a.alpha)
    spark.createDataFrame([("auc", r["auc"]), ("lambda", r["lambda"]), *r["weights"]], "name string, value double").write.option("header", True).csv(f"{a.out}/weights")


def do_filter(spark: SparkSession, a: argparse.Namespace) -> None:
    sites = scan.include_exclude(scanfiles.read_occurrences(spark, a.occurrences, False), a.include, a.exclude, a.threshold)
    scanfiles.write_occurrences(intervals.greedy(sites) if a.no_overlap else sites, a.out)


def do_motifs(spark: SparkSession, a: argparse.Namespace) -> None:
    """Renames, adds pseudo-counts, shuffles positions, or writes counts."""
    motifs = meme.renamed(meme.read(spark, a.motifs)["motifs"], a.pattern, a.pseudo)
    if a.shuffle is not None:
        motifs = [pssm.shuffled(m, a.shuffle + i) for i, m in enumerate(motifs)]
    spark.createDataFrame([(meme.clover(motifs) if a.clover else meme.render(motifs),)], "value string").coalesce(1).write.text(a.out)


def do_sites(spark: SparkSession, a: argparse.Namespace) -> None:
    """A list of aligned sites to a motif."""
    rows = spark.read.text(a.sites).select(F.upper(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("s")).where("s <> ''")
    meme.write(spark, [pssm.from_site_rows(a.name or Path(a.sites).stem, rows)], a.out)


def do_plant(spark: SparkSession, a: argparse.Namespace) -> None:
    fasta.write(fasta.planted(spark, a.site, a.count, a.length, a.mutation, a.seed), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *args: tuple) -> None:
        p = sub.add_parser(name, help=(run.__doc__ or "").strip() or None)
        for flag, options in args:
            p.add_argument(flag, **options)
        p.add_argument("--out", required=True)
        p.set_defaults(run=run)

    bg = (("--background", {}), ("--order", {"type": int, "default": 2}), ("--pseudo", {"type": float, "default": 1.0}))
    z = ("--threshold", {"type": float, "default": scan.THRESHOLD})
    occ, lens = ("occurrences", {}), ("--lengths", {})
    command("scan", do_scan, ("motifs", {}), ("fasta", {}), *bg, ("--lam", {"type": float, "default": scan.LAMBDA}), z, ("--bed", {"action": "store_true"}), ("--isolated", {"action": "store_true"}))
    command("discover", do_discover, ("fasta", {}), *bg, z, ("--count", {"type": int, "default": 1}), ("--min-sites", {"type": int, "default": 0}), ("--max-sites", {"type": int, "default": 0}), ("--width", {"type": int, "action": "append"}), ("--every", {"type": int, "default": 1}))
    command("em", do_em, ("fasta", {}), ("seed", {}), ("sites", {"type": float}), *bg)
    command("stats", do_stats, occ, ("lengths", {}))
    command("spacings", do_spacings, occ, lens, ("--definitions", {}), ("--distance", {"type": int, "default": spacing.DISTANCE}), ("--evidence", {"type": float, "default": 1.0}), ("--inverse", {"action": "store_true"}))
    command("discriminate", do_discriminate, ("tables", {"nargs": "+"}), ("--alpha", {"type": float, "default": 1.0}))
    command("filter", do_filter, occ, ("--include", {"action": "append"}), ("--exclude", {"action": "append"}), ("--threshold", {"type": float, "default": 0.0}), ("--no-overlap", {"action": "store_true"}))
    command("motifs", do_motifs, ("motifs", {}), ("--pattern", {"default": "{name}"}), ("--pseudo", {"type": float, "default": 0.0}), ("--shuffle", {"type": int}), ("--clover", {"action": "store_true"}))
    command("sites", do_sites, ("sites", {}), ("--name", {}))
    command("plant", do_plant, ("site", {}), ("--count", {"type": int, "default": 30}), ("--length", {"type": int, "default": 100}), ("--mutation", {"type": float, "default": 0.1}), ("--seed", {"type": int, "default": 1}))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or local_session()
    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
