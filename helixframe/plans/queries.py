"""The registered queries: operators applied to the DNA view of the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import background, discover, discriminate, em, intervals, pssm, sampling, scan, sequences, spacing, stats
from ..session import folder, ship
from ..sources import fasta, scanfiles
from . import settings as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_kept: dict[tuple, DataFrame] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return sequences.from_documents(spark.read.parquet(f"{d}/documents.parquet"))


def bench_seqs(spark: SparkSession, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return sequences.from_documents(b.select(F.col("item_id").alias("doc_id"), F.lit("benchmark").alias("source"), "text"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return seqs(spark, d).select("seq", F.length("s").cast("long").alias("length"))


def kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one session share; stored where it fits, made again where it is lost."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _kept:
        _kept[key] = make().persist()
    return _kept[key]


def model(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "markov", lambda: background.markov(seqs(spark, d), S.ORDER))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """(motif, w, seq, pos, strand, Z) of the three motifs."""
    return kept(spark, d, "sites", lambda: scan.scan(seqs(spark, d), [m.for_scan() for m in S.MOTIFS], model(spark, d), S.ORDER, S.LAMBDA, S.THRESHOLD))


def freqs(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r["freq"] for r in background.frequencies(seqs(spark, d)).orderBy("base").collect()])


def one(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query
def dna_sequences(spark: SparkSession, d: str) -> DataFrame:
    return sequences.globalise(seqs(spark, d)).select("seq", "name", "length", "gstart", F.md5("s").alias("digest"))


@query
def base_composition(spark: SparkSession, d: str) -> DataFrame:
    return sequences.composition(seqs(spark, d))


@query
def zero_order_freqs(spark: SparkSession, d: str) -> DataFrame:
    a = background.frequencies(seqs(spark, d)).withColumnRenamed("freq", "symmetric")
    b = background.frequencies(seqs(spark, d), pseudo=1.0, symmetric=False).select("base", F.col("freq").alias("plain"))
    return rounded(a.join(b, "base"), "symmetric", "plain", digits=9)


@query
def kmer_counts_w6(spark: SparkSession, d: str) -> DataFrame:
    return sequences.word_counts(seqs(spark, d), 6)


@query
def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    return sequences.canonical_counts(seqs(spark, d), 6)


@query
def kmer_ordinal(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    return sequences.word_counts(seqs(spark, d), 6).select("w", dna.word_ordinal(w, 6).alias("ordinal"), dna.reverse_complement(w).alias("rc"), dna.base_ordinal(dna.at(w, 0)).cast("int").alias("first"))


@query
def prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    words = sequences.word_counts(seqs(spark, d), 6)
    depth = words.select("w", "n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("depth"))
    return depth.groupBy("depth", F.substring("w", F.lit(1), F.col("depth")).alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("leaves"))


@query
def nfree_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequences.known_window_counts(seqs(spark, d), 12)


@query
def start_counts_by_width(spark: SparkSession, d: str) -> DataFrame:
    return sequences.start_counts(seqs(spark, d), [4, 5, 6])


@query
def hamming_to_seed(spark: SparkSession, d: str) -> DataFrame:
    return sequences.word_counts(seqs(spark, d), 6).select("w", dna.hamming(F.col("w"), F.lit(S.SEED6), 6).alias("distance"))


@query
def shifted_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    w, s = F.col("w"), F.lit(S.SEED6)
    return sequences.word_counts(seqs(spark, d), 6).select("w", dna.shifted_distance(w, s, 6).alias("shifted"), dna.shifted_distance_rc(w, s, 6).alias("either"), dna.close_seeds(w, s, 6).alias("close"))


@query
def seed_filter_speedup(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: one of EVERY canonical words by its ordinal."""
    w = F.col("w")
    return sequences.canonical_counts(seqs(spark, d), 6).where(F.pmod(dna.word_ordinal(w, 6), F.lit(S.EVERY)) == 0)


@query
def n_segments(spark: SparkSession, d: str) -> DataFrame:
    r = sequences.runs(seqs(spark, d))
    size = F.col("end") - F.col("start")
    return r.groupBy("seq").agg(F.count_if("known").alias("known_runs"), F.count_if(~F.col("known")).alias("unknown_runs"), F.max(F.when(F.col("known"), size)).cast("long").alias("longest_known"), F.sum(F.when(~F.col("known"), size).otherwise(0)).cast("long").alias("unknown"))


@query
def markov_counts_o2(spark: SparkSession, d: str) -> DataFrame:
    return background.markov_counts(seqs(spark, d), 2)


@query
def markov_logprobs_o2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(model(spark, d), "logp")


@query
def base_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    base = background.base_ll(seqs(spark, d), model(spark, d), S.ORDER)
    return rounded(base.groupBy("seq").agg(F.count("*").alias("n"), F.sum("ll").alias("ll"), F.min("ll").alias("least")), "ll", "least")


@query
def window_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    x = background.window_ll(background.base_ll(seqs(spark, d), model(spark, d), S.ORDER), 6)
    return rounded(x.groupBy("seq").agg(F.count("*").alias("n"), F.min("ll").alias("low"), F.max("ll").alias("high"), F.avg("ll").alias("mean")), "low", "high", "mean")


@query
def isolated_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    words = sequences.word_counts(seqs(spark, d), 6)
    return rounded(background.isolated_ll(words, model(spark, d), S.ORDER, 6), "ll")


@query
def log_odds_matrix(spark: SparkSession, d: str) -> DataFrame:
    f = freqs(spark, d)
    rows = []
    for m in S.MOTIFS:
        lo = pssm.log_odds(m.for_scan(), f)
        whole = pssm.scaled(lo)
        rows += [(m.name, i, "ACGTN"[b], round(float(lo[i, b]), 6), int(whole[i, b])) for i in range(m.width) for b in range(5)]
    return rounded(one(spark, rows, "motif string, col int, base string, lo double, whole int"), "lo")


@query
def pssm_ic(spark: SparkSession, d: str) -> DataFrame:
    t = pssm.table(spark, S.MOTIFS)
    f = background.frequencies(seqs(spark, d)).select("base", "freq")
    term = F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)
    rel = F.when(F.col("p") > 0, F.col("p") * (F.log("p") - F.log("freq"))).otherwise(0.0)
    x = t.join(F.broadcast(f), "base").groupBy("motif").agg((F.sum(term) + F.count_distinct("col") * F.log(F.lit(4.0))).alias("ic"), F.sum(rel).alias("relative"))
    return rounded(x, "ic", "relative")


@query
def consensus(spark: SparkSession, d: str) -> DataFrame:
    f = background.frequencies(seqs(spark, d)).select("base", "freq")
    t = pssm.table(spark, S.MOTIFS).join(F.broadcast(f), "base")
    best = lambda v: F.max_by("base", F.struct(v, (-F.ascii("base")).alias("b")))
    col = t.groupBy("motif", "col").agg(best(F.col("p")).alias("a"), best((F.col("p") / F.col("freq")).alias("r")).alias("b"))
    word = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", c))), lambda x: x[c]), "")
    return col.groupBy("motif").agg(word("a").alias("consensus"), word("b").alias("over_background"))


@query
def score_cdf(spark: SparkSession, d: str) -> DataFrame:
    f = freqs(spark, d)
    rows = []
    for m in S.MOTIFS:
        whole = pssm.scaled(pssm.log_odds(m.for_scan(), f))
        pdf = pssm.score_pdf(whole, f)
        tail = pssm.right_tail(pdf)
        rows += [(m.name, int(s), float(pdf[s]), float(tail[s])) for s in np.flatnonzero(pdf)]
    return rounded(one(spark, rows, "motif string, score int, pdf double, tail double"), "pdf", "tail", digits=9)


@query
def pwm_scan_sites(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sites(spark, d), "Z")


@query
def pwm_scan_pvalues(spark: SparkSession, d: str) -> DataFrame:
    out = scan.decorate(sites(spark, d), [m.for_scan() for m in S.MOTIFS], freqs(spark, d))
    return rounded(rounded(out, "Z"), "pvalue", digits=9)


@query
def pwm_scan_context(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scan.scan(seqs(spark, d), [S.MOTIFS[0].for_scan()], model(spark, d), S.ORDER, S.LAMBDA, S.THRESHOLD, context=True), "Z")


@query
def scan_filter_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scan.include_exclude(sites(spark, d), ["M1", "M2"], ["M2"], 0.5), "Z")


@query
def top_sites_per_motif(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 25 best sites of each motif."""
    r = F.row_number().over(W.partitionBy("motif").orderBy(F.desc("zr"), "seq", "pos", "strand"))
    x = sites(spark, d).withColumn("zr", F.round("Z", 6)).withColumn("rank", r).where("rank <= 25")
    return x.select("motif", "rank", "w", "seq", "pos", "strand", F.col("zr").alias("Z"))


@query
def best_wmers_nonoverlap(spark: SparkSession, d: str) -> DataFrame:
    """The 100 best non-overlapping sites of each motif."""
    return rounded(scan.best(sites(spark, d), 100), "Z")


@query
def nonoverlap_by_position(spark: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.by_position(sites(spark, d)), "Z")


@query
def nonoverlap_greedy(spark: SparkSession, d: str) -> DataFrame:
    return rounded(intervals.greedy(sites(spark, d)), "Z")


@query
def sites_by_motif(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.by_motif(sites(spark, d)), "sum_z", "min_z", "max_z", digits=4)


@query
def site_density(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.density(sites(spark, d), lengths(spark, d)), "per_base", digits=9)


@query
def best_z_by_seq(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.best_by_seq(sites(spark, d)), "best")


@query
def seq_centric_long(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.seq_long(sites(spark, d)), "expected", "best", "anywhere", digits=5)


@query
def seq_centric_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.seq_wide(sites(spark, d), lengths(spark, d), S.NAMES), "expected", *[f"e_{m}" for m in S.NAMES], digits=5)


@query
def seq_centric_melt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.melt(stats.seq_wide(sites(spark, d), lengths(spark, d), S.NAMES), S.NAMES), "value", digits=5)


@query
def seq_centric_cast(spark: SparkSession, d: str) -> DataFrame:
    wide = stats.cast(stats.seq_long(sites(spark, d)), S.NAMES, ("total", "best"))
    return rounded(wide, *[f"{m}_best" for m in S.NAMES])


@query
def full_outer_seq_stats(spark: SparkSession, d: str) -> DataFrame:
    x = sites(spark, d).groupBy("motif", "seq").agg(F.sum("Z").alias("e"))
    t = [(m, x.where(F.col("motif") == m).select("seq", "e")) for m in S.NAMES]
    return rounded(stats.joined(t), *[f"{m}_e" for m in S.NAMES], digits=5)


@query
def scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.summary(sites(spark, d), lengths(spark, d)), "min_z", "max_z")


@query
def site_rank_curve(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_curve(rounded(sites(spark, d), "Z"))


@query
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return stats.coverage_curve(rounded(stats.best_by_seq(sites(spark, d)), "best"))


@query
def position_quantiles(spark: SparkSession, d: str) -> DataFrame:
    x = stats.position_curve(sites(spark, d), lengths(spark, d))
    return rounded(x, "scaled", "quantile")


@query
def cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cooccurrence(stats.best_by_seq(sites(spark, d))), "c")


@query
def length_listing(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_listing(lengths(spark, d))


@query
def enrichment_vs_background(spark: SparkSession, d: str) -> DataFrame:
    words = [m.for_scan() for m in S.MOTIFS]
    bg = scan.scan(bench_seqs(spark, d), words, model(spark, d), S.ORDER, S.LAMBDA, S.THRESHOLD)
    a = stats.mean_density(sites(spark, d), lengths(spark, d))
    b = stats.mean_density(bg, bench_seqs(spark, d).select("seq", F.length("s").cast("long").alias("length")))
    return rounded(stats.enrichment(a, b), "per_base", "bg_per_base", "ratio", digits=9)


@query
def bed_export(spark: SparkSession, d: str) -> DataFrame:
    x = scanfiles.bed(sites(spark, d).withColumn("Z", F.round("Z", 6)), seqs(spark, d))
    return x


@query
def adjacent_overlap_flag(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlap_flags(sites(spark, d))


@query
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged(sites(spark, d), "motif")


@query
def site_overlap_amount(spark: SparkSession, d: str) -> DataFrame:
    m = intervals.merged(sites(spark, d), "motif")
    pick = lambda x: m.where(F.col("motif") == x).select("seq", "start", "end")
    return intervals.overlap_amount(pick("M1"), pick("M3"))


@query
def erased_windows(spark: SparkSession, d: str) -> DataFrame:
    left = intervals.erased_free(seqs(spark, d), sites(spark, d), 6)
    return left.groupBy("seq").agg(F.count("*").alias("n"))


@query
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    m = intervals.merged(sites(spark, d), "motif")
    pick = lambda x: m.where(F.col("motif") == x).select("seq", "start", "end")
    c = intervals.confusion(pick("M1"), pick("M3"), seqs(spark, d))
    return rounded(c.crossJoin(intervals.accuracy(c)), "nSn", "nPPV", "nSp", "nPC", "nCC", digits=9)  # single rows


def _spacings(spark: SparkSession, d: str) -> DataFrame:
    return spacing.oriented(spacing.close_pairs(sites(spark, d), S.DISTANCE), None, S.DISTANCE)


@query
def pair_spacings(spark: SparkSession, d: str) -> DataFrame:
    return _spacings(spark, d)


@query
def pair_spacings_inner(spark: SparkSession, d: str) -> DataFrame:
    return spacing.oriented(spacing.close_pairs(sites(spark, d), S.DISTANCE), lengths(spark, d), S.DISTANCE)


@query
def spacing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return spacing.histogram(_spacings(spark, d))


@query
def spacing_dense(spark: SparkSession, d: str) -> DataFrame:
    cells = spacing.dense(spacing.histogram(_spacings(spark, d)), S.DISTANCE)
    return cells.select("primary", "secondary", F.posexplode("cells").alias("cell", "n"))


@query
def spacing_evidence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spacing.evidence(spacing.histogram(_spacings(spark, d)), S.DISTANCE), "log_evidence", digits=4)


@query
def spacing_report(spark: SparkSession, d: str) -> DataFrame:
    x = rounded(spacing.evidence(spacing.histogram(_spacings(spark, d)), S.DISTANCE), "log_evidence", digits=4)
    return spacing.without_inverse(x).where(F.col("log_evidence") >= S.EVIDENCE_AT_LEAST)


@query
def find_spacings(spark: SparkSession, d: str) -> DataFrame:
    defs = one(spark, S.DEFINITIONS, "primary string, secondary string, same_strand boolean, upstream boolean, distance int")
    return spacing.find(_spacings(spark, d), F.broadcast(defs))


@query
def spaced_pairs_offset(spark: SparkSession, d: str) -> DataFrame:
    x = sites(spark, d)
    return spacing.offset_pairs(x.where("motif = 'M1'"), x.where("motif = 'M3'"), S.OFFSETS)


@query
def em_iteration_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sums of Z by position and base: one expectation step and the counts of the maximisation step."""
    m = S.MOTIFS[1]
    words = sequences.word_counts(seqs(spark, d), m.width)
    ll = background.isolated_ll(words, model(spark, d), S.ORDER, m.width)
    z = em.posteriors(ll, m.for_scan(), S.EM_LAMBDA)
    o = F.when(F.col("rc") == 0, F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    by = z.select(F.posexplode(F.split(o, "")).alias("col", "base"), (F.col("Z") * F.col("n")).alias("z"))
    return rounded(by.where("base <> ''").groupBy("col", "base").agg(F.sum("z").alias("z")), "z", digits=3)


@query
def site_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the sites of each motif by position and base."""
    o = F.when(F.col("strand") == "+", F.col("w")).otherwise(dna.reverse_complement(F.col("w")))
    x = sites(spark, d).select("motif", F.posexplode(F.split(o, "")).alias("col", "base")).where("base <> ''")
    return x.groupBy("motif", "col", "base").agg(F.count("*").alias("n"))


@query
def hamming_per_base(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for m in S.MOTIFS:
        part = discover.hamming_per_base(sites(spark, d).where(F.col("motif") == m.name), m.consensus())
        out = part if out is None else out.unionByName(part)
    return rounded(out, "per_base")


@query
def event_spacings(spark: SparkSession, d: str) -> DataFrame:
    """Spacings of events: kinds as motifs, users as sequences, seconds as positions."""
    e = spark.read.parquet(f"{d}/events.parquet")
    x = e.select(F.col("event_type").alias("motif"), F.lit("A").alias("w"), F.col("user_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("pos"), F.lit("+").alias("strand"), F.lit(1.0).alias("Z"))
    return spacing.histogram(spacing.oriented(spacing.close_pairs(x, 3600), None, 3600).withColumn("distance", F.floor(F.col("distance") / 60)))


@query
def pruned_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that prefix pruning leaves and that pass the threshold: as many as without it."""
    m = S.MOTIFS[0].for_scan()
    words = background.isolated_ll(sequences.word_counts(seqs(spark, d), m.width), model(spark, d), S.ORDER, m.width)
    left = sampling.pruned(words, m, S.LAMBDA, S.THRESHOLD, 4)
    hits = scan._strands(left, m, S.LAMBDA).where(F.col("Z") >= S.THRESHOLD)
    return rounded(hits.select("w", "n", "strand", "Z"), "Z")


@query
def sampled_posterior_sum(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the sum of posteriors from about 2,000 words."""
    m = S.MOTIFS[0].for_scan()
    words = background.isolated_ll(sequences.word_counts(seqs(spark, d), m.width), model(spark, d), S.ORDER, m.width)
    return sampling.sampled_sum(words, m, S.LAMBDA, 2000)


@query
def lasso_discriminate(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.read.parquet(f"{d}/labels.parquet").select(F.col("doc_id").alias("seq"), F.col("quality").cast("double").alias("y")).dropna()
    wide = stats.seq_wide(sites(spark, d), lengths(spark, d), S.NAMES)
    cols = [f"e_{m}" for m in S.NAMES] + ["length"]
    r = discriminate.discriminate(wide.join(labels, "seq"), cols, folds=3, lambdas=(0.1, 0.01, 0.001))
    return one(spark, [("lambda", r["lambda"]), ("auc", r["auc"]), ("intercept", r["intercept"]), *r["weights"]], "name string, value double")


@query
def em_converged(spark: SparkSession, d: str) -> DataFrame:
    """Expectation maximisation on the benchmark's sequences: the matrix after five iterations from a seed."""
    ship(spark)
    s = bench_seqs(spark, d)
    m = background.markov(s, S.ORDER).persist()
    w = background.window_ll(background.base_ll(s, m, S.ORDER), 6)
    placed = sequences.globalise(s).select("seq", "gstart")
    rows = em.prepared(w.join(placed, "seq").withColumn("gpos", F.col("gstart") + F.col("pos")).drop("gstart"))
    r = em.run_em(rows, pssm.from_seed("EM", S.SEED6), 40, rows.count(), most=5)
    out = [(i, b, float(r.motif.probs[i, k])) for i in range(6) for k, b in enumerate("ACGT")]
    return one(spark, out, "col int, base string, p double")


@query
def discover_motif(spark: SparkSession, d: str) -> DataFrame:
    """The best motif of width 6 in the benchmark's sequences, with its instances."""
    found = discover.discover(bench_seqs(spark, d), 1, 10, 20, [6], S.ORDER, per_width=1, iterations=5)
    return found[0]["instances"].select("seq", "pos", "strand", "w", F.round("Z", 6).alias("Z"))


@query
def local_positions(spark: SparkSession, d: str) -> DataFrame:
    """Global positions of the sites, brought back to sequence and offset."""
    placed = kept(spark, d, "placed", lambda: sequences.globalise(seqs(spark, d)).select("seq", "length", "gstart"))
    at = sites(spark, d).join(placed, "seq").select((F.col("gstart") + F.col("pos")).alias("gpos")).distinct()
    return sequences.localise(at, placed)


@query
def cumulative_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    x = background.cumulative_ll(background.base_ll(seqs(spark, d), model(spark, d), S.ORDER))
    return rounded(x.groupBy("seq").agg(F.min("cum_ll").alias("last"), F.avg("cum_ll").alias("mean")), "last", "mean", digits=4)


@query
def spacing_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spacing.likelihoods(spacing.histogram(_spacings(spark, d)), S.DISTANCE), "log_choose", "log_uniform", "log_dirichlet", digits=4)


@query
def site_accuracy(spark: SparkSession, d: str) -> DataFrame:
    m = intervals.merged(sites(spark, d), "motif")
    pick = lambda x: m.where(F.col("motif") == x).select("seq", "start", "end")
    c = intervals.site_confusion(pick("M1"), pick("M3"))
    return rounded(c.crossJoin(intervals.site_accuracy(c)), "sSn", "sPPV", "sASP", digits=9)  # single rows


@query
def report_header(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.header(sites(spark, d), lengths(spark, d)), "bases_per_site")


@query
def motif_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = stats.cluster_motifs(stats.best_by_seq(sites(spark, d)), S.NAMES)
    return rounded(one(spark, found, "left int, right int, distance double, size int"), "distance")


@query
def sequence_clusters(spark: SparkSession, d: str) -> DataFrame:
    """k-means of the sequences by the expected numbers of sites."""
    return stats.cluster_sequences(stats.seq_wide(sites(spark, d), lengths(spark, d), S.NAMES), [f"e_{m}" for m in S.NAMES])


@query
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """All sequences written as FASTA files and read again; numbered in the files' order."""
    at = folder(spark)
    fasta.write(seqs(spark, d).orderBy("seq"), at)
    return fasta.read(spark, at).select("seq", "name", F.length("s").cast("long").alias("length"), F.md5("s").alias("digest"))


@query
def scan_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The scan's sites written as CSV and read again."""
    at = folder(spark)
    scanfiles.write_occurrences(scan.decorate(sites(spark, d), [m.for_scan() for m in S.MOTIFS], freqs(spark, d)), at)
    return scanfiles.read_occurrences(spark, at, False).select("motif", "w", "seq", F.col("pos").cast("long").alias("pos"), "strand", "score")


@query
def lengths_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lengths and names of all sequences written as CSV and read again."""
    at = folder(spark)
    scanfiles.write_lengths(seqs(spark, d), at)
    return scanfiles.read_lengths(spark, at).select("seq", F.col("length").cast("long").alias("length"), "name")
