"""Motif files in MEME text form, and other motif formats."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.pssm import BASES, Motif


def parse(text: str) -> dict:
    """version, alphabet, strands, background and motifs."""
    text = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#"))
    one = lambda p: (m.group(1).strip() if (m := re.search(p, text, re.M | re.I)) else None)
    freqs = re.search(r"^Background letter frequencies[^\n]*\n((?:\s*[A-Z]\s+[\d.eE+-]+)+)", text, re.M)
    background = [float(x) for _, x in sorted(re.findall(r"([A-Z])\s+([\d.eE+-]+)", freqs.group(1)))] if freqs else None
    motifs = []
    for part in re.split(r"^MOTIF\s+", text, flags=re.M)[1:]:
        head = part.split("\n", 1)[0].split()
        m = Motif(head[0], np.zeros((0, 4)), altname=head[1] if len(head) > 1 else None)
        for kind in ("letter-probability matrix", "log-odds matrix"):
            x = re.search(rf"^{kind}:([^\n]*)\n((?:[ \t]*[-+\d.eEinfINF]+(?:[ \t]+[-+\d.eEinfINF]+)*[ \t]*(?:\n|$))+)", part, re.M)
            if not x:
                continue
            values = np.array([[float(v) for v in row.split()] for row in x.group(2).strip().splitlines()])
            info = dict(re.findall(r"(\w+)=\s*(\S+)", x.group(1)))
            if kind[0] == "l" and kind[1] == "e":
                m.probs = values
                m.nsites = int(float(info.get("nsites", 20)))
                m.evalue = float(info["E"]) if "E" in info else None
            else:
                m.log_odds = values
        url = re.search(r"^URL\s+(\S+)", part, re.M)
        m.url = url.group(1) if url else None
        motifs.append(m)
    return {"version": one(r"^MEME version\s+(\S+)"), "alphabet": one(r"^ALPHABET\s*=\s*(\S+)"), "strands": (one(r"^strands:\s*(.*)$") or "").split(), "background": background, "motifs": motifs}


def read(spark: SparkSession, path: str) -> dict:
    """Parses a motif file (small: one text row)."""
    return parse(spark.read.text(path, wholetext=True).first()[0])


def render(motifs: list[Motif], background: list[float] | None = None, version: str = "4") -> str:
    """MEME minimal text."""
    out = [f"MEME version {version}", "", "ALPHABET= ACGT", "", "strands: + -", ""]
    if background is not None:
        out += ["Background letter frequencies", " ".join(f"{b} {f:.6f}" for b, f in zip(BASES, background, strict=True)), ""]
    for m in motifs:
        e = "" if m.evalue is None else f" E= {m.evalue:.3g}" if not math.isinf(m.evalue) else " E= inf"
        out += [f"MOTIF {m.name}" + (f" {m.altname}" if m.altname else ""), "", f"letter-probability matrix: alength= 4 w= {m.width} nsites= {m.nsites}{e}"]
        out += [" ".join(f"{x:.6f}" for x in row) for row in m.probs]
        out += [*([f"URL {m.url}"] if m.url else []), ""]
    return "\n".join(out) + "\n"


def write(spark: SparkSession, motifs: list[Motif], path: str, background: list[float] | None = None) -> None:
    spark.createDataFrame([(render(motifs, background),)], "value string").coalesce(1).write.text(path)


def background_file(freqs: list[float]) -> str:
    return "# order 0\n" + "".join(f"{b} {f:.3e}\n" for b, f in zip(BASES, freqs, strict=True))


def clover(motifs: list[Motif]) -> str:
    """Counts of sites, a matrix after each name."""
    return "".join(f">{m.name}\n" + "".join(" ".join(str(int(round(x))) for x in row) + "\n" for row in m.probs * m.nsites) for m in motifs)


def simplified(m: Motif) -> list[str]:
    """A row for each base: ten times the probability, ':' for 0 and 'a' for 10."""
    sign = lambda p: ":" if round(p * 10) == 0 else "a" if round(p * 10) >= 10 else str(round(p * 10))
    return [f"{b} " + "".join(sign(p) for p in m.probs[:, i]) for i, b in enumerate(BASES)]


def report(motifs: list[tuple[Motif, list[dict]]], n_seqs: int, n_bases: int) -> str:
    """A text report: matrices and sites with flanks (site dicts: name, pos, strand, Z, left, site, right)."""
    out = [f"{n_seqs} sequences, {n_bases} bases", ""]
    for m, sites in motifs:
        out += [f"MOTIF {m.name} width = {m.width} sites = {len(sites)}" + (f" E-value = {m.evalue:.3g}" if m.evalue is not None else ""), "", "Simplified matrix", *simplified(m), "", "Sites by posterior"]
        out += [f"{s['name']} {s['strand']} {s['pos'] + 1} {s['Z']:.6f} {s['left']} {s['site']} {s['right']}" for s in sorted(sites, key=lambda s: -s["Z"])]
        out += ["", "Position-specific probability matrix", *[" ".join(f"{x:.6f}" for x in row) for row in m.probs], ""]
    return "\n".join(out) + "\n"


def renamed(motifs: list[Motif], pattern: str = "{name}", pseudo: float = 0.0) -> list[Motif]:
    """New names from name, idx and alt; pseudo-counts added if asked."""
    out = []
    for i, m in enumerate(motifs):
        n = m.with_pseudo(pseudo) if pseudo else m
        out.append(Motif(pattern.format(name=m.name, idx=i, alt=m.altname or ""), n.probs, m.nsites, m.evalue, m.altname, m.url))
    return out


def table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """(motif, altname, w, nsites, evalue, url, probs)."""
    rows = [(m.name, m.altname, m.width, m.nsites, m.evalue, m.url, m.probs.tolist()) for m in motifs]
    return spark.createDataFrame(rows, "motif string, altname string, w int, nsites int, evalue double, url string, probs array<array<double>>")
