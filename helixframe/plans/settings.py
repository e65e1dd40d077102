"""Fixed inputs of the registered queries: motifs, background order, thresholds, seeds."""

from __future__ import annotations

import numpy as np

from ..operators.pssm import Motif

ORDER = 2
WIDTH = 8
LAMBDA, THRESHOLD = 0.001, 0.3
DISTANCE = 30
SEED6 = "TTAGCA"
OFFSETS = [-40, -24, -16, -12, -9, 9, 12, 16, 24, 40]


def _motif(name: str, consensus: str, strong: list[float]) -> Motif:
    return Motif(name, np.array([[p if b == c else round((1 - p) / 3, 6) for b in "ACGT"] for c, p in zip(consensus, strong, strict=True)]), 20)


MOTIFS = [
    _motif("M1", "TTAGCTAC", [0.94, 0.91, 0.88, 0.91, 0.94, 0.91, 0.88, 0.85]),
    _motif("M2", "ACTTTACG", [0.91, 0.94, 0.91, 0.88, 0.94, 0.91, 0.85, 0.88]),
    _motif("M3", "TAGCACTT", [0.91, 0.91, 0.94, 0.94, 0.88, 0.91, 0.85, 0.91]),
]
NAMES = [m.name for m in MOTIFS]
EVIDENCE_AT_LEAST = 1.0
#: (primary, secondary, same_strand, upstream, distance)
DEFINITIONS = [("M1", "M2", True, False, 4), ("M2", "M3", True, False, 8), ("M3", "M1", True, True, 3), ("M1", "M3", True, False, 10), ("M1", "M1", True, False, 5), ("M3", "M3", True, False, 12)]
EVERY = 7
EM_LAMBDA = 0.01
