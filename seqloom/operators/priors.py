"""Dirichlet priors of emissions and transitions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Published mixtures for match emissions (weights, then a component per line, residues in
# alphabetical order), insert emissions, and transitions mm mi md, im ii, dm dd.
AMINO_WEIGHTS = (0.178091, 0.056591, 0.0960191, 0.0781233, 0.0834977, 0.0904123, 0.114468, 0.0682132, 0.234585)
AMINO_MATCH = (
    (0.270671, 0.039848, 0.017576, 0.016415, 0.014268, 0.131916, 0.012391, 0.022599, 0.020358, 0.030727, 0.015315, 0.048298, 0.053803, 0.020662, 0.023612, 0.216147, 0.147226, 0.065438, 0.003758, 0.009621),
    (0.021465, 0.010300, 0.011741, 0.010883, 0.385651, 0.016416, 0.076196, 0.035329, 0.013921, 0.093517, 0.022034, 0.028593, 0.013086, 0.023011, 0.018866, 0.029156, 0.018153, 0.036100, 0.071770, 0.419641),
    (0.561459, 0.045448, 0.438366, 0.764167, 0.087364, 0.259114, 0.214940, 0.145928, 0.762204, 0.247320, 0.118662, 0.441564, 0.174822, 0.530840, 0.465529, 0.583402, 0.445586, 0.227050, 0.029510, 0.121090),
    (0.070143, 0.011140, 0.019479, 0.094657, 0.013162, 0.048038, 0.077000, 0.032939, 0.576639, 0.072293, 0.028240, 0.080372, 0.037661, 0.185037, 0.506783, 0.073732, 0.071587, 0.042532, 0.011254, 0.028723),
    (0.041103, 0.014794, 0.005610, 0.010216, 0.153602, 0.007797, 0.007175, 0.299635, 0.010849, 0.999446, 0.210189, 0.006127, 0.013021, 0.019798, 0.014509, 0.012049, 0.035799, 0.180085, 0.012744, 0.026466),
    (0.115607, 0.037381, 0.012414, 0.018179, 0.051778, 0.017255, 0.004911, 0.796882, 0.017074, 0.285858, 0.075811, 0.014548, 0.015092, 0.011382, 0.012696, 0.027535, 0.088333, 0.944340, 0.004373, 0.016741),
    (0.093461, 0.004737, 0.387252, 0.347841, 0.010822, 0.105877, 0.049776, 0.014963, 0.094276, 0.027761, 0.010040, 0.187869, 0.050018, 0.110039, 0.038668, 0.119471, 0.065802, 0.025430, 0.003215, 0.018742),
    (0.452171, 0.114613, 0.062460, 0.115702, 0.284246, 0.140204, 0.100358, 0.550230, 0.143995, 0.700649, 0.276580, 0.118569, 0.097470, 0.126673, 0.143634, 0.278983, 0.358482, 0.661750, 0.061533, 0.199373),
    (0.005193, 0.004039, 0.006722, 0.006121, 0.003468, 0.016931, 0.003647, 0.002184, 0.005019, 0.005990, 0.001473, 0.004158, 0.009055, 0.003630, 0.006583, 0.003172, 0.003690, 0.002967, 0.002772, 0.002686),
)
AMINO_INSERT = (681, 120, 623, 651, 313, 902, 241, 371, 687, 676, 143, 548, 647, 415, 551, 926, 623, 505, 102, 269)
AMINO_MOVES = ((0.7939, 0.0278, 0.0135), (0.1551, 0.1331), (0.9002, 0.5630))
DNA_WEIGHTS = (0.24, 0.26, 0.08, 0.42)
DNA_MATCH = ((0.16, 0.45, 0.12, 0.39), (0.09, 0.03, 0.09, 0.04), (1.29, 0.40, 6.58, 0.51), (1.74, 1.49, 1.57, 1.95))
DNA_INSERT = (1, 1, 1, 1)
DNA_MOVES = ((2.0, 0.1, 0.1), (0.12, 0.4), (0.5, 1.0))


@dataclass(frozen=True)
class Prior:
    weights: np.ndarray
    match: np.ndarray  # components x letters
    insert: np.ndarray
    moves: tuple[np.ndarray, np.ndarray, np.ndarray]  # out of match, insert and delete states


def _prior(weights, match, insert, moves) -> Prior:
    return Prior(np.array(weights) / sum(weights), np.array(match, float), np.array(insert, float), tuple(np.array(x, float) for x in moves))


def prior(alphabet: str) -> Prior:
    if alphabet == "amino":
        return _prior(AMINO_WEIGHTS, AMINO_MATCH, AMINO_INSERT, AMINO_MOVES)
    return _prior(DNA_WEIGHTS, DNA_MATCH, DNA_INSERT, DNA_MOVES)


def laplace(letters: int) -> Prior:
    """One added to every count."""
    return _prior((1.0,), np.ones((1, letters)), np.ones(letters), (np.ones(3), np.ones(2), np.ones(2)))
