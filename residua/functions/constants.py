"""Residue scales and rule tables shared by every operator.

Fixed values: all tables in this module are published scales or domain rules whose numbers must
stay as they are for results to be right.
"""

from __future__ import annotations

ALPHABET = "ACDEFGHIKLMNPQRSTVWY"

# Fixed values, one line per residue: Kyte-Doolittle hydropathy, Boman-type potential, Chou-Fasman
# helix and sheet propensity, atoms of the residue inside a chain, average mass of the free residue.
_RESIDUE_TABLE = """
aa  kd    boman  helix  sheet  C   H   N  O  S  mass
A   1.8   0.17   1.45   0.97   3   5   1  1  0  89.0932
C   2.5   0.24   0.77   1.30   3   5   1  1  1  121.1582
D  -3.5  -1.23   1.01   0.54   4   5   1  3  0  133.1027
E  -3.5  -2.02   1.51   0.37   5   7   1  3  0  147.1293
F   2.8   1.13   1.13   1.38   9   9   1  1  0  165.1891
G  -0.4   0.01   0.53   0.81   2   3   1  1  0  75.0666
H  -3.2  -0.96   1.00   0.87   6   7   3  1  0  155.1546
I   4.5   0.31   1.08   1.60   6   11  1  1  0  131.1729
K  -3.9  -0.99   1.16   0.74   6   12  2  1  0  146.1876
L   3.8   0.56   1.21   1.30   6   11  1  1  0  131.1729
M   1.9   0.23   1.45   1.05   5   9   1  1  1  149.2113
N  -3.5  -0.42   0.67   0.89   4   6   2  2  0  132.1179
P  -1.6  -0.45   0.59   0.62   5   7   1  1  0  115.1305
Q  -3.5  -0.58   1.11   1.10   5   8   2  2  0  146.1445
R  -4.5  -0.81   0.98   0.90   6   12  4  1  0  174.2010
S  -0.8  -0.13   0.79   0.72   3   5   1  2  0  105.0926
T  -0.7  -0.14   0.82   1.20   4   7   1  2  0  119.1192
V   4.2   0.07   1.06   1.70   5   9   1  1  0  117.1463
W  -0.9   1.85   1.08   1.37   11  10  2  1  0  204.2252
Y  -1.3   0.94   0.69   1.47   9   9   1  2  0  181.1885
"""


def _columns(table: str) -> dict[str, dict[str, float]]:
    header, *rows = [line.split() for line in table.strip().splitlines()]
    return {
        name: {row[0]: float(row[position]) for row in rows}
        for position, name in enumerate(header)
        if position
    }


SCALES = _columns(_RESIDUE_TABLE)
ELEMENTS = ("C", "H", "N", "O", "S")
WATER_MASS = 18.0153

# Residue classes (a residue may be in several).
RESIDUE_CLASSES = {
    "positive_frac": "KRH",
    "negative_frac": "DE",
    "polar_uncharged_frac": "STNQCY",
    "hydrophobic_frac": "AILMFWVPG",
    "aromatic_frac": "FYW",
    "small_frac": "AGSTP",
}

# Two-residue motifs.
MOTIFS = ("KK", "RR", "KR", "RK", "GG", "PP", "FW", "WF", "HP", "PH")

# Residue sets of the helix, turn and sheet fractions.
STRUCTURE_SETS = {"HelixFraction": "EMALK", "TurnFraction": "NPGSD", "SheetFraction": "VIYFWLT"}

# Fixed values (Bjellqvist scale): side-chain and terminal pK values.
POSITIVE_PK = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE_PK = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINUS_PK = 7.5
N_TERMINUS_PK_BY_RESIDUE = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_TERMINUS_PK = 3.55
C_TERMINUS_PK_BY_RESIDUE = {"D": 4.55, "E": 4.75}

# Search interval and tolerance of the isoelectric point.
PI_LOW, PI_HIGH, PI_START, PI_STEPS = 4.05, 12.0, 7.775, 17

# Fixed values (Guruprasad 1990): instability weight of a residue pair. Every pair not listed
# weighs 1.0. One line per first residue, then second residue and weight.
_INSTABILITY = """
A: C 44.94 D -7.49 H -7.49 P 20.26
C: D 20.26 H 33.60 M 33.60 L 20.26 Q -6.54 P 20.26 T 33.60 W 24.68 V -6.54
D: F -6.54 K -7.49 S 20.26 R -6.54 T -14.03
E: C 44.94 E 33.60 D 20.26 I 20.26 H -6.54 Q 20.26 P 20.26 S 20.26 W -14.03
F: D 13.34 K -14.03 P 20.26 Y 33.601
G: A -7.49 E -6.54 G 13.34 I -7.49 K -7.49 N -7.49 T -7.49 W 13.34 Y -7.49
H: G -9.37 F -9.37 I 44.94 K 24.68 N 24.68 P -1.88 T -6.54 W -1.88 Y 44.94
I: E 44.94 H 13.34 K -7.49 L 20.26 P -1.88 V -7.49
K: G -7.49 I -7.49 M 33.60 L -7.49 Q 24.64 P -6.54 R 33.60 V -7.49
L: K -7.49 Q 33.60 P 20.26 R 20.26 W 24.68
M: A 13.34 H 58.28 M -1.88 Q -6.54 P 44.94 S 44.94 R -6.54 T -1.88 Y 24.68
N: C -1.88 G -14.03 F -14.03 I 44.94 K 24.68 Q -6.54 P -1.88 T -7.49 W -9.37
P: A 20.26 C -6.54 E 18.38 D -6.54 F 20.26 M -6.54 Q 20.26 P 20.26 S 20.26 R -6.54 W -1.88 V 20.26
Q: C -6.54 E 20.26 D 20.26 F -6.54 Q 20.26 P 20.26 S 44.94 V -6.54 Y -6.54
R: G -7.49 H 20.26 N 13.34 Q 20.26 P 20.26 S 44.94 R 58.28 W 58.28 Y -6.54
S: C 33.60 E 20.26 Q 20.26 P 44.94 S 20.26 R 20.26
T: E 20.26 G -7.49 F 13.34 N -14.03 Q -6.54 W -14.03
V: D -14.03 G -7.49 K -1.88 P 20.26 T -7.49 Y -6.54
W: A -14.03 G -9.37 H 24.68 M 24.68 L 13.34 N 13.34 T -14.03 V -7.49
Y: A 24.68 E -6.54 D 24.68 G -7.49 H 13.34 M 44.94 P 13.34 R -15.91 T -7.49 W -9.37 Y 13.34
"""


def instability_exceptions() -> dict[str, float]:
    """Pair -> weight for the pairs that do not weigh 1.0."""
    weights: dict[str, float] = {}
    for line in _INSTABILITY.strip().splitlines():
        first, rest = line.split(":")
        fields = rest.split()
        for second, weight in zip(fields[::2], fields[1::2]):
            weights[first + second] = float(weight)
    return weights


# Default screening windows.
DEFAULT_CRITERIA = {
    "Length": (6.0, 40.0),
    "NetCharge_pH7": (-1.0, 10.0),
    "Gravy": (-2.5, 1.5),
    "InstabilityIndex": (0.0, 40.0),
    "BomanIndex": (-3.0, 3.0),
    "Aromaticity": (0.0, 0.40),
    "HydrophobicMoment100": (0.10, 3.50),
    "HelixFraction": (0.10, 1.00),
}

# Assessment labels by lowest score.
ASSESSMENTS = ((85.0, "Excellent"), (70.0, "Good"), (50.0, "Moderate"))
LOWEST_ASSESSMENT = "Needs Optimization"
UNCOVERED_ASSESSMENT = "Insufficient descriptor coverage"

# Descriptors reported by the design profile, in report order.
PROFILE_DESCRIPTORS = (
    "Length", "MolecularWeight", "Gravy", "Hydrophobicity_KD", "NetCharge_pH7", "ChargeDensity",
    "IsoelectricPoint", "AliphaticIndex", "BomanIndex", "HydrophobicMoment100", "HelixFraction",
    "SheetFraction", "InstabilityIndex",
)

# Names a sequence column may have, in order of preference.
SEQUENCE_COLUMN_NAMES = (
    "sequence", "peptide", "peptide_sequence", "peptidesequence", "seq", "aa_sequence",
    "aasequence", "aminoacidsequence", "amino_acid_sequence",
)

# Substrings that mark a target column.
TARGET_COLUMN_HINTS = (
    "activity", "ic50", "mic", "toxicity", "solubility", "bindingscore", "docking",
    "docking_score", "dockingscore", "vina", "affinity", "property", "target",
)

# Name parts of lower-is-better targets, one list for scoring, one for design.
SCORING_MINIMIZE_HINTS = (
    "ic50", "ec50", "ki", "kd", "mic", "docking", "vina", "bindingscore", "bindingenergy", "deltag",
)
DESIGN_MINIMIZE_HINTS = ("ic50", "mic", "ec50", "ki", "kd", "docking", "vina", "affinity")
