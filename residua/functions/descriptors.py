"""Sequence descriptors as native column expressions: one narrow projection, no shuffle.

Work is layered so that nothing is computed twice: residue counts first, then the sums that several
descriptors share, then everything that is arithmetic on them. Hydrophobic moment, instability index and isoelectric point come from Arrow
functions (see `ordered`).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from residua.functions import constants as K
from residua.functions.ordered import (
    hydrophobic_moment,
    instability_index,
    isoelectric_point,
    pair_frequencies,
)
from residua.functions.sequences import clean_sequence, has_residues

BASE_DESCRIPTORS = (
    "Length", "MolecularWeight", "Aromaticity", "Hydrophobicity_KD", "NetCharge_pH7",
    "IsoelectricPoint", "InstabilityIndex", "Gravy", "AliphaticIndex", "BomanIndex",
    "ShannonEntropy", "ChargeDensity", "HydrophobicMoment100", "HelixFraction", "TurnFraction",
    "SheetFraction", "HelixPropensityAvg", "SheetPropensityAvg", "ExtCoeffReduced",
    "ExtCoeffOxidized",
)
COMPOSITION = tuple(f"AAC_{aa}" for aa in K.ALPHABET)
ELEMENTAL = tuple(f"Elem_{e}" for e in K.ELEMENTS) + tuple(f"Elem_{e}_fraction" for e in "CNOS")
MOTIF = tuple(f"Motif_{m}" for m in K.MOTIFS)
DIPEPTIDES = tuple(a + b for a in K.ALPHABET for b in K.ALPHABET)
DESCRIPTOR_PREFIXES = ("AAC_", "DPC_", "Motif_", "Elem_", "3D_")


@dataclass(frozen=True)
class DescriptorConfig:
    include_dipeptide: bool = False
    include_fingerprints: bool = True
    include_elemental: bool = True


def descriptor_names(config: DescriptorConfig = DescriptorConfig()) -> list[str]:
    names = list(BASE_DESCRIPTORS) + list(COMPOSITION) + list(K.RESIDUE_CLASSES)
    if config.include_elemental:
        names += ELEMENTAL
    if config.include_fingerprints:
        names += MOTIF
    if config.include_dipeptide:
        names += [f"DPC_{pair}" for pair in DIPEPTIDES]
    return names


def _total(terms: list[Column]) -> Column:
    return reduce(add, terms)


class CountedSequence:
    """Expressions over a table that holds a cleaned sequence and its residue counts."""

    def __init__(self, sequence: str, prefix: str) -> None:
        self.sequence = F.col(sequence)
        self.prefix = prefix
        self.length = F.length(self.sequence)

    def count_columns(self) -> dict[str, Column]:
        return {
            self.prefix + aa: self.length - F.length(F.replace(self.sequence, F.lit(aa), F.lit("")))
            for aa in K.ALPHABET
        }

    def count(self, letters: str) -> Column:
        return _total([F.col(self.prefix + aa) for aa in letters])

    def fraction(self, letters: str) -> Column:
        return self.count(letters) / F.greatest(self.length, F.lit(1))

    def weighted(self, scale: dict[str, float]) -> Column:
        """Scale summed over the residues.

        Whole-number scales are written as the commonest value plus the differences, which is exact
        and shorter; others term by term, since a rounding error could move a value over a limit.
        """
        values = [scale[aa] for aa in K.ALPHABET]
        if not all(v == int(v) for v in values):
            return _total([F.col(self.prefix + aa) * F.lit(v) for aa, v in zip(K.ALPHABET, values)])
        base = max(values, key=values.count)
        terms = [F.col(self.prefix + aa) * F.lit(v - base) for aa, v in zip(K.ALPHABET, values) if v != base]
        return _total([self.length * F.lit(base), *terms])

    def totals(self) -> dict[str, Column]:
        """Sums that several descriptors share; a layer of their own, so each is computed once."""
        n_pk, c_pk = self.terminal_pk()
        water = {"H": 2.0, "O": 1.0}
        columns = {f"__t_{e}": self.weighted(K.SCALES[e]) + F.lit(water.get(e, 0.0)) for e in K.ELEMENTS}
        atoms = {aa: sum(K.SCALES[e][aa] for e in K.ELEMENTS) for aa in K.ALPHABET}
        columns["__t_atoms"] = self.weighted(atoms) + F.lit(sum(water.values()))
        columns["__t_kd"] = self.weighted(K.SCALES["kd"])
        columns["__charge"] = self.charge(F.lit(10.0**7), F.pow(F.lit(10.0), n_pk), F.pow(F.lit(10.0), c_pk))
        return columns

    def mean_of(self, name: str) -> Column:
        return (F.col("__t_kd") if name == "kd" else self.weighted(K.SCALES[name])) / self.length

    def entropy(self) -> Column:
        shares = [F.col(self.prefix + aa) / self.length for aa in K.ALPHABET]
        return _total([F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares])

    def terminal_pk(self) -> tuple[Column, Column]:
        def lookup(letter: Column, table: dict[str, float], default: float) -> Column:
            branches = F.lit(default)
            for aa, value in table.items():
                branches = F.when(letter == aa, F.lit(value)).otherwise(branches)
            return branches

        first = F.substring(self.sequence, 1, 1)
        last = F.substring(self.sequence, -1, 1)
        return (
            lookup(first, K.N_TERMINUS_PK_BY_RESIDUE, K.N_TERMINUS_PK),
            lookup(last, K.C_TERMINUS_PK_BY_RESIDUE, K.C_TERMINUS_PK),
        )

    def charge(self, proton: Column, n_term: Column, c_term: Column) -> Column:
        """Net charge; `proton` is 10**pH and the terms are 10**pK, so one power serves all groups."""
        positive = [n_term / (n_term + proton)] + [
            F.col(self.prefix + aa) * (10.0**pk / (F.lit(10.0**pk) + proton)) for aa, pk in K.POSITIVE_PK.items()
        ]
        negative = [proton / (proton + c_term)] + [
            F.col(self.prefix + aa) * (proton / (proton + F.lit(10.0**pk))) for aa, pk in K.NEGATIVE_PK.items()
        ]
        return _total(positive) - _total(negative)

    def elemental(self) -> dict[str, Column]:
        columns = {f"Elem_{e}": F.col(f"__t_{e}") for e in K.ELEMENTS}
        columns |= {f"Elem_{e}_fraction": F.col(f"__t_{e}") / F.col("__t_atoms") for e in "CNOS"}
        return columns

    def motifs(self) -> dict[str, Column]:
        return {f"Motif_{m}": motif_frequency(self.sequence, m) for m in K.MOTIFS}


def motif_frequency(sequence: Column, motif: str) -> Column:
    """Non-overlapping occurrences per adjacent pair."""
    pairs = F.length(sequence) - 1
    hits = (F.length(sequence) - F.length(F.replace(sequence, F.lit(motif), F.lit("")))) / len(motif)
    return F.when(pairs > 0, hits / pairs).otherwise(0.0)


def adjacent_pairs(sequence: Column) -> Column:
    """Overlapping pairs as an array, empty below two residues."""
    return F.regexp_extract_all(sequence, F.lit("(?=(..))"), F.lit(1))


def core_columns(counted: CountedSequence) -> dict[str, Column]:
    """Descriptors that are arithmetic on length, counts and terminal residues."""
    length, count = counted.length, counted.count
    charge = F.col("__charge")
    reduced = count("W") * 5500.0 + count("Y") * 1490.0
    columns = {
        "Length": length,
        "MolecularWeight": counted.weighted(K.SCALES["mass"]) - (length - 1) * F.lit(K.WATER_MASS),
        "Aromaticity": counted.fraction("FWY"),
        "Hydrophobicity_KD": counted.mean_of("kd"),
        "NetCharge_pH7": charge,
        "IsoelectricPoint": isoelectric_point(counted.sequence),
        "InstabilityIndex": instability_index(counted.sequence),
        "Gravy": counted.mean_of("kd"),
        "AliphaticIndex": (count("A") + count("V") * 2.9 + count("IL") * 3.9) * 100.0 / length,
        "BomanIndex": counted.mean_of("boman"),
        "ShannonEntropy": counted.entropy(),
        "ChargeDensity": charge / F.greatest(length, F.lit(1)),
        "HydrophobicMoment100": hydrophobic_moment(counted.sequence),
    }
    columns |= {name: counted.fraction(letters) for name, letters in K.STRUCTURE_SETS.items()}
    columns |= {
        "HelixPropensityAvg": counted.mean_of("helix"),
        "SheetPropensityAvg": counted.mean_of("sheet"),
        "ExtCoeffReduced": reduced,
        "ExtCoeffOxidized": reduced + F.floor(count("C") / 2) * 125.0,
    }
    columns |= {f"AAC_{aa}": counted.fraction(aa) for aa in K.ALPHABET}
    columns |= {name: counted.fraction(letters) for name, letters in K.RESIDUE_CLASSES.items()}
    return columns


def with_descriptors(
    df: DataFrame,
    sequence_col: str = "Sequence",
    config: DescriptorConfig = DescriptorConfig(),
    only: list[str] | None = None,
) -> DataFrame:
    """Input columns, the cleaned sequence and the descriptors of every non-empty sequence.

    An input column that has the name of a descriptor is replaced. `only` names the descriptors to
    compute, otherwise the configured set; expressions that nobody selects later are pruned.
    """
    wanted = list(only) if only is not None else descriptor_names(config)
    kept = [c for c in df.columns if c not in wanted and c not in (sequence_col, "Sequence")]
    counted = CountedSequence("Sequence", "__n_")
    raw = F.col(f"`{sequence_col}`")
    cleaned = df.filter(has_residues(raw)).select(
        *[F.col(f"`{c}`") for c in kept], clean_sequence(raw).alias("Sequence")
    )
    available = core_columns(counted) | counted.elemental() | counted.motifs()
    if any(name.startswith("DPC_") for name in wanted):
        available |= {f"DPC_{pair}": F.get(F.col("__pairs"), F.lit(i)) for i, pair in enumerate(DIPEPTIDES)}
        cleaned = cleaned.withColumn("__pairs", pair_frequencies(F.col("Sequence")))
    counts = cleaned.select("*", *[expr.alias(name) for name, expr in counted.count_columns().items()])
    totals = counts.select("*", *[expr.alias(name) for name, expr in counted.totals().items()])
    return totals.select(
        *[F.col(f"`{c}`") for c in kept], "Sequence", *[available[name].alias(name) for name in wanted]
    )


def dipeptides_long(df: DataFrame, id_cols: list[str], sequence_col: str = "Sequence") -> DataFrame:
    """One row per (row, pair present): occurrences and frequency. Counted in the row, no shuffle."""
    cleaned = df.select(*id_cols, clean_sequence(F.col(sequence_col)).alias("__s")).filter(F.length("__s") >= 2)
    exploded = cleaned.select(
        *id_cols, "__s", F.explode(F.array_distinct(adjacent_pairs(F.col("__s")))).alias("Dipeptide")
    ).filter(F.col("Dipeptide").rlike(f"^[{K.ALPHABET}]{{2}}$"))
    count = F.regexp_count(F.col("__s"), F.concat(F.lit("(?="), F.col("Dipeptide"), F.lit(")")))
    return exploded.select(*id_cols, "Dipeptide", count.cast("bigint").alias("Count"), F.col("__s")).select(
        *id_cols, "Dipeptide", "Count", (F.col("Count") / (F.length("__s") - 1)).alias("Frequency")
    )


def descriptor_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are descriptors by name."""
    known = set(BASE_DESCRIPTORS) | set(K.RESIDUE_CLASSES)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    return [
        name
        for name, dtype in df.dtypes
        if (dtype in numeric or dtype.startswith("decimal"))
        and (name in known or name.startswith(DESCRIPTOR_PREFIXES))
    ]
