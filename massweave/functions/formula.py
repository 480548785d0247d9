"""Molecular formulas as MAP<STRING,INT> columns: parsing, masses, ratios, indices, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from massweave.functions.chem import ATOM_ORDER, ELECTRON, ELEMENT, ISOTOPES, MONO, VALENCE


def parse(text: Column) -> Column:
    """``"C10 H20 13C1"`` to atom counts; null where the text isn't atoms with counts, space between them."""
    fine = text.rlike(r"^\s*(\d*[A-Z][a-z]?\d+)(\s+\d*[A-Z][a-z]?\d+)*\s*$")
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    entry = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"^(\d*[A-Z][a-z]?)\d+$", 1).alias("k"), F.regexp_extract(x, r"(\d+)$", 1).cast("int").alias("v")))
    return F.when(fine, F.map_from_entries(F.filter(entry, lambda e: e["v"] > 0)))


def count(atoms: Column, *labels: str) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(atoms[label], F.lit(0)) for label in labels])


def element(atoms: Column, name: str) -> Column:
    """Atoms of an element, all isotopes together."""
    return count(atoms, *[label for label, _, _ in ISOTOPES[name]])


def neutral_mass(atoms: Column) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.coalesce(atoms[k], F.lit(0)) * F.lit(m) for k, m in MONO.items()]), 9)


def mz(mass: Column, charge: Column, ion_type: Column, adduct_mass: Column | None = None) -> Column:
    """m/z by ion type: ``radical``, ``protonated`` or ``adduct``; the adduct's mass is added to the neutral's."""
    extra = F.when(ion_type == "protonated", charge * MONO["H"]).when(ion_type == "adduct", adduct_mass if adduct_mass is not None else F.lit(None)).otherwise(F.lit(0.0))
    return (mass + extra - charge * ELECTRON) / F.abs(charge)


def text(atoms: Column) -> Column:
    """Atoms in the common order, then their isotopes."""
    labels = [label for name in ATOM_ORDER for label, _, _ in ISOTOPES[name]]
    main = [x for x in labels if x in ATOM_ORDER] + [x for x in labels if x not in ATOM_ORDER]
    return F.concat_ws(" ", *[F.when(F.coalesce(atoms[x], F.lit(0)) > 0, F.concat(F.lit(x), atoms[x].cast("string"))) for x in main])


def class_label(atoms: Column, ion_type: Column) -> Column:
    """Heteroatoms and counts; ``HC`` without any; radicals are marked."""
    hetero = [x for x in ATOM_ORDER if x not in ("C", "H")]
    label = F.concat_ws(" ", *[F.when(element(atoms, x) > 0, F.concat(F.lit(x), element(atoms, x).cast("string"))) for x in hetero])
    return F.concat(F.when(label == "", "HC").otherwise(label), F.when(ion_type == "radical", " -R").otherwise(""))


def ratio(atoms: Column, top: str, bottom: str) -> Column:
    return F.try_divide(element(atoms, top).cast("double"), element(atoms, bottom))


def dbe(atoms: Column) -> Column:
    """Rings and double bonds: 1 + half the sum of (valence - 2)."""
    return 1 + reduce(lambda a, b: a + b, [element(atoms, x) * F.lit((v - 2) / 2) for x, v in VALENCE.items()])


def nosc(atoms: Column) -> Column:
    """Nominal oxidation state of carbon; null without carbon."""
    c, h, n, o, p, s = (element(atoms, x) for x in "CHNOPS")
    return 4 - F.try_divide((4 * c + h - 3 * n - 2 * o + 5 * p - 2 * s).cast("double"), c)


def aromaticity(atoms: Column, modified: bool = False) -> Column:
    """Aromaticity index, within 0 and 1: all oxygen counts as double bonded, or half of it if modified."""
    c, h, n, o, p, s = (element(atoms, x) for x in "CHNOPS")
    oxygen = o * 0.5 if modified else o
    value = F.try_divide(1 + c - oxygen - s - 0.5 * (h + n + p), c - oxygen - n - s - p)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def kendrick(mass: Column, base: dict[str, int] | None = None, rounding: str = "floor") -> tuple[Column, Column, Column]:
    """Kendrick mass, defect and nominal mass for a repeating unit."""
    unit = sum(MONO[k] * n for k, n in (base or {"C": 1, "H": 2}).items())
    km = mass * (int(unit) / unit)
    nominal = {"floor": F.floor, "ceil": F.ceil, "round": F.rint}[rounding](km)
    return km, nominal - km, nominal


def ppm(observed: Column, calculated: Column, factor: float = 1e6) -> Column:
    return (observed - calculated) / calculated * factor


def mz_score(error: Column, std: float = 1.66, mean: float = 0.0) -> Column:
    """Likeness of a mass error under a normal spread, 1 at the mean."""
    return F.exp(-((error - mean) * (error - mean)) / (2 * std * std))


def confidence(mz_part: Column, isotopologue_part: Column, mz_weight: float = 0.6, isotopologue_weight: float = 0.4) -> Column:
    return mz_weight * mz_part + isotopologue_weight * isotopologue_part


def elements() -> list[str]:
    return sorted(set(ELEMENT.values()))


def subtracted(atoms: Column, other: Column) -> Column:
    """Atoms left after another formula's are taken off; none where nothing is left of an element."""
    return F.map_filter(F.transform_values(atoms, lambda k, n: n - F.coalesce(other[k], F.lit(0))), lambda _, n: n > 0)


def class_atoms(atoms: Column) -> Column:
    """The atoms that make a heteroatom class: all but carbon and hydrogen."""
    return F.map_filter(atoms, lambda k, n: ~k.isin("C", "H") & (n > 0))


def normalised_distance(distance: Column, low: float, high: float) -> Column:
    """The distance's place between its least and largest value, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - low) / (high - low)))


def error_percent(observed: Column, calculated: Column) -> Column:
    """Of an isotopologue's abundance or area: by how many percent it misses what was calculated."""
    return (observed - calculated) / calculated * 100
