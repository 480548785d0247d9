"""Physical constants of the common elements."""

from __future__ import annotations

# Masses in unified atomic mass units and natural abundances of isotopes (public atomic-mass tables).
ELECTRON = 0.0005485799090659
ISOTOPES: dict[str, list[tuple[str, float, float]]] = {
    "H": [("H", 1.00782503223, 0.999885), ("D", 2.01410177812, 0.000115)],
    "C": [("C", 12.0, 0.9893), ("13C", 13.00335483507, 0.0107)],
    "N": [("N", 14.00307400443, 0.99636), ("15N", 15.00010889888, 0.00364)],
    "O": [("O", 15.99491461957, 0.99757), ("17O", 16.9991317565, 0.00038), ("18O", 17.99915961286, 0.00205)],
    "F": [("F", 18.99840316273, 1.0)],
    "Na": [("Na", 22.989769282, 1.0)],
    "Si": [("Si", 27.97692653465, 0.92223), ("29Si", 28.9764946649, 0.04685), ("30Si", 29.973770136, 0.03092)],
    "P": [("P", 30.97376199842, 1.0)],
    "S": [("S", 31.9720711744, 0.9499), ("33S", 32.9714589098, 0.0075), ("34S", 33.967867004, 0.0425), ("36S", 35.96708071, 0.0001)],
    "Cl": [("Cl", 34.968852682, 0.7576), ("37Cl", 36.965902602, 0.2424)],
    "K": [("K", 38.9637064864, 0.932581), ("40K", 39.963998166, 0.000117), ("41K", 40.9618252579, 0.067302)],
    "Fe": [("54Fe", 53.93960899, 0.05845), ("Fe", 55.93493633, 0.91754), ("57Fe", 56.93539284, 0.02119), ("58Fe", 57.93327443, 0.00282)],
    "Cu": [("Cu", 62.92959772, 0.6915), ("65Cu", 64.9277897, 0.3085)],
    "Br": [("Br", 78.9183376, 0.5069), ("81Br", 80.9162897, 0.4931)],
    "I": [("I", 126.9044719, 1.0)],
}
VALENCE = {"H": 1, "C": 4, "N": 3, "O": 2, "F": 1, "Na": 1, "Si": 4, "P": 3, "S": 2, "Cl": 1, "K": 1, "Fe": 3, "Cu": 2, "Br": 1, "I": 1}
#: Order of atoms in written formulas.
ATOM_ORDER = ("C", "H", "O", "N", "P", "S", "Cl", "Br", "F", "I", "Si", "Na", "K", "Fe", "Cu")

MONO = {label: mass for rows in ISOTOPES.values() for label, mass, _ in rows}
ABUNDANCE = {label: share for rows in ISOTOPES.values() for label, _, share in rows}
ELEMENT = {label: element for element, rows in ISOTOPES.items() for label, _, _ in rows}
C13_DELTA = MONO["13C"] - MONO["C"]
