"""Fixed values the results depend on."""

import math

# Orbit of the Earth: AU, -, degrees.
EARTH_A = 1.00000261
EARTH_E = 0.01671123
EARTH_I = 0.0
EARTH_W = 114.20783
EARTH_OM = 348.73936

# SI constants behind the orbital period.
GRAVITY = 6.67384e-11
SUN_MASS = 1.989e30
AU_METRES = 149597870700.0
DAY_SECONDS = 86400.0

# Upper limit of a reported orbit distance, AU.
MOID_CEILING = 5.45492

# Borders of the near-Earth groups, AU.
EARTH_PERIHELION = 0.983
EARTH_APHELION = 1.017
AMOR_LIMIT = 1.3

# Hazard rules.
HAZARD_H = 22.0
HAZARD_MOID = 0.05

# Outlier limits: semi-major axis (AU), inclination (degrees).
OUTLIER_A = 5.0
OUTLIER_I = 100.0

TWO_PI = 2.0 * math.pi

# Bounds of the uniform generator (smallest and largest value of each parameter).
UNIFORM_BOUNDS = {
    "a": (1.000260120377797, 4.46166177141966),
    "i": (0.02438955123301278, 75.41131510380872),
    "w": (0.02760676022780205, 359.99587807745064),
    "om": (0.02127409471845821, 359.9423115627528),
    "q": (0.07065659039931853, 1.0169904584402378),
    "n": (0.1045825212392566, 0.985223228646292),
    "ma": (0.08310240005844932, 359.93944570848504),
    "epoch": (2444221.5, 2457315.5),
}

# Orbital parameters whose pairs are compared in the pair distributions.
PAIR_COLUMNS = ("a", "i", "w", "e", "q", "om")
