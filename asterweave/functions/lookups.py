"""Lookup tables: fixed values that decide results. Each can be replaced by a parameter of its operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Priority of a catalogue, 1 first.
PRIORITIES = {"ngc": 1, "ic": 1, "sh2": 2, "rcw": 3, "lbn": 4, "ced": 5, "pgc": 6, "barn": 7, "ldn": 8}

# Order in which the identifiers of a cluster are preferred.
CATALOG_ORDER = ("ngc", "ic", "sh2", "rcw", "lbn", "ced", "pgc", "barn", "ldn")

# Weight of a catalogue in the yearly plan; other designations weigh 10.
PLAN_WEIGHTS = {"ngc": 90, "ic": 90, "sh2": 80, "rcw": 70, "lbn": 60, "ced": 50, "pgc": 40, "barn": 30, "ldn": 20}
PLAN_WEIGHT_OTHER = 10

# Order of catalogues in printed lists of designations.
LABEL_PRIORITY = {"ngc": 9, "ic": 8, "sh2": 7, "rcw": 6, "lbn": 5, "ced": 4, "pgc": 3, "barn": 2, "ldn": 1}

# Largest number of a Messier, Caldwell and Herschel designation.
FAMOUS_RANGES = {"M": 110, "C": 109, "H": 400}

# Points by upper-case type: filter triband, filter narrow band, sky up to Bortle 5, brighter sky.
SCORECARD = {
    "GX": (10, 0, 10, 10), "G": (10, 0, 10, 10), "*": (10, 0, 10, 10), "OTHER": (10, 0, 10, 10), "DUP": (10, 0, 10, 10),
    "**": (10, 0, 10, 10), "GPAIR": (10, 0, 10, 10), "*ASS": (10, 0, 10, 10), "GGROUP": (10, 0, 10, 10), "NOVA": (10, 0, 10, 10),
    "GTRPL": (10, 0, 20, 20), "OCL": (20, 0, 20, 20), "GCL": (20, 0, 20, 20),
    "NB": (20, 30, 20, 20), "HII": (20, 30, 20, 20), "NEB": (20, 30, 20, 20), "CL+N": (20, 30, 20, 20), "PN": (20, 30, 20, 20),
    "SNR": (20, 30, 10, 10), "DN": (0, 0, 30, 0), "RFN": (0, 0, 30, 0),
}
# Points for the most famous list an object is in, and for each measured field.
FAME_POINTS = {"messier": 25.0, "caldwell": 20.0, "herschel": 15.0}
MEASURED_POINTS = 15.0

# Magnitude and size in arcmin taken for a type that lacks them.
DEFAULT_MAG = {
    "Gx": 13.0, "G": 13.0, "GPair": 13.0, "GTrpl": 13.0, "GGroup": 13.0, "PN": 11.0, "OCl": 8.0, "GCl": 8.0, "Cl+N": 8.0,
    "HII": 10.0, "SNR": 10.0, "NB": 10.0, "Neb": 10.0, "DN": 99.0, "LDN": 99.0,
}
DEFAULT_MAG_OTHER = 12.0
DEFAULT_SIZE = {
    "Gx": 5.0, "G": 5.0, "GPair": 8.0, "GTrpl": 8.0, "GGroup": 8.0, "PN": 1.0, "OCl": 15.0, "GCl": 15.0,
    "HII": 45.0, "SNR": 45.0, "DN": 20.0, "NB": 20.0, "Neb": 20.0,
}
DEFAULT_SIZE_OTHER = 10.0

# Printed name of a type.
TYPE_LABELS = {
    "*": "Gwiazda", "**": "Gwiazda Podwójna", "*Ass": "Association of stars", "Nova": "Nova", "Gx": "Galaktyka", "G": "Galaktyka",
    "S": "Galaktyka spiralna", "SB": "Galaktyka spiralna z poprzeczką", "E": "Galaktyka eliptyczna", "GPair": "Para Galaktyk",
    "GTrpl": "Triplet Galaktyk", "GGroup": "Grupa Galaktyk", "OC": "Gromada Otwarta", "OCl": "Gromada Otwarta", "GCl": "Gromada kulista",
    "Cl+N": "Gromada z Mgławicą", "GC": "Gromada Kulista", "HII": "Obszar HII", "NB": "Mgławica", "Neb": "Mgławica",
    "EmN": "Mgławica Emisyjna", "PN": "Mgławica Planetarna", "RfN": "Mgławica Refleksyjna", "DN": "Ciemna Mgławica",
    "DrkN": "Ciemna Mgławica", "SNR": "Pozostałość po SuperN", "Other": "Inny", "NonEx": "Nieistniejący",
}

# Caldwell numbers by padded designation.
CALDWELL = {
    "IC0342": 5, "IC0405": 31, "IC1613": 51, "IC2391": 85, "IC2602": 102, "IC2944": 100, "IC5146": 19,
    "NGC0040": 2, "NGC0055": 72, "NGC0104": 106, "NGC0147": 17, "NGC0185": 18, "NGC0188": 1, "NGC0246": 56, "NGC0247": 62,
    "NGC0253": 65, "NGC0300": 70, "NGC0362": 104, "NGC0457": 13, "NGC0559": 8, "NGC0663": 10, "NGC0752": 28, "NGC0891": 23,
    "NGC1097": 67, "NGC1261": 87, "NGC1275": 24, "NGC1851": 73, "NGC2070": 103, "NGC2237": 49, "NGC2239": 50, "NGC2261": 46,
    "NGC2360": 58, "NGC2362": 64, "NGC2392": 39, "NGC2403": 7, "NGC2419": 25, "NGC2477": 71, "NGC2506": 54, "NGC2516": 96,
    "NGC2775": 48, "NGC2867": 90, "NGC3115": 53, "NGC3132": 74, "NGC3195": 109, "NGC3201": 79, "NGC3242": 59, "NGC3372": 92,
    "NGC3532": 91, "NGC3626": 40, "NGC3766": 97, "NGC4038": 60, "NGC4039": 61, "NGC4236": 3, "NGC4244": 26, "NGC4372": 108,
    "NGC4449": 21, "NGC4559": 36, "NGC4565": 38, "NGC4609": 98, "NGC4631": 32, "NGC4697": 52, "NGC4755": 94, "NGC4833": 105,
    "NGC4884": 35, "NGC4945": 83, "NGC5005": 29, "NGC5128": 77, "NGC5139": 80, "NGC5248": 45, "NGC5286": 84, "NGC5694": 66,
    "NGC5823": 88, "NGC6025": 95, "NGC6087": 89, "NGC6101": 107, "NGC6124": 75, "NGC6193": 82, "NGC6231": 76, "NGC6302": 69,
    "NGC6352": 81, "NGC6397": 86, "NGC6541": 78, "NGC6543": 6, "NGC6729": 68, "NGC6744": 101, "NGC6752": 93, "NGC6822": 57,
    "NGC6826": 15, "NGC6882": 37, "NGC6888": 27, "NGC6934": 47, "NGC6946": 12, "NGC6960": 34, "NGC6992": 33, "NGC7000": 20,
    "NGC7006": 42, "NGC7009": 55, "NGC7023": 4, "NGC7243": 16, "NGC7293": 63, "NGC7331": 30, "NGC7479": 44, "NGC7635": 11,
    "NGC7662": 22, "NGC7814": 43, "C9": 9, "C14": 14, "C41": 41, "C99": 99,
}

# Herschel 400 numbers that the tests and examples use; the whole list is a table given as a parameter.
HERSCHEL_SAMPLE = {"NGC0040": 1, "NGC0129": 2, "NGC0136": 3, "NGC0157": 4, "NGC0185": 5, "NGC779": 33, "NGC869": 34, "NGC884": 35, "NGC891": 36}

# Common names of Sharpless regions. The key of 126 is written with U+2011, so it matches no id.
SH2_NAMES = {
    "Sh2-101": "Tulip Nebula", "Sh2-103": "Loop", "Sh2-105": "Crescent Nebula", "Sh2-108": "Sadr Region",
    "Sh2-11": "War and Peace Nebula", "Sh2-117": "N American & Pelican Nebula", "Sh2-125": "Cocoon Nebula",
    "Sh2‑126": "Great Lacerta Nebula", "Sh2-129": "Flying Bat Nebula", "Sh2-136": "Ghost Nebula", "Sh2-155": "Cave Nebula",
    "Sh2-162": "Bubble Nebula", "Sh2-184": "Pac Man Nebula", "Sh2-190": "Heart Nebula", "Sh2-197": "Maffei 2", "Sh2-199": "Soul Nebula",
    "Sh2-220": "California Nebula", "Sh2-229": "Flaming Star Nebula", "Sh2-234": "Spider Nebula", "Sh2-237": "Fly Nebula",
    "Sh2-238": "Hind's Variable Nebula", "Sh2-244": "Crab Nebula", "Sh2-245": "Fishhook Nebula", "Sh2-248": "Jellyfish Nebula",
    "Sh2-25": "Lagoon Nebula", "Sh2-252": "Monkey Head Nebula", "Sh2-261": "Lower's Nebula", "Sh2-264": "Angelfish Nebula",
    "Sh2-273": "Fox Fur Nebula", "Sh2-274": "Medusa Nebula", "Sh2-275": "Rosette Nebula", "Sh2-276": "Barnard's Loop",
    "Sh2-277": "Flame Nebula", "Sh2-279": "Running Man Nebula", "Sh2-281": "Orion Nebula", "Sh2-292": "Seagull Nebula head",
    "Sh2-296": "Seagull Nebula wings", "Sh2-298": "Thor's Helmet", "Sh2-30": "Trifid Nebula", "Sh2-311": "Skull & Crossbones Nebula",
    "Sh2-45": "Omega Nebula", "Sh2-49": "Eagle Nebula", "Sh2-54": "Cauda", "Sh2-6": "Bug Nebula", "Sh2-8": "Cat's Paw Nebula",
}

# Corrections of the raw catalogue, by name.
NAME_PATCH = {
    "NGC0188": "North Celestial Pole Cluster", "NGC1333": "Embryo Nebula", "NGC1746": "Cluster of Clusters",
    "NGC1788": "Cosmic Bat Nebula", "NGC1960": "Pinwheel Cluster", "NGC2168": "Shoe-Buckle Cluster", "NGC2170": "Angel Nebula",
    "NGC2682": "King Cobra Cluster", "NGC5457": "Pinwheel Galaxy", "NGC6334": "Cat's Paw Nebula", "NGC6355": "The Snake Nebula",
    "NGC 6979": "Fleming's Triangular Nebula", "NGC7078": "Great Pegasus Cluster", "NGC7092": "Pyramid Cluster",
    "NGC7380": "Wizard Nebula", "NGC7822": "Question Mark Nebula", "IC0410": "Tadpole Nebula", "IC0423": "Tear Drop Nebula",
    "IC0446": "Coyote Cloud", "IC0447": "Dreyer's Nebula", "IC1318": "Gamma Cygni Nebula", "IC1396": "Elephant's Trunk Nebula",
    "IC1613": "Cetus Dwarf Galaxy", "IC4665": "Summer Beehive Cluster", "IC4756": "Graff’s Cluster",
}
MESSIER_PATCH = {"NGC1432": "45"}


def lookup(table: dict, key: Column, default: object = None) -> Column:
    """The value of a small fixed table at ``key``, as a map literal; ``default`` where there is none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.create_map(*pairs)[key]
    return found if default is None else F.coalesce(found, F.lit(default))
