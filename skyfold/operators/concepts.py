"""Words of questions, the concepts they name, and the classes behind a concept."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Classes of each concept.
CONCEPT_CLASSES = {
    "building": ["roof", "wall", "structure"],
    "structure": ["structure", "roof", "wall"],
    "road": ["ground"],
    "water": ["water"],
    "flood": ["water"],
    "vegetation": ["vegetation"],
    "tree": ["vegetation"],
    "canopy": ["vegetation"],
    "roof": ["roof"],
    "wall": ["wall"],
    "vehicle": ["vehicle"],
    "car": ["vehicle"],
    "bridge": ["structure"],
    "tower": ["structure"],
    "powerline": ["structure"],
    "debris": ["unclassified", "structure"],
    "rubble": ["unclassified", "structure"],
    "landslide": ["unclassified", "structure"],
    "ground": ["ground"],
    "terrain": ["ground"],
}
# The concept that a word names.
SYNONYMS = {
    "building": "building", "buildings": "building", "house": "building", "homes": "building",
    "structure": "structure", "structures": "structure",
    "roof": "roof", "roofs": "roof", "wall": "wall", "walls": "wall",
    "bridge": "bridge", "bridges": "bridge", "tower": "tower", "towers": "tower", "pylon": "tower", "powerline": "powerline", "powerlines": "powerline",
    "road": "road", "roads": "road", "street": "road", "streets": "road", "path": "road",
    "vehicle": "vehicle", "vehicles": "vehicle", "truck": "vehicle", "trucks": "vehicle", "car": "car", "cars": "car",
    "water": "water", "pond": "water", "lake": "water", "river": "water", "flood": "flood", "flooding": "flood",
    "vegetation": "vegetation", "tree": "tree", "trees": "tree", "forest": "tree", "canopy": "canopy",
    "debris": "debris", "rubble": "debris", "rubbish": "debris", "landslide": "landslide", "landslides": "landslide", "mudslide": "landslide",
    "ground": "ground", "field": "ground", "terrain": "terrain",
}
# Parts of words that name a concept when no whole word does, in order.
PARTS = {
    "building": ["building", "house", "homes", "structure"],
    "water": ["water", "flood", "pond", "lake", "river"],
    "road": ["road", "street", "path"],
}


def concept(q: Column) -> Column:
    """Concept of the first known word of a lower-case question, else by the first known part; null if neither is there."""
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    named = F.array_compact(F.transform(F.split(q, r"\s+"), lambda w: table[w]))
    part = F.lit(None).cast("string")
    for name, words in PARTS.items():
        there = F.lit(False)
        for w in words:
            there = there | q.contains(w)
        part = F.coalesce(part, F.when(there, name))
    return F.coalesce(F.get(named, F.lit(0)), part)
