"""Spaces from templates: usual sizes of rooms and what their surfaces are usually made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Length, width and height in metres, and the category of material for floor, wall and ceiling.
TEMPLATES = [
    ("bedroom-small", 3.2, 2.8, 2.7, "tiles", "paint", "paint"),
    ("bedroom-medium", 4.0, 3.6, 2.8, "tiles", "paint", "paint"),
    ("bedroom-luxury", 5.5, 4.5, 3.0, "marble", "cladding", "gypsum"),
    ("living-room", 6.0, 4.5, 2.9, "marble", "paint", "gypsum"),
    ("bathroom", 2.5, 1.8, 2.6, "tiles", "tiles", "paint"),
    ("office", 4.2, 3.5, 2.8, "tiles", "paint", "gypsum"),
    ("retail", 8.0, 6.0, 3.4, "marble", "cladding", "gypsum"),
]
COLUMNS = "template_id string, length_m double, width_m double, height_m double, floor_category string, wall_category string, ceiling_category string"


def templates(spark: SparkSession) -> DataFrame:
    """The catalogue, with the keys of each template's name and subtitle."""
    return spark.createDataFrame(TEMPLATES, COLUMNS).select("*", F.concat("template_id", F.lit(".name")).alias("name_key"), F.concat("template_id", F.lit(".subtitle")).alias("subtitle_key"))


def from_templates(wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` with the template that their template_id names; its columns are null where none has that id.

    The catalogue is broadcast: it has a fixed number of rows. Ids are matched exactly; columns of `wanted` that are named
    like the catalogue's are replaced; repeated rows each give a row.
    """
    known = templates(wanted.sparkSession)
    kept = [c for c in wanted.columns if c == "template_id" or c not in known.columns]
    return wanted.select(*kept).join(F.broadcast(known), "template_id", "left").select(*kept, *[c for c in known.columns if c != "template_id"])
