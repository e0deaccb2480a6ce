"""File names: formats by extension, BIDS entities, and label names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extension and format, longer extensions first.
EXTENSIONS = (
    ("nii.gz", "nifti"), ("nii", "nifti"), ("mgz", "mgh"), ("mgh", "mgh"), ("gii", "gifti"), ("gifti", "gifti"), ("ply", "ply"), ("obj", "obj"),
    ("stl", "stl"), ("off", "off"), ("vtk", "vtk"), ("vtp", "vtp"), ("trk", "trk"), ("tck", "tck"), ("h5", "hdf5"), ("npz", "npz"),
)


def geometry_format(name: Column) -> Column:
    """The format of a file by its extension in lower case; null if unknown."""
    out = F.lit(None).cast("string")
    for ext, kind in reversed(EXTENSIONS):
        out = F.when(F.lower(name).endswith("." + ext), kind).otherwise(out)
    return out


def bids_entities(path: Column) -> Column:
    """Map of the key-value pairs in a BIDS path; of a repeated key the first counts."""
    pairs = F.regexp_extract_all(path, F.lit(r"(?:^|[/_])([a-z]+-[A-Za-z0-9]+)"), F.lit(1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "-", 1).alias("key"), F.substring_index(p, "-", -1).alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]))
