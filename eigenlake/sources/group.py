"""Cohorts: one file a subject, read into maps (subject, vid, value) beside a table of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenlake.functions.names import bids_entities
from eigenlake.operators import inference, parcels
from eigenlake.sources import formats


def subjects(spark: SparkSession, root: str, pattern: str, wanted: list[str] | None = None) -> DataFrame:
    """(subject, path, entities, n_files): the first file in order of path of each ``sub-`` under root; the contents aren't read.

    ``pattern`` is a glob of file names; ``entities`` is the map of BIDS pairs in the path; ``wanted`` keeps these subjects (with or without ``sub-``).
    """
    found = formats.discover(spark, root, pattern).where("subject is not null")
    if wanted is not None:
        found = found.where(F.col("subject").isin([s if s.startswith("sub-") else f"sub-{s}" for s in wanted]))
    return found.groupBy("subject").agg(F.min("path").alias("path"), F.count("*").alias("n_files")).select("subject", "path", bids_entities(F.col("path")).alias("entities"), "n_files")


def freesurfer_subjects(spark: SparkSession, root: str, name: str, hemi: str = "lh", wanted: list[str] | None = None) -> DataFrame:
    """(subject, path) of ``<subject>/surf/<hemi>.<name>`` under root, a surface or a measure."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{hemi}.{name}").load(root).select("path")
    found = files.select(F.regexp_extract("path", r"/([^/]+)/surf/[^/]+$", 1).alias("subject"), "path").where("subject <> ''")
    return found.where(F.col("subject").isin(wanted)) if wanted is not None else found


def covariate(people: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """(subject, value): an entity of each subject."""
    return people.select("subject", F.coalesce(F.try_element_at("entities", F.lit(key)), F.lit(default)).alias("value"))


def load_group(people: DataFrame, field: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Maps (subject, vid, value) of the subjects' files, and errors (subject, path, error) of those that couldn't be read.

    ``field`` is a condition on the name of a file's field; by default all
    are taken, and a file without any, such as a bare surface, is an error.
    A task reads one file; a bad file doesn't stop the others.
    """
    spark = people.sparkSession
    paths = people.select("subject", "path")
    parent = [r.folder for r in paths.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).distinct().toLocalIterator()]
    if not parent:
        return spark.createDataFrame([], "subject string, vid long, value double"), spark.createDataFrame([], "subject string, path string, error string")
    content = spark.read.format("binaryFile").load(parent).select("path", "content").join(paths, "path").select("path", "content")
    read = content.mapInPandas(formats._parse_all, formats.SCHEMA).join(paths, "path")
    values = formats.fields(read).join(paths.withColumnRenamed("path", "shape_id"), "shape_id")
    values = values.where(field) if field is not None else values
    empty = F.coalesce("error", F.when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, F.lit("the file has no map")))
    return values.select("subject", "vid", "value"), read.select("subject", "path", empty.alias("error")).where("error is not null")


def split(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The subjects (subject, value) of the two levels of a label, in order; nulls are left out, and other than two levels are an error."""
    levels = [r.value for r in labels.where("value is not null").select("value").distinct().orderBy("value").limit(3).collect()]
    if len(levels) != 2:
        raise ValueError(f"a comparison needs two groups, there are {'more than two' if len(levels) > 2 else len(levels)}")
    return tuple(labels.where(F.col("value") == x).select("subject") for x in levels)


def comparison(maps: DataFrame, labels: DataFrame, test: str = "ttest", **settings) -> DataFrame:
    """The vertexwise test of ``inference`` (ttest, mannwhitney or permutation) between the two levels of labels (subject, value)."""
    tests = {"ttest": inference.vertexwise_ttest, "mannwhitney": inference.vertexwise_mannwhitney, "permutation": inference.permutation_test}
    if test not in tests:
        raise ValueError(f"unknown test {test}")
    a, b = split(labels)
    marked = a.withColumn("grp", F.lit("a")).unionByName(b.withColumn("grp", F.lit("b")))
    return tests[test](maps.join(marked, "subject").select("subject", "vid", "value", "grp"), "a", "b", **settings)


def load_freesurfer(spark: SparkSession, root: str, measure: str, target: DataFrame, hemi: str = "lh", method: str = "nearest", wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Maps (subject, vid, value) of a measure at the vertices of a common sphere (vid, x, y, z), and errors.

    The subjects' own spheres are ``surf/<hemi>.sphere.reg``.
    """
    people = freesurfer_subjects(spark, root, measure, hemi, wanted)
    values, errors = load_group(people)
    spheres = freesurfer_subjects(spark, root, "sphere.reg", hemi, wanted)
    files = formats.read(spark, root, f"{hemi}.sphere.reg")
    own = formats.vertices(files).join(spheres.withColumnRenamed("path", "shape_id"), "shape_id").select(F.col("subject").alias("shape_id"), "vid", "x", "y", "z")
    out = parcels.carried(values.withColumnRenamed("subject", "shape_id"), own, target, method)
    return out.withColumnRenamed("shape_id", "subject"), errors


def tract_masks(spark: SparkSession, root: str, bundles: list[str] | None = None, folder: str = "bundle_segmentations") -> DataFrame:
    """(subject, bundle, path) of the mask volumes ``<folder>/<bundle>.nii[.gz]`` under root; subject is null outside ``sub-`` folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*").load(root).select("path")
    found = files.where(F.col("path").contains(f"/{folder}/")).select(F.nullif(F.regexp_extract("path", r"/(sub-[^/_]+)", 1), F.lit("")).alias("subject"), F.regexp_extract("path", r"/([^/]+?)\.nii(\.gz)?$", 1).alias("bundle"), "path")
    return found.where(F.col("bundle").isin(bundles)) if bundles is not None else found


def tract_clouds(spark: SparkSession, root: str, bundles: list[str] | None = None, level: float = 0.5, jitter: float = 0.0, seed: int = 0, folder: str = "bundle_segmentations") -> tuple[DataFrame, DataFrame]:
    """Points (shape_id, vid, x, y, z) of the voxels beyond ``level`` of each mask, and masks that give none (path, error)."""
    masks = tract_masks(spark, root, bundles, folder)
    files = formats.read(spark, root, "*.nii*").join(masks, "path", "left_semi")
    inside = formats.voxels(files).where(F.col("value") > level).withColumn("value", F.lit(1.0))
    empty = masks.join(inside.select(F.col("shape_id").alias("path")).distinct(), "path", "left_anti").select("path", F.lit("the mask is empty").alias("error"))
    return formats.label_cloud(inside, 1.0, jitter, seed), empty
