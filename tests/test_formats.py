"""Round trips of files, and files built by hand."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenlake.operators import geometry
from eigenlake.sources import formats


@pytest.fixture(scope="module")
def mesh(spark):
    v, f = geometry.torus(spark, 8, 6)
    return v.withColumn("shape_id", F.lit("t")).cache(), f.withColumn("shape_id", F.lit("t")).cache()


@pytest.mark.parametrize("kind", ["obj", "ply", "stl", "vtk", "gii"])
def test_meshes_come_back(spark, mesh, kind, tmp_path):
    v, f = mesh
    assert formats.save(formats.encode_meshes(v, f, kind), str(tmp_path), kind) == 1
    files = formats.read(spark, str(tmp_path), f"*.{kind}").cache()
    assert files.first().error is None
    got, faces = formats.vertices(files), formats.faces(files)
    assert (got.count(), faces.count()) == (v.count(), f.count())
    area = geometry.surface_area(got, faces).first()
    assert abs(area[1] / geometry.surface_area(v, f).first()[1] - 1) < 1e-5


def test_fields_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("s", c, i, i * k) for k, c in ((1.0, "a"), (2.0, "b")) for i in range(5)], "shape_id string, field string, vid long, value double")
    for kind in ("gii", "npz"):
        formats.save(formats.encode_fields(rows, kind), str(tmp_path), kind)
        got = formats.fields(formats.read(spark, str(tmp_path), f"*.{kind}")).groupBy("field").agg(F.sum("value").alias("s")).collect()
        assert sorted(r.s for r in got) == [10.0, 20.0]


def test_volumes(spark, tmp_path):
    x = np.zeros((4, 3, 2), np.int16)
    x[1, 2, 1], x[3, 0, 0] = 5, 7
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 4, 3, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, 2, 0, 0, 10, 0, 2, 0, 20, 0, 0, 2, 30)
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(bytes(head) + x.tobytes(order="F")))
    rows = formats.voxels(formats.read(spark, str(tmp_path), "*.nii.gz")).collect()
    assert {(r.i, r.j, r.k, r.value, r.x, r.y, r.z) for r in rows} == {(1, 2, 1, 5.0, 12.0, 24.0, 32.0), (3, 0, 0, 7.0, 16.0, 20.0, 30.0)}
    cloud = formats.label_cloud(formats.voxels(formats.read(spark, str(tmp_path), "*.nii.gz")), 5, 0.25).collect()
    assert len(cloud) == 1 and abs(cloud[0].x - 12) <= 0.25
    mgh = struct.pack(">7i", 1, 2, 2, 2, 1, 3, 0) + struct.pack(">h", 0) + b"\0" * 254 + np.arange(8, dtype=">f4").tobytes()
    got = formats.parse("b.mgh", mgh)
    assert got["fields"]["value"] == list(range(8)) and got["shape"] == [2, 2, 2]


def test_freesurfer_files():
    tri = b"\xff\xff\xfemade\n\n" + struct.pack(">ii", 3, 1) + np.arange(9, dtype=">f4").tobytes() + np.array([0, 1, 2], ">i4").tobytes()
    got = formats.parse("/s/lh.white", tri)
    assert got["points"] == list(range(9)) and got["faces"] == [0, 1, 2]
    curv = b"\xff\xff\xff" + struct.pack(">iii", 3, 1, 1) + np.array([1, 2, 3], ">f4").tobytes()
    assert formats.parse("/s/lh.thickness", curv)["fields"]["value"] == [1, 2, 3]
    name = b"area\0"
    annot = struct.pack(">i4i", 2, 0, 5 + (6 << 8), 1, 0) + struct.pack(">ii", 1, -2) + struct.pack(">ii", 1, 4) + b"ct1\0" + struct.pack(">i", 1) + struct.pack(">ii", 0, len(name)) + name + struct.pack(">4i", 5, 6, 0, 0)
    got = formats.parse("lh.x.annot", annot)
    assert got["fields"]["label"] == [0, -1] and got["names"] == ["area"]
    got = formats.parse("v.label", b"#!ascii label\n2\n4 0 0 0 1.5\n7 0 0 0 2.5\n")
    assert got["fields"] == {"vid": [4, 7], "value": [1.5, 2.5]}


def test_streamlines():
    body = np.array([[1, 2, 3], [4, 5, 6], [np.nan] * 3, [7, 8, 9], [np.nan] * 3, [np.inf] * 3], "<f4").tobytes()
    head = b"mrtrix tracks\ndatatype: Float32LE\nfile: . 80\nEND\n"
    got = formats.parse("a.tck", head.ljust(80, b"\0") + body)
    assert got["points"] == list(range(1, 10)) and got["fields"]["line"] == [0, 0, 1]
    head = bytearray(1000)
    struct.pack_into("<3f", head, 12, 1, 1, 1)
    got = formats.parse("a.trk", bytes(head) + struct.pack("<i", 1) + np.array([1, 2, 3], "<f4").tobytes())
    assert got["points"] == [1, 2, 3] and got["fields"]["line"] == [0]


def test_bad_files_say_so(spark, tmp_path):
    (tmp_path / "x.nii").write_bytes(b"nothing")
    (tmp_path / "y.what").write_bytes(b"nothing")
    rows = formats.read(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(r.error for r in rows)
    assert formats.vertices(formats.read(spark, str(tmp_path))).count() == 0


def test_parcels_and_matrix(spark, mesh, tmp_path):
    v, f = mesh
    part, inner = formats.extract_submesh(v, f, v.where("vid < 20"))
    assert part.count() == 20 and 0 < inner.count() < f.count() and inner.where("greatest(i0, i1, i2) >= 20").count() == 0
    values = v.select("shape_id", "vid", F.col("z").alias("value"))
    labels = v.select("shape_id", "vid", (F.col("vid") % 3).alias("label"))
    assert formats.aggregate_by_parcel(values, labels).count() == 3
    names = spark.createDataFrame([("Left-Hippo",), ("CA1",)], "name string")
    assert [r.grp for r in formats.remap_parcels(names, {"hippo": "H"}, "contains").orderBy("name").collect()] == ["unmapped", "H"]
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25)], "i int, j int, w double")
    formats.save_connectome(edges, str(tmp_path / "m"))
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert text.splitlines() == ["i\t1\t2", "1\t0.000000\t0.500000", "2\t0.250000\t0.000000"]
