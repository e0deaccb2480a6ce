"""Readers and writers of mesh, surface, volume and streamline files.

Spark lists and reads the files (``binaryFile``, so any store works); a task
parses one file at a time.  ``read`` gives one row a file; the relational
views below explode it.  Writers turn relations into rows (shape_id, content)
for ``save``, which writes through Hadoop's file system interface.
"""

from __future__ import annotations

import base64
import gzip
import io
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eigenlake.functions.names import geometry_format
from eigenlake.operators.order import quantiles

#: What a file holds: points and faces, named columns a point, or a volume with its affine.
SCHEMA = "path string, format string, points array<double>, faces array<long>, fields map<string, array<double>>, names array<string>, shape array<int>, affine array<double>, error string"

# Element types of the NIfTI-1, MGH and GIfTI formats.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
MGH_TYPES = {0: ">u1", 1: ">i4", 3: ">f4", 4: ">i2"}
GIFTI_TYPES = {"NIFTI_TYPE_UINT8": "u1", "NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_FLOAT64": "f8"}
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _mesh(points, faces) -> dict:
    return {"points": np.asarray(points, float).ravel(), "faces": np.asarray(faces, np.int64).ravel()}


def _fan(polygons: list[list[int]]) -> list[tuple[int, int, int]]:
    """Triangles of polygons."""
    return [(p[0], p[i], p[i + 1]) for p in polygons for i in range(1, len(p) - 1)]


def parse_obj(data: bytes) -> dict:
    points, polygons = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        word = line.split()
        if word[:1] == ["v"]:
            points.append([float(x) for x in word[1:4]])
        elif word[:1] == ["f"]:
            at = [int(x.split("/")[0]) for x in word[1:]]
            polygons.append([i - 1 if i > 0 else len(points) + i for i in at])
    return _mesh(points, _fan(polygons))


def parse_ply(data: bytes) -> dict:
    head, _, body = data.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    kind, elements = "ascii", []
    for line in head.decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            elements[-1][2].append(word[1:])
    order = ">" if kind == "binary_big_endian" else "<"
    out, tokens, at = {"points": [], "faces": []}, iter(body.split()) if kind == "ascii" else None, 0
    for name, n, properties in elements:
        if tokens is None and all(p[0] != "list" for p in properties):
            kind_of = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
            rows = np.frombuffer(body, kind_of, n, at)
            at += n * kind_of.itemsize
            if name == "vertex":
                out["points"] = np.stack([rows[c] for c in "xyz"], axis=1)
            continue
        rows = []
        for _ in range(n):
            row = {}
            for p in properties:
                if tokens is not None:
                    row[p[-1]] = [float(next(tokens)) for _ in range(int(next(tokens)))] if p[0] == "list" else float(next(tokens))
                elif p[0] == "list":
                    size = int(np.frombuffer(body, order + PLY_TYPES[p[1]], 1, at)[0])
                    at += np.dtype(PLY_TYPES[p[1]]).itemsize
                    row[p[-1]] = np.frombuffer(body, order + PLY_TYPES[p[2]], size, at).tolist()
                    at += size * np.dtype(PLY_TYPES[p[2]]).itemsize
                else:
                    row[p[-1]] = float(np.frombuffer(body, order + PLY_TYPES[p[0]], 1, at)[0])
                    at += np.dtype(PLY_TYPES[p[0]]).itemsize
            rows.append(row)
        if name == "vertex":
            out["points"] = [[r[c] for c in "xyz"] for r in rows]
        elif name == "face":
            out["faces"] = _fan([[int(i) for i in next(v for v in r.values() if isinstance(v, list))] for r in rows])
    return _mesh(out["points"], out["faces"])


def parse_stl(data: bytes) -> dict:
    """Equal corners become one vertex."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack("<I", data[80:84])[0]:
        corners = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]), offset=84)["v"].reshape(-1, 3)
    else:
        corners = np.array([[float(x) for x in line.split()[1:4]] for line in data.decode("ascii", "replace").splitlines() if line.split()[:1] == ["vertex"]]).reshape(-1, 3)
    points, at = np.unique(corners.astype(float), axis=0, return_inverse=True)
    return _mesh(points, at.reshape(-1, 3))


def parse_vtk(data: bytes) -> dict:
    """Legacy polydata, ASCII or binary."""
    lines = data.split(b"\n", 4)
    text, rest = lines[2].strip().upper() == b"ASCII", b"\n".join(lines[3:])
    p = rest.index(b"POINTS")
    end = rest.index(b"\n", p)
    n, kind = int(rest[p:end].split()[1]), {b"float": "f4", b"double": "f8"}[rest[p:end].split()[2]]
    q = rest.index(b"POLYGONS")
    end_q = rest.index(b"\n", q)
    size = int(rest[q:end_q].split()[2])
    if text:
        points, flat = np.array(rest[end:q].split()[: 3 * n], float), [int(x) for x in rest[end_q:].split()[:size]]
    else:
        points, flat = np.frombuffer(rest, ">" + kind, 3 * n, end + 1), np.frombuffer(rest, ">i4", size, end_q + 1).tolist()
    polygons, at = [], 0
    while at < len(flat):
        polygons.append(flat[at + 1 : at + 1 + flat[at]])
        at += 1 + flat[at]
    return _mesh(points, _fan(polygons))


def parse_gifti(data: bytes) -> dict:
    """Pointset and triangles, or one field an array; label names by key."""
    root, fields, out = ET.fromstring(data), {}, {}
    for k, a in enumerate(root.iter("DataArray")):
        kind = np.dtype(GIFTI_TYPES[a.get("DataType")]).newbyteorder("<" if a.get("Endian", "LittleEndian") == "LittleEndian" else ">")
        text = (a.findtext("Data") or "").strip()
        if a.get("Encoding") == "ASCII":
            x = np.array(text.split(), float)
        else:
            raw = base64.b64decode(text)
            x = np.frombuffer(zlib.decompress(raw) if a.get("Encoding") == "GZipBase64Binary" else raw, kind)
        intent = a.get("Intent")
        if intent == "NIFTI_INTENT_POINTSET":
            out["points"] = x.astype(float)
        elif intent == "NIFTI_INTENT_TRIANGLE":
            out["faces"] = x.astype(np.int64)
        else:
            fields[f"field_{k}"] = x.astype(float)
    names = {int(x.get("Key", x.get("Index", 0))): (x.text or "") for x in root.iter("Label")}
    return out | {"fields": fields, "names": [names.get(i, "") for i in range(max(names, default=-1) + 1)]}


def parse_freesurfer(data: bytes) -> dict:
    """Triangle surfaces and new-format morphometry."""
    magic = data[:3]
    if magic == b"\xff\xff\xff":
        n, = struct.unpack(">i", data[3:7])
        return {"fields": {"value": np.frombuffer(data, ">f4", n, 15).astype(float)}}
    if magic != b"\xff\xff\xfe":
        raise ValueError("not a surface or morphometry file")
    at = data.index(b"\n\n", 3) + 2
    nv, nf = struct.unpack(">ii", data[at : at + 8])
    return _mesh(np.frombuffer(data, ">f4", 3 * nv, at + 8), np.frombuffer(data, ">i4", 3 * nf, at + 8 + 12 * nv))


def parse_annot(data: bytes) -> dict:
    """Labels as places in the colour table, -1 for none, and the table's names; version 2."""
    n, = struct.unpack(">i", data[:4])
    pairs = np.frombuffer(data, ">i4", 2 * n, 4).reshape(n, 2)
    at = 4 + 8 * n
    tag, version = struct.unpack(">ii", data[at : at + 8])
    names, code = [], {}
    if tag and version == -2:
        _, size = struct.unpack(">ii", data[at + 8 : at + 16])
        at += 16 + size
        count, = struct.unpack(">i", data[at : at + 4])
        at += 4
        for _ in range(count):
            place, size = struct.unpack(">ii", data[at : at + 8])
            name = data[at + 8 : at + 8 + size].rstrip(b"\0").decode("utf-8", "replace")
            r, g, b, _ = struct.unpack(">4i", data[at + 8 + size : at + 24 + size])
            at += 24 + size
            names += [""] * (place + 1 - len(names))
            names[place], code[r + (g << 8) + (b << 16)] = name, place
    value = np.full(n, -1.0)
    value[pairs[:, 0]] = [code.get(c, -1) for c in pairs[:, 1].tolist()]
    return {"fields": {"label": value}, "names": names}


def parse_label(data: bytes) -> dict:
    """Vertices of a region with their values."""
    rows = [line.split() for line in data.decode("ascii", "replace").splitlines()[2:] if line.strip()]
    return {"fields": {"vid": np.array([float(r[0]) for r in rows]), "value": np.array([float(r[4]) for r in rows])}}


def parse_nifti(data: bytes) -> dict:
    """A volume in first-index-fastest order with slope and intercept applied, and its affine by rows."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", data[40:56])
    shape = [d for d in dim[1 : dim[0] + 1]]
    code, = struct.unpack(order + "h", data[70:72])
    pix = struct.unpack(order + "8f", data[76:108])
    offset, slope, inter = struct.unpack(order + "3f", data[108:120])
    _, sform = struct.unpack(order + "2h", data[252:256])
    x = np.frombuffer(data, order + NIFTI_TYPES[code], int(np.prod(shape)), int(offset)).astype(float)
    if slope not in (0.0,) and np.isfinite(slope):
        x = x * slope + inter
    if sform > 0:
        affine = [*struct.unpack(order + "12f", data[280:328]), 0, 0, 0, 1]
    else:
        b, c, d, *shift = struct.unpack(order + "6f", data[256:280])
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
        m = turn * np.array([pix[1], pix[2], pix[3] * (-1 if pix[0] < 0 else 1)])
        affine = np.vstack([np.column_stack([m, shift]), [0, 0, 0, 1]]).ravel().tolist()
    return {"fields": {"value": x}, "shape": shape, "affine": np.array(affine, float)}


def parse_mgh(data: bytes) -> dict:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    _, *shape, code, _ = struct.unpack(">7i", data[:28])
    good, = struct.unpack(">h", data[28:30])
    delta, mdc, mid = (1.0, 1.0, 1.0), np.array([[-1, 0, 0], [0, 0, -1], [0, 1, 0]], float), np.zeros(3)
    if good > 0:
        v = struct.unpack(">15f", data[30:90])
        delta, mdc, mid = v[:3], np.array(v[3:12]).reshape(3, 3), np.array(v[12:15])
    m = mdc.T * np.array(delta)
    affine = np.vstack([np.column_stack([m, mid - m @ (np.array(shape[:3]) / 2)]), [0, 0, 0, 1]])
    return {"fields": {"value": np.frombuffer(data, MGH_TYPES[code], int(np.prod(shape)), 284).astype(float)}, "shape": shape if shape[3] > 1 else shape[:3], "affine": affine.ravel()}


def parse_npz(data: bytes) -> dict:
    """All numeric arrays as fields, flat; vertices and faces as a mesh."""
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        a = {k: z[k] for k in z.files if z[k].dtype.kind in "iufb"}
    mesh = _mesh(a.pop("vertices"), a.pop("faces")) if {"vertices", "faces"} <= a.keys() else {}
    return mesh | {"fields": {k: v.astype(float).ravel() for k, v in a.items()}}


def parse_tck(data: bytes) -> dict:
    """Streamlines: points, and the field ``line`` with each point's streamline."""
    head = dict(x.split(": ", 1) for x in data[: data.index(b"\nEND")].decode("ascii", "replace").splitlines() if ": " in x)
    kind = np.dtype({"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}[head["datatype"]])
    x = np.frombuffer(data, kind, offset=int(head["file"].split()[-1]), count=(len(data) - int(head["file"].split()[-1])) // kind.itemsize // 3 * 3).reshape(-1, 3).astype(float)
    line, good = np.cumsum(np.isnan(x[:, 0])), np.isfinite(x[:, 0])
    return {"points": x[good].ravel(), "fields": {"line": line[good].astype(float)}}


def parse_trk(data: bytes) -> dict:
    """The same; points are in voxel millimetres, moved to world space by the header's matrix where it has one."""
    scalars, = struct.unpack("<h", data[36:38])
    properties, = struct.unpack("<h", data[238:240])
    size, m = np.array(struct.unpack("<3f", data[12:24])), np.array(struct.unpack("<16f", data[440:504])).reshape(4, 4)
    at, points, line, k = 1000, [], [], 0
    while at + 4 <= len(data):
        n, = struct.unpack("<i", data[at : at + 4])
        points.append(np.frombuffer(data, "<f4", n * (3 + scalars), at + 4).reshape(n, 3 + scalars)[:, :3].astype(float))
        line.append(np.full(n, float(k)))
        at, k = at + 4 + 4 * (n * (3 + scalars) + properties), k + 1
    p = np.concatenate(points) if points else np.empty((0, 3))
    if m[3, 3]:
        p = (p / size - 0.5) @ m[:3, :3].T + m[:3, 3]
    return {"points": p.ravel(), "fields": {"line": np.concatenate(line) if line else np.empty(0)}}


def format_of(path: str, data: bytes) -> str | None:
    """By extension, then by magic bytes and usual names."""
    name = path.rsplit("/", 1)[-1].lower()
    for end, kind in ((".nii.gz", "nifti"), (".nii", "nifti"), (".mgz", "mgh"), (".mgh", "mgh"), (".gii", "gifti"), (".obj", "obj"), (".ply", "ply"), (".stl", "stl"), (".vtk", "vtk"), (".npz", "npz"), (".annot", "annot"), (".label", "label"), (".trk", "trk"), (".tck", "tck")):
        if name.endswith(end):
            return kind
    if data[:3] in (b"\xff\xff\xfe", b"\xff\xff\xff") or name.rsplit(".", 1)[-1] in ("white", "pial", "inflated", "sphere", "thickness", "curv", "sulc", "area"):
        return "freesurfer"
    return None


PARSERS = {"obj": parse_obj, "ply": parse_ply, "stl": parse_stl, "vtk": parse_vtk, "gifti": parse_gifti, "freesurfer": parse_freesurfer, "annot": parse_annot, "label": parse_label, "nifti": parse_nifti, "mgh": parse_mgh, "npz": parse_npz, "trk": parse_trk, "tck": parse_tck}


def parse(path: str, data: bytes) -> dict:
    """A row of ``SCHEMA``; a file that can't be read has only ``error``."""
    kind, row, error = format_of(path, data), {}, None
    try:
        if kind is None:
            raise ValueError("unknown format")
        row = PARSERS[kind](data)
    except Exception as e:  # noqa: BLE001 - one bad file must not end the job; the row says what failed
        error = f"{type(e).__name__}: {e}"
    fields = row.get("fields")
    flat = lambda k: None if row.get(k) is None else np.asarray(row[k]).tolist()
    return {"path": path, "format": kind, "points": flat("points"), "faces": flat("faces"), "fields": None if fields is None else {k: v.tolist() for k, v in fields.items()}, "names": row.get("names"), "shape": flat("shape"), "affine": flat("affine"), "error": error}


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, data in zip(b["path"], b["content"], strict=True):
            yield pd.DataFrame([parse(path, data)])


def read(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row a file under ``path``, searched to any depth; ``pattern`` is a glob of file names."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "content").mapInPandas(_parse_all, SCHEMA)


def vertices(files: DataFrame) -> DataFrame:
    """(shape_id, vid, x, y, z); the path is the shape's id."""
    at = F.sequence(F.lit(0), (F.size("points") / 3).cast("int") - 1)
    p = files.where("size(points) >= 3").select(F.col("path").alias("shape_id"), "points", F.explode(at).alias("i"))
    return p.select("shape_id", F.col("i").cast("long").alias("vid"), *(F.get("points", F.col("i") * 3 + k).alias(c) for k, c in enumerate("xyz")))


def faces(files: DataFrame) -> DataFrame:
    """(shape_id, fid, i0, i1, i2)."""
    at = F.sequence(F.lit(0), (F.size("faces") / 3).cast("int") - 1)
    p = files.where("size(faces) >= 3").select(F.col("path").alias("shape_id"), "faces", F.explode(at).alias("i"))
    return p.select("shape_id", F.col("i").cast("long").alias("fid"), *(F.get("faces", F.col("i") * 3 + k).alias(f"i{k}") for k in range(3)))


def fields(files: DataFrame) -> DataFrame:
    """(shape_id, field, vid, value)."""
    one = files.where("fields is not null").select(F.col("path").alias("shape_id"), F.explode("fields").alias("field", "values"))
    return one.select("shape_id", "field", F.posexplode("values").alias("vid", "value")).withColumn("vid", F.col("vid").cast("long"))


def voxels(files: DataFrame) -> DataFrame:
    """(shape_id, i, j, k, value, x, y, z) of the first volume of each file, nonzero voxels only; x, y, z by the affine."""
    v = files.where("size(shape) >= 3 and affine is not null").select(F.col("path").alias("shape_id"), "shape", "affine", F.posexplode(F.element_at("fields", "value")).alias("at", "value"))
    n0, n1, n2 = (F.get("shape", F.lit(d)) for d in range(3))
    v = v.where((F.col("value") != 0) & (F.col("at") < n0 * n1 * n2)).select("shape_id", "value", "affine", (F.col("at") % n0).alias("i"), (F.floor(F.col("at") / n0) % n1).cast("int").alias("j"), F.floor(F.col("at") / (n0 * n1)).cast("int").alias("k"))
    world = lambda r: F.get("affine", F.lit(4 * r)) * F.col("i") + F.get("affine", F.lit(4 * r + 1)) * F.col("j") + F.get("affine", F.lit(4 * r + 2)) * F.col("k") + F.get("affine", F.lit(4 * r + 3))
    return v.select("shape_id", "i", "j", "k", "value", *(world(r).alias(c) for r, c in enumerate("xyz")))


def label_cloud(volume: DataFrame, label: float, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """Points of the voxels with a label, numbered within their shape; jitter is a uniform shift that depends on voxel and seed alone."""
    from pyspark.sql import Window

    p = volume.where(F.col("value") == label)
    shift = lambda c: jitter * (F.pmod(F.xxhash64("i", "j", "k", F.lit(c), F.lit(seed)), F.lit(2000001)) / 1000000.0 - 1)
    vid = F.row_number().over(Window.partitionBy("shape_id").orderBy("k", "j", "i")) - 1
    return p.select("shape_id", vid.cast("long").alias("vid"), *((F.col(c) + shift(c)).alias(c) for c in "xyz"))


# ---- sinks


def _obj(v: np.ndarray, f: np.ndarray) -> bytes:
    return "".join([*(f"v {x!r} {y!r} {z!r}\n" for x, y, z in v.tolist()), *(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in f.tolist())]).encode()


def _ply(v: np.ndarray, f: np.ndarray) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\nproperty double x\nproperty double y\nproperty double z\nelement face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n"
    rows = np.empty(len(f), np.dtype([("n", "u1"), ("i", "<i4", 3)]))
    rows["n"], rows["i"] = 3, f
    return head.encode() + v.astype("<f8").tobytes() + rows.tobytes()


def _stl(v: np.ndarray, f: np.ndarray) -> bytes:
    rows = np.zeros(len(f), np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    rows["v"] = v[f]
    normal = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
    rows["n"] = normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-30)
    return b"\0" * 80 + struct.pack("<I", len(f)) + rows.tobytes()


def _vtk(v: np.ndarray, f: np.ndarray) -> bytes:
    head = f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET POLYDATA\nPOINTS {len(v)} double\n"
    return (head + "".join(f"{x!r} {y!r} {z!r}\n" for x, y, z in v.tolist()) + f"POLYGONS {len(f)} {4 * len(f)}\n" + "".join(f"3 {a} {b} {c}\n" for a, b, c in f.tolist())).encode()


def _gifti(arrays: list[tuple[str, str, np.ndarray]]) -> bytes:
    root = ET.Element("GIFTI", Version="1.0", NumberOfDataArrays=str(len(arrays)))
    for intent, kind, x in arrays:
        a = ET.SubElement(root, "DataArray", Intent=intent, DataType=kind, ArrayIndexingOrder="RowMajorOrder", Dimensionality=str(x.ndim), Encoding="GZipBase64Binary", Endian="LittleEndian", ExternalFileName="", ExternalFileOffset="", **{f"Dim{i}": str(n) for i, n in enumerate(x.shape)})
        ET.SubElement(a, "Data").text = base64.b64encode(zlib.compress(x.astype("<" + GIFTI_TYPES[kind]).tobytes())).decode()
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def _gifti_surface(v: np.ndarray, f: np.ndarray) -> bytes:
    return _gifti([("NIFTI_INTENT_POINTSET", "NIFTI_TYPE_FLOAT32", v), ("NIFTI_INTENT_TRIANGLE", "NIFTI_TYPE_INT32", f)])


WRITERS = {"obj": _obj, "ply": _ply, "stl": _stl, "vtk": _vtk, "gii": _gifti_surface}


def encode_meshes(vertices_: DataFrame, faces_: DataFrame, kind: str) -> DataFrame:
    """(shape_id, content binary) in format obj, ply, stl, vtk or gii; vertices are numbered in the order of vid."""
    from eigenlake.operators.kernels import per_pair, xyz

    def kernel(v, f):
        return {"content": [WRITERS[kind](xyz(v), np.searchsorted(v["vid"].to_numpy(), f[["i0", "i1", "i2"]].to_numpy(np.int64).reshape(-1, 3) if len(f) else np.empty((0, 3), np.int64)))]}

    return per_pair(vertices_, faces_, kernel, "content binary")


def encode_fields(fields_: DataFrame, kind: str = "gii") -> DataFrame:
    """(shape_id, content binary) of fields (shape_id, field, vid, value): GIfTI functional arrays or npz, one array a field in order of names."""
    from eigenlake.operators.kernels import per_shape

    def kernel(rows):
        arrays = {str(k): g.sort_values("vid")["value"].to_numpy(float) for k, g in rows.groupby("field", sort=True)}
        if kind == "gii":
            return {"content": [_gifti([("NIFTI_INTENT_NONE", "NIFTI_TYPE_FLOAT32", x) for x in arrays.values()])]}
        out = io.BytesIO()
        np.savez_compressed(out, **arrays)
        return {"content": [out.getvalue()]}

    return per_shape(fields_, kernel, "content binary")


def save(encoded: DataFrame, folder: str, extension: str) -> int:
    """Writes each content as ``folder/shape_id.extension`` through Hadoop's file system and returns the number of files.

    Rows come to the driver one partition at a time, as files are few and
    each is a single shape; relations of any size are better kept as Parquet.
    """
    jvm, conf, n = encoded.sparkSession._jvm, encoded.sparkSession._jsc.hadoopConfiguration(), 0
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    for row in encoded.toLocalIterator():
        name = str(row.shape_id).rsplit("/", 1)[-1]
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{extension}"), True)
        try:
            out.write(bytearray(row.content))
        finally:
            out.close()
        n += 1
    return n


def save_connectome(edges: DataFrame, path: str) -> None:
    """A tab-separated matrix with a header of labels, from edges (i, j, w); pairs without an edge are 0.

    One row a node; the columns are the nodes, up to Spark's limit of pivot values.
    """
    labels = [r.i for r in edges.select(F.explode(F.array("i", "j")).alias("i")).distinct().orderBy("i").limit(10_001).collect()]
    if len(labels) > 10_000:
        raise ValueError("a matrix file holds up to 10,000 nodes; keep larger ones as edges")
    every = edges.sparkSession.createDataFrame([(x,) for x in labels], edges.select("i").schema)
    wide = every.join(edges.groupBy("i").pivot("j", labels).agg(F.first("w")), "i", "left").orderBy("i")
    wide.select("i", *(F.format_string("%.6f", F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0))).alias(str(x)) for x in labels)).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, subject, format) of files under root, subjects from sub-X parts of the path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    subject = F.nullif(F.regexp_extract("path", r"/(sub-[^/_]+)", 1), F.lit(""))
    return files.select("path", "length", subject.alias("subject"), geometry_format(F.lower("path")).alias("format"))


def extract_submesh(vertices_: DataFrame, faces_: DataFrame, mask: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices in the mask (shape_id, vid) and the faces with all corners in it; ids stay."""
    m = mask.select("shape_id", "vid").distinct()
    kept = faces_
    for c in ("i0", "i1", "i2"):
        kept = kept.join(m.select("shape_id", F.col("vid").alias(c)), ["shape_id", c], "left_semi")
    return vertices_.join(m, ["shape_id", "vid"], "left_semi"), kept


def aggregate_by_parcel(values: DataFrame, labels: DataFrame) -> DataFrame:
    """(shape_id, label, n, mean, median, std, min, max, sum, iqr) of values (shape_id, vid, value) by labels (shape_id, vid, label); NaN is left out, population deviation."""
    v = values.where(~F.isnan("value")).join(labels, ["shape_id", "vid"])
    x, key = F.col("value"), ["shape_id", "label"]
    parts = quantiles(v, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, *key)
    sums = v.groupBy(*key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("sum"))
    return sums.join(parts, key, "left").select(*key, "n", "mean", "median", "std", "min", "max", "sum", (F.col("q3") - F.col("q1")).alias("iqr"))


def remap_parcels(names: DataFrame, mapping: dict[str, str], match: str = "exact", unmapped: str = "unmapped") -> DataFrame:
    """(name, grp): group of each name by equality, or by the first key in order that it contains."""
    grp = F.lit(None).cast("string")
    for key in sorted(mapping):
        hit = F.col("name") == key if match == "exact" else F.contains(F.lower("name"), F.lit(key.lower()))
        grp = F.coalesce(grp, F.when(hit, mapping[key]))
    return names.select("name", F.coalesce(grp, F.lit(unmapped)).alias("grp"))
