"""Names of brain regions by label, and the atlases that parcels come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels of the usual segmentations (id name), in the order of a look-up by name.
ASEG = """2 Left-Cerebral-White-Matter, 3 Left-Cerebral-Cortex, 4 Left-Lateral-Ventricle, 5 Left-Inf-Lat-Vent, 7 Left-Cerebellum-White-Matter,
8 Left-Cerebellum-Cortex, 10 Left-Thalamus, 11 Left-Caudate, 12 Left-Putamen, 13 Left-Pallidum, 14 3rd-Ventricle, 15 4th-Ventricle,
16 Brain-Stem, 17 Left-Hippocampus, 18 Left-Amygdala, 24 CSF, 26 Left-Accumbens-area, 28 Left-VentralDC, 30 Left-vessel, 31 Left-choroid-plexus,
41 Right-Cerebral-White-Matter, 42 Right-Cerebral-Cortex, 43 Right-Lateral-Ventricle, 44 Right-Inf-Lat-Vent, 46 Right-Cerebellum-White-Matter,
47 Right-Cerebellum-Cortex, 49 Right-Thalamus, 50 Right-Caudate, 51 Right-Putamen, 52 Right-Pallidum, 53 Right-Hippocampus, 54 Right-Amygdala,
58 Right-Accumbens-area, 60 Right-VentralDC, 62 Right-vessel, 63 Right-choroid-plexus, 77 WM-hypointensities, 85 Optic-Chiasm,
251 CC_Posterior, 252 CC_Mid_Posterior, 253 CC_Central, 254 CC_Mid_Anterior, 255 CC_Anterior"""
HIPPOCAMPUS = """203 parasubiculum, 204 presubiculum-head, 205 presubiculum-body, 206 subiculum-head, 207 subiculum-body, 208 CA1-head, 209 CA1-body,
210 CA2/3-head, 211 CA2/3-body, 212 CA4-head, 213 CA4-body, 214 GC-ML-DG-head, 215 GC-ML-DG-body, 226 molecular_layer_HP-head,
227 molecular_layer_HP-body, 228 hippocampal-fissure, 229 HATA, 230 fimbria, 231 hippocampal_tail, 232 whole_hippocampal_head, 233 whole_hippocampal_body"""
THALAMUS = """8103 Left-AV, 8104 Left-CeM, 8105 Left-CL, 8106 Left-CM, 8108 Left-LD, 8109 Left-LGN, 8110 Left-LP, 8111 Left-L-Sg, 8112 Left-MDl,
8113 Left-MDm, 8115 Left-MGN, 8116 Left-MV(Re), 8117 Left-Pc, 8118 Left-Pf, 8119 Left-Pt, 8120 Left-PuA, 8121 Left-PuI, 8122 Left-PuL, 8123 Left-PuM,
8126 Left-VA, 8127 Left-VAmc, 8128 Left-VLa, 8129 Left-VLp, 8130 Left-VM, 8131 Left-VPL, 8133 Left-Whole_thalamus"""
AMYGDALA = """7001 Left-Lateral-nucleus, 7002 Left-Basal-nucleus, 7003 Left-Accessory-Basal-nucleus, 7004 Left-Anterior-amygdaloid-area,
7005 Left-Central-nucleus, 7006 Left-Medial-nucleus, 7007 Left-Cortical-nucleus, 7008 Left-Corticoamygdaloid-transition,
7009 Left-Paralaminar-nucleus, 7010 Left-Whole-amygdala"""
# The networks of the 7 and the 17 network parcellations, in order.
YEO = {
    7: ("Visual", "Somatomotor", "DorsalAttention", "VentralAttention", "Limbic", "Frontoparietal", "Default"),
    17: ("VisCent", "VisPeri", "SomMotA", "SomMotB", "DorsAttnA", "DorsAttnB", "SalVentAttnA", "SalVentAttnB", "LimbicA", "LimbicB", "ContA", "ContB", "ContC", "DefaultA", "DefaultB", "DefaultC", "TempPar"),
}
# Atlas, how its labels are had, the file or volume, parcels a hemisphere.
ATLASES = (
    ("dkt", "native_annot", "{hemi}.aparc.DKTatlas.annot", 31),
    ("desikan", "native_annot", "{hemi}.aparc.annot", 34),
    ("destrieux", "native_annot", "{hemi}.aparc.a2009s.annot", 74),
    *((f"schaefer_{n}", "fsaverage_annot", f"{{hemi}}.Schaefer2018_{n}Parcels_7Networks_order.annot", n // 2) for n in (100, 200, 400, 600, 800, 1000)),
    ("glasser", "fsaverage_annot", "{hemi}.HCPMMP1.annot", 180),
    ("brainnetome", "mni_volume", "brainnetome", 123),
    ("aal3", "mni_volume", "aal", 85),
    ("julich", "mni_volume", "juelich", None),
    ("harvard_oxford", "mni_volume", "harvard_oxford", 48),
)
ALIASES = {"schaefer": "schaefer_200", "aparc": "desikan", "mmp": "glasser", "hcp": "glasser"}


def _entries(text: str) -> list[tuple[int, str]]:
    return [(int(n), name) for n, _, name in (x.strip().partition(" ") for x in text.split(","))]


def _both_sides(text: str, step: int) -> dict[int, str]:
    own = _entries(text)
    return dict(own + [(n + step, name.replace("Left", "Right")) for n, name in own])


LABELS = {
    "aseg": dict(_entries(ASEG)),
    "hippocampal_subfields": _both_sides(HIPPOCAMPUS, 1000),
    "thalamic_nuclei": _both_sides(THALAMUS, 100),
    "amygdala_nuclei": _both_sides(AMYGDALA, 1000),
}


def labels(spark: SparkSession, atlas: str) -> DataFrame:
    """(id, name, place) of an atlas; no rows for an unknown one."""
    return spark.createDataFrame([(n, name, i) for i, (n, name) in enumerate(LABELS.get(atlas, {}).items())], "id int, name string, place int")


def label_name(label: Column, atlas: str) -> Column:
    """The name of a label, Unknown-<id> where there is none."""
    names = [F.lit(x) for pair in LABELS.get(atlas, {}).items() for x in pair]
    unknown = F.concat(F.lit("Unknown-"), label.cast("string"))
    return F.coalesce(F.try_element_at(F.create_map(*names), label.cast("int")), unknown) if names else unknown


def label_id(name: Column, atlas: str) -> Column:
    """The first label whose name has this text, in any case; null if none does."""
    out = F.lit(None).cast("int")
    for n, have in reversed(LABELS.get(atlas, {}).items()):
        out = F.when(F.contains(F.lit(have.lower()), F.lower(name)), F.lit(n)).otherwise(out)
    return out


def structures(spark: SparkSession, atlas: str, hemisphere: str = "both") -> DataFrame:
    """(id) of an atlas's labels, or of those of one hemisphere by name (left or lh, right or rh)."""
    every, name = labels(spark, atlas), F.lower("name")
    if hemisphere == "both":
        return every.select("id")
    return every.where(name.contains(hemisphere) | name.contains(hemisphere[0] + "h")).select("id")


def yeo_network(parcel: Column, parcels: int = 200, networks: int = 7) -> Column:
    """The network of a parcel (from 1), if each has equally many parcels a hemisphere; an approximation, exact only by the parcels' names."""
    half = parcels // 2
    place = F.least(F.floor(F.pmod(parcel - 1, F.lit(half)) / (half // networks)), F.lit(networks - 1))
    return F.element_at(F.array(*map(F.lit, YEO[networks])), (place + 1).cast("int"))


def atlases(spark: SparkSession) -> DataFrame:
    """(name, strategy, source, parcels), aliases included."""
    have = {a[0]: a for a in ATLASES}
    return spark.createDataFrame([*ATLASES, *((n, *have[a][1:]) for n, a in ALIASES.items())], "name string, strategy string, source string, parcels int")


def resolve_atlas(name: str) -> tuple:
    """(name, strategy, source, parcels) of an atlas, in any case, with - or blanks for _."""
    key = name.lower().replace("-", "_").replace(" ", "_")
    have = {a[0]: a for a in ATLASES}
    if ALIASES.get(key, key) not in have:
        raise ValueError(f"unknown atlas {name}; there are {', '.join(sorted([*have, *ALIASES]))}")
    return have[ALIASES.get(key, key)]
