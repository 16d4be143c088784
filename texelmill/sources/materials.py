"""Binary material files: a declarative layout, read and written as Spark jobs.

The layout below is data; one small reader and one small writer walk it per file inside Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: signatures and field order of the two formats ----------------------------------------------
# name, kind, then the conditions under which the field is present (v = version; a name = that flag is set)
SIGNATURES = {"BGSM": 0x4D534742, "BGEM": 0x4D454742}
HEADER = """
tile_flags u32
u_offset f32
v_offset f32
u_scale f32
v_scale f32
alpha f32
alpha_blend_mode0 u8
alpha_blend_mode1 u32
alpha_blend_mode2 u32
alpha_test_ref u8
alpha_test bool
zbuffer_write bool
zbuffer_test bool
ssr bool
wet_ssr bool
decal bool
two_sided bool
decal_nofade bool
non_occluder bool
refraction bool
refraction_falloff bool
refraction_power f32
env_mapping bool v<10
env_mapping_mask_scale f32 v<10
depth_bias bool v>=10
grayscale_to_palette_color bool
mask_writes u8 v>=6
"""
BGSM = """
DiffuseTexture str
NormalTexture str
SmoothSpecTexture str
GreyscaleTexture str
EnvmapTexture str v<=2
GlowTexture str
InnerLayerTexture str v<=2
WrinklesTexture str
DisplacementTexture str v<=2
SpecularTexture str v>2
LightingTexture str v>2
FlowTexture str v>2
DistanceFieldAlphaTexture str v>=17
EnableEditorAlphaRef bool
Translucency bool v>=8
TranslucencyThickObject bool v>=8
TranslucencyMixAlbedoWithSubsurfaceColor bool v>=8
TranslucencySubsurfaceColor color v>=8
TranslucencyTransmissiveScale f32 v>=8
TranslucencyTurbulence f32 v>=8
RimLighting bool v<8
RimPower f32 v<8
BackLightPower f32 v<8
SubsurfaceLighting bool v<8
SubsurfaceLightingRolloff f32 v<8
SpecularEnabled bool
SpecularColor color
SpecularMult f32
Smoothness f32
FresnelPower f32
WetnessControlSpecScale f32
WetnessControlSpecPowerScale f32
WetnessControlSpecMinvar f32
WetnessControlEnvMapScale f32 v<10
WetnessControlFresnelPower f32
WetnessControlMetalness f32
PBR bool v>2
CustomPorosity bool v>=9
PorosityValue f32 v>=9
RootMaterialPath str
AnisoLighting bool
EmitEnabled bool
EmittanceColor color EmitEnabled
EmittanceMult f32
ModelSpaceNormals bool
ExternalEmittance bool
LumEmittance f32 v>=12
UseAdaptativeEmissive bool v>=13
AdaptativeEmissive_ExposureOffset f32 v>=13
AdaptativeEmissive_FinalExposureMin f32 v>=13
AdaptativeEmissive_FinalExposureMax f32 v>=13
BackLighting bool v<8
ReceiveShadows bool
HideSecret bool
CastShadows bool
DissolveFade bool
AssumeShadowmask bool
Glowmap bool
EnvironmentMappingWindow bool v<7
EnvironmentMappingEye bool v<7
Hair bool
HairTintColor color
Tree bool
Facegen bool
SkinTint bool
Tessellate bool
DisplacementTextureBias f32 v<3
DisplacementTextureScale f32 v<3
TessellationPnScale f32 v<3
TessellationBaseFactor f32 v<3
TessellationFadeDistance f32 v<3
GrayscaleToPaletteScale f32
SkewSpecularAlpha bool v>=1
Terrain bool v>=3
UnkInt1 u32 v==3 Terrain
TerrainThresholdFalloff f32 v>=3 Terrain
TerrainTilingDistance f32 v>=3 Terrain
TerrainRotationAngle f32 v>=3 Terrain
"""
BGEM = """
BaseTexture str
GrayscaleTexture str
EnvmapTexture str
NormalTexture str
EnvmapMaskTexture str
SpecularTexture str v>=11
LightingTexture str v>=11
GlowTexture str v>=11
GlassRoughnessScratch str v>=21
GlassDirtOverlay str v>=21
GlassEnabled bool v>=21
GlassFresnelColor color v>=21 GlassEnabled
GlassBlurScaleBase f32 v>=21 GlassEnabled
GlassBlurScaleFactor f32 v>=22 GlassEnabled
GlassRefractionScaleBase f32 v>=21 GlassEnabled
EnvironmentMapping bool v>=10
EnvironmentMappingMaskScale f32 v>=10
BloodEnabled bool
EffectLightingEnabled bool
FalloffEnabled bool
FalloffColorEnabled bool
GrayscaleToPaletteAlpha bool
SoftEnabled bool
BaseColor color
BaseColorScale f32
FalloffStartAngle f32
FalloffStopAngle f32
FalloffStartOpacity f32
FalloffStopOpacity f32
LightingInfluence f32
EnvmapMinLOD u8
SoftDepth f32
EmittanceColor color v>=11
AdaptativeEmissive_ExposureOffset f32 v>=15
AdaptativeEmissive_FinalExposureMin f32 v>=15
AdaptativeEmissive_FinalExposureMax f32 v>=15
Glowmap bool v>=16
EffectPbrSpecular bool v>=20
"""
BGSM_TEXTURE_FIELDS = {
    "DiffuseTexture": "DiffuseTexture",
    "NormalTexture": "NormalTexture",
    "SmoothSpecTexture": "SmoothSpecTexture",
    "GreyscaleTexture": "GreyscaleTexture",
    "EnvmapTexture": "EnvmapTexture",
    "GlowTexture": "GlowTexture",
    "InnerLayerTexture": "InnerLayerTexture",
    "WrinklesTexture": "WrinklesTexture",
}
BGEM_TEXTURE_FIELDS = {
    "DiffuseTexture": "BaseTexture",
    "NormalTexture": "NormalTexture",
    "SmoothSpecTexture": "SpecularTexture",
    "GreyscaleTexture": "GrayscaleTexture",
    "EnvmapTexture": "EnvmapTexture",
    "GlowTexture": "GlowTexture",
}
# -----------------------------------------------------------------------------------------------------------------

_CODES = {"bool": "?", "u8": "B", "u32": "I", "f32": "f", "color": "3f"}
_SQL_TYPES = {"bool": "boolean", "u8": "int", "u32": "bigint", "f32": "float", "color": "struct<r:float,g:float,b:float>", "str": "string"}
_COLOR = pa.struct([("r", pa.float32()), ("g", pa.float32()), ("b", pa.float32())])
_ARROW = {"bool": pa.bool_(), "u8": pa.int32(), "u32": pa.int64(), "f32": pa.float32(), "color": _COLOR, "str": pa.string()}
_COMPARE = {"<": lambda v, n: v < n, "<=": lambda v, n: v <= n, ">": lambda v, n: v > n, ">=": lambda v, n: v >= n, "==": lambda v, n: v == n}


def _parse(text: str) -> list[tuple[str, str, list[tuple[str, int | str]]]]:
    fields = []
    for line in text.split("\n"):
        if line:
            name, kind, *conditions = line.split()
            gates = []
            for c in conditions:
                op = c[1:].rstrip("0123456789") if c[0] == "v" else ""
                gates.append((op, int(c[1 + len(op) :])) if op else ("flag", c))
            fields.append((name, kind, gates))
    return fields


LAYOUTS = {"BGSM": _parse(HEADER) + _parse(BGSM), "BGEM": _parse(HEADER) + _parse(BGEM)}
KINDS = {name: kind for layout in LAYOUTS.values() for name, kind, _ in layout}
CATALOG_SCHEMA = "path string, mtype string, version bigint, error string, " + ", ".join(f"`{n}` {_SQL_TYPES[k]}" for n, k in KINDS.items())
_CATALOG_ARROW = pa.schema(
    [("path", pa.string()), ("mtype", pa.string()), ("version", pa.int64()), ("error", pa.string())]
    + [(n, _ARROW[k]) for n, k in KINDS.items()]
)


def _present(gates: list, version: int, record: dict) -> bool:
    return all(bool(record.get(arg)) if op == "flag" else _COMPARE[op](version, arg) for op, arg in gates)


def decode_material(content: bytes) -> dict:
    """One material file to its fields; raises on a bad signature or a short file."""
    signature, version = struct.unpack_from("<II", content, 0)
    mtype = next((m for m, s in SIGNATURES.items() if s == signature), None)
    if mtype is None:
        raise ValueError(f"invalid signature 0x{signature:08X}")
    record, at = {"mtype": mtype, "version": version}, 8
    for name, kind, gates in LAYOUTS[mtype]:
        if not _present(gates, version, record):
            continue
        if kind == "str":
            (size,) = struct.unpack_from("<I", content, at)
            if at + 4 + size > len(content):
                raise ValueError("file ends inside a string")
            record[name] = content[at + 4 : at + 4 + size].decode("utf-8")
            at += 4 + size
        else:
            code = "<" + _CODES[kind]
            values = struct.unpack_from(code, content, at)
            record[name] = dict(zip("rgb", values)) if kind == "color" else values[0]
            at += struct.calcsize(code)
    return record


def encode_material(record: dict) -> bytes:
    """Fields to file bytes. Missing values become 0, false, an empty string or white."""
    version = int(record["version"])
    out = [struct.pack("<II", SIGNATURES[record["mtype"]], version)]
    for name, kind, gates in LAYOUTS[record["mtype"]]:
        if not _present(gates, version, record):
            continue
        value = record.get(name)
        if kind == "str":
            raw = (value or "").encode("utf-8")
            out.append(struct.pack("<I", len(raw)) + raw)
        elif kind == "color":
            value = value or {"r": 1.0, "g": 1.0, "b": 1.0}
            out.append(struct.pack("<3f", value["r"], value["g"], value["b"]))
        else:
            cast = {"bool": bool, "f32": float}.get(kind, int)
            out.append(struct.pack("<" + _CODES[kind], cast(value or 0)))
    return b"".join(out)


_NUMBERS = {"bool": "?", "u8": "u1", "u32": "<u4", "f32": "<f4", "color": "<f4"}


def _take(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all (at, size) stretches one after the other, and where each begins and ends."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return data[np.repeat(at - ends[:-1], sizes) + np.arange(ends[-1])], ends


def _decode_group(data: np.ndarray, at: np.ndarray, end: np.ndarray, mtype: str, version: int) -> tuple[dict[str, tuple], np.ndarray]:
    """Files of one type and version, field by field: name to (rows that have the field, Arrow values), and which files could be read.

    ``at`` and ``end``: where the fields of each file begin and end in ``data``.
    """
    found, flags, at, good = {}, {}, at.copy(), np.ones(len(at), bool)
    for name, kind, gates in LAYOUTS[mtype]:
        if not all(_COMPARE[op](version, arg) for op, arg in gates if op != "flag"):
            continue
        has = good.copy()
        for arg in (arg for op, arg in gates if op == "flag"):
            has &= flags.get(arg, np.zeros(len(at), bool))
        size = 4 if kind == "str" else struct.calcsize("<" + _CODES[kind])
        good &= ~has | (at + size <= end)
        rows = np.flatnonzero(has & good)
        raw = data[at[rows, None] + np.arange(size)]
        at[rows] += size
        if kind == "str":
            sizes = raw.view("<u4")[:, 0].astype(np.int64) if len(rows) else np.zeros(0, np.int64)
            fits = at[rows] + sizes <= end[rows]
            good[rows[~fits]] = False
            rows, sizes = rows[fits], sizes[fits]
            text, ends = _take(data, at[rows], sizes)
            if ends[-1] and text.max() >= 128:  # beyond ASCII each string must be valid by itself
                for i, row in enumerate(rows):
                    try:
                        text[ends[i] : ends[i + 1]].tobytes().decode("utf-8")
                    except UnicodeDecodeError:
                        good[row] = False
            at[rows] += sizes
            values = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes())).cast(pa.large_binary())
        else:
            values = raw.view(_NUMBERS[kind]) if len(rows) else np.zeros((0, 3), _NUMBERS[kind])
            if kind == "bool":
                values = raw != 0
                flags[name] = np.zeros(len(at), bool)
                flags[name][rows] = values[:, 0]
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)], "rgb") if kind == "color" else pa.array(np.ascontiguousarray(values[:, 0])).cast(_ARROW[kind])
        found[name] = (rows, values)
    return found, good


def decode_materials(paths: pa.Array, contents: pa.Array) -> pa.RecordBatch:
    """Files to rows of the catalog. Files of one type and version are read together, a field at a time; those that can't be read give the error of :func:`decode_material`."""
    contents = contents.cast(pa.large_binary())
    bounds = np.frombuffer(contents.buffers()[1], np.int64)[contents.offset : contents.offset + len(contents) + 1] if len(contents) else np.zeros(1, np.int64)
    data = np.frombuffer(contents.buffers()[2], np.uint8) if len(contents) and contents.buffers()[2] else np.zeros(0, np.uint8)
    start, end = bounds[:-1], bounds[1:]
    heads = np.full((len(contents), 2), -1, np.int64)
    long_ = np.flatnonzero(end - start >= 8)
    if len(long_):
        heads[long_] = data[start[long_, None] + np.arange(8)].view("<u4")
    types, error = np.full(len(contents), None, object), np.full(len(contents), None, object)
    parts: dict[str, list[tuple]] = {}
    done = np.zeros(len(contents), bool)
    for mtype, signature in SIGNATURES.items():
        for version in np.unique(heads[heads[:, 0] == signature, 1]).tolist():
            rows = np.flatnonzero((heads[:, 0] == signature) & (heads[:, 1] == version))
            found, good = _decode_group(data, start[rows] + 8, end[rows], mtype, version)
            types[rows[good]], done[rows[good]] = mtype, True
            for name, (own, values) in found.items():
                kept = good[own]
                parts.setdefault(name, []).append((rows[own[kept]], values if kept.all() else values.filter(pa.array(kept))))
    for i in np.flatnonzero(~done).tolist():
        try:
            decode_material(contents[i].as_py())
            error[i] = "unreadable"
        except (ValueError, struct.error, UnicodeDecodeError, TypeError) as e:
            error[i] = str(e) or "unreadable"
    columns = [paths.cast(pa.string()), pa.array(types, pa.string()), pa.array(heads[:, 1], mask=~done), pa.array(error, pa.string())]
    for name, kind in KINDS.items():
        if name not in parts:
            columns.append(pa.nulls(len(contents), _ARROW[kind]))
            continue
        place = np.full(len(contents), -1, np.int64)
        rows = np.concatenate([r for r, _ in parts[name]])
        place[rows] = np.arange(len(rows))
        values = pa.concat_arrays([v for _, v in parts[name]]).take(pa.array(place, mask=place < 0))
        columns.append(values.cast(pa.binary()).cast(pa.string()) if kind == "str" else values)
    return pa.RecordBatch.from_arrays(columns, schema=_CATALOG_ARROW)


def encode_rows(records: pa.RecordBatch) -> pa.Array:
    """The files of a batch of records; those of one type and version are made together, a field at a time."""
    types, versions = records.column("mtype").to_pylist(), records.column("version").to_pylist()
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(types, versions)):
        groups.setdefault(key, []).append(i)
    made, order = [], []
    for (mtype, version), own in groups.items():
        made.append(_encode_group(records.take(pa.array(own)), mtype, int(version)))
        order += own
    if not made:
        return pa.array([], pa.binary())
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return pa.concat_arrays(made).take(pa.array(back))


def _encode_group(records: pa.RecordBatch, mtype: str, version: int) -> pa.Array:
    count, flags = len(records), {}
    names = [f.name for f in records.schema if not pa.types.is_null(f.type)]
    pieces: list[tuple[np.ndarray, np.ndarray]] = [(np.tile(np.frombuffer(struct.pack("<II", SIGNATURES[mtype], version), np.uint8), count), np.full(count, 8))]
    for name, kind, gates in LAYOUTS[mtype]:
        if not all(_COMPARE[op](version, arg) for op, arg in gates if op != "flag"):
            continue
        has = np.ones(count, bool)
        for arg in (arg for op, arg in gates if op == "flag"):
            has &= flags.get(arg, np.zeros(count, bool))
        column = records.column(name) if name in names else pa.nulls(count, _ARROW[kind])  # missing values are written as in :func:`encode_material`
        if kind == "str":
            text = column.fill_null("").cast(pa.large_string()) if name in names else pa.array([""] * count, pa.large_string())
            bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + count + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            sizes = np.where(has, np.diff(bounds), 0)
            pieces.append((np.ascontiguousarray(sizes[has].astype("<u4")).view(np.uint8), np.where(has, 4, 0)))
            pieces.append((_take(data, bounds[:-1], sizes)[0], sizes))
            continue
        if kind == "color":
            parts = [column.field(c) for c in "rgb"] if name in names else []
            white = column.is_null().to_numpy(zero_copy_only=False)
            values = np.column_stack([np.where(white, np.float32(1), p.fill_null(0).to_numpy(zero_copy_only=False)) for p in parts]) if parts else np.ones((count, 3))
        else:
            values = column.fill_null(False if kind == "bool" else 0).to_numpy(zero_copy_only=False) if name in names else np.zeros(count)
            if kind == "bool":
                values = values.astype(bool)
                flags[name] = values & has
            if kind in ("u8", "u32") and ((values[has] < 0) | (values[has] >= 1 << (8 if kind == "u8" else 32))).any():
                raise struct.error(f"{name} does not fit {kind}")
            values = values[:, None]
        raw = np.ascontiguousarray(values.astype(_NUMBERS[kind])[has]).view(np.uint8)
        pieces.append((raw.ravel(), np.where(has, raw.shape[1], 0)))
    # where each piece of each file goes
    sizes = np.column_stack([size for _, size in pieces])
    ends = np.concatenate([[0], sizes.sum(axis=1).cumsum()])
    starts = ends[:-1, None] + sizes.cumsum(axis=1) - sizes
    out = np.empty(ends[-1], np.uint8)
    for i, (raw, size) in enumerate(pieces):
        first = np.cumsum(size) - size
        out[np.repeat(starts[:, i] - first, size) + np.arange(len(raw))] = raw
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def material_catalog(files: DataFrame) -> DataFrame:
    """``path, content`` to one typed row per file; a corrupt file gives a row with ``error``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decode_materials(batch.column("path"), batch.column("content"))

    return files.select("path", "content").mapInArrow(read, CATALOG_SCHEMA)


def encode_materials(records: DataFrame, path_col: str = "out_path") -> DataFrame:
    """Typed rows (catalog columns; missing ones count as null) to ``path, content``."""
    names = ["mtype", "version", *[n for n in KINDS if n in records.columns]]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(path_col).cast(pa.string()), encode_rows(batch)], ["path", "content"])

    return records.select(path_col, *names).mapInArrow(write, "path string, content binary")


def material_json_text(records: DataFrame) -> DataFrame:
    """Rewritten JSON records to ``path, content`` (pretty, UTF-8)."""
    text = F.to_json("fields", {"pretty": "true"})
    return records.select(F.col("out_path").alias("path"), F.encode(text, "UTF-8").alias("content"))
