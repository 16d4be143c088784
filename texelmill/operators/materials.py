"""Material records: type detection, texture-path rewriting and the run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texelmill.functions import paths
from texelmill.operators.pathops import plan_product, with_exclude_reason

# ---- fixed values: logical texture names and the JSON keys / binary fields they mean ------------------------
BGSM_KEYS = {
    "DiffuseTexture": "sDiffuseTexture",
    "NormalTexture": "sNormalTexture",
    "SmoothSpecTexture": "sSmoothSpecTexture",
    "GreyscaleTexture": "sGreyscaleTexture",
    "EnvmapTexture": "sEnvmapTexture",
    "GlowTexture": "sGlowTexture",
    "InnerLayerTexture": "sInnerLayerTexture",
    "WrinklesTexture": "sWrinklesTexture",
}
BGEM_KEYS = {
    "DiffuseTexture": "sBaseTexture",
    "NormalTexture": "sNormalTexture",
    "SmoothSpecTexture": "sSpecularTexture",
    "GreyscaleTexture": "sGrayscaleTexture",
    "EnvmapTexture": "sEnvmapTexture",
    "GlowTexture": "sGlowTexture",
}
SCALE_KEY = "fGrayscaleToPaletteScale"
# --------------------------------------------------------------------------------------------------------------


def field_text(key: str) -> Column:
    """A field of ``fields`` as text; null when it is missing."""
    return F.try_variant_get(F.col("fields")[key], "$", "string")


def read_material_json(records: DataFrame) -> DataFrame:
    """``path, value`` to ``path, fields`` (map of typed JSON values), ``mtype`` and ``error``; malformed text keeps its row.

    Text after the object, an object inside anything else and repeated keys count as malformed.
    """
    # within brackets, so that anything after the object shows
    alone = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    good = alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()
    fields = F.when(good, F.from_json("value", "map<string,variant>"))
    out = records.withColumn("fields", fields)
    has = lambda k: F.map_contains_key("fields", k)
    mtype = (
        F.when(F.col("fields").isNull(), None)
        .when(has("sDiffuseTexture") | has("sSmoothSpecTexture"), "BGSM")
        .when(has("sBaseTexture"), "BGEM")
        .otherwise("BGSM")
    )
    error = F.when(F.col("fields").isNull(), F.lit("malformed json"))
    return out.select(*[c for c in records.columns if c != "value"], "fields", mtype.alias("mtype"), error.alias("error"))


def _keys(mapping: dict[str, str], selected: Sequence[str] | None) -> list[str]:
    return [k for name, k in mapping.items() if not selected or name in selected]


def rewrite_material_json(
    materials: DataFrame,
    folders: Sequence[str],
    selected: Sequence[str] | None = None,
    scale: float | None = None,
    out_root: str = "",
) -> DataFrame:
    """One row per material and folder with the chosen texture paths moved into the folder.

    ``scale`` sets the palette scale of BGSM records when above zero.
    """
    plan = plan_product(materials.where(F.col("fields").isNotNull()), list(folders), "folder")

    def moved(keys: list[str]) -> Column:
        def one(k: Column, v: Column) -> Column:
            text = F.try_variant_get(v, "$", "string")
            path = k.isin(*keys) & (F.schema_of_variant(v) == "STRING") & (text != "")
            return F.when(path, paths.insert_folder(text, F.col("folder")).cast("variant")).otherwise(v)

        return F.transform_values("fields", one)

    out = F.when(F.col("mtype") == "BGEM", moved(_keys(BGEM_KEYS, selected))).otherwise(moved(_keys(BGSM_KEYS, selected)))
    if scale is not None and scale > 0:
        number = F.lit(float(scale)).cast("variant")
        placed = F.transform_values("fields", lambda k, v: F.when(k == SCALE_KEY, number).otherwise(v))
        scaled = F.when(F.map_contains_key("fields", SCALE_KEY), placed).otherwise(F.map_concat("fields", F.create_map(F.lit(SCALE_KEY), number)))
        plan = plan.withColumn("fields", F.when(F.col("mtype") == "BGSM", scaled).otherwise(F.col("fields")))
    return plan.select("path", "mtype", "folder", out.alias("fields"), output_path(F.col("path"), F.col("folder"), out_root).alias("out_path"))


def output_path(path: Column, folder: Column, out_root: str) -> Column:
    root = F.lit(out_root.rstrip("/")) if out_root else paths.dirname(path)
    return F.concat_ws("/", F.when(root != "", root), folder, paths.basename(path))


def rewrite_material_record(records: DataFrame, mapping: dict[str, str], folders: Sequence[str], selected: Sequence[str] | None = None, scale: float | None = None, out_root: str = "") -> DataFrame:
    """Binary records (typed columns, one per field) rewritten the same way; ``mapping``: logical name -> column."""
    plan = plan_product(records, list(folders), "folder")
    columns = [c for name, c in mapping.items() if (not selected or name in selected) and c in records.columns]
    plan = plan.withColumns({c: F.when(F.col(c) != "", paths.insert_folder(F.col(c), F.col("folder"))).otherwise(F.col(c)) for c in columns})
    if scale is not None and scale > 0 and "GrayscaleToPaletteScale" in records.columns:
        plan = plan.withColumn("GrayscaleToPaletteScale", F.lit(float(scale)).cast("float"))
    return plan.withColumn("out_path", output_path(F.col("path"), F.col("folder"), out_root))


def with_outcome(files: DataFrame, exclude: Sequence[str] = (), include_bgsm: bool = True, include_bgem: bool = True) -> DataFrame:
    """Outcome per scanned file. ``files``: path, kind (JSON/BGSM/BGEM/UNKNOWN), mtype (of JSON), error."""
    tagged = with_exclude_reason(files, exclude)
    type_ = F.when(F.col("kind") == "JSON", F.col("mtype")).otherwise(F.col("kind"))
    wanted = F.when(type_ == "BGSM", include_bgsm).when(type_ == "BGEM", include_bgem).otherwise(True)
    outcome = (
        F.when(F.col("excluded_by").isNotNull(), "excluded")
        .when(F.col("kind") == "UNKNOWN", "unknown")
        .when(F.col("error").isNotNull(), "error")
        .when(~wanted, "filtered")
        .when(F.col("kind") == "JSON", F.concat(F.lit("json_"), F.lower("mtype")))
        .otherwise(F.lower("kind"))
    )
    return tagged.withColumn("outcome", outcome)


def run_summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of a run from its ``outcome`` column; excluded files also count as filtered."""
    o = F.col("outcome")
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(o == "bgsm").alias("processed_bgsm"),
        F.count_if(o == "bgem").alias("processed_bgem"),
        F.count_if(o == "json_bgsm").alias("processed_json_bgsm"),
        F.count_if(o == "json_bgem").alias("processed_json_bgem"),
        F.count_if(o.isin("filtered", "excluded")).alias("skipped_filtered"),
        F.count_if(o == "excluded").alias("skipped_excluded"),
        F.count_if(o == "unknown").alias("skipped_unknown"),
        F.count_if(o == "error").alias("errors"),
    )
