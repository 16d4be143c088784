"""Filters, pairing and lookup joins over path tables (``path``[, ``length``])."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import paths
from texelmill.session import cut_lineage

# ---- fixed values: mesh lookup ---------------------------------------------------------------------------------
ACTOR_FOLDERS = ("actor", "actors")
ARMOR_FOLDERS = ("armor", "powerarmor")
ARMOR_KEYWORDS = ("_leg", "_arm", "_head", "_helmet", "_body", "_torso")
ACTOR_ASSETS_FOLDER = "characterassets"
# ----------------------------------------------------------------------------------------------------------------


def scan_filter(files: DataFrame, extensions: Sequence[str], root: str | None = None, recursive: bool = True) -> DataFrame:
    """Files with a known extension, recursive below ``root`` or directly in it."""
    out = files.where(paths.extension(F.col("path")).isin(*extensions))
    if root is not None:
        base = root.rstrip("/") + "/"
        out = out.where(F.col("path").startswith(base))
        if not recursive:
            out = out.where(paths.dirname(F.col("path")) == root.rstrip("/"))
    return out


def filter_terms(files: DataFrame, include_csv: str = "", exclude_csv: str = "") -> DataFrame:
    """Case-insensitive substring filters on the file name; no include terms means all; exclude wins."""
    name = F.lower(paths.basename(F.col("path")))
    include, exclude = paths.csv_terms(include_csv), paths.csv_terms(exclude_csv)
    out = files.where(paths.any_substring(name, include)) if include else files
    return out.where(~paths.any_substring(name, exclude)) if exclude else out


def with_exclude_reason(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """``excluded_by``: the first pattern found in the lower-case file name, null when none."""
    low = [p.lower() for p in patterns]
    return files.withColumn("excluded_by", paths.first_substring(F.lower(paths.basename(F.col("path"))), low))


def ignore_dirs(files: DataFrame, root: str, globs: Sequence[str]) -> DataFrame:
    """Drop files below any directory whose relative path or last name matches a glob (case-sensitive)."""
    cleaned = [g.strip().replace("\\", "/").lstrip("./") for g in globs]
    patterns = [paths.glob_regex(g) for g in cleaned if g]
    if not patterns:
        return files
    prefix = root.rstrip("/") + "/" if root else ""
    rel = F.substring(paths.dirname(F.col("path")), F.lit(len(prefix) + 1), F.length("path"))
    names = F.filter(F.split(rel, "/"), lambda s: s != "")
    up_to = F.transform(names, lambda s, i: F.array_join(F.slice(names, F.lit(1), i + 1), "/"))

    def hit(d: Column) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | d.rlike(p)
        return found

    return files.where(~(F.exists(names, hit) | F.exists(up_to, hit)))


def skip_output_roots(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Drop paths equal to or below an output root; empty roots and ``.`` are ignored."""
    out = files
    for root in (r.strip("/") for r in roots):
        if root and root != ".":
            out = out.where(~((F.col("path") == root) | F.col("path").startswith(root + "/")))
    return out


def archive_entries(files: DataFrame, root: str) -> DataFrame:
    """Archive entry per file; files outside the data folder are dropped."""
    if root.rstrip("/").rsplit("/", 1)[-1] == "Data":
        has_data: Column | bool = True
    else:
        found = F.max(F.col("path").startswith(root.rstrip("/") + "/Data/"))
        has_data = files.agg(F.coalesce(found, F.lit(False)).alias("has_data")).scalar()
    out = files.select("path", paths.archive_relpath(F.col("path"), root, has_data).alias("entry"))
    return out.where(F.col("entry").isNotNull())


def manifest_lines(entries: DataFrame) -> DataFrame:
    """Manifest body as (entry, line): quoted, back-slashes doubled, a comma after every line but the last.

    The last entry is found by ``max``, not by a global window.
    """
    last = entries.agg(F.max("entry").alias("last")).scalar()
    text = F.concat(F.lit('\t"'), F.replace("entry", F.lit("\\"), F.lit("\\\\")), F.lit('"'))
    return entries.select("entry", F.concat(text, F.when(F.col("entry") == last, "").otherwise(",")).alias("line"))


# ---- pairing by normalized name --------------------------------------------------------------------------------


#: Greys of one name that meet its colours in one group.
PAIR_SHARD = 1024


def _keyed(files: DataFrame, with_palette: bool = False) -> DataFrame:
    return files.withColumn("key", paths.normalize_key(F.col("path"), with_palette))


def pair_textures(greys: DataFrame, colors: DataFrame, ordered: bool = True) -> DataFrame:
    """Every (grey, colour) pair whose normalized names agree, in their deterministic order, or in none without ``ordered``.

    Greys of a frequent name are dealt over shards of about PAIR_SHARD and its colours go to each of them, so a common name is
    many small groups; most names have one shard. The order sorts all pairs; whoever does not write the list can do without.
    """
    p = F.col("path")
    left = _keyed(greys).select("key", p.alias("grey_path"))
    right = _keyed(colors).select("key", p.alias("color_path"))
    shards = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PAIR_SHARD).cast("int").alias("_n"))
    left = left.join(shards, "key").withColumn("_shard", F.pmod(F.xxhash64("grey_path"), F.col("_n")).cast("int")).drop("_n")
    right = right.join(shards, "key").select("key", "color_path", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_shard"))
    pairs = left.join(right, ["key", "_shard"]).select("key", "grey_path", "color_path")
    if not ordered:
        return pairs
    g, c = F.col("grey_path"), F.col("color_path")
    return pairs.orderBy("key", F.lower(paths.parent_name(g)), F.lower(g), F.lower(paths.stem(c)), F.lower(paths.parent_name(c)), F.lower(c))


def unmatched_greys(greys: DataFrame, colors: DataFrame) -> DataFrame:
    return _keyed(greys).join(_keyed(colors).select("key").distinct(), "key", "left_anti").select("key", "path")


def _palette_keys(palettes: DataFrame) -> DataFrame:
    return _keyed(palettes, True).select("key", F.col("path").alias("palette_path"), paths.dirname(F.col("path")).alias("folder"))


def _files_by_folder(files: DataFrame) -> DataFrame:
    """Image files with their key, once for each of their own ancestor folders."""
    img = _keyed(files.where(paths.extension(F.col("path")).isin(*paths.IMAGE_EXTENSIONS)), True).select("key", "path")
    names = F.split(paths.dirname(F.col("path")), "/")
    folders = F.transform(names, lambda s, i: F.array_join(F.slice(names, F.lit(1), i + 1), "/"))
    return img.select("key", "path", F.explode(folders).alias("folder"))


def detect_greyscale(palettes: DataFrame, files: DataFrame) -> DataFrame:
    """The grey image of each palette: same folder first, then the shortest path, then the alphabet.

    Greys are reduced to the best one per (key, folder) before palettes meet them; only a palette that itself carries a
    grey-like name must skip itself and looks at its candidates one by one.
    """
    p = F.col("path")
    far = (paths.dirname(p) != F.col("folder")).cast("int")
    rank = F.struct(far.alias("far"), F.length("path").alias("n"), F.lower("path").alias("low"), "path")
    greys = _files_by_folder(files).where(paths.is_greyscale_name(p))
    best = greys.groupBy("key", "folder").agg(F.min(rank)["path"].alias("grey_path"))
    pal = _palette_keys(palettes)
    odd = paths.is_greyscale_name(F.col("palette_path"))
    plain = pal.where(~odd).join(best, ["key", "folder"]).select("palette_path", "grey_path")
    own = pal.where(odd).join(greys, ["key", "folder"]).where(p != F.col("palette_path"))
    return plain.unionByName(own.groupBy("palette_path").agg(F.min(rank)["path"].alias("grey_path")))


def detect_textures(palettes: DataFrame, files: DataFrame) -> DataFrame:
    """Colour textures of each palette: strictly below its folder, neither grey-like nor palette-like names.

    A file meets only palettes of its key in its own ancestor folders (equi join on key and folder).
    """
    p = F.col("path")
    below = _files_by_folder(files).where(paths.dirname(p) != F.col("folder"))
    kept = below.where(~paths.is_greyscale_name(p) & ~paths.is_palette_name(p))
    found = _palette_keys(palettes).join(kept, ["key", "folder"]).where(p != F.col("palette_path"))
    return found.select("palette_path", p.alias("texture_path"))


def locate_group_files(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Per group: its palette ``<group>_palette`` (DDS preferred), its grey images and an error when no palette exists.

    Files are cut down to candidate names first and then meet their group by an equi join on the name.
    """
    img = files.where(paths.extension(F.col("path")).isin(*paths.IMAGE_EXTENSIONS))
    name = F.lower(paths.stem(F.col("path")))
    pal = img.where(name.endswith("_palette")).select(F.regexp_replace(name, "_palette$", "").alias("low"), "path")
    g = groups.select("group_name", F.lower("group_name").alias("low"))
    rank = F.struct((paths.extension(F.col("path")) != ".dds").cast("int").alias("o"), "path")
    best = pal.join(g, "low").groupBy("group_name").agg(F.min(rank)["path"].alias("palette_path"))
    # group names may contain '_': a grey stem offers every tail after an underscore as its group
    body = F.regexp_replace(name, "_greyscale$", "")
    parts = F.split(body, "_")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "_"))
    grey = img.where(name.endswith("_greyscale") & (F.size(parts) >= 2)).select("path", F.explode(tails).alias("low"))
    counts = grey.join(g, "low").groupBy("group_name").agg(F.count_distinct("path").alias("greys"))
    out = groups.select("group_name").join(best, "group_name", "left").join(counts, "group_name", "left")
    error = F.when(F.col("palette_path").isNull(), F.concat(F.lit("palette not found: "), F.col("group_name"), F.lit("_palette")))
    return out.select("group_name", "palette_path", F.coalesce("greys", F.lit(0).cast("long")).alias("greys"), error.alias("error"))


# ---- mesh lookup -----------------------------------------------------------------------------------------------


def first_with_prefix(names: DataFrame, asks: DataFrame, ending: str) -> DataFrame:
    """``dir, stem, file, value``: the first file (smallest ``name + ending``) of a folder whose name begins with the stem; asks without one are left out.

    ``names``: dir, name, value (the smallest of equal names counts); ``asks``: dir, stem. An empty stem finds nothing.

    Names and stems go into one order of (dir, key), cut into ranges. The files that begin with a stem follow it at once, so the
    next file in the order decides; across the end of a range it is the first file of the next range that has one, one carried row
    per range. Each name and each stem is shuffled as one row, however long it is.
    """
    file = F.concat("name", F.lit(ending))
    own = names.groupBy("dir", file.alias("key")).agg(F.min("value").alias("value"))
    asks = asks.where("dir is not null and stem <> ''").select("dir", "stem").distinct()
    # a stem that reaches into the ending meets one file whose name is too short for it: it is asked again from behind that file
    into = [ending[:n] for n in range(1, len(ending) + 1)]
    behind = F.array(*[F.when(F.endswith("stem", F.lit(e)), F.concat(F.expr(f"left(stem, char_length(stem) - {len(e)})"), F.lit(ending + "\0"))) for e in into])
    starts = F.concat(F.array("stem"), F.filter(behind, lambda b: b.isNotNull()))
    asked = asks.select("dir", "stem", F.explode(starts).alias("key"))
    rows = own.where("dir is not null and key is not null").select("dir", "key", F.lit(None).cast("string").alias("stem"), F.struct("dir", F.col("key").alias("file"), "value").alias("hit"))
    rows = rows.unionByName(asked.withColumn("hit", F.lit(None).cast(rows.schema["hit"].dataType)))
    # written, so that the bounds of the ranges cannot move between the two reads
    ranged = cut_lineage(rows.repartitionByRange("dir", "key").withColumn("part", F.spark_partition_id()))
    heads = ranged.groupBy("part").agg(F.min("hit").alias("head"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    heads = heads.select("part", F.last("head", ignorenulls=True).over(later).alias("after"))
    # from the last key to the first, files before the stems equal to them
    order = Window.partitionBy("part").orderBy(F.desc("dir"), F.desc("key"), F.col("stem").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("next", F.last("hit", ignorenulls=True).over(order)).where("stem is not null").join(heads, "part", "left")
    found = found.select("dir", "stem", F.coalesce("next", "after").alias("hit"))
    fits = (F.col("hit.dir") == F.col("dir")) & F.startswith(F.col("hit.file"), F.col("stem")) & (F.length("hit.file") - len(ending) >= F.length("stem"))
    best = found.where(fits).groupBy("dir", "stem").agg(F.min("hit").alias("hit"))
    return best.select("dir", "stem", "hit.file", "hit.value")


def find_mesh(textures: DataFrame, meshes: DataFrame, data_root: str) -> DataFrame:
    """First mesh of each texture below ``<data_root>/Textures``, null when there is none. Compared without case.

    Rules in order: body-part keywords for armour names, ``<stem>_1.nif``, ``<stem>.nif``, ``<stem>*.nif``; actor paths
    try the assets sub-folder first. Meshes are indexed by (folder, name) and (folder, keyword) keeping only the first, and
    the last rule takes the next name in one order of names and stems, so a folder full of meshes never meets a folder full
    of textures pair by pair.
    """
    base = data_root.rstrip("/").lower()
    path = F.lower(F.col("path"))
    tex_root, mesh_root = base + "/textures/", base + "/meshes/"
    rel = F.substring(path, F.lit(len(tex_root) + 1), F.length(path))
    tex = textures.select("path").distinct().where(path.startswith(tex_root)).select(
        "path", paths.dirname(rel).alias("rel_dir"), F.regexp_replace(paths.stem(rel), "_d$", "").alias("stem")
    )
    folders = F.split("rel_dir", "/")
    in_any = lambda words: F.exists(folders, lambda s: s.isin(*words))
    home = F.regexp_replace(F.concat(F.lit(mesh_root), F.col("rel_dir")), "/$", "")
    where_to = F.when(in_any(ACTOR_FOLDERS), F.array(F.concat(home, F.lit("/" + ACTOR_ASSETS_FOLDER)), home)).otherwise(F.array(home))
    asks = tex.select("path", "stem", in_any(ARMOR_FOLDERS).alias("armor"), F.posexplode(where_to).alias("dir_no", "dir"))

    mesh_path = F.lower(F.col("path"))
    mesh = meshes.where(mesh_path.endswith(".nif")).select(
        F.col("path").alias("mesh_path"), paths.dirname(mesh_path).alias("dir"), F.regexp_replace(paths.basename(mesh_path), "[.]nif$", "").alias("name")
    )
    first = F.min(F.struct(F.concat("name", F.lit(".nif")).alias("file"), "mesh_path")).alias("hit")

    # keyword pass
    words = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(k).alias("word")) for i, k in enumerate(ARMOR_KEYWORDS)])
    has = lambda text: F.filter(words, lambda k: F.contains(F.col(text), k["word"]))
    key_index = mesh.select("dir", "name", "mesh_path", F.explode(has("name")).alias("k")).groupBy("dir", F.col("k.word").alias("word")).agg(first)
    key_asks = asks.where("armor").select("path", "dir", "dir_no", F.explode(has("stem")).alias("k"))
    by_key = key_asks.select("path", "dir", "dir_no", "k.no", "k.word").join(key_index, ["dir", "word"])
    hits = by_key.select("path", F.struct(F.lit(0).alias("pass"), "dir_no", F.col("no").alias("rule"), "hit.mesh_path").alias("h"))

    # direct pass: two whole names, then the first name that begins with the stem
    whole = mesh.groupBy("dir", "name").agg(F.min("mesh_path").alias("mesh_path"))
    rules = F.array(F.struct(F.lit(0).alias("rule"), F.concat("stem", F.lit("_1")).alias("name")), F.struct(F.lit(1).alias("rule"), F.col("stem").alias("name")))
    direct = asks.select("path", "dir", "dir_no", F.explode(rules).alias("q")).select("path", "dir", "dir_no", "q.rule", "q.name")
    found = direct.join(whole, ["dir", "name"]).select("path", "dir_no", "rule", "mesh_path")
    longer = first_with_prefix(mesh.withColumnRenamed("mesh_path", "value"), asks, ".nif").withColumnRenamed("value", "mesh_path")
    found = found.unionByName(asks.join(longer, ["dir", "stem"]).select("path", "dir_no", F.lit(2).alias("rule"), "mesh_path"))
    hits = hits.unionByName(found.select("path", F.struct(F.lit(1).alias("pass"), "dir_no", "rule", "mesh_path").alias("h")))
    best = hits.groupBy("path").agg(F.min("h").alias("h"))
    return textures.select("path").distinct().join(best, "path", "left").select("path", F.col("h.mesh_path").alias("mesh_path"))


def resolve_diffuse(slots: DataFrame, materials: DataFrame) -> DataFrame:
    """Texture behind a diffuse slot: a ``.dds`` is itself, a material gives its diffuse texture or ``..._d.dds``.

    ``slots``: slot_path; ``materials``: path, DiffuseTexture.
    """
    slot = paths.slashed(F.col("slot_path"))
    ext = paths.extension(slot)
    named = slots.withColumn("_key", F.lower(slot))
    known = materials.select(F.lower(paths.slashed(F.col("path"))).alias("_key"), F.col("DiffuseTexture").alias("_diffuse"))
    known = known.groupBy("_key").agg(F.min("_diffuse").alias("_diffuse"))
    guess = F.replace(slot, F.lit(".bgsm"), F.lit("_d.dds"))
    return named.join(known, "_key", "left").select(
        *slots.columns, F.when(ext == ".dds", slot).when(ext == ".bgsm", F.coalesce("_diffuse", guess)).alias("diffuse")
    )


def diffuse_textures(files: DataFrame) -> DataFrame:
    return files.where(paths.is_diffuse_texture(F.col("path")))


def plan_product(files: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Every file with every value of a short literal list (sizes, folders)."""
    return files.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))

