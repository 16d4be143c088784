"""Path and name expressions. Back-slashes count as separators; callers that must keep them say so."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: extensions, name suffixes and forbidden characters ---------------------------------------
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tga", ".bmp", ".tif", ".tiff", ".dds")
MATERIAL_EXTENSIONS = (".bgsm", ".bgem", ".json")
GREY_WORDS = ("greyscale", "grayscale", "grey", "gray", "bw", "mask")
PALETTE_WORD = "palette"
FORBIDDEN_IN_NAMES = r'[<>:"/\\|?*]+'
# -------------------------------------------------------------------------------------------------------------


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def parent_name(path: Column) -> Column:
    return basename(dirname(path))


def stem(path: Column) -> Column:
    """Base name without its last extension; leading dots are part of the name."""
    return F.regexp_replace(basename(path), r"^([.]*[^.].*)[.][^.]*$", "$1")


def extension(path: Column) -> Column:
    base = basename(path)
    return F.lower(F.substring(base, F.length(stem(path)) + 1, F.length(base)))


def csv_terms(csv: str | None) -> list[str]:
    return [t.strip() for t in (csv or "").lower().split(",") if t.strip()]


def any_substring(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for t in terms:
        hit = hit | text.contains(t)
    return hit


def first_substring(text: Column, terms: Sequence[str]) -> Column:
    """The first term (in list order) found in ``text``, else null."""
    return F.coalesce(*[F.when(text.contains(t), F.lit(t)) for t in terms if t], F.lit(None).cast("string"))


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a shell-style pattern: ``*``, ``?``, ``[set]``, ``[!set]``."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def normalize_key(path: Column, with_palette: bool = False) -> Column:
    """Pairing key: lower stem without trailing qualifiers, only ``a-z 0-9 _`` kept."""
    words = "|".join(GREY_WORDS + ((PALETTE_WORD,) if with_palette else ()))
    base = F.regexp_replace(F.lower(stem(path)), rf"(?:[\s_\-]?(?:{words}))+$", "")
    return F.regexp_replace(base, r"[^a-z0-9_]+", "")


def is_greyscale_name(path: Column) -> Column:
    return F.lower(stem(path)).rlike("(" + "|".join(GREY_WORDS) + ")$")


def is_palette_name(path: Column) -> Column:
    return F.lower(stem(path)).rlike(rf"(?:^|[\s_\-]){PALETTE_WORD}$")


def is_diffuse_texture(path: Column) -> Column:
    return basename(path).rlike(r"(?i)_d[.]dds$")


def sanitize_name(name: Column) -> Column:
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), FORBIDDEN_IN_NAMES, "")
    return F.btrim(F.btrim(F.regexp_replace(clean, r"\s+", " "), F.lit(" ")), F.lit("."))


def insert_folder(path: Column, folder: Column) -> Column:
    """Put ``folder`` right before the file name unless the directory already ends with ``/folder``."""
    q = slashed(path)
    d = dirname(q)
    moved = (
        F.when(~q.contains("/"), F.concat(folder, F.lit("/"), q))
        .when((d != "") & F.endswith(d, F.concat(F.lit("/"), folder)), q)
        .when(d == "", F.concat(folder, q))
        .otherwise(F.concat(d, F.lit("/"), folder, F.lit("/"), basename(q)))
    )
    return F.when(path.isNull() | (path == ""), path).otherwise(moved)


def texture_path_matches(slot_path: Column, texture_path: Column) -> Column:
    """Does the texture path end with the slot path, compared from ``textures\\`` on and without case?"""
    back = lambda p: F.lower(F.replace(p, F.lit("/"), F.lit("\\")))
    slot = back(F.coalesce(slot_path, F.lit("")))
    at = F.locate("textures\\", slot)
    tail = F.when(at > 0, F.substring(slot, at, F.length(slot))).otherwise(slot)
    return F.endswith(back(texture_path), tail)


def model_route(path: Column, textures_model: str, normals_model: str) -> Column:
    return F.when(F.endswith(F.lower(stem(path)), F.lit("_n")), normals_model).otherwise(textures_model)


def material_kind(content: Column) -> Column:
    """JSON, BGSM, BGEM or UNKNOWN from the first bytes of a file."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("7B") | head.startswith("5B"), "JSON")
        .when(head == "4247534D", "BGSM")
        .when(head == "4247454D", "BGEM")
        .otherwise("UNKNOWN")
    )


def archive_relpath(path: Column, root: str, has_data: Column | bool) -> Column:
    """Archive entry ``Data\\...`` of a path, null when it lies outside the data folder."""
    root = root.rstrip("/")
    parent = root.rsplit("/", 1)[0] + "/" if "/" in root else ""
    after = lambda prefix: F.substring(path, F.lit(len(prefix) + 1), F.length(path))
    if root.rsplit("/", 1)[-1] == "Data":
        rel = F.when(path.startswith(root + "/"), after(parent))
    else:
        inside = F.when(path.startswith(root + "/Data/"), after(root + "/"))
        rel = F.when(F.lit(has_data) if isinstance(has_data, bool) else has_data, inside).otherwise(
            F.concat(F.lit("Data/"), after(parent))
        )
    return F.replace(rel, F.lit("/"), F.lit("\\"))
