"""Named queries: path tables, materials, headers, list rows, plugin records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelmill.functions import paths, tokens
from texelmill.operators import materials, ordering, pathops, plugins, resize, subgraph
from texelmill.plans import check_sql as c
from texelmill.plans.registry import query
from texelmill.plans.views import Tables
from texelmill.sources import assets, tables
from texelmill.sources import materials as material_files
from texelmill.sources import plugins as plugin_files

P = "path"
BASE = "split_part(path,'/',-1)"
EXT_SQL = f"lower(substr({BASE}, length({c.stem(P)})+1))"
IMAGE_EXTS = "('.png','.jpg','.jpeg','.tga','.bmp','.tif','.tiff','.dds')"


# ---- scans and filters ------------------------------------------------------------------------------------------------


@query("a01_scan_assets", c.q(("assets",), f"select path, length from assets where {EXT_SQL} in ('.dds','.tga') and starts_with(path,'Mods/Data/')"))
def a01(t: Tables) -> DataFrame:
    return pathops.scan_filter(t("assets"), (".dds", ".tga"), "Mods/Data")


@query("a01_scan_assets_flat", c.q(("assets",), f"select path, length from assets where {EXT_SQL} in {IMAGE_EXTS} and {c.dirname(P)}='Mods/Data/Textures/Brand7'"))
def a01f(t: Tables) -> DataFrame:
    return pathops.scan_filter(t("assets"), paths.IMAGE_EXTENSIONS, "Mods/Data/Textures/Brand7", recursive=False)


MATERIAL_PATHS = "case when p_partkey%3=0 then 'Materials/' else 'Materials/sub/' end || 'm' || p_partkey || case p_partkey%4 when 0 then '.BGSM' when 1 then '.bgem' when 2 then '.Json' else '.txt' end"


@query(
    "a02_scan_materials",
    f"select path from (select {MATERIAL_PATHS} as path from part) where lower(path) similar to '.*[.](bgsm|bgem|json)' and {c.dirname(P)}='Materials'",
)
def a02(t: Tables) -> DataFrame:
    files = t.raw("part").select(F.expr(MATERIAL_PATHS).alias("path"))
    return pathops.scan_filter(files, paths.MATERIAL_EXTENSIONS, "Materials", recursive=False)


JSON_SQL = (
    "select path, case when not json_valid(value) then null when contains(value,'\"sDiffuseTexture\"') or contains(value,'\"sSmoothSpecTexture\"') then 'BGSM'"
    " when contains(value,'\"sBaseTexture\"') then 'BGEM' else 'BGSM' end as mtype, case when not json_valid(value) then 'malformed json' end as error,"
    + ", ".join(f"case when json_valid(value) then json_extract_string(value,'$.{k}') end as {k}" for k in ("sDiffuseTexture", "sBaseTexture", "sNormalTexture", "fGrayscaleToPaletteScale"))
    + " from material_json"
)
JSON_KEYS = ("sDiffuseTexture", "sBaseTexture", "sNormalTexture", "fGrayscaleToPaletteScale")


@query("a03_read_material_json", c.q(("material_json",), JSON_SQL))
def a03(t: Tables) -> DataFrame:
    df = materials.read_material_json(t("material_json"))
    return df.select("path", "mtype", "error", *[materials.field_text(k).alias(k) for k in JSON_KEYS])


HEADERS_SQL = """select path, case when good then w end::int as width, case when good then h end::int as height, case when good then k%3<>0 end as is_dx10,
 case when good and k%3<>0 then case k%4 when 0 then 98 when 1 then 99 else 77 end end::int as dxgi,
 good and k%3<>0 and k%4<2 as is_bc7, good and k%3<>0 and k%4=0 as is_bc7_linear from (select *, substr(content_hex,1,8)='44445320' as good,
 cast(regexp_extract(path,'([0-9]+)',1) as bigint) as k from texture_bytes)"""


def headers(t: Tables) -> DataFrame:
    return assets.texture_headers(t("texture_bytes").select("path", F.unhex("content_hex").alias("content")))


@query("a06_texture_headers", c.q(("texture_bytes",), HEADERS_SQL))
def a06(t: Tables) -> DataFrame:
    return headers(t)


LINES_SQL = (
    "select row_id, case when row_id%50=0 then role||chr(9)||perspective when row_id%50=1 then '  ' else"
    " concat_ws(chr(9), role, perspective, actor_kw, target_kw, behavior, anim_paths) || case when row_id%7=0 then chr(9)||'more' else '' end end as value from subgraph"
)


@query(
    "a07_read_subgraph",
    c.q(
        ("subgraph",),
        "select row_id, role, perspective, actor_kw, target_kw, behavior, anim_paths, case when row_id%7=0 then 'more' else '' end as rest from subgraph where row_id%50>1",
    ),
)
def a07(t: Tables) -> DataFrame:
    rows = t("subgraph")
    tab = F.lit("\t")
    line = F.concat_ws("\t", *tables.COLUMNS)
    line = F.when(F.col("row_id") % 7 == 0, F.concat(line, F.lit("\tmore"))).otherwise(line)
    line = F.when(F.col("row_id") % 50 == 0, F.concat(F.col("role"), tab, F.col("perspective"))).when(F.col("row_id") % 50 == 1, F.lit("  ")).otherwise(line)
    parsed = tables.parse_subgraph(rows.select("row_id", line.alias("value")))
    return parsed.withColumn("rest", F.array_join("rest", "\t"))


ENTRY_SQL = "select path, replace(substr(path, 6), '/', chr(92)) as entry from assets where starts_with(path,'Mods/Data/')"


@query("b05_archive_relpath", c.q(("assets",), ENTRY_SQL))
def b05(t: Tables) -> DataFrame:
    return pathops.archive_entries(t("assets"), "Mods")


@query("b05_archive_relpath_nodata", c.q(("assets",), "select path, 'Data'||chr(92)||replace(substr(path, 11), '/', chr(92)) as entry from assets"))
def b05n(t: Tables) -> DataFrame:
    return pathops.archive_entries(t("assets"), "Mods/Data/Textures")


@query(
    "a10_write_manifest",
    c.q(
        ("assets",),
        "select entry, chr(9)||'\"'||replace(entry,chr(92),chr(92)||chr(92))||'\"'||case when row_number() over (order by entry desc)=1 then '' else ',' end as line from e",
        ("e", ENTRY_SQL),
    ),
)
def a10(t: Tables) -> DataFrame:
    return pathops.manifest_lines(pathops.archive_entries(t("assets"), "Mods").select("entry"))


@query(
    "a11_output_names",
    c.q(("assets",), f"select path, {c.stem(P)}||'_My Set_greyscale' as greyscale_name, {c.stem(P)}||'_My Set_quant' as quant_name, {c.stem(P)}||'_My Set_palette' as palette_name from assets"),
)
def a11(t: Tables) -> DataFrame:
    return assets.output_names(t("assets"), "My  Set?.")


UVW_SQL = "select shape_id, cast(row_number() over (partition by shape_id order by tri_id)-1 as int) as tri_id, u0, v0, u1, v1, u2, v2 from triangles"


@query("a12_read_uv_triangles", c.q(("triangles",), UVW_SQL))
def a12(t: Tables) -> DataFrame:
    corners = F.array(*[F.array(F.col(f"u{k}"), F.col(f"v{k}")) for k in range(3)])
    packed = t("triangles").groupBy("shape_id").agg(F.array_sort(F.collect_list(F.struct("tri_id", corners.alias("c")))).alias("all"))
    uvs = F.flatten(F.transform("all", lambda e: e["c"]))
    tris = F.transform(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.array(i * 3, i * 3 + 1, i * 3 + 2))
    text = F.to_json(F.struct(uvs.alias("uvs"), tris.alias("tris")))
    return tables.read_uv_triangles(packed.select("shape_id", text.alias("value")))


@query(
    "b01_filter_terms",
    c.q(("assets",), f"select * from assets where (contains(lower({BASE}),'red') or contains(lower({BASE}),'_d.')) and not contains(lower({BASE}),'gold') and not contains(lower({BASE}),'palette')"),
)
def b01(t: Tables) -> DataFrame:
    return pathops.filter_terms(t("assets"), "RED, _d.", "gold,Palette")


@query(
    "b02_exclude_patterns",
    c.q(("assets",), f"select *, case when contains(lower({BASE}),'_n.') then '_n.' when contains(lower({BASE}),'bolt') then 'bolt' when contains(lower({BASE}),'red') then 'red' end as excluded_by from assets"),
)
def b02(t: Tables) -> DataFrame:
    return pathops.with_exclude_reason(t("assets"), ["_N.", "bolt", "", "red"])


@query(
    "b03_ignore_dirs",
    c.q(
        ("assets",),
        f"select * from assets where not regexp_matches(substr({c.dirname(P)}, 11), '(^|/)(promo|Brand1.|s[^lm][^/]*)(/|$)') and not regexp_matches(substr({c.dirname(P)}, 11), '^Textures/Brand2(/|$)')",
    ),
)
def b03(t: Tables) -> DataFrame:
    return pathops.ignore_dirs(t("assets"), "Mods/Data", ["promo", "Brand1?", "./Textures\\Brand2", " ", "s[!lm]*"])


@query(
    "b04_skip_output_roots",
    c.q(("assets",), "select * from assets where not starts_with(path,'Mods/Data/Textures/Brand1/') and not starts_with(path,'Mods/Data/Textures/Brand25/')"),
)
def b04(t: Tables) -> DataFrame:
    return pathops.skip_output_roots(t("assets"), ["Mods/Data/Textures/Brand1", ".", "", "Mods/Data/Textures/Brand25/"])


@query("b06_normalize_key", c.q(("assets",), f"select path, {c.norm_key(P)} as key, {c.norm_key(P, True)} as pal_key from assets"))
def b06(t: Tables) -> DataFrame:
    p = F.col("path")
    return t("assets").select("path", paths.normalize_key(p).alias("key"), paths.normalize_key(p, True).alias("pal_key"))


GREY_SQL = rf"regexp_matches(lower({c.stem(P)}), '(greyscale|grayscale|grey|gray|bw|mask)$')"
PAL_SQL = rf"regexp_matches(lower({c.stem(P)}), '(?:^|[\s_\-])palette$')"


@query("b07_name_kinds", c.q(("assets",), f"select path, {GREY_SQL} as is_grey, {PAL_SQL} as is_palette from assets"))
def b07(t: Tables) -> DataFrame:
    p = F.col("path")
    return t("assets").select("path", paths.is_greyscale_name(p).alias("is_grey"), paths.is_palette_name(p).alias("is_palette"))


NAME_SQL = "case when p_partkey%3=0 then '  ' else '' end || p_name || case p_partkey%4 when 0 then ' <a>:  b.' when 1 then '?*x ' when 2 then '|/y..' else chr(92) || '\"z' end"


@query(
    "b08_sanitize_name",
    rf"""select p_partkey, trim(trim(regexp_replace(regexp_replace(n, '[<>:"/\\|?*]+', '', 'g'), '\s+', ' ', 'g'), ' '), '.') as clean from (select p_partkey, {NAME_SQL} as n from part)""",
)
def b08(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", paths.sanitize_name(F.expr(NAME_SQL)).alias("clean"))


MOVED_SQL = (
    "select path, p, " + c.insert_folder("p", "'gold'") + " as moved from (select path, coalesce(sDiffuseTexture, sNormalTexture) as p from j union all select path, sNormalTexture from j)"
)


@query("b09_insert_folder", c.q(("material_json",), MOVED_SQL, ("j", JSON_SQL)))
def b09(t: Tables) -> DataFrame:
    fields = materials.read_material_json(t("material_json"))
    one = fields.select("path", F.coalesce(materials.field_text("sDiffuseTexture"), materials.field_text("sNormalTexture")).alias("p"))
    both = one.unionByName(fields.select("path", materials.field_text("sNormalTexture").alias("p")))
    return both.select("path", "p", paths.insert_folder(F.col("p"), F.lit("gold")).alias("moved"))


SLOTS = "case p_partkey%4 when 0 then 'Textures/x'||p_partkey||'_d.DDS' when 3 then 'Textures/y.png' else 'Materials'||chr(92)||'m'||p_partkey||'.bgsm' end"


@query(
    "b10_resolve_diffuse",
    f"select slot_path, case when k%4=0 then slot_path when k%4=3 then null when k%5<3 then 'Weapons/d'||k||'_d.dds' else 'Materials/m'||k||'_d.dds' end as diffuse from (select p_partkey as k, {SLOTS} as slot_path from part)",
)
def b10(t: Tables) -> DataFrame:
    part = t.raw("part")
    slots = part.select(F.expr(SLOTS).alias("slot_path"))
    known = part.selectExpr("case when p_partkey%5<3 then 'MATERIALS/m' else 'Other/m' end||p_partkey||'.bgsm' as path", "'Weapons/d'||p_partkey||'_d.dds' as DiffuseTexture")
    return pathops.resolve_diffuse(slots, known)


@query(
    "b11_texture_path_matches",
    c.q(("textures",), "select path, slot, ends_with(replace(lower(path),'/',chr(92)), case when contains(lower(slot),'textures'||chr(92)) then substr(lower(slot), strpos(lower(slot),'textures'||chr(92))) else lower(slot) end) as matches"
        " from (select path, 'D:'||chr(92)||replace(case when length(path)%3=0 then upper(substr(path,6)) when length(path)%3=1 then substr(path,20) else path||'x' end,'/',chr(92)) as slot from textures)"),
)
def b11(t: Tables) -> DataFrame:
    p = F.col("path")
    n = F.length(p) % 3
    tail = F.when(n == 0, F.upper(F.substring(p, 6, 4000))).when(n == 1, F.substring(p, 20, 4000)).otherwise(F.concat(p, F.lit("x")))
    slot = F.concat(F.lit("D:\\"), F.replace(tail, F.lit("/"), F.lit("\\")))
    return t("textures").select("path", slot.alias("slot"), paths.texture_path_matches(slot, p).alias("matches"))


@query("b13_route_by_suffix", c.q(("assets",), f"select path, case when ends_with(lower({c.stem(P)}),'_n') then 'normals' else 'textures' end as model from assets"))
def b13(t: Tables) -> DataFrame:
    return t("assets").select("path", paths.model_route(F.col("path"), "textures", "normals").alias("model"))


HEAD_HEX = "case p_partkey%5 when 0 then '4247534D02000000' when 1 then '4247454D' when 2 then '7B2273' when 3 then '5B' else '424753' end"


@query(
    "b14_detect_material_type",
    "select p_partkey, case p_partkey%5 when 0 then 'BGSM' when 1 then 'BGEM' when 4 then 'UNKNOWN' else 'JSON' end as kind from part",
)
def b14(t: Tables) -> DataFrame:
    return t.raw("part").select("p_partkey", paths.material_kind(F.unhex(F.expr(HEAD_HEX))).alias("kind"))


@query("b15_output_name", c.q(("subgraph",), "select row_id, role||'_W+Gold_additive.txt' as added, role||'_new_replace.txt' as replaced from subgraph"))
def b15(t: Tables) -> DataFrame:
    r = F.col("role")
    return t("subgraph").select("row_id", subgraph.output_name(r, " W, Gold ").alias("added"), subgraph.output_name(r, "", False).alias("replaced"))


@query("b16_is_diffuse_texture", c.q(("assets",), "select * from assets where ends_with(lower(path),'_d.dds')"))
def b16(t: Tables) -> DataFrame:
    return pathops.diffuse_textures(t("assets"))


# ---- joins on paths ---------------------------------------------------------------------------------------------------


def greys_and_colors(t: Tables) -> tuple[DataFrame, DataFrame]:
    files = t("assets")
    grey = paths.is_greyscale_name(F.col("path"))
    return files.where(grey).select("path"), files.where(~grey).select("path")


PAIR_CTES = (
    ("greys", f"select path, {c.norm_key(P)} as key from assets where {GREY_SQL}"),
    ("cols", f"select path, {c.norm_key(P)} as key from assets where not {GREY_SQL}"),
)


@query("e05_pair_textures", c.q(("assets",), "select g.key, g.path as grey_path, c.path as color_path from greys g join cols c using (key)", *PAIR_CTES))
def e05(t: Tables) -> DataFrame:
    return pathops.pair_textures(*greys_and_colors(t), ordered=False)


@query("e06_unmatched_greys", c.q(("assets",), "select key, path from greys where key not in (select key from cols)", *PAIR_CTES))
def e06(t: Tables) -> DataFrame:
    return pathops.unmatched_greys(*greys_and_colors(t))


BELOW_CTES = (
    ("pals", f"select path as palette_path, {c.norm_key(P, True)} as key, {c.dirname(P)} as folder from assets where {PAL_SQL}"),
    ("imgs", f"select path, {c.norm_key(P, True)} as key, {c.dirname(P)} as d, {GREY_SQL} as grey, {PAL_SQL} as pal from assets where {EXT_SQL} in {IMAGE_EXTS}"),
    ("cand", "select * from pals p join imgs i using (key) where i.path<>p.palette_path and (i.d=p.folder or starts_with(i.d, p.folder||'/'))"),
)


def palettes_of(t: Tables) -> DataFrame:
    return t("assets").where(paths.is_palette_name(F.col("path"))).select("path")


@query(
    "e07_detect_greyscale",
    c.q(("assets",), "select palette_path, path as grey_path from (select *, row_number() over (partition by palette_path order by cast(d<>folder as int), length(path), lower(path), path) as rn from cand where grey) where rn=1", *BELOW_CTES),
)
def e07(t: Tables) -> DataFrame:
    return pathops.detect_greyscale(palettes_of(t), t("assets"))


@query("e08_detect_textures", c.q(("assets",), "select palette_path, path as texture_path from cand where d<>folder and not grey and not pal", *BELOW_CTES))
def e08(t: Tables) -> DataFrame:
    return pathops.detect_textures(palettes_of(t), t("assets"))


GROUPS = "select distinct group_name from (select unnest([replace(p_name,' ','_')||'_'||p_partkey%4, upper(split_part(p_name,' ',2))||'_'||p_partkey%4]) as group_name from part)"


@query(
    "e09_locate_group_palette",
    c.q(
        ("assets",),
        f"select g.group_name, p.path as palette_path, coalesce(n,0) as greys, case when p.path is null then 'palette not found: '||g.group_name||'_palette' end as error from grp g"
        f" left join (select group_name, path, row_number() over (partition by group_name order by cast({EXT_SQL}<>'.dds' as int), path) as rn from grp join assets on lower({c.stem(P)})=lower(group_name)||'_palette') p on p.group_name=g.group_name and rn=1"
        f" left join (select group_name, count(*) as n from grp join assets on ends_with(lower({c.stem(P)}), '_'||lower(group_name)||'_greyscale') group by 1) s on s.group_name=g.group_name",
        ("grp", GROUPS),
    ),
)
def e09(t: Tables) -> DataFrame:
    both = "array(replace(p_name,' ','_')||'_'||p_partkey%4, upper(split_part(p_name,' ',2))||'_'||p_partkey%4)"
    groups = t.raw("part").select(F.explode(F.expr(both)).alias("group_name")).distinct()
    return pathops.locate_group_files(groups, t("assets"))


MESH_SQL = (
    ("tx", f"select path, lower({c.dirname('substr(path,20)')}) as rd, regexp_replace(lower({c.stem(P)}),'_d$','') as st from textures"),
    ("dirs", "select path, rd, st, unnest(case when contains('/'||rd||'/','/actors/') or contains('/'||rd||'/','/actor/') then ['mods/data/meshes/'||rd||'/characterassets','mods/data/meshes/'||rd] else ['mods/data/meshes/'||rd] end) as d,"
        " generate_subscripts(case when contains('/'||rd||'/','/actors/') or contains('/'||rd||'/','/actor/') then [1,2] else [1] end,1) as dn from tx"),
    ("ms", f"select path as mesh_path, lower({c.dirname(P)}) as d, lower({BASE}) as f from meshes"),
    ("kw", "select * from (values (0,'_leg'),(1,'_arm'),(2,'_head'),(3,'_helmet'),(4,'_body'),(5,'_torso')) as k(kn,word)"),
    ("hits", "select path, 0 as pass, dn, kn as rule, f, mesh_path from dirs join kw on contains(st,word) join ms using (d) where contains(left(f,length(f)-4),word) and (contains('/'||rd||'/','/armor/') or contains('/'||rd||'/','/powerarmor/'))"
        " union all select path, 1, dn, case when f=st||'_1.nif' then 0 when f=st||'.nif' then 1 else 2 end, f, mesh_path from dirs join ms using (d) where starts_with(f,st)"),
)


@query(
    "e10_find_mesh",
    c.q(("textures", "meshes"), "select t.path, h.mesh_path from textures t left join (select path, mesh_path, row_number() over (partition by path order by pass, dn, rule, f, mesh_path) as rn from hits) h on h.path=t.path and rn=1", *MESH_SQL),
)
def e10(t: Tables) -> DataFrame:
    return pathops.find_mesh(t("textures"), t("meshes"), "Mods/Data")


@query("e14_plan_product", c.q(("assets",), "select path, length, unnest([512,1024,2048])::int as size from assets"))
def e14(t: Tables) -> DataFrame:
    return pathops.plan_product(t("assets"), [512, 1024, 2048], "size")


@query(
    "f10_texture_order",
    c.q(("assets",), f"select path, row_number() over (order by lower({c.stem(P)}), lower({c.parent(P)}), lower(path), path)-1 as position from assets"),
)
def f10(t: Tables) -> DataFrame:
    keys = [*ordering.texture_order_keys(F.col("path")), F.col("path")]
    return ordering.with_position(t("assets").select("path"), keys)


# ---- list-valued rows -------------------------------------------------------------------------------------------------


@query(
    "h01_split_join_tokens",
    c.q(("subgraph",), "select row_id, len(list_filter(string_split(anim_paths||', ,x ,',','), lambda e: trim(e)<>'')) as n, array_to_string(list_filter(list_transform(string_split(anim_paths||', ,x ,',','), lambda e: trim(e)), lambda e: e<>''), ', ') as joined from subgraph"),
)
def h01(t: Tables) -> DataFrame:
    parts = tokens.split_tokens(F.concat("anim_paths", F.lit(", ,x ,")))
    return t("subgraph").select("row_id", F.size(parts).alias("n"), tokens.join_tokens(parts).alias("joined"))


TOK = "list_filter(list_transform(string_split({0},','), lambda e: trim(e)), lambda e: e<>'')"
TARGETS, FOLDERS = "['AnimsF','Anims3']", "['W1','W2','W4']"
LAST = "split_part(replace(e,'/',chr(92)),chr(92),-1)"
MATCH_SQL = f"select * from (select *, {TOK.format('target_kw')} as anims, {TOK.format('anim_paths')} as fold from subgraph) where list_has_any(anims,{TARGETS}) and len(list_filter(fold, lambda e: list_contains({FOLDERS},{LAST})))>0"
ARGS = ("AnimsF, Anims3", "W1,W2, W4")
NEW_ANIMS = f"array_to_string(list_transform(anims, lambda e: case when list_contains({TARGETS},e) then 'AnimsNew' else e end),', ')"
MADE = "regexp_replace(replace(e,'/',chr(92)), '[^\\\\]*$', '') || 'W2'"


@query("h02_match_rows", c.q(("subgraph",), "select * exclude (anims, fold) from m", ("m", MATCH_SQL)))
def h02(t: Tables) -> DataFrame:
    return subgraph.match_rows(t("subgraph"), *ARGS)


@query(
    "h03_replace_tokens",
    c.q(
        ("subgraph",),
        f"select row_id, role, perspective, actor_kw, behavior, {NEW_ANIMS} as target_kw, array_to_string(list_transform(fold, lambda e: case when list_contains({FOLDERS},{LAST}) then {MADE} else e end),', ') as anim_paths from m",
        ("m", MATCH_SQL),
    ),
)
def h03(t: Tables) -> DataFrame:
    return subgraph.rewrite_rows(t("subgraph"), ARGS[0], "AnimsNew", ARGS[1], "W2", prepend=False)


PREPEND_SQL = (
    "select row_id, role, perspective, actor_kw, behavior, " + NEW_ANIMS + " as target_kw, (select string_agg(case when list_contains(" + FOLDERS + "," + LAST + ") and not coalesce(prev=made,false) then made||', '||e else e end, ', ' order by i)"
    " from (select e, i, lag(e) over (order by i) as prev, " + MADE + " as made from (select unnest(fold) as e, generate_subscripts(fold,1) as i))) as anim_paths from m"
)


@query("h04_prepend_tokens", c.q(("subgraph",), PREPEND_SQL, ("m", MATCH_SQL)))
def h04(t: Tables) -> DataFrame:
    return subgraph.rewrite_rows(t("subgraph"), ARGS[0], "AnimsNew", ARGS[1], "W2")


@query(
    "h05_subgraph_summary",
    c.q(("subgraph",), "select f.file_stem, f.file_stem||'_W2_additive.txt' as out_name, count(m.row_id) as n from (select distinct role||case when row_id%3=0 then '' else '_b' end as file_stem from subgraph union select 'missing') f"
        " left join (select *, role||case when row_id%3=0 then '' else '_b' end as file_stem from m) m using (file_stem) group by 1, 2", ("m", MATCH_SQL)),
)
def h05(t: Tables) -> DataFrame:
    rows = t("subgraph").withColumn("file_stem", F.expr("role||case when row_id%3=0 then '' else '_b' end"))
    files = rows.select("file_stem").unionByName(t.spark.range(1).select(F.lit("missing").alias("file_stem")))
    done = subgraph.rewrite_rows(rows, ARGS[0], "AnimsNew", ARGS[1], "W2")
    return subgraph.subgraph_summary(files, done, "W2")


# ---- materials and resize plans ---------------------------------------------------------------------------------------


REWRITE_SQL = (
    "select j.path, mtype, folder, 'Out/'||folder||'/'||split_part(j.path,'/',-1) as out_path,"
    " case when mtype='BGSM' then " + c.insert_folder("sDiffuseTexture", "folder") + " else sDiffuseTexture end as sDiffuseTexture,"
    " case when mtype='BGEM' then " + c.insert_folder("sBaseTexture", "folder") + " else sBaseTexture end as sBaseTexture, sNormalTexture,"
    " case when mtype='BGSM' then '0.5' else fGrayscaleToPaletteScale end as fGrayscaleToPaletteScale from j, (select unnest(['gold','red set']) as folder) where error is null"
)


@query("h06_rewrite_material", c.q(("material_json",), REWRITE_SQL, ("j", JSON_SQL)))
def h06(t: Tables) -> DataFrame:
    read = materials.read_material_json(t("material_json"))
    out = materials.rewrite_material_json(read, ["gold", "red set"], ["DiffuseTexture", "GlowTexture"], 0.5, "Out")
    return out.select("path", "mtype", "folder", "out_path", *[materials.field_text(k).alias(k) for k in JSON_KEYS])


_BACK = "chr(92)"
WRITE_SQL = (
    "select 'Out/'||folder||'/'||split_part(j.path,'/',-1) as path, case when mtype='BGSM' then '{\"sDiffuseTexture\":\"'||replace(" + c.insert_folder("sDiffuseTexture", "folder") + f",{_BACK},{_BACK}||{_BACK})"
    "||'\",\"sNormalTexture\":\"Weapons/gold/n.dds\",\"fGrayscaleToPaletteScale\":0.5,\"fAlpha\":0.5,\"iTiles\":3}'"
    " else '{\"sBaseTexture\":\"'||replace(" + c.insert_folder("sBaseTexture", "folder") + f",{_BACK},{_BACK}||{_BACK})"
    "||'\",\"sNormalTexture\":\"\",\"bGlow\":true,\"aList\":[1,2.5,null],\"oMeta\":{\"k\":\"v\",\"n\":[]},\"nNull\":null}' end as text"
    " from j, (select unnest(['gold','red set']) as folder) where error is null"
)


@query("a05_write_json", c.q(("material_json",), WRITE_SQL, ("j", JSON_SQL)))
def a05j(t: Tables) -> DataFrame:
    """The written text, read back and printed without spaces: numbers, booleans, lists and nested objects keep their types."""
    read = materials.read_material_json(t("material_json"))
    out = materials.rewrite_material_json(read, ["gold", "red set"], ["DiffuseTexture", "GlowTexture"], 0.5, "Out")
    written = material_files.material_json_text(out)
    return written.select("path", F.to_json(F.from_json(F.decode("content", "UTF-8"), "map<string,variant>")).alias("text"))


@query(
    "h07_parse_sizes",
    "select p_partkey, array_to_string(list_sort(list_distinct([512, cast(p_size*64 as int), case when p_partkey between 1 and 16384 then cast(p_partkey as int) else 512 end])), ',') as sizes from part",
)
def h07(t: Tables) -> DataFrame:
    raw = F.expr("concat(' 512;x, -4,,', p_size*64, ' ,99999; 512,', p_partkey)")
    return t.raw("part").select("p_partkey", F.array_join(tokens.parse_sizes(raw).cast("array<string>"), ",").alias("sizes"))


def plan_sql(square: bool) -> str:
    if square:
        copy, w, h = "greatest(w,h)>0 and greatest(w,h)<=size and not conv", "size", "size"
    else:
        side = "case when greatest(w,h)>0 and size/greatest(w,h)<1 then greatest(1,cast(round_even({0}*(size/greatest(w,h)),0) as int)) else {0} end"
        copy, w, h = "greatest(w,h)>0 and size>=greatest(w,h) and not conv", side.format("w"), side.format("h")
    return (
        f"select path, size, case when {copy} then 'copy' when conv then 'convert' else 'resize' end as action, case when {copy} then w else {w} end::int as target_w,"
        f" case when {copy} then h else {h} end::int as target_h, 'Out/'||size||'/'||substr(path,10) as out_path from (select path, coalesce(width,0) as w, coalesce(height,0) as h, is_bc7 as conv, unnest([256,768,1024])::int as size from hd)"
    )


@query("h08_resize_plan", c.q(("texture_bytes",), plan_sql(True), ("hd", HEADERS_SQL)))
def h08(t: Tables) -> DataFrame:
    return resize.resize_plan(headers(t), [1024, 256, 768], "Out", "Textures", convert_bc7=True)


@query("h08_resize_plan_lanczos", c.q(("texture_bytes",), plan_sql(False), ("hd", HEADERS_SQL)))
def h08l(t: Tables) -> DataFrame:
    return resize.resize_plan(headers(t), [1024, 256, 768], "Out", "Textures", "lanczos", convert_bc7=True)


RECORD = {
    "mtype": "case when p_partkey%3=0 then 'BGEM' else 'BGSM' end",
    "version": "cast(element_at(array(1,2,6,7,8,9,10,12,13,17,20,21,22), cast(p_partkey%13 as int)+1) as bigint)",
    "out_path": "concat('Materials/m', p_partkey, '.bgsm')",
    "DiffuseTexture": "concat('Weapons/', replace(p_name,' ','_'), '_d.dds')",
    "BaseTexture": "concat('Effects\\\\', p_name, '.dds')",
    "GlowTexture": "case when p_partkey%2=0 then p_type end",
    "DistanceFieldAlphaTexture": "p_brand",
    "SpecularMult": "cast(p_size/8.0 as float)",
    "Terrain": "p_partkey%5=0",
    "TerrainRotationAngle": "cast(p_size as float)",
    "EmitEnabled": "p_partkey%7=0",
    "EmittanceColor": "named_struct('r', cast(0.5 as float), 'g', cast(p_size as float), 'b', cast(0 as float))",
    "GlassEnabled": "p_partkey%2=0",
    "GlassBlurScaleFactor": "cast(p_size/4.0 as float)",
    "mask_writes": "cast(p_size as int)",
    "alpha_blend_mode2": "p_partkey*1000",
}


def records(t: Tables) -> DataFrame:
    return t.raw("part").selectExpr(*[f"{e} as {n}" for n, e in RECORD.items()])


CATALOG_SQL = """select 'Materials/m'||k||'.bgsm' as path, mtype, v::bigint as version, null::varchar as error,
 case when mtype='BGSM' then 'Weapons/'||replace(p_name,' ','_')||'_d.dds' end as DiffuseTexture,
 case when mtype='BGEM' then 'Effects'||chr(92)||p_name||'.dds' end as BaseTexture,
 case when mtype='BGSM' or v>=11 then case when k%2=0 then p_type else '' end end as GlowTexture,
 case when mtype='BGSM' and v>=17 then p_brand end as DistanceFieldAlphaTexture,
 case when mtype='BGSM' then p_size/8.0::double end as SpecularMult,
 case when mtype='BGSM' and v>=3 and k%5=0 then p_size::double end as TerrainRotationAngle,
 case when mtype='BGSM' and k%7<>0 then null when mtype='BGSM' or v>=11 then p_size::double end as emit_g,
 case when mtype='BGEM' and v>=22 and k%2=0 then p_size/4.0::double end as GlassBlurScaleFactor,
 case when v>=6 then p_size end as mask_writes, k*1000 as alpha_blend_mode2
 from (select *, p_partkey as k, case when p_partkey%3=0 then 'BGEM' else 'BGSM' end as mtype, [1,2,6,7,8,9,10,12,13,17,20,21,22][p_partkey%13+1] as v from part)"""


@query("a04_material_catalog", CATALOG_SQL)
def a04(t: Tables) -> DataFrame:
    read = material_files.material_catalog(material_files.encode_materials(records(t)))
    floats = [F.col(n).cast("double").alias(n) for n in ("SpecularMult", "TerrainRotationAngle", "GlassBlurScaleFactor")]
    names = ("path", "mtype", "version", "error", "DiffuseTexture", "BaseTexture", "GlowTexture", "DistanceFieldAlphaTexture", "mask_writes", "alpha_blend_mode2")
    return read.select(*names, *floats, F.col("EmittanceColor.g").cast("double").alias("emit_g"))


WRITE_SQL = f"""select 'Out/gold/m'||k||'.bgsm' as path, mtype, {c.insert_folder("dt", "'gold'")} as DiffuseTexture, {c.insert_folder("bt", "'gold'")} as BaseTexture,
 case when mtype='BGSM' or v>=11 then case when k%2=0 then 'gold/'||p_type else '' end end as GlowTexture, case when mtype='BGSM' then 1.5::double end as GrayscaleToPaletteScale
 from (select *, p_partkey as k, case when p_partkey%3=0 then 'BGEM' else 'BGSM' end as mtype, [1,2,6,7,8,9,10,12,13,17,20,21,22][p_partkey%13+1] as v,
 case when p_partkey%3<>0 then 'Weapons/'||replace(p_name,' ','_')||'_d.dds' end as dt, case when p_partkey%3=0 then 'Effects'||chr(92)||p_name||'.dds' end as bt from part)"""


@query("a05_write_materials", WRITE_SQL)
def a05(t: Tables) -> DataFrame:
    read = material_files.material_catalog(material_files.encode_materials(records(t)))
    done = []
    for mtype, fields, scale in (("BGSM", material_files.BGSM_TEXTURE_FIELDS, 1.5), ("BGEM", material_files.BGEM_TEXTURE_FIELDS, None)):
        part = read.where((F.col("mtype") == mtype) & F.col("error").isNull())
        done.append(materials.rewrite_material_record(part, fields, ["gold"], None, scale, "Out"))
    written = material_files.encode_materials(done[0].unionByName(done[1]))
    again = material_files.material_catalog(written)
    return again.select("path", "mtype", "DiffuseTexture", "BaseTexture", "GlowTexture", F.col("GrayscaleToPaletteScale").cast("double").alias("GrayscaleToPaletteScale"))


# ---- plugin records ---------------------------------------------------------------------------------------------------


def plugin_bytes(t: Tables) -> DataFrame:
    """Plugin files with a file tag, an author record, a description record and 64 string records each."""
    size = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    rec = F.concat(F.lit("45444944"), size(F.col("size")), F.rpad(F.hex(F.encode("text", "UTF-8")), F.col("size") * 2, F.lit("0")))
    files = t("plugin_rows").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", rec.alias("h")))), lambda s: s["h"]), "").alias("body"))
    author = F.hex(F.encode(F.concat(F.lit("by "), F.col("path")), "UTF-8"))
    head = F.concat(
        F.lit("54455334"), F.lit("434E414D"), F.lit("1800"), F.rpad(author, 48, "0"), F.lit("534E414D"), F.lit("0400"), F.lit("6F6C6400")
    )
    return files.select("path", F.unhex(F.concat(head, "body")).alias("content"))


# 4 tag + (6+24) author + (6+4) description = 44 bytes before the first record
PLUGIN_SQL = (
    "rec",
    "select path, 44+cast(coalesce(sum(size+6) over (partition by path order by slot rows between unbounded preceding and 1 preceding),0) as bigint) as rec_offset, 'EDID' as tag, size, text from plugin_rows",
)


@query("a08_plugin_strings", c.q(("plugin_rows",), "select * from rec", PLUGIN_SQL))
def a08(t: Tables) -> DataFrame:
    return plugin_files.plugin_strings(plugin_bytes(t))


@query(
    "a09_plugin_header",
    c.q(("plugin_rows",), "select path, unnest([4,34])::bigint as rec_offset, unnest(['CNAM','SNAM']) as tag, unnest([24,4])::int as size, unnest(['by '||path,'old']) as text from (select distinct path from plugin_rows)"),
)
def a09(t: Tables) -> DataFrame:
    return plugin_files.plugin_header(plugin_bytes(t))


@query(
    "h09_parse_terms",
    "select o_orderkey, array_to_string(list_distinct_keep, '|') as terms from (select o_orderkey, case when o_custkey%7=0 then [o_orderpriority] when o_custkey%9=o_orderkey%9 then ['A'||o_custkey%9,'b c'] else ['A'||o_custkey%9,'b c','A'||o_orderkey%9] end as list_distinct_keep from orders)",
)
def h09(t: Tables) -> DataFrame:
    raw = F.expr("case when o_custkey%7=0 then ' , ' else concat(' A', o_custkey%9, ',b c\n\nA', o_orderkey%9, ' ,, b c') end")
    return t.raw("orders").select("o_orderkey", F.array_join(tokens.parse_terms(raw, F.col("o_orderpriority")), "|").alias("terms"))


RENAME = "replace(replace(text,'Template_','Pepper_'),'BUILDING','Pepper_')"
RENAMED_SQL = f"select *, {RENAME}<>text and strlen({RENAME})<=size as changed, case when {RENAME}<>text and strlen({RENAME})<=size then {RENAME} else text end as new_text from rec"
PAD_SQL = "case when changed then rpad(hex(new_text), size*2, '0') end as payload"


@query("h10_rename_strings", c.q(("plugin_rows",), f"select path, rec_offset, tag, size, text, changed, new_text, {PAD_SQL} from n", PLUGIN_SQL, ("n", RENAMED_SQL)))
def h10(t: Tables) -> DataFrame:
    terms = F.array(F.lit("Template_"), F.lit("BUILDING"))
    out = plugins.rename_strings(plugin_files.plugin_strings(plugin_bytes(t)), terms, "Pepper_.esp")
    return out.withColumn("payload", F.hex("payload"))


@query(
    "h11_set_header",
    c.q(
        ("plugin_rows",),
        "select path, 4::bigint as rec_offset, 'CNAM' as tag, 24::int as size, 'by '||path as text, 'by plugin3.esp' as new_text, rpad(hex('by plugin3.esp'),48,'0') as payload from (select distinct path from plugin_rows) where path<>'plugin3.esp'",
    ),
)
def h11(t: Tables) -> DataFrame:
    out = plugins.set_header(plugin_files.plugin_header(plugin_bytes(t)), "CNAM", "by plugin3.esp")
    return out.withColumn("payload", F.hex("payload"))


@query(
    "h12_patch_files",
    c.q(
        ("plugin_rows",),
        "select path, 100+sum(size+6)-56 as n_bytes, md5('54455334434E414D1800'||rpad(hex('me'),48,'0')||'534E414D04006F6C6400'||string_agg('45444944'||lpad(hex(size%256),2,'0')||lpad(hex(size//256),2,'0')||rpad(hex(new_text),size*2,'0'), '' order by rec_offset)) as digest from n group by path",
        PLUGIN_SQL,
        ("n", RENAMED_SQL),
    ),
)
def h12(t: Tables) -> DataFrame:
    files = plugin_bytes(t)
    texts = plugins.rename_strings(plugin_files.plugin_strings(files), F.array(F.lit("Template_"), F.lit("BUILDING")), "Pepper_.esp")
    author = plugins.set_header(plugin_files.plugin_header(files), "CNAM", "me")
    patches = texts.select("path", "rec_offset", "payload").unionByName(author.select("path", "rec_offset", "payload"))
    done = plugin_files.patch_files(files, patches)
    return done.select("path", F.length("content").cast("bigint").alias("n_bytes"), F.md5(F.encode(F.hex("content"), "UTF-8")).alias("digest"))
