"""Named queries: colour functions and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texelmill.functions import color, paths
from texelmill.operators import cluster, histogram, materials, neighborhood, uv
from texelmill.plans import check_sql as c
from texelmill.plans.registry import query
from texelmill.plans.views import Tables

RGB = ["r", "g", "b"]


def col() -> list:
    return [F.col(k) for k in RGB]


def r4(col, name: str, places: int = 4):
    """Twin of the check's rounding."""
    scale = float(10**places)
    return (F.floor(col * scale + 0.5000001) / scale).alias(name)


LAB3 = f"{c.r4('lab_l')} as lab_l, {c.r4('lab_a')} as lab_a, {c.r4('lab_b')} as lab_b"


@query("c01_rgb_to_lab", c.q(("colors",), f"select r, g, b, {LAB3} from {c.lab('colors')}"))
def c01(t: Tables) -> DataFrame:
    return color.with_lab(t("colors")).select(*RGB, *[r4(F.col(k), k) for k in ("lab_l", "lab_a", "lab_b")])


@query(
    "c02_hue_chroma",
    c.q(("colors",), f"select r, g, b, {c.r4(c.hue('lab_a', 'lab_b'))} as hue, {c.r4(c.chroma('lab_a', 'lab_b'))} as chroma from {c.lab('colors')}"),
)
def c02(t: Tables) -> DataFrame:
    a, b = F.col("lab_a"), F.col("lab_b")
    return color.with_lab(t("colors")).select(*RGB, r4(color.hue_angle(a, b), "hue"), r4(color.chroma(a, b), "chroma"))


STEPS = (
    ("lp", f"select * from {c.lab('palette')}"),
    (
        "st",
        "select a.palette_id, a.idx, a.lab_l as l1, a.lab_a as a1, a.lab_b as b1, b.lab_l as l2, b.lab_a as a2, b.lab_b as b2"
        " from lp a join lp b on a.palette_id=b.palette_id and b.idx=a.idx+1",
    ),
)


def palette_steps(t: Tables) -> DataFrame:
    lab = color.with_lab(t("palette"))
    one = lab.select("palette_id", "idx", *[F.col(f"lab_{k}").alias(f"{k}1") for k in "lab"])
    two = lab.select("palette_id", (F.col("idx") - 1).alias("idx"), *[F.col(f"lab_{k}").alias(f"{k}2") for k in "lab"])
    return one.join(two, ["palette_id", "idx"])


@query(
    "c03_delta_e76",
    c.q(("palette",), f"select palette_id, idx, {c.r4('sqrt(pow(l1-l2,2)+pow(a1-a2,2)+pow(b1-b2,2))')} as de from st", *STEPS),
)
def c03(t: Tables) -> DataFrame:
    de = color.delta_e76(*[F.col(k) for k in ("l1", "a1", "b1", "l2", "a2", "b2")])
    return palette_steps(t).select("palette_id", "idx", r4(de, "de"))


@query(
    "c04_delta_e2000",
    c.q(("palette",), f"select palette_id, idx, {c.r4('de')} as de from {c.de00('st', ('l1', 'a1', 'b1'), ('l2', 'a2', 'b2'), 'de')}", *STEPS),
)
def c04(t: Tables) -> DataFrame:
    return color.with_delta_e2000(palette_steps(t), ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de").select(
        "palette_id", "idx", r4(F.col("de"), "de")
    )


@query("c05_rgb_to_hsv", c.q(("colors",), f"select r, g, b, {c.r4('h')} as h, {c.r4('s')} as s, {c.r4('v')} as v from {c.hsv('colors')}"))
def c05(t: Tables) -> DataFrame:
    return color.with_hsv(t("colors")).select(*RGB, *[r4(F.col(k), k) for k in "hsv"])


@query("c06_luma601", c.q(("colors",), "select r, g, b, cast((299*r+587*g+114*b+500)//1000 as int) as luma from colors"))
def c06(t: Tables) -> DataFrame:
    return t("colors").select(*RGB, color.luma601(*col()).alias("luma"))


@query("c07_grey_lab", c.q(("colors",), f"select r, g, b, cast(round(lab_l*255.0/100.0) as int) as grey from {c.lab('colors')}"))
def c07(t: Tables) -> DataFrame:
    return color.with_lab(t("colors")).select(*RGB, color.grey_lab(F.col("lab_l")).alias("grey"))


def _lin(ch: str) -> str:
    return f"case when {ch}/255.0::double > 0.04045 then pow(({ch}/255.0::double+0.055)/1.055,2.4) else {ch}/255.0::double/12.92 end"


def _stretch(value: str, src: str) -> str:
    return (
        "select image_id, r, g, b, cast(floor(round(case when hi>lo then (v-lo)/(hi-lo) else 0 end*255.0,9)) as int) as grey from"
        f" (select *, min(v) over (partition by image_id) as lo, max(v) over (partition by image_id) as hi from (select *, {value} as v from {src}))"
    )


@query("c08_grey_linear", c.q(("hist",), _stretch(f"0.2126*({_lin('r')})+0.7152*({_lin('g')})+0.0722*({_lin('b')})", "hist")))
def c08(t: Tables) -> DataFrame:
    return histogram.grey_linear(t("pixels"))


@query(
    "c09_grey_rank",
    c.q(
        ("hist",),
        "select image_id, r, g, b, cast((rn-1)*255//greatest(k-1,1) as int) as grey from (select *, row_number() over (partition by image_id"
        f" order by round(lab_l,6), r, g, b) as rn, count(*) over (partition by image_id) as k from {c.lab('hist')})",
    ),
)
def c09(t: Tables) -> DataFrame:
    return histogram.grey_rank(t("pixels"))


@query("c10_grey_weighted_lab", c.q(("hist",), _stretch(f"lab_l*2.55+{c.chroma('lab_a', 'lab_b')}*0.3", c.lab("hist"))))
def c10(t: Tables) -> DataFrame:
    return histogram.grey_weighted_lab(t("pixels"))


def _byte(e: str) -> str:
    return f"greatest(0,least(255,cast(round_even(({e})*255.0::double,0) as bigint)))"


@query(
    "c11_pack_rgb",
    c.q(
        ("colors",),
        f"select r, g, b, {c.rgb_key()} as packed, {_byte('r/200.0::double')}*65536+{_byte('g/255.0::double')}*256+{_byte('(b-8)/255.0::double')}+4278190080 as argb,"
        f" {c.r4('r/255.0')} as unit_r, {c.r4('b/255.0')} as unit_b from colors",
    ),
)
def c11(t: Tables) -> DataFrame:
    packed = color.pack_rgb(*col())
    argb = color.color3_to_argb(F.col("r") / 200.0, F.col("g") / 255.0, (F.col("b") - 8) / 255.0)
    unit = color.argb_to_color3(packed)
    return t("colors").select(*RGB, packed.alias("packed"), argb.alias("argb"), r4(unit["r"], "unit_r"), r4(unit["b"], "unit_b"))


@query(
    "c12_index_to_display",
    c.q(
        ("indexed",),
        "select image_id, x, y, cast(idx*255//63 as int) as shown, cast(idx*255//greatest(max(idx) over (partition by image_id),1) as int) as shown_max from indexed",
    ),
)
def c12(t: Tables) -> DataFrame:
    px = t("indexed")
    top = px.groupBy("image_id").agg(F.max("idx").alias("top"))
    return px.join(top, "image_id").select(
        "image_id", "x", "y", color.index_to_display(F.col("idx"), 64).alias("shown"), color.index_to_display(F.col("idx"), F.col("top") + 1).alias("shown_max")
    )


@query(
    "c13_eff_weight",
    c.q(("ghist",), f"select r, g, b, {c.r4('weight')} as weight from feat", ("feat", c.features("ghist"))),
)
def c13(t: Tables) -> DataFrame:
    return cluster.with_color_features(t("ghist"), "scope").select(*RGB, r4(F.col("weight"), "weight"))


@query(
    "c14_hue_bin",
    c.q(
        ("colors",),
        f"select r, g, b, cast(cast(floor(round({c.hue('lab_a', 'lab_b')},6)/15.0) as int)%24 as int) as bin,"
        " cast(case when s<0.05 then 12 else least(floor(h*12),11) end as int) as hsv_bin from " + c.lab(c.hsv("colors")),
    ),
)
def c14(t: Tables) -> DataFrame:
    df = color.with_lab(color.with_hsv(t("colors")))
    deg = F.round(color.hue_angle(F.col("lab_a"), F.col("lab_b")), 6)
    return df.select(*RGB, color.hue_bin(deg).alias("bin"), color.hue_value_bin(F.col("h"), F.col("s")).alias("hsv_bin"))


BAYER = "[" + ",".join(str(v) for v in color.BAYER_8X8) + "]"


def bayer_sql(src: str, k: int, amount: float) -> str:
    moved = f"idx/{k - 1}.0::double+{amount}::double*(({BAYER}[(y%8)*8+x%8+1]+0.5)/64.0::double-0.5)"
    return f"select image_id, x, y, cast(round_even(round(greatest(0.0::double,least(1.0::double,{moved}))*{k - 1}.0::double,9),0) as int) as idx from {src}"


@query("c15_bayer_dither", c.q(("indexed",), bayer_sql("indexed", 64, 0.2)))
def c15(t: Tables) -> DataFrame:
    return neighborhood.bayer_filter(t("indexed"), 64, 0.2)


@query(
    "c16_uv_to_px",
    c.q(
        ("triangles",),
        f"select shape_id, tri_id, {c.r4('(u1-floor(u1))*31')} as px, {c.r4('(v1-floor(v1))*31')} as py, {c.r4('greatest(0,least(1,u2))*63')} as cx,"
        f" {c.r4('greatest(0,least(1,v2))*63')} as cy, {c.r4('(u0-0.5)*2')} as qu from triangles",
    ),
)
def c16(t: Tables) -> DataFrame:
    wrap = color.uv_to_px(F.col("u1"), F.col("v1"), F.lit(32), F.lit(32))
    clamp = color.uv_to_px(F.col("u2"), F.col("v2"), F.lit(64), F.lit(64), wrap=False)
    return t("triangles").select(
        "shape_id", "tri_id", r4(wrap["px"], "px"), r4(wrap["py"], "py"), r4(clamp["px"], "cx"), r4(clamp["py"], "cy"),
        r4(color.expand_quarter_uv(F.col("u0")), "qu"),
    )


def _fit(k: str, n: str) -> str:
    return f"cast(case when {k}>=1 then {n} else greatest(1, round_even({n}*{k},0)) end as int)"


@query(
    "c17_fit_dims",
    c.q(
        (),
        f"""select p_partkey, {_fit('k1', 'w')} as fit_w, {_fit('k1', 'h')} as fit_h, {_fit('k2', 'w')} as box_w, {_fit('k2', 'h')} as box_h from (
        select *, least(1.0::double, 1024.0::double/w, 1024.0::double/h) as k1, least(1.0::double, 800.0::double/w, 600.0::double/h) as k2 from (
        select p_partkey, cast(p_size*97+1 as int) as w, cast(p_partkey%4096+1 as int) as h from part))""",
    ),
)
def c17(t: Tables) -> DataFrame:
    dims = t.raw("part").selectExpr("p_partkey", "cast(p_size*97+1 as int) as w", "cast(p_partkey%4096+1 as int) as h")
    one, two = color.fit_dims(F.col("w"), F.col("h"), 1024), color.fit_within(F.col("w"), F.col("h"), 800, 600)
    return dims.select(
        "p_partkey", one["new_w"].alias("fit_w"), one["new_h"].alias("fit_h"), two["new_w"].alias("box_w"), two["new_h"].alias("box_h")
    )


@query(
    "c18_next_power_of_2",
    "select o_orderkey, cast(case when o_orderkey<=1 then 1 else power(2, length(to_base(o_orderkey-1,2))) end as bigint) as p2 from orders",
)
def c18(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", color.next_power_of_2(F.col("o_orderkey")).alias("p2"))


def jitter_sql(c_: str, salt: int) -> str:
    x = f"(((r*65536+g*256+b)::bigint+{salt * 0x9E3779B9})%4294967296*{color.JITTER[0]}%4294967296)"
    y = f"(xor({x},{x}>>15)*{color.JITTER[1]}%4294967296)"
    return f"cast(greatest(0, least(255, {c_}+xor({y},{y}>>13)%21-10)) as int)"


@query("c19_modify_color", c.q(("colors",), "select r, g, b, " + ", ".join(f"{jitter_sql(k, i)} as new_{k}" for i, k in enumerate("rgb")) + " from colors"))
def c19(t: Tables) -> DataFrame:
    moved = color.modify_color(*col(), color.pack_rgb(*col()))
    return t("colors").select(*RGB, *[v.alias(f"new_{k}") for k, v in moved.items()])


# ---- aggregations ---------------------------------------------------------------------------------------------------


@query("d01_color_histogram", c.q(("pixels",), "select image_id, r, g, b, count(*) as n from pixels group by all"))
def d01(t: Tables) -> DataFrame:
    return histogram.color_histogram(t("pixels"), ["image_id"])


@query("d01_color_histogram_global", c.q(("pixels",), "select r, g, b, count(*) as n from pixels group by all"))
def d01g(t: Tables) -> DataFrame:
    return histogram.color_histogram(t("pixels"))


@query("d02_unique_colors", c.q(("pixels", "palette"), "select r, g, b from pixels union select r, g, b from palette"))
def d02(t: Tables) -> DataFrame:
    return histogram.unique_colors(t("pixels").select(*RGB).unionByName(t("palette").select(*RGB)))


@query(
    "d03_color_coverage",
    c.q(
        ("pixels", "palette"),
        "select r, g, b, greatest(sum(n),1)::bigint as n, sum(cov)::int as coverage from (select r, g, b, count(*) as n, count(distinct image_id) as cov from pixels group by all"
        " union all select distinct r, g, b, 0, 0 from palette) group by r, g, b",
    ),
)
def d03(t: Tables) -> DataFrame:
    return histogram.color_coverage(t("pixels"), t("palette")).withColumn("coverage", F.col("coverage").cast("int"))


@query("d04_grey_histogram", c.q(("indexed",), "select image_id, idx, count(*) as n from indexed group by all"))
def d04(t: Tables) -> DataFrame:
    return histogram.grey_histogram(t("indexed"))


@query(
    "d04_grey_summary",
    c.q(
        ("indexed",),
        f"select image_id, count(*) as pixels, count(distinct idx) as unique_values, min(idx) as min_value, max(idx) as max_value,"
        f" {c.r4('count(distinct idx)/256.0*100.0')} as coverage_pct from indexed group by image_id",
    ),
)
def d04s(t: Tables) -> DataFrame:
    return histogram.grey_summary(t("indexed")).withColumn("coverage_pct", r4(F.col("coverage_pct"), "x"))


@query(
    "d05_dominant_color",
    c.q(
        ("indexed",),
        "select image_id, idx, r, g, b, n, pixels from (select *, row_number() over (partition by image_id, idx order by n desc, r, g, b) as rn,"
        " sum(n) over (partition by image_id, idx)::bigint as pixels from (select image_id, idx, r, g, b, count(*) as n from indexed group by all)) where rn=1",
    ),
)
def d05(t: Tables) -> DataFrame:
    return histogram.dominant_color(t("indexed"))


@query(
    "d06_representative_grey",
    c.q(("indexed",), "select image_id, idx, cast(floor(quantile_cont((299*r+587*g+114*b+500)//1000,0.5)) as int) as repr_grey from indexed group by image_id, idx"),
)
def d06(t: Tables) -> DataFrame:
    greys = t("indexed").withColumn("grey", color.luma601(*col()))
    return histogram.representative_grey(greys, ["image_id", "idx"])


@query(
    "d07_color_report",
    c.q(
        ("ipal",),
        f"select image_id, idx, r, g, b, frequency, {c.r4('frequency/total*100.0')} as frequency_pct,"
        " row_number() over (partition by image_id order by frequency desc, idx)<=10 as most_used,"
        " row_number() over (partition by image_id order by frequency, idx)<=10 as least_used from (select p.*, coalesce(h.n,0) as frequency,"
        " (select sum(n) from hist x where x.image_id=p.image_id) as total from ipal p left join hist h using (image_id, r, g, b))",
    ),
)
def d07(t: Tables) -> DataFrame:
    return histogram.color_report(t("ipal"), t("hist")).withColumn("frequency_pct", r4(F.col("frequency_pct"), "x"))


@query(
    "d08_suffix_counts",
    c.q(("assets",), f"select count(*) filter (ends_with(lower({c.stem('path')}),'_d')) as d_count, count(*) filter (ends_with(lower({c.stem('path')}),'_n')) as n_count from assets"),
)
def d08(t: Tables) -> DataFrame:
    return histogram.suffix_counts(t("assets"), paths.stem(F.col("path")))


OUTCOME_SQL = """select *, case when excluded_by is not null then 'excluded' when kind='UNKNOWN' then 'unknown' when error then 'error' when mtype='BGEM' then 'filtered'
 else 'json_'||lower(mtype) end as outcome from (select path, case when contains(lower(path),'m13') then 'm13' when contains(lower(path),'7.json') then '7.json' end as excluded_by,
 case when left(value,1) in ('{','[') then 'JSON' else 'UNKNOWN' end as kind, not json_valid(value) as error,
 case when not json_valid(value) then null when contains(value,'"sDiffuseTexture"') then 'BGSM' when contains(value,'"sBaseTexture"') then 'BGEM' else 'BGSM' end as mtype from material_json)"""


@query(
    "d09_run_summary",
    c.q(
        ("material_json",),
        "select count(*) as scanned, 0::bigint as processed_bgsm, 0::bigint as processed_bgem, count(*) filter (outcome='json_bgsm') as processed_json_bgsm,"
        " count(*) filter (outcome='json_bgem') as processed_json_bgem, count(*) filter (outcome in ('filtered','excluded')) as skipped_filtered,"
        " count(*) filter (outcome='excluded') as skipped_excluded, count(*) filter (outcome='unknown') as skipped_unknown, count(*) filter (outcome='error') as errors from o",
        ("o", OUTCOME_SQL),
    ),
)
def d09(t: Tables) -> DataFrame:
    records = t("material_json")
    kind = paths.material_kind(F.encode("value", "UTF-8"))
    files = materials.read_material_json(records.withColumn("kind", kind))
    return materials.run_summary(materials.with_outcome(files, ["m13", "7.JSON"], include_bgem=False))


def cooccurrence_sql(offsets: str) -> str:
    return (
        "select image_id, ia as idx_a, ib as idx_b, count(*) as n from (select a.image_id, a.idx as ia, b.idx as ib from indexed a,"
        f" (values {offsets}) as o(dx,dy) join indexed b on b.image_id=a.image_id and b.x=a.x+o.dx and b.y=a.y+o.dy where a.idx<>b.idx) p"
        " group by all"
    )


@query(
    "d10_cooccurrence",
    c.q(("indexed",), cooccurrence_sql("(1,0),(-1,0),(0,1),(0,-1),(1,1),(-1,-1),(-1,1),(1,-1)")),
)
def d10(t: Tables) -> DataFrame:
    return neighborhood.cooccurrence(t("indexed"))


@query("d10_cooccurrence_4way", c.q(("indexed",), cooccurrence_sql("(1,0),(-1,0),(0,1),(0,-1)")))
def d10f(t: Tables) -> DataFrame:
    return neighborhood.cooccurrence(t("indexed"), connectivity=4)


CUBE = "cast(floor(r/64)*16+floor(g/64)*4+floor(b/64) as int)"


def cube_members(t: Tables) -> DataFrame:
    return cluster.with_color_features(t("ghist"), "scope").withColumn("cluster", F.expr(CUBE))


CUBE_MEMBERS = (("feat", c.features("ghist")), ("members", f"select *, {CUBE} as cluster from feat"))


@query(
    "d11_cluster_stats",
    c.q(
        ("ghist",),
        f"select cluster, {c.r4('score')} as score, {c.r4('median_chroma')} as median_chroma, coverage, freq, size from ({c.stats('members')})",
        *CUBE_MEMBERS,
    ),
)
def d11(t: Tables) -> DataFrame:
    out = cluster.cluster_stats(cube_members(t), "scope").drop("scope")
    return out.withColumns({k: r4(F.col(k), k) for k in ("score", "median_chroma")})


@query("d12_cluster_medoid", c.q(("ghist",), f"select cluster, r, g, b, {c.r4('cost')} as cost from ({c.medoid('members', False)})", *CUBE_MEMBERS))
def d12(t: Tables) -> DataFrame:
    return cluster.cluster_medoid(cube_members(t), "scope").drop("scope").withColumn("cost", r4(F.col("cost"), "cost"))


@query("d12_cluster_medoid_weighted", c.q(("ghist",), f"select cluster, r, g, b, {c.r4('cost', 3)} as cost from ({c.medoid('members', True)})", *CUBE_MEMBERS))
def d12w(t: Tables) -> DataFrame:
    return cluster.cluster_medoid(cube_members(t), "scope", weighted=True).drop("scope").withColumn("cost", r4(F.col("cost"), "cost", 3))


@query(
    "d13_path_continuity",
    c.q(
        ("palette",),
        f"select palette_id, {c.r4('coalesce(sum(d),0)')} as total_de, {c.r4('coalesce(avg(d),0)')} as mean_de, {c.r4('coalesce(max(d),0)')} as max_de from"
        " (select palette_id, sqrt(pow(lab_l-lag(lab_l) over w,2)+pow(lab_a-lag(lab_a) over w,2)+pow(lab_b-lag(lab_b) over w,2)) as d"
        f" from {c.lab('palette')} window w as (partition by palette_id order by idx)) group by palette_id",
    ),
)
def d13(t: Tables) -> DataFrame:
    out = histogram.path_continuity(t("palette").withColumn("position", F.col("idx")))
    return out.select("palette_id", *[r4(F.col(k), k) for k in ("total_de", "mean_de", "max_de")])


@query(
    "d14_frac_grey",
    c.q(
        ("pixels",),
        f"select image_id, y, {c.r4('f')} as frac_grey, f>=0.9 as is_filler from (select image_id, y, avg(case when r//64=g//64 and g//64=b//64 then 1.0::double else 0.0::double end) as f from pixels group by all)",
    ),
)
def d14(t: Tables) -> DataFrame:
    coarse = t("pixels").selectExpr("image_id", "y", "cast(floor(r/64) as int) as r", "cast(floor(g/64) as int) as g", "cast(floor(b/64) as int) as b")
    return histogram.frac_grey(coarse, ["image_id", "y"]).withColumn("frac_grey", r4(F.col("frac_grey"), "x"))


@query(
    "d15_used_palette",
    c.q(
        ("indexed", "ipal"),
        "select p.image_id, p.idx, p.r, p.g, p.b from ipal p join (select image_id, max(idx%(40+image_id%20)) as m from indexed group by image_id) using (image_id) where p.idx<=m",
    ),
)
def d15(t: Tables) -> DataFrame:
    return histogram.used_palette(t("indexed").withColumn("idx", F.expr("idx%(40+image_id%20)")), t("ipal"))


@query(
    "d16_uv_set_groups",
    c.q(
        ("shapes",),
        "select mesh_path, diffuse, uv_index, array_to_string(list(shape_id order by shape_id),',') as shape_ids, diffuse||' - UV '||uv_index as label from"
        " (select *, unnest(range(n_sets))::int as uv_index from shapes where diffuse<>'') group by mesh_path, diffuse, uv_index",
    ),
)
def d16(t: Tables) -> DataFrame:
    shapes = t("shapes").withColumn("uv_sets", F.expr("array_repeat('uv', n_sets)"))
    return uv.uv_set_groups(shapes).withColumn("shape_ids", F.array_join(F.col("shape_ids").cast("array<string>"), ","))


@query(
    "b12_has_transparency",
    c.q(("pixels",), "select p.* from pixels p where image_id in (select image_id from pixels group by image_id having min(a)<255)"),
)
def b12(t: Tables) -> DataFrame:
    return histogram.with_transparency(t("pixels"))
