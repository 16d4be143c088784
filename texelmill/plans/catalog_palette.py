"""Named queries: mapping, ordering, neighbourhoods, palette construction and whole workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from texelmill.functions import color
from texelmill.operators import cluster, histogram, lut, mapping, neighborhood, ordering, quantize, uv
from texelmill.operators.neighborhood import FILL_SHIFTS, gaussian_weights
from texelmill.plans import check_sql as c
from texelmill.plans import palettes as flows
from texelmill.plans.catalog_color import CUBE_MEMBERS, bayer_sql, cube_members, r4
from texelmill.plans.registry import query
from texelmill.plans.views import SHAPE, Tables

RGB = ["r", "g", "b"]
PX_COLORS = "(select distinct palette_id, r, g, b from px)"
PX_NEAR = ("near", c.nearest(PX_COLORS, "palette", ("palette_id", "r", "g", "b"), "c.palette_id=p.palette_id"))

# ---- mapping ----------------------------------------------------------------------------------------------------------


@query("e01_map_to_palette", c.q(("px",), "select px.*, idx from px join near using (palette_id, r, g, b)", PX_NEAR))
def e01(t: Tables) -> DataFrame:
    return mapping.map_to_palette(t("px"), t("palette"))


@query("e01_map_exact_first", c.q(("px",), "select px.*, case when g=0 then 5 else idx end as idx from px join near using (palette_id, r, g, b)", PX_NEAR))
def e01x(t: Tables) -> DataFrame:
    exact = t("px").where("g = 0").select("palette_id", *RGB, F.lit(5).alias("exact_idx")).distinct()
    return mapping.map_to_palette(t("px"), t("palette"), exact=exact)


@query("e01_map_to_shared_palette", c.q(("pixels", "gpal"), "select p.*, idx from pixels p join near using (r, g, b)", ("near", c.nearest("(select r, g, b from ghist)", "gpal", ("r", "g", "b"), "true"))))
def e01s(t: Tables) -> DataFrame:
    return mapping.map_to_shared_palette(t("pixels"), t("gpal"))


@query("e02_apply_color_map", c.q(("pixels",), "select image_id, x, y, a, case when r>=128 then b else r end as r, case when r>=128 then r else g end as g, case when r>=128 then g else b end as b from pixels"))
def e02(t: Tables) -> DataFrame:
    turned = t("colors").where("r >= 128").select(*RGB, F.col("b").alias("rep_r"), F.col("r").alias("rep_g"), F.col("g").alias("rep_b"))
    return mapping.apply_color_map(t("pixels"), turned)


BIN = f"cast(cast(floor(round({c.hue('lab_a', 'lab_b')},6)/15.0) as int)%24 as int) as hue_bin"
LABBED = (("lc", f"select 0 as scope, *, {BIN} from {c.lab('colors')}"), ("lr", f"select 0 as scope, *, {BIN} from {c.lab('gpal')}"))
ASSIGNED = f"select r, g, b, rep_r, rep_g, rep_b, rep_idx, {c.r4('delta_e')} as delta_e from "


def _labbed(df: DataFrame) -> DataFrame:
    lab = color.with_lab(cluster.one_scope(df))
    return lab.withColumn("hue_bin", color.hue_bin(F.round(color.hue_angle(F.col("lab_a"), F.col("lab_b")), 6)))


@query("e03_assign_representatives", c.q(("colors", "gpal"), ASSIGNED + f"({c.assign('lc', 'lr', True)})", *LABBED))
def e03(t: Tables) -> DataFrame:
    out = mapping.assign_representatives(_labbed(t("colors")), _labbed(t("gpal")), "scope")
    return out.drop("scope").withColumn("delta_e", r4(F.col("delta_e"), "d"))


@query("e03_assign_nearest", c.q(("colors", "gpal"), ASSIGNED + f"({c.assign('lc', 'lr', False)})", *LABBED))
def e03n(t: Tables) -> DataFrame:
    out = mapping.assign_representatives(_labbed(t("colors")), _labbed(t("gpal")), "scope", same_bin_first=False)
    return out.drop("scope").withColumn("delta_e", r4(F.col("delta_e"), "d"))


def lut_sql() -> str:
    ch = ", ".join(f"cast(floor(round(lo.{k}+(hi.{k}-lo.{k})*(pos-floor(pos)),9)) as int) as {k}" for k in "rgb")
    return (
        f"select w.palette_id, w.i as idx, {ch} from (select palette_id, count(*) as n, unnest(range(256)) as i, unnest(range(256))*(count(*)-1)/255.0::double as pos from palette group by palette_id) w"
        " join palette lo on lo.palette_id=w.palette_id and lo.idx=floor(pos) join palette hi on hi.palette_id=w.palette_id and hi.idx=least(floor(pos)+1,n-1)"
    )


@query("e04_apply_lut", c.q(("indexed",), "select i.image_id, i.x, i.y, l.r, l.g, l.b, i.a from indexed i join lut l using (palette_id, idx)", ("lut", lut_sql())))
def e04(t: Tables) -> DataFrame:
    return mapping.apply_lut(t("indexed"), t("palette"))


@query("e04_palette_row", c.q(("pixels",), "select image_id as palette_id, x as idx, r, g, b from pixels p where y=least(30,(select max(y) from pixels m where m.image_id=p.image_id))"))
def e04r(t: Tables) -> DataFrame:
    return mapping.palette_row_at(t("pixels").withColumnRenamed("image_id", "palette_id"), 30)


def mask_sql(keys: str, src: str) -> str:
    xy = ", ".join(f"(u{k}-floor(u{k}))*(w-1) as x{k}, (v{k}-floor(v{k}))*(h-1) as y{k}" for k in range(3))

    def side(a: int, b: int) -> str:
        return f"(x{b}-x{a})*(y-y{a})-(y{b}-y{a})*(x-x{a})"

    e = f"{side(0, 1)},{side(1, 2)},{side(2, 0)}"
    box = "x between least(x0,x1,x2) and greatest(x0,x1,x2) and y between least(y0,y1,y2) and greatest(y0,y1,y2)"
    return (
        f"select distinct {keys}, x, y from (select *, {xy} from {src}), (select unnest(range(32))::int as x), (select unnest(range(32))::int as y)"
        f" where {box} and (least({e})>=0 or greatest({e})<=0)"
    )


MASK = ("mask", mask_sql("shape_id", "(select *, 32 as w, 32 as h from triangles)"))


def sized(t: Tables) -> DataFrame:
    return t("triangles").withColumns({"w": F.lit(32), "h": F.lit(32)})


@query("e11_uv_mask", c.q(("triangles",), "select * from mask", MASK))
def e11(t: Tables) -> DataFrame:
    return uv.uv_mask(sized(t), ("shape_id",))


@query(
    "e12_mask_alpha",
    c.q(("indexed", "triangles"), "select i.image_id, i.x, i.y, i.r, i.g, i.b, i.palette_id, case when m.x is null then 0 else i.a end as a, case when m.x is null or i.a=0 then 0 else i.idx end as idx"
        " from indexed i left join mask m on m.shape_id=i.image_id and m.x=i.x and m.y=i.y", MASK),
)
def e12(t: Tables) -> DataFrame:
    mask = uv.uv_mask(sized(t), ("shape_id",)).withColumnRenamed("shape_id", "image_id")
    return mapping.mask_alpha(t("indexed"), mask, "idx")


@query(
    "e13_group_index_remap",
    c.q(
        ("indexed", "gpal"),
        "select i.palette_id as group_id, i.image_id, i.x, i.y, n.idx as unified_idx from (select *, least(idx, (select max(idx) from palette p where p.palette_id=indexed.palette_id)) as gi from indexed) i"
        " join gp on gp.palette_id=i.palette_id and gp.idx=i.gi join near n on n.r=gp.r and n.g=gp.g and n.b=gp.b",
        ("gp", "select palette_id, idx, case when r<128 then 255-r else r end as r, case when r<128 then b else g end as g, case when r<128 then g else b end as b from palette"),
        ("near", c.nearest("(select distinct r, g, b from gp)", "gpal", ("r", "g", "b"), "true")),
    ),
)
def e13(t: Tables) -> DataFrame:
    group = t("palette").withColumnRenamed("palette_id", "group_id")
    reps = group.where("r < 128").select(*RGB, (F.lit(255) - F.col("r")).alias("rep_r"), F.col("b").alias("rep_g"), F.col("g").alias("rep_b")).distinct()
    index = t("indexed").withColumnRenamed("palette_id", "group_id").select("group_id", "image_id", "x", "y", "idx")
    return mapping.group_index_remap(index, group, reps, t("gpal"))


# ---- ordering ---------------------------------------------------------------------------------------------------------


@query("f01_lightness_sort", c.q(("palette",), c.lightness_order("palette", "palette_id")))
def f01(t: Tables) -> DataFrame:
    return ordering.lightness_sort(t("palette"))


def hue_sql(final: str) -> tuple[tuple[str, str], ...]:
    return (
        ("l0", f"select *, round({c.hue('lab_a', 'lab_b')},6) as hue, round({c.chroma('lab_a', 'lab_b')},6) as ch, round(lab_l,6) as l from {c.lab('palette')}"),
        ("l1", "select *, row_number() over w as rn, round(coalesce(lead(hue) over w, min(hue) over (partition by palette_id)+360)-hue,6) as gap from l0 window w as (partition by palette_id order by hue, idx)"),
        ("rot", "select palette_id, hue as rot from (select *, row_number() over (partition by palette_id order by gap desc, rn) as k from l1) where k=1"),
        ("l2", "select l1.*, round(case when hue-rot<0 then hue-rot+360 else hue-rot end,6) as u from l1 join rot using (palette_id)"),
        ("l3", "select *, max(u) over p - min(u) over p > 90 as wide from l2 window p as (partition by palette_id)"),
        ("l4", "select *, row_number() over (partition by palette_id order by case when wide then u else l end, case when wide then l else ch end, idx)-1 as up,"
         " row_number() over (partition by palette_id order by case when wide then u else -l end, case when wide then -l else ch end, idx)-1 as down from l3"),
        *[(f"c_{n}", f"select palette_id, round(sum(d),6) as cost from (select palette_id, sqrt(pow(lab_l-lag(lab_l) over w,2)+pow(lab_a-lag(lab_a) over w,2)+pow(lab_b-lag(lab_b) over w,2)) as d from l4 window w as (partition by palette_id order by {n})) group by palette_id") for n in ("up", "down")],
        ("fin", final),
    )


@query("f02_hue_sort", c.q(("palette",), "select * from fin", *hue_sql("select palette_id, idx, r, g, b, cast(up as int) as position from l4")))
def f02(t: Tables) -> DataFrame:
    return ordering.hue_sort(t("palette"))


@query(
    "f02_hue_sort_cheaper",
    c.q(("palette",), "select * from fin", *hue_sql("select l4.palette_id, idx, r, g, b, cast(case when coalesce(a.cost<=b.cost,true) then up else down end as int) as position from l4 join c_up a using (palette_id) join c_down b using (palette_id)".replace("r, g, b", "l4.r, l4.g, l4.b").replace("b.cost", "z.cost").replace("c_down b", "c_down z"))),
)
def f02c(t: Tables) -> DataFrame:
    return ordering.hue_sort(t("palette"), direction="cheaper")


@query("f03_polish_order")
def f03(t: Tables) -> DataFrame:
    return ordering.polish_order(ordering.hue_sort(t("palette"), direction="cheaper"))


#: The greedy walk step by step: from the last entry to the open one of least cost.
WALK = (
    ("ix!", "select px.image_id, x, y, palette_id, idx from px join near using (palette_id, r, g, b)"),
    ("meet", "select a.palette_id, a.idx as ia, b.idx as ib from ix a, (values (1,0),(0,1),(1,1),(-1,1)) d(dx,dy), ix b where b.image_id=a.image_id and b.x=a.x+dx and b.y=a.y+dy and a.idx<>b.idx"),
    ("links!", "select palette_id, i, j, count(*)::double as n from (select palette_id, ia as i, ib as j from meet union all select palette_id, ib, ia from meet) group by all"),
    ("pl!", f"select palette_id, idx, r, g, b, lab_l, lab_a, lab_b from {c.lab('palette')}"),
    ("far!", "select palette_id, i, j, round(de, 9) as far from " + c.de00(
        "(select p.palette_id, p.idx as i, q.idx as j, p.lab_l as l1, p.lab_a as a1, p.lab_b as b1, q.lab_l as l2, q.lab_a as a2, q.lab_b as b2 from pl p join pl q on p.palette_id=q.palette_id)", ("l1", "a1", "b1"), ("l2", "a2", "b2"), "de")),
    ("cost!", "select palette_id, i, j, 0.7::double*far/greatest(max(far) over p, 1e-12)+(1-0.7::double)*(1-coalesce(n, 0)/greatest(max(coalesce(n, 0)) over p, 1e-12)) as cost from far left join links using (palette_id, i, j) window p as (partition by palette_id)"),
    ("walk!", "with recursive w(palette_id, step, last, seen) as (select palette_id, 0, arg_min(idx, (lab_l, idx)), [arg_min(idx, (lab_l, idx))] from pl group by palette_id union all"
     " select palette_id, step+1, j, list_append(seen, j) from (select w.palette_id, step, seen, j, row_number() over (partition by w.palette_id order by cost, j) as k from w join cost c on c.palette_id=w.palette_id and c.i=w.last where not list_contains(seen, j)) where k=1)"
     " select palette_id, step as position, last as idx from w"),
)


@query("f04_adjacency_sort", c.q(("px", "palette"), "select palette_id, idx, r, g, b, position from walk join palette using (palette_id, idx)", PX_NEAR, *WALK))
def f04(t: Tables) -> DataFrame:
    indexed = mapping.map_to_palette(t("px"), t("palette"))
    links = neighborhood.cooccurrence(indexed, by=("image_id",))
    links = links.join(t("px").select("image_id", "palette_id").distinct(), "image_id")
    links = links.groupBy("palette_id", "idx_a", "idx_b").agg(F.sum("n").alias("n"))
    return ordering.adjacency_sort(t("palette"), links)


SCORED = "select * replace (round(score,6) as score), cluster%24 as hue_bin from (" + c.stats("members") + ")"
PICKED = "select cluster, hue_bin, rank::int as rank, kept, pick::int as pick from "


def scored(t: Tables) -> DataFrame:
    return cluster.cluster_stats(cube_members(t), "scope").withColumns({"score": F.round("score", 6), "hue_bin": F.col("cluster") % 24})


@query("f05_select_hue_balanced", c.q(("ghist",), PICKED + f"({c.hue_balanced('cl', 30)})", *CUBE_MEMBERS, ("cl", SCORED)))
def f05(t: Tables) -> DataFrame:
    return cluster.select_hue_balanced(scored(t), "scope", 30).select("cluster", "hue_bin", "rank", "kept", "pick")


@query("f06_select_largest", c.q(("ghist",), PICKED + f"({c.largest('cl', 20)})", *CUBE_MEMBERS, ("cl", SCORED)))
def f06(t: Tables) -> DataFrame:
    return cluster.select_largest(scored(t), "scope", 20).select("cluster", "hue_bin", "rank", "kept", "pick")


def coarse_sql(bins: int, levels: int) -> tuple[tuple[str, str], ...]:
    return (
        ("k0", f"select palette_id, idx, cast(case when s<0.05 then {bins} else least(floor(h*{bins}),{bins - 1}) end as int) as bin, greatest(r,g,b) as val, s as sat from {c.hsv('palette')}"),
        ("k1", "select *, row_number() over (partition by palette_id, bin order by val, sat desc, idx)-1 as pos, count(*) over (partition by palette_id, bin) as n from k0"),
        ("k2", f"select *, case when pos < (n%{levels})*(n//{levels}+1) then pos//(n//{levels}+1) else n%{levels}+(pos-(n%{levels})*(n//{levels}+1))//(n//{levels}) end as run from k1 where n>{levels}"),
        ("k3", "select *, max(sat) over w as top, quantile_cont(val,0.5) over w as mid, count(*) over w as rs, row_number() over (partition by palette_id, bin, run order by pos)-1 as rp from k2 window w as (partition by palette_id, bin, run)"),
        ("reps", "select palette_id, bin, run, idx as rep, val as rv from (select *, row_number() over (partition by palette_id, bin, run order by case when top>0 then abs(val-mid) else case when rp=rs//2 then 0 else 1 end end, pos) as k"
         " from k3 where top=0 or sat>=top-1e-6) where k=1"),
        ("cm", "select palette_id, idx, bin, coalesce(rep, idx) as coarse_idx from (select k1.palette_id, k1.idx, k1.bin, rep, row_number() over (partition by k1.palette_id, k1.idx order by abs(rv-val), run) as k from k1 left join reps using (palette_id, bin)) where k=1"),
    )


@query("f07_coarse_index_map", c.q(("palette",), "select * from cm", *coarse_sql(12, 3)))
def f07(t: Tables) -> DataFrame:
    return ordering.coarse_index_map(t("palette"), levels=3)


RANGES = "select image_id, string_agg(case when lo=hi then lo::varchar else lo||'-'||hi end, ', ' order by lo) as txt from (select image_id, min(idx) as lo, max(idx) as hi from (select *, idx-row_number() over (partition by image_id order by idx) as isl from {0}) group by image_id, isl) group by image_id"


@query(
    "f08_index_ranges",
    c.q(
        ("indexed",),
        f"select p.image_id, p.txt as present_ranges, coalesce(m.txt,'(none)') as missing_ranges from ({RANGES.format('pres')}) p left join ({RANGES.format('mis')}) m using (image_id)",
        ("pres", "select distinct image_id, idx from indexed"),
        ("mis", "select image_id, idx from (select distinct image_id from indexed), (select unnest(range(256)) as idx) where (image_id, idx) not in (select (image_id, idx) from pres)"),
    ),
)
def f08(t: Tables) -> DataFrame:
    return histogram.index_ranges(t("indexed"))


@query(
    "f09_palette_slots",
    c.q(
        ("indexed", "ipal"),
        "select image_id, slot as idx, coalesce(last_value(cc ignore nulls) over (partition by image_id order by slot rows between unbounded preceding and current row), first_value(cc ignore nulls) over (partition by image_id order by slot rows between current row and unbounded following)) as cc from"
        " (select image_id, slot from (select distinct image_id from tk), (select unnest(range(32))::int as slot)) left join tk using (image_id, slot)",
        ("gm", "select image_id, idx, cast(floor(quantile_cont((299*r+587*g+114*b+500)//1000,0.5)) as int) as grey from indexed group by image_id, idx"),
        ("tk", "select image_id, cast(grey*31//255 as int) as slot, arg_min(r||'.'||g||'.'||b, idx) as cc from gm join ipal using (image_id, idx) group by 1, 2"),
    ),
)
def f09(t: Tables) -> DataFrame:
    greys = t("indexed").withColumn("grey", color.luma601(F.col("r"), F.col("g"), F.col("b")))
    return histogram.palette_slots(greys, t("ipal"), 32).select("image_id", "idx", F.concat_ws(".", *RGB).alias("cc"))


@query("f11_unique_color_order", c.q(("pixels",), "select image_id, r, g, b, (min(y*32+x)//32)::int as first_y, (min(y*32+x)%32)::int as first_x from pixels group by image_id, r, g, b"))
def f11(t: Tables) -> DataFrame:
    return histogram.first_appearance(t("pixels"))


LINES = ("ln", "select image_id, y, min(x) as x0, max(x) as x1, min(min(y)) over (partition by image_id) as y0, max(max(y)) over (partition by image_id) as y1 from indexed group by image_id, y")


def around(cols: str, src: str) -> str:
    """Each pixel with the pixels at offsets dx, dy, edges repeated."""
    return (
        f"(select p.image_id, p.x, p.y, o.dx, o.dy, {cols} from (select i.*, y0, y1 from {src} i join ln using (image_id, y)) p, offs o"
        " join ln l on l.image_id=p.image_id and l.y=greatest(p.y0,least(p.y1,p.y+o.dy))"
        f" join {src} v on v.image_id=p.image_id and v.y=l.y and v.x=greatest(l.x0,least(l.x1,p.x+o.dx)))"
    )


OFFS3 = ("offs", "select unnest([-1,0,1]) as dx, dy from (select unnest([-1,0,1]) as dy)")
MEDIAN = f"select image_id, x, y, list_sort(list(v))[5] as idx from {around('v.idx as v', 'indexed')} group by image_id, x, y"


@query("f12_median_filter", c.q(("indexed",), "select * from med", LINES, OFFS3, ("med", MEDIAN)))
def f12(t: Tables) -> DataFrame:
    return neighborhood.median_filter(t("indexed"), 3)


OFFS9 = ("offs", "select dx, dy from (select unnest(range(-4, 5)) as dx) cross join (select unnest(range(-4, 5)) as dy)")


@query("f12_median_filter_wide", c.q(("indexed",), "select * from med", LINES, OFFS9, ("med", MEDIAN.replace("[5]", "[41]"))))
def f12w(t: Tables) -> DataFrame:
    return neighborhood.median_filter(t("indexed"), 9)


def gauss_ctes(sigma: float) -> tuple[tuple[str, str], ...]:
    w = gaussian_weights(sigma)
    k = len(w) // 2
    weights = ", ".join(f"({i - k}, {v!r}::double)" for i, v in enumerate(w))
    along = f"(select dx, 0 as dy, wt from (values {weights}) as q(dx, wt))"
    down = f"(select 0 as dx, dx as dy, wt from (values {weights}) as q(dx, wt))"
    return (
        LINES,
        ("hor", f"select image_id, x, y, sum(v*wt) as idx from {around('v.idx as v, o.wt', 'indexed').replace('offs o', along + ' o')} group by image_id, x, y"),
        ("ver", f"select image_id, x, y, sum(v*wt) as v from {around('v.idx as v, o.wt', 'hor').replace('offs o', down + ' o')} group by image_id, x, y"),
    )


@query("f13_gaussian_filter", c.q(("indexed",), f"select image_id, x, y, {c.r4('v')} as idx from ver", *gauss_ctes(0.6)))
def f13(t: Tables) -> DataFrame:
    return neighborhood.gaussian_filter(t("indexed"), 0.6, whole=False).withColumn("idx", r4(F.col("idx"), "idx"))


@query("f14_smooth_dither_median", c.q(("indexed",), bayer_sql("med", 64, 0.2), LINES, OFFS3, ("med", MEDIAN)))
def f14(t: Tables) -> DataFrame:
    return neighborhood.smooth_dither(t("indexed"), 64, "median_dither")


@query("f14_smooth_dither_gaussian", c.q(("indexed",), bayer_sql("gw", 64, 0.2), *gauss_ctes(0.6), ("gw", "select image_id, x, y, cast(floor(round(v,6)+0.5) as int) as idx from ver")))
def f14g(t: Tables) -> DataFrame:
    return neighborhood.smooth_dither(t("indexed"), 64, "gaussian_dither")


@query("f14_smooth_dither_none", c.q(("indexed",), "select image_id, x, y, least(idx, 31) as idx from indexed"))
def f14n(t: Tables) -> DataFrame:
    return neighborhood.smooth_dither(t("indexed"), 32, "none")


# ---- quantization -----------------------------------------------------------------------------------------------------


def median_cut_sql(k: int, hist: str = "hist", prefix: str = "r", extra: int = 6) -> tuple[tuple[str, str], ...]:
    """Rounds that fill up to k boxes, and ``extra`` ones for boxes that hot colours leave early; the last round is ``<prefix>z``, its means ``<prefix>mp``."""
    ctes, src, rounds = [], f"(select *, 0::bigint as box from {hist})", (k - 1).bit_length() + extra
    for i in range(rounds):
        a = f"select *, max(r) over w-min(r) over w as sr, max(g) over w-min(g) over w as sg, max(b) over w-min(b) over w as sb from {src} window w as (partition by image_id, box)"
        v = f"select *, case when sg>=sr and sg>=sb then g when sr>=sb then r else b end as v from ({a})"
        s = f"select *, sum(n) over (partition by image_id, box order by v range between unbounded preceding and current row) as upto, sum(n) over w as al, max(v) over w as top, min(v) over w as low from ({v}) window w as (partition by image_id, box)"
        h = f"select *, min(case when upto*2>=al then v end) over (partition by image_id, box) as half, dense_rank() over (partition by image_id order by al*(top-low) desc, box) as rk from ({s})"
        m = f"select *, max(rk) over (partition by image_id) as total from ({h})"
        name = f"{prefix}{i}" if i + 1 < rounds else f"{prefix}z"
        ctes.append((f"{name}!", f"select image_id, r, g, b, n, box*2+cast(v > (case when half=top then half-1 else half end) and top>low and rk<={k}-total as int) as box from ({m})"))
        src = name
    return (*ctes, (f"{prefix}mp!", c.means(src)))


@query("g01a_median_cut", c.q(("hist",), "select image_id, idx, r, g, b from rmp", *median_cut_sql(8)))
def g01a(t: Tables) -> DataFrame:
    return quantize.median_cut(t("hist"), 8)["palette"]


@query("g01a_median_cut_map", c.q(("hist",), "select h.image_id, h.r, h.g, h.b, rmp.idx from rz h join rmp using (image_id, box)", *median_cut_sql(16)))
def g01am(t: Tables) -> DataFrame:
    return quantize.median_cut(t("hist"), 16)["color_map"]


@query("g01a_median_cut_48", c.q(("hist",), "select image_id, idx, r, g, b from rmp", *median_cut_sql(48)))
def g01a48(t: Tables) -> DataFrame:
    return quantize.median_cut(t("hist"), 48)["palette"]


SKEWED = ("skew", "select image_id, r, g, b, case when (r*7+g*3+b)%11=0 then n*100000 else n end as n from hist")


@query("g01a_median_cut_skewed", c.q(("hist",), "select image_id, idx, r, g, b from rmp", SKEWED, *median_cut_sql(40, "skew", extra=14)))
def g01ask(t: Tables) -> DataFrame:
    """A few colours hold nearly all pixels; the palette still has 40 entries wherever there are 40 colours."""
    return quantize.median_cut(t("hist").withColumn("n", F.expr("case when (r*7+g*3+b)%11=0 then n*100000 else n end")), 40)["palette"]


FARTHEST = (
    ("far!", "with recursive f(image_id, r, g, b, n, step, cr, cg, cb, reach, gain) as (select image_id, r, g, b, n, 0, cr, cg, cb, (r-cr)**2+(g-cg)**2+(b-cb)**2, 1.0::double from"
     " (select *, first_value(r) over w as cr, first_value(g) over w as cg, first_value(b) over w as cb from hist window w as (partition by image_id order by n desc, r, g, b)) union all"
     " select image_id, r, g, b, n, step+1, cr, cg, cb, least(reach, (r-cr)**2+(g-cg)**2+(b-cb)**2), gain from (select image_id, r, g, b, n, step, reach, first_value(r) over w as cr, first_value(g) over w as cg,"
     " first_value(b) over w as cb, first_value(reach) over w as gain from f where step<31 window w as (partition by image_id order by reach desc, n desc, r, g, b)))"
     " select distinct image_id, step as box, cr as r, cg as g, cb as b from f where gain>0"),
)


@query("g01b_max_coverage", c.q(("hist",), "select image_id, row_number() over (partition by image_id order by r, g, b, box)-1 as idx, r, g, b from far", *FARTHEST))
def g01b(t: Tables) -> DataFrame:
    return quantize.max_coverage(t("hist"), 32)["palette"]


OCT = ("oct", c.octree("hist", 32))


@query("g01c_fast_octree", c.q(("hist",), "select * from oct", OCT))
def g01c(t: Tables) -> DataFrame:
    return quantize.fast_octree(t("hist"), 32)["palette"]


@query("g01c_fast_octree_map", c.q(("hist",), c.mapped("hist", "oct"), OCT))
def g01cm(t: Tables) -> DataFrame:
    return quantize.fast_octree(t("hist"), 32)["color_map"]


@query("g01c_fullest_buckets", c.q(("hist",), c.fullest_buckets("hist", 32)))
def g01cb(t: Tables) -> DataFrame:
    return quantize.fullest_buckets(t("hist"), 32)["palette"]


@query("g01c_fast_octree_200", c.q(("hist",), c.octree("hist", 200)))
def g01c200(t: Tables) -> DataFrame:
    return quantize.fast_octree(t("hist"), 200)["palette"]


def lloyd_ctes(rounds: int, seed: tuple[tuple[str, str], ...] = (OCT,), pal: str = "oct") -> tuple[tuple[str, str], ...]:
    ctes = list(seed)
    for i in range(rounds):
        near = c.mapped("hist", pal)
        ctes.append((f"lm{i}!", c.means(f"(select h.*, m.idx as box from hist h join ({near}) m using (image_id, r, g, b))")))
        pal = f"lm{i}"
    return tuple(ctes)


@query("g01d_kmeans_adaptive", c.q(("hist",), "select image_id, idx, r, g, b from lm1", *lloyd_ctes(2)))
def g01d(t: Tables) -> DataFrame:
    return quantize.kmeans_adaptive(t("hist"), 32)["palette"]


@query("g01e_error_bounded", c.q(("hist",), "select image_id, idx, r, g, b from lm2", *lloyd_ctes(3, median_cut_sql(32), "rmp")))
def g01e(t: Tables) -> DataFrame:
    return quantize.error_bounded(t("hist"), 32)["palette"]


def best_first_ctes(k: int, target: float, hist: str = "hist") -> tuple[tuple[str, str], ...]:
    """One split a step and image: of all cuts of all boxes the one that removes most squared error, until k boxes or the error a pixel is at most ``target``. ``bfz`` has the boxes."""
    sums = ", ".join(f"sum({e}) over w::double as l{a}, sum({e}) over u::double as t{a}" for a, e in (("n", "n"), ("r", "n*r"), ("g", "n*g"), ("b", "n*b")))
    sides = "select f.*, ch, case ch when 0 then r when 1 then g else b end as v from f, (select unnest([0, 1, 2]) as ch) where step<%d and err>%r*total" % (k - 1, target)
    cuts = f"select *, {sums} from ({sides}) window w as (partition by image_id, box, ch order by v range between unbounded preceding and current row), u as (partition by image_id, box, ch)"
    apart = "+".join(f"((tn-ln)*l{c}-ln*(t{c}-l{c}))*((tn-ln)*l{c}-ln*(t{c}-l{c}))" for c in "rgb")
    gains = f"select *, case when tn>ln then ({apart})/(tn*ln*(tn-ln)) else 0.0 end as gain from ({cuts})"
    pick = f"select *, first_value(gain) over o as bg, first_value(box) over o as bb, first_value(ch) over o as bc, first_value(v) over o as bv from ({gains}) window o as (partition by image_id order by gain desc, box, ch, v)"
    step = f"select image_id, r, g, b, n, case when box=bb and (case bc when 0 then r when 1 then g else b end)>bv then step+1 else box end, step+1, err-bg, total from ({pick}) where ch=0 and bg>0"
    sse = "sum(n*(r*r+g*g+b*b)) over w::double-(sum(n*r) over w::double*sum(n*r) over w::double+sum(n*g) over w::double*sum(n*g) over w::double+sum(n*b) over w::double*sum(n*b) over w::double)/sum(n) over w"
    return (
        ("bf!", f"with recursive f(image_id, r, g, b, n, box, step, err, total) as (select image_id, r, g, b, n, 0::bigint, 0, {sse}, sum(n) over w from {hist} window w as (partition by image_id) union all {step}) select * from f"),
        ("bfz!", "select * from (select *, max(step) over (partition by image_id) as last from bf) where step=last"),
        ("bfmp!", c.means("bfz")),
    )


@query("g01e_best_first", c.q(("hist",), "select image_id, r, g, b, n, box from bfz", *best_first_ctes(32, 0.0)))
def g01ebf(t: Tables) -> DataFrame:
    """Boxes of the best-first order; 32 in every image that has so many colours."""
    return quantize.variance_split(t("hist"), 32)


@query("g01e_enough_quality", c.q(("hist",), "select image_id, idx, r, g, b from bfmp", *best_first_ctes(48, quantize.quality_error(60))))
def g01een(t: Tables) -> DataFrame:
    """Palettes only as large as a quality of 60 needs."""
    boxes = quantize.variance_split(t("hist"), 48, quantize.quality_error(60))
    return quantize._with_dense_idx(boxes.groupBy("image_id", "box").agg(*[quantize._mean(x) for x in "rgb"])).select("image_id", "idx", *"rgb")


def floor_ctes(k: int) -> tuple[tuple[str, str], ...]:
    """``lmz``: best-first boxes refined by three rounds, or the median cut of images that stay below a quality of 85; ``mapz``: colours to entries; ``told``: who fell back."""
    return (
        *best_first_ctes(k, 0.0),
        *lloyd_ctes(3, (), "bfmp"),
        *median_cut_sql(k),
        ("fine!", c.mapped("hist", "lm2")),
        ("apart!", "select m.image_id, h.n, (h.r-p.r)**2+(h.g-p.g)**2+(h.b-p.b)**2 as d from fine m join hist h using (image_id, r, g, b) join lm2 p on p.image_id=m.image_id and p.idx=m.idx"),
        ("told!", f"select image_id, sum(d*n)/sum(n)>{quantize.quality_error(85)!r} as fell_back from apart group by image_id"),
        ("lmz!", "select image_id, idx, r, g, b from lm2 join told using (image_id) where not fell_back union all select image_id, idx, r, g, b from rmp join told using (image_id) where fell_back"),
        ("mapz!", "select image_id, r, g, b, idx from fine join told using (image_id) where not fell_back union all"
         " select h.image_id, h.r, h.g, h.b, rmp.idx from rz h join rmp using (image_id, box) join told on told.image_id=h.image_id where fell_back"),
    )


@query("g01e_quality_floor", c.q(("hist",), "select image_id, idx, r, g, b, fell_back from lmz join told using (image_id)", *floor_ctes(24)))
def g01eq(t: Tables) -> DataFrame:
    """24 colours at a quality of 85 or more, the median cut where that fails."""
    out = quantize.quality_bounded(t("hist"), 24)
    return out["palette"].join(out["quality"].select("image_id", "fell_back"), "image_id")


UNIFORM = (
    *median_cut_sql(16, prefix="u"),
    ("flat", "select h.image_id, p.r, p.g, p.b, sum(h.n) as n from uz h join ump p using (image_id, box) group by all"),
    *median_cut_sql(16, "flat"),
)


@query("g01f_uniform", c.q(("hist",), "select image_id, idx, r, g, b from rmp", *UNIFORM))
def g01f(t: Tables) -> DataFrame:
    return quantize.uniform(t("hist"), 16)["palette"]


@query("g01_quantize_index_image", c.q(("pixels", "hist"), "select p.image_id, p.x, p.y, m.idx, p.a from pixels p join (" + c.mapped("hist", "oct") + ") m using (image_id, r, g, b)", OCT))
def g01(t: Tables) -> DataFrame:
    return quantize.quantize(t("pixels"), "fast_octree", 32, None)["index_image"]


# ---- lookup tables ----------------------------------------------------------------------------------------------------


def upscale_sql(sigma: float) -> str:
    w = gaussian_weights(sigma)
    k = len(w) // 2
    weights = ", ".join(f"({i - k}, {v!r}::double)" for i, v in enumerate(w))
    wide = (
        "select w.palette_id, w.i, " + ", ".join(f"lo.{ch}+(hi.{ch}-lo.{ch})*(pos-floor(pos)) as {ch}" for ch in "rgb")
        + " from (select palette_id, count(*) as n, unnest(range(256)) as i, unnest(range(256))*(count(*)-1)/255.0::double as pos from palette group by palette_id) w"
        " join palette lo on lo.palette_id=w.palette_id and lo.idx=floor(pos) join palette hi on hi.palette_id=w.palette_id and hi.idx=least(floor(pos)+1,n-1)"
    )
    ch = ", ".join(f"cast(greatest(0,least(255,round_even(round(sum(m.{k}*wt),6),0))) as int) as {k}" for k in "rgb")
    return (
        f"with wide as ({wide}) select t.palette_id, t.i::int as idx, {ch} from wide t, (values {weights}) as q(d, wt)"
        " join wide m on m.palette_id=t.palette_id and m.i=case when abs(t.i+d)>255 then 510-abs(t.i+d) else abs(t.i+d) end group by t.palette_id, t.i"
    )


@query("g02_upscale_lut", c.q(("palette",), "select * from up", ("up", upscale_sql(1.0))))
def g02(t: Tables) -> DataFrame:
    return lut.upscale_lut(t("palette"), 256, 1.0)


@query("g03_downsample_lut", c.q(("palette",), "select palette_id, k::int as idx, r, g, b from up join (select unnest(range(24)) as k) on up.idx=k*255//23", ("up", upscale_sql(1.0))))
def g03(t: Tables) -> DataFrame:
    return lut.downsample_lut(lut.upscale_lut(t("palette"), 256, 1.0), 24)


def scoped_hist(t: Tables) -> DataFrame:
    return cluster.with_color_features(t("hist").withColumnRenamed("image_id", "scope"), "scope")


@query("g04_cluster_colors", c.q(("ghist",), "select r, g, b, threshold, cluster from members", ("feat", c.features("ghist")), *c.cells("feat", 64)))
def g04(t: Tables) -> DataFrame:
    return cluster.cluster_cells(cluster.with_color_features(t("ghist"), "scope"), "scope", 64).select(*RGB, "threshold", "cluster")


@query(
    "g04_cluster_colors_per_image",
    c.q(("hist",), "select scope as image_id, r, g, b, threshold, cluster from members", ("ih", "select image_id as scope, r, g, b, n, 1 as coverage from hist"), ("feat", c.features("ih")), *c.cells("feat", 100)),
)
def g04i(t: Tables) -> DataFrame:
    return cluster.cluster_cells(scoped_hist(t), "scope", 100).select(F.col("scope").alias("image_id"), *RGB, "threshold", "cluster")


@query("g04_cluster_colors_exact")
def g04x(t: Tables) -> DataFrame:
    few = quantize.fast_octree(t("hist"), 64)["palette"].withColumnRenamed("image_id", "scope").withColumn("n", F.lit(1))
    return cluster.cluster_leader(cluster.with_color_features(few, "scope"), "scope", 32).select("scope", *RGB, "threshold", "cluster")


@query("g05_reduce_palette", c.q(("ghist",), "select idx, r, g, b from pal", *c.reduced(48, True)))
def g05(t: Tables) -> DataFrame:
    return cluster.reduce_palette(t("ghist"), "scope", 48)["palette"].drop("scope")


@query("g05_reduce_color_map", c.q(("ghist",), ASSIGNED + "cmap", *c.reduced(48, True)))
def g05m(t: Tables) -> DataFrame:
    out = cluster.reduce_palette(t("ghist"), "scope", 48)["color_map"].drop("scope")
    return out.withColumn("delta_e", r4(F.col("delta_e"), "d"))


@query("g06_build_palette", c.q(("ghist",), "select idx, r, g, b from pal", *c.reduced(48, False)))
def g06(t: Tables) -> DataFrame:
    return cluster.build_palette(t("ghist"), "scope", 48)["palette"].drop("scope")


@query("g06_build_color_map", c.q(("ghist",), ASSIGNED + "cmap", *c.reduced(48, False)))
def g06m(t: Tables) -> DataFrame:
    out = cluster.build_palette(t("ghist"), "scope", 48)["color_map"].drop("scope")
    return out.withColumn("delta_e", r4(F.col("delta_e"), "d"))


PAL_HIST = ("phist", "select palette_id, r, g, b, count(*) as n from px group by all")


@query("g07_pad_palette", c.q(("px",), "select * from pd", PAL_HIST, ("pd", c.padded("palette", "palette_id", 200, "phist", None))))
def g07(t: Tables) -> DataFrame:
    return lut.pad_palette(t("palette"), 200, "palette_id", histogram.color_histogram(t("px"), ["palette_id"]))


# at most eight colours per palette, so every padding strategy is needed
COARSE_SQL = "select palette_id, cast(row_number() over (partition by palette_id order by r, g, b)-1 as int) as idx, r, g, b from (select distinct palette_id, r//128*200 as r, g//128*200 as g, b//128*200 as b from palette)"


@query("g07_pad_palette_to_256", c.q(("px",), "select * from pd", PAL_HIST, ("few", COARSE_SQL), ("pd", c.padded("few", "palette_id", 256, "phist", None))))
def g07f(t: Tables) -> DataFrame:
    coarse = t("palette").selectExpr("palette_id", *[f"cast(floor({k}/128)*200 as int) as {k}" for k in RGB]).distinct()
    place = F.row_number().over(Window.partitionBy("palette_id").orderBy(*RGB)) - 1
    few = coarse.select("palette_id", place.alias("idx"), *RGB)
    return lut.pad_palette(few, 256, "palette_id", histogram.color_histogram(t("px"), ["palette_id"]))


IMAGE_BASE = ("base", "select distinct i.image_id, p.idx, p.r, p.g, p.b from (select distinct image_id, palette_id from px) i join palette p using (palette_id)")


@query("g08_build_row", c.q(("indexed",), f"select * replace ({c.r4('delta_e')} as delta_e) from br", IMAGE_BASE, ("br", c.row_built("indexed", "base", "image_id"))))
def g08(t: Tables) -> DataFrame:
    base = t("px").select("image_id", "palette_id").distinct().join(t("palette"), "palette_id").drop("palette_id")
    return lut.build_row(t("indexed"), base).withColumn("delta_e", r4(F.col("delta_e"), "d"))


@query(
    "g08_top_colors",
    c.q(("indexed",), "select * from (select *, row_number() over (partition by image_id, idx order by n desc, r, g, b)::int as rank from (select image_id, idx, r, g, b, count(*) as n from indexed group by all)) where rank<=3"),
)
def g08t(t: Tables) -> DataFrame:
    return histogram.top_colors(t("indexed"), 3)


TEXTURE_COLS = "cast(image_id as int) as palette_id, x, y, case when image_id%5=0 or (image_id%3=0 and y%8=0) then g else r end as r, g, case when image_id%5=0 or (image_id%3=0 and y%8=0) then g else b end as b"
EXTRACTED = (
    ("tex", f"select {TEXTURE_COLS} from pixels"),
    ("tl", "select palette_id, y, avg(case when r=g and g=b then 1.0::double else 0 end) as f, max(max(y)) over (partition by palette_id)+1 as h from tex group by palette_id, y"),
    ("good", "select palette_id, y from tl where y%4=0 and y < greatest(h//4,1)*4 and f<0.9"),
    ("pick", "select * from good union all select distinct palette_id, h//2 from tl where palette_id not in (select palette_id from good)"),
    ("ext", "select palette_id, cast(y//4 as int) as row_no, x as idx, r, g, b from tex join pick using (palette_id, y)"),
)


def texture(t: Tables) -> DataFrame:
    return t("pixels").selectExpr(*[e.strip() for e in TEXTURE_COLS.split(", ") if e])


@query("g09_extract_rows", c.q(("pixels",), "select * from ext", *EXTRACTED))
def g09(t: Tables) -> DataFrame:
    return lut.extract_rows(texture(t), 4)


STACKED = ("stk", "select cast(palette_id//3 as int) as palette_id, palette_id%3 as row_no, idx, r, g, b from palette")


def stacked(t: Tables) -> DataFrame:
    return t("palette").selectExpr("cast(floor(palette_id/3) as int) as palette_id", "palette_id%3 as row_no", "idx", *RGB)


@query("g10_compose_palette", c.q(("palette",), c.composed("stk", 4, True), STACKED))
def g10(t: Tables) -> DataFrame:
    return lut.compose_palette(stacked(t), 4, "gradient")


@query("g10_compose_palette_black", c.q(("palette",), c.composed("stk", 5, False), STACKED))
def g10b(t: Tables) -> DataFrame:
    return lut.compose_palette(stacked(t), 5)


def dilate_ctes(rounds: int) -> tuple[tuple[str, str], ...]:
    ctes = [("s0!", "select p.*, a>0 as known, max(x) over w+1 as w, max(y) over w+1 as h from pixels p window w as (partition by image_id)")]
    for i in range(8 * rounds):
        dx, dy = FILL_SHIFTS[i % 8]
        rgb = ", ".join(f"case when not s.known and f.x is not null then f.{k} else s.{k} end as {k}" for k in "rgb")
        ctes.append((
            f"s{i + 1}!",
            f"select s.image_id, s.x, s.y, {rgb}, s.a, s.known or f.x is not null as known, s.w, s.h from s{i} s left join (select * from s{i} where known) f"
            f" on f.image_id=s.image_id and f.x=(s.x-({dx})+s.w)%s.w and f.y=(s.y-({dy})+s.h)%s.h",
        ))
    return tuple(ctes)


@query("g11_dilate", c.q(("pixels",), "select image_id, x, y, r, g, b, case when a=0 and known then 255 else a end as a from s16", *dilate_ctes(2)))
def g11(t: Tables) -> DataFrame:
    return neighborhood.dilate(t("pixels"), 2)


# ---- workflows --------------------------------------------------------------------------------------------------------

G12 = (
    OCT,
    ("cmq!", c.mapped("hist", "oct")),
    ("fullp!", c.padded("oct", "image_id", 32, "hist", None)),
    ("ord", c.lightness_order("(select image_id, idx, r, g, b from fullp)", "image_id")),
    ("uses", "select image_id, o.r, o.g, o.b, sum(h.n) as n from hist h join cmq q using (image_id, r, g, b) join oct o using (image_id, idx) group by all".replace("select image_id,", "select h.image_id,")),
    ("gi", "select p.image_id, p.x, p.y, case when p.a=0 then 0 else o.position end as idx, p.a from pixels p join cmq q using (image_id, r, g, b) join ord o using (image_id, idx)"),
    ("gp", "select image_id, position as idx, r, g, b from ord"),
)


@query(
    "g12_generate_palette_report",
    c.q(
        ("hist",),
        f"select image_id, idx, r, g, b, frequency, {c.r4('frequency/total*100.0')} as frequency_pct, row_number() over (partition by image_id order by frequency desc, idx)<=10 as most_used,"
        " row_number() over (partition by image_id order by frequency, idx)<=10 as least_used from (select p.*, coalesce(n,0)::bigint as frequency, sum(n) over (partition by image_id) as total"
        " from gp p left join uses using (image_id, r, g, b))",
        *G12,
    ),
)
def g12(t: Tables) -> DataFrame:
    out = flows.generate_palette(t("pixels"), 32, "fast_octree", quant_post=None)
    return out["report"].withColumn("frequency_pct", r4(F.col("frequency_pct"), "p"))


@query("g12_generate_palette_index", c.q(("hist",), "select *, cast(idx*255//31 as int) as display from gi", *G12))
def g12i(t: Tables) -> DataFrame:
    return flows.generate_palette(t("pixels"), 32, "fast_octree", quant_post=None)["index_image"]


EXTRA = "select image_id, 1 as extra_no, x, y, b as r, r as g, g as b from pixels"


@query(
    "g12_generate_palette_texture",
    c.q(
        ("hist",),
        c.composed("rws", 4, True),
        *G12,
        ("ix", "select g.image_id, g.idx, e.r, e.g, e.b from gi g join (" + EXTRA + ") e using (image_id, x, y)"),
        ("br", c.row_built("ix", "gp", "image_id")),
        ("rws", "select image_id as palette_id, 0 as row_no, idx, r, g, b from gp union all select image_id, 1, idx, r, g, b from br"),
    ),
)
def g12t(t: Tables) -> DataFrame:
    extras = t("pixels").selectExpr("image_id", "1 as extra_no", "x", "y", "b as r", "r as g", "g as b")
    return flows.generate_palette(t("pixels"), 32, "fast_octree", extras, None)["texture"]


TEXTURES = "select image_id, 1 as texture_no, x, y, g as r, r as g, b, case when (x+y)%5=0 then 0 else a end as a from pixels"


@query(
    "g12_generate_palette_textures",
    c.q(
        ("hist",),
        "select image_id, texture_no, x, y, idx, a, cast(idx*255//31 as int) as display from (select e.image_id, e.texture_no, e.x, e.y, e.a, case when e.a=0 then 0 else m.idx end as idx from (" + TEXTURES + ") e join ("
        + c.nearest("(select distinct image_id, r, g, b from (" + TEXTURES + "))", "gp", ("image_id", "r", "g", "b"), "c.image_id=p.image_id") + ") m using (image_id, r, g, b))",
        *G12,
    ),
)
def g12x(t: Tables) -> DataFrame:
    textures = t("pixels").selectExpr("image_id", "1 as texture_no", "x", "y", "g as r", "r as g", "b", "case when (x+y)%5=0 then 0 else a end as a")
    return flows.generate_palette(t("pixels"), 32, "fast_octree", quant_post=None, textures=textures)["texture_images"]


# the defaults: best-first boxes refined by Lloyd rounds under a quality floor, and the quantized image smoothed by a median
G12_DEFAULT = (
    *floor_ctes(32),
    ("indexed!", "select p.image_id, p.x, p.y, n.idx, p.a from pixels p join mapz n using (image_id, r, g, b)"),
    LINES,
    OFFS3,
    ("med", MEDIAN),
    ("fullp!", c.padded("(select image_id, idx, r, g, b from lmz)", "image_id", 32, "hist", None)),
    ("ord", c.lightness_order("(select image_id, idx, r, g, b from fullp)", "image_id")),
    ("dgi", "select i.image_id, i.x, i.y, case when i.a=0 then 0 else o.position end as idx, i.a from indexed i join med m using (image_id, x, y) join ord o on o.image_id=i.image_id and o.idx=least(31,greatest(0,m.idx))"),
    ("dgp", "select image_id, position as idx, r, g, b from ord"),
)


@query("g12_default_index", c.q(("hist",), "select *, cast(idx*255//31 as int) as display from dgi", *G12_DEFAULT))
def g12d(t: Tables) -> DataFrame:
    return flows.generate_palette(t("pixels"), 32)["index_image"]


@query("g12_default_texture", c.q(("hist",), c.composed("rws", 4, True), *G12_DEFAULT, ("rws", "select image_id as palette_id, 0 as row_no, idx, r, g, b from dgp")))
def g12dt(t: Tables) -> DataFrame:
    return flows.generate_palette(t("pixels"), 32)["texture"]


G13 = (
    OCT,
    ("cmq!", c.mapped("hist", "oct")),
    ("ghist", "select distinct 0 as scope, r, g, b, 1 as n, 1 as coverage from oct"),
    *c.reduced(48, False),
    ("cand", "select scope, rank as seq, r, g, b from sel join med using (scope, cluster) where not kept"),
    ("src", "select 0 as scope, r, g, b, sum(n) as n from hist group by all"),
    ("pd", c.padded("pal", "scope", 48, "src", "cand")),
    ("ord", c.lightness_order("(select scope, idx, r, g, b from pd)", "scope")),
    ("plc", "select r as rep_r, g as rep_g, b as rep_b, max(position) as to_idx from ord group by all"),
)


@query("g13_shared_palette", c.q(("hist",), "select position as idx, r, g, b from ord", *G13))
def g13(t: Tables) -> DataFrame:
    return flows.generate_palettes(t("pixels"), 48, True, "fast_octree", 32, None)["palette"].drop("scope")


@query(
    "g13_shared_index_image",
    c.q(("hist",), "select p.image_id, p.x, p.y, l.to_idx as idx from pixels p join cmq q using (image_id, r, g, b) join oct o using (image_id, idx) join cmap m on m.r=o.r and m.g=o.g and m.b=o.b join plc l using (rep_r, rep_g, rep_b)", *G13),
)
def g13i(t: Tables) -> DataFrame:
    return flows.generate_palettes(t("pixels"), 48, True, "fast_octree", 32, None)["index_image"]


# quantized to 32 colours, no more than the palette holds: every colour is its own cluster
G13_EACH = (
    OCT,
    ("cmq!", c.mapped("hist", "oct")),
    ("own!", "select image_id, row_number() over (partition by image_id order by r, g, b)-1 as idx, r, g, b from (select distinct image_id, r, g, b from oct)"),
    ("pd!", c.padded("own", "image_id", 64, "hist", None)),
    ("ord", c.lightness_order("(select image_id, idx, r, g, b from pd)", "image_id")),
    ("plc", "select image_id, r, g, b, max(position) as to_idx from ord group by all"),
)


@query(
    "g13_palette_per_image",
    c.q(("hist",), "select p.image_id, p.x, p.y, l.to_idx as idx from pixels p join cmq q using (image_id, r, g, b) join oct o using (image_id, idx) join plc l on l.image_id=o.image_id and l.r=o.r and l.g=o.g and l.b=o.b", *G13_EACH),
)
def g13m(t: Tables) -> DataFrame:
    return flows.generate_palettes(t("pixels"), 64, False, "fast_octree", 32, None)["index_image"]


G14 = (
    ("ghist", "select 0 as scope, r, g, b, greatest(sum(n),1)::bigint as n, sum(cov)::bigint as coverage from (select r, g, b, count(*) as n, count(distinct (palette_id, image_id)) as cov from"
     " (select i.palette_id, i.image_id, p.r, p.g, p.b from indexed i join palette p using (palette_id, idx)) group by all union all select distinct r, g, b, 0, 0 from palette) group by r, g, b"),
    *c.reduced(48, True),
    ("cand", "select scope, rank as seq, r, g, b from sel join med using (scope, cluster) where not kept"),
    ("pd", c.padded("pal", "scope", 48, None, "cand")),
    ("ord", c.lightness_order("(select scope, idx, r, g, b from pd)", "scope")),
    ("plc", "select r as rep_r, g as rep_g, b as rep_b, max(position) as to_idx from ord group by all"),
)


def merged(t: Tables) -> dict[str, DataFrame]:
    index = t("indexed").select(F.col("palette_id").alias("group_id"), "image_id", "x", "y", "idx")
    return flows.merge_groups(index, t("palette").withColumnRenamed("palette_id", "group_id"), 48)


@query("g14_merge_groups_palette", c.q(("indexed",), "select position as idx, r, g, b from ord", *G14))
def g14(t: Tables) -> DataFrame:
    return merged(t)["palette"].drop("scope")


@query(
    "g14_merge_groups_index",
    c.q(
        ("indexed",),
        "select i.palette_id as group_id, i.image_id, i.x, i.y, l.to_idx as unified_idx from (select *, least(idx, (select max(idx) from palette p where p.palette_id=indexed.palette_id)) as gi from indexed) i"
        " join palette p on p.palette_id=i.palette_id and p.idx=i.gi join cmap m on m.r=p.r and m.g=p.g and m.b=p.b join plc l using (rep_r, rep_g, rep_b)",
        *G14,
    ),
)
def g14i(t: Tables) -> DataFrame:
    return merged(t)["index_image"]


G15 = (
    *EXTRACTED,
    ("old", "select * replace (dense_rank() over (partition by palette_id order by row_no)-1 as row_no) from ext"),
    ("exn", "select palette_id, max(row_no)+1 as rws, max(idx)+1 as wd from old group by palette_id"),
    ("prs", "select cast(image_id as int) as palette_id, k as pair_no, image_id as grey_id, (image_id+k)%(select count(distinct image_id) from pixels) as color_id from (select distinct image_id from pixels), (select unnest([1,2]) as k)"),
    ("sz", "select image_id, max(x)+1 as w, max(y)+1 as h from pixels group by image_id"),
    ("ix", "select palette_id*10+pair_no as row_key, least(g.r, wd-1) as idx, c.r, c.g, c.b from prs join exn using (palette_id) join pixels g on g.image_id=grey_id join sz gs on gs.image_id=grey_id join sz cs on cs.image_id=color_id"
     " join pixels c on c.image_id=color_id and c.x=floor((g.x+0.5)*cs.w/gs.w) and c.y=floor((g.y+0.5)*cs.h/gs.h)"),
    ("bs", "select palette_id*10+pair_no as row_key, idx, r, g, b from prs join old using (palette_id) where row_no=0"),
    ("br", c.row_built("ix", "bs", "row_key")),
    ("rws2", "select palette_id, row_no, idx, r, g, b from old union all select row_key//10, rws+row_key%10-1, idx, r, g, b from br join exn on exn.palette_id=row_key//10"),
)


@query("g15_add_palette_rows", c.q(("pixels",), c.composed("rws2", 4, False), *G15))
def g15(t: Tables) -> DataFrame:
    px = t("pixels")
    count = px.agg(F.count_distinct("image_id").alias("n")).scalar()
    each = px.select("image_id").distinct().select("image_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("pair_no"))
    pairs = each.select(F.col("image_id").cast("int").alias("palette_id"), "pair_no", F.col("image_id").alias("grey_id"), ((F.col("image_id") + F.col("pair_no")) % count).alias("color_id"))
    return flows.add_palette_rows(texture(t), pairs, px)


@query(
    "g16_convert_to_palette",
    c.q(("px",), "select image_id, x, y, idx, p.r, p.g, p.b, cast(idx*255//greatest(max(idx) over (partition by image_id),1) as int) as display from (select px.image_id, px.x, px.y, px.palette_id, n.idx from px join near n using (palette_id, r, g, b)) join palette p using (palette_id, idx)", PX_NEAR),
)
def g16(t: Tables) -> DataFrame:
    return mapping.convert_to_palette(t("px"), t("palette"))


@query(
    "g17_map_coarse",
    c.q(("px",), "select px.image_id, px.x, px.y, cm.coarse_idx from px join near using (palette_id, r, g, b) join cm using (palette_id, idx)", PX_NEAR, *coarse_sql(18, 6)),
)
def g17(t: Tables) -> DataFrame:
    return ordering.map_coarse(mapping.map_to_palette(t("px"), t("palette")), t("palette")).select("image_id", "x", "y", "coarse_idx")


@query(
    "g18_quantize_greys",
    c.q(("pixels",), "select image_id, x, y, cast(floor(quantile_cont(x*7+y, 0.5) over (partition by image_id, r, g, b)) as int) as grey from pixels"),
)
def g18(t: Tables) -> DataFrame:
    return histogram.quantize_greys(t("pixels").withColumn("grey", F.expr("x*7+y")))


SHAPES = f"'Mods/Data/Meshes/S/t'||cast({SHAPE} as varchar(9))||'.nif'"
SLOT = (
    f"case when {SHAPE}%3=0 then 'textures/S/other_d.dds' when s_suppkey%4=0 then '' when s_suppkey%2=0 then 'Materials/S/t'||cast({SHAPE} as varchar(9))||'.bgsm'"
    f" else 'textures/S/T'||cast({SHAPE} as varchar(9))||'_d.dds' end"
)


@query(
    "g19_remove_uv_padding",
    c.q(
        ("pixels", "triangles"),
        "select p.image_id, p.x, p.y, p.r, p.g, p.b, case when m.x is null then 0 else p.a end as a from pixels p left join mask m on m.image_id=p.image_id and m.x=p.x and m.y=p.y where p.image_id in (select image_id from us)",
        ("sh", f"select {SHAPE} as image_id, s_suppkey as tri_id, {SLOT} as slot from supplier"),
        ("mt", "select *, slot<>'' and image_id%3<>0 as ok from sh where image_id in (select image_id from pixels)"),
        ("us", "select * from (select *, bool_or(ok) over (partition by image_id) as anym from mt) where ok or not anym"),
        ("mask", mask_sql("image_id", "(select us.image_id, t.*, 32 as w, 32 as h from us join triangles t using (tri_id))")),
    ),
)
def g19(t: Tables) -> DataFrame:
    images = t("pixels").select("image_id").distinct()
    tex = images.select("image_id", F.format_string("Mods/Data/Textures/S/t%d_d.dds", "image_id").alias("path"), F.lit(32).alias("w"), F.lit(32).alias("h"))
    meshes = t.raw("supplier").select(F.expr(SHAPES).alias("path")).distinct()
    slots = t.raw("supplier").select("s_suppkey", F.expr(SHAPES).alias("mesh_path"), F.expr(SLOT).alias("slot_path"))
    shapes = t("triangles").join(slots, F.col("tri_id") == F.col("s_suppkey")).drop("s_suppkey")
    mats = images.select(F.format_string("Materials/S/t%d.bgsm", "image_id").alias("path"), F.format_string("textures/S/t%d_d.dds", "image_id").alias("DiffuseTexture"))
    return uv.remove_uv_padding(t("pixels"), tex, meshes, shapes, mats, "Mods/Data")
