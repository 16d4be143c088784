"""Building blocks of the SQL checks (DuckDB dialect), written apart from the DataFrame code."""

from __future__ import annotations

from texelmill.plans.views import with_views


def q(views: tuple[str, ...], body: str, *ctes: tuple[str, str]) -> str:
    """A whole check: views, further named steps (``name!`` is materialized), final select."""
    steps = [*with_views(*views), *ctes]
    head = ",\n".join(f"{name.rstrip('!')} as {'materialized ' if name.endswith('!') else ''}({text})" for name, text in steps)
    return f"with {head}\n{body}" if steps else body


def r4(expr: str, places: int = 4) -> str:
    """Rounded double. The nudge sends exact halves one way whatever the last bit, so both engines agree on them."""
    scale = f"{10**places}.0::double"
    return f"(floor(({expr})*{scale}+0.5000001::double)/{scale})"


def lab(src: str, r: str = "r", g: str = "g", b: str = "b", prefix: str = "lab_") -> str:
    """``src`` plus its CIELAB columns, as a parenthesised sub-select."""

    def lin(c: str) -> str:
        return f"case when {c}/255.0::double > 0.04045 then pow(({c}/255.0::double+0.055)/1.055, 2.4) else {c}/255.0::double/12.92 end"

    def f(a: float, bb: float, c: float, white: float) -> str:
        t = f"((_lr*{a}::double+_lg*{bb}::double+_lb*{c}::double)/{white}::double)"
        return f"case when {t} > 0.008856 then cbrt({t}) else 7.787*{t}+16.0::double/116.0 end"

    return (
        f"(select * exclude (_lr,_lg,_lb,_fx,_fy,_fz), 116.0*_fy-16.0 as {prefix}l, 500.0*(_fx-_fy) as {prefix}a, 200.0*(_fy-_fz) as {prefix}b from ("
        f"select *, {f(0.412453, 0.357580, 0.180423, 0.95047)} as _fx, {f(0.212671, 0.715160, 0.072169, 1.0)} as _fy,"
        f" {f(0.019334, 0.119193, 0.950227, 1.08883)} as _fz from ("
        f"select *, {lin(r)} as _lr, {lin(g)} as _lg, {lin(b)} as _lb from {src})))"
    )


def hue(a: str, b: str) -> str:
    return f"(case when degrees(atan2({b},{a})) < 0 then degrees(atan2({b},{a}))+360.0 else degrees(atan2({b},{a})) end)"


def chroma(a: str, b: str) -> str:
    return f"sqrt({a}*{a}+{b}*{b})"


def de00(src: str, p: tuple[str, str, str], s: tuple[str, str, str], out: str) -> str:
    """``src`` plus the CIEDE2000 difference of two Lab triples, as a parenthesised sub-select."""
    (l1, a1, b1), (l2, a2, b2) = p, s
    k = "6103515625.0::double"
    cb = f"(({chroma(a1, b1)}+{chroma(a2, b2)})/2)"
    s1 = f"select *, 0.5*(1-sqrt(pow({cb},7)/(pow({cb},7)+{k}))) as _g from {src}"
    s2 = f"select *, {a1}*(1+_g) as _p1, {a2}*(1+_g) as _p2 from ({s1})"
    s3 = f"select *, {chroma('_p1', b1)} as _c1, {chroma('_p2', b2)} as _c2, {hue('_p1', b1)} as _h1, {hue('_p2', b2)} as _h2 from ({s2})"
    s4 = (
        f"select *, case when _c1*_c2=0 then 0 when abs(_h2-_h1)<=180 then _h2-_h1 when _h2-_h1>180 then _h2-_h1-360 else _h2-_h1+360 end as _dh,"
        f" case when _c1*_c2=0 then _h1+_h2 when abs(_h2-_h1)<=180 then (_h1+_h2)/2 when _h1+_h2<360 then (_h1+_h2+360)/2 else (_h1+_h2-360)/2 end as _hm,"
        f" (_c1+_c2)/2 as _cm, pow(({l1}+{l2})/2-50,2) as _lm from ({s3})"
    )
    s5 = (
        "select *, 1-0.17*cos(radians(_hm-30))+0.24*cos(radians(2*_hm))+0.32*cos(radians(3*_hm+6))-0.20*cos(radians(4*_hm-63)) as _t,"
        f" -2*sqrt(pow(_cm,7)/(pow(_cm,7)+{k}))*sin(radians(60*exp(-pow((_hm-275)/25,2)))) as _rt from ({s4})"
    )
    s6 = (
        f"select *, ({l2}-{l1})/(1+0.015*_lm/sqrt(20+_lm)) as _tl, (_c2-_c1)/(1+0.045*_cm) as _tc,"
        f" 2*sqrt(_c1*_c2)*sin(radians(_dh)/2)/(1+0.015*_cm*_t) as _th from ({s5})"
    )
    drop = "_g,_p1,_p2,_c1,_c2,_h1,_h2,_dh,_hm,_cm,_lm,_t,_rt,_tl,_tc,_th"
    return f"(select * exclude ({drop}), sqrt(greatest(_tl*_tl+_tc*_tc+_th*_th+_rt*_tc*_th, 0)) as {out} from ({s6}))"


def hsv(src: str) -> str:
    """``src`` plus h, s, v."""
    hi, lo = "greatest(r,g,b)", "least(r,g,b)"
    d = f"cast({hi}-{lo} as double)"
    sextant = (
        f"case when {hi}={lo} then 0.0::double when b={hi} then (r-g)/{d}+4.0 when g={hi} then (b-r)/{d}+2.0"
        f" else case when (g-b)/{d} < 0 then (g-b)/{d}+6.0 else (g-b)/{d} end end"
    )
    return (
        f"(select *, ({sextant})/6.0::double as h, case when {hi}>0 then {d}/{hi} else 0.0::double end as s, {hi}/255.0::double as v from {src})"
    )


def rgb_key(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"({r}*65536+{g}*256+{b})"


def stem(p: str) -> str:
    return rf"regexp_replace(split_part({p},'/',-1), '^([.]*[^.].*)[.][^.]*$', '\1')"


def dirname(p: str) -> str:
    return f"regexp_replace({p}, '/?[^/]*$', '')"


def parent(p: str) -> str:
    return f"split_part({dirname(p)},'/',-1)"


def norm_key(p: str, with_palette: bool = False) -> str:
    words = "greyscale|grayscale|grey|gray|bw|mask" + ("|palette" if with_palette else "")
    return rf"regexp_replace(regexp_replace(lower({stem(p)}), '(?:[\s_\-]?(?:{words}))+$', ''), '[^a-z0-9_]+', '', 'g')"


def insert_folder(p: str, folder: str) -> str:
    s = f"replace({p}, chr(92), '/')"
    d = dirname(s)
    base = f"split_part({s},'/',-1)"
    return (
        f"case when {p} is null or {p}='' then {p} when not contains({s},'/') then concat({folder},'/',{s})"
        f" when ends_with({d}, concat('/',{folder})) then {s} when {d}='' then concat({folder},{s})"
        f" else concat({d},'/',{folder},'/',{base}) end"
    )


# ---- clustering steps -----------------------------------------------------------------------------------------------


def features(hist: str) -> str:
    """scope, r, g, b, n, coverage + Lab, chroma, hue_bin, weight."""
    return (
        f"select *, pow(n,0.85)*(1+0.6*(chroma/greatest(max(chroma) over (partition by scope),1e-6)))+0.25*coverage as weight from ("
        f"select *, {chroma('lab_a', 'lab_b')} as chroma, cast(cast(floor(round({hue('lab_a', 'lab_b')},6)/15.0) as int)%24 as int) as hue_bin from {lab(hist)})"
    )


def cells(src: str, target: int) -> tuple[tuple[str, str], ...]:
    """CTEs that end in ``members``: src plus threshold and cluster."""

    def c(col: str) -> str:
        return f"case when t=0 then -1 else cast(floor(round({col},6)/greatest(t,1)) as bigint) end"

    keyed = f"select *, {rgb_key()} as _rgb from {src}"
    edges = (
        f"select s.*, t, case when t=0 then _rgb else -1 end as c0, {c('lab_l')} as c1, {c('lab_a')} as c2, {c('lab_b')} as c3"
        " from keyed s, (select unnest(range(21)) as t)"
    )
    pick = (
        "select scope, coalesce(min(case when k <= " + str(target) + " then t end), 20) as t from"
        " (select scope, t, count(distinct (c0,c1,c2,c3)) as k from edges group by scope, t) group by scope"
    )
    members = (
        "select e.* exclude (t,c0,c1,c2,c3,_rgb), cast(e.t as int) as threshold,"
        " cast(min(_rgb) over (partition by e.scope, c0,c1,c2,c3) as int) as cluster from edges e join edge p on e.scope=p.scope and e.t=p.t"
    )
    return ("keyed", keyed), ("edges", edges), ("edge", pick), ("members", members)


def medoid(members: str, weighted: bool) -> str:
    w = "y.weight" if weighted else "1.0"
    pairs = (
        f"(select x.scope, x.cluster, {rgb_key('x.r', 'x.g', 'x.b')} as _rgb, x.lab_l as xl, x.lab_a as xa, x.lab_b as xb,"
        f" y.lab_l as yl, y.lab_a as ya, y.lab_b as yb, {w} as w, count(*) over (partition by x.scope, x.cluster) as _k"
        f" from {members} x join {members} y on x.scope=y.scope and x.cluster=y.cluster)"
    )
    costs = (
        f"(select scope, cluster, _rgb, round(sum(case when _k=1 then 0 else de*w end),6) as cost from"
        f" {de00(pairs, ('xl', 'xa', 'xb'), ('yl', 'ya', 'yb'), 'de')} group by scope, cluster, _rgb)"
    )
    return (
        f"select scope, cluster, cast(_rgb//65536 as int) as r, cast(_rgb//256%256 as int) as g, cast(_rgb%256 as int) as b, cost from"
        f" (select *, row_number() over (partition by scope, cluster order by cost, _rgb) as rn from {costs}) where rn=1"
    )


def stats(members: str) -> str:
    return (
        "select scope, cluster, sum(weight) as score, quantile_cont(round(chroma,4),0.5) as median_chroma,"
        " cast(sum(coverage) as bigint) as coverage, cast(sum(n) as bigint) as freq, count(*) as size"
        f" from {members} group by scope, cluster"
    )


def hue_balanced(clusters: str, target: int) -> str:
    cap = max(1, round(target * 0.15))
    order = "score desc, median_chroma desc, coverage desc, freq desc, cluster"
    a = (
        f"select *, row_number() over (partition by scope order by {order}) as rank, row_number() over (partition by scope, hue_bin order by {order}) as ib,"
        f" max(median_chroma) over (partition by scope, hue_bin) >= 20 as vivid, count(*) over (partition by scope) as total from {clusters}"
    )
    b = f"select *, vivid and ib=1 and total>{target} as res, total<={target} or (vivid and ib=1) or ib<={cap} as allowed from ({a})"
    c = f"select *, row_number() over (partition by scope order by cast(allowed as int) desc, cast(res as int) desc, rank) as pick0 from ({b})"
    return (
        f"select * exclude (ib,vivid,total,res,allowed,pick0), allowed and pick0<={target} as kept,"
        f" case when allowed and pick0<={target} then pick0 end as pick from ({c})"
    )


def largest(clusters: str, target: int) -> str:
    return (
        f"select *, rank<={target} as kept, case when rank<={target} then rank end as pick from"
        f" (select *, row_number() over (partition by scope order by size desc, cluster) as rank from {clusters})"
    )


def assign(colors: str, reps: str, same_bin: bool) -> str:
    """Closest representative per colour; both sides carry Lab and hue_bin."""
    other = "cast(c.hue_bin<>p.hue_bin as int)" if same_bin else "0"
    pairs = (
        f"(select c.scope, c.r, c.g, c.b, c.lab_l as cl, c.lab_a as ca, c.lab_b as cb, p.lab_l as pl, p.lab_a as pa, p.lab_b as pb,"
        f" p.idx as rep_idx, p.r as rep_r, p.g as rep_g, p.b as rep_b, {other} as other from {colors} c join {reps} p on c.scope=p.scope)"
    )
    d = de00(pairs, ("pl", "pa", "pb"), ("cl", "ca", "cb"), "de")
    return (
        "select scope, r, g, b, rep_r, rep_g, rep_b, rep_idx, delta_e from (select *, round(de,9) as delta_e, row_number() over"
        f" (partition by scope, r, g, b order by other, round(de,9), rep_idx) as rn from {d}) where rn=1"
    )


def reduced(target: int, weighted: bool) -> tuple[tuple[str, str], ...]:
    """CTEs from ``ghist`` to ``pal`` (scope, idx, r, g, b) and ``cmap``."""
    bin_of = f"cast(cast(floor(round({hue('lab_a', 'lab_b')},6)/15.0) as int)%24 as int) as hue_bin"
    ctes = [("feat", features("ghist")), *cells("feat", target), ("med", medoid("members", weighted)), ("stat", stats("members"))]
    if weighted:
        labbed = f"select scope, cluster, {bin_of} from {lab('med')}"
        ctes += [("cl", f"select s.* replace (round(score,6) as score), hue_bin from stat s join ({labbed}) using (scope, cluster)"), ("sel", hue_balanced("cl", target))]
    else:
        ctes += [("sel", largest("stat", target))]
    ctes += [
        ("pal", "select s.scope, cast(pick-1 as int) as idx, r, g, b from sel s join med using (scope, cluster) where kept"),
        ("reps", f"select *, {bin_of} from {lab('pal')}"),
        ("cmap", assign("members", "reps", weighted)),
    ]
    return tuple(ctes)


def nearest(colors: str, palette: str, keys: tuple[str, ...], join: str) -> str:
    """``keys`` and the idx of the nearest RGB entry of each colour; ties to the lowest index."""
    k = ", ".join(f"c.{n}" for n in keys)
    d = "(c.r-p.r)*(c.r-p.r)+(c.g-p.g)*(c.g-p.g)+(c.b-p.b)*(c.b-p.b)"
    return (
        f"select {', '.join(keys)}, idx from (select {k}, p.idx, row_number() over (partition by {k} order by {d}, p.idx) as rn"
        f" from {colors} c join {palette} p on {join}) where rn=1"
    )


def lightness_order(palette: str, by: str) -> str:
    """Palette plus ``position``."""
    h = f"case when round({chroma('lab_a', 'lab_b')},6)>0.1 then round({hue('lab_a', 'lab_b')},6) else 0 end"
    return f"select * exclude (lab_l,lab_a,lab_b), cast(row_number() over (partition by {by} order by round(lab_l,6), {h}, idx)-1 as int) as position from {lab(palette)}"


MEAN = "cast(floor(round(sum({0}*n)/sum(n),6)+0.5) as int) as {0}"


def means(src: str) -> str:
    """Weighted mean colour per (image_id, box) with dense idx."""
    m = ", ".join(MEAN.format(k) for k in "rgb")
    return f"select *, cast(row_number() over (partition by image_id order by r, g, b, box)-1 as int) as idx from (select image_id, box, {m} from {src} group by image_id, box)"


def fullest_buckets(hist: str, k: int, shift: int = 4) -> str:
    m = ", ".join(MEAN.format(c) for c in "rgb")
    box = f"(r//{2**shift})*65536+(g//{2**shift})*256+b//{2**shift}"
    top = f"select *, row_number() over (partition by image_id order by n desc, box) as rk from (select image_id, box, {m}, sum(n) as n from (select *, {box} as box from {hist}) group by image_id, box)"
    return f"select image_id, cast(row_number() over (partition by image_id order by r, g, b, box)-1 as int) as idx, r, g, b from ({top}) where rk<={k}"


def octree(hist: str, k: int) -> str:
    """Levels merged from the leaves up until the next one would have k nodes or fewer; there the least populated siblings first."""
    cut = lambda d: "+".join(f"(({c}>>({d}))<<({d}))*{w}" for c, w in (("r", 65536), ("g", 256), ("b", 1)))
    size = f"select image_id, d, count(*) as nodes from (select distinct image_id, d, {cut('d')} as node from {hist}, (select unnest(range(0, 9))::int as d)) group by image_id, d"
    fit = f"select image_id, min(d) filter (nodes<={k}) as d from ({size}) group by image_id"
    over = f"select f.image_id, f.d, coalesce(s.nodes-{k}, 0) as over from ({fit}) f left join ({size}) s on s.image_id=f.image_id and s.d=f.d-1"
    leaf = f"select h.*, over, {cut('d')} as parent, {cut('greatest(d-1, 0)')} as child from {hist} h join ({over}) using (image_id)"
    kin = f"select image_id, parent, any_value(over) as over, sum(n) as n, count(distinct child)-1 as gone from ({leaf}) group by image_id, parent"
    done = f"select image_id, parent, coalesce(sum(gone) over (partition by image_id order by n, parent rows between unbounded preceding and 1 preceding), 0)<over as merged from ({kin})"
    boxes = f"(select image_id, r, g, b, n, case when merged then parent else child end as box from ({leaf}) join ({done}) using (image_id, parent))"
    return f"select image_id, idx, r, g, b from ({means(boxes)})"


def mapped(hist: str, palette: str) -> str:
    """image_id, r, g, b -> idx."""
    return nearest(hist, palette, ("image_id", "r", "g", "b"), "c.image_id=p.image_id")


def row_built(indexed: str, base: str, by: str) -> str:
    """One palette row per ``by``: dominant colours, base kept when missing, equal or within 2 of it."""
    dom = (
        f"select {by}, idx, r as dr, g as dg, b as db, pixels from (select *, row_number() over (partition by {by}, idx order by n desc, r, g, b) as rn,"
        f" sum(n) over (partition by {by}, idx) as pixels from (select {by}, idx, r, g, b, count(*) as n from {indexed} group by all)) where rn=1"
    )
    j = f"(select p.*, dr, dg, db, pixels, coalesce(dr,r) as er, coalesce(dg,g) as eg, coalesce(db,b) as eb from {base} p left join ({dom}) using ({by}, idx))"
    d = de00(lab(lab(j, prefix="p_"), "er", "eg", "eb", prefix="q_"), ("p_l", "p_a", "p_b"), ("q_l", "q_a", "q_b"), "de")
    stay = "((r=er and g=eg and b=eb) or de<=2.0)"
    cols = ", ".join(f"case when {stay} then {k} else e{k} end as {k}" for k in "rgb")
    return f"select {by}, idx, {cols}, not {stay} as deviates, case when dr is not null then de end as delta_e, coalesce(pixels,0)::bigint as pixels from {d}"


def composed(rows: str, height: int, gradient: bool) -> str:
    pad = "case when w>1 then x*255//(w-1) else 0 end" if gradient else "0"
    return (
        f"select palette_id, cast(row_no*{height}+k as int) as y, idx as x, r, g, b from {rows}, (select unnest(range({height})) as k) union all"
        f" select palette_id, y, x, {pad}::int, {pad}::int, {pad}::int from (select palette_id, w, y, unnest(range(w))::int as x from (select palette_id, w,"
        f" unnest(range(n*{height}, full_h::int))::int as y from (select *, power(2, ceil(log2(n*{height}))) as full_h from (select palette_id, max(row_no)+1 as n, max(idx)+1 as w from {rows} group by palette_id))))"
    )


def padded(pal: str, by: str, size: int, hist: str | None, candidates: str | None) -> str:
    mix = ", ".join(f"(a.{k}*(4-k)+b.{k}*k)//4 as {k}" for k in "rgb")
    offers = [
        f"select a.{by}, 1 as st, (a.idx*5+s)*4+k as seq, {mix} from {pal} a, (select unnest([1,2,3,4]) as s), (select unnest([1,2,3]) as k) join {pal} b on b.{by}=a.{by} and b.idx=a.idx+s",
        f"select {by}, 3, r*65536+g*256+b, r, g, b from (select distinct {by} from {pal}), (select unnest(range(0,256,42)) as r), (select unnest(range(0,256,42)) as g), (select unnest(range(0,256,42)) as b)",
    ]
    if candidates:
        offers.append(f"select {by}, 0, seq, r, g, b from {candidates}")
    if hist:
        offers.append(f"select {by}, 2, seq, r, g, b from (select *, row_number() over (partition by {by} order by n desc, r, g, b) as seq from {hist}) where {by} in (select {by} from {pal})")
    fresh = f"select {by}, r, g, b, min((st, seq)) as o from ({' union all '.join(offers)}) f where ({by}, r, g, b) not in (select ({by}, r, g, b) from {pal}) group by {by}, r, g, b"
    placed = f"select f.*, row_number() over (partition by {by} order by o, r, g, b) as p, (select count(*) from {pal} x where x.{by}=f.{by}) as k from ({fresh}) f"
    return (
        f"select {by}, idx, r, g, b, null::int as strategy from {pal} where idx<{size} union all"
        f" select {by}, cast(k+p-1 as int), r::int, g::int, b::int, o[1]::int from ({placed}) where p+k<={size}"
    )
