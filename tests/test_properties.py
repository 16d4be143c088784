"""Properties, brute-force twins and golden values of what SQL does not express."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from texelmill.functions import color, paths
from texelmill.operators import cluster, lut, mapping, materials, neighborhood, ordering, pathops, plugins, quantize
from texelmill.plans.views import Tables
from texelmill.sources import files as file_sinks
from texelmill.sources import assets, tables
from texelmill.sources import materials as material_files
from texelmill.sources import plugins as plugin_files

RGB = ["r", "g", "b"]
FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# published CIEDE2000 test pairs
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0000),
    ((50.0, 2.5, 0.0), (50.0, 0.0, -2.5), 4.3065),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
]


def test_delta_e2000_published_pairs(spark):
    df = spark.createDataFrame([(*a, *b, d) for a, b, d in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    rows = color.with_delta_e2000(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "got")
    inline = rows.withColumn("expr", color.delta_e2000(*[F.col(c) for c in ("l1", "a1", "b1", "l2", "a2", "b2")]))
    for r in inline.collect():
        assert abs(r.got - r.want) < 5e-5 and abs(r.expr - r.want) < 5e-5
    a, b = np.array([p[0] for p in PAIRS]), np.array([p[1] for p in PAIRS])
    assert np.allclose(cluster._de2000(a, b), [p[2] for p in PAIRS], atol=5e-5)


def test_lab_and_hsv_of_primaries(spark):
    df = spark.createDataFrame([(255, 0, 0), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    red, white, black = color.with_hsv(color.with_lab(df)).orderBy(F.desc("s"), F.desc("v")).collect()
    assert [round(red[c], 3) for c in ("lab_l", "lab_a", "lab_b", "h", "s", "v")] == [53.241, 80.092, 67.203, 0.0, 1.0, 1.0]
    assert round(white.lab_l, 3) == 100 and white.s == 0 and black.lab_l == 0 and black.v == 0


def test_golden_path_and_token_examples(spark):
    df = spark.createDataFrame([("Weapons/X/barrel1_d.dds",), ("barrel1_d.dds",), ("a/asd/b.dds",), ("",), (None,)], "p string")
    got = [r[0] for r in df.select(paths.insert_folder(F.col("p"), F.lit("asd"))).collect()]
    assert got == ["Weapons/X/asd/barrel1_d.dds", "asd/barrel1_d.dds", "a/asd/b.dds", "", None]
    idx = spark.createDataFrame([(1, v) for v in [0, 1, 2, 3, 5, 7, 8, 9, 10]], "image_id long, idx int")
    from texelmill.operators.histogram import index_ranges

    row = index_ranges(idx).first()
    assert row.present_ranges == "0-3, 5, 7-10" and row.missing_ranges == "4, 6, 11-255"
    assert paths.glob_regex("a[!b]?*.x") == "(?s)^a[^b]..*\\.x$"


# ---- palettes ---------------------------------------------------------------------------------------------------------


def path_cost(rows) -> float:
    lab = np.array([[r.lab_l, r.lab_a, r.lab_b] for r in sorted(rows, key=lambda r: r.position)])
    return float(np.sqrt(((lab[1:] - lab[:-1]) ** 2).sum(axis=1)).sum())


def test_polish_keeps_ends_and_never_lengthens(spark):
    start = ordering.hue_sort(Tables(spark, FOLDER)("palette"), direction="cheaper")
    done = ordering.polish_order(start)
    a, b = (color.with_lab(x).collect() for x in (start, done))
    for p in {r.palette_id for r in a}:
        one, two = [r for r in a if r.palette_id == p], [r for r in b if r.palette_id == p]
        assert sorted(r.idx for r in one) == sorted(r.idx for r in two)
        assert sorted(r.position for r in two) == list(range(len(two)))
        assert path_cost(two) <= path_cost(one) + 1e-6
        ends = lambda rows: [min(rows, key=lambda r: r.position).idx, max(rows, key=lambda r: r.position).idx]
        assert ends(one) == ends(two)


def test_two_opt_equals_slow_search():
    rng = np.random.default_rng(3)
    lab = rng.random((12, 3)) * 100

    def slow(lab, passes):
        n, path = len(lab), list(range(len(lab)))
        d = lambda i, j: float(np.linalg.norm(lab[i] - lab[j]))
        for _ in range(passes):
            hit = False
            for i in range(1, n - 2):
                for j in range(i + 1, n - 1):
                    if d(path[i - 1], path[j]) + d(path[i], path[j + 1]) - d(path[i - 1], path[i]) - d(path[j], path[j + 1]) < -1e-6:
                        path[i : j + 1], hit = path[i : j + 1][::-1], True
                        break
                if hit:
                    break
            if not hit:
                break
        return path

    assert ordering._two_opt(lab, 60).tolist() == slow(lab, 60)


def test_adjacency_sort_is_a_permutation_from_the_darkest(spark):
    t = Tables(spark, FOLDER)
    indexed = mapping.map_to_palette(t("px"), t("palette"))
    links = neighborhood.cooccurrence(indexed.withColumn("image_id", F.col("palette_id").cast("long")), by=("image_id",)).withColumnRenamed("image_id", "palette_id")
    links = links.withColumn("palette_id", F.col("palette_id").cast("int"))
    rows = color.with_lab(ordering.adjacency_sort(t("palette"), links)).collect()
    for p in {r.palette_id for r in rows}:
        one = sorted((r for r in rows if r.palette_id == p), key=lambda r: r.position)
        assert [r.position for r in one] == list(range(len(one)))
        assert one[0].lab_l == min(r.lab_l for r in one)


def weighted_error(hist, out) -> dict:
    pal = out["palette"].withColumnsRenamed({c: f"p{c}" for c in RGB})
    d = sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in RGB), F.lit(0))
    j = hist.join(out["color_map"], ["image_id", *RGB]).join(pal, ["image_id", "idx"])
    return {r.image_id: r.e for r in j.groupBy("image_id").agg(F.sum(d * F.col("n")).alias("e")).collect()}


@pytest.mark.parametrize("method", quantize.METHODS)
def test_quantizers_cover_every_color_with_few_entries(spark, method):
    hist = Tables(spark, FOLDER)("hist")
    out = quantize.quantize_histogram(hist, method, 16)
    sizes = out["palette"].groupBy("image_id").count().collect()
    assert sizes and all(r["count"] <= 16 for r in sizes)
    assert hist.join(out["color_map"], ["image_id", *RGB], "left_anti").count() == 0
    assert out["color_map"].groupBy("image_id", *RGB).count().where("count > 1").count() == 0


def test_refined_quantizer_is_no_worse(spark):
    hist = Tables(spark, FOLDER)("hist")
    plain, fine = (weighted_error(hist, quantize.quantize_histogram(hist, m, 16)) for m in ("median_cut", "libimagequant"))
    assert plain.keys() == fine.keys() and all(fine[k] <= plain[k] * 1.02 for k in plain)


def test_leader_clusters_follow_row_order(spark):
    rows = [(0, 10, 10, 10, 5), (0, 11, 10, 10, 1), (0, 200, 0, 0, 2), (0, 201, 3, 0, 9), (0, 0, 0, 255, 1)]
    hist = spark.createDataFrame(rows, "scope int, r int, g int, b int, n long")
    feat = cluster.with_color_features(hist, "scope")
    got = {(r.r, r.g, r.b): r.cluster for r in cluster.cluster_leader(feat, "scope", 3).collect()}
    assert got[(10, 10, 10)] == got[(11, 10, 10)] and got[(200, 0, 0)] == got[(201, 3, 0)] and len(set(got.values())) == 3


def test_medoid_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster, "MEDOID_BLOCK", 7)
    rng = np.random.default_rng(5)
    colors = np.unique(rng.integers(0, 256, (90, 3)), axis=0)
    rows = [(0, int(r), int(g), int(b), int(n), int(k)) for (r, g, b), n, k in zip(colors, rng.integers(1, 9, len(colors)), rng.integers(0, 3, len(colors)) // 2)]
    members = cluster.with_color_features(spark.createDataFrame(rows, "scope int, r int, g int, b int, n long, cluster int"), "scope")
    data = members.toPandas()
    for weighted in (False, True):
        got = {r.cluster: (r.r, r.g, r.b) for r in cluster.cluster_medoid(members, "scope", weighted).collect()}
        for k, g in data.groupby("cluster"):
            lab = g[["lab_l", "lab_a", "lab_b"]].to_numpy()
            w = g["weight"].to_numpy() if weighted else np.ones(len(g))
            best = int(np.argmin(np.round(cluster._de2000(lab[:, None, :], lab[None, :, :]) @ w, 6)))
            assert got[k] == tuple(g[RGB].to_numpy()[best])


def test_pruned_cells_keep_the_nearest_entry(spark):
    rng = np.random.default_rng(1)
    pal = rng.integers(0, 256, (200, 3))
    colors = np.vstack([rng.integers(0, 256, (3000, 3)), pal[:50]])
    p = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(pal)], "idx int, r int, g int, b int")
    px = spark.createDataFrame([tuple(map(int, c)) for c in colors], "r int, g int, b int")
    got = {(r.r, r.g, r.b): r.idx for r in mapping.map_to_shared_palette(px, p).collect()}
    for c in colors:
        assert got[tuple(map(int, c))] == int(np.argmin(((pal - c) ** 2).sum(axis=1)))


def test_shared_palette_mapping_never_shuffles_pixels(spark):
    t = Tables(spark, FOLDER)
    pal = t("palette").where("palette_id = 0").select("idx", *RGB)
    text = plan(mapping.map_to_shared_palette(t("pixels"), pal))
    assert "BroadcastHashJoin" in text and "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "Python" not in plan(mapping.map_to_palette(t("px"), t("palette")))


def test_oversized_palette_is_refused(spark):
    big = spark.range(300).selectExpr("0 as palette_id", "cast(id as int) as idx", "0 as r", "0 as g", "0 as b")
    with pytest.raises(Exception, match="palette larger than 256"):
        mapping.packed_palette(big).collect()


def test_padding_fills_every_palette(spark):
    few = spark.createDataFrame([(0, 0, 1, 2, 3), (1, 0, 0, 0, 0), (1, 1, 255, 255, 255)], "palette_id int, idx int, r int, g int, b int")
    rows = lut.pad_palette(few, 256).collect()
    for p in (0, 1):
        one = [(r.r, r.g, r.b) for r in rows if r.palette_id == p]
        assert len(one) == 256 and len(set(one)) == 256
        assert sorted(r.idx for r in rows if r.palette_id == p) == list(range(256))


def test_padding_offers_stay_in_the_row_of_their_palette(spark):
    """Against plain Python, with every source of offers; offers as rows were some 1400 a palette, grouped, joined and sorted in one task."""
    rnd = random.Random(5)
    colour = lambda: tuple(rnd.randrange(0, 256, 51) for _ in RGB)
    palettes = {p: [colour() for _ in range(n)] for p, n in ((0, 1), (1, 7), (2, 40), (3, 60), (None, 2))}
    spare = [(p, i // 2, *colour()) for p in (0, 1, 2, 9) for i in range(12)]
    hist = [(p, *c, rnd.randrange(1, 4)) for p in (0, 2, 3, 8, None) for c in {colour() for _ in range(30)}]
    size = 50
    out = lut.pad_palette(
        spark.createDataFrame([(p, i, *c) for p, e in palettes.items() for i, c in enumerate(e)], "palette_id int, idx int, r int, g int, b int"),
        size,
        "palette_id",
        spark.createDataFrame(hist, "palette_id int, r int, g int, b int, n long"),
        spark.createDataFrame(spare, "palette_id int, seq long, r int, g int, b int"),
    )
    want = []
    for p, entries in palettes.items():
        want += [(p, i, *c, None) for i, c in enumerate(entries[:size])]
        if p is None:
            continue
        offers = [(0, x[2:]) for x in sorted(x for x in spare if x[0] == p)]
        for i, one in enumerate(entries):
            for two in entries[i + 1 : i + 5]:
                offers += [(1, tuple((a * (4 - k) + b * k) // 4 for a, b in zip(one, two))) for k in (1, 2, 3)]
        offers += [(2, x[1:4]) for x in sorted((x for x in hist if x[0] == p), key=lambda x: (-x[4], x[1:4]))]
        offers += [(3, (r, g, b)) for r in range(0, 256, 42) for g in range(0, 256, 42) for b in range(0, 256, 42)]
        seen = set(entries)
        new = [(s, c) for s, c in offers if not (c in seen or seen.add(c))]
        want += [(p, len(entries) + i, *c, s) for i, (s, c) in enumerate(new[: max(0, size - len(entries))])]
    assert plan(out).count("Generate") == 1
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


# ---- neighbourhoods ---------------------------------------------------------------------------------------------------


def image_frame(spark, data: np.ndarray, columns: str):
    h, w = data.shape[:2]
    rows = [(0, x, y, *[int(v) for v in np.atleast_1d(data[y, x])]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, " + columns)


def as_array(df, shape, column="idx"):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


@pytest.fixture()
def small_bands(monkeypatch):
    monkeypatch.setattr(neighborhood, "BAND", 4)


def test_median_over_bands(spark, small_bands):
    data = np.random.default_rng(2).integers(0, 64, (19, 11))
    df = image_frame(spark, data, "idx int")
    for size in (3, 5):
        k = size // 2
        pad = np.pad(data, k, mode="edge")
        want = np.array([[np.median(pad[y : y + size, x : x + size]) for x in range(11)] for y in range(19)])
        assert (as_array(neighborhood.median_filter(df, size), data.shape) == want).all()


@pytest.mark.parametrize("cells", [1 << 20, 90])
def test_sliding_median_equals_sorting(monkeypatch, cells):
    """Windows of 3 to 31, lines of different begin and length, holes, columns in one part or in many."""
    monkeypatch.setattr(neighborhood, "MEDIAN_CELLS", cells)
    rng = np.random.default_rng(12)
    for size in (3, 7, 9, 15, 31):
        k = size // 2
        starts = rng.integers(0, 5, 13).tolist()
        lines = [np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 30, n)) for n in rng.integers(6, 25, 13)]
        own = [2 <= i < 11 for i in range(13)]
        got = neighborhood.sliding_median(lines, starts, own, k)
        assert len(got) == 9
        for i, medians in zip(range(2, 11), got):
            for j, median in enumerate(medians):
                taps = []
                for y in range(i - k, i + k + 1):
                    y = min(max(y, 0), 12)
                    for x in range(starts[i] + j - k, starts[i] + j + k + 1):
                        taps.append(lines[y][min(max(x - starts[y], 0), len(lines[y]) - 1)])
                known = sorted(v for v in taps if not np.isnan(v))
                assert not known or median == known[len(known) // 2]


def test_wide_median_over_bands(spark, small_bands):
    data = np.random.default_rng(3).integers(0, 64, (19, 11))
    whole = image_frame(spark, data, "idx int")
    for size in (7, 11):
        k = size // 2
        pad = np.pad(data, k, mode="edge")
        want = np.array([[np.median(pad[y : y + size, x : x + size]) for x in range(11)] for y in range(19)])
        assert (as_array(neighborhood.median_filter(whole, size), data.shape) == want).all()
    holed = whole.where("not (x = 2 and y = 3)")
    got = neighborhood.median_filter(holed, 7)
    assert got.schema["idx"].dataType.simpleString() == "int"
    rows = got.collect()
    assert len(rows) == 19 * 11 - 1 and all(r.idx is not None for r in rows)
    assert neighborhood.median_filter(whole.limit(0), 7).count() == 0


def test_gaussian_over_bands(spark, small_bands):
    data = np.random.default_rng(4).integers(0, 256, (17, 9))
    weights = np.array(neighborhood.gaussian_weights(1.0))
    pad = np.pad(data.astype(float), 3, mode="edge")
    rows = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 1, pad)
    want = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), 0, rows)
    got = as_array(neighborhood.gaussian_filter(image_frame(spark, data, "idx int"), 1.0), data.shape)
    assert (got == np.floor(np.round(want, 6) + 0.5)).all()


@pytest.mark.parametrize("ways", [4, 8])
def test_cooccurrence_over_bands(spark, small_bands, ways):
    data = np.random.default_rng(6).integers(0, 5, (14, 7))
    want = {}
    for dy, dx in [(0, 1), (1, 0), (1, 1), (1, -1)][: 4 if ways == 8 else 2]:
        for y in range(14):
            for x in range(7):
                if 0 <= y + dy < 14 and 0 <= x + dx < 7 and data[y, x] != data[y + dy, x + dx]:
                    for a, b in ((data[y, x], data[y + dy, x + dx]), (data[y + dy, x + dx], data[y, x])):
                        want[(a, b)] = want.get((a, b), 0) + 1
    got = neighborhood.cooccurrence(image_frame(spark, data, "idx int"), ways).collect()
    assert {(r.idx_a, r.idx_b): r.n for r in got} == want


def brute_fill(data: np.ndarray, rounds: int) -> np.ndarray:
    rgb, alpha = data[..., :3].copy(), data[..., 3]
    known, wanted = alpha > 0, alpha == 0
    for _ in range(rounds):
        for dx, dy in neighborhood.FILL_SHIFTS:
            reach = np.roll(known, (dy, dx), (0, 1)) & wanted
            rgb[reach] = np.roll(rgb, (dy, dx), (0, 1))[reach]
            known, wanted = known | reach, wanted & ~reach
    return np.dstack([rgb, np.where((alpha == 0) & known, 255, alpha)])


@pytest.mark.parametrize("band, rounds", [(4, 1), (4, 2), (256, 3)])
def test_dilate_is_exact_over_bands(spark, monkeypatch, band, rounds):
    monkeypatch.setattr(neighborhood, "BAND", band)
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, (41, 6, 4))
    data[..., 3] = np.where(rng.random((41, 6)) < 0.12, 255, 0)
    got = neighborhood.dilate(image_frame(spark, data, "r int, g int, b int, a int"), rounds).collect()
    want = brute_fill(data, rounds)
    assert len(got) == 41 * 6
    assert all((r.r, r.g, r.b, r.a) == tuple(want[r.y, r.x]) for r in got)


def test_holes_in_lines_are_left_out(spark, small_bands):
    data = np.arange(30).reshape(6, 5)
    df = image_frame(spark, data, "idx int").where("not (x = 2 and y = 3)")
    got = neighborhood.median_filter(df, 3).collect()
    assert len(got) == 29 and all(r.idx is not None for r in got)


def test_pairs_of_a_common_name(spark, monkeypatch):
    """A name that most files share is dealt over shards; nothing is lost or doubled, repeated rows count as given."""
    monkeypatch.setattr(pathops, "PAIR_SHARD", 8)
    greys = [f"a{i}/default.dds" for i in range(100)] + ["b/other.dds", "b/lonely.dds", "b/other.dds", None]
    colors = [f"c{i}/Default.dds" for i in range(7)] + ["d/OTHER.dds", None]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    key = {r.path: r.key for r in pathops._keyed(frame(greys + colors)).collect()}
    want = sorted((key[g], g, c) for g in greys for c in colors if key[g] is not None and key[g] == key[c])
    got = pathops.pair_textures(frame(greys), frame(colors), ordered=False)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 702
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()
    ordered = [tuple(r) for r in pathops.pair_textures(frame(greys), frame(colors)).collect()]
    assert sorted(ordered) == want and [r[0] for r in ordered] == sorted(r[0] for r in ordered)
    assert pathops.pair_textures(frame(greys), frame([])).count() == 0


def test_first_with_prefix_over_ranges(spark):
    """Names that sort around the ending, stems that reach into it, stems at the ends of ranges, several folders."""
    rng = np.random.default_rng(10)
    word = lambda most: "".join(rng.choice(list("ab. _nif"), rng.integers(0, most)))
    names = [(f"d{rng.integers(0, 3)}", word(6) + rng.choice(["", "", ".", ".n", ".nif"]), f"v{i:04}") for i in range(400)]
    asks = [(f"d{rng.integers(0, 4)}", word(5) + rng.choice(["", "", ".", ".n", ".ni", ".nif"])) for _ in range(300)] + [(d, n) for d, n, _ in names[:50]] + [("d0", None), (None, "a")]
    left = spark.createDataFrame(names, "dir string, name string, value string")
    right = spark.createDataFrame(asks, "dir string, stem string")
    want = {}
    for d, stem in asks:
        hits = [((n + ".nif").encode(), v) for e, n, v in names if e == d and stem and n.startswith(stem)]
        if hits:
            want[d, stem] = (min(hits)[0].decode(), min(hits)[1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for adaptive, parts in (("true", "8"), ("false", "40")):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {(r.dir, r.stem): (r.file, r.value) for r in pathops.first_with_prefix(left, right, ".nif").collect()}
            assert got == want and len(want) > 50
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert pathops.first_with_prefix(left.limit(0), right, ".nif").count() == 0
    assert pathops.first_with_prefix(left, right.limit(0), ".nif").count() == 0


# ---- binary files -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("mtype, version", [("BGSM", v) for v in (1, 2, 3, 6, 7, 8, 9, 10, 12, 13, 17)] + [("BGEM", v) for v in (6, 10, 11, 15, 16, 20, 21, 22)])
def test_material_round_trip(mtype, version):
    full = {"mtype": mtype, "version": version}
    for i, (name, kind, _) in enumerate(material_files.LAYOUTS[mtype]):
        full[name] = {"bool": True, "u8": i % 256, "u32": 70000 + i, "f32": i / 4, "str": f"t/{name}é.dds", "color": {"r": 0.5, "g": i / 8, "b": 1.0}}[kind]
    raw = material_files.encode_material(full)
    back = material_files.decode_material(raw)
    assert all(full[k] == v for k, v in back.items())
    assert material_files.encode_material(back) == raw
    empty = material_files.encode_material({"mtype": mtype, "version": version})
    again = material_files.decode_material(empty)
    assert material_files.encode_material(again) == empty
    if mtype == "BGSM":
        assert again["SpecularColor"] == {"r": 1.0, "g": 1.0, "b": 1.0} and again["DiffuseTexture"] == ""


def test_corrupt_materials_become_error_rows(spark):
    good = material_files.encode_material({"mtype": "BGSM", "version": 2, "DiffuseTexture": "x.dds"})
    rows = [("ok.bgsm", good), ("short.bgsm", good[:90]), ("bad.bgsm", b"XXXX" + good[4:]), ("empty.bgsm", b"")]
    got = {r.path: r for r in material_files.material_catalog(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["ok.bgsm"].error is None and got["ok.bgsm"].DiffuseTexture == "x.dds" and got["ok.bgsm"].PBR is None
    assert all(got[k].error for k in ("short.bgsm", "bad.bgsm", "empty.bgsm"))


def test_materials_of_a_batch_are_read_and_made_together(monkeypatch):
    """Whole batches give what one file at a time gives, without a call per file; cut and spoilt files keep their errors."""
    import random

    import pyarrow as pa

    rng, kinds = random.Random(5), material_files.KINDS
    value = {"bool": lambda: rng.random() < 0.5, "u8": lambda: rng.randrange(256), "u32": lambda: rng.randrange(1 << 32), "f32": lambda: rng.randrange(-999, 999) / 8, "str": lambda: rng.choice(["", "a", "ü/ß.dds", "x" * 300]), "color": lambda: {"r": 0.5, "g": rng.random() // 0.125 / 8, "b": 1.0}}
    rows = []
    for i in range(400):
        mtype = rng.choice(["BGSM", "BGEM"])
        rows.append({"mtype": mtype, "version": rng.choice([1, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13, 15, 16, 17, 20, 21, 22])} | {n: value[k]() if rng.random() < 0.8 else None for n, k in kinds.items() if n != "LumEmittance"})
    schema = pa.schema([("mtype", pa.string()), ("version", pa.int64()), *[(n, material_files._ARROW[k]) for n, k in kinds.items() if n != "LumEmittance"]])
    one = [material_files.encode_material(r) for r in rows]
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    monkeypatch.setattr(material_files, "encode_material", None)
    assert material_files.encode_rows(batch).to_pylist() == one
    assert material_files.encode_rows(batch.slice(7, 100)).to_pylist() == one[7:107] and material_files.encode_rows(batch.slice(0, 0)).to_pylist() == []
    files = [c if i % 4 else rng.choice([c[: rng.randrange(len(c))], c[:-1], b"XXXX" + c[4:], None, c.replace("ü".encode(), b"\xff\xff"), c + b"more"]) for i, c in enumerate(one)]
    want = []
    for c in files:
        try:
            want.append(material_files.decode_material(c))
        except Exception as e:
            want.append({"error": str(e)})
    paths = pa.array([str(i) for i in range(len(files))])
    decode, calls = material_files.decode_material, []
    monkeypatch.setattr(material_files, "decode_material", lambda c: calls.append(c) or decode(c))
    for at, size in ((0, len(files)), (3, 50), (0, 0)):
        got = material_files.decode_materials(paths.slice(at, size), pa.array(files, pa.binary()).slice(at, size))
        assert got.to_pylist() == pa.RecordBatch.from_pylist([{"path": str(i), **want[i]} for i in range(at, at + size)], schema=material_files._CATALOG_ARROW).to_pylist()
    assert 0 < len(calls) <= 2 * sum("error" in w for w in want)


def sub(tag: bytes, text: bytes, size: int) -> bytes:
    return tag + size.to_bytes(2, "little") + text.ljust(size, b"\0")


def test_plugin_scan_rename_and_patch(spark):
    body = b"TES4....." + sub(b"CNAM", b"me", 4) + sub(b"CNAM", b"nobody", 10) + sub(b"SNAM", b"", 3)
    body += sub(b"EDID", b"Gun_01", 8) + b"??" + sub(b"EDID", b"Gun_EDID", 12) + b"EDID\xff\xff"
    files = spark.createDataFrame([("a.esp", body), ("none.esp", b"EDI")], "path string, content binary")
    texts = plugin_files.plugin_strings(files)
    assert [(r.size, r.text) for r in texts.orderBy("rec_offset").collect()] == [(8, "Gun_01"), (12, "Gun_EDID")]
    renamed = plugins.rename_strings(texts, F.array(F.lit("Gun")), "Rifle.esp")
    flags = {r.text: (r.changed, r.new_text) for r in renamed.collect()}
    assert flags == {"Gun_01": (True, "Rifle_01"), "Gun_EDID": (True, "Rifle_EDID")}
    too_long = plugins.rename_strings(texts, F.array(F.lit("Gun")), "Cannon.esp")
    assert {r.text: r.changed for r in too_long.collect()} == {"Gun_01": False, "Gun_EDID": True}
    author = plugins.set_header(plugin_files.plugin_header(files), "CNAM", "someone")
    assert author.count() == 1 and author.first().size == 10
    patches = renamed.select("path", "rec_offset", "payload").unionByName(author.select("path", "rec_offset", "payload"))
    done = {r.path: bytes(r.content) for r in plugin_files.patch_files(files, patches).collect()}
    assert len(done["a.esp"]) == len(body) and done["none.esp"] == b"EDI"
    assert b"Rifle_01" in done["a.esp"] and b"Rifle_EDID" in done["a.esp"] and b"someone\0\0\0" in done["a.esp"]
    again = plugin_files.plugin_strings(spark.createDataFrame(list(done.items()), "path string, content binary"))
    assert {r.text for r in again.collect()} == {"Rifle_01", "Rifle_EDID"}


# ---- files ------------------------------------------------------------------------------------------------------------


def test_file_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "Mods" / "Data"
    (root / "sub").mkdir(parents=True)
    for name in ("a_d.dds", "b.PNG", "c.txt", "sub/d.tga"):
        (root / name).write_bytes(b"xyz")
    found = assets.scan_assets(spark, str(root))
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a_d.dds", "b.PNG", "d.tga"]
    assert "content" not in plan(found).split("ReadSchema")[-1]
    assert assets.scan_assets(spark, str(root), recursive=False).count() == 2

    files = spark.createDataFrame([("m/Data/x/a.dds",), ("m/Data/b.dds",), ("m/other.txt",)], "path string")
    assets.write_manifest(files, "m", str(tmp_path / "manifest"))
    parts = sorted((tmp_path / "manifest").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert text == '[\n\t"Data\\\\b.dds",\n\t"Data\\\\x\\\\a.dds"\n]\n'
    assets.write_manifest(files.where("false"), "m", str(tmp_path / "none"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))) == "[\n]\n"

    out = spark.createDataFrame([("p/q.bin", b"12")], "path string, content binary")
    for _ in range(2):
        file_sinks.write_files(out, str(tmp_path / "out"))
    assert [p.read_bytes() for p in (tmp_path / "out").rglob("*.*")] == [b"12"]

    px = Tables(spark, FOLDER)("indexed")
    assets.write_index_image(px.select("image_id", "x", "y", "idx"), str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == px.count()
    tex = lut.compose_palette(px.sparkSession.createDataFrame([(0, 0, 0, 1, 2, 3)], "palette_id int, row_no int, idx int, r int, g int, b int"), 3)
    assets.write_palette_texture(tex, str(tmp_path / "tex"))
    assert spark.read.parquet(str(tmp_path / "tex")).count() == 4


def test_list_files_in_both_encodings(spark, tmp_path):
    head = "Role\tPerspective\tA\tT\tBehavior\tAnim\n"
    row = "MT\t1st\t\tAnims\tB\tX\\é€, Y\n"
    (tmp_path / "u.txt").write_bytes((head + row + "short\tline\n\n").encode("utf-8"))
    (tmp_path / "c.txt").write_bytes((head + row).replace("\n", "\r\n").encode("cp1252"))
    rows = tables.read_subgraph(spark, str(tmp_path))
    assert {(r.file_stem, r.role, r.anim_paths) for r in rows.collect()} == {("u", "MT", "X\\é€, Y"), ("c", "MT", "X\\é€, Y")}
    assert tables.subgraph_lines(rows).select("value").distinct().first()[0] == row.rstrip("\n")


def test_stream_counters(spark, tmp_path):
    from texelmill.streaming import incremental

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"sDiffuseTexture": "x"}')
    (src / "b.json").write_text("{bad")
    (src / "c.bgsm").write_bytes(b"????")

    def outcomes():
        files = incremental.watch_files(spark, str(src)).withColumn("value", F.expr("try_validate_utf8(cast(content as string))"))
        files = files.withColumn("kind", paths.material_kind(F.col("content")))
        return materials.with_outcome(materials.read_material_json(files))

    for step, want in (("one", 3), ("two", 4)):
        q = incremental.write_summary(incremental.running_summary(outcomes()), f"counters_{step}", str(tmp_path / "state"))
        q.awaitTermination(60)
        row = spark.table(f"counters_{step}").first()
        assert (row.scanned, row.errors, row.skipped_unknown) == (want, 1, 1)
        (src / "d.json").write_text('{"sBaseTexture": "y"}')


def test_rewritten_json_is_written_pretty(spark):
    rec = spark.createDataFrame([("m/a.json", '{"sDiffuseTexture":"x/y.dds","other":"1"}')], "path string, value string")
    out = materials.rewrite_material_json(materials.read_material_json(rec), ["f"])
    row = material_files.material_json_text(out).first()
    assert row.path == "m/f/a.json" and b'"sDiffuseTexture" : "x/f/y.dds"' in bytes(row.content)


# ---- scale shape ------------------------------------------------------------------------------------------------------


def test_plans_have_no_cross_joins(spark):
    import __spark_entry__ as entry

    for name in ("e01_map_to_palette", "e03_assign_representatives", "e10_find_mesh", "e08_detect_textures", "d10_cooccurrence", "g04_cluster_colors", "f12_median_filter"):
        text = plan(entry.queries()[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = ordering.with_position(df, [F.col("v")]).orderBy("v").collect()
    assert [r.position for r in rows] == list(range(1000))


def test_pair_order(spark):
    greys = spark.createDataFrame([("b/x_grey.png",), ("a/X_mask.png",)], "path string")
    colors = spark.createDataFrame([("z/x.png",), ("y/x.png",)], "path string")
    got = [(r.grey_path, r.color_path) for r in pathops.pair_textures(greys, colors).collect()]
    assert got == [("a/X_mask.png", "y/x.png"), ("a/X_mask.png", "z/x.png"), ("b/x_grey.png", "y/x.png"), ("b/x_grey.png", "z/x.png")]


def test_adjacency_sort_has_no_interpreted_distances(spark):
    t = Tables(spark, FOLDER)
    links = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 0, 2)], "palette_id int, idx_a int, idx_b int, n long")
    plan = ordering.adjacency_sort(t("palette"), links)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
    wide = spark.range(300).selectExpr("0 as palette_id", "cast(id as int) as idx", "cast(id % 256 as int) as r", "cast(id % 7 as int) as g", "1 as b")
    with pytest.raises(Exception, match="larger than 256"):
        ordering.adjacency_sort(wide, links).collect()
