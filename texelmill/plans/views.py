"""Domain tables derived from the given parquet tables: one expression text for Spark and for the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> (source table, select list); channels are INT 0..255, paths use forward slashes
#: Eight triangles a shape, so shapes grow with the table and stay small.
SHAPE = "cast(floor((s_suppkey-1)/8) as bigint)"

VIEWS: dict[str, tuple[str, list[str]]] = {
    # 32x32 RGBA tiles
    "pixels": (
        "events",
        [
            "cast(floor(event_id/1024) as bigint) as image_id",
            "cast(event_id%32 as int) as x",
            "cast(cast(floor(event_id/32) as bigint)%32 as int) as y",
            "cast((user_id%8)*32+event_id%4 as int) as r",
            "cast(cast(floor(value) as bigint)%16*16 as int) as g",
            "cast(cast(regexp_extract(props,'([0-9]+)',1) as int)%8*32 as int) as b",
            "case when event_type='error' then 0 else 255 end as a",
        ],
    ),
    # palettes of 64 entries, the last one shorter
    "palette": (
        "part",
        [
            "cast(floor(p_partkey/64) as int) as palette_id",
            "cast(p_partkey%64 as int) as idx",
            "cast(p_size*5%256 as int) as r",
            "cast(p_partkey*7%256 as int) as g",
            "cast(p_partkey*p_size%256 as int) as b",
        ],
    ),
    # file catalogue; palettes lie one folder above the other files
    "asset_rows": (
        "part",
        [
            "concat('Mods/Data/Textures/', replace(p_brand,'#',''), '/', case p_partkey%5 when 3 then '' else concat(lower(p_type), '/') end,"
            " replace(p_name,' ','_'), '_', cast(cast(floor(p_partkey/5) as bigint)%3 as varchar(9)),"
            " case p_partkey%5 when 0 then '_d.dds' when 1 then '_n.dds' when 2 then '_greyscale.png' when 3 then '_palette.dds' else '.png' end) as path",
            "cast(p_size*1000 as bigint) as len",
        ],
    ),
    "tex_rows": (
        "part",
        [
            "concat('Mods/Data/Textures/', case p_partkey%4 when 0 then 'Actors' when 1 then 'Armor' else 'Weapons' end, '/', lower(p_type), '/',"
            " replace(p_name,' ','_'), case p_partkey%3 when 0 then '_leg' when 1 then '_Helmet' else '' end, '_d.dds') as path",
        ],
    ),
    "mesh_rows": (
        "part",
        [
            "concat('Mods/Data/Meshes/', case p_partkey%4 when 0 then 'Actors' when 1 then 'Armor' else 'Weapons' end, '/', lower(p_type), '/',"
            " case p_partkey%8 when 0 then 'CharacterAssets/' else '' end, replace(p_name,' ','_'),"
            " case p_partkey%5 when 0 then '_1' when 1 then '_leg' when 2 then '_helmet_b' when 3 then '' else '_x' end, '.nif') as path",
        ],
    ),
    "material_json": (
        "part",
        [
            "concat('Materials/m', cast(p_partkey as varchar(20)), '.json') as path",
            "case when p_partkey%97=0 then '{bad' when p_partkey%89=0 then '{\"sBaseTexture\":\"x\"} tail'"
            " when p_partkey%4=0 then concat('{\"sBaseTexture\":\"Effects/', replace(p_name,' ','_'), '.dds\",\"sNormalTexture\":\"\",\"bGlow\":true,\"aList\":[1,2.5,null],\"oMeta\":{\"k\":\"v\",\"n\":[]},\"nNull\":null}')"
            " else concat('{\"sDiffuseTexture\":\"', case p_partkey%3 when 0 then 'Weapons/' when 1 then concat('Weapons',chr(92),chr(92)) else '' end,"
            " replace(p_name,' ','_'), '_d.dds\",\"sNormalTexture\":\"Weapons/gold/n.dds\",\"fGrayscaleToPaletteScale\":1.5,\"fAlpha\":0.5,\"iTiles\":3}') end as value",
        ],
    ),
    "subgraph": (
        "orders",
        [
            "o_orderkey as row_id",
            "o_orderpriority as role",
            "case when o_orderkey%2=0 then '1st' else '3rd' end as perspective",
            "case when o_custkey%3=0 then 'Flavor' else '' end as actor_kw",
            "concat('Anims', o_orderstatus, ',  Anims', cast(o_custkey%9 as varchar(20))) as target_kw",
            "concat('Actors', chr(92), 'Behaviors', chr(92), 'B.hkx') as behavior",
            "concat('Actors', chr(92), 'Anim', chr(92), 'W', cast(o_orderkey%11 as varchar(20)), ', Actors/Power/W', cast(o_custkey%5 as varchar(20)),"
            " ', Actors/Power/W', cast(o_orderkey%5 as varchar(20))) as anim_paths",
        ],
    ),
    # 148-byte texture headers as hex
    "texture_bytes": (
        "part",
        [
            "concat('Textures/t', cast(p_partkey as varchar(20)), '.dds') as path",
            "cast(power(2, p_size%6+7) as bigint) as w",
            "cast(power(2, p_partkey%5+7) as bigint) as h",
            "concat(case when p_partkey%50=0 then '00000000' else '44445320' end, '7C000000', '00000000',"
            " lpad(hex(cast(power(2, p_partkey%5+7) as bigint)%256),2,'0'), lpad(hex(cast(floor(power(2, p_partkey%5+7)/256) as bigint)),2,'0'), '0000',"
            " lpad(hex(cast(power(2, p_size%6+7) as bigint)%256),2,'0'), lpad(hex(cast(floor(power(2, p_size%6+7)/256) as bigint)),2,'0'), '0000',"
            " repeat('00',64), case when p_partkey%3=0 then '44585435' else '44583130' end, repeat('00',40),"
            " case p_partkey%4 when 0 then '62' when 1 then '63' else '4D' end, repeat('00',19)) as content_hex",
        ],
    ),
    # 64 string records per plugin file
    "plugin_rows": (
        "customer",
        [
            "concat('plugin', cast(cast(floor(c_custkey/64) as bigint) as varchar(20)), '.esp') as path",
            "cast(c_custkey%64 as int) as slot",
            "cast(length(concat('Template_', c_mktsegment, '_', cast(c_custkey as varchar(20))))+c_custkey%7 as int) as size",
            "concat('Template_', c_mktsegment, '_', cast(c_custkey as varchar(20))) as text",
        ],
    ),
    "triangles": (
        "supplier",
        [
            f"{SHAPE} as shape_id",
            "s_suppkey as tri_id",
            *[
                f"cast(s_suppkey*{m}%64+{d} as double)/64 as {n}"
                for n, m, d in (("u0", 3, 0), ("v0", 5, 0), ("u1", 3, 9), ("v1", 5, 2), ("u2", 3, 4), ("v2", 5, 11))
            ],
        ],
    ),
    "shapes": (
        "supplier",
        [
            f"concat('Meshes/m', cast({SHAPE} as varchar(20)), '.nif') as mesh_path",
            "s_suppkey as shape_id",
            "case when s_suppkey%7=0 then '' else concat('Textures/t', cast(s_suppkey%4 as varchar(20)), '_d.dds') end as diffuse",
            "cast(s_suppkey%3 as int) as n_sets",
        ],
    ),
}

# views made of other views, as SQL for the check only; ``Tables`` builds them with the DataFrame API
DERIVED_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "assets": (("asset_rows",), "select path, max(len) as length from asset_rows group by path"),
    "textures": (("tex_rows",), "select distinct path from tex_rows"),
    "meshes": (("mesh_rows",), "select distinct path from mesh_rows"),
    "px": (
        ("pixels", "palette"),
        "select p.*, cast(p.image_id % (select count(distinct palette_id) from palette) as int) as palette_id from pixels p",
    ),
    "indexed": (("px",), "select px.*, cast(floor(g/16)*4+floor(b/64) as int) as idx from px"),
    "hist": (("pixels",), "select image_id, r, g, b, count(*) as n from pixels group by all"),
    "colors": (("pixels",), "select distinct r, g, b from pixels"),
    "ghist": (
        ("hist",),
        "select 0 as scope, r, g, b, cast(sum(n) as bigint) as n, cast(count(*) as bigint) as coverage from hist group by r, g, b",
    ),
    "ipal": (
        ("hist",),
        "select image_id, cast(rn-1 as int) as idx, r, g, b from (select *, row_number() over (partition by image_id order by n desc, r, g, b) as rn"
        " from hist) q where rn <= 64",
    ),
    "gpal": (
        ("ghist",),
        "select cast(row_number() over (order by n desc, r, g, b)-1 as int) as idx, r, g, b from ghist order by n desc, r, g, b limit 64",
    ),
}


class Tables:
    """The views over one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        if name in VIEWS:
            source, columns = VIEWS[name]
            return self.raw(source).selectExpr(*columns)
        return getattr(self, name)()

    def assets(self) -> DataFrame:
        return self("asset_rows").groupBy("path").agg({"len": "max"}).withColumnRenamed("max(len)", "length")

    def textures(self) -> DataFrame:
        return self("tex_rows").distinct()

    def meshes(self) -> DataFrame:
        return self("mesh_rows").distinct()

    def px(self) -> DataFrame:
        from pyspark.sql import functions as F

        count = self("palette").agg(F.count_distinct("palette_id").alias("n")).scalar()
        return self("pixels").withColumn("palette_id", (F.col("image_id") % count).cast("int"))

    def indexed(self) -> DataFrame:
        return self.px().selectExpr("*", "cast(floor(g/16)*4+floor(b/64) as int) as idx")

    def hist(self) -> DataFrame:
        from texelmill.operators.histogram import color_histogram

        return color_histogram(self("pixels"), ["image_id"])

    def colors(self) -> DataFrame:
        from texelmill.operators.histogram import unique_colors

        return unique_colors(self("pixels"))

    def ghist(self) -> DataFrame:
        from pyspark.sql import functions as F

        from texelmill.operators.cluster import one_scope

        per_color = self.hist().groupBy("r", "g", "b")
        return one_scope(per_color.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("coverage")))

    def ipal(self) -> DataFrame:
        """The 64 most frequent colours of each image as its palette."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        w = Window.partitionBy("image_id").orderBy(F.desc("n"), "r", "g", "b")
        ranked = self.hist().withColumn("rn", F.row_number().over(w)).where("rn <= 64")
        return ranked.select("image_id", (F.col("rn") - 1).alias("idx"), "r", "g", "b")

    def gpal(self) -> DataFrame:
        """The 64 most frequent colours of all images as one palette (top-k, then ranks over those 64 rows)."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        order = [F.desc("n"), F.asc("r"), F.asc("g"), F.asc("b")]
        top = self.ghist().orderBy(*order).limit(64)
        return top.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("idx"), "r", "g", "b")


def with_views(*names: str) -> list[tuple[str, str]]:
    """SQL steps that define the named views and everything below them, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        if name in VIEWS:
            source, columns = VIEWS[name]
            done[name] = f"select {', '.join(columns)} from {source}"
        else:
            needs, text = DERIVED_SQL[name]
            for n in needs:
                add(n)
            done[name] = text

    for n in names:
        add(n)
    return list(done.items())
