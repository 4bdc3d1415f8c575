"""Readers and writers of the venue's documents: GeoJSON, directory, grid, baseline, itineraries, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from atrium import params

PROPERTIES = "kind:string,cat:string,code:string,name:string,area_m2:double,peso:double,mini:boolean,numeracao_derivada:boolean,nome_derivado:boolean,borda_aberta:boolean,eixo:string,largura_m:double,extensao_m:double"
COLLECTION = f"type string, features array<struct<type:string,properties:struct<{PROPERTIES}>,geometry:struct<type:string,coordinates:string>>>"
POINTS = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "LineString": "array<array<double>>", "Point": "array<double>"}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row a feature (ord, kind, ..., geometry) of FeatureCollections, one document a file.

    geometry: type, and lines: arrays of (x, y), whatever the type; the rings of a MultiPolygon's parts follow
    each other.
    """
    docs = spark.read.schema(COLLECTION).option("multiLine", True).json(path)
    rows = docs.select(F.posexplode("features").alias("ord", "f")).select("ord", "f.properties.*", "f.geometry")
    raw = F.col("geometry.coordinates")
    pts = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    as_ = {k: F.from_json(raw, v) for k, v in POINTS.items()}
    kind = F.col("geometry.type")
    lines = (
        F.when(kind.isin("Polygon", "MultiLineString"), F.transform(as_["Polygon"], pts))
        .when(kind == "MultiPolygon", F.transform(F.flatten(as_["MultiPolygon"]), pts))
        .when(kind == "LineString", F.array(pts(as_["LineString"])))
        .when(kind == "Point", F.array(pts(F.array(as_["Point"]))))
    )
    return rows.withColumn("geometry", F.struct(kind.alias("type"), lines.alias("lines")))


def feature_json(features: DataFrame) -> DataFrame:
    """(ord, value): each feature as GeoJSON text; properties that are null are left out. Each ring of a
    MultiPolygon is a part of its own."""
    pair = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    line = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, pair), ","), F.lit("]"))
    kind, lines = F.col("geometry.type"), F.col("geometry.lines")
    coordinates = F.when(kind == "Point", pair(lines[0][0])).when(kind == "LineString", line(lines[0])).when(kind == "MultiPolygon", F.concat(F.lit("[["), F.array_join(F.transform(lines, line), "],["), F.lit("]]"))).otherwise(F.concat(F.lit("["), F.array_join(F.transform(lines, line), ","), F.lit("]")))
    properties = F.to_json(F.struct(*[c for c in features.columns if c not in ("ord", "geometry")]))
    return features.select("ord", F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}")).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """One GeoJSON feature a line, in parallel: the form for data of any size."""
    feature_json(features).select("value").write.text(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """One FeatureCollection in one file. A document is one object by its format: for one venue's map."""
    body = feature_json(features).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda r: r["value"]), ",").alias("b"))
    body.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "b", F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(code, name) of exhibitors and (n, name) of booths; a missing section is empty."""
    docs = spark.read.schema("expositores map<string,string>, travessa map<string,string>").option("multiLine", True).json(path)
    section = lambda c: docs.select(F.explode(F.coalesce(c, F.expr("cast(map() as map<string,string>)"))).alias("k", "name"))
    return section("expositores").withColumnRenamed("k", "code"), section("travessa").select(F.col("k").cast("int").alias("n"), "name")


def read_ring(spark: SparkSession, path: str) -> DataFrame:
    """(pos, x, y): the outer ring of the first feature."""
    first = read_geojson(spark, path).where("ord = 0").select(F.posexplode(F.col("geometry.lines")[0]).alias("pos", "p"))
    return first.select("pos", "p.x", "p.y")


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring): the outer ring of every feature of the documents under ``path``, open, by the feature's name."""
    rows = read_geojson(spark, path).select("name", F.col("geometry.lines")[0].alias("r"))
    closed = (F.size("r") > 1) & (F.element_at("r", 1) == F.element_at("r", -1))
    return rows.select("name", F.when(closed, F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r")).alias("ring"))


GRID = "venue long, passo double, w int, h int, origem array<double>, ex array<double>, ey array<double>, livre string, acessos map<string,array<int>>, portas map<string,array<array<int>>>"


def write_grid(packed: DataFrame, width: int, height: int, step: float, path: str, frame=None, access: DataFrame | None = None, doors: DataFrame | None = None, key: str = "venue") -> None:
    """One JSON object a venue: step, size, the frame's origin and axes, the packed cells, the access cell of each
    destination (key, name, i, j; the first of a name counts) and the cells of each door (key, name, i, j)."""
    rows = packed
    cell = F.array(F.col("i").cast("int"), F.col("j").cast("int"))
    if access is not None:
        first = access.where("i is not null").groupBy(key, "name").agg(F.min(F.struct("ord", cell.alias("c"))).alias("m"))
        rows = rows.join(first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "m.c")))).alias("acessos")), key, "left")
    if doors is not None:
        each = doors.groupBy(key, "name").agg(F.array_sort(F.collect_list(cell)).alias("c"))
        rows = rows.join(each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "c")))).alias("portas")), key, "left")
    axis = lambda v: F.array(*[F.lit(round(float(x), 9)) for x in v]) if v else F.lit(None).cast("array<double>")
    parts = {
        "venue": F.col(key), "passo": F.lit(float(step)), "w": F.lit(width), "h": F.lit(height),
        "origem": axis(frame and frame.origin), "ex": axis(frame and frame.ex), "ey": axis(frame and frame.ey), "livre": F.col("bits"),
        **{c: F.col(c) for c in ("acessos", "portas") if c in rows.columns},
    }
    rows.select(F.to_json(F.struct(*[v.alias(k) for k, v in parts.items()])).alias("value")).write.text(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(venue, step, w, h, origem, ex, ey, bits, acessos, portas) of what write_grid wrote."""
    return spark.read.schema(GRID).json(path).withColumnsRenamed({"livre": "bits", "passo": "step"})


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """(category, value) of an acceptance baseline; None where there is none yet."""
    try:
        docs = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    return docs.select(F.explode(F.from_json("value", "map<string,double>")).alias("category", "value"))


def write_baseline(rows: DataFrame, path: str) -> None:
    rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "value"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: The baseline's entry for the largest drift, beside the categories.
DRIFT = "_deriva_cm"


def regressions(fidelity: DataFrame, baseline: DataFrame | None, slack: float = params.BASELINE_RATIO, drift: float = params.BASELINE_DRIFT_CM) -> DataFrame:
    """Categories (category, ratio) whose ratio fell by more than ``slack`` below the baseline, and the drift in
    centimetres (category DRIFT) if it grew by more than ``drift``; none without a baseline."""
    if baseline is None:
        return fidelity.where("false")
    return fidelity.join(baseline, "category").where(f"case when category = '{DRIFT}' then ratio > value + {drift} else ratio < value - {slack} end")


def acceptance(spark: SparkSession, fidelity: DataFrame, path: str, accept: bool = False) -> DataFrame:
    """The regressions of (category, ratio, drift_cm) against the baseline under ``path``; with ``accept`` the figures
    become the baseline, and none is one."""
    now = fidelity.select("category", F.round("ratio", 4).alias("ratio"))
    now = now.union(fidelity.agg(F.coalesce(F.round(F.max("drift_cm"), 2), F.lit(0.0)).alias("ratio")).select(F.lit(DRIFT), "ratio"))
    if accept:
        write_baseline(now.select("category", F.col("ratio").alias("value")), path)
        return now.where("false")
    return regressions(now, read_baseline(spark, path))


def save_itinerary(stops: DataFrame, path: str) -> None:
    stops.write.mode("overwrite").parquet(path)


def restore_itinerary(spark: SparkSession, path: str, cells: DataFrame) -> DataFrame:
    """The first stop of each stored itinerary, if its cell is still free."""
    first = spark.read.parquet(path).where("pos = 0")
    return first.join(cells.where("free").select("venue", "i", "j"), ["venue", "i", "j"], "left_semi")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(files, version): a hash of all files' paths under ``path`` and contents, 12 characters, that any change changes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    name = F.expr("substring(path, instr(path, root) + length(root))")
    one = files.withColumn("root", F.lit(root)).select(name.alias("name"), F.sha2("content", 256).alias("digest"))
    return one.agg(F.count("*").alias("files"), F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "digest"))), lambda f: F.concat(f["name"], F.lit(":"), f["digest"])), "\n"), 256), 1, 12).alias("version"))


def write_report(issues: DataFrame, path: str, totals: dict[str, int] | None = None) -> None:
    """An import report in Markdown: totals, if given, then pending points, then warnings, each in order."""
    line = F.concat(F.lit("- **"), "rule", F.lit("** "), "msg")
    rows = issues.select(F.when(F.col("severity") == "pending", 1).otherwise(2).alias("part"), "rule", line.alias("value"))
    heads = [(1, "", "## Pending"), (2, "", "## Warnings")] + [(0, f"{n:04}", f"- {name}: {count}") for n, (name, count) in enumerate((totals or {}).items())]
    heads = issues.sparkSession.createDataFrame(heads, "part int, rule string, value string")
    heads.union(rows).orderBy("part", "rule", "value").select("value").coalesce(1).write.text(path)


def write_extraction(shapes: DataFrame, words: DataFrame, page: tuple[float, float], path: str) -> None:
    """One JSON document of a page: its size, its shapes (category, kind, x0..y1, points) of at least EXTRACT_SIDE on
    both sides, and its words (text, x0..y1), in order of ``ord``. A page is one object by its format."""
    two = lambda c: F.round(c, 2)
    box = F.array(*[two(F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    kept = shapes.where(f"x1 - x0 >= {params.EXTRACT_SIDE} and y1 - y0 >= {params.EXTRACT_SIDE}")
    kept = kept.select(F.struct("ord", F.struct("category", "kind", box.alias("bbox"), F.transform("points", lambda p: F.array(two(p["x"]), two(p["y"]))).alias("points")).alias("v")).alias("r"))
    said = words.select(F.struct("ord", F.struct("text", box.alias("bbox")).alias("v")).alias("r"))
    gathered = lambda df, name: df.agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]).alias(name))
    both = gathered(kept, "shapes").crossJoin(gathered(said, "words"))
    both.select(F.to_json(F.struct(F.array(*[F.lit(float(v)) for v in page]).alias("page"), "shapes", "words")).alias("value")).coalesce(1).write.text(path)


def rewrite_document(spark: SparkSession, path: str, schema: str, change, target: str) -> None:
    """A JSON document read, changed by ``change`` (DataFrame to DataFrame) and written under a new path: what is
    read stays as it is, so a job that is run again finds its input."""
    if path.rstrip("/") == target.rstrip("/"):
        raise ValueError("the changed document goes to another path")
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    change(docs).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(target)
