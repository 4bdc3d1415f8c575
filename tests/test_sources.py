"""Round trips of the readers and writers."""

from pyspark.sql import functions as F

from atrium.sources import documents as d


def test_geojson_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(0, "estande", "A01", None, ("Polygon", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])), (1, "poi", None, "É", ("Point", [[(2.5, 3.5)]])), (2, "via", None, "Rua A", ("LineString", [[(0.0, 1.0), (5.0, 1.0)]]))],
        "ord int, kind string, code string, name string, geometry struct<type:string,lines:array<array<struct<x:double,y:double>>>>",
    )
    d.write_geojson(rows, str(tmp_path / "map"))
    back = d.read_geojson(spark, str(tmp_path / "map")).select(rows.columns)
    assert back.exceptAll(rows).isEmpty() and back.count() == 3
    assert '"name":' not in d.feature_json(rows).where("ord = 0").first()["value"]
    d.write_features(rows, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def test_directory_and_ring(spark, tmp_path):
    (tmp_path / "dir.json").write_text('{"expositores": {"A01": "X", "B02": "Y"}}')
    exhibitors, booths = d.read_directory(spark, str(tmp_path / "dir.json"))
    assert exhibitors.count() == 2 and booths.count() == 0
    (tmp_path / "ring.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"v"},"geometry":{"type":"Polygon","coordinates":[[[1,2],[3,4],[1,2]]]}}]}')
    assert [tuple(r) for r in d.read_ring(spark, str(tmp_path / "ring.json")).orderBy("pos").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, 1.0, 2.0)]


def test_baseline(spark, tmp_path):
    path = str(tmp_path / "base")
    assert d.read_baseline(spark, path) is None
    now = spark.createDataFrame([("a", 1.0), ("b", 0.9)], "category string, ratio double")
    assert d.regressions(now, None).isEmpty()
    d.write_baseline(now.withColumnRenamed("ratio", "value"), path)
    worse = spark.createDataFrame([("a", 0.97), ("b", 0.895)], "category string, ratio double")
    assert [r["category"] for r in d.regressions(worse, d.read_baseline(spark, path)).collect()] == ["a"]


def test_grid_and_itinerary(spark, tmp_path):
    from atrium.operators.grid import pack_bits, unpack_bits

    cells = spark.range(5 * 3).selectExpr("0L as venue", "cast(id % 5 as int) as i", "cast(id div 5 as int) as j", "id % 3 <> 0 as free")
    d.write_grid(pack_bits(cells, 5), 5, 3, 0.5, str(tmp_path / "grid"))
    back = unpack_bits(d.read_grid(spark, str(tmp_path / "grid")), 5, 3)
    assert back.exceptAll(cells).isEmpty()
    stops = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 2, 0), (1, 0, 0, 0)], "itin int, pos int, i int, j int").withColumn("venue", F.lit(0).cast("long"))
    d.save_itinerary(stops, str(tmp_path / "stops"))
    assert [r["itin"] for r in d.restore_itinerary(spark, str(tmp_path / "stops"), cells).collect()] == [0]


def test_manifest_and_report(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    one = d.manifest(spark, str(tmp_path)).first()
    (tmp_path / "b").write_text("c")
    two = d.manifest(spark, str(tmp_path)).first()
    assert one["files"] == two["files"] == 2 and one["version"] != two["version"] and len(one["version"]) == 12
    issues = spark.createDataFrame([("warning", "V4", "x"), ("pending", "V1", "y")], "severity string, rule string, msg string")
    d.write_report(issues, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["## Pending", "- **V1** y", "## Warnings", "- **V4** x"]


def test_multipolygons_and_positions_of_every_kind(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"kind":"area"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]],[[2,2],[3,2],[2,2]]],[[[5,5],[6,5],[5,5]]]]}},{"type":"Feature","properties":{"kind":"via"},"geometry":{"type":"MultiLineString","coordinates":[[[0,1],[2,1]],[[3,1],[4,1]]]}}]}')
    rows = {r["kind"]: [[(p["x"], p["y"]) for p in line] for line in r["geometry"]["lines"]] for r in d.read_geojson(spark, str(tmp_path / "map.json")).collect()}
    assert rows == {"area": [[(0, 0), (1, 0), (1, 1), (0, 0)], [(2, 2), (3, 2), (2, 2)], [(5, 5), (6, 5), (5, 5)]], "via": [[(0, 1), (2, 1)], [(3, 1), (4, 1)]]}


def test_rings_by_name(spark, tmp_path):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(0, "predio", "7", ("Polygon", [square])), (1, "predio", "8", ("Polygon", [square[:3]]))], "ord int, kind string, name string, geometry struct<type:string,lines:array<array<struct<x:double,y:double>>>>")
    d.write_geojson(rows, str(tmp_path / "rings"))
    assert {r["name"]: [(p["x"], p["y"]) for p in r["ring"]] for r in d.read_rings(spark, str(tmp_path / "rings")).collect()} == {"7": square[:3], "8": square[:3]}


def test_grid_document_holds_access_doors_and_the_frame(spark, tmp_path):
    from types import SimpleNamespace

    from atrium.operators.grid import pack_bits

    cells = spark.range(4 * 4).selectExpr("3L as venue", "cast(id % 4 as int) as i", "cast(id div 4 as int) as j", "true as free")
    access = spark.createDataFrame([(3, 5, "A01", 1, 2), (3, 4, "A01", 3, 3), (3, 6, "B02", None, None), (3, 7, "C03", 0, 0)], "venue long, ord long, name string, i int, j int")
    doors = spark.createDataFrame([(3, "North", 2, 3), (3, "North", 1, 3), (3, "South", 0, 0)], "venue long, name string, i int, j int")
    frame = SimpleNamespace(origin=(-46.65, -23.5), ex=(1e-6, 2.1234567891e-7), ey=(-2e-7, 1e-6))
    d.write_grid(pack_bits(cells, 4), 4, 4, 0.5, str(tmp_path / "grid"), frame, access, doors)
    row = d.read_grid(spark, str(tmp_path / "grid")).first()
    assert row["acessos"] == {"A01": [3, 3], "C03": [0, 0]} and row["portas"] == {"North": [[1, 3], [2, 3]], "South": [[0, 0]]}
    assert (row["origem"], row["ex"], row["ey"], row["w"], row["h"], row["step"]) == ([-46.65, -23.5], [1e-6, 2.12e-7], [-2e-7, 1e-6], 4, 4, 0.5)


def test_acceptance_gates_the_drift_and_takes_a_new_baseline(spark, tmp_path):
    path = str(tmp_path / "base")
    figures = lambda ratio, drift: spark.createDataFrame([("a", ratio, drift), ("b", 0.9, 1.0)], "category string, ratio double, drift_cm double")
    assert d.acceptance(spark, figures(0.5, 9.0), path).isEmpty()  # no baseline, nothing to fall behind
    assert d.acceptance(spark, figures(1.0, 2.0), path, accept=True).isEmpty()
    assert d.acceptance(spark, figures(0.991, 2.9), path).isEmpty()
    assert [r["category"] for r in d.acceptance(spark, figures(1.0, 3.1), path).collect()] == [d.DRIFT]
    assert sorted(r["category"] for r in d.acceptance(spark, figures(0.98, 9.0), path).collect()) == [d.DRIFT, "a"]


def test_extraction_keeps_large_shapes_in_order(spark, tmp_path):
    import json

    shapes = spark.createDataFrame([(2, "stand", "rect", 0.0, 0.0, 9.127, 5.0, [(0.0, 0.0), (9.127, 5.0)]), (1, "area", "poly", 1.0, 1.0, 8.0, 8.0, [(1.0, 1.0)]), (3, "speck", "rect", 0.0, 0.0, 3.9, 50.0, [])], "ord long, category string, kind string, x0 double, y0 double, x1 double, y1 double, points array<struct<x:double,y:double>>")
    words = spark.createDataFrame([(9, "last", 0.0, 0.0, 1.0, 1.0), (5, "first é\"", 0.004, 0.0, 1.0, 1.0)], "ord long, text string, x0 double, y0 double, x1 double, y1 double")
    d.write_extraction(shapes, words, (100.0, 50.0), str(tmp_path / "page"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "page")).collect()]
    page = json.loads(text[0])
    assert len(text) == 1 and page["page"] == [100.0, 50.0]
    assert [(s["category"], s["bbox"], s["points"]) for s in page["shapes"]] == [("area", [1.0, 1.0, 8.0, 8.0], [[1.0, 1.0]]), ("stand", [0.0, 0.0, 9.13, 5.0], [[0.0, 0.0], [9.13, 5.0]])]
    assert [(w["text"], w["bbox"][0]) for w in page["words"]] == [("first é\"", 0.0), ("last", 0.0)]


def test_a_rewritten_document_leaves_its_source(spark, tmp_path):
    import json

    import pytest

    source, target = tmp_path / "in.json", str(tmp_path / "out")
    source.write_text('{"name": "x",\n "n": 1}')
    d.rewrite_document(spark, str(source), "name string, n long", lambda rows: rows.withColumn("n", F.col("n") + 1), target)
    assert json.loads(spark.read.text(target).first()["value"]) == {"name": "x", "n": 2} and json.loads(source.read_text())["n"] == 1
    with pytest.raises(ValueError):
        d.rewrite_document(spark, str(source), "name string", lambda rows: rows, str(source))


def test_report_totals_come_first(spark, tmp_path):
    issues = spark.createDataFrame([("warning", "V4", "x")], "severity string, rule string, msg string")
    d.write_report(issues, str(tmp_path / "out"), {"stands": 3, "areas": 1})
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["- stands: 3", "- areas: 1", "## Pending", "## Warnings", "- **V4** x"]
