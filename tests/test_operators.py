"""Literal edge cases of the operators."""

from __future__ import annotations

import base64
import io
import zipfile

from pyspark.sql import functions as F

from strataframe import schemas
from strataframe.functions import numbers, strings
from strataframe.operators import collections as ops
from strataframe.operators import geometry, records, textures, usage
from strataframe.sources import files
from strataframe.streaming import events


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, bytes)) else F.lit(v))
    return df.select(expr.alias("x")).first().x


def test_cap_then_rank(spark):
    assets = spark.createDataFrame([(i, 100 if i == 20 else 5 if i % 2 else None) for i in range(21)], "ord bigint, dl bigint")
    got = [(r.ord, r["rank"]) for r in ops.with_total(assets, ops.cap_then_rank(assets, "ord", "dl", 20)).orderBy("rank").collect()]
    assert [o for o, _ in got] == [*range(1, 20, 2), *range(0, 20, 2)]  # the most downloaded is not among them
    assert ops.with_total(assets, ops.cap_then_rank(assets, "ord", "dl", 20)).first().total_count == 21


def test_exact_round(spark):
    """As Python rounds: the exact binary value, halves to even."""
    import math
    import random

    r = random.Random(3)
    values = [2.675, 0.125, 1.005, 0.375, -0.125, 2.5, 3.5, 0.0, -0.001, 1e15 + 0.5, 2.0**52 + 1, 1e300, 5e-324, float("nan"), float("inf"), float("-inf")]
    values += [r.uniform(-1e4, 1e4) for _ in range(3000)] + [r.randrange(-10**7, 10**7) / 2**r.randrange(1, 20) for _ in range(3000)] + [r.randrange(10**9) / 10**5 + r.choice([0, 5e-6]) for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    for digits in (0, 2, 4, 6):
        for row in df.select("v", numbers.exact_round(F.col("v"), digits).alias("x")).collect():
            if row.v is None or math.isnan(row.v):
                assert (row.x is None) == (row.v is None) and (row.v is None or math.isnan(row.x))
            else:
                want = row.v if math.isinf(row.v) else round(row.v, digits)
                assert row.x == want and math.copysign(1, row.x) == math.copysign(1, want), (row.v, digits)
    assert one(spark, numbers.floor_round(F.col("v"), 2), v=2.675) == 2.68
    assert one(spark, numbers.fixed(F.col("v"), 2), v=2.675) == f"{2.675:.2f}" == "2.67"


def test_fit_and_ratio(spark):
    w, h = numbers.fit_to_max(F.col("w"), F.col("h"), 800)
    assert (one(spark, w, w=1600, h=900), one(spark, h, w=1600, h=900)) == (800, 450)
    assert (one(spark, w, w=640, h=480), one(spark, h, w=640, h=480)) == (640, 480)
    ratio = lambda xs: one(spark, numbers.percent_of_max(F.array(*(F.lit(x) for x in xs)).cast("array<double>")))
    assert ratio([29.0, 100.0, 50.0]) == [28, 100, 50]  # 29 / 100 * 100 truncates
    assert ratio([0.0, 1.0, 2.0]) is None
    assert ratio([]) == []
    whole = lambda raw: one(spark, numbers.percent_of_max_json(F.lit(raw)))
    assert whole("[0, -1, 2]") == [0, -1, 2] and whole("[]") == [] and whole("[29.0, 100, 50]") == [28, 100, 50] and whole("[0.0, 1, 2]") is None
    low, high, default = schemas.SETTINGS["port"]
    assert one(spark, numbers.clamp(F.col("p"), low, high), p=80) == 1024 and low <= default <= high


def test_strings(spark):
    assert one(spark, strings.map_type(F.col("n")), n="wood_nor_gl.jpg") == "gl"
    assert one(spark, strings.ellipsis(F.col("s"), 200), s="x" * 201) == "x" * 200 + "..."
    assert one(spark, strings.ellipsis(F.col("s"), 200), s="x" * 200) == "x" * 200
    assert one(spark, strings.strip_prefix(F.col("j"), "job_"), j="job_12") == "12"
    assert one(spark, strings.strip_prefix(F.col("j"), "job_"), j="12") == "12"
    assert one(spark, strings.base64_plain(F.col("b")), b=b"y" * 200) == base64.b64encode(b"y" * 200).decode()
    assert [one(spark, strings.truthy(F.col("t")), t=t) for t in ("TRUE", "1", "Yes", "on", "0", "", " on")] == [True] * 4 + [False] * 3
    assert one(spark, strings.first_non_empty(F.lit(""), F.lit("s"), F.lit("e"))) == "s"


def test_thumbnail(spark):
    df = spark.createDataFrame([(k, i, w) for k, ws in (("a", [200, 640, 720]), ("b", [200, 1024])) for i, w in enumerate(ws)], "uid string, ord bigint, width int")
    got = {r.uid: r.width for r in ops.first_match_else_first(df, "uid", "width", "ord", F.col("width").between(400, 800)).collect()}
    assert got == {"a": 640, "b": 200}
    got = {r.uid: (r.width, r.error) for r in ops.first_match(df, "uid", "width", "ord", F.col("width") > 800).collect()}
    assert got == {"a": (None, "no match"), "b": (1024, None)}


def test_slots(spark):
    kinds = spark.createDataFrame([("Normal",), ("DISP",), ("diff",)], "k string")
    assert [r.x for r in kinds.select(textures.slot(F.col("k")).alias("x")).collect()] == ["Normal", "Displacement", None]
    strict = textures.slot(F.col("k"), textures.NORMAL_DOWNLOAD, exact_displacement=True)
    assert [r.x for r in kinds.select(strict.alias("x")).collect()] == ["Normal", None, None]


def test_packed_fallback(spark):
    df = spark.createDataFrame([("m", k) for k in ("arm", "roughness", "diffuse")], "m string, k string")
    r = textures.packed_fallback(df, "m", "k").first()
    assert (r.g_to_roughness, r.b_to_metallic, r.r_mix, r.ao_mix) == (False, True, 0.8, None)


def test_mask(spark):
    df = spark.createDataFrame(
        [(True, "p", "m", "e" * 201), (False, "p", "m", "e"), (False, "p", "m", ""), (None, "p", "m", None)],
        "consent boolean, prompt_text string, metadata string, error_message string",
    )
    got = [(r.prompt_text, r.metadata, r.error_message) for r in usage.mask(df, F.col("consent")).collect()]
    assert got == [("p", "m", "e" * 200 + "..."), (None, None, usage.MASKED_ERROR), (None, None, ""), (None, None, None)]


def test_boxes(spark):
    corners = [[float(x), float(y), float(z)] for x in (0, 1) for y in (0, 2) for z in (0, 3)]
    turn = [[0.0, -1.0, 0.0, 5.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    df = spark.createDataFrame([(0, "a", "MESH", corners, turn), (1, "b", "LIGHT", corners, turn)], "ord bigint, name string, type string, bound_box array<array<double>>, matrix_world array<array<double>>")
    a, b = geometry.object_box(df).orderBy("ord").collect()
    assert (a.min_x, a.max_x, a.min_y, a.max_y, a.min_z, a.max_z) == (3.0, 5.0, 0.0, 1.0, 0.0, 3.0)
    assert b.min_x is None
    assert one(spark, geometry.normalise_factor(F.lit(4.0), 1.0)) == 0.25 and one(spark, geometry.normalise_factor(F.lit(0.0), 1.0)) == 1.0


def test_descendants_in_preorder(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("a!", None), ("x", "y"), ("y", "x")], "id string, parent_id string")
    got = [(r.id, r.depth) for r in geometry.descendants(nodes).orderBy("path").collect()]
    assert got == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("a!", 0)]


def test_descendants_are_deep(spark):
    """No limit on levels."""
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(12)], "id string, parent_id string")
    assert geometry.descendants(nodes).agg(F.max("depth")).first()[0] == 11


def test_normalise_import(spark):
    """Two roots: each scales about its own place, so the new box isn't the old one scaled."""
    meshes = spark.createDataFrame([("i", "a", 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), ("i", "b", 6.0, 8.0, 0.0, 0.0, 0.0, 0.0)], "k string, root string, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    roots = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 6.0, 0.0, 0.0)], "root string, at_x double, at_y double, at_z double")
    r = geometry.normalise_import(meshes, roots, "k", 4.0).first()
    assert (r.factor, r.new_min_x, r.new_max_x) == (0.5, 0.0, 7.0)


def test_overlapping(spark):
    """Against all pairs; boxes of very different sizes, and of none."""
    import random

    r = random.Random(5)
    rows = []
    for i in range(120):
        low = [r.uniform(-20, 20) for _ in range(3)]
        rows.append((i, *(x for v in low for x in (v, v + r.choice([0.0, 1.0, 9.0])))))
    df = spark.createDataFrame(rows, "k int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double")
    meet = lambda a, b: all(a[j] <= b[j + 1] and b[j] <= a[j + 1] for j in (1, 3, 5))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b)}
    got = [tuple(x) for x in geometry.overlapping(df, "k").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert geometry.overlapping(df.limit(0), "k").collect() == []


def test_median_and_rank(spark):
    import statistics

    rows = [(k, float((i * 37) % 101)) for k, n in (("a", 1), ("b", 2), ("c", 501), ("d", 1000)) for i in range(n)] + [("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in ops.exact_median(df, "k", "v").collect()}
    assert got == {k: statistics.median(v for j, v in rows if j == k) for k in "abcd"}
    ranked = ops.rank_counts(spark.createDataFrame([(f"k{i:03}", i % 7) for i in range(300)], "k string, n int"), "n", "k")
    assert [r["rank"] for r in ranked.orderBy(F.desc("n"), "k").collect()] == list(range(1, 301))


def test_bounded_burst(spark):
    df = spark.createDataFrame([("x", i) for i in range(5)] + [("y", 9)], "b string, o int")
    assert {(r.b, r.o): r.taken for r in ops.bounded_burst(df, "b", "o", 3).collect()} == {("x", 0): True, ("x", 1): True, ("x", 2): True, ("x", 3): False, ("x", 4): False, ("y", 9): True}


def test_requests_and_links(spark):
    df = spark.createDataFrame([("false", 0, False, ""), ("x", 2, True, None)], "q string, n int, d boolean, c string")
    got = [r.x for r in df.select(records.request(df, ["q", "d"], ["n", "c"]).alias("x")).collect()]
    assert got == ['{"q":"false","d":false}', '{"q":"x","d":true,"n":2}']
    links = spark.createDataFrame([("a", "s"), ("b", None), ("c", "t")], "from_node string, to_socket string")
    assert sorted(r.from_node for r in records.without_links_to(links, "s").collect()) == ["b", "c"]
    nodes = spark.createDataFrame([("n",), ("m",)], "node string")
    links = spark.createDataFrame([("n", "z", "o", "p", 1), ("n", "a", "o", "p", 2)], "from_node string, from_socket string, to_node string, to_socket string, ord int")
    assert {r.node: r.connections for r in textures.connections(nodes, links).collect()} == {"n": ["z → o.p", "a → o.p"], "m": []}


def test_json(spark):
    kind = lambda x: one(spark, records.json_kind(F.lit(x).cast("string")))
    assert [kind(x) for x in ('{"a": 1}', "[]", "1", "1.5", '"s"', "true", "null", "{} {}", "1, 2", "{", "", None)] == ["object", "array", "integer", "number", "string", "boolean", "null"] + ["malformed"] * 5
    raw = '{"a": null, "b": ""}'
    assert [one(spark, records.json_default(F.lit(raw), k, "d")) for k in ("a", "b", "c")] == [None, "", "d"]


def test_paths(spark):
    inside = lambda p: one(spark, strings.inside("/extract", F.lit(p).cast("string")))
    assert [inside(p) for p in ("a", "a..b", "x/../y", "..", "../extract", "../extract-more/a", "/etc", "", None)] == [True, True, True, False, True, False, False, True, None]
    assert [one(spark, strings.suffix(F.lit(p))) for p in ("a/b.tar.gz", ".hidden", "a.b/c", "x.")] == [".gz", "", "", ""]
    assert [one(spark, strings.has_host(F.lit(u).cast("string"))) for u in ("https://a.b/c", "a.b/c", "http://", "not a url", None)] == [True, False, False, False, False]


def test_recorded():
    import asyncio

    from strataframe.functions.timing import recorded

    rows = []

    @recorded("add", rows.append, ["b", "c"])
    def add(a, b=None, c=None):
        return a + b

    async def later(a):
        raise ValueError(a)

    def broken(_):
        raise OSError

    assert add(1, 2) == 3 and recorded("quiet", broken)(lambda: 5)() == 5
    for call in (lambda: add("x", b=1), lambda: asyncio.run(recorded("later", rows.append)(later)("no"))):
        try:
            call()
        except (TypeError, ValueError):
            pass
        else:
            raise AssertionError
    assert [(r["tool_name"], r["success"], r["metadata"]) for r in rows] == [("add", True, {"b": 2}), ("add", False, {"b": 1}), ("later", False, {})]
    assert rows[2]["error_message"] == "no" and all(r["duration_ms"] >= 0 for r in rows)


def test_http_records(spark):
    """Pages over HTTP, with a header that is asked for; what can't be read is a row with an error."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from strataframe.sources import http_json

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            good = self.path != "/none" and self.headers.get("Authorization") == "Token t"
            body = {"/list": {"results": [{"name": "a", "n": 1}, None]}, "/map": {"results": {"k": {"name": "b"}}}}.get(self.path)
            self.send_response(200 if good else 404)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode() if self.path != "/broken" else b"{")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        df = http_json.http_records(spark, [f"{base}/{p}" for p in ("list", "map", "none", "broken")], "name STRING, n BIGINT", "results", http_json.authorised("t"))
        got = sorted(((r.url.rsplit("/", 1)[1], r.status, r.ord, r.key, r.name, r.n, r.error) for r in df.collect()), key=repr)
    finally:
        server.shutdown()
    assert got == [
        ("broken", None, None, None, None, None, "JSONDecodeError"), ("list", 200, 0, "0", "a", 1, None), ("list", 200, 1, "1", None, None, None),
        ("map", 200, 0, "k", "b", None, None), ("none", 404, None, None, None, None, "HTTP 404"),
    ]


def test_framing(spark, tmp_path):
    """Chunks over several triggers; what is never complete gives nothing, nor do two values in one buffer."""
    from strataframe.streaming.framing import framed

    parts = [[("a", 1, '{"x": '), ("b", 1, "[1]"), ("b", 2, "[2"), ("c", 1, "{}{}")], [("a", 2, "1}"), ("a", 3, '{"y'), ("b", 3, "]"), ("c", 2, "{}")], [("a", 4, '": 2}')]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "conn string, seq int, part string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    got = []
    for k in range(len(parts)):
        stream = spark.readStream.schema("conn string, seq int, part string").parquet(f"{tmp_path}/in/{{{','.join(map(str, range(k + 1)))},none}}")
        q = framed(stream, "conn", "seq", "part").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
        got.append(sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())))
    assert got[0] == [("b", 0, "[1]")]
    assert got[2] == [("a", 0, '{"x": 1}'), ("a", 1, '{"y": 2}'), ("b", 0, "[1]"), ("b", 1, "[2]")]


def test_node_images_and_formats(spark):
    nodes = spark.createDataFrame([("n", "i"), ("m", "none")], "node string, image string")
    images = spark.createDataFrame([(2, "i"), (1, "i")], "ord bigint, name string")
    assert [(r.node, r.image_ord) for r in textures.node_images(nodes, images).collect()] == [("n", 1)]
    files_map = F.create_map(F.lit("diff"), F.create_map(F.lit("1k"), F.create_map(F.lit("jpg"), F.lit("url"))))
    has = lambda *p: one(spark, textures.manifest_has(files_map, *map(F.lit, p)))
    assert (has("diff", "1k", "jpg"), has("diff", "2k", "jpg"), has("nor", "1k", "jpg")) == (True, False, False)


def test_archives(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("a.obj", "sub/a..b.txt", "../out.txt", "/etc/x"):
            z.writestr(name, "data")
    (tmp_path / "m.zip").write_bytes(raw.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "cut.zip").write_bytes(raw.getvalue()[:60])
    found = files.binary_files(spark, str(tmp_path), "*.zip")
    got = {r.entry: r.safe for r in files.archive_entries(found).collect() if r.entry}
    assert got == {"a.obj": True, "sub/a..b.txt": True, "../out.txt": False, "/etc/x": False}
    rows = files.archive_entries(found, extract=True).collect()
    assert {r.entry: r.data and bytes(r.data) for r in rows if r.entry} == {"a.obj": b"data", "sub/a..b.txt": b"data", "../out.txt": None, "/etc/x": None}
    assert sum(r.error is not None for r in rows) == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ord": 1, "category": "x", "n": 5}\nnot json\n')
    rows = files.json_records(spark, str(tmp_path / "a.json"), schemas.CATEGORIES).collect()
    assert [(r.category, r.n) for r in rows] == [("x", 5), (None, None)]
    table = spark.range(1).select(F.create_map(F.lit("k"), F.struct(F.lit(1).alias("a")), F.lit("j"), F.struct(F.lit(2).alias("a"))).alias("m"))
    assert [(r.ord, r.id, r.a) for r in files.map_rows(table, "m", "id").collect()] == [(0, "k", 1), (1, "j", 2)]


def test_schemas_parse(spark):
    for name in ("OBJECTS", "ASSETS", "CATEGORIES", "ASSET_FILES", "IMAGES", "NODES", "LINKS", "MODEL_RESULTS", "THUMBNAILS", "JOBS", "EVENTS", "COMMAND", "RESPONSE"):
        assert spark.createDataFrame([], getattr(schemas, name)).columns


def test_stream_counts(spark, sf_dir, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = events.masked_stream(spark, f"{tmp_path}/in", schema)
    q = events.tool_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("count")).first()[0] == spark.read.parquet(f"{tmp_path}/in").count()


def test_pushdown(spark, sf_dir):
    """The scene summary reads only what it needs and takes a top-n without a global sort."""
    from strataframe.plans import registry

    plan = registry.QUERIES["scene_summary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and " Sort [" not in plan and "p_brand" not in plan.rsplit("ReadSchema", 1)[1]
