import io
import json
import os
import sys
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quadrille import sinks
from quadrille.functions.grid import Cartesian
from quadrille.operators import tiling
from quadrille.plans import config, jobs
from quadrille.sources import schema as schemas
from quadrille.sources import tables
from quadrille.streaming.heat import windowed_heatmap


def test_schema():
    s = schemas.schema({"b": {"type": "double", "index": 3}, "a": {"type": "long", "index": 1}}, 6)
    assert [f.name for f in s] == ["__unspecified_0__", "a", "__unspecified_2__", "b", "__unspecified_4__", "__unspecified_5__"]
    for bad, width in (({"a": {"type": "x", "index": 0}}, None), ({"a": {"index": 0}}, None), ({"a": {"type": "int"}}, None), ({"a": {"type": "int", "index": 0}, "b": {"type": "int", "index": 0}}, None), ({"a": {"type": "int", "index": 3}}, 2)):
        with pytest.raises(ValueError):
            schemas.schema(bad, width)
    assert len(schemas.schema({}, 2)) == 2 and len(schemas.schema({})) == 0


def test_lines_of_text(spark):
    s = schemas.schema({"a": {"type": "int", "index": 0}, "b": {"type": "double", "index": 1}, "c": {"type": "string", "index": 2}})
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = tables.parse_lines(df("1, 2.5 , x", "1,2", "1,2,3,4", "z,1,y", "2,3,null", "null,1,y", None, '3,4,"a,b"', ""), s)
    assert [tuple(r) for r in got.collect()] == [(1, 2.5, "x"), (2, 3.0, None), (3, 4.0, "a,b")]
    got = tables.parse_lines(df("# no", "a;b;c", "1;2;'p;q'"), s, {"sep": ";", "quote": "'", "comment": "#", "header": True})
    assert [tuple(r) for r in got.collect()] == [(1, 2.0, "p;q")]
    with pytest.raises(ValueError):
        tables.parse_lines(df("1"), s, {"separator": ";"})


def test_hocon():
    text = """
    # a comment
    tiling { levels = [0, 1, 2], bins: 4, source = "/a b/c.csv" } // another
    tiling.more.deep = ${?NOPE}
    spark { app.name = tiles, executor { memory = 2g } }
    path = ${HOME}/x
    "quoted.key" = "a\\n\\u00e9"
    flag = yes, n = -1.5e3
    list = [
      a
      b
    ]
    tiling { extra = true }
    """
    c = config.parse(text, {"HOME": "/h"})
    assert c["tiling"] == {"levels": [0, 1, 2], "bins": 4, "source": "/a b/c.csv", "more": {}, "extra": True}
    assert c["path"] == "/h/x" and c["quoted.key"] == "a\né" and c["list"] == ["a", "b"] and c["n"] == -1500.0
    assert config.flat(c["spark"]) == {"app.name": "tiles", "executor.memory": "2g"}
    s = config.Section(c)
    assert s.truth("flag") and s.section("tiling").many(int, "levels") == [0, 1, 2] and s.whole("x", "tiling.bins") == 4 and s.text("x", default=None) is None
    for f in (lambda: s.text("x"), lambda: s.whole("path"), lambda: s.section("flag"), lambda: config.parse("a = ${B}", {}), lambda: config.parse("a = [1"), lambda: config.parse("a")):
        with pytest.raises(config.ConfigError):
            f()
    assert config.parse('{"a": {"b": 1}}') == {"a": {"b": 1}}


def test_files_merge(tmp_path):
    for name, text in (("one", "a { b = 1 }"), ("two", "a { b = 2, c = 3 }\nd = 4")):
        (tmp_path / name).write_text(text)
    assert config.load(str(tmp_path / "one"), str(tmp_path / "two"), environment={"d": "9"}) == {"a": {"b": 1, "c": 3}, "d": "9"}


POINTS = "\n".join(f"{x}\t{y}\t{v}\t{t}\t{w}" for x, y, v, t, w in [(-99.0, 40.0, 1.0, 100, "a b a"), (-99.0, 40.0, 2.0, 900, "c b"), (10.0, -20.0, 4.0, 100, "c c d"), (170.0, 80.0, 8.0, 5000, "x"), ("", 1.0, 1.0, 100, "a")])
COLUMNS = "columns { x { type = double, index = 0 }, y { type = double, index = 1 }, v { type = double, index = 2 }, t { type = long, index = 3 }, s { type = string, index = 4 } }\nsparkCsv { sep = \"\\t\" }"


def ran(spark, tmp_path, job, section, rows=POINTS, columns=COLUMNS, levels="[0, 1]", bins="bins = 4"):
    (tmp_path / "in.csv").write_text(rows)
    text = f"tiling {{ levels = {levels}, {bins}, source = {tmp_path}/in.csv }}\nfileOutput {{ dest = {tmp_path}/out, layer = l }}\n{columns}\n{section}"
    out = jobs.run(job, spark, config.parse(text, {}))
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out/l") for d, _, fs in os.walk(tmp_path / "out/l") for f in fs)
    tiles = {tuple(map(int, f[:-4].split("/"))) for f in found if f.endswith(".bin")}
    assert tiles == {tuple(r)[:3] for r in out.select("z", "tx", "ty").collect()}
    meta = {f: json.loads((tmp_path / "out/l" / f).read_text()) for f in found if f.endswith(".json")}
    return tiles, meta, tmp_path / "out/l"


def test_heatmap_job(spark, tmp_path):
    tiles, meta, folder = ran(spark, tmp_path, "xyHeatmap", "xyHeatmap { xColumn = x, yColumn = y, valueColumn = v, projection = mercator }")
    assert tiles == {(0, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)} and meta == {"metadata.json": {"bins": 4}}
    again = sinks.read_files(spark, str(tmp_path / "out"), "l")
    assert again.count() == 4 and again.where("z = 0").first()["payload"] == (folder / "00/0/0.bin").read_bytes()
    (tmp_path / "two").mkdir()
    tiles, _, _ = ran(spark, tmp_path / "two", "xyHeatmap", "xyHeatmap { xColumn = x, yColumn = y, projection = cartesian, xyBounds = [-180, -90, 180, 90] }")
    assert (1, 1, 1) in tiles


def test_time_heatmap_job(spark, tmp_path):
    tiles, meta, folder = ran(spark, tmp_path, "xyTimeHeatmap", "xyTimeHeatmap { xColumn = x, yColumn = y, timeColumn = t, min = 0, step = 500, count = 2, projection = mercator }")
    assert tiles == {(0, 0, 0), (1, 0, 1), (1, 1, 0)} and meta["metadata.json"] == {"bins": 4, "range": {"start": 0, "count": 2, "step": 500}}
    assert len((folder / "00/0/0.bin").read_bytes()) == 4 * 4 * 2 * 8


def test_topics_jobs(spark, tmp_path):
    (tmp_path / "terms").write_text("a\nc\n")
    (tmp_path / "stop").write_text("d\n")
    lists = f"terms = {tmp_path}/terms, stopWords = {tmp_path}/stop"
    tiles, meta, folder = ran(spark, tmp_path, "xyTopics", f"xyTopics {{ xColumn = x, yColumn = y, textColumn = s, projection = mercator, {lists} }}", bins="")
    assert tiles == {(0, 0, 0), (1, 0, 1), (1, 1, 0)} and meta == {"metadata.json": {}, "terms.json": ["a", "c"]}
    assert (folder / "01/1/0.bin").read_text() == '[{"binIndex": 0, "topics": {"c": 2}}]'
    tiles, meta, _ = ran(spark, tmp_path, "xyTimeTopics", f"xyTimeTopics {{ xColumn = x, yColumn = y, textColumn = s, timeColumn = t, min = 0, step = 500, count = 2, topicLimit = 2, projection = mercator, {lists} }}")
    assert meta["metadata.json"]["range"]["count"] == 2


def test_segment_job(spark, tmp_path):
    columns = 'columns { a { type = double, index = 0 }, b { type = double, index = 1 }, c { type = double, index = 2 }, d { type = double, index = 3 } }\nsparkCsv { sep = "," }'
    tiles, meta, _ = ran(spark, tmp_path, "xySegment", "xySegment { arcType = fullline, x1Column = a, y1Column = b, x2Column = c, y2Column = d, minSegLen = 4, projection = cartesian, xyBounds = [0, 0, 16, 16] }", "1,1,14,9\n2,2,2.5,2\n", columns)
    # At level 0 the longer segment has less than four bins, and the shorter one has at all levels.
    assert tiles == {(1, 0, 0), (1, 1, 0), (1, 1, 1)} and meta["metadata.json"] == {"bins": 4, "1": {"min": 1.0, "max": 1.0}}


def test_ip_jobs(spark, tmp_path):
    columns = 'columns { a { type = string, index = 0 }, b { type = string, index = 1 }, v { type = double, index = 2 } }\nsparkCsv { sep = "\\t" }'
    rows = "24.42.0.0\t24.90.0.0\t1\n\t1.2.3.4\t2\n"
    tiles, _, _ = ran(spark, tmp_path, "ipHeatmap", "ipHeatmap { ipColumn = a, valueColumn = v }", rows, columns, "[0, 1]")
    assert tiles == {(0, 0, 0), (1, 0, 0)}
    (tmp_path / "two").mkdir()
    tiles, _, _ = ran(spark, tmp_path / "two", "ipSegment", "ipSegment { arcType = fullline, ipFromColumn = a, ipToColumn = b }", rows, columns, "[4]")
    assert tiles == {(4, 4, 2)}


def test_word_jobs(spark, tmp_path):
    section = "topics { xColumn = x, yColumn = y, textColumn = s, projection = mercator }\ntf-idf { words = 2, tf = raw, idf = log, dictionary { minDF = 0.1 } }\nlda { topics = 2, wordsPerTopic = 2, topicsPerDocument = 1, maximumIterations = 2 }"
    tiles, meta, folder = ran(spark, tmp_path, "tf-idf", section)
    assert len(tiles) == 4 and meta == {} and json.loads((folder / "01/0/1.bin").read_text()).keys() == {"a", "b"}
    assert len(ran(spark, tmp_path, "lda", section)[0]) == 4


def test_wrong_configurations(spark):
    for text in ("", "tiling { levels = [0], source = x }", "tiling { levels = [0], source = x }\nfileOutput { dest = a, layer = b }\nxyHeatmap { xColumn = x, yColumn = y, projection = cartesian }", "tiling { levels = [0], source = x }\nfileOutput { dest = a, layer = b }\nxyHeatmap { xColumn = x, yColumn = y, projection = round }"):
        with pytest.raises(config.ConfigError):
            jobs.run("xyHeatmap", spark, config.parse(text, {}))


class Held:
    """A store in memory of the process."""

    kept: dict = {}

    def put(self, name, data):
        self.kept[name] = data


def test_other_stores(spark, tmp_path):
    sink = sinks.Sink(Held, "l", separator=",", suffix="", prefix="")
    sink.write_bytes("metadata.json", b"{}")
    assert Held.kept == {"l/metadata.json": b"{}"}
    files = sinks.Files(str(tmp_path))
    files.put("a/b", b"1")
    files.put("a/b", b"2")
    assert files.get("a/b") == b"2" and os.listdir(tmp_path / "a") == ["b"]
    files.delete("a/b")
    with pytest.raises(FileNotFoundError):
        files.get("a/b")
    for make in (lambda: sinks.S3("b"), lambda: sinks.HBase("h", "t")):
        with pytest.raises(RuntimeError):
            make()


def test_failures_are_raised(spark, tmp_path):
    (tmp_path / "f").write_text("")
    tiles = spark.createDataFrame([(0, 0, 0, b"1")], "z int, tx int, ty int, payload binary")
    with pytest.raises(Exception):
        sinks.files(str(tmp_path / "f"), "l").write(tiles)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0.1, 0.1, "2024-01-01 00:00:01"), (0.1, 0.1, "2024-01-01 00:00:02"), (0.9, 0.9, "2024-01-01 00:10:00")], "x double, y double, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = windowed_heatmap(stream, "x", "y", "t", Cartesian(), [0], 2, "1 minute", "1 minute")
    q = out.writeStream.outputMode("complete").format("memory").queryName("heat").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.table("heat").collect()) == [1.0, 2.0]
    assert tiling.bounds(rows, "x", "y").first()[:] == (0.1, 0.9, 0.1, 0.9)


def test_the_segment_job_computes_its_cells_once(spark, tmp_path):
    from quadrille.plans import jobs

    columns = 'columns { a { type = double, index = 0 }, b { type = double, index = 1 }, c { type = double, index = 2 }, d { type = double, index = 3 } }\nsparkCsv { sep = "," }'
    made = []
    whole = jobs.segments.segment_heatmap
    jobs.segments.segment_heatmap = lambda *a, **k: made.append(whole(*a, **k)) or made[-1]
    try:
        ran(spark, tmp_path, "xySegment", "xySegment { arcType = fullline, x1Column = a, y1Column = b, x2Column = c, y2Column = d, projection = cartesian, xyBounds = [0, 0, 16, 16] }", "1,1,14,9\n", columns)
    finally:
        jobs.segments.segment_heatmap = whole
    assert len(made) == 1 and made[0].storageLevel.useDisk


def test_clients_with_stand_ins(tmp_path, monkeypatch):
    """The libraries are not here; what is asked of them is."""
    objects, asked = {}, {}

    class Client:
        def put_object(self, Bucket, Key, Body, **extra):  # noqa: N803
            objects[Key] = {"Body": io.BytesIO(Body), **extra}

        def get_object(self, Bucket, Key):  # noqa: N803
            return objects[Key]

    monkeypatch.setitem(sys.modules, "boto3", SimpleNamespace(client=lambda *_, **__: Client()))
    for zipped in (True, False):
        store = sinks.S3("b", zipped=zipped)
        store.put("k", b"tile" * 50, "image/png")
        assert objects["k"]["ContentType"] == "image/png" and ("ContentEncoding" in objects["k"]) is zipped and store.get("k") == b"tile" * 50
    assert sinks.unzipped(sinks.zipped(b"x")) == b"x" and sinks.zipped(b"x") == sinks.zipped(b"x")

    class Connection:
        def __init__(self, **address):
            asked.update(address)

        def tables(self):
            return [b"t"]

        def table(self, name):
            return {}

    monkeypatch.setitem(sys.modules, "happybase", SimpleNamespace(Connection=Connection))
    site = tmp_path / "site.xml"
    site.write_text("<configuration><property><name>hbase.zookeeper.quorum</name><value>a.example:2181, b.example</value></property><property><name>hbase.regionserver.thrift.port</name><value>9191</value></property></configuration>")
    sinks.HBase([str(site)], "t")
    assert asked == {"host": "a.example", "port": 9191}
    (tmp_path / "more.xml").write_text("<configuration><property><name>hbase.thrift.host</name><value>c.example</value></property></configuration>")
    assert sinks.address_of([str(site), str(tmp_path / "more.xml")])["host"] == "c.example" and sinks.address_of("h") == {"host": "h"}
    with pytest.raises(ValueError):
        sinks.address_of([])
