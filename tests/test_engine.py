import datetime as dt

import pytest

from sluice.engine import Engine
from sluice.lang.diagnostics import QueryError


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    trips = [(11, "Lisbon", 12.5, "tram"), (12, "Porto", 3.0, "bus"), (13, "Lisbon", 40.0, "train"), (14, "Faro", 7.25, "bus"), (15, "Porto", 18.0, "train"), (16, "Lisbon", 2.0, "tram"), (17, None, 9.0, "ferry")]
    e.register_table("trips", spark.createDataFrame(trips, "no int, city string, km double, mode string"))
    e.register_table("fares", spark.createDataFrame([("tram", 1.5), ("bus", 2.0), ("train", 6.0), ("boat", 8.0), ("bus", 2.5)], "mode string, price double"))
    e.register_table("shifts", spark.createDataFrame([(1, "day", 8), (2, "night", 11), (3, "day", 5), (4, "day", 9), (5, "night", 2)], "slot long, crew string, hours long"))
    e.register_table("orders", spark.createDataFrame([(1, '{"item": "pear", "n": [4, 1]}'), (2, '{"item": "fig", "n": []}'), (3, None)], "no long, doc string"))
    e.register_table("log", spark.createDataFrame([("lamp on at 7 by ana",), ("lamp off at 23 by rui",), ("door open",)], "entry string"))
    e.register_table("pulses", spark.createDataFrame([(3, "p", 2), (14, "p", 5), (27, "q", 1), (8, "p", 4)], "t long, src string, amp long"))
    return e


def rows(engine, text, **params):
    return sorted((tuple(r) for r in engine.query(text, params).collect()), key=repr)


def one(engine, text):
    return engine.query("print x = " + text).first()["x"]


CASES = [
    ('trips | where mode == "tram" | summarize far = max(km), all = sum(km)', [(12.5, 14.5)]),
    ("trips | summarize c = dcountif(city, km > 5) by mode | where c > 0", [("bus", 1), ("train", 2), ("tram", 1)]),
    ("shifts | summarize s = sumif(hours, crew == 'day'), a = avgif(hours, slot > 2), n = countif(hours < 6)", [(22, 16 / 3, 2)]),
    # each stage sees what the one before it left
    ("shifts | top 3 by hours desc | where crew == 'day' | project slot", [(1,), (4,)]),
    ("shifts | sort by hours asc | take 4 | sort by hours desc | take 1 | project hours", [(9,)]),
    ("shifts | take 2 | where slot > 100 | count", [(0,)]),
    ("trips | where km between (7 .. 12.5) | project no", [(11,), (14,), (17,)]),
    ("trips | where km !between (3 .. 20) | project no", [(13,), (16,)]),
    ("trips | project-away k*, mode | where no == 12", [(12, "Porto")]),
    ("trips | project-keep m*, no | where no < 13", [(11, "tram"), (12, "bus")]),
    ("shifts | project-rename worked = hours | where worked > 10", [(2, "night", 11)]),
    # nulls
    ("trips | where isnull(city) or isempty(city) | project no", [(17,)]),
    ("trips | where city != 'Porto' | count", [(4,)]),
    ("trips | summarize n = count(), c = count(city), d = dcount(city)", [(7, 6, 3)]),
    ("orders | extend n = parse_json(doc).n | mv-expand n to typeof(long) | project no, n", [(1, 1), (1, 4), (2, None), (3, None)]),
    ("orders | where isnotnull(doc) | mv-apply x = parse_json(doc).n to typeof(long) on (summarize low = min(x), k = count()) | project no, low, k", [(1, 1, 2)]),
    ("orders | mv-apply x = parse_json(doc).n to typeof(long) on (top 1 by x asc) | project no, x", [(1, 1)]),
    ('log | parse entry with thing " " state " at " hour:long " by " who | project thing, hour, who', [("lamp", 7, "ana"), ("lamp", 23, "rui"), (None, None, None)]),
    ('log | parse-where entry with thing " " state " at " hour:long " by " who | where hour > 10 | project who', [("rui",)]),
    # bins without rows hold the default
    ("pulses | make-series a = max(amp) default = -1 on t from 0 to 30 step 10 by src | mv-expand a to typeof(long), t to typeof(long) | project src, t, a", [("p", 0, 4), ("p", 10, 5), ("p", 20, -1), ("q", 0, -1), ("q", 10, -1), ("q", 20, 1)]),
    ("union trips, shifts | summarize n = count(), k = count(km), h = sum(hours)", [(12, 7, 35)]),
    ("trips | join kind=inner (fares) on mode | where price < 2.5 | project no, price, mode1", [(11, 1.5, "tram"), (12, 2.0, "bus"), (14, 2.0, "bus"), (16, 1.5, "tram")]),
    ("trips | join kind=leftanti (fares | where price > 5) on mode | count", [(5,)]),
    ("fares | join kind=leftouter (trips | summarize n = count() by mode) on mode | where isnull(n) | project mode", [("boat",)]),
    ("trips | lookup (fares | summarize price = min(price) by mode) on mode | project no, cost = km * price | where cost > 70", [(13, 240.0), (15, 108.0)]),
    ("range k from 20 to 2 step -6", [(2,), (8,), (14,), (20,)]),
    ("datatable(name:string, when:datetime)['a', datetime(2022-03-01), 'b', datetime(2022-04-01)] | where when > datetime(2022-03-15) | project name", [("b",)]),
    ("let near = trips | where km < 8; let n = toscalar(near | count); near | where no < 13 | extend n | project no, n", [(12, 3)]),
    ("declare query_parameters(limit_km:real = 15.0); trips | where km > limit_km | count", [(2,)]),
    ("trips | where mode has_any ('TRAM', 'ferry') | count", [(3,)]),
    ("trips | where mode !has 'tra' | count", [(3,)]),
    ("trips | where mode startswith_cs 't' and mode !endswith 'M' | project no", [(13,), (15,)]),
    ("trips | where city !in~ ('LISBON', 'faro') | project no", [(12,), (15,)]),
    ("trips | where isnotnull(city) | summarize arg_min(km, no, mode) by city | project city, no, mode", [("Faro", 14, "bus"), ("Lisbon", 16, "tram"), ("Porto", 12, "bus")]),
    ("trips | summarize make_set(mode) by city | where city == 'Lisbon' | mv-expand set_mode to typeof(string) | project set_mode", [("train",), ("tram",)]),
    ("shifts | sort by slot asc | extend total = row_cumsum(hours, crew != prev(crew)) | project slot, total", [(1, 8), (2, 11), (3, 5), (4, 14), (5, 2)]),
    ("shifts | sort by hours asc | serialize next_slot = next(slot) | where hours == 8 | project slot, next_slot", [(1, 4)]),
    ("shifts | partition by crew (top 1 by hours asc) | project slot", [(3,), (5,)]),
    ("shifts | extend long = hours > 7 | evaluate pivot(crew, max(hours), long) | project long, day, night", [(False, 5, 2), (True, 9, 11)]),
    ('print d = dynamic({"w": 2.5, "v": true}) | evaluate bag_unpack(d) | project v, w', [(True, 2.5)]),
    ("shifts | scan order by slot asc declare (run:long = 0) with (step a: true => run = iff(crew == 'day', a.run + hours, 0);) | where slot >= 3 | project slot, run", [(3, 5), (4, 14), (5, 0)]),
    ("shifts | fork (where hours > 9 | project slot) (count)", [(2,)]),
    ("trips | where isnotnull(city) | sample-distinct 5 of city | count", [(3,)]),
    ('search in (trips, fares) "ferry" | project no, mode', [(17, "ferry")]),
    ('find in (trips, fares) where mode == "boat" | project source_, price', [("fares", 8.0)]),
    ("print s = 'depth: 12; wind: NE; depth: 40' | parse-kv s as (depth:long, wind:string, rain:string) with (regex=@'(\\w+): (\\w+)') | project depth, wind, rain", [(12, "NE", None)]),
    ("log | extend w = tostring(split(entry, ' ')[0]) | reduce by w | project Pattern, Count", [("door", 1), ("lamp", 2)]),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=range(len(CASES)))
def test_queries(engine, text, want):
    assert rows(engine, text) == sorted(want, key=repr)


SCALARS = [
    ("17 / 5", 3), ("17.0 / 5", 3.4), ("4 / 0", None), ("17 % 5", 2), ("-9 / 4", -2), ("12h / 30m", 24.0), ("iff(3 in (1, 2), 'in', 'out')", "out"), ("case(1 > 2, 'p', 2 > 3, 'q', 'r')", "r"),
    ("indexof('mississippi', 'ss')", 2), ("indexof('mississippi', 'k')", -1), ("substring('harbour', 3, 3)", "bou"), ("strcat('n', 7, '-', 2.5)", "n7-2.5"), ("strcmp('pear', 'fig')", 1), ("binary_xor(9, 12)", 5),
    ("binary_shift_left(5, 4)", 80), ("binary_shift_right(80, 3)", 10), ("max_of(2, 9, 4)", 9), ("min_of(2, 9, 4)", 2), ("binary_and(12, 10)", 8), ("binary_or(12, 10)", 14), ("bin(-7.25, 0.5)", -7.5), ("bin(44, 6)", 42),
    ("log2(64)", 6.0), ("toint('-31')", -31), ("toint('3a')", None), ("tolong('0x1F')", 31), ("extract('([a-z]+)=([0-9]+)', 2, 'k=42')", "42"), ("extract('q', 0, 'k=42')", None), ("countof('banana', 'an')", 2),
    ("array_length(dynamic(['u', 'v']))", 2), ("dynamic([8, 6, 4])[-2]", 6), ("tostring(dynamic({'m': {'n': [1, 7]}}).m.n[1])", "7"), ("parse_ipv4('0.0.2.1')", 513), ("ipv4_is_in_range('172.20.3.4', '172.16.0.0/12')", True),
    ("ipv4_is_in_range('172.32.0.1', '172.16.0.0/12')", False), ("ipv4_compare('9.8.7.6', '9.8.7.200', 25)", -1), ("parse_ipv6('192.168.1.1')", "0000:0000:0000:0000:0000:ffff:c0a8:0101"),
    ("parse_ipv6_mask('192.168.77.9', 16)", "0000:0000:0000:0000:0000:ffff:c0a8:0000"), ("isempty(' ')", False), ("isnotempty(' ')", True), ("tohex(4095)", "fff"),
    ("datetime_diff('minute', datetime(2023-05-01 10:30), datetime(2023-05-01 09:59:59))", 31), ("dayofweek(datetime(2023-05-06))", dt.timedelta(days=6)), ("make_datetime(2019, 12, 31)", dt.datetime(2019, 12, 31)),
    ("startofweek(datetime(2023-05-06 12:00))", dt.datetime(2023, 4, 30)), ("tostring(49h + 30m)", "2.01:30:00"), ("totimespan('00:00:07.5')", dt.timedelta(seconds=7.5)), ("format_datetime(datetime(2023-05-06 17:08:09), 'dd.MM.yyyy HH:mm')", "06.05.2023 17:08"),
    ("unixtime_seconds_todatetime(86400)", dt.datetime(1970, 1, 2)), ("round(beta_cdf(0.25, 1.0, 2.0), 4)", 0.4375), ("set_has_element(dynamic([4, 5]), 6)", False), ("jaccard_index(dynamic([1, 2, 3]), dynamic([2, 3, 4]))", 0.5),
    ("strcat_array(series_fir(dynamic([3, 0, 6]), dynamic([1, 1, 1])), ' ')", "1.0 1.0 3.0"), ("toreal(series_iir(dynamic([2, 2, 2]), dynamic([1]), dynamic([1, -1]))[2])", 6.0), ("series_sum(series_subtract(dynamic([9, 4]), dynamic([1, 1])))", 11.0),
    ("base64_decode_tostring('bGlzYm9h')", "lisboa"), ("url_encode_component('a/b?')", "a%2Fb%3F"), ("tostring(parse_url('ftp://srv.example:21/x').Host)", "srv.example"), ("hash_md5('')", "d41d8cd98f00b204e9800998ecf8427e"),
    ("replace_regex('2023-05', '([0-9]+)-([0-9]+)', '\\\\2/\\\\1')", "05/2023"), ("gettype(3)", "long"), ("not(2 > 3)", True), ("coalesce(tostring(''), 'w')", ""), ("parse_version('2.10') > parse_version('2.9.7')", True), ("trim('[xy]+', 'xyzyx')", "z"),
    ("isnan(real(nan))", True), ("real(-inf) < -1e300", True), ("extract_json('$.a', '{\"a\": 12}', typeof(long)) + 1", 13), ("tostring(bag_merge(dynamic({'p': 1}), dynamic({'q': 2, 'p': 9})))", '{"p":1,"q":2}'),
    ("array_sum(array_slice(dynamic([5, 6, 7, 8]), 2, 3))", 15.0), ("toscalar(shifts | summarize sum(hours))", 35),
]


@pytest.mark.parametrize(("text", "want"), SCALARS, ids=[s[0] for s in SCALARS])
def test_scalars(engine, text, want):
    found = one(engine, text)
    assert found == pytest.approx(want) if isinstance(want, float) else found == want


ERRORS = [
    ("trips | where colour == 'red'", "KQL001"), ("trips | extend y = frobnicate(km)", "KQL003"), ("trips | extend y = indexof()", "KQL004"), ("trips | sumarize count()", "KQL005"), ("voyages | count", "KQL008"),
    ("print geo_h3cell_level('x')", "KQL201"), ("trips | evaluate unknown_plugin(1)", "KQL201"), ("trips | join kind=diagonal (fares) on mode", "KQL006"), ("print y = cursor_current()", "KQL201"),
]


@pytest.mark.parametrize(("text", "code"), ERRORS)
def test_errors(engine, text, code):
    with pytest.raises(QueryError) as e:
        engine.query(text)
    assert e.value.code == code


def test_compat_switch(spark, engine):
    sql = Engine(spark, compat="sql")
    sql.tables = engine.tables
    assert sql.query("shifts | count").columns == ["Count_"]
    assert sql.query("shifts | summarize max(hours) by crew").columns == ["crew", "agg0"]
    assert [r["hours"] for r in sql.query("shifts | sort by hours | project hours").collect()] == [2, 5, 8, 9, 11]
    assert [r["hours"] for r in engine.query("shifts | sort by hours | project hours").collect()] == [11, 9, 8, 5, 2]
    assert sql.query("fares | project mode | union (fares | project mode)").count() == 4


def test_extension_points(spark, engine):
    from pyspark.sql import functions as F

    engine.register_scalar("doubled", lambda c: c * 2)
    engine.register_tabular("head_of", lambda df, n: df.limit(n))
    engine.register_plugin("tagged", lambda df, *a: df.withColumn("tag", F.lit("seen")))
    assert rows(engine, "print x = doubled(21)") == [(42,)]
    assert rows(engine, "trips | invoke head_of(3) | count") == [(3,)]
    assert "tag" in engine.query("trips | evaluate tagged()").columns


def test_plans_push_filters_and_prune_columns(spark):
    e = Engine(spark)
    e.register_table("orders", spark.read.parquet("/root/testdata/sf0.001/orders.parquet"))
    plan = e.explain("orders | extend y = o_totalprice * 2 | where o_orderstatus == 'F' | project o_orderkey").plan
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    assert "Python" not in plan


def test_files_and_sinks(spark, tmp_path):
    from sluice.sources import sinks

    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "c.json").write_text('[{"x": 1}, {"x": 3}]')
    e = Engine(spark)
    for n in ("a.csv", "b.jsonl", "c.json"):
        e.load_file(str(tmp_path / n), n[0])
    assert rows(e, "union a, b, c | summarize sum(x)") == [(10,)]
    assert sinks.to_csv(e.query("a | sort by x asc")) == "x,y\n1,a\n2,b\n"
    assert sinks.to_json(e.query("a | where x == 1")) == '[{"x": 1, "y": "a"}]'
    assert "y" in sinks.to_table(e.query("a"))
    assert sinks.ddl("t", [("a", "long")]) == "CREATE TABLE `t` (`a` BIGINT)"
    sinks.write(e.query("a"), str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    uri = str(tmp_path / "a.csv")
    assert rows(e, f'externaldata(x:long, y:string)["{uri}"] with (format="csv", ignoreFirstRecord=true) | count') == [(2,)]


def test_arrow_files_and_results(spark, tmp_path):
    import pyarrow as pa
    from pyarrow import feather

    for k in range(3):
        feather.write_feather(pa.table({"k": [k, k + 10], "w": [f"w{k}", None]}), str(tmp_path / f"part{k}.arrow"))
    e = Engine(spark)
    e.load_file([str(tmp_path / f"part{k}.arrow") for k in range(3)], "parts")
    assert rows(e, "parts | project k, w") == sorted([(k + 10 * j, None if j else f"w{k}") for k in range(3) for j in (0, 1)], key=repr)
    assert e.query_arrow("parts | where k > 9 | sort by k asc | project k").column("k").to_pylist() == [10, 11, 12]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n1,"two\nlines"\n2,one\n')
    e = Engine(spark)
    e.load_file(str(tmp_path / "q.csv"), "q", multiLine=True)
    assert rows(e, "q | project a, b") == [(1, "two\nlines"), (2, "one")]


def test_pairs_of_shapes(engine):
    line = lambda *p: "dynamic(" + __import__("json").dumps({"type": "LineString", "coordinates": p}) + ")"
    square = "geo_from_wkt('POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))')"
    assert one(engine, f"geo_intersects_2lines({line((0, 0), (4, 4))}, {line((0, 4), (4, 0))})") is True
    assert one(engine, f"geo_intersects_2lines({line((0, 0), (1, 1))}, {line((2, 2), (3, 3))})") is False
    assert one(engine, f"tostring(geo_intersection_2lines({line((0, 0), (4, 4))}, {line((0, 4), (4, 0))}).coordinates)") == "[2,2]"
    assert one(engine, f"geo_intersects_line_with_polygon({line((5, 5), (6, 6))}, {square})") is False
    assert one(engine, f"geo_intersects_line_with_polygon({line((3, 3), (3.5, 3.2))}, {square})") is True
    assert one(engine, f"tostring(geo_intersection_line_with_polygon({line((-1, 3), (9, 3))}, {square}).coordinates)") == "[[0,3],[4,3]]"
    # the hole cuts the line in two
    assert one(engine, f"tostring(geo_intersection_line_with_polygon({line((-1, 1.5), (9, 1.5))}, {square}).coordinates)") == "[[[0,1.5],[1,1.5]],[[2,1.5],[4,1.5]]]"
    assert one(engine, f"geo_intersects_2polygons({square}, geo_from_wkt('POLYGON ((3 3, 9 3, 9 9, 3 9, 3 3))'))") is True
    assert one(engine, f"geo_intersects_2polygons({square}, geo_from_wkt('POLYGON ((5 5, 9 5, 9 9, 5 9, 5 5))'))") is False
    assert one(engine, "tostring(geo_from_wkt('MULTIPOINT ((1 2), (3 4))').coordinates)") == "[[1,2],[3,4]]"
    assert one(engine, "tostring(geo_from_wkt('nonsense'))") in (None, "")
    area = one(engine, "geo_polygon_area(geo_point_buffer(10.0, 50.0, 1000.0, 1.0))")
    assert area == pytest.approx(3.14159e6, rel=0.01)


def test_database_addresses():
    from sluice.sources.readers import jdbc_target

    assert jdbc_target("postgres://ana:p%40ss@db.host:5433/stock") == ("jdbc:postgresql://db.host:5433/stock", {"user": "ana", "password": "p@ss"})
    assert jdbc_target("mysql://db.host/stock?useSSL=true") == ("jdbc:mysql://db.host/stock?useSSL=true", {})
    assert jdbc_target("sqlserver://h:1433/stock") == ("jdbc:sqlserver://h:1433;databaseName=stock", {})
    assert jdbc_target("sqlite:/tmp/x.db")[0] == "jdbc:sqlite:/tmp/x.db" and jdbc_target("duckdb:x.db")[0] == "jdbc:duckdb:x.db"
    assert jdbc_target("jdbc:h2:mem:x") == ("jdbc:h2:mem:x", {})
    with pytest.raises(QueryError):
        jdbc_target("gopher://x/y")


def test_command_line(spark, tmp_path):
    import io

    from sluice.cli import main

    (tmp_path / "t.csv").write_text("x\n1\n2\n")
    out = io.StringIO()
    assert main(["run", "t | summarize s = sum(x)", "-d", str(tmp_path), "-o", "csv"], spark, out) == 0
    assert out.getvalue() == "s\n3\n"
    assert main(["validate", "t | wher", "-d", str(tmp_path)], spark, io.StringIO()) == 1
    assert main(["explain", "t | count", "-d", str(tmp_path)], spark, io.StringIO()) == 0


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from sluice import streaming

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    df = streaming.open_stream(spark, str(tmp_path / "in"), source.schema, "ts")
    e = Engine(spark)
    q = streaming.run(e, "events | where event_type == 'error' | summarize n = count() by event_type", {"events": df}, "errors", str(tmp_path / "c1"), "complete", "memory")
    q.awaitTermination(120)
    assert spark.table("errors").first()["n"] == source.where("event_type = 'error'").count()
    w = streaming.tumbling(df, "ts", "1 day", [F.count(F.lit(1)).alias("n")])
    q = w.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("days").agg(F.sum("n")).first()[0] == source.count()


def test_catalogue_is_complete():
    from sluice.functions import registry

    names = registry.names()
    assert len(names) >= 433
    for n in ("series_fir", "geo_azimuth", "percentilesw", "parse_xml", "row_rank_dense", "treepath", "estimate_data_size"):
        assert registry.find(n.upper()) is not None


def test_statistics_and_policy(spark, engine):
    spark.range(10).write.mode("overwrite").saveAsTable("counted")
    engine.analyze("counted")
    assert "10 rows" in "".join(r["data_type"] or "" for r in spark.sql("DESCRIBE EXTENDED counted").collect())
    engine.policy("aggressive")
    assert spark.conf.get("spark.sql.cbo.enabled") == "true"
    engine.policy("conservative")
    assert rows(engine, "counted | where id > 7 | count") == [(2,)]
    spark.sql("DROP TABLE counted")
