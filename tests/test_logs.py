from pyspark.sql import functions as F

from ferrule import report
from ferrule.operators import logs, runtime, stats
from ferrule.streaming.events import EventBus


def lines(spark, *text):
    return spark.createDataFrame(list(enumerate(text)), "line_no int, line string")


GC = (
    "[7.0419s][info][gc] GC(31) Pause Remark (Metadata Threshold) 300K->260K(2G) 0.75ms",
    "[88.5s][info][gc] GC(32) Pause Full (Heap Dump()) 96M->80M(128M) 40.125ms",
    "noise",
)


def test_gc(spark):
    young, full = logs.parse_gc(lines(spark, *GC)).orderBy("gc_id").collect()
    assert (young.timestamp_ms, young.type, young.cause, young.heap_before_kb, young.heap_total_kb, young.pause_ms, young.is_full, young.reclaimed_kb) == (
        7041, "Pause Remark", "Metadata Threshold", 300, 2097152, 0.75, False, 40,
    )
    assert (full.type, full.cause, full.is_full, full.reclaimed_kb) == ("Pause Full", "Heap Dump()", True, 16384)
    s = stats.gc_stats(logs.parse_gc(lines(spark, *GC))).head()
    assert (s.total_collections, s.full_gc, s.young_gc, s.max_pause_ms) == (2, 1, 1, 40.125)
    assert stats.gc_stats(logs.parse_gc(lines(spark, "x"))).head().avg_pause_ms == 0.0


def test_memory_units(spark):
    df = spark.createDataFrame([("1M",), ("2048K",), ("1G",), ("1024B",), ("15MB",), ("2048",)], "m string")
    assert [r[0] for r in df.select(logs.memory_kb(F.col("m"))).collect()] == [1024, 2048, 1048576, 1, None, 2]


def test_safepoint_jit_inlining(spark):
    s = '[41.2507s][info][safepoint] Safepoint "ICBufferFull", Time since last: 777 ns, Reaching safepoint: 42000 ns, At safepoint: 1008000 ns, Total: 1050000 ns'
    r = logs.parse_safepoint(lines(spark, s)).head()
    assert (r.timestamp_ms, r.name, r.total_ms, r.reaching_ms) == (41250, "ICBufferFull", 1.05, 0.042)
    j = logs.parse_jit(lines(spark, " 9051   77   %s!  3   shop.Basket::total @ 8 (61 bytes)")).head()
    assert (j.timestamp_ms, j.compile_id, j.tier, j.method, j.bytecode_size, j.is_osr, j.is_synchronized, j.is_exception_handler, j.status) == (
        9051, 77, 3, "shop.Basket::total @ 8", 61, True, True, True, "NORMAL",
    )
    i = logs.parse_inlining(lines(spark, " @ 3  shop.Basket::add (44 bytes)   callee is too large")).head()
    assert (i.bytecode_index, i.inlined, i.reason) == (3, False, "callee is too large")


def test_tier_resets_on_deoptimisation(spark):
    e = spark.createDataFrame([(1, "m", 4, False), (2, "m", 4, True), (3, "k", 3, False), (4, "k", 2, False)], "seq int, method string, tier int, is_deopt boolean")
    assert {r.method: r.current_tier for r in stats.current_tier(e, "seq").collect()} == {"m": 0, "k": 3}


def test_profiles(spark):
    a = logs.parse_stacks(lines(spark, "# c", "", "main;read 100", "main;sort 200", "bad x"))
    b = logs.parse_stacks(lines(spark, "main;read 150", "main;sort 7", "main;sort 100", "new 3"))
    d = {r.stack: (r.delta, r.percent, r.kind) for r in stats.profile_diff(a, b).collect()}
    assert d == {"main;read": (50, 50.0, "regression"), "main;sort": (-100, -50.0, "optimization"), "new": (3, 100.0, "regression")}
    assert "main;read (100)" in report.flame_html(a)


def test_percentiles_interpolate(spark):
    r = stats.percentiles(spark.range(1, 101).selectExpr("id * 1000 as v"), "v").head()
    assert (r.p50, round(r.p95, 6), round(r.p99, 6)) == (50500.0, 95050.0, 99010.0)
    assert stats.percentiles(spark.range(0), "id").head().p50 == 0.0


def test_health(spark):
    m = spark.createDataFrame([(10, 1, 0, 0, 1, 10.0), (10, 150, 0, 0, 0, 0.0), (300, 1, 1, 40, 1, 600.0)], "non_heap_mb int, loaders int, hits int, misses int, collections int, max_pause_ms double")
    assert [(r.severity, r.healthy, len(r.issues)) for r in stats.health_issues(m).collect()] == [("INFO", True, 0), ("CRITICAL", False, 1), ("CRITICAL", False, 3)]


def test_nested_calls(spark):
    c = spark.createDataFrame([("t", i, k, i * 10) for i, k in enumerate(["EXIT", "ENTRY", "ENTRY", "EXIT", "EXIT"])], "thread string, at int, kind string, nanos long")
    r = stats.execution_stats(c, "thread", "at", "kind", "nanos").head()
    assert (r.executions, r.total_nanos) == (2, 40)


def test_calls_against_a_stack(spark):
    import random

    rng = random.Random(3)
    rows = [(t, i, rng.choice(["ENTRY", "EXIT"]), rng.randint(0, 1000)) for t in ("a", "b", "c") for i in range(120)] + [("d", 0, "EXIT", 1), ("e", 0, "ENTRY", 1)]
    want = {}
    for t in "abcde":
        held, n, total = [], 0, 0
        for _, _, k, x in sorted(r for r in rows if r[0] == t):
            if k == "ENTRY":
                held.append(x)
            elif held:
                n, total = n + 1, total + x - held.pop()
        want[t] = (n, total)
    c = spark.createDataFrame(rows, "thread string, at int, kind string, nanos long")
    assert {r.thread: (r.executions, r.total_nanos) for r in stats.execution_stats(c, "thread", "at", "kind", "nanos").collect()} == want


def test_lines_of_large_files_keep_their_order(spark, tmp_path):
    texts = {"a.log": [f"line {i} " + "x" * (i % 50) for i in range(3000)], "b.log": ["one", "", "three"]}
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        read = logs.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 1
        rows = sorted((r.file.rpartition("/")[2], r.line_no, r.line) for r in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == [(name, i, x) for name in sorted(texts) for i, x in enumerate(texts[name])]


def test_flame_page_shows_every_stack(spark, tmp_path):
    stacks = spark.range(2500).selectExpr("concat('s', id) as stack", "id + 1 as count")
    report.write_flame(stacks, str(tmp_path / "new" / "f.html"))
    page = (tmp_path / "new" / "f.html").read_text()
    assert page.count("<div") == 2500 and page == report.flame_html(stacks)


def test_scan_sorts_lines(spark):
    both = lines(spark, *GC, '[1.5s][info][safepoint] Safepoint "X", Time since last: 1 ns, Reaching safepoint: 2 ns, At safepoint: 3 ns, Total: 5 ns')
    gc, safe = logs.scan_gc(both)
    assert (gc.count(), [r.name for r in safe.collect()]) == (2, ["X"])


def test_settings_and_events(spark, tmp_path):
    (tmp_path / "a.properties").write_text("# own\nlogLevel = WARN\npackages: a.b\n")
    assert runtime.agent_settings(None) == {"retransform": True, "packages": "", "log_level": "INFO"}
    assert runtime.agent_settings(f"retransform=no;logLevel=DEBUG,configFile={tmp_path}/a.properties") == {"retransform": False, "packages": "a.b", "log_level": "WARN"}
    s = spark.createDataFrame([("a=1,b=2;a=3, ,c",), (None,)], "x string").select(runtime.settings(F.col("x")).alias("m")).collect()
    assert [r.m for r in s] == [{"a": "3", "b": "2", "c": ""}, {}]
    e = runtime.record(spark.createDataFrame([("r", True, 5)], "rule_name string, success boolean, duration_nanos int"), "execution").head()
    assert (e.kind, e.fields) == ("execution", '{"rule_name":"r","success":true,"duration_nanos":5,"error_message":""}')
    assert set(runtime.EVENT_KINDS) == {"execution", "compilation", "loader_created", "cache_eviction", "memory_analysis"}


def test_event_bus_isolates_listeners(spark):
    got, bus = [], EventBus()

    def broken(df, batch):
        raise ValueError

    bus.subscribe("CACHE_HIT", broken)
    bus.subscribe("CACHE_HIT", lambda df, batch: got.append(df.count()))
    bus.publish(spark.createDataFrame([("CACHE_HIT",), ("CACHE_MISS",)], "type string"))
    assert got == [1]


def test_reports():
    assert report.render("T", {"a": 1}) == "T\n" + "a".ljust(25) + " : 1"
    assert report.render("T", {"a": 'x"y'}, "csv") == '"Key","Value"\n"a","x""y"'
    assert report.render("T", {"a": 1}, "text", quiet=True) == ""
