import model
from conftest import as_set
from pyspark.sql import functions as F
from strandline.fixtures import Fixtures
from strandline.operators import history, versions
from strandline.operators.monitor import new_files
from strandline.sources.events import event_stream
from strandline.streaming import jobs, keyed, upkeep
from strandline.streaming import late as late_jobs
from test_graph import network, tables

SF = "/root/testdata/sf0.001"


def feed(df, path, parts, order):
    """Write rows as `parts` files in order, as if they had arrived one after the other."""
    n = df.count()
    numbered = df.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] * parts // n)).toDF([*df.columns, "_part"])
    numbered = numbered.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns], "_part")
    for i in range(parts):
        numbered.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)


def run(stream, checkpoint, mode="append", name=None, batch=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
    query = writer.foreachBatch(batch).start() if batch else writer.format("memory").queryName(name).start()
    query.awaitTermination(240)
    assert query.exception() is None


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def snapshots(spark):
    return Fixtures(spark, SF).snapshots().select("project_id", "node_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "hash")


def test_activity_and_growth(spark, tmp_path):
    ev = Fixtures(spark, SF).events().select("project_id", F.col("ts").cast("timestamp").alias("ts"), "event", "actor")
    feed(ev, str(tmp_path / "in"), 3, ["ts"])
    stream = source(spark, str(tmp_path / "in"), ev.schema).withWatermark("ts", "1 day")
    run(jobs.activity_windows(stream), tmp_path / "c1", "complete", "activity")
    got = as_set(spark.table("activity").select(F.to_date("start").alias("day"), "actor", "event", "n"), "day", "actor", "event", "n")
    assert got == as_set(history.activity_daily(ev), "day", "actor", "event", "n")
    marks = source(spark, str(tmp_path / "in"), ev.schema).withColumn("kind", F.lit("versions"))
    run(jobs.growth_stream(marks), tmp_path / "c2", "update", "growth")
    last = spark.table("growth").groupBy("project_id").agg(F.max("n").alias("n"))
    assert as_set(last, "project_id", "n") == as_set(ev.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")), "project_id", "n")


def paths_read(query):
    """Folders that any source of the stream read from."""
    return " ".join(src.description for progress in query.recentProgress for src in progress.sources)


def keyed_run(stream, checkpoint, name):
    query = (stream.writeStream.outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True)
             .format("memory").queryName(name).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return query


def test_state_changes_equal_the_batch_operator(spark, tmp_path):
    states = Fixtures(spark, SF).table("events").selectExpr(
        "'p' AS project_id", "concat('U', user_id) AS node_id", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS seq",
        "CASE event_type WHEN 'error' THEN 'missing' WHEN 'purchase' THEN 'modified' ELSE 'ok' END AS state")
    feed(states, str(tmp_path / "in"), 3, ["ts", "seq"])
    query = keyed_run(keyed.state_change_stream(source(spark, str(tmp_path / "in"), states.schema)), tmp_path / "c", "changes")
    want = history.state_changes(states, F.date_trunc("day", "ts"))
    assert as_set(spark.table("changes"), "node_id", "ts", "seq", "state") == as_set(want, "node_id", "ts", "seq", "state")
    assert sum(p["numInputRows"] for p in query.recentProgress) == states.count()  # every row is read once, nothing else is


def test_removed_artifacts_are_forgotten(spark, rows, tmp_path):
    schema = "project_id string, node_id string, t int, seq long, state string"
    when = lambda df: df.selectExpr("project_id", "node_id", "timestamp_seconds(t) AS ts", "seq", "state")
    parts = [when(rows(schema, ("p", "a", 10, 1, "missing"), ("p", "b", 10, 2, "stale"), ("p", "c", 10, 3, "ok"))),
             when(rows(schema, ("p", "a", 20, 4, None), ("p", "b", 20, 5, "stale"), ("p", "c", 1000, 6, "ok"))),
             when(rows(schema, ("p", "a", 1010, 7, "ok"), ("p", "c", 1010, 8, "missing"))),
             when(rows(schema, ("p", "b", 2000, 9, "stale"), ("p", "a", 2000, 10, "missing")))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = source(spark, str(tmp_path / "in"), parts[0].schema)
    keyed_run(keyed.state_change_stream(stream), tmp_path / "c", "kept")
    kept = {("a", 1, "missing"), ("b", 2, "stale"), ("c", 8, "missing"), ("a", 10, "missing")}
    assert as_set(spark.table("kept"), "node_id", "seq", "state") == kept
    query = keyed_run(keyed.state_change_stream(stream.withWatermark("ts", "0 seconds"), 100), tmp_path / "c2", "forgot")
    assert as_set(spark.table("forgot"), "node_id", "seq", "state") == kept | {("b", 9, "stale")}  # b was silent too long
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 12


def test_versions_equal_the_batch_operator(spark, tmp_path):
    shots = snapshots(spark)
    feed(shots, str(tmp_path / "in"), 4, ["ts", "seq"])
    stream = keyed.version_stream(source(spark, str(tmp_path / "in"), shots.schema))
    out, log = str(tmp_path / "out"), str(tmp_path / "c")
    query = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination(240)
    assert query.exception() is None
    want = versions.assign_versions(shots, F.date_trunc("day", "ts"))
    cols = ["node_id", "v", "ts", "seq", "hash"]
    assert as_set(spark.read.parquet(out), *cols) == as_set(want, *cols)
    # no micro-batch reads earlier output: the only files of a plan are those of the input
    assert str(tmp_path / "in") in paths_read(query) and out not in paths_read(query)
    assert sum(p["numInputRows"] for p in query.recentProgress) == shots.count()
    # starting again with nothing new adds nothing
    again = stream.writeStream.option("checkpointLocation", log).trigger(availableNow=True).format("parquet").start(out)
    again.awaitTermination(240)
    assert as_set(spark.read.parquet(out), *cols) == as_set(want, *cols)


def test_versions_of_odd_snapshots(spark, rows, tmp_path):
    schema = "project_id string, node_id string, ts timestamp, seq long, hash string"
    at = F.timestamp_seconds("seq")
    first = rows("project_id string, node_id string, seq long, hash string", ("p", "a", 1, None), ("p", "a", 2, None), ("q", "a", 3, "x"))
    later = rows("project_id string, node_id string, seq long, hash string", ("p", "a", 4, "x"), ("q", "a", 5, "x"), ("p", "a", 6, None))
    for part in (first, later):
        part.select("project_id", "node_id", at.alias("ts"), "seq", "hash").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keyed_run(keyed.version_stream(source(spark, str(tmp_path / "in"), schema)), tmp_path / "c", "odd")
    assert as_set(spark.table("odd"), "project_id", "v", "seq", "hash") == {("p", 1, 1, None), ("q", 1, 3, "x"), ("p", 2, 4, "x"), ("p", 3, 6, None)}


def test_new_files(spark, rows, tmp_path):
    schema = "project_id string, path string, size long, mtime long, round long"
    large = 1_700_000_000_123_456_789  # nanoseconds keep their digits
    listings = [[("p", "d/old", 1, large), ("p", "same", 1, None)], [("p", "d/old", 1, large + 1), ("p", "same", 1, None), ("p", "new", 5, 5)],
                [("p", "d/old", 1, large + 1), ("p", "new", 6, 6), ("q", "first", 1, 1)], [("p", "new", 6, 6), ("p", "same", None, None)]]
    rounds = [rows(schema, *[(*x, 0 if x[0] == "q" else n) for x in listing]) for n, listing in enumerate(listings)]
    for part in rounds:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = source(spark, str(tmp_path / "in"), rounds[0].schema)
    query = keyed_run(keyed.new_file_stream(stream), tmp_path / "c", "found")
    cols = ["round", "path", "size", "mtime", "changed_since_seen"]
    got = as_set(spark.table("found"), *cols)
    # equal to the batch operator, round by round
    want, seen = set(), {}
    for n, part in enumerate(rounds):
        known = rows("project_id string, path string, size long, mtime long", *[(*k, *v) for k, v in seen.items()])
        fresh = new_files(part, known)
        want |= as_set(fresh.where("round > 0"), *cols)
        seen |= {(r.project_id, r.path): (r.size, r.mtime) for r in part.collect()}
    assert got == want and (1, "d/old", 1, large + 1, True) in got and not any(r[1] == "first" for r in got)
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * len(seen)  # bounded by paths, not by rounds
    # a memory from before the stream
    memory = rows("project_id string, path string, size long, mtime long", ("p", "new", 5, 5), ("p", "d/old", 1, large))
    keyed_run(keyed.new_file_stream(stream.where("round > 0"), memory), tmp_path / "c2", "found_after")
    assert as_set(spark.table("found_after"), *cols) == {(1, "d/old", 1, large + 1, True), (1, "same", 1, None, False), (2, "new", 6, 6, True),
                                                         (3, "same", None, None, True)}


def test_late_rows_end_as_the_batch_operator(spark, tmp_path):
    """Snapshots in order, but for some that arrive far too late."""
    shots = snapshots(spark).where("pmod(xxhash64(node_id), 4) = 0")
    late = F.pmod(F.xxhash64("node_id", "seq"), F.lit(11)) == 0
    feed(shots.where(~late), str(tmp_path / "in"), 3, ["ts", "seq"])
    feed(shots.where(late), str(tmp_path / "in"), 2, ["ts", "seq"])
    path, by_day = str(tmp_path / "split"), F.date_trunc("day", "ts")
    split, repair = late_jobs.split_late(path), late_jobs.repair_versions(path, by_day)
    batches = []

    def both(batch, n):
        batches.append((batch.collect(), n))
        split(batch, n)
        repair(batch, n)

    run(source(spark, str(tmp_path / "in"), shots.schema), tmp_path / "c", batch=both)
    side = late_jobs.late_rows(spark, path)
    assert 0 < side.count() <= shots.where(late).count()
    assert side.count() + spark.read.parquet(f"{path}/on_time").count() == shots.count()
    keyed_run(keyed.version_stream(late_jobs.on_time_stream(spark, path, shots.schema)), tmp_path / "c2", "numbered")
    cols = ["node_id", "v", "ts", "seq", "hash"]
    want = as_set(versions.assign_versions(shots, by_day), *cols)
    right = lambda: as_set(late_jobs.corrected_versions(spark.table("numbered"), path), *cols)
    assert as_set(spark.table("numbered"), *cols) != want  # the stream alone lacks the late rows
    assert right() == want
    # a repeated micro-batch changes nothing
    again = spark.createDataFrame(batches[-1][0], shots.schema)
    split(again, batches[-1][1])
    repair(again, batches[-1][1])
    assert right() == want and side.count() == late_jobs.late_rows(spark, path).count()
    # only artifacts with late rows are numbered anew
    assert as_set(spark.read.parquet(f"{path}/repaired"), "node_id") <= as_set(side, "node_id")


def test_watermark_delay_and_missing_times(spark, rows, tmp_path):
    schema = "project_id string, node_id string, t int, seq long, hash string"
    when = lambda *x: rows(schema, *x).selectExpr("project_id", "node_id", "timestamp_seconds(t) AS ts", "seq", "hash")
    split = late_jobs.split_late(str(tmp_path / "s"), 60)
    split(when(("p", "a", 1000, 1, "x"), ("p", "a", 1, 2, "x")), 0)
    split(when(("p", "a", 940, 3, "x"), ("p", "a", 939, 4, "x"), ("p", "a", None, 5, "x"), ("p", "a", 2000, 6, "x")), 1)
    split(when(("p", "a", 1939, 7, "x")).limit(0), 2)
    split(when(("p", "a", 1939, 7, "x")), 3)
    assert as_set(late_jobs.late_rows(spark, str(tmp_path / "s")), "batch", "seq") == {(1, 4), (3, 7)}


def test_heartbeats(spark, rows, tmp_path):
    beats = rows("job_id string, t int", ("a", 0), ("b", 0), ("b", 50)).selectExpr("job_id", "timestamp_seconds(1000 + t) AS ts")
    later = rows("job_id string, t int", ("b", 100), ("c", 110)).selectExpr("job_id", "timestamp_seconds(1000 + t) AS ts")
    last = rows("job_id string, t int", ("c", 111)).selectExpr("job_id", "timestamp_seconds(1000 + t) AS ts")
    for part in (beats, later, last):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(jobs.heartbeat_timeouts(source(spark, str(tmp_path / "in"), beats.schema), 60), tmp_path / "c", "append", "quiet")
    assert as_set(spark.table("quiet").select("job_id", F.unix_seconds("last_beat").alias("t")), "job_id", "t") == {("a", 1000)}


def test_upkeep_equals_the_whole_evaluation(spark, rows, tmp_path):
    """Random saves and confirmations on networks that may hold cycles; the marks stay those of a fresh evaluation."""
    nodes, edges, rnd = network(3, 16, 34)
    placed = {e: rnd.choice([None, 1, 2]) for e in edges if e[2] == "part_of"}
    data = [x for x in nodes if nodes[x]["type"] not in model.PROCESS]
    inputs = {x: sorted(model.effective_parents(nodes, edges, x)) for x in data}
    recorded = {(x, p): nodes[p]["current"] for x in data for p in inputs[x]}

    def now():
        n, e = tables(rows, nodes, edges, placed)
        return n, e, rows("project_id string, node_id string, parent_id string, recorded int", *[("p", a, b, v) for (a, b), v in recorded.items()])

    job = upkeep.upkeep_batch(now, str(tmp_path / "u"))
    saved = "project_id string, node_id string"
    job(rows(saved, ("p", rnd.choice(data))), 0)
    for n in range(1, 4):
        touched = rnd.sample(sorted(nodes), rnd.randrange(1, 3))
        for x in touched:
            if rnd.random() < 0.6:
                nodes[x]["current"] = (nodes[x]["current"] or 0) + 1
            recorded |= {(x, p): nodes[p]["current"] for p in inputs.get(x, [])}
        job(rows(saved, *[("p", x) for x in touched]), n)
        if n == 2:
            job(rows(saved, *[("p", x) for x in touched]), n)  # repeated
        assert as_set(upkeep.stale_now(spark, str(tmp_path / "u")), "node_id") == model.stale(nodes, edges, recorded, placed)


def test_upkeep_writes_what_changes(spark, rows, tmp_path):
    """A save in a short chain writes the few rows around it, however many stale artifacts stand beside."""
    node = "project_id string, node_id string, type string, current_version int, final_version int"
    edge = "project_id string, edge_id string, source string, target string, rel string, placed_version int"
    many = [f"l{i}" for i in range(400)]
    edges = rows(edge, *[("p", f"{s}>{t}", s, t, "feeds" if t == "pl" else "derives", None)
                         for s, t in [("root", x) for x in many] + [("a", "pl"), ("pl", "b"), ("b", "c")]])
    recorded = rows("project_id string, node_id string, parent_id string, recorded int", ("p", "b", "a", 1), ("p", "c", "b", 1), *[("p", x, "root", 0) for x in many])
    version = {}
    now = lambda: (rows(node, *[("p", k, "pipeline" if k == "pl" else "result", version.get(k, 1), None) for k in (*many, "root", "a", "pl", "b", "c")]), edges, recorded)
    job, saved = upkeep.upkeep_batch(now, str(tmp_path / "u")), "project_id string, node_id string"
    job(rows(saved, ("p", "c")), 0)
    version["a"] = 2
    job(rows(saved, ("p", "a")), 1)
    assert as_set(spark.read.parquet(str(tmp_path / "u" / "changes")), "node_id", "mark") == {
        ("b", "stale"), ("c", "stale"), ("pl", "stale"), ("pl", "seed"), ("b", "seed")}
    assert as_set(upkeep.stale_now(spark, str(tmp_path / "u")), "node_id") == {"b", "c", "pl", *many}


def test_upkeep_on_a_cycle(spark, rows, tmp_path):
    """Artifacts that support each other's staleness are fresh again once nothing outside supports it."""
    node = "project_id string, node_id string, type string, current_version int, final_version int"
    edge = "project_id string, edge_id string, source string, target string, rel string, placed_version int"
    edges = rows(edge, *[("p", f"{s}{t}", s, t, "derives", None) for s, t in ("ab", "bc", "cb", "cd")])
    state = {"a": 1, "recorded": 1}
    now = lambda: (rows(node, *[("p", k, "result", state.get(k, 1), None) for k in "abcd"]), edges,
                   rows("project_id string, node_id string, parent_id string, recorded int", ("p", "b", "a", state["recorded"])))
    job, saved = upkeep.upkeep_batch(now, str(tmp_path / "u")), "project_id string, node_id string"
    stale = lambda: as_set(upkeep.stale_now(spark, str(tmp_path / "u")), "node_id")
    job(rows(saved, ("p", "a")), 0)
    assert stale() == set()
    state["a"] = 2
    job(rows(saved, ("p", "a")), 1)
    assert stale() == {"b", "c", "d"}
    state["recorded"] = 2
    job(rows(saved, ("p", "b")), 2)
    assert stale() == set()


def test_autosave(spark, rows, tmp_path):
    changes = rows("project_id string, node_id string, ts int, state string, mode string", ("p", "a", 1, "modified", "managed"), ("p", "b", 1, "modified", "ref"),
                   ("p", "c", 1, "missing", "managed"), ("p", "d", 1, "stale", "managed"))
    jobs.autosave_batch(str(tmp_path / "s"), str(tmp_path / "l"))(changes, 3)
    assert as_set(spark.read.parquet(str(tmp_path / "s")), "node_id") == {"a"}
    assert as_set(spark.read.parquet(str(tmp_path / "l")), "node_id", "event") == {("b", "modified_on_disk"), ("c", "missing_on_disk")}


def test_event_stream_reads_the_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "event": "x", "actor": "u"}\nbroken\n')
    run(event_stream(spark, str(tmp_path / "log")).select("event", "ts"), tmp_path / "c", "append", "log_events")
    assert as_set(spark.table("log_events"), "event") == {"x"}
