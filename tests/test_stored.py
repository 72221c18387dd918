"""The stored log, incremental ingest and streams with state."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tracework.functions import ids
from tracework.operators import stats, timetravel
from tracework.sources import factlog
from tracework.streaming import streams

LOG = "e string, a string, v string, tx long, op string"


def random_log(n, seed):
    rng = random.Random(seed)
    return [(f"e{rng.randrange(6)}", rng.choice(["name", "tag"]), rng.choice("uvw"), rng.randrange(1, 60), rng.choice(["add", "add", "retract"])) for _ in range(n)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2])
def test_validity_equals_reads_of_the_log(spark, seed):
    log = spark.createDataFrame(random_log(250, seed) + [("e0", "name", None, 3, "add"), (None, "name", "u", 3, "add")], LOG)
    valid = factlog.validity(log, ("tag",)).cache()
    assert valid.where("valid_to is not null and valid_to <= valid_from").count() == 0
    for tx in (0, 1, 5, 17, 30, 59, 100):
        want = timetravel.as_of(log.where("e is not null and v is not null"), tx, ("tag",))
        assert sorted(map(tuple, factlog.at(valid, tx).collect())) == sorted(map(tuple, want.collect())), tx
    now = timetravel.as_of(log.where("e is not null and v is not null"), None, ("tag",))
    assert sorted(map(tuple, factlog.at(valid).collect())) == sorted(map(tuple, now.collect()))
    # Many points at once, by blocks of several sizes.
    pairs = spark.createDataFrame([(f"e{i}", t, i * 100 + t) for i in range(7) for t in range(0, 64, 3)], "e string, tx long, pair long")
    want = {(e, tx, a, v, s) for tx in range(0, 64, 3) for e, a, v, s in map(tuple, factlog.at(valid, tx).collect())}
    for width in (1, 4, 1000):
        got = factlog.at_pairs(valid, pairs, width)
        assert got.columns == ["e", "tx", "pair", "a", "v", "since"]
        rows = [(r.e, r.tx, r.a, r.v, r.since) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want, width
    assert factlog.at_pairs(valid, pairs.where("false")).count() == 0


def test_stored_log_reads_few_folders(spark, tmp_path):
    rows = random_log(300, 4)
    log = spark.createDataFrame(rows, LOG)
    store, valid = str(tmp_path / "log"), str(tmp_path / "valid")
    factlog.write_log(log.where("tx <= 30"), store, 10)
    factlog.write_log(log.where("tx > 30"), store, 10)
    assert sorted(map(tuple, factlog.read_log(spark, store, width=10).collect())) == sorted(rows)
    some = factlog.read_log(spark, store, 15, ("name",), width=10)
    assert sorted(map(tuple, some.collect())) == sorted(r for r in rows if r[3] <= 15 and r[1] == "name")
    assert "PartitionFilters: [isnotnull(a" in plan_of(some) or "PartitionFilters: [isnotnull(tx_range" in plan_of(some)
    assert all("a=name" in f and int(f.split("tx_range=")[1].split("/")[0]) <= 1 for f in _read_files(some))
    late = factlog.read_log(spark, store, after=44, width=10)
    assert sorted(map(tuple, late.collect())) == sorted(r for r in rows if r[3] > 44)
    factlog.write_validity(factlog.validity(log), valid, 10)
    then = factlog.at(factlog.read_validity(spark, valid, 15, ("name",), 10), 15)
    assert sorted(map(tuple, then.collect())) == sorted(map(tuple, timetravel.as_of(log.where("a = 'name'"), 15).collect()))
    assert all("a=name" in f and int(f.split("from_range=")[1].split("/")[0]) <= 1 for f in _read_files(then))


def _read_files(df):
    """Files that rows come from, which leaves out folders that were pruned."""
    df.collect()
    scan = df.select("*", F.input_file_name().alias("f"))
    return {r.f for r in scan.select("f").distinct().collect() if r.f}


def test_ingest_reads_the_state_of_its_own_entities(spark, tmp_path):
    from tracework.streaming.ingest import Ingest

    into = Ingest(spark, str(tmp_path / "log"), parts=4, many=("tag",))
    rng = random.Random(8)
    every, log = [], spark.createDataFrame([], LOG)
    for number in range(7):
        batch = [(f"e{rng.randrange(20)}", rng.choice(["name", "tag"]), rng.choice("uvwx"), rng.choice(["add", "add", "add", "retract"])) for _ in range(60)]
        if number == 4:
            batch += [("e3", None, None, "retract-entity"), (None, "name", "u", "add")]
        changes = spark.createDataFrame(batch, "e string, a string, v string, op string")
        facts = timetravel.apply_changes(log, changes.where("e is not null"), number + 1, ("tag",)).collect()
        every += [tuple(f) for f in facts]
        log = spark.createDataFrame(every, LOG)
        into.step(changes, number)
        if number == 5:
            into.step(changes, number)  # done again after a failure
    stored = spark.read.schema(LOG).parquet(str(tmp_path / "log")).drop("batch")
    assert sorted(map(tuple, stored.collect())) == sorted(every)
    want = timetravel.as_of(log, None, ("tag",))
    assert sorted(tuple(r)[:3] for r in into.state().collect()) == sorted(tuple(r)[:3] for r in want.collect())
    assert max(into.bytes_read[6], into.bytes_read[3]) < 1.6 * min(into.bytes_read[6], into.bytes_read[3])  # the log has grown, what is read has not
    for part in range(4):
        assert len(into._versions(part)) <= 2
    one = spark.createDataFrame([("e1", "name", "last", "add")], "e string, a string, v string, op string")
    into.step(one, 7)
    assert 0 < into.bytes_read[7] < into.bytes_read[6]  # one entity: one part


def _stream(spark, folder, batches):
    for k, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(folder / f"{k}"))
        for f in (folder / f"{k}").glob("part-*"):
            f.rename(folder / f"{k}-{f.name}")
            os.utime(folder / f"{k}-{f.name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder) + "/*.parquet")


def _drained(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name), q


def _state_rows(query):
    return [sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in query.recentProgress]


def test_streamed_limiter_is_the_batch_limiter(spark, tmp_path):
    own, t0 = streams.with_state_store(spark), dt.datetime(2024, 1, 1)
    shape = "key string, ts timestamp, id long"
    rows = [("k" if i % 3 else "j", t0 + dt.timedelta(seconds=7 * i), i) for i in range(60)]
    batches = [own.createDataFrame(rows[k : k + 20], shape) for k in (0, 20, 40)] + [own.createDataFrame([("z", t0 + dt.timedelta(hours=h), 1000 + h)], shape) for h in (3, 6)]
    skip = F.col("id") % 5 == 0
    out, query = _drained(streams.limit_stream(_stream(own, tmp_path, batches), 2, 60.0, skip=skip), "limited")
    got = {(r.id, r.allowed, r.remaining) for r in out.collect() if r.id < 1000}
    want = {(r.id, r.allowed, r.remaining) for r in streams.limit_requests(spark.createDataFrame(rows, shape), 2, 60.0, skip).collect()}
    assert got == want and len(got) == 60 and any(r[2] is None for r in got)
    waits = [r for r in out.collect() if not r.allowed]
    assert waits and all(0 <= r.retry_s <= 60 and r.reset >= r.ts for r in waits)
    assert _state_rows(query)[-1] <= 3  # windows of j and k are gone, only the last key has its value and timer
    key = spark.createDataFrame([(None, "1.2.3.4, 5.6.7.8", "9.9.9.9", "/a"), ("u", None, None, "/a"), (None, " ", None, "/b")], "u string, x string, a string, p string")
    assert [r.k for r in key.select(streams.client_key(*map(F.col, "uxap")).alias("k")).collect()] == ["1.2.3.4:/a", "u:/a", "unknown:/b"]


def test_streamed_votes(spark, tmp_path):
    own, t0 = streams.with_state_store(spark), dt.datetime(2024, 1, 1)
    shape = "proposal_id long, voter_id long, vote string, ts timestamp"
    at = lambda p, v, vote, s: (p, v, vote, t0 + dt.timedelta(seconds=s))
    batches = [
        [at(1, 1, "APPROVE", 0), at(2, 1, "APPROVE", 0), at(3, 1, "APPROVE", 1)],
        [at(1, 2, "APPROVE", 2), at(2, 1, "REJECT", 2), at(2, 2, "REJECT", 3), at(1, 3, "REJECT", 4)],
        [at(9, 1, "ABSTAIN", 500)],
        [at(9, 2, "ABSTAIN", 501), at(1, 4, "REJECT", 501)],
        [at(10, 2, "ABSTAIN", 2000)],
        [at(10, 3, "ABSTAIN", 2001)],
    ]
    out, query = _drained(streams.tally_stream(_stream(own, tmp_path, [own.createDataFrame(b, shape) for b in batches]), 2, 5.0, "1 second"), "tallied")
    got = {(r.proposal_id, r.decision, r.approve, r.reject, r.total) for r in out.collect()}
    assert got == {(1, "approved", 2, 1, 3), (2, "rejected", 0, 2, 2), (3, "timeout", 1, 0, 1), (9, "timeout", 0, 0, 2)}
    assert _state_rows(query)[-1] <= 5  # what is left belongs to the last proposal


def test_streamed_histograms(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    shape = "ts timestamp, path string, code int, x double"
    rng = random.Random(3)
    rows = [(t0 + dt.timedelta(seconds=20 * i), rng.choice("ab"), rng.choice([200, None]), rng.choice([0.5, 1.0, 3.0, 7.0, 70.0, None])) for i in range(60)]
    batches = [rows[k : k + 20] for k in (0, 20, 40)] + [[(t0 + dt.timedelta(hours=2), "c", 1, 1.0)], [(t0, "a", 200, 1.0)] * 3]
    frames = [spark.createDataFrame(b, shape) for b in batches]
    bounds = [1.0, 5.0, 10.0]
    out, query = _drained(streams.windowed_histogram(_stream(spark, tmp_path, frames), "ts", ["path", "code"], "x", bounds), "histograms", "update")
    assert streams.late_rows(query, out) == 3
    got = {r.labels: tuple(r) for r in streams.merged_histograms(out).drop("n").collect()}
    table = spark.createDataFrame(rows + batches[3], shape)
    want = stats.histogram(table.withColumn("labels", streams.label_key(["path", "code"])), "labels", "x", bounds).collect()
    assert got == {r.labels: tuple(0.0 if v is None else v for v in r) for r in want} and 'code="200",path="a"' in got and 'path="b"' in got


def test_id_index_is_pruned(spark, tmp_path):
    from tracework.functions.ids import uuid3
    from tracework.sources import idindex

    rows = spark.range(3000).select(uuid3(F.concat(F.lit("part/"), F.col("id").cast("string"))).alias("id"), F.lit("part").alias("kind"), F.col("id").alias("key"))
    idindex.write_id_index(rows, str(tmp_path / "index"))
    some = [r.id for r in rows.where("key in (5, 77, 2999)").collect()]
    found = idindex.find_ids(spark, str(tmp_path / "index"), [*some, "no such id"])
    assert sorted(r.key for r in found.collect()) == [5, 77, 2999]
    plan = plan_of(found)
    assert "PartitionFilters: [head#" in plan.replace("isnotnull(", "") or "head#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "In(id" in plan.split("PushedFilters")[1].split("\n")[0]
    assert len(_read_files(found)) <= 3
    asked = spark.createDataFrame([(i,) for i in some * 2], "x string")
    assert sorted(r.key for r in idindex.find_many(spark, str(tmp_path / "index"), asked).collect()) == [5, 77, 2999]


def test_patterns_in_groups_stars_and_parts(spark):
    from tracework.operators.match import Query

    rows = [("a", "name", "A"), ("a", "type", "t"), ("a", "made", "m"), ("m", "by", "x"), ("m", "by", "y"), ("b", "name", "B"), ("b", "type", "t"), ("b", "made", "n"), ("c", "name", "C"), ("q", "knows", "q")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    run = lambda q: sorted((tuple(r) for r in q.execute(t).collect()), key=str)
    group = Query().find("?e", "?m", "?x").where(("?e", "name", "?n")).optional(("?e", "made", "?m"), ("?m", "by", "?x"))
    assert run(group) == [("a", "m", "x"), ("a", "m", "y"), ("b", None, None), ("c", None, None)]
    apart = Query().find("?e", "?m", "?x").where(("?e", "name", "?n")).optional(("?e", "made", "?m")).optional(("?m", "by", "?x"))
    assert run(apart) == [("a", "m", "x"), ("a", "m", "y"), ("b", "n", None), ("c", None, None)]
    star = Query().single("name", "type", "made").find("?e", "?n", "?m").where(("?e", "name", "?n"), ("?e", "type", "t"), ("?e", "made", "?m"))
    assert run(star) == [("a", "A", "m"), ("b", "B", "n")]
    assert plan_of(star.execute(t, counted=False)).count("Exchange hashpartitioning") == 1  # three patterns, one exchange
    assert run(Query().find("?e", "?n").where(("?e", "name", "?n"), ("?e", "type", "?t"))) == [("a", "A"), ("b", "B")]
    there = Query().find("?n").where(("?e", "name", "?n"), ("?z", "knows", "?z"))
    assert run(there.distinct()) == [("A",), ("B",), ("C",)]
    assert run(Query().find("?n").where(("?e", "name", "?n"), ("?z", "hates", "?z")).distinct()) == []
    both = Query().find("?n", "?x").where(("?e", "name", "?n"), ("?m", "by", "?x"))
    assert len(run(both)) == 6  # all combinations are what is asked for
    with pytest.raises(ValueError):
        Query().where(("?e", "name", "?n")).optional(("?z", "by", "?x")).execute(t)


def test_imports_and_registry_are_kept(spark, tmp_path):
    from tracework.sources import files

    shape = ("entity struct<entity_id:string,entity_type:string,batch:string,product_name:string,was_generated_by:string>, "
             "activities array<struct<activity_id:string,activity_type:string,started_at:timestamp,ended_at:timestamp>>, agents array<struct<agent_id:string,agent_name:string,agent_type:string>>")  # fmt: skip
    bundle = lambda k, batch: ((k, "t", batch, "n", None), [("a" + k, "made", None, None)], [("g", "G", "org")])
    one, two = spark.createDataFrame([bundle("x", "b1"), bundle("y", "b1")], shape), spark.createDataFrame([bundle("y", "b2")], shape)
    path = str(tmp_path / "kept")
    for rows, name in ((one, "1"), (one, "1"), (two, "2"), (one, "1")):
        files.import_bundles(rows, path, name)
    got = files.imported(spark, path)
    assert {(r.entity_id, r.batch) for r in got["entities"].collect()} == {("x", "b1"), ("y", "b2")}
    assert got["activities"].count() == 2 and got["agents"].count() == 1
    assert spark.read.parquet(f"{path}/entities").count() == 3
    columns = "name string, namespace string, format string, version string, loaded_at timestamp"
    entry = lambda n, v, day: (n, "urn:" + n, "ttl", v, dt.datetime(2024, 1, day))
    at = str(tmp_path / "registry")
    for rows in ([entry("p", "1", 1), entry("q", "1", 1)], [entry("p", "2", 2)], [entry("r", "1", 3)]):
        files.store_registry(spark.createDataFrame(rows, columns), at)
    assert {(r.name, r.version) for r in files.stored_registry(spark, at).collect()} == {("p", "2"), ("q", "1"), ("r", "1")}
    assert len(list((tmp_path / "registry").glob("registry_version=*"))) == 2


def test_recall_files_of_all_forms(spark, tmp_path):
    import json

    from tracework.sources import files

    rec = lambda k: {"recall_number": f"F-{k}", "event_id": "1", "recalling_firm": 'a "firm" {x}', "openfda": {}}
    (tmp_path / "lines.json").write_text("".join(json.dumps(rec(k)) + "\n" for k in range(20)))
    (tmp_path / "pretty.json").write_text(json.dumps({"meta": {"results": {"total": 2}, "note": "x"}, "results": [rec(20), rec(21)]}, indent=2))
    (tmp_path / "records.json").write_text(json.dumps({"records": [rec(22)], "results": [rec(99)]}))
    (tmp_path / "array.json").write_text(json.dumps([rec(23), rec(24)]))
    (tmp_path / "other.json").write_text("not json\n")
    got = sorted(int(r.recall_number[2:]) for r in files.read_recalls(spark, str(tmp_path)).collect())
    assert got == list(range(25))
    assert files.read_recalls(spark, str(tmp_path), 3).count() == 3


def test_one_large_turtle_file_is_read_in_splits(spark, tmp_path):
    from tracework.sources import turtle

    lines = ["@prefix ex: <http://x/> ."]
    for k in range(400):
        lines += [f"ex:n{k} a prov:Entity ;", *(f'  ex:p{i} "v{k}-{i}" ;' for i in range(k % 7)), "  ex:last 1 . # end", ""]
    (tmp_path / "big.ttl").write_text("\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        got = sorted((r.s, r.p, r.o) for r in turtle.read_turtle(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(f"http://x/n{k}", turtle.TYPE, turtle.PREFIXES["prov"] + "Entity") for k in range(400)] + [(f"http://x/n{k}", "http://x/last", "1") for k in range(400)]
    want += [(f"http://x/n{k}", f"http://x/p{i}", f"v{k}-{i}") for k in range(400) for i in range(k % 7)]
    assert got == sorted(want)


def test_turtle_lines_that_stand_alone_are_not_shuffled(spark, tmp_path):
    from tracework.sources import turtle

    null = "cast(null as string)"
    made = spark.range(0, 300, 1, 7).selectExpr("concat('http://x/n', id) as s", "'http://x/p' as p", "concat('v \"', id) as o", "'literal' as o_kind", f"{null} as datatype", f"{null} as lang")
    turtle.write_turtle(made, str(tmp_path / "t"), {"ex": "http://x/"})
    files = [r.value for r in spark.read.text(str(tmp_path / "t"), wholetext=True).collect()]
    assert len(files) == 7 and all(f.startswith("@prefix ex: <http://x/> .\nex:n") and f.count("@prefix") == 1 for f in files)
    back = turtle.read_turtle(spark, str(tmp_path / "t"))
    assert sorted((r.s, r.p, r.o) for r in back.collect()) == sorted((f"http://x/n{k}", "http://x/p", f'v "{k}') for k in range(300))
    assert "rangepartitioning" not in back._jdf.queryExecution().toString().lower()


def test_turtle_that_stands_alone_is_parsed_without_a_shuffle(spark, tmp_path):
    """A quote that is escaped ends no literal, and what follows it names no type."""
    from tracework.sources import turtle

    null = "cast(null as string)"
    values = "array('q\"^^xsd:int', 'a # b', '', 'c\\\\', concat('m', char(1), 'n'))"
    made = spark.range(0, 5, 1, 2).selectExpr("concat('http://x/n', id) as s", "'http://x/p' as p", f"{values}[cast(id as int)] as o", "'literal' as o_kind", f"{null} as datatype", "if(id = 0, null, 'en') as lang")
    turtle.write_turtle(made, str(tmp_path / "t"), {"ex": "http://x/"})
    back = turtle.read_turtle(spark, str(tmp_path / "t"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan and plan.count("FileScan text") == 1
    columns = ["s", "p", "o", "o_kind", "datatype", "lang"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, made.collect()))
    (tmp_path / "t" / "more.ttl").write_text("@prefix e: <http://e/> .\ne:a a e:b ;\n e:c 1 ;\n <d> e:f .\n")
    more = {tuple(r) for r in turtle.read_turtle(spark, str(tmp_path / "t")).select("s", "p", "o").collect()}
    assert {r for r in more if r[0] == "http://e/a"} == {("http://e/a", turtle.TYPE, "http://e/b"), ("http://e/a", "http://e/c", "1"), ("http://e/a", "d", "http://e/f")} and len(more) == 8


def test_keys_are_found_by_whole_identifiers(spark):
    names = [f"part/{k}" for k in range(300)] + [None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    wanted = [ids.uuid3_of(n) for n in ("part/7", "part/250", "")]
    alike = wanted[0][:-1] + ("0" if wanted[0][-1] != "0" else "1")  # the same first digits, another identifier
    found = lambda some: {r.name for r in df.where(ids.uuid3_among(F.col("name"), some)).collect()}
    assert found([*wanted, "no identifier", alike]) == {"part/7", "part/250", ""}
    assert found([alike]) == set() and found([]) == set()


def test_a_longer_log_has_wider_ranges_not_more_of_them(spark, tmp_path):
    counts = []
    for n in (4_000, 400_000):
        log = spark.range(n).selectExpr("cast(id % 50 as string) as e", "'x' as a", "cast(id as string) as v", "id as tx", "'add' as op")
        width, path = factlog.fit_width(log, 1000), str(tmp_path / str(n))
        factlog.write_log(log, path, width)
        counts.append(spark.read.parquet(path).selectExpr("input_file_name() as f").distinct().count())
        assert factlog.read_log(spark, path, 3_500, after=1_500, width=width).count() == 2_000
    assert factlog.fit_width(log.where("false"), 1000) == 1000
    assert counts[1] <= factlog.RANGES * factlog.PARTS and counts[0] <= 4 * factlog.PARTS


def test_pairs_and_pieces_are_not_sent_to_the_driver(spark):
    """Both sides of the join are made many times larger than their files let expect."""
    valid = spark.createDataFrame([("e", "a", "v", 5, None)], factlog.VALID)
    got = factlog.at_pairs(valid, spark.createDataFrame([("e", 7, "x"), ("e", 3, "y")], "e string, tx long, k string"), 1)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("e", 7, "x", "a", "v", 5)]


def test_recalls_get_identifiers_after_the_least_record_is_found(spark):
    from tracework.sources import recalls

    fields = ("recall_number", "event_id", "recalling_firm", "product_description", "city", "state", "country", "recall_initiation_date", "report_date", "termination_date")
    rows = [("F-1", "1", "b", "p", "c", None, "x", "20240102", None, None), ("F-1", "2", "a", "q", " ", "", None, "2024", "20240103", "20240230"), ("F-2", "3", " ", "p", None, None, None, None, None, None)]
    found = recalls.normalise(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)))
    (r,) = found.collect()
    assert (r.recalling_firm, r.product_description, r.location, r.started_at.day, r.ended_at) == ("a", "q", "Unknown", 3, None)
    assert [r.entity_id, r.activity_id, r.agent_id] == [ids.uuid3_of(f"openfda-food/{k}") for k in ("entity/F-1", "activity/F-1", "agent/a")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" in plan and "md5" not in plan[plan.index("Aggregate") :]
