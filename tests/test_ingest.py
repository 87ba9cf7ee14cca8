import pytest
from pyspark.sql import functions as F

from entityframe import EntitySchema, EntityStore, Field, PropertyFilter
from entityframe.operators import listing, schemas
from entityframe.sources import export, ingest
from entityframe.sources.csv_files import clean_headers, raw_table, read_csv
from entityframe.sources.stored import StoredEntities
from entityframe.streaming import jobs
from helpers import bags, column


@pytest.fixture
def upload(tmp_path, spark):
    def make(text, schema_name="Upload", existing=None, header_row=None, **kw):
        path = tmp_path / "file.csv"
        path.write_bytes(text.encode("utf-8"))
        raw = read_csv(spark, str(path), header_row)
        return ingest.plan(raw, schema_name, existing, **kw)

    return make


def kinds(plan):
    return [(f.name, f.type.value, f.required) for f in plan.ingest.schema.fields]


def counts(plan):
    return tuple(plan.ingest.summary().first())


def test_create(upload):
    plan = upload("name,age,active\nAlice,30,true\nBob,25,false\n")
    assert plan.created and kinds(plan) == [("name", "STRING", True), ("age", "INTEGER", True), ("active", "BOOLEAN", True)]
    assert counts(plan) == (2, 2, 0)


def test_extend(upload):
    plan = upload("name,score\nAlpha,42\nBeta,100\n", existing=EntitySchema("Upload", (Field("name", "STRING", True),)))
    assert plan.new_fields == ("score",) and counts(plan) == (2, 2, 0)
    assert plan.ingest.schema.version == "2.0.0"  # a new required field is a breaking change


def test_type_conflict(upload):
    plan = upload("count\n3.5\n", existing=EntitySchema("Upload", (Field("count", "INTEGER", True),)))
    assert counts(plan) == (1, 0, 1)
    assert "type mismatch: existing=INTEGER, detected=FLOAT" in plan.changes[0].message
    assert column(plan.ingest.rejects(), "error_message") == ['field count: unable to coerce "3.5" to integer']


def test_header_index(upload):
    plan = upload("metadata,value\nname,age\nAlice,30\nBob,25\n", header_row=1)
    assert [k[0] for k in kinds(plan)] == ["name", "age"] and counts(plan) == (2, 2, 0)
    assert [c[0] for c in plan.ingest.raw.candidates if c[2]] == [1]
    assert sorted(column(plan.ingest.rows(), "row_number")) == [3, 4]


def test_partial_invalid(upload):
    existing = EntitySchema("Upload", (Field("name", "STRING", True), Field("score", "INTEGER", True)))
    plan = upload("name,score\nAlpha,10\nBeta,not_a_number\nGamma,25\n", existing=existing)
    assert counts(plan) == (3, 2, 1)
    rejected = plan.ingest.rejects().select("row_number", "error_message").first()
    assert tuple(rejected) == (3, 'field score: unable to coerce "not_a_number" to integer')


def test_preview_errors(upload):
    existing = EntitySchema("Upload", (Field("name", "STRING", True), Field("age", "INTEGER")))
    rows = upload("name,age\nAlice,30\nBob,not_a_number\n", existing=existing).ingest.preview().collect()
    assert [(r["row_number"], r["values"]["name"], r["error"] is not None) for r in rows] == [(2, "Alice", False), (3, "Bob", True)]


def test_override(upload):
    plan = upload("name,age\nAlice,30\nBob,55\n", overrides={"age": "string"})
    head = plan.headers({"age": "string"})[1]
    assert (head["detected_type"], head["effective_type"], head["overridden"]) == ("INTEGER", "STRING", True)


def test_fractional_timestamps(upload):
    text = "Asset, Warranty_Expiration_Date\nLaptop,2024-03-02 16:25:04.594\nMonitor,2024-03-05 09:15:13.120\n"
    plan = upload(text)
    assert kinds(plan)[1] == ("Warranty_Expiration_Date", "TIMESTAMP", True) and counts(plan) == (2, 2, 0)


def test_messy_file(upload):
    text = '﻿a b,a-b,,"x.y"\n\n , ,\n1, two ,3,"q, ""r"""\n,,,\n4,5\n6,7,8,9,10\n'
    plan = upload(text)
    raw = plan.ingest.raw
    assert raw.columns == ["a_b", "a_b_2", "column_3", "x_y"]
    rows = raw.df.orderBy("row_number").select(*[raw.cell(c) for c in raw.columns]).collect()
    assert [tuple(r) for r in rows] == [("1", "two ", "3", 'q, "r"'), ("4", "5", None, None), ("6", "7", "8", "9")]


def test_headers_may_be_any_name(upload):
    plan = upload("row_number,properties,error,__base,path\n7,a,b,c,d\n8,a,,c,d\n")
    assert [k[0] for k in kinds(plan)] == ["row_number", "properties", "error", "base", "path"]
    got = plan.ingest.valid().select("row_number", "path", "properties.row_number", "properties.properties", "properties.path")
    assert sorted(map(tuple, got.collect())) == [(2, "upload.n7", 7, "a", "d"), (3, "upload.n8", 8, "a", "d")]
    assert plan.ingest.preview().count() == 2


def test_header_cleaning():
    assert clean_headers([" Name ", "name", "name", "a.b c-d", "", "__x__"]) == ["Name", "name_2", "name_3", "a_b_c_d", "column_5", "x"]


def test_paths(spark):
    rows = [(2, " 2025/10/23 12:09:55 ", None), (3, "Example", "x"), (4, " ", "Example"), (5, "Example", None), (6, "--", None)]
    df = spark.createDataFrame(rows, "n int, a string, b string")
    raw = raw_table(df, ["a", "b"], "n")
    raw.chunk = F.floor(F.col("row_number") / 2)
    job = ingest.Ingest(raw, EntitySchema("Team Schema", (Field("a"), Field("b"))))
    got = dict(map(tuple, job.valid().select("row_number", "path").collect()))
    assert got == {
        2: "team_schema.n2025_10_23_12_09_55",
        3: "team_schema.example",
        4: "team_schema.example_2",
        5: "team_schema.example_3",
        6: "team_schema.row_5",
    }
    blank = ingest.Ingest(raw, EntitySchema("--", (Field("a"), Field("b"))))
    assert "entity.example" in column(blank.valid(), "path")


def test_required_and_references(upload):
    existing = EntitySchema("Upload", (Field("a", "STRING", True), Field("r", "ENTITY_REFERENCE")))
    plan = upload("a,r\n,zz\nx,\ny,zz\n", existing=existing)
    got = sorted(map(tuple, plan.ingest.rejects().select("row_number", "error_message").collect()))
    assert got == [
        (2, "a: required field 'a' is missing; r: field 'r' must be a valid UUID string"),
        (4, "r: field 'r' must be a valid UUID string"),
    ]
    plan.ingest.skip_validation = True
    plan.ingest._staged = None
    assert plan.ingest.rejects().count() == 0


def test_write_is_repeatable(upload, spark, tmp_path):
    plan = upload("name,age\nAlice,30\nBob,x\nBob,4\n", existing=EntitySchema("Upload", (Field("name"), Field("age", "INTEGER"))))
    paths = [str(tmp_path / d) for d in ("entities", "rejects", "manifest")]
    for _ in range(2):
        assert plan.ingest.write(*paths, batch_id="b1") == "b1"
    stored = EntityStore(mixed=spark.read.parquet(paths[0]))
    found = stored.load("Upload")
    assert sorted(column(found, "path")) == ["upload.alice", "upload.bob"]
    assert column(listing.search_range(found, "age", 10, 40), "path") == ["upload.alice"]
    log = ingest.reject_log(spark.read.parquet(paths[1]), "org", "Upload", "")
    assert column(log, "row_number") == [None, 3]  # the type conflict is logged against the file
    stats = ingest.batch_stats(spark.read.parquet(paths[2])).first()
    assert (stats["total_batches"], stats["completed_batches"], stats["total_rows_flushed"]) == (1, 1, 2)


def test_multi_block_row_numbers(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("k,v\n" + "".join(f"{i},{'x' * 50}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        raw = read_csv(spark, str(path))
        assert raw.df.select("__block").distinct().count() > 5
        assert raw.df.filter(F.col("row_number") != F.col("@k").try_cast("int") + 2).count() == 0
        assert raw.df.count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_export_round_trip(spark, tmp_path):
    schema = EntitySchema("T", (Field("name"), Field("n", "FLOAT"), Field("o", "JSON"), Field("gone")))
    df = bags(spark, "T", [("a", None, {"name": 'x, "y"', "n": 2.0, "o": {"k": [1]}}), ("b", None, {"n": 1.5})])
    rows = export.type_rows(df, schema)
    export.write_csv(rows, str(tmp_path / "out"))
    back = export.read_back(spark, str(tmp_path / "out"), rows.columns)
    assert sorted(map(tuple, back.collect())) == [("", "1.5", "", ""), ('x, "y"', "2", '{"k":[1]}', "")]
    assert export.type_rows(df, schema, (PropertyFilter("n", "1."),)).count() == 1


def test_conform(spark):
    df = bags(spark, "T", [("a", None, {"n": "12", "f": 2, "x": 1, "l": ["p", 3]}), ("b", None, {"n": "zz"})])
    out = schemas.conform(df, EntitySchema("T", (Field("n", "INTEGER"), Field("f", "FLOAT"), Field("l", "ENTITY_REFERENCE_ARRAY"), Field("new"))))
    got = {r["id"]: tuple(r["properties"]) for r in out.collect()}
    assert got == {"a": (12, 2.0, ["p", "3"], None), "b": (None, None, None, None)}


def test_history_stream(spark, tmp_path):
    start = bags(spark, "U", [("a", None, {"v": 0})])
    fields = "seq long, op string, id string, v string, changed_at timestamp, reason string"
    for n, rows in enumerate([[(1, "UPDATE", "a", '{"v":1}')], [(2, "UPDATE", "a", '{"v":2}'), (3, "INSERT", "b", '{"v":9}')]]):
        df = spark.createDataFrame([(*r, None, None) for r in rows], fields)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incoming = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        changes = incoming.select(
            "seq", "op", "id", F.lit("org").alias("organization_id"), F.lit("s").alias("schema_id"), F.lit("U").alias("entity_type"),
            F.lit(None).cast("string").alias("path"), F.parse_json("v").alias("properties"),
            F.timestamp_seconds("seq").alias("changed_at"), "reason",
        )
        jobs.history_stream(changes, spark, str(tmp_path / "out"), str(tmp_path / "marks"), start).awaitTermination()
    current = jobs.read_state(spark, str(tmp_path / "out"), start)
    assert spark.read.parquet(str(tmp_path / "out/deltas/0-0")).count() == 1  # only the changed entity is written
    assert sorted(map(tuple, current.select("id", "version").collect())) == [("a", 3), ("b", 1)]
    past = spark.read.parquet(str(tmp_path / "out/history"))
    assert sorted(map(tuple, past.select("entity_id", "version").collect())) == [("a", 1), ("a", 2)]


def test_only_committed_entities_show(upload, spark, tmp_path):
    fields = EntitySchema("Upload", (Field("name"), Field("age", "INTEGER")))
    paths = [str(tmp_path / d) for d in ("entities", "rejects", "manifest")]
    job = lambda text: upload(text, existing=fields).ingest
    snapshot = lambda: StoredEntities(spark, paths[0], paths[2])
    names = lambda: sorted(column(snapshot().mixed(), "path"))

    def breaks(which, batch):
        which.log = lambda: which.rejects().withColumn("error_message", F.raise_error(F.lit("broke off")).cast("string"))
        with pytest.raises(Exception, match="broke off"):
            which.write(*paths, batch_id=batch)

    breaks(job("name,age\nZoe,1\nBad,x\n"), "b0")
    assert names() == [] and spark.read.parquet(paths[0]).count() == 1
    job("name,age\nAlice,30\nBob,x\n").write(*paths, batch_id="b1")
    taken = snapshot()
    breaks(job("name,age\nCarl,5\nBad,x\n"), "b1")
    assert names() == ["upload.alice"]
    job("name,age\nDora,7\nEve,50\n").write(*paths, batch_id="b2")
    assert names() == ["upload.alice", "upload.dora", "upload.eve"] and column(taken.mixed(), "path") == ["upload.alice"]
    job("name,age\nCarl,5\n").write(*paths, batch_id="b1")
    assert names() == ["upload.carl", "upload.dora", "upload.eve"]
    assert len(list((tmp_path / "entities/batch_id=b1").glob("attempt=*"))) == 1
    job("name,age\nBad,x\n").write(*paths, batch_id="b3")  # no valid row
    assert len(names()) == 3
    stats = ingest.batch_stats(spark.read.parquet(paths[2])).first()
    assert (stats["total_batches"], stats["completed_batches"], stats["failed_batches"]) == (4, 3, 1)


def test_typed_columns_of_a_store_are_filtered_by_the_scan(upload, spark, tmp_path):
    paths = [str(tmp_path / d) for d in ("entities", "rejects", "manifest")]
    old = EntitySchema("Upload", (Field("name"), Field("age", "STRING")))
    upload("name,age\nOld,41\nOdd,n/a\n", existing=old).ingest.write(*paths, batch_id="b1")
    new = EntitySchema("Upload", (Field("Name"), Field("age", "INTEGER"), Field("city")))
    upload("name,age,city\nAlice,30,Rome\nBob,50,Oslo\n", existing=new).ingest.write(*paths, batch_id="b2")
    store = StoredEntities(spark, paths[0], paths[2]).store([new])
    found = listing.search_range(store.load("Upload"), "age", 40, 60)
    assert sorted(column(found, "path")) == ["upload.bob", "upload.old"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = found.filter(F.col("`@city`") == "Oslo")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(`@age`,40)" in plan and "EqualTo(`@city`,Oslo)" in plan and "properties" not in plan
    assert column(listing.search_containment(store.load("Upload"), {"age": 30, "city": "Rome"}), "path") == ["upload.alice"]
    # The types of a snapshot that have no schema keep their bags, and every type is among all of them.
    assert StoredEntities(spark, paths[0], paths[2]).store().load("Upload").count() == 4 and store.all().count() == 4
