"""DataFrame operators, sources, sinks, options, streaming."""

import io
import os
import random
import re
import subprocess
import sys
import time
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from metaglean.functions import samples, textsql
from metaglean.functions.core import Options
from metaglean.functions.detect import detect
from metaglean.functions.messages import locales, message
from metaglean.operators import audit, detect as D, files as O
from metaglean.plans import batch, catalogue, corpus as C, options
from metaglean.sources import files as sources, sinks
from metaglean.streaming import watch

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def canon(rows, names):
    cell = lambda x: "-" if x is None or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) else str(x)
    return sorted(tuple(cell(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    cur = duck.execute(catalogue.ORACLE[name])
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert canon([r.asDict() for r in df.collect()], names) == canon(want, names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLE) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_column_detection_equals_bytes(spark):
    r = random.Random(3)
    seeds = [f(15, "NIKON text") for f in (samples.jpeg, samples.png, samples.webp, samples.gif, samples.svg, samples.tiff, samples.pdf)]
    seeds += [samples.tiff(15, "t", True), samples.ftyp("zzzz", "heic") + b"\0" * 9, samples.quicktime({}), b" \n<?xml?><svg>", b"<a xmlns='http://www.w3.org/2000/svg'>", b"", b"II*\0\xff\xff\xff\xff\0\0\0\0", b"MM\0*\0\0\0\x08\0\0"]
    files = list(seeds)
    for _ in range(400):
        d = bytearray(r.choice(seeds))
        for _ in range(r.randint(0, 3)):
            if d:
                d[r.randrange(min(len(d), 40))] = r.choice((0, 255, 73, 77, 42, 1))
        files.append(bytes(d[: r.randint(0, len(d))] if r.random() < 0.3 else d))
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(files)], "id int, content binary")
    for row in D.with_format(df).collect():
        assert row.format == detect(files[row.id]), files[row.id][:60]


def test_extra_columns_and_errors(spark):
    rows = [(1, bytearray(samples.jpeg(15, "x")), "f"), (2, None, "g"), (3, bytearray(b"\xff\xd8\xff\xe0\0"), None), (4, bytearray(b""), "h")]
    df = spark.createDataFrame(rows, "id int, content binary, format string")
    for f in (O.metadata_types, O.read_metadata, O.remove_metadata, O.verify_clean):
        assert f(df).count() == 4 and f(df.limit(0)).count() == 0
    assert {r.id: r.error_class for r in O.remove_metadata(df).collect()} == {1: None, 2: "Unsupported", 3: "Corrupted", 4: "Unsupported"}
    assert O.structure(df).where("id = 3").first().error_class == "Corrupted"


def test_scan_prunes_and_pushes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.JPG", samples.jpeg(3, "x")), ("sub/b.png", samples.png(3, "x")), ("c.txt", b"no"), ("draft_d.gif", samples.gif(1, "x"))):
        (tmp_path / name).write_bytes(data)
    found = sources.scan(spark, str(tmp_path), exclude=("draft*",), max_length=10_000)
    assert sorted(os.path.basename(r.path) for r in found.select("path").collect()) == ["a.JPG", "b.png"]
    plan = found.select("path")._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,10000)" in plan and "ReadSchema: struct<path:string,length:bigint>" in plan
    assert sources.scan(spark, str(tmp_path), recursive=False).count() == 2
    assert [len(x) for x in sources.classify(spark, [str(tmp_path), str(tmp_path / "a.JPG"), str(tmp_path / "none")])] == [1, 1, 1]


def test_batch_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(samples.jpeg(7, "x"))
    (tmp_path / "in/bad.png").write_bytes(samples.png(0, "")[:20])
    job = options.parse([str(tmp_path / "in"), "--output-dir", f"file:{tmp_path}/out", "--keep", "ICC Profile"])
    rows = batch.run(spark, job, str(tmp_path / "report"))
    assert {os.path.basename(r.file): (r.success, r.skipped_existing) for r in rows.collect()} == {"a.jpg": (True, False), "bad.png": (False, False)}
    out = (tmp_path / "out/a-clean.jpg").read_bytes()
    assert out == samples.jpeg(4, "x")
    a = audit.audit(rows)
    assert a.first().successful == 1 and a.select(audit.exit_code()).first()[0] == 1
    assert not [f for f in os.listdir(tmp_path / "out") if f.endswith(".part")]
    dry = batch.process(sources.scan(spark, str(tmp_path / "in")), dry_run=True)
    assert sorted(os.path.basename(r.output_path) for r in dry.collect()) == ["a-clean.jpg", "bad-clean.png"]


def test_output_paths_belong_to_one_file(spark, tmp_path):
    for folder, bits in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.png").write_bytes(samples.png(bits, "x"))
    job = options.parse([str(tmp_path / "a"), str(tmp_path / "b"), "--output-dir", f"file:{tmp_path}/out"])
    rows = {r.file.split("/")[-2]: r for r in batch.run(spark, job, str(tmp_path / "report")).collect()}
    assert len(rows) == 2 and rows["a"].success and not rows["b"].success and "/a/same.png" in rows["b"].error
    assert (tmp_path / "out/same-clean.png").read_bytes() == samples.png(0, "")


def test_watch_reads_every_input(spark, tmp_path):
    for i, folder in enumerate(("a", "b", "a/deep")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / f"f{i}.png").write_bytes(samples.png(3, "x"))
    job = options.parse([str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "a/deep"), "--output-dir", f"file:{tmp_path}/out"])
    watch.watch(spark, job, str(tmp_path / "results"), once=True).awaitTermination(120)
    (tmp_path / "b/f0.png").write_bytes(samples.png(1, "another file of that name"))
    watch.watch(spark, job, str(tmp_path / "results"), once=True).awaitTermination(120)
    assert sorted(f for f in os.listdir(tmp_path / "out") if not f.startswith(".")) == ["f0-clean.png", "f1-clean.png", "f2-clean.png"]
    lost = spark.read.parquet(str(tmp_path / "results-written")).where("error is not null").collect()
    assert len(lost) == 1 and "b/f0.png" in lost[0].error and "a/f0.png" in lost[0].error


def test_reports_print_every_row(spark, capsys):
    batch.shown(spark.range(3000).select(F.concat(F.lit("line "), "id")))
    assert len(capsys.readouterr().out.split("\n")) == 3001


def test_data_urls_leave_columns_alone(spark):
    d = spark.createDataFrame([("data:;base64,eA==", 1, 2)], "u string, __parsed int, parsed_ int")
    assert sources.from_data_urls(d, "u").columns == ["u", "__parsed", "parsed_", "content", "error_message"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / f"in/f{i}.png").write_bytes(samples.png(i, f"text {i}"))
    job = options.parse([str(tmp_path / "in"), "--output-dir", f"file:{tmp_path}/out"])
    watch.watch(spark, job, str(tmp_path / "results"), once=True).awaitTermination(120)
    (tmp_path / "in/late.png").write_bytes(samples.png(3, "late"))
    watch.watch(spark, job, str(tmp_path / "results"), once=True).awaitTermination(120)
    want = {r.output_path: bytes(r.content) for r in batch.process(sources.scan(spark, str(tmp_path / "in")), job.options, job.output_dir).collect()}
    got = {f"file:{tmp_path}/out/{f}": (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out") if not f.startswith(".")}
    assert got == want and len(got) == 7
    with pytest.raises(ValueError):
        watch.watch(spark, options.parse(["/a", "--output-dir", "/a/b"]), "/tmp/x")


def test_progress_and_gate(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"f{i}.png").write_bytes(samples.png(i, "x"))
    seen = []
    listener = watch.Progress(lambda batch, rows: seen.append(rows))
    spark.streams.addListener(listener)
    q = watch.scrub_stream(sources.stream(spark, str(tmp_path))).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/.check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    for _ in range(100):
        if seen:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert seen and seen[-1] == 3
    found = sources.scan(spark, str(tmp_path))
    assert not O.all_clean(found) and O.all_clean(found.where("path like '%f0.png'"))


def test_standard_input(tmp_path):
    out = subprocess.run([sys.executable, "-m", "metaglean.plans.batch", "-"], input=samples.png(3, "x"), capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout == samples.png(0, "")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "b.txt", bytearray(b"bb")), ("g", "a.txt", bytearray(b"a")), ("h", "c", None)], "g string, name string, content binary")
    zips = {r.group: zipfile.ZipFile(io.BytesIO(bytes(r.archive))) for r in sinks.zip_bundle(df, "g").collect()}
    assert zips["g"].namelist() == ["a.txt", "b.txt"] and zips["g"].read("b.txt") == b"bb"
    one = spark.createDataFrame([(f"file:{tmp_path}/x/y", bytearray(b"1"))], "output_path string, content binary")
    assert [r.written for r in sinks.write_files(one).collect()] == [True]
    assert [r.written for r in sinks.write_files(one.withColumn("content", F.lit(b"2")), skip_existing=True).collect()] == [False]
    sinks.write_files(one.withColumn("content", F.lit(b"3")), backup_suffix=".bak").collect()
    assert (tmp_path / "x/y").read_bytes() == b"3" and (tmp_path / "x/y.bak").read_bytes() == b"1"
    assert sinks.json_line(spark.createDataFrame([(1, None)], "a int, b string")).first().json == '{"a":1,"b":null}'


def test_small_tables_of_many_rows_are_spread(spark, tmp_path):
    """One row group of narrow rows was one task, however many files were made of it."""
    one = spark.range(0, 50_001, 1, 1).select(F.col("id").alias("event_id"))
    one.write.parquet(f"{tmp_path}/events.parquet")
    assert C.table(spark, str(tmp_path), "events").rdd.getNumPartitions() == 1
    assert C.places(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert C.spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_letters_of_texts(spark):
    texts = [None, "", "  ", "é1\n", " Ab\u00a0c d\tE  ", "\U0001f600Z[`{@", "x" * 9, "\x00a\x7f b\r"]
    want = [re.sub("[^A-Za-z ]", "", t or "").strip(" ") or "x" for t in texts]
    assert [C.letters(None if t is None else t.encode()) for t in texts] == want
    plan = C.images(spark, SF)._jdf.queryExecution().toString()
    assert "regexp_replace" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("name", ["plugin_format", "metadata_diff", "ifd_entries", "heic_types", "movie_metadata"])
def test_files_are_made_and_read_once(spark, name):
    """Made and read again for each of their answers, files were joined by id afterwards."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow ") == 2


def test_long_texts_are_no_appended_payload(spark, tmp_path):
    """A text chunk of over 65,536 bytes is a sign to the scan, but none of stego_scan's SQL."""
    import duckdb

    docs = [(i, "word " * 15_000) for i in (1, 8, 7, 14, 26, 78, 91)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(catalogue.ORACLE["stego_scan"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["stego_scan"](spark, str(tmp_path)).select("id", "code", "size").collect()]
    assert len(want) == 4 and sorted(got, key=str) == sorted(want, key=str)
    every = O.steganography(C.images(spark, str(tmp_path), False)).where("code = 'png-large-private-chunk'")
    assert sorted(r.id for r in every.collect()) == [1, 8, 78]


def test_zip_of_more_files_than_its_end_can_count():
    """As many bytes as the SQL of zip_archives says, and every file can be read."""
    files = [(f"o{i}.txt", b"x" * (i % 3)) for i in range(70_000)]
    made = sinks.stored_zip(files)
    assert len(made) == 22 + sum(76 + 2 * len(n) + len(d) for n, d in files)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.namelist() == [n for n, _ in files] and all(z.read(n) == d for n, d in files[::999]) and z.testzip() is None
    with zipfile.ZipFile(io.BytesIO(sinks.stored_zip([("\xe9/ü", None)]))) as z:
        assert z.namelist() == ["\xe9/ü"] and z.read("\xe9/ü") == b""


def test_inspect_text(spark):
    d = samples.located(1.5, -2.25)
    t = O.read_metadata(spark.createDataFrame([(bytearray(d),)], "content binary")).select(O.inspect_text().alias("t")).first().t
    assert t == f"  Format    : jpeg\n  File size : {len(d)} B\n  GPS       : 1.500000, -2.250000"


def test_options(tmp_path):
    j = options.parse(["a", "--profile", "archive", "--gps-redact", "city", "--inject-artist", "Me", "--include", "*.jpg,*.png"])
    assert j.options.keep[-1] == "Description" and j.options.remove == ("GPS", "Software") and j.include == ("*.jpg", "*.png") and j.options.inject == {"artist": "Me"}
    (tmp_path / "rc").write_text('{"preserveOrientation": true, "output-dir": "/o", "nonsense": 1}')
    j = options.parse(["a"], str(tmp_path / "rc"))
    assert j.options.orientation and j.output_dir == "/o"
    with pytest.raises(SystemExit) as e:
        options.parse(["--gps-redact", "nowhere"])
    assert e.value.code == 3
    assert options.with_profile({"title": True}, "unknown") == {"title": True} and Options().resolved() == Options()
    assert message("done", "de", count=3) == "Fertig: 3 Dateien" and message("size", "fr", size=1) == "Size: 1" and "en" in locales()


@pytest.mark.parametrize("pattern,name,want", [("*.jpg", "a.JPG", True), ("*.jpg", "d/a.jpg", False), ("**/*.jpg", "d/e/a.jpg", True), ("**/*.jpg", "a.jpg", True), ("**", "a/b", True), ("?.png", "a.png", True), ("?.png", "/.png", False), ("a+b.*", "a+b.c", True), ("a.b", "axb", False)])
def test_globs(spark, pattern, name, want):
    assert spark.range(1).select(textsql.matches_glob(F.lit(name), pattern)).first()[0] == want
