import pytest
from pyspark.sql import functions as F

from lodestone.operators import indexing, mail, rendering
from lodestone.sources import files, indexes, mbox
from lodestone.streaming import threads


def test_dense_ids(spark):
    df = spark.createDataFrame([(i * 7 % 101, "p" if i % 3 else "q") for i in range(101)], "k long, path string")
    got = indexing.with_dense_ids(df, ["path", "k"]).orderBy("chunk_id").collect()
    want = sorted((r["path"], r["k"]) for r in df.collect())
    assert [(r["path"], r["k"]) for r in got] == want and [r["chunk_id"] for r in got] == list(range(101))


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("columns", [["k", "text"], ["k"]])
def test_dense_ids_of_many_wide_rows(spark, adaptive, columns):
    """No row is lost and no id comes twice, whatever columns are asked for, with one value of the first column on a third of all rows."""
    n = 200_000
    df = spark.range(0, n, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.pmod(F.xxhash64("id"), F.lit(997)))).alias("path"), F.xxhash64("id").alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = indexing.with_dense_ids(df, ["path", "k"]).select("chunk_id", "path", *columns)
        s = got.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).first()
        assert tuple(s) == (n, n, 0, n - 1)
        ordered = got.select("chunk_id", "path", "k").toPandas().sort_values("chunk_id")
        assert list(zip(ordered["path"], ordered["k"])) == sorted(zip(ordered["path"], ordered["k"]))
        assert got.filter("path = 'hot'").count() == -(-n // 3) and got.filter("chunk_id >= 100 AND chunk_id < 200").count() == 100
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("total", [0, 1, 7, 100, 37011])
@pytest.mark.parametrize("shards", [1, 2, 3, 8])
def test_shard_bounds(spark, total, shards):
    b = spark.range(1).select(F.explode(indexing.shard_bounds(F.lit(total).cast("bigint"), F.lit(shards))).alias("b")).select("b.*").collect()
    assert [x["start"] for x in b] == [total * i // shards for i in range(shards)] and b[-1]["stop"] == total
    ids = spark.range(total).select(indexing.shard_of(F.col("id"), F.lit(total), shards).alias("s")).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in ids} == {x["shard"]: x["stop"] - x["start"] for x in b if x["stop"] > x["start"]}


def test_parse_shard():
    assert indexing.parse_shard("1/4") == (1, 4)
    for bad in ("4/4", "x", "1", "-1/2", "1/0"):
        with pytest.raises(ValueError):
            indexing.parse_shard(bad)


MAN = "shard_index int, shard_of int, total_chunks long, model string, dim int, chunker_version string, index_format int, commit_sha string"


def shard(i, of, total, model="m", dim=3, chunker="1", index_format=3, commit="c"):
    return (i, of, total, model, dim, chunker, index_format, commit)


def test_shard_errors(spark):
    counts = spark.createDataFrame([(0, 5, 5), (1, 5, 5)], "shard_index int, rows long, vectors long")
    ok = spark.createDataFrame([shard(1, 2, 10), shard(0, 2, 10)], MAN)
    assert indexing.shard_errors(ok, counts).first()["errors"] == []
    lone = spark.createDataFrame([shard(0, 2, 10)], MAN)
    assert "incomplete set" in indexing.shard_errors(lone, counts).first()["errors"]
    for changed, name in (({"model": "n"}, "model"), ({"dim": 4}, "dim"), ({"chunker": "2"}, "chunker_version"), ({"index_format": 2}, "index_format"), ({"commit": None}, "commit_sha")):
        other = spark.createDataFrame([shard(0, 2, 10), shard(1, 2, 10, **changed)], MAN)
        assert indexing.shard_errors(other, counts).first()["errors"] == [f"{name} differs"]
    with pytest.raises(ValueError):
        indexing.shard_errors(ok.drop("index_format"), counts)
    rows = spark.createDataFrame([(1, 4, [1.0]), (0, 1, [2.0])], "shard_index int, chunk_id long, embedding array<float>")
    man = spark.createDataFrame([shard(0, 2, 2), shard(1, 2, 2)], MAN)
    assert [r["chunk_id"] for r in indexing.merge_shards(rows, man).collect()] == [1, 4]
    with pytest.raises(ValueError):
        indexing.merge_shards(rows, lone)


def test_replace_posts(spark):
    a = spark.createDataFrame([("x.py", 1), ("forum/1", 2), (None, 3)], "path string, n int")
    new = spark.createDataFrame([("forum/2", 9)], "path string, n int")
    once = indexing.replace_posts(a, new)
    assert sorted(r["n"] for r in once.collect()) == [1, 3, 9]
    assert sorted(r["n"] for r in indexing.replace_posts(once, new).collect()) == [1, 3, 9]


def test_index_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    p = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        indexes.read(spark, p)
    indexes.write(rows, {"model": "m", "dim": 2, "channel": "main"}, p)
    got, man = indexes.read(spark, p)
    assert got.count() == 2 and man["n_chunks"] == "2" and man["dim"] == "2"
    q = str(tmp_path / "j")
    indexes.write(rows.drop("text"), {"model": "m", "dim": 2, "channel": "main"}, q)
    both, man = indexes.read_many(spark, [p, q])
    assert both.count() == 4 and man["combined_from"] == f"{p},{q}"
    bad = str(tmp_path / "bad")
    indexes.write(rows, {"model": "m", "dim": 3}, bad)
    with pytest.raises(ValueError):
        indexes.read(spark, bad)
    with pytest.raises(ValueError):
        indexes.read_many(spark, [p, bad])


def test_publish(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0])], "chunk_id long, embedding array<float>")
    old, new, wrong = (str(tmp_path / n) for n in ("live", "staged", "wrong"))
    indexes.write(rows, {"model": "old", "dim": 1, "channel": "main"}, old)
    indexes.write(rows, {"model": "x", "dim": 1, "channel": "other"}, wrong)
    with pytest.raises(ValueError):
        indexes.publish(spark, wrong, old, "main")
    assert indexes.read_manifest(spark, old)["model"] == "old"
    indexes.write(rows, {"model": "new", "dim": 1, "channel": "main"}, new)
    indexes.publish(spark, new, old, "main")
    assert indexes.read_manifest(spark, old)["model"] == "new" and not indexes.exists(spark, old + ".backup") and not indexes.exists(spark, new)


def test_release(spark):
    rel = lambda draft, *names: (draft, False, [(n, f"u/{n}") for n in names])
    schema = "releases array<struct<draft: boolean, prerelease: boolean, assets: array<struct<name: string, browser_download_url: string>>>>"
    listing = spark.createDataFrame([([rel(True, "index-main-9.zip"), *[rel(False, "other.zip")] * 100, rel(False, "index-10.0.0-1.zip", "index-10.0.0-1.sha256")],)], schema)
    assert rendering.pick_release(listing, "10.0.0").first()["zip_url"] == "u/index-10.0.0-1.zip"
    assert rendering.pick_release(listing, "9.0.0").count() == 0


def test_sections(spark):
    md = "# A\nx\n## Solver\ny\n### deep\nz\n## Next\nw"
    d = spark.createDataFrame([(1, md), (2, "no heading"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in rendering.sections(d, "SOLVER").collect()] == [(1, 2, 2, "## Solver\ny\n### deep\nz")]
    assert rendering.headings(d).count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "a.py").write_bytes(b"x = 1\r\ny\xff = 2\n")
    (tmp_path / "data" / "b.py").write_text("no")
    (tmp_path / "c.bin").write_text("no")
    rows = files.scan_tree(spark, str(tmp_path)).collect()
    assert [(r["path"], r["text"]) for r in rows] == [("a.py", "x = 1\ny = 2\n")]
    assert files.tracked_paths(str(tmp_path)) is None
    assert files.project_version("project(Demo VERSION 9.1.2 LANGUAGES CXX)") == "9.1.2"


@pytest.mark.parametrize("range_bytes", [40, 100, 10_000])
def test_mailbox(spark, tmp_path, range_bytes):
    p = tmp_path / "m.mbox"
    parts = [f"From x\nSubject: =?utf-8?q?s{i}?=\nFrom: a <a@b.c>\nDate: Tue, 30 Jan 2018 08:33:51 +0000\nX-GM-THRID: {i % 2}\n\nbody {i}\nmore\n\n" for i in range(5)]
    p.write_text("".join(parts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    try:
        rows = mbox.read_mailbox(spark, str(p)).orderBy("msg_ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r["msg_ord"] for r in rows}) == 5
    assert [r["subject"] for r in rows] == [f"s{i}" for i in range(5)]
    assert [r["body"].strip() for r in rows] == [f"body {i}\nmore" for i in range(5)]
    assert rows[1]["thread_id"] == "1"


MSG = "msg_ord long, thread_id string, subject string, sender string, date_raw string, body string"


def test_post_rows(spark):
    long = "word " * 30
    m = spark.createDataFrame(
        [
            (1, "t", "Re: drift", "Ann Lee <a@b.c>", "Tue, 30 Jan 2018 08:33:51 +0000", long), (2, "t", "drift", "Ann Lee <a@b.c>", "junk", "Hi Bob,\n" + long + "\n> old"),
            (3, "t", "install fails", "x", None, long), (4, None, None, None, None, long), (5, "t", "q", "x", "Tue, 30 Jan 2024 08:33:51 +0000", "short"),
            (6, "t", "q", "Bo", "Tue, 30 Jan 2024 08:33:51 +0000", long),
        ], MSG,
    )
    rows = {r["msg_ord"]: r for r in mail.post_rows(m).collect()}
    assert sorted(rows) == [2, 4, 6]
    assert (rows[2]["line"], rows[6]["line"], rows[4]["line"], rows[4]["path"]) == (1, 2, 1, "forum/unknown")
    assert rows[2]["text"].startswith("Subject: drift\nDate: junk\n\nHi [name removed],\nword")


def test_thread_numbers_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("thread_id"), (F.col("id") * 7919).alias("msg_ord"))
    got = {r["msg_ord"]: r["number"] for r in mail.running_numbers(rows).collect()}
    seen, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["msg_ord"]):
        t = r["thread_id"] or "unknown"
        seen[t] = want[r["msg_ord"]] = seen.get(t, 0) + 1
    assert got == want


BOX = "".join(f"From x\nSubject: s{i}\nFrom: a <a@b.c>\nX-GM-THRID: {i % 2}\n\nbody {i}\n\n" for i in range(4))


def test_mail_stream(spark, tmp_path):
    """Mailboxes that arrive one after another are parsed, numbered per thread and written once each."""
    src, out, ck = (tmp_path / n for n in ("in", "out", "ck"))
    src.mkdir()
    write = threads.number_messages(str(out))

    def run():
        stream = mbox.stream_mailboxes(spark, str(src))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(ck)).trigger(availableNow=True).start().awaitTermination()

    for name in ("a.mbox", "b.mbox"):
        (src / name).write_text(BOX)
        run()
    rows = spark.read.parquet(f"{out}/messages").collect()
    got = sorted((r["thread_id"], r["number"], r["mailbox"][-6:], r["subject"]) for r in rows)
    assert got == [("0", 1, "a.mbox", "s0"), ("0", 2, "a.mbox", "s2"), ("0", 3, "b.mbox", "s0"), ("0", 4, "b.mbox", "s2"), ("1", 1, "a.mbox", "s1"), ("1", 2, "a.mbox", "s3"), ("1", 3, "b.mbox", "s1"), ("1", 4, "b.mbox", "s3")]


def test_redelivery_changes_nothing(spark, tmp_path):
    schema = "mailbox string, thread_id string, msg_ord long, text string"
    first = spark.createDataFrame([("m", "a", 1, "x"), ("m", "a", 1, "x"), ("m", None, 2, "y")], schema)
    second = spark.createDataFrame([("m", "a", 1, "x"), ("m", "a", 3, "z")], schema)
    number = threads.number_messages(str(tmp_path / "n"))
    post = threads.upsert_posts(str(tmp_path / "p"))
    for batch, n in ((first, 0), (second, 1), (second, 1), (first, 2)):  # batch 1 runs twice, batch 2 brings batch 0 again
        number(batch, n)
        post(batch, n)
    got = sorted((r["thread_id"] or "unknown", r["msg_ord"], r["number"]) for r in spark.read.parquet(str(tmp_path / "n" / "messages")).collect())
    assert got == [("a", 1, 1), ("a", 3, 2), ("unknown", 2, 1)]
    assert sorted(r["msg_ord"] for r in threads.read_posts(spark, str(tmp_path / "p")).collect()) == [1, 2, 3]


def test_examples(spark, tmp_path):
    for name in ("a.py", "sub/b.MD", "c.cpp", "__pycache__/d.py", "DEMO_OUTPUT/e.txt", "data/f.rst"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x = 1\n")
    (tmp_path / "large.txt").write_text("word " * 250_000)
    assert sorted(r["path"] for r in files.scan_examples(spark, str(tmp_path)).collect()) == ["a.py", "data/f.rst", "large.txt", "sub/b.MD"]


def test_checkpoint_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from lodestone import runtime

    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(RuntimeError):
        runtime.checkpoint_dir(session)
