from pyspark.sql import functions as F

from spoor.sources import folders, recordings
from spoor.sources.lines import numbered_lines


def test_a_recording_of_several_parts_is_one_file_in_order(spark, tmp_path):
    """Parts that are dealt out by recording already, as those of ``lines_of``; as many tasks as Spark likes."""
    rows = spark.range(6000).select((F.col("id") % 30).alias("recording_id"), F.floor(F.col("id") / 30).alias("seq"), F.repeat(F.lit("x"), 300).alias("qname"))
    first = rows.groupBy("recording_id").agg(F.min("seq").alias("seq"), F.max("qname").alias("qname"))
    rest = rows.join(first.select("recording_id", F.col("seq").alias("s")).hint("merge"), "recording_id").where("seq <> s").drop("s")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        recordings.write_recordings(rest.unionByName(first), str(tmp_path / "r"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    rows = recordings.read_lines(spark, str(tmp_path / "r")).groupBy("recording_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.countDistinct("seq").alias("numbers")).collect()
    assert len(rows) == 30 and {(r.n, r["last"], r.numbers) for r in rows} == {(200, 200, 200)}
    assert all(len(list(f.glob("part-*"))) == 1 for f in (tmp_path / "r").iterdir())


def test_plain_calls_read_what_spark_reads(spark, tmp_path, monkeypatch):
    """Names with signs, empty files, carriage returns, bytes that are no text, hidden files; large ones by Spark."""
    texts = {"a=1/f b.txt": b"one\r\ntwo", "a=1/e.txt": b"", "a=%25/g#.txt": b"\n\nx\n", "h.txt": "﻿é\n".encode(), "l.txt": b"\xffq\nr\n", "_SUCCESS": b"no\n", "_x=1/k.txt": b"k\n", ".hid/z.txt": b"no", "a=1/.crc": b"no", "[big]/b.txt": b"line\n" * 50}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    monkeypatch.setattr(folders, "LARGE", 100)
    lines = lambda: sorted((r.file, r.line_no, bytes(r.line)) for r in numbered_lines(spark, str(tmp_path)).withColumn("line", F.col("line").cast("binary")).collect())
    whole = lambda: sorted((r.file, bytes(r.content)) for r in folders.whole_files(spark, str(tmp_path), "*.txt").withColumn("content", F.col("content").cast("binary")).collect())
    plain = lines(), whole()
    monkeypatch.setattr(folders, "mounted", lambda *_: None)
    assert plain == (lines(), whole()) and len(plain[0]) == 59


def test_result_tree_is_written_by_plain_calls(spark, sf_dir):
    from spoor.plans import more

    root = folders.mounted(spark, more._result_tree(spark, sf_dir))
    held = {tuple(names) for _, below, names in folders.os.walk(root) if not below}
    assert held == {("part-00000.txt",)}  # no sums beside it, for each of which Hadoop starts a process


def test_traces_keep_only_what_lines_need(spark, sf_dir, monkeypatch):
    from spoor.plans import trace

    kept = []
    monkeypatch.setattr(trace, "materialize", lambda df, label: kept.append(df.columns) or df)
    trace._written(spark, sf_dir)
    assert kept == [["recording_id", "pid", "seq", "epoch", "is_last", "call", "ret"]]


def test_dropped_recordings_begin_with_their_start(spark, sf_dir):
    from spoor.plans import sources

    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        files = recordings.read_files(spark, sources._dropped(spark, sf_dir)).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len({r.recording_id for r in files}) == len(files)
    assert all('"op":"session_start"' in r.content.split("\n")[0] for r in files)
