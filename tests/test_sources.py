"""Readers, writers, resume and streaming on small files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from votemill.operators import corpus, resampling
from votemill.sources import readers, schemas, writers
from votemill.streaming import completion, ingest


def test_dumps(spark, tmp_path):
    big = 10**30
    lines = [{"id": "a", "gold": "1", "samples": [{"ans": str(big), "logp": -0.1, "trunc": False, "len": 3}]}, {"id": "b", "gold": "2", "samples": []}, {"id": "a", "gold": "1", "samples": [{"ans": "5", "logp": -0.2, "trunc": True, "len": 4}, {"ans": None, "logp": -1.0, "trunc": False, "len": 9}]}]
    (tmp_path / "val_s1.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n")
    dump = readers.json_lines(spark, str(tmp_path), "sample_dump", tolerant=True)
    assert dump.count() == 3 and readers.rejected_lines(spark, str(tmp_path), "sample_dump").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path), "sample_dump").collect()
    own = schemas.ballots(readers.last_wins(dump)).orderBy("id", "pos").collect()
    assert [(r["id"], r["pos"], r["ans"]) for r in own] == [("a", 0, "5"), ("a", 1, None)]
    assert schemas.ballots(dump, 1).filter(F.col("ans") == str(big)).count() == 1
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "val_x.jsonl").write_text(json.dumps(lines[0]))
    assert [r["system"] for r in readers.dumps(spark, f"{tmp_path}/other/*.jsonl").select("system").collect()] == ["val_x"]


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "p.csv").write_text('﻿ Problem_ID , Question ,answer\n1,"two\nlines, ""quoted""",5\n')
    row = readers.problems(spark, str(tmp_path / "p.csv")).first()
    assert (row["id"], row["question"], row["answer"]) == ("1", 'two\nlines, "quoted"', "5")
    with pytest.raises(ValueError, match="columns"):
        schemas.resolve(["x", "y"], schemas.ID_NAMES)
    writers.answers_csv(spark.createDataFrame([("a", "7")], "id string, answer string"), str(tmp_path / "s"))
    df, header = readers.submission(spark, str(tmp_path / "s"))
    assert header == ["id", "answer"] and df.collect() == [("a", "7")]
    with pytest.raises(Exception, match="too long"):
        writers.answers_csv(spark.createDataFrame([("a", str(2**63))], "id string, answer string"), str(tmp_path / "t"))


def test_maps_blocks_and_sinks(spark, tmp_path):
    (tmp_path / "strata.json").write_text(json.dumps({"x": ["1", "2"], "y": ["3"]}))
    assert sorted(readers.strata(spark, str(tmp_path / "strata.json")).collect()) == [("x", "1"), ("x", "2"), ("y", "3")]
    (tmp_path / "key.json").write_text(json.dumps({"7": {"verdict": "BROKEN", "gold": 1, "ours": 2, "truth": None, "note": ""}}))
    assert readers.corrected_key(spark, str(tmp_path / "key.json")).first()["truth"] is None
    (tmp_path / "t.txt").write_text("intro\n## ID: a\none \\boxed{1}\n### ID： b\ntwo\n## ID: a\nagain\n")
    blocks = corpus.teacher_blocks(readers.blocks(spark, str(tmp_path / "t.txt")))
    assert [(r["id"], r["solution"]) for r in blocks.orderBy("place").collect()] == [("a", "one \\boxed{1}"), ("b", "two"), ("a", "again")]
    assert readers.count_headers(spark, str(tmp_path / "t.txt")).first()["n"] == 2
    rows = spark.createDataFrame([(i, f"q{i}", str(i)) for i in range(5)], "id long, question string, answer string")
    writers.chunks(rows, str(tmp_path / "chunks"), str(tmp_path / "keys"), 2)
    text = spark.read.text(str(tmp_path / "chunks"))
    assert text.select("chunk").distinct().count() == 3 and "answer" not in text.columns
    writers.metrics(spark, {"acc": 0.5}, str(tmp_path / "m"))
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"acc": 0.5}


def test_blocks_of_split_files(spark, tmp_path):
    """One file in many splits gives the blocks of a plain reading, wherever the splits fall."""
    rng = random.Random(2)
    lines = ["before ## ID: no", "", *(rng.choice(["## ID: a{0}", "### ID： b{0}", "#### ID :c{0}", "## Notes {0}", "# ID: x", "text {0}", "", "## ID: two words", "##ID:d{0}  "]).format(i) for i in range(3000))]
    text = "\n".join(lines) + "\n## ID: last"
    for name in ("one", "two"):
        (tmp_path / f"{name}.txt").write_text(text)
    head = re.compile(r"(?m)^#{2,4}\s*ID\s*[:：]\s*(\S+)[^\S\n]*$")
    hits = list(head.finditer(text))
    want = [(m.group(1), text[m.end() : n.start() if n else len(text)].strip()) for m, n in zip(hits, [*hits[1:], None])]
    for size in ("700", "5000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = readers.blocks(spark, str(tmp_path / "*.txt"))
            splits = readers.records(spark, str(tmp_path / "*.txt")).select("file", "split").distinct().count()
            got = corpus.teacher_blocks(found).orderBy("file", "place").collect()
            n = readers.count_headers(spark, str(tmp_path / "*.txt")).first()["n"]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert splits == 2 or (size != "128m" and splits > 10)
        for name in ("one", "two"):
            assert [(r["id"], r["solution"]) for r in got if name in r["file"]] == want
        assert n == len({i for i, _ in want})


def test_resume(spark, tmp_path):
    params = {"n": 8, "seed": 42}
    ingest.check_fingerprint(spark, str(tmp_path / "f"), params)
    ingest.check_fingerprint(spark, str(tmp_path / "f"), params)
    with pytest.raises(ingest.FingerprintError, match="n: 8 before, 16 now"):
        ingest.check_fingerprint(spark, str(tmp_path / "f"), {"n": 16, "seed": 42})
    ingest.check_fingerprint(spark, str(tmp_path / "f"), {"n": 16, "seed": 42}, force=True)
    (tmp_path / "in").mkdir()
    schema, sink = "id long, v double", str(tmp_path / "sink")
    put = lambda name, ids: (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "v": 1.0}) + "\n" for i in ids))
    put("a.json", range(40))
    run = lambda ledger: ingest.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), sink, str(tmp_path / ledger))
    count = lambda: ingest.sink_rows(spark, sink, schema).count()
    run("c1")
    assert count() == 40
    run("c1")
    assert count() == 40
    put("b.json", range(35, 45))
    run("c1")
    assert count() == 45
    run("c2")  # the ledger is lost: everything is read again, nothing is written twice
    assert count() == 45
    assert ingest.todo(spark.range(50).toDF("id"), ingest.sink_rows(spark, sink, schema)).count() == 5


def test_completion_stream_matches_batch(spark, tmp_path):
    rows = [(k, float(v), f"2024-01-01 00:{m:02d}:00") for k, m, v in [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 5), (3, 3, 1)]]
    df = spark.createDataFrame(rows, "key long, value double, at string").select("key", "value", F.to_timestamp("at").alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(9, 0.0, "2024-01-02 00:00:00")], "key long, value double, at string").select("key", "value", F.to_timestamp("at").alias("ts"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.drain(completion.completed(source, "key", 3), str(tmp_path / "out"), str(tmp_path / "c"))
    got = {r["key"]: (r["n"], r["total"], r["partial"]) for r in ingest.sink_rows(spark, str(tmp_path / "out"), completion.OUT).collect()}
    want = {r["key"]: (r["n"], r["total"], r["partial"]) for r in completion.completed_batch(df, "key", 3).collect()}
    assert got[1] == want[1] == (3, 6.0, False)
    assert all(got[k] == want[k] for k in got if k != 9)


def test_normal_quantile(spark):
    got = spark.createDataFrame([(0.001,), (0.5,), (0.975,)], "p double").select(resampling.normal_quantile(F.col("p"))).collect()
    assert [round(r[0], 5) for r in got] == [-3.09023, 0.0, 1.95996]
