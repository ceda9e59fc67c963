"""Readers and writers over files in the shared folder: what is written is read back by the engine's own readers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from votemill.operators import contracts, corpus, systems
from votemill.plans.registry import query
from votemill.sources.scratch import work
from votemill.plans.systems import A, by_seed
from votemill.sources import readers, schemas, writers
from votemill.sources.adapters import BALLOTS_SQL, ballots, gold, table
from votemill.streaming import ingest


def dump(spark, d):
    """The ballots as a dump: one row a problem with its samples in order."""
    sample = F.struct("pos", "ans", "logp", "trunc", "len")
    rows = ballots(spark, d).groupBy(F.col("id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(sample)).alias("s"))
    return rows.select("id", F.lit("0").alias("gold"), F.transform("s", lambda x: F.struct(x["ans"].alias("ans"), x["logp"].alias("logp"), x["trunc"].alias("trunc"), x["len"].alias("len"))).alias("samples"))


@query("jsonl_dump", f'WITH {BALLOTS_SQL} SELECT id::VARCHAR AS id, pos, ans, round(logp, 6) + 0.0 AS logp, trunc, "len" FROM b WHERE pos < 2')
def jsonl_dump(spark, d):
    """A dump written as JSON lines and read with the first two samples of each problem."""
    path = f"{work(spark)}/dump"
    writers.json_lines(dump(spark, d), path)
    rows = schemas.ballots(readers.json_lines(spark, path, "sample_dump"), 2)
    return rows.select("id", "pos", "ans", (F.round("logp", 6) + 0.0).alias("logp"), "trunc", "len")


@query("jsonl_glob", f"WITH {BALLOTS_SQL} SELECT 'part_' || system AS system, count(DISTINCT id) AS problems, count(*) AS samples FROM b GROUP BY system")
def jsonl_glob(spark, d):
    """Dumps of a glob, each labelled by the folder it lies in."""
    home = work(spark)
    for s in ("O", "F"):
        own = ballots(spark, d).filter(F.col("system") == s).groupBy(F.col("id").cast("string").alias("id")).agg(F.collect_list(F.struct("ans", "logp", "trunc", "len")).alias("samples"))
        writers.json_lines(own, f"{home}/part_{s}")
    rows = readers.dumps(spark, f"{home}/part_*/*.json", label=r"/(part_[^/]+)/[^/]+$")
    return schemas.ballots(rows).groupBy("system").agg(F.countDistinct("id").alias("problems"), F.count("*").alias("samples"))


@query("jsonl_last_wins", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE 'old' END AS gold FROM part")
def jsonl_last_wins(spark, d):
    """Of rows that share a key, the last one of the file."""
    path, p = f"{work(spark)}/twice", table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    old, new = p.select("id", F.lit("old").alias("gold")), p.filter("p_partkey % 3 = 0").select("id", F.lit("new").alias("gold"))
    writers.json_lines(old.unionByName(new).coalesce(1), path)
    return readers.last_wins(readers.json_lines(spark, path, "id string, gold string"))


@query("jsonl_tolerant", "SELECT count(*) FILTER (p_partkey % 5 <> 0) AS read, count(*) FILTER (p_partkey % 5 = 0) AS rejected FROM part")
def jsonl_tolerant(spark, d):
    """Malformed lines are left out and counted."""
    path = f"{work(spark)}/broken"
    line = F.when(F.col("p_partkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"))))
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    bad = readers.rejected_lines(spark, path, "bad_ids").agg(F.count("*").alias("rejected"))
    return readers.json_lines(spark, path, "bad_ids", tolerant=True).filter("id IS NOT NULL").agg(F.count("*").alias("read")).join(F.broadcast(bad))  # one row each


@query("csv_problems", "SELECT p_partkey::VARCHAR AS id, 'a \"quoted\"' || chr(10) || 'line, ' || p_name AS question, p_size::VARCHAR AS p_size FROM part")
def csv_problems(spark, d):
    """Problems of a CSV with other names, padded headers, quotes and line breaks in cells."""
    path = f"{work(spark)}/problems"
    rows = table(spark, d, "part").select(F.col("p_partkey").alias(" Problem_ID "), F.concat(F.lit('a "quoted"\nline, '), "p_name").alias("Question"), F.col("p_size").alias("p_size "))
    rows.write.option("header", True).option("escape", '"').csv(path)
    return contracts.require_unique(readers.problems(spark, path), "id")


@query("csv_answers", "SELECT c_custkey::VARCHAR AS id, (c_custkey * 7 - 5000)::VARCHAR AS answer FROM customer")
def csv_answers(spark, d):
    """A submission written as id,answer and read as texts."""
    path = f"{work(spark)}/answers"
    writers.answers_csv(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") * 7 - 5000).cast("string").alias("answer")), path)
    rows, header = readers.submission(spark, path)
    assert header == contracts.HEADER
    return rows


@query("csv_columns", "SELECT s_suppkey, s_nationkey FROM supplier")
def csv_columns(spark, d):
    path = f"{work(spark)}/columns"
    writers.columns_csv(table(spark, d, "supplier"), path, ["s_suppkey", "s_nationkey"])
    return spark.read.schema("s_suppkey long, s_nationkey long").option("header", True).csv(path)


@query("json_map", "SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey = 0 THEN 'BROKEN' ELSE 'OK' END AS verdict, n_regionkey::VARCHAR AS gold, NULL AS ours, CASE WHEN n_regionkey > 1 THEN (n_regionkey * 10)::VARCHAR END AS truth, n_name AS note FROM nation")
def json_map(spark, d):
    """A corrected key written as one JSON object, a null truth included, and read entry by entry."""
    path, c = f"{work(spark)}/key", F.col
    entry = F.struct(
        F.when(c("n_regionkey") == 0, "BROKEN").otherwise("OK").alias("verdict"), c("n_regionkey").alias("gold"), F.when(c("n_regionkey") > 1, c("n_regionkey") * 10).alias("truth"), c("n_name").alias("note")
    )
    whole = table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(c("n_nationkey").cast("string"), entry))).alias("m"))  # 25 entries
    whole.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return readers.corrected_key(spark, path)


@query("json_metrics", "SELECT 'customers' AS key, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'suppliers', count(*)::DOUBLE FROM supplier")
def json_metrics(spark, d):
    path = f"{work(spark)}/metrics"
    writers.metrics(spark, {"customers": float(table(spark, d, "customer").count()), "suppliers": float(table(spark, d, "supplier").count())}, path)
    return readers.json_map(spark, path, "double")


@query("vector_file", "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) + 0.0 AS total FROM embeddings")
def vector_file(spark, d):
    path = f"{work(spark)}/vectors"
    writers.vectors(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return spark.read.schema("vec_id long, embedding array<float>").parquet(path).select("vec_id", F.size("embedding").alias("n"), (F.round(total, 4) + 0.0).alias("total"))


#: Blocks of a file at most: a file is larger than a split, and is written by the task that read its documents.
FILE_ROWS = 100_000


def block_files(spark, d):
    """Documents as blocks of files, every fourth with a heading of its own; the folder."""
    k = F.col("doc_id")
    mark = F.element_at(F.array(F.lit("## ID: "), F.lit("###ID： "), F.lit("#### ID :")), (k % 3 + 1).cast("int"))
    text = F.concat(mark, k.cast("string"), F.lit("\n"), "text", F.when(k % 4 == 0, "\n## Notes\n#ID: 5\nend\n").otherwise(""))
    path = f"{work(spark)}/blocks"
    table(spark, d, "documents").filter("doc_id IS NOT NULL AND text IS NOT NULL").select(text.alias("value")).write.option("maxRecordsPerFile", FILE_ROWS).text(path)
    return path


STRIPPED = r"regexp_replace(regexp_replace(text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '## Notes' || chr(10) || '#ID: 5' || chr(10) || 'end' ELSE '' END, '^\s+', ''), '\s+$', '')"


@query("block_scan", f"SELECT doc_id, md5({STRIPPED}) AS solution_md5 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def block_scan(spark, d):
    """Blocks of large files, which are read in splits at their records."""
    found = corpus.teacher_blocks(readers.blocks(spark, block_files(spark, d)))
    return found.select(F.col("id").cast("long").alias("doc_id"), F.md5("solution").alias("solution_md5"))


@query("header_count", "SELECT count(DISTINCT doc_id) AS n FROM documents WHERE text IS NOT NULL")
def header_count(spark, d):
    return readers.count_headers(spark, block_files(spark, d))


@query("resume_fingerprint", "SELECT run, problems, refused FROM (SELECT count(*) AS n FROM orders), (VALUES ('same', 0, false), ('one more', 1, true), ('forced', 1, false)) t(run, more, refused), LATERAL (SELECT n + more AS problems)")
def resume_fingerprint(spark, d):
    """A run over the problems that is resumed with as many, with one more, and with one more by force; whether it was refused."""
    path, out, n = f"{work(spark)}/fingerprint", [], table(spark, d, "orders").count()
    ingest.check_fingerprint(spark, path, {"problems": n, "seed": 42})
    for name, problems, force in (("same", n, False), ("one more", n + 1, False), ("forced", n + 1, True)):
        try:
            ingest.check_fingerprint(spark, path, {"problems": problems, "seed": 42}, force)
            out.append((name, problems, False))
        except ingest.FingerprintError:
            out.append((name, problems, True))
    return spark.createDataFrame(out, "run string, problems long, refused boolean")


#: erfc by Simpson's rule, an independent way to the p-value.
ERFC = "1 - 2 / sqrt(pi()) * list_sum(list_transform(range(2001), lambda i: (CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(i / 2000.0 * x, 2)))) * x / 6000"


@query(
    "mcnemar_p",
    f"""WITH {A}, p AS (SELECT y.system, sum((x.ok AND NOT y.ok)::INT)::BIGINT AS b, sum((NOT x.ok AND y.ok)::INT)::BIGINT AS c FROM s x JOIN s y ON x.id = y.id AND x.system = 's0' AND y.system <> 's0' GROUP BY y.system),
  z AS (SELECT system, b, c, round((abs(b - c) - 1) / sqrt(b + c), 6) AS z FROM p WHERE b + c > 0) SELECT system, b, c, z, round({ERFC}, 6) AS p FROM (SELECT *, greatest(z, 0) / sqrt(2) AS x FROM z)""",
)
def mcnemar_p(spark, d):
    """Each other system against the first: the corrected z and its two-sided p-value."""

    @F.pandas_udf("double")
    def p_value(z: pd.Series) -> pd.Series:
        return z.map(systems.mcnemar_p)

    rows, out = by_seed(spark, d), None
    for s in ("s1", "s2"):
        one = systems.mcnemar(rows, "s0", s).filter("z IS NOT NULL").select(F.lit(s).alias("system"), "b", "c", "z", F.round(p_value("z"), 6).alias("p"))
        out = one if out is None else out.unionByName(one)
    return out
