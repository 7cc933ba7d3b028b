"""Queries do the whole job: rows that a cut would lose."""

import random
import re

import oracle
import pytest
from pyspark.sql import functions as F

from sitegrid.plans import queries as q


def test_runs_across_blocks(spark):
    from sitegrid import streaming

    rng, rows, run = random.Random(5), [], 0
    for p in range(2000):
        key = rng.choice("ab") if rng.random() < 0.3 or not rows else rows[-1][1]
        run += not rows or key != rows[-1][1]
        rows.append((p, key, run))
    df = spark.createDataFrame(rng.sample([r[:2] for r in rows], len(rows)), "pos long, chrom string")
    out = streaming.runs(df, ["chrom"], "pos")
    assert out.columns == ["pos", "chrom", "run"]
    assert sorted(map(tuple, out.collect())) == rows
    assert streaming.runs(df.where("false"), ["chrom"], "pos").count() == 0
    one = streaming.runs(df.withColumn("chrom", F.lit(None).cast("string")), ["chrom"], "pos")
    assert {r.run for r in one.collect()} == {1}


def test_runs_go_past_any_position(spark, tmp_path):
    """Positions on both sides of 4000."""
    spark.range(3900, 4100).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    out = q.queries()["w3_runs"](spark, str(tmp_path))
    assert out.count() == 200
    assert oracle.difference(out, q.oracle_sql()["w3_runs"], con) == ""


@pytest.mark.parametrize("name", ["s6_fasta", "i5_cytosines", "f1_context", "f2_revcomp", "x3_cytosine_pattern"])
def test_genome_takes_every_document(spark, tmp_path, name):
    """Long texts, other languages and nulls."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("acgtACGT xyz") for _ in range(n)) for n in (0, 1, 2, 99, 100, 101, 1999, 2001, 5000)]
    docs = [(i, t, "de" if i % 2 else "en", len(t)) for i, t in enumerate(texts)] + [(50, None, "en", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert oracle.difference(q.queries()[name](spark, str(tmp_path)), q.oracle_sql()[name], con) == ""


def test_planted_regions_come_out(spark, sf):
    found = q.queries()["d1_call_regions"](spark, sf).collect()
    assert found and all(r.z_sidak_p <= 0.05 for r in found)
    assert all(r.start % 3000 < 1000 for r in found)  # the planted ranges begin at multiples of 3000
    assert {r["sample"] for r in found} >= {"s1", "s2"}


@pytest.mark.parametrize("name", ["j9_class_lookup", "a2_merge_classes", "a3_matrix_per_class", "o1_by_order_table"])
def test_no_rows_are_dealt_by_sample_or_chrom_alone(spark, sf, name):
    """A few values that all rows share: dealt by them, the rows of one would meet in a task."""
    plan = q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((sample|chrom)#\d+, \d", plan)


def test_one_gzip_file_is_written_and_read_without_sorting_in_a_task(spark, tmp_path):
    """What comes before a single file stays in its own tasks, and its rows are dealt out as they are read."""
    from sitegrid.sources import text

    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("n"))
    text.write_text(keys.repartition(4, "k").sortWithinPartitions("k"), str(tmp_path / "t.gz"), compression="gzip", single=True)
    assert len(list((tmp_path / "t.gz").glob("part-*"))) == 1
    got = text.delimited(spark, str(tmp_path / "t.gz"), ["k", "n"], {"n": "H"}, dims=["k"], header=True)
    assert sorted((int(r.k), r.n) for r in got.collect()) == [(k, k % 2) for k in range(4000)]
    assert "RoundRobin" not in got._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 4000 / spark.sparkContext.defaultParallelism
