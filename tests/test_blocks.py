"""Round trips of the block format, with chunks beyond one block and records that straddle blocks."""

import random

import pytest
from pyspark.sql import functions as F

from sitegrid.sources import blocks


def test_round_trip_through_spark(spark, tmp_path):
    blocks.register(spark)
    rng = random.Random(1)
    rows = [(f"chr{i % 2}", i, rng.choice("+-"), rng.choice(["CGA", "CT", ""]), rng.randrange(2**16)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "chrom string, pos long, strand string, context string, mc int")
    path = str(tmp_path / "t")
    opts = {"formats": "Q,c,3s,H", "columns": "pos,strand,context,mc", "dims": "chrom"}
    df.repartition(2, "chrom").sortWithinPartitions("chrom", "pos").write.format("keyed_blocks").options(**opts).mode("append").save(path)
    back = spark.read.format("keyed_blocks").load(path)
    assert sorted(map(tuple, back.drop("id").collect())) == sorted(rows)
    one = back.where("chrom = 'chr1'")
    assert one.count() == 10_000 and one.agg(F.min("id"), F.max("id")).first()[:] == (1, 10_000)
    assert back.where("chrom = 'nope'").count() == 0


def test_directory_and_uint32(tmp_path):
    head = blocks.Header(["I"], ["n"], ["d"], "note")
    path = str(tmp_path / "x.cz")
    values = [0, 1, 123456789, 4294967295] * 20_000
    with open(path, "wb+") as f:
        w = blocks.ChunkWriter(f, head)
        for v in values:
            w.write(("a",), (v,))
        w.write(("b",), (7,))
        with pytest.raises(ValueError):
            w.write(("a",), (1,))
        w.close()
    got, chunks = blocks.directory(path)
    assert (got, [(c.values, c.rows) for c in chunks]) == (head, [(("a",), 80_000), (("b",), 1)])
    assert [r[0] for r in blocks.records(chunks[0], head)] == values


def test_cut_off_files_are_refused(tmp_path):
    head, path = blocks.Header(["I"], ["n"], ["d"]), str(tmp_path / "x.cz")
    with open(path, "wb+") as f:
        w = blocks.ChunkWriter(f, head)
        for v in range(60_000):
            w.write((str(v // 30_000),), (v,))
        w.close()
    whole = open(path, "rb").read()
    assert len(blocks.directory(path)[1]) == 2
    for bad in (whole[: len(whole) // 2], whole[:-5], whole + b"x", whole.replace(blocks.CHUNK_MARK, b"XX", 1)):
        open(path, "wb").write(bad)
        with pytest.raises(ValueError):
            blocks.directory(path)


def test_uint32_through_spark_and_metadata(spark, tmp_path):
    blocks.register(spark)
    values, path = [0, 1, 123456789, 4294967295], str(tmp_path / "t")
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5)], "d string, n long").coalesce(1)
    df.write.format("keyed_blocks").options(formats="I", columns="n", dims="d", message="note").mode("append").save(path)
    assert [r.n for r in spark.read.format("keyed_blocks").load(path).where("d = 'a'").orderBy("id").collect()] == values
    chunks = {r.d: r for r in blocks.chunk_table(spark, path).collect()}
    assert {d: (r.nrows, r.nblocks) for d, r in chunks.items()} == {"a": (4, 1), "b": (1, 1)}
    assert blocks.header(chunks["a"].file) == blocks.Header(["I"], ["n"], ["d"], "note")
    assert [(r.d, r.block, r.first_id) for r in blocks.block_table(spark, path).orderBy("d").collect()] == [("a", 1, 1), ("b", 1, 1)]
