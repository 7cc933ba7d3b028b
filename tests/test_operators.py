"""Golden rows, edge cases and invariants of the site table operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitegrid import functions as fn
from sitegrid import model
from sitegrid.operators import aggregate, dmr, index, join, matrix, select, setops
from sitegrid.sources import text

GOLDEN = [("chr1", p, "+", c, 0, 1) for p, c in ((3001733, "CTG"), (3001743, "CAA"), (3001746, "CCT"), (3001747, "CTG"))]
GOLDEN += [("chr8", p, "-", c, 0, 1) for p, c in ((3002093, "CTG"), (3002098, "CAA"), (3002101, "CAG"), (3002102, "CCA"), (3002103, "CCC"))]
NAMES = ["chrom", "pos", "strand", "context", "mc", "cov"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def golden(spark):
    return model.assign_ids(spark.createDataFrame(GOLDEN, "chrom string, pos long, strand string, context string, mc int, cov int"), ["chrom"], ["pos"])


def test_golden_view_and_zip(golden):
    ref, data = golden.select("chrom", "id", "pos", "strand", "context"), golden.select("chrom", "id", "mc", "cov")
    assert rows(join.zip_rows(ref, data, ["chrom"]).select(NAMES)) == sorted(GOLDEN, key=repr)
    assert select.where_dims(golden, {"chrom": "chr8"}).count() == 5


def test_golden_range_by_reference(golden):
    ref, data = golden.select("chrom", "id", "pos", "strand", "context"), golden.select("chrom", "id", "mc", "cov")
    got = join.range_by_reference(ref, data, ["chrom"], "pos", {"chrom": "chr8"}, 3002101, 3002102)
    assert rows(got.select("context", "mc", "cov")) == [("CAG", 0, 1), ("CCA", 0, 1)]
    assert join.range_by_reference(ref, data, ["chrom"], "pos", {"chrom": "chr8"}, 1, 2).count() == 0


def test_uint32_round_trip(spark, tmp_path):
    values = [0, 1, 123456789, 4294967295, 2**40, -5]
    df = text.frame(spark, [("a", str(x)) for x in values], ["I"], ["n"], ["d"])
    df = model.assign_ids(df, ["d"], ["n"])
    text.write_keyed(df, str(tmp_path / "t"), ["d"])
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [0, 0, 1, 123456789, 4294967295, 4294967295]
    text.write_keyed(df, str(tmp_path / "t"), ["d"], mode="ignore")


def test_saturate_is_idempotent(spark):
    df = spark.createDataFrame([(x,) for x in (-(2**40), -1, 0, 255, 256, 2**40, None)], "x long")
    for code in "BHIbhiqd":
        once = df.select(fn.saturate(F.col("x"), code).alias("x"))
        assert rows(once) == rows(once.select(fn.saturate(F.col("x"), code).alias("x")))
    assert rows(df.select(fn.saturate(F.lit("abcdef"), "3s").alias("s")).distinct()) == [("abc",)]
    with pytest.raises(ValueError):
        fn.spark_type("x")


def test_regions_in_gaps_past_the_end_and_repeated(spark):
    ref = model.assign_ids(spark.createDataFrame([("c", p) for p in (10, 20, 30, 1000)], "chrom string, pos long"), ["chrom"], ["pos"])
    regions = spark.createDataFrame([("c", 12, 15, 1), ("c", 20, 30, 2), ("c", 2000, 3000, 3), ("c", 31, 5000, 4), ("c", 20, 30, 2), ("x", 1, 2, 5)], "chrom string, start long, stop long, name long")
    over = join.positions_to_ids(ref, regions, ["chrom"], width=16).select("name", "id_start", "id_end")
    assert rows(over) == [(1, 2, 2), (2, 2, 3), (2, 2, 3), (4, 4, 4)]
    inside = join.positions_to_ids(ref, regions, ["chrom"], boundary="contained", width=16).select("name", "id_start", "id_end")
    assert rows(inside) == [(2, 2, 3), (2, 2, 3), (4, 4, 4)]
    with pytest.raises(ValueError):
        join.positions_to_ids(ref, regions, ["chrom"], boundary="x")


def test_region_sums_equal_the_join(spark):
    random.seed(5)
    data = spark.createDataFrame([(f"c{i % 3}", i // 3 + 1, random.randrange(300), random.randrange(70000)) for i in range(600)], "chrom string, id long, mc long, cov long")
    idx = spark.createDataFrame([(f"c{k % 3}", k, s := random.randrange(1, 190), s + random.randrange(40)) for k in range(90)], "chrom string, name long, id_start long, id_end long")
    a = aggregate.region_sums(data, idx, ["chrom"], ["mc", "cov"]).select("name", "mc", "cov")
    assert rows(a) == rows(aggregate.region_sums_by_join(data, idx, ["chrom"], ["mc", "cov"]).select("name", "mc", "cov"))
    small = aggregate.running_sums(data, ["chrom"], ["mc"], block=16)
    assert rows(small) == rows(aggregate.running_sums(data, ["chrom"], ["mc"]))


def test_distributed_ids_equal_the_window(spark):
    df = spark.createDataFrame([(f"c{i % 2}", (i * 7919) % 5003) for i in range(5000)], "chrom string, pos long")
    assert rows(model.assign_ids(df, ["chrom"], ["pos"], distributed=True)) == rows(model.assign_ids(df, ["chrom"], ["pos"]))
    assert model.assign_ids(df.where("false"), ["chrom"], ["pos"], distributed=True).count() == 0


def test_align_keeps_reference_rows(spark):
    ref = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "chrom string, pos long")
    m = spark.createDataFrame([("c", 2, 5), ("c", 9, 7)], "chrom string, pos long, mc long")
    assert rows(join.align(ref, m, ["chrom", "pos"], {"mc": 0})) == [("c", 1, 0), ("c", 2, 5), ("c", 3, 0)]


def test_strand_merge_drops_the_odd_row(spark):
    df = spark.createDataFrame([("c", i, 10 * i, "+-"[i % 2 == 0], i, 2 * i) for i in range(1, 6)], "chrom string, id long, pos long, strand string, mc long, cov long")
    assert rows(aggregate.strand_merge(df, ["chrom"], ["mc", "cov"])) == [("c", 1, 3, 6), ("c", 2, 7, 14)]
    assert aggregate.strand_merge(df, ["chrom"], ["mc"], strict=True).count() == 0


def test_extract_renumbers_and_refuses_intervals(golden):
    idx = index.subset_index(golden, ["chrom"], match=F.col("context") == "CTG")
    assert rows(index.extract(golden.select("chrom", "id", "pos"), idx, ["chrom"])) == [("chr1", 1, 3001733), ("chr1", 2, 3001747), ("chr8", 1, 3002093)]
    with pytest.raises(ValueError):
        index.extract(golden, golden.withColumn("id_start", F.col("id")), ["chrom"])


def test_string_query_column_is_refused(golden):
    with pytest.raises(TypeError):
        select.point_range(golden, "context", 1, 2)


def test_patterns(golden):
    for p in ("CGN", "CHN", "+CGN", "-CGN"):
        select.by_context(golden, p).count()
    with pytest.raises(ValueError):
        select.by_context(golden, "CAN")


def test_cytosines_at_ends_and_chunk_borders(spark):
    random.seed(2)
    seqs = {"e": "", "a": "C", "b": "G", "c": "CG", "d": "GCN", "long": "".join(random.choice("ACGTN") for _ in range(500))}
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    want = []
    comp = dict(zip("ACGTN", "TGCAN", strict=True))
    for k, s in seqs.items():
        for i, ch in enumerate(s):
            if ch == "C":
                want.append((k, i + 1, "+", (s[i : i + 3] + "NN")[:3]))
            elif ch == "G":
                want.append((k, i + 1, "-", "".join(comp[x] for x in reversed(s[i - 2 : i + 1])) if i >= 2 else "CNN"))
    assert rows(index.cytosines(df, chunk=7)) == sorted(want, key=repr)


def test_fisher_textbook():
    assert fn.fisher_exact([3, 8, 0], [1, 2, 0], [1, 1, 0], [3, 5, 0]).round(4).tolist() == [0.4857, 0.035, 1.0]


def test_sig3(spark):
    got = spark.createDataFrame([(0.8125,), (0.1285,), (1 / 3,), (None,)], "x double").select(fn.sig3("x").alias("x")).collect()
    assert [r.x for r in got] == [0.812, 0.129, 0.333, None] or [r.x for r in got] == [float("%.3g" % 0.8125), float("%.3g" % 0.1285), 0.333, None]


def test_extremes_ties_and_nan(spark):
    m = spark.createDataFrame([("a", "s1", 0.5), ("a", "s2", 0.5), ("a", "s3", 0.1), ("b", "s1", float("nan")), ("b", "s2", 1.0), ("c", "s1", None)], "k string, sample string, v double")
    got = {r.k: r for r in aggregate.extremes(m, ["k"], "v").collect()}
    assert (got["a"].Hypo, got["a"].Hyper, got["a"].delta_beta) == ("s3", "s1", 0.4) and math.isnan(got["b"].Max) and "c" not in got


def test_mask(spark):
    m = spark.createDataFrame([("0.5", 0.01), ("1", 0.01), ("", 0.01), ("nan", 0.01), (None, 0.01)], "odd_ratio string, pval double")
    assert [r.pval for r in select.mask_unless_below(m).collect()] == [0.01, 1.0, 1.0, 1.0, 1.0]


def test_concat(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert rows(setops.concat({"b": b, "a": a}, title="t")) == [(1, "a"), (2, "b")]
    with pytest.raises(KeyError):
        setops.concat({"a": a}, order=["z"])


def test_matrix_round_trip(spark):
    m = spark.createDataFrame([("s1", "c", 1, 1, 2), ("s2", "c", 1, 3, 4), ("s1", "c", 2, 0, 5)], "sample string, chrom string, id long, mc long, cov long")
    wide = matrix.fisher(m, ["chrom", "id"], ["s1", "s2"])
    assert matrix.unpivot(wide, ["chrom", "id"], ["s1", "s2"]).count() == 4
    assert aggregate.merge_samples(m, ["chrom", "id"], ["mc", "cov"], ["B", "B"]).agg(F.sum("mc")).first()[0] == 4


def test_region_calling_finds_a_planted_region(spark):
    random.seed(11)
    sites = [("s", "c", 100 * i, 1e-5 if 200 <= i < 210 else random.random()) for i in range(400)]
    df = spark.createDataFrame(sites, "sample string, chrom string, pos long, pval double")
    called = dmr.significant(dmr.call_regions(df, ["sample", "chrom"], dist=300)).collect()
    assert any(r.start < 20000 + 500 and r.end >= 20900 - 500 and r.n_probes >= 8 for r in called)
    assert len(called) <= 3
    assert dmr.call_regions(df.where("false"), ["sample", "chrom"]).count() == 0


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("g", p) for p in (0.01, 0.04, 0.03, 0.005, 0.04)], "g string, p double")
    got = sorted(round(r.q, 6) for r in dmr.adjust(df, ["g"], "p", "q").collect())
    assert got == [0.025, 0.025, 0.04, 0.04, 0.04]


def test_text_skip_and_header(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# note\nchrom\tpos\nc1\t5\nc1\tbad\n")
    got = text.delimited(spark, str(tmp_path / "x.tsv"), ["chrom", "pos"], {"pos": "H"}, dims=["chrom"], header=True, skip=1)
    assert rows(got) == [("c1", 5), ("c1", None)]


def test_streaming_merge(spark, tmp_path):
    from sitegrid import streaming

    src = tmp_path / "in"
    spark.createDataFrame([("c", 1, 2), ("c", 1, 3)], "chrom string, pos long, mc long").coalesce(1).write.parquet(str(src))
    for _ in range(2):
        stream = spark.readStream.schema("chrom string, pos long, mc long").parquet(str(src))
        streaming.merge_into(stream, str(tmp_path / "out"), ["chrom", "pos"], ["mc"], str(tmp_path / "cp")).awaitTermination()
        spark.createDataFrame([("c", 1, 10), ("d", 4, 1)], "chrom string, pos long, mc long").coalesce(1).write.mode("append").parquet(str(src))
    got = streaming.merged(spark.read.parquet(str(tmp_path / "out")), ["chrom", "pos"], ["mc"])
    assert rows(got) == [("c", 1, 15), ("d", 4, 1)]


def test_ordinals_equal_the_window(spark):
    random.seed(9)
    df = spark.createDataFrame([(random.choice(["a", "b", None]), p) for p in random.sample(range(-500, 5000), 900)], "d string, pos long")
    assert rows(model.ordinals(df, ["d"], "pos", "id", width=64)) == rows(model.assign_ids(df, ["d"], ["pos"]).select("d", "pos", "id"))
    assert model.ordinals(df.where("false"), ["d"], "pos", "id").count() == 0


def test_clusters_across_blocks(spark):
    random.seed(4)
    sites, want = [(d, p) for d in "ab" for p in sorted(random.sample(range(3000), 250))], []
    for k, (d, p) in enumerate(sites):
        same = k and sites[k - 1][0] == d
        want.append((d, p, want[-1][2] + (p - sites[k - 1][1] > 12) if same else 1))
    df = spark.createDataFrame(sites, "d string, pos long")
    for width in (16, 100, 65_536):
        assert rows(dmr.clusters(df, ["d"], 12, width)) == sorted(want, key=repr)


def test_long_and_short_intervals(spark):
    random.seed(8)
    points = [("c", random.randrange(10**6)) for _ in range(300)]
    spans = [("c", s := random.randrange(10**6), s + random.choice([0, 3, 900, 70_000, 900_000]), k) for k in range(60)] + [("c", 9, 3, 99), ("x", 0, 10**6, 98)]
    got = join.points_in_intervals(spark.createDataFrame(points, "d string, pos long"), spark.createDataFrame(spans, "d string, start long, stop long, k int"), ["d"], "pos", "start", "stop", width=8)
    assert sorted((r.pos, r.k) for r in got.collect()) == sorted((p, k) for _, p in points for d, a, b, k in spans if d == "c" and a <= p <= b)


def test_first_at_or_after(spark):
    ref = model.assign_ids(spark.createDataFrame([("c", p) for p in (10, 20, 30)], "chrom string, pos long"), ["chrom"], ["pos"])
    points = spark.createDataFrame([("c", 5, 1), ("c", 20, 2), ("c", 21, 3), ("c", 31, 4), ("x", 1, 5)], "chrom string, pos long, k int")
    assert sorted((r.k, r.id) for r in join.first_at_or_after(ref, points, ["chrom"], width=8).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_cytosine_patterns(spark):
    df = spark.createDataFrame([("s", "CGCAGCTTé" + "CCG")], "chrom string, seq string")
    every = rows(index.cytosines(df, chunk=4))
    assert rows(index.cytosines(df, chunk=4, pattern="CHG")) == [r for r in every if r[3][1] in "ACT" and r[3][2] == "G"]
    assert rows(index.cytosines(df, pattern="CN")) == every and any(r[3] == "CTT" for r in every) and ("s", 10, "+", "CCG") in every
    with pytest.raises(ValueError):
        index.cytosines(df, pattern="G")


def test_fisher_of_large_counts():
    start = math.lgamma
    p = fn.fisher_exact([70_000, 10**7], [70_500, 10**7 + 3000], [60_000, 10**7 - 500], [61_000, 10**7])
    assert p[0] == pytest.approx(0.23160967828, rel=1e-7) and 0.69 < p[1] < 0.70
    assert fn.log_factorial([10, 100_000]).tolist() == pytest.approx([start(11), start(100_001)], rel=1e-12)


def test_combination_against_pairs():
    rng = random.Random(3)
    pos, z, r = [], [], []
    for _ in range(40):
        n = rng.randrange(1, 20)
        pos.append([rng.randrange(10**6) + x for x in sorted(rng.sample(range(900), n))])
        pos[-1].sort()
        z.append([rng.gauss(0, 1) for _ in range(n)])
        r.append([rng.random() for _ in range(3)])
    got = dmr.stouffer_liptak_all(pos, z, r, 100)
    for p, s, c, g in zip(pos, z, r, got, strict=True):
        lag = lambda a, b: max((abs(a - b) - 1) // 100, 0)
        var = sum(1.0 if i == j else (c[k] if (k := lag(a, b)) < 3 else 0.0) for i, a in enumerate(p) for j, b in enumerate(p))
        assert g == pytest.approx(0.5 * math.erfc(sum(s) / math.sqrt(2 * var)), rel=1e-12)


def test_streams_and_batches(spark):
    import io

    df = spark.createDataFrame([("a", 1, 300), ("a", 2, None), ("b", 1, 7)], "d string, id long, n int")
    out = io.StringIO()
    assert text.to_stream(df.orderBy("d", "id"), out) == 3 and out.getvalue() == "d\tid\tn\na\t1\t300\na\t2\t\nb\t1\t7\n"
    out.seek(out.getvalue().index("a"))
    assert rows(text.from_stream(spark, ["d", "id", "n"], {"id": "Q", "n": "B"}, out, ["d"])) == [("a", 1, 255), ("a", 2, None), ("b", 1, 7)]
    assert text.from_stream(spark, ["d"], {}, io.StringIO(""), ["d"]).count() == 0
    parts = list(text.local_batches(df, {"d": "a"}, 1))
    assert [len(p) for p in parts] == [1, 1] and text.to_frame(df, {"d": "a"})["id"].tolist() == [1, 2]


def test_append_and_ignore(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 6)], "d string, id long, n long")
    path = str(tmp_path / "t")
    for mode, n in (("error", 2), ("append", 4), ("ignore", 4), ("overwrite", 2)):
        text.write_keyed(df, path, ["d"], mode=mode)
        assert spark.read.parquet(path).count() == n


def test_sorted_compressed_matrix(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([("b", 2), ("a", 10), ("a", 9), ("b", 1)], "d string, id long").repartition(3)
    text.write_matrix(df, str(tmp_path / "m"), ["d", "id"])
    lines = [x for f in sorted((tmp_path / "m").glob("*.gz")) for x in gzip.open(f, "rt").read().splitlines() if not x.startswith("d\t")]
    assert lines == ["a\t9", "a\t10", "b\t1", "b\t2"]


def test_shared_folder_is_needed_on_a_cluster(monkeypatch):
    from sitegrid import storage

    class Given:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: Given()

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError):
        storage.shared_folder(Session())


def test_combined_scores_of_a_bin_equal_each_neighbourhood_alone():
    import numpy as np

    rng = random.Random(11)
    for n in (1, 2, 300):
        pos = np.sort(np.array([rng.randrange(10 * n) for _ in range(n)]))
        z, mine, by_lag = np.array([rng.gauss(0, 1) for _ in range(n)]), np.array([rng.random() < 0.7 for _ in range(n)]), [0.4, 0.2, 0.1]
        want = [dmr.stouffer_liptak(pos[near], z[near], by_lag, 10) for p in pos[mine] for near in [np.abs(pos - p) <= 25]]
        assert dmr.combined(pos, z, mine, by_lag, 10, 25).tolist() == want
