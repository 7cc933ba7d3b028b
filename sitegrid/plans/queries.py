"""One query per operator, by the operator's name in the survey, beside the oracle's SQL."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from .. import model
from ..operators import aggregate, dmr, index, join, matrix, select, setops
from ..sources import blocks, text
from . import views as v
from .views import CHROMS, SAMPLES, scratch, with_ctes

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _op(sql: str | None = None, *ctes: str):
    """Register a query under its function's name; without SQL only its rows can be checked."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_ctes(sql, *ctes)
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


CHROM = ["chrom"]
SITE = ["chrom", "id"]


def _cast(df: DataFrame, **kinds: str) -> DataFrame:
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else c for c in df.columns))


# Sources and sinks: written to the shared folder, read back through the source.


@_op("SELECT chrom, pos, strand, CAST(least(cov, 255) AS SMALLINT) AS cov FROM total", "total")
def s1_text_source(spark, sf):
    path = scratch(spark, "s1")
    text.write_text(v.total(spark, sf).select("chrom", "pos", "strand", "context", "mc", "cov"), path, header=False)
    names = ["chrom", "pos", "strand", "context", "mc", "cov"]
    return text.delimited(spark, path, names, {"pos": "Q", "strand": "c", "context": "3s", "mc": "H", "cov": "B"}, use=["pos", "strand", "cov"], dims=CHROM)


@_op("SELECT chrom, pos, context, CAST(least(mc, 65535) AS INTEGER) AS mc FROM total", "total")
def s2_gzip_source(spark, sf):
    path = scratch(spark, "s2")
    text.write_text(v.total(spark, sf).select("chrom", "pos", "context", "mc"), path, header=True, compression="gzip", single=True)
    return text.delimited(spark, path, ["chrom", "pos", "context", "mc"], {"pos": "Q", "context": "3s", "mc": "H"}, dims=CHROM, header=True)


@_op("SELECT chrom, pos, CAST(mc AS INTEGER) AS mc, CASE chrom WHEN 'chr3' THEN 0 WHEN 'chr1' THEN 1 WHEN 'chr5' THEN 3 END AS ord FROM total WHERE chrom IN ('chr3','chr1','chr5')", "total")
def s5_contig_scan(spark, sf):
    path, order = scratch(spark, "s5"), scratch(spark, "s5o")
    text.write_text(v.total(spark, sf).select("chrom", "pos", "mc"), path, header=False)
    spark.createDataFrame([(c, "x") for c in CHROMS], "chrom string, more string").coalesce(1).write.csv(order, sep="\t")
    return text.contigs(spark, path, ["chrom", "pos", "mc"], {"pos": "Q", "mc": "H"}, order=text.order_file(spark, order))


@_op("SELECT chrom, seq FROM genome WHERE seq <> ''", "genome")
def s6_fasta(spark, sf):
    path = scratch(spark, "s6")
    g = v.genome(spark, sf).where("seq <> ''")
    lines = F.concat(F.lit(">"), "chrom", F.lit(" x\n"), F.regexp_replace("seq", "(.{60})", "$1\n"))
    g.select(lines).write.text(path)
    return text.fasta(spark, path)


@_op("SELECT pos, strand FROM ref WHERE chrom='chr2'", "ref")
def s7_scan(spark, sf):
    return select.column_slice(select.where_dims(v.ref(spark, sf), {"chrom": "chr2"}), ["pos", "strand", "context"], 0, 2)


@_op("SELECT pos, strand, context FROM ref WHERE chrom='chr4'", "ref")
def s8_decoded_scan(spark, sf):
    raw = v.ref(spark, sf).select("chrom", "id", "pos", F.encode("strand", "UTF-8").alias("strand"), F.encode("context", "UTF-8").alias("context"))
    rows = select.where_dims(raw, {"chrom": "chr4"})
    return rows.select("pos", F.decode("strand", "UTF-8").alias("strand"), F.decode("context", "UTF-8").alias("context"))


@_op("SELECT sample, chrom, count(*) AS nrows FROM sites GROUP BY ALL", "sites")
def s12_chunk_directory(spark, sf):
    return model.chunk_directory(v.sites(spark, sf), ["sample", "chrom"])


@_op("SELECT * FROM (VALUES ('chr3',0),('chr1',1),('chr9',2),('chr5',3)) t(chrom, ord)")
def s15_order_file(spark, sf):
    path = scratch(spark, "s15")
    spark.createDataFrame([(c, "100") for c in CHROMS], "chrom string, n string").coalesce(1).write.csv(path, sep="\t")
    return text.order_file(spark, path)


@_op("SELECT sample, cell_class FROM classes", "classes")
def s16_class_table(spark, sf):
    path = scratch(spark, "s16")
    text.write_text(v.classes(spark), path, header=False)
    return text.class_table(spark, path)


@_op("SELECT chrom, start, stop, concat('r', CAST(region_id AS VARCHAR)) AS name FROM regions", "regions")
def s17_region_bed(spark, sf):
    path = scratch(spark, "s17")
    r = v.regions(spark, sf)
    text.write_text(r.select("chrom", "start", "stop", F.concat(F.lit("r"), F.col("region_id").cast("string"))), path, header=False)
    return text.region_bed(spark, path)


@_op("SELECT chrom, id, " + ", ".join(f"CAST(max(CASE WHEN sample='{s}' THEN mc END) AS DOUBLE) AS {s}" for s in SAMPLES) + " FROM m GROUP BY chrom, id", "m")
def s18_matrix_reader(spark, sf):
    path = scratch(spark, "s18")
    wide = matrix._pivot(v.m(spark, sf), SITE, SAMPLES, {"": F.col("mc")})
    text.write_text(wide, path)
    return text.matrix(spark, path, {"chrom": "string", "id": "long"}, SAMPLES)


@_op("SELECT chrom, id, pos, CAST(least(mc, 255) AS SMALLINT) AS mc, CAST(least(cov, 255) AS SMALLINT) AS cov FROM total", "total")
def k1_pack(spark, sf):
    path = scratch(spark, "k1")
    packed = model.typed(v.total(spark, sf), ["B", "B"], ["mc", "cov"], ["chrom", "id", "pos"])
    text.write_keyed(packed, path, CHROM)
    return spark.read.schema(packed.schema).parquet(path)


# Projection, filters, predicates.


@_op("SELECT chrom, pos, strand, context FROM ref", "ref")
def p1_view(spark, sf):
    return select.view(v.ref(spark, sf), ["pos", "strand", "context"], CHROM, [0])


@_op("SELECT * FROM m WHERE sample='s2' AND chrom='chr1'", "m")
def p2_dim_filter(spark, sf):
    return select.where_dims(v.m(spark, sf), {"sample": "s2", "chrom": "chr1"})


@_op("SELECT chrom, pos, id FROM ref WHERE chrom IN ('chr3','chr1','chr9','chr5')", "ref")
def p3_ordered_dims(spark, sf):
    return select.in_order(v.ref(spark, sf).select("chrom", "pos", "id"), "chrom", CHROMS)


@_op("SELECT strand, context FROM ref", "ref")
def p4_column_slice(spark, sf):
    return select.column_slice(v.ref(spark, sf), ["pos", "strand", "context"], 1, 3)


@_op("SELECT chrom, pos, strand, CASE WHEN NOT starts_with(context,'CG') THEN 'CHN' WHEN strand='+' THEN '+CGN' ELSE 'CGN' END AS kind FROM ref", "ref")
def p5_context(spark, sf):
    r = v.ref(spark, sf)
    cg = select.by_context(r, "CGN")
    parts = {"CHN": select.by_context(r, "CHN"), "+CGN": select.by_context(r, "+CGN"), "CGN": cg.where("strand <> '+'")}
    return setops.concat({k: d.select("chrom", "pos", "strand") for k, d in parts.items()}, title="kind")


@_op("SELECT * FROM ref WHERE pos BETWEEN 3000 AND 9000", "ref")
def p6_point_range(spark, sf):
    return select.point_range(v.ref(spark, sf), "pos", 3000, 9000)


@_op("SELECT * FROM regions WHERE start>=700 AND stop<=5000", "regions")
def p7_containment(spark, sf):
    return select.contained(v.regions(spark, sf), "start", "stop", 700, 5000)


@_op(
    "SELECT l_orderkey, CAST(least(greatest(x,0),255) AS SMALLINT) AS u8, CAST(least(greatest(x,-128),127) AS TINYINT) AS i8, CAST(least(greatest(x,0),65535) AS INTEGER) AS u16, substr(l_shipmode,1,3) AS s3 "
    "FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT)*CAST(l_suppkey AS BIGINT)*50-20000 AS x, l_returnflag||l_linestatus||'xx' AS l_shipmode FROM lineitem)"
)
def p9_saturate(spark, sf):
    x = F.expr("cast(l_quantity as bigint) * l_suppkey * 50 - 20000")
    t = v.table(spark, sf, "lineitem")
    s = fn.saturate
    return t.select("l_orderkey", s(x, "B").alias("u8"), s(x, "b").alias("i8"), s(x, "H").alias("u16"), s(F.concat("l_returnflag", "l_linestatus", F.lit("xx")), "3s").alias("s3"))


@_op("SELECT 'chr1' AS chrom, pos-1 AS start, pos, strand FROM ref WHERE chrom='chr1'", "ref")
def p10_derived(spark, sf):
    r = select.where_dims(v.ref(spark, sf), {"chrom": "chr1"})
    return r.select(F.lit("chr1").alias("chrom"), (F.col("pos") - 1).alias("start"), "pos", "strand")


@_op("SELECT chrom, start, stop, region_id/4000.0 AS z_sidak_p FROM regions WHERE region_id/4000.0 <= 0.05", "regions")
def p11_significant(spark, sf):
    return dmr.significant(v.regions(spark, sf).select("chrom", "start", "stop", F.expr("cast(region_id as double) / 4000.0D").alias("z_sidak_p")))


@_op(
    "SELECT sample, chrom, id, CASE WHEN coalesce(try_cast(o AS DOUBLE),1) >= 1 THEN 1.0 ELSE p END AS pval FROM "
    "(SELECT sample, chrom, id, CASE WHEN id%5=0 THEN '' ELSE CAST(CAST(mc AS DOUBLE)/cov*2 AS VARCHAR) END AS o, CAST(mc AS DOUBLE)/cov AS p FROM m)",
    "m",
)
def p13_mask(spark, sf):
    x = F.col("mc").cast("double") / F.col("cov")
    rows = v.m(spark, sf).select("sample", "chrom", "id", F.when(F.col("id") % 5 == 0, "").otherwise((x * 2).cast("string")).alias("odd_ratio"), x.alias("pval"))
    return select.mask_unless_below(rows).select("sample", "chrom", "id", "pval")


@_op("SELECT chrom, id, pos FROM ref WHERE chrom='chr3' AND id>=100", "ref")
def p14_offset_scan(spark, sf):
    return select.from_row(v.ref(spark, sf).select("chrom", "id", "pos"), 100, {"chrom": "chr3"})


# Joins.


@_op("SELECT r.chrom, r.id, r.pos, r.strand, r.context, t.mc, t.cov FROM ref r JOIN total t USING (chrom, id)", "total")
def j1_zip(spark, sf):
    return join.zip_rows(v.ref(spark, sf), v.total(spark, sf).select("chrom", "id", "mc", "cov"), CHROM)


@_op("SELECT chrom, id, pos, strand, context, mc, cov FROM total WHERE chrom='chr2' AND pos BETWEEN 300 AND 9000", "total")
def j2_range_by_reference(spark, sf):
    return join.range_by_reference(v.ref(spark, sf), v.total(spark, sf).select("chrom", "id", "mc", "cov"), CHROM, "pos", {"chrom": "chr2"}, 300, 9000)


@_op("SELECT g.region_id, g.start, g.stop, g.chrom, r.id, r.pos FROM regions g JOIN ref r ON r.chrom=g.chrom AND r.pos BETWEEN g.start AND g.stop", "ref", "regions")
def j3_multi_region(spark, sf):
    return join.points_in_intervals(v.ref(spark, sf).select("chrom", "id", "pos"), v.regions(spark, sf), CHROM, "pos", "start", "stop", 256)


@_op("SELECT r.chrom, r.pos, r.id, coalesce(s.mc,0) AS mc, coalesce(s.cov,0) AS cov FROM ref r LEFT JOIN (SELECT * FROM sites WHERE sample='s1') s USING (chrom, pos)", "ref", "sites")
def j4_align(spark, sf):
    s1 = select.where_dims(v.sites(spark, sf), {"sample": "s1"}).drop("sample")
    return join.align(v.ref(spark, sf).select("chrom", "pos", "id"), s1, ["chrom", "pos"], {"mc": 0, "cov": 0})


@_op("SELECT chrom, pos, CAST(least(cov,65535) AS INTEGER) AS cov FROM sites WHERE sample='s3'", "sites")
def j4b_pack_columns(spark, sf):
    return model.typed(select.where_dims(v.sites(spark, sf), {"sample": "s3"}), ["H"], ["cov"], ["chrom", "pos"])


@_op("SELECT t.chrom, t.id, t.mc, t.cov FROM total t JOIN (SELECT chrom, id FROM ref WHERE id%7=0 UNION ALL SELECT chrom, id FROM ref WHERE id%21=0) x USING (chrom, id)", "total")
def j5_by_ids(spark, sf):
    r = v.ref(spark, sf).select("chrom", "id")
    ids = r.where("id % 7 = 0").unionByName(r.where("id % 21 = 0"))
    return join.by_ids(v.total(spark, sf).select("chrom", "id", "mc", "cov"), ids, CHROM)


@_op("SELECT i.region_id, t.chrom, t.id, t.mc, t.cov FROM idx i JOIN total t ON t.chrom=i.chrom AND t.id BETWEEN i.id_start AND i.id_end", "idx", "total")
def j6_id_intervals(spark, sf):
    idx = index.region_index(v.ref(spark, sf), v.regions(spark, sf), CHROM)
    return join.by_id_intervals(v.total(spark, sf).select("chrom", "id", "mc", "cov"), idx, CHROM, 64).select("region_id", "chrom", "id", "mc", "cov")


@_op("SELECT chrom, id, pos, strand, context, mc, cov FROM total WHERE starts_with(context,'CG')", "total")
def j7_subset(spark, sf):
    r = v.ref(spark, sf)
    return index.subset(v.total(spark, sf).select("chrom", "id", "mc", "cov"), index.subset_index(r, CHROM, "CGN"), CHROM, r)


@_op("SELECT * FROM idx", "idx")
def j8_positions_to_ids(spark, sf):
    return join.positions_to_ids(v.ref(spark, sf), v.regions(spark, sf), CHROM)


@_op(
    "SELECT * FROM (SELECT g.chrom, g.start, g.stop, g.region_id, min(r.id) AS id_start, max(r.id) AS id_end FROM regions g JOIN ref r ON r.chrom=g.chrom AND r.pos BETWEEN g.start AND g.stop GROUP BY ALL)",
    "ref", "regions",
)
def j8_contained(spark, sf):
    return join.positions_to_ids(v.ref(spark, sf), v.regions(spark, sf), CHROM, boundary="contained", width=500)


@_op("SELECT m.*, c.cell_class FROM m JOIN classes c USING (sample)", "m", "classes")
def j9_class_lookup(spark, sf):
    return join.with_class(v.m(spark, sf), v.classes(spark))


@_op("SELECT g.*, d.n_dms, d.sname FROM regions g LEFT JOIN dmr d USING (chrom, start, stop)", "dmr")
def j11_dmr_attributes(spark, sf):
    return join.attributes(v.regions(spark, sf), v.dmr(spark, sf), ["chrom", "start", "stop"])


# Aggregation.


@_op("SELECT chrom, id, CAST(least(sum(mc),255) AS SMALLINT) AS mc, CAST(least(sum(cov),65535) AS INTEGER) AS cov FROM m GROUP BY chrom, id", "m")
def a1_merge_samples(spark, sf):
    return aggregate.merge_samples(v.m(spark, sf), SITE, ["mc", "cov"], ["B", "H"])


@_op("SELECT cell_class, chrom, id, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM m JOIN classes USING (sample) GROUP BY ALL", "m", "classes")
def a2_merge_classes(spark, sf):
    return aggregate.merge_classes(v.m(spark, sf), v.classes(spark), SITE, ["mc", "cov"])


@_op(
    "SELECT cell_class, chrom, id, " + ", ".join(f"max(CASE WHEN sample='{s}' THEN mc END) AS \"{s}.mc\", max(CASE WHEN sample='{s}' THEN cov END) AS \"{s}.cov\"" for s in SAMPLES) + " FROM m JOIN classes USING (sample) GROUP BY ALL",
    "m", "classes",
)
def a3_matrix_per_class(spark, sf):
    return matrix.counts(join.with_class(v.m(spark, sf), v.classes(spark)), ["cell_class", *SITE], SAMPLES)


@_op("SELECT i.chrom, i.start, i.stop, i.region_id, i.id_start, i.id_end, CAST(least(sum(t.mc),65535) AS INTEGER) AS mc, CAST(least(sum(t.cov),65535) AS INTEGER) AS cov FROM idx i JOIN total t ON t.chrom=i.chrom AND t.id BETWEEN i.id_start AND i.id_end GROUP BY ALL", "idx", "total")
def a4_region_sums(spark, sf):
    idx = index.region_index(v.ref(spark, sf), v.regions(spark, sf), CHROM)
    return aggregate.region_sums(v.total(spark, sf), idx, CHROM, ["mc", "cov"], ["H", "H"])


@_op(
    "SELECT chrom, CAST(k AS BIGINT)+1 AS id, CAST(sum(mc) AS BIGINT) AS mc, CAST(sum(cov) AS BIGINT) AS cov FROM (SELECT *, (row_number() OVER (PARTITION BY chrom ORDER BY id)-1)//2 AS k FROM total WHERE starts_with(context,'CG')) GROUP BY chrom, k HAVING count(*)=2",
    "total",
)
def a5_strand_merge(spark, sf):
    return aggregate.strand_merge(select.by_context(v.total(spark, sf), "CGN"), CHROM, ["mc", "cov"])


@_op("SELECT sample, chrom, id, mc, cov, CAST(sum(mc) OVER w AS BIGINT) AS mc_sum, CAST(sum(cov) OVER w AS BIGINT) AS cov_sum, CAST(sum(cov-mc) OVER w AS BIGINT) AS uc_sum FROM m WINDOW w AS (PARTITION BY chrom, id)", "m")
def a6_site_totals(spark, sf):
    return aggregate.site_totals(v.m(spark, sf).select("sample", *SITE, "mc", "cov"), SITE)


@_op(
    "SELECT chrom, id, arg_min(sample, (f, sample)) AS \"Hypo\", arg_max(sample, (f, -CAST(substr(sample,2) AS INTEGER))) AS \"Hyper\", min(f) AS \"Min\", max(f) AS \"Max\", max(f)-min(f) AS delta_beta FROM (SELECT *, CAST(mc AS DOUBLE)/cov AS f FROM m) GROUP BY ALL",
    "m",
)
def a7_extremes(spark, sf):
    rows = v.m(spark, sf).withColumn("f", fn.safe_ratio(F.col("mc"), F.col("cov")))
    return aggregate.extremes(rows, SITE, "f")


@_op("SELECT chrom, start, stop, string_agg(DISTINCT sname, ',' ORDER BY sname) AS sname FROM dmr GROUP BY ALL", "dmr")
def a8_joined_names(spark, sf):
    return aggregate.joined_names(v.dmr(spark, sf), ["chrom", "start", "stop"], "sname")


@_op("SELECT DISTINCT chrom, strand, context FROM m", "m")
def a9_distinct(spark, sf):
    return v.m(spark, sf).select("chrom", "strand", "context").distinct()


@_op("SELECT cell_class, string_agg(sample, ',' ORDER BY sample) AS samples FROM classes GROUP BY ALL", "classes")
def a10_class_members(spark, sf):
    return aggregate.class_members(v.classes(spark)).select("cell_class", F.concat_ws(",", "samples").alias("samples"))


@_op("SELECT chrom, count(*) AS nrows FROM ref GROUP BY chrom", "ref")
def a11_row_counts(spark, sf):
    return model.chunk_directory(v.ref(spark, sf), CHROM)


@_op("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*)>1")
def a12_repeated_keys(spark, sf):
    return model.repeated_keys(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@_op("SELECT max(length(p_name)) AS width FROM part")
def a13_name_width(spark, sf):
    return v.table(spark, sf, "part").agg(F.max(F.length("p_name")).cast("long").alias("width"))


@_op("SELECT chrom, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM ref GROUP BY chrom", "ref")
def a14_group_by_dims(spark, sf):
    return v.ref(spark, sf).repartition("chrom").groupBy("chrom").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))


@_op("SELECT chrom, start, stop, sample, round(beta, 9) AS beta FROM beta", "beta")
def a15_region_means(spark, sf):
    return _beta(spark, sf).withColumn("beta", F.round("beta", 9))


def _beta(spark, sf):
    points = v.m(spark, sf).select("sample", "chrom", "pos", fn.safe_ratio(F.col("mc"), F.col("cov")).alias("beta"))
    return aggregate.region_means(points, v.regions(spark, sf).drop("region_id"), CHROM, "beta", ["sample"], 256)


# Matrices.


def _pivot_sql(cell: str, suffix: str = "") -> str:
    return ", ".join(f"max(CASE WHEN sample='{s}' THEN {cell} END) AS \"{s}{suffix}\"" for s in SAMPLES)


@_op(f"SELECT chrom, id, {_pivot_sql('f')} FROM (SELECT *, CAST(printf('%.3g', CAST(mc AS DOUBLE)/cov) AS DOUBLE) AS f FROM m) GROUP BY chrom, id", "m")
def v1_fraction(spark, sf):
    return matrix.fraction(v.m(spark, sf), SITE, SAMPLES)


@_op("SELECT chrom, id, " + ", ".join(f"max(CASE WHEN sample='{s}' THEN mc END) AS \"{s}.mc\", max(CASE WHEN sample='{s}' THEN cov END) AS \"{s}.cov\"" for s in SAMPLES) + " FROM m GROUP BY chrom, id", "m")
def v2_counts(spark, sf):
    return matrix.counts(v.m(spark, sf), SITE, SAMPLES)


_FISHER = """SELECT sample, chrom, id, CASE WHEN b*c<>0 THEN CAST(a*d AS DOUBLE)/CAST(b*c AS DOUBLE) WHEN a*d<>0 THEN CAST('inf' AS DOUBLE) END AS odd_ratio, round(p, 9) AS pval FROM (
    SELECT sample, chrom, id, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d, least(1.0, sum(CASE WHEN lp <= lobs + ln(1+1e-7) THEN exp(lp) ELSE 0 END)) AS p FROM (
      SELECT *, lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(k+1)-lgamma(a+b-k+1)-lgamma(a+c-k+1)-lgamma(d-a+k+1) AS lp,
        lgamma(a+b+1)+lgamma(c+d+1)+lgamma(a+c+1)+lgamma(b+d+1)-lgamma(a+b+c+d+1)-lgamma(a+1)-lgamma(b+1)-lgamma(c+1)-lgamma(d+1) AS lobs FROM (
        SELECT *, unnest(range(greatest(0,a-d), least(a+b,a+c)+1)) AS k FROM (
          SELECT sample, chrom, id, mc AS a, cov-mc AS b, CAST(sum(mc) OVER w AS BIGINT)-mc AS c, CAST(sum(cov-mc) OVER w AS BIGINT)-(cov-mc) AS d FROM m WINDOW w AS (PARTITION BY chrom, id)))) GROUP BY sample, chrom, id)"""


@_op(_FISHER, "m")
def v3_fisher(spark, sf):
    return matrix.fisher_long(v.m(spark, sf), SITE).withColumn("pval", fn.rounded(F.col("pval"), 9))


@_op("SELECT chrom, id, " + ", ".join(f"max(CASE WHEN sample='{s}' THEN odd_ratio END) AS \"{s}.odd_ratio\", max(CASE WHEN sample='{s}' THEN pval END) AS \"{s}.pval\"" for s in SAMPLES) + f" FROM ({_FISHER}) GROUP BY chrom, id", "m")
def v3_fisher_matrix(spark, sf):
    wide = matrix.fisher(v.m(spark, sf), SITE, SAMPLES, rounded=False)
    return wide.select(*SITE, *(x for s in SAMPLES for x in (F.col(f"`{s}.odd_ratio`"), fn.rounded(F.col(f"`{s}.pval`"), 9).alias(f"{s}.pval"))))


@_op("SELECT r.chrom, r.pos-1 AS start, r.pos, r.strand, r.context, x.* EXCLUDE (chrom, id) FROM ref r JOIN (SELECT chrom, id, " + _pivot_sql("mc", ".mc") + " FROM m GROUP BY chrom, id) x USING (chrom, id)", "m")
def v4_with_reference(spark, sf):
    wide = matrix._pivot(v.m(spark, sf), SITE, SAMPLES, {".mc": F.col("mc")})
    return matrix.with_reference(wide, v.ref(spark, sf), CHROM)


@_op("SELECT sample, row_number() OVER (ORDER BY sample)-1 AS place FROM (SELECT DISTINCT sample FROM sites)", "sites")
def v5_sample_order(spark, sf):
    return spark.createDataFrame([(s, k) for k, s in enumerate(matrix.sample_names(v.sites(spark, sf)))], "sample string, place long")


_UNPIVOT = "SELECT s.sample, k.chrom, k.id, coalesce(f.pval, 1.0) AS pval, f.odd_ratio FROM (SELECT DISTINCT chrom, id FROM m) k CROSS JOIN (SELECT DISTINCT sample FROM m) s LEFT JOIN (SELECT sample, chrom, id, CASE WHEN coalesce(CAST(mc*2 AS DOUBLE)/cov,1)>=1 THEN 1.0 ELSE CAST(mc AS DOUBLE)/cov END AS pval, CAST(mc*2 AS DOUBLE)/cov AS odd_ratio FROM m) f USING (sample, chrom, id)"


@_op(_UNPIVOT, "m")
def v6_unpivot(spark, sf):
    mc, cov = F.col("mc").cast("double"), F.col("cov")
    wide = matrix._pivot(v.m(spark, sf), SITE, SAMPLES, {".odd_ratio": mc * 2 / cov, ".pval": mc / cov})
    return matrix.unpivot(wide, SITE, SAMPLES)


# Windows, order, sets.


@_op("SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS id FROM ref", "ref")
def w1_row_ids(spark, sf):
    return model.assign_ids(v.ref(spark, sf).select("chrom", "pos"), CHROM, ["pos"], distributed=True)


@_op("SELECT chrom, id, (id-1)//2 AS pair FROM ref", "ref")
def w2_pair_index(spark, sf):
    return v.ref(spark, sf).select("chrom", "id", F.floor((F.col("id") - 1) / 2).cast("long").alias("pair"))


@_op("SELECT pos, chrom, CAST(sum(n) OVER (ORDER BY pos) AS BIGINT) AS run FROM (SELECT pos, chrom, CASE WHEN chrom=lag(chrom) OVER (ORDER BY pos) THEN 0 ELSE 1 END AS n FROM ref)", "ref")
def w3_runs(spark, sf):
    from ..streaming import runs

    return runs(v.ref(spark, sf).select("pos", "chrom"), CHROM, "pos")


@_op("SELECT sample, chrom, pos, CAST(sum(n) OVER (PARTITION BY sample, chrom ORDER BY pos) AS BIGINT) AS cluster FROM (SELECT sample, chrom, pos, CASE WHEN pos-lag(pos) OVER (PARTITION BY sample, chrom ORDER BY pos)<=9 THEN 0 ELSE 1 END AS n FROM m)", "m")
def w5_clusters(spark, sf):
    return dmr.clusters(v.m(spark, sf).select("sample", "chrom", "pos"), ["sample", "chrom"], 9, 500)


@_op("SELECT chrom, id, pos FROM ref WHERE chrom IN ('chr3','chr1','chr5')", "ref")
def o1_by_order_table(spark, sf):
    order = spark.createDataFrame([(c, i) for i, c in enumerate(CHROMS)], "chrom string, ord int")
    return select.by_order_table(v.ref(spark, sf).select("chrom", "id", "pos"), "chrom", order).select("chrom", "id", "pos")


@_op("SELECT chrom, count(*) AS nrows FROM ref GROUP BY chrom ORDER BY chrom", "ref")
def o2_sorted_contigs(spark, sf):
    return model.chunk_directory(v.ref(spark, sf), CHROM).orderBy("chrom")


@_op("SELECT chrom, id, pos FROM ref ORDER BY chrom, id LIMIT 25", "ref")
def o4_limit(spark, sf):
    return v.ref(spark, sf).select("chrom", "id", "pos").orderBy("chrom", "id").limit(25)


@_op("SELECT chrom, pos, mc, cov FROM sites WHERE sample IN ('s1','s3','s4')", "sites")
def u1_concat(spark, sf):
    s = v.sites(spark, sf)
    parts = {k: select.where_dims(s, {"sample": k}).drop("sample") for k in SAMPLES}
    return setops.concat(parts, order=["s3", "s1", "s4"])


@_op("SELECT chrom, pos, mc, cov, concat('cell_', sample) AS cell FROM sites", "sites")
def u2_concat_named(spark, sf):
    s = v.sites(spark, sf)
    return setops.concat({k: select.where_dims(s, {"sample": k}).drop("sample") for k in SAMPLES}, title="cell", name=lambda n: f"cell_{n}")


@_op("SELECT chrom, pos, mc, cov, sample AS filename FROM sites", "sites")
def u2_file_names(spark, sf):
    path = scratch(spark, "u2")
    v.sites(spark, sf).write.partitionBy("sample").parquet(path)
    parts = {k: spark.read.parquet(f"{path}/sample={k}") for k in SAMPLES}
    named = {k: setops.with_file_name(d, folder=True, ext="") for k, d in parts.items()}
    return setops.concat(named).withColumn("filename", F.regexp_replace("filename", "^sample=", ""))


@_op("SELECT chrom, start, stop, n_dms, sname FROM dmr", "dmr")
def u3_concat_dmrs(spark, sf):
    d = v.dmr(spark, sf).withColumn("min_p", F.lit(0.01)).withColumn("z_p", F.lit(0.02)).withColumn("z_sidak_p", F.lit(0.03))
    return setops.concat_dmrs({s: d.where(F.col("sname") == s).drop("sname") for s in ("s1", "s3", "s6")})


# Indexes.


@_op("SELECT chrom, id FROM ref WHERE starts_with(context,'CG') AND strand='+'", "ref")
def i1_subset_index(spark, sf):
    return index.subset_index(v.ref(spark, sf), CHROM, "+CGN")


_BED = "bed AS (SELECT concat('chr', CAST(c_custkey%6+1 AS VARCHAR)) AS chrom, c_custkey*11 AS start, c_custkey*11+c_nationkey*40 AS stop, c_name AS name FROM customer)"


@_op(
    f"SELECT * FROM (SELECT g.*, (SELECT min(r.id) FROM ref r WHERE r.chrom=g.chrom AND r.pos>=g.start) AS id_start, coalesce((SELECT min(r.id) FROM ref r WHERE r.chrom=g.chrom AND r.pos>=g.stop), (SELECT max(r.id) FROM ref r WHERE r.chrom=g.chrom)) AS id_end FROM ({_BED.removeprefix('bed AS (').removesuffix(')')}) g) WHERE id_start IS NOT NULL",
    "ref",
)
def i2_region_index(spark, sf):
    """Named regions, among them those of a chromosome that the reference lacks and those past its last row."""
    k = F.col("c_custkey")
    bed = v.table(spark, sf, "customer").select(F.concat(F.lit("chr"), (k % 6 + 1).cast("string")).alias("chrom"), (k * 11).alias("start"), (k * 11 + F.col("c_nationkey") * 40).alias("stop"), F.col("c_name").alias("name"))
    return index.region_index(v.ref(spark, sf), bed, CHROM, width=1000)


@_op("SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY id) AS id, mc, cov FROM total WHERE starts_with(context,'CG')", "total")
def i3_extract(spark, sf):
    return index.extract(v.total(spark, sf).select("chrom", "id", "mc", "cov"), index.subset_index(v.ref(spark, sf), CHROM, "CGN"), CHROM)


_CONTEXT = "CASE WHEN c='C' THEN rpad(substr(seq, i, 3), 3, 'N') WHEN i<3 THEN 'CNN' ELSE translate(reverse(substr(seq, i-2, 3)), 'ACGT', 'TGCA') END"


@_op(f"SELECT chrom, i AS pos, CASE c WHEN 'C' THEN '+' ELSE '-' END AS strand, {_CONTEXT} AS context FROM (SELECT *, substr(seq, i, 1) AS c FROM (SELECT chrom, seq, unnest(range(1, length(seq)+1)) AS i FROM genome)) WHERE c IN ('C','G')", "genome")
def i5_cytosines(spark, sf):
    return index.cytosines(v.genome(spark, sf), chunk=100)


# Functions.


@_op(f"SELECT doc_id, CAST(count(*) AS BIGINT) AS n, context, CAST(sum(i) AS BIGINT) AS positions FROM (SELECT doc_id, i, {_CONTEXT} AS context FROM (SELECT *, substr(seq, i, 1) AS c FROM (SELECT doc_id, seq, unnest(range(1, length(seq)+1)) AS i FROM genome)) WHERE c IN ('C','G')) GROUP BY doc_id, context", "genome")
def f1_context(spark, sf):
    """The context of every C and G of every sequence, counted by document."""
    raw = v.genome(spark, sf).select("doc_id", F.col("seq").cast("binary").alias("q"), F.posexplode(F.split("seq", "")).alias("i", "c")).where("c in ('C', 'G')")
    near = F.substring(F.col("q"), F.greatest(F.col("i") - 1, F.lit(1)), F.least(F.col("i") + 3, F.lit(5))).cast("string")  # two letters to either side
    strand = F.when(F.col("c") == "C", "+").otherwise("-")
    at = raw.select("doc_id", "i", fn.context3(near, F.least(F.col("i") + 1, F.lit(3)), strand).alias("context"))
    return at.groupBy("doc_id", "context").agg(F.count("*").alias("n"), F.sum(F.col("i") + 1).alias("positions"))


@_op("SELECT doc_id, translate(reverse(seq),'ACGT','TGCA') AS rc FROM genome", "genome")
def f2_revcomp(spark, sf):
    return v.genome(spark, sf).select("doc_id", fn.revcomp(F.col("seq")).alias("rc"))


@_op("SELECT sample, chrom, id, CAST(printf('%.3g', CAST(mc AS DOUBLE)/cov) AS DOUBLE) AS f FROM m", "m")
def f4_sig3(spark, sf):
    return v.m(spark, sf).select("sample", *SITE, fn.sig3(fn.safe_ratio(F.col("mc"), F.col("cov"))).alias("f"))


@_op("SELECT chrom, id, CASE WHEN cov=0 THEN 0.0 ELSE CAST(mc AS DOUBLE)/cov END AS f FROM total", "total")
def f5_safe_ratio(spark, sf):
    return v.total(spark, sf).select(*SITE, fn.safe_ratio(F.col("mc"), F.col("cov")).alias("f"))


@_op("SELECT o_orderkey, o_orderkey*65536+o_custkey%65536 AS packed, o_orderkey AS block, o_custkey%65536 AS within_block FROM orders")
def f6_virtual_offset(spark, sf):
    packed = fn.make_offset(F.col("o_orderkey"), F.col("o_custkey"))
    block, within = fn.split_offset(packed)
    return v.table(spark, sf, "orders").select("o_orderkey", packed.alias("packed"), block.alias("block"), within.alias("within_block"))


@_op("SELECT page_id, regexp_replace(regexp_extract(url,'([^/]*)$',1), '\\.[^.]*$', '') AS name FROM pages")
def f9_sample_name(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", fn.sample_name(F.col("url")).alias("name"))


@_op("SELECT o_orderkey, CAST(o_totalprice AS VARCHAR)::DOUBLE AS price, CAST(o_custkey AS INTEGER) AS cust FROM orders")
def f10_casts(spark, sf):
    t = v.table(spark, sf, "orders")
    return t.select("o_orderkey", F.decode(F.encode(F.col("o_totalprice").cast("string"), "UTF-8"), "UTF-8").cast("double").alias("price"), F.col("o_custkey").cast("int").alias("cust"))


# Statistics.


def _planted(spark, sf):
    """p-values of all sites: small ones in planted regions, even ones made from the counts elsewhere."""
    even = (F.expr("(mc * 7919 + cov * 104729 + pos * 31) % 997").cast("double") + 0.5) / 997
    return v.m(spark, sf).select("sample", "chrom", "pos", F.when(F.col("pos") % 3000 < 160, F.lit(1e-5) * (F.col("pos") % 7 + 1)).otherwise(even).alias("pval"))


@_op()
def d1_call_regions(spark, sf):
    """p-values of every sample combined along each chrom, called and filtered; the planted regions must come out."""
    return dmr.significant(dmr.call_regions(_planted(spark, sf), ["sample", "chrom"], dist=300))


@_op(f"SELECT sample, chrom, pos, round(least(1.0, min(pval*n/k) OVER (PARTITION BY sample, chrom ORDER BY pval DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 12) AS q FROM (SELECT *, count(*) OVER (PARTITION BY sample, chrom ORDER BY pval) AS k, count(*) OVER (PARTITION BY sample, chrom) AS n FROM (SELECT sample, chrom, pos, CASE WHEN pos%3000<160 THEN 1e-5*(1+pos%7) ELSE ((mc*7919+cov*104729+pos*31)%997+0.5)/997 END AS pval FROM m))", "m")
def d2_adjusted(spark, sf):
    """Benjamini-Hochberg over every sample and chrom."""
    return dmr.adjust(_planted(spark, sf), ["sample", "chrom"], "pval", "q").select("sample", "chrom", "pos", F.round("q", 12).alias("q"))


@_op(
    'SELECT e.*, p.n_dms, q.sname FROM (SELECT chrom, start, stop, arg_min(sample, (b, sample)) AS "Hypo", arg_max(sample, (b, -CAST(substr(sample,2) AS INTEGER))) AS "Hyper", max(b) AS "Max", min(b) AS "Min", round(max(b)-min(b), 9) AS delta_beta FROM (SELECT *, round(beta, 9) AS b FROM beta) GROUP BY ALL) e '
    "LEFT JOIN (SELECT chrom, start, stop, arg_max(n_dms, sname) AS n_dms FROM dmr GROUP BY ALL) p USING (chrom, start, stop) LEFT JOIN (SELECT chrom, start, stop, string_agg(DISTINCT sname, ',' ORDER BY sname) AS sname FROM dmr GROUP BY ALL) q USING (chrom, start, stop) WHERE delta_beta >= 0.3",
    "beta", "dmr",
)
def d3_annotate(spark, sf):
    b = _beta(spark, sf).withColumn("beta", F.round("beta", 9))
    out = dmr.annotate(b, v.dmr(spark, sf), ["chrom", "start", "stop"])
    return out.withColumn("delta_beta", F.round("delta_beta", 9)).where("delta_beta >= 0.3")


# Hooks, and the functions in SQL.


@_op("SELECT chrom, id FROM ref WHERE context='CHN' AND strand='-' UNION ALL SELECT chrom, id FROM ref WHERE pos%10=1", "ref")
def x1_row_predicate(spark, sf):
    """Subset indexes by a predicate: a column, and a callable."""
    r = v.ref(spark, sf)
    by_column = index.subset_index(r, CHROM, match=(F.col("context") == "CHN") & (F.col("strand") == "-"))
    return by_column.unionByName(index.subset_index(r, CHROM, match=lambda d: d.where("pos % 10 = 1")))


@_op(
    "SELECT sample, chrom, id, translate(reverse(context),'ACGTN','TGCAN') AS rc, CASE WHEN cov=0 THEN 0.0 ELSE CAST(mc AS DOUBLE)/cov END AS f, CASE WHEN (cov-mc)*7<>0 THEN CAST(mc*5 AS DOUBLE)/((cov-mc)*7) WHEN mc*5<>0 THEN CAST('inf' AS DOUBLE) END AS o FROM (SELECT * REPLACE (replace(context,'H','C') AS context) FROM m)",
    "m",
)
def x1_sql_functions(spark, sf):
    """The functions used from spark.sql."""
    fn.register(spark)
    v.m(spark, sf).createOrReplaceTempView("site_rows")
    return spark.sql("SELECT sample, chrom, id, revcomp(replace(context, 'H', 'C')) AS rc, safe_ratio(mc, cov) AS f, odds_ratio(mc, cov - mc, 7, 5) AS o FROM site_rows")


@_op(
    'SELECT * FROM (SELECT chrom, start, stop, arg_min(sample, (b, sample)) AS "Hypo", arg_max(sample, (b, -CAST(substr(sample,2) AS INTEGER))) AS "Hyper", max(b)-min(b) AS delta_beta FROM (SELECT *, round(beta, 3) AS b FROM beta) GROUP BY ALL) WHERE delta_beta >= 0.4',
    "beta",
)
def p12_delta_cutoff(spark, sf):
    b = _beta(spark, sf).withColumn("beta", F.round("beta", 3))
    out = dmr.annotate(b, v.dmr(spark, sf), ["chrom", "start", "stop"], cutoff=0.4)
    return out.select("chrom", "start", "stop", "Hypo", "Hyper", "delta_beta")


@_op(f"SELECT r.chrom, r.pos-1 AS start, r.pos, r.strand, r.context, x.* EXCLUDE (chrom, id) FROM ref r JOIN (SELECT chrom, id, {_pivot_sql('CASE WHEN cov=0 THEN 0.0 ELSE CAST(mc AS DOUBLE)/cov END')} FROM m GROUP BY chrom, id) x USING (chrom, id)", "m")
def j10_matrix_reference(spark, sf):
    return matrix.with_reference(matrix.fraction(v.m(spark, sf), SITE, SAMPLES, rounded=False), v.ref(spark, sf), CHROM)


@_op("SELECT p.chrom, p.pos, p.c_custkey, min(r.id) AS id FROM (SELECT concat('chr', CAST(c_custkey%5+1 AS VARCHAR)) AS chrom, c_custkey*13 AS pos, c_custkey FROM customer) p JOIN ref r ON r.chrom=p.chrom AND r.pos>=p.pos GROUP BY ALL", "ref")
def w4_forward_search(spark, sf):
    k = F.col("c_custkey")
    points = v.table(spark, sf, "customer").select(F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"), (k * 13).alias("pos"), "c_custkey")
    return join.first_at_or_after(v.ref(spark, sf), points, CHROM, width=2000)


@_op("SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY id) AS id, pos, strand, mc, cov FROM total WHERE starts_with(context,'CG') AND strand='+'", "total")
def i4_extract_cg(spark, sf):
    t = v.total(spark, sf)
    return index.extract(t.select("chrom", "id", "pos", "strand", "mc", "cov"), index.subset_index(t, CHROM, "+CGN"), CHROM)


@_op("SELECT chrom, id, pos, mc, cov FROM total WHERE chrom='chr1'", "total")
def o3_kept_order(spark, sf):
    return select.where_dims(v.total(spark, sf).select("chrom", "id", "pos", "mc", "cov"), {"chrom": "chr1"}).sortWithinPartitions("id")


@_op("SELECT r_name AS region, CAST(least(n_nationkey*30, 255) AS SMALLINT) AS n, substr(n_name, 1, 3) AS s FROM nation JOIN region ON n_regionkey=r_regionkey")
def s4_frame_source(spark, sf):
    """A pandas frame in memory, keyed by a column of it."""
    both = v.table(spark, sf, "nation").join(v.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pdf = both.select(F.col("r_name").alias("region"), (F.col("n_nationkey") * 30).alias("n"), F.col("n_name").alias("s")).toPandas()
    return text.frame(spark, pdf, ["B", "3s"], ["n", "s"], ["region"])


# Chunks in memory, streams, and the block format.


@_op("SELECT c_custkey, CAST(least(c_nationkey*20, 255) AS SMALLINT) AS nation, substr(c_mktsegment, 1, 4) AS segment, substr(c_mktsegment, 1, 4) AS name FROM customer")
def s3_stream_source(spark, sf):
    """Text that comes over a stream, as K3 writes it."""
    stream = io.StringIO()
    text.to_stream(v.table(spark, sf, "customer").select("c_mktsegment", "c_custkey", (F.col("c_nationkey") * 20).alias("nation"), F.col("c_mktsegment").alias("name")), stream, header=False)
    stream.seek(0)
    rows = text.from_stream(spark, ["segment", "c_custkey", "nation", "name"], {"segment": "4s", "c_custkey": "Q", "nation": "B", "name": "4s"}, stream)
    return rows.select("c_custkey", "nation", "segment", "name")


@_op("SELECT chrom, (id-1)//700 AS batch, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM ref GROUP BY ALL", "ref")
def s10_batches(spark, sf):
    return text.batches(v.ref(spark, sf), 700).groupBy("chrom", "batch").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@_op("SELECT chrom, id, pos, strand, (id-1)//400 AS part FROM ref WHERE chrom='chr3'", "ref")
def s11_local_frame(spark, sf):
    """One chunk as pandas frames, batch by batch, and as one frame; they must be the same."""
    import pandas as pd

    rows = v.ref(spark, sf).select("chrom", "id", "pos", "strand")
    whole, parts = text.to_frame(rows, {"chrom": "chr3"}), list(text.local_batches(rows, {"chrom": "chr3"}, 400))
    joined = pd.concat([p.assign(part=k) for k, p in enumerate(parts)], ignore_index=True)
    assert joined.drop(columns="part").equals(whole)
    return spark.createDataFrame(joined, "chrom string, id long, pos long, strand string, part long")


_FORMATS = {"formats": "Q,c,3s,H", "columns": "pos,strand,context,mc", "dims": "chrom"}


def _block_folder(spark, sf, name):
    """The reference with its summed counts as files of the block format; None where the folder isn't a mounted one."""
    path = scratch(spark, name)
    blocks.register(spark)
    rows = v.total(spark, sf).select("chrom", "id", "pos", "strand", "context", F.least("mc", F.lit(65535)).cast("int").alias("mc"))
    rows.repartition("chrom").sortWithinPartitions("chrom", "id").drop("id").write.format("keyed_blocks").options(**_FORMATS).mode("append").save(path)
    return path


@_op("SELECT chrom, id, pos, strand, context, CAST(least(mc, 65535) AS INTEGER) AS mc FROM total WHERE chrom IN ('chr2', 'chr5')", "total")
def s9_k2_block_format(spark, sf):
    """Written as chunks of the block format and read back, with the filter on the dimension pushed to the chunks."""
    path = _block_folder(spark, sf, "s9")
    read = lambda c: spark.read.format("keyed_blocks").load(path).where(F.col("chrom") == c)
    return read("chr2").unionByName(read("chr5"))


@_op("SELECT chrom, count(*) AS nrows, (count(*)*14+65534)//65535 AS nblocks FROM total GROUP BY chrom", "total")
def s12_s14_block_metadata(spark, sf):
    """Chunks of block files from their headers and tails alone."""
    return blocks.chunk_table(spark, _block_folder(spark, sf, "s12")).select("chrom", "nrows", "nblocks")


@_op("SELECT chrom, k+1 AS block, (k*65535+13)//14+1 AS first_id FROM (SELECT chrom, unnest(range((count(*)*14+65534)//65535)) AS k FROM total GROUP BY chrom)", "total")
def s13_block_directory(spark, sf):
    """Blocks of block files, with the row id of the first record that starts in each."""
    return blocks.block_table(spark, _block_folder(spark, sf, "s13")).select("chrom", "block", "first_id")


@_op("SELECT chrom, id, CAST(max(CASE WHEN sample='s1' THEN cov END) AS DOUBLE) AS s1, CAST(max(CASE WHEN sample='s2' THEN cov END) AS DOUBLE) AS s2 FROM m GROUP BY chrom, id", "m")
def k5_sorted_matrix(spark, sf):
    """A matrix as sorted, compressed text, read back."""
    path = scratch(spark, "k5")
    text.write_matrix(matrix._pivot(v.m(spark, sf), SITE, SAMPLES[:2], {"": F.col("cov")}), path, SITE)
    return text.matrix(spark, path, {"chrom": "string", "id": "long"}, SAMPLES[:2])


@_op("SELECT chrom, pos, strand FROM ref", "ref")
def k4_k7_appended_text(spark, sf):
    """Packed in three steps, the second and third appended; a step that ignores what is there changes nothing."""
    path, r = scratch(spark, "k7"), v.ref(spark, sf).select("chrom", "id", "pos", "strand")
    for k in range(3):
        text.write_keyed(r.where(F.col("id") % 3 == k), path, CHROM, mode="append")
    text.write_keyed(r, path, CHROM, mode="ignore")
    return spark.read.schema(r.schema).parquet(path).select("chrom", "pos", "strand")


@_op("SELECT p_partkey, CAST(round_even(p_size/3.0, -1) AS BIGINT) AS tens FROM part")
def f8_nearest_ten(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", fn.nearest_tens(F.col("p_size")).alias("tens"))


@_op(f"SELECT chrom, i AS pos, CASE c WHEN 'C' THEN '+' ELSE '-' END AS strand, context FROM (SELECT *, {_CONTEXT} AS context FROM (SELECT *, substr(seq, i, 1) AS c FROM (SELECT chrom, seq, unnest(range(1, length(seq)+1)) AS i FROM genome)) WHERE c IN ('C','G')) WHERE regexp_matches(context, '^C[ACT]G')", "genome")
def x3_cytosine_pattern(spark, sf):
    return index.cytosines(v.genome(spark, sf), chunk=1000, pattern="CHG")
