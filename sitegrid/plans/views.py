"""Site tables derived from the star schema: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ordinals
from ..storage import new_folder

SAMPLES = [f"s{i}" for i in range(1, 8)]
CHROMS = ["chr3", "chr1", "chr9", "chr5"]

CTES = {
    "ref": """ref AS (SELECT chrom, pos, strand, context, row_number() OVER (PARTITION BY chrom ORDER BY pos) AS id FROM (
        SELECT concat('chr', CAST(CAST(floor(o_orderkey/2) AS BIGINT)%5+1 AS VARCHAR)) AS chrom, o_orderkey+1 AS pos,
        CASE WHEN o_orderkey%2=0 THEN '+' ELSE '-' END AS strand, CASE WHEN CAST(floor(o_orderkey/2) AS BIGINT)%3=0 THEN 'CGN' ELSE 'CHN' END AS context FROM orders))""",
    "sites": """sites AS (SELECT concat('s', CAST(l_linenumber AS VARCHAR)) AS sample, concat('chr', CAST(CAST(floor(l_orderkey/2) AS BIGINT)%5+1 AS VARCHAR)) AS chrom, l_orderkey+1 AS pos,
        CAST(sum(CAST(floor(CAST(l_quantity AS BIGINT)*CAST(round(l_discount*100) AS BIGINT)/10) AS BIGINT)) AS BIGINT) AS mc, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cov
        FROM lineitem GROUP BY l_linenumber, l_orderkey)""",
    "m": "m AS (SELECT s.sample, r.chrom, r.id, r.pos, r.strand, r.context, s.mc, s.cov FROM sites s JOIN ref r USING (chrom, pos))",
    "total": "total AS (SELECT r.chrom, r.id, r.pos, r.strand, r.context, CAST(coalesce(sum(s.mc),0) AS BIGINT) AS mc, CAST(coalesce(sum(s.cov),0) AS BIGINT) AS cov FROM ref r LEFT JOIN sites s USING (chrom, pos) GROUP BY ALL)",
    "regions": "regions AS (SELECT concat('chr', CAST(p_partkey%5+1 AS VARCHAR)) AS chrom, p_partkey*7 AS start, p_partkey*7+p_size*10 AS stop, p_partkey AS region_id FROM part)",
    "genome": "genome AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS chrom, regexp_replace(upper(text),'[^ACGT]','','g') AS seq FROM documents WHERE text IS NOT NULL)",
    "classes": "classes AS (SELECT * FROM (VALUES ('s1','A'),('s2','A'),('s3','A'),('s4','B'),('s5','B'),('s6','B'),('s7','B')) t(sample, cell_class))",
    "idx": """idx AS (SELECT * FROM (SELECT g.chrom, g.start, g.stop, g.region_id,
        (SELECT min(r.id) FROM ref r WHERE r.chrom=g.chrom AND r.pos>=g.start) AS id_start,
        coalesce((SELECT min(r.id) FROM ref r WHERE r.chrom=g.chrom AND r.pos>=g.stop), (SELECT max(r.id) FROM ref r WHERE r.chrom=g.chrom)) AS id_end FROM regions g) WHERE id_start IS NOT NULL)""",
    "beta": "beta AS (SELECT g.chrom, g.start, g.stop, m.sample, avg(m.mc/m.cov) AS beta FROM regions g JOIN m ON m.chrom=g.chrom AND m.pos BETWEEN g.start AND g.stop GROUP BY ALL)",
    "dmr": "dmr AS (SELECT chrom, start, stop, region_id%9+2 AS n_dms, concat('s', CAST(k AS VARCHAR)) AS sname FROM regions, (VALUES (1),(3),(6)) t(k) WHERE region_id%4<k AND region_id%3<>0)",
}
NEEDS = {"m": ["ref", "sites"], "total": ["ref", "sites"], "idx": ["ref", "regions"], "beta": ["ref", "sites", "m", "regions"], "dmr": ["regions"]}


def with_ctes(body: str, *names: str) -> str:
    """A statement with the named views, and those that they need, in front."""
    need: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in need:
            need.append(n)

    for n in names:
        add(n)
    return f"WITH {', '.join(CTES[n] for n in need)} {body}" if need else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chrom(key: str):
    return F.concat(F.lit("chr"), (F.floor(F.col(key) / 2) % 5 + 1).cast("string")).alias("chrom")


def ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference sites: chrom, pos, strand, context, id."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        _chrom("o_orderkey"), (k + 1).alias("pos"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), F.when(F.floor(k / 2) % 3 == 0, "CGN").otherwise("CHN").alias("context")
    )
    return ordinals(rows, ["chrom"], "pos", "id")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements: sample, chrom, pos, mc, cov."""
    q = F.col("l_quantity").cast("long")
    mc = F.floor(q * F.round(F.col("l_discount") * 100).cast("long") / 10).cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_orderkey").agg(F.sum(mc).alias("mc"), F.sum(q).alias("cov"))
    return rows.select(F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sample"), _chrom("l_orderkey"), (F.col("l_orderkey") + 1).alias("pos"), "mc", "cov")


def m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements with their reference row."""
    return sites(spark, sf_dir).join(ref(spark, sf_dir), ["chrom", "pos"]).select("sample", "chrom", "id", "pos", "strand", "context", "mc", "cov")


def total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples summed on every reference row."""
    sums = sites(spark, sf_dir).groupBy("chrom", "pos").agg(F.sum("mc").alias("mc"), F.sum("cov").alias("cov"))
    zero = F.lit(0).cast("long")
    return ref(spark, sf_dir).join(sums, ["chrom", "pos"], "left").select("chrom", "id", "pos", "strand", "context", F.coalesce("mc", zero).alias("mc"), F.coalesce("cov", zero).alias("cov"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (k % 5 + 1).cast("string")).alias("chrom"), (k * 7).alias("start"), (k * 7 + F.col("p_size") * 10).alias("stop"), k.alias("region_id"))


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, "A" if s < "s4" else "B") for s in SAMPLES], "sample string, cell_class string")


def dmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.array(F.lit(1), F.lit(3), F.lit(6)))
    rows = regions(spark, sf_dir).withColumn("k", k).where("region_id % 4 < k and region_id % 3 <> 0")
    return rows.select("chrom", "start", "stop", (F.col("region_id") % 9 + 2).alias("n_dms"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("sname"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one, for round trips through files."""
    return f"{new_folder(spark, 'round-trips')}-{name}"
