"""Views of the test tables as notes, retrieval items and published values, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit

# Published mean reciprocal ranks of 13 models in 4 cells, in panel order;
# site 0 discharge, site 0 imaging, site 1 discharge, site 1 imaging.
POINT = {
    "bge": (0.2802, 0.1811, 0.2815, 0.1835),
    "gte": (0.2966, 0.1954, 0.3013, 0.1994),
    "e5": (0.2275, 0.1676, 0.2420, 0.1392),
    "nomic": (0.3380, 0.1922, 0.2923, 0.1913),
    "mpnet": (0.2659, 0.1853, 0.2909, 0.1645),
    "minilm": (0.2333, 0.1709, 0.2644, 0.1560),
    "medcpt": (0.1517, 0.1461, 0.1743, 0.1463),
    "biolord": (0.1941, 0.1632, 0.2174, 0.1578),
    "bert-base": (0.0151, 0.0181, 0.0161, 0.0121),
    "biobert": (0.0187, 0.0256, 0.0240, 0.0108),
    "clinicalbert": (0.0250, 0.0690, 0.0330, 0.0434),
    "pubmedbert": (0.0287, 0.0488, 0.0358, 0.0313),
    "scibert": (0.0181, 0.0209, 0.0120, 0.0105),
}
CONTRASTIVE = list(POINT)[:8]
CELLS = ((0, "discharge"), (0, "imaging"), (1, "discharge"), (1, "imaging"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes of two sites and two genres."""
    d = table(spark, sf, "documents")
    return d.select(
        (F.substring("source", 4, 9).cast("int") % 2).alias("site"),
        F.when(F.col("lang") == "en", "en").otherwise("other").alias("genre"),
        (F.col("doc_id") % 150).cast("string").alias("patient"),
        (1990 + F.col("doc_id") % 35).cast("int").alias("year"),
        F.col("doc_id").alias("src_order"),
        "text",
    )


#: Vectors of each document of a cycle: windows in number by cell, varying within a cell, and up to ten.
ITEM_SIZES = (2, 3, 4, 5)
VARIED_SIZES = tuple(n for n in range(2, 6) for _ in range(4))
LONG_SIZES = tuple(n for n in range(2, 12) for _ in range(4))


def _starts(sizes: tuple[int, ...]) -> str:
    return ", ".join(str(sum(sizes[:i])) for i in range(len(sizes)))


def items(spark: SparkSession, sf: str, sizes: tuple[int, ...] = ITEM_SIZES, models: int = 8) -> tuple[DataFrame, DataFrame]:
    """Queries and windows: all vectors are dealt over documents of ``sizes``, over and over, of each the first being a query and the others windows; model m is 8 of the dimensions."""
    at = table(spark, sf, "embeddings").select("embedding", F.expr(f"vec_id div {sum(sizes)}").alias("cycle"), (F.col("vec_id") % sum(sizes)).alias("r"), F.expr(f"array({_starts(sizes)})").alias("starts"))
    e = at.withColumn("no", F.size(F.filter("starts", lambda x: x <= F.col("r"))) - 1).select("embedding", (F.col("cycle") * len(sizes) + F.col("no")).alias("doc_idx"), (F.col("r") - F.get("starts", "no")).alias("c"))
    m = e.select("doc_idx", "c", "embedding", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(models - 1).cast("bigint"))).alias("model"))
    v = unit(F.slice(F.col("embedding"), (8 * F.col("model") + 1).cast("int"), F.lit(8)))
    x = m.select((F.col("doc_idx") % 2).alias("site"), F.expr("(doc_idx div 2) % 2").alias("genre"), "model", "doc_idx", "c", v.alias("v"))
    return x.where("c = 0").drop("c"), x.where("c >= 1").withColumnRenamed("c", "chunk_no")


def varied(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items whose number of windows varies within a cell."""
    return items(spark, sf, VARIED_SIZES)


def long(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items of up to ten windows."""
    return items(spark, sf, LONG_SIZES)


def point(spark: SparkSession) -> DataFrame:
    rows = [(m, i, s, g, x) for i, (m, xs) in enumerate(POINT.items()) for (s, g), x in zip(CELLS, xs, strict=True)]
    return spark.createDataFrame(rows, "model string, panel_ord int, site int, genre string, mrr double")


def point_scopes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("full", m) for m in POINT] + [("contrastive", m) for m in CONTRASTIVE], "scope string, model string")


def item_scopes(spark: SparkSession) -> DataFrame:
    """All eight models of the items, and the first five."""
    return spark.createDataFrame([("full", m) for m in range(8)] + [("contrastive", m) for m in range(5)], "scope string, model bigint")


# --- the same for DuckDB

NOTES = """notes AS (SELECT substr(source, 4, 9)::INT % 2 AS site, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS genre,
  (doc_id % 150)::VARCHAR AS patient, (1990 + doc_id % 35)::INT AS year, doc_id AS src_order, text FROM documents)"""
KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\p{Nd}', '', 'g'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"


def items_sql(sizes: tuple[int, ...] = ITEM_SIZES, models: int = 8) -> str:
    return f"""e0 AS (SELECT *, vec_id // {sum(sizes)} AS cycle, vec_id % {sum(sizes)} AS r, [{_starts(sizes)}] AS starts FROM embeddings), e1 AS (SELECT *, len(list_filter(starts, lambda y: y <= r)) AS no FROM e0),
e AS (SELECT cycle * {len(sizes)} + no - 1 AS doc_idx, r - starts[no] AS c, unnest(range({models})) AS model, embedding::DOUBLE[] AS w FROM e1),
x0 AS (SELECT doc_idx % 2 AS site, (doc_idx // 2) % 2 AS genre, model, doc_idx, c, list_slice(w, 8 * model + 1, 8 * model + 8) AS w FROM e),
x1 AS (SELECT *, greatest(sqrt(list_inner_product(w, w)), 1e-9) AS size FROM x0),
x AS (SELECT site, genre, model, doc_idx, c, list_transform(w, lambda y: y / size) AS v FROM x1),
q AS (SELECT site, genre, model, doc_idx, v FROM x WHERE c = 0),
d AS (SELECT site, genre, model, doc_idx, c AS chunk_no, v FROM x WHERE c >= 1)"""


VARIED = items_sql(VARIED_SIZES)
LONG = items_sql(LONG_SIZES)
ITEMS = items_sql()
SCORES = """s AS (SELECT q.site, q.genre, q.model, q.doc_idx AS query_idx, d.doc_idx, max(list_inner_product(q.v, d.v)) AS score
  FROM q JOIN d ON q.site = d.site AND q.genre = d.genre AND q.model = d.model GROUP BY ALL)"""


def ranks_sql(scores: str = "s", out: str = "r") -> str:
    return f"""{out}0 AS (SELECT *, row_number() OVER (PARTITION BY site, genre, model, query_idx ORDER BY score DESC, doc_idx) AS rank,
  count(*) OVER (PARTITION BY site, genre, model, query_idx) AS n_docs FROM {scores}),
{out}1 AS (SELECT site, genre, model, query_idx, rank FROM {out}0 WHERE doc_idx = query_idx AND rank <= least(10, n_docs - 1)),
{out} AS (SELECT q.site, q.genre, q.model, q.doc_idx, z.rank, coalesce(1.0::DOUBLE / z.rank, 0.0::DOUBLE) AS rr, (coalesce(z.rank, 11) <= 1)::INT AS hit1, (coalesce(z.rank, 11) <= 10)::INT AS hit10
  FROM q LEFT JOIN {out}1 z ON q.site = z.site AND q.genre = z.genre AND q.model = z.model AND q.doc_idx = z.query_idx)"""


CELL_MEANS = "cell AS (SELECT site, genre, model, avg(rr) AS mrr, avg(hit1) AS hit1, avg(hit10) AS hit10, count(*) AS n FROM r GROUP BY ALL)"
