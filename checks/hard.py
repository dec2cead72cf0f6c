"""Images, prototypes, evolution and networks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from checks.inputs import DENSE_SQL, dense
from checks.registry import query, rounded, table
from foldmeter.operators import evolve, extractors, hog, prototypes, scaling, splits
from foldmeter.operators.network import Layer, NeuralNetwork
from foldmeter.session import cut_lineage, scratch_dir
from foldmeter.sources import paths


def _hog_sql(norm: str, pixel: str = "CAST(embedding[i] AS DOUBLE)") -> str:
    first = {
        "L1": "v / (sum(abs(v)) OVER b + 1e-5)",
        "L1-sqrt": "sqrt(v / (sum(abs(v)) OVER b + 1e-5))",
        "L2": "v / sqrt(sum(v * v) OVER b + 1e-10)",
        "L2-Hys": "least(v / sqrt(sum(v * v) OVER b + 1e-10), 0.2)",
    }[norm]
    second = "v / sqrt(sum(v * v) OVER b + 1e-10)" if norm == "L2-Hys" else "v"
    return f"""
WITH px AS (SELECT vec_id AS image_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, {pixel} AS v FROM embeddings, range(1, 65) t(i)),
g AS (SELECT image_id, y, x,
   CASE WHEN y IN (0, 7) THEN 0 ELSE lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - lag(v) OVER (PARTITION BY image_id, x ORDER BY y) END AS gy,
   CASE WHEN x IN (0, 7) THEN 0 ELSE lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - lag(v) OVER (PARTITION BY image_id, y ORDER BY x) END AS gx
   FROM px),
o AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, sqrt(gx * gx + gy * gy) AS mag, degrees(atan2(gy, gx)) AS deg FROM g),
binned AS (SELECT image_id, cy, cx, mag, CAST(floor(CASE WHEN deg >= 180 THEN deg - 180 WHEN deg < 0 THEN deg + 180 ELSE deg END / 20) AS INTEGER) AS bin FROM o),
hist AS (SELECT image_id, cy, cx, b.bin, coalesce(sum(mag) FILTER (n.bin = b.bin), 0) / 4 AS v
         FROM binned n, range(9) b(bin) GROUP BY ALL),
blocks AS (SELECT image_id, br, bc, cy - br AS iy, cx - bc AS ix, bin, v FROM hist, range(3) r(br), range(3) c(bc)
           WHERE cy BETWEEN br AND br + 1 AND cx BETWEEN bc AND bc + 1),
n1 AS (SELECT * EXCLUDE (v), {first} AS v FROM blocks WINDOW b AS (PARTITION BY image_id, br, bc)),
n2 AS (SELECT * EXCLUDE (v), {second} AS v FROM n1 WINDOW b AS (PARTITION BY image_id, br, bc))
SELECT image_id, CAST((((br * 3 + bc) * 2 + iy) * 2 + ix) * 9 + bin AS INTEGER) AS feature_ix, round(v, 6) AS value FROM n2
"""


def _hog(spark, sf_dir, norm):
    images = dense(spark, sf_dir).select(
        F.col("row_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"),
        F.col("features").alias("pixels"),
    )
    found = hog.hog_features(images, 9, 2, 2, 2, 2, norm)
    return rounded(found.select("image_id", F.posexplode("features").alias("feature_ix", "value")))


for _name, _norm in (("hog_features", "L2-Hys"), ("hog_l1", "L1"), ("hog_l1_sqrt", "L1-sqrt"), ("hog_l2", "L2")):
    query(_name, _hog_sql(_norm))(lambda spark, sf_dir, norm=_norm: _hog(spark, sf_dir, norm))


def _png(rows: np.ndarray) -> bytes:
    """A grey image of 8 bits."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = rows.shape
    lines = b"".join(b"\0" + r.tobytes() for r in rows)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def _write_images(df, folder: str):
    """(row_id, file name) of one image file per row, written by the tasks."""

    def write(parts):
        fs, root = FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for part in parts:
            for i, vector in zip(part.row_id, part.features):
                grey = np.clip(np.floor(np.asarray(vector) * 40 + 128.5), 0, 255).astype(np.uint8)
                with fs.open_output_stream(f"{root}/{i}.png") as out:
                    out.write(_png(grey.reshape(8, 8)))
            yield part[["row_id"]].assign(picture=part.row_id.astype(str) + ".png")

    return df.mapInPandas(write, "row_id long, picture string")


@query("image_hog", _hog_sql("L2-Hys", "CAST(greatest(0, least(255, floor(CAST(embedding[i] AS DOUBLE) * 40 + 128.5))) AS DOUBLE)"))
def image_hog(spark, sf_dir):
    """Every embedding as an image file; rows name the files, by relative and by absolute path."""
    folder = scratch_dir(spark)
    written = cut_lineage(_write_images(dense(spark, sf_dir).select("row_id", "features"), folder))
    path = F.when(F.col("row_id") % 2 == 0, F.col("picture")).otherwise(F.concat(F.lit(folder + "/"), "picture"))
    rows = paths.image_attribute(written.select("row_id", path.alias("picture")), "picture", folder)
    found = extractors.Hog(9, 2, 2, 2, 2, "L2-Hys").features(rows, "picture")
    return rounded(found.select(F.col("row_id").alias("image_id"), F.posexplode("features").alias("feature_ix", "value")))


@query(
    "path_text",
    "SELECT c_custkey AS row_id, c_mktsegment AS label, n_name || ' in region ' || n_regionkey AS nation "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def path_text(spark, sf_dir):
    """Customers point to a text file per nation, by relative and by absolute path."""
    folder = scratch_dir(spark)
    nations = table(spark, sf_dir, "nation")
    line = F.concat("n_name", F.lit(" in region "), F.col("n_regionkey").cast("string"))
    nations.select(line.alias("value"), F.concat(F.lit("n"), "n_nationkey").alias("key")).write.partitionBy("key").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(
        F.regexp_extract("path", r"key=n(\d+)/", 1).cast("int").alias("c_nationkey"),
        F.regexp_extract("path", r"(key=n\d+/[^/]+)$", 1).alias("relative"),
    )
    path = F.when(F.col("c_custkey") % 2 == 0, F.col("relative")).otherwise(F.concat(F.lit(folder + "/"), "relative"))
    customers = table(spark, sf_dir, "customer").join(files, "c_nationkey")
    rows = customers.select(F.col("c_custkey").alias("row_id"), F.col("c_mktsegment").alias("label"), path.alias("nation"))
    replaced = paths.text_attribute(rows, "nation", folder)
    return replaced.withColumn("nation", F.regexp_replace("nation", "\n$", ""))


# Fixed gene table: the first rows of each class, and of the next one as outer slots.
GENES_SQL = f"""
WITH {DENSE_SQL},
firsts AS (SELECT label_ix, features, CAST(row_number() OVER (PARTITION BY label_ix ORDER BY row_id) - 1 AS INTEGER) AS r FROM base),
genes AS (
  SELECT i.individual, label_ix AS class, r AS slot, 1e0 - 1e-1 * r AS value, features AS vector FROM firsts, range(2) i(individual) WHERE r < 2 + i.individual
  UNION ALL
  SELECT i.individual, (label_ix + 9) % 10, 10 + r, -1e0 + 2e-1 * r, features FROM firsts, range(2) i(individual) WHERE r < 3),
dist AS (SELECT q.row_id, q.label_ix, individual, class, slot, value,
           sqrt(list_sum(list_transform(range(1, 65), lambda j: (q.features[j] - g.vector[j]) ** 2))) AS d FROM base q, genes g),
sided AS (SELECT *, row_number() OVER (PARTITION BY row_id, individual, class, value > 0 ORDER BY d, slot) AS side_rank,
            row_number() OVER (PARTITION BY row_id, individual, class ORDER BY d, slot) AS all_rank FROM dist),
nearest AS (SELECT row_id, label_ix, individual, class, value AS rating FROM sided WHERE all_rank = 1),
used AS (SELECT *, CASE WHEN value > 0 THEN 1 ELSE 2 END AS part, side_rank AS r FROM sided WHERE side_rank <= 2),
used3 AS (SELECT * FROM used UNION ALL SELECT *, 0, all_rank FROM sided WHERE all_rank <= 2),
two AS (SELECT row_id, label_ix, individual, class, CASE WHEN min(d) = 0 THEN arg_min(value, part * 10 + r) FILTER (d = 0) ELSE sum(value / d) / sum(1 / d) END AS rating
        FROM used GROUP BY ALL),
three AS (SELECT row_id, label_ix, individual, class, CASE WHEN min(d) = 0 THEN arg_min(value, part * 10 + r) FILTER (d = 0) ELSE sum(value / d) / sum(1 / d) END AS rating
        FROM used3 GROUP BY ALL)
"""


def _genes(df, fun):
    from pyspark.sql import Window as W

    firsts = df.withColumn("r", F.row_number().over(W.partitionBy("label_ix").orderBy("row_id")) - 1).filter("r < 3")
    both = firsts.withColumn("individual", F.explode(F.array(F.lit(0), F.lit(1))))
    own = both.filter("r < 2 + individual").select(
        "individual", F.col("label_ix").alias("class"), F.col("r").alias("slot"), (1 - 0.1 * F.col("r")).alias("value"), "features"
    )
    outer = both.select(
        "individual", ((F.col("label_ix") + 9) % 10).alias("class"), (F.col("r") + 10).alias("slot"), (-1 + 0.2 * F.col("r")).alias("value"), "features"
    )
    genes = own.unionByName(outer).withColumnRenamed("features", "vector").withColumn("fun", F.lit(fun))
    return prototypes.population_of(genes)


def _ratings(spark, sf_dir, fun):
    df = dense(spark, sf_dir)
    rated = prototypes.ratings(df, _genes(df, fun)).select("row_id", F.explode("ratings").alias("x"))
    return rounded(rated.select("row_id", "x.individual", "x.class", F.col("x.value").alias("rating")))


for _name, _fun, _cte in (("proto_nearest", "nearest", "nearest"), ("proto_2x2", "2+2", "two"), ("proto_2x2x2", "2+2+2", "three")):
    query(
        _name,
        GENES_SQL + f"SELECT row_id, CAST(individual AS INTEGER) AS individual, class, round(rating, 6) AS rating FROM {_cte}",
    )(lambda spark, sf_dir, fun=_fun: _ratings(spark, sf_dir, fun))

_CLASSIFIED = GENES_SQL + (
    ", classified AS (SELECT row_id, label_ix, individual, class FROM two "
    "QUALIFY row_number() OVER (PARTITION BY row_id, individual ORDER BY rating DESC, class) = 1) "
)


@query("proto_classify", _CLASSIFIED + "SELECT row_id, CAST(individual AS INTEGER) AS individual, class AS predicted_ix FROM classified")
def proto_classify(spark, sf_dir):
    df = dense(spark, sf_dir)
    return prototypes.classify(df, _genes(df, "2+2"))


@query(
    "proto_fitness",
    _CLASSIFIED
    + "SELECT CAST(individual AS INTEGER) AS individual, round(avg(CASE WHEN class = label_ix THEN 1.0 ELSE 0.0 END), 6) AS fitness "
    "FROM classified GROUP BY individual",
)
def proto_fitness(spark, sf_dir):
    df = dense(spark, sf_dir)
    return rounded(prototypes.fitness(df, _genes(df, "2+2")))


@query("proto_train")
def proto_train(spark, sf_dir):
    df = dense(spark, sf_dir).persist()
    model = evolve.EvolvedPrototypes(random_seed=1).fit(df)
    return model.predict(df)


def _network(train):
    scaler = scaling.min_max(train, -1, 1)
    net = NeuralNetwork([Layer(32, "relu"), Layer(16, "sigmoid")], random_seed=1)
    return scaler, net.fit(scaler.transform(train), 10)


@query("mlp_cv")
def mlp_cv(spark, sf_dir):
    df = splits.stratified_k_fold(dense(spark, sf_dir), 5).persist()
    out = None
    for step in range(5):
        train, test = splits.fold_roles(df, step)
        scaler, model = _network(train)
        part = model.predict(scaler.transform(test))
        out = part if out is None else out.unionByName(part)
    return df.select("row_id", "fold", "label_ix").join(out, "row_id")


@query("epoch_log")
def epoch_log(spark, sf_dir):
    _, model = _network(dense(spark, sf_dir))
    return rounded(model.epoch_log(spark))
