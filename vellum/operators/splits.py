"""Splits of exact size, batches, samples, and rows multiplied by augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import numbered

def head_tail(df: DataFrame, order: list, part: int, of: int, *, lossy: bool = False, names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """The first part / of rows of an order and the rest, sizes exact; lossy leaves out the row at the border."""
    border = F.floor(F.col("all_") * part / of)
    own = numbered(df, order)
    own = own.where(F.col("i_") != border) if lossy else own
    return own.withColumn("split", F.when(F.col("i_") < border, names[0]).otherwise(names[1])).drop("i_", "all_")


def shuffled(df: DataFrame, key: list[str], seed: int, part: int, of: int, **options) -> DataFrame:
    """A random split of exact size: the order is a hash of key and seed, then the key."""
    return head_tail(df.withColumn("hash_", F.xxhash64(*key, F.lit(seed))), ["hash_", *key], part, of, **options).drop("hash_")


def last_of(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]))).where(F.col("r_") <= k).drop("r_")


def batched(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return numbered(df, order).withColumn("batch", F.floor(F.col("i_") / size)).drop("i_", "all_")


def with_replacement(df: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """n draws of any rows: each draw's hash picks a position."""
    rows = numbered(df, order)
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("i_"))
    return draws.join(rows.drop("all_"), "i_").drop("i_")


def augmented_names(df: DataFrame, stem: str, most: int) -> DataFrame:
    """Each row once for every rotation from -most to most degrees, with and without noise; names carry both."""
    angles, noise = F.explode(F.array(*[F.lit(a) for a in range(-most, most + 1)])), F.explode(F.array(F.lit(""), F.lit("_gauss")))
    rows = df.withColumn("angle_", angles).withColumn("noise_", noise)
    name = F.concat(F.col(stem), F.when(F.col("angle_") == 0, "").otherwise(F.concat(F.lit("_rot"), "angle_")), "noise_", F.lit(".png"))
    return rows.withColumn("file", name).drop("angle_", "noise_")


def one_of(key, epoch: int, choices: int, share: float = 1.0):
    """A transform for each row and epoch, from 0, or -1 for none: by hash, so reruns agree."""
    h = F.xxhash64(key, F.lit(epoch))
    return F.when(F.pmod(F.shiftrightunsigned(h, 16), F.lit(1000)) < int(share * 1000), F.pmod(h, F.lit(choices))).otherwise(F.lit(-1).cast("long"))


def drawn(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows by lot, the same ones each time: those with the smallest digests of key and seed."""
    lot = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key], F.lit(str(seed))).cast("binary"))
    return df.withColumn("lot_", lot).orderBy("lot_", *key).limit(n).drop("lot_")


def variants(df: DataFrame, stem: str, names: list[str]) -> DataFrame:
    """Each row as it is and once for each transform: variant, from 0 for the original, and file."""
    rows = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
    label = F.element_at(F.array(*[F.lit(x) for x in ["", *["_" + n for n in names]]]), F.col("variant") + 1)
    return rows.withColumn("file", F.concat(F.col(stem), label, F.lit(".png")))


#: The transforms that each image goes through once.
TRANSFORMS = ["rotate", "noise", "elastic", "optical", "clahe", "affine", "perspective", "brightness", "blur", "grid", "hue", "median"]


def _lot(key, name: str, seed: int):
    """A number from 0 to 1, by a digest of key, name and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{name}:{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def vertical_crops(df: DataFrame, key: str, height: str, seed: int, ratio: float = 0.2, share: float = 0.5) -> DataFrame:
    """df with y1 and y2: of a share of the rows, either end is cut by up to half of the ratio of the height."""
    most = F.floor(F.floor(F.col(height) * ratio) / 2)
    cut = lambda name: F.when(_lot(F.col(key), "crop", seed) < share, F.floor(_lot(F.col(key), name, seed) * (most + 1))).otherwise(0)
    return df.withColumn("y1", cut("top").cast("int")).withColumn("y2", (F.col(height) - cut("bottom")).cast("int"))


def trials(spark, n: int, seed: int, *, rate: tuple[float, float] = (1e-6, 1e-4), decay: tuple[float, float] = (0.0, 0.1), warmup: tuple[int, int] = (0, 1000)) -> DataFrame:
    """n sets of hyper-parameters: trial, lr (log-uniform), weight_decay (uniform), warmup (whole number); ends included."""
    from math import log

    own = spark.range(n).select(F.col("id").alias("trial"))
    lr = F.exp(log(rate[0]) + _lot(F.col("trial"), "lr", seed) * (log(rate[1]) - log(rate[0])))
    wd = decay[0] + _lot(F.col("trial"), "wd", seed) * (decay[1] - decay[0])
    steps = warmup[0] + F.floor(_lot(F.col("trial"), "warmup", seed) * (warmup[1] - warmup[0] + 1))
    return own.select("trial", lr.alias("lr"), wd.alias("weight_decay"), steps.cast("long").alias("warmup"))
