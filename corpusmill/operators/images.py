"""Images: pluggable decoding, small convolutional networks in numpy, export and lookup of files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 224


def decode_first(values: list, decode: Callable[[bytes], np.ndarray]) -> np.ndarray | None:
    """The first of the values (bytes, or dicts with ``bytes``) that decodes; None if none does."""
    for x in values:
        raw = x.get("bytes") if isinstance(x, dict) else x
        if raw:
            try:
                return decode(bytes(raw))
            except Exception:  # noqa: BLE001, S112  any decoder may raise anything; the next column is tried
                continue
    return None


def to_tensor(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(height, width, 3) bytes -> (3, side, side) floats from 0 to 1, by bilinear sampling."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(side) + 0.5) * h / side - 0.5, 0, h - 1)
    x = np.clip((np.arange(side) + 0.5) * w / side - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    img = image.astype(float)
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return ((top * (1 - fy) + low * fy) / 255).transpose(2, 0, 1)


def conv3x3(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(n, c, h, w) with padding 1 -> (n, k, h, w)."""
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1))), (3, 3), axis=(2, 3))
    return np.einsum("nchwij,kcij->nkhw", windows, weight, optimize=True) + bias[None, :, None, None]


def pool2(x: np.ndarray) -> np.ndarray:
    n, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max((3, 5))


def forward(x: np.ndarray, weights: dict, pools: list[bool], flatten: bool = False) -> np.ndarray:
    """Class probabilities: convolutions with ReLU (pooled where ``pools`` says), mean or flattening, two layers."""
    for k, pooled in enumerate(pools):
        x = np.maximum(conv3x3(x, weights[f"conv{k}.w"], weights[f"conv{k}.b"]), 0)
        x = pool2(x) if pooled else x
    x = x.reshape(len(x), -1) if flatten else x.mean((2, 3))
    x = np.maximum(x @ weights["fc0.w"].T + weights["fc0.b"], 0)
    z = x @ weights["fc1.w"].T + weights["fc1.b"]
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def random_weights(classes: int, channels: list[int], hidden: int, seed: int = 0, flat: int | None = None) -> dict:
    """Weights of the right shapes; the real ones are the user's."""
    rng, out, c = np.random.default_rng(seed), {}, 3
    for k, n in enumerate(channels):
        out[f"conv{k}.w"], out[f"conv{k}.b"], c = rng.normal(0, (2 / (9 * c)) ** 0.5, (n, c, 3, 3)), np.zeros(n), n
    for name, a, b in (("fc0", flat or c, hidden), ("fc1", hidden, classes)):
        out[f"{name}.w"], out[f"{name}.b"] = rng.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b)
    return out


def score_images(df: DataFrame, columns: list[str], decode: Callable[[bytes], np.ndarray], weights: dict, pools: list[bool], out: str = "scores", flatten: bool = False, side: int = SIDE, error: str | None = None) -> DataFrame:
    """Adds the class probabilities of each row's first decodable image; an empty array if it has none or the network
    fails on it. ``error`` names a column for what went wrong (null where nothing did), to be counted as a reason.

    The weights are broadcast once; a batch goes through the network together, one by one where that fails.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def scored(images: list[np.ndarray]) -> list:
        return forward(np.stack([to_tensor(x, side) for x in images]), shared.value, pools, flatten).tolist()

    @F.pandas_udf("scores array<double>, error string")
    def run(*images: pd.Series) -> pd.DataFrame:
        found = [decode_first(list(row), decode) for row in zip(*images, strict=True)]
        at = [i for i, x in enumerate(found) if x is not None]
        result, errors = [[] for _ in found], [None] * len(found)
        for a in range(0, len(at), 32):
            part = at[a : a + 32]
            try:
                rows = scored([found[i] for i in part])
            except Exception:  # noqa: BLE001  an image of an odd shape; the others still count
                rows = []
                for i in part:
                    try:
                        rows += scored([found[i]])
                    except Exception as e:  # noqa: BLE001
                        rows.append([])
                        errors[i] = type(e).__name__
            for i, row in zip(part, rows, strict=True):
                result[i] = row
        return pd.DataFrame({"scores": result, "error": errors})

    df = df.withColumn("__s", run(*[F.col(c) for c in columns])).withColumn(out, F.col("__s.scores"))
    return (df.withColumn(error, F.col("__s.error")) if error else df).drop("__s")


def image_name(label, pmc_id, row_id):
    return F.concat(label, F.lit("/"), pmc_id, F.lit("_"), row_id.cast("string"), F.lit(".jpg"))


def export_images(df: DataFrame, image: str, folder: str) -> int:
    """Writes each image to ``folder/<final_label or rule_pred>/<pmc_id>_<row_id>.jpg`` from the executors;
    rows without an image are skipped. Returns the number written. ``folder`` (a path or URI) must be shared by all."""
    named = df.where(F.col(image).isNotNull()).select(F.coalesce("final_label", "rule_pred").alias("l"), "pmc_id", "row_id", F.col(image).alias("i"))

    def write(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        for pdf in batches:
            for label, pmc, row, raw in pdf.itertuples(index=False):
                system.create_dir(f"{base}/{label}", recursive=True)
                with system.open_output_stream(f"{base}/{label}/{pmc}_{row}.jpg") as f:
                    f.write(raw)
            yield pd.DataFrame({"n": [len(pdf)]})

    return int(named.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def image_files(spark, folder: str) -> DataFrame:
    """The paths of all files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def file_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(name, path) of image files; of files with one name the last path in order stands."""
    found = paths.where(F.lower(F.col(path)).rlike(r"\.(jpg|jpeg|png)$")).withColumn("name", F.regexp_extract(path, r"([^/]+)$", 1))
    return found.groupBy("name").agg(F.max(path).alias("path"))


def looked_up(df: DataFrame, paths: DataFrame, root: str) -> DataFrame:
    """Adds image_path: the file below the label's folder, else the one directly below ``root``, else null."""
    label = F.coalesce(F.nullif("final_label", F.lit("")), "rule_pred")
    name = F.concat("pmc_id", F.lit("_"), F.col("row_id").cast("string"), F.lit(".jpg"))
    known = paths.select(F.col("path").alias("p")).distinct()
    a, b = known.withColumnRenamed("p", "__a"), known.withColumnRenamed("p", "__b")
    out = df.withColumns({"__in": F.concat(F.lit(root + "/"), label, F.lit("/"), name), "__flat": F.concat(F.lit(root + "/"), name)})
    out = out.join(a, F.col("__in") == F.col("__a"), "left").join(b, F.col("__flat") == F.col("__b"), "left")
    return out.withColumn("image_path", F.coalesce("__a", "__b")).drop("__in", "__flat", "__a", "__b")
