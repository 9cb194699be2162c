"""Statistics of images as pixel tables: image_id, pos, r, g, b."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .splits import stride_sample


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), c.cast("double")))


def from_matrix(images: DataFrame, matrix: str = "matrix", most: int = 5000) -> DataFrame:
    """Pixels of array<array<array<double>>> columns, row by row, every ceil(n / most)-th of each image."""
    cells = images.select("image_id", F.posexplode(F.flatten(matrix)).alias("pos", "p"))
    pixels = cells.select("image_id", "pos", *[clamp(F.col("p")[i]).alias(c) for i, c in enumerate("rgb")])
    return stride_sample(pixels, "pos", [], most, ["image_id"])


def from_files(files: DataFrame, most: int = 5000) -> DataFrame:
    """Pixels of binary PPM (P6) images from a binaryFile table; image_id is the path. Other formats need a decoder that isn't here."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                head = data[:64].split(None, 4)
                if not data.startswith(b"P6") or len(head) < 5:
                    continue
                w, h, top = int(head[1]), int(head[2]), int(head[3])
                x = np.frombuffer(data[-w * h * 3 :], np.uint8).reshape(-1, 3) * (255.0 / top)
                step = max(1, -(-len(x) // most))
                at = np.arange(0, len(x), step)
                out.append(pd.DataFrame({"image_id": path, "pos": at, "r": x[at, 0], "g": x[at, 1], "b": x[at, 2]}))
            yield pd.concat(out) if out else pd.DataFrame(columns=["image_id", "pos", "r", "g", "b"])

    return files.select("path", "content").mapInPandas(run, "image_id string, pos long, r double, g double, b double")


def _rgb() -> tuple[Column, Column, Column]:
    return tuple(clamp(F.col(c)) for c in "rgb")


def is_skin() -> Column:
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    spread = F.greatest(r, g, b) - F.least(r, g, b)
    plain = (r > 95) & (g > 40) & (b > 20) & (spread > 15) & (F.abs(r - g) > 15) & (r > g) & (r > b)
    cb = 128.0 - 0.168736 * r - 0.331264 * g + 0.5 * b
    cr = 128.0 + 0.5 * r - 0.418688 * g - 0.081312 * b
    return plain | (cb.between(77, 127) & cr.between(133, 173))


def skin_ratio(pixels: DataFrame, medium: float = 0.30, high: float = 0.55) -> DataFrame:
    """image_id, skin_ratio, non_skin_ratio, risk, n."""
    d = pixels.groupBy("image_id").agg(F.avg(is_skin().cast("double")).alias("skin_ratio"), F.count(F.lit(1)).alias("n"))
    risk = F.when(F.col("skin_ratio") >= high, "high").when(F.col("skin_ratio") >= medium, "medium").otherwise("low")
    return d.select("image_id", "skin_ratio", (1 - F.col("skin_ratio")).alias("non_skin_ratio"), risk.alias("risk"), "n")


def forensics(pixels: DataFrame) -> DataFrame:
    """One aggregate: channel means, spread of luma, saturation, clipping, colour diversity, flatness."""
    r, g, b = _rgb()
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    luma = 0.2126 * r + 0.7152 * g + 0.0722 * b
    cut = sum((F.when((c <= 3) | (c >= 252), 1.0).otherwise(0.0) for c in (r, g, b)), F.lit(0.0))
    cell = F.floor(r / 16) * 256 + F.floor(g / 16) * 16 + F.floor(b / 16)
    d = pixels.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_r"), F.avg(g).alias("mean_g"), F.avg(b).alias("mean_b"), F.stddev_pop(luma).alias("luma_std"),
        F.avg(F.when(top <= 0, 0.0).otherwise((top - low) / F.nullif(top, F.lit(0.0)))).alias("saturation"), (F.avg(cut) / 3).alias("clipping"), (F.count_distinct(cell) / F.count(F.lit(1))).alias("diversity"),
    )
    return d.withColumn("flatness", 1 - F.least(F.lit(1.0), F.col("luma_std") / 64))


GENERATORS = ("stable diffusion", "midjourney", "dall-e", "dalle", "sdxl", "comfyui", "invokeai", "adobe firefly", "flux")
FILE_HINTS = ("midjourney", "dalle", "stable-diffusion", "sdxl", "flux", "ai-generated", "genimg")


def hint_score(text: Column, hints: tuple[str, ...], each: float) -> Column:
    low = F.lower(text)
    return F.least(F.lit(1.0), sum((F.when(F.contains(low, F.lit(h)), each).otherwise(0.0) for h in hints), F.lit(0.0)))


def authenticity(signals: DataFrame) -> DataFrame:
    """signals with score, risk and confidence, from generator_hint, filename_hint, has_camera, flatness, diversity, clipping (missing ones are neutral)."""
    has = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in signals.columns else F.lit(default)
    s = F.least(F.lit(0.45), 0.45 * F.greatest(F.lit(0.0), has("generator_hint", 0.0)))
    s = s + F.least(F.lit(0.20), 0.20 * F.greatest(F.lit(0.0), has("filename_hint", 0.0)))
    for cond, by in ((~has("has_camera", False), 0.12), (has("flatness", 0.0) > 0.58, 0.12), (has("diversity", 1.0) < 0.08, 0.10), (has("clipping", 0.0) > 0.35, 0.10)):
        s = s + F.when(cond, by).otherwise(0.0)
    d = signals.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 12))
    d = d.withColumn("risk", F.when(F.col("score") >= 0.72, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))
    return d.withColumn("confidence", 0.45 + 0.5 * F.least(F.lit(1.0), F.abs(F.col("score") - 0.5) * 2))


def _centres(x: np.ndarray, k: int, iterations: int, batch: int, seed: int) -> np.ndarray:
    """Clusters of images of as many pixels each (images x pixels x 3): every image draws the same places, so all take a step at once."""
    n, every = x.shape[1], np.arange(len(x))
    kk = 1 if n == 1 else max(2, min(k, n))
    rng = np.random.default_rng(seed)
    c = x[:, rng.permutation(n)[:kk]].copy()
    count = np.zeros(c.shape[:2])
    for _ in range(iterations if kk > 1 else 0):
        for j in rng.integers(0, n, min(batch, n)):
            row = x[:, j]
            i = ((c - row[:, None]) ** 2).sum(2).argmin(1)
            count[every, i] += 1
            c[every, i] += (row - c[every, i]) / count[every, i][:, None]
    return c


def palette(pixels: DataFrame, k: int = 5, iterations: int = 100, batch: int = 32, seed: int = 42, held: int = 100_000) -> DataFrame:
    """image_id, rank, r, g, b, hex, share: clusters of each image's (sampled) pixels. Images of one size go together in Arrow, about ``held`` pixels at once."""

    def run(batches):
        for b in batches:
            out = []
            size = b["r"].map(len)
            for n, same in b.groupby(size):
                for first in range(0, len(same), max(1, held // n)):
                    some = same.iloc[first : first + max(1, held // n)]
                    x = np.clip(np.stack([np.stack(some[c].to_numpy()).astype(float) for c in "rgb"], 2), 0, 255)
                    for image, px, c in zip(some["image_id"], x, _centres(x, k, iterations, batch, seed)):
                        at = ((px[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
                        rows = [(int((at == i).sum()), *np.floor(px[at == i].mean(0) + 0.5).astype(int)) for i in range(len(c)) if (at == i).any()]
                        rows.sort(key=lambda r: (-r[0], r[1:]))
                        out += [(image, m + 1, int(r), int(g), int(u), f"#{r:02X}{g:02X}{u:02X}", many / n) for m, (many, r, g, u) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["image_id", "rank", "r", "g", "b", "hex", "share"])

    kind = dict(pixels.dtypes)["image_id"]
    whole = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[F.col(c).cast("double").alias(c) for c in "rgb"]))).alias("px"))
    return whole.select("image_id", *[F.transform("px", _channel(c)).alias(c) for c in "rgb"]).mapInPandas(run, f"image_id {kind}, rank int, r int, g int, b int, hex string, share double")


def _channel(c: str):
    return lambda x: x[c]


def analyze(pixels: DataFrame) -> DataFrame:
    """Skin ratio and palette of each image."""
    p = palette(pixels).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("rank", "hex", "share"))).alias("palette"))
    return skin_ratio(pixels).join(p, "image_id")
