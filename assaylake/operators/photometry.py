"""The photometric part of camera augmentation, on strips of rows: exposure, white balance, gamma, shading, vignette, off-axis lens shading and sensor noise.

Noise is a function of the seed and the cell alone, by a counter-based generator: any partitioning, any height of strips and any repeated task gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The generator's increment and multipliers, and the bounds of off-axis lens shading.
GOLDEN, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LENS_STRENGTH, LENS_OFFSET = 0.04, 0.25
#: Columns of a strip's parameters; the three of the lens may be null together.
PARAMETERS = ("exposure_ev", "red_gain", "blue_gain", "gamma", "shading_strength", "shading_angle_degrees", "vignette_strength", "noise_std", "noise_seed", "lens_strength", "lens_x", "lens_y")


def hashed(seed: int, counter: np.ndarray) -> np.ndarray:
    """64 mixed bits for each counter."""
    z = np.uint64(seed & (1 << 64) - 1) + (counter.astype(np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
    for shift, by in zip((30, 27), MIX):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def normal(seed: int, cell: np.ndarray) -> np.ndarray:
    """A standard normal value for each cell, of two uniform ones."""
    a, b = ((hashed(seed, 2 * cell.astype(np.int64) + k) >> np.uint64(11)).astype(float) + 0.5 for k in (0, 1))
    return np.sqrt(-2.0 * np.log(a * 2.0**-53)) * np.cos(2.0 * np.pi * b * 2.0**-53)


def adjusted(rgb: np.ndarray, top: int, height: int, p: dict[str, float]) -> np.ndarray:
    """Rows of an image (rows, width, 3), 0 to 255, from row `top` of `height` on, with the parameters p applied."""
    rows, width = rgb.shape[:2]
    light = rgb / 255.0 * 2.0 ** p["exposure_ev"] * np.array([p["red_gain"], 1.0, p["blue_gain"]])
    light = np.clip(light, 0.0, 1.0) ** p["gamma"]
    x = (np.arange(width) / max(width - 1, 1) * 2.0 - 1.0)[None, :]
    y = ((top + np.arange(rows)) / max(height - 1, 1) * 2.0 - 1.0)[:, None]
    angle = np.deg2rad(p["shading_angle_degrees"])
    gain = 1.0 - p["shading_strength"] * (x * np.cos(angle) + y * np.sin(angle) + 1.0) / 2.0
    gain = gain * (1.0 - p["vignette_strength"] * np.minimum(1.0, x * x + y * y))
    lens = [p["lens_strength"], p["lens_x"], p["lens_y"]]
    if any(v is not None for v in lens):
        if None in lens or not 0.0 <= lens[0] <= LENS_STRENGTH or max(map(abs, lens[1:])) > LENS_OFFSET:
            raise ValueError("LENS_SHADING_INVALID")
        gain = gain * (1.0 - lens[0] * np.minimum(1.0, (x - 2.0 * lens[1]) ** 2 + (y - 2.0 * lens[2]) ** 2))
    cell = (top * width * 3 + np.arange(rows * width * 3)).reshape(rgb.shape)
    light = light * gain[..., None] + normal(int(p["noise_seed"]), cell) * (p["noise_std"] / 255.0)
    return np.rint(np.clip(light, 0.0, 1.0) * 255.0).astype(np.uint8)


def photometric(strips: DataFrame, height: str = "height") -> DataFrame:
    """strips (image, y, width, rgb as binary row by row, height of the image, and PARAMETERS) with rgb adjusted; a null parameter or incomplete rows are an error. Other columns stay."""
    at = {n: strips.columns.index(n) for n in ("y", "width", "rgb", height, *PARAMETERS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                value = {n: batch.column(i)[k].as_py() for n, i in at.items()}
                if any(value[n] is None for n in PARAMETERS[:9]):
                    raise ValueError("PHOTOMETRY_PARAMETER_MISSING")
                made.append(adjusted(np.frombuffer(value["rgb"], np.uint8).reshape(-1, value["width"], 3), value["y"], value[height], value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()) if i == at["rgb"] else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return strips.mapInArrow(run, strips.schema)
