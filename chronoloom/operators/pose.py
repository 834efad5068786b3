"""Poses from JSON frames: candidates, one person followed through time, repaired and brought to a canonical form.

Frames are scored by expressions; which person is followed depends on the choice before, so that is a fold over one file's
frames, and the repair of a file's track is NumPy on that file alone. Files are independent and run in parallel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOINTS = 17
SCHEMA = "instances array<struct<bbox:array<array<double>>,bbox_score:double,keypoints:array<array<double>>,keypoint_scores:array<double>>>"
#: Weights of a candidate's scores. Fixed values.
WEIGHTS = {"bbox": 0.25, "pose": 0.25, "center": 0.25, "continuity": 0.15, "size": 0.10}
HIPS, SHOULDERS = (11, 12), (5, 6)


def select_files(spark: SparkSession, folder: str, stems: DataFrame | None = None, *, most: int | None = None) -> tuple[list[str], list[str]]:
    """Paths of the folder's JSON files, by name, and the wanted stems (a column ``stem``) that have none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("stem"))
    lost = [] if stems is None else [r["stem"] for r in stems.select("stem").distinct().join(found, "stem", "left_anti").orderBy("stem").collect()]
    found = found if stems is None else found.join(stems.select("stem").distinct(), "stem", "left_semi")
    return [r["path"] for r in (found.orderBy("stem").limit(most) if most else found.orderBy("stem")).collect()], lost


def read_frames(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, frame, instances): a row for each frame of each file, which is one JSON array."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"array<struct<{SCHEMA.replace(' ', ':', 1)}>>").alias("frames"))
    return files.select("file", F.posexplode("frames").alias("frame", "f")).select("file", "frame", F.coalesce("f.instances", F.array()).alias("instances"))


def _bbox(i):
    xs, ys = F.transform(i["keypoints"], lambda k: k[0]), F.transform(i["keypoints"], lambda k: k[1])
    own = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.coalesce(F.when(F.size(F.get(i["bbox"], 0)) >= 4, F.get(i["bbox"], 0)), own)


def frame_sizes(frames: DataFrame) -> DataFrame:
    """(file, width, height): the largest coordinates, 1 at least."""
    far = lambda a: F.greatest(F.lit(1.0), F.max(F.array_max(F.flatten(F.transform("instances", a)))))
    xs = lambda i: F.concat(F.transform(i["keypoints"], lambda k: k[0]), F.array(F.get(_bbox(i), 2)))
    ys = lambda i: F.concat(F.transform(i["keypoints"], lambda k: k[1]), F.array(F.get(_bbox(i), 3)))
    return frames.groupBy("file").agg(far(xs).alias("width"), far(ys).alias("height"))


def candidates(frames: DataFrame) -> DataFrame:
    """(file, frame, candidates): of each person with all joints, the parts of the score that need no memory.

    Of more joints or scores than ``JOINTS`` the first count; where scores are fewer, each is 1. Scores may lie outside 0 to 1.
    """
    sized = frames.join(frame_sizes(frames), "file")

    def one(p):
        scores = F.when(F.size(p["keypoint_scores"]) >= JOINTS, F.slice(p["keypoint_scores"], 1, JOINTS)).otherwise(F.array_repeat(F.lit(1.0), JOINTS))
        i = {"bbox": p["bbox"], "bbox_score": p["bbox_score"], "keypoints": F.slice(p["keypoints"], 1, JOINTS), "keypoint_scores": scores}
        box = _bbox(i)
        cx, cy = (box[0] + box[2]) / 2 / F.col("width"), (box[1] + box[3]) / 2 / F.col("height")
        area = F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1]) / (F.col("width") * F.col("height"))
        off = F.sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5))
        unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
        known = F.filter(i["keypoint_scores"], lambda e: e.isNotNull())
        pose = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, e: a + e) / F.size(known))
        fixed = WEIGHTS["bbox"] * F.coalesce(i["bbox_score"], F.lit(0.0)) + WEIGHTS["pose"] * F.coalesce(pose, F.lit(0.0)) + WEIGHTS["center"] * (1 - unit(off / F.sqrt(F.lit(0.5)))) + WEIGHTS["size"] * (1 - unit(area / 0.75))
        return F.struct(cx.alias("cx"), cy.alias("cy"), fixed.alias("fixed"), i["keypoints"].alias("keypoints"), i["keypoint_scores"].alias("scores"))

    whole = F.filter("instances", lambda i: (F.size(i["keypoints"]) >= JOINTS) & F.forall(i["keypoints"], lambda k: F.size(k) >= 2))
    return sized.select("file", "frame", F.transform(whole, one).alias("candidates"))


def follow(found: list[list[tuple[float, float, float]]]) -> list[int | None]:
    """For each frame's (cx, cy, fixed score) the chosen candidate; the first of equals.

    Continuity is nearness to the last chosen, or, as long as there is none, to the frame's centre.
    """
    last, out = None, []
    for frame in found:
        best, score = None, -np.inf
        for n, (cx, cy, fixed) in enumerate(frame):
            far = np.hypot(cx - 0.5, cy - 0.5) / 0.5**0.5 if last is None else np.hypot(cx - last[0], cy - last[1]) / 0.35
            near = 1 - min(1.0, far)
            if fixed + WEIGHTS["continuity"] * near > score:
                best, score = n, fixed + WEIGHTS["continuity"] * near
        if best is not None:
            last = frame[best][:2]
        out.append(best)
    return out


def filled(v: np.ndarray) -> np.ndarray:
    """Missing values by straight lines, held at the ends; zeros if there are none."""
    ok = np.flatnonzero(np.isfinite(v))
    return np.interp(np.arange(len(v)), ok, v[ok]) if len(ok) else np.zeros(len(v))


def smoothed(k: np.ndarray, window: int, order: int) -> np.ndarray:
    """(frames, joints, 2), filled and put through Savitzky and Golay's filter."""
    from ..functions.arrays import savgol, savgol_window

    out = np.stack([filled(v) for v in k.reshape(len(k), -1).T], 1) if len(k) else k.reshape(0, -1)
    w = savgol_window(len(k), window, order)
    if w:
        rows, half = np.array(savgol(w, order)), w // 2
        mid = np.stack([rows[half] @ out[i : i + w] for i in range(len(out) - w + 1)])
        out = np.concatenate([rows[:half] @ out[:w], mid, rows[half + 1 :] @ out[-w:]])
    return out.reshape(k.shape)


def torso(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pelvis, the vector from it to the shoulders' middle, and its length."""
    pelvis, chest = k[:, HIPS].mean(1), k[:, SHOULDERS].mean(1)
    return pelvis, chest - pelvis, np.linalg.norm(chest - pelvis, axis=1)


def valid_torso(k: np.ndarray, scores: np.ndarray, least: float, lo: float, hi: float) -> np.ndarray:
    own = [*HIPS, *SHOULDERS]
    length = torso(k)[2]
    ok = np.isfinite(k[:, own]).all((1, 2)) & (scores[:, own] >= least).all(1) & (length > 1e-6)
    if not ok.any():
        return ok
    middle = np.median(length[ok])
    return ok & (length >= lo * middle) & (length <= hi * middle)


def canonical(k: np.ndarray, *, upright: bool = True) -> np.ndarray:
    """Around the pelvis, turned upright, in torso lengths; a length far from the median counts as missing."""
    pelvis, up, length = torso(k)
    middle = np.nanmedian(np.where(length > 1e-6, length, np.nan)) if (length > 1e-6).any() else 1.0
    wrong = ~((length >= 0.25 * middle) & (length <= 4 * middle))
    fix = lambda v: np.stack([filled(np.where(wrong, np.nan, c)) for c in v.T], 1)
    pelvis, up = fix(pelvis), fix(up)
    length = np.maximum(np.linalg.norm(up, axis=1), 1e-6)
    out = k - pelvis[:, None]
    if upright:
        turn = -np.pi / 2 - np.arctan2(up[:, 1], up[:, 0])
        c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
        out = np.stack([c * out[..., 0] - s * out[..., 1], s * out[..., 0] + c * out[..., 1]], -1)
    return out / length[:, None, None]


def bad_frames(k: np.ndarray, most: float = 8.0, speed: float = 100.0, fps: float = 30.0) -> np.ndarray:
    bad = ~np.isfinite(k).all((1, 2)) | (np.abs(k) > most).any((1, 2))
    fast = (np.linalg.norm(np.diff(k, axis=0), axis=2) * fps > speed).any(1) if len(k) > 1 else np.zeros(0, bool)
    bad[1:] |= fast
    bad[:-1] |= fast
    return bad


def repaired(k: np.ndarray, scores: np.ndarray, *, least: float = 0.3, torso_least: float = 0.3, torso_range=(0.35, 2.5), window: int = 9, order: int = 2, rounds: int = 5, upright: bool = True) -> np.ndarray:
    """The canonical track; frames that come out wrong are taken out and filled again, up to ``rounds`` times."""
    k = np.where((scores >= least)[..., None], k, np.nan)
    k[~valid_torso(k, scores, torso_least, *torso_range)] = np.nan
    for _ in range(rounds):
        out = canonical(smoothed(k, window, order), upright=upright)
        bad = bad_frames(out)
        if not bad.any() or np.isnan(k[bad]).all():
            break
        k[bad] = np.nan
    return np.where(np.isfinite(out), out, 0.0)


def tracks(frames: DataFrame, **how) -> DataFrame:
    """(file, frame, joint, x, y): the followed person of each file, canonical."""
    import pandas as pd

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("frame")
        found = [list(c) for c in f["candidates"]]
        chosen = follow([[(c["cx"], c["cy"], c["fixed"]) for c in frame] for frame in found])
        k, s = np.full((len(f), JOINTS, 2), np.nan), np.zeros((len(f), JOINTS))
        for i, (frame, n) in enumerate(zip(found, chosen, strict=True)):
            if n is not None:
                k[i] = [list(p[:2]) for p in frame[n]["keypoints"]]
                s[i] = frame[n]["scores"]
        out = repaired(k, s, **how).astype("float32")
        return pd.DataFrame({"file": f["file"].iloc[0], "frame": np.repeat(f["frame"].to_numpy(), JOINTS), "joint": np.tile(np.arange(JOINTS, dtype="int32"), len(f)), "x": out[..., 0].ravel(), "y": out[..., 1].ravel()})

    return candidates(frames).groupBy("file").applyInPandas(run, "file string, frame int, joint int, x float, y float")
