"""Quality scores by Bradley-Terry pairwise ranking.

Every pair of one better and one worse labelled document counts; the weights of
a linear score minimise the logistic loss on the feature differences of all pairs.
A pair's loss hinges on two scores alone, so the pairs are never made: rows are added
up by score (``STEPS`` steps, a row dealt linearly to the two around its score), and the
sums of the two classes give value and slope for all pairs.  Newton's steps
are two passes over the rows each, which stay where they are; sums alone travel.  The threshold is an
exact quantile of all labelled documents' scores: the one that leaves below it the
share of documents labelled low.  The score given out is the logistic function of the distance
to the threshold, so 0.5 is the threshold.

Defined results: a null text counts as empty, and an empty text has a score as
any other; ids that are repeated or null are scored row by row, a null id is
not held out and never learnt from; of several labels for one id the lowest
holds; without both labels to learn from, every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlab.operators.ordering import exact_percentiles

from .common import held_out, may_learn, stage

#: Score steps, and the score that the last of them stands for; beyond it a pair's loss is flat or straight.
STEPS, REACH = 2049, 32.0
#: Rows of a block.
BLOCK = 1 << 12
#: Partitions up to which their sums are added up at once.
FLAT = 64

_BYTES = np.zeros(256, np.uint8)
for _kind, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'-",
                              b"!?", b"|<>{}[]\\/_=+~^`", b"#$%&*@", b"\"()"), 1):
    _BYTES[list(_set)] = _kind
KINDS = 11
FEATURES = KINDS + 8


def features(text: str | None) -> np.ndarray:
    """Shares of kinds of bytes, word and line statistics of a whole text."""
    raw = (text or "").encode()
    counts = np.bincount(_BYTES[np.frombuffer(raw, np.uint8)], minlength=KINDS).astype(float) if raw else np.zeros(KINDS)
    words, lines = raw.lower().split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m, often = len(words), len(lines), Counter(words)
    letters = max(1.0, counts[0] + counts[1] + counts[2])
    tail = [
        np.log1p(n),
        (len(raw) / n if n else 0.0) / 10,
        len(often) / (n ** 0.9) if n else 0.0,
        len(set(lines)) / m if m else 1.0,
        counts[2] / letters,
        sum(map(bytes.isalpha, words)) / n if n else 0.0,
        sum(a == b for a, b in zip(words, words[1:])) / n if n else 0.0,
        max(often.values()) / n if n else 0.0,
    ]
    return np.concatenate((np.sqrt(counts / max(1, len(raw))), tail))


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of rows, of rows labelled 1, sums and sums of squares of the features."""
    return np.concatenate(([len(y), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)))


def _around(z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at or below each row's score, and the row's share in the next one."""
    at = (np.clip(z @ w, -REACH, REACH) + REACH) * ((STEPS - 1) / (2 * REACH))
    low = np.minimum(at.astype(np.int64), STEPS - 2)
    return low, at - low


def by_step(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows and their features added up by (label, score step)."""
    low, part = _around(z, w)
    out = np.zeros((2, STEPS, 1 + z.shape[1]))
    own = np.concatenate((np.ones((len(z), 1)), z), axis=1)
    np.add.at(out, (y, low), own * (1 - part)[:, None])
    np.add.at(out, (y, low + 1), own * part[:, None])
    return out


def squares(z: np.ndarray, y: np.ndarray, w: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Products of features, weighted by (label, score step)."""
    low, part = _around(z, w)
    return (z * (weight[y, low] * (1 - part) + weight[y, low + 1] * part)[:, None]).T @ z


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def weights(total: Callable, ridge: float = 1e-3) -> dict | None:
    """Standardising constants, weights and share of rows labelled 0; ``total(f)`` adds up f(x, y) over blocks of all rows.

    None without rows of both labels.
    """
    sums = total(moments)
    if sums is None or not 0 < sums[1] < sums[0]:
        return None
    n, width = sums[0], (len(sums) - 2) // 2
    mean = sums[2:2 + width] / n
    scale = np.sqrt(np.maximum(sums[2 + width:] / n - mean * mean, 0)) + 1e-6
    score = np.linspace(-REACH, REACH, STEPS)
    p = 1 / (1 + np.exp(score[:, None] - score[None, :]))  # of a better row's step and a worse one's: that the pair is the wrong way round
    q, w = p * (1 - p), np.zeros(width)
    for _ in range(20):  # Newton steps of the logistic loss
        worse, better = total(lambda x, y, w=w: by_step(_standard(x, mean, scale), y, w))
        pairs = better[:, 0].sum() * worse[:, 0].sum()
        slope = ((p @ worse[:, 0]) @ better[:, 1:] - (better[:, 0] @ p) @ worse[:, 1:]) / pairs - ridge * w
        weight = np.stack((better[:, 0] @ q, q @ worse[:, 0])) / pairs
        own = total(lambda x, y, w=w, weight=weight: squares(_standard(x, mean, scale), y, w, weight))
        cross = better[:, 1:].T @ q @ worse[:, 1:] / pairs
        step = np.linalg.solve(own - cross - cross.T + ridge * np.eye(width), slope)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    z = total(lambda x, y: np.array([(s := _standard(x, mean, scale) @ w).sum(), (s * s).sum()])) / n
    return {"mean": mean, "scale": scale, "w": w, "unit": float(np.sqrt(max(z[1] - z[0] * z[0], 0)) + 1e-9) / 4, "low": float(1 - sums[1] / n)}


NOTHING = {"mean": np.zeros(FEATURES), "scale": np.ones(FEATURES), "w": np.zeros(FEATURES), "cut": 0.0, "unit": 1.0}


def fit(x: np.ndarray, y: np.ndarray, pairs: int | None = None, ridge: float = 1e-3) -> dict:
    """The model of features and labels (0 or 1) at hand; all pairs count, whatever ``pairs`` says."""
    model = weights(lambda f: f(x, y), ridge)
    if model is None:
        return NOTHING
    return model | {"cut": float(np.quantile(_standard(x, model["mean"], model["scale"]) @ model["w"], model["low"]))}


def scored(x: np.ndarray, model: dict) -> np.ndarray:
    s = np.clip((x - model["mean"]) / model["scale"], -8, 8) @ model["w"]
    return 1 / (1 + np.exp(np.clip(-(s - model["cut"]) / model["unit"], -500, 500)))


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Blocks (x, y: packed features and labels, n: rows) of all documents to learn from."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & may_learn(F.col("_id"))) \
        .groupBy("_id").agg(F.min("_y").alias("_y"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).where(may_learn(F.col("_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["_id", "_x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK):
                x, y = (c.to_pylist() for c in b.slice(s, BLOCK).columns)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)]), pa.array([np.array(y, np.int8).tobytes()]), pa.array([len(y)], pa.int32())], names=["x", "y", "n"])

    # the features, not the texts, meet the labels
    known = texts.mapInArrow(run, f"_id {texts.schema['_id'].dataType.simpleString()}, _x binary")
    return stage(known.join(own, "_id").select("_x", "_y").mapInArrow(pack, "x binary, y binary, n int"), "labelled")


def _unpacked(r) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["x"], float).reshape(-1, FEATURES), np.frombuffer(r["y"], np.int8).astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict:
    """The ranking model fitted to all labelled documents that may be learnt from."""
    blocks = labelled_features(docs, labels, id_col, text_col, label_col)
    rows = blocks.select("x", "y").rdd.map(_unpacked)

    def total(f: Callable):
        def part(own):
            out = None
            for x, y in own:
                got = f(x, y)
                out = got if out is None else out + got
            return [] if out is None else [out]
        parts = rows.mapPartitions(part)
        return None if not few else parts.reduce(np.add) if few <= FLAT else parts.treeReduce(np.add)

    few = rows.getNumPartitions() if blocks.take(1) else 0
    model = weights(total)
    if model is None:
        return NOTHING
    mean, scale, w = model["mean"], model["scale"], model["w"]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_standard(np.frombuffer(x, float).reshape(-1, FEATURES), mean, scale) @ w)], names=["s"])

    cut = exact_percentiles(blocks.select("x").mapInArrow(scores, "s double"), [], "s", [model["low"]]).first()["value"]
    return model | {"cut": float(cut)}


def with_scores(docs: DataFrame, model: dict, cols: list[str], text_col: str = "text", keep_from: float | None = None) -> DataFrame:
    """``cols`` and the score of every row, or, with ``keep_from``, ``cols`` of the rows that reach it."""
    src = docs.select(F.col(text_col).cast("string").alias("_vx_text"), *[F.col(c) for c in cols])
    kept = src.select(*cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(0)]).reshape(-1, FEATURES)
            s = scored(x, model)
            if keep_from is None:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(s)], names=[*kept.names, "score"])
            else:
                yield pa.RecordBatch.from_arrays(b.columns[1:], names=kept.names).filter(pa.array(s >= keep_from))

    if keep_from is not None:
        return src.mapInArrow(run, kept)
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = learn(docs, labels, id_col, text_col)
    return with_scores(docs, model, [id_col], text_col) \
        .select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, all columns as they are."""
    cols = docs.columns
    model = learn(docs, labels, id_col, text_col)
    plain = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    return with_scores(plain, model, plain.columns, f"c{cols.index(text_col)}", keep_from=0.5).toDF(*cols)
