"""Document quality by attention-based multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talkframe.llm.tables import written

#: Bytes of a passage, the instance of the bag that a document is.
PASSAGE = 512
#: Bytes whose features are counted at a time, whatever the length of a text.
PIECE = PASSAGE << 11


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: its own class (letters apart, cases, digits and non-ASCII bytes together, ASCII punctuation apart) and its coarse class."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    seen: dict[str, int] = {}
    for b in range(256):
        c = chr(b)
        if b > 127:
            name, kind = "other", 6
        elif c.isalpha():
            name, kind = (c, 0) if c.islower() else ("upper", 1)
        elif c.isdigit():
            name, kind = "digit", 2
        elif c == "\n":
            name, kind = c, 5
        elif c.isspace() or b < 32 or b == 127:
            name, kind = "space", 4
        else:
            name, kind = c, 3
        fine[b], coarse[b] = seen.setdefault(name, len(seen)), kind
    return fine, coarse


FINE, COARSE = _classes()
N_FINE, N_COARSE = int(FINE.max()) + 1, 7
N_FEATURES = N_FINE + N_COARSE * N_COARSE + 2


def passages(text: str) -> Iterator[np.ndarray]:
    """Raw encodings of all passages of a text, piece by piece."""
    return encoded(text.encode("utf-8", "surrogatepass"))


def encoded(text: bytes) -> Iterator[np.ndarray]:
    """Of each passage the shares of byte classes and of pairs of coarse classes, the share of distinct words, and the length."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(data), 1), PIECE):
        part = data[at : at + PIECE]
        n = max(1, -(-len(part) // PASSAGE))
        rows = np.arange(len(part)) // PASSAGE
        out = np.zeros((n, N_FEATURES), np.float32)
        out[:, :N_FINE] = np.bincount(rows * N_FINE + FINE[part], minlength=n * N_FINE).reshape(n, N_FINE)
        kinds = COARSE[part]
        pairs = kinds[:-1] * N_COARSE + kinds[1:]
        k = N_COARSE * N_COARSE
        out[:, N_FINE:-2] = np.bincount(rows[1:] * k + pairs, minlength=n * k).reshape(n, k)
        size = np.maximum(out[:, :N_FINE].sum(1, keepdims=True), 1)
        out /= size
        words = [part[i * PASSAGE : (i + 1) * PASSAGE].tobytes().lower().split() for i in range(n)]
        out[:, -2] = [len(set(w)) / len(w) if w else 1.0 for w in words]
        out[:, -1:] = np.log1p(size)
        yield np.sqrt(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Passage encoder W, gated attention V, U, w, and the document's classifier c, over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def score(self, text: str) -> float:
        """Probability of the good label: one softmax over all passages of the whole text, summed up piece by piece."""
        p = self.weights
        top, total, bag = -np.inf, 0.0, 0.0
        for raw in passages(text):
            h = np.tanh((raw - self.mean) / self.scale @ p["W"] + p["b"])
            e = (np.tanh(h @ p["V"]) * sigmoid(h @ p["U"])) @ p["w"]
            peak = max(top, float(e.max()))
            a, old = np.exp(e - peak), np.exp(top - peak)
            total, bag, top = total * old + a.sum(), bag * old + a @ h, peak
        return float(sigmoid(bag / total @ p["c"] + p["d"][0]))


def train(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gates: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the log loss of the documents' labels; gradients flow through the attention to every passage. Fixed seed, fixed order."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(bags)
    mean, scale = flat.mean(0), flat.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    shape = {"W": (N_FEATURES, hidden), "b": (hidden,), "V": (hidden, gates), "U": (hidden, gates), "w": (gates,), "c": (hidden,), "d": (1,)}
    p = {k: (rng.normal(0, s[0] ** -0.5, s) if k not in "bd" else np.zeros(s)).astype(np.float64) for k, s in shape.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            ix = order[at : at + batch]
            x, y = np.concatenate([bags[i] for i in ix]), labels[ix]
            sizes = np.array([len(bags[i]) for i in ix])
            starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(ix)), sizes)
            h = np.tanh(x @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
            e = (t * s) @ p["w"]
            a = np.exp(e - np.maximum.reduceat(e, starts)[of])
            a /= np.add.reduceat(a, starts)[of]
            z = np.add.reduceat(a[:, None] * h, starts)
            out = (sigmoid(z @ p["c"] + p["d"]) - y) / len(ix)
            dz = (out[:, None] * p["c"])[of]
            da = (dz * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts)[of])
            dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}
            step += 1
            for k, g in grad.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: x.astype(np.float32) for k, x in p.items()})


def fit(docs: DataFrame, labels: DataFrame, usable: Column, most_docs: int = 6000, most_passages: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learns from a bounded sample of labelled rows, those with the lowest hash of their id among the `usable` ones of `labels`; none gives null.

    The sample is bounded by rows and by passages: at most `most_docs` rows, in the order of the hash, as long as the passages of all their texts stay within
    `most_passages` (a row that would pass the bound is left out, the next may fit). Of a row that is taken every passage takes part. So at most most_passages
    encodings (45 MB) reach the driver, whatever the texts. Labels other than 0 and 1 are ignored; of conflicting labels of an id the
    smaller counts, of several texts the first in order.
    """
    chosen = (
        labels.where(usable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.min(label_col).cast("double").alias("y"))
        .withColumn("_hash", F.xxhash64(id_col)).orderBy("_hash", id_col).limit(most_docs)
    )
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    texts = written(texts.groupBy("_hash", id_col, "y").agg(F.min("text").alias("text")), "quality-sample")
    sizes = texts.select(id_col, F.greatest(F.ceil(F.octet_length("text") / PASSAGE), F.lit(1)).alias("n")).orderBy("_hash", id_col).collect()  # at most most_docs rows
    taken, left = [], most_passages
    for key, n in sizes:
        if n <= left:
            taken, left = [*taken, key], left - n
    if len(taken) < len(sizes):
        texts = texts.where(F.col(id_col).isin(taken))

    def bag(text: str) -> bytes:
        return np.concatenate([*passages(text)]).astype(np.float16).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([bag(t.as_py()) for t in batch.column(2)], pa.binary())], names=["h", "y", "bag"])

    rows = texts.select("_hash", "y", "text").mapInArrow(encode, "h bigint, y double, bag binary").collect()
    rows = sorted((r.h, r.y, bytes(r.bag)) for r in rows)
    if not rows:
        return None
    bags = [np.frombuffer(b, np.float16).astype(np.float32).reshape(-1, N_FEATURES) for *_, b in rows]
    return train(bags, np.array([y for _, y, _ in rows]))


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row's id with score (0 to 1, higher: the good label is likelier), predicted (1 if score >= `threshold`) and, with `carry`, row (all its columns).

    Every passage of the whole text is encoded and weighted; null counts as empty, an empty text is one empty passage.
    Without a model every score is 1. Repeated rows are scored each; an empty table gives an empty result. Scan only:
    no shuffle; the model is a broadcast of some thousand numbers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.weights) if model else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column("row").field(text_col) if carry else batch.column("text")
            found = pa.array([m.score(t.as_py() or "") if m else 1.0 for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), found, *([batch.column("row")] if carry else [])], names=["id", "score", *(["row"] if carry else [])])

    more = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row") if carry else F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), more)
    shape = StructType([rows.schema["id"], StructField("score", DoubleType()), *([rows.schema["row"]] if carry else [])])
    done = rows.mapInArrow(run, shape)
    return done.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(["row"] if carry else []))
