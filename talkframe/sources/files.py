"""Sources: raw and WAV audio, manifests, saved results and session streams."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
CHUNK = "session_id string, chunk_ix int, n_samples int, pcm array<float>"


def _chunks(name: str, samples: np.ndarray, seconds: float) -> Iterator[tuple]:
    size = int(min(seconds, 5.0) * RATE)
    for i, at in enumerate(range(0, len(samples), size)):
        part = samples[at : at + size]
        yield name, i, len(part), part


def _decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray], seconds: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):  # one file's rows at a time
                yield pd.DataFrame(list(_chunks(path, decode(bytes(content)), seconds)), columns=["session_id", "chunk_ix", "n_samples", "pcm"])

    return files.select("path", "content").mapInPandas(run, CHUNK)


def _s16(data: bytes) -> np.ndarray:
    return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float32) / 32768.0


def read_pcm(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """Raw 16-bit little-endian mono at 16 kHz as chunks of floats; an odd last byte is dropped, the remainder is the last chunk."""
    return _decoded(spark.read.format("binaryFile").load(path), _s16, seconds)


def read_wav(spark: SparkSession, path: str, seconds: float = 1.0) -> DataFrame:
    """16-bit mono WAV at 16 kHz; anything else is an error of the task that reads it."""
    def decode(data: bytes) -> np.ndarray:
        with wave.open(io.BytesIO(data)) as w:
            if (w.getnchannels(), w.getsampwidth(), w.getframerate()) != (1, 2, RATE):
                raise ValueError("only 16-bit mono WAV at 16 kHz is read")
            return _s16(w.readframes(w.getnframes()))

    return _decoded(spark.read.format("binaryFile").load(path), decode, seconds)


SAMPLE = "name string, path string, reference string, duration double, language string, category string, n_speakers int, source string, tags array<string>"


def read_manifest(spark: SparkSession, path: str, languages: list[str] | None = None, categories: list[str] | None = None, quick: list[str] | None = None) -> DataFrame:
    """A JSON array of samples, filtered by language, category and a set of names."""
    out = spark.read.schema(SAMPLE).option("multiLine", True).json(path)
    for name, wanted in (("language", languages), ("category", categories), ("name", quick)):
        if wanted is not None:
            out = out.where(F.col(name).isin(*wanted))
    return out


def read_bench_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the `results` array of saved reports."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def session_stream(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """Rows of many sessions as a stream of files; the end of a session is a row of kind eof."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def score_partitions(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """A user's model over the rows: `load` runs once per task, what it returns maps batches to batches. No model is shipped."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in frames:
            yield model(pdf)

    return df.mapInPandas(run, schema)


def write_audio(samples: DataFrame, folder: str, form: str = "wav") -> DataFrame:
    """S1, S2 the other way: name and samples (array<smallint>) of each row as a file `folder`/name.wav or .pcm, 16-bit mono at 16 kHz; name, path, n_bytes. The folder is shared;
    a task that runs again writes the same files again."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in frames:
            made = []
            for name, values in zip(pdf["name"], pdf["samples"], strict=True):
                data = np.asarray(values, "<i2").tobytes()
                if form == "wav":
                    out = io.BytesIO()
                    with wave.open(out, "wb") as w:
                        w.setparams((1, 2, RATE, 0, "NONE", ""))
                        w.writeframes(data)
                    data = out.getvalue()
                uri = f"{folder}/{name}.{form}"
                system, path = fs.FileSystem.from_uri(uri)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as stream:
                    stream.write(data)
                made.append((name, uri, len(data)))
            yield pd.DataFrame(made, columns=["name", "path", "n_bytes"])

    return samples.select("name", "samples").mapInPandas(run, "name string, path string, n_bytes bigint")
