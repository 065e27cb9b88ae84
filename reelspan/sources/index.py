"""Vectors of scenes as a table with a manifest that tells whether it still fits."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F


class Encoder(Protocol):
    """Turns texts, paths of frames or paths of sounds into vectors; ``name`` is kept in the manifest."""

    name: str

    def encode(self, items: list[str]) -> list: ...


class HashingEncoder:
    """Counts of hashed words, of length 1: a stand-in for tests and for machines without a model, not a semantic encoder."""

    def __init__(self, width: int = 64) -> None:
        self.width, self.name = width, f"hashing-{width}"

    def encode(self, items: list[str]) -> list:
        import re
        import zlib

        out = np.zeros((len(items), self.width), np.float32)
        for i, t in enumerate(items):
            for w in re.findall(r"\w+", (t or "").lower()):
                out[i, zlib.crc32(w.encode()) % self.width] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return [None if not m else v for v, m in zip(out / np.where(n == 0, 1, n), n[:, 0])]


def sentence_encoder(model: str, device: str = "auto") -> Encoder:
    """An encoder by the sentence-transformers library, where it is installed; the model is loaded once in a worker."""
    import sentence_transformers

    class Sentences:
        name = model
        _loaded = None

        def encode(self, items: list[str]) -> list:
            if Sentences._loaded is None:
                Sentences._loaded = sentence_transformers.SentenceTransformer(model, device=None if device == "auto" else device)
            return list(Sentences._loaded.encode(items, normalize_embeddings=True))

    return Sentences()


def encoded(df: DataFrame, item: str, out: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """``df`` with the vector of ``item`` in ``out``; what can't be encoded, and null, has a null vector. A column named ``out`` is replaced."""
    df = df.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vecs: list = []
            items = f[item].tolist()
            for i in range(0, len(items), batch):
                some = items[i : i + batch]
                got = encoder.encode(["" if x is None else x for x in some])
                vecs += [None if x is None or v is None else np.asarray(v, np.float32) for x, v in zip(some, got)]
            yield f.assign(**{out: pd.Series(vecs, index=f.index, dtype=object)})

    return df.mapInPandas(run, f"{fields}, `{out}` array<float>")


def similarity(encoder: Encoder) -> Callable[[Column, Column], Column]:
    """Cosine of two texts by an encoder, from 0; a text without a vector is like nothing. Taken by rows, in batches."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        texts = list(dict.fromkeys([*a.fillna(""), *b.fillna("")]))
        vecs = dict(zip(texts, encoder.encode(texts)))

        def one(x: str, y: str) -> float:
            u, v = vecs[x], vecs[y]
            n = 0.0 if u is None or v is None else float(np.linalg.norm(u) * np.linalg.norm(v))
            return max(0.0, float(np.dot(u, v)) / n) if n else 0.0

        return pd.Series([one(x, y) for x, y in zip(a.fillna(""), b.fillna(""))])

    out = lambda a, b: cosine(a, b)
    out.by_rows = True
    return out


def fingerprint(segments: DataFrame) -> str:
    """A number for the content of a table, whatever the order of its rows."""
    h = F.xxhash64(*[F.to_json(F.struct(*segments.columns))])
    r = segments.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s")).first()
    return f"{r.n}-{r.x}-{r.s}"


def build_or_load(spark: SparkSession, segments: DataFrame, path: str, manifest: dict[str, str], build: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """(vectors, whether they were built): those stored at ``path`` if the manifest stored with them equals this one.

    The manifest has the content of the scenes and the name of every encoder and option that the vectors depend on.
    It is written after the vectors, so that a build that broke off is not taken for a finished one.
    """
    want = json.dumps({**manifest, "segments": fingerprint(segments)}, sort_keys=True)
    try:
        have = spark.read.text(path + "/manifest", wholetext=True).first()
    except AnalysisException as e:  # there is no manifest; any other error is one
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        have = None
    if have and have[0].strip() == want and not force:
        return spark.read.parquet(path + "/vectors"), False
    build(segments).write.mode("overwrite").parquet(path + "/vectors")
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/manifest")
    return spark.read.parquet(path + "/vectors"), True


def _device(device: str) -> str:
    import torch

    return ("cuda" if torch.cuda.is_available() else "cpu") if device == "auto" else device


def _unit_rows(x, keep: list[bool]) -> list:  # noqa: ANN001
    """Rows of a tensor at length 1, None where an item could not be read."""
    v = (x / x.norm(dim=-1, keepdim=True)).detach().cpu().numpy()
    rows = iter(v)
    return [next(rows) if k else None for k in keep]


def clip_encoder(model: str, kind: str = "image", device: str = "auto") -> Encoder:
    """Pictures (by path) or texts in the space of a CLIP model, by the transformers library, where it is installed."""
    import transformers

    class Clip:
        name = f"{model}/{kind}"
        _parts = None

        def encode(self, items: list[str]) -> list:
            import torch

            if Clip._parts is None:
                Clip._parts = transformers.CLIPModel.from_pretrained(model).to(_device(device)), transformers.CLIPProcessor.from_pretrained(model)
            net, prepare = Clip._parts
            with torch.no_grad():
                if kind == "text":
                    return _unit_rows(net.get_text_features(**prepare(text=items, return_tensors="pt", padding=True, truncation=True).to(net.device)), [True] * len(items))
                pictures = [_picture(p) for p in items]
                some = [p for p in pictures if p is not None]
                if not some:
                    return [None] * len(items)
                return _unit_rows(net.get_image_features(**prepare(images=some, return_tensors="pt").to(net.device)), [p is not None for p in pictures])

    return Clip()


def _picture(path: str):  # noqa: ANN202
    from PIL import Image

    try:
        return Image.open(path).convert("RGB")
    except OSError:
        return None


def clap_encoder(model: str, kind: str = "audio", rate: int = 48_000, device: str = "auto") -> Encoder:
    """Wave files (by path) or texts in the space of a CLAP model, by the transformers library, where it is installed.

    ``rate`` is the files' rate; it must be the one the model was made for, else its features are meaningless.
    """
    import transformers

    from reelspan.sources.media import load_wav

    class Clap:
        name = f"{model}/{kind}/{rate}"
        _parts = None

        def encode(self, items: list[str]) -> list:
            import torch

            if Clap._parts is None:
                Clap._parts = transformers.ClapModel.from_pretrained(model).to(_device(device)), transformers.ClapProcessor.from_pretrained(model)
                want = Clap._parts[1].feature_extractor.sampling_rate
                if want != rate:
                    raise ValueError(f"{model} needs {want} samples a second, not {rate}")
            net, prepare = Clap._parts
            with torch.no_grad():
                if kind == "text":
                    return _unit_rows(net.get_text_features(**prepare(text=items, return_tensors="pt", padding=True, truncation=True).to(net.device)), [True] * len(items))
                waves = [load_wav(open(p, "rb").read()) if p else None for p in items]
                some = [w for w in waves if w is not None and len(w)]
                if not some:
                    return [None] * len(items)
                return _unit_rows(net.get_audio_features(**prepare(audios=some, sampling_rate=rate, return_tensors="pt").to(net.device)), [w is not None and bool(len(w)) for w in waves])

    return Clap()


def some_usable(df: DataFrame, column: str, what: str) -> DataFrame:
    """``df``, of which at least one row must have a vector in ``column``, if it has any rows: that all failed is no result."""
    if df.where(F.col(column).isNotNull()).isEmpty() and not df.isEmpty():
        raise ValueError(f"no {what} could be encoded")
    return df


def zero_filled(df: DataFrame, column: str, width: int) -> DataFrame:
    """Missing vectors as zeros, as a dense matrix has them; their similarity to anything is 0."""
    return df.withColumn(column, F.coalesce(column, F.array_repeat(F.lit(0.0).cast("float"), width)))
