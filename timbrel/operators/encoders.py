"""Encoders with given weights, in numpy: a recurrent timbre encoder and a transformer for emotion.

Weights are arrays under the names that the public model classes use, in an ``.npz`` or checkpoint
file that Spark reads once and broadcasts; its size is checked first.  Names that an encoder does
not need are ignored.
"""

from __future__ import annotations

import functools
import io
import math
import pickle
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.operators import slices

#: Bytes of a weights file, at most: every worker holds it.
MAX_WEIGHTS = 2 << 30
#: Fixed values of the public emotion model: strides of its convolutions, heads, groups of the position convolution, epsilon, what it rates.
STRIDES, HEADS, GROUPS, EPSILON = (5, 2, 2, 2, 2, 2, 2), 16, 16, 1e-5
LOGITS = ("arousal", "dominance", "valence")

Weights = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class LstmEncoder:
    """(slices, frames, bands) to unit vectors: last hidden state of the last layer, a linear layer, negatives cut."""

    def __init__(self, weights: Weights):
        self.layers = []
        while f"lstm.weight_ih_l{len(self.layers)}" in weights:
            k = len(self.layers)
            self.layers.append((weights[f"lstm.weight_ih_l{k}"].T, weights[f"lstm.weight_hh_l{k}"].T, weights[f"lstm.bias_ih_l{k}"] + weights[f"lstm.bias_hh_l{k}"]))
        if not self.layers:
            raise ValueError("the weights have no layer lstm.weight_ih_l0")
        self.weight, self.bias = weights["linear.weight"].T, weights["linear.bias"]

    def __call__(self, mels: np.ndarray) -> np.ndarray:
        x = np.asarray(mels, np.float32)
        for into, again, bias in self.layers:
            n = again.shape[0]
            pushed = x @ into + bias
            hidden, cell, out = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros((*x.shape[:2], n))
            for t in range(x.shape[1]):
                gates = pushed[:, t] + hidden @ again
                enter, keep, fresh, leave = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n : 3 * n], gates[:, 3 * n :]
                cell = sigmoid(keep) * cell + sigmoid(enter) * np.tanh(fresh)
                hidden = sigmoid(leave) * np.tanh(cell)
                out[:, t] = hidden
            x = out
        y = np.maximum(x[:, -1] @ self.weight + self.bias, 0)
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def standardized(x: np.ndarray) -> np.ndarray:
    """Zero mean, unit variance."""
    x = np.asarray(x, np.float64)
    return (x - x.mean()) / np.sqrt(x.var() + 1e-7)


def gelu(x: np.ndarray) -> np.ndarray:
    """x times the normal distribution function, which a rational formula gives to seven digits."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z) / 2
    return x * np.where(x < 0, tail, 1 - tail)


def convolved(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, stride: int = 1, groups: int = 1) -> np.ndarray:
    """(time, in) to (time, out) by a (out, in / groups, width) kernel, no padding."""
    out, inner, width = weight.shape
    windows = np.lib.stride_tricks.sliding_window_view(x, width, axis=0)[::stride]  # (time, in, width)
    windows = windows.reshape(len(windows), groups, inner * width)
    kernel = weight.reshape(groups, out // groups, inner * width)
    return np.einsum("tgi,goi->tgo", windows, kernel, optimize=True).reshape(len(windows), out) + bias


class EmotionEncoder:
    """One recording's samples to the time mean of a transformer's hidden states; ``logits`` rates it."""

    def __init__(self, weights: Weights, strides: tuple[int, ...] = STRIDES, heads: int = HEADS, groups: int = GROUPS):
        self.w = {k.removeprefix("wav2vec2."): np.asarray(v, np.float32) for k, v in weights.items()}
        self.strides, self.heads, self.groups = strides, heads, groups
        place = "encoder.pos_conv_embed.conv."
        size, direction = (self.w[k] if k in self.w else self.w[place + "parametrizations.weight." + old] for k, old in ((place + "weight_g", "original0"), (place + "weight_v", "original1")))
        self.position = size * direction / np.sqrt((direction**2).sum(axis=(0, 1), keepdims=True))
        self.depth = 0
        while f"encoder.layers.{self.depth}.layer_norm.weight" in self.w:
            self.depth += 1
        #: Samples that give one frame.
        self.least = 1
        for i in range(len(strides) - 1, -1, -1):
            self.least = (self.least - 1) * strides[i] + self.w[f"feature_extractor.conv_layers.{i}.conv.weight"].shape[2]

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[name + ".weight"].T + self.w[name + ".bias"]

    def _norm(self, name: str, x: np.ndarray) -> np.ndarray:
        x = (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + EPSILON)
        return x * self.w[name + ".weight"] + self.w[name + ".bias"]

    def _attention(self, name: str, x: np.ndarray) -> np.ndarray:
        apart = lambda y: y.reshape(len(x), self.heads, -1).transpose(1, 0, 2)
        query, key, value = (apart(self._linear(f"{name}.{k}_proj", x)) for k in "qkv")
        score = query @ key.transpose(0, 2, 1) / np.sqrt(query.shape[-1])
        share = np.exp(score - score.max(axis=-1, keepdims=True))
        share /= share.sum(axis=-1, keepdims=True)
        return self._linear(f"{name}.out_proj", (share @ value).transpose(1, 0, 2).reshape(len(x), -1))

    def hidden(self, samples: np.ndarray) -> np.ndarray:
        """(time, size) hidden states; a recording too short for a frame is followed by silence."""
        x = standardized(samples) if len(samples) else np.zeros(0)
        x = np.pad(x, (0, max(0, self.least - len(x))))[:, None].astype(np.float32)
        for i, stride in enumerate(self.strides):
            layer = f"feature_extractor.conv_layers.{i}"
            x = gelu(self._norm(layer + ".layer_norm", convolved(x, self.w[layer + ".conv.weight"], self.w[layer + ".conv.bias"], stride)))
        x = self._linear("feature_projection.projection", self._norm("feature_projection.layer_norm", x))
        width = self.position.shape[2]
        padded = np.pad(x, ((width // 2, width // 2), (0, 0)))
        x = x + gelu(convolved(padded, self.position, self.w["encoder.pos_conv_embed.conv.bias"], 1, self.groups)[: len(x)])
        for i in range(self.depth):
            layer = f"encoder.layers.{i}"
            x = x + self._attention(layer + ".attention", self._norm(layer + ".layer_norm", x))
            inner = gelu(self._linear(layer + ".feed_forward.intermediate_dense", self._norm(layer + ".final_layer_norm", x)))
            x = x + self._linear(layer + ".feed_forward.output_dense", inner)
        return self._norm("encoder.layer_norm", x)

    def __call__(self, samples: np.ndarray) -> np.ndarray:
        return self.hidden(samples).mean(axis=0)

    def logits(self, samples: np.ndarray) -> np.ndarray:
        return self._linear("classifier.out_proj", np.tanh(self._linear("classifier.dense", self(samples))))


#: Fixed values of the public checkpoint format: number and version that a plain file starts with, and its kinds of storage.
MAGIC, VERSION = 0x1950A86A20F9469CFC6C, 1001
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "?"}


def _strided(storage: np.ndarray, offset: int, size: tuple, stride: tuple, *_) -> np.ndarray:
    """A tensor as a view of its storage, inside it."""
    last = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset - 1
    if offset < 0 or min(stride, default=0) < 0 or last >= len(storage):
        raise ValueError("a tensor reaches beyond its storage")
    return np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride])


class _Reader(pickle.Unpickler):
    """Reads tensors and plain containers only; any other class in the file is refused."""

    def __init__(self, file, storage: Callable[[str, str, int], np.ndarray]):
        super().__init__(file)
        self.storage = storage

    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        if module in ("torch", "torch.storage") and name in STORAGES:
            return name
        if module == "torch._utils" and name in ("_rebuild_tensor", "_rebuild_tensor_v2"):
            return _strided
        if module == "torch._utils" and name == "_rebuild_parameter":
            return lambda data, *_: data
        raise ValueError(f"{module}.{name} is no part of a checkpoint of weights")

    def persistent_load(self, key: tuple) -> np.ndarray:
        _, kind, name, _, size = key[:5]
        return self.storage(kind, str(name), int(size))


def checkpoint(raw: bytes) -> Weights:
    """The arrays of a checkpoint file, packed or plain, read without the library that wrote it; those under ``model_state``, if it has that."""
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as packed:
            body = next(n for n in packed.namelist() if n.endswith("/data.pkl"))
            base = body.removesuffix("data.pkl")
            found = _Reader(io.BytesIO(packed.read(body)), lambda kind, name, size: np.frombuffer(packed.read(f"{base}data/{name}"), STORAGES[kind])[:size]).load()
    else:
        file, made = io.BytesIO(raw), {}

        def storage(kind: str, name: str, size: int) -> np.ndarray:
            return made.setdefault(name, np.zeros(min(size, len(raw)), STORAGES[kind]))

        plain = lambda: _Reader(file, storage).load()
        if (plain(), plain()) != (MAGIC, VERSION):
            raise ValueError("not a checkpoint of weights")
        plain()
        found = plain()
        for name in plain():  # the storages follow, each after its length
            size = int.from_bytes(file.read(8), "little")
            made[str(name)][:] = np.frombuffer(file.read(size * made[str(name)].itemsize), made[str(name)].dtype)
    found = found.get("model_state", found)
    return {k: np.array(v) for k, v in found.items() if isinstance(v, np.ndarray)}


def load_weights(spark: SparkSession, path: str, most: int = MAX_WEIGHTS) -> Weights:
    """The arrays of an .npz or checkpoint file in any store that Spark reads; larger files, and objects other than arrays, are refused."""
    file = spark.read.format("binaryFile").load(path)
    size = file.agg(F.sum("length")).first()[0]
    if not size or size > most:
        raise ValueError(f"{path} has {size or 0} bytes; 1 to {most} are possible")
    raw = bytes(file.select("content").first()[0])
    if raw[:2] == b"PK" and not any(n.endswith("/data.pkl") for n in zipfile.ZipFile(io.BytesIO(raw)).namelist()):
        with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
            return {name: arrays[name] for name in arrays.files}
    return checkpoint(raw)


def _built(kind: type, sent, **options):
    return kind(sent.value, **options)


def use_timbre_weights(spark: SparkSession, path: str, name: str = "timbre") -> None:
    """From now on the encoder ``name`` is the recurrent one with these weights."""
    sent = spark.sparkContext.broadcast(load_weights(spark, path))
    slices.register_encoder(name, functools.partial(_built, LstmEncoder, sent))


def use_emotion_weights(spark: SparkSession, path: str, name: str = "emotion", **options) -> None:
    """From now on the encoder ``name`` is the transformer with these weights, over whole recordings."""
    sent = spark.sparkContext.broadcast(load_weights(spark, path))
    slices.register_whole_encoder(name, functools.partial(_built, EmotionEncoder, sent, **options))


def emotion_logits(waves: DataFrame, name: str = "emotion") -> DataFrame:
    """(id, filename, arousal, dominance, valence) of recordings, by the encoder set by ``use_emotion_weights``."""
    make = slices.whole_encoder(name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            rated = [model.logits(np.asarray(x, np.float32)) for x in pdf["samples"]]
            yield pd.DataFrame({"id": pdf["id"], "filename": pdf["filename"], **{k: [float(r[i]) for r in rated] for i, k in enumerate(LOGITS)}})

    return waves.select("id", "filename", "samples").mapInPandas(run, "id long, filename string, " + ", ".join(f"{k} double" for k in LOGITS))
