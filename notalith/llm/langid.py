"""Language identification by a byte convolutional network, trained in numpy.

Bytes (UTF-8, ASCII letters lowered) are embedded, convolved by filters of several widths,
max-pooled over a fixed-length window and classed by softmax. At inference a filter's response
is a sum of table lookups, a table entry for each byte pair, so batches of windows cost a few
gathers a byte. A text is cut into windows without remainder, never into a prefix, and its
probabilities are the mean over windows, weighted by window length.

Training reads a bounded, deterministic sample: `per_lang` rows of each language with the
smallest hashes of doc_id and text, and `windows` windows of each; where per_lang * MAX_LANGS
rows would be passed, every language has fewer, but none has none. Rows that repeat id, text and
language are one row of it. Null texts and texts without letters are `und` with score 0. Rows
without lang are not learned from; with no learnable row at all every text is `und`. Texts are
classed whole, however long. Other columns have no influence; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, table

#: Rows a language that training reads at most, windows it takes of each, and languages that may have as many.
PER_LANG, TRAIN_WINDOWS, MAX_LANGS = 400, 4, 200
#: Shares of a language in which its sample is drawn first.
SPREAD = 32
WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS, DIM = 16, 12
#: Windows of an inference batch; with WINDOW and FILTERS it bounds memory.
BATCH = 512
UND = "und"


def as_windows(data: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(windows, lengths): all bytes of data, the last window filled up with zeros."""
    n = max(1, -(-len(data) // size))
    flat = np.zeros(n * size, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    lengths = np.full(n, size, np.int64)
    lengths[-1] = len(data) - (n - 1) * size
    return flat.reshape(n, size), lengths


class ByteCNN:
    """emb (256, DIM), a filter bank (width * DIM, FILTERS) for each width, and the output layer."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.emb = r.normal(0, 0.3, (256, DIM)).astype(np.float32)
        self.conv = [r.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(classes)))).astype(np.float32)
        self.out_bias = np.zeros(max(1, len(classes)), np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.emb, *self.conv, self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients on a batch of windows."""
        n, e = len(x), self.emb[x]
        pooled, kept = [], []
        for w, c in zip(WIDTHS, self.conv, strict=True):
            t = x.shape[1] - w + 1
            cols = np.concatenate([e[:, j : j + t] for j in range(w)], axis=2)
            resp = (cols.reshape(-1, w * DIM) @ c).reshape(n, t, FILTERS)
            best = resp.argmax(1)
            pooled.append(np.take_along_axis(resp, best[:, None], 1)[:, 0])
            kept.append(best)
        z = np.concatenate(pooled, 1) + self.bias
        h = np.maximum(z, 0)
        logits = h @ self.out + self.out_bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(n), y] + 1e-9).mean()
        d = p.copy()
        d[np.arange(n), y] -= 1
        d /= n
        dz = (d @ self.out.T) * (z > 0)
        g_emb, g_conv = np.zeros_like(self.emb), []
        for k, (w, c) in enumerate(zip(WIDTHS, self.conv, strict=True)):
            dr = dz[:, k * FILTERS : (k + 1) * FILTERS]
            at = kept[k][:, :, None] + np.arange(w)  # window, filter, byte of the filter
            byte = x[np.arange(n)[:, None, None], at]
            cols = self.emb[byte].reshape(n, FILTERS, w * DIM)
            g_conv.append(np.einsum("nfd,nf->df", cols, dr))
            back = (dr[:, :, None] * c.T[None]).reshape(-1, DIM)
            np.add.at(g_emb, byte.reshape(-1), back)
        return loss, [g_emb, *g_conv, dz.sum(0), h.T @ d, d.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 11) -> ByteCNN:
        r, t = np.random.default_rng(seed), 0
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                _, grads = self.step(x[order[i : i + batch]], y[order[i : i + batch]])
                t += 1
                for p, g, a, b in zip(self.params(), grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
        return self

    def lookups(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width tables of responses: to the first byte pair, and to the rest."""
        out = []
        for w, c in zip(WIDTHS, self.conv, strict=True):
            one = [self.emb @ c[j * DIM : (j + 1) * DIM] for j in range(w)]
            pair = lambda a, b: (one[a][:, None] + one[b][None]).reshape(65536, FILTERS)  # noqa: B023, E731
            out.append((pair(0, 1), None if w == 2 else one[2] if w == 3 else pair(2, 3)))
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        pooled = []
        for w, (first, rest) in zip(WIDTHS, tables, strict=True):
            t = x.shape[1] - w + 1
            resp = first[pairs[:, :t]]
            if w == 3:
                resp += rest[x[:, 2 : 2 + t]]
            elif w == 4:
                resp += rest[pairs[:, 2 : 2 + t]]
            pooled.append(resp.max(1))
        h = np.maximum(np.concatenate(pooled, 1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()


def train(docs: DataFrame, per_lang: int = PER_LANG, windows: int = TRAIN_WINDOWS) -> ByteCNN:
    """A network fitted on a bounded sample of docs(doc_id, text, lang); rows without either are ignored."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    ids = usable.select("lang", "_h").distinct().withColumn("_s", F.pmod("_h", F.lit(SPREAD)))
    for by in (("lang", "_s"), ("lang",)):  # first within shares of a language, so that no task sees all of it
        ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= per_lang)
    ids = ids.orderBy("_r", "lang").limit(per_lang * MAX_LANGS).select("lang", "_h")
    n = F.char_length("text")
    # the windows' characters: from evenly spread places of the text
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda i: F.substring("text", F.floor(F.greatest(n - WINDOW, F.lit(0)) * i / max(1, windows - 1)).cast("int") + 1, F.lit(WINDOW)))
    # per_lang * MAX_LANGS rows at most
    sample = usable.join(F.broadcast(ids), ["lang", "_h"]).select("lang", "_h", F.array_distinct(cut).alias("cuts")).dropDuplicates(["lang", "_h"]).collect()
    sample.sort(key=lambda r: (r["lang"], r["_h"]))
    classes = sorted({r["lang"] for r in sample})
    x, y = [], []
    for r in sample:
        for c in r["cuts"]:
            x.append(as_windows(lowered(c))[0][0])
            y.append(classes.index(r["lang"]))
    net = ByteCNN(classes)
    return net.fit(np.array(x), np.array(y)) if len(classes) > 1 else net


def classify(batches: Iterator[pa.RecordBatch], net: ByteCNN) -> Iterator[pa.RecordBatch]:
    """Adds lang_pred and score to batches with _text and _letter; drops those two."""
    tables = net.lookups()
    for batch in batches:
        texts, letter = batch.column("_text").to_pylist(), batch.column("_letter").to_pylist()
        pred, score = [UND] * len(texts), [0.0] * len(texts)
        sums = np.zeros((len(texts), len(net.classes)))
        total = np.zeros(len(texts))
        x, owner, weight, have = [], [], [], 0

        def flush() -> None:
            nonlocal x, owner, weight, have
            if x:
                xs, o, w = np.concatenate(x), np.concatenate(owner), np.concatenate(weight)
                for i in range(0, len(xs), BATCH):
                    p = net.probabilities(xs[i : i + BATCH], tables) * w[i : i + BATCH, None]
                    np.add.at(sums, o[i : i + BATCH], p)
                    np.add.at(total, o[i : i + BATCH], w[i : i + BATCH])
            x, owner, weight, have = [], [], [], 0

        for i, t in enumerate(texts):
            if letter[i] and net.classes:
                a, n = as_windows(lowered(t))
                x.append(a)
                owner.append(np.full(len(a), i))
                weight.append(n.astype(np.float64))
                have += len(a)
                if have >= 8 * BATCH:
                    flush()
        flush()
        for i in np.flatnonzero(total):
            p = sums[i] / total[i]
            k = int(p.argmax())
            pred[i], score[i] = net.classes[k], float(min(1.0, max(0.0, p[k])))
        keep = [n for n in batch.schema.names if n not in ("_text", "_letter")]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])


def identify(docs: DataFrame, net: ByteCNN, columns: list[str]) -> DataFrame:
    """The columns named, and lang_pred and score of every row's whole text."""
    small_batches(docs.sparkSession)
    src = docs.select(*columns, F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return src.mapInArrow(lambda b: classify(b, net), f"{shape}, lang_pred string, score double")


def training_part(docs: DataFrame) -> DataFrame:
    """The rows whose crc32(doc_id as text) mod 4 is not 2."""
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", held, "text"), train(training_part(docs)), ["doc_id", "held_out"])
