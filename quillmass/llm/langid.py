"""Language identification (operator 1): a byte convolutional network, trained in numpy, over fixed windows.

Bytes are embedded; filters of several widths slide over a window, their largest responses pass a rectifier and
a softmax layer. A text's language is the one with the largest mean probability over all its windows, weighted
by their length; no part of a text is left out. ``und`` (score 0) stands for null texts and texts without a letter.

Training reads at most ``Sample.rows`` labelled rows, spread evenly over the languages, chosen by hash of their id
and text; the network is a few thousand numbers, so it is sent with the function. With no labelled row at all,
every text is ``und`` and the pipeline's stage keeps all.

Every row is judged by its own text: repeated rows get equal results, ties of probability go to the first language
in order, ids may be null (never held out), and an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"


@dataclass(frozen=True)
class Sample:
    """The bounds of what the driver learns from."""

    rows: int = 4000
    windows_per_row: int = 3


@dataclass(frozen=True)
class Shape:
    """The network: window and embedding size, filter widths and filters for each."""

    window: int = 192
    embedding: int = 4
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12


class ByteNet:
    """Embedding, convolutions, max pooling, softmax; forward and backward passes in numpy."""

    def __init__(self, languages: list[str], shape: Shape = Shape(), seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.shape = languages, shape
        d, f = shape.embedding, shape.filters
        self.table = rng.normal(0, 0.5, (256, d)).astype(np.float32)
        self.table[0] = 0  # padding
        self.kernels = [rng.normal(0, (2 / (w * d)) ** 0.5, (w * d, f)).astype(np.float32) for w in shape.widths]
        self.biases = [np.zeros(f, np.float32) for _ in shape.widths]
        self.out = rng.normal(0, 0.1, (f * len(shape.widths), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.kernels, *self.biases, self.out, self.out_bias]

    def _unfold(self, embedded: np.ndarray, width: int) -> np.ndarray:
        n, length, d = embedded.shape
        s = embedded.strides
        return np.lib.stride_tricks.as_strided(embedded, (n, length - width + 1, width * d), (s[0], s[1], s[2]), writeable=False)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """The largest response of each filter over each window.

        All widths are one product: narrower filters are padded with zeros, and the places at a window's end
        where only they fit are added.
        """
        widest, d, f = max(self.shape.widths), self.shape.embedding, self.shape.filters
        joint = np.zeros((widest * d, f * len(self.kernels)), np.float32)
        for k, kernel in enumerate(self.kernels):
            joint[: len(kernel), k * f : (k + 1) * f] = kernel
        flat = self._unfold(self.table[windows], widest)
        n, places = flat.shape[:2]
        tops = (np.ascontiguousarray(flat).reshape(-1, widest * d) @ joint).reshape(n, places, -1).max(axis=1)
        for k, (width, kernel) in enumerate(zip(self.shape.widths, self.kernels, strict=True)):
            if width < widest:
                rest = self._unfold(self.table[windows[:, places:]], width)
                tops[:, k * f : (k + 1) * f] = np.maximum(tops[:, k * f : (k + 1) * f], (np.ascontiguousarray(rest) @ kernel).max(axis=1))
        return np.maximum(tops + np.concatenate(self.biases), 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows) @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n, d = len(windows), self.shape.embedding
        embedded = self.table[windows]
        flats, tops, parts = [], [], []
        for width, kernel, bias in zip(self.shape.widths, self.kernels, self.biases, strict=True):
            flat = np.ascontiguousarray(self._unfold(embedded, width))
            response = flat @ kernel
            top = response.argmax(axis=1)
            flats.append(flat)
            tops.append(top)
            parts.append(np.take_along_axis(response, top[:, None, :], axis=1)[:, 0, :] + bias)
        before = np.concatenate(parts, axis=1)
        hidden = np.maximum(before, 0)
        logits = hidden @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        delta = np.exp(logits)
        delta /= delta.sum(axis=1, keepdims=True)
        delta[np.arange(n), labels] -= 1
        delta /= n
        g_out, g_out_bias = hidden.T @ delta, delta.sum(axis=0)
        g_hidden = (delta @ self.out.T) * (before > 0)
        g_embedded = np.zeros_like(embedded)
        g_kernels, g_biases = [], []
        f = self.shape.filters
        for k, (width, kernel) in enumerate(zip(self.shape.widths, self.kernels, strict=True)):
            g = g_hidden[:, k * f : (k + 1) * f]
            chosen = flats[k][np.arange(n)[:, None], tops[k]]  # n, filters, width * d
            g_kernels.append(np.einsum("nfk,nf->kf", chosen, g))
            g_biases.append(g.sum(axis=0))
            back = g[:, :, None] * kernel.T[None]
            for j in range(width):
                np.add.at(g_embedded, (np.arange(n)[:, None], tops[k] + j), back[:, :, j * d : (j + 1) * d])
        g_table = np.zeros_like(self.table)
        np.add.at(g_table, windows, g_embedded)
        g_table[0] = 0
        return [g_table, *g_kernels, *g_biases, g_out, g_out_bias]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteNet:
        """Adam on cross-entropy, the rate falling to nought."""
        rng = np.random.default_rng(seed)
        ps = self.parameters()
        first, second = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps]
        steps, t = max(1, epochs * -(-len(windows) // batch)), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                t += 1
                pick = order[at : at + batch]
                lr = rate * (1 - (t - 1) / steps)
                for p, g, m, v in zip(ps, self.gradients(windows[pick], labels[pick]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return self

    def predict(self, texts: list[bytes], budget: int = 32) -> tuple[list[str], list[float]]:
        """Language and score of each text from all its windows, ``budget`` windows at a time."""
        size = self.shape.window
        n = np.array([len(t) for t in texts], dtype=np.int64)
        per = np.maximum(1, -(-n // size))
        sums = np.zeros((len(texts), len(self.languages)))
        owner = np.repeat(np.arange(len(texts)), per)
        data = np.frombuffer(b"".join(t.ljust(int(k) * size, b"\0") for t, k in zip(texts, per, strict=True)), np.uint8).reshape(-1, size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        weight = np.clip(n[owner] - place * size, 1, size).astype(np.float64)
        for at in range(0, len(data), budget):
            part = slice(at, at + budget)
            np.add.at(sums, owner[part], self.probabilities(data[part]) * weight[part, None])
        sums /= np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
        best = sums.argmax(axis=1)
        return [self.languages[b] for b in best], [float(x) for x in sums[np.arange(len(texts)), best]]


def windows_of(text: bytes, size: int, most: int) -> list[bytes]:
    """At most ``most`` windows of a text, spread over all of it; for training only."""
    starts = range(0, max(1, len(text)), size)
    step = max(1, len(starts) // most)
    return [text[s : s + size].ljust(size, b"\0") for s in starts[::step][:most]]


def sample_rows(labelled: DataFrame, sample: Sample, span: int, text_col: str, lang_col: str, id_col: str) -> tuple[list[str], list]:
    """The languages, and lang, key, text of at most a share of rows for each, all chosen by a hash of id and text.

    Repeated rows have one hash and count once, so neither they nor rows without id crowd out others. The hash first
    leaves about 1.2 shares of each language; of these a window keeps exactly one share, so the driver never gets more
    than ``sample.rows`` rows of ``span`` characters. A language that the hash leaves without rows is tried again with a wider one.
    """
    has = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    keyed = has.select(F.col(lang_col).alias("lang"), key.alias("key"), F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 30)).alias("turn"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("whole"))
    counts = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()}
    languages = sorted(counts)
    share = max(1, sample.rows // max(1, len(languages)))
    # a long text is read from a place of its own, not always from its start
    at = F.lit(1) + F.pmod(F.xxhash64("id", F.lit(1)), F.greatest(F.lit(1), F.length("whole") - span).cast("long")).cast("int")
    found, left, wider = [], languages, 1.2
    while left:
        cuts = F.create_map(*[x for lang in left for x in (F.lit(lang), F.lit(min(1 << 30, int((wider * share + 20) / max(1, counts[lang]) * (1 << 30)) + 1)))])
        few = keyed.filter(F.col("lang").isin(left) & (F.col("turn") < F.element_at(cuts, F.col("lang"))))
        once = few.select("lang", "key", "turn", F.col("whole").substr(at, F.lit(span)).alias("text")).dropDuplicates(["lang", "key"])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "key"))
        rows = once.withColumn("place", place).filter(F.col("place") <= share).select("lang", "key", "text").collect()
        found += rows
        left = sorted(set(left) - {r.lang for r in rows})
        wider *= 16
    return languages, found


def train(labelled: DataFrame, sample: Sample = Sample(), shape: Shape = Shape(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> ByteNet | None:
    """A network from at most ``sample.rows`` rows of ``labelled``, None if it has no labelled text."""
    span = shape.window * 8 * sample.windows_per_row
    languages, rows = sample_rows(labelled, sample, span, text_col, lang_col, id_col)
    windows, labels = [], []
    for lang, _, text in sorted(rows, key=lambda r: (r[1], r[0])):
        for w in windows_of(text.encode("utf-8", "replace"), shape.window, sample.windows_per_row):
            windows.append(np.frombuffer(w, np.uint8))
            labels.append(languages.index(lang))
    if not windows:
        return None
    return ByteNet(languages, shape).fit(np.array(windows), np.array(labels))


def language(text: Column, net: ByteNet | None) -> Column:
    """struct(lang_pred, score) of a whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if net is not None:
            lettered = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
            for at in range(0, len(lettered), 256):
                part = lettered[at : at + 256]
                found = net.predict([texts.iloc[i].encode("utf-8", "replace") for i in part])
                for i, lang, score in zip(part, *found, strict=True):
                    langs[i], scores[i] = lang, score
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predicted(F.coalesce(text.cast("string"), F.lit("")))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 modulo 4 (null ids are never held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, net: ByteNet | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text enters the prediction."""
    found = documents.select("doc_id", held_out().alias("held_out"), language(F.col("text"), net).alias("_p"))
    return found.select("doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(documents: DataFrame, net: ByteNet | None, least: float = 0.35) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``; same columns. Without a network all stay."""
    if net is None:
        return documents
    found = language(F.col("text"), net)
    return documents.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least))
