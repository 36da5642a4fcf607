"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the letters of a text in pieces: runs of letters (a to z after folding A to Z,
and all bytes of other characters), cut at ``PIECE`` bytes. In a piece it reads the bytes forward
and backward, labels every position with the probability of each language, and a document's
probability is the mean over all its positions. It is trained in numpy by backpropagation through
time on words of a bounded sample: at most ``SAMPLE_DOCS`` documents and ``SAMPLE_WORDS`` distinct
words of a language.

Scale: one pass over the texts, no shuffle of them. A piece's labels depend on nothing outside it,
so a task labels each distinct piece once and keeps the sums in a table of at most ``CACHE`` rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without training rows
every text is ``und``; documents without a language are predicted but never learned from; a null
id counts as the empty text for the split; rows that repeat are predicted one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavegraph.llm.common import batched, lower_ascii, raw, slices, split_words, table, word_hashes
from wavegraph.operators.skew import small_side
from wavegraph.session import materialize

HIDDEN = 16
PIECE = 24
SAMPLE_DOCS = 150
SAMPLE_WORDS = 6_000
STEPS = 500
BATCH = 256
CACHE = 400_000
SEED = 5

# The code of a byte: 0 is padding, 1 to 26 are letters, the rest are the bytes beyond ASCII.
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
CODES = 155
_LETTERS = _CODE > 0
_WORD = r"[^\x00-\x60\x7B-\x7F]+"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class ByteNetwork:
    """Two gated recurrent layers, one in each direction, and a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.hidden = hidden
        self.w = {"out": rng.normal(0, 0.2, (2 * hidden, len(languages))), "bias": np.zeros(len(languages))}
        for d in "fb":
            self.w[d + "in"] = rng.normal(0, 0.3, (CODES, 3 * hidden))
            self.w[d + "zr"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2 * hidden))
            self.w[d + "n"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, hidden))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _read(self, d: str, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Hidden states [time, piece, hidden]; padding leaves the state as it is."""
        n, length = codes.shape
        size = self.hidden
        h = np.zeros((n, size), np.float32)
        out = np.zeros((length, n, size), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x = self.w[d + "in"][codes[:, t]]
            zr = _sigmoid(x[:, : 2 * size] + h @ self.w[d + "zr"])
            z, r = zr[:, :size], zr[:, size:]
            new = np.tanh(x[:, 2 * size :] + (r * h) @ self.w[d + "n"])
            live = (codes[:, t] > 0).astype(np.float32)[:, None]
            if trace is not None:
                trace.append((t, h, z, r, new, live))
            h = h + live * z * (new - h)
            out[t] = h
        return out

    def label(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities [time, piece, language]; meaningless at padding."""
        states = np.concatenate([self._read("f", codes), self._read("b", codes)], axis=2)
        return self._softmax(states)

    def _softmax(self, states: np.ndarray) -> np.ndarray:
        score = states @ self.w["out"] + self.w["bias"]
        score -= score.max(axis=2, keepdims=True)
        e = np.exp(score)
        return e / e.sum(axis=2, keepdims=True)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """For each piece, the probabilities summed over its positions."""
        return (self.label(codes) * (codes.T > 0)[:, :, None]).sum(axis=0)

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions, and its gradient by backpropagation through time."""
        size = self.hidden
        traces = {"f": [], "b": []}
        states = np.concatenate([self._read(d, codes, traces[d]) for d in "fb"], axis=2)
        prob = self._softmax(states)
        live = (codes.T > 0).astype(np.float32)
        total = max(1.0, float(live.sum()))
        rows = np.arange(len(target))
        loss = float(-(np.log(prob[:, rows, target] + 1e-9) * live).sum() / total)
        delta = prob
        delta[:, rows, target] -= 1.0
        delta *= (live / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.einsum("tns,tnl->sl", states, delta, optimize=True)
        g["bias"] = delta.sum(axis=(0, 1))
        back = delta @ self.w["out"].T
        for d, own in (("f", back[:, :, :size]), ("b", back[:, :, size:])):
            dh = np.zeros((len(target), size), np.float32)
            for t, h, z, r, new, on in reversed(traces[d]):
                dh = dh + own[t]
                dz = dh * on * (new - h) * z * (1 - z)
                dn = dh * on * z * (1 - new * new)
                drh = dn @ self.w[d + "n"].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                g[d + "n"] += (r * h).T @ dn
                g[d + "zr"] += h.T @ dzr
                np.add.at(g[d + "in"], codes[:, t], np.concatenate([dzr, dn], axis=1))
                dh = dh * (1 - on * z) + drh * r + dzr @ self.w[d + "zr"].T
        return loss, g

    def train(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = STEPS, seed: int = SEED) -> None:
        """Adam; each batch has as many pieces of every language, drawn by weight."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(target == k) for k in range(len(self.languages))]
        chance = [np.cumsum(weight[i]) / weight[i].sum() for i in groups]
        each = max(1, BATCH // len(groups))
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([i[np.searchsorted(c, rng.random(each))] for i, c in zip(groups, chance)])
            used = codes[pick]
            used = used[:, : max(1, int((used > 0).sum(axis=1).max()))]
            _, g = self.gradients(used, target[pick])
            rate = 0.01 if step < 0.7 * steps else 0.003
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def encode(pieces: list[bytes]) -> np.ndarray:
    """Codes [piece, time], padded with 0 to the longest piece."""
    width = max(map(len, pieces), default=1)
    return _CODE[np.frombuffer(b"".join(p.ljust(width, b"\x00") for p in pieces), np.uint8).reshape(len(pieces), width)]


def split_of(id: Column, folds: int = 5) -> Column:
    """The fold of a document by the CRC of its id; fold 0 is held out."""
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train_network(
    docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, steps: int = STEPS,
) -> ByteNetwork | None:
    """A network from the documents of ``docs`` that have a language, or None if there are none.

    The documents of a language with the smallest hashes of their id are its sample. The network
    is small and the sample bounded, so it is trained in one place.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = materialize(
        known.select("lang", "id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_docs)
        .select("lang", "id").distinct()
    )
    sample = known.join(small_side(picked, picked.count()), ["lang", "id"])
    words = (
        sample.select("lang", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_WORD), F.lit(0))).alias("run"))
        # Long runs in pieces, as prediction reads them.
        .select("lang", F.explode(F.expr(
            f"transform(sequence(0, (octet_length(run) - 1) div {PIECE}), i -> substring(cast(run as binary), int(i * {PIECE} + 1), {PIECE}))"
        )).alias("word"))
        .groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("word"), "word")))
        .where(F.col("k") <= sample_words).orderBy("lang", "word")
    )
    rows = words.select("lang", "word", "n").collect()
    if not rows:
        return None
    names = sorted({r["lang"] for r in rows})
    place = {name: k for k, name in enumerate(names)}
    network = ByteNetwork(names)
    codes = encode([bytes(r["word"]) for r in rows])
    weight = np.sqrt(np.array([r["n"] for r in rows], float))
    network.train(codes, np.array([place[r["lang"]] for r in rows]), weight, steps)
    return network


class _Labeler:
    """Predicts batches of texts; labels a distinct piece once as long as the table of known pieces has room."""

    def __init__(self, network: ByteNetwork) -> None:
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.table = np.zeros((1024, len(self.network.languages)), np.float32)

    def _rows(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, keys: list[int]) -> np.ndarray:
        new = [k for k, key in enumerate(keys) if key not in self.known]
        if len(self.known) + len(new) > CACHE:
            self._forget()
            new = list(range(len(keys)))
        for start in range(0, len(new), 4096):
            part = sorted(new[start : start + 4096], key=lambda k: end[k] - first[k])
            for a in range(0, len(part), 512):  # pieces of like length together
                some = part[a : a + 512]
                at = len(self.known)
                while at + len(some) > len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[at : at + len(some)] = self.network.sums(encode([data[first[k] : end[k]].tobytes() for k in some]))
                self.known.update((keys[k], at + j) for j, k in enumerate(some))
        return np.array([self.known[k] for k in keys], np.int64)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for start, stop in slices(texts):
            part = texts.slice(start, stop - start)
            data, first, end, row = split_words(part, _LETTERS, lower=True)
            longest = int((end - first).max()) if len(first) else 0
            if longest > PIECE:
                pieces = -(-(end - first) // PIECE)
                step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                stop_at = np.repeat(end, pieces)
                first = np.repeat(first, pieces) + step * PIECE
                end, row = np.minimum(first + PIECE, stop_at), np.repeat(row, pieces)
            hashes, example, back = np.unique(word_hashes(data, first, end), return_index=True, return_inverse=True)
            sums = self.table[:0]
            if len(hashes):
                at = self._rows(data, first[example], end[example], hashes.tolist())
                sums = self.table[at].astype(float)
            n = stop - start
            total = np.bincount(row, weights=(end - first).astype(float), minlength=n)
            pooled = np.stack([np.bincount(row, weights=sums[back, k], minlength=n) for k in range(self.table.shape[1])], axis=1) if len(hashes) else np.zeros((n, self.table.shape[1]))
            mean = pooled / np.maximum(total, 1)[:, None]
            plain = np.bincount(row[data[first] < 128], minlength=n) if len(first) else np.zeros(n, int)
            for k in range(n):
                # Bytes beyond ASCII may be signs rather than letters; without any letter nothing is said.
                sure = total[k] > 0 and (plain[k] > 0 or any(map(str.isalpha, raw(part)[k].as_py().decode("utf-8", "replace"))))
                names.append(self.network.languages[int(mean[k].argmax())] if sure else "und")
                scores.append(float(min(1.0, round(mean[k].max(), 6))) if sure else 0.0)
        return names, scores


def predict(docs: DataFrame, network: ByteNetwork | None, text: str = "text") -> DataFrame:
    """``docs`` with the columns lang_pred and score, which take the place of any of the same name."""
    base = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kept = docs.select(*(docs[c] for c in base))
    if network is None:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(network))
    at = base.index(text)
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeler = _Labeler(pickle.loads(shared.value))
        for batch in batches:
            names, scores = labeler.predict(batch.column(at).fill_null("" if not pa.types.is_binary(batch.column(at).type) else b""))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[f.name for f in schema]
            )

    return batched(kept).mapInArrow(run, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = split_of(F.col("doc_id"))
    network = train_network(docs.where(fold != 0))
    found = predict(docs.select("doc_id", "text"), network)
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
