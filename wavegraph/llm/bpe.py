"""BPE encoding and decoding by speculation and verification.

The exact encoding of a word merges its symbols pair by pair, the pair of the lowest rank first.
Here a word's tokens are first guessed: from the left, always the longest token that fits. Then all
words of a batch are verified together: a sequence of tokens is the exact encoding if every token
is the encoding of its own symbols and no merge reaches over the border of two adjacent tokens. For
a border, the merges that made the right edge of the left token and the left edge of the right token
are taken back in the reverse of their order; two pieces that lay side by side at the same time must
have no merge that comes before the next merge of either. That is a few table lookups for a whole
column of distinct pairs. Only words that fail are merged exactly.

Scale: documents are neither shuffled nor split; the vocabulary, read on the driver from a path
that is a parameter, is broadcast (some megabytes, whatever the corpus). A task keeps the encodings of
``CACHE_WORDS`` words of at most ``CACHE_CHARS`` characters, and takes a text in pieces of ``PIECE``
characters, cut at blanks, which no token holds; a piece without blanks stays whole.

Defined cases: a null text is the empty text, which has no ids; bytes that are not UTF-8 count as
U+FFFD; a special token's string inside a text is that token, as in the library; unknown ids are
left out of a decoded text; repeated rows and extra columns are kept as they are.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavegraph.llm.common import byte_list, table

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 300_000
CACHE_CHARS = 64
PIECE = 1 << 20
SLICE_TEXTS = 64
# Words of more symbols are merged with a heap.
FEW_SYMBOLS = 50

# Scripts whose characters Python's Unicode tables and the library's agree on (tests compare each);
# a text with any other character has its words found by the library's own normalizer.
_OTHER = re.compile(
    "[^\x00-՗֍-ࢎऀ-௿Ḁ-ⁿ₠-⿿　-ꟊ가-힣豈-﷿\U0001f000-\U0001faff]"
)
_ASCII_CLASSES = {r"\p{L}": "a-zA-Z", r"\p{N}": "0-9", r"\s": r"\t-\r "}


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and splitting rules of one tokenizer file. Small enough to be sent to every executor."""

    def __init__(self, text: str) -> None:
        self.json = text
        whole = json.loads(text)
        model, rules = whole["model"], whole["pre_tokenizer"]["pretokenizers"]
        steps = [n["type"] for n in whole["normalizer"]["normalizers"]]
        if (model["type"], whole["decoder"], steps, [r["type"] for r in rules]) != (
            "BPE", None, ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
        ):
            raise ValueError("not a tokenizer of words with ends")
        self.pattern = rules[0]["pattern"]["Regex"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.size = 1 + max(*self.ids.values(), *self.special.values())
        self.rank = np.full(self.size, -1)
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        made = []
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            token = self.ids[a + b]
            if self.rank[token] >= 0:
                raise ValueError("a token with two merges")
            self.rank[token], self.left[token], self.right[token] = k, self.ids[a], self.ids[b]
            made.append(self.left[token] * self.size + self.right[token])
        self.merge_rank = np.argsort(made, kind="stable")
        self.merge_key = np.array(made, np.int64)[self.merge_rank]
        self.token_of_rank = np.zeros(len(made), np.int64)
        self.token_of_rank[self.rank[self.rank >= 0]] = np.flatnonzero(self.rank >= 0)
        # A token is sound if its own symbols are encoded as it: both halves are, and nothing reaches over their border before.
        sound = np.ones(self.size, bool)
        for token in self.token_of_rank:
            sound[token] = sound[self.left[token]] & sound[self.right[token]]
        merged = self.token_of_rank
        clear = self.separate(self.left[merged], self.right[merged], self.rank[merged])
        sound[merged[~clear]] = False
        for token in self.token_of_rank:
            sound[token] &= sound[self.left[token]] & sound[self.right[token]]
        self.sound = sound

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of merging a with b; beyond all ranks where there is no such merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        return np.where(self.merge_key[at] == key, self.merge_rank[at], len(self.merge_key))

    def separate(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of adjacent tokens, whether no merge reaches over their border (before rank ``until``)."""
        never = len(self.merge_key)
        u, v = a.copy(), b.copy()
        # The rank at which the piece on either side is merged into the next larger one.
        next_u = np.full(len(a), never) if until is None else until.copy()
        next_v = next_u.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            across = self._rank_of_pair(u[live], v[live])
            # Of equal merges the left one comes first: a u that waits for the same merge is taken by its left neighbour.
            wrong = (across < next_u[live]) & (across <= next_v[live]) & (across < never)
            good[live[wrong]] = False
            back_v = self.rank[v[live]] >= self.rank[u[live]]
            on = ~wrong & (np.maximum(self.rank[u[live]], self.rank[v[live]]) >= 0)
            right, left = live[on & back_v], live[on & ~back_v]
            next_v[right], next_u[left] = self.rank[v[right]], self.rank[u[left]]
            v[right], u[left] = self.left[v[right]], self.right[u[left]]
            live = live[on]
        return good

    @cached_property
    def symbols(self) -> list[str]:
        return _byte_symbols()

    @cached_property
    def pieces(self) -> tuple[dict[bytes, int], dict[bytes, int], dict[bytes, int]]:
        """Tokens inside words and at their ends, by their bytes; the longest inner token by its first three bytes."""
        byte = {s: b for b, s in enumerate(self.symbols)}
        inner, last, longest = {}, {}, {}
        for token, number in self.ids.items():
            ends = token.endswith(self.suffix) and token != self.suffix
            raw = bytes(byte[c] for c in (token[: -len(self.suffix)] if ends else token))
            (last if ends else inner)[raw] = number
            if not ends:
                longest[raw[:3]] = max(len(raw), longest.get(raw[:3], 0))
        return inner, last, longest

    @cached_property
    def names(self) -> np.ndarray:
        names = np.full(self.size, None, object)
        for token, number in (*self.ids.items(), *self.special.items()):
            names[number] = token
        return names

    @cached_property
    def token_list(self) -> list[int]:
        return self.token_of_rank.tolist()

    @cached_property
    def merges(self) -> dict[int, int]:
        return dict(zip(self.merge_key.tolist(), self.merge_rank.tolist()))

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_str(self.json)

    def propose(self, word: bytes) -> list[int]:
        """From the left, always the longest token; the last byte belongs to a token that ends words."""
        inner, last, longest = self.pieces
        out, at, size = [], 0, len(word)
        while True:
            end = last.get(word[at:])
            if end is not None:
                out.append(end)
                return out
            stop = min(at + longest.get(word[at : at + 3], 2), size - 1)
            while (token := inner.get(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, of equal ones the leftmost."""
        inner, last, _ = self.pieces
        tokens = [inner[word[i : i + 1]] for i in range(len(word) - 1)] + [last[word[-1:]]]
        return self._merge_few(tokens) if len(tokens) <= FEW_SYMBOLS else self._merge_many(tokens)

    def _merge_few(self, tokens: list[int]) -> list[int]:
        size, rank_of, token_of, never = self.size, self.merges.get, self.token_list, len(self.merge_key)
        ranks = [rank_of(a * size + b, never) for a, b in zip(tokens, tokens[1:])]
        while ranks and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            tokens[i] = token = token_of[rank]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(tokens[i - 1] * size + token, never)
            if i < len(ranks):
                ranks[i] = rank_of(token * size + tokens[i + 1], never)
        return tokens

    def _merge_many(self, tokens: list[int]) -> list[int]:
        n, size, ranks, token_of = len(tokens), self.size, self.merges, self.token_list
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (r := ranks.get(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = token_of[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := ranks.get(tokens[x] * size + tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, as packed 32-bit integers; guessed one by one, verified together."""
        raw = [w.encode() for w in words]
        guesses = [self.propose(w) for w in raw]
        count = np.fromiter(map(len, guesses), np.int64, len(words))
        tokens = np.fromiter(chain.from_iterable(guesses), np.int64, int(count.sum()))
        owner = np.repeat(np.arange(len(words)), count)
        fails = np.zeros(len(words), bool)
        fails[owner[~self.sound[tokens]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inside] * self.size + tokens[inside + 1], return_inverse=True)
        fails[owner[inside[~self.separate(pairs // self.size, pairs % self.size)[which]]]] = True
        packed = tokens.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        out = [packed[start:end] for start, end in zip([0, *ends], ends)]
        for k in np.flatnonzero(fails).tolist():
            out[k] = array("i", self.merge(raw[k])).tobytes()
        return out

    @cached_property
    def _rules(self) -> tuple[re.Pattern, regex.Pattern, re.Pattern]:
        plain = self.pattern
        for name, ascii_class in _ASCII_CLASSES.items():
            plain = plain.replace(f"[{name}]", f"[{ascii_class}]").replace(name, ascii_class)
        special = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        return re.compile(plain), regex.compile(self.pattern), re.compile(f"({special})")

    def _words(self, text: str) -> list[str]:
        """The normalized words of a text without special tokens."""
        plain, full, _ = self._rules
        if text.isascii():
            return plain.findall(text.lower())
        if _OTHER.search(text) is None:
            # The library folds each character by itself, so a sigma at the end of a word is like any other.
            return full.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        byte = {ord(s): b for b, s in enumerate(self.symbols)}
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, map(ord, w))).decode() for w, _ in split]

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """The words of a text, piece by piece, and the special tokens between them."""
        _, _, special = self._rules
        for part in special.split(text) if self.special else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            start = 0
            while start < len(part):
                end = len(part)
                if end - start > PIECE:
                    blank = re.compile("[ \n]").search(part, start + PIECE)
                    end = blank.start() if blank else end
                yield self._words(part[start:end])
                start = end

    def encode(self, texts: list[str], known: dict[str, bytes]) -> list[np.ndarray]:
        """The ids of each text. ``known`` keeps words from call to call."""
        if len(known) > CACHE_WORDS:
            known.clear()
        parts = [list(self._parts(t)) for t in texts]
        new = list(set().union(*(p for text in parts for p in text if not isinstance(p, int))) - known.keys())
        found = dict(zip(new, self.encode_words(new))) if new else {}
        known.update((w, ids) for w, ids in found.items() if len(w) <= CACHE_CHARS)
        look = known.__getitem__
        if any(len(w) > CACHE_CHARS for w in new):
            look = lambda w: found[w] if w in found else known[w]
        return [
            np.frombuffer(b"".join(array("i", [p]).tobytes() if isinstance(p, int) else b"".join(map(look, p)) for p in text), np.int32)
            for text in parts
        ]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: without a decoder of its own, the tokens joined by blanks."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            ids = ids[(ids >= 0) & (ids < self.size)]
        return " ".join(t for t in self.names[ids].tolist() if t is not None)


def _encode_column(column: pa.Array, vocabulary: Vocabulary, known: dict[str, bytes]) -> Iterator[list[np.ndarray]]:
    texts = byte_list(column)
    for start in range(0, len(texts), SLICE_TEXTS):
        yield vocabulary.encode([t.decode("utf-8", "replace") for t in texts[start : start + SLICE_TEXTS]], known)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    cut = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(np.concatenate(ids)))


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def _on_batches(spark: SparkSession, path: str | None, kind: str, run) -> Column:
    """An Arrow function of one column with the vocabulary and a store of known words at hand."""
    shared = spark.sparkContext.broadcast(read_vocabulary(path or public_tokenizers.path(VOCABULARY)))

    def over(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, bytes] = {}
        for column in columns:
            yield run(column, shared.value, known)

    over.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(over, kind)


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with a column ``ids`` (a column of that name is replaced): the token ids of ``text``."""

    def run(column: pa.Array, vocabulary: Vocabulary, known: dict) -> pa.Array:
        parts = [_lists(found) for found in _encode_column(column, vocabulary, known)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(ids, _on_batches(docs.sparkSession, path, "array<int>", run)(docs[text].cast("string")))


def decode(tokens: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """``tokens`` with a column ``text`` (a column of that name is replaced): the text of the token ids; null is no ids."""

    def run(column: pa.Array, vocabulary: Vocabulary, known: dict) -> pa.Array:
        return pa.array([vocabulary.decode(np.array(x or [], np.int64)) for x in column.to_pylist()], pa.string())

    return tokens.withColumn(text, _on_batches(tokens.sparkSession, path, "string", run)(tokens[ids]))


def round_trip(docs: DataFrame, text: str = "text", out: str = "bpe", path: str | None = None) -> DataFrame:
    """``docs`` with a struct ``out`` of ``ids`` and ``decoded``, both from one pass over the texts."""

    def run(column: pa.Array, vocabulary: Vocabulary, known: dict) -> pa.Array:
        ids, back = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.string())]
        for found in _encode_column(column, vocabulary, known):
            ids.append(_lists(found))
            back.append(pa.array([vocabulary.decode(x) for x in found], pa.string()))
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(back)], names=["ids", "decoded"])

    kind = "ids array<int>, decoded string"
    return docs.withColumn(out, _on_batches(docs.sparkSession, path, kind, run)(docs[text].cast("string")))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("bpe.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("bpe.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("bpe.decoded"), 256).alias("decoded_sha256"),
    )
