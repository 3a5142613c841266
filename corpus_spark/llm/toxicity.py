"""Toxicity by a noisy-channel decoder and a classifier on the restored words.

*Restore.* A token that holds digits or symbols among letters, inner punctuation or a
letter three times in a row, and a run of single letters, is read as the noisy form of
some word. Its readings form a lattice: a symbol stands for itself or for the letters
it resembles, punctuation may be noise, a long run may be one or two letters. Viterbi
decoding finds the likeliest reading under a character trigram model counted over all
documents. Every other token has a lattice of one path and stays as it is.

Symbols at the end of a token may be noise or letters, and a token of digits and signs
only may be a number or a word: both readings count, the one without the symbols and
the likeliest one with them. Between the letters of a spaced run there may be a border
or nothing. A model of three letters cannot tell, so the likeliest words are found under
the frequencies of the LEXICON most frequent words of the training rows, words outside
them by the character model; these words and the run in one piece count.

*Learn.* Restored words and word beginnings of 4 to 6 bytes are counted by label on all
labelled documents of the training folds. The features that mark toxic documents (at most
MAX_FEATURES, the strongest first) enter a ridge logistic regression of Spark ML as present
or not, so that a chance word of a few toxic documents earns little.

*Score.* Whole texts, one pass, no shuffle.

Rows: NULL or empty text scores like a text without marked words. Without training rows
of both labels every score is the one label there is, 0 if there is none.
NULL labels and NULL ids are not learnt from. Repeated rows score alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_spark.llm.buffers import BASE, BYTE_CODES, INVERSE, LOWER, PUNCTUATION, flat_bytes, mix, pieces, powers, split_words, strip_punctuation
from corpus_spark.session import materialize

MAX_FEATURES = 20_000
MIN_DOCS = 5
MIN_ODDS = 2.5
RIDGE = 0.1
FOLDS = 5
_STARTS = (4, 5, 6)
SCORED_BYTES = 1 << 20  # text scored at once, or one longer document
LEXICON = 50_000
_LONGEST, _UNKNOWN = 24, 3.0  # letters of a word in a spaced run; cost of a word outside the lexicon

# What a symbol may stand for, besides itself.
_READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "",
}
_NOISE = ".-_*'~^,:;/\\"

# Classes of bytes in the character model: 0 border, 1-26 letters, 27 digits, 28 other, 29-31 beyond ASCII.
CLASSES = 32
_CLASS = np.full(256, 28, np.int32)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
for _c in range(26):
    _CLASS[ord("a") + _c] = _CLASS[ord("A") + _c] = 1 + _c
_CLASS[ord("0") : ord("9") + 1] = 27
_CLASS[0x80:0xC0] = 29
_CLASS[0xC0:0xE0] = 30
_CLASS[0xE0:] = 31

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_EDGE = PUNCTUATION.copy()
_EDGE[[ord(c) for c in "@$!|+(<"]] = False  # may be letters
_SPACED = ~PUNCTUATION  # what a spaced run consists of
_SPACED[[ord(c) for c in "@$!"]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in _READINGS if ord(c) < 128]] = True
_SIGN[[ord(c) for c in _NOISE]] = True


# --- character model -------------------------------------------------------


def _count_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, _ = flat_bytes(batch.column(0))
        total = np.zeros(CLASSES**3, np.int64)
        for at in range(0, len(data), 1 << 20):
            c = _CLASS[data[max(at - 2, 0) : at + (1 << 20)]]
            if len(c) > 2:
                total += np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["cell", "n"])


def character_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log probabilities [a, b, c] of class c after a, b, from all documents; at most 32,768 cells."""
    cells = docs.select(F.col(text_col).cast("string")).mapInArrow(_count_classes, "cell int, n long")
    counts = np.zeros(CLASSES**3)
    for cell, n in cells.groupBy("cell").agg(F.sum("n")).collect():
        counts[cell] = n
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    pairs = counts.sum(0) + 0.5
    pairs /= pairs.sum(1, keepdims=True)
    return np.log((counts + 4 * pairs[None]) / (counts.sum(2, keepdims=True) + 4))


def _options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for every place the readings and what each costs."""
    places, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run = j - i
        one: list[tuple[str, float]]
        if c.isalpha():
            one = [(c, 0.0)]
        else:
            one = [(c, 3.0), *[(r, 0.5) for r in _READINGS.get(c, "")]]
            if c in _NOISE:
                one.append(("", 1.0))
        if run >= 3:
            one = [(r * k, cost + 0.5 + 0.5 * k) for r, cost in one if r for k in (1, 2)] + [(r, v) for r, v in one if not r]
            places.append(one)
        else:
            places.extend([one] * run)
        i = j
    return places


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a lower-case token."""
    best = {(0, 0): (0.0, None)}
    # A path is a chain (reading, path before), so that a step costs the same at any length.
    for options in _options(token):
        after: dict = {}
        for (a, b), (score, path) in best.items():
            for reading, cost in options:
                x, y, s = a, b, score - cost
                for byte in reading.encode():
                    z = int(_CLASS[byte])
                    s += model[x, y, z]
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (reading, path))
        best = after
    _, path = max(((s + model[a, b, 0], p) for (a, b), (s, p) in best.items()), key=lambda e: e[0])
    parts = []
    while path is not None:
        reading, path = path
        parts.append(reading)
    return "".join(reversed(parts))


def spaced_words(text: str, model: np.ndarray, lexicon: dict[str, float]) -> list[str]:
    """The likeliest words of a spaced run whose letters are ``text``; the lexicon has their costs."""
    best, since = [0.0] + [np.inf] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        a, b, cost = 0, 0, best[i] + _UNKNOWN
        for j in range(i + 1, min(i + _LONGEST, len(text)) + 1):
            for byte in text[j - 1].encode():
                z = int(_CLASS[byte])
                cost -= model[a, b, z]
                a, b = b, z
            total = min(cost - model[a, b, 0], best[i] + lexicon.get(text[i:j], np.inf))
            if total < best[j]:
                best[j], since[j] = total, i
    found, j = [], len(text)
    while j:
        found.append(text[since[j] : j])
        j = since[j]
    return found[::-1]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SCORED_BYTES):
        data, offsets = flat_bytes(batch.column("text"))
        words = split_words(data, offsets, lower=True)
        start, end = strip_punctuation(data, words.start, words.end)
        low = bytes(LOWER[data])
        found = Counter(low[a:b] for a, b in zip(start.tolist(), end.tolist()) if 0 < b - a <= _LONGEST)
        words = pa.array([w.decode("utf-8", "replace") for w in found], pa.string())
        yield pa.record_batch([words, pa.array(list(found.values()), pa.int64())], ["word", "n"])


def word_costs(rows: DataFrame) -> dict[str, float]:
    """Negative log frequency of the LEXICON most frequent words of column ``text``."""
    counts = rows.select("text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    total = sum(r["n"] for r in found)
    return {r["word"]: float(np.log(total / r["n"])) for r in found}


# --- words of a batch ------------------------------------------------------


def _counted(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    return total[end] - total[start]


def _restored_words(
    data: np.ndarray, offsets: np.ndarray, model: np.ndarray, lexicon: dict[str, float], cache: dict
) -> tuple[np.ndarray, ...]:
    """(bytes, start, end, document) of all words, the noisy ones in their restored forms."""
    words = split_words(data, offsets, lower=True)
    start, end = words.start.copy(), words.end.copy()
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    edge = PUNCTUATION.copy()
    edge[[ord(c) for c in "@$!|+(<*"]] = False  # may be letters
    _, until = strip_punctuation(data, start, end, edge, _EDGE)
    start, end = strip_punctuation(data, start, end, edge)
    if not len(start):
        return data, start, end, doc
    letters, signs = _counted(_LETTER[data], start, end), _counted(_SIGN[data], start, end)
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    runs = _counted(same, np.minimum(start + 2, end), end)
    noisy = (end > start) & (((letters > 0) & (signs > 0)) | (runs > 0))
    size = until - start
    bare = (_counted(_LETTER[data], start, until) == 0) & (size > 2) & (_counted(_SIGN[data], start, until) == size)
    more = bare | ((until > end) & (letters > 0))
    single = (size == 1) & ~noisy
    single[single] = _SPACED[data[start[single]]]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (single).astype(np.int8), [0]])))
    joined = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= 3]
    drop, texts, owners = noisy.copy(), [], []
    for some, stop in ((noisy, end), (more, until)):
        for w in np.flatnonzero(some).tolist():
            texts.append((bytes(data[start[w] : stop[w]]), False))
            owners.append(doc[w])
    for a, b in joined:
        inner = np.flatnonzero(np.diff(doc[a:b])) + 1
        for lo, hi in zip([a, *(a + inner).tolist()], [*(a + inner).tolist(), b]):
            if hi - lo >= 3:
                drop[lo:hi] = True
                texts.append((bytes(data[start[lo:hi]]), True))
                owners.append(doc[lo])
    found, owner = [], []
    for key, d in zip(texts, owners):
        if key not in cache:
            if len(cache) > 200_000:
                cache.clear()
            text, spaced = key
            whole = restore(text.decode("utf-8", "replace").lower(), model)
            words = {whole, *spaced_words(whole, model, lexicon)} if spaced else {whole}
            cache[key] = [w for word in sorted(words) for w in word.encode().split()]
        found.extend(cache[key])
        owner.extend([d] * len(cache[key]))
    extra = np.frombuffer(b"".join(found), np.uint8)
    size = np.array([len(x) for x in found], np.int64)
    stop = len(data) + np.cumsum(size)
    keep = ~drop & (end > start)
    return (
        np.concatenate([data, extra]),
        np.concatenate([start[keep], stop - size]),
        np.concatenate([end[keep], stop]),
        np.concatenate([doc[keep], np.array(owner, np.int64)]),
    )


def _features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes [word, feature]: the whole word and its beginnings; 0 where the word is shorter."""
    out = np.zeros((len(start), 1 + len(_STARTS)), np.uint64)
    order = np.argsort(start, kind="stable") if len(start) and (np.diff(start) < 0).any() else np.arange(len(start))
    at, table = 0, BYTE_CODES[LOWER]
    while at < len(order):
        lo = int(start[order[at]])
        to = max(at + 1, int(np.searchsorted(start[order], lo + (1 << 20))))
        some = order[at:to]
        hi = int(end[some].max())
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * powers(BASE, hi - lo), out=total[1:])
        s, e = start[some] - lo, end[some] - lo
        back = powers(INVERSE, hi - lo + 1)[s]
        out[some, 0] = mix((total[e] - total[s]) * back) | np.uint64(1)
        for i, size in enumerate(_STARTS):
            fit = e - s >= size
            h = mix((total[np.minimum(s + size, hi - lo)] - total[s]) * back + np.uint64(size))
            out[some, 1 + i] = np.where(fit, h | np.uint64(1), np.uint64(0))
        at = to
    return out


@dataclass
class ToxicityModel:
    """Everything a task needs; at most MAX_FEATURES weights, LEXICON words and 32,768 cells."""

    characters: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    share: float | None = None

    def marks(self, data: np.ndarray, offsets: np.ndarray, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature number) pairs."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        data, start, end, doc = _restored_words(data, offsets, self.characters, self.lexicon, cache)
        found = _features(data, start, end)
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        row, column = np.nonzero(self.keys[at] == found)
        pairs = np.unique(doc[row] * len(self.keys) + at[row, column])
        return pairs // len(self.keys), pairs % len(self.keys)

    def score(self, data: np.ndarray, offsets: np.ndarray, cache: dict) -> np.ndarray:
        n = len(offsets) - 1
        if self.share is not None:
            return np.full(n, self.share)
        doc, feature = self.marks(data, offsets, cache)
        total = self.bias + np.bincount(doc, self.weights[feature], minlength=n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


# --- learning --------------------------------------------------------------


def crc_fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def _count_features(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in pieces(batches, "text", SCORED_BYTES):
            data, start, end, doc = _restored_words(*flat_bytes(batch.column("text")), model.characters, model.lexicon, cache)
            toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), np.int64)
            keys = _features(data, start, end)
            pairs = np.stack([keys.ravel(), np.repeat(doc, keys.shape[1]).astype(np.uint64)], axis=1)
            pairs = pairs[pairs[:, 0] > 0]
            order = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[order]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
            pairs = pairs[new]
            key, at = np.unique(pairs[:, 0], return_inverse=True)
            bad = np.bincount(at, toxic[pairs[:, 1].astype(np.int64)], minlength=len(key)).astype(np.int64)
            every = np.bincount(at, minlength=len(key)).astype(np.int64)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(bad), pa.array(every)], ["key", "bad", "n"])

    return run


def _gather_marks(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in pieces(batches, "text", SCORED_BYTES):
            doc, feature = model.marks(*flat_bytes(batch.column("text")), cache)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
            yield pa.record_batch([lists, batch.column("toxic")], ["marks", "toxic"])

    return run


def _fit(marked: DataFrame, features: int, sizes: dict[int, int]) -> tuple[float, np.ndarray]:
    """Logistic regression with a ridge on rows (marks, toxic); only its weights come to the driver."""
    if not features:
        return float(np.log(sizes[1] / sizes[0])), np.zeros(0)
    names = [str(i) for i in range(features)]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="marks", outputCol="features")
    # The ridge counts for the sum over all rows, Spark's penalty for their mean.
    model = LogisticRegression(
        labelCol="toxic", regParam=RIDGE / sum(sizes.values()), standardization=False, maxIter=200, tol=1e-9, family="binomial"
    ).fit(vectors.transform(marked.withColumn("marks", F.col("marks").cast("array<string>"))))
    return float(model.intercept), model.coefficients.toArray()


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", folds: int = FOLDS,
) -> ToxicityModel:
    """Learn from all labelled documents whose fold is not 0."""
    model = ToxicityModel(character_model(docs, text_col))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.where("id is not null and toxic in (0, 1)").where(crc_fold("id", folds) != 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.where(crc_fold("id", folds) != 0)  # before texts move
    # Labels grow with the documents: a merge join at any size.
    rows = materialize(texts.join(marked.hint("merge"), "id").select("text", "toxic"), "training-rows")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").agg(F.count("*")).collect()}
    if len(sizes) < 2:
        model.share = float(max(sizes, default=0))
        return model
    model.lexicon = word_costs(rows)
    counts = rows.mapInArrow(_count_features(model), "key long, bad long, n long")
    counts = counts.groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[1] + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (sizes[0] + 1))
    strong = counts.where(F.col("bad") >= MIN_DOCS).select("key", (odds * F.log1p("bad")).alias("worth"), odds.alias("odds"))
    chosen = strong.where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("worth"), "key").limit(MAX_FEATURES).collect()
    model.keys = np.sort(np.array([r["key"] for r in chosen], np.int64).view(np.uint64))
    found = materialize(rows.mapInArrow(_gather_marks(model), "marks array<int>, toxic int"), "training-marks")
    model.bias, model.weights = _fit(found, len(model.keys), sizes)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of being toxic; other columns and rows stay."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in pieces(batches, place, SCORED_BYTES):
            score = model.score(*flat_bytes(batch.column(place)), cache)
            yield pa.record_batch([*batch.columns, pa.array(score)], [*batch.schema.names, out])

    schema = docs.select("*", F.lit(0.0).alias(out)).schema
    return docs.mapInArrow(run, schema)
