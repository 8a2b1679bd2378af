"""Toxic documents by a support vector machine on a subsequence string kernel.

Two words are alike as far as they share subsequences of ``ORDER`` letters,
each weighted by ``DECAY`` to the length it spans in either word (normalised
to a cosine). Gaps and inserted characters only lower the weight, evenly
where they are even: ``i.d.i.o.t`` is as good as ``idiot``. Landmarks are the
words that best tell toxic from clean training documents. A sentence is
described by its greatest likeness to each landmark, mapped by the Nystroem method; a
linear support vector machine is trained on sentences, those of toxic
documents being relabelled by it until they stay the same, and a document's
score is that of its two worst sentences, calibrated.

Executors look through the training texts: what comes to the driver are counts
of words, and a bounded number of sentences' likenesses of each text. The
settings are those that did best in cross-validation among training rows, see
``cross_validated``; rows that are held out had no part in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Texts, bounded_sample, cut, lists, signed, slices
from .ngram_join import shingles

#: Letters of a subsequence, and the weight of each place that it spans.
ORDER, DECAY = 3, 0.6
#: Bytes of a word that are compared at once; longer words are compared in windows of that size, each half over the one before.
WIDTH = 32
#: The classifier is fitted on at most so many labelled documents of each label, those whose ids hash lowest, and of each on so many sentences, those most like a landmark.
SAMPLE, SENTENCES = {1: 1000, 0: 2000}, 64
#: What a word begins and ends with, as letters of its own.
START, END = b"\x01", b"\x02"
#: Bytes of text that are scored together: each comparison with a landmark is many short array operations, which pay for many words at once.
SCORED_BYTES = 4_000_000
#: A score from here on means toxic.
TOXIC_FROM = 0.3

@dataclass(frozen=True)
class Settings:
    """Most landmarks and the least log-likelihood ratio of each; cosines below ``least`` count as none, likeness is the others' ``power``; cost of a misplaced sentence."""

    landmarks: int = 48
    clear: float = 12.0
    least: float = 0.65
    power: float = 2.0
    cost: float = 1000.0

    def shaped(self, cosine: np.ndarray) -> np.ndarray:
        return np.where(cosine >= self.least, cosine, 0) ** self.power


_CODE = np.where((np.arange(256) >= 128) | np.isin(np.arange(256), list(START + END) + list(range(97, 123))), np.arange(256), 0).astype(np.uint8)
_CODE = _CODE[LOWER]
_BIT = np.where(_CODE > 0, np.uint32(1) << (_CODE & 31).astype(np.uint32), 0).astype(np.uint32)
_STOP = np.isin(np.arange(256), list(b".!?\n"))


def kernel(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each row of codes with the same row of ``others``, or with all of its only row. Code 0 is a gap."""
    n, width = len(words), others.shape[1]
    prime = np.zeros((ORDER, width + 1, n))
    prime[0] = 1
    total = np.zeros(n)
    square = DECAY * DECAY
    for p in range(words.shape[1]):
        x = words[:, p]
        if not x.any():
            prime[1:] *= DECAY
            continue
        same = [np.where((others[:, j] == x) & (x > 0), square, 0.0) for j in range(width)]
        for j in range(width):
            total += same[j] * prime[ORDER - 1, j]
        for i in range(ORDER - 1, 0, -1):
            run = np.zeros(n)
            for j in range(width):
                run = DECAY * run + same[j] * prime[i - 1, j]
                prime[i, j + 1] = DECAY * prime[i, j + 1] + run
    return total


def likeness(words: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Cosine of rows of codes to each landmark's row; those that are not in sight of a landmark (see ``in_sight``) count as 0."""
    out = np.zeros((len(words), len(landmarks)))
    near = in_sight(words, landmarks)
    length = words.shape[1] - (words[:, ::-1] > 0).argmax(1)
    step = 4  # words are compared with others of about their length, so that little is computed for nothing
    for size in range(step, words.shape[1] + step, step):
        rows = np.flatnonzero(near.any(1) & (length > size - step) & (length <= size))
        if not len(rows):
            continue
        part = np.ascontiguousarray(words[rows, :size])
        own = kernel(part, part)
        for k, l in enumerate(landmarks):
            l = l[None, : np.flatnonzero(l).max(initial=0) + 1]
            hit = np.flatnonzero(near[rows, k] & (own > 0))
            if len(hit):
                out[rows[hit], k] = kernel(part[hit], l) / np.sqrt(own[hit] * kernel(l, l))
    return out


def in_sight(words: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """For each row and landmark, whether three fifths of the landmark's neighbouring letters come in its order in the row.

    A rule of thumb that saves nearly all kernels; tests hold what it loses, of words spoilt in all ways, under one in a hundred.
    """
    rows, width = np.arange(len(words)), words.shape[1]
    first, last = np.full((256, len(words)), width, np.uint8), np.zeros((256, len(words)), np.uint8)
    for p in range(width):
        first[words[:, width - 1 - p], rows] = width - 1 - p
        last[words[:, p], rows] = p + 1
    out = np.zeros((len(words), len(landmarks)), bool)
    for k, l in enumerate(landmarks):
        letters = l[l > 0].tolist()
        pairs = np.zeros(len(words), np.uint8)
        for a, b in zip(letters[:-1], letters[1:], strict=True):
            pairs += first[a] + 1 < last[b]
        out[:, k] = pairs >= max(1, -(-3 * (len(letters) - 1) // 5))
    return out


def has_letters(bits: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """For each landmark and word, whether the word, given by the bits of its letters, has two thirds of the landmark's letters."""
    own = [sum({1 << (c & 31) for c in l[l > END[0]].tolist()}) for l in landmarks]
    return np.array([np.bitwise_count(bits & np.uint32(x)) >= -(-2 * x.bit_count() // 3) for x in own]).reshape(len(landmarks), len(bits))


def codes(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), WIDTH), np.uint8)
    for row, w in zip(out, words, strict=True):
        c = _CODE[np.frombuffer(w[:WIDTH], np.uint8)]
        row[: len(c)] = c
    return out


@dataclass
class Model:
    """Settings, landmarks' codes, what maps likeness to a margin, and the calibration of a document's two greatest margins."""

    settings: Settings
    landmarks: np.ndarray
    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def score(self, texts: int, doc: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Scores of so many texts, of which sentences have these cosines."""
        margin = self.settings.shaped(cosine) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(_worst(texts, doc, margin, self.bias) @ self.slopes + self.shift, -30, 30)))


def _worst(texts: int, doc: np.ndarray, margin: np.ndarray, none: float) -> np.ndarray:
    """The greatest and second greatest margin of each text's sentences, of which two have no likeness to any landmark."""
    out = np.full((texts, 2), none)
    order = np.lexsort((-margin, doc))
    doc, margin = doc[order], margin[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    for k in (0, 1):
        out[doc[rank == k], k] = np.maximum(margin[rank == k], none)
    return out


def _spelled(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, with three or more single bytes in a row, as in ``i d i o t``, as one more word."""
    one = ends - starts == 1
    text_start = np.zeros(len(starts) + 1, bool)
    text_start[at] = True
    edge = np.flatnonzero(one[1:] != one[:-1]) + 1 if len(one) else np.zeros(0, int)
    edge = np.unique(np.r_[0, edge, np.flatnonzero(text_start[:-1]), len(one)])
    runs = [(a, b) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a >= 3 and one[a]]
    return np.array([starts[a] for a, _ in runs], np.int64), np.array([ends[b - 1] for _, b in runs], np.int64)


def sentence_features(t: Texts, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, greatest cosine to each landmark) of each sentence with any in sight of one."""
    more = _spelled(t.starts, t.ends, t.at)
    starts, ends = np.r_[t.starts, more[0]], np.r_[t.ends, more[1]]
    if not len(starts) or not len(landmarks):
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks)))
    long = np.flatnonzero(ends - starts > WIDTH)
    if len(long):
        step = WIDTH // 2
        windows = -(-(ends[long] - starts[long] - WIDTH) // step)
        extra = np.repeat(starts[long], windows) + step * (np.arange(windows.sum()) - np.repeat(np.r_[0, np.cumsum(windows)[:-1]], windows) + 1)
        starts, ends = np.r_[starts, extra], np.r_[ends, np.minimum(extra + WIDTH, np.repeat(ends[long], windows))]
    bits = _BIT[t.data]
    has = np.bitwise_or.reduceat(bits, t.starts) if len(t.starts) else np.zeros(0, np.uint32)
    has = np.r_[has, np.full(len(starts) - len(has), 0xFFFFFFFF, np.uint32)]  # runs and windows are few: all are compared
    rows = np.flatnonzero(has_letters(has, landmarks).any(0))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks)))
    place = starts[rows, None] + np.arange(WIDTH)
    matrix = np.zeros((len(rows), WIDTH + 2), np.uint8)
    matrix[:, 0] = START[0]
    matrix[:, 1:-1] = np.where(place < ends[rows, None], _CODE[t.data[np.minimum(place, len(t.data) - 1)]], 0)
    matrix[np.arange(len(rows)), 1 + WIDTH - (matrix[:, -2:0:-1] > 0).argmax(1)] = END[0]  # after the last letter
    _, pick, which = np.unique(np.ascontiguousarray(matrix).view(f"V{WIDTH + 2}").ravel(), return_index=True, return_inverse=True)
    like = likeness(matrix[pick], landmarks)[which]
    hit = like.any(1)
    rows, like = rows[hit], like[hit]
    text = np.searchsorted(t.offsets, starts[rows], "right") - 1
    sentence = np.cumsum(_STOP[t.data])[starts[rows]]
    order = np.lexsort((sentence, text))
    text, sentence, like = text[order], sentence[order], like[order]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])]) if len(text) else np.zeros(0, np.int64)
    return text[new], np.maximum.reduceat(like, new) if len(new) else like


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine with squared hinge loss, by Newton's method."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    keep = np.eye(len(w))
    keep[-1, -1] = 1e-3
    for _ in range(30):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * (2 * c * weight[inside])[:, None]
        step = np.linalg.solve(keep + a.T @ x1[inside], keep @ w + a.T @ (x1[inside] @ w - y[inside]))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _letters(w: bytes) -> bytes:
    """w without what is no letter at its ends."""
    c = np.flatnonzero(_CODE[np.frombuffer(w, np.uint8)])
    return w[c[0] : c[-1] + 1] if len(c) else b""


def _map(texts: DataFrame, schema: str, make: Callable[[Texts, pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in slices(b["text"]):
                yield pa.RecordBatch.from_arrays(make(t, b.slice(t.first, len(t))), names)

    return texts.mapInArrow(run, schema)


def apart(texts: DataFrame) -> DataFrame:
    """The rows (doc_id, toxic, text) of which at least half is not in rows with smaller ids, by stretches of five words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def stretches(t: Texts, b: pa.RecordBatch) -> list[pa.Array]:
        h, at = shingles(t, 5)
        return [b["doc_id"].take(pa.array(np.repeat(np.arange(len(t)), np.diff(at)))), pa.array(signed(h))]

    own = cut(_map(texts, f"doc_id {kind}, h long", stretches))
    first = own.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    seen = own.join(first, "h").where("doc_id <> first").groupBy("doc_id").agg(F.count("*").alias("seen"))
    late = own.groupBy("doc_id").agg(F.count("*").alias("n")).join(seen, "doc_id").where("2 * seen > n").select("doc_id")
    return texts.join(F.broadcast(late), "doc_id", "left_anti")  # at most as many as are sampled


def _grams(t: Texts, b: pa.RecordBatch) -> list[pa.Array]:
    """Words of each text and their beginnings, each once."""
    of, out = [], []
    for d in range(len(t)):
        words = {START + _letters(w) for w in t.text(d).lower().split()}
        own = {w[:n] for w in words for n in range(ORDER + 2, min(len(w), WIDTH) + 1)} | {w + END for w in words if ORDER < len(w) < WIDTH}
        of += [d] * len(own)
        out += own
    return [pa.array(out, pa.binary()), b["toxic"].take(pa.array(of, pa.int64()))]


def choose_landmarks(texts: DataFrame, settings: Settings) -> list[bytes]:
    """The words and beginnings of words that most clearly mark toxic rows, by log-likelihood ratio; none that begins with another."""
    n = {bool(r["toxic"]): r["count"] for r in texts.groupBy("toxic").count().collect()}
    n1, n0 = max(1, n.get(True, 0)), max(1, n.get(False, 0))
    counts = _map(texts, "w binary, toxic boolean", _grams).groupBy("w").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("c"))
    often = counts.where((F.col("a") >= max(3, 0.01 * n1)) & (F.col("a") * n0 >= F.col("c") * 4 * n1)).collect()  # in one toxic row of a hundred at least

    def weight(a: int, c: int) -> float:
        share = (a + c) / (n1 + n0)
        parts = ((a, n1 * share), (n1 - a, n1 * (1 - share)), (c, n0 * share), (n0 - c, n0 * (1 - share)))
        return 2 * sum(k * np.log(k / e) for k, e in parts if k)

    weights = {bytes(r["w"]): weight(r["a"], r["c"]) for r in often}
    chosen: list[bytes] = []
    for w in sorted(weights, key=lambda w: (-round(weights[w], 6), -len(w), w)):
        if weights[w] < settings.clear or len(chosen) == settings.landmarks:
            break
        if not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    return chosen


@dataclass
class Examples:
    """Documents, and their sentences' cosines: which document each is of."""

    ids: list
    toxic: np.ndarray
    doc: np.ndarray
    cosine: np.ndarray


def examples(texts: DataFrame, landmarks: np.ndarray) -> Examples:
    """At most ``SENTENCES`` sentences of each row, those with the greatest cosine to a landmark; found on executors."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def sentences(t: Texts, b: pa.RecordBatch) -> list[pa.Array]:
        of, cosine = sentence_features(t, landmarks)
        order = np.lexsort((-cosine.max(1, initial=0), of))
        of, cosine = of[order], cosine[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < SENTENCES
        of, cosine = of[keep], cosine[keep]
        n = np.bincount(of, minlength=len(t))
        return [b["doc_id"], b["toxic"], lists(cosine.ravel(), n * len(landmarks), pa.float64())]

    rows = sorted(_map(texts, f"doc_id {kind}, toxic boolean, cosine array<double>", sentences).collect(), key=lambda r: r["doc_id"])
    each = [np.array(r["cosine"], float).reshape(-1, len(landmarks)) for r in rows]
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in each])
    return Examples([r["doc_id"] for r in rows], np.array([r["toxic"] for r in rows], bool), doc, np.concatenate([*each, np.zeros((0, len(landmarks)))]))


def train(data: Examples, landmarks: np.ndarray, settings: Settings) -> Model:
    gram = settings.shaped(cosines_of(landmarks))
    values, vectors = np.linalg.eigh(gram)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    like = settings.shaped(data.cosine)
    some = like.any(1)
    doc, like = data.doc[some], like[some]
    x = np.r_[like @ root, np.zeros((1, len(landmarks)))]  # the last stands for all sentences without any likeness
    positive = data.toxic[doc]
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(8):
        y = np.r_[np.where(positive, 1.0, -1.0), -1.0]
        weight = np.r_[np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum())), 1.0] * settings.cost
        w, b = _svm(x, y, weight)
        margin = x @ w + b
        before, positive = positive, data.toxic[doc] & (margin[:-1] > 0)
        if (before == positive).all():
            break
    slopes, shift = _calibrated(_worst(len(data.toxic), doc, (x @ w + b)[:-1], b), data.toxic)
    return Model(settings, landmarks, root @ w, b, slopes, shift)


def cosines_of(landmarks: np.ndarray) -> np.ndarray:
    own = np.sqrt(kernel(landmarks, landmarks))
    return np.stack([kernel(landmarks, l[None]) for l in landmarks], 1) / np.outer(own, own)


def _calibrated(margins: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Platt's slopes and shift, by Newton's method, with his smoothed targets."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins, np.ones(len(margins))]
    w = np.r_[np.ones(margins.shape[1]), 0.0]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (p - target) + 1e-2 * w)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return np.maximum(w[:-1], 0.0), float(w[-1])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(doc_id, toxic, text) of the labelled rows that are not held out, at most ``SAMPLE`` of each label, without near copies. Rows with nulls are left out."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(toxic).alias("label"))
    picked = [bounded_sample(known.where(F.col("label") == y), F.col("doc_id"), n) for y, n in SAMPLE.items()]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most the sum of SAMPLE rows
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id").groupBy("doc_id", (F.col("label") == 1).alias("toxic")).agg(F.min("text").alias("text"))
    return cut(apart(cut(rows.repartition(docs.sparkSession.sparkContext.defaultParallelism))))


def fitted(texts: DataFrame, settings: Settings) -> Model | None:
    """A model of rows (doc_id, toxic, text), or None if no word tells toxic from clean."""
    chosen = choose_landmarks(texts, settings)
    landmarks = codes(chosen)
    data = examples(texts, landmarks) if chosen else None
    return train(data, landmarks, settings) if data is not None and len(set(data.toxic.tolist())) == 2 else None


def fit(docs: DataFrame, labels: DataFrame, *, settings: Settings | None = None, **names: str) -> Model | None:
    """A model of the labelled rows that are not held out, see ``training_rows``; None if they have one label only."""
    return fitted(training_rows(docs, labels, **names), settings or Settings())


def cross_validated(texts: DataFrame, choices: list[Settings], folds: int = 4) -> list[tuple[Settings, float, int, int]]:
    """(settings, log loss, toxic rows found, clean rows marked) of each choice, in order of loss, over folds of the training rows.

    A fold's landmarks, weights and calibration come from the other folds alone.
    """
    fold = F.pmod(F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")), F.lit(folds))
    total = {s: [0.0, 0, 0, 0] for s in choices}
    for k in range(folds):
        inside, outside = texts.where(fold != k), texts.where(fold == k)
        made: dict[tuple, tuple[Examples, Examples, np.ndarray] | None] = {}
        for s in choices:
            if (key := (s.landmarks, s.clear)) not in made:
                landmarks = codes(choose_landmarks(inside, s))
                made[key] = (examples(inside, landmarks), examples(outside, landmarks), landmarks) if len(landmarks) else None
            if made[key] is None:
                continue
            learn, asked, landmarks = made[key]
            p = train(learn, landmarks, s).score(len(asked.toxic), asked.doc, asked.cosine)
            loss = -np.log(np.maximum(np.where(asked.toxic, p, 1 - p), 1e-12)).sum()
            marked = p >= TOXIC_FROM
            for i, x in enumerate((loss, int((marked & asked.toxic).sum()), int((marked & ~asked.toxic).sum()), len(p))):
                total[s][i] += x
    return sorted(((s, x[0] / max(1, x[3]), x[1], x[2]) for s, x in total.items()), key=lambda r: r[1])


def score(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), in one pass without a shuffle.

    Null and empty texts, and all texts where nothing could be learnt, get the
    score of a text without toxic words; long texts are scored whole. Repeated
    rows and ties get equal scores; a row without an id is not held out; no rows
    give no rows; other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            if model is not None:
                for t in slices(b["text"], SCORED_BYTES):
                    out[t.first : t.first + len(t)] = model.score(len(t), *sentence_features(t, model.landmarks))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(out), pa.array((out >= TOXIC_FROM).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
