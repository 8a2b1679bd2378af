"""Personal data and secrets: fixed patterns, and more by a semi-Markov conditional random field.

The fixed patterns find what has an exact form. The field labels segments of
words, not single words: features of a whole candidate segment (its shape, its
digits, whether they pass a checksum, the words beside it) score each kind, and
dynamic programming over entities of at most ``MOST_WORDS`` words chooses
boundaries and kinds together. It is trained on windows around digits, at signs,
words of seeds and values after ``=`` or ``:``, labelled by the fixed patterns
and by seeds for secrets. Its segments are added where they overlap no
pattern's match and are all but certain.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Kinds of the fixed patterns in their order, and the one that the field adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Words of an entity at most, words beside a clue that belong to its window, and the least probability of an added segment.
MOST_WORDS, BESIDE, SURE = 4, 3, 0.95
#: The field is trained on at most so many documents with a match of each kind, found over all rows, and so many
#: with a clue but no match, those whose ids hash lowest, in so many rounds.
SAMPLE, ROUNDS = 400, 6
#: Of each of these, at most so many stretches of at most so many words and characters.
SNIPPETS, SNIPPET_WORDS, SNIPPET = 16, 40, 4000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`()[]{}<>,;:!?#*$%&|."
#: Words before a secret, and what teaches the field secrets.
_SECRET_WORD = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)")
_SEED = re.compile(r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20]*[=:][\x20]*\"?([0-9A-Za-z_+/-]{12,})|\b(AKIA[0-9A-Z]{16})\b")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by start and kind, each found in linear time."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        # letters before an at sign belong to it alone, so that the leftmost match begins with the first of them
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _GROUPS.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - len(parts) % 4, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, at + size))
            at += size + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _sign(s: str) -> int:
    """Where the sign between a key and its value is in a word, or -1: an equals sign, or a colon after a word of seeds."""
    k = s.find("=")
    if k < 0 and (k := s.find(":")) > 0 and not _SECRET_WORD.search(s, 0, k):
        return -1
    return k


def _values(text: str, words: list[tuple[int, int]]) -> list[bool]:
    """Which words hold a value after an equals sign or a colon: in them, or at the end of the word before."""
    out, after = [], False
    for a, b in words:
        w = text[a:b].rstrip("\"'")
        out.append(w not in ("=", ":") and (after or "=" in w[:-1] or ":" in w[:-1]))
        after = w[-1:] in ("=", ":")
    return out


class Window:
    """Some neighbouring words of a text, and the segments of them that may be entities; ``values`` may be such by themselves."""

    def __init__(self, text: str, words: list[tuple[int, int]], before: str, values: list[bool] | None = None) -> None:
        self.text, self.words, self.before = text, words, before
        self.segments: list[tuple[int, int]] = []
        clue = [any(c in "0123456789@" for c in text[a:b]) for a, b in words]
        self.lower = [text[a:b].strip(_EDGE).lower() if text[a:b] != "=" else "=" for a, b in words]
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + MOST_WORDS) + 1):
                if clue[i] and clue[j - 1] or j == i + 1 and (clue[i] or values and values[i]) or any(clue[i:j]) and text[words[i][0]] in "+(":
                    self.segments.append((i, j))
        self.ends: dict[int, list[int]] = defaultdict(list)
        for k, (_, j) in enumerate(self.segments):
            self.ends[j].append(k)

    def features(self, k: int) -> list[str]:
        """What is seen of a segment; made when asked for, since a text may be one long window."""
        i, j = self.segments[k]
        left = [self.lower[i - 1] if i else self.before, self.lower[i - 2] if i > 1 else ""]
        return features(self.text[self.words[i][0] : self.words[j - 1][1]], j - i, left)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Places of the words i to j without marks at the ends; of ``key=value`` the value's."""
        a, b = self.words[i][0], self.words[j - 1][1]
        while a < b and self.text[a] in _EDGE and self.text[a] != "(":
            a += 1
        while b > a and self.text[b - 1] in _EDGE:
            b -= 1
        if j == i + 1 and (k := a + _sign(self.text[a:b])) > a and k + 1 < b:
            a = k + 1 + (self.text[k + 1] in "\"'")
        return a, b


def features(segment: str, words: int, left: list[str]) -> list[str]:
    """What is seen of a whole candidate segment."""
    s = segment.strip(_EDGE.replace("(", "")).rstrip("=")
    k = _sign(s) if words == 1 else -1
    key, value = (s[:k], s[k + 1 :]) if k >= 0 else (s, "") if words == 1 else ("", s)
    s = value.strip(_EDGE) or s
    digits = re.sub(r"[^0-9]", "", s)
    letters = sum(c.isalpha() for c in s)
    out = [f"words={words}", f"size={min(len(s), 48) // 4}", f"digits={min(len(digits), 24) // 3}", f"letters={min(letters, 24) // 4}"]
    out += [f"left={left[0]}", f"left2={left[1]}/{left[0]}"] if words else []
    if key and value:
        out.append(f"key={key.lower()}")
    if " " not in s:
        if _DOMAIN.fullmatch(s.partition("@")[2]) and "@" in s:
            out.append("mail")
        if re.fullmatch(r"[0-9a-f]{12,}|[0-9A-F]{12,}", s) and letters and digits:
            out.append("hex")
        if re.fullmatch(r"[0-9A-Za-z_/+-]{16,}", s) and digits and letters:
            out.append("mixed" + ("U" if s.upper() == s else "l" if s.lower() == s else "m"))
        if re.fullmatch(r"[A-Za-z_/+-]{12,}", s):
            out.append("long")
        if len(p := s.split(".")) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in p):
            out.append("four")
        if s.replace(".", "").isdigit() and len(s) < 12:
            out.append("number")
    if re.fullmatch(r"[0-9 -]+", s):
        out.append(f"plain{12 <= len(digits) <= 19}{luhn(digits) if digits else False}")
    if re.fullmatch(r"[+(][0-9 ().-]+", s):
        out.append(f"dial{s[0]}{9 <= len(digits) <= 15}")
    if segment != segment.rstrip(_EDGE):
        out.append("mark")
    return out


def windows(text: str) -> Iterator[Window]:
    """The stretches of words around those with a digit or an at sign, values and words of seeds.

    Clues whose neighbourhoods meet are in one window, however long it gets, so
    that no segment lies in two windows and none is cut.
    """
    words = [m.span() for m in _WORD.finditer(text)]
    at, n = 0, len(words)
    values = _values(text, words)
    clue = [i for i, (a, b) in enumerate(words) if values[i] or any(c in "0123456789@" for c in text[a:b]) or _SECRET_WORD.search(text, a, b)]
    while at < len(clue):
        first = max(0, clue[at] - BESIDE)
        last = clue[at]
        while at < len(clue) and clue[at] <= last + 2 * BESIDE:
            last = clue[at]
            at += 1
        before = text[slice(*words[first - 1])].strip(_EDGE).lower() if first else ""
        to = min(n, last + BESIDE + 1)
        yield Window(text, words[first:to], before, values[first:to])


class Field:
    """Weights of (kind, feature); a word outside entities scores 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = {}
        self.bias = -2.0

    def scores(self, w: Window, seen: list[list[str]] | None = None) -> list[list[float]]:
        """Each segment's score by kind; ``seen`` are their features where they were made before."""
        get = self.weights.get
        return [[self.bias * (j - i) + sum(get((y, f), 0.0) for f in fs) for y in KINDS] for (i, j), fs in zip(w.segments, seen or map(w.features, range(len(w.segments))), strict=True)]

    def sums(self, w: Window, scores: list[list[float]]) -> tuple[list[float], list[list[float]]]:
        """Log sums of all labellings of the first words, and each segment's and kind's probability."""
        n = len(w.words)
        forward = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = [forward[j - 1], *(forward[w.segments[k][0]] + s for k in w.ends[j] for s in scores[k])]
            top = max(terms)
            forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        backward = [-math.inf] * n + [0.0]
        begins: dict[int, list[int]] = defaultdict(list)
        for k, (i, _) in enumerate(w.segments):
            begins[i].append(k)
        for i in range(n - 1, -1, -1):
            terms = [backward[i + 1], *(backward[w.segments[k][1]] + s for k in begins[i] for s in scores[k])]
            top = max(terms)
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        return forward, [[math.exp(min(0.0, forward[i] + s + backward[j] - forward[n])) for s in row] for (i, j), row in zip(w.segments, scores, strict=True)]

    def best(self, w: Window) -> list[tuple[str, int, int, float]]:
        """The best labelling's entities (kind, first word, end) and their probabilities."""
        if not w.segments:
            return []
        scores = self.scores(w)
        n = len(w.words)
        value: list[tuple[float, int, int]] = [(0.0, -1, -1)]
        for j in range(1, n + 1):
            now = (value[j - 1][0], -1, -1)
            for k in w.ends[j]:
                for y, s in enumerate(scores[k]):
                    if (v := value[w.segments[k][0]][0] + s) > now[0]:
                        now = (v, k, y)
            value.append(now)
        _, sure = self.sums(w, scores)
        out, j = [], n
        while j > 0:
            _, k, y = value[j]
            if k < 0:
                j -= 1
            else:
                out.append((KINDS[y], *w.segments[k], sure[k][y]))
                j = w.segments[k][0]
        return out[::-1]

    def learn(self, data: list[tuple[Window, dict[int, int]]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Gradient steps (Adagrad) on the log-likelihood of labelled windows: segment number -> kind."""
        size: dict[tuple[str, str], float] = defaultdict(lambda: 1e-2)
        made = [[w.features(k) for k in range(len(w.segments))] for w, _ in data]
        for _ in range(rounds):
            for (w, truth), seen in zip(data, made, strict=True):
                _, sure = self.sums(w, self.scores(w, seen))
                step: dict[tuple[str, str], float] = defaultdict(float)
                for k, own in enumerate(seen):
                    for y, kind in enumerate(KINDS):
                        g = (truth.get(k) == y) - sure[k][y]
                        if abs(g) > 1e-4:
                            for f in own:
                                step[kind, f] += g
                for key, g in step.items():
                    g -= decay * self.weights.get(key, 0.0)
                    size[key] += g * g
                    self.weights[key] = self.weights.get(key, 0.0) + rate * g / math.sqrt(size[key])


def covered(spans: list[Span]) -> Callable[[int, int], bool]:
    """Whether a place from a to b overlaps any of the spans, each asked in logarithmic time."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return lambda a, b: (k := bisect_left(starts, b)) > 0 and ends[k - 1] > a


def known_spans(text: str) -> list[Span]:
    """What patterns and seeds make out."""
    known = base_spans(text)
    taken = covered(known)
    seeds = (("secret", *m.span(1 if m.group(1) else 2)) for m in _SEED.finditer(text))
    return known + [s for s in seeds if not taken(*s[1:])]


def labelled(text: str) -> Iterator[tuple[Window, dict[int, int]]]:
    """The text's windows with the segments that patterns and seeds make out, the former first; linear in the text."""
    known = known_spans(text)
    order = sorted(range(len(known)), key=lambda x: known[x][1])
    starts = [known[x][1] for x in order]
    for w in windows(text):
        begins, ends = [a for a, _ in w.words], [b for _, b in w.words]
        number = {s: k for k, s in enumerate(w.segments)}
        truth: dict[int, int] = {}
        taken = [False] * len(w.words)
        for x in sorted(order[bisect_left(starts, begins[0]) : bisect_left(starts, ends[-1])]):
            kind, a, b = known[x]
            i, j = bisect_right(begins, a) - 1, bisect_left(ends, b) + 1
            k = number.get((i, j))
            if k is not None and a < ends[i] and not any(taken[i:j]):
                truth[k] = KINDS.index(kind)
                taken[i:j] = [True] * (j - i)
        if w.segments:
            yield w, truth


def _classes(text: str) -> set[str]:
    return {k for k, _, _ in known_spans(text)} or {"none"}


def snippets(text: str) -> list[str]:
    """At most ``SNIPPETS`` stretches of a text, those with a match first: each a window after the word before it, or ``SNIPPET_WORDS`` words of a longer one."""
    out = []
    for w, truth in labelled(text):
        hit = {w.segments[k][0] for k in truth}
        for i in range(0, len(w.words), SNIPPET_WORDS):
            to = min(len(w.words), i + SNIPPET_WORDS)
            part = text[w.words[i][0] : w.words[to - 1][1]]
            out.append((hit.isdisjoint(range(i, to)), f"{w.before} {part}" if w.before and not i else part))
    return [s for _, s in sorted(out, key=lambda x: x[0])[:SNIPPETS] if len(s) <= SNIPPET]


def samples(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Stretches of texts with a match of each kind, and with a clue but no match, of at most ``sample`` texts each, in the order of their ids' hashes.

    One pass counts each kind over all rows. A second brings a share of each
    that is sure to hold ``sample`` rows, as in ``bounded_sample``. What comes
    to the driver is bounded in texts, stretches and characters.
    """
    key = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 33)
    clues = docs.where(F.col(text).rlike("[0-9@=:]")).select(key.alias("h"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, int] = defaultdict(int)
        for b in batches:
            for x in b["text"]:
                for k in _classes(x.as_py()):
                    n[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["kind", "n"])

    counts = {r["kind"]: r["n"] for r in clues.mapInArrow(count, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # a row a kind
    below = {k: (1 << 31) * min(1.0, (sample + 6 * sample**0.5 + 20) / n) for k, n in counts.items()}
    if not below:
        return []

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b["text"].to_pylist()
            kinds = [sorted(k for k in _classes(x) if h < below[k]) for h, x in zip(b["h"].to_pylist(), texts, strict=True)]
            chosen = pa.array([bool(k) for k in kinds], pa.bool_())
            parts = [snippets(x) for x, k in zip(texts, kinds, strict=True) if k]
            yield pa.RecordBatch.from_arrays([b["h"].filter(chosen), pa.array(parts, pa.list_(pa.string())), pa.array([k for k in kinds if k], pa.list_(pa.string()))], ["h", "parts", "kinds"])

    rows = sorted(clues.where(F.col("h") < max(below.values())).mapInArrow(take, "h long, parts array<string>, kinds array<string>").collect(), key=lambda r: (r["h"], r["parts"]))
    room, out = dict.fromkeys(below, sample), []
    for r in rows:
        if any(room[k] > 0 for k in r["kinds"]):
            out += r["parts"]
        for k in r["kinds"]:
            room[k] -= 1
    return out


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Field:
    """A field trained on stretches of at most ``sample`` documents of each kind. Without any clue in the documents it adds nothing."""
    field = Field()
    field.learn([x for t in samples(docs, doc_id=doc_id, text=text, sample=sample) for x in labelled(t)])
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The patterns' matches, and these with what the field adds."""
    base = base_spans(text)
    out = list(base)
    taken = covered(base)
    for w in windows(text):
        for kind, i, j, sure in field.best(w):
            a, b = w.span(i, j)
            if sure >= SURE and a < b and not taken(a, b):
                out.append((kind, a, b))
    return base, sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_CLUE = np.isin(np.arange(256), list(b"0123456789@=:"))


def _spans(column: pa.Array, field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    for t in slices(column):
        sums = np.r_[0, np.cumsum(_CLUE[t.data])]
        any_clue = sums[t.offsets[1:]] > sums[t.offsets[:-1]]
        for d in range(len(t)):
            yield all_spans(t.text(d).decode(), field) if any_clue[d] else ([], [])


def find(docs: DataFrame, field: Field, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row a row, in one pass without a shuffle.

    Null and empty texts have no spans. Repeated rows get equal results, a null
    id stays null, no rows give no rows. Long texts are searched whole, in time
    and memory in proportion to their length. Of spans that start together the
    kinds' order tells. Other columns are not read.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(_spans(b["text"], field))
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in BASE]
            shas = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b["doc_id"], *counts, shas, pa.array([_joined(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, *, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets; of overlapping spans the union is replaced, by the first one's kind.

    Null texts stay null, texts without spans and all other columns as they
    are; equal texts become equal ones; no rows give no rows.
    """

    def clean(value: str, spans: list[Span]) -> str:
        out, at, last = [], 0, -1
        for k, a, b in spans:
            if a >= last:
                out += [value[at:a], f"[{k.upper()}]"]
            last = max(last, b)
            at = last
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b[text]
            values = [v if v is None or not s else clean(v, s) for v, (_, s) in zip(column.to_pylist(), _spans(column, field), strict=True)]
            yield b.set_column(b.schema.get_field_index(text), b.schema.field(text), pa.array(values, column.type))

    return docs.mapInArrow(run, docs.schema)
