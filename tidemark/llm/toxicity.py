"""Toxicity with noisy-channel deobfuscation.

A token that mixes letters with look-alike characters (of other scripts too), repeats a letter three times or more, or is
spelled out letter by letter is decoded first: each character opens its readings (itself, the letters it stands for, nothing
for a repetition or a separator, a word break for a separator), and Viterbi finds the reading of least cost under the channel
and a character trigram model of the corpus, whatever the token's length; the ``beam`` cheapest states of each
character go on.  The restored text is scored by a sparse logistic model over words and word beginnings; a restored
word's n uses in a document weigh 1 + ln(n), in fitting as in scoring.

The trigram model counts every character of every text (a table of 64 ** 3 cells at most, whatever the corpus).  Only the
logistic model is fitted from a bounded sample (``train_rows`` labelled rows, dealt by a hash of the id); it keeps
features that at least ``min_docs`` toxic documents hold and that favour them.  Scoring reads whole texts in one map; a
worker process keeps what it has decoded from task to task.

Null and empty texts get the model's prior.  Repeated rows get equal scores, one result row each.  Null ids keep a null
id and are not held out; label rows with null or other values are not learned from.  No usable label: every score is 0.5.
Of an id with several texts the least is learned from.  Very long texts and tokens take time linear in their length.  A score
equal to the threshold is predicted 1; readings of equal cost are settled by the order of the lattice.  Columns other than id and text are never read.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches
from .quality_crf import held_out, learning_rows

#: Letters that a character may stand for (fixed values: common look-alikes of digits, signs, Cyrillic and Greek letters).
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "§": "s", "¡": "i",
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
_SEPARATORS = " .-_*,/"
#: Characters without width, which split no word.
_INVISIBLE = dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_letters = re.compile(r"[^\W\d_]+").findall
#: Letters spelled out: four or more single characters, separators between each two.
_spelled = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*,/]+(?:[^\W_]|[@$!|+])(?![^\W_])){3,}")
_tripled = re.compile(r"([^\W\d_])\1\1").search
_latin = re.compile(r"[a-z]").search
_lookalike = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]").search
_SIZE = 64


def _codes() -> np.ndarray:
    """Latin-1 byte -> code: 0 no letter, 1-26 a-z, 27 and up the other lower-case letters."""
    out, nxt = np.zeros(256, np.int64), 1
    for k in range(256):
        c = bytes([k]).decode("latin-1")
        if c.isalpha() and c == c.lower():
            out[k], nxt = nxt, nxt + 1
    return out


CODES = _codes()


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of (two characters before, character) over all texts, flattened; a word begins after (0, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for b in slices(batches, 0):
            # two spaces between texts: no word reaches into the next, and a slice is counted at once
            text = "   ".join(t for t in b.column(0).to_pylist() if t)
            c = CODES[np.frombuffer(f"  {text.lower()} ".encode("latin-1", "replace"), np.uint8)]
            before = np.where(c[1:-1] == 0, 0, c[:-2])
            cell = (before * _SIZE + c[1:-1]) * _SIZE + c[2:]
            total += np.bincount(cell[(c[1:-1] > 0) | (c[2:] > 0)], minlength=_SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    found = docs.select(text_col).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SIZE**3)
    for r in found:
        out[r[0]] = r[1]
    return out


class Decoder:
    """Readings of noisy tokens under a trigram model."""

    def __init__(self, counts: np.ndarray, beam: int | None = 16):
        table = counts.reshape(_SIZE, _SIZE, _SIZE) + 0.01
        self.cost = (-np.log(table / table.sum(2, keepdims=True))).tolist()
        self.beam = beam

    def code(self, letter: str) -> int:
        return int(CODES[letter.encode("latin-1", "replace")[0]])

    def readings(self, text: str, i: int) -> list[tuple[str, float]]:
        c = text[i]
        if c in _SEPARATORS:
            return [("", 0.1), (" ", 2.5)]
        stands_for = LOOKALIKES.get(c, "")
        out = [(c, 3.0 if stands_for else 0.1)] if c.isalpha() else []
        out += [(x, 1.0) for x in stands_for] or ([("", 4.0)] if not c.isalpha() else [])
        if i and text[i - 1] == c:  # a doubled letter may be meant, a run of three hardly
            out.append(("", 0.2 if c * 3 in text[max(0, i - 2) : i + 2] else 2.5))
        return out

    def best(self, text: str) -> tuple[float, str]:
        """Cost and text of the most likely reading."""
        cost = self.cost
        states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, None)}
        for i in range(len(text)):
            nxt: dict[tuple[int, int], tuple] = {}
            steps = [(letter, channel, self.code(letter) if letter.strip() else 0) for letter, channel in self.readings(text, i)]
            for (a, b), (spent, back) in states.items():
                row = cost[a][b]
                for letter, channel, k in steps:
                    if not letter:
                        state, total, made = (a, b), spent + channel, back
                    else:
                        state, total, made = (b, k) if k else (0, 0), spent + channel + row[k], (back, letter)
                    if state not in nxt or total < nxt[state][0]:
                        nxt[state] = (total, made)
            if self.beam and len(nxt) > self.beam:
                nxt = dict(sorted(nxt.items(), key=lambda x: (x[1][0], x[0]))[: self.beam])
            states = nxt
        total, back = min(((spent + cost[a][b][0], back) for (a, b), (spent, back) in states.items()), key=lambda x: x[0])
        made = []
        while back:
            back, letter = back
            made.append(letter)
        return total, "".join(reversed(made))

    def decode(self, text: str) -> str:
        return self.best(text)[1]

    def words(self, token: str) -> list[str]:
        """The words of one token without white space, restored."""
        if not token.isascii():
            token = unicodedata.normalize("NFKC", token.translate(_INVISIBLE)).lower()
        core = token.rstrip(".,;:?!\"'()[]{}<>#*%&$|~^=/").lstrip(".,;:?\"'()[]{}<>#*%&~^=/")
        plain = core.isalpha()
        noisy = not (plain and core.isascii()) and _lookalike(core) and _latin(core)
        if plain and not noisy:
            return self.decode(core).split() if _tripled(core) else [core]
        if noisy:
            return _letters(self.decode(core))
        return [w for x in _letters(core) for w in (self.decode(x).split() if _tripled(x) else [x])]


def features(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 6 letters."""
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


def weight(n: int) -> float:
    """What n uses of a word weigh."""
    return 1.0 + math.log(n)


def restored(text: str | None, words, decode) -> Counter:
    """Words of the restored text with their counts, as ``words`` (of a token) and ``decode`` (of letters spelled out) give them."""
    found: Counter = Counter()
    text = (text or "").lower()
    for token, n in Counter(text.split()).items():
        for w in words(token):
            found[w] += n
    for m in _spelled.finditer(text):
        found.update(decode(m[0]))
    return found


class Scorer:
    """A text's sum of weights; each token is worked out once and remembered, in two generations of up to ``limit`` tokens."""

    def __init__(self, decoder: Decoder, weights: dict[str, float], limit: int = 200_000):
        self.decoder, self.weights, self.limit = decoder, weights, limit
        self.young: dict[str, tuple[str, ...]] = {}
        self.old: dict[str, tuple[str, ...]] = {}
        self.whole = {f[1:] for f in weights if f[0] == "="}
        self.starts = {f[:4] for f in weights if f[0] != "="}

    def value(self, word: str) -> float:
        if word not in self.whole and word[:4] not in self.starts:
            return 0.0
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def words(self, token: str) -> tuple[str, ...]:
        """The token's restored words that weigh something."""
        found = self.young.get(token)
        if found is None:
            found = self.old.get(token)
            if found is None:
                found = tuple(w for w in self.decoder.words(token) if self.value(w))
            if len(token) <= 64:
                if len(self.young) >= self.limit:
                    self.young, self.old = {}, self.young
                self.young[token] = found
        return found

    def total(self, text: str | None) -> float:
        """The sum over restored words that weigh something: as :func:`restored` counts them, the others left out."""
        if not text:
            return 0.0
        text, counts = text.lower(), Counter()
        tokens = text.split()
        heavy = {t for t in set(tokens) if self.words(t)}
        if heavy:
            for t, n in Counter(t for t in tokens if t in heavy).items():
                for w in self.words(t):
                    counts[w] += n
        for m in _spelled.finditer(text):
            counts.update(w for w in self.decoder.decode(m[0]).split() if self.value(w))
        return sum(weight(n) * self.value(w) for w, n in sorted(counts.items()))


#: The scorer that a worker process holds: its model's name, and the scorer.
_held: tuple[str, Scorer, float] | None = None


def worker_scorer(name: str, sent) -> tuple[Scorer, float]:
    """This process's scorer of the model and its bias, made by its first task and found again by the others."""
    global _held
    if _held is None or _held[0] != name:
        _held = None
        m = sent.value
        _held = (name, Scorer(Decoder(m["counts"]), m["weights"]), m["bias"])
    return _held[1], _held[2]


def _fit(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, steps: int = 600, l1: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal gradient with momentum, an L1 penalty on the weights."""
    at = np.concatenate([a for a, _ in x]) if x else np.empty(0, int)
    value = np.concatenate([v for _, v in x]).astype(float)
    row = np.repeat(np.arange(len(x)), [len(a) for a, _ in x])
    scale = np.maximum(np.bincount(at, value**2, width) / len(y), 1e-4) ** 0.25  # rare features may weigh more, within reason
    value = value / scale[at]
    w, z, bias, zb, t = np.zeros(width), np.zeros(width), 0.0, 0.0, 1.0
    step = 4.0 / max(1.0, np.bincount(row, value**2, len(y)).mean())
    for _ in range(steps):
        r = y - 1 / (1 + np.exp(-np.clip(np.bincount(row, z[at] * value, len(y)) + zb, -30, 30)))
        new = z + step * np.bincount(at, r[row] * value, width) / len(y)
        new = np.sign(new) * np.maximum(abs(new) - step * l1, 0)
        new_bias = zb + min(step, 2.0) * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    return w / scale, bias


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 8000, min_docs: int = 3
) -> dict:
    """The trigram counts of all texts, and the weights fitted on the sample."""
    counts = trigrams(docs, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(counts)
    rows = cut(learning_rows(docs, labels, label_col, id_col, text_col, train_rows), "learning")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, by = Decoder(sent.value), (Counter(), Counter())
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by[y].update({f for w in restored(t.as_py(), decoder.words, lambda x: decoder.decode(x).split()) for f in features(w)})
        names = list(by[0].keys() | by[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in by)], names=["f", "n0", "n1"])

    sizes = dict(rows.groupBy("label").count().collect())
    if len(sizes) < 2:
        return {"counts": counts, "weights": {}, "bias": 0.0}
    found = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lift = F.col("n1") * sizes[0] > 2 * F.col("n0") * sizes[1]
    names = sorted(r[0] for r in found.where((F.col("n1") >= min_docs) & lift).select("f").collect())
    place = {f: k for k, f in enumerate(names)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for b in batches:
            at, value = [], []
            for t in b.column(1):
                have: dict[int, float] = {}
                for w, n in sorted(restored(t.as_py(), decoder.words, lambda x: decoder.decode(x).split()).items()):
                    for f in features(w):
                        if f in place:
                            have[place[f]] = have.get(place[f], 0.0) + weight(n)
                at.append(sorted(have))
                value.append([have[k] for k in at[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))], names=["label", "at", "n"])

    data = sorted(map(tuple, rows.mapInArrow(vectors, "label int, at array<long>, n array<double>").collect()))
    w, bias = _fit([(np.array(a, int), np.array(n, float)) for _, a, n in data], np.array([r[0] for r in data], float), len(names))
    return {"counts": counts, "weights": {f: float(w[k]) for f, k in place.items() if w[k]}, "bias": float(bias)}


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted: one row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, bias = worker_scorer(name, sent)
        for b in slices(batches, 1):
            total = np.array([scorer.total(t.as_py()) for t in b.column(1)]) + bias
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())], names=["id", "score"])

    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
