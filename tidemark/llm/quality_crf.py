"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score reads its own features and those of the lines before and after; transitions
tie neighbours together.  Forward-backward gives each line's probability of being good; their mean, weighted by the
lines' lengths, goes through a one-variable logistic map to the document's quality between 0 and 1.

Only document labels exist, so a line first has its document's label; once a first model is fitted, lines of bad
documents that it calls good are relabelled good (the document's worst line excepted) and the model is fitted again.
It is fitted on the driver from a bounded sample of labelled rows: in order of a hash of the id, at most
``train_rows`` rows, and of these each whole document for which ``train_lines`` lines in all leave room.  Scoring reads whole texts, one
map over the rows, and holds a few numbers for each line of a bounded block of texts.

Null and empty texts are one empty line.  Very long texts are one chain, in time linear in their lines.  Repeated rows get
equal scores, one result row each; an id labelled several times counts once, if its labels agree, and of its texts the least is
learned from.  A score equal to the threshold is predicted 1.  Null ids keep a null id and are not held out; label
rows with null or other values are not learned from.  No usable label: every score is 0.5.
Columns other than id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

_SYMBOLS, _DIGITS, _UPPER = b"#*$%&|<>@^~=_+{}[]\\", b"0123456789", bytes(range(65, 91))
_ENDS = (b".", b"!", b"?", b'"', b":", b";")
WIDTH = 13


def line_features(lines: list[bytes], seen: set[bytes] | None = None) -> np.ndarray:
    """WIDTH features of each line of one document, neighbours not included; ``seen``: lines before these, added to."""
    out, seen = [], set() if seen is None else seen
    for line in lines:
        words = line.split()
        n, size = len(words) or 1, len(line) or 1
        symbols = len(line) - len(line.translate(None, _SYMBOLS))
        upper = len(line) - len(line.translate(None, _UPPER))
        again = sum(map(bytes.__eq__, words, words[1:])) / n
        rare = 1 - len(set(words)) / n
        bare = line.strip()
        out.append((
            1.0, min(n, 60) / 60, n < 4, min(1.0, 8 * symbols / size), (8 * symbols > size) + 0.0, (len(line) - len(line.translate(None, _DIGITS))) / size,
            upper / size, upper * 2 > size, again, rare if n > 7 else 0.0, (rare > 0.5) + 0.0, min(1.0, line.count(b"!") / n),
            (bare in seen) + 0.0 if bare else 0.0,
        ))
        seen.add(bare)
    return np.array(out, np.float64)


def with_neighbours(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each line's features, then the previous line's and the next one's (zeros beyond a document's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after])


def marginals(score: np.ndarray, start: np.ndarray, count: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transition counts (2 x 2, from x to), and each chain's log normaliser.

    ``score``: a line's log-odds of good; ``start``/``count``: the lines of each chain; ``trans``: transition scores.
    All chains advance together, a line at a time, longest first.
    """
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    emit = np.stack([np.zeros_like(score), score], 1)
    alpha, beta = emit.copy(), np.zeros_like(emit)
    longest = int(count[0]) if len(count) else 0
    alive = np.searchsorted(-count, -np.arange(longest), side="left")  # chains with more than t lines
    for t in range(1, longest):
        at = start[: alive[t]] + t
        prev = alpha[at - 1]
        alpha[at] += np.logaddexp(prev[:, :1] + trans[0], prev[:, 1:] + trans[1])
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(nxt[:, :1] + trans[:, 0], nxt[:, 1:] + trans[:, 1])
    final = alpha[start + count - 1]
    norm_of_chain = np.logaddexp(final[:, 0], final[:, 1])
    norm = np.empty(len(score))
    norm[np.concatenate([np.arange(s, s + c) for s, c in zip(start, count, strict=True)])] = np.repeat(norm_of_chain, count)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - norm, 0))
    inner = np.ones(len(score), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] + trans[None] + (emit[at] + beta[at])[:, None, :] - norm[at][:, None, None]
    back = np.empty_like(norm_of_chain)
    back[order] = norm_of_chain
    return good, np.exp(np.minimum(pair, 0)).sum(0), back


def _adam(grad, theta: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        g = grad(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def fit(docs: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 150) -> dict:
    """A model from (label, features, line lengths) of documents."""
    if not docs or len({d[0] for d in docs}) < 2:
        return {}
    count = np.array([len(d[1]) for d in docs])
    start = np.cumsum(count) - count
    x = with_neighbours(np.vstack([d[1] for d in docs]), start, start + count - 1)
    label, owner = np.array([d[0] for d in docs]), np.repeat(np.arange(len(docs)), count)
    y = label[owner].astype(float)
    length = np.concatenate([d[2] for d in docs])
    inner = np.ones(len(y), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    k = x.shape[1]

    def ascend(theta: np.ndarray) -> np.ndarray:
        observed = np.zeros((2, 2))
        np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1)

        def grad(t: np.ndarray) -> np.ndarray:
            good, pairs, _ = marginals(x @ t[:k], start, count, t[k:].reshape(2, 2))
            g = np.concatenate([x.T @ (y - good), (observed - pairs).ravel()]) / len(y)
            return g - 1e-4 * t

        return _adam(grad, theta, steps, 0.1)

    theta = ascend(np.zeros(k + 4))
    good = marginals(x @ theta[:k], start, count, theta[k:].reshape(2, 2))[0]
    worst = np.full(len(docs), np.inf)
    np.minimum.at(worst, owner, good)
    y = np.where((label[owner] == 0) & (good > 0.5) & (good > worst[owner]), 1.0, y)
    theta = ascend(theta)
    good = marginals(x @ theta[:k], start, count, theta[k:].reshape(2, 2))[0]
    mean = np.bincount(owner, good * length) / np.bincount(owner, length)

    def calibrate(t: np.ndarray) -> np.ndarray:
        return np.array([((label - 1 / (1 + np.exp(-(t[0] * mean + t[1])))) * z).mean() for z in (mean, 1.0)]) - 1e-4 * t

    a, b = _adam(calibrate, np.array([4.0, -2.0]), 800, 0.1)
    return {"weights": theta[:k], "trans": theta[k:].reshape(2, 2), "a": float(a), "b": float(b)}


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves no rest by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """label, text, rank of at most ``rows`` labelled documents that are not held out, dealt by a hash of the id.

    One row an id: of several texts the least, found map-side first, so an id on very many rows brings one.
    """
    ids = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    ids = ids.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("label"), F.max(label_col).alias("_max")).where("label = _max")
    ids = ids.withColumn("rank", F.xxhash64("_id")).orderBy("rank", "_id").limit(rows).select("_id", "label", "rank")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(ids), F.col("_doc") == F.col("_id"))
    return found.groupBy("_id", "label", "rank").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("label", "text", "rank")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = 6000, train_lines: int = 2_000_000) -> dict:
    rows = learning_rows(docs, labels, label_col, id_col, text_col, train_rows)
    rows = cut(rows.withColumn("lines", F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1), "learning")
    room, over = train_lines, []
    for rank, lines in rows.select("rank", "lines").orderBy("rank", "lines").collect():  # train_rows rows at most
        if lines <= room:
            room -= lines
        else:
            over.append(rank)
    rows = rows.where(~F.col("rank").isin(over)).select("label", "text") if over else rows.select("label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, data, length = [], [], []
            for y, t in zip(b.column(0), b.column(1), strict=True):
                lines = _split(t.as_py())
                label.append(y.as_py())
                data.append(line_features(lines).astype(np.float32).tobytes())
                length.append(np.array([len(x) + 1 for x in lines], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(data, pa.binary()), pa.array(length, pa.binary())], names=["label", "x", "n"])

    found = rows.repartition(32).mapInArrow(features, "label int, x binary, n binary").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1]), bytes(r[2])))  # any order of the tasks gives the same model
    return fit([(r[0], np.frombuffer(r[1], np.float32).astype(float).reshape(-1, WIDTH), np.frombuffer(r[2], np.float32).astype(float)) for r in found])


def emissions(lines: list[bytes], weights: np.ndarray, most: int = 5000) -> np.ndarray:
    """Each line's log-odds of good; features are held for ``most`` lines at a time."""
    own, prev, nxt = weights[:WIDTH], weights[WIDTH : 2 * WIDTH], weights[2 * WIDTH :]
    score, before, after, seen = [np.empty(len(lines)) for _ in range(3)] + [set()]
    for k in range(0, len(lines), most):
        x = line_features(lines[k : k + most], seen)
        score[k : k + most], before[k : k + most], after[k : k + most] = x @ own, x @ prev, x @ nxt
    score[1:] += before[:-1]
    score[:-1] += after[1:]
    return score


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    """The scores of a block of texts."""
    if not texts or not model:
        return np.full(len(texts), 0.5)
    scores, lengths = [], []
    for t in texts:
        lines = _split(t)
        scores.append(emissions(lines, model["weights"]))
        lengths.append(np.array([len(line) + 1 for line in lines], float))
    count = np.array([len(s) for s in scores])
    start = np.cumsum(count) - count
    length = np.concatenate(lengths)
    good = marginals(np.concatenate(scores), start, count, model["trans"])[0]
    mean = np.add.reduceat(good * length, start) / np.add.reduceat(length, start)
    return 1 / (1 + np.exp(-(model["a"] * mean + model["b"])))


def _blocks(texts: Iterator[str | None], most: int = 2_000_000, rows: int = 500) -> Iterator[list[str | None]]:
    """Runs of at most ``rows`` texts and about ``most`` characters."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t or "")
        if held >= most or len(block) >= rows:
            yield block
            block, held = [], 0
    if block:
        yield block


def _scored(docs: DataFrame, model: dict, text_col: str, extra: str, make) -> DataFrame:
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            scores = [score_texts(block, sent.value) for block in _blocks(t.as_py() for t in b.column(at))]
            yield make(b, np.concatenate(scores or [np.empty(0)]))

    return docs.mapInArrow(run, extra)


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted: one row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    make = lambda b, s: pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])
    out = _scored(docs.select(id_col, text_col), model, text_col, f"id {kind}, score double", make)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows scored under the threshold; columns as given."""
    return _scored(docs, model, text_col, docs.schema, lambda b, s: b.filter(pa.array(s >= threshold, pa.bool_())))
