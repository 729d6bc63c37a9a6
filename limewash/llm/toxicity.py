"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col
from limewash.llm.words import ALNUM, LOWER, U, Words, mix, owners, small_batches, words_of

BITS = 18
PREFIXES = (3, 4, 5, 6)
#: A chain is a sentence, or this many words of it.
CHAIN = 64
STEP = 1 << 19
#: Chains that are computed side by side.
AT_ONCE = 2048
#: Labelled rows of either class that the model is fitted on at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2000, 20_000
#: Share of the words and beginnings taken for toxic tokens that may be so by chance, and the share of
#: toxic surroundings among all surroundings of one.
CHANCE, PRECISION = 0.2, 0.95

_END = np.zeros(256, np.int32)
_END[[10, 33, 46, 63]] = 1
_random = np.random.default_rng(98317)
_LETTER = _random.integers(0, 1 << 63, (max(PREFIXES), 257), dtype=np.uint64) * U(2) + U(1)


def features(words: Words) -> np.ndarray:
    """Hashed features of every word, one per column: the word, and its first 3 to 6 bytes (of a
    shorter word, all of it, marked)."""
    h = np.zeros(len(words.starts), U)
    columns = [(mix(words.hashes) >> U(64 - BITS)).astype(np.int32)]
    last = max(len(words.data) - 1, 0)
    for k in range(max(PREFIXES)):
        place = words.starts + k
        letter = np.where(place < words.ends, LOWER[words.data[np.minimum(place, last)]] if len(words.data) else 0, 256)
        h = h + _LETTER[k][letter]
        if k + 1 in PREFIXES:
            columns.append((mix(h + U(k + 1)) >> U(64 - BITS)).astype(np.int32))
    return np.stack(columns, axis=1)


def chains(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The chain of every word and its place in the chain."""
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.append(0, np.cumsum(_END[words.data]))
    owner = owners(words.first)
    new = np.ones(n, bool)
    new[1:] = (ends[words.starts[1:]] > ends[words.ends[:-1]]) | (owner[1:] != owner[:-1])
    at = np.arange(n)
    place = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= place % CHAIN == 0
    return np.cumsum(new) - 1, place % CHAIN


@dataclass
class Model:
    weights: np.ndarray  # of features, for the toxic state
    moves: np.ndarray  # log weights of (state, next state)
    first: float  # log weight of a chain that begins toxic
    scale: np.ndarray  # of the document score
    base: float | None = None  # the score of everything, if there was nothing to learn

    def marginals(self, feature: np.ndarray, chain: np.ndarray, place: np.ndarray, tags: np.ndarray | None = None):
        """The probability of every word to be toxic; with tags also the gradient of moves and first."""
        out = np.zeros(len(chain))
        grad, grad_first = np.zeros((2, 2)), 0.0
        emit = np.zeros(len(chain))
        for k in range(feature.shape[1]):
            emit += self.weights[feature[:, k]]
        emit = np.exp(np.clip(emit, -30, 30))
        step = np.exp(self.moves)
        bounds = np.searchsorted(chain, np.arange(0, (chain[-1] if len(chain) else -1) + AT_ONCE + 1, AT_ONCE))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            c, t = chain[a:b] - chain[a], place[a:b]
            n, length = int(c[-1]) + 1, int(t.max()) + 1
            psi, inside = np.ones((length, n)), np.zeros((length, n), bool)
            psi[t, c], inside[t, c] = emit[a:b], True
            alpha, beta = np.empty((length, 2, n)), np.ones((length, 2, n))
            now = np.stack([np.ones(n), np.exp(self.first) * psi[0]])
            alpha[0] = now / now.sum(axis=0)
            for k in range(1, length):
                now = step.T @ alpha[k - 1]
                now[1] *= psi[k]
                alpha[k] = now / now.sum(axis=0)
            for k in range(length - 2, -1, -1):
                later = np.stack([beta[k + 1][0], beta[k + 1][1] * psi[k + 1]])
                now = step @ later
                beta[k] = np.where(inside[k + 1], now / now.sum(axis=0), 1.0)
            both = alpha * beta
            prob = both[:, 1] / both.sum(axis=1)
            out[a:b] = prob[t, c]
            if tags is not None:
                tag = np.zeros((length, n), int)
                tag[t, c] = tags[a:b]
                for k in range(1, length):
                    pair = alpha[k - 1][:, None, :] * step[:, :, None] * np.stack([beta[k][0], beta[k][1] * psi[k]])[None]
                    pair = pair / pair.sum(axis=(0, 1)) * inside[k]
                    grad -= pair.sum(axis=2)
                    np.add.at(grad, (tag[k - 1][inside[k]], tag[k][inside[k]]), 1)
                grad_first += float((tag[0] - prob[0]).sum())
        return (out, grad, grad_first) if tags is not None else out

    def score(self, summary: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(summary), self.base)
        return 1 / (1 + np.exp(-np.clip(summary @ self.scale[1:] + self.scale[0], -30, 30)))


def summaries(prob: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: log odds of its most toxic word, and the log of the expected number of such."""
    n = len(first) - 1
    top, total = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        top[full] = np.maximum.reduceat(prob, first[full])
        total[full] = np.add.reduceat(np.where(prob > 0.05, prob, 0), first[full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(top / (1 - top)), np.log1p(total)], axis=1)


def unlikely(bad: np.ndarray, clean: np.ndarray, base: float) -> np.ndarray:
    """Which features stand in more toxic texts than chance gives, a share of CHANCE of them wrongly.

    The likelihood-ratio bound on a tail of the binomial law of ``base`` weighs ``bad`` against
    ``clean`` at any size. What chance finds at a bound counts only the features that stand in
    enough texts to reach it.
    """
    n = bad + clean
    share = bad / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(bad > 0, bad * np.log(share / base), 0) + np.where(clean > 0, clean * np.log((1 - share) / (1 - base)), 0)
    tail = np.where((share > base) & (n > 0), np.exp(-gain), 1.0)
    level = np.sort(tail[n > 0])
    if not len(level):
        return np.zeros(len(n), bool)
    able = np.searchsorted(np.sort(base ** n[n > 0]), level * (1 + 1e-9), "right")
    fits = level[level * able <= CHANCE * np.searchsorted(level, level, "right")]
    return (n > 0) & (tail <= (fits[-1] if len(fits) else -1.0))


def token_tags(feature: np.ndarray, words: Words, toxic: np.ndarray) -> np.ndarray:
    """Tags of words, learnt from labels of documents.

    A feature is toxic if it stands in more toxic documents than chance gives (``unlikely``) and
    hardly in surroundings (the words before and after) of clean ones. A feature of toxic documents
    counts once per document and once per surroundings, whichever are fewer, so what a few much
    copied documents share does not count. A word of a toxic document with such a feature is tagged.
    """
    owner = owners(words.first)
    h = words.hashes
    around = mix(np.append(U(0), h[:-1]) * U(3) + np.append(h[1:], U(0)))
    counts, texts = np.zeros((2, 1 << BITS)), np.zeros((2, 1 << BITS))
    for k in range(feature.shape[1]):
        for y in (0, 1):
            own = toxic[owner] == y
            pair = np.unique(mix(around[own] ^ mix(feature[own, k].astype(U))) & ~U((1 << BITS) - 1) | feature[own, k].astype(U))
            counts[y] += np.bincount((pair & U((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
            pair = np.unique(owner[own].astype(np.int64) << BITS | feature[own, k])
            texts[y] += np.bincount(pair & ((1 << BITS) - 1), minlength=1 << BITS)
    size = [max(1.0, float((toxic[owner] == y).sum())) for y in (0, 1)]
    base = min(max(float(texts[1].sum() / max(texts.sum(), 1)), 1e-9), 1 - 1e-9)  # of one text and feature
    clean, bad = counts[0] * size[1] / size[0], counts[1]
    chosen = unlikely(np.minimum(texts[1], bad), texts[0], base) & (bad >= PRECISION * (bad + clean))
    return (chosen[feature].any(axis=1) & (toxic[owner] == 1)).astype(int)


def fit(texts: list[str], labels: list[int], rounds: int = 30, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Maximum likelihood by gradient steps of adaptive size over all chains, then a logistic
    calibration of the document score on the same documents."""
    none = Model(np.zeros(1 << BITS), np.zeros((2, 2)), 0.0, np.zeros(3))
    if len(set(labels)) < 2:
        none.base = float(labels[0]) if labels else 0.5
        return none
    words = words_of(pa.array(texts, pa.large_string()), ALNUM)
    label = np.asarray(labels)
    feature, (chain, place) = features(words), chains(words)
    tags = token_tags(feature, words, label)
    if not tags.any():  # no word tells the classes apart
        none.base = float(label.mean())
        return none
    model = Model(np.zeros(1 << BITS), np.array([[0.0, -3.0], [-1.0, 0.0]]), -3.0, np.zeros(3))
    seen, seen_moves, seen_first = np.full(1 << BITS, 1e-2), np.full((2, 2), 1.0), 1.0
    for _ in range(rounds):
        prob, moves, first = model.marginals(feature, chain, place, tags)
        error = tags - prob
        grad = sum(np.bincount(feature[:, k], weights=error, minlength=1 << BITS) for k in range(feature.shape[1]))
        grad -= decay * len(tags) * model.weights
        seen += grad**2
        seen_moves += moves**2
        seen_first += first**2
        model.weights += rate * grad / np.sqrt(seen)
        model.moves += rate * moves / np.sqrt(seen_moves)
        model.first += rate * first / np.sqrt(seen_first)
    model.weights = model.weights.astype(np.float32)
    x = summaries(model.marginals(feature, chain, place), words.first)
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    for _ in range(25):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-np.clip(x @ model.scale, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        model.scale = model.scale + np.linalg.solve(hess, x.T @ (label - p) - 1e-2 * model.scale)
    return model


def held_out(key: Column) -> Column:
    """Rows that the model never learns from: those with crc32(key as text) mod 4 = 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES,
) -> Model:
    """Fit on at most ``sample`` labelled documents of either class, none of them held out and none
    of more than ``sample_bytes`` bytes. So the sample is bounded, and one task does the fitting; only
    the model comes to the driver.

    Documents of one text (by a 64-bit hash) count once. They are the first in the order of a hash of
    their ids. A document or text with several labels counts as toxic if any is; null ids and labels
    are left out. Without two classes there is nothing to
    learn, and every score is the one label, or a half.
    """
    usable = labels.where(col(key).isNotNull() & col(label).isNotNull() & ~held_out(col(key)))
    one = usable.groupBy(col(key).cast("long").alias("id__")).agg(F.max(col(label).cast("int")).alias("label__"))
    short = docs.where(F.octet_length(col(text)) <= sample_bytes).select(col(key).cast("long").alias("doc__"), F.xxhash64(col(text)).alias("hash__"))
    one = one.join(short, F.col("id__") == F.col("doc__")).groupBy("hash__").agg(F.min("id__").alias("id__"), F.max("label__").alias("label__"))
    picked = one.where("label__ = 1").orderBy(F.xxhash64("id__"), "id__", "hash__").limit(sample).unionByName(
        one.where("label__ = 0").orderBy(F.xxhash64("id__"), "id__", "hash__").limit(sample)
    ).select("hash__", "id__", "label__").collect()
    chosen = {r[0]: r[2] for r in picked}
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], "pick__ bigint, of__ bigint")
    fits = (col(key).cast("long") == F.col("of__")) & (F.xxhash64(col(text)) == F.col("pick__"))
    rows = docs.join(F.broadcast(ids), fits).where(F.octet_length(col(text)) <= sample_bytes)
    rows = rows.groupBy("of__", "pick__").agg(F.min(col(text)).alias("text__"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        model = fit([t for _, _, t in sampled], [chosen[h] for _, h, _ in sampled])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = rows.coalesce(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else fit([], [])


def tag(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: toxic likelier) and ``toxic_spans``: start and end, in
    characters, of the words whose probability to be toxic is ``least`` or more; words in a row
    are one span. Null and empty texts have the score of a text without toxic words, and no span.
    Repeated rows are alike; columns of these names are replaced.
    """
    names = [c for c in df.columns if c not in ("score", "toxic_spans")]
    schema = "".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}, " for c in names)
    schema += "score double, toxic_spans array<struct<start:int,end:int>>"
    sent = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in small_batches(batches, "text__", STEP):
            words = words_of(batch.column(len(names)), ALNUM)
            prob = model.marginals(features(words), *chains(words)) if model.base is None else np.zeros(len(words.starts))
            score = model.score(summaries(prob, words.first))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            hit = np.flatnonzero(prob >= least)
            if len(hit):
                owner = owners(words.first)[hit]
                characters = np.append(0, np.cumsum((words.data & 0xC0) != 0x80))
                new = np.append(True, (hit[1:] != hit[:-1] + 1) | (owner[1:] != owner[:-1]))
                cut = np.flatnonzero(new)
                for a, b in zip(cut, np.append(cut[1:], len(hit)) - 1):
                    base = characters[words.offsets[owner[a]]]
                    spans[owner[a]].append({"start": int(characters[words.starts[hit[a]]] - base), "end": int(characters[words.ends[hit[b]]] - base)})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(score, pa.float64()), pa.array(spans, pa.list_(span))], names=[*names, "score", "toxic_spans"]
            )

    return df.select(*[col(c) for c in names], col(text).alias("text__")).mapInArrow(run, schema)


def drop_toxic(df: DataFrame, model: Model, text: str = "text", reject: float = 0.3) -> DataFrame:
    """``df`` without the rows whose score is ``reject`` or more. Same columns."""
    inner = df.select(*[col(c).alias(f"c{i}__") for i, c in enumerate(df.columns)])
    scored = tag(inner, model, f"c{df.columns.index(text)}__").where(F.col("score") < reject)
    return scored.select(*[F.col(f"c{i}__").alias(c) for i, c in enumerate(df.columns)])
