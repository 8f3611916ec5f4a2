"""Quality classifier by co-training of two views.

One view sees the text (which words and symbol runs stand in it), the other the metadata of the page (language, source,
length, layout). Each is a logistic model; over a few rounds each labels the rows of an unlabelled pool that it is sure
of for the other one. Both are then calibrated on labelled rows kept apart, the calibrated views are combined, and all
documents are scored in one pass. Two targets are learned this way, low quality and toxicity; a document is kept where
neither is likely.

The models are fitted on samples of bounded size, the SAMPLE labelled and POOL unlabelled documents with the smallest
hash of their id, whatever the size of the corpus. Scoring covers every document and its whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pieces
from docloom.plans.stage import cut

SAMPLE = 6_000
POOL = 3_000
ROUNDS = 3
SURE = 0.97
PER_ROUND = 400
TERMS = 500
STEMS = (8, 7, 6, 5)
LEAST_DOCS = 5
FOLDS = 5
REJECT = 0.5
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SYMBOLS = bytes(b if 33 <= b < 127 and not chr(b).isalnum() else 32 for b in range(256))
_MARKS = re.compile(rb"(?:[!-/:-@\[-`{-~]{2,}|\|)")
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SPACE = b" \t\n\x0b\x0c\r"


def terms(text: bytes) -> set[bytes]:
    """Distinct lower-case words, their beginnings, and runs of two or more symbols or lone bars."""
    found = set(text.translate(_WORDS).split())
    stems = found
    for size in STEMS:
        stems = {w[:size] for w in stems}
        found = found | stems
    found.update(x for x in set(text.translate(_SYMBOLS).split()) if len(x) > 1 or x == b"|")
    return found


def metadata(text: bytes, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Numbers of the metadata view. n_chars is taken as told and may be null."""
    size = max(1, len(text))
    lines = text.split(b"\n")
    words = text.split()
    letters = size - len(text.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    upper = size - len(text.translate(None, _UPPER))
    digits = size - len(text.translate(None, _DIGITS))
    space = size - len(text.translate(None, _SPACE))
    high = len(text.translate(None, bytes(range(128))))
    symbols = len(text) - (letters + digits + space) - high if text else 0
    kinds = [0.0] * 24
    if lang is not None:
        kinds[xxhash.xxh32_intdigest(lang.encode()) % 8] = 1.0
    if source is not None:
        kinds[8 + xxhash.xxh32_intdigest(source.encode()) % 16] = 1.0
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words))
    return [
        np.log1p(n_chars if n_chars is not None and n_chars > 0 else 0), np.log1p(size), np.log1p(len(lines)), np.log1p(size / len(lines)),
        np.log1p(len(words)), len(set(words)) / max(1, len(words)) ** 0.75, stutter, min(stutter * 4, 1.0),
        upper / max(1, letters), min(1.0, 3 * upper / max(1, letters)), digits / size, symbols / size, min(1.0, 8 * max(0, symbols) / size), text.count(b"|") / max(1, len(words)), *kinds,
    ]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights with intercept last, by Newton steps; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Both views of one target: term weights, metadata weights with their scaling, and the combination."""

    words: list[bytes]
    text: np.ndarray
    meta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    mix: np.ndarray

    def views(self, present: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Logits of both views."""
        return np.stack([present @ self.text[:-1] + self.text[-1], (meta - self.mean) / self.scale @ self.meta[:-1] + self.meta[-1]], 1)

    def score(self, present: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(np.clip(self.views(present, meta), -12, 12) @ self.mix[:-1] + self.mix[-1])


def presence(rows: list[set[bytes]], words: list[bytes]) -> np.ndarray:
    at = {t: i for i, t in enumerate(words)}
    out = np.zeros((len(rows), len(words)))
    for r, found in enumerate(rows):
        small, large = (at, found) if len(at) < len(found) else (found, at)
        for t in small:
            if t in large:
                out[r, at[t]] = 1.0
    return out


def co_train(words: list[bytes], text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both views on the labelled rows that are not `held`; the held ones calibrate them."""
    mean, scale = meta[~held].mean(0), meta[~held].std(0)
    scale[scale < 1e-9] = 1.0
    known, unknown = (meta - mean) / scale, (pool_meta - mean) / scale
    views = [(text[~held], pool_text), (known[~held], unknown)]
    extra: list[dict[int, int]] = [{}, {}]  # pseudo-labels that each view was given
    fitted = [np.zeros(0), np.zeros(0)]
    for turn in range(rounds + 1):
        for v, (own, asked) in enumerate(views):
            given = sorted(extra[v])
            labels = np.concatenate([y[~held], np.array([extra[v][i] for i in given], float)])
            fitted[v] = logistic(np.vstack([own, asked[given]]), labels)
        if turn == rounds or not len(pool_text):
            break
        for v, (_, asked) in enumerate(views):
            p = sigmoid(asked @ fitted[v][:-1] + fitted[v][-1])
            for label, sure in ((1, p), (0, 1 - p)):
                best = [i for i in np.argsort(-sure, kind="stable").tolist() if sure[i] >= SURE and i not in extra[1 - v]]
                extra[1 - v].update(dict.fromkeys(best[:PER_ROUND], label))
    model = Model(words, fitted[0], fitted[1], mean, scale, np.array([1.0, 1.0, 0.0]))
    both = np.clip(model.views(text[held], meta[held]), -12, 12)
    calibrated = both_scaled(both, y[held])
    model.mix = calibrated
    return model


def both_scaled(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Platt scaling of each view, then a logistic combination of the calibrated views, as weights of the raw logits."""
    scales = [platt(logits[:, v : v + 1], y) for v in range(logits.shape[1])]
    calibrated = np.stack([logits[:, v] * s[0] + s[1] for v, s in enumerate(scales)], 1)
    w = platt(calibrated, y)
    slopes = np.array([w[v] * s[0] for v, s in enumerate(scales)])
    return np.append(slopes, w[-1] + sum(w[v] * s[1] for v, s in enumerate(scales)))


def platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic fit with the frequencies of the classes as they are, and smoothed targets."""
    ones, zeros = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


_SLIM = ["doc_id", "text", "lang", "source", "n_chars"]


def _slim(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "bigint", "text": "binary", "lang": "string", "source": "string", "n_chars": "bigint"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def _features(batch: pa.RecordBatch) -> tuple[list[set[bytes]], np.ndarray]:
    rows = list(zip(*(batch.column(c).to_pylist() for c in _SLIM[1:]), strict=True))
    return [terms(t or b"") for t, *_ in rows], np.array([metadata(t or b"", a, b, c) for t, a, b, c in rows], float).reshape(len(rows), -1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> dict[str, Model]:
    """Models of `low` (quality 0) and `toxic` from bounded samples; {} where no labels are at hand.

    Labels are one row per document: of repeated ones the worst counts, and rows without both are left out.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = known.agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null")
    here = known.join(ids.distinct(), "doc_id", "left_semi")
    turn = F.xxhash64("doc_id", F.lit(17))
    chosen = here.orderBy(turn, "doc_id").limit(sample)
    rest = ids.join(known, "doc_id", "left_anti").distinct().orderBy(turn, "doc_id").limit(pool)
    wanted = cut(chosen.unionByName(rest, allowMissingColumns=True))  # at most sample + pool rows
    fold = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(FOLDS)) == 0
    wanted = wanted.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), fold.alias("held"))

    def run(batches):
        for batch in pieces(batches):
            rows, meta = _features(batch)
            arrays = [batch.column(c) for c in ("doc_id", "quality", "toxic", "held")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([list(r) for r in rows], pa.list_(pa.binary())), pa.array(meta.tolist(), pa.list_(pa.float64()))], ["doc_id", "quality", "toxic", "held", "terms", "meta"])

    slim = _slim(docs).join(F.broadcast(wanted), "doc_id")
    seen = cut(slim.mapInArrow(run, "doc_id bigint, quality int, toxic int, held boolean, terms array<binary>, meta array<double>"))
    targets = {"low": F.col("quality") <= 0, "toxic": F.col("toxic") > 0}
    fitted_on = seen.where("quality is not null and not held")
    sizes = fitted_on.agg(F.count("*").alias("n"), *[F.count_if(y).alias(k) for k, y in targets.items()]).first()
    counts = fitted_on.select(F.explode("terms").alias("t"), *[y.alias(k) for k, y in targets.items()]).groupBy("t")
    counts = cut(counts.agg(F.count("*").alias("n"), *[F.count_if(k).alias(k) for k in targets]).where(F.col("n") >= LEAST_DOCS))
    words = {k: _chosen(counts, k, sizes[k], sizes["n"]) for k in targets}
    return _fitted(seen, words)


def _chosen(counts: DataFrame, target: str, ones: int, rows: int) -> list[bytes]:
    """The TERMS terms with the largest chi-square against a target, ties by term."""
    if not ones or ones == rows:
        return []
    expected = F.col("n") * (ones / rows)
    apart = F.col(target) - expected
    ranked = counts.select("t", (apart * apart * (1 / expected + 1 / (F.col("n") - expected))).alias("x")).orderBy(F.desc("x"), "t").limit(TERMS)
    return [bytes(r.t) for r in ranked.collect()]


def _fitted(seen: DataFrame, words: dict[str, list[bytes]]) -> dict[str, Model]:
    """Models from the sample, of which only the chosen terms reach the driver."""
    every = sorted(set().union(*words.values()))
    place = {t: i for i, t in enumerate(every)}

    def run(batches):
        for batch in pieces(batches):
            own = [sorted(place[t] for t in found if t in place) for found in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "quality", "toxic", "held", "meta")], pa.array(own, pa.list_(pa.int32()))], ["doc_id", "quality", "toxic", "held", "meta", "at"])

    slim = seen.mapInArrow(run, "doc_id bigint, quality int, toxic int, held boolean, meta array<double>, at array<int>")
    rows = sorted(slim.collect(), key=lambda r: (xxhash.xxh64_intdigest(b"%d" % r.doc_id), r.meta))
    known, pool = [r for r in rows if r.quality is not None], [r for r in rows if r.quality is None]
    held = np.array([r.held for r in known], bool)
    meta = lambda part: np.array([r.meta for r in part], float).reshape(len(part), -1)
    out = {}
    for name, own in words.items():
        y = np.array([float(r.quality <= 0) if name == "low" else float(r.toxic > 0) for r in known])
        if len(y) < 20 or min(y[~held].sum(), (1 - y[~held]).sum()) < 4 or not held.any():
            continue
        column = {place[t]: i for i, t in enumerate(own)}

        def text(part, column=column, own=own):
            x = np.zeros((len(part), len(own)))
            for i, r in enumerate(part):
                x[i, [column[j] for j in r.at if j in column]] = 1.0
            return x

        out[name] = co_train(own, text(known), meta(known), y, held, text(pool), meta(pool) if pool else meta(known)[:0])
    return out


def _scored(models: dict[str, Model], batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows, meta = _features(batch)
    low = models["low"].score(presence(rows, models["low"].words), meta) if "low" in models else np.zeros(len(rows))
    toxic = models["toxic"].score(presence(rows, models["toxic"].words), meta) if "toxic" in models else np.zeros(len(rows))
    return low, toxic


def score_documents(docs: DataFrame, models: dict[str, Model], reject: float = REJECT) -> DataFrame:
    """doc_id, low_score, toxic_score and keep of every row. A null text is an empty one; missing metadata is zero.
    Without a model for a target its score is zero."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few hundred weights for each target

    def run(batches):
        for batch in pieces(batches):
            low, toxic = _scored(shared.value, batch)
            keep = (low < reject) & (toxic < reject)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(low), pa.array(toxic), pa.array(keep)], ["doc_id", "low_score", "toxic_score", "keep"])

    return _slim(docs).mapInArrow(run, "doc_id bigint, low_score double, toxic_score double, keep boolean")


def keep_good(docs: DataFrame, models: dict[str, Model], reject: float = REJECT) -> DataFrame:
    """The rows of `docs` that are kept, in one pass and without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names, kinds = docs.columns, {"doc_id": pa.int64(), "text": pa.binary(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}

    def run(batches):
        for batch in pieces(batches):
            columns = [batch.column(c).cast(kinds[c]) if c in names else pa.nulls(batch.num_rows, kinds[c]) for c in _SLIM]
            low, toxic = _scored(shared.value, pa.RecordBatch.from_arrays(columns, _SLIM))
            yield batch.filter(pa.array((low < reject) & (toxic < reject)))

    return docs.mapInArrow(run, docs.schema)
