"""Toxicity as severity: cumulative-link (proportional odds) regression on sparse text features. One weight vector is shared by all ordered thresholds, P(grade <= k) = sigmoid(t_k - w.x), and the output is the expected severity.

Features of a document are counted over its words: the words themselves and their first four and five letters, which also catch inflected forms. The model is fitted on a bounded sample of labelled documents (SAMPLE_ROWS a class; labels meet their documents first, then those with the least hash of doc_id and text are taken, so the sample depends neither on partitions nor on labels of other tables), each counted whole in the executors: its distinct words' counts go to the driver, not its text; everything else sees all rows. Features that lean to the toxic class by the G statistic are fitted. Labels say only toxic or not, so toxic training rows get their grade 1 to 3 across: the sample is cut into FOLDS parts, and a row is graded by how many of its words have a feature that the other parts mark; no feature may lower the severity.
The fitted weights, one for each such feature of the sample (those of 0.001 or less are zero), go to the executors with the task. Near copies of rows before them in the sample (by min-hashes) are not fitted twice. Severity is an order, not a calibrated scale.

Edge cases: null and empty texts have no features and get the baseline severity; very long texts are read whole, a batch of at most 1000 texts at a time; labels with a null or repeated doc_id, without a document or with a null toxic are left out or count once; documents that share a labelled doc_id but not their text each count, repeated rows once; with no toxic or no clean labelled row nothing is rejected (severity 0); repeated rows each give a row; no rows give no rows; further columns are ignored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import document_key, materialise, maybe_broadcast, released, released_after, small_batches, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Sampled labelled rows of each class, least ratio of its share among toxic to that among clean rows and least G statistic of a feature, ordered grades.
SAMPLE_ROWS, MARK_RATIO, LEAST_G, GRADES = 3000, 4.0, 15.0, 4
#: Parts of the sample whose rows are graded by what the other parts mark.
FOLDS = 5
CACHED = 100_000


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


@dataclass
class Severity:
    """weights by feature, and the ordered thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def latent(self, words: list[str]) -> float:
        return sum(self.weights.get(f, 0.0) for w in words for f in features(w))

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: one row a document."""
        t = np.asarray(self.thresholds)
        return 1 / (1 + np.exp(np.clip(t[None, :] - latent[:, None], -60, 60)))


def fit_ordinal(rows: list[np.ndarray], counts: list[np.ndarray], grades: np.ndarray, size: int, levels: int = GRADES, steps: int = 300, ridge: float = 1e-4, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch Adam on the balanced log-likelihood; rows hold feature numbers, counts their values."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col, val = np.concatenate(rows), np.concatenate(counts)
    toxic = grades > 0
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    # thresholds: the first, and the logs of the gaps after it
    theta = np.zeros(size + levels - 1)
    theta[size] = 1.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = np.arange(len(grades))
    for step in range(1, steps + 1):
        w, gaps = theta[:size], np.exp(np.clip(theta[size + 1 :], -5, 5))
        t = theta[size] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(doc, weights=w[col] * val, minlength=len(rows))
        cdf = 1 / (1 + np.exp(np.clip(z[:, None] - t[None, :], -60, 60)))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(z), 1)), cdf, np.ones((len(z), 1))], axis=1)
        p = np.maximum(full[n, grades + 1] - full[n, grades], 1e-12)
        slope = full * (1 - full)
        up, down = slope[n, grades + 1], slope[n, grades]
        dz = weight * (up - down) / p  # of the negative log-likelihood
        dt = np.zeros((len(z), levels + 1))
        dt[n, grades + 1] -= weight * up / p
        dt[n, grades] += weight * down / p
        dt = dt[:, 1:levels].sum(axis=0)
        grad = np.empty_like(theta)
        grad[:size] = np.bincount(col, weights=dz[doc] * val, minlength=size) + ridge * w
        grad[size] = dt.sum()
        grad[size + 1 :] = np.cumsum(dt[:0:-1])[::-1] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:size] = np.maximum(theta[:size], 0.0)
    gaps = np.exp(np.clip(theta[size + 1 :], -5, 5))
    return theta[:size], theta[size] + np.concatenate([[0.0], np.cumsum(gaps)])


def association(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """The G statistic of features that a of n toxic and b of m clean rows hold; 0 for those that don't lean to the toxic."""
    out = np.zeros(len(a))
    share = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, rows in ((a, n), (b, m)):
            for seen, part in ((x, share), (rows - x, 1 - share)):
                out += np.where(seen > 0, seen * np.log(seen / (rows * part)), 0.0)
    return np.where(a * m > b * n, 2 * out, 0.0)


#: What the fit needs of a text: its distinct words in the order of their first places, their counts, three min-hashes of its word triples.
Profile = tuple[list[str], list[int], list[int]]


def profile(text: str) -> Profile:
    import xxhash

    w = WORD.findall(text.lower())
    many = Counter(w)
    triples = np.fromiter((xxhash.xxh64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), dtype=np.uint64)
    least = [int((triples * np.uint64(m)).min()) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    return list(many), list(many.values()), least


def unlike(profiles: Sequence[Profile], toxic: list[bool]) -> list[int]:
    """Rows of the sample without near copies of rows before them in the class, whose rare words would look toxic: those that share none of three min-hashes of word triples."""
    seen: set[tuple] = set()
    out = []
    for k, ((_, _, least), x) in enumerate(zip(iter(profiles), toxic, strict=True)):
        keys = {(x, j, h) for j, h in enumerate(least)}
        if not keys & seen:
            out.append(k)
        seen |= keys
    return out


@dataclass
class Counted:
    """A row's features by number: the words that have any of them, their counts, and which word has which."""

    counts: np.ndarray
    word: np.ndarray
    feature: np.ndarray

    @property
    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Its features, and how often it has each."""
        f, at = np.unique(self.feature, return_inverse=True)
        return f, np.bincount(at, weights=self.counts[self.word], minlength=len(f)) if len(f) else np.zeros(0)


def counted(p: Profile, number: dict[str, int]) -> Counted:
    counts, word, feature = [], [], []
    for w, c in zip(p[0], p[1], strict=True):
        found = [number[f] for f in features(w) if f in number]
        if found:
            word += [len(counts)] * len(found)
            feature += found
            counts.append(c)
    return Counted(np.array(counts, np.int32), np.array(word, np.int32), np.array(feature, np.int32))


def marks(held: list[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the features (of `size`), strongest first, that lean to the toxic of some rows' features."""
    n, m = int(toxic.sum()), int((~toxic).sum())
    if not n or not m:
        return np.zeros(0, np.int64)
    of = lambda kind: np.bincount(np.concatenate([h for h, x in zip(held, toxic, strict=True) if x == kind]), minlength=size)
    a, b = of(True), of(False)
    g = association(a, n, b, m)
    good = np.flatnonzero((a >= (3 if n >= 100 else 2)) & (a / n >= MARK_RATIO * (b + 0.5) / m) & (g >= LEAST_G))
    return good[np.lexsort((good, -g[good]))]


def fit(texts: list[str], toxic: list[bool]) -> Severity:
    """The model of texts held in memory."""
    return fit_profiles([profile(t) for t in texts], toxic)


def fit_profiles(profiles: Sequence[Profile], toxic: list[bool]) -> Severity:
    """The model of a sample."""
    kept = unlike(profiles, toxic)
    toxic = [toxic[k] for k in kept]
    n, m = sum(toxic), len(toxic) - sum(toxic)
    if not n or not m:
        return Severity({}, [60.0] * (GRADES - 1))

    in_toxic: Counter = Counter()
    for k, x in zip(kept, toxic, strict=True):
        if x:
            in_toxic.update({f for w in profiles[k][0] for f in features(w)})
    names = sorted(f for f, c in in_toxic.items() if c >= 2)
    del in_toxic
    number = {f: k for k, f in enumerate(names)}
    every = [counted(profiles[k], number) for k in kept]
    is_toxic = np.array(toxic)
    own = [r.own for r in every]
    held = [f for f, _ in own]
    chosen = marks(held, is_toxic, len(names))
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    rows, values = [], []
    for f, c in own:
        at = place[f]
        rows.append(at[at >= 0])
        values.append(c[at >= 0])
    many = np.zeros(len(every))
    for fold in range(FOLDS):
        rest = np.arange(len(every)) % FOLDS != fold
        marked = np.zeros(len(names), bool)
        marked[marks([h for h, r in zip(held, rest, strict=True) if r], is_toxic[rest], len(names))] = True
        for k in np.flatnonzero(~rest).tolist():
            words = np.unique(every[k].word[marked[every[k].feature]])
            many[k] = every[k].counts[words].sum()
    cuts = np.quantile(many[is_toxic], [k / (GRADES - 1) for k in range(1, GRADES - 1)])
    grades = np.where(is_toxic, 1 + np.searchsorted(cuts, many, side="left"), 0)
    w, at = fit_ordinal(rows, values, grades, len(chosen))
    return Severity({names[f]: float(x) for f, x in zip(chosen.tolist(), w, strict=True) if abs(x) > 1e-3}, [float(x) for x in at])


class Profiles(Sequence):
    """Profiles of an Arrow table, each made when it is asked for: the driver holds texts' words as they came, and no list of them."""

    def __init__(self, rows):
        self.rows = rows

    def __len__(self) -> int:
        return self.rows.num_rows

    def __getitem__(self, k: int) -> Profile:
        words, counts, least = (self.rows[c][k].as_py() for c in ("words", "counts", "least"))
        return words.split(" ") if words else [], counts, least


def sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[Profile, bool]]:
    """(profile, toxic) of what sampled gives."""
    got = sampled(documents, labels, rows)
    return list(zip(Profiles(got), got["toxic"].to_pylist(), strict=True))


def sampled(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """An Arrow table (h, toxic, words, counts, least) of at most `rows` labelled documents of each class: those whose doc_id and text hash least."""
    import pyarrow as pa

    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    keyed = documents.filter("doc_id is not null").select(document_key().alias("key"), "text")
    found = keyed.select("key", F.col("key.doc_id").alias("doc_id")).join(maybe_broadcast(known), "doc_id").groupBy("key").agg(F.first("toxic").alias("toxic"))
    found = materialise(found.withColumn("h", F.xxhash64("key", F.lit(9))), "labelled")
    picked = found.filter("toxic").orderBy("h", "key").limit(rows).unionByName(found.filter("not toxic").orderBy("h", "key").limit(rows))
    few = F.broadcast(materialise(picked.select("key", "toxic", "h"), "sampled"))  # 2 x rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [profile(t.as_py() or "") for t in b.column(1)]
            # No word holds a space. Unsigned hashes go as the signed ones of the same bits.
            least = np.array([h for _, _, h in got], dtype=np.uint64).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([" ".join(w) for w, _, _ in got], pa.string()), pa.array([c for _, c, _ in got], pa.list_(pa.int32())), pa.array(least, pa.list_(pa.int64()))], ["h", "toxic", "words", "counts", "least"])

    rows_of = small_batches(keyed).join(few, "key").select("h", "text", "toxic")
    got = rows_of.mapInArrow(released(run), "h long, toxic boolean, words string, counts array<int>, least array<bigint>").dropDuplicates(["h"]).toArrow()
    return got.sort_by("h").combine_chunks()


class _Weights(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        get = self.weights.get
        w = sum(get(f, 0.0) for f in features(word))
        if len(self) >= CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = w
        return w


def score(documents: DataFrame, model: Severity) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (probability of grade 1 or more), toxic (p_toxic >= 0.5), n_words."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = _Weights(model.weights).__getitem__
        for b in batches:
            latent, n = [], []
            for text in b.column(1):
                words = WORD.findall((text.as_py() or "").lower())
                n.append(len(words))
                latent.append(sum(map(weight, words)))
            p = model.probabilities(np.array(latent, dtype=float)).round(9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5), pa.array(n, pa.int64())], ["doc_id", "severity", "p_toxic", "toxic", "n_words"])

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return small_batches(documents).select("doc_id", "text").mapInArrow(released(run), f"doc_id {id_type}, severity double, p_toxic double, toxic boolean, n_words long")


@released_after
def fitted(documents: DataFrame, labels: DataFrame) -> Severity:
    got = sampled(documents, labels)
    return fit_profiles(Profiles(got), got["toxic"].to_pylist())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score(documents, fitted(documents, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without those that the model finds toxic."""
    keyed = documents.select(document_key().alias("doc_id"), "text")
    bad = materialise(score(keyed, fitted(documents, labels)).filter("toxic").select(F.col("doc_id").alias("bad")).distinct(), "toxic")
    return documents.join(maybe_broadcast(bad), document_key() == F.col("bad"), "left_anti").select(documents.columns)
