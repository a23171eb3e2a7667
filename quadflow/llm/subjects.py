"""Subject areas of pages: calibrated classifier chains over term, source and structure features, decoded by beam search."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadflow.runtime import small

#: Labelled pages, at most, that the classifier is fitted on, chosen by hash of their id.
SAMPLE = 6000
#: Chains of different order, combinations kept per chain and step, folds for calibration.
CHAINS, BEAM, FOLDS = 3, 4, 4
#: Lines of one window, in which an article shows but a stray word does not.
WINDOW = 8

_BROKEN = re.compile(r"([^\W\d_])[-‐‑¬=~­][ \t]*\n[ \t]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]{3,}")
_EDGES = [np.array(e, np.float64) for e in ([0.5, 1.5, 2.5, 3.5, 4.5, 6.5, 8.5, 12.5, 20.5, 40.5], [0.5, 1.5, 2.5, 3.5, 4.5, 5.5, 7.5, 10.5, 15.5], [0.03, 0.06, 0.1, 0.15, 0.25, 0.4, 0.6, 0.8], [0.5, 1.5, 2.5, 3.5, 4.5, 6.5, 9.5, 14.5], [0.2, 0.35, 0.5, 0.65, 0.8, 0.95])]
N_BINS = sum(len(e) + 1 for e in _EDGES)


def words_by_line(text: str) -> list[list[str]]:
    """The lower-case words of each line, words broken at a line's end joined on the line they begin on."""
    return [_WORD.findall(line.lower()) for line in _BROKEN.sub(r"\1", text).split("\n")]


def lexicon(pages: list[list[list[str]]], labels: np.ndarray, rounds: int = 12, least: int = 4, background: float = 0.6, leak: float = 0.06) -> dict[str, tuple[int, float]]:
    """word -> (area, weight): which area a word speaks for, by expectation maximization over the labelled pages.

    Each occurrence comes from an area of its page's labels, from the background, or, rarely, from another area.
    """
    n_areas = labels.shape[1]
    per_page = [Counter(w for line in page for w in line) for page in pages]
    df = Counter(w for c in per_page for w in c)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in df.items() if n >= least))}
    if not vocabulary:
        return {}
    at = [(d, vocabulary[w], min(n, 3)) for d, c in enumerate(per_page) for w, n in c.items() if w in vocabulary]
    doc, word, count = (np.array(x) for x in zip(*at, strict=True))
    prior = np.zeros((len(pages), n_areas + 1), np.float32)
    some = labels.sum(1, keepdims=True)
    prior[:, :n_areas] = np.where(labels > 0, (1 - background - leak) / np.maximum(some, 1), leak / np.maximum(n_areas - some, 1))
    prior[:, n_areas] = background
    theta = np.full((len(vocabulary), n_areas + 1), 1.0, np.float32)
    for r in range(rounds):
        share = prior[doc] * theta[word]
        share *= (count / share.sum(1))[:, None]
        mass = np.stack([np.bincount(word, weights=share[:, k], minlength=len(vocabulary)) for k in range(n_areas + 1)], 1)
        theta = ((mass + 0.01) / (mass.sum(0) + 0.01 * len(vocabulary))).astype(np.float32)
    best = mass / mass.sum(1, keepdims=True)
    return {w: (int(best[i, :n_areas].argmax()), float(best[i, :n_areas].max())) for w, i in vocabulary.items() if best[i, :n_areas].max() > 0.5}


def evidence(page: list[list[str]], words: dict[str, tuple[int, float]], n_areas: int) -> np.ndarray:
    """Per area: hits, most hits in a window, share of the page's hits, distinct words, best share of a window with it."""
    lines = np.zeros((len(page) + WINDOW, n_areas))
    distinct: list[set] = [set() for _ in range(n_areas)]
    for i, line in enumerate(page):
        for w in line:
            if hit := words.get(w):
                lines[i, hit[0]] += hit[1]
                distinct[hit[0]].add(w)
    total = lines.sum(0)
    run = np.cumsum(np.vstack([np.zeros(n_areas), lines]), 0)
    windows = run[WINDOW:] - run[:-WINDOW]
    sums = windows.sum(1, keepdims=True)
    share = np.divide(windows, sums, out=np.zeros_like(windows), where=sums > 0)
    at = windows.argmax(0)
    return np.stack([total, windows.max(0), total / max(total.sum(), 1e-9), np.array([len(s) for s in distinct], float), share[at, np.arange(n_areas)]], 1)


def binned(e: np.ndarray) -> np.ndarray:
    """One-hot bins of evidence (..., area, 5) as (..., area, N_BINS)."""
    out = []
    for k, edges in enumerate(_EDGES):
        out.append(np.eye(len(edges) + 1)[np.searchsorted(edges, e[..., k])])
    return np.concatenate(out, -1)


def structure(text: str, page: list[list[str]], source: str | None, rates: dict[str, np.ndarray], overall: np.ndarray, weights: dict[str, tuple[int, float]]) -> np.ndarray:
    """Length, capital lines, share of known words, and how the page's source splits over the areas (log odds to all)."""
    lines = text.split("\n")
    capital = sum(1 for x in lines if x.isupper())
    n_words = sum(map(len, page))
    known = sum(1 for line in page for w in line if w in weights)
    return np.concatenate([[np.log1p(len(lines)) / 5, capital / max(len(lines), 1), known / max(n_words, 1)], rates.get(source or "", overall)])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression, the last column of x being the intercept, by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def monotone(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on p: the knots and their values."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for q, v in zip(p[order], y[order], strict=True):
        blocks.append([q, q, v, 1])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    x = np.array([v for b in blocks for v in (b[0], b[1])])
    return x, np.array([v for b in blocks for v in (b[2] / b[3],) * 2])


@dataclass
class Model:
    areas: list[str]
    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    rates: dict[str, np.ndarray] = field(default_factory=dict)
    overall: np.ndarray | None = None
    pooled: np.ndarray | None = None
    chains: list[tuple[list[int], list[np.ndarray]]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None
    low: float = 0.0
    high: float = 1.0

    def features(self, texts: list[str], sources: list[str | None]) -> np.ndarray:
        """(page, area, feature): the pooled score of the area's evidence, that of the other areas, source and structure."""
        n = len(self.areas)
        pages = [words_by_line(t) for t in texts]
        e = np.stack([evidence(p, self.words, n) for p in pages]) if pages else np.zeros((0, n, 5))
        s = np.stack([structure(t, p, src, self.rates, self.overall, self.words) for t, p, src in zip(texts, pages, sources, strict=True)]) if pages else np.zeros((0, 3 + n))
        return self.assembled(binned(e), s)

    def assembled(self, bins: np.ndarray, s: np.ndarray) -> np.ndarray:
        n = len(self.areas)
        score = np.concatenate([bins, np.ones((*bins.shape[:2], 1))], -1) @ self.pooled
        hot = 1 / (1 + np.exp(-score))
        rest = (hot.sum(1, keepdims=True) - hot)[..., None]
        own = s[:, 3:, None]
        shape = np.broadcast_to(s[:, None, :3], (len(s), n, 3))
        return np.concatenate([score[..., None], rest, own, shape], -1)

    def conditional(self, chain: tuple[list[int], list[np.ndarray]], j: int, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """P(the j-th label of the chain) given features (..., area, feature) and the j labels before it."""
        order, weights = chain
        return 1 / (1 + np.exp(-np.clip(np.concatenate([x, before, np.ones((*x.shape[:-1], 1))], -1) @ weights[j], -30, 30)))

    def true(self, p: np.ndarray) -> np.ndarray:
        """Calibrated, and freed of the labels' noise: low is how often a label is given without cause, high with."""
        q = np.interp(p, *self.knots) if self.knots else p
        return np.clip((q - self.low) / max(self.high - self.low, 1e-6), 1e-4, 1 - 1e-4)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """(page, area) of 0 and 1: the likeliest combination, by beam search in each chain, scored by all chains."""
        m, n = x.shape[:2]
        found = [self.beam(c, x) for c in self.chains]
        sets = np.concatenate(found, 1)  # page, candidate, area
        score = np.zeros(sets.shape[:2])
        for chain in self.chains:
            y = sets[:, :, chain[0]]
            for j, k in enumerate(chain[0]):
                p = self.true(self.conditional(chain, j, np.broadcast_to(x[:, None, k], (m, sets.shape[1], x.shape[2])), y[:, :, :j]))
                score += np.log(np.where(y[:, :, j] > 0, p, 1 - p))
        return sets[np.arange(m), score.argmax(1)] if m else np.zeros((0, n))

    def beam(self, chain: tuple[list[int], list[np.ndarray]], x: np.ndarray) -> np.ndarray:
        m, n = x.shape[:2]
        y, score = np.zeros((m, 1, n)), np.zeros((m, 1))
        for j, k in enumerate(chain[0]):
            p = self.true(self.conditional(chain, j, np.broadcast_to(x[:, None, k], (m, y.shape[1], x.shape[2])), y[:, :, chain[0][:j]]))
            yes = y.copy()
            yes[:, :, k] = 1
            y, score = np.concatenate([y, yes], 1), np.concatenate([score + np.log(1 - p), score + np.log(p)], 1)
            if y.shape[1] > BEAM:
                best = np.argsort(-score, 1, kind="stable")[:, :BEAM]
                y, score = np.take_along_axis(y, best[:, :, None], 1), np.take_along_axis(score, best, 1)
        full = np.full((m, BEAM, n), 0.0)
        full[:, : y.shape[1]] = y
        full[:, y.shape[1] :] = y[:, :1]
        return full


def fit(texts: list[str], sources: list[str | None], labels: np.ndarray, areas: list[str]) -> Model:
    """A model from labelled pages; labels (page, area) of 0 and 1, some of them wrong. Without pages it assigns none."""
    n, m = len(texts), len(areas)
    model = Model(areas)
    if not n or not m:
        model.chains = []
        return model
    pages = [words_by_line(t) for t in texts]
    fold = np.arange(n) % FOLDS
    base = (labels.sum(0) + 0.5) / (n + 1)
    model.overall = np.zeros(m)
    # each fold's evidence comes from words learned on the other folds, else a page would vouch for its own label
    bins, extra = np.zeros((n, m, N_BINS)), np.zeros((n, 3 + m))

    def rates_of(rows: np.ndarray) -> dict[str, np.ndarray]:
        by = defaultdict(list)
        for i in rows:
            by[sources[i] or ""].append(i)
        return {s: np.log((labels[i].sum(0) + 20 * base) / (len(i) + 20) / base) for s, i in by.items()}

    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(train) or not len(test):
            train = test = np.arange(n)
        w = lexicon([pages[i] for i in train], labels[train])
        rates = rates_of(train)
        for i in test:
            bins[i] = binned(evidence(pages[i], w, m))
            extra[i] = structure(texts[i], pages[i], sources[i], rates, model.overall, w)
    model.words, model.rates = lexicon(pages, labels), rates_of(np.arange(n))
    flat = np.concatenate([bins.reshape(n * m, -1), np.ones((n * m, 1))], 1)
    orders = [list(np.random.default_rng(c).permutation(m)) if c else list(np.argsort(-labels.sum(0), kind="stable")) for c in range(CHAINS)]

    def chains_on(rows: np.ndarray, x: np.ndarray) -> list[tuple[list[int], list[np.ndarray]]]:
        one = np.ones((len(rows), 1))
        return [([int(k) for k in o], [logistic(np.concatenate([x[rows][:, k], labels[rows][:, o[:j]], one], 1), labels[rows, k], ridge=3.0) for j, k in enumerate(o)]) for o in orders]

    out_p, out_y = [], []
    for f in range(FOLDS):
        train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if not len(train) or not len(test):
            continue
        model.pooled = logistic(flat[np.repeat(fold != f, m)], labels[train].ravel(), ridge=2.0)
        x = model.assembled(bins, extra)
        for chain in chains_on(train, x):
            for j, k in enumerate(chain[0]):
                out_p.append(model.conditional(chain, j, x[test][:, k], labels[test][:, chain[0][:j]]))
                out_y.append(labels[test, k])
    model.pooled = logistic(flat, labels.ravel(), ridge=2.0)
    x = model.assembled(bins, extra)
    model.chains = chains_on(np.arange(n), x)
    if out_p:
        p, y = np.concatenate(out_p), np.concatenate(out_y)
        model.knots = monotone(p, y)
        order = np.argsort(p)
        some = max(1, int(labels.mean() * len(p) / 2))  # the half of what is likely that is likeliest
        model.low, model.high = float(y[order[: len(p) // 2]].mean()), float(y[order[-some:]].mean())
        if model.high - model.low < 0.2:
            model.low, model.high = 0.0, 1.0
    return model


def fitted(docs: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most sample labelled pages, those with the smallest hashes of their id.

    Only this bounded sample reaches the driver: ids and areas first, then the texts of the chosen pages.
    """
    names = sorted(r[0] for r in areas.select("subject_area").where("subject_area is not null").distinct().collect())  # a fixed few areas
    noted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject_area").alias("noted"))
    chosen = noted.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source").join(small(chosen, sample), "doc_id").orderBy("h", "doc_id", "text").limit(sample).collect()
    y = np.array([[a in set(r["noted"]) for a in names] for r in rows], float).reshape(len(rows), len(names))
    return fit([r["text"] for r in rows], [r["source"] for r in rows], y, names)


def page_areas(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject_area) for every page: the areas of the likeliest combination, none for many a page.

    A null text is empty, an empty one has no area; a null source counts as unknown; repeated rows are judged alike and
    each give rows; a very long page takes one task's time in proportion to its length. Further columns are ignored.
    """
    if not model.areas or not model.chains:
        return docs.select("doc_id", F.lit(None).cast("string").alias("subject_area")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                ids = part.column(0)
                y = model.decode(model.features([t or "" for t in part.column(1).to_pylist()], part.column(2).to_pylist()))
                rows, cols = np.nonzero(y)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array([model.areas[k] for k in cols], pa.string())], names=["doc_id", "subject_area"])

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, subject_area string")


def composition(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject_area, lang, source, n_pages, n_chars): the corpus by area; a page of several areas counts in each, one
    of none under a null area."""
    sized = docs.select("doc_id", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))
    return sized.join(found, "doc_id", "left").groupBy("subject_area", "lang", "source").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("n_chars"))
