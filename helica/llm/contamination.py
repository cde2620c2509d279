"""Passages of evaluation items inside a large corpus.

Texts become passages of ``WINDOW`` words, every ``STRIDE`` words. A passage is a
TF-IDF vector over the terms of the evaluation items, with document frequencies
from the whole corpus. A randomised SVD of the items' passages gives a latent
space. A corpus passage is held against the items' passages with which it shares
a rare term; those near it in the latent space are candidates, whose words are
then compared one by one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helica.session import cut_lineage

WINDOW, STRIDE = 24, 12
RANK = 256
#: Cosine from which a pair is a candidate: for passages with 12 words in a row, and for paraphrases.
MIN_COSINE = 0.1
MIN_COSINE_PARAPHRASE = 0.3
#: Words of ``WINDOW`` that a paraphrase has in common with its item, in the same order.
ALIKE = (2 * WINDOW) // 3
#: Terms of an item's passage that the fewest other passages have, and how many of them a text has to have near for a paraphrase.
RARE_TERMS, RARE_SHARED = 10, 3
#: Words of items that are searched for in one pass over the corpus; more are searched in blocks. Bounds what is broadcast: a vector for every 12 words and every term, about 400 MB at most.
WORDS_PER_BLOCK = 2_000_000
SEED = 20
#: Pairs of passages compared at once; bounds a worker's memory.
AT_ONCE = 4096

TOKEN = re.compile(
    r"\\(?:[a-z]*cite[a-z]*|ref|eqref|pageref|autoref|cref|label|bibitem)\*?\s*(?:\[[^\]]*\]\s*)*\{[^}]*\}"
    r"|\\(?:begin|end)\s*\{[^}]*\}|\\[a-z]+\*?|([^\W_]+)"
)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without markup commands, citation and label keys."""
    return [w for w in TOKEN.findall(text.lower()) if w] if text else []


def starts(n: int) -> np.ndarray:
    """Where the passages of a text of ``n`` words start: any ``STRIDE`` words in a row lie within one passage."""
    return np.arange(0, max(n - STRIDE, 0) + 1, STRIDE) if n else np.empty(0, np.int64)


def passages(ids: np.ndarray) -> np.ndarray:
    """The passages of a text as rows of ``WINDOW`` term numbers, filled up with 0."""
    at = starts(len(ids))
    return np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])[at[:, None] + np.arange(WINDOW)]


def regions(ids: np.ndarray) -> np.ndarray:
    """The passages of a text with the ``STRIDE`` words before and after each."""
    at = starts(len(ids))
    return np.concatenate([np.zeros(STRIDE, ids.dtype), ids, np.zeros(WINDOW + STRIDE, ids.dtype)])[at[:, None] + np.arange(WINDOW + 2 * STRIDE)]


def in_runs(known: np.ndarray, length: int) -> np.ndarray:
    """Where a text has ``length`` known words in a row."""
    step = np.diff(np.concatenate([[0], known.view(np.int8), [0]]))
    first, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - first >= length
    mark = np.zeros(len(known) + 1, np.int32)
    mark[first[long]] += 1
    mark[end[long]] -= 1
    return np.cumsum(mark[:-1]) > 0


@dataclass(frozen=True)
class Items:
    """Evaluation items: their words and answers as term numbers. Terms up to ``n_terms`` are those of passages; answers may have others."""

    keys: list
    terms: dict[str, int]
    n_terms: int
    ids: list[np.ndarray]
    answers: list[np.ndarray]

    @property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All passages of the items, the item of each, and where it starts in it."""
        rows = [passages(i) for i in self.ids]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.concatenate([starts(len(i)) for i in self.ids]) if rows else np.empty(0, np.int64)
        return (np.concatenate(rows) if rows else np.empty((0, WINDOW), np.int32)), owner, at


def read_items(rows: list) -> Items:
    """Items from (key, passage, answer) rows; null passages have no words."""
    terms: dict[str, int] = {}
    number = lambda text: np.array([terms.setdefault(w, len(terms) + 1) for w in words(text)], np.int32)
    ids = [number(r[1]) for r in rows]
    n_terms = len(terms)
    return Items([r[0] for r in rows], terms, n_terms, ids, [number(r[2]) for r in rows])


def numbered_texts(corpus: DataFrame, terms: dict[str, int]) -> DataFrame:
    """The corpus (``k``, ``t``) as term numbers, cut into words once: ``k`` and ``ids`` of each text with a known word, and ``term`` and ``n``, each partition's document frequencies.

    The number 0 stands for words that no item has; as a term it counts the texts.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(terms)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        n = np.zeros(len(known) + 1, np.int64)
        for batch in batches:
            keys, held = [], []
            for k, t in zip(batch["k"], batch["t"]):
                w = words(t)
                ids = np.fromiter((known.get(x, 0) for x in w), np.int32, len(w))
                found = np.unique(ids)
                n[found] += found > 0
                n[0] += 1
                if found.any():
                    keys.append(k)
                    held.append(zlib.compress(ids.tobytes(), 1))
            yield pd.DataFrame({"k": pd.Series(keys, dtype=object), "ids": pd.Series(held, dtype=object), "term": pd.Series([None] * len(keys), dtype="Int32"), "n": pd.Series([None] * len(keys), dtype="Int64")})
        used = np.flatnonzero(n)
        yield pd.DataFrame({"k": pd.Series([None] * len(used), dtype=object), "ids": pd.Series([None] * len(used), dtype=object), "term": pd.Series(used, dtype="Int32"), "n": pd.Series(n[used], dtype="Int64")})

    return corpus.mapInPandas(number, "k string, ids binary, term int, n long")


def term_weights(numbered: DataFrame, items: Items) -> np.ndarray:
    """Inverse document frequency of each term of the items' passages over all texts; 0 for all other numbers. Only one sum a term comes to the driver."""
    sums = numbered.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(items.terms) + 1)
    n[sums["term"].to_numpy(int)] = sums["n"].to_numpy(float)
    idf = np.log((2 + n[0]) / (1 + n))
    idf[0] = 0
    idf[items.n_terms + 1 :] = 0
    return idf


def gathered(rows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """For each passage the sum of its terms' rows of ``weighted``, of length 1: its vector times a thin matrix, without the vector."""
    out = np.zeros((len(rows), weighted.shape[1]), weighted.dtype)
    for j in range(rows.shape[1]):
        out += weighted[rows[:, j]]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def latent_space(spark, windows: np.ndarray, idf: np.ndarray, rank: int = RANK, power: int = 2, seed: int = SEED) -> np.ndarray:
    """Term directions (terms x rank) of a randomised SVD of the passages' TF-IDF matrix A.

    The passages are a distributed table. Each step multiplies a thin matrix by
    A'A: tasks go through their rows of A by the terms that are in them, and only
    sums of the thin products (terms x rank) come back; the driver orthonormalises
    them. No task or driver holds A.
    """
    n_terms = len(idf)
    rank = min(rank, n_terms - 1, max(len(windows), 1))
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, rank)))[0]
    if not len(windows):
        return thin
    slices = max(1, min(8, len(windows) // 512))  # each sends terms x rank numbers to the driver
    rows = spark.createDataFrame(pd.DataFrame({"w": [r.tobytes() for r in windows.astype(np.int32)]}), "w binary").repartition(slices)
    for _ in range(power + 1):
        q = spark.sparkContext.broadcast((thin, idf))

        def product(batches: Iterator[pd.DataFrame], q=q) -> Iterator[pd.DataFrame]:
            thin, idf = q.value
            total = np.zeros(thin.shape)
            for batch in batches:
                w = np.frombuffer(b"".join(batch["w"]), np.int32).reshape(-1, WINDOW)
                for a in np.split(w, range(1024, len(w), 1024)):
                    # A term that comes twice in a passage has twice its weight; the length is that of the sum of equal terms.
                    times = (a[:, :, None] == a[:, None, :]).sum(axis=2)
                    scale = idf[a] / np.maximum(np.sqrt((idf[a] ** 2 * times).sum(axis=1, keepdims=True)), 1e-12)
                    y = np.einsum("ij,ijk->ik", scale, thin[a])
                    for j in range(WINDOW):
                        np.add.at(total, a[:, j], scale[:, j, None] * y)
            yield pd.DataFrame({"part": [total.tobytes()]})

        parts = rows.mapInPandas(product, "part binary").collect()
        thin = np.linalg.qr(sum(np.frombuffer(p[0]).reshape(thin.shape) for p in parts))[0]
    return thin


@dataclass(frozen=True)
class Gate:
    """The items' passages by keys: those of ``keys[i]`` are ``items[first[i]:first[i + 1]]``. A key is a term, or two neighbours as ``term * n_terms + next term``."""

    keys: np.ndarray
    first: np.ndarray
    items: np.ndarray
    begins: np.ndarray
    n_terms: int
    two: bool

    @classmethod
    def of(cls, pairs: np.ndarray, n_terms: int, two: bool = False) -> Gate:
        """From rows (key, passage)."""
        pairs = np.unique(pairs, axis=0) if len(pairs) else np.empty((0, 2), np.int64)
        keys, first = np.unique(pairs[:, 0], return_index=True)
        begins = np.zeros(n_terms, bool)
        begins[keys // n_terms if two else keys] = True
        return cls(keys, np.append(first, len(pairs)), pairs[:, 1], begins, n_terms, two)

    def hits(self, ids: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, passage) of all places of a text that lead to a passage."""
        at = np.flatnonzero(self.begins[ids] & allowed)
        if self.two:
            at = at[at + 1 < len(ids)]
            at = at[allowed[at + 1]]
        if not len(at) or not len(self.keys):
            return at[:0], self.items[:0]
        key = ids[at].astype(np.int64) * self.n_terms + ids[at + 1] if self.two else ids[at]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[k] == key
        at, k = at[known], k[known]
        count = self.first[k + 1] - self.first[k]
        ends = np.cumsum(count)
        flat = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[k] - (ends - count), count)
        return np.repeat(at, count), self.items[flat]


def run_gate(windows: np.ndarray, idf: np.ndarray, length: int) -> Gate:
    """Passages by the rarest term of every ``length`` words in a row and its neighbour in them: a text with such words has both, so none is missed."""
    two = length > 1
    found = []
    for s in range(WINDOW - length + 1):
        w = windows[:, s : s + length].astype(np.int64)
        full = (w > 0).all(axis=1)
        best = np.minimum(np.argmax(idf[w], axis=1), length - 1 - two)
        n = np.arange(len(w))
        key = w[n, best] * len(idf) + w[n, best + 1] if two else w[n, best]
        found.append(np.stack([key, n], axis=1)[full])
    return Gate.of(np.concatenate(found) if found else np.empty((0, 2), np.int64), len(idf), two)


def rare_gate(windows: np.ndarray, idf: np.ndarray, n: int = RARE_TERMS) -> Gate:
    """Passages by the ``n`` of their terms that stand in the fewest passages of the items; of equal ones by those rarer in the corpus."""
    held = np.bincount(np.unique(windows + np.arange(len(windows))[:, None] * len(idf)) % len(idf), minlength=len(idf))
    first, at = np.unique(windows, return_inverse=True)
    place = np.empty(len(first), np.int64)
    place[np.lexsort((first, -idf[first], held[first]))] = np.arange(len(first))
    rank = np.where(windows > 0, place[at.reshape(windows.shape)], len(first))
    terms = np.take_along_axis(windows, np.argsort(rank, axis=1, kind="stable")[:, :n], axis=1)
    pairs = np.stack([terms.ravel(), np.repeat(np.arange(len(windows)), terms.shape[1])], axis=1)
    return Gate.of(pairs[pairs[:, 0] > 0].astype(np.int64), len(idf))


def longest_runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of passages, the longest stretch of equal known words in a row, and where it starts in both."""
    n = np.arange(len(a))
    row, best = np.zeros((len(a), b.shape[1] + 1), np.int64), np.zeros(len(a), np.int64)
    ends = np.zeros((2, len(a)), np.int64)
    for i in range(a.shape[1]):
        hit = (a[:, i, None] == b) & (a[:, i, None] > 0)
        new = np.zeros_like(row)
        new[:, 1:] = (row[:, :-1] + 1) * hit
        row = new
        j = np.argmax(row, axis=1)
        more = row[n, j] > best
        best[more], ends[0, more], ends[1, more] = row[n, j][more], i + 1, j[more]
    return best, ends[0] - best, ends[1] - best


def widened(text: np.ndarray, item: np.ndarray, x: int, y: int) -> int:
    """Equal known words in a row around position ``x`` of a text and ``y`` of an item, in both directions, however far they go."""
    total = 0
    for a, b in ((text[x:], item[y:]), (text[:x][::-1], item[:y][::-1])):
        n = min(len(a), len(b))
        other = np.flatnonzero((a[:n] != b[:n]) | (a[:n] == 0))
        total += int(other[0]) if len(other) else n
    return total


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of passages, the length of the longest common subsequence of known words."""
    row = np.zeros((len(a), b.shape[1] + 1), np.int64)
    for i in range(a.shape[1]):
        hit = (a[:, i, None] == b) & (a[:, i, None] > 0)
        taken = row[:, :-1] + hit
        new = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(taken * hit, row[:, 1:]), axis=1, out=new[:, 1:])
        row = new
    return row[:, -1]


def common_anywhere(a: np.ndarray, b: np.ndarray, enough: int = ALIKE) -> np.ndarray:
    """For each pair of regions, the longest common subsequence of a stretch of ``WINDOW`` words each.

    The middles count first; only where they have less than ``enough`` are all other
    stretches tried, until one has. So whether there is enough does not depend on
    where in the texts the passages start.
    """
    same = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] > 0)
    bits = np.zeros((*a.shape, 8), np.uint8)
    bits[:, :, : b.shape[1] // 8] = np.packbits(same, axis=2, bitorder="little")
    equal = bits.view(np.uint64)[:, :, 0]  # for each word of a, a bit for each word of b

    def common(rows: np.ndarray, i: int, j: int, n_a: int, n_b: int) -> np.ndarray:
        """Common subsequences of ``n_a`` words from ``i`` on with ``n_b`` words from ``j`` on, bit by bit at once."""
        open_, inside = np.full(len(rows), ~np.uint64(0)), np.uint64((1 << n_b) - 1)
        for k in range(i, i + n_a):
            taken = open_ & (equal[rows, k] >> np.uint64(j)) & inside
            open_ = (open_ + taken) | (open_ & ~taken)
        return n_b - np.bitwise_count(open_ & inside).astype(np.int64)

    best = common(np.arange(len(a)), STRIDE, STRIDE, WINDOW, WINDOW)
    left = np.flatnonzero(best < enough)
    left = left[common(left, 0, 0, a.shape[1], b.shape[1]) >= enough]
    for i in range(a.shape[1] - WINDOW + 1):
        near = left[common(left, i, 0, WINDOW, b.shape[1]) >= enough]
        for j in range(b.shape[1] - WINDOW + 1):
            if not len(near):
                break
            best[near] = np.maximum(best[near], common(near, i, j, WINDOW, WINDOW))
            near = near[best[near] < enough]
        left = left[best[left] < enough]
        if not len(left):
            break
    return best


def holds(ids: np.ndarray, answer: np.ndarray) -> bool:
    """Whether a text has the words of an answer, next to each other; an empty answer is in none."""
    if not len(answer) or len(answer) > len(ids):
        return False
    at = np.flatnonzero(ids[: len(ids) - len(answer) + 1] == answer[0])
    for i in range(1, len(answer)):
        at = at[ids[at + i] == answer[i]]
    return len(at) > 0


@dataclass(frozen=True)
class Search:
    """What every task needs to search its texts."""

    ids: list[np.ndarray]
    answers: list[np.ndarray]
    windows: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    around: np.ndarray | None
    weighted: np.ndarray
    latent: np.ndarray
    n_terms: int
    runs: Gate
    rare: Gate | None
    min_words: int
    min_cosine: float
    min_cosine_paraphrase: float

    def near(self, pairs: list[tuple], limit: float) -> tuple[np.ndarray, ...]:
        """Text number, passage of the text, its words, passage of an item, cosine; of the pairs with at least ``limit``."""
        n, w, rows, p = map(np.concatenate, zip(*pairs))
        _, one, inverse = np.unique(n * (1 << 32) + w, return_index=True, return_inverse=True)
        mine = gathered(rows[one][:, -WINDOW - STRIDE : -STRIDE] if rows.shape[1] > WINDOW else rows[one], self.weighted)
        cosine = np.einsum("ij,ij->i", mine[inverse], self.latent[p])
        keep = cosine >= limit
        return n[keep], w[keep], rows[keep], p[keep], cosine[keep].astype(float)

    def verbatim(self, pairs: list[tuple], texts: dict[int, np.ndarray]) -> Iterator[tuple]:
        """Pairs by their cosine, then by words in the same order, then by words in a row."""
        n, w, rows, p, cosine = self.near(pairs, self.min_cosine)
        lcs = common_subsequence(rows, self.windows[p])
        some = lcs >= self.min_words
        n, w, rows, p, cosine, lcs = (x[some] for x in (n, w, rows, p, cosine, lcs))
        run, i, j = longest_runs(rows, self.windows[p])
        for k in np.flatnonzero(run >= self.min_words):
            item = int(self.owner[p[k]])
            yield int(n[k]), item, float(cosine[k]), widened(texts[int(n[k])], self.ids[item], int(w[k] * STRIDE + i[k]), int(self.at[p[k]] + j[k])), int(lcs[k])

    def alike(self, pairs: list[tuple], texts: dict[int, np.ndarray]) -> Iterator[tuple]:
        """Pairs by their cosine, then by the answer, then by words in the same order there or up to ``STRIDE`` words beside."""
        n, w, rows, p, cosine = self.near(pairs, self.min_cosine_paraphrase)
        asked = {x: holds(texts[x[0]], self.answers[x[1]]) for x in set(zip(n.tolist(), self.owner[p].tolist()))}
        has = np.array([asked[x] for x in zip(n.tolist(), self.owner[p].tolist())], bool)
        n, w, rows, p, cosine = (x[has] for x in (n, w, rows, p, cosine))
        lcs = common_anywhere(rows, self.around[p])
        enough = np.flatnonzero(lcs >= ALIKE)
        run = longest_runs(rows[enough][:, STRIDE : STRIDE + WINDOW], self.windows[p[enough]])[0]
        for k, r in zip(enough, run):
            yield int(n[k]), int(self.owner[p[k]]), float(cosine[k]), int(r), int(lcs[k])

    def candidates(self, ids: np.ndarray, paraphrase: bool) -> tuple[np.ndarray, np.ndarray]:
        """(passage of the text, passage of an item) that share a term of the gate, or for paraphrases several rare terms thereabouts."""
        known = (ids > 0) & (ids <= self.n_terms)
        n_passages, step = len(starts(len(ids))), len(self.windows) + 1
        if not paraphrase:
            x, p = self.runs.hits(ids, in_runs(known, self.min_words))
            w = np.concatenate([x // STRIDE, x // STRIDE - 1])
            keep = (w >= 0) & (w < n_passages)
            return np.divmod(np.unique(w[keep] * step + np.tile(p, 2)[keep]), step)
        x, p = self.rare.hits(ids, known)
        # Only passages with that many terms within a region stay; the text is in order, so they follow each other.
        order, more = np.argsort(p, kind="stable"), RARE_SHARED - 1
        x, p = x[order], p[order]
        close = (p[more:] == p[: len(p) - more]) & (x[more:] - x[: len(x) - more] < WINDOW + 2 * STRIDE)
        stay = np.zeros(len(x), bool)
        for d in range(RARE_SHARED):
            stay[d : d + len(close)] |= close
        x, p = x[stay], p[stay]
        # A term counts once for a passage of an item, however often it stands there.
        w = np.concatenate([x // STRIDE + d for d in (1, 0, -1, -2)])
        keep, width = (w >= 0) & (w < n_passages), self.rare.n_terms
        one = np.unique(((w * step + np.tile(p, 4)) * width + np.tile(ids[x], 4))[keep]) // width
        key, times = np.unique(one, return_counts=True)
        return np.divmod(key[times >= RARE_SHARED], step)

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = [(False, self.verbatim)] + ([(True, self.alike)] if self.rare is not None else [])
        for batch in batches:
            keys, texts, best = list(batch["k"]), {}, {}

            def note(found: Iterator[tuple]) -> None:
                for n, item, *values in found:
                    have = best.get((n, item), (0.0, 0, 0))
                    best[n, item] = tuple(map(max, have, values))

            held: list[list] = [[] for _ in searches]
            size = [0 for _ in searches]
            for n, raw in enumerate(batch["ids"]):
                ids = np.frombuffer(zlib.decompress(raw), np.int32)
                shown = np.where(ids <= self.n_terms, ids, 0)
                for s, (paraphrase, test) in enumerate(searches):
                    w, p = self.candidates(ids, paraphrase)
                    if not len(w):
                        continue
                    texts[n] = ids
                    if paraphrase:
                        padded = np.concatenate([np.zeros(STRIDE, np.int32), shown, np.zeros(WINDOW + STRIDE, np.int32)])
                    else:  # words that cannot belong to words in a row weigh nothing
                        padded = np.concatenate([np.where(in_runs(shown > 0, self.min_words), shown, 0), np.zeros(WINDOW, np.int32)])
                    for k in range(0, len(w), AT_ONCE):
                        rows = padded[w[k : k + AT_ONCE, None] * STRIDE + np.arange(WINDOW + 2 * STRIDE * paraphrase)]
                        held[s].append((np.full(len(rows), n), w[k : k + AT_ONCE], rows, p[k : k + AT_ONCE]))
                        size[s] += len(rows)
                        if size[s] >= AT_ONCE:
                            note(test(held[s], texts))
                            held[s], size[s] = [], 0
            for s, (_, test) in enumerate(searches):
                if held[s]:
                    note(test(held[s], texts))
            rows = []
            for (n, item), (cosine, run, lcs) in sorted(best.items()):
                answered = holds(texts[n], self.answers[item])
                if run >= self.min_words or (lcs >= ALIKE and answered and self.rare is not None):
                    rows.append((keys[n], item, cosine, run, lcs, answered))
            yield pd.DataFrame(rows, columns=["k", "item", "cosine", "run", "lcs", "answered"])


def find_leaks(
    corpus: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    passage: str = "passage",
    answer: str = "answer",
    min_words: int = STRIDE,
    min_cosine: float | None = None,
    rank: int = RANK,
    paraphrase: bool = False,
) -> DataFrame:
    """Documents that contain passages of items: key, item_key, cosine, longest_run, common_words, answered.

    A pair is found if the text has at least ``min_words`` (12 at most) words in a
    row of the item's passage; with ``paraphrase`` also if 16 of 24 words follow each
    other in the same order, wherever the 24 words start in either, and the text has
    the item's answer. ``longest_run`` is counted over passages' borders for
    words in a row, ``common_words`` within a passage of 24. ``answered`` tells
    whether the text has the item's answer.

    The corpus is cut into words once and stays where it is. Items, their terms and
    the latent space are broadcast, in blocks of about ``WORDS_PER_BLOCK`` words, in
    the order of their keys; more are searched in further passes. A passage of the
    corpus is held against passages of items that share the rarest term of
    12 words in a row, and its neighbour, with it (none with such words is missed), for paraphrases at
    least ``RARE_SHARED`` of their ``RARE_TERMS`` rarest terms within its 48 words (the
    README gives the share of paraphrases that this finds).
    Of those the cosine in the latent space has to reach ``min_cosine`` (-2 lets all
    pass, so that words in a row are found without exception; for these, words
    outside runs of ``min_words`` terms of the items weigh nothing); then the longest
    common subsequence, words in a row and the answer decide. Nothing is shuffled
    but one count for each term. Null and empty texts and passages match nothing,
    passages shorter than ``min_words`` match nothing; texts of any length are read
    whole; rows that repeat come out for each repetition; an empty table on either
    side gives no row; other columns are not read. Items with equal passages are all
    reported.
    """
    if not 1 <= min_words <= STRIDE:
        raise ValueError(f"min_words must be from 1 to {STRIDE}")
    spark = corpus.sparkSession
    cosine = min_cosine if min_cosine is not None else MIN_COSINE
    loose = min_cosine if min_cosine is not None else MIN_COSINE_PARAPHRASE
    docs = corpus.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where(F.length("t") > 0)
    kind, item_kind = corpus.schema[key].dataType, items.schema[item_key].dataType.simpleString()
    wanted = items.select(F.col(item_key), F.col(passage), F.col(answer)).where(F.col(passage).isNotNull()).orderBy(item_key, passage, answer)
    result, held = None, 0
    rows: list = []

    def search(rows: list) -> DataFrame:
        block = read_items(rows)
        windows, owner, at = block.windows
        numbered = cut_lineage(numbered_texts(docs, block.terms))
        idf = term_weights(numbered, block)
        space = latent_space(spark, windows, idf[: block.n_terms + 1], rank)
        weighted = np.zeros((len(idf), space.shape[1]), np.float32)
        weighted[: len(space)] = space * idf[: len(space), None]
        around = np.concatenate([regions(i) for i in block.ids]) if paraphrase and len(windows) else None
        rare = rare_gate(windows, idf) if around is not None else None
        task = Search(block.ids, block.answers, windows, owner, at, around, weighted, gathered(windows, weighted), block.n_terms, run_gate(windows, idf, min_words), rare, min_words, cosine, loose)
        shared = spark.sparkContext.broadcast(task)
        keys = spark.createDataFrame([(i, k) for i, k in enumerate(block.keys)], f"item long, `{item_key}` {item_kind}")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from shared.value(batches)

        hits = numbered.where(F.col("term").isNull()).select("k", "ids").mapInPandas(run, "k string, item long, cosine double, run long, lcs long, answered boolean")
        return hits.join(F.broadcast(keys), "item").select(F.col("k").cast(kind).alias(key), item_key, "cosine", F.col("run").alias("longest_run"), F.col("lcs").alias("common_words"), "answered")

    for r in wanted.toLocalIterator():
        rows.append(r)
        held += len(words(r[1]))
        if held >= WORDS_PER_BLOCK:
            found = search(rows)
            result = found if result is None else result.unionByName(found)
            rows, held = [], 0
    if rows or result is None:
        found = search(rows)
        result = found if result is None else result.unionByName(found)
    return result
