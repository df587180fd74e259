"""Evaluation items leaking into documents, by latent semantic retrieval.

Documents are read as passages of 2 * RUN words, one every RUN words, so that every run of RUN words lies whole in a
passage.  Passages and probes (windows of RUN words of the items, one every PROBE_STEP words) become TF-IDF vectors over
the words of the items (other words cannot leak); the frequencies of words cover all passages.  A randomised SVD gives
the latent space: tasks sum A'(A x) over their passages for a block of random directions x, the sums are added by word in
the cluster, and only the (words of the items) x RANK matrix comes to the driver.

Candidates are found in the latent space only, and nothing is taken from a sample.  A leaked run is a window of the
document: every window of as many words as a run has gets its latent vector, made as those of the runs of the items are
made, so that equal words have equal vectors.  The runs are kept in lists (spherical k-means of all runs); a window visits
the lists whose centre is, up to SAME, nearest to it, and is a candidate for the items of the runs whose cosine is 1 up to
SAME.  No leak is lost by that, whatever stands around it.  The exact check of runs of words looks at candidates only.

For paraphrases passages are candidates for the items of the probes they have a cosine of PARAPHRASE_COSINE to; lists are
passed over only if by their radius they hold no such probe.  The longest common subsequence with the words of the
item's question looks at these only.

The items are a stated query set.  They are taken in blocks of at most ITEM_BLOCK items, VOCABULARY different words and
BLOCK_WORDS words, so what is broadcast is bounded; the documents are tokenised and stored once for all of a block.  Null and empty texts and items
without words leak nothing.  Rows repeated under one id count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.session import materialize, once_per_id

RUN = 13
RANK, SHARP = 192, 1.5  # rare words weigh more, as they tell items apart
PROBE_STEP = 3
CALIBRATION, MISSED = 20_000, 0.0002
ITEM_BLOCK, VOCABULARY, BLOCK_WORDS = 20_000, 200_000, 250_000
SAME = 1e-4  # far above what rounding makes of equal vectors
SLICE, TASK_WORDS, COMMON = 40_000, 400_000, 256
PARAPHRASE_COSINE, PARAPHRASE_LCS, ANSWERED_LCS = 0.55, 0.6, 0.4
_WORD = re.compile(r"[^\W_]+")
SEED = 20240501


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


def _rolling(ids: np.ndarray) -> np.ndarray:
    """A hash of every row of word numbers."""
    h = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        h = h * np.uint64(0x9E3779B97F4A7C15) + (ids[:, j] + 2).astype(np.uint64)
    return h


def _with_item(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + item.astype(np.uint64) * np.uint64(0x94D049BB133111EB)


class Items:
    """A block of items as word numbers: vocabulary, probes and the runs that count as leaked.

    Numbers below `size` are words of items; above are words of questions only."""

    def __init__(self, rows: list[tuple[int, str, str]], run: int = RUN, step: int = PROBE_STEP):
        self.ids, self.words, self.query, self.probes, self.run = [], [], [], [], run
        self.vocab: dict[str, int] = {}
        number = lambda w: [self.vocab.setdefault(x, len(self.vocab)) for x in w]
        questions = []
        for item, text, query in rows:
            w = number(words(text))
            if not w:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.words.append(w)
            questions.append(words(query))
            last = len(w) - min(run, len(w))
            self.probes += [(k, w[a : a + run]) for a in sorted({*range(0, last + 1, step), last})]
        self.size = len(self.vocab)
        self.query = [set(number(q)) for q in questions]
        self.lengths = np.array([min(run, len(w)) for w in self.words])
        # the runs of each item, by length, as sorted keys of (run, item)
        self.runs: dict[int, np.ndarray] = {}
        for n in set(self.lengths.tolist()):
            rows_, owner = [], []
            for k in np.flatnonzero(self.lengths == n):
                w = self.words[k]
                rows_ += [w[a : a + n] for a in range(len(w) - n + 1)]
                owner += [k] * (len(w) - n + 1)
            self.runs[n] = np.unique(_with_item(_rolling(np.array(rows_, np.int64)), np.array(owner)))

    def holds(self, k: int, part: list[int]) -> bool:
        """Word by word: whether the item has the run."""
        w, n = self.words[k], len(part)
        return any(w[a : a + n] == part for a in range(len(w) - n + 1) if w[a] == part[0])


def _encode(vocab: dict[str, int]):
    """Texts as word numbers, -1 for other words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = [[vocab.get(x, -1) for x in words(t)] for t in pdf["text"]]
            yield pd.DataFrame({"doc": pdf["doc"], "ids": ids})

    return run


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(rows' ids, word numbers) of some documents, of about TASK_WORDS words at a time."""
    for pdf in batches:
        doc = pdf["doc"].to_numpy() if "doc" in pdf else np.zeros(len(pdf), np.int64)
        docs, lo, n = [], 0, 0
        for i, ids in enumerate(pdf["ids"]):
            docs.append(np.asarray(ids, np.int32))
            n += len(ids)
            if n >= TASK_WORDS or i + 1 == len(pdf):
                yield doc[lo : i + 1], docs
                docs, lo, n = [], i + 1, 0


class Passages:
    """Passages of some documents: segments of `run` words, a passage is a segment and the next one of the document.

    Only passages with `least` known words or more count.  `at`, `to` are places in `flat`, `doc` is the number of the document."""

    def __init__(self, docs: list[np.ndarray], size: int, run: int, least: int = 1):
        sizes = np.array([len(x) for x in docs], np.int64)
        self.flat = np.concatenate(docs) if len(docs) else np.empty(0, np.int32)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))
        segs = -(-sizes // run)
        seg_doc = np.repeat(np.arange(len(docs)), segs)
        first_seg = np.concatenate(([0], np.cumsum(segs)))
        inner = np.arange(len(seg_doc)) - np.repeat(first_seg[:-1], segs)
        start = self.begin[seg_doc] + inner * run
        end = np.minimum(start + run, self.begin[seg_doc + 1])
        good = (self.flat >= 0) & (self.flat < size)
        count = np.concatenate(([0], np.cumsum(good)))
        self.known = self.flat[good]
        self.seg_from, self.seg_to = count[start], count[end]
        many = segs[seg_doc]
        a = np.flatnonzero((inner < np.maximum(many - 1, 1)))
        b = np.where(many[a] > 1, a + 1, len(seg_doc))  # len(seg_doc): no second segment
        ends = np.append(self.seg_to, 0)  # the segments of a document follow each other
        has = np.maximum(ends[b], self.seg_to[a]) - self.seg_from[a] >= least
        self.a, self.b = a[has], b[has]
        self.n_segs = len(seg_doc)
        self.doc = seg_doc[self.a]
        self.at = start[self.a]
        self.to = np.where(self.b < self.n_segs, np.append(end, 0)[self.b], end[self.a])

    def __len__(self) -> int:
        return len(self.a)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum of table rows over the known words of every passage."""
        out = np.zeros((self.n_segs + 1, *table.shape[1:]), table.dtype)
        table = np.concatenate([table, np.zeros((1, *table.shape[1:]), table.dtype)])
        n = self.seg_to - self.seg_from
        known = np.append(self.known, len(table) - 1)
        for lo in range(0, self.n_segs, 512):  # some segments at a time, a word of each after the other
            hi = min(lo + 512, self.n_segs)
            for j in range(int(n[lo:hi].max(initial=0))):
                at = np.where(n[lo:hi] > j, self.seg_from[lo:hi] + j, len(self.known))
                out[lo:hi] += table[known[at]]
        return out[self.a] + out[self.b]

    def spread(self, values: np.ndarray, acc: np.ndarray, weight: np.ndarray) -> None:
        """Add each passage's row, times the word's weight, to the rows of its known words."""
        z = np.zeros((self.n_segs + 1, values.shape[1]), np.float32)
        z[self.a] += values
        np.add.at(z, self.b, values)
        # the commonest words, which are most of all, by products of small dense blocks; the others in order of the word
        size = len(weight)
        top = np.argsort(-np.bincount(self.known, minlength=size), kind="stable")[:COMMON]
        place = np.full(size, len(top))
        place[top] = np.arange(len(top))
        n = self.seg_to - self.seg_from
        sums = np.zeros((len(top), values.shape[1]), np.float64)
        for lo in range(0, self.n_segs, 2048):
            hi = min(lo + 2048, self.n_segs)
            w = place[self.known[self.seg_from[lo] : self.seg_to[hi - 1]]]
            counts = np.bincount(np.repeat(np.arange(hi - lo), n[lo:hi]) * (len(top) + 1) + w, minlength=(hi - lo) * (len(top) + 1))
            sums += counts.reshape(hi - lo, -1)[:, :-1].T.astype(np.float32) @ z[lo:hi]
        acc[top] += sums * weight[top, None]
        rest = np.flatnonzero(place[self.known] == len(top))
        seg = np.repeat(np.arange(self.n_segs), n)[rest]
        word = self.known[rest]
        for lo in range(0, len(rest), SLICE):
            w = word[lo : lo + SLICE]
            order = np.argsort(w, kind="stable")
            f = w[order]
            cuts = np.flatnonzero(np.diff(f, prepend=-1))
            acc[f[cuts]] += np.add.reduceat(z[seg[lo : lo + SLICE][order]], cuts, axis=0) * weight[f[cuts], None]


def _frequencies(size: int, run: int):
    """How often each word stands in the segments; at `size` the number of segments."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size + 1, np.int64)
        for _, docs in _parts(batches):
            p = Passages(docs, size, run)
            n[:-1] += np.bincount(p.known, minlength=size)
            n[-1] += p.n_segs
        keep = np.flatnonzero(n)
        yield pd.DataFrame({"w": keep.astype(np.int32), "n": n[keep]})

    return count


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _product(idf: np.ndarray, start: np.ndarray, run: int):
    """Rows of A'(A start) over a task's passages; a passage's TF-IDF vector is scaled by the length of its words."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = idf.astype(np.float32)
        table = np.concatenate([start * idf[:, None], (idf**2)[:, None]], axis=1).astype(np.float32)
        acc = np.zeros((len(start), start.shape[1]), np.float64)
        for _, docs in _parts(batches):
            p = Passages(docs, len(start), run)
            if len(p):
                s = p.sums(table)
                p.spread(s[:, :-1] / np.maximum(s[:, -1:], 1e-12), acc, weight)
        keep = np.flatnonzero(acc.any(axis=1))
        if len(keep):
            yield pd.DataFrame({"w": keep.astype(np.int32), "v": list(acc[keep])})

    return go


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"w": pdf["w"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})


class LatentSpace:
    def __init__(self, idf: np.ndarray, basis: np.ndarray):
        self.table = (basis * idf[:, None]).astype(np.float32)

    def of(self, parts: list[list[int]]) -> np.ndarray:
        """Unit vectors of lists of known words."""
        return _unit(np.stack([self.table[w].sum(0) for w in parts])) if parts else np.empty((0, self.table.shape[1]), np.float32)

    def windows(self, flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Unit vectors of n known words from each place on; equal words have equal vectors, also where they add up to nothing."""
        x = np.zeros((len(at), self.table.shape[1]), np.float32)
        for j in range(n):
            x += self.table[flat[at + j]]
        x /= np.maximum(np.abs(x).max(1, keepdims=True), 1e-30)
        x[~x.any(1), 0] = 1
        return _unit(x)


def latent_space(docs: DataFrame, size: int, rank: int = RANK, run: int = RUN, rounds: int = 1) -> LatentSpace:
    """Randomised SVD of the passages' TF-IDF matrix: orthonormal basis of its leading right singular space."""
    counted = docs.select("ids").mapInPandas(_frequencies(size, run), "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(size), 1
    for w, n in counted:
        if w == size:
            total = n
        else:
            df[w] = n
    idf = np.log1p(total / (1 + df)) ** SHARP + 0.05
    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, rank)))[0]
    for _ in range(rounds):
        rows = docs.select("ids").mapInPandas(_product(idf, q, run), "w int, v array<double>").groupBy("w").applyInPandas(_sum_rows, "w int, v array<double>").collect()
        b = np.zeros_like(q)
        for w, v in rows:
            b[w] = v
        # directions that no passage has stay random, so that their words are not lost
        q = np.linalg.qr(b + 1e-9 * np.random.default_rng(SEED + 1).standard_normal(b.shape))[0]
    return LatentSpace(idf, q)


def _lists(vectors: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centres, about the square root of the vectors; the centre of each vector)."""
    c = vectors[rng.choice(len(vectors), max(1, round(len(vectors) ** 0.5)), replace=False)]
    for _ in range(6):
        at = (vectors @ c.T).argmax(1)
        m = np.zeros_like(c)
        np.add.at(m, at, vectors)
        c = np.where(m.any(1, keepdims=True), _unit(m), c)
    return c, (vectors @ c.T).argmax(1)


class Windows:
    """The windows of `n` known words of some documents, as passages are."""

    def __init__(self, docs: list[np.ndarray], size: int, n: int):
        sizes = np.array([len(x) for x in docs], np.int64)
        self.flat = np.concatenate(docs) if len(docs) else np.empty(0, np.int32)
        end = np.repeat(np.cumsum(sizes), sizes)
        known = np.concatenate(([0], np.cumsum((self.flat >= 0) & (self.flat < size))))
        at = np.arange(max(0, len(self.flat) - n + 1))
        self.at = at[(at + n <= end[at]) & (known[at + n] - known[at] == n)]
        self.to = self.at + n
        self.doc = np.repeat(np.arange(len(docs)), sizes)[self.at]


class RunIndex:
    """The runs of the items by length, in lists."""

    def __init__(self, items: Items, space: LatentSpace):
        self.space, self.size = space, items.size
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]] = {}
        for n in sorted(set(items.lengths.tolist())):
            own = np.flatnonzero(items.lengths == n)
            flat = np.concatenate([np.array(items.words[k], np.int64) for k in own])
            sizes = np.array([len(items.words[k]) for k in own])
            at = np.concatenate([np.arange(m - n + 1) + b for m, b in zip(sizes, np.cumsum(sizes) - sizes)])
            owner = np.repeat(own, sizes - n + 1)
            v = space.windows(flat, at, n)
            c, near = _lists(v, np.random.default_rng(SEED + 3))
            self.of[n] = v, owner, c, [np.flatnonzero(near == j) for j in range(len(c))]

    def candidates(self, w: Windows, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of w, items) of the windows of n words: each pair once."""
        vectors, owner, centres, lists = self.of[n]
        rows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(w.at), 8192):
            x = self.space.windows(w.flat, w.at[lo : lo + 8192], n)
            s = x @ centres.T
            close, of = np.nonzero(s >= s.max(1, keepdims=True) - SAME)
            order = np.argsort(of, kind="stable")
            close, of = close[order], of[order]
            cuts = np.searchsorted(of, np.arange(len(lists) + 1))
            for j, members in enumerate(lists):
                i = close[cuts[j] : cuts[j + 1]]
                for a in range(0, len(members), 4096) if len(i) else ():
                    m = members[a : a + 4096]
                    r, p = np.nonzero(x[i] @ vectors[m].T >= 1 - SAME)
                    rows.append(i[r] + lo)
                    items.append(owner[m[p]])
        both = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return both[0], both[1]


class ProbeIndex:
    """The probes of the items in lists.

    Without `background` the cosine is PARAPHRASE_COSINE and no probe of that cosine is passed over.  With it (to measure how
    well passages tell leaks) both thresholds are calibrated on leaks written over the background."""

    def __init__(self, items: Items, space: LatentSpace, background: list[np.ndarray] | None = None):
        self.vectors = space.of([w for _, w in items.probes])
        self.owner = np.array([k for k, _ in items.probes])
        rng = np.random.default_rng(SEED + 2)
        self.centres, at = _lists(self.vectors, rng)
        self.lists = [np.flatnonzero(at == j) for j in range(len(self.centres))]
        if background is not None:
            self.cosine, self.near = self._calibrate(items, space, background, at, rng)
        else:
            least = np.array([(self.vectors[m] @ c).min(initial=1) for m, c in zip(self.lists, self.centres)])
            radius = np.arccos(np.clip(least - SAME, -1, 1))
            self.cosine, self.near = PARAPHRASE_COSINE, np.cos(np.minimum(np.arccos(PARAPHRASE_COSINE) + radius, np.pi)) - SAME

    def _calibrate(self, items: Items, space: LatentSpace, background: list[np.ndarray], at: np.ndarray, rng) -> tuple[float, float]:
        first = np.searchsorted(self.owner, np.arange(len(items.words) + 1))
        cosines, nears = [], []
        made, owner = [], rng.integers(0, len(items.words), CALIBRATION)
        for k in owner:
            w = items.words[k]
            n = items.lengths[k]
            a = rng.integers(0, len(w) - n + 1)
            part = w[a : a + n]
            if background:
                b = background[rng.integers(0, len(background))]
                b = b[(o := rng.integers(0, max(1, len(b) - 2 * items.run + 1))) : o + 2 * items.run]
                o = rng.integers(0, max(1, len(b) - n + 1))
                part = [*part, *(int(x) for x in np.concatenate([b[:o], b[o + n :]]) if 0 <= x < items.size)]
            made.append(part)
        x = space.of(made)
        for k, v in zip(owner, x):
            c = self.vectors[first[k] : first[k + 1]] @ v
            best = int(c.argmax())
            cosines.append(c[best])
            nears.append(self.centres[at[first[k] + best]] @ v)
        return float(np.quantile(cosines, MISSED / 2)) - 1e-4, float(np.quantile(nears, MISSED / 2)) - 1e-4

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of x, items, cosines): each pair once, with its greatest cosine."""
        rows, items, cos = [], [], []
        for lo in range(0, len(x), 8192):
            part = x[lo : lo + 8192]
            close = part @ self.centres.T >= self.near
            for j, members in enumerate(self.lists):
                i = np.flatnonzero(close[:, j])
                for at in range(0, len(members), 4096) if len(i) else ():
                    m = members[at : at + 4096]
                    s = part[i] @ self.vectors[m].T
                    a, b = np.nonzero(s >= self.cosine)
                    rows.append(i[a] + lo)
                    items.append(self.owner[m[b]])
                    cos.append(s[a, b])
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        r, k, c = np.concatenate(rows), np.concatenate(items), np.concatenate(cos)
        order = np.lexsort((-c, k, r))
        r, k, c = r[order], k[order], c[order]
        one = np.ones(len(r), bool)
        one[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
        return r[one], k[one], c[one]


def _lcs(masks: dict[int, int], size: int, part: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel; masks has the places of each word of the first text."""
    full = (1 << size) - 1
    v = full
    for x in part:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs_length(a: list[int], b: list[int]) -> int:
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    return _lcs(masks, len(a), b)


_SCHEMA = "doc_id bigint, item_id bigint, verbatim boolean, cosine double, lcs double, answers double"


def _verbatim(items: Items, p: Passages | Windows, row: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether the passage of each candidate holds a whole run of its item."""
    hit = np.zeros(len(row), bool)
    for n, keys in items.runs.items():
        c = np.flatnonzero(items.lengths[item] == n)
        places = p.to[row[c]] - p.at[row[c]] - n + 1
        c, places = c[places > 0], places[places > 0]
        for lo in range(0, len(c), 20_000):
            i, m = c[lo : lo + 20_000], places[lo : lo + 20_000]
            at = np.arange(m.sum()) + np.repeat(p.at[row[i]] - (np.cumsum(m) - m), m)
            of = np.repeat(i, m)
            h = _with_item(_rolling(p.flat[at[:, None] + np.arange(n)].astype(np.int64)), item[of])
            for j in np.flatnonzero(np.isin(h, keys)):
                if not hit[of[j]] and items.holds(int(item[of[j]]), p.flat[at[j] : at[j] + n].tolist()):
                    hit[of[j]] = True
    return hit


def _search(items: Items, space: LatentSpace, runs: RunIndex, index: ProbeIndex | None):
    # a passage with fewer words of the items than a paraphrase needs cannot hold one
    least = max(1, int(min(map(len, items.words)) * ANSWERED_LCS / 3))  # of the three passages around

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks: dict[int, dict[int, int]] = {}
        for ids, docs in _parts(batches):
            out: dict[tuple[int, int], tuple] = {}
            for n in runs.of:
                w = Windows(docs, items.size, n)
                row, item = runs.candidates(w, n)
                exact = _verbatim(items, w, row, item)
                for d, k in zip(w.doc[row[exact]].tolist(), item[exact].tolist()):
                    out[(d, k)] = (True, 1.0, 1.0, 1.0)
            p = Passages(docs, items.size, items.run, least) if index else ()
            row, item, cos = index.candidates(_unit(p.sums(space.table))) if len(p) else (np.empty(0, np.int64),) * 3
            for i in np.flatnonzero(cos >= PARAPHRASE_COSINE).tolist():
                d, k = int(p.doc[row[i]]), int(item[i])
                was = out.get((d, k))
                if was and was[0]:
                    continue
                text, q = items.words[k], items.query[k]
                if k not in masks:
                    masks[k] = {x: sum(1 << j for j, y in enumerate(text) if y == x) for x in set(text)}
                a, z = int(p.at[row[i]]), int(p.to[row[i]])
                around = p.flat[max(p.begin[d], a - len(text)) : min(p.begin[d + 1], z + len(text))].tolist()
                common = _lcs(masks[k], len(text), around) / len(text)
                answers = len(q & set(around)) / len(q) if q else 0.0
                if (common >= PARAPHRASE_LCS or (common >= ANSWERED_LCS and answers == 1.0)) and (not was or common > was[2]):
                    out[(d, k)] = (False, float(cos[i]), common, answers)
            rows = [(int(ids[d]), items.ids[k], *v) for (d, k), v in out.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "verbatim", "cosine", "lcs", "answers"])

    return go


def item_blocks(items: DataFrame, run: int = RUN) -> Iterator[Items]:
    """The items in order, so many at a time as stay below ITEM_BLOCK and, from the first on, VOCABULARY words."""
    last, rest, more = None, [], True
    while more or rest:
        if more:
            block = (items if last is None else items.filter(F.col("item_id") > last)).orderBy("item_id").limit(ITEM_BLOCK - len(rest)).collect()
            more = len(block) == ITEM_BLOCK - len(rest)
            rest += [tuple(r) for r in block]
            last = rest[-1][0] if rest else None
        seen: set[str] = set()
        take = many = 0
        for _, text, query in rest:
            own = words(text)
            seen.update(own, words(query))
            many += len(own)
            if take and (len(seen) > VOCABULARY or many > BLOCK_WORDS):
                break
            take += 1
        yield Items(rest[:take], run)
        rest = rest[take:]


def leaked_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, paraphrases: bool = False) -> DataFrame:
    """doc_id, item_id, verbatim, cosine, lcs, answers: one row per document and leaked item.

    Paraphrases have PARAPHRASE_LCS of the item's words in order around the passage, or ANSWERED_LCS of them with all
    words of the item's question."""
    spark = docs.sparkSession
    d = once_per_id(docs.filter(F.col(text) != ""), key, text).select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    query = F.col("query") if "query" in items.columns else F.lit("")
    q = once_per_id(items.filter(F.col("text") != "").select("item_id", "text", query.alias("query")), "item_id", "text", "query")
    out = None
    for part in item_blocks(q, run):
        if not part.probes:
            continue
        coded = materialize(d.mapInPandas(_encode(part.vocab), "doc bigint, ids array<int>"))  # read three times
        space = latent_space(coded, part.size, run=run)
        index = ProbeIndex(part, space) if paraphrases else None
        found = coded.mapInPandas(_search(part, space, RunIndex(part, space), index), _SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)
