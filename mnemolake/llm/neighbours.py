"""The most similar vectors of every vector, by a hash-prefix forest.

A vector's hash string begins with learned symbols and goes on with bits.  The learned symbols are two levels of spherical
k-means (at most BRANCH symbols each, about CELL_MEAN vectors per leaf), fitted on a sample of at most SAMPLE vectors
chosen by hash; every row is indexed.  A vector is entered under the leaves it
is most similar to, so neighbours on either side of a border meet: ENTRIES up to ONE_LEVEL leaves, and more with the
logarithm of the leaves (MOST_ENTRIES at most), as borders grow with them.  An entry is bits only.  The bits are signs of
random projections of what the leaf's centre leaves over.

A part is the shortest prefix that holds at most PART_ROWS entries: leaves above that are descended bit by bit, by counts
made in the cluster, so the same rule holds at any size and for a leaf with a third of all rows.  (Entries that agree in
all DEPTH bits, that is vectors almost equal, are dealt by hash.)  In a part, TREES trees are built: each is the sorted
array of the strings of its entries.  For a row the descent to its longest prefix match is its place in each array; all
trees then ascend synchronously, one bit at a time, until the rows that share the prefix of that length in any tree are
WANTED (in large parts one SHAREth of the part) or more.  These candidates are ordered by the Hamming distance of their
strings and, of the nearest COMPARED, the cosine is estimated from it.  The nearest COMPARED of each row over all its parts are compared exactly, as far as their estimated
cosine is not MARGIN behind the k-th.  For that each vector travels to its home, the part of its first entry, and to the homes of the rows it
is compared with.

The only loss is of pairs that no tree brings together; recall against brute force is tested and stated in the README.

Vectors travel packed without loss (as scaled integers where they are decimal, by a table of their distinct values, or
as they are) and compressed.

Equal vectors are handled exactly before the forest: rows with equal vectors form a class, the forest sees one row per
class, and of a class only the first k + 1 ids can be among the k best of anyone (ties go to the smaller id).

Vectors that are null, not of the dimension, not finite, have nulls, or are all zero take no part.  Rows repeated under
one id count once.  Empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.session import bucketed, materialize, partitions

SAMPLE, BRANCH, CELL_MEAN, PER_LEAF = 65_536, 1024, 500, 8
ONE_LEVEL, FIRST = 128, 60
ENTRIES, MOST_ENTRIES, MORE, PROBES = 3, 12, 1.93, 6
PART_ROWS, STEP, DEPTH = 20_000, 4, 60
TREES, BITS, WANTED, SHARE, COMPARED = 48, 16, 600, 8, 24
SKETCH = 8  # words of 64 bits
MARGIN = 0.2  # of estimated cosine, more than three standard deviations of what TREES * BITS bits tell
SEED = 7


def projection(dim: int, columns: int = TREES * BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, columns)).astype(np.float32)


def hash_strings(x: np.ndarray, proj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((rows, trees) strings of BITS bits, (SKETCH, rows) words of 64 of the bits); a bit says which half of the part a row is in."""
    trees = proj.shape[1] // BITS
    y = x.astype(np.float32) @ proj
    y -= np.median(y, axis=0)
    bits = np.packbits(y.reshape(len(x), trees, BITS) > 0, axis=2)
    strings = bits.view(">u2").reshape(len(x), trees).astype(np.uint16)
    words = np.ascontiguousarray(bits.reshape(len(x), -1)[:, : 8 * SKETCH]).view(np.uint64)
    return strings, np.ascontiguousarray(words.T)


def centroids(x: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        order = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
        m = np.zeros_like(c)
        m[at[order][cuts]] = np.add.reduceat(x[order], cuts, axis=0)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        c = np.where(n > 0, m / np.maximum(n, 1e-12), c)
    return c.astype(np.float32)


class Codebook:
    """Up to two levels of learned symbols; a leaf is first * BRANCH + second symbol.  At most SAMPLE / PER_LEAF leaves.

    Second symbols are learned from what the first leaves over and have an equal share of it: a mean of many rows would
    otherwise be near to all rows and its leaf without bound."""

    def __init__(self, x: np.ndarray, rows: int):
        leaves = max(1, min(rows // CELL_MEAN, len(x) // PER_LEAF, SAMPLE // PER_LEAF))
        first = 1 if leaves <= 2 else min(FIRST, int(np.ceil(np.sqrt(leaves)))) if leaves > ONE_LEVEL else leaves
        self.entries = int(np.clip(round(ENTRIES + MORE * np.log(leaves / ONE_LEVEL)), ENTRIES, MOST_ENTRIES))
        self.first = centroids(x, first, SEED)
        at = (x @ self.first.T).argmax(1)
        self.second: list[np.ndarray] = []
        for i, c in enumerate(self.first):
            own = x[at == i]
            many = min(BRANCH, round(leaves * len(own) / len(x))) if leaves > ONE_LEVEL else 1
            if many > 1 and len(own) > many:
                r = _left_over(own, c)
                r = centroids(r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12), many, SEED + 1 + i)
                r = _left_over(r, c)
                r = c + r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
                self.second.append((r / np.linalg.norm(r, axis=1, keepdims=True)).astype(np.float32))
            else:
                self.second.append(c[None])
        self.begin = np.cumsum([0, *map(len, self.second)])[:-1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, entries): the most similar leaves among those below the PROBES most similar first symbols; -1 for none."""
        sim = x @ self.first.T
        near = np.argsort(-sim, axis=1)[:, :PROBES]
        value = np.full((len(x), near.shape[1] * self.entries), -np.inf, np.float32)
        name = np.full(value.shape, -1, np.int32)
        for i, c in enumerate(self.second):
            rows, place = np.nonzero(near == i)
            if not len(rows):
                continue
            s = x[rows] @ c.T
            best = np.argsort(-s, axis=1)[:, : self.entries]
            at = place[:, None] * self.entries + np.arange(best.shape[1])
            value[rows[:, None], at] = np.take_along_axis(s, best, 1)
            name[rows[:, None], at] = i * BRANCH + best
        return np.take_along_axis(name, np.argsort(-value, axis=1, kind="stable")[:, : self.entries], 1)

    def centre(self, leaf: int) -> np.ndarray:
        return self.second[leaf // BRANCH][leaf % BRANCH]


def pack(v: np.ndarray) -> bytes:
    """A float32 vector without loss, compressed."""
    import zstandard

    raw = None
    for k, scale in enumerate((1.0, 10.0, 100.0, 1e3, 1e4)):
        with np.errstate(all="ignore"):
            q = np.rint(v.astype(np.float64) * scale)
            if np.abs(q).max(initial=0) < 32000 and ((q / scale).astype(np.float32) == v).all():
                z = np.where(q < 0, -2 * q - 1, 2 * q).astype("<u2")  # small numbers whatever the sign
                raw = bytes([2, k]) + z.view(np.uint8).reshape(-1, 2).T.tobytes()
                break
    if raw is None:
        values, codes = np.unique(v, return_inverse=True)
        if len(values) > 256:
            raw = b"\x00" + v.astype("<f4").tobytes()
        else:
            raw = b"\x01" + bytes([len(values) - 1]) + values.astype("<f4").tobytes() + codes.astype(np.uint8).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b)
    if raw[0] == 2:
        z = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=2).reshape(2, -1).T).view("<u2").ravel().astype(np.int32)
        q = np.where(z & 1, -(z + 1) // 2, z // 2)
        return (q / 10.0 ** raw[1]).astype(np.float32)
    if raw[0] == 0:
        return np.frombuffer(raw, "<f4", offset=1)
    n = raw[1] + 1
    return np.frombuffer(raw, "<f4", n, 2)[np.frombuffer(raw, np.uint8, offset=2 + 4 * n)]


def _units(vecs) -> np.ndarray:
    x = np.stack([unpack(b) for b in vecs]).astype(np.float32)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 500):
            part = pdf.iloc[lo : lo + 500]
            yield pd.DataFrame({"h": part["h"], "vec": [pack(np.asarray(v, np.float32)) for v in part["v"]]})


def _left_over(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return x - np.outer(x @ c, c)


def _prefix_bits(x: np.ndarray, c: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """DEPTH bits of every row, first bit highest."""
    return ((_left_over(x, c) @ deep > 0) @ (1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def _entries(book: Codebook, splits: dict[int, set[tuple[int, int]]], only: frozenset | None = None, slices: dict | None = None):
    """The entries of each vector; the part is the prefix after descending `splits`, as leaf, depth and bits.

    What travels is the cosine to the leaf's centre (`along`), the TREES * BITS bits of what the centre leaves over, and as
    `home` the part of the first entry.
    only: entries of these leaves, without bits."""
    kind = ["leaf", "depth", "bits", "h"] + ([] if only is not None else ["slice", "home", "along", "sketch"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deep = projection(book.first.shape[1], DEPTH, SEED + 50)
        centres = np.concatenate(book.second)
        if only is None:
            proj = projection(book.first.shape[1])
            shift = centres @ proj
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                rows = pdf.iloc[lo : lo + 1000]
                x = _units(rows["vec"])
                leaf = book.leaves(x)
                many = leaf.shape[1]
                out = pd.DataFrame({"leaf": leaf.T.ravel(), "depth": np.int32(0), "bits": np.int64(0), "h": np.tile(rows["h"].to_numpy(), many), "slice": np.int32(0), "_i": np.tile(np.arange(len(rows)), many)})
                out = out[out["leaf"] >= 0] if only is None else out[out["leaf"].isin(only)]
                out = out.reset_index(drop=True)
                for name in set(out["leaf"].unique()) & splits.keys():
                    at = np.flatnonzero(out["leaf"] == name)
                    bits = _prefix_bits(x[out["_i"].to_numpy()[at]], book.centre(name), deep)
                    depth = np.zeros(len(at), np.int64)
                    for d in range(0, DEPTH, STEP):
                        cut = np.array([(d, int(b)) in splits[name] for b in bits >> (DEPTH - d)]) & (depth == d)
                        depth[cut] = d + STEP
                    out.loc[at, "depth"] = depth.astype(np.int32)
                    out.loc[at, "bits"] = bits >> (DEPTH - depth)
                if slices:
                    key = list(zip(out["leaf"], out["depth"], out["bits"]))
                    out["slice"] = [np.int32(h % slices.get(k, 1)) for k, h in zip(key, out["h"])]
                if only is None:
                    i, name = out["_i"].to_numpy(), out["leaf"].to_numpy()
                    place = _place(out)
                    out["home"] = place[i]  # the first entries come first, one of each row
                    number = book.begin[name // BRANCH] + name % BRANCH
                    y = x @ proj
                    sketch, along = np.empty((len(out), proj.shape[1] // 8), np.uint8), np.empty(len(out), np.float32)
                    for a in range(0, len(out), 500):
                        j, c = i[a : a + 500], number[a : a + 500]
                        along[a : a + 500] = np.einsum("ij,ij->i", x[j], centres[c])
                        sketch[a : a + 500] = np.packbits(y[j] > along[a : a + 500, None] * shift[c], axis=1)
                    out["along"] = along
                    out["sketch"] = [b.tobytes() for b in sketch]
                yield out[kind]

    return run


def _place(parts: pd.DataFrame) -> np.ndarray:
    """A number for a part."""
    z = np.zeros(len(parts), np.uint64)
    for c in ("leaf", "depth", "bits", "slice"):
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + parts[c].to_numpy().astype(np.int64).view(np.uint64)
    return ((z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _lcp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading bits."""
    d = a ^ b
    return np.where(d == 0, BITS, BITS - 1 - np.floor(np.log2(np.maximum(d, 1).astype(np.float32))).astype(np.int64))


def forest_pairs(strings: np.ndarray, words: np.ndarray, want: int = WANTED, most: int = COMPARED) -> np.ndarray:
    """(pairs, 2): row and candidate of the rows of one part, the `most` nearest by Hamming distance of each row.

    strings is (rows, trees), words (SKETCH, rows).  `stop` is the level at which a row's synchronous ascent ends: the longest prefix length
    at which the rows that share it, over all trees, are `want` or more."""
    m, trees = strings.shape
    want = max(want, m // SHARE)
    if m < 2:
        return np.empty((0, 2), np.int64)
    orders = [np.argsort(strings[:, t], kind="stable") for t in range(trees)]
    equal = [_lcp(strings[o[:-1], t], strings[o[1:], t]) for t, o in enumerate(orders)]
    stop = np.full(m, -1)
    for level in range(BITS, -1, -1):
        size = np.zeros(m, np.int64)
        for o, e in zip(orders, equal):
            node = np.concatenate(([0], np.cumsum(e < level)))
            size[o] += np.bincount(node)[node] - 1
        stop[(stop < 0) & ((size >= want) | (level == 0))] = level
        if (stop >= 0).all():
            break
    nodes = {}
    for level in np.unique(stop):
        for t, (o, e) in enumerate(zip(orders, equal)):
            node = np.concatenate(([0], np.cumsum(e < level)))
            n = np.bincount(node)
            begin = np.cumsum(n) - n
            place = np.empty(m, np.int64)
            place[o] = node
            nodes[level, t] = (n[place].astype(np.int32), begin[place].astype(np.int32))
    out = []
    step = max(1, 2_000_000 // m)
    for lo in range(0, m, step):  # a block of rows at a time
        mine = np.arange(lo, min(lo + step, m))
        seen = np.zeros((len(mine), m), bool)
        for level in np.unique(stop[mine]):
            i = mine[stop[mine] == level]
            for t, o in enumerate(orders):
                n, begin = nodes[level, t]
                c = n[i]
                at = np.arange(c.sum()) + np.repeat(begin[i] - (np.cumsum(c) - c), c)
                seen[np.repeat(i - lo, c), o[at]] = True
        seen[mine - lo, mine] = False
        a, b = np.nonzero(seen)
        far = np.zeros(len(a), np.int16)
        for w in words:
            far += np.bitwise_count(w[a + lo] ^ w[b])
        # the `most` nearest of each row: below a row's bound all, at the bound the first ones
        width = 64 * len(words) + 1
        count = np.bincount(a * width + far, minlength=len(mine) * width).reshape(-1, width)
        bound = (np.cumsum(count, axis=1) < most).sum(1)
        near = far <= bound[a]
        a, b, far = a[near], b[near], far[near]
        order = np.lexsort((far, a))
        a, b = a[order], b[order]
        near = np.arange(len(a)) - np.searchsorted(a, a, "left") < most
        out.append(np.stack([a[near] + lo, b[near]], axis=1))
    return np.concatenate(out)


def best_of(x: np.ndarray, pairs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, other rows, cosines): the k best candidates of each row; a candidate serves both rows of a pair."""
    key = np.unique(pairs.min(1) * np.int64(len(x)) + pairs.max(1)) if len(pairs) else np.empty(0, np.int64)
    a, b = key // max(len(x), 1), key % max(len(x), 1)
    c = np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 4000]], x[b[i : i + 4000]]) for i in range(0, len(a), 4000)]) if len(a) else np.empty(0, np.float32)
    me, other, c = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])
    order = np.lexsort((other, -c, me))
    me, other, c = me[order], other[order], c[order]
    keep = np.arange(len(me)) - np.searchsorted(me, me, "left") < k
    return me[keep], other[keep], c[keep]


_LISTED = np.dtype([("o", "<i8"), ("far", "<f4"), ("home", "<i8")])


def _groups(batches: Iterator[pd.DataFrame], name: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of one key at a time; they come sorted by key."""
    group: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        keys = pdf[name].to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for piece in np.split(np.arange(len(pdf)), cuts):
            if not len(piece):
                continue
            key = tuple(keys[piece[0]])
            if group and key != last:
                yield pd.concat(group)
                group = []
            last = key
            group.append(pdf.iloc[piece])
    if group:
        yield pd.concat(group)


def _kept(row: np.ndarray, far: np.ndarray, k: int, most: int) -> np.ndarray:
    """Which of the candidates, sorted by row and distance, may be among the k best: MARGIN behind the k-th at most."""
    first = np.searchsorted(row, row, "left")
    kth = np.minimum(first + k, np.searchsorted(row, row, "right")) - 1
    return (far <= far[kth] + MARGIN) & (np.arange(len(row)) - first < most)


def _search_parts(k: int):
    """The candidates of each entry of a part, as a list of (other row, 1 less the cosine as estimated, its home)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["leaf", "depth", "bits", "slice"]):
            h, home = g["h"].to_numpy(), g["home"].to_numpy()
            bits = np.frombuffer(b"".join(g["sketch"]), np.uint8).reshape(len(g), -1)
            words = np.ascontiguousarray(bits.view(np.uint64).T)
            pairs = forest_pairs(bits.view(">u2").astype(np.uint16), words[:SKETCH])
            a, b = pairs[:, 0], pairs[:, 1]
            far = np.zeros(len(a), np.int16)
            for w in words:
                far += np.bitwise_count(w[a] ^ w[b])
            along = np.clip(g["along"].to_numpy(), -1, 1)
            across = np.sqrt(1 - along**2)
            far = 1 - along[a] * along[b] - across[a] * across[b] * np.cos(np.pi * far / (64 * len(words)))
            order = np.lexsort((far, a))
            a, b, far = a[order], b[order], far[order]
            keep = _kept(a, far, k, COMPARED)
            a, b, far = a[keep], b[keep], far[keep]
            x = np.empty(len(a), _LISTED)
            x["o"], x["far"], x["home"] = h[b], far, home[b]
            cuts = np.flatnonzero(np.diff(a, prepend=-1))
            lists = [x[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(a)])]
            yield pd.DataFrame({"h": h[a[cuts]], "home": home[a[cuts]], "list": lists})

    return run


def _merge_lists(k: int):
    """From the lists of all entries the pairs to compare, each with the home where that is done.  Rows come sorted by h."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.array([len(x) // _LISTED.itemsize for x in pdf["list"]])
        x = np.frombuffer(b"".join(pdf["list"]), _LISTED)
        h, home = np.repeat(pdf["h"].to_numpy(), n), np.repeat(pdf["home"].to_numpy(), n)
        order = np.lexsort((x["far"], x["o"], h))
        h, home, x = h[order], home[order], x[order]
        one = np.ones(len(h), bool)
        one[1:] = (h[1:] != h[:-1]) | (x["o"][1:] != x["o"][:-1])
        h, home, x = h[one], home[one], x[one]
        order = np.lexsort((x["o"], x["far"], h))
        h, home, x = h[order], home[order], x[order]
        keep = _kept(h, x["far"], k, COMPARED)
        h, home, x = h[keep], home[keep], x[keep]
        o = x["o"]
        return pd.DataFrame({"place": np.where(h < o, home, x["home"]), "a": np.minimum(h, o), "b": np.maximum(h, o)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            last = pdf["h"].to_numpy() == pdf["h"].iloc[-1] if len(pdf) else np.zeros(0, bool)
            rest = pdf[last]
            if not last.all():
                yield of(pdf[~last])
        if rest is not None and len(rest):
            yield of(rest)

    return run


def _compare(k: int):
    """Exact cosines of the pairs of a place, for each row the best; rows come sorted by place, vectors (b null) first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["place"]):
            v = g["vec"].notna().to_numpy()
            if v.all():
                continue
            own = g[v].sort_values("a")
            h, x = own["a"].to_numpy(), _units(own["vec"])
            p = g[~v]
            at = np.stack([np.searchsorted(h, p["a"].to_numpy()), np.searchsorted(h, p["b"].to_numpy())], axis=1)
            a, b, c = best_of(x, at, k + 2)
            yield pd.DataFrame({"h": h[a], "o": h[b], "cosine": c.astype(np.float64)})

    return run


def _splits(vecs: DataFrame, book: Codebook) -> tuple[dict[int, set[tuple[int, int]]], dict]:
    """(prefixes to descend per leaf, number of slices of prefixes that cannot be descended further).

    What comes to the driver is prefixes with more than PART_ROWS entries only: at most ENTRIES * rows / PART_ROWS a level."""
    splits: dict[int, set[tuple[int, int]]] = {}
    slices: dict[tuple[int, int, int], int] = {}
    only: frozenset | None = None
    for d in range(0, DEPTH + 1, STEP):
        if only is None:
            e = vecs.select("h", "vec").mapInPandas(_leaf_counts(book), "leaf int, depth int, bits bigint, n bigint")
            e = e.groupBy("leaf", "depth", "bits").agg(F.sum("n").alias("n"))
        else:
            e = vecs.mapInPandas(_entries(book, splits, only), "leaf int, depth int, bits bigint, h bigint")
            e = e.groupBy("leaf", "depth", "bits").agg(F.count(F.lit(1)).alias("n"))
        large = e.filter((F.col("n") > PART_ROWS) & (F.col("depth") == d)).collect()
        if not large:
            break
        for leaf, depth, bits, n in large:
            if d == DEPTH:
                slices[(leaf, depth, bits)] = -(-n // PART_ROWS)
            else:
                splits.setdefault(leaf, set()).add((depth, bits))
        only = frozenset(r[0] for r in large)
    return splits, slices


def _leaf_counts(book: Codebook):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                leaf, n = np.unique(book.leaves(_units(pdf["vec"].iloc[lo : lo + 1000])), return_counts=True)
                yield pd.DataFrame({"leaf": leaf.astype(np.int32), "depth": np.int32(0), "bits": np.int64(0), "n": n.astype(np.int64)})[leaf >= 0]

    return run


def valid_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(key).isNotNull() & v.isNotNull() & fine).select(F.col(key).alias("id"), v.cast("array<float>").alias("v"))


def nearest(df: DataFrame, key: str = "id", vector: str = "vector", k: int = 3, dim: int = 768) -> DataFrame:
    """id, rank (1..k), neighbour, cosine: the k most similar other rows of every row."""
    n = partitions(df.sparkSession)
    v = valid_vectors(df, key, vector, dim).withColumn("h", F.xxhash64("v"))
    # h stands for a class of equal vectors; of an id that comes with several vectors one counts
    ids = materialize(v.groupBy("id").agg(F.min("h").alias("h")))
    packed = v.select("h", "v").mapInPandas(_pack_rows, "h bigint, vec binary").groupBy("h").agg(F.min("vec").alias("vec"))
    vecs = bucketed(packed.join(ids.select("h").distinct(), "h", "left_semi"), "h")
    n_vecs = vecs.count()
    size = min(SAMPLE, max(8192, 4 * n_vecs * PER_LEAF // CELL_MEAN))
    step = max(1, -(-n_vecs // size))  # rows are taken by hash, `size` at most
    sample = [r[0] for r in vecs.filter(F.pmod(F.xxhash64("h"), F.lit(step)) == 0).orderBy("h").limit(size).select("vec").collect()]
    if not sample:
        return df.sparkSession.createDataFrame([], "id string, rank bigint, neighbour string, cosine double")
    book = Codebook(_units(sample), n_vecs)
    splits, slices = _splits(vecs, book)
    parts = vecs.mapInPandas(_entries(book, splits, slices=slices), "leaf int, depth int, bits bigint, h bigint, slice int, home bigint, along float, sketch binary")
    key = ["leaf", "depth", "bits", "slice"]
    parts = parts.repartition(max(n, 24), *key).sortWithinPartitions(*key)
    lists = parts.mapInPandas(_search_parts(k), "h bigint, home bigint, list binary").repartition(n, "h").sortWithinPartitions("h")
    pairs = materialize(lists.mapInPandas(_merge_lists(k), "place bigint, a bigint, b bigint"))
    # a pair is compared at the home of its smaller row; a vector travels once to every place that needs it
    wanted = pairs.select("place", F.explode(F.array("a", "b")).alias("h")).distinct()
    moved = wanted.join(vecs.hint("merge"), "h").select("place", F.col("h").alias("a"), F.lit(None).cast("bigint").alias("b"), "vec")
    moved = moved.unionByName(pairs.withColumn("vec", F.lit(None).cast("binary")))
    moved = moved.repartition(max(n, 24), "place").sortWithinPartitions("place")
    both = moved.mapInPandas(_compare(k), "h bigint, o bigint, cosine double").groupBy("h", "o").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("h").orderBy("id")
    # ids: at most k + 1 of any class can be someone's neighbour
    few = ids.select("h", "id").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= k + 1).select("h", "id")
    firsts = few.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    top = Window.partitionBy("h").orderBy(F.desc("cosine"), "nid")
    near = both.join(firsts.withColumnRenamed("h", "o"), "o").select("h", "cosine", F.explode("ids").alias("nid"))
    near = near.withColumn("i", F.row_number().over(top)).filter(F.col("i") <= k).select("h", "cosine", "nid")
    own = firsts.filter(F.size("ids") > 1).select("h", F.lit(1.0).alias("cosine"), F.explode("ids").alias("nid"))
    lists = near.unionByName(own).groupBy("h").agg(F.collect_list(F.struct((-F.round("cosine", 12)).alias("d"), "nid", "cosine")).alias("l"))
    of = ids.select("h", "id").join(lists, "h")
    best = F.slice(F.filter(F.array_sort("l"), lambda x: x["nid"] != F.col("id")), 1, k)
    out = of.select("id", F.posexplode(best).alias("rank", "x"))
    return out.select("id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("x.nid").alias("neighbour"), F.col("x.cosine").alias("cosine"))


def near_pairs(df: DataFrame, key: str = "id", vector: str = "vector", k: int = 3, dim: int = 768) -> DataFrame:
    """id_a < id_b where one is among the k most similar of the other."""
    x = nearest(df, key, vector, k, dim)
    return x.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
