"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are grouped by keys made of a part of their bits. Within a group the fingerprints are held as vertical
bit planes; one pass over the planes updates the distances of 64 pairs a word in carry-save counters, and words in
which every pair is beyond the radius are abandoned. Connected components join the links.

Two ways to make keys: `block_masks` cuts the bits in m blocks and keeps every choice of m - radius blocks, so each
pair within the radius shares a key (no link is lost). At radii at which blocks no longer select, the keys are the
least hashes of a text's shingles, so many that similar sets have one in common (`set_fingerprints`).

Links at such a radius are candidates only: `verified` compares the shingle sets of linked texts themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, components, pick, read_table, stored
from .textnp import Words, binary_parts, mix, shingles, slices

#: Fingerprints of one key that one task compares; beyond it a key is dealt out in pairs of blocks.
BLOCK = 8192
#: Texts, and shingles of them, that one block of a component holds when shingle sets are compared.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 19
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- fingerprints


def votes(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """(n, 64) counts of set bits, most significant first, of the hashes of each text (text: ascending index)."""
    out = np.zeros((n, 64), np.int32)
    if len(hashes) == 0:
        return out
    lanes = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).view(np.uint64)  # 8 counters a word
    begin = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[begin, len(text)])
    parts = -(-size // 255)  # a lane of 8 bits holds up to 255
    owner = np.repeat(np.arange(len(begin)), parts)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    sums = np.add.reduceat(lanes, begin[owner] + 255 * step, axis=0).view(np.uint8).astype(np.int32)
    out[text[begin]] = np.add.reduceat(sums, np.cumsum(parts) - parts, axis=0)
    return out


def majority(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A fingerprint of 64 bits: bit set where over half the hashes set it; no hashes: zero."""
    return np.packbits(2 * counts > total[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def _xxh_rows(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh64_intdigest as xx

    hashes, owner = [], []
    for i, t in enumerate(texts):
        w = t.lower().split()  # of bytes: A-Z only, and white space \x20 \x09-\x0D only
        if not w:
            continue
        joined = b" ".join(w)
        if len(w) <= k:
            hashes.append(np.array([xx(joined, 42)], np.uint64))
        else:
            ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
            first = np.r_[0, ends[: len(w) - k] + 1]
            hashes.append(
                np.fromiter((xx(joined[s:e], 42) for s, e in zip(first.tolist(), ends[k - 1 :].tolist())), np.uint64)
            )
        owner.append(np.full(len(hashes[-1]), i))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owner)


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = 3, words: int = 1, exact: bool = True
) -> DataFrame:
    """(key, w0 .. w{words-1}): a fingerprint of 64 * words bits of each whole text.

    exact: XXH64 with seed 42 of the space-joined shingles (words must be 1); else rolling 64-bit word hashes, mixed
    anew for every 64 bits. Null and wordless texts get zero.
    """
    schema = f"`{key}` bigint, " + ", ".join(f"w{i} bigint" for i in range(words))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = binary_parts(batch.column(1))
            out: list[list[np.ndarray]] = [[] for _ in range(words)]
            for i, j in slices(offs):
                d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                if exact:
                    raw = d.tobytes()
                    h, owner = _xxh_rows([raw[a:b] for a, b in zip(o[:-1].tolist(), o[1:].tolist())], shingle)
                else:
                    w = Words(d, o)
                    h, at = shingles(w.hashes(), w.doc, shingle)
                    owner = w.doc[at]
                total = np.bincount(owner, minlength=j - i)
                for x in range(words):
                    out[x].append(majority(votes(h if exact else mix(h, x + 1), owner, j - i), total).view(np.int64))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            names = [key, *(f"w{i}" for i in range(words))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, cols)], names=names)

    return arrow_rows(pick(docs, key, text)).mapInArrow(rows, schema)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct k-word shingles of each text, ascending by text and hash."""
    w = Words(data, offs)
    h, at = shingles(w.hashes(), w.doc, k)
    h, owner = mix(h), w.doc[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])][: len(h)]
    return h[new], owner[new]


def set_ids(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's shingle set; texts of equal sets have the same one, wordless texts zero."""
    out = np.zeros(n, np.uint64)
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
    if len(begin):
        with np.errstate(over="ignore"):
            out[owner[begin]] = mix(np.add.reduceat(mix(h, 91), begin))
    return out.view(np.int64)


def set_fingerprints(docs: DataFrame, key: str, text: str, shingle: int, words: int, similarity: float) -> DataFrame:
    """(key, id, n, w0 .. w{words-1}, least): name, size, fingerprint and least hashes of each text's set of shingles.

    Two sets of n hashes or more with the similarity have similarity * n in common, so the least hash of those is among
    the least n - similarity * n + 1 of either set: no pair of that similarity is without a common one.
    """
    schema = f"`{key}` bigint, id bigint, n bigint, " + ", ".join(f"w{i} bigint" for i in range(words)) + ", least array<bigint>"
    names = [key, "id", "n", *(f"w{i}" for i in range(words)), "least"]

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = binary_parts(batch.column(1))
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(words + 4)]
            for i, j in slices(offs):
                h, owner = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                total = np.bincount(owner, minlength=j - i)
                cols = [set_ids(h, owner, j - i), total]
                cols += [majority(votes(mix(h, x + 1), owner, j - i), total).view(np.int64) for x in range(words)]
                some = np.where(total > 0, total - np.ceil(similarity * total - 1e-9).astype(np.int64) + 1, 0)
                early = np.arange(len(h)) - (np.cumsum(total) - total)[owner] < some[owner]
                cols += [some, h[early].view(np.int64)]
                for x, c in zip(out, cols):
                    x.append(c)
            *flat, some, hashes = [np.concatenate(x) for x in out]
            least = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(some)].astype(np.int32)), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *map(pa.array, flat), least], names=names)

    return arrow_rows(pick(docs, key, text)).mapInArrow(rows, schema)


# ---- keys


def block_masks(n: int, radius: int, bits: int = 64) -> list[list[int]]:
    """Masks of every choice of m - radius of m blocks; m grows until a key has some bits more than n needs."""
    m = radius + 1
    while True:
        edge = [round(i * bits / m) for i in range(m + 1)]
        if bits * (m - radius) // m >= min(math.log2(max(2, n)) + 2, 40):
            break
        m += 1
    block = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(m)]
    return [_split(sum(block[i] for i in c), bits) for c in itertools.combinations(range(m), m - radius)]


def agreement(similarity: float) -> float:
    """Chance that a bit agrees, for two shingle sets of like size and this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def _split(mask: int, bits: int) -> list[int]:
    words = [(mask >> (64 * i)) & ((1 << 64) - 1) for i in range(bits // 64)]
    return [w - (1 << 64) if w >> 63 else w for w in words]


# ---- comparison


def planes_of(f: np.ndarray) -> np.ndarray:
    """(64 * W, words) bit planes of fingerprints (n, W); one spare word of zeros at the end."""
    n, w = f.shape
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    room = (n + 63) // 64 + 1
    wide = np.zeros((64 * w, room * 64), np.uint8)
    wide[:, :n] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def survivors(differ, alive: np.ndarray, n_planes: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and lanes of the words whose pairs differ in at most radius planes.

    differ(p, idx): the words of plane p, XORed, at the indices. Two planes at a time enter the lowest counter as in
    a carry-save adder; carries go up the levels; what leaves the top level is beyond the radius.
    """
    idx = np.flatnonzero(alive)
    live, levels = alive[idx], radius.bit_length()
    count = [np.zeros(len(idx), np.uint64) for _ in range(levels)]
    over = np.zeros(len(idx), np.uint64)
    for p in range(0, n_planes, 2):
        if not len(idx):
            break
        x, y = differ(p, idx), differ(p + 1, idx)
        if levels:
            c = count[0]
            carry = (x & y) | (c & (x ^ y))
            count[0] = c ^ x ^ y
            for j in range(1, levels):
                count[j], carry = count[j] ^ carry, count[j] & carry
            over |= carry
        else:
            over |= x | y
        if p % 16 == 14 or p + 2 >= n_planes:
            more, same = over.copy(), ~over
            for j in range(levels - 1, -1, -1):
                if radius >> j & 1:
                    same &= count[j]
                else:
                    more |= same & count[j]
                    same &= ~count[j]
            live = live & ~more
            keep = live != 0
            if not keep.all():
                idx, live, over = idx[keep], live[keep], over[keep]
                count = [c[keep] for c in count]
    return idx, live


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little").astype(bool)


class _Union:
    def __init__(self, n: int):
        self.to = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Hook the greater root to the lesser until all pairs agree."""
        to = self.to
        while len(a):
            a, b = to[a], to[b]
            differ = a != b
            a, b = a[differ], b[differ]
            if not len(a):
                break
            np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = to[to]
                if (up == to).all():
                    break
                to[:] = up


def links(f: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (index, root index) of the pairs of one group within the radius; groups lie together."""
    n = len(f)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, n])
    union = _Union(n)
    small = np.repeat(size <= 64, size)
    if small.any():
        at = np.flatnonzero(small)
        _shifted(f[at], group[at], at, radius, union)
    for s, k in zip(begin[size > 64].tolist(), size[size > 64].tolist()):
        _rectangle(f[s : s + k], s, radius, union)
    moved = np.flatnonzero(union.to != np.arange(n))
    return moved, union.to[moved]


def _shifted(f: np.ndarray, group: np.ndarray, at: np.ndarray, radius: int, union: _Union) -> None:
    """Groups of up to 64: every fingerprint against the one s places on, for s = 1, 2, .."""
    n, planes = len(f), planes_of(f)
    room = planes.shape[1] - 1
    for s in range(1, 64):
        same = np.zeros(room * 64, np.uint8)
        if s < n:
            same[: n - s] = group[s:] == group[:-s]
        alive = np.packbits(same, bitorder="little").view(np.uint64)
        if not alive.any():
            break
        right, left = np.uint64(s), np.uint64(64 - s)

        def differ(p, idx, right=right, left=left):
            row = planes[p]
            return row[idx] ^ ((row[idx] >> right) | (row[idx + 1] << left))

        idx, live = survivors(differ, alive, len(planes), radius)
        if len(idx):
            w, lane = np.nonzero(_lanes(live))
            a = idx[w] * 64 + lane
            union.join(at[a], at[a + s])


def _rectangle(f: np.ndarray, offset: int, radius: int, union: _Union, cells: int = 1 << 18) -> None:
    """One large group: blocks of fingerprints as queries against the planes of all."""
    k, planes = len(f), planes_of(f)
    room = planes.shape[1] - 1
    rows = max(1, cells // room)
    for q in range(0, k, rows):
        m = min(rows, k - q)
        bits = np.unpackbits(np.ascontiguousarray(f[q : q + m]).view(np.uint8).reshape(m, -1), axis=1, bitorder="little")
        flip = np.where(bits.T == 1, _FULL, np.uint64(0))
        alive = np.full((m, room), _FULL, np.uint64)
        if k % 64:
            alive[:, -1] = np.uint64((1 << (k % 64)) - 1)

        def differ(p, idx, flip=flip):
            return planes[p][idx % room] ^ flip[p][idx // room]

        idx, live = survivors(differ, alive.ravel(), len(planes), radius)
        if len(idx):
            w, lane = np.nonzero(_lanes(live))
            union.join(offset + q + idx[w] // room, offset + (idx[w] % room) * 64 + lane)


def link(fps: DataFrame, masks: list[list[int]], radius: int, words: int) -> DataFrame:
    """Links (a, b) of the ids of fingerprints within the radius that share a key: a spanning forest for each key.

    fps: (id, w0 ..), each fingerprint once. Keys seen to be very common in a sample of the rows are dealt out in
    pairs of blocks, so every pair still meets; the rest go to one task each.
    """
    names = [f"w{i}" for i in range(words)]
    keys = F.array(
        *[F.xxhash64(F.lit(t), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(names, mask)]) for t, mask in enumerate(masks)]
    )
    return meet(fps.select("id", *names, F.explode(keys).alias("k")), radius, words)


def meet(rows: DataFrame, radius: int, words: int) -> DataFrame:
    """The links of `link` for rows (id, w0 .., k) of fingerprints and their keys."""
    names = [f"w{i}" for i in range(words)]
    share = 64
    hot = (
        rows.where(F.pmod(F.xxhash64("id", F.lit(share)), F.lit(share)) == 0)
        .groupBy("k")
        .count()
        .where(F.col("count") * share > BLOCK)
        .select("k", F.ceil(F.col("count") * share / (BLOCK // 2)).cast("int").alias("blocks"))
    )
    hot = stored(hot, "simhash-hot")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pair = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64(F.col("k"), F.least(own, j), F.greatest(own, j))
    )
    if hot.isEmpty():
        dealt = rows
    else:
        wide = rows.join(hot, "k", "left")
        dealt = wide.select("id", *names, F.explode(F.when(F.col("blocks").isNull(), F.array("k")).otherwise(pair)).alias("k"))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def done(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            k = cols[-1]
            if len(k) < 2:
                return None
            same = k[1:] == k[:-1]
            twin = np.r_[same, False] | np.r_[False, same]
            cols = [c[twin] for c in cols]
            if not len(cols[0]):
                return None
            f = np.stack(cols[1:-1], axis=1).view(np.uint64)
            a, b = links(f, cols[-1], radius)
            return pa.RecordBatch.from_arrays([pa.array(cols[0][a]), pa.array(cols[0][b])], names=["a", "b"])

        for batch in it:
            cols = [np.asarray(c) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[-1], cols[-1][-1], "left"))
            held = [c[cut:] for c in cols]
            if cut and (out := done([c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and (out := done(held)) is not None:
            yield out

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(compare, "a bigint, b bigint")


# ---- exact comparison


def similar(h: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (index, root index) of the pairs of sets of this Jaccard similarity or more.

    h: the hashes of all sets, one set after another; size: of each. Every pair is compared, but those that their
    sizes rule out and those that other pairs have joined already.
    """
    n = len(size)
    union, order = _Union(n), np.argsort(size, kind="stable")
    begin, size = (np.cumsum(size) - size)[order], size[order]
    number = np.unique(h, return_inverse=True)[1]
    mark = np.zeros(int(number.max(initial=-1)) + 1, bool)
    last = np.searchsorted(size, size / similarity + 1e-9, "right")
    for i in range(n - 1):
        if not size[i]:
            continue
        other = i + 1 + np.flatnonzero(union.to[i + 1 : last[i]] != union.to[i])
        if not len(other):
            continue
        own, k = number[begin[i] : begin[i] + size[i]], size[other]
        mark[own] = True
        first = np.cumsum(k) - k
        common = np.add.reduceat(mark[number[np.repeat(begin[other] - first, k) + np.arange(k.sum())]], first, dtype=np.int64)
        mark[own] = False
        near = other[common + 1e-9 >= similarity * (size[i] + k - common)]
        union.join(np.full(len(near), i), near)
    moved = np.flatnonzero(union.to != np.arange(n))
    return order[moved], order[union.to[moved]]


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of the ids of texts whose shingle sets have the similarity, among those that `pairs` connect.

    nodes: (id, n, least), least being the key of one of the texts of this set. All pairs within a component of `pairs`
    are compared, which are more than the pairs themselves; a large component is dealt out in pairs of blocks.
    """
    root = components(pairs, "near-rough").withColumnRenamed("node", "id")
    held = stored(nodes.join(root.hint("merge"), "id").select("id", "n", "least", "root"), "near-held")
    large = (
        held.groupBy("root")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
        .select("root", F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("root", F.least(own, j), F.greatest(own, j)))
    dealt = held.join(large.hint("merge"), "root").select("id", pair.alias("groups"))
    wanted = held.select(F.col("least").alias(key)).distinct()

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = binary_parts(batch.column(0))
            for i, j in slices(offs):
                h, owner = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], shingle)
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=j - i))].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(h, owner, j - i)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["id", "s"]
                )

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids, all_ = np.array(list(held), np.int64), list(held.values())
                a, b = similar(np.concatenate(all_), np.array([len(x) for x in all_]), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        for batch in it:
            s = batch.column(1)
            values, offs = np.asarray(s.values), np.asarray(s.offsets)
            for k, x, i, j in zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist()):
                if k != group:
                    yield from done()
                    group, held = k, {}
                held[x] = values[i:j].copy()  # of rows that repeat a set, one
        yield from done()

    texts = pick(docs, key, text).join(wanted.hint("merge"), key, "left_semi").select(text)
    rows = arrow_rows(texts).mapInArrow(sets, "id bigint, s array<bigint>").join(dealt.hint("merge"), "id").select("id", "s", F.explode("groups").alias("k"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k").sortWithinPartitions("k").mapInArrow(compare, "a bigint, b bigint")


# ---- operators


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(key, fp, component_id): 64-bit fingerprints of whole texts, linked at radius or fewer bits, with the least key
    of the component. Equal fingerprints are one node, so copies are never compared with one another. Null and
    wordless texts have fingerprint zero and link like others; rows with a null key keep their fingerprint and a
    component like others; an empty table gives an empty result.
    """
    fp = stored(fingerprints(docs, key, text, shingle=shingle), "simhash-fp").withColumnRenamed("w0", "fp")
    nodes = stored(fp.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    n = nodes.count()
    pairs = link(nodes.select(F.col("fp").alias("id"), F.col("fp").alias("w0")), block_masks(n, radius), radius, 1)
    root = components(pairs, "simhash-cc")
    rooted = nodes.join(root, nodes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(least, "root").select("fp", "component_id")
    return fp.join(names, "fp").select(key, "fp", "component_id")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    shingle: int = 5,
    similarity: float = 0.8,
    words: int = 4,
    recall: float = 0.99999,
) -> DataFrame:
    """(key, component_id): texts linked by this Jaccard similarity of their five-word shingles or more, with the least
    key of the component.

    Texts meet by the least hashes of their sets, which loses no pair, and those that meet are compared by fingerprints
    of 64 * words bits. The radius is so far above the number of bits at which two texts of this similarity differ on
    average that a pair at the similarity is within it with chance recall, a closer one with more. No link counts
    before the sets themselves are compared. Equal sets are one node and never need to meet.
    """
    names = [f"w{i}" for i in range(words)]
    fp = stored(set_fingerprints(docs, key, text, shingle, words, similarity), "near-fp")
    nodes = stored(fp.groupBy("id", "n", *names).agg(F.first("least").alias("keys"), F.min(key).alias("least")), "near-nodes")
    bits, differ = 64 * words, 1 - agreement(similarity)
    radius = round(bits * differ + NormalDist().inv_cdf(recall) * math.sqrt(bits * differ * (1 - differ)))
    pairs = meet(nodes.select("id", *names, F.explode("keys").alias("k")), radius, words)
    nodes = nodes.select("id", "n", "least")
    root = components(verified(docs, nodes, pairs, key, text, shingle, similarity), "near-cc")
    rooted = stored(nodes.join(root.hint("merge"), nodes.id == root.node, "left").select("id", "least", F.coalesce("root", "id").alias("root")), "near-rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("id", "component_id")
    return fp.select(key, "id").join(named.hint("merge"), "id").select(key, "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
