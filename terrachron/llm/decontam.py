"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item has a 64-bit SimHash of its five-word shingles. A document's windows of the items' lengths are
fingerprinted likewise and looked up in a multi-index: the 64 bits are cut in radius + 1 blocks, and an item within
the radius agrees with the window in one block at least, so the index loses none. Its keys are the window's length and
a block's bits, so a window meets only items of its own length. Exact similarity of the weighted shingles then verifies
each candidate.

A window can only be similar enough if it has one of the item's rare shingles (those that together weigh more than
the similarity allows to miss), so windows are laid where such a shingle stands, aligned with its place in the item;
no other window can pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, pick, read_table
from .simhash import majority, votes
from .textnp import Words, binary_parts, shingles, slices

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 18
#: Words of benchmark text in one index; a larger benchmark is worked off in blocks of items.
INDEX_WORDS = 2_000_000
#: Windows fingerprinted at a time.
WINDOWS = 4096


class Index:
    """Items: ids and texts. shared: sorted hashes of the shingles that several items of the whole benchmark have, and in
    how many; without it, it is counted over these items."""

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY, radius: int = RADIUS, shared: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.similarity, self.radius = ids, similarity, radius
        a = pa.array(texts, pa.large_string())
        data, offs = binary_parts(a)
        w = Words(data, offs)
        h, at = shingles(w.hashes(), w.doc, SHINGLE)
        item = w.doc[at]
        self.words = w.per_text()
        self.simhash = majority(votes(h, item, len(ids)), np.bincount(item, minlength=len(ids)))
        # a shingle weighs less the more items have it
        pairs = np.unique(np.stack([h, item.astype(np.uint64)]), axis=1)
        self.keys, df = np.unique(pairs[0], return_counts=True)
        if shared is not None:
            df = np.ones(len(self.keys))
            if len(shared[0]):
                place = np.minimum(np.searchsorted(shared[0], self.keys), len(shared[0]) - 1)
                df = np.where(shared[0][place] == self.keys, shared[1][place], 1)
        self.weight = 1 / np.sqrt(df)
        code = np.searchsorted(self.keys, h)
        self.profile: list[tuple[np.ndarray, np.ndarray]] = []  # of each item: codes and counts
        anchors: list[tuple[int, int, int]] = []  # code, item, place
        place = at - np.searchsorted(w.doc, item, "left")
        for i in range(len(ids)):
            own = item == i if len(ids) < 50 else slice(np.searchsorted(item, i, "left"), np.searchsorted(item, i, "right"))
            c, n = np.unique(code[own], return_counts=True)
            self.profile.append((c, n))
            order = np.argsort(-self.weight[c], kind="stable")
            rank = np.cumsum((self.weight[c] * n)[order])
            need = int(np.searchsorted(rank, (1 - similarity) * (rank[-1] if len(rank) else 0) * (1 + 1e-9), "right")) + 1
            rare = set(c[order[:need]].tolist())
            anchors += [(x, i, p) for x, p in zip(code[own].tolist(), place[own].tolist()) if x in rare]
        anchors.sort()
        self.anchor = np.array(anchors, np.int64).reshape(-1, 3)
        self.anchored = np.unique(self.anchor[:, 0])
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(self.keys[self.anchored] >> np.uint64(44)).astype(np.int64)] = True
        # multi-index: for each block of bits, items in order of (words, the block's value)
        edge = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        self.blocks = [(np.uint64(edge[b]), np.uint64((1 << (edge[b + 1] - edge[b])) - 1)) for b in range(radius + 1)]
        self.lists = []
        for b in range(radius + 1):
            v = self._block_keys(self.simhash, self.words, b)
            order = np.argsort(v, kind="stable")
            self.lists.append((v[order], order))

    def _block_keys(self, fp: np.ndarray, words: np.ndarray, b: int) -> np.ndarray:
        s, m = self.blocks[b]
        return (words.astype(np.uint64) << np.uint64(32)) | ((fp >> s) & m)

    def near(self, fp: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of a window's length whose fingerprint is within the radius of the window's."""
        found = []
        for b, (keys, order) in enumerate(self.lists):
            k = self._block_keys(fp, words, b)
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = high - low
            w = np.repeat(np.arange(len(fp)), n)
            item = order[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
            ok = np.bitwise_count(self.simhash[item] ^ fp[w]) <= self.radius
            found.append(w[ok] * len(self.ids) + item[ok])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.ids), pair % len(self.ids)

    def matches(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, item, first word, similarity): the best window of each item in each text, at or above the similarity."""
        w = Words(data, offs)
        if not len(w.doc):
            return []
        h, at = shingles(w.hashes(), w.doc, SHINGLE)
        may = np.flatnonzero(self.slots[(h >> np.uint64(44)).astype(np.int64)])
        code = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
        hit = self.keys[code] == h[may]
        may, code = may[hit], code[hit]
        low, high = np.searchsorted(self.anchor[:, 0], code, "left"), np.searchsorted(self.anchor[:, 0], code, "right")
        some = high > low
        may, low, high = may[some], low[some], high[some]
        if not len(may):
            return []
        total = np.repeat(may, high - low)
        row = np.arange(len(total)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        item, doc = self.anchor[row, 1], w.doc[at[total]]
        begin_of, count_of = np.searchsorted(w.doc, doc, "left"), np.searchsorted(w.doc, doc, "right")
        start = np.maximum(at[total] - self.anchor[row, 2], begin_of)
        end = np.minimum(start + self.words[item], count_of)
        start = np.maximum(begin_of, end - self.words[item])
        # windows of one text and place have one length for each item that laid them
        windows = np.unique(np.stack([doc, start, end, self.words[item]]), axis=1)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for k in range(0, windows.shape[1], WINDOWS):
            d, s, e, words = windows[:, k : k + WINDOWS]
            a, b = np.searchsorted(at, s, "left"), np.searchsorted(at, np.maximum(s + 1, e - SHINGLE + 1), "left")
            n = b - a
            own = np.repeat(np.arange(len(n)), n)
            part = h[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)]
            for q, j in zip(*(x.tolist() for x in self.near(majority(votes(part, own, len(n)), n), words))):
                x = self.similar(h[a[q] : b[q]], j)
                key = (int(d[q]), j)
                if x >= self.similarity - 1e-12 and (x, -int(s[q])) > (lambda z: (z[0], -z[1]))(best.get(key, (-1.0, 0))):
                    best[key] = (x, int(s[q]))
        first = np.searchsorted(w.doc, np.arange(len(offs) - 1), "left")
        return [(d, j, int(s - first[d]), x) for (d, j), (x, s) in best.items()]

    def similar(self, part: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's; shingles of no item weigh 1."""
        own, n = np.unique(part, return_counts=True)
        code = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        known = self.keys[code] == own
        c, m = self.profile[item]
        w = np.where(known, self.weight[code], 1.0)
        both = np.isin(code, c) & known
        mine = np.zeros(len(own))
        mine[both] = m[np.searchsorted(c, code[both])]
        less = float((np.minimum(n, mine) * w).sum())
        more = float((self.weight[c] * m).sum() + (n * w).sum()) - less
        return less / more if more > 0 else 0.0


def shared_shingles(items: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that more than one item has, and in how many: over the whole benchmark, so that the
    weights do not depend on how it is cut in blocks."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = binary_parts(batch.column(0))
            for i, j in slices(offs):
                w = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h, at = shingles(w.hashes(), w.doc, SHINGLE)
                pairs = np.unique(np.stack([h, w.doc[at].astype(np.uint64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0].view(np.int64))], names=["h"])

    got = arrow_rows(items.select(text)).mapInArrow(each, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(float)[order]


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS, words: int = INDEX_WORDS) -> Iterator[Index]:
    """Indexes of blocks of items of `words` words at most; items without a word are left out."""
    rows = pick(benchmark, key, text).where(F.col(text).isNotNull()).withColumn("_n", F.octet_length(text))
    shared = shared_shingles(rows, text)
    ids: list = []
    texts: list[str] = []
    size = 0
    for i, t, n in rows.orderBy(key, text).toLocalIterator():
        if not t.encode().split():
            continue
        if ids and size + n > 6 * words:
            yield Index(ids, texts, similarity, radius, shared)
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += n
    if ids:
        yield Index(ids, texts, similarity, radius, shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", *, similarity: float = SIMILARITY, radius: int = RADIUS, words: int = INDEX_WORDS) -> DataFrame:
    """(key, item_id, first_word, similarity): a row for each document and item that it holds, with the best window.

    Null and empty texts hold nothing; items of fewer than five words are one shingle and must match as a whole text;
    an item given twice is found twice; an empty benchmark gives an empty result.
    """
    spark = docs.sparkSession
    schema = f"`{key}` bigint, item_id bigint, first_word int, similarity double"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, similarity=similarity, radius=radius, words=words):
        held = spark.sparkContext.broadcast(index)

        def find(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in it:
                data, offs = binary_parts(batch.column(1))
                rows = [(i + d, *rest) for i, j in slices(offs) for d, *rest in held.value.matches(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])]
                if rows:
                    d, item, s, x = (list(c) for c in zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)).cast(pa.int64()), pa.array([held.value.ids[i] for i in item], pa.int64()), pa.array(s, pa.int32()), pa.array(x, pa.float64())],
                        names=[key, "item_id", "first_word", "similarity"],
                    )

        out = out.unionByName(arrow_rows(pick(docs, key, text)).mapInArrow(find, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item: rows are dropped where they are read, so null and
    repeated ids need no rule."""
    for index in indexes(benchmark, **how):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def keep(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in it:
                data, offs = binary_parts(batch.column(batch.schema.get_field_index(text)))
                good = np.ones(batch.num_rows, bool)
                for i, j in slices(offs):
                    for d, *_ in held.value.matches(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                        good[i + d] = False
                yield batch.filter(pa.array(good))

        docs = arrow_rows(docs).mapInArrow(keep, docs.schema)
    return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "first_word", "similarity")
