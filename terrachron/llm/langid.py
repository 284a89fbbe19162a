"""Language identification by language-bitmask n-gram filters.

One Bloom filter serves all languages: a slot holds a bit for each language (a bit slice), so the AND of an n-gram's
slots gives at once every language that contains it. A text's n-grams are looked up together; the set bits are
counted for each language, the count is corrected for that language's rate of false positives, and the largest
corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, pick, read_table
from .textnp import mix

SIZES = (3, 4)
#: Labelled rows that the filters are learned from, for each language; drawn by a hash of the id.
TRAIN_ROWS = 5000
SLOTS_LOG2 = 20
HASHES = 4
#: A language contains an n-gram that is in this share of its texts, and in no less than OF_BEST of the share of the
#: language where it is most common.
MIN_SHARE = 0.004
OF_BEST = 0.1
#: Characters worked off at a time; longer texts are cut with an overlap.
PIECE = 1 << 16

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, row of each) of texts, lower-cased, other characters than letters as one space, spaces at the
    ends; no piece holds much more than PIECE, and no n-gram is lost or repeated at a cut."""
    keep = max(SIZES) - 1
    chars: list[np.ndarray] = []
    rows: list[np.ndarray] = []
    size = 0

    def flush():
        return np.concatenate(chars), np.concatenate(rows)

    for i, t in enumerate(texts):
        if not t:
            continue
        a = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        a = np.where(_letters()[a], a, np.uint32(32))
        space = a == 32
        a = a[~(space & np.r_[False, space[:-1]])]
        if len(a) < 3:
            continue
        for s in range(0, len(a), PIECE):
            part = a[max(0, s - keep) : s + PIECE]
            chars.append(part)
            rows.append(np.full(len(part), i if s == 0 else -1 - i, np.int32))
            size += len(part)
            if size >= PIECE:
                yield flush()
                chars, rows, size = [], [], 0
    if size:
        yield flush()


def ngrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of every n-gram of the texts, repeats included, in pieces of bounded size."""
    keep = max(SIZES) - 1
    for c, row in _pieces(texts):
        own = np.where(row < 0, -1 - row, row)
        # in a later piece of a text the first keep characters are an overlap: only n-grams that end past it are new
        late = (row < 0) & (np.arange(len(row)) - np.searchsorted(own, own, "left") < keep) if (row < 0).any() else None
        h = c.astype(np.uint64)
        with np.errstate(over="ignore"):
            for n in SIZES:
                if len(c) < n:
                    continue
                m = len(c) - n + 1
                acc = np.full(m, n, np.uint64)
                for j in range(n):
                    acc = acc * np.uint64(0x100000001B3) + h[j : m + j]
                ok = own[:m] == own[n - 1 :]
                if late is not None:
                    ok &= ~late[n - 1 :]
                yield mix(acc[ok]), own[:m][ok]


def _slots(h: np.ndarray, log2: int) -> Iterator[np.ndarray]:
    """Double hashing: HASHES slots for every hash."""
    mask = np.uint64((1 << log2) - 1)
    a, b = h & mask, (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(HASHES):
            yield ((a + np.uint64(j) * b) & mask).astype(np.int64)


class BitmaskFilter:
    """langs: names by bit; tables: for each word of 64 languages a mask for each slot. masks: (n-grams, words)."""

    def __init__(self, langs: list[str], hashes: np.ndarray, masks: np.ndarray, log2: int = SLOTS_LOG2):
        self.langs, self.log2 = langs, log2
        self.tables, false = [], []
        for word in range(-(-len(langs) // 64)):
            own = min(64, len(langs) - 64 * word)
            kind = np.uint8 if own <= 8 else np.uint16 if own <= 16 else np.uint32 if own <= 32 else np.uint64
            table = np.zeros(1 << log2, kind)
            for s in _slots(hashes, log2):
                np.bitwise_or.at(table, s, masks[:, word].astype(kind))
            self.tables.append(table)
            false += [float(np.mean((table >> kind(b)) & kind(1))) ** HASHES for b in range(own)]
        self.false = np.array(false)

    def lookup(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        out = None
        for s in _slots(h, self.log2):
            out = self.tables[word][s] if out is None else out & self.tables[word][s]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 where there is no letter."""
        n, langs = len(texts), len(self.langs)
        total, hit = np.zeros(n), np.zeros((n, langs))
        for h, row in ngrams(texts):
            total += np.bincount(row, minlength=n)
            for word, table in enumerate(self.tables):
                m, one = self.lookup(h, word), table.dtype.type(1)
                for b in range(min(64, langs - 64 * word)):
                    hit[:, 64 * word + b] += np.bincount(row[(m >> table.dtype.type(b)) & one == 1], minlength=n)
        some = np.maximum(total, 1)[:, None]
        true = np.maximum(0, (hit / some - self.false) / np.maximum(1e-9, 1 - self.false))
        best = np.argmax(true, axis=1) if langs else np.zeros(n, int)
        top = true[np.arange(n), best] if langs else np.zeros(n)
        score = np.where(top > 0, top / np.maximum(true.sum(axis=1), 1e-300), 1 / max(1, langs))
        known = (total > 0) & (langs > 0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], np.where(known, np.clip(score, 0, 1), 0.0)


def lettered(texts: list[str | None]) -> np.ndarray:
    """Which texts have a letter."""
    out = np.zeros(len(texts), bool)
    for _, row in ngrams(texts):
        out[row] = True
    return out


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, rows_per_lang: int = TRAIN_ROWS) -> BitmaskFilter:
    """Filters of the languages of the labelled rows (lang not null).

    For each language about rows_per_lang rows are read, drawn by a hash of the key (all, if there are fewer); that
    bounds the table of n-grams, so it may come to the driver, as a row for each language does. Texts without a letter
    teach nothing; repeated rows count as often as they stand. Languages are ordered by their number of rows, so ties go
    to the most common; there may be any number, 64 to a word of the masks.
    """
    rows = labelled.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("g"))
    rows = rows.where("g is not null")
    counts = sorted(((r["n"], r["g"]) for r in rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    langs = [g for _, g in counts]
    if not langs:
        return BitmaskFilter([], np.zeros(0, np.uint64), np.zeros((0, 0), np.uint64))
    share = F.try_element_at(F.create_map(*[F.lit(x) for n, g in counts for x in (g, min(1.0, rows_per_lang / n))]), F.col("g"))
    draw = (F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 20)) / (1 << 20)) < share
    bit = {g: i for i, g in enumerate(langs)}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, tag = batch.column(0).to_pylist(), np.array([bit[g] for g in batch.column(1).to_pylist()], np.int64)
            for s in range(0, len(texts), 50):
                seen = [np.stack([h, row.astype(np.uint64)]) for h, row in ngrams(texts[s : s + 50])]
                if not seen:
                    continue
                h, row = np.concatenate(seen, axis=1)
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
                h, g = h[new], tag[s + row[new].astype(np.int64)]
                order = np.lexsort((g, h))
                h, g = h[order], g[order]
                at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
                n = np.diff(np.r_[at, len(h)])
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(g[at].astype(np.int32)), pa.array(n)], names=["h", "g", "n"])

    drawn = arrow_rows(rows).where(draw)
    size = {bit[r["g"]]: r["n"] for r in drawn.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    grams = drawn.select("t", "g").mapInArrow(count, "h bigint, g int, n bigint").groupBy("h", "g").agg(F.sum("n").alias("n"))
    if not size:
        return BitmaskFilter(langs, np.zeros(0, np.uint64), np.zeros((0, -(-len(langs) // 64)), np.uint64))
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for b, n in size.items() for x in (b, float(n))]), F.col("g"))
    frame = grams.withColumn("r", rate).where(F.col("r") >= MIN_SHARE).select("h", "g", "r").toPandas()
    h, at = np.unique(frame["h"].to_numpy(np.int64), return_inverse=True)
    best = np.zeros(len(h))
    np.maximum.at(best, at, frame["r"].to_numpy(float))
    held = frame["r"].to_numpy(float) >= OF_BEST * best[at]
    masks = np.zeros((len(h), -(-len(langs) // 64)), np.uint64)
    bits = frame["g"].to_numpy(np.uint64)[held]
    np.bitwise_or.at(masks, (at[held], (bits // np.uint64(64)).astype(np.int64)), np.uint64(1) << bits % np.uint64(64))
    return BitmaskFilter(langs, h.view(np.uint64), masks)


def identify(docs: DataFrame, model: BitmaskFilter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of whole texts, one row each, repeats included. Null texts, and texts without a letter, are
    `und` with score 0; so is everything if no language was learned. Other columns are not read; an empty table gives no
    row."""

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            pred: list[str] = []
            value: list[np.ndarray] = []
            for s in range(0, len(texts), 500):
                p, v = model.predict(texts[s : s + 500])
                pred += p
                value.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(np.concatenate(value) if value else np.zeros(0))],
                names=[key, "lang_pred", "score"],
            )

    return arrow_rows(pick(docs, key, text)).mapInArrow(score, f"`{key}` bigint, lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(crc_mod("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
