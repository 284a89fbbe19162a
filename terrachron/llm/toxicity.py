"""Toxicity by weak supervision.

Many voters look at a text: word lists that are given, word lists mined from labelled rows, and patterns (insults that are
addressed, heaped or shouted, masked words, runs of marks, no listed word at all). A row's votes are made by lists that
were mined without its own label: the labelled rows are parted into FOLDS, and a row meets the lists of the other folds;
rows without a label meet those of all. A generative model of the votes (two classes; each voter fires with its own
chance in either class) estimates the voters' accuracies; pairs of voters that fire together more
than the classes explain are taken as correlated, and their evidence is shared out. A list is of one language or another,
so a voter that does not fire abstains. The model's posteriors, not the labels, then train a linear classifier over words
and word beginnings, which scores every text. Labels serve for two things only: mining the lists, and the class balance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, crc_mod, pick, read_table, stored
from .textnp import Words, binary_parts, mix, slices

#: Labelled rows that the lists are mined from, and rows without a label that vote besides; each drawn by a hash of the id.
TRAIN_ROWS, UNLABELLED_ROWS = 20_000, 10_000
FOLDS = 4
#: Least deviation of a feature, in standard errors: beyond what the best of a million idle features reaches.
STRONG = 5.5
#: Least share of toxic rows among a listed feature's rows.
SHARE = 0.8
#: Both for the classifier's features, which are weighed against each other.
FEATURE_STRONG, FEATURE_SHARE = 4.0, 0.4
#: Mined lists, by strength.
LISTS = 12
#: Byte lengths of the word beginnings that count as features besides the whole words.
STEMS = (4, 5, 6, 7)

#: Given lists: common insults, one list a kind and language. Fixed values.
GIVEN = {
    "en, contempt": "idiot idiots moron morons imbecile imbeciles cretin dimwit halfwit dunce fool fools dumb stupid stupidity brainless clown clowns loser losers",
    "en, disgust": "disgusting scum filth filthy vermin trash garbage pathetic worthless vile repulsive pig pigs rat rats scumbag degenerate",
    "en, abuse": "bastard bastards bitch shit shitty bullshit crap asshole ass dick fuck fucking fucker damn whore slut",
    "de": "idiot idioten dummkopf trottel depp blödmann arschloch scheiße scheiß abschaum dreck drecksau versager schwachkopf hurensohn widerlich erbärmlich",
    "fr": "idiot idiote imbécile crétin crétine abruti connard connasse salaud salope merde ordure débile minable raclure dégoûtant",
    "es": "idiota idiotas imbécil estúpido estúpida tonto pendejo cabrón mierda basura escoria asqueroso inútil payaso gilipollas patético",
}
#: Patterns over the lower-cased words and the raw text.
_ADDRESS = {"you", "your", "youre", "u", "du", "dich", "ihr", "tu", "te", "toi", "vous", "tú", "eres", "usted"}
_MASKED = re.compile(r"[^\W\d_][*@#$]+[^\W\d_]")
_MARKS = re.compile(r"[!?]{3,}")
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("addressed", "heaped", "shouted", "masked", "marks")

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256), 39]] = True


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words (letters, A-Z lower-cased) and word beginnings of texts, repeats included."""
    w = Words(data, offs, _LETTERS)
    out, own = [mix(w.hashes(), 1)], [w.doc]
    size = w.end - w.start
    for n in STEMS:
        long = size > n
        s = w.start[long]
        out.append(mix(w.hashes(s, s + n), 100 + n))
        own.append(w.doc[long])
    return np.concatenate(out), np.concatenate(own)


def given_votes(text: str) -> list[int]:
    """Votes of the given lists and of the patterns, in the order of GIVEN and PATTERNS."""
    raw = _WORD.findall(text)
    words = [w.lower() for w in raw]
    lists = [set(v.split()) for v in GIVEN.values()]
    own = set(words)
    votes = [int(not own.isdisjoint(s)) for s in lists]
    bad = set().union(*lists)
    at = [i for i, w in enumerate(words) if w in bad]
    near = any(w in _ADDRESS for i in at for w in words[max(0, i - 3) : i + 4])
    shout = sum(len(w) > 2 and w.isupper() for w in raw)
    return [*votes, int(near), int(len(at) >= 2), int(shout >= 5 and 4 * shout >= len(raw)), int(bool(_MASKED.search(text))), int(bool(_MARKS.search(text)))]


def _feature_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fold, y, text) to (id, fold, y, votes of the given, features)."""
    for batch in it:
        texts = batch.column(3)
        data, offs = binary_parts(texts)
        for i, j in slices(offs):
            h, own = features(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            order = np.lexsort((h, own))
            h, own = h[order], own[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (own[1:] != own[:-1])][: len(h)]
            h, own = h[new], own[new]
            at = np.searchsorted(own, np.arange(j - i + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            votes = pa.array([given_votes(t or "") for t in texts.slice(i, j - i).to_pylist()], pa.list_(pa.int32()))
            first = [batch.column(c).slice(i, j - i) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*first, votes, lists], names=["id", "fold", "y", "g", "f"])


class LabelModel:
    """Two-class model of votes: each voter's chance to fire by class, and weights that share out the evidence of
    correlated voters. Not to fire is an abstention and says nothing of the class; `against` marks the voters that
    speak for the negative class. The class balance is given: rows on which all abstain would otherwise draw it away."""

    def __init__(self, balance: float, rounds: int = 40):
        self.prior, self.rounds = float(np.clip(balance, 1e-4, 1 - 1e-4)), rounds

    def fit(self, votes: np.ndarray, against: np.ndarray, anchor: np.ndarray | None = None) -> LabelModel:
        """votes: (rows, voters) of 0 and 1. anchor: the known classes of some rows, NaN for the others. The rounds start
        from the anchor (without one, from the number of votes), whose rows weigh together as much as all the others, so
        that a voter that fires alone, but at random, isn't taken at its word."""
        n, k = votes.shape
        v, self.against = votes.astype(float), against
        self.weight = np.ones(k)
        known = np.zeros(n, bool) if anchor is None else ~np.isnan(anchor)
        if known.any() and 0 < anchor[known].sum() < known.sum():
            share, q = np.where(known, max(1.0, (n - known.sum()) / known.sum()), 1.0), np.where(known, anchor, 0.0)
            self._estimate(v, q, known.astype(float))
        else:
            known, share = np.zeros(n, bool), np.ones(n)
            q = np.clip(0.5 + 0.2 * (v[:, ~against].sum(axis=1) - 2 * v[:, against].sum(axis=1)), 0.02, 0.98)
            self._estimate(v, q, share)
        for step in range(self.rounds):
            q = np.where(known, q, self.posterior(votes))
            self._estimate(v, q, share)
            if step % 10 == 9 and n > 1 and k:
                self.weight = 1 / (1 + self._shared(v, q))
        return self

    def _estimate(self, v: np.ndarray, q: np.ndarray, share: np.ndarray) -> None:
        one, zero = q * share, (1 - q) * share
        self.fire = np.clip(np.stack([(zero @ v + 0.5) / (zero.sum() + 1), (one @ v + 0.5) / (one.sum() + 1)]), 1e-4, 1 - 1e-4)

    def accuracies(self) -> np.ndarray:
        """Chance that the class is the one that a voter speaks for, where it fires."""
        one = self.prior * self.fire[1] / (self.prior * self.fire[1] + (1 - self.prior) * self.fire[0])
        return np.where(self.against, 1 - one, one)

    def _shared(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For each voter the sum of its correlations with others within the classes, as far as beyond chance."""
        total = np.zeros((v.shape[1], v.shape[1]))
        for c, w in ((0, 1 - q), (1, q)):
            r = (v - self.fire[c]) * np.sqrt(w)[:, None]
            cov = r.T @ r / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            r = cov / np.outer(sd, sd)
            total = np.maximum(total, np.where(r > max(0.5, 4 / np.sqrt(max(w.sum(), 1))), r, 0))
        np.fill_diagonal(total, 0)
        self.correlation = total
        return total.sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        says = np.log(self.fire[1]) - np.log(self.fire[0])
        says = np.where(self.against, np.minimum(says, 0), np.maximum(says, 0)) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ says
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Toxicity:
    """Weights of features (sorted hashes) and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.slots = np.zeros(1 << 16, bool)
        self.slots[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        z = np.full(n, self.bias)
        if len(self.hashes):
            h, own = features(data, offs)
            may = self.slots[(h >> np.uint64(48)).astype(np.int64)]
            h, own = h[may], own[may]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            pair = np.unique(own[hit] * len(self.hashes) + at[hit])
            z += np.bincount(pair // len(self.hashes), self.weights[pair % len(self.hashes)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: np.ndarray, cols: np.ndarray, n: int, k: int, target: np.ndarray, l2: float = 0.03, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Weights and bias on 0/1 features (coordinate lists), by gradient steps scaled by the features' curvature."""
    w, bias = np.zeros(k), float(np.log(np.clip(target.mean(), 1e-4, 0.9999) / (1 - np.clip(target.mean(), 1e-4, 0.9999))))
    seen, momentum = np.bincount(cols, minlength=k), np.zeros(k)
    width = np.bincount(rows, minlength=n)
    scale = 1 / (l2 + 0.25 * seen * max(1.0, float(np.percentile(width, 90)) if n else 1.0))
    for _ in range(steps):
        z = bias + np.bincount(rows, w[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(cols, (target - p)[rows], minlength=k) - l2 * w
        momentum = 0.9 * momentum + g * scale
        w += momentum
        if np.abs(momentum).max() < 1e-3:
            break
        bias += float((target - p).mean() / max(0.02, (p * (1 - p)).mean()) * 0.3)
    return w, bias


def _by_row(rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each column, as (starts, rows in order of column)."""
    order = np.argsort(cols, kind="stable")
    return np.searchsorted(cols[order], np.arange(n + 1)), rows[order]


def mined_lists(rows: np.ndarray, cols: np.ndarray, n: int, strength: np.ndarray) -> np.ndarray:
    """The list of each feature (-1 where the strength is not above 0): features that mostly stand in the same texts (a
    word and its beginnings) go to the same one, and families of like strength too, so that a list has one accuracy.
    rows, cols: the texts' features, by text."""
    k = len(strength)
    seen, cut = np.bincount(cols, minlength=k), np.searchsorted(rows, np.arange(n + 1))
    start, texts = _by_row(rows, cols, k)
    family, families = np.full(k, -1), 0
    for f in np.argsort(-strength, kind="stable"):
        if family[f] >= 0 or strength[f] <= 0:
            continue
        own = texts[start[f] : start[f + 1]]
        size = cut[own + 1] - cut[own]
        at = np.repeat(cut[own] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(own) else np.zeros(0, int)
        other, both = np.unique(cols[at.astype(int)], return_counts=True)
        near = other[(both >= 0.7 * np.minimum(seen[other], seen[f])) & (family[other] < 0) & (strength[other] > 0)]
        family[near] = family[f] = families
        families += 1
    return np.where(family >= 0, family * min(LISTS, families) // max(families, 1), -1)


def telling(p, n, pos, size, strong: float = STRONG, share: float = SHARE):
    """Strength of a feature that stands in n of size rows, p of the pos toxic ones (its deviation from the base rate in
    standard errors), and whether that is over `strong` and this share of its rows is toxic. Columns or arrays."""
    base = pos / size
    z = (p - n * base) / (n * base * (1 - base) + 0.25) ** 0.5
    return z, (n >= 3) & (z > strong) & (p >= share * (n + 1))


def _reduced(sample: DataFrame, hs: np.ndarray) -> pa.Table:
    """The sample's rows with the places of their features in hs (sorted) only."""

    def reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lists = batch.column(4)
            own = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            v = np.asarray(lists.flatten()).view(np.uint64)
            at = np.minimum(np.searchsorted(hs, v), max(len(hs) - 1, 0))
            hit = hs[at] == v if len(hs) else np.zeros(len(v), bool)
            cut = np.searchsorted(own[hit], np.arange(len(lists) + 1))
            f = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(at[hit].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(4)], f], names=["id", "fold", "y", "g", "f"])

    return sample.mapInArrow(reduce, "id bigint, fold int, y int, g array<int>, f array<int>").toArrow().combine_chunks().sort_by("id")


def _pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = table.column("f").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if not len(table):
        return np.zeros(0, int), np.zeros(0, int)
    return np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten()).astype(np.int64)


def votes_of(rows: np.ndarray, cols: np.ndarray, fold: np.ndarray, given: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (texts, voters) and which voters speak for the negative class. strength: (FOLDS + 1, features), those of the
    lists mined without a fold, and of all labelled rows; a text of fold q meets strength[q]."""
    n, k = len(fold), strength.shape[1]
    mined, several = np.zeros((n, LISTS)), np.zeros(n)
    for q in range(FOLDS + 1):
        which = mined_lists(rows, cols, n, strength[q])
        own = (fold[rows] == q) & (which[cols] >= 0) if k else np.zeros(len(rows), bool)
        mined[rows[own], which[cols[own]]] = 1
    several = mined.sum(axis=1)
    votes = np.concatenate([given, mined, (several >= 2)[:, None], ((several == 0) & (given[:, : len(GIVEN)].sum(axis=1) == 0))[:, None]], axis=1)
    return votes.astype(float), np.arange(votes.shape[1]) == votes.shape[1] - 1


def learn(labelled: DataFrame, label: str = "label", text: str = "text", key: str = "doc_id", *, rows: int = TRAIN_ROWS, unlabelled: DataFrame | None = None, unlabelled_rows: int = UNLABELLED_ROWS) -> Toxicity:
    """Fit on about `rows` of the labelled rows (all, if fewer) and `unlabelled_rows` of the unlabelled (columns key and
    text), drawn by a hash of the key; null labels teach nothing.

    The samples are what bounds the driver's work: their features are counted on the executors, and only the telling ones
    (see `telling`), with the sample's rows of them, come to the driver. Repeated rows count as often as they are there;
    null and empty texts have no feature. With fewer than two classes the score is the class that there is, or 0.1
    without any label.
    """
    spark = labelled.sparkSession
    base = labelled.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{label}`").cast("int").alias("y"), F.col(f"`{text}`").alias("t")).where("y is not null")
    by = {r["y"]: r["n"] for r in base.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(by.values())
    none = np.zeros(0, np.uint64)
    if n == 0:
        return Toxicity(none, np.zeros(0), float(np.log(0.1 / 0.9)))
    if len(by) < 2:
        return Toxicity(none, np.zeros(0), 5.0 if 1 in by else -5.0)

    def drawn(df: DataFrame, total: int, most: int) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("k", F.lit(29)), F.lit(1 << 20)) < int(min(1.0, most / max(total, 1)) * (1 << 20)))

    fold = F.pmod(F.xxhash64("k", F.lit(31)), F.lit(FOLDS)).cast("int")
    all_rows = drawn(base, n, rows).select(fold.alias("fold"), "y", "t")
    if unlabelled is not None:
        free = unlabelled.select(F.col(f"`{key}`").cast("string").alias("k"), F.lit(None).cast("int").alias("y"), F.col(f"`{text}`").alias("t"))
        all_rows = all_rows.unionByName(drawn(free, free.count(), unlabelled_rows).select(F.lit(FOLDS).alias("fold"), "y", "t"))
    numbered = all_rows.select(F.monotonically_increasing_id().alias("id"), "fold", "y", "t")
    sample = stored(arrow_rows(numbered).mapInArrow(_feature_rows, "id bigint, fold int, y int, g array<int>, f array<bigint>"), "tox-sample")
    known = sample.where("y is not null")
    sizes = {r["fold"]: (r["p"], r["n"]) for r in known.groupBy("fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).collect()}
    pos, size = sum(p for p, _ in sizes.values()), sum(m for _, m in sizes.values())
    if not pos or pos == size:
        return Toxicity(none, np.zeros(0), 5.0 if pos else -5.0)
    # of each feature, its rows and toxic rows by fold: what a list mined without a fold saw is the rest
    sums = [F.sum(F.when(F.col("fold") == q, v).otherwise(0)).alias(f"{c}{q}") for q in range(FOLDS) for c, v in (("p", F.col("y")), ("n", F.lit(1)))]
    counts = known.select("fold", "y", F.explode("f").alias("h")).groupBy("h").agg(*sums)
    whole = {c: sum(F.col(f"{c}{q}") for q in range(FOLDS)) for c in "pn"}
    seen = []
    for q in range(FOLDS + 1):
        lp, ln = sizes.get(q, (0, 0))
        without = {c: whole[c] - F.col(f"{c}{q}") if q < FOLDS else whole[c] for c in "pn"}
        if not 0 < pos - lp < size - ln:
            seen.append(F.lit(0.0))
            continue
        z, ok = telling(without["p"], without["n"], pos - lp, size - ln)
        seen.append(F.when(ok, z).otherwise(0.0))
    top = counts.select("h", F.array(*seen).alias("z")).where(F.exists("z", lambda z: z > 0)).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    strength = np.stack(top["z"].to_list()).T[:, order] if len(h) else np.zeros((FOLDS + 1, 0))
    got = _reduced(sample, h[order])
    r, c = _pairs(got)
    given = np.array(got.column("g").to_pylist(), float)
    votes, against = votes_of(r, c, np.asarray(got.column("fold")), given, strength)
    y = got.column("y").to_pandas().to_numpy(float)
    target = LabelModel(pos / size).fit(votes, against, np.where(np.asarray(got.column("fold")) == 0, y, np.nan)).posterior(votes)

    # the classifier's features are those that tell the posteriors apart, in all the sample
    ids = np.asarray(got.column("id"))
    soft = spark.createDataFrame(pa.table({"id": ids, "q": target}))
    mass, m = float(target.sum()), len(target)
    weighed = sample.select("id", "f").join(soft, "id").select("q", F.explode("f").alias("h")).groupBy("h").agg(F.sum("q").alias("p"), F.count(F.lit(1)).alias("n"))
    _, ok = telling(F.col("p"), F.col("n"), mass, m, FEATURE_STRONG, FEATURE_SHARE)
    hs = np.sort(weighed.where(ok).select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    if not len(hs):
        return Toxicity(none, np.zeros(0), float(np.log(pos / (size - pos))))
    r, c = _pairs(_reduced(sample, hs))
    w, bias = _logistic(r, c, m, len(hs), target)
    return Toxicity(hs, w, bias)


def score(docs: DataFrame, model: Toxicity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of whole texts, one row each, repeats included; null and empty texts get the score of no evidence, equal
    texts equal scores, an empty table no row."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = binary_parts(batch.column(1))
            out = [model.scores(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in slices(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(out) if out else np.zeros(0))], names=[key, "score"])

    return arrow_rows(pick(docs, key, text)).mapInArrow(rows, f"`{key}` bigint, score double")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    mine = crc_mod("doc_id", 5) != 0
    known = pick(labels, "doc_id", "toxic").where(mine & F.col("toxic").isNotNull())
    texts = pick(docs, "doc_id", "text").where(mine)
    train = texts.join(known, "doc_id").withColumnRenamed("toxic", "label")
    found = score(docs, learn(train, unlabelled=texts.join(known, "doc_id", "left_anti")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
