"""Template residue, filler text, error pages and script notices in the place of content.

Contract: null, empty and blank texts are no residue; every text is read whole; repeated rows of an id count once (an id
is found if any of its rows is); extra columns are never read; an empty table gives an empty result.

A regularised logistic regression on hashed character n-grams, pairs with marks, length and title features and the
novelty of a segment decides. Its weak labels (``weak``: statuses, slots' syntax, general phrases) come from a sample
bounded in characters; no list is asked when a document is judged. For forms that no list has, n-grams are left out at
random in training, so that novelty and shape carry weight too. Novelty is the share of a segment's n-grams that few
distinct segments of the whole corpus hold: copies count once a task, so an error page in a third of all documents is as
new as in one (so a different partitioning of the input may shift a score a little; the same one gives the same scores).
Negatives are drawn by how often they occur, and once more from what the first model takes for residue.
Hosts (sources) can be held out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.functions.keys import eq_key
from skewline.llm.segments import SIZES, D, M, Segments, grams, keys, marks, of_folded, only, packs, per_segment, segments, shape
from skewline.llm.weak import ABOUT, cues, weak_label
from skewline.session import cut

#: characters of the documents that weak labels are taken from, about; negatives drawn by frequency and positives, about; characters a model is fitted on, at most
SAMPLE_CHARS, NEGATIVES, POSITIVES, FIT_CHARS = 40_000_000, 30_000, 20_000, 6_000_000
#: score from which a negative is drawn for the second fit
HARD = -2.5
#: value of the feature of a pair with a mark
MARK = 3.0
#: log-odds from which a segment is residue, chosen by precision on held-out hosts and recall of planted forms
RESIDUE_FROM = -0.7
#: an n-gram in at most 1 + this share of the distinct segments is new, one level for each share; value of a share of new n-grams; n-grams added to a segment's own, none of them new, so that a few characters aren't novel by themselves
NEW, NOVEL, KNOWN = (0.00005, 0.0005, 0.004), 3.0, 8
#: weight of a positive and of a segment that writes about residue; share of the rows whose n-grams are left out in an epoch, and share of n-grams that stay there
POSITIVE, MENTION, DROP, STAY = 32.0, 4.0, 0.5, 0.1
#: columns: n-grams, marks, length classes, title classes, novelty of each size and level by script
_MARKS, _LENGTH = len(SIZES) * D, len(SIZES) * D + M
_TITLE = _LENGTH + 12
_NOVEL = _TITLE + 3
WIDTH = _NOVEL + 2 * len(SIZES) * len(NEW)
#: a one for each level that is reached, 21 bits apart: all levels of a segment are summed at once
_PACKED = np.array([sum(1 << (21 * q) for q in range(n)) for n in range(len(NEW) + 1)], np.int64)
#: counters in a row of the sum over tasks
_ROW = 1 << 12


class _Seen:
    """Keys met before, in sorted runs that double."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def new(self, k: np.ndarray) -> np.ndarray:
        """Whether each key is the first of its kind, here and in all calls before."""
        out = np.zeros(len(k), bool)
        u, first = np.unique(k, return_index=True)
        for run in self.runs:
            at = np.minimum(np.searchsorted(run, u), len(run) - 1)
            fresh = run[at] != u
            u, first = u[fresh], first[fresh]
        out[first] = True
        if len(u):
            self.runs.append(u)
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            self.runs.append(np.sort(np.concatenate([self.runs.pop(), self.runs.pop()])))
        return out


class Counts:
    """In how many places of distinct segments each hashed n-gram occurs."""

    def __init__(self) -> None:
        self.v = np.zeros(_MARKS, np.int64)
        self.segments = self.documents = self.chars = 0
        self.seen = _Seen()

    def add(self, texts: list[str | None]) -> Counts:
        held: list[np.ndarray] = []
        for _, part in packs(texts):
            s = segments(part)
            new = self.seen.new(keys(s))
            self.segments += int(new.sum())
            for h, across in grams(only(s, new)):
                h[across] = _MARKS  # counted apart
                held.append(h)
            if sum(map(len, held)) > 1_000_000:
                self._count(held)
        self._count(held)
        self.documents += len(texts)
        self.chars += sum(len(t) for t in texts if t)
        return self

    def _count(self, held: list[np.ndarray]) -> None:
        if held:
            self.v += np.bincount(np.concatenate(held), minlength=_MARKS + 1)[:_MARKS]
            held.clear()

    def levels(self) -> np.ndarray:
        """For each hashed n-gram at how many of the shares ``NEW`` it counts as new."""
        return sum((self.v <= 1 + q * self.segments).astype(np.uint8) for q in NEW)


def corpus_counts(docs: DataFrame, text: str = "text") -> Counts:
    """Counts over all documents: each task adds up its own counters, whose rows a shuffle sums."""
    src = docs.select(F.col(text).alias("t")).where(F.length(F.trim("t")) > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counts()
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                c.add(b.column(0).slice(a, 1000).to_pylist())
        if c.documents:
            rows = [*c.v.reshape(-1, _ROW), np.array([c.segments, c.documents, c.chars])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], names=["row", "v"])

    def add(t: pa.Table) -> pa.Table:
        m = t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return pa.table({"row": pa.array([t.column("row")[0].as_py()], pa.int32()), "v": pa.array([m.sum(0)], pa.list_(pa.int64()))})

    schema = "row int, v array<long>"
    got = src.mapInArrow(count, schema).groupBy("row").applyInArrow(add, schema).toArrow()
    out = Counts()
    for row, v in zip(got.column("row").to_pylist(), got.column("v")):
        v = v.values.to_numpy()
        if row < _MARKS // _ROW:
            out.v[row * _ROW : (row + 1) * _ROW] = v
        else:
            out.segments, out.documents, out.chars = v.tolist()
    return out


def novelty(s: Segments, packed: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(column, value) of each segment: the share of its n-grams that are new, by size and level; apart for Chinese and Japanese, whose n-grams are rarer. ``found``: its n-grams, if at hand."""
    kanji = np.logical_or.reduceat((s.chars >= 0x3040) & (s.chars <= 0x9FFF), s.at).astype(np.int64)
    for k, (h, across) in enumerate(grams(s) if found is None else found):
        whole = np.maximum(s.size - SIZES[k] + 1, 0) + KNOWN
        new = packed.take(h, mode="clip")
        new[across] = 0
        new = per_segment(s, new)
        for q in range(len(NEW)):
            share = (new >> (21 * q) & (1 << 21) - 1) / whole
            yield _NOVEL + 2 * (k * len(NEW) + q) + kanji, (NOVEL * share).astype(np.float32)


class Model:
    """Weights of all columns; ``levels``: novelty of n-grams in the corpus."""

    def __init__(self, levels: np.ndarray | None = None, w: np.ndarray | None = None) -> None:
        self.levels = np.zeros(_MARKS, np.uint8) if levels is None else levels
        if w is None:  # without positives nothing is residue
            w = np.zeros(WIDTH, np.float32)
            w[_TITLE:_NOVEL] = -10
        self.w = w
        self._packed: np.ndarray | None = None

    @property
    def packed(self) -> np.ndarray:
        """The levels as they are summed, made once where they are used."""
        if self._packed is None:
            self._packed = _PACKED[self.levels]
        return self._packed

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_packed": None}

    def score(self, s: Segments) -> np.ndarray:
        """Log-odds of each segment; those above ``RESIDUE_FROM`` are residue."""
        if not len(s.at):
            return np.zeros(0)
        z, found = np.zeros(len(s.at)), list(grams(s))
        for h, across in found:
            v = self.w.take(h, mode="clip")  # all within
            v[across] = 0
            z += per_segment(s, v)
        n, length, title = shape(s)
        z = z / np.sqrt(np.maximum(n, 1)) + self.w[_LENGTH + length] + self.w[_TITLE + title]
        where, h = marks(s)
        if len(where):
            z += MARK * np.bincount(where, weights=self.w[_MARKS + h], minlength=len(s.at))
        for col, v in novelty(s, self.packed, found):
            z += self.w[col] * v
        return z


def _matrix(s: Segments, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row bounds, columns, values) of the segments' features."""
    n, length, title = shape(s)
    each, one = np.arange(len(s.at)), np.ones(len(s.at), np.float32)
    scale = (1 / np.sqrt(np.maximum(n, 1))).astype(np.float32)
    rows, cols, values = [each, each], [_LENGTH + length, _TITLE + title], [one, one]
    seg = np.repeat(each, s.size)
    for h, across in grams(s):
        inside = np.ones(len(h), bool)
        inside[across] = False
        r = seg[: len(h)][inside]
        rows.append(r)
        cols.append(h[inside])
        values.append(scale[r])
    where, h = marks(s)
    rows.append(where)
    cols.append(_MARKS + h)
    values.append(np.full(len(where), MARK, np.float32))
    for col, v in novelty(s, _PACKED[levels]):
        rows.append(each)
        cols.append(col)
        values.append(v)
    r = np.concatenate(rows).astype(np.int32)
    order = np.argsort(r, kind="stable")
    return np.searchsorted(r[order], np.arange(len(s.at) + 1)), np.concatenate(cols).astype(np.int32)[order], np.concatenate(values)[order]


def fit(s: Segments, y: np.ndarray, times: np.ndarray, weight: np.ndarray, levels: np.ndarray, epochs: int = 14, batch: int = 512, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """L2-regularised logistic regression by adaptive gradient steps over batches, averaged over the later epochs.

    In each epoch a share of the rows lose most of their n-grams; not so negatives met more than once, which are known forms.
    """
    model = Model(levels)
    if not y.any():
        return model
    bounds, cols, values = _matrix(s, levels)
    # only the columns that the rows hold, numbered in their order
    held = np.zeros(WIDTH, bool)
    held[cols] = True
    ngrams, width = int(held[:_MARKS].sum()), int(held.sum())
    cols = (np.cumsum(held, dtype=np.int32) - 1)[cols]
    rng = np.random.default_rng(3)
    w, g2, mean, n = np.zeros(width, np.float32), np.full(width, 1e-4, np.float32), np.zeros(width), 0
    mark = np.zeros(width, bool)
    may = y | (times < 2)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), batch):
            r = order[a : a + batch]
            m = bounds[r + 1] - bounds[r]
            start = np.cumsum(m) - m
            at = np.repeat(bounds[r] - start, m) + np.arange(m.sum())
            c, v = cols[at], values[at]
            out = np.repeat((rng.random(len(r)) < DROP) & may[r], m) & (c < ngrams)
            v = np.where(out & (rng.random(len(c)) > STAY), 0, v)
            z = np.add.reduceat(w[c] * v, start)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[r]) * weight[r] / batch
            mark[c] = True
            used = np.flatnonzero(mark)
            mark[used] = False
            g = np.bincount(c, weights=np.repeat(err, m) * v, minlength=width)[used].astype(np.float32) + l2 * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
        if epoch >= epochs // 2:
            mean += w
            n += 1
    model.w = np.zeros(WIDTH, np.float32)
    model.w[held] = mean / n
    return model


_SAMPLE = "key long, fold int, folded binary, alone boolean, y boolean, about boolean, n long"


def _one() -> list:
    """How the rows of one segment are put together."""
    return [F.min("folded").alias("folded"), F.min("alone").alias("alone"), F.max("y").alias("y"), F.max("about").alias("about"), F.sum("n").alias("n")]


def labelled(docs: DataFrame, doc_id: str, text: str, fold: str | None, share: float) -> DataFrame:
    """(key, fold, folded, alone, y, about, n): distinct segments of a share of the documents (by a hash of the id), with their weak label, whether they write about residue, and their number."""
    d = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))
    d = d.where(F.col("i").isNotNull() & (F.length(F.trim("t")) > 0) & (F.pmod(F.xxhash64(F.lit(11), "i"), F.lit(1_000_000)) < int(share * 1_000_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, str | None] = {}
        for b in batches:
            for a in range(0, b.num_rows, 2000):
                part = b.slice(a, 2000)
                s = segments(part.column(0).to_pylist())
                fold_of = part.column(1).to_numpy()[s.doc] if len(s.doc) else s.doc
                k = keys(s)
                for f in np.unique(fold_of).tolist():
                    mine = np.flatnonzero(fold_of == f)
                    u, first, n = np.unique(k[mine], return_index=True, return_counts=True)
                    at, y = mine[first], []
                    folded = s.folded_of(at)
                    for key, i, chars in zip(u.tolist(), at.tolist(), folded):
                        if key not in known:
                            known[key] = cues(s.raw(i), chars[2:-2].decode("utf-16-le", "replace"))
                        y.append(known[key])
                    if len(known) > 500_000:
                        known.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.full(len(u), f, np.int32)), pa.array(folded, pa.binary()), pa.array(s.alone[at]), pa.array([x not in (None, ABOUT) for x in y], pa.bool_()), pa.array([x == ABOUT for x in y], pa.bool_()), pa.array(n.astype(np.int64))], names=["key", "fold", "folded", "alone", "y", "about", "n"])

    rows = d.select("t", "fold").mapInArrow(run, _SAMPLE)
    return rows.groupBy("key", "fold").agg(*_one())


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: str | None = None, n_folds: int = 1, counts: Counts | None = None, sample_chars: int = SAMPLE_CHARS) -> list[Model]:
    """One model for each fold, trained on the documents of the other folds (with one fold: on all).

    Each model is fitted in a task on at most ``FIT_CHARS`` characters; the driver holds weights and counters only.
    """
    spark = docs.sparkSession
    counts = counts or corpus_counts(docs, text)
    levels = counts.levels()
    models = [Model(levels) for _ in range(n_folds)]
    if not counts.documents:
        return models
    rows = labelled(docs, doc_id, text, fold, min(1.0, sample_chars / max(counts.chars, 1)))
    if n_folds > 1:
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("model")).where("model <> fold")
        rows = rows.groupBy("model", "key").agg(*_one())
    else:
        rows = rows.withColumn("model", F.lit(0)).drop("fold")
    rows = cut(rows.select("model", "key", "folded", "alone", "y", "about", "n"), "residue-sample")
    sums = rows.groupBy("model").agg(F.sum("n").alias("n"), F.sum((F.col("y") | F.col("about")).cast("long")).alias("pos")).collect()  # one row a fold
    rate = {r["model"]: (min(1.0, NEGATIVES / r["n"]), min(1.0, POSITIVES / max(r["pos"], 1))) for r in sums}
    of = lambda k: F.coalesce(*[F.when(F.col("model") == m, F.lit(x[k])) for m, x in rate.items()], F.lit(0.0))
    u = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30)) / float(1 << 30)
    # a form met often is known: its weight rises with the root of its number, so that rare hosts' headings count
    # a text of one segment that comes more than once may be an error page that no list has: it is left unlabelled
    drawn = F.when(F.col("y") | F.col("about"), u < of(1)).when(F.col("alone") & (F.col("n") > 1), False).otherwise(u < of(0) * F.col("n"))
    rows = rows.select("model", "key", "folded", "alone", "y", "n", F.when(F.col("y"), F.lit(POSITIVE)).when(F.col("about"), F.lit(MENTION)).otherwise(F.greatest(F.least(2 * F.sqrt("n") - 1, F.lit(POSITIVE)), of(0) * F.col("n"))).alias("weight"), drawn.alias("drawn"))
    shared = spark.sparkContext.broadcast(levels)  # 2^18 bytes

    def fit_one(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("y", "descending"), ("key", "ascending")])
        n = np.array([len(x) // 2 for x in t.column("folded").to_pylist()], np.int64)
        t = t.slice(0, int(np.searchsorted(np.cumsum(n), FIT_CHARS, "right")))
        col = lambda c: t.column(c).to_numpy()
        s = of_folded(t.column("folded").to_pylist(), col("alone"))
        m = fit(s, col("y").astype(bool), col("n"), col("weight"), shared.value) if t.num_rows else Model()
        return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([pickle.dumps(m.w)], pa.binary())})

    def fit_all(rows: DataFrame) -> list[Model]:
        got = rows.select("model", "key", "folded", "alone", "y", "n", "weight").groupBy("model").applyInArrow(fit_one, "model int, w binary").collect()  # one row a fold
        out = [Model(levels) for _ in range(n_folds)]
        for r in got:
            out[r["model"]].w = pickle.loads(r["w"])
        return out

    first = spark.sparkContext.broadcast([m.w for m in fit_all(rows.where("drawn"))])

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, of_row = np.zeros(b.num_rows), b.column(0).to_numpy()
            for m in np.unique(of_row).tolist():
                at = np.flatnonzero(of_row == m)
                part = b.take(pa.array(at))
                z[at] = Model(shared.value, first.value[m]).score(of_folded(part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False)))
            yield b.filter(pa.array(b.column("drawn").to_numpy(zero_copy_only=False) | ((z > HARD) & ~(b.column("alone").to_numpy(zero_copy_only=False) & (b.column("n").to_numpy() > 1)))))

    return fit_all(rows.mapInArrow(hard, rows.schema).where("not y or drawn"))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, kind, score, n_segments): documents with a segment that the classifier takes for residue; kind and score of the surest.

    The kind is told by the weak labels, ``other`` where they know none; it decides nothing.
    """
    model = model or train(docs, doc_id, text)[0]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 + 2^16 weights, 2^18 bytes
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("doc_id").isNotNull() & (F.length(F.trim("t")) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                docs, kinds, scores = [], [], []
                for first, texts in packs(part.column(1).to_pylist()):
                    s = segments(texts)
                    z = m.score(s)
                    i = np.flatnonzero(z > RESIDUE_FROM)
                    kinds += [weak_label(s.raw(k)) or "other" for k in i.tolist()]
                    docs.append(first + s.doc[i])
                    scores.append(z[i])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(docs))), pa.array(kinds, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["doc_id", "kind", "score"])

    rows = src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, kind string, score double")
    return rows.groupBy("doc_id").agg(F.max(F.struct("score", "kind")).alias("m"), F.count(F.lit(1)).alias("n_segments")).select("doc_id", "m.kind", "m.score", "n_segments")


#: hosts are dealt out to folds on the driver: more than these are refused rather than cut
MAX_HOSTS = 100_000
_COUNTS = ("segments", "weak", "picked", "both")
_VALIDATION = "fold int, hosts string, segments long, weak long, picked long, precision double, recall double"


def validate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", hold: int = 4, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(fold, hosts, segments, weak, picked, precision, recall): the decision on every document of a fold's hosts, by a model of the other hosts trained as in ``found``, against the weak labels."""
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).alias("i"), F.coalesce(eq_key(F.col(host)), F.lit("")).alias("h"), F.col(text).alias("t")).where("i is not null and t is not null")
    hosts = sorted(r["h"] for r in d.select("h").distinct().limit(MAX_HOSTS + 1).collect())
    if len(hosts) > MAX_HOSTS:
        raise ValueError(f"more than {MAX_HOSTS} hosts")
    n_folds = min(hold, len(hosts))
    if not n_folds:
        return spark.createDataFrame([], _VALIDATION)
    d = d.join(F.broadcast(spark.createDataFrame([(h, k % hold) for k, h in enumerate(hosts)], "h string, fold int")), "h")  # at most MAX_HOSTS rows
    names = spark.createDataFrame([(f, ", ".join(hosts[f::hold])) for f in range(n_folds)], "fold int, hosts string")
    # with a single host nothing can be held out: an untrained model picks nothing
    models = train(d, "i", "t", "fold", n_folds, sample_chars=sample_chars) if n_folds > 1 else [Model()]
    shared = spark.sparkContext.broadcast(models)  # hold x (2^18 + 2^16) weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                fold = part.column(2).to_numpy()
                counts = np.zeros((len(_COUNTS), len(fold)), np.int64)
                for f in np.unique(fold).tolist():
                    place = np.flatnonzero(fold == f)
                    counts[:, place] = _against_weak(shared.value[f], part.column(3).take(pa.array(place)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *map(pa.array, counts)], names=["i", "x", "fold", *_COUNTS])

    src = d.select("i", F.xxhash64("t").alias("x"), "fold", "t")
    rows = src.mapInArrow(run, f"i {src.schema['i'].dataType.simpleString()}, x long, fold int, {', '.join(f'{c} long' for c in _COUNTS)}")
    # repeated rows of a document count once
    sums = rows.distinct().groupBy("fold").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    ratio = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    return sums.join(F.broadcast(names), "fold").select("fold", "hosts", "segments", "weak", "picked", ratio("both", "picked").alias("precision"), ratio("both", "weak").alias("recall"))


def _against_weak(model: Model, texts: list[str]) -> np.ndarray:
    """``_COUNTS`` of each text: segments, those with a weak label, those picked, and both."""
    if len(several := [x for _, x in packs(texts)]) > 1:
        return np.concatenate([_against_weak(model, x) for x in several], 1)
    s = segments(texts)
    picked = model.score(s) > RESIDUE_FROM
    seen: dict[str, bool] = {}
    weak = np.zeros(len(picked), bool)
    for i in range(len(picked)):
        raw = s.raw(i)
        if raw not in seen:
            seen[raw] = weak_label(raw) is not None
        weak[i] = seen[raw]
    return np.stack([np.bincount(s.doc[x], minlength=len(texts)) for x in (np.ones(len(picked), bool), weak, picked, picked & weak)])
