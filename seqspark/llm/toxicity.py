"""Toxicity by a convolutional text classifier, trained here in numpy.

Words are hashed to rows of an embedding table; each row remembers the print of
the training word it was given to, so other words that fall on it count as
unknown (a zero row) and long texts gain nothing from chance collisions.  Filters
of several widths run over the whole text, the maximum of each feeds a logistic
output.  The decision threshold is calibrated by language on all labelled rows outside
the fit, of any length, from counts by language, bin of the score and label; the language is read off the text's function words, never off the table, and
is folded into the score, so that 0.5 is the threshold everywhere.

The fit takes a bounded sample of labelled rows (parameters below) on the driver;
scoring runs on all rows with the model broadcast, whose size is fixed.

Defined results: null and empty texts get the score of a text of unknown words;
texts are scored whole whatever their length; repeated rows are scored each; of a
labelled doc_id that repeats, the fit takes the least text; labels that are null or name no document are not used; without both classes among
the labels every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks, text_pieces
from .wordarrays import ALNUM_LOWER, words_of

#: Labelled rows of each class that the fit takes at most, by the hash of their id.
MAX_TOXIC, MAX_CLEAN = 2000, 2500
#: Bins of the logit that thresholds are counted in: from -BIN_RANGE to BIN_RANGE, so many to 1.
BIN_RANGE, BINS_TO_1 = 16, 64
#: Labelled texts longer than this many characters are not fitted on (they are scored like all others).
MAX_TRAIN_CHARS = 6_000
BUCKETS, DIMS, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
STEPS, BATCH, RATE = 350, 48, 0.005

# Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is it that for with as on at by from this are be or an",
    "de": "der die das und ist nicht ein mit von zu den des dem sich auf er sie im",
    "fr": "le la les des et un une que qui dans pour est pas sur au elle avec du",
    "es": "el los las y que de en un por con no su para es al como se del",
}
LANGUAGES = ["", *FUNCTION_WORDS]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS + 1 rows; the last, for unknown words, stays zero
    prints: np.ndarray  # of the word each bucket was given to; 0: none
    filters: list[np.ndarray]  # by width: (width, DIMS, FILTERS)
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: np.ndarray  # logits, by LANGUAGES
    language: np.ndarray  # of function words: hashes, sorted
    language_of: np.ndarray

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
        known = self.prints[bucket] == (hashes >> np.uint64(32)).astype(np.uint32)
        return np.where(known, bucket, BUCKETS)

    def votes(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text the function words of each language, in the order of LANGUAGES."""
        n = len(first) - 1
        slot = np.minimum(np.searchsorted(self.language, hashes), len(self.language) - 1)
        at = np.flatnonzero(self.language[slot] == hashes)
        text = np.searchsorted(first, at, side="right") - 1
        votes = np.bincount(text * len(LANGUAGES) + self.language_of[slot[at]], minlength=n * len(LANGUAGES))
        return votes.reshape(n, len(LANGUAGES))

    def languages(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each text the index of the language with most function words; 0 without any."""
        return self.votes(hashes, first).argmax(1)

    def features(self, rows: np.ndarray, first: np.ndarray, places: bool = False):
        """Maxima of every filter over each text (texts by word bounds), and where they stand."""
        n, filters = len(first) - 1, FILTERS
        out = np.zeros((n, len(WIDTHS) * filters), np.float32)
        where = np.full((n, len(WIDTHS) * filters), -1) if places else None
        x = self.table[rows]
        for k, width in enumerate(WIDTHS):
            if len(rows) < width:
                continue
            m = len(rows) - width + 1
            c = x[:m] @ self.filters[k][0]
            for o in range(1, width):
                c += x[o : o + m] @ self.filters[k][o]
            for t in range(n):
                a, b = first[t], first[t + 1] - width + 1
                if b > a:
                    own = c[a:b]
                    if places:
                        p = own.argmax(0)
                        out[t, k * filters : (k + 1) * filters] = own[p, np.arange(filters)]
                        where[t, k * filters : (k + 1) * filters] = p + a
                    else:
                        out[t, k * filters : (k + 1) * filters] = own.max(0)
        out += np.concatenate(self.biases)
        np.maximum(out, 0, out=out)
        return (out, where) if places else out

    def logits(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.features(self.rows(hashes), first) @ self.output + self.bias


def _empty_model(rng: np.random.Generator) -> Model:
    names, words = zip(*((k, w) for k, ws in enumerate(FUNCTION_WORDS.values(), 1) for w in ws.split()), strict=True)
    hashes, names = words_of([" ".join(words)], ALNUM_LOWER).hash, np.array(names)
    # words of several languages tell nothing
    alone = np.isin(hashes, (u := np.unique(hashes, return_counts=True))[0][u[1] == 1])
    hashes, names = hashes[alone], names[alone]
    order = np.argsort(hashes)
    return Model(
        np.zeros((BUCKETS + 1, DIMS), np.float32),
        np.zeros(BUCKETS, np.uint32),
        [rng.normal(0, 0.3 / w**0.5, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
        np.zeros(len(LANGUAGES)),
        hashes[order],
        names[order],
    )


class _Adam:
    def __init__(self, shape):
        self.m, self.v, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, p: np.ndarray, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        p -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-7)


def kept_rows(labels: np.ndarray) -> np.ndarray:
    """Every sixth row of each class, which the fit leaves to the thresholds."""
    kept = np.zeros(len(labels), bool)
    for y in (0, 1):
        kept[np.flatnonzero(labels == y)[5::6]] = True
    return kept


def fit(texts: list[str], labels: np.ndarray, seed: int = 7, steps: int = STEPS) -> Model | None:
    """A model from labelled texts; its thresholds are those of kept_rows(). None without both classes."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    model = _empty_model(rng)
    words = words_of(texts, ALNUM_LOWER)
    n = len(texts)
    kept = kept_rows(labels)
    # buckets go to the words of most texts first
    text = words.text_of()
    hashes, at = np.unique(words.hash, return_inverse=True)
    pairs = np.unique(at.astype(np.int64) * n + text)
    pairs = pairs[~kept[pairs % n]]
    spread = np.bincount(pairs // n, minlength=len(hashes))
    order = np.argsort(-spread, kind="stable")
    order = order[spread[order] >= 2]
    bucket = (hashes[order] & np.uint64(BUCKETS - 1)).astype(np.int64)
    _, first_of = np.unique(bucket, return_index=True)
    model.prints[bucket[first_of]] = (hashes[order][first_of] >> np.uint64(32)).astype(np.uint32)
    model.table[bucket[first_of]] = rng.normal(0, 0.05, (len(first_of), DIMS)).astype(np.float32)
    # start: the first dimension holds how much more often a word stands in toxic texts (shrunk log odds),
    # and the first filters of width 1 read it
    toxic = np.bincount(pairs // n, weights=labels[pairs % n], minlength=len(hashes))
    fitted = np.array([(~kept & (labels == y)).sum() for y in (0, 1)])
    odds = np.log((toxic + 0.2) / (fitted[1] + 0.4)) - np.log((spread - toxic + 0.2) / (fitted[0] + 0.4))
    odds *= spread / (spread + 4)
    model.table[bucket[first_of], 0] = np.clip(odds[order][first_of] / 3, -0.5, 1)
    model.filters[0][0, 0, : FILTERS // 2] = 1
    model.output[: FILTERS // 2] = 0.6
    model.bias = -2.0
    rows = model.rows(words.hash)

    train = np.flatnonzero(~kept)
    own = [train[labels[train] == y] for y in (0, 1)]
    if not all(map(len, own)):
        return None
    adam = [*(_Adam(f.shape) for f in model.filters), *(_Adam(b.shape) for b in model.biases), _Adam(model.output.shape)]
    pace, filters = np.full((BUCKETS + 1, 1), 1e-6, np.float32), FILTERS
    bias, bias_pace = np.full(1, model.bias, np.float32), _Adam(1)
    for _ in range(steps):
        batch = np.concatenate([rng.choice(own[0], BATCH - BATCH // 3), rng.choice(own[1], BATCH // 3)])
        first = np.concatenate([[0], np.cumsum(words.first[batch + 1] - words.first[batch])])
        r = np.concatenate([rows[words.first[i] : words.first[i + 1]] for i in batch])
        model.bias = float(bias[0])
        f, where = model.features(r, first, places=True)
        p = 1 / (1 + np.exp(-(f @ model.output + model.bias)))
        g = (p - labels[batch]) / len(batch)
        bias_pace.step(bias, np.array([g.sum()], np.float32))
        down = g[:, None] * model.output * (f > 0) * (where >= 0)
        grad_out = f.T @ g + 1e-4 * model.output
        touched, pulls = [], []
        for k, width in enumerate(WIDTHS):
            d, w = down[:, k * filters : (k + 1) * filters], where[:, k * filters : (k + 1) * filters]
            t, q = np.nonzero(d)
            weight, at = d[t, q].astype(np.float32), w[t, q]
            grad = np.zeros_like(model.filters[k])
            for o in range(width):
                row = r[at + o]
                np.add.at(grad[o].T, q, weight[:, None] * model.table[row])
                touched.append(row)
                pulls.append(weight[:, None] * model.filters[k][o].T[q])
            adam[k].step(model.filters[k], grad)
            adam[len(WIDTHS) + k].step(model.biases[k], d.sum(0).astype(np.float32))
        adam[-1].step(model.output, grad_out.astype(np.float32))
        # rows of the table: steps by the size of the pulls so far
        row, pull = np.concatenate(touched), np.concatenate(pulls)
        some, at = np.unique(row, return_inverse=True)
        total = np.zeros((len(some), DIMS), np.float32)
        np.add.at(total, at, pull)
        pace[some] += (total * total).mean(1, keepdims=True)
        model.table[some] -= 0.05 * total / np.sqrt(pace[some])
        model.table[BUCKETS] = 0
    model.bias = float(bias[0])
    _calibrate(model, words, labels, kept)
    return model


def _best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Where fewest rows fall on the wrong side; the middle of the widest such gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    gap = edges[1:] - edges[:-1]
    best = np.flatnonzero(wrong == wrong.min())
    i = best[gap[best].argmax()]
    return float((edges[i] + edges[i + 1]) / 2)


def _calibrate(model: Model, words, labels: np.ndarray, kept: np.ndarray) -> None:
    """Thresholds by language from the kept rows, where a language has enough of both classes."""
    z = np.empty(len(labels))
    for lo in range(0, len(labels), 256):
        hi = min(lo + 256, len(labels))
        a, b = words.first[lo], words.first[hi]
        z[lo:hi] = model.logits(words.hash[a:b], words.first[lo : hi + 1] - a)
    language = model.languages(words.hash, words.first)
    if 0 < labels[kept].sum() < kept.sum():
        model.thresholds[:] = np.clip(_best_threshold(z[kept], labels[kept]), -3, 3)
    for k in range(len(LANGUAGES)):
        own = kept & (language == k)
        if labels[own].sum() >= 8 and (1 - labels[own]).sum() >= 8:
            model.thresholds[k] = np.clip(_best_threshold(z[own], labels[own]), -3, 3)


def held_out_column(doc_id: str = "doc_id"):
    """Rows that the fit never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of labelled rows outside the held-out fold, calibrate on all others outside it.

    The sample is chosen by id hash among the labelled rows that are short enough,
    from ids alone, so the texts of the other rows are not moved to the driver.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out_column())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("turn", F.xxhash64("doc_id"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = texts.where(F.length("text") <= MAX_TRAIN_CHARS).select("doc_id").join(known, "doc_id").groupBy("doc_id", "toxic", "turn").agg(F.count("*"))
    one = short.where("toxic = 1").orderBy("turn").limit(MAX_TOXIC)
    zero = short.where("toxic = 0").orderBy("turn").limit(MAX_CLEAN)
    chosen = F.broadcast(one.unionAll(zero).select("doc_id", "toxic"))  # MAX_TOXIC + MAX_CLEAN rows at most
    rows = (
        texts.where(F.length("text") <= MAX_TRAIN_CHARS)
        .join(chosen, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("text", "ascending")])
    )
    toxic = rows.column("toxic").to_numpy()
    model = fit(rows.column("text").to_pylist(), toxic)
    if model is None:
        return None
    fitted = set(np.asarray(rows.column("doc_id"))[~kept_rows(toxic)].tolist())
    seen = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in fitted], "doc_id long"))
    calibrate(model, texts.where(~held_out_column()), known.select("doc_id", "toxic").join(seen, "doc_id", "left_anti"))
    return model


def calibrate(model: Model, texts: DataFrame, labels: DataFrame) -> None:
    """Thresholds by language from all texts (doc_id, text) with a label (doc_id, toxic), whole and of any length.

    Texts are scored where they are read; ids and bins are joined.  Only counts by language, bin of the logit and label come to the driver, whose
    number is fixed.  A language with fewer than 8 rows of a class gets the threshold
    of all rows; without both classes the thresholds stay.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in text_blocks(batches, _BLOCK_CHARS):
            z, language = _logits(shared.value, found)
            bins = np.floor(np.clip(z, -BIN_RANGE, BIN_RANGE - 1e-6) * BINS_TO_1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(language.astype(np.int32)), pa.array(bins)], names=["doc_id", "language", "bin"])

    binned = texts.mapInArrow(run, "doc_id long, language int, bin int").join(labels, "doc_id")
    counts = binned.groupBy("language", "bin", "toxic").agg(F.count("*").alias("n")).collect()
    table = np.zeros((len(LANGUAGES), 2, 2 * BIN_RANGE * BINS_TO_1))
    for r in counts:
        table[r.language, r.toxic, r.bin + BIN_RANGE * BINS_TO_1] += r.n
    whole = table.sum(0)
    if not whole.sum(1).all():
        return
    for k in range(len(LANGUAGES)):
        model.thresholds[k] = _threshold_of_counts(table[k] if table[k].sum(1).min() >= 8 else whole)


def _threshold_of_counts(counts: np.ndarray) -> float:
    """Where fewest rows fall on the wrong side; the middle of the widest such gap. counts: (label, bin)."""
    wrong = np.concatenate([[0], np.cumsum(counts[1])]) + np.concatenate([np.cumsum(counts[0][::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())  # edges below the bins
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    widest = max(runs, key=len)
    return float((widest[0] + widest[-1]) / 2 / BINS_TO_1 - BIN_RANGE)


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField("language", T.StringType()),
    ]
)


def _logits(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language of each text; a long one is read in pieces, whose maxima and votes are united."""
    z, language = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    long = [i for i, t in enumerate(texts) if t is not None and len(t) > PIECE_CHARS]
    if len(long) < len(texts):
        some = [i for i in range(len(texts)) if i not in set(long)] if long else range(len(texts))
        words = words_of([texts[i] for i in some], ALNUM_LOWER)
        z[some], language[some] = model.logits(words.hash, words.first), model.languages(words.hash, words.first)
    for i in long:
        best, votes, held = None, 0, np.zeros(0, np.uint64)
        for piece in text_pieces(texts[i], PIECE_CHARS):
            own = words_of([piece], ALNUM_LOWER)
            votes = votes + model.votes(own.hash, own.first)
            held = np.concatenate([held, own.hash])
            if len(held) >= max(WIDTHS):  # windows over the cut are in the next piece's
                f = model.features(model.rows(held), np.array([0, len(held)]))
                best = f if best is None else np.maximum(best, f)
                held = held[1 - max(WIDTHS) :]
        if best is None:
            best = model.features(model.rows(held), np.array([0, len(held)]))
        z[i], language[i] = (best @ model.output + model.bias)[0], votes.argmax(1)[0]
    return z, language


def _scores(model: Model | None, texts: list) -> tuple[np.ndarray, np.ndarray]:
    if model is None:
        return np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    z, language = _logits(model, texts)
    z -= model.thresholds[language]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40))), language


#: Longer texts are scored piece by piece.
PIECE_CHARS = 2_000_000
_BLOCK_CHARS = 500_000  # so that activations stay in cache


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per document: score, predicted (score >= 0.5), and the language read off its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches, _BLOCK_CHARS):
            s, language = _scores(shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([LANGUAGES[k] for k in language.tolist()], pa.string())],
                names=SCHEMA.names,
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all their columns, that the classifier does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in text_blocks(batches, _BLOCK_CHARS):
            yield block.filter(pa.array(_scores(shared.value, texts)[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
