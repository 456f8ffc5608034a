"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the letter triples they share as subsequences, each occurrence weighted
by ``DECAY`` to the letters it spans, over at most ``SPAN`` letters; so gaps and inserted characters
only lessen it. Words begin and end with marks that count as letters, and runs of single letters
("i d i o t") are one word. A sentence, and so a document, scores as its strongest word does.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class, those with the smallest
hashed ids), cut into sentences, each with its document's label. Few sentences of a toxic document are
toxic, so the machine is trained as a multiple-instance one, in ``ROUNDS`` rounds: the sentences that the
machine so far finds strongest are each toxic document's positive examples (one at least, and up to
``COVER`` that it calls toxic; in the first round ``COVER``), the strongest sentences of each clean document and some by lot are the
negative ones, and a machine is trained on them, a sentence standing as its strongest word. The first
round ranks sentences by the log odds of their triples. Landmarks are chosen by farthest-first in the
kernel; the machine is trained on the Nyström features, by Newton steps on the squared hinge loss, and
its scores are set to probabilities by a logistic fit on documents.
As a score is linear in the landmarks' triples, the trained machine is one table of triple weights.

Defined cases: a null or empty text, or one without letters, gets the score of no evidence; texts of any
length are scored whole; repeated rows score alike; with labels of one class or none, every score is the
share of toxic rows (0 without labels); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import checkpointed, released

DECAY, SPAN = 0.6, 6
#: Labelled documents of each class that training takes at most.
SAMPLE = 3000
#: Landmarks; distinct examples of each class in a round at most, the most frequent ones.
LANDMARKS, EXAMPLES = 320, 1000
#: Sentences of each document that are examples, and rounds of choosing them.
COVER, ROUNDS = 3, 5
#: How much more frequent in toxic documents a toxic example must be; and what is added to the counts of the first round.
PURER, SMOOTH = 10, 8
#: Most frequent toxic examples that are also trained on with a letter inserted; together such forms weigh about as much as the example.
VARIED = 40
#: Words of more letters are no examples.
LONGEST = 64
_SPACE, _JOINER, _MARK = 0, 1, 2
_LETTERS = 64
_CHUNK = 1 << 18
#: What stands between two sentences.
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
#: White space between two words that each have two letters side by side.
_BETWEEN = re.compile(r"[^\W\d_]{2}\S*(\s)(?=\s*\S*[^\W\d_]{2})")
#: Rows of a batch that are scored together.
_ROWS = 256
GAPS = [(a, b) for a, b in product(range(1, SPAN), repeat=2) if a + b < SPAN]


def _classes() -> np.ndarray:
    """Class of each character: 0 space, 1 joiner (any other non-letter), 2 the word mark, from 3 on the letters, case folded; rare letters share classes."""
    out = np.full(0x3000, _JOINER, np.uint8)
    for c in range(0x3000):
        ch = chr(c)
        if ch.isspace():
            out[c] = _SPACE
        elif ch.isalpha():
            low = ch.lower()[0]
            out[c] = 3 + (ord(low) - 97 if "a" <= low <= "z" else 26 + ord(low) % (_LETTERS - 29))
    return out


_CLASS = _classes()


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words of the texts with a mark on either side: classes, number of the word of each, and the text of each word.

    Characters that are not letters are dropped inside a word; a run of single-letter words is one word.
    """
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), "<u4")
    code = np.where(raw < len(_CLASS), _CLASS[np.minimum(raw, len(_CLASS) - 1)], 3 + 26 + raw % (_LETTERS - 29)).astype(np.uint8)
    text_of = np.zeros(len(raw), np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])[:-1]
    np.add.at(text_of, ends[ends < len(raw)], 1)
    text_of = np.cumsum(text_of)
    word = np.cumsum(code == _SPACE)
    letters = np.flatnonzero(code > _MARK)
    code, word, text_of = code[letters], word[letters], text_of[letters]
    if not len(code):
        return np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    size, text = np.diff(np.r_[first, len(code)]), text_of[first]
    joined = np.r_[False, (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])]
    new = first[~joined]
    size, text = np.diff(np.r_[new, len(code)]), text_of[new]
    out = np.full(len(code) + 2 * len(new), _MARK, np.uint8)
    number = np.repeat(np.arange(len(new)), size)
    out[np.arange(len(code)) + 2 * number + 1] = code
    return out, np.repeat(np.arange(len(new)), size + 2), text


def triples(code: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(position of the first letter, triple, weight) for every pattern of gaps."""
    wide = code.astype(np.int32)
    for a, b in GAPS:
        n = len(code) - a - b
        if n <= 0:
            continue
        at = np.flatnonzero(word[:n] == word[a + b :])
        yield at, (wide[at] * _LETTERS + wide[at + a]) * _LETTERS + wide[at + a + b], DECAY ** (a + b)


def word_scores(code: np.ndarray, word: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """Decision value of each of ``n`` words, without the bias."""
    total, norm = np.zeros(n), np.zeros(n)
    for at, t, w in triples(code, word):
        own = word[at]
        total += np.bincount(own, weights[t], n) * w
        norm += np.bincount(own, minlength=n) * (w * w)
    return total / np.sqrt(np.maximum(norm, 1e-12))


def vectors(words: list[str]):
    """Normalised sparse triple vectors of the words, as a dictionary each. A word may hold a sentence's spaced letters."""
    out = []
    for w in words:
        code, word, _ = flatten([w])
        v: dict[int, float] = {}
        norm = 0.0
        for _, t, weight in triples(code, np.zeros_like(word)):
            norm += len(t) * weight * weight
            for x in t.tolist():
                v[x] = v.get(x, 0.0) + weight
        out.append({k: x / norm**0.5 for k, x in v.items()} if norm else {})
    return out


def _dense(vs: list[dict[int, float]], column: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(vs), len(column)), np.float32)
    for i, v in enumerate(vs):
        for k, x in v.items():
            j = column.get(k)
            if j is not None:
                out[i, j] = x
    return out


def train_words(positive: list[str], weight: np.ndarray, negative: list[str]) -> tuple[np.ndarray, float]:
    """Triple weights and bias of the machine from words of toxic sentences (with weights) and of clean ones."""
    pos, neg = vectors(positive), vectors(negative)
    half = min(len(pos), LANDMARKS * 2 // 3)
    marks_from = [*pos, *neg[: 4 * LANDMARKS]]
    column = {k: j for j, k in enumerate(sorted({k for v in marks_from for k in v}))}
    some = _dense(marks_from, column)

    def spread(rows: np.ndarray, n: int) -> list[int]:
        if not len(rows):
            return []
        chosen, near = [0], rows @ rows[0]
        while len(chosen) < min(n, len(rows)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, rows @ rows[chosen[-1]])
        return chosen

    marks = [*spread(some[: len(pos)], half), *(len(pos) + k for k in spread(some[len(pos) :], LANDMARKS - half))]
    land = some[marks]
    values, basis = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = basis[:, keep] / np.sqrt(values[keep])  # K_mm to the power -1/2, up to a rotation
    x = np.concatenate([some[: len(pos)] @ land.T, *(_dense(neg[lo : lo + 2000], column) @ land.T for lo in range(0, len(neg), 2000))]) @ root
    y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
    c = np.r_[weight / weight.sum(), np.full(len(neg), 1.0 / max(1, len(neg)))] * len(y)
    x1, theta, ridge = np.c_[x, np.ones(len(y))], np.zeros(x.shape[1] + 1), np.r_[np.full(x.shape[1], 1.0), 1e-6]
    for _ in range(50):
        hinge = 1 - y * (x1 @ theta)
        on = hinge > 0
        grad = ridge * theta - 2 * (x1[on] * (c[on] * hinge[on] * y[on])[:, None]).sum(0)
        if np.abs(grad).max() < 1e-8 * len(y):
            break
        theta = theta - np.linalg.solve(np.diag(ridge) + 2 * (x1[on] * c[on][:, None]).T @ x1[on], grad)
    table, alpha = np.zeros(_LETTERS**3), root @ theta[:-1]
    for k, a in zip(marks, alpha, strict=True):
        for t, value in marks_from[k].items():
            table[t] += a * value
    return table, float(theta[-1])


def _cut(text: str, at: int) -> int:
    """A place near ``at`` or behind it, between two words with letters side by side, so that no run of single letters is cut."""
    places = [m.start(1) for m in _BETWEEN.finditer(text, at - 4096, at)]
    if places:
        return places[-1]
    later = _BETWEEN.search(text, at)
    return later.start(1) if later else len(text)


def document_values(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Strongest word's decision value per text; -inf without words. Texts are cut between words, so memory is bounded."""
    out = np.full(len(texts), -np.inf)
    held, owners, size = [], [], 0

    def flush() -> None:
        code, word, text = flatten(held)
        if len(text):
            np.maximum.at(out, np.array(owners)[text], word_scores(code, word, len(text), weights))

    for k, t in enumerate(texts):
        lo = 0
        while True:
            hi = len(t) if len(t) - lo <= _CHUNK else _cut(t, lo + _CHUNK)
            held.append(t[lo:hi])
            owners.append(k)
            size += hi - lo
            if size >= _CHUNK:
                flush()
                held, owners, size = [], [], 0
            if hi >= len(t):
                break
            lo = hi
    if held:
        flush()
    return out


class Model:
    """A trained scorer: triple weights, bias, and the logistic that makes a probability."""

    def __init__(self, weights: np.ndarray | None, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.shift)
        value = np.maximum(document_values(texts, self.weights) + self.bias, -3.0)
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that may be examples; words of single letters are joined as in :func:`flatten`."""
    out = []
    for part in _SENTENCE.split(text.lower()):
        words, run = [], ""
        for w in [*part.split(), ""]:
            w = w if w.isalpha() else "".join(filter(str.isalpha, w))
            if len(w) == 1:
                run += w
                continue
            words += [x for x in (run, w) if 1 < len(x) <= LONGEST]
            run = ""
        if words:
            out.append(sorted(set(words)))
    return out


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sentences, toxic) of each labelled text."""
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sentences(t) for t in part.column(0).to_pylist()], pa.list_(pa.list_(pa.string()))), part.column(1)], names=["sentences", "toxic"])


def inserted(word: str) -> list[str]:
    """The word with a letter more between any two of its letters."""
    return [f"{word[:k]}x{word[k:]}" for k in range(1, len(word))]


def _odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(triple, times in clean and in toxic sentences): each word once per sentence."""
    times = np.zeros((2, _LETTERS**3), np.int64)
    held: tuple[list[str], list[str]] = ([], [])
    size = [0, 0]

    def flush(k: int) -> None:
        code, word, _ = flatten(["\n".join(held[k])])
        for _, t, _ in triples(code, word):
            times[k] += np.bincount(t, minlength=_LETTERS**3)
        held[k].clear()
        size[k] = 0

    for b in slices(batches):
        for cut, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for s in cut:
                held[toxic].extend(s)
                size[toxic] += sum(map(len, s))
                if size[toxic] >= _CHUNK:
                    flush(toxic)
    flush(0)
    flush(1)
    some = np.flatnonzero(times.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(times[0, some]), pa.array(times[1, some])], names=["t", "neg", "pos"])


def examples(cut: list[list[str]], toxic: int, weights: np.ndarray, bias: float | None) -> list[tuple[str, float]]:
    """The strongest words, with values, of a document's ``COVER`` strongest sentences; of a clean one ``COVER`` words by lot too. Equal words count once.

    Of a toxic document those above zero, and the strongest in any case; all of them without a bias.
    """
    words = sorted({w for s in cut for w in s})
    if not words:
        return []
    code, word, owner = flatten(words)
    value = np.full(len(words), -np.inf)
    np.maximum.at(value, owner, word_scores(code, word, len(owner), weights) + (bias or 0.0))
    of = dict(zip(words, value.tolist(), strict=True))
    strongest = sorted({max(s, key=lambda w: (of[w], w)) for s in cut}, key=lambda w: (-of[w], w))[:COVER]
    if toxic:
        return [(w, of[w]) for k, w in enumerate(strongest) if not k or bias is None or of[w] > 0]
    lot = sorted(words, key=lambda w: zlib.crc32(w.encode()))[:COVER]
    return [(w, of[w]) for w in dict.fromkeys([*strongest, *lot])]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``_ROWS`` rows, so that few rows at a time are Python objects; what another operator left in the worker goes first."""
    released()
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            yield b.slice(lo, _ROWS)


def held_out(key: str = "doc_id"):
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def _examples(rows: DataFrame, purer: DataFrame, weights: np.ndarray, bias: float | None) -> tuple[dict[str, int], list[str]]:
    """Toxic examples with the number of documents that gave them, and clean ones, the strongest first.

    What stands as often in clean documents is no toxic example, though the strongest of a toxic document.
    """
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [(w, t, v) for cut, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for w, v in examples(cut, t, *shared.value)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["word", "toxic", "value"])

    found = checkpointed(rows.mapInArrow(run, "word string, toxic int, value double").groupBy("word", "toxic").agg(F.count("*").alias("n"), F.max("value").alias("value")))
    toxic = found.where("toxic = 1").join(purer.withColumn("pure", F.lit(True)), "word", "left").orderBy(F.desc_nulls_last("pure"), F.desc("n"), F.desc("value"), "word").limit(EXAMPLES).collect()
    toxic = [r for r in toxic if r["pure"]] or toxic
    clean = found.where("toxic = 0")
    strong = clean.orderBy(F.desc("value"), "word").limit(EXAMPLES // 2).collect()
    usual = clean.orderBy(F.desc("n"), "word").limit(EXAMPLES // 2).collect()
    return {r["word"]: r["n"] for r in toxic}, [r["word"] for r in [*strong, *usual]]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from the labelled rows outside the held-out fifth.

    What reaches the driver is bounded: ids and scores of the sample, a row for each triple, and
    ``2 * EXAMPLES`` words a round.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [r for t in (0, 1) for r in usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    toxic = sum(r["toxic"] for r in chosen)
    if not 0 < toxic < len(chosen):
        return Model(None, 0, 0, float(bool(toxic)))
    sample = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int").coalesce(1)
    # at most 2 x SAMPLE ids are broadcast; equal texts count once
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = checkpointed(rows)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(None, 0, 0, float(bool(n1)))
    cut = checkpointed(rows.select("text", "toxic").mapInArrow(_cut_up, "sentences array<array<string>>, toxic int"))
    words = cut.select("toxic", F.explode(F.array_distinct(F.flatten("sentences"))).alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    purer = checkpointed(words.where(f"pos * {n0} > {PURER} * neg * {n1}").select("word"))
    odds = cut.mapInArrow(_odds, "t int, neg long, pos long").groupBy("t").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    pos, neg = odds["pos"].to_numpy(), odds["neg"].to_numpy()
    weights, bias = np.zeros(_LETTERS**3), None
    share = pos.sum() / (pos.sum() + neg.sum())
    # what is added is shared out as the classes are, so that a triple never seen says nothing
    weights[odds["t"].to_numpy()] = np.log((pos + SMOOTH * share) / share) - np.log((neg + SMOOTH * (1 - share)) / (1 - share))
    negative: dict[str, None] = {}
    for _ in range(ROUNDS):
        positive, clean = _examples(cut, purer, weights, bias)
        if not positive:
            return Model(None, 0, 0, n1 / (n1 + n0))
        negative |= dict.fromkeys(clean)
        words = [w for w in positive if w not in negative] or list(positive)
        forms = {w: float(positive[w]) for w in words}
        for w in words[:VARIED]:
            for v in inserted(w):
                forms.setdefault(v, positive[w] / len(w))
        weights, bias = train_words(list(forms), np.array(list(forms.values())), list(negative))
    table = spark.sparkContext.broadcast(weights)

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            v = document_values([t or "" for t in b.column(0).to_pylist()], table.value) + bias
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(v, -3.0)), b.column(1)], names=["value", "toxic"])

    fitted = rows.select("text", "toxic").mapInArrow(value, "value double, toxic int").toPandas()
    x, y = fitted["value"].to_numpy(), fitted["toxic"].to_numpy(float)
    w = np.ones(len(y))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(w * (p - y) * x).sum() + 0.05 * (a - 4), (w * (p - y)).sum()])
        q = w * p * (1 - p) + 1e-9
        h = np.array([[(q * x * x).sum() + 0.05, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -3, 3)), b - float(np.clip(step[1], -3, 3))
    return Model(weights, bias, max(a, 0.1), b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = shared.value.score([t or "" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = shared.value.score([t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()])
            yield part.filter(pa.array(s < 0.5))

    return docs.mapInArrow(run, docs.schema)
