"""Subject areas of documents (problem 10).

Every text is read once into the hashed words of its sentences; code, stack traces and quoted
names are left out. A word has a slot of its own in the vocabulary when it is among the
``OWN`` of most documents, else it shares one of ``SHARED`` slots by its hash, so none is
dropped. Slots are weighted by frequency, by rarity and by how far the subjects of the
labelled documents that hold them differ from the subjects at large. A truncated singular
value decomposition of the weighted document-term matrix is found by a randomised range finder:
each pass multiplies a thin matrix by the whole corpus inside the tasks, and the sums come
back in two levels. Documents and their sentences are placed by the right singular vectors.

Labelled documents give the seed centroids, one per subject and language; centroids are
refined by reassigning all documents to their nearest one, for ``ROUNDS`` rounds or until they
rest. A document's
subjects are read from its sentences by cosine similarity: each speaks for the subject of its
nearest centroid when that one leads clearly, and subjects with enough of the document's voice
are its own, the strongest one at least; where no sentence speaks, the document's own cosine
decides. Sentences that only mention a thing are told by a linear model of their words other
than the topical ones, fitted on at most ``SAMPLE`` labelled documents: those in which a
sentence speaks for a subject that isn't the document's.

Defined results: null and blank texts have no subject; labels of unknown documents or
subjects are ignored; without any label there is no result; a text without a word has no
subject; repeated ids count once; ties go to the subject first in the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.runtime import stow

WORD_BITS = 18
OWN, SHARED = 16_384, 1_024
RANK = 128
PASSES = 2
ROUNDS, REST = 2, 1e-3
SMOOTH = 2.0
LEAD = 0.4
WEAK = 0.4
SHARE = 0.2
CLEAR = 0.1
#: Languages of most labelled documents that have centroids of their own; the others share one a subject.
LANGUAGES = 8
#: Labelled documents that the model of mentions is fitted on, at most (the least hashes of their ids).
SAMPLE = 8_000
CONTEXT_BITS = 16
#: Passes over the sentences, and gradient steps at least.
EPOCHS, STEPS = 4, 400
#: Words of more weight than this are what a sentence is about; the model of mentions doesn't see which.
TOPICAL = 1.0
CHUNK = 256
SLICE = 512  # documents multiplied at once, to bound a task's memory
FAN = 64  # groups that the sums of tasks go through on their way to one

BREAK = -1
_FENCED = re.compile(r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)")
_QUOTED = re.compile(r"`[^`\n]*+`")
_SPEAKER = r"(?:(?:(?:tool|user|agent|assistant|system)[ \t]*[>:]|[#>*-]+)[ \t]*)?"
#: Lines of a program or a stack trace say nothing about the subject.
_MACHINE = re.compile(
    rf"(?m)^[ \t]*{_SPEAKER}(?:Traceback \(|File \"|at \S+\(|[A-Za-z_.]*(?:Error|Exception): |[+\-@]{{2,}} |[\w.]+\([^)\n]*\);?$|[\w.-]+$|[^\w\n]+$"
    r"|(?:return|raise|assert|import|from|def|class|if|for|with|let|const|var|func)\b[^\n\[\](){}=;:]*[\[\](){}=;:])[^\n]*$"
)
_TURN = re.compile(r"(?m)^[ \t]*(?:tool|user|agent|assistant|system)[ \t]*[>:]")
_WORD = re.compile(r"[^\W\d_]{2,}(?:['’-][^\W\d_]+)*")
_PATH = re.compile(r"(?:[\w.-]+/)+[\w.-]+")
_END = re.compile(r"[.!?][\"'”»)\]]*$")


class _Ids(dict):
    """What stands between two spaces -> the hashed words in it, made when first asked for; an end of a sentence adds a break."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        bare = _PATH.sub(" ", token) if "/" in token else token
        found = [zlib.crc32(w.encode("utf-8", "replace")) & ((1 << WORD_BITS) - 1) for w in _WORD.findall(bare)]
        if token == _LINE or _END.search(token):
            found.append(BREAK)
        self[token] = told = tuple(found)
        return told


_LINE = "\0"  # stands for the end of a line


def said(text: str, ids: _Ids) -> list[int]:
    """The hashed words of a text's prose, with breaks between sentences."""
    if "```" in text:
        text = _FENCED.sub("\n", text)
    text = _TURN.sub("\n", _MACHINE.sub("\n", text))
    if "`" in text:
        text = _QUOTED.sub(" ", text)
    return list(chain.from_iterable(map(ids.__getitem__, text.lower().replace("\n", f" {_LINE} ").split())))


def read(documents: DataFrame) -> DataFrame:
    """doc_id, lang, said of every document with a word."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for pdf in batches:
            if len(ids) > 1_000_000:
                ids.clear()
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "said": [said(t, ids) for t in pdf["text"]]})
            yield out[[any(x >= 0 for x in s) for s in out["said"]]]

    return documents.select("doc_id", "lang", "text").mapInPandas(words, "doc_id long, lang string, said array<int>")


class Words(NamedTuple):
    """The words of a batch: their document, sentence and slot, and the document of each sentence."""

    doc: np.ndarray
    sentence: np.ndarray
    slot: np.ndarray
    of: np.ndarray
    n_docs: int


def unpacked(batch: pa.RecordBatch, slot_of: np.ndarray) -> Words:
    lists = batch.column(batch.schema.get_field_index("said"))
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    word = flat >= 0
    begins = np.cumsum(~word)  # breaks before each place
    doc, number = doc[word], begins[word]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])] if len(doc) else np.zeros(0, dtype=bool)
    return Words(doc, np.cumsum(new) - 1, slot_of[flat[word]], doc[new], len(sizes))


class Matrix(NamedTuple):
    """Unit rows of weighted slots, flattened; ``norm`` is the length each row had."""

    row: np.ndarray
    slot: np.ndarray
    weight: np.ndarray
    norm: np.ndarray


def matrix(row: np.ndarray, slot: np.ndarray, n_rows: int, weights: np.ndarray) -> Matrix:
    """Rows of (1 + log count) * weight of slot."""
    key, count = np.unique(row * len(weights) + slot, return_counts=True)
    row, slot = key // len(weights), key % len(weights)
    w = (1 + np.log(count)) * weights[slot]
    norm = np.sqrt(np.bincount(row, w * w, n_rows))
    return Matrix(row, slot, (w / np.where(norm == 0, 1, norm)[row]).astype(np.float32), norm)


def times(m: Matrix, q: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m.norm), q.shape[1]), dtype=np.float32)
    if len(m.row):
        heads = np.flatnonzero(np.r_[True, m.row[1:] != m.row[:-1]])
        out[m.row[heads]] = np.add.reduceat(q[m.slot] * m.weight[:, None], heads, axis=0)
    return out


def add_transposed(out: np.ndarray, m: Matrix, y: np.ndarray) -> None:
    """Add the transpose of ``m`` times ``y`` to ``out``."""
    if len(m.row):
        order = np.argsort(m.slot, kind="stable")
        slot = m.slot[order]
        heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        out[slot[heads]] += np.add.reduceat(y[m.row[order]] * m.weight[order][:, None], heads, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def summed(rows: DataFrame, emit: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sum the numbered vectors that ``emit`` yields in the tasks, in two levels; as many come back as there are numbers."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, v in emit(slices(batches)):
            yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "v": pa.array([np.asarray(v, dtype=np.float32).tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v, dtype=np.float32 if len(pdf.columns) == 3 else np.float64).astype(np.float64) for v in pdf["v"]], axis=0)
        return pd.DataFrame({"number": [pdf["number"].iloc[0]], "v": [total.tobytes()]})

    parts = rows.mapInArrow(tell, "number int, v binary").withColumn("group", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    once = parts.groupBy("number", "group").applyInPandas(add, "number int, v binary")
    return {r["number"]: np.frombuffer(r["v"], dtype=np.float64) for r in once.groupBy("number").applyInPandas(add, "number int, v binary").collect()}


def in_chunks(total: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(total), CHUNK):
        part = total[at : at + CHUNK]
        if part.any():
            yield at // CHUNK, part.ravel()


def from_chunks(parts: dict[int, np.ndarray], size: int, width: int) -> np.ndarray:
    out = np.zeros((size, width))
    for number, v in parts.items():
        part = v.reshape(-1, width)
        out[number * CHUNK : number * CHUNK + len(part)] = part
    return out


def document_counts(rows: DataFrame) -> pd.DataFrame:
    """(id, n): how many documents hold each hashed word; at most 2^WORD_BITS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = np.arange(1 << WORD_BITS)
        held = np.zeros(1 << WORD_BITS, dtype=np.int64)
        for batch in slices(batches):
            w = unpacked(batch, same)
            np.add.at(held, np.unique(w.doc * len(same) + w.slot) % len(same), 1)
        ids = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids.astype(np.int32)), "n": pa.array(held[ids])})

    return rows.select("said").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()


def slots(counts: pd.DataFrame, own: int, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each hashed word, and the documents of each slot."""
    counts = counts.sort_values(["n", "id"], ascending=[False, True])
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    at = np.arange(len(ids))
    at[own:] = own + ids[own:] % shared
    slot_of = np.zeros(1 << WORD_BITS, dtype=np.int64)
    slot_of[ids] = at
    return slot_of, np.bincount(at, n, min(len(ids), own + shared) if len(ids) <= own else own + shared)


class Model(NamedTuple):
    slot_of: np.ndarray
    weights: np.ndarray
    axes: np.ndarray
    centroids: np.ndarray
    subjects: list[str]
    of: np.ndarray  # the subject number of each centroid
    weak: float  # sentences lighter than this do not speak
    context: np.ndarray  # weights of the model of mentions
    bias: float


def places(w: Words, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return unit(times(matrix(w.doc, w.slot, w.n_docs, weights), axes))


def best_of(sim: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    return np.stack([sim[:, of == s].max(1) if (of == s).any() else np.full(len(sim), -1.0) for s in range(n)], axis=1)


def spoken(w: Words, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(subject, speaks) of each sentence: its nearest one, and whether that leads clearly and the sentence weighs enough."""
    s = matrix(w.sentence, w.slot, len(w.of), m.weights)
    by = best_of(unit(times(s, m.axes)) @ m.centroids.T.astype(np.float32), m.of, len(m.subjects))
    ranked = np.sort(by, axis=1)
    second = ranked[:, -2] if len(m.subjects) > 1 else np.full(len(by), -1.0)
    return by.argmax(1), (ranked[:, -1] - second > LEAD * ranked[:, -1]) & (ranked[:, -1] > 0.03) & (s.norm >= m.weak)


def context(w: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature): runs of one to three words, the topical ones masked, each once a sentence."""
    x = np.where(weights[w.slot] > TOPICAL, len(weights), w.slot).astype(np.uint64)
    found = []
    for k in (1, 2, 3):
        h = np.zeros(max(len(x) - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            h = (h + x[j : j + len(h)] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        same = w.sentence[: len(h)] == w.sentence[k - 1 : k - 1 + len(h)]
        found.append((w.sentence[: len(h)][same] << CONTEXT_BITS) + (h[same] & np.uint64((1 << CONTEXT_BITS) - 1)).astype(np.int64))
    key = np.unique(np.concatenate(found))
    return key >> CONTEXT_BITS, key & ((1 << CONTEXT_BITS) - 1)


def mention_scores(sentence: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    size = np.bincount(sentence, minlength=n)
    return bias + np.bincount(sentence, weights[feature], n) / np.sqrt(np.maximum(size, 1))


def fit_mentions(sentences: list[np.ndarray], off: np.ndarray, seed: int = 5, batch: int = 256) -> tuple[np.ndarray, float]:
    """Logistic regression by adaptive gradient steps over batches: weights and bias; all zero but the bias where a class is missing."""
    weights, bias = np.zeros(1 << CONTEXT_BITS), -3.0
    if not off.any() or off.all():
        return weights, -np.inf
    gw, gb = np.full(len(weights), 1e-2), 1e-2
    sizes = np.array([len(x) for x in sentences])
    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-STEPS * batch // len(sentences)))):
        order = rng.permutation(len(sentences))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            feature = np.concatenate([sentences[i] for i in part])
            row = np.repeat(np.arange(len(part)), sizes[part])
            scale = 1 / np.sqrt(sizes[part])
            z = bias + np.bincount(row, weights[feature], len(part)) * scale
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - off[part]
            step = np.bincount(feature, (error * scale)[row], len(weights))
            gw += step**2
            weights -= 0.3 * step / np.sqrt(gw)
            gb += error.sum() ** 2
            bias -= 0.3 * error.sum() / np.sqrt(gb)
    return weights, bias


def learned_mentions(labelled: DataFrame, model: Model, size: int = SAMPLE) -> Model:
    """Fit the model of mentions on labelled documents most of whose speaking sentences agree with the label."""
    number = {s: i for i, s in enumerate(model.subjects)}
    given = labelled.sparkSession.sparkContext.broadcast(tuple(model))
    drawn = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select("said", "subjects")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*given.value)
        for batch in slices(batches):
            w = unpacked(batch, m.slot_of)
            own = [{number.get(s, -1) for s in x} for x in batch.column(batch.schema.get_field_index("subjects")).to_pylist()]
            top, speaks = spoken(w, m)
            agrees = np.array([t in own[d] for t, d in zip(top, w.of)], dtype=bool)
            heard = np.bincount(w.of[speaks], minlength=w.n_docs)
            right = np.bincount(w.of[speaks & agrees], minlength=w.n_docs)
            use = speaks & (2 * right >= heard)[w.of] if len(w.of) else speaks
            sentence, feature = context(w, m.weights) if len(w.doc) else (w.doc, w.doc)
            cuts = np.searchsorted(sentence, np.arange(len(w.of) + 1))
            chosen = np.flatnonzero(use)
            yield pa.RecordBatch.from_pydict({
                "off": pa.array(~agrees[chosen], pa.bool_()),
                "features": pa.array([feature[cuts[i] : cuts[i + 1]].astype(np.int32) for i in chosen], pa.list_(pa.int32())),
            })

    rows = drawn.mapInArrow(tell, "off boolean, features array<int>").toPandas()  # the sentences of at most ``size`` documents
    weights, bias = fit_mentions(rows["features"].tolist(), rows["off"].to_numpy(dtype=float))
    return model._replace(context=weights.astype(np.float32), bias=float(bias))


def fit(rows: DataFrame, labels: DataFrame, own: int = OWN, shared: int = SHARED, rank: int = RANK, seed: int = 7) -> Model | None:
    """Slots, term weights, singular axes, centroids and the model of mentions, from the read documents and their labels."""
    sc = rows.sparkSession.sparkContext
    counts = document_counts(rows)
    if not len(counts):
        return None
    slot_of, held = slots(counts, own, shared)
    size, n_documents = len(held), rows.count()
    rows = rows.withColumn("tongue", F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2)))
    labelled = stow(rows.join(labels.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects")), "doc_id"), "labelled")
    subjects = sorted(r[0] for r in labelled.select(F.explode("subjects")).distinct().collect())  # of the fixed table of subjects
    if not subjects:
        return None
    number = {s: i for i, s in enumerate(subjects)}
    given_slots = sc.broadcast(slot_of)

    def tell_subjects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros((size, len(subjects)))
        for batch in batches:
            w = unpacked(batch, given_slots.value)
            share = np.zeros((w.n_docs, len(subjects)))
            for i, x in enumerate(batch.column(batch.schema.get_field_index("subjects")).to_pylist()):
                share[i, [number[s] for s in x]] = 1 / len(x)
            key = np.unique(w.doc * size + w.slot)
            np.add.at(total, key % size, share[key // size])
        yield from in_chunks(total)

    table = from_chunks(summed(labelled.select("said", "subjects"), tell_subjects), size, len(subjects))
    prior = table.sum(0) / table.sum()
    share = (table + SMOOTH * prior) / (table.sum(1, keepdims=True) + SMOOTH)
    weights = np.log(n_documents / np.maximum(held, 1)).clip(0) * (share * np.log(share / prior)).sum(1)
    if not weights.any():
        weights = np.ones(size)
    rank = min(rank, size)

    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    weak = 0.0
    for _ in range(PASSES):
        given = sc.broadcast((slot_of, weights, axes.astype(np.float32)))  # slots x rank, whatever the corpus

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            slot_of_, w, q = given.value
            total, heard = np.zeros((size, rank), dtype=np.float32), np.zeros(2)
            for batch in batches:
                words = unpacked(batch, slot_of_)
                m = matrix(words.doc, words.slot, words.n_docs, w)
                add_transposed(total, m, times(m, q))
                norm = matrix(words.sentence, words.slot, len(words.of), w).norm
                heard += norm.sum(), len(norm)
            yield from in_chunks(total)
            yield -1, heard

        parts = summed(rows.select("said"), multiply)
        heard = parts.pop(-1)
        weak = WEAK * heard[0] / max(heard[1], 1)
        axes = np.linalg.qr(from_chunks(parts, size, rank))[0]
    axes = axes.astype(np.float32)

    single = labelled.filter(F.size("subjects") == 1).withColumn("subject", F.col("subjects")[0])
    tongues = single.groupBy("tongue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tongue").limit(LANGUAGES).collect()
    tongue_of = {r["tongue"]: i for i, r in enumerate(tongues)}
    width = len(tongue_of) + 1
    given = sc.broadcast((slot_of, weights, axes))

    def seed_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        slot_of_, w, q = given.value
        total = np.zeros((len(subjects) * width, q.shape[1]))
        for batch in batches:
            at = places(unpacked(batch, slot_of_), w, q)
            told = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("subject", "tongue")))
            np.add.at(total, [number[s] * width + tongue_of.get(t, width - 1) for s, t in told], at)
        yield from in_chunks(total)

    seeds = from_chunks(summed(single.select("said", "subject", "tongue"), seed_sums), len(subjects) * width, rank)
    order = np.flatnonzero(seeds.any(1))
    if not len(order):
        return None
    centroids, of = unit(seeds[order]), order // width
    for _ in range(ROUNDS):
        now = sc.broadcast((slot_of, weights, axes, centroids.astype(np.float32), of))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
            slot_of_, w, q, c, owner = now.value
            total = np.zeros(c.shape)
            for batch in batches:
                at = places(unpacked(batch, slot_of_), w, q)
                sim = at @ c.T
                best = sim.argmax(1)
                other = np.where(owner[None, :] == owner[best][:, None], -9.0, sim).max(1)
                clear = sim.max(1) - other > CLEAR
                np.add.at(total, best[clear], at[clear])
            yield from in_chunks(total)

        sums = from_chunks(summed(rows.select("said"), nearest), *centroids.shape)
        moved = unit(np.where(sums.any(1, keepdims=True), sums, centroids))
        rests = (1 - (moved * centroids).sum(1)).max() < REST
        centroids = moved
        if rests:
            break
    model = Model(slot_of, weights, axes, centroids, subjects, of, weak, np.zeros(1 << CONTEXT_BITS, dtype=np.float32), -np.inf)
    return learned_mentions(labelled, model)


def assigned(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, voice): one row a subject of a document, with its share of the document's voices."""
    given = rows.sparkSession.sparkContext.broadcast(tuple(model))  # a plain tuple: executors need not have the class

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*given.value)
        n = len(m.subjects)
        for batch in slices(batches):
            w = unpacked(batch, m.slot_of)
            top, speaks = spoken(w, m)
            votes = np.zeros((w.n_docs, n))
            np.add.at(votes, (w.of[speaks], top[speaks]), 1)
            mixed = (votes > 0).sum(1) > 1
            if np.isfinite(m.bias) and mixed.any():  # a mention can only matter where sentences disagree
                asked = mixed[w.doc]
                words = Words(w.doc[asked], w.sentence[asked], w.slot[asked], w.of, w.n_docs)
                mention = speaks & mixed[w.of] & (mention_scores(*context(words, m.weights), len(w.of), m.context, m.bias) > 0)
                np.add.at(votes, (w.of[mention], top[mention]), -1)
            at = places(w, m.weights, m.axes)
            score = votes + 1e-3 * best_of(at @ m.centroids.T.astype(np.float32), m.of, n)
            known = np.linalg.norm(at, axis=1) > 0
            order = np.argsort(-score, axis=1, kind="stable")[:, :2]
            total = votes.sum(1)
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(known)
            voice = lambda i, j: np.where(total[i] > 0, votes[i, order[i, j]] / np.maximum(total[i], 1), 1.0)
            second = first[(total[first] > 0) & (votes[first, order[first, 1]] >= SHARE * total[first])] if n > 1 else first[:0]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.r_[ids[first], ids[second]], pa.int64()),
                "subject": pa.array([m.subjects[j] for j in np.r_[order[first, 0], order[second, 1] if n > 1 else second]], pa.string()),
                "voice": pa.array(np.r_[voice(first, 0), voice(second, 1) if n > 1 else second], pa.float64()),
            })

    return rows.select("doc_id", "said").mapInArrow(decide, "doc_id long, subject string, voice double")


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, own: int = OWN) -> DataFrame:
    """(doc_id, subject, voice) of every document with text."""
    base = documents.select("doc_id", "lang", "text").filter("doc_id is not null and text is not null and text rlike '\\\\S'")
    known = labels.dropna(subset=["doc_id", "subject"]).select("doc_id", "subject").distinct().join(subjects.select("subject").distinct(), "subject", "left_semi")
    rows = stow(read(base), "said")
    model = fit(rows, known, own)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, voice double")
    return assigned(rows, model).groupBy("doc_id", "subject").agg(F.max("voice").alias("voice"))


def composition(areas: DataFrame, documents: DataFrame) -> DataFrame:
    """Per subject: documents, their share of the documents with a subject, and characters (split evenly between two subjects)."""
    sizes = documents.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("chars"))
    each = areas.join(sizes, "doc_id").withColumn("part", 1 / F.count("*").over(Window.partitionBy("doc_id")))
    by = each.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("part").alias("weight"), F.sum(F.col("part") * F.col("chars")).alias("chars"))
    return by.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
