"""p8: subject areas of documents by interpolated n-gram language models."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import written

#: Labelled documents used at most; those of the smallest hashes are taken. Of ten parts one is left for reports (accuracy)
#: and two set the thresholds; the rest is fitted.
LABELS, PARTS = 20_000, 10
REPORT, THRESHOLD = (1,), (0, 5)
#: A subject of so many labels in the threshold part has a threshold of its own; others take that of all.
OWN = 40
#: N-grams are counted in so many cells, so a model has a fixed size whatever the vocabulary.
CELLS = 1 << 18
#: Rounds of re-estimation over all documents.
ROUNDS = 2
#: A subject is accepted when it takes up this part of a document's sentences.
SHARE = 0.2
#: Interpolation weights of pair, word and background in a model; of pair, word and uniform in the background.
MIX, BACK = (0.4, 0.4, 0.2), (0.5, 0.45, 0.05)
#: Thresholds tried, in nats that a subject must be ahead of no subject.
TRIED = np.arange(-1.0, 5.01, 0.5)


def sentence_words(text: Column) -> Column:
    """The words in lower case, flat, a line feed between sentences; without code blocks, headings, mark-up, list marks, speakers and paths."""
    def out(t: Column, sign: str, pattern: str, put: str = "\n") -> Column:
        """t without what the pattern matches; texts without its sign are not looked through."""
        return F.element_at(F.transform(F.array(t), lambda x: F.when(x.rlike(sign), F.regexp_replace(x, pattern, put)).otherwise(x)), 1)

    t = out(text, "```|<[hpc]", "(?s)```.*?(?:```|\\z)|<(h[1-6]|pre|code)\\b[^>]*>.*?</\\1>")
    t = out(t, "#|==|--|=[ \\t]*(?:[\\r\\n]|\\z)", "(?m)^[\\x{FEFF} \\t]*#{1,6}[ \\t].*$|^[ \\t]*(?:=+|-{3,})[ \\t]*$")
    t = out(t, "<", "</?[a-zA-Z][^>\\n]*+>")
    t = out(t, "[-*+>|\\[.)]", "(?m)^[\\x{FEFF} \\t]*(?:[-*+>]|\\d+[.)]|\\|[ \\t]*\\d+[ \\t]*\\||\\[\\d\\d?:\\d\\d\\][ \\t]*[^\\s:]{1,40}:)[ \\t]+|[ \\t]*\\|[ \\t]*$", "")
    t = F.regexp_replace(t, "(?<=[.!?…])[\"”»)\\]]*\\s+", "\n")
    return F.regexp_extract_all(F.lower(F.regexp_replace(t, "(?<!\\S)\\S*?[/_0-9]\\S*+", " ")), F.lit("[\\r\\n]+|[\\p{L}\\p{M}]+"), F.lit(0))


def _cells(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, labels, part, u): the cells of each document's words, -1 between sentences. Cells of pairs follow from these."""
    each = documents.select("doc_id", F.explode(F.array(sentence_words(F.coalesce("text", F.lit(""))))).alias("s"))
    u = F.transform("s", lambda w: F.when(w.startswith("\n") | w.startswith("\r"), -1).otherwise(F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int")))
    order = F.xxhash64(F.lit(11), "doc_id")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.coalesce(F.lower(F.trim("subject")), F.lit(""))).alias("labels"))
    known = known.orderBy(order, "doc_id").limit(LABELS).withColumn("part", F.pmod(order, F.lit(PARTS)).cast("int"))
    return each.select("doc_id", u.alias("u")).join(F.broadcast(known), "doc_id", "left")


class Models:
    """Counts of words and pairs: a column per subject, one for no subject, the last for all text; and of sentences."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, sentences: np.ndarray):
        self.words, self.pairs, self.starts = (x.astype(np.float32) for x in (words, pairs, sentences))
        self.total = np.maximum(self.words.sum(0, dtype=np.float64), 1).astype(np.float32)
        self.shares = self.words / self.total
        self.inverse = (1 / np.maximum(np.concatenate([self.words, self.starts[None]]), 1)).astype(np.float32)  # the last row is for a sentence's first word

    def __reduce__(self) -> tuple:
        """Most counts are 0, so a model travels as a small part of its size."""
        out = io.BytesIO()
        np.savez_compressed(out, a=self.words, b=self.pairs, c=self.starts)
        return _model, (out.getvalue(),)

    def gains(self, u: np.ndarray, b: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Per sentence and model, by how many nats the model's cross-entropy is below the background's, summed over the words."""
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        before = np.concatenate([u[:1], u[:-1]])
        before[starts] = CELLS
        w, p = self.shares[u], self.pairs[b]
        p *= self.inverse[before]
        np.minimum(p, 1, out=p)
        back = BACK[0] * p[:, -1:] + BACK[1] * w[:, -1:] + BACK[2] / CELLS
        own = MIX[0] * p[:, :-1] + MIX[1] * w[:, :-1] + MIX[2] * back
        return np.add.reduceat(np.log(own / back), starts, axis=0)


def _model(data: bytes) -> Models:
    x = np.load(io.BytesIO(data))
    return Models(x["a"], x["b"], x["c"])


def _posteriors(gains: np.ndarray, doc: np.ndarray, docs: int, allowed: np.ndarray) -> np.ndarray:
    """Share of each sentence in each class, under proportions of the classes in its document, found by four steps of EM."""
    classes = gains.shape[1]
    like = np.exp(np.clip(gains - gains.max(1, keepdims=True), -50, 0)) * allowed[doc]
    prior = allowed / allowed.sum(1, keepdims=True)
    n = np.bincount(doc, minlength=docs)[:, None]
    for _ in range(4):
        post = like * prior[doc]
        post /= np.maximum(post.sum(1, keepdims=True), 1e-30)
        sums = np.stack([np.bincount(doc, weights=post[:, c], minlength=docs) for c in range(classes)], axis=1)
        prior = (sums + 0.2) / (n + 0.2 * classes)
    return post


def _batch(b: pa.RecordBatch, subjects: list[str]) -> tuple:
    """Arrays of a batch: words, pairs, sentence lengths, document of each sentence, allowed classes, part of the labels, labels."""
    lists = b.column("u")
    counts = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(b.num_rows), counts)
    fresh = flat < 0
    fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
    kept = flat >= 0
    u, sentence, of = flat[kept], np.cumsum(fresh)[kept], of[kept]
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    lens, doc = np.diff(np.append(starts, len(u))), of[starts]
    before = np.concatenate([u[:1], u[:-1]])
    before[starts] = CELLS  # a sentence's first word
    p = ((before * 2654435761 + u * 40503 + 1) % (1 << 32) * 1597334677 % (1 << 32)) % CELLS
    at = {s: i for i, s in enumerate(subjects)}
    allowed = np.ones((b.num_rows, len(subjects) + 1), dtype=np.float32)
    labels = b.column("labels").to_pylist()
    for i, ls in enumerate(labels):
        if ls:
            allowed[i] = 0.02  # single sentences of other areas, and mistaken labels
            allowed[i, [at[x] for x in ls if x in at]] = 1
            allowed[i, -1] = 1
    return u, p, lens, doc, allowed, np.asarray(b.column("part").fill_null(-1).to_numpy(zero_copy_only=False)), labels


def _counted(cells: DataFrame, subjects: list[str], model=None) -> Models:
    """Counts over all documents. Without a model: labelled documents count for their labels. With one: every sentence
    counts for the classes in proportion to its posteriors. Sums are made in each task first, then per cell; tasks are as
    many as cores, so what they send does not grow with the documents."""
    width = len(subjects) + 2
    away = list(REPORT + THRESHOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS, width), dtype=np.float32)
        said = np.zeros((1, width), dtype=np.float32)
        for b in batches:
            u, p, lens, doc, allowed, part, labels = _batch(b, subjects)
            if not len(lens):
                continue
            held = np.isin(part, away)
            if model is None:
                own = np.zeros((b.num_rows, width), dtype=np.float32)
                for i, ls in enumerate(labels):
                    if ls and not held[i]:
                        hit = [subjects.index(x) for x in ls if x in subjects]
                        own[i, hit or [-2]] = 1 / max(1, len(hit))
                at, c = np.nonzero(own[doc])
                weight = own[doc[at], c]
            else:
                allowed[held] = 1
                post = _posteriors(model.value.gains(u, p, lens), doc, b.num_rows, allowed)
                c = post.argmax(1)
                weight = post[np.arange(len(c)), c]
                at = np.flatnonzero(weight > 0.5)
                c, weight = c[at], weight[at]
            said[0] += np.bincount(c, weights=weight, minlength=width).astype(np.float32)
            said[0, -1] += len(lens)
            # each counted sentence's words, with its class and weight
            reps = lens[at]
            first = (np.cumsum(lens) - lens)[at]
            spots = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first, reps)
            of, much = np.repeat(c, reps), np.repeat(weight, reps)
            for k, cell in enumerate((u, p)):
                sums[k] += np.bincount(cell[spots] * width + of, weights=much, minlength=CELLS * width).reshape(CELLS, width).astype(np.float32)
                sums[k, :, -1] += np.bincount(cell, minlength=CELLS)
        for k, table in enumerate((sums[0], sums[1], said)):
            full = np.flatnonzero(table[:, -1])
            if len(full):
                columns = [pa.array(np.full(len(full), k, np.int32)), pa.array(full.astype(np.int32)), *[pa.array(table[full, c]) for c in range(width)]]
                yield pa.RecordBatch.from_arrays(columns, ["k", "cell", *[f"c{c}" for c in range(width)]])

    schema = "k int, cell int, " + ", ".join(f"c{c} float" for c in range(width))
    part = cells.coalesce(cells.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    rows = part.groupBy("k", "cell").agg(*[F.sum(f"c{c}").cast("float").alias(f"c{c}") for c in range(width)]).toPandas()  # at most 2 x CELLS + 1 rows
    full = np.zeros((3, CELLS, width), dtype=np.float32)
    full[rows["k"].to_numpy(dtype=int), rows["cell"].to_numpy(dtype=int)] = rows[[f"c{c}" for c in range(width)]].to_numpy()
    return Models(full[0], full[1], full[2, 0])


def _shares(gains: np.ndarray, doc: np.ndarray, docs: int, leads: np.ndarray) -> np.ndarray:
    """Per document the share of its sentences in each subject, where a subject must be ahead of none by its lead."""
    ahead = gains.copy()
    ahead[:, :-1] -= leads
    best = _posteriors(ahead, doc, docs, np.ones((docs, gains.shape[1]), dtype=np.float32)).argmax(1)
    counts = np.zeros((docs, gains.shape[1]))
    np.add.at(counts, (doc, best), 1)
    return counts / np.maximum(np.bincount(doc, minlength=docs), 1)[:, None]


def _hits(cells: DataFrame, subjects: list[str], model, parts: tuple, leads: list[np.ndarray]) -> pd.DataFrame:
    """(i, subject, hit, miss, labelled): rights and wrongs of each subject under each of the leads, against the labels of some parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, p, lens, doc, _, _, labels = _batch(b, subjects)
            if not len(lens):
                continue
            gains = model.value.gains(u, p, lens)
            truth = np.array([[x in (ls or []) for x in subjects] for ls in labels])
            rows = []
            for i, lead in enumerate(leads):
                said = _shares(gains, doc, b.num_rows, lead)[:, :-1] >= SHARE
                rows += zip([i] * len(subjects), range(len(subjects)), (said & truth).sum(0).tolist(), (said ^ truth).sum(0).tolist(), truth.sum(0).tolist(), strict=True)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["i", "subject", "hit", "miss", "labelled"]), preserve_index=False)

    sums = [F.sum(c).alias(c) for c in ("hit", "miss", "labelled")]
    return cells.where(F.col("part").isin(*parts)).mapInArrow(run, "i long, subject long, hit long, miss long, labelled long").groupBy("i", "subject").agg(*sums).toPandas()


def _thresholds(cells: DataFrame, subjects: list[str], model) -> np.ndarray:
    """How far each subject must be ahead: the lead of the best F1 of accepted subjects against the labels of the threshold
    part, over all subjects, or over the subject alone where it has enough labels."""
    scores = _hits(cells, subjects, model, THRESHOLD, [np.full(len(subjects), x) for x in TRIED])

    def best(rows: pd.DataFrame) -> float:
        per = rows.groupby("i")[["hit", "miss"]].sum()
        f1 = 2 * per["hit"] / (2 * per["hit"] + per["miss"]).clip(lower=1)
        good = sorted(per.index[f1 >= f1.max() - 1e-9])
        return float(TRIED[good[len(good) // 2]])

    if scores.empty:
        return np.full(len(subjects), 1.0)
    every = best(scores)
    own = {s: g for s, g in scores.groupby("subject") if g["labelled"].max() >= OWN}
    return np.array([best(own[s]) if s in own else every for s in range(len(subjects))])


def _fitted(cells: DataFrame, names: list[str]) -> tuple:
    """(broadcast model, leads)."""
    context = cells.sparkSession.sparkContext
    model = context.broadcast(_counted(cells, names))
    for _ in range(ROUNDS):
        past, model = model, context.broadcast(_counted(cells, names, model))
        past.destroy()
    return model, _thresholds(cells, names, model)


def _names(areas: DataFrame) -> list[str]:
    return sorted({r[0].strip().lower() for r in areas.select("subject").where("subject is not null").collect()})  # the areas' list


def accuracy(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[float, float, int]:
    """(precision, recall, labels) of accepted subjects against the labels that neither models nor thresholds have seen."""
    names, cells = _names(areas), written(_cells(documents, labels), "cells")
    model, leads = _fitted(cells, names)
    rows = _hits(cells, names, model, REPORT, [leads])
    hit, labelled, miss = (int(rows[c].sum()) for c in ("hit", "labelled", "miss"))
    said = miss - (labelled - hit) + hit
    return hit / max(1, said), hit / max(1, labelled), labelled


def subjects_of(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, share, sentences): each area's part of each document's sentences, where it has one.

    A model per area, one for sentences of no area, and a background over all documents, all interpolated pairs and
    words; first from the labels, then re-estimated over all documents. A sentence goes to the class of the highest
    posterior under its document's proportions; how far each area must be ahead is set on labels held out. Code blocks and
    headings do not count. Null or blank texts give no rows; repeated rows give repeated rows. Labels of unknown areas,
    and null ones, say that there is no area. Without labels nothing is known and no rows come out.
    """
    spark: SparkSession = documents.sparkSession
    names = _names(areas)
    if not names:
        return spark.createDataFrame([], "doc_id long, subject string, share double, sentences int")
    cells = written(_cells(documents, labels), "cells")
    model, leads = _fitted(cells, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, p, lens, doc, _, _, _ = _batch(b, names)
            if not len(lens):
                continue
            share = _shares(model.value.gains(u, p, lens), doc, b.num_rows, leads)[:, :-1]
            i, c = np.nonzero(share)
            n = np.bincount(doc, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(i)), pa.array([names[x] for x in c], pa.string()), pa.array(share[i, c]), pa.array(n[i].astype(np.int32))], ["doc_id", "subject", "share", "sentences"]
            )

    return cells.mapInArrow(run, "doc_id long, subject string, share double, sentences int")


def found(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject): the areas that take up at least a fifth of the document's sentences."""
    return subjects_of(documents, areas, labels).where(F.col("share") >= SHARE).select("doc_id", "subject").distinct()


def composition(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, documents, sentences): documents with each area, and the sentences it takes up in all documents."""
    per = subjects_of(documents, areas, labels)
    accepted = F.sum(F.when(F.col("share") >= SHARE, 1).otherwise(0))
    return per.groupBy("subject").agg(accepted.alias("documents"), F.round(F.sum(F.col("share") * F.col("sentences"))).cast("long").alias("sentences"))
