"""Language ID: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

Subwords are the byte n-grams (2, 3 and 4 long) of lower-cased words with their borders; other characters separate words. Each
hashes to one of ``2 ** BUCKET_BITS`` embeddings; a text is the average of its subwords' embeddings, classified by a linear
softmax. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows: at most
``per_language`` documents of each language, those whose id hashes lowest, as whole texts and as short runs of their words.
Every language is learned: with more than MOST_DOCUMENTS / ``per_language`` of them each has a smaller share of MOST_DOCUMENTS
documents, one at least. Of a document at most SAMPLE_SUBWORDS distinct subwords are handed to the driver, in one stream. One more class stands for everything else: its examples are
subwords drawn at random, as a text in an unknown language or script would hash. A fifth of the sample is set aside to fit
the temperature of the softmax and the score below which a text is rejected, so that at most ``reject_rate`` of texts
like the labelled ones are. The score is the probability of the predicted language, which is never the extra class.

As the model is linear in the average, embedding and classifier fold into one table of bucket by language where languages are
fewer than dimensions; that table, or both parts, is broadcast (its size is fixed by the bucket count and the number of
languages); whole texts are scored in one pass.

Defined results: a null text or one without a letter is ``und`` with score 0; rows whose id is null are predicted but
never learned from and count as not held out; without any labelled row everything is ``und``; repeated rows get equal
predictions; an empty table gives an empty result. Language, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm import arrow_text as at
from quernel.session import materialize

BUCKET_BITS = 15
DIMENSION = 16
SIZES = (2, 3, 4)
SCORE_SLICE = 500_000
PER_LANGUAGE, MOST_DOCUMENTS, SAMPLE_SUBWORDS = 400, 40_000, 20_000
REJECT_RATE = 0.002
EMBEDDING_RATE = 20  # an embedding's share of a text is small, its steps are longer than those of the classifier
LETTER = np.full(256, 0x20, dtype=np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket by language with the extra class last, or by dimension
    weights: np.ndarray | None  # dimension by language, unless the table has been folded with it
    bias: np.ndarray
    temperature: float
    threshold: float  # texts with a lower score are rejected

    def logits(self, average: np.ndarray) -> np.ndarray:
        return (average if self.weights is None else average @ self.weights) + self.bias


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts with a space around each text, and the text of each byte."""
    rows = len(offsets) - 1
    text = np.repeat(np.arange(rows), np.diff(offsets))
    out = np.full(len(data) + rows + 1, 0x20, dtype=np.uint8)
    out[np.arange(len(data)) + text + 1] = LETTER[data]
    return out, offsets[:-1] + np.arange(rows)


def subwords(data: np.ndarray, offsets: np.ndarray):
    """For each size: buckets and texts of the n-grams that have letters between their ends."""
    letters, starts = spaced(data, offsets)
    wide = letters.astype(np.uint32)
    gap = letters == 0x20
    for size in SIZES:
        n = len(letters) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, dtype=np.uint32)
        inner = np.zeros(n, dtype=bool)
        for i in range(size):
            h = (h ^ wide[i : i + n]) * np.uint32(0x01000193)
            if 0 < i < size - 1:
                inner |= gap[i : i + n]
        if size == 2:
            inner = gap[:n] & gap[1 : 1 + n]
        at_ = np.flatnonzero(~inner)
        h = h[at_]
        yield ((h ^ (h >> np.uint32(15))) & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64), np.searchsorted(starts, at_, "right") - 1


def _logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    total, count = np.zeros((rows, model.table.shape[1])), np.zeros(rows)
    for bucket, text in subwords(data, offsets):
        if len(bucket):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            total[text[first]] += np.add.reduceat(model.table[bucket], first, axis=0)
            count += np.bincount(text, minlength=rows)
    return model.logits(total / np.maximum(count, 1)[:, None])


def _long_logits(model: Model, data: np.ndarray) -> np.ndarray:
    """Of one long text, in pieces that overlap so that each n-gram is counted in just one."""
    total, count = np.zeros(model.table.shape[1]), 0
    letters = np.concatenate([[0x20], LETTER[data], [0x20]]).astype(np.uint8)
    for start in range(0, len(letters), SCORE_SLICE):
        part = letters[start : start + SCORE_SLICE + SIZES[-1] - 1]
        wide, gap = part.astype(np.uint32), part == 0x20
        for size in SIZES:
            n = min(SCORE_SLICE, len(part) - size + 1)
            if n <= 0:
                continue
            h, inner = np.full(n, size, dtype=np.uint32), np.zeros(n, dtype=bool)
            for i in range(size):
                h = (h ^ wide[i : i + n]) * np.uint32(0x01000193)
                if 0 < i < size - 1:
                    inner |= gap[i : i + n]
            if size == 2:
                inner = gap[:n] & gap[1 : 1 + n]
            h = h[~inner]
            total += model.table[((h ^ (h >> np.uint32(15))) & np.uint32((1 << BUCKET_BITS) - 1)).astype(np.int64)].sum(axis=0)
            count += len(h)
    return model.logits(total / max(count, 1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(batches):
    """Labelled subword counts: the whole text, and runs of 1, 3 and 10 words from places that the text itself decides."""
    schema = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("part", pa.int32()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    for batch in batches:
        out = [[], [], [], [], []]
        for lang, order, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = (text or "").split()
            pieces = [text or ""] + [" ".join(words[(order >> 8 * k) % max(1, len(words) - n + 1) :][:n]) for k, n in enumerate((1, 3, 10))]
            for part, piece in enumerate(pieces):
                data = np.frombuffer(piece.lower().encode("utf-8"), np.uint8)
                found = [b for b, _ in subwords(data, np.array([0, len(data)]))] if len(data) else []
                buckets, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if len(buckets) > SAMPLE_SUBWORDS:  # the most frequent
                    top = np.sort(np.argsort(-counts, kind="stable")[:SAMPLE_SUBWORDS])
                    buckets, counts = buckets[top], counts[top]
                if len(buckets):
                    for column, value in zip(out, (lang, order, part, buckets.astype(np.int32), counts.astype(np.int32))):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, held_out, per_language: int) -> DataFrame:
    """At most ``per_language`` learnable rows of each language, by a hash of the id; fewer where there are very many languages."""
    rows = docs.filter(~held_out & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.lit(17), F.col(id_col)).bitwiseAND(F.lit((1 << 62) - 1)).alias("order"), F.col(text_col).alias("text")
    )
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = sizes.count()
    per_language = max(1, min(per_language, MOST_DOCUMENTS // max(1, languages)))
    # only rows that can be among the lowest are sorted: a share of about twice the number wanted
    share = sizes if languages > MOST_DOCUMENTS else F.broadcast(sizes)
    share = share.withColumn("below", F.lit(float(1 << 62)) * F.least(F.lit(1.0), F.lit(2.0 * per_language + 100) / F.col("n")))
    likely = rows.join(share, "lang").filter("order <= below")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))
    return likely.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "order", "text")


def fit(sample: DataFrame, reject_rate: float = REJECT_RATE, epochs: int = 6, rate: float = 0.6, seed: int = 5) -> Model | None:
    """Train on the driver from the subword counts of a bounded sample."""
    examples = materialize(sample.mapInArrow(_examples, "lang string, order long, part int, buckets array<int>, counts array<int>"), "examples")
    rows = [(r["order"], r["lang"], r["part"], np.array(r["buckets"], np.int32), np.array(r["counts"], np.int32)) for r in examples.toLocalIterator()]
    rows.sort(key=lambda r: (*r[:3], len(r[3])))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    data = [(buckets, counts, number[lang], part, order % 5 == 0) for order, lang, part, buckets, counts in rows]
    del rows  # shares are made from counts when they are needed: the driver holds 8 bytes for each subword of an example
    train, check = [d for d in data if not d[4]] or data, [d for d in data if d[4]] or data
    rng = np.random.default_rng(seed)

    def others(like: list) -> list:
        """Random subwords in the sizes of every third example."""
        made = []
        for d in like[::3]:
            buckets, counts = np.unique(rng.integers(0, 1 << BUCKET_BITS, max(2, len(d[0]))), return_counts=True)
            made.append((buckets.astype(np.int32), counts.astype(np.int32), len(languages), -1, d[4]))
        return made

    train, check = train + others(train), check + others(check)
    embedding = rng.normal(0, 1 / DIMENSION, (1 << BUCKET_BITS, DIMENSION))
    weights, bias = np.zeros((DIMENSION, len(languages) + 1)), np.zeros(len(languages) + 1)
    step, steps = 0, epochs * len(train)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            buckets, counts, label, _, _ = train[i]
            share = counts / counts.sum()
            lr = rate * (1 - step / steps)
            step += 1
            part = embedding[buckets]
            hidden = share @ part
            error = _softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= lr * np.outer(hidden, error)
            bias -= lr * 0.1 * error
            embedding[buckets] = part - (lr * EMBEDDING_RATE * share)[:, None] * back
    averages = np.array([(counts / counts.sum()) @ embedding[buckets] for buckets, counts, *_ in check])
    logits = averages @ weights + bias
    labels, whole = np.array([d[2] for d in check]), np.array([d[3] == 0 for d in check])
    grid = [2.0**k for k in range(-4, 9)]
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    temperature = grid[int(np.argmin(loss))]
    top = _softmax(logits / temperature)[:, :-1].max(axis=1)
    threshold = min(0.5, float(np.quantile(top[whole], reject_rate)) / 2) if whole.any() else 0.0
    del data, train, check
    at.make_room("")
    table, rest = (embedding @ weights, None) if len(bias) < DIMENSION else (embedding, weights)
    return Model(languages, table, rest, bias, temperature, threshold)


def _predict_batches(shared):
    schema = pa.schema([("row_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def score(column) -> tuple[list, np.ndarray, np.ndarray]:
        model = shared.value
        has_letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, top = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        if model is not None and has_letter.any():
            data, offsets = at.bytes_of(pc.utf8_lower(column))
            for first, last, part, bounds in at.slices(data, offsets, SCORE_SLICE):
                logits = _long_logits(model, part)[None] if last - first == 1 and len(part) > SCORE_SLICE else _logits(model, part, bounds)
                chance = _softmax(logits / model.temperature)
                best[first:last], top[first:last] = chance[:, :-1].argmax(axis=1), chance[:, :-1].max(axis=1)
        else:
            has_letter = np.zeros(len(column), dtype=bool)
        top = np.where(has_letter, top, 0.0)
        names = [model.languages[b] if h else "und" for b, h in zip(best.tolist(), has_letter.tolist())]
        return names, top, ~has_letter | (top < (model.threshold if model else 0.0))

    def run(batches):
        for part in at.parts(batches):
            names, top, rejected = score(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(rejected)], schema=schema)

    run.score = score
    return run


def held_out_rows(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    return fit(labelled_sample(docs, id_col, text_col, lang_col, held_out_rows(id_col), per_language))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, lang_pred, score and rejected for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict_batches(shared), "row_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score, place = _predict_batches(shared).score, docs.columns.index(text_col)

    def run(batches):
        for part in at.parts(batches):
            _, _, rejected = score(part.column(place))
            yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs))
    return found.select(F.col("row_id").alias("doc_id"), held_out_rows("row_id").alias("held_out"), "lang_pred", "score", "rejected")
