"""Language identification.

Method: multinomial naive Bayes over hashed character n-grams. A text is lower-cased, everything that isn't a letter
becomes one blank, and all runs of 1 to ``N`` characters are hashed into ``BUCKETS`` features. Training counts features and documents
by language, in one pass that sends no more than one table a task. The matrix of log-probabilities (add-one smoothing; BUCKETS x
languages, 32-bit) is broadcast.

Scoring goes by batches: the texts of a batch become one sparse block, the features of all of them one after the other and where each text's
begin, which is scored by one gather from the matrix and a segmented sum, in numpy. A block holds ``HELD`` characters at most; longer texts
run over several blocks, so memory doesn't follow their length.

The prediction depends on the text alone. Texts that are null or have no letter are ``und`` with score 0. The score is the winner's softmax
share of the mean log-probability of ``SHARP`` features, so that it is comparable between short and long texts. Ties go to the language that
sorts first. Without any labelled text, every text is ``und``. Labels may be null (such rows are not learned from). More than ``MOST_LABELS``
labels are refused with an error, as the matrix is broadcast: a column of so many values doesn't hold languages.

Ids need not be unique: a repeated row is counted, and predicted, as often as it is there. An empty table gives an empty table. Other columns,
of whatever name, are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from densefold.llm.common import column

BUCKETS = 1 << 15
N = 3
SHARP = 20
#: Characters of one text in a block, and of a whole block.
STEP, HELD = 1 << 16, 1 << 17
#: Labels that are scored at once.
LABELS = 16
#: Labels beyond this number are refused: the matrix is broadcast.
MOST_LABELS = 500
UNKNOWN = "und"
#: From this score on, a prediction that differs from a document's declared language counts against the document.
SURE = 0.9

_GAP = regex.compile(r"\P{L}+")
_TIMES, _ODD, _SHIFT = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(49)


def parts_of(text: str | None) -> list[str]:
    """The text as it is scored, cut into parts of STEP characters, each followed by the N - 1 that its last n-grams reach into; none without a letter."""
    kept = _GAP.sub(" ", text.lower()).strip(" ") if text else ""
    if not kept:
        return []
    kept = f" {kept} "
    if len(kept) <= STEP + N - 1:
        return [kept]
    # The last part must have a gram of its own that the one before hasn't.
    return [kept[a : a + STEP + N - 1] for a in range(0, len(kept) - N + 1, STEP)]


class Block:
    """Features of several texts, one after the other: ``indices`` for each n, and the number that each text has."""

    def __init__(self):
        self.parts: list[str] = []
        self.rows: list[int] = []
        self.final: list[bool] = []
        self.size = 0

    def add(self, row: int, part: str, final: bool) -> None:
        self.parts.append(part)
        self.rows.append(row)
        self.final.append(final)
        self.size += len(part)

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n from 1 to N: feature numbers in the order of the parts, and how many each part has."""
        size, final = np.fromiter(map(len, self.parts), np.int64, len(self.parts)), np.array(self.final)
        c = np.frombuffer("".join(self.parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        place = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
        h = np.zeros(len(c), np.uint64)
        for n in range(1, N + 1):
            h = h[: len(c) - n + 1] * _TIMES + c[n - 1 :] + np.uint64(n)
            many = np.where(final, size - n + 1, size - N + 1)  # grams that start in the part: the overlap's belong to the next one
            mine = place[: len(h)] < np.repeat(many, size)[: len(h)]
            yield ((h[mine] * _ODD) >> _SHIFT).astype(np.int32), many


def blocks(texts: Iterable[str | None]) -> Iterator[Block]:
    """All texts, numbered, in blocks of bounded size."""
    now = Block()
    for row, text in enumerate(texts):
        parts = parts_of(text)
        for k, part in enumerate(parts):
            now.add(row, part, k == len(parts) - 1)
            if now.size >= HELD:
                yield now
                now = Block()
    if now.parts:
        yield now


def features(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of a text, in no particular order."""
    return np.concatenate([np.zeros(0, np.int32), *(f for b in blocks([text]) for f, _ in b.features())])


def _count(labels: list[str]):
    place = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(labels), BUCKETS + 1), np.int64)  # the last column counts documents
        held = [Block() for _ in labels]

        def add(k: int) -> None:
            for f, _ in held[k].features():
                total[k, :BUCKETS] += np.bincount(f, minlength=BUCKETS)
            held[k] = Block()

        for batch in batches:
            for text, label in zip(column(batch, "text"), column(batch, "label").to_pylist(), strict=True):
                k = place[label]
                total[k, BUCKETS] += 1
                parts = parts_of(text.as_py())
                for i, part in enumerate(parts):
                    held[k].add(0, part, i == len(parts) - 1)
                    if held[k].size >= HELD:
                        add(k)
        for k, rest in enumerate(held):
            if rest.parts:
                add(k)
        seen = np.flatnonzero(total.any(axis=1))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array([total[k].tobytes() for k in seen], pa.binary())], ["label", "counts"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, blob in zip(column(batch, "label").to_pylist(), column(batch, "counts"), strict=True):
            part = np.frombuffer(blob.as_buffer(), np.int64)
            sums[k] = sums[k] + part if k in sums else part
    for k, s in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["label", "counts"])


class Model:
    """Labels and log-probabilities (BUCKETS x labels)."""

    def __init__(self, labels: list[str], counts: np.ndarray):
        self.labels = labels
        grams, documents = counts[:, :BUCKETS] + 1.0, counts[:, BUCKETS]
        self.table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        self.prior = np.log(np.maximum(documents, 1) / max(1, documents.sum()))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text by label, features of each text)."""
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        for b in blocks(texts):
            rows = np.array(b.rows)
            for f, many in b.features():
                some = many > 0
                begin = (np.cumsum(many) - many)[some]
                for a in range(0, len(self.labels), LABELS):
                    np.add.at(total[:, a : a + LABELS], rows[some], np.add.reduceat(self.table[:, a : a + LABELS][f], begin, axis=0, dtype=np.float64))
                np.add.at(n, rows, many)
        return total, n

    def score(self, texts: Iterable[str | None]) -> tuple[list[str], list[float]]:
        texts = list(texts)
        if not self.labels or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, n = self.sums(texts)
        best = (total + self.prior).argmax(axis=1)
        mean = (total - total[np.arange(len(texts)), best][:, None]) / np.maximum(n, 1)[:, None] * SHARP
        score = np.where(n > 0, 1 / np.exp(np.minimum(mean, 50.0)).sum(axis=1), 0.0)
        return [self.labels[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist(), strict=True)], score.tolist()


def train(spark: SparkSession, rows: DataFrame, text: Column, label: Column) -> Model:
    """A model from all rows with a label. One pass over the texts; a table of BUCKETS counts per label and task is shuffled."""
    rows = rows.select(text.cast("string").alias("text"), label.cast("string").alias("label")).where("label IS NOT NULL AND text IS NOT NULL")
    labels = sorted(r[0] for r in rows.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    counts = np.zeros((len(labels), BUCKETS + 1), np.int64)
    if labels:
        parts = rows.mapInArrow(_count(labels), "label int, counts binary").repartitionById(len(labels), "label")
        for r in parts.mapInArrow(_sum, "label int, counts binary").collect():
            counts[r["label"]] = np.frombuffer(r["counts"], np.int64)
    return Model(labels, counts)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.value.score(t.as_py() for t in column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "kept"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    return run


def predict(spark: SparkSession, rows: DataFrame, text: Column, model: Model, keep: list[Column]) -> DataFrame:
    """(kept, lang_pred, score) of every row; ``kept`` is a struct of the columns ``keep``, so that no name of theirs can clash. No shuffle."""
    shared = spark.sparkContext.broadcast(model)
    given = rows.select(F.struct(*keep).alias("kept"), text.cast("string").alias("text"))
    return given.mapInArrow(_predict(shared), StructType([given.schema["kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def _model(spark: SparkSession, docs: DataFrame) -> Model:
    return train(spark, docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), F.col("text"), F.col("lang"))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned from those that aren't held out."""
    keep = [F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")]
    return predict(spark, docs, F.col("text"), _model(spark, docs), keep).select("kept.*", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sure: float = SURE) -> DataFrame:
    """The documents whose language is known and isn't declared wrongly, all columns kept.

    Rejected are null texts and texts without a letter, and documents whose text the model takes, with a score of ``sure`` or more, for another
    language than their ``lang`` says. A document without a declared language stays if it has a letter, and so do all such documents of a table
    without any label, from which nothing can be learned.
    """
    model = _model(spark, docs)
    if not model.labels:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    done = predict(spark, docs, F.col("text"), model, [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    declared = F.col(f"kept.c{docs.columns.index('lang')}").cast("string")
    wrong = declared.isNotNull() & (declared != F.col("lang_pred")) & (F.col("score") >= sure)
    return done.where((F.col("lang_pred") != UNKNOWN) & ~wrong).select(*[F.col(f"kept.c{k}").alias(c) for k, c in enumerate(docs.columns)])
