"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts every labelled text outside the held-out fold, inside the tasks, by language and bucket; Spark sums and
stores the counts of all languages. Log-probability matrices of at most BLOCK languages x BUCKETS float32 values are broadcast
one after the other, and each document keeps its best language over them. Scoring gathers the rows of a batch's n-grams in numpy.

Defined results: null text, empty text and text without a letter give ``und`` with score 0. With no labelled text at all
every text is ``und``. Equal posteriors go to the language that sorts first. Repeated rows are counted and returned each.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notegrid.llm.common import batch, give_back, materialize, mix, unused

#: Parameters of the model: sizes of the n-grams, buckets they hash to, and the count added to each bucket.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
ADDED = 0.1
#: Languages whose table is broadcast at a time; all are learned.
BLOCK = 256
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

_U = np.uint64
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def ngrams(texts: list[str | None], most: int = 1 << 17):
    """For some texts at a time: (first, last, row of each n-gram, bucket of each n-gram, letters of each text)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        parts: list[str] = []
        while j < len(texts) and (j == i or size < most):
            parts.append((texts[j] or "").lower())
            size += len(parts[-1])
            j += 1
        length = np.fromiter(map(len, parts), np.int64, j - i)
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(j - i, dtype=np.int32), length)
        kept = letters()[points]
        n_letters = np.bincount(row[kept], minlength=j - i)
        # what is no letter becomes one space between words, whatever the text before ends with
        first_gap = ~kept
        first_gap[1:] &= kept[:-1] | (row[1:] != row[:-1])
        use = kept | first_gap
        code, of = np.where(kept, points, 32)[use].astype(np.uint64), row[use]
        rows, buckets = [], []
        for n in ORDERS:
            if len(code) < n:
                continue
            m = len(code) - n + 1
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = h * _U(0x100000001B3) + code[k : k + m]
            same = of[:m] == of[n - 1 :]
            rows.append(of[:m][same])
            buckets.append((mix(h[same]) >> _U(64 - 15)).astype(np.int32))
        yield i, j, np.concatenate(rows or [np.zeros(0, np.int32)]), np.concatenate(buckets or [np.zeros(0, np.int32)]), n_letters
        i = j


def held_out(doc_id: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[tuple[str, int]], DataFrame]:
    """All languages in order with their numbers of texts, and the stored counts (lang, bucket, n)."""
    schema = "lang string, bucket int, n long"
    arrow = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for i, j, row, bucket, _ in ngrams(b.column(0).to_pylist()):
                for name in set(langs[i:j]):
                    of = langs[i:j] == name
                    have = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    have[:BUCKETS] += np.bincount(bucket[of[row]], minlength=BUCKETS)
                    have[BUCKETS] += int(of.sum())
                if len(sums) >= BLOCK:
                    yield from out(sums)
        yield from out(sums)
        give_back()

    def out(sums):
        for name, have in sums.items():
            at = np.flatnonzero(have)
            yield batch(arrow, [name] * len(at), at.astype(np.int32), have[at])
        sums.clear()

    labelled = docs.where(F.col(lang).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).alias("lang"))
    counts = materialize(labelled.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "languages")
    return sorted((r["lang"], r["n"]) for r in counts.where(F.col("bucket") == BUCKETS).select("lang", "n").collect()), counts


def table_of(langs: list[tuple[str, int]], counts: DataFrame, first: int) -> np.ndarray:
    """For BLOCK languages from the first: BUCKETS x languages of log probabilities, with the log priors among all as last row."""
    here = langs[first : first + BLOCK]
    columns = F.broadcast(counts.sparkSession.createDataFrame([(name, k) for k, (name, _) in enumerate(here)], "lang string, k int"))
    cells = counts.join(columns, "lang").select("k", "bucket", "n").toArrow()
    table = np.zeros((BUCKETS + 1, len(here)))
    table[cells.column("bucket").to_numpy(), cells.column("k").to_numpy()] = cells.column("n").to_numpy()
    grams, priors = table[:BUCKETS] + ADDED, table[BUCKETS] + ADDED
    everything = sum(n for _, n in langs) + ADDED * len(langs)
    return np.vstack([np.log(grams / grams.sum(axis=0)), np.log(priors / everything)]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[tuple[str, int]], DataFrame], text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with pred and score, the posterior of that language given the text; columns of docs with these names go.

    Languages come in blocks of BLOCK, whose tables are broadcast one after the other; each document carries its best log
    probability so far and the sum of all relative to it.
    """
    langs, counts = model
    out = docs.drop(pred, score)
    plain, best, much = out.schema.fields, unused(out, "_best"), unused(out, "_sum")
    carried = [T.StructField(pred, T.StringType()), T.StructField(best, T.DoubleType()), T.StructField(much, T.DoubleType())]
    for first in range(0, len(langs), BLOCK):
        if first:
            out = materialize(out, "scored")
        out = scored(out, T.StructType([*plain, *carried]), np.array([x for x, _ in langs[first : first + BLOCK]], dtype=object), table_of(langs, counts, first), text, first > 0)
    if not langs:
        return out.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    return out.withColumn(score, F.when(F.col(much) > 0, 1 / F.col(much)).otherwise(0.0)).drop(best, much)


def scored(docs: DataFrame, schema: T.StructType, names: np.ndarray, table: np.ndarray, text: str, more: bool) -> DataFrame:
    weights = docs.sparkSession.sparkContext.broadcast(table)

    def score(batches):
        w, k = weights.value, len(names)
        for b in batches:
            own = b.columns[:-3] if more else b.columns
            if more:
                pred, best, total_ = np.array(b.column(b.num_columns - 3).to_pylist(), dtype=object), *(b.column(b.num_columns - n).to_numpy(zero_copy_only=False).copy() for n in (2, 1))
            else:
                pred, best, total_ = np.full(b.num_rows, UNKNOWN, dtype=object), np.full(b.num_rows, -np.inf), np.zeros(b.num_rows)
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            for i, j, row, bucket, n_letters in ngrams(texts):
                total = np.tile(w[-1].astype(np.float64), (j - i, 1))
                for c in range(k):
                    total[:, c] += np.bincount(row, weights=w[bucket, c], minlength=j - i)
                at, top = total.argmax(axis=1), total.max(axis=1)
                much = np.exp(total - top[:, None]).sum(axis=1)
                seen, was = n_letters > 0, best[i:j]
                high = np.maximum(top, was)
                much = much * np.exp(top - high) + total_[i:j] * np.exp(was - high)
                better = seen & (top > was)
                pred[i:j][better] = names[at[better]]
                best[i:j][seen], total_[i:j][seen] = high[seen], much[seen]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pred, pa.string()), pa.array(best), pa.array(total_)], names=schema.fieldNames())
        give_back()

    return docs.mapInArrow(score, schema)


def identify(docs: DataFrame, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Learn from the labelled documents outside the held-out fold and predict every document; docs need doc_id, text, lang."""
    learn = docs.where(~held_out())
    return predict(docs, train(learn), pred=pred, score=score)
