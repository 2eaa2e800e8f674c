"""Toxicity by class-conditional Kneser-Ney models of expressions.

An expression is a word.  For each class, toxic and ordinary, a model of order ``ORDER`` gives the
likelihood of its characters; counts are numbers of labelled documents that have the expression.
What a class's model takes from its counts it gives to continuation counts of order 4, these to
order 3, and so on to single characters, all shared by the classes: so an expression that neither
class knows well has equal likelihoods and says nothing.  A document's evidence is the largest difference of
log-likelihoods among its expressions, the mean of its ``TELLING`` largest, and the mean difference of
all, normalised by length in characters; a logistic curve, fitted on labelled documents that the models
have not seen, turns them into a score.

Counts are exact and grow with the corpus.  The classes differ at a gram that has been counted, and
at a context that has; these differences are the model.  It is sent to the tasks up to ``MODEL_GRAMS``
grams, and joined by shuffles beyond.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.shared import fresh, written
from tarnflow.llm.words import batches_of, mix

#: Characters of a gram.
ORDER = 5
#: Discounts of the class models and of continuation counts.
DISCOUNT, SHARED_DISCOUNT = 2.0, 0.75
#: Grams and contexts of a model that is sent to the tasks, 16 bytes each: 64 MB.
MODEL_GRAMS = 4_000_000
#: Labels that are sent to the tasks, 16 bytes each: 16 MB; more are joined by a shuffle.
SENT_LABELS = 1_000_000
#: Labelled documents kept from the models to fit the curve: a fifth of each class, and this many at most.
CURVE_ROWS = 4000
#: Expressions of a document whose differences are its most telling ones.
TELLING = 3
#: Documents with this score or more are taken to be toxic.
THRESHOLD = 0.7
#: Differences are whole numbers of this, so their sums do not depend on an order.
UNIT = 1e-6
_WORD = re.compile(r"\w+")
_PAD = "\0"
_U = np.uint64


def expressions(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of words, each word after ``ORDER - 1`` pads and before one; places of its characters and its end."""
    pad = _PAD * (ORDER - 1)
    text = pad + pad.join(words) + pad
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.zeros(len(codes), bool)
    ends[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes, np.flatnonzero(ends[ORDER - 1 :]) + ORDER - 1


def _fold(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` codes that end at each place."""
    h = np.full(len(at), width, _U)
    for k in range(width - 1, -1, -1):
        h = mix(h * _U(0x9E3779B97F4A7C15) + codes[at - k].astype(_U))
    return h


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the words and each word's end: the word, and hashes of the gram and its context."""
    codes, at = _codes(words)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
    return owner, _fold(codes, at, ORDER), _fold(codes, at - 1, ORDER - 1)


def _counts(labelled: DataFrame) -> DataFrame:
    """Every gram with the numbers of ordinary and toxic documents of its expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            seen = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                seen[toxic].update(set(expressions(text)))
            words = list(seen[0].keys() | seen[1].keys())
            if not words:
                continue
            codes, at = _codes(words)
            owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
            found, first, place = np.unique(_fold(codes, at, ORDER), return_index=True, return_inverse=True)
            window = codes[at[first][:, None] + np.arange(1 - ORDER, 1)]
            text = window.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            columns = [pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)])]
            for c in (0, 1):
                weight = np.fromiter((seen[c][w] for w in words), np.float64, len(words))[owner]
                columns.append(pa.array(np.bincount(place, weight, len(found)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["gram", "n0", "n1"])

    rows = labelled.select("text", "toxic").mapInArrow(run, "gram string, n0 long, n1 long")
    return rows.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _backoff(counts: DataFrame) -> DataFrame:
    """(``gram``, ``back``): the shared probability of a gram's last character after its last ``ORDER - 2`` ones.

    At order k a gram counts as often as it continues different grams of order k + 1; its context gives
    the discounts to order k - 1, and single characters give them to all characters alike, with one
    for those never seen.
    """
    levels, rows = [], counts.select("gram")
    for k in range(ORDER - 1, 0, -1):
        rows = rows.groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
        levels.append((k, rows))
        rows = rows.select("gram")
    p = None
    for k, rows in reversed(levels):
        context = rows.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = rows.withColumn("context", F.substring("gram", 1, k - 1)).join(context, "context")
        freed = F.lit(SHARED_DISCOUNT) * F.col("kinds") / F.col("total")
        if p is None:
            lower = F.lit(1.0) / (F.col("kinds") + 1)
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, k - 1)).join(p, "rest")
            lower = F.col("back")
        own = (F.col("n") - SHARED_DISCOUNT) / F.col("total")
        p = rows.select(F.col("gram").alias("rest"), (own + freed * lower).alias("back"))
    return p


def differences(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``gram``, ``d``) and (``context``, ``d``): toxic less ordinary log-likelihood, in units, of the
    last character of a counted gram, and of any other character after a counted context.

    A class gives a character max(n - D, 0) of its context's total, and what that leaves of the total,
    the sum of min(n, D), goes by the shared probability; a class that has not met the context gives the
    shared probability alone.  After a context, characters not counted there differ by what is left only.
    """
    least = lambda c: F.least(F.col(c).cast("double"), F.lit(DISCOUNT))
    head = F.substring("gram", 1, ORDER - 1).alias("context")
    sums = [f(c).alias(f"{n}{c[1]}") for c in ("n0", "n1") for n, f in (("t", F.sum), ("f", lambda x: F.sum(least(x))))]
    contexts = written(counts.groupBy(head).agg(*sums), "contexts")
    whole = lambda x: F.round(x / UNIT).cast("long").alias("d")
    left = [F.when(F.col(f"t{c}") > 0, F.col(f"f{c}") / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)]
    rows = counts.withColumns({"context": head, "rest": F.substring("gram", 2, ORDER - 1)}).join(contexts, "context").join(_backoff(counts), "rest")

    def p(c: int) -> Column:
        own = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0))
        return F.when(F.col(f"t{c}") > 0, (own + F.col(f"f{c}") * F.col("back")) / F.col(f"t{c}")).otherwise(F.col("back"))

    by_gram = rows.select("gram", whole(F.log(p(1)) - F.log(p(0))))
    return by_gram, contexts.select("context", whole(F.log(left[1]) - F.log(left[0])))


class Model:
    """The differences, to be sent to the tasks: hashes of grams and contexts, sorted, and their numbers."""

    def __init__(self, by_gram: DataFrame, by_context: DataFrame) -> None:
        self.grams, self.contexts = self._table(by_gram, ORDER), self._table(by_context, ORDER - 1)

    @staticmethod
    def _table(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
        got = rows.toArrow()
        codes = np.frombuffer("".join(got.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = _fold(codes, np.arange(width - 1, len(codes), width), width)
        order = np.argsort(hashes)
        return hashes[order], got.column("d").to_numpy()[order].astype(np.int64)

    def differences(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word, in units."""
        if not words:
            return np.zeros(0, np.int64)
        owner, gram, context = grams(words)
        one, first, place = np.unique(gram, return_index=True, return_inverse=True)
        d = np.zeros(len(one), np.int64)
        # a counted gram's own difference, else its context's, else none
        for (keys, values), wanted in ((self.contexts, context[first]), (self.grams, one)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                d = np.where(keys[at] == wanted, values[at], d)
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(d[place], ends - [len(w) + 1 for w in words])

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text the largest difference of an expression, the mean of the largest ones, and the mean difference a character."""
        sets = [set(expressions(t)) for t in texts]
        words = list(set().union(*sets)) if sets else []
        value = dict(zip(words, self.differences(words).tolist(), strict=True))
        out = np.zeros((len(texts), 3))
        for i, own in enumerate(sets):
            if own:
                mine = [value[w] for w in own]
                most = heapq.nlargest(TELLING, mine)
                out[i] = most[0] * UNIT, sum(most) / len(most) * UNIT, sum(mine) / (sum(map(len, own)) + len(own)) * UNIT
        return out


def _sent_evidence(docs: DataFrame, text: str, model: Model, names: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column=text):
            x = shared.value.evidence(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, x.T.copy())], [*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]]))


def _joined_evidence(docs: DataFrame, text: str, by_gram: DataFrame, by_context: DataFrame, names: list[str]) -> DataFrame:
    """The same by shuffles: distinct expressions meet the model gram by gram, and documents their expressions."""
    sha, word = fresh(docs, "sha", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            owners, found = [], []
            for key, t in zip(batch.column("sha").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = list(set(expressions(t)))
                owners += [key] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.string()), pa.array(found, pa.string())], ["sha", "word"])

    keyed = docs.withColumn(sha, F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    texts = keyed.groupBy(F.col(sha).alias("sha")).agg(F.first(text).alias("text"))
    pairs = written(texts.mapInArrow(run, "sha string, word string"), "pairs")
    padded = F.concat(F.lit(_PAD * (ORDER - 1)), F.col("word"), F.lit(_PAD))
    at = F.explode(F.sequence(F.lit(1), F.length("word") + 1))
    cut = pairs.select("word").distinct().select("word", padded.alias("padded"), at.alias("at"))
    cut = cut.select("word", F.expr(f"substring(padded, at, {ORDER})").alias("gram"), F.expr(f"substring(padded, at, {ORDER - 1})").alias("context"))
    known = cut.join(by_gram.select("gram", F.col("d").alias("own")), "gram", "left").join(by_context.select("context", F.col("d").alias("rest")), "context", "left")
    value = known.groupBy("word").agg(F.sum(F.coalesce("own", "rest", F.lit(0))).alias("d"))
    found = pairs.join(value, "word").groupBy("sha").agg(
        F.slice(F.sort_array(F.collect_list("d"), asc=False), 1, TELLING).alias("most"), F.sum("d").alias("whole"), F.sum(F.length("word") + 1).alias("size")
    )
    most = F.aggregate("most", F.lit(0).cast("long"), lambda n, d: n + d)
    evidence = [F.col("most")[0] * UNIT, most / F.size("most") * UNIT, F.col("whole") / F.col("size") * UNIT]
    found = found.select(F.col("sha").alias(sha), *[e.alias(n) for e, n in zip(evidence, names, strict=True)])
    joined = keyed.join(found, sha, "left").drop(sha)
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names})


def curve_value(evidence: list[Column], curve: np.ndarray) -> Column:
    """The curve's value, in columns."""
    z = F.lit(float(curve[0]))
    for x, w in zip(evidence, curve[1:].tolist(), strict=True):
        z = z + x * w
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50, rows: tuple[float, float] | None = None) -> np.ndarray:
    """Weights of a logistic curve over (1, x), by Newton steps; large weights of columns of equal spread cost.

    A row weighs as the square root of its class's rarity: half way from all rows alike to both
    classes alike.  ``rows``: how many rows of class 0 and 1 the given ones stand for, if not themselves.
    """
    spread = x.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(x)), x / spread])
    drawn = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    stand = drawn if rows is None else np.array(rows) * len(y) / sum(rows)
    share = (np.sqrt(len(y) / 2 / stand) * stand / drawn)[y]
    w, cost = np.zeros(x.shape[1]), np.diag([0.0, *[1e-2] * len(spread)]) * len(y) ** 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + cost @ w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + cost + 1e-6 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w / np.concatenate([[1.0], spread])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    *,
    text: str = "text",
    key: str = "doc_id",
    label: str = "toxic",
    curve_rows: int = CURVE_ROWS,
    model_grams: int = MODEL_GRAMS,
    sent_labels: int = SENT_LABELS,
) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1, higher: toxic likelier) and ``predicted``.

    Models learn from the labelled rows where ``train`` holds, all but a sample kept for the curve:
    a fifth of each class, at most ``curve_rows`` in all, the same rows at every run; of two rows of a
    class one is kept.  If a class has one row, the curve is fixed and rises with the evidence.  A document with several
    labels counts as toxic if one says so; null labels and labels without document are left out.
    Null and empty texts have no expression and get the curve's value at no evidence.  Without
    labels of both classes nothing can be learnt and every score is 0.  Repeated rows score alike.
    An empty table gives an empty table.  A clashing column name is prefixed with ``_``.

    A model of up to ``model_grams`` grams is sent to the tasks, and a larger one joined, with the same scores; so are
    up to ``sent_labels`` labels.
    """
    score, predicted, *names = fresh(docs, "score", "predicted", "largest", "telling", "mean")
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"))
    marks = written(marks.agg(F.max((F.col(label) > 0).cast("int")).alias("toxic")), "labels")
    rows = docs.where(train).select(F.col(key).alias("key"), F.col(text).alias("text"))
    how = "broadcast" if marks.count() <= sent_labels else "merge"
    known = rows.select("key").join(marks.hint(how), "key").withColumn("draw", F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 40)))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    rows_of = (sizes.get(0, 0), sizes.get(1, 0))
    if not min(rows_of):
        return docs.withColumns({score: F.lit(0.0), predicted: F.lit(0)})
    held = F.lit(False)
    for c in (0, 1):
        m = min(max(rows_of[c] // 5, int(rows_of[c] > 1)), max(1, curve_rows // 2))
        if m:
            up_to = known.where(F.col("toxic") == c).select("draw").orderBy("draw").limit(m).agg(F.max("draw")).first()[0]
            held = held | ((F.col("toxic") == c) & (F.pmod(F.xxhash64("key", F.lit(23)), F.lit(1 << 40)) <= up_to))
    rows = rows.join(marks.hint(how), "key")
    counts = written(_counts(rows.where(~held)), "grams")
    by_gram, by_context = (written(t, "model") for t in differences(counts))
    if by_gram.count() + by_context.count() <= model_grams:
        model = Model(by_gram, by_context)
        evidence = lambda df, column, names: _sent_evidence(df, column, model, names)
    else:
        evidence = lambda df, column, names: _joined_evidence(df, column, by_gram, by_context, names)
    columns = ["largest", "telling", "mean"]
    got = evidence(rows.where(held).select("text", "toxic"), "text", columns).select("toxic", *columns).toPandas()
    got = got.sort_values(["toxic", *columns])
    scored = evidence(docs, text, names)
    p = curve_value([F.col(n) for n in names], _fit(got[columns].to_numpy(), got["toxic"].to_numpy(), rows_of))
    return scored.withColumn(score, p).withColumn(predicted, (F.col(score) >= THRESHOLD).cast("int")).select(*docs.columns, score, predicted)


def _fit(x: np.ndarray, y: np.ndarray, rows_of: tuple[int, int]) -> np.ndarray:
    if len(set(y.tolist())) < 2:
        # half the classes' log odds, as fit_curve weighs them, and the largest difference as it stands
        return np.array([np.log(rows_of[1] / rows_of[0]) / 2, 1.0, 0.0, 0.0])
    return fit_curve(x, y, rows=rows_of)
