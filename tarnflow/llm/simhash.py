"""SimHash near-duplicates: fingerprints, links by multi-index hashing, components, one document of each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.components import components
from tarnflow.llm.shared import NULL_ID, forget, fresh, meet, release, small_batches, written
from tarnflow.llm.shingles import NEAR, OF, SEED, key_members, may_be_near, may_fit, packed_texts, similar, with_keys
from tarnflow.llm.words import SPACES_LOWER, batches_of, column_bytes

#: Bits by which linked fingerprints differ at most.
LIMIT = 2
#: Bits of a segment, lowest first; of two linked fingerprints the first segments differ by at most
#: one bit, or else the second ones by none.  Fixed by ``LIMIT``.
SEGMENT = 32
#: Fingerprints of a bucket of a segment's table that are compared one by one.
BUCKET = 64


def fingerprint(text: bytes, shingle: int) -> bytes:
    """Big-endian fingerprint: a bit is 1 if it is set in over half of the shingles' hashes."""
    digest, width = xxhash.xxh64_digest, 8
    ones, total, carry = np.zeros(8 * width, np.int64), 0, []
    last = b""
    for piece in SPACES_LOWER.pieces(text):
        words = carry + piece.lower().split()
        n = len(words) - shingle + 1
        if n > 0:
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
            starts = [0, *(e + 1 for e in ends[: n - 1])]
            raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=True)])
            ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, width), axis=1).sum(axis=0, dtype=np.int64)
            total += n
        carry = words[max(0, n) :]
        last = last if n > 0 else b" ".join(words)
    if not total and last:
        return digest(last, SEED)
    return np.packbits(2 * ones > total).tobytes()


def with_fingerprints(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed long."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, column=text):
            prints = b"".join([fingerprint(t, shingle) for t in column_bytes(batch.column(text))])
            values = np.frombuffer(prints, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _flip(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def _spread(df: DataFrame) -> DataFrame:
    """In as many parts as a shuffle has: rows are few bytes and are about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)


def segment_table(x: DataFrame) -> DataFrame:
    """(``key``, ``y``): each fingerprint under the value of each of its segments, the segment's number above."""
    low, high = F.col("x").bitwiseAND((1 << SEGMENT) - 1), F.shiftrightunsigned("x", SEGMENT)
    return x.select(F.explode(F.array(low, high + (1 << SEGMENT))).alias("key"), F.col("x").alias("y"))


def ball_probes(x: DataFrame) -> DataFrame:
    """(``key``, ``x``): the buckets in which a fingerprint looks for linked ones.

    The first segment's ball has radius 1, the second's radius 0.  Of two values that differ by one
    bit, the one without the bit looks for the other, so half of the ball is enough.
    """
    low, high = F.col("x").bitwiseAND((1 << SEGMENT) - 1), F.shiftrightunsigned("x", SEGMENT)
    bits = F.array(*[F.lit(b) for b in range(SEGMENT)])
    ball = F.transform(F.filter(bits, lambda b: F.col("x").bitwiseAND(_flip(b)) == 0), lambda b: low.bitwiseOR(_flip(b)))
    return x.select(F.explode(F.concat(F.array(low, high + (1 << SEGMENT)), ball)).alias("key"), "x")


def links(prints: DataFrame, column: str) -> DataFrame:
    """Links (``a``, ``b``) that join all distinct fingerprints at most 2 bits apart.

    Multi-index hashing: each fingerprint stands in the table of each segment; it enumerates the small
    balls around its own segments' values, fetches what the tables hold there, and complete distances
    decide.  A bucket of more than ``BUCKET`` fingerprints is not paired out: those in it and those
    that look there go by ``dense_links``, which is as exact and gathers 65 at most under a key.
    """
    x = _spread(written(prints.select(F.col(column).alias("x")).distinct(), "distinct-prints"))
    table, probes = segment_table(x), ball_probes(x)
    full = written(table.groupBy("key").count().where(F.col("count") > BUCKET).select("key"), "full-buckets")
    crowded = not full.isEmpty()
    if crowded:
        table = table.join(full, "key", "left_anti")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    low = F.bit_count(differ.bitwiseAND((1 << SEGMENT) - 1))
    # each pair once: the second table gives what the first cannot, and members of one bucket in order
    first = (low == 1) | ((low == 0) & (F.col("x") < F.col("y")))
    wanted = F.when(F.col("key") < 1 << SEGMENT, first).otherwise((low == LIMIT) & (F.col("x") < F.col("y")))
    met = probes.join(table, "key").where(wanted & (F.bit_count(differ) <= LIMIT))
    found = met.select(F.col("x").alias("a"), F.col("y").alias("b"))
    if crowded:
        there = probes.union(segment_table(x).select("key", F.col("y").alias("x"))).join(full, "key", "left_semi").select("x").distinct()
        found = found.union(dense_links(_spread(there)))
    return found


def dense_links(x: DataFrame) -> DataFrame:
    """Star links (``a``, ``b``) that join all fingerprints ``x`` at most 2 bits apart, however many share a segment.

    Of two such fingerprints, one that is one bit away from both, or one of the two, is in the ball
    of radius 1 of both.  So a key is a segment's ball member with the rest of the fingerprint as it
    stands; it gathers 65 at most, and whom it gathered is a mask of 64 bits and a flag, which sums
    before the shuffle.  Members of a key are at most 2 bits apart and are linked to its least.
    """
    bits = F.array(*[F.lit(b) for b in range(64)])
    ball = F.transform(bits, lambda b: F.struct(F.col("x").bitwiseXOR(_flip(b)).alias("key"), _flip(b).alias("mask")))
    own = F.array(F.struct(F.col("x").alias("key"), F.lit(0).cast("long").alias("mask")))
    keys = x.select(F.explode(F.concat(own, ball)).alias("k")).select("k.key", "k.mask")
    met = keys.groupBy("key").agg(
        F.bit_or("mask").alias("mask"), F.max(F.col("mask") == 0).alias("own")
    )
    met = met.where(F.bit_count("mask") + F.col("own").cast("int") > 1)
    near = F.transform(
        F.filter(bits, lambda b: F.col("mask").bitwiseAND(_flip(b)) != 0), lambda b: F.col("key").bitwiseXOR(_flip(b))
    )
    members = F.when(F.col("own"), F.concat(F.array("key"), near)).otherwise(near)
    met = met.select(F.array_min(members).alias("b"), F.explode(members).alias("a"))
    return met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LIMIT)).distinct()


def near_duplicates(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 3
) -> DataFrame:
    """Per row of ``docs``: its key, ``fingerprint`` (signed long) and ``component_id``.

    Fingerprints at most 2 bits apart are linked; a component's id is the least key that is
    reachable.  Texts of fewer words than a shingle are one shingle; texts without words and null
    texts have fingerprint 0 and are linked like others.  A null key has a row and is nobody's
    component id unless no other key is reachable.  Repeated rows stand one by one.
    An empty table gives an empty table.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    prints = written(with_fingerprints(narrow, "text", shingle, "fp").select("key", "fp"), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("key").alias("least"))
    found = components(links(prints, "fp")).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = written(least.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


#: Rows of whole texts, and of pairs of them, that go to Python at once.
BATCH_ROWS, PAIR_ROWS = 1000, 32
#: Rounds of stars at most before all pairs that are left are compared, and the share of a round's pairs that must be
#: near for another to follow.
ROUNDS, GOOD = 12, 0.5
#: Members of a key with which the others are compared in a round, and pairs of a text that are verified in it.
STARS = 3


def _fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """Pairs of ids whose SimHashes are linked, by one id of each fingerprint, and of ids that share one."""
    least = written(sets.groupBy("fp").agg(F.min("id").alias("least")), "least")
    same = sets.join(least, "fp").where(F.col("id") != F.col("least")).select(F.col("id").alias("a"), F.col("least").alias("b"))
    of = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"{end}_id"))
    linked = links(least, "fp").join(of("a"), "a").join(of("b"), "b")
    return same.union(linked.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def _with_roots(rows: DataFrame, ends: tuple[str, ...], roots: DataFrame) -> DataFrame:
    """``rows`` with the component of each id in ``ends``, as ``<end>_root``."""
    for end in ends:
        root = roots.select(F.col("a").alias(end), F.col("b").alias("to"))
        rows = rows.join(root, end, "left").withColumn(f"{end}_root", F.coalesce("to", end)).drop("to")
    return rows


def near_links(members: DataFrame, sketches: DataFrame, first: DataFrame, verify: Callable[[DataFrame], DataFrame], possible: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``components`` of the links between all ids of near sets; ``members`` has ``key``, ``id``, ``n`` and ``lead``,
    ``sketches`` each id's, ``first`` pairs to begin with.

    In a round, the members of a key are compared with a few of them, others in each round, and a few of an
    id's pairs are verified.  Then members of one component have no need to meet any more.  After a round
    that finds few near pairs, all pairs of different components left under the keys are compared: first one
    for each id, then those of ids still apart.  Of a pair the smaller set must lead under the key.
    ``possible`` leaves out pairs that sizes and sketches rule out, ``verify`` those that are not near.
    Components are carried on: each round's near pairs are added to the stars of those before.
    """
    spark = members.sparkSession
    fits = F.least("n", "b_n") * OF >= F.greatest("n", "b_n") * NEAR
    found, rest = None, members.withColumn("id_root", F.col("id"))
    for turn in range(ROUNDS):
        by = [F.min(F.struct(F.xxhash64("id", F.lit(STARS * turn + i)), "id", "n", "id_root")) for i in range(STARS)]
        some = rest.groupBy("key").agg(F.array_distinct(F.array(*by)).alias("some")).select("key", F.explode("some").alias("one"))
        met = rest.join(some.select("key", F.col("one.id").alias("b"), F.col("one.n").alias("b_n"), F.col("one.id_root").alias("b_root")), "key")
        met = met.where((F.col("id_root") != F.col("b_root")) & fits).select(F.col("id").alias("a"), "b").distinct()
        # at most so many pairs of a text, others in each round
        star = possible(met).groupBy("a").agg(F.array_sort(F.collect_set(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b"))).alias("s"))
        star = star.select("a", F.explode(F.slice("s", 1, STARS)).alias("s")).select("a", "s.b")
        star = written(star if turn else star.union(first.select("a", "b")), "star")
        tried, near = star.count(), verify(star)
        before, found = found, components(near if found is None else found.union(near))
        good = near.count() >= GOOD * tried
        forget(star, near, *([] if before is None else [before]))
        moved = written(_with_roots(rest.drop("id_root"), ("id",), found), "moved")
        open_ = moved.groupBy("key").agg(F.min("id_root").alias("x"), F.max("id_root").alias("y")).where("x != y").select("key")
        forget(rest)
        rest = written(moved.join(open_, "key"), "rest")
        forget(moved)
        release(spark)
        if rest.isEmpty():
            return found
        if not good:
            break
    rest = written(rest.join(sketches, "id"), "rest")
    other = rest.select("key", *[F.col(c).alias(f"b_{c}") for c in ("id", "n", "id_root", "sketch")])
    rest = rest.where("lead")
    # sizes and sketches are part of the join, so pairs that they rule out are not made
    fits = may_fit("n", "sketch", "b_n", "b_sketch")
    smaller = (F.col("n") < F.col("b_n")) | ((F.col("n") == F.col("b_n")) & (F.col("id") < F.col("b_id")))
    met = rest.join(other, "key").where(smaller & (F.col("id_root") != F.col("b_id_root")) & fits)
    pairs = written(met.select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct(), "pairs")
    one = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "one")
    if one.isEmpty():
        return found
    found = components(found.union(verify(one)))
    release(spark)
    apart = _with_roots(pairs.join(one, ["a", "b"], "left_anti"), ("a", "b"), found).where(F.col("a_root") != F.col("b_root"))
    apart = written(apart.select("a", "b"), "apart")
    return found if apart.isEmpty() else components(found.union(verify(apart)))


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group, the row of least key stays.

    A group is a component of links between texts whose sets of ``shingle``-word shingles have a
    Jaccard similarity of 0.8 at least: all such pairs are linked, and no others.  SimHash finds the
    nearest by multi-index hashing (``links``); since no small distance reaches all pairs of 0.8,
    ``near_links`` finds the rest.  Every link is verified on the whole sets.
    Texts without words form one group.  A null key is less than every other; equal keys rank by a
    hash of their texts; of equal rows one stays.  Columns stay as they are.  An empty table gives
    an empty table.
    """
    k, t, n = fresh(docs, "key", "text_hash", "n")
    keyed = docs.withColumn(k, F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))).withColumn(t, F.xxhash64(text))
    narrow = keyed.select(F.col(k).alias("k"), F.col(t).alias("t"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession, BATCH_ROWS):
        goes, twice = _goes(narrow, shingle)
    kept = meet(keyed, goes.select(F.col("k").alias(k), F.col("t").alias(t)), [k, t], "left_anti")
    if twice:
        one = Window.partitionBy(k, t).orderBy(*[c for c in docs.columns if c not in (key, text)] or [F.lit(1)])
        kept = kept.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).drop(n)
    return kept.drop(k, t)


def _goes(narrow: DataFrame, shingle: int) -> tuple[DataFrame, bool]:
    """(``k``, ``t``) of the rows of ``narrow`` that have a near copy of less key; whether some rows are repeated."""
    prints = written(with_keys(narrow, shingle), "prints")
    of_set = [F.first(c).alias(c) for c in ("n", "fp", "sketch")]
    sets = written(prints.groupBy("id").agg(F.min(F.struct("k", "t")).alias("at"), *of_set).select("id", "at.k", "at.t", "n", "fp", "sketch"), "sets")

    def possible(pairs: DataFrame) -> DataFrame:
        return may_be_near(pairs, sets)

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs if hasattr(pairs, "scratch_path") else written(pairs, "pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        wanted = written(sets.select("id", "k", "t").join(ids, "id"), "ids")
        # a row here has two whole texts, and long ones may come together
        with small_batches(narrow.sparkSession, PAIR_ROWS):
            near = written(similar(pairs, packed_texts(wanted, narrow), shingle), "near")
        forget(wanted)
        return near

    members = key_members(prints)
    places = written(prints.select("k", "t", "id"), "places")
    forget(prints)
    first = written(possible(_fingerprint_pairs(sets)), "first")
    release(narrow.sparkSession)
    found = near_links(members, sets.select("id", "sketch"), first, verify, possible).select(F.col("a").alias("id"), F.col("b").alias("root"))
    rooted = written(places.join(found, "id", "left").select("k", "t", F.coalesce("root", "id").alias("root")), "roots")
    stays = rooted.groupBy("root").agg(F.min(F.struct("k", "t")).alias("stay"))
    goes = rooted.join(stays, "root").where((F.col("k") != F.col("stay.k")) | (F.col("t") != F.col("stay.t")))
    goes = written(goes.select("k", "t").distinct(), "goes")
    twice = not places.groupBy("k", "t").count().where("count > 1").isEmpty()
    forget(sets, members, places, rooted, first)
    return goes, twice
