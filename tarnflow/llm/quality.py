"""Quality rules as a ledger of bits, with DataFrame operations only.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit a failed
rule; policies are masks of bits with a version, applied to the ledger without reading texts again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import WORD, fresh

#: Words of a window whose repeats are counted.
GRAM = 3


@dataclass(frozen=True)
class Rule:
    """A bit, a name and the condition on the measurements under which a document fails."""

    bit: int
    name: str
    fails: Callable[[dict[str, Column]], Column]


@dataclass(frozen=True)
class Policy:
    """A version and the rules that it enforces."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule(0, "too_few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_words", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
    Rule(3, "symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(4, "repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule(5, "empty", lambda m: m["n_words"] == 0),
)
BASE = Policy("base", ("too_few_words", "repeated_words"))
STANDARD = Policy("v1", tuple(r.name for r in RULES))


def mask_of(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[name] for name in policy.rules)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, gram: int = GRAM) -> Column:
    """Words in windows of ``gram`` words that the text has twice or more.

    Hashes of windows are sorted with their places, so equal windows are neighbours; the places of those
    with an equal neighbour are sorted again, and each adds the words that the place before does not
    cover.  Neighbours of equal hash are compared word by word: should a hash have misled, the text's windows are
    sorted themselves.
    """

    def windows(w: Column) -> Column:
        n = F.size(w) - gram + 1
        at = F.sequence(F.lit(1), n)
        hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i - 1 + k) for k in range(gram)]))
        several = lambda h: F.size(F.array_distinct(h)) < F.size(h)
        by_hash = lambda h: F.when(several(h), _let(F.array_sort(F.arrays_zip(h.alias("g"), at.alias("i"))), lambda s: checked(s, w))).otherwise(F.lit(0))
        return F.when(n < 2, F.lit(0)).otherwise(_let(hashed, by_hash))

    def checked(s: Column, w: Column) -> Column:
        same = lambda x, y: F.forall(F.sequence(F.lit(0), F.lit(gram - 1)), lambda k: F.get(w, x["i"] - 1 + k) == F.get(w, y["i"] - 1 + k))
        misled = F.exists(F.transform(s, lambda x, k: F.struct(x.alias("x"), F.get(s, k - 1).alias("y"))), lambda p: (p["x"]["g"] == p["y"]["g"]) & ~same(p["x"], p["y"]))
        joined = F.transform(F.sequence(F.lit(1), F.size(w) - gram + 1), lambda i: F.struct(F.slice(w, i, gram).alias("g"), i.alias("i")))
        return F.when(F.coalesce(misled, F.lit(False)), _let(F.array_sort(joined), places)).otherwise(places(s))

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
        return _let(F.array_sort(F.transform(same, lambda x: x["i"])), spread)

    def spread(p: Column) -> Column:
        gained = F.transform(p, lambda x, k: F.least(F.lit(gram), F.coalesce(x - F.get(p, k - 1), F.lit(gram))))
        return F.aggregate(gained, F.lit(0), lambda a, x: a + x)

    return _let(words, windows).cast("long")


#: What a line without words is made of.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters that count as symbols; fixed.
SYMBOLS = "#*$%&|<>"


def measurements(text: Column) -> Column:
    """What the rules look at, as fields of one column: the text's words are taken once."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    found = {
        "n_words": lambda w, _: F.size(w),
        "word_chars": lambda w, _: F.length(F.array_join(w, "")),
        "n_symbols": lambda w, _: F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": lambda _, x: F.size(x),
        "n_dup_lines": lambda _, x: F.size(x) - F.size(F.array_distinct(x)),
        "n_repeat_words": lambda w, _: repeated_words(w),
    }
    return _let(words, lambda w: _let(lines, lambda x: F.struct(*[f(w, x).cast("long").alias(n) for n, f in found.items()])))


MEASURED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def quality_ledger(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``docs`` with the measurements and ``failed``, a bit for each rule it fails.

    A null text counts as an empty one: it has no words and one rule for that.  Equal rows get equal
    ledgers.  An empty table gives an empty table.  Clashing column names are prefixed with ``_``.
    Nothing is shuffled.
    """
    *own, failed, ledger = fresh(docs, *MEASURED, "failed", "ledger")
    names = dict(zip(MEASURED, own, strict=True))
    measured = docs.withColumn(ledger, measurements(F.col(text))).withColumns({names[k]: F.col(f"`{ledger}`.{k}") for k in MEASURED}).drop(ledger)
    values = {k: F.col(names[k]) for k in MEASURED}
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(rule.fails(values), F.lit(1 << rule.bit)).otherwise(0).cast("long"))
    return measured.withColumn(failed, bits)


def passes(policy: Policy, failed: Column | str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether no rule of the policy failed."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablations(ledger: DataFrame, policy: Policy, *, failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: how many rows fail it, fail it alone, and would be kept without it.

    Rows are first counted by their bits, so no more than 2 ** (number of rules) counts are shuffled.
    An empty ledger gives no rows.
    """
    mask = mask_of(policy, rules)
    hit = F.col(failed).bitwiseAND(F.lit(mask).cast("long")).alias("hit")
    counts = ledger.groupBy(hit).agg(F.count("*").alias("n"))
    chosen = [r for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in chosen]))
    rows = counts.select("hit", "n", each.alias("r")).select("hit", "n", "r.rule", "r.bit")
    fails = F.col("hit").bitwiseAND(F.col("bit")) != 0
    alone = F.col("hit") == F.col("bit")
    kept = (F.col("hit") == 0) | alone
    total = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for c, a in ((fails, "n_failed"), (alone, "n_alone"), (kept, "n_kept_without"))]
    return rows.groupBy("rule").agg(F.lit(policy.version).alias("policy"), *total)
