"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each text. The ledger keeps the measurements
and one integer whose bit ``i`` says that rule ``i`` failed. Policies are
named, versioned sets of rules, applied later by a bitwise AND without
touching a text again, and ablations come from counts by bit pattern.

Defined cases: a null or empty text has no words and fails ``few_words``; a
text of any length is measured whole; repeated rows give repeated ledger rows;
an empty table gives an empty ledger; columns other than the text are carried
along unless they bear a name of the ledger, in which case the ledger's column
replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialised, n_symbols, words_of

WINDOW = 3

#: name -> failure test over the measurements; the position is the bit.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_windows": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "many_symbols": lambda m: 100 * m("n_symbols") > 40 * m("n_words"),
    "duplicate_lines": lambda m: 100 * m("n_dup_lines") > 60 * m("n_lines"),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 25 * m("n_words"),
    "repeated_words": lambda m: 100 * m("n_distinct_words") < 8 * F.least(m("n_words"), F.lit(500)),
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "many_symbols", "duplicate_lines"),
    "web-2": tuple(RULES),
}
DEFAULT_POLICY = "web-2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_distinct_words")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    A window is one long: the high bits of its hash and, in the low bits, its
    position. Sorting brings equal windows side by side, so the work is
    n log n however often a window repeats; neighbours with equal hash bits are
    compared word by word. A text whose windows are all distinct is not sorted."""
    def covered(w, hashes):
        span = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w).cast("long"))))

        def positions(span):
            place = lambda x: x.bitwiseAND(span - 1).cast("int")
            ordered = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(-span) + i))
            same = lambda a, b: (a.bitwiseAND(-span) == b.bitwiseAND(-span)) & (
                F.get(w, place(a)) == F.get(w, place(b))) & (
                F.get(w, place(a) + 1) == F.get(w, place(b) + 1)) & (
                F.get(w, place(a) + 2) == F.get(w, place(b) + 2))
            pairs = let(ordered, lambda s: F.transform(
                F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda k: same(F.get(s, k), F.get(s, k + 1))),
                lambda k: F.array(place(F.get(s, k)), place(F.get(s, k + 1)))))
            return F.sort_array(F.array_distinct(F.flatten(pairs)))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(span, positions), start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"),
                                    i.alias("last")))["n"]

    def hashes(w):
        shifted = [F.slice(w, 1 + j, F.size(w) - (WINDOW - 1)).alias(f"w{j}") for j in range(WINDOW)]
        return F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(z))

    windows = lambda w: let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, h)))
    return let(words, lambda w: F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(windows(w)))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document: its columns, the measurements and
    ``fail_bits`` (long). Narrow: no shuffle, no Python."""
    names = {*MEASURES, "fail_bits"}
    keep = [c for c in docs.columns if c.lower() not in names]
    # the columns that are carried go through by number and cannot meet the names used here
    packed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    t = F.coalesce(F.col("text"), F.lit(""))
    first = materialised(packed, words=words_of(t),
                         lines=F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    long = lambda c: c.cast("long")
    measured = materialised(
        first,
        n_words=long(F.size("words")),
        word_chars=long(F.length(F.array_join("words", ""))),
        n_symbols=long(n_symbols(t)),
        n_lines=long(F.size("lines")),
        n_dup_lines=long(F.size("lines") - F.size(F.array_distinct("lines"))),
        n_repeat_words=long(repeat_words(F.col("words"))),
        n_distinct_words=long(F.size(F.array_distinct("words"))),
    ).drop("words", "lines", "text")
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(F.col), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long"))
    return materialised(measured, fail_bits=bits).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *MEASURES, "fail_bits")


def mask_of(policy: str | tuple[str, ...]) -> int:
    """The bit mask of a named policy or of a tuple of rule names."""
    return sum(BITS[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def passes(policy: str | tuple[str, ...] = DEFAULT_POLICY, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str | tuple[str, ...] = DEFAULT_POLICY,
                 out: str = "kept") -> DataFrame:
    """The ledger with the policy's verdict in ``out``."""
    return led.withColumn(out, passes(policy))


def ablations(led: DataFrame, policy: str | tuple[str, ...] = DEFAULT_POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, documents that
    only it rejects (they come back if the rule goes), and documents rejected
    by the policy without it. One count by bit pattern (at most 2^rules
    groups) and bitwise sums over those few rows."""
    mask = mask_of(policy)
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit"))
                               for r in rules])).alias("r")
    b = F.col("bits")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (patterns.select("bits", "n", rows).select("bits", "n", "r.rule", "r.bit").groupBy("rule")
            .agg(total(b.bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
                 total(b == F.col("bit")).alias("n_only"),
                 total(b.bitwiseAND(F.bitwise_not(F.col("bit"))) != 0).alias("n_rejected_without"),
                 F.sum("n").alias("n_docs")))
