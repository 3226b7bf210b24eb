"""Quality rules as a ledger: each rule is evaluated once, policies are masks over its bits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import grams, hash_spans, row_order, slices, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_letters", "n_shouts")

#: Rules in the order of their bits: a rule's condition says that a text fails it.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "2 * n_words > word_chars",
    "long_words": "word_chars > 20 * n_words",
    "upper_case": "100 * n_upper > 40 * n_letters",
    "shouts": "100 * n_shouts > 20 * n_words",
}
BASE = ("few_words", "repeated_words")

#: Versioned policies: the rules that each enforces.
POLICIES: dict[str, Sequence[str]] = {
    "base-1": BASE,
    "corpus-1": (*BASE, "symbols", "duplicate_lines", "upper_case"),
    "corpus-2": tuple(RULES),
}

_CLASS = np.zeros((4, 256), dtype=bool)
_CLASS[0, list(b"#*$%&|<>")] = True
_CLASS[1, 0x41:0x5B] = True
_CLASS[2, [*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CLASS[3, ord("!")] = True


def _per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set in each range of ``first``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def _repeated(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each value, whether its row holds it more than once; and whether a copy of it is in a lower place."""
    order, new = row_order(values, first)
    runs = np.cumsum(new) - 1
    again, earlier = np.zeros((2, len(values)), dtype=bool)
    if len(values):
        sizes = np.bincount(runs)
        again[order] = sizes[runs] > 1
        least = np.minimum.reduceat(order, np.flatnonzero(new))
        earlier[order] = order != least[runs]
    return np.array([again, earlier])


def measured(column: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text; a null counts as empty."""
    words = words_of(column)
    data, offsets = words.data, words.offsets
    hashes = words.hashes()
    windows, upto = grams(hashes, words.first, 3)
    twice = _repeated(windows, upto)[0]
    covered = np.zeros(len(hashes) + 2, dtype=bool)
    at = np.arange(len(windows)) + np.repeat(words.first[:-1] - upto[:-1], np.diff(upto))
    for k in range(3):
        covered[at[twice] + k] = True

    breaks = np.flatnonzero(data == 0x0A)
    rows = np.flatnonzero(np.diff(offsets))
    starts = np.sort(np.concatenate([breaks + 1, offsets[rows]]))
    ends = np.sort(np.concatenate([breaks, offsets[rows + 1]]))
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    lines = np.searchsorted(starts, offsets)
    again = _repeated(hash_spans(data, starts, ends), lines)[1]

    points = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(points, out=inside[1:])
    chars = np.concatenate([[0], np.cumsum(inside[words.ends] - inside[words.starts])])
    kinds = [_per_row(kind[data], offsets) for kind in _CLASS]
    return [words.counts, np.diff(chars[words.first]), kinds[0], _per_row(again, lines),
            _per_row(covered[:-2], words.first), np.diff(lines), kinds[1], kinds[2], kinds[3]]


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
           rules: Mapping[str, str] = RULES) -> DataFrame:
    """``id_col``, MEASURES and ``failures``: bit i is set if the text fails the i-th rule.

    Each text is read once, in its partition; nothing is shuffled. A null text counts as
    empty: all measures 0. Null ids and repeated rows are kept; an empty table gives an
    empty ledger; other columns of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [pa.array(m.astype(np.int64)) for m in measured(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["id", *MEASURES])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(measure, f"id {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = sum((F.when(F.expr(fails), F.lit(1 << i)).otherwise(0).cast("long")
                for i, fails in enumerate(rules.values())), F.lit(0).cast("long"))
    return out.withColumn("failures", bits).withColumnRenamed("id", id_col)


def mask(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    """The bits of the named rules."""
    order = list(rules)
    return sum(1 << order.index(name) for name in set(names))


def passes(policy: str | Sequence[str], rules: Mapping[str, str] = RULES) -> Column:
    """Whether a ledger row fails no rule of the policy."""
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col("failures").bitwiseAND(F.lit(mask(names, rules))) == 0


def ablations(entries: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES,
              rules: Mapping[str, str] = RULES) -> DataFrame:
    """What each rule of each policy rejects: ``policy``, ``rule``, ``rejected``, ``only_this``.

    ``only_this`` texts would be kept without the rule. Texts are first counted by their
    bits (at most 2**rules rows), so any number of policies costs one pass.
    """
    counts = entries.groupBy("failures").agg(F.count("*").alias("n"))
    order = list(rules)
    cases = F.array(*(
        F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"),
                 F.lit(mask(names, rules)).cast("long").alias("mask"),
                 F.lit(1 << order.index(r)).cast("long").alias("bit"))
        for p, names in policies.items() for r in names))
    hit = F.col("failures").bitwiseAND(F.col("c.bit")) != 0
    alone = F.col("failures").bitwiseAND(F.col("c.mask")) == F.col("c.bit")
    return (
        counts.select("failures", "n", F.explode(cases).alias("c"))
        .groupBy("c.policy", "c.rule")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
             F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only_this"))
    )
