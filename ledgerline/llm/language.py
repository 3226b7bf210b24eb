"""Language identification by cross-parsing entropy against suffix automata."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.words import slices

SAMPLE_TEXTS = 64            # labelled texts of a language that the fit reads at most, whole
SAMPLE_CHARS = 4_096         # of such a text; a language that has none so short teaches by its shortest
ALL_CHARS = 2_400_000        # of all such texts: bounds a worker's memory, by fewer texts of many languages
DENSE = 64                   # codes of a language that have a column in its table; the rest are looked up
PIECE = 256                  # characters parsed in lockstep with other pieces
UNKNOWN = "und"


def _normalised(text: str) -> str:
    """Lower case, everything but letters as single spaces."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_edges(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings.

    The root is state 0: a walk from it goes on as long as what it has read occurs in ``codes``.
    """
    links, lengths, nexts, last = [-1], [0], [{}], 0
    for code in codes.tolist():
        new = len(nexts)
        links.append(0)
        lengths.append(lengths[last] + 1)
        nexts.append({})
        state, last = last, new
        while state >= 0 and code not in nexts[state]:
            nexts[state][code] = new
            state = links[state]
        if state < 0:
            continue
        follower = nexts[state][code]
        if lengths[follower] == lengths[state] + 1:
            links[new] = follower
            continue
        clone = len(nexts)
        links.append(links[follower])
        lengths.append(lengths[state] + 1)
        nexts.append(dict(nexts[follower]))
        links[follower] = links[new] = clone
        while state >= 0 and nexts[state].get(code) == follower:
            nexts[state][code] = clone
            state = links[state]
    return nexts


def _table(edges: list[dict[int, int]], letters: int) -> np.ndarray:
    """Transitions (state, code) of the codes below ``letters``; -1 where there is none."""
    table = np.full((len(edges), letters), -1, dtype=np.int32)
    for state, some in enumerate(edges):
        for code, to in some.items():
            if code < letters:
                table[state, code] = to
    return table


def suffix_automaton(codes: np.ndarray, letters: int) -> np.ndarray:
    """Transitions (state, letter) of the automaton of all substrings; -1 where there is none."""
    return _table(suffix_edges(codes), letters)


class Automaton:
    """All substrings of one language's text, over the letters of that language.

    ``own`` maps the codes of all languages to those of this one: 0 a space, 1 a letter that
    its text lacks, then its letters, the most frequent first. The first DENSE codes have
    columns in a table, the transitions of the others stand sorted by state and code.
    """

    def __init__(self, codes: np.ndarray, kinds: int):
        counts = np.bincount(codes, minlength=kinds)
        counts[:2] = 0
        known = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
        self.own = np.ones(kinds, dtype=np.int64)
        self.own[0] = 0
        self.own[known] = np.arange(2, 2 + len(known))
        self.letters = 2 + len(known)
        edges = suffix_edges(self.own[codes])
        self.width = min(self.letters, DENSE)
        self.flat = _table(edges, self.width).ravel()
        rest = sorted((state * self.letters + code, to) for state, some in enumerate(edges)
                      for code, to in some.items() if code >= self.width)
        self.keys = np.array([key for key, _ in rest], dtype=np.int64)
        self.targets = np.array([to for _, to in rest], dtype=np.int32)

    def after(self, state: np.ndarray | int, code: np.ndarray) -> np.ndarray:
        """The states after reading own codes; -1 where there is no transition."""
        if not len(self.keys):
            return self.flat[state * self.width + code].astype(np.int64)
        rare = code >= self.width
        found = self.flat[state * self.width + np.where(rare, 1, code)].astype(np.int64)
        if rare.any():
            key = (state * self.letters + code)[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found[rare] = np.where(self.keys[at] == key, self.targets[at], -1)
        return found


class Parser:
    """Automata of all languages; a code for every letter that one of them knows."""

    def __init__(self, texts: Mapping[str, str]):
        self.langs = sorted(texts)
        alphabet = sorted({c for t in texts.values() for c in t if c != " "})
        kinds = 2 + len(alphabet)                         # 0 a space, 1 unknown letter, else known
        self.kinds = np.zeros(0x110000, dtype=np.min_scalar_type(kinds))
        self.kinds[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
        self.kinds[[ord(c) for c in alphabet]] = np.arange(2, kinds)
        self.tables = [Automaton(self.codes(texts[lang]), kinds) for lang in self.langs]

    def codes(self, text: str) -> np.ndarray:
        return self.kinds[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]

    def phrases(self, pieces: np.ndarray, lengths: np.ndarray, table: Automaton,
                before: np.ndarray | None = None) -> np.ndarray:
        """Longest-match phrases that begin in each piece; pieces stand sorted, the longest first.

        ``before``: the piece that goes before each in its text, -1 for the first. All pieces are parsed
        at once, as if a phrase began with each. Then the phrase that is open at the end of a piece
        goes on in the next, until a phrase begins where one does in that piece's own parse: from
        there on both are one. So the counts of a text add up to those of its parse as a whole.
        """
        n, width = pieces.shape
        state = np.zeros(n, dtype=np.int64)
        starts = np.zeros((n, width), dtype=bool)
        alive = np.searchsorted(-lengths, -np.arange(width), "left")
        for step in range(width):
            k = alive[step]
            if not k:
                break
            code = table.own[pieces[:k, step]]
            after = table.after(state[:k], code)
            broken = np.flatnonzero(after < 0)
            starts[:k, step] = state[:k] == 0
            starts[broken, step] = True       # the phrase before ended, or a character that never occurs is one
            after[broken] = np.maximum(table.after(0, code[broken]), 0)
            state[:k] = after
        count = starts.sum(axis=1)
        if before is None:
            return count
        own, end, entered = count.copy(), state.copy(), np.zeros(n, dtype=np.int64)
        later = np.flatnonzero(before >= 0)
        while True:
            entry = end[before[later]]
            moved = later[entry != entered[later]]
            if not len(moved):
                return count
            entered[moved] = end[before[moved]]
            count[moved], end[moved] = self._entered(moved, entered[moved], pieces, lengths, table, starts, own, state)

    def _entered(self, which, entry, pieces, lengths, table, starts, own, own_end):
        """Phrases that begin in pieces which are entered in a state, and the states at their ends."""
        count, end = own[which].copy(), own_end[which].copy()
        state, begun = entry.copy(), np.zeros(len(which), dtype=np.int64)
        active = np.flatnonzero(entry > 0)    # else the phrase before ended with its piece
        for step in range(pieces.shape[1]):
            over = active[lengths[which[active]] <= step]
            count[over], end[over] = begun[over], state[over]
            active = active[lengths[which[active]] > step]
            if not len(active):
                break
            code = table.own[pieces[which[active], step]]
            after = table.after(state[active], code)
            broken = after < 0
            met = broken & starts[which[active], step]
            count[active[met]] = begun[active[met]] + starts[which[active[met]], step:].sum(axis=1)
            begun[active[broken & ~met]] += 1
            after[broken] = np.maximum(table.after(0, code[broken]), 0)
            state[active] = after
            active = active[~met]
        count[active], end[active] = begun[active], state[active]
        return count, end

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, codes, owner, previous = len(column), [], [], []
        for row, value in enumerate(column):
            code = self.codes(value.as_py() or "")
            keep = np.ones(len(code), dtype=bool)
            keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
            code = code[keep]
            if not code.any():
                continue
            for at in range(0, len(code), PIECE):
                previous.append(len(codes) - 1 if at else -1)
                codes.append(code[at:at + PIECE])
                owner.append(row)
        if not codes or not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        lengths = np.array([len(c) for c in codes])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        pieces = np.zeros((len(order), int(lengths[0])), dtype=self.kinds.dtype)
        for to, at in enumerate(order):
            pieces[to, : lengths[to]] = codes[at]
        place = np.empty(len(order) + 1, dtype=np.int64)
        place[order], place[-1] = np.arange(len(order)), -1
        before = place[np.asarray(previous)[order]]
        rows = np.asarray(owner)[order]
        sizes = np.bincount(rows, lengths, n)
        found = np.stack([
            np.bincount(rows, self.phrases(pieces, lengths, t, before), n) for t in self.tables])
        rates = found / np.maximum(sizes, 1)              # phrases per character
        best = rates.argmin(axis=0)
        share = 1 / np.maximum(rates, 1e-12)
        score = share.max(axis=0) / share.sum(axis=0)
        names = [self.langs[b] if s else UNKNOWN for b, s in zip(best, sizes)]
        return names, np.where(sizes > 0, score, 0.0)


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(texts))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
          sample_texts: int = SAMPLE_TEXTS) -> dict[str, str]:
    """Normalised training text of each language: whole texts of a bounded number of rows.

    Of each language, among the texts that have a letter and at most SAMPLE_CHARS characters, the
    ``sample_texts`` rows lowest by the hash of their id; if it has none so short, its shortest text.
    With so many languages that all samples could exceed ALL_CHARS, each has fewer rows, one at
    the fewest. Rows with a null text or language, or without a letter, teach nothing.
    """
    rows = (
        docs.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(id_col).alias("key"))
        .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .withColumn("over", F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)))
    )
    # of texts that are too long the shortest alone
    order = Window.partitionBy("lang").orderBy("over", "key", "text")
    found = (
        rows.withColumn("n", F.row_number().over(order))
        .filter((F.col("n") == 1) | (F.col("n") <= sample_texts) & (F.col("over") == 0))
        .orderBy("lang", "n").collect()
    )
    texts: dict[str, list[str]] = {}
    for row in found:
        if normal := _normalised(row["text"]):
            texts.setdefault(row["lang"], []).append(normal)
    each = max(1, ALL_CHARS // (SAMPLE_CHARS * max(1, len(texts))))
    return {name: " ".join(some[:each]) for name, some in texts.items()}


def identify(docs: DataFrame, texts: Mapping[str, str], text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every whole text, read where it lies.

    A text is lower-cased, all but letters become single spaces, and it is parsed greedily
    into the longest phrases that occur in a language's training text: in pieces of PIECE
    characters that are walked in lockstep and joined where one goes over into the next. The language with the fewest phrases per
    character wins (a tie: the first by name). ``score`` is the winner's share of the
    inverse rates. A text that is null or has no letter, and any text if nothing was
    learned, is ``und`` with score 0. Null ids and repeated rows are kept; other columns
    of ``docs`` are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(texts.items())))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = parser.predict(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
