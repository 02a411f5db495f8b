"""Language-model scoring by a hashed maximum-entropy model.

The model factors a token's probability into that of its class, that of its
cell within the class and that of the token within the cell.  Class and cell
are softmaxes over sums of weight rows that the context's features name by
their hashes: the last cell, the last two, and the second last alone (a skip).
Biases are the corpus's unigrams.  A frequent token has a cell of its own; the
rest are hashed to TAIL cells, in which a token has its add-one share of the
cell's counts, so that every token of any text has a probability and a rare
word is context by its cell.

Training is one pass of distributed gradient updates over every training text:
in each round every task takes gradient steps on its share from the round's
common weights, and the rows' changes are averaged by how often each task used
the row.  A block's equal events (context and cell) are one row with a count,
in training and in scoring.

Counts are exact and cover all training tokens: HEAD of them at most, the most
frequent, go to every task, the counts of the rest are joined.

Cases.  A null or empty text is the one token that ends a text; a null id is
held out by the empty text's crc32; repeated rows are counted and scored one by
one; without a training text every count is 0; an empty table gives an empty
result.  Only the columns named are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.runtime import held_out, lower_words, table, written

#: Ends a text; no word holds a space.
END = b" "
CLASSES, SLOTS = 64, 64
CELLS, TAIL = CLASSES * SLOTS, 64
#: Cells of the tail that are told apart as context.
TAIL_CONTEXTS = 16
CLASS_ROWS_BITS, WORD_ROWS_BITS = 14, 15
HEAD = 1 << 18
FOLDS, HELD_OUT = 7, 2
ROUNDS = 2
STEP_EVENTS = 2048
BLOCK_TOKENS = 1 << 18
RATE = 0.7
#: Tokens that a learner should have at least, and the sums into which the learners' changes go first.
LEARNER_TOKENS, SALTS = 1 << 21, 8
#: Rows of a weight table that travel as one block.
BLOCK_ROWS = 512
#: Distinct tokens that a task counts before it passes them on.
COUNTER_TOKENS = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Events:
    """The distinct events of a block: contexts, groups of a context and a class, and events in them, each in order."""

    def __init__(self, cells: np.ndarray, starts: np.ndarray) -> None:
        n, begin = len(cells), CELLS
        at = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        symbols = np.where(cells < CELLS - TAIL, cells, CELLS - TAIL + cells % TAIL_CONTEXTS)
        last = []
        for back in (1, 2):
            x = np.full(n, begin, np.int64)
            x[back:] = symbols[:-back] if back < n else x[back:]
            x[at < back] = begin
            last.append(x)
        one, two = last
        found, self.inverse, self.counts = np.unique((two * (CELLS + 1) + one) * CELLS + cells, return_inverse=True, return_counts=True)
        self.cls, self.slot = found % CELLS // SLOTS, found % SLOTS
        group = found // SLOTS  # a number for each context and class
        self.group_of, firsts = self._runs(group)
        self.group_class, context = self.cls[firsts], (group // CLASSES)[firsts]
        self.context_of, firsts = self._runs(context)
        self.keys = self.features(context[firsts] % (CELLS + 1), context[firsts] // (CELLS + 1))

    @staticmethod
    def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the run of equal values that each belongs to, and where runs begin."""
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        return np.cumsum(new) - 1, np.flatnonzero(new)

    @staticmethod
    def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Feature keys [3, contexts] of the last cell and the one before it."""
        one, two = one.astype(np.uint64), two.astype(np.uint64)
        return np.stack([one, (np.uint64(1) << np.uint64(40)) | (two << np.uint64(16)) | one, (np.uint64(2) << np.uint64(40)) | two])

    def levels(self, model: MaxEnt) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each of the two softmaxes: level, biases and rows of its distinct inputs, then input, output and count of its events."""
        yield 0, np.broadcast_to(model.class_bias, (self.keys.shape[1], CLASSES)), MaxEnt.rows(self.keys, CLASS_ROWS_BITS), self.context_of[self.group_of], self.cls, self.counts
        rows = MaxEnt.rows(self.keys[:, self.context_of], WORD_ROWS_BITS, self.group_class.astype(np.uint64))
        yield 1, model.word_bias[self.group_class], rows, self.group_of, self.slot, self.counts


class MaxEnt:
    def __init__(self, cell_counts: np.ndarray, real: np.ndarray) -> None:
        """cell_counts [CELLS]: training tokens of each cell; real: the cells that a token can have."""
        shares = np.where(real, cell_counts + 1.0, 0.0).reshape(CLASSES, SLOTS)
        with np.errstate(divide="ignore"):
            self.class_bias = np.maximum(np.log(shares.sum(1) / shares.sum()), -60).astype(np.float32)
            self.word_bias = np.maximum(np.log(shares / np.maximum(shares.sum(1, keepdims=True), 1)), -60).astype(np.float32)
        self.class_rows = np.zeros((1 << CLASS_ROWS_BITS, CLASSES), np.float32)
        self.word_rows = np.zeros((1 << WORD_ROWS_BITS, SLOTS), np.float32)

    @staticmethod
    def rows(keys: np.ndarray, bits: int, cls: np.ndarray | None = None) -> np.ndarray:
        if cls is not None:
            keys = keys | ((cls + np.uint64(1)) << np.uint64(48))
        mixed = keys * _ODD
        return (((mixed ^ (mixed >> np.uint64(32))) * _ODD) >> np.uint64(64 - bits)).astype(np.uint16)

    @staticmethod
    def log_softmax(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        z = weights[rows[0]]
        for r in rows[1:]:
            z += weights[r]
        z += bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def log_probability(self, events: Events) -> np.ndarray:
        """Natural log probability of each token's cell."""
        out = np.zeros(len(events.counts))
        for level, bias, rows, inputs, outputs, _ in events.levels(self):
            weights = (self.class_rows, self.word_rows)[level]
            for lo in range(0, rows.shape[1], STEP_EVENTS):
                z = self.log_softmax(bias[lo : lo + STEP_EVENTS], weights, rows[:, lo : lo + STEP_EVENTS])
                mine = slice(*np.searchsorted(inputs, [lo, lo + STEP_EVENTS]))
                out[mine] += z[inputs[mine] - lo, outputs[mine]]
        return out[events.inverse]


class Trainer:
    """Gradient steps on a copy of the model, each row with a rate of its own that falls with its past gradients."""

    def __init__(self, model: MaxEnt) -> None:
        self.model, self.start = model, (model.class_rows.copy(), model.word_rows.copy())
        self.past = [np.full(len(w), 1.0, np.float32) for w in self.start]
        self.used = [np.zeros(len(w), np.int64) for w in self.start]

    def _step(self, level: int, weights: np.ndarray, gradient: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> None:
        """One step along gradients [inputs, outputs] that stand for so many tokens each."""
        for r in rows:
            order = np.argsort(r, kind="stable")
            ordered = r[order]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            u = ordered[first]
            sums = np.add.reduceat(gradient[order], first, axis=0) if len(first) < len(r) else gradient[order]
            past = self.past[level][u] + np.einsum("ij,ij->i", sums, sums)
            self.past[level][u] = past
            weights[u] += sums * (RATE / np.sqrt(past))[:, None]
            self.used[level][u] += np.add.reduceat(tokens[order], first)

    def learn(self, events: Events) -> None:
        m = self.model
        for level, bias, rows, inputs, outputs, counts in events.levels(m):
            weights = (m.class_rows, m.word_rows)[level]
            for lo in range(0, rows.shape[1], STEP_EVENTS):
                mine = slice(*np.searchsorted(inputs, [lo, lo + STEP_EVENTS]))
                at, n, some = inputs[mine] - lo, counts[mine], rows[:, lo : lo + STEP_EVENTS]
                tokens = np.bincount(at, n, some.shape[1])
                gradient = np.exp(MaxEnt.log_softmax(bias[lo : lo + STEP_EVENTS], weights, some))
                gradient *= -tokens[:, None].astype(np.float32)
                np.add.at(gradient, (at, outputs[mine]), n.astype(np.float32))
                self._step(level, weights, gradient, some, tokens.astype(np.int64))

    def changes(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(level, block, uses of each row, change of each row) of every block in use."""
        for level, weights in enumerate((self.model.class_rows, self.model.word_rows)):
            for b in range(0, len(weights), BLOCK_ROWS):
                at = slice(b, b + BLOCK_ROWS)
                if (n := self.used[level][at]).any():
                    yield level, b // BLOCK_ROWS, n, weights[at] - self.start[level][at]


def tail_cell(token: bytes) -> int:
    """Cell of a token without one of its own; cells from CELLS - TAIL on."""
    return CELLS - TAIL + zlib.crc32(token) % TAIL


class CellOf(dict):
    """Cells of tokens: those of the frequent ones, and by hash those of all others."""

    def __missing__(self, token: bytes) -> int:
        return tail_cell(token)


def blocks_of(batches: Iterator[pa.RecordBatch], cell_of: CellOf) -> Iterator[Events]:
    """Events of whole texts, BLOCK_TOKENS or more at a time."""
    cells, starts, n = [], [], 0
    for b in batches:
        for text in b.column(0):
            words = lower_words(text.as_py())
            words.append(END)
            starts.append(n)
            cells += map(cell_of.__getitem__, words)
            n = len(cells)
            if n >= BLOCK_TOKENS:
                yield Events(np.array(cells, np.int64), np.array(starts))
                cells, starts, n = [], [], 0
    if cells:
        yield Events(np.array(cells, np.int64), np.array(starts))


def count_tokens(texts: DataFrame) -> DataFrame:
    """texts(text) -> (token, c), every token of every text counted, its end as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "c"])

        held: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                held.update(lower_words(text.as_py()))
                held[END] += 1
                if len(held) > COUNTER_TOKENS:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return written(texts.mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")), "counts")


def head_counts(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """The most frequent tokens, at most so many, all with more than some count; most frequent first."""
    level = F.floor(F.log2("c") * 16)
    levels = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for x, n in levels:  # under a thousand levels whatever the corpus
        if (total := total + n) > most:
            break
        least = x
    if least is None:
        return []
    got = counts.where(level >= least).toArrow()
    return sorted(((t.encode(), c) for t, c in zip(got["token"].to_pylist(), got["c"].to_pylist())), key=lambda x: (-x[1], x[0]))


def train(texts: DataFrame, model: MaxEnt, cell_of: CellOf, n_tokens: int, rounds: int = ROUNDS) -> MaxEnt:
    """texts(text, part) of n_tokens: one pass, a round over each of the parts 0 to rounds - 1."""
    rows = BLOCK_ROWS

    def summing(weighted: bool):
        """Sums of uses and of uses times change; weighted: the changes that come in are not yet times their uses."""

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int, int], list[np.ndarray]] = {}  # blocks of one model at most, times the salts dealt here
            for b in batches:
                for level, block, salt, n, x in zip(*(c.to_pylist() for c in b.columns)):
                    uses = np.frombuffer(n, np.int64)
                    change = np.frombuffer(x, np.float32)
                    if weighted:
                        change = (change.reshape(len(uses), -1) * uses[:, None].astype(np.float32)).ravel()
                    if (t := total.get((level, block, salt))) is None:
                        total[level, block, salt] = [uses.copy(), change.copy()]
                    else:
                        t[0] += uses
                        t[1] += change
            keys = list(total)
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([t[i].tobytes() for t in total.values()], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays(columns, ["level", "block", "salt", "uses", "change"])

        return summed

    schema = "level int, block int, salt int, uses binary, change binary"
    for part in range(rounds):

        def learn(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(model)
            for events in blocks_of(batches, cell_of):
                trainer.learn(events)
            salt = TaskContext.get().partitionId() % SALTS
            out = [(level, block, salt, n.tobytes(), x.tobytes()) for level, block, n, x in trainer.changes()]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            for lo in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out[lo : lo + 16]], t) for i, t in enumerate(types)], ["level", "block", "salt", "uses", "change"])

        # A learner should have LEARNER_TOKENS, for its weights travel whole.  Two
        # levels of sums: a block meets one sum for each salt in the last.
        mine = texts.where(F.col("part") == part).select("text").coalesce(max(1, -(-n_tokens // (rounds * LEARNER_TOKENS))))
        changes = mine.mapInArrow(learn, schema).repartition("level", "block", "salt").mapInArrow(summing(True), schema).withColumn("salt", F.lit(0))
        for r in changes.repartition("level", "block").mapInArrow(summing(False), schema).toLocalIterator():
            weights = (model.class_rows, model.word_rows)[r["level"]]
            uses = np.frombuffer(bytes(r["uses"]), np.int64)
            change = np.frombuffer(bytes(r["change"]), np.float32).reshape(rows, -1)
            weights[r["block"] * rows : (r["block"] + 1) * rows] += change / np.maximum(uses, 1)[:, None]
    return model


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs."""
    out = held_out(id_col, FOLDS, HELD_OUT)
    part = F.pmod(F.xxhash64(id_col, F.lit(23)), F.lit(ROUNDS)).cast("int")
    texts = docs.where(~out).select(F.col(text_col).alias("text"), part.alias("part"))
    counts = count_tokens(texts.select("text"))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = head_counts(counts)
    own = head[: CELLS - TAIL]
    cell_of = CellOf((t, i) for i, (t, _) in enumerate(own))
    head_index = {t: i for i, (t, _) in enumerate(head)}
    # of each tail cell all tokens and distinct ones, less those with a cell of their own
    sums = {r[0]: (r[1], r[2]) for r in counts.groupBy((F.crc32(F.col("token").cast("binary")) % TAIL).alias("cell")).agg(F.sum("c"), F.count(F.lit(1))).collect()}
    tail = np.array([sums.get(i, (0, 0)) for i in range(TAIL)], np.float64).T
    for t, c in own:
        tail[:, tail_cell(t) - (CELLS - TAIL)] -= c, 1
    cell_counts = np.zeros(CELLS)
    cell_counts[: len(own)], cell_counts[CELLS - TAIL :] = [c for _, c in own], tail[0]
    real = (np.arange(CELLS) < len(own)) | (np.arange(CELLS) >= CELLS - TAIL)
    model = train(texts, MaxEnt(cell_counts, real), cell_of, n)
    head_log = np.append(np.log10(np.array([c for _, c in head]) + 1.0) if head else [], [0.0])  # the last: not in the head
    base_each, within_cell = float(np.log10(n + v + 1)), np.log10(tail.sum(axis=0) + 1)
    n_own = len(own)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 34
        names = ["row", "id", "n_tokens", "n_known", "base", "score", "rest"]

        def scored(ids: list, words: list[list[bytes]], number: int) -> pa.RecordBatch:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(sizes) - sizes
            flat = list(chain.from_iterable(words))
            at = np.fromiter(map(head_index.get, flat, repeat(-1)), np.int64, len(flat))
            logs = head_log[at]
            cells, rare = at.copy(), np.flatnonzero((at < 0) | (at >= n_own))
            cells[rare] = [tail_cell(flat[i]) for i in rare.tolist()]
            lm = model.log_probability(Events(cells, starts)) / np.log(10)
            lm[rare] += logs[rare] - within_cell[cells[rare] - (CELLS - TAIL)]
            missing = np.flatnonzero(at < 0)
            of = np.searchsorted(missing, np.append(starts, len(flat)))
            rest = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array([flat[i] for i in missing.tolist()], pa.binary()).cast(pa.string()))
            known = np.add.reduceat((at >= 0).astype(np.int64), starts)
            columns = [pa.array(np.arange(number, number + len(words))), pa.array(ids, id_type), pa.array(sizes), pa.array(known), pa.array(np.add.reduceat(logs, starts) - sizes * base_each), pa.array(np.add.reduceat(lm, starts)), rest]
            return pa.RecordBatch.from_arrays(columns, names)

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            ids, words, held = [], [], 0
            for id_, text in zip(b.column(0), b.column(1)):
                ws = lower_words(text.as_py())
                ws.append(END)
                ids.append(id_.as_py())
                words.append(ws)
                held += len(ws)
                if held >= BLOCK_TOKENS:
                    yield scored(ids, words, number)
                    number += len(ids)
                    ids, words, held = [], [], 0
            if ids:
                yield scored(ids, words, number)
                number += len(ids)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, n_tokens long, n_known long, base double, score double, rest array<string>")
    rows = written(rows, "scored")
    # counted before the join, so that a token unseen in training, however frequent, is one row a document
    tail = rows.select("row", F.explode("rest").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times")).join(counts, "token")
    tail = tail.groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    joined = rows.drop("rest").join(tail, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), held_out("id", FOLDS, HELD_OUT).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op5_hashed_maxent(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
