"""Language ID by segmentation-marginalised unigrams.

A fixed public vocabulary of pieces (its file is a parameter) gets one piece
distribution for each language, by expectation maximisation over all
segmentations of the words; a text's likelihood under a language is the
product over its words of the sum over all segmentations, by the forward
algorithm.  Words are lower-cased white-space runs with a boundary mark before
them; a character without a piece is an unknown piece of its own.  Beside the
languages stands a background under which all pieces are equally likely: the
score is the posterior of the best language against the others and the
background, so text of no learnt language scores low.

A long word, such as a sentence of a script without spaces, is cut wherever no
piece of the vocabulary spans, which leaves the sum over all segmentations as
it is; what remains long is taken character by character.

The fit uses a bounded sample: about SAMPLE documents of a language, by a hash
of the id.  Everything else covers every whole text.

Cases.  A null text or one without a letter is `und` with score 0; a null id
is held out by the empty text's crc32; a null lang is not learnt from;
repeated rows are predicted alike; ties go to the first language in order;
without a language to learn every prediction is `und`; an empty table gives an
empty result.  Only the columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from tessera.llm.runtime import held_out, table, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE = 1500
ROUNDS = 3
FOLDS, HELD_OUT = 4, 2
MARK = "▁"
#: Characters whose words are scored together.
BLOCK_CHARS = 2_000_000
#: Words of more characters are cut; units of more than LONG_UNIT are taken one by one.
LONG_WORD, LONG_UNIT = 40, 64
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 18


class Pieces:
    """The vocabulary as hash tables over polynomial hashes of code points."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces, self.n = pieces, len(pieces)  # n: the id of the unknown piece; n + 1 stands for no piece
        self.longest = max(map(len, pieces), default=1)
        self.power = _BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        hashes = np.zeros(self.n, np.uint64)
        sizes = np.fromiter(map(len, pieces), np.int64, self.n)
        for size in sorted(set(sizes.tolist())):
            at = np.flatnonzero(sizes == size)
            codes = np.frombuffer("".join([pieces[i] for i in at]).encode("utf-32-le"), np.uint32).reshape(-1, size)
            for c in codes.T.astype(np.uint64):
                hashes[at] = hashes[at] * _BASE + c
        self.keys = np.zeros((2, 1 << _SLOT_BITS), np.uint64)
        self.ids = np.full((2, 1 << _SLOT_BITS), self.n + 1, np.int32)
        rest, self.mix = np.arange(self.n), [_MIX, _MIX]
        for level in (0, 1):
            tries = [_MIX + np.uint64(2 * i) for i in range(1 if level == 0 else 64)]
            firsts = [np.unique(self.slots(hashes[rest], m), return_index=True)[1] for m in tries]
            best = max(range(len(tries)), key=lambda i: len(firsts[i]))
            self.mix[level], put = tries[best], rest[firsts[best]]
            slots = self.slots(hashes[put], tries[best])
            self.keys[level, slots], self.ids[level, slots] = hashes[put], put
            rest = np.setdiff1d(rest, put)
        self.rest = [(hashes[i], i) for i in rest]  # in neither table, one or two of a vocabulary: looked up by themselves

    def __reduce__(self):
        return _pieces, (tuple(self.pieces),)  # tasks get the pieces and build the tables once a process

    @staticmethod
    def slots(h: np.ndarray, mix: np.uint64) -> np.ndarray:
        return (h * mix) >> np.uint64(64 - _SLOT_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; n + 1 where there is none."""
        one = self.slots(h, self.mix[0])
        out = np.where(self.keys[0][one] == h, self.ids[0][one], self.n + 1)
        miss = np.flatnonzero(out > self.n)
        if len(miss):
            at = self.slots(h[miss], self.mix[1])
            out[miss] = np.where(self.keys[1][at] == h[miss], self.ids[1][at], self.n + 1)
            for key, i in self.rest:
                out[miss[h[miss] == key]] = i
        return out

    def windows(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(size, ids of the piece of that size that begins at each place) of one word's codes."""
        h = np.zeros(len(codes), np.uint64)
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = h[: len(codes) - size + 1] * _BASE + codes[size - 1 :]
            yield size, self.find(h)

    def cut(self, word: str) -> list[str]:
        """The word's parts between the places that no piece spans."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        spans = np.zeros(len(codes) + 1, np.int64)
        for size, ids in self.windows(codes):
            if size > 1:
                at = np.flatnonzero(ids < self.n)
                spans += np.bincount(at + 1, minlength=len(spans)) - np.bincount(at + size, minlength=len(spans))
        where = [0, *np.flatnonzero(np.cumsum(spans)[1:-1] == 0) + 1, len(codes)]
        return [word[a:b] for a, b in zip(where, where[1:])]

    def units(self, word: str) -> list[str]:
        return self.cut(MARK + word) if len(word) > LONG_WORD else [MARK + word]

    def one_by_one(self, codes: np.ndarray, probability: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Forward algorithm over one long unit: probability [n + 2, languages], the last row 0 -> [languages]."""
        m, scale = self.longest, np.zeros(probability.shape[1])
        past = np.zeros((m, probability.shape[1]))  # at places end - m to end - 1
        past[-1] = 1
        for lo in range(0, len(codes), chunk):
            first = max(0, lo - m + 1)
            part = codes[first : lo + chunk]
            ends = np.full((len(part), m), self.n + 1)  # the piece that begins m, ..., 1 before the end
            for size, ids in self.windows(part):
                ends[size - 1 :, m - size] = np.where(ids > self.n, self.n, ids) if size == 1 else ids
            each = probability[ends[lo - first :]]
            for p in each:
                now = (past * p).sum(axis=0)
                past[:-1] = past[1:]
                past[-1] = 1
                past[:-1] /= now
                scale += np.log(now)
        return scale

    def matches(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """codes [words, length] -> (end, size, rows, piece ids), ends ascending."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + codes[:, j]
        for end in range(1, length + 1):
            for size in range(1, min(self.longest, end) + 1):
                ids = self.find(prefix[end] - prefix[end - size] * self.power[size])
                if size == 1:
                    yield end, 1, slice(None), np.where(ids > self.n, self.n, ids)
                elif len(rows := np.flatnonzero(ids < self.n)):
                    yield end, size, rows, ids[rows]

    def log_likelihood(self, codes: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Forward algorithm: codes [words, length], probability [n + 1, languages] -> [words, languages]."""
        n, scale = codes.shape[0], 0.0
        alpha = [np.ones((n, probability.shape[1]))]
        for end, size, rows, ids in self.matches(codes):
            if size == 1:
                if end % 16 == 0:  # against underflow in long words
                    top = np.maximum.reduce(alpha[-self.longest :])
                    alpha, scale = [a / top for a in alpha[-self.longest :]], scale + np.log(top)
                alpha.append(alpha[-1] * probability[ids])
            else:
                alpha[-1][rows] += alpha[-1 - size][rows] * probability[ids]
        return np.log(alpha[-1]) + scale

    def expected(self, codes: np.ndarray, counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Forward-backward: expected piece counts [n + 1] of weighted units."""
        n, length = codes.shape
        found = list(self.matches(codes))
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0], beta[length] = 1, 1
        for end, size, rows, ids in found:
            alpha[end][rows] += alpha[end - size][rows] * probability[ids]
        for end, size, rows, ids in reversed(found):
            beta[end - size][rows] += beta[end][rows] * probability[ids]
        out, weight = np.zeros(self.n + 1), counts / alpha[length]
        for end, size, rows, ids in found:
            out += np.bincount(ids, weight[rows] * alpha[end - size][rows] * probability[ids] * beta[end][rows], self.n + 1)
        return out


@lru_cache(maxsize=4)
def _pieces(pieces: tuple[str, ...]) -> Pieces:
    return Pieces(list(pieces))


def load_pieces(path: str = VOCABULARY) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)])


def by_length(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, codes [units, length]) of units of one length."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for at in np.split(order, cuts):
        if not len(at):
            continue
        size = int(sizes[at[0]])
        step = max(1, 400_000 // size)
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            joined = "".join([units[i] for i in part]).encode("utf-32-le", "surrogatepass")
            yield part, np.frombuffer(joined, np.uint32).reshape(len(part), size).astype(np.uint64)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def fit(docs: DataFrame, pieces: Pieces, sample: int = SAMPLE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-free piece probabilities [pieces + 1, languages]."""
    known = docs.where(~held_out(id_col, FOLDS, HELD_OUT)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((pieces.n + 1, 0))
    rate = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / n[k]))]), F.col("lang"))
    chosen = written(known.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000)) < rate * 1_000_000).select("text", "lang"), "sample")
    probability = np.full((pieces.n + 1, len(langs)), 1 / (pieces.n + 1))
    number = {k: i for i, k in enumerate(langs)}
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], probability=probability) -> Iterator[pa.RecordBatch]:
            total = np.zeros(probability.shape[::-1])
            for b in batches:
                words: dict[int, Counter] = {}
                for text, lang in zip(b.column(0), b.column(1)):
                    c = words.setdefault(number[lang.as_py()], Counter())
                    for w in words_of(text.as_py()):
                        c.update([u[i : i + LONG_UNIT] for u in pieces.units(w) for i in range(0, len(u), LONG_UNIT)])
                for k, c in words.items():
                    keys, counts = list(c), np.fromiter(c.values(), np.float64, len(c))
                    for at, codes in by_length(keys):
                        total[k] += pieces.expected(codes, counts[at], probability[:, k])
            k, i = np.nonzero(total)
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[k, i])], ["k", "i", "n"])

        sums = chosen.repartition(12).mapInArrow(run, "k int, i int, n double").groupBy("k", "i").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((pieces.n + 1, len(langs)))
        counts[sums["i"].to_numpy(), sums["k"].to_numpy()] = sums["n"].to_numpy()
        probability = (counts + 0.1) / (counts + 0.1).sum(axis=0)
    return langs, probability


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, pieces: Pieces, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two last columns: the language and its posterior under equal priors of the languages and the background."""
    at, count = docs.columns.index(text_col), len(langs)
    probability = np.column_stack([probability, np.full(len(probability), 1 / len(probability))])

    def judged(texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        index = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws))}
        units = [pieces.units(w) for w in index]
        of = {u: i for i, u in enumerate(dict.fromkeys(u for us in units for u in us))}
        each = np.zeros((len(of), count + 1))
        padded = np.vstack([probability, np.zeros(count + 1)])
        for rows, codes in by_length(list(of)):
            if codes.shape[1] <= LONG_UNIT:
                each[rows] = pieces.log_likelihood(codes, probability)
            else:
                for i, unit in zip(rows, codes):
                    each[i] = pieces.one_by_one(unit, padded)
        score = np.zeros((len(index), count + 1))
        if units:
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            flat = np.fromiter((of[u] for us in units for u in us), np.int64, int(sizes.sum()))
            score = np.add.reduceat(each[flat], np.cumsum(sizes) - sizes)
        out, sure = [], []
        for text, ws in zip(texts, words):
            if not langs or not text or not any(map(str.isalpha, text)):
                out.append("und")
                sure.append(0.0)
                continue
            total = score[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(total[:count]))
            out.append(langs[best])
            sure.append(float(1 / np.exp(np.minimum(total - total[best], 700)).sum()))
        return out, sure

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs_of, scores, block, held = [], [], [], 0
            for text in b.column(at):
                block.append(text.as_py())
                held += len(block[-1] or "")
                if held >= BLOCK_CHARS:
                    x, y = judged(block)
                    langs_of, scores, block, held = langs_of + x, scores + y, [], 0
            x, y = judged(block)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs_of + x, pa.string()), pa.array(scores + y, pa.float64())], names=[*b.schema.names, *names])

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(run, schema)


def language_scores(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs."""
    pieces = load_pieces(vocabulary)
    langs, probability = fit(docs, pieces, id_col=id_col, text_col=text_col, lang_col=lang_col)
    out = predict(docs.select(id_col, text_col), langs, probability, pieces, text_col)
    return out.select(id_col, held_out(id_col, FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is identified with that posterior at least."""
    pieces = load_pieces(vocabulary)
    langs, probability = fit(docs, pieces, id_col=id_col, text_col=text_col, lang_col=lang_col)
    own = "_".join(docs.columns)
    names = (f"lang_{own}", f"score_{own}")  # no column of docs has these names
    out = predict(docs, langs, probability, pieces, text_col, names)
    return out.where((F.col(f"`{names[0]}`") != "und") & (F.col(f"`{names[1]}`") >= least)).select(docs.columns)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
