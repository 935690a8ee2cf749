"""Language ID with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a word is the
sum, over all ways to cut it into pieces, of the product of the pieces' probabilities: a forward algorithm.  A text
gets, for each language, the sum of the log-probabilities of its words; the score is the posterior of the best
language under equal priors.  Probabilities are learnt by expectation-maximisation over the word counts of a
sample of labelled rows, bounded by ``train_rows`` for each language.

Words are runs of letters, lower-cased, with the vocabulary's word mark in front.  All pieces of letters count, whatever
their length, and words of any length are summed over whole: long ones one by one, in logarithms, as their products would
leave the range of floating point.

Defined cases: ``und`` with score 0 where the text is null or has no letter, and for every row if nothing can be
learnt (no labelled row); rows with a null label or id are not learnt from; repeated rows count as often as they
occur; equal posteriors go to the label that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MARK = "▁"
#: Letters of the longest word whose probability is multiplied out (FLOOR to this power is a double still); positions of a
#: longer one that are looked up at a time.
SHORT, STRETCH = 40, 4096
FLOOR = 1e-7
_B = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[str, ...]:
    """Pieces of letters, with or without the word mark, lower-cased."""
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {m.id_to_piece(i).lower() for i in range(m.get_piece_size())}
    else:
        from tokenizers import Tokenizer

        found = {p.lower().replace("</w>", "") for p in Tokenizer.from_file(path).get_vocab()}
    return tuple(sorted(p for p in found if p and (p == MARK or p.removeprefix(MARK).isalpha())))


def _hash(codes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64) if before is None else before
    return h * _B + codes.astype(np.uint64) + np.uint64(1)


class Pieces:
    """Look-up of pieces by the hash of their characters."""

    def __init__(self, path: str):
        self.names = pieces_of(path)
        with np.errstate(over="ignore"):
            keys = []
            for p in self.names:
                h = np.zeros(1, np.uint64)
                for ch in p:
                    h = _hash(np.array([ord(ch)]), h)
                keys.append(common.mix(h)[0])
        keys = np.array(keys, np.uint64)
        self.longest = max(map(len, self.names), default=1)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def __len__(self) -> int:
        return len(self.names)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece, or len(self) where there is none."""
        h = common.mix(h)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.order[at], len(self.names))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the words of one length, and their characters, mark in front, as a matrix."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for k in np.unique(sizes):
        at = np.flatnonzero(sizes == k)
        codes = np.frombuffer("".join(MARK + words[i] for i in at).encode("utf-32-le"), np.uint32)
        yield at, codes.reshape(len(at), k + 1)


def _steps(codes: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, length, piece numbers) of every stretch of the words."""
    m = codes.shape[1]
    for s in range(m):
        h = None
        for n in range(1, min(pieces.longest, m - s) + 1):
            h = _hash(codes[:, s + n - 1], h)
            yield s, n, pieces.find(h)


def _stretches(codes: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, np.ndarray]]:
    """(a, numbers) of a word: the pieces that begin at a, a + 1, ... (rows), by their length (columns)."""
    m, none = len(codes), len(pieces)
    for a in range(0, m, STRETCH):
        size = min(STRETCH, m - a)
        some = np.concatenate([codes[a : a + size + pieces.longest - 1], np.zeros(pieces.longest, codes.dtype)])
        h, out = None, np.full((size, pieces.longest), none)
        for n in range(1, pieces.longest + 1):
            h = _hash(some[n - 1 : n - 1 + size], h)
            fits = np.arange(a, a + size) + n <= m
            out[fits, n - 1] = pieces.find(h)[fits]
        yield a, out


def _log_weights(found: np.ndarray, table: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Log-probabilities (starts x lengths x languages) of pieces; letters have a floor."""
    return np.concatenate([single[found[:, :1]], table[found[:, 1:]]], axis=1)


def _logs(probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(divide="ignore"):
        return np.log(np.vstack([probs, np.zeros((1, probs.shape[1]))])), np.log(np.vstack([np.maximum(probs, FLOOR), np.full((1, probs.shape[1]), FLOOR)]))


def long_forward(codes: np.ndarray, pieces: Pieces, table: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Log of the summed probability of each beginning of a word (rows) in each language."""
    top, k = pieces.longest, table.shape[1]
    out = np.full((len(codes) + 1 + top, k), -np.inf)
    out[0] = 0
    for a, found in _stretches(codes, pieces):
        for s, w in enumerate(_log_weights(found, table, single), a):
            out[s + 1 : s + 1 + top] = np.logaddexp(out[s + 1 : s + 1 + top], out[s] + w)
    return out[: len(codes) + 1]


def long_backward(codes: np.ndarray, pieces: Pieces, table: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Log of the summed probability of each end of a word."""
    top, k = pieces.longest, table.shape[1]
    out = np.full((len(codes) + 1 + top, k), -np.inf)
    out[len(codes)] = 0
    for a, found in reversed(list(_stretches(codes, pieces))):
        for s, w in reversed(list(enumerate(_log_weights(found, table, single), a))):
            out[s] = np.logaddexp.reduce(out[s + 1 : s + 1 + top] + w, axis=0)
    return out[: len(codes) + 1]


@dataclass
class Model:
    vocabulary: str
    langs: tuple[str, ...]
    probs: np.ndarray  # pieces x languages

    def score(self, words: list[str], pieces: Pieces) -> np.ndarray:
        """Log-probability of each word in each language."""
        k = len(self.langs)
        table = np.vstack([self.probs, np.zeros((1, k))])
        single = np.vstack([np.maximum(self.probs, FLOOR), np.full((1, k), FLOOR)])
        out = np.zeros((len(words), k))
        with np.errstate(over="ignore"):
            for at, codes in by_length(words):
                if codes.shape[1] > SHORT:
                    for i, one in zip(at, codes, strict=True):
                        out[i] = long_forward(one, pieces, *_logs(self.probs))[-1]
                    continue
                forward = np.zeros((codes.shape[1] + 1, len(at), k))
                forward[0] = 1
                for s, n, found in _steps(codes, pieces):
                    forward[s + n] += forward[s] * (single if n == 1 else table)[found]
                out[at] = np.log(forward[-1])
        return out


def expected(words: list[str], langs: np.ndarray, counts: np.ndarray, probs: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece in each language: forward and backward over all segmentations."""
    k = probs.shape[1]
    table, single = np.vstack([probs, np.zeros((1, k))]), np.vstack([np.maximum(probs, FLOOR), np.full((1, k), FLOOR)])
    out = np.zeros((len(pieces) + 1) * k)
    with np.errstate(over="ignore"):
        for at, codes in by_length(words):
            m, lang = codes.shape[1], langs[at]
            if m > SHORT:
                for one, j, n in zip(codes, lang, counts[at], strict=True):
                    logs = [x[:, j : j + 1] for x in _logs(probs)]
                    ahead, behind = long_forward(one, pieces, *logs)[:, 0], long_backward(one, pieces, *logs)[:, 0]
                    behind = np.concatenate([behind, np.full(pieces.longest, -np.inf)])
                    for a, found in _stretches(one, pieces):
                        ends = np.arange(a, a + len(found))[:, None] + np.arange(1, pieces.longest + 1)
                        share = np.exp(ahead[a : a + len(found), None] + _log_weights(found, *logs)[:, :, 0] + behind[ends] - ahead[-1])
                        out += np.bincount(found.ravel() * k + j, weights=n * share.ravel(), minlength=len(out))
                continue
            steps = [(s, n, f, (single if n == 1 else table)[f, lang]) for s, n, f in _steps(codes, pieces)]
            forward, backward = np.zeros((m + 1, len(at))), np.zeros((m + 1, len(at)))
            forward[0], backward[m] = 1, 1
            for s, n, _, p in steps:
                forward[s + n] += forward[s] * p
            for s, n, _, p in reversed(steps):
                backward[s] += p * backward[s + n]
            weight = counts[at] / forward[m]
            for s, n, f, p in steps:
                out += np.bincount(f * k + lang, weights=forward[s] * p * backward[s + n] * weight, minlength=len(out))
    return out.reshape(-1, k)[:-1]


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a batch, the word number of each occurrence, and where each text begins among them."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.split_pattern_regex(low, r"\P{L}+")
    off = lists.offsets.to_numpy()
    coded = lists.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), off - off[0]


def learn(docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", id_col: str = "doc_id", train_rows: int = 1500, rounds: int = 2, most_labels: int = 1000) -> Model:
    """``train_rows``: about as many rows of each language, chosen by a hash of the id, are learnt from (all where
    there are fewer).  What comes to the driver is the table of languages and of piece probabilities, whose size
    is that of the vocabulary times the number of languages; more than ``most_labels`` of them raise."""
    spark = common.session_of(docs)
    common.tidy(spark)
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and i is not null and t is not null")
    sizes = {r.l: r.n for r in labelled.groupBy("l").agg(F.count("*").alias("n")).limit(most_labels + 1).collect()}
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    langs = tuple(sorted(sizes))
    pieces = Pieces(vocabulary)
    if not langs:
        return Model(vocabulary, (), np.zeros((len(pieces), 0)))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, train_rows / n)))])
    sample = labelled.where(F.pmod(F.xxhash64("i", F.lit(11)), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20))
    order = {k: i for i, k in enumerate(langs)}

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, at, off = words_of(batch.column(0))
            rows = np.repeat(np.array([order[x] for x in batch.column(1).to_pylist()], np.int64), np.diff(off))
            n = np.bincount(rows * len(names) + at, minlength=len(langs) * len(names)).reshape(len(langs), len(names))
            n[:, [i for i, w in enumerate(names) if not w]] = 0  # between two runs of what is no letter
            k, j = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in j], pa.string()), pa.array(k, pa.int32()), pa.array(n[k, j], pa.int64())], names=["w", "k", "n"])

    counted = common.written(sample.select("t", "l").mapInArrow(common.released(words), "w string, k int, n long").groupBy("w", "k").agg(F.sum("n").alias("n")), "words")
    probs = np.full((len(pieces), len(langs)), 1.0 / len(pieces))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = Pieces(vocabulary), np.zeros(probs.shape)
        for batch in batches:
            total += expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(float), probs, table)
        i, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(total[i, k])], names=["p", "k", "x"])

    for _ in range(rounds):
        sums = counted.mapInArrow(common.released(expect), "p int, k int, x double").groupBy("p", "k").agg(F.sum("x").alias("x")).toArrow()
        total = np.full(probs.shape, 0.01)
        total[sums["p"].to_numpy(), sums["k"].to_numpy()] += sums["x"].to_numpy()
        probs = total / total.sum(0)
    return Model(vocabulary, langs, probs)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score"), kept_words: int = 150_000) -> DataFrame:
    """``keep`` columns and, called ``names``, the language and score of each whole text; nothing is shuffled."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.langs)
        pieces, known, table, used = Pieces(model.vocabulary), {}, np.zeros((1 << 14, k)), 0
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                at = batch.schema.get_field_index("__text")
                found, word, off = words_of(batch.column(at))
                new = [w for w in found if w not in known]
                if used + len(new) > kept_words:
                    known, used, new = {}, 0, found
                if used + len(new) > len(table):
                    table = np.vstack([table[:used], np.zeros((max(len(new), len(table)), k))])
                table[used : used + len(new)] = 0
                some = [i for i, w in enumerate(new) if w]
                if some and k:
                    table[used + np.array(some)] = model.score([new[i] for i in some], pieces)
                known.update(zip(new, range(used, used + len(new)), strict=True))
                used += len(new)
                place = np.array([known[w] for w in found], np.int64)
                letters = np.array([bool(w) for w in found])
                sums = np.zeros((len(word) + 1, k + 1))
                np.cumsum(np.column_stack([table[place][word], letters[word]]) if len(word) else np.zeros((0, k + 1)), axis=0, out=sums[1:])
                got = sums[off[1:]] - sums[off[:-1]]
                some, ll = got[:, k] > 0, got[:, :k]
                if k:
                    best = ll.argmax(1)
                    post = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                    lang = [model.langs[b] if ok else "und" for b, ok in zip(best, some, strict=True)]
                    score = np.where(some, post, 0.0)
                else:
                    lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns) if i != at), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text")).mapInArrow(common.released(run), schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    """True for one fifth of the ids, which are not learnt from; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out()), vocabulary, **options)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, vocabulary: str, least: float = 0.5, **options) -> DataFrame:
    """The documents whose language is recognised: not ``und``, posterior of at least ``least``.  Where nothing can be learnt
    (no labelled row), no language is rejected: only null texts and those without a letter go."""
    model = learn(docs.where(~held_out()), vocabulary, **options)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    made = predict(docs, model, keep=tuple(docs.columns), names=("__lang", "__score"))
    return made.where((F.col("__lang") != "und") & (F.col("__score") >= least)).select(*docs.columns)
