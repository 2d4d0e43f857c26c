"""Language identification by unigram pieces, marginalised over all segmentations.

Every language has its own probabilities for the pieces of one fixed public vocabulary.  A
word's probability is the sum over all ways to cut it into pieces (forward algorithm), a
text's is the product over its words: no piece crosses a blank, so that is again the sum over
all segmentations.  Probabilities are fitted by expectation-maximisation, with expected piece
counts from the forward and backward sums of the training words.

``sample_rows`` bounds the documents per language that the fit reads (chosen by a hash of
doc_id, so the choice doesn't depend on the layout); languages and priors come from all
training rows, and every text is scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

FOLDS, HELD_OUT_FOLD = 3, 1
SAMPLE_ROWS = 4_000
ROUNDS = 3
PRIOR_COUNT = 0.01
UNKNOWN = 1e-9
LONGEST_PIECE = 16
TRAINING_CELLS = 400_000
CACHED_WORDS = 700_000
UNDETERMINED = "und"
LETTERS = re.compile(r"[^\W\d_]+")
SPACE = "▁"  # fixed value: how the vocabulary writes the blank before a word


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("piece_bpe_32k.model")


_VOCABULARIES: dict[str, Vocabulary] = {}
BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a vocabulary file, without control and byte pieces and those with a blank inside."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
            if not special and SPACE not in piece[1:] and len(piece) <= LONGEST_PIECE:
                self.pieces[piece] = i
        self.unknown = model.get_piece_size()
        self.width = self.unknown + 1
        keys: list[list[tuple[int, int]]] = [[] for _ in range(LONGEST_PIECE + 1)]
        for piece, i in self.pieces.items():
            key = 0
            for letter in piece:
                key = (key * int(BASE) + ord(letter)) % (1 << 64)
            keys[len(piece)].append((key, i))
        self.keys = [np.array([k for k, _ in sorted(x)], np.uint64) for x in keys]
        self.ids = [np.array([i for _, i in sorted(x)], np.int64) for x in keys]

    def lookup(self, size: int, key: np.ndarray) -> np.ndarray:
        """Ids of the pieces of ``size`` characters with these keys, -1 for none."""
        keys = self.keys[size]
        if not len(keys):
            return np.full(len(key), -1, np.int64)
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        return np.where(keys[at] == key, self.ids[size][at], -1)


def load(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    return LETTERS.findall(text.lower())


@dataclass
class Cuts:
    """Where pieces match in many words: parallel arrays, and the number of ends per word."""

    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    length: np.ndarray

    @classmethod
    def find(cls, words: list[str], vocabulary: Vocabulary) -> Cuts:
        length = np.array([len(w) + 1 for w in words], np.int64)
        joined = "".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, np.uint32).astype(np.uint64)
        first = np.cumsum(length) - length
        word = np.repeat(np.arange(len(words)), length)
        start = np.arange(len(codes)) - first[word]
        room = length[word] - start  # characters from here to the end of the word
        at = np.arange(len(codes))
        key = np.zeros(len(codes), np.uint64)
        found = []
        for size in range(1, LONGEST_PIECE + 1):
            fits = room[at] >= size
            at, key = at[fits], key[fits]
            key = key * BASE + codes[at + size - 1]
            piece = vocabulary.lookup(size, key)
            hit = np.ones(len(at), bool) if size == 1 else piece >= 0
            found.append((at[hit], np.full(hit.sum(), size), np.where(piece < 0, vocabulary.unknown, piece)[hit]))
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        return cls(word[at], start[at], start[at] + size, piece, length)


def _sums(cuts: Cuts, chance: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations before (or after) each position, scaled per position.

    Returns sums of shape (words, positions, columns of ``chance``) and their log scales
    (words, positions): a true sum is sums * exp(scale).
    """
    near, far = (cuts.start, cuts.end) if forward else (cuts.end, cuts.start)
    words, most = len(cuts.length), int(cuts.length.max())
    sums = np.zeros((words, most + 1, chance.shape[1]))
    scale = np.full((words, most + 1), -np.inf)
    first = np.zeros(words, np.int64) if forward else cuts.length
    sums[np.arange(words), first] = 1.0
    scale[np.arange(words), first] = 0.0
    order = np.argsort(far, kind="stable")
    edges = np.searchsorted(far[order], np.arange(most + 2))
    for at in range(1, most + 1) if forward else range(most - 1, -1, -1):
        here = order[edges[at] : edges[at + 1]]
        if not len(here):
            continue
        w, source = cuts.word[here], near[here]
        top = np.full(words, -np.inf)
        np.maximum.at(top, w, scale[w, source])
        part = sums[w, source] * chance[here] * np.exp(scale[w, source] - top[w])[:, None]
        total = np.stack([np.bincount(w, part[:, c], words) for c in range(part.shape[1])], axis=1)
        size = total.max(axis=1)
        live = size > 0
        sums[live, at] = total[live] / size[live, None]
        scale[live, at] = top[live] + np.log(size[live])
    return sums, scale


def log_chances(words: list[str], vocabulary: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """log P(word | language), shape (words, languages); the last row of ``chance`` is the unknown's."""
    out = np.empty((len(words), chance.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):  # words of like length together, about 2 million cells at a time
        size = max(1, 2_000_000 // ((len(words[order[min(at + 4000, len(order)) - 1]]) + 2) * chance.shape[1]))
        rows = order[at : at + min(size, 4000)]
        cuts = Cuts.find([words[i] for i in rows], vocabulary)
        sums, scale = _sums(cuts, chance[cuts.piece], True)
        ends = np.arange(len(rows)), cuts.length
        with np.errstate(divide="ignore"):
            found = np.log(sums[ends]) + scale[ends][:, None]
        # a language that is e^700 times less likely than another underflows; it stays finite
        out[rows] = np.maximum(found, found.max(axis=1, keepdims=True) - 700)
        at += len(rows)
    return out


def expected_counts(words: list[str], langs: np.ndarray, counts: np.ndarray, vocabulary: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language over counted (word, language) rows."""
    out = np.zeros_like(chance)
    order = np.argsort([len(w) for w in words], kind="stable")
    at = 0
    while at < len(order):  # words of like length together, long ones in small lots
        longest = len(words[order[min(at + 4000, len(order)) - 1]])
        rows = order[at : at + max(1, min(4000, TRAINING_CELLS // (longest + 2)))]
        at += len(rows)
        cuts = Cuts.find([words[i] for i in rows], vocabulary)
        lang = langs[rows][cuts.word]
        own = chance[cuts.piece, lang][:, None]
        before, up = _sums(cuts, own, True)
        after, down = _sums(cuts, own, False)
        w = cuts.word
        whole = np.log(before[np.arange(len(rows)), cuts.length, 0]) + up[np.arange(len(rows)), cuts.length]
        share = before[w, cuts.start, 0] * own[:, 0] * after[w, cuts.end, 0]
        share *= np.exp(up[w, cuts.start] + down[w, cuts.end] - whole[w])
        np.add.at(out, (cuts.piece, lang), share * counts[rows][w])
    return out


@dataclass
class Model:
    vocabulary: str
    languages: list[str]
    log_prior: np.ndarray
    chance: np.ndarray


def _word_counts(sample: DataFrame, languages: list[str]) -> DataFrame:
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: Counter = Counter()
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                number = place[lang]
                held.update((number, w) for w in words_of(text or ""))
            columns = [
                pa.array([k[0] for k in held], pa.int32()),
                pa.array([k[1] for k in held], pa.string()),
                pa.array(list(held.values()), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "c"])

    parts = sample.select("text", "lang").mapInArrow(count, "lang int, word string, c long")
    return parts.groupBy("lang", "word").agg(F.sum("c").alias("c"))


def _expectation(counted: DataFrame, sent, vocabulary: str) -> DataFrame:
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chance = load(vocabulary), sent.value
        total = np.zeros_like(chance)
        for batch in batches:
            if batch.num_rows:
                lang, counts = batch.column(0).to_numpy().astype(np.int64), batch.column(2).to_numpy()
                total += expected_counts(batch.column(1).to_pylist(), lang, counts, pieces, chance)
        piece, lang = np.nonzero(total)
        columns = [pa.array(piece), pa.array(lang), pa.array(total[piece, lang])]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "lang", "uses"])

    parts = counted.mapInArrow(expect, "piece long, lang long, uses double")
    return parts.groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))


def learn(training: DataFrame, vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the columns doc_id, text, lang; rows without text or lang are left out."""
    spark = training.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    training = training.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in training.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    width = load(vocabulary).width
    chance = np.full((width, len(languages)), 1.0 / width)
    chance[-1] = UNKNOWN
    rows = sum(sizes.values())
    model = Model(vocabulary, languages, np.log([sizes[x] / rows for x in languages]), chance)
    if not languages:
        return model
    share = spark.createDataFrame([(x, min(1.0, sample_rows / sizes[x])) for x in languages], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    sample = training.join(F.broadcast(share), "lang").where(draw)  # one row per language
    counted = stored(_word_counts(sample, languages), "language-words")
    for _ in range(ROUNDS):
        found = _expectation(counted, spark.sparkContext.broadcast(model.chance), vocabulary).toPandas()
        uses = np.full_like(chance, PRIOR_COUNT)
        uses[found["piece"], found["lang"]] += found["uses"]
        uses[-1] = 0
        chance = uses / uses.sum(axis=0)
        chance[-1] = UNKNOWN
        model.chance = chance
    return model


class _Scorer:
    """log P(word) of the words met lately, one row each."""

    def __init__(self, model: Model):
        self.model, self.vocabulary = model, load(model.vocabulary)
        self.place: dict[str, int] = {}
        self.rows = np.empty((CACHED_WORDS, len(model.languages)))

    def prepare(self, texts: list[list[str]]) -> None:
        new = list(set().union(*texts).difference(self.place))
        if len(self.place) + len(new) > len(self.rows):
            self.place = {}
            new = list(set().union(*texts))
            if len(new) > len(self.rows):
                self.rows = np.empty((len(new), self.rows.shape[1]))
        if new:
            held = len(self.place)
            self.place.update((w, i) for i, w in enumerate(new, held))
            self.rows[held : held + len(new)] = log_chances(new, self.vocabulary, self.model.chance)

    def posterior(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(axis=0) + self.model.log_prior
        total = np.exp(total - total.max())
        return total / total.sum()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from ``text`` alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, names = _Scorer(sent.value), sent.value.languages
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores = [], []
            for at in range(0, len(texts), 200):
                spoken = [words_of(t) if names else [] for t in texts[at : at + 200]]
                scorer.prepare(spoken)
                for words in spoken:
                    chances = scorer.posterior(words) if words else None
                    langs.append(UNDETERMINED if chances is None else names[int(chances.argmax())])
                    scores.append(0.0 if chances is None else float(chances.max()))
            columns = [*batch.columns[:2], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        tag, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def identify(docs: DataFrame, vocabulary: str | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Learn from the rows that are not held out and predict every row.

    A null text and one without a letter are ``und`` with score 0, and so is everything if no
    row has both text and lang.  Equal posteriors go to the language that sorts first.  A null
    doc_id hashes as the empty text; repeated rows are kept; other columns are ignored.
    """
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"),
        (crc_mod(key, FOLDS) == HELD_OUT_FOLD).alias("held_out"),
    )
    return predict(rows, learn(rows.where("NOT held_out"), vocabulary, sample_rows))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
