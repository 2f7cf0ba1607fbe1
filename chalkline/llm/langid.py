"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get one probability per language,
fitted by expectation maximisation over the words of labelled texts. A word's
probability in a language is the sum over all its segmentations into pieces,
from the forward algorithm; a text's is the product over its words (runs of
letters, lower-cased, with the vocabulary's word mark in front). Words and
segmentations never interact, so each distinct word is scored once and whole
texts are sums of word scores.

Training reads a bounded sample: about ``train_docs`` labelled documents of
each language, chosen by a hash of doc_id. Counting, prediction and the fold
statistics cover all rows.

Defined results: ``und`` with score 0 where the text is null or has no letter,
and for every row where nothing was learned. Equal posteriors go to the
alphabetically first language. A letter outside the vocabulary costs the same
in every language. A null doc_id is never trained on and not held out. Repeated
rows are predicted alike; an empty table gives no rows; extra columns are
ignored (or kept, by :func:`keep_known`). Texts and single words of any length
are scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import fresh, materialize, tokenizer_file

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS = 500
ROUNDS = 3
#: Pseudo-count of every piece in every language.
SMOOTHING = 0.05
#: Probability of a letter that is no piece.
UNKNOWN = 1e-8
#: Longer words are scored one at a time with rescaling instead of in arrays.
ARRAY_WORD = 30
REMEMBERED_WORDS = 100_000
#: Characters whose words are looked up together.
CHUNK_CHARS = 2_000_000
UNDETERMINED = "und"
WORD_MARK = "▁"

_WORDS = re.compile(r"[^\W\d_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    if not text:
        return []
    found = _WORDS.findall(text.lower())
    if not all(map(str.isalpha, found)):                    # letter-like numbers such as roman numeral signs
        found = [w for x in found for w in re.split(r"[\W\d_]+", "".join(c if c.isalpha() else " " for c in x)) if w]
    return found


class Vocabulary:
    """The pieces that can occur in lower-cased words, found by substring hashes."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
                  if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
        usable = (p for p in pieces if all(c.isalpha() or (c == WORD_MARK and i == 0) for i, c in enumerate(p)))
        self.pieces = sorted({p for p in usable if p == p.lower()})
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.longest = max(map(len, self.pieces))
        hashes = np.array([self._hash(p) for p in self.pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.order = hashes[order], order
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(hashes * _MULTIPLIER) >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_MULTIPLIER) + ord(c)) % (1 << 64)
        return h

    def lattice(self, words: list[str]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For words of equal length: at each end position the pieces that end there, as (length, word rows, piece ids)."""
        n = len(words[0]) + 1
        chars = np.array([WORD_MARK + w for w in words], dtype=f"<U{n}").view("<u4").reshape(len(words), n).astype(np.uint64)
        prefix = np.zeros((n + 1, len(words)), dtype=np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _MULTIPLIER + chars[:, j]
        found: list[list] = [[]]
        powers = [np.uint64(pow(int(_MULTIPLIER), k, 1 << 64)) for k in range(self.longest + 1)]
        for j in range(1, n + 1):
            ends = []
            for k in range(1, min(j, self.longest) + 1):
                h = prefix[j] - prefix[j - k] * powers[k]
                rows = np.nonzero(self.seen[(h * _MULTIPLIER) >> np.uint64(44)])[0]
                if len(rows):
                    at = np.minimum(np.searchsorted(self.hashes, h[rows]), len(self.hashes) - 1)
                    hit = self.hashes[at] == h[rows]
                    if hit.any():
                        ends.append((k, rows[hit], self.order[at[hit]]))
            found.append(ends)
        return found


def forward(lattice: list, p: np.ndarray, rows: int) -> np.ndarray:
    """alpha[j, word, language]: summed probability of all segmentations of the first j characters."""
    alpha = np.zeros((len(lattice), rows, p.shape[1]))
    alpha[0] = 1
    for j in range(1, len(lattice)):
        single = np.full(rows, UNKNOWN)
        for k, at, ids in lattice[j]:
            alpha[j, at] += alpha[j - k, at] * p[ids]
            if k == 1:
                single[at] = 0
        alpha[j] += alpha[j - 1] * single[:, None]
    return alpha


def backward(lattice: list, p: np.ndarray, rows: int) -> np.ndarray:
    """beta[j, word, language]: summed probability of all segmentations from character j on."""
    beta = np.zeros((len(lattice), rows, p.shape[1]))
    beta[-1] = 1
    for j in range(len(lattice) - 1, 0, -1):
        single = np.full(rows, UNKNOWN)
        for k, at, ids in lattice[j]:
            beta[j - k, at] += beta[j, at] * p[ids]
            if k == 1:
                single[at] = 0
        beta[j - 1] += beta[j] * single[:, None]
    return beta


def long_word(word: str, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log-probabilities of one long word, with the forward values rescaled at every step."""
    text, span = WORD_MARK + word, vocabulary.longest
    recent, log = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for j in range(1, len(text) + 1):
        a, single = np.zeros(p.shape[1]), True
        for k in range(1, min(j, span) + 1):
            i = vocabulary.ids.get(text[j - k:j])
            if i is not None:
                a += recent[-k] * p[i]
                single = single and k != 1
        if single:
            a += recent[-1] * UNKNOWN
        scale = np.where(a > 0, a, 1e-300)
        log += np.log(scale)
        recent = [x / scale for x in recent[-span + 1:]] + [a / scale]
    return log


def by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return groups


def word_scores(words: list[str], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language."""
    out = np.zeros((len(words), p.shape[1]))
    for n, rows in by_length(words).items():
        if n > ARRAY_WORD:
            for i in rows:
                out[i] = long_word(words[i], vocabulary, p)
        else:
            out[rows] = np.log(forward(vocabulary.lattice([words[i] for i in rows]), p, len(rows))[-1])
    return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def load_vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["lang", "word", "n"])


def _expected_batches(batches: Iterator[pa.RecordBatch], path: str, langs: list[str], p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """E-step: expected counts of each piece in each language over this partition's words."""
    vocabulary = load_vocabulary(path)
    total = np.zeros_like(p)
    for batch in batches:
        by_lang: dict[str, tuple[list, list]] = {}
        for lang, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if len(w) <= ARRAY_WORD:                        # pieces are counted from ordinary words
                words, counts = by_lang.setdefault(lang, ([], []))
                words.append(w)
                counts.append(n)
        for lang, (words, counts) in by_lang.items():
            at = langs.index(lang)
            own, weight = p[:, at:at + 1], np.array(counts, dtype=float)
            for rows in by_length(words).values():
                lattice = vocabulary.lattice([words[i] for i in rows])
                alpha, beta = forward(lattice, own, len(rows)), backward(lattice, own, len(rows))
                share = weight[rows] / alpha[-1, :, 0]
                for j in range(1, len(lattice)):
                    for k, r, ids in lattice[j]:
                        np.add.at(total[:, at], ids, alpha[j - k, r, 0] * own[ids, 0] * beta[j, r, 0] * share[r])
    piece, at = np.nonzero(total)
    if len(piece):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, at])],
                                         names=["lang", "piece", "n"])


class Model:
    """Languages in alphabetical order and the piece probabilities, one column per language."""

    def __init__(self, path: str, langs: list[str], p: np.ndarray):
        self.path, self.langs, self.p = path, langs, p
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def __getstate__(self):
        return self.path, self.langs, self.p

    def __setstate__(self, state):
        self.__init__(*state)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Score rows of distinct words; recent ones are remembered."""
        if len(self.known) > REMEMBERED_WORDS:
            self.known, self.scores = {}, self.scores[:0]
        new = [w for w in words if w not in self.known]
        if new:
            first = len(self.scores)
            self.scores = np.concatenate([self.scores, word_scores(new, load_vocabulary(self.path), self.p)])
            self.known.update(zip(new, range(first, first + len(new))))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def loglikelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text in each language, and its number of words."""
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        pending, rows, chars = [], [], 0

        def flush():
            if pending:
                distinct = pa.array(pending).dictionary_encode()
                scores = self._rows(distinct.dictionary.to_pylist())[distinct.indices.to_numpy()]
                for at in range(len(self.langs)):
                    out[:, at] += np.bincount(np.repeat(rows_at, rows_n), scores[:, at], len(texts))

        rows_at: list[int] = []
        rows_n: list[int] = []
        for i, text in enumerate(texts):
            words = words_of(text)
            sizes[i] = len(words)
            pending += words
            rows_at.append(i)
            rows_n.append(len(words))
            chars += len(text or "")
            if chars >= CHUNK_CHARS:
                flush()
                pending, rows_at, rows_n, chars = [], [], [], 0
        flush()
        return out, sizes


def train(labelled: DataFrame, vocabulary_path: str | None = None, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Fits piece probabilities on ``labelled`` (doc_id, text, lang).

    The sample is drawn by a hash of doc_id at a rate that gives about
    ``train_docs`` documents of each language, whatever the table's size.
    """
    path = vocabulary_path or tokenizer_file(VOCABULARY)
    rows = labelled.filter("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    langs = sorted(sizes)
    size = len(load_vocabulary(path).pieces)
    p = np.full((size, len(langs)), 1.0 / size)
    if not langs:
        return Model(path, [], p)
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000)) < F.try_element_at(rate, "lang") * 1_000_000
    words = materialize(rows.filter(chosen).select("lang", "text").mapInArrow(_count_batches, "lang string, word string, n long")
                        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    for _ in range(rounds):
        def expected(it, p=p):
            return _expected_batches(it, path, langs, p)
        counts = words.mapInArrow(expected, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        total = np.full((size, len(langs)), SMOOTHING)
        for r in counts.toLocalIterator():                  # at most languages x vocabulary rows
            total[r["piece"], r["lang"]] += r["n"]
        p = total / total.sum(0)
    return Model(path, langs, p)


def _predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    log, sizes = model.loglikelihoods(texts.to_pylist())
    if not model.langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = log.argmax(1)
    share = 1 / np.exp(log - log.max(1, keepdims=True)).sum(1)
    return [model.langs[b] if n else UNDETERMINED for b, n in zip(best, sizes)], np.where(sizes > 0, share, 0.0)


def _predict_batches(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            pred, score = _predict(batch.column(at), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, "lang_pred", "lang_score"])


def predict(docs: DataFrame, model: Model, columns: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its posterior under equal priors; only ``text`` is looked at.

    Columns of the two names are replaced.
    """
    from pyspark.sql import types as T
    docs = docs.drop(*columns)
    at = [c.lower() for c in docs.columns].index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())])
    return docs.mapInArrow(lambda it: _predict_batches(it, model, at), schema)


def keep_known(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is determined with a posterior of ``least`` or more."""
    lang, score = fresh(docs, "lang"), fresh(docs, "score")
    known = (F.col(lang) != UNDETERMINED) & (F.col(score) >= least)
    return predict(docs, model, (lang, score)).filter(known).drop(lang, score)
