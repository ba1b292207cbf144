"""Language ID with unigram pieces, summed over all segmentations.

The pieces are those of a fixed public tokenizer's vocabulary (lower-cased;
never copied, the path is a parameter). Each language has a probability per
piece, fitted by expectation maximisation on labelled rows. A word's probability
is the sum over all its segmentations into pieces (forward algorithm); a text's
is the product over its words, so each distinct word is scored once per batch,
for all languages at once, in numpy. Words of any length are fitted and scored, in logarithms.

The model is fitted on a bounded sample: about ``per_lang`` labelled texts
of each language, at most ``max_docs`` in all (documented parameters; a text counts once, whatever its length). Of more than ``max_docs``
languages the rarest have no row in it and can't be predicted. Predictions cover every whole text.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without labelled rows there is no
language to name, so all is ``und``, and ``keep_identified`` then keeps every text with a letter; ties go to the
language first in order; repeated rows are alike. ``predict`` keeps the caller's columns, but for those named
lang_pred or score in whatever case, which are replaced; ``keep_identified`` returns rows as they are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sluiceway.llm.common import beside, crc_bucket, map_arrow, uniform

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Probability of a character that no piece covers, the same in every language.
UNKNOWN = 1e-7
#: Distinct tokens whose scores are kept by a task.
KEPT_TOKENS = 150_000
#: Words, and characters of words, that are handled as one matrix.
WORDS, CELLS = 20_000, 1_000_000
RUN = re.compile(r"[^\W\d_]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str | None = None) -> list[str]:
    """Distinct lower-cased pieces of letters (words are runs of letters, so that others never match)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(Path(path or vocabulary_path())))
    raw = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p for p in raw if RUN.fullmatch(p.lstrip(MARK)) or p == MARK})


def runs(token: str) -> list[str]:
    """A token's letter runs, each with the mark of a word's start."""
    if token.isalpha():
        return [MARK + token]
    return [MARK + r for r in RUN.findall(token) if any(c.isalpha() for c in r)]


def codes(words: list[str]) -> np.ndarray:
    """Words as a matrix of code points, zeros behind the shorter ones."""
    width = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64)


def batched(words: list[str]) -> Iterator[np.ndarray]:
    """Indexes of words in matrices of like lengths, of WORDS words and about CELLS characters at most."""
    size = np.array([len(w) for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        step = int(max(1, min(WORDS, CELLS // size[order[at]])))
        while step > 1 and size[order[min(at + step, len(order)) - 1]] > 2 * size[order[at]] + 8:
            step = (step + 1) // 2
        yield order[at : at + step]
        at += step


class Pieces:
    """Looks up all pieces in a batch of words by rolling hashes, length by length."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        by_len: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_len.setdefault(len(p), []).append(i)
        #: For each length: which places of a bitmap have a piece, the pieces' hashes in order, and their ids.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, ids in by_len.items():
            m, h = codes([pieces[i] for i in ids]), np.zeros(len(ids), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(n):
                    h = h * BASE + m[:, i] + np.uint64(1)
            rank = np.argsort(h)
            maybe = np.zeros(1 << max(12, (16 * len(ids)).bit_length()), bool)
            maybe[self._place(h, len(maybe))] = True
            self.tables[n] = maybe, h[rank], np.array(ids)[rank]

    @staticmethod
    def _place(h: np.ndarray, size: int) -> np.ndarray:
        return ((h >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)

    def at(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, words that have a piece there, its id), ends ascending."""
        n, width = words.shape
        prefix = np.zeros((width + 1, n), np.uint64)
        power = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                prefix[i + 1] = prefix[i] * BASE + words[:, i] + np.uint64(1)
            for i in range(self.longest):
                power[i + 1] = power[i] * BASE
            for end in range(1, width + 1):
                for length, (maybe, keys, ids) in self.tables.items():
                    if length <= end:
                        h = prefix[end] - prefix[end - length] * power[length]
                        at = np.flatnonzero(maybe[self._place(h, len(maybe))])
                        if not len(at):
                            continue
                        k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                        same = keys[k] == h[at]
                        if same.any():
                            yield end, length, at[same], ids[k[same]]


def forward(pieces: Pieces, prob: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations; words (n, width, zeros behind), prob (pieces + 1, langs) to (n, langs).

    A character that is no piece of its own counts UNKNOWN. Sums are kept relative to a scale that
    follows them every few characters.
    """
    n, width = words.shape
    langs = prob.shape[1]
    size = (words > 0).sum(1)
    ring = {0: np.ones((n, langs))}
    scale, out = np.zeros((n, langs)), np.zeros((n, langs))
    found = pieces.at(words)
    now = next(found, None)
    for end in range(1, width + 1):
        p = np.full((n, langs), UNKNOWN)
        held = []
        while now is not None and now[0] == end:
            if now[1] == 1:
                p[now[2]] = prob[now[3]]
            else:
                held.append(now)
            now = next(found, None)
        ring[end] = ring[end - 1] * p
        for _, length, hit, piece in held:
            ring[end][hit] += ring[end - length][hit] * prob[piece]
        ring.pop(end - pieces.longest - 1, None)
        done = np.flatnonzero(size == end)
        out[done] = np.log(ring[end][done]) + scale[done]
        if end % 8 == 0:
            top = np.maximum.reduce(list(ring.values()))
            scale += np.log(top)
            for v in ring.values():
                v /= top
    return out


def expected_counts(pieces: Pieces, prob: np.ndarray, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used in words (n, width, zeros behind), by forward and backward sums of logs."""
    n, width = words.shape
    size = (words > 0).sum(1)
    spans: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
    a = np.full((width + 1, n), -np.inf)
    a[0] = 0
    by_end: dict[int, list] = {}
    for x in pieces.at(words):
        by_end.setdefault(x[0], []).append(x[1:])
    every = np.arange(n)
    for end in range(1, width + 1):
        single = np.full(n, UNKNOWN)
        ids = np.full(n, pieces.n)
        steps = []
        for length, hit, piece in by_end.get(end, ()):
            if length == 1:
                single[hit], ids[hit] = prob[piece], piece
            else:
                steps.append((end, length, hit, piece, np.log(prob[piece])))
        steps.insert(0, (end, 1, every, ids, np.log(single)))
        for _, length, hit, _, p in steps:
            a[end][hit] = np.logaddexp(a[end][hit], a[end - length][hit] + p)
        spans += steps
    b = np.full((width + 1, n), -np.inf)
    b[size, every] = 0
    total = np.zeros(pieces.n + 1)
    whole = a[size, every]
    for end, length, hit, piece, p in reversed(spans):
        if not np.isfinite(b[end][hit]).any():
            continue
        through = p + b[end][hit]
        total += np.bincount(piece, np.exp(a[end - length][hit] + through - whole[hit]) * weight[hit], pieces.n + 1)
        b[end - length][hit] = np.logaddexp(b[end - length][hit], through)
    return total


def fit_language(pieces: Pieces, words: Counter, rounds: int = 3, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities by expectation maximisation over word types and their counts."""
    types, counts = list(words), np.array(list(words.values()), float)
    parts = [(codes([types[i] for i in at]), counts[at]) for at in batched(types)] if types else []
    prob = np.full(pieces.n + 1, 1.0 / max(1, pieces.n))
    for _ in range(rounds):
        total = sum((expected_counts(pieces, prob, m, w) for m, w in parts), np.zeros(pieces.n + 1))
        total[pieces.n] = 0
        prob = (total + smooth) / (total.sum() + smooth * pieces.n)
    prob[pieces.n] = 0
    return prob


class Model:
    """Languages, their piece probabilities and priors. Small: pieces x languages doubles."""

    def __init__(self, pieces: list[str], sample: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in sample})
        self.pieces = pieces
        look = Pieces(pieces)
        columns = []
        for lang in self.langs:
            words: Counter = Counter()
            for own, text in sample:
                if own == lang:
                    for token, n in Counter(text.lower().split()).items():
                        for r in runs(token):
                            words[r] += n
            columns.append(fit_language(look, words))
        self.prob = np.stack(columns, axis=1) if columns else np.zeros((len(pieces) + 1, 0))
        seen = Counter(lang for lang, _ in sample)
        self.prior = np.log(np.array([(seen[x] + 1) / (len(sample) + len(self.langs)) for x in self.langs]))


class Scorer:
    """Scores whole texts by a model; keeps what it knows of tokens up to a bound."""

    def __init__(self, model: Model):
        self.model, self.look = model, Pieces(model.pieces)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.langs)))
        self.counts = np.zeros(0)

    def learn(self, tokens: set[str]) -> None:
        fresh = [t for t in tokens if t not in self.index]
        if not fresh:
            return
        said = [(i, r) for i, t in enumerate(fresh) for r in runs(t)]
        owner = np.array([i for i, _ in said], np.int64)
        counts = np.bincount(owner, minlength=len(fresh)).astype(float)
        once = counts.max(initial=0) <= 1  # no token has several runs
        logs = np.zeros((len(fresh), len(self.model.langs)))
        for at in batched([r for _, r in said]) if said else ():
            own, found = owner[at], forward(self.look, self.model.prob, codes([said[k][1] for k in at]))
            if once:
                logs[own] = found
            else:
                np.add.at(logs, own, found)
        for t in fresh:
            self.index[t] = len(self.index)
        self.logs, self.counts = np.concatenate([self.logs, logs]), np.concatenate([self.counts, counts])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs = self.model.langs
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not langs:
            return names, scores
        split = [(text or "").lower().split() for text in texts]
        if len(self.index) > KEPT_TOKENS:
            self.forget()
        self.learn(set().union(*split))
        for i, tokens in enumerate(split):
            if not tokens:
                continue
            ids = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
            n = self.counts[ids].sum()
            if not n:
                continue
            logit = (self.model.prior + self.logs[ids].sum(0)) / max(1.0, n**0.5)
            best = int(np.argmax(logit))
            names[i] = langs[best]
            scores[i] = 1 / np.exp(logit - logit[best]).sum()
        return names, scores


def learn(docs: DataFrame, train: Column, *, per_lang: int = 300, max_docs: int = 3000, vocabulary: str | None = None) -> Model:
    """Fit on a bounded sample, about the same number of texts from each language; reruns take the same."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_docs).collect()  # at most max_docs names
    want = max(1, min(per_lang, max_docs // max(1, len(counts))))
    # as an Arrow table: rows given as a list go through Python workers of their own, which stay beside those of mapInArrow
    facts = pa.table({"_lang": pa.array([r[0] for r in counts], pa.string()), "_rate": pa.array([min(1.0, want / r[1]) for r in counts], pa.float64())})
    rates = docs.sparkSession.createDataFrame(facts, "_lang string, _rate double")
    drawn = uniform(F.xxhash64("doc_id", "text"), F.lit(3))
    met = rows.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).where(drawn < F.col("_rate"))
    some = met.groupBy("lang", "text").agg(F.min(drawn / F.col("_rate")).alias("at")).orderBy("at", "lang", "text").limit(2 * max_docs)
    return Model(load_pieces(vocabulary), sorted((r[0], r[1]) for r in some.select("lang", "text").collect()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score."""
    return _predicted(docs.select(F.struct(*beside(docs, "lang_pred", "score")).alias("doc"), "text"), model).select("doc.*", "lang_pred", "score")


def _predicted(packed: DataFrame, model: Model) -> DataFrame:
    """(doc, text) to (doc, lang_pred, score)."""
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            names, scores = scorer.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc", "lang_pred", "score"])

    return map_arrow(packed, run, StructType([packed.schema["doc"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id) mod 3 isn't 1."""
    held = crc_bucket("doc_id", 3) == 1
    model = learn(docs, ~held, **options)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that are in some language: those predicted ``und`` go."""
    model = learn(docs, crc_bucket("doc_id", 3) != 1, **options)
    packed = docs.select(F.struct("*").alias("doc"), "text")
    kept = _predicted(packed, model).where(F.col("lang_pred") != "und") if model.langs else packed.where(F.col("text").rlike(r"\p{L}"))
    return kept.select("doc.*")
