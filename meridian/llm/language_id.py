"""Language identification by segmentation-marginalised unigrams.

A text's words are strings over the pieces of a fixed public vocabulary. Each language has
a probability for every piece; a word's probability is the sum over all its segmentations,
by a forward algorithm over its characters. A text is the product of its words, so the work
is done once per distinct word and batch. A word is a run of letters, of whatever length:
long ones, as scripts without blanks have, go one by one with their sums kept in scale. Piece probabilities are one step of expectation
maximisation: expected counts from a forward-backward pass, under a start that gives every
piece the same chance, over a bounded sample of labelled documents (FIT_ROWS, by a hash).
The features are the texts alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, table

#: Labelled documents used at most to fit; the bound is on the classifier's sample only.
FIT_ROWS = 20_000
#: Characters from which a word is summed alone, to keep tables of many words narrow; either way gives the same sums.
LONG_WORD = 48
#: Sums below this are made again in scale, so that none gets lost.
FAINT = 1e-250
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 300_000


def vocabulary(path: str) -> dict[str, int]:
    """Piece to number, for the lower-cased letter pieces of a sentencepiece model file, and every letter met in them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = sorted({p for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i).lstrip("▁").lower()) and p.isalpha()})
    return {p: i for i, p in enumerate(names)}


class Lattices:
    """Words as arcs over a vocabulary, many words at once: position by position for all together."""

    def __init__(self, pieces: dict[str, int]):
        # with every prefix of a piece, so that a look ahead ends where no piece goes on
        self.steps = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | pieces
        self.unknown = len(pieces)

    def arcs(self, words: list[str]):
        """(word, start, end, piece) of all arcs, sorted by end; a letter that is no piece has the unknown one."""
        get, unk = self.steps.get, self.unknown
        w, a, b, p = [], [], [], []
        for k, word in enumerate(words):
            n = len(word)
            for i in range(n):
                q = get(word[i])
                w.append(k), a.append(i), b.append(i + 1), p.append(unk if q is None or q < 0 else q)
                j = i + 2
                while q is not None and j <= n:
                    q = get(word[i:j])
                    if q is not None and q >= 0:
                        w.append(k), a.append(i), b.append(j), p.append(q)
                    j += 1
        w, a, b, p = (np.array(x, dtype=np.int32) for x in (w, a, b, p))
        o = np.argsort(b, kind="stable")
        return w[o], a[o], b[o], p[o]

    def forward(self, words: list[str], prob: np.ndarray, arcs=None) -> np.ndarray:
        """alpha[word, position, language]: the summed probability of all segmentations of the prefix."""
        w, a, b, p = arcs or self.arcs(words)
        most = max(map(len, words), default=0)
        alpha = np.zeros((len(words), most + 1, prob.shape[1]))
        alpha[:, 0] = 1
        ends = np.searchsorted(b, np.arange(1, most + 2))
        for j in range(1, most + 1):
            k = slice(ends[j - 1], ends[j])
            if k.start == k.stop:
                continue
            add = alpha[w[k], a[k]] * prob[p[k]]
            for lang in range(prob.shape[1]):
                alpha[:, j, lang] += np.bincount(w[k], weights=add[:, lang], minlength=len(words))
        return alpha

    def log_likelihood(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """log P(word | language), by the forward algorithm."""
        if not words:
            return np.zeros((0, prob.shape[1]))
        long = [k for k, x in enumerate(words) if len(x) > LONG_WORD]
        if long:
            out = np.empty((len(words), prob.shape[1]))
            short = [k for k, x in enumerate(words) if len(x) <= LONG_WORD]
            out[short] = self.log_likelihood([words[k] for k in short], prob)
            for k in long:
                out[k] = self._scaled(words[k], prob)[1].sum(axis=0)
            return out
        alpha = self.forward(words, prob)
        end = alpha[np.arange(len(words)), [len(x) for x in words]]
        out = np.log(np.maximum(end, FAINT))
        for k in np.flatnonzero((end < FAINT).any(axis=1)).tolist():
            out[k] = self._scaled(words[k], prob)[1].sum(axis=0)
        return out

    def _scaled(self, word: str, prob: np.ndarray):
        """(arcs by end, logs of the scales): the forward sums of one word, each position's divided by its own sum.

        Only as many positions are held as the longest piece spans.
        """
        w, a, b, p = self.arcs([word])
        ends = np.searchsorted(b, np.arange(1, len(word) + 2))
        scale = np.zeros((len(word), prob.shape[1]))
        back = [np.ones(prob.shape[1])]  # sums at the last positions, nearest last, each in the scale of the last
        most = max(map(len, self.steps), default=1)
        for j in range(1, len(word) + 1):
            k = slice(ends[j - 1], ends[j])
            got = sum(back[x - j] * prob[q] for x, q in zip(a[k].tolist(), p[k].tolist(), strict=True))
            scale[j - 1] = np.log(np.maximum(got, 1e-300))
            back = [x / np.maximum(got, 1e-300) for x in back[-most:]] + [np.ones(prob.shape[1])]
        return (a, b, p), scale

    def expected(self, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected pieces over all segmentations: counts[word, language] words each. Forward, then backward."""
        long = [k for k, x in enumerate(words) if len(x) > LONG_WORD]
        if long:
            short = [k for k, x in enumerate(words) if len(x) <= LONG_WORD]
            total = self.expected([words[k] for k in short], counts[short], prob) if short else np.zeros((len(prob), counts.shape[1]))
            for k in long:
                total += self._expected_long(words[k], prob)[:, None] * counts[k]
            return total
        arcs = w, a, b, p = self.arcs(words)
        alpha = self.forward(words, prob, arcs)[:, :, 0]
        beta = np.zeros_like(alpha)
        size = np.array([len(x) for x in words], dtype=np.int64)
        faint = np.flatnonzero(alpha[np.arange(len(words)), size] < FAINT)
        if len(faint):
            plain = np.setdiff1d(np.arange(len(words)), faint)
            total = self.expected([words[k] for k in plain.tolist()], counts[plain], prob)
            return total + sum(self._expected_long(words[k], prob)[:, None] * counts[k] for k in faint.tolist())
        beta[np.arange(len(words)), size] = 1
        one = prob[:, 0]
        o = np.argsort(-a, kind="stable")
        w, a, b, p = w[o], a[o], b[o], p[o]
        starts = np.searchsorted(-a, -np.arange(alpha.shape[1]), "left"), np.searchsorted(-a, -np.arange(alpha.shape[1]), "right")
        for i in range(alpha.shape[1] - 2, -1, -1):
            k = slice(starts[0][i], starts[1][i])
            beta[:, i] += np.bincount(w[k], weights=beta[w[k], b[k]] * one[p[k]], minlength=len(words))
        post = alpha[w, a] * one[p] * beta[w, b] / alpha[np.arange(len(words)), size][w]
        return np.stack([np.bincount(p, weights=post * counts[w, lang], minlength=len(one)) for lang in range(counts.shape[1])], axis=1)


    def _expected_long(self, word: str, prob: np.ndarray) -> np.ndarray:
        """expected() of one long word: log sums forward and backward."""
        w, a, b, p = self.arcs([word])
        one = np.log(np.maximum(prob[:, 0], 1e-300))[p]
        n = len(word)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0.0
        ends = np.searchsorted(b, np.arange(1, n + 2))
        for j in range(1, n + 1):
            k = slice(ends[j - 1], ends[j])
            ahead[j] = np.logaddexp.reduce(ahead[a[k]] + one[k])
        o = np.argsort(a, kind="stable")
        starts = np.searchsorted(a[o], np.arange(n + 1))
        for i in range(n - 1, -1, -1):
            k = o[starts[i] : starts[i + 1]]
            behind[i] = np.logaddexp.reduce(one[k] + behind[b[k]])
        return np.bincount(p, weights=np.exp(ahead[a] + one + behind[b] - ahead[n]), minlength=len(prob))


def words_of(text: str | None) -> Counter:
    """Lower-cased runs of letters with their numbers. Numbers that are no decimal digits are no letters, though the expression takes them."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        for part in (w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split():
            out[part] += n
    return out


def train(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> tuple[list[str], dict[str, int], np.ndarray, np.ndarray]:
    """(languages, pieces, P(piece | language), P(language)) from labelled documents; rows with a null label or text are left out.

    What reaches the driver is one row a language and piece. No labelled rows: no languages.
    """
    rows = docs.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    per = rows.groupBy(lang_col).count().collect()
    langs = sorted(r[0] for r in per)
    pieces = vocabulary(vocab_path)
    if not langs:
        return [], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0)

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        lat = Lattices(pieces)
        number = {x: i for i, x in enumerate(langs)}
        got: dict[str, np.ndarray] = {}
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, k in words_of(text).items():
                row = got.get(w)
                if row is None:
                    row = got[w] = np.zeros(len(langs))
                row[number[lang]] += k
        total = np.zeros((len(pieces) + 1, len(langs)))
        start = np.full((len(pieces) + 1, 1), 1 / (len(pieces) + 1))
        words = list(got)
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            total += lat.expected(part, np.array([got[w] for w in part]), start)
        p, c = np.nonzero(total)
        return pa.record_batch([pa.array(p), pa.array(c), pa.array(total[p, c])], names=["piece", "lang", "n"])

    sums = batches(rows.select(text_col, lang_col), "piece long, lang long, n double", count).groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(pieces) + 1, len(langs)))
    total[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
    # a little of the pooled distribution in each, so that no piece is impossible
    pooled = (total.sum(axis=1) + 0.1) / (total.sum() + 0.1 * len(total))
    prob = 0.98 * total / np.maximum(total.sum(axis=0), 1e-12) + 0.02 * pooled[:, None]
    count_of = dict((r[0], r[1]) for r in per)
    prior = np.array([count_of[x] for x in langs], dtype=float)
    return langs, pieces, prob, prior / prior.sum()


_known: dict[str, dict[str, np.ndarray]] = {}


def known_words(model: str) -> dict[str, np.ndarray]:
    """Words that this worker has summed under a model, with their log-likelihoods; emptied when it grows too large or the model changes."""
    if model not in _known or len(_known[model]) > _CACHE_WORDS:
        _known.clear()
        _known[model] = {}
    return _known[model]


def predict(docs: DataFrame, model, text_col: str = "text", out: str = "_lang") -> DataFrame:
    """docs with a struct column out: lang_pred and score (the posterior of that language, 0 to 1).

    A null text, one without letters, and any text under a model without languages: UNKNOWN, score 0.
    """
    langs, pieces, prob, prior = model
    name = hashlib.sha256(repr((langs, sorted(pieces.items()))).encode() + prob.tobytes()).hexdigest()

    def run(text: pd.Series) -> pd.DataFrame:
        lat = Lattices(pieces)
        pred, score = [], []
        for at in range(0, len(text), 256):
            part = [words_of(t) for t in text.iloc[at : at + 256]]
            known = known_words(name)
            new = list({w for c in part for w in c if w not in known}) if langs else []
            for k in range(0, len(new), 4096):
                known.update(zip(new[k : k + 4096], lat.log_likelihood(new[k : k + 4096], prob), strict=True))
            for c in part:
                if not c or not langs:
                    pred.append(UNKNOWN), score.append(0.0)
                    continue
                ll = np.log(prior) + np.array([known[w] for w in c]).T @ np.fromiter(c.values(), float, len(c))
                post = np.exp(ll - ll.max())
                k = int(ll.argmax())
                pred.append(langs[k]), score.append(float(post[k] / post.sum()))
        return pd.DataFrame({"lang_pred": pd.Series(pred, dtype=object), "score": pd.Series(score, dtype=float)})

    return docs.withColumn(out, F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col)))


def identify(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id_col, held_out, lang_pred, score), one a document.

    Labels are learned from documents whose crc32(id as text) mod 3 is not 1 (held_out: it
    is); a null id is never held out. Repeated rows get the same prediction. Columns not
    named are not read, and label, id and source are no inputs of a prediction.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = train(docs.where(~held), vocab_path, id_col, text_col, lang_col)
    out = predict(docs.select(id_col, text_col, held.alias("held_out")), model, text_col)
    return out.select(id_col, "held_out", "_lang.lang_pred", "_lang.score")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op1_language_id": op1_language_id}
