"""Language identification with a linear-chain conditional random field over words.

Method: a word's features are its character n-grams (one to four bytes of the
lower-cased word between boundary marks, so that affixes are features too), hashed
to a weight table, and the word itself if the training lexicon has it. Transitions
between neighbouring words' languages are learned with the weights, by the
gradient of the conditional likelihood from forward-backward. Training sequences
splice runs of words from documents of different languages, so the model sees
changes of language. Marginals come from forward-backward over the whole text: the
chain is cut into blocks whose transfer matrices are multiplied, which is exact and
runs over all blocks of a batch at once. A document's scores are the mean marginals
of its words, weighted by their letters.

The model is fitted on the driver to a bounded sample: at most ``max_docs``
labelled rows of ``max_chars`` characters together, an equal share of both for each
language, those with the smallest hashes (a row too long for what is left of the share
is passed over), and ``max_words`` words of them.

A word is a letter (Unicode category L) and the letters and marks after it. A text of
more than SEGMENT words is read in segments, twice: once for the forward messages at
their borders, once backwards for the marginals; the result is that of one pass.

Defined cases: text that is null or has no letter is ``und`` with score 0; ties go
to the language that sorts first; no labelled row gives ``und`` for all; repeated
rows are judged each on its own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
UNDETERMINED = "und"
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
BLOCK = 64
#: Words of a text that are held at once; of all texts of a slice together, characters.
SEGMENT, SLICE_CHARS = 100_000, 500_000
#: Distinct words whose scores a task remembers.
REMEMBERED = 100_000


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words one after another, and where each word's begin."""
    raw = [b"\x02" + w.encode() + b"\x03" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(data))  # bytes to the word's end
    owner = np.repeat(np.arange(len(raw)), sizes)
    grams, owners, h = [], [], np.zeros(len(data), np.uint32)
    for n in SIZES:
        shifted = np.zeros(len(data), np.uint32)
        shifted[: len(data) - n + 1] = data[n - 1 :]
        h = (h + shifted + np.uint32(1)) * np.uint32(0x9E3779B1)
        ok = left >= n
        grams.append((h ^ np.uint32(n * 0x05EBCA6B))[ok])
        owners.append(owner[ok])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    grams = grams[order] * np.uint32(0xC2B2AE35)
    starts = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(raw)))])[:-1]
    return (grams >> np.uint32(16)).astype(np.int64), starts


class _Numbers(dict):
    """Words in the order of their coming."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


@dataclass
class Field:
    """A fitted model; scores are natural logarithms."""

    langs: list[str]
    grams: np.ndarray  # BUCKETS x languages
    lexicon: dict[str, np.ndarray]
    transitions: np.ndarray
    known: _Numbers = field(default_factory=_Numbers)  # words met lately, by the rows of their scores
    scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": _Numbers(), "scores": None}

    def remembered(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; each distinct word is scored once."""
        if self.scores is None or len(self.known) > REMEMBERED:
            self.known, self.scores = _Numbers(), np.zeros((0, len(self.langs)))
        old = len(self.known)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if len(self.known) > old:
            self.scores = np.concatenate([self.scores, self.emissions(list(islice(self.known, old, None)))])
        return self.scores[ids]

    def emissions(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        if not words:
            return np.zeros((0, len(self.langs)))
        grams, starts = features(words)
        scores = np.add.reduceat(self.grams[grams], starts, axis=0)
        counts = np.diff(np.append(starts, len(grams)))
        scores /= np.sqrt(counts)[:, None]
        for i, w in enumerate(words):
            if (known := self.lexicon.get(w)) is not None:
                scores[i] += known
        return scores

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each text, a row for each word: the probabilities of the languages there."""
        words = [w for own in texts for w in own]
        if not words:
            return [np.zeros((0, len(self.langs))) for _ in texts]
        lengths = [len(own) for own in texts]
        gamma, _ = forward_backward(self.remembered(words), self.transitions, lengths)
        return np.split(gamma, np.cumsum(lengths)[:-1])

    def mean(self, text: str) -> np.ndarray | None:
        """The mean marginals of a long text's words, weighted by their letters, in segments."""
        begins, alphas, alpha = [], [], None
        for begin, words in _segments(text):
            begins.append(begin)
            alphas.append(alpha)
            alpha = forward(self.remembered(words), self.transitions, alpha)
        total, letters, beta = np.zeros(len(self.langs)), 0, None
        for begin, end, alpha in zip(reversed(begins), [None, *reversed(begins[1:])], reversed(alphas), strict=True):
            words = words_of(text[begin:end])
            scores = self.remembered(words)
            gamma, _ = forward_backward(scores, self.transitions, [len(words)], alpha, beta)
            beta = backward(scores, self.transitions, beta)
            weights = np.fromiter(map(len, words), float, len(words))
            total += weights @ gamma
            letters += weights.sum()
        return total / letters if letters else None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        long = [t is not None and len(t) > 2 * SEGMENT for t in texts]
        split = [words_of(t) if t and not own else [] for t, own in zip(texts, long, strict=True)]
        means: list[np.ndarray | None] = []
        for words, gamma in zip(split, self.marginals(split) if self.langs else [()] * len(split), strict=True):
            weights = np.fromiter(map(len, words), float, len(words))
            means.append(weights @ gamma / weights.sum() if words and self.langs else None)
        langs, best = [], []
        for text, own, mean in zip(texts, long, means, strict=True):
            mean = self.mean(text) if own and self.langs else mean
            langs.append(UNDETERMINED if mean is None else self.langs[int(mean.argmax())])
            best.append(0.0 if mean is None else min(1.0, float(mean.max())))
        return langs, best


def _segments(text: str) -> Iterator[tuple[int, list[str]]]:
    """Runs of at most SEGMENT words: where each begins in the text, and its words."""
    begin, words = 0, []
    for m in LETTERS.finditer(text):
        if len(words) == SEGMENT:
            yield begin, words
            begin, words = m.start(), []
        words.append(m[0].lower())
    if words:
        yield begin, words


def _steps(scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transitions)


def forward(scores: np.ndarray, transitions: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
    """The forward message after these words, from that before them (None: they begin the text)."""
    e, t = _steps(scores, transitions)
    for product in _products(e, t, alpha is None):
        alpha = (np.ones(len(t)) if alpha is None else alpha) @ product
        alpha = alpha / alpha.sum()
    return alpha


def backward(scores: np.ndarray, transitions: np.ndarray, beta: np.ndarray | None) -> np.ndarray:
    """The backward message before these words, from that after them (None: they end the text)."""
    e, t = _steps(scores, transitions)
    beta = np.full(len(t), 1 / len(t)) if beta is None else beta
    for product in reversed(_products(e, t, False)):
        beta = product @ beta
        beta = beta / beta.sum()
    return beta


def _products(e: np.ndarray, t: np.ndarray, first: bool) -> list[np.ndarray]:
    """The transfer matrices of blocks of words; no transition leads to the first word of a text."""
    n, k = e.shape
    blocks = -(-n // BLOCK)
    padded = np.ones((blocks * BLOCK, k))
    padded[:n] = e
    steps = padded.reshape(blocks, BLOCK, k)
    live = (np.arange(blocks * BLOCK) < n).reshape(blocks, BLOCK)
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(min(BLOCK, n)):
        on = live[:, i]
        step = product[on] @ t
        if first and i == 0:
            step[0] = np.eye(k)
        step = step * steps[on, i][:, None, :]
        product[on] = step / step.sum(axis=(1, 2), keepdims=True)
    return list(product)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, lengths: list[int], before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and summed pair marginals; sequences lie one after another in scores.

    before, after: messages of what lies around a single sequence, if it is a segment.
    """
    k = scores.shape[1]
    e, t = _steps(scores, transitions)
    # blocks of at most BLOCK words, each within one sequence; short ones are padded with idle steps
    starts, first = [], []
    at = 0
    for n in lengths:
        for i in range(0, n, BLOCK):
            starts.append((at + i, min(BLOCK, n - i)))
            first.append(i == 0 and before is None)
        at += n
    begin, size = np.array([s for s, _ in starts]), np.array([n for _, n in starts])
    first, blocks = np.array(first), len(starts)
    new = np.isin(begin, np.cumsum([0, *lengths])[:-1])
    index = np.minimum(begin[:, None] + np.arange(BLOCK), len(scores) - 1)
    live = np.arange(BLOCK) < size[:, None]
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for i in range(int(size.max())):
        on = live[:, i]
        moved = product[on] if i else np.where(first[on, None, None], np.eye(k), t)
        step = (moved @ t if i else moved) * e[index[on, i]][:, None, :]
        product[on] = step / step.sum(axis=(1, 2), keepdims=True)
    alpha, beta = np.empty((blocks, k)), np.empty((blocks, k))
    for b in range(blocks):  # no transition leads to a sequence's first word
        alpha[b] = (np.ones(k) if before is None else before) if new[b] else message
        message = alpha[b] @ product[b]
        message = message / message.sum()
    for b in range(blocks - 1, -1, -1):
        if b == blocks - 1 or new[b + 1]:
            beta[b] = 1 / k if after is None else after
        else:
            message = product[b + 1] @ beta[b + 1]
            beta[b] = message / message.sum()
    gamma, pairs = np.empty_like(scores), np.zeros((k, k))
    forward = np.empty((int(size.max()), blocks, k))
    state = alpha
    for i in range(len(forward)):
        on = live[:, i]
        step = (state @ t if i else np.where(first[:, None], state, state @ t)) * e[index[:, i]]
        step /= step.sum(axis=1, keepdims=True)
        state = np.where(on[:, None], step, state)
        forward[i] = state
    state = beta
    for i in range(len(forward) - 1, -1, -1):
        on = live[:, i]
        joint = forward[i] * state
        gamma[index[on, i]] = (joint / joint.sum(axis=1, keepdims=True))[on]
        weighted = e[index[:, i]] * state
        inner = on & ~(first & (i == 0))
        before = forward[i - 1] if i else alpha
        pair = before[inner][:, :, None] * t * weighted[inner][:, None, :]
        pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        back = weighted @ t.T
        state = np.where(on[:, None], back / back.sum(axis=1, keepdims=True), state)
    return gamma, pairs


def fit(rows: list[tuple[str, str]], max_words: int = 200_000, rounds: int = 6, batch: int = 16, rate: float = 0.3, decay: float = 1e-4, seed: int = 0) -> Field:
    """Learn from (text, language) rows; the same rows in any order give the same model."""
    rows = sorted((lang, words) for text, lang in rows if (words := words_of(text)))
    langs = sorted({lang for lang, _ in rows})
    k = len(langs)
    model = Field(langs, np.zeros((BUCKETS, k)), {}, np.zeros((k, k)))
    if not langs:
        return model
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    # runs of words, dealt evenly over the languages, spliced to sequences
    runs: list[list[tuple[int, list[str]]]] = [[] for _ in langs]
    for lang, words in rows:
        at = 0
        while at < len(words):
            n = int(rng.geometric(1 / 25))
            runs[langs.index(lang)].append((langs.index(lang), words[at : at + n]))
            at += n
    share = max_words // k
    chosen = []
    for own in runs:
        rng.shuffle(own)
        kept = np.cumsum([len(words) for _, words in own]) <= share
        chosen += [run for run, ok in zip(own, kept, strict=True) if ok] or own[:1]
    rng.shuffle(chosen)
    sequences = [chosen[i : i + 6] for i in range(0, len(chosen), 6)]

    seen: dict[str, np.ndarray] = {}
    for lang, words in chosen:
        for w in words:
            seen.setdefault(w, np.zeros(k))[lang] += 1
    # words met often enough to be worth a weight of their own
    model.lexicon = {w: np.zeros(k) for w, n in seen.items() if n.sum() >= 5}
    grams_sq, lexicon_sq, trans_sq = np.full((BUCKETS, k), 1e-6), {w: np.full(k, 1e-6) for w in model.lexicon}, np.full((k, k), 1e-6)
    for _ in range(rounds):
        for i in rng.permutation(range(0, len(sequences), batch)).tolist():
            part = sequences[i : i + batch]
            texts = [[w for _, words in runs for w in words] for runs in part]
            truth = np.array([lang for runs in part for lang, words in runs for _ in words])
            number: dict[str, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for words in texts for w in words])
            vocabulary = list(number)
            lengths = [len(words) for words in texts]
            gamma, pairs = forward_backward(model.emissions(vocabulary)[ids], model.transitions, lengths)
            gap = -gamma
            gap[np.arange(len(truth)), truth] += 1
            by_word = np.zeros((len(vocabulary), k))
            np.add.at(by_word, ids, gap)
            grams, starts = features(vocabulary)
            counts = np.diff(np.append(starts, len(grams)))
            slope = np.zeros((BUCKETS, k))
            np.add.at(slope, grams, np.repeat(by_word / np.sqrt(counts)[:, None], counts, axis=0))
            touched = np.unique(grams)
            slope = slope[touched] - decay * model.grams[touched] * len(truth)
            grams_sq[touched] += slope**2
            model.grams[touched] += rate * slope / np.sqrt(grams_sq[touched])
            for w, g in zip(vocabulary, by_word, strict=True):
                if w in model.lexicon:
                    lexicon_sq[w] += g**2
                    model.lexicon[w] += rate * g / np.sqrt(lexicon_sq[w])
            inside = np.ones(len(truth), bool)
            inside[np.cumsum([0, *lengths])[:-1]] = False
            actual = np.zeros((k, k))
            np.add.at(actual, (truth[:-1][inside[1:]], truth[1:][inside[1:]]), 1)
            slope = actual - pairs
            trans_sq += slope**2
            model.transitions += rate * slope / np.sqrt(trans_sq)
    return model


def sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, max_docs: int, max_chars: int) -> list[tuple[str, str]]:
    """Labelled rows, in whole texts: for each language an equal share of max_docs and of max_chars, in the order of a hash."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit(1)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n_langs = rows.select("lang").distinct().count()
    if not n_langs:
        return []
    quota, chars = max(1, max_docs // n_langs), max_chars // n_langs
    found = rows.select("h", "lang", F.char_length("text").alias("n"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("rank") <= quota).orderBy("lang", "h").limit(max_docs).collect()
    chosen, left, last = set(), 0, None
    for r in found:
        if r["lang"] != last:
            last, left = r["lang"], chars
            chosen.add((r["lang"], r["h"]))  # one at least, whatever its length
            left -= r["n"]
        elif r["n"] <= left:
            chosen.add((r["lang"], r["h"]))
            left -= r["n"]
    texts = rows.where(F.col("h").isin([h for _, h in chosen])).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()
    return [(r["text"], r["lang"]) for r in texts if (r["lang"], r["h"]) in chosen]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 800, max_chars: int = 20_000_000, **options) -> Field:
    return fit(sample(docs, text_col, lang_col, id_col, max_docs, max_chars), **options)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Parts of a batch: of so many rows, and of SLICE_CHARS unless one text is longer."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("__text")), 0).to_numpy(zero_copy_only=False)
    begin = chars = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and (chars + n > SLICE_CHARS or i - begin == rows):
            yield batch.slice(begin, i - begin)
            begin, chars = i, 0
        chars += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def identify(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred and lang_score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        model = shared.value
        for batch in batches:
            for part in _slices(batch):
                langs, scores = model.predict(part.column("__text").to_pylist())
                columns = [c for n, c in zip(part.schema.names, part.columns, strict=True) if n != "__text"]
                names = [n for n in part.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "lang_score"])

    schema = docs.schema
    rows = docs.withColumn("__text", F.col(text_col))
    return map_arrow(rows, task, schema.add("lang_pred", "string").add("lang_score", "double"))

