"""Language identification by a linear-chain conditional random field over words.

Each word of a text gets a language: its score for a language sums learned weights of its byte trigrams, its prefix and
suffix, and, where the word is in the learned lexicon, of the word itself; learned transition weights link neighbours.
Forward-backward gives each word's posterior, so a text that switches languages gets labels that switch. A document's
language is the one with the largest mean posterior, and that mean is its score.

Training uses at most ``PER_LANG`` labelled documents of each language, those with the smallest hash, and joins runs of
their words into sequences that switch language, so that transitions are learned. It maximises the conditional
log-likelihood on the driver. Prediction reads every whole text on the executors; features are numpy arrays over the
text's bytes, and documents go through forward-backward in step, as many as ``TEXT_BYTES`` hold.

Posteriors share out certainty among the learned languages and so cannot tell that a text is in none of them. For that the
scores before they are normalised are used: the mean over a text's words of the best language's score above the average of
all (its fit) is small where few features were ever learned. ``keep_identified`` drops texts of ``FIT_WORDS`` words or more
whose fit is below ``FIT_SHARE`` of the smallest one among the training texts of that length.

Defined results: ``und`` with score 0 for a null text or one without a letter (or if no label was learned); words without
a letter take their neighbours' language; ties go to the language first in order; repeated rows are judged each; a null
doc_id counts as the empty text in the split; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftframe.durable import ship
from driftframe.llm.blocks import U64, Block, blocks, runs_of, strings
from driftframe.llm.sampling import smallest

PER_LANG, SEQUENCES, RUN = 200, 1200, 24
GRAM_BITS, WORD_BITS = 16, 18
ROUNDS, RATE, DECAY = 40, 0.2, 1e-4
TEXTS, TEXT_BYTES = 2500, 4_000_000  # that go through forward-backward in step
UNKNOWN = "und"
FIT_WORDS, FIT_SHARE = 20, 0.6
LEAST = 0.34  # below this mean posterior a text is in no learned language; an even guess among four is 0.25


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray
    words: np.ndarray
    steps: np.ndarray
    least_fit: float = -np.inf


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x * U64(0x9E3779B97F4A7C15)) >> U64(64 - bits)).astype(np.int64)


def features(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte of a word its trigram's slot, and where each word's bytes begin; per word the slots of its affixes (two
    columns) and of the word itself, and whether it has a letter (or any byte beyond ASCII)."""
    padded = np.full(len(b.data) + 2, 32, np.uint64)
    inside = np.zeros(len(b.data) + 1, np.int8)
    inside[b.start] += 1
    np.add.at(inside, b.end, -1)
    inside = np.cumsum(inside[:-1]).astype(bool)
    padded[1:-1][inside] = b.data[inside]
    at = np.flatnonzero(inside)
    left, here, right = padded[at], padded[at + 1], padded[at + 2]
    begins = np.zeros(len(b.data), bool)
    begins[b.start] = True
    ends = np.zeros(len(b.data) + 1, bool)
    ends[b.end] = True
    left = np.where(begins[at], U64(32), left)
    right = np.where(ends[at + 1], U64(32), right)
    grams = _slot((left << U64(16)) | (here << U64(8)) | right, GRAM_BITS)
    size = b.end - b.start
    first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    word = b.data.astype(np.uint64)
    pick = lambda at, ok: np.where(ok, word[np.clip(at, 0, max(0, len(word) - 1))], U64(32))
    head = (pick(b.start, size > 0) << U64(16)) | (pick(b.start + 1, size > 1) << U64(8)) | pick(b.start + 2, size > 2)
    tail = (pick(b.end - 3, size > 2) << U64(16)) | (pick(b.end - 2, size > 1) << U64(8)) | pick(b.end - 1, size > 0)
    affix = np.stack([_slot(head + U64(1 << 25), GRAM_BITS), _slot(tail + U64(1 << 26), GRAM_BITS)], 1)
    letter = ((here >= 97) & (here <= 122)) | (here >= 128)
    letters = np.add.reduceat(letter, first) > 0 if len(first) else np.zeros(0, bool)
    return grams, first, affix, _slot(b.word_hashes(), WORD_BITS), letters


def emissions(b: Block, model: Model) -> np.ndarray:
    grams, first, affix, word, letters = features(b)
    if not len(first):
        return np.zeros((0, len(model.langs)), np.float32)
    out = np.add.reduceat(model.grams[grams], first, axis=0)
    out += model.grams[affix[:, 0]] + model.grams[affix[:, 1]] + model.words[word]
    out[~letters] = 0
    return out


def forward_backward(scores: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of each word, and the expected number of each transition. Sequences go in step, the longest first, so
    that those still running at a step stand together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    longest = int(size.max(initial=0))
    running = len(size) - np.searchsorted(np.sort(size), np.arange(longest), side="right")
    offset = np.concatenate([[0], np.cumsum(running)])
    seq = np.repeat(np.arange(len(size)), size)
    place = offset[np.arange(len(scores)) - first[seq]] + rank[seq]
    local = np.empty_like(scores)
    local[place] = np.exp(scores - scores.max(1, keepdims=True))
    move = np.exp(steps - steps.max()).astype(local.dtype)
    alpha = np.empty_like(local)
    for t in range(longest):
        a, z = offset[t], offset[t + 1]
        now = local[a:z] if t == 0 else (alpha[offset[t - 1] : offset[t - 1] + z - a] @ move) * local[a:z]
        alpha[a:z] = now / now.sum(1, keepdims=True)
    expected = np.zeros_like(steps)
    beta = np.ones((int(running[0]) if longest else 0, scores.shape[1]), local.dtype)
    post = np.empty_like(local)
    for t in range(longest - 1, -1, -1):
        a, z = offset[t], offset[t + 1]
        if t + 1 < longest:
            n = int(running[t + 1])
            ahead = local[z : z + n] * beta[:n]
            pair = alpha[a : a + n].T @ (ahead / ((alpha[a : a + n] @ move) * ahead).sum(1, keepdims=True))
            expected += pair * move
            back = ahead @ move.T
            beta[:n] = back / back.sum(1, keepdims=True)
        now = alpha[a:z] * beta[: z - a]
        post[a:z] = now / now.sum(1, keepdims=True)
    return post[place], expected


def train(rows: list[tuple[str, str]], seed: int = 3) -> Model | None:
    """``(text, lang)`` rows to a model."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    pools = [[w for w in (pc.utf8_lower(pa.array([t]))[0].as_py().split() for t, lang in rows if lang == own) if w] for own in langs]
    pools = {k: pool for k, pool in enumerate(pools) if pool}
    keys, texts, gold = sorted(pools), [], []
    for _ in range(SEQUENCES if keys else 0):
        words: list[str] = []
        for _ in range(int(rng.integers(1, 5))):
            k = keys[int(rng.integers(len(keys)))]
            doc = pools[k][int(rng.integers(len(pools[k])))]
            at = int(rng.integers(len(doc)))
            run = doc[at : at + int(rng.integers(3, RUN))]
            words += run
            gold += [k] * len(run)
        texts.append(" ".join(words))
    model = Model(langs, np.zeros((1 << GRAM_BITS, len(langs)), np.float32), np.zeros((1 << WORD_BITS, len(langs)), np.float32), np.zeros((len(langs), len(langs))))
    if not texts:
        return model
    (b,) = blocks(pa.array(texts), block_bytes=1 << 40)
    assert len(b.start) == len(gold), "a word of the sample was cut differently"
    truth = np.eye(len(langs))[gold]
    grams, first, affix, word, letters = features(b)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
    inner = np.setdiff1d(np.arange(len(gold) - 1), b.first[1:-1] - 1)
    seen = np.zeros_like(model.steps)
    np.add.at(seen, (np.asarray(gold)[inner], np.asarray(gold)[inner + 1]), 1)
    tables = [model.grams, model.words, model.steps]
    memory = [[np.zeros(t.shape), np.zeros(t.shape)] for t in tables]
    for step in range(1, ROUNDS + 1):
        scores = emissions(b, model).astype(float)
        post, expected = forward_backward(scores, b.first, model.steps)
        off = (truth - post) * letters[:, None]
        by = lambda slots, rows, n: np.stack([np.bincount(slots, rows[:, k], n) for k in range(len(langs))], 1)
        n = len(model.grams)
        slopes = [by(grams, off[owner], n) + by(affix[:, 0], off, n) + by(affix[:, 1], off, n), by(word, off, len(model.words)), seen - expected]
        for table, (m, v), g in zip(tables, memory, slopes):
            g = g - DECAY * len(gold) / 100 * table
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            table += (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-3)).astype(table.dtype)
    return model


def label_words(text: str, model: Model) -> list[tuple[str, str, float]]:
    """Each word of a text with its language and posterior."""
    out = []
    for b in blocks(pc.utf8_lower(strings(pa.array([text])))):
        post, _ = forward_backward(emissions(b, model), b.first, model.steps)
        words = text.encode().split()
        out += [(w.decode(), model.langs[int(k)], float(p[k])) for w, p, k in zip(words, post, post.argmax(1))]
    return out


def judged(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best language (an index), its mean posterior, its fit, and how many words have a letter."""
    scores, counts, fits, lettered = [], [], [], []
    for b in blocks(pc.utf8_lower(strings(texts))):
        own = emissions(b, model)
        scores.append(own)
        counts.append(b.n_words)
        n = len(b.first) - 1
        words = np.bincount(b.doc, own.any(1), n) if len(own) else np.zeros(n)
        sums = np.stack([np.bincount(b.doc, own[:, k], n) for k in range(own.shape[1])], 1) if len(own) else np.zeros((n, len(model.langs)))
        fits.append((sums.max(1) - sums.mean(1)) / np.maximum(words, 1))
        lettered.append(words)
    size = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    mean = np.zeros((len(size), len(model.langs)))
    if first[-1]:
        post, _ = forward_backward(np.concatenate(scores), first, model.steps)
        full = size > 0
        mean[full] = np.add.reduceat(post, first[:-1][full], axis=0) / size[full, None]
    best = mean.argmax(1)
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
    return best, np.clip(mean[np.arange(len(best)), best], 0, 1), joined(fits), joined(lettered)


def predict(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    return judged(texts, model)[:2]


def _predictor(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model.langs + [UNKNOWN], object)
        for batch in batches:
            for part in (batch.slice(i, n) for i, n in runs_of(batch.column("text"), TEXTS, TEXT_BYTES)):
                best, score = predict(part.column("text"), model)
                known = part.column("letter").to_numpy(zero_copy_only=False) & (score > 0)
                lang = langs[np.where(known, best, len(langs) - 1)]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _sieve(shared, least: float) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, n) for i, n in runs_of(batch.column("text"), TEXTS, TEXT_BYTES)):
                _, score, fit, words = judged(part.column("text"), shared.value)
                yield part.filter(pa.array((score >= least) & ((words < FIT_WORDS) | (fit >= shared.value.least_fit))))

    return run


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """A model from at most ``per_lang`` labelled documents a language that are not held out."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sample = smallest(rows, per_lang, ["doc_id", "text"], 17, each="lang").select("text", "lang").collect()
    rows = sorted((r["text"], r["lang"]) for r in sample)
    if (model := train(rows)) is not None:
        _, _, fit, words = judged(pa.array([t for t, _ in rows]), model)
        model.least_fit = FIT_SHARE * float(fit[words >= FIT_WORDS].min(initial=np.inf)) if (words >= FIT_WORDS).any() else -np.inf
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``(doc_id, held_out, lang_pred, score)``."""
    ship(docs.sparkSession)
    model = model or learn(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predictor(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without those whose language is ``und``, less certain than ``least``, or none of the learned ones by its fit;
    all columns stay. Without any learned label only texts without a letter go."""
    ship(docs.sparkSession)
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    model = learn(docs)
    if model is None:
        return lettered
    plain = lettered.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names may hold dots and ticks
    return plain.mapInArrow(_sieve(docs.sparkSession.sparkContext.broadcast(model), least), plain.schema).toDF(*docs.columns)
