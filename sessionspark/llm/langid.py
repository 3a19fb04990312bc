"""Language identification by a linear-chain conditional random field over words.

A word's features are its byte n-grams of 2 to 4 with marks at both ends (those with a mark are its affixes), affixes of
one character, and the word itself (the lexicon), hashed into TABLE weights for each label; labels of neighbouring words
are tied by learned transition weights. Forward-backward gives each word's label probabilities over the whole text: chains of
CHAIN words are worked on at once, and the messages between them, products of the chains' transfer matrices, are carried along
the text first, so that the result is that of one uncut chain. A text's language is the label with the highest mean probability over its words,
its score that mean; runs of equal word labels mark the switches inside a text.

Training fits all weights on a bounded sample: of each label about PER_LABEL different documents, picked by a hash of their
ids and texts from all documents that may be learned from, with SAMPLE_CHARS characters of each, and of these MIXED parts in ten
with the second half taken from another document, so that switches are seen. Everything else reads all rows and whole texts.

Defined cases: a null text and one without letters are `und` with score 0; with no labelled row all are; null labels and
null ids aren't learned from; a null id is not held out; repeated rows get equal answers, and count once in the sample; of
labels with equal means the first by name wins; a very long text is labelled whole, CUT bytes at a time; an empty table gives an
empty result; key columns may have any names, other columns are not read; more than MOST_LABELS labels raise an error, as
the model is sent to all executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio

CHAIN, TABLE = 64, 1 << 18
PER_LABEL, SAMPLE_CHARS, MIXED, EPOCHS, BATCH, RATE, DECAY = 400, 2048, 3, 4, 64, 0.2, 1e-4
#: Labels of a model at most (a label takes 1 MB), and bytes of a long text that are labelled at once.
MOST_LABELS, CUT = 128, 1 << 19

ASCII_LETTERS = np.zeros(256, bool)
ASCII_LETTERS[65:91] = ASCII_LETTERS[97:123] = True
#: Bytes of words: ASCII letters and all of non-ASCII characters.
LETTER_BYTES = ASCII_LETTERS.copy()
LETTER_BYTES[128:] = True


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of each word, one word after the other, and where each word's begin."""
    size = ends - starts
    wide = size + 2
    at = np.cumsum(wide) - wide
    total = int(wide.sum())
    marked = np.zeros(total + 4, np.uint64)
    inner = np.ones(total, bool)
    inner[at] = inner[at + wide - 1] = False
    marked[at], marked[at + wide - 1] = 256, 257
    marked[:total][inner] = data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    left = np.repeat(at + wide, wide) - np.arange(total)  # symbols from here to the word's end
    grams, where = [], []
    h = marked[:total].copy()
    for n in (2, 3, 4):
        h = h * np.uint64(1_000_003) + marked[n - 1 : total + n - 1]
        ok = np.flatnonzero(left >= n)
        grams.append(h[ok] + np.uint64(n << 56))
        where.append(ok)
    # The whole word, at its end mark.
    grams.append(textio.span_hashes(data, starts, ends, np.arange(256, dtype=np.uint8)))
    where.append(at + wide - 1)
    where = np.concatenate(where)
    order = np.argsort(where, kind="stable")
    slots = (textio.mix(np.concatenate(grams))[order] >> np.uint64(64 - 18)).astype(np.int32)
    return slots, np.searchsorted(where[order], at)


def _chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the chains that cut each row's words; first: each row's first word, and the end."""
    counts = np.diff(first)
    n = -(-counts // CHAIN)
    begin = np.repeat(first[:-1], n) + CHAIN * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(CHAIN, np.repeat(first[1:], n) - begin)


def forward_backward(emission: np.ndarray, begin: np.ndarray, length: np.ndarray, transition: np.ndarray, pairs: bool = False, prior: np.ndarray | None = None, future: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Label probabilities of each word (rows of emission), and the expected transition counts. Chains: begin and length, and for each the messages to its first word and to its last."""
    n_labels = emission.shape[1]
    out = np.zeros_like(emission)
    counts = np.zeros((n_labels, n_labels)) if pairs else None
    if not len(begin):
        return out, counts
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    prior, future = (None if v is None else v[order] for v in (prior, future))
    psi = np.exp(emission - emission.max(axis=1, keepdims=True))
    t_matrix = np.exp(transition).astype(emission.dtype)
    steps = int(length[0])
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]
    ahead = np.zeros((steps, len(begin), n_labels), emission.dtype)
    for t in range(steps):
        m = live[t]
        a = psi[begin[:m] + t] * (1 if prior is None else prior[:m]) if not t else (ahead[t - 1, :m] @ t_matrix) * psi[begin[:m] + t]
        ahead[t, :m] = a / a.sum(axis=1, keepdims=True)
    back = np.ones((len(begin), n_labels), emission.dtype) if future is None else future.astype(emission.dtype)
    for t in range(steps - 1, -1, -1):
        m = live[t]
        p = ahead[t, :m] * back[:m]
        out[begin[:m] + t] = p / p.sum(axis=1, keepdims=True)
        if t:
            b = psi[begin[:m] + t] * back[:m]
            if pairs:
                x = ahead[t - 1, :m, :, None] * t_matrix[None] * b[:, None, :]
                counts += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ t_matrix.T
            back[:m] = b / b.sum(axis=1, keepdims=True)
    return out, counts


def transfers(emission: np.ndarray, begin: np.ndarray, length: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """For each chain, the matrix from a message to its first word to the one that its last word passes on, up to a factor."""
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    psi = np.exp(emission - emission.max(axis=1, keepdims=True))
    t_matrix = np.exp(transition).astype(emission.dtype)
    out = np.zeros((len(begin), *t_matrix.shape), np.float64)
    now = np.eye(len(t_matrix), dtype=emission.dtype)[None] * psi[begin][:, None, :]
    for t in range(1, int(length[0]) if len(length) else 0):
        m = int(np.searchsorted(-length, -t, "left"))
        now[:m] = (now[:m] @ t_matrix) * psi[begin[:m] + t][:, None, :]
        now[:m] /= now[:m].sum(axis=(1, 2), keepdims=True)
    out[order] = now
    return out


def messages(moves: np.ndarray, chains: np.ndarray, transition: np.ndarray, prior: np.ndarray | None = None, future: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Messages to the first and to the last word of each chain of rows that have `chains` chains each (moves: their transfer matrices). prior and future: those to the first row's first and the last row's last word, where the text goes on there."""
    end = np.cumsum(chains)
    start = end - chains
    ahead, back = np.ones(moves.shape[:2]), np.ones(moves.shape[:2])
    if prior is not None:
        ahead[0] = prior
    if future is not None:
        back[-1] = future
    t_matrix = np.exp(transition).astype(np.float64)
    for k in range(1, int(chains.max(initial=0))):
        at = (start + k)[chains > k]
        a = (ahead[at - 1][:, None, :] @ moves[at - 1])[:, 0] @ t_matrix
        ahead[at] = a / a.sum(axis=1, keepdims=True)
        at = (end - 1 - k)[chains > k]
        b = (moves[at + 1] @ back[at + 1][:, :, None])[:, :, 0] @ t_matrix.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    return ahead, back


class Model:
    """Labels and weights of a trained field."""

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        self.weights = np.zeros((TABLE, len(labels)), np.float32)
        self.transition = np.zeros((len(labels), len(labels)), np.float32)

    def emissions(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weights[slots], at, axis=0) if len(at) else np.zeros((0, len(self.labels)), np.float32)

    def word_emissions(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, one, word = np.unique(textio.span_hashes(data, starts, ends, np.arange(256, dtype=np.uint8)), return_index=True, return_inverse=True)
        return self.emissions(*word_features(data, starts[one], ends[one]))[word]

    def word_probabilities(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, prior: np.ndarray | None = None, future: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every word of a piece; prior and future: the messages to its first and last word, where its only row goes on there."""
        emission, (begin, length) = self.word_emissions(data, starts, ends), _chains(first)
        counts = -(-np.diff(first) // CHAIN)
        if prior is None and future is None and counts.max(initial=0) < 2:
            return forward_backward(emission, begin, length, self.transition)[0]
        # Only chains with a neighbour have messages to carry.
        shared = np.repeat((counts > 1) | (prior is not None) | (future is not None), counts)
        ahead, back = np.ones((2, len(begin), len(self.labels)))
        moves = transfers(emission, begin[shared], length[shared], self.transition)
        ahead[shared], back[shared] = messages(moves, counts[counts > 1] if prior is None and future is None else counts, self.transition, prior, future)
        return forward_backward(emission, begin, length, self.transition, prior=ahead.astype(emission.dtype), future=back.astype(emission.dtype))[0]

    def transfer(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The transfer matrix of all words of a piece of one row."""
        moves = transfers(self.word_emissions(data, starts, ends), *_chains(np.array([0, len(starts)])), self.transition)
        t_matrix, now = np.exp(self.transition).astype(np.float64), moves[0]
        for m in moves[1:]:
            now = now @ t_matrix @ m
            now /= now.sum()
        return now


def train(samples: list[tuple[str, str]], seed: int = 0) -> Model:
    """Fit a model to (text, label) samples by stochastic gradients of the log-likelihood (AdaGrad)."""
    model = Model(sorted({label for _, label in samples}))
    if not samples:
        return model
    rng = np.random.default_rng(seed)
    raw = [t.lower().encode() for t, _ in samples]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = textio.word_spans(data, offsets, LETTER_BYTES)
    if not len(starts):
        return model
    _, one, word = np.unique(textio.span_hashes(data, starts, ends, np.arange(256, dtype=np.uint8)), return_index=True, return_inverse=True)
    slots, at = word_features(data, starts[one], ends[one])
    n_slots = np.diff(np.concatenate((at, [len(slots)])))
    label = np.repeat([model.labels.index(x) for _, x in samples], np.diff(first))
    begin, length = _chains(first)
    half = CHAIN // 2
    chains = []
    for k, (b, n) in enumerate(zip(begin.tolist(), length.tolist(), strict=True)):
        chain = np.arange(b, b + n)
        if k % 10 < MIXED and n > half:
            o = int(rng.integers(len(begin)))
            chain = np.concatenate((chain[:half], np.arange(begin[o], begin[o] + min(length[o], half))))
        chains.append(chain)
    n_labels = len(model.labels)
    square, square_t = np.full_like(model.weights, 1e-6), np.full_like(model.transition, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(chains))
        for k in range(0, len(order), BATCH):
            batch = [chains[i] for i in order[k : k + BATCH]]
            words = np.concatenate(batch)
            sizes = np.array([len(c) for c in batch])
            cut = np.cumsum(sizes) - sizes
            types, place = np.unique(word[words], return_inverse=True)
            n = n_slots[types]
            ends_at = np.cumsum(n)
            own = slots[np.repeat(at[types] - (ends_at - n), n) + np.arange(int(ends_at[-1]))]
            emission = model.emissions(own, ends_at - n)[place]
            p, expected = forward_backward(emission, cut, sizes, model.transition, pairs=True)
            y = label[words]
            error = -p
            error[np.arange(len(y)), y] += 1
            error /= len(batch)
            by_type = np.stack([np.bincount(place, error[:, c], len(types)) for c in range(n_labels)], axis=1)
            used, to = np.unique(own, return_inverse=True)
            spread = np.repeat(by_type, n, axis=0)
            g = np.stack([np.bincount(to, spread[:, c], len(used)) for c in range(n_labels)], axis=1) - DECAY * model.weights[used]
            square[used] += g * g
            model.weights[used] += RATE * g / np.sqrt(square[used])
            inside = np.ones(len(y), bool)
            inside[cut] = False
            seen = np.zeros((n_labels, n_labels))
            np.add.at(seen, (y[:-1][inside[1:]], y[1:][inside[1:]]), 1)
            g = (seen - expected) / len(batch) - DECAY * model.transition
            square_t += g * g
            model.transition += (RATE * g / np.sqrt(square_t)).astype(np.float32)
    return model


def sample(docs: DataFrame, *, key: str, text: str, label: str, per_label: int = PER_LABEL) -> DataFrame:
    """About per_label (text, label) rows of each label, with a bounded part of each text."""
    rows = docs.select(*(F.col(textio.quoted(c)).alias(n) for c, n in ((key, "key"), (text, "text"), (label, "label")))).where("key is not null and text is not null and label is not null")
    rows = rows.withColumn("h", F.xxhash64("key", "text", F.lit(7)))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    shares = docs.sparkSession.createDataFrame([(r.label, per_label / r.n) for r in counts], T.StructType([rows.schema["label"], T.StructField("share", T.DoubleType())]))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1) + 1
    taken = F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53) < F.col("share")
    picked = rows.join(F.broadcast(shares), "label").where(taken)
    return picked.select(F.substring("text", place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"), "label", "h").dropDuplicates(["h"]).select("text", "label")


def slices(starts: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the words of a piece: all, or of a single long row so many whole chains as CUT bytes hold."""
    at, total = 0, len(starts)
    while at < total:
        to = total if len(first) > 2 else int(np.searchsorted(starts, starts[at] + CUT))
        if to < total:
            to = at + max(1, (to - at) // CHAIN) * CHAIN
        yield at, min(to, total)
        at = to


def row_means(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean label probabilities of each row and, if each, the label of every word."""
    n = np.diff(first)
    total, words = np.zeros((len(n), len(model.labels))), np.zeros(len(starts) if each else 0, np.int32)
    cuts = list(slices(starts, first))
    spans = [(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in cuts]
    carried = [(None, None)] * len(cuts)
    if len(cuts) > 1:
        carried = list(zip(*messages(np.stack([model.transfer(*x) for x in spans]), np.array([len(cuts)]), model.transition), strict=True))
    for (a, b), span, (prior, future) in zip(cuts, spans, carried, strict=True):
        p = model.word_probabilities(*span, np.clip(first, a, b) - a, prior, future)
        if each:
            words[a:b] = p.argmax(axis=1)
        begin = np.clip(first[:-1], a, b) - a
        some = np.flatnonzero(np.clip(first[1:], a, b) - a > begin)
        total[some] += np.add.reduceat(p, begin[some], axis=0, dtype=np.float64)
    return total / np.maximum(n, 1)[:, None], words


def identify(docs: DataFrame, model: Model, *, keys: list[str], text: str = "text", runs: bool = False) -> DataFrame:
    """keys, lang_pred and score of every row; with runs also an array of (first_word, end_word, lang)."""
    mark = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())])
    added = "lang_pred string, score double" + (", runs array<struct<first_word:bigint,end_word:bigint,lang:string>>" if runs else "")
    named = {k: f"k{i}" for i, k in enumerate(keys) if k != text}
    docs = docs.select(*([F.struct(*(F.col(textio.quoted(k)).alias(n) for k, n in named.items())).alias("_keys")] if named else []), F.col(textio.quoted(text)).alias("_text"))
    schema = T.StructType([*docs.schema.fields[: None if text in keys else -1], *T._parse_datatype_string(added).fields])
    at, given = len(docs.columns) - 1, len(docs.columns) - (text not in keys)
    held = docs.sparkSession.sparkContext.broadcast(model)  # TABLE weights for each of MOST_LABELS labels at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        labels = np.array([*m.labels, "und"], object)
        for batch in batches:
            data, offsets = textio.utf8(pc.utf8_lower(batch.column(at)))
            for i, j in textio.pieces(offsets, CUT):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = textio.word_spans(d, o, LETTER_BYTES)
                known = np.diff(np.searchsorted(np.flatnonzero(ASCII_LETTERS[d]), o)) > 0
                for r in np.flatnonzero(~known & (np.diff(first) > 0)).tolist():
                    known[r] = any(c.isalpha() for c in d[o[r] : o[r + 1]].tobytes().decode())
                known &= len(m.labels) > 0
                mean, word = row_means(m, d, starts, ends, first, runs)
                best = mean.argmax(axis=1) if len(m.labels) else np.zeros(j - i, np.int64)
                lang = np.where(known, labels[best], "und")
                score = np.where(known, np.clip(mean.max(axis=1, initial=0), 0, 1), 0.0)
                columns = [*(batch.column(k).slice(i, j - i) for k in range(given)), pa.array(lang, pa.string()), pa.array(score)]
                if runs:
                    marks = [[{"first_word": a, "end_word": b, "lang": str(labels[word[first[r] + a]])} for a, b in _runs(word[first[r] : first[r + 1]])] if known[r] else [] for r in range(j - i)]
                    columns.append(pa.array(marks, pa.list_(mark)))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = docs.mapInArrow(run, schema)
    return found.select(*(F.col("_text" if k == text else f"_keys.{named[k]}").alias(k) for k in keys), *(f.name for f in schema.fields[given:]))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(0, np.int64)
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(textio.quoted(key)).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """A model from the rows that aren't held out. One task trains on the bounded sample; the driver gets the weights."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted(pair for f in frames for pair in zip(f["text"], f["label"], strict=True))
        m = train(rows)
        yield pd.DataFrame({"labels": [m.labels], "weights": [m.weights.tobytes()], "transition": [m.transition.tobytes()]})

    picked = sample(docs.where(~held_out(key)), key=key, text=text, label=label)
    row = picked.repartition(1).mapInPandas(run, "labels array<string>, weights binary, transition binary").first()
    model = Model(list(row.labels) if row else [])
    if model.labels:
        model.weights = np.frombuffer(row.weights, np.float32).reshape(TABLE, -1)
        model.transition = np.frombuffer(row.transition, np.float32).reshape(len(model.labels), -1)
    return model


def op4_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), fit(docs), keys=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
