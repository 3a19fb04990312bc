"""Token counts by Viterbi over a unigram vocabulary, without building token lists.

An Aho-Corasick automaton over the vocabulary's UTF-8 bytes enumerates the pieces that end at each byte, longest first.
Dynamic programming keeps, at each byte, the best score and the number of pieces that gives it. Many words advance in
lockstep, one byte of each at a time, as numpy arrays. Ties go as in the tokenizers library's Unigram model: a later
candidate must be strictly better, so the longest piece wins; a character without a piece of its own is unknown and scores
10 below the least piece. With byte fallback it counts as its bytes, else unknown characters that touch are one token.

A vocabulary is a SentencePiece file's pieces and scores, or a tokenizers file (.json) of a Unigram model, with any scores.
Spaces become U+2581 with one before the text. Texts are cut into words before each U+2581 if the file's Metaspace
pre-tokenizer cuts there itself, or if no piece holds U+2581 after another character and no unknown run can go on over it: then
every way through the text ends a piece there. Sums of whole numbers are exact, so a word's best way is the same at any place.
Sums of fractions are rounded, and a word's best way could depend on what was added up before it; but only if two ways are
nearer to each other than the rounding. So each word's MARGIN, the least lead that any best way in it has, is kept beside its
count, and a text with a word whose lead is within the rounding of its sum is counted whole, in the library's order of addition.

No public unigram file is at hand and tokenizers are not trained here: the query takes the SentencePiece file's pieces and
scores as its vocabulary.

Defined cases: a null or empty text has 0 tokens and score 0; repeated rows and null ids stay rows; a text that holds
U+2581 itself isn't cut into words, and is by a pre-tokenizer; a very long text is counted whole, by its words, and words of
more than LONG bytes one by one; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textio

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 2048
#: Leads under MARGIN times a text's sum may be rounding: ten thousand additions of 64-bit floats stay under it.
MARGIN = 1e-12


class Automaton:
    """Aho-Corasick over bytes: next state, and for each state the longest piece that ends there and the next shorter one's state."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.byte_fallback = byte_fallback
        children: list[dict[int, int]] = [{}]
        depth, score, ends = [0], [0.0], [False]
        for piece, value in pieces:
            node = 0
            for byte in piece.encode():
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    score.append(0.0)
                    ends.append(False)
                node = children[node][byte]
            if node:
                score[node], ends[node] = value, True
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        self.shorter = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        for byte, node in children[0].items():
            self.next[0, byte] = node
        queue = deque(children[0].values())
        while queue:
            node = queue.popleft()
            f = int(fail[node])
            self.shorter[node] = f if ends[f] else self.shorter[f]
            self.next[node] = self.next[f]
            for byte, child in children[node].items():
                fail[child] = self.next[f, byte]
                self.next[node, byte] = child
                queue.append(child)
        self.depth, self.score = np.array(depth, np.int64), np.array(score)
        self.longest = np.where(np.array(ends), np.arange(n), self.shorter).astype(np.int32)
        self.unknown = min(v for _, v in pieces) - UNKNOWN_PENALTY

    def count(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best score and piece count of each word, and the least lead over a second best that the best has at any of its characters."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        cells = np.cumsum(sizes + 1) - (sizes + 1)  # a word's cell for the bytes before its first
        best, pieces = np.zeros(int((sizes + 1).sum())), np.zeros(int((sizes + 1).sum()), np.int64)
        lead = np.full(len(words), np.inf)
        lost = np.zeros(len(best), bool)  # the best way's last piece is an unknown character
        state, begin = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # words of more than t bytes
            byte = data[starts[:live] + t]
            state[:live] = self.next[state[:live], byte]
            begin[:live][(byte & 0xC0) != 0x80] = t
            last = sizes[:live] == t + 1
            after = data[np.minimum(starts[:live] + t + 1, len(data) - 1)]
            at = np.flatnonzero(last | ((after & 0xC0) != 0x80))  # ends of characters
            cell, lone = cells[at] + t + 1, t + 1 - begin[at]
            top, many = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)
            second = np.full(len(at), -np.inf)
            single = np.zeros(len(at), bool)
            out, here = self.longest[state[at]], np.arange(len(at))
            while True:
                some = out > 0
                if not some.all():
                    out, here = out[some], here[some]
                if not len(out):
                    break
                length = self.depth[out]
                source = cell[here] - length
                value = best[source] + self.score[out]
                better = value > top[here]
                second[here] = np.maximum(second[here], np.minimum(value, top[here]))
                top[here[better]] = value[better]
                many[here[better]] = pieces[source[better]] + 1
                single[here[length == lone[here]]] = True
                out = self.shorter[out]
            u = np.flatnonzero(~single)
            if len(u):
                source = cell[u] - lone[u]
                value = best[source] + self.unknown
                better = value > top[u]
                second[u] = np.maximum(second[u], np.minimum(value, top[u]))
                top[u[better]] = value[better]
                many[u[better]] = (pieces[source] + (lone[u] if self.byte_fallback else ~lost[source]))[better]
                lost[cell[u[better]]] = True
            best[cell], pieces[cell] = top, many
            lead[at] = np.minimum(lead[at], top - second)
        score, n, least = np.zeros(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words))
        score[order], n[order], least[order] = best[cells + sizes], pieces[cells + sizes], lead
        return score, n, least

    def count_long(self, word: bytes) -> tuple[float, int]:
        """The same for one long word, without arrays."""
        step, longest, shorter, depth, score = (memoryview(np.ascontiguousarray(x)) for x in (self.next.reshape(-1), self.longest, self.shorter, self.depth, self.score))
        best, pieces = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
        lost = bytearray(len(word) + 1)
        state = begin = 0
        for t, byte in enumerate(word, 1):
            state = step[state * 256 + byte]
            if byte & 0xC0 != 0x80:
                begin = t - 1
            if t < len(word) and word[t] & 0xC0 == 0x80:
                continue
            top, many, single = float("-inf"), 0, False
            out = longest[state]
            while out:
                source = t - depth[out]
                if (value := best[source] + score[out]) > top:
                    top, many = value, pieces[source] + 1
                single = single or source == begin
                out = shorter[out]
            if not single and (value := best[begin] + self.unknown) > top:
                top, many = value, pieces[begin] + (t - begin if self.byte_fallback else not lost[begin])
                lost[t] = 1
            best[t], pieces[t] = top, many
        return best[-1], pieces[-1]


def read_vocabulary(model: str) -> tuple[bool, list[tuple[str, float]], bool]:
    """Whether words are cut before each U+2581, the pieces with their scores, and whether unknown characters become bytes."""
    if not model.endswith(".json"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]
        return False, pieces, {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
    with open(model, encoding="utf-8") as f:
        held = json.load(f)
    cut, normal = held.get("pre_tokenizer"), held.get("normalizer")
    spaces = [{"type": "Prepend", "prepend": SPACE}, {"type": "Replace", "pattern": {"String": " "}, "content": SPACE}]
    marks_words = cut and cut["type"] == "Metaspace" and cut.get("split", True) and cut.get("prepend_scheme") == "always" and not normal
    if held["model"]["type"] != "Unigram" or not (marks_words or not cut and normal and normal.get("normalizers") == spaces):
        raise ValueError("the file must have a Unigram model, and write spaces as U+2581 by a splitting Metaspace pre-tokenizer or by Prepend and Replace")
    pieces = [(p, float(v)) for p, v in held["model"]["vocab"]]
    return cut is not None, pieces, bool(held["model"].get("byte_fallback")) and {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}


class Counter:
    """Counts texts, with a bounded cache of words."""

    CACHE = 400_000

    def __init__(self, model: str) -> None:
        self.split, self.pieces, byte_fallback = read_vocabulary(model)
        self.automaton = Automaton(self.pieces, byte_fallback)
        self.whole = all(v == int(v) for _, v in self.pieces)
        self.cuts = (byte_fallback or any(p == SPACE for p, _ in self.pieces)) and not any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.score, self.n, self.lead = np.zeros(0), np.zeros(0, np.int64), np.zeros(0)

    def words(self, text: str) -> list[str]:
        """The words whose best pieces together are the text's."""
        if not text:
            return []
        if self.split:
            marked = text.replace(" ", SPACE)
            return [SPACE + w for w in (marked[1:] if marked[0] == SPACE else marked).split(SPACE)]
        if not self.cuts or SPACE in text:
            return [SPACE + text.replace(" ", SPACE)]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        out, spaces = [], 0
        for part in text.split(" "):
            spaces += 1
            if part:
                out.append(part if spaces == 1 else SPACE * spaces + part)
                spaces = 0
        if spaces:
            out.append(SPACE * spaces)
        return out

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token count and score of each text."""
        if len(self.known) > self.CACHE:
            self._clear()
        cut = [self.words(t) for t in texts]
        flat = [w for c in cut for w in c]
        new = list({w for w in flat if w not in self.known})
        if new:
            coded = [(w if w[0] == SPACE else SPACE + w).encode() for w in new]
            score, n, lead = np.zeros(len(new)), np.zeros(len(new), np.int64), np.zeros(len(new))
            short = [i for i, w in enumerate(coded) if len(w) <= LONG]
            score[short], n[short], lead[short] = self.automaton.count([coded[i] for i in short])
            for i, w in enumerate(coded):
                if len(w) > LONG:
                    score[i], n[i] = self.automaton.count_long(w)
            for k, w in enumerate(new, len(self.n)):
                self.known[w] = k
            self.score, self.n, self.lead = np.concatenate([self.score, score]), np.concatenate([self.n, n]), np.concatenate([self.lead, lead])
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        for w in new:  # long words aren't kept
            if len(w) > 64:
                del self.known[w]
        ends = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        n, score = (np.diff(np.concatenate(([0], np.cumsum(x[at])))[ends]) for x in (self.n, self.score))
        if not self.whole and not self.split:
            some = np.flatnonzero(np.diff(ends) > 1)
            least = np.minimum.reduceat(np.append(self.lead[at], np.inf), ends[some]) if len(some) else np.zeros(0)
            for i in some[least <= MARGIN * (1 + np.abs(score[some]))].tolist():
                score[i], n[i] = self.automaton.count_long((SPACE + texts[i].replace(" ", SPACE)).encode())
        return n, score


_counters: dict[str, Counter] = {}


def counter(model: str) -> Counter:
    """The worker's counter; it stays from task to task."""
    if model not in _counters:
        _counters[model] = Counter(model)
    return _counters[model]


def count_tokens(docs: DataFrame, *, keys: list[str], text: str = "text", model: str | None = None) -> DataFrame:
    """keys, n_tokens and score of every row."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select(F.struct(*(F.col(textio.quoted(k)).alias(f"k{i}") for i, k in enumerate(keys))).alias("_keys"), F.col(textio.quoted(text)).alias("_text"))
    schema = T.StructType([docs.schema["_keys"], T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for batch in batches:
            column = batch.column(1)
            _, offsets = textio.utf8(column)
            for i, j in textio.pieces(offsets):
                n, score = own.count([t or "" for t in column.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(score)], names=schema.names)

    return docs.mapInArrow(run, schema).select(*(F.col(f"_keys.k{i}").alias(k) for i, k in enumerate(keys)), "n_tokens", "score")


def op10_unigram_viterbi(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), keys=["doc_id"])
