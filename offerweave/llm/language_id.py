"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's score under
a language is the sum over all its segmentations into pieces of the product of their
probabilities, which a forward pass over the whole word gives, however long; a text's score is the
product over its words. The probabilities are fitted by expectation maximisation over the same
lattice, on a bounded sample of labelled texts (there words over PART bytes count as several).

Distinct words are scored once for each slice of a partition, all together as arrays. Nothing is
shuffled but the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerweave.llm import packed, words

SLICE = 4_000_000
#: The sample that the model is fitted on: texts of each language, and bytes a text may have.
SAMPLE, SAMPLE_BYTES = 600, 16_384
ROUNDS = 3
#: Words of up to so many bytes are scored together as arrays, longer ones one by one; the model is
#: fitted on parts of at most so many bytes.
PART = 32
SMOOTH = 0.1
NONE = "und"

_OTHER = np.ones(256, bool)
_OTHER[0x61:0x7B] = _OTHER[0x41:0x5B] = _OTHER[0x80:] = False
_B = np.uint64(0x9E3779B97F4A7C15)
_LEAD = np.zeros(256, np.int8)  # bytes of the character that a byte begins
_LEAD[:0x80], _LEAD[0xC0:0xE0], _LEAD[0xE0:0xF0], _LEAD[0xF0:] = 1, 2, 3, 4


def vocabulary(path: str) -> list[bytes]:
    """Text pieces of a sentencepiece model, a word's begin as a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in found if p)


class Lattice:
    """Pieces at each place of many words at once. The piece after the last stands for one
    character that the vocabulary lacks."""

    def __init__(self, pieces: list[bytes]):
        self.unknown, self.longest = len(pieces), max(map(len, pieces), default=1)
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            v = 0
            for b in p:
                v = (v * int(_B) + b + 1) % (1 << 64)
            h[i] = v
        # tables of about sixteen slots a piece; what finds its slot taken goes to the next table
        self.tables, left = [], np.arange(len(pieces))
        while len(left):
            bits = np.uint64(64 - max(6, int(len(left) * 16).bit_length()))
            slot = (packed.mix(h[left] + np.uint64(len(self.tables))) >> bits).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            piece, hashes = np.full(1 << (64 - int(bits)), -1, np.int32), np.zeros(1 << (64 - int(bits)), np.uint64)
            piece[slot[first]], hashes[slot[first]] = left[first], h[left[first]]
            self.tables.append((bits, piece, hashes))
            left = np.delete(left, first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        for i, (bits, piece, hashes) in enumerate(self.tables):
            slot = packed.mix(h + np.uint64(i)) >> bits
            hit = hashes[slot] == h
            out[hit] = piece[slot[hit]]
        return out

    def edges(self, parts: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """(lengths, [(start, end, words, pieces)]), by start and end."""
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(size.max(initial=0))
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
        out = []
        for s in range(width):
            h = np.zeros(len(parts), np.uint64)
            lead = _LEAD[text[:, s]]
            alone = np.zeros(len(parts), bool)
            for n in range(1, min(self.longest, width - s) + 1):
                h = h * _B + (text[:, s + n - 1].astype(np.uint64) + np.uint64(1))
                w = np.flatnonzero((lead > 0) & (s + n <= size))
                piece = self.find(h[w])
                w, piece = w[piece >= 0], piece[piece >= 0]
                if len(w):
                    alone[w] |= lead[w] == n
                    out.append((s, s + n, w, piece))
            for n in (1, 2, 3, 4):
                w = np.flatnonzero(~alone & (lead == n) & (s < size))
                if len(w):  # a character cut off at the end counts as whole
                    to = np.minimum(s + n, size[w])
                    for e in np.unique(to):
                        own = w[to == e]
                        out.append((s, int(e), own, np.full(len(own), self.unknown, np.int32)))
        return size, out

    def forward(self, size, edges, prob: np.ndarray) -> np.ndarray:
        """alpha[place, word, language]."""
        alpha = np.zeros((int(size.max(initial=0)) + 1, len(size), prob.shape[1]))
        alpha[0] = 1
        for s, e, w, p in edges:
            alpha[e, w] += alpha[s, w] * prob[p]
        return alpha

    def score(self, parts: list[bytes], prob: np.ndarray) -> np.ndarray:
        """Log-probability of each word under each language."""
        out = np.empty((len(parts), prob.shape[1]))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        for i in order[np.searchsorted(lengths[order], PART, "right") :].tolist():
            out[i] = self.score_long(parts[i], prob)
        order = order[: np.searchsorted(lengths[order], PART, "right")]
        for at in range(0, len(order), 20_000):
            some = order[at : at + 20_000]
            size, edges = self.edges([parts[i] for i in some])
            alpha = self.forward(size, edges, prob)
            out[some] = np.log(np.maximum(alpha[size, np.arange(len(some))], 1e-290))
        return out

    def pieces_of(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all pieces in a word, by start."""
        text = np.frombuffer(word, np.uint8)
        lead = _LEAD[text]
        begin = np.flatnonzero(lead > 0)
        alone = np.zeros(len(text), bool)
        h, found = np.zeros(len(begin), np.uint64), []
        for n in range(1, self.longest + 1):
            on = begin + n <= len(text)
            begin, h = begin[on], h[on]
            h = h * _B + (text[begin + n - 1].astype(np.uint64) + np.uint64(1))
            piece = self.find(h)
            hit = piece >= 0
            at = begin[hit]
            alone[at] |= lead[at] == n
            found.append((at, at + n, piece[hit]))
        rest = np.flatnonzero((lead > 0) & ~alone)
        found.append((rest, np.minimum(rest + lead[rest], len(text)), np.full(len(rest), self.unknown, np.int32)))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order]

    def score_long(self, word: bytes, prob: np.ndarray) -> list[float]:
        """As score() for one word of any length: the forward pass is scaled up as it falls."""
        start, end, piece = self.pieces_of(word)
        start, end, piece = start.tolist(), end.tolist(), piece
        out = []
        for k in range(prob.shape[1]):
            alpha, log, shift = [0.0] * (len(word) + 1), 0.0, 2.0**300
            alpha[0], here = 1.0, -1
            for s, e, p in zip(start, end, prob[piece, k].tolist(), strict=True):
                if s != here:
                    here = s
                    ahead = slice(s, s + self.longest + 1)
                    if alpha[s] < 1e-60 and max(alpha[ahead]) < 1e-60:
                        alpha[ahead] = [x * shift for x in alpha[ahead]]
                        log -= 300 * np.log(2.0)
                alpha[e] += alpha[s] * p
            out.append(float(np.log(max(alpha[-1], 1e-290)) + log))
        return out

    def expect(self, parts: list[bytes], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used, by language."""
        out = np.zeros_like(prob)
        order = np.argsort(np.fromiter(map(len, parts), np.int64, len(parts)), kind="stable")
        for at in range(0, len(order), 20_000):
            some = order[at : at + 20_000]
            size, edges = self.edges([parts[i] for i in some])
            alpha = self.forward(size, edges, prob)
            beta = np.zeros_like(alpha)
            each = np.arange(len(some))
            beta[size, each] = 1
            for s, e, w, p in sorted(edges, key=lambda x: -x[0]):
                beta[s, w] += beta[e, w] * prob[p]
            scale = weight[some] / np.maximum(alpha[size, each], 1e-290)
            for s, e, w, p in edges:
                used = alpha[s, w] * prob[p] * beta[e, w] * scale[w]
                for k in range(prob.shape[1]):
                    out[:, k] += np.bincount(p, used[:, k], len(prob))
        return out


def parts_of(distinct: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """(parts, word of each part), to fit on: long words are cut between characters."""
    parts, of = [], []
    for i, w in enumerate(distinct):
        w = b" " + w
        while len(w) > PART:
            cut = PART
            while cut > 1 and w[cut] & 0xC0 == 0x80:
                cut -= 1
            parts.append(w[:cut])
            of.append(i)
            w = w[cut:]
        parts.append(w)
        of.append(i)
    return parts, np.array(of, np.int64)


class Model:
    """languages, pieces and log-probabilities. ``tokens`` is the vocabulary's path."""

    def __init__(self, languages: list[str], pieces: list[bytes], prob: np.ndarray):
        self.languages, self.pieces, self.prob = languages, pieces, prob
        self.lattice = Lattice(pieces)

    def __reduce__(self):
        return Model, (self.languages, self.pieces, self.prob)

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each text by language, whether it has a letter)."""
        data, at = packed.texts(pc.utf8_lower(column))
        starts, ends, first = words.spans(data, at, _OTHER)
        code, distinct = words.codes(data, starts, ends, _OTHER)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[0x61:0x7B] = True
        total = np.r_[0, np.cumsum(ascii_letter[data])]
        letters = total[at[1:]] > total[at[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(first) > 0)):
            letters[i] = any(c.isalpha() for c in data[at[i] : at[i + 1]].tobytes().decode())
        out = np.zeros((len(at) - 1, len(self.languages)))
        if distinct and self.languages:
            scored = self.lattice.score([b" " + w for w in distinct], self.prob)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(doc, scored[code, k], len(at) - 1)
        return out, letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        ll, letters = self.score(column)
        if not self.languages:
            return [NONE] * len(ll), np.zeros(len(ll))
        best = ll.argmax(1) if len(ll) else np.zeros(0, np.int64)
        score = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
        return [self.languages[b] if ok else NONE for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def fit(texts: list[str], langs: list[str], pieces: list[bytes], rounds: int = ROUNDS) -> Model:
    languages = sorted(set(langs))
    model = Model(languages, pieces, np.full((len(pieces) + 1, max(1, len(languages))), 1 / (len(pieces) + 1)))
    if not languages:
        return model
    data, at = packed.texts(pc.utf8_lower(pa.array(texts, pa.string())))
    starts, ends, first = words.spans(data, at, _OTHER)
    code, distinct = words.codes(data, starts, ends, _OTHER)
    k = np.repeat(np.array([languages.index(x) for x in langs]), np.diff(first))
    weight = np.bincount(k + code * len(languages), minlength=len(distinct) * len(languages)).reshape(-1, len(languages)).astype(float)
    parts, of = parts_of(distinct)
    for _ in range(rounds):
        used = model.lattice.expect(parts, weight[of], model.prob) + SMOOTH
        model.prob = used / used.sum(0)
    return model


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """_lang, _at (from 1) and _text of the ``sample`` distinct texts of each language with the least
    hashes, or all if it has fewer, among rows with a label that are not held out. Texts over
    SAMPLE_BYTES come after all others, and only their first SAMPLE_BYTES characters count.

    Distinct hashes are counted by their number of bits first. Only those up to the number that
    completes the sample are ranked, about twice the sample: a language of a third of all rows
    brings no more of them to one task than another.
    """
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), held_out(F.col(id_col)).alias("_held"))
    rows = rows.filter("not _held and _lang is not null and octet_length(_text) > 0")
    least = F.xxhash64("_text").bitwiseAND(F.lit(2**63 - 1))
    rows = rows.select("_lang", "_text", least.alias("_h"), (F.octet_length("_text") > SAMPLE_BYTES).alias("_long"))
    distinct = rows.select("_lang", "_long", "_h").distinct().withColumn("_bits", F.length(F.bin("_h")))
    counts = distinct.groupBy("_lang", "_long", "_bits").agg(F.count(F.lit(1)).alias("_n"))
    smaller = Window.partitionBy("_lang").orderBy("_long", "_bits").rowsBetween(Window.unboundedPreceding, -1)
    levels = counts.withColumn("_before", F.coalesce(F.sum("_n").over(smaller), F.lit(0))).filter(F.col("_before") < sample)
    few = distinct.join(F.broadcast(levels.drop("_n", "_before")), ["_lang", "_long", "_bits"])
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_long", "_h"))
    chosen = F.broadcast(few.withColumn("_at", place).filter(F.col("_at") <= sample).drop("_bits"))
    head = F.substring("_text", 1, SAMPLE_BYTES).alias("_text")
    return rows.join(chosen, ["_lang", "_long", "_h"]).select("_lang", "_at", head).groupBy("_lang", "_at").agg(F.min("_text").alias("_text"))


def train(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on the training texts of each language, at most ``sample`` of each."""
    got = training_texts(docs, id_col, text_col, lang_col, sample).orderBy("_lang", "_at").collect()
    return fit([r["_text"] for r in got], [r["_lang"] for r in got], vocabulary(vocab))


def held_out(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score appended (columns of those names are replaced).

    ``und`` and score 0 if the text is null, empty or has no letter. Otherwise score is the
    posterior of the language, equal ones going to the first in order of name. Each row is judged
    by its text alone, so repeated rows agree. An empty table gives no rows.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    text = f"_text_{'_' * max(len(f.name) for f in kept)}"

    def run(batches):
        for batch in batches:
            for part in packed.slices(batch, text, SLICE):
                langs, score = model.predict(part.column(text))
                own = [part.column(i) for i in range(len(kept))]
                yield pa.record_batch([*own, pa.array(langs, pa.string()), pa.array(score)], [*(f.name for f in kept), "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return packed.map_batches(docs.select(*[f.name for f in kept], F.col(text_col).alias(text)), run, out)
