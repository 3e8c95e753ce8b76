"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. Parsing a text by longest matches against it gives
c phrases; c * log2(n) / length (n: size of the labelled text) is the cross-parsing entropy per letter, and the
language with the lowest wins. Letters are lower-cased; every run of other characters is one space. The commonest letters of the labelled
text have a symbol each, every other one of its letters a code of several symbols of its own; lengths are counted in symbols. Letters that
the labelled text lacks share a symbol that matches nothing.

The automata become one dense table whose entry for (state, symbol) holds the next state after restarting where the match
ends, and how many phrases ended. So all texts of a batch advance together, one symbol of each at a time. Texts over `segment` symbols are
parsed in pieces side by side, each as if it began a text; then every piece runs again from the state in which the one before it
ended, until it meets its first run, and its phrases are counted anew up to there. The outcome is that of the whole text.

The fit reads a bounded sample: of each language at most 2 * `docs_per_lang` labelled rows in the order of a hash of the row, at
most `excerpt` characters of each row, and `total_chars` over all languages in equal shares (`least_chars` each where there are
many), so that the table grows with the number of languages alone. Prediction reads whole texts and nothing but texts.

Defined results: null texts and texts without a letter give `und` with score 0; ties go to the language that sorts first; without
labelled rows everything is `und`; repeated rows get equal results; an empty table gives no rows; input columns named
lang_pred or score are replaced, all others kept. score is the runner-up's share of the two lowest entropies
(0.5: undecided; 1 where only one language is known).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.common import release_memory, small_batches

SPACE, OTHER, FIRST = 0, 1, 2


BASE = 16  # symbols for each digit of a letter's code; each place has its own, so that codes match as a whole or in their first digits


@dataclass
class Alphabet:
    """letters: for each code point SPACE, OTHER, a symbol of its own, or, from `rare` on, the number of a code of `digits` symbols."""

    letters: np.ndarray
    rare: int
    digits: int

    @property
    def width(self) -> int:
        return self.rare + BASE * self.digits


@dataclass
class Model:
    langs: list[str]
    bits: np.ndarray  # log2 of each language's labelled size
    roots: np.ndarray
    table: np.ndarray  # (states, symbols): next state * 4 + phrases that end
    alphabet: Alphabet


def _alphabet(texts: list[str], common: int) -> Alphabet:
    """Letters get what their lower case has."""
    counts = Counter(c for t in texts for c in t if c.isalpha())
    own = {c: FIRST + i for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    letters = np.zeros(0x110000, np.uint32)
    for p in range(len(letters)):
        if (c := chr(p)).isalpha():
            letters[p] = own.get(c.lower()[0], OTHER)
    rare, digits = FIRST + min(common, len(own)), 0
    while len(own) > common and BASE**digits < len(own) - common:
        digits += 1
    return Alphabet(letters, rare, max(digits, int(len(own) > common)))


def _read(text: str, alphabet: Alphabet) -> np.ndarray:
    """Symbols of a text, each run of spaces as one."""
    s = alphabet.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    s = s[keep]
    coded = s >= alphabet.rare
    if not coded.any():
        return s.astype(np.uint8)
    sizes = np.where(coded, alphabet.digits, 1)
    out = np.repeat(s, sizes)
    place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.minimum(place, alphabet.digits - 1)
    digit = (out.astype(np.int64) - alphabet.rare) // BASE ** (alphabet.digits - 1 - place) % BASE
    return np.where(np.repeat(coded, sizes), alphabet.rare + BASE * place + digit, out).astype(np.uint8)


def _automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions (states, width) of the suffix automaton, -1 where there is none."""
    most = 2 * len(symbols) + 2
    go, link, length = np.full((most, width), -1, np.int32), [-1], [0]
    count, last = 1, 0
    for c in symbols:
        cur, count = count, count + 1
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and go[p, c] < 0:
            go[p, c] = cur
            p = link[p]
        if p != -1:
            q = int(go[p, c])
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy, count = count, count + 1
                length.append(length[p] + 1)
                link.append(link[q])
                go[copy] = go[q]
                while p != -1 and go[p, c] == q:
                    go[p, c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return go[:count]


def build(samples: dict[str, list[str]], letters: int = 40) -> Model:
    """A model of labelled texts by language; `letters` of them have a symbol each, the rest codes."""
    langs = sorted(samples)
    lowered = {k: [t.lower() for t in samples[k]] for k in langs}
    alphabet = _alphabet([t for k in langs for t in lowered[k]], letters)
    width = alphabet.width
    tables, roots, bits, base = [], [], [], 0
    for k in langs:
        text = " ".join(lowered[k])
        read = _read(text, alphabet)[: len(text)]  # codes do not make the table larger
        go = _automaton(read.tolist(), width)
        restart = go[0]  # after a failed match the symbol starts the next phrase
        known = restart >= 0
        open_ = (np.arange(len(go)) > 0).astype(np.int32)[:, None]  # a phrase that a failure ends; an unknown symbol is one of its own
        failed = np.where(known[None, :], (restart[None, :] + base) * 4 + open_, base * 4 + open_ + 1)
        step = np.where(go >= 0, (go + base) * 4, failed).astype(np.int32)
        tables.append(step)
        roots.append(base)
        bits.append(np.log2(max(2, len(read))))
        base += len(go)
    table = np.concatenate(tables) if tables else np.zeros((1, width), np.int32)
    return Model(langs, np.array(bits), np.array(roots, np.int64), table, alphabet)


def entropies(model: Model, texts: list[str], segment: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(texts, languages) bits per symbol, and which texts have a letter."""
    reads = [_read(t, model.alphabet) for t in texts]
    lettered = np.array([bool((r != SPACE).any()) for r in reads])
    lengths = np.array([len(r) for r in reads], np.int64)
    pieces = -(-lengths // segment)
    owner = np.repeat(np.arange(len(texts)), pieces)
    width, n = model.table.shape[1], len(model.langs)
    phrases = np.zeros((len(texts), n))
    if not len(owner) or not n:
        return phrases, lettered
    segment = min(segment, int(lengths.max()))
    grid = np.zeros((len(owner), segment), np.uint8)
    size = np.full(len(owner), segment, np.int64)
    at = 0
    for r, k in zip(reads, pieces.tolist(), strict=True):
        if k:
            grid[at : at + k].reshape(-1)[: len(r)] = r
            size[at + k - 1] = len(r) - (k - 1) * segment
            at += k
    follows, final = np.r_[False, owner[1:] == owner[:-1]], np.r_[owner[1:] != owner[:-1], True]
    flat, roots = model.table.reshape(-1), model.roots[:, None]
    order = np.argsort(-size, kind="stable")
    sorted_, by_size = np.ascontiguousarray(grid[order].T), size[order]
    state, ended = np.tile(roots, (1, len(owner))), np.zeros((n, len(owner)), np.int64)
    for k in range(int(by_size[0])):
        live = int(np.searchsorted(-by_size, -k, side="left"))  # those longer than k
        x = flat[state[:, :live] * width + sorted_[k, :live]]
        ended[:, :live] += x & 3
        state[:, :live] = x >> 2
    state[:, order], ended[:, order] = state.copy(), ended.copy()
    # Pieces that follow another begin in its last state; from where both runs are in one state they are the same.
    first, todo, more = state.copy(), np.flatnonzero(follows), np.zeros_like(ended)
    while len(todo):
        a, b = np.tile(roots, (1, len(todo))), state[:, todo - 1].copy()
        gain = np.zeros_like(a)
        apart = np.arange(len(todo))
        for k in range(segment):
            apart = apart[((a[:, apart] != b[:, apart]).any(axis=0)) & (size[todo[apart]] > k)]
            if not len(apart):
                break
            symbol = grid[todo[apart], k]
            x, y = flat[a[:, apart] * width + symbol], flat[b[:, apart] * width + symbol]
            gain[:, apart] += (y & 3) - (x & 3)
            a[:, apart], b[:, apart] = x >> 2, y >> 2
        more[:, todo] = gain
        met = (a == b).all(axis=0)
        now = np.where(met, first[:, todo], b)
        changed = (now != state[:, todo]).any(axis=0)
        state[:, todo] = now
        todo = todo[changed & ~final[todo]] + 1
    ended += more + np.where(final[None, :], state != roots, False)
    for j in range(n):
        phrases[:, j] = np.bincount(owner, ended[j], len(texts))
    return phrases * model.bits[None, :] / np.maximum(lengths, 1)[:, None], lettered


def sample(labelled: DataFrame, docs_per_lang: int = 300, excerpt: int = 1000, total_chars: int = 120_000, least_chars: int = 500) -> dict[str, list[str]]:
    """Excerpts by language of labelled rows (doc_id, text, lang). Only the bounded sample described above reaches the driver."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1_000_000_007)) / 1_000_000_007
    held = rows.withColumn("draw", draw).join(F.broadcast(counts), "lang")  # one row a language
    held = held.where(F.col("draw") < F.lit(float(docs_per_lang)) / F.col("n"))
    held = held.select("lang", "draw", F.substring("text", 1, excerpt).alias("text")).where(F.length(F.trim("text")) > 0).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))  # of the sample: some docs_per_lang rows of a language
    held = held.withColumn("nth", nth).where(F.col("nth") <= 2 * docs_per_lang)
    each = max(least_chars, total_chars // max(1, counts.count()))
    samples: dict[str, list[str]] = {}
    used: Counter = Counter()
    for r in held.sort("lang", "nth").toLocalIterator():
        if used[r["lang"]] < each:
            samples.setdefault(r["lang"], []).append(r["text"][: each - used[r["lang"]]])
            used[r["lang"]] += len(r["text"])
    return {k: v for k, v in samples.items() if any(c.isalpha() for t in v for c in t)}


def fit(labelled: DataFrame, **bounds: int) -> Model:
    """A model of labelled rows (doc_id, text, lang), of which sample() takes a bounded part."""
    return build(sample(labelled, **bounds))


def predict(docs: DataFrame, model: Model, segment: int = 4096, batch_chars: int = 4_000_000) -> DataFrame:
    """docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    keep = docs.drop("lang_pred", "score")
    names = keep.columns
    at_text = [c.lower() for c in names].index("text")
    keep = keep.toDF(*[f"c{k}" for k in range(len(names))])  # names may hold dots
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as sample()'s characters allow

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        m = shared.value
        h, lettered = entropies(m, [t or "" for t in texts], segment)
        if not m.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = h.argmin(1)
        low = np.sort(h, 1)
        score = low[:, 1] / np.maximum(low[:, 0] + low[:, 1], 1e-300) if len(m.langs) > 1 else np.ones(len(texts))
        return [m.langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, score, 0.0).tolist()

    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < batch_chars):
                    chars += len(texts[end] or "")
                    end += 1
                langs, scores = judge(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])
                at = end
        release_memory()

    return keep.mapInArrow(run, schema).toDF(*names, "lang_pred", "score")
