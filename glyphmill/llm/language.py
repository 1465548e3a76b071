"""Language ID by cross-parsing entropy.

For each language a bounded sample of its labelled text (CHARS characters for all languages together, shared out
evenly, at most MOST_CHARS each) becomes a suffix automaton: the automaton that accepts exactly the substrings
of that text. The sample is windows cut out of texts of any length. A text is parsed by each automaton into greedy longest matches. A
phrase is a place in the sample, so it costs as many bits as the sample's length has; phrases are normalised by that, since larger samples
give longer ones. The language with the fewest bits wins, ties to the language that sorts first.

Automata are dense tables: a missing transition holds, negated, where the parse restarts from the root. Texts are
cut into blocks of BLOCK characters that end a phrase, and all blocks of a slice walk all automata in lockstep,
one numpy step a character. Whole texts are parsed.

Characters are lower-cased; everything that is not a letter is one space. Every letter of the samples is a symbol of
its own: transitions of the commonest SYMBOLS are in the dense tables, all others in one sorted list of (state, symbol).
Letters that no sample has are a phrase of their own.

Cases. Null and empty texts, and those with no letter: `und`, score 0. Null lang: teaches nothing. Null doc_id: held
out. No labelled text at all: `und`. Repeated rows: predicted alike. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.learning import held_out
from glyphmill.llm.shared import frugal, lean, written

CHARS, MOST_CHARS = 160_000, 24_000
SYMBOLS = 56
BLOCK = 256
_SPACE, _OTHER, _PAD = 0, SYMBOLS + 1, SYMBOLS + 2
_WIDTH = SYMBOLS + 3
#: States that walk at once; more languages than fit walk one group after the other.
_AT_ONCE = 4_000_000


class SuffixAutomaton:
    """Transitions of the automaton of all substrings of a sequence of symbols."""

    def __init__(self, symbols: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:  # q stands for matches of two lengths: part them
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now

    def table(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Row of states by symbol: the next state, or ~(state after a restart with that symbol); and (state, symbol, next state) of rarer symbols.

        One more state, the last, stands for a symbol the sample lacks: a phrase of its own that nothing continues.
        """
        n = len(self.next)
        out = np.full((n + 1, _WIDTH), ~n, np.int32)
        for c, to in self.next[0].items():
            if c < _WIDTH:
                out[:, c] = ~to
        out[0] = n  # at a start no phrase ends
        rare = []
        for state, row in enumerate(self.next):
            for c, to in row.items():
                if c < _WIDTH:
                    out[state, c] = to
                else:
                    rare.append((state, c, to))
        out[:, _PAD] = np.arange(n + 1)
        return out, rare


class Parser:
    """The automata of all languages in one table."""

    def __init__(self, samples: dict[str, str]) -> None:
        counts = Counter(c for text in samples.values() for c in text.lower() if c.isalpha())
        self.symbols = {c: i + 1 if i < SYMBOLS else i - SYMBOLS + _WIDTH for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
        self.languages = sorted(samples)
        self._codes = None
        self.size = max(self.symbols.values(), default=0) + 1
        tables, rare, self.roots, self.ends, base = [], [], [], [], 0
        #: Bits of a phrase of each language.
        self.bits = np.log2([max(4, len(samples[k])) for k in self.languages])
        for language in self.languages:
            lower = np.frombuffer(samples[language].lower().encode("utf-32-le"), np.uint32)
            one, others = SuffixAutomaton(self._squeeze(self.codes[lower]).tolist()).table()
            one = np.where(one >= 0, one + base, one - base)
            tables.append(one)
            rare += [((state + base) * self.size + c, to + base) for state, c, to in others]
            self.roots.append(base)
            base += len(one)
            self.ends.append(base - 1)
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        rare.sort()
        self.rare = np.array([k for k, _ in rare], np.int64)
        self.rare_to = np.array([to for _, to in rare], np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_codes": None}

    @property
    def codes(self) -> np.ndarray:
        """Symbol of each code point."""
        if self._codes is None:
            letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
            self._codes = np.where(letters, _OTHER, _SPACE).astype(np.int32)
            self._codes[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        return self._codes

    @staticmethod
    def _squeeze(symbols: np.ndarray) -> np.ndarray:
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != _SPACE) | (symbols[:-1] != _SPACE)
        return symbols[keep]

    def _step(self, state: np.ndarray, symbols: np.ndarray, roots: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the dense tables hold for common symbols, for rarer ones."""

        def look(at: np.ndarray, none: np.ndarray) -> np.ndarray:
            keys = at * np.int64(self.size) + symbols
            place = np.minimum(np.searchsorted(self.rare, keys), len(self.rare) - 1)
            return np.where(self.rare[place] == keys, self.rare_to[place], none)

        start = look(roots, ends)
        return look(state, np.where(state == roots, start, ~start))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by each language, and the text's letters."""
        parts, letters = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            symbols = self._squeeze(self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)])
            letters[i] = np.count_nonzero(symbols != _SPACE)
            parts.append(symbols if letters[i] else symbols[:0])
        sizes = np.array([len(p) for p in parts])
        blocks = -(-sizes // BLOCK)
        lanes = int(blocks.sum())
        out = np.zeros((len(self.languages), len(texts)))
        if not lanes or not self.languages:
            return out, letters
        grid = np.full(lanes * BLOCK, _PAD, np.int32)
        begin = np.concatenate([[0], np.cumsum(blocks)]) * BLOCK
        for p, at in zip(parts, begin.tolist(), strict=False):
            grid[at : at + len(p)] = p
        columns = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
        owner = np.repeat(np.arange(len(texts)), blocks)
        group = max(1, _AT_ONCE // lanes)
        for first in range(0, len(self.languages), group):
            k = len(self.roots[first : first + group])
            roots, ends = (np.repeat(np.array(x[first : first + group], np.int32), lanes) for x in (self.roots, self.ends))
            state = roots
            count = np.zeros(k * lanes, np.int32)
            for step in columns:
                rare = np.flatnonzero(step > _PAD)
                common = np.minimum(step, _PAD) if len(rare) else step
                to = self.table[state * np.int32(_WIDTH) + np.tile(common, k)]
                if len(rare):
                    at = (np.arange(k)[:, None] * lanes + rare).ravel()
                    to[at] = self._step(state[at], np.tile(step[rare], k), roots[at], ends[at])
                sign = to >> 31
                count -= sign
                state = to ^ sign
            count += 1  # the phrase that the block's end closes
            for row, counts in zip(out[first : first + k], count.reshape(k, lanes), strict=True):
                row += np.bincount(owner, counts, len(texts))
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        phrases, letters = self.phrases(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        cost = np.maximum(phrases, 1) * self.bits[:, None]
        best = cost.argmin(axis=0)
        ease = (cost.min(axis=0) / cost) ** 4
        score = np.where(letters > 0, ease.max(axis=0) / ease.sum(axis=0), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score


def fit(documents: DataFrame) -> Parser:
    """Automata from windows of the documents outside the held-out fold, chosen by a hash, until a language has its share of CHARS."""
    draw = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(1 << 30))
    known = documents.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out()).select("lang", "text", F.col("doc_id").cast("long").alias("id"), F.length("text").alias("n"))
    found = written(known.groupBy("lang").agg(F.sum("n").alias("chars"), F.min(draw("id")).alias("least")), "languages")
    share = max(1, min(MOST_CHARS, CHARS // max(1, found.count())))
    window = min(share, max(BLOCK, share // 16))
    # About twice the share of each language is read, so that copies may be left out; its first document is read in any case.
    part = draw("id", "at") < (1 << 30) * (2.0 * share + 16 * window) / F.col("chars")
    windows = known.join(F.broadcast(found), "lang").withColumn("at", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / window))))
    windows = windows.where(part | (F.col("at") == 0) & (draw("id") == F.col("least"))).select("lang", F.substring("text", F.col("at").cast("int") * window + 1, F.lit(window)).alias("text"))
    samples: dict[str, list[str]] = {}
    for r in windows.distinct().orderBy("lang", F.xxhash64("text")).toLocalIterator():
        own = samples.setdefault(r.lang, [])
        if sum(map(len, own)) < share:
            own.append(r.text)
    return Parser({k: " ".join(v) for k, v in samples.items()})


def identified(documents: DataFrame, parser: Parser) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = [], 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                if sum(map(len, texts[-1:])) + (i - at) * 2000 > 1_000_000 or i + 1 == batch.num_rows:
                    names, scores = parser.predict(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])
                    texts, at = [], i + 1

    return lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(documents, fit(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
