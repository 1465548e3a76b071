"""Toxicity by a weighted finite-state pattern grammar.

Tokens are runs of letters and digits, A-Z lower-cased. Each gets a class: insult (a fixed list, and words
and word beginnings learned from the labels, each with a weight), threat, target, negation, report, other. Marks between
tokens are symbols as well: a break (comma, colon, bracket, quotation mark) or an end (. ; ! ? and line ends).

Transducers are tables of arcs (state, symbol) -> state. Three read forwards:

  target    remembers a target until the next break; at the start of a sentence a target with a break behind it is fronted
  negation  holds for SCOPE tokens, up to the next break
  report    holds from a reporting verb to the sentence's end, past breaks and quotation marks

and three read backwards:

  addressed  whether a target follows before the next break
  object     whether a target follows within REACH tokens
  last       whether the sentence ends next

Each direction is composed once, into one table over the reachable products of states. What a token of weight w puts out
hangs on its symbol and on both composed states: an insult is plain, targeted, negated or reported; a threat counts if
it has an object, or is the last word of a sentence whose target is fronted, and is excused if negated or reported. Only
sentences that hold an insult or a threat are read at all. A document's six sums go, as
log(1 + sum), into a logistic score whose weights are fitted, from a prior that trusts the grammar, on a bounded
sample of labelled rows (3500 clean, 1500 toxic) outside the held-out fold.

Learned words: at least LEAST contexts (preceding tokens) in toxic texts of the sample, more where chance alone could
give as many to one of the words tried, and log odds of ODDS or more
against its contexts in other texts, scaled to all labelled rows; the weight follows the log odds. Contexts are
counted once, so that copies of one text teach nothing.

Cases. Null and empty texts: no tokens, the score of the intercept. Null doc_id: held out. Repeated rows: scored
alike. No labels: the prior. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.learning import held_out, labelled_sample, logistic
from glyphmill.llm.shared import frugal, give_back, lean
from glyphmill.llm.tokens import NOT_LETTERS, Words, mix, words

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK, END = range(8)
SYMBOLS = 8
SUMS = ("plain", "targeted", "negated", "reported", "threat", "excused")
INSULTS = "idiot idiots stupid moron morons loser losers scum trash clown clowns worthless pathetic disgusting imbecile dumb fool vermin filth".split()
THREATS = "kill destroy hurt beat murder crush stab shoot töten tuer matar".split()
TARGETS = "you your yourself he she him her they them u du dich ihr euch tu te toi vous tú usted ustedes vosotros".split()
NEGATIONS = "not never no nobody isn aren wasn don didn nicht kein keine nie pas jamais nunca jamás tampoco".split()
REPORTS = "said says saying wrote writes called calls quoted told claimed sagte schrieb dit écrit dijo escribió".split()
STEMS = (4, 5, 6)
LEAST, ODDS = 6, 1.5
SCOPE, REACH = 3, 3
_PRIOR = np.array([3.6, 4.6, 1.0, 1.0, 4.6, 0.5, -3.0])
_MARKS = np.zeros(256, np.int8)
_MARKS[[ord(c) for c in ",:()[]\""]] = BREAK
_MARKS[[ord(c) for c in ".;!?\n\r"]] = END
#: Quotation marks and apostrophes beyond ASCII, which would else be letters.
_QUOTES, _APOSTROPHES = "[\u00ab\u00bb\u201c\u201d\u201e]", "[\u2018\u2019]"


class Transducer:
    """Arcs (state, symbol) -> state from state 0 on; a symbol without an arc leads where the state's default does."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], int], default: dict[int, int] | None = None) -> None:
        default = default or {}
        self.next = [[arcs.get((s, c), default.get(s, s)) for c in range(SYMBOLS)] for s in range(states)]


def _everywhere(states: int, symbols: tuple[int, ...], to: int) -> dict[tuple[int, int], int]:
    return {(s, c): to for s in range(states) for c in symbols}


def target() -> Transducer:
    """0 start of a sentence, 1 target first, 2 target seen, 3 none in sight; 4 and 5: the same two, target fronted."""
    arcs = {(0, TARGET): 1, (1, TARGET): 1, (1, BREAK): 5, (2, BREAK): 3, (3, TARGET): 2, (4, BREAK): 5, (5, TARGET): 4} | {(0, BREAK): 0} | _everywhere(6, (END,), 0)
    return Transducer(6, arcs, {0: 3, 1: 2})


def negation() -> Transducer:
    """State s: so many more tokens are negated."""
    return Transducer(SCOPE + 1, _everywhere(SCOPE + 1, (BREAK, END), 0) | _everywhere(SCOPE + 1, (NEGATION,), SCOPE), {s: max(0, s - 1) for s in range(SCOPE + 1)})


def report() -> Transducer:
    return Transducer(2, {(0, REPORT): 1, (1, END): 0})


def addressed() -> Transducer:
    return Transducer(2, {(0, TARGET): 1, (1, BREAK): 0, (1, END): 0})


def near_object() -> Transducer:
    """State s: a target stood at most REACH + 1 - s tokens ago."""
    return Transducer(REACH + 1, _everywhere(REACH + 1, (BREAK, END), 0) | _everywhere(REACH + 1, (TARGET,), REACH), {s: max(0, s - 1) for s in range(REACH + 1)})


def last() -> Transducer:
    """1 right after (before, in reading order) an end."""
    return Transducer(2, _everywhere(2, (END,), 1), {0: 0, 1: 0})


def compose(machines: list[Transducer]) -> tuple[list[list[int]], list[tuple[int, ...]]]:
    """One table of arcs over the reachable products of the machines' states, and the product each of its states stands for."""
    products, table = [tuple(0 for _ in machines)], []
    number = {products[0]: 0}
    for product in products:  # grows as new products are reached
        row = []
        for c in range(SYMBOLS):
            to = tuple(m.next[s][c] for m, s in zip(machines, product, strict=True))
            if to not in number:
                number[to] = len(products)
                products.append(to)
            row.append(number[to])
        table.append(row)
    return table, products


def outputs(forwards: list[tuple[int, ...]], backwards: list[tuple[int, ...]]) -> dict[int, list[list[int]]]:
    """For insults and threats: by both composed states, the sum that the token's weight goes to, or -1."""
    insult = [[3 if r else 2 if n else 1 if t in (1, 2, 4) or a else 0 for a, _, _ in backwards] for t, n, r in forwards]
    threat = [[(5 if r or n else 4) if o or (e and t in (4, 5)) else -1 for _, o, e in backwards] for t, n, r in forwards]
    return {INSULT: insult, THREAT: threat}


def flat(texts: pa.Array) -> pa.Array:
    """Texts with quotation marks and apostrophes beyond ASCII replaced by those of ASCII."""
    texts = texts.cast(pa.large_string())
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, _QUOTES, '"'), _APOSTROPHES, "'")


def _keys(w: Words) -> list[np.ndarray]:
    """Hashes of whole tokens and of their beginnings, apart from each other by length."""
    return [w.hashes(fold=True)] + [w.hashes(fold=True, first_bytes=k) ^ np.uint64(k) for k in STEMS]


def _fixed(tokens: list[str]) -> np.ndarray:
    _, w = next(words(pa.array([" ".join(tokens)]), gaps=NOT_LETTERS))
    return w.hashes(fold=True)


class Grammar:
    """The lexicon as one hash table, and the composed transducers."""

    forth, _forwards = compose([target(), negation(), report()])
    back, _backwards = compose([addressed(), near_object(), last()])
    out = outputs(_forwards, _backwards)

    def __init__(self, learned: dict[int, float], beta: np.ndarray) -> None:
        table = {int(h): (c, 1.0) for c, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for h in _fixed(names)}
        table |= {int(h): (c, 1.0) for c, names in ((THREAT, THREATS), (INSULT, INSULTS)) for h in _fixed(names)}
        table |= {h: (INSULT, v) for h, v in learned.items() if table.get(h, (INSULT,))[0] == INSULT}
        self.hashes = np.array(sorted(table), np.uint64)
        self.classes = np.array([table[int(h)][0] for h in self.hashes], np.int8)
        self.weights = np.array([table[int(h)][1] for h in self.hashes])
        self.beta = beta
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def classify(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each token; the first of word, long beginning, short beginning that is listed."""
        keys = _keys(w)
        kind, weight = np.zeros(len(w.starts), np.int8), np.zeros(len(w.starts))
        for h in (*keys[1:], keys[0]):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            true = self.hashes[place] == h[at]
            kind[at[true]], weight[at[true]] = self.classes[place[true]], self.weights[place[true]]
        return kind, weight

    def read(self, symbols: list[int], weights: list[float], out: list[float]) -> None:
        """Add what one sentence puts out to the six sums."""
        ahead, state, at = [0] * len(symbols), self.back[0][END], len(symbols)
        for c in reversed(symbols):
            at -= 1
            ahead[at] = state
            state = self.back[state][c]
        state = 0
        for c, w, b in zip(symbols, weights, ahead, strict=True):
            if c == INSULT or c == THREAT:
                place = self.out[c][state][b]
                if place >= 0:
                    out[place] += w
            state = self.forth[state][c]

    def sums(self, w: Words) -> np.ndarray:
        """The six sums of each text of a slice."""
        out = np.zeros((len(w.first) - 1, len(SUMS)))
        if not len(w.starts):
            return out
        kind, weight = self.classify(w)
        marks = _MARKS[w.raw]
        ends = np.concatenate([[0], np.cumsum(marks == END)])
        sentence = ends[w.starts] + np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))  # a new text is a new sentence
        hit = np.flatnonzero((kind == INSULT) | (kind == THREAT))
        own = np.unique(sentence[hit])
        los, his = np.searchsorted(sentence, own, "left"), np.searchsorted(sentence, own, "right")
        breaks = np.concatenate([[0], np.cumsum(marks == BREAK)])
        after = np.zeros(len(kind), bool)  # a break stands before this token
        after[1:] = breaks[w.starts[1:]] > breaks[w.ends[:-1]]
        for lo, hi, doc in zip(los.tolist(), his.tolist(), (np.searchsorted(w.first, los, "right") - 1).tolist(), strict=True):
            symbols, weights = kind[lo:hi], weight[lo:hi]
            at = np.flatnonzero(after[lo + 1 : hi]) + 1
            if len(at):
                symbols, weights = np.insert(symbols, at, BREAK), np.insert(weights, at, 0.0)
            self.read(symbols.tolist(), weights.tolist(), out[doc])
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.log1p(sums) @ self.beta[:-1] + self.beta[-1])))


def learned_words(texts: list[str], y: np.ndarray, scale: float) -> dict[int, float]:
    """Hash of each learned word or beginning, with its weight. scale: rows that a clean text stands for against a toxic one."""

    def read(own: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and contexts, slice by slice. A context is the token before; of a beginning, with the whole word."""
        for _, w in words(flat(pa.array(own, pa.string())), most=1 << 18, gaps=NOT_LETTERS):
            whole = w.hashes(fold=True)
            before = np.zeros(len(whole), np.uint64)
            before[1:] = whole[:-1]
            yield (w.hashes(fold=True, first_bytes=k) ^ np.uint64(k), mix(before ^ mix(whole))) if k else (whole, before)

    def counted(h: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes and the number of contexts of each."""
        _, index = np.unique(mix(context) ^ h, return_index=True)
        return np.unique(h[index], return_counts=True)

    bad, good = ([t for t, v in zip(texts, y, strict=True) if (v > 0) == side] for side in (True, False))
    out: dict[int, float] = {}
    for k in (0, *STEMS):
        toxic = list(read(bad, k))
        if not toxic:
            return {}
        names, seen = counted(np.concatenate([h for h, _ in toxic]), np.concatenate([c for _, c in toxic]))
        often = seen >= LEAST
        tried, total = len(names), sum(len(h) for h, _ in toxic)
        names, seen = names[often], seen[often]
        if not len(names):
            continue
        kept, other = [], 0
        for h, context in read(good, k):  # of clean texts only what is in question is kept
            other += len(h)
            place = np.minimum(np.searchsorted(names, h), len(names) - 1)
            same = names[place] == h
            kept.append((h[same], context[same]))
        clean = np.zeros(len(names))
        if kept:
            found, n = counted(np.concatenate([h for h, _ in kept]), np.concatenate([c for _, c in kept]))
            clean[np.searchsorted(names, found)] = n
        odds = np.log((seen + 0.5) / (clean * scale + 0.5))
        # A neutral word's contexts are all toxic with share ** seen; no such word is expected among all that are tried.
        share = np.clip(total / max(1, total + other), 1e-9, 0.9)
        ok = (seen >= np.log(10 * tried) / -np.log(share)) & (odds >= ODDS)
        out |= {int(a): float(b) for a, b in zip(names[ok], np.clip(odds[ok] / 4, 0.2, 1.5), strict=True)}
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Grammar:
    texts, y, weights = labelled_sample(documents, labels, "toxic", {0: 3500, 1: 1500})
    # Half of the texts teach words; the weights are fitted on the other half, where these words are as new as elsewhere.
    half = np.arange(len(texts)) % 2 == 0
    scale = float(weights[y == 0].max(initial=1e-9) / weights[y == 1].max(initial=1e-9)) if len(set(y.tolist())) == 2 else 1.0
    grammar = Grammar(learned_words([t for t, h in zip(texts, half, strict=True) if h], y[half], scale), _PRIOR)
    rest = [t for t, h in zip(texts, half, strict=True) if not h]
    sums = [grammar.sums(w) for _, w in words(flat(pa.array(rest, pa.string())), most=1 << 18, gaps=NOT_LETTERS)]
    x = np.log1p(np.concatenate(sums)) if sums else np.zeros((0, len(SUMS)))
    beta = logistic(x, y[~half], weights[~half], _PRIOR, strength=3.0)
    grammar = Grammar(learned_words(texts, y, scale), beta)
    del texts, rest, x, sums
    give_back()
    return grammar


def scored(documents: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, and the sums of SUMS of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in words(flat(batch.column(1)), gaps=NOT_LETTERS):
                sums = grammar.sums(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sums)), pa.array(grammar.scores(sums)), *(pa.array(c) for c in sums.T)], names=["doc_id", "score", *SUMS])

    return lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), ", ".join(["doc_id long, score double", *(f"{s} double" for s in SUMS)]))


def keep_clean(documents: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores under the threshold, with all their columns."""
    names = documents.columns
    kinds = documents.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, w in words(flat(batch.column(at)), gaps=NOT_LETTERS):
                good = grammar.scores(grammar.sums(w)) < threshold
                yield batch.slice(row, len(good)).filter(pa.array(good))

    return lean(documents).mapInArrow(frugal(run), kinds)


def op5(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(documents, grammar).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
