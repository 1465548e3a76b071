"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Base spans are the leftmost non-overlapping matches of three patterns; they always stay. Further candidates are
tokens of LEAST or more characters that mix letters and digits and have a sensitive word within NEAR
characters before them, or as their beginning. A candidate's novelty is its marginal size: what zstandard needs for the text around it
with the candidate, less what it needs without. The compressor is primed with a dictionary trained on identifiers that are made by
rule out of WORDS, so it knows their words and what their letters and digits cost; case is folded. Since a marginal size
also hangs on what stands around, it is compared with what random letters and digits add in the same place:
ordinary identifiers come to 0.4 to 0.85 of that, random keys to 0.9 and more. Candidates of LIKE_RANDOM, or
LIKE_DIGITS where a third of the characters are digits (hexadecimal keys have few letters), are reported as kind
`novel`. Base spans get a novelty too.

Whole texts are searched; cheap searches for bytes that any match must hold skip the rest.

Cases. Null and empty texts: no spans. Null doc_id: scanned like any other. Repeated rows: scanned alike. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.shared import frugal, lean

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make the characters after them sensitive.
_SENSITIVE = re.compile(r"passw(?:or)?d|secret|token|api.?key|access.?key|private.?key|credential|authorization|bearer", re.IGNORECASE | re.ASCII)
LEAST, NEAR, AROUND, LIKE_RANDOM, LIKE_DIGITS = 16, 48, 512, 0.89, 0.8
DRAWS, LITTLE = 4, 256
_TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: What ordinary identifiers are made of.
WORDS = """
user name password secret token api key access private public client server host port path file folder config setting default value index
count total size limit offset length width height buffer cache queue stack list map set table column row field record entry item node edge
graph tree leaf root parent child first last next previous start stop begin end open close read write load store save send receive request
response reply header body message event handler listener callback action state status code error warning info debug trace log level time
date year month day hour minute second zone locale language country city street address number phone email account customer order product
price amount payment invoice report summary page section chapter part title text label caption image video audio media format type kind class
object method function module package library version release build test check verify validate parse encode decode encrypt decrypt hash sign
random unique global local static final constant variable parameter argument option flag mode enable disable create update delete insert
select filter sort group join merge split copy move rename reset login logout session cookie browser window button form input output result
query search find match replace print display show hide view model control service worker thread process task job batch stream pipe socket
network internet website domain link url http https www com org net json xml html css script style theme color black white red green blue
dark light main home about help guide manual how your with from into for and the new old
""".split()
_HEXES = np.zeros(256, bool)
_HEXES[[ord(c) for c in "0123456789abcdef"]] = True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower()
    out = []
    if any(k in lower for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if len(raw) >= 24:
        stops = np.flatnonzero(~_HEXES[np.frombuffer(raw, np.uint8)])
        if np.diff(stops, prepend=-1, append=len(raw)).max() > 24:
            out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def identifier(rng: random.Random, words: list[str]) -> str:
    """Two to five words, some with a number, joined in one of the usual ways."""
    chosen = [rng.choice(words) for _ in range(rng.randrange(2, 6))]
    if rng.random() < 0.4:
        for _ in range(rng.randrange(1, 3)):
            chosen[rng.randrange(len(chosen))] += str(rng.choice([rng.randrange(1, 100), rng.randrange(1990, 2031), rng.randrange(1, 10)]))
    titled = [w.title() for w in chosen]
    return rng.choice(["_".join(chosen), "-".join(chosen), chosen[0] + "".join(titled[1:]), "".join(titled), "_".join(chosen).upper(), "".join(chosen)])


@cache
def _packer() -> zstandard.ZstdCompressor:
    """A compressor with the trained dictionary, its tables of symbol costs included; the same in every process."""
    rng = random.Random(1)
    samples = [" ".join(identifier(rng, WORDS) for _ in range(12)).encode() for _ in range(4000)]
    known = zstandard.train_dictionary(16384, samples, level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)


@cache
def _lead() -> str:
    """Identifiers that stand before surroundings of under LITTLE characters, of which the compressor could not tell much."""
    rng = random.Random(3)
    return " ".join(identifier(rng, WORDS) for _ in range(60))[:600]


def _added(text: str, start: int, end: int, tokens: list[str]) -> list[int]:
    """Bytes that each token adds in the place of text[start:end]."""
    own = text[start:end]  # what it says once more nearby makes it no less a secret
    before, after = text[max(0, start - AROUND) : start].replace(own, ""), text[end : end + AROUND].replace(own, "")
    if len(before) + len(after) < LITTLE:
        before = _lead() + before
    size = lambda token: len(_packer().compress((before + token + after).lower().encode("utf-8", "replace")))
    least = size("")
    return [max(0, size(token) - least) for token in tokens]


def novelty(text: str, start: int, end: int) -> int:
    """Bytes that text[start:end] adds to its surroundings when both are compressed."""
    return _added(text, start, end, [text[start:end]])[0]


def like_random(text: str, start: int, end: int) -> tuple[int, float]:
    """The novelty of text[start:end], and its share of what random letters and digits add there (the mean of DRAWS, the same on every call)."""
    n = end - start
    draws = ["".join(random.Random(n * DRAWS + i).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for i in range(DRAWS)]
    own, *others = _added(text, start, end, [text[start:end], *draws])
    return own, own * DRAWS / max(1, sum(others))


def is_novel(token: str, share: float) -> bool:
    digits = sum(map(str.isdigit, token))
    return share >= (LIKE_DIGITS if 3 * digits >= len(token) else LIKE_RANDOM)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of tokens in sensitive context, one a run of token characters, in order."""
    ends = [m.end() for m in _SENSITIVE.finditer(text)]
    for run in _TOKEN.finditer(text) if ends else ():
        start, end = run.span()
        inside = bisect_left(ends, end) - 1
        if inside >= 0 and ends[inside] > start:  # the run begins with a sensitive word of its own
            start = end - len(text[ends[inside] : end].lstrip("+/_=-"))
        elif inside < 0 or start - ends[inside] > NEAR:
            continue
        token = text[start:end]
        if end - start >= LEAST and re.search("[0-9]", token) and re.search("[A-Za-z]", token):
            yield start, end


def novel_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, novelty) of further candidates that do not compress and overlap no known span; known: by start."""
    out = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if not any(k in lower for k in (b"passw", b"secret", b"token", b"key", b"credential", b"authorization", b"bearer")):
        return out
    starts, reach = [s for s, _, _ in known], list(accumulate((e for *_, e in known), max))
    for start, end in candidates(text):
        upto = bisect_left(starts, end)
        if upto and reach[upto - 1] > start:
            continue
        new, share = like_random(text, start, end)
        if is_novel(text[start:end], share):
            out.append((start, 3, end, new))
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans by start and kind; all spans likewise, with their novelty."""
    base = sorted(base_spans(text))
    every = sorted([(s, k, e, novelty(text, s, e)) for s, k, e in base] + novel_spans(text, base))
    return base, every


def found_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, novelties of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = scan(text.as_py() or "")
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in every), [n for *_, n in every]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "novelties"])

    return lean(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelties array<int>")


def op9(spark, sf_dir: str) -> DataFrame:
    return found_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
