"""The stages against plain Python on a small corpus."""

import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from glyphmill.llm import toxicity
from grammar_by_hand import sums as by_hand


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def toxic_ids(docs, labels):
    """A slow walk: every token of every sentence, with the fitted lexicon and weights, by the grammar's definition."""
    grammar = toxicity.fit(docs, labels)
    names = {toxicity.INSULT: "insult", toxicity.THREAT: "threat", toxicity.TARGET: "target", toxicity.NEGATION: "negation", toxicity.REPORT: "report"}
    listed = {int(h): (names[int(c)], float(w)) for h, c, w in zip(grammar.hashes, grammar.classes, grammar.weights, strict=True)}

    def classify(token):
        raw = folded(token).encode()
        keys = [int(toxicity._fixed([token])[0]), *(int(stem_hash(raw[:k])) ^ k for k in (6, 5, 4))]
        return next((listed[k] for k in keys if k in listed), ("other", 0.0))

    out = set()
    for r in docs.collect():
        total = grammar.beta[-1] + sum(b * math.log1p(s) for b, s in zip(grammar.beta, by_hand(r.text, classify), strict=False))
        if 1 / (1 + math.exp(-total)) >= 0.3:
            out.add(r.doc_id)
    return out


def stem_hash(raw):
    import numpy as np

    from glyphmill.llm.tokens import _VALUE, BASES, span_hashes

    return span_hashes(_VALUE[np.frombuffer(raw, np.uint8)], np.array([0]), np.array([len(raw)]), BASES[0])[0]


def later_copies(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 60)
    for i, r in enumerate(rows):
        least[root(i)] = min(least[root(i)], r.doc_id)
    return {r.doc_id for i, r in enumerate(rows) if least[root(i)] != r.doc_id}


def leaked(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(t))
    windows = set()
    for item in items:
        w = words(item.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    return {r.doc_id for r in rows for w in [words(r.text)] for n in sizes if any(tuple(w[i : i + n]) in windows for i in range(len(w) - n + 1))}


def test_stages_keep_what_they_should(spark, data):
    labels, benchmark = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    docs = seen = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, data).cache()
        rows, kept = seen.collect(), Counter(r.doc_id for r in out.collect())
        ids = Counter(r.doc_id for r in rows)
        if name == "sharding":
            loads = defaultdict(int)
            for r in out.collect():
                loads[r.shard] += r.size
            assert kept == ids and max(loads.values()) < 1.2 * min(loads.values())
            break
        assert out.columns == docs.columns
        if name == "toxicity":
            assert set(kept) == set(ids) - toxic_ids(seen, labels)
        if name == "near_duplicates":
            assert set(kept) == set(ids) - later_copies(rows)
        if name == "decontamination":
            assert set(kept) == set(ids) - leaked(rows, benchmark.collect())
        if name == "mixing":
            assert set(kept) <= set(ids) and max(kept.values()) <= 3
        else:
            assert max(kept.values()) == 1
        seen = out


def test_near_copies_leave_other_texts_of_their_id(spark):
    copy, other = (" ".join(f"{w}{i}" for i in range(80)) for w in ("a", "b"))
    rows = [(1, copy), (3, copy), (3, other), (None, copy)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(map(tuple, out.collect())) == Counter([rows[0], rows[2], rows[3]])


def test_run_is_the_stages(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.count() > 0 and len(corpus_pipeline.STAGES) == 5
    assert set(spark.read.parquet(f"{data}/documents.parquet").columns) <= set(rows.columns)


def write_tables(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, row string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = write_tables(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "sharding" or out.columns == docs.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_takes_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i % 977}x{i % 61}" for i in range(40_000))
    texts = [None, "", " \n", "one", "one", "a plain text of some words", long, "ü É 日本 " * 30]
    rows = [(i, t, None, None if i % 2 else "s", None, "clash", "clash") for i, t in enumerate(texts)] + [(None, "without an id", "en", None, 3, "clash", "clash"), (3, "one", None, None, None, "clash", "clash")]
    docs = write_tables(spark, tmp_path, rows)
    expected = {"toxicity": len(rows), "near_duplicates": len(rows) - 1, "decontamination": len(rows), "sharding": len(rows)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name != "sharding":
            assert out.columns == docs.columns
        if name in expected:
            assert len(got) == expected[name], name
        else:
            assert {(r.doc_id, r.text) for r in got} <= {r[:2] for r in rows}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_leave_clean_rows_and_take_planted_ones(spark, tmp_path):
    item = "zero one two three four five six seven eight nine ten"
    rows = [(1, f"before {item} after", "en", "s", 1, "x", "x"), (2, "You are an idiot and a moron, you stupid fool.", "en", "s", 1, "x", "x"), (3, 'She said: "you are an idiot", and nobody laughed.', "en", "s", 1, "x", "x"), (4, "I will not hurt you.", "en", "s", 1, "x", "x")]
    docs = write_tables(spark, tmp_path, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert {r.doc_id for r in stages["toxicity"](spark, docs, str(tmp_path)).collect()} == {1, 3, 4}
    assert {r.doc_id for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()} == {2, 3, 4}
    assert {r.doc_id for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()} == {1, 2, 3, 4}


def test_pipelines_side_by_side_keep_their_tables(spark, data):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        counts = [f.result() for f in [pool.submit(lambda: corpus_pipeline.run(spark, data).count()) for _ in range(2)]]
    assert counts[0] == counts[1] > 0
