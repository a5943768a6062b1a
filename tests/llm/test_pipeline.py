"""Every stage of the pipeline against plain Python, and the whole of it, on a small set of documents."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from quire.llm import contamination, learning, quality, tokens


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    item = say(30)
    docs = [(k, " ".join(say(80) + (["zgrukh", "vxorbl"] * 5 if k % 4 == 0 else []))) for k in range(80)]
    docs += [(100 + k, " ".join(w if j != 5 * k else "changed" for j, w in enumerate(docs[1][1].split()))) for k in range(5)]
    docs += [(200, " ".join(say(20) + item + say(20))), (201, " ".join(say(9) + [w if k % 9 else "other" for k, w in enumerate(item)])), (202, "write to a.b@c.example.org or +1 (234) 555-9876 " + " ".join(say(30)))]
    docs += [(203, None), (204, ""), (None, " ".join(item)), (None, "nobody " + docs[3][1]), (205, docs[2][1]), (205, "a second text " + " ".join(say(40)))]
    rows = [(d, t, "en", f"s{k % 3}", len(t or ""), k) for k, (d, t) in enumerate(docs)]
    out = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def _rows(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.source) for r in df.collect())


def test_stages_equal_plain_python(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    columns = docs.columns
    kept = pipeline.quality_classifier(spark, docs, made)
    labels = spark.read.parquet(f"{made}/labels.parquet").selectExpr("doc_id", "quality AS label")
    model = quality.train(learning.labelled_sample(docs, labels))
    want = [r for r in docs.collect() if quality.scores([r.text], *model)[0] >= 0.7]
    assert kept.columns == columns and _rows(kept) == sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.source) for r in want)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in want} >= {4 * k for k in range(1, 15)}

    single = pipeline.near_duplicates(spark, docs, made)
    sets = {}
    for r in docs.collect():
        w = (r.text or "").lower().split()
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, []).append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted({((r.doc_id if r.doc_id is not None else -1), r.text or "", r.source) for r in docs.collect() if r.doc_id is None or root[r.doc_id] == r.doc_id})
    assert single.columns == columns and _rows(single) == want and {root[100 + k] for k in range(5)} == {1}

    clean = pipeline.benchmark_decontamination(spark, docs, made)
    item = contamination.word_hashes([spark.read.parquet(f"{made}/benchmark.parquet").collect()[0].text])[0]
    leaks = lambda t: contamination.align(item, contamination.word_hashes([t])[0])[0] >= 0.6 * 2 * len(item)
    found = docs.collect()
    bad = {r.doc_id for r in found if r.doc_id is not None and leaks(r.text)}
    want = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.source) for r in found if (r.doc_id not in bad if r.doc_id is not None else not leaks(r.text)))
    assert clean.columns == columns and _rows(clean) == want and bad == {200, 201} and len([r for r in want if r[0] == -1]) == 1

    hidden = {(r.doc_id, r.text): r for r in pipeline.personal_data(spark, docs, made).collect()}
    assert next(t for d, t in hidden if d == 202).startswith("write to [EMAIL] or [PHONE] ") and (203, None) in hidden
    assert all(r.n_chars == len(r.text) for r in hidden.values() if r.text is not None) and len([1 for d, t in hidden if t and re.search(r"\[[A-Z]+\]", t)]) == 1

    pieces = pipeline.packed(spark, docs.where("doc_id <> 205"), made).collect()
    encoder = tokens.Encoder(tokens.vocabulary())
    for r in found:
        if r.doc_id is not None and r.doc_id != 205:
            ids = b"".join(bytes(p.ids) for p in sorted((p for p in pieces if p.doc_id == r.doc_id), key=lambda p: p.start))
            assert np.frombuffer(ids, "<u4").tolist() == encoder.encode([r.text])[0].tolist() + [1]


def test_run_and_empty_table(spark, made, tmp_path):
    ids = {r.doc_id for r in pipeline.run(spark, made).select("doc_id").distinct().collect()}
    assert not ids & {4, 8, 200, 201, 101, 102} and {1, 2, 202} <= ids
    empty = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{made}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, empty).count() == 0
