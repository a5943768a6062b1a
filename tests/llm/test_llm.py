"""Each operator against brute force or an exact round trip, with nulls, empty tables, ties and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quire.llm import chat, contamination, jaccard, langid, neighbours, packing, pii, quality, repair, tokens, toxicity

PATH = tokens.vocabulary()
TEXT = "doc_id long, text string"


def rows(spark, data, schema=TEXT):
    return spark.createDataFrame(data, schema)


def test_encoder_equals_the_library():
    rng = random.Random(1)
    bits = ["a", "b", "é", "ß", "×", " ", "  ", "\n", "\n\n", " \n", "\t", "'", "'s", "don't", "1", "23", "!", " ", "　", "日本", "\x00", "\x1c", "😀", "<|endoftext|>", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(5000)] + [None, "", "x" * 5000, " " * 300]
    e = tokens.Encoder(PATH)
    ids, n = e.encode(texts)
    want = [x.ids for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want))


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    docs = [rng.choice(40, n).astype(np.uint32) for n in (0, 1, 500, 3000, 7, 2000)]
    shard = repair.Shard(repair.Shard.pack(np.arange(6), np.zeros(6, bool), np.concatenate(docs), np.array([len(d) for d in docs]), 50, least=4))
    assert len(shard.rules) and len(shard.symbols) < sum(map(len, docs))
    for k, d in enumerate(docs):
        assert (shard.document(k) == d).all()
        assert (shard.span(k, 3, 450) == d[3:450]).all()


def test_op1_starts_and_sums(spark):
    data = [(3, "b b b"), (1, None), (2, ""), (None, "x"), (3, "a")]
    got = sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in repair.read_documents(repair.write_shards(rows(spark, data), PATH)).collect())
    e, at, want = tokens.Encoder(PATH), 0, []
    first = sorted([x for x in data if x[0] == 3], key=lambda x: (zlib.crc32(x[1].encode()) if zlib.crc32(x[1].encode()) >= 0 else 0, x[1]))
    for d, t in [data[3], data[1], data[2], *first]:
        ids = np.append(e.encode([t])[0], 0).astype("<u4")
        want.append((d or -1, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert repair.read_documents(repair.write_shards(rows(spark, []), PATH)).count() == 0


def test_packing_pieces(spark):
    data = [(1, "a b c " * 3000), (2, None), (2, None)]
    got = packing.pack(rows(spark, data), PATH).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.length & (r.length - 1) == 0 and r.offset == 0 for r in got)
    ids = b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 1), key=lambda r: r.start))
    assert np.frombuffer(ids, "<u4").tolist() == tokens.Encoder(PATH).encode([data[0][1]])[0].tolist() + [1]
    assert packing.pieces(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]


def test_chat_trees(spark):
    nodes = rows(spark, [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "### a: </turn>\\", 0.9), (1, 4, 3, None, None, 0.9), (2, 1, 99, "system", "s", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)], "tree_id long, node_id long, parent_id long, role string, text string, score double")
    out = chat.format_paths(chat.best_paths(nodes), nodes)
    got = {r.tree_id: r for r in out.select("tree_id", chat.parse(chat.F.col("formatted")).alias("turns"), chat.learned(chat.F.col("formatted"), chat.F.col("loss")).alias("kept")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "q"), ("assistant", "### a: </turn>\\"), ("", "")]
    assert got[1].kept == "### a: </turn>\\" and set(got) == {1, 2}
    assert chat.best_paths(nodes, top=2).where("tree_id = 1").select("leaf_id").distinct().count() == 2


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0


def _brute(text):
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and _luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def test_pii_spans(spark, monkeypatch):
    rng = random.Random(5)
    bits = ["a", "b.", "@", "a@b.c", "é", "1", "255", "256", ".", "1.2.3.4", " ", "-", "+", "(", ")", "+1 (234) 555-6677", "4207051279108084", "4207 0512 7910 8084", "\x01", "😀", "0001", "\n", "a@b.c_d@e.f"]
    data = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for k in range(400)] + [(900, None), (901, ""), (902, "1" * 20000), (903, "a@b" + ".c" * 9000)]
    monkeypatch.setattr(pii, "table", lambda *_: rows(spark, data))
    got = {r.doc_id: r for r in pii.op7_pii(spark, "").collect()}
    for k, text in data:
        assert got[k].base_sha256 == hashlib.sha256(",".join(_brute(text)).encode()).hexdigest(), text
    out = pii.redact(rows(spark, [(1, "please call (234) 555-9876 now, a@b.de"), (2, "order 123-456-7890")])).collect()
    assert [r.text for r in out] == ["please call [PHONE] now, [EMAIL]", "order 123-456-7890"]


@pytest.mark.parametrize("crowd", [32, 2])
def test_jaccard_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    if crowd == 2:
        monkeypatch.setattr(jaccard, "MEMBERS", 3)
        monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    data = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for k in range(60)]
    for k in range(60, 140):
        t = data[rng.randrange(len(data))][1].split()
        if t:
            t[rng.randrange(len(t))] = rng.choice(words)
        data.append((k, " ".join(t)))
    data += [(200, None), (201, ""), (202, "A b"), (203, "a  B"), (204, " \t\n")]
    sets = {d: ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()) for d, t in data for w in [(t or "").lower().split()]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(rows(spark, data), 4, 85).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in ids}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16))
    x[100:180] = x[5]
    data = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (904, [None] * 16)]
    table = neighbours.usable(rows(spark, data, "vec_id long, embedding array<double>"))
    got = neighbours.nearest(table, table.where("vec_id % 100 = 0")).collect()
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert len(got) == 30


def test_contamination_finds_edited_copies(spark):
    rng = random.Random(7)
    w = lambda n: [f"{rng.choice('bcdfgk')}{rng.randrange(5000)}" for _ in range(n)]
    item = w(40)
    edited = [x if k % 9 else "zzz" for k, x in enumerate(item) if k != 20]
    docs = [(1, " ".join(w(200) + item + w(100))), (2, " ".join(w(50) + edited + w(50))), (3, " ".join(w(300))), (4, None), (5, "")]
    got = {(r.doc_id, r.item_id): r.score for r in contamination.contaminated(rows(spark, docs), rows(spark, [(7, " ".join(item)), (8, None), (9, "one two")], "item_id long, text string")).collect()}
    assert got[1, 7] == 1.0 and 0.6 <= got[2, 7] < 1 and len(got) == 2


def _contaminated(docs, items, least=0.6):
    words = lambda t: contamination.word_hashes([t])[0]
    for d, t in docs:
        for i, x in items:
            w = words(x)
            if len(w) >= 3 and contamination.align(w, words(t))[0] >= least * 2 * len(w):
                yield d, i


def test_contamination_of_frequent_edited_copies(spark):
    rng = random.Random(11)
    w = lambda n: [f"{rng.choice('bcdfgk')}{rng.randrange(5000)}" for _ in range(n)]
    item, other = w(40), w(40)
    edited = ["zzz" if k in (4, 12, 20, 28, 36) else x for k, x in enumerate(item)]
    docs = [(k, " ".join(w(5) + edited + w(5))) for k in range(60)] + [(100 + k, " ".join(w(3) + other)) for k in range(60)]
    docs += [(200, " ".join("zzz" if k in (4, 12, 20, 28, 36) else x for k, x in enumerate(other))), (201, " ".join(x for pair in zip(item[::2], item[1::2], strict=True) for x in (*pair, "zzz"))), (202, " ".join(w(50)))]
    items = [(7, " ".join(item)), (8, " ".join(other))]
    got = [(r.doc_id, r.item_id) for r in contamination.contaminated(rows(spark, docs), rows(spark, items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(_contaminated(docs, items)) and {(0, 7), (200, 8), (201, 7)} <= set(got)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(12)
    w = lambda n: [f"w{int(rng.random() ** 3 * 300)}" for _ in range(n)]
    items = [(k, w(n)) for k, n in enumerate([3, 4, 5, 5, 6, 7, 9, 15, 20, 40, 41, 60] * 2)]
    docs = []
    for d in range(400):
        copy = []
        for x in rng.choice(items)[1]:
            r = rng.random()
            copy += w(1) if r < 0.1 else [] if r < 0.15 else [x, *w(1)] if r < 0.4 else [x]
        docs.append((d, " ".join(w(rng.randrange(30)) + copy + w(rng.randrange(30)))))
    items = [(k, " ".join(x)) for k, x in items]
    got = [(r.doc_id, r.item_id) for r in contamination.contaminated(rows(spark, docs), rows(spark, items, "item_id long, text string")).collect()]
    want = sorted(_contaminated(docs, items))
    assert sorted(got) == want and len(want) > 300


@pytest.mark.parametrize("chars", [8_000_000, 900])
def test_contamination_of_long_items(spark, monkeypatch, chars):
    monkeypatch.setattr(contamination, "CHARS", chars)
    rng = random.Random(13)
    w = lambda n: [f"{rng.choice('bcdfgk')}{rng.randrange(5000)}" for _ in range(n)]
    texts = {k: w(150) for k in range(4)}
    docs = [(k, " ".join(w(5) + [x if i % 6 else "zzz" for i, x in enumerate(t)] + w(5))) for k, t in texts.items()]
    got = [(r.doc_id, r.item_id, round(r.score, 2)) for r in contamination.contaminated(rows(spark, docs), rows(spark, [(k, " ".join(t)) for k, t in texts.items()], "item_id long, text string")).collect()]
    assert sorted((d, i) for d, i, _ in got) == [(k, k) for k in range(4)] and {s for *_, s in got} <= {0.75, 0.76}


def test_align():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert contamination.align(a, np.array([9, 1, 2, 9, 3, 4, 9], np.uint64)) == (7, 1, 6)


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_learn(kind):
    rng = random.Random(8)
    base = ["".join(rng.choice("aeioumnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    say = lambda n: [rng.choice(base) for _ in range(n)]
    bad = ["zgrukh", "vxorbl", "qwykka"]
    sample = [(k, " ".join(t), k % 2) for k in range(300) for t in [say(80) + ([rng.choice(bad) + "!!" for _ in range(6)] if k % 2 else [])] if not rng.shuffle(t)]
    train, test = sample[:220], sample[220:]
    if kind == "quality":
        s = quality.scores([t for _, t, _ in test], *quality.train(train))
        assert ((s > 0.5) == [y for _, _, y in test]).mean() > 0.9
    else:
        m = toxicity.train(train, 0.5)
        s = toxicity.scores([t for _, t, _ in test], m, toxicity.Gains(m))
        assert ((s > 0.5) == [y for _, _, y in test]).mean() > 0.9
        assert np.isfinite(toxicity.scores([None, "", "x" * 5000], m, toxicity.Gains(m))).all()


def test_language_codes():
    code = langid.codewords(4)
    assert code.shape == (4, 7) and min(int((code[a] != code[b]).sum()) for a in range(4) for b in range(a)) == 4
    rng = random.Random(9)
    sample = [(k, " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(30)), s) for k in range(120) for s in ("abcde", "fghij", "klmno")]
    m = langid.train(sample[:240])
    lang, score, _ = langid.predict([t for _, t, _ in sample[240:]] + [None, "12 !"], m)
    assert lang[:-2] == [s for _, _, s in sample[240:]] and lang[-2:] == ["und", "und"] and score[-1] == 0
    assert langid.predict(["abc"], langid.train([]))[0] == ["und"]


def test_classify_keeps_other_columns(spark):
    docs = rows(spark, [(1, "a", 0.5), (2, None, 0.1)], "doc_id long, text string, score double")
    out = quality.classify(docs, (np.zeros(1 << quality.BITS, np.float32), 0.0))
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "text"] and out.count() == 2
