"""The language-model operators against brute force, round trips and held-out labels, on small and awkward tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from thalweg.llm import common, graph, language, lines, media, mixing, near, packing, secrets, tokenfiles, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, 7, "clash") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = "This line is long enough to be found again and again by all of them"
    rows = [(k, text(r.randint(0, 60)) + "\n" + (shared if k % 3 == 0 else "") + "\n" + text(12), f"s{k % 4}") for k in range(40)]
    base = text(80).split()
    for k in range(40, 60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = "x" + str(r.random())
        rows.append((k, " ".join(w), None))
    rows += [(60, None, "s0"), (61, "", None), (62, " \n\t", "s1"), (63, rows[3][1], "s2"), (64, "one", "s2"), (65, "É one\x1ctwo " * 3000, "s3"), (None, shared, "s0"), (66, rows[3][1].upper(), "s1"), (5, rows[5][1], "s1")]
    return rows


def test_secret_spans_follow_the_rules():
    text = "password = 'abcdefgh12' x token:short AKIA" + "A1" * 8 + " " + "0f" * 20
    got = secrets.base_spans(text)
    assert [(k, text[s:e][:4]) for s, k, e in got] == [(0, "pass"), (1, "AKIA"), (2, "0f0f")]
    assert secrets.base_spans("paſſword=abcdefgh12") == []
    codes, y = secrets.made_findings(["some words around it here"], 1200)
    net = secrets.CharNet().fit(codes, y)
    more, z = secrets.made_findings(["other text stands about"], 300, seed=9)
    assert ((net.scores(more) >= net.threshold) == z).mean() > 0.9


def test_secret_scan_rows(spark, corpus):
    docs = table(spark, corpus + [(70, "key ghp_x token=abcdefgh99 end", "s0")])
    out = {r.doc_id: r.spans for r in secrets.scan(docs, secrets.CharNet()).collect()}
    assert [(s.kind, s.start, s.end) for s in out[70] if s.kind != "model"] == [("assign", 10, 26)] and out[61] == []


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(0, 0.3, (300, 8)).astype(np.float32)
    x[50:60] = x[40]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [None] * 8), (1020, [float("nan")] * 8), (None, x[0].tolist()), (1040, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(64 * x.astype(float)).astype(int)
    got = defaultdict(list)
    for row in topk.top_k(df, k=5).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for i in range(0, 300, 20):
        s = q @ q[i]
        assert got[i] == [(j, int(s[j])) for j in sorted((j for j in range(300) if j != i), key=lambda j: (-s[j], j))[:5]]
    assert set(got) == set(range(0, 300, 20))
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_prunes_rows_in_groups(spark, monkeypatch):
    """Tight groups of vectors: exact, without a cartesian product, and fewer than a quarter of all pairs compared."""
    for name, value in (("BLOCK", 64), ("STEP", 16), ("PART", 700), ("RINGS", 16)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(5)
    centres = r.normal(0, 1, (25, 16))
    centres *= 4 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = (centres[r.integers(0, 25, 4000)] + r.normal(0, 0.02, (4000, 16))).astype(np.float32)
    x[100:1400] = x[100]  # a third of all rows are one vector
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(40, x[7].tolist())], "vec_id long, embedding array<float>")
    q, got = np.floor(64 * x.astype(float)).astype(int), defaultdict(list)
    out = topk.top_k(df, k=5, visited=True)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    share = {}
    for row in out.orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
        share[row.query_id] = row.n_visited / 4001
    for i in range(0, 4000, 20):
        own = q[i] if i != 40 else min(q[40].tolist(), q[7].tolist())
        s = q @ np.array(own)
        cand = sorted((j for j in range(4000) if j != i), key=lambda j: (-s[j], j))[:5]
        assert got[i] == [(j, int(s[j])) for j in cand]
    assert np.mean(list(share.values())) < 0.25


def test_toxicity_generalises_to_misspellings():
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    bad = ["zorkface", "grumblit"]
    texts, y = [], []
    for k in range(400):
        w = [word() for _ in range(40)]
        if k % 4 == 0:
            w[r.randrange(40)] = r.choice(bad)
        texts.append(" ".join(w).encode())
        y.append(int(k % 4 == 0))
    m = toxicity.SubwordModel().fit(texts, y)
    score = lambda t: m.probability(np.array([m.logit(m.amounts(t.split()))]))[0]
    clean = b"abcde bcdef cdefg defgh efghi abcde bcdef"
    assert score(clean + b" zorkfaces") > 0.5 > score(clean)
    assert 0 <= score(b"") <= 1 and toxicity.SubwordModel().fit([], []).probability(np.zeros(1))[0] == 0


@pytest.mark.parametrize("raw", [b"", b"x", b"\xff" * 1500, bytes(range(256)) * 9, b"a" * 576])
def test_media_round_trip_and_resync(raw):
    stream = media.encode(raw)
    p = media.parse(stream)
    padded = media.decode(stream, p)
    assert padded == raw + b"\xff" * (len(padded) - len(raw)) and len(padded) % 576 == 0 and padded
    assert p["crc_bad"] == p["resyncs"] == 0 and p["vbr"]["frames"] == len(p["offsets"]) and p["samples"] == 1152 * len(p["offsets"])
    hurt = stream + b"junk\xff\xe0" + media.encode(b"more" * 400)[len(media.encode(b"")) - 672 :]
    assert len(media.parse(hurt)["offsets"]) >= len(p["offsets"]) and media.parse(hurt)["resyncs"] >= 1
    at = p["offsets"][0] + 4
    assert media.parse(stream[:at] + bytes([stream[at] ^ 1]) + stream[at + 1 :])["crc_bad"] == 1


def test_media_query_keeps_every_unit(spark, tmp_path):
    """Through the query: marks of tags and frames at every place of the last unit and its neighbours; nulls; no rows."""
    texts = [None, "", "x" * 575, "x" * 576, "x" * 577]
    for mark in ("TAG", "ID3", "ÿû", "VBRI"):
        texts += ["x" * k + mark + "y" * 52 for k in (0, 446, 447, 448, 449, 520, 521, 522, 576 + 521)]
    texts += ["x" * k + "TAG" + "z" * (573 - k) for k in range(0, 574, 7)]
    schema = "doc_id long, text string, media string"
    for name, rows in (("some", list(enumerate(texts)) + [(None, "null key"), (3, "x" * 576)]), ("none", [])):
        spark.createDataFrame([(*r, "clash") for r in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    out = media.op4_media_columns(spark, f"{tmp_path}/some").collect()
    want = []
    for i, t in [*enumerate(texts), (None, "null key"), (3, "x" * 576)]:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), hashlib.sha256(media.encode(raw)).hexdigest()))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in out) == sorted(want)
    assert media.op4_media_columns(spark, f"{tmp_path}/none").count() == 0


def test_media_tail_tags_checksums_and_tables():
    stream = media.encode(b"some text")
    tag = b"TAG" + b"a title".ljust(125, b"\0")
    for end in (stream + tag, stream + b"junk" + tag):
        p = media.parse(end)
        assert p["tags"]["title"] == "a title" and len(p["offsets"]) == 1 and media.decode(end, p)[:9] == b"some text"
    assert media.parse(stream + b"junk" + tag)["skipped"] == 4 and media.parse(b"")["offsets"] == [] == media.parse(tag)["offsets"]
    for layer, joint, size in ((1, False, 32), (1, True, 24), (2, False, 64)):
        bits = 0xFFF80000 | (4 - layer) << 17 | 10 << 12 | 1 << 10 | (1 << 6 | 1 << 4 if joint else 0)
        f = media.header(bits)
        body = bytearray(f.length)
        body[:4] = bits.to_bytes(4, "big")
        body[6 : 6 + size] = bytes((37 * k + 11) % 256 for k in range(size))
        data, n = media.guarded(bytes(body), f)
        plain = 0xFFFF  # bit by bit, as the standard draws it
        for k in range(n):
            high = plain >> 15 ^ data[k // 8] >> 7 - k % 8 & 1
            plain = (plain << 1 & 0xFFFF) ^ (0x8005 if high else 0)
        body[4:6] = plain.to_bytes(2, "big")
        p = media.parse(bytes(body) * 3)
        assert (p["crc_good"], p["crc_bad"], len(p["offsets"])) == (3, 0, 3)
        body[7] ^= 64
        assert media.parse(bytes(body) * 3)["crc_bad"] == 3
        assert n == 16 + (256 if layer == 1 and not joint else 32 * 4 + 4 * 8 if layer == 1 else n - 16)
    f = media.header(media._HEADER & ~(1 << 16) | 1 << 16)
    vbri = bytearray(f.length)
    vbri[:4], vbri[36:40] = f.bits.to_bytes(4, "big"), b"VBRI"
    vbri[46:62] = (f.length * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + b"\0\2\0\3\0\2\0\2"
    vbri[62:66] = b"\1\0\0\7"
    p = media.parse(bytes(vbri) + (f.bits.to_bytes(4, "big").ljust(f.length, b"\0")) * 4)
    assert p["vbr"] == {"kind": "VBRI", "frames": 4, "bytes": f.length * 5, "toc": [768, 789], "frames_per_entry": 2} and len(p["offsets"]) == 4


@pytest.mark.parametrize("known", [200_000, 20])
def test_language_scores(spark, corpus, monkeypatch, known):
    """Base columns against the contract's formula, whether counts are told to all tasks or joined."""
    monkeypatch.setattr(language, "KNOWN", known)
    monkeypatch.setattr(language, "VOCABULARY", 15)
    out = language.score(table(spark, corpus)).collect()
    docs = [(i, common.words((t or "").encode()) + [b""]) for i, t, _ in corpus]
    c = Counter(w for i, ws in docs if language.trains(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == n and math.isfinite(r.score) and r.score < 0 for r in out)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1) for r in out)
    assert language.score(table(spark, [])).count() == 0


def laid(docs):
    return np.concatenate(docs), np.array([len(d) for d in docs])


def test_network_probabilities_add_up_and_carry_state():
    net = language.GRU(40)
    h = np.append(np.random.default_rng(1).normal(0, 1, (1, language.HIDDEN)), [[1]], 1).astype(np.float32)
    p = np.exp([net.log_probabilities(h, np.array([y]))[0] for y in range(41)])
    assert p.sum() == pytest.approx(1, abs=1e-4)
    docs = [np.random.default_rng(k).integers(0, 41, n).astype(np.int32) for k, n in enumerate((5, 100, 1, 60))]
    assert language.score_documents(net, *laid(docs)) == pytest.approx([language.score_documents(net, *laid([d]))[0] for d in docs], rel=1e-4)


def test_gradients_are_those_of_the_loss():
    """One step with a state of equal scales moves every weight against the numerical slope of the loss."""
    r = np.random.default_rng(4)
    x, y = r.integers(0, 90, (6, 3)), r.integers(0, 91, (6, 3)).astype(np.int32)
    y[4:, 2] = -1
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True
    start = np.zeros((3, language.HIDDEN), np.float32)

    def loss(net):
        hs, _, _ = net.steps(x, fresh, start)
        return -net.log_probabilities(hs[y >= 0], y[y >= 0]).astype(float).sum()

    net = language.GRU(90)
    net.p = {k: v * 5 for k, v in net.p.items()}
    net.blank()
    after, big = net.copy(), 1e8
    after.learn(x, y, fresh, start, {k: np.full_like(v, big) for k, v in net.p.items()}, 1e4, 1)
    moved = {k: (net.p[k] - after.p[k]).ravel() for k in net.p}
    for k in net.p:
        for j in [int(i) for i in np.argsort(-np.abs(moved[k]))[:4]]:
            up, down = net.copy(), net.copy()
            up.p[k].ravel()[j] += 0.02
            down.p[k].ravel()[j] -= 0.02
            assert moved[k][j] == pytest.approx((loss(up) - loss(down)) / 0.04, rel=0.05, abs=0.02)


def test_one_very_long_text_lies_beside_short_ones():
    lengths = np.array([50_000] + [3] * 500)
    lanes = language.Lanes(np.arange(lengths.sum()) % 7, lengths, 100)
    assert len(lanes.tokens) == lengths.sum() and lanes.length[0] == 50_000
    assert sum(int((y >= 0).sum()) for _, _, y, _ in lanes.windows()) == lengths.sum()


def test_every_window_trains(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 0)
    docs = table(spark, [(next(i for i in range(9) if language.trains(i)), " ".join(f"w{k}" for k in range(80)), "x")])
    lex = language.lexicon(language.word_counts(docs, "doc_id", "text"))
    net = language.train(docs, lex, "doc_id", "text")
    first = language.GRU(lex.n)
    first.begin(np.append(lex.counts[: lex.n], lex.other_total))
    assert (np.abs(net.p["X"] - first.p["X"]).max(1)[: lex.n] > 1e-5).all()


def test_many_word_hashes_and_their_places():
    r = random.Random(8)
    texts = [b"", b" ", b"a"] + ["".join(r.choice(["Ab", "é", " ", "\n", "\x1c", "x" * 30]) for _ in range(r.randint(0, 40))).encode() for _ in range(200)]
    own = [common.word_hashes(t) for t in texts]
    for block in (1, 16, 1 << 18):
        h, n = common.many_word_hashes(texts, block)
        assert n.tolist() == [len(common.words(t)) for t in texts] and h.tolist() == [x for o in own for x in o.tolist()]
    known = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64)
    asked = np.concatenate((known[::-1], known + np.uint64(1)))
    for levels in (1, 2, 3):
        assert common.HashTable(known, levels).find(asked).tolist() == list(range(5000))[::-1] + [5000] * 5000
    assert common.HashTable(known[:0]).find(asked).tolist() == [0] * len(asked)


def test_packing_is_gapless_and_tight(spark):
    r = random.Random(2)
    rows = [(k, r.choice([1, 7, 500, 900, 4096, 2000])) for k in range(400)] + [(1, 7), (1, 7)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, length long"), ["doc_id"]).collect()
    by = defaultdict(list)
    for x in out:
        by[x.sequence_id].append((x.offset, x.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    assert len(out) == len(rows) and len(by) <= math.ceil(sum(n for _, n in rows) / 4096) * 11 / 9 + 1


def test_token_pieces(spark, corpus):
    path = public_tokenizers.path(packing.TOKENIZER)
    out = packing.token_pieces(table(spark, corpus), path, capacity=64).collect()
    t = Tokenizer.from_file(path)
    want = []
    for i, x, _ in corpus:
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want += [(str(i), p, zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 64))]
    assert sorted((str(r.doc_id), r.piece, r.ids_crc32) for r in out) == sorted(want)


def test_targets_and_budgets(spark, corpus):
    assert mixing.targets({"a": 10, "b": 10, None: 10}) == {"a": 5, "b": 10, None: 15}
    t = mixing.targets({"a": 90, "b": 5, "c": 5})
    assert t == {"a": 70, "b": 15, "c": 15} and mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}
    r = np.random.default_rng(1)
    sizes, counts = np.arange(1, 60) * 7, r.integers(1, 9, 59)
    for budget in (1, 700, 5000, int((sizes * counts).sum()) - 3):
        for exact in (100, 1 << 17):
            take = mixing.fit_budget(sizes, counts, budget, exact)
            assert (take <= counts).all() and abs(int((take * sizes).sum()) - budget) <= 7
    a, b = (sorted(map(str, mixing.mix(table(spark, corpus)).collect())) for _ in range(2))
    assert a == b and len(a) == len(corpus)
    assert mixing.mix(table(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(spark, corpus):
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for i, t, _ in corpus:
        for x in (t or "").encode().split(b"\n"):
            if i is not None and len(key(x).decode()) >= 40:
                held[key(x)].add(i)
    want = []
    for i, t, _ in corpus:
        own = (t or "").encode().split(b"\n")
        kept = [x for x in own if i is None or len(held[key(x)]) < 5 or max(held[key(x)]) == i]
        want.append((str(i), len(own), len(own) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    out = lines.dedup(table(spark, corpus)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out) == sorted(want)
    assert lines.dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("rounds", [False, True])
def test_jaccard_classes_equal_brute_force(spark, corpus, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(near, "CLASS_DOCS", 1)
        monkeypatch.setattr(near, "CHUNK", 5)
        monkeypatch.setattr(near, "LEADERS", 2)
        monkeypatch.setattr(near, "RARE", 3)
        monkeypatch.setattr(near, "COMMON", 6)
        monkeypatch.setattr(near, "LONG", 70)
    sets = [(i, set(common.shingles((t or "").encode(), 3).tolist())) for i, t, _ in corpus]
    label = {i: i for i, _ in sets if i is not None}
    for _ in label:
        for i, a in sets:
            for j, b in sets:
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 90 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    out = near.similar_classes(table(spark, corpus), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted((str(i), len(s), str(label.get(i))) for i, s in sets)
    if rounds:
        assert len(near.common_shingles(near.document_sets(table(spark, corpus), 3, "doc_id", "text"), len(corpus))[0]) > 20
        assert near.similar_classes(table(spark, []), 3, 90).count() == 0


def test_classes_whose_largest_changes(spark):
    """Common words order the turns: 16 of X, then x within X while it leads, then Y, which overtakes, then y within Y; x links y."""
    own = iter(range(1000, 100_000))
    hot, run = [900, 901, 902], lambda start: list(range(start, start + 40))
    sets = [hot + [next(own) for _ in range(40)] for _ in range(400)]
    sets += [run(0) + hot + [next(own)] for _ in range(16)] + [run(3) + hot[:2], run(6)]
    sets += [run(9) + hot[:1] + [next(own)] for _ in range(40)]
    t = pa.table({"doc_id": range(len(sets)), "n": [len(s) for s in sets], "tokens": [np.array(sorted(s), "<i8").tobytes() for s in sets]})
    star = {r["a"]: r["b"] for r in near._classes(80)(t).to_pylist()}
    assert [star.get(i, i) for i in range(len(sets))] == [min(i, 400) for i in range(len(sets))]


def graded_sets(seed):
    """Sets of 20 numbers in a row from random starts, and the least index that links at 80 percent reach."""
    starts = np.random.default_rng(seed).integers(0, 120, 40)
    label = list(range(40))
    for _ in label:
        for i in range(40):
            for j in range(40):
                if abs(starts[i] - starts[j]) <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    return [np.arange(s, s + 20) for s in starts], label


def test_rounds_whose_largest_changes(spark, monkeypatch):
    monkeypatch.setattr(near, "LEADERS", 2)
    monkeypatch.setattr(near, "CHUNK", 25)
    made = [graded_sets(seed) for seed in range(30)]
    rows = [(g, 100 * g + i, 20, s.astype("<i8").tobytes()) for g, (sets, _) in enumerate(made) for i, s in enumerate(sets)]
    links = near._rounds(spark.createDataFrame(rows, "comp long, doc_id long, n long, tokens binary"), 80)
    least = {r.node: r.component for r in graph.components(links).collect()}
    assert [least.get(r[1], r[1]) for r in rows] == [100 * g + k for g, (_, label) in enumerate(made) for k in label]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 3), (2, 5)], "a long, b long")
    assert {r.node: r.component for r in graph.components(edges).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_token_files_round_trip(spark, corpus):
    path = public_tokenizers.path(tokenfiles.TOKENIZER)
    manifest = tokenfiles.write_shards(table(spark, corpus), common.shared_dir(spark), path)
    out = sorted(tokenfiles.read_shards(manifest).collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(path)
    at = 0
    for r, (i, x, _) in zip(out, sorted(corpus, key=lambda c: (c[0] is not None, c[0] or 0, c[1] is not None, c[1] or ""))):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    shard = tokenfiles.Shard(manifest.first().uri)
    assert shard.find([10**9], [0])[0][0] == -1


def test_perfect_hash_is_minimal():
    a, b = tokenfiles.key_hashes(list(range(5000)), [0] * 5000)
    assert sorted(tokenfiles.PerfectHash.build(a, b).slot(a, b).tolist()) == list(range(5000))


def test_cached_pieces_equal_whole_encoding():
    r = random.Random(6)
    texts = ["".join(r.choices([" ", " ", "\n", "\t", "a", "B", "é", "1", ".", "'s", "　", "\x1f"], k=r.randint(0, 15))) for _ in range(800)] + ["<|endoftext|> a"]
    for name, keep in ((tokenfiles.TOKENIZER, True), (packing.TOKENIZER, False)):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        assert [x.tolist() for x in tokens.Encoder(path, keep).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_direct_words_equal_whole_encoding(monkeypatch, name, keep):
    """Letters, signs, line ends, white space and digits in any order; the cache's generations turn over."""
    monkeypatch.setattr(tokens, "CACHE", 50)
    r = random.Random(11)
    parts = ["Ab", "don't", "'s", "é", "ÑU", "İ", "ß", "ﬁ", "µ", "ª", "×", "你好", "e\u0301", "12", "a1", ",", ".%%%", "<|endoftext|>", "\n", "\r\n", "\t", " ", "  ", "\0", "\x01", "\x1c", "\x85", "\u3000", "\u200d", "Ā", "į", "ı"]
    texts = ["", " ", "\n", "a\n", "\na", "a.\nb, c", "a \nb", "a\n\nb"] + ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(3000)]
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    got = tokens.Encoder(path, keep).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
