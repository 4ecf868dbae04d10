"""Token shards, the Merkle manifest and collocations against brute force."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm import collocations, merkle, toxicity, vafile, wavelet

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated ids."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(30)] + ["Été", "naïve", "don't", "3,5", "x<|endoftext|>y", "日本"]
    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\t", "! "]) for _ in range(n))
    rows = [(i * 3, text(rng.randrange(1, 60)), rng.choice(["en", "de", None, "und"]), f"s{rng.randrange(5)}", i) for i in range(90)]
    rows += [(1000, None, "en", None, None), (1001, "", None, "s1", 0), (1002, " \n\t ", "en", "s1", 1), (1003, text(30_000), "en", "s1", 2)]
    rows += [(None, "no id", "en", "s1", 3), (None, "No Id", "en", None, 3), (6, "same id, other text", "en", "s2", 4)]
    rows += [rows[4]] * 40 + [(5000, "A", "en", "alone", 1)]
    return spark.createDataFrame(rows, DOCS).withColumns({"rank": F.lit(1), "g": F.lit("x"), "path": F.lit(2)}).repartition(6), rows


# -- token shards


def test_encoder_cuts_change_no_id():
    rng = random.Random(1)
    plain, encoder = Tokenizer.from_file(path(wavelet.TOKENIZER)), wavelet.Encoder(path(wavelet.TOKENIZER))
    chars = " \n\t.,;:!?'abcZ19éß×… 　 –<|>_-"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["", "a", "it's 'tis  x  \n\n y.", " <|endoftext|> z<|endoftext|>.", "x" * 5000, "é è\n à"]
    ids, n = encoder.encode([t.encode() for t in texts])
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


class Counted:
    """A tokenizer that counts the inputs it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.inputs = tokenizer, 0

    def encode_batch_fast(self, inputs, **options):
        self.inputs += len(inputs)
        return self.tokenizer.encode_batch_fast(inputs, **options)


def test_new_pieces_are_encoded_together():
    plain, encoder = Tokenizer.from_file(path(wavelet.TOKENIZER)), wavelet.Encoder(path(wavelet.TOKENIZER))
    encoder._tokenizer = counted = Counted(plain)
    words = " ".join(f"wörd{i * 7919}<|endoftext|>日本, {i}" for i in range(5000))
    texts = [words.encode(), b"\xff broken \xc3 bytes\xe2\x82", b"", " \n  é<|endoftext|>".encode()]
    ids, n = encoder.encode(texts)
    want = [plain.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    assert counted.inputs <= 5


def test_ids_that_leave_out_bytes_go_by_inputs(tmp_path):
    from tokenizers import models, pre_tokenizers

    # Bytes that are no token have no id, as there is no unknown one.
    known = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "Ġ": 3}, [("a", "b")]))
    known.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    known.save(str(tmp_path / "t.json"))
    encoder = wavelet.Encoder(str(tmp_path / "t.json"))
    texts = ["ab xab", "zzz", "", "b éa  ab", "ab ab"]
    ids, n = encoder.encode([t.encode() for t in texts])
    want = [known.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("sigma", [1, 2, 3, 70, 40_000])
def test_matrix_answers_from_the_file(tmp_path, sigma):
    rng = np.random.default_rng(sigma)
    ids = (rng.zipf(1.3, 150_000) % sigma).astype(np.uint32) * 3
    file = tmp_path / "x.wvm"
    file.write_bytes(wavelet.pack([(1, 100_000), (None, 50_000)], ids))
    shard = wavelet.Shard(str(file))
    assert (shard.ids() == ids).all() and shard.docs["n"].tolist() == [100_000, 50_000]
    for i in rng.integers(0, len(ids), 30).tolist():
        token = int(ids[i])
        assert shard[i] == token and shard.rank(token, i) == (ids[:i] == token).sum()
        assert shard.select(token, shard.rank(token, i)) == i and shard.count(token) == (ids == token).sum()
    assert shard.count(1) == 0
    with pytest.raises(IndexError):
        shard.select(int(ids[0]), shard.count(int(ids[0])))


def test_shards_read_back(spark, corpus):
    docs, rows = corpus
    written = wavelet.write_shards(docs, shard_tokens=2000)
    listed = written.collect()
    assert len(listed) > 4 and sum(r.docs for r in listed) == len(rows)
    got = wavelet.read_shards(written, ids=True).orderBy("start").collect()
    plain = Tokenizer.from_file(path(wavelet.TOKENIZER))
    want = [(r[0], plain.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in rows]
    key = lambda d: (d[0] is not None, d[0] or 0)
    assert [r.doc_id for r in got] == [d for d, _ in sorted(want, key=key)]
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted(want, key=repr)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    flat = [i for r in got for i in r.ids]
    asked = [0, flat[5], 50_256, 49_999]
    counts = {r.token: r.n for r in wavelet.count_ids(written, asked).collect()}
    assert counts == {t: flat.count(t) for t in asked}
    found = wavelet.find_ids(written, [50_256]).collect()
    assert sorted(r.position for r in found) == [i for i, t in enumerate(flat) if t == 50_256]
    none = wavelet.write_shards(docs.limit(0))
    assert none.count() == 0 and wavelet.read_shards(none).count() == 0


# -- Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc, text, lang, source, n = row
    return h(*map(part, (doc, source, lang, n, text)))


def climb(nodes):
    """The last node, and for each first one its (left, right) segments."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for i, place in enumerate(at):
            run, p = runs[place // 16], place % 16
            ways[i].append(("".join(run[:p]), "".join(run[p + 1 :])))
            at[i] = place // 16
        nodes = [h(*r) for r in runs]
    return nodes[0], ways


def test_manifest_equals_a_plain_tree(spark, corpus):
    docs, rows = corpus
    changed = F.when(F.col("doc_id") % 5 == 0, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    got = merkle.verify(docs, tampered={"text": changed}).collect()
    order = sorted({r[3] for r in rows}, key=lambda s: (s is not None, s or ""))
    trees = {}
    for s in order:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, *climb([leaf_of(r) for r in own]))
    root, tops = climb([trees[s][1] for s in order])
    want = []
    for s, top in zip(order, tops, strict=True):
        own, subroot, ways = trees[s]
        for r, way in zip(own, ways, strict=True):
            low = r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
            node = leaf_of((r[0], low, *r[2:]) if r[0] is not None and r[0] % 5 == 0 else r)
            for left, right in way + top:
                node = h(left, node, right)
            want.append((r[0], leaf_of(r), subroot, root, h(*[a + b for a, b in way + top]), node, node == root))
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r.verified for r in got} == {True, False}
    assert merkle.verify(docs.limit(0)).count() == 0


def test_requests_for_some_leaves(spark, corpus):
    docs, rows = corpus
    leaves = docs.select("doc_id", "source", merkle.leaf_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    tree = merkle.build(leaves, "leaf", "source", ["doc_id"])
    every = {(r.source, r["__rank"]): r.path for r in merkle.proofs(tree, "source").collect()}
    assert len(every) == len(rows)
    asked = [("s1", 0), ("s1", 17), (None, 0), ("alone", 0), ("s1", 17), ("s2", 9999)]
    got = merkle.proofs(tree, "source", spark.createDataFrame(asked, "g string, rank bigint")).collect()
    assert {(r.source, r["__rank"]): r.path for r in got} == {k: every[k] for k in set(asked) if k in every}


# -- collocations


def phrases(rows, threshold):
    """Counts, words of each group and scored candidates, by plain loops."""
    counts, total = Counter(), Counter()
    for _, text, lang, _, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    counts[lang or "und", tuple(w[i : i + n])] += 1
    out = []
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < threshold:
            continue
        longer = [q for (g, q), f in counts.items() if g == lang and len(q) > len(p) and f >= max(a, threshold)]
        if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        best, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], total[lang], best))
    return counts, total, out


@pytest.mark.parametrize("block", [collocations.BLOCK_BYTES, 300])
def test_collocations_equal_plain_loops(spark, corpus, monkeypatch, block):
    docs, rows = corpus
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    counts, _, want = phrases(rows, 20)
    found, _ = collocations.frequent_phrases(docs, threshold=20)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in found.collect()} == {k: v for k, v in counts.items() if v >= 20}
    got = collocations.collocations(docs, threshold=20, top=50).collect()
    ranked = {}
    for row in sorted(want, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        ranked.setdefault(row[0], []).append(row)
    want = {(g, i + 1, *r[1:]) for g, own in ranked.items() for i, r in enumerate(own[:50])}
    assert {(r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want and len(got) == len(want)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_blocks_count_each_ngram_once(monkeypatch):
    """Cut anywhere, also where a word or a run of blanks is longer than a block."""
    rng = random.Random(2)
    texts = [b" ".join(rng.choice([b"a", b"bb", b"c." * 9, b"d" * 40, b" " * 50]) for _ in range(rng.randrange(40))) for _ in range(30)]
    seeds = np.arange(30, dtype=np.uint64)
    def keys():
        found = Counter()
        for words in collocations.blocks(texts):
            for order, key, ok in collocations.ngrams(words, seeds, range(1, 6), None):
                found.update((order, k) for k in key[ok].tolist())
        return found
    whole = keys()
    for size in (1, 7, 64):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        assert keys() == whole


def test_summary_keeps_whatever_reaches_the_threshold():
    """With no more counters than needed, merged from many small summaries."""
    rng = np.random.default_rng(3)
    keys = collocations._mix(np.concatenate([rng.zipf(1.5, 20_000) % 5000, np.repeat(np.arange(9000, 9030), 100)]).astype(np.uint64))
    rng.shuffle(keys)
    mass = np.bincount((keys >> np.uint64(62)).astype(int), minlength=4)
    merged = collocations.Summary(mass // 100 + 1)
    for part in np.array_split(keys, 50):
        one = collocations.Summary(mass // 100 + 1)
        one.add(part)
        one.settle()
        for p, k, c, taken in one.parts():
            merged.merge(k, c, np.where(np.arange(4) == p, taken, 0))
    kept = {int(k): int(c) + int(merged.taken[p]) for p, ks, cs, _ in merged.parts() for k, c in zip(ks, cs, strict=True)}
    true = Counter(keys.tolist())
    assert merged.taken.max() < 100 and len(merged) <= (mass // 100 + 1).sum()
    assert all(k in kept and kept[k] >= n for k, n in true.items() if n >= 100)


def test_score_beyond_a_long(spark):
    a, n, l, r = 9 * 10**12, 10**14, 10**13, 9 * 10**12
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint")
    got = row.select(collocations.score(*[F.col(c) for c in "anlr"]).alias("s")).first().s
    assert got == 1000 * a * n // (l * r)


# -- mended operators


def test_long_vectors_take_part(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(150)]
    rows += [(200, [2.2e6, 0.0, 0.0, 0.0]), (201, [-2.5e6, 0.25, 0.0, -1e-9]), (202, [2.2e6, 1.0, 0.0, 0.0]), (300, [0.0, 0.0, 3e12, 1e-3])]
    rows += [rows[-2], (203, [float("inf")] * 4), (204, None), (205, [1.0, None, 0.0, 0.0]), (None, [9e9] * 4)]
    got = sorted(map(tuple, vafile.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()))
    whole = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for i, q in whole:
        if i % 100 == 0:
            best = sorted((-sum(map(int.__mul__, q, v)), j) for j, v in whole if j != i)[:10]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(best)]
    assert got == sorted(want)
    big = spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="does not fit a long"):
        vafile.top_k(big).collect()


def test_toxicity_pairs_act_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    held = toxicity.labelled_sample.__globals__["F"].lit(False)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows, _ = toxicity.labelled_sample(docs, labels, "toxic", [0, 1], 500, 4 << 20, held)
    tight, loose = toxicity.fit(rows), toxicity.fit(rows, penalty=0.0)
    assert tight.pairs >= toxicity.PLACED * len(rows) > 0
    text = rows[0][0][:500]

    def spread(model):
        return max(float(np.ptp(model.logits(pa.array([f"{text} {t}" for t in kind])))) for kind in toxicity.IDENTITY)

    assert spread(tight) < 0.05 < spread(loose)


def test_toxicity_gradient_by_plain_loops():
    """The learned weights are a minimum: no small step of one lowers the loss much."""
    rows = [("good words here", 0), ("bad words here", 1), ("good day", 0), ("bad day vile", 1)] * 8
    model = toxicity.fit(rows)
    texts = pa.array([t for t, _ in rows])
    y = np.array([l for _, l in rows])
    assert ((model.scores(texts) >= 0.5) == y).all()
    feature = {t: {int(f) for _, fs in toxicity.present([t]) for f in fs} for t, _ in rows}
    for t in feature:
        known = [model.slots[f] for f in feature[t] if model.slots[f] >= 0]
        assert float(model.logits(pa.array([t]))[0]) == pytest.approx(model.bias + sum(model.weights[s] for s in known))


def test_encoding_needs_few_times_the_text():
    encoder = wavelet.Encoder(path(wavelet.TOKENIZER))
    words = b" ab cd" * 700_000
    encoder.encode([words[:600]])
    tracemalloc.start()
    try:
        ids, n = encoder.encode([b"", words, b"", words[:6]])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    small, _ = encoder.encode([words[:6]])
    assert n.tolist() == [0, 700_000 * len(small), 0, len(small)] and np.array_equal(ids, np.tile(small, 700_001))
    assert most < 8 * len(words)
