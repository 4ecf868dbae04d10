"""Each operator against a brute-force version, with nulls, ties and odd tables."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quayside.llm import (
    decontaminate,
    langid,
    maglev,
    mixing,
    quality,
    simhash,
    suffixes,
    toxicity,
    vafile,
    warc,
)
from quayside.llm.common import held_out
from quayside.llm.samples import _within, labelled_sample

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool):03d}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(4)
    passage = words(rng, 40)
    texts = [words(rng, rng.randrange(5, 120)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[4].replace("w1", "x1", 1), None, "", " \t\n", "short", "short"]
    texts += [words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(6)]
    texts += ["A" * 400, "A" * 200 + "b", words(rng, 6000), "é" * 90 + " ßü", "x" * 49, "x" * 50, "x" * 51]
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 9 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], None, None, None), (rows[8][0], words(rng, 50), "en", "s1", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


def brute_suffixes(rows):
    out, seen = [], set()
    order = sorted({r[0] for r in rows if r[0] is not None}) + [None]
    for doc in order:
        own = [(r[1] or "").encode() for r in rows if r[0] == doc]
        for b in own:
            gone = bytearray(len(b))
            for p in range(len(b) - 49):
                if b[p : p + 50] in seen:
                    gone[p : p + 50] = b"\1" * 50
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
            out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        for b in own:
            seen |= {b[p : p + 50] for p in range(len(b) - 49)}
    return sorted(out, key=repr)


def test_suffixes_equal_brute_force(spark, corpus):
    docs, rows = corpus
    got = suffixes.repeated_bytes(docs.withColumn("n_bytes", F.lit(1)).withColumn("tid", F.lit("x")))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffixes(rows)


def test_only_the_first_holder_of_a_text_is_compared(spark, monkeypatch):
    def single(session):
        session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    monkeypatch.setattr(suffixes, "bounded_batches", single)
    rng = random.Random(21)
    early, a, b, c = (words(rng, 30) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (2, early), (3, early + " " + c), (7, c), (7, early + " " + c), (7, b[:60] + c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(len(rows))
    try:
        got = suffixes.repeated_bytes(docs)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffixes(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def test_suffixes_split_hot_tokens(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE_PER_PARTITION", 100_000)
    rng = random.Random(9)
    line = words(rng, 12)
    rows = [(i, f"{words(rng, 9)} {line} {words(rng, 9)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    real = suffixes._route

    def watched(n, splitters, hot):
        found.append(len(hot))
        return real(n, splitters, hot)

    monkeypatch.setattr(suffixes, "_route", watched)
    got = suffixes.repeated_bytes(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_suffixes(rows)
    assert found == [found[0]] and found[0] > 0


def test_multikey_sort_is_the_order_of_the_bytes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3, (500, 19), dtype=np.uint8)
    order, same = suffixes.multikey_sort(suffixes.tokens(rows))
    plain = [r.tobytes() for r in rows]
    assert [plain[i] for i in order] == sorted(plain)
    assert same.tolist() == [i > 0 and plain[order[i]] == plain[order[i - 1]] for i in range(500)]


def test_anchors_depend_on_content_alone():
    rng = random.Random(2)
    middle = words(rng, 30).encode()
    a, b = words(rng, 20).encode() + middle, b"?" + words(rng, 7).encode() + middle
    found = []
    for t in (a, b):
        at, first, last, _ = suffixes.anchors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        own = {int(s) - len(t) + len(middle): int(p - s) for p, f, e in zip(at, first, last, strict=True) for s in range(f, e + 1)}
        found.append({s: o for s, o in own.items() if s >= 0})
    assert found[0] == found[1] and len(found[0]) == len(middle) - 49


# -- decontamination ---------------------------------------------------------


def test_decontamination_spans_map_to_the_original(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = "Ü—x! ONE, two;three (four) five six seven\neight nine ten eleven twelve thirteen end é"
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "", 5), (4, "Alpha beta?", 5)], "doc_id int, text string, contamination int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, "alpha BETA"), (9, None), (10, "!!")], "item_id int, text string")
    out, name = decontaminate.find_contamination(docs, bench)
    assert name != "contamination" and "contamination" in out.columns
    rows = {r.doc_id: r[name] for r in out.collect()}
    assert (rows[1].n_words, rows[1].n_hit, rows[1].items) == (16, 13, ["7"])
    assert [text[s.start : s.end] for s in rows[1].spans] == [text[text.index("ONE") : text.index(" end")]]
    assert (rows[2].n_words, rows[2].n_hit, rows[3].n_words) == (0, 0, 0)
    assert (rows[4].n_hit, rows[4].items) == (2, ["8"])


def test_sliced_benchmark_gives_the_same(spark, corpus):
    docs, rows = corpus
    items = [(i, r[1][:120]) for i, r in enumerate(rows) if r[1] and len(r[1]) > 60][:30]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one, a = decontaminate.find_contamination(docs, bench)
    many, b = decontaminate.find_contamination(docs, bench, slice_bytes=900)
    rows_of = lambda d, n: sorted(((r.doc_id, r.text, r[n].asDict(True)) for r in d.collect()), key=repr)
    assert rows_of(one, a) == rows_of(many, b)
    none, c = decontaminate.find_contamination(docs, bench.limit(0))
    assert none.where(F.col(c)["n_hit"] > 0).count() == 0 and none.count() == len(rows)


# -- archives ----------------------------------------------------------------


def test_archives_round_trip(spark, folder):
    long, short = "<p>é</p>" * 300, "tiny"
    rows = [(1, "http://a/ x\r\ny", long), (5, None, long), (3, "u", long), (2, "u", short), (4, "u", short), (6, "u", None), (7, "u", "")]
    rows += [(8, "u", "<i>" + "z" * 3_000_000), (8, "u", "other" * 300), (None, "u", long), (9, "u", "n" * 999), (10, "u", "n" * 999)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).repartition(3)
    listed = warc.write_archives(pages)
    back = warc.read_archives(listed, payloads=True).collect()
    assert sum(r.records for r in listed.collect()) == len(rows) == len(back)
    digest = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted(((i, len((t or "").encode()), digest(t), "revisit" if t == long and i != 5 else "response", 5 if t == long and i != 5 else None) for i, _, t in rows), key=repr)
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr) == want
    assert all(digest_of == hashlib.sha1(bytes(r.payload)).hexdigest() for r in back if r.payload is not None for digest_of in [r.payload_digest])
    path = listed.first().path.removeprefix("file:")
    assert open(path, "rb").read(4) == bytes.fromhex("5d2a4d18")
    assert warc.write_archives(pages.limit(0)).count() == 0


def test_small_archives_hold_raw_dictionaries(tmp_path):
    w = warc.ArchiveWriter(str(tmp_path / "a.warc.zst"))
    page = {"id": 1, "url": "u", "refers_to": None, "date": "2024-01-01T00:00:00Z"}
    w.add(warc.record(page, b"body"))
    w.close()
    assert [r["payload"] for r in warc.read_archive(w.path)] == [b"body"]
    whole = (tmp_path / "a.warc.zst").read_bytes()
    (tmp_path / "b.warc.zst").write_bytes(whole[:-3])
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path / "b.warc.zst")))


# -- mixing ------------------------------------------------------------------


def test_targets_stop_at_the_cap_and_reshare():
    assert mixing.cyclic_weights(["b", None, "a", "c", "é"]) == {"a": 1, "b": 2, "c": 3, "é": 1, None: 2}
    got = mixing.capped_targets({"a": 100, "b": 10, "c": 90}, {"a": 1, "b": 2, "c": 3})
    assert got == {"a": 42.5, "b": 30.0, "c": 127.5}
    assert mixing.capped_targets({}, {}) == {} and mixing.capped_targets({"a": 0}, {"a": 1}) == {"a": 0.0}
    assert sum(mixing.whole_quotas({"a": 1.4, "b": 1.3, "c": 1.3}).values()) == 4


def test_flow_prefers_text_that_is_not_repeated():
    patterns = {("a",): 10, ("b",): 10, ("a", "b"): 20}
    flow = mixing.route(patterns, {"a": 30, "b": 10})
    assert flow[(("a",), "a")] == 10 and flow[(("a", "b"), "a")] == 20 and flow[(("b",), "b")] == 10
    flow = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": 25, "b": 5})
    sent = {p: sum(v for (q, _), v in flow.items() if q == p) for p in ((("a",)), ("a", "b"))}
    assert sent == {("a",): 15, ("a", "b"): 15}  # the price rises, so both repeat alike


def test_sources_that_share_nothing_are_solved_apart():
    patterns = {(f"s{i}",): 10 for i in range(20_000)} | {("s0", "s1"): 4, ("elsewhere",): 7}
    flow = mixing.route(patterns, {f"s{i}": 5 + 20 * (i % 2) for i in range(20_000)})
    assert flow[(("s2",), "s2")] == 5 and flow[(("s3",), "s3")] == 25
    assert sum(v for (_, s), v in flow.items() if s == "s0") == 5
    assert sum(v for (_, s), v in flow.items() if s == "s1") == 25
    assert not any("elsewhere" in p for p, _ in flow)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randrange(1, 60)), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += [(9001, None, "s1"), (9002, "", None), (9003, "one two", None), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("mix", F.lit(0))
    mixed, name, plan = mixing.mix(docs, F.array("source"))
    got = mixed.select("doc_id", "source", F.col(name)["size"].alias("size"), F.col(name)["taken"].alias("taken")).collect()
    again = mixing.mix(docs.repartition(7), F.array("source"))
    assert sorted(map(repr, got)) == sorted(repr(r) for r in again[0].select("doc_id", "source", F.col(again[1])["size"].alias("size"), F.col(again[1])["taken"].alias("taken")).collect())
    assert len(got) == len(rows)
    for s, target in plan.targets.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= max(3, 0.01 * target)
    assert all(r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size for r in got if r.size)
    assert all(r.size == len((dict((a, b) for a, b, _ in rows)[r.doc_id] or "").split()) for r in got)
    empty, name, plan = mixing.mix(docs.limit(0), F.array("source"))
    assert empty.count() == 0 and plan.targets == {}


def test_a_long_document_does_not_end_the_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(20, 120), "a") for i in range(4000)]
    rows += [(9000 + i, "w " * n, "a") for i, n in enumerate((90_000, 60_000, 30_000, 10_000))]
    rows += [(9100, "w " * 4000, "a")] * 3 + [(9200, "w " * 400_000, "b")]
    # All that is left of this one fits behind the long document.
    rows += [(10_000 + i, "w", "c") for i in range(400)] + [(9300, "w " * 5000, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for seed in range(6):
        mixed, name, plan = mixing.mix(docs, F.array("source"), weights=lambda s: {"a": 1, "b": 3, "c": 0.0136}, seed=seed)
        taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col(name)["taken"]).alias("n")).collect()}
        assert plan.targets["a"] - 25 <= taken["a"] <= plan.targets["a"] + 1 and taken["c"] == 400


def test_rows_of_two_sources_are_picked_apart(spark):
    rows = [(i, f"w{i} " * 10, s) for i in range(300) for s in ("a", "b")] + [(1000 + i, "w " * 10, "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed, name, plan = mixing.mix(docs, F.array("source"), weights=lambda s: {"a": 1, "b": 4, "c": 1})
    copies = F.col(name)["copies"]
    assert plan.targets == {"a": 1500.0, "b": 6000.0, "c": 1500.0}
    assert {r.copies for r in mixed.where("source = 'b'").select(copies.alias("copies")).collect()} == {2}
    assert mixed.where("source = 'a'").agg(F.sum(copies)).first()[0] == 150


def test_overlapping_sources_share_a_document(spark):
    rows = [(i, "w " * 10, ["a"] if i < 20 else ["b", "a"]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sources array<string>")
    mixed, name, plan = mixing.mix(docs, F.col("sources"), weights=lambda s: {"a": 1, "b": 1})
    assert plan.sizes == {"a": 400, "b": 200}
    assert plan.targets == {"a": 200.0, "b": 200.0}
    assert mixed.agg(F.sum(F.col(name)["taken"])).first()[0] == 400


# -- SimHash -----------------------------------------------------------------


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, radius=3):
    parent = list(range(len(values)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(a) for a in range(len(values))]


def test_simhash_equals_brute_force(spark, corpus):
    docs, rows = corpus
    prints = docs.withColumn("root", F.lit(1)).withColumn("fp", simhash.fingerprints(F.col("text")))
    got = simhash.cluster(prints).withColumn("hex", simhash.fingerprint_hex(F.col("fp"))).collect()
    values = [slow_fingerprint(r[1]) for r in rows]
    group = brute_components(values)
    least = {g: min((r[0] for r, x in zip(rows, group, strict=True) if x == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{v:016x}", least[g]) for r, v, g in zip(rows, values, group, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("limit", [1 << 15, 8])
def test_links_connect_all_that_is_near(spark, limit):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(6):
        v = rng.getrandbits(64)
        for _ in range(60):
            values.add(v)
            if rng.random() < 0.7:
                v ^= 1 << rng.randrange(64)
            else:
                values.add(v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), limit=limit).collect()
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    group = brute_components(values)
    named = [roots.get(v, v) for v in signed]
    assert len(set(group)) == len(set(named)) == len(set(zip(group, named, strict=True)))


def test_bit_slices_count_as_plain_distances():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    values = np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(700)], np.uint64)
    for radius in (0, 1, 3, 5):
        rows = simhash.near(values, simhash.bit_planes(values), values, list(range(64)), radius)
        marks = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")[:, :700]
        assert (marks == (np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)).all()
        links = simhash.forest(values, list(range(64)), radius)
        group = dict(zip(map(int, values), brute_components([int(v) for v in values], radius), strict=True))
        distinct = {int(v) for v in values}
        assert len(links) < 700 and all(group[a] == group[b] for a, b in links)
        assert len({a for a, _ in links} | distinct) - len({b for _, b in links} - {a for a, _ in links}) == len(set(group.values()))


def test_one_of_each_group_stays(spark, corpus):
    docs, rows = corpus
    kept = simhash.one_of_each(docs.withColumn("root", F.lit(2)).withColumn("__fp", F.lit(2)))
    assert kept.columns == docs.columns + ["root", "__fp"]
    values = [slow_fingerprint(r[1]) for r in rows]
    assert kept.count() == len(set(brute_components(values)))
    assert simhash.one_of_each(docs.limit(0)).count() == 0


# -- classifiers -------------------------------------------------------------


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int, quality int")


def test_toxicity_holds_on_unseen_rows_and_ignores_mentions(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        toxic = i % 4 == 0
        text = words(rng, 30) + (" " + rng.choice(["vilething", "vileness", "rotten"]) if toxic else "")
        # Mentions of one group go with the label in the sample, without being its cause.
        if rng.random() < (0.8 if toxic else 0.1):
            text += " my muslim neighbour"
        rows.append((text, int(toxic)))
    docs, labels = labelled(spark, rows)
    held = held_out(F.col("doc_id"), 5, 0)
    assert {r.doc_id for r in docs.where(held).collect()} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    model = toxicity.train(docs, labels, held)
    odd = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "my muslim neighbour"), (-4, "vile " * 200_000)], "doc_id bigint, text string"))
    got = {r.doc_id: r.s for r in odd.select("doc_id", toxicity.score(odd, model, F.col("text")).alias("s")).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows))
    assert got[-1] == got[-2] and all(0 <= s <= 1 for s in got.values()) and got[-3] < 0.5
    loose, tight = toxicity.fit(rows, penalty=0.0), toxicity.fit(rows)
    change = lambda m: abs(float(np.diff(m.logits(pa.array(["my muslim neighbour", "my hindu neighbour"])))[0]))
    assert change(tight) < change(loose)


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    never = F.lit(False)
    for m in (toxicity, quality):
        scores = [r[0] for r in docs.select(m.score(docs, m.train(docs, none, never), F.col("text"))).collect()]
        assert scores[0] == scores[1] and 0 <= scores[0] <= 1
    model = langid.train(docs.withColumn("lang", F.lit(None).cast("string")), never)
    assert [r[0].lang for r in docs.select(langid.identify(docs, model, F.col("text"))).collect()] == ["und", "und"]
    assert docs.limit(0).select(langid.identify(docs, model, F.col("text")).alias("x")).count() == 0


def test_byte_bound_thins_all_classes_of_a_sample(spark):
    rng = random.Random(12)
    rows = [(words(rng, 100), 0) for _ in range(3000)] + [(words(rng, 400), 1) for _ in range(60)]
    docs, labels = labelled(spark, rows)
    take = lambda per_class, max_bytes: labelled_sample(docs, labels, "toxic", [0, 1], per_class, max_bytes, F.lit(False))
    got, counts = take(50, 100_000)
    assert counts == {0: 3000, 1: 60} and len(got) == len({t for t, _ in got})
    n = {y: sum(1 for _, z in got if z == y) for y in (0, 1)}
    assert n[0] == 50 and n[1] == 37 and sum(len(t) for t, _ in got) <= 100_000
    # What the rare class leaves of its share goes to the common one.
    got, _ = take(3000, 300_000)
    assert sum(y for _, y in got) == 60 and sum(len(t) for t, y in got if not y) > 180_000 - 1000
    got, _ = take(3000, 1000)
    assert [y for _, y in got].count(1) == 1


def test_long_text_does_not_end_a_class(spark):
    assert _within({0: [(1, 10), (2, 90), (3, 10)], 1: [(4, 5)]}, 60) == [4, 1, 3]
    assert _within({0: [(1, 70), (2, 60)], 1: [], 2: [(3, 10)] * 3}, 40) == [3, 3, 2] and _within({0: []}, 9) == []


def test_languages_are_told_apart_and_odd_texts_are_not(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ba", "lo", "mi"], "bb": ["kru", "zent", "ock"], "cc": ["ño", "ció", "lla"]}
    make = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(i, make(lang := list(syllables)[i % 3], rng.randrange(3, 40)), lang) for i in range(600)]
    rows += [(1001, None, "aa"), (1002, "", "aa"), (1003, "12 … !!", "aa"), (1004, make("bb", 50_000), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    held = held_out(F.col("doc_id"), 4, 2)
    model = langid.train(docs, held)
    got = {r.doc_id: r.x for r in docs.select("doc_id", langid.identify(docs, model, F.col("text")).alias("x")).collect()}
    assert np.mean([got[i].lang == lang for i, _, lang in rows[:600] if zlib.crc32(str(i).encode()) % 4 == 2]) > 0.97
    assert all(got[i].lang == "und" and got[i].score == 0 and got[i].rejected for i in (1001, 1002, 1003))
    assert got[1004].lang == "bb" and 0 <= got[1004].score <= 1


def test_quality_holds_on_unseen_rows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(700):
        good = i % 5 > 0
        text = words(rng, rng.randrange(20, 200))
        rows.append((text if good else words(rng, 60) + " " + " ".join([f"W{rng.randrange(9)}!!"] * 80), int(good)))
    docs, labels = labelled(spark, rows)
    held = held_out(F.col("doc_id"), 5, 0)
    model = quality.train(docs, labels, held)
    odd = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "w " * 300_000)], "doc_id bigint, text string"))
    got = {r.doc_id: r.s for r in odd.select("doc_id", quality.score(odd, model, F.col("text")).alias("s")).collect()}
    assert np.mean([(got[i] >= quality.THRESHOLD) == bool(y) for i, (_, y) in enumerate(rows)]) > 0.97
    assert got[-1] == got[-2] and all(0 <= s <= 1 for s in got.values())


def test_every_passage_counts():
    data = np.frombuffer(("a " * 100 + "B! " * 30).encode(), np.uint8)
    owner, x = quality.passages(data, np.array([0, 0, len(data), len(data)]))
    assert owner.tolist() == [0, 1, 1, 1, 1, 2]
    assert not x[0, 1:].any() and x[4, 2] > 0.4 and x[1, 2] == 0


# -- vectors -----------------------------------------------------------------


def brute_top(rows, every, k=10):
    usable = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable[i] = np.floor(np.array(v, np.float32).astype(np.float64) * 1024).astype(np.int64)
    out = []
    for q in usable:
        if q % every:
            continue
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(30)]  # ties
    rows += [(1000, None), (1010, [1.0, None]), (1020, [float("nan")] * 12), (1030, [float("inf")] * 12), (None, [0.5] * 12)]
    rows += [(2000, [3.0, -4.0]), (2001, [1.0, 1.0]), (2010, []), (2020, []), (3000, [0.0] * 12), (3010, [900.0] * 12), (3020, [3e5] * 12)]
    rows += [rows[20], rows[20]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    got = vafile.top_k(table, every=10)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 10)
    index = vafile.VectorFile.build(table)
    asked = index.rows.where("id % 10 = 0").select("id", "dims", "exact")
    blocks = index.search(asked, block=16)
    assert sorted(tuple(r) for r in blocks.collect()) == brute_top(rows, 10)
    assert vafile.top_k(table.limit(0)).count() == 0


# -- sharding ----------------------------------------------------------------


def slow_table(names, slots):
    orders = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        at, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        orders.append(iter([(at + j * step) % slots for j in range(slots)]))
    out = {}
    while len(out) < slots:
        for i, o in enumerate(orders):
            if len(out) < slots:
                out[next(s for s in o if s not in out)] = i
    return [out[i] for i in range(slots)]


def test_table_is_filled_in_turns():
    names = ["a", "b", "c", "d", "e"]
    table = maglev.lookup_table(names, 101)
    assert table == slow_table(names, 101)
    share = np.bincount(table)
    assert share.max() - share.min() <= 1
    fewer = maglev.lookup_table(names[:-1], 10007)
    before = maglev.lookup_table(names, 10007)
    moved = sum(a != b for a, b in zip(before, fewer, strict=True) if a != 4)
    assert moved < 0.1 * 10007
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.lookup_table(bad, 101)
    with pytest.raises(ValueError):
        maglev.lookup_table(names, 100)


def test_sharding_keeps_all_rows_and_columns(spark, corpus):
    docs, rows = corpus
    out = maglev.assign_shards(docs.withColumn("shard", F.lit("mine")).withColumn("a.b", F.lit(1)), shards=7, slots=997)
    assert out.columns == [*docs.columns, "shard", "a.b", "shard_"] and out.count() == len(rows)
    assert out.where("shard_ IS NULL OR shard <> 'mine'").count() == 0
    assert out.groupBy("doc_id").agg(F.countDistinct("shard_").alias("n")).where("n > 1").count() == 0
    table = maglev.lookup_table([f"shard-{i}" for i in range(7)], 997)
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    for r in out.where("doc_id IS NOT NULL").collect():
        assert r.shard_ == table[signed(str(r.doc_id)) % 997]
    assert json.dumps(maglev.assign_shards(docs.limit(0)).columns)
