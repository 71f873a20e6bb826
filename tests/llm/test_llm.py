"""The training-data operators against plain versions, and all of them on awkward tables."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cueloom.llm import bpe, language_id, licenses, mixing, ngram_join, order_minhash, pii, token_counts, toxicity
from cueloom.llm import progressive_jpeg as jpeg
from cueloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs home to sleep in the warm sun"
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, ENGLISH, "en", "a", len(ENGLISH)),
    (4, ENGLISH, "en", "a", len(ENGLISH)),
    (5, ENGLISH, "de", None, len(ENGLISH)),
    (6, LONG, "en", "b", len(LONG)),
    (7, "x" * 50_000, "en", "b", 50_000),
    (None, "no id here, but four words", "fr", "b", 26),
    (8, "😀 日本 é <|endoftext|> 123 4", "ja", "c", 25),
    (9, "a", None, "c", 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    clash = {"n_tokens": F.lit("mine"), "score": F.lit("mine"), "spans": F.lit(1), "media": F.lit("m"), "epoch": F.lit("e"), "sig": F.lit(0), "ids": F.lit(0), "fingerprint": F.lit(2)}
    return spark.createDataFrame(AWKWARD, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(tmp_path, df, labels=()):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    df.sparkSession.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


OPS = sorted(n for n in entry.queries() if n.startswith("op"))


def test_ten_operators_and_the_pipeline():
    assert [n.split("_")[0] for n in sorted(OPS, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)] and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [*OPS, "pipeline"])
def test_awkward_and_empty_tables(spark, awkward, empty, tmp_path, name):
    (tmp_path / "a").mkdir(), (tmp_path / "e").mkdir()
    full = entry.queries()[name](spark, table(tmp_path / "a", awkward, [(4, 1, 1), (6, None, None), (None, 1, 0)])).collect()
    none = entry.queries()[name](spark, table(tmp_path / "e", empty)).collect()
    assert none == []
    if name not in ("op4_temperature_mixing", "op7_license_scan", "pipeline"):
        assert len(full) == len(AWKWARD)
        assert sorted(r.doc_id for r in full if r.doc_id) == sorted(r[0] for r in AWKWARD if r[0])


@pytest.mark.parametrize("name", ["op4_temperature_mixing", "op7_license_scan"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = lambda r: sorted(map(tuple, r), key=repr)
    assert rows(df.select(columns).collect()) == rows(duckdb.sql(entry.oracle_sql()[name]).project(", ".join(columns)).fetchall())


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_jpeg_round_trip_and_general_decoder(monkeypatch):
    r = random.Random(0)
    payloads = [jpeg.padded(t) for t in (b"", b"x", bytes(range(256)), r.randbytes(64 * 37), b"a" * 4000)]
    files = [jpeg.encode(p) for p in payloads]
    images = [jpeg.decode(f) for f in files]
    assert [jpeg.payload_of(i) for i in images] == payloads
    assert all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in files)
    monkeypatch.setattr(jpeg.Huffman, "fixed_bits", property(lambda s: 0))
    for f, i in zip(files, images, strict=True):
        assert all((a.coefficients == b.coefficients).all() for a, b in zip(i.components, jpeg.decode(f).components, strict=True))


def test_jpeg_pixels_match_the_definition():
    image = jpeg.decode(jpeg.encode(jpeg.padded(b"some words of text to look at")))
    c = image.components[0]
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = c.coefficients[0]
    block = block.reshape(8, 8)
    k = np.where(np.arange(8) == 0, np.sqrt(0.5), 1)
    cos = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * k / 2
    want = np.clip(cos @ block @ cos.T + 128, 0, 255)
    sums = c.coefficients[:1].astype(float) @ jpeg.BASIS / (1 << 13) + 128
    assert np.abs(np.clip(sums.reshape(8, 8), 0, 255) - want).max() < 0.6
    assert image.rgb().shape == (16, 16, 3)


def test_jpeg_damage_is_null(spark):
    df = spark.createDataFrame([(bytearray(b"no image"),), (None,)], "media binary")
    assert [r.rgb for r in jpeg.decode_media(df).collect()] == [None, None]


# --- 2 and 9 --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    bits = ["a", "b", " ", "  ", "\n", "\n\n", ".", ",", "'s", "<|endoftext|>", "é", "²", "5", "\t", " ", "日", "😀", "!", "_", "the", "ing", "\r\n", " "]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 50))) for _ in range(4000)] + ["a" * 3000, "the" * 2000, " " * 500, "\n" * 99]


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(token_counts.tokenizer_path(token_counts.TOKENIZER))


def test_counts_equal_the_library(texts, library):
    count = token_counts.counter(token_counts.tokenizer_path(token_counts.TOKENIZER), 1000)
    assert count(texts) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all("".join(token_counts.safe_pieces(t)) == t and "".join(token_counts.fine_pieces(t)) == t for t in texts)


def test_bpe_equals_the_library(texts, library):
    own = bpe.load(token_counts.tokenizer_path(bpe.TOKENIZER))
    ids = own.encode(texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in ids] == texts


def test_both_trees_agree():
    own = bpe.load(token_counts.tokenizer_path(bpe.TOKENIZER))
    r = random.Random(5)
    words = list({bytes(r.choice(b"abetionsh ") for _ in range(r.randint(1, 16))) for _ in range(300)})
    assert own.merge_many(words, 16) == [own.merge_one(w) for w in words]


# --- 3 --------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    """Selects from a sorted list for each function."""
    h = order_minhash.kmers(order_minhash.code_points(text))
    base = order_minhash.numbered(h) >> np.uint64(32)
    out = []
    for s, f in zip(order_minhash._SEEDS.tolist(), order_minhash._FACTORS.tolist(), strict=True):
        best = sorted(((int(b) ^ s) * f & 0xFFFFFFFF, i) for i, b in enumerate(base.tolist()))[:2]
        at = sorted([i for _, i in best] + [-1] * (2 - len(best)))
        first = h[at[0]] if at[0] >= 0 else np.uint64(0)
        with np.errstate(over="ignore"):
            out.append(int(order_minhash._mix(np.array([first * np.uint64(0xE7037ED1A0B428DB) + h[at[1]]], np.uint64))[0] >> np.uint64(48)))
    return out


def test_fingerprints():
    r = random.Random(2)
    for n in (1, 5, 8, 9, 50, 3000):
        t = "".join(r.choice("abcd é") for _ in range(n))
        assert order_minhash.fingerprint(t).tolist() == plain_fingerprint(t)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(2000)) for _ in range(2))
    e = a[:1500] + b[:500]
    own, other = order_minhash.both_fingerprints(order_minhash.code_points(a), order_minhash.code_points(e), 1500)
    assert own.tolist() == order_minhash.fingerprint(a).tolist() and other.tolist() == order_minhash.fingerprint(e).tolist()
    moved = a[1000:] + a[:1000]
    like = lambda x: order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(x))
    assert like(a) == 1 and like(a[:900] + "zz" + a[902:]) > 0.9 and like(b) < 0.1 and like(moved) < 0.85
    repeated = order_minhash.numbered(order_minhash.kmers(order_minhash.code_points("abcdefgh" * 4)))
    assert len(set(repeated.tolist())) == len(repeated)


def test_next_document_wraps(spark):
    rows = {r.doc_id: r for r in order_minhash.op3_order_minhash(spark, SF).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(t) // 4
        assert rows[k].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        assert rows[k].fingerprint == order_minhash.as_hex(order_minhash.fingerprint(t))


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_mixing_limits(spark):
    rows = [(i, "w " * 10, None, "big" if i % 10 else f"s{i % 3}", 20) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, repetition=2.0)
    times = {r.source: (r.n, r.ids, r.most) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), (F.max("epoch") + 1).alias("most")).collect()}
    assert times["big"] == (2700, 2700, 1)
    assert all(n <= 2 * 100 and ids == 100 and n > 190 for s, (n, ids, most) in times.items() if s != "big")
    budgeted = mixing.mix(df, repetition=3.0, budget=3000.0)
    words = budgeted.select(F.sum(mixing.tokens())).first()[0]
    assert 0.98 * 3000 <= words <= 3000
    plan, _ = mixing.plan(df, None, entropy=0.5)
    p = [r.weight for r in plan.collect()]
    assert abs(-sum(x * np.log(x) for x in p) - 0.5 * np.log(len(p))) < 0.01


def test_mixing_with_salted_join(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, mixing.mix(df).select("doc_id", "epoch", "row_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(df).select("doc_id", "epoch", "row_key").collect())) == want


# --- 5 --------------------------------------------------------------------------------------------------------------


def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_classes(rows):
    sets = dict(zip([r[0] for r in rows], plain_sets([r[1] for r in rows]), strict=True))
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed, n):
    r = random.Random(seed)
    bases = [[f"w{r.randrange(400)}" for _ in range(r.choice([3, 5, 30, 120]))] for _ in range(8)]
    passage = [f"p{i}" for i in range(25)]
    rows = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = f"w{r.randrange(400)}"
        if r.random() < 0.3:
            w += passage
        rows.append((i * 3, " ".join(w).title() if r.random() < 0.3 else "\n".join(w), "en", "s", 0))
    return rows


@pytest.mark.parametrize(("seed", "block", "broadcast"), [(0, 1024, 400_000), (1, 4, 400_000), (2, 7, 0)])
def test_near_duplicates(spark, monkeypatch, seed, block, broadcast):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", broadcast)
    rows = near_copies(seed, 160)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == plain_classes(rows)


def test_divide_skip_finds_all_links():
    sets = ngram_join.shingle_sets([r[1].encode() for r in near_copies(5, 120)])
    sets = [np.frombuffer(x, dtype=np.uint64) for x in {s.tobytes() for s in sets} if x]
    index = ngram_join.Index(sets)
    plain = [set(s.tolist()) for s in sets]
    for q, a in enumerate(plain):
        want = {r for r, b in enumerate(plain) if r != q and 100 * len(a & b) >= 80 * len(a | b)}
        assert set(index.linked(q).tolist()) == want


def plain_first(sets):
    plain, root = [set(s.tolist()) for s in sets], list(range(len(sets)))
    for i, a in enumerate(plain):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & plain[j]) >= 80 * len(a | plain[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_classes_of_drifting_chains():
    r = np.random.default_rng(1)
    for _ in range(150):
        sets = []
        for _ in range(int(r.integers(1, 4))):
            s = r.integers(0, 1 << 63, 60).astype(np.uint64)
            for _ in range(int(r.integers(2, 9))):
                sets.append(np.unique(s))
                s = np.concatenate([s[5:], r.integers(0, 1 << 63, 5).astype(np.uint64)])
        sets = [sets[i] for i in r.permutation(len(sets))]
        assert ngram_join.classes(sets) == plain_first(sets)


def test_bitmaps_bound_differences():
    r = np.random.default_rng(0)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, 20).astype(np.uint64)]))
        assert ngram_join.hamming(ngram_join.bitmap(a), ngram_join.bitmap(b)) <= len(np.setxor1d(a, b))


def test_groups_that_straddle_a_power_of_two_meet():
    r = np.random.default_rng(2)
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    for _ in range(300):
        a = new(116)  # 256 bits; both leaders have 512
        lead, b = np.concatenate([a, new(13)]), np.concatenate([a[:109], new(20)])
        assert 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) and 100 * len(np.intersect1d(lead, b)) < 80 * len(np.union1d(lead, b))
        groups = [(1, 10, 116, 129, ngram_join.hamming(ngram_join.bitmap(a), ngram_join.bitmap(lead)), ngram_join.bitmap(lead)), (1, 20, 129, 129, 0, ngram_join.bitmap(b))]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*groups, strict=True)], names=["h", "g", "low", "high", "radius", "bits"])
        assert sum(x.num_rows for x in ngram_join._may_link(iter([batch]))) == 1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in {x for e in edges if e[0] != e[1] for x in e}}


# --- 6, 10: learned ---------------------------------------------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    got = language_id.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_texts_without_letters_are_und(spark):
    model = language_id.Hierarchy(language_id.features([b"the cat and the dog", b"der hund und die katze", b"le chat et la souris"] * 3), ["en", "de", "fr"] * 3)
    df = spark.createDataFrame([("123 !",), (None,), ("",), ("the dog and the cat",), ("die katze und der hund",)], "text string")
    assert [r.lang_pred for r in language_id.identify(df, model).collect()] == ["und", "und", "und", "en", "de"]


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "Hierarchy", lambda x, langs: (len(x), set(langs)))
    df = spark.createDataFrame([(i, f"some words {i}", f"l{i % 230}") for i in range(460)], "doc_id long, text string, lang string")
    assert language_id.learn(df) == (460, {f"l{i}" for i in range(230)})


def test_toxic_wording_is_found():
    r = random.Random(4)
    words = ["".join(r.choice("aeinorstl") for _ in range(r.randint(2, 8))) for _ in range(900)]
    bad = ["grumfle", "snortwick", "blarghus", "vexnitz"]

    def text(toxic):
        w = [r.choice(words) for _ in range(120)]
        for _ in range(5 * toxic):
            w[r.randrange(120)] = r.choice(bad)
        return " ".join(w)

    model = toxicity.Model([(text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)])
    hits = [(y, model.score(text(y))) for y in (0, 1) * 60]
    assert sum((s >= 0.5) == bool(y) for y, s in hits) / len(hits) > 0.9
    assert toxicity.Model([]).score("x") == 0 and toxicity.Model([("a", 1)]).score("") == 1


# --- 7 --------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    rows = [(1, "some more words that stand before the notice here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released UNDER the -- mit License"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "licensed under nothing"), (5, None)]
    got = {(r.doc_id, r.license): (r.n_units, r.best_score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"): (1, 1.0), (2, "MIT"): (1, 1.0), (3, "GPL-3.0"): (1, 1.0)}


# --- 8 --------------------------------------------------------------------------------------------------------------

RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    ok = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k, rule in enumerate(RULES) for m in re.finditer(rule, t) if ok[k](m)]


def test_base_spans_follow_the_rules():
    r = random.Random(6)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    for _ in range(6000):
        t = "".join(r.choice("a1@.-+ ()%05") for _ in range(60))
        assert pii.base_spans(t) == plain_spans(t)


def test_model_adds_forms_that_the_rules_miss():
    text = "call (858) 555-7280 or write to bob77 (at) foo.com now, card 4539.5787.6362.1486 or a@b.com"
    base, every = pii.find_spans([text, "", "plain words only"], pii.trained())
    found = {(pii.KINDS[k], text[a:b]) for k, a, b in every[0]}
    assert set(base[0]) <= set(every[0]) and ("phone", "(858) 555-7280") in found and len(found) >= 3
    assert every[1:] == [[], []]
    assert pii.redacted("x a@b.com y", [(0, 2, 9)]) == "x [EMAIL] y"


def test_windows_cover_all_digits():
    r = random.Random(7)
    for _ in range(300):
        t = "".join(r.choice("ab 1") if r.random() < 0.1 else "x" for _ in range(r.randint(0, 700)))
        starts = pii.window_starts(t)
        assert all(any(s <= m.start() < s + pii.WINDOW for s in starts) for m in re.finditer("[0-9@]", t))


def test_spelled_out_addresses_without_digits():
    for address in ("jane.smith (at) example.com", "jane[at]example.org"):
        text = "plain words stand here " * 9 + f"so write to {address} about it " + "and more words follow " * 9
        assert [text[a:b] for _, a, b in pii.find_spans([text], pii.trained())[1][0]] == [address]
    t = "no digit here " * 40
    assert {p for s in pii.window_starts(t) for p in range(s, s + pii.WINDOW)} >= set(range(len(t)))


def test_training_learns():
    x, y = pii._snippets(100, pii.WINDOW, 99)
    p = pii.trained().decode(x)
    assert (p == y).mean() > 0.95


# --- Pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, f"{ENGLISH} number {i} of many others that differ in words w{i} v{i} u{i} t{i} s{i} r{i} q{i} p{i}", "en", f"s{i % 3 and 1}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, "12345 !!!", "en", "s0", 1), (102, "write to jo@mail.example.com or call +1 (858) 555-7280 about this small matter", "en", "s1", 1)]
    sf = table(tmp_path, spark.createDataFrame(rows, DOCS))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {101}
    unique = corpus_pipeline.near_duplicates(spark, kept, sf)
    classes = plain_classes([r for r in rows if r[0] != 101])
    assert sorted(r.doc_id for r in unique.collect()) == sorted(k for k, (_, c) in classes.items() if k == c)
    clean = corpus_pipeline.personal_data(spark, unique, sf)
    hit = clean.where("doc_id = 102").first()
    assert hit.text == "write to [EMAIL] or call [PHONE] about this small matter" and hit.n_chars == len(hit.text)
    mixed = corpus_pipeline.mixture(spark, clean, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    last = corpus_pipeline.run(spark, sf).collect()
    assert len(last) == mixed.count() and next(r for r in last if r.doc_id == 102).decoded_sha256 == hashlib.sha256(hit.text.encode()).hexdigest()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "encoding"]


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_without_languages_keeps_texts_with_letters(spark, tmp_path, lang):
    rows = [(i, t, lang, "s", 1) for i, t in enumerate([ENGLISH, "12 !", None, "", "ein Satz", "é"])]
    sf = table(tmp_path, spark.createDataFrame(rows, DOCS))
    kept = corpus_pipeline.language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]


def test_contract_columns(spark):
    r = jpeg.op1_media_jpeg(spark, SF).first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text.encode()
    payload = text + bytes(-len(text) % 64)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert os.path.exists(token_counts.tokenizer_path("byte_bpe_50k.json"))
