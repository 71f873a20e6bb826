"""Operators against brute-force versions and the forms that their methods must handle."""

import os
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from cueloom.llm import bpe, components, language_id, license_texts, licenses, mixing, ngram_join, order_minhash, pii, toxicity
from cueloom.llm import progressive_jpeg as jpeg

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- 1: a general progressive encoder -------------------------------------------------------------------------------

ALL = jpeg.Huffman([0] * 8 + [255, 1] + [0] * 6, list(range(256)))


class Writer:
    def __init__(self):
        self.bits, self.run, self.held = [], 0, []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        code, n = ALL.code_of[s]
        self.put(code, n)

    def value(self, v, size):
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def end_of_blocks(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.put(self.run - (1 << n), n)
            self.bits += self.held
            self.run, self.held = 0, []

    def bytes(self):
        self.end_of_blocks()
        return jpeg._stuffed(np.array(self.bits, dtype=np.uint8))


def ac_first(w, block, low):
    zeros = 0
    for c in block[1:].tolist():
        v = abs(c) >> low
        if not v:
            zeros += 1
            continue
        w.end_of_blocks()
        while zeros > 15:
            w.symbol(0xF0)
            zeros -= 16
        w.symbol(zeros << 4 | v.bit_length())
        w.value(v if c > 0 else -v, v.bit_length())
        zeros = 0
    w.run += zeros > 0


def ac_refine(w, block):
    fresh = [k for k in range(1, 64) if abs(block[k]) == 1]
    zeros, corrections = 0, []
    for k in range(1, 64):
        v = abs(int(block[k]))
        if not v:
            zeros += 1
            continue
        while zeros > 15 and fresh and k <= fresh[-1]:
            w.end_of_blocks()
            w.symbol(0xF0)
            w.bits += corrections
            zeros, corrections = zeros - 16, []
        if v > 1:
            corrections.append(v & 1)
            continue
        w.end_of_blocks()
        w.symbol(zeros << 4 | 1)
        w.bits += [int(block[k] > 0), *corrections]
        zeros, corrections = 0, []
    if zeros or corrections:
        w.run += 1
        w.held += corrections


def progressive(planes, width, height, interval=0):
    """A file of 1 or 3 components without subsampling, with one bit of successive approximation and restarts."""

    def scan(ids, start, end, high, low, rows, each):
        parts, step = [], interval or len(rows)
        for i in range(0, len(rows), step):
            w = Writer()
            each(w, rows[i : i + step])
            parts.append(w.bytes())
        data = b"".join(p + (b"\xff" + bytes([0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))
        return jpeg._scan(ids, start, end, high, low, data)

    def dc_first(w, units):
        last = [0] * len(planes)
        for unit in units:
            for c, block in enumerate(unit):
                v = int(block[0]) >> 1
                d = v - last[c]
                last[c] = v
                w.symbol(abs(d).bit_length())
                w.value(d, abs(d).bit_length())

    units = list(zip(*planes, strict=True))
    ids = list(range(1, len(planes) + 1))
    scans = [scan(ids, 0, 0, 0, 1, units, dc_first)]
    scans += [scan([c], 1, 63, 0, 1, planes[c - 1], lambda w, rows: [ac_first(w, b, 1) for b in rows]) for c in ids]
    scans.append(scan(ids, 0, 0, 1, 0, units, lambda w, us: w.bits.extend(int(b[0]) & 1 for u in us for b in u)))
    scans += [scan([c], 1, 63, 1, 0, planes[c - 1], lambda w, rows: [ac_refine(w, b) for b in rows]) for c in ids]
    frame = struct.pack(">HBHHB", 8 + 3 * len(ids), 8, height, width, len(ids)) + b"".join(bytes([c, 0x11, 0]) for c in ids)
    restarts = b"\xff\xdd" + struct.pack(">HH", 4, interval) if interval else b""
    return b"".join([b"\xff\xd8\xff\xdb", struct.pack(">HB", 67, 0), b"\x03" * 64, b"\xff\xc2", frame, ALL.segment(0, 0), ALL.segment(1, 0), restarts, *scans, b"\xff\xd9"])


@pytest.mark.parametrize(("components", "interval", "density"), [(1, 0, 0.02), (1, 3, 0.3), (3, 0, 0.1), (3, 5, 0.02), (1, 0, 0.0), (3, 0, 0.9)])
def test_jpeg_files_of_any_coding(components, interval, density):
    r = np.random.default_rng(components * 10 + interval)
    across, down = 7, 5
    planes = []
    for _ in range(components):
        p = r.integers(-40, 41, (across * down, 64)) * (r.random((across * down, 64)) < density)
        p[r.random(p.shape) < density / 2] = 1  # found by refinement only
        p[:, 0] = r.integers(-100, 100, len(p))
        p[4:12, 1:] = 0  # a run of empty blocks
        planes.append(p)
    image = jpeg.decode(progressive(planes, across * 8 - 3, down * 8 - 1, interval))
    assert all((c.coefficients == p).all() for c, p in zip(image.components, planes, strict=True))
    rgb = image.rgb()
    assert rgb.shape == (down * 8 - 1, across * 8 - 3, 3) and (components == 3 or (rgb[..., 0] == rgb[..., 2]).all())


def test_jpeg_query_stores_tensors(spark):
    df = jpeg.media_digests(spark.createDataFrame([(1, "some text " * 90), (2, None)], "doc_id long, text string"))
    for r in df.collect():
        rgb = np.frombuffer(r.rgb, dtype=np.uint8).reshape(r.height, r.width, 3)
        want = jpeg.decode(jpeg.encode(jpeg.padded((r.text or "").encode())))
        assert (rgb == want.rgb()).all() and r.feature == jpeg.feature(rgb) and r.payload_bytes % 64 == 0


# --- 3 --------------------------------------------------------------------------------------------------------------


def test_order_minhash_query_against_a_plain_loop(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    rows = [(r.choice([1, 2, 2, 3, None, 40, 41, 42, 43]) if i % 3 else i * 7, " ".join(word() for _ in range(r.randint(0, 60))) if r.random() > 0.1 else None) for i in range(120)]
    rows += [(None, "the same")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    got = order_minhash.with_next(df, order_minhash._edits, schema).collect()
    keyed = sorted(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.tie))
    want = []
    for i, x in enumerate(keyed):
        after = keyed[(i + 1) % len(keyed)].text
        cut = len(x.text) // 4
        edited = x.text[: len(x.text) - cut] + after[:cut]
        f, e, n = (order_minhash.fingerprint(t) for t in (x.text, edited, after))
        want.append((x.doc_id, len(x.text), order_minhash.as_hex(f), order_minhash.as_hex(e), float((f == e).mean()), float((f == n).mean())))
    assert sorted(map(repr, want)) == sorted(repr((g.doc_id, g.n_chars, g.fingerprint, g.edited_fingerprint, g.near_edited, g.near_next)) for g in got)


def test_order_minhash_bounds_split_hot_ids(spark):
    df = spark.createDataFrame([(7 if i % 3 else i, i * 977) for i in range(600)], "k long, tie long")
    bounds = order_minhash._bounds(df, 12)
    assert sum(k == 7 for k, _ in bounds) >= 8 and bounds == sorted(set(bounds))
    got = df.select("k", "tie", order_minhash._range_of(bounds).alias("r")).collect()
    assert all(x.r == sum(b <= (x.k, x.tie) for b in bounds) for x in got)


# --- 5 --------------------------------------------------------------------------------------------------------------


def components_of(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("block", "pivots", "part"), [(256, 8, 512), (4, 1, 3), (3, 0, 2)])
def test_ngram_join_in_small_blocks(spark, monkeypatch, block, pivots, part):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "LIST_PART", part)
    r = random.Random(block)
    texts = []
    for size in (60, 61, 30, 130):  # chains of copies that drift, several classes to a bundle
        words = [f"w{r.randrange(10**6)}" for _ in range(size)]
        for step in range(22):
            texts.append(" ".join(words))
            for _ in range(r.choice([0, 1, 1, 2])):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    shared = " ".join(f"s{i}" for i in range(12))
    texts += [" ".join(f"x{r.randrange(10**6)}" for _ in range(25)) + " " + shared for _ in range(20)]
    texts += ["", None, "one", "One", "a b c d", "a b c d e", texts[0].upper(), texts[0]]
    order = list(range(len(texts)))
    r.shuffle(order)
    df = spark.createDataFrame([(i, texts[o]) for i, o in enumerate(order)], "doc_id long, text string")
    want, sizes = components_of([texts[o] for o in order])
    got = {x.doc_id: x for x in ngram_join.near_duplicates(df).collect()}
    assert [got[i].component_id for i in range(len(order))] == want and [got[i].n_shingles for i in range(len(order))] == sizes


# --- 6 --------------------------------------------------------------------------------------------------------------


def toxic_rows(n=120):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "an", "er", "in", "on", "re", "ed", "ou"]) for _ in range(r.randint(1, 4)))
    rude = ["vileword", "nastything", "awfulname"]
    rows = []
    for i in range(n):
        words = [word() for _ in range(r.randint(40, 160))]
        if i % 3 == 0:
            for _ in range(8):
                words[r.randrange(len(words))] = r.choice(rude)
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_against_a_plain_version(spark):
    rows = toxic_rows()
    rows += [(500, None, 0), (501, "", 1), (502, f"{rows[0][1]} {rows[3][1]} " * 80, 1)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows if x[0] < 500], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert b"vileword" in model.distances.contents[1] and b"vileword" not in model.distances.contents[0]

    def plain(text):
        length = []
        for content in model.distances.contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=len(content), source_size=2 * toxicity.WINDOW, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=4)
            c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
            length.append([len(c.compress(w)) for w in toxicity.windows(text or "")])
        near = sum(a - b >= model.near for a, b in zip(*length, strict=True))
        return 1 / (1 + np.exp(-np.clip(model.slope * (near / np.sqrt(len(length[0]) + toxicity.PRIOR) - model.limit), -30, 30)))

    got = {x.doc_id: x for x in toxicity.toxicity(docs, model).collect()}
    assert all(abs(got[i].score - plain(t)) < 1e-5 and got[i].predicted == int(got[i].score >= 0.5) for i, t, _ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows[:120]]) > 0.95 and got[502].predicted == 1 and got[500].score == got[501].score


def test_toxicity_learns_from_long_texts(spark):
    rows = [(i, t * 300, y) for i, t, y in toxic_rows(60)]
    assert min(len(t) for _, t, _ in rows) > toxicity.SAMPLE_CHARS
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for _, t, y in rows]) > 0.9
    short = docs.select(toxicity.sampled(F.col("text")).alias("t")).collect()
    assert all(toxicity.SAMPLE_CHARS <= len(x.t) <= toxicity.SAMPLE_CHARS + toxicity.SAMPLE_PARTS for x in short)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]


# --- 7 --------------------------------------------------------------------------------------------------------------


def scanned(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license): r.n_units for r in licenses.scan(rows, **options).collect()}


def test_licences_inside_lines_and_over_lines(spark):
    prose = "Some words that have nothing to do with it stand here and go on for a while. "
    wrapped = prose * 30 + "\nThis work is licensed under the\nGNU General Public\n License, version 3\n" + prose
    got = scanned(spark, "This file is released under the MIT License.", prose + "Copyright 2024 Example Corp. Licensed under the Apache License, Version 2.0. " + prose, wrapped, "licensed to drive; a license of some kind", "Licensed under CC BY 4.0\nx\nLicensed under CC BY-SA 4.0\nLicensed under CC BY 4.0", "", None)
    assert got == {(0, "MIT"): 1, (1, "Apache-2.0"): 1, (2, "GPL-3.0"): 1, (4, "CC-BY-4.0"): 2, (4, "CC-BY-SA-4.0"): 1}


def test_full_licences(spark):
    names = [(k, t) for k, texts in license_texts.TEXTS.items() for t in texts if len(t) > 200]
    noisy = ["Copyright (c) 2024 A. Person\n\n" + re.sub(r"\s+", lambda m: "\n# " if len(m[0]) > 1 else " ", t).replace("Software", "Program", 1) + "\nThe end of it." for _, t in names]
    got = scanned(spark, *noisy)
    assert all((i, k) in got for i, (k, _) in enumerate(names)) and len(got) == len(names)
    whole = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0"}
    there = {k: v for k, v in whole.items() if os.path.exists(f"/usr/share/common-licenses/{k}")}
    got = scanned(spark, *(open(f"/usr/share/common-licenses/{k}").read() for k in there))
    assert {(i, v) for i, v in enumerate(there.values())} <= set(got)


def test_licences_against_a_plain_version(spark):
    r = random.Random(7)
    templates = licenses.templates_of(license_texts.TEXTS)
    anchors = licenses.anchors_of(templates)
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 6)):
            words += [f"v{r.randrange(99)}" for _ in range(r.randint(0, 12))]
            piece = list(r.choice(templates)[1])
            for _ in range(r.randrange(3)):
                piece[r.randrange(len(piece))] = r.choice(["x", "license", "y"])
            words += piece
        texts.append(" ".join(words))

    def plain(text):
        words, found = licenses.words_of(text), set()
        for i, w in enumerate(words):
            for t, at in anchors.get(w, ()):
                name, own, grams = templates[t]
                part = words[i - at : i - at + len(own)] if i >= at else []
                mine = {f"{a} {b}" for a, b in zip(part, part[1:])}
                if mine and (score := 2 * len(mine & set(grams)) / (len(mine) + len(grams))) >= 0.8:
                    found.add((i - at, i - at + len(part), -score, -len(grams), name))
        out, end, place = Counter(), -1, []
        for x in [*sorted(found), (10**9, 0, 0, 0, "")]:
            if x[0] >= end and place:
                out[min(place, key=lambda p: (p[2], p[3], p[4], p[0]))[4]] += 1
                place = []
            place.append(x)
            end = max(end, x[1])
        return out

    got = scanned(spark, *texts)
    assert got == {(i, k): n for i, t in enumerate(texts) for k, n in plain(t).items()}


def test_licences_without_key_words(spark, tmp_path):
    templates = licenses.templates_of(license_texts.TEXTS)
    long = [(name, words) for name, words, _ in templates if len(words) > 45]
    texts = ["Before it. " + " ".join("other" if w in licenses.key_words(words) else w for w in words) + " and after" for _, words in long]
    names = [name for name, _ in long]
    mit = dict(long)["MIT"]
    texts += ["used under CC BY 4.0 CC0", "x under CC BY-SA 4.0; x under CC BY-SA 4.0", " ".join(mit[9:]), " ".join([*mit[5:20], "and", *mit[20:]])]
    names += ["CC-BY-4.0", "CC-BY-SA-4.0", "MIT", "MIT"]
    spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.license): r.n_units for r in licenses.op7_license_scan(spark, str(tmp_path)).collect()}
    assert got == {(i, n): 1 + ("SA" in n) for i, n in enumerate(names)}


def test_licences_everywhere_against_a_plain_version(spark):
    r = random.Random(11)
    templates = licenses.templates_of(license_texts.TEXTS)
    texts = []
    for _ in range(80):
        words = []
        for _ in range(r.randint(1, 5)):
            piece = list(r.choice(templates)[1])
            for _ in range(r.randrange(1 + len(piece) // 5)):
                at = r.randrange(len(piece))
                piece[at : at + r.randrange(2)] = r.choice([[], ["x"], ["license", "y"]])
            for key in r.sample(licenses.key_words(piece), r.randrange(len(licenses.key_words(piece)) + 1)):
                piece = [w if w != key else "z" for w in piece]
            words += piece[r.choice([0, 0, len(piece) // 8]) :] + [f"v{r.randrange(99)}" for _ in range(r.choice([0, 3, 40, 150]))]
        texts.append(" ".join(words))

    def plain(text):
        words, keyed, others = licenses.words_of(text), set(), set()
        for name, own, grams in templates:
            for start in range(len(words)):
                part = words[start : start + len(own)]
                mine = {f"{a} {b}" for a, b in zip(part, part[1:])}
                if mine and (score := 2 * len(mine & set(grams)) / (len(mine) + len(grams))) >= 0.8:
                    at_key = any(w in licenses.key_words(own) and words[start + i : start + i + 1] == [w] for i, w in enumerate(own))
                    (keyed if at_key else others).add((-score, -len(grams), name, start, start + len(part)))
        over = lambda a, b: a[3] < b[4] and b[3] < a[4]
        runs, taken = [], []
        for x in sorted(keyed, key=lambda x: x[3:]):
            if runs and x[3] < max(y[4] for y in runs[-1]):
                runs[-1].append(x)
            else:
                runs.append([x])
        free = lambda x: not any(over(x, y) for y in keyed)
        for x in sorted(others):
            if (free(x) or any(x[3] <= y[3] and y[4] <= x[4] for y in keyed)) and not any(over(x, y) for y in taken):
                taken.append(x)
        out, taken = {}, list(filter(free, taken))
        for x in [*map(min, runs), *taken]:
            n, best = out.get(x[2], (0, 0))
            out[x[2]] = (n + 1, max(best, round(-x[0], 6)))
        return out, len(taken)

    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [plain(t) for t in texts]
    got = {(x.doc_id, x.license): (x.n_units, x.best_score) for x in licenses.scan(rows, everywhere=True).collect()}
    assert got == {(i, k): v for i, (places, _) in enumerate(want) for k, v in places.items()}
    assert sum(n for _, n in want) > 20


# --- 8 --------------------------------------------------------------------------------------------------------------

FORMS = {
    "at in brackets": lambda w, d: f"{w()} (at) {w()}.com",
    "at in brackets after digits": lambda w, d: f"{w()}{d(2)} (at) {w()}.com",
    "at in square brackets": lambda w, d: f"{w()}.{w()}[at]{w()}.org",
    "at and dot as words": lambda w, d: f"{w()} at {w()} dot com",
    "hyphens": lambda w, d: f"{d(3)}-{d(3)}-{d(4)}",
    "area code in brackets": lambda w, d: f"({d(3)}) {d(3)}-{d(4)}",
    "dots": lambda w, d: f"{d(3)}.{d(3)}.{d(4)}",
    "card with dots": lambda w, d: ".".join(re.findall("....", next(x for x in (d(16) for _ in range(999)) if pii.luhn(x)))),
}


@pytest.fixture(scope="module")
def prose(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 300 and lang is not null").limit(120).collect()]
    return [w for t in texts for w in t.split() if not re.search(r"[0-9@]", w)]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("place", ["middle", "start", "end"])
def test_pii_recall_by_form(prose, form, place):
    r = random.Random(f"{form}{place}")
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    some = lambda: " ".join(r.choice(prose) for _ in range(r.randint(5, 120)))
    texts, spans = [], []
    for _ in range(100):
        x = FORMS[form](w, d)
        before = "" if place == "start" else some() + " "
        texts.append(before + x + ("" if place == "end" else " " + some()))
        spans.append((len(before), len(before) + len(x)))
    found = pii.find_spans(texts, pii.trained())[1]
    recall = np.mean([any(s[1:] == want for s in got) for got, want in zip(found, spans, strict=True)])
    assert recall >= (0.8 if (form, place) == ("at and dot as words", "start") else 0.9)


def test_pii_windows_are_reconciled():
    weigh = pii.reconciled({(0, 0, 10): 1.0, (0, 5, 12): 1.5, (3, 10, 20): 1.0, (1, 21, 30): 0.5, (2, 21, 30): 0.7})
    assert weigh == [(0, 0, 10), (3, 10, 20), (2, 21, 30)]
    long = "word " * 200
    phone = "555-123-4567"
    texts = [long[:k] + phone + " " + long for k in range(200, 400, 7)]
    found = pii.find_spans([t if t[: t.index(phone)].endswith(" ") else t.replace(phone, " " + phone) for t in texts], pii.trained())[1]
    assert np.mean([sum(s[0] == 3 for s in x) == 1 for x in found]) >= 0.9  # once each, wherever windows end


def test_pii_query_columns_against_the_rules(spark):
    texts = ["a@b.com 10.0.0.1 4111 1111 1111 1111 +44 20 7946 0958 x", "", None, "é a@b.c.d +1 (555) 123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_known", F.lit("mine"))
    import hashlib

    for r in pii.personal_data(df).collect():
        base = pii.base_spans(r.text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(pii.joined(base).split(",")) <= set(r.spans.split(","))
    out = pii.redact(df).orderBy("doc_id").collect()
    assert [r._known for r in out] == ["mine"] * 4 and out[2].text is None and out[1].text == "" and out[3].text == "é [EMAIL] [PHONE]"


# --- 10 -------------------------------------------------------------------------------------------------------------


def test_language_query_against_a_plain_vote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~language_id.held_out()))

    def plain(text):
        x = language_id.features([text.encode()])[0].astype(float)
        margin = lambda w: float(x @ w[:-1].astype(float) + w[-1])
        family = model.families[int(np.argmax([margin(w) for w in model.top]))] if model.top is not None else model.families[0]
        members = model.members[family]
        votes = {m: [0, 0.0] for m in members}
        for (f, a, b), w in model.pairs.items():
            if f == family:
                m = margin(w)
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        return max(members, key=lambda m: tuple(votes[m]))

    rows = language_id.identify(docs, model).where("doc_id % 3 = 0").collect()
    assert all(r.lang_pred == (plain(r.text) if r.text and language_id.has_letter(r.text) else "und") for r in rows)


# --- The pipeline's stages ------------------------------------------------------------------------------------------


def test_stages_with_clashing_columns(spark):
    r = random.Random(9)
    some = lambda n: " ".join(r.choice(["the", "house", "stands", "and", "green", "of", "river"]) + str(r.randrange(50)) for _ in range(n))
    copy = some(60)
    rows = [(i, some(40), "en" if i % 2 else None, f"s{i % 3}", 1) for i in range(20)] + [(30, copy, "en", "s1", 1), (31, copy, "en", "s1", 1), (31, copy, "en", "s1", 1), (32, some(50), None, None, None), (33, None, "en", "s1", 0), (34, "", "en", "s1", 0), (35, "123 !", "en", "s1", 5), (None, some(30), "en", "s2", 3), (40, some(45), "en", "s0", 2), (40, some(46), "en", "s0", 2)]
    names = ["_rank", "_known", "_row", "_mark", "_id", "_kept", "_place", "_pred", "_score", "_letter", "_made", "_source", "_times", "score", "lang_pred", "kept", "rows", "epoch", "block", "class_id", "component_id"]
    docs = spark.createDataFrame(rows, DOCS).withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, None)
        if name != "encoding":
            assert out.columns == docs.columns
            assert all(x[n] is None if x.doc_id is None else x[n] == f"{n}{x.doc_id}" for x in out.collect() for n in names)
        kept = Counter(x.doc_id for x in out.collect())
        if name == "language":
            assert kept == Counter(x[0] for x in rows if x[0] not in (33, 34, 35)) and all(x.lang == "en" for x in out.collect())
        if name == "near_duplicates":
            assert kept == Counter([*range(20), 30, 32, None, 40, 40])
        seen = spark.createDataFrame(out.collect(), out.schema)
    assert set(kept) == {*range(20), 30, 32, None, 40}


def test_language_stage_without_labels(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", None, "s", 3) for i in range(5)] + [(9, "12", None, "s", 2)], DOCS)
    assert sorted((x.doc_id, x.lang) for x in corpus_pipeline.language(spark, docs, None).collect()) == [(i, None) for i in range(5)]


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_mixing_takes_what_a_plain_order_takes(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" * 1 for _ in range(r.randint(0, 9))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture, _ = mixing.plan(df)
    plans = {x._source: x for x in mixture.collect()}
    taken = Counter((x.doc_id) for x in mixing.mix(df, details=False).collect())
    place = df.select("doc_id", F.coalesce("source", F.lit("(none)")).alias("_source"), F.col("doc_id").alias("_id"), mixing.tokens().alias("n")).join(mixture.select("_source", "blocks", "epochs", "rest"), "_source").select("*", *mixing._place()).collect()
    for name, p in plans.items():
        mine = sorted((x for x in place if x._source == name), key=lambda x: (x.block_key, x.block, x.row_key, x.doc_id))
        total = 0
        for x in mine:
            total += x.n
            assert taken[x.doc_id] == p.epochs + (p.rest > 0 and total <= p.rest), (name, x.doc_id)




# --- Components -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part", [5, 40, 10_000])
def test_components_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(components, "PART_EDGES", part)
    r = random.Random(part)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)] + [(200, 200 + i) for i in range(1, 30)] + [(300 + i, 301 + i) for i in range(25)] + [(-5, 7), (7, -5), (8, 8)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    got = {x.node: x.root for x in components.components(df).collect()}
    alone = {i for i in parent if find(i) == i and sum(find(j) == i for j in parent) == 1}
    assert got == {i: find(i) for i in parent if i not in alone}
    assert components.components(df.limit(0)).collect() == []


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_decoding_is_the_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path(bpe.TOKENIZER)
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Bpe(path)
    r = random.Random(9)
    texts = ["", "plain words, and more.", "é日本 😀\n\n  x", "<|endoftext|> in a text", "a" * 5000] + ["".join(r.choice("ab é日😀\t<|'s.") for _ in range(80)) for _ in range(200)]
    ids = own.encode(texts)
    assert ids == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    cut = [x[: r.randint(0, len(x))] for x in ids]  # cuts inside characters too
    assert [own.decode(x) for x in [*ids, *cut]] == [library.decode(x, skip_special_tokens=False) for x in [*ids, *cut]]
    many = [f"w{i} x{i * 7}" for i in range(3000)]
    small = bpe.MEMORY_PIECES
    try:
        bpe.MEMORY_PIECES = 500  # what is remembered is dropped in between
        assert [i for a in range(0, 3000, 300) for i in own.encode(many[a : a + 300])] == [e.ids for e in library.encode_batch(many, add_special_tokens=False)]
    finally:
        bpe.MEMORY_PIECES = small


@pytest.mark.parametrize("most", [0, 400_000])
def test_near_duplicate_stage_beyond_its_broadcasts(spark, monkeypatch, most):
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", most)
    same = " ".join(f"w{i}" for i in range(40))
    texts = [(1, same), (2, same), (2, same), (3, same + " x"), (4, "a b c d e f g"), (4, "a b c d e f g"), (4, "another text with the same id"), (5, ""), (5, ""), (6, None), (None, same), (None, "no id but words"), (None, "no id but words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, None).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted([(1, same), (4, "a b c d e f g"), (4, "another text with the same id"), (5, ""), (6, None), (None, "no id but words")], key=repr)
