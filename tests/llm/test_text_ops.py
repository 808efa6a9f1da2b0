"""Language id, mixing, exact dedup, packing, quality and licences against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectdrift.llm import exact_dedup, lang_id, license_scan, mixing, packing, quality

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, size long, h string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = "mot " * 40_000
    rows = [
        (1, "a  b", "en", "x", 1, "h"), (2, "a b", "en", "x", 1, "h"), (2, "a b", "en", "x", 1, "h"), (3, None, None, None, None, None),
        (4, "", "fr", "y", 0, ""), (None, "a\tb", None, "y", 0, None), (None, "only null id", "en", "x", 0, None), (6, long, "fr", None, 5, "z"),
        (7, "!!! 123", "en", "y", 1, "q"), (8, "été\n\x0b\x0c été", "fr", "y", 1, "q"), (9, "a b", "en", "y", 1, "q"), (10, "a\x1fb", "en", "y", 1, "q"),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


# ---------------------------------------------------------------- language id


def cross_parse(text, train):
    """Phrases of the greedy parse, by substring search."""
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in train:
            k += 1
        n, i = n + 1, i + max(k - 1, 1) if text[i] in train else i + 1
    return n


def test_phrases_match_substring_search():
    rng = random.Random(1)
    train = [rng.randrange(4) for _ in range(300)]
    table = lang_id.table_of(lang_id.automaton(train), 6, len(train))
    parts = [np.array([rng.randrange(6) for _ in range(n)], np.int32) for n in (1, 7, 200, lang_id.SEGMENT)]
    joined = "".join(map(str, train))
    got = lang_id.phrases(parts, table)
    for part, n in zip(parts, got, strict=True):
        # A mismatch starts the next phrase with the mismatching symbol; one that training lacks is a phrase by itself.
        state, want = "", 1
        for c in map(str, part.tolist()):
            if state + c in joined:
                state += c
            else:
                want += 1
                state = c if c in joined else ""
        assert n == want


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang_id.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_tables_hold_all_transitions():
    rng = random.Random(2)
    train = [rng.randrange(1, 3000) for _ in range(4000)]
    steps = lang_id.automaton(train)
    table = lang_id.table_of(steps, 3001, len(train))
    size = len(table.owner)
    for state, by in enumerate(steps):
        for c in {*by, 1, 2999}:
            slot = (table.base[state] + c) % size
            assert (table.to[slot] == by[c]) if c in by else table.owner[slot] != state
    assert sum(map(len, steps)) == (table.owner >= 0).sum()


# First letter and size of the alphabets.
SCRIPTS = {"ko": (0xAC00, 11172), "zh": (0x4E00, 20000), "am": (0x1200, 300), "ru": (0x430, 32), "en": (0x61, 26), "xx": (0x61, 26), "th": (0xE01, 46)}


def test_languages_of_many_scripts(spark):
    """Random words of each language's own lexicon; en and xx share their letters, ko and zh have thousands."""
    rng, rows = random.Random(5), []
    for lang, (at, n) in SCRIPTS.items():
        few = 2 if n > 1000 else 6
        words = ["".join(c for c in (chr(at + rng.randrange(n)) for _ in range(rng.randrange(1, few) + 1)) if c.isalpha()) or chr(at) for _ in range(600)]
        gap = "" if lang == "zh" else " "
        for k in range(80 if lang != "am" else 12):
            text = gap.join(rng.choice(words[: 60 if k % 3 else 600]) for _ in range(rng.randrange(8, 90)))
            rows.append((len(rows), text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r for r in lang_id.op1(docs).join(docs.select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    for lang in SCRIPTS:
        own = [r.lang_pred for r in got if r.lang == lang]
        assert own and sum(p == lang for p in own) / len(own) > 0.98, (lang, own)


def test_texts_and_samples_of_one_language(spark):
    rows = [(k, "x" * 200_000 if k % 2 else "yy zz " * 40, "a") for k in range(8)]
    parser = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert 950 < parser.tables[0].length < 970  # the four short rows, whole
    only = lang_id.fit(spark.createDataFrame(rows[1:2], "doc_id long, text string, lang string"))
    assert only.tables[0].length == 200_000
    label, score = lang_id.classify(["yy zz yy zz"], parser, parser.codes())[0]
    assert label == "a" and 0 < score < 1


def test_language_of_odd_rows(odd, empty):
    rows = {(r.doc_id, r.lang_pred) for r in lang_id.op1(odd).collect()}
    assert {(3, "und"), (4, "und"), (7, "und"), (8, "fr")} <= rows
    assert lang_id.op1(odd).count() == odd.count()
    assert lang_id.op1(empty).count() == 0


# ---------------------------------------------------------------- mixing


def filled(sizes, weights):
    """Targets by sharing the excess round by round."""
    total, live, out = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(total)
    while live:
        share = rest / sum(weights[i] for i in live)
        over = {i for i in live if share * weights[i] > 3 * sizes[i] + 1e-9}
        if not over:
            for i in live:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = 3.0 * sizes[i]
            rest -= out[i]
        live -= over
    return out


def test_targets_share_the_excess(spark):
    sizes = [("b", 10), ("a", 1000), ("é", 3), (None, 500), ("c", 40), ("zero", 0)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted([s for s, _ in sizes if s is not None]) + [None]
    want = filled([dict(sizes)[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert [got[s] for s in order] == pytest.approx(want)


def test_mix_comes_near_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.op2(docs).collect()
    again = mixing.op2(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    text = {r.doc_id: r for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id].text or ""))
        x = r.target / r.source_size
        assert r.taken in (r["size"] * int(x), r["size"] * (int(x) + 1)) and r.taken <= 3 * r["size"]
        t = by.setdefault(text[r.doc_id].source, [r.target, 0, 0])
        t[1] += r.taken
        t[2] = max(t[2], r["size"])
    assert all(abs(taken - target) <= 0.01 * target for target, taken, _ in by.values()), by


def test_meetings_keep_expected_copies_and_words():
    rng = random.Random(2)
    rows = [(rng.getrandbits(64), rng.randrange(1, 400), 0.37) for _ in range(60)]
    rows.sort(key=lambda r: -r[1])
    words = sum(s * f for _, s, f in rows)
    first = []
    for seed in range(400):
        extra, left = mixing.meet(rows, seed)
        got = sum(s * (e if p < 0 else p) for (_, s, _), e, p in zip(rows, extra, left, strict=True))
        assert got == pytest.approx(words) and sum(p >= 0 for p in left) <= 1
        first.append(extra[0] if left[0] < 0 else left[0])
    assert np.mean(first) == pytest.approx(0.37, abs=0.1)


def test_small_documents_settle_the_large_ones():
    rng = random.Random(3)
    for seed in range(30):
        f = rng.choice([0.02, 0.37, 0.5, 0.98])
        rows = sorted([(rng.getrandbits(64), s, f) for s in [9000, 9000, 5000, *(rng.randrange(1, 300) for _ in range(4000))]], key=lambda r: -r[1])
        extra, left = mixing.meet(rows, seed)
        assert all(s < 300 for (_, s, _), p in zip(rows, left, strict=True) if p >= 0)
        assert sum(s * (e if p < 0 else p) for (_, s, _), e, p in zip(rows, extra, left, strict=True)) == pytest.approx(sum(s * f for _, s, f in rows))
    # Shares differ, each one's expected copies stay.
    rows = [(k, s, f) for k, (s, f) in enumerate([(50, 0.4), (40, 0.9), (30, 0.2), (9, 0.5), (9, 0.1), (8, 0.7), (5, 0.5), (3, 0.3), (2, 0.6)])]
    ends = []
    for seed in range(4000):
        extra, left = mixing.meet(rows, seed)
        ends.append([e if p < 0 else p for e, p in zip(extra, left, strict=True)])
    assert np.mean(ends, axis=0) == pytest.approx([f for _, _, f in rows], abs=0.04)


def test_mix_of_ties_and_repeated_rows(spark):
    rows = [(k % 40, "a b c d e", "s" if k % 2 else "t") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op2(docs).collect()
    assert len(got) == 200 and all(r.taken in (0, 5, 10, 15) for r in got)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.op2(docs.repartition(5)).collect())


def test_mix_of_odd_rows_and_blocks(odd, empty, spark):
    rows = mixing.copies(odd, block_rows=2).collect()
    assert len(rows) == odd.count() and all(0 <= r.copies <= 3 for r in rows)
    assert {r["size"] for r in rows if r.id == 6} == {40_000}
    assert mixing.op2(empty).count() == 0
    assert mixing.mixed(odd).columns == odd.columns
    many = spark.range(3000).selectExpr("id as doc_id", "repeat('w ', cast(id % 50 + 1 as int)) as text", "if(id < 2000, 'hot', 'b') as source")
    sums = mixing.copies(many, block_rows=2).groupBy("source").agg({"target": "max"}).collect()
    taken = {r.source: r.t for r in mixing.copies(many, block_rows=2).selectExpr("source", "size * copies as w").groupBy("source").agg({"w": "sum"}).withColumnRenamed("sum(w)", "t").collect()}
    assert all(abs(taken[r.source] - r["max(target)"]) <= 50 for r in sums)


# ---------------------------------------------------------------- exact dedup


def brute_groups(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    return groups


@pytest.mark.parametrize("partitions", [1, 3, 9])
def test_exact_groups(docs, odd, partitions):
    for table in (odd, docs.union(docs.limit(40)).union(docs.selectExpr("doc_id + 100000", "'same  text'", "lang", "source", "n_chars"))):
        got = exact_dedup.groups_of_equals(table, partitions=partitions).collect()
        want = brute_groups(table.collect())
        assert len(got) == sum(map(len, want.values()))
        shas = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
        for r in got:
            ids = shas[r.text_sha256]
            assert r.id in ids and r.group_size == len(ids)
            assert r.keep_id == min((i for i in ids if i is not None), default=None)
            assert not r.kept or r.id == r.keep_id
        assert sum(r.kept for r in got) == len(want)


def test_exact_groups_of_nothing(empty):
    assert exact_dedup.op3(empty).count() == 0


# ---------------------------------------------------------------- packing


def test_fast_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, rng = Tokenizer.from_file(path), random.Random(3)
    pool = ["the", " ", "  ", "\n", "été", "123", "'s", "!!", "<|endoftext|>", "　", " ", "日本", "\U0001f600", "\t", "x" * 30, "don't", "\x00", "́"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(300)]
    assert packing.encoder(path)(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_very_long_runs(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = [" " * 2_000_000, "\n" * 1_000_000 + "x", "a " + "\t " * 5000 + "b", " " * 4095 + "y", "a" * 1_000_000, "!?" * 500_000, "\u3000" * 100_000]
    assert packing.encoder(path)(texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    rows = packing.op4(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = [r.length for r in rows if r.doc_id == i]
        assert sum(own) == len(plain.encode(t, add_special_tokens=False).ids) + 1 and max(own) <= 1024


def test_packing_places_every_piece_once(docs, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.default_tokenizer())
    for table in (docs, odd):
        rows = packing.op4(table).collect()
        want = []
        for r in table.collect():
            ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
            cut = [ids[: len(ids) % 1024 or 1024]]
            cut += [ids[i : i + 1024] for i in range(len(cut[0]), len(ids), 1024)]
            at = 0
            for k, p in enumerate(cut):
                want.append((r.doc_id, k, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
                at += len(p)
        key = lambda t: tuple((x is None, x) for x in t)
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in by.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(by) <= 1.05 * sum(r.length for r in rows) / 1024 + 1
    assert packing.op4(empty).count() == 0


def test_plan_is_tight_on_many_pieces():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.lognormal(5.5, 1.0, 200_000).astype(int) + 1, 1024)
    values, counts = np.unique(lengths, return_counts=True)
    kinds = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 1024)
    placed = {}
    for items, n in kinds:
        assert sum(k for k, _ in items) <= 1024
        for k, _ in items:
            placed[k] = placed.get(k, 0) + n
    assert placed == dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert sum(n for _, n in kinds) <= 1.01 * lengths.sum() / 1024


# ---------------------------------------------------------------- quality


def test_quality_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op5(docs, labels).join(labels, "doc_id").collect()
    good = [r.selected for r in rows if r.quality == 1]
    bad = [r.selected for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    ties = docs.where("doc_id < 40").union(docs.where("doc_id < 40"))  # rows that repeat have equal keys and stay or go together
    assert all(n == 2 for n in [r["count"] for r in quality.op5(ties, labels).groupBy("doc_id", "selected").count().collect()])
    assert quality.op5(docs, labels).count() == docs.count()


def plain_grams(text):
    """Buckets of the words and pairs of a text by a hashing of its own, byte by byte."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0d]+", (text or "").encode())
    h = [mix((sum((c + 1) * pow(base, i, 1 << 64) for i, c in enumerate(w)) + len(w)) & mask) for w in tokens]
    return Counter(x % quality.BUCKETS for x in [*h, *(mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(h, h[1:], strict=False))])


def test_weights_and_selection_match_plain_counting(docs, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.op5(docs, labels).collect()}
    keys = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 11) h").collect()}
    rows, good = docs.collect(), {r.doc_id: r.quality for r in labels.collect()}
    by = {r.doc_id: plain_grams(r.text) for r in rows}
    raw, target = sum(by.values(), Counter()), sum((by[i] for i in by if good.get(i)), Counter())
    weight = {}
    for i, own in by.items():
        mine = own if good.get(i) else Counter()
        total = target.total() - mine.total()
        weight[i] = sum(c * np.log((target[b] - mine[b] + 16) / (total * raw[b] / raw.total() + 16)) for b, c in own.items())
        assert got[i].log_weight == pytest.approx(weight[i], abs=1e-6)
    # k by the level that keeps the good and drops the bad; then the k largest keys with Gumbel noise.
    at = quality.level(spark.createDataFrame([(float(weight[i]), bool(q)) for i, q in good.items() if i in weight and q is not None], "log_weight double, good boolean"))
    k = sum(w >= at - 1e-9 for w in weight.values())
    noisy = {i: w - np.log(-np.log((((keys[i] % (1 << 64)) >> 11) + 0.5) / (1 << 53))) for i, w in weight.items()}
    assert {i for i, r in got.items() if r.selected} == set(sorted(noisy, key=noisy.get)[-k:])
    plain = [(w, good[i]) for i, w in weight.items() if good.get(i) is not None]
    score = lambda t: sum(w < t for w, q in plain if not q) / sum(not q for _, q in plain) - 20 * sum(w < t for w, q in plain if q) / sum(bool(q) for _, q in plain)
    assert score(at) >= max(score(w) for w, _ in plain) - 0.05


def test_top_k_is_exact(spark):
    rng = random.Random(4)
    keys = [rng.choice([-1, 1]) * rng.getrandbits(rng.randrange(2, 63)) for _ in range(500)]
    table = spark.createDataFrame([(k,) for k in keys], "key_bits long")
    for k in (1, 17, 250, 500):
        assert quality.kth_key(table, k) == sorted(keys, reverse=True)[k - 1]


def test_quality_of_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (99, 1), (None, 0), (4, None)], "doc_id long, quality int")
    assert quality.op5(odd, labels).count() == odd.count()
    assert quality.op5(empty, labels).count() == 0
    assert quality.op5(odd, labels.limit(0)).where("selected").count() == odd.count()


# ---------------------------------------------------------------- licences


def test_licences(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in license_scan.op6(docs).collect()}
    marks = {"MIT": "under the MIT License.", "GPL": "under the GNU General Public License, version 3.", "Apache-2.0": "Apache License, Version 2.0.", "CC-BY-NC": "CC BY-NC 4.0."}
    clean = 0
    for r in docs.collect():
        want = {k for k, v in marks.items() if v in r.text} | {"unknown" for x in r.text.split("\n") if x == "All rights reserved."}
        got = set(filter(None, rows[r.doc_id].licences.split(",")))
        assert want <= got, r.doc_id
        clean += not want and bool(got)
        for span in filter(None, rows[r.doc_id].spans.split(",")):
            name, a, b = span.split(":")
            if name in marks and name in want:
                assert marks[name] in r.text[int(a) : int(b) + 1] or marks[name] not in r.text.split("\n")
    assert clean <= 0.005 * docs.count()
    assert license_scan.op6(empty).count() == 0


def test_licences_in_long_lines_and_unknown(spark, odd):
    word = "thing other place water people never under while night house " * 60
    rows = [(1, word + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. " + word),
            (2, "Use of this software is subject to the terms of the end user license agreement."), (3, word), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.op6(docs).collect()}
    assert "MIT" in got[1].licences.split(",") and got[2].licences == "unknown" and got[3].n_notices == got[4].n_notices == got[5].n_notices == 0
    assert license_scan.op6(odd).count() == odd.count()


@pytest.fixture(scope="module")
def scanner(spark):
    return license_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


# Usual paragraphs, not all of them templates word by word.
PARAGRAPHS = [
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce the Work."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("GPL", "SPDX-License-Identifier: GPL-2.0-only"), ("BSD", "SPDX-License-Identifier: BSD-2-Clause"), ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC0", "SPDX-License-Identifier: CC0-1.0"), ("MIT", "MIT License"),
    ("", "He gave back the software manuals that he had borrowed from the library last summer."), ("", "The guard released the old version of the gate."),
]


def test_licence_paragraphs(spark, scanner):
    rows = [(k, t) for k, (_, t) in enumerate(PARAGRAPHS)]
    mit = " ".join(license_scan.TEMPLATES["MIT"][3:7])
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([*rows, (99, wrapped)], "doc_id long, text string"), scanner).withColumnRenamed("id", "doc_id").collect()}
    said = [(name, got[k].licences) for k, (name, _) in enumerate(PARAGRAPHS)]
    assert sum(a == b for a, b in said) >= len(said) - 1, said
    assert [b for a, b in said if not a] == ["", ""] and "MIT" in got[99].licences.split(",")


def test_unknown_is_calibrated_on_unseen_families(spark):
    """Families that the scanner isn't told of are licence text of no known family."""
    left = ("MPL-2.0", "CC0", "Unlicense", "Apache-2.0")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scanner = license_scan.fit(docs, templates={k: v for k, v in license_scan.TEMPLATES.items() if k not in left})
    texts = [t for k in left for t in license_scan.TEMPLATES[k] if len(t.split()) > 8]
    named = [scanner.name(t) for t in texts]
    assert np.mean([n != "unknown" for n in named]) <= 0.1, named
    known = [(k, t) for k in scanner.names for t in license_scan.TEMPLATES[k] if len(t.split()) > 8]
    assert np.mean([scanner.name(t) == k for k, t in known]) > 0.95


def plain_scan(text, scanner):
    """Windows, scores and comparison one by one."""
    found = []
    at = 0
    for line in text.split("\n"):
        tokens = [m.span() for m in re.finditer(r"[0-9A-Za-z_\x80-\U0010ffff]+|[^0-9A-Za-z_\x80-\U0010ffff\x20\x09-\x0d]+", line)]
        n = len(tokens)
        firsts = [0] if n <= 48 else [min(k * 24, n - 48) for k in range(-(-(n - 48) // 24) + 1)]
        for first in firsts if n else []:
            last = min(first + 48, n)
            a, b = tokens[first][0], tokens[last][0] if last < n else len(line)
            f = license_scan.features(line[a:b])
            z = scanner.gate[f].astype(float).sum() / np.sqrt(2 * (last - first) - 1) + scanner.gate_bias
            if z < np.log(0.75 / 0.25):
                continue
            words = re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", line[a:b].lower())
            if len(words) < 2:
                continue
            zs = scanner.family[f].sum(axis=0) / np.sqrt(len(f)) + scanner.family_bias
            k = int(zs.argmax())
            rest = np.delete(zs, k)
            margin = min(20.0, max(-20.0, zs[k] - np.log(np.exp(rest).sum())))
            share = 0.0
            for t in license_scan.TEMPLATES[scanner.names[k]]:
                other = re.findall(r"[a-z0-9]+(?:[-.][a-z0-9]+)*", t.lower())
                size = min(3, len(words), len(other))
                x, y = ({" ".join(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (words, other))
                share = max(share, len(x & y) / min(len(x), len(y)))
            chance = 1 / (1 + np.exp(-(scanner.right @ [1.0, margin, share])))
            name = scanner.names[k] if chance >= 0.5 and share >= 0.5 else "unknown"
            if found and found[-1][0] == name and (at + a <= found[-1][2] or not text[found[-1][2] : at + a].strip()):
                found[-1][2] = max(found[-1][2], at + b)
            else:
                found.append([name, at + a, at + b])
        at += len(line) + 1
    return ",".join(f"{n}:{a}:{b}" for n, a, b in found)


def test_scan_matches_one_window_at_a_time(spark, scanner):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    many = "\n".join(f"é{k} " + t for k in range(20) for _, t in PARAGRAPHS) + "\n" + "mot là " * 300 + PARAGRAPHS[0][1]
    rows = docs.union(spark.createDataFrame([(-1, many), (-2, None), (-3, " \n")], "doc_id long, text string")).withColumn("lines", F.lit(1)).withColumn("id", F.lit("x"))
    got = {r.id: r.spans for r in license_scan.scan(rows, scanner).collect()}
    for r in rows.collect():
        assert got[r.doc_id] == plain_scan(r.text or "", scanner), r.doc_id


def test_many_notices_in_one_document(spark, scanner):
    text = "\n".join(("Released under the MIT License." if k % 2 else "é plain words of a line") for k in range(40_000))
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).first()
    assert row.n_notices == 20_000 and row.licences == "MIT"
