"""Operators against plain Python on tables with nulls, blanks, ties, repeats and clashing names."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import license_templates, line_templates, mixing, packing, quality_rules, queries, sharding, similar, simhash, spotsigs, substring_dedup, token_counts

CLASHING = "rank before size copies _row _key _id _digest drop leaf line tokens n bucket found docs counts hashes print root node a b key col path license".split()
VOCABULARY = [a + b for a in "ba ce di fo gu the of ñu ßa 日".split() for b in "ra se ti lo mu na ke".split()] + "the of and to in a is that".split()


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def prose(rng, n):
    return "\n".join(sentence(rng, rng.randint(4, 14)) for _ in range(max(1, n // 9)))


def table():
    rng = random.Random(7)
    shared = sentence(rng, 70)
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice([5, 40, 90, 160]))
        if i % 5 == 0:
            text = prose(rng, 30) + "\n" + shared + "\n" + text
        if i % 7 == 0:
            text += f"\nSigned by member {i} of the {rng.choice(['Old', 'New'])} club 4x{i} today"
        rows.append((i, text, rng.choice(["s1", "s2", "s2", "s3", None])))
    rows += [(100 + i, rows[10][1], "s1") for i in range(6)]  # exact copies
    near = rows[20][1].split(" ")
    rows += [(200 + i, " ".join(near[:i] + ["changed"] + near[i + 1 :]), "s2") for i in range(5)]
    rows += [(300, None, "s1"), (301, "", None), (302, " \n\t ", "s2"), (303, "one", "s3"), (304, None, "s1"), (None, rows[3][1], "s2"), (None, None, "s3")]
    rows += [(305, rows[5][1], "s1"), (305, rows[5][1], "s1"), (306, "ab " * 3000 + "x" * 3000, "s4"), (307, "loop " * 400, "s4"), (-5, prose(rng, 120), "s5")]
    return rows


ROWS = table()
PAIRS = [(d, t) for d, t, _ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit("other"))
    return frame.repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_substring_dedup(docs, empty):
    got = substring_dedup.remove_repeats(docs)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(PAIRS), key=repr)
    assert sum(r.n_removed for r in got.collect()) > 500
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got.collect())
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("window", [4, 7])
def test_substring_dedup_short_windows(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(40)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substring_dedup(rows, window), key=repr)


def test_quality_rules(docs, empty):
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    got = quality_rules.judge_documents(docs)
    assert rows_of(got, "doc_id", *names) == sorted(((d, *brute.quality(t)) for d, t in PAIRS), key=repr)
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id", "text") == sorted(((d, t) for d, t in PAIRS if brute.quality(t)[-1]), key=repr)
    assert quality_rules.judge_documents(empty).count() == quality_rules.keep_documents(empty).count() == 0


def test_quality_rules_repetition(spark):
    rng = random.Random(3)
    line = sentence(rng, 12)
    texts = [prose(rng, 200), "\n".join([prose(rng, 80)] + [line] * 4), "\n".join([line, *(f"{sentence(rng, 9)}\n{line} {i}" for i in range(4))]), "# $ | " * 60]
    got = quality_rules.judge_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    assert rows_of(got, "doc_id", *names) == sorted(((d, *brute.quality(t)) for d, t in enumerate(texts)), key=repr)
    assert {r.doc_id for r in got.collect() if r.kept} == {0}


def test_quality_rules_every_length_counts(spark):
    word = (f"w{i:04d}" for i in range(10_000))
    fresh = lambda n: [next(word) for _ in range(n)]
    thrice, twice, pieces = fresh(24), fresh(60), [fresh(5) for _ in range(20)]
    texts = {
        "long alone": fresh(90) + thrice + fresh(90) + thrice + fresh(90) + thrice,
        "short alone": sum(([*p, *fresh(9)] for p in pieces + pieces), []),
        "head and foot": twice + fresh(300) + twice,
    }
    got = quality_rules.judge_documents(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id string, text string"))
    broken = {r.doc_id: [n for n, (_, limit) in quality_rules.GRAMS.items() if r[f"gram_share_{n}"] > limit] for r in got.collect()}
    assert broken == {"long alone": [10], "short alone": [5], "head and foot": []}
    assert {r.doc_id for r in got.collect() if r.kept} == {"head and foot"}
    for r in got.collect():
        want = brute.gram_shares(" ".join(texts[r.doc_id]))
        assert all(abs(r[f"gram_share_{n}"] - want[n]) < 1e-12 for n in quality_rules.GRAMS)


def test_spot_signatures(docs, empty):
    got = {(r.doc_id, r.fingerprint): r for r in spotsigs.fingerprint_edits(docs).collect()}
    assert spotsigs.fingerprint_edits(docs).count() == len(ROWS)
    assert spotsigs.fingerprint_edits(empty).count() == 0
    single = sorted({(d, t or "") for d, t in PAIRS if d is not None and d != 305}, reverse=True)
    for (d, t), (_, other) in zip(single, single[1:]):
        if d in (306,) or (d, 305)[0] == 306:
            continue  # followed by the repeated row
        h = len(t) // 2
        edited = t[: len(t) - h] + other[:h]
        a, b, c = (brute.signatures(x, spotsigs.ANCHORS) for x in (t, edited, other))
        r = got[d, "".join(sorted(a))]
        assert (r.n_chars, r.edited_sha256, r.edited_fingerprint) == (len(t), brute.sha(edited), "".join(sorted(b)))
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b)) and r.near_next == pytest.approx(len(a & c) / len(a | c))


def test_spot_signature_floor(spark):
    sets = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 5]), ([1], [1, 2, 3]), ([1, 2], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in sets.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.5)).collect()] == [0.6, 0.0, 1.0]


def test_token_counts(docs, empty):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    special = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(SPECIAL, "doc_id long, text string"))
    got = token_counts.count_tokens(special, path, 100)
    tok = token_counts.tokenizer(path)
    want = [(d, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 100) for d, t in PAIRS + SPECIAL]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.count_tokens(empty, path, 100).count() == 0


SPECIAL = [
    (1000 + i, t)
    for i, t in enumerate(
        ["a <|endoftext|> b", "<|endoftext|>", " x\n\ny \n z", "é ñ\nü  ö", "a b c　d  e", "I'll DON'T we've 's", "1 22 ½ ٣", "\n", " ", "a\n b", "\x1c \x1d x\x85y", "word " * 9, "a\nb\nc d", "̀x ́\ny"]
    )
]


def test_packing(docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = token_counts.tokenizer(path)
    pairs = PAIRS + SPECIAL
    special = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(SPECIAL, "doc_id long, text string"))
    got = packing.pack_documents(special, path, 256, 1).collect()
    want = []
    for d, t in pairs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want.append((d, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    check_bins(got, 256)
    assert packing.pack_documents(empty, path).count() == 0


def check_bins(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // capacity) * 1.1 + 1


@pytest.mark.parametrize("counts", [{7: 1}, {4: 1000, 3: 1000}, {10: 5}, {n: 3 for n in range(1, 11)}, {6: 4, 5: 4, 4: 4, 1: 3}, {}])
def test_bin_plan(counts):
    plan = packing.plan_bins(counts, 10)
    used = {}
    for line, nxt in zip(plan, [*plan[1:], None]):
        last = nxt[1] if nxt is not None and nxt[0] == line[0] else counts[int(line[0])]
        for k in range(int(last - line[1])):
            at = (int(line[3] + k // line[2]), int(line[4] + k % line[2] * line[0]))
            assert at not in used
            used[at] = int(line[0])
    assert sorted(used.values()) == sorted(x for n, c in counts.items() for x in [n] * c)
    fill = {}
    for (b, offset), length in sorted(used.items()):
        assert fill.get(b, 0) == offset
        fill[b] = offset + length
    assert all(x <= 10 for x in fill.values())


def test_simhash(docs, empty):
    got = simhash.link_documents(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("f"), "component_id")
    want = brute.components(PAIRS)
    assert rows_of(got, "doc_id", "f", "component_id") == sorted(want, key=repr)
    assert simhash.link_documents(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.keep_one(empty).count() == 0


def test_simhash_dense_group(spark):
    """More prints around one signature than are compared pair by pair, and a chain between two centres."""
    rng = random.Random(5)
    prints = set()
    for centre in (rng.getrandbits(63), rng.getrandbits(63)):
        prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 40) for b in range(a, 40, 3)}
    a, b = sorted(prints)[0], sorted(prints)[-1]
    for bit in range(64):
        if (a ^ b) >> bit & 1:
            a ^= 1 << bit
            prints.add(a)
    prints |= {rng.getrandbits(63) for _ in range(500)}
    prints = sorted(prints)
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()
    got, want = {p: p for p in prints}, {p: p for p in prints}

    def find(g, x):
        while g[x] != x:
            g[x] = g[g[x]]
            x = g[x]
        return x

    for e in edges:
        assert (e.a ^ e.b).bit_count() <= 4
        got[find(got, e.a)] = find(got, e.b)
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 4:
                want[find(want, p)] = find(want, q)
    classes = lambda g: sorted(sorted(p for p in prints if find(g, p) == r) for r in {find(g, p) for p in prints})
    assert classes(got) == classes(want)


def test_line_templates(docs, empty):
    got = line_templates.dedup_lines(docs)
    want = brute.line_dedup(PAIRS)
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", "text") == sorted(want, key=repr)
    assert sum(a != b for a, b in zip(PAIRS, want)) > 10
    assert all(r.n_chars == len(r.text or "") for r in got.select("text", "n_chars").collect())
    assert line_templates.dedup_lines(empty).count() == 0


def test_line_template_fields(spark):
    rows = [(i, f"Member {i} of the old club paid {7 * i} coins\nown {chr(97 + i)} line here") for i in range(4)] + [(9, "x y")]
    got = {r.doc_id: r.n_dropped for r in line_templates.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: 0}


def test_license_templates(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (3, "a/b/c/x.py", "code"),
        (4, "a/y.py", "code"), (5, "z.py", "code"), (6, "a/b/own.py", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"), (7, None, "All rights reserved."),
        (8, None, None), (9, "a/b/c/x.py", "code"), (10, "q/w.py", "A licence for cows and one copyright for hens in every garden of the town"), (11, "a/empty.py", ""),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("clash")).withColumn("folder", F.lit("clash"))
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in license_templates.scan_licenses(files, ["doc_id"]).collect()}
    assert got == {
        1: ("MIT", "MIT", None), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "Apache-2.0", "a/b"), 4: (None, "MIT", "a"), 5: (None, None, None), 6: ("GPL-3.0", "GPL-3.0", None),
        7: ("Proprietary", "Proprietary", None), 8: (None, None, None), 9: (None, "Apache-2.0", "a/b"), 10: (None, None, None), 11: (None, "MIT", "a"),
    }
    assert license_templates.scan_licenses(files.limit(0)).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 8)
    want = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", brute.jump(d or 0, 8), brute.jump(d or 0, 9)) for d, t in PAIRS]
    assert rows_of(got, "doc_id", "size", "text_crc32", "law", "shard", "grown_shard") == sorted(want, key=repr)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, 8).count() == 0


def test_jump_moves_only_to_the_new_shard(spark):
    ids = spark.range(3000).select("id", sharding.jump_shard(F.col("id"), 40).alias("a"), sharding.jump_shard(F.col("id"), 41).alias("b")).collect()
    assert all(r.a == r.b or r.b == 40 for r in ids) and 20 < sum(r.b == 40 for r in ids) < 150


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs, (1, 2, 3), 3, "mix").collect()
    want, goal = brute.mix([r for r in ROWS if r[0] != 305]), brute.targets(ROWS)
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in plan} == {s: x for s, x in goal.items()}
    assert any(t == 3 * n for n, t in goal.values() if n) and any(0 < t < 3 * n for n, t in goal.values())
    for source, (size, target) in goal.items():
        taken = sum(r.copies * r.size * r.n_rows for r in plan if r.source == source)
        assert abs(taken - target) <= max((r.size * r.n_rows for r in plan if r.source == source), default=0)
    assert all(0 <= r.copies <= 3 for r in plan)
    assert len(want) == len({r for r in ROWS if r[0] != 305})
    mixed = mixing.mix_documents(docs, (1, 2, 3), 3, "mix")
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies * r.n_rows for r in plan)
    assert rows_of(mixed, "doc_id", "text") == rows_of(mixing.mix_documents(docs.repartition(3), (1, 2, 3), 3, "mix"), "doc_id", "text")
    assert mixing.mix_plan(empty, (1, 2, 3), 3, "mix").count() == mixing.mix_documents(empty, (1, 2, 3), 3, "mix").count() == 0


def test_mixing_draws(spark):
    rows = sorted({r for r in ROWS if r[0] is not None and r[0] != 305}, key=repr)
    plan = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), (1, 2, 3), 3, "mix")
    assert rows_of(plan, "doc_id", "source", "copies") == sorted(((d, s, n) for (d, _, s), n in brute.mix(rows).items()), key=repr)


def test_near_copies_by_five_words(spark):
    """Near copies of short and long texts at 0.8 and above, most of them over 4 bits apart, and others below."""
    rng = random.Random(11)
    texts = []
    for i in range(60):
        words = [f"{rng.choice(VOCABULARY)}{rng.randrange(50)}" for _ in range(rng.choice([60, 150, 400]))]
        texts.append(" ".join(words))
        for _ in range(2):
            near = list(words)
            for k in rng.sample(range(len(near)), max(1, len(near) * rng.choice([1, 2, 6]) // 100)):
                near[k] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(near))
    texts += [None, "", " \n", "Two words", "two  WORDS"]
    sets, prints = [brute.five_grams(t) for t in texts], [brute.simhash(t) for t in texts]
    apart = [(brute.alike(sets[i], sets[j]), (prints[i] ^ prints[j]).bit_count() <= 4) for i in range(len(texts)) for j in range(i)]
    assert apart.count((True, False)) > 20
    least = brute.one_of_similar(list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one_similar(docs).collect()) == least
    assert similar.keep_one_similar(docs.limit(0)).count() == 0


def kept_ids(spark, texts):
    return sorted(r.doc_id for r in similar.keep_one_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())


def framed(rng, frame, own):
    return " ".join([*frame, *(f"w{rng.randrange(10**6)}" for _ in range(own))])


def test_near_copies_of_framed_pages(spark):
    """Pages of one frame stay unless they are alike; each near copy in their large buckets is found."""
    rng = random.Random(5)
    frame = [f"f{i}" for i in range(260)]
    pages = [framed(rng, frame, 60) for _ in range(160)]
    near = []
    for page in pages:
        words = page.split()
        words[300] = "other"
        near.append(" ".join(words))
    assert all(brute.alike(brute.five_grams(a), brute.five_grams(b)) for a, b in zip(pages, near))
    assert kept_ids(spark, pages + near) == list(range(160))


def test_near_copies_of_known_passages(spark, monkeypatch):
    """Pages put together from few passages have no rare gram: buckets are compared by pivots."""
    rng = random.Random(6)
    passages = [[f"p{i}w{k}" for k in range(20)] for i in range(24)]
    picks = [sorted(rng.sample(range(24), 16)) for _ in range(120)]
    picks += [sorted({*p, *rng.sample([x for x in range(24) if x not in p], 1)}) for p in picks[:40]]
    texts = [" ".join(w for i in p for w in [*passages[i], f"end{i}", "of", "this", "part", f"p{i}"]) for p in picks]
    want = brute.one_of_similar(list(enumerate(texts)))
    assert 20 < len(want) < 150
    rounds = []
    verified = similar._verified
    monkeypatch.setattr(similar, "_verified", lambda *a: rounds.append(1) or verified(*a))
    assert kept_ids(spark, texts) == want
    assert len(rounds) > 2  # stars, rare grams, and rounds of pivots


def test_near_copies_hold_other_columns_and_ids(spark):
    """Repeated ids with different texts, repeated rows, and columns named like those of the operator."""
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long, 7, 1), (1, "other words than those above here", 7, 2), (2, long + " end", 8, 3), (2, long + " end", 8, 3), (None, long, 9, 4)]
    got = similar.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, digest long, root long"))
    assert got.columns == ["doc_id", "text", "digest", "root"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows[:2])


def test_license_versions_and_variants(spark):
    """Each notice 20 times: versions and variants of a licence are told apart, and unknown ones are none."""
    notices = {
        "GNU General Public License, version 2.": "GPL-2.0", "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "This work is licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0", "Licensed under the LGPLv2.1.": "LGPL-2.1",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY 3.0.": None,
        "Licensed under the BSD 2-Clause License.": "BSD-2-Clause", "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the BSD 4-Clause License.": None,
        "Licensed under the MIT License.": "MIT", "# http://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0", "Licensed under the Apache License, Version 1.1.": None,
        "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License\n// version 2.": "GPL-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies.": "ISC",
        "Copyright 2024 Some Firm SA, 3 rooms. All rights reserved.": "Proprietary",
    }
    files = spark.createDataFrame([(k * 20 + i, f"d{k}/f{i}.py", f"{n}\nx = {i}") for k, n in enumerate(notices) for i in range(20)], "doc_id long, path string, text string")
    got = {r.doc_id // 20: r.own_license for r in license_templates.scan_licenses(files, ["doc_id"]).collect()}
    assert {n: got[k] for k, n in enumerate(notices)} == notices


def cut_lines(spark, texts):
    got = line_templates.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r.text.split("\n") for r in got.orderBy("doc_id").collect()]


def test_line_templates_of_one_leaf(spark):
    """Three templates with a variable field in one leaf."""
    names = ["Ann", "Bob", "Cid", "Dee"]
    lines = [[f"This page was seen by {x} on our wiki", f"This page was printed for {x} at the library", f"This page was sent from {x} with kind regards"] for x in names]
    assert {len(x.split()) for y in lines for x in y} == {9}
    got = cut_lines(spark, ["\n".join([*x, f"body {n}"]) for x, n in zip(lines, names)])
    assert got == [[*lines[0], "body Ann"], *([f"body {n}"] for n in names[1:])]


@pytest.mark.parametrize("more", [0, 30])
def test_line_templates_beside_commoner_lines(spark, more):
    """Each piece of a template lies in a commoner line of another one, alone or in a crowd."""
    common = [*(["one two three a b k l m n o"] * 5), *(["one two three p q c d r s t"] * 5)]
    common += [f"one two three a b k{chr(97 + i // 9)} l{chr(97 + i % 9)} u{chr(97 + i)} v w" for i in range(min(more, 26)) for _ in range(2)]
    lines = [f"one two three a b c d e f {x}" for x in ("Ann", "Bob", "Cid", "Dee")]
    got = cut_lines(spark, [f"{x}\nbody" for x in lines] + common)
    assert got[:4] == [[lines[0], "body"], *([["body"]] * 3)]


def test_line_templates_keep_different_lines(spark):
    """Rows of numbers and short sentences of one leaf stay; copies of them go."""
    own = [["12 7 2021", "I do not know", "5 of 9"], ["3 44 1999", "I do not care", "6 of 9"], ["8 80 800", "I do not agree", "7 of 9"]]
    same = ["1 2 3", "All rights are reserved", "Page 3 of 10"]
    assert cut_lines(spark, ["\n".join([*x, *same]) for x in own]) == [[*own[0], *same], *own[1:]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_templates_like_brute_force(spark, seed):
    """Leaves of several templates, numbers, short lines, odd blanks, lines that meet several leads."""
    rng = random.Random(seed)
    heads = ["This page was", "seen on 12", "a b c", "1 2 3", "x <*> y"]
    tails = ["seen", "printed", "for", "by", "Ann", "Bob", "at", "the", "wiki", "7", "99", "<*>", "our"]
    blank = lambda: rng.choice([" ", " ", " ", " ", "  ", "\t", "\r"])

    def line():
        tokens = rng.choice(heads).split(" ")[: rng.choice([1, 3, 3, 3, 3])] + rng.choices(tails, k=rng.choice([0, 1, 3, 4, 4, 5, 8]))
        return rng.choice(["", "", "", " "]) + "".join(t + blank() for t in tokens[:-1]) + tokens[-1]

    shared = [line() for _ in range(25)]
    frames = ["This page was seen by {} on our wiki", "This page was printed for {} at the wiki", "This page was seen today at your {}"]
    rows = []
    for i in range(40):
        text = [line() for _ in range(6)] + rng.sample(shared, 4) + [f.format(rng.choice(["Ann", "Bob", "Cid", "9", f"N{i}"])) for f in frames]
        rng.shuffle(text)
        rows.append((i if i else None, "\n".join(text)))
    rows += [(50, rows[4][1]), (51, rows[4][1]), (4, rows[4][1]), (52, ""), (53, None), (54, "\n \n\t\n"), (55, "This page was seen today by the team")]
    got = line_templates.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = brute.line_dedup(rows)
    assert rows_of(got, "doc_id", "text") == sorted(want, key=repr)
    assert sum(len(a[1] or "") - len(b[1] or "") for a, b in zip(rows, want)) > 2000
