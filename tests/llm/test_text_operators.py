"""Tokenising, packing, sharding, language, licenses, near copies and repeats against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(small, texts, nothing):
    import tiktoken

    from gatewright.llm.bpe import decode, parse_ranks, read_ranks, round_trip

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=parse_ranks(read_ranks(RANKS)), special_tokens={})
    coded = round_trip(small, RANKS, P.PATTERN)
    got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in coded.collect())
    assert got == Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    again = Counter((r["doc_id"], bytes(r["decoded"])) for r in decode(coded, RANKS).collect())
    assert again == Counter((i, (t or "").encode()) for i, t in texts)
    assert round_trip(nothing, RANKS, P.PATTERN).count() == 0


def test_bpe_of_long_and_odd_pretokens():
    import random

    import tiktoken

    from gatewright.llm.bpe import Encoder, parse_ranks, read_ranks

    ranks = parse_ranks(read_ranks(RANKS))
    enc, own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Encoder(ranks, P.PATTERN)
    draw = random.Random(1)
    cases = ["a" * 20_000 + "abcab" * 5_000] + ["".join(draw.choice("aab thé中0\n\t\x1c  'sA😀½") for _ in range(draw.randint(0, 300))) for _ in range(200)]
    assert all(own.encode(t).tolist() == enc.encode_ordinary(t) for t in cases)


def _packed_well(rows, lengths):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= math.ceil(sum(lengths) / 2048 * 1.02) + 1


def test_packing(small, texts, nothing):
    from tokenizers import Tokenizer

    from gatewright.llm.common import stored
    from gatewright.llm.packing import pack, token_pieces

    pieces = stored(token_pieces(small, TOKENIZER, P.PATTERN, 2048).withColumn("offset", F.lit("kept")), "t")
    rows = pack(pieces, 2048, ["doc_id", "piece", "start"]).collect()
    t = Tokenizer.from_file(TOKENIZER)
    expected = Counter()
    for i, x in texts:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expected.update((i, k, a, np.array(ids[a:z], "<u4").tobytes()) for k, (a, z) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows) == expected
    assert {r["offset_input"] for r in rows} == {"kept"}
    _packed_well(rows, [r["length"] for r in rows])
    empty = stored(token_pieces(nothing, TOKENIZER, P.PATTERN, 2048), "t")
    assert pack(empty, 2048, ["doc_id"]).count() == 0


@pytest.mark.parametrize("lengths", [[2048] * 5, [1] * 5000, [1025] * 7 + [1023] * 3, list(range(1, 2049)), [700] * 1000 + [300] * 10])
def test_histogram_packing_uses_every_piece_once(lengths):
    from gatewright.llm.packing import pack_histogram

    have = np.bincount(lengths, minlength=2049)
    used = np.zeros_like(have)
    for p, n in pack_histogram(have, 2048):
        assert n > 0 and sum(p) <= 2048
        for v in p:
            used[v] += n
    assert (used == have).all()


def test_shards(small, texts, nothing):
    from gatewright.llm.sharding import shuffle_into_shards

    placed = shuffle_into_shards(small.withColumn("slot", F.lit(7)), 40, seed=3, bucket_bytes=1 << 16).collect()
    assert Counter((r["doc_id"], r["text"]) for r in placed) == Counter(texts) and {r["slot_input"] for r in placed} == {7}
    sizes = Counter(r["shard"] for r in placed)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(n))
    few = shuffle_into_shards(small.limit(3), 40, seed=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in few) == [(0, 0), (1, 0), (2, 0)]
    assert shuffle_into_shards(nothing, 40, seed=3).count() == 0


def test_language(spark, small, nothing):
    from gatewright.llm.langid import fit, identify

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~out))
    held = identify(docs.where(out), model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    odd = {r["doc_id"]: r for r in identify(small.where("doc_id > 10000").withColumn("score", F.lit("x")), model).collect()}
    assert [odd[i]["lang_pred"] for i in (10_001, 10_002, 10_003, 10_004)] == ["und"] * 4 and odd[10_005]["lang_pred"] != "und"
    assert odd[10_001]["score"] == 0 and odd[10_001]["score_input"] == "x"
    assert fit(nothing) is None and identify(nothing, None).count() == 0
    assert {r["lang_pred"] for r in identify(small.limit(5), None).collect()} == {"und"}
    one = fit(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in identify(docs.limit(5), one).collect()} == {"de"}


def test_corpus_without_labels_stays(spark, small, nothing):
    from corpus_pipeline import known_language

    bare = small.withColumn("lang", F.lit(None).cast("string"))
    got = Counter((r["doc_id"], r["text"], r["lang"]) for r in known_language(spark, bare, "").collect())
    lettered = [(r["doc_id"], r["text"]) for r in small.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    assert got == Counter((i, t, None) for i, t in lettered)
    labelled = known_language(spark, small.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "und").otherwise(F.col("lang"))), "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in labelled) == Counter(lettered)
    assert known_language(spark, nothing, "").count() == 0


def test_licenses(spark, small, nothing):
    from conftest_llm import docs_of

    from gatewright.llm.licenses import NOTICES, PHRASES, scan

    planted = ["x Under the\nMIT   License, under-the-mit-license", "apache license version 20", "İ cc by nc cc by nc", "This work is licensed under the GNU General Public Licence, version 3!", "released under mit licence", "Kelvin Kunder the mit license", "ünder the mit license"]
    docs = small.unionByName(docs_of(spark, planted, 20_000))
    word, low = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def expected(text):
        text = (text or "").translate(low)
        w = word.findall(text)
        places = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels, best = {x for _, x in places}, 0.0
        base = ",".join(sorted(labels))
        for line in text.split("\n"):
            own = set(word.findall(line))
            for label, notice in NOTICES:
                n = set(notice.split())
                if len(own & n) >= math.ceil(0.8 * len(n) - 1e-9):
                    labels.add(label)
                    best = max(best, len(own & n) / len(n))
        return (len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, base, ",".join(sorted(labels)), 1.0 if places else best)

    got = Counter(tuple(r) for r in scan(docs).collect())
    assert got == Counter((r["doc_id"], *expected(r["text"])) for r in docs.collect())
    assert scan(nothing).count() == 0
    plan = scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
APACHE = "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"


def test_wrapped_notices(spark):
    import textwrap

    from conftest_llm import docs_of

    from gatewright.llm.licenses import scan

    cases = []
    for label, notice in (("mit", MIT), ("gpl", GPL), ("apache-2", APACHE)):
        for width in (20, 40, 76):
            for mark, end in (("", "\n"), (" * ", "\n"), ("REM ", "\r\n"), ("", "\n\n")):
                lines = textwrap.wrap(notice, width)
                cases.append((label, "first words\n" + end.join(mark + x for x in lines) + "\nlast words\n" * 9))
    w = MIT.split()
    cases.append(("", "\n".join(f"{x} " + "other words " * 5 for x in w)))  # too far apart
    cases.append(("", "\n".join(w[: len(w) // 2])))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan(docs_of(spark, [t for _, t in cases])).collect()}
    assert [got[k][0] for k in range(len(cases))] == [x for x, _ in cases]
    assert all(got[k][1] >= 0.8 if x else got[k][1] == 0 for k, (x, _) in enumerate(cases))


def test_first_word_counts_whole_characters(spark):
    from conftest_llm import docs_of

    from gatewright.llm.licenses import scan

    long_ = "\U0001F600 word\n" * 20_000  # characters beyond U+FFFF, and a match far from the start
    cases = [("\U0001F600" * 3 + " one under the mit license", 2), ("\U0001F600 a \U00020000 b under the mit license under the mit license", 4), (long_ + "under the mit license", 40_000)]
    got = {r["doc_id"]: r["first_word"] for r in scan(docs_of(spark, [t for t, _ in cases])).collect()}
    assert [got[k] for k in range(len(cases))] == [n for _, n in cases]


def _sets(texts, n):
    out = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def _classes(texts, n, num, den):
    """Per row: size of the set, smallest id reachable."""
    sets, lead = _sets(texts, n), list(range(len(texts)))

    def find(x):
        while lead[x] != x:
            x = lead[x]
        return x

    where = defaultdict(list)
    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x])
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                lead[find(k)] = find(j)
        for x in s:
            where[x].append(k)
    low = defaultdict(list)
    for k, (i, _) in enumerate(texts):
        low[find(k)] += [i] if i is not None else []
    return sets, [min(low[find(k)], default=None) for k in range(len(texts))]


@pytest.mark.parametrize("n,num,den,frequent", [(3, 90, 100, 64), (5, 80, 100, 64), (3, 80, 100, 3)])
def test_near_copies(spark, small, nothing, monkeypatch, n, num, den, frequent):
    import random

    from conftest_llm import docs_of

    from gatewright.llm import shingles

    monkeypatch.setattr(shingles, "FREQUENT", frequent)  # few copies then take the combination signatures
    monkeypatch.setattr(shingles, "BLOCK", 4 * frequent)
    draw, base, family = random.Random(5), [f"w{k}" for k in range(200)], []
    for _ in range(120):
        w = list(base)
        for _ in range(draw.randint(0, 9)):
            w[draw.randrange(200)] = f"e{draw.randrange(10**6)}"
        family.append(" ".join(w))
    docs = small.unionByName(docs_of(spark, family, 30_000))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets, lead = _classes(texts, n, num, den)
    got = Counter((r["id"], r["n_shingles"], r["component"]) for r in shingles.similar_groups(docs, n, num, den).collect())
    assert got == Counter((i, len(s), c) for (i, _), s, c in zip(texts, sets, lead))
    kept = Counter(r["doc_id"] for r in shingles.first_of_groups(docs, n, num, den).collect())
    assert kept == Counter({c for s, c in zip(sets, lead) if s and c is not None} | {None}) + Counter(i for (i, _), s in zip(texts, sets) if not s)
    assert shingles.similar_groups(nothing, n, num, den).count() == 0


@pytest.mark.parametrize("num,den", [(80, 100), (90, 100), (70, 100), (50, 100)])
def test_short_sets_of_frequent_tokens_meet(num, den):
    from gatewright.llm.shingles import signatures

    head = 1 << 62
    # frequent ones of eight classes and two more of the same classes; one rare, two beyond the head
    universe = np.array([8000 + 8 * 97 * k + k for k in range(8)] + [16_003, 24_003, 40_000, head + 5, head + 9], np.uint64)
    frequent = np.sort(universe[:10])
    masks = range(1, 1 << len(universe))
    shown, size = [], np.array([m.bit_count() for m in masks])
    for m in masks:
        own = np.sort(universe[[k for k in range(len(universe)) if m >> k & 1]])
        shown.append(set(signatures(own, head, frequent, num, den).tolist()))
    all_ = np.array(masks)
    pairs = 0
    for m in list(masks)[::7]:
        common = np.bitwise_count(all_ & m).astype(int)
        for other in np.flatnonzero((den * common >= num * (size + size[m - 1] - common)) & (all_ != m)):
            pairs += 1
            assert shown[m - 1] & shown[other], (m, int(all_[other]))
    assert pairs > 500


def test_tasks_grow_with_dealt_rows(spark):
    from gatewright.llm.shingles import _shards

    members = spark.range(100_000).select(F.lit(1).alias("sig"), F.col("id").alias("row"), F.lit(25).cast("long").alias("blocks"))
    assert _shards(members) == 125 and _shards(members.where("false")) == 1


def test_suffix_arrays():
    from gatewright.llm.repeats import common_prefixes, suffix_array

    draw = np.random.default_rng(1)
    for _ in range(200):
        s = draw.integers(1, draw.integers(2, 6), draw.integers(1, 60))
        own = s.tolist()
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(own)), key=lambda i: own[i:])
        text = own
        got = common_prefixes(text, sa)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert got[b] == n


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeats(spark, small, nothing, monkeypatch, hot):
    import random

    from conftest_llm import docs_of

    from gatewright.llm import repeats

    monkeypatch.setattr(repeats, "HOT_WINDOWS", hot)  # with 1, all open cores are counted string by string
    draw = random.Random(3)

    def noise(n):
        return "".join(draw.choice("abcdefgh ijkl mnop é") for _ in range(n))

    passage, loop = noise(700), "ab" * 600
    planted = [noise(300) + passage[k:] + noise(200) for k in (0, 50, 333)] + [passage[:399] + noise(10), passage[5:405], noise(50) + loop, passage + noise(5) + passage]
    docs = small.unionByName(docs_of(spark, planted, 40_000))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(t[p : p + 400] for _, t in rows for p in range(len(t) - 399))
    expected = Counter()
    for i, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p + 1 : p + 401] = True
        kept = bytes(b for b, x in zip(t, gone[1:]) if not x)
        expected[i, len(t), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = repeats.remove_repeats(docs.withColumn("kept", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got) == expected
    assert all(r["kept_input"] == 1 and r["kept_text"] == bytes(r["kept"]).decode("utf-8", "ignore") for r in got)
    assert repeats.remove_repeats(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    from gatewright.llm.components import components

    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_checksums_agree(spark):
    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary"))).first()[0] == zlib.crc32("é".encode())
