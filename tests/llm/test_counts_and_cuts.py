"""Fill-in-middle cuts, collocations and token counts against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest_llm import docs_of
from gatewright.llm import collocations as C
from gatewright.llm import infill as I
from gatewright.llm import token_counts as N
from gatewright.llm.queries import published_pattern, tokenizer

# ---------------------------------------------------------------- op11


def tokens_of(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def cut_by_hand(doc_id, text):
    text, w = text or "", tokens_of(text or "")
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    a, b = sorted(v % (len(w) + 1) for v in h[:2])
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind, mask", [
    ("array", np.arange(I.SPAN) % 1000 == 7),
    ("bitmap", np.random.default_rng(1).random(I.SPAN) < 0.4),
    ("run", (np.arange(I.SPAN) // 5000) % 2 == 1),
])
def test_each_container_selects(kind, mask):
    c = I.container(mask)
    assert c.kind == kind
    at = np.flatnonzero(mask)
    for k in (0, 1, len(at) // 2, len(at) - 1):
        assert c.select(k) == at[k]


@pytest.mark.parametrize("text", ["", "a", "7", "ab", "a b", "12ab", "é€😀a", "ab" * 70_000, "a " * 70_000, "x" * I.SPAN, "x" * I.SPAN + "y z", "." * (I.SPAN + 5), ("word " * 20 + "!" * 9000) * 15])
def test_offsets_of_all_kinds_of_texts(text):
    bounds, words = I.BoundarySet(text), tokens_of(text)
    assert len(bounds) == len(words)
    ends = np.cumsum([0, *map(len, words)])
    picks = range(len(words) + 1) if len(words) < 300 else random.Random(3).sample(range(len(words) + 1), 200)
    assert all(bounds.offset(k) == ends[k] for k in picks)


def test_cuts_equal_a_plain_version_and_restore(small, texts):
    out = I.fill_in_middle(small.select("doc_id", "text"))
    got = out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", I.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[2:7]) == cut_by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_sentinels_stay_plain_and_parts_of_them_restore(spark):
    odd = ["a <P> b", "x<S>", "<M>", "<", "<P", "P>", "<<P", "S>M>", "<S <P <M", "a<P\n>", "<\n" * 40]
    rows = I.fill_in_middle(docs_of(spark, odd * 20)).select("text", "form", I.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in rows)
    assert all(r["form"] == "plain" for r in rows if any(s in r["text"] for s in ("<P>", "<S>", "<M>")))


def test_cuts_keep_clashing_columns_and_take_no_rows(spark, nothing):
    docs = docs_of(spark, ["one two three"]).withColumns({"n": F.lit("mine"), "FORM": F.lit(3), "output": F.lit(None).cast("string")})
    row = I.fill_in_middle(docs).first()
    assert (row["n_input"], row["FORM_input"], row["output_input"]) == ("mine", 3, None)
    assert I.fill_in_middle(nothing).count() == 0


# ---------------------------------------------------------------- op12


def mined_by_hand(rows, least, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", t):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        own = [p for p, a in c.items() if len(p) > 1 and a >= least]
        most = Counter()
        for q in own:
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q):
                        most[q[i:j]] = max(most[q[i:j]], c[q])
        scored = []
        for p in own:
            a = c[p]
            if 100 * most[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def mined(docs, **options):
    return sorted(tuple(r) for r in C.collocations(docs, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top", [(3, 50), (2, 100_000)])
def test_collocations_equal_a_plain_count(small, least, top):
    rows = [(r["text"], r["lang"]) for r in small.collect()]
    want = mined_by_hand(rows, least, top)
    assert {len(r[2].split(" ")) for r in want} >= {2, 3, 4}
    assert mined(small, least=least, top=top) == want


def test_collocations_of_odd_words(spark):
    odd = ["A b a B a b a b", "x\x0by\x0cz q\tq q q q q", "é\xa0é é\xa0é é", "a b.a b,a b;c a b:c!a b?c\r\na  b", "ÀB cd ÀB cd", "\x00 \x01 \x00 \x01", None, "", " \t "]
    docs = docs_of(spark, odd * 3).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "xx"))
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert mined(docs, least=2) == mined_by_hand(rows, 2, 2000)


def test_collocations_across_blocks(spark, monkeypatch):
    """Windows at the seams of blocks count once."""
    numbers, words = C.word_numbers([b"a b c d a b c d a b c d, a b c d"] * 5)
    found = Counter()
    shorter = C.Bitmap(np.full(1, ~np.uint64(0)))
    for at in range(0, len(numbers), 7):
        p, n = C.phrases(numbers[at : at + 7 + 2], words, b"x", 3, shorter)
        found.update(dict(zip(p.to_pylist(), n.tolist())))
    p, n = C.phrases(numbers, words, b"x", 3, shorter)
    assert found == Counter(dict(zip(p.to_pylist(), n.tolist())))


def test_collocations_of_nothing(nothing, spark):
    assert mined(nothing) == []
    assert mined(docs_of(spark, ["one two", None])) == []


# ---------------------------------------------------------------- op13

JSON = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def counts(docs, **options):
    return Counter(tuple(r) for r in N.token_counts(docs, JSON, published_pattern(), **options).collect())


def expected(library, rows):
    n = [len(library.encode(t or "", add_special_tokens=False)) for _, t in rows]
    return Counter((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n))


@pytest.mark.parametrize("chunk, overlap", [(N.CHUNK, N.OVERLAP), (500, 100), (80, 80)])
def test_counts_equal_the_library(small, texts, library, chunk, overlap):
    assert counts(small, chunk=chunk, overlap=overlap) == expected(library, texts)


def test_counts_of_texts_that_align_late(spark, library):
    special = "<|endoftext|>"
    odd = ["x" * 5000, " " * 4000 + "a", "a b " * 50 + "y" * 3000 + " c d" * 50, special * 300, ("ab" + special) * 200, "it's they'll we've " * 150,
           "".join(f"{'z' * (k % 97)}'ll <|endo" for k in range(200)), "\n" * 777 + "é€😀 " * 300, "12 345 6789" * 200, "é" * 3000, special[:-1] * 200, " \t  " * 400]
    rows = list(enumerate(odd * 2))
    assert counts(docs_of(spark, odd * 2), chunk=100, overlap=100) == expected(library, rows)
    assert counts(docs_of(spark, odd), chunk=1000, overlap=200) == expected(library, rows[: len(odd)])


def test_counts_of_random_texts(spark, library):
    rnd = random.Random(8)
    made = ["".join(rnd.choice(["a", "B", "'", "l", "s", " ", "  ", "\n", "7", "é", "中", "😀", "<|endoftext|>", "<|", "..."]) for _ in range(rnd.randrange(300, 900))) for _ in range(150)]
    assert counts(docs_of(spark, made), chunk=90, overlap=70) == expected(library, list(enumerate(made)))


def test_counts_refuse_overlaps_that_prove_nothing(small):
    with pytest.raises(ValueError):
        N.token_counts(small, JSON, published_pattern(), chunk=50, overlap=60)
    with pytest.raises(ValueError):
        N.token_counts(small, JSON, published_pattern(), overlap=20)


def test_counts_of_nothing(nothing):
    assert counts(nothing) == Counter()
