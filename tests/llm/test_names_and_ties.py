"""Columns of the same name as an operator's own, repeated ids, many languages, added tokens, planted passages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import docs_of
from gatewright.llm.queries import published_pattern, tokenizer


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    import corpus_pipeline as c

    own = ["score", "lang_pred", "ambiguous", "spans", "kept", "n_bytes", "kept_text", "_hash", "_key", "_size", "_bytes"]
    texts = [f"plain words number {i} of many that differ in {i * 7} ways and more" for i in range(6)]
    docs = docs_of(spark, texts).withColumns({"lang": F.lit("en"), **{n: F.concat(F.lit(f"mine {n} "), "doc_id") for n in own}})
    want = {r["doc_id"]: r.asDict() for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert {r["doc_id"]: r.asDict() for r in got.collect()} == want, name


def test_graph_search_finds_equals_of_a_vector_whose_id_repeats(spark):
    from gatewright.llm.hnsw import nearest

    v, rng = [1.0, 2.0, 0.5], np.random.default_rng(4)
    rows = [(20, v)] * 31 + [(100 + i, v) for i in range(25)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(40)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 20, k=20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found if r["score"] == found[-1]["score"]][-1] <= 124
    assert len(found) == 20 and all(r["vec_id"] != 20 for r in found)
    assert sum(100 <= r["vec_id"] < 125 for r in found) + sum(r["score"] > 5.25 for r in found) == 20


@pytest.mark.parametrize("n", [2, 4, 9, 64, 70, 300])
def test_codewords_differ(n):
    from gatewright.llm.langid import codewords

    code = codewords(n, 15)
    assert len({tuple(c) for c in code.tolist()}) == n
    assert (np.abs(code.sum(0)) < n).all()


def test_pieces_take_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    from gatewright.llm.packing import token_pieces

    file = tokenizer("byte_bpe_50k.json")
    texts = ["hello<|endoftext|> world", "<|endoftext|>", "a <|endoftext|><|endoftext|>b  <|endo", "no such string", None]
    got = {r["doc_id"]: bytes(r["ids"]) for r in token_pieces(docs_of(spark, texts), file, published_pattern(), 2048).collect()}
    library = Tokenizer.from_file(file)
    for i, t in enumerate(texts):
        assert got[i] == np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


def test_planted_passages_go_and_clean_texts_stay(spark):
    from gatewright.llm.repeats import remove_repeats

    passage = " ".join(f"planted{i} passage" for i in range(60))  # over 50 words and 400 bytes
    clean = [" ".join(f"w{i}x{k}" for k in range(90)) for i in range(20)]
    texts = clean + [f"{clean[i][:200]}{i} {passage} {i} end of text {i}" for i in range(5)]
    rows = remove_repeats(docs_of(spark, texts)).select("doc_id", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "kept_text").collect()
    for r in rows:
        assert (r["n_removed"] >= len(passage)) == (r["doc_id"] >= 20) and ("planted9 passage" in r["kept_text"]) is False
        assert r["doc_id"] >= 20 or r["n_removed"] == 0


def test_short_passages_of_over_fifty_words_go(spark, small):
    import random
    import re

    from corpus_pipeline import without_repeats

    draw = random.Random(8)

    def noise(n):
        return " ".join("".join(draw.choice("abcdefghé") for _ in range(draw.randint(2, 5))) for _ in range(n))

    passage = noise(55)
    assert len(passage.encode()) < 400
    texts = [noise(60), *(f"{noise(20 + i)} {passage}\n{noise(30)}" for i in range(3)), f"{noise(9)}\t{passage.replace(' ', '  ')} {noise(9)}",
             f"{noise(70)} {' '.join(passage.split()[:50])} {noise(5)}", "on and " * 30 + noise(60)]
    docs = docs_of(spark, texts, 50_000).unionByName(small.where("doc_id < 60"))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for _, t in rows]
    at = {}
    for d, (_, t) in enumerate(rows):
        for size, places in (("w", [(tuple(t[a:z] for a, z in words[d][i : i + 51]), words[d][i][0], words[d][i + 50][1]) for i in range(len(words[d]) - 50)]),
                             ("b", [(t[i : i + 400], i, i + 400) for i in range(len(t) - 399)])):
            for string, a, z in places:
                at.setdefault((size, string), []).append((d, a, z))
    gone = [np.zeros(len(t), bool) for _, t in rows]
    for places in at.values():
        for d, a, z in places if len(places) > 1 else []:
            gone[d][a:z] = True
    want = {i: bytes(np.frombuffer(t, np.uint8)[~g]).decode("utf-8", "ignore") for (i, t), g in zip(rows, gone)}
    got = {r["doc_id"]: r["text"] for r in without_repeats(spark, docs, "").collect()}
    assert got == {i: t for i, t in want.items() if t}
    assert not any(" ".join(passage.split()[:51]) in got[50_000 + i] for i in range(1, 4)) and got[50_000] == texts[0] and got[50_005] == texts[5]


def test_plain_words_are_encoded_by_the_vocabulary_alone():
    from tokenizers import Tokenizer

    from gatewright.llm.packing import Tokens

    path = tokenizer("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        own = Tokens(f.read(), published_pattern())
    library, rng = Tokenizer.from_file(path), np.random.default_rng(8)
    ids = lambda texts: [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
    alphabets = ["ab 's", "\t\n\r  x.", "aßñ Éžɏ¡­²ª", "a  \u0085\u001c\u0000\u007f1", "é €😀ำ٣́", "wort Ǆ12.,-"]
    texts = ["".join(rng.choice(list(a), int(n))) for a in alphabets for n in rng.integers(0, 60, 60)]
    texts += ["".join(map(chr, range(0x250))), "x" * 5000, "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", None, ""]
    assert ids(texts) == [library.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    own.known.clear()
    own.tokenizer = None  # plain words do not pass the library's other steps
    plain = ["Ein großer Wald, el niño; it's 12 words\n\tand more"]
    assert ids(plain) == [library.encode(t, add_special_tokens=False).ids for t in plain]


def test_no_task_of_the_pipeline_needs_two_python_workers(spark, monkeypatch):
    import corpus_pipeline as c
    from pyspark.sql.classic.dataframe import DataFrame

    passage = " ".join(f"shared{i}" for i in range(60))
    texts = [f"{' '.join(f'own{k}x{i}' for i in range(40))} {passage} tail{k}" for k in range(4)]
    below, plain = [], DataFrame.mapInArrow

    def watched(self, *args, **kwargs):
        below.append(self._jdf.queryExecution().analyzed().toString())
        return plain(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    docs = docs_of(spark, texts)
    for _, stage in c.STAGES[:-1]:
        docs = c.stored(stage(spark, docs, ""), "stage")
    kept = [r["text"] for r in docs.collect()]
    assert len(kept) == 4 and not any("shared" in t for t in kept)
    assert c.STAGES[-1][1](spark, docs, "").count() == 4
    assert len(below) > 10 and not [x for x in below if "MapInArrow" in x]
