"""Dictionary segmentation against a path search by the letter, and its use in BM25."""

import math
import time

import numpy as np
from pyspark.sql import functions as F

from lodestone.functions.tokenize import DictionaryTokenizer, DoubleArray
from lodestone.operators import bm25


def brute(words, text):
    """Every position from the right: the best of (log probability, end), then single letters and digits that touch are put together."""
    words = {w.lower(): f for w, f in words.items() if w and f > 0}
    total, t = math.log(max(sum(words.values()), 1)), text.lower()
    best = [(0.0, len(t))] * (len(t) + 1)
    for i in range(len(t) - 1, -1, -1):
        best[i] = max((math.log(words.get(t[i:j], 1)) - total + best[j][0], j) for j in range(i + 1, len(t) + 1) if j == i + 1 or t[i:j] in words)
    parts, i = [], 0
    while i < len(t):
        parts.append(t[i : best[i][1]])
        i = best[i][1]
    out, plain = [], False
    for p in parts:
        now = len(p) == 1 and p in "abcdefghijklmnopqrstuvwxyz0123456789"
        out, plain = ([*out[:-1], out[-1] + p] if now and plain else [*out, p]), now
    return [p.strip() for p in out if p.strip()]


def test_equals_the_path_search_by_the_letter():
    rng = np.random.default_rng(4)
    letters = list("知识库测试数据的一是不了ab1 ，。X\n")
    for n in (0, 1, 5, 40, 300):
        words = {"".join(rng.choice(letters[:14], int(rng.integers(1, 6)))): int(rng.integers(1, 50)) for _ in range(n)}
        words |= {"": 4, "零": 0, "AB": 3} if n > 1 else {}
        tok = DictionaryTokenizer(words)
        texts = ["", " ", "a", "ab1", "零零", *["".join(rng.choice(letters, int(rng.integers(1, 80)))) for _ in range(120)], "知" * 500]
        assert tok.cut_all(texts) == [brute(words, t) for t in texts]
        assert [tok.cut(t) for t in texts[:20]] == tok.cut_all(texts)[:20]


def test_double_array_holds_exactly_its_words():
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abcdexyz"), int(rng.integers(1, 7)))): float(i) for i in range(2000)}
    trie = DoubleArray(words)
    text = "".join(rng.choice(list("abcdexyzq"), 3000))
    got = {(int(a), n): v for n, at, value in trie.matches(trie.codes(np.array([ord(c) for c in text]))) for a, v in zip(at, value, strict=True)}
    assert got == {(i, n): words[text[i : i + n]] for i in range(len(text)) for n in range(1, 7) if text[i : i + n] in words and i + n <= len(text)}


def test_vocabulary_table_and_bm25(spark):
    vocabulary = spark.createDataFrame([("知识", 100), ("知识库", 90), ("知识库", 100), ("测试", 100), (None, 5), ("无", 0)], "word string, frequency long")
    tok = DictionaryTokenizer.of(vocabulary)
    d = spark.createDataFrame([(1, "知识库测试 python3 的"), (2, "知识"), (3, None)], "chunk_id long, content string")
    assert [r[0] for r in d.orderBy("chunk_id").select(tok(F.col("content"))).collect()] == [["知识库", "测试", "python3", "的"], ["知识"], []]
    index = bm25.build_index(d, tokenizer=tok)
    found = bm25.search(index, spark.createDataFrame([(7, "测试知识")], "query_id long, query string"), tokenizer=tok)
    assert {r["chunk_id"] for r in found.collect()} == {1, 2}


def test_tries_of_many_words_are_built_level_by_level():
    rng = np.random.default_rng(6)
    letters = np.array([chr(0x4E00 + i) for i in range(900)] + list("abcdefghij𝒳"))
    wide = {"".join(rng.choice(letters, int(rng.integers(1, 4)))): float(i) for i in range(20_000)}  # a root of some 900 children
    narrow = {"".join(w): float(i) for i, w in enumerate(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), (100_000, 9)))}
    began = time.process_time()
    tries = [DoubleArray(wide), DoubleArray(narrow), DoubleArray({}), DoubleArray({"": 1.0})]
    assert time.process_time() - began < 8  # some 1 s; node by node it was 30 s for 200,000 words
    for words, trie in zip((wide, narrow), tries, strict=False):
        text = "".join(rng.choice(list(words), 300)) + "q" + "".join(rng.choice(letters, 3000))
        got = {(int(a), n): v for n, at, value in trie.matches(trie.codes(np.array([ord(c) for c in text]))) for a, v in zip(at, value, strict=True)}
        assert got == {(i, n): words[text[i : i + n]] for i in range(len(text)) for n in range(1, 10) if text[i : i + n] in words and i + n <= len(text)}
        assert len(trie.base) < 3 * len({w[:n] for w in words for n in range(1, len(w) + 1)}) + 5_000
    assert not any(len(at) for t in tries[2:] for _, at, _ in t.matches(t.codes(np.array([97, 98]))))


def test_tokens_as_arrow_arrays():
    words = {"知识库": 5, "　知识": 9, "测 试": 4, "𝒳𝒴": 7, "é": 2, "库\x85": 3}
    tok = DictionaryTokenizer(words)
    texts = ["知识库　知识测 试", "", "  \n", "a1 𝒳𝒴é\x1f库\x85é", "　", "é 𝒳 ab"]
    got = tok.segmented(texts)
    got.validate(full=True)
    assert str(got.type) == "list<item: string>"
    assert got.to_pylist() == tok.cut_all(texts) == [brute(words, t) for t in texts]
    assert tok.segmented([]).to_pylist() == [] and tok.segmented(["", ""]).to_pylist() == [[], []]
