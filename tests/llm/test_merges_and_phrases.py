"""BPE by merges against the library; collocations against counts of every phrase."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pcgspark.llm import collocations, merge_bpe
from pcgspark.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
FILE = P.path("byte_bpe_50k.json")
VOCABULARY, LIBRARY = merge_bpe.Vocabulary(FILE), Tokenizer.from_file(FILE)
PIECES = st.sampled_from(["the ", "'ll", " 12", "<|endoftext|>", "<|endof", "\n\n ", "é", "漢字", "\U00000558", "\U0003d000", "😀", "aaaa", " ", "\t", "\U000000a0", "x'S", "\U00000301", "\U0000fffd", "\x00", "?!"])


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(PIECES, max_size=14).map("".join)))
def test_merges_against_the_library(text):
    own = VOCABULARY.load()
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == ids_of(text)
    assert own.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(ids):
    assert VOCABULARY.load().decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 30_000, " " * 50_000 + "x", "é" * 5000, "x\n" * 20_000, "a" * 20_001, "the'll " * 200_000])
def test_long_runs(text):
    assert np.frombuffer(VOCABULARY.load().encode(text), "<u4").tolist() == ids_of(text)


def test_every_character_is_cut_like_the_library():
    own = VOCABULARY.load()
    for first in range(0, 0x110000, 0x800):
        text = "".join(f"a{c}1{c}! {c} " for c in map(chr, range(first, min(first + 0x800, 0x110000))) if not "\ud800" <= c <= "\udfff")
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(text), hex(first)


def test_merge_rows(spark, odd, empty):
    got = {(r["doc_id"], r["n_tokens"]): r for r in merge_bpe.round_trip(odd, VOCABULARY).collect()}
    for r in odd.collect():
        ids = ids_of(r["text"] or "")
        row = got[(r["doc_id"], len(ids))]
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert merge_bpe.round_trip(odd, VOCABULARY).count() == odd.count() and merge_bpe.round_trip(empty, VOCABULARY).count() == 0


def test_merge_columns(spark, docs_of):
    docs = docs_of(["a b", None, "<|endoftext|>"]).selectExpr("doc_id", "text", "7 as ids", "'x' as decoded")
    tokens = merge_bpe.encode(docs, VOCABULARY)
    assert tokens.columns == ["doc_id", "text", "ids", "decoded", "ids_"] and all(r["ids"] == 7 for r in tokens.collect())
    back = merge_bpe.decode(tokens, VOCABULARY, "ids_")
    assert [(r["decoded"], r["decoded_"], r["ids_"]) for r in back.orderBy("doc_id").collect()] == [("x", "a b", ids_of("a b")), ("x", "", []), ("x", "<|endoftext|>", [50256])]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="end_of_word_suffix"):
        merge_bpe.Vocabulary(P.path("word_bpe_49k.json"))


def test_stale_entries():
    own = merge_bpe.MergeBpe({c: i for i, c in enumerate(["a", "b", "c", "bc", "ab", "abc", "aa"])}, [("b", "c"), ("a", "b"), ("a", "bc"), ("a", "a")], {})
    assert own.merge([0, 1, 2]) == [5]  # a-b is queued, and stale after b-c
    assert own.merge([0, 0, 0]) == [6, 0] and own.merge([0, 0, 1, 2]) == [0, 5] and own.merge([]) == []


# -- collocations -----------------------------------------------------------------------------------------------------
def plain(rows, longest=3, least=10, inside=50, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                part = (lang, w[i : i + m])
                if 100 * a >= inside * found[part]:
                    gone.add(part)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:first], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize(("longest", "least", "inside", "first"), [(3, 10, 50, 2000), (4, 3, 80, 25), (2, 2, 50, 7)])
def test_collocations(spark, odd, monkeypatch, longest, least, inside, first):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 1 << 14)
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")).repartition(3)
    want = plain([(r["text"], r["lang"]) for r in docs.collect()], longest, least, inside, first)
    assert want and rows_of(collocations.collocations(docs, longest, least, inside, first)) == want


def test_collocation_rules(spark, docs_of):
    texts = ["A b, a B. a b\nb\ta a  b", "İ É\u00a0x É\u00a0x", None, "", " .,\t!", "a a a a", "und x y"]
    docs = docs_of(texts * 2, ["en", None, "en", "en", None, "de", "und"] * 2)
    assert rows_of(collocations.collocations(docs, 3, 2)) == plain([(r["text"], r["lang"]) for r in docs.collect()], 3, 2)


def test_exact_scores(spark):
    a, left, right = 123_456_789_012, 999_999_999_999, 123_456_789_013
    got = spark.range(1).select(collocations.score_of(*[collocations.F.lit(x) for x in (a, left, right)])).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_no_phrases(spark, empty, docs_of):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(docs_of(["a b", "c d"])).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, longest=1)


def test_lists_are_vertical(spark, docs_of):
    """A word has one list in a block, in order, and its length is its count."""
    with Scratch(spark) as keep:
        rows = keep(collocations.word_lists(docs_of(["x y x", "x. y"]).coalesce(1))).orderBy("g", "data").collect()
    counts, places = collocations.unpack(next(r["data"] for r in rows if r["data"]))
    lists = dict(zip([r["word"] for r in rows if r["word"]], np.split(places, np.cumsum(counts)[:-1]), strict=True))
    assert {w: x.tolist() for w, x in lists.items()} == {"x": [1, 3, 5], "y": [2, 7]} and {r["word"]: r["n"] for r in rows if r["word"]} == {"x": 3, "y": 2}


def test_one_exchange_for_counting_and_looking_up(spark, docs_of):
    with Scratch(spark) as keep:
        lists = keep(collocations.word_lists(docs_of(["x y x", "x. y"]))).filter("data is null")
        tagged = collocations._tagged(lists, ["lang", "word"], 2)
        assert len(tagged.collect()) == 4 and "ReusedExchange" in tagged._jdf.queryExecution().executedPlan().toString()


def test_texts_without_words(spark, docs_of):
    assert collocations.collocations(docs_of([None, "", " \t", ".,;\n!?", "\x0b\x0c"], [None, "en", "de", None, "en"])).count() == 0
