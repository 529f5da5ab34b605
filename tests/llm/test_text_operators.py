"""Quality rules, token counts, byte-level BPE: against plain computations."""

import base64
import hashlib
import re
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pcgspark.llm import bpe, quality, token_counts
from pcgspark.llm.common import table

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\r\x0b\x0c"
TEXT = st.text(alphabet=st.sampled_from("aAbB #!|\n\té漢"), max_size=80)


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if g[x] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=5))
def test_measures(texts):
    got = quality.measure(pa.array(texts, pa.string())).to_pylist()
    assert [(m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) for m in got] == list(map(plain_measures, texts))


def test_quality_odd_rows(spark, odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["n_words"] == 0 and not by[0]["kept"] and by[4]["n_words"] == 40_000
    assert quality.judge(empty).count() == 0
    kept = quality.ledger(odd, into="l")
    assert set(odd.columns) < set(kept.columns) and kept.count() == odd.count()


def test_policies_and_ablation(spark, docs_of):
    words = " ".join(f"word{i}" for i in range(60))
    docs = docs_of([words, words + " #" * 40, "short", "short #", words.upper()])
    bits = quality.ledger(docs).select("ledger.fail_bits")
    loose = quality.Policy("loose", 2, ("too_few_words",))
    assert bits.filter(quality.passes(bits["fail_bits"], loose)).count() == 3
    got = {r["rule"]: r for r in quality.ablation(bits, quality.WEB).collect()}
    assert got["too_few_words"]["n_failed"] == 2 and got["symbols"]["n_failed"] == 2
    assert got["symbols"]["n_failed_alone"] == 1 and got["symbols"]["n_kept_without"] == 2
    with pytest.raises(ValueError):
        quality.ablation(bits, quality.Policy("none", 1, ()))


def test_token_counts(spark, odd, empty, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd.filter("doc_id > 4").selectExpr("doc_id + 100000", "text").toDF("doc_id", "text"))
    got = {r["doc_id"]: r for r in token_counts.count_documents(docs, P.path("piece_bpe_32k.model")).collect()}
    for r in docs.collect():
        n = len(sp.encode(r["text"] or ""))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"], got[r["doc_id"]]["n_bytes"]) == (n, n > 4096, len((r["text"] or "").encode()))
    assert token_counts.count_documents(empty, P.path("piece_bpe_32k.model")).count() == 0
    assert token_counts.count_documents(odd, P.path("piece_bpe_32k.model")).count() == odd.count()


def test_cache_encodes_only_misses(spark, docs_of, tmp_path):
    t = token_counts.SentencePieceCounter(P.path("piece_bpe_32k.model"))
    root = f"file://{tmp_path}"
    first = token_counts.count_tokens(docs_of(["a b", "a b", "c", None, "a▁b"]), t, root)
    assert [r["n_tokens"] for r in first.orderBy("doc_id").collect()] == [2, 2, 1, 0, 2]
    path = token_counts.cache_path(root, t.version)
    assert token_counts.read_cache(spark, path).count() == 3  # a space and its symbol are one content
    token_counts.append_misses(docs_of(["c", "d e f", ""]), t, root)
    assert token_counts.read_cache(spark, path).count() == 4


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.data.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=120), st.integers(4, 9))
def test_bpe_against_the_library(text, leaf):
    vocabulary = bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    b = vocabulary.load()
    assert b.pieces(text, leaf) == b.find.findall(text)
    data = text.encode("utf-8", "replace")
    assert b.tree(data, 1) == b.merge(data)
    assert b.decode(b.encode(text), 3) == data


def test_bpe_long_runs(vocabulary, library):
    b = vocabulary.load()
    for text in ("ab" * 40_000, " " * 70_000 + "x", "é" * 3000, "the'll " * 30_000, "x\n" * 50_000):
        assert b.encode(text) == library.encode_ordinary(text)


def test_bpe_rows(spark, odd, empty, vocabulary, library):
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.round_trip(odd, vocabulary).collect()}
    for r in odd.collect():
        ids = library.encode_ordinary(r["text"] or "")
        row = got[(r["doc_id"], len(ids))]
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.round_trip(empty, vocabulary).count() == 0
    tokens = bpe.encode(odd, vocabulary)
    back = bpe.decode(tokens, vocabulary).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back) and set(odd.columns) < set(tokens.columns)


def test_added_columns_never_replace_others(spark, docs_of, tmp_path):
    """A column with the name of an added one stays, and the added one gets underscores behind it."""
    from pcgspark.llm import langid, toxicity

    names = ["ids", "decoded", "n_tokens", "__digest", "ledger", "language", "toxicity"]
    docs = docs_of(["a b", None]).selectExpr("doc_id", "text", *[f"'mine' as `{n}`" for n in names])
    vocabulary = bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    counter = token_counts.SentencePieceCounter(P.path("piece_bpe_32k.model"))
    tokens = bpe.encode(docs, vocabulary)
    added = {
        "ids_": tokens, "decoded_": bpe.decode(tokens, vocabulary, "ids_"), "n_tokens_": token_counts.count_tokens(docs, counter, f"file://{tmp_path}"), "ledger_": quality.ledger(docs),
        "language_": langid.predict(docs, None), "toxicity_": toxicity.predict(docs, 0.5),
    }
    for name, df in added.items():
        assert df.columns[-1] == name and df.columns[: len(docs.columns)] == docs.columns
        assert all(r[n] == "mine" for r in df.collect() for n in names)
    assert [list(r["ids_"] or []) for r in tokens.orderBy("doc_id").collect()][1] == [] and [bytes(r["decoded_"]) for r in added["decoded_"].orderBy("doc_id").collect()] == [b"a b", b""]
