"""Line dedup, Jaccard join, spot signatures and the pipeline: against brute force."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pcgspark.llm import components, jaccard_join, line_dedup, spotsigs
from pcgspark.llm.common import Scratch, materialise, table
from pcgspark.llm.jaccard_join import Spec

SF = "/root/testdata/sf0.001"


def plain_set(text, k):
    w = [x.encode().lower() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain_classes(texts, k, num, den):
    sets = {i: plain_set(t, k) for i, t in texts.items()}
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def edited(rng, words, share):
    return " ".join(rng.choice(["new", "odd", "x1", "x2"]) if rng.random() < share else w for w in words)


@pytest.fixture(scope="module")
def near():
    rng = random.Random(7)
    texts, passage = [], [f"p{i}" for i in range(30)]
    for size in (3, 4, 8, 15, 40, 120, 700):
        for base in range(5):
            words = [f"{size}b{base}w{rng.randrange(10_000)}" for _ in range(size)]
            if base % 2:
                words[:0] = passage
            texts += [edited(rng, words, s) for s in (0, 0, 0.004, 0.01, 0.03, 0.08)]
    texts += ["", None, " ", "A b", "a B", "a b c", "solo"] + [" ".join(passage + [f"t{i}"]) for i in range(25)]
    return texts


@pytest.mark.parametrize("entry,surplus,remembered", [(1, 15, 1 << 20), (0, 15, 3), (0, 0, 1 << 20), (1 << 40, 5, 1 << 20)])
@pytest.mark.parametrize("spec", [Spec(3, 90, 100), Spec(5, 80, 100)])
def test_classes_against_brute_force(spark, docs_of, near, spec, entry, surplus, remembered, monkeypatch):
    """With the weights dealt by cost, all by neighbourhoods (entry 0), and by segments alone (a huge entry)."""
    for name, value in (("ENTRY_COST", entry), ("SURPLUS", surplus), ("REMEMBERED", remembered), ("LOCAL", 3), ("GROUP", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    want, sizes = plain_classes(dict(enumerate(near)), spec.k, spec.num, spec.den)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard_join.join_classes(docs_of(near), spec).collect()}
    assert got == {i: (want[i], sizes[i]) for i in want}


def family(rng, n, members, edits):
    """Near copies of one text: so many words replaced in each that only few of them link."""
    base = [f"f{rng.randrange(10_000)}" for _ in range(n)]
    return [" ".join(w if rng.random() > edits * (i % 4) / n else f"e{rng.randrange(1000)}" for w in base) for i in range(members)]


@pytest.mark.parametrize("entry", [0, 1])
def test_families_of_near_copies(spark, docs_of, entry, monkeypatch):
    """Families whose members lie about the threshold: buckets of many classes, in which weights are dealt."""
    monkeypatch.setattr(jaccard_join, "ENTRY_COST", entry)
    rng = random.Random(21)
    texts = [t for n, e in ((9, 1), (14, 1), (30, 1), (80, 2), (200, 4), (1100, 12)) for t in family(rng, n, 40, e)]
    rng.shuffle(texts)
    for spec in (Spec(3, 90, 100), Spec(5, 80, 100)):
        want, _ = plain_classes(dict(enumerate(texts)), spec.k, spec.num, spec.den)
        assert len(set(want.values())) > 20
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_classes(docs_of(texts), spec).collect()}
        assert got == want


def test_units_without_a_cost_are_only_counted(spark, docs_of, monkeypatch):
    """Of the units of weight only those that cost something are listed, sorted and dealt."""
    monkeypatch.setattr(jaccard_join, "ENTRY_COST", 0)
    listed, keep = [], Scratch.__call__

    def noted(self, df):
        stored = keep(self, df)
        if stored.columns == ["i", "low", "u"]:
            listed.append(stored.select(F.explode("u").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.min("u.cost").alias("least")).first())
        return stored

    monkeypatch.setattr(Scratch, "__call__", noted)
    jaccard_join.join_classes(docs_of(family(random.Random(21), 80, 40, 2)), Spec(3, 90, 100)).count()
    assert listed and any(x["n"] for x in listed) and all(x["least"] > 0 for x in listed if x["n"])


def test_one_document_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (9, a), (9, None), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.join_classes(docs, Spec(3, 90, 100)).collect()}
    assert got == {(1, 58): 1, (2, 59): 1, (3, 59): 1, (9, 58): 1, (9, 0): 1, (4, 1): 4}
    rows = [(5, a), (5, b), (2, a + " x"), (7, b + " y"), (7, "own text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {tuple(r) for r in jaccard_join.keep_one(docs, Spec(3, 90, 100)).collect()}
    assert kept == {(2, a + " x"), (5, b), (7, "own text")}


def test_words_decide(spark, docs_of, monkeypatch):
    """Shingles that only share a hash don't link: the words are compared."""
    assert not jaccard_join.similar([b"a"], [b"b"], Spec(3, 90, 100)) and not jaccard_join.similar([], [], Spec(3, 90, 100))
    pairs = [(0, "a b c d e f", "a b c d e f"), (1, "a b c", "x y z"), (2, "a b", "a b c"), (3, " ".join("abcdefghijklmnop"), " ".join("abcdefghijklmnopq"))]
    for _, x, y in pairs:
        p, q = plain_set(x, 3), plain_set(y, 3)
        assert jaccard_join.similar(jaccard_join.plain_words(x), jaccard_join.plain_words(y), Spec(3, 90, 100)) == (100 * len(p & q) >= 90 * len(p | q))


def test_tables_go(spark, monkeypatch, tmp_path):
    """Of a run's tables only the result stays in the shared folder."""
    from pcgspark.llm import common

    names = iter("abc")
    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}/{next(names)}")
    with common.Scratch(spark) as keep:
        df = keep(spark.range(5).toDF("a"))
        out = keep.result(df.filter("a > 2"))
        assert sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"]
    assert [x.name for x in tmp_path.iterdir()] == ["b"] and out.count() == 2


def test_without_broadcasts(spark, docs_of, near, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    want, _ = plain_classes(dict(enumerate(near)), 3, 90, 100)
    got = jaccard_join.join_classes(docs_of(near), Spec(3, 90, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_join_odd_rows(spark, odd, empty):
    got = jaccard_join.join_classes(odd, Spec(3, 90, 100)).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and by[9]["component_id"] == 8 and by[0]["n_shingles"] == 0 and by[None]["component_id"] is None
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] is None) == [0, 1]
    assert jaccard_join.join_classes(empty, Spec(3, 90, 100)).count() == 0
    kept = jaccard_join.keep_one(odd, Spec(5, 80, 100))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (99, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 99: 50, 100: 50}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_settled_components_take_one_round(spark):
    stored = []
    stars = spark.createDataFrame([(i, i % 7) for i in range(7, 70)], "a bigint, b bigint")
    got = components.components(stars, lambda df: stored.append(1) or materialise(df)).collect()
    assert {r["node"]: r["component"] for r in got} == {i: i % 7 for i in range(70)}
    assert len(stored) == 4  # the edges, two tables of least neighbours, the round's result



def test_passages_are_removed_once(spark, docs_of):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randrange(100_000)}" for _ in range(12))
    passage = [line() for _ in range(8)]
    texts, places = [], []
    for i in range(40):
        own = [line() for _ in range(rng.randrange(2, 9))]
        if i % 2:
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage
        places.append(i % 2)
        texts.append("\n".join(own))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(texts)).collect()}
    assert got[1] == texts[1]
    left = [sum(x in got[i].split("\n") for x in passage) for i in range(3, 40, 2)]
    assert sum(left) <= 0.15 * 8 * len(left)
    assert all(got[i] == texts[i] for i in range(0, 40, 2))
    assert {x for t in texts for x in t.split("\n")} == {x for t in got.values() for x in t.split("\n")}
    assert all([x for x in texts[i].split("\n") if x in set(got[i].split("\n"))] == got[i].split("\n") for i in got)


def passages_removed(texts):
    """Brute force: all lines in runs of two lines or more and MIN_CHARS characters that occur earlier."""
    seen, out = set(), {}
    for i, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for s in range(len(lines)):
            for e in range(s + 2, len(lines) + 1):
                run = tuple(lines[s:e])
                if sum(map(len, run)) >= line_dedup.MIN_CHARS:
                    if run in seen:
                        gone.update(range(s, e))
                    seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("n_lines,n_words", [(2, 27), (3, 18), (4, 14), (18, 3), (30, 2), (55, 1)])
def test_every_passage_is_removed(spark, docs_of, n_lines, n_words):
    """Passages of few lines, and of many short ones, between foreign lines."""
    rng = random.Random(n_lines)
    line = lambda k: " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(k))
    texts, kept = [], []
    for _ in range(12):
        passage = [line(n_words) for _ in range(n_lines)]
        for again in range(2):
            own = [line(10) for _ in range(5)]
            texts.append("\n".join(own[:2] + passage + own[2:]))
            kept.append("\n".join(own) if again else texts[-1])
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(texts)).collect()}
    assert got == dict(enumerate(kept))


@pytest.mark.parametrize("near,look", [(64, 256), (4, 200)])
def test_passages_against_brute_force(spark, docs_of, near, look, monkeypatch):
    monkeypatch.setattr(line_dedup, "NEAR", near)
    monkeypatch.setattr(line_dedup, "LOOK", look)
    rng = random.Random(5)
    pool = ["", "", "a", "bb", "}"] + ["".join(rng.choices("xyz ", k=k)) for k in (3, 9, 20, 31, 45, 59, 60, 61, 90)]
    runs = [[rng.choice(pool) for _ in range(rng.randrange(2, 15))] for _ in range(8)] + [["", "q"] * 40, ["r"] + [""] * 90 + ["s" * 59]]
    texts = []
    for _ in range(40):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines += rng.choice(runs) + [rng.choice([*pool, f"own{rng.random()}"]) for _ in range(rng.randrange(3))]
        texts.append("\n".join(lines))
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(texts)).collect()}
    assert got == passages_removed(texts)


def test_a_first_occurrence_stays(spark, docs_of):
    """Lines that repeat the lines before them, in a run that overlaps its own first occurrence, and a known passage after them."""
    known = "the first line of a passage that all texts know\nand the second line of that same known passage"
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of([f"intro\n{known}\nend", "\n".join(["x"] * 1000 + [known])])).collect()}
    assert got[1] == "\n".join(["x"] * line_dedup.MIN_CHARS)


def test_many_lines_take_linear_time(spark, docs_of):
    """Twice the lines take about twice the time; a quadratic step shows as four times."""
    import time

    def seconds(n):
        docs = docs_of(["\n".join(f"{i:040d}" for i in range(n))])
        began = time.time()
        assert line_dedup.chunk_rows(docs).count() >= n - 1
        return time.time() - began

    seconds(1000)
    small, large = (min(seconds(n) for _ in range(2)) for n in (20_000, 80_000))
    assert large < 9 * small + 1


def test_bytes_decide(spark, docs_of):
    """Chunks that only share a hash stay: bytes of the first occurrence are compared."""
    texts = ["a" * 70 + "\n" + "b" * 70, "c" * 70 + "\n" + "d" * 70]
    docs = docs_of(texts)
    rows = line_dedup.chunk_rows(docs).withColumn("h", line_dedup.F.lit(1))
    original = line_dedup.chunk_rows
    try:
        line_dedup.chunk_rows = lambda _: rows
        assert sorted(r["text"] for r in line_dedup.dedup_lines(docs).collect()) == sorted(texts)
    finally:
        line_dedup.chunk_rows = original


def test_lines_odd_rows(spark, odd, empty):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == odd.count() and got.columns == [*odd.columns, "line_dedup"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[0]["text"] is None and by[1]["text"] == "" and by[10]["text"] == "\n\n\n" and by[None] is not None
    assert line_dedup.dedup_lines(empty).count() == 0
    passage = "\n".join(["the same line of a text"] * 2 + ["and yet another long line of it"])
    rows = [(1, passage, "mine", 1), (1, "other text\n" + passage, "yours", 2), (2, passage, None, 3), (2, passage, None, 3), (None, passage, "x", 4)]
    clash = spark.createDataFrame(rows, "doc_id bigint, text string, line_dedup string, Line_Dedup_ int")
    out = line_dedup.dedup_lines(clash)
    assert out.columns == [*clash.columns, "line_dedup__"]
    got = sorted((tuple(r)[:4] for r in out.collect()), key=lambda r: (r[3], r[1]))
    # of the texts of one doc_id that with the least hash counts as the first
    assert [r[2:] for r in got] == [r[2:] for r in sorted(rows, key=lambda r: r[3])] and [r[1] for r in got if r[0] == 2] == ["", ""] and got[-1][1] == passage
    assert sorted(r[1] for r in got if r[0] == 1) in (sorted([passage, "other text"]), sorted(["", "other text\n" + passage]))


def test_shared_runs_in_groups(spark, docs_of, monkeypatch):
    """One passage in very many documents is dealt in salted groups."""
    monkeypatch.setattr(line_dedup, "GROUP", 3)
    passage = "\n".join(f"line {i} of the passage that all documents share" for i in range(4))
    texts = [f"own {i}\n{passage}\nend {i}" for i in range(50)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs_of(texts)).collect()}
    assert got == {i: texts[i] if i == 0 else f"own {i}\nend {i}" for i in range(50)}


def signature_set(s):
    return {s[i : i + 8] for i in range(0, len(s), 8)}


def test_fingerprints(spark):
    docs = table(spark, SF, "documents")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: x[0])
    got = {r["doc_id"]: r for r in spotsigs.fingerprints(docs).collect()}
    for k, (i, text) in enumerate(rows):
        m = len(text) // 4
        want = text[: len(text) - m] + rows[(k + 1) % len(rows)][1][:m]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        a, b, c = signature_set(r["fingerprint"]), signature_set(r["edited_fingerprint"]), signature_set(got[rows[(k + 1) % len(rows)][0]]["fingerprint"])
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b), abs=1e-6) and r["near_next"] == pytest.approx(len(a & c) / len(a | c), abs=1e-6)


def test_chains(spark, docs_of):
    text = "the Cat of the mat is on a very fine day"
    chains = sorted({("the", "cat", "mat"), ("of", "mat", "very"), ("the", "mat", "very"), ("is", "very", "fine"), ("on", "very", "fine"), ("a", "very", "fine")})
    want = spark.createDataFrame(chains, "a string, b string, c string").select(F.xxhash64("a", "b", "c").alias("h")).collect()
    got = docs_of([text]).select(spotsigs.signatures(F.col("text")).alias("s")).first()["s"]
    assert got == sorted(r["h"] for r in want)


def plain_chains(text):
    """Chains from their definition: an anchor and the next two words that are none."""
    out, words = set(), text.lower().split()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS]
        if w in spotsigs.ANCHORS and len(after) >= 2:
            out.add((w, after[0], after[1]))
    return out


def test_chains_against_their_definition(spark, docs_of):
    rng = random.Random(2)
    texts = [" ".join(rng.choice([*spotsigs.ANCHORS[:9], *[f"w{i}" for i in range(25)]]) for _ in range(rng.randrange(60, 200))) for _ in range(30)]
    texts += ["the " * 40 + "end of story " * 3, "one the of and two a three " * 9]
    rows = [(i, *c) for i, t in enumerate(texts) for c in plain_chains(t)]
    want: dict = {}
    for r in spark.createDataFrame(rows, "i int, a string, b string, c string").select("i", F.xxhash64("a", "b", "c").alias("h")).collect():
        want.setdefault(r["i"], []).append(r["h"])
    got = {r["doc_id"]: r["s"] for r in docs_of(texts).select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert all(set(got[i]) >= set(want[i]) for i in want) and all(got[i] == sorted(want[i]) for i in want if len(want[i]) >= 10)


def test_chains_with_breaks_and_control_characters(spark, docs_of):
    """A break of line beside a content word is an anchor without a letter; a control character is part of its word."""
    filler = " the one two of three four is five six on seven eight"
    wanted = {
        "the cat\u0001x sat on the mat" + filler: [("the", "cat\u0001x", "sat"), ("on", "mat", "one"), ("the", "mat", "one")],
        "cat\n sat of the\nmat" + filler: [("", "sat", "mat"), ("of", "mat", "one"), ("the", "mat", "one"), ("", "mat", "one")],
        "cat of\t\nthe  mat of of dog" + filler: [("of", "mat", "dog"), ("the", "mat", "dog"), ("of", "dog", "one")],
    }
    rest = [("the", "one", "two"), ("of", "three", "four"), ("is", "five", "six"), ("on", "seven", "eight")]
    rows = [(i, *c) for i, chains in enumerate(wanted.values()) for c in chains + rest]
    want: dict = {}
    for r in spark.createDataFrame(rows, "i int, a string, b string, c string").select("i", F.xxhash64("a", "b", "c").alias("h")).collect():
        want.setdefault(r["i"], []).append(r["h"])
    got = {r["doc_id"]: r["s"] for r in docs_of(list(wanted)).select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    assert got == {i: sorted(h) for i, h in want.items()}


def test_similar_pairs_store_no_index(spark, docs_of, monkeypatch):
    """What is stored is a row for each set and each pair, not one for each signature of an index."""
    stored = []
    monkeypatch.setattr(spotsigs, "materialise", lambda df, keep=spotsigs.materialise: stored.append(keep(df)) or stored[-1])
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(["the", *base[:i], "other", *base[i:]]) for i in (0, 50, 100)]
    assert spotsigs.similar_pairs(docs_of(texts)).count() == 3
    assert sum(x.count() for x in stored) <= 6


def test_signatures_of_every_kind_of_text(spark, docs_of):
    """An edited quarter leaves half of the signatures, with punctuation, in any language and without spaces."""
    rng = random.Random(11)
    word = lambda letters, k=6: "".join(rng.choices(letters, k=k))
    latin, russian, han = "bcdfghijklmnoprstuvz", "абвгдежзиклмнопрст", "".join(map(chr, range(0x4E00, 0x5000)))
    kinds = [
        lambda: " ".join(rng.choice(["the,", '"of', "AND!!", "(to)", "is&&&"]) + " " + word(latin) for _ in range(200)),
        lambda: " ".join(word(latin) for _ in range(300)),
        lambda: " ".join(word(russian) for _ in range(300)),
        lambda: word(han, 1500),
        lambda: "。".join(word(han, 40) for _ in range(40)),
        lambda: word(latin + "0123456789", 4000),
        lambda: " ".join([word(latin) for _ in range(150)] + ["the", word(latin)] + [word(latin) for _ in range(150)]),
    ]
    texts = []
    for kind in kinds:
        a, b = kind(), kind()
        n = len(a)
        texts += [a, a[: n - n // 4] + b[: n // 4], b[: n // 8] + a[n // 8 :], a[: n // 2] + b[:7] + a[n // 2 :]]
    texts += [" ".join(["again", "and", "again"] * 50), "one two six", "!? ... !", "one two"]
    s = {r["doc_id"]: set(r["s"]) for r in docs_of(texts).select("doc_id", spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect()}
    like = lambda i, j: len(s[i] & s[j]) / len(s[i] | s[j])
    for k in range(0, 4 * len(kinds), 4):
        assert len(s[k]) >= 20 and like(k, k + 1) > 0.45 and like(k, k + 2) > 0.6 and like(k, k + 3) > 0.9
        assert all(like(k, j) < 0.1 for j in range(4 * len(kinds)) if j // 4 != k // 4)
    assert all(s[i] for i in range(len(texts)))


def test_anchors_with_punctuation(spark, docs_of):
    texts = ["the cat of the mat is on a very fine day", '"The, cat. of THE!! (mat) is& on -- a very fine day...']
    a, b = (r["s"] for r in docs_of(texts).select(spotsigs.signatures(spotsigs.F.col("text")).alias("s")).collect())
    assert a == b and len(a) == 6


def test_fingerprint_odd_rows(spark, odd, empty, docs_of, monkeypatch):
    assert spotsigs.fingerprints(empty).count() == 0
    got = spotsigs.fingerprints(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = spotsigs.fingerprints(docs_of(["just the one text of all"])).first()
    assert one["near_next"] == 1.0
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 2)
    again = spotsigs.fingerprints(odd).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    long_run = spotsigs.fingerprints(docs_of(["the " * 50_000, "of " * 3])).collect()
    assert len(long_run) == 2


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_similar_pairs_against_brute_force(spark, docs_of, threshold):
    rng = random.Random(17)
    near = [" ".join(w if rng.random() > share else f"e{rng.randrange(99)}" for w in base.split()) for base in (" ".join(rng.choice(["the", "of", "is", *[f"w{i}" for i in range(60)]]) for _ in range(n)) for n in (30, 90, 300, 900)) for share in (0, 0.004, 0.01, 0.02, 0.05, 0.1)]
    docs = table(spark, SF, "documents").select("doc_id", "text").union(docs_of(near).select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text"))
    sets = {}
    for r in docs.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect():
        key = tuple(r["s"])
        sets[key] = min(sets.get(key, r["doc_id"]), r["doc_id"])
    want = set()
    rows = [(set(k), i) for k, i in sets.items()]
    for a, i in rows:
        for b, j in rows:
            if i < j and len(a & b) >= threshold * len(a | b):
                want.add((i, j))
    assert len(want) > 10 and {(r["a"], r["b"]) for r in spotsigs.similar_pairs(docs, threshold).collect()} == want


@pytest.mark.parametrize("clean,junk", [(0.9, 0.45), (1.0, 0.65), (0.9, 1.0)])
def test_mixing_draws_no_clean_document(spark, docs_of, monkeypatch, clean, junk):
    import corpus_pipeline as cp

    n = 400
    rows = [(i, 10, "junk" if i % 4 == 0 else "clean", junk if i % 4 == 0 else clean, (i * 7 % n) / n) for i in range(n)]
    rated = spark.createDataFrame(rows, "doc_id bigint, tokens bigint, domain string, rate double, u double").withColumn("t", F.xxhash64(F.lit("x")))
    monkeypatch.setattr(cp.mixing, "mix", lambda *a, **k: (rated, None))
    kept = {r["doc_id"] for r in cp.mix_sources(spark, docs_of(["x"] * n), SF).collect()}
    assert sum(i % 4 > 0 for i in kept) == 300
    assert abs(sum(i % 4 == 0 for i in kept) - 100 * junk) <= 1
    after = {r["domain"]: r["after"] for r in cp.shares(cp.draw(rated)).collect()}
    assert after["clean"] == pytest.approx(300 / len(kept))


def test_mixing_stage_meets_its_weights(spark):
    """On the stage's own output: expected and drawn tokens of each domain by posteriors, and no clean document gone."""
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    labels = cp.mixing.domains_of(table(spark, sf, "labels"))
    rated, model = cp.mixing.mix(docs, labels, cp.WEIGHTS, most=1.0, whole=cp.KEPT)
    rows = cp.draw(rated).toPandas()
    assert rows["rate"].between(0, 1).all() and model.residual < 1e-3
    p, tokens = np.array(rows["p"].tolist()), rows["tokens"].to_numpy()[:, None]
    weights = np.array([cp.WEIGHTS[d] for d in model.domains])
    fitted = (p * tokens * rows["rate"].to_numpy()[:, None]).sum(0)
    assert np.allclose(fitted / fitted.sum(), weights, atol=2e-3)
    kept = {(r["doc_id"]) for r in cp.mix_sources(spark, docs, sf).select("doc_id").collect()}
    assert kept == set(rows[rows["stays"]]["doc_id"]) and rows[rows["domain"] == cp.KEPT]["stays"].all()
    drawn = (p * tokens)[rows["stays"].to_numpy()].sum(0)
    assert np.allclose(drawn / drawn.sum(), weights, atol=0.02)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    start = docs
    for name, stage in cp.STAGES:
        before = docs
        docs = cp.materialise(stage(spark, docs, SF))
        if name != "byte_bpe":
            assert docs.columns == before.columns and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert 0 < docs.count() < start.count() and docs.count() == before.count()
    assert cp.run(spark, SF).count() == docs.count()


def test_every_stage_against_plain_rules(spark):
    """Each stage on what the one before kept, against Python without Spark; the mixture's rates are taken as fitted."""
    import corpus_pipeline as cp
    import public_tokenizers
    import tiktoken

    keep = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    sf = "/root/testdata/sf0.01"
    stages = dict(cp.STAGES)

    def fails(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {x for x, n in Counter(g).items() if n > 1}
        repeated = len({i + j for i, x in enumerate(g) if x in seen for j in range(3)})
        chars, symbols = sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>")
        upper, lower = sum("A" <= c <= "Z" for c in text or ""), sum("a" <= c <= "z" for c in text or "")
        again = len(lines) - len(set(lines))
        return len(w) < 50 or 2 * repeated > len(w) or 100 * symbols > 4 * chars or 100 * again > 40 * len(lines) or 100 * upper > 60 * (upper + lower) or not 2 * len(w) <= chars <= 15 * len(w) or (text or "").count("!") > len(w)

    one = cp.materialise(stages["quality_rules"](spark, docs, sf))
    assert keep(one) == {i: t for i, t in keep(docs).items() if not fails(t)}
    two = cp.materialise(stages["line_dedup"](spark, one, sf))
    before = sorted(keep(one).items())
    lines = {before[i][0]: t for i, t in passages_removed([t for _, t in before]).items()}
    assert keep(two) == {i: t for i, t in lines.items() if t == dict(before)[i] or t.strip(" \t\n\r\x0b\x0c")}
    three = cp.materialise(stages["near_duplicates"](spark, two, sf))
    sets, holders = {i: plain_set(t, 5) for i, t in keep(two).items()}, {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            least[max(x, y)] = min(x, y)
    assert keep(three) == {i: t for i, t in keep(two).items() if root(i) == i}
    four = cp.materialise(stages["mixing"](spark, three, sf))
    rated, _ = cp.mixing.mix(three, cp.mixing.domains_of(table(spark, sf, "labels")), cp.WEIGHTS, most=1.0, whole=cp.KEPT)
    stays = {r["doc_id"] for r in rated.collect() if r["domain"] == cp.KEPT or r["u"] < r["rate"]}
    assert set(keep(four)) == stays
    data = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (len(ids := plain.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in keep(four).items()}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["byte_bpe"](spark, four, sf).collect()} == want


def test_pipeline_stages_with_odd_rows(spark, odd, empty):
    import corpus_pipeline as cp

    for rows in (odd, empty):
        docs = rows
        for name, stage in cp.STAGES:
            docs = cp.materialise(stage(spark, docs, SF))
            assert name == "byte_bpe" or docs.columns == rows.columns


def test_every_registered_sql(spark):
    import duckdb

    from pcgspark.llm import queries

    for name, sql in queries.oracle_sql().items():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
        want, got = con.execute(sql).df(), queries.queries()[name](spark, SF).toPandas()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert got[columns].sort_values(columns).values.tolist() == want[columns].sort_values(columns).values.tolist()
