"""Language, toxicity, mixing and URL filters: held-out quality and defined results for odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pcgspark.llm import langid, mixing, toxicity, url_filter
from pcgspark.llm.common import table
from pcgspark.llm.queries import CURATED

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right, bad = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum((~F.col("score").between(0, 1)).cast("int"))).first()
    assert n > 200 and right / n > 0.97 and bad == 0


def test_language_odd_rows(spark, odd, empty, docs_of):
    assert {r["lang_pred"] for r in langid.identify(empty).collect()} == set()
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2, 10)} == {"und"}
    nothing = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(nothing).collect()} == {("und", 0.0)}


def plain_model(texts):
    """Interpolated Kneser-Ney from its definition: a function of a context (three characters) and the next character."""
    import re
    import unicodedata

    def clean(text):
        letter = lambda c: c.isalpha() or unicodedata.category(c)[0] == "M"
        text = "".join(c if letter(c) else " " for c in text.lower())
        return re.split(" +", text.strip()) if text.strip() else []

    top = {}
    for text in texts:
        for word in clean(text):
            padded = "\0\0\0" + word + "\0"
            for i in range(3, len(padded)):
                top[padded[i - 3 : i + 1]] = top.get(padded[i - 3 : i + 1], 0) + 1
    levels = {4: top}
    for size in (3, 2, 1):
        levels[size] = {}
        for g in levels[size + 1]:
            levels[size][g[1:]] = levels[size].get(g[1:], 0) + 1

    def p(context, c):
        value = 1 / (len(levels[1]) + 1)
        for size in range(1, 5):
            level, h = levels[size], context[len(context) - size + 1 :] if size > 1 else ""
            ones, twos = (sum(v == x for v in level.values()) for x in (1, 2))
            d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            followers = {g: v for g, v in level.items() if g[:-1] == h}
            if followers:
                total = sum(followers.values())
                value = max(level.get(h + c, 0) - d, 0) / total + d * len(followers) / total * value
        return value

    return p


def test_language_models_against_plain_kneser_ney(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 1000)
    texts = {"en": ["The theme of them", "this thing that; other", "a an and"], "de": ["Übergröße und mehr", "der die das", "dass dies dort"], "hi": ["नमस्ते दुनिया", "यह एक पाठ है"]}
    model = langid.fit(docs_of([t for x in texts.values() for t in x], [lang for lang, x in texts.items() for _ in x]))
    assert model.langs == sorted(texts)
    for k, lang in enumerate(model.langs):
        plain = plain_model(texts[lang])
        for context in ("\0\0\0", "\0\0t", "\0th", "the", "der", "नम"[:2].rjust(3, "\0"), "xyz"):
            for c in "thea\0zß":
                row = np.array([[0 if x == "\0" else ord(x) for x in context + c]], np.uint32)
                assert np.exp(model.log_probabilities(row))[0, k] == pytest.approx(plain(context, c), rel=1e-9)


def test_probabilities_sum_to_one(spark, docs_of, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 1000)
    model = langid.fit(docs_of(["the theme of them", "this thing that", "other"]))
    kinds, _ = langid.grams(["the theme of them", "this thing that", "other"])
    letters = sorted({int(c) for k in kinds for c in k} - {0}) + [0]
    rows = np.array([(0, ord("t"), ord("h"), c) for c in [*letters, ord("z")]], np.uint32)
    assert np.exp(model.log_probabilities(rows)).sum() == pytest.approx(1, abs=1e-9)


def test_marks_belong_to_words(spark, docs_of):
    g, spans = langid.grams(["नमस्ते", "\u0301\u0301", "e\u0301t", None, "12"])
    assert np.diff(spans).tolist() == [7, 0, 4, 0, 0] and 0 not in g[:6, -1]


def test_the_sample_is_bounded(spark, docs_of):
    docs = docs_of(["x" * 100] * 50 + ["y" * 5000] + ["z" * 10] * 3, ["a"] * 50 + ["b"] + ["c"] * 3)
    n = {r["lang"]: (r["count"], r["chars"]) for r in langid.sample_of(docs, 20, 1000).groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("chars")).collect()}
    assert n == {"a": (10, 1000), "b": (1, 5000), "c": (3, 30)}


def test_rejection_of_unknown_script(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit(docs)
    strange = spark.createDataFrame([(0, "ζεφυρος " * 30), (1, docs.filter("lang = 'en' and n_chars > 500").first()["text"])], "doc_id bigint, text string")
    assert [r["language"]["rejected"] for r in langid.predict(strange, model).orderBy("doc_id").collect()] == [True, False]


def test_toxicity_of_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank, y = got["score"].rank(), got["toxic"] == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.8 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()


def test_toxicity_odd_rows(spark, odd, empty, no_labels):
    assert {r["score"] for r in toxicity.classify(odd, no_labels).collect()} == {0.0}
    assert toxicity.classify(empty, table(spark, SF, "labels")).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (7, None, 1), (7, 0, 0), (None, 1, 1), (8, 1, None), (11, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)


def test_scores_against_plain_windows(spark):
    """Every window compressed by itself, the features and the curve by their definitions."""
    import zstandard

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.fit(docs, labels)
    d = model.dictionaries
    size = lambda content, w: len(zstandard.ZstdCompressor(level=d.level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False).compress(w))
    some = docs.filter("doc_id % 97 = 3 and length(text) < 2500").select("doc_id", "text")
    got = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.predict(some, model).collect()}
    rows = some.collect()
    assert len(rows) >= 5
    for r in rows:
        words = (r["text"] or "").lower().split()
        parts = [" " + " ".join(words[i : i + toxicity.WINDOW]) + " " for i in range(0, len(words), toxicity.WINDOW)] or [""]
        saved = [size(d.ordinary, p.encode()) - size(d.toxic, p.encode()) for p in parts]
        x = [math.log1p(sum(v >= t for v in saved)) for t in toxicity.THRESHOLDS] + [min(max(saved), 12) / 4, math.log(len(saved)), math.log1p(sum(v <= -4 for v in saved))]
        z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=False)) + model.weights[-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_windows():
    assert toxicity.windows(None) == [b""] and toxicity.windows("A b", 1) == [b" a ", b" b "]


def test_mixture_meets_its_targets(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rated, model = mixing.mix(docs, mixing.domains_of(labels), mixing.WEIGHTS)
    rows = rated.toPandas()
    p, t, r = np.array(rows["p"].tolist()), rows["tokens"].to_numpy(), rows["rate"].to_numpy()
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and len(rows) == docs.count()
    want = np.array([mixing.WEIGHTS[d] for d in model.domains])
    assert np.allclose((p * (t * r)[:, None]).sum(0) / t.sum(), want, atol=1e-4)


def test_rates_stay_nonnegative_where_targets_conflict(spark):
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.6, 0.4]), (0, [0.5, 0.5])], "tokens bigint, p array<double>")
    steps, _ = mixing.fit_rates(rows, [20.0, 0.0])
    rate = np.array([r[0] for r in rows.select(mixing._rate(steps)).collect()])
    assert (rate >= 0).all()
    a = np.array([[9, 6], [1, 4]])
    best = min(((a @ np.array([x, y]) - [20, 0]) ** 2).sum() for x in np.linspace(0, 3, 121) for y in np.linspace(0, 3, 121))
    start = ((a @ np.ones(2) - [20, 0]) ** 2).sum()
    got = ((a @ rate[:2] - [20, 0]) ** 2).sum()
    assert got <= start and got < best * 1.6 + 1


@pytest.mark.parametrize("most", [None, 1.0])
@pytest.mark.parametrize("seed", range(4))
def test_rates_against_plain_projected_gradient(spark, seed, most):
    """A long plain projected gradient over one rate for each document reaches no lower residual."""
    rng = np.random.default_rng(seed)
    n, k = 60, 3
    p, tokens = rng.dirichlet(np.full(k, 0.4), n), rng.integers(1, 300, n)
    targets = rng.dirichlet(np.full(k, 0.7)) * tokens.sum() * (0.5 if most else 1.2)
    rows = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens bigint, p array<double>")
    steps, residual = mixing.fit_rates(rows, targets.tolist(), most=most)
    rate = np.array([r[0] for r in rows.select(mixing._rate(steps, most=most)).collect()])
    a = (p * tokens[:, None]).T
    plain, size = np.ones(n), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(40_000):
        plain = np.clip(plain - size * a.T @ (a @ plain - targets), 0, most or np.inf)
    miss = lambda r: np.abs(a @ r - targets).max() / targets.sum()
    assert (rate >= 0).all() and (most is None or (rate <= most).all()) and miss(rate) == pytest.approx(residual, abs=1e-9)
    square = lambda r: ((a @ r - targets) ** 2).sum() / targets.sum() ** 2
    assert square(rate) <= 1.1 * square(plain) + 2e-5  # where targets can't be met, within a tenth of the least squares


def test_mixing_odd_rows(spark, odd, empty, no_labels):
    got = mixing.mixture(odd, no_labels).collect()
    assert len(got) == odd.count() and {r["domain"] for r in got} == {"all"} and all(r["rate"] >= 0 for r in got)
    assert mixing.mixture(empty, no_labels).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, None), (None, 1, 1), (8, None, None), (11, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert mixing.mixture(odd, labels).count() == odd.count()


PAGES = "page_id bigint, url string, html string"


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    tail = rest[k:]
    k = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return host, tail[:k]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in CURATED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0])) if fits else None


def test_urls(spark, no_labels):
    urls = [None, "", "no scheme/es/", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "x://org/", "x://org", "ftp://my.com/de/", "a://b.com/fr/#://c.com/de/", "h://evil.com?u=/de/", "h://x.com:80/de/", "http://ünï.org/\nes/"]
    rows = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, *urls])], PAGES)
    for r in url_filter.judge(rows, no_labels, CURATED).collect():
        url = urls[r["page_id"] % len(urls)]
        host, path = plain_url(url)
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *(rule or (None, "allow"))), url
    assert url_filter.judge(spark.createDataFrame([], PAGES), no_labels, CURATED).count() == 0


def test_curated_rules_are_those_of_the_contract(spark, no_labels):
    want = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    assert {h + p: v for h, p, v in CURATED} == want and len(CURATED) == len(want)
    rows = spark.createDataFrame([(i, f"https://www.{rule}2", None) for i, rule in enumerate(want)], PAGES)
    assert {r["rule"]: r["verdict"] for r in url_filter.judge(rows, no_labels, CURATED).collect()} == want


def test_mined_rules(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        word = "casino" if bad else "news"
        rows.append((i, f"http://h{i % 7}.example.net/{word}/{'win' if i % 8 == 0 else 'page'}/{i}", "x"))
        labels.append((i, 0 if bad else 1, 0))
    rows.append((1000, "http://other.net/casino/9", "x"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), []).collect()}
    assert got[1000] == "block" and all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))
    known = spark.createDataFrame([(["a", "b"], i % 2 == 0) for i in range(40)] + [(["c", "a"], True)] * 20, "tokens array<string>, bad boolean")
    rules = {tuple(r["items"]) for r in url_filter.mine(known).collect()}
    assert rules == {("c",)}


@pytest.mark.parametrize("seed", range(3))
def test_rules_against_plain_search(spark, seed):
    """All minimal combinations by trying every one; tokens that always go together are one."""
    from itertools import combinations

    rng = np.random.default_rng(seed)
    words = [f"t{i}" for i in range(7)]
    rows = []
    for _ in range(400):
        has = [w for w in words if rng.random() < 0.45] + ["x", "y"] * int(rng.random() < 0.3)
        sure = {"t0", "t1"} <= set(has) or {"t2", "t3", "x"} <= set(has) or "t6" in has and seed == 1
        rows.append((has, bool(rng.random() < (0.95 if sure else 0.1))))
    base, least = sum(b for _, b in rows) / 400, max(url_filter.MIN_SUPPORT * 400, url_filter.MIN_ROWS)
    often = sum(sum(b for has, b in rows if w in has) >= least for w in [*words, "x", "y"])
    want = {}
    for size in range(1, 9):
        for c in combinations([*words, "x"], size):
            of = [b for has, b in rows if set(c) <= set(has)]
            n, k = len(of), sum(of)
            if k < least or any(set(w) <= set(c) for w in want):
                continue
            p = k / n
            odds = n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0))
            if p >= base + url_filter.MIN_GAIN * (1 - base) and odds >= size * math.log(often) - math.log(url_filter.ALPHA):
                want[c] = (k / 400, p)
    got = {tuple(r["items"]): (r["support"], r["confidence"]) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert set(got) == set(want) and len(want) >= 2 and all(got[c] == pytest.approx(want[c]) for c in want)


def test_labels_that_say_nothing_give_no_rules(spark):
    rng = np.random.default_rng(5)
    rows = [([f"w{i}" for i in rng.integers(0, 60, 6)], bool(rng.random() < 0.26)) for _ in range(1000)]
    assert url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).count() == 0


def test_very_long_urls(spark, no_labels):
    url = "http://a.example.org/es/" + "/".join(f"w{i}" for i in range(20_000)) + "?" + "&".join(f"k{i}=1" for i in range(2000))
    rows = spark.createDataFrame([(1, url, None), (1, url, None), (None, None, None)], PAGES)
    got = url_filter.judge(rows, spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int"), CURATED).collect()
    assert sorted((r["rule"] or "", r["verdict"]) for r in got) == [("", "allow"), ("example.org/es/", "block"), ("example.org/es/", "block")]


def test_a_language_of_one_row_is_learned(spark, docs_of):
    texts = ["the quick brown fox jumps over the lazy dog"] * 20 + [f"wort{i} und satz{i} mit grund" for i in range(20)]
    for lone in range(100, 130):  # any id, so also those that calibration would withhold
        rows = docs_of(texts, ["en"] * 20 + ["de"] * 20).union(spark.createDataFrame([(lone, "zażółć gęślą jaźń", "pl", "s", 17)], docs_of([]).schema))
        if rows.filter(f"doc_id = {lone}").select(langid._share(2) < langid.CALIBRATION_SHARE).first()[0]:
            assert "pl" in langid.fit(rows).langs
            return
    raise AssertionError("no id would be withheld")
