"""Odd rows through every operator, and brute-force comparisons on small texts."""

import random
import re
from collections import Counter
from math import log

import pytest

from foldmeter.llm.bytes import byte_dedup
from foldmeter.llm.crossentropy import cross_entropy_difference
from foldmeter.llm.decontaminate import contamination, decontaminate
from foldmeter.llm.jaccard import ngram_jaccard
from foldmeter.llm.mix import mix_sources, route, source_targets
from foldmeter.llm.neighbours import neighbour_quality
from foldmeter.llm.repeats import substring_dedup
from foldmeter.llm.rules import line_frequency_rules
from foldmeter.llm.urls import url_filter
from foldmeter.llm.warc import pages_through_archives

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(6000))
TEXTS = [None, "", " \n\t", "one", "one", "Two words", "x " * 120, LONG, LONG, "é ü " + LONG, "a\nb\na\nb", "zero\x00byte " * 30]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, runs string, target string"


def rows(texts):
    return [(i, t, "en", ["a", "b", None][i % 3], 0, 7, 8, "r", "t") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    data = [*rows(TEXTS), (3, "one", "en", "a", 0, 7, 8, "r", "t"), (None, LONG, None, None, None, 7, 8, "r", "t")]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(3, 1), (6, 0), (7, 1), (None, 1)], "id long, label int")


def items(spark):
    return spark.createDataFrame([(1, "ONE"), (2, None), (3, LONG[:200])], "item_id long, text string")


def operators(spark):
    return {
        "ngram_jaccard": ngram_jaccard,
        "substring_dedup": substring_dedup,
        "byte_dedup": byte_dedup,
        "rules": line_frequency_rules,
        "mix": mix_sources,
        "decontaminate": lambda d: decontaminate(d, items(spark)),
        "neighbours": lambda d: neighbour_quality(d, labels(spark)),
        "crossentropy": lambda d: cross_entropy_difference(d, labels(spark).filter("label = 1")),
    }


NAMES = ["ngram_jaccard", "substring_dedup", "byte_dedup", "rules", "mix", "decontaminate", "neighbours", "crossentropy"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    assert operators(spark)[name](odd).count() == odd.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, name):
    assert operators(spark)[name](empty).count() == 0


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def near_copies():
    rng = random.Random(5)
    base = [f"t{rng.randrange(4000)}" for _ in range(300)]
    out = []
    for _ in range(120):
        words = base[: rng.randrange(2, 300)] if rng.random() < 0.5 else list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_brute_force(spark, k, num):
    texts = near_copies()
    got = {r.doc_id: r for r in ngram_jaccard(spark.createDataFrame(rows(texts), SCHEMA), k=k, num=num, block_tokens=2000).collect()}
    sets = []
    for t in texts:
        w = words_of(t.lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)})
    top, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    assert [(got[i].n_shingles, got[i].component_id, got[i].n_links) for i in range(len(texts))] == [
        (len(sets[i]), top[i], links[i]) for i in range(len(texts))
    ]


def test_repeats_brute_force(spark):
    texts = [*near_copies()[:40], "x " * 120, "x " * 80, "p q " * 60, "p q " * 70]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: words_of(r.text) for r in substring_dedup(docs).collect()}
    kept_bytes = {r.doc_id: bytes(r.kept) for r in byte_dedup(docs).collect()}
    for units, window, result in ((words_of, 50, got), (str.encode, 50, kept_bytes)):
        first = {}
        for d, text in enumerate(texts):
            u = units(text)
            gone = [False] * len(u)
            for i in range(len(u) - window + 1):
                key = tuple(u[i : i + window])
                if first.setdefault(key, d) < d:
                    gone[i : i + window] = [True] * window
            kept = [x for x, g in zip(u, gone) if not g]
            assert result[d] == (bytes(kept) if isinstance(u, bytes) else kept), d


def test_decontaminate(spark):
    passage = "The quick brown fox jumps over the lazy dog while the cat sleeps"
    docs = spark.createDataFrame(rows([f"Before, {passage.upper()}! after", "clean text here"]), SCHEMA)
    item = spark.createDataFrame([(9, passage), (10, "absent words only")], "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, item).collect()}
    assert got == {0: (15, 13, ["9"]), 1: (3, 0, [])}
    assert {r.doc_id: r.text for r in decontaminate(docs, item).collect()} == {0: "Before, after", 1: "clean text here"}


def test_targets_and_flow():
    got = source_targets({"a": 10, "b": 1000, None: 1000}, (5, 2, 1), 1.5, 2)
    assert got["a"] == 20 and abs(sum(got.values()) - 1.5 * 2010) < 1e-6 and max(got["b"], got[None]) <= 2000
    flow = route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}, 2)
    assert sum(map(sum, flow.values())) == 30 and all(x[1] == 0 for x in flow.values())


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.ORG", "https://x.org/en/1?q", "http://b.com/de/5#z", "http://c.net/a/b/c/d/e/f"]
    pages = spark.createDataFrame([(i, u, [None, 0, 1][i % 3]) for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, label int")
    got = url_filter(pages, [("allow", "org", "/"), ("block", "com", "/de/"), ("block", "x.org", "/en/1")]).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and by[0].host == "" and by[3].host == "a.example.org" and by[3].rule is None
    assert (by[4].rule, by[4].verdict) == ("x.org/en/1", "block") and by[5].verdict == "block" and by[6].template.endswith("<rest>")
    assert url_filter(pages.limit(0), [("allow", "org", "/")]).count() == 0


def test_warc_round_trip(spark):
    html = [None, "", "<p>é</p>", "<p>é</p>", "x" * 3_000_000, "\r\n\r\nWARC/1.1"]
    pages = spark.createDataFrame([*((i, f"http://h/{i}\n", h) for i, h in enumerate(html)), (None, None, "q")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages_through_archives(pages).collect()}
    assert len(got) == 7 and (got[1].record_type, got[1].refers_to) == ("revisit", 0) and got[3].refers_to == 2
    assert all(got[i].payload == (h or "") for i, h in enumerate(html) if got[i].record_type == "response")
    assert got[3].payload_bytes == 9 and got[3].payload_digest == got[2].payload_digest
    assert pages_through_archives(pages.limit(0)).count() == 0


@pytest.mark.parametrize("least_share", [1e-6, 0.01, 1.0])
def test_crossentropy_brute_force(spark, least_share):
    rng = random.Random(3)
    texts = [" ".join(f"w{min(rng.randrange(1, 90), rng.randrange(1, 90))}" for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    texts += ["only here twice", texts[0], "", None, "W1 once"]
    marked = {*range(0, 40, 4), 40}
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    target = spark.createDataFrame([(i,) for i in marked], "id long")
    got = {r.doc_id: (r.n_tokens, r.score) for r in cross_entropy_difference(docs, target, least_share=least_share).collect()}
    n, t = Counter(), Counter()
    cut = [words_of((x or "").lower()) for x in texts]
    for d, w in enumerate(cut):
        for model in (n, t) if d in marked else (n,):
            model.update(w)
            model.update(zip(w, w[1:]))
    size = sum(isinstance(k, str) for k in n)

    def p(model, before, word):
        alone = (model[word] + 1) / (sum(c for k, c in model.items() if isinstance(k, str)) + size)
        return alone if before is None else 0.7 * model[before, word] / max(model[before], 1) + 0.3 * alone

    for d, w in enumerate(cut):
        gains = [log(p(n, a, b) / p(t, a, b)) for a, b in zip([None, *w], w)]
        assert got[d] == (len(w), pytest.approx(sum(gains) / len(w), abs=1e-9) if w else None), d


def test_crossentropy_is_not_cut_finer_than_its_input(spark, monkeypatch):
    """Buckets pack a row for each other bucket and block: their number follows the tokens, not the partitions."""
    from foldmeter.llm import crossentropy

    made = {}
    half, gains = crossentropy._half_counted, crossentropy._bucket_gains
    monkeypatch.setattr(crossentropy, "_half_counted", lambda buckets: half(made.setdefault("buckets", buckets)))
    monkeypatch.setattr(crossentropy, "_bucket_gains", lambda *a: gains(*a[:-1], made.setdefault("blocks", a[-1])))
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(60)]
    docs, target = spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame([(i,) for i in range(0, 60, 3)], "id long")
    scores = lambda: {r.doc_id: (r.n_tokens, pytest.approx(r.score, abs=1e-9)) for r in cross_entropy_difference(docs, target, least_share=0.01).collect()}
    few = scores()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    made.clear()
    try:
        assert scores() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made == {"buckets": 1, "blocks": 1}
    monkeypatch.setattr(crossentropy, "LEAST_TOKENS", 1000)
    monkeypatch.setattr(crossentropy, "LEAST_ROWS", 20)
    made.clear()
    assert scores() == few and made == {"buckets": 4, "blocks": 3}


def verdicts(spark, urls):
    pages = spark.createDataFrame([(i, u, label) for i, (u, label) in enumerate(urls)], "page_id long, url string, label int")
    return {r.url: r.verdict for r in url_filter(pages, [("allow", "none.org", "/")]).collect()}


def test_small_bad_branch_of_a_hot_host(spark):
    urls = [(f"http://hot.com/s{i % 80}/{i}", int(i % 49 > 0)) for i in range(4000)]
    bad = [(f"http://hot.com/bad/{i}", 0) for i in range(60)]
    got = verdicts(spark, urls + bad)
    assert all(got[u] == "block" for u, _ in bad) and all(got[u] == "allow" for u, _ in urls)


def test_bad_branch_below_the_fourth_segment(spark):
    urls = [(f"http://deep.com/a/b/c/d/e/good/{i}", 1) for i in range(300)]
    bad = [(f"http://deep.com/a/b/c/d/e/bad/{i}", 0) for i in range(60)]
    got = verdicts(spark, urls + bad)
    assert all(got[u] == "block" for u, _ in bad) and all(got[u] == "allow" for u, _ in urls)


def test_clashing_names(spark):
    """Names that operators use inside are ordinary column names: they come back unchanged."""
    names = ["part", "whole", "_id", "_mark", "_runs", "_words", "_host", "_segments", "_segment", "_named", "_bin", "_members", "text", "host__", "i", "a.b"]
    shown = [n for n in names if n not in ("text",)]
    texts = ["one two three " * 30, "one two three " * 30, None, "", "x y"]
    base = [(i, t, "s", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(base, ["doc_id", "body", "source", *names])
    results = [
        mix_sources(docs, text_column="body"),
        substring_dedup(docs, text_column="body"),
        decontaminate(docs, items(spark), text_column="body"),
        line_frequency_rules(docs, text_column="body"),
    ]
    for got in results:
        back = {r.doc_id: r for r in got.collect()}
        assert len(back) == 5 and all(back[i][n] == f"{n}{i}" for i in back for n in ["text", *shown])
    pages = spark.createDataFrame([(f"http://h.com/a/{i}", 1, *[f"{n}{i}" for n in names]) for i in range(4)], ["url", "label", *names])
    got = {r.url: r for r in url_filter(pages, [("allow", "org", "/")]).collect()}
    assert len(got) == 4 and all(got[f"http://h.com/a/{i}"][n] == f"{n}{i}" for i in range(4) for n in shown)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Planted copies, passages, benchmark windows and short texts, and what every stage leaves of them."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    clean = [fresh(200) for _ in range(12)]
    passage, item = fresh(70), fresh(14)
    near = clean[0].split()
    near[100] = "changed"
    texts = [*clean, clean[3], " ".join(near), f"{fresh(60)} {passage}", f"{fresh(60)} {passage}", f"{fresh(60)} {item} {fresh(60)}", "too short", None, ""]
    rows_ = [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path / "sf")
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left, now = [], spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, work) in enumerate(pipeline.STAGES):
        work(spark, now, sf).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        left.append({r.doc_id: r for r in now.collect()})
        assert now.columns[:5] == docs.columns
    assert set(left[0]) == set(range(17)) and all(left[0][i].text == texts[i] for i in left[0])
    assert set(left[1]) == set(range(17)) - {12, 13}
    assert left[2][15].text.split() == texts[15].split()[:60] and left[2][14].text == texts[14]
    assert item not in left[3][16].text and len(left[3][16].text.split()) == 120
    assert all(left[3][i].text == texts[i] and left[3][i].n_chars == len(texts[i]) for i in range(12))
    words = {i: len(words_of(r.text)) for i, r in left[3].items()}
    taken = {i: r.taken for i, r in left[4].items()}
    assert all(0 < taken[i] <= 2 * words[i] for i in taken) and set(taken) <= set(words)
    for s in "ab":
        mine = [i for i in words if "ab"[i % 2] == s]
        target = next(r.target for i, r in left[4].items() if r.source == s)
        assert abs(sum(taken.get(i, 0) for i in mine) - target) <= 1
    again = {(r.doc_id, r.text, r.taken) for r in pipeline.run(spark, sf).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in left[4].values()}
