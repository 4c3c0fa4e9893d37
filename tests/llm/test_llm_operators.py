"""Each operator against a plain version of it, on small made inputs."""

import collections
import hashlib
import itertools
import math
import random
import tracemalloc
import re
import zlib

import numpy as np
import public_tokenizers
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rolesift.llm import bpe, jaccard_join, language_id, quality, toxicity, url_filter
from rolesift.llm.arrays import WHITE, chain_digests, slices, text_bytes, word_bounds, word_digests
from rolesift.llm.components import components
from rolesift.llm.decontamination import decontaminate
from rolesift.llm.exact_dedup import ENTRY, exact_duplicates, merge_runs, merge_tree, send, sorted_run
from rolesift.llm.jaccard_join import near_duplicates
from rolesift.llm.line_dedup import drop_boilerplate
from rolesift.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from rolesift.llm.sharding import Shard, even_tree, place, place_grown, shard_documents
from rolesift.llm.sample import labelled_sample
from rolesift.llm.url_filter import DigestArray, UrlRule, judge_urls, pack_rules

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SPACE = re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, parts=3):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


# arrays and packing


def test_words_and_digests_of_a_slice():
    texts = ["ab  cd", "", None, "\u00e9t\u00e9 ab\n", "Cd", "x" * 5000]
    body, starts = text_bytes(pa.array(texts).slice(0))
    begins, ends = word_bounds(~WHITE[body], starts[:-1])
    words = [bytes(body[b:e]).decode() for b, e in zip(begins, ends)]
    assert words == ["ab", "cd", "\u00e9t\u00e9", "ab", "Cd", "x" * 5000]
    digests = word_digests(body, begins, ends)
    assert digests[0] == digests[3] and digests[1] == digests[4]
    assert len(set(digests.tolist())) == 4
    assert len(chain_digests(digests, 5)) == 2
    sliced, moved = text_bytes(pa.array(texts).slice(3, 2))
    assert bytes(sliced).decode() == "\u00e9t\u00e9 ab\nCd" and moved.tolist() == [0, 9, 11]


def test_slices_bound_bytes_and_keep_every_row():
    batch = pa.record_batch([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d"])], names=["id", "text"])
    pieces = list(slices([batch], most=12))
    assert [i for p in pieces for i in p.column("id").to_pylist()] == list(range(6))
    assert [p.num_rows for p in pieces] == [3, 3]  # a piece ends with the row that fills it


@pytest.mark.parametrize("values", [[], [0], [5, 5, 7], [1, 300, 70_000, 2**40, 2**63]])
def test_packing_returns_what_went_in(values):
    values = np.array(values, dtype=np.uint64)
    assert unpack(pack(values)).tolist() == values.tolist()
    assert unpack_sorted(pack_sorted(values)).tolist() == values.tolist()


# language ID


def plain_grams(text):
    """Runs of 1 to MAX_N bytes of lower-cased words, a space at both ends of each."""
    words = re.split(rb"[^a-z\x80-\xff]+", text.lower().encode())
    for word in filter(None, words):
        padded = b" " + word + b" "
        for n in range(1, language_id.MAX_N + 1):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != b" ":
                    yield gram


def test_grams_are_those_of_padded_words():
    texts = ["Ab c", "", "\u00c9t\u00e9!", "12 34", "a-b  cde"]
    found = list(language_id.gram_codes(pa.array(texts)))
    assert len(found) == len(texts)
    for text, codes in zip(texts, found):
        expected = sorted(int.from_bytes(g, "big") for g in plain_grams(text))
        # words share the space between them, so runs of one word and its spaces are the same
        assert sorted(codes.tolist()) == expected
    assert list(language_id.gram_codes(pa.array([], pa.string()))) == []


def test_grams_of_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choices(["ab", "c ", "é", "  ", "1 ", " x"], k=2_000))
    whole = language_id.runs(next(language_id.gram_codes(pa.array([text]))))
    for most in (1, 7, 100, 10_000):
        assert "".join(language_id.pieces(text, most)) == text
        monkeypatch.setattr(language_id.pieces, "__defaults__", (most,))
        codes, counts = language_id.gram_counts(text)
        assert codes.tolist() == whole[0].tolist() and counts.tolist() == whole[1].tolist()


def test_gram_codes_hold_little_beside_the_text():
    text = " ".join(f"word{i}" for i in range(200_000))
    tracemalloc.start()
    list(language_id.gram_codes(pa.array([text])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


def test_samples_are_bounded_in_classes_and_bytes(spark):
    rows = [(i, "x" * (i % 7 + 1), f"l{i % 5}" if i < 50 else "l9") for i in range(70)] + [(99, "y" * 1_000, "l9")]
    docs = spark.createDataFrame(rows, "id long, text string, label string")
    sample = labelled_sample(docs, docs, "id", "text", "label", 6, max_classes=3).to_pylist()
    assert sorted((r["label"], r["n"]) for r in sample) == [("l0", 10)] * 6 + [("l1", 10)] * 6 + [("l9", 21)] * 6
    small = labelled_sample(docs, docs, "id", "text", "label", 6, max_classes=2, max_bytes=80).to_pylist()
    sizes = {label: sum(len(r["text"]) for r in small if r["label"] == label) for label in ("l0", "l9")}
    assert 30 <= sizes["l0"] <= 40 or len([r for r in small if r["label"] == "l0"]) == 6
    assert 0 < sizes["l9"] <= 40 and all(len(r["text"]) < 8 for r in small)


def test_judge_is_the_out_of_place_distance():
    rng = random.Random(3)
    texts = {"aa": " ".join(rng.choices(["foo", "bar", "baz"], k=50)), "bb": " ".join(rng.choices(["ooo", "zab", "qux"], k=50))}
    sample = pa.table({"text": list(texts.values()), "label": list(texts), "n": [1, 1]})
    model = language_id.learn_profiles(sample, length=20)

    def top(text):
        counts = {}
        for g in plain_grams(text):
            counts[int.from_bytes(g, "big")] = counts.get(int.from_bytes(g, "big"), 0) + 1
        return sorted(counts, key=lambda c: (-counts[c], c))[:20]

    for text in ("foo qux baz", "zab", "nothing here", "ooo ooo bar"):
        own = top(text)
        sums = {}
        for lang, known in texts.items():
            ranks = {c: i for i, c in enumerate(top(known))}
            sums[lang] = sum(abs(ranks[c] - i) if c in ranks else 20 for i, c in enumerate(own))
        best = min(sorted(sums), key=sums.get)
        lang, score = model.judge(*language_id.runs(next(language_id.gram_codes(pa.array([text])))))
        assert lang == best and math.isclose(score, 1 - sums[best] / (20 * len(own)))


# URL filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


RULES = [
    UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("a.example.net", "/e", "block"),
    UrlRule("org", "", "block"), UrlRule("x.org", "/", "allow"),
]


def plain_rule(host, path):
    fits = [r for r in RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.key), len(r.host)), default=None)


def test_urls_against_all_rules(spark):
    urls = [
        "http://A.example.NET/en/1?x#y", "https://example.net/en/", "http://example.net/de/", "http://notexample.net/en/",
        "http://net", "http://net/", "ftp://x.org?q=/", "http://y.x.org/", "http://org", "x.org/", "", None, "://", "http:///en/",
        "http://a.example.net/e", "http://example.com/a://net/", "http://\u00e9.org/\u00fc", "http://b.net/" + "p" * 50_000,
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, RULES).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        host, path = plain_url(url)
        rule = plain_rule(host, path)
        expected = (host, path, rule and rule.key, rule.verdict if rule else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == expected, url


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "_digest", lambda key: 7)
    (tmp_path / "rules").write_bytes(pack_rules(RULES))
    array = DigestArray(str(tmp_path / "rules"))
    keys = [("net/", 3), ("org", 3), ("x.org/", 5), ("none/", 4), ("net/", 4)]
    found = array.probe(keys)
    assert [array.key(int(f)) if f >= 0 else None for f in found] == ["net/", "org", "x.org/", None, None]


def test_no_rules_and_too_many(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert [r.verdict for r in judge_urls(pages, [], otherwise="block").collect()] == ["block"]
    monkeypatch.setattr(url_filter, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        judge_urls(pages, RULES)


# toxicity


def plain_marginals(emissions, pairs):
    """All tag sequences, after a plain word."""
    n = len(emissions)
    total, toxic = 0.0, [0.0] * n
    for tags in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(e for e, t in zip(emissions, tags) if t) + sum(pairs[a][b] for a, b in zip((0, *tags), tags)))
        total += weight
        for i, t in enumerate(tags):
            toxic[i] += weight * t
    return [t / total for t in toxic]


def test_marginals_are_sums_over_all_tag_sequences():
    rng = np.random.default_rng(0)
    lengths = [0, 1, 5, 9, 3, 0, 10]
    bounds = np.cumsum([0, *lengths])
    emissions, pairs = rng.normal(0, 2, bounds[-1]), rng.normal(0, 1, (2, 2))
    expected = [p for a, b in zip(bounds[:-1], bounds[1:]) for p in plain_marginals(emissions[a:b], pairs)]
    for size in (2, 3, 64):
        assert np.allclose(toxicity.marginals(emissions, bounds, pairs, size), expected)


def test_field_finds_spans_and_leaves_clean_texts_alone(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(5, 60), 300).split()
        toxic = i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Grobian", "schuft\u00e9", "grobianus"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(found) == 900
    for r in found:
        text = rows[r.doc_id][1]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) == labels[r.doc_id][1], (text, r.score)
        spans = [text[s.start : s.end] for s in r.spans]
        bad = [w for w in text.split() if not w.startswith("w")]
        assert spans == bad


def test_toxicity_ranks_held_out_rows_of_few_labels(spark):
    """No word stands in enough of a dozen toxic documents to be beyond chance, yet scores must rank."""
    rng = random.Random(7)
    bad = [f"{k}schuft" for k in range(14)]
    rows, labels = [], []
    for i in range(100):
        words = prose(rng, rng.randrange(40, 200), 400).split()
        toxic = i % 6 == 0
        for word in rng.sample(bad, 4) if toxic else []:
            words.insert(rng.randrange(len(words) + 1), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(100, ""), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    score = {r.doc_id: r.score for r in found}
    held = [r.doc_id for r in found if r.held_out and r.doc_id < 100]
    pairs = [(score[x], score[y]) for x in held if x % 6 == 0 for y in held if y % 6]
    assert pairs and sum((x > y) + (x == y) / 2 for x, y in pairs) >= 0.9 * len(pairs)
    assert score[100] == score[101] < min(score[i] for i in range(0, 100, 6))


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score_toxicity(docs, none).collect()] in ([0, 0], [1, 1])


def test_join_makes_a_pair_under_its_first_common_shingle_only(spark):
    rng = random.Random(3)
    held = {node: sorted(rng.sample(range(200), 70)) for node in range(40)}
    rows = [(t, n, 70, i, (0, 0, 0, 0, 0), n, True) for n, own in held.items() for i, t in enumerate(own)]
    bits = "struct<unshared:long,m0:long,m1:long,m2:long,m3:long>"
    index = spark.createDataFrame(rows, f"token long, node long, n long, at long, bits {bits}, comp long, minor boolean")
    carried = jaccard_join._with_earlier(index)
    assert carried.count() == len(rows)
    assert carried.agg(F.max(F.size("earlier"))).first()[0] == jaccard_join.EARLIER
    x, y = carried.alias("x"), carried.alias("y")
    met = x.join(y, [F.col("x.token") == F.col("y.token"), F.col("x.node") < F.col("y.node"), ~F.arrays_overlap("x.earlier", "y.earlier")])
    found = collections.Counter((r.a, r.b) for r in met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).collect())
    pairs = {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    assert set(found) == pairs and max(found.values()) == 1
    assert {(r.a, r.b) for r in jaccard_join._joined(carried, ["token"], 1).collect()} == {
        (r.a, r.b) for r in jaccard_join._joined(index, ["token"], 1).collect()
    }


# decontamination


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_contamination(text, items, size=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item_id, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        k = min(size, len(own))
        for a in range(len(own) - k + 1 if k else 0):
            for at in range(len(words) - k + 1):
                if words[at : at + k] == own[a : a + k]:
                    hit.update(range(at, at + k))
                    if item_id is not None:
                        named.add(str(item_id))
    ids = ",".join(sorted(named))
    return len(words), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_contamination_against_all_windows(spark):
    rng = random.Random(2)
    passage = prose(rng, 30, 40).upper()
    items = [(1, passage), (2, "alpha Beta"), (3, ""), (None, "w1 w2 w3"), (10, passage[40:]), (4, None), (5, "!!"), (2, "alpha Beta"), (6, "\u00c9T\u00c9 \u00e9t\u00e9")]
    texts = [
        passage.lower(), "x " + passage + " y", passage.replace(" ", "...", 7), passage.rsplit(" ", 21)[0], "ALPHA, beta; alpha", "beta alpha",
        "", None, "w1 w2 w3 w2 w3", "\u00e9t\u00e9 \u00e9t\u00e9", "\u00c9t\u00c9 \u00e9T\u00e9", "\u00c9T\u00c9 \u00e9t\u00e9", *[prose(rng, 80, 40) for _ in range(10)],
        (prose(rng, 20_000, 40) + " " + passage) * 2,
    ]
    docs = frame(spark, texts)
    found = decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = plain_contamination(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected, r.doc_id


def test_contamination_in_several_blocks(spark, monkeypatch):
    from rolesift.llm import decontamination

    monkeypatch.setattr(decontamination, "BLOCK_ROWS", 7)
    rng = random.Random(4)
    items = [(i, prose(rng, 14, 60)) for i in range(5)]
    texts = [items[i % 5][1] + " " + prose(rng, 5, 60) for i in range(6)] + [prose(rng, 30, 60)]
    found = decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    for r in found.collect():
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_contamination(texts[r.doc_id], items)


# Jaccard join


def plain_components(texts, size=5, percent=75):
    sets = []
    for text in texts:
        words = [w for w in SPACE.split((text or "").translate(LOWER)) if w]
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def near_texts(seed):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    bases = [prose(rng, n) for n in (5, 6, 9, 30, 80, 200)]
    texts = [edited(rng, rng.choice(bases), rng.randrange(4)) for _ in range(70)]
    texts += [passage + " " + prose(rng, rng.randrange(10, 90)) for _ in range(40)]
    texts += [t.upper().replace(" ", "\n\t", 3) for t in texts[:10]] + ["", None, " \n", "one", "One", "one two"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, rare_pairs, per_doc", [(1, 20_000, 20), (2, 3, 0), (3, 0, 10**9)])
def test_components_against_all_pairs(spark, monkeypatch, seed, rare_pairs, per_doc):
    """Also where almost every shingle counts as frequent, and with many or hardly any star rounds."""
    texts = near_texts(seed)
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_DOC", per_doc)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 1500)
    real = jaccard_join.find_links
    monkeypatch.setattr(jaccard_join, "find_links", lambda nodes, percent: real(nodes, percent, rare_pairs))
    n, roots = plain_components(texts)
    found = near_duplicates(frame(spark, texts)).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (n[i], roots[i]) for i in range(len(texts))}
    assert {r.doc_id for r in found if r.kept} == set(roots)


def test_join_alone_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0)
    for rare_pairs in (10**9, 2, 0):
        texts = near_texts(8)
        real = jaccard_join.find_links
        with monkeypatch.context() as m:
            m.setattr(jaccard_join, "find_links", lambda nodes, percent: real(nodes, percent, rare_pairs))
            found = near_duplicates(frame(spark, texts)).collect()
        assert {r.doc_id: r.component_id for r in found} == dict(enumerate(plain_components(texts)[1]))


@pytest.mark.parametrize("large_set", [0, 12, 10**6])
def test_large_sets_are_joined_by_single_shingles(spark, monkeypatch, large_set):
    """Whatever counts as large, and with all shingles frequent, the components are the same."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(60):
        words = base[: rng.randrange(6, 40)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
        texts.append(" ".join(words))
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0)
    real = jaccard_join.find_links
    monkeypatch.setattr(jaccard_join, "find_links", lambda nodes, percent: real(nodes, percent, 0, large_set=large_set))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, roots = plain_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (n, r) for i, (n, r) in enumerate(zip(sizes, roots))}


@pytest.mark.parametrize("percent, rare_pairs", [(50, 10**9), (50, 0), (30, 0)])
def test_links_by_one_common_shingle(spark, monkeypatch, percent, rare_pairs):
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 0)
    real = jaccard_join.find_links
    monkeypatch.setattr(jaccard_join, "find_links", lambda nodes, percent: real(nodes, percent, rare_pairs))
    rng = random.Random(percent)
    texts = ["a", "a b", "c d", "c e f", "g", "g h i"] + [prose(rng, rng.randrange(1, 6), 200) for _ in range(60)]
    found = near_duplicates(frame(spark, texts), shingle_words=1, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(plain_components(texts, 1, percent)[1]))


def test_a_hot_shingle_is_one_entry_per_chunk_in_its_range(spark):
    rng = random.Random(4)
    passage = prose(rng, 30)
    texts = [f"{passage} {prose(rng, 8)}" for _ in range(300)]
    slim = frame(spark, texts, parts=2).withColumnRenamed("doc_id", "id")
    sent = slim.mapInArrow(jaccard_join._send_shingles(5, 16), jaccard_join._MESSAGE).collect()
    digests = [(r.chunk, d) for r in sent if r.key >= 0 for d in unpack_sorted(bytes(r.a)).tolist()]
    assert len(digests) == len(set(digests)) and len({c for c, _ in digests}) == 2
    pdf = pd.DataFrame([r for r in sent if r.key >= 0], columns=sent[0].__fields__)
    totals = [unpack(c).tolist() for _, g in pdf.groupby("key") for c in jaccard_join._count(g)["c"]]
    assert sum(n == 300 for ns in totals for n in ns) == 2 * 26  # each chunk is told the total


def test_all_links_of_a_family_are_offered(spark):
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(1, 3)) for _ in range(25)] + [prose(rng, 30) for _ in range(10)] + ["", None]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for t in texts)]
    expected = {
        (a, b) for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    }
    found = [tuple(sorted(r)) for r in jaccard_join.similar_pairs(frame(spark, texts)).collect()]
    assert len(expected) > 100 and sorted(found) == sorted(expected)
    with pytest.raises(ValueError):
        jaccard_join.similar_pairs(frame(spark, texts), percent=0)


def test_percent_is_checked(spark):
    for percent in (0, 101):
        with pytest.raises(ValueError):
            near_duplicates(frame(spark, ["a"]), percent=percent)


def test_components_of_paths_stars_and_circles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(203, 201), (201, 202), (202, 203), (203, 203)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, **{200 + i: 201 for i in (1, 2, 3)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# line dedup


@pytest.mark.parametrize("ratio, least", [(0.05, 3), (0.3, 2), (0.0, 1)])
def test_lines_against_a_plain_count(spark, ratio, least):
    rng = random.Random(9)
    common = [" menu ", "menu", "imprint\t", "a  b", "", "  ", "\u00a0"]
    rows = []
    for i in range(200):
        host = rng.choice(["hot", "hot", "h1", "h2", "", None, f"own{i}"])
        lines = [rng.choice(common) if rng.random() < 0.4 else prose(rng, 2, 40) for _ in range(rng.randrange(9))]
        rows.append((i, host, "\n".join(lines) if rng.random() < 0.95 else None))
    rows.append((200, "hot", "menu\n" * 30_000))
    bare = lambda line: line.strip(" \t\n\x0b\x0c\r")
    pages, seen = {}, {}
    for _, host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in {bare(x) for x in (text or "").split("\n")} - {""}:
            seen[host, line] = seen.get((host, line), 0) + 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    found = drop_boilerplate(spark.createDataFrame(rows, "doc_id long, site string, text string"), "site", max_ratio=ratio, min_pages=least)
    got = {r.doc_id: (r.site, r.text, r.n_lines, r.n_dropped) for r in found.collect()}
    assert len(got) == len(rows)
    for i, host, text in rows:
        lines = text.split("\n") if text is not None else []
        stay = [x for x in lines if (host, bare(x)) not in bad]
        expected = (host, None if text is None else "\n".join(stay), sum(bare(x) != "" for x in lines), len(lines) - len(stay))
        assert got[i] == expected


def test_a_bound_in_pages_does_not_loosen_as_a_host_grows(spark):
    for pages in (40, 400):
        rows = [(i, "h", f"own {i}\nseldom" if i < 12 else f"own {i}") for i in range(pages)]
        docs = spark.createDataFrame(rows, "doc_id long, site string, text string")
        cut = {m: drop_boilerplate(docs, "site", max_pages=m).agg({"n_dropped": "sum"}).first()[0] for m in (None, 10, 12)}
        assert cut == {None: 12 if pages == 40 else 0, 10: 12, 12: 12 if pages == 40 else 0}


# exact dedup


def plain_exact(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = {}
    for text, ids in groups.items():
        for i in ids:
            out[i] = (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("fan_in, run_rows", [(8, 25_000), (2, 7), (4, 20)])
def test_tree_keeps_the_smallest_id(spark, fan_in, run_rows):
    rng = random.Random(fan_in)
    texts = [rng.choice(["hot text", "hot  text", "hot\n\ttext"]) if i % 3 == 0 else prose(rng, rng.randrange(0, 4), 9) for i in range(300)]
    texts += ["", None, " ", "\n", "a" * 200_000, "\u00a0x", "x"]
    found = exact_duplicates(frame(spark, texts), fan_in=fan_in, run_rows=run_rows).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == plain_exact(texts)


def test_the_largest_id_is_no_null(spark):
    top = 2**63 - 1
    rows = [(top, "a"), (None, "a"), (None, "b"), (None, "b"), (top, "c"), (-(2**63), "c")]
    found = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found), key=str)
    assert got == sorted(
        [(top, top, 2, True), (None, top, 2, False), (None, None, 2, True), (None, None, 2, False),
         (top, -(2**63), 2, False), (-(2**63), -(2**63), 2, True)], key=str,
    )


def test_merged_runs_are_the_sorted_union():
    rng = np.random.default_rng(5)
    for _ in range(40):
        runs = []
        for _ in range(rng.integers(1, 9)):
            run = np.zeros(rng.integers(0, 30), dtype=ENTRY)
            run["digest"] = rng.integers(0, 12, len(run))  # few digests: several texts under one
            run["sha"] = [bytes([b]) * 32 for b in rng.integers(0, 3, len(run))]
            run["no_id"] = rng.integers(0, 2, len(run))
            run["keep"] = np.where(run["no_id"], 0, rng.integers(-9, 9, len(run)))
            run["row"], run["rows"] = rng.integers(0, 1000, len(run)), 1
            runs.append(run)
        got = merge_runs([sorted_run(r) for r in runs])
        assert got.tolist() == sorted_run(np.concatenate(runs)).tolist()
        assert got["rows"].sum() == sum(map(len, runs))


def test_digests_alone_do_not_make_texts_equal(spark):
    rows = [(i, i, 5, bytes([i % 3]) * 32, 4 + i % 2) for i in range(12)]  # one digest, six texts
    slim = spark.createDataFrame(rows, "id long, row long, digest long, sha binary, n_bytes long")
    got = sorted((r.keep_id, r.group_size) for r in merge_tree(slim, 12, fan_in=2, run_rows=3).collect())
    assert got == [(i, 2) for i in range(6)]
    with pytest.raises(ValueError):
        merge_tree(slim, 12, fan_in=3)


def test_slices_of_a_run_cover_it():
    for level, owner, least in ((0, 5, 0), (1, 13, 1 << 62)):  # the run of owner 13 is in quarter 1
        run = np.zeros(50, dtype=ENTRY)
        most = 2**64 - 1 if level == 0 else (2 << 62) - 1
        run["digest"] = np.sort(np.random.default_rng(0).integers(least, most, 50, dtype=np.uint64))
        parts = send(owner, run, 4, level)
        got = np.concatenate([np.frombuffer(p, dtype=ENTRY) for _, p in parts])
        assert got["digest"].tolist() == run["digest"].tolist()
        for to, part in parts:
            digit = to // 4**level % 4
            assert to == owner + (digit - owner // 4**level % 4) * 4**level
            digests = np.frombuffer(part, dtype=ENTRY)["digest"]
            assert all((int(d) >> (62 - 2 * level)) % 4 == digit for d in digests)


# quality


def test_means_are_means_of_all_features():
    texts = ["ab ab cd", "", "x", "\u00e9 \u00e9 \u00e9", None, "AB ab"]
    table = np.random.default_rng(0).normal(size=quality.BUCKETS)
    found = quality.features(pa.array(texts))
    got = quality.means(found, table)
    for i in range(len(texts)):
        own = np.concatenate([k.buckets[k.begins[i] : k.ends[i]] for k in found])
        size = len((texts[i] or "").encode())
        words = len((texts[i] or "").split())
        expected = words + max(0, words - 1) + max(0, size - 2) + max(0, size - 3)
        assert len(own) - expected == (1 if i == 3 else 0)  # a repeat one apart is one more
        assert math.isclose(got[i], table[own].mean() if len(own) else 0.0, abs_tol=1e-9)
        alone = quality.means(quality.features(pa.array([texts[i]])), table)
        assert math.isclose(alone[0], got[i], abs_tol=1e-9)


def test_quality_separates_held_out_documents(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        rows.append((i, prose(rng, rng.randrange(3, 80)) if good else " ".join([f"w{rng.randrange(4000)}"] * rng.randrange(8, 40))))
        labels.append((i, int(good)))
    found = quality.score_quality(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][1] for r in held) >= 0.97 * len(held)


# BPE


def test_pieces_encode_like_the_whole_text():
    tokenizer = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    rng = random.Random(0)
    alphabet = ["ab", "\u00e9", " ", "  ", "\n", "\t\n", "12", "!?", "'s", "\u00a0", "\u3000", "\U0001f600", "\x1c", "'", "don't "]
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        whole = tokenizer.encode_ordinary(text)
        for most in (1, 2, 5, 13):
            assert "".join(bpe.safe_pieces(text, most)) == text
            assert bpe.encode(tokenizer, text, most).tolist() == whole
        assert bpe.decode(tokenizer, np.array(whole, "<u4")) == text.encode()


@pytest.mark.parametrize("pattern", [bpe.GPT2, bpe.CL100K, bpe.O200K, r"\S+\s*|\s+", r"[^\n]+|\n"])
def test_long_texts_encode_like_the_whole_with_other_patterns(pattern):
    tokenizer = bpe.encoding(bpe.read_ranks(RANKS), pattern)
    rng = random.Random(1)
    alphabet = ["ab", "Cd", "\u00e9", " ", " ", "  ", "\n", "\r\n", "\t", "12", "!!!", "?/", "'S", "\u00a0", "\u3000", "\x1c", "\u0301"]
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60))) + "!!!\n a"
        whole = tokenizer.encode_ordinary(text)
        for most in (1, 2, 5, 13):
            assert bpe.encode(tokenizer, text, most).tolist() == whole
    assert len(bpe.safe_pieces("ab cd\n" * 100, 7)) > 50


def test_round_trip_is_the_library(spark):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  world\n", "\u00e9\u00e8 <|endoftext|>", "x" * 3000, "a b " * 40_000]
    encoded = bpe.encode_texts(frame(spark, texts), RANKS, PATTERN)
    decoded = {r.doc_id: r for r in bpe.decode_ids(encoded, RANKS, PATTERN).collect()}
    for r in bpe.round_trip(frame(spark, texts), RANKS, PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert list(decoded[r.doc_id].token_ids) == ids and bytes(decoded[r.doc_id].decoded) == text.encode()
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# sharding


def plain_shard(key, shards):
    """Descend by the least draw of each level, as the module says."""

    def draw(name, weight):
        u = (int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        return -math.log(u) / weight

    live = [s for s in shards if s.weight > 0]
    for name in (
        lambda s: f"region-{s.region}", lambda s: f"rack-{s.region}-{s.rack}", lambda s: f"shard-{s.number}"
    ):
        weights = {}
        for s in live:
            weights[name(s)] = weights.get(name(s), 0) + s.weight
        best = min(weights, key=lambda n: draw(n, weights[n]))
        live = [s for s in live if name(s) == best]
    return live[0].number


def test_shards_slots_and_growth(spark):
    texts = [None if i % 7 == 0 else f"text \u00e9 {i % 10}" for i in range(700)]
    rows = shard_documents(frame(spark, texts), even_tree(24), even_tree(25), slice_rows=50).collect()
    slots = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.shard == plain_shard(r.doc_id, even_tree(24))
        assert r.grown_shard == plain_shard(r.doc_id, even_tree(25)) and r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert any(r.grown_shard == 24 for r in rows)


def test_only_the_subtree_with_a_new_weight_gains_or_loses(spark):
    tree = [Shard(0, 0, 0, 1.0), Shard(1, 0, 0, 3.0), Shard(2, 0, 1, 2.0), Shard(3, 1, 0, 2.0)]
    grown = [*tree[:1], Shard(1, 0, 0, 6.0), *tree[2:]]
    ids = spark.range(4000)
    both = place(place(ids, F.col("id"), tree, "old"), F.col("id"), grown, "new").collect()
    # region 0 and its rack 0 weigh more, for shard 1: rows enter these and never leave them
    allowed = {0: {0, 1}, 1: {1}, 2: {0, 1, 2}, 3: {0, 1, 2, 3}}
    assert all(r.new in allowed[r.old] for r in both)
    assert any(r.old == 3 and r.new != 3 for r in both) and any(r.old == 0 and r.new == 1 for r in both)
    share = [sum(r.old == s for r in both) / 4000 for s in range(4)]
    assert np.allclose(share, [1 / 8, 3 / 8, 2 / 8, 2 / 8], atol=0.03)
    regions = sum(r.new == 3 for r in both) / 4000
    assert abs(regions - 2 / 11) < 0.03
    assert all(r.old == plain_shard(r.id, tree) and r.new == plain_shard(r.id, grown) for r in both)
    with pytest.raises(ValueError):
        place(ids, F.col("id"), [Shard(0, 0, 0, 0.0)], "x")
    with pytest.raises(ValueError):  # a region of the tree has changed, so rows could move between its shards
        place_grown(ids, F.col("id"), tree, grown, "old", "new")


def test_rows_move_into_the_new_region_only_and_make_few_draws(spark):
    ids = spark.range(20_000)
    moved = place_grown(ids, F.col("id"), even_tree(24), even_tree(25), "old", "new")
    rows = moved.collect()
    assert all(r.new in (r.old, 24) for r in rows)
    assert abs(sum(r.new == 24 for r in rows) / len(rows) - 1 / 25) < 0.006
    apart = place(place(ids, F.col("id"), even_tree(24), "old"), F.col("id"), even_tree(25), "new").collect()
    assert sorted(apart) == sorted(rows)
    share = np.bincount([r.old for r in rows], minlength=24) / len(rows)
    assert np.allclose(share, 1 / 24, atol=0.006)
    same = place_grown(ids, F.col("id"), even_tree(24), even_tree(24), "old", "new")
    assert same.filter("old <> new").count() == 0
