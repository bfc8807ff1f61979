"""Nulls, empty tables, clashing names, long texts, ties and broken inputs of the corpus operators."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, language_id, licenses, ngram_join, piece_sampling, quality_model, quality_rules, suffix_tree, url_filter, warc


def texts(n, words, seed=0):
    r = random.Random(seed)
    return [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(words)) for _ in range(n)]


def near(text, k):
    w = text.split()
    for i in range(k):
        w[-1 - i] = f"edit{i}"
    return " ".join(w)


def test_links_go_through_null_ids(spark):
    (a,) = texts(1, 200)
    b, c = near(a, 16), near(near(a, 16), 32)  # a ~ b ~ c, a and c aren't linked
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in (a, b, c)]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    for ids, want in (((1, 9, 2), 1), ((1, None, 2), 1), ((None, None, None), None), ((5, 3, None), 3)):
        df = spark.createDataFrame(list(zip(ids, (a, b, c))), "doc_id long, text string")
        assert {r.component_id for r in ngram_join.ngram_components(df).collect()} == {want}


def test_repeated_ids_are_apart(spark):
    b, z = texts(2, 60)
    df = spark.createDataFrame([(3, b), (7, b), (7, z)], "doc_id long, text string")
    got = {(r.id, r.component_id, r.set_key) for r in ngram_join.ngram_components(df).collect()}
    assert {(i, c) for i, c, _ in got} == {(3, 3), (7, 3), (7, 7)} and len({k for _, _, k in got}) == 2


def test_large_groups_of_near_copies(spark):
    (a,) = texts(1, 120)
    rows = [(i, near(a, 3) + f" tail{i} end{i}") for i in range(300)]
    others = [(1000 + i, t) for i, t in enumerate(texts(40, 60, 5))]
    df = spark.createDataFrame(rows + others, "doc_id long, text string")
    got = {r.id: r.component_id for r in ngram_join.ngram_components(df).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(40))


def test_overlaps_over_blocks_are_exact(spark):
    a, b = texts(1, 300, 3)[0], None
    b = near(a, 25)
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    x, y = ngram_join.shingle_sets([a.encode(), b.encode()])
    pairs = spark.createDataFrame([(ngram_join.set_key(x), len(x), ngram_join.set_key(y), len(y))], "a long, na long, b long, nb long")
    common = len(set(x.tolist()) & set(y.tolist()))
    for blocks in (1, 3, 4):
        assert [r.common for r in ngram_join.linked(df, pairs, 5, 50, blocks).collect()] == [common]
    assert ngram_join.linked(df, pairs, 5, 99).count() == 0


def test_suffix_tree_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = suffix_tree.score(docs, F.lit(False), ["doc_id"]).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert suffix_tree.score(docs.where("doc_id = 9"), F.lit(True), ["doc_id"]).count() == 0


def test_clashing_names(spark):
    own = "suffix host __t __text __w __l __r __s __p __c __q __threshold __row __key __found0 given url path rule v score k t s h p f contamination rules licenses quality".split()
    urls = spark.createDataFrame([(1, "http://a.net/", *["x"] * len(own))], ["page_id", "link", *own])
    got = url_filter.filter_urls(urls, "link").first()
    assert got.suffix == "x" and got.verdict == "block" and got.host == "a.net" and got.v == "x"
    docs = spark.createDataFrame([(1, "some words of text " * 30, "en", *["x"] * len(own))], ["doc_id", "body", "lang", *own])
    rest = [c for c in own if c not in ("contamination", "rules", "licenses", "quality")]
    benchmark = spark.createDataFrame([(1, "words of")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for df, new in (
        (quality_rules.quality_rules(docs, "body"), "rules"),
        (decontaminate.find_contamination(docs, benchmark, "body"), "contamination"),
        (licenses.scan_licenses(docs, "body"), "licenses"),
        (quality_model.quality_filter(docs, labels, text_col="body"), "quality"),
        (piece_sampling.encode_samples(docs, text_col="body"), "ids"),
    ):
        row = df.first()
        assert all(row[c] == "x" for c in rest if c != new) and row[new] != "x"
    records = spark.createDataFrame([(1, "u", 1, "response", {"etag": "1"}, "p1", "x", "x", "x"), (2, "u", 2, "revisit", {"etag": "1"}, None, "x", "x", "x")], "seq long, url_key string, ts long, kind string, headers map<string,string>, payload string, __r string, k string, part string")
    got = warc.resolve_revisits(records, partitions=2).where("seq = 2").first()
    assert (got.resolved_seq, got.resolved_payload, got.k, got.part) == (1, "p1", "x", "x")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels, items = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = language_id.train(language_id.training_sample(docs, "text", "lang", "doc_id"))
    for df in (
        language_id.identify(docs, model),
        url_filter.filter_urls(pages),
        quality_rules.quality_rules(docs),
        licenses.scan_licenses(docs),
        decontaminate.find_contamination(docs, items),
        warc.resolve_revisits(warc.captures(pages)),
        quality_model.quality_filter(docs, labels),
        piece_sampling.encode_samples(docs),
    ):
        assert df.count() == 0


def test_language_of_long_texts():
    text = "Das  Haus-und 12 der Garten, Σ\u00e9t\u00e9 " * 40
    whole = [language_id.slot_counts(text), language_id.letters(text).tolist()]
    size, language_id.SLICE = language_id.SLICE, 7
    try:  # slices share no subword and add no bound
        again = [language_id.slot_counts(text), language_id.letters(text).tolist()]
    finally:
        language_id.SLICE = size
    assert whole[1] == again[1] and all((x == y).all() for x, y in zip(whole[0], again[0]))


def test_language_sample_keeps_long_texts_and_ties(spark):
    rows = [(7, "the house and garden " * k, "en") for k in (1, 20_000, 3)] + [(7, "das haus und garten", "de"), (8, None, "de"), (9, "x", None)]
    samples = [language_id.training_sample(spark.createDataFrame(rows[::way], "doc_id long, text string, lang string").repartition(3), "text", "lang", "doc_id") for way in (1, -1)]
    flat = [[(s.tolist(), c.tolist(), lang) for s, c, lang in x] for x in samples]
    assert flat[0] == flat[1] and len(flat[0]) == 4 and max(sum(c) for _, c, _ in flat[0]) > 1_000_000
    model = language_id.train(samples[0])
    got = language_id.identify(spark.createDataFrame([(1, None), (2, "12 ."), (3, "das haus")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got[:2]] == [("und", 0.0, True)] * 2 and 0 < got[2].score <= 1


def record(body, kind="response", extra=b""):
    return b"WARC/1.0\r\nWARC-Type: " + kind.encode() + b"\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n" + extra + b"Content-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_broken_warc_records():
    good = record(b"one") + b"junk line\r\n" + record(b"two") + record(b"three").replace(b"Content-Length: 5", b"Content-Length: x") + record(b"four") + record(b"x" * 50)[:-30]
    got = [(r["payload"], r["error"]) for r in warc.parse_warc(good)]
    assert [p for p, _ in got] == [b"one", None, b"two", None, b"four", None] and [e is None for _, e in got] == [True, False, True, False, True, False]
    zipped = gzip.compress(record(b"one")) + gzip.compress(record(b"two" * 500))[:-20] + gzip.compress(record(b"three"))
    rows = list(warc.parse_warc(zipped))
    assert rows[0]["payload"] == b"one" and rows[-1]["payload"] == b"three" and any(r["error"] for r in rows) and [r["seq"] for r in rows] == list(range(len(rows)))
    cut = list(warc.parse_warc(gzip.compress(record(b"one"))[:-12]))
    assert cut[-1]["error"] and list(warc.parse_warc(b"")) == []


def test_read_warc(spark, tmp_path):
    http = b"HTTP/1.1 304 Not Modified\r\nLast-Modified: x\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(b"one")) + gzip.compress(record(http, "revisit", b"Content-Type: application/http\r\n")))
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.seq, r.kind, r.url_key, r.error) for r in rows] == [(0, "response", "a", None), (1, "revisit", "a", None)]
    assert rows[1].headers == {"last-modified": "x"} and rows[1].ts is not None


def test_revisits_of_odd_records(spark):
    rows = [(1, "u", 5, "response", {"last-modified": "m"}, "p"), (2, "u", 6, "revisit", {"last-modified": "m"}, None), (3, "u", 6, "revisit", {"last-modified": "n"}, None), (4, "u", 7, "revisit", {}, None), (5, "u", None, "revisit", {}, None), (6, None, 9, "revisit", None, None), (6, "u", 9, None, None, "q")]
    df = spark.createDataFrame(rows, "seq long, url_key string, ts long, kind string, headers map<string,string>, payload string")
    got = sorted((r.seq, str(r.kind), str(r.revisit_status), r.resolved_seq, r.resolved_payload) for r in warc.resolve_revisits(df, partitions=3).collect())
    assert got == [(1, "response", "None", 1, "p"), (2, "revisit", "resolved", 1, "p"), (3, "revisit", "validator_mismatch", None, None), (4, "revisit", "unverified", 1, "p"), (5, "revisit", "no_response", None, None), (6, "None", "None", None, None), (6, "revisit", "no_response", None, None)]


def test_round_trip(spark):
    rows = [(1, "Ein Wort\nund noch  eines"), (None, "k"), (2, ""), (3, None), (4, "long " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = piece_sampling.decode_pieces(piece_sampling.encode_samples(docs, k=2)).collect()
    assert {r.doc_id for r in got} == {1, None, 2, 4} and all(r.decoded == dict(rows)[r.doc_id] and r.round_trip for r in got)


def lattice(v, text):
    """All segmentations of a text with their log probabilities, listed one by one."""
    pieces = {v.bytes[i].decode(): i for i in range(len(v.bytes)) if v.log_weight[i] > float("-inf") and i not in set(v.byte_ids)}

    def listed(rest):
        if not rest:
            return [((), 0.0)]
        return [((pieces[rest[:k]], *s), v.log_weight[pieces[rest[:k]]] + x) for k in range(1, len(rest) + 1) if rest[:k] in pieces for s, x in listed(rest[k:])]

    import math

    found = listed(" " + text)
    total = math.log(sum(math.exp(x) for _, x in found))
    return {s: x - total for s, x in found}


def test_units_and_pieces_of_whole_blocks():
    import numpy as np

    r = random.Random(4)
    texts = ["a", " ", "\n", "\0", "a\0b c\n", " \n x  y\n\n z ", "\n a ", *("".join(r.choice(["the", " ", " cat", "\n", "日", "\t"]) for _ in range(30)) for _ in range(200))]
    assert [piece_sampling.split_units(t) for t in texts] == [piece_sampling._UNITS.findall(" " + t) for t in texts]
    v = piece_sampling.Vocabulary(open(piece_sampling.DEFAULT_MODEL, "rb").read())
    codes = [np.array([r.choice([5, 77, -ord("é") - 1, -ord("\t") - 1, -ord("😀") - 1]) for _ in range(r.randint(0, 6))], np.int32) for _ in range(50)]
    want = [[x for c in some.tolist() for x in ([c] if c >= 0 else [v.byte_ids[b] for b in chr(-c - 1).encode()])] for some in codes]
    assert [x.tolist() for x in v.expanded(codes)] == want and v.expanded([]) == []


def test_bounds_that_count_are_worked_out_and_few_others():
    import numpy as np

    r = np.random.default_rng(3)
    sizes, k = np.array([0, 1, 3, 700, 5000, 40, 5000]), 3
    starts = np.concatenate([[0], np.cumsum(sizes)])
    p = r.choice([1.0, 0.99, 0.9, 0.5], int(starts[-1]))
    split, spare, key = np.array([0, 0, 1, 20, 4990, 39, 0]), r.uniform(0, 0.5, len(sizes)), r.gumbel(size=len(sizes))
    noise_keys = piece_sampling.mix(np.arange(len(sizes), dtype=np.uint64))
    got = piece_sampling._bounds(np.log(p), p, starts, split, spare, key, noise_keys, k)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        left = 1.0 - p[a:b]
        if split[i] < b - a:
            left[split[i]] = spare[i]
        with np.errstate(divide="ignore"):
            g = np.cumsum(np.log(p[a:b])) - np.log(p[a:b]) + np.log(left) - np.log(-np.log(piece_sampling.uniform(np.full(b - a, noise_keys[i]), np.arange(b - a))))
        want = np.where(np.arange(b - a) < split[i], -np.inf, -np.logaddexp(-key[i], -g))
        top = np.argsort(-want, kind="stable")[:k]
        assert np.allclose(got[a:b][top], want[top]) and ((got[a:b] == -np.inf) | (got[a:b] == want)).all()
    assert (got[starts[6] :] > -np.inf).sum() < 150  # of the last path's 5,000


def test_samples_against_the_listed_lattice():
    import math
    from collections import Counter

    import numpy as np

    v = piece_sampling.Vocabulary(open(piece_sampling.DEFAULT_MODEL, "rb").read())
    lattices, n = piece_sampling.Lattices(v), 4000
    want = lattice(v, "the cat")
    found = piece_sampling.sample_texts(lattices, ["the cat"] * n, piece_sampling.mix(np.arange(n, dtype=np.uint64)), 2)
    for samples in found:
        for pieces, log_prob, inclusion in samples:
            assert log_prob == pytest.approx(want[tuple(pieces.tolist())]) and inclusion <= 0
    # without replacement: how often the pair (first, second) is met is p1 * p2 / (1 - p1)
    pairs = Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b in found)
    for (a, b), c in pairs.most_common(12):
        p = math.exp(want[a]) * math.exp(want[b]) / (1 - math.exp(want[a]))
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    # inclusion scores: the sum of p / inclusion over the samples estimates all probability, which is 1
    weight = [sum(math.exp(x) / math.exp(i) for _, x, i in samples) for samples in found]
    assert np.mean(weight) == pytest.approx(1.0, abs=0.1)


def test_patience_against_listing():
    import itertools

    r = random.Random(8)
    for _ in range(200):
        a, b = r.sample("abcdefgh", 6), r.sample("abcdefgh", 6)  # words that are met once: anchors are a longest common subsequence
        best = max(k for k in range(7) for x in itertools.combinations(a, k) if any(list(x) == list(y) for y in itertools.combinations(b, k)))
        got = licenses.patience([x.encode() for x in a], [x.encode() for x in b])
        assert len(got) == best and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_license_cases(spark):
    mit = "released under the MIT license"
    rows = [(1, None), (2, ""), (3, f"x {mit}. y {mit}!"), (4, "nothing here"), (5, "word " * 50_000 + mit)]
    got = {r.doc_id: [(m.license, m.start) for m in r.licenses] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [("MIT", 1), ("MIT", 7)], 4: [], 5: [("MIT", 50_000)]}


def test_trees_learn_from_rules(spark):
    urls = [f"http://{'x' * (i % 9)}{i}.net/a/b/c?p={i}" for i in range(200)] + [f"https://h{i}.org/fr/" for i in range(200)] + ["http://87y.info/a/b/c?p=9", "https://h7.com/en/"]
    got = {r.url: r for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got["http://87y.info/a/b/c?p=9"].verdict == "block" and got["https://h7.com/en/"].verdict == "allow" and got["https://h7.com/en/"].rule is None
    features = url_filter.lexical_features(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    row = spark.createDataFrame([("http://aab.net/x?k=1",)], "url string").select(*[c.alias(n) for n, c in features.items()]).first()
    import math
    from collections import Counter

    text = "http://aab.net/x?k=1"
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())
    assert row.f_entropy == pytest.approx(entropy) and (row.f_length, row.f_depth, row.f_params, row.suffix, row.f_labels) == (20.0, 1.0, 1.0, "net", 2.0)


def test_ordered_sorts_narrow_keys_once(monkeypatch):
    import numpy as np

    from lectern.llm import suffix_tree

    r, calls, ranks = np.random.default_rng(1), [], suffix_tree.ranks
    monkeypatch.setattr(suffix_tree, "ranks", lambda k: calls.append(1) or ranks(k))
    narrow = [r.integers(0, 1 << 20, 5000), r.integers(0, 9, 5000), r.permutation(5000)]
    assert (suffix_tree.ordered(*narrow) == np.lexsort(narrow[::-1])).all() and not calls
    wide = [r.integers(0, 9, 5000) << 59, r.integers(0, 9, 5000) << 59, r.permutation(5000)]
    assert (suffix_tree.ordered(*wide) == np.lexsort(wide[::-1])).all() and calls
