"""Corpus operators against brute force on small fixtures, with nulls, empty and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import decontaminate, gram_model, language_id, licenses, ngram_join, piece_sampling, quality_model, quality_rules, suffix_tree, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, rules string"


def corpus(n=60, seed=1):
    r = random.Random(seed)
    words = [a + b for a in "ka lo mi ne ru tu".split() for b in "ba ce di fo gu".split()]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(60, 150))), "en", "x") for i in range(n)]
    for i in range(0, 20, 2):  # near copies
        w = rows[i][1].split()
        for _ in range(i // 4):
            w[r.randrange(len(w))] = "edit"
        rows.append((100 + i, " ".join(w), "en", None))
    return [*rows, (500, None, None, None), (501, "", "en", "x"), (502, "one two", None, "x"), (503, "One\ttwo", "en", "x"), (None, "a b c d e f", "en", "x"), (7, rows[7][1], "en", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_ngram_components(docs):
    rows = corpus()
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    want = Counter()
    for i, row in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want[(row[0], len(sets[i]), min(ids) if ids else None)] += 1
    got = Counter((r.id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect())
    assert got == want


def test_ngram_empty(spark):
    assert ngram_join.ngram_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules(docs):
    got = {r.doc_id: r.r for r in quality_rules.quality_rules(docs.where("doc_id >= 500")).select("doc_id", F.col("rules").alias("r")).collect()}
    assert got[500].n_words == 0 and got[500].base_failed and not got[500].kept
    assert got[502].n_words == 2 and got[502].word_chars == 6


def test_rules_lines(spark):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(10))
    rows = [(1, good, "", ""), (2, good + "\nHome | About | News | Contact", "", ""), (3, "\n".join(["a | b | c | d"] * 3 + ["only one line of text"]), "", "")]
    got = {r.doc_id: r.rules for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).drop("rules")).collect()}
    assert got[1].kept and got[2].kept and got[2].clean_text == good and not got[3].kept
    assert got[3].n_dup_lines == 2


def test_rules_repeats_of_long_texts(spark):
    n = 4_000_000
    long = spark.range(1).select(F.lit(1).alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.hex(i))).alias("text"))  # all words differ
    r = quality_rules.quality_rules(long).select("rules.n_words", "rules.n_repeat_words").first()
    assert r.n_words == n and r.n_repeat_words == 0


def test_wu_manber():
    r = random.Random(3)
    text = " " + " ".join(r.choice("ab ba abc c ca".split()) for _ in range(400)) + " "
    patterns = sorted({f" {' '.join(r.choice('ab ba abc c ca'.split()) for _ in range(r.randint(1, 14)))} ".encode() for _ in range(60)})
    want = sorted((i, p) for p in patterns for i in range(len(text)) if text.encode().startswith(p, i))
    assert sorted(decontaminate.WuManber(patterns).search(text.encode())) == want


def test_contamination_passes(spark, docs):
    items = spark.createDataFrame([(1, corpus()[3][1]), (2, "one two"), (3, None), (4, "a b, c")], "item_id long, text string")
    found = [decontaminate.find_contamination(docs, items, patterns_per_pass=n).select("doc_id", "contamination").orderBy("doc_id", "contamination.n_hit").collect() for n in (5, 1000)]
    assert found[0] == found[1]
    by = {r.doc_id: r.contamination for r in found[0]}
    assert by[3].n_hit == by[3].n_words and by[3].contaminated and by[502].items == ["2"] and by[500].n_words == 0 and not by[501].contaminated


def test_suffix_tree(docs):
    got = suffix_tree.score(docs, ~suffix_tree.held_out(), ["doc_id"]).collect()
    assert len(got) == len(corpus()) and all(r.score <= 0 and r.n_known <= r.n_tokens for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_suffix_tree_keeps_passages_at_any_size(spark):
    r = random.Random(4)
    filler = [(" ".join(r.choice("ba ce di fo gu".split()) for _ in range(3000)),) for _ in range(400)]  # 4e-6 of 1.2 million tokens is 4.8
    passages = [("zeta eta theta iota kappa",)] * 3
    found = []
    for rows in (passages + filler[:4], passages + filler):
        docs = spark.createDataFrame([(None, *x) for x in rows] + [(1, "zeta eta theta iota kappa"), (2, "kappa iota theta eta zeta")], "doc_id long, text string")
        by = {x.doc_id: x.score for x in suffix_tree.score(docs, F.col("doc_id").isNull(), ["doc_id"]).where("doc_id is not null").collect()}
        found.append(by[1] - by[2])
    assert found[0] > 5 and found[1] > 5


def brute_force_tree(rows, asked):
    """(n_tokens, n_known, base, score) of the asked texts, by sequences listed one by one."""
    lists = [[*(x or "").lower().split(), 0] for x in rows]
    n = Counter(tuple(x[i - k + 1 : i + 1]) for x in lists for i in range(len(x)) for k in range(1, 5) if i >= k - 1)
    total, kinds = sum(map(len, lists)), [v for k, v in n.items() if len(k) == 1]
    discount = kinds.count(1) / (kinds.count(1) + 2 * kinds.count(2)) if kinds.count(1) and kinds.count(2) else 0.5
    share = lambda ctx, w: n[(*ctx, w)] / (n[ctx] if ctx else total)
    tree = {}
    follow = {}
    for k, v in n.items():
        if len(k) > 1 and v >= 2:
            follow.setdefault(k[:-1], {})[k[-1]] = v
    for ctx, after in follow.items():
        left, left_q = n[ctx] - sum(after.values()), max(1 - sum(share(ctx[1:], w) for w in after), 1e-12)
        gain = sum(v * math.log(v / n[ctx] / share(ctx[1:], w)) for w, v in after.items()) + (left * math.log(left / n[ctx] / left_q) if left else 0)
        if gain >= 10:
            weights = {w: (v - 0.5) / n[ctx] for w, v in after.items()}
            tree[ctx] = weights, max(1 - sum(weights.values()), 1e-9)
    assert tree
    out = []
    for text in asked:
        words = [*(text or "").lower().split(), 0]
        score = 0.0
        for i, w in enumerate(words):
            p = (n[(w,)] - discount) / total if (w,) in n else discount * len(kinds) / total
            for k in range(1, min(i, 3) + 1):
                if (ctx := tuple(words[i - k : i])) in tree:
                    p = tree[ctx][0].get(w, 0.0) + tree[ctx][1] * p
            score += math.log10(p)
        out.append((len(words), sum((y,) in n for y in words), sum(math.log10((n[(y,)] + 1) / (total + len(kinds) + 1)) for y in words), score))
    return out


def test_suffix_tree_brute_force(spark):
    r = random.Random(11)
    words = [a + b for a in "ka lo mi ne".split() for b in "ba ce di".split()]
    rows = ["a b c d e"] * 8 + ["x b c q", "q b c q a", "", None, "a A b"] + ["u v w"] * 6 + [" ".join(r.choice(words) for _ in range(40)) for _ in range(30)] + ["a " * 60]
    asked = ["a b c d e", "x b c d", "v w zzz a", None, "q b c q", "a a a a zz", " ".join(words), ""]
    want = brute_force_tree(rows, asked)
    docs = spark.createDataFrame([(k, x, False) for k, x in enumerate(asked)] + [(None, x, True) for x in rows], "doc_id long, text string, learn boolean").repartition(3)
    for options in ({}, {"heads": 0}, {"shard": 64, "heads": 5}, {"held": 4}, {"shard": 64, "held": 20}):  # all words broadcast, none; shards in passes; words dealt to several shards
        got = {x.doc_id: x for x in suffix_tree.score(docs, F.col("learn"), ["doc_id", "learn"], **options).where("not learn").collect()}
        for k, (n_tokens, n_known, base, score) in enumerate(want):
            assert (got[k].n_tokens, got[k].n_known) == (n_tokens, n_known) and got[k].base_score == pytest.approx(base, rel=1e-5) and got[k].score == pytest.approx(score, rel=1e-5)


def test_language_id():
    rows = [(f"the house and the garden with {i}", "en") for i in range(80)] + [(f"das haus und der garten mit {i}", "de") for i in range(80)]
    model = language_id.train([(*language_id.slot_counts(t), lang) for t, lang in rows])
    assert model.predict("the garden and house")[0] == "en" and model.predict("der garten und haus")[0] == "de"
    assert model.predict(None)[0] == "und" and model.predict("12 -")[:2] == ("und", 0.0)


def test_patience():
    a, b = b"x the quick brown fox y".split(), b"the quick red brown fox".split()
    assert licenses.patience(a, b) == [(1, 0), (2, 1), (3, 3), (4, 4)]
    found = licenses.Scanner().scan(b"foo licensed under cc by nc 4 0 bar released under the mit license".split())
    assert [f["license"] for f in found] == ["CC-BY-NC-4.0", "MIT"]


def test_urls(spark):
    urls = ["https://a.example.net/en/1", "http://b.NET/x", "https://example.com/de/2?q=1", "https://x.org/fr/", "https://x.org/en/", "nothing", None, "http://net", "http://www.example.com/de/9"] * 5
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert got["https://a.example.net/en/1"][2:] == ("example.net/en/", "allow") and got["http://b.NET/x"] == ("b.net", "/x", "net/", "block")
    assert got["https://example.com/de/2?q=1"][1:] == ("/de/2", "example.com/de/", "block") and got["https://x.org/fr/"][2:] == ("org/fr/", "allow")
    assert got[None][:3] == ("", "", None) and got["http://net"][2] is None and got["nothing"][0] == ""


def test_revisits(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["u", "v", None]), r.randint(0, 40), r.choice(["response", "revisit"]), {"etag": r.choice(["1", "2"]), "date": str(i), "server": "s"}, f"p{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, url_key string, ts long, kind string, headers map<string,string>, payload string")
    for x in warc.resolve_revisits(df, partitions=7).collect():
        if x.kind == "response":
            assert x.resolved_seq == x.seq and x.revisit_status is None
            continue
        before = [y for y in rows if y[1] == x.url_key and y[3] == "response" and (y[2], y[0]) < (x.ts, x.seq)] if x.url_key else []
        if not before:
            assert x.revisit_status == "no_response" and x.resolved_seq is None
            continue
        best = max(before, key=lambda y: (y[2], y[0]))
        same = best[4]["etag"] == x.headers["etag"]
        assert x.revisit_status == ("resolved" if same else "validator_mismatch")
        assert (x.resolved_seq, x.resolved_payload) == ((best[0], best[5]) if same else (None, None))
        if same:
            assert x.merged_headers == {"etag": best[4]["etag"], "date": str(x.seq), "server": "s"}


def test_warc_records():
    body = b"HTTP/1.1 200 OK\r\nETag: 1\r\n\r\nhello"
    data = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a/\r\nContent-Type: application/http\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    (row,) = warc.parse_warc(data)
    assert row["error"] is None and row["kind"] == "response" and row["headers"] == {"etag": "1"} and row["payload"] == b"hello"


def test_quality_model(spark):
    r = random.Random(2)
    good = [(i, " ".join(r.choice("the cat sat on mat and dog ran far".split()) for _ in range(60)), "en", "") for i in range(80)]
    bad = [(i, " ".join("".join(r.choice("#%&!XQZ") for _ in range(6)) for _ in range(60)), "en", "") for i in range(100, 110)]
    docs = spark.createDataFrame([*good, *bad, (200, None, None, ""), (201, "", "en", "")], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(70)] + [(100, 0), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x.quality for x in quality_model.quality_filter(docs, labels).collect()}
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in range(100, 110)) and not got[200].kept and not got[201].kept
    none = quality_model.quality_filter(docs, labels.where("quality = 5")).collect()
    assert sum(x.quality.kept for x in none) == 90


def test_quality_thresholds_of_all_trusted(spark):
    r = random.Random(6)
    made = lambda words: " ".join(r.choice(words.split()) for _ in range(60))
    rows = [(i, made("the cat sat on mat and dog ran far"), "en", "") for i in range(900)] + [(1000 + i, made("ein kleiner hund lief weit durch wald und feld"), "de", "") for i in range(90)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(x[0], 1) for x in rows], "doc_id long, quality int")
    got = {x.doc_id: (x.lang, x.quality) for x in quality_model.quality_filter(docs, labels, max_trusted=60).collect()}
    # the rare language has a threshold of its own, though the sample has a few of its texts, and its texts are kept
    thresholds = {k: {round(q.threshold - quality_model.SHORT / math.sqrt(len(rows[i if i < 900 else i - 100][1]) + 1), 9) for i, (lang, q) in got.items() if lang == k} for k in ("en", "de")}
    assert all(len(v) == 1 for v in thresholds.values()) and thresholds["en"] != thresholds["de"]
    assert all(q.kept for _, q in got.values())


def test_quality_model_counts_all_trusted_texts_whole(spark, monkeypatch):
    made = []
    whole = quality_model._weights
    monkeypatch.setattr(quality_model, "_weights", lambda *a: made.append(whole(*a)) or made[-1])
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(f"one two three four w{i % 7}".split()) for _ in range(30 if i else 4000)), "en", "") for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    quality_model.quality_filter(docs, spark.createDataFrame([(x[0], 1) for x in rows], "doc_id long, quality int")).count()
    want = whole(gram_model.gram_counts(spark.createDataFrame([(bytearray(x[1].encode()), 1) for x in rows], "text binary, c long"), quality_model.ORDER))
    assert np.array_equal(made[-1].weight.keys, want.weight.keys) and np.allclose(made[-1].weight.values, want.weight.values)
    assert len(made) == 3 and all(0 < len(m.weight.keys) <= len(want.weight.keys) for m in made)


def test_gram_counts_of_a_long_text_in_parts(spark):
    text = spark.createDataFrame([(bytearray(b"abra cad abra " * 40), 2), (bytearray(b"x y"), 1)], "text binary, c long")
    counts = [sorted(map(tuple, gram_model.gram_counts(text, 5, block).collect())) for block in (7, 50, 1 << 20)]
    assert counts[0] == counts[1] == counts[2]


def test_fold_counts_against_listed_grams(spark):
    r = random.Random(8)
    rows = [(" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 40))), r.randint(1, 3), r.randint(0, 1)) for _ in range(40)]
    want = [Counter(), Counter()]
    for text, c, fold in rows:
        cp, starts = gram_model.stream([text.encode()])
        for n, _, key, ctx, suf in gram_model.grams(cp, 4, starts):
            for x in zip(key.view(np.int64).tolist(), ctx.view(np.int64).tolist(), suf.view(np.int64).tolist()):
                want[fold][(n, *x)] += c
    texts = spark.createDataFrame([(bytearray(t.encode()), c, fold) for t, c, fold in rows], "text binary, c long, fold int").repartition(3)
    for block, bits in ((1 << 20, 19), (60, 3), (60, 1)):  # with few slots most sequences are sent at once
        got = gram_model.fold_counts(texts, 4, block, bits).collect()
        for k in (0, 1):
            assert {tuple(x[:4]): x[4 + k] for x in got if x[4 + k]} == dict(want[k])


def test_quality_filter_moves_no_text(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("one two three four five six seven".split()) for _ in range(10_000)), "en", "") for i in range(60)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, doubles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, held = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many labels
    try:
        assert quality_model.quality_filter(docs, labels).count() == 60
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert written() - before < 400_000  # the texts are 2.9 MB; 0.7 MB at 2 bits a letter


def test_having_sent_and_joined(spark, monkeypatch):
    texts = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "c"), ("x", None)], "id string, text string")
    ids = spark.createDataFrame([("1",), ("x",), ("1",), ("9",)], "id string")
    for most in (quality_model.SENT_IDS, 1):
        monkeypatch.setattr(quality_model, "SENT_IDS", most)
        assert sorted(quality_model._having(texts, ids).collect(), key=str) == [("1", "a"), ("1", "c"), ("x", None)]
        assert quality_model._having(texts, ids.limit(0)).count() == 0


def test_thresholds_are_exact_quantiles(spark, monkeypatch):
    r = random.Random(12)
    monkeypatch.setattr(quality_model, "ACCURACY", 20)  # beyond that many values Spark's quantiles are approximate
    rows = [(lang, r.choice([1.0, r.gauss(0, 1)])) for lang, n in (("en", 3000), ("de", 41), (None, 500), ("fr", 1)) for _ in range(n)]
    got = {(x.lang, x.g): (x.n, x.x) for x in quality_model._quantiles(spark.createDataFrame(rows, "lang string, v double").repartition(5), [0.5, 0.93]).collect()}
    for key in [("en", 0), ("de", 0), (None, 0), ("fr", 0), (None, 1)]:
        v = sorted(x for lang, x in rows if key[1] or lang == key[0])
        assert got.pop(key) == (len(v), [v[max(math.ceil(p * len(v)), 1) - 1] for p in (0.5, 0.93)])
    assert not got
    # and quality_filter takes its thresholds from them
    rows = [(i, " ".join(r.choice("the cat sat on mat and dog ran far".split()) for _ in range(r.randint(3, 30))), "en", "") for i in range(600)]
    labels = spark.createDataFrame([(x[0], 1) for x in rows], "doc_id long, quality int")
    seen = []
    for accuracy in (20, 10_000):
        monkeypatch.setattr(quality_model, "ACCURACY", accuracy)
        seen.append({x.doc_id: x.quality.threshold for x in quality_model.quality_filter(spark.createDataFrame(rows, SCHEMA), labels).collect()})
    assert seen[0] == pytest.approx(seen[1], abs=1e-12)


def test_quality_shares():
    got = quality_model.shares({"en": 9000, "de": 500, None: 100}, 2000)
    assert got == {None: 1.0, "de": 1.0, "en": pytest.approx(1400 / 9000)} and quality_model.shares({"en": 5}, 10) == {"en": 1.0}


def test_gram_model_adds_up(spark):
    words = spark.createDataFrame([(bytearray(w.encode()), c) for w, c in (("ab", 5), ("abc", 2), ("b", 1), ("ca", 3))], "word binary, c long")
    model = quality_model.kneser_ney(words, order=3)
    total = 0.0
    for first in ["a", "b", "c", "z"]:
        total += 10 ** model.log10_words([first.encode()])[0] / model.symbol_probabilities(np.array([0x110001, ord(first), 0x110001]))[2]
    assert total == pytest.approx(1.0 - model.symbol_probabilities(np.array([0x110001, 0x110001]))[1], abs=1e-6)


def test_gram_model_reads_through_bounds(spark):
    texts = ["ab cd ab cd ef", "cd ab", "ef ab cd", "a b"]
    model = quality_model.kneser_ney(spark.createDataFrame([(bytearray(x.encode()), 1) for x in texts], "text binary, c long"), order=4)
    for asked in (["ab cd ef", "", " cd  ab\n", "zz ab a b", "ab cd ef"], ["ab"] * 3):
        # brute force: each text by itself, each symbol by its own n-grams
        want = [float(np.log10(model.symbol_probabilities(gram_model.stream([x.encode()])[0]))[1:].sum()) for x in asked]
        for bits, part in ((21, 1 << 19), (1, 3)):
            scores = gram_model.TextScores(model, bits, part)
            for _ in range(2):
                logs, symbols = scores.logs([x.encode() for x in asked])
                assert logs == pytest.approx(want) and symbols.tolist() == [len(" ".join(x.split())) + 1 if x.split() else 0 for x in asked]
    for before in ("ab ", "cd e", "b"):  # sums to 1 over the next symbol, given what stands before
        cp = [0x110001, *(0x110001 if x == " " else ord(x) for x in before)]
        p = [model.symbol_probabilities(np.array([*cp, x]))[-1] for x in [0x110001, *map(ord, "abcdef")]]
        z = model.symbol_probabilities(np.array([*cp, ord("z")]))[-1]  # stands for all symbols that training never met
        assert sum(p) + z == pytest.approx(1.0)
    ordered, shuffled = (scores.logs([x])[0][0] for x in (b"ab cd ef", b"cd ef ab"))
    alone = sum(scores.logs([x])[0][0] for x in (b"ab", b"cd", b"ef"))
    assert ordered != pytest.approx(shuffled) and ordered != pytest.approx(alone)


def test_samples():
    v = piece_sampling.Vocabulary(open(piece_sampling.DEFAULT_MODEL, "rb").read())
    lattices = piece_sampling.Lattices(v)
    texts = ["thn", "", "  two  blanks \n\nand ▁ 日本😀\t", "x" * 300]
    n = 3000
    keys = piece_sampling.mix(np.arange(n, dtype=np.uint64))
    for t in texts:
        for samples in piece_sampling.sample_texts(lattices, [t] * 3, keys[:3], 3):
            assert len({tuple(s[0].tolist()) for s in samples}) == len(samples) and all(v.decode(s[0].tolist()).decode() == t for s in samples)
    # brute force: first samples follow the probabilities, inclusion scores estimate how often a segmentation is among k
    found = piece_sampling.sample_texts(lattices, ["thn"] * n, keys, 2)
    first = Counter(tuple(s[0][0].tolist()) for s in found)
    log_prob = {tuple(q[0].tolist()): q[1] for s in found for q in s}
    for seg, c in first.items():
        p = math.exp(log_prob[seg])
        assert abs(c / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert sum(math.exp(x) for x in log_prob.values()) <= 1 + 1e-9
    again = piece_sampling.sample_texts(lattices, ["other text", "thn"], keys[[5, 9]], 2)[1]
    assert [s[0].tolist() for s in again] == [s[0].tolist() for s in found[9]]
