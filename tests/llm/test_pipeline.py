"""Stages of the pipeline against brute force on small fixtures, and the whole of it."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline

SCHEMA = "doc_id long, text string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_apply_rules(spark):
    good = "\n".join(prose(i, 12) + "." for i in range(10))
    menu = "Home | About | News | Contact"
    rows = [(1, good, len(good)), (2, f"{menu}\n{good}", 5), (2, f"{menu}\n{good}", 5), (3, menu, 7), (4, None, None), (None, good, 3)]
    got = corpus_pipeline.apply_rules(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "n_chars"]
    # the menu goes with its line; a text that lost nothing keeps its n_chars, whatever it is
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, good, len(good)), (2, good, len(good)), (2, good, len(good)), (None, good, 3)], key=str)


def test_deduplicate(spark):
    a, b, c, d = map(prose, range(4))
    rows = [(5, a), (2, a), (2, a), (9, b), (7, c), (6, c), (7, d), (8, d), (None, prose(9)), (11, None), (12, None)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.deduplicate(spark, spark.createDataFrame([(i, t, 0) for i, t in rows], SCHEMA), "").collect()]
    # texts are the same or have nothing in common: a component is a text
    least = {t: min((i for i, u in rows if u == t and i is not None), default=None) for _, t in rows}
    want = {(i, t) for i, t in rows if t is None or i == least[t]}
    assert len(got) == len(set(got)) and set(got) == want


def test_run(spark, tmp_path, monkeypatch):
    stages, seen = list(corpus_pipeline.STAGES), []
    assert [k for k, _ in stages] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece_sampling"]
    hooked = [(k, lambda s, d, f, k=k, g=g: (out := g(s, d, f), seen.append((k, {r.doc_id for r in out.select("doc_id").collect()})))[0]) for k, g in stages]
    monkeypatch.setattr(corpus_pipeline, "STAGES", hooked)
    texts = [prose(i) for i in range(8)]
    bench = prose(50)
    docs = [(i, t) for i, t in enumerate(texts)] + [(20, texts[3]), (21, bench), (22, "one two")]
    pq.write_table(pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["x"] * len(docs), "n_chars": [len(t) for _, t in docs]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [0], "quality": [0], "toxic": [0]}), tmp_path / "labels.parquet")  # nothing is trusted: all with words stay
    pq.write_table(pa.table({"item_id": [1], "text": [bench]}), tmp_path / "benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    everything = {i for i, _ in docs}
    assert [ids for _, ids in seen][:4] == [everything, everything - {22}, everything - {22, 20}, everything - {22, 20, 21}]
    assert kept == set(range(8)) and got.count() == 16


def test_classify_bounds_no_trusted_texts(monkeypatch):
    import inspect

    import corpus_pipeline
    from lectern.llm.quality_model import quality_filter

    class Asked(Exception):
        pass

    def asked(*args, **how):
        raise Asked(inspect.signature(quality_filter).bind(*args, **how))

    monkeypatch.setattr(corpus_pipeline, "quality_filter", asked)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *a: None)
    try:
        corpus_pipeline.classify(None, None, "")
    except Asked as e:
        bound = e.args[0]
        bound.apply_defaults()
        assert bound.arguments["max_trusted"] is None
    else:
        raise AssertionError("not asked")


def tables_left(folder):
    return {p: pq.read_schema(next(p.rglob("*.parquet"))).names for p in folder.glob("lectern-*") if any(p.rglob("*.parquet"))}


def test_stages_leave_little_on_disk(spark, tmp_path, monkeypatch):
    import time

    from lectern.llm import common
    from lectern.llm.ngram_join import ngram_components
    from lectern.llm.quality_model import quality_filter

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")

    def shuffles():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in (found.apply(i).toString() for i in range(found.size())) if b.startswith("shuffle_")}

    # what was shuffled for a table goes with its query, and the caller's setting stays
    before, set_to = shuffles(), spark.conf.get(common.SHUFFLES_GO, None)
    t = common.materialize(spark.range(1000).selectExpr("id", "id % 2 AS part").repartition(3, "id"), "part")
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(common.SHUFFLES_GO, None) == set_to and t.count() == 1000
    common.discard(t)
    assert not list(tmp_path.glob("lectern-*"))  # the whole of a partitioned table
    # no sets of shingles, leading columns or pairs
    texts = [prose(i) for i in range(6)]
    rows = list(enumerate([*texts, *(t + " tail" for t in texts)]))
    got = ngram_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.id: r.component_id for r in got.collect()} == {i: i % 6 for i in range(12)}
    assert sorted(map(tuple, tables_left(tmp_path).values())) == sorted([("id", "t", "k", "n", "segment", "data"), ("k", "n", "rep"), ("u", "v")])
    # no copy of the texts
    there = set(tables_left(tmp_path))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = quality_filter(docs, spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int"))
    assert got.count() == 12
    assert not [c for p, c in tables_left(tmp_path).items() if p not in there and {"given", "text"} & set(c)]
