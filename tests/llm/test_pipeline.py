"""The pipeline's stages against brute force, and what the operators share."""

import random
import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomsheet.llm import bpe, common, crf, decontaminate, language_id, secrets
from loomsheet.llm.components import components
from tests.llm.test_text_operators import brute_groups, brute_hits, literal_spans


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    rng = random.Random(2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    item = bench.where("item_id = 3").first().text
    base = docs.where("doc_id = 20").first().text
    extra = [(9001, None, "en"), (9002, "", "en"), (9003, "12 34 !!", "en"), (9004, base, "en"), (9005, base + " onthe", "en"), (9006, item, "en"), (9007, 'the thing and token = "0123456789abcdef0123" of the', "en"), (9007, 'the thing and token = "0123456789abcdef0123" of the', "en")]
    extra += [(9100 + k, " ".join(rng.choices(base.split(), k=80)), "en") for k in range(3)]
    more = spark.createDataFrame([(i, t, lang, "src0", len(t or "")) for i, t, lang in extra], docs.schema)
    out = str(tmp_path_factory.mktemp("sf"))
    docs.unionByName(more).write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(autouse=True)
def small_field(monkeypatch):
    """A field that is trained faster; the operator's own tests use the full one."""
    monkeypatch.setattr(secrets.fit, "__defaults__", (secrets.Settings(snippets=1500, sequences=1500, steps=100), *secrets.fit.__defaults__[1:]))


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    items = [(r.item_id, r.text) for r in common.table(spark, folder, "benchmark").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs, _ = common.stored(stage(spark, docs, folder), "test")
        after = docs.collect()
        if name == "language ID":
            gone = Counter(r.doc_id for r in before) - Counter(r.doc_id for r in after)
            assert set(gone) == {9001, 9002, 9003}
        elif name == "near-dedup":
            want = brute_groups([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id for r in after) == sorted(i for i, (_, root) in want.items() if i == root)
        elif name == "decontamination":
            bad = {r.doc_id for r in before if brute_hits(r.text, items)[1]}
            assert 9006 in bad and {r.doc_id for r in before} - bad == {r.doc_id for r in after}
        elif name == "secret scan":
            old = {r.doc_id: r for r in before}
            assert set(old) == {r.doc_id for r in after}
            for r in after:
                assert not literal_spans(r.text) and r.n_chars == len(r.text)
                if not literal_spans(old[r.doc_id].text) and "[SECRET]" not in r.text:
                    assert r.text == old[r.doc_id].text
            assert sum("[SECRET]" in r.text and not literal_spans(old[r.doc_id].text) for r in after) <= 2
        else:
            ours = bpe.Encoder(*bpe._vocabulary(None))
            assert {(r.doc_id, tuple(r.ids), r.n_tokens) for r in after} == {(r.doc_id, tuple(i := ours.encode(r.text)), len(i)) for r in before}
        if name != "BPE":
            assert docs.columns == columns
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_of_nothing(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs, _ = common.stored(stage(spark, docs, folder), "empty")
    assert docs.count() == 0


def some_texts(n):
    rng = random.Random(8)
    return [" ".join(rng.choices([f"v{k}" for k in range(5000)], k=60)) for _ in range(n)]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_null_ids_are_judged_too(spark, sf):
    a, b, c, *_ = some_texts(3)
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 3").first().text
    rows = [(1, a), (None, a), (None, a + " x"), (None, b), (None, b), (None, b + " x"), (None, c), (None, None), (None, ""), (2, None)]
    got = corpus_pipeline.dedup(spark, documents(spark, rows), sf).collect()
    assert Counter((r.doc_id, (r.text or "")[:100] if r.text is not None else None) for r in got if r.text != b and r.text != b + " x") == Counter([(1, a[:100]), (None, c[:100]), (None, None), (None, ""), (2, None)])
    assert sum(r.text in (b, b + " x") for r in got) == 1
    clean = corpus_pipeline.clean_of_benchmark(spark, documents(spark, [(None, item), (None, a), (None, a), (5, item), (5, b), (None, None)]), sf).collect()
    assert Counter((r.doc_id, r.text) for r in clean) == Counter([(None, a), (None, a), (5, b), (None, None)])


def test_texts_that_share_an_id_are_judged_one_by_one(spark, sf):
    a, b, c, d, e, f = some_texts(6)
    rows = [(3, a), (5, a + " x"), (5, b), (6, c), (6, d), (6, d), (7, e), (7, e + " x"), (8, f), (8, c + " x"), (9, d + " x"), (9, d + " x")]
    got = corpus_pipeline.dedup(spark, documents(spark, rows), sf).collect()
    kept = Counter((r.doc_id, r.text) for r in got if r.doc_id != 7)
    assert kept == Counter([(3, a), (5, b), (6, c), (6, d), (8, f)])
    assert [r.text in (e, e + " x") for r in got if r.doc_id == 7] == [True]


def test_tokens_are_decoded(spark, sf):
    rows = [(1, "é 漢字 \U0001f600 one"), (None, ""), (3, None)]
    got = corpus_pipeline.tokens(spark, documents(spark, rows), sf).collect()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_hot_keys_lose_no_row(spark):
    left = spark.range(300).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1000)], "k long, v long"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, w string")
    raw = lambda df: df.withColumn("k", F.encode(F.col("k").cast("string"), "UTF-8"))
    counts = raw(left).where("k IS NOT NULL").groupBy("k").count()
    got = common.hot_lookup(raw(left), raw(right), "k", "v", hot_rows=10, counts=counts).select("v", "w").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, left.join(right, "k").select("v", "w").collect()))
    for how in ("inner", "left"):
        got = common.hot_lookup(left, right, "k", "v", how, hot_rows=10).select("k", "v", "w").collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))


def test_components(spark):
    rng = random.Random(4)
    path = [(k, k + 1) for k in range(1000, 1120)]
    star = [(5, k) for k in range(100, 160)]
    loose = [(rng.randrange(2000, 2060), rng.randrange(2000, 2060)) for _ in range(40)]
    pairs = path + star + loose + [(7, 7)] + path[:3]
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert {n: got.get(n, n) for n in root} == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_redaction():
    assert secrets.redact("abcdef", [(1, 3, 0), (2, 4, 2)]) == "a[SECRET]ef" and secrets.redact("é", []) == "é"
    assert language_id.UNDETERMINED == "und"


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 150])
def test_contaminated_rows_go_without_a_shuffle(spark, sf, tmp_path, monkeypatch, block_bytes):
    """At 6 GB texts were shuffled and sorted to meet the verdicts, which took the executors' memory."""
    monkeypatch.setattr(decontaminate.without, "__defaults__", (*decontaminate.without.__defaults__[:2], block_bytes))
    monkeypatch.setattr(decontaminate, "SHARD_ROWS", 7)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    items = [(k if k else None, " ".join(rng.choices(words, k=n))) for k, n in enumerate([30, 13, 14, 5, 1, 0, 20, 20])] + [(9, None)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(20)] + [t[:-1] for _, t in items if t]
    texts += [f"{a} {t.upper()}. {a}" for a, (_, t) in zip(texts, items, strict=False) if t] + ["", None, " ".join(items[6][1].split()[1:14]), " ".join(items[6][1].split()[1:13])]
    texts = [t.replace(items[4][1], "v") if t and k % 2 else t for k, t in enumerate(texts)]
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)] * 2
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, _ = common.stored(documents(spark, rows).coalesce(2), "test")
    got = corpus_pipeline.clean_of_benchmark(spark, docs, str(tmp_path))
    want = Counter((i, t) for i, t in rows if not brute_hits(t, [x for x in items if x[1]])[1])
    assert 0 < sum(want.values()) < len(rows)
    assert got.columns == docs.columns and Counter((r.doc_id, r.text) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Sort"))


def test_windows_of_many_items_are_tried_some_at_a_time():
    n = 400_000
    q = decontaminate.queries(((1, " ".join(f"w{k % 1000}" for k in range(n)).encode()),))
    shard = decontaminate.Shard(q, *decontaminate._postings(pa.array(["w5 w6 w7"])))
    tracemalloc.start()
    assert not len(shard.rarest(q))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6  # 13 counts of 8 bytes for each of all windows would be 42 MB


def test_spark_sends_small_batches(spark):
    """A task's rows went to Python in one batch, of which JVM and worker held several copies: over 3000 MB in an executor that near-dedup had filled."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([batch.column(1).buffers()[2].size] * batch.num_rows, pa.int64())], names=["id", "size"])  # a part's buffer is that of the batch it was sent in

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("x"), F.when(F.col("id") == 77, 9_000_000).otherwise(3000)).alias("text"))
    got = common.in_batches(docs, run, "id long, size long").collect()
    assert sorted(r.id for r in got) == list(range(6000))
    assert sum(r.size > 8 << 20 for r in got) < 1500  # only those sent with the long row
    assert spark.conf.get(name) == before


def test_scans_take_some_texts_at_a_time():
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"v{k}" for k in range(5000)], k=4000)) + f' token = "{k:020}" ' for k in range(90)] + [None, "", "a" * 700_000 + " AKIA" + "B" * 16]
    weights = np.zeros((secrets.WIDTH, 3))
    weights[0, crf.OUTSIDE], weights[19, crf.BEGIN] = 1, 9
    model = secrets.Model(crf.Model(weights, np.zeros((3, 3))), secrets.surprise(np.zeros((27, 27), np.int64)))
    tracemalloc.start()
    got = secrets.scan(model, pa.array(texts[:-1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(t or "") for t in texts[:-1]) > 2e6 and peak < 90e6  # 196 MB when all were taken at once
    got += secrets.scan(model, pa.array(texts[-1:]))
    assert got == secrets.scan(model, pa.array(texts)) == [s for t in texts for s in secrets.scan(model, pa.array([t], pa.string()))]
    assert [[s for s in spans if s[2] < 3] for spans in got] == [secrets.base_spans(t or "") for t in texts] and all(got[:90])
    assert secrets.scan(model, pa.array([], pa.string())) == []
