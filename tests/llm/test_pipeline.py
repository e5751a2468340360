import math

import zstandard
from pyspark.sql import functions as F
from tests.llm.helpers import edge_docs
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import plain as plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from docengine.llm import mixing, ngram_join, quality
from docengine.llm.queries import tokenizer_path


def expected(rows):
    """(doc_id, source, tokens) of the pipeline's result, each as often as it is taken."""
    pack = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rows = [(k, s, t) for k, s, t in rows if quality.measure(t, pack)[6]]
    told = plain_lines([(k, t) for k, _, t in rows])
    rows = [(k, s, text) for (k, s, _), (n, exact, near, text) in zip(rows, told) if not exact + near or exact + near < n]
    groups = plain_groups([(k, t) for k, _, t in rows])
    rows = [r for r in rows if groups[r[0]][1] == r[0]]
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    share = targets(sizes)
    import hashlib

    tokenizer, out = Tokenizer.from_file(tokenizer_path()), []
    for k, s, t in rows:
        rate = float(share[s]) / sizes[s]
        coin = int(hashlib.md5(f"{mixing.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        copies = math.floor(rate) + (coin < rate - math.floor(rate))
        out += [(k, s, tuple(tokenizer.encode(t, add_special_tokens=False).ids))] * copies
    return sorted(out)


def test_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.source, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == expected(rows)
    assert len(got) > 0


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_good_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").join(docs, "doc_id").where(F.size(F.split("text", r"\s+")) >= 50)
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert good.join(kept, "doc_id", "left_anti").count() == 0


def test_edges(spark, sf_dir):
    df = edge_docs(spark)
    for extra in ("kept", "line_dedup", "ngram_join", "token_ids", "rate"):
        docs = df.withColumnRenamed("size", extra)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf_dir).count() == 0
        stage(spark, df, sf_dir).collect()


def test_groups_stage_writes_few_files(spark, sf_dir):
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        kept = corpus_pipeline.one_of_near_copies(spark, docs, sf_dir)
        assert kept.rdd.getNumPartitions() <= ngram_join.FILES * spark.sparkContext.defaultParallelism < 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quality_rules_move_texts_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = corpus_pipeline.quality_rules(spark, docs, sf_dir)._jdf.queryExecution()
    rows = plan.toRdd().count()
    node = plan.executedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    moved = {k: node.metrics().apply(k).value() for k in ("pythonDataSent", "pythonDataReceived")}
    size, kept = (t.agg(F.sum(F.octet_length("text"))).first()[0] for t in (docs, corpus_pipeline.quality_rules(spark, docs, sf_dir)))
    assert 0 < rows < docs.count()
    assert size < moved["pythonDataSent"] < 1.3 * size
    assert kept < moved["pythonDataReceived"] < 1.3 * kept


def test_quality_rules_keep_any_columns(spark, sf_dir):
    more = ("1 as kept", "doc_id as `a.b`", "array(doc_id) as ids", "named_struct('ratio', lang) as of")
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").union(edge_docs(spark).drop("size")).selectExpr("*", *more)
    pack = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    out = corpus_pipeline.quality_rules(spark, df, sf_dir)
    assert out.schema == df.schema
    assert sorted(out.collect(), key=str) == sorted((r for r in df.collect() if quality.measure(r.text, pack)[6]), key=str) != []
