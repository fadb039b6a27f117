"""The pipeline against what its operators say about its stages' own inputs."""

from collections import Counter

import corpus_pipeline
from tests.llm.fixtures import SMALL, odd_documents
from tracemill.llm import language, mixing, quality, simhash


def in_a_language(docs):
    """By a loop over sizes: the cosine against a share of the hundredth part of the learning documents of that size."""
    scored = docs.select("doc_id", "lang", language.held_out(docs.doc_id).alias("held"), language.predictions(docs).alias("p")).collect()
    least = {}
    for size in {r.p["size"] for r in scored}:
        cosines, lower = [], size
        while len(cosines) < language.SUPPORT and lower >= 0:
            cosines += [r.p.score for r in scored if r.p["size"] == lower and not r.held and r.lang == r.p.lang_pred]
            lower -= 1
        cells = sorted(int(min(c, 0.9999) * language.CELLS) / language.CELLS for c in cosines)
        enough = len(cells) >= language.SUPPORT
        least[size] = max(language.LEAST_SCORE, language.NEAR * cells[int(language.UNLIKE * len(cells))]) if enough else language.LEAST_SCORE
    return [r for r in scored if r.p.lang_pred != "und" and r.p.score >= least[r.p["size"]]]


def test_every_stage_acts_on_what_the_one_before_kept(spark, tmp_path):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs, expected = documents, {
        "quality rules": lambda d: Counter(r.doc_id for r in quality.judge(d, labels).where("kept").collect()),
        "language ID": lambda d: Counter(r.doc_id for r in in_a_language(d)),
        "SimHash near-dedup": lambda d: Counter({r.component_id for r in simhash.near_duplicates(d).collect()}),
        "mixing sources to target weights": lambda d: Counter({r.doc_id: r.taken // r.size for r in mixing.mix(d).where("size > 0").collect()}),
        "byte-level BPE encoding and decoding": lambda d: Counter(r.doc_id for r in d.collect()),
    }
    assert [name for name, _ in corpus_pipeline.STAGES] == list(expected)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == documents.columns
        assert Counter(r.doc_id for r in after.select("doc_id").collect()) == +expected[name](docs)
        docs = after
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.columns == docs.columns and sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() <= docs.count() * 2
        assert stage(spark, docs.limit(0), SMALL).count() == 0
