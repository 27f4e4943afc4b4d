"""The pipeline against its stages' brute-force versions, each on its own input."""

from collections import Counter

import brute
import corpus_pipeline
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from swathline.llm import queries
from swathline.session import cut_lineage


def test_stages(spark, folder, folder_rows):
    bench = folder_rows("benchmark", "item_id", "text")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
        after = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert set(after) <= set(before)
        elif name == "line_dedup":
            want = brute.without_boilerplate([(r[0], r[3], r[1]) for r in before])
            assert Counter((r[0], r[1]) for r in after) == Counter(want)
            assert all(r[4] == len(r[1]) for r in after)
        elif name == "ngram_jaccard":
            found = brute.jaccard_components([(r[0], r[1]) for r in before], 5, 80)
            assert Counter(after) == Counter(r for r in before if found[r[0]][1] == r[0])
        elif name == "decontaminate":
            bad = {r[0] for r in brute.decontaminated([(r[0], r[1]) for r in before], bench) if r[-1]}
            assert Counter(after) == Counter(r for r in before if r[0] not in bad)
        else:
            tokenizer = Tokenizer.from_file(queries.tokenizer_path())
            want = brute.pieces([(r[0], r[1]) for r in before], tokenizer)
            assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in docs.collect()} == want
        before = after
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(key).collect())) == Counter(map(tuple, docs.select(key).collect()))


def test_awkward_documents_pass_every_stage(spark, awkward, folder):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", F.col("n_chars").alias("line"))
    for _, stage in corpus_pipeline.STAGES:
        docs = cut_lineage(stage(spark, docs, folder))
    assert docs.filter("doc_id = 2").count() == 1
    empty = awkward.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut_lineage(stage(spark, empty, folder))
    assert empty.count() == 0


def test_registered():
    names = entry.queries()
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n[:2] == "op" and n[2].isdigit()} == set(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5
