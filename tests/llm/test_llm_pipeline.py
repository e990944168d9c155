import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_rows import SCHEMA, edge_documents, prose, row  # noqa: E402
from test_llm_dedup import brute_components, brute_repeats, split  # noqa: E402
from test_llm_text import brute_contaminated, expected, library  # noqa: E402,F401

import corpus_pipeline  # noqa: E402
from polyeval.llm import toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark, library):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
    rows = [(r.doc_id, r.text) for r in docs.collect() if score(r.text) < 0.5]
    roots = {d for d, _, c in brute_components(rows) if d == c}
    rows = [r for r in rows if r[0] in roots]
    texts = {}
    least = {}
    for d, t in sorted(rows):
        w = split(t)
        for i in range(len(w) - 49):
            least.setdefault(tuple(w[i:i + 50]), d)
    lost = {d: n for d, _, n, _ in brute_repeats(rows)}
    for d, t in rows:
        if not lost[d]:
            texts[d] = t
            continue
        w, gone = split(t), set()
        for i in range(len(w) - 49):
            if least[tuple(w[i:i + 50])] < d:
                gone |= set(range(i, i + 50))
        out, at = "", 0
        for i, x in enumerate(w):
            stop = t.index(x, at) + len(x)
            out += "" if i in gone else t[at:stop]
            at = stop
        if len(gone) < len(w):
            texts[d] = (out + t[at:]).strip()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {d for d, _ in brute_contaminated(texts.items(), items)}
    want = {d: expected(library, t) for d, t in texts.items() if d not in hit}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_take_edge_rows_and_empty_tables(spark):
    rows = edge_documents() + [row(90, prose(20, 30))]
    docs = spark.createDataFrame(rows, SCHEMA)
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
        assert last.count() == frame.count()
