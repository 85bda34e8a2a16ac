import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from quadrille.llm import pieces, quality
from quadrille.llm import text as X
from tests.llm.test_operators import contaminated, edited, first_lines, prose, rows, similar, smith_waterman, words


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """A folder of documents and benchmark, and the documents' rows."""
    import pandas as pd

    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(30)
    own, items = contaminated(31)
    own = [(i, t) for i, t in own if i is not None]
    base = [(500 + i, prose(rng, 150)) for i in range(8)]
    own += base + [(600 + i, edited(rng, t, 0.05)) for i, t in base] + [(700, base[0][1]), (701, "An " * 400), (702, "a\nb\n" + base[1][1]), (703, None), (None, prose(rng, 60))]
    frame = pd.DataFrame({"doc_id": pd.array([i for i, _ in own], "Int64"), "text": [t for _, t in own], "lang": "en", "source": "s", "n_chars": [len(t or "") for _, t in own], "key": 1})
    frame.to_parquet(folder / "documents.parquet", index=False)
    pd.DataFrame({"item_id": [i for i, _ in items], "text": [t for _, t in items]}).to_parquet(folder / "benchmark.parquet", index=False)
    return str(folder), own, items


def brute(own, items):
    """The stages on lists of rows."""
    out = []
    kept = [d for d in own if d[1] is not None and not np.array([bad for _, bad in quality.verdict(quality.measure(*X.utf8(pa.array([d[1]]))))]).any()]
    out.append(kept)
    flags = first_lines(sorted(kept, key=lambda d: (d[0] is not None, d[0] or 0)))
    kept = [(i, "\n".join(x for x, f in zip(t.split("\n"), flags[(i, t)]) if f)) for i, t in kept]
    kept = [d for d in kept if d[1].replace("\n", "").strip(" \t\r")]
    out.append(kept)
    pairs, parent = similar([d for d in kept if d[0] is not None]), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    kept = [d for d in kept if d[0] is None or root(d[0]) == d[0]]
    out.append(kept)
    own_items = [words(t) for _, t in items if len(words(t)) >= 3]
    kept = [d for d in kept if not any(smith_waterman(w, words(d[1])) >= len(w) for w in own_items)]
    out.append(kept)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out.append([(i, library.encode(t)) for i, t in kept])
    return out


def test_every_stage_by_brute_force(spark, corpus, tmp_path):
    folder, own, items = corpus
    exp = brute(own, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        last = k == len(corpus_pipeline.STAGES) - 1
        assert last or docs.columns == columns
        got = [(r["doc_id"], list(r["ids"]) if last else r["text"]) for r in docs.collect()]
        assert sorted(map(str, got)) == sorted(map(str, exp[k])), name
        if not last:
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert len(own) > len(exp[0]) > len(exp[2]) > len(exp[3]) > 0


def test_the_whole_run(spark, corpus):
    folder, own, items = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(i), t) for i, t in brute(own, items)[-1])
    assert all(r["agrees"] and r["round_trip"] for r in got)


def test_no_documents(spark, corpus, tmp_path):
    folder = corpus[0]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert rows(corpus_pipeline.run(spark, str(tmp_path))) == []
