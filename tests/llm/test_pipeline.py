import re

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_near import brute
from test_tokens_packing_decontamination import brute as hits

import corpus_pipeline
from quillstone.llm.tokens import Ids

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def test_run_as_brute_force(spark, tmp_path):
    text = lambda a, n, step=1: " ".join(WORDS[(a + i * step * (1 + i // 7)) % 20] for i in range(n))
    item = text(3, 14, 3)
    docs = [(0, None), (1, ""), (2, "123 456"), (3, text(1, 60)), (4, text(1, 60) + " end"), (5, text(2, 90, 7) + " " + item + " " + text(5, 20, 3)), (6, item + " x"), (7, text(4, 30, 9) + " mail joe@x.org or 4041894974608795"), (9, text(9, 3000, 11))]
    table = pa.table({"doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "lang": ["en" if d % 2 else None for d, _ in docs], "source": ["s"] * len(docs), "n_chars": [len(t or "") for _, t in docs]})
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [item, "not there at all"]}), tmp_path / "benchmark.parquet")
    stage, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), table.column_names
    kept = [stage := f(spark, stage, str(tmp_path)) for _, f in corpus_pipeline.STAGES[:-1]]
    assert all(k.columns == columns for k in kept)
    language, near, clean, private = [{r.doc_id: r for r in k.collect()} for k in kept]
    assert sorted(language) == [3, 4, 5, 6, 7, 9]
    assert sorted(near) == sorted({c for _, c, _ in brute([(d, t) for d, t in docs if d in language])}) == [3, 5, 6, 7, 9]
    marked = {d: n / w for d, w, n, _ in hits([(d, t) for d, t in docs if d in near], [(1, item)], 10)}
    assert sorted(clean) == sorted(d for d, share in marked.items() if share <= 0.5) == [3, 5, 7, 9]
    assert item not in clean[5].text and clean[5].n_chars == len(clean[5].text) and clean[3].text == docs[3][1]
    assert not re.search("joe@|4041894974608795", private[7].text) and private[9].text == docs[-1][1]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Ids(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {d: len(ids.encode(r.text)) // 4 + 1 for d, r in private.items()}
    assert {d: sum(r.length for r in rows if r.doc_id == d) for d in private} == lengths
    assert len({r.sequence_id for r in rows}) == -(-sum(lengths.values()) // 2048)


def test_lettered_documents_stay_without_labels(spark):
    rows = [(1, "plain text", None), (2, "日本", None), (3, "123 !!", None), (4, "", None), (5, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, frame, "").collect()) == [1, 2]


def test_clashing_columns_repeated_ids_and_no_rows(spark, tmp_path):
    """Columns with the names of the operators' own pass through; rows of one id stay apart unless they are near copies; no rows give none."""
    names = ["score", "lang_pred", "label", "copies", "class_id", "hit_spans", "clean_text", "keep", "surrogate_text", "N_Entities", "n", "piece", "__q_found"]
    text = lambda a: " ".join(WORDS[(a + i * (1 + i // 7)) % 20] for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (1, text(5)), (2, text(9) + " joe@x.org"), (None, text(13))]
    columns = {"doc_id": [d for d, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), **{c: [f"{c}-{d}" for d, _ in rows] for c in names}}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
    got = sorted(stage.collect(), key=lambda r: str(r.doc_id))
    assert [r.doc_id for r in got] == [1, 1, 2, None]
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in names)
    assert "joe@" not in got[2].text and {got[0].text, got[1].text} == {text(1), text(5)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {1, 2, None}
    pq.write_table(pa.table(columns).slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
