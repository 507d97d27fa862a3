"""The pipeline's stages on a planted table, against the operators' brute-force rules."""

import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_neardup import words_set  # noqa: E402
from tests.llm.test_quality import brute as quality_brute  # noqa: E402
from tests.llm.test_quality import corpus  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "token = 0123456789abcdef0123456789abcdef"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows = [[i, t, "en", "src0", len(t)] for i, t, _ in corpus(160)]
    rows += [[200, rows[1][1], "en", "src0", 0], [201, rows[3][1] + " tail", "en", "src0", 0], [202, rows[5][1][:0] + " ".join(f"z{i}" for i in range(90)) + f" {KEY}", "en", "src1", 0], [203, None, "en", "src0", None], [204, "", None, None, 0]]
    for r in rows:
        r[4] = len(r[1]) if r[1] is not None else None
    spark.createDataFrame([tuple(r) for r in rows], COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in corpus(160)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {r[0]: r[1] for r in rows}


def test_stages(spark, folder, tmp_path):
    at, texts = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
    quality, near, secret, packed = seen
    good = {i for i, t in texts.items() if t and quality_brute(t)[0] >= 50 and 100 * quality_brute(t)[4] <= 50 * quality_brute(t)[0] and "#" not in t and "&" not in t and "|" not in t}
    assert {r.doc_id for r in quality.collect()} == good
    sets = {i: words_set(texts[i], 5) for i in good}
    stays = {i for i in good if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in good)}
    assert {r.doc_id for r in near.collect()} == stays and 200 not in stays and 201 not in stays
    clean = {r.doc_id: r for r in secret.collect()}
    assert set(clean) == stays and KEY not in clean[202].text and clean[202].n_chars == len(clean[202].text)
    assert all(clean[i].text == texts[i] for i in stays - {202})
    assert quality.columns == near.columns == secret.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    from crestline.llm import bpe
    import public_tokenizers

    encode = bpe.json_encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer.encode
    pieces = {}
    for r in packed.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == stays
    for i, own in pieces.items():
        ids = [*encode(clean[i].text, add_special_tokens=False).ids, 0]
        at_id = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at_id and r.ids_crc32 == zlib.crc32(np.array(ids[at_id : at_id + r.length], "<u4").tobytes())
            at_id += r.length
        assert at_id == len(ids)
    run = corpus_pipeline.run(spark, at)
    assert run.agg({"length": "sum"}).first()[0] == packed.agg({"length": "sum"}).first()[0]


def test_extra_columns_and_repeated_ids(spark, folder, tmp_path):
    at, texts = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    twice = docs.unionByName(docs.filter("doc_id IN (1, 202)"))
    names = ("gone", "gone_id", "node", "kept", "label", "quality", "anomaly", "file")
    twice = twice.selectExpr("*", *[f"cast(doc_id AS string) AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, twice, at).write.parquet(f"{tmp_path}/{name}")
        twice = spark.read.parquet(f"{tmp_path}/{name}")
        assert twice.columns == [*docs.columns, *names]
    rows = twice.collect()
    assert all(r.gone == r.gone_id == r.file == str(r.doc_id) for r in rows)
    assert sum(r.doc_id == 1 for r in rows) == sum(r.doc_id == 202 for r in rows) == 2  # a repeated id is no copy of itself
    assert corpus_pipeline.STAGES[-1][1](spark, twice, at).count() > 0


def test_run_leaves_only_its_result(spark, folder):
    from crestline.llm import storage

    at, _ = folder
    mark = len(storage.made)
    out = corpus_pipeline.run(spark, at)
    assert out.count() > 0 and len(storage.made) == mark + len(corpus_pipeline.STAGES)
    assert [storage.open_fs(p)[0].get_file_info(storage.open_fs(p)[1]).type.name for p in storage.made[mark:]] == ["NotFound"] * 3 + ["Directory"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
