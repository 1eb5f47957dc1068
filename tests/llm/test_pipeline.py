import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestock.llm.mixing import first_words, mixed_documents
from lodestock.llm.quality import score_quality, train
from lodestock.llm.secrets import redacted
from lodestock.llm.similar import one_of_each
from tests.llm.test_quality import make
from tests.llm.test_similar import slow_groups


def test_first_words():
    assert first_words(" a  bé\x0bc d ", 2) == " a  bé" and first_words("a b", 2) == "a b" and first_words("a b ", 1) == "a"


def test_mixed_rows(spark):
    rng = random.Random(1)
    rows = [(k, " ".join("w" * rng.randrange(1, 5) + str(k) for _ in range(rng.choice([0, 3, 50, 400]))), rng.choice(["a", "b", None])) for k in range(90)]
    rows += [(5, rows[5][1], rows[5][2]), (None, "x y z", "b"), (None, "x y z", "b"), (95, None, "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = mixed_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in got)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * total) <= 3
    texts = {(i, t) for i, t, _ in rows}
    assert sum((r.doc_id, r.text) not in texts for r in got) <= 3
    assert all(any(j == r.doc_id and (t or "").startswith(r.text) for j, t, _ in rows) for r in got)
    assert mixed_documents(docs.limit(0)).count() == 0


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    kinds = [rng.choice([0, 1, 2, 2, 2]) for _ in range(260)]
    rows = [(k, make(rng, kind)) for k, kind in enumerate(kinds)]
    rows[20] = (20, rows[20][1] + " password=hunter2222 end")
    rows += [(300 + k, rows[k][1]) for k in range(0, 60, 3)] + [(None, rows[2][1]), (400, None), (401, ""), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "more") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    labels = spark.createDataFrame([(k, int(kinds[k] != 1), int(kinds[k] == 0)) for k in range(0, 260, 2)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    quality, near, secrets, mixture, packing = (f for _, f in corpus_pipeline.STAGES)
    key = lambda r: tuple(map(str, r))
    one = quality(spark, docs, str(tmp_path))
    scored = score_quality(docs, train(docs, labels)).collect()
    assert sorted(map(key, one.collect())) == sorted(key(r[:6]) for r in scored if r._kept)

    two = near(spark, one, str(tmp_path))
    held = one.collect()
    known = [r for r in held if r.doc_id is not None]
    component, _ = slow_groups([r.text or "" for r in known])
    first = {}
    for r, c in zip(known, component, strict=True):
        first[c] = min(first.get(c, r.doc_id), r.doc_id)
    assert sorted(str(r.doc_id) for r in two.collect()) == sorted([*map(str, first.values()), *("None" for r in held if r.doc_id is None)])
    assert two.columns == docs.columns

    three = secrets(spark, two, str(tmp_path))
    want = {r.doc_id: None if r.text is None else redacted(r.text) for r in two.collect()}
    assert {r.doc_id: r.text for r in three.collect()} == want and three.columns == docs.columns

    four = mixture(spark, three, str(tmp_path))
    n_words = sum(len((r.text or "").split()) for r in three.collect())
    assert abs(sum(len(r.text.split()) for r in four.collect()) - 1.5 * n_words) <= 3 and four.columns == docs.columns

    rows = packing(spark, four, str(tmp_path)).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(len(plain.encode(r.text or "").ids) + 1 for r in four.collect())
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == lengths

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mark = lambda r: (str(r.doc_id), r.start, r.length, r.ids_crc32)
    assert sorted(map(mark, whole)) == sorted(map(mark, rows))
    assert zlib.crc32(np.array([0], "<u4").tobytes()) == 558161692


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert one_of_each(docs).count() == 0
