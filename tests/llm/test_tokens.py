import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestock.llm.common import scratch
from lodestock.llm.dac import Segment, encode_segment, read_tokens, write_tokens
from lodestock.llm.packing import pack, shortest_pack_first
from lodestock.llm.tokens import Ids

HARD = ["", " ", "a", "  a  b\n\n c'd 'S İx ſ ¼3²", "x'S Y's 12 3\t\t4 <|endoftext|> __a -- b\x1cc", "\n\n", " a \n b \r\n", "a\n b", "a \nb ", "日本 語 ä ̈b", "hello <|endoftext|> world", "a<|startoftext|>b <|endoftext|><|ENDOFTEXT|> 日 c", "x  <|endoftext|>  y", "Éeauouon.\nEnpaeux $$$ x", "word " * 3000, "x" * 5000]
ROWS = [(5, HARD[3]), (2, None), (9, "word " * 3000), (2, "again"), (None, "no id"), (7, ""), (5, HARD[3]), (11, "hello <|endoftext|> world"), (12, "a <|startoftext|>b")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    path = public_tokenizers.path(name)
    plain, own = Tokenizer.from_file(path), Ids(path, kept=3)
    for sub in (HARD, [x for x in HARD if "  " not in x], []):
        flat, at = own.batch(pa.array(sub, pa.string()))
        for k, text in enumerate(sub):
            want = plain.encode(text, add_special_tokens=False).ids
            assert own(text).tolist() == want
            assert flat[at[k] : at[k + 1]].tolist() == want


def test_segment_gives_any_id():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, m, 700) for m in (2, 256, 65536, 2**32)] + [[0, 255, 256, 65535, 65536, 2**32 - 1]]).astype("<u4")
    rng.shuffle(ids)
    seg = Segment(encode_segment([3, None, 4], np.array([0, 1000, len(ids) - 1000]), ids))
    assert [seg[i] for i in range(len(ids))] == ids.tolist()
    assert seg.doc_ids == [3, None, 4] and len(seg) == len(ids)
    for i, j in [(0, 0), (0, 1), (511, 513), (512, 1024), (7, 2000), (0, len(ids)), (len(ids), len(ids))]:
        assert seg.ids(i, j).tolist() == ids[i:j].tolist()
    assert seg.doc(1).tolist() == ids[:1000].tolist()
    with pytest.raises(ValueError):
        encode_segment([1], np.array([1]), np.array([70000]), widths=(1, 1))
    with pytest.raises(ValueError):
        Segment(b"XXXX" + bytes(40))


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, start string, part string")


def test_written_tokens_read_back(spark):
    path, plain = public_tokenizers.path("word_bpe_49k.json"), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = scratch(spark, "t")
    got = read_tokens(spark, at, write_tokens(_docs(spark, ROWS), at, path, segment_ids=10)).collect()
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    at = scratch(spark, "t")
    assert read_tokens(spark, at, write_tokens(_docs(spark, []), at, path)).count() == 0


def test_packing_covers_every_id_once(spark):
    path, plain = public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [*ROWS, *((100 + k, "tie " * (k % 7)) for k in range(60))]
    got = pack(_docs(spark, rows), path, size=64).collect()
    want = sorted((i is not None, i or 0, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    whole = [(r.doc_id is not None, r.doc_id or 0, r.doc_tokens) for r in got if r.start == 0]
    assert sorted(whole) == want and sum(r.length for r in got) == sum(w[2] for w in want)
    ids = {r[0]: np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows if r[0] not in (2, None)}
    for r in got:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 64 and sorted(sequences) == list(range(len(sequences)))
    assert pack(_docs(spark, []), path).count() == 0


def test_shortest_pack_goes_first():
    placed, made = shortest_pack_first({6: 2, 5: 1, 3: 2, 1: 3}, 10)
    assert made == 3
    assert placed[:3] == [(6, 0, 2, 0, 0), (5, 0, 1, 2, 0), (3, 0, 1, 2, 5)]
    assert sum(p[2] for p in placed) == 8
    assert len(shortest_pack_first({k: 997 * k % 13 + 1 for k in range(1, 1025)})[0]) < 4096


def slow_packing(histogram, size):
    """One document at a time, the longest first, into the sequence with the most room left; what is left of a length that fits nowhere begins sequences. How full each sequence gets."""
    full = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = min(range(len(full)), key=full.__getitem__, default=None)
            if at is None or full[at] + length > size:
                full += [length] * left
                break
            full[at] += length
            left -= 1
    return sorted(full)


def test_packing_is_that_of_one_document_at_a_time():
    rng = np.random.default_rng(4)
    for size in (10, 64):
        for _ in range(20):
            histogram = {int(n): int(rng.integers(1, 9)) for n in rng.integers(1, size + 1, 12)}
            placed, made = shortest_pack_first(histogram, size)
            full = np.zeros(made, int)
            for length, _, count, first, offset in placed:
                assert (full[first : first + count] == offset).all()
                full[first : first + count] += length
            assert sorted(full.tolist()) == slow_packing(histogram, size)
            for length in histogram:
                ranks = sorted((rank, count) for n, rank, count, _, _ in placed if n == length)
                assert [r for r, _ in ranks] == np.cumsum([0, *(c for _, c in ranks)])[:-1].tolist() and sum(c for _, c in ranks) == histogram[length]


def test_a_table_of_one_id_is_dealt_out(spark):
    docs = _docs(spark, [*((7, f"text {k}") for k in range(40)), *((None, "same") for _ in range(40))]).repartition(4)
    at, path = scratch(spark, "one"), public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(docs, at, path)
    assert manifest.groupBy("part").sum("n_docs").count() > 1
    got = sorted(read_tokens(spark, at, manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and [r.doc_id for r in got] == [None] * 40 + [7] * 40


def test_packed_table_pads_as_little_as_the_rule(spark):
    rng = np.random.default_rng(3)
    docs = _docs(spark, [(k, "w " * int(rng.integers(0, 90))) for k in range(200)])
    got = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=64).collect()
    histogram = {}
    for r in got:
        histogram[r.length] = histogram.get(r.length, 0) + 1
    full = {}
    for r in got:
        full[r.sequence_id] = full.get(r.sequence_id, 0) + r.length
    assert sorted(full.values()) == slow_packing(histogram, 64)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cuts_are_looked_at_together(name, monkeypatch):
    """Only cuts that need the tokenizer go through _ids one at a time; the ids are the library's for all of them."""
    path = public_tokenizers.path(name)
    plain, own, asked = Tokenizer.from_file(path), Ids(path), []
    one_by_one = Ids._ids
    monkeypatch.setattr(Ids, "_ids", lambda self, text: asked.append(text.strip()) or one_by_one(self, text))
    signs = [f"{a}{chr(c)}{b}" for c in range(1, 0x180) if chr(c) not in " " for a, b in (("", ""), ("Ab", "cD"), ("Z", "'s"))]
    texts = ["The thedthshha, Éeauouon it's x9 ###", " ".join(signs), *signs, "ÀÉ İstanbul 日本 word\n", None]
    flat, at = own.batch(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids
    assert {"İstanbul", "日本"} <= set(asked) and not {"The", "it's", "thedthshha,", "Éeauouon", "###", "ÀÉ"} & set(asked)
