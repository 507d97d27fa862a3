"""Token records, packing and byte-level BPE against the libraries, one text at a time."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from crestline.llm import bpe, packing, records, unibytes

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, part string, start string"
ODD = ["", None, " ", "  a  b ", "a\n\nb  c\t d", "don't it's  \n x", "x ", "é,ü. ß.. a's, \r\n b\x1cc d\x85e", "a　b    c", "<|endoftext|> a 👍🏽 b" * 3, "\n\na b\n", "word " * 6000, "x" * 5000, "a, b.c,. d,,. 12,3. \n \n"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "p", "s") for i, t in enumerate(ODD)]
    rows += [(3, "again", "p", None), (3, "again", "p", None), (None, "no id", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoder_equals_the_library(plain):
    r = random.Random(5)
    texts = ["".join(r.choice(" \n\tab,.'s1é 　👍") for _ in range(r.randint(0, 30))) for _ in range(4000)]
    encoder = bpe.CachedEncoder(bpe.json_encoder(JSON).tokenizer)
    assert [x.tolist() for x in encoder.encode_list(texts)] == [plain(t) for t in texts]


def test_crc32c_known_values():
    for data, want in ((b"123456789", 0xE3069283), (bytes(32), 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43)):
        padded = np.frombuffer(data, np.uint8)
        assert records.crc32c(padded, np.array([0]), np.array([len(data)])).tolist() == [want]


def test_records(spark, docs, plain, tmp_path):
    got = [tuple(r) for r in records.token_records(docs, JSON).collect()]
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(text), 0]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda x: (x[1],)
    assert sorted(got, key=key) == want


def test_records_shuffled_and_damaged(spark, docs, plain, tmp_path):
    manifest = records.write_sequences(docs, str(tmp_path / "r"), JSON)
    a = [(r.doc_id, r.ids) for r in records.read_shuffled(manifest, 1).orderBy("order").collect()]
    b = [(r.doc_id, r.ids) for r in records.read_shuffled(manifest, 2).orderBy("order").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert a != b and sorted(a, key=key) == sorted(b, key=key)
    assert sorted(a, key=key) == sorted([(r.doc_id, [*plain(r.text), 0]) for r in docs.collect()], key=key)
    data, _ = records.frame([7], np.array([1, 2, 0]), np.array([0, 3]), 2)
    assert records.unframe(data)[0] == [7]
    for at in (0, 9, 14, 30, len(data) - 1):
        with pytest.raises((ValueError, OverflowError)):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_packing(docs, plain):
    rows = [r.asDict() for r in packing.pack_documents(docs, JSON, capacity=64, piece=16, bundle=640).collect()]
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*plain(r.text), 0])
    assert by_doc.keys() == texts.keys()
    for doc_id, all_ids in texts.items():
        (ids, *others) = all_ids
        if others:
            assert sum(r["length"] for r in by_doc[doc_id]) == sum(map(len, all_ids))
            continue
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_those_of_the_differencing(seed):
    r = random.Random(seed)
    sizes = [b - a for _ in range(r.choice([1, 2, 17, 900])) for a, b in packing.halves(0, r.randint(1, 1023), 16)]
    windows = packing.pack(sizes, 1024)
    assert all(0 < sum(sizes[i] for i in own) <= 1024 for own in windows)
    assert sorted(i for own in windows for i in own) == list(range(len(sizes)))
    assert windows == packing.difference(sizes, len(windows))
    # every smaller count has a window over capacity
    fewest = -(-sum(sizes) // 1024)
    assert all(max(sum(sizes[i] for i in own) for own in packing.difference(sizes, k)) > 1024 for k in range(fewest, len(windows)))
    assert len(windows) <= fewest + 1 + fewest // 50


def test_special_token_strings_are_encoded_like_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "a <|endoftext| b", "<|endoftext|> " * 50]
    got = bpe.json_encoder(JSON).encode_list(texts + ["plain words"])
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts + ["plain words"]]


def test_memory_is_bounded_and_changes_nothing():
    small = bpe.CachedEncoder(bpe.json_encoder(JSON).tokenizer)
    for memory in (small.inner, small.head, small.tail):
        memory.limit = 2000
    r = random.Random(5)
    words = ["".join(r.choices("abcXYZ'é.-", k=r.randint(1, 9))) for _ in range(300)] + ["-" * 5000, "x" + "-" * 5000]
    for _ in range(5):
        texts = [" ".join(r.choices(words, k=60)) for _ in range(20)]
        assert [x.tolist() for x in small.encode_list(texts)] == [small.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(m.size < m.limit + 600 and all(len(x) <= bpe.MAX_KEPT_CHARS for x in (*m.young, *m.old)) for m in (small.inner, small.head, small.tail))


def test_lookups_follow_distinct_words_not_what_surrounds_them():
    class Counted(bpe.Memory):
        asked = 0

        def get(self, stretch):
            self.asked += 1
            return super().get(stretch)

        def get_all(self, stretches):
            self.asked += len(stretches)
            return super().get_all(stretches)

    encoder = bpe.CachedEncoder(bpe.json_encoder(JSON).tokenizer)
    encoder.inner, encoder.head, encoder.tail = Counted(), Counted(), Counted()
    r = random.Random(3)
    words = ["".join(r.choices("abcdeéßñ", k=5)) for _ in range(200)]
    ends = ["", ".", ",", "!", "?)", "...", "'"]
    texts = ["".join(r.choice(words) + r.choice(ends) + r.choice("  \n") for _ in range(999)) + "x" for _ in range(9)]
    assert [x.tolist() for x in encoder.encode_list(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.inner.asked + encoder.head.asked <= 2 * len(words) + 2 and encoder.tail.asked <= 3 * len(ends)


def test_odd_characters_beside_words_lines_and_ends():
    odd = ["a", "Zed", "é", "\u00d7", "\u00f7", "\u00b5", "\u024f", "\u0250", "\u00a0", "\u3000", "\u0301", "中", "\0", "\x1c", "\t", "\r", " ", " ", "\n", ".", "'", "'s", "'ll", "$$", "12", "<|endoftext|>"]
    r = random.Random(8)
    for encoder in (bpe.json_encoder(JSON), bpe.ranks_encoder(RANKS, P.PATTERN)):
        for _ in range(150):
            some = [*r.sample(odd, r.randint(2, len(odd))), "word", " ", " "]
            texts = ["".join(r.choices(some, k=r.choice([0, 1, 2, 3, 8, 40]))) for _ in range(9)]
            assert [x.tolist() for x in encoder.encode_list(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe(spark, docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha(own.decode_bytes(ids))))
    assert sorted(map(str, map(tuple, unibytes.round_trip(docs, RANKS, P.PATTERN).collect()))) == sorted(map(str, want))
    encoded = unibytes.encode_documents(docs, RANKS, P.PATTERN)
    back = {r.doc_id: r.text for r in unibytes.decode_documents(encoded, RANKS, P.PATTERN).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if i != 3)
    for r in encoded.collect():
        assert r.offsets == np.cumsum([0, *(len(own.decode_single_token_bytes(i)) for i in r.ids)])[:-1].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert records.token_records(none, JSON).count() == 0
    assert packing.pack_documents(none, JSON).count() == 0
    assert unibytes.round_trip(none, RANKS, P.PATTERN).count() == 0
