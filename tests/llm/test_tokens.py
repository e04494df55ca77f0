"""Operators 3, 4 and 6 against the tokenizer libraries."""

import base64
import bisect
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from rasterloom.llm.bpe import Codec, read_ranks  # noqa: E402
from rasterloom.llm.op3_bpe_codec import decode_documents, encode_documents, op3_bpe_codec, round_trip  # noqa: E402
from rasterloom.llm.op4_token_records import frame, frames, op4_token_records, read_records, shuffled_read, with_starts, write_records  # noqa: E402
from rasterloom.llm.op6_best_fit_packing import CapacityTree, best_fit_decreasing, op6_best_fit_packing, pack_documents  # noqa: E402
from rasterloom.llm.shared import fresh_dir  # noqa: E402


RANKS, TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return Codec(read_ranks(RANKS), PATTERN)


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ALPHABET = st.text(st.sampled_from(list("abcthe nd'sréß0129.,|\n\t  \x1c😀語")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(text=ALPHABET)
def test_codec_is_tiktoken(codec, tiktoken_ids, text):
    ids = np.frombuffer(codec.encode([text])[0], "<u4").tolist()
    assert ids == tiktoken_ids(text) and codec.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(text=ALPHABET)
def test_chunks_are_the_library(library_ids, text):
    from rasterloom.llm.op4_token_records import encoder

    assert np.frombuffer(encoder(TOKENIZER).encode([text])[0], "<u4").tolist() == library_ids(text)


def test_long_pieces(codec, tiktoken_ids):
    for piece in ("ab" * 4000, "aaaa" * 500, "thequick" * 300):
        assert np.frombuffer(codec.encode([piece])[0], "<u4").tolist() == tiktoken_ids(piece)


def test_round_trip_query(spark, data, texts, tiktoken_ids):
    rows = op3_bpe_codec(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tiktoken_ids(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_odd_rows(odd, none_of, tiktoken_ids):
    encoded = encode_documents(odd, RANKS, PATTERN)
    rows = encoded.collect()
    assert len(rows) == odd.count() and {tuple(r["ids"]) for r in rows if r["doc_id"] == 10} == {tuple(tiktoken_ids(next(r["text"] for r in odd.collect() if r["doc_id"] == 10)))}
    assert sorted(bytes(r["decoded"]) for r in decode_documents(encoded, RANKS, PATTERN).collect()) == sorted((r["text"] or "").encode() for r in odd.collect())
    assert round_trip(none_of, RANKS, PATTERN).count() == 0 and encode_documents(none_of, RANKS, PATTERN).count() == 0


def test_records_query(spark, data, texts, library_ids):
    got, start = {r["doc_id"]: r for r in op4_token_records(spark, data).collect()}, 0
    assert len(got) == len(texts)
    for d in sorted(texts):
        ids = library_ids(texts[d]) + [2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_record_files(spark, odd, none_of, library_ids):
    path = fresh_dir(spark, "test-records")
    write_records(odd, path, TOKENIZER)
    records = read_records(spark, path).collect()
    want = sorted(np.array(library_ids(r["text"]) + [2], "<u4").tobytes() for r in odd.collect())
    assert sorted(bytes(r["ids"]) for r in records) == want
    ids = [r["doc_id"] for r in sorted(records, key=lambda r: (r["file"], r["record"]))]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    names = [r["name"] for r in spark.read.parquet(f"{path}/manifest").collect()]
    assert sorted(x.tobytes() for n in names for _, x in shuffled_read(path, n, 5)) == want
    empty = fresh_dir(spark, "test-records")
    write_records(none_of, empty, TOKENIZER)
    assert with_starts(read_records(spark, empty), spark.read.parquet(f"{empty}/manifest")).count() == 0


def test_damage_is_seen():
    data = frame(b"payload") + frame(b"more")
    assert list(frames(io.BytesIO(data))) == [b"payload", b"more"]
    for at in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(frames(io.BytesIO(bytes(broken))))
    with pytest.raises(ValueError):
        list(frames(io.BytesIO(data[:-3])))


def test_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    with pytest.raises(ValueError):
        write_records(docs, fresh_dir(spark, "test-records"), TOKENIZER, end_id=1 << 16)
    wide = fresh_dir(spark, "test-records")
    write_records(docs, wide, TOKENIZER, end_id=1 << 16, width=4)
    assert np.frombuffer(read_records(spark, wide).first()["ids"], "<u4")[-1] == 1 << 16


def test_memories_are_bounded():
    from rasterloom.llm.bpe import Chunks

    seen = []
    chunks = Chunks(lambda new: seen.append(len(new)) or [x.encode() for x in new], remembered=1 << 20)
    texts = [" ".join(f"w{(i * 37 + j) % 9000}" for j in range(300)) + " " + "x" * 5000 for i in range(200)]
    for t in texts:
        assert chunks.encode([t]) == [t.encode()]
    for m in (chunks.after_space, chunks.whole):
        assert m.size <= m.most // 2 and max(map(len, [*m.young, *m.old, ""])) <= 64
        assert sum(len(k) + len(v) for d in (m.young, m.old) for k, v in d.items()) < 1 << 20
    assert sum(seen) < 60_000


def bins_of(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    free, bins = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        left = free.pop(i) if i < len(free) else capacity
        bins += left == capacity
        if left > n:
            bisect.insort(free, left - n)
    return bins


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.choice([7, 16, 50, 1024])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, max(1, capacity // 5)) for _ in range(rng.randint(0, 400))]
        counts = [0] * (capacity + 1)
        for n in lengths:
            counts[n] += 1
        plan, bins = best_fit_decreasing(counts, capacity)
        assert bins == bins_of(lengths, capacity)
        used: dict[int, list[tuple[int, int]]] = {}
        for length in range(1, capacity + 1):
            own = [r for r in plan.tolist() if r[0] == length]
            for rank in range(counts[length]):
                row = max((r for r in own if r[1] <= rank), key=lambda r: r[1])
                step, nth = divmod(rank - row[1], row[3])
                used.setdefault(row[2] + step, []).append((row[4] + nth * length, length))
        assert len(used) == bins
        for pieces in used.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity


def test_capacity_tree():
    t = CapacityTree(10)
    t.add(4, 2), t.add(9, 1)
    assert [t.tightest(n) for n in (1, 4, 5, 9, 10)] == [4, 4, 9, 9, None]
    t.add(4, -2)
    assert t.tightest(1) == 9


def check_packing(rows, ids_of):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for d, ids in ids_of.items():
        at = 0
        for k, p in enumerate(sorted(by_doc[d], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at) and p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes()) and (not k or p["length"] == 1024)
            at += p["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_seq) == bins_of([r["length"] for r in rows], 1024)


def test_packing_query(spark, data, texts, library_ids):
    check_packing(op6_best_fit_packing(spark, data).collect(), {d: library_ids(t) + [2] for d, t in texts.items()})


def test_packing_odd_rows(odd, none_of, library_ids):
    rows = pack_documents(odd, TOKENIZER).collect()
    check_packing(rows, {10: library_ids(next(r["text"] for r in odd.collect() if r["doc_id"] == 10)) + [2]})
    assert sum(r["length"] for r in rows) == sum(len(library_ids(r["text"])) + 1 for r in odd.collect())
    assert pack_documents(none_of, TOKENIZER).count() == 0


def test_plain_words_go_to_the_model(monkeypatch):
    """Words of letters with marks are not searched for pretokens, and get the ids that the library gives for them in a text."""
    import public_tokenizers
    import tokenizers

    from rasterloom.llm.op4_token_records import encoder

    path, searched = public_tokenizers.path("byte_bpe_50k.json"), []
    whole = tokenizers.Tokenizer.from_file(path)

    class Watched:
        def __init__(self):
            self.of = tokenizers.Tokenizer.from_file(path)

        def __getattr__(self, name):
            return getattr(self.of, name)

        def encode_batch_fast(self, texts, **how):
            searched.extend(texts)
            return self.of.encode_batch_fast(texts, **how)

    plain = [" word", " Wörter,", "Straße", "\nÀ!?", " a$$$", " it_", " END!!", " naïveté..."]
    odd = [" <b", " it's", " a'", " x1", " 12", " 日本語", "\n\n", " ", "<|endoftext|>", " a<|endoftext|>", " é", " ét", "a\x85b", " ×", " ªº"]
    with monkeypatch.context() as m:
        m.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda _, made=Watched(): made)}))
        made = encoder.__wrapped__(path)
    ids = lambda x: np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    assert made.encode_chunks(plain + odd) == [ids(x) for x in plain + odd]
    assert not any(x in text.split("\n") for text in searched for x in plain)
    texts = ["".join(plain) + "".join(odd), " ".join(plain), "\n".join(x.strip() for x in plain)]
    assert made.encode(texts) == [ids(x) for x in texts]
