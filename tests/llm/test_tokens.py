import random
import zlib
from array import array

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from edges import TEXTS, edge_docs  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from topicspark.llm import bpe, packing  # noqa: E402

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "   ", "\n", "\t", "é", "É", "ß", "'s", "'LL", "123", "½", "日本", "😀", "<|endoftext|>", "<|", "\x00", "\x1c", "\x85",
         "…", "--", "aaaa", "the", " The", "İ", "Σ", "ﬁ", "\xa0", "٣", "é", "<|startoftext|>"]


def random_texts(n):
    rng = random.Random(9)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_texts_equal_the_library():
    library = Tokenizer.from_file(BYTES)
    _, words, decoder = bpe.encoder(BYTES)
    texts = random_texts(1500) + [t or "" for _, t in TEXTS] + ["".join(random.Random(1).choices("abcdefgh ", k=20_000)), "q" * 5_000]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        packed = words.packed(text)
        assert array("I", packed).tolist() == ids, repr(text[:60])
        assert decoder.texts([packed]) == [library.decode(ids, skip_special_tokens=False)]
    packed = [words.packed(t) for t in texts]
    assert decoder.texts(packed) == [decoder.texts([p])[0] for p in packed]
    assert decoder.texts([]) == [] and decoder.texts([b"", b""]) == ["", ""]


def test_word_ids_equal_the_library():
    library, store = Tokenizer.from_file(WORDS), packing.word_store(WORDS)
    for text in random_texts(1500) + [t or "" for _, t in TEXTS]:
        assert array("I", store.packed(text)).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:60])


def test_a_full_store_starts_again():
    _, words, _ = bpe.encoder(BYTES)
    was, words.limit = words.limit, 3
    try:
        text = "one two three four five six seven one two three"
        assert array("I", words.packed(text)).tolist() == Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    finally:
        words.limit = was


def test_every_token_stands_for_itself():
    prefix = bpe.encoder(BYTES)[0]
    for t, text in list(prefix.token.items())[::37]:
        assert prefix.ids(text) == [t]


def test_encode_rows(spark):
    library = Tokenizer.from_file(BYTES)
    out = bpe.encode(edge_docs(spark), BYTES, decode=True)
    got = sorted(((r["doc_id"], array("I", bytes(r["ids"])).tolist(), r["decoded"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in TEXTS), key=repr)
    assert bpe.encode(edge_docs(spark).limit(0), BYTES).count() == 0


@pytest.mark.parametrize("last", [True, False])
def test_packing_covers_every_id_once_without_padding(last):
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.randint(1, rng.choice([3, 300, 5_000])) for _ in range(rng.randint(0, 40))]
        sequences, wait = packing.pack(lengths, (64, 16, 8), last)
        pieces = sorted([p for s in sequences for p in s] + wait)
        at = [0] * len(lengths)
        for doc, start, n in pieces:
            assert n > 0 and start == at[doc]
            at[doc] += n
        assert at == lengths
        sizes = [sum(p[2] for p in s) for s in sequences]
        assert all(x <= 64 and x & (x - 1) == 0 for x in sizes)
        assert sum(p[2] for p in wait) < (1 if last else 64)
        assert max(packing.step_groups(sequences, 256), default=0) <= max(1, sum(sizes) // 128)


def test_packed_rows(spark):
    library = Tokenizer.from_file(WORDS)
    docs = edge_docs(spark, [t for t in TEXTS if t[0] is not None and t[0] != 6]).repartition(3)
    rows = packing.pack_documents(docs, WORDS, 1, pool_tokens=3_000).collect()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, t in TEXTS:
        if i is None or i == 6:
            continue
        ids, at = library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(array("I", part).tobytes()))
            at += r["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and len({x["step_group"] for x in s}) == 1
            at += r["length"]
        assert at == s[0]["sequence_tokens"] and at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0), WORDS, 1).count() == 0
