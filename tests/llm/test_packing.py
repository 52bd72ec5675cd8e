"""Operator 8: ids, cuts, gapless sequences, few of them."""
import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cases import documents  # noqa: F401
from codeaudit.llm import packing
from codeaudit.llm.packing import encode_words, evolve, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


encode = functools.partial(encode_words, path=PATH)


TOKENIZER = Tokenizer.from_file(PATH)


def whole(t):
    return TOKENIZER.encode(t or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts():
    r = random.Random(2)
    odd = ["é", "é", "́", "İ", "ΑΣ", "ǅ", "don't", "'S", "<|endoftext|>", "<|startoftext|>x", "日本", "ÉTÉ.", "e\u0301", "ﬁn", "Ⅷ", "ΣΑΣ", "Ǆ", "ŉ", "K", "가각", "À", "STRASSE,", "ẞ!", "x--", "\xa0", "\x1c", " ", "a-b", "​", "🙂", "\x85", "12"]
    texts = ["".join(r.choice(odd + ["word", "Word.", " ", "\n", "\t", "  "]) for _ in range(r.randrange(0, 40))) for _ in range(400)]
    want = [whole(x) for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == want
    old = packing.GENERATION_BYTES
    packing.GENERATION_BYTES = 500
    try:
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == want
    finally:
        packing.GENERATION_BYTES = old


def test_forgotten_words_are_encoded_anew_and_used_ones_kept():
    words = packing._Words(PATH)
    old, packing.GENERATION_BYTES = packing.GENERATION_BYTES, 40_000
    try:
        for i in range(400):
            words.text(f"often W{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}q, zz{i}")
            assert "often" in words or "often" in words.older
            assert words.size < 42_000 and len(words) + len(words.older) < 500
    finally:
        packing.GENERATION_BYTES = old


def check(rows, got, length):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= length
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0, *[n for _, n in s[:-1]]]).tolist()
        assert s[-1][0] + s[-1][1] <= length
    for d, t in rows:
        ids = whole(t) + [1]
        mine = sorted(pieces[d], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in mine] == [
            (k, a, min(length, len(ids) - a)) for k, a in enumerate(range(0, len(ids), length))]
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in mine]
    return len(sequences), -(-sum(r.length for r in got) // length)


def test_partly_empty_sequences_of_all_blocks_are_merged(documents):
    """Equal sizes that never fill a sequence, and tiny ones that need larger blocks."""
    ids = lambda texts: [np.zeros(int(t) - 1, "<u4").tobytes() for t in texts]
    for size, n, most in ((30, 400, 135), (1, 900, 10), (7, 500, 38)):
        got = pack(documents([(i, str(size)) for i in range(n)]), ids, length=100, block_items=20, epochs=1).collect()
        assert len(got) == n and len({(r.sequence_id, r.offset) for r in got}) == n
        assert len({r.sequence_id for r in got}) <= most, (size, len({r.sequence_id for r in got}))


def test_packing(documents):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["tree", "house", "Extraordinary", "x1,"]) for _ in range(int(r.lognormvariate(3.5, 1.2))))) for i in range(900)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 5000), (1003, "a " * 255)]
    got = pack(documents(rows), encode, length=256, block_items=200).collect()
    n, least = check(rows, got, 256)
    assert n <= least * 1.02 + 1


def test_ids_edges_and_clashes(documents):
    rows = [(1, "one two three"), (2, "word " * 600)]
    docs = documents(rows).selectExpr("*", "1 as item", "2 as piece", "3 as raw", "4 as size")
    got = pack(docs, encode, length=500, with_ids=True).collect()
    joined = {d: [i for r in sorted(got, key=lambda r: r.piece) if r.doc_id == d for i in r.ids] for d in (1, 2)}
    assert joined == {d: whole(t) + [1] for d, t in rows}
    assert pack(documents([]), encode).count() == 0
    twice = pack(documents([(None, "a"), (None, "a"), (5, "a")]), encode).collect()
    assert len({r.sequence_id for r in twice}) == 1 and sorted(r.offset for r in twice) == [0, 2, 4]


def test_search_is_better_than_best_fit():
    """Triples that fill a sequence exactly, which best fit decreasing misses."""
    r = random.Random(3)
    size = []
    for _ in range(60):
        a, b = r.randrange(250, 500), r.randrange(260, 400)
        size += [a, b, 1000 - a - b]
    order = sorted(range(len(size)), key=lambda i: -size[i])
    plain = len(packing._pack(order, size, 1000))
    best = evolve(size, 1000, [], 1, 8, 40)[0]
    assert sorted(i for b in best for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= 1000 for b in best)
    assert 60 <= len(best) < plain
