import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchloom.llm.packing import CachedEncoder, HarmonicPacker, harmonic_pack, piece_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = CachedEncoder(PATH, limit=50)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="aB'sé É.,9 \n\tßÿ<|>", max_size=60)))
def test_cached_ids_are_the_tokenizers_own(text):
    assert ENCODER.encode(text) == array("I", TOKENIZER.encode(text, add_special_tokens=False).ids).tobytes()


def test_special_strings_and_all_plain_letters():
    for text in ("x <|endoftext|> y", "".join(map(chr, range(0x20, 0x7F))), " ".join(chr(c) for c in range(0xC0, 0x100)), "we're they'll 's'S I'M"):
        assert ENCODER.encode(text) == array("I", TOKENIZER.encode(text, add_special_tokens=False).ids).tobytes()


def test_byte_level_tokenizers_go_straight_through():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = CachedEncoder(path)
    assert not plain.by_word
    assert plain.encode("Hello there") == array("I", Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids).tobytes()


def test_pieces_fit_their_class():
    for rest in range(2048):
        pieces = piece_lengths(rest, 2048, 0.01)
        assert sum(pieces) == rest
        assert all(2048 // p * p >= 2048 * 0.98 or p < 3 or 2048 - 2048 // p * p < 2048 // p for p in pieces)


def check(pieces, capacity=2048):
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return [sum(n for _, n in own) for own in by.values()]


def test_every_id_lies_in_one_piece(spark, docs, awkward):
    rows = awkward + [(100 + i, "some more words " * (i * 7 % 300)) for i in range(80)]
    out = harmonic_pack(docs(rows), PATH).collect()
    sizes = check(out)
    padding = sum(2048 - s for s in sizes if s & (s - 1))
    assert padding <= 0.03 * sum(sizes)
    by = defaultdict(list)
    for p in out:
        by[p.doc_id].append(p)
    for i, text in {r[0]: r[1] for r in rows if r[0] not in (None, 5)}.items():
        ids = array("I", [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1])
        at = 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    assert sum(p.length for p in by[5]) == 2 * by[5][0].doc_tokens and None in by
    assert harmonic_pack(docs(rows).where("false"), PATH).count() == 0


def test_full_bins_hold_a_fixed_number_of_pieces():
    packer = HarmonicPacker()
    out = [x for i in range(1000) for x in packer.add(lambda start, length, i=i: (i, start, length), 300 + i % 40)]
    bins = defaultdict(list)
    for (_, _, length), sequence, _ in out:
        bins[sequence].append(length)
    assert all(len(b) == 2048 // max(b) for b in bins.values())
    assert sum(p[2] for p, _, _ in out) + sum(p[2] for p, _, _ in packer.finish()) == sum(300 + i % 40 for i in range(1000))


def test_ids_can_come_along(docs):
    row = harmonic_pack(docs([(1, "hello world")]), PATH, with_ids=True).collect()
    assert sum((list(r.ids) for r in sorted(row, key=lambda r: r.start)), []) == [*TOKENIZER.encode("hello world", add_special_tokens=False).ids, 1]


def test_waiting_pieces_hold_their_own_ids_only():
    packer = HarmonicPacker()
    for i in range(200):
        ids = bytes(4 * (2048 * 50 + 3 + i % 5))
        list(packer.add(lambda start, length, ids=ids: ids[4 * start : 4 * (start + length)], len(ids) // 4))
    waiting = [(len(held), length) for own in packer.open.values() for held, _, length in own]
    assert waiting and all(size == 4 * length for size, length in waiting) and sum(size for size, _ in waiting) < 4 * 2048 * len(packer.open)


def test_words_are_learned_one_by_one_if_ends_mislead():
    own = CachedEncoder(PATH)
    own.ends = set()
    assert own.encode("several words here") == array("I", TOKENIZER.encode("several words here", add_special_tokens=False).ids).tobytes()
