import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bootlens.llm import bpe
from bootlens.llm.common import BoundedCache
from tests.llm.rows import documents, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_text_as_the_library(library):
    own, rng = bpe.BytePairCoder(PATH, cache=50), random.Random(3)
    atoms = [" ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "1", "'s", "'LL", "!", "<|endoftext|>", "<|", "\xa0", "\x1c", "\x85", "　", "​", "\U0001F600", "中", "the", "tion", "\x00", "՘"]
    for _ in range(4000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_unfinished_bytes_decode_as_the_library(library):
    own, rng = bpe.BytePairCoder(PATH), random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_chunks_do_not_change_ids(library):
    text = prose(5, 3000) + " \n  x " + "z" * 3000 + prose(6, 2000)
    parts = list(bpe.chunks(text, 100))
    assert "".join(parts) == text and len(parts) > 50
    own = bpe.BytePairCoder(PATH)
    assert [i for p in parts for unit in bpe.UNIT.findall(p) for i in own._units[unit]] == library.encode(text, add_special_tokens=False).ids


def test_documents(spark, library):
    got = sorted(tuple(r) for r in bpe.encode_documents(documents(spark).fillna({"doc_id": -1}), PATH).collect())
    want = []
    for i, text, *_ in odd_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids))
    assert got == sorted(want)


def test_null_ids_stay_and_empty_table(spark):
    assert bpe.encode_documents(documents(spark), PATH).where("doc_id is null").count() == 3
    assert bpe.encode_documents(documents(spark, []), PATH, with_ids=False).collect() == []


def test_frequent_words_stay_however_many_rare_ones_pass():
    asked = []
    cache = BoundedCache(lambda key: asked.append(key) or key.upper(), limit=40)
    for i in range(500):
        assert cache["the"] == "THE" and cache[f"rare{i}"] == f"RARE{i}"
        assert len(cache) + len(cache.old) <= 40
    assert asked.count("the") == 1 and len(asked) == 501


def test_words_of_common_letters_are_cut_without_the_library(library):
    own, cut = bpe.BytePairCoder(PATH), []
    own._cut = lambda unit, f=own._cut: cut.append(unit) or f(unit)
    text = "Rare words, écrits (naïvement); слова. Rare? it's 4you"
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert set(cut) == {",", " (naïvement);", ".", "?", "'s", " 4you"}


def test_fixed_letters_are_letters_of_the_library(library):
    own = bpe.BytePairCoder(PATH, cache=50)
    letters = "".join(c for c in map(chr, range(0x21, 0xE000)) if bpe.WORD.fullmatch(c))
    assert len(own._cut(letters)) == 1 and len(letters) > 30000


def test_parts_have_the_pretokens_of_the_whole(library):
    own, rng = bpe.BytePairCoder(PATH, cache=200), random.Random(6)
    atoms = [" ", "  ", "\n", "\x85", "\xa0", "\x1c", "　", "'", "'s", "'LL", ",", ".", "_", "[", "`", "{", "\x7f", "’", "́", "\xad", "‍",
             "1", "²", "ª", "×", "÷", "a", "é", "ß", "Ω", "ǅ", "ʰ", "я", "中", "か", "한", "the", " The", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(rng.choice(atoms) for _ in range(rng.randint(0, 12)))
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text
