import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from bootlens.llm import token_store as ts
from tests.llm.rows import documents, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_units_as_the_library():
    library, own, rng = Tokenizer.from_file(PATH), ts.LibraryEncoder(PATH, limit=40), random.Random(5)
    atoms = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "!", "<|endoftext|>", "\xa0", "\x1c", "\x85", "\u3000", "\U0001F600", "ch", "\r\n", "the", "tion", "x" * 70]
    for _ in range(60):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 25))) for _ in range(20)]
        for text, ids in zip(texts, own.encode(texts)):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_round_trip(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    got = sorted(tuple(r) for r in ts.round_trip(documents(spark, rows), PATH).collect())
    assert got == sorted(want(rows))


def test_documents_without_id_come_first(spark):
    got = sorted((tuple(r) for r in ts.round_trip(documents(spark), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got][:3] == [None] * 3 and got[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))


def test_one_document_by_its_index(spark, tmp_dir):
    rows = [(k, prose(k, 60), "en", "a", 1) for k in range(300)]
    folder = f"{tmp_dir}/store"
    manifest = ts.write_store(documents(spark, rows, clash=False), PATH, folder).collect()
    dictionary = open(f"{folder}/dictionary", "rb").read()
    assert dictionary and sum(r["n_docs"] for r in manifest) == 300
    library, found = Tokenizer.from_file(PATH), 0
    for r in manifest:
        shard = ts.Shard(fs.LocalFileSystem(), r["file"], dictionary)
        for ids in shard.find(177):
            assert ids.tolist() == library.encode(prose(177, 60), add_special_tokens=False).ids + [2]
            found += 1
        with pytest.raises(ValueError):
            ts.Shard(fs.LocalFileSystem(), r["file"], dictionary + b"x")
    assert found == 1


def test_empty_table(spark):
    assert ts.round_trip(documents(spark, []), PATH).collect() == []


def test_pieces_cover_the_whole_document():
    ids = np.arange(5000, dtype="<u4").tobytes()
    got = np.frombuffer(ts.pieces(ids), dtype="<u4")
    assert len(got) == ts.PIECES * ts.PIECE // 4 and got[0] == 0 and got[-1] == 4999 and ts.pieces(ids[:400]) == ids[:400]
    assert max(np.diff(got)) < 5000 / (ts.PIECES - 1)


def test_the_dictionary_does_not_depend_on_partitioning(spark):
    rows = [(k, prose(k, 90), "en", "a", 1) for k in range(400)] + [(None, prose(k, 90), "en", "a", 1) for k in range(20)]
    df = documents(spark, rows, clash=False).select("doc_id", "text")
    a, b = (ts.train_dictionary(df.repartition(n), PATH, 2) for n in (1, 6))
    assert a == b and a


def test_frequent_units_stay_in_the_cache():
    own = ts.LibraryEncoder(PATH, limit=200)
    for k in range(30):
        own.encode([" ".join(["the", "frequent", "words", *(f"rare{k}x{j}" for j in range(40))])])
    assert {" frequent", " words"} <= set(own.young) | set(own.old) and len(own.young) + len(own.old) <= 2 * 200


def test_units_end_where_common_pretokens_end():
    texts = ["Rare words. rare,", "", " \n two  4you it's", "naïve! 中文1 \xa0x", "<|endoftext|>", "\t"]
    units, before = ts.cut_units(texts, ["<|endoftext|>"])
    got = [units.to_pylist()[a:b] for a, b in zip(before, before[1:])]
    assert got == [["Rare", " words", ".", " rare", ","], [], [" \n", " two", " ", " 4", "you", " it", "'s"],
                   ["naïve", "!", " 中文", "1", " ", "\xa0", "x"], ["<|endoftext|>"], ["\t"]]
    assert ts.cut_units([])[0].to_pylist() == ts.cut_units(["", ""])[0].to_pylist() == []


def test_the_library_meets_a_word_once_whatever_stands_behind_it():
    own, asked = ts.LibraryEncoder(PATH), []
    own.learn = lambda units, f=own.learn: asked.extend(units) or f(units)
    texts = [" word" + end for end in (".", ",", "!", ";", "?", ")", ":", "1", "22", "'s", " word", "\nword")]
    got = own.encode(texts)
    assert asked.count(" word") == 1 and len(asked) == len(set(asked)) and not {" word.", " word,", " word1"} & set(asked)
    library = Tokenizer.from_file(PATH)
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_texts_are_cut_in_blocks():
    library, own = Tokenizer.from_file(PATH), ts.LibraryEncoder(PATH)
    texts = ["", prose(1, 260_000), "short", "", prose(2, 50) + "<|endoftext|> x", prose(3, 260_000) + " "]
    assert max(map(len, texts)) > ts.CHUNK
    assert [b"".join(p) for p in ([x.encode() for x in own.parts(t)] for t in texts)] == [t.encode() for t in texts]
    assert [len(x) for x in ts.blocks(["a" * 3, "b" * 3, "c" * 9, "d"], 6)] == [2, 1, 1]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_batches_are_sliced_by_bytes():
    texts = ["x" * n for n in (5, 5, 30, 1, 1, 1, 1, 0, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], names=["doc_id", "text"])
    got = [s.column(1).to_pylist() for s in ts.slices(batch, rows=4, size=10)]
    assert [t for s in got for t in s] == texts and [len(s) for s in got] == [2, 1, 4, 2, 1]
    assert list(ts.slices(batch.slice(0, 0))) == []


def test_odd_characters_as_the_library():
    library, own, rng = Tokenizer.from_file(PATH), ts.LibraryEncoder(PATH, limit=300), random.Random(7)
    atoms = [" ", "  ", "\n", "\x85", "\xa0", "\x1c", "\u2003", "\u3000", "'", "'s", "'LL", "s", ",", ".", "_", "[", "`", "{", "\x7f", "’", "\u0301", "\xad", "\u200d",
             "1", "23", "²", "٣", "ª", "º", "×", "÷", "a", "é", "ß", "Ω", "ǅ", "ʰ", "я", "中", "か", "한", "\U0001F600", "the", " The", "<|endoftext|>", "<|"]
    for _ in range(200):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 12))) for _ in range(20)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_pretokens_are_cut_at_white_space_only(tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    words = {"type": "Split", "pattern": {"Regex": r" ?\S+|\s+(?!\S)|\s+"}, "behavior": "Isolated", "invert": False}
    spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [words, spec["pre_tokenizer"] | {"use_regex": False}]}
    spec["model"]["vocab"]["a."] = 50257  # a merge over the end of letters
    merges = spec["model"]["merges"]
    merges.append(["a", "."] if isinstance(merges[0], list) else "a .")
    (tmp_path / "other.json").write_text(json.dumps(spec))
    library, own = Tokenizer.from_file(f"{tmp_path}/other.json"), ts.LibraryEncoder(f"{tmp_path}/other.json")
    texts = ["it's (a)st.. end", "U.S. 4you 2.5.\n\n  x's", "don't.", "<|endoftext|>a.b a."]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, dtype="<u4").tolist() for ids in own.encode(texts)] == want
    assert any(50257 in ids for ids in want)
