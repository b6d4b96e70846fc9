"""Token files on hostile texts: the library's ids with a fresh and with a used encoder, split ranges."""

import cProfile
import pstats
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bitpack

PIECES = ["mot", "été", "x", "A1", "日本", "\xa0", "\t", "　", "\x1c", "\x1f", " ", "\r", "\n", " ", " ", " ", "!", "?", ".", ",", ":", ";", "(", ")", "<", ">", "|", "'s", "'", "-", "\x00", "é", "é", "🎉", "<|endoftext|>", "#*$%&", "\x0b", "\x85", "ß", "42"]


def hostile(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randrange(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return hostile(10_000, 7) + ["mot\xa0 !", "x mot\xa0! y", " mot\xa0 ", "x mot\xa0! y", "un\t; deux\t ; trois　? quatre　"]


def test_hostile_texts_fresh_and_used(texts):
    library = bitpack._tokenizer("byte_bpe_50k.json")
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    used = bitpack.Encoder("byte_bpe_50k.json")
    for _ in range(2):
        assert [x.tolist() for x in used.encode(pa.array(texts))] == want
    for i in range(0, len(texts), 50):  # a text met by an encoder that knows nothing
        fresh = bitpack.Encoder("byte_bpe_50k.json")
        assert [x.tolist() for x in fresh.encode(pa.array(texts[i : i + 5]))] == want[i : i + 5]
    backwards = bitpack.Encoder("byte_bpe_50k.json")
    assert [x.tolist() for x in backwards.encode(pa.array(texts[::-1]))] == want[::-1]


def test_new_words_are_learned_as_arrays():
    """Fewer calls than one for ten new words; words that differ in the marks behind them are one."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgéüñçßжš", k=12)) for _ in range(20_000)]
    texts = [" ".join(w + rng.choice(["", "", ".", ",", "?!"]) for w in words[i : i + 100]) for i in range(0, len(words), 100)]
    encoder, profile = bitpack.Encoder("byte_bpe_50k.json"), cProfile.Profile()
    got = profile.runcall(encoder.encode, pa.array(texts))
    assert pstats.Stats(profile).total_calls < len(words) // 10
    library = bitpack._tokenizer("byte_bpe_50k.json")
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    known = encoder.known
    again = encoder.encode(pa.array([f"{w}; {w}|\n{w}" for w in words]))
    assert encoder.known - known == len(words) + 2  # each behind a line break, or at a start; and the new marks
    assert again[7].tolist() == library.encode("{0}; {0}|\n{0}".format(words[7]), add_special_tokens=False).ids


def test_letters_with_marks_and_forgetting():
    """Each character of one to three bytes, alone, doubled and before marks, with a memory that is soon given up."""
    chars = [chr(c) for c in (*range(0x0900), *range(0x1E00, 0x2100), *range(0x3000, 0x3100), 0xAC00, 0x1F389)]
    texts = [f"x {c} {c}{c} a{c}!? {c}. {c}b, ..{c}*\n{c}{c} {c}; '{c}'s:\n{c}" for c in chars]
    library = bitpack._tokenizer("byte_bpe_50k.json")
    encoder = bitpack.Encoder("byte_bpe_50k.json", most=500)
    for part in (texts[:400], texts, texts[::-1]):
        assert [x.tolist() for x in encoder.encode(pa.array(part))] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_words_whose_hashes_meet():
    """Hashes of one place in the table, through several sizes of it, are told apart."""
    encoder = bitpack.Encoder("byte_bpe_50k.json")
    hashes = np.arange(1, 9001, dtype=np.uint64) << np.uint64(10)
    for i in range(0, len(hashes), 3000):
        assert (encoder._find(hashes[i:]) == -1).all()
        encoder._keep(hashes[i : i + 3000], np.arange(3000, dtype=np.uint32), np.ones(3000, np.int64))
        assert (encoder._find(hashes[: i + 3000]) == np.arange(i + 3000)).all()
    encoder.forget()
    assert (encoder._find(hashes) == -1).all()


def test_rows_without_name_and_of_one_name_are_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bitpack, "PART_ROWS", 50)
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"text {i} " * (i % 7)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bitpack.write_packed(docs, str(tmp_path / "t"))
    sizes = [len(bitpack.Image(r.content).doc_ids) for r in spark.read.parquet(str(tmp_path / "t")).collect()]
    assert max(sizes) < 200 and sum(sizes) == 600
    library = bitpack._tokenizer("byte_bpe_50k.json")
    back = sorted(bitpack.read_packed(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    assert np.cumsum([0] + [r.n_tokens for r in back])[:-1].tolist() == [r.start for r in back]
    crcs = sorted(zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for _, t in rows)
    assert sorted(r.ids_crc32 for r in back) == crcs
