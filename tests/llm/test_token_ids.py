import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from covermap.llm.rans import Coder, scaled_frequencies
from covermap.llm.token_ids import WordTokenizer, default_tokenizer, read_token_files, write_token_files, written_ids


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


@pytest.mark.parametrize("lanes, segment", [(4, 16), (7, 14), (64, 128), (1024, 1 << 18)])
@pytest.mark.parametrize("count", [0, 1, 5, 63, 64, 1000, 5000])
def test_round_trip(lanes, segment, count):
    ids = (np.random.default_rng(count).zipf(1.4, count) % 300).astype(np.uint32)
    coder = Coder(scaled_frequencies(np.bincount(ids, minlength=300)))
    block = coder.encode(ids, lanes, segment)
    assert coder.decode(block, segment).tolist() == ids.tolist()
    for number in range(len(block.states)):  # each from its own checkpoint
        assert coder.decode_segment(block, number, segment).tolist() == ids[number * segment:(number + 1) * segment].tolist()


def test_size_is_near_the_entropy():
    ids = (np.random.default_rng(3).zipf(1.3, 1 << 18) % 40_000).astype(np.uint32)
    counts = np.bincount(ids)
    shares = counts[counts > 0] / len(ids)
    block = Coder(scaled_frequencies(counts)).encode(ids)
    assert 8 * len(block.words) / len(ids) < 1.03 * -(shares * np.log2(shares)).sum() + 0.05


def test_one_symbol_and_damage():
    coder = Coder(scaled_frequencies(np.array([0, 9])))
    assert coder.decode(coder.encode(np.ones(100, np.uint32), 8, 16), 16).tolist() == [1] * 100
    coder = Coder(scaled_frequencies(np.array([5, 9, 3])))
    block = coder.encode(np.random.default_rng(0).integers(0, 3, 4000).astype(np.uint32), 8, 400)
    block.words = bytes([block.words[0] ^ 255]) + block.words[1:]
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(block, 400)


@pytest.mark.parametrize("counts", [[1, 1, 1 << 40], [3] * 7, [1] * 5000 + [10**9]])
def test_frequencies_sum_up_and_none_is_lost(counts):
    found = scaled_frequencies(np.array(counts))
    assert found.sum() == 1 << 20 and found.min() >= 1


def test_words_give_the_ids_of_whole_texts(tokenizer, fixture_texts):
    with open(default_tokenizer(), encoding="utf-8") as file:
        words = WordTokenizer(file.read())
    texts = [text or "" for text in fixture_texts]
    texts += ["Hi, THERE. İ É İ <|STARTOFTEXT|> a<|startoftext|>b it's IT'S, x.. y., Ａ,  a b Σ ΟΔΟΣ 12,5.", "́a é, "]
    found = words.ids([text.encode() for text in texts])
    assert [np.frombuffer(one, "<u4").tolist() for one in found] == [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]


def test_against_whole_texts(documents, rows_of, tokenizer):
    found = [tuple(row) for row in written_ids(documents, with_ids=True).collect()]
    ids = lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    raw = lambda text: np.array(ids(text), "<u4").tobytes()
    assert sorted(((one[0], one[2], one[3], bytes(one[4])) for one in found), key=repr) == sorted(
        ((doc_id, len(ids(text)), zlib.crc32(raw(text)), raw(text)) for doc_id, text, _ in rows_of), key=repr)
    in_order = sorted(found, key=lambda one: one[1])
    assert [one[1] for one in in_order] == np.cumsum([0] + [one[2] for one in in_order])[:-1].tolist()
    order = [(one[0] is not None, one[0] or 0) for one in in_order]
    assert order == sorted(order)


def test_small_blocks_and_empty_table(spark, documents, nothing, tmp_path, collected):
    write_token_files(documents, str(tmp_path / "small"), block_tokens=50)
    small = read_token_files(spark, str(tmp_path / "small"), with_ids=False)
    assert collected(small.select("doc_id", "n_tokens", "ids_crc32")) == collected(written_ids(documents).select("doc_id", "n_tokens", "ids_crc32"))
    assert spark.read.parquet(str(tmp_path / "small/blocks")).count() > 10
    assert written_ids(nothing).collect() == []
