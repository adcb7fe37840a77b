import signal

import numpy as np
import pyarrow as pa
import pytest

from siltlog.llm.words import ChunkMemo, RowMemo, numbered


@pytest.fixture
def in_time():
    def late(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


def _codes(words):
    return np.array([int(w) for w in words], np.uint32)


@pytest.mark.parametrize("n", [10, 11, 16, 17, 100, 1000])
def test_more_strings_in_a_text_than_slots(in_time, n):
    memo, rows = ChunkMemo(lambda words: (np.repeat(_codes(words), 2), np.full(len(words), 2, np.int64)), bits=4), RowMemo(lambda words: [_codes(words)], bits=4)
    for start in (0, 5, 0, n):  # long strings stand between the others
        words = [str(k) if k % 7 else "0" * 70 + str(k) for k in range(start, start + n)]
        flat, ends = memo.ids(*numbered(pa.array([[*words, words[0]], words[:1]])))
        want = [int(w) for w in [*words, words[0], words[0]] for _ in "ab"]
        assert flat.tolist() == want and ends.tolist() == [0, 2 * n + 2, 2 * n + 4]
        at, (found,) = rows.rows(pa.array(words))
        assert found[at].tolist() == [int(w) for w in words]
        assert memo.numbers.count <= 10 and rows.numbers.count <= 10


def test_known_strings_when_there_is_no_room(in_time):
    numbers = ChunkMemo(None, bits=4).numbers
    assert numbers.look(pa.array(list("abcdefgh")))[0].tolist() != []
    at, new = numbers.look(pa.array(list("ahijklmnopqrstuvw")))
    assert len(set(at.tolist())) == len(at) and numbers.count <= 10
    assert set(at.tolist()) - set(range(8)) == set(range(8, 8 + len(new)))


def test_a_text_of_more_words_than_the_memo_holds(in_time):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    from siltlog.llm import pieces

    text = " ".join(map(str, range(100_000, 640_000)))
    assert pieces.load(path).encode(text) == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)
