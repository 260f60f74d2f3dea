import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voxlab.llm.token_counts import RunCounter, count_tokens

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return RunCounter(f.read())


def texts(n, seed=3):
    rnd = random.Random(seed)
    odd = [chr(rnd.randrange(0x80, 0x3000)) for _ in range(300)] + [chr(rnd.randrange(0x10000, 0x20000)) for _ in range(50)]
    marks = list("\x1c\x1f\x85\xa0 　\t\n\x0b'''") + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", "İ", "Σ", "é", "é", "́"]
    letters = [chr(c) for c in range(32, 127)] * 4 + odd + marks
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 70))) for _ in range(n)]


def test_equals_the_library(library, counter):
    for t in texts(1500):
        assert counter.of_text(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_state_maps_compose_at_any_cut(library, counter):
    rnd = random.Random(5)
    for t in texts(800, 9):
        n, want = rnd.randrange(1, 9), counter.of_text(t)
        maps = [counter.state_map(t[i:i + n]) for i in range(0, max(1, len(t)), n)]
        assert counter.tokens(counter.composed(maps)) == want
        folded = maps[0]
        for m in maps[1:]:
            folded = counter.compose(folded, m)
        assert counter.tokens(folded) == want


def test_word_machine_equals_the_merge_rules(counter):
    rnd = random.Random(1)
    m = counter.machine
    for _ in range(2000):
        w = "".join(rnd.choice("abcdeinorst") for _ in range(rnd.randrange(1, 14)))
        assert m.count(w) == len(m.merged([*w[:-1], w[-1] + m.end]))


def test_tables_may_be_emptied(library, counter, monkeypatch):
    monkeypatch.setattr("voxlab.llm.token_counts.MAX_STATES", 5)
    monkeypatch.setattr("voxlab.llm.token_counts.MAX_RUNS", 3)
    monkeypatch.setattr("voxlab.llm.token_counts.MAX_PAIRS", 4)
    for t in texts(100, 11):
        assert counter.of_text(t) == len(library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_query_over_odd_rows(spark, odd, library, chunk):
    got = sorted((tuple(r) for r in count_tokens(odd.where("doc_id != 6 or doc_id is null"), PATH, chunk=chunk).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD if i != 6]
    assert [r[:3] for r in got] == sorted(want, key=str)
    assert not any(r[3] for r in got)


def test_long_text_in_many_chunks(frame, library, monkeypatch):
    monkeypatch.setattr("voxlab.llm.token_counts.FAN_IN", 4)
    t = "x" * 3000 + " the end, of <|endoftext|> it all " * 60 + "y" * 500
    (r,) = count_tokens(frame([(1, t, None, None)]), PATH, chunk=100, limit=10).collect()
    assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t), len(library.encode(t, add_special_tokens=False).ids), True)


def test_empty_table(frame):
    assert count_tokens(frame([]), PATH).collect() == []
