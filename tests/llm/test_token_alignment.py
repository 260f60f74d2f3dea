import collections
import hashlib
import random

import public_tokenizers
import pytest

from voxlab.llm import token_alignment as T

from .conftest import ODD

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def pair():
    return T.TokenPair(open(A, "rb").read(), open(B, "rb").read())


def whole(libraries, text):
    """(ids, bytes of each token) of A and of B for a whole text, None without tokens."""
    if not text:
        return None
    a, b = libraries
    code = T.byte_of_symbol()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    raw_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(T.MARK, " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return None
    return (ids_a, raw_a), (ids_b, raw_b)


def spans(raw):
    at, out = 0, []
    for r in raw:
        out.append((at, at + len(r)))
        at += len(r)
    return out


def brute(libraries, rows):
    """All columns by comparing every token of A with every token of B."""
    docs, counts = [], collections.Counter()
    for i, text in rows:
        got = whole(libraries, text)
        if got is None:
            docs.append((i, 0, 0, 0, [], ""))
            continue
        (ia, ra), (ib, rb) = got
        sa, sb = spans(ra), spans(rb)
        links = [(ia[x], ib[y]) for x in range(len(ia)) for y in range(len(ib)) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for e in ends:
            inside = lambda ids, s: ",".join(str(k) for k, (u, v) in zip(ids, s, strict=True) if u >= before and v <= e)  # noqa: E731, B023
            groups.append(f"{inside(ia, sa)}|{inside(ib, sb)}")
            before = e
        counts.update(links)
        docs.append((i, len(ia), len(ib), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return sorted(((i, na, nb, ng, len(li), sum(counts[x] == top[x[1]] for x in li), sum(counts[x] for x in li), sha) for i, na, nb, ng, li, sha in docs), key=str)


TEXTS = [
    "hello world", "  two  spaces   and\n\nlines \n next\ttab ", "a", " ", "\n", "\n\nx", "word ", "don't stop, it's 12345 o'clock!", "<|endoftext|> <s>x</s> <unk> <0x0A>",
    "Zażółć gęślą jaźń 日本語のテキスト 😀👍🏽 العربية हिन्दी", "no" + chr(0xA0) + "break " + chr(0x3000) + "wide" + chr(0x2009) + "thin" + chr(0x2028) + "line", "a" + chr(0x1C) + "b" + chr(0x180E) + " c" + chr(0xFEFF),
    "mark " + T.MARK + "here", T.MARK, "\r\n\f\v x", "e" + chr(0x301) + "cole " + chr(0xFB01) + "n " + chr(0) + " nul", "x" * 700, "y " * 300, "-" * 50 + " " * 40 + "=" * 9,
]


def test_ids_are_those_of_the_libraries(pair, libraries):
    assert pair.fast is not None
    rng = random.Random(5)
    pieces = [" ", "  ", "\n", "\t", "\r\n", chr(0xA0), chr(0x3000), chr(0x2003), "a", "The", "word", "'s", "42", "ü", "日", "😀", T.MARK, ".", "...", "<0x0A>", chr(0x1E), chr(0x85), "ing", "x"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    for t, got in zip(texts, pair.tokens(texts), strict=True):
        want = whole(libraries, t)
        assert got == (want and (want[0][0], want[1][0])), repr(t)


def test_fast_ids_on_old_characters(pair, libraries):
    """Every kind of character that is taken for settled, beside white space, digits and marks."""
    rng = random.Random(6)
    old = [chr(c) for lo, hi in T._OLD for c in range(lo, hi + 1)]
    texts = ["".join(rng.choice(old) + rng.choice(["", "", " ", "1", "a", "'", "\n", "\t "]) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789 .,-'_/=+") for _ in range(200)) for _ in range(2000)]
    sure = [t for t in texts if not T.UNSETTLED.search(t)]
    assert len(sure) > 5000
    a = libraries[0]
    for t, e in zip(sure, a.encode_batch_fast([" " + t for t in sure], add_special_tokens=False), strict=True):
        assert pair.fast.encode_ordinary(" " + t) == e.ids, repr(t)


def test_windows_with_one_hash_are_told_apart(pair, monkeypatch):
    texts = ["of the of it the of", "it of the it"]
    want = T.Block(pair, 0).documents(pair.tokens(texts))
    monkeypatch.setattr(T, "_mixed", lambda ids, ends, seed: ends.astype("uint64") * 0)
    assert [d for d, _ in T.Block(pair, 0).documents(pair.tokens(texts))] == [d for d, _ in want]


def columns(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_equals_brute_force(frame, libraries):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(100, None), (101, ""), (None, "hello world"), (7, "hello hello world")]
    df = frame([(i, t, "en", "s") for i, t in rows]).repartition(3)
    assert columns(T.align_documents(df, A, B)) == brute(libraries, rows)


def test_small_blocks_and_forgetful_workers(frame, libraries, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, "of " * 40), (51, "hello world")]
    pair = T.TokenPair(open(A, "rb").read(), open(B, "rb").read())
    monkeypatch.setattr(T, "MAX_WINDOWS", 3)
    monkeypatch.setattr(T, "BLOCK_TOKENS", 5)
    blocks, docs = [T.Block(pair, 0)], []
    for (i, t), got in zip(rows, pair.tokens([t for _, t in rows]), strict=True):
        if blocks[-1].full():
            blocks.append(T.Block(pair, len(blocks)))
        docs.append((i, got and blocks[-1].documents([got])[0]))
    assert len(blocks) > 10
    total = collections.Counter()
    for b in blocks:
        *_, codes, n = b.pairs()
        total.update(dict(zip(codes.tolist(), n.tolist(), strict=True)))
    want = collections.Counter()
    for _, t in rows:
        got = whole(libraries, t)
        if got:
            (ia, ra), (ib, rb) = got
            sa, sb = spans(ra), spans(rb)
            want.update(ia[x] << T.B_BITS | ib[y] for x in range(len(ia)) for y in range(len(ib)) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1])
    assert total == want
    assert [d and d[0] for _, d in docs] == [r[7] or None for i, t in rows for r in brute(libraries, [(i, t)])]


def test_odd_rows_and_empty_table(odd, frame, libraries):
    got = columns(T.align_documents(odd, A, B))
    short = [(r[0], r[1]) for r in ODD if not r[1] or len(r[1]) < 1000]
    assert len(got) == len(ODD)
    assert sorted((r[0], *r[1:4]) for r in got if r[0] in (2, 3, 5)) == sorted((r[0], *r[1:4]) for r in brute(libraries, short) if r[0] in (2, 3, 5))
    long = next(r for r in got if r[0] == 6)
    assert long[1] > 40_000 and long[4] >= long[3]
    assert columns(T.align_documents(frame([]), A, B)) == []
