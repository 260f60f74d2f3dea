import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from voxlab.llm.pii import KINDS, LABELERS, estimate, find, fitted, redact, span_array, train

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and max(map(int, m[0].split("."))) > 255 or name == "card" and not (12 <= len(d) <= 19 and luhn(d)) \
                    or name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out)]


def card(rnd, n=16):
    d = "4" + "".join(rnd.choice("0123456789") for _ in range(n - 2))
    return d + next(c for c in "0123456789" if luhn(d + c))


def texts(n, seed=4):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randrange(0, 14)):
            parts.append(rnd.choice([
                lambda: "wörd 😀", lambda: f"x{rnd.randrange(99)}.y@mail{rnd.randrange(9)}.example.com", lambda: "a@b.c_d@e.f-g.h", lambda: "a@b@c.d.", lambda: "@x.y", lambda: "q@w",
                lambda: ".".join(str(rnd.randrange(0, 300)) for _ in range(rnd.randrange(2, 7))), lambda: "001.002.0255.0000", lambda: card(rnd), lambda: card(rnd, rnd.randrange(11, 22)),
                lambda: f"{card(rnd)} {card(rnd)}", lambda: "-".join(card(rnd)[i:i + 4] for i in range(0, 16, 4)), lambda: str(rnd.randrange(10 ** 15)),
                lambda: f"+1 ({rnd.randrange(100, 999)}) 555-{rnd.randrange(1000, 9999)}", lambda: "+1)))", lambda: "+49 30 1234567 9.8.7.6", lambda: "+12--",
                lambda: f'token = "{rnd.getrandbits(160):040x}"', lambda: "plain text, no more"])())
        out.append(rnd.choice(["", " ", "\n"]).join(parts) if rnd.random() < 0.3 else " ".join(parts))
    return out


def test_base_spans_by_definition(frame):
    t = texts(400)
    rows = {r.doc_id: r for r in find(frame([(i, x, "en", "s") for i, x in enumerate(t)])).collect()}
    for i, x in enumerate(t):
        want, r = base(x), rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (x, want, r.spans)
        n = [sum(s.startswith(k + ":") for s in want) for k, _ in PATTERNS]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r.n_added
        key = [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans)]
        assert key == sorted(key) and len(set(key)) == len(key)


def test_spans_are_added(frame):
    rnd = random.Random(1)
    filler = [(i, x, "en", "s") for i, x in enumerate(texts(300))]
    a, b = card(rnd), card(rnd)
    t = f'pay {a} {b} now, token = "{rnd.getrandbits(160):040x}"'
    (r,) = [r for r in find(frame([*filler, (999, t, "en", "s")])).collect() if r.doc_id == 999]
    kinds = [s.split(":")[0] for s in r.spans.split(",")]
    assert kinds == ["card", "card", "secret"] and r.n_card == 0


@pytest.mark.parametrize("n", [200, 201, 100_000])
def test_long_secrets_are_proposed_whole(frame, n):
    token = "eyJ" + "".join(random.Random(n).choices("0123456789abcdef", k=n - 3))
    start = len('token = "')
    (r,) = frame([(1, f'token = "{token}" and on', "en", "s")]).select(span_array(F.col("text")).alias("s")).collect()
    assert (start, start + n) in [(x.start, x.stop) for x in r.s if KINDS[x.kind] == "secret"]


def test_odd_rows(odd, frame):
    got = find(odd).collect()
    assert len(got) == 10
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.spans, r.base_sha256) == ("", empty) for r in got if r.doc_id in (1, 2, 3, 4, 6, 7))
    (r,) = [r for r in got if r.doc_id == 5]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 0, 1)
    assert find(frame([])).collect() == [] and redact(frame([])).collect() == []


@pytest.mark.parametrize(("text", "want"), [
    ("1" * 200_000, []), ("a" * 200_000 + "@", []), ("+1" + ")" * 200_000, []), ("1 " * 100_000, []), ("+1 " * 50_000, []),
    ("a@b" + ".c" * 50_000, ["email:0:100003"]), ("1.2." * 10_000, [f"ip:{8 * i}:{8 * i + 7}" for i in range(5000)])])
def test_very_long_runs(frame, text, want):
    (r,) = find(frame([(1, text, "en", "s")])).collect()
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()


def test_many_matches_in_one_text(frame):
    t = " x ".join(f"u{i}@h.org" for i in range(3000))
    (r,) = find(frame([(1, t, "en", "s")])).collect()
    assert r.n_email == 3000 and r.spans == ",".join(base(t))


def test_redaction(frame):
    rows = [(1, "ä a.b@c.org, +1 (212) 555-0100 end", "en", "s"), (2, "nothing here", "en", "s"), (3, None, "en", "s"), (4, "+1 555 9.8.7.6", "en", "s")]
    df = redact(frame(rows))
    got = {r.doc_id: r for r in df.collect()}
    assert df.columns == frame(rows).columns
    assert got[1].text == "ä [EMAIL], [PHONE] end" and got[1].n_chars == len(got[1].text)
    assert got[2].text == "nothing here" and got[2].n_chars == 12 and got[3].text is None
    assert "9.8" not in got[4].text


def test_no_python_in_the_plan(frame, capsys):
    find(frame([(1, "a@b.c", "en", "s")])).explain()
    redact(frame([(1, "a@b.c", "en", "s")])).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_estimation_recovers_reliabilities():
    rnd = random.Random(3)
    right = (0.95, 0.9, 0.8, 0.6, 0.7)
    counts = {}
    for _ in range(40_000):
        y = rnd.random() < 0.6
        v = tuple(1 if (rnd.random() < p) == y else -1 for p in right)
        counts[v] = counts.get(v, 0) + 1
    got = estimate([(0, v, n) for v, n in counts.items()])
    assert got["prior"][0] == pytest.approx(0.6, abs=0.03)
    for j, p in enumerate(right):
        assert got["rates"][j, 1, 2] == pytest.approx(p, abs=0.03) and got["rates"][j, 0, 0] == pytest.approx(p, abs=0.03)
    assert len(LABELERS) == len(right)


def test_estimation_keeps_kinds_apart():
    """Three kinds, each with labelers of its own quality: every prior and rate is found."""
    rnd = random.Random(4)
    truth = {0: (0.3, (0.9, 0.9, 0.55, 0.8, 0.7)), 1: (0.6, (0.6, 0.85, 0.9, 0.7, 0.9)), 2: (0.8, (0.85, 0.5, 0.8, 0.9, 0.6))}
    counts = {}
    for k, (share, right) in truth.items():
        for _ in range(40_000):
            y = rnd.random() < share
            v = tuple(1 if (rnd.random() < p) == y else -1 for p in right)
            counts[k, v] = counts.get((k, v), 0) + 1
    got = estimate([(k, v, n) for (k, v), n in counts.items()])
    for k, (share, right) in truth.items():
        assert got["prior"][k] == pytest.approx(share, abs=0.05)
        for j, p in enumerate(right):
            assert got["by_kind"][k, j, 1, 2] == pytest.approx(p, abs=0.05)


def test_sure_patterns_stay_positive():
    """A kind whose form and gazetteer votes fail is still itself where the base rule holds."""
    got = estimate([(0, (1, -1, -1, 0, 1), 500), (1, (1, 1, 1, 0, 1), 500), (0, (0, -1, -1, 0, 1), 20)], [True, True, False])
    assert got["posterior"][0] == got["posterior"][1] == 1.0
    assert got["prior"][0] > 0.9 and got["by_kind"][0, 1, 1, 0] > 0.8 and got["by_kind"][1, 1, 1, 2] > 0.8


def test_classifier_follows_probabilities():
    rows = [(0, (1, 1, 1, 0, 1), 3, 50, 0.99), (0, (-1, -1, -1, 0, -1), 3, 50, 0.01)]
    w = train(rows)
    assert len(w) == 1 + len(KINDS) + 2 * len(LABELERS) + 2
    assert len(train([])) == len(w)


def test_fit_counts_every_span(frame):
    df = frame([(i, "a@b.c and 1.2.3.4", "en", "s") for i in range(50)]).select(span_array(F.col("text")).alias("spans"))
    assert fitted(df)["prior"][0] > 0.5
