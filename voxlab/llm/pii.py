"""Personal data by weak supervision (DataFrame functions only).

Base spans are those of four fixed patterns and their checks.  Wider patterns
propose further spans: e-mail addresses written out, card and phone numbers that run into
neighbouring figures, secrets such as access tokens.  Five labelers vote on each span
(for, against, abstain): the base rule, a checksum or form rule, a gazetteer,
the words before it, and its boundaries.  Expectation-maximisation on the
counts of vote patterns, over all documents, estimates how reliable each labeler is and
how likely each pattern is personal data.  A logistic classifier on votes, kind
and shape of a span is then trained on those probabilities; what it accepts is
added to the base spans, which always stay.

The pattern counts are bounded by the number of patterns (a few thousand
rows), not by the data; nothing else reaches the driver.  Positions come from the
lengths of the pieces between matches, summed in blocks, so long texts with many
matches stay near linear.

Defined results: a null or empty text has no spans; rows with a null or
repeated id are treated row by row; without any proposal nothing is added; spans of
different kinds may overlap, an added span overlaps no base span of its kind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("rule", "form", "gazetteer", "context", "edges")

# The base patterns; possessive and anchored at the run they start in, so that no input makes them backtrack.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The proposing patterns.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?)[A-Za-z0-9-]{1,63}){1,8}",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
}
# Gazetteers, as patterns on the match.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]? ?)(?:com|org|net|edu|gov|mil|int|info|biz|io|co|me|de|fr|es|it|nl|be|at|ch|uk|us|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|pt|ie|eu)$",
    "ip": r"^(?!0+\.|127\.|255\.255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38)",
    "phone": r"^\+(?:1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:[0-9a-f]{24,}|[0-9A-F]{24,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[0-9A-Za-z-]+|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]+)$",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|from|to|cc)\W{0,12}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|login|client)\W{0,12}$",
    "card": r"(?i)(?:card|visa|credit|account|iban|no|number)\W{0,12}$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax|whatsapp|contact)\W{0,12}$",
    "secret": r"(?i)(?:token|secret|api[_-]?key|key|password|passwd|pwd|bearer|credential)\w{0,6}\W{0,12}$",
}
DIGITS = {"card": (12, 19), "phone": (9, 15)}
BLOCK = 64
BEFORE = 24
_SPAN = "array<struct<kind:int,start:long,stop:long,base:boolean,votes:array<int>,shape:int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m: Column) -> Column:
    """The check of the base rule on a match."""
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if kind in DIGITS:
        lo, hi = DIGITS[kind]
        n = F.length(_digits(m))
        fits = n.between(lo, hi)
        return fits & F.when(fits, F.call_function("luhn_check", _digits(m))).otherwise(False) if kind == "card" else fits
    return F.lit(True)


def _form(kind: str, m: Column) -> Column:
    """Vote of the checksum or form rule."""
    ok = {
        "email": F.length(m).between(6, 100) & m.rlike(r"[A-Za-z]"),
        "ip": _holds("ip", m),
        "card": _holds("card", m),
        "phone": _holds("phone", m) & m.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}$|^\+[0-9]{9,15}$"),
        "secret": m.rlike("^[^0-9]*+[0-9][^A-Za-z]*+[A-Za-z][^0-9]*+[0-9][^A-Za-z]*+[A-Za-z]") & ~m.rlike(r"[A-Za-z]{12}"),
    }[kind]
    return F.when(ok, 1).otherwise(-1)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: an expression named twice in a lambda is computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(lens: Column) -> Column:
    """Prefix sums of an array of long: sums of blocks first, then within each block."""
    add, zero = lambda a, x: a + x, F.lit(0).cast("long")

    def sums(x: Column) -> Column:
        n = F.size(x)
        of = lambda b: F.aggregate(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), zero, add)
        at = lambda i: F.floor(i / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), at(n - 1)), of)
        offsets = F.aggregate(blocks, F.array(zero), lambda a, y: F.array_append(a, F.element_at(a, -1) + y))
        return _let(offsets, lambda o: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(o, at(i)) + F.aggregate(
            F.slice(x, at(i) * BLOCK + 1, i - at(i) * BLOCK + 1), zero, add)))
    return _let(lens, sums)


def _spans(text: Column, kind: str, pattern: str, base: bool, guard: Column) -> Column:
    """Spans of one pattern with their votes; an empty array where the guard fails or nothing matches."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    k = KINDS.index(kind)

    def span(x: Column, stop: Column, before: Column, after: Column) -> Column:
        ok = _holds(kind, x) if base else F.lit(False)
        clean = before.rlike(r"(?:^|[\s\"'(<\[:=,;])$") & after.rlike(r"^(?:$|[\s\"')>\].,;:!?])")
        rule = F.when(ok, 1).otherwise(-1) if base else F.lit(0)  # the base rule has no say on what others propose
        votes = F.array(rule, _form(kind, x), F.when(x.rlike(GAZETTEER[kind]), 1).otherwise(-1),
                        F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0), F.when(clean, 1).otherwise(-1))
        shape = F.least(F.lit(3), F.floor(F.length(x) / 12)) * 3 + F.least(F.lit(2), F.floor(3 * F.length(_digits(x)) / F.length(x)))
        return F.struct(F.lit(k).alias("kind"), (stop - F.length(x)).cast("long").alias("start"), stop.alias("stop"),
                        ok.alias("base"), votes.alias("votes"), shape.cast("int").alias("shape"))

    def made(b: Column) -> Column:
        m, p = b["m"], b["p"]
        # the i-th match ends after i + 1 pieces and as many matches
        lens = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda x, y: (F.length(x) + F.length(y)).cast("long"))
        return _let(_running(lens), lambda ends: F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda i: span(
            F.get(m, i), F.get(ends, i), F.substring(F.get(p, i), -BEFORE, BEFORE), F.substring(F.get(p, i + 1), 1, 1))))

    empty = F.array().cast(_SPAN)
    held = _let(F.struct(found.alias("m"), pieces.alias("p")), lambda b: F.when(F.size(b["m"]) > 0, made(b)).otherwise(empty))
    return F.when(guard, held.cast(_SPAN)).otherwise(empty)


def span_array(text: Column) -> Column:
    """All spans, base and proposed, of a text."""
    t = F.coalesce(text, F.lit(""))
    digit = t.rlike("[0-9]")
    at = {"email": t.contains("@"), "ip": digit, "card": digit, "phone": t.contains("+")}
    wide = {
        "email": (t.contains("(") | t.contains("[")) & t.rlike(r"[\[(] ?(?:at|AT) ?[\])]"),
        "card": digit & t.rlike("[0-9]{4}"),
        "phone": digit & t.rlike("[0-9]{3}[\\x20.-][0-9]{4}"),
        "secret": digit & t.rlike("[A-Za-z0-9+/_-]{20}"),
    }
    ruled = F.concat(*[_spans(t, k, p, True, at[k]) for k, p in BASE.items()])
    proposed = F.concat(*[_spans(t, k, p, False, wide[k]) for k, p in WIDE.items()])
    return F.concat(ruled, proposed)


def _meets(base: Column, s: Column) -> Column:
    """Whether a span overlaps a base span of its kind."""
    return F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["stop"]) & (s["start"] < b["stop"]))


def judged(spans: Column) -> Column:
    """Without the proposals that overlap a base span of their kind."""
    return _let(F.filter(spans, lambda s: s["base"]), lambda base: F.filter(spans, lambda s: s["base"] | (F.get(s["votes"], 0) == -1) | ~_meets(base, s)))


def estimate(counted: list[tuple[int, tuple[int, ...], int]], sure: list[bool] | None = None, rounds: int = 100, shared: float = 50.0) -> dict:
    """Expectation-maximisation on (kind, votes, count): prior by kind, vote rates by labeler and class, posterior by pattern.

    Every kind has rates of its own (``by_kind``), as one and the same labeler may be good for one kind and
    useless for another; the rates over all kinds (``rates``) count as ``shared`` further spans of
    each.  Patterns that are ``sure`` stay positive.
    """
    kinds = np.array([r[0] for r in counted], int)
    votes = np.array([r[1] for r in counted], int).reshape(len(counted), len(LABELERS)) + 1
    n = np.array([r[2] for r in counted], float)
    fixed = np.zeros(len(counted), bool) if sure is None else np.array(sure, bool)
    p = np.where(fixed, 1.0, np.clip(0.5 + 0.15 * (votes - 1).sum(axis=1), 0.05, 0.95))  # start: the sum of votes
    prior, rates = np.full(len(KINDS), 0.5), np.full((len(LABELERS), 2, 3), 1 / 3)
    by_kind = np.full((len(KINDS), len(LABELERS), 2, 3), 1 / 3)
    # a weak belief that labelers are rather right than wrong keeps the two classes from changing places
    right = 1 + 0.02 * n.sum() * np.array([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]])
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kinds == k
            prior[k] = ((n * p)[own].sum() + 1) / (n[own].sum() + 2)
        for j in range(len(LABELERS)):
            for y, q in enumerate((1 - p, p)):
                c = np.array([np.bincount(votes[kinds == k, j], weights=(n * q)[kinds == k], minlength=3) for k in range(len(KINDS))])
                every = c.sum(axis=0) + right[y]
                rates[j, y] = every / every.sum()
                c = c + shared * rates[j, y]
                by_kind[:, j, y] = c / c.sum(axis=1, keepdims=True)
        log = [np.log(np.where(y, prior[kinds], 1 - prior[kinds])) + sum(np.log(by_kind[kinds, j, y, votes[:, j]]) for j in range(len(LABELERS))) for y in (0, 1)]
        new = np.where(fixed, 1.0, 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    return {"prior": prior, "rates": rates, "by_kind": by_kind, "posterior": p}


def _row(kind: int, votes: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(v == x) for v in votes for x in (-1, 1)], float(shape // 3) / 3, float(shape % 3) / 2]


def train(rows: list[tuple[int, tuple[int, ...], int, float, float]], ridge: float = 1.0) -> np.ndarray:
    """Weights of the span classifier from (kind, votes, shape, count, probability)."""
    if not rows:
        return np.zeros(len(_row(0, (0,) * len(LABELERS), 0)))
    x, n, p = np.array([_row(*r[:3]) for r in rows]), np.array([r[3] for r in rows], float), np.array([r[4] for r in rows])
    n = n / n.sum() * 1000
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - q)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fitted(spans: DataFrame) -> dict:
    """Estimates and classifier from a table with a column ``spans``."""
    s = F.col("s")
    counted = spans.select(F.explode("spans").alias("s")).groupBy(s["kind"].alias("k"), s["votes"].alias("v"), s["shape"].alias("h")).count().collect()
    rows = sorted((r["k"], tuple(r["v"]), r["h"], r["count"]) for r in counted)  # bounded by kinds x votes x shapes
    by: dict[tuple, int] = {}
    for k, v, _, n in rows:
        by[k, v] = by.get((k, v), 0) + n
    pattern = list(by)
    # the rule's own vote is 1 for base spans alone, which are personal data by definition
    got = estimate([(k, v, by[k, v]) for k, v in pattern], [v[0] == 1 for _, v in pattern]) if pattern else {"posterior": np.zeros(0), "prior": np.full(len(KINDS), 0.5), "rates": None}
    at = dict(zip(pattern, got["posterior"], strict=True))
    return got | {"weights": train([(k, v, h, n, float(at[k, v])) for k, v, h, n in rows])}


def accepted(spans: Column, model: dict) -> Column:
    """The base spans and what the classifier adds, by start, kind and end."""
    w = [float(x) for x in model["weights"]]
    nk, nl = len(KINDS), len(LABELERS)

    def score(s: Column) -> Column:
        out = F.lit(w[0]) + F.element_at(F.array(*[F.lit(x) for x in w[1:1 + nk]]), s["kind"] + 1)
        for j in range(nl):
            v = F.get(s["votes"], j)
            out = out + F.when(v == -1, w[1 + nk + 2 * j]).when(v == 1, w[2 + nk + 2 * j]).otherwise(0.0)
        return out + F.floor(s["shape"] / 3) / 3 * w[-2] + s["shape"] % 3 / 2 * w[-1]

    def plain(s: Column, base: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), base.alias("base"))

    def kept(base: Column) -> Column:
        more = F.filter(spans, lambda s: ~s["base"] & (score(s) >= 0) & ~_meets(base, s))
        return F.array_sort(F.concat(F.transform(base, lambda s: plain(s, s["base"])), F.array_distinct(F.transform(more, lambda s: plain(s, F.lit(False))))))
    return _let(F.filter(spans, lambda s: s["base"]), kept)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of base spans by kind, base_sha256, spans and number of spans added."""
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), span_array(F.col(text_col).cast("string")).alias("spans")) \
        .withColumn("spans", judged(F.col("spans"))), "spans")
    rows = rows.withColumn("kept", accepted(F.col("spans"), fitted(rows)))
    base = F.filter("kept", lambda s: s["base"])
    n = lambda k: F.size(F.filter("kept", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return rows.select(F.col("doc_id").alias(id_col), *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
                       F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("kept")).alias("spans"),
                       F.size(F.filter("kept", lambda s: ~s["base"])).cast("long").alias("n_added"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``length_col``, where there is one, is set to the new length of changed texts.
    """
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    t = names[cols.index(text_col)]
    d = docs.toDF(*names)
    found = d.select(span_array(F.col(t)).alias("spans")).where(F.size("spans") > 0).select(judged(F.col("spans")).alias("spans"))
    model = fitted(stage(found, "spans"))
    d = d.withColumn("_a", span_array(F.col(t))).withColumn("_s", accepted(F.col("_a"), model))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("pos"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["pos"]
        text = F.col(t)
        cut = F.concat(text.substr((a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int")), F.element_at(marks, s["kind"] + 1))
        return F.struct(F.when(fresh, F.array_append(a["out"], cut)).otherwise(a["out"]).alias("out"), F.greatest(a["pos"], s["stop"]).alias("pos"))

    end = lambda a: F.concat(F.array_join(a["out"], ""), F.col(t).substr((a["pos"] + 1).cast("int"), F.lit(2147483647)))
    new = F.aggregate("_s", start, step, end)
    changed = F.size("_s") > 0
    out = d.withColumn("_new", F.when(changed, new).otherwise(F.col(t)))
    if length_col in cols:
        n = names[cols.index(length_col)]
        out = out.withColumn(n, F.when(changed, F.length("_new").cast(docs.schema[length_col].dataType)).otherwise(F.col(n)))
    return out.withColumn(t, F.col("_new")).select(*names).toDF(*cols)
