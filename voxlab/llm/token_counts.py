"""Token counts: a BPE tokenizer compiled into deterministic counting transducers.

Two machines count the tokens of a text.

* The *run machine* has two states, inside and outside a run of characters
  that are not white space.  No token spans white space, so a chunk of text is
  summarised by its state map: the count of the runs that lie whole within it,
  and the piece of a run open at either edge (or, when the chunk has no white
  space, the one piece it consists of).  Maps compose associatively.
* The *word machine* reads the characters of one word.  Its states are
  weighted subsets: every position where a token of the correct segmentation
  may have begun, held as (trie node, token before it, tokens emitted beyond
  the common least).  The common least is put on the transition, so that each
  transition is annotated with the tokens it emits.  A segmentation is that of
  the merge rules exactly when each pair of neighbours is what the merges make
  of the two alone, hence (node, token before) is all that needs keeping.
  States are built when first reached.

Texts longer than ``chunk`` code points are cut into chunks dealt out over the
tasks; their maps are then composed in order, per text, first inside blocks of
``FAN_IN`` neighbouring chunks in parallel and then across the blocks.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated ids
keep one row each; the strings of special tokens count as one token each.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Chunks composed by one task at a time; FAN_IN ** 2 chunks exceed the longest string Spark holds.
FAN_IN = 256
#: Bounds of a worker's tables; a table that reaches its bound is emptied and built anew.
MAX_RUNS, MAX_STATES, MAX_PAIRS, CACHED_RUN = 800_000, 150_000, 400_000, 48
NEVER = 1 << 60
#: Up to here case, composition and class of a character are the same in every Unicode version.
SETTLED = "\u024f"

_COMPILED: dict = {}


class WordMachine:
    """Weighted-subset transducer over the symbols of one word."""

    def __init__(self, merges: list[list[str]], end: str):
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.end = end
        tokens = {a + b for a, b in self.rank} | {s for m in self.rank for s in m}
        self.nodes = {""}
        for t in tokens:
            body = t[:-len(end)] if t.endswith(end) else t
            for i in range(1, len(body) + (body is t)):
                self.nodes.add(body[:i])
        self.tokens = tokens
        self.made = {a + b: (a, b) for a, b in self.rank}
        self.edges: dict[tuple[str, int], list[tuple[str, int]] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self._empty()

    def _empty(self) -> None:
        self.ids = {(("", "", 0),): 0}
        self.sets = [(("", "", 0),)]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.ends: list[dict[str, int]] = [{}]

    def symbols(self, token: str) -> list[str]:
        e = self.end
        if token.endswith(e) and len(token) > len(e):
            body = token[:-len(e)]
            return [*body[:-1], body[-1] + e]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The merge rules applied to a list of symbols: lowest rank first, leftmost first."""
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), NEVER))
            if (parts[best], parts[best + 1]) not in rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2:]]
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, int]] | None:
        """(part, rank of the merge that takes it up) of a token's left (0) or right (1) edge as it is built, outermost
        part last; None if the merges don't build the token from its symbols."""
        key = (token, side)
        if key not in self.edges:
            if token not in self.made:
                out = [(token, NEVER)]
            elif self.merged(self.symbols(token)) != [token]:
                out = None
            else:
                pair = self.made[token]
                part = self.edge(pair[side], side)
                out = [*part[:-1], (part[-1][0], self.rank[pair]), (token, NEVER)]
            self.edges[key] = out
        return self.edges[key]

    def follows(self, before: str, token: str) -> bool:
        """Whether the merges leave ``before`` and ``token`` side by side as they are.

        Ranks only rise while a token is built (a pair holding a new part ranks
        after it), so rank is time: the two stay apart unless some pair of
        edge parts that exist at the same time merges before either is taken up.
        """
        key = (before, token)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(before, token)
        return known

    def _apart(self, before: str, token: str) -> bool:
        right = self.edge(token, 0)
        if right is None:
            return False
        if not before:
            return True
        left, i, j = self.edge(before, 1), 0, 0
        while True:
            (a, until_a), (b, until_b) = left[i], right[j]
            r = self.rank.get((a, b))
            if r is not None and r < until_a and r <= until_b:
                return False
            if until_a == until_b == NEVER:
                return True
            if until_a <= until_b:
                i += 1
            else:
                j += 1

    def is_token(self, s: str) -> bool:
        return s in self.tokens or len(s) == 1 or len(s) == 1 + len(self.end) and s.endswith(self.end)

    def _step(self, state: int, c: str) -> tuple[int, int]:
        out = []
        for node, before, n in self.sets[state]:
            longer = node + c
            if longer in self.nodes:
                out.append((longer, before, n))
            if self.is_token(longer) and self.follows(before, longer):
                out.append(("", longer, n + 1))
        least = min(x[2] for x in out)
        key = tuple(sorted((a, b, n - least) for a, b, n in out))
        nxt = self.ids.get(key)
        if nxt is None:
            nxt = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append({})
        self.steps[state][c] = (nxt, least)
        return nxt, least

    def _end(self, state: int, c: str) -> int:
        last = c + self.end
        n = min(n + 1 for node, before, n in self.sets[state] if self.is_token(node + last) and self.follows(before, node + last))
        self.ends[state][c] = n
        return n

    def count(self, word: str) -> int:
        """Tokens of a word of byte symbols, at least one long."""
        if len(self.sets) > MAX_STATES:
            self._empty()
        state = total = 0
        for c in word[:-1]:
            step = self.steps[state].get(c) or self._step(state, c)
            state = step[0]
            total += step[1]
        last = word[-1]
        n = self.ends[state].get(last)
        return total + (self._end(state, last) if n is None else n)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class RunCounter:
    """Counts the tokens of runs between white space; keeps the counts of short runs."""

    def __init__(self, spec: bytes):
        import regex
        self.space = regex.compile(r"\s+")
        j = json.loads(spec)
        m, norm, pre = j["model"], j["normalizer"], j["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in norm["normalizers"]]
        split, byte_level = pre
        if (m["type"], kinds, split["type"], byte_level["type"]) != ("BPE", ["NFC", "Replace", "Lowercase"], "Split", "ByteLevel") \
                or m["dropout"] or m["continuing_subword_prefix"] or m["ignore_merges"] or not m["end_of_word_suffix"]:
            raise ValueError("the compiler knows BPE with word ends over NFC, white space and lower-case rules")
        self.word = regex.compile(split["pattern"]["Regex"])
        from tokenizers import Tokenizer
        self.rules = Tokenizer.from_buffer(spec)
        special = [regex.escape(t["content"]) for t in j["added_tokens"]]
        self.special = regex.compile("|".join(special)) if special else None
        self.hint = j["added_tokens"][0]["content"][:2] if special else None
        self.machine = WordMachine(m["merges"], m["end_of_word_suffix"])
        self.bytes = byte_symbols()
        self.runs: dict[str, int] = {}

    def _plain(self, run: str) -> int:
        """Tokens of a run without special strings.  Beyond the settled letters its words are cut
        by the tokenizer's own normaliser and word rule, whose Unicode version may differ from Python's."""
        count = self.machine.count
        if max(run) > SETTLED:
            return sum(count(w) for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(run)))
        table = self.bytes
        s = run.lower() if run.isascii() else unicodedata.normalize("NFC", run).lower()
        return sum(count("".join([table[b] for b in w.encode()])) for w in self.word.findall(s))

    def of_run(self, run: str) -> int:
        """Tokens of one run; short runs are remembered."""
        n = self.runs.get(run)
        if n is None:
            if self.special is not None and self.special.search(run):
                n = len(self.special.findall(run)) + sum(map(self._plain, filter(None, self.special.split(run))))
            else:
                n = self._plain(run) if run else 0
            if len(run) <= CACHED_RUN:
                if len(self.runs) >= MAX_RUNS:
                    self.runs.clear()
                self.runs[run] = n
        return n

    def split(self, text: str) -> list[str]:
        """Runs between white space, with an empty piece where the text begins or ends in it."""
        return self.space.split(text)

    def of_text(self, text: str) -> int:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() takes these for white space, the tokenizer does not
            return sum(map(self.of_run, self.split(text)))
        get, n, missed = self.runs.get, 0, []
        for run in text.split():
            k = get(run)
            if k is None:
                missed.append(run)
            else:
                n += k
        return n + sum(map(self.of_run, missed))

    def state_map(self, chunk: str) -> tuple[bool, str, int, str]:
        """(has white space, piece open to the left, tokens of whole runs, piece open to the right)."""
        cuts = list(self.space.finditer(chunk, 0))
        if not cuts:
            return False, chunk, 0, ""
        first, last = cuts[0], cuts[-1]
        return True, chunk[:first.start()], self.of_text(chunk[first.end():last.start()]) if len(cuts) > 1 else 0, chunk[last.end():]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring stretches of text."""
        if not a[0] and not b[0]:
            return False, a[1] + b[1], 0, ""
        if not a[0]:
            return True, a[1] + b[1], b[2], b[3]
        if not b[0]:
            return True, a[1], a[2], a[3] + b[1]
        return True, a[1], a[2] + self.of_run(a[3] + b[1]) + b[2], b[3]

    def composed(self, maps: list[tuple]) -> tuple:
        """Balanced composition of neighbouring maps; pieces are joined once a level."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, whole: tuple) -> int:
        return self.of_run(whole[1]) + whole[2] + (self.of_run(whole[3]) if whole[0] else 0)


def compiled(spec) -> RunCounter:
    """The worker's own compiled tokenizer, made once per broadcast."""
    if _COMPILED.get("of") is not spec:
        _COMPILED.update(of=spec, counter=RunCounter(spec.value))
    return _COMPILED["counter"]


_CUT = "row_id long, doc_id {t}, n_bytes long, chunk_no int, n_tokens long, piece string"
_MAP = "row_id long, doc_id {t}, n_bytes long, chunk_no int, n_tokens long, spaced boolean, head string, tail string"


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``.

    ``tokenizer`` names a file that the driver reads; the executors get its
    few megabytes by broadcast.  Short texts are counted where they are read.
    Long ones send their chunks to other tasks, whose maps come back to be
    composed, so no shuffle carries short texts.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        spec = spark.sparkContext.broadcast(f.read())
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    cut_schema, map_schema = _CUT.format(t=kind), _MAP.format(t=kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, row = compiled(spec), TaskContext.get().partitionId() << 36
        for b in batches:
            rows, ids, sizes, nos, counts, pieces = [], [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t or ""
                row += 1
                long = len(t) > chunk
                n = counter.of_text(t) if not long else 0
                for no in range(0, max(1, len(t)), chunk) if long else (0,):
                    rows.append(row)
                    ids.append(i)
                    sizes.append(len(t.encode()) if not no else 0)
                    nos.append(no // chunk)
                    counts.append(n)
                    pieces.append(t[no:no + chunk] if long else None)
            yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(ids, b.schema.field(0).type), pa.array(sizes, pa.int64()),
                                   pa.array(nos, pa.int32()), pa.array(counts, pa.int64()), pa.array(pieces, pa.string())],
                                  names=["row_id", "doc_id", "n_bytes", "chunk_no", "n_tokens", "piece"])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(spec)
        for b in batches:
            maps = [(None, None, n, None) if p is None else counter.state_map(p)
                    for n, p in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            s, h, n, t = zip(*maps, strict=True) if maps else ((), (), (), ())
            yield pa.record_batch([*b.columns[:4], pa.array(n, pa.int64()), pa.array(s, pa.bool_()), pa.array(h, pa.string()), pa.array(t, pa.string())],
                                  names=["row_id", "doc_id", "n_bytes", "chunk_no", "n_tokens", "spaced", "head", "tail"])

    def composer(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter, open_key, held = compiled(spec), None, []
            out: list[dict] = []

            def close() -> None:
                r = held[0]
                if r["spaced"] is None:
                    out.append(r)
                    return
                s, h, n, t = counter.composed([(x["spaced"], x["head"], x["n_tokens"], x["tail"]) for x in held])
                r = r | {"n_bytes": sum(x["n_bytes"] for x in held), "chunk_no": r["chunk_no"] // FAN_IN}
                out.append(r | ({"n_tokens": counter.tokens((s, h, n, t)), "spaced": None, "head": None, "tail": None} if last
                                else {"n_tokens": n, "spaced": s, "head": h, "tail": t}))

            schema = None
            for b in batches:
                schema = b.schema
                for r in b.to_pylist():
                    key = (r["row_id"], 0 if last else r["chunk_no"] // FAN_IN)
                    if held and key != open_key:
                        close()
                        held = []
                    open_key = key
                    held.append(r)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
            if held:
                close()
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        return run

    maps = src.mapInArrow(cut, cut_schema).repartition("row_id", "chunk_no").mapInArrow(mapped, map_schema)
    block = F.expr(f"chunk_no div {FAN_IN}")
    blocks = maps.repartition(F.col("row_id"), block).sortWithinPartitions("row_id", "chunk_no").mapInArrow(composer(False), map_schema)
    whole = blocks.repartition("row_id").sortWithinPartitions("row_id", "chunk_no").mapInArrow(composer(True), map_schema)
    return whole.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
