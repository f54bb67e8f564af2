"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' word sequences are put into one automaton (Blumer et al.), each starting at the root, so
no match runs across two items. Training words stream through it: after every word the automaton
knows the longest match that ends there. A match at least one window long marks its words and names
the items that hold its last window. A window is 13 consecutive words of an item; an item of fewer
words is one window itself.

The items are cut into blocks of a bounded number of words, one automaton each. An automaton is the
only thing that is broadcast, one at a time: each further block is another pass over the documents, whose hits are
written, and the hits of a row are put together in the end.

Defined cases: a null or wordless text has no words and no hits; null items and items without words
have no window; an item without an identifier is named by the empty text; equal items all count; repeated documents are judged one by one; an empty benchmark
marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrely.llm.common import append
from acrely.session import cut

WINDOW = 13
BLOCK_WORDS = 100_000  # item words of one automaton
FIELDS = "n_words long, items array<string>, spans array<struct<first:int,last:int>>"

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    """Runs of digits, ASCII letters (in lower case) and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over item words, with the windows each state stands for."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        edges: list[dict[int, int]] = [{}]
        self.shortest = 0
        ends: list[tuple[int, int, str]] = []
        owners: dict[int, set[str]] = {}
        for item, sequence in items:
            if not sequence:
                continue
            need = min(window, len(sequence))
            self.shortest = min(self.shortest or need, need)
            state = 0
            for word in sequence:
                state = self._extend(edges, state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                if len(sequence) >= window:
                    owners.setdefault(state, set()).add(item)
            if len(sequence) < window:
                ends.append((state, len(sequence), item))
        self._name_windows(owners, ends)
        size = max(1, len(self.vocabulary))
        self.next = {s * size + w: t for s, out in enumerate(edges) for w, t in out.items()}

    def _new(self, edges: list[dict[int, int]], length: int, link: int, out: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        edges.append(out)
        return len(edges) - 1

    def _split(self, edges: list[dict[int, int]], p: int, w: int, q: int) -> int:
        """A copy of `q` for the strings that reach it through `p`; takes over their edges."""
        copy = self._new(edges, self.length[p] + 1, self.link[q], dict(edges[q]))
        self.link[q] = copy
        while p >= 0 and edges[p].get(w) == q:
            edges[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, edges: list[dict[int, int]], last: int, w: int) -> int:
        known = edges[last].get(w)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(edges, last, w, known)
        state = self._new(edges, self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in edges[p]:
            edges[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = edges[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(edges, p, w, q)
        return state

    def _name_windows(self, owners: dict[int, set[str]], ends: list[tuple[int, int, str]]) -> None:
        """Per state: the items that hold its window, and the short items its strings may end with."""
        n, size = len(self.length), self.window
        order = sorted(range(1, n), key=self.length.__getitem__)
        held = {s: set(items) for s, items in owners.items() if self.length[s] >= size}
        for s in reversed(order):  # an item in a state is in every suffix of it too
            up = self.link[s]
            if s in held and self.length[up] >= size:
                held.setdefault(up, set()).update(held[s])
        # The state among the suffixes of `s` whose strings include the one of exactly `size` words.
        at = [0] * n
        for s in order:
            at[s] = at[self.link[s]] if self.length[self.link[s]] >= size else s if self.length[s] >= size else 0
        self.window_items = {s: frozenset(held[at[s]]) for s in order if at[s] and at[s] in held}
        mine: dict[int, dict[int, set[str]]] = {}
        for s, length, item in ends:
            mine.setdefault(s, {}).setdefault(length, set()).add(item)
        self.short_items: dict[int, tuple] = {}
        for s in order:
            own = tuple((length, frozenset(items)) for length, items in sorted(mine.get(s, {}).items()))
            all_ = self.short_items.get(self.link[s], ()) + own
            if all_:
                self.short_items[s] = all_

    def match(self, sequence: Sequence[int], offset: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        """Stream one stretch of known words; adds hit spans (first, last) and items."""
        following, link, length, size = self.next, self.link, self.length, max(1, len(self.vocabulary))
        window, shorts, named = self.window, self.short_items, self.window_items
        state = matched = 0
        for i, w in enumerate(sequence, offset):
            after = following.get(state * size + w)
            while after is None and state:
                state = link[state]
                matched = length[state]
                after = following.get(state * size + w)
            if after is None:
                matched = 0
                continue
            state = after
            matched += 1
            if matched >= window:
                spans.append((i - matched + 1, i))
                items |= named[state]
            if state in shorts:
                for n, whose in shorts[state]:
                    if n <= matched:
                        spans.append((i - n + 1, i))
                        items |= whose

    def scan(self, text: bytes | None) -> tuple[int, list[str], list[tuple[int, int]]]:
        """Number of words, items with a window in the text, and merged spans of hit words."""
        found = words(text) if text else []
        if not found or not self.shortest:
            return len(found), [], []
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in found], dtype=np.int64)
        # A word of no item resets the automaton: only stretches of known words that are as long as the
        # shortest window can hold one.
        known = np.flatnonzero(np.diff(np.concatenate(([0], ids >= 0, [0]))))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for first, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - first >= self.shortest:
                self.match(ids[first:end].tolist(), first, spans, items)
        return len(found), sorted(items), merged(spans)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def without(text: bytes, spans: Sequence[tuple[int, int]]) -> bytes:
    """The text without the words `first`..`last` of every span and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for first, last in spans:
        kept.append(text[at:places[first][0]])
        at = places[last][1]
    return b"".join([*kept, text[at:]])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_words: int) -> list[DataFrame]:
    """The items (item, body) in blocks of about `block_words` words."""
    items = benchmark.filter(F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("body"))
    chars = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-chars // (block_words * 4)))  # a word and its blank take four bytes or more as a rule
    return [items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k) for k in range(blocks)]


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _pass(docs: DataFrame, block: DataFrame, text: str, window: int, into: str, keep: Sequence[str] | None) -> tuple[DataFrame, object]:
    """One pass over the documents with the automaton of one block of items, and the broadcast that holds it."""
    automaton = docs.sparkSession.sparkContext.broadcast(
        Automaton(((r.item or "", words(bytes(r.body))) for r in block.toLocalIterator()), window))

    def start():
        scan = automaton.value.scan

        def work(texts):
            found = [scan(t) for t in texts]
            spans = [[{"first": a, "last": b} for a, b in f[2]] for f in found]
            return [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.string())), pa.array(spans, SPANS)]
        return work

    return append(docs, text, start, FIELDS, into, keep), automaton


def _in_passes(docs: DataFrame, blocks: list[DataFrame], text: str, window: int, into: str) -> DataFrame:
    """A pass per block, written before the next begins, so one automaton is held at a time. Hits of a row are put together at the end."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    bodies, hits = rows.select("at", F.col("row")[text].alias("body")), None
    for block in blocks:
        found, automaton = _pass(bodies, block, "body", window, "f", ["at"])
        mine = cut(found.filter(F.size("f.spans") > 0) if hits is not None else found)  # the first also tells the words of every row
        automaton.destroy()
        hits = mine if hits is None else hits.unionByName(mine)
    per_row = hits.groupBy("at").agg(
        F.max("f.n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("f.items")))).alias("items"),
        F.flatten(F.collect_list("f.spans")).alias("spans"))

    def together(batches):
        for batch in batches:
            spans = [[{"first": a, "last": b} for a, b in merged((x["first"], x["last"]) for x in s)] for s in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(
                [batch.column(1), batch.column(2), pa.array(spans, SPANS)], names=["n_words", "items", "spans"])], names=["at", into])

    return rows.join(per_row.mapInArrow(together, f"at long, {into} struct<{FIELDS.replace(' ', ':').replace(',:', ',')}>"), "at").select("row.*", into)


def annotate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "_found", keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with the struct column `into`: n_words, items, spans (first and last hit word), n_hit.

    Items of more than about `block_words` words in all take a pass over the documents for each block of that size.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    blocks = _blocks(benchmark, item_id, item_text, block_words)
    if len(blocks) == 1:
        found, _ = _pass(docs, blocks[0], text, window, into, kept)
    else:
        found = _in_passes(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]), blocks, text, window, into).select(
            *[F.col(f"`{c}`") for c in kept], into)
    hit = F.aggregate(f"{into}.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumn(into, F.col(into).withField("n_hit", hit))


def contaminated(into: str = "_found", share: int = 20) -> Column:
    """At least one word in `share` is part of a benchmark window."""
    return (F.col(f"{into}.n_hit") > 0) & (F.col(f"{into}.n_hit") * share >= F.col(f"{into}.n_words"))


def scrub(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", max_span: int = WINDOW, share: int = 20, **names,
) -> DataFrame:
    """Drop documents over the coverage limit; cut spans of `max_span` words or more out of the others."""
    found = annotate(docs, benchmark, text, **names).filter(~F.coalesce(contaminated(share=share), F.lit(False)))
    long = F.filter("_found.spans", lambda s: s["last"] - s["first"] + 1 >= max_span)
    marked = found.withColumn("_found", F.when(F.size(long) > 0, long))

    def cut_out(batches):
        for batch in batches:
            names_ = batch.schema.names
            at, spans_at = names_.index(text), names_.index("_found")
            texts, spans = batch.column(at).to_pylist(), batch.column(spans_at).to_pylist()
            new = [
                t if t is None or not s else without(t.encode(), [(x["first"], x["last"]) for x in s]).decode()
                for t, s in zip(texts, spans)]
            columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in names_ if n != "_found"])

    return marked.mapInArrow(cut_out, docs.drop("_found").schema)
