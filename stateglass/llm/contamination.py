"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence that occurs in an item. Training texts
stream through it once: after each word the state stands for the longest sequence
of words up to here that occurs in some item, and its length is known. A length of
``window`` or more means that the last ``window`` words are a window of an item;
items shorter than a window count when they occur whole.

The automaton goes to every task, so it is built from items of a checked size; more
items are cut into shards of that size, and each shard is one more pass.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stateglass.llm.common import written

WINDOW = 10
# Text of items in one automaton: about 200,000 words.
SHARD_BYTES = 1 << 20

# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]
)
_FOUND = (
    T.StructType().add("n_words", "long").add("n_hit", "long").add("longest", "long")
    .add("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    .add("items", T.ArrayType(T.StringType()))
)
_FOUND_CUT = T.StructType([*_FOUND.fields, T.StructField("cut", T.StringType())])


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            coded.append((name, ids))
            last = 0
            for word in ids:
                last = self._extend(last, word)
        self._name_windows(coded)

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, word: int) -> int:
        """The state for ``state`` + word, split off if longer sequences share it."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._copy(target, self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # a sequence that an earlier item has
            return self._redirect(last, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._redirect(state, word)
        return new

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _name_windows(self, coded: list[tuple[str | None, list[int]]]) -> None:
        self.items: dict[int, set] = {}
        whole: dict[int, list[tuple[int, set]]] = {}
        for name, ids in coded:
            own = {name} - {None}
            state = 0
            for at, word in enumerate(ids):
                state = self.next[state][word]
                if at + 1 >= self.window:
                    state = self._window_state(state)
                    self.items.setdefault(state, set()).update(own)
            if ids and len(ids) < self.window:
                whole.setdefault(state, []).append((len(ids), own))
        self.top = {s: self._window_state(s) for s in range(len(self.next)) if self.length[s] >= self.window}
        # Whole short items that end where a state ends: its own and those of its suffixes.
        self.short: dict[int, list[tuple[int, set]]] = {}
        if whole:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                found = whole.get(state, []) + self.short.get(self.link[state], [])
                if found:
                    self.short[state] = found

    def search(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set]:
        """(longest match, hit intervals of word positions, items) of a text."""
        steps, link, length = self.next, self.link, self.length
        window, short, top = self.window, self.short, self.top
        state = matched = longest = 0
        hits: list[tuple[int, int]] = []
        items: set = set()
        root = steps[0]
        for at, word in enumerate(map(self.vocabulary.get, words)):
            if word is None:
                state = matched = 0
                continue
            if not state:
                state, matched = root[word], 1
            else:
                following = steps[state].get(word)
                while following is None:
                    state = link[state]
                    matched = length[state]
                    following = steps[state].get(word)
                state = following
                matched += 1
            if matched > longest:
                longest = matched
            if matched >= window:
                items |= self.items[top[state]]
                hits.append((at + 1 - window, at + 1))
            if state in short:
                for size, own in short[state]:
                    if matched >= size:
                        items |= own
                        hits.append((at + 1 - size, at + 1))
        return longest, hits, items


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal intervals; those that touch or overlap become one."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without its words at the spans and what lies between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def _search_column(automaton, cut: bool):
    """``automaton`` is a broadcast; with ``cut`` the text without the hit words comes too."""
    fields = [*_FOUND_ARROW, pa.field("cut", pa.string())] if cut else list(_FOUND_ARROW)

    @F.arrow_udf(_FOUND_CUT if cut else _FOUND)
    def search(texts: pa.Array, before: pa.Array) -> pa.Array:
        own = automaton.value
        out = []
        for text, old in zip(texts.to_pylist(), before.to_pylist()):
            words = normal_words(text)
            longest, hits, items = own.search(words)
            if old:
                hits += [(s["start"], s["end"]) for s in old["spans"]]
                items = items | set(old["items"])
                longest = max(longest, old["longest"])
            spans = joined_spans(hits)
            found = {
                "n_words": len(words),
                "n_hit": sum(e - s for s, e in spans),
                "longest": longest,
                "spans": [{"start": s, "end": e} for s, e in spans],
                "items": sorted(items),
            }
            if cut and spans:
                found["cut"] = cut_words(text, spans).decode()
            out.append(found)
        return pa.array(out, pa.struct(fields))

    # A filter on the result must not make Spark run the search twice.
    return search.asNondeterministic()


def item_shards(items: DataFrame, id_col: str, text_col: str, shard_bytes: int):
    """Lists of (id, words), of about ``shard_bytes`` of text each, and if one is the last."""
    rows = items.select(
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
    ).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    for shard in range(shards):
        own = rows.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard).distinct()
        words = [(r.id, normal_words(bytes(r.text))) for r in own.toLocalIterator()]
        yield words, shard == shards - 1


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    result: str = "found",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_bytes: int = SHARD_BYTES,
    cut: bool = False,
) -> DataFrame:
    """All columns and a struct ``result`` on what the text shares with the items.

    Fields: ``n_words``; ``n_hit``, words inside occurrences of item windows;
    ``longest``, the longest match in words; ``spans``, the hit words as maximal
    intervals; ``items``, the ids with an occurring window, as sorted strings. With
    ``cut`` also the text without the hit spans, null where nothing is hit.

    A null or wordless text has no words. Items without words match nothing; an
    item with a null id makes hits and is not named; items with equal ids or equal
    texts count once per id. Without items nothing is hit. A column that is called
    like ``result`` is replaced.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    before = F.lit(None).cast(_FOUND)
    found = docs
    for own, last in item_shards(items, item_id, item_text, shard_bytes):
        automaton = spark.sparkContext.broadcast(ItemAutomaton(own, window))
        found = found.withColumn(result, _search_column(automaton, cut and last)(text, before))
        if not last:
            found, before = written(found, "contamination"), F.col(f"`{result}`")
    return found


def remove_contamination(
    docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = 0.5, **options
) -> DataFrame:
    """The rows with hit spans cut out of their texts; heavily hit rows are dropped.

    A row goes if more than ``max_coverage`` of its words are hit. From the others
    each span is cut, from the first byte of its first word to the last of its last.
    Rows without a hit come back unchanged, columns too.
    """

    name = "__found"
    found = find_contamination(docs, items, name, text_col, cut=True, **options)
    found = found.where(F.col(f"{name}.n_hit") <= max_coverage * F.col(f"{name}.n_words"))
    text = F.coalesce(F.col(f"{name}.cut"), F.col(f"`{text_col}`").cast("string"))
    return found.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
