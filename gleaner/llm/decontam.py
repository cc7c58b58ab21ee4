"""Benchmark decontamination with an FM-index over each shard of the training text.

A shard is what one task gathers from its partition, up to a bound of bytes; nothing is shuffled. Its text is the
sequence of its words, as symbols of the shard's own vocabulary; each end of a text is a separator. A separator sorts
before all words and before later separators, so no comparison of suffixes passes one. The shard's suffixes are sorted
by prefix doubling, the Burrows-Wheeler sequence goes into a wavelet matrix with rank counts, and every test phrase is
found by backward search; its occurrences are located by walking to the next sampled suffix position. The index knows
nothing of the phrases, so one index answers every block of them. Merged occurrences are the spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut

#: Bytes of text in a shard, unless one text has more; of test items that are searched for at once; and of test items that are sent out for one pass.
SHARD_BYTES, BLOCK_BYTES, PASS_BYTES = 4 << 20, 4 << 20, 64 << 20
SAMPLE = 8
#: Occurrences that are located at once.
AT_ONCE = 1 << 19

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ODD = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, unless one text has more.
HASH_BYTES = 1 << 20


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte and 64-bit hash of each word: a maximal run of digits, letters and non-ASCII bytes, A-Z folded."""
    folded = _FOLD[np.frombuffer(data, np.uint8)]
    inside = np.concatenate(([False], folded != 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return begin, end, np.empty(0, np.uint64)
    n = 1 << len(folded).bit_length()
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(folded * _powers(_ODD, n)[: len(folded)], dtype=np.uint64)))
    h = (total[end] - total[begin]) * _powers(pow(_ODD, -1, 1 << 64), n)[begin]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return begin, end, h ^ (h >> np.uint64(29))


class Phrases:
    """The windows of a block of test items: where they begin in the items' words, and whose they are, by length."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        hashed = [(i, words_of((t or "").encode("utf-8", "surrogatepass"))[2]) for i, t in items]
        hashed = [(i, h) for i, h in hashed if len(h)]
        self.hashes = np.concatenate([h for _, h in hashed] or [np.empty(0, np.uint64)])
        self.items: list[object] = list(dict.fromkeys(i for i, _ in hashed))
        number = {x: k for k, x in enumerate(self.items)}
        owner = np.array([number[i] for i, _ in hashed], np.int64)
        length = np.array([len(h) for _, h in hashed], np.int64)
        first = np.cumsum(length) - length
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(length, window)).tolist():
            own = np.flatnonzero(np.minimum(length, window) == n)
            many = length[own] - n + 1
            begin = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            self.by_length[n] = begin, np.repeat(owner[own], many)


def sorted_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; 0 is a separator, and the last symbol is one.

    A separator ends the comparison, an earlier one sorting first. The first sort packs as many symbols as fit
    in 64 bits; then only suffixes that still tie are sorted by the rank of what follows, twice as far each time.
    """
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    depth = max(1, min(62 // bits, 16))
    key, going = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(depth):
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - k)] = symbols[k:]
        key = key << bits | np.where(going, ahead, 0)
        going &= ahead != 0
    order = np.argsort(key, kind="stable")  # ties that end at a separator are by position, which is by separator
    tied = going[order]  # no separator yet
    same = np.concatenate(([False], (key[order][1:] == key[order][:-1]) & tied[1:]))
    rank = np.empty(n, np.int64)
    at = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(same, 0, at))
    open_ = same | np.concatenate((same[1:], [False]))
    while open_.any():
        slots = np.flatnonzero(open_)
        which = order[slots]
        further = rank[which] << 32 | rank[which + depth]
        by = np.argsort(further, kind="stable")
        order[slots] = which[by]
        further = further[by]
        same = np.concatenate(([False], further[1:] == further[:-1]))
        rank[order[slots]] = np.maximum.accumulate(np.where(same, 0, slots))
        open_[slots] = same | np.concatenate((same[1:], [False]))
        depth *= 2
    return order


class Ranked:
    """A bit vector with counts of ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate((packed, np.zeros(16 - len(packed) % 8, np.uint8))).view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FMIndex:
    def __init__(self, symbols: np.ndarray):
        order = sorted_suffixes(symbols)
        counts = np.bincount(symbols)
        self.first = np.cumsum(counts) - counts  # rows whose suffix begins with a smaller symbol
        self.size = len(symbols)
        last = symbols[order - 1].astype(np.int32)  # the symbol before the first is the last, a separator
        self.depth = max(1, int(symbols.max()).bit_length())
        self.levels: list[tuple[Ranked, int]] = []
        for level in reversed(range(self.depth)):
            ones = (last >> level & 1).astype(bool)
            self.levels.append((Ranked(ones), int(len(ones) - ones.sum())))
            last = np.concatenate((last[~ones], last[ones]))
        by = np.argsort(self._spread(np.arange(len(counts))))  # the last level holds symbols in this order
        self.base = np.empty(len(counts), np.int64)
        self.base[by] = np.cumsum(counts[by]) - counts[by]
        starts = np.concatenate(([True], symbols[:-1] == 0))
        sampled = (starts | (np.arange(self.size) % SAMPLE == 0))[order]
        self.sampled, self.place = Ranked(sampled), order[sampled]

    def _spread(self, symbols: np.ndarray) -> np.ndarray:
        """The order in which the last level holds symbols: by their bits from the last to the first."""
        out = np.zeros(len(symbols), np.int64)
        for level in range(self.depth):
            out |= (symbols >> level & 1) << (self.depth - 1 - level)
        return out

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the first i rows of the Burrows-Wheeler sequence."""
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, zeros + ones, i - ones)
        return i - self.base[symbol]

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier."""
        symbol, i = np.zeros(len(row), np.int64), row
        for bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return self.first[symbol] + i - self.base[symbol]

    def search(self, symbols: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes begin with the n symbols from each place on, by backward search; all are known to the index."""
        low, high = np.zeros(len(begin), np.int64), np.full(len(begin), self.size)
        for k in reversed(range(n)):
            go = np.flatnonzero(low < high)
            symbol = symbols[begin[go] + k]
            low[go] = self.first[symbol] + self.rank(symbol, low[go])
            high[go] = self.first[symbol] + self.rank(symbol, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: back to a sampled one; a stretch's first position is sampled, so no walk passes a separator."""
        out, steps, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            found = self.sampled.get(rows)
            out[left[found]] = self.place[self.sampled.rank(rows[found])] + steps
            left, rows, steps = left[~found], rows[~found], steps + 1
            rows = self.step(rows)
        return out


class Shard:
    """The words of some texts and the FM-index over them."""

    def __init__(self, texts: list[bytes]):
        self.text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        parts, low = [], 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(self.text_at, self.text_at[low] + HASH_BYTES, "right")) - 1)
            b, e, h = words_of(b"\0".join(texts[low:high]) + b"\0")
            parts.append((b + self.text_at[low], e + self.text_at[low], h))
            low = high
        self.begin, self.end, hashes = (np.concatenate(x) for x in zip(*parts))
        self.of_text = np.searchsorted(self.text_at, self.begin, "right") - 1
        self.words = np.bincount(self.of_text, minlength=len(texts))
        self.first_word = np.cumsum(self.words) - self.words
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        del hashes
        self.index = None
        if len(symbols):
            ends = np.flatnonzero(np.diff(self.of_text, append=-1)) + 1  # after the last word of each text
            self.place = np.insert(np.arange(len(symbols)), ends, -1)
            self.index = FMIndex(np.insert(symbols + 1, ends, 0))

    def find(self, phrases: Phrases, cover: np.ndarray, found: list[set]) -> None:
        """Adds the occurrences of a block's windows to cover (differences by word) and their items to found (by text)."""
        if self.index is None or not len(phrases.hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, phrases.hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == phrases.hashes, at + 1, 0)
        strange = np.concatenate(([0], np.cumsum(symbol == 0)))
        for n, (begin, owner) in phrases.by_length.items():
            known = strange[begin + n] == strange[begin]
            begin, owner = begin[known], owner[known]
            low, high = self.index.search(symbol, begin, n)
            there = np.flatnonzero(low < high)
            if not len(there):
                continue
            # equal windows have equal rows: each is located once
            low, first, window = np.unique(low[there], return_index=True, return_inverse=True)
            count = high[there][first] - low
            pairs = np.unique(np.stack((window, owner[there]), axis=1), axis=0)
            owned = np.searchsorted(pairs[:, 0], np.arange(len(low) + 1))
            done = np.cumsum(count)
            for part in range(0, int(done[-1]), AT_ONCE):
                k = np.arange(part, min(part + AT_ONCE, int(done[-1])))
                w = np.searchsorted(done, k, "right")
                word = self.place[self.index.locate(low[w] + k - (done[w] - count[w]))]
                np.add.at(cover, word, 1)
                np.add.at(cover, word + n, -1)
                for pair in np.unique(self.of_text[word] * len(low) + w).tolist():
                    x = pair % len(low)
                    found[pair // len(low)].update(phrases.items[o] for o in pairs[owned[x] : owned[x + 1], 1].tolist())


def search_shard(texts: list[bytes], blocks: Iterator[Phrases], before: list[list[tuple[int, int]]]) -> list[tuple[int, np.ndarray, np.ndarray, set]]:
    """For each text its words, merged spans of hit words as rows (begin, end), their bytes, and the items found.

    before has the spans that an earlier pass found in each text; they are merged with these.
    """
    shard = Shard(texts)
    cover = np.zeros(len(shard.begin) + 1, np.int64)
    for t, spans in enumerate(before):
        for a, b in spans:
            cover[shard.first_word[t] + a] += 1
            cover[shard.first_word[t] + b] -= 1
    found: list[set] = [set() for _ in texts]
    for phrases in blocks:
        shard.find(phrases, cover, found)
    hit = np.cumsum(cover[:-1]) > 0
    # spans end with their text
    opens = hit & ~(np.concatenate(([False], hit[:-1])) & (np.diff(shard.of_text, prepend=-1) == 0))
    closes = hit & ~(np.concatenate((hit[1:], [False])) & (np.diff(shard.of_text, append=-1) == 0))
    o, c = np.flatnonzero(opens), np.flatnonzero(closes)
    owner = shard.of_text[o]
    out = []
    for t in range(len(texts)):
        a, b = np.searchsorted(owner, t), np.searchsorted(owner, t, "right")
        spans = np.stack((o[a:b], c[a:b] + 1), axis=1) - shard.first_word[t]
        cut_at = np.stack((shard.begin[o[a:b]], shard.end[c[a:b]]), axis=1) - shard.text_at[t]
        out.append((int(shard.words[t]), spans, cut_at, found[t]))
    return out


def _passes(items: DataFrame, block_bytes: int, pass_bytes: int) -> Iterator[list[list[tuple[object, str | None]]]]:
    """The query set, as blocks of items for each pass; the driver holds one pass's bytes at a time."""
    blocks: list[list] = [[]]
    held = own = 0
    for row in items.toLocalIterator():
        n = len((row.text or "").encode("utf-8", "surrogatepass"))
        if blocks[-1] and held + n > pass_bytes:
            yield blocks
            blocks, held, own = [[]], 0, 0
        elif blocks[-1] and own + n > block_bytes:
            blocks.append([])
            own = 0
        blocks[-1].append((row.item_id, row.text))
        held, own = held + n, own + n
    yield blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), item_col: str = "item_id", item_text: str = "text", window: int = 10, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Each row's `keep` columns with n_words, n_hit, items (sorted array of strings), spans and clean_text.

    A window is `window` consecutive words of an item, or all of a shorter item's; a word inside any occurrence
    of a window is hit. spans are merged stretches of hit words as [begin, end) word numbers; clean_text is the
    text without the characters from the first to the last word of each span (the text itself if nothing is hit).
    A null text has no words and stays null. Null item ids, null item texts and items without words are ignored;
    repeated items count once. One row comes out for each that goes in.

    The items are the stated query set. They are broadcast at most `pass_bytes` at a time, and within a task each
    shard's index is searched for one block of at most `block_bytes` after the other. Where a benchmark needs more
    than one pass, the rows with what was found so far are checkpointed between passes and the broadcast is dropped,
    so neither the driver nor an executor ever holds more of it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull())
    kept = [f"k{i}" for i in range(len(keep))]
    span_type = "array<struct<begin:int,end:int>>"
    inner = docs.select(*(F.col(c).alias(k) for k, c in zip(kept, keep)), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast(span_type).alias("spans"), F.col(text_col).alias("text"))
    fields = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(kept, keep))
    rows = inner
    many = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > pass_bytes
    after = ", text string" if many else ""  # a further pass needs the texts again
    sent = None
    for blocks in _passes(items, block_bytes, pass_bytes):
        if sent is not None:
            inner = cut(rows.select(*kept, "items", "spans", "text"))
            sent.unpersist(blocking=True)
        sent = spark.sparkContext.broadcast(blocks)
        rows = inner.mapInArrow(_search(sent, window, shard_bytes, many), f"{fields}n_words long, n_hit long, items array<string>, spans {span_type}, clean_text string{after}")
    return rows.select(*(F.col(k).alias(c) for k, c in zip(kept, keep)), "n_words", "n_hit", "items", "spans", "clean_text")


def _search(sent: Broadcast, window: int, shard_bytes: int, texts_too: bool):
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def answered(rows: pa.Table, blocks: Iterator[Phrases]) -> pa.Table:
        texts = rows.column("text").to_pylist()
        known = [[(x["begin"], x["end"]) for x in own or []] for own in rows.column("spans").to_pylist()]
        listed = rows.column("items").to_pylist()
        distinct = {t: k for k, t in enumerate(dict.fromkeys(t or "" for t in texts))}
        raw = [t.encode("utf-8", "surrogatepass") for t in distinct]
        before: list[list[tuple[int, int]]] = [[] for _ in raw]
        for t, own in zip(texts, known):
            before[distinct[t or ""]] = own  # equal texts have equal spans
        got = search_shard(raw, blocks, before)
        columns: list[list] = [[], [], [], [], []]
        for text, old in zip(texts, listed):
            at = distinct[text or ""]
            n, spans, cuts, items_found = got[at]
            clean = text
            if len(cuts):
                edges = [0, *cuts.ravel().tolist(), len(raw[at])]
                clean = b"".join(raw[at][a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "surrogatepass")
            for column, value in zip(columns, (n, int((spans[:, 1] - spans[:, 0]).sum()), sorted({*items_found, *(old or [])}), [{"begin": a, "end": b} for a, b in spans.tolist()], clean)):
                column.append(value)
        out = rows.drop_columns(["items", "spans", "text"])
        for name, kind, column in zip(("n_words", "n_hit", "items", "spans", "clean_text"), (pa.int64(), pa.int64(), pa.list_(pa.string()), span_type, pa.string()), columns):
            out = out.append_column(name, pa.array(column, kind))
        return out.append_column("text", rows.column("text")) if texts_too else out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = Phrases(sent.value[0], window) if len(sent.value) == 1 else None

        def blocks() -> Iterator[Phrases]:
            for one in sent.value:
                yield only or Phrases(one, window)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
            for i, n in enumerate(sizes):
                size += n
                if size >= shard_bytes:
                    yield from answered(pa.Table.from_batches([*held, batch.slice(at, i + 1 - at)]), blocks()).to_batches()
                    held, size, at = [], 0, i + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield from answered(pa.Table.from_batches(held), blocks()).to_batches()

    return search
