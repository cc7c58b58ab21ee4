"""Two tokenizers' tokens of the same text, aligned by the bytes that they own.

Each token's number is repeated over its bytes, for a byte-level BPE (A) and for a piece model (B). Where neighbouring
bytes have another owner in A or B, a new pair of owners overlaps; where both change at once the text is cut. Between
two cuts lie the tokens of one group, and every A token of a group is linked with every B token of it.

Both tokenizers cut before white space that follows something else, so a text is encoded and aligned by chunks, runs of
white space with the word after it; a task does each distinct chunk once and remembers it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.bpe import PATTERN, Vocabulary
from gleaner.llm.common import cut

#: Characters of text that a task aligns at once, and that share one look at the corpus' counts; chunks that a task remembers.
CHARS_AT_ONCE, REMEMBERED = 1 << 21, 300_000
SPACE = "▁"


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte the number of the token that it belongs to."""
    return np.repeat(np.arange(len(lengths)), lengths)


def overlaps_and_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From byte owners of one text: the A and the B token of each overlap, in order, and the byte where each group ends."""
    if not len(a):
        return (np.empty(0, np.int64),) * 3
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    first = np.concatenate(([0], np.flatnonzero(new_a | new_b) + 1))
    return a[first], b[first], np.append(np.flatnonzero(new_a & new_b) + 1, len(a))


class Ragged:
    """Lists of numbers one after the other, which grows at its end."""

    def __init__(self, kind: type = np.int32) -> None:
        self.begin, self.count, self.values = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, kind)

    def add(self, counts: np.ndarray, values: np.ndarray) -> None:
        self.begin = np.concatenate((self.begin, len(self.values) + np.cumsum(counts) - counts))
        self.count, self.values = np.concatenate((self.count, counts.astype(np.int32))), np.concatenate((self.values, values.astype(self.values.dtype)))

    def of(self, which: np.ndarray) -> np.ndarray:
        """The lists of the given numbers, joined."""
        each = self.count[which].astype(np.int64)
        return self.values[np.repeat(self.begin[which] - np.cumsum(each) + each, each) + np.arange(each.sum())].astype(np.int64)


class Aligner:
    """Chunks of text with both tokenizers' ids, their groups and their links."""

    def __init__(self, tokenizer_json: str, piece_model: bytes, pattern: str = PATTERN, tokens: bool = True):
        """With `tokens` ids, overlaps and cuts of chunks are remembered, too."""
        from sentencepiece import SentencePieceProcessor

        self.a = Vocabulary(tokenizer_json, pattern)
        self.b = SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes, words = [], []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.b_bytes.append(piece.replace(SPACE, " ").encode())
                if not self.b.is_control(i) and not self.b.is_unknown(i):
                    words.append(piece.replace(SPACE, " "))
        self.b_length = np.array([len(x) for x in self.b_bytes], np.int64)
        #: Without pieces that hold a line break, what follows one is encoded alike everywhere: a chunk can stand for itself.
        self.apart = not any("\n" in w for w in words)
        # a chunk goes on over white space that some piece has after something else
        inside = "".join(sorted({c for w in words for c in regex.findall(r"\S(\s)", w)}))
        self.chunks = regex.compile(rf"\s+\S*(?:[{regex.escape(inside)}]\s*\S*)*" if inside else r"\s+\S*").findall
        self.names_of_a = [f"{i}{end}" for i in range(len(self.a.bytes_of)) for end in ",|"]
        self.names = self.names_of_a + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.foreign, self.sizes = np.empty(0, bool), np.empty((0, 4), np.int64)
        self.ids_a, self.ids_b, self.over_a, self.over_b, self.cuts, self.times = (Ragged() for _ in range(6))
        self.links = Ragged(np.int64)

    def _ids(self, texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B, and how many each text has; none where their bytes are not the text's.

        A cuts between a chunk that ends in a word and the next one, so such chunks go to it as one text. B adds a space
        before what it gets: a whole text comes without its own, a chunk after a line break, whose two ids go.
        """
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        a = np.concatenate([np.empty(0, np.int32), *self.a.encode(["".join(texts)] if not whole else texts)]).astype(np.int64)
        n_a = np.diff(np.searchsorted(np.cumsum(self.a.length_of[a]), np.cumsum(sizes), "right"), prepend=0)
        lists = self.b.encode([t[1:] for t in texts] if whole else ["\n" + t for t in texts], num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        if not whole:
            stay = np.ones(len(b), bool)
            begin = np.cumsum(n_b) - n_b
            stay[begin] = stay[begin + 1] = False
            b, n_b = b[stay], n_b - 2
        of_b = np.bincount(owners(n_b), weights=self.b_length[b], minlength=len(texts))
        foreign = of_b != sizes
        if foreign.any() or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(raw):
            ends = np.cumsum(n_b).tolist()
            foreign = np.array([b"".join(map(self.b_bytes.__getitem__, b[i:j].tolist())) != r for i, j, r in zip([0, *ends], ends, raw)])
            a, b = a[~foreign[owners(n_a)]], b[~foreign[owners(n_b)]]
            n_a, n_b = np.where(foreign, 0, n_a), np.where(foreign, 0, n_b)
        self.foreign = np.concatenate((self.foreign, foreign))
        return a, b, n_a, n_b

    def learn(self, texts: list[str], whole: bool = False) -> None:
        """Encodes and aligns chunks, each of which begins with white space; their numbers follow those known before."""
        flat_a, flat_b, n_a, n_b = self._ids(texts, whole)
        chunk_a, size_a, size_b = owners(n_a), self.a.length_of[flat_a], self.b_length[flat_b]
        over_a, over_b, ends = overlaps_and_cuts(owners(size_a), owners(size_b))
        # the group of a token: that in which its last byte lies
        group_a, group_b = np.searchsorted(ends, np.cumsum(size_a), "left"), np.searchsorted(ends, np.cumsum(size_b), "left")
        chunk_of_group = np.zeros(len(ends), np.int64)
        chunk_of_group[group_a] = chunk_a
        codes, times, chunk_of_link, n_links = self._links(flat_a, group_a, flat_b, group_b, len(ends), chunk_of_group)

        def count(x: np.ndarray) -> np.ndarray:
            return np.bincount(x, minlength=len(texts)).astype(np.int64)

        if self.tokens:
            byte_base = np.concatenate(([0], np.cumsum(np.bincount(chunk_a, weights=size_a, minlength=len(texts)).astype(np.int64))))
            chunk_of_overlap = chunk_a[over_a]
            self.ids_a.add(n_a, flat_a)
            self.ids_b.add(n_b, flat_b)
            self.over_a.add(count(chunk_of_overlap), over_a - (np.cumsum(n_a) - n_a)[chunk_of_overlap])
            self.over_b.add(count(chunk_of_overlap), over_b - (np.cumsum(n_b) - n_b)[chunk_of_overlap])
            self.cuts.add(count(chunk_of_group), ends - byte_base[chunk_of_group])
        self.links.add(count(chunk_of_link), codes)
        self.times.add(count(chunk_of_link), times)
        linked = np.bincount(chunk_of_group, weights=n_links, minlength=len(texts)).astype(np.int64)
        self.sizes = np.concatenate((self.sizes, np.stack((n_a, n_b, count(chunk_of_group), linked), axis=1)))
        if not whole:
            self.known.update(zip(texts, range(len(self.groups), len(self.groups) + len(texts))))
        self.groups.extend(self._texts(flat_a, group_a, flat_b, group_b, n_a, n_b))

    def _links(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, groups: int, chunk: np.ndarray):
        """Id pairs as a * |B| + b, how often each is linked in its chunk, that chunk; and each group's number of links.

        Ids that a group holds several times meet once, with the product of their numbers.
        """

        def distinct(ids: np.ndarray, group: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            key, n = np.unique(group * width + ids, return_counts=True)
            at = key // width
            each = np.bincount(at, minlength=groups)
            return key % width, n, each, np.cumsum(each) - each

        wide_a, wide_b = len(self.a.bytes_of), len(self.b_bytes)
        own_a, times_a, each_a, from_a = distinct(a, group_a, wide_a)
        own_b, times_b, each_b, from_b = distinct(b, group_b, wide_b)
        each = each_a * each_b
        g = np.repeat(np.arange(groups), each)
        k = np.arange(len(g)) - np.repeat(np.cumsum(each) - each, each)
        x, y = from_a[g] + k // each_b[g], from_b[g] + k % each_b[g]
        pairs = wide_a * wide_b
        key, at = np.unique(chunk[g] * pairs + own_a[x] * wide_b + own_b[y], return_inverse=True)
        times = np.bincount(at, weights=times_a[x] * times_b[y], minlength=len(key)).astype(np.int64)
        return key % pairs, times, key // pairs, np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups)

    def _texts(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """`a1,a2|b1;` for each group of each chunk: a token's place is its number plus that of the other side's tokens before it."""
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True)[: len(a)], np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        code = np.empty(len(a) + len(b), np.int64)
        code[at_a], code[at_b] = 2 * a + last_a, 2 * b + last_b + len(self.names_of_a)
        names = list(map(self.names.__getitem__, code.tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        return ["".join(names[low:high]) for low, high in zip([0, *ends], ends)]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks; none where a tokenizer gives other bytes than the text's."""
        parts = [self.chunks(" " + t) if t and self.apart else [] for t in texts]
        new = list({c for own in parts for c in own if c not in self.known})
        if len(self.groups) + len(new) > REMEMBERED and self.groups:
            self.forget()
            new = list({c for own in parts for c in own})
        solid = [c for c in new if not c[-1].isspace()]
        if solid:
            self.learn(solid)
        for c in new:
            if c[-1].isspace():
                self.learn([c])
        out = []
        for text, own in zip(texts, parts):
            which = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            if text and (not own or self.foreign[which].any()):
                self.learn([" " + text], whole=True)  # chunks that differ may make up for each other
                which = np.array([] if self.foreign[-1] else [len(self.groups) - 1], np.int64)
            out.append(which)
        return out


_HELD: dict[tuple, Aligner] = {}


def _aligner(tokenizer_json: str, piece_model: bytes, pattern: str, tokens: bool) -> Aligner:
    """The task's process keeps one aligner."""
    key = hash(tokenizer_json), hash(piece_model), pattern, tokens
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Aligner(tokenizer_json, piece_model, pattern, tokens)
    return _HELD[key]


def pack(codes: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted codes as differences, and numbers of times, with the bytes of equal weight side by side."""
    values = np.concatenate((np.diff(codes, prepend=0), times)).astype("<i8")
    return zlib.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(values[: len(values) // 2]), values[len(values) // 2 :]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    low, texts, held = 0, [], 0
    for at, value in enumerate(column):
        text = value.as_py() or ""
        if texts and held + len(text) > CHARS_AT_ONCE:
            yield low, texts
            low, texts, held = at, [], 0
        texts.append(text)
        held += len(text)
    if texts:
        yield low, texts


_OUTPUTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string", "ids_a": "array<bigint>", "ids_b": "array<bigint>", "overlaps": "array<struct<a: bigint, b: bigint>>", "cuts": "array<bigint>", "block": "bigint", "links": "binary"}


def align(docs: DataFrame, tokenizer_json: str, piece_model: bytes, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids_a", "ids_b", "overlaps", "cuts"), pattern: str = PATTERN) -> DataFrame:
    """Each row's `keep` columns with the `outputs` asked for, of space+text by A and of text by B, which adds the space.

    ids_a, ids_b; overlaps: the pairs (A token, B token) that share bytes, by their places, in order; cuts: the bytes of
    space+text where groups end; groups: `a1,a2|b1;a3|b2,b3`, the ids of each group; n_a, n_b, n_groups, n_links: the
    numbers of tokens, groups and linked pairs of tokens; block, links: input of `link_counts`. Null and empty texts, and
    texts whose tokens make up other bytes than space+text, have no tokens: zeros and empty values. Strings of special
    tokens are plain text. Rows that repeat, or have null ids, each give a row; other columns are not read. A group whose
    sides hold many different ids makes all their pairs, as links are defined; equal ids count without being paired.
    The files' contents (2 MB) are broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer_json, piece_model, pattern, bool({"ids_a", "ids_b", "overlaps", "cuts"} & set(outputs))))
    names = [f"k{i}" for i in range(len(keep))]
    inner = docs.select(F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in zip(names, keep)))
    fields = [f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(names, keep)] + [f"x_{o} {_OUTPUTS[o]}" for o in outputs]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = _aligner(*sent.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for low, texts in _parts(batch.column(0)):
                made = _columns(aligner, texts, outputs, block)
                yield pa.RecordBatch.from_arrays([*batch.slice(low, len(texts)).columns[1:], *made], [*names, *(f"x_{o}" for o in outputs)])
                block += 1

    out = inner.mapInArrow(aligned, ", ".join(fields))
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), *(F.col(f"x_{o}").alias(o) for o in outputs))


def _columns(aligner: Aligner, texts: list[str], outputs: tuple[str, ...], block: int) -> list[pa.Array]:
    which = aligner.of(texts)
    n_chunks = np.array([len(w) for w in which], np.int64)
    flat, doc = np.concatenate([np.empty(0, np.int64), *which]), owners(n_chunks)
    per_chunk = aligner.sizes[flat]
    sizes = np.stack([np.bincount(doc, weights=per_chunk[:, k], minlength=len(texts)).astype(np.int64) for k in range(4)], axis=1)

    def shifted(lists: Ragged, by: np.ndarray) -> np.ndarray:
        """Values counted from their text's begin: each chunk's go on after those of the chunks before it."""
        before = np.cumsum(by) - by
        begin = np.cumsum(n_chunks) - n_chunks
        total = np.append(before, by.sum())
        return lists.of(flat) + np.repeat(before - np.repeat(total[begin], n_chunks), lists.count[flat])

    def listed(values: np.ndarray | pa.Array, each: np.ndarray) -> pa.Array:
        sums = np.bincount(doc, weights=each, minlength=len(texts)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sums))).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))

    def make(name: str) -> pa.Array:
        if name == "block":
            return pa.array(np.full(len(texts), block, np.int64))
        if name in ("n_a", "n_b", "n_groups", "n_links"):
            return pa.array(sizes[:, ("n_a", "n_b", "n_groups", "n_links").index(name)])
        if name == "groups":
            return pa.array(["".join([aligner.groups[k] for k in own.tolist()])[:-1] for own in which], pa.string())
        if name in ("ids_a", "ids_b"):
            lists = aligner.ids_a if name == "ids_a" else aligner.ids_b
            return listed(lists.of(flat), lists.count[flat])
        if name == "overlaps":
            both = [pa.array(shifted(lists, per_chunk[:, k])) for k, lists in enumerate((aligner.over_a, aligner.over_b))]
            return listed(pa.StructArray.from_arrays(both, ["a", "b"]), aligner.over_a.count[flat])
        if name == "cuts":
            ends = np.array([aligner.cuts.values[b + n - 1] if n else 0 for b, n in zip(aligner.cuts.begin[flat].tolist(), aligner.cuts.count[flat].tolist())], np.int64)
            return listed(shifted(aligner.cuts, ends), aligner.cuts.count[flat])
        wide = len(aligner.a.bytes_of) * len(aligner.b_bytes)
        key, at = np.unique(np.repeat(doc, aligner.links.count[flat]) * wide + aligner.links.of(flat), return_inverse=True)
        times = np.bincount(at, weights=aligner.times.of(flat), minlength=len(key)).astype(np.int64)
        ends = np.searchsorted(key, np.arange(len(texts) + 1) * wide)
        return pa.array([pack(key[i:j] % wide, times[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())], pa.binary())

    return [make(o) for o in outputs]


def piece_count(piece_model: bytes) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=piece_model).get_piece_size()


def link_counts(blocks: DataFrame, wide_b: int) -> DataFrame:
    """(a, b, documents, best) for each linked id pair of the corpus: best tells whether no pair of that A id is in more documents."""
    counts = blocks.groupBy("code").agg(F.sum("documents").alias("documents"))
    counts = counts.select("code", F.floor(F.col("code") / wide_b).alias("a"), F.pmod("code", F.lit(wide_b)).alias("b"), "documents")
    highest = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(highest, "a").select("code", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def blocks_of_links(aligned: DataFrame) -> DataFrame:
    """(block, code, documents): the distinct links of each block of documents, and in how many of them each is."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out() -> pa.RecordBatch:
            code, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block, np.int64)), pa.array(code), pa.array(n.astype(np.int64))], ["block", "code", "documents"])

        for batch in batches:
            for own, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != block and held:
                    yield out()
                    held = []
                block = own
                held.append(unpack(packed.as_py())[0])
        if held:
            yield out()

    return aligned.select("block", "links").mapInArrow(summed, "block bigint, code bigint, documents bigint")


def scored(aligned: DataFrame, wide_b: int, keep: tuple[str, ...]) -> DataFrame:
    """`keep` with n_best and count_sum of each row of `aligned` (which has block and links), against the whole corpus.

    The distinct links of a block of documents are looked up together: they go out by link, come back by block with
    their counts, and meet the block's documents there. What a group holds is one block and its links, both bounded;
    a link that all documents hold has one row for each block.
    """
    blocks = cut(blocks_of_links(aligned))
    rated = blocks.select("block", "code").join(link_counts(blocks, wide_b).select("code", "documents", "best"), "code")
    names = [f"k{i}" for i in range(len(keep))]
    rows = aligned.select("block", "links", *(F.col(c).alias(k) for k, c in zip(names, keep)))
    fields = "".join(f"{k} {aligned.schema[c].dataType.simpleString()}, " for k, c in zip(names, keep))

    def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(codes := found["code"].to_numpy())
        codes, documents, best = codes[order], found["documents"].to_numpy()[order], found["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for packed in rows["links"]:
            own, times = unpack(packed.as_py())
            at = np.searchsorted(codes, own)
            n_best.append(int(times[best[at]].sum()) if len(at) else 0)
            count_sum.append(int((times * documents[at]).sum()) if len(at) else 0)
        return pa.table([*(rows[k] for k in names), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*names, "n_best", "count_sum"])

    out = rows.groupBy("block").cogroup(rated.groupBy("block")).applyInArrow(summed, f"{fields}n_best bigint, count_sum bigint")
    return out.select(*(F.col(k).alias(c) for k, c in zip(names, keep)), "n_best", "count_sum")
