"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

Texts are split into pre-tokens block by block; a pre-token's place in a text is kept as the number of its word in the
block. Each block's distinct words are dealt by their hash into buckets, one pack a bucket, so that a word meets all its
occurrences of the table in one task and is merged there once, whatever the number of blocks that hold it: a word that a
third of all pre-tokens consists of is one entry a block. The ids go back to their blocks and are put together by place.
Decoding looks every id up in the table of token bytes.

Null counts as empty; an empty text has no ids. Rows are independent: repeated rows repeat, other columns are ignored
whatever their names, an empty table gives no rows. The table is split twice, once for the words and once for the
places, so its rows must come in the same order when read again, as those of files do; a block that isn't the same the
second time stops the job.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

BLOCK = 4_000_000  # bytes of text a block; a longer text is a block of its own
REMEMBERED = 2_000_000  # words of one bucket kept at a time; beyond it a word may be merged again
STAND_INS = {"letter": "a", "number": "1", "space": " ", "other": "!"}


def ranks_of(file: bytes) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file.splitlines() if line)}


class Splitter:
    """Pre-tokens of texts, by ``pattern``.

    The library's pattern engine and the one used here may know different versions of Unicode. The kind of every
    character beyond ASCII is asked of the library when it is first met; where the answers differ a text is split by a
    shadow in which a character of the right kind stands for it.
    """

    def __init__(self, pattern: str):
        self.pattern, self.find, self.seen, self.shadows = pattern, regex.compile(pattern).findall, set(map(chr, range(128))), {}
        self.kinds = {"letter": regex.compile(r"\p{L}"), "number": regex.compile(r"\p{N}"), "space": regex.compile(r"\s")}

    def ask(self, characters: set[str]) -> None:
        """Learn the kinds of new characters: a character joins its like in one pre-token, which is one token here."""
        new = sorted(characters - self.seen)
        if not new:
            return
        self.seen |= set(new)
        ranks = {bytes([b]): b for b in range(256)}
        for c in new:
            for mark in ("a", "1", "!"):
                ranks.setdefault((mark + c + mark).encode(), len(ranks))
        library = tiktoken.Encoding("kinds", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        joins = lambda c, mark: len(library.encode_ordinary(mark + c + mark)) == 1
        for c in new:
            theirs = "letter" if joins(c, "a") else "number" if joins(c, "1") else "other" if joins(c, "!") else "space"
            ours = next((kind for kind, known in self.kinds.items() if known.fullmatch(c)), "other")
            if ours != theirs:
                self.shadows[ord(c)] = STAND_INS[theirs]

    def split(self, text: str) -> list[str]:
        """All pre-tokens of a text, in order; together they are the text."""
        if not text.isascii():
            own = set(text)
            self.ask(own)
            if self.shadows and any(ord(c) in self.shadows for c in own):
                at, out = 0, []
                for piece in self.find(text.translate(self.shadows)):
                    out.append(text[at : at + len(piece)])
                    at += len(piece)
                return out
        return self.find(text)


class Merger:
    """Ids of single words by merge ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def merge(self, word: bytes) -> list[int]:
        """The adjacent pair of the lowest rank is joined first, the leftmost of equals; a word with a rank is whole."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(ranks[word[i : i + 2]], i) for i in range(n - 1) if word[i : i + 2] in ranks]
        heapq.heapify(agenda)
        while agenda:
            rank, left = heapq.heappop(agenda)
            own, right = parts[left], after[left]
            if own is None or right >= n:
                continue
            pair = own + parts[right]
            if ranks.get(pair) != rank:
                continue  # one of the two has grown since
            parts[left], parts[right] = pair, None
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                joined = ranks.get(pair + parts[follower])
                if joined is not None:
                    heapq.heappush(agenda, (joined, left))
            previous = before[left]
            if previous >= 0:
                joined = ranks.get(parts[previous] + pair)
                if joined is not None:
                    heapq.heappush(agenda, (joined, previous))
        return [ranks[part] for part in parts if part is not None]


class _Numbers(dict):
    """Numbers in the order of first use."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as compressed planes of bytes."""
    return zlib.compress(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, buckets: int):
    """(name, batch, words, their buckets, codes, words a text) of every block; words are ordered by bucket."""
    splitter, part = Splitter(pattern), TaskContext.get().partitionId()
    for number, batch in enumerate(slices(batches, "text", BLOCK)):
        numbers, codes, lengths, digest = _Numbers(), [], [], xxhash.xxh3_64()
        for text in batch.column("text").to_pylist():
            found = splitter.split(text) if text else []
            digest.update(text or "")
            lengths.append(len(found))
            codes.extend(map(numbers.__getitem__, found))
        words = [w.encode() for w in numbers]
        bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        yield f"{part}-{number}-{digest.hexdigest()}", batch, [words[i] for i in order.tolist()], bucket[order], place[np.array(codes, np.int64)], lengths


def _word_packs(pattern: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, words, bucket, _, _ in _blocks(batches, pattern, buckets):
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
            packs = [words[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(packs), pa.string()), pa.array(bucket[cuts[:-1]] if packs else [], pa.int64()),
                 pa.array([_pack(np.array([len(w) for w in pack])) for pack in packs], pa.binary()),
                 pa.array([zlib.compress(b"".join(pack), 1) for pack in packs], pa.binary())],
                ["block", "bucket", "sizes", "data"])

    return run


def _places(pattern: str, buckets: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, batch, words, _, codes, lengths in _blocks(batches, pattern, buckets):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.string()), pa.array([len(words)], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(kind)),
                 pa.array([_pack(np.array(lengths, np.int64))], pa.binary()), pa.array([_pack(codes)], pa.binary())],
                ["block", "words", "docs", "lengths", "codes"])

    return run


def _merged(ranks: dict[bytes, int]):
    """Packs of words to packs of ids; rows come bucket by bucket, so one bucket's words are remembered at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known, held = Merger(ranks).merge, {}, None
        for batch in batches:
            sizes, data = [], []
            for bucket, lengths, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sizes", "data"))):
                if bucket != held or len(known) > REMEMBERED:
                    known, held = {}, bucket
                at, raw, found = 0, zlib.decompress(packed), []
                for length in _unpack(lengths).tolist():
                    word = raw[at : at + length]
                    at += length
                    own = known.get(word)
                    if own is None:
                        own = known[word] = merge(word)
                    found.append(own)
                sizes.append(_pack(np.array([len(ids) for ids in found])))
                data.append(_pack(np.array([i for ids in found for i in ids])))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(sizes, pa.binary()), pa.array(data, pa.binary())], ["block", "bucket", "sizes", "data"])

    return run


def _together(tokens: list[bytes], whole: bool):
    """One block's texts from its places and its packs of ids."""

    def run(places: pa.Table, packs: pa.Table) -> pa.Table:
        if places.num_rows != 1:
            raise ValueError("a block of texts was not the same when read again; write the texts as a table first")
        row = places.to_pylist()[0]
        packs = packs.sort_by("bucket")
        sizes = np.concatenate([np.zeros(0, "<u4"), *map(_unpack, packs.column("sizes").to_pylist())]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *map(_unpack, packs.column("data").to_pylist())])
        if len(sizes) != row["words"]:
            raise ValueError("a block of texts was not the same when read again; write the texts as a table first")
        starts = np.cumsum(sizes) - sizes
        codes, lengths = _unpack(row["codes"]), _unpack(row["lengths"]).astype(np.int64)
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = ids[np.repeat(starts[codes] - ends[:-1], each) + np.arange(ends[-1])] if ends[-1] else ids[:0]
        table = pa.array(tokens, pa.large_binary())
        decoded = table.take(pa.array(flat, pa.uint32()))
        reach = np.frombuffer(decoded.buffers()[1], np.int64)[decoded.offset : decoded.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        plain = memoryview(decoded.buffers()[2]) if len(flat) else memoryview(b"")
        bounds = ends[np.concatenate([[0], np.cumsum(lengths)])].tolist()
        raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B") if len(flat) else memoryview(b"")
        spans = list(zip(bounds, bounds[1:]))
        text = [plain[reach[a] : reach[b]] for a, b in spans]
        columns = [
            pa.array(row["docs"], places.schema.field("docs").type.value_type),
            pa.array([b - a for a, b in spans], pa.int64()),
            pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in spans], pa.string()),
            pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()),
        ]
        if whole:
            columns += [pa.array([flat[a:b].tolist() for a, b in spans], pa.list_(pa.int32())), pa.array([bytes(t).decode() for t in text], pa.string())]
        return pa.Table.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if whole else [])])

    return run


def encoded(docs: DataFrame, file: bytes, pattern: str, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` also the ids and the decoded text.

    ``file`` is a rank file, ``pattern`` what splits a text. Memory is one block of texts, or one bucket's words.
    """
    spark = docs.sparkSession
    ranks = ranks_of(file)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    words = own.mapInArrow(_word_packs(pattern, buckets), "block string, bucket long, sizes binary, data binary")
    found = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged(ranks), words.schema)
    places = own.mapInArrow(_places(pattern, buckets, to_arrow_type(own.schema["doc_id"].dataType)), f"block string, words long, docs array<{kind}>, lengths binary, codes binary")
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return places.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_together(tokens, ids), schema)
