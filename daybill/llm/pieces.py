"""SentencePiece encoding and decoding for merge-type vocabularies with byte fallback.

A text is cut where no piece can reach across (a space after another character, and around characters that no piece
holds), so each segment's ids depend on the segment alone. A segment is merged from an agenda of adjacent symbol pairs
ordered by score, then position. Every segment met for the first time is also encoded by the library, a batch at a time,
and a difference stops the job. Null counts as empty; an empty text has no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .words import slices

SPACE = "▁"
REMEMBERED = 300_000  # segments a worker keeps, or those of one batch if they are more


class Codec:
    """Encoder and decoder of one model, given as its bytes."""

    def __init__(self, model: bytes, check: bool = True):
        self.library, self.check = sentencepiece.SentencePieceProcessor(model_proto=model), check
        size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) for i in range(size)]
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special)) if not s and not self.library.is_unused(i)}
        self.scores = {p: self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or not all(map(self.library.is_byte, self.bytes)):
            raise ValueError("only vocabularies with leading space marks and byte fallback are supported")
        lone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in self.ids))
        odd = re.escape(lone)
        self.segments = re.compile(f"{SPACE}+[^{SPACE}{odd}]*|[^{SPACE}{odd}]+" + (f"|[{odd}]" if lone else "")).findall
        self.known: dict[str, tuple[str, int, str]] = {}

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment: the best-scored adjacent pair is merged first, the leftmost of equals."""
        symbols: list[str | None] = list(segment)
        n, scores = len(symbols), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, str]] = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((-scores[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, pair = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            follower = after[left] = after[right]
            if follower < n:
                before[follower] = left
                joined = pair + symbols[follower]
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined], left, follower, joined))
            previous = before[left]
            if previous >= 0:
                joined = symbols[previous] + pair
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined], previous, left, joined))
        out: list[int] = []
        for symbol in symbols:
            if symbol is not None:
                own = self.ids.get(symbol)
                out += [own] if own is not None else [self.bytes[b] for b in symbol.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids: marks become spaces, byte runs characters, and the first mark goes."""
        return self._plain(ids, True)

    def _plain(self, ids: list[int], first: bool) -> str:
        parts, held = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                held.append(byte)
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held.clear()
            parts.append(self.pieces[i])
        parts.append(held.decode("utf-8", "replace"))
        whole = "".join(parts)
        return (whole[1:] if first and whole.startswith(SPACE) else whole).replace(SPACE, " ")

    def learn(self, segments: set[str]) -> None:
        """Encode new segments and hold them against the library."""
        new = [s for s in segments if s not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            # Segments of the present batch stay: the frequent ones among them are not encoded anew.
            self.known = {s: self.known[s] for s in segments if s in self.known}
        merged = [self.merge(s) for s in new]
        if self.check:
            # A line break is never part of a piece; behind it a segment stands as it would inside a text.
            marked = self.library.encode(["\n" + s.replace(SPACE, " ") for s in new], num_threads=1)
            lead = len(self.library.encode("\n"))
            for segment, own, theirs in zip(new, merged, marked):
                if own != theirs[lead:]:
                    raise ValueError(f"the library encodes {segment!r} as {theirs[lead:]}, not {own}")
        for segment, own in zip(new, merged):
            self.known[segment] = (",".join(map(str, own)), len(own), self._plain(own, False))

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        segments = self.cut(text)
        self.learn(set(segments))
        return [int(i) for s in segments for i in self.known[s][0].split(",")]

    def cut(self, text: str) -> list[str]:
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []


_CODECS: dict[int, Codec] = {}


def _codec(model: bytes, check: bool) -> Codec:
    """One codec a worker process, kept from task to task."""
    key = hash((model, check))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, check)
    return _CODECS[key]


def encoded(docs: DataFrame, model: bytes, text: str = "text", key: str = "doc_id", ids: bool = False, check: bool = True) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``, with ``ids`` also the ids and the decoded text.

    Rows are independent: repeated rows repeat, extra columns are ignored, an empty table gives no rows. Memory is one slice
    of a batch and the remembered segments; a text of any length is one list of segments.
    """
    kind = docs.schema[key].dataType.simpleString()
    extra = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, check)
        sha = lambda value: hashlib.sha256(value.encode()).hexdigest()
        for batch in slices(batches, "text", 4_000_000):
            cuts = [codec.cut(t or "") for t in batch.column("text").to_pylist()]
            codec.learn({s for cut in cuts for s in cut})
            counts, hashed, back, every, plain = [], [], [], [], []
            for cut in cuts:
                found = [codec.known[s] for s in cut]
                line = ",".join([f[0] for f in found])
                whole = "".join([f[2] for f in found])[1:]  # the mark set before a text
                counts.append(sum([f[1] for f in found]))
                hashed.append(sha(line))
                back.append(sha(whole))
                if ids:
                    every.append([int(i) for i in line.split(",")] if line else [])
                    plain.append(whole)
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(back, pa.string())]
            arrays += [pa.array(every, extra[0].type), pa.array(plain, pa.string())] if ids else []
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(f.name for f in extra)])

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
