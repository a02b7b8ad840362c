"""SentencePiece encoding with source offsets, and decoding.

Longest-prefix normalisation through the model's compiled character map keeps, for every normalised byte, where it came
from, so each piece is projected to a span of the original UTF-8. Pieces hold the word mark only in front, so a text is
cut before each run of marks and every chunk is encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import bounded_batches, from_buffer, only_memo, slices, strings

MARK = "▁"
#: Words that a worker remembers; at this many it starts anew.
MEMO_WORDS = 150_000
#: Marks, by hash, of words that have come once (a power of two).
SEEN = 1 << 21
NONE = float("-inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_models: dict[bytes, "Pieces"] = {}


class CharMap:
    """The compiled character map: a double-array trie over UTF-8, then zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(length, place of the replacement) of the longest key that data has at this place; (0, 0) if none."""
        if not self.units:
            return 0, 0
        best = (0, 0)
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (k + 1 - at, self.units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, place: int) -> bytes:
        return self.texts[place:self.texts.index(b"\0", place)]


class Pieces:
    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(blob)
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the word mark in front are known")
        self.norm = proto.normalizer_spec
        self.map = CharMap(self.norm.precompiled_charsmap)
        self.kind = [p.type for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        if USER in self.kind or UNUSED in self.kind:
            raise ValueError("user-defined and unused pieces are not known")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = self.kind.index(UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface
        self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)] if proto.trainer_spec.byte_fallback else None
        self.end = self.ids[proto.trainer_spec.eos_piece]
        self.cut = all(MARK not in p.lstrip(MARK) for p in self.score)
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.cut else "(?s:.+)")
        self.plain = not self.map.units and not self.norm.remove_extra_whitespaces and self.norm.escape_whitespaces
        self.known = {p: (self.ids[p], len(p.encode()), p.count(MARK)) for p in self.score}
        # the byte pieces of ASCII are characters whatever stands beside them
        ascii_bytes = {i: bytes([b]) for b, i in enumerate(self.bytes[:128])} if self.bytes else {}
        surfaces = [t.replace(MARK, " ").encode() if k == NORMAL else ascii_bytes.get(i, b"") for i, (t, k) in enumerate(zip(self.text, self.kind))]
        self.is_plain = np.array([k == NORMAL or i in ascii_bytes for i, k in enumerate(self.kind)])
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_size = np.array([len(x) for x in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.words = Words(self)

    # -- normalising ---------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, list[int]]:
        """The normalised text and, for each of its bytes and its end, the byte of the original it stands at."""
        data = text.encode()
        out, where = bytearray(), []
        space = MARK.encode() if self.norm.escape_whitespaces else b" "

        def put(piece: bytes, source: int) -> None:
            piece = piece.replace(b" ", space)
            out.extend(piece)
            where.extend([source] * len(piece))

        def steps() -> Iterator[tuple[bytes, int, int]]:
            at = 0
            while at < len(data):
                n, place = self.map.longest(data, at)
                if n:
                    yield self.map.replacement(place), at, n
                else:
                    n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                    yield data[at:at + n], at, n
                at += n

        tight, spaced, end, begun = self.norm.remove_extra_whitespaces, self.norm.remove_extra_whitespaces, 0, False
        for piece, at, n in steps():
            if tight and not begun and piece.strip(b" ") == b"" and set(piece) <= {32}:
                end = at + n
                continue
            if not begun:
                if self.norm.add_dummy_prefix:
                    put(b" ", at)
                begun = True
            if tight:
                while spaced and piece[:1] == b" ":
                    piece = piece[1:]
            if piece:
                put(piece, at)
                spaced = tight and piece[-1:] == b" "
            end = at + n
        if tight:
            while out.endswith(space):
                end = where[len(out) - len(space)]
                del out[-len(space):]
                del where[len(out):]
        where.append(end)
        return out.decode(), where

    # -- encoding ------------------------------------------------------------

    def merge(self, chunk: str) -> list[str]:
        """The pieces' texts: the adjacent pair of best score, leftmost first, is merged again and again."""
        if len(chunk) > 40:
            return self.merge_long(chunk)
        score, parts = self.score.get, list(chunk)
        pairs = [score(a + b, NONE) for a, b in zip(chunk, chunk[1:])]
        while pairs and (best := max(pairs)) > NONE:
            i = pairs.index(best)
            parts[i] = both = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(both + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = score(parts[i - 1] + both, NONE)
        return parts

    def merge_long(self, chunk: str) -> list[str]:
        """The same with a heap, for chunks in which looking at every pair would cost the square of the length."""
        at: list[str | None] = list(chunk)
        n, score = len(at), self.score
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(-s, i, a + b, len(a)) for i, (a, b) in enumerate(zip(chunk, chunk[1:])) if (s := score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both, cut = heapq.heappop(heap)
            j = after[i]
            if at[i] is None or j < 0 or len(at[i]) != cut or at[i] + at[j] != both:
                continue  # one of the two has been merged since
            at[i], at[j] = both, None
            after[i] = k = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if (s := score.get(new := both + at[k])) is not None:
                    heapq.heappush(heap, (-s, i, new, len(both)))
            if (h := before[i]) >= 0 and (s := score.get(new := at[h] + both)) is not None:
                heapq.heappush(heap, (-s, h, new, len(at[h])))
        return [x for x in at if x is not None]

    def encode_chunk(self, chunk: str, mark_bytes: int = 3) -> bytes:
        """Packed pairs (id, bytes of the text it covers), a mark counting as so many."""
        out: list[int] = []
        less = 3 - mark_bytes
        for piece in self.merge(chunk):
            if (known := self.known.get(piece)) is not None:
                i, size, marks = known
                out += (i, size - marks * less)
                continue
            size = len(piece.encode()) - less * piece.count(MARK)
            if self.bytes:
                for b in piece.encode():
                    out += (self.bytes[b], 0)
                out[-1] = size  # as in the library, the last byte's piece has the character's span
            elif out and out[-2] == self.unknown:
                out[-1] += size
            else:
                out += (self.unknown, size)
        return array("i", out).tobytes()

    def encode(self, text: str) -> tuple[bytes, bytes, bytes, bytes]:
        """Packed ids (end id last), span begins and ends in bytes of the original text, and the decoded UTF-8."""
        if not text:
            return array("i", [self.end]).tobytes(), b"\0\0\0\0", b"\0\0\0\0", b""
        prefix = bool(self.norm.add_dummy_prefix)
        if self.plain and self.cut and prefix and MARK not in text:
            # Every character stands for itself, and marks are the spaces, a byte each; the first one is the dummy prefix.
            if text[0] != " " and "  " not in text:
                packed = b"".join(map(self.words.__getitem__, text.split(" ")))
            else:
                packed = b"".join([self.encode_chunk(c, 1) for c in self.chunk.findall(MARK + text.replace(" ", MARK))])
            pairs = np.frombuffer(packed, np.int32).reshape(-1, 2)
            ends = np.cumsum(pairs[:, 1], dtype=np.int32) - np.int32(1)
            begins = np.maximum(ends - pairs[:, 1], 0)
        else:
            if self.plain:
                normal, where = (MARK * prefix) + text.replace(" ", MARK), None
            else:
                normal, where = self.normalise(text)
            pairs = np.frombuffer(b"".join([self.encode_chunk(c) for c in self.chunk.findall(normal)]), np.int32).reshape(-1, 2)
            ends = np.cumsum(pairs[:, 1], dtype=np.int32)
            begins = ends - pairs[:, 1]
            if where is None:
                begins, ends = self.source(text, begins, ends, prefix)
            else:
                table = np.array(where, np.int32)
                begins, ends = table[begins], table[ends]
        ids = pairs[:, 0]
        last = array("i", [int(ends[-1]) if len(ends) else 0]).tobytes()
        return (
            ids.tobytes() + array("i", [self.end]).tobytes(), begins.astype(np.int32, copy=False).tobytes() + last, ends.astype(np.int32, copy=False).tobytes() + last, self.decode_array(ids))

    def decode_array(self, ids: np.ndarray) -> bytes:
        """decode(), by one gather where every id is a normal piece or an ASCII byte."""
        if not len(ids) or not self.is_plain[ids].all() or self.norm.remove_extra_whitespaces:
            return self.decode(ids.tolist())
        size = self.surface_size[ids]
        shift = self.surface_at[ids] - np.cumsum(size) + size
        out = self.surface[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()
        return out[1:] if self.norm.add_dummy_prefix and self.text[ids[0]].startswith(MARK) else out

    @staticmethod
    def source(text: str, begins: np.ndarray, ends: np.ndarray, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(text.encode(), np.uint8)
        width = np.where(data == 32, 3, 1)
        place = np.zeros(int(width.sum()) + 3 * prefix + 1, np.int64)
        at = np.concatenate([[0], np.cumsum(width)]) + 3 * prefix
        place[at] = np.arange(len(data) + 1)
        return place[begins], place[ends]  # pieces end between characters, so the inside of a mark is never asked for

    # -- decoding ------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids; runs of byte pieces become characters, and what is no UTF-8 becomes U+FFFD byte by byte."""
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                run.append(int(self.text[i][3:5], 16))
                first = False
                continue
            if run:
                out.append(repair(bytes(run)))
                run.clear()
            if i is None or self.kind[i] == CONTROL:
                continue
            piece = self.unknown_text if i == self.unknown else self.text[i]
            if first and i != self.unknown:
                first_mark = piece.startswith(MARK) and (self.norm.add_dummy_prefix or self.norm.remove_extra_whitespaces)
                if self.norm.remove_extra_whitespaces and first_mark:
                    piece = piece[1:]
                else:
                    piece, first = piece[1:] if first_mark else piece, False
                    out.append(piece.replace(MARK, " ").encode())
                    continue
                first = not piece
            else:
                first = False
            out.append(piece.replace(MARK, " ").encode())
        return b"".join(out)


class Words(dict):
    """What encode_chunk() gives for a word with one mark before it; words are remembered when they come a second time."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.seen = pieces, bytearray(SEEN)

    def __missing__(self, word: str) -> bytes:
        known = self.pieces.encode_chunk(MARK + word, 1)
        place = hash(word) & SEEN - 1
        if self.seen[place] and len(word) < 100:
            if len(self) >= MEMO_WORDS:
                self.clear()
                self.seen = bytearray(SEEN)
            self[word] = known
        self.seen[place] = 1
        return known


def repair(raw: bytes) -> bytes:
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
            try:
                out.append(raw[at:at + n].decode())
                at += n
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out).encode()


def model(blob: bytes) -> Pieces:
    key = hashlib.sha256(blob).digest()
    only_memo("pieces", _models.clear)
    if key not in _models:
        _models[key] = Pieces(blob)
    return _models[key]


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, n_bytes, ids, begins, ends, decoded) for every row, in one narrow pass.

    ids has the end id last; begins and ends are byte offsets in the original UTF-8, the dummy prefix at its first
    character; without spans they are left out. decoded is the decoder's text of ids. model_file is a path on the driver;
    its content (fixed in size) is broadcast. A null text counts as empty: only the end id. Repeated rows and null ids come
    out as they came in; an empty table gives an empty one; other columns of df are not read.
    """
    with open(model_file, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(blob.value)
        for part in slices(batches):
            rows = [pieces.encode(x) for x in strings(part.column("text"))]
            ids, begins, ends, decoded = zip(*rows)
            columns = [part.column("id"), from_buffer(list(ids), np.int32)]
            columns += [from_buffer(list(x), np.int32) for x in (begins, ends)] if spans else []
            yield pa.RecordBatch.from_arrays([*columns, pa.array(decoded, pa.binary()).cast(pa.string()), part.column("n_bytes")], names)

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    offsets = "begins array<int>, ends array<int>, " if spans else ""
    names = ["id", "ids", *["begins", "ends"] * spans, "decoded", "n_bytes"]
    return source.mapInArrow(run, f"id {kind}, ids array<int>, {offsets}decoded string, n_bytes long").withColumnRenamed("id", id_col)


def decode(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row; null ids count as none and give the empty text, a null in ids is passed over."""
    with open(model_file, "rb") as f:
        blob = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(blob.value)
        for batch in batches:
            texts = [pieces.decode([i for i in ids or () if i is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])

    bounded_batches(df)
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
