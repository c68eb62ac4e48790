"""Offset-preserving SentencePiece encoding and decoding, for BPE models with byte fallback.

Normalisation takes the longest prefix that the model's compiled character map knows and records, for every
normalised byte, the original byte it comes from. Merging works on stretches that no piece can cross, so a
stretch that occurs again is looked up, and new ones merge side by side, as rows of an array. Every piece is
projected to the original bytes it stands for.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from clearbrook.llm.shared import load, map_batches, schema_with, set_aside

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A worker remembers stretches until they have so many ids, then forgets all.
REMEMBERED = 800_000
#: Stretches of up to so many characters merge side by side. Above, a stretch is cut where nothing merges, and what is longer still merges by a heap instead of repeated scans.
SCAN = 48
#: Texts are encoded together up to so many characters, and so many of their stretches at once.
TOGETHER, BLOCK = 300_000, 50_000
NO_PIECE = float("inf")


class CharacterMap:
    """A compiled character map: four bytes with the size of a double-array trie, the trie, then replacements that end with a zero byte."""

    def __init__(self, blob: bytes) -> None:
        self.units: tuple[int, ...] = ()
        self.texts = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest entry that starts at ``at``, or None."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (units[node] & 0x7FFFFFFF, k + 1 - at)
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class PieceModel:
    """A model file's pieces, scores and normaliser, with what encoding needs of them."""

    def __init__(self, blob: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        norm = proto.normalizer_spec
        self.map = CharacterMap(norm.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models with suffix spaces or a denormaliser are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.unknown, self.unknown_text = self.kinds.index(UNKNOWN), proto.trainer_spec.unk_surface
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.costs = {p.piece: -p.score for p in proto.pieces if p.type == NORMAL}
        self.bytes = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if proto.trainer_spec.byte_fallback else {}
        self.fallback = proto.trainer_spec.byte_fallback
        self.names = [b"%d" % i for i in range(len(self.pieces))]
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else self._surface([i]).encode() for i in range(len(self.pieces))]
        #: Two characters that stand side by side in no piece: nothing merges across that place.
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        into_space = any(x[1] == SPACE and x[0] != SPACE for x in self.joined)
        at_newline = any("\n" in x for x in self.joined)
        self._pairs()
        self.stretch = re.compile(r"(?s).+" if into_space else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if at_newline else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

    def _pairs(self) -> None:
        """Arrays for merging many stretches: the id of each character, and of each two pieces that make a third, sorted by both ids as one number."""
        n = len(self.pieces)
        self.cost_of, self.size_of = np.full(n + 1, NO_PIECE), np.zeros(n, np.int32)
        for p, i in self.ids.items():
            self.cost_of[i], self.size_of[i] = self.costs[p], len(p.encode())
        chars = sorted((ord(p), i) for p, i in self.ids.items() if len(p) == 1)
        codes, ids = zip((-1, -1), *chars, strict=True)
        self.char_codes, self.char_ids = np.array(codes, np.int64), np.array(ids, np.int32)
        known = ((self.ids.get(p[:k]), self.ids.get(p[k:]), i) for p, i in self.ids.items() for k in range(1, len(p)))
        pairs = sorted((a * n + b, i) for a, b, i in known if a is not None and b is not None)
        keys, ids = zip((-1, -1), *pairs, strict=True)
        self.pair_keys, self.pair_ids = np.array(keys, np.int64), np.array(ids, np.int32)

    def _paired(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ids of the pieces that pairs make, -1 for none."""
        key = left.astype(np.int64) * len(self.pieces) + right
        at = np.searchsorted(self.pair_keys, key, "right") - 1
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def merged_together(self, stretches: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`merged` for many stretches of 1 to SCAN characters, those left out that hold a character which is no piece: (places in the list, a row of ids for each), by falling number of ids."""
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        codes = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")
        at = np.searchsorted(self.char_codes, codes, "right") - 1
        ids = np.where(self.char_codes[at] == codes, self.char_ids[at], -1)
        first = np.cumsum(sizes) - sizes
        whole = np.minimum.reduceat(ids, first) >= 0
        who, rows, pairs = np.empty(0, np.int64), np.empty((0, SCAN), np.int32), np.empty((0, SCAN - 1), np.int32)
        for n in range(SCAN, 0, -1):  # rows of n ids: those of n characters join what has been merged down to n
            new = np.flatnonzero((sizes == n) & whole)
            if len(new):
                fresh = ids[first[new, None] + np.arange(n)]
                who, rows = np.concatenate([who, new]), np.concatenate([rows, fresh])
                pairs = np.concatenate([pairs, self._paired(fresh[:, :-1], fresh[:, 1:])])
            if n == 1 or not len(who):
                if len(who):
                    yield who, rows
                rows, pairs = rows[:, : n - 1], pairs[:, : max(n - 2, 0)]
                continue
            costs = self.cost_of[pairs]
            best = costs.argmin(1)  # the leftmost of equal ones
            each = np.arange(len(who))
            go = costs[each, best] != NO_PIECE
            if not go.all():
                yield who[~go], rows[~go]
                who, rows, pairs, best = who[go], rows[go], pairs[go], best[go]
                each = each[: len(who)]
            made = pairs[each, best]
            k = np.arange(n - 1)
            rows = np.take_along_axis(rows, k + (k > best[:, None]), 1)
            rows[each, best] = made
            k = k[:-1]
            pairs = np.take_along_axis(pairs, k + (k >= best[:, None]), 1)
            for i, b in ((each[best > 0], best[best > 0] - 1), (each[best < n - 2], best[best < n - 2])):
                pairs[i, b] = self._paired(rows[i, b], rows[i, b + 1])

    def normalise(self, text: str, align: bool = False) -> tuple[str, list[int]]:
        """Normalised text and, if ``align``, the original byte of each of its bytes and one more for the end."""
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:  # every byte stays, but spaces become a mark
            mark = SPACE if self.escape else " "
            return mark * self.prefix + text.replace(" ", mark), self._aligned(text, mark) if align else []
        data, out, at, space = text.encode(), bytearray(), [], SPACE.encode() if self.escape else b" "

        def step(p: int) -> tuple[bytes, int]:
            hit = self.map.longest(data, p)
            n = 1 if data[p] < 0x80 else 2 if data[p] < 0xE0 else 3 if data[p] < 0xF0 else 4
            return hit if hit else (data[p : p + n], n)

        p = 0
        while self.squeeze and p < len(data) and step(p)[0] == b" ":
            p += step(p)[1]
        if p == len(data):
            return "", [p]
        if self.prefix:
            out += space
            at += [p] * len(space)
        spaced = self.squeeze
        while p < len(data):
            new, n = step(p)
            if spaced:
                new = new.lstrip(b" ")
            for b in new:
                if b == 32 and self.escape:
                    out += space
                    at += [p] * len(space)
                else:
                    out.append(b)
                    at.append(p)
            if new:
                spaced = self.squeeze and new.endswith(b" ")
            p += n
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            p = at[-len(space)]
            del at[-len(space) :]
        return out.decode(), [*at, p]

    def _aligned(self, text: str, mark: str) -> np.ndarray:
        data, wide = np.frombuffer(text.encode(), np.uint8), len(mark.encode())
        size = np.where(data == 32, wide, 1)
        if self.prefix:
            size[0] += wide
        return np.append(np.repeat(np.arange(len(data)), size), len(data))

    def merged(self, chars: str) -> list[str]:
        """BPE: the best-scored pair merges first, of equal ones the leftmost."""
        parts = list(chars)
        if len(parts) > SCAN:
            return self._merged_by_heap(parts)
        cost, none = self.costs.get, NO_PIECE
        found = [cost(a + b, none) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while found:
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = cost(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = cost(parts[at] + parts[at + 1], none)
        return parts

    def _merged_by_heap(self, parts: list[str]) -> list[str]:
        cost, none, n = self.costs.get, NO_PIECE, len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(c, i, parts[i], parts[i + 1]) for i in range(n - 1) if (c := cost(parts[i] + parts[i + 1], none)) != none]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (c := cost(parts[x] + parts[y], none)) != none:
                    heapq.heappush(heap, (c, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def split(self, stretch: str) -> list[str]:
        """Pieces of a stretch, each of them in the vocabulary or one character. A long one is first cut where nothing merges."""
        if len(stretch) <= SCAN:
            return self.merged(stretch)
        cut = [0, *(i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.joined), len(stretch)]
        return [p for a, b in zip(cut, cut[1:]) for p in self.merged(stretch[a:b])]  # noqa: B905

    def coded(self, stretch: str) -> tuple[list[int], list[int]]:
        """ids of a stretch and the normalised bytes that each stands for."""
        ids, sizes = [], []
        for piece in self.split(stretch):
            i, raw = self.ids.get(piece), piece.encode()
            if i is not None:
                ids.append(i)
                sizes.append(len(raw))
            elif self.fallback:
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
            elif ids and ids[-1] == self.unknown:  # unknowns side by side are one piece
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown)
                sizes.append(len(raw))
        return ids, sizes

    def _surface(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.unknown_text if i == self.unknown else "" if self.kinds[i] == CONTROL else self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes in a row are read as UTF-8 and the space that encoding puts first goes."""
        text = self._surface(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def coded_together(self, stretches: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
        """`coded` for many stretches: (places in the list, numbers of ids, their ids in a row, their sizes)."""
        short = [i for i, s in enumerate(stretches) if len(s) <= SCAN]
        left = set(range(len(stretches)))
        for who, rows in self.merged_together([stretches[i] for i in short]) if short else ():
            places = [short[i] for i in who.tolist()]
            left.difference_update(places)
            yield places, np.full(len(places), rows.shape[1]), rows.ravel(), self.size_of[rows.ravel()]
        for i in left:  # long ones and those with a character that is no piece
            ids, sizes = self.coded(stretches[i])
            yield [i], np.array([len(ids)]), np.array(ids, np.int32), np.array(sizes, np.int32)

    def encode(self, texts: list[str], memory: Memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and the first byte of each in the original text with the end of the last. Of the ids that spell one character as bytes, the last one spans it and those before are empty."""
        normal = [self.normalise(t, align=True) for t in texts]
        parts = [self.stretch.findall(n) for n, _ in normal]
        ids, sizes, counts = memory.of([s for part in parts for s in part])
        ends, p, q = np.cumsum(counts), 0, 0
        for part, (_, at) in zip(parts, normal, strict=True):
            p += len(part)
            a, q = q, int(ends[p - 1]) if p else 0
            yield ids[a:q], np.asarray(at)[np.concatenate([[0], np.cumsum(sizes[a:q])])]

    def digests(self, texts: list[str], memory: Memory) -> Iterator[tuple[int, str, str, str]]:
        """For each text (number of ids, SHA-256 of the ids joined by commas, of the decoded text, and of the first and end bytes of all ids as little-endian 32-bit numbers)."""
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for ids, borders in self.encode(texts, memory):
            listed, borders = ids.tolist(), borders.astype("<u4")
            back = b"".join([self.raw[i] for i in listed])  # whole characters, as they come from a text
            names = b",".join([self.names[i] for i in listed])
            yield len(listed), sha(names), sha(back[1:] if self.prefix and back.startswith(b" ") else back), sha(borders[:-1].tobytes() + borders[1:].tobytes())


class Memory:
    """What a worker remembers of stretches: a number for each, and by it where its ids and their sizes lie. It forgets all when it is full."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = self.sizes = np.empty(0, np.int32)
        self.first = self.count = np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        places, counts, ids, sizes = zip(*self.model.coded_together(new), strict=True)
        self.number.update(zip((new[i] for part in places for i in part), range(len(self.number), len(self.number) + len(new)), strict=True))
        count = np.concatenate(counts)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.sizes, *sizes])

    def of(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all stretches and their sizes in a row, and the number of ids of each stretch; new stretches are worked out together."""
        ids, sizes, counts = [], [], []
        for k in range(0, len(stretches), BLOCK):
            block = stretches[k : k + BLOCK]
            if len(self.ids) > REMEMBERED:
                self._forget()
            if new := list(set(block).difference(self.number)):
                self._learn(new)
            at = np.fromiter(map(self.number.__getitem__, block), np.int64, len(block))
            count = self.count[at]
            place = np.repeat(self.first[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
            ids.append(self.ids[place])
            sizes.append(self.sizes[place])
            counts.append(count)
        none = np.empty(0, np.int32)
        return np.concatenate([none, *ids]), np.concatenate([none, *sizes]), np.concatenate([none, *counts])


def _together(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First and end row of parts of at most 500 rows, each of TOGETHER bytes or a single row."""
    a, size = 0, 0
    for b in range(len(column)):
        more = column.slice(b, 1).nbytes
        if b > a and (size + more > TOGETHER or b - a == 500):
            yield a, b
            a, size = b, 0
        size += more
    if a < len(column):
        yield a, len(column)


def _add(df: DataFrame, model: PieceModel, text: str, outputs: list[tuple[str, pa.DataType, str]], many: Callable[[PieceModel, list, Memory], list[tuple]]) -> DataFrame:
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)
    df = set_aside(df, [n for n, _, _ in outputs])
    schema = schema_with(df, ", ".join(f"{name} {kind}" for name, _, kind in outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memory = Memory(model)
        for batch in batches:
            for a, b in _together(batch.column(at)):
                part = batch.slice(a, b - a)
                rows = many(model, part.column(at).to_pylist(), memory)
                new = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(outputs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *[n for n, _, _ in outputs]])

    return map_batches(df, run, schema)


def encode_texts(df: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``df`` with ids, starts and ends (arrays of equal length; bytes of the UTF-8 text: the pieces tile it). A null text is empty and has no ids; a text of any length is read whole; repeated rows are encoded alike; an empty table gives an empty one. Input columns named like an output stay as ``<name>_in``."""
    ints = pa.list_(pa.int32())
    return _add(df, model, text, [("ids", ints, "array<int>"), ("starts", ints, "array<int>"), ("ends", ints, "array<int>")], lambda m, texts, memory: [(i, b[:-1], b[1:]) for i, b in m.encode([t or "" for t in texts], memory)])


def decode_ids(df: DataFrame, model: PieceModel, ids: str = "ids") -> DataFrame:
    """``df`` with the text that ``ids`` stand for in decoded; null ids are none."""
    return _add(df, model, ids, [("decoded", pa.string(), "string")], lambda m, rows, _: [(m.decode(i or []),) for i in rows])


def digest_texts(df: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``df`` with n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of each text, as encoding with its source alignment and decoding give them, without sending ids back from the workers. Odd texts and columns as in `encode_texts`."""
    return _add(df, model, text, [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"), ("spans_sha256", pa.string(), "string")], lambda m, texts, memory: list(m.digests([t or "" for t in texts], memory)))


def load_model(path: str | None = None) -> PieceModel:
    """The model in ``path``, a small file that the driver reads; the public 32k model if None."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return PieceModel(f.read())


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_texts(load(spark, sf_dir, "documents").select("doc_id", "text"), load_model()).drop("text")
