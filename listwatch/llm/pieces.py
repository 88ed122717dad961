"""SentencePiece encoding and decoding with byte offsets (operator 13).

A text is normalised first: at each place the longest key of the model's
compiled character map (a double-array trie and the strings it points to) is
replaced, spaces become U+2581, and each byte of the normalised text records
the byte of the original at which its source starts. The normalised text is
then contracted by the model's scores (best score first, leftmost of equal
ones), unknown characters fall back to their UTF-8 bytes, and the record of
sources projects every piece to its span of original bytes.

Where no piece of the vocabulary holds a character before U+2581, or an ASCII
character beside another one, no contraction crosses that place; the text is
cut there and the distinct parts are contracted once per worker, in a bounded
cache. Spark deals out the documents and nothing is shuffled.

Byte-pair models are handled; a model of another kind, or one that marks
spaces behind words, raises ValueError.

Defined cases: a null text encodes like the empty one (the end id alone, as
the library does for ""); null ids decode like an empty list; an id outside the vocabulary raises;
malformed UTF-8 reads as U+FFFD; texts of any length are encoded whole (one
text has to fit a task); ids, nulls and repeated rows are kept row by row and
other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from listwatch.llm.bpe import _slices as slices

SPACE = "▁"
MARK = SPACE.encode()
BPE = 2  # the trainer's number of this kind of model
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts of one generation of a worker's cache, and the longest part that is kept.
CACHE_PARTS = 200_000
CACHED_CHARS = 64
#: Symbols from which a part is contracted with a heap; and the rank of a pair that is not contracted.
LONG_PART = 48
NONE = 1 << 40
#: Parts contracted together; a character that no piece holds; a place behind a row's symbols.
BLOCK = 4096
UNSEEN, GONE = -1, -2
#: Characters encoded at once.
SLICE = 1 << 20


class CharsMap:
    """The compiled character map of a normaliser."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4 if blob else 0).tolist()
        self.strings = blob[4 + size:]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest key that starts at ``at``, and its length."""
        units, found, length = self.units, None, 0
        node = _offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found, length = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.strings[found:self.strings.index(0, found)], length


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Normaliser:
    def __init__(self, spec):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.space = MARK if self.escape else b" "

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each byte of it the original byte at which its source starts, with one entry
        more for the end."""
        raw = text.encode()
        if self.map or self.trim:
            return self._by_prefixes(raw)
        if not raw:
            return b"", np.zeros(1, dtype=np.int64)
        widths = np.ones(len(raw), dtype=np.int64)
        if self.escape:
            widths[np.frombuffer(raw, dtype=np.uint8) == 0x20] = len(MARK)
        source = np.repeat(np.arange(len(raw)), widths)
        head = self.space if self.prefix else b""
        return (head + (raw.replace(b" ", MARK) if self.escape else raw),
                np.concatenate([np.zeros(len(head), dtype=np.int64), source, [len(raw)]]))

    def _next(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What the map, or else the character itself, gives at ``at``, and how many bytes it takes."""
        if self.map and (found := self.map.longest(raw, at)):
            return found
        lead = raw[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at:at + width], width

    def _by_prefixes(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at, after_space = bytearray(), [], 0, self.trim
        while at < len(raw):
            got, width = self._next(raw, at)
            if after_space:
                got = got.lstrip(b" ")
            if got:
                if self.prefix and not out:
                    out += self.space
                    source += [at] * len(self.space)
                shown = got.replace(b" ", self.space)
                out += shown
                source += [at] * len(shown)
                after_space = self.trim and got.endswith(b" ")
            at += width
        end = len(raw)
        if self.trim:
            while out.endswith(self.space):
                del out[-len(self.space):]
                end = source[len(out)]
                del source[len(out):]
            end = end if out else 0
        return bytes(out), np.array([*source, end], dtype=np.int64)


class Processor:
    """Vocabulary, normaliser and cache of one Python worker."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with the space before a word are handled")
        kinds = [p.type for p in model.pieces]
        if USER_DEFINED in kinds or UNUSED in kinds or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with byte fallback and without user-defined or unused pieces are handled")
        self.normalise = Normaliser(model.normalizer_spec)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self._merges({p.piece: p.score for p in model.pieces if p.type == NORMAL}, len(model.pieces))
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.end = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL
                        else (model.trainer_spec.unk_surface if p.type == UNKNOWN else p.piece.replace(SPACE, " ")).encode()
                        for p in model.pieces]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.marked = [k == NORMAL and p.piece.startswith(SPACE) for k, p in zip(kinds, model.pieces)]
        self.drop_first = self.normalise.prefix or self.normalise.trim
        self.keep_dropping = self.normalise.trim
        self.cut = self._cutter()
        #: Of each part the ids and their lengths in normalised bytes, in turn, as little-endian unsigned 32-bit integers.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cutter(self) -> Callable[[str], list[str]]:
        """A function that cuts a normalised text at places that no contraction crosses."""
        longer = [p for p in self.ids if len(p) > 1]
        if any(a != SPACE and b == SPACE for p in longer for a, b in zip(p, p[1:])):
            return lambda text: [text] if text else []
        joined = set().union(*longer)
        alone = {c for c in map(chr, range(128)) if c not in joined}
        # marks that no piece holds behind a letter: a text is cut between the two
        marks = {c for c in joined - {b for p in longer for a, b in zip(p, p[1:]) if a.isalpha()} if c < "\x80" and not c.isalnum()}
        alone, marks = (re.escape("".join(sorted(x))) for x in (alone, marks))
        rest = f"[^{SPACE}{alone}{marks}]*"
        return re.compile(f"(?:{SPACE}+|[^{SPACE}{alone}]){rest}" + (rf"(?:(?<![^\W\d_])[{marks}]+{rest})*" if marks else "")
                          + (f"|[{alone}]" if alone else "")).findall

    def _merges(self, scores: dict[str, float], n: int) -> None:
        """``rank`` and ``made`` of each contractible pair of symbols (left << 20 | right). Symbols are the ids of pieces;
        a character that only longer pieces hold gets a number above them, any other character is -1."""
        self.symbol = dict(self.ids)
        for c in sorted(set().union(*scores)):
            self.symbol.setdefault(c, n + len(self.symbol))
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        for piece, score in scores.items():
            for k in range(1, len(piece)):
                a, b = self.symbol.get(piece[:k]), self.symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = (order[score], self.ids[piece])
        self.rank = {k: v[0] for k, v in pairs.items()}
        self.made = {k: v[1] for k, v in pairs.items()}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.key_rank, self.key_made = (np.array([t[k] for k in self.keys.tolist()] + [NONE], dtype=np.int64) for t in (self.rank, self.made))
        self.n = n
        self.n_chars, self.n_bytes = np.zeros((2, n), dtype=np.int64)
        for piece, i in self.ids.items():
            self.n_chars[i], self.n_bytes[i] = len(piece), len(piece.encode())
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for c, i in self.symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

    def _symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands among the contractible ones; behind the last if it is none of them."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at, mode="clip") == key, at, len(self.keys))

    def _spell(self, text: str, toks: list[int]) -> bytes:
        """Ids and lengths of one part with unknown characters; of the bytes of such a character the last has its whole
        length."""
        out, at = [], 0
        for t in toks:
            if 0 <= t < self.n:
                out += [t, int(self.n_bytes[t])]
                at += int(self.n_chars[t])
            else:
                raw = text[at].encode()
                for b in raw:
                    out += [self.bytes[b], 0]
                out[-1] = len(raw)
                at += 1
        return np.array(out, dtype="<u4").tobytes()

    def _contract_block(self, parts: list[str]) -> Iterator[bytes]:
        """Contract many short parts together: each round contracts the best, leftmost pair of every row that has one,
        so all these rows get shorter by one symbol."""
        lengths = np.array([len(p) for p in parts])
        width = int(lengths.max())
        toks = np.full((len(parts), width), GONE, dtype=np.int64)
        toks[np.arange(width) < lengths[:, None]] = self._symbols("".join(parts))
        done, rows = toks.copy(), np.arange(len(parts))
        ranks = self.key_rank[self._find(toks[:, :-1], toks[:, 1:])]
        while width > 1 and len(rows):
            best = ranks.argmin(axis=1)
            live = ranks[np.arange(len(rows)), best] < NONE
            if not live.all():
                done[rows[~live], :width], done[rows[~live], width:] = toks[~live], GONE
                rows, toks, ranks, best = rows[live], toks[live], ranks[live], best[live]
            each = np.arange(len(rows))
            toks[each, best] = self.key_made[self._find(toks[each, best], toks[each, best + 1])]
            width -= 1
            place = np.arange(width)
            toks = np.take_along_axis(toks, place + (place > best[:, None]), axis=1)
            place = place[:-1]
            ranks = np.take_along_axis(ranks, place + (place >= best[:, None]), axis=1)
            for k in (best - 1, best):
                ok = (k >= 0) & (k < width - 1)
                ranks[each[ok], k[ok]] = self.key_rank[self._find(toks[each[ok], k[ok]], toks[each[ok], k[ok] + 1])]
        if len(rows):
            done[rows, :width], done[rows, width:] = toks, GONE
        kept = done != GONE
        ends = np.cumsum(kept.sum(axis=1))
        odd = ((done == UNSEEN) | (done >= self.n)).any(axis=1)
        flat = done[kept]
        both = np.stack([flat, self.n_bytes[np.where((flat < 0) | (flat >= self.n), 0, flat)]], axis=1).astype("<u4").tobytes()
        start = 0
        for p, end, strange in zip(parts, ends.tolist(), odd.tolist()):
            yield self._spell(p, flat[start:end].tolist()) if strange else both[8 * start:8 * end]
            start = end

    def _contract_all(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        parts.sort(key=len)
        short = next((i for i, p in enumerate(parts) if len(p) > LONG_PART), len(parts))
        for at in range(0, short, BLOCK):
            some = parts[at:min(at + BLOCK, short)]
            yield from zip(some, self._contract_block(some))
        for p in parts[short:]:
            yield p, self._spell(p, self._contract_long(self._symbols(p).tolist()))

    def _contract_long(self, toks: list[int]) -> list[int]:
        """The same rule with a heap over a linked list; None is a symbol that is gone."""
        rank, n = self.rank.get, len(toks)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := rank(toks[i] << 20 | toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or toks[i] != a or toks[j] != b:
                continue  # a pair that an earlier contraction has changed
            toks[i], toks[j], right[i] = self.made[a << 20 | b], None, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank(toks[x] << 20 | toks[y])) is not None:
                    heapq.heappush(heap, (r, x, toks[x], toks[y]))
        return [t for t in toks if t is not None]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, spans) of each text, the end id included: ids as little-endian unsigned 32-bit integers, spans as pairs
        of them, the first original byte and the one behind the last."""
        if len(self.cache) > CACHE_PARTS:  # two generations: parts still in use come back from the older one
            self.cache, self.older = {}, self.cache
        shown = [self.normalise(t) for t in texts]
        parts = [self.cut(raw.decode()) for raw, _ in shown]
        missing: set[str] = set()
        for own in parts:
            missing.update(filterfalse(self.cache.__contains__, own))
        known = missing & self.older.keys()
        self.cache.update((p, self.older[p]) for p in known)
        long = {}
        for p, got in self._contract_all(list(missing - known)):
            (self.cache if len(p) <= CACHED_CHARS else long)[p] = got
        look = (self.cache | long if long else self.cache).__getitem__
        return [self._project(b"".join(map(look, own)), source) for own, (_, source) in zip(parts, shown)]

    def _project(self, got: bytes, source: np.ndarray) -> tuple[bytes, bytes]:
        ids, lengths = np.frombuffer(got, dtype="<u4").reshape(-1, 2).T
        ends = source[np.cumsum(lengths, dtype=np.int64)]
        spans = np.empty((len(ends) + 1, 2), dtype="<u4")
        spans[:1, 0] = source[0]
        spans[1:-1, 0] = ends[:-1]
        # the bytes of an unknown character before its last one span nothing, at its start
        spans[:-1, 1] = np.where(lengths == 0, spans[:-1, 0], ends)
        spans[-1] = source[-1]
        return ids.tobytes() + struct.pack("<I", self.end), spans.tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of a list of ids (little-endian unsigned 32-bit integers)."""
        flat = np.frombuffer(ids, dtype="<u4")
        if len(flat) and int(flat.max()) >= len(self.surface):
            raise ValueError("an id is not in the vocabulary")
        parts = list(map(self.surface.__getitem__, flat.tolist()))
        if self.drop_first:  # the space that was put before the text
            for k, i in enumerate(flat.tolist()):
                if self.marked[i]:
                    parts[k] = parts[k][1:]
                    if not self.keep_dropping or parts[k]:
                        break
                elif parts[k]:
                    break
        whole = b"".join(parts)
        try:
            return whole.decode()
        except UnicodeDecodeError:  # byte pieces that form no character
            return self._repaired(flat, parts)

    def _repaired(self, flat: np.ndarray, parts: list[bytes]) -> str:
        out, at = [], 0
        edges = np.flatnonzero(np.diff(self.is_byte[flat])) + 1
        for stop in [*edges.tolist(), len(flat)]:
            out.append(_lenient(b"".join(parts[at:stop])))
            at = stop
        return "".join(out)


def _lenient(raw: bytes) -> str:
    """Characters, and U+FFFD for each byte that starts none."""
    out, at = [], 0
    while at < len(raw):
        for width in range(1, 5):
            try:
                out.append(raw[at:at + width].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            width = 1
        at += width
    return "".join(out)


@lru_cache(maxsize=2)
def processor(model_path: str) -> Processor:
    return Processor(model_path)


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id_col, ids, spans): of each whole text the ids (binary, four bytes an id, little-endian, the end id last) and
    the span of original UTF-8 bytes of each (binary, two such integers an id: first byte, byte behind the last).
    ``decoded``: a column of that name with the text that the ids stand for, decoded in the same pass."""
    extra = ["decoded"] if decoded else []
    schema = df.select(F.col(f"`{id_col}`")).schema.add("ids", "binary").add("spans", "binary")
    schema = schema.add("decoded", "string") if decoded else schema

    def run(batches):
        p = processor(model_path)
        for b in batches:
            texts = [(t or b"").decode(errors="replace") for t in b.column(1).to_pylist()]
            for s in slices([len(t) for t in texts], SLICE):
                both = p.encode(texts[s])
                columns = [b.column(0)[s], *(pa.array([x[k] for x in both], pa.binary()) for k in (0, 1))]
                if decoded:
                    columns.append(pa.array([p.decode(ids) for ids, _ in both], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "spans", *extra])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, decoded): the text that each list of ids (binary, four bytes an id) stands for."""
    schema = df.select(F.col(f"`{id_col}`")).schema.add("decoded", "string")

    def run(batches):
        p = processor(model_path)
        for b in batches:
            ids = [x or b"" for x in b.column(1).to_pylist()]
            for s in slices([len(x) for x in ids], 4 * SLICE):
                yield pa.RecordBatch.from_arrays([b.column(0)[s], pa.array([p.decode(x) for x in ids[s]], pa.string())],
                                                 names=[id_col, "decoded"])

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`")).mapInArrow(run, schema)


def digest(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return per document: n_tokens, ids_sha256 (of the decimal ids joined by one space),
    decoded_sha256, spans_sha256 (lowercase hex)."""
    def shown(batches):
        decimal = list(map(str, range(len(processor(model_path).surface))))
        for b in batches:
            texts = [" ".join(map(decimal.__getitem__, np.frombuffer(x, dtype="<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "shown"])

    both = encode(df, model_path, id_col, text_col, decoded=True)
    return both.mapInArrow(shown, StructType([*both.schema.fields, StructField("shown", StringType())])).select(
        F.col(f"`{id_col}`"), F.floor(F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("shown", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2("spans", 256).alias("spans_sha256"))
