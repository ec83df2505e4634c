"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merging with an agenda: adjacent symbols whose union is a piece are candidates, the best score is popped first
(the leftmost of equal ones), and each popped candidate is skipped when a hash keyed by seed, document, occurrence of the
word, place in the word and piece falls below the dropout rate.  Words of any length vary from one occurrence to the
next, and reruns agree.  With rate 0 the pieces are those of the library.

Words of up to ``WIDE`` symbols go through their agendas together, one pop of each at a time, as rows of numpy arrays;
longer ones use a heap beside a linked list.  What a word becomes if nothing is skipped is kept, with the candidates that
it merges: an occurrence all of whose candidates pass has those pieces, any other one goes through the agenda itself.

Decoding gives the text back exactly: characters without a piece become byte pieces, and so does the space mark itself
where it stands in a text.

Defined results: null texts encode to null and decode to null, empty texts to no pieces; repeated rows get the same
pieces as they have the same id, and rows without an id count as having the empty one; texts of any length are encoded
whole, a slice of words at a time; other columns pass through untouched, but for one that has the name of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import column

MARK = "▁"
#: Stands in a text for the mark itself, which is no space there; no valid text holds it.
LITERAL_MARK = "\ud800"
#: A word as it is encoded where a text has more than single spaces.
WORD = re.compile(rf"{MARK}+[^{MARK}]*")
CROSSING = re.compile(rf"[^{MARK}]{MARK}")

GONE, PAD = -1, -2  # a symbol that was merged into one before it; what follows a word's last symbol
NONE = np.int32(2**31 - 1)  # the rank of neighbours that make no piece
WIDTHS = (4, 8, 12, 16, 24, 48)
WIDE = WIDTHS[-1]

#: Words that are encoded at once, and symbols of words that a worker remembers.
SLICE_WORDS = 200_000
CACHE_SYMBOLS = 4_000_000
#: Pieces that are decoded at once.
SLICE_PIECES = 2_000_000


class Vocabulary:
    """Pieces of a model file: ids by character, pairs of symbols that merge, and what each piece stands for."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.by_char = np.full(0x110000, -1, np.int32)
        for i in plain:
            if len(self.pieces[i]) == 1:
                self.by_char[ord(self.pieces[i])] = i
        rank = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        pairs = {}
        for i in plain:
            piece = self.pieces[i]
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = rank[model.get_score(i)], i
        keys = sorted(pairs)
        self.pair_keys = np.array([*keys, 2**62], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), NONE], np.int32)
        self.pair_made = np.array([*(pairs[k][1] for k in keys), 0], np.int32)
        byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        shown = [bytes([byte_of[i]]) if i in byte_of else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        #: Whether no piece goes on past a word's end, so that words can be encoded alone.
        self.by_word = not any(CROSSING.search(self.pieces[i]) for i in plain)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of each two neighbours; the rank is NONE where they make no piece."""
        key = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE), self.pair_made[at]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, a mark before each, and how many each word has; characters without a piece become byte pieces."""
        chars = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        symbols = self.by_char[chars]
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, size
        unknown = chars[odd]
        unknown[unknown == ord(LITERAL_MARK)] = ord(MARK)
        n_bytes = 1 + (unknown > 0x7F).astype(np.int64) + (unknown > 0x7FF) + (unknown > 0xFFFF)
        grown = np.ones(len(symbols), np.int64)
        grown[odd] = n_bytes
        out = np.repeat(symbols, grown)
        out[out < 0] = self.bytes[np.frombuffer(unknown.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)]
        np.add.at(size, np.searchsorted(np.cumsum(size), odd, side="right"), n_bytes - 1)
        return out, size


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def candidate_hash(key, place, made) -> np.ndarray:
    """32 bits for each candidate, by the key of the word's occurrence, its place in the word, and the piece it would make."""
    return mix(key ^ (np.asarray(made, np.uint64) << np.uint64(32) | np.asarray(place, np.uint64))) >> np.uint64(32)


def occurrence_keys(seed: int, doc_key: str, first: int, n: int) -> np.ndarray:
    """Keys of a document's words ``first`` to ``first + n``."""
    start = np.uint64(xxhash.xxh64_intdigest(doc_key.encode("utf-8", "surrogatepass"), seed & 0xFFFFFFFFFFFFFFFF))
    return mix(start + np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Merged:
    """Pieces of words (``ids`` from ``start``, ``size`` of them), and the candidates merged on the way (``place``, ``made``)."""

    def __init__(self, n: int):
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.place, self.made = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.merge_start, self.n_merges = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def append(self, more: Merged) -> None:
        self.start = np.append(self.start, more.start + len(self.ids))
        self.merge_start = np.append(self.merge_start, more.merge_start + len(self.place))
        self.ids, self.place, self.made = np.append(self.ids, more.ids), np.append(self.place, more.place), np.append(self.made, more.made)
        self.size, self.n_merges = np.append(self.size, more.size), np.append(self.n_merges, more.n_merges)


def starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def taken(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs that begin at ``start`` and are ``size`` long, one after the other."""
    return np.arange(size.sum()) - np.repeat(starts(size) - start, size)


def merge(words: list[str], voc: Vocabulary, keys: np.ndarray | None = None, limit: int = 0) -> Merged:
    """What the agenda makes of each word; candidates whose hash by the word's key is below ``limit`` (of 2^32) are skipped."""
    symbols, size = voc.symbols(words)
    at, out = starts(size), Merged(len(words))
    ids, rows, places, pieces, n_ids = [], [], [], [], 0
    for narrow, width in zip((0, *WIDTHS), (*WIDTHS, None)):
        own = np.flatnonzero((size > narrow) & (size <= width)) if width else np.flatnonzero(size > WIDE)
        if not len(own):
            continue
        own_keys = keys[own] if keys is not None else None
        if width:
            table = np.full((len(own), width + 1), PAD, np.int32)
            table[np.arange(width + 1) < size[own, None]] = symbols[taken(at[own], size[own])]
            merged = merge_together(table, voc, own_keys, limit)
        else:
            merged = merge_long([symbols[a : a + n].tolist() for a, n in zip(at[own], size[own])], voc, own_keys, limit)
        found, counts, row, place, made = merged
        ids.append(found)
        out.start[own], out.size[own] = n_ids + starts(counts), counts
        n_ids += len(found)
        rows.append(own[row])
        places.append(place)
        pieces.append(made)
    if ids:
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        out.ids, out.place, out.made = np.concatenate(ids), np.concatenate(places)[order], np.concatenate(pieces)[order]
        out.n_merges = np.bincount(row, minlength=len(words))
        out.merge_start = starts(out.n_merges)
    return out


def merge_together(table: np.ndarray, voc: Vocabulary, keys: np.ndarray | None, limit: int):
    """All rows of symbols at once, each with an agenda of ranks of which the lowest is popped: the ids left, how many of each
    row, and the row, place and piece of every merge."""
    n, width = table.shape  # the last column is PAD, where links past either end lead
    rank, made = np.full((n, width), NONE), np.zeros((n, width), np.int32)
    rank[:, :-1], made[:, :-1] = voc.look_up(table[:, :-1], table[:, 1:])
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    before[:, 0] = width - 1
    flat_table, flat_rank, flat_made, flat_after, flat_before = (x.reshape(-1) for x in (table, rank, made, after, before))
    rows, places, pieces = [], [], []
    live = np.arange(n)
    while len(live):
        best = rank[live]
        i = best.argmin(axis=1)
        go = best[np.arange(len(live)), i] != NONE
        live, i = live[go], i[go]
        base = live * width
        piece = flat_made[base + i]
        if limit:
            stays = candidate_hash(keys[live], i, piece) >= limit
            flat_rank[(base + i)[~stays]] = NONE
            row, i, base, piece = live[stays], i[stays], base[stays], piece[stays]
        else:
            row = live
            rows.append(row)
            places.append(i)
            pieces.append(piece)
        j = flat_after[base + i]
        k = np.minimum(flat_after[base + j], width - 1)
        h = flat_before[base + i]
        flat_table[base + i], flat_table[base + j], flat_rank[base + j] = piece, GONE, NONE
        flat_after[base + i], flat_before[base + k] = k, i
        flat_rank[base + i], flat_made[base + i] = voc.look_up(piece, flat_table[base + k])
        flat_rank[base + h], flat_made[base + h] = voc.look_up(flat_table[base + h], piece)
    left = table >= 0
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return table[left], left.sum(axis=1), cat(rows), cat(places).astype(np.int32), cat(pieces).astype(np.int32)


def merge_long(words: list[list[int]], voc: Vocabulary, keys: np.ndarray | None, limit: int):
    """As ``merge_together``, word by word, with a heap of candidates beside a linked list of symbols."""
    ids, counts, rows, places, pieces = [], [], [], [], []
    for row, symbols in enumerate(words):
        n = len(symbols)
        line = np.array(symbols, np.int64)
        rank, made = voc.look_up(line[:-1], line[1:])
        heap = [(int(rank[i]), int(i), int(made[i])) for i in np.flatnonzero(rank != NONE)]
        heapify(heap)
        pairs = _pairs_of(voc)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, piece = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or pairs.get(symbols[i] << 16 | symbols[j], (0, -1))[1] != piece:
                continue  # one of the two was merged meanwhile
            if limit and candidate_hash(keys[row : row + 1], [i], [piece])[0] < limit:
                continue
            if not limit:
                rows.append(row)
                places.append(i)
                pieces.append(piece)
            symbols[i], symbols[j] = piece, GONE
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(piece << 16 | symbols[k]):
                    heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get(symbols[h] << 16 | piece)):
                heappush(heap, (found[0], h, found[1]))
        left = [s for s in symbols if s >= 0]
        ids += left
        counts.append(len(left))
    return np.array(ids, np.int32), np.array(counts, np.int64), np.array(rows, np.int64), np.array(places, np.int32), np.array(pieces, np.int32)


_pairs: dict[int, dict[int, tuple[int, int]]] = {}


def _pairs_of(voc: Vocabulary) -> dict[int, tuple[int, int]]:
    """The pairs as a dictionary, for words that are too long for rows."""
    if id(voc) not in _pairs:
        _pairs.clear()
        _pairs[id(voc)] = {int(k): (int(r), int(m)) for k, r, m in zip(voc.pair_keys[:-1], voc.pair_rank, voc.pair_made)}
    return _pairs[id(voc)]


class Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    def __init__(self, voc: Vocabulary, rate: float, seed: int):
        self.voc, self.seed, self.limit = voc, seed, int(rate * 2**32)
        self.forget()

    def forget(self) -> None:
        self.numbers, self.plain = Numbers(), Merged(0)

    def words(self, text: str) -> list[str]:
        """The words of a text; each is encoded with a mark before it."""
        if MARK in text:
            text = text.replace(MARK, LITERAL_MARK)
        if not self.voc.by_word:
            return [text.replace(" ", MARK)]
        words = text.split(" ")
        return [w[1:] for w in WORD.findall((" " + text).replace(" ", MARK))] if "" in words else words

    def encode_words(self, words: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words, and how many each word has."""
        if len(self.plain.ids) + len(self.plain.place) > CACHE_SYMBOLS:
            self.forget()
        known = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > known:
            fresh = np.flatnonzero(number >= known)
            _, first = np.unique(number[fresh], return_index=True)
            self.plain.append(merge([words[i] for i in fresh[first]], self.voc))
        plain = self.plain
        start, size, ids = plain.start[number], plain.size[number], plain.ids
        if self.limit:
            n = plain.n_merges[number]
            at = taken(plain.merge_start[number], n)
            skipped = candidate_hash(np.repeat(keys, n), plain.place[at], plain.made[at]) < self.limit
            varied = np.zeros(len(words), bool)
            varied[np.repeat(np.arange(len(words)), n)[skipped]] = True
            varied = np.flatnonzero(varied)
            if len(varied):
                other = merge([words[i] for i in varied], self.voc, keys[varied], self.limit)
                start[varied], size[varied], ids = len(ids) + other.start, other.size, np.append(ids, other.ids)
        return ids[taken(start, size)], size

    def encode(self, texts: list[str | None], doc_keys: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and how many each text has."""
        out, counts = [], np.zeros(len(texts), np.int64)
        held: list[str] = []
        keys, owners = [], []

        def flush() -> None:
            ids, size = self.encode_words(held, np.concatenate(keys))
            out.append(ids)
            np.add.at(counts, np.concatenate(owners), size)
            held.clear(), keys.clear(), owners.clear()

        for i, (text, doc_key) in enumerate(zip(texts, doc_keys)):
            words = self.words(text) if text else []
            for first in range(0, len(words), SLICE_WORDS):
                part = words[first : first + SLICE_WORDS]
                held += part
                keys.append(occurrence_keys(self.seed, doc_key or "", first, len(part)))
                owners.append(np.full(len(part), i))
                if len(held) >= SLICE_WORDS:
                    flush()
        if held:
            flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts


def decode(ids: np.ndarray, size: np.ndarray, voc: Vocabulary) -> pa.Array:
    """Texts of runs of piece ids, ``size`` of each: byte pieces as UTF-8, marks as spaces, less the space put before a text."""
    n_bytes = voc.shown_size[ids]
    data = voc.shown[taken(voc.shown_start[ids], n_bytes)]
    ends = np.append(0, np.cumsum(n_bytes))[np.append(0, np.cumsum(size))]
    first = ends[:-1][ends[1:] > ends[:-1]]
    spaces = first[data[first] == 32]
    data = np.delete(data, spaces)
    ends = ends - np.searchsorted(spaces, ends)
    texts = pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:  # ids that no text encodes to
        raw = data.tobytes()
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
    return texts


def decode_lists(lists: pa.Array, voc: Vocabulary) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False)
    end, parts, at = np.cumsum(size), [], 0
    while at < len(size):
        done = end[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + SLICE_PIECES)))
        parts.append(decode(ids[done : end[to - 1]], size[at:to], voc))
        at = to
    texts = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))


_encoders: dict[tuple, Encoder] = {}


class PieceCodec:
    """Column functions ``encode(text, id)`` and ``decode(ids)`` for one vocabulary, dropout rate and seed."""

    def __init__(self, spark: SparkSession, path: str, rate: float = 0.1, seed: int = 1):
        shared = self.shared = spark.sparkContext.broadcast(Vocabulary(path))

        def encoded(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            voc = shared.value
            key = (id(voc), rate, seed)
            if key not in _encoders:
                _encoders.clear()
                _encoders[key] = Encoder(voc, rate, seed)
            for texts, keys in batches:
                ids, counts = _encoders[key].encode(texts.to_pylist(), keys.to_pylist())
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()), mask=texts.is_null())

        def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for lists in batches:
                yield decode_lists(lists, shared.value)

        self._encode = F.arrow_udf(encoded, "array<int>").asNondeterministic()
        self._decode = F.arrow_udf(decoded, "string").asNondeterministic()

    def encode(self, text: Column, doc_id: Column) -> Column:
        return self._encode(text, doc_id.cast("string"))

    def decode(self, ids: Column) -> Column:
        return self._decode(ids)


def encode_docs(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", into: str = "ids", **options) -> DataFrame:
    """``docs`` with its text replaced by ``into`` (array of int), in place of a column of that name; the other columns are untouched."""
    codec = PieceCodec(docs.sparkSession, path, **options)
    rest = [column(c) for c in docs.columns if c.lower() not in (text_col.lower(), into.lower())]
    return docs.select(*rest, codec.encode(column(text_col), column(id_col)).alias(into))


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_hash, lossless (decoding gave the text back)."""
    codec = PieceCodec(docs.sparkSession, path, **options)
    encoded = docs.select("doc_id", "text", codec.encode(F.col("text"), F.col("doc_id")).alias("ids"))
    decoded = encoded.select("doc_id", "text", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), codec.decode(F.col("ids")).alias("back"))
    return decoded.select("doc_id", F.when(F.col("n_pieces") >= 0, F.col("n_pieces")).otherwise(0).alias("n_pieces"), "ids_hash", F.col("back").eqNullSafe(F.col("text")).alias("lossless"))
