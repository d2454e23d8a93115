"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every pre-token is a row of symbols.  A segment tree stands over its adjacent pairs; a leaf holds
``rank << 32 | position`` of its pair (or "none"), an inner node the smaller of its children.  The
root is therefore the leftmost pair of lowest rank.  Merging it changes three leaves, each repaired
along one path to the root, until the root says that no pair can merge.

Short pre-tokens are worked on side by side: their trees are the rows of one array, and every step
takes the root of each row.  Long ones (up to whole texts without a space) have a tree of their
own, so their cost is ``n log n``.  Pre-tokens repeat, so results are kept per white-space
separated piece of text: neither the pre-tokenizer nor the normalizer looks across white space.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from trialsift.llm.common import others, text_slices

NONE = np.int64(1) << 62
SLICE = 512  # rows encoded between two outputs
LANE = 64  # symbols up to which pre-tokens share an array
KEPT_PIECES = 250_000  # pieces remembered by a worker before it starts anew

# White space that the pre-tokenizer drops, and its pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"


def byte_alphabet() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 is itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Vocabulary:
    """Symbols and merge ranks of a tokenizer file, with vectorised pair look-up."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}
        self.split_added = re.compile(
            "(" + "|".join(re.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")"
        )
        pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            pairs[self.ids[a] << 20 | self.ids[b]] = (rank, self.ids[a + b])
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.pair_id = np.array([pairs[k][1] for k in self.pair_keys.tolist()], dtype=np.int64)
        alphabet = byte_alphabet()
        self.inner = np.array([self.ids[c] for c in alphabet], dtype=np.int64)
        self.last = np.array([self.ids[c + self.suffix] for c in alphabet], dtype=np.int64)
        self.pattern = regex.compile(PIECES)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or ``NONE``) and merged symbol of pairs; a symbol of -1 never merges."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.pair_rank[at], NONE), self.pair_id[at]

    def normalized(self, piece: str) -> str:
        piece = unicodedata.normalize("NFC", piece)
        # The tokenizer lower-cases each character by itself: no final form of sigma.
        return "".join(map(str.lower, piece)) if "Σ" in piece else piece.lower()

    def pretokens(self, piece: str) -> list[str | int]:
        """Pre-tokens of a piece; an added token is given by its id."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            if piece[:-1].isalpha():
                return [piece[:-1].lower(), piece[-1]]
        parts = self.split_added.split(piece) if "<|" in piece else [piece]
        out: list[str | int] = []
        for part in parts:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.pattern.findall(self.normalized(part))
        return out


def merge_one(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of one pre-token, by a segment tree of its own."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = int(NONE)
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * width)
    at, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        found = pairs.get(at[i] << 20 | at[i + 1])
        if found:
            tree[width + i] = found[0] << 32 | i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int) -> None:
        j = after[i]
        found = pairs.get(at[i] << 20 | at[j]) if j < n else None
        k = width + i
        tree[k] = found[0] << 32 | i if found else none
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    while tree[1] != none:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        at[i] = pairs[at[i] << 20 | at[j]][1]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        at[j] = -1
        if j < n - 1:
            tree[width + j] = none
            k = width + j
            while k > 1:
                k >>= 1
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [s for s in at if s >= 0]


def merge_many(rows: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Merge all rows of symbols (padded with -1) side by side; merged places become -1."""
    count, n = rows.shape
    at = rows.astype(np.int64)
    if n < 2:
        return at
    width = 1 << (n - 1).bit_length()
    places = np.arange(n, dtype=np.int64)
    after = np.tile(places + 1, (count, 1))
    before = np.tile(places - 1, (count, 1))
    tree = np.full((count, 2 * width), NONE, dtype=np.int64)
    rank, _ = vocabulary.rank_of(at[:, :-1].ravel(), at[:, 1:].ravel())
    rank = rank.reshape(count, n - 1)
    tree[:, width : width + n - 1] = np.where(rank == NONE, NONE, (rank << 32) | places[:-1])
    for k in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        k = i + width
        tree[r, k] = value
        while k[0] > 1:  # all leaves lie on one level
            k = k >> 1
            tree[r, k] = np.minimum(tree[r, 2 * k], tree[r, 2 * k + 1])

    def pair_value(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = after[r, i]
        right = np.where(j < n, at[r, np.minimum(j, n - 1)], -1)
        found, _ = vocabulary.rank_of(at[r, i], right)
        return np.where(found == NONE, NONE, (found << 32) | i)

    live = np.flatnonzero(tree[:, 1] != NONE)
    while len(live):
        i = tree[live, 1] & 0xFFFFFFFF
        j = after[live, i]
        _, merged = vocabulary.rank_of(at[live, i], at[live, j])
        at[live, i] = merged
        at[live, j] = -1
        following = after[live, j]
        after[live, i] = following
        inside = following < n
        before[live[inside], following[inside]] = i[inside]
        put(live, j, np.full(len(live), NONE))
        put(live, i, pair_value(live, i))
        left = before[live, i]
        has = left >= 0
        if has.any():
            put(live[has], left[has], pair_value(live[has], left[has]))
        live = live[tree[live, 1] != NONE]
    return at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of consecutive runs, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


def merge_all(pretokens: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pre-tokens one after another, and how many each has; like lengths are merged together."""
    raws = [p.encode("utf-8", "surrogatepass") for p in pretokens]
    lengths = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
    ends = np.cumsum(lengths)
    raw = np.frombuffer(b"".join(raws), dtype=np.uint8)
    symbols = vocabulary.inner[raw]
    symbols[ends - 1] = vocabulary.last[raw[ends - 1]]
    starts = ends - lengths
    merged = np.full(len(symbols), -1, dtype=np.int64)  # an id stands where its first symbol stood
    size, done = 4, np.zeros(len(raws), dtype=bool)
    while size <= LANE:
        members = np.flatnonzero(~done & (lengths <= size))
        if len(members):
            places = ragged(starts[members], lengths[members])
            rows = np.full((len(members), size), -1, dtype=np.int64)
            own = ragged(np.arange(len(members)) * size, lengths[members])
            rows.ravel()[own] = symbols[places]
            merged[places] = merge_many(rows, vocabulary).ravel()[own]
            done[members] = True
        size *= 2
    for m in np.flatnonzero(~done).tolist():
        found = merge_one(symbols[starts[m] : ends[m]].tolist(), vocabulary.pairs)
        merged[starts[m] : starts[m] + len(found)] = found
    kept = merged >= 0
    return merged[kept], np.add.reduceat(kept, starts, dtype=np.int64) if len(raws) else lengths


class _Numbers(dict):
    """Numbers of pieces in the order of their first appearance."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


class PieceTable:
    """Numbered pieces of text with their ids as ragged arrays, filled as new pieces turn up."""

    def __init__(self, encode_new, limit: int = KEPT_PIECES):
        self.encode_new, self.limit = encode_new, limit
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.extra: list = []
        self.flat = np.empty(1 << 16, dtype=np.uint16)
        self.start = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def number_run(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the pieces of each text of a run, all of them known afterwards."""
        if len(self.number) > self.limit:
            self.clear()
        number = self.number.__getitem__
        rows = [np.fromiter(map(number, raw.split()), dtype=np.int64) for raw in texts]
        self._learn()
        return rows

    def _learn(self) -> None:
        new, self.number.new = self.number.new, []
        if not new:
            return
        ids, lengths, extra = self.encode_new([p.decode("utf-8", "replace") for p in new])
        first, total = len(self.number) - len(new), len(ids)
        self.extra += extra
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.number) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = ids
        self.start[first + 1 : len(self.number) + 1] = self.used + np.cumsum(lengths)
        self.used += total

    def gather(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of a sequence of pieces."""
        starts = self.start[numbers]
        return self.flat[ragged(starts, self.start[numbers + 1] - starts)]


def runs(texts: list[str | None], size: int = 4_000_000) -> Iterator[list[bytes]]:
    """The texts in UTF-8, in runs of bounded size (a longer text is a run by itself)."""
    run: list[bytes] = []
    held = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and held + len(raw) > size:
            yield run
            run, held = [], 0
        run.append(raw)
        held += len(raw)
    if run:
        yield run


class Encoder:
    """Texts to ids and back, within one Python worker."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.table = PieceTable(self._encode_pieces)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of the pieces one after another, how many each has, and each decoded."""
        vocabulary, seen, numbers, counts = self.vocabulary, {}, [], []
        for piece in pieces:
            found = vocabulary.pretokens(piece)
            counts.append(len(found))
            numbers += [seen.setdefault(t, len(seen)) for t in found]
        plain = [t for t in seen if isinstance(t, str)]
        flat, lengths = merge_all(plain, vocabulary)
        if len(plain) < len(seen):  # added tokens have one id, known already
            parts = np.split(flat, np.cumsum(lengths)[:-1]) if plain else []
            given = iter(parts)
            rows = [next(given) if isinstance(t, str) else np.array([t]) for t in seen]
            flat = np.concatenate(rows)
            lengths = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        starts = np.cumsum(lengths) - lengths
        which = np.array(numbers, dtype=np.int64)
        ids = flat[ragged(starts[which], lengths[which])] if len(which) else flat
        ends = np.concatenate([[0], np.cumsum(lengths[which])])[np.cumsum(counts, dtype=np.int64)]
        names = list(map(vocabulary.names.__getitem__, ids.tolist()))
        begins = [0, *ends.tolist()]
        decoded = [" ".join(names[a:b]) for a, b in zip(begins, begins[1:])]
        return ids, np.diff(np.array(begins)), decoded

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids and decoded text of each text."""
        for run in runs(texts):
            rows = self.table.number_run(run)
            extra = self.table.extra
            for numbers in rows:
                decoded = " ".join([s for k in numbers.tolist() if (s := extra[k])])
                yield self.table.gather(numbers), decoded

    def decode(self, ids: np.ndarray) -> str:
        names = self.vocabulary.names
        return " ".join([names[i] for i in ids.tolist() if i in names])


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(vocabulary: Broadcast) -> Encoder:
    """The worker's encoder for a broadcast tokenizer file."""
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary.value)
    return _ENCODERS[key]


def load_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file for the workers: some megabytes, whatever the size of the corpus."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids`` (little-endian unsigned 32-bit integers) and ``decoded``.

    ``ids`` are those of the tokenizer file without special tokens added; ``decoded`` is the text
    of the ids, symbols joined by spaces, since the file names no decoder.  NULL and empty texts,
    and texts of white space only, have no ids and an empty decoded text.  Repeated rows are
    encoded each by itself.  Columns called ``ids`` or ``decoded`` are replaced.  No shuffle.
    """
    vocabulary = load_vocabulary(docs.sparkSession, tokenizer_path)
    plain = docs.select(*others(docs, ("ids", "decoded")))
    at = [c.lower() for c in plain.columns].index(text.lower())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            # Small slices, since ids and decoded text are larger than the text itself.
            for part in text_slices(batch, at, rows=SLICE):
                ids, decoded = [], []
                for found, back in encoder.encode(part.column(at).to_pylist()):
                    ids.append(found.astype("<u4").tobytes())
                    decoded.append(back)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    [*part.schema.names, "ids", "decoded"],
                )
        # A worker may wait for other work for long; it keeps the vocabulary, not the pieces.
        encoder.table.clear()

    schema = type(plain.schema)(list(plain.schema.fields)).add("ids", "binary").add("decoded", "string")
    return plain.mapInArrow(encode, schema)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the text of the ids of each row; NULL ids give an empty text."""
    vocabulary = load_vocabulary(encoded.sparkSession, tokenizer_path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            texts = [
                encoder.decode(np.frombuffer(raw or b"", dtype="<u4"))
                for raw in batch.column(batch.schema.get_field_index(ids)).to_pylist()
            ]
            kept = [i for i, f in enumerate(batch.schema) if f.name != "decoded"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(texts, pa.string())],
                [*(batch.schema.names[i] for i in kept), "decoded"],
            )

    kept = [f for f in encoded.schema.fields if f.name != "decoded"]
    schema = type(encoded.schema)(kept).add("decoded", "string")
    return encoded.mapInArrow(decode, schema)
