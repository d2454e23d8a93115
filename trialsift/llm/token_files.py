"""Token files: whole documents as ids in compressed, checksummed blocks, in ascending id order.

A row of a file is a segment: some consecutive documents of one id range, their numbers of ids, and
the blocks (``range_coder.BLOCK`` ids each, every one coded from an empty model, with the CRC-32 of
its ids as little-endian unsigned 32-bit integers).  Any segment can be read by itself.  Files are
Parquet tables, so that writing survives lost executors and works on any file system Spark knows.

Id ranges come from one pass over the ids alone.  The exchange that orders the documents moves
their ids (two bytes each), not their texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialsift.llm.bpe import byte_alphabet, load_vocabulary, ragged
from trialsift.llm.common import partitions, quoted
from trialsift.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from trialsift.plans.ranges import sketch_bounds, with_ranges

SEGMENT = 64 * BLOCK  # ids after which a segment ends with its document
_SCHEMA = (
    "part int, first long, doc_ids array<long>, n_tokens array<int>, sizes array<int>, "
    "checks array<long>, payload binary"
)


# What the texts are split at, and the normalizers and split pattern of this family of vocabularies.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces that are split into words here: visible ASCII and letters of Latin-1 and Latin Extended-A.  None of them
#: decomposes or combines, and each has one lower-case letter.  Added tokens need "<|".
_PLAIN = "^[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]*$"
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f"
_WORDS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\n{_LETTERS}0-9]+")
_CALL = 256  # words of one text for the library, so that its own records of it stay small
KEPT_WORDS = 1_000_000  # words remembered before a worker starts anew
_RUN = 32_000_000  # bytes of text whose pieces are looked up together (a longer text is a run by itself)


def _joined(texts: pa.Array, size: int, mark: str) -> list[str]:
    """Consecutive texts joined, ``size`` at a time."""
    borders = np.append(np.arange(0, len(texts), size), len(texts)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(borders), texts), mark).to_pylist()


def _gathered(ids: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Ids of a sequence of numbered runs of ids, ``sizes`` long and stored one after another."""
    lengths = sizes[numbers].astype(np.int32)
    total = int(lengths.sum(dtype=np.int64))
    if max(total, len(ids)) >= 1 << 31:
        return ids[ragged((np.cumsum(sizes) - sizes)[numbers], lengths.astype(np.int64))]
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)[numbers]
    at = np.repeat(starts - np.cumsum(lengths, dtype=np.int32) + lengths, lengths)
    at += np.arange(total, dtype=np.int32)
    return ids.take(at)


class _Merger:
    """The library's merges, for words that are split already.

    The model is that of the tokenizer file.  Its own cache is off, since no word comes twice.  The
    last symbol of a word, and no other, has the suffix for the end of a word.  Words are remembered
    with their ids, in arrays that take some 25 bytes a word, and forgotten at ``KEPT_WORDS``.
    """

    def __init__(self, model: dict):
        from tokenizers import Tokenizer, models, pre_tokenizers

        suffix = model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.tokenizer = Tokenizer(
            models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=suffix)
        )
        self.tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.is_last = np.zeros(1 << 16, dtype=bool)
        self.is_last[[i for s, i in model["vocab"].items() if s.endswith(suffix)]] = True
        self.names = {b: name for b, name in enumerate(byte_alphabet()) if b != 0x20}
        self._forget()

    def _forget(self) -> None:
        """The line end is the only word known; it has no ids."""
        self.known = pa.array(["\n"])
        self.ids, self.sizes = np.zeros(0, dtype=np.uint16), np.zeros(1, dtype=np.int64)

    @classmethod
    def of(cls, spec: dict) -> _Merger | None:
        """None if the file asks for anything else than the fixed values, or lacks a byte."""
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        expected = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
            and (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": _SPLIT}, "Removed", True)
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and not spec.get("post_processor")
            and all("<|" in t["content"] for t in spec["added_tokens"])
        )
        if not expected:
            return None
        both = (c + s for c in byte_alphabet() for s in ("", model["end_of_word_suffix"]))
        return cls(model) if all(c in model["vocab"] for c in both) else None

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat: list[int] = []
        for text in _joined(words, _CALL, " "):
            named = text if text.isascii() else text.encode().decode("latin-1").translate(self.names)
            flat += self.tokenizer.encode_batch_fast([named], add_special_tokens=False)[0].ids
        ids = np.array(flat, dtype=np.uint16)
        ends = np.flatnonzero(self.is_last[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("words and their last symbols differ in number")
        return ids, np.diff(ends, prepend=0)

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pieces one after another, and how many each has."""
        found = ["\n", *_WORDS.findall(_joined(pieces, len(pieces), "\n")[0].lower()), "\n"]
        words = pa.array(found, pa.string()).dictionary_encode()
        if len(self.known) > KEPT_WORDS:
            self._forget()
        found = pc.index_in(words.dictionary, self.known)
        at, new = found.fill_null(0).to_numpy().copy(), found.is_null()
        if found.null_count:
            unknown = words.dictionary.filter(new)
            at[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(unknown))
            ids, sizes = self._merge(unknown)
            self.known = pa.concat_arrays([self.known, unknown])
            self.ids, self.sizes = np.append(self.ids, ids), np.append(self.sizes, sizes)
        numbers = at[words.indices.to_numpy()]
        return _gathered(self.ids, self.sizes, numbers), np.diff(np.cumsum(self.sizes[numbers])[numbers == 0])


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word of a run of texts.

    Plain pieces of text between white space are split into words here, as the file's pattern does, and
    merged by the library; all other pieces go through it whole, each distinct one once.
    """

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer do not fit two bytes")
        self.merger = _Merger.of(json.loads(text))
        self.mark, self.mark_id = "", -1
        for mark in "×°©®":  # a sign of a single id, which no other text can give
            found = self._ids(f"a {mark} a")
            if len(found) == 3 and len(self._ids(mark)) == 1:
                self.mark, self.mark_id = mark, int(found[1])
                break

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _encode_whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as they are; many go to the library as one text, parted by a sign between spaces."""
        if not self.mark or any(self.mark in p for p in pieces):
            rows = [self._ids(p) for p in pieces]
            return np.concatenate(rows), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat, lengths = [], []
        for start in range(0, len(pieces), 4096):
            some = pieces[start : start + 4096]
            ids = self._ids(f" {self.mark} ".join(some))
            marks = np.flatnonzero(ids == self.mark_id)
            bounds = np.concatenate([[-1], marks, [len(ids)]])
            lengths.append(np.diff(bounds) - 1)
            flat.append(np.delete(ids, marks))
        return np.concatenate(flat), np.concatenate(lengths)

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        if self.merger is None:
            plain = np.zeros(len(pieces), dtype=bool)
        else:
            marked = pc.match_substring(pieces, "<|")
            plain = pc.and_not(pc.match_substring_regex(pieces, _PLAIN), marked).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(pieces), dtype=np.int64)
        parts = [np.zeros(0, dtype=np.uint16)]
        if plain.any():
            ids, lengths[plain] = self.merger.encode(pieces.filter(pa.array(plain)))
            parts.append(ids)
        if not plain.all():
            ids, lengths[~plain] = self._encode_whole(pieces.filter(pa.array(~plain)).to_pylist())
            parts.append(ids)
        # Both groups are brought into the order of the pieces.
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        starts = np.empty(len(pieces), dtype=np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return np.concatenate(parts)[ragged(starts, lengths)], lengths

    def encode(self, texts: pa.Array, end: int) -> Iterator[pa.Array]:
        """Ids of each text and the end id, as little-endian unsigned 16-bit integers; NULL is empty."""
        texts = texts.fill_null("")
        sums = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        low = 0
        while low < len(texts):
            before = sums[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sums, before + _RUN, side="right")))
            yield self._encode_run(texts.slice(low, high - low), end)
            low = high

    def _encode_run(self, texts: pa.Array, end: int) -> pa.Array:
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        pieces = split.flatten().dictionary_encode()
        ids, sizes = self.encode_pieces(pieces.dictionary)
        # The end id is one more piece, behind the last one of each text.
        numbers = np.insert(pieces.indices.to_numpy(), offsets[1:] - offsets[0], len(sizes))
        ids, sizes = np.append(ids, np.uint16(end)), np.append(sizes, 1)
        ends = np.cumsum(sizes[numbers])[offsets[1:] - offsets[0] + np.arange(len(texts))]
        flat = _gathered(ids, sizes, numbers).astype("<u2", copy=False)
        borders = pa.array(np.insert(2 * ends, 0, 0), pa.int64())
        return pa.Array.from_buffers(
            pa.large_binary(), len(texts), [None, borders.buffers()[1], pa.py_buffer(flat.tobytes())]
        )


_ENCODERS: dict[int, LibraryEncoder] = {}


def _encoder(vocabulary: Broadcast) -> LibraryEncoder:
    key = hash(vocabulary.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = LibraryEncoder(vocabulary.value)
    return _ENCODERS[key]


def tokenize(docs: DataFrame, tokenizer_path: str, end: int, id: str, text: str) -> DataFrame:
    """``id`` and ``ids`` (little-endian unsigned 16-bit integers, the end id last)."""
    vocabulary = load_vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary)
        for texts in batches:
            parts = list(encoder.encode(texts, end))
            yield pa.concat_arrays(parts).cast(pa.binary()) if parts else pa.array([], pa.binary())

    encode = F.arrow_udf(run, "binary")
    return docs.select(quoted(id).cast("long").alias("id"), encode(quoted(text).cast("string")).alias("ids"))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents to segments; enough of them are coded together to fill the lanes."""
    waiting: list[tuple[int, int, list, list]] = []  # part, first id, document ids, their tokens
    held = 0
    part, first, ids, tokens, size = None, 0, [], [], 0

    def coded() -> pa.RecordBatch:
        flat = [np.concatenate(s[3]) for s in waiting]
        offsets = np.cumsum([0, *map(len, flat)])
        blocks = [np.arange(0, len(f), BLOCK) for f in flat]
        starts = np.concatenate([b + o for b, o in zip(blocks, offsets)])
        lengths = np.concatenate([np.minimum(BLOCK, len(f) - b) for f, b in zip(flat, blocks)])
        payloads, checks = encode_blocks(np.concatenate(flat), starts, lengths)
        rows, at = [], 0
        for segment, b in zip(waiting, blocks):
            own = payloads[at : at + len(b)]
            rows.append(
                {
                    "part": segment[0],
                    "first": segment[1],
                    "doc_ids": segment[2],
                    "n_tokens": [len(t) for t in segment[3]],
                    "sizes": [len(p) for p in own],
                    "checks": checks[at : at + len(b)],
                    "payload": b"".join(own),
                }
            )
            at += len(b)
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    for batch in batches:
        parts = batch.column(0).to_pylist()
        for p, doc, raw in zip(parts, batch.column(1).to_pylist(), batch.column(2)):
            if ids and (p != part or size >= SEGMENT):
                waiting.append((part, first, ids, tokens))
                held += size
                first, ids, tokens, size = first + size, [], [], 0
                if held >= LANES * BLOCK:
                    yield coded()
                    waiting, held = [], 0
            if p != part:
                part, first = p, 0
            ids.append(doc)
            tokens.append(np.frombuffer(raw.as_buffer(), dtype="<u2"))
            size += len(tokens[-1])
    if ids:
        waiting.append((part, first, ids, tokens))
    if waiting:
        yield coded()


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("first", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int32())),
        ("sizes", pa.list_(pa.int32())),
        ("checks", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end: int = 2, id: str = "doc_id", text: str = "text"
) -> None:
    """Write all documents; NULL and empty texts have the end id alone, NULL ids come first.

    Rows with the same id follow one another in the order of their texts' ids.  An empty table
    gives a table without rows.
    """
    bounds = sketch_bounds(docs, {"k": quoted(id).cast("long")})["k"]
    tokens = tokenize(docs, tokenizer_path, end, id, text)
    ranged = with_ranges(tokens, {"__part": ("id", bounds)})
    part = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.coalesce("__part", F.lit(0))).cast("int")
    rows = ranged.select(part.alias("part"), "id", "ids").repartition(partitions(docs.sparkSession), "part")
    ordered = rows.sortWithinPartitions("part", F.col("id").asc_nulls_first(), F.xxhash64("ids"))
    ordered.mapInArrow(_segments, _SCHEMA).write.parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        blocks = 0
        for i in range(batch.num_rows):
            rows += batch.slice(i, 1).to_pylist()
            blocks += len(rows[-1]["sizes"])
            if blocks >= LANES or i == batch.num_rows - 1:
                yield from _decoded(rows)
                rows, blocks = [], 0


def _decoded(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    payloads, lengths, checks = [], [], []
    for r in rows:
        at = 0
        for size in r["sizes"]:
            payloads.append(r["payload"][at : at + size])
            at += size
        total = sum(r["n_tokens"])
        lengths += [min(BLOCK, total - b) for b in range(0, total, BLOCK)]
        checks += r["checks"]
    decoded = decode_blocks(payloads, np.array(lengths, dtype=np.int64), checks)
    at = 0
    for r in rows:
        own = decoded[at : at + len(r["sizes"])]
        at += len(own)
        flat = np.concatenate(own).astype("<u4")
        ends = np.cumsum(r["n_tokens"])
        begins = ends - np.array(r["n_tokens"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(r["doc_ids"], pa.int64()),
                pa.array(begins + (r["base"] + r["first"]), pa.int64()),
                pa.array([flat[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()),
            ],
            ["doc_id", "start", "ids"],
        )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it) and ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers.  A damaged block is an error.
    """
    files = spark.read.schema(_SCHEMA).parquet(path)
    count = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda total, n: total + n)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per id range: at most 4098, whatever the size of the files.
    totals = files.select("part", count.alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(totals), "part")
    return placed.mapInArrow(_read, "doc_id long, start long, ids binary")
