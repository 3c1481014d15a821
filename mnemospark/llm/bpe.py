"""BPE encoding through a table of distinct words, and decoding through the pieces of its ids."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, release, tokenizer_path

LONGEST = 256
BLOCK_BYTES = 12_000_000
PART_BYTES = 32_000_000
#: Words of printable ASCII and Latin letters, which are composed already and whose lower case is one letter (special
#: tokens begin with <|); and the parts, in lower case, that the tokenizer cuts words into.
_PLAIN = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
_PARTS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"

#: Byte-level BPE writes each byte as a printable character: itself where it is one, else one from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _byte_letters(part: str) -> str:
    return part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slices of data, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _placed(data: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at each place, given the ids of distinct things and which of them each place holds; and where each ends."""
    begin, size = (np.cumsum(size) - size)[at], size[at]
    return _gathered(data, begin, size), np.cumsum(size)


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(i) // 4 for i in ids], dtype=np.int64)


def _cut(data: np.ndarray, size: np.ndarray) -> list[bytes]:
    ends, raw = (4 * np.cumsum(size)).tolist(), data.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Words:
    """Ids of words, as little-endian unsigned 32-bit integers.

    A word is a run of characters other than ASCII white space. The tokenizer drops white space
    and neither its normalizer nor its pattern reaches across it, so a text's ids are those of its words in order.
    """

    def __init__(self, name: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.most, self.known = Tokenizer.from_file(tokenizer_path(name)), most, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: The same merges without what comes before them, for parts that are in lower case, composed and split already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.ends = np.array([p.endswith("</w>") for p in self.pieces()])

    def ids(self, texts: pa.Array, rows: int = 2_000) -> Iterator[np.ndarray]:
        """Ids of each text of a string array; null texts have none.

        Words are split and told apart outside Python: only the distinct parts of `rows` texts are looked up here, and
        ids join back to words, and to all places of the words, by position.
        """
        for i in range(0, len(texts), rows):
            split = pc.ascii_split_whitespace(texts.slice(i, rows).fill_null(""))
            coded = split.flatten().dictionary_encode()
            data, size = self.encoded(coded.dictionary)
            ids, ends = _placed(data, size, coded.indices.to_numpy())
            cuts = np.concatenate([[0], ends])[np.cumsum(split.value_lengths().to_numpy())]
            yield from np.split(ids, cuts[:-1]) if len(cuts) else ()

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has. Plain words are encoded by their parts, others by the library."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|")))
        spaced = pc.ascii_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _PARTS, r"\1 "))
        split = pc.ascii_split_whitespace(spaced)
        coded = split.flatten().dictionary_encode()
        data, size = _joined(self._looked_up(coded.dictionary.to_pylist(), self._by_merges))
        data, ends = _placed(data, size, coded.indices.to_numpy())
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])]
        if len(spaced) == len(words):
            return data, np.diff(at)
        odd, odd_size = _joined(self._looked_up(words.filter(pc.invert(plain)).to_pylist(), self._by_library))
        which, sizes, begin = plain.to_numpy(zero_copy_only=False), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        sizes[which], begin[which] = np.diff(at), at[:-1]
        sizes[~which], begin[~which] = odd_size, len(data) + np.cumsum(odd_size) - odd_size
        return _gathered(np.concatenate([data, odd]), begin, sizes), sizes

    def _looked_up(self, texts: list[str], encode) -> list[bytes]:
        """Ids of each text, encoded once and then known until there are too many."""
        new = [t for t in texts if t not in self.known]
        if len(self.known) + len(new) > self.most:
            self.trim()
            new = [t for t in texts if t not in self.known]
        known = self.known
        known.update(zip(new, encode(new), strict=True))
        out = [known[t] for t in texts]
        for t in new:
            if len(t) > LONGEST:
                del known[t]
        return out

    def trim(self, keep: int = 100_000) -> None:
        """Forgets all but what was met first, mostly what is frequent; done when a task ends, as others need the memory then."""
        self.known = dict(islice(self.known.items(), min(keep, self.most // 2)))
        release()

    def _by_merges(self, parts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(parts), 4096):
            ids = np.array(self.merges.encode_batch_fast([" ".join(map(_byte_letters, parts[i : i + 4096]))], add_special_tokens=False)[0].ids, dtype="<u4")
            # each part is one pre-token, and the last id of a pre-token, no other, has the word's end in its piece
            ends, data = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _by_library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    @classmethod
    def shared(cls, name: str) -> Words:
        """The one of this worker, whose words stay known from task to task."""
        if name not in _SHARED:
            _SHARED[name] = cls(name)
        return _SHARED[name]

    def pieces(self) -> list[str]:
        """The piece of each id."""
        return [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]


_SHARED: dict[str, Words] = {}


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _opened(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class Blocks:
    """A task's documents in blocks of about BLOCK_BYTES of text; the same rows give the same blocks each time."""

    def __init__(self, parts: int):
        self.parts, self.task, self.n = parts, TaskContext.get().partitionId(), -1

    def read(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, list[list[bytes]], np.ndarray, np.ndarray]]:
        """For each block: its key, its rows, its distinct words by part (by hash, sorted), how many words each text has,
        and of each word its place in the list of all parts' words."""
        texts = pc.fill_null(batch.column("text"), "")
        ends, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while begin < len(texts):
            self.n += 1
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BLOCK_BYTES, side="right")))
            split = pc.ascii_split_whitespace(texts.slice(begin, end - begin))
            coded = split.flatten().dictionary_encode()
            # text that begins or ends with white space has an empty word there
            words, at = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
            lengths = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            if b"" in words:
                full = at != words.index(b"")
                lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[full], minlength=len(lengths))
                at = at[full]
            by: list[list[bytes]] = [[] for _ in range(self.parts)]
            order = sorted((w, i) for i, w in enumerate(words) if w)
            dealt: list[list[int]] = [[] for _ in range(self.parts)]
            for w, i in order:
                part = xxhash.xxh3_64_intdigest(w) % self.parts
                by[part].append(w)
                dealt[part].append(i)
            place = np.zeros(len(words), dtype="<u4")
            place[[i for own in dealt for i in own]] = np.arange(len(order), dtype="<u4")
            digest = xxhash.xxh3_128_hexdigest(b"\n".join(b"\t".join(p) for p in by))
            yield f"{self.task}-{self.n}-{digest}", batch.slice(begin, end - begin), by, lengths, place[at]
            begin = end


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json", parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of docs (doc_id, text).

    1. Each block of documents lists its distinct words, dealt to `parts` by hash (one for each PART_BYTES of texts, if
       not given, so a part's words stay as many at any size).
    2. A part's task holds its share of the distinct-word table: it encodes each word once and answers each block
       with the ids of the block's words, by position.
    3. A block's documents, as positions in its list of words, meet the answers; ids join back by position, and
       decoding looks each id's piece up in the table of pieces, whose size the vocabulary fixes, once for each of the
       block's distinct words.

    Only packed word lists and positions are shuffled, and a word counts once a block, so none is hot. Blocks must be
    the same in both readings of docs: read it from a table. A block that isn't raises an error, for its key holds a
    digest of its words. Null texts count as empty (no ids, empty decoded text); repeated rows give repeated rows; null
    doc_ids pass; an empty table gives no rows; other columns are ignored.
    """
    docs, _ = carried(docs, ["doc_id", "text"], keep=[])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = parts or max(few, -(-size // PART_BYTES))
    # as many partitions as blocks: what a task reads stays the same at any size
    blocks = max(few, -(-size // BLOCK_BYTES))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(parts)
        for batch in batches:
            for key, _, by, _, _ in blocks.read(batch):
                there = [i for i, words in enumerate(by) if words]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array([_pressed(b"\n".join(by[i])) for i in there], pa.binary())],
                    names=["key", "part", "words"],
                )

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Words.shared(name)
        table: dict[bytes, bytes] = {}
        for b in batches:
            out = []
            for packed in b.column("words").to_pylist():
                words = _opened(packed).split(b"\n")
                new = [w for w in words if w not in table]
                data, size = encoder.encoded(pa.array([w.decode() for w in new], pa.string()))
                table.update(zip(new, _cut(data, size), strict=True))
                found = [table[w] for w in words]
                out.append(_pressed(np.array([len(i) // 4 for i in found], dtype="<u4").tobytes() + b"".join(found)))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("part"), pa.array(out, pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=["key", "part", "ids", "docs"])
        encoder.trim()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(parts)
        for batch in batches:
            for key, b, by, lengths, flat in blocks.read(batch):
                ids = b.column("doc_id")
                head = np.array([b.num_rows, len(flat), sum(map(len, by))], dtype="<u8").tobytes()
                body = lengths.astype("<u4").tobytes() + np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 4).T).tobytes()
                nulls = np.array(ids.is_valid().to_pylist(), dtype=np.uint8).tobytes()
                own = head + ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + nulls + body
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), pa.array([_pressed(own)], pa.binary())], names=["key", "part", "ids", "docs"])

    def joined(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block.column("part").to_pylist(), block.column("ids").to_pylist(), block.column("docs").to_pylist(), strict=True), key=lambda r: r[0])
        own = [r for r in rows if r[0] < 0]
        words: list[bytes] = []
        for _, packed, _ in rows[len(own) :]:
            data = _opened(packed)
            total, n = len(data) // 4, 0
            numbers = np.frombuffer(data, dtype="<u4")
            # the lengths come first: as many as there are, they and their sum make up the whole
            ends = np.cumsum(numbers.astype(np.int64)) + np.arange(1, total + 1)
            n = int(np.searchsorted(ends, total)) + 1 if total else 0
            edges = n * 4 + 4 * np.concatenate([[0], np.cumsum(numbers[:n], dtype=np.int64)])
            words += [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        pieces = _pieces(name)
        size = np.array([len(w) // 4 for w in words], dtype=np.int64)
        coded = np.frombuffer(b"".join(words), dtype="<u4")
        said = pa.array([" ".join([pieces[i] for i in np.frombuffer(w, dtype="<u4").tolist()]) for w in words], pa.string())
        out: list[list] = [[], [], [], []]
        for _, _, packed in own:
            data = _opened(packed)
            n, flat, distinct = (int(x) for x in np.frombuffer(data, dtype="<u8", count=3))
            if distinct != len(words):
                raise RuntimeError("a block's words changed between two readings of the documents: store them as a table first")
            ids, there, at = np.frombuffer(data, dtype="<i8", count=n, offset=24), np.frombuffer(data, dtype=np.uint8, count=n, offset=24 + 8 * n), 24 + 9 * n
            lengths = np.frombuffer(data, dtype="<u4", count=n, offset=at).astype(np.int64)
            planes = np.frombuffer(data, dtype=np.uint8, count=4 * flat, offset=at + 4 * n).reshape(4, flat)
            places = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
            encoded, ends = _placed(coded, size, places)
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])]
            raw = encoded.tobytes()
            full = size[places] > 0  # words without ids are not decoded to anything
            kept = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(lengths)])]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), said.take(pa.array(places[full]))), " ").cast(pa.binary())
            for i in range(n):
                mine = raw[4 * cuts[i] : 4 * cuts[i + 1]]
                for column, v in zip(out, (int(ids[i]) if there[i] else None, len(mine) // 4, hashlib.sha256(mine).hexdigest(), hashlib.sha256(texts[i].as_buffer()).hexdigest()), strict=True):
                    column.append(v)
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)})

    shape = "key string, part int, ids binary, docs binary"
    questions = docs.mapInArrow(asked, "key string, part int, words binary")
    answers = questions.repartition(parts, "part").mapInArrow(answered, shape)
    return docs.mapInArrow(placed, shape).unionByName(answers).repartition(blocks, "key").groupBy("key").applyInArrow(joined, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_PIECES: dict[str, list[str]] = {}


def _pieces(name: str) -> list[str]:
    if name not in _PIECES:
        _PIECES[name] = Words.shared(name).pieces()
    return _PIECES[name]


def decode_ids(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """rows (doc_id, ids array) with `text`: the pieces (id, piece) of its ids, joined by id, with spaces between.

    pieces is a vocabulary: its size is fixed by the tokenizer, so it is broadcast. Null or empty ids, and ids that have
    no piece, give nothing; doc_ids must be unique and a null one is a document too; an empty table gives no rows.
    """
    at = rows.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    said = at.join(F.broadcast(pieces), "id", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return said.select("doc_id", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
