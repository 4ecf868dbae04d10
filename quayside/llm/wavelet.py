"""Token ids of documents as one wavelet matrix per shard.

A shard holds the ids of consecutive documents, each closed by an end id. Its
alphabet is the shard's distinct ids by falling frequency; level by level, from
the highest bit of that code, a bit plane is stored and the sequence is parted
stably into zeros and ones. Planes are cut into blocks that are compressed one
by one, with the number of ones before each, so that access, rank and select
read a few blocks of one file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, col, partitions
from quayside.session import materialize, new_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: A shard is closed once it holds so many ids.
SHARD_TOKENS = 4 << 20
#: Text that one task of the writer gets at most, on average.
TASK_BYTES = 256 << 20
#: Text that is encoded together.
ENCODE_BYTES = 24 << 20
#: Pieces of text whose ids are put together at a time.
RUN_PIECES = 1 << 18
#: Bits of a plane that are compressed together.
BLOCK_BITS = 1 << 16
#: Distinct pieces of text a worker remembers; it forgets all of them when full.
MEMORY = 1_000_000

MAGIC = b"WVMX0001"
_HEAD = struct.Struct("<8sQQIII")


# -- encoding ----------------------------------------------------------------


class Encoder:
    """Ids of whole texts, each distinct piece being encoded once.

    Under the byte-level pattern no match goes from a visible character to a
    following blank or line feed, nor from an ASCII letter to one of ``.,;:!?``.
    Cutting there changes no id. Any other kind of tokenizer gets
    whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        added = "".join(t["content"] for t in kind.get("added_tokens") or [])
        self._cuts = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and kind.get("normalizer") is None
            and not kind.get("truncation")
            and kind["model"].get("type") == "BPE"
            and not set(added) & set(" \n.,;:!?")
        )
        self._bytes = None
        if self._cuts and not kind.get("padding") and kind["model"].get("unk_token") is None:
            # A token of the byte alphabet has one character a byte.
            sizes = {i: len(t) for t, i in self._tokenizer.get_vocab(False).items()}
            sizes |= {t["id"]: len(t["content"].encode()) for t in kind.get("added_tokens") or []}
            self._bytes = np.zeros(max(sizes, default=0) + 1, np.int64)
            self._bytes[list(sizes)] = list(sizes.values())
        self._forget()

    def _forget(self) -> None:
        self._code: dict[bytes, int] = {}
        self._flat, self._ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        ids = [e.ids for e in self._tokenizer.encode_batch_fast(decoded, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(i) for i in ids], np.int64)

    def _fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, for pieces that are not empty and new.

        The words of one split input are encoded each on its own, at about half
        the cost of as many inputs. The bytes that ids stand for tell where a
        word ends; pieces whose ids leave out bytes are given as inputs.
        """
        if self._bytes is not None:
            words = [p.decode("utf-8", "replace") for p in pieces]
            (joined,) = self._tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(joined.ids, np.uint32)
            upto = np.cumsum(self._bytes[ids])
            ends = np.cumsum([len(w.encode()) for w in words])
            if len(upto) and upto[-1] == ends[-1]:
                last = np.searchsorted(upto, ends)
                if (upto[last] == ends).all():
                    return ids, np.diff(last + 1, prepend=0)
        return self._each(pieces)

    def _codes(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces, under which ``_flat`` holds their ids."""
        missing = [p for p in pieces if p not in self._code]
        if len(self._code) + len(missing) > MEMORY:
            self._forget()
            missing = pieces
        code = self._code
        made, ends = [self._flat], [self._ends]
        for i in range(0, len(missing), 4096):
            ids, n = self._fresh(missing[i : i + 4096])
            made.append(ids)
            ends.append(ends[-1][-1] + np.cumsum(n))
        self._flat, self._ends = np.concatenate(made), np.concatenate(ends)
        code.update(zip(missing, range(len(code), len(code) + len(missing)), strict=True))
        return np.fromiter(map(code.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        if not self._cuts:
            return self._each(texts)
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[0] = True
        cut[ends] = True
        left, right = (np.frombuffer(raw.translate(t), np.uint8) for t in (_LEFT, _RIGHT))
        cut[1:-1] |= (left[:-1] & right[1:]).astype(bool)
        cut[2:-1] |= (left[:-2] & right[2:] & _TWO).astype(bool) & (data[1:-1] >= 0x80)
        del left, right
        edges = np.flatnonzero(cut)
        offsets = pa.py_buffer(edges.astype(np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, offsets, pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        marks = np.searchsorted(edges, np.concatenate([[0], ends]))
        indices = coded.indices.to_numpy()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        del cut, edges, offsets, pieces, coded
        codes = self._codes(words)
        starts = self._ends[codes]
        sizes = self._ends[codes + 1] - starts
        out, total, done = [], np.zeros(len(marks), np.int64), 0
        # What is as long as the text is one byte or four an item; longer numbers are made run by run.
        for a in range(0, len(indices), RUN_PIECES):
            some = indices[a : a + RUN_PIECES]
            n = sizes[some]
            after = np.cumsum(n)
            at = np.repeat((starts[some] - after + n).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            out.append(self._flat[at])
            low, high = np.searchsorted(marks, [a, a + len(some)], "right")
            total[low:high] = done + after[marks[low:high] - a - 1]
            done += len(at)
        return np.concatenate(out), np.diff(total)


def _marked(chars: bytes, mark: int) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(chars)] = mark
    return table


_LETTERS, _VISIBLE = bytes([*range(65, 91), *range(97, 123)]), bytes(range(0x21, 0x7F))
#: First bytes of two-byte characters among which there is no blank.
_LEAD = bytes(range(0xC3, 0xE0))
_TWO = 4
# A cut lies between bytes that share a bit, or around the second byte of a character where that is ``_TWO``.
_LEFT = (_marked(_VISIBLE, 1) | _marked(_LETTERS, 2) | _marked(_LEAD, _TWO)).tobytes()
_RIGHT = (_marked(b" \n", 1 | _TWO) | _marked(b".,;:!?", 2)).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# -- the matrix --------------------------------------------------------------


def build(ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The alphabet and, per level, the number of zeros and the packed plane."""
    # Ties of frequency go to the smaller id, so equal shards make equal files.
    seen = np.bincount(ids)
    alphabet = np.flatnonzero(seen)
    alphabet = alphabet[np.argsort(-seen[alphabet], kind="stable")].astype(np.uint32)
    code_of = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code_of[alphabet] = np.arange(len(alphabet))
    row = code_of[ids]
    planes = []
    for level in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
        ones = (row >> level & 1).astype(bool)
        planes.append((len(row) - int(ones.sum()), np.packbits(ones)))
        row = np.concatenate([row[~ones], row[ones]])
    return alphabet, planes


def restore(n: int, alphabet: np.ndarray, planes: Sequence[tuple[int, np.ndarray]]) -> np.ndarray:
    """The ids again: the planes undone from the lowest bit up."""
    row = np.zeros(n, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    for level, (zeros, packed) in enumerate(reversed(planes)):
        ones = np.unpackbits(packed, count=n).astype(bool)
        back = np.empty_like(row)
        back[~ones] = row[:zeros]
        back[ones] = row[zeros:] | row.dtype.type(1 << level)
        row = back
    return alphabet[row] if n else np.zeros(0, np.uint32)


def pack(docs: Sequence[tuple[int | None, int]], ids: np.ndarray) -> bytes:
    """One shard as a file: head, directories, document table, blocks."""
    alphabet, planes = build(ids)
    squeeze = zstandard.ZstdCompressor(level=1)
    step = BLOCK_BITS // 8
    blocks, directory = [], []
    for zeros, packed in planes:
        parts = [packed[i : i + step] for i in range(0, len(packed), step)]
        ones = np.array([int(np.bitwise_count(p).sum()) for p in parts], np.uint32)
        made = [squeeze.compress(p.tobytes()) for p in parts]
        blocks += made
        directory.append(struct.pack("<Q", zeros) + ones.tobytes() + np.array([len(b) for b in made], np.uint32).tobytes())
    table = np.array([(0 if d is None else d, d is None, n) for d, n in docs], _DOC)
    front = squeeze.compress(b"".join([alphabet.tobytes(), *directory, table.tobytes()]))
    head = _HEAD.pack(MAGIC, len(ids), len(docs), len(alphabet), len(planes), len(front))
    return head + front + b"".join(blocks)


_DOC = np.dtype([("doc", "<i8"), ("null", "?"), ("n", "<i8")])


class Shard:
    """A shard read from one file; blocks of planes are fetched when asked for."""

    def __init__(self, path: str):
        system, inner = open_path(path)
        self._file = system.open_input_file(inner)
        magic, self.n, docs, sigma, depth, size = _HEAD.unpack(self._file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        front = zstandard.ZstdDecompressor().decompress(self._file.read_at(size, _HEAD.size))
        count = -(-self.n // BLOCK_BITS)
        self.alphabet = np.frombuffer(front, np.uint32, sigma)
        at, place = 4 * sigma, _HEAD.size + size
        self._levels = []
        for _ in range(depth):
            (zeros,) = struct.unpack_from("<Q", front, at)
            ones = np.frombuffer(front, np.uint32, count, at + 8)
            sizes = np.frombuffer(front, np.uint32, count, at + 8 + 4 * count)
            starts = np.concatenate([[place], place + np.cumsum(sizes, dtype=np.int64)])
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
            self._levels.append((zeros, before, starts))
            at, place = at + 8 + 8 * count, int(starts[-1])
        self.docs = np.frombuffer(front, _DOC, docs, at)
        self._code = {int(t): c for c, t in enumerate(self.alphabet)}
        self._block = lru_cache(maxsize=4 * max(depth, 1))(self._fetch)

    def close(self) -> None:
        self._file.close()

    def _fetch(self, level: int, block: int) -> np.ndarray:
        starts = self._levels[level][2]
        raw = self._file.read_at(int(starts[block + 1] - starts[block]), int(starts[block]))
        bits = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), count=bits)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        block, rest = divmod(i, BLOCK_BITS)
        before = int(self._levels[level][1][block])
        return before + (int(self._block(level, block)[:rest].sum()) if rest else 0)

    def _place(self, level: int, bit: int, k: int) -> int:
        """The place of the ``k``-th (from 0) zero or one of a plane."""
        before = self._levels[level][1]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK_BITS, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self._block(level, block) == bit)[k - int(before[block])])

    def _bits(self, code: int) -> list[int]:
        return [code >> s & 1 for s in range(len(self._levels) - 1, -1, -1)]

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, (zeros, _, _) in enumerate(self._levels):
            bit = int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.alphabet[code])

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences before ``end`` lie after the last level."""
        low, high = 0, end
        for level, bit in enumerate(self._bits(self._code[token])):
            zeros = self._levels[level][0]
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if bit else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before position ``end``."""
        if token not in self._code:
            return 0
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        place = self._range(token, self.n)[0] + k
        for level, bit in reversed(list(enumerate(self._bits(self._code[token])))):
            place = self._place(level, bit, place - self._levels[level][0] if bit else place)
        return place

    def positions(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids of the shard in order."""
        planes = []
        for level, (zeros, _, starts) in enumerate(self._levels):
            # Blocks lie one after another, so a plane is one read.
            raw = self._file.read_at(int(starts[-1] - starts[0]), int(starts[0]))
            cuts = (starts - starts[0]).tolist()
            open_ = zstandard.ZstdDecompressor().decompress
            bits = b"".join(open_(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
            planes.append((zeros, np.frombuffer(bits, np.uint8)))
        return restore(self.n, self.alphabet, planes)


# -- on Spark ----------------------------------------------------------------


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def qualified(spark, path: str) -> str:
    """``path`` with the scheme that Spark itself would give it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toString()


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode every text and write the shards; returns their list.

    Columns: path, docs, tokens, start (ids of all shards before). Documents
    are in ascending order of id, null ids first, equal ids by text; a null
    text is empty, and an empty one has the end id alone. Repeated rows stay
    repeated. A shard holds whole documents, so one longer than
    ``shard_tokens`` makes a longer shard. Ids of added tokens stand where a
    text contains their strings. An empty table writes no shard.

    Only shards of attempts that ended well are listed. ``folder`` must be one
    all executors reach; by default it is below the work folder, and
    ``tokenizer`` is a file present on all of them.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = tokenizer or public_tokenizers.path(TOKENIZER)
    target = qualified(spark, folder or new_path(spark, "shards"))
    system, inner = open_path(target)
    system.create_dir(inner, recursive=True)
    rows = docs.select(
        col(doc_id).cast("bigint").alias("doc"),
        F.coalesce(col(text), F.lit("")).cast("binary").alias("text"),
    ).withColumn("same", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The hash parts rows that share an id, or have none.
    ranged = rows.repartitionByRange(max(partitions(spark), -(-size // TASK_BYTES)), "doc", "same")
    ordered = ranged.sortWithinPartitions("doc", "same", "text").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        waiting, held, done, nth = [], 0, [], 0

        def close(part: int) -> None:
            nonlocal waiting, held, nth
            path = f"{target}/ids-{uuid.uuid4().hex}.wvm"
            raw = pack([d for some, _ in waiting for d in some], np.concatenate([i for _, i in waiting]))
            out_system, out = open_path(path)
            with out_system.open_output_stream(out, compression=None) as sink:
                sink.write(raw)
            done.append(
                {"part": part, "nth": nth, "path": path, "docs": sum(len(d) for d, _ in waiting), "tokens": held}
            )
            waiting, held, nth = [], 0, nth + 1

        part = None
        for rows in _gathered(batches):
            part = rows.column("part")[0].as_py()
            texts = rows.column("text").to_pylist()
            ids, n = encoder.encode(texts)
            # The end id goes behind each document.
            full = np.insert(ids, np.cumsum(n), end_id)
            keys, sizes = rows.column("doc").to_pylist(), (n + 1).tolist()
            start = at = first = 0
            for i, one in enumerate(sizes):
                at += one
                held += one
                if held >= shard_tokens or i == len(sizes) - 1:
                    waiting.append((list(zip(keys[first : i + 1], sizes[first : i + 1], strict=True)), full[start:at]))
                    start, first = at, i + 1
                    if held >= shard_tokens:
                        close(part)
        if waiting:
            close(part)
        if done:
            yield pa.RecordBatch.from_pylist(done, _LISTED)

    listed = ordered.select("doc", "text", "part").mapInArrow(write, "part int, nth int, path string, docs bigint, tokens bigint")
    shards = materialize(listed, "shard-list")
    # One row for each task of the writer, then one for each of its shards.
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("nth")) - F.col("tokens")
    return shards.withColumn("inside", inside).join(before, "part").select(
        "path", "docs", "tokens", (F.col("base") + F.col("inside")).alias("start")
    )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together until they hold ``ENCODE_BYTES``, so that a piece is looked up less often."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= ENCODE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_LISTED = pa.schema(
    [("part", pa.int32()), ("nth", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]
)


def read_shards(shards: DataFrame, ids: bool = False) -> DataFrame:
    """Every document of the listed shards, read back from the files.

    Columns: doc_id, start (ids of all documents before), n_tokens (with the
    end id), ids_crc32, and the ids themselves as an array where asked for.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                row = shard.ids().astype("<u4", copy=False)
                docs = shard.docs
                shard.close()
                ends = np.cumsum(docs["n"])
                begins = ends - docs["n"]
                for i in range(0, len(docs), 4000):
                    some = slice(i, i + 4000)
                    pairs = list(zip(begins[some].tolist(), ends[some].tolist(), strict=True))
                    out = {
                        "doc_id": pa.array(docs["doc"][some], mask=docs["null"][some]),
                        "start": pa.array(begins[some] + start),
                        "n_tokens": pa.array(docs["n"][some]),
                        "ids_crc32": pa.array([zlib.crc32(row[a:b]) for a, b in pairs], pa.int64()),
                    }
                    if ids:
                        first, last = pairs[0][0], pairs[-1][1]
                        cuts = np.append(begins[some], last) - first
                        out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(row[first:last], pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * ids
    listed = shards.select("path", "start")
    return listed.repartition(partitions(shards.sparkSession), "path").mapInArrow(read, schema)


def count_ids(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """How often each id occurs, from two ranks a shard: token, n."""
    wanted = sorted(set(tokens))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                shard = Shard(path)
                found = [shard.count(t) for t in wanted]
                shard.close()
                yield pa.RecordBatch.from_pydict({"token": pa.array(wanted, pa.int64()), "n": pa.array(found, pa.int64())})

    asked = shards.select("path").repartition(partitions(shards.sparkSession), "path").mapInArrow(ask, "token bigint, n bigint")
    return asked.groupBy("token").agg(F.sum("n").alias("n"))


def find_ids(shards: DataFrame, tokens: Sequence[int]) -> DataFrame:
    """Every occurrence of some ids by select: token, position, doc_id."""
    wanted = sorted(set(tokens))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                ends = np.cumsum(shard.docs["n"])
                for token in wanted:
                    n = shard.count(token)
                    for k in range(0, n, 4000):
                        places = np.array([shard.select(token, j) for j in range(k, min(k + 4000, n))], np.int64)
                        doc = np.searchsorted(ends, places, "right")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "token": pa.array(np.full(len(places), token, np.int64)),
                                "position": pa.array(places + start),
                                "doc_id": pa.array(shard.docs["doc"][doc], mask=shard.docs["null"][doc]),
                            }
                        )
                shard.close()

    listed = shards.select("path", "start").repartition(partitions(shards.sparkSession), "path")
    return listed.mapInArrow(ask, "token bigint, position bigint, doc_id bigint")
