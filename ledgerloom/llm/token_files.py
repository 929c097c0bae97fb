"""Token ids in binary files: canonical length-limited Huffman coding from global counts.

1. Each text is encoded once; ids stay in a written table. Word-like units are encoded once a task and remembered.
2. Counts of ids (as many as the vocabulary has) give code lengths by package-merge, and canonical codes from them.
3. Documents are coded where they lie, dealt to ranges of doc_id and sorted; each task writes one file. A file holds the
   code lengths and independent blocks: doc_ids, numbers of ids, the bit offset of every ``STEP`` ids, coded bits.
4. Reading decodes all stretches between checkpoints of a block at once, one id of each a step, by table lookup.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialize, scratch_path, text_chunks
from ledgerloom.llm.files import open_to_read, open_to_write

MOST_BITS = 18
STEP = 1024
BLOCK_IDS = 4_000_000
NO_ID = -(1 << 63)  # stands for a null doc_id in the files, and sorts first
MAGIC = b"CHUF0001"
HEAD = "<8sII"  # magic, symbols, bytes of the packed code lengths
BLOCK = "<IIQQ"  # documents, checkpoints, ids, bytes of coded bits


# ---------------------------------------------------------------- the code
def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, merged, leaf_in = counts[order].astype(np.float64), None, []
    for _ in range(most):
        packages = np.zeros(0) if merged is None else merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        merged = both[by]
        leaf_in.append(by < len(leaves))
    need, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(leaf_in):
        n = int(flags[:need].sum())
        lengths[:n] += 1
        need = 2 * (need - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: in order of (length, id), each one more than the last, widened with zeros."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """For each ``most`` bits that may come next: id * 32 + length of its code."""
    codes, table = canonical(lengths), np.zeros(1 << most, np.int64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (most - lengths[order].astype(np.int64))).astype(np.int64)
    filled = np.repeat(order.astype(np.int64) * 32 + lengths[order], spans)
    assert not len(order) or int(codes[order[0]]) == 0
    table[: len(filled)] = filled
    return table


def encode_bits(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Coded bytes of documents of ``sizes`` ids each, from a full byte on; bytes of each; bit of each id within its document."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    first = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate(([0], ends))
    bits = total[first[1:]] - total[first[:-1]]
    taken = (bits + 7) // 8
    within = ends - width - np.repeat(total[first[:-1]], sizes)
    at = within + np.repeat(np.concatenate(([0], np.cumsum(taken)[:-1])) * 8, sizes)
    value = codes[ids] << (64 - width - (at & 31)).astype(np.uint64)
    word = at >> 5
    n = int(taken.sum()) // 4 + 2
    # the codes' bits do not overlap, so that sums of them are exact
    words = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n) if len(ids) else np.zeros(n)
    if len(ids):
        words = words + np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:n]
    return words.astype(">u4").tobytes()[: int(taken.sum())], taken, within


def decode_bits(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """The ids of stretches that begin at bits ``starts`` and hold ``sizes`` ids, one after the other."""
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    order = np.argsort(-sizes, kind="stable")
    at, size = starts[order].astype(np.int64), sizes[order]
    out, to = np.zeros(int(sizes.sum()), np.int64), (np.cumsum(sizes) - sizes)[order]
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
    for step, n in enumerate(live.tolist()):
        bit = at[:n]
        got = table[((window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(32 - most)).astype(np.int64)]
        out[to[:n] + step] = got >> 5
        at[:n] = bit + (got & 31)
    return out


# ---------------------------------------------------------------- texts to ids
class UnitEncoder:
    """Encodes texts cut before each space, where the tokenizer's own word pattern cuts too unless another white space
    stands beside it; such texts are encoded whole. Units are remembered up to ``most``, then the older half goes."""

    ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"  # in Arrow's pattern language: two signs of Unicode white space

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most, self.known, self.older = Tokenizer.from_file(path), most, {}, {}
        n = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.size = np.zeros(n, np.int64)
        for token, i in self.tok.get_vocab(True).items():
            self.size[i] = len(token)  # a byte is a character in this vocabulary
        self.space = self._pack(self.tok.encode(" ", add_special_tokens=False).ids)

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _learn(self, units: list[str]) -> None:
        for i in range(0, len(units), 4000):
            part = units[i : i + 4000]
            got = self.tok.encode_batch_fast([" " + " ".join(part[j : j + 500]) for j in range(0, len(part), 500)], add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, np.int64) for x in got])
            ends = np.cumsum([len(u.encode()) + 1 for u in part])
            cut = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
            packed, step = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            a = 0
            for u, b in zip(part, (cut * step).tolist(), strict=True):
                self.known[u] = packed[a:b]
                a = b

    def _units(self, dictionary: pa.Array) -> list[bytes]:
        """The ids of each distinct unit with a space before it."""
        units = dictionary.to_pylist()
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        missing = []
        for u in units:
            if u and u not in self.known:
                old = self.older.get(u)
                if old is None:
                    missing.append(u)
                else:
                    self.known[u] = old
        self._learn(missing)
        self.known[""] = self.space
        return list(map(self.known.__getitem__, units))

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [self._pack(x.ids) for x in self.tok.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """The packed ids of each text: units are told apart and put together by Arrow, a task's batch at once."""
        odd = pc.match_substring_regex(column, self.ODD)
        out: list[bytes] = [b""] * len(column)
        for i, x in zip(pc.indices_nonzero(odd).to_pylist(), self._whole(column.filter(odd)), strict=True):
            out[i] = x
        plain = column.filter(pc.invert(odd))
        if not len(plain):
            return out
        parts = pc.split_pattern(plain, " ")
        first, coded = parts.offsets.to_numpy().astype(np.int64), parts.flatten().dictionary_encode()
        first = first - first[0]
        ids = self._units(coded.dictionary)
        at = coded.indices.to_numpy().astype(np.int64)
        at[first[:-1]] = len(ids) + np.arange(len(plain))  # a text's first unit has no space before it
        ids += self._whole(parts.flatten().take(pa.array(first[:-1])))
        size = np.array([len(x) for x in ids], np.int64)
        table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size)))), pa.py_buffer(b"".join(ids))])
        data = table.take(pa.array(at)).buffers()[2].to_pybytes()
        ends = np.concatenate(([0], np.cumsum(size[at])))[first]
        for i, a, b in zip(pc.indices_nonzero(pc.invert(odd)).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = data[a:b]
        return out


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder_for(name: str) -> UnitEncoder:
    """One a Python worker, with the units that its tasks have met; their number is bounded."""
    return UnitEncoder(tokenizer_path(name))


def _encode(name: str, end_id: int):
    def run(batches):
        coder = encoder_for(name)
        end = coder._pack([end_id])
        for b in batches:
            column, ids = b.column("text"), b.column("doc_id")
            for i, j, _, _ in text_chunks(column, 8_000_000):
                part = pc.fill_null(column.slice(i, j - i), "")
                got = [x + end for x in coder.encode(part)]
                # low bytes, then high ones: the written table's compression does better on them
                planes = [np.frombuffer(x, np.uint8).reshape(-1, coder.dtype.itemsize).T.tobytes() for x in got]
                n = [len(x) // coder.dtype.itemsize for x in got]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(planes, pa.binary())], names=["doc_id", "n_tokens", "planes"])

    return run


def _ids_of(planes: pa.Array, sizes: np.ndarray) -> np.ndarray:
    parts = []
    for x, n in zip(planes, sizes.tolist(), strict=True):
        p = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, n).astype(np.int64)
        parts.append(sum(p[k] << (8 * k) for k in range(len(p))))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _counted(symbols: int):
    def run(batches):
        total = np.zeros(symbols, np.int64)
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.slice(i, 500)
                total += np.bincount(_ids_of(part.column("planes"), part.column("n_tokens").to_numpy()), minlength=symbols)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _coded(lengths: np.ndarray):
    def run(batches):
        codes = canonical(lengths)
        for b in batches:
            sizes = b.column("n_tokens").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(sizes) // 500_000)) + 1, [len(b)]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                part, n = b.slice(i, j - i), sizes[i:j]
                data, taken, within = encode_bits(_ids_of(part.column("planes"), n), n, codes, lengths)
                ends, first = np.cumsum(taken), np.concatenate(([0], np.cumsum(n)))
                rows = [data[e - t : e] for e, t in zip(ends.tolist(), taken.tolist(), strict=True)]
                marks = [within[a:z:STEP] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(rows, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "bits", "marks"])

    return run


def _block(docs: list[tuple]) -> bytes:
    ids, sizes = np.array([d[0] for d in docs], "<i8"), np.array([d[1] for d in docs], "<i8")
    start = np.cumsum([0, *(len(d[2]) for d in docs)])[:-1] * 8
    marks = np.concatenate([np.asarray(d[3]) + s for d, s in zip(docs, start, strict=True)]).astype("<u8")
    bits = b"".join(d[2] for d in docs)
    return struct.pack(BLOCK, len(docs), len(marks), int(sizes.sum()), len(bits)) + ids.tobytes() + sizes.tobytes() + marks.tobytes() + bits


def _write(folder: str, lengths: np.ndarray, block_ids: int):
    def run(batches):
        name, out, held, n_ids, docs, first, total = f"{folder}/{uuid.uuid4().hex}.chuf", None, [], 0, 0, None, 0
        for b in batches:
            for i in range(len(b)):
                if out is None:
                    out, packed = open_to_write(name), zlib.compress(lengths.tobytes())
                    out.write(struct.pack(HEAD, MAGIC, len(lengths), len(packed)) + packed)
                    first = b.column("doc_id")[i].as_py()
                size = b.column("n_tokens")[i].as_py()
                held.append((b.column("doc_id")[i].as_py(), size, b.column("bits")[i].as_py(), b.column("marks")[i].values.to_numpy()))
                n_ids, docs, total = n_ids + size, docs + 1, total + size
                if n_ids >= block_ids:
                    out.write(_block(held))
                    held, n_ids = [], 0
        if held:
            out.write(_block(held))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first": first, "docs": docs, "ids": total}])

    return run


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` lie below ``doc_id``."""
    below = F.array(*(F.lit(min(b, (1 << 63) - 1)).cast("long") for b in bounds))
    return F.size(F.filter(below, lambda b: b < doc_id)) if bounds else F.lit(0)


def write_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text; more columns are not read) in ascending order of doc_id.

    ``tokenizer``: a file of the public tokenizers, with byte-level tokens. Null texts are empty; each document ends
    with ``end_id``. Returns (file, first, docs, ids, start): one row a file, start being the ids of all files before.
    Rows of one doc_id follow each other. An empty table gives no file.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    encoded = materialize(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(_encode(tokenizer, end_id), "doc_id long, n_tokens long, planes binary"), "tokens-ids")
    symbols = max(Tokenizer.from_file(tokenizer_path(tokenizer)).get_vocab_size(), end_id + 1)
    counts = np.zeros(symbols, np.int64)
    for r in encoded.mapInArrow(_counted(symbols), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most a row an id
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    coded = encoded.mapInArrow(_coded(lengths), "doc_id long, n_tokens long, bits binary, marks array<long>")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges by the written doc_ids alone: a partitioning by range of the coded rows would code all twice
    bounds = [int(x) for x in encoded.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)] if parts > 1 else []
    dealt = coded.repartitionById(parts, range_of(F.col("doc_id"), bounds))
    files = dealt.sortWithinPartitions("doc_id", "n_tokens", "bits").mapInArrow(_write(folder, lengths, block_ids), "file string, first long, docs long, ids long")
    files = materialize(files, "tokens-files")
    order = Window.orderBy(F.col("first").asc_nulls_first(), "file")  # one row a file
    return files.withColumn("start", F.sum("ids").over(order) - F.col("ids"))


def read_blocks(name: str):
    """The blocks of a file: doc_ids, numbers of ids, all ids."""
    with open_to_read(name) as f:
        magic, symbols, packed = struct.unpack(HEAD, f.read(struct.calcsize(HEAD)))
        if magic != MAGIC:
            raise ValueError(f"{name} is no token file")
        table = decode_table(np.frombuffer(zlib.decompress(f.read(packed)), np.uint8)[:symbols])
        while head := f.read(struct.calcsize(BLOCK)):
            docs, marks, ids, size = struct.unpack(BLOCK, head)
            doc_ids, sizes = np.frombuffer(f.read(8 * docs), "<i8"), np.frombuffer(f.read(8 * docs), "<i8")
            starts, bits = np.frombuffer(f.read(8 * marks), "<u8").astype(np.int64), np.frombuffer(f.read(size), np.uint8)
            each = -(-sizes // STEP)
            lanes = np.full(marks, STEP, np.int64)
            last = np.cumsum(each) - 1
            lanes[last] = sizes - (each - 1) * STEP
            got = decode_bits(bits, starts, lanes, table)
            assert len(got) == ids
            yield doc_ids, sizes, got


def _read(with_ids: bool):
    def run(batches):
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                for doc_ids, sizes, ids in read_blocks(name):
                    ends = np.cumsum(sizes)
                    begin, raw = ends - sizes, ids.astype("<u4")
                    crc = [zlib.crc32(raw[a:z]) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)]
                    cols = [pa.array(doc_ids), pa.array(begin + start), pa.array(sizes), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.array([raw[a:z].astype(np.int64) for a, z in zip(begin.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])
                    start += int(ends[-1])

    return run


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the files."""
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    rows = files.select("file", "start").repartition(n, "file").mapInArrow(_read(with_ids), schema)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
