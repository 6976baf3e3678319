"""Token ids as binary files, coded by static range asymmetric numeral systems.

A file holds one frequency table, shared by all its blocks, and blocks of whole
documents. In a block, ids go in turn to a number of lanes; each lane is a rANS
coder with a 64-bit state, and the lanes' 32-bit words are interleaved in the
order in which a decoder asks for them. A block needs nothing but the table, so
blocks are decoded in parallel; the file's index is a list of checkpoints: for
each block its offset, the ids and documents before it, and a CRC-32 of its ids.

File layout, little-endian::

    blocks      words u32[], then states u64[lanes], for each block
    index       zlib of: ids of the table u32[], frequencies u32[],
                checkpoints (8 x u64 each), doc_ids i64[], lengths u64[]
    footer      offset of the index, its length, number of table entries, of
                blocks and of documents, null flag of the first doc_id's run,
                CRC-32 of the index, magic (8 x u64)
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, byte_slices, filesystem, freeing, new_folder, quoted, stored

MAGIC = 0x31304B4E524C50
#: log2 of the sum of a table's frequencies, and the least state of a coder.
SCALE_BITS, LOW_BITS = 20, 31
#: A block ends with the document in which it reaches so many ids; a file with the block in which it does.
BLOCK_IDS, FILE_IDS = 1 << 18, 1 << 23
MOST_LANES = 2048
#: Words, and as many pre-tokens, whose ids a worker remembers.
REMEMBERED = 600_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 8_000_000
#: A task reads so many blocks of a file.
BLOCKS_A_TASK = 16


# -- coding ------------------------------------------------------------------


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and frequencies of 1 or more that sum to ``1 << SCALE_BITS``."""
    if len(ids) and ids.max() < 1 << 22:
        counts = np.bincount(ids)
        names = np.flatnonzero(counts)
        counts = counts[names]
    else:
        names, counts = np.unique(ids, return_counts=True)
    total = 1 << SCALE_BITS
    if len(names) > total:
        raise ValueError("more distinct ids than the table has room for")
    if not len(names):
        return names.astype(np.uint32), np.zeros(0, np.uint32)
    freq = np.maximum(1, (counts * total) // max(1, counts.sum())).astype(np.int64)
    over = int(freq.sum()) - total
    if over < 0:
        freq[np.argmax(freq)] -= over
    for k in np.argsort(-freq, kind="stable"):
        if over <= 0:
            break
        less = min(over, int(freq[k]) - 1)
        freq[k] -= less
        over -= less
    return names.astype(np.uint32), freq.astype(np.uint32)


def lanes_for(n: int) -> int:
    return int(min(MOST_LANES, max(1, n // 64)))


def encode_block(symbols: np.ndarray, freq: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and final states of ``symbols`` (indexes into the table)."""
    n, lanes = len(symbols), lanes_for(len(symbols))
    state = np.full(lanes, 1 << LOW_BITS, np.uint64)
    groups: list[np.ndarray] = []
    for a in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
        s = symbols[a : a + lanes]
        x, f = state[: len(s)], freq[s]
        full = x >= f << np.uint64(LOW_BITS - SCALE_BITS + 32)
        groups.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(s)] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + start[s]
    return np.concatenate(groups[::-1]) if groups else np.zeros(0, np.uint32), state


def decode_block(words: np.ndarray, state: np.ndarray, n: int, freq: np.ndarray, start: np.ndarray, symbol_at: np.ndarray) -> np.ndarray:
    """The ``n`` symbols of a block."""
    lanes, state, at = len(state), state.copy(), 0
    out = np.empty(n, symbol_at.dtype)
    mask, low, words = np.uint64((1 << SCALE_BITS) - 1), np.uint64(1 << LOW_BITS), words.astype(np.uint64)
    for a in range(0, n, lanes):
        x = state[: min(lanes, n - a)]
        slot = x & mask
        s = symbol_at[slot]
        out[a : a + len(x)] = s
        x = freq[s] * (x >> np.uint64(SCALE_BITS)) + slot - start[s]
        few = np.flatnonzero(x < low)
        x[few] = x[few] << np.uint64(32) | words[at : at + len(few)]
        at += len(few)
        state[: len(x)] = x
    if at != len(words) or (n and (state != low).any()):
        raise ValueError("a block doesn't end where it should")
    return out


# -- files -------------------------------------------------------------------


def pack_file(doc_ids: list, ids: list[np.ndarray]) -> bytes:
    """A whole file of documents in the given order. Null doc_ids come first."""
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    names, freq = frequency_table(every)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.cumsum(lengths)
    f64 = freq.astype(np.uint64)
    begin = np.cumsum(f64) - f64
    if len(names) and names[-1] < 1 << 22:
        place = np.zeros(int(names[-1]) + 1, np.int32)
        place[names] = np.arange(len(names))
        symbols = place[every]
    else:
        symbols = np.searchsorted(names, every)
    body, checkpoints, doc, done = [], [], 0, 0
    offset = 0
    while doc < len(ids):
        last = min(int(np.searchsorted(ends, done + BLOCK_IDS)), len(ids) - 1)
        stop = int(ends[last])
        words, states = encode_block(symbols[done:stop], f64, begin)
        raw = words.tobytes() + states.tobytes()
        checkpoints.append((offset, len(words), len(states), stop - done, done, doc, last + 1 - doc, zlib.crc32(every[done:stop].astype("<u4").tobytes())))
        body.append(raw)
        offset += len(raw)
        doc, done = last + 1, stop
    nulls = sum(d is None for d in doc_ids)
    index = zlib.compress(b"".join([names.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), np.array(checkpoints, "<u8").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u8").tobytes()]), 1)
    footer = np.array([offset, len(index), len(names), len(checkpoints), len(ids), nulls, zlib.crc32(index), MAGIC], "<u8")
    return b"".join([*body, index, footer.tobytes()])


class TokenFile:
    """A file opened for reading its blocks in any order."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        offset, length, names, blocks, docs, self.nulls, crc, magic = np.frombuffer(self.file.read_at(64, size - 64), "<u8").tolist()
        index = self.file.read_at(length, offset)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{uri} is no token file, or a damaged one")
        raw = zlib.decompress(index)
        self.names = np.frombuffer(raw, "<u4", names)
        self.freq = np.frombuffer(raw, "<u4", names, 4 * names).astype(np.uint64)
        self.blocks = np.frombuffer(raw, "<u8", 8 * blocks, 8 * names).reshape(-1, 8).tolist()
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 8 * names + 64 * blocks)
        self.lengths = np.frombuffer(raw, "<u8", docs, 8 * names + 64 * blocks + 8 * docs).astype(np.int64)
        self.begin = np.cumsum(self.freq) - self.freq
        self.symbol_at = np.repeat(np.arange(names, dtype=np.int32), self.freq.astype(np.int64))

    def block(self, k: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids before it in the file, and ids, of each document in block ``k``."""
        offset, words, lanes, n, before, first, docs, crc = self.blocks[k]
        raw = self.file.read_at(4 * words + 8 * lanes, offset)
        symbols = decode_block(np.frombuffer(raw, "<u4", words), np.frombuffer(raw, "<u8", lanes, 4 * words).astype(np.uint64), n, self.freq, self.begin, self.symbol_at)
        ids = self.names[symbols] if n else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        at = 0
        for d in range(first, first + docs):
            size = int(self.lengths[d])
            yield (None if d < self.nulls else int(self.doc_ids[d])), before + at, ids[at : at + size]
            at += size


# -- tokens ------------------------------------------------------------------


class WordTokenizer:
    """A ``tokenizers`` file, with a memory of words where the file allows one.

    A file whose text is cut at white space, normalised without regard to what
    stands around a word, and split by a pattern into pre-tokens that a BPE
    model ends with a suffix, gives a text the ids of its words, one after
    another: then each distinct word is encoded once. Words of Latin letters and
    ASCII marks, which are the same in every normal form and have one lower
    case, are split by the file's own pattern, and only distinct pre-tokens go
    to the library, many in one call; the suffix says where each ends. Every
    other word goes to the library itself, and with every other kind of file
    whole texts do.
    """

    LATIN = "^[\\x21-\\x7e\u00c0-\u012f\u0131-\u024f]+$"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        parts = lambda x, name: x[name] if x and x.get("type") == "Sequence" else [x or {}]
        normal, split, model = parts(told["normalizer"], "normalizers"), parts(told["pre_tokenizer"], "pretokenizers"), told["model"]
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.by_word = (
            [(n.get("type"), n.get("pattern"), n.get("content")) for n in normal] == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
            and [(x.get("type"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in split] == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)]
            and (model["type"], model.get("dropout"), bool(model.get("end_of_word_suffix"))) == ("BPE", None, True)
            and not any(c in t for t in self.added for c in ASCII_SPACE)
        )
        if self.by_word:
            # A line end parts words, so that one call splits many.
            self.pattern = regex.compile("\n|" + split[0]["pattern"]["Regex"])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.known, self.known_pieces = Memory(), Memory()

    def encode(self, texts, end: int) -> list[np.ndarray]:
        """The ids of each text (a pyarrow array, null: none) as uint32, with ``end`` after the last."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            return [np.array([*x.ids, end], np.uint32) for x in found]
        # Arrow splits at space and TAB..CR, no more and no less.
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat, lengths = self.known.ids(split.flatten(), self._words)
        ends = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = np.full(len(flat) + len(texts), end, np.uint32)
        keep = np.ones(len(out), bool)
        stops = ends[1:] + np.arange(len(texts))
        keep[stops] = False
        out[keep] = flat
        return np.split(out, stops[:-1] + 1) if len(texts) else []

    def _words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``words`` (a pyarrow array without repeats) one after another, and how many each has."""
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(words, self.LATIN)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        pieces = self.pattern.findall("\n".join(words.filter(plain).to_pylist()).lower() + "\n")
        flat, lengths = self.known_pieces.ids(pa.array(pieces, pa.large_string()), self._pieces)
        mine = plain.to_numpy(zero_copy_only=False)
        if not mine.any():
            flat, sizes = flat[:0], np.zeros(0, np.int64)
        else:
            # A line end has no ids and ends a word.
            sizes = np.diff(np.cumsum(lengths)[np.fromiter(map("\n".__eq__, pieces), bool, len(pieces))], prepend=0)
        rest = words.filter(pc.invert(plain)).to_pylist()
        if not rest:
            return flat, sizes
        raw: list = []
        for a in range(0, len(rest), 20_000):
            # One call for many words: the library gives the word of each id.
            found = self.tokenizer.encode(rest[a : a + 20_000], is_pretokenized=True, add_special_tokens=False)
            raw.append((np.array(found.ids, np.uint32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(rest[a : a + 20_000]))))
        both = np.concatenate([sizes, *(n for _, n in raw)])
        order = np.concatenate([np.flatnonzero(mine), np.flatnonzero(~mine)])
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gathered(np.concatenate([flat, *(x for x, _ in raw)]), both, back)

    def _pieces(self, pieces) -> tuple[np.ndarray, np.ndarray]:
        """The same for pre-tokens, of which a line end has no ids."""
        pieces = pieces.to_pylist()
        sizes = np.zeros(len(pieces), np.int64)
        some = [i for i, p in enumerate(pieces) if p != "\n"]
        every = []
        for a in range(0, len(some), 20_000):
            part = [pieces[i] for i in some[a : a + 20_000]]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                n = np.diff(stops, prepend=0)
            else:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, n = np.array([i for x in found for i in x], np.uint32), list(map(len, found))
            every.append(ids)
            sizes[some[a : a + 20_000]] = n
        return np.concatenate(every) if every else np.zeros(0, np.uint32), sizes


class Memory:
    """Ids of strings, by arrays: a known string is found by Arrow's hash, without a Python object."""

    def __init__(self):
        self.names, self.flat, self.sizes = None, np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def ids(self, strings, make) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``strings`` one after another, and how many each has; ``make`` gives those of unknown ones."""
        import pyarrow as pa
        import pyarrow.compute as pc

        coded = strings.dictionary_encode()
        asked, codes = coded.dictionary, coded.indices.to_numpy()
        if self.names is None:
            self.names = asked.slice(0, 0)
        at = pc.index_in(asked, value_set=self.names)
        new = asked.filter(pc.is_null(at))
        if len(new):
            flat, sizes = make(new)
            place = at.fill_null(0).to_numpy().astype(np.int64)
            place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
            names = pa.concat_arrays([self.names, new])
            every, lengths = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            if len(names) > REMEMBERED:
                # What this call asked for stays; the rest goes.
                every, lengths = _gathered(every, lengths, place)
                names, place = asked, np.arange(len(asked))
            self.names, self.flat, self.sizes = names, every, lengths
        else:
            place = at.to_numpy()
        return _gathered(self.flat, self.sizes, place[codes])


def _gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs number ``which`` of ``flat``, whose runs have ``sizes``, one after another, and their sizes."""
    begin, lengths = (np.cumsum(sizes) - sizes)[which], sizes[which]
    ends = np.cumsum(lengths)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - lengths), lengths)], lengths


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """The tokenizer of a worker, read once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# -- tables ------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, *, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of ``docs`` in ascending doc_id order; a row for each file.

    Columns: ``path, part, seq, first_id, n_ids, n_docs, n_blocks``; ``first_id``
    counts the ids of all files before. Rows of equal doc_id stand by a hash of
    the text, then by the text, and a doc_id with very many rows is dealt to
    several parts by that hash. A null text has the end id alone; a null doc_id
    comes first; a text of any length is a document of one block; an empty table
    has no file. Other columns than doc_id and text are not read.

    Each task writes files of names of its own, and only those that its row
    names belong to the table, so a task that runs again leaves nothing but an
    unread file. The rows of files stay a table; what comes to the driver is the
    sum of each part, of which there are as many as the session's shuffles have.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    least = -(1 << 63)
    key = F.coalesce(quoted("doc_id").cast("long"), F.lit(least))
    # Range bounds from doc_id alone: sampling for a sort would read the texts as well.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.select(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = np.array(sorted(bounds), np.int64)

    @F.arrow_udf("int")
    def part(ids, draws):
        import pyarrow as pa

        x, u = ids.to_numpy(), draws.to_numpy()
        low, high = np.searchsorted(bounds, x, "left"), np.searchsorted(bounds, x, "right")
        # An id that is several bounds at once has parts of its own, by its draw in [0, 1).
        return pa.array(np.where(high > low, low + 1 + (u * (high - low)).astype(np.int64), low).astype(np.int32))

    rows = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted("text").cast("string").alias("text"), F.coalesce(quoted("doc_id").cast("long"), F.lit(least)).alias("__lp_key"))
    # The one id that nulls are sorted like comes after all of them.
    tie = F.when(F.col("doc_id") == least, F.lit((1 << 53) - 1)).otherwise(F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 11))
    rows = rows.withColumn("__lp_tie", tie).withColumn("part", part(F.col("__lp_key"), F.col("__lp_tie") / F.lit(float(1 << 53))))
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__lp_tie", "text").select("doc_id", "text", "part")

    def run(batches):
        import pyarrow as pa

        tokenizer = tokenizer_at(tokenizer_path)
        seq, number, held_docs, held, size = 0, 0, [], [], 0
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)

        def flush():
            nonlocal seq, held_docs, held, size
            raw = pack_file(held_docs, held)
            name = f"{number:08d}-{seq:05d}-{uuid.uuid4().hex}.rans"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(raw)
            blocks = int(np.frombuffer(raw[-64:], "<u8")[3])
            row = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "part": pa.array([number], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": [size], "n_docs": [len(held)], "n_blocks": pa.array([blocks], pa.int32())})
            seq, held_docs, held, size = seq + 1, [], [], 0
            return row

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and number != batch.column(2)[0].as_py():
                yield flush()
            number = batch.column(2)[0].as_py()
            ids = batch.column(0).to_pylist()
            for a, b in byte_slices(batch.column(1), BATCH_BYTES):
                for doc, x in zip(ids[a:b], tokenizer.encode(batch.column(1).slice(a, b - a), end_id)):
                    held_docs.append(doc)
                    held.append(x)
                    size += len(x)
                    if size >= file_ids:
                        yield flush()
        if held:
            yield flush()

    files = stored(dealt.mapInArrow(freeing(run), "path string, part int, seq int, n_ids long, n_docs long, n_blocks int"), "files", 2)
    sums, before = [], 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        sums.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(sums, "part int, start long")
    earlier = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("earlier", earlier).join(starts, "part").select("path", "part", "seq", (F.col("start") + F.col("earlier")).alias("first_id"), "n_ids", "n_docs", "n_blocks")


def read_token_files(files: DataFrame, *, with_ids: bool = True, blocks_a_task: int = BLOCKS_A_TASK) -> DataFrame:
    """The documents in ``files``: ``doc_id, start, n_tokens, ids_crc32`` and ``ids`` if asked for.

    Blocks are read by offset and decoded apart from each other; a block that
    fails its checksum ends the job. Without files there are no rows.
    """
    ranges = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_blocks") - 1, F.lit(0)), F.lit(blocks_a_task)))).select("path", "first_id", "block")
    ranges = ranges.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path, first, block in zip(*[c.to_pylist() for c in batch.columns]):
                file = TokenFile(path)
                for k in range(block, min(block + blocks_a_task, len(file.blocks))):
                    docs = [(d, first + at, len(x), zlib.crc32(x.astype("<u4").tobytes()), x) for d, at, x in file.block(k)]
                    if docs:
                        cols = list(zip(*docs))
                        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                        if with_ids:
                            arrays.append(pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32())))
                        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    return ranges.mapInArrow(freeing(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
