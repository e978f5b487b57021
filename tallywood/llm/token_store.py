"""Token ids in binary files, packed by a static range asymmetric numeral system (operator 4).

Documents are encoded by the tokenizers library and given an end id, in ascending order of id (ties by
the hash of the text; a null id first). A static table, normalised to 2**SCALE from the counts of all
ids, is shared by all blocks. A block holds whole documents of about block_tokens ids; its ids are
dealt over LANES interleaved coders, so a step codes one id in each lane by array operations. Blocks
stand alone: each has its header, the ids and lengths of its documents, the place of its first id among
all ids, and every checkpoint_steps steps a checkpoint (the lanes' states, the words read so far and
the CRC-32 of the ids up to the next), from which decoding can begin.

File: blocks one after the other, each ``TWB1``, header length (4 bytes), header (JSON), sections, and
the end mark. The folder ``table`` holds the shared table in one block of the same kind.

A text of an added token (such as ``<|endoftext|>``) gives that token's id, as the library's default has it.

Defined results: null and empty texts have the end id only; no documents give no blocks; the ids must
be below 2**SCALE; repeated rows are written each.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_files import read_files, write_blocks
from .bpe import CACHE_CHARS, uneven, uneven_inside
from .common import fresh_path, sliced, staged

SCALE, LANES, LOW = 20, 2048, np.uint64(1 << 31)
MAGIC, END_MARK = b"TWB1", b"\xf1TWE"
#: ASCII that that is neither a letter, a digit nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces a worker keeps the ids of; beyond them the later half goes.
CACHE_ENTRIES = 400_000
#: Words that the library is asked for in one text.
LINES = 256
#: Words, or later lines of pieces, of letters that are letters in every version of Unicode.
LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


class Table:
    """Frequencies that add up to 2**SCALE; an id that was counted has 1 at least."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.cum = np.cumsum(self.freq) - self.freq
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        counts = counts.astype(np.float64)
        seen = counts > 0
        if not seen.any():
            return cls(np.zeros(1, np.int64))
        total = 1 << SCALE
        if seen.sum() > total:
            raise ValueError(f"more than {total} different ids")
        freq = np.where(seen, np.maximum(1, np.floor(counts / counts.sum() * total)), 0).astype(np.int64)
        over = int(freq.sum()) - total
        order = np.argsort(-freq, kind="stable")
        while over > 0:  # taken from the largest
            cut = np.minimum(freq[order] - 1, -(-over // 8) + freq[order] // 64)
            cut = np.maximum(0, np.minimum(cut, over - (np.cumsum(cut) - cut)))
            freq[order] -= cut
            over = int(freq.sum()) - total
        freq[order[0]] -= over
        return cls(freq)


def encode_ids(ids: np.ndarray, table: Table, checkpoint_steps: int) -> tuple[list[int], list[bytes], bytes]:
    """(words read before each checkpoint, states at each, all words) of one block."""
    n, shift = len(ids), np.uint64(SCALE)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, np.uint64)
    parts: list[np.ndarray] = []
    states: list[bytes] = []
    written = [0] * (steps + 1)
    f_all, c_all, room = table.freq[ids], table.cum[ids], np.uint64(63 - SCALE)
    for s in range(steps - 1, -1, -1):
        f, c = f_all[s * LANES : (s + 1) * LANES], c_all[s * LANES : (s + 1) * LANES]
        y = x[: len(f)]
        full = y >= f << room
        out = y[full].astype(np.uint32)
        y[full] >>= np.uint64(32)
        q = y // f
        x[: len(f)] = (q << shift) + (y - q * f) + c
        parts.append(out)
        written[s] = len(out)
        if s % checkpoint_steps == 0:
            states.append(x.astype("<u8").tobytes())
    before = np.concatenate([[0], np.cumsum(written)])
    words = np.concatenate(parts[::-1]).astype("<u4").tobytes() if parts else b""
    return before[:steps:checkpoint_steps].tolist(), states[::-1], words


def decode_ids(n: int, table: Table, state: bytes, words: np.ndarray, at: int, first: int, last: int) -> np.ndarray:
    """The ids of steps first to last of a block of n ids, from the state before first; at: words read before."""
    x = np.frombuffer(state, "<u8").astype(np.uint64)
    shift, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    stop = min(n, last * LANES)
    out = np.empty(stop - first * LANES, np.uint32)
    for lo in range(0, len(out), LANES):
        m = min(LANES, len(out) - lo)
        y = x[:m]
        slot = y & mask
        ids = table.symbol[slot]
        out[lo : lo + m] = ids
        y = table.freq[ids] * (y >> shift) + slot - table.cum[ids]
        need = np.flatnonzero(y < LOW)
        y[need] = (y[need] << np.uint64(32)) | words[at : at + len(need)]
        at += len(need)
        x[:m] = y
    return out


def pack(header: dict, sections: dict[str, bytes]) -> bytes:
    body = b"".join(sections.values())
    head = json.dumps(header | {"sections": {k: len(v) for k, v in sections.items()}, "crc": zlib.crc32(body)}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + body


def unpack(content: bytes) -> Iterator[tuple[dict, dict[str, memoryview]]]:
    """The blocks of a file; a wrong mark or checksum is an error."""
    view, at = memoryview(content).cast("B"), 0
    while at < len(view):
        if view[at : at + 4] != MAGIC:
            raise ValueError("no block begins here")
        size = int.from_bytes(view[at + 4 : at + 8], "little")
        header = json.loads(bytes(view[at + 8 : at + 8 + size]))
        at += 8 + size
        begin, sections = at, {}
        for k, n in header["sections"].items():
            sections[k] = view[at : at + n]
            at += n
        if zlib.crc32(view[begin:at]) != header["crc"] or view[at : at + 4] != END_MARK:
            raise ValueError("a block is damaged")
        at += 4
        yield header, sections


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, the type its ids are packed in, the packed ids of pieces seen lately, a pattern of the added
    tokens' texts (None if there are none), whether texts may be taken apart at blanks, the id of a line's end (None if it isn't one), and the model."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model = t.model
    if hasattr(model, "_resize_cache"):
        model._resize_cache(0)  # each word is asked for once: the pieces kept here serve as cache
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    plain = not made.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    line = t.encode("\n", add_special_tokens=False).ids
    added = [re.escape(x["content"]) for x in made.get("added_tokens", []) if x["content"]]
    return t, np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"), {}, re.compile("|".join(added)) if added else None, plain, line[0] if plain and len(line) == 1 else None, model


def of_letters(model, words: list[str], kind: np.dtype, line_id: int) -> list[bytes]:
    """The packed ids of words of LETTERS, each after a blank, or after a line's end where the word is told with a blank."""
    from tokenizers.pre_tokenizers import ByteLevel

    ask, level, line = model.tokenize, ByteLevel(add_prefix_space=False, use_regex=False), np.array([line_id], kind).tobytes()
    # the model reads bytes as characters of its own, which are the same for A-Z and a-z
    named = lambda x: "".join(y for y, _ in level.pre_tokenize_str(x))
    blank, other = named(" "), [x.lstrip(" ") for x in words if not x.isascii()]
    others = iter(named(" ".join(other)).split(blank))
    asks = [("" if x[0] == " " else blank) + (x.lstrip(" ") if x.isascii() else next(others)) for x in words]
    flat, sizes = [np.zeros(0, kind)], []
    for i in range(0, len(asks), 1024):
        found = list(map(ask, asks[i : i + 1024]))
        sizes += map(len, found)
        flat.append(np.array([k.id for x in found for k in x], kind))
    packed, ends = np.concatenate(flat).tobytes(), (np.cumsum(sizes) * kind.itemsize).tolist()
    out = map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))
    return [line + x if w[0] == " " else x for x, w in zip(out, words, strict=True)]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    """The library's ids of each text, packed.

    Where a blank stands between two characters that aren't white space, the library's split begins a
    match. Texts where all blanks do are taken apart there, and the library is asked once for each
    piece; other texts it gets whole, as it does texts that hold an added token's text, and all texts
    where the file names another split or a normalizer.
    """
    t, kind, known, added, plain, line_id, model = tokenizer(path)
    if not texts:
        return []
    if len(known) > CACHE_ENTRIES:  # the commonest pieces came first
        early = dict(islice(known.items(), CACHE_ENTRIES // 2))
        known.clear()
        known.update(early)
    # Arrow cuts the texts and numbers their pieces, so that Python sees each different piece of a batch once
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    starts = np.asarray(parts.offsets)[:-1].astype(np.int64)
    coded = parts.values.dictionary_encode()
    nth, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    counts = np.diff(np.append(starts, len(nth)))
    text_of = np.repeat(np.arange(len(texts)), counts)
    after = np.ones(len(nth), bool)  # the pieces that a blank stands before
    after[starts] = False
    heads = [words[i] for i in nth[starts].tolist()]
    held = list(map(known.get, words))
    lacks = np.fromiter(map(is_, held, repeat(None)), bool, len(words))
    odd = np.zeros(len(words), bool)
    odd[[i for i in np.flatnonzero(lacks).tolist() if uneven_inside(words[i])]] = True
    whole = np.fromiter((not plain or (added is not None and added.search(x) is not None) or (n > 1 and uneven(h)) for x, h, n in zip(texts, heads, counts.tolist(), strict=True)), bool, len(texts))
    whole[text_of[after & odd[nth]]] = True
    cuts = after & ~whole[text_of]
    used = np.zeros(len(words), bool)
    used[nth[cuts]] = True
    new = [words[i] for i in np.flatnonzero(used & lacks).tolist()]
    # a line's end between characters that aren't white space is a match of its own, so a piece is told by its lines. The later ones are known with a blank before them, which no piece has
    lined = {}
    if line_id is not None:
        for x in new:
            if "\n" in x and not any(map(uneven_inside, lines := x.split("\n"))):
                lined[x] = [lines[0], *[" " + y for y in lines[1:]]]
    wanted = set(new).difference(lined).union(*lined.values()).difference(known)
    # the split also ends a match between a letter and a mark, so a word is asked for without the marks at its end
    ended = {x: (y, x[len(y) :]) for x in wanted if x[-1] in MARKS and (y := x.rstrip(MARKS)) and LETTERS.match(y[-1])}
    asked = list(wanted.difference(ended).union([x for x, _ in ended.values()]).difference(known))
    marks = sorted({m for _, m in ended.values()})
    first = [x if w else h for x, h, w in zip(texts, heads, whole.tolist(), strict=True)]

    def packs(asks: list[str], by_line: bool) -> list[bytes]:
        """The packed ids of each of asks, or of each of their lines."""
        flat = [np.array(e.ids, kind) for e in t.encode_batch_fast(asks, add_special_tokens=False)]
        ids = np.concatenate([*flat, np.zeros(0, kind)])
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        starts = np.append(0, ends[:-1])
        if by_line:
            ends = np.flatnonzero(ids == line_id)
            starts = np.append(0, ends[:-1] + 1)
        packed = ids.tobytes()
        return list(map(packed.__getitem__, map(slice, (starts * kind.itemsize).tolist(), (ends * kind.itemsize).tolist())))

    # letters alone, with their blank, are one match: the library's model is asked for them without its split
    letters = list(filter(LETTERS.fullmatch, asked)) if line_id is not None else []
    if letters:
        known.update(zip(letters, of_letters(model, letters, kind, line_id), strict=True))
        asked = [x for x in asked if x not in known]
    # a line's end is a match of its own before a blank, so many words are asked for as the lines of one text
    inner = [x for x in asked if "\n" in x or x[0] == " "] if line_id is not None else asked
    lines = [x for x in asked if "\n" not in x and x[0] != " "] if line_id is not None else []
    asks = [" " + "\n ".join(lines[i : i + LINES]) + "\n" for i in range(0, len(lines), LINES)]
    if lines:
        known.update(zip(lines, packs(asks, True), strict=True))
    cut = iter(packs(["\n" + x[1:] if x[0] == " " else " " + x for x in inner] + marks + first, False))
    known.update(zip(inner, islice(cut, len(inner)), strict=True))
    marks = dict(zip(marks, islice(cut, len(marks)), strict=True))
    for x, (word, mark) in ended.items():
        known[x] = known[word] + marks[mark]
    # the ids of the different pieces one after the other, then those that begin each text; a text is a choice of such stretches
    for i in np.flatnonzero(lacks & ~used).tolist():
        held[i] = b""
    for i, x in zip(np.flatnonzero(used & lacks).tolist(), new, strict=True):
        held[i] = b"".join([known[y] for y in lined[x]]) if x in lined else known[x]
    held.extend(cut)
    sizes = np.fromiter(map(len, held), np.int64, len(held)) // kind.itemsize
    nth[starts] = len(words) + np.arange(len(texts))
    taken = np.where(cuts | ~after, sizes[nth], 0)
    ends = np.cumsum(taken)
    at = np.repeat((np.cumsum(sizes) - sizes)[nth] - (ends - taken), taken) + np.arange(ends[-1])
    packed = np.frombuffer(b"".join(held), kind)[at].tobytes()
    stop = (ends[starts + counts - 1] * kind.itemsize).tolist()
    out = [packed[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]
    for x in [*letters, *asked, *ended]:
        if len(x) > CACHE_CHARS:
            known.pop(x, None)
    return out


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, id: str = "doc_id", text: str = "text", end_id: int = 0, block_tokens: int = 1 << 20, checkpoint_steps: int = 128, blocks_per_file: int = 8) -> None:
    """Writes the ids of every text of df under path."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    docs = docs.repartitionByRange("id").withColumn("h", F.xxhash64("text")).sortWithinPartitions("id", "h").select("id", "text")
    kind = tokenizer(tokenizer_path)[1]
    end, width = np.array([end_id], kind).tobytes(), kind.itemsize

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            lens = np.array([len(x) // width for x in held], "<u4").tobytes()
            row = {"part": part, "block": block, "before": before, "n": size, "ids": ids, "lens": lens, "tokens": b"".join(held)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("lens", pa.binary()), ("tokens", pa.binary())]))

        for b in batches:
            for s in sliced(b, [1], 8 << 20):
                for i, x in zip(s.column(0).to_pylist(), token_ids(s.column(1).to_pylist(), tokenizer_path), strict=True):
                    ids.append(i)
                    held.append(x + end)
                    size += len(x) // width + 1
                    if size >= block_tokens:
                        yield close()
                        block, before, size, ids, held = block + 1, before + size, 0, [], []
        if held:
            yield close()

    blocks = staged(docs.mapInArrow(collect, "part long, block long, before long, n long, ids array<long>, lens binary, tokens binary"), "token_blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for x in b.column(0):
                more = np.bincount(np.frombuffer(x.as_buffer(), kind))
                total = np.pad(total, (0, max(0, len(more) - len(total))))
                total[: len(more)] += more
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    # as many rows as the vocabulary has entries, and one for each partition
    counted = blocks.select("tokens").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.token for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r.token] = r.n
    # one row for each partition of the sort
    parts = sorted((r.part, r.n, r.blocks) for r in blocks.groupBy("part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("blocks")).collect())
    base, at, nth = {}, 0, 0
    for part, n, k in parts:
        base[part], at, nth = (at, nth), at + n, nth + k
    table = Table.of_counts(counts)
    freq = table.freq.astype("<u4").tobytes()
    head = pack({"kind": "table", "scale": SCALE, "crc_of": table.crc}, {"freq": freq})
    write_blocks(spark.createDataFrame([(bytearray(head),)], "block binary").coalesce(1), "block", END_MARK, f"{path}/table", 1)
    shared = spark.sparkContext.broadcast((freq, base))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, base = shared.value
        table = Table(np.frombuffer(freq, "<u4"))
        for b in batches:
            for r in range(b.num_rows):
                part, block, before, n, ids, lens, tokens = (b.column(i)[r] for i in range(7))
                values = np.frombuffer(tokens.as_buffer(), kind)
                reads, states, words = encode_ids(values, table, checkpoint_steps)
                span = checkpoint_steps * LANES
                crcs = [zlib.crc32(values[i : i + span].astype("<u4").tobytes()) for i in range(0, len(values), span)]
                names = ids.values
                sections = {"ids": np.array(names.fill_null(0), "<i8").tobytes(), "null": np.packbits(np.array(names.is_null())).tobytes(), "lens": lens.as_py(), "states": b"".join(states), "words": words}
                header = {"kind": "ids", "part": part.as_py(), "block": block.as_py(), "start": base[part.as_py()][0] + before.as_py(), "n": n.as_py(), "docs": len(names), "lanes": LANES, "every": checkpoint_steps, "reads": reads, "crcs": crcs, "table": table.crc}
                yield pa.RecordBatch.from_arrays([pa.array([pack(header, sections)], pa.binary())], names=["block"])

    # staged blocks are read in any order: each goes to the file that holds its place among all blocks
    numbers = F.broadcast(spark.createDataFrame([(p, i) for p, (_, i) in base.items()], "part long, nth long"))
    placed = blocks.join(numbers, "part").withColumn("place", F.col("nth") + F.col("block"))
    files = max(1, -(-nth // blocks_per_file))
    ordered = placed.repartitionById(files, (F.col("place") / blocks_per_file).cast("int")).sortWithinPartitions("place")
    write_blocks(ordered.select("part", "block", "before", "n", "ids", "lens", "tokens").mapInArrow(encode, "block binary"), "block", END_MARK, f"{path}/ids", blocks_per_file)


def block_ids(header: dict, sections: dict[str, memoryview], table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those between two of its checkpoints."""
    if header["table"] != table.crc:
        raise ValueError("the block was written with another table")
    words, every, size = np.frombuffer(sections["words"], "<u4"), header["every"], header["lanes"] * 8
    out = []
    for k in range(first, len(header["reads"]) if last is None else last):
        state = bytes(sections["states"][k * size : (k + 1) * size])
        ids = decode_ids(header["n"], table, state, words, header["reads"][k], k * every, (k + 1) * every)
        if zlib.crc32(ids.astype("<u4").tobytes()) != header["crcs"][k]:
            raise ValueError("the ids differ from those that were written")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document under path; ids as little-endian unsigned 32-bit integers."""
    content = read_files(spark, f"{path}/table").first().content
    freq = bytes(next(unpack(bytes(content)))[1]["freq"])
    shared = spark.sparkContext.broadcast(freq)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(np.frombuffer(shared.value, "<u4"))
        for b in batches:
            for c in b.column(0):
                for header, sections in unpack(c.as_buffer()):
                    ids = block_ids(header, sections, table).astype("<u4").tobytes()
                    lens = np.frombuffer(sections["lens"], "<u4").astype(np.int64)
                    ends = np.cumsum(lens)
                    names = pa.array(np.frombuffer(sections["ids"], "<i8"), mask=np.unpackbits(np.frombuffer(sections["null"], np.uint8), count=header["docs"]).astype(bool))
                    offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                    packed = pa.Array.from_buffers(pa.binary(), len(lens), [None, offsets, pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([names, pa.array(header["start"] + ends - lens), pa.array(lens), packed], names=["doc_id", "start", "n_tokens", "ids"])

    return read_files(spark, f"{path}/ids").select("content").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """What is read back of df's ids once they are written in the shared folder."""
    path = fresh_path(df.sparkSession, "token_files")
    write_tokens(df, path, tokenizer_path, **options)
    return read_tokens(df.sparkSession, path)
