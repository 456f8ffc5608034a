"""Alignment of two tokenizers' output over the same texts, with segments tokenised once.

A text is cut before runs of white space, at places where neither vocabulary can merge across: the first
tokenizer's pattern never joins what is no white space with white space after it, and the second is cut
only before characters that none of its pieces holds behind another kind of character (looked up in its
vocabulary). So a text's tokens are its segments' tokens side by side, and segments recur: they are
tokenised and aligned once each, and the alignments are joined back to the documents.

Documents are held in blocks of bounded size, each with the list of its distinct segments, and a
document is a list of places in it. Only such lists are shuffled, never a row for every occurrence, so
that the commonest segment is one row a block.

1. ``blocks``: one row a block, written to the checkpoint folder.
2. ``aligned``: distinct segments with their number of occurrences, ids, groups and overlapping pairs.
3. ``pair_counts``: how often a pair of ids is linked in all documents, and whether this is its second id's most.
4. ``alignments``: what the pairs sum up to for each segment.
5. ``parcels``: alignments joined back to the blocks' segments, packed and compressed by block; documents composed from them.

Each step is written to the checkpoint folder, and what no later step reads is removed.

Defined cases: a text that is null, empty or not given back by both tokenizers has no tokens: zeros and an
empty ``groups_sha256``, and its segments count nowhere. Texts of any length are taken whole; one without
white space is one segment. Repeated rows count each for itself; a null id is kept; an empty table gives
an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import discard, stored

#: Characters of text in a block. With its list of segments a block takes a few times as many bytes.
BLOCK_CHARS = 16_000_000
#: Pairs held by at least this share of all distinct segments' pairs are joined apart from the others: at most 1 / share of them.
HOT_SHARE = 1 / 1000
#: Rows of a parcel at most.
PARCEL_ROWS = 100_000
_CUTS = " \t\n"


class Numbered(dict):
    """Keys numbered in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def splitter(cuts: str):
    """Cuts a text before those of the characters ``cuts`` that stand behind one that is no white space."""
    if not cuts:
        return lambda text: [text]
    other = rf"[^\S{cuts}]\s*"  # white space that is no place to cut, with what follows it
    return re.compile(rf"\s*\S+(?:{other}\S+)*(?:{other}\Z)?|\s+\Z").findall


class Pair:
    """The two tokenizers, and where they may be cut. Made once a Python worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from lakequill.llm.bpe import byte_characters

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        back = {c: b for b, c in enumerate(byte_characters())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            if all(c in back for c in s):
                self.a_bytes[i] = bytes(back[c] for c in s)
        self.a_length = np.array([len(b) for b in self.a_bytes])
        self.b_bytes, pieces = [], []
        for i in range(self.b.get_piece_size()):
            p = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.b_bytes.append(bytes([int(p[1:-1], 16)]))
            else:
                self.b_bytes.append(p.replace("▁", " ").encode())
                pieces.append(p)
        self.b_length = np.array([len(b) for b in self.b_bytes])
        self.space = self.b.piece_to_id("▁")
        # a cut before a character is sound if no piece holds that character behind one that is no white space
        cuts = "".join(c for c in _CUTS if not any(re.search(rf"[^\s▁]{'▁' if c == ' ' else c}", p) for p in pieces))
        # and, for those that are not the space, if no piece holds them at all, as the tokenizer's own space stands before them
        cuts = "".join(c for c in cuts if c == " " or not any(c in p for p in pieces))
        self.split = splitter(cuts)
        self.sound: dict[str, bool] = {}

    def given_back(self, text: str) -> bool:
        """Whether the second tokenizer gives back every character; it works character by character, so each is tried once."""
        chars = set(text)
        for c in chars.difference(self.sound):
            self.sound[c] = b"".join(self.b_bytes[i] for i in self.b.encode(f"a{c}a")) == f" a{c}a".encode()
        return all(map(self.sound.__getitem__, chars))

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Segments begin with the white space that the tokenizer would put before them, or the space it adds is taken off."""
        own = [s.startswith(" ") for s in segments]
        ids = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        for k, o in enumerate(own):
            if not o:
                if ids[k][:1] != [self.space]:
                    raise ValueError(f"the added space merged with segment {segments[k]!r}")
                del ids[k][0]
            elif segments[k] == " ":
                ids[k] = [self.space]  # of an empty text the tokenizer makes nothing
        return ids

    def align(self, segments: list[str]) -> list[tuple]:
        """``(n_a, n_b, n_groups, groups, pairs a, pairs b, times)`` of each segment."""
        out = []
        for seg, x, y in zip(segments, (e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)), self.encode_b(segments), strict=True):
            if b"".join(map(self.a_bytes.__getitem__, x)) != seg.encode() or b"".join(map(self.b_bytes.__getitem__, y)) != seg.encode():
                raise ValueError(f"segment {seg!r} is not given back")
            out.append(_align(x, y, self.a_length, self.b_length))
        return out


def _align(x: list[int], y: list[int], x_length: np.ndarray, y_length: np.ndarray) -> tuple:
    """Merges the two lists of token ends: a link for each two tokens that overlap, a new group where both end."""
    links: dict[tuple[int, int], int] = {}
    groups, i, j, gi, gj = [], 0, 0, 0, 0
    xe, ye = int(x_length[x[0]]), int(y_length[y[0]])
    while True:
        links[x[i], y[j]] = links.get((x[i], y[j]), 0) + 1
        if xe == ye:
            groups.append(",".join(map(str, x[gi : i + 1])) + "|" + ",".join(map(str, y[gj : j + 1])))
            i, j = i + 1, j + 1
            gi, gj = i, j
            if i == len(x):
                break
            xe, ye = xe + int(x_length[x[i]]), ye + int(y_length[y[j]])
        elif xe < ye:
            i += 1
            xe += int(x_length[x[i]])
        else:
            j += 1
            ye += int(y_length[y[j]])
    return len(x), len(y), len(groups), ";".join(groups), [a for a, _ in links], [b for _, b in links], list(links.values())


@lru_cache(maxsize=2)
def pair(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def blocks(docs: DataFrame, byte_path: str, piece_path: str, chars: int = BLOCK_CHARS) -> DataFrame:
    """``(block, doc_ids, sizes, places binary, segments, times)``: documents as lists of places among a block's distinct segments.

    ``sizes`` is the number of segments of each document, 0 for one without tokens; ``places`` holds them all as 32-bit integers, compressed.
    """
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("segments", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, number = pair(byte_path, piece_path), TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[int] = []
        places: list[np.ndarray] = []
        known = Numbered()
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, sizes, places, known, held, number
            flat = np.concatenate(places) if places else np.empty(0, np.int32)
            row = [number, ids, sizes, pa.compress(flat.astype("<i4").tobytes(), "zstd", asbytes=True), list(known), np.bincount(flat, minlength=len(known)).tolist()]
            ids, sizes, places, known, held, number = [], [], [], Numbered(), 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                segments = two.split(" " + text) if text and two.given_back(text) else []
                places.append(np.fromiter(map(known.__getitem__, segments), np.int32, len(segments)))
                ids.append(key)
                sizes.append(len(segments))
                held += len(text or "") + 8
                if held >= chars:
                    yield close()
        if ids:
            yield close()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, doc_ids array<long>, sizes array<int>, places binary, segments array<string>, times array<long>")


def aligned(blocks: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``(number, segment, occurs, n_a, n_b, n_groups, groups, pairs)`` of every distinct segment; ``pairs`` is an array of ``(a, b, times)``.

    ``number`` is fixed only once the rows are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(byte_path, piece_path)
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 3
        names = ["segment", "occurs", "n_a", "n_b", "n_groups", "groups", "a", "b", "times"]
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                rows = two.align(part.column(0).to_pylist())
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    distinct = blocks.select(F.explode(F.arrays_zip("segments", "times")).alias("s")).groupBy(F.col("s.segments").alias("segment")).agg(F.sum("s.times").alias("occurs"))
    out = distinct.mapInArrow(run, "segment string, occurs long, n_a long, n_b long, n_groups long, groups string, a array<int>, b array<int>, times array<int>")
    return out.withColumn("pairs", F.arrays_zip("a", "b", "times")).drop("a", "b", "times").withColumn("number", F.monotonically_increasing_id())


def pair_counts(segments: DataFrame) -> DataFrame:
    """``(a, b, linked, best)``: links of each pair of ids in all documents, and whether no other first id has more with ``b``.

    The most of each second id has at most one row per entry of that vocabulary, so it is broadcast.
    """
    counts = segments.select("occurs", F.explode("pairs").alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum(F.col("occurs") * F.col("p.times")).alias("linked"), F.count("*").alias("held_by"))
    counts = stored(counts)
    most = counts.groupBy("b").agg(F.max("linked").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "linked", (F.col("linked") == F.col("most")).cast("long").alias("best"), "held_by")


def alignments(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """``(segment, n_a, n_b, n_groups, groups, n_best, count_sum)``, stored: the last two summed over each segment's links.

    Pairs that many segments hold, such as a comma with a comma, are joined apart: there are at most
    ``1 / HOT_SHARE`` of them, so they are broadcast, and no key of the shuffled join is hot.
    """
    total = counts.agg(F.coalesce(F.sum("held_by"), F.lit(0)).alias("n")).first()["n"]
    most = max(1.0, total * HOT_SHARE)
    hot = counts.where(F.col("held_by") > most).select(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("linked").alias("h_linked"), F.col("best").alias("h_best"))
    rows = segments.select("number", F.explode("pairs").alias("p")).select("number", F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.times").alias("times"))
    tried = rows.join(F.broadcast(hot), (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")), "left")

    def sums(linked: str, best: str) -> list:
        return ["number", (F.col("times") * F.col(best)).alias("n_best"), (F.col("times") * F.col(linked)).alias("count_sum")]

    often = tried.where("ha is not null").select(*sums("h_linked", "h_best"))
    cold = counts.where(F.col("held_by") <= most).select("a", "b", "linked", "best")
    seldom = tried.where("ha is null").select("number", "a", "b", "times").join(cold, ["a", "b"]).select(*sums("linked", "best"))
    both = stored(often.unionByName(seldom).groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    out = stored(segments.select("number", "segment", "n_a", "n_b", "n_groups", "groups").join(both, "number").drop("number"))
    discard(both)
    return out


def parcels(blocks: DataFrame, alignments: DataFrame) -> DataFrame:
    """``(of_block, parcel binary)``: alignments of each block's segments with their places, as compressed tables of ``PARCEL_ROWS`` rows at most."""

    def pack(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("of_block")
        keys = rows.column("of_block").to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        options, data = pa.ipc.IpcWriteOptions(compression="zstd"), []
        for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
            sink = pa.BufferOutputStream()
            part = rows.slice(lo, hi - lo).drop_columns("of_block").combine_chunks()
            with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                writer.write_table(part)
            data.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts], pa.int64()), pa.array(data, pa.binary())], names=["of_block", "parcel"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= PARCEL_ROWS:
                yield from pack(pa.Table.from_batches(held))
                held = []
        if sum(x.num_rows for x in held):
            yield from pack(pa.Table.from_batches(held))

    listed = blocks.select(F.col("block").alias("of_block"), F.posexplode("segments").alias("place", "segment"))
    return listed.join(alignments, "segment").drop("segment").mapInArrow(run, "of_block long, parcel binary")


def compose(blocks: DataFrame, parcels: DataFrame, digest: bool = True) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every document, or ``groups`` itself with ``digest`` false.

    A group of p and q tokens has p + q - 1 links, as its tokens end together only at its end.
    """
    last = "groups_sha256" if digest else "groups"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", last]

    def run(docs: pa.Table, sent: pa.Table) -> pa.Table:
        cols: list[list] = [[] for _ in names]
        read = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in sent.column("parcel")]
        sums, groups = np.zeros((0, 6), np.int64), []
        if read:
            parts = pa.concat_tables(read).sort_by("place")
            groups = parts.column("groups").to_pylist()
            n_a, n_b, n_groups, *others = (parts.column(c).to_numpy() for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum"))
            sums = np.stack([n_a, n_b, n_groups, n_a + n_b - n_groups, *others], axis=1)
        for ids, sizes, raw in zip(docs.column("doc_ids").to_pylist(), docs.column("sizes").to_pylist(), docs.column("places").to_pylist(), strict=True):
            places, lo = np.frombuffer(pa.decompress(raw, 4 * sum(sizes), "zstd"), "<i4"), 0
            for key, size in zip(ids, sizes, strict=True):
                mine = places[lo : lo + size]
                lo += size
                for k, value in enumerate([key, *sums[mine].sum(axis=0).tolist()]):
                    cols[k].append(value)
                joined = ";".join(map(groups.__getitem__, mine.tolist()))
                cols[-1].append(hashlib.sha256(joined.encode()).hexdigest() if digest and size else joined)
        return pa.table([pa.array(c, pa.string() if n == last else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    return blocks.select("block", "doc_ids", "sizes", "places").groupBy("block").cogroup(parcels.groupBy("of_block")).applyInArrow(run, ", ".join(f"{n} {'string' if n == last else 'long'}" for n in names))


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = True, chars: int = BLOCK_CHARS) -> DataFrame:
    """Both tokenizers' alignment of every document of ``docs(doc_id, text)``; see the module."""
    cut = stored(blocks(docs, byte_path, piece_path, chars))
    segments = stored(aligned(cut, byte_path, piece_path))
    counts = stored(pair_counts(segments))
    summed = alignments(segments, counts)
    discard(segments, counts)
    sent = stored(parcels(cut, summed))
    discard(summed)
    return compose(cut, sent, digest)
