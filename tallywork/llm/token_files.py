"""Token files of directly addressable codes.

A file holds the ids of some pages one after another. Each id is cut into chunks of eight bits, lowest first. Level
0 has the first chunk of every id, level k the chunk k of those ids that need one. A level stores its chunks, a
bitmap that says which of them go on to the next level, and a rank directory: the number of set bits before each
block of 512. Where an id's next chunk lies follows from the rank of its bit, so any id is read by a few look-ups,
without decoding what stands before it.

Layout, all little-endian: 8 bytes magic, uint32 length of the JSON head, the head, then the sections at the offsets
that the head names, counted from the start of the file. Sections of pages: int64 page ids, uint8 "id is missing",
int64 end of each page's ids within the file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywork.llm.common import page_texts
from tallywork.llm.shingles import BASE, INVERSE, mixed, power
from tallywork.session import write_scratch

register_pickle_by_value(sys.modules[__name__])

MAGIC = b"DACODES1"
RANK_BLOCK = 512
CACHED_WORDS = 1 << 20  # with their ids some 40 MB
SLICE_BYTES = 1 << 20
LONG_WORD = 256  # bytes from which a word's hash is a digest
WORDS_AT_ONCE = 64
#: White space to spaces and ASCII letters to lower case, byte by byte.
PLAIN = bytes.maketrans(b"\t\n\r" + string.ascii_uppercase.encode(), b"   " + string.ascii_lowercase.encode())
BREAK = re.compile(rb"[ \t\n\r]")
#: Letters of ASCII and of U+00C0 to U+00FF, in UTF-8.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")

# hashes of words: a sum over their bytes by place, in which a space counts 0
_LETTER = mixed(np.arange(1, 257, dtype="uint64") * BASE)
_LETTER[32] = 0


class TokenFile:
    """Random access to the ids of one file, given as a buffer (bytes or a memory map)."""

    def __init__(self, buffer) -> None:
        if bytes(buffer[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = int(np.frombuffer(buffer, "<u4", 1, 8)[0])
        head = json.loads(bytes(buffer[12:12 + size]))

        def section(at: dict) -> np.ndarray:
            return np.frombuffer(buffer, at["type"], at["count"], at["offset"])

        self.n_tokens: int = head["n_tokens"]
        self.levels = [{name: section(at) for name, at in level.items()} for level in head["levels"]]
        self.page_ids, self.missing, self.ends = (section(head[k]) for k in ("page_ids", "missing", "ends"))

    def __getitem__(self, places) -> np.ndarray:
        """The ids at the places given, each by one look-up a level."""
        at = np.atleast_1d(np.asarray(places, "int64"))
        if at.size and (at.min() < 0 or at.max() >= self.n_tokens):
            raise IndexError("place outside the file")
        ids = np.zeros(at.size, "uint32")
        live = np.arange(at.size)
        for k, level in enumerate(self.levels):
            ids[live] |= level["chunks"][at].astype("uint32") << np.uint32(8 * k)
            goes_on = (level["more"][at >> 3] >> (at & 7).astype("uint8")) & 1 == 1
            live, at = live[goes_on], at[goes_on]
            if not live.size:
                break
            at = _rank(level, at)
        return ids

    def all_ids(self) -> np.ndarray:
        """All ids in order: each level fills in the ids that the bitmap above sends to it."""
        ids, live = np.zeros(self.n_tokens, "uint32"), np.arange(self.n_tokens)
        for k, level in enumerate(self.levels):
            ids[live] |= level["chunks"].astype("uint32") << np.uint32(8 * k)
            live = live[np.unpackbits(level["more"], count=len(level["chunks"]), bitorder="little") == 1]
        return ids


def _rank(level: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Set bits before each place: the directory's count, and at most one block of bits counted."""
    ranks = level["ranks"][at // RANK_BLOCK].astype("int64")
    width = RANK_BLOCK // 8
    first = at // RANK_BLOCK * width
    columns = first[:, None] + np.arange(width)
    block = np.where(columns < len(level["more"]), level["more"][np.minimum(columns, len(level["more"]) - 1)], 0)
    bits = np.unpackbits(block.astype("uint8"), axis=1, bitorder="little")
    before = np.arange(RANK_BLOCK) < (at % RANK_BLOCK)[:, None]
    return ranks + (bits.astype(bool) & before).sum(axis=1)


def token_file_bytes(ids: np.ndarray, page_ids: list[int | None], ends: list[int]) -> bytes:
    """The file of ``ids``, of which page k has those from ``ends[k - 1]`` to ``ends[k]``."""
    sections: list[bytes] = []
    offset = 0

    def put(values: np.ndarray) -> dict:
        nonlocal offset
        raw = values.tobytes()
        at = {"type": values.dtype.str, "count": int(values.size), "offset": offset}
        sections.append(raw + bytes(-len(raw) % 8))
        offset += len(sections[-1])
        return at

    levels, rest = [], np.asarray(ids, "<u4")
    while rest.size:
        more = (rest >> np.uint32(8)) > 0
        filled = np.zeros(-(-rest.size // RANK_BLOCK) * RANK_BLOCK, bool)
        filled[:rest.size] = more
        counts = filled.reshape(-1, RANK_BLOCK).sum(axis=1)
        levels.append({
            "chunks": put((rest & np.uint32(0xFF)).astype("u1")),
            "more": put(np.packbits(more, bitorder="little")),
            "ranks": put(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8"))})
        rest = rest[more] >> np.uint32(8)
    head = {
        "n_tokens": int(len(ids)), "levels": levels,
        "page_ids": put(np.array([p or 0 for p in page_ids], "<i8")),
        "missing": put(np.array([p is None for p in page_ids], "u1")),
        "ends": put(np.array(ends, "<i8"))}
    # the head's length depends on the offsets in it: they are written relative and moved by a fixed start
    start = 0
    while True:
        moved = _moved(head, start)
        text = json.dumps(moved).encode()
        needed = -(-(12 + len(text)) // 8) * 8
        if needed == start:
            break
        start = needed
    return b"".join([MAGIC, np.array([len(text)], "<u4").tobytes(), text, bytes(start - 12 - len(text)), *sections])


def _moved(head, by: int):
    """``head`` with every offset in it raised by ``by``."""
    if isinstance(head, dict):
        return {k: v + by if k == "offset" else _moved(v, by) for k, v in head.items()}
    return [_moved(v, by) for v in head] if isinstance(head, list) else head


class WordEncoder:
    """Ids of UTF-8 texts whose tokenizer drops white space, ignores case and marks the end of every piece.

    Equal to encoding the whole text at once: normalisation (composition, lower case by character) never looks across a
    space, and a full stop or comma between a letter and a space is a piece of its own. All words of a slice of texts are
    found and hashed at once and looked up in a sorted table of known hashes; what that doesn't have is encoded, new words of
    Latin letters WORDS_AT_ONCE in one text, any other word by itself. A table with more than CACHED_WORDS words forgets the half
    that was used least.

    With ``markers`` the strings of the tokenizer's added tokens, as they are written, stand for their ids, which is what the
    library does by default: it cuts a text at them first. Otherwise they are ordinary text.
    """

    def __init__(self, tokenizer_path: str, end_id: int, markers: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True  # words don't hold markers; in lower case they may look like one
        added = self.tokenizer.get_added_tokens_decoder() if markers else {}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special for t in added.values()):
            raise ValueError("markers must be special tokens that are met as they are written")
        self.markers = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        longest_first = sorted(self.markers, key=len, reverse=True)
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")") if added else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.end = np.array([end_id], "<u4").tobytes()
        self.words: dict[bytes, bytes] = {}  # those being learned
        self.hashes, self.first, self.count = np.zeros(0, "uint64"), np.zeros(0, "int64"), np.zeros(0, "int64")
        self.used, self.pool, self.pooled = np.zeros(0, "int64"), np.zeros(1 << 16, "uint32"), 0

    def _alone(self, words: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(words, found, strict=True))

    def _together(self, words: list[bytes]) -> None:
        """Words of letters, many in one text; should a text not have an end for each word, its words one by one."""
        groups = [words[i:i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        found = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, e in zip(groups, found, strict=True):
            ids = np.array(e.ids, "<u4")
            cuts = 4 * (np.flatnonzero(self.ends_piece[ids]) + 1)
            if len(cuts) == len(group):
                raw, cuts = ids.tobytes(), [0, *cuts.tolist()]
                self.words.update(zip(group, (raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
            else:
                self._alone(group)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, with the end id."""
        if self.cut is None:
            return [ids + self.end for ids in self._encode(texts)]
        # every second part of a text is a marker; hardly any text has one
        parts = [self.cut.split(t) if b"<" in t else [t] for t in texts]
        between = iter(self._encode([x for some in parts for x in some[::2]]))
        return [b"".join(self.markers[x] if i % 2 else next(between) for i, x in enumerate(some)) + self.end for some in parts]

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Slices of about SLICE_BYTES at a time; a longer text is cut at white space, as no word or rule crosses it."""
        out: list[list[bytes]] = [[] for _ in texts]
        slice_, owners, size = [], [], 0

        def finish() -> None:
            nonlocal size
            for owner, ids in zip(owners, self._encode_slice(slice_), strict=True):
                out[owner].append(ids)
            slice_.clear()
            owners.clear()
            size = 0

        for owner, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = BREAK.search(text, at + SLICE_BYTES) if len(text) - at > SLICE_BYTES else None
                end = cut.start() if cut else len(text)
                slice_.append(text[at:end])
                owners.append(owner)
                size += end - at
                at = end
                if size >= SLICE_BYTES:
                    finish()
        if slice_:
            finish()
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _encode_slice(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts) + b" "
        low = np.frombuffer(joined.translate(PLAIN), "uint8")
        solid = low != 32
        before, after = np.zeros_like(solid), np.zeros_like(solid)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        stop = np.isin(low, (44, 46)) & ~after
        stop[1:] &= (low[:-1] >= 97) & (low[:-1] <= 122)
        stop[0] = False
        starts = np.flatnonzero(solid & (~before | stop))
        stops_next = np.zeros_like(stop)
        stops_next[:-1] = stop[1:]
        ends = np.flatnonzero(solid & (~after | stops_next)) + 1
        place = self._look_up(low, starts, ends)
        count = self.count[place]
        reached = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.first[place] - reached[:-1], count) + np.arange(reached[-1])]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = [0, *reached[np.searchsorted(starts, text_ends)].tolist()]
        raw = ids.astype("<u4").tobytes()
        if len(self.hashes) > CACHED_WORDS:
            self._forget()
        return [raw[4 * x:4 * y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]

    def _look_up(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the table of each word; new ones are learned first."""
        if not starts.size:
            return np.zeros(0, "int64")
        terms = _LETTER[low]
        terms *= power(BASE, low.size)
        hashes = np.add.reduceat(terms, starts) * power(INVERSE, low.size)[starts]
        lengths = ends - starts
        hashes = mixed(hashes + lengths.astype("uint64") * BASE)
        for i in np.flatnonzero(lengths > LONG_WORD):
            hashes[i] = int.from_bytes(hashlib.blake2b(low[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(place.size, bool)
        inside = place < self.hashes.size
        known[inside] = self.hashes[place[inside]] == hashes[inside]
        if not known.all():
            fresh = np.flatnonzero(~known)
            new, first = np.unique(hashes[fresh], return_index=True)
            at = fresh[first]
            words = [low[x:y].tobytes() for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(new, words)
            place = np.searchsorted(self.hashes, hashes)
        self.used += np.bincount(place, minlength=self.used.size)
        return place

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        letters, other = [], []
        for word in words:
            (letters if LATIN.fullmatch(word) else other).append(word)
        for learn, some in ((self._together, letters), (self._alone, other)):
            for i in range(0, len(some), 1024):
                learn(some[i:i + 1024])
        found = [self.words[w] for w in words]
        self.words = {}
        count = np.array([len(x) // 4 for x in found])
        ids = np.frombuffer(b"".join(found), "<u4")
        if self.pooled + ids.size > self.pool.size:
            self.pool = np.concatenate([self.pool[:self.pooled], np.zeros(self.pooled + ids.size, "uint32")])
        self.pool[self.pooled:self.pooled + ids.size] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, at, self.pooled + np.cumsum(count) - count)
        self.hashes, self.count, self.used = (np.insert(x, at, y) for x, y in ((self.hashes, hashes), (self.count, count), (self.used, 0)))
        self.pooled += ids.size

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.used, kind="stable")[:CACHED_WORDS // 2])
        self.hashes, count, first = self.hashes[keep], self.count[keep], self.first[keep]
        start = np.cumsum(count) - count
        self.pool = self.pool[np.repeat(first - start, count) + np.arange(count.sum())]
        self.first, self.count, self.used, self.pooled = start, count, self.used[keep] // 2, int(count.sum())


def kept_encoder(*settings) -> WordEncoder:
    """The encoder of these settings, kept in the worker process from task to task with the words that it knows."""
    held = sys.modules.setdefault("_tallywork_encoders", types.ModuleType("_tallywork_encoders")).__dict__
    if settings not in held:
        held[settings] = WordEncoder(*settings)
    return held[settings]


def _file_system(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:/"):
        system, path = fs.FileSystem.from_uri("file://" + folder[5:] if folder.startswith("file:/") and "//" not in folder else folder)
        return system, path
    return fs.LocalFileSystem(), folder


def write_token_files(
    pages: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, tokens_a_file: int = 1 << 22, markers: bool = False
) -> DataFrame:
    """Write the ids of ``pages(page_id, html)`` in ascending page_id order below ``folder``; return the list of files.

    Every page's ids are those of its whole text, followed by ``end_id``; missing and empty texts have the end id alone.
    Missing page ids come first; rows of one page_id are ordered by their text's hash, repeated rows stay repeated.
    An empty table writes no file. ``tokenizer_path`` is the same on every worker; its tokenizer must drop white space.
    With ``markers`` a text's "<|endoftext|>" and the like give their one id, as the library does by default; else they are text.

    The rows are range-partitioned by (page_id, text hash) and sorted; each task encodes its range as a stream and starts
    another file after ``tokens_a_file`` ids (a page is never split). Files carry a random part in their names, and the
    list (path, part, place, n_pages, n_tokens, first_token), itself a written table, names only those of
    tasks that succeeded: a lost or repeated task leaves a file that nobody reads. ``first_token`` is the number
    of ids in all files before.
    """
    rows = page_texts(pages).withColumns({"page_id": F.col("page_id").cast("long"), "text_hash": F.xxhash64("html")})
    ordered = rows.repartitionByRange("page_id", "text_hash").sortWithinPartitions("page_id", "text_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        encoder, (system, root) = kept_encoder(tokenizer_path, end_id, markers), _file_system(folder)
        held: list[bytes] = []
        page_ids: list[int | None] = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal place
            name = f"part-{part:06d}-{place:06d}-{uuid.uuid4().hex}.dac"
            system.create_dir(root, recursive=True)
            with system.open_output_stream(f"{root}/{name}") as out:
                out.write(token_file_bytes(np.frombuffer(b"".join(held), "<u4"), page_ids, ends))
            row = pa.record_batch([
                pa.array([f"{folder}/{name}"]), pa.array([part], pa.int32()), pa.array([place], pa.int32()),
                pa.array([len(ends)], pa.int64()), pa.array([ends[-1]], pa.int64())], ["path", "part", "place", "n_pages", "n_tokens"])
            place += 1
            for x in (held, page_ids, ends):
                x.clear()
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                some = batch.slice(i, 1024)
                encoded = encoder.encode(some.column("html").to_pylist())
                for page_id, ids in zip(some.column("page_id").to_pylist(), encoded, strict=True):
                    held.append(ids)
                    page_ids.append(page_id)
                    ends.append((ends[-1] if ends else 0) + len(ids) // 4)
                    if ends[-1] >= tokens_a_file:
                        yield flush()
        if ends:
            yield flush()

    listed = write_scratch(
        ordered.select("page_id", F.encode("html", "utf-8").alias("html")).mapInArrow(write, "path string, part int, place int, n_pages long, n_tokens long"), "token_files")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = listed.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens")).select(  # a row a task
        "part", F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("before_part"))
    within = F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return listed.withColumn("within", within).join(parts, "part").select(
        "path", "part", "place", "n_pages", "n_tokens", (F.col("before_part") + F.col("within")).alias("first_token"))


def _tasks(files: DataFrame) -> int:
    return int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_token_files(files: DataFrame) -> DataFrame:
    """(page_id, start, n_tokens, ids) of every page in ``files(path, first_token)``.

    ``start`` counts all ids before the page, in all files. ``ids`` holds little-endian unsigned 32-bit integers.
    A task holds one file at a time.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first in zip(batch["path"], batch["first_token"], strict=True):
                system, local = _file_system(path)
                with system.open_input_file(local) as source:
                    file = TokenFile(source.read())
                ids = file.all_ids().astype("<u4").tobytes()
                starts = np.concatenate([[0], file.ends[:-1]]).astype("int64")
                for i in range(0, len(file.ends), 1024):
                    begin, end = starts[i:i + 1024], file.ends[i:i + 1024]
                    page_ids = pd.array(file.page_ids[i:i + 1024], dtype="Int64")
                    page_ids[file.missing[i:i + 1024] == 1] = pd.NA
                    yield pd.DataFrame({
                        "page_id": page_ids, "start": first + begin, "n_tokens": end - begin,
                        "ids": [ids[4 * a:4 * b] for a, b in zip(begin, end, strict=True)]})

    # rows of a few bytes stand for whole files: a fixed number of tasks, which adaptive execution doesn't merge
    spread = files.select("path", "first_token").repartition(_tasks(files), "path")
    return spread.mapInPandas(read, "page_id long, start long, n_tokens long, ids binary")


def read_tokens(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(place, id) for each global place in ``wanted(place)``: random access, no file is decoded.

    Places outside the files give no row. ``files`` is the list of :func:`write_token_files`.
    """
    # a place belongs to the last file that starts at or before it: places and file starts merge in one order
    by_file = Window.partitionBy("bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    width = 1 << 26
    # a file is listed in every bucket of places that it touches, so that buckets can be searched apart
    starts = files.filter("n_tokens > 0").select(
        F.explode(F.sequence(F.floor(F.col("first_token") / width), F.floor((F.col("first_token") + F.col("n_tokens") - 1) / width)))
        .alias("bucket"), F.col("first_token").alias("at"), F.lit(0).alias("kind"), "path", "first_token", "n_tokens")
    asked = wanted.select(
        F.floor(F.col("place") / width).alias("bucket"), F.col("place").cast("long").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("first_token"),
        F.lit(None).cast("long").alias("n_tokens")).filter(F.col("at").isNotNull())
    file = F.last(F.when(F.col("kind") == 0, F.struct("path", "first_token", "n_tokens")), ignorenulls=True).over(by_file)
    found = starts.unionByName(asked).withColumn("file", file).filter("kind = 1 AND at < file.first_token + file.n_tokens")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (path, first), group in batch.groupby(["path", "first_token"]):
                system, local = _file_system(path)
                with system.open_input_file(local) as source:
                    ids = TokenFile(source.read())[group["place"].to_numpy() - first]
                yield pd.DataFrame({"place": group["place"].to_numpy(), "id": ids.astype("int64")})

    chosen = found.select(F.col("at").alias("place"), "file.path", "file.first_token").repartition(_tasks(files), "path").sortWithinPartitions("path")
    return chosen.mapInPandas(look_up, "place long, id long")
