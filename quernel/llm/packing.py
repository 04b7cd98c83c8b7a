"""Best-fit packing of token sequences with exact complements.

Where a piece goes depends on its length alone, and there are at most ``capacity`` lengths, so the plan is made on the driver
from the number of pieces of each length, whatever their number. Longest lengths first, the gap that a length leaves is looked up among the
sums of one, two and three available lengths (found by hashing: a length is its own key, a pair is a length whose complement is
there, a triple is a length with such a pair); a combination that fills the gap exactly is taken as often as the counts of its members allow.
What is left goes by best fit: into the fullest sequences that still have room, and into new ones where none has.

A plan is a table of ranges: pieces number a to b of a length go to sequences s to s + b - a at one offset. Each step of the plan
uses up a length or all sequences of one fill, so there are few ranges, and the table that is broadcast is bounded by ``capacity``.
Pieces are numbered within their length by the counts of tasks, so a length that most pieces have is spread over all tasks.

Ids come from the tokenizers library, word by word: texts are cut at spaces that stand alone, where its own rule always cuts, and the ids of
words are kept in a table of bounded size. Texts with spaces amid other white space are handed to its rule whole.

Defined results: a null text is an empty one, which is the end token alone; very long texts are cut, the first piece being the
shorter one; repeated rows and ids are documents of their own; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from quernel.llm import arrow_text as at
from quernel.llm.bpe import PIECES, UNCOMMON, byte_letters, tokenizer_path
from quernel.session import materialize

CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64
WHITE = r"[\s\x1c-\x1f]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ODD_SPACE = re.compile(rf" (?={WHITE})(?<={WHITE} )")  # at each space the next character decides nearly always
RARE = re.compile(UNCOMMON.pattern)
SPACE_LETTER = "\u0120"
RANK_BITS = 42  # pieces of a length, below 2 ** 42, and their length share a key of 63 bits


class Recent(dict):
    """Values by key, made by ``make`` when first asked for; two generations of at most CACHE_WORDS are kept."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_WORD_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Ids:
    """Ids of whole texts as the tokenizers library gives them, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = {b: c for c, b in byte_letters().items()}
        self.cut = regex.compile(PIECES).findall
        self.pieces = Recent(self.piece)
        self.words = Recent(self.word)
        self.starts = Recent(self.rule)

    def piece(self, piece: str) -> bytes:
        """Ids of a text that the library doesn't cut."""
        letters = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.tokenize(letters)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a space and a word. Letters are one piece, and ASCII punctuation after them another."""
        if word.isalpha():
            if word.isascii():  # ASCII letters stand for themselves
                return array("I", [token.id for token in self.tokenize(SPACE_LETTER + word)]).tobytes()
            if not RARE.search(word):
                return self.piece(" " + word)
            return self.rule(" " + word)
        body = word.rstrip(PUNCTUATION)
        if body != word and body.isalpha():
            return self.words[body] + self.pieces[word[len(body) :]]
        return self.rule(" " + word)

    def rule(self, text: str) -> bytes:
        """Ids of any text, by the library's own cuts; where versions of Unicode may disagree about letters the library cuts itself."""
        if any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not text.isascii() and RARE.search(text):
            return b"".join(self.pieces[text[a:b]] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text):
            return self.rule(text)
        first, *rest = text.split(" ")
        return self.starts[first] + b"".join(map(self.words.__getitem__, rest))


def ids_of(path: str) -> Ids:
    """One table of ids per worker process and file."""
    loaded = at.cache("packing")
    if path not in loaded:
        at.make_room("packing")
        loaded[path] = Ids(path)
    return loaded[path]


def pieces_of(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int, keep_ids: bool) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (doc_id, piece, start, length, ids_crc32), ``task`` and ``nth``, the piece's number among those of
    its length in the task; with ``keep_ids`` the ids."""
    rows = docs.select(F.spark_partition_id().alias("task"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    fields = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()), ("nth", LongType())]
    schema = StructType(rows.schema.fields[:2])
    for name, kind in fields + [("ids", ArrayType(IntegerType()))] * keep_ids:
        schema = schema.add(name, kind)
    end = array("I", [end_id]).tobytes()

    def run(batches):
        words = ids_of(path)
        seen: dict[int, int] = defaultdict(int)
        for batch in at.parts(batches, 256):
            source, columns, ids = [], [[] for _ in fields], []
            for row, value in enumerate(batch.column(2)):
                encoded = words.encode(value.as_py() or "") + end
                begin, stop = 0, (len(encoded) // 4 - 1) % capacity + 1
                for piece in range(-(-len(encoded) // (4 * capacity))):
                    part = encoded[4 * begin : 4 * stop]
                    source.append(row)
                    for column, item in zip(columns, (piece, begin, stop - begin, zlib.crc32(part), seen[stop - begin])):
                        column.append(item)
                    if keep_ids:
                        ids.append(np.frombuffer(part, np.int32))
                    seen[stop - begin] += 1
                    begin, stop = stop, stop + capacity
            source = pa.array(source, pa.int64())
            out = [batch.column(0).take(source), batch.column(1).take(source)]
            out += [pa.array(c, pa.int32() if name == "piece" else pa.int64()) for c, (name, _) in zip(columns, fields)]
            if keep_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return rows.mapInArrow(run, schema)


class Plan:
    """Ranges of pieces of one length and where they go; ``counts`` has the number of pieces of each length. Gaps are filled exactly with
    combinations of up to ``members`` lengths before what is left goes by best fit."""

    def __init__(self, counts: dict[int, int], capacity: int, members: int = 3):
        self.capacity, self.members, self.sequences = capacity, members, 0
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, count in counts.items():
            self.left[length] = count
        self.taken = np.zeros(capacity + 1, dtype=np.int64)
        self.ranges: list[tuple[int, int, int, int]] = []  # length, first piece, first sequence, offset
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: first sequence, number of sequences
        self._exact()
        self._best_fit()

    def _put(self, length: int, times: int, sequence: int, offset: int) -> None:
        self.ranges.append((length, int(self.taken[length]), sequence, offset))
        self.taken[length] += times
        self.left[length] -= times

    def _complements(self, gap: int, size: int, most: int):
        """Combinations of ``size`` available lengths, at most ``most`` each and falling, that sum up to ``gap``; longest first."""
        if size == 1:
            if 0 < gap <= most and self.left[gap]:
                yield (gap,)
        elif size == 2:
            high = np.arange(min(most, gap - 1), -(-gap // 2) - 1, -1)
            for length in high[(self.left[high] > 0) & (self.left[gap - high] > 0)].tolist():
                yield length, gap - length
        else:
            for length in range(min(most, gap - size + 1), -(-gap // size) - 1, -1):
                if self.left[length]:
                    for rest in self._complements(gap - length, size - 1, length):
                        yield length, *rest
                        if not self.left[length]:
                            break

    def _fill(self, length: int, combination: tuple[int, ...]) -> None:
        members = (length, *combination)
        times = min(int(self.left[m]) // members.count(m) for m in set(members))
        if times:
            offset = 0
            for member in members:
                self._put(member, times, self.sequences, offset)
                offset += member
            self.sequences += times

    def _exact(self) -> None:
        if self.left[self.capacity]:
            times = int(self.left[self.capacity])
            self._put(self.capacity, times, self.sequences, 0)
            self.sequences += times
        for size in range(1, self.members + 1):
            for length in range(self.capacity - 1, 0, -1):
                if self.left[length]:
                    for combination in self._complements(self.capacity - length, size, length):
                        self._fill(length, combination)
                        if not self.left[length]:
                            break

    def _best_fit(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length]:
                room = min((r for r, runs in self.open.items() if r >= length and runs), default=None)
                count = int(self.left[length])
                if room is None:
                    each = self.capacity // length
                    for times, many in ((count // each, each), (1, count % each)):
                        if times and many:
                            for i in range(many):
                                self._put(length, times, self.sequences, i * length)
                            self.open[self.capacity - many * length].append((self.sequences, times))
                            self.sequences += times
                    continue
                first, times = self.open[room].pop()
                used = min(times, count)
                if used < times:
                    self.open[room].append((first + used, times - used))
                self._put(length, used, first, self.capacity - room)
                self.open[room - length].append((first, used))


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Exact combinations use up short pieces that best fit may need more: of the plans with triples, pairs and single complements the one with
    the fewest sequences."""
    return min((Plan(counts, capacity, members) for members in (3, 2, 1)), key=lambda plan: plan.sequences)


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """(Materialized) ``pieces`` with sequence_id and offset instead of task and nth."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("run"))
    before = F.sum("run").over(Window.partitionBy("length").orderBy("task")) - F.col("run")
    starts = counts.select("task", "length", before.alias("before"))
    ranked = pieces.join(starts, ["task", "length"]).withColumn("key", F.shiftleft("length", RANK_BITS) + F.col("before") + F.col("nth")).drop("task", "nth", "before")
    ranges = np.array(sorted(plan.ranges), dtype=np.int64).reshape(-1, 4)
    shared = pieces.sparkSession.sparkContext.broadcast(((ranges[:, 0] << RANK_BITS) + ranges[:, 1], ranges[:, 2], ranges[:, 3]))
    where = ranked.columns.index("key")
    schema = StructType([f for f in ranked.schema.fields if f.name != "key"]).add("sequence_id", LongType()).add("offset", LongType())

    def run(batches):
        keys, sequences, offsets = shared.value
        for batch in batches:
            key = batch.column(where).to_numpy(zero_copy_only=False)
            found = np.searchsorted(keys, key, "right") - 1
            columns = [c for i, c in enumerate(batch.columns) if i != where]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences[found] + (key - keys[found])), pa.array(offsets[found])], schema.names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``keep_ids`` the ids."""
    if not 1 <= capacity < 1 << (63 - RANK_BITS):
        raise ValueError("capacity must be at least 1 and below 2 ** 21")
    pieces = materialize(pieces_of(docs, id_col, text_col, path or tokenizer_path(), end_id, capacity, keep_ids), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # a row for each length
    found = placed(pieces, best_plan(counts, capacity))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, pieces) of packed pieces with their ids; a sequence has at most ``capacity`` ids."""
    members = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(members.alias("members"))
    return grouped.select("sequence_id", F.flatten("members.ids").alias("ids"), F.transform("members", lambda m: F.struct(m.offset.alias("offset"), m.doc_id.alias("doc_id"), m.piece.alias("piece"))).alias("pieces"))


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False)
