"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of a byte string is the only token sequence in which every adjacent pair is compatible (encoding the two
tokens' bytes gives back the two tokens), and the encoding of a prefix is determined by its last token. So for every
prefix one token is stored: the token that ends there, matches the bytes before the end and is compatible with the last
token of the prefix that it leaves. Matches come from an automaton over the vocabulary, which lists for every end all
tokens that are suffixes of the prefix; ids are read off by following the stored tokens back. The time is linear in the
length times the matches per position, whatever the text, so a long run without white space is no worse than words.

Texts are split as the public tokenizer's pre-tokenizer does, and special strings are found first. Each distinct piece is
encoded once per task and kept in a table of bounded size.

Defined results: a null or empty text has no tokens and decodes to an empty text; repeated rows and extra columns are
left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quernel.llm import arrow_text as at

SPACES = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed values: Unicode white space
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"  # fixed values
UNCOMMON = regex.compile(r"[^\x00-\u052f\u1e00-\u23ff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef]")
CACHE_PIECES = 100_000
CACHE_PAIRS = 300_000
CACHE_PIECE_CHARS = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids by piece: computed when first asked for. Two generations of at most CACHE_PIECES each are kept, so that pieces in use
    survive when there is no more room."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Vocabulary:
    """Tokens, merges and the automaton of one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.tokens = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: content.encode() for content, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}  # when a pair is merged
        self.made: dict[int, tuple[int, int, int]] = {}  # a token's merge: when, left, right
        for when, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = ids[left], ids[right], ids[left + right]
            self.rank.setdefault((a, b), when)
            self.made.setdefault(whole, (when, a, b))
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            raw = self.tokens[i]
            self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.known = Pieces(self.encode_piece)
        self.splitter = None
        self.pieces = regex.compile(PIECES)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of both tokens gives these two tokens."""
        return (left, right) not in self.rank and self._undisturbed(left, right, len(self.rank))

    def _undisturbed(self, left: int, right: int, until: int) -> bool:
        """Whether no merge across the border of two tokens comes before the tokens are complete.

        Going back in time, the later of the two border tokens' own merges is undone. A merge across the border would have
        come first if it precedes what swallows the left border token, and precedes or ties with what swallows the right
        one: of equal pairs the left one is merged first.
        """
        left_taken = right_taken = until
        a, b = self.made.get(left), self.made.get(right)
        while a is not None or b is not None:
            if b is None or (a is not None and a[0] > b[0]):
                left_taken, left = a[0], a[2]
            else:
                right_taken, right = b[0], b[1]
            when = self.rank.get((left, right))
            if when is not None and when < left_taken and when <= right_taken:
                return False
            a, b = self.made.get(left), self.made.get(right)
        return True

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        raw = piece.encode("utf-8").decode("latin-1")
        n = len(raw)
        last, start_of = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix, and where it starts
        compatible = self.compatible
        for at, (length, token) in self.automaton.iter(raw):
            end = at + 1
            if last[end] >= 0:
                continue
            start = end - length
            key = last[start] << 32 | token  # the left token is -1 at the start of the piece
            fits = compatible.get(key)
            if fits is None:
                if len(compatible) >= CACHE_PAIRS:
                    compatible.clear()
                fits = compatible[key] = self.pair_fits(last[start], token) if start else self.whole_is_itself(token)
            if fits:
                last[end], start_of[end] = token, start
        out, end = [], n
        while end:
            out.append(last[end])
            end = start_of[end]
        out.reverse()
        return array("I", out).tobytes()

    def whole_is_itself(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token: so are its two parts, and nothing merges across them before."""
        made = self.made.get(token)
        return made is None or (
            self.whole_is_itself(made[1]) and self.whole_is_itself(made[2]) and self._undisturbed(made[1], made[2], made[0])
        )

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special strings. Where versions of Unicode may disagree about letters, the
        tokenizer's own splitter decides."""
        if not UNCOMMON.search(text):
            return self.pieces.findall(text)
        if self.splitter is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self.splitter = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        parts = self.special_split.split(text) if self.special_split else [text]
        return b"".join(
            array("I", [self.special[part]]).tobytes() if part in self.special else b"".join(map(self.known.__getitem__, self.split(part)))
            for part in parts if part
        )

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    loaded = at.cache("bpe")
    if path not in loaded:
        at.make_room("bpe")
        loaded[path] = Vocabulary(path)
    return loaded[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode_batches(path: str, carried: int, keep_ids: bool):
    """Columns of the encoding after ``carried`` columns of the input; the text is the last column of the input."""

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                counts, hashes, back, ids = [], [], [], []
                for value in part.column(part.num_columns - 1):
                    encoded = words.encode(value.as_py() or "")
                    counts.append(len(encoded) // 4)
                    hashes.append(hashlib.sha256(encoded).hexdigest())
                    back.append(hashlib.sha256(words.decode(encoded).encode("utf-8")).hexdigest())
                    if keep_ids:
                        ids.append(encoded)
                columns = [part.column(i) for i in range(carried)] + [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
                names = part.schema.names[:carried] + ["n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_texts(docs: DataFrame, path: str | None = None, text_col: str = "text", carry: tuple = ("doc_id",), keep_ids: bool = True) -> DataFrame:
    """The columns ``carry`` of every row of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids."""
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias("text_to_encode"))
    schema = StructType([f for f in rows.schema.fields[:-1]])
    for name, kind in [("n_tokens", LongType()), ("ids_sha256", StringType()), ("decoded_sha256", StringType())] + [("ids", ArrayType(IntegerType()))] * keep_ids:
        schema = schema.add(name, kind)
    return rows.mapInArrow(_encode_batches(path or tokenizer_path(), len(carry), keep_ids), schema)


def decode_ids(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", carry: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``carry`` with ``text``: the decoded ids. Null ids decode to null."""
    path = path or tokenizer_path()
    rows = encoded.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode(array("I", value).tobytes()) if value is not None else None for value in batch.column(len(carry)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(texts, pa.string())], [*batch.schema.names[: len(carry)], "text"])

    return rows.mapInArrow(run, StructType(rows.schema.fields[:-1]).add("text", StringType()))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, keep_ids=False)
