"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: forced-boundary splitting. From the vocabulary file a 256 x 256 table is made of the
byte pairs that occur inside any token. A pair that occurs in none marks a certain token
boundary. A text is cut there if the cut cannot change how the vocabulary's word pattern splits
either side:

* before ASCII white space that follows a character that is not white. Where a pair with a byte
  beyond ASCII does occur in a token, a text that holds the pair is cut after ASCII characters only.
* in what is left longer than LONG characters (embedded data, minified code, prose without
  blanks), between two characters neither of which is white. The pattern looks beyond a word
  only across white space, so a cut elsewhere is seen only by a word that begins there: one
  that the second side begins with an apostrophe might be taken for a contraction, and is not cut;
  any other is cut in the whole text as well, or is the rest of a word that no merge joins.

Fragments are encoded independently, remembered per worker, and concatenated. Texts are
never cut anywhere else, so the ids equal those of encoding the whole text.

Cases: null and empty texts have the ids []; very long texts, repeated rows and texts that
hold a special token's string are ordinary; an empty table gives an empty table; other
columns of the input are not read, unless named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.runtime import spread, table

#: Folder of the public vocabulary files; a parameter everywhere.
TOKENIZER_DIR = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the word pattern that belongs to the vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Unicode's White_Space property, as \s in the word pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ASCII_WHITE = "\t\n\x0b\x0c\r "

#: Fragments up to LONG characters are remembered, up to REMEMBERED of them per worker.
LONG, REMEMBERED = 32, 150_000
#: White space runs from this length on are encoded apart.
STACK = 1_000


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in raw.splitlines() if line)}


def pair_table(tokens) -> np.ndarray:
    """inside[a, b]: byte a is followed by byte b inside some token."""
    inside = np.zeros((256, 256), bool)
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    ends = np.cumsum([len(t) for t in tokens]) - 1
    within = np.ones(len(joined), bool)
    within[ends] = False
    at = np.flatnonzero(within)
    inside[joined[at], joined[at + 1]] = True
    return inside


class FragmentEncoder(dict):
    """Maps a fragment to its ids; misses are encoded by the library and remembered."""

    def __init__(self, raw: bytes):
        import tiktoken

        super().__init__()
        ranks = read_ranks(raw)
        inside = pair_table(list(ranks))
        own = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.single = own.encode_ordinary, own._encode_single_piece
        self.runs = re.compile(f"[{WHITE}]{{{STACK},}}").finditer
        dark = [b for b in range(128) if chr(b) not in ASCII_WHITE]
        cut = "".join(c for c in ASCII_WHITE if not inside[dark, ord(c)].any())
        #: Pairs of a byte beyond ASCII and white space that do occur in a token: such a text is cut after ASCII only.
        self.doubtful = [bytes([b]) + c.encode() for c in cut for b in range(128, 256) if inside[b, ord(c)]]
        keep = "".join(c for c in ASCII_WHITE if c not in cut) + WHITE[len(ASCII_WHITE):]
        self.fragments = re.compile(f"[{WHITE}]*(?:[^{WHITE}]+(?:[{keep}][{WHITE}]*)?)+|[{WHITE}]+").findall
        #: Pairs between which a run without white space may be cut.
        self.safe = ~inside
        white = [ord(c) for c in ASCII_WHITE]
        self.safe[white, :] = self.safe[:, white] = False
        self.safe[:, 0x80:0xC0] = False  # a character's later bytes
        self.safe[:, ord("'")] = False
        self.white = re.compile(f"[{WHITE}]").search
        self.careful = re.compile(f"(?<=[{re.escape(''.join(map(chr, dark)))}])(?=[{cut}])" if cut else "(?!)").split

    def __missing__(self, fragment: str) -> list[int]:
        if len(fragment) > LONG:
            return self.long(fragment)
        ids = self.encode(fragment)
        if len(self) >= REMEMBERED:
            self.clear()
        self[fragment] = ids
        return ids

    def long(self, fragment: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(fragment):
            out += self[piece] if len(piece) <= LONG else self.whole(piece)
        return out

    def split(self, fragment: str) -> list[str]:
        """A fragment of which only the beginning may be white, cut at all safe pairs."""
        visible = fragment.lstrip(WHITE)
        if self.white(visible):
            return [fragment]
        raw = visible.encode()
        lead = fragment[: len(fragment) - len(visible)].encode()
        at = np.frombuffer(raw, np.uint8)
        ends = [0, *(np.flatnonzero(self.safe[at[:-1], at[1:]]) + (1 + len(lead))).tolist(), len(lead) + len(raw)]
        raw = lead + raw
        return [raw[a:b].decode() for a, b in zip(ends, ends[1:])]

    def whole(self, fragment: str) -> list[int]:
        """Runs of white space beyond the library's stack are handed to it as the one word they are,

        less their last character if a word follows, as the word pattern has it.
        """
        out, at = [], 0
        for run in self.runs(fragment):
            end = run.end() - (run.end() < len(fragment))
            out += self.encode(fragment[at : run.start()]) + self.single(fragment[run.start() : end].encode())
            at = end
        return out + self.encode(fragment[at:])

    def pieces(self, text: str) -> Iterator[str]:
        """What is encoded by itself, in order."""
        for fragment in self.cuts(text):
            yield from self.split(fragment) if len(fragment) > LONG else (fragment,)

    def cuts(self, text: str) -> list[str]:
        if self.doubtful:
            raw = text.encode()
            if any(pair in raw for pair in self.doubtful):
                return [x for x in self.careful(text) if x]
        return self.fragments(text)

    def ids(self, text: str | None) -> Iterator[int]:
        return chain.from_iterable(map(self.__getitem__, self.cuts(text))) if text else iter(())

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, self.cuts(text)))) if text else 0


_encoders: dict[str, FragmentEncoder] = {}


def encoder(raw: bytes) -> FragmentEncoder:
    key = hashlib.md5(raw).hexdigest()
    if key not in _encoders:
        _encoders[key] = FragmentEncoder(raw)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str | None):
    """The file's bytes (under 1 MB for 50,000 tokens, whatever the corpus) as a broadcast variable."""
    with open(path or os.path.join(TOKENIZER_DIR, VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>) of each row; no shuffle, one pass."""
    raw = _vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in it:
            flat, ends = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                flat.extend(enc.ids(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(batches, schema)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """df without its text, with the number of tokens of the text instead (0 for null)."""
    raw = _vocabulary(df.sparkSession, vocabulary)
    rest = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(out, T.LongType())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in it:
            counts = pa.array([enc.count(t) for t in batch.column(len(rest)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], counts], names=[*rest, out])

    return spread(df.select(*rest, text)).mapInArrow(batches, schema)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by power of two of the token count, per language as written."""
    n = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return (
        n.groupBy("lang", F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens"))).otherwise(-1).cast("int").alias("log2_tokens"))
        .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    )


def cut_report(df: DataFrame, group: str = "lang", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per value of group: documents, bytes, pieces encoded by themselves, bytes in pieces beyond LONG, and the longest piece's bytes."""
    raw = _vocabulary(df.sparkSession, vocabulary)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(raw.value)
        for batch in it:
            rows = []
            for t in batch.column(1).to_pylist():
                sizes = [len(p.encode()) for p in enc.pieces(t)] if t else []
                rows.append((sum(sizes), len(sizes), sum(n for n in sizes if n > LONG), max(sizes, default=0)))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[group, "n_bytes", "n_pieces", "n_bytes_long", "longest"])

    schema = T.StructType([df.schema[group], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_pieces", "n_bytes_long", "longest"))])
    each = spread(df.select(group, text)).mapInArrow(batches, schema)
    sums = [F.sum(c).alias(c) for c in ("n_bytes", "n_pieces", "n_bytes_long")]
    return each.groupBy(group).agg(F.count("*").alias("n_docs"), *sums, F.max("longest").alias("longest"))


def p6_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_report(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids, "p6_cuts": p6_cuts, "p6_length_histogram": p6_length_histogram}
SQL: dict[str, str] = {}
