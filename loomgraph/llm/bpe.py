"""Byte-level BPE with the tokenizers library, over Arrow batches.

The ranks of a vocabulary file are turned into the library's merges: a token's
merges are all pairs of tokens that make it up, in the order of its rank, and a
match of the pattern that is itself a token is taken whole. The byte table
(byte to printable character) is the usual one of byte-level BPE. Decoding goes
from ids to characters and by the reversed table to bytes, so tokens that split
a character decode exactly. A token's offsets are the code points of the text
that it covers; tokens that split a character share it.

Defined cases: a null text is an empty one and has no tokens; very long texts
are encoded whole; repeated rows give equal rows; an empty table gives no rows;
other columns are ignored, or kept if asked for.
"""

from __future__ import annotations

import array
import base64
import copy
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomgraph.llm.common import by_batches, trimmed

#: Characters of words and matches whose encodings a task keeps, about 40 bytes for each; beyond that they are dropped and made anew.
KEPT = 2 << 20
#: Units and matches of more characters are not kept.
LONG = 64
#: White space that is not a single space or line feed between other characters, or the mark used to cut.
SPACED = re.compile(r"[ \n](?:[ \n]|\Z)|^[ \n]|[\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def byte_table() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    at = {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}
    return [at[b] for b in range(256)]


def spelled_out(pattern: str) -> str:
    """pattern with its character classes as ranges, as the tiktoken library's own engine has them.

    Unicode versions differ between regular expression engines.
    """
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}

    def ranges(name: str) -> str:
        probe = tiktoken.Encoding("probe", pat_str=name + "+", mergeable_ranks=single, special_tokens={})
        members = sorted(map(ord, set(bytes(probe.encode_ordinary(every)).decode())))
        starts = [c for k, c in enumerate(members) if not k or members[k - 1] != c - 1]
        ends = [c for k, c in enumerate(members) if k + 1 == len(members) or members[k + 1] != c + 1]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))

    found = {name: ranges(name) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{\w\}|\\s", lambda x: found.get(x[0], x[0]), m[0]), pattern)
    out = out.replace(r"\S", f"[^{found[chr(92) + 's']}]")
    return re.sub(r"\\p\{\w\}|\\s", lambda x: f"[{found[x[0]]}]" if x[0] in found else x[0], out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBPE:
    """Encoder and decoder for one vocabulary of ranks; with_offsets: encodings have each token's offsets."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, spelled: str | None = None, with_offsets: bool = True):
        from tokenizers import models

        self.table = byte_table()
        self.separable = pattern == public_tokenizers.PATTERN
        self.pattern = re.compile(spelled or spelled_out(pattern))
        self.characters = dict(enumerate(self.table))
        self.with_offsets = with_offsets
        self.kept: dict[str, tuple] = {}
        self.pieces: dict[str, tuple[str, bytes]] = {}
        self.held = 0
        self.back = {c: b for b, c in enumerate(self.table)}
        vocabulary = {"".join(self.table[b] for b in token): rank for token, rank in ranks.items()}
        merges = []
        for token, _ in sorted(vocabulary.items(), key=lambda x: x[1]):
            merges += [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in vocabulary and token[k:] in vocabulary]
        self.model = models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)
        self.bytes_of = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, rank in vocabulary.items():
            self.bytes_of[rank] = bytes(self.back[c] for c in token)
        # all tokens' bytes, one after the other, and where each begins
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.size = np.array(list(map(len, self.bytes_of)), dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def fresh(self) -> ByteBPE:
        """The same encoder, with no encodings kept as yet."""
        own = copy.copy(self)
        own.kept, own.pieces, own.held = {}, {}, 0
        return own

    def _units(self, text: str) -> list[tuple]:
        """A text as units of whole matches: (ids in decimal with commas, ids as bytes, offsets of the ids, code points).

        Where single spaces and line feeds alone part a text's words, no match of
        the pattern reaches over them except for the space before a word, so words
        are units. Encodings of short units are kept, KEPT characters at a time.
        """
        kept, units = self.kept, self._cut(text)
        try:
            return list(map(kept.__getitem__, units))
        except KeyError:
            found = []
            for unit in units:
                made = kept.get(unit)
                if made is None:
                    made = self._unit(unit)
                    if len(unit) <= LONG:
                        kept[unit] = made
                        self.held += len(unit)
                found.append(made)
            if self.held > KEPT:
                kept.clear()
                self.pieces.clear()
                self.held = 0
            return found

    def _unit(self, unit: str) -> tuple[str, bytes, tuple[int, ...], int]:
        matches = self.pattern.findall(unit)
        if len(matches) == 1:
            decimal, raw = self._piece(unit)
        else:
            found = []
            for piece in matches:
                own = self.pieces.get(piece)
                if own is None:
                    own = self._piece(piece)
                    if len(piece) <= LONG:
                        self.pieces[piece] = own
                        self.held += len(piece)
                found.append(own)
            decimal, raw = ",".join([d for d, _ in found]), b"".join([r for _, r in found])
        ends: list[int] = []
        if self.with_offsets:
            # matches follow each other without a gap
            of = range(len(unit) + 1) if unit.isascii() else [*(k for k, c in enumerate(unit) for _ in c.encode()), len(unit)]
            start = 0
            for i in memoryview(raw).cast("i"):
                end = start + len(self.bytes_of[i])
                ends += (of[start], of[end - 1] + 1)
                start = end
        return decimal, raw, tuple(ends), len(unit)

    def _piece(self, piece: str) -> tuple[str, bytes]:
        """A match by the library, over the characters that stand for its bytes."""
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.characters))]
        return ",".join(map(str, ids)), array.array("i", ids).tobytes()

    def _cut(self, text: str) -> list[str]:
        if not self.separable or not text or SPACED.search(text):
            return [text] if text else []
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.ids(self._units(t)).tolist() for t in texts]

    @staticmethod
    def ids(units: list[tuple]) -> np.ndarray:
        return np.frombuffer(b"".join([u[1] for u in units]), dtype=np.int32)

    @staticmethod
    def decimal(units: list[tuple]) -> str:
        """The ids, joined by commas."""
        return ",".join([u[0] for u in units if u[0]])

    @staticmethod
    def spans(units: list[tuple]) -> np.ndarray:
        """Start and end of each token of a text."""
        counts = [len(u[2]) for u in units]
        flat = np.fromiter(itertools.chain.from_iterable([u[2] for u in units]), dtype=np.int32, count=sum(counts))
        lengths = np.array([u[3] for u in units], dtype=np.int32)
        return (flat + np.repeat(np.cumsum(lengths, dtype=np.int32) - lengths, counts)).reshape(-1, 2)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code point offsets of each token of text; tokens that split a character share it."""
        return list(map(tuple, self.spans(self._units(text)).tolist()))

    def decode(self, ids) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        size = self.size[ids]
        at = np.arange(size.sum()) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.all_bytes[at].tobytes()


_made: dict[tuple, ByteBPE] = {}


def _encoder(name: str, shipped: tuple[bytes, str], with_offsets: bool = False) -> ByteBPE:
    """An encoder: one for each worker process and vocabulary, but the encodings that it keeps are a task's own."""
    ranks, spelled = shipped
    key = (name, hashlib.sha256(ranks).digest(), with_offsets)
    if key not in _made:
        _made[key] = ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, spelled=spelled, with_offsets=with_offsets)
    return _made[key].fresh()


def _shipped(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: its size is that of one file, whatever the corpus."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), spelled_out(public_tokenizers.PATTERN)))


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *(np.asarray(p, dtype=np.int32) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def encode(docs: DataFrame, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """keep (doc_id) with token_ids, starts and ends (code points) array<int>, n_tokens and decoded_sha256, of the bytes that the ids decode to."""
    ranks = _shipped(docs, path)

    def make():
        bpe = _encoder(path, ranks.value, with_offsets=True)

        def of(texts: pa.Array) -> list[pa.Array]:
            units = [bpe._units(x or "") for x in texts.to_pylist()]
            ids, spans = [bpe.ids(u) for u in units], [bpe.spans(u) for u in units]
            decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            lists = [_lists(ids, pa.int32()), *(_lists([s[:, k] for s in spans], pa.int32()) for k in (0, 1))]
            return [*lists, pa.array(list(map(len, ids)), pa.int64()), pa.array(decoded, pa.string())]

        return of

    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("token_ids", "starts", "ends")] + [T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())]
    return by_batches(docs, fields, make, keep or ["doc_id"], rows=32)


def decode(encoded: DataFrame, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """keep (doc_id) and decoded string of token_ids; bytes that are no UTF-8 become U+FFFD; null ids give null."""
    ranks = _shipped(encoded, path)
    keep = keep or ["doc_id"]

    def run(batches):
        bpe = _encoder(path, ranks.value)
        for batch in batches:
            texts = [None if ids is None else bpe.decode(ids).decode(errors="replace") for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    given = encoded.select(*keep, "token_ids")
    return given.mapInArrow(trimmed(run), T.StructType([*(given.schema[c] for c in keep), T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, sha256 of the ids and of the bytes that they decode to."""
    ranks = _shipped(docs, path)

    def make():
        bpe = _encoder(path, ranks.value)

        def of(texts: pa.Array) -> list[pa.Array]:
            counts, ids_sha, text_sha = [], [], []
            for text in texts.to_pylist():
                units = bpe._units(text or "")
                ids = bpe.ids(units)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(bpe.decimal(units).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            return [pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]

        return of

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return by_batches(docs, fields, make, ["doc_id"], rows=32)
