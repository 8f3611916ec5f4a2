"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string ends in exactly one token for every prefix: the token t for which the
encoding of the shorter prefix may be followed by t. Storing this last token per prefix gives the
encoding by walking back, allows exact appends (prefixes never change) and lets an edit keep all
pieces before it and all pieces after the first common boundary. The cost per piece is linear in its
length, however long a run of letters is.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, pieces, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE = 400_000
PAIRS = 1_000_000
CACHE_CHARS = 48
LOOK_AHEAD = 3


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class PrefixCoder:
    """Encoder and decoder over one table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern)
        self.longest = max(map(len, ranks))
        self.endings = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple] = {}
        self.loose = regex.compile(r" (?:\s|\Z)")
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _merge_all(self, text: bytes, below: int) -> list[bytes]:
        """Plain merging of the bytes of one token with the ranks below its own."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int) -> tuple[list[tuple[bytes, float]], list[tuple[bytes, float]]] | None:
        """The strings that stand at the left and at the right end of a token while it is merged, each with the
        rank of the merge that ends it; None for a token that its own bytes do not merge to."""
        if token not in self.edges:
            text = self.bytes_of[token]
            left, right = [(text, math.inf)], [(text, math.inf)]
            if len(text) > 1:
                parts = self._merge_all(text, token)
                known = [self._edge(self.ranks[p]) for p in parts] if len(parts) == 2 else [None, None]
                if None in known:
                    self.edges[token] = None
                    return None
                left += [(p, min(r, token)) for p, r in known[0][0]]
                right += [(p, min(r, token)) for p, r in known[1][1]]
            self.edges[token] = left, right
        return self.edges[token]

    def may_follow(self, one: int, two: int) -> bool:
        """Whether the merges of both strings together leave exactly these two tokens.

        They do unless some string at the right end of the first and some string at the left end of the second
        make a token that comes before the merges which end these strings; of equal ranks the left place goes first.
        """
        key = one << 32 | two
        known = self.pairs.get(key)
        if known is None:
            first, second = self._edge(one), self._edge(two)
            known = first is not None and second is not None
            if known:
                for a, ends in first[1]:
                    for b, stops in second[0]:
                        rank = self.ranks.get(a + b)
                        if rank is not None and rank < ends and rank <= stops:
                            known = False
                            break
                    if not known:
                        break
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def extend(self, text: bytes | bytearray, last: list[int], start: int) -> None:
        """Append to `last` the last token of each prefix of `text` that ends after `start`.

        Exactly one token fits each prefix, so the order in which they are tried is free.
        """
        pairs, done, near = self.pairs, len(last), max(0, start - self.longest)
        for end, (token, size) in self.endings.iter(bytes(text[near:]).decode("latin-1")):
            end += near
            if end != done:
                if end < done:
                    continue
                raise ValueError("the vocabulary has no encoding of a prefix")
            at = end + 1 - size
            if at:
                fits = pairs.get(last[at - 1] << 32 | token)
                if fits is None:
                    fits = self.may_follow(last[at - 1], token)
            else:
                fits = self._edge(token) is not None
            if fits:
                last.append(token)
                done += 1
        if done != len(text):
            raise ValueError("the vocabulary has no encoding of a prefix")

    @staticmethod
    def walk(text_length: int, last: list[int], bytes_of: dict[int, bytes]) -> list[int]:
        out, at = [], text_length
        while at:
            out.append(last[at - 1])
            at -= len(bytes_of[out[-1]])
        return out[::-1]

    def piece(self, text: bytes) -> list[int]:
        """Tokens of one piece of the pattern; a piece that is a token stays whole."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        last: list[int] = []
        self.extend(text, last, 0)
        return self.walk(len(text), last, self.bytes_of)

    def pieces_of(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.split.findall(text):
            out += self.piece(m.encode())
        return out

    def encode(self, text: str) -> list[int]:
        """Token ids of a text."""
        return [int(i) for ids, _ in self.chunks(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _written(self, text: str) -> tuple[bytes, bytes]:
        ids = self.pieces_of(text)
        return b" ".join([b"%d" % i for i in ids]), self.decode(ids)

    def chunks(self, text: str) -> list[tuple[bytes, bytes]]:
        """For each stretch of the text, its ids in decimal joined by one space, and the bytes they decode to.

        The pattern always starts a new piece at a space that a non-space follows, so a text whose spaces are all
        of that kind is encoded chunk by chunk, and chunks are remembered. Any other text is one stretch.
        """
        if not text:
            return []
        if self.split.pattern != PATTERN or self.loose.search(text):
            return [self._written(text)]
        first, *rest = text.split(" ")
        known = self.known
        out = [known.get(c) for c in rest]
        if None in out:
            if len(known) >= CACHE:
                known.clear()
            for n, made in enumerate(out):
                if made is None:
                    chunk = rest[n]
                    made = known.get(chunk)
                    if made is None:
                        made = self._written(" " + chunk)
                        if len(chunk) <= CACHE_CHARS:
                            known[chunk] = made
                    out[n] = made
        return [self._written(first), *out] if first else out


class EncodedText:
    """A text with its encoding, for appends and edits that cost as much as what changes."""

    def __init__(self, coder: PrefixCoder, text: str = ""):
        self.coder, self.text = coder, text
        self.spans: list[tuple[int, int]] = []
        self.ids: list[list[int]] = []
        self.encoded = 0
        self._take(self._pieces(0))

    def _pieces(self, start: int) -> Iterator[tuple[int, int]]:
        return (m.span() for m in self.coder.split.finditer(self.text, start))

    def _take(self, spans: Iterator[tuple[int, int]]) -> None:
        for a, b in spans:
            self.spans.append((a, b))
            self.ids.append(self.coder.piece(self.text[a:b].encode()))
            self.encoded += 1

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters [start, end). Pieces that looked no further than `start` stay, and from the
        first boundary behind the edit that is an old boundary too, all old pieces are taken over."""
        keep = len(self.spans)
        while keep and self.spans[keep - 1][1] + LOOK_AHEAD > start:
            keep -= 1
        shift = len(new) - (end - start)
        old = {a + shift: i for i, (a, _) in enumerate(self.spans) if i >= keep and a >= end}
        spans, ids = self.spans, self.ids
        self.text = self.text[:start] + new + self.text[end:]
        self.spans, self.ids = spans[:keep], ids[:keep]
        at = self.spans[-1][1] if self.spans else 0
        for a, b in self._pieces(at):
            if a >= start + len(new) and a in old:
                i = old[a]
                self.spans += [(x + shift, y + shift) for x, y in spans[i:]]
                self.ids += ids[i:]
                return
            self._take(iter([(a, b)]))


class EncodedPiece:
    """One byte string with the last token of each prefix, which grows at its end."""

    def __init__(self, coder: PrefixCoder, text: bytes = b""):
        self.coder, self.text, self.last = coder, bytearray(), []
        self.append(text)

    def append(self, more: bytes) -> None:
        start = len(self.text)
        self.text += more
        self.coder.extend(self.text, self.last, start)

    def tokens(self, length: int | None = None) -> list[int]:
        """Encoding of the text, or of any prefix of it."""
        return PrefixCoder.walk(len(self.text) if length is None else length, self.last, self.coder.bytes_of)


def vocabulary(spark: SparkSession, path: str | None = None):
    """The rank file as a broadcast of its bytes; such a file holds a vocabulary, under a few MB."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        data = f.read(64 << 20)
    return spark.sparkContext.broadcast(data)


_CODERS: dict[bytes, PrefixCoder] = {}


def _coder(data: bytes) -> PrefixCoder:
    """One coder per Python worker, so that its cache serves all tasks."""
    key = hashlib.sha256(data).digest()
    if key not in _CODERS:
        _CODERS[key] = PrefixCoder(read_ranks(data))
    return _CODERS[key]


def encode_documents(docs: DataFrame, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep`, then tokens: the ids of the whole text. Null texts are empty and give no ids."""
    keep = ["doc_id"] if keep is None else keep
    ranks = vocabulary(docs.sparkSession, path)
    fields = [docs.schema[c] for c in keep]
    (own,) = fresh([*keep, "tokens"], "_text")
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(own))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields) + "tokens array<int>"

    def run(batches):
        coder = _coder(ranks.value)
        for batch in pieces(batches, 64):
            ids = pa.array([coder.encode(x.decode(errors="replace")) for x in utf8(batch, own)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], ids], [*[f.name for f in fields], "tokens"])

    return slim.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text_bytes from (doc_id, tokens)."""
    ranks = vocabulary(encoded.sparkSession, path)

    def run(batches):
        coder = _coder(ranks.value)
        for batch in pieces(batches, 64):
            out = pa.array([coder.decode(x or []) for x in batch.column("tokens").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "text_bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, text_bytes binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encodes each text and decodes the ids, in one pass over the rows."""
    ranks = vocabulary(docs.sparkSession, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = _coder(ranks.value)
        for batch in pieces(batches, 64):
            counts, ids_hash, text_hash = [], [], []
            for text in utf8(batch, "_text"):
                made = coder.chunks(text.decode(errors="replace"))
                ids = b" ".join([i for i, _ in made])
                counts.append(ids.count(b" ") + (ids != b""))
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(b"".join([b for _, b in made])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select("doc_id", F.col("text").alias("_text"))
    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
