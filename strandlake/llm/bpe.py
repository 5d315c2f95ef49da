"""Byte-level BPE encoding and decoding.

Encoding of one pre-token keeps its symbols in a doubly linked list and the mergeable neighbours in a priority queue
ordered by merge rank, then place; an entry whose symbols have changed since it was queued is stale and skipped.
Decoding concatenates the vocabulary's byte strings.

Defined cases: a null text is empty, an empty text has no ids and the digest of no bytes, repeated rows are repeated in
the result, a very long pre-token costs n log n. Extra columns are ignored unless asked for.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: What a worker remembers of encoded pre-tokens, and as much again of pieces between spaces and of those at the beginning
#: of lines: bytes of keys, ids and dictionary entries.
CACHE_BYTES = 128 << 20
CACHE_KEY_CHARS = 48
#: Bytes that an entry takes beside its characters and ids.
ENTRY_BYTES = 200


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What a tokenizer file says: bytes of each id, merges by pair of ids, added tokens, and the splitting pattern."""

    pieces: list[bytes]
    merges: dict[int, tuple[int, int]]
    first: list[int]
    added: dict[str, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str | None = None) -> Vocabulary:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        pieces = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for piece, i in vocab.items():
            pieces[i] = piece.encode() if piece in added else bytes(letters[c] for c in piece)
        for piece, i in added.items():
            pieces[i] = piece.encode()
        merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        one = {b: vocab[c] for c, b in letters.items()}
        return cls(pieces, merges, [one[b] for b in range(256)], added, pattern or public_tokenizers.PATTERN)


def merge_word(word: bytes, first: list[int], merges: dict[int, tuple[int, int]]) -> list[int]:
    """Ids of one pre-token. Queue entries are rank << 32 | place, so that the least rank, then the leftmost place, is next."""
    ids = [first[b] for b in word]
    n = len(ids)
    if n < 2:
        return ids
    find = merges.get
    queue = []
    left = ids[0]
    for i in range(n - 1):
        right = ids[i + 1]
        if (found := find(left << 32 | right)) is not None:
            queue.append(found[0] << 32 | i)
        left = right
    if not queue:
        return ids
    heapq.heapify(queue)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while queue:
        entry = pop(queue)
        i = entry & 0xFFFFFFFF
        j = after[i]
        if j >= n or (a := ids[i]) < 0 or (found := find(a << 32 | ids[j])) is None or found[0] != entry >> 32:
            continue  # stale: one of the two symbols has merged meanwhile
        ids[i] = merged = found[1]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := find(merged << 32 | ids[k])) is not None:
                push(queue, found[0] << 32 | i)
        h = before[i]
        if h >= 0 and (found := find(ids[h] << 32 | merged)) is not None:
            push(queue, found[0] << 32 | h)
    return [x for x in ids if x >= 0]


class _Recent(dict):
    """Keys to packed ids, in two generations of half of most bytes each: a full one becomes the older, which is forgotten.
    What is asked for again passes to the younger, so that frequent keys stay."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.held, self.most = 0, most

    def keep(self, key: str, packed: bytes) -> bytes:
        if len(key) <= CACHE_KEY_CHARS:
            self.held += ENTRY_BYTES + len(key) + len(packed)
            if self.held > self.most // 2:
                self.older = dict(self)
                self.clear()
                self.held = ENTRY_BYTES + len(key) + len(packed)
            self[key] = packed
        return packed


class _Words(_Recent):
    """Pre-token to its packed ids, computed on first use."""

    def __init__(self, vocab: Vocabulary, most: int):
        super().__init__(most)
        self.vocab = vocab

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        return self.keep(word, self.merged(word) if packed is None else packed)

    def merged(self, word: str) -> bytes:
        return array("I", merge_word(word.encode(), self.vocab.first, self.vocab.merges)).tobytes()


class _Irregular(Exception):
    """A piece of a line that borders on further white space."""


class _Pieces(_Recent):
    """What stands between two single spaces, with lead before it, to its packed ids.

    A pre-token never crosses from a visible character over one space to another: the space belongs to what follows.
    So such pieces can be encoded, and remembered, each for itself.
    """

    def __init__(self, lead: str, split, words: _Words):
        super().__init__(words.most)
        self.lead, self.split, self.words = lead, split, words

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Irregular
        packed = self.older.get(piece)
        if packed is None:
            words = self.split(self.lead + piece)
            if len(words) == 1 and len(piece) <= CACHE_KEY_CHARS:  # remembered here, so not among the words too
                packed = self.words.get(words[0]) or self.words.merged(words[0])
            else:
                packed = b"".join(map(self.words.__getitem__, words))
        return self.keep(piece, packed)


@dataclass
class Codec:
    """Encodes to packed little-endian unsigned 32-bit ids, and decodes them."""

    vocab: Vocabulary
    cache_bytes: int = CACHE_BYTES
    words: _Words = field(init=False)

    def __post_init__(self):
        self.words = _Words(self.vocab, self.cache_bytes)
        self.split = regex.compile(self.vocab.pattern).findall
        self.heads, self.pieces = _Pieces("", self.split, self.words), _Pieces(" ", self.split, self.words)
        self.newline = self.words["\n"]
        self.specials = regex.compile("|".join(f"({regex.escape(x)})" for x in sorted(self.vocab.added, key=len, reverse=True))) if self.vocab.added else None

    def plain(self, text: str) -> bytes:
        """Of a text without added tokens. Lines that begin and end with visible characters are cut at their spaces."""
        try:
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(self.heads[head] + b"".join(map(self.pieces.__getitem__, rest)))
            return self.newline.join(lines)
        except _Irregular:
            return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.specials is None or not any(x in text for x in self.vocab.added):
            return self.plain(text)
        out = []
        for part in self.specials.splititer(text):
            if part in self.vocab.added:
                out.append(array("I", [self.vocab.added[part]]).tobytes())
            elif part:
                out.append(self.plain(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I")
        ids.frombytes(packed)
        raw = b"".join(map(self.vocab.pieces.__getitem__, ids))
        return raw.decode("utf-8", "replace").encode()


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(source: str, vocab: Vocabulary, cache_bytes: int) -> Codec:
    """The worker's codec for a vocabulary file; it and its remembered words serve the worker's later tasks too."""
    if (source, cache_bytes) not in _codecs:
        _codecs.clear()
        _codecs[source, cache_bytes] = Codec(vocab, cache_bytes)
    return _codecs[source, cache_bytes]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False, with_text: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and on request ids (binary) and decoded text.

    A null text is empty; repeated rows give equal rows, and so do ties, for the encoding depends on the text alone; texts
    of any length are encoded whole. cache_bytes: what a worker may remember of pre-tokens, and as much again of pieces
    and of beginnings of lines; it keeps them as long as it lives.
    Every row is worked on where it is read; there is no shuffle. The vocabulary is broadcast: its size is that of a
    tokenizer file and does not depend on the documents.
    """
    spark = docs.sparkSession
    source = path or default_path()
    vocab = spark.sparkContext.broadcast(Vocabulary.load(source))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(source, vocab.value, cache_bytes)
        for batch in batches:
            out = {"n": [], "ids": [], "sha": [], "back": [], "text": []}
            for text in batch.column(1):
                packed = codec.encode(text.as_py() or "")
                raw = codec.decode(packed)
                out["n"].append(len(packed) >> 2)
                out["sha"].append(sha256(packed).hexdigest())
                out["back"].append(sha256(raw).hexdigest())
                if with_ids:
                    out["ids"].append(packed)
                if with_text:
                    out["text"].append(raw.decode())
            cols = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["sha"], pa.string()), pa.array(out["back"], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            if with_text:
                cols, names = [*cols, pa.array(out["text"], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids + ", decoded string" * with_text
    return docs.select(docs[id_col], docs[text_col]).mapInArrow(run, schema)
