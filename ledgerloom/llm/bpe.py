"""Operator 2: byte-level BPE encoding and decoding by a bounded-lookahead streaming transducer.

From the merge list alone, `Transducer` computes how many bytes behind a token's end can still change it:
merge r = (u, v) can be kept from happening by an earlier merge (v, w), which needs w and what w itself depends on, and
so on down the ranks. reach(r) is that distance; the lookahead is the largest of |w| + reach over the merges that a
finished token could still take part in. A pre-token is read byte by byte into a buffer that never exceeds twice the
lookahead (plus one token): tokens that end at least `lookahead` bytes before the buffer's end are stable and leave.
As the left part of a BPE result is the BPE result of its own bytes, the rest goes on alone. Decoding is a state
machine over bytes that keeps at most three bytes of an unfinished character.

Nulls are empty texts: 0 tokens. The text <|endoftext|> is the vocabulary's special token, as in the tokenizers
library. Repeated rows, ties and null doc_ids are encoded row by row; other columns are ignored; an empty table
gives an empty result. Texts are read in chunks of rows; a text longer than a chunk in windows, whose ids pass through
the decoder and the digests and are held no longer. Short pre-tokens, of at most twice the lookahead, fit the
transducer's buffer whole: one fill of it gives their ids, which a memo keeps.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import wordkernel as wk
from .common import fields, table
from .pieces import Encoder


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for name, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in name)
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
            self.special_id = t["id"]
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        #: (left id << 20 | right id) to (rank, merged id)
        self.merge: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merge.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes behind a token's end that can change it, for any token."""
        made: dict[int, int] = {}  # token to the reach of the merge that forms it
        after: dict[int, list[tuple[int, int]]] = {}  # left token to (right token's length, reach) of earlier merges
        most = 0
        for key, (_, merged) in self.merge.items():  # by rank
            left, right = key >> 20, key & 0xFFFFF
            size = len(self.bytes_of[right])
            reach = max(0, made.get(right, 0), made.get(left, 0) - size, *(n + r for n, r in after.get(right, ())))
            after.setdefault(left, []).append((size, reach))
            made[merged] = max(reach, made.get(merged, 0))
            most = max(most, size + reach)
        return most

    def tokens(self, piece: bytes) -> list[int]:
        """All merges of a short buffer, lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in piece]
        get = self.merge.get
        none = (1 << 60, 0)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | best[1], none)
            if i < len(ranks):
                ranks[i] = get(best[1] << 20 | ids[i + 1], none)
        return ids

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in parts, each as soon as it is stable."""
        held = b""
        for part in parts:
            for s in range(0, len(part), self.lookahead):
                held += part[s : s + self.lookahead]
                if len(held) > 2 * self.lookahead:
                    done = 0
                    for t in self.tokens(held):
                        if done + len(self.bytes_of[t]) > len(held) - self.lookahead:
                            break
                        done += len(self.bytes_of[t])
                        yield t
                    held = held[done:]
        yield from self.tokens(held)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return [self.tokens(x) if len(x) <= 2 * self.lookahead else list(self.stream([x])) for x in (p.encode("utf-8", "surrogatepass") for p in pieces)]

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, bit by bit; bytes that are no UTF-8 become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        of, held, n = self.bytes_of, [], 0
        for i in ids:
            held.append(of[i])
            n += 1
            if n == 4096:
                yield machine.decode(b"".join(held))
                held, n = [], 0
        yield machine.decode(b"".join(held), True)


@functools.lru_cache(2)
def transducer(path: str) -> tuple[Transducer, Encoder]:
    t = Transducer(path)
    return t, Encoder(t.encode_pieces, t.special_id, t.stream)


def _whole(encoder: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a chunk; a long text's are gathered from its windows."""
    if len(offsets) == 2 and len(data) > wk.CHUNK_BYTES:
        ids = np.concatenate([np.zeros(0, np.int32), *encoder.long(data)])
        return ids, np.array([0, len(ids)])
    return encoder.chunk(data, offsets)


def _streamed(t: Transducer, encoder: Encoder, data: np.ndarray, name: list[bytes]) -> tuple[list, list, list]:
    """The digests of one long text: ids leave window by window, go through the decoder at once, and are forgotten."""
    n, hashed, back = 0, hashlib.sha256(), hashlib.sha256()

    def ids() -> Iterator[int]:
        nonlocal n
        for part in encoder.long(data):
            own = part.tolist()
            if own:
                hashed.update(b"," * bool(n) + b",".join(map(name.__getitem__, own)))
            n += len(own)
            yield from own

    for part in t.decode(ids()):
        back.update(part.encode())
    return [n], [hashed.hexdigest()], [back.hexdigest()]


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, encoder = transducer(path)
        name = [b"%d" % i for i in range(len(t.bytes_of))]
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                if hi - lo == 1 and len(data) > wk.CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, 1), *map(pa.array, _streamed(t, encoder, data, name))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                    continue
                ids, first = encoder.chunk(data, offsets)
                hashes, decoded = [], []
                for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = ids[s:e].tolist()
                    hashes.append(hashlib.sha256(b",".join(map(name.__getitem__, own))).hexdigest())
                    back = hashlib.sha256()
                    for part in t.decode(own):
                        back.update(part.encode())
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(hashes), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = transducer(path)
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                ids, first = _whole(encoder, data, offsets)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = transducer(path)
        for b in batches:
            out = ["".join(t.decode(x or ())) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, ids."""
    return fields(docs, doc_id="long", text="string").mapInArrow(_ids(path), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """ids(doc_id, ids) to doc_id, text."""
    return fields(ids, doc_id="long", ids="array<int>").mapInArrow(_texts(path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_tokens, ids_sha256, decoded_sha256, encoded and decoded in one pass."""
    return fields(docs, doc_id="long", text="string").mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_vocabulary())
