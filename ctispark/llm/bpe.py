"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last characters cuts a text into chunks, so passages
that documents share fall into the same chunks wherever they stand. Each
worker encodes a chunk once and keeps the result (least recently used ones go
when the store is full); chunks are then joined again. A chunk's first and
last words may have been cut in two, or have other neighbours than in the
text, so at each joint the stretch between two safe places is encoded anew and
accepted if both chunks' encodings agree with it outside of that stretch; if
not, it is widened to the next safe place, at most to the whole text.

A place is safe where a printing ASCII character is followed by a space or a
line feed: the vocabulary's splitting pattern begins a new piece there
whatever comes before, and what precedes does not look beyond it.
"""

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ctispark.llm.common import pieces, read

#: The rolling hash covers WINDOW characters; a chunk ends where its CUT_BITS top bits are 0, after about 2 ** CUT_BITS characters.
WINDOW, CUT_BITS = 16, 10
#: Bytes of chunks (text and encodings) that a worker keeps.
KEPT_BYTES = 64 << 20
SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")
SPECIAL = "<|endoftext|>"
#: Up to here both libraries class characters alike, and the faster one encodes.
PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*\Z")


def cuts(text: str) -> list[int]:
    """Where chunks end, the end of the text included."""
    n = len(text)
    if n <= WINDOW:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = codes * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    rolled = np.zeros(n - WINDOW + 1, np.uint32)
    for k in range(WINDOW):  # each character is shifted out of the hash after WINDOW steps
        rolled += mixed[k : n - WINDOW + 1 + k] << np.uint32(2 * (WINDOW - 1 - k))
    ends = np.flatnonzero(rolled * np.uint32(0x9E3779B1) >> np.uint32(32 - CUT_BITS) == 0) + WINDOW
    out = ends.tolist()
    return out if out and out[-1] == n else [*out, n]


class Codec:
    """Encodes and decodes with one vocabulary. Both files hold the same one; the second is optional and faster for plain text."""

    def __init__(self, vocabulary: str, ranks: str | None = None, kept_bytes: int = KEPT_BYTES):
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes = self._token_bytes()
        self.names = [str(i) for i in range(len(self.bytes))]
        self.kept: OrderedDict[str, tuple] = OrderedDict()
        self.room = kept_bytes
        self.encoded_chars = 0

    def _token_bytes(self) -> list[bytes]:
        # byte-level vocabularies write bytes that don't print as the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        out = []
        for i in range(self.exact.get_vocab_size(with_added_tokens=True)):
            token = self.exact.id_to_token(i)
            out.append(bytes(back[c] for c in token) if all(c in back for c in token) and token != SPECIAL else token.encode())
        return out

    def encode_alone(self, text: str) -> list[int]:
        if not text:
            return []
        self.encoded_chars += len(text)
        if self.fast is not None and SPECIAL not in text and PLAIN.match(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def chunk(self, text: str) -> tuple[list[int], int, int, int, int]:
        """ids; where the text's first and last agreeing safe places are and how many ids stand before and after them (-1, 0, -1, 0 if there is none)."""
        found = self.kept.get(text)
        if found is not None:
            self.kept.move_to_end(text)
            return found
        ids = self.encode_alone(text)
        places = [m.start() for m in SAFE.finditer(text)]
        head, n_head = self._agreeing(ids, ((p, text[:p]) for p in places), True)
        tail, n_tail = self._agreeing(ids, ((p, text[p:]) for p in reversed(places)), False)
        found = (ids, head, n_head, tail, n_tail) if head >= 0 <= tail and head <= tail else (ids, -1, 0, -1, 0)
        self.kept[text] = found
        self.room -= 4 * len(text) + 36 * len(ids) + 400
        while self.room < 0 and len(self.kept) > 1:
            old, gone = self.kept.popitem(last=False)
            self.room += 4 * len(old) + 36 * len(gone[0]) + 400
        return found

    def _agreeing(self, ids: list[int], parts, front: bool) -> tuple[int, int]:
        """The first place whose part, encoded anew, is what ids begin (end) with."""
        for place, part in parts:
            own = self.encode_alone(part)
            if own == (ids[: len(own)] if front else ids[len(ids) - len(own) :]):
                return place, len(own)
        return -1, 0

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, as if it were encoded at once."""
        ends = cuts(text)
        out: list[int] = []
        start, open_from = 0, 0  # of the chunk; of the stretch that has no ids yet
        for k, end in enumerate(ends):
            ids, head, n_head, tail, n_tail = self.chunk(text[start:end])
            first, last = k == 0, k == len(ends) - 1
            if first and last:
                return list(ids)
            if head >= 0:
                if not first:
                    out += self.encode_alone(text[open_from : start + head])
                out += ids[0 if first else n_head : len(ids) if last else len(ids) - n_tail]
                open_from = end if last else start + tail
            start = end
        return out + self.encode_alone(text[open_from:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[tuple, Codec] = {}


def codec(vocabulary: str, ranks: str | None = None) -> Codec:
    """This worker's codec for the files; it lives on from task to task."""
    key = (vocabulary, ranks)
    if key not in _CODECS:
        _CODECS[key] = Codec(vocabulary, ranks)
    return _CODECS[key]


def files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, ranks: str | None = None, digests: bool = False) -> DataFrame:
    """A row a document: its id under its own name, and ids, an array<int>; with digests, instead of ids, n_tokens, ids_sha256 and decoded_sha256.

    A null text is encoded as an empty one. Ids of documents pass through,
    null or repeated; other columns are not returned. Empty input gives empty
    output. Texts of any length are encoded whole.
    """
    if vocabulary is None:
        vocabulary, ranks = files()
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, ranks)
        for batch in (part for whole in batches for part in pieces(whole, 1)):
            found = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            if digests:
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                columns = [pa.array([len(x) for x in found], pa.int64()), pa.array([sha(",".join(map(own.names.__getitem__, x))) for x in found], pa.string()), pa.array([sha(own.decode(x)) for x in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], [doc_id, "ids"])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {rest}")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """A row a row: its id and text, decoded from ids (null: empty)."""
    vocabulary = vocabulary or files()[0]
    kind = encoded.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [doc_id, "text"])

    return encoded.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind}, text string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digests=True)
