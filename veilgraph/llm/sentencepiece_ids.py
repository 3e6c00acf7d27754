"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a word's letter before a white-space marker, so no
merge crosses the place where a marker follows another character.  A text is
cut there into marked words; each distinct marked word is segmented once by the
library, and the ids of a text are its words' ids joined by position.

The table of distinct words belongs to a Python worker and is emptied when it
holds ``MAX_TABLE_CHARS`` characters, so memory is bounded; a word met again is
then segmented again, with the same ids.  A table for the whole corpus would
need every word occurrence shuffled, several times the input; a worker's own
table moves nothing.

Defined results: a null or empty text has the end id alone and decodes to the
empty text; a text without spaces is one marked word; repeated rows are encoded
each; the output has the input's columns, with the operator's own columns in
place of any that share their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgraph.llm.base import small_batches, text_of

MARKER = "▁"
CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")
MAX_TABLE_CHARS = 40_000_000
MAX_WORD_CHARS = 256
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class ChunkTable(dict):
    """Ids and decoded text of each distinct marked word, segmented when first met."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        for i, piece in enumerate(pieces):
            if not self.model.is_control(i) and MARKER in piece.lstrip(MARKER):
                raise ValueError(f"piece {piece!r} crosses a white-space marker; chunks would not be independent")
        if self.model.encode(" a  b ", out_type=str) != self._plain(" a  b "):
            raise ValueError("the model changes white space; chunks would not be independent")
        self.eos = self.model.eos_id()
        self.raw = [self._bytes_of(i, piece) for i, piece in enumerate(pieces)]
        self.chars = 0

    def _plain(self, text: str) -> list[str]:
        chunks = CHUNK.findall(MARKER + text.replace(" ", MARKER))
        return [piece for c in chunks for piece in (self.model.encode(c[1:], out_type=str) if c[1:] else [c])]

    def _bytes_of(self, i: int, piece: str) -> bytes:
        if self.model.is_control(i):
            return b""
        if self.model.is_byte(i):
            return bytes([int(_BYTE.match(piece)[1], 16)])
        if self.model.is_unknown(i):
            return " ⁇ ".encode()
        return piece.replace(MARKER, " ").encode()

    def _segment(self, chunk: str) -> tuple[str, int, bytes]:
        # The library puts the first marker back itself.
        ids = self.model.encode(chunk[1:]) if chunk[1:] else [self.model.piece_to_id(MARKER)]
        return " ".join(map(str, ids)), len(ids), b"".join([self.raw[i] for i in ids])

    def __missing__(self, chunk: str) -> tuple[str, int, bytes]:
        found = self._segment(chunk)
        if len(chunk) <= MAX_WORD_CHARS:  # longer ones are hardly met again
            if self.chars > MAX_TABLE_CHARS:
                self.clear()
                self.chars = 0
            self[chunk] = found
            self.chars += len(chunk)
        return found

    def encode(self, text: str) -> tuple[str, int, bytes]:
        """Ids joined by spaces, their number, and the decoded text in UTF-8; the end id included."""
        if not text:
            return str(self.eos), 1, b""
        found = [self[chunk] for chunk in CHUNK.findall(MARKER + text.replace(" ", MARKER))]
        ids, counts, raw = zip(*found)
        # decode() drops the marker that the encoder put first.
        return f"{' '.join(ids)} {self.eos}", sum(counts) + 1, b"".join(raw)[1:]


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The worker's table; kept between tasks, as Spark reuses its Python workers."""
    if model_path not in _TABLES:
        _TABLES[model_path] = ChunkTable(model_path)
    return _TABLES[model_path]


def encode_decode(docs: DataFrame, model_path: str, column: str = "text", ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (array), ``decoded``, ``ids_sha256`` and ``decoded_sha256``.

    ``ids=False`` leaves the two long columns out.  ``model_path`` is read by
    each executor, like the tokenizer libraries themselves.
    """
    small_batches(docs.sparkSession)
    added = [T.StructField("n_tokens", T.LongType())]
    if ids:
        added += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = [f.name for f in added]
    others = [c for c in docs.columns if c not in names]
    source = "_encoded_text"
    while source in others:
        source = f"_{source}"
    keep_text = [F.col(f"`{c}`") for c in others if ids or c != column]
    taken = docs.select(*keep_text, text_of(column).alias(source))
    kept = taken.columns[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = chunk_table(model_path)
        for batch in batches:
            rows = []
            for text in batch[source]:
                joined, n, raw = words.encode(text)
                digests = [hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()]
                whole = [list(map(int, joined.split())), raw.decode("utf-8", "replace")] if ids else []
                rows.append([n, *whole, *digests])
            out = pd.DataFrame(rows, columns=names)
            yield pd.concat([batch[kept].reset_index(drop=True), out], axis=1)

    schema = T.StructType([*[taken.schema[c] for c in kept], *added])
    return taken.mapInPandas(run, schema)
