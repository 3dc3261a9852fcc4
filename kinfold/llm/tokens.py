"""Byte-level BPE ids of whole texts through the ``tokenizers`` library.

The pre-tokenizer always breaks before a space that a non-space character
follows, so the ids of a text are the ids of its space-led chunks in turn.
Arrow splits a batch at its spaces and numbers the distinct chunks; each worker
keeps the ids of chunks it has met and sends only new ones to the library, many
at once.  Where a space is followed by white space or by the end, the chunks on
both sides are one.  ``encode`` equals ``Tokenizer.encode`` on every text;
``tests/llm`` compares them on random and awkward ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks a worker remembers (about 200 bytes each), and the longest it keeps.
MEMO_CHUNKS, MEMO_LENGTH = 1_200_000, 48
#: Chunks sent to the library as one string.
JOINED = 200
#: Where a text that has spaces beside other white space is cut.
_BREAK = re.compile(r" (?=\S)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Chunk -> number; a chunk not met before gets the next number and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, chunk):
        self.new.append(chunk)
        self[chunk] = number = len(self)
        return number


class Encoder:
    """Encodes batches of texts to uint32 arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.library.get_vocab_size()
        #: Every character of a byte-level token stands for one byte.
        self.bytes_of = np.array([len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self._clear()

    def _clear(self):
        self.memo = _Memo()
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        # Chunks that can't stand alone have a length of -1.
        self.lengths = self.starts = np.empty(0, np.int32)

    def _whole(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []

    def _joined(self, chunks: list[str]) -> tuple[list[int], np.ndarray]:
        """Ids of the chunks, each led by a space, and the number of ids of each, found from their bytes."""
        text = " " + " ".join(chunks)
        ids = self._whole(text)
        if text.isascii():
            sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        else:
            sizes = np.fromiter((len(c.encode("utf-8")) for c in chunks), np.int64, len(chunks))
        at = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(sizes + 1)) + 1
        return ids, np.diff(at, prepend=0)

    def _keep(self, ids: list[int]) -> int:
        """Append ids to the store; the place of the first."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        at, self.used = self.used, self.used + len(ids)
        self.ids[at : self.used] = ids
        return at

    def _learn(self):
        """Get the ids of the chunks that wait."""
        new, self.memo.new = self.memo.new, []
        lengths, starts = np.full(len(new), -1, np.int32), np.zeros(len(new), np.int32)
        led = [k for k, c in enumerate(new) if c.__class__ is str and c and not c[0].isspace()]
        for i in range(0, len(led), JOINED):
            some = led[i : i + JOINED]
            ids, counts = self._joined([new[k] for k in some])
            lengths[some] = counts
            starts[some] = self._keep(ids) + np.cumsum(counts) - counts
        for k, c in enumerate(new):
            if c.__class__ is tuple:  # the first chunk of a text
                ids = self._whole(c[0])
                lengths[k], starts[k] = len(ids), self._keep(ids)
        self.lengths = np.concatenate([self.lengths, lengths])
        self.starts = np.concatenate([self.starts, starts])

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of chunks, with those too long to be kept taken as the empty chunk, which can't stand alone."""
        some = pc.if_else(pc.greater(pc.utf8_length(chunks), MEMO_LENGTH), "", chunks).to_numpy(zero_copy_only=False)
        return np.fromiter(map(self.memo.__getitem__, some), np.int64, len(some))

    def _chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the chunks of all texts, and where each text's begin; the last place is the end."""
        if len(self.memo) > MEMO_CHUNKS:
            self._clear()
        split = pc.split_pattern(column, " ")
        chunks, bounds = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(chunks)
        numbers = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        heads = chunks.take(pa.array(bounds[:-1])).to_pylist()
        numbers[bounds[:-1]] = [self.memo[h,] if len(h) <= MEMO_LENGTH else self.memo[""] for h in heads]
        if self.memo.new:
            self._learn()
        return numbers, bounds

    def _apart(self, text: str) -> np.ndarray:
        """The ids of a text with chunks that are too long or can't stand alone."""
        first, *rest = _BREAK.split(text)
        numbers, out, since = self._numbers(pa.array(rest, pa.string())), [self._whole(first)], 0
        if self.memo.new:
            self._learn()
        for k in [*np.flatnonzero(self.lengths[numbers] < 0).tolist(), len(rest)]:
            out.append(self._gathered(numbers[since:k]))
            out.append(self._whole(" " + rest[k]) if k < len(rest) else [])
            since = k + 1
        return np.concatenate([np.asarray(x, np.uint32) for x in out])

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.lengths[numbers]
        first = np.cumsum(lengths, dtype=np.int64) - lengths
        return self.ids[np.repeat(self.starts[numbers] - first, lengths) + np.arange(int(lengths.sum()))]

    def _runs(self, texts: Iterable[str]):
        """Per text: numbers of its chunks, or its ids if some can't stand alone."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = pc.fill_null(column, "")
        if not len(column):
            return
        numbers, bounds = self._chunks(column)
        odd = np.minimum.reduceat(self.lengths[numbers], bounds[:-1]) < 0
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            yield (None, self._apart(column[k].as_py())) if odd[k] else (numbers[a:b], None)

    def encode(self, texts: Iterable[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text, null counting as empty."""
        return [self._gathered(numbers) if ids is None else ids for numbers, ids in self._runs(texts)]

    def count(self, texts: Iterable[str] | pa.Array) -> list[int]:
        """The number of ids of each text."""
        return [int(self.lengths[numbers].sum()) if ids is None else len(ids) for numbers, ids in self._runs(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def texts_of(column) -> list[str]:
    """An Arrow string column as texts, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]
