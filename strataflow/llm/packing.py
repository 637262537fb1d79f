"""Cost-balanced packing of documents into fixed-length token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import giving_back, single_threaded
from .segments import batches_of

SEQUENCE_TOKENS = 2048
WINDOW_TOKENS = 1 << 21
CHUNK_CHARS = 1 << 22
# Pieces leave a task when they are so many, or their ids so many bytes.
READY_PIECES = 20_000
READY_BYTES = 1 << 22
SEPARATOR_ID = 1


# Bytes of the text after lower-casing, by what the pre-tokeniser makes of them; beside OTHER nothing is cut.
OTHER, LETTER, DIGIT, MARK, APOSTROPHE, BLANK = range(6)


def byte_tables() -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-casing of A-Z with one kind of blank, classes of bytes, and the pairs of classes to cut between.

    The pre-tokeniser takes runs of letters, single digits, and runs of marks; only ``'s`` and the like join a
    mark and letters, and they begin with an apostrophe.
    """
    lower = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
    kind = np.zeros(256, np.uint8)
    kind[33:127] = MARK
    kind[48:58], kind[97:123], kind[39], kind[32] = DIGIT, LETTER, APOSTROPHE, BLANK
    cut = np.zeros((6, 6), bool)
    cut[[[LETTER], [MARK], [APOSTROPHE]], DIGIT] = cut[LETTER, [MARK, APOSTROPHE]] = True
    cut[DIGIT, [LETTER, DIGIT, MARK, APOSTROPHE]] = cut[MARK, LETTER] = True
    cut[:, BLANK] = True
    return lower, kind, cut.ravel()


LOWER, KIND, CUT = byte_tables()


class WordIds:
    """Token ids of a text, piece by piece.

    The vocabulary's pre-tokeniser drops white space and never joins across it, nor across most changes
    between letters, digits and marks, so the ids of a text are those of its pieces in order, and a piece that
    recurs is encoded once.  Texts of a batch are cut as one string of bytes; a piece keeps the blank before it.
    Pieces are kept in two generations, so the frequent ones stay and memory is bounded.
    It lower-cases, so A-Z can be lowered before pieces are told apart.
    """

    def __init__(self, path: str, separator: int = SEPARATOR_ID, keep: int = 300_000):
        single_threaded()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends_word = self.ends_of_words()
        self.keep, self.known, self.older = keep, {}, {}
        self.end = np.array([separator], dtype="<u4").tobytes()

    def ends_of_words(self) -> np.ndarray:
        """Per token id whether it ends a word; never, if the vocabulary can't end a word in every byte."""
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        out = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        if suffix:
            ends = [i for token, i in vocabulary.items() if token.endswith(suffix)]
            if sum(len(token) == len(suffix) + 1 for token in vocabulary if token.endswith(suffix)) >= 256:
                out[ends] = 1
        return out

    def cuts(self, data: bytes) -> np.ndarray:
        """Where pieces start: at every blank and, if no added token stands there, between classes of bytes."""
        kinds = KIND[np.frombuffer(data, np.uint8)]
        if any(token in data for token in self.added):
            return np.flatnonzero(kinds == BLANK)
        inner = np.flatnonzero(CUT[kinds[:-1] * np.uint8(6) + kinds[1:]]) + 1
        return np.concatenate([[0], inner])

    def ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > self.keep // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for piece in pieces:
            if piece not in known:
                ids = older.get(piece)
                if ids is None:
                    new.append(piece)
                else:
                    known[piece] = ids
        words = [piece.decode("utf-8", "replace").lstrip(" ") for piece in new]
        alone = np.array([word.isalpha() for word in words], dtype=bool)
        for learn, some in ((self.learn_letters, np.flatnonzero(alone)), (self.learn_words, np.flatnonzero(~alone))):
            for lo in range(0, len(some), 512):
                part = some[lo : lo + 512].tolist()
                learn([new[i] for i in part], [words[i] for i in part])
        return [known[piece] for piece in pieces]

    def learn_letters(self, pieces: list[bytes], words: list[str]) -> None:
        """Words of letters in one text, cheaper than a list of words: each is one run for the pre-tokeniser."""
        ids = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids
        last = self.ends_word[ids]
        if np.count_nonzero(last) == len(words):
            self.store(pieces, ids, np.cumsum(last) - last)
        else:  # lower-casing or composing has made something else of a letter
            self.learn_words(pieces, words)

    def learn_words(self, pieces: list[bytes], words: list[str]) -> None:
        """One call for many words: a call costs more than a word."""
        encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        self.store(pieces, encoded.ids, np.array(encoded.word_ids, dtype=np.int64))

    def store(self, pieces: list[bytes], ids: list[int], of: np.ndarray) -> None:
        data = np.array(ids, dtype="<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(of, minlength=len(pieces)))).tolist()
        for piece, a, b in zip(pieces, [0, *ends], ends):
            self.known[piece] = data[a:b]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text with the separator id at its end."""
        for lo, hi in batches_of([len(t or "") for t in texts], CHUNK_CHARS):
            raw = [b" " + (t or "").encode("utf-8", "replace") for t in texts[lo:hi]]
            data = b"".join(raw).translate(LOWER)
            starts = self.cuts(data)
            edges = np.append(starts, len(data)).astype(np.int64)
            pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
            ids = pa.array(self.ids_of(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64)
            held = memoryview(ids.buffers()[2] or b"")
            ends = at[np.searchsorted(edges, np.cumsum([len(r) for r in raw]))].tolist()
            for a, b in zip([0, *ends], ends):
                yield b"".join((held[a:b], self.end))


def place(lengths: np.ndarray, n_sequences: int, capacity: int, linear: float, quadratic: float):
    """Pieces (item, start, length, sequence) for as many tokens as ``n_sequences`` hold.

    Items go in descending length to the cheapest sequence with room for them; an item that fits
    nowhere is cut over the cheapest sequences that have any room left.  A piece costs
    ``linear * n + quadratic * n**2``: attention stays inside a piece.  Also returns what is left of
    each item.
    """
    cost, room = np.zeros(n_sequences), np.full(n_sequences, capacity)
    pieces, waiting, left = [], [], lengths.copy()
    for item in np.argsort(-lengths, kind="stable"):
        n = int(lengths[item])
        fits = np.where(room >= n, cost, np.inf)
        at = int(fits.argmin()) if n_sequences else -1
        if at < 0 or fits[at] == np.inf:
            waiting.append(item)
            continue
        pieces.append((item, 0, n, at))
        cost[at] += linear * n + quadratic * n * n
        room[at] -= n
        left[item] = 0
    for item in waiting:
        start = 0
        while left[item] and room.any():
            at = int(np.where(room > 0, cost, np.inf).argmin())
            n = int(min(left[item], room[at]))
            pieces.append((item, start, n, at))
            cost[at] += linear * n + quadratic * n * n
            room[at] -= n
            left[item] -= n
            start += n
    return pieces, left


class Packer:
    """Packs a stream of encoded documents; holds at most one window of tokens."""

    def __init__(self, first_id: int, capacity: int, window: int, linear: float, quadratic: float, with_ids: bool):
        self.next_id, self.capacity, self.window, self.with_ids = first_id, capacity, window, with_ids
        self.linear, self.quadratic = linear, quadratic
        self.open: list[tuple] = []  # (doc_id, tokens of the document, start of this rest, ids of the rest)
        self.held = 0
        self.out: list[tuple] = []
        self.out_bytes = 0

    def emit(self, doc, total, start, ids, sequence, offset):
        piece = (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset)
        self.out.append((*piece, ids) if self.with_ids else piece)
        self.out_bytes += len(ids) if self.with_ids else 0

    def full(self) -> bool:
        return len(self.out) > READY_PIECES or self.out_bytes > READY_BYTES

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.capacity:
            self.emit(doc, total, start, ids[4 * start : 4 * (start + self.capacity)], self.next_id, 0)
            self.next_id += 1
            start += self.capacity
        if start < total:
            self.open.append((doc, total, start, ids[4 * start :]))
            self.held += total - start
        if self.held >= self.window:
            self.close(final=False)

    def close(self, final: bool) -> None:
        """Fill whole sequences; what is left waits for the next window, at the end it is padded."""
        n_sequences = -(-self.held // self.capacity) if final else self.held // self.capacity
        lengths = np.array([len(ids) // 4 for *_, ids in self.open], dtype=np.int64)
        pieces, left = place(lengths, n_sequences, self.capacity, self.linear, self.quadratic)
        offset = [0] * n_sequences
        for item, start, n, at in pieces:
            doc, total, base, ids = self.open[item]
            self.emit(doc, total, base + start, ids[4 * start : 4 * (start + n)], self.next_id + at, offset[at])
            offset[at] += n
        self.next_id += n_sequences
        rest = []
        for (doc, total, base, ids), length, keep in zip(self.open, lengths, left):
            if keep:
                done = int(length - keep)
                rest.append((doc, total, base + done, ids[4 * done :]))
        self.open, self.held = rest, int(left.sum())

    def frame(self, columns: list[str]) -> pd.DataFrame:
        """What is ready, as columns."""
        ready = pd.DataFrame(self.out, columns=[*columns, "ids"] if self.with_ids else columns)
        self.out, self.out_bytes = [], 0
        return ready


def pack(
    docs: DataFrame,
    tokenizer: str,
    sequence_tokens: int = SEQUENCE_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
    linear: float = 1.0,
    quadratic: float = 1.0 / SEQUENCE_TOKENS,
    separator: int = SEPARATOR_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every task packs the documents it reads, ``window_tokens`` at a time, without a shuffle: full
    sequences are cut off long documents, the rests go in descending length to the sequence of lowest
    attention cost with room left, and what fits nowhere is cut.  Only the last sequence of a task is
    padded.  ``sequence_id`` counts on from the task's number times 2**33.  ``with_ids`` adds the ids as
    little-endian 32-bit words.

    A null or empty text is one piece with only the separator; a null doc_id stays null; repeated rows
    are packed each; an empty table gives no rows; other columns are not read.
    """
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in numbers]]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    columns = ["doc_id", *numbers]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordIds(tokenizer, separator)  # gone with the task, as is its memory
        first = TaskContext.get().partitionId() << 33
        packer = Packer(first, sequence_tokens, window_tokens, linear, quadratic, with_ids)
        for batch in batches:
            ids_of = encoder.encode(batch["text"].tolist())
            for doc, ids in zip(batch["doc_id"].astype(object), ids_of):
                packer.add(None if pd.isna(doc) else doc, ids)
                if packer.full():
                    yield typed(packer.frame(columns))
        packer.close(final=True)
        yield typed(packer.frame(columns))

    def typed(df: pd.DataFrame) -> pd.DataFrame:
        if docs_are_long:
            df["doc_id"] = df["doc_id"].astype("Int64")
        return df

    docs_are_long = dict(docs.dtypes)["doc_id"] in ("bigint", "int")
    return docs.select("doc_id", "text").mapInPandas(giving_back(run), schema)
