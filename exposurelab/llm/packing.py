"""Packing documents into fixed-length sequences by vector bin packing.

Every piece asks for three things at once: tokens, one segment, and tokens that
bear loss.  Each task fills one sequence after the other from a window of its own
documents.  The next piece is the one whose demand has the largest dot product
with what is left of the three limits; if nothing fits whole, the best one is cut
to fill the rest.  No shuffle is needed, and a task never holds more than a window.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, quoted

MAX_TOKENS = 2048
MAX_SEGMENTS = 256
WINDOW = 1024
CACHED = 150_000
PIECES = (
    "start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"
)


class Recent(dict):
    """A table of what was made lately: two generations of at most ``size`` entries."""

    def __init__(self, make, size: int = CACHED):
        super().__init__()
        self.make, self.size = make, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def all(self, keys: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, keys))


class WordTokenizer:
    """Token ids as little-endian 32-bit bytes, for byte-level vocabularies that drop white space.

    Such a tokenizer treats the words between blanks one by one, so recent words are
    looked up, in lower case and without the stop or comma behind them where that changes
    nothing.  A new word of Latin letters and signs is split by the tokenizer's own
    pattern, whose parts are looked up again or go to its merges; other words go
    through the whole tokenizer.  Memory is bounded whatever the texts hold.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spelled = [as_bytes([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.words = Recent(self.word)
        self.parts = Recent(self.part)

    def encode(self, text: str) -> bytes:
        if SIMPLE_TEXT.fullmatch(text) and "<|" not in text:
            # Most words are followed by a full stop or a comma; apart from it, far fewer are new.
            text = text.lower()
            if BESIDE.search(text):
                text = ALONE.sub(r" \g<0> ", text)
            else:
                text = text.replace(".", " . ").replace(",", " , ")
            return self.words.all(text.split())
        return self.words.all(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))

    def word(self, word: str) -> bytes:
        if LETTERS.fullmatch(word):
            return self.part(word)
        plain = PLAIN.fullmatch(word)
        if plain:
            letters, signs = plain.groups()
            made = self.parts[letters.lower()]
            return made + self.parts[signs] if signs else made
        if SIMPLE.fullmatch(word) and "<|" not in word:
            return self.parts.all(PATTERN.findall(word.lower()))
        return as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def part(self, part: str) -> bytes:
        if not part.isascii():
            part = part.encode().decode("latin-1").translate(BYTE_SIGNS)
        spelled = self.spelled
        return b"".join([spelled[t.id] for t in self.model.tokenize(part)])


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


# Words whose case, normal form and classes of characters are the same in every library.
SIMPLE = re.compile("[\x21-\x7e\xc0-\xff]*")
SIMPLE_TEXT = re.compile("[\t\n\r\x20-\x7e\xc0-\xff]*")
LETTERS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")
# Signs in a row are one part of a word, so that only lone stops and commas may be set apart.
_SIGN = "!-/:-@\\[-`{-~\xd7\xf7"
BESIDE = re.compile(f"[{_SIGN}][{_SIGN}]")
ALONE = re.compile(f"(?<![{_SIGN}])[.,](?![{_SIGN}])")
# Most of them: letters, then signs other than an apostrophe.
PLAIN = re.compile("([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")
# Fixed value: how the vocabulary's tokenizer splits normalized text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Byte-level vocabularies spell bytes that are not printable as characters from 256 on.
BYTE_SIGNS = {
    b: chr(256 + k)
    for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))
}

_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that its tables outlast a task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Fills sequences under limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool, window: int = WINDOW):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits are positive")
        self.limits = np.array([tokens, segments, loss], float)
        self.cut, self.window = cut, window
        self.items: list[list] = []  # [payload, start, end, loss start]
        self.left = self.limits.copy()
        self.open: list[tuple] = []

    def add(self, payload, n_tokens: int, loss_start: int) -> Iterator[list[tuple]]:
        """Take an example whose tokens from ``loss_start`` on bear loss; yields full sequences."""
        if not self.cut and (n_tokens > self.limits[0] or n_tokens - loss_start > self.limits[2]):
            raise ValueError(f"an example of {n_tokens} tokens does not fit and may not be cut")
        self.items.append([payload, 0, n_tokens, min(loss_start, n_tokens)])
        if len(self.items) >= self.window:
            yield from self.fill(len(self.items) // 2)

    def finish(self) -> Iterator[list[tuple]]:
        yield from self.fill(0)
        if self.open:
            yield self.close()

    def fill(self, leave: int) -> Iterator[list[tuple]]:
        """Place items until ``leave`` are left."""
        items = self.items
        demand = np.array([self.demand(x) for x in items], float).reshape(-1, 3)
        waiting = np.ones(len(items), bool)
        n_waiting = len(items)
        scaled = demand / self.limits**2
        while n_waiting > leave:
            fits = waiting & (demand <= self.left).all(axis=1)
            score = scaled @ self.left
            if fits.any():
                best = int(np.argmax(np.where(fits, score, -1.0)))
                self.place(items[best], items[best][2])
                waiting[best] = False
                n_waiting -= 1
            elif self.cut and self.left.min() >= 1:
                best = int(np.argmax(np.where(waiting, score, -1.0)))
                self.place(items[best], self.cut_at(items[best]))
                demand[best] = self.demand(items[best])
                scaled[best] = demand[best] / self.limits**2
            else:
                yield self.close()
                continue
            if self.left.min() < 1:
                yield self.close()
        self.items = [x for x, w in zip(items, waiting) if w]

    @staticmethod
    def demand(item: list) -> tuple:
        _, start, end, loss = item
        return end - start, 1, end - max(start, loss)

    def cut_at(self, item: list) -> int:
        """The furthest end that the limits allow for the piece's start."""
        _, start, end, loss = item
        return int(min(end, start + self.left[0], max(start, loss) + self.left[2]))

    def place(self, item: list, end: int) -> None:
        payload, start, _, loss = item
        bearing = max(0, end - max(start, loss))
        self.open.append((payload, start, end, bearing))
        self.left -= (end - start, 1, bearing)
        item[1] = end

    def close(self) -> list[tuple]:
        made, self.open, self.left = self.open, [], self.limits.copy()
        return made


def powers(pieces: list[tuple], full: int, cut: bool) -> Iterator[list[tuple]]:
    """Split a sequence that is not full where its length is a sum of powers of two.

    Only sequences of ``full`` tokens or a power of two need no padding, so a rest
    of 1,300 tokens becomes sequences of 1,024, 256, 16 and 4.
    """
    total = sum(e - s for _, s, e, _ in pieces)
    if total == full or not cut:
        yield pieces
        return
    sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
    queue = list(reversed(pieces))
    for size in sizes:
        made = []
        while size:
            payload, start, end, bearing = queue.pop()
            take = min(size, end - start)
            # Loss-bearing tokens are the last ones of a piece.
            later = min(bearing, end - start - take)
            made.append((payload, start, start + take, bearing - later))
            if take < end - start:
                queue.append((payload, start + take, end, later))
            size -= take
        yield made


def pack(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    end_id: int = 1,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    cut: bool = True,
    window: int = WINDOW,
) -> DataFrame:
    """Pieces of documents in their sequences; every token lies in exactly one piece.

    ``vocabulary`` is a tokenizer file on every machine.  A document is the ids of
    its prompt (no loss), of its text and ``end_id``.  Returns ``<id>, start,
    length, doc_tokens, loss_tokens, sequence_id, offset, ids``; ``ids`` holds the
    piece's ids as little-endian 32-bit numbers.  With ``cut`` documents are cut
    freely and no sequence needs padding: it has ``max_tokens`` tokens or a power
    of two.  Without, an example too large for an empty sequence raises ValueError.

    Null texts count as empty and give ``end_id`` alone; null ids stay null; rows
    repeated are packed as often as they come; an empty table gives no rows.
    Sequences follow the order of each input partition: read the input from
    files (not from a shuffle of unsure order), so that a lost task is made again alike.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens)
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, {PIECES}"
    schema = arrow_schema(docs.sparkSession, ddl)
    blank = F.lit("")
    rows = docs.select(
        quoted(id_col).alias("id"),
        F.coalesce(quoted(prompt_col), blank).alias("prompt") if prompt_col else blank.alias("prompt"),
        F.coalesce(quoted(text_col), blank).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = tokenizer_of(vocabulary)
        packer = Packer(*limits, cut, window)
        end = as_bytes([end_id])
        number = TaskContext.get().partitionId() << 33
        made, size = [], 0

        def record(sequences):
            nonlocal number, size
            for whole in sequences:
                for sequence in powers(whole, max_tokens, cut):
                    offset = 0
                    for (key, ids), start, stop, bearing in sequence:
                        part = ids[4 * start : 4 * stop]
                        made.append((key, start, stop - start, len(ids) // 4, bearing, number, offset, part))
                        offset += stop - start
                        size += len(part)
                    number += 1

        def batch():
            nonlocal size
            columns = list(zip(*made))
            made.clear()
            size = 0
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

        for rows in batches:
            for key, prompt, text in zip(*[rows.column(i).to_pylist() for i in range(3)]):
                head = tokenize.encode(prompt) if prompt else b""
                ids = head + tokenize.encode(text) + end
                record(packer.add((key, ids), len(ids) // 4, len(head) // 4))
                if size > 4_000_000:
                    yield batch()
        record(packer.finish())
        if made:
            yield batch()

    return rows.mapInArrow(run, ddl)
