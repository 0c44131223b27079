"""Exact token counts at every prefix of a text, by dynamic programming.

A piece is a span that the pre-tokenizer cuts out. In byte-pair encoding the
last token of a piece's prefix is the only vocabulary entry that ends there and
*follows* the last token of what stands before it, that is, the two alone are
encoded as these two. So

    count(i) = count(i - length of the last token) + 1

is found from left to right with one pass of an automaton that lists the entries
ending at each byte; whether one token may follow another is asked once for each
pair. A piece is never encoded again for its prefixes.

A prefix of a text is its whole pieces and a rest. The rest is a prefix of the next piece
but in three places, which are treated as the library treats the prefix as a text of its own:

* white space at the end of a prefix is one piece, though in the text its last
  blank may open the next piece;
* ``'l``, ``'r`` and ``'v`` of a cut contraction are two pieces;
* a special string that is cut is ordinary text, and so is one with what stands before it.

Counts that a text can have stand at the last byte of each character. They need
not rise: a longer prefix can have fewer tokens.

Defined cases: null counts as empty; an empty text has no tokens and no
prefixes; rows of equal or null doc_id keep their own entries; other columns of
the input, whatever their names, are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._units import UnitMemo, encode_spans
from lodestone.llm.token_files import ByteBpe, coder

#: Bytes of text that a worker counts at a time; a byte takes some thirty bytes of arrays meanwhile.
BATCH_BYTES = 1 << 20
#: Pairs of tokens whose answer a worker remembers.
PAIRS = 4_000_000
MEMO_UNITS = 200_000
#: Bytes of the longest piece that is remembered.
LONGEST = 64

# Unicode's white space, and contractions that the pre-tokenizer keeps together.
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
CONTRACTIONS = ("'ll", "'re", "'ve")
#: The pre-tokenizer's pattern with its classes for ASCII alone.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

TOTALS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long"
STORED = "doc_id long, text string, counts binary"


class PrefixCounter:
    """Token counts of all prefixes, for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick

        self.bpe: ByteBpe = coder(path)
        self.split = self.bpe.whole.pre_tokenizer.pre_tokenize_str
        self.single = self.bpe.fast._encode_single_piece
        self.entries = ahocorasick.Automaton()
        for token in self.bpe.fast.token_byte_values():
            self.entries.add_word(token.decode("latin-1"), (self.bpe.fast.encode_single_token(token), len(token)))
        self.entries.make_automaton()
        self.names = {self.bpe.fast.encode_single_token(t): t for t in self.bpe.fast.token_byte_values()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.memo = UnitMemo(self._units, MEMO_UNITS)

    def follows(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side in an encoded piece; remembered."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.single(self.names[left] + self.names[right]) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Counts of the prefixes of one piece, by length."""
        count, last = [0] * len(data), [0] * len(data)
        pairs, follows = self.pairs, self.follows
        for end, (token, size) in self.entries.iter(data.decode("latin-1")):
            if count[end]:
                continue
            before = end - size
            if before < 0:
                count[end], last[end] = 1, token
                continue
            left = last[before]
            known = pairs.get(left << 32 | token)
            if follows(left, token) if known is None else known:
                count[end], last[end] = count[before] + 1, token
        return count

    def remembered(self, part: bytes) -> list[int]:
        """``piece``, of a short piece from memory if it was met lately."""
        if len(part) > LONGEST:
            return self.piece(part)
        counts = self.pieces.get(part)
        if counts is None:
            if len(self.pieces) >= MEMO_UNITS:
                self.pieces.clear()
            counts = self.pieces[part] = self.piece(part)
        return counts

    def cut(self, text: str) -> list[str]:
        """Pieces of a text, as the pre-tokenizer cuts them; ASCII is cut here, where the classes are plain."""
        return ASCII_PIECES.findall(text) if text.isascii() else [text[a:b] for _, (a, b) in self.split(text)]

    def unit(self, text: str) -> list[int]:
        """Counts of the prefixes, in bytes, of a text that starts where a piece starts and holds no special string."""
        pieces = self.cut(text)
        if len(pieces) == 1 and pieces[0] not in CONTRACTIONS:
            return self.remembered(text.encode())
        out: list[int] = []
        base, run = 0, b""  # tokens of whole pieces; white space that is open
        run_start = run_base = 0
        for chars in pieces:
            part = chars.encode()
            start, blank = len(out), chars[0] in WHITE and not chars.strip(WHITE)
            counts = self.remembered(part)
            out += [base + c for c in counts] if base else counts
            if chars in CONTRACTIONS:
                out[start + 1] = base + 2
            if blank and not run:
                run_start, run_base = start, base
            if run and (blank or part[:1] == b" "):
                # A prefix that ends here has one piece of white space, from the run's start.
                run += part if blank else b" "
                for k, c in enumerate(self.piece(run), run_start):
                    out[k] = run_base + c
            elif blank:
                run = part
            if not blank:
                run = b""
            base += counts[-1]
        return out

    def _units(self, found: list[bytes]) -> list[bytes]:
        return [np.array(self.unit(u.decode()), "<u4").tobytes() for u in found]

    def ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts at each byte of texts, special strings taken as ordinary text, and where each text starts (one entry more)."""
        buf, offsets = T.flat(texts)
        if not len(buf):
            return np.zeros(0, np.uint32), offsets
        start, end, first = self.bpe.spans(buf, offsets)
        counts, _ = encode_spans(buf, start, end, first, self.memo, "<u4")
        own = counts[end - 1]
        before = np.cumsum(own, dtype=np.int64) - own
        filled = first[:-1] < len(start)
        of_text = np.zeros(len(offsets) - 1, np.int64)
        of_text[filled] = before[first[:-1][filled]]
        base = before - np.repeat(of_text, np.diff(first))
        return counts + np.repeat(base, end - start).astype(np.uint32), offsets

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token count of the prefix that ends with each byte of the texts, and where each text starts (one entry more)."""
        out, offsets = self.ordinary(texts)
        special = self.bpe.special
        buf, _ = T.flat(texts)
        if special is None or not special.search(buf.tobytes()):
            return out, offsets
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            data = buf[a:b].tobytes()
            if special.search(data):
                out[a:b] = self._with_special(data)
        return out, offsets

    def _with_special(self, data: bytes) -> np.ndarray:
        """Counts of a text with special strings: each is one token, and text after it starts anew."""
        found = [m.span() for m in self.bpe.special.finditer(data)]
        begins, ends = [0, *(e for _, e in found)], [*(s for s, _ in found), len(data)]
        # Up to a special string's last byte it is ordinary text that goes on from what stands before.
        reach = [*(e - 1 for _, e in found), len(data)]
        parts, edges = self.ordinary(pa.array([data[a:b].decode() for a, b in zip(begins, reach)], pa.large_string()))
        out, base = np.zeros(len(data), np.uint32), 0
        for k, (a, b, at) in enumerate(zip(begins, ends, reach)):
            part = parts[edges[k] : edges[k + 1]]
            out[a:at] = base + part
            if b > a:
                base += int(part[b - a - 1])
            if at < len(data):
                base += 1
                out[at] = base
        return out


def char_ends(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mask of the bytes that end a character."""
    out = np.ones(len(buf), bool)
    out[:-1] = (buf[1:] & 0xC0) != 0x80
    return out


def longest_within(counts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, limit: int) -> np.ndarray:
    """Bytes of each text's longest prefix of whole characters with at most ``limit`` tokens."""
    fits = np.where(ends & (counts <= limit), np.arange(1, len(counts) + 1), 0)
    out = np.zeros(len(offsets) - 1, np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        out[filled] = np.maximum(np.maximum.reduceat(fits, offsets[filled]) - offsets[filled], 0)
    return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def totals(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of each text, whether they exceed ``limit``, and the bytes of the longest prefix that does not."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for table in C.bounded(batches, BATCH_BYTES):
            at, offsets = count.counts(table.column("text"))
            buf, _ = T.flat(table.column("text"))
            size = np.diff(offsets)
            n = np.zeros(len(size), np.int64)
            n[size > 0] = at[offsets[1:][size > 0] - 1]
            cut = longest_within(at, char_ends(buf, offsets), offsets, limit)
            columns = [table.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit), pa.array(cut)]
            yield from pa.table(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"]).to_batches()

    return _texts(docs).mapInArrow(work, TOTALS)


def store(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Texts with the token count of each prefix: little-endian unsigned 32-bit integers, one for each byte of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for table in C.bounded(batches, BATCH_BYTES):
            at, offsets = count.counts(table.column("text"))
            at = at.astype("<u4", copy=False)
            kept = pa.array([at[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield from table.append_column("counts", kept).select(["doc_id", "text", "counts"]).to_batches()

    return _texts(docs).mapInArrow(work, STORED)


def truncate(stored: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each stored text and limit, the longest prefix of at most that many tokens; no tokenizer runs.

    Returns doc_id, max_tokens, n_tokens of the prefix, and the prefix. Texts with no such prefix but the empty one give that.
    """
    wanted = sorted(set(limits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.bounded(batches, BATCH_BYTES):
            buf, offsets = T.flat(table.column("text"))
            at = np.frombuffer(b"".join(x.as_py() for x in table.column("counts")), "<u4")
            ends = char_ends(buf, offsets)
            for limit in wanted:
                cut = longest_within(at, ends, offsets, limit)
                n = np.zeros(len(cut), np.int64)
                n[cut > 0] = at[(offsets[:-1] + cut - 1)[cut > 0]]
                texts = [buf[a : a + k].tobytes().decode() for a, k in zip(offsets[:-1].tolist(), cut.tolist())]
                columns = [table.column("doc_id"), pa.array([limit] * len(cut), pa.int32()), pa.array(n), pa.array(texts, pa.string())]
                yield from pa.table(columns, names=["doc_id", "max_tokens", "n_tokens", "text"]).to_batches()

    return stored.mapInArrow(work, "doc_id long, max_tokens int, n_tokens long, text string")


def spans_within(stored: DataFrame, budget: int) -> DataFrame:
    """Cut each stored text into consecutive spans whose counts, as differences of stored counts, stay within ``budget``.

    A span runs from one character end to the last at which the text's count is at most ``budget`` above the count at the
    span's start. Returns doc_id, span (from 0), start and stop in bytes, and that difference; no tokenizer runs. A single
    character that exceeds the budget is a span of its own. The difference is what the span adds to the text before it;
    encoded alone, a span can have other tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.flatnonzero(char_ends(data, np.array([0, len(data)])))
                at = np.frombuffer(counts, "<u4")[ends].astype(np.int64)
                ahead = np.minimum.accumulate(at[::-1])[::-1]  # least count from here on: rises, so it can be searched
                begin, had, span = 0, 0, 0
                while begin < len(ends):
                    stop = max(begin + 1, int(np.searchsorted(ahead, had + budget, "right")))
                    rows.append((doc, span, int(ends[begin - 1]) + 1 if begin else 0, int(ends[stop - 1]) + 1, int(at[stop - 1]) - had))
                    begin, had, span = stop, int(at[stop - 1]), span + 1
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "span", "start", "stop", "tokens"])

    return stored.mapInArrow(work, "doc_id long, span int, start long, stop long, tokens long")
