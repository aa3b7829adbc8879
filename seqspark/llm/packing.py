"""Packing token sequences into windows without changing their order.

The documents of a task stand one after another; windows are cut from that stream by
dynamic programming, which minimises padding plus penalties for cuts inside a document.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow, slices

WINDOW = 2048

#: Cost of a cut at the end of a sentence and at any other token, in tokens of padding.
SENTENCE_COST, INSIDE_COST = 4, 32

#: Longer sentences may be cut at every so many tokens, too.
SENTENCE_TOKENS = 128

#: The smallest power of two that windows are cut to before a partition's end.
LEAST_POWER = 64

#: Tokens that are packed at once, and windows that stay open until more tokens are there.
LOT_TOKENS, OPEN_WINDOWS = 400_000, 8

#: A task's table of words starts anew at so many; words longer than this aren't kept.
TABLE_WORDS, WORD_CHARS = 600_000, 96

#: The last token of a word that ends a sentence carries this bit while a text is put together.
END = 1 << 31

_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")


#: What may follow a word's letters as a token's parent of its own: ASCII punctuation, without the
#: apostrophe of contractions.
_TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class Words(dict):
    """Token ids (little-endian bytes) of the distinct words met so far; the last one of a word that
    ends a sentence carries END.

    Holds for tokenizers whose tokens never cross a space or a line end. With `letters`, the letters
    and the punctuation of a word of Latin letters go to the model one after the other; other
    words go to the tokenizer."""

    def __init__(self, tokenizer, limit: int = TABLE_WORDS, letters: bool = False):
        super().__init__({"": b""})
        self.tokenizer, self.limit, self.letters = tokenizer, limit, letters
        self.cores: dict[str, bytes] = {}  # by letters, and by punctuation at a word's end
        self.tails: dict[str, bytes] = {"": b""}
        if letters:
            self.model, self.normal = tokenizer.model, tokenizer.normalizer.normalize_str

    def __missing__(self, word: str) -> bytes:
        out = None
        if self.letters and len(word) <= WORD_CHARS:
            letters = word.rstrip(_TAIL)
            if letters.isalpha() and max(letters) < "\u0250":
                out = self.core(letters)
                if out is not None and len(letters) < len(word):
                    tail = word[len(letters) :]
                    if tail not in self.tails:
                        self.tails[tail] = self.whole(tail)
                    out += self.tails[tail]
        if out is None:
            out = self.whole(word)
        if len(word) <= WORD_CHARS:
            self[word] = out
        return out

    def whole(self, word: str) -> bytes:
        ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids)
        if ids and _SENTENCE.search(word):
            ids[-1] |= END
        return ids.tobytes()

    def core(self, letters: str) -> bytes | None:
        low = letters.lower() if max(letters) < "\u0100" else self.normal(letters)
        out = self.cores.get(low)
        if out is None:
            if not low.isalpha():  # lower-casing may part a letter and a mark
                return None
            symbols = low if low.isascii() else "".join([_BYTE_SYMBOLS[b] for b in low.encode()])
            out = self.cores[low] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids, with END at the ends of sentences and lines."""
        if len(self) > self.limit:
            self.clear()
            self.cores.clear()
            self[""] = b""
        body = [b"".join(map(self.__getitem__, line.split(" "))) for line in text.split("\n")]
        ids = np.frombuffer(b"".join(body), "<u4").copy()
        if len(body) > 1:
            last = np.cumsum([len(b) for b in body]) // 4 - 1
            ids[last[last >= 0]] |= END
        return ids


def _byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    more = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(more)) for b in range(256)]


_BYTE_SYMBOLS = _byte_symbols()


def words_apart(tokenizer_json: str) -> bool:
    """Whether texts may be tokenised word by word: the normaliser only composes, lower-cases and
    replaces white space, words are split off without it, and no added token holds any."""
    import json

    conf = json.loads(tokenizer_json)
    parts = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    norm, pre = parts(conf["normalizer"], "normalizers"), parts(conf["pre_tokenizer"], "pretokenizers")
    calm = all(n["type"] in ("NFC", "NFD", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norm)
    split = pre and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and " " not in pre[0]["pattern"].get("Regex", " ")
    bare = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    added = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in conf["added_tokens"])
    return bool(calm and split and bare and added)


#: Texts on which a table of words must agree with the tokenizer before it is used.
_PROBES = ("One's  two, . ; 3 4\n\nfive! ", " \n ", "A \u0301b e\u0301 .\n.", "(ÀÉ) --Straße?! Łódź Ñ#% İ ǅ _x_ [y]")


#: A worker's table of words outlives its task: the next one goes on with it.
_KEPT: dict = {}


def _encoder(tokenizer_json: str):
    """A function from a text to its ids, with END at the ends of sentences."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if tokenizer_json in _KEPT:
        return _KEPT[tokenizer_json]
    tokenizer = Tokenizer.from_str(tokenizer_json)
    if words_apart(tokenizer_json):
        for letters in (True, False):
            words = Words(tokenizer, letters=letters and tokenizer.normalizer is not None)
            if all((words.encode(t) & ~np.uint32(END)).tolist() == tokenizer.encode(t, add_special_tokens=False).ids for t in _PROBES):
                _KEPT.clear()
                _KEPT[tokenizer_json] = words.encode
                return words.encode

    def whole(text: str) -> np.ndarray:
        got = tokenizer.encode(text, add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        ids[[i for i, (_, b) in enumerate(got.offsets) if _SENTENCE.search(text[max(0, b - 4) : b])]] |= END
        return ids

    return whole


def boundaries(ends: np.ndarray, docs: np.ndarray, sentence_cost: int, inside_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and what each cut costs: the ends of its documents (nothing),
    those of sentences, and places within long sentences."""
    edges = np.union1d(ends, docs)
    cost = np.full(len(edges), sentence_cost, np.int64)
    cost[np.searchsorted(edges, docs)] = 0
    more = (np.diff(edges, prepend=0) - 1) // SENTENCE_TOKENS  # inner places of each sentence
    total = int(more.sum())
    if not total:
        return edges, cost
    first = np.repeat(np.concatenate([[0], edges[:-1]]), more)
    step = np.arange(total) - np.repeat(np.cumsum(more) - more, more) + 1
    at = np.concatenate([edges, first + step * SENTENCE_TOKENS])
    cost = np.concatenate([cost, np.full(total, inside_cost, np.int64)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def cut(at: np.ndarray, cost: np.ndarray, window: int, least: int = 1) -> np.ndarray:
    """The cuts of least cost, the last place of `at` among them.

    at: ascending places from 1 on, no two (and no first) further apart than `window`; cost of
    cutting at each. A window from a to b costs window - (b - a) of padding, nothing if
    b - a is a power of two from `least` on. f(b) = cost(b) + the least of f(a) + padding over a >= b - window:
    the linear part comes from a queue of rising f(a) + a, the powers from their places."""
    place = np.concatenate([[0], at])
    n = len(place)
    number = np.full(int(place[-1]) + 1, -1, np.int32)  # of the place at each token
    number[place] = np.arange(n)
    ends, begins, size = [], [], least
    while size < window:  # a whole window has no padding anyway
        late = int(np.searchsorted(place, size))
        found = number[place[late:] - size]
        hit = np.flatnonzero(found >= 0)
        ends.append(hit + late)
        begins.append(found[hit])
        size *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    ends, begins = [*ends[order].tolist(), n], begins[order].tolist()
    p, price = place.tolist(), [0, *cost.tolist()]
    best, came = [0] * n, [0] * n
    queue, head = deque([(0, 0, 0)]), 0  # (f(a) + a, a's place, a), the first rising
    due = ends[0]
    for b in range(1, n):
        pb = p[b]
        low = pb - window
        while queue[0][1] < low:
            queue.popleft()
        value, _, a = queue[0]
        value += window - pb
        while due == b:
            j = begins[head]
            if best[j] < value:
                a, value = j, best[j]
            head += 1
            due = ends[head]
        value += price[b]
        best[b], came[b] = value, a
        value += pb
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, pb, b))
    out, b = [], n - 1
    while b:
        out.append(p[b])
        b = came[b]
    return np.array(out[::-1], np.int64)


class Packer:
    """Takes documents in order and gives their pieces, window by window."""

    def __init__(self, window: int, sentence_cost: int, inside_cost: int, base: int):
        self.window, self.costs, self.next = window, (sentence_cost, inside_cost), base
        self.docs: list[tuple] = []  # id, tokens before, ids left (with END), tokens in all
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)

    def take(self, last: bool):
        """Pieces of the windows that are settled; of all, if no more documents come."""
        if not self.size:
            return
        stream = np.concatenate([d[2] for d in self.docs])
        starts = np.cumsum([0, *(len(d[2]) for d in self.docs)])
        at, cost = boundaries(np.flatnonzero(stream & END) + 1, starts[1:], *self.costs)
        stream &= ~np.uint32(END)
        if last:  # the rest may be cut anywhere, so that it can become windows of powers of two
            free = np.setdiff1d(np.arange(max(1, self.size - self.window), self.size), at)
            at, cost = np.concatenate([at, free]), np.concatenate([cost, np.full(len(free), self.costs[1])])
            order = np.argsort(at)
            at, cost = at[order], cost[order]
        cuts = cut(at, cost, self.window, 1 if last else LEAST_POWER)
        if not last:
            cuts = cuts[: max(0, len(cuts) - OPEN_WINDOWS)]
        if not len(cuts):
            return
        stop = int(cuts[-1])
        edges = np.union1d(cuts, starts[1:-1][starts[1:-1] < stop])
        begin = np.concatenate([[0], edges[:-1]])
        doc = np.searchsorted(starts, begin, side="right") - 1
        win = np.searchsorted(cuts, begin, side="right")
        offset = begin - np.concatenate([[0], cuts])[win]
        before = begin - starts[doc]
        for b, e, d, w, o, s in zip(begin.tolist(), edges.tolist(), doc.tolist(), win.tolist(), offset.tolist(), before.tolist(), strict=True):
            doc_id, given, _, tokens = self.docs[d]
            yield doc_id, given + s, e - b, stream[b:e], tokens, self.next + w, o
        self.next += len(cuts)
        d = int(np.searchsorted(starts, stop, side="right")) - 1
        self.docs = self.docs[d:]
        if self.docs and stop > starts[d]:
            doc_id, given, ids, tokens = self.docs[0]
            a = stop - int(starts[d])
            self.docs[0] = (doc_id, given + a, ids[a:], tokens)
        self.size -= stop


def pack(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, window: int = WINDOW, sentence_cost: int = SENTENCE_COST, inside_cost: int = INSIDE_COST, ids: bool = False) -> DataFrame:
    """One row per piece of a document: id_col, start (its document's tokens before it),
    length, ids_crc32, doc_tokens, sequence_id, offset (in its sequence), and ids
    (array<int>) where asked for.

    tokenizer_json: a tokenizer's JSON file as text; a document is its ids without special
    tokens, then end_id (if not null). Sequences hold at most `window` (256 at least) tokens and are to be
    padded to it, unless their length is a power of two. Rows keep the order of their
    input partition; cuts fall on ends of documents, for sentence_cost on ends of
    sentences or lines, for inside_cost inside sentences over SENTENCE_TOKENS tokens
    and anywhere in a partition's last window.

    A partition is packed by the task that reads it: nothing is shuffled, and padding that a
    partition's end adds is that of one window, split into powers of two. sequence_id holds the
    partition's number in its upper bits. Memory is that of LOT_TOKENS tokens and one text.
    A null text counts as empty (end_id alone); without end_id an empty document has no
    piece. Null and repeated ids stay as they are, each row being a document of its own;
    other columns aren't looked at; an empty table gives no rows.
    """
    if window < 2 * SENTENCE_TOKENS:
        raise ValueError(f"window must be {2 * SENTENCE_TOKENS} or more")
    schema = "id string, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * ids
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * ids
    types = [pa.string(), *[pa.int64()] * 6] + [pa.list_(pa.int32())] * ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def settled(packer: Packer, last: bool):
        rows = []
        for doc_id, start, length, own, tokens, sequence, offset in packer.take(last):
            rows.append((doc_id, start, length, zlib.crc32(own), tokens, sequence, offset) + ((own.astype(np.int32),) if ids else ()))
            if len(rows) == 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def run(batches):
        encode = _encoder(tokenizer_json)
        packer = Packer(window, sentence_cost, inside_cost, TaskContext.get().partitionId() << 33)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = np.concatenate([encode(text or ""), tail])
                if len(own):
                    packer.add(doc_id, own)
                if packer.size >= LOT_TOKENS:
                    yield from settled(packer, False)
        yield from settled(packer, True)

    out = in_arrow(df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")), run, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
