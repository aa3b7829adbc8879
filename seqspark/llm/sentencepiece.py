"""SentencePiece encoding and decoding with a table of distinct marked words."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.common import in_arrow, slices

MARK = "▁"

#: A task's table forgets its words when it holds so many; words longer than this are segmented each time.
TABLE_WORDS, WORD_CHARS = 400_000, 96


def _processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def cuts_at_marks(model: bytes) -> bool:
    """Whether texts can be segmented word by word: no piece has a marker after
    another character, the normaliser leaves characters alone and keeps runs of
    spaces, and a marker is put before the text."""
    sp = _processor(model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if MARK in piece.lstrip(MARK):
            return False
    probe = " x  ﬁ Ａ　é "
    return sp.normalize(probe) == MARK + probe.replace(" ", MARK) and sp.piece_to_id(MARK) != sp.unk_id()


def chunks(text: str) -> list[str]:
    """The marked words of a text in order, the first marker of each left out:
    joined by one space they give the text again."""
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    if words == [""]:
        return []
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    if run:  # markers at the end
        out.append(" " * (run - 1))
    return out


class WordTable:
    """Ids (little-endian uint32 bytes) and decoded form of distinct marked words."""

    def __init__(self, sp, limit: int = TABLE_WORDS):
        self.sp, self.limit = sp, limit
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # words that decode to something else

    def learn(self, words: list[str]) -> None:
        todo = [w for w in words if w]
        found = self.sp.encode(todo, num_threads=1) if todo else []
        back = self.sp.decode(found, num_threads=1) if todo else []
        for w, ids, s in zip(todo, found, back, strict=True):
            self.ids[w] = np.array(ids, "<u4").tobytes()
            if s != w:
                self.odd[w] = s
        if len(todo) < len(words):  # a lone marker
            self.ids[""] = np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()

    def batch(self, texts: list[str]):
        """(ids as bytes, decoded text) of each text."""
        if len(self.ids) > self.limit:
            self.ids.clear()
            self.odd.clear()
        for text in texts:
            words = chunks(text)
            new = set(words).difference(self.ids)
            once = []
            if new:
                self.learn(list(new))
                once = [w for w in new if len(w) > WORD_CHARS]
            ids = b"".join(map(self.ids.__getitem__, words))
            if self.odd and not self.odd.keys().isdisjoint(words):
                back = " ".join([self.odd.get(w, w) for w in words])
            else:
                back = text.replace(MARK, " ")
            yield ids, back
            for w in once:
                self.ids.pop(w, None)
                self.odd.pop(w, None)


def encode_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, ids: bool = True, text: bool = True) -> DataFrame:
    """One row per row of df: id_col, n_tokens, ids_sha256, decoded_sha256, and
    ids (array<int>) and decoded (string) where asked for.

    model: the bytes of a SentencePiece model. Where no piece can cross a marker,
    each task keeps a table of the distinct marked words it has met, segments
    each once and joins the ids back by position; other models encode whole texts.

    A null text counts as empty (only the begin and end ids). Repeated rows give
    repeated results; a null id stays null; other columns of df are not looked
    at; an empty table gives no rows. Texts of any length: memory is that of one text
    and a bounded table.
    """
    apart = cuts_at_marks(model)
    schema = "id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * text
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        sp = _processor(model)
        table = WordTable(sp)
        head = np.array([sp.bos_id()] * bos, "<u4").tobytes()
        tail = np.array([sp.eos_id()] * eos, "<u4").tobytes()

        def whole(texts):
            for t in texts:
                got = sp.encode(t, num_threads=1)
                yield np.array(got, "<u4").tobytes(), sp.decode(got)

        for part in slices(batches):
            n, ih, dh, il, dl = [], [], [], [], []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for body, back in (table.batch if apart else whole)(texts):
                body = head + body + tail
                n.append(len(body) // 4)
                ih.append(hashlib.sha256(body).hexdigest())
                dh.append(hashlib.sha256(back.encode()).hexdigest())
                if ids:
                    il.append(np.frombuffer(body, "<i4"))
                if text:
                    dl.append(back)
            cols = {"id": part.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ih, pa.string()), "decoded_sha256": pa.array(dh, pa.string())}
            if ids:
                cols["ids"] = pa.array(il, pa.list_(pa.int32()))
            if text:
                cols["decoded"] = pa.array(dl, pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))
    out = in_arrow(rows, run, schema)
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
