"""SentencePiece encoding and decoding for merge-type vocabularies, with a score-ordered agenda of adjacent symbol pairs.

A text gets a space in front, its spaces become U+2581, and its characters are the first symbols. The agenda is a heap of
adjacent pairs whose joined text is a piece, best score first, leftmost first; a pair that has changed since it was
entered is passed over when it comes up. A run of n symbols costs O(n log n) even where a text is one unbroken word.
What is no piece in the end falls back to bytes.

Characters that stand side by side in some piece are of one kind (letters are, and so are signs; digits and line ends stand
beside none). No merge crosses the place between two kinds, nor that before U+2581, which no piece has behind another
character, so a text is encoded in parts that begin there. Parts repeat, so short ones are looked up once encoded. The parts
that an Arrow batch has encoded for the first time are checked against the sentencepiece library in one call for the batch;
a part that differs fails the task.

Null and empty texts have no ids and an empty decoded text. Rows are encoded one by one, so repeated rows and ids give equal
rows and nothing depends on order; of equal scores the leftmost pair is merged. No rows give no rows. A text is never cut:
one of many megabytes is encoded whole, in memory that grows with that text alone. Columns other than id and text are not
read, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from cinderlake.llm.bpe import as_class, id_and_text
from cinderlake.llm.common import held
from cinderlake.shipping import ship

MARK = "▁"
#: What one byte of a byte piece, and a control piece, is while a text is put together: no text from Spark holds such code points.
BYTE_POINT, CONTROL = 0xDC00, "\udd00"
#: Encoded parts that a Python worker keeps, and their longest length; as many may be set aside. Some 100 MB.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 48
#: Bits of a pair's length in an entry of the agenda.
SIZE_BITS = 8
SIZE_MASK = (1 << SIZE_BITS) - 1

codecs.register_error("each byte", lambda error: ("�", error.start + 1))


def kinds_of(pieces: Iterable[str]) -> list[str]:
    """Characters in groups: those that stand side by side in some piece are in one; without U+2581 and those that stand beside none."""
    over: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := over.setdefault(c, c)) != c:
            c = up
        return c

    for piece in pieces:
        bare = piece.lstrip(MARK)
        for a, b in zip(bare, bare[1:], strict=False):
            over[top(a)] = top(b)
        if bare != piece and bare:
            top(bare[0])
    groups: dict[str, list[str]] = {}
    for c in over:
        groups.setdefault(top(c), []).append(c)
    return sorted(("".join(sorted(group)) for group in groups.values()), key=lambda g: (-len(g), g))  # what is tried first holds most


class PieceCodec:
    """The vocabulary of a sentencepiece model of kind BPE: identity normalisation, a space in front, byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = messages.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kind, normal, pieces = model.trainer_spec, model.normalizer_spec, model.pieces
        normal_piece, unknown, control, byte = (messages.ModelProto.SentencePiece.Type.Value(x) for x in ("NORMAL", "UNKNOWN", "CONTROL", "BYTE"))
        if kind.model_type != kind.BPE or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces and kind.byte_fallback):
            raise ValueError(f"not a merge-type model with plain normalisation and byte fallback: {path}")
        if {p.type for p in pieces} - {normal_piece, unknown, control, byte} or any(MARK in p.piece.lstrip(MARK) for p in pieces if p.type == normal_piece):
            raise ValueError(f"pieces that are user-defined, unused or run over a space: {path}")
        self.ids = {p.piece: i for i, p in enumerate(pieces) if p.type == normal_piece}
        places = {s: n for n, s in enumerate(sorted({p.score for p in pieces}, reverse=True))}
        #: By piece: its place in the order of scores, 0 for the best; equal scores share a place.
        self.place = {p.piece: places[p.score] for p in pieces if p.type == normal_piece}
        self.longest = max(map(len, self.place), default=0)
        if self.longest > SIZE_MASK:
            raise ValueError(f"pieces of more than {SIZE_MASK} characters: {path}")
        self.byte_ids = [0] * 256
        self.surface: dict[str, str] = {}
        for i, p in enumerate(pieces):
            if p.type == byte:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            self.surface[str(i)] = p.piece if p.type == normal_piece else chr(BYTE_POINT + int(p.piece[3:5], 16)) if p.type == byte else CONTROL if p.type == control else kind.unk_surface
        kinds = kinds_of(self.place)
        inside = [as_class([*kind]) for kind in kinds]
        self.parts = re.compile("|".join([f"{MARK}*[{kind}]+" for kind in inside] + [f"{MARK}+", f"[^{MARK}{''.join(inside)}]+"]))
        #: A character that merges with nothing, to put before a part that the library is asked for, and its ids after the space.
        self.fence = next(c for c in map(chr, range(1, 128)) if c not in "".join(kinds))
        self.fence_ids = len(self.library.encode(self.fence))
        self.byte_runs = re.compile(f"[{chr(BYTE_POINT)}-{chr(BYTE_POINT + 255)}]+")
        self.known = Known(self)
        self.fresh: list[tuple[str, list[int]]] = []

    def merged(self, part: str) -> list[str]:
        """The symbols that are left of a part's characters once no adjacent pair is a piece."""
        symbols, n = [*part], len(part)
        place, longest = self.place.get, self.longest
        # An entry is a pair's place, then where it begins, then its length, in one number.
        agenda = [((p * n + i) << SIZE_BITS) + 2 for i in range(n - 1) if (p := place(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while agenda:
            entry = heappop(agenda)
            i = (entry >> SIZE_BITS) % n
            a, j = symbols[i], after[i]
            # A pair of which one side has grown or gone since is longer now, or empty.
            if not a or j == n or len(a) + len(symbols[j]) != entry & SIZE_MASK:
                continue
            whole = symbols[i] = a + symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (size := len(whole) + len(symbols[k])) <= longest and (p := place(whole + symbols[k])) is not None:
                    heappush(agenda, ((p * n + i) << SIZE_BITS) + size)
            if (h := before[i]) >= 0 and (size := len(symbols[h]) + len(whole)) <= longest and (p := place(symbols[h] + whole)) is not None:
                heappush(agenda, ((p * n + h) << SIZE_BITS) + size)
        return [s for s in symbols if s]

    def part_ids(self, part: str) -> list[int]:
        ids: list[int] = []
        for s in self.merged(part):
            if (i := self.ids.get(s)) is not None:
                ids.append(i)
            else:
                ids += map(self.byte_ids.__getitem__, s.encode("utf-8"))
        return ids

    def split(self, text: str) -> list[str]:
        return self.parts.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> str:
        """The ids of a whole text, decimal, joined by one comma."""
        return ",".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: str) -> str:
        """The text of any ids, joined by one comma: without the first space; bytes that are no UTF-8 give U+FFFD each."""
        if not ids:
            return ""
        text = "".join(map(self.surface.__getitem__, ids.split(",")))
        if CONTROL in text:  # bytes on both sides of one stay apart, and a first space may follow it
            before = text[: len(text) - len(text.lstrip(CONTROL))]
            text = before + text[len(before) :].removeprefix(MARK)
        else:
            text = text.removeprefix(MARK)
        text = text.replace(MARK, " ")
        if text.isascii():
            return text
        return self.byte_runs.sub(lambda m: bytes(ord(c) - BYTE_POINT for c in m[0]).decode("utf-8", "each byte"), text).replace(CONTROL, "")

    def check(self) -> None:
        """Compares what has been encoded since the last check with the library's ids."""
        fresh, self.fresh = self.fresh, []
        # The library puts a space in front of what it is given, which the fence keeps from the part.
        theirs = self.library.encode([self.fence + part for part, _ in fresh], num_threads=1) if fresh else []
        for (part, ids), other in zip(fresh, theirs, strict=True):
            if ids != other[self.fence_ids :]:
                raise RuntimeError(f"ids differ from the library's for {part[:80]!r}")


class Known(dict):
    """Ids of parts, encoded when first asked for. When full it is set aside, and what is asked for again returns from there."""

    def __init__(self, codec: PieceCodec) -> None:
        self.codec = codec
        self.aside: dict[str, str] = {}

    def __missing__(self, part: str) -> str:
        made = self.aside.get(part)
        if made is None:
            ids = self.codec.part_ids(part)
            self.codec.fresh.append((part, ids))
            made = ",".join(map(str, ids))
        if len(part) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.aside = dict(self)
                self.clear()
            self[part] = made
        return made


def count(ids: str) -> int:
    return ids.count(",") + 1 if ids else 0


def codec(path: str) -> PieceCodec:
    """The worker's codec, so that what one task has encoded serves the next."""
    return held(f"pieces {path}", lambda: PieceCodec(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (decimal, joined by a comma) and decoded text.

    A narrow transformation: one pass over the two columns, no shuffle. ``path`` must exist on each executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            ids = [pieces.encode(t or "") for t in batch.column(1).to_pylist()]
            pieces.check()
            yield pa.record_batch(
                [batch.column(0), pa.array(map(count, ids), pa.int64()), pa.array(ids, pa.large_string()), pa.array(map(pieces.decode, ids), pa.large_string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids = pieces.encode(text.as_py() or "")
                n.append(count(ids))
                of_ids.append(hashlib.sha256(ids.encode("ascii")).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(ids).encode("utf-8")).hexdigest())
            pieces.check()
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
