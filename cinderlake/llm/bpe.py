"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf of the tree holds the merge rank of one adjacent pair of symbols; the root is the lowest rank, leftmost
first. A merge changes three leaves, each in logarithmic time, so a run of n symbols costs O(n log n) even where
a text is one unbroken word. Pre-tokens repeat, so short ones are looked up once encoded.

Letters, numbers, white space, lower case and composition are those of the tokenizers library, whose Unicode tables are
older than Python's: ``library_tables`` asks it once, on the driver, for what a character is. Ids, merges and decoding
are made here.

Null and empty texts, and texts of white space alone, have no ids and an empty decoded text. Rows are encoded one by
one, so repeated rows and ids give equal rows and nothing depends on order; no rows give no rows. A text is never cut:
one of many megabytes is encoded whole, in memory that grows with that text alone.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cinderlake.llm.common import column, held
from cinderlake.shipping import ship

NONE = 1 << 60
#: Encoded pre-tokens that a Python worker keeps, and their longest length; as many may be set aside. Some 50 MB.
CACHE_ENTRIES, CACHE_LENGTH = 120_000, 48


@dataclass(frozen=True)
class Tables:
    """What the library takes characters for: members of character classes, lower case and composition where they are not Python's."""

    letters: str
    numbers: str
    spaces: str
    lower: tuple[tuple[str, str], ...]
    #: Characters that are in another class for the module ``regex``.
    other_class: str
    #: Characters that Python's tables compose or reorder and the library's do not: they part a text.
    apart: str


def as_class(found: list[str]) -> str:
    """Runs of characters as the inside of a character class."""
    points = sorted({ord(c) for run in found for c in run})
    ends = [i for i, (a, b) in enumerate(zip(points, points[1:], strict=False)) if b != a + 1] + [len(points) - 1]
    starts = [0] + [i + 1 for i in ends[:-1]]
    return "".join(f"\\U{points[a]:08x}-\\U{points[b]:08x}" for a, b in zip(starts, ends, strict=True)) if points else ""


@lru_cache(maxsize=1)
def library_tables() -> Tables:
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(every)
    classes = (r"\p{L}", r"\p{N}", r"\s")
    members = ["".join(piece for piece, _ in pre_tokenizers.Split(Regex(p + "+"), behavior="removed", invert=True).pre_tokenize_str(whole)) for p in classes]
    other = set().union(*({*mine} ^ {*regex.findall(p, whole)} for p, mine in zip(classes, members, strict=True)))
    rest = [c for c in every if c != "\n"]
    lowered = normalizers.Lowercase().normalize_str("\n".join(rest)).split("\n")
    nfc = normalizers.NFC().normalize_str
    apart = set()
    for c in every:
        if unicodedata.combining(c) and any(unicodedata.normalize("NFC", t) != nfc(t) for t in (f"a{c}\u0334", f"a\u0345{c}")):
            apart.add(c)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and "<" not in parts[0]:
            pair = "".join(chr(int(x, 16)) for x in parts)
            if unicodedata.normalize("NFC", pair) != nfc(pair):
                apart.add(pair[1])
    lower = tuple((c, low) for c, low in zip(rest, lowered, strict=True) if c.lower() != low or c == "\u03a3")  # Python lowers a final sigma by its place
    return Tables(*map(as_class, members), lower, as_class(sorted(other)), as_class(sorted(apart)))


class MinTree:
    """Least value over positions; point updates in logarithmic time."""

    def __init__(self, values: list[int]) -> None:
        size = self.size = 1 << max(0, (len(values) - 1).bit_length())
        node = self.node = [NONE] * size + values + [NONE] * (size - len(values))
        for i in range(size - 1, 0, -1):
            left, right = node[2 * i], node[2 * i + 1]
            node[i] = left if left <= right else right

    def update(self, at: int, value: int) -> int:
        """Sets the value at a position and returns the least value of all."""
        node = self.node
        i = at + self.size
        node[i] = value
        while i > 1:
            other = node[i ^ 1]
            if other < value:
                value = other
            i >>= 1
            if node[i] == value:
                break
            node[i] = value
        return node[1]


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where it prints, else the next free code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class BpeCodec:
    """The tokenizer of a ``tokenizers`` JSON file: NFC, white space and case folding, split pattern, byte-level BPE."""

    def __init__(self, path: str, tables: Tables | None = None) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tables = tables or library_tables()
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        #: By the ids of a pair, in one number: its rank; and the id that a rank's pair becomes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 32 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {str(i): t for t, i in (self.vocab | self.special).items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        known = lambda letters, numbers, spaces: re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces))
        self.pattern, self.odd_pattern = regex.compile(pattern), known(tables.letters, tables.numbers, tables.spaces)
        self.ascii_pattern = known("a-zA-Z", "0-9", r"\t-\r ")  # the same for ASCII texts, which it matches faster
        # Most texts have no character that the library and Python's modules take differently: one search tells.
        odd_case = as_class([c for c, _ in tables.lower])
        # Looking a character up is fast up to U+FFFF only, so characters beyond are looked for first.
        self.unusual = re.compile(f"[{tables.apart}{tables.other_class}{odd_case}]")
        self.unusual_low = re.compile("[" + as_class([chr(c) for c in range(0x10000) if self.unusual.match(chr(c))]) + "]")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.apart = re.compile(f"([{tables.apart}])") if tables.apart else None
        self.lower = str.maketrans(dict(tables.lower))
        self.odd_case = re.compile(f"[{odd_case}]")
        self.byte_ids = [self.vocab.get(c, -1) for c in byte_letters()]
        self.last_ids = [self.vocab.get(c + self.end, -1) for c in byte_letters()]
        self.ids = Memo(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the leftmost pair of lowest rank until no adjacent pair can merge."""
        n = len(ids)
        if n < 2:
            return ids
        rank, made = self.ranks.get, self.made
        # A pair's value is its rank, then its place, so that the least one is the leftmost of the lowest rank.
        values, a = [], ids[0]
        for b in ids[1:]:
            values.append(NONE if (r := rank(a << 32 | b)) is None else r * n + len(values))
            a = b
        tree = MinTree(values)
        update = tree.update
        least = tree.node[1]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while least < NONE:
            r, i = divmod(least, n)
            ids[i] = whole = made[r]
            j = after[i]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                update(j, NONE)
            if k < n:
                before[k] = i
                least = update(i, NONE if (r := rank(whole << 32 | ids[k])) is None else r * n + i)
            else:
                least = update(i, NONE)
            if (h := before[i]) >= 0:
                least = update(h, NONE if (r := rank(ids[h] << 32 | whole)) is None else r * n + h)
        return [x for x in ids if x >= 0]

    def word(self, piece: str) -> str:
        """Ids of one pre-token, joined by one space."""
        raw = piece.encode("utf-8")
        ids = [*map(self.byte_ids.__getitem__, raw)]
        ids[-1] = self.last_ids[raw[-1]]
        return " ".join(map(str, self.merge(ids)))

    def composed(self, text: str) -> str:
        parts = self.apart.split(text) if self.apart else [text]
        return "".join(unicodedata.normalize("NFC", part) for part in parts)

    def lowered(self, text: str) -> str:
        parts, at = [], 0
        for m in self.odd_case.finditer(text):
            parts += [text[at : m.start()].lower(), m[0].translate(self.lower)]
            at = m.end()
        return "".join([*parts, text[at:].lower()])

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        composed = unicodedata.normalize("NFC", text)
        if not self.unusual_low.search(composed) and not (self.beyond.search(text) and self.unusual.search(text + composed)):
            return self.pattern.findall(composed.lower())
        return self.odd_pattern.findall(self.lowered(self.composed(text)))

    def encode(self, text: str) -> str:
        """The ids of a whole text, decimal, joined by one space."""
        ids: list[str] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                ids.append(str(self.special[part]))
            elif part:
                ids += map(self.ids.__getitem__, self.pieces(part))
        return " ".join(ids)

    def decode(self, ids: str) -> str:
        """The text of ids as ``encode`` gives them: their tokens, joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else ""


class Memo(dict):
    """Ids of pre-tokens, encoded when first asked for. A full memo is set aside, and what is asked for again returns from there."""

    def __init__(self, codec: BpeCodec) -> None:
        self.codec = codec
        self.aside: dict[str, str] = {}

    def __missing__(self, piece: str) -> str:
        made = self.aside.get(piece) or self.codec.word(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.aside = dict(self)
                self.clear()
            self[piece] = made
        return made


def count(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def codec(path: str, tables: Tables) -> BpeCodec:
    """The worker's codec, so that what one task has encoded serves the next."""
    return held(f"bpe {path}", lambda: BpeCodec(path, tables))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids (decimal, joined by a space) and decoded text.

    A narrow transformation: one pass over the two columns, no shuffle. ``path`` must exist on each executor.
    """
    tables = library_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, tables)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array(map(count, ids), pa.int64()), pa.array(ids, pa.large_string()), pa.array(map(bpe.decode, ids), pa.large_string())],
                names=["id", "n_tokens", "ids", "decoded"],
            )

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, path: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, SHA-256 of the ids and of the text decoded from them; the ids on demand."""
    tables = library_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, tables)
        for batch in batches:
            n, ids, decoded, every = [], [], [], []
            for text in batch.column(1):
                joined = bpe.encode(text.as_py() or "")
                n.append(count(joined))
                ids.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(joined).encode("utf-8")).hexdigest())
                every += [joined] * with_ids
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.record_batch(columns + [pa.array(every, pa.string())] * with_ids, names=names + ["ids"] * with_ids)

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string" * with_ids).withColumnRenamed("id", id_col)
