"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often they do so in the corpus.

Each text, with a space in front, has a label for each of its bytes: none, the end of a token of A, of one of B, or of both.
A regular expression scans the labels for spans up to each both-label; the counts of labels in a span are the tokens of A
and B in that group, and all A-B pairs of a group are linked.

Texts are encoded in parts that no merge crosses, looked up once encoded, so numpy handles whole slices of documents. A task
works through chunks of documents. A chunk leaves one list of its different id pairs with the number of its documents that
hold each; documents refer to places in that list. The corpus-wide counts are sums over chunks, and only each chunk's list,
not each document's, is joined with them: a pair that is in every document meets the join once per chunk. Counts then
return to the documents of the chunk. The chunks are a stored table, so a lost executor repeats none of the encoding.

Texts that are null, empty or hold what a tokenizer does not give back byte by byte (U+2581 in B) have no tokens: zeros and
an empty ``groups_sha256``. Repeated rows and ids are documents of their own. Ties in counts are all best. Texts are never
cut; one of many megabytes takes memory in proportion to it, and a group of very many tokens is linked by its different
ids and their numbers, not token by token. No rows give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.bpe import Tables, byte_letters, id_and_text, library_tables
from cinderlake.llm.common import Stored, held, slices
from cinderlake.llm.pieces import MARK, PieceCodec
from cinderlake.shipping import ship

#: Characters of text that numpy handles at once, and that make a chunk.
SLICE_CHARS, CHUNK_CHARS = 500_000, 4_000_000
#: Parts and ids that a worker keeps of each tokenizer (some 50 MB), and pairs of a group from which it is linked by different ids.
KNOWN_PARTS, KNOWN_IDS, LARGE_GROUP = 250_000, 4_000_000, 4096
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
SPAN = re.compile(rb"[\x01\x02]*\x03")
# What byte-level BPE splits a text by; {l}, {n} and {s} are its letters, numbers and white space.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"


def low_part(ranges: str) -> str:
    """What of the ranges of a character class, as ``as_class`` writes them, begins up to U+FFFF."""
    return "".join(r for r in re.findall(r"\\U[0-9a-f]{8}-\\U[0-9a-f]{8}", ranges) if r[2:6] == "0000")


class Lexicon:
    """Parts of texts, numbered as they come, with their token ids laid end to end."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]) -> None:
        if not {bytes([b]) for b in range(256)} <= {*token_bytes}:
            raise ValueError("not every byte has a token, so texts may not come back byte by byte")
        self.encode = encode
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)
        self.row: dict[str, int] = {}
        self.ids, self.starts, self.used, self.sound = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self, parts: set[str]) -> None:
        """Numbers parts not seen before; ``sound`` tells whether the tokens have as many bytes as the part."""
        fresh = [*parts.difference(self.row)]
        if not fresh:
            return
        ids = self.encode(fresh)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        n_bytes = np.fromiter((len(p) if p.isascii() else len(p.replace(MARK, " ").encode("utf-8")) for p in fresh), np.int64, len(fresh))
        self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
        ends = np.cumsum(counts)
        self.sound = np.concatenate([self.sound, sums(self.lengths[flat], np.concatenate([[0], ends])) == n_bytes])
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.ids = np.concatenate([self.ids, flat])
        self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])

    def forget(self) -> None:
        """Keeps the half of the parts that were used most."""
        keep = np.sort(np.argpartition(self.used, len(self.used) // 2)[len(self.used) // 2 :])
        counts = np.diff(self.starts)[keep]
        ends = np.cumsum(counts)
        if ends[-1] > KNOWN_IDS // 2:
            keep, counts, ends = keep[:0], counts[:0], ends[:0]
        parts = [*self.row]
        self.row = {parts[k]: i for i, k in enumerate(keep.tolist())}
        self.ids = self.ids[np.repeat(self.starts[keep] - ends + counts, counts) + np.arange(int(counts.sum()))]
        self.starts, self.used, self.sound = np.concatenate([[0], ends]), self.used[keep] // 2, self.sound[keep]

    def tokens(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, given in parts, end to end; number of tokens of each text; whether each text is sound."""
        self.learn(set().union(*texts))
        n_parts = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(texts)), np.int64, int(n_parts.sum()))
        self.used += np.bincount(rows, minlength=len(self.used))
        counts = np.diff(self.starts)[rows]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.starts[rows] - ends + counts, counts) + np.arange(int(counts.sum()))]
        edge = np.concatenate([[0], np.cumsum(n_parts)])
        bad = np.concatenate([[0], np.cumsum(~self.sound[rows])])[edge]
        out = ids, np.diff(np.concatenate([[0], ends])[edge]), np.diff(bad) == 0
        if len(self.row) > KNOWN_PARTS or len(self.ids) > KNOWN_IDS:
            self.forget()
        return out


class Aligner:
    """Both tokenizers of a worker: A from a tokenizers JSON file of kind byte-level BPE, B from a sentencepiece model."""

    def __init__(self, a_path: str, b_path: str, tables: Tables | None = None) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tables = tables or library_tables()
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            raise ValueError(f"not plain byte-level BPE: {a_path}")
        library = Tokenizer.from_file(a_path)
        library.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():  # added tokens are text as it stands
            a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode("utf-8")
        self.a = Lexicon(lambda parts: [e.ids for e in library.encode_batch_fast(parts, add_special_tokens=False)], a_bytes)
        pieces = self.pieces = PieceCodec(b_path)
        library_b, fence, skip = pieces.library, pieces.fence, pieces.fence_ids
        b_bytes = [bytes([int(p[3:5], 16)]) if library_b.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i in range(len(library_b)) for p in [library_b.id_to_piece(i)]]

        def b_ids(parts: list[str]) -> list[list[int]]:  # the fence keeps from a part the space that the library puts in front
            return [ids[skip:] for ids in library_b.encode([fence + p for p in parts], num_threads=1)]

        self.b = Lexicon(b_ids, b_bytes)
        self.n_b = len(b_bytes)
        self.split_any = re.compile(BYTE_LEVEL_PATTERN.format(l=tables.letters, n=tables.numbers, s=tables.spaces))
        # Characters of a class are looked up fast as long as it has none beyond U+FFFF.
        self.split_low = re.compile(BYTE_LEVEL_PATTERN.format(l=low_part(tables.letters), n=low_part(tables.numbers), s=low_part(tables.spaces)))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.split_ascii = re.compile(BYTE_LEVEL_PATTERN.format(l="a-zA-Z", n="0-9", s=r"\t-\r "))
        width = len(str(max(len(a_bytes), self.n_b))) + 1
        #: Decimal ids with what follows them in a group: a comma, or behind the last of A a bar and the last of B a semicolon.
        self.names = np.array([f"{i}{c}".encode() for n, marks in ((len(a_bytes), ",|"), (self.n_b, ",;")) for c in marks for i in range(n)], f"S{width}")
        self.n_a = len(a_bytes)

    def a_parts(self, text: str) -> list[str]:
        split = self.split_ascii if text.isascii() else self.split_any if self.beyond.search(text) else self.split_low
        return split.findall(" " + text)

    def align(self, texts: list[str | None]) -> Slice:
        """Groups and links of the texts, all at once: their labels stand end to end, as every text ends with a both-label."""
        usable = [i for i, t in enumerate(texts) if t and MARK not in t]
        given = [texts[i] for i in usable]
        a_ids, a_count, a_sound = self.a.tokens([*map(self.a_parts, given)])
        b_ids, b_count, b_sound = self.b.tokens([*map(self.pieces.split, given)])
        sound = a_sound & b_sound
        a_ids, b_ids = a_ids[np.repeat(sound, a_count)], b_ids[np.repeat(sound, b_count)]
        a_count, b_count = a_count[sound], b_count[sound]
        return Slice(self, len(texts), np.array(usable, np.int64)[sound], a_ids, a_count, b_ids, b_count)


class Slice:
    """What ``Aligner.align`` finds: numbers of each text, and its different id pairs with how often they are linked."""

    def __init__(self, of: Aligner, n: int, rows: np.ndarray, a_ids: np.ndarray, a_count: np.ndarray, b_ids: np.ndarray, b_count: np.ndarray) -> None:
        a_end, b_end = np.cumsum(of.a.lengths[a_ids]), np.cumsum(of.b.lengths[b_ids])
        labels = np.zeros(int(a_end[-1]) if len(a_end) else 0, np.uint8)
        labels[a_end - 1] |= A_END
        labels[b_end - 1] |= B_END
        ends = labels.tobytes().translate(None, bytes([NONE]))  # what has no label is in no count
        span_ends = np.cumsum(np.fromiter(map(len, SPAN.findall(ends)), np.int64))  # each begins where the last one ended
        span_starts = np.concatenate([[0], span_ends[:-1]]) if len(span_ends) else span_ends
        marks = np.frombuffer(ends, np.uint8)
        before = lambda label: np.concatenate([[0], np.cumsum((marks & label) != 0)])
        a_before, b_before = before(A_END), before(B_END)
        a_from, b_from = a_before[span_starts], b_before[span_starts]
        n_a, n_b = a_before[span_ends] - a_from, b_before[span_ends] - b_from
        text_of = np.searchsorted(np.cumsum(a_count), a_from, "right") if len(a_from) else np.zeros(0, np.int64)
        self.n = n
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, np.int64) for _ in range(4))
        self.n_a[rows], self.n_b[rows] = a_count, b_count
        self.n_groups[rows] = np.bincount(text_of, minlength=len(rows))[: len(rows)]
        self.n_links[rows] = sums(n_a * n_b, np.searchsorted(text_of, np.arange(len(rows) + 1)))
        self.digests = [""] * n
        self.name(of, rows, a_ids, a_count, b_ids, b_count, n_a, n_b)
        self.link(of, rows[text_of], a_ids, b_ids, a_from, b_from, n_a, n_b)

    def name(self, of: Aligner, rows, a_ids, a_count, b_ids, b_count, n_a, n_b) -> None:
        """Digests of the groups: A's ids, a bar, B's ids, a semicolon, laid out at the places that the group sizes give."""
        out = np.empty(len(a_ids) + len(b_ids), np.int64)
        a_shift, b_shift = np.cumsum(n_b) - n_b, np.cumsum(n_a)
        a_last, b_last = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
        a_last[np.cumsum(n_a) - 1] = 1
        b_last[np.cumsum(n_b) - 1] = 1
        out[np.arange(len(a_ids)) + np.repeat(a_shift, n_a)] = a_ids + of.n_a * a_last
        out[np.arange(len(b_ids)) + np.repeat(b_shift, n_b)] = b_ids + 2 * of.n_a + of.n_b * b_last
        edge = np.concatenate([[0], np.cumsum(a_count + b_count)])
        for k, row in enumerate(rows.tolist()):
            text = of.names[out[edge[k] : edge[k + 1]]].tobytes().translate(None, b"\0")
            self.digests[row] = hashlib.sha256(text[:-1]).hexdigest()

    def link(self, of: Aligner, row_of, a_ids, b_ids, a_from, b_from, n_a, n_b) -> None:
        """``row``, ``pair`` (A's id times the size of B, plus B's id) and ``times``, sorted, each pair of a text once."""
        size = n_a * n_b
        small = np.flatnonzero(size <= LARGE_GROUP)
        wide = np.repeat(small, size[small])
        k = np.arange(len(wide)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        per = n_b[wide]
        rows = [row_of[wide]]
        pairs = [a_ids[a_from[wide] + k // per].astype(np.int64) * of.n_b + b_ids[b_from[wide] + k % per]]
        times = [np.ones(len(wide), np.int64)]
        for g in np.flatnonzero(size > LARGE_GROUP).tolist():
            a, a_n = np.unique(a_ids[a_from[g] : a_from[g] + n_a[g]], return_counts=True)
            b, b_n = np.unique(b_ids[b_from[g] : b_from[g] + n_b[g]], return_counts=True)
            pairs.append((a.astype(np.int64)[:, None] * of.n_b + b).ravel())
            times.append((a_n[:, None] * b_n).ravel())
            rows.append(np.full(len(pairs[-1]), row_of[g]))
        most = of.n_a * of.n_b
        key, weight = np.concatenate(rows) * most + np.concatenate(pairs), np.concatenate(times)
        if len(pairs) == 1:
            key, self.times = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            self.times = np.add.reduceat(weight[order], first) if len(first) else weight
        self.row, self.pair = np.divmod(key, most)


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of runs of values between edges; empty runs give 0."""
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[edges[1:]] - upto[edges[:-1]]


DOC = "chunk long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>"
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def chunk_batches(number: int, ids: list[pa.Array], parts: list[Slice]) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk; the last one's row carries the chunk's pairs and in how many of its documents each is."""
    pairs, places, holders = np.unique(np.concatenate([s.pair for s in parts]), return_inverse=True, return_counts=True)
    at = 0
    for i, (own, s) in enumerate(zip(ids, parts, strict=True)):
        n_pairs = np.bincount(s.row, minlength=s.n)
        at, mine = at + len(s.pair), places[at : at + len(s.pair)].astype(np.int32)
        last = i == len(parts) - 1
        carried = [lists(v if last else v[:0], np.array([0] * (s.n - 1) + [len(v) * last])) for v in (pairs, holders.astype(np.int64))]
        yield pa.record_batch(
            [pa.array([number] * s.n, pa.int64()), own, *(pa.array(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)), pa.array(s.digests, pa.string()), lists(mine, n_pairs), lists(s.times.astype(np.int64), n_pairs), *carried],
            names=["chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "chunk_pairs", "holders"],
        )


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with numbers and digest of their groups, their pairs as places in the list of their chunk, and that list in one row of the chunk."""
    tables = library_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = held(f"align {a_path} {b_path}", lambda: Aligner(a_path, b_path, tables))
        number, chars = TaskContext.get().partitionId() << 33, 0
        ids: list[pa.Array] = []
        parts: list[Slice] = []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts, SLICE_CHARS):
                ids.append(batch.column(0).slice(start, stop - start))
                parts.append(of.align(texts[start:stop]))
                chars += sum(len(t or "") for t in texts[start:stop])
                if chars >= CHUNK_CHARS:
                    yield from chunk_batches(number, ids, parts)
                    number, chars, ids, parts = number + 1, 0, [], []
        if parts:
            yield from chunk_batches(number, ids, parts)

    ship(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"{DOC}, chunk_pairs array<long>, holders array<long>")


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """``(pair, n, best)``: in how many documents a pair is linked, and whether no pair of its A id is in more. Chunks are summed up before the shuffle."""
    each = chunks.select(F.explode(F.arrays_zip("chunk_pairs", "holders")).alias("x")).select("x.*")
    counts = each.groupBy(F.col("chunk_pairs").alias("pair")).agg(F.sum("holders").alias("n"))
    a_id = F.floor(F.col("pair") / n_b)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # as many rows as A has ids at most
    return counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def told(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one chunk with the counts of its pairs."""
    order = np.argsort(found.column("pair").to_numpy())
    n, best = found.column("n").to_numpy()[order], found.column("best").to_numpy(zero_copy_only=False)[order]
    places, times = (docs.column(c).combine_chunks() for c in ("places", "times"))
    edges = np.asarray(places.offsets)
    where, weight = places.values.to_numpy(), times.values.to_numpy()
    best_links, count_sum = sums(weight * best[where], edges), sums(weight * n[where], edges)
    columns = [docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, pa.array(best_links, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], names=[c.split()[0] for c in RESULT.split(", ")])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    stored = Stored(aligned(docs, a_path, b_path, id_col, text_col), "aligned")
    counts = Stored(pair_counts(stored.df, n_b), "pairs")
    asked = stored.df.select(F.col("chunk").alias("asking"), F.explode("chunk_pairs").alias("pair"))
    found = asked.join(counts.df, "pair").select("asking", "pair", "n", "best")
    left = stored.df.select(*(c.split()[0] for c in DOC.split(", ")))
    return left.groupBy("chunk").cogroup(found.groupBy("asking")).applyInArrow(told, RESULT).withColumnRenamed("id", id_col)
