"""Byte-pair encoding and decoding with a segment tree over adjacent pairs.

A text is cut at the special tokens, then into pieces by the byte-level rule (PIECES); a piece starts as its bytes'
tokens. The leaves of a segment tree hold, for each token with a right neighbour, the rank of that pair and its place;
a node holds the least of its two children, so the root names the leftmost pair of the lowest rank. Merging it changes
three leaves (the pair's own, the swallowed token's and the left neighbour's) and their ways to the root; it ends when
the root is empty. A piece of n bytes costs n log n steps at most.

Pieces up to LANES bytes are worked in lanes: one numpy row per distinct piece, each with a tree of its own, all rows
taking one merge a step; longer pieces run the same tree alone. Each task keeps the tokens of at most CACHE bytes of
distinct pieces; then it starts a new store, so memory is bounded and nothing depends on the order of the rows.
The vocabulary travels with the tasks: its size is that of the file, whatever the data.

A text is worked in stretches of about STRETCH characters, cut where white space follows other characters: no piece
reaches over such a place. Only a text without any white space in a stretch is held longer.

Defined results: a null text is the empty text, which has no tokens and decodes to the empty text; equal rows give equal
rows; an empty table gives an empty result; ids without an entry in the vocabulary are an error in `decode`. Columns other
than those named are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktab.llm.common import query, table

LANES = 128
LANE_CELLS = 1 << 21     # cells of one numpy tree
CACHE = 6 << 20          # bytes of distinct pieces kept by a task
STRETCH = 1 << 18
_NONE = np.int32(2 ** 31 - 1)

# The byte-level piece rule, and the code points (first, last) that count as neither letter nor number in it because they
# were assigned after its character tables.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATER = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]
_later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
_PLAIN = regex.compile(PIECES)
_LATER = regex.compile(f"[{_later}]")
_STRICT = regex.compile(PIECES.replace(r"\p{L}+", rf"[\p{{L}}--[{_later}]]+").replace(r"\p{N}+", rf"[\p{{N}}--[{_later}]]+")
                        .replace(r"[^\s\p{L}\p{N}]+", rf"[[^\s\p{{L}}\p{{N}}]||[{_later}]]+"), regex.V1)
_SPACE = regex.compile(r"(?<=\S)\s")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1 ones as they are, the rest from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Parts of a text, cut only between a character and white space after it."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def pieces(text: str) -> list[str]:
    try:
        text.encode("latin-1")  # quicker than a search, and true of most texts
    except UnicodeEncodeError:
        if _LATER.search(text):
            return _STRICT.findall(text)
    return _PLAIN.findall(text)


@dataclass
class Vocabulary:
    """Tables of a byte-level vocabulary."""
    first: np.ndarray                 # token of each byte
    pairs: np.ndarray                 # left << 32 | right, sorted
    rank_of: np.ndarray               # rank of each of them
    merged: np.ndarray                # token that each rank makes
    spelling: list[bytes | None]      # bytes of each token
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a tokenizer file with a byte-level BPE model, read where the job is planned."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()
        plain = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        rule = data.get("pre_tokenizer") or {}
        if (model.get("type") != "BPE" or data.get("normalizer") or rule.get("type") != "ByteLevel" or rule.get("add_prefix_space")
                or not rule.get("use_regex", True) or any((model.get(k) or v) != v for k, v in plain.items())):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        if any(t[k] for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special tokens that take their surroundings aren't handled")
        vocab = model["vocab"]
        of = {c: b for b, c in enumerate(letters)}
        spelling: list[bytes | None] = [None] * (max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1)
        for token, i in vocab.items():
            spelling[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for content, i in special.items():
            spelling[i] = content.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[m[j]] for m in merges], dtype=np.int64) for j in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        return cls(np.array([vocab[c] for c in letters], dtype=np.int32), keys[order], order.astype(np.int32),
                   np.array([vocab["".join(m)] for m in merges], dtype=np.int32), spelling, special)

    @cached_property
    def known(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.rank_of.tolist()))

    @cached_property
    def letters(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of bytes) of each token in (all bytes in a row)."""
        size = np.array([len(x or b"") for x in self.spelling])
        return np.cumsum(size) - size, size, np.frombuffer(b"".join(x or b"" for x in self.spelling), dtype=np.uint8)

    def spell(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of runs of tokens; the first begins at ends[0]."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.spelling) or any(self.spelling[i] is None for i in np.unique(ids).tolist())):
            raise ValueError("an id isn't in the vocabulary")
        start, size, letters = self.letters
        size = size[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        data = letters[np.repeat(start[ids] - stop[:-1], size) + np.arange(stop[-1])]
        edge = stop[ends]
        try:
            data.tobytes().decode("utf-8")
            whole = not ((data[edge[:-1][edge[:-1] < len(data)]] & 0xC0) == 0x80).any()  # no text begins inside a character
        except UnicodeDecodeError:
            whole = False
        if whole:
            return pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(data))
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edge, edge[1:])], pa.string())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it can't merge."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.rank_of[at], _NONE) if len(self.pairs) else np.full(len(keys), _NONE)


def merge_alone(data: bytes, vocab: Vocabulary) -> np.ndarray:
    """Tokens of one piece of any length."""
    n = len(data)
    ids = vocab.first[np.frombuffer(data, dtype=np.uint8)]
    if n < 2:
        return ids
    width = 1 << (n - 1).bit_length()
    far = (int(_NONE) + 1) * width
    tree = np.full(2 * width, far, dtype=np.int64)
    ranks = vocab.ranks(ids[:-1], ids[1:]).astype(np.int64)
    tree[width:width + n - 1] = np.where(ranks == _NONE, far, ranks * width + np.arange(n - 1))
    level = width
    while level > 1:
        tree[level // 2:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
        level //= 2
    tree, ids = tree.tolist(), ids.tolist()
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    known, merged = vocab.known, vocab.merged

    def put(place: int) -> None:
        rank = known.get(ids[place] << 32 | ids[after[place]]) if after[place] >= 0 else None
        set_leaf(place, far if rank is None else rank * width + place)

    def set_leaf(place: int, value: int) -> None:
        at = place + width
        tree[at] = value
        at >>= 1
        while at:
            a, b = tree[2 * at], tree[2 * at + 1]
            least = a if a < b else b
            if tree[at] == least:
                break
            tree[at] = least
            at >>= 1

    while tree[1] < far:
        rank, place = divmod(tree[1], width)
        gone = after[place]
        ids[place] = int(merged[rank])
        after[place] = after[gone]
        if after[gone] >= 0:
            before[after[gone]] = place
        set_leaf(gone, far)
        put(place)
        if before[place] >= 0:
            put(before[place])
    out, place = [], 0
    while place >= 0:
        out.append(ids[place])
        place = after[place]
    return np.array(out, dtype=np.int32)


def merge_lanes(data: list[bytes], width: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(all tokens, number of tokens of each piece) of pieces of 1 to `width` bytes; width is a power of two, 2 at least."""
    n = np.array([len(d) for d in data])
    rows, cols = len(data), np.arange(width)
    filled = cols < n[:, None]
    ids = np.zeros((rows, width), dtype=np.int32)
    ids[filled] = vocab.first[np.frombuffer(b"".join(data), dtype=np.uint8)]
    paired = cols[:-1] < n[:, None] - 1
    tree = np.full((rows, 2 * width), _NONE, dtype=np.int64)
    ranks = vocab.ranks(ids[:, :-1][paired], ids[:, 1:][paired]).astype(np.int64)
    tree[:, width:-1][paired] = np.where(ranks == _NONE, _NONE, ranks * width + np.nonzero(paired)[1])
    level = width
    while level > 1:
        np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
        level //= 2
    ids, tree, alive = ids.ravel(), tree.ravel(), filled.copy().ravel()
    after = np.where(cols + 1 < n[:, None], cols + 1, -1).ravel()
    before = np.broadcast_to(cols - 1, (rows, width)).copy().ravel()
    lane = np.arange(rows)
    while True:
        lane = lane[tree[lane * 2 * width + 1] < _NONE]
        if not len(lane):
            break
        base, root = lane * width, lane * 2 * width
        rank, place = np.divmod(tree[root + 1], width)
        gone = after[base + place]
        follow = after[base + gone]
        token = vocab.merged[rank]
        ids[base + place], alive[base + gone], after[base + place] = token, False, follow
        has = follow >= 0
        before[(base + follow)[has]] = place[has]
        tree[root + width + gone] = _NONE
        new = np.full(len(lane), _NONE, dtype=np.int64)
        found = vocab.ranks(token[has], ids[(base + follow)[has]]).astype(np.int64)
        new[has] = np.where(found == _NONE, _NONE, found * width + place[has])
        tree[root + width + place] = new
        prior = before[base + place]
        has = np.flatnonzero(prior >= 0)
        found = vocab.ranks(ids[(base + prior)[has]], token[has]).astype(np.int64)
        tree[(root + width + prior)[has]] = np.where(found == _NONE, _NONE, found * width + prior[has])
        ways = [(root, width + gone), (root, width + place), (root[has], width + prior[has])]
        while ways[0][1][0] > 1:  # every way is as long as the tree is high
            ways = [(r, at >> 1) for r, at in ways]
            for r, at in ways:
                left = r + 2 * at
                tree[r + at] = np.minimum(tree[left], tree[left + 1])
    return ids[alive], alive.reshape(rows, width).sum(axis=1)


def merge_all(data: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in data, in the order worked; number of tokens of each; all tokens)."""
    lengths = np.array([len(d) for d in data])
    width_of = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    order, sizes, tokens = [], [], []
    for width in np.unique(width_of[lengths <= LANES]).tolist():
        members = np.flatnonzero((width_of == width) & (lengths <= LANES))
        step = max(1, LANE_CELLS // width)
        for at in range(0, len(members), step):
            flat, n = merge_lanes([data[i] for i in members[at:at + step]], width, vocab)
            order.append(members[at:at + step])
            sizes.append(n)
            tokens.append(flat)
    for i in np.flatnonzero(lengths > LANES):
        tokens.append(merge_alone(data[i], vocab))
        order.append(np.array([i]))
        sizes.append(np.array([len(tokens[-1])]))
    return np.concatenate(order), np.concatenate(sizes), np.concatenate(tokens)


class Encoder:
    """Tokens of texts, with a bounded store of pieces already merged."""

    def __init__(self, vocab: Vocabulary, room: int = CACHE):
        self.vocab, self.room = vocab, room
        marks = sorted(vocab.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}   # of each piece
        self.start, self.size, self.tokens = (np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int32))
        self.held = 0

    def parts(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces, and special tokens."""
        for i, part in enumerate(self.marks.split(text) if self.marks else [text]):
            if i % 2:
                yield self.vocab.special[part]
            elif part:
                for stretch in stretches(part):
                    yield pieces(stretch)

    def learn(self, found: list[str]) -> None:
        new = list(set(found) - self.number.keys())
        if not new:
            return
        if self.held > self.room:
            self.clear()
            new = list(set(found))
        data = [p.encode() for p in new]
        order, sizes, tokens = merge_all(data, self.vocab)
        first = len(self.number)
        self.number.update(zip([new[i] for i in order.tolist()], range(first, first + len(new))))
        self.start = np.concatenate([self.start, len(self.tokens) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.held += sum(map(len, data))

    def gather(self, found: list[str]) -> np.ndarray:
        """Tokens of known pieces in a row."""
        at = np.fromiter(map(self.number.__getitem__, found), dtype=np.int64, count=len(found))
        size = self.size[at]
        return self.tokens[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each text; the new pieces of many texts are merged together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | int]] = []
        size = 0

        def settle() -> None:
            self.learn([p for _, part in waiting if not isinstance(part, int) for p in part])
            for i, part in waiting:
                out[i].append(np.array([part], dtype=np.int32) if isinstance(part, int) else self.gather(part))
            waiting.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                waiting.append((i, part))
                size += 1 if isinstance(part, int) else len(part)
                if size > STRETCH:
                    settle()
                    size = 0
        settle()
        return [np.concatenate(x) if x else np.empty(0, dtype=np.int32) for x in out]


def _slices(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches whose column holds about `most` bytes at the most, or one row."""
    for batch in batches:
        whole = batch.column(column)
        sizes = np.diff(np.asarray(whole.offsets)) if isinstance(whole, pa.ListArray) else np.array(pc.binary_length(whole).fill_null(0))
        group = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _shape(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encode(docs: DataFrame, vocab: Vocabulary, *keep: Column, back: bool = False) -> DataFrame:
    """The columns named in keep (doc_id unless given) and ids (array of int) of every whole text.

    With `back` also decoded: the text that the ids spell, found in the same pass so that they travel once.
    """
    rows = docs.select(*(keep or [F.col("doc_id")]), F.coalesce("text", F.lit("")).alias("__t"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as large as the vocabulary file
    made = ["ids", "decoded"] if back else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in _slices(batches, len(names), 2 << 20):
            found = encoder.encode(batch.column(len(names)).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            ids = np.concatenate(found)
            out = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))]
            if back:
                out.append(encoder.vocab.spell(ids, ends))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=[*names, *made])

    return rows.mapInArrow(run, ", ".join([_shape(rows.drop("__t")), "ids array<int>", "decoded string"][:len(made) + 1]))


def decode(tokens: DataFrame, vocab: Vocabulary, *keep: Column) -> DataFrame:
    """The columns named in keep (all unless given) and text: the bytes of the ids (array of int; null: none) in a row.

    Bytes that aren't UTF-8 become U+FFFD.
    """
    rows = tokens.select(*(keep or [F.col(f"`{x}`") for x in tokens.columns]), F.col("ids").alias("__ids"))
    names = rows.columns[:-1]
    shared = tokens.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(names), 1 << 19):
            ids = batch.column(len(names))
            ends = np.asarray(ids.offsets)
            texts = shared.value.spell(ids.flatten().to_numpy(zero_copy_only=False), ends - ends[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, "text"])

    return rows.mapInArrow(run, f"{_shape(rows.drop('__ids'))}, text string")


@query("op13_bpe_coding")
def op13_bpe_coding(spark, folder):
    import public_tokenizers
    vocab = Vocabulary.load(public_tokenizers.path("byte_bpe_50k.json"))
    coded = encode(table(spark, folder, "documents"), vocab, back=True)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
