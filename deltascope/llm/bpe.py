"""Byte-pair encoding by speculation and verification, and decoding.

A tokenizer file names merges in order of rank; encoding a word applies them,
lowest rank first. Instead of merging, words are cut greedily into the longest
tokens of the vocabulary, all places of all words at once on a trie, and the cut
is verified: a sequence of tokens is what merging gives exactly if each token is
what its own text merges to and no adjacent pair is pulled apart. Only words with
a failing pair are merged exactly.

A pair (a, b) is compatible unless some merge crosses its border. While a merges
on its own, its last piece runs up the right spine of a's merge tree, and b's
first piece up b's left spine. Ranks rise along a spine, so a piece is there from
its own rank to its parent's. A merge (x, y) of pieces on the two spines happens
if its rank comes before x's parent (at the same rank the left one goes first)
and not after y's parent.

Files of one kind are read: NFC, lower case, white space dropped; contractions,
runs of letters, single digits, runs of anything else; bytes as symbols, a word's
last one with a suffix; special tokens sought in the text as it stands; no
decoder, so decoding joins tokens by a space.

The vocabulary is fixed by its file, and so is the size of what is broadcast.
Words met before are remembered up to a bound; long texts are cut at spaces.
Rows stay where they are: nothing is shuffled.

Defined results: null text is empty; an empty text has no ids and decodes to an
empty text; code points that Python's Unicode tables don't know are classed and
lower-cased by the tokenizers library itself; equal rows give equal rows; null
ids of documents are kept; an empty table gives an empty result; other columns,
whatever their names, are kept where `carry` names them.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Characters and rows handled at once, words remembered by a task, and bytes from which a word isn't remembered.
PIECE, ROWS, REMEMBERED, LONG_WORD = 1 << 18, 1000, 100_000, 64
NEVER = np.int32(2**31 - 1)
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Unicode's white space, and what follows an apostrophe in a contraction.
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable in Latin-1, else one from 256 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """The merges as arrays: ranks, trie, spines, and which tokens stand for their own text."""

    def __init__(self, model: dict):
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(vocab.values()) + 1
        left, right, self.rank = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for r, (a, b) in enumerate(pairs):
            t = vocab[a + b]
            left[t], right[t], self.rank[t] = vocab[a], vocab[b], r
        self.n, made = n, np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.pair_codes, order = np.unique(left[made].astype(np.int64) * n + right[made], return_index=True)
        self.pair_tokens = made[order]
        characters = byte_characters()
        self.inner, self.final = (np.array([vocab[c + end] for c in characters], np.int32) for end in ("", self.suffix))
        self.right_spine, self.left_spine = self._spine(right), self._spine(left)
        own, parts = np.ones(n, bool), made[np.argsort(self.rank[made])]
        kept = ~self._crossed(left[parts], right[parts], whole=False)
        for t, ok in zip(parts.tolist(), kept.tolist(), strict=True):
            own[t] = ok and own[left[t]] and own[right[t]]
        self._trie(vocab, own, {c: i for i, c in enumerate(characters)})

    def _spine(self, child: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By depth: each token's piece there (-1: none), and the rank at which it is merged away."""
        at, until, levels = np.arange(self.n, dtype=np.int32), np.full(self.n, NEVER), []
        while (at >= 0).any():
            levels.append((at, until))
            until, at = np.where(at >= 0, self.rank[at], NEVER), np.where(at >= 0, child[at], -1).astype(np.int32)
        return levels

    def merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that x and y merge to, or -1."""
        code = x.astype(np.int64) * self.n + y
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (x >= 0) & (y >= 0), self.pair_tokens[at], -1)

    def _crossed(self, a: np.ndarray, b: np.ndarray, whole: bool = True) -> np.ndarray:
        """Whether a merge crosses the border of each pair; whole=False leaves out the merge of a and b themselves."""
        found = np.zeros(len(a), bool)
        for i, (xs, x_until) in enumerate(self.right_spine):
            some = np.nonzero(~found & (xs[a] >= 0))[0]
            for j, (ys, y_until) in enumerate(self.left_spine):
                some = some[~found[some] & (ys[b[some]] >= 0)]
                if len(some) and (whole or i or j):
                    p, q = a[some], b[some]
                    token = self.merged(xs[p], ys[q])
                    rank = self.rank[token]
                    found[some] = (token >= 0) & (rank < x_until[p]) & (rank <= y_until[q])
                    if not whole:
                        found[some] &= rank < self.rank[self.merged(p, q)]
        return found

    def _trie(self, vocab: dict, own: np.ndarray, byte_of: dict) -> None:
        """Sorted codes (state * 512 + symbol) with the state that follows, and each state's token or -1. A symbol is a byte, plus 256 if it is a word's last."""
        edges, token = {}, [-1]
        for text, t in vocab.items():
            last = text.endswith(self.suffix) and len(text) > len(self.suffix)
            body = text[: -len(self.suffix)] if last else text
            if not own[t] or any(c not in byte_of for c in body):
                continue
            state = 0
            for i, c in enumerate(body):
                code = state * 512 + byte_of[c] + 256 * (last and i == len(body) - 1)
                state = edges.setdefault(code, len(token))
                if state == len(token):
                    token.append(-1)
            token[state] = t
        self.edge_codes = np.array(sorted(edges), np.int64)
        self.edge_states = np.array([edges[c] for c in self.edge_codes.tolist()], np.int64)
        self.state_token = np.array(token, np.int32)

    def longest(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each place the longest token that starts there and stays within its word, and its length."""
        token, length = np.full(len(symbols), -1, np.int32), np.zeros(len(symbols), np.int64)
        at, state, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            code = state * 512 + symbols[at + depth]
            edge = np.minimum(np.searchsorted(self.edge_codes, code), len(self.edge_codes) - 1)
            on = self.edge_codes[edge] == code
            at, state = at[on], self.edge_states[edge[on]]
            depth += 1
            found = self.state_token[state]
            hit = found >= 0
            token[at[hit]], length[at[hit]] = found[hit], depth
            on = at + depth < ends[at]
            at, state = at[on], state[on]
        return token, length

    def exact(self, symbols: list[int]) -> list[int]:
        """Merging by rank, leftmost first, over a linked list."""
        tokens, n = symbols, len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        lookup = self.pair_lookup()
        heap = [(self.rank[t], i, t) for i in range(n - 1) if (t := lookup.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, t = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j < 0 or lookup.get((tokens[i], tokens[j])) != t:
                continue
            tokens[i], tokens[j], after[i] = t, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (more := lookup.get((tokens[p], tokens[q]))) is not None:
                    heapq.heappush(heap, (self.rank[more], p, more))
        return [t for t in tokens if t >= 0]

    def pair_lookup(self) -> dict:
        if "_lookup" not in self.__dict__:
            a, b = np.divmod(self.pair_codes, self.n)
            self._lookup = dict(zip(zip(a.tolist(), b.tolist(), strict=True), self.pair_tokens.tolist(), strict=True))
        return self._lookup

    def merge_words(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many short words side by side: a round makes each word's lowest merge, the leftmost of equal ones. Tokens of all words, and how many each has."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_tokens, done_words = [tokens[:0]], [word[:0]]

        def into(i):
            follows = np.minimum(i + 1, len(tokens) - 1)
            return np.where((follows > i) & (word[follows] == word[i]), self.merged(tokens[i], tokens[follows]), -1)

        made = into(np.arange(len(tokens)))
        while len(tokens):
            rank = np.where(made >= 0, self.rank[made], NEVER)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(tokens)))
            least = np.repeat(lowest, counts)
            over = least == NEVER
            done_tokens.append(tokens[over])
            done_words.append(word[over])
            hits = np.flatnonzero((rank == least) & ~over)
            hits = hits[np.diff(word[hits], prepend=-1) > 0]
            tokens[hits] = made[hits]
            over[hits + 1] = True
            place = np.cumsum(~over) - 1
            tokens, word, made = tokens[~over], word[~over], made[~over]
            hits = place[hits]
            touched = np.concatenate([hits, hits[hits > 0] - 1])
            made[touched] = into(touched)
        tokens, word = np.concatenate(done_tokens), np.concatenate(done_words)
        return tokens[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """ids of all words, how many each has, and how many words had to be merged."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[ends - 1] += 256
        token, length = self.longest(symbols, np.repeat(ends, sizes))
        at, until, path = ends - sizes, ends, []
        while len(at):
            path.append(at)
            at = at + length[at]
            at, until = at[at < until], until[at < until]
        path = np.sort(np.concatenate(path))
        tokens, owner = token[path], np.searchsorted(ends, path, side="right")
        within = np.flatnonzero(owner[1:] == owner[:-1])
        codes, back = np.unique(tokens[within].astype(np.int64) * self.n + tokens[within + 1], return_inverse=True)
        failing = np.zeros(len(words), bool)
        failing[owner[within[self._crossed(*np.divmod(codes, self.n))[back]]]] = True
        counts = np.bincount(owner, minlength=len(words))
        if failing.any():
            base, longer = np.where(symbols >= 256, self.final[symbols & 255], self.inner[symbols & 255]), failing & (sizes > LONG_WORD)
            short = failing & ~longer
            again, n = self.merge_words(base[np.repeat(short, sizes)], sizes[short])
            kept = np.repeat(~failing, counts)
            parts, owners = [tokens[kept], again], [owner[kept], np.repeat(np.flatnonzero(short), n)]
            for i in np.flatnonzero(longer).tolist():
                parts.append(np.array(self.exact(base[ends[i] - sizes[i] : ends[i]].tolist()), np.int32))
                owners.append(np.full(len(parts[-1]), i))
            owner = np.concatenate(owners)
            tokens, counts = np.concatenate(parts)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))
        return tokens.astype(np.int32), counts, int(failing.sum())


class Tokenizer:
    """What a tokenizer file says, for tasks: it is broadcast."""

    def __init__(self, text: str):
        spec = json.loads(text)
        self.text, self.merges, self.vocab = text, Merges(spec["model"]), spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if spec["decoder"] is not None or spec["model"]["ignore_merges"] or [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer of another kind")
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for name, i in [*self.vocab.items(), *self.special.items()]:
            self.names[i] = name


@cache
def _kinds() -> np.ndarray:
    """Of every code point, as Python's tables have it."""
    of = {"L": LETTER, "N": DIGIT}
    return np.frombuffer(bytes(UNKNOWN if (k := unicodedata.category(chr(c))) == "Cn" else of.get(k[0], OTHER) for c in range(0x110000)), np.uint8)


class Encoder:
    """Encodes texts in a task."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.library, self.merged_words = tokenizer, None, 0
        self.splits = re.compile("(" + "|".join(map(re.escape, sorted(tokenizer.special, key=len, reverse=True))) + ")") if tokenizer.special else None
        self.kinds = _kinds().copy()
        self.kinds[list(WHITE_SPACE)] = SPACE
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.sizes = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _ask(self):
        if self.library is None:
            from tokenizers import Tokenizer as Library

            self.library = Library.from_str(self.tokenizer.text)
        return self.library

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if "Cn" in map(unicodedata.category, set(text)):
            return self._ask().normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def _kind(self, code: int) -> int:
        """Of a code point that Python doesn't know: whether it joins a letter, or a sign, or neither."""
        joins = lambda c: len(self._ask().pre_tokenizer.pre_tokenize_str(c + chr(code))) == 1
        return LETTER if joins("a") else OTHER if joins("!") else DIGIT

    def words(self, text: str) -> tuple[pa.StringArray, np.ndarray]:
        """The words of a normalised text, and where each begins."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kinds[points]
        if (kind == UNKNOWN).any():
            for code in np.unique(points[kind == UNKNOWN]).tolist():
                self.kinds[code] = self._kind(code)
            kind = self.kinds[points]
        before, after = np.concatenate([[SPACE], kind[:-1]]), np.concatenate([kind, [SPACE] * 4])
        starts = np.append((kind != SPACE) & ((kind != before) | (kind == DIGIT)), [False] * 4)
        near = np.append(points, np.zeros(4, np.uint32))
        quotes = np.nonzero((points == 0x27) & (before != OTHER))[0]
        for tail in CONTRACTIONS:
            hit = quotes[np.all([near[quotes + 1 + i] == ord(c) for i, c in enumerate(tail)], axis=0)]
            starts[hit + 1] = False
            starts[hit + 1 + len(tail)] |= after[hit + 1 + len(tail)] == LETTER
        starts = starts[: len(kind)]
        places = np.nonzero(starts | (kind == SPACE))[0]
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        parts = pa.StringArray.from_buffers(len(places), pa.py_buffer(np.append(byte[places], byte[-1]).astype(np.int32)), pa.py_buffer(text.encode()))
        return parts.take(pa.array(np.nonzero(starts[places])[0])), np.nonzero(starts)[0]

    def encode_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and how many each has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.sizes) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        slot = np.array([self.known.get(w, -1) for w in distinct], np.int64)
        new = np.flatnonzero(slot < 0).tolist()
        if new:
            ids, sizes, merged = self.tokenizer.merges.encode([distinct[i].encode() for i in new])
            self.merged_words += merged
            first = len(self.sizes)
            slot[new] = np.arange(first, first + len(new))
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
            self.known.update((distinct[i], k) for k, i in enumerate(new, first) if len(distinct[i]) <= LONG_WORD)
        which = slot[coded.indices.to_numpy()]
        counts, starts = self.sizes[which], (np.cumsum(self.sizes) - self.sizes)[which]
        return self.ids[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts

    def _pieces(self, text: str):
        """Special tokens' ids, and the normalised texts between them in pieces that end at spaces."""
        for part in self.splits.split(text) if self.splits else [text]:
            if part in self.tokenizer.special:
                yield self.tokenizer.special[part]
                continue
            at = 0
            while at < len(part):
                upto = len(part) if len(part) - at <= PIECE else part.rfind(" ", at, at + PIECE) + 1 or part.find(" ", at + PIECE) + 1 or len(part)
                yield self.normal(part[at:upto])
                at = upto

    def _encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces, and how many each has."""
        texts = ["" if isinstance(p, int) else p for p in pieces]
        words, places = self.words(" ".join(texts) + " ")
        ids, counts = self.encode_words(words) if len(words) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        upto = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(places, np.cumsum([len(t) + 1 for t in texts]))]
        n, special = np.diff(upto, prepend=0), [i for i, p in enumerate(pieces) if isinstance(p, int)]
        if special:
            ids = np.insert(ids, upto[special], [pieces[i] for i in special]).astype(np.int32)
            n[special] = 1
        return ids, n

    def __call__(self, texts: list[str]) -> pa.ListArray:
        counts, found, held, length = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            for piece in self._pieces(text):
                held.append((i, piece))
                length += 1 if isinstance(piece, int) else len(piece)
                if length >= PIECE:
                    found.append(self._add(held, counts))
                    held, length = [], 0
        found.append(self._add(held, counts))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))

    def _add(self, held: list, counts: np.ndarray) -> np.ndarray:
        ids, n = self._encode_pieces([p for _, p in held]) if held else (np.zeros(0, np.int32), [])
        np.add.at(counts, [i for i, _ in held], n) if held else None
        return ids


def load(path: str) -> Tokenizer:
    with open(path, encoding="utf-8") as file:
        return Tokenizer(file.read())


def _joined(ids: pa.Array, names: list[str]) -> pa.StringArray:
    """The tokens of each list of ids, joined by a space."""
    flat, bounds = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0))]).tolist()
    return pa.array([" ".join(map(names.__getitem__, flat[a:b].tolist())) for a, b in pairwise(bounds)], pa.string())


def encode(docs: DataFrame, tokenizer: Tokenizer, *, doc_id="doc_id", text="text", carry=(), decoded: bool = False) -> DataFrame:
    """The columns of `carry` as a struct `row` where there are any, and doc_id, ids; with `decoded` also what `decode` gives, made in the same Python process."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                ids = encoder(part.column(part.num_columns - 1).to_pylist())
                more = [_joined(ids, shared.value.names)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, *more], [*batch.schema.names[:-1], "ids", *(["decoded"] if decoded else [])])

    rows = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *made]))


def decode(encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """encoded with a column `decoded`: the tokens of its column `ids`, special ones too, joined by a space."""
    shared, at = encoded.sparkSession.sparkContext.broadcast(tokenizer.names), encoded.columns.index("ids")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _joined(batch.column(at), shared.value)], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def op13_bpe(spark, sf_dir):
    import public_tokenizers

    tokenizer = load(public_tokenizers.path("word_bpe_49k.json"))
    found = encode(table(spark, sf_dir, "documents"), tokenizer, decoded=True)  # one Python process a task, not two
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
