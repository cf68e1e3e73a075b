"""Operator 5, byte-level BPE: a lazily determinised transducer, and a streaming decoder.

The merges define, for every text w, one token sequence.  Its last token t satisfies two
conditions that are local: the bytes of t end w, and the pair (last token of the rest, t)
is *stable*, that is, merging the bytes of both gives back just these two tokens.  A
nondeterministic machine therefore guesses token starts: an item is a position where a
token may have begun, the last token before it and the node of the byte trie reached
since.  ``Transducer`` determinises this machine while it reads: a state is the tuple of
live items, interned on first sight, and its transition on a byte is computed once.  No
item lives longer than the longest token, so tokens are emitted after bounded lookahead,
as soon as all live items agree on them.

Pieces that match the pattern are encoded one by one.  As in the tiktoken library, a
piece that is itself a token stays one token.

Defined results: a null or empty text has no tokens and decodes to no bytes; repeated
rows are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import ctypes
import gc
import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches whose encoding a worker remembers in a generation, and transitions and pairs it keeps before it starts anew.
STRETCHES, TRANSITIONS, PAIRS = 300_000, 1_000_000, 500_000
#: Characters of text that are encoded at once; a longer text is encoded alone.
GROUP = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(ranks: dict[bytes, int], text: bytes, below: int = 1 << 60) -> list[int]:
    """Plain merging, lowest rank first, with ranks under ``below``; used when tokens are compiled."""
    parts = [text[i : i + 1] for i in range(len(text))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], below))
        if ranks.get(parts[best] + parts[best + 1], below) >= below:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Finite-state encoder compiled from ranks, determinised in two steps, each on first sight.

    Live token starts form a set of trie nodes.  The shorter ones are suffixes of the longest,
    which therefore names the set; ``hops`` holds its moves, the tokens that end there and which
    starts live on.  A state is such a set with the token before each of its starts; ``moves``
    holds its next state and the token that ends the text so far.
    """

    #: Stands for no token before.
    NOTHING = -1

    def __init__(self, ranks: dict[bytes, int], share: float = 1.0):
        self.ranks = ranks
        #: of TRANSITIONS and PAIRS that are kept
        self.share = share
        self.bytes_of = {v: k for k, v in ranks.items()}
        # a byte trie; token[n] is the token that node n spells, or -1
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for text, rank in ranks.items():
            node = 0
            for b in text:
                nxt = self.children[node].get(b)
                if nxt is None:
                    nxt = self.children[node][b] = len(self.token)
                    self.token.append(-1)
                    self.children.append({})
                node = nxt
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self.own: dict[int, bool] = {}
        #: by the longest live node: all live nodes and their ages in bytes, oldest first
        self.live: dict[int, tuple[tuple[int, int], ...]] = {0: ((0, 0),)}
        self.hops: dict[int, tuple[int, tuple[tuple[int, int, int], ...], tuple[int, ...]]] = {}
        self.restart()

    def restart(self) -> None:
        """Forgets all states but the first, that of an empty text."""
        self.states: list[tuple[int, tuple[int, ...]]] = [(0, (self.NOTHING,))]
        self.index = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int, int]] = {}
        if len(self.hops) > TRANSITIONS * self.share:
            self.live, self.hops = {0: ((0, 0),)}, {}

    def spine(self, token: int, right: bool) -> list[int]:
        """The token, its part at the given edge, that part's part, down to one byte."""
        out = self.spines[right].get(token)
        if out is None:
            out = [token]
            text = self.bytes_of[token]
            while len(text) > 1:
                # the merges of lower rank leave the two parts that the token was merged from
                parts = merge(self.ranks, text, below=self.ranks[text])
                text = self.bytes_of[parts[-1 if right else 0]]
                out.append(parts[-1 if right else 0])
            self.spines[right][token] = out
        return out

    def stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives these two tokens again."""
        if left < 0:  # at the start of a piece: the token must be what its own bytes merge to
            known = self.own.get(right)
            if known is None:
                known = self.own[right] = merge(self.ranks, self.bytes_of[right]) == [right]
            return known
        key = (left << 32) | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS * self.share:
                self.pairs.clear()
            known = self.pairs[key] = self.stable(-1, right) and self._never_joined(left, right)
        return known

    def _never_joined(self, left: int, right: int) -> bool:
        # Replays both sides' merges at the boundary in order of rank.  Were the symbols that
        # touch there ever the next to merge, the boundary would vanish.
        a, b, of, ranks = self.spine(left, True), self.spine(right, False), self.bytes_of, self.ranks
        i, j = len(a) - 1, len(b) - 1
        while True:
            across = ranks.get(of[a[i]] + of[b[j]])
            next_a = a[i - 1] if i else 1 << 60
            next_b = b[j - 1] if j else 1 << 60
            if across is not None and across < next_a and across <= next_b:
                return False
            if not i and not j:
                return True
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1

    def hop(self, node: int, byte: int) -> tuple[int, tuple[tuple[int, int, int], ...], tuple[int, ...]]:
        """Next set of live nodes, the tokens that end (with length and start, longest first), the starts that live on."""
        ends, starts, nodes = [], [], []
        for i, (at, age) in enumerate(self.live[node]):
            nxt = self.children[at].get(byte)
            if nxt is None:
                continue
            if self.token[nxt] >= 0:
                ends.append((self.token[nxt], age + 1, i))
            if self.children[nxt]:
                starts.append(i)
                nodes.append((nxt, age + 1))
        nodes.append((0, 0))
        target = nodes[0][0]
        self.live.setdefault(target, tuple(nodes))
        out = self.hops[node << 8 | byte] = (target, tuple(ends), tuple(starts))
        return out

    def move(self, state: int, byte: int) -> tuple[int, int, int]:
        """Next state, the last token of the text so far and its length in bytes."""
        node, before = self.states[state]
        target, ends, starts = self.hops.get(node << 8 | byte) or self.hop(node, byte)
        pairs = self.pairs
        for last, length, i in ends:
            left = before[i]
            known = pairs.get(left << 32 | last) if left >= 0 else None
            if self.stable(left, last) if known is None else known:
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        key = (target, (*[before[i] for i in starts], last))
        known = self.index.get(key)
        if known is None:
            known = self.index[key] = len(self.states)
            self.states.append(key)
        out = self.moves[state << 8 | byte] = (known, last, length)
        return out

    def stream(self, text: bytes) -> Iterator[int]:
        """Tokens of one piece, each as soon as no live item can contradict it."""
        if len(self.moves) > TRANSITIONS * self.share:
            self.restart()
        moves, state = self.moves, 0
        back: list[tuple[int, int]] = []  # last token and its length, for each end position
        done, base = 0, 0  # bytes emitted; position of back[0]
        for i, b in enumerate(text):
            hop = moves.get(state << 8 | b) or self.move(state, b)
            state = hop[0]
            back.append(hop[1:])
            if i - done >= 512:
                # common history of the live items: follow each back and keep what all share
                starts = [i + 1 - age for _, age in self.live[self.states[state][0]]]
                paths = [self._path(back, base, s, done) for s in starts]
                shared = min(map(len, paths))
                k = 0
                while k < shared and all(p[k] == paths[0][k] for p in paths):
                    k += 1
                for token, length in paths[0][:k]:
                    yield token
                    done += length
                back, base = back[done - base :], done
        yield from (t for t, _ in self._path(back, base, len(text), done))

    @staticmethod
    def _path(back: list[tuple[int, int]], base: int, end: int, done: int) -> list[tuple[int, int]]:
        out = []
        while end > done:
            out.append(back[end - 1 - base])
            end -= out[-1][1]
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 512:
            return list(self.stream(piece))
        if len(self.moves) > TRANSITIONS * self.share:
            self.restart()
        moves, state, back = self.moves, 0, []
        for b in piece:
            hop = moves.get(state << 8 | b) or self.move(state, b)
            state = hop[0]
            back.append(hop)
        out, end = [], len(back)
        while end:
            _, token, length = back[end - 1]
            out.append(token)
            end -= length
        out.reverse()
        return out

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Encodings of short pieces in order of their bytes; each is read on from where it leaves the one before."""
        if len(self.moves) > TRANSITIONS * self.share:
            self.restart()
        moves, whole, back, before = self.moves, self.ranks.get, [], b""
        for piece in pieces:
            token = whole(piece)
            if token is not None:
                yield [token]
                continue
            at = 0
            for x, y in zip(before, piece):  # noqa: B905  the shorter one ends it
                if x != y:
                    break
                at += 1
            del back[at:]
            state = back[-1][0] if at else 0
            for b in piece[at:]:
                hop = moves.get(state << 8 | b) or self.move(state, b)
                state = hop[0]
                back.append(hop)
            before, out, end = piece, [], len(piece)
            while end:
                _, token, length = back[end - 1]
                out.append(token)
                end -= length
            out.reverse()
            yield out


class Utf8Machine:
    """UTF-8 states by the number of bytes that a started character still lacks.

    ``pending`` is what a chunk's end leaves open: at most three bytes.  A byte that no
    character may hold at that place becomes U+FFFD, as Python's "replace" has it.
    """

    #: First byte (from, to), bytes that follow.
    NEEDS = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))

    def __init__(self):
        self.pending = b""

    def open_tail(self, data: bytes) -> int:
        """Length of the unfinished character that ends data."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = next((n for lo, hi, n in self.NEEDS if lo <= b <= hi), 0)
            if need < back:
                return 0
            part = data[-back:]
            # a prefix counts only if some character begins with it
            return back if codecs.getincrementaldecoder("utf-8")("replace").decode(part) == "" else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        tail = self.open_tail(data)
        self.pending = data[len(data) - tail :] if tail else b""
        return data[: len(data) - tail].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.pending = self.pending.decode("utf-8", "replace"), b""
        return out


class Codec:
    """Whole texts to ids and back, with the encodings of recent stretches remembered.

    A stretch is what stands between spaces and line feeds.  Encodings are kept in two
    generations: when the younger is full the elder goes, so that frequent stretches stay.
    """

    def __init__(self, path: str, pattern: str, share: float = 1.0):
        import regex

        self.fst = Transducer(load_ranks(path), share)
        self.share = share
        self.pieces = regex.compile(pattern).findall
        self.young: dict[str, tuple[tuple[int, ...], str]] = {}
        self.elder: dict[str, tuple[tuple[int, ...], str]] = {}
        # the cuts below are proved for the one pattern
        self.cuts = pattern == public_tokenizers.PATTERN

    def _encode(self, text: str) -> tuple[tuple[int, ...], str]:
        encode = self.fst.encode
        ids = tuple([i for piece in self.pieces(text) for i in encode(piece.encode("utf-8"))])
        return ids, ",".join(map(str, ids))

    @staticmethod
    def lasting(text: str) -> bool:
        """Whether to remember: white space at an edge, but for a stretch's first space, would hide where a text may not be cut."""
        return 0 < len(text) <= 64 and not (text[-1].isspace() or text[:2].isspace() or len(text) > 1 and text[1].isspace())

    def recall(self, text: str) -> tuple[tuple[int, ...], str]:
        """The encoding of a stretch that is not among the younger ones."""
        out = self.elder.get(text)
        if out is None:
            out = self._encode(text)
        if text == "\n" or self.lasting(text):
            self.young[text] = out
        return out

    def learn(self, texts: list[str]) -> None:
        """Encodes the new stretches of many texts in order, so that common beginnings are read once."""
        if len(self.young) >= STRETCHES * self.share:
            self.elder, self.young = self.young, {}
        if not self.cuts:
            return
        young, elder, lasting = self.young, self.elder, self.lasting
        new: set[str] = set()
        for text in texts:
            if len(text) <= GROUP * self.share:
                new.update(text.replace(" ", "\n ").split("\n"))
        new.difference_update(young)
        matched, pieces = [], set()
        for stretch in new:
            if stretch in elder:
                young[stretch] = elder[stretch]
            elif lasting(stretch):
                found = self.pieces(stretch)
                pieces.update(found)
                if len(found) > 1:
                    matched.append((stretch, found))
        order = []
        for piece in sorted(pieces.difference(young)):
            if piece in elder:
                young[piece] = elder[piece]
            else:
                order.append(piece)
        for piece, ids in zip(order, self.fst.encode_sorted([p.encode("utf-8") for p in order]), strict=True):
            young[piece] = tuple(ids), ",".join(map(str, ids))
        for stretch, found in matched:
            both = [young[p] for p in found]
            young[stretch] = tuple([i for ids, _ in both for i in ids]), ",".join([x for _, x in both])

    def parts(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """Ids, and the same in decimal, of stretches of text between matches.

        A space between two characters other than white space always begins a match of the
        pattern, and a line feed there is a match of its own; the text is cut there, so that
        frequent stretches are looked up.  Lines with other white space are matched whole,
        and so are texts with blank lines, or with white space at both sides of a line feed.
        """
        if not text:
            return []
        recall = self.recall
        if not self.cuts:
            return [self._encode(text)]
        lines = text.split("\n")
        if len(lines) > 1 and not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
            return [self.young.get(p) or recall(p) for p in self.pieces(text)]
        out = []
        feed = self.young.get("\n") or recall("\n")
        for n, line in enumerate(lines):
            if n:
                out.append(feed)
            # each stretch but a line's first keeps the space before it
            words = line.replace(" ", "\n ").split("\n")
            found = list(map(self.young.get, words))
            if None in found:
                if any(len(w) < 2 or w[1].isspace() or w[-1].isspace() for w, f in zip(words[1:], found[1:], strict=True) if f is None) or words[0][-1:].isspace() or not words[0]:
                    found = [self.young.get(p) or recall(p) for p in self.pieces(line)]
                else:
                    found = [f or recall(w) for w, f in zip(words, found, strict=True)]
            out += found
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids, _ in self.parts(text) for i in ids]

    def decode_bytes(self, ids: list[int], step: int = 4096) -> Iterator[bytes]:
        of = self.fst.bytes_of
        for i in range(0, len(ids), step):
            yield b"".join(map(of.__getitem__, ids[i : i + step]))

    def decode_stream(self, ids: list[int], step: int = 4096) -> Iterator[str]:
        machine = Utf8Machine()
        for data in self.decode_bytes(ids, step):
            yield machine.feed(data)
        yield machine.finish()


_CODECS: dict[tuple[str, str, float], Codec] = {}


def codec(path: str, pattern: str, share: float = 1.0) -> Codec:
    """One codec for each worker process."""
    if (path, pattern, share) not in _CODECS:
        _CODECS[path, pattern, share] = Codec(path, pattern, share)
    return _CODECS[path, pattern, share]


def give_back() -> None:
    """Returns to the machine what the process has freed and its allocators still hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other C libraries than glibc lack it
        ctypes.CDLL(None).malloc_trim(0)


def groups(batch: pa.RecordBatch, most: float) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts, the second column, together have some ``most`` bytes, one row at least."""
    start, size = 0, 0
    for row, length in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if row > start and size + (length or 0) > most:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _encoded(c: Codec, batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in groups(batch, GROUP * c.share):
            texts = [t or "" for t in part.column(1).to_pylist()]
            c.learn(texts)
            rows: list[tuple] = []
            for text in texts:
                parts = c.parts(text)
                ids = [i for p, _ in parts for i in p]
                back = hashlib.sha256()
                for data in c.decode_bytes(ids):
                    back.update(data)
                rows.append((len(ids), hashlib.sha256(",".join([s for _, s in parts]).encode()).hexdigest(), back.hexdigest(), *([ids] if with_ids else [])))
            kinds = [pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int32())] if with_ids else [])]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep: bool = True, share: float = 1.0) -> DataFrame:
    """Adds to each id the token ids of its text and the digests of ids and of decoded bytes.

    ``path`` names the rank file, which every executor must have at that place.  A worker keeps
    its caches, some 300 MB over 16,000 texts, for its next task, or lets them go at a task's end,
    however it ends, and their memory with them.  ``share`` makes the caches, and the texts encoded
    at once, so much smaller: it changes memory and time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here refers to itself, and the collector would walk all caches again and again
        try:
            yield from _encoded(codec(path, pattern, share), batches, with_ids)
        finally:
            gc.enable()
            if not keep:
                _CODECS.clear()
                give_back()

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))
